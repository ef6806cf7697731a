import numpy as np
import pytest

from tessella.operators.connectivity import components, enforce
from tessella.operators.slic import slic
from tessella.plans.geometry import plan, tiles
from tessella.sources.images import blobs, from_array, infer_shape, to_array

CHERRY = np.array([[1, 1, 0, 0], [1, 1, 0, 0], [1, 1, 1, 1], [1, 1, 1, 1]])


def segment(spark, image, multichannel=True, **kw):
    image = np.asarray(image)
    two_d = image.ndim == 2 or image.ndim == 3 and multichannel
    shape = (1, *image.shape[:2]) if two_d else image.shape[:3]
    return to_array(slic(from_array(spark, image, multichannel), multichannel=multichannel, ndim=image.ndim, **kw), shape, two_d)


def quadrants(h=20, w=21):
    out = np.zeros((h, w), int)
    out[:10, 10:], out[10:, :10], out[10:, 10:] = 1, 2, 3
    return out


@pytest.mark.parametrize(
    "shape, n, kw, sp_shape, grid, least, most",
    [
        ((50, 50, 50), 100, {"multichannel": False}, (11, 11, 11), (5, 5, 5), 400, 10000),
        ((3, 33, 33, 33), 100, {"multichannel": True}, (3, 4, 4), (1, 9, 9), 16, 403),
        ((3, 4, 4), 2, {"multichannel": False}, (3, 3, 3), (1, 2, 2), 4, 120),
        ((100, 100, 100), 1000.0, {}, (1, 4, 4), (1, 25, 25), 6, 160),
        ((20, 21), 4, {}, (1, 11, 11), (1, 2, 2), 42, 1050),
        ((20, 21, 22), 8, {"multichannel": False}, (11, 11, 11), (2, 2, 2), 462, 11550),
        ((2, 5), 2, {}, (1, 2, 3), (1, 1, 2), 2, 50),
        ((3, 6), 2, {"max_size_factor": 0.8}, (1, 3, 3), (1, 1, 2), 3, 7),
        ((20, 21), 500, {}, (1, 1, 1), (1, 20, 21), 0, 10),
        ((200, 200, 200), 64000, {"multichannel": False}, (5, 5, 5), (40, 40, 40), 50, 1250),
    ],
)
def test_geometry(shape, n, kw, sp_shape, grid, least, most):
    p = plan(shape, n, **kw)
    assert (p.sp_shape, p.sp_grid, p.min_size, p.max_size) == (sp_shape, grid, least, most)


def test_tiles():
    assert tiles((33,) * 3, 32) == tiles((64,) * 3, 32) == (2, 2, 2) and tiles((1, 32, 7), 32) == (1, 1, 1)


@pytest.mark.parametrize("shape, kw", [((5,), {}), ((1,) * 5, {}), ((2, 5, 1), {"convert2lab": True}), ((5, 5), {"n_segments": 0}), ((5, 5), {"compactness": 0})])
def test_errors(shape, kw):
    with pytest.raises(ValueError):
        plan(shape, **kw)


@pytest.mark.parametrize("backend", ["sql", "arrow"])
def test_golden_volume(spark, backend):
    image = np.stack([CHERRY] * 3)
    kw = dict(n_segments=2, compactness=0.1, multichannel=False, backend=backend)
    plain = [[3, 3, 2, 2], [3, 3, 2, 2], [3, 3, 4, 4], [3, 3, 4, 4]]
    joined = [[0, 0, 1, 1], [0, 0, 1, 1], [0, 0, 2, 2], [0, 0, 2, 2]]
    assert segment(spark, image, enforce_connectivity=False, **kw).tolist() == [plain] * 3
    assert segment(spark, image, **kw).tolist() == [joined] * 3


@pytest.mark.parametrize("more", [{}, {"max_size_factor": 0.8}])
def test_small_segments_are_absorbed(spark, more):
    image = np.array([[0, 0, 0, 1, 1, 1], [1, 0, 0, 1, 1, 0], [0, 0, 0, 1, 1, 0]], float)
    assert segment(spark, image, n_segments=2, compactness=0.0001, **more).tolist() == [[0, 0, 0, 1, 1, 1]] * 3


@pytest.mark.parametrize("backend", ["sql", "arrow"])
def test_fallback_to_first_center(spark, backend):
    image = np.array([[0, 0, 0, 1, 1, 1], [1, 0, 0, 1, 1, 0], [0, 0, 0, 1, 1, 0]], float)
    got = segment(spark, image, n_segments=2, compactness=0.0001, enforce_connectivity=False, backend=backend)
    assert got.tolist() == [[2, 2, 2, 1, 1, 1], [1, 2, 2, 1, 1, 2], [2, 2, 2, 1, 1, 2]]


def test_spacing(spark):
    image = np.array([[1, 1, 1, 0, 0], [1, 1, 0, 0, 0]]) + 0.1 * np.random.RandomState(0).normal(size=(2, 5))
    assert segment(spark, image, n_segments=2, compactness=1, enforce_connectivity=False).tolist() == [[1, 1, 1, 2, 2], [1, 1, 2, 2, 2]]
    assert segment(spark, image, n_segments=2, compactness=1, spacing=(1, 500, 1)).tolist() == [[0] * 5, [1] * 5]


def test_colours_in_lab_and_gray_quadrants(spark):
    r = np.random.RandomState(0)
    q = quadrants()
    colour = np.zeros((20, 21, 3))
    for channel, part in enumerate((0, 2, 3)):
        colour[q == part, channel] = 1
    colour = np.clip(colour + 0.01 * r.normal(size=colour.shape), 0, 1)
    assert (segment(spark, colour, n_segments=4, enforce_connectivity=False) - 1 == q).all()
    gray = np.clip(np.array([0.33, 0, 0.67, 1.0])[q] + 0.0033 * np.random.RandomState(0).normal(size=q.shape), 0, 1)
    assert (segment(spark, gray, n_segments=4, compactness=1) == q).all()
    assert (segment(spark, gray, n_segments=500) == np.arange(420).reshape(20, 21)).all()


def test_eight_channels(spark):
    q = quadrants(20, 20)
    image = np.zeros((20, 20, 8))
    for part in range(4):
        image[q == part, 2 * part : 2 * part + 2] = 1
    image = np.clip(image + 0.01 * np.random.RandomState(0).normal(size=image.shape), 0, 1)
    assert (segment(spark, image, n_segments=4) == q).all()


def test_octants(spark):
    part = np.zeros((20, 21, 22), int)
    part[10:] += 4
    part[:, 10:] += 2
    part[:, :, 11:] += 1
    image = np.clip(np.arange(0, 1.000001, 1 / 7)[part] + 0.001 * np.random.RandomState(0).normal(size=part.shape), 0, 1)
    assert (segment(spark, image, multichannel=False, n_segments=8, compactness=1) == part).all()


def test_edges(spark):
    assert segment(spark, CHERRY, max_iter=0, enforce_connectivity=False).tolist() == [[0] * 4] * 4
    assert segment(spark, [[3.0]], n_segments=1).tolist() == [[0]]
    hole = np.array([[np.nan, 1.0], [1.0, 1.0]])
    assert segment(spark, hole, n_segments=1, enforce_connectivity=False)[0, 0] == 1
    for dtype in (np.float32, np.float64, np.uint8, int):
        assert segment(spark, np.ones((6, 6), dtype), n_segments=4).shape == (6, 6)


def test_tables_must_be_dense(spark):
    pixels = from_array(spark, CHERRY)
    assert infer_shape(pixels) == (1, 4, 4, 1)
    for broken in (pixels.where("x > 0 or y > 0"), pixels.union(pixels.limit(1)), pixels.where("x < 0")):
        with pytest.raises(ValueError):
            infer_shape(broken)


def test_backends_agree_on_blobs(spark):
    cube = blobs(spark, 12, seed=3, grain=4)
    kw = dict(n_segments=27, compactness=2.0, multichannel=False, max_iter=3, shape=(12, 12, 12, 1))
    one, two = (slic(cube, backend=b, enforce_connectivity=False, **kw).orderBy("z", "y", "x").collect() for b in ("sql", "arrow"))
    assert one == two
    joined = slic(cube, **kw)
    p = plan((12, 12, 12), 27, 2.0, multichannel=False)
    sizes = components(joined, p).groupBy("label").agg({"comp": "min", "*": "count"}).collect()
    assert joined.count() == 12**3 and len(sizes) == joined.select("label").distinct().count()


def test_components_across_tiles(spark, monkeypatch):
    from tessella.operators import connectivity

    monkeypatch.setattr(connectivity, "TILE", 3)
    monkeypatch.setattr(connectivity, "FLAT_TILE", 3)
    image = np.array([[1, 1, 1, 1, 1, 1, 1], [1, 2, 2, 2, 2, 2, 1], [1, 2, 1, 1, 1, 2, 1], [1, 2, 2, 2, 2, 2, 1], [1, 1, 1, 1, 1, 1, 1]])
    pixels = from_array(spark, image).selectExpr("image_id", "z", "y", "x", "cast(features[0] as long) as label")
    got = to_array(enforce(pixels, plan(image.shape, 35, max_size_factor=100.0)), (1, *image.shape), True)
    ring, core = image == 2, np.zeros_like(image, bool)
    core[2, 2:5] = True
    assert got.tolist() == np.where(ring, 1, np.where(core, 2, 0)).tolist()


def test_tiles_merge_like_one_tile(spark, monkeypatch):
    from tessella.operators import connectivity

    image = np.random.default_rng(5).integers(1, 4, (7, 6, 9))
    pixels = from_array(spark, image[..., None]).selectExpr("image_id", "z", "y", "x", "cast(features[0] as long) as label").cache()
    p = plan(image.shape, 60, multichannel=False)
    whole, tiled = [], []
    for side, into in ((16, whole), (2, tiled)):
        monkeypatch.setattr(connectivity, "TILE", side)
        into += enforce(pixels, p).orderBy("z", "y", "x").collect()
    assert p.min_size > 1 and whole == tiled


def test_nearest_skips_no_winner():
    from pyspark.sql import Row
    from tessella.operators.assign import LIMIT, Centers

    p, rng = plan((9, 10, 11), 40, 0.3, (1, 2, 0.5), multichannel=False), np.random.default_rng(7)
    rows = [Row(image_id=0, c=c, f=[float(rng.normal())], cz=float(z), cy=float(y), cx=float(x), alive=bool(rng.random() < 0.8)) for c, (z, y, x) in enumerate(rng.integers(0, 11, (p.n_centers, 3)))]
    at = np.stack(np.meshgrid(*map(np.arange, (9, 10, 11)), indexing="ij"), -1).reshape(-1, 3)
    features = np.where(rng.random((len(at), 1)) < 0.01, np.nan, rng.normal(size=(len(at), 1)).round(1))
    centers = Centers([0], p)
    f, pos, alive = centers.by_image[0]
    for r in rows:
        f[r.c], pos[r.c], alive[r.c] = r.f, (r.cz, r.cy, r.cx), r.alive
    got = centers.nearest(0, at, features)
    for q, v, label in zip(at, features, got):
        home = np.minimum(q // np.array(p.sp_shape), np.array(p.sp_grid) - 1)
        best, want = LIMIT, 0
        for r in rows:
            cell = np.array(np.unravel_index(r.c, p.sp_grid))
            if r.alive and (abs(cell - home) <= 2).all():
                d = (v[0] - r.f[0]) ** 2 + sum(((a - b) * w) ** 2 for a, b, w in zip(q, (r.cz, r.cy, r.cx), p.spacing)) / p.spread
                if d < best:
                    best, want = d, r.c
        assert label == want
