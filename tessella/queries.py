"""Registered queries over images derived from the test tables, and their DuckDB counterparts."""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.color import TO_XYZ, WHITE, rgb2lab
from .operators.assign import candidates, home_cell
from .operators.assign import assign as assign_pixels
from .operators.centers import init_centers, partial_sums, update
from .operators.connectivity import components
from .operators.slic import prepared, slic
from .plans.geometry import SlicPlan, plan
from .sources.images import EMBEDDING_BOX, EVENT_TYPES, colour_image, embedding_image, events_image, lineitem_image

#: Each gives a pixel table and the shape that its lattice is laid over. Vectors may lie outside theirs: the nearest cell is their home.
IMAGES = {
    "ev": events_image,
    "evt": lambda s, d: events_image(s, d, True),
    "rgb": colour_image,
    "li2": lineitem_image,
    "li3": lambda s, d: lineitem_image(s, d, "month"),
    "li4": lambda s, d: lineitem_image(s, d, "year"),
    "emb": lambda s, d: (embedding_image(s, d), EMBEDDING_BOX),
}
#: Dimensions of the array that each image stands for, and segments.
ASKED = {"ev": (3, 30), "evt": (3, 30), "rgb": (3, 30), "li2": (3, 14), "li3": (4, 200), "li4": (4, 40), "emb": (3, 20)}


def plan_of(image: str, shape, **kw) -> SlicPlan:
    ndim, n = ASKED[image]
    return plan(shape[1:] if ndim == 3 else shape, **({"n_segments": n, "convert2lab": False, "enforce_connectivity": False} | kw))


def image(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        px, _ = IMAGES[name](spark, sf_dir)
        return px.select("z", "y", "x", F.concat_ws(",", F.transform("features", lambda v: v.cast("long").cast("string"))).alias("features"))

    return run


def init_li3(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, shape = IMAGES["li3"](spark, sf_dir)
    return init_centers(px, plan_of("li3", shape)).select("c", "gz", "gy", "gx", "cz", "cy", "cx")


def home_li3(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, shape = IMAGES["li3"](spark, sf_dir)
    return px.select("z", "y", "x", home_cell(plan_of("li3", shape)).alias("cell"))


def candidates_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, shape = IMAGES["ev"](spark, sf_dir)
    p = plan_of("ev", shape)
    near = candidates(init_centers(px, p), p).select("cell", F.size("cands").cast("long").alias("candidates"))
    return px.select("y", "x", home_cell(p).alias("cell")).join(near, "cell").select("y", "x", "candidates")


def assign_round1(name: str, **kw):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        px, shape = IMAGES[name](spark, sf_dir)
        p = plan_of(name, shape, **kw)
        home = prepared(px, p)
        return assign_pixels(home, init_centers(home, p), p, images=1).select("z", "y", "x", (F.col("c") + 1).alias("label"))

    return run


def update_round1_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, shape = IMAGES["ev"](spark, sf_dir)
    p = plan_of("ev", shape)
    home = prepared(px, p)
    centers = init_centers(home, p)
    new = update(centers, partial_sums(assign_pixels(home, centers, p), p))
    return new.select("c", F.round(F.col("f")[0], 6).alias("f0"), *(F.round(a, 6).alias(a) for a in ("cz", "cy", "cx")), "alive")


def segmented(name: str, backend: str = "sql", **kw):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        px, shape = IMAGES[name](spark, sf_dir)
        ndim, n = ASKED[name]
        out = slic(px, ndim=ndim, **({"n_segments": n, "convert2lab": False, "enforce_connectivity": False, "shape": shape, "backend": backend} | kw))
        return out.drop("image_id")

    return run


def segment_stats_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, (px, _) = segmented("ev", max_iter=2)(spark, sf_dir), IMAGES["ev"](spark, sf_dir)
    met = labels.join(px, ["y", "x"])
    return met.groupBy("label").agg(F.count("*").alias("pixels"), F.round(F.avg(F.col("features")[0].cast("double")), 6).alias("mean_count"))


def components_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = segmented("ev", max_iter=2)(spark, sf_dir).withColumns({"image_id": F.lit(0).cast("long"), "z": F.lit(0)})
    return components(labels, plan_of("ev", (1, 30, 24, 1))).select("y", "x", "label", F.col("comp").alias("component"))


def lab_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", *(((F.col(c).cast("long") * k) % 256 / 255.0).alias(a) for a, c, k in (("r", "l_partkey", 7), ("g", "l_suppkey", 11), ("b", "l_quantity", 5))))
    return p.select("l_orderkey", "l_linenumber", *(F.round(v, 4).alias(n) for v, n in zip(rgb2lab(F.col("r"), F.col("g"), F.col("b")), ("lab_l", "lab_a", "lab_b"))))


# --- DuckDB ------------------------------------------------------------------

@dataclass(frozen=True)
class Stated:
    """What the SQL takes as given, so that a wrong lattice can't pass: shape, channels, cell, cells, least and greatest size of connected segments."""

    shape: tuple[int, int, int]
    channels: int
    sp_shape: tuple[int, int, int]
    sp_grid: tuple[int, int, int]
    least: int
    greatest: int


STATED = {
    "ev": Stated((1, 30, 24), 1, (1, 5, 5), (1, 6, 5), 9, 240),
    "evt": Stated((1, 30, 24), 5, (1, 5, 5), (1, 6, 5), 9, 240),
    "rgb": Stated((1, 30, 24), 3, (1, 5, 5), (1, 6, 5), 9, 240),
    "li2": Stated((1, 7, 50), 1, (1, 5, 5), (1, 2, 10), 7, 175),
    "li3": Stated((7, 50, 83), 1, (6, 6, 6), (2, 9, 14), 46, 1152),
    "li4": Stated((7, 50, 7), 2, (4, 4, 4), (2, 13, 2), 18, 471),
    "emb": Stated((1, 20, 25), 64, (1, 5, 5), (1, 4, 5), 10, 250),
}


def _grid(z: int, y: int, x: int) -> str:
    return f"(SELECT a.z, b.y, c.x FROM range({z}) a(z), range({y}) b(y), range({x}) c(x))"


def _pixels(name: str) -> str:
    """SQL of z, y, x and channels f0, f1 and so on, as doubles."""
    (z, y, x), c = STATED[name].shape, STATED[name].channels
    if name == "emb":
        return "SELECT 0::BIGINT AS z, vec_id // 25 AS y, vec_id % 25 AS x, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE * 1000) AS f{i}" for i in range(c)) + " FROM embeddings"
    if name in ("ev", "evt", "rgb"):
        values = ["count(*)"] if c == 1 else [f"count(*) FILTER (event_type = '{t}')" for t in EVENT_TYPES[:c]]
        source = "SELECT 0 AS z, date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE) AS y, hour(ts) AS x, {} FROM events GROUP BY ALL"
    else:
        values = ["count(*)"] if c == 1 else ["count(*)", "count(*) FILTER (l_discount > 0.05)"]
        line, qty, month = "l_linenumber - 1", "CAST(trunc(l_quantity) AS BIGINT) - 1", "year(l_shipdate) * 12 + month(l_shipdate)"
        at = {"li2": ("0", line, qty), "li3": (line, qty, f"{month} - (SELECT min({month}) FROM lineitem)"), "li4": (line, qty, "year(l_shipdate) - (SELECT min(year(l_shipdate)) FROM lineitem)")}[name]
        source = f"SELECT {', '.join(f'{v} AS {a}' for a, v in zip('zyx', at))}, {{}} FROM lineitem GROUP BY ALL"
    cells = source.format(", ".join(f"{v} AS f{i}" for i, v in enumerate(values)))
    full = f"SELECT g.z, g.y, g.x, {', '.join(f'coalesce(f{i}, 0)::DOUBLE AS f{i}' for i in range(c))} FROM {_grid(z, y, x)} g LEFT JOIN ({cells}) USING (z, y, x)"
    if name != "rgb":
        return full
    levels = ", ".join(f"((f{i}::BIGINT * 24) % 256 / 255.0::DOUBLE)::FLOAT::DOUBLE AS {v}" for i, v in enumerate("rgb"))
    lab = _lab("z, y, x", f"SELECT z, y, x, {levels} FROM ({full})")
    return f"SELECT z, y, x, lab_l::FLOAT::DOUBLE AS f0, lab_a::FLOAT::DOUBLE AS f1, lab_b::FLOAT::DOUBLE AS f2 FROM ({lab})"


def _lattice(p: Stated) -> str:
    (_, gy, gx), s = p.sp_grid, p.sp_shape
    g = [f"(c // {gy * gx})", f"((c // {gx}) % {gy})", f"(c % {gx})"]
    return f"SELECT c, {', '.join(f'{e} AS g{a}' for a, e in zip('zyx', g))}, {', '.join(f'({e} * {n} + {n // 2})::DOUBLE AS c{a}' for a, e, n in zip('zyx', g, s))} FROM range({prod(p.sp_grid)}) t(c)"


def _home(p: Stated) -> list[str]:
    return [f"least({a} // {s}, {n - 1})" for a, s, n in zip("zyx", p.sp_shape, p.sp_grid)]


def _slic_sql(name: str, last: str, iters: int, compactness: float = 1.0, spacing=(1.0, 1.0, 1.0)) -> str:
    """CTEs px (pixels), k0.. (centers), e1.. (labels c of each pixel), then `last`."""
    p = STATED[name]
    n, scale, spread = p.channels, 1.0 / compactness, float(max(p.sp_shape) ** 2)
    fs = [f"f{i}" for i in range(n)]
    parts = [f"px AS MATERIALIZED (SELECT z, y, x, {', '.join(f'{f} * {scale!r} AS {f}' for f in fs)}, {', '.join(f'{h} AS h{a}' for h, a in zip(_home(p), 'zyx'))} FROM ({_pixels(name)}))"]
    parts.append(f"k0 AS MATERIALIZED (SELECT *, {', '.join(f'0.0::DOUBLE AS m{i}' for i in range(n))}, TRUE AS alive FROM ({_lattice(p)}))")
    colour = " + ".join(["0.0::DOUBLE", *(f"(px.f{i} - k.m{i}) * (px.f{i} - k.m{i})" for i in range(n))])
    place = " + ".join(["0.0::DOUBLE", *(f"((px.{a} - k.c{a}) * {float(w)!r}::DOUBLE) * ((px.{a} - k.c{a}) * {float(w)!r}::DOUBLE)" for a, w in zip("zyx", spacing))])
    near = " AND ".join(f"k.g{a} BETWEEN px.h{a} - 2 AND px.h{a} + 2" for a in "zyx")
    for t in range(1, iters + 1):
        dist = f"SELECT px.z, px.y, px.x, k.c, ({colour}) + ({place}) / {spread!r}::DOUBLE AS d FROM px JOIN k{t - 1} k ON {near} WHERE k.alive"
        parts.append(f"e{t} AS MATERIALIZED (SELECT px.z, px.y, px.x, coalesce(b.c, 0) AS c FROM px LEFT JOIN (SELECT z, y, x, c FROM ({dist}) WHERE d < 1e8 QUALIFY row_number() OVER (PARTITION BY z, y, x ORDER BY d, c) = 1) b USING (z, y, x))")
        window = " AND ".join(f"e.{a} >= trunc(k.c{a}) - {2 * s} AND e.{a} < trunc(k.c{a}) + {2 * s}" for a, s in zip("zyx", p.sp_shape))
        sums = f"SELECT k.c, count(*) AS n, {', '.join(f'sum(px.{f}) AS s_{f}' for f in fs)}, {', '.join(f'sum(e.{a}::DOUBLE) AS s_{a}' for a in 'zyx')} FROM e{t} e JOIN px USING (z, y, x) JOIN k{t - 1} k ON k.c = e.c WHERE {window} GROUP BY k.c"
        means = [f"CASE WHEN n IS NULL THEN {'1e8::DOUBLE' if i == 0 else f'm{i}'} ELSE s_f{i} / n END AS m{i}" for i in range(n)] + [f"CASE WHEN n IS NULL THEN c{a} ELSE s_{a} / n END AS c{a}" for a in "zyx"]
        parts.append(f"k{t} AS MATERIALIZED (SELECT k.c, gz, gy, gx, {', '.join(means)}, n IS NOT NULL AND s_f0 / n <> 1e8 AS alive FROM k{t - 1} k LEFT JOIN ({sums}) s ON s.c = k.c)")
    return f"WITH RECURSIVE {', '.join(parts)} {last}"


def _labels_sql(name: str, iters: int, **kw) -> str:
    at = "y, x" if ASKED[name][0] == 3 else "z, y, x"
    return _slic_sql(name, f"SELECT {at}, c + 1 AS label FROM e{iters}", iters, **kw)


def _connected_sql(name: str, iters: int = 5, **kw) -> str:
    """Labels after connectivity, one component at a time in raster order. A component's first pixel has no pixel of its label before it on any axis. States no splitting, as no component here is that large."""
    p = STATED[name]
    (_, ny, nx), at = p.shape, "y, x" if ASKED[name][0] == 3 else "z, y, x"
    index = f"(z * {ny} + y) * {nx} + x"
    steps = [f"SELECT a.p, b.p AS q, a.c AS pc, b.c AS qc FROM cell a JOIN cell b ON a.z + {d[0]} = b.z AND a.y + {d[1]} = b.y AND a.x + {d[2]} = b.x" for d in ((0, 0, 1), (0, 1, 0), (1, 0, 0))]
    known = "list_min(list_transform(near, lambda i: nums[i]))"
    value = f"CASE WHEN nums[k] IS NOT NULL THEN nums[k] WHEN size >= {p.least} THEN fresh WHEN {known} IS NOT NULL THEN {known} WHEN step >= many AND len(list_filter(nums, lambda v: v IS NOT NULL)) = 0 THEN fresh END"
    body = _slic_sql(name, "", iters, **kw).rstrip()
    return f"""{body},
cell AS MATERIALIZED (SELECT z, y, x, {index} AS p, c FROM e{iters}),
face AS MATERIALIZED ({' UNION ALL '.join(steps)}),
tie AS MATERIALIZED (SELECT p, q FROM face WHERE pc = qc UNION ALL SELECT q, p FROM face WHERE pc = qc),
reach(s, p) AS (SELECT p, p FROM cell WHERE p NOT IN (SELECT q FROM face WHERE pc = qc) UNION SELECT r.s, t.q FROM reach r JOIN tie t ON r.p = t.p),
comp AS MATERIALIZED (SELECT p, min(s) AS comp FROM reach GROUP BY p),
part AS MATERIALIZED (SELECT comp, row_number() OVER (ORDER BY comp) AS k, count(*) AS size FROM comp GROUP BY comp),
beside AS (SELECT a.comp AS m, b.comp AS n FROM face JOIN comp a ON a.p = face.p JOIN comp b ON b.p = face.q WHERE a.comp <> b.comp),
around AS (SELECT pm.k, list(DISTINCT pn.k) AS near FROM (SELECT m, n FROM beside UNION SELECT n, m FROM beside) JOIN part pm ON pm.comp = m JOIN part pn ON pn.comp = n GROUP BY pm.k),
graph AS MATERIALIZED (SELECT part.k, size, coalesce(near, []) AS near, (SELECT count(*) FROM part) AS many FROM part LEFT JOIN around USING (k)),
walk(step, nums, fresh) AS (
    SELECT 0::BIGINT, list_transform(range((SELECT count(*) FROM part)), lambda i: NULL::BIGINT), 0::BIGINT
    UNION ALL
    SELECT step + 1, list_transform(nums, lambda v, i: CASE WHEN i = k THEN value ELSE v END), fresh + (value IS NOT NULL AND value = fresh)::BIGINT
    FROM (SELECT *, {value} AS value FROM walk JOIN graph ON k = step % many + 1 WHERE step < many OR len(list_filter(nums, lambda v: v IS NULL)) > 0)),
done AS MATERIALIZED (SELECT nums FROM walk ORDER BY step DESC LIMIT 1),
merged AS MATERIALIZED (SELECT cell.*, (SELECT nums FROM done)[part.k] AS m FROM cell JOIN comp USING (p) JOIN part USING (comp))
SELECT {at}, dense_rank() OVER (ORDER BY first) - 1 AS label FROM (SELECT *, min(p) OVER (PARTITION BY m) AS first FROM merged)"""


def _image_sql(name: str) -> str:
    n = STATED[name].channels
    return f"SELECT z, y, x, concat_ws(',', {', '.join(f'f{i}::BIGINT' for i in range(n))}) AS features FROM ({_pixels(name)})"


def _components_sql() -> str:
    face = "abs(a.y - b.y) + abs(a.x - b.x) = 1"
    reach = f"ties AS MATERIALIZED (SELECT a.y * 24 + a.x AS p, b.y * 24 + b.x AS q FROM e2 a JOIN e2 b ON a.c = b.c AND {face}), reach(p, q) AS (SELECT y * 24 + x, y * 24 + x FROM e2 UNION SELECT r.p, t.q FROM reach r JOIN ties t ON r.q = t.p)"
    body = _slic_sql("ev", "", 2).rstrip()
    return f"{body}, {reach} SELECT e.y, e.x, e.c + 1 AS label, m.component FROM e2 e JOIN (SELECT p, min(q) AS component FROM reach GROUP BY p) m ON m.p = e.y * 24 + e.x"


def _lab(key: str, base: str) -> str:
    """SQL of lab_l, lab_a, lab_b of r, g, b, for each key."""
    lin = [f"CASE WHEN {v} > 0.04045 THEN pow(({v} + 0.055) / 1.055, 2.4) ELSE {v} / 12.92 END AS l{v}" for v in "rgb"]
    t = [f"({m[0]!r} * lr + {m[1]!r} * lg + {m[2]!r} * lb) / {w!r} AS t{a}" for m, w, a in zip(TO_XYZ, WHITE, "xyz")]
    f = [f"CASE WHEN t{a} > 0.008856 THEN cbrt(t{a}) ELSE 7.787 * t{a} + 16.0 / 116.0 END AS f{a}" for a in "xyz"]
    steps = f"SELECT {key}, {', '.join(f)} FROM (SELECT {key}, {', '.join(t)} FROM (SELECT {key}, {', '.join(lin)} FROM ({base})))"
    return f"SELECT {key}, 116.0 * fy - 16.0 AS lab_l, 500.0 * (fx - fy) AS lab_a, 200.0 * (fy - fz) AS lab_b FROM ({steps})"


def _lab_sql() -> str:
    key = "l_orderkey, l_linenumber"
    base = f"SELECT {key}, (l_partkey * 7) % 256 / 255.0::DOUBLE AS r, (l_suppkey * 11) % 256 / 255.0::DOUBLE AS g, (CAST(trunc(l_quantity) AS BIGINT) * 5) % 256 / 255.0::DOUBLE AS b FROM lineitem"
    return f"SELECT {key}, round(lab_l, 4) AS lab_l, round(lab_a, 4) AS lab_a, round(lab_b, 4) AS lab_b FROM ({_lab(key, base)})"


TINY = 1.0 / 32768

QUERIES = {
    **{f"image_{n}": image(n) for n in ("ev", "evt", "li3", "emb")},
    "init_centers_li3": init_li3,
    "home_cell_li3": home_li3,
    "candidates_ev": candidates_ev,
    **{f"assign_round1_{n}": assign_round1(n) for n in ("ev", "li3", "emb")},
    "update_round1_ev": update_round1_ev,
    "slic_ev_iter2": segmented("ev", max_iter=2),
    "slic_ev_iter2_arrow": segmented("ev", "arrow", max_iter=2),
    "slic_evt_iter2": segmented("evt", max_iter=2, compactness=4.0),
    "slic_li2_iter3": segmented("li2", max_iter=3, compactness=8.0),
    "slic_li3_iter2_arrow": segmented("li3", "arrow", max_iter=2, compactness=2.0),
    "slic_spacing_li2": segmented("li2", max_iter=2, compactness=8.0, spacing=(1, 3, 2)),
    "slic_fallback_ev": segmented("ev", max_iter=2, compactness=TINY),
    "slic_max_iter0_ev": segmented("ev", max_iter=0),
    "segment_stats_ev": segment_stats_ev,
    "components_ev": components_ev,
    "slic_lab_rgb": segmented("rgb", "arrow", max_iter=2, convert2lab=None, compactness=10.0),
    "slic_channels_li4": segmented("li4", "arrow", max_iter=2, compactness=4.0),
    "slic_connected_rgb": segmented("rgb", "arrow", enforce_connectivity=True, convert2lab=None, compactness=10.0),
    "slic_connected_li4": segmented("li4", "sql", enforce_connectivity=True, compactness=4.0, max_iter=3),
    "slic_connected_ev": segmented("ev", "arrow", enforce_connectivity=True, compactness=8.0),
    "slic_connected_li3": segmented("li3", "arrow", enforce_connectivity=True, compactness=8.0),
    "rgb2lab_parts": lab_parts,
}


def oracle_sql() -> dict[str, str]:
    li3, ev = STATED["li3"], STATED["ev"]
    h = _home(li3)
    near = " AND ".join(f"k.g{a} BETWEEN h{a} - 2 AND h{a} + 2" for a in "zyx")
    first = lambda n: _slic_sql(n, "SELECT z, y, x, c + 1 AS label FROM e1", 1)
    return {
        **{f"image_{n}": _image_sql(n) for n in ("ev", "evt", "li3", "emb")},
        "init_centers_li3": f"SELECT c, gz, gy, gx, cz, cy, cx FROM ({_lattice(li3)})",
        "home_cell_li3": f"SELECT z, y, x, ({h[0]} * {li3.sp_grid[1]} + {h[1]}) * {li3.sp_grid[2]} + {h[2]} AS cell FROM {_grid(*li3.shape)}",
        "candidates_ev": f"SELECT y, x, count(*) AS candidates FROM (SELECT *, {', '.join(f'{e} AS h{a}' for e, a in zip(_home(ev), 'zyx'))} FROM {_grid(*ev.shape)}) JOIN ({_lattice(ev)}) k ON {near} GROUP BY y, x",
        **{f"assign_round1_{n}": first(n) for n in ("ev", "li3", "emb")},
        "update_round1_ev": _slic_sql("ev", "SELECT c, round(m0, 6) AS f0, round(cz, 6) AS cz, round(cy, 6) AS cy, round(cx, 6) AS cx, alive FROM k1", 1),
        "slic_ev_iter2": _labels_sql("ev", 2),
        "slic_ev_iter2_arrow": _labels_sql("ev", 2),
        "slic_evt_iter2": _labels_sql("evt", 2, compactness=4.0),
        "slic_li2_iter3": _labels_sql("li2", 3, compactness=8.0),
        "slic_li3_iter2_arrow": _labels_sql("li3", 2, compactness=2.0),
        "slic_spacing_li2": _labels_sql("li2", 2, compactness=8.0, spacing=(1, 3, 2)),
        "slic_fallback_ev": _labels_sql("ev", 2, compactness=TINY),
        "slic_max_iter0_ev": f"SELECT y, x, 0::BIGINT AS label FROM {_grid(1, 30, 24)}",
        "segment_stats_ev": _slic_sql("ev", "SELECT e.c + 1 AS label, count(*) AS pixels, round(avg(px.f0), 6) AS mean_count FROM e2 e JOIN px USING (z, y, x) GROUP BY 1", 2),
        "components_ev": _components_sql(),
        "slic_lab_rgb": _labels_sql("rgb", 2, compactness=10.0),
        "slic_channels_li4": _labels_sql("li4", 2, compactness=4.0),
        "slic_connected_rgb": _connected_sql("rgb", compactness=10.0),
        "slic_connected_li4": _connected_sql("li4", 3, compactness=4.0),
        "slic_connected_ev": _connected_sql("ev", compactness=8.0),
        "slic_connected_li3": _connected_sql("li3", compactness=8.0),
        "rgb2lab_parts": _lab_sql(),
    }
