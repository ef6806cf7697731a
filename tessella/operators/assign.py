"""Each pixel's nearest center among those up to two lattice cells away: as a join, and in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.geometry import SlicPlan
from .centers import LIMIT

RADIUS = 2
#: Centers of more than this go by join, not by broadcast.
BROADCAST_BYTES = 64 << 20
#: Pixels in a block that is assigned at a time, and its bytes.
BLOCK_PIXELS, BLOCK_BYTES = 1 << 16, 8 << 20


def home_cell(plan: SlicPlan) -> Column:
    """Linear index of a pixel's lattice cell; of the nearest one, if the pixel lies outside."""
    g = [F.greatest(F.least(F.expr(f"{a} div {s}"), F.lit(n - 1)), F.lit(0)) for a, s, n in zip("zyx", plan.sp_shape, plan.sp_grid)]
    return ((g[0] * plan.sp_grid[1] + g[1]) * plan.sp_grid[2] + g[2]).cast("long")


def with_home(pixels: DataFrame, plan: SlicPlan) -> DataFrame:
    """Features in double, scaled by compactness, and the home cell; both stay over all rounds."""
    scaled = F.transform("features", lambda v: v.cast("float").cast("double") * F.lit(plan.scale))
    return pixels.select("image_id", "z", "y", "x", scaled.alias("features"), home_cell(plan).alias("cell"))


def candidates(centers: DataFrame, plan: SlicPlan) -> DataFrame:
    """image_id, cell, cands: live centers up to two cells away on every axis (125 at most), and center 0's position."""
    span = lambda a, n: F.explode(F.sequence(F.greatest(F.col(a) - RADIUS, F.lit(0)), F.least(F.col(a) + RADIUS, F.lit(n - 1))))
    near = centers.select("*").withColumn("hz", span("gz", plan.sp_grid[0])).withColumn("hy", span("gy", plan.sp_grid[1])).withColumn("hx", span("gx", plan.sp_grid[2]))
    cell = ((F.col("hz") * plan.sp_grid[1] + F.col("hy")) * plan.sp_grid[2] + F.col("hx")).cast("long")
    listed = near.groupBy("image_id", cell.alias("cell")).agg(F.collect_list(F.when(F.col("alive"), F.struct("c", "f", "cz", "cy", "cx"))).alias("cands"))
    zero = centers.where("c = 0").select("image_id", F.struct("c", "cz", "cy", "cx").alias("zero"))
    return listed.join(zero, "image_id")


def distance(center: Column, plan: SlicPlan) -> Column:
    colour = F.aggregate(F.zip_with("features", center["f"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    place = F.lit(0.0)
    for a, w in zip("zyx", plan.spacing):
        d = (F.col(a) - center[f"c{a}"]) * w
        place = place + d * d
    return colour + place / plan.spread


def assign(home: DataFrame, centers: DataFrame, plan: SlicPlan, images: int | None = None) -> DataFrame:
    """home's rows with c, and its center's position pz, py, px.

    The least distance under LIMIT wins, at a tie the lowest c; a pixel without any takes center 0.
    Cells are joined by key; a cell's list is bounded by 125 centers. `images`: how many there are, if known; where their lists fit
    the bound together they are broadcast, so that a cell of very many pixels isn't one task's work.
    """
    near = candidates(centers, plan)
    if images and images * plan.n_centers * min(plan.n_centers, (2 * RADIUS + 1) ** 3) * 8 * (plan.channels + 4) <= BROADCAST_BYTES:
        near = F.broadcast(near)
    met = home.join(near, ["image_id", "cell"])
    dist = F.transform("cands", lambda k: F.struct(distance(k, plan).alias("d"), k["c"].alias("c"), k["cz"].alias("cz"), k["cy"].alias("cy"), k["cx"].alias("cx")))
    best = F.array_min(F.filter(dist, lambda s: s["d"] < LIMIT))
    won = met.select("image_id", "z", "y", "x", "features", "cell", best.alias("best"), "zero")
    pick = lambda k: F.coalesce(F.col(f"best.{k}"), F.col(f"zero.{k}"))
    return won.select("image_id", "z", "y", "x", "features", "cell", pick("c").alias("c"), pick("cz").alias("pz"), pick("cy").alias("py"), pick("cx").alias("px"))


def most_images(plan: SlicPlan) -> int:
    """Of how many images the centers fit the bound together."""
    return BROADCAST_BYTES // (plan.n_centers * 8 * (plan.channels + 4))


class Centers:
    """All images' centers as arrays, of bounded size, for the driver and the workers. They start as init_centers() has them."""

    def __init__(self, images: list[int], plan: SlicPlan):
        n, size = plan.n_centers, np.array(plan.sp_shape)
        lattice = (np.stack(np.unravel_index(np.arange(n), plan.sp_grid), 1) * size + size // 2).astype(np.float64)
        self.plan, self.by_image = plan, {i: (np.zeros((n, plan.channels)), lattice.copy(), np.ones(n, bool)) for i in images}

    def updated(self, sums: list) -> Centers:
        """What update() makes of them by rows of sums_arrow()."""
        new = Centers([], self.plan)
        for i, (f, pos, _) in self.by_image.items():
            f = f.copy()
            f[:, 0] = LIMIT
            new.by_image[i] = (f, pos.copy(), np.zeros(self.plan.n_centers, bool))
        for r in sums:
            f, pos, alive = new.by_image[r.image_id]
            f[r.c] = np.array(r.f_sum) / r.n
            pos[r.c] = np.array((r.z_sum, r.y_sum, r.x_sum)) / r.n
            alive[r.c] = f[r.c, 0] != LIMIT
        return new

    def nearest(self, image: int, at: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Each pixel's center. Pixels go by home cell; a candidate that is further from the box around a cell's pixels (in place and
        features) than the home center is from any of them can't win, so whole cells skip it. The rest are compared pixel by pixel."""
        f, pos, alive = self.by_image[image]
        plan, n = self.plan, len(at)
        grid, w = np.array(plan.sp_grid), np.array(plan.spacing, np.float64)
        cell = np.minimum(at // np.array(plan.sp_shape), grid - 1)
        home = (cell[:, 0] * grid[1] + cell[:, 1]) * grid[2] + cell[:, 2]

        def distances(at, features, f, pos):
            colour = np.zeros(len(at))
            for i in range(plan.channels):
                colour += (features[:, i] - f[:, i]) ** 2
            step = ((at - pos) * w) ** 2
            return colour + (step[:, 0] + step[:, 1] + step[:, 2]) / plan.spread

        order = np.argsort(home, kind="stable")
        starts = np.flatnonzero(np.diff(home[order], prepend=-1))
        counts = np.diff(np.append(starts, n))
        sorted_at, sorted_f, own = at[order], features[order], home[order]
        bound = np.where(alive[own], np.minimum(distances(sorted_at, sorted_f, f[own], pos[own]), LIMIT), LIMIT)
        bound = np.maximum.reduceat(np.nan_to_num(bound, nan=LIMIT), starts) * (1 + 1e-9)
        reach = [np.arange(-min(RADIUS, g - 1), min(RADIUS, g - 1) + 1) for g in plan.sp_grid]
        offsets = np.stack(np.meshgrid(*reach, indexing="ij"), -1).reshape(-1, 3)
        k = cell[order[starts]][:, None, :] + offsets
        inside = ((k >= 0) & (k < grid)).all(2)
        c = np.where(inside, (k[:, :, 0] * grid[1] + k[:, :, 1]) * grid[2] + k[:, :, 2], 0)

        def gap(values, centers):
            low, high = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
            return np.maximum(np.maximum(low[:, None] - centers, centers - high[:, None]), 0)

        least = sum((gap(sorted_at[:, a], pos[c, a]) * w[a]) ** 2 for a in range(3)) / plan.spread
        for i in range(plan.channels):
            least += gap(sorted_f[:, i], f[c, i]) ** 2
        keep = inside & alive[c] & ~(least > bound[:, None])
        # Cells with most candidates first: those with a j-th candidate, and their pixels, are then a prefix.
        many = keep.sum(1)
        by = np.argsort(-many, kind="stable")
        c = np.take_along_axis(c, np.argsort(~keep, axis=1, kind="stable"), 1)[by]  # those kept, ascending
        many, counts, starts = many[by], counts[by], starts[by]
        ends = np.cumsum(counts)
        place = np.repeat(starts - (ends - counts), counts) + np.arange(n)
        sorted_at, sorted_f, order = sorted_at[place], sorted_f[place], order[place]
        best, label = np.full(n, LIMIT), np.zeros(n, np.int64)
        for j in range(int(many.max(initial=0))):
            cells = int(np.searchsorted(-many, -j, "left"))  # those of more than j candidates
            m = int(ends[cells - 1])
            one = np.repeat(c[:cells, j], counts[:cells])
            d = distances(sorted_at[:m], sorted_f[:m], f[one], pos[one])
            less = d < best[:m]
            np.copyto(best[:m], d, where=less)
            np.copyto(label[:m], one, where=less)
        out = np.empty(n, np.int64)
        out[order] = label
        return out


BLOCKS = "image_id long, at binary, features binary"


def blocks(home: DataFrame, plan: SlicPlan) -> DataFrame:
    """Pixels in blocks of one image, BLOCK_PIXELS or BLOCK_BYTES at most: places (32-bit z, y, x) and features as they lie in memory.

    Rounds go over these few rows without turning pixels into Arrow columns each time.
    """
    most = max(1, min(BLOCK_PIXELS, BLOCK_BYTES // (8 * plan.channels + 12)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            image, at, features = (np.concatenate(x) for x in zip(*parts))
            for i in np.unique(image):
                own = np.flatnonzero(image == i)
                for low in range(0, len(own), most):
                    k = own[low : low + most]
                    yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int64()), pa.array([at[k].tobytes()], pa.binary()), pa.array([features[k].tobytes()], pa.binary())], names=["image_id", "at", "features"])

        for b in batches:
            parts.append((b.column(0).to_numpy(), np.stack([b.column(i).to_numpy() for i in (1, 2, 3)], 1), b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)))
            rows += b.num_rows
            if rows >= most:
                yield from out()
                parts, rows = [], 0
        if rows:
            yield from out()

    return home.select("image_id", *(F.col(a).cast("int") for a in "zyx"), "features").mapInArrow(run, BLOCKS)


def _batches(batches: Iterator[pa.RecordBatch], centers: Centers):
    for b in batches:
        for image, raw, values in zip(*(b.column(i).to_pylist() for i in range(3))):
            at = np.frombuffer(raw, np.int32).reshape(-1, 3).astype(np.int64)
            features = np.frombuffer(values, np.float64).reshape(len(at), -1)
            yield image, at, features, centers.nearest(image, at, features)


def assign_arrow(packed: DataFrame, centers: Centers) -> DataFrame:
    """image_id, z, y, x, c of every pixel of blocks(), the centers broadcast."""
    shared = packed.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, at, _, c in _batches(batches, shared.value):
            at = at.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), i, np.int64)), *(pa.array(np.ascontiguousarray(at[:, k])) for k in range(3)), pa.array(c)], names=["image_id", "z", "y", "x", "c"])

    return packed.mapInArrow(run, "image_id long, z int, y int, x int, c long")


def sums_arrow(packed: DataFrame, centers: Centers) -> DataFrame:
    """partial_sums() straight from blocks(): they give one row a center, and only these are shuffled."""
    shared, plan = packed.sparkSession.sparkContext.broadcast(centers), centers.plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value
        for i, at, features, c in _batches(batches, centers):
            low = np.trunc(centers.by_image[i][1][c])
            reach = 2 * np.array(plan.sp_shape)
            ok = ((at >= low - reach) & (at < low + reach)).all(1)
            name, back = np.unique(c[ok], return_inverse=True)
            values = np.concatenate([features[ok], at[ok]], 1)
            sums = np.stack([np.bincount(back, values[:, k], len(name)) for k in range(values.shape[1])], 1) if len(name) else np.zeros((0, values.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(name), i, np.int64)), pa.array(name), pa.array(np.bincount(back, minlength=len(name)).astype(np.int64)), pa.array(list(sums), pa.list_(pa.float64()))], names=["image_id", "c", "n", "sums"]
            )

    parts = packed.mapInArrow(run, "image_id long, c long, n long, sums array<double>")
    n = plan.channels
    total = parts.groupBy("image_id", "c").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(n))).alias("f_sum"), *(F.sum(F.col("sums")[n + k]).alias(f"{a}_sum") for k, a in enumerate("zyx")))
    return total
