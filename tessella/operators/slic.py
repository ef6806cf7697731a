"""SLIC segmentation of images in a pixel table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import rgb2lab
from ..plans.geometry import SlicPlan, plan
from ..sources.images import infer_shape
from .assign import Centers, assign, assign_arrow, blocks, most_images, sums_arrow, with_home
from .centers import init_centers, partial_sums, update
from .connectivity import enforce
from .lineage import cut


def prepared(pixels: DataFrame, p: SlicPlan) -> DataFrame:
    """Pixels with scaled features (in Lab if the plan says so) and home cells."""
    if p.to_lab:
        v = [F.col("features")[i].cast("double") for i in range(3)]
        pixels = pixels.withColumn("features", F.array(*rgb2lab(*v)).cast("array<float>"))
    return with_home(pixels, p)


def rounds(home: DataFrame, p: SlicPlan, backend: str = "sql") -> DataFrame:
    """image_id, z, y, x, label from 1, after max_iter assignments; the means after the last one aren't needed.

    `arrow` keeps the centers with the driver, if they fit a fixed bound, broadcasts them and shuffles only sums by center; `sql` joins
    each cell's candidates by key, has no such bound, and cuts the centers from their lineage each round.
    """
    if p.max_iter == 0:
        return home.select("image_id", "z", "y", "x", F.lit(0).cast("long").alias("label"))
    most, images = most_images(p), []
    if backend == "arrow" and most:
        packed = cut(blocks(home, p))
        images = [r.image_id for r in packed.select("image_id").distinct().limit(most + 1).collect()]
    if 0 < len(images) <= most:
        near = Centers(images, p)
        for _ in range(p.max_iter - 1):
            near = near.updated(sums_arrow(packed, near).collect())
        last = assign_arrow(packed, near)
    else:
        home = cut(home) if p.max_iter > 1 else home
        centers = cut(init_centers(home, p))
        for _ in range(p.max_iter - 1):
            centers = cut(update(centers, partial_sums(assign(home, centers, p), p)))
        last = assign(home, centers, p)
    return last.select("image_id", "z", "y", "x", (F.col("c") + 1).cast("long").alias("label"))


def slic(
    pixels: DataFrame, n_segments: float = 100, compactness: float = 1.0, spacing=(1, 1, 1), max_iter: int = 5, multichannel: bool = True, convert2lab: bool | None = None,
    enforce_connectivity: bool = True, min_size_factor: float = 0.4, max_size_factor: float = 10.0, *, ndim: int | None = None, backend: str = "arrow", shape: tuple[int, int, int, int] | None = None,
) -> DataFrame:
    """image_id, (z,) y, x, label of every pixel of a pixel table (image_id, z, y, x, features).

    All images of the table have one shape, dense. Labels count from 1 without connectivity, from 0 with it. `ndim`: of
    the array that the table stands for; by default 2-D where there is one z and `multichannel` or one channel, else
    3-D, with channels as a further axis where there are several. z is left out for 2-D images.
    `shape` (Z, Y, X, C) saves the pass that infers it and checks the pixels. `backend`: `arrow` or `sql`.
    """
    if backend not in ("arrow", "sql"):
        raise ValueError("backend is arrow or sql")
    z, y, x, c = shape or infer_shape(pixels)
    flat = z == 1 and (multichannel or c == 1) if ndim is None else ndim == 2 or ndim == 3 and multichannel
    dims = ((y, x, c) if multichannel else (y, x)) if flat else ((z, y, x, c) if multichannel or c > 1 else (z, y, x))
    p = plan(dims, n_segments, compactness, spacing, max_iter, multichannel, convert2lab, enforce_connectivity, min_size_factor, max_size_factor)
    home = prepared(pixels, p)
    labels = rounds(home, p, backend)
    if p.connect:
        labels = enforce(labels, p)
    return labels.drop("z") if p.is_2d else labels
