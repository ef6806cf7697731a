"""Images as pixel tables: image_id, z, y, x, features array<float>; one row a pixel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.geometry import canonical

PIXELS = "image_id long, z int, y int, x int, features array<float>"


def from_array(spark: SparkSession, image: np.ndarray, multichannel: bool = True, image_id: int = 0) -> DataFrame:
    """A pixel table of an array that the driver has; larger images come as tables from the start."""
    image = np.asarray(image)
    (z, y, x, c), _ = canonical(image.shape, multichannel)
    at = np.indices((z, y, x)).reshape(3, -1)
    cells = pa.FixedSizeListArray.from_arrays(pa.array(image.reshape(-1).astype(np.float32)), c).cast(pa.list_(pa.float32()))
    rows = pa.table({"image_id": pa.array(np.full(z * y * x, image_id, np.int64)), **{a: pa.array(v.astype(np.int32)) for a, v in zip("zyx", at)}, "features": cells})
    return spark.createDataFrame(rows, PIXELS)


def to_array(labels: DataFrame, shape: tuple[int, int, int], is_2d: bool) -> np.ndarray:
    """Labels of one image as an array on the driver."""
    rows = labels.toPandas()
    out = np.zeros(shape, np.int64)
    out[rows["z"] if "z" in rows else 0, rows["y"], rows["x"]] = rows["label"]
    return out[0] if is_2d else out


def infer_shape(pixels: DataFrame) -> tuple[int, int, int, int]:
    """(Z, Y, X, C) shared by all images of a pixel table; raises ValueError unless every image is dense, without repeats or nulls."""
    per = pixels.groupBy("image_id").agg(
        *(F.max(a).alias(a) for a in "zyx"), *(F.min(a).alias(f"low_{a}") for a in "zyx"), F.count("*").alias("n"), F.max(F.size("features")).alias("c"), F.min(F.size("features")).alias("least_c"),
        F.sum((F.col("features").isNull() | F.col("z").isNull() | F.col("y").isNull() | F.col("x").isNull() | F.exists("features", lambda v: v.isNull())).cast("int")).alias("nulls"),
    )
    s = per.agg(*(F.max(c).alias(c) for c in ("z", "y", "x", "c", "nulls")), *(F.min(c).alias(f"min_{c}") for c in ("z", "y", "x", "n", "least_c", "low_z", "low_y", "low_x")), F.max("n").alias("n")).first()
    if s.n is None:
        raise ValueError("no pixels")
    box = (s.z + 1, s.y + 1, s.x + 1) if not s.nulls else (0, 0, 0)
    repeats = pixels.groupBy("image_id", "z", "y", "x").agg(F.count("*").alias("k")).where("k > 1")
    if s.nulls or (s.min_z, s.min_y, s.min_x) != (s.z, s.y, s.x) or min(s.min_low_z, s.min_low_y, s.min_low_x) < 0 or not s.n == s.min_n == box[0] * box[1] * box[2] or s.c != s.min_least_c or not repeats.isEmpty():
        raise ValueError("images must be dense boxes of one shape, each pixel once, without nulls")
    return (*box, s.c)


def grid(spark: SparkSession, z: int, y: int, x: int) -> DataFrame:
    """All pixels of a box, from one range."""
    p = F.col("id")
    return spark.range(z * y * x).select(F.lit(0).cast("long").alias("image_id"), (p / (y * x)).cast("int").alias("z"), F.expr(f"cast((id div {x}) % {y} as int)").alias("y"), (p % x).cast("int").alias("x"))


def _filled(spark: SparkSession, counts: DataFrame, shape: tuple[int, int, int], values: list[str]) -> DataFrame:
    """Counted cells on the full grid, zero where none was counted. The cells are fewer than the grid's pixels."""
    full = grid(spark, *shape).join(counts, ["z", "y", "x"], "left")
    return full.select("image_id", "z", "y", "x", F.array(*(F.coalesce(F.col(v), F.lit(0)).cast("float") for v in values)).alias("features"))


# Fixed order of the channels.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


Box = tuple[int, int, int, int]


def events_image(spark: SparkSession, sf_dir: str, by_type: bool = False) -> tuple[DataFrame, Box]:
    """Days (from the first one on) by hours, events counted; one channel, or one a type. And the image's shape, as far as the data reach."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts is not null")
    ends = e.agg(F.min(F.to_date("ts")).alias("low"), F.max(F.to_date("ts")).alias("high")).first()
    days = (ends.high - ends.low).days + 1
    cells = e.select(F.date_diff(F.to_date("ts"), F.lit(ends.low)).alias("y"), F.hour("ts").alias("x"), "event_type")
    aggs = [F.count_if(F.col("event_type") == t).alias(t) for t in EVENT_TYPES] if by_type else [F.count("*").alias("n")]
    names = EVENT_TYPES if by_type else ["n"]
    return _filled(spark, cells.groupBy(F.lit(0).alias("z"), "y", "x").agg(*aggs), (1, days, 24), names), (1, days, 24, len(names))


def colour_image(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Box]:
    """events_image() with three channels, from 0 to 1: counts of the first three types, each 24 levels of 255."""
    px, (z, y, x, _) = events_image(spark, sf_dir, by_type=True)
    return px.withColumn("features", F.transform(F.slice("features", 1, 3), lambda v: ((v.cast("long") * 24) % 256 / 255.0).cast("float"))), (z, y, x, 3)


def lineitem_image(spark: SparkSession, sf_dir: str, along: str = "quantity") -> tuple[DataFrame, Box]:
    """Items counted, and the image's shape as far as the data reach. `along`: `quantity`, lines by quantities; `month`, also by months
    from the first one on; `year`, also by years, with a second channel that counts items of a discount over 5 %.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("qty"), "l_shipdate", "l_discount")
    li = li.withColumns({"month": F.year("l_shipdate") * 12 + F.month("l_shipdate"), "year": F.year("l_shipdate")}).where("line > 0 and qty > 0 and l_shipdate is not null")
    ends = li.agg(F.max("line").alias("line"), F.max("qty").alias("qty"), *(f(c).alias(f"{n}_{c}") for c in ("month", "year") for n, f in (("low", F.min), ("high", F.max)))).first()
    line, qty, n = F.col("line") - 1, F.col("qty") - 1, F.count("*").alias("n")
    if along == "quantity":
        return _filled(spark, li.groupBy(F.lit(0).alias("z"), line.alias("y"), qty.alias("x")).agg(n), (1, ends.line, ends.qty), ["n"]), (1, ends.line, ends.qty, 1)
    low, high = ends[f"low_{along}"], ends[f"high_{along}"]
    box, names = (ends.line, ends.qty, high - low + 1), ["n", "cheap"] if along == "year" else ["n"]
    counted = li.groupBy(line.alias("z"), qty.alias("y"), (F.col(along) - low).alias("x")).agg(n, F.count_if(F.col("l_discount") > 0.05).alias("cheap"))
    return _filled(spark, counted, box, names), (*box, len(names))


#: The box that the vectors' lattice is laid over, as their SQL has it. There may be fewer or more vectors; the last row needn't be full.
EMBEDDING_BOX: Box = (1, 20, 25, 64)


def embedding_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in rows of 25, each a pixel of 64 channels in thousandths; every row of the table is a pixel, and y is a long, as ids may be large. Of longer vectors the SQL has the first 64 values, too."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(
        F.lit(0).cast("long").alias("image_id"), F.lit(0).alias("z"), F.expr("vec_id div 25").alias("y"), (F.col("vec_id") % 25).cast("int").alias("x"),
        F.transform(F.slice("embedding", 1, EMBEDDING_BOX[3]), lambda v: F.round(v.cast("double") * 1000).cast("float")).alias("features"),
    )


def blobs(spark: SparkSession, side: int, seed: int = 0, grain: int = 8) -> DataFrame:
    """A cube of 0 and 1 in blobs: hashes at the corners of coarse cells, interpolated and cut at their middle."""
    corner = lambda dz, dy, dx: (F.xxhash64(F.expr(f"z div {grain}") + dz, F.expr(f"y div {grain}") + dy, F.expr(f"x div {grain}") + dx, F.lit(seed)) % 1000).cast("double")
    part = lambda a, d: (F.col(a) % grain if d else grain - F.col(a) % grain) / grain
    total = sum((corner(i, j, k) * part("z", i) * part("y", j) * part("x", k) for i in (0, 1) for j in (0, 1) for k in (0, 1)), F.lit(0.0))
    return grid(spark, side, side, side).select("image_id", "z", "y", "x", F.array((total > 0).cast("float")).alias("features"))
