"""Centers: the lattice they start on, and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.geometry import SlicPlan

#: What the first feature of a center without pixels is set to; also the bound of accepted distances.
LIMIT = 1.0e8


def init_centers(images: DataFrame, plan: SlicPlan) -> DataFrame:
    """image_id, c, gz, gy, gx, f, cz, cy, cx, alive: the lattice for every image (a column image_id), features zero.

    A position is the middle of its cell and may lie outside the image.
    """
    (_, gy, gx), s = plan.sp_grid, plan.sp_shape
    cells = images.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(plan.n_centers - 1).cast("long"))).alias("c"))
    placed = cells.select("image_id", "c", F.expr(f"cast(c div {gy * gx} as int)").alias("gz"), F.expr(f"cast((c div {gx}) % {gy} as int)").alias("gy"), F.expr(f"cast(c % {gx} as int)").alias("gx"))
    middle = lambda a, n: (F.col(a) * n + n // 2).cast("double")
    return placed.select("*", F.array_repeat(F.lit(0.0), plan.channels).alias("f"), middle("gz", s[0]).alias("cz"), middle("gy", s[1]).alias("cy"), middle("gx", s[2]).alias("cx"), F.lit(True).alias("alive"))


def in_window(plan: SlicPlan) -> Column:
    """Whether a pixel counts for the mean of its center, which was at pz, py, px."""
    ok = F.lit(True)
    for a, s in zip("zyx", plan.sp_shape):
        t = F.col(f"p{a}").cast("int")  # toward zero
        ok &= (F.col(a) >= t - 2 * s) & (F.col(a) < t + 2 * s)
    return ok


def partial_sums(assigned: DataFrame, plan: SlicPlan) -> DataFrame:
    """image_id, c, n, sums of features and positions over the pixels in each center's window. Partial sums are shuffled, pixels aren't."""
    kept = assigned.where(in_window(plan))
    if plan.channels <= 64:
        return kept.groupBy("image_id", "c").agg(
            F.count("*").alias("n"), F.array(*(F.sum(F.col("features")[i]) for i in range(plan.channels))).alias("f_sum"), *(F.sum(F.col(a).cast("double")).alias(f"{a}_sum") for a in "zyx")
        )
    place = kept.groupBy("image_id", "c").agg(F.count("*").alias("n"), *(F.sum(F.col(a).cast("double")).alias(f"{a}_sum") for a in "zyx"))
    each = kept.select("image_id", "c", F.posexplode("features").alias("i", "v")).groupBy("image_id", "c", "i").agg(F.sum("v").alias("v"))
    wide = each.groupBy("image_id", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("f_sum"))
    return place.join(wide, ["image_id", "c"])


def update(centers: DataFrame, sums: DataFrame) -> DataFrame:
    """Means where a center has pixels; elsewhere it dies: its first feature becomes LIMIT, the rest stays."""
    met = centers.join(sums, ["image_id", "c"], "left")
    has = F.col("n").isNotNull()
    dead = F.transform("f", lambda v, i: F.when(i == 0, F.lit(LIMIT)).otherwise(v))
    f = F.when(has, F.transform("f_sum", lambda v: v / F.col("n"))).otherwise(dead)
    mean = lambda a: F.when(has, F.col(f"{a}_sum") / F.col("n")).otherwise(F.col(f"c{a}")).alias(f"c{a}")
    return met.select("image_id", "c", "gz", "gy", "gx", f.alias("f"), mean("z"), mean("y"), mean("x"), has.alias("alive")).withColumn("alive", F.col("alive") & (F.col("f")[0] != LIMIT))
