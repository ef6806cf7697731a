"""Timing of segmentations: sweeps over sides, two ways side by side, jobs and stages of a run."""

from __future__ import annotations

import contextlib
import io
import statistics
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators.slic import slic
from .sources.images import blobs

#: side, segments, run, bytes (4 a voxel), seconds, gb_s.
RUNS = "way string, side int, segments long, run int, bytes long, seconds double, gb_s double"


def timed(build: Callable[[], DataFrame]) -> float:
    """Seconds that a query takes to be built and to run to its last row."""
    began = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def cube(spark: SparkSession, side: int, grain: int, **kw) -> DataFrame:
    """The segmentation of a cube of blobs, a segment for every grain^3 voxels."""
    return slic(blobs(spark, side), n_segments=side**3 / grain**3, multichannel=False, shape=(side, side, side, 1), **kw)


def sweep(spark: SparkSession, sides=range(50, 350, 50), runs: int = 5, grain: int = 5, ways: dict[str, dict] | None = None, compactness: float = 0.2) -> DataFrame:
    """One row (RUNS) for each run of each way at each side; a way is a name for arguments of slic. No sides or no runs give no rows."""
    rows = []
    for side in sides:
        for run in range(runs):
            for way, kw in (ways or {"arrow": {"backend": "arrow"}}).items():
                s = timed(lambda: cube(spark, side, grain, compactness=compactness, **kw))  # noqa: B023
                rows.append((way, side, side**3 // grain**3, run, 4 * side**3, s, 4 * side**3 / 1e9 / s))
    return spark.createDataFrame(rows, RUNS)


def compare(spark: SparkSession, one: dict, other: dict, side: int = 100, rounds: int = 3, runs: int = 5, grain: int = 10) -> dict[str, float]:
    """Median over rounds of the mean seconds of two ways, and their ratio."""
    means = {"one": [], "other": []}
    for _ in range(rounds):
        for way, kw in (("one", one), ("other", other)):
            means[way].append(statistics.mean(timed(lambda: cube(spark, side, grain, **kw)) for _ in range(runs)))  # noqa: B023
    a, b = (statistics.median(v) for v in means.values())
    return {"one": a, "other": b, "ratio": a / b}


def profiled(spark: SparkSession, build: Callable[[], DataFrame]) -> dict:
    """seconds, plan (formatted, after the run) and stages (job, stage, name, tasks, failed) of a query, those that ran while it was built included."""
    sc, group = spark.sparkContext, f"profile-{uuid.uuid4().hex}"
    sc.setJobGroup(group, "profiled run")
    try:
        began = time.perf_counter()
        df = build()
        df.write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - began
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            df.explain("formatted")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    tracker, stages = sc.statusTracker(), []
    for job in sorted(tracker.getJobIdsForGroup(group)):
        for stage in sorted(tracker.getJobInfo(job).stageIds):
            if info := tracker.getStageInfo(stage):
                stages.append({"job": job, "stage": stage, "name": info.name, "tasks": info.numTasks, "failed": info.numFailedTasks})
    return {"seconds": seconds, "plan": plan.getvalue(), "stages": stages}


def write_csv(runs: DataFrame, path: str) -> None:
    """A small table of runs as one CSV file with a header, in a new folder or in place of an old one."""
    runs.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
