"""Cutting lineage in iterations."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints into the folder that the cluster names in spark.checkpoint.dir; where none is named, into one of our own if Spark runs in this process alone."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessella-"))
    kept = df.checkpoint(eager=True)
    # A checkpoint keeps its plan's estimated size and constraints. Over rounds of joins the estimate is multiplied into a number
    # of millions of digits, so the rows go on as a table of which nothing is assumed.
    spark = df.sparkSession
    rows = kept._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)
