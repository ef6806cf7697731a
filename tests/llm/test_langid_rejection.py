"""A language that the models never saw is rejected."""

import pytest
from pyspark.sql import functions as F

from tessella.llm import langid


@pytest.mark.parametrize("unseen", ["en", "de", "es", "fr"])
def test_a_language_left_out_of_training_is_rejected(spark, unseen):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) >= 500").select("doc_id", "text", "lang")
    out = langid.identify(rows, rows.where(F.col("lang") != unseen)).join(rows.select("doc_id", "lang"), "doc_id").collect()
    left_out, known = ([r.rejected for r in out if (r.lang == unseen) == side] for side in (True, False))
    assert len(left_out) > 10 and sum(left_out) > 0.8 * len(left_out)
    assert sum(known) < 0.01 * len(known)
