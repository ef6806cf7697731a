"""A corpus pipeline over `documents`: language, toxicity, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
`documents` and drop the rows they reject.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bagminhash, decontam, langid, sp_codec, toxcnn
from tessella.llm.common import delete, prepare, scratch_dir, table, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that the language models accept; where no row has a language, texts with a letter."""
    prepare(spark)
    model = langid.fit(docs.where(F.col("lang").isNotNull()))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.where(~langid.predict(F.col("text"), model, spark)["rejected"])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that score below 0.5."""
    prepare(spark)
    model = toxcnn.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxcnn.score(F.col("text"), model, spark) < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each class of near copies."""
    prepare(spark)
    return bagminhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts without a passage of a benchmark item."""
    prepare(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids, ids_sha256, decoded_sha256 of every text."""
    prepare(spark)
    of = sp_codec.digests(tokenizer_path("piece_bpe_32k.model"), with_ids=True)
    coded = docs.select("doc_id", "lang", "source", "n_chars", of(F.col("text")).alias("r"))
    return coded.select("doc_id", "lang", "source", "n_chars", "r.n_tokens", "r.ids", "r.ids_sha256", "r.decoded_sha256")


STAGES = [
    ("language_id", language),
    ("toxicity", toxicity),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: No SQL for models trained here; the test checks token ids, benchmark windows and that kept texts differ, not which rows each stage keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage keeps is written to the shared folder and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch_dir(spark)}/tessella-pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)  # only the last stage's table is still read, by the result
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
