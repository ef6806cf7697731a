"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, dac, decontam, langid, pseudolm, sharding, sp_codec, spotsigs, tokencount, toxcnn
from .common import crc_fold, prepare, table, tokenizer_path


def op1_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    of = sp_codec.digests(tokenizer_path("piece_bpe_32k.model"))
    return table(spark, sf_dir, "documents").select("doc_id", of("text").alias("r")).select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")


def op2_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    fold = crc_fold(F.col("doc_id"), 4)
    model = langid.fit(docs.where((fold != 2) & F.col("lang").isNotNull()))
    predicted = docs.select("doc_id", (fold == 2).alias("held_out"), langid.predict(F.col("text"), model, spark).alias("p"))
    return predicted.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def op3_bagminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def op4_byte_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_dac_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return dac.written_and_read(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited(table(spark, sf_dir, "documents"))


def op7_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pseudolm.scores(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontam.report(decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    fold = crc_fold(F.col("doc_id"), 5)
    model = toxcnn.learn(docs, table(spark, sf_dir, "labels").where(fold != 0))
    scored = docs.select("doc_id", (fold == 0).alias("held_out"), toxcnn.score(F.col("text"), model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece_codec, op2_kneser_ney_language, op3_bagminhash_near_dedup, op4_byte_balanced_shards, op5_dac_token_files, op6_spotsigs_fingerprints, op7_masked_pseudo_likelihood, op8_token_counts, op9_benchmark_decontamination, op10_toxicity_cnn)}

# --- DuckDB ------------------------------------------------------------------

_BYTES = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)"
_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_SHARDS_SQL = f"""
WITH crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
sized AS MATERIALIZED (
    SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size,
        xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, b: xor(c >> 8, t[xor(c % 256, b) + 1])), 4294967295) AS text_crc32
    FROM documents, crc),
run AS (SELECT *, sum(size) OVER o - size AS ahead, sum(size) OVER () AS every FROM sized WINDOW o AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)),
placed AS (SELECT *, least(7, ((2 * ahead + size) * 8) // (2 * every))::INTEGER AS shard FROM run)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, NULL::INTEGER AS grown_shard FROM placed
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_WINDOW = "array_to_string(list_slice(w, i, i + n - 1), ' ')"
_DECONTAMINATION_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
spans AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
item_windows AS MATERIALIZED (SELECT DISTINCT item, n, {_WINDOW} AS s FROM spans),
sizes AS (SELECT DISTINCT n FROM item_windows),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
found AS MATERIALIZED (SELECT r, i, p.n, item FROM (SELECT r, i, n, {_WINDOW} AS s FROM places) p JOIN item_windows USING (n, s)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op4_byte_balanced_shards": _SHARDS_SQL, "op9_benchmark_decontamination": _DECONTAMINATION_SQL}
