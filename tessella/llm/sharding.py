"""Operator 4: contiguous shards of near-equal bytes, from global prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_prefix


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, bytes of the text plus 1 (null text: 1), unsigned crc32 of its UTF-8 (null: of nothing), and `more`."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), *more)


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Puts documents, in ascending doc_id order, into `shards` contiguous runs of near-equal bytes.

    The prefix sum of sizes is cut at equal targets: a document goes where its middle byte falls, so a
    shard misses its target by no more than one document. Null ids come first; rows of one id are
    ordered by size and checksum, and rows equal in all three are interchangeable. A group of copies of
    any size is cut like other rows, so no shard outgrows its target. More shards than documents leave
    some shards empty; an empty table gives no rows. Columns other than doc_id and text are ignored.
    """
    return _placed(sized(docs), shards)


def _placed(rows: DataFrame, shards: int) -> DataFrame:
    """Rows of sized(), with what else they carry, and their shard and slot."""
    more = rows.columns[3:]
    if shards < 1:
        raise ValueError("shards must be positive")
    order = [F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("text_crc32").asc()]
    placed = global_prefix(rows, order, F.col("size")).select(
        "doc_id", "size", "text_crc32", *more, "row_before",
        F.least(F.lit(shards - 1), F.expr(f"((2 * value_before + size) * {shards}) div (2 * value_all)")).cast("int").alias("shard"),
    )
    first = placed.groupBy("shard").agg(F.min("row_before").alias("first_row"))  # at most `shards` rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", *more, "shard", (F.col("row_before") - F.col("first_row")).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Writes every row, with all its columns, to a folder `shard=k` for each shard, in slot order within each file.

    A column of `docs` named shard or slot is written as own_shard or own_slot.
    """
    taken, names = {c.lower() for c in docs.columns} | {"shard", "slot"}, []
    for c in docs.columns:
        name = c
        while c.lower() in ("shard", "slot") and name.lower() in taken:
            name = f"own_{name}"
        taken.add(name.lower())
        names.append(name)
    whole = F.struct(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names))).alias("whole")
    placed = _placed(sized(docs, whole), shards).select("whole.*", "shard", "slot")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
