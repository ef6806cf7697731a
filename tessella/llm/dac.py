"""Operator 5: token ids in directly addressable codes: chunk levels, continuation bitmaps, rank directories."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytebpe import encoder
from .common import scratch_dir

MAGIC = b"DAC1"
BLOCK = 512  # bits of a bitmap for each entry of its rank directory
SEGMENT_IDS = 1 << 18


def pack(ids: np.ndarray) -> bytes:
    """A segment: 8-bit chunks from low to high, one level each.

    Level 0 has the lowest chunk of every id. A set bit in a level's bitmap says that the id goes on; its
    next chunk lies in the next level at the rank of that bit. The directory has the rank at every
    512th bit, so any id is found by a few reads a level.
    Layout: magic, ids, levels; for each level its length, then chunks, bitmap and directory.
    """
    left, parts = ids.astype(np.uint32), []
    while True:
        more = left > 0xFF
        chunks, bits = (left & 0xFF).astype(np.uint8), np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
        ranks = (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4")
        parts.append((chunks, bits, ranks))
        left = left[more] >> 8
        if not len(left):
            break
    head = MAGIC + struct.pack("<II", len(ids), len(parts))
    return head + b"".join(struct.pack("<I", len(c)) + c.tobytes() + b.tobytes() + r.tobytes() for c, b, r in parts)


class Segment:
    """Reads any id, or any run of ids, of a packed segment without decoding what comes before."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC segment")
        self.size, levels = struct.unpack_from("<II", data, 4)
        at, self.levels = 12, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<I", data, at)
            at += 4
            blocks = -(-n // BLOCK)
            chunks = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at + n)
            ranks = np.frombuffer(data, "<u4", blocks, at + n + len(bits))
            at += n + len(bits) + 4 * blocks
            self.levels.append((chunks, bits, ranks))

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before bit i."""
        block, byte = i // BLOCK, i // 8
        if block == len(ranks):
            return 0 if not block else int(ranks[-1]) + int(np.bitwise_count(bits[-(BLOCK // 8) :]).sum())
        n = int(ranks[block]) + int(np.bitwise_count(bits[block * (BLOCK // 8) : byte]).sum(dtype=np.int64))
        return n + (int(bits[byte]) & ((1 << (i % 8)) - 1)).bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                return value
            i, shift = self._rank(bits, ranks, i), shift + 8
        raise ValueError("a chunk is missing")

    def run(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1: on each level the run's continuations lie side by side from the rank of its start."""
        out, where, shift = np.zeros(stop - start, np.uint32), None, 0
        for chunks, bits, ranks in self.levels:
            part = chunks[start:stop].astype(np.uint32) << np.uint32(shift)
            if where is None:
                out |= part
            else:
                out[where] |= part
            first = start // 8
            go = np.unpackbits(bits[first : -(-stop // 8)], bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)
            n = int(go.sum())
            if not n:
                break
            where = np.flatnonzero(go) if where is None else where[go]
            start = self._rank(bits, ranks, start)
            stop, shift = start + n, shift + 8
        return out


FILE_SCHEMA = "part int, seg int, n_ids long, doc_ids array<bigint>, starts array<bigint>, data binary"
_ARROW = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("data", pa.binary())])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Writes the ids of every whole text (null as empty), each with `end_id` behind it, in ascending doc_id order.

    Texts are dealt to partitions by ranges of doc_id; partition k holds `part` = k, its segments count up
    from 0, and a segment holds whole documents: their ids, where each starts in the segment (and
    where the last ends), and the packed ids. Null doc_ids come first; rows of one id follow the order of
    their texts. Spark's writer commits each task's file once, so a lost executor's work is simply redone.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seg = encoder(tokenizer), TaskContext.get().partitionId(), 0
        names, pending, total = [], [], 0
        end = np.array([end_id], np.uint32)

        def flush():
            starts = np.cumsum([0, *map(len, pending)])
            row = [[part], [seg], [int(starts[-1])], [names], [starts.tolist()], [pack(np.concatenate(pending))]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _ARROW)], schema=_ARROW)

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), enc.ids([t or "" for t in b.column(1).to_pylist()])):
                names.append(doc)
                pending.append(np.concatenate([ids, end]))
                total += len(ids) + 1
                if total >= SEGMENT_IDS:
                    yield flush()
                    names, pending, total, seg = [], [], 0, seg + 1
        if names:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    slim = docs.select("doc_id", "text")
    made = slim.repartitionByRange(order[0]).sortWithinPartitions(*order).mapInArrow(segments, FILE_SCHEMA)
    # Pages are plain and not compressed, so a segment's bytes in the file are those that pack() made.
    made.write.mode("overwrite").option("compression", "uncompressed").option("parquet.enable.dictionary#data", "false").parquet(path)


def spans(files: DataFrame) -> DataFrame:
    """part, seg, n_ids, first (ids of all segments before it): where each segment lies among all ids."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a partition
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("part_base"))
    per = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    own = files.select("part", "seg", "n_ids", F.coalesce(F.sum("n_ids").over(per), F.lit(0)).alias("seg_base"))
    return own.join(F.broadcast(base), "part").select("part", "seg", "n_ids", (F.col("part_base") + F.col("seg_base")).alias("first"))


def read(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32: each document's ids read by address.

    ids_crc32 is the crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    files = spark.read.parquet(path)
    fields = [("part", pa.int32()), ("seg", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seg, names, starts, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                s = Segment(data)
                crc = [zlib.crc32(s.run(x, y).astype("<u4").tobytes()) for x, y in zip(starts, starts[1:])]
                n = len(names)
                cols = [[part] * n, [seg] * n, names, starts[:-1], np.diff(starts).tolist(), crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], schema=pa.schema(fields))

    rows = files.select("part", "seg", "doc_ids", "starts", "data").mapInArrow(documents, "part int, seg int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(spans(files).drop("n_ids"), ["part", "seg"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(numbers: DataFrame, path: str) -> DataFrame:
    """number, id of each row of `numbers` (number long): the id with so many ids of the whole corpus before it.

    A number meets its segment by the run of SEGMENT_IDS ids that it lies in, and the id is read by its address there. Only the
    segments asked for are read, each once whatever is asked of it. A null number, one below 0 or one past the last id has a null
    id; repeated numbers are answered each; an empty table gives no rows; other columns are left out.
    """
    files, run = numbers.sparkSession.read.parquet(path), lambda c: F.floor(c / SEGMENT_IDS)
    where = spans(files).withColumn("run", F.explode(F.sequence(run(F.col("first")), run(F.col("first") + F.col("n_ids") - 1))))
    asked = numbers.select("number").where("number >= 0").distinct().withColumn("run", run(F.col("number")))
    found = asked.join(where, "run").where(F.col("number").between(F.col("first"), F.col("first") + F.col("n_ids") - 1))
    # Distinct numbers of a segment are no more than its ids.
    by_segment = found.groupBy("part", "seg", "first").agg(F.collect_list(F.col("number") - F.col("first")).alias("at"))
    fields = pa.schema([("number", pa.int64()), ("id", pa.int64())])

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, at, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                s = Segment(data)
                yield pa.RecordBatch.from_arrays([pa.array([first + i for i in at], pa.int64()), pa.array([s[i] for i in at], pa.int64())], schema=fields)

    got = files.select("part", "seg", "data").join(by_segment, ["part", "seg"]).select("first", "at", "data").mapInArrow(ids, "number long, id long")
    return numbers.select("number").join(got, "number", "left")


def written_and_read(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes the files into the shared folder (or `path`) and reads every document back from them."""
    spark = docs.sparkSession
    path = path or f"{scratch_dir(spark)}/tessella-dac-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    return read(spark, path)
