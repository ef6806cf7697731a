"""What several corpus operators share: scratch space, Arrow batches, words, global order."""

from __future__ import annotations

import ctypes
import gc
import itertools
import pickle
import re
import sys
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in a batch that goes to a Python worker, so that a batch of long texts stays small.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes, for the queries of this subpackage."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; where none is named, one of our own if Spark runs in this process alone."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if shared:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(shared)
        return shared.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
    return sc.getCheckpointDir().rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint, which survives a lost executor."""
    scratch_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    # A checkpoint keeps its plan's estimated size and constraints. Over rounds of joins the estimate is multiplied into a number
    # of millions of digits, so the rows go on as a table of which nothing is assumed.
    spark = df.sparkSession
    rows = kept._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_limit(share: float) -> int:
    """The signed 64-bit value that a uniform hash stays at or below with the given chance."""
    return max(-(2**63), min(2**63 - 1, int(share * 2**64) - 2**63))


def crc_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


# --- words -----------------------------------------------------------------

def _keep(is_word) -> bytes:
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    return bytes(lower[b] if b > 127 or is_word(chr(b)) else 32 for b in range(256))


#: Byte tables: ASCII letters (and digits) in lower case, other ASCII to a blank, the rest as it is.
ALNUM = _keep(lambda c: c.isalnum())
LETTERS = _keep(lambda c: c.isalpha())


def lowered(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text in lower case, null as empty."""
    return pc.fill_null(pc.utf8_lower(texts.cast(pa.string())), "").cast(pa.binary()).to_pylist()


def split_words(texts: list[bytes], keep: bytes = ALNUM) -> tuple[list[bytes], np.ndarray]:
    """All words in order, and the number of words in each text."""
    parts = [t.translate(keep).split() for t in texts]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    return list(itertools.chain.from_iterable(parts)), counts


def slices(texts: pa.Array, most: int = 1 << 20):
    """Runs of rows of at most `most` bytes of text, or one row, so that work space doesn't follow the batch."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts.cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(texts) or not len(texts) and at == 0:
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, stop - at)
        at = stop


class WordIndex(dict):
    """Numbers words as they come; `new` holds those not yet looked at."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit, self.new, self.hits = limit, [], np.zeros(0, np.int64)

    def __missing__(self, word):
        i = self[word] = len(self)
        self.new.append(word)
        return i

    def numbers(self, words: list) -> np.ndarray:
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        hits = np.bincount(at, minlength=len(self))
        hits[: len(self.hits)] += self.hits
        self.hits = hits
        return at

    def shrunk(self) -> np.ndarray | None:
        """Past the limit, keeps the more frequent half, whose former numbers it returns in the new order."""
        if len(self) <= self.limit:
            return None
        kept = np.sort(np.argsort(-self.hits, kind="stable")[: self.limit // 2])
        words = list(self)
        self.clear()
        self.update((words[k], i) for i, k in enumerate(kept.tolist()))
        self.hits = self.hits[kept] // 2
        return kept


class Table(dict):
    """A table of distinct keys of bounded size: past the limit the older half goes, but for keys in use."""

    def __init__(self, limit: int):
        super().__init__()
        self.half, self.old = limit // 2, {}

    def missing(self, keys: set) -> list:
        """Makes room and returns the keys that have no value yet."""
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()
        new = keys.difference(self)
        known = new.intersection(self.old)
        self.update((k, self.old[k]) for k in known)
        return list(new.difference(known))


def doc_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; a run of none gives 0."""
    out = np.zeros((len(counts), *values.shape[1:]), np.float64)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some], axis=0)
    return out


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies; only its path is ever used."""
    import public_tokenizers

    return public_tokenizers.path(name)


def in_task(rows: DataFrame, build: Callable[[Iterator[pa.RecordBatch]], object]):
    """What `build` makes of a table of bounded size. It runs in one task, so that models aren't trained in the driver's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pickle.dumps(build(batches))
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["made"])

    made = rows.repartition(1).mapInArrow(run, "made binary").first()
    return pickle.loads(made.made) if made else build(iter(()))


class Drawn:
    """The texts of the least hashes of each kind: at most `most` distinct ones, and beyond the first no more than `size` bytes in all.

    Whole texts of any length come in; the order is by hash alone, so length doesn't decide.
    """

    def __init__(self, most: int, size: int):
        self.most, self.size, self.kinds = most, size, {}

    def add(self, kind, h: int, text: str) -> None:
        rows = self.kinds.setdefault(kind, {"bytes": 0, "rows": set()})
        if (h, text) not in rows["rows"]:
            rows["rows"].add((h, text))
            rows["bytes"] += len(text)
            if len(rows["rows"]) > 3 * self.most or rows["bytes"] > 3 * self.size and len(rows["rows"]) > 1:
                kept = self._least(rows["rows"])
                self.kinds[kind] = {"bytes": sum(len(t) for _, t in kept), "rows": set(kept)}

    def _least(self, rows: set) -> list[tuple[int, str]]:
        out, total = [], 0
        for h, t in sorted(rows)[: self.most]:
            total += len(t.encode())
            if out and total > self.size:
                break
            out.append((h, t))
        return out

    def rows(self, kind) -> list[tuple[int, str]]:
        return self._least(self.kinds[kind]["rows"])

    def texts(self) -> dict:
        return {k: [t for _, t in self.rows(k)] for k in sorted(self.kinds)}


_held: tuple = (None, None, None)


def held(kind: str, source, make):
    """What a worker keeps between batches: one thing at a time, so that reused workers don't gather all operators' tables."""
    global _held
    if _held[0] != kind or not (_held[1] is source or isinstance(source, str) and _held[1] == source):
        _held = (None, None, None)
        trim()
        _held = (kind, source, make(source))
    return _held[2]


def trim() -> None:
    """Gives freed memory of this process back to the system."""
    gc.collect()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of rounds that are over, which it does as the driver's garbage goes; freed memory goes back to the system."""
    trim()
    spark.sparkContext._jvm.System.gc()


# --- global order ------------------------------------------------------------

def global_prefix(df: DataFrame, order: list[Column], value: Column) -> DataFrame:
    """Adds `row_before`, `value_before` (rows and values ahead in the given order) and `rows_all`, `value_all`.

    Ranges of the order are dealt to partitions once and checkpointed; each partition then needs only
    the totals of those ahead of it: one row a partition, the only thing that is broadcast.
    """
    v, pid = "value_own", "range_part"
    ranged = cut(df.withColumn(v, value).repartitionByRange(*order).withColumn(pid, F.spark_partition_id()))
    totals = ranged.groupBy(pid).agg(F.count("*").alias("rows_in"), F.sum(v).alias("value_in"))
    ahead = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    base = totals.select(
        pid,
        F.coalesce(F.sum("rows_in").over(ahead), F.lit(0)).alias("rows_base"),
        F.coalesce(F.sum("value_in").over(ahead), F.lit(0)).alias("value_base"),
        F.sum("rows_in").over(every).alias("rows_all"),
        F.sum("value_in").over(every).alias("value_all"),
    )
    own = Window.partitionBy(pid).orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.select("*", (F.row_number().over(own) - 1).alias("row_in"), F.coalesce(F.sum(v).over(before), F.lit(0)).alias("value_run"))
        .join(F.broadcast(base), pid)
        .withColumn("row_before", F.col("rows_base") + F.col("row_in"))
        .withColumn("value_before", F.col("value_base") + F.col("value_run"))
        .drop(pid, "row_in", "value_run", "rows_base", "value_base")
    )


