"""Operator 9: which words of a document lie in passages of benchmark items: a prefix-filtered set join."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

WINDOW = 10
#: Largest block of benchmark text, in bytes, whose index goes to every worker; more items make more blocks.
BLOCK_BYTES = 4 << 20
#: Candidate windows compared at a time.
CANDIDATES = 1 << 18

#: ASCII letters in lower case and digits stay, other ASCII ends a word, everything else is part of a word.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _utf8(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


class Index:
    """Windows of a block of items, reached through the rarest word of each.

    A window is contained exactly or not at all, so by the prefix bound one word of it suffices, and the
    rarest makes the fewest candidates. Its place in the window fixes where the window must start
    (position), the window's own length how far it reaches, and all words are then compared.
    Everything but the words themselves lies in arrays, of some 60 bytes a window.
    """

    def __init__(self, items: list[tuple[str, bytes]], counts: dict[bytes, int], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        name, rows, owners = {item: i for i, item in enumerate(self.items)}, [np.zeros((0, window), np.int32)], [np.zeros(0, np.int32)]
        for item, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number)) for w in words(text)], np.int32)
            if n := min(window, len(ids)):
                own = np.full((len(ids) - n + 1, window), -1, np.int32)
                own[:, :n] = np.lib.stride_tricks.sliding_window_view(ids, n)
                rows.append(own)
                owners.append(np.full(len(own), name[item], np.int32))
        self.windows, back = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([back.reshape(-1), np.concatenate(owners)], 1), axis=0)
        self.owner, self.owner_from = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.length = (self.windows >= 0).sum(1)
        freq = np.array([*(counts.get(w, 0) for w in self.number), 0], np.int64)
        rank = np.empty(len(freq), np.int64)
        rank[np.lexsort((np.arange(len(freq)), freq))] = np.arange(len(freq))
        rank[-1] = len(freq)  # where a shorter window has no word
        place = rank[self.windows].argmin(1) if len(self.windows) else np.zeros(0, np.int64)
        anchor = self.windows[np.arange(len(self.windows)), place] if len(self.windows) else np.zeros(0, np.int32)
        #: Windows in the order of their anchors, the anchors' places in them, and where each word's windows start.
        self.by_anchor = np.argsort(anchor, kind="stable")
        self.place = place[self.by_anchor]
        self.first = np.searchsorted(anchor[self.by_anchor], np.arange(len(self.number) + 2))
        self.anchors = np.append(np.diff(self.first)[:-1], 0)  # windows of each word; the last, at -1, has none
        self.anchor_words = {w for w, i in self.number.items() if self.anchors[i]}

    def match(self, ids: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Positions of words in any occurrence of a window, and the items that have one. ids: -1 for words of no item."""
        hit = np.zeros(len(ids) + 1, np.int64)
        at = np.flatnonzero(self.anchors[ids])
        many = self.anchors[ids[at]]
        found = set()
        ends = np.cumsum(many)
        for low, high in _runs(ends, CANDIDATES):  # candidates are compared so many at a time
            p, n = at[low:high], many[low:high]
            k = np.repeat(self.first[ids[p]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start, k = np.repeat(p, n) - self.place[k], self.by_anchor[k]
            ok = (start >= 0) & (start + self.length[k] <= len(ids))
            start, k = start[ok], k[ok]
            for j in range(self.windows.shape[1]):
                word = self.windows[k, j]
                same = (word < 0) | (ids[np.minimum(start + j, len(ids) - 1)] == word)
                start, k = start[same], k[same]
            np.add.at(hit, start, 1)
            np.add.at(hit, start + self.length[k], -1)
            found.update(np.unique(k).tolist())
        items = {self.items[o] for k in found for o in self.owner[self.owner_from[k] : self.owner_from[k + 1]].tolist()}
        return np.flatnonzero(np.cumsum(hit[:-1]) > 0), items


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts running totals into runs of at most `most`, or of one."""
    low = 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
        yield low, high
        low = high


def corpus_counts(docs: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """How often each benchmark word occurs in all documents: one row a word and task is shuffled."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = known.value, np.zeros(len(known.value) + 1, np.int64)
        for b in batches:
            for t in _utf8(b.column(0)):
                c = Counter(words(t))
                for w in c.keys() & number.keys():
                    total[number[w]] += c[w]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["w", "n"])

    rows = docs.select("text").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return {vocabulary[r.w]: r.n for r in rows}


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items, each with words, in blocks of at most block_bytes of text (or one item)."""
    block, size = [], 0
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).where("item_id is not null and text is not null").orderBy("item_id")
    for item, text in items.toLocalIterator():
        text = bytes(text)
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    yield block


def _hits(text: Column, index: Index, spark: SparkSession) -> Column:
    """struct<n_words, places array<int>, items array<string>> of a text."""
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf("n_words long, places array<int>, items array<string>")
    def of(texts: pa.Array) -> pa.Array:
        index = shared.value
        get, n, places, items = index.number.get, [], [], []
        for t in _utf8(texts):
            ws = words(t)
            n.append(len(ws))
            if index.anchor_words.isdisjoint(ws):
                places.append([])
                items.append([])
                continue
            hit, own = index.match(np.fromiter((get(w, -1) for w in ws), np.int64, len(ws)))
            places.append(hit.astype(np.int32))
            items.append(sorted(own))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["n_words", "places", "items"])

    return of(text)


def indexes(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """An index for each block of the benchmark, its words ordered by how rare they are in all of `docs`. Only one block's words are here at a time."""
    for b in blocks(benchmark, block_bytes):
        vocabulary = sorted({w for _, t in b for w in words(t)})
        yield Index(b, corpus_counts(docs, vocabulary) if vocabulary else {}, window)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, with all their columns, whose texts have no word in an occurrence of a benchmark window."""
    out = docs
    for index in indexes(docs, benchmark, window, block_bytes):
        out = out.where(F.size(_hits(F.col("text"), index, docs.sparkSession)["places"]) == 0)
    return out


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, places (sorted positions of hit words), items (sorted, distinct) of every whole text.

    A window is `window` consecutive words of an item, or all words of a shorter one; items without words
    or id are left out, null texts have no words. Every row comes out, also those that repeat or have no
    id: several blocks are merged by numbers that the rows are given. Other columns
    are ignored. The benchmark is the stated query set: its index goes to the workers by blocks of
    bounded size, and each block meets all documents.
    """
    hits = lambda rows, i: rows.withColumn("h", _hits(F.col("text"), i, docs.sparkSession)).drop("text").select("*", "h.*").drop("h")
    rows, found = docs.select("doc_id", "text"), None
    each = indexes(docs, benchmark, window, block_bytes)
    index, more = next(each), next(each, None)
    if more is None:
        return hits(rows, index)
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))  # fixed once written
    found = hits(rows, index)
    while more is not None:
        found, more = found.unionByName(hits(rows, more).where("size(places) > 0")), next(each, None)
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))  # noqa: E731  a row a block
    return found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), merged("places").alias("places"), merged("items").alias("items")).drop("row")


def report(found: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 (of the sorted item ids, joined by commas), contaminated for each document."""
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("places") > 0).alias("contaminated"),
    )


