"""Operator 8: exact token counts from distinct pre-tokens and their frequencies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytebpe import ByteBpe
from .common import cut, held, trim
from .sp_codec import PieceCodec

#: So many of the most frequent pre-tokens have their counts in every worker; the counts of all others are joined.
KNOWN = 1_000_000
#: Distinct pre-tokens that a task adds up before it hands them on.
FLUSH = 1_000_000
NUL = "\x00"


class PreTokens:
    """Pre-tokens of a text, and how many pieces each has. None where a text can't be cut: the library then counts it whole."""

    def __init__(self, path: str):
        self.enc = PieceCodec(path) if path.endswith(".model") else ByteBpe(path)

    def of(self, text: str) -> list[str] | None:
        if isinstance(self.enc, PieceCodec):
            return self.enc.words(text) if self.enc.independent else None
        return self.enc.parts(text) if self.enc.apart(text) else None

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        if isinstance(self.enc, PieceCodec):
            self.enc._fill(self.enc.table.missing(set(pre_tokens)))
            return [self.enc.table[w][0] for w in pre_tokens]
        return [len(self.enc.encode(w)) // self.enc.type.itemsize for w in pre_tokens]

    def whole(self, text: str) -> int:
        return len(self.enc.sp.encode(text) if isinstance(self.enc, PieceCodec) else self.enc.tok.encode(text, add_special_tokens=False).ids)


def pre_tokens(path: str) -> PreTokens:
    return held("pre-tokens", path, PreTokens)


def distinct(docs: DataFrame, path: str) -> DataFrame:
    """pre_token, n (occurrences in all texts), pieces of each distinct pre-token that occurs again. Each task adds its own up first.

    Those that occur once in all texts are left to where they occur, where they are counted once just as well.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, total = pre_tokens(path), Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["pre_token", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                total.update(split.of(text or "") or ())
                if len(total) > FLUSH:
                    yield rows()
                    total.clear()
        yield rows()
        total.clear()
        trim()

    each = docs.select("text").mapInArrow(count, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))
    return cut(each.where("n > 1").select("pre_token", "n", pieces(path)("pre_token").alias("pieces")))


def pieces(path: str):
    """A column function: a pre-token to its number of pieces, null to null."""

    @F.arrow_udf("long")
    def of(words: pa.Array) -> pa.Array:
        own = [w for w in words.to_pylist() if w is not None]
        counts = iter(pre_tokens(path).pieces(own))
        return pa.array([next(counts) if w else None for w in words.is_valid().to_pylist()], pa.int64())

    return of


def counted(text: Column, path: str, known: dict[str, int], spark) -> Column:
    """struct<own, rest>: pieces of a text's known pre-tokens, and the others, each as often as it occurs, between NULs. A pre-token with a NUL is counted here."""
    shared = spark.sparkContext.broadcast(known)  # KNOWN entries at most

    @F.arrow_udf("own long, rest string")
    def of(texts: pa.Array) -> pa.Array:
        split, get = pre_tokens(path), shared.value.get
        own, rest = [], []
        for text in texts.to_pylist():
            parts = split.of(text or "")
            if parts is None:
                own.append(split.whole(text or ""))
                rest.append(None)
                continue
            bag = Counter(parts)
            total, left = 0, []
            for w, k in bag.items():
                if (n := get(w)) is None and NUL in w:
                    (n,) = split.pieces([w])
                if n is None:
                    left += [w] * k
                else:
                    total += n * k
            own.append(total)
            rest.append(NUL.join(left) if left else None)
        return pa.StructArray.from_arrays([pa.array(own, pa.int64()), pa.array(rest, pa.string())], ["own", "rest"])

    return of(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, whole texts.

    The pieces of each distinct pre-token of all texts are counted once; a document's pre-token frequencies meet these counts, the
    most frequent in the worker, all others by a join, and are summed. Counts equal the library's for the whole text, with no begin,
    end or added special tokens; strings of special tokens inside a text count as the library's default takes them, which counts
    such texts whole, as it does all texts of a file whose pre-tokens don't stand alone. Null and empty texts have 0 bytes and 0
    tokens; repeated rows are counted each; an empty table gives no rows; other columns are ignored.
    """
    table = distinct(docs, path)
    top = table.orderBy(F.desc("n"), "pre_token").limit(KNOWN).select("pre_token", "pieces").toArrow()
    known = dict(zip(top["pre_token"].to_pylist(), top["pieces"].to_pylist()))
    n_bytes = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    rows = docs.select("doc_id", n_bytes.alias("n_bytes"), counted(F.col("text"), path, known, docs.sparkSession).alias("c")).select("doc_id", "n_bytes", "c.*")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))  # fixed once written
    rest = rows.select("row", F.explode(F.split("rest", r"\x00")).alias("pre_token"))
    met = rest.join(table.select("pre_token", F.col("pieces").alias("known")), "pre_token", "left")
    met = met.select("row", F.coalesce("known", pieces(path)(F.when(F.col("known").isNull(), F.col("pre_token")))).alias("pieces"))
    added = met.groupBy("row").agg(F.sum("pieces").alias("added"))
    n = (F.col("own") + F.coalesce("added", F.lit(0))).alias("n_tokens")
    return rows.join(added, "row", "left").select("doc_id", "n_bytes", n).withColumn("over_limit", F.col("n_tokens") > limit)
