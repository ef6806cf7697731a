"""Operator 1: SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, held

MARK = "▁"
_RUNS = re.compile(" +[^ ]*")


class PieceCodec:
    """Segments each distinct marked word once and joins its ids back by position.

    A marked word is a run of blanks with the non-blanks after it. Where no piece has a mark behind
    another character, no merge can cross into the next marked word, so the words segment
    independently. If a model doesn't have this property, or its normaliser does more than mark
    blanks, whole texts go to the library instead.
    """

    def __init__(self, path: str, limit: int = 160_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table = Table(limit)
        self.eos, self.mark_id = self.sp.eos_id(), self.sp.piece_to_id(MARK)
        self.independent = self._independent()

    def _independent(self) -> bool:
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            return False
        probes = ["a  b", "  a", "a ", " ", "AÉﬁ　\t\r\n", "é x y​", "Ａ ①"]
        return all(self.sp.normalize(t) == MARK + t.replace(" ", MARK) for t in probes)

    def _fill(self, words: list[str]) -> None:
        ids = self.sp.encode([w[1:] for w in words], num_threads=1)  # the library puts the first mark itself
        ids = [own or [self.mark_id] for own in ids]  # and gives nothing for a mark alone
        self.table.update((w, (len(own), " ".join(map(str, own)), text)) for w, own, text in zip(words, ids, self.sp.decode(ids, num_threads=1)))

    @staticmethod
    def words(text: str) -> list[str]:
        """Marked words of a text, each with its blanks in front; the empty text has none."""
        if not text:
            return []
        return _RUNS.findall(" " + text.replace(MARK, " "))

    def segment(self, texts: list[str]) -> list[list[tuple]]:
        """For each text, by position: number of ids, ids as text and decoded text of each marked word."""
        if not self.independent:
            out = []
            for t in texts:
                ids = self.sp.encode(t)
                out.append([(len(ids), " ".join(map(str, ids)), self.sp.decode(ids))] if ids else [])
            return out
        parts = [self.words(t) for t in texts]
        if new := self.table.missing(set().union(*parts)):
            self._fill(new)
        get = self.table.__getitem__
        return [list(map(get, p)) for p in parts]

    def ids(self, entries: list[tuple], end: bool = True) -> list[int]:
        return list(map(int, self.id_text(entries, end).split()))

    def id_text(self, entries: list[tuple], end: bool = True) -> str:
        return " ".join([e[1] for e in entries] + [str(self.eos)] * end)

    @staticmethod
    def decoded(entries: list[tuple]) -> str:
        """decode() drops the first mark of each word's ids; joined by a blank that is the text's decoding."""
        return " ".join([e[2] for e in entries])


def codec(path: str) -> PieceCodec:
    return held("codec", path, PieceCodec)


def _strings(texts: pa.Array) -> list[str]:
    return [t or "" for t in texts.to_pylist()]


def encode(docs: DataFrame, path: str, end: bool = True) -> DataFrame:
    """doc_id, ids array<int> of each whole text (null as empty); other columns are left out.

    Ids equal the library's for the whole text, with an end id only. The empty text has the end id alone.
    """

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([c.ids(e, end) for e in c.segment(_strings(texts))], pa.list_(pa.int32()))

    return docs.select("doc_id", ids_of("text").alias("ids"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the library's decode() of each list of ids (null as empty)."""

    @F.arrow_udf("string")
    def text_of(ids: pa.Array) -> pa.Array:
        sp = codec(path).sp
        return pa.array([sp.decode(list(i or [])) for i in ids.to_pylist()], pa.string())

    return encoded.select("doc_id", text_of("ids").alias("text"))


def digests(path: str, with_ids: bool = False):
    """A column function: text to struct<n_tokens, ids_sha256, decoded_sha256> of the encoding with its end id, and its ids."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    def of(texts: pa.Array) -> pa.Array:
        c = codec(path)
        rows = c.segment(_strings(texts))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        n = np.fromiter((sum(e[0] for e in r) + 1 for r in rows), np.int64, len(rows))
        cols = {"n_tokens": pa.array(n), "ids_sha256": pa.array([sha(c.id_text(r)) for r in rows], pa.string()), "decoded_sha256": pa.array([sha(c.decoded(r)) for r in rows], pa.string())}
        if with_ids:
            cols["ids"] = pa.array([c.ids(r) for r in rows], pa.list_(pa.int32()))
        return pa.StructArray.from_arrays(list(cols.values()), list(cols))

    return of
