"""Ids and id counts of texts through a table of distinct pre-tokens, for both tokenizer libraries."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from .common import held
from .sp_codec import PieceCodec

#: A blank inside a longer run of white space, where a cut would change the pre-tokens.
_LONG_RUN = re.compile(r"\s (?:\s|\Z)")
#: A blank between two other characters than white space, where a cut never does.
_SINGLE = re.compile(r"(?<=\S) (?=\S)")


#: White space other than blanks and line feeds, whose absence saves the search for long runs.
_RARE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_SIGNS = r"[!-/:-@\[-`{-~]*"
#: One or two words of letters that every Unicode version counts as such, each with the signs behind it, a line feed between them.
_WORD = re.compile(rf"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)({_SIGNS})(?:(\n)([A-Za-zÀ-ÖØ-öø-ɏ]+)({_SIGNS}))?")


class Pieces(dict):
    """A table of distinct pieces, filled as they come. Past the limit the older half goes, but for pieces in use."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.half, self.old = make, limit // 2, {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
            if len(piece) > 1000:  # whole texts aren't worth keeping
                return value
        self[piece] = value
        return value

    def turn(self) -> None:
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()


class ByteBpe:
    """A cut before a blank that follows a non-blank never changes byte-level pre-tokens.

    So a text is cut at its single blanks, each piece with its blank is encoded once, and ids are joined
    back by position. Texts with longer runs of white space around a blank are cut at those between two
    non-blanks only; those with the string of an added token go to the library whole. A file whose pre-tokeniser isn't the plain byte-level one
    is always used whole.

    Pieces that are plainly one word are merged by rank instead of by the library, which takes a
    third of the time. Both ways give the same ids if ranks follow the order of merges and every
    token's own string merges to it: the parts inside a token's string then meet in one way only.
    That is verified for the file; if it doesn't hold, the library encodes all pieces.
    """

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("post_processor") is None
        self.type = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.table = Pieces(self.encode, limit)
        self.merge = self._ranks(spec) if self.plain else None

    def _ranks(self, spec: dict):
        """A function of a word's bytes to its ids, or None if ranks can't stand for the merges."""
        from tiktoken import Encoding
        from tokenizers.pre_tokenizers import ByteLevel

        model = spec["model"]
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if made != sorted(set(made)) or len(made) + 256 != len(vocab):
            return None
        if any(len(t := self.tok.model.tokenize(w)) != 1 or t[0].id != i for w, i in vocab.items()):
            return None
        shown = {ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0]: b for b in range(128)}
        # The other bytes show as the characters that are left, in order, of the byte alphabet.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = [b for b in range(256) if b not in printable]
        alphabet = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        if any(alphabet.get(c) != b for c, b in shown.items()) or any(c not in alphabet for w in vocab for c in w):
            return None
        ranks = {bytes(alphabet[c] for c in w): i for w, i in vocab.items()}
        return Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def encode(self, piece: str) -> bytes:
        """Ids of a piece as little-endian numbers of `type`."""
        if self.merge is not None and (m := _WORD.fullmatch(piece)):
            ids = []
            for g in m.groups():
                if g:
                    ids += self.merge(g.encode())
            return array(self.code, ids).tobytes()
        return array(self.code, self.tok.encode(piece, add_special_tokens=False).ids).tobytes()

    def apart(self, text: str) -> bool:
        """Whether a text has pre-tokens that stand alone."""
        return self.plain and not any(a in text for a in self.added)

    def cut(self, text: str) -> bool:
        """Whether a text may be cut at all its blanks."""
        plain = "  " not in text and "\n " not in text and not any(c in text for c in _RARE)
        return plain or not _LONG_RUN.search(text)

    def parts(self, text: str) -> list[str]:
        """Pieces that encode independently."""
        if not text:
            return []
        if not self.apart(text):
            return [text]
        first, *rest = text.split(" ") if self.cut(text) else _SINGLE.split(text)
        out = [" " + p for p in rest]
        return [first, *out] if first else out

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian numbers of `type`."""
        self.table.turn()
        get = self.table.__getitem__
        return [b"".join(map(get, self.parts(t))) for t in texts]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(p) // self.type.itemsize for p in self.packed(texts)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(p, self.type).astype(np.uint32) for p in self.packed(texts)]


class SentencePieces:
    """The same interface over a SentencePiece model, without begin or end ids."""

    def __init__(self, path: str):
        self.codec = PieceCodec(path)

    def counts(self, texts: list[str]) -> list[int]:
        return [sum(e[0] for e in r) for r in self.codec.segment(texts)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.codec.ids(r, False), np.uint32) for r in self.codec.segment(texts)]


def encoder(path: str):
    return held("encoder", path, lambda p: SentencePieces(p) if p.endswith(".model") else ByteBpe(p))
