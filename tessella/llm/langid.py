"""Operator 2: language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, Drawn, WordIndex, doc_sums, hash_limit, held, in_task, lowered, slices, split_words

ORDER = 5
#: Bounds of the training sample, for each language: documents, and bytes of all their texts.
TRAIN_DOCS, TRAIN_BYTES = 300, 3 << 20
#: Every so manyth sampled document calibrates instead of training.
CALIBRATE = 5
UNDETERMINED = "und"
_PRIME = np.uint64(0x100000001B3)
START, END = 1, 2


def _hashes(codes: np.ndarray, offset: np.ndarray, order: int) -> np.ndarray:
    """Hash of the `order` codes up to each place; 0 where a word has fewer before it."""
    h = np.full(len(codes), np.uint64(0xCBF29CE484222325) + np.uint64(order))
    for j in range(order - 1, -1, -1):
        c = np.zeros(len(codes), np.uint64)
        c[j:] = codes[: max(len(codes) - j, 0)]
        h = (h ^ c) * _PRIME
        h ^= h >> np.uint64(29)
    h[offset < order - 1] = 0
    return h


def _coded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, each between START and END; each place's offset in its word; word lengths."""
    texts = [w.decode("utf-8", "replace") for w in words]
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = ("\x01" + "\x02\x01".join(texts) + "\x02") if texts else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    size = n + 2
    offset = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    return codes, offset, size


@dataclass
class Model:
    """For all languages at once: sorted hashes with a row of values for each language.

    grams[k]: hashes of (k+1)-grams, and the discounted relative frequency of the last code in its context;
    contexts[k]: hashes of their contexts, and the weight that the order below gets.
    """

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float
    heat: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    noise: np.ndarray | None = None

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy sums (nats) of each word in each language, and the characters predicted; 0 and 0 without a letter."""
        codes, offset, size = _coded(words)
        p = np.full((len(codes), len(self.langs)), self.floor)
        below = np.zeros(len(codes), np.uint64)  # the context of order 1 is empty
        for k, ((gh, gv), (ch, cv)) in enumerate(zip(self.grams, self.contexts)):
            h = _hashes(codes, offset, k + 1)
            ctx = below if k == 0 else np.concatenate([[np.uint64(0)], _hashes(codes, offset, k)[:-1]])
            use = offset >= max(k, 1)
            at = np.minimum(np.searchsorted(ch, ctx), len(ch) - 1)
            known = use & (ch[at] == ctx)
            p[known] *= cv[at[known]]
            at = np.minimum(np.searchsorted(gh, h), len(gh) - 1)
            known &= gh[at] == h
            p[known] += gv[at[known]]
        cost = -np.log(p)
        cost[offset == 0] = 0  # the start isn't predicted
        letters = np.fromiter((any(map(str.isalpha, w.decode("utf-8", "replace"))) for w in words), bool, len(words))
        return doc_sums(cost, size) * letters[:, None], np.where(letters, size - 1, 0)


def train(samples: dict[str, list[bytes]], order: int = ORDER) -> Model:
    """samples: lower-case UTF-8 texts by language. Counts below the highest order are those of distinct left neighbours."""
    langs = sorted(samples)
    grams, contexts, alphabet = [defaultdict(lambda: np.zeros(len(langs))) for _ in range(order)], [defaultdict(lambda: np.ones(len(langs))) for _ in range(order)], set()
    for col, lang in enumerate(langs):
        freq = Counter(split_words(samples[lang], LETTERS)[0])
        words = list(freq)
        codes, offset, size = _coded(words)
        weight = np.repeat(np.fromiter(freq.values(), np.int64, len(words)), size)
        alphabet.update(np.unique(codes).tolist())
        hashes = [_hashes(codes, offset, k) for k in range(1, order + 2)]
        for k in range(order):
            h, ok = hashes[k], offset >= max(k, 1)
            if k == order - 1:
                name, first = np.unique(h[ok], return_index=True)
                count = np.bincount(np.searchsorted(name, h[ok]), weight[ok])
            else:  # distinct longer grams that end in this one; grams at the start of a word have no left neighbour and keep their counts
                inner = ok & (offset >= k + 1)
                longer, at = np.unique(hashes[k + 1][inner], return_index=True)
                ends = h[inner][at]
                edge = ok & (offset == k)
                name = np.unique(h[ok])
                count = np.bincount(np.searchsorted(name, ends), minlength=len(name)) + np.bincount(np.searchsorted(name, h[edge]), weight[edge], len(name))
                first = None
            # Any place of a gram gives its context.
            order_of = np.argsort(h[ok], kind="stable")
            place = np.flatnonzero(ok)[order_of[np.searchsorted(h[ok][order_of], name)]]
            ctx = np.zeros(len(name), np.uint64) if k == 0 else hashes[k - 1][place - 1]
            total_name, back = np.unique(ctx, return_inverse=True)
            total = np.bincount(back, count)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            for g, v in zip(name.tolist(), np.maximum(count - discount, 0) / total[back]):
                grams[k][g][col] = v
            for c, v in zip(total_name.tolist(), discount * np.bincount(back) / total):
                contexts[k][c][col] = v

    def arrays(table: dict) -> tuple[np.ndarray, np.ndarray]:
        key = np.array(sorted(table), np.uint64)
        return key, np.array([table[k] for k in key.tolist()], np.float64).reshape(len(key), len(langs))

    return Model(langs, [arrays(t) for t in grams], [arrays(t) for t in contexts], 1.0 / (len(alphabet) + 1))


class Scorer:
    """Scores each distinct word once; documents add their words up."""

    def __init__(self, model: Model):
        self.model, self.index = model, WordIndex()
        self.cost, self.chars = np.zeros((0, len(model.langs)), np.float32), np.zeros(0, np.int64)

    def entropies(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Nats a character in each language, and characters, of each text; characters 0: no letter."""
        if (kept := self.index.shrunk()) is not None:
            self.cost, self.chars = self.cost[kept], self.chars[kept]
        words, counts = split_words(texts, LETTERS)
        at = self.index.numbers(words)
        if self.index.new:
            cost, chars = self.model.words(self.index.new)
            self.cost, self.chars = np.concatenate([self.cost, cost.astype(np.float32)]), np.concatenate([self.chars, chars])
            self.index.new = []
        chars = doc_sums(self.chars[at], counts)
        return doc_sums(self.cost[at], counts) / np.maximum(chars, 1)[:, None], chars


def calibrate(model: Model, samples: list[tuple[str, bytes]]) -> Model:
    """Fits the heat of the score, and by language what entropies its own texts have: mean, spread and noise a character."""
    n = len(model.langs)
    h, chars = Scorer(model).entropies([t for _, t in samples])
    truth = np.array([model.langs.index(x) for x, _ in samples], np.int64)
    use = chars > 0
    h, chars, truth = h[use], chars[use], truth[use]
    model.mean, model.spread, model.noise = np.full(n, h.min(1).mean() if len(h) else 3.0), np.full(n, 0.5), np.full(n, 4.0)
    if len(h):
        own = h[np.arange(len(h)), truth]
        for k in range(n):
            if (truth == k).sum() >= 5:
                x, c = own[truth == k], chars[truth == k]
                model.mean[k] = np.average(x, weights=np.minimum(c, 500))
                model.noise[k] = max(1.0, np.sqrt(np.mean((x - model.mean[k]) ** 2 * np.minimum(c, 500))))
                model.spread[k] = max(0.1, x.std())

        def loss(heat: float) -> float:
            z = -(h - h.min(1, keepdims=True)) * np.minimum(chars, 200)[:, None] * heat
            return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(h)), truth]))

        model.heat = min(np.geomspace(0.02, 2, 25), key=loss)
    return model


def judge(model: Model, h: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language's index, its score, and whether it is rejected.

    Rejected are texts without letters, and those whose entropy is 8 calibrated deviations above the
    language's own texts; the deviation grows as texts get shorter.
    """
    best = h.argmin(1)
    z = -(h - h.min(1, keepdims=True)) * np.minimum(chars, 200)[:, None] * model.heat
    score = np.where(chars > 0, 1 / np.exp(z).sum(1), 0.0)
    limit = model.mean[best] + 8 * np.sqrt(model.spread[best] ** 2 + model.noise[best] ** 2 / np.maximum(chars, 1))
    return best, score, (chars == 0) | (h.min(1) > limit)


def drawn(labelled: DataFrame, docs_a_language: int = TRAIN_DOCS) -> DataFrame | None:
    """lang, h, text: of each language the rows whose text has one of the least hashes, about twice `docs_a_language`. None where no row has a language.

    Counts come first; a hash threshold by language then bounds what is read on, so no group is sorted or gathered whole.
    """
    usable = labelled.where("text is not null and lang is not null")
    counts = {r.lang: r.n for r in labelled.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    cut_off = F.create_map(*(x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(hash_limit((2 * docs_a_language + 50) / n)))))
    return usable.select("lang", F.xxhash64("text", F.lit(17)).alias("h"), "text").where(F.col("h") <= F.element_at(cut_off, F.col("lang")))


def fit(labelled: DataFrame) -> Model | None:
    """A calibrated model of the languages in `labelled` (text, lang), or None where none is labelled.

    It learns from at most TRAIN_DOCS distinct whole texts of each language, of any length, in the order of their
    hashes until they make TRAIN_BYTES; repeated rows count once. One task trains it.
    """
    rows = drawn(labelled)

    def build(batches: Iterator[pa.RecordBatch]) -> Model | None:
        least = Drawn(TRAIN_DOCS, TRAIN_BYTES)
        for b in batches:
            for lang, h, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                least.add(lang, h, text)
        samples = {k: lowered(pa.array(v, pa.string())) for k, v in least.texts().items()}
        if not samples:
            return None
        apart = {k: v[::CALIBRATE] if len(v) >= 2 * CALIBRATE else [] for k, v in samples.items()}
        kept = {k: [t for i, t in enumerate(v) if not apart[k] or i % CALIBRATE] for k, v in samples.items()}
        return calibrate(train(kept), [(k, t) for k in sorted(samples) for t in (apart[k] or samples[k])])

    return None if rows is None else in_task(rows, build)


def predict(text: Column, model: Model | None, spark) -> Column:
    """struct<lang_pred, score, rejected> of a whole text.

    Null texts and texts without a letter are `und` with score 0 and rejected. Without a model every text is.
    A tie goes to the language that comes first in order.
    """
    if model is None:
        return F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample's bounds

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def of(texts: pa.Array) -> pa.Array:
        m, out = shared.value, []
        scorer = held("langid", m, Scorer)
        for part in slices(texts):
            h, chars = scorer.entropies(lowered(part))
            best, score, rejected = judge(m, h, chars)
            lang = [m.langs[b] if c else UNDETERMINED for b, c in zip(best, chars)]
            out.append(pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], ["lang_pred", "score", "rejected"]))
        return pa.concat_arrays(out)

    return of(text)


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of `docs`, by models of `labelled` (text, lang).

    Rows that repeat get equal predictions; an empty table gives no rows; only the text decides.
    """
    return docs.select("doc_id", predict(F.col("text"), fit(labelled), docs.sparkSession).alias("p")).select("doc_id", "p.*")
