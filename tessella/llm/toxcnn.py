"""Operator 10: toxicity by a convolutional network over hashed word embeddings, trained in numpy on all labelled texts, shard by shard."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, WordIndex, cut, doc_sums, held, lowered, release, slices, split_words, trim

DIM, WIDTHS, FILTERS = 8, (1, 2, 3), 8
GRAM = 5
#: Rows of the table of embeddings, in which hashed features share places; its size doesn't follow the corpus.
TABLE = 1 << 16
#: Bytes of text that one task trains on; between rounds the models of all shards are averaged.
SHARD_BYTES = 8 << 20
#: Up to this many labelled ids are broadcast; beyond, texts are shuffled to their labels.
SENT_IDS = 1 << 20
#: Rows of the table that fewer documents reach stay zero.
LEAST_DOCS = 3
#: Passes over a shard in each round.
PASSES = (1, 3, 4, 4)
BATCH, RATE = 32, 0.05
#: Share of words hidden at each step of training, so that one telling word suffices.
HIDDEN = 0.4
#: One in so many labelled texts sets the thresholds and isn't trained on.
CALIBRATE = 5
#: Steps of a logit to one, by which the texts that set thresholds are counted, up to LARGEST.
STEPS, LARGEST = 1024, 64
#: Occurrences from which a word may tell a language.
SEEN = 5
#: Values of a model in a row, when those of all shards are added.
BLOCK = 1 << 16


def features(word: bytes) -> np.ndarray:
    """Hashes of a word and of its 5-grams of bytes between marks."""
    marked = b"<" + word + b">"
    parts = {marked, *(marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1))}
    return np.fromiter(map(xxhash.xxh64_intdigest, sorted(parts)), np.uint64, len(parts))


@dataclass
class Model:
    table: np.ndarray  # (TABLE, DIM)
    filters: list[np.ndarray] = field(default_factory=list)  # (width, DIM, FILTERS)
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    out_bias: float = 0.0
    shift: np.ndarray | None = None  # by language, and last for none: the logit at which a text counts as toxic
    speaks: np.ndarray | None = None  # (TABLE, languages): the log of a hashed word's frequency in each language against the mean, 0 where it is rare

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(TABLE - 1)).astype(np.int64)

    def embed(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros((0, DIM), np.float32)
        own = [features(w) for w in words]
        n = np.fromiter(map(len, own), np.int64, len(own))
        return np.add.reduceat(self.table[self.rows(np.concatenate(own))], np.cumsum(n) - n, axis=0).astype(np.float32)

    def pooled(self, vectors: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest activation of each filter in each document (at least 0), and where it lies (-1: nowhere).

        vectors: of all words in order. Windows that reach past a document's end see zeros there.
        """
        n, docs = len(vectors), len(counts)
        left = np.repeat(np.cumsum(counts), counts) - np.arange(n) if n else np.zeros(0, np.int64)
        top, places = np.zeros((docs, FILTERS * len(WIDTHS)), np.float32), []
        some = counts > 0
        start = (np.cumsum(counts) - counts)[some]
        for i, (w, b) in enumerate(zip(self.filters, self.bias)):
            act = vectors @ w[0] + b
            for j in range(1, len(w)):
                part = vectors[j:] @ w[j]
                part[left[: n - j] <= j] = 0
                act[: n - j] += part
            best = np.maximum.reduceat(act, start, axis=0) if some.any() else np.zeros((0, FILTERS), np.float32)
            top[some, i * FILTERS : (i + 1) * FILTERS] = np.maximum(best, 0)
            places.append(act)
        return top, places

    def kinds(self, words: list[bytes]) -> np.ndarray:
        return self.speaks[word_rows(words)]

    def languages(self, kinds: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The language of each text by what its words' rows of `speaks` add up to: the first at a tie, the number of languages where no word tells."""
        votes = doc_sums(kinds, counts)
        return np.where(votes.any(1), votes.argmax(1) if votes.shape[1] else 0, self.speaks.shape[1])

    def logits(self, vectors: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.pooled(vectors, counts)[0] @ self.out + self.out_bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def word_rows(words: list[bytes]) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) & np.uint64(TABLE - 1)).astype(np.int64)


@dataclass
class Shard:
    """Labelled texts that one task holds, each (id, text) once."""

    number: int
    texts: list[bytes]
    toxic: np.ndarray
    apart: np.ndarray  # of those that set the thresholds
    langs: list[str | None]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """The shards of a partition sorted by shard, h, text and lang (nulls last), so that of repeated rows the least language stays."""

    def made(number: int, rows: list[tuple]) -> Shard:
        h, toxic, apart, texts, langs = zip(*rows)
        return Shard(number, lowered(pa.array(texts, pa.string())), np.array(toxic, np.int64), np.array(apart, bool), list(langs))

    number, rows = None, []
    for b in batches:
        for own, *row in zip(*(b.column(c).to_pylist() for c in ("shard", "h", "toxic", "apart", "text", "lang"))):
            if own != number and rows:
                yield made(number, rows)
                rows = []
            number = own
            if not rows or (rows[-1][0], rows[-1][3]) != (row[0], row[3]):
                rows.append(tuple(row))
    if rows:
        yield made(number, rows)
    trim()


class Words:
    """The words of texts in order (`ids`, `counts` a text) and, for each distinct one, its rows of the table."""

    def __init__(self, texts: list[bytes]):
        words, self.counts = split_words(texts, LETTERS)
        index = WordIndex()
        self.ids = index.numbers(words)
        self.distinct = list(index)
        own = [features(w) for w in self.distinct]
        self.n_own = np.fromiter(map(len, own), np.int64, len(own))
        self.rows = (np.concatenate(own) & np.uint64(TABLE - 1)).astype(np.int64) if own else np.zeros(0, np.int64)
        self.first = np.cumsum(self.n_own) - self.n_own

    def cells(self, which: np.ndarray) -> np.ndarray:
        k = self.n_own[which]
        return self.rows[np.repeat(self.first[which], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]


def counted(shard: Shard, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells and their counts: texts trained on that reach a row of the table, from TABLE on a hashed word's occurrences in each language, below 0 texts by label and use."""
    w = Words(shard.texts)
    doc = np.repeat(np.arange(len(shard.texts)), w.counts)
    pairs = np.unique(doc * len(w.distinct) + w.ids) if len(doc) else np.zeros(0, np.int64)
    doc_of, word = np.divmod(pairs, max(len(w.distinct), 1))
    trained = ~shard.apart[doc_of]
    doc_of, word = doc_of[trained], word[trained]
    reached = np.unique(np.repeat(doc_of, w.n_own[word]) * TABLE + w.cells(word)) % TABLE
    number = {x: i for i, x in enumerate(names)}
    lang = np.repeat(np.array([number.get(x, -1) for x in shard.langs], np.int64), w.counts)
    spoken = word_rows(w.distinct)[w.ids[lang >= 0]] * len(names) + lang[lang >= 0]
    return np.unique(np.concatenate([reached, TABLE + spoken, -1 - (2 * shard.apart + shard.toxic)]), return_counts=True)


class Training:
    """A model and the sums of squared gradients that Adagrad divides by."""

    def __init__(self, known: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.known = known
        m = self.model = Model((rng.normal(0, 0.1, (TABLE, DIM)) * known[:, None]).astype(np.float32))
        m.filters = [rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        m.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        m.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.table_squares = np.full(TABLE, 1e-4, np.float32)
        self.squares = [np.full(x.shape, 1e-4, np.float32) for x in self.dense()]

    def dense(self) -> list[np.ndarray]:
        m = self.model
        return [*m.filters, *m.bias, m.out, np.array([m.out_bias], np.float32)]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.dense(), *self.squares)]).astype(np.float64)

    def set_flat(self, flat: np.ndarray) -> None:
        at, parts = 0, []
        for x in (*self.dense(), *self.squares):
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        m, n = self.model, len(WIDTHS)
        m.filters, m.bias, m.out, m.out_bias = parts[:n], parts[n : 2 * n], parts[2 * n], float(parts[2 * n + 1][0])
        self.squares = parts[2 * n + 2 :]

    def step(self, k: int, value: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.squares[k] += grad * grad
        return value - RATE * grad / np.sqrt(self.squares[k])

    def passes(self, shard: Shard, label_weights: np.ndarray, turn: int) -> np.ndarray:
        """Trains on the shard's texts; what changed, for `averaged`: rows of the table, their squares and whether they were reached, all else weighted by texts, the texts."""
        before, table, table_squares = self.flat(), self.model.table.copy(), self.table_squares.copy()
        w, labels, m, n = Words(shard.texts), shard.toxic, self.model, len(WIDTHS)
        rng = np.random.default_rng([turn, shard.number])
        trained, starts, reached = np.flatnonzero(~shard.apart), np.cumsum(w.counts) - w.counts, np.zeros(TABLE, bool)
        for _ in range(PASSES[turn]):
            for chosen in np.array_split(rng.permutation(trained), max(1, len(trained) // BATCH)):
                c = w.counts[chosen]
                if not c.sum():
                    continue
                mine = w.ids[np.repeat(starts[chosen], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
                which, back = np.unique(mine, return_inverse=True)
                cells, k = w.cells(which), w.n_own[which]
                vec, cell_word = np.add.reduceat(m.table[cells], np.cumsum(k) - k, axis=0), np.repeat(np.arange(len(which)), k)
                seen = rng.random(len(back)) >= HIDDEN
                x = vec[back] * seen[:, None]
                top, acts = m.pooled(x, c)
                err = (_sigmoid(top @ m.out + m.out_bias) - labels[chosen]) * label_weights[labels[chosen]] / len(chosen)
                hidden = np.outer(err, m.out) * (top > 0)
                grad_word = np.zeros_like(vec)
                begin = np.cumsum(c) - c
                for i, (f_i, act) in enumerate(zip(m.filters, acts)):
                    g = hidden[:, i * FILTERS : (i + 1) * FILTERS]
                    d, f = np.nonzero(g)
                    place = np.fromiter((begin[a] + act[begin[a] : begin[a] + c[a], b].argmax() for a, b in zip(d, f)), np.int64, len(d))
                    g, grad_w = g[d, f], np.zeros_like(f_i)
                    for j in range(len(f_i)):
                        ok = place + j < (begin + c)[d]
                        p, gg, ff = place[ok] + j, g[ok], f[ok]
                        np.add.at(grad_w[j].T, ff, gg[:, None] * x[p])
                        np.add.at(grad_word, back[p], gg[:, None] * f_i[j].T[ff] * seen[p][:, None])
                    m.filters[i] = self.step(i, f_i, grad_w)
                    m.bias[i] = self.step(n + i, m.bias[i], np.bincount(f, g, FILTERS).astype(np.float32))
                m.out = self.step(2 * n, m.out, (err @ top).astype(np.float32))
                m.out_bias = float(self.step(2 * n + 1, np.array([m.out_bias], np.float32), np.array([err.sum()], np.float32))[0])
                hit = np.abs(grad_word).sum(1)[cell_word] > 0
                rows, at = np.unique(cells[hit], return_inverse=True)
                grad_row = np.zeros((len(rows), DIM), np.float32)
                np.add.at(grad_row, at, grad_word[cell_word[hit]])
                rows, grad_row = rows[self.known[rows]], grad_row[self.known[rows]]
                self.table_squares[rows] += (grad_row**2).mean(1)
                m.table[rows] -= RATE * grad_row / np.sqrt(self.table_squares[rows])[:, None]
                reached[rows] = True
        change = [(m.table - table).ravel(), self.table_squares - table_squares, reached, (self.flat() - before) * len(trained), [len(trained)]]
        return np.concatenate(change).astype(np.float32)

    def averaged(self, total: np.ndarray) -> None:
        """Takes in the sum of what all shards changed: a row of the table by the mean of the shards that reached it, all else by the mean over texts."""
        rows, squares, reached, dense, texts = np.split(total, np.cumsum([TABLE * DIM, TABLE, TABLE, len(self.flat())]))
        by = np.maximum(reached, 1)
        self.model.table = (self.model.table + rows.reshape(TABLE, DIM) / by[:, None]).astype(np.float32)
        self.table_squares = (self.table_squares + squares / by).astype(np.float32)
        self.set_flat(self.flat() + dense / max(float(texts[0]), 1))


def _added(rows: pa.Table) -> pa.Table:
    """The sum of a block's values over all shards, in their order, so that it doesn't depend on partitions."""
    rows = rows.sort_by("shard")
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in (v.as_py() for v in rows["body"]))
    return pa.table({"block": pa.array(rows["block"][:1].to_pylist(), pa.int32()), "body": pa.array([total.tobytes()], pa.binary())})


def added(rows: DataFrame, of: Callable[[Shard], np.ndarray]) -> np.ndarray:
    """The sum over all shards of the vectors that `of` makes of each, added in tasks block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            v = of(shard).astype(np.float32)
            for i in range(0, len(v), BLOCK):
                yield pa.RecordBatch.from_pydict({"block": pa.array([i // BLOCK], pa.int32()), "shard": pa.array([shard.number], pa.int32()), "body": pa.array([v[i : i + BLOCK].tobytes()], pa.binary())})

    parts = rows.mapInArrow(run, "block int, shard int, body binary").groupBy("block").applyInArrow(_added, "block int, body binary").collect()
    return np.concatenate([np.frombuffer(bytes(r.body), np.float64) for r in sorted(parts, key=lambda r: r.block)])


def cells(rows: DataFrame, of: Callable[[Shard], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Cells and their counts over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            cell, n = of(shard)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

    got = rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().sort_by("cell")
    return got["cell"].to_numpy(), got["n"].to_numpy()


def telling(n: np.ndarray) -> np.ndarray:
    """Model.speaks from the occurrences of hashed words (rows) in texts of each language (columns)."""
    share = np.log((n + 0.5) / (n.sum(0) + 1))
    return np.where((n.sum(1) >= SEEN)[:, None], share - share.mean(1, keepdims=True), 0).astype(np.float32) if n.shape[1] else np.zeros(n.shape, np.float32)


def judged(shard: Shard, model: Model, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Cells of language, label and logit in STEPS, and how many of the texts that set thresholds fall there."""
    chosen, found = np.arange(len(shard.texts)) if every else np.flatnonzero(shard.apart), []
    scorer = Scorer(model)
    for part in np.array_split(chosen, max(1, len(chosen) // 200)):
        logit, lang = scorer.judged([shard.texts[i] for i in part])
        place = np.clip(np.rint(logit * STEPS), -LARGEST * STEPS, LARGEST * STEPS).astype(np.int64) + LARGEST * STEPS
        found.append((lang * 2 + shard.toxic[part]) * (2 * LARGEST * STEPS + 1) + place)
    return np.unique(np.concatenate(found), return_counts=True)


def thresholds(logit: np.ndarray, labels: np.ndarray, weights: np.ndarray, lang: np.ndarray, langs: int) -> np.ndarray:
    """By language the logit with the fewest weighted errors, in the middle of the widest gap that has them; languages with under 10 texts (by weight) of a label share the common one."""

    def best(which: np.ndarray) -> float:
        order = np.argsort(logit[which])
        x, y, w = logit[which][order], labels[which][order], weights[which][order]
        if not len(x):
            return 0.0
        wrong = np.concatenate([[0], np.cumsum(w * (y == 1))]) + np.concatenate([np.cumsum((w * (y == 0))[::-1])[::-1], [0]])
        edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
        low = np.flatnonzero(wrong <= wrong.min() + 1e-9)
        gap = np.concatenate([[0], x[1:] - x[:-1], [0]])
        return float(edges[low[gap[low].argmax()]])

    everything = best(np.arange(len(logit)))
    own = [np.flatnonzero(lang == k) for k in range(langs)]
    return np.array([best(w) if min(weights[w] @ (labels[w] == 1), weights[w] @ (labels[w] == 0)) >= 10 else everything for w in own])


class Scorer:
    def __init__(self, model: Model):
        self.model, self.index = model, WordIndex()
        self.vectors, self.kinds = np.zeros((0, DIM), np.float32), model.kinds([])

    def judged(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Logit and language of each text."""
        if (kept := self.index.shrunk()) is not None:
            self.vectors, self.kinds = self.vectors[kept], self.kinds[kept]
        m = self.model
        words, counts = split_words(texts, LETTERS)
        at = self.index.numbers(words)
        if new := self.index.new:
            self.vectors = np.concatenate([self.vectors, m.embed(new)])
            self.kinds = np.concatenate([self.kinds, m.kinds(new)])
            self.index.new = []
        return m.logits(self.vectors[at], counts), m.languages(self.kinds[at], counts)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        logit, lang = self.judged(texts)
        return _sigmoid(logit - self.model.shift[lang]).astype(np.float64)


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of the texts of `docs` that `labels` (doc_id, toxic) marks 0 or 1; None unless both occur.

    Labels whose row repeats count once; ids with contradicting labels, null ids, null labels and null or empty texts are left out. Every
    other labelled text is used, whole: four in five are trained on, each fifth by hash sets the thresholds (all do, where
    there are under 10 of a label). Counts are of all texts. Shards of some SHARD_BYTES, by hash of id and text, are trained on
    in tasks, and their models averaged after each round. Where `docs` has a column lang, words learn from it which language they tell.
    """
    spark = docs.sparkSession
    one = cut(labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").select("doc_id", F.col("toxic").cast("int").alias("toxic")))
    one = F.broadcast(one) if one.count() <= SENT_IDS else one
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", lang.alias("lang")).where("text <> ''").join(one, "doc_id")
    sizes = rows.groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()
    if len(sizes) < 2:
        return None
    n = -(-sum(r.bytes for r in sizes) // SHARD_BYTES)
    rows = rows.select(F.xxhash64(F.col("doc_id").cast("long"), "text", F.lit(23)).alias("h"), "toxic", "text", "lang")
    rows = rows.withColumns({"shard": F.pmod("h", F.lit(n)).cast("int"), "apart": F.pmod(F.xxhash64("h", F.lit(31)), F.lit(CALIBRATE)) == CALIBRATE - 1})
    rows = cut(rows.repartitionByRange(n, "shard").sortWithinPartitions("shard", "h", "text", F.col("lang").asc_nulls_last()))
    release(spark)
    names = sorted(r.lang for r in rows.select("lang").where("lang is not null").distinct().collect())
    cell, count = cells(rows, lambda shard: counted(shard, names))
    reached, spoken, used = np.zeros(TABLE, np.int64), np.zeros(TABLE * len(names)), np.zeros(4)  # used: trained on, by label, and apart
    own, words = (cell >= 0) & (cell < TABLE), cell >= TABLE
    reached[cell[own]], spoken[cell[words] - TABLE], used[-1 - cell[cell < 0]] = count[own], count[words], count[cell < 0]
    training, label_weights = Training(reached >= LEAST_DOCS), used[:2].sum() / 2 / np.maximum(used[:2], 1)
    for turn in range(len(PASSES)):
        shared = spark.sparkContext.broadcast(training)
        training.averaged(added(rows, lambda shard: copy.deepcopy(shared.value).passes(shard, label_weights, turn)))
        shared.destroy()
        release(spark)
    m, width = training.model, 2 * LARGEST * STEPS + 1
    m.speaks = telling(spoken.reshape(TABLE, len(names)))
    every, shared = used[2:].min() < 10, spark.sparkContext.broadcast(m)
    cell, count = cells(rows, lambda shard: judged(shard, shared.value, every))
    shared.destroy()
    kind, place = np.divmod(cell, width)
    m.shift = thresholds(place / STEPS - LARGEST, kind % 2, count.astype(np.float64), kind // 2, len(names) + 1)
    return m


def score(text: Column, model: Model | None, spark) -> Column:
    """Toxicity from 0 to 1 of a whole text; 0.5 is the calibrated threshold of the text's language. Null is empty; without a model 0."""
    if model is None:
        return F.lit(0.0)
    shared = spark.sparkContext.broadcast(model)  # of a size that doesn't follow the corpus

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        scorer = held("toxcnn", shared.value, Scorer)
        return pa.array(np.concatenate([scorer.scores(lowered(p)) for p in slices(texts)]))

    return of(text)


def toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted for every row of `docs`; only the text decides. An empty table gives no rows."""
    scored = docs.select("doc_id", score(F.col("text"), model, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
