"""Operator 7: masked pseudo-likelihood of documents under a bidirectional window network trained in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, WordIndex, cut, doc_sums, held, lowered, slices, split_words, trim

CLASSES, MEMBERS = 32, 32
#: Tokens of the network: the most frequent words of the corpus; the commonest endings of all other words, and one for the rest of endings.
ENDINGS = 64
FREQUENT = CLASSES * MEMBERS - ENDINGS
#: So many of the most frequent words have their counts in every worker; the counts of all others are joined.
KNOWN = 50_000
#: Logarithms add up as whole numbers of this part, so that the order of sums doesn't matter.
PART = 1 << 20
#: Characters that spell a word which no other document has: any of so many, or the end.
LETTERS = 40
SPAN = (-2, -1, 1, 2)
DIM = 16
STEP, RATE = 8192, 0.05
#: Words of a fold, which one network runs through; one of so many folds comes first, to give all others a common start.
FOLD, FIRST = 1 << 20, 8
#: Folds get a task each up to TASKS of them, beyond that a task has up to TASK_FOLDS and hands on one sum.
TASKS, TASK_FOLDS = 64, 8
FLUSH = 300_000
BLOCK = 1024


@dataclass
class Network:
    """Every token from its neighbours: their embeddings by place add up under a tanh, then a class and a member of it are predicted.

    Two softmaxes of 32 make an exactly normalised distribution over the 1024 tokens: frequent words, and the endings of all others.
    """

    context: np.ndarray  # (places, tokens + 1, DIM); the last token lies beyond a document's ends
    classes: np.ndarray  # (DIM, CLASSES)
    class_bias: np.ndarray
    members: np.ndarray  # (CLASSES, DIM, MEMBERS)
    member_bias: np.ndarray  # (CLASSES, MEMBERS)

    @staticmethod
    def shapes() -> list[tuple[int, ...]]:
        n = CLASSES * MEMBERS
        return [(len(SPAN), n + 1, DIM), (DIM, CLASSES), (CLASSES,), (CLASSES, DIM, MEMBERS), (CLASSES, MEMBERS)]

    @classmethod
    def from_flat(cls, flat: np.ndarray) -> Network:
        parts, at = [], 0
        for shape in cls.shapes():
            size = int(np.prod(shape))
            parts.append(flat[at : at + size].reshape(shape).astype(np.float32))
            at += size
        return cls(*parts)

    @classmethod
    def fresh(cls, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        return cls.from_flat(np.concatenate([rng.normal(0, 0.1, int(np.prod(s))) for s in cls.shapes()]))

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.classes, self.class_bias, self.members, self.member_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def forward(self, around: list[np.ndarray], token: np.ndarray, grads: list[np.ndarray] | None = None) -> np.ndarray:
        """log p of each token given its neighbours; adds the gradients of the mean negative log p to `grads`."""
        hidden = np.tanh(sum(c[a] for c, a in zip(self.context, around)))
        kind, member = np.divmod(token, MEMBERS)
        rows = np.arange(len(token))
        p = _softmax(hidden @ self.classes + self.class_bias)
        log_p = np.log(p[rows, kind])
        order = np.argsort(kind.astype(np.int16), kind="stable")
        ends = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        back = None
        if grads is not None:
            p[rows, kind] -= 1
            p /= len(token)
            grads[1] += hidden.T @ p
            grads[2] += p.sum(0)
            back = p @ self.classes.T
        for k in range(CLASSES):
            mine = order[ends[k] : ends[k + 1]]
            if not len(mine):
                continue
            h = hidden[mine]
            q = _softmax(h @ self.members[k] + self.member_bias[k])
            at = np.arange(len(mine))
            log_p[mine] += np.log(q[at, member[mine]])
            if grads is not None:
                q[at, member[mine]] -= 1
                q /= len(token)
                grads[3][k] += h.T @ q
                grads[4][k] += q.sum(0)
                back[mine] += q @ self.members[k].T
        if grads is not None:
            back *= 1 - hidden * hidden
            for i, a in enumerate(around):
                order = np.argsort(a.astype(np.int16), kind="stable")
                first = np.flatnonzero(np.diff(a[order], prepend=-1))
                grads[0][i, a[order[first]]] += np.add.reduceat(back[order], first, axis=0)
        return log_p


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(np.clip(x, -60, 60))  # in range for 32-bit floats, and quicker than each row's maximum
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    return np.maximum(x, 1e-12)


def ending(word: bytes) -> bytes:
    return word[-2:]


def spelled(word: bytes) -> float:
    """Log of the chance that a word is made letter by letter."""
    return -(len(word) + 1) * float(np.log(LETTERS))


def name_of(word: bytes) -> int:
    """What Spark's xxhash64 gives for the word."""
    return xxhash.xxh64_intdigest(word, 42)


@dataclass
class Words:
    """What workers know of words: the frequent ones, the commonest endings of others, log counts of each ending's words, name (hash) and count of the KNOWN ones."""

    frequent: list[bytes]
    endings: list[bytes]
    masses: np.ndarray
    names: np.ndarray
    counts: np.ndarray
    first: int  # the number of the first ending


class Tokens:
    """Numbers of words. A frequent word is a token; of others the ending is, and the word has its share of what all words of that ending occur.

    `rare` marks the others, `counts` has how often each occurs in the corpus (0: not known here), `spelling` the log of its chance letter by letter.
    """

    FIELDS = ("numbers", "rare", "counts", "spelling", "names")

    def __init__(self, words: Words):
        self.words, self.own, self.index = words, {w: i for i, w in enumerate(words.frequent)}, WordIndex()
        self.kind = {e: words.first + i for i, e in enumerate(words.endings)}
        self.numbers, self.rare, self.counts, self.spelling, self.names = np.zeros(0, np.int16), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def at(self, words: list[bytes]) -> np.ndarray:
        if (kept := self.index.shrunk()) is not None:
            for field in self.FIELDS:
                setattr(self, field, getattr(self, field)[kept])
        at = self.index.numbers(words)
        if new := self.index.new:
            known, size, last = self.words, len(new), self.words.first + ENDINGS - 1
            rare = np.fromiter((w not in self.own for w in new), bool, size)
            number = np.fromiter((self.own[w] if w in self.own else self.kind.get(ending(w), last) for w in new), np.int16, size)
            name = np.fromiter(map(name_of, new), np.uint64, size).view(np.int64)
            place = np.minimum(np.searchsorted(known.names, name), max(len(known.names) - 1, 0))
            count = np.where(known.names[place] == name, known.counts[place], 0) if len(known.names) else np.zeros(size, np.int64)
            spelling = np.fromiter(map(spelled, new), np.float64, size)
            for field, values in zip(self.FIELDS, (number, rare, count, spelling, name)):
                setattr(self, field, np.concatenate([getattr(self, field), values]))
            self.index.new = []
        return at


def neighbours(tokens: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """For each place in SPAN the token there, or the one beyond the ends."""
    n, edge = len(tokens), CLASSES * MEMBERS
    first = np.repeat(np.cumsum(counts) - counts, counts)
    last = np.repeat(np.cumsum(counts), counts)
    out = []
    for s in SPAN:
        at = np.arange(n) + s
        inside = (at >= first) & (at < last)
        out.append(np.where(inside, tokens[np.clip(at, 0, max(n - 1, 0))], edge) if n else tokens)
    return out


def vocabulary(docs: DataFrame) -> tuple[Words, DataFrame]:
    """What workers know of words, and (name, n, spelling) of every word of all documents. Each task adds its words up first.

    The most frequent words and endings come first; ties go to the lesser one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            total.update(split_words(lowered(b.column(0)), ALNUM)[0])
            if len(total) > FLUSH:
                yield rows()
                total.clear()
        yield rows()
        total.clear()
        trim()

    counted = cut(docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    top = counted.orderBy(F.desc("n"), "word").limit(KNOWN).select("word", "n").toArrow()
    words, n = [bytes(w) for w in top["word"].to_pylist()], np.array(top["n"].to_pylist(), np.int64)
    frequent = words[:FREQUENT]
    tail = F.expr("substr(word, -2, 2)")
    ends = Counter({bytes(r.tail): r.n for r in counted.groupBy(tail.alias("tail")).agg(F.sum("n").alias("n")).collect()})  # pairs of bytes at most
    for w, k in zip(frequent, n[:FREQUENT].tolist()):
        ends[ending(w)] -= k
    endings = sorted((e for e in ends if ends[e] > 0), key=lambda e: (-ends[e], e))[: ENDINGS - 1]
    masses = np.array([*(ends[e] for e in endings), *[0] * (ENDINGS - 1 - len(endings)), sum(ends[e] for e in ends if e not in endings)], np.float64)
    names = np.array([name_of(w) for w in words], np.uint64).view(np.int64)
    order = np.argsort(names)
    letters = -(F.octet_length("word") + 1) * F.log(F.lit(float(LETTERS)))
    return Words(frequent, endings, np.log(masses + 1), names[order], n[order], FREQUENT), counted.select(F.xxhash64("word").alias("name"), "n", letters.alias("spelling"))


def share(count: np.ndarray, times: np.ndarray, spelling: np.ndarray) -> np.ndarray:
    """Log of what a word weighs among those of its ending: how often other documents have it, plus the chance of its letters."""
    return np.log(np.maximum(count - times, 0) + np.exp(spelling))


def numbered(docs: DataFrame, known: Words) -> DataFrame:
    """doc_id, n_tokens, ids (16-bit tokens of the whole text), fixed (log of the known words' shares, in PARTs), names and times of words whose count is to be joined."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # of fixed size

    @F.arrow_udf("n_tokens long, ids binary, fixed long, names array<long>, times array<long>")
    def of(texts: pa.Array) -> pa.Array:
        tokens, out = held("pseudolm", shared.value, Tokens), []
        mass = shared.value.masses
        for part in slices(texts):
            words, counts = split_words(lowered(part), ALNUM)
            at = tokens.at(words)
            ids = tokens.numbers[at]
            doc = np.repeat(np.arange(len(counts)), counts)
            pick = np.flatnonzero(tokens.rare[at])
            pair, times = np.unique(doc[pick] * (len(tokens.numbers) + 1) + at[pick], return_counts=True)
            doc, word = np.divmod(pair, len(tokens.numbers) + 1)
            n = tokens.counts[word]
            log = np.where(n > 0, share(n, times, tokens.spelling[word]), 0) - mass[tokens.numbers[word].astype(np.int64) - shared.value.first]
            fixed = np.zeros(len(counts), np.int64)
            np.add.at(fixed, doc, np.round(times * log * PART).astype(np.int64))
            left = n == 0
            ends = pa.array(np.searchsorted(doc[left], np.arange(len(counts) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (tokens.names[word[left]], times[left])]
            starts = np.concatenate([[0], np.cumsum(counts)])
            raw = [ids[a:b].tobytes() for a, b in zip(starts, starts[1:])]
            out.append(pa.StructArray.from_arrays([pa.array(counts), pa.array(raw, pa.binary()), pa.array(fixed), *lists], ["n_tokens", "ids", "fixed", "names", "times"]))
        return pa.concat_arrays(out)

    return docs.select("doc_id", F.xxhash64("doc_id", F.xxhash64("text")).alias("deal"), of("text").alias("s")).select("doc_id", "deal", "s.*")


def _tokens(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = ids.to_pylist()
    return np.frombuffer(b"".join(raw), np.int16).astype(np.int64), np.fromiter(map(len, raw), np.int64, len(raw)) // 2


class Run:
    """A network on its way through the documents of a fold, in steps of STEP words that don't depend on how rows arrive."""

    def __init__(self, start: Network, squares: list[np.ndarray]):
        self.net, self.squares = Network(*(p.copy() for p in start.parts())), [s.copy() for s in squares]
        self.waiting, self.size, self.seen = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.size += len(ids)
        if self.size >= STEP:
            self.learn()

    def learn(self) -> None:
        if self.size:
            ids, counts = np.concatenate(self.waiting), np.fromiter(map(len, self.waiting), np.int64, len(self.waiting))
            around = neighbours(ids, counts)
            for i in range(0, len(ids), STEP):
                grads = [np.zeros(s, np.float32) for s in Network.shapes()]
                self.net.forward([a[i : i + STEP] for a in around], ids[i : i + STEP], grads)
                for value, g, s in zip(self.net.parts(), grads, self.squares):
                    s += g * g
                    value -= RATE * g / np.sqrt(s)
            self.seen += self.size
            self.waiting, self.size = [], 0

    def weighed(self) -> np.ndarray:
        """All values and squares as whole numbers, times the words seen; sums of these are exact in any order."""
        self.learn()
        flat = np.concatenate([self.net.flat(), *(s.ravel() for s in self.squares)]).astype(np.float64)
        return np.append(np.round(flat * (self.seen << 10)).astype(np.int64), self.seen)


def trained(rows: DataFrame, folds: int, net: Network, squares: list[np.ndarray]) -> tuple[Network, list[np.ndarray]]:
    """One network for each fold of `rows` (deal, ids), all from the same start, and their mean by words, likewise of the squares.

    A row's hash decides its fold and place in it, so the result doesn't depend on how rows are dealt to tasks. A task adds up
    its networks as whole numbers, block by block they are added up over tasks, and one sum comes to the driver.
    """
    shared = rows.sparkSession.sparkContext.broadcast((net, squares))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, own, total = None, None, 0
        for b in batches:
            ids, counts = _tokens(b.column(1))
            starts = np.concatenate([[0], np.cumsum(counts)])
            for f, x, y in zip(b.column(0).to_pylist(), starts, starts[1:]):
                if f != fold:
                    total, own, fold = total + own.weighed() if own else 0, Run(*shared.value), f
                own.add(ids[x:y])
        if own:
            total = total + own.weighed()
            parts = [total[i : i + BLOCK] for i in range(0, len(total), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.int64()))], names=["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, sums in zip(b.column(0).to_pylist(), b.column(1)):
                total[block] = total.get(block, 0) + sums.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array(list(total.values()), pa.list_(pa.int64()))], names=["block", "sums"])

    dealt = rows.select(F.pmod("deal", F.lit(folds)).alias("fold"), "ids", "deal").repartitionByRange(min(folds, max(TASKS, folds // TASK_FOLDS)), "fold").sortWithinPartitions("fold", "deal", "ids")
    sums = dealt.select("fold", "ids").mapInArrow(run, "block int, sums array<bigint>").repartition(-(-2 * len(net.flat()) // BLOCK), "block").mapInArrow(add, "block int, sums array<bigint>")
    flat = [np.array(r.sums, np.int64) for r in sorted(sums.collect(), key=lambda r: r.block)]
    if not flat:
        return net, squares
    flat = np.concatenate(flat)
    mean = flat[:-1] / (float(flat[-1]) * 1024)
    size = len(net.flat())
    return Network.from_flat(mean[:size]), Network.from_flat(mean[size:]).parts()


def fit(rows: DataFrame) -> Network:
    """Trains on every word of every row: first over one of FIRST folds, then over all from the mean of those."""
    some = rows.where("n_tokens > 0")
    words = some.agg(F.sum("n_tokens").alias("n")).first().n or 0
    net, squares = Network.fresh(), [np.full(s, 1e-6, np.float32) for s in Network.shapes()]
    apart = F.pmod(F.xxhash64("deal"), F.lit(FIRST)) == 0
    for part, n in ((some.where(apart), -(-words // FIRST)), (some, words)):
        net, squares = trained(part, max(1, -(-n // FOLD)), net, squares)
    return net


def log_likelihood(ids: Column, net: Network, spark) -> Column:
    """Sum of the log of the network's probability of each token given its neighbours, in PARTs."""
    shared = spark.sparkContext.broadcast(net)  # of fixed size

    @F.arrow_udf("long")
    def of(rows: pa.Array) -> pa.Array:
        net = shared.value
        tokens, counts = _tokens(rows)
        around = neighbours(tokens, counts)
        log_p = np.concatenate([net.forward([a[i : i + STEP] for a in around], tokens[i : i + STEP]) for i in range(0, len(tokens), STEP)] or [np.zeros(0, np.float32)])
        # To a 16384th each, so that texts score alike wherever they stand.
        return pa.array(doc_sums(np.round(log_p.astype(np.float64) * (1 << 14)), counts).astype(np.int64) * (PART >> 14))

    return of(ids)


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, pll, mean_pll of every row, under a network trained on all of `docs`.

    Words (lower case) are runs of ASCII letters and digits and of everything beyond ASCII. The network predicts every word from
    both sides: a frequent one itself, of any other its ending. Such a word has, of what its ending gets, a share by how often the
    other documents have it (the document's own occurrences are masked as well), and by its letters if none has. Counts cover all
    of `docs`, grow with it and are joined, but for the most frequent. Null, empty and wordless texts have 0 tokens, pll 0.0
    and a null mean. Equal texts score alike; rows that repeat count each. An empty table gives no rows. Other columns are ignored.
    """
    known, counts = vocabulary(docs)
    rows = cut(numbered(docs, known).withColumn("row", F.monotonically_increasing_id()))  # fixed once written
    net = fit(rows)
    rare = rows.select("row", F.explode(F.arrays_zip("names", "times")).alias("w")).select("row", F.col("w.names").alias("name"), F.col("w.times").alias("times"))
    weight = F.log(F.greatest(F.col("n") - F.col("times"), F.lit(0)) + F.exp("spelling"))
    added = rare.join(counts, "name").groupBy("row").agg(F.sum(F.round(F.col("times") * weight * PART).cast("long")).alias("added"))
    scored = rows.select("row", "doc_id", "n_tokens", (log_likelihood(F.col("ids"), net, docs.sparkSession) + F.col("fixed")).alias("own")).join(added, "row", "left")
    scored = scored.select("doc_id", "n_tokens", ((F.col("own") + F.coalesce("added", F.lit(0))) / PART).alias("pll"))
    return scored.withColumn("mean_pll", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")))
