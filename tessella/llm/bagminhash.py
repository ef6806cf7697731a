"""Operator 3: near-duplicate classes by BagMinHash signatures, banding and exact multiset overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, WordIndex, cut, held, lowered, release, slices, split_words

SHINGLE = 5
SIMILARITY = 0.8
#: 25 bands of 5 rows: two bags of similarity 0.8 share no band with a chance of 5e-5.
BANDS, ROWS = 25, 5
#: Pairs whose signatures agree on fewer components than this aren't verified: 4 deviations below 0.8.
LEAST_AGREE = int(BANDS * ROWS * (SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / (BANDS * ROWS)) ** 0.5))
#: In buckets of up to this many texts all are compared with each other; larger ones go by heads.
SMALL = 4
#: Rounds of one head a large bucket, each over the buckets that still hold several classes.
ROUNDS = 2
#: Texts and bytes of text in a block of the exact comparison that settles what is open after those rounds.
BLOCK_TEXTS, BLOCK_BYTES = 512, 2 << 20
#: Open buckets that hang together and have up to this many texts are compared as one, larger ones bucket by bucket.
CHAINED = 8192
#: Shingles that are looked at together.
STRIP = 4096
#: How strongly heads after the first prefer texts that share large buckets.
CENTRAL_POWER = 4

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def bags(word_hash: np.ndarray, counts: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, multiplicity) of all shingles; a document of fewer than k words, but not none, has one of all its words."""
    n = len(word_hash)
    start = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts)), counts)
    width = np.minimum(counts, k)[doc]
    last = (start + counts)[doc]
    at = np.arange(n)
    ok = at + width <= last
    at, doc, width = at[ok], doc[ok], width[ok]
    h = mix(width.astype(np.uint64))
    for j in range(k):
        in_it = j < width
        w = word_hash[np.minimum(at + j, n - 1)] if n else word_hash
        h = np.where(in_it, mix(h ^ w), h)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, m: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash: an array (docs, m) of hashes; two bags agree in a component with a chance of their weighted Jaccard.

    The weight axis is discretised into units, gathered into intervals (0,1], (1,2], (2,4], (4,8] and so on.
    Every (shingle, interval) has a Poisson process of its own, of a rate in proportion to the interval's
    length; a point has a time, a place on the interval and a component. A bag of weight w keeps the
    points at places of up to w: those in whole intervals at once, in the last by halving down to the
    place's unit. The component takes the least time. A process ends at a time past the document's
    largest component, which no later point can lower.
    """
    best = np.full((docs, m), np.inf)
    name = np.zeros((docs, m), np.uint64)
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    d = np.repeat(doc, levels)
    w = np.repeat(weight, levels)
    level = np.arange(len(d)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    length = np.maximum(low, 1)
    state = mix(np.repeat(shingle, levels) ^ mix(level.astype(np.uint64)))
    time = np.zeros(len(d))
    flat_best, flat_name = best.reshape(-1), name.reshape(-1)
    while len(d):
        state = mix(state)
        u = ((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(u) / length
        state = mix(state)
        comp = ((state >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        place = low + 1 + ((state & np.uint64(0xFFFFFFFF)) * length.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        keep = place <= w
        slot, t, s = (d * m + comp)[keep], time[keep], state[keep]
        np.minimum.at(flat_best, slot, t)
        won = flat_best[slot] == t
        flat_name[slot[won]] = s[won]
        docs_left, back = np.unique(d, return_inverse=True)
        go = time < best[docs_left].max(1)[back]
        d, w, low, length, state, time = (x[go] for x in (d, w, low, length, state, time))
    return name


class Hasher:
    """Stable 64-bit hashes of words, each computed once."""

    def __init__(self):
        self.index, self.values = WordIndex(), np.zeros(0, np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        if (kept := self.index.shrunk()) is not None:
            self.values = self.values[kept]
        at = self.index.numbers(words)
        if self.index.new:
            self.values = np.concatenate([self.values, np.fromiter(map(xxhash.xxh64_intdigest, self.index.new), np.uint64, len(self.index.new))])
            self.index.new = []
        return self.values[at]


def text_bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words, counts = split_words(lowered(texts), ALNUM)
    return (*bags(held("words", "shingles", lambda _: Hasher()).of(words), counts), counts)


def _sketch_slice(texts: pa.Array) -> pa.Array:
    doc, shingle, weight, counts = text_bags(texts)
    n = len(counts)
    sig = signatures(doc, shingle, weight, n)
    bag = np.zeros(n, np.uint64)
    np.add.at(bag, doc, mix(shingle ^ mix(weight.astype(np.uint64))))
    h = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64)), (n, BANDS)).copy()
    for r in range(ROWS):
        h = mix(h ^ sig[:, r::ROWS])
    bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(h.reshape(-1).view(np.int64)))
    low = (sig & np.uint64(0xFF)).astype(np.uint8)
    return pa.StructArray.from_arrays(
        [pa.array(counts), pa.array(bag.view(np.int64)), bands, pa.array([x.tobytes() for x in low], pa.binary())], ["n_words", "bag_hash", "bands", "sig"]
    )


def sketch(text: Column) -> Column:
    """struct<n_words, bag_hash, bands, sig> of a text: the hash of its multiset, its band keys, its signature's low bytes."""

    @F.arrow_udf("n_words long, bag_hash long, bands array<bigint>, sig binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([_sketch_slice(x) for x in slices(texts)])

    return of(text)


def agreement(a: Column, b: Column) -> Column:
    """Components in which two signatures agree."""

    @F.arrow_udf("int")
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        one, other = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(len(v), BANDS * ROWS) for v in (x, y))
        return pa.array((one == other).sum(1).astype(np.int32))

    return of(a, b)


def similarity(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Exact weighted Jaccard of the bags of texts pair by pair; 0 where neither has words."""
    n = len(left)
    doc, shingle, weight, _ = text_bags(pa.concat_arrays([left.cast(pa.string()), right.cast(pa.string())]))
    pair = doc % max(n, 1)
    order = np.lexsort((shingle, pair))
    p, s, w = pair[order], shingle[order], weight[order]
    same = np.flatnonzero((p[1:] == p[:-1]) & (s[1:] == s[:-1]))
    common = np.bincount(p[same], np.minimum(w[same], w[same + 1]), n)
    total = np.bincount(p, w, n)
    return np.divide(common, total - common, out=np.zeros(n), where=total > common)


def overlap(a: Column, b: Column) -> Column:
    @F.arrow_udf("double")
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        at, parts = 0, []
        for part in slices(x):
            parts.append(similarity(part, y.slice(at, len(part))))
            at += len(part)
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return of(a, b)


def components(links: DataFrame) -> DataFrame:
    """id, root: the least id of the component of each end of `links` (a, b). Labels spread along links and then along labels until none changes.

    Rounds of joins over checkpointed tables; nothing but whether a label changed comes to the driver.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "root", F.lit(None).cast("long").alias("own"))
        spread = near.union(labels.select("id", "root", F.col("root").alias("own"))).groupBy("id").agg(F.min("root").alias("to"), F.max("own").alias("was"))
        jump = labels.select(F.col("id").alias("to"), F.col("root").alias("far"))
        new = cut(spread.join(jump, "to").select("id", F.least("to", "far").alias("root"), "was"))
        labels = new.select("id", "root")
        if new.where("root <> was").isEmpty():
            return labels


def relabelled(labels: DataFrame, fresh: DataFrame) -> DataFrame:
    """Labels (id, root) after new links between ids: the roots that the links tie together are merged."""
    of = lambda x: labels.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}"))
    ties = cut(fresh.join(of("a"), "a").join(of("b"), "b").where("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
    if ties.isEmpty():
        return labels
    merged = components(ties).select(F.col("id").alias("root"), F.col("root").alias("to"))
    return cut(labels.join(merged, "root", "left").select("id", F.coalesce("to", "root").alias("root")))


def _within(small: DataFrame) -> DataFrame:
    """Pairs a < b of the texts of buckets that hold SMALL texts at most."""
    held_ = small.groupBy("band", "key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    pairs = F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, SMALL), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return held_.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def _stars(rows: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """In each bucket of several classes, every text against the bucket's head only: pairs a < b of texts not yet in one class."""
    heads = (
        rows.groupBy(*keys).agg(F.min_by(F.struct("id", "root"), rank).alias("head"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        .where("lo <> hi").drop("lo", "hi")
    )
    met = rows.select("id", "root", *keys).join(heads, keys).where("root <> head.root")
    return met.select(F.least(F.col("id"), F.col("head.id")).alias("a"), F.greatest(F.col("id"), F.col("head.id")).alias("b")).distinct()


def _linked(rows: pa.Table) -> pa.Table:
    """Links a < b between two blocks of texts, or within one: of all pairs of SIMILARITY or more, those that tie classes not yet tied by another.

    A bag is the set of its (shingle, number of the copy), so common shingles are a product of matrices.
    """
    ids, roots, own = (rows[c].to_numpy() for c in ("id", "root", "own"))
    left, right = np.flatnonzero(own == rows["i"][0].as_py()), np.flatnonzero(own == rows["j"][0].as_py())
    apart = rows["i"][0].as_py() != rows["j"][0].as_py()
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not len(left) or not len(right) or (roots == roots[0]).all():
        return none
    at, parts = 0, []
    for part in slices(rows["text"].combine_chunks()):
        doc, shingle, weight, _ = text_bags(part)
        parts.append((doc + at, shingle, weight))
        at += len(part)
    doc, shingle, weight = (np.concatenate(x) for x in zip(*parts))
    copy = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    doc, shingle = np.repeat(doc, weight), np.repeat(shingle, weight)
    shingle = np.where(copy > 0, mix(shingle ^ mix(copy.astype(np.uint64))), shingle)
    total = np.bincount(doc, minlength=len(ids))
    name, shingle = np.unique(shingle, return_inverse=True)
    in_left, in_right = (np.bincount(shingle[own[doc] == own[side[0]]], minlength=len(name)) for side in (left, right))
    shared = (in_left > 0) & (in_right > 0) if apart else in_left > 1
    use = shared[shingle]
    doc, shingle = doc[use], (np.cumsum(shared) - 1)[shingle[use]]
    order = np.argsort(shingle, kind="stable")
    doc, shingle = doc[order], shingle[order]
    place = np.zeros(len(ids), np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.float32)  # whole numbers, exact up to 2^24
    for low in range(0, int(shared.sum()), STRIP):
        ends = np.searchsorted(shingle, [low, low + STRIP])
        d, k = doc[ends[0] : ends[1]], shingle[ends[0] : ends[1]] - low
        x, y = np.zeros((len(left), STRIP), np.float32), np.zeros((len(right), STRIP), np.float32)
        for m, side in ((x, left), (y, right)):
            mine = own[d] == own[side[0]]
            m[place[d[mine]], k[mine]] = 1
        common += x @ y.T
    common = common.astype(np.float64)
    near = common / np.maximum(total[left][:, None] + total[right][None, :] - common, 1) >= SIMILARITY
    near &= roots[left][:, None] != roots[right][None, :]
    one, two = np.nonzero(near if apart else np.triu(near, 1))
    one, two = left[one], right[two]
    parent: dict[int, int] = {}

    def root(r: int) -> int:
        while (up := parent.get(r, r)) != r:
            parent[r] = parent.get(up, up)
            r = up
        return r

    kept = []
    for n, (r, t) in enumerate(zip(roots[one].tolist(), roots[two].tolist())):
        r, t = root(r), root(t)
        if r != t:
            parent[max(r, t)] = min(r, t)
            kept.append(n)
    x, y = ids[one[kept]], ids[two[kept]]
    return pa.table({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64())})


def _unfolded(bucketed: DataFrame, labels: DataFrame) -> DataFrame:
    """id, root, band, key of the texts' large buckets. A text meets its label once, not once a bucket."""
    return cut(bucketed.join(labels, "id").withColumn("bucket", F.explode("buckets")).select("*", "bucket.*").drop("buckets", "bucket"))


def _settled(rows: DataFrame, stock: DataFrame) -> DataFrame | None:
    """Links between the classes of every bucket in `rows` that holds several: all its texts against all, block by block.

    Rows grow with a bucket's texts times its blocks, not its pairs; a block pair returns a link a class at most.
    """
    several = rows.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").drop("hi")
    open_ = cut(rows.select("id", "root", "band", "key").join(several, ["band", "key"]))
    if open_.isEmpty():
        return None
    chain = components(open_.where("root <> lo").select(F.col("root").alias("a"), F.col("lo").alias("b")).distinct()).select(F.col("id").alias("root"), F.col("root").alias("chain"))
    chained = open_.select("id", "root").distinct().join(chain, "root").groupBy("chain").agg(F.count("*").alias("n"))
    unit = F.when(F.col("n") <= CHAINED, F.xxhash64("chain")).otherwise(F.xxhash64("band", "key"))
    member = open_.join(chain.join(chained, "chain"), "root").select(unit.alias("unit"), "id", "root").distinct()
    member = cut(member.join(stock.select("id", F.octet_length("text").alias("bytes")), "id"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("bytes") / BLOCK_BYTES)).cast("int")
    dealt = member.join(member.groupBy("unit").agg(blocks.alias("g")), "unit").withColumn("own", F.pmod(F.xxhash64("id", F.lit(5)), "g").cast("int"))
    dealt = dealt.select("unit", "id", "root", "own", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other"))
    dealt = dealt.select("unit", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "root", "own")
    return cut(dealt.join(stock.select("id", "text"), "id").groupBy("unit", "i", "j").applyInArrow(_linked, "a long, b long").distinct())


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, n_words for every row; see keyed_classes()."""
    return keyed_classes(docs).select("doc_id", "class_id", "class_size", "n_words")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that lead their class: the least doc_id (null last), then the least text hash.

    Of rows that repeat an id and a text the one of the least hash over all columns stays; rows without words all
    stay, once for each id and text. Whole rows travel in one struct, so no name can clash.
    """
    lead = keyed_classes(docs).where("doc_id <=> class_id and text_key = lead_key").select(F.struct("doc_id", "text_key").alias("lead")).distinct()
    whole = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key")).alias("own"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    same = F.col("own.doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("own.text_key") == F.col("lead.text_key"))
    led = whole.join(lead, same, "left_semi")
    return led.groupBy("own").agg(F.min_by("whole", F.xxhash64(F.to_json("whole"))).alias("whole")).select("whole.*")


def keyed_classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, class_id, lead_key, class_size, n_words for every row: near-duplicate classes over whole texts.

    Documents are linked when the weighted Jaccard of their multisets of 5-word shingles (lower case;
    ASCII letters, digits and everything beyond ASCII make words) is 0.8 or more, and a class is a
    connected set of links; class_id is the least doc_id in it, class_size its number of rows. Texts with
    equal multisets are one text from the start. Texts without words (null, empty, only signs) are in no
    class: class_id is their own doc_id and class_size 1. A text of 1 to 4 words has one shingle. Null ids
    stay null and come after all others, so only a class of null ids has a null class_id. Rows that repeat
    an id take part each with its own text. An empty table gives no rows. Other columns are ignored.
    Multisets are told apart by 64-bit hashes: two of n differ and agree in it with a chance of n^2 / 2^65.

    In buckets of up to SMALL texts all meet. In larger ones every text meets one head a round, at first
    the most central text, then one of the bucket's largest class, which is linear and makes most links.
    Large buckets that still hold several classes are then settled exactly: all their texts against all,
    in blocks. That is quadratic in a group of texts that share buckets but mostly no link, in arithmetic
    and, divided by BLOCK_TEXTS, in rows.
    """
    release(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = cut(base.select("doc_id", F.xxhash64("text").alias("text_key"), sketch(F.col("text")).alias("s")).select("doc_id", "text_key", "s.*"))
    worded = rows.where("n_words > 0")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    texts = cut(
        worded.groupBy(F.col("bag_hash").alias("id"))
        .agg(F.min(first).alias("first"), F.count("*").alias("copies"), F.min_by("bands", first).alias("bands"), F.min_by("sig", first).alias("sig"))
    )
    placed = texts.select("id", F.posexplode("bands").alias("band", "key"))
    shared = placed.join(placed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), ["band", "key"])
    shared = cut(shared.withColumn("central", F.sum("n").over(Window.partitionBy("id"))))
    # The texts that share a bucket with another, fetched once for all rounds.
    wanted = shared.select("id").distinct().join(texts.select("id", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"), "sig"), "id")
    found = base.withColumn("text_key", F.xxhash64("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key")))
    stock = cut(found.select("id", "sig", "text").dropDuplicates(["id"]))
    labels = cut(wanted.select("id", F.col("id").alias("root")))
    large, tested = shared.where(F.col("n") > SMALL), None
    bucketed = cut(large.groupBy("id").agg(F.first("central").alias("central"), F.collect_list(F.struct("band", "key")).alias("buckets")))
    side = lambda x, *more: stock.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in more))
    for turn in range(ROUNDS):
        own = lambda k: F.xxhash64("id", F.lit(k))
        drawn = lambda k: -F.log(F.greatest(own(k) / F.lit(2.0**64) + 0.5, F.lit(2.0**-64))) / F.pow("central", F.lit(CENTRAL_POWER))
        if not turn:
            rank = F.struct(-F.col("central"), own(0), F.col("id"))
            pairs = _stars(large.withColumn("root", F.col("id")), ["band", "key"], rank).unionByName(_within(shared.where(F.col("n") <= SMALL))).distinct()
        else:
            # Heads come from the bucket's largest class, so that only the texts outside it are tested.
            sizes = labels.groupBy("root").agg(F.count("*").alias("texts"))
            now = _unfolded(bucketed, labels.join(sizes, "root"))
            pairs = _stars(now, ["band", "key"], F.struct(-F.col("texts"), F.xxhash64("root", F.lit(turn)), drawn(turn), F.col("id")))
        pairs = cut(pairs)
        if pairs.isEmpty():  # no bucket of several classes is left
            break
        untested = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        tested = pairs if tested is None else tested.unionByName(pairs)
        near = untested.join(side("a", "sig"), "a").join(side("b", "sig"), "b").where(agreement(F.col("sig_a"), F.col("sig_b")) >= LEAST_AGREE).select("a", "b")
        fresh = cut(near.join(side("a", "text"), "a").join(side("b", "text"), "b").where(overlap(F.col("text_a"), F.col("text_b")) >= SIMILARITY).select("a", "b"))
        labels = relabelled(labels, fresh)
        release(docs.sparkSession)
    else:
        fresh = _settled(_unfolded(bucketed.drop("central"), labels), stock)
        if fresh is not None:
            labels = relabelled(labels, fresh)
        release(docs.sparkSession)
    final = texts.select("id", "first", "copies").join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
    # Written, so that a class of many texts is split when it meets its lead, not kept whole in the task that made it.
    lead = cut(final.groupBy("root").agg(F.min("first").alias("lead"), F.sum("copies").alias("class_size")))
    of = final.join(lead, "root").select(F.col("id").alias("bag_hash"), F.col("lead.doc_id").alias("class_id"), F.col("lead.text_key").alias("lead_key"), "class_size")
    out = ["doc_id", "text_key", "class_id", "lead_key", "class_size", "n_words"]
    none = rows.where("n_words = 0").select("doc_id", "text_key", F.col("doc_id").alias("class_id"), F.col("text_key").alias("lead_key"), F.lit(1).cast("long").alias("class_size"), "n_words")
    return worded.select("doc_id", "text_key", "bag_hash", "n_words").join(of, "bag_hash").select(*out).unionByName(none)
