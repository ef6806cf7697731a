"""Operator 6: SpotSigs fingerprints. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, global_prefix

# The common words at which chains start, by language.
ANCHORS = {
    "en": ["a", "an", "the", "is", "was", "of", "and", "that"],
    "de": ["der", "die", "das", "ist", "war", "und", "ein", "eine"],
    "fr": ["le", "la", "les", "est", "et", "un", "une", "des"],
    "es": ["el", "los", "las", "es", "y", "uno", "una", "del"],
}
# Other common words, which no chain holds.
COMMON = {
    "en": ["be", "by", "for", "from", "he", "in", "it", "on", "or", "this", "to", "with", "as", "are", "at", "not"],
    "de": ["den", "dem", "von", "zu", "mit", "sich", "auf", "nicht", "es", "im", "in", "für"],
    "fr": ["de", "du", "en", "que", "qui", "dans", "pour", "par", "sur", "au", "avec", "ne"],
    "es": ["de", "que", "en", "se", "por", "con", "para", "su", "al", "lo", "no", "si"],
}
#: Content words in a chain, and how many words behind its anchor are searched for them.
CHAIN, REACH = 3, 12


def _words(values: dict[str, list[str]]) -> list[str]:
    return sorted({w for v in values.values() for w in v})


def spots(text: Column) -> Column:
    """The distinct spot signatures of a text, as 32-bit numbers in a sorted array<bigint>.

    Words are runs of letters and digits in lower case. Behind each anchor the next CHAIN words that
    are not common words, found within REACH words, form with it a signature; at the end of a text, or
    of the reach, a chain may be shorter but not empty. A text without signatures has one of the
    whole text, so only equal texts share it.
    """
    anchors = _words(ANCHORS)
    common = sorted({*anchors, *_words(COMMON)})
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    chain = lambda w, i: F.slice(F.filter(F.slice(w, i + 2, REACH), lambda x: ~x.isin(common)), 1, CHAIN)

    def signatures(w: Column) -> Column:
        made = F.transform(w, lambda x, i: F.when(x.isin(anchors), F.concat_ws(" ", x, chain(w, i))))
        full = F.filter(made, lambda s: s.contains(" "))
        return F.array_distinct(F.transform(full, lambda s: F.xxhash64(s).bitwiseAND(F.lit(0xFFFFFFFF))))

    # Bound to a lambda's variable, the words are made once.
    made = F.element_at(F.transform(F.array(words), signatures), 1)
    whole = F.array(F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.element_at(F.transform(F.array(made), lambda s: F.when(F.size(s) > 0, F.array_sort(s)).otherwise(whole)), 1)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two sorted signature sets. The shorter's share of the longer bounds it, so sets of very unequal length aren't compared below a bound of 0."""
    n = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) * F.size(b) == 0, F.lit(0.0)).otherwise(n / (F.size(a) + F.size(b) - n))


def as_text(signatures: Column) -> Column:
    """The set's length, a colon, and eight lowercase hex digits for each signature, ascending."""
    digits = F.transform(signatures, lambda x: F.substring(F.hex(x + F.lit(1 << 32)), 2, 8))
    return F.concat(F.size(signatures).cast("string"), F.lit(":"), F.lower(F.array_join(digits, "")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, spots, fingerprint of every row, whole texts (null as empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", spots(text).alias("spots")).withColumn("fingerprint", as_text(F.col("spots")))


def similar(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """id_a, id_b, likeness: pairs of different signature sets with a Jaccard of at least `least`, each once.

    Equal sets are one (the least doc_id stands for them). Sets are dealt by length class, geometric of
    ratio 1/least, so partners lie in the same class or the next. Within a class sets meet only on
    their rarest signatures: of n, the n - ceil(least * n) + 1 rarest; common signatures are never
    joined on. Lengths are compared before sets are.
    """
    import math

    sets = cut(fingerprints(docs).groupBy("spots").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("spots")))
    each = sets.select("id", "n", F.explode("spots").alias("sig"))
    rare = each.groupBy("sig").agg(F.count("*").alias("df"))
    listed = each.join(rare, "sig").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("by_df"))
    prefix = listed.select("id", "n", F.explode(F.slice("by_df", F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)).alias("p")).select("id", "n", F.col("p.sig").alias("sig"))
    part = F.floor(F.log(F.col("n")) / math.log(1 / least) + 1e-9).cast("int")
    left = prefix.withColumn("part", F.explode(F.array(part, part + 1)))
    right = prefix.withColumn("part", part)
    pairs = (
        left.alias("l").join(right.alias("r"), ["sig", "part"])
        .where("l.n < r.n or l.n = r.n and l.id < r.id").where(F.col("l.n") >= F.col("r.n") * least)
        .select(F.col("l.id").alias("id_a"), F.col("r.id").alias("id_b")).distinct()
    )
    of = lambda x: sets.select(F.col("id").alias(f"id_{x}"), F.col("spots").alias(f"spots_{x}"))
    return pairs.join(of("a"), "id_a").join(of("b"), "id_b").select("id_a", "id_b", likeness(F.col("spots_a"), F.col("spots_b")).alias("likeness")).where(F.col("likeness") >= least)


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id for every row.

    A text's last floor(n_chars/3) code points are replaced by the first as many (or all) of the next
    document in descending doc_id; after the last comes the first. Null texts are empty, null ids come
    last, texts of one id follow in the order of their hash, and repeated rows are one document in the
    order but each get a row. A single document is its own next.

    The order is settled on ids, hashes and lengths alone; the texts are shuffled once, and from each only as much
    as its taker needs goes on to it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("t")).select("doc_id", "t", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.xxhash64("t").alias("h"))
    keys = base.select("k", "h", F.length("t").alias("n")).distinct()
    rows = cut(global_prefix(keys, [F.col("k").desc(), F.col("h").asc()], F.lit(0)).select("k", "h", "n", "row_before", "rows_all"))
    taker = rows.select(F.col("k").alias("to_k"), F.col("h").alias("to_h"), F.floor(F.col("n") / 3).cast("int").alias("need"), ((F.col("row_before") + 1) % F.col("rows_all")).alias("row_before"))
    give = cut(rows.join(taker, "row_before").select("k", "h", "to_k", "to_h", "need"))
    full = base.join(give, ["k", "h"])
    from_next = full.select("to_k", "to_h", F.col("doc_id").alias("next_id"), F.substring("t", F.lit(1), F.col("need")).alias("head"), spots(F.col("t")).alias("next_spots"))
    from_next = from_next.select(F.col("to_k").alias("k"), F.col("to_h").alias("h"), "next_id", "head", "next_spots").dropDuplicates(["k", "h"])
    own = full.select("k", "h", "doc_id", "t")
    met = own.join(from_next, ["k", "h"])
    n = F.length("t")
    changed = met.select(
        "doc_id", "next_id", "next_spots", n.cast("long").alias("n_chars"), spots(F.col("t")).alias("spots"),
        F.concat(F.substring("t", F.lit(1), n - F.floor(n / 3).cast("int")), F.col("head")).alias("edited"),
    )
    both = changed.select("*", spots(F.col("edited")).alias("edited_spots"))
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("spots")).alias("fingerprint"),
        as_text(F.col("edited_spots")).alias("edited_fingerprint"), likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"), "next_id",
    )
