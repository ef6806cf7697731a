"""Corpus operators against the libraries and against brute force, on small hostile tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessella.llm import bagminhash, dac, decontam, langid, pseudolm, sharding, sp_codec, spotsigs, tokencount, toxcnn
from tessella.llm.common import tokenizer_path

SF = "/root/testdata/sf0.001"
BPE, PIECE = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = ["", None, " ", "  a", "a  b ", "x\n \ny", "don't stop<|endoftext|>now", "ÀÉ ñandú 中文 🙂", "▁a▁", "\t\x00\x1c", "the cat " * 3000, "same", "same", "One two three four.", "1 + 1 = 2!!"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "clash", 7) for i, t in enumerate(ODD)] + [(2, "  a", "en", "clash", 7), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, size string, shard string, p long")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_key(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_sentencepiece_equals_the_library(docs, real):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE))
    of = sp_codec.digests(tokenizer_path(PIECE))
    for df in (docs, real):
        got = by_key(df.select("doc_id", of("text").alias("r")).select("doc_id", "r.*"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = sp.encode(r.text or "", add_eos=True)
            want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
        assert got == sorted(want, key=repr)
    assert [r.text for r in sp_codec.decode(sp_codec.encode(docs, tokenizer_path(PIECE)), tokenizer_path(PIECE)).collect()] == [sp.decode(sp.encode(r.text or "")) for r in docs.select("text").collect()]


@pytest.mark.parametrize("name", [BPE, PIECE, "word_bpe_49k.json"])
def test_counts_equal_the_library(docs, name):
    if name.endswith(".model"):
        import sentencepiece

        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name)).encode(t))
    else:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_path(name))
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    want = [(r.doc_id, len((r.text or "").encode()), count(r.text or "")) for r in docs.select("doc_id", "text").collect()]
    assert by_key(tokencount.count_tokens(docs, tokenizer_path(name)), "doc_id", "n_bytes", "n_tokens") == sorted(want, key=repr)


def test_dac_round_trip_and_random_access():
    r = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.array([0, 255, 256, 65535, 65536, 2**32 - 1], np.uint32), r.integers(0, 50257, 5000).astype(np.uint32), np.zeros(512, np.uint32)):
        s = dac.Segment(dac.pack(ids))
        assert [s[i] for i in range(0, len(ids), 7)] == ids[::7].tolist()
        for a, b in [(0, len(ids)), *(sorted(r.integers(0, len(ids) + 1, 2).tolist()) for _ in range(20))]:
            assert s.run(a, b).tolist() == ids[a:b].tolist()


def test_dac_files(spark, docs, real, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path(BPE))
    for i, df in enumerate((real, docs, docs.limit(0))):
        got = sorted(tuple(r) for r in dac.written_and_read(df, tokenizer_path(BPE), str(tmp_path / str(i))).select("start", "n_tokens", "ids_crc32").collect())
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
        start, want = 0, []
        for r in rows:
            ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
            want.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert got == want


def test_dac_tokens_by_number(spark, docs, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(dac, "SEGMENT_IDS", 1 << 10)
    tok, path = Tokenizer.from_file(tokenizer_path(BPE)), str(tmp_path / "files")
    dac.write(docs, path, tokenizer_path(BPE))
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    every = [i for r in rows for i in [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]]
    asked = [*range(0, len(every), 7), 0, 0, len(every) - 1, len(every), -1, None, 10**12]
    got = dac.tokens_at(spark.createDataFrame([(n, "x") for n in asked], "number long, id string"), path).collect()
    want = [(n, every[n] if n is not None and 0 <= n < len(every) else None) for n in asked]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert dac.tokens_at(spark.createDataFrame([], "number long"), path).count() == 0
    dac.write(docs.limit(0), path, tokenizer_path(BPE))
    assert [tuple(r) for r in dac.tokens_at(spark.createDataFrame([(0,)], "number long"), path).collect()] == [(0, None)]


def test_shards_are_contiguous_and_balanced(docs, real):
    for df, shards in ((real, 8), (docs, 3), (docs.limit(0), 8)):
        rows = sorted(sharding.assign(df, shards).collect(), key=lambda r: (r.shard, r.slot))
        assert len(rows) == df.count()
        assert [r.doc_id for r in rows] == sorted((r.doc_id for r in df.collect()), key=lambda d: (d is not None, d or 0))
        for k in {r.shard for r in rows}:
            assert [r.slot for r in rows if r.shard == k] == list(range(sum(r.shard == k for r in rows)))
        if rows:
            total, most = sum(r.size for r in rows), max(r.size for r in rows)
            assert all(abs(sum(r.size for r in rows if r.shard == k) - total / shards) <= most for k in range(shards))
    assert {(r.size, r.text_crc32) for r in sharding.assign(docs.where("text is null or text = ''"), 2).collect()} == {(1, 0)}


def test_spotsigs_edits(docs, real):
    for df in (real, docs.where("doc_id is null or doc_id <> 2")):
        rows = {r.doc_id: r for r in spotsigs.edited(df).collect()}
        order = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: -(r[0] if r[0] is not None else -1))
        prints = {r.doc_id: r.fingerprint for r in spotsigs.fingerprints(df).collect()}
        for (i, t), (j, u) in zip(order, order[1:] + order[:1]):
            k, r = len(t) // 3, rows[i]
            assert (r.n_chars, r.next_id, r.edited_sha256, r.fingerprint) == (len(t), j, sha(t[: len(t) - k] + u[:k]), prints[i])
            a, b = (set(re.findall("." * 8, p.split(":")[1])) for p in (r.fingerprint, rows[j].fingerprint))
            assert r.near_next == pytest.approx(len(a & b) / len(a | b))
    assert spotsigs.edited(docs.limit(0)).count() == 0 and spotsigs.edited(docs).count() == docs.count()


def test_spotsigs_pairs_equal_brute_force(real):
    sets = {}
    for r in spotsigs.fingerprints(real).collect():
        key = frozenset(r.spots)
        sets[key] = min(r.doc_id, sets.get(key, r.doc_id))
    items = list(sets.items())
    want = {frozenset((i, j)) for n, (a, i) in enumerate(items) for b, j in items[:n] if len(a & b) >= 0.8 * len(a | b)}
    assert {frozenset((r.id_a, r.id_b)) for r in spotsigs.similar(real, 0.8).collect()} == want


def bag(text):
    table = bytes((b + 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalnum() else 32 for b in range(256))
    w = (text or "").lower().encode().translate(table).split()
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def test_near_duplicate_classes_equal_brute_force(spark, real):
    r = random.Random(4)
    base = [" ".join(r.choice("abcdefghijkl") + str(r.randint(0, 99)) for _ in range(90)) for _ in range(3)]
    rows = [(r.id, r.text) for r in real.selectExpr("doc_id id", "text").collect()]
    for i, b in enumerate(base):
        for j in range(8):
            w = b.split()
            for _ in range(j % 3):
                w[r.randrange(len(w))] = f"new{i}{j}"
            rows.append((1000 + 10 * i + j, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, "!!"), (2003, "two words"), (2004, "Two  WORDS!"), (2005, "spam " * 400), (2006, "spam " * 390), (2005, "spam " * 400)]
    bags = {k: bag(t) for k, t in rows}
    parent = {k: k for k in bags}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = [k for k in bags if bags[k]]
    for n, a in enumerate(keys):
        for b in keys[:n]:
            both = sum((bags[a] & bags[b]).values())
            if both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = bagminhash.classes(df).collect()
    assert len(got) == len(rows) and {r.doc_id: r.class_id for r in got} == {k: root(k) for k in bags}
    kept = sorted(r.doc_id for r in bagminhash.deduplicated(df.selectExpr("*", "'x' id", "1 band")).collect())
    assert kept == sorted({root(k) for k in bags})
    assert bagminhash.classes(df.limit(0)).count() == 0


def replaced(template, kept, name):
    w = list(template)
    for p in kept:
        w[p] = f"{name}x{p}"
    return w


@pytest.mark.parametrize("kind", ["partners", "four", "five"])
def test_near_templates_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(bagminhash, "BLOCK_TEXTS", 64)
    r, texts = random.Random(9), []
    if kind == "partners":  # a hundred texts, any two of which share one of three replaced words at most, 0.77 alike; each with a partner at 0.815
        template, places = [f"t{i}" for i in range(200)], range(5, 195, 6)
        for i in range(100):
            a, b = divmod(i, 10)
            own = replaced(template, [places[x] for x in (a, 10 + b, 20 + (a + b) % 10)], f"a{i}")
            texts += [" ".join(own), " ".join(replaced(own, [p for p in places if own[p] == template[p]][i % 7 : i % 7 + 4], f"b{i}"))]
    else:  # texts that differ from one base in as many words each
        template = [f"t{i}" for i in range(300)]
        texts = [" ".join(replaced(template, r.sample(range(300), 4 if kind == "four" else 5), f"a{i}")) for i in range(300)]
    bags = [set(bag(t)) for t in texts]
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(bags)):
        for b in range(a):
            both = len(bags[a] & bags[b])
            if both >= 0.8 * (len(bags[a]) + len(bags[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = bagminhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert kind != "partners" or len({root(k) for k in range(len(texts))}) == 100
    assert {r.doc_id: r.class_id for r in got} == {k: root(k) for k in range(len(texts))}


def test_bagminhash_is_unbiased():
    a = np.array([1, 2, 3, 4, 5], np.uint64)
    wa, wb = np.array([1, 5, 2, 40, 3]), np.array([3, 5, 1, 25, 0])
    doc = np.array([0] * 5 + [1] * 4)
    sig = bagminhash.signatures(doc, np.concatenate([a, a[:4]]), np.concatenate([wa, wb[:4]]), 2, 4000)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / 4000) ** 0.5


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 150])
def test_decontamination_equals_brute_force(spark, real, block):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").limit(12).select("item_id", "text").union(spark.createDataFrame([(900, "One two"), (901, ""), (902, None), (903, "le la une")], "item_id long, text string"))
    df = real.select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "ONE two, one-two"), (-4, "x " * 9000 + "one two")], "doc_id long, text string"))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for r in bench.collect():
        w = words(r.text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(r.item_id))
    want = []
    for r in df.collect():
        w, hit, items = words(r.text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= own
        want.append((r.doc_id, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    got = decontam.report(decontam.find(df, bench, block_bytes=block))
    assert by_key(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
    assert {r.doc_id for r in decontam.clean(df, bench, block_bytes=block).collect()} == {w[0] for w in want if not w[2]}
    assert decontam.find(df, bench.limit(0)).where("size(places) > 0").count() == 0


def test_language_models(spark, docs):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = rows.where("doc_id % 3 > 0"), rows.where("doc_id % 3 = 0")
    met = langid.identify(test, train).join(test.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in met]) > 0.98 and np.mean([r.rejected for r in met]) < 0.01
    model = langid.fit(train)
    odd = docs.select("text", langid.predict(docs["text"], model, spark).alias("p")).collect()
    assert all((r.p.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) and 0 <= r.p.score <= 1 for r in odd)
    # Interpolated probabilities over the alphabet sum to one.
    p = langid.train({"a": [b"banana bandana"], "b": [b"cab"]})
    assert abs(sum(v[0] for v in p.grams[0][1]) + p.contexts[0][1][0][0] - 1) < 1e-9


def test_toxicity_finds_planted_words(spark, docs):
    r = random.Random(2)
    text = lambda toxic: " ".join([f"w{r.choice('abcdefgh')}{r.choice('xyzuv')}" for _ in range(30)] + ["vilest"] * toxic)
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxcnn.learn(df.where("doc_id < 400"), df.where("doc_id < 400").select("doc_id", "toxic"))
    got = toxcnn.toxicity(df.where("doc_id >= 400"), model).join(df, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in toxcnn.toxicity(docs, model).collect())
    assert toxcnn.learn(df, df.select("doc_id", "toxic").where("toxic = 0")) is None


def test_pseudo_likelihood(spark, docs):
    net = pseudolm.Network.fresh()
    n = pseudolm.CLASSES * pseudolm.MEMBERS
    around = [np.full(n, k) for k in (3, 9, 100, n)]
    assert np.exp(net.forward(around, np.arange(n))).sum() == pytest.approx(1, abs=1e-4)
    rows = [(i, "alpha beta gamma delta " * 40) for i in range(60)] + [(100, "gamma gamma alpha alpha " * 40)]
    got = {r.doc_id: r for r in pseudolm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_tokens == 160 and got[0].mean_pll > got[100].mean_pll and got[0].pll == got[1].pll
    odd = pseudolm.scores(docs).collect()
    assert len(odd) == docs.count() and all((r.mean_pll is None) == (r.n_tokens == 0) for r in odd)
    assert pseudolm.scores(docs.limit(0)).count() == 0


def test_pipeline_equals_its_operators_by_hand(spark):
    import corpus_pipeline
    import sentencepiece

    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(w) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [re.findall(r"[a-z0-9\x80-\U0010ffff]+", r.text.lower())] for w in [w[i : i + 10] for i in range(len(w) - 9)]]
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in rows}
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE))
    for r in rows:
        assert r.ids == sp.encode(texts[r.doc_id], add_eos=True) and r.decoded_sha256 == sha(sp.decode(r.ids))
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", texts[r.doc_id].lower())
        assert not {tuple(w[i : i + 10]) for i in range(len(w) - 9)} & set(bench)
    assert len({texts[k] for k in kept}) == len(kept) > 0.5 * len(set(texts.values()))
