"""Pseudo-likelihood against brute force: words one by one, gradients by differences, and no dependence on partitions."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tessella.llm import pseudolm
from tessella.llm.common import ALNUM, split_words


def corpus():
    r = random.Random(3)
    vocabulary = [r.choice("bcdfgk") + r.choice("aeiou") + r.choice("lmnrst") + r.choice(["", "ing", "ed", "s"]) for _ in range(60)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 60)))) for i in range(40)]
    return [*rows, (40, None), (41, ""), (42, "!?"), (43, "oncehere unheard"), (44, "twice told tale"), (45, "twice told tale"), (None, "no id"), (7, rows[7][1]), (7, rows[7][1]), (46, "long text " * 9000)]


@pytest.mark.parametrize("known", [2, 50_000])
def test_scores_equal_brute_force(spark, monkeypatch, known):
    monkeypatch.setattr(pseudolm, "KNOWN", known)
    monkeypatch.setattr(pseudolm, "FREQUENT", 5)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' row", "1 n_tokens", "2 name")
    got = sorted((tuple(r) for r in pseudolm.scores(df).collect()), key=repr)
    words = [split_words([(t or "").lower().encode()], ALNUM)[0] for _, t in rows]
    count = Counter(w for ws in words for w in ws)
    frequent = sorted(count, key=lambda w: (-count[w], w))[: min(5, known)]
    mass = Counter()
    for w in count:
        if w not in frequent:
            mass[w[-2:]] += count[w]
    endings = sorted(mass, key=lambda e: (-mass[e], e))[: pseudolm.ENDINGS - 1]
    rest = sum(mass[e] for e in mass if e not in endings)
    information, _ = pseudolm.vocabulary(df)
    net = pseudolm.fit(pseudolm.numbered(df, information))
    token = lambda w: frequent.index(w) if w in frequent else 5 + (endings.index(w[-2:]) if w[-2:] in endings else pseudolm.ENDINGS - 1)
    want = []
    for (doc, _), ws in zip(rows, words):
        ids, own, total = [token(w) for w in ws], Counter(ws), 0.0
        edge = pseudolm.CLASSES * pseudolm.MEMBERS
        around = [np.array([ids[i + s] if 0 <= i + s < len(ids) else edge for i in range(len(ids))], np.int64) for s in pseudolm.SPAN]
        if ws:
            total = float(net.forward(around, np.array(ids)).astype(float).sum())
        for w in ws:
            if w not in frequent:
                total += math.log(count[w] - own[w] + 40.0 ** -(len(w) + 1)) - math.log((mass[w[-2:]] if w[-2:] in endings else rest) + 1)
        want.append((doc, len(ws), total, total / len(ws) if ws else None))
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=repr)):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-3, abs=1e-2) and (a[3] is None) == (b[3] is None)
    pll = {r[0]: r[2] for r in got}
    assert pll[44] == pll[45] and pll[43] < pll[44] and len({r[2] for r in got if r[0] == 7}) == 1


def test_partitions_do_not_matter(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one, many = (sorted(tuple(r) for r in pseudolm.scores(df.repartition(n)).select("doc_id", "pll").collect()) for n in (1, 17))
    assert [a[0] for a in one] == [b[0] for b in many]
    assert max(abs(a[1] - b[1]) / (1 + abs(a[1])) for a, b in zip(one, many)) < 1e-5


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    n = pseudolm.CLASSES * pseudolm.MEMBERS
    net = pseudolm.Network(*(p.astype(np.float64) for p in pseudolm.Network.fresh().parts()))
    tokens = rng.integers(0, n, 300)
    tokens[:40] = 7
    around = pseudolm.neighbours(tokens, np.array([120, 0, 180]))
    grads = [np.zeros(s) for s in pseudolm.Network.shapes()]
    net.forward(around, tokens, grads)
    for value, g in zip(net.parts(), grads):
        where = [tuple(w) for w in np.argwhere(np.abs(g) > np.quantile(np.abs(g), 0.99))[:4]] + [tuple(rng.integers(0, s) for s in value.shape) for _ in range(2)]
        for w in where:
            was, ends = value[w], []
            for step in (1e-5, -1e-5):
                value[w] = was + step
                ends.append(-net.forward(around, tokens).mean())
            value[w] = was
            assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g[w], rel=1e-3, abs=1e-7)
