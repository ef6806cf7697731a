"""The toxicity network learns from every labelled text, in shards whose number doesn't follow partitions."""

import random

import numpy as np

from tessella.llm import toxcnn


def test_rare_telling_words_are_learned_and_shards_decide(spark, monkeypatch):
    monkeypatch.setattr(toxcnn, "SHARD_BYTES", 1 << 20, raising=False)
    r = random.Random(2)
    bad = ["".join(r.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(600)]  # each in 8 of 4800 toxic texts
    text = lambda *more: " ".join([f"w{r.choice('abcdefgh')}{r.choice('xyzuv')}" for _ in range(20)] + list(more))
    rows = [(i, text(bad[i % 600]), 1) for i in range(4800)] + [(10_000 + i, text(), 0) for i in range(4800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxcnn.learn(df, df.select("doc_id", "toxic"))
    new = spark.createDataFrame([(i, text(w)) for i, w in enumerate(bad)] + [(1000 + i, text()) for i in range(600)], "doc_id long, text string")
    got = {x.doc_id: x.predicted for x in toxcnn.toxicity(new, model).collect()}
    assert sum(got[i] for i in range(600)) > 540 and sum(got[1000 + i] for i in range(600)) < 30
    again = toxcnn.learn(df.repartition(7).unionByName(df.limit(5)), df.select("doc_id", "toxic"))
    assert np.allclose(model.table, again.table, atol=1e-4) and np.allclose(model.shift, again.shift, atol=1e-2)
