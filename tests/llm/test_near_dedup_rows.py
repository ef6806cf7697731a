"""Rows that the joins of the near-duplicate classes make."""

import random

from tessella.llm import bagminhash


def made_by_joins(spark, key):
    """Rows out of all joins on the column `key`, by execution."""
    store, found = spark._jsparkSession.sharedState().statusStore(), {}
    executions = store.executionsList()
    for i in range(executions.size()):
        run = executions.apply(i).executionId()
        metrics, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for k in range(nodes.size()):
            node = nodes.apply(k)
            if "Join" in node.name() and f"[{key}#" in node.desc():
                for m in range(node.metrics().size()):
                    metric = node.metrics().apply(m)
                    if metric.name() == "number of output rows" and metrics.contains(metric.accumulatorId()):
                        found[run] = found.get(run, 0) + int(metrics.apply(metric.accumulatorId()).replace(",", ""))
    return found


def test_a_text_meets_its_label_once_whatever_its_buckets(spark):
    r = random.Random(4)
    template = [f"t{i}" for i in range(300)]
    texts = []
    for i in range(300):
        words = list(template)
        for k in r.sample(range(300), 4):
            words[k] = f"a{i}x{k}"
        texts.append(" ".join(words))
    before = set(made_by_joins(spark, "id"))
    got = bagminhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == 300
    rows = [n for run, n in made_by_joins(spark, "id").items() if run not in before]
    assert rows and max(rows) <= 2 * len(texts)
