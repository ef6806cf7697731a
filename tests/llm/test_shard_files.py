"""The shard writer keeps every row and column, where assign() puts it."""

from collections import Counter

from tessella.llm import sharding


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [(None, f"no id {i % 2}", f"s{i}", i) for i in range(4)] + [(7, "hot " * 5, f"h{i}", i) for i in range(30)] + [(i, "x" * i, None, 0) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int").selectExpr("*", "1 as size", "'k' as whole", "2 as range_part")
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text, r.own_shard, r.own_slot, r.size, r.whole, r.range_part) for r in back.collect()) == Counter((*r, 1, "k", 2) for r in rows)
    want = Counter((r.shard, r.slot, r.doc_id) for r in sharding.assign(docs, 4).collect())
    assert Counter((r.shard, r.slot, r.doc_id) for r in back.collect()) == want
    assert len({r.shard for r in back.collect() if r.doc_id == 7}) > 1
