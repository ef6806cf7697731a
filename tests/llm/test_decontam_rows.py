"""Every row comes out of the search for benchmark passages, in one block or in several."""

import pytest

from tessella.llm import decontam


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 10])
def test_repeated_rows_and_rows_without_id_all_come_out(spark, block):
    bench = spark.createDataFrame([(1, "one two"), (2, "three four"), (3, "two three")], "item_id long, text string")
    rows = [(5, "x one two three y")] * 3 + [(None, "nothing")] * 2 + [(None, "three four")] * 2 + [(6, None)] * 2 + [(5, "other"), (7, "")]
    got = decontam.find(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_bytes=block).collect()
    want = [(5, 5, [1, 2, 3], ["1", "3"])] * 3 + [(None, 1, [], [])] * 2 + [(None, 2, [0, 1], ["2"])] * 2 + [(6, 0, [], [])] * 2 + [(5, 1, [], []), (7, 0, [], [])]
    assert sorted(((r.doc_id, r.n_words, r.places, r.items) for r in got), key=repr) == sorted(want, key=repr)
