"""The queries on vectors against their SQL, on tables that don't fill a box of 20 by 25."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessella import queries
from tessella.operators.assign import assign
from tessella.operators.centers import init_centers
from tessella.operators.slic import prepared, slic
from tessella.sources.images import blobs


def vectors(ids, seed=0, size=64):
    values = np.random.default_rng(seed).normal(0, 0.2, (len(ids), size)).astype(np.float32)
    return [(i, v.tolist()) for i, v in zip(ids, values)]


#: A part of the last row; more rows than the lattice has; fewer; gaps; twice the same; as far out as a distance may be, and further.
TABLES = {
    "part_of_a_row": vectors(range(513)),
    "taller": vectors(range(2000)),
    "smaller": vectors(range(7)),
    "gaps": vectors(range(3, 1500, 7)),
    "repeats": vectors([*range(30), *range(20)]),
    "large_ids": vectors([0, 600, 10**11, 10**15, 2**62]),
    "far": vectors([0, 1_200_000, 1_249_000, 1_251_000, 1_300_000]),
    "before_zero": vectors(range(-700, 40, 9)),
    "no_id_or_vector": [*vectors(range(520)), (None, [0.1] * 64), (520, None), (521, [None] * 64), (522, [0.1] * 63), (523, [])],
    "longer": vectors(range(40), size=70),
    "empty": [],
}


@pytest.fixture(params=sorted(TABLES))
def table(request, tmp_path):
    ids, values = ([r[k] for r in TABLES[request.param]] for k in (0, 1))
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(values, pa.list_(pa.float32())), "label": pa.array([0] * len(ids), pa.int32())}), tmp_path / "embeddings.parquet")
    return str(tmp_path)


def both(spark, name, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    key = lambda r: tuple((v is not None, v) for v in r)
    theirs = con.sql(queries.oracle_sql()[name])
    return (sorted(map(tuple, queries.QUERIES[name](spark, sf_dir).select(*theirs.columns).collect()), key=key), sorted(theirs.fetchall(), key=key))


def test_image_equals_sql(spark, table):
    ours, theirs = both(spark, "image_emb", table)
    assert ours == theirs


def test_assignment_equals_sql(spark, table):
    ours, theirs = both(spark, "assign_round1_emb", table)
    assert ours == theirs


def test_long_places_in_blocks(spark):
    """Arrow batches hold places of 32 bits, of whatever type a table has them."""
    px = blobs(spark, 8)
    wide = px.withColumns({a: px[a].cast("long") for a in "zyx"})
    ours, theirs = (sorted(map(tuple, slic(p, n_segments=8, max_iter=2).collect())) for p in (wide, px))
    assert ours == theirs and len(ours) == 512


def test_candidates_of_few_images_are_broadcast(spark):
    sf = "/root/testdata/sf0.01"
    px, shape = queries.IMAGES["emb"](spark, sf)
    p = queries.plan_of("emb", shape)
    home = prepared(px, p)
    centers = init_centers(home, p)
    ways = {n: assign(home, centers, p, images=n) for n in (None, 1)}
    joins = {n: df._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") for n, df in ways.items()}
    assert joins == {None: 0, 1: 1}
    rows = [sorted(map(tuple, df.select("z", "y", "x", "c", "pz", "py", "px").collect())) for df in ways.values()]
    assert rows[0] == rows[1] and len(rows[0]) == 500
