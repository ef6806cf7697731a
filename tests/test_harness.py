import csv
import glob
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import harness
from tessella.operators.slic import slic
from tessella.sources import volumes
from tessella.sources.images import from_array, infer_shape

RNG = np.random.default_rng(5)


@pytest.mark.parametrize("shape, multichannel", [((7, 9), True), ((7, 9, 3), True), ((4, 7, 9), False), ((3, 4, 5, 2), True)])
def test_npy_volumes(spark, tmp_path, monkeypatch, shape, multichannel):
    image = RNG.random(shape).astype(np.float32)
    path = str(tmp_path / "image.npy")
    np.save(path, image)
    for most in (1 << 18, 20):  # whole planes, and two lines at a time
        monkeypatch.setattr(volumes, "PIXELS_AT_ONCE", most)
        got = volumes.from_npy(spark, path, multichannel, image_id=3)
        want = from_array(spark, image, multichannel, image_id=3)
        assert got.schema == want.schema
        order = ["z", "y", "x"]
        assert got.orderBy(*order).collect() == want.orderBy(*order).collect()
    assert infer_shape(got)[:3] == infer_shape(want)[:3]


def test_empty_volume(spark, tmp_path):
    np.save(str(tmp_path / "none.npy"), np.zeros((0, 5), np.float32))
    assert volumes.from_npy(spark, str(tmp_path / "none.npy")).count() == 0


def test_hdf5_asks_the_library(spark, monkeypatch):
    asked = []

    def file(path, mode):
        asked.append((path, mode))
        return {"own": np.zeros((2, 3))}

    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=file))
    assert volumes.from_hdf5(spark, "/shared/volume.h5", "own").columns == ["image_id", "z", "y", "x", "features"]
    assert asked == [("/shared/volume.h5", "r")]


def test_volume_to_labels(spark, tmp_path):
    image = RNG.random((12, 13)).astype(np.float32)
    np.save(str(tmp_path / "image.npy"), image)
    one, two = (slic(px, n_segments=6, multichannel=False, ndim=2).orderBy("y", "x").collect() for px in (volumes.from_npy(spark, str(tmp_path / "image.npy")), from_array(spark, image)))
    assert one == two


def test_sweep_compare_and_csv(spark, tmp_path):
    runs = harness.sweep(spark, sides=(6, 8), runs=2, grain=3, ways={"a": {"backend": "arrow"}, "s": {"backend": "sql"}})
    rows = runs.collect()
    assert [(r.way, r.side, r.run) for r in rows] == [(w, s, k) for s in (6, 8) for k in (0, 1) for w in "as"]
    assert all(r.bytes == 4 * r.side**3 and r.gb_s == pytest.approx(r.bytes / 1e9 / r.seconds) for r in rows)
    assert harness.sweep(spark, sides=()).count() == 0
    harness.write_csv(runs, str(tmp_path / "runs"))
    (name,) = glob.glob(f"{tmp_path}/runs/*.csv")
    with open(name) as f:
        assert [(r["way"], int(r["side"]), float(r["seconds"])) for r in csv.DictReader(f)] == [(r.way, r.side, r.seconds) for r in rows]
    found = harness.compare(spark, {"backend": "arrow"}, {"backend": "sql"}, side=6, rounds=1, runs=1, grain=3)
    assert found["ratio"] == pytest.approx(found["one"] / found["other"])


def test_profile(spark):
    got = harness.profiled(spark, lambda: spark.range(100, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).count())
    assert got["seconds"] > 0 and "HashAggregate" in got["plan"]
    assert got["stages"] and all(s["tasks"] > 0 and s["failed"] == 0 for s in got["stages"])
