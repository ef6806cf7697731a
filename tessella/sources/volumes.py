"""Images in array files on a shared file system, read in tasks: the driver only looks at their shape."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.geometry import canonical, ceil_div
from .images import PIXELS

#: Pixels that are read at once.
PIXELS_AT_ONCE = 1 << 18


def from_volume(spark: SparkSession, open_array: Callable[[], np.ndarray], multichannel: bool = True, image_id: int = 0) -> DataFrame:
    """A pixel table of what `open_array` opens: anything with a shape and slices, as memory maps and datasets have.

    It is opened once on the driver, for its shape, and once in each task, which reads runs of lines of one plane. The
    file has to be readable by the same path everywhere. An array without pixels gives an empty table.
    """
    shape = open_array().shape
    (z, y, x, c), is_2d = canonical(shape, multichannel)
    lines = max(1, PIXELS_AT_ONCE // max(1, x))
    runs = ceil_div(y, lines)
    fields = pa.schema([("image_id", pa.int64()), ("z", pa.int32()), ("y", pa.int32()), ("x", pa.int32()), ("features", pa.list_(pa.float32()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = open_array()
        for b in batches:
            for unit in b.column(0).to_pylist():
                plane, first = unit // runs, unit % runs * lines
                last = min(y, first + lines)
                part = np.asarray(source[first:last] if is_2d else source[plane, first:last], np.float32).reshape(-1)
                n = (last - first) * x
                at = [np.full(n, image_id), np.full(n, plane), np.repeat(np.arange(first, last), x), np.tile(np.arange(x), last - first)]
                cells = pa.FixedSizeListArray.from_arrays(pa.array(part), c).cast(fields.field("features").type)
                yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(f.type.to_pandas_dtype())) for v, f in zip(at, fields)), cells], schema=fields)

    units = z * runs if math.prod((z, y, x, c)) else 0
    return spark.range(0, units, 1, max(1, min(units, spark.sparkContext.defaultParallelism * 4))).mapInArrow(read, PIXELS)


def from_npy(spark: SparkSession, path: str, multichannel: bool = True, image_id: int = 0) -> DataFrame:
    """A pixel table of a .npy file, through a memory map."""
    return from_volume(spark, lambda: np.load(path, mmap_mode="r"), multichannel, image_id)


def from_hdf5(spark: SparkSession, path: str, dataset: str = "data", multichannel: bool = True, image_id: int = 0) -> DataFrame:
    """A pixel table of a dataset of an HDF5 file; needs h5py on the driver and the workers."""

    def open_dataset():
        import h5py

        return h5py.File(path, "r")[dataset]

    return from_volume(spark, open_dataset, multichannel, image_id)
