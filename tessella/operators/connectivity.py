"""Connected segments: components of equal label, small ones absorbed, large ones split, dense labels in raster order."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.geometry import SlicPlan, tiles
from .lineage import cut

#: Sides of the tiles whose inner components one call finds, of flat images and of volumes.
FLAT_TILE, TILE = 256, 32


def tile_side(plan: SlicPlan) -> int:
    """The side of tiles; an image of at most twice that is one tile."""
    side = FLAT_TILE if plan.shape[0] == 1 else TILE
    return 2 * side if max(plan.shape) <= 2 * side else side


def _tile_components(plan: SlicPlan):
    _, ny, nx = plan.shape

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low = [int(pdf[a].min()) for a in "zyx"]
        box = [int(pdf[a].max()) - m + 1 for a, m in zip("zyx", low)]
        at = [pdf[a].to_numpy() - m for a, m in zip("zyx", low)]
        label = np.full(box, np.iinfo(np.int64).min)
        label[tuple(at)] = pdf["label"].to_numpy()
        index = ((np.arange(box[0])[:, None, None] + low[0]) * ny + (np.arange(box[1])[None, :, None] + low[1])) * nx + np.arange(box[2])[None, None, :] + low[2]
        flat, parent = index.reshape(-1), np.arange(index.size)
        local = parent.reshape(box)
        for axis in range(3):
            if box[axis] < 2:
                continue
            one, two = [slice(None)] * 3, [slice(None)] * 3
            one[axis], two[axis] = slice(None, -1), slice(1, None)
            same = label[tuple(one)] == label[tuple(two)]
            a, b = local[tuple(one)][same], local[tuple(two)][same]
            while len(a):  # hook greater roots under lesser ones, then flatten, until ends agree
                ra, rb = parent[a], parent[b]
                differ = ra != rb
                a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
                np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
                while (up := parent[parent] != parent).any():
                    parent[up] = parent[parent[up]]
        root = flat[parent].reshape(box)
        out = {"image_id": pdf["image_id"], "z": pdf["z"], "y": pdf["y"], "x": pdf["x"], "p": index[tuple(at)], "label": pdf["label"], "local": root[tuple(at)]}
        for axis, a in enumerate("zyx"):
            ahead = np.full(box, -1)
            one, two = [slice(None)] * 3, [slice(None)] * 3
            one[axis], two[axis] = slice(None, -1), slice(1, None)
            one, two = tuple(one), tuple(two)
            ahead[one] = np.where(root[one] == root[two], -1, root[two])
            out[f"next_{a}"] = ahead[tuple(at)]
        return pd.DataFrame(out)

    return run


def _neighbours(cells: DataFrame, plan: SlicPlan, of: str, tile: int = 1) -> DataFrame:
    """Values of column `of` (and labels) on both sides of every face between two pixels, of different tiles only where a side is given."""
    _, ny, nx = plan.shape
    crosses = lambda a, n: (F.col(a) < n - 1) & (F.col(a) % tile == tile - 1)
    steps = F.array(*(F.struct(F.lit(d).cast("long").alias("d"), crosses(a, n).alias("ok")) for a, d, n in zip("zyx", (ny * nx, nx, 1), plan.shape)))
    ahead = cells.select("image_id", F.col("label").alias("label_a"), F.col(of).alias("a"), "p", F.explode(F.filter(steps, lambda s: s["ok"])).alias("s"))
    ahead = ahead.select("image_id", "label_a", "a", (F.col("p") + F.col("s.d")).alias("p"))
    met = cells.where(F.greatest(*(((F.col(a) % tile == 0) & (F.col(a) > 0)).cast("int") for a in "zyx")) == 1)
    return ahead.join(met.select("image_id", "p", F.col("label").alias("label_b"), F.col(of).alias("b")), ["image_id", "p"]).where("a <> b").select("image_id", "a", "b", "label_a", "label_b").distinct()


def components(labels: DataFrame, plan: SlicPlan) -> DataFrame:
    """image_id, z, y, x, p, label, comp: the least linear index of each pixel's component of equal label (faces touch)."""
    cells, roots, _ = tiled_components(labels, plan)
    return _rooted(cells, roots).select("image_id", "z", "y", "x", "p", "label", "comp")


def _rooted(parts: DataFrame, roots: DataFrame | None, of: str = "local", to: str = "comp") -> DataFrame:
    """Adds the component `to` of the part of a tile in column `of`."""
    if roots is None:
        return parts.withColumn(to, F.col(of))
    ends = roots.select("image_id", F.col("local").alias(of), F.col("comp").alias("root"))
    return parts.join(ends, ["image_id", of], "left").withColumn(to, F.coalesce("root", of)).drop("root")


def tiled_components(labels: DataFrame, plan: SlicPlan) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Parts of equal label in tiles, and how they hang together: cells, roots, rims.

    cells: image_id, z, y, x, p, label, local (the part), and next_z, next_y, next_x: the part ahead in the same tile, if another
    than the pixel's own, else -1. roots (image_id, local, comp): the parts that touch an equal label in another tile. rims: parts
    a, b on both sides of faces between tiles. Both are None where there is one tile.

    Tiles of bounded size settle their inner components; only the ties between tiles are then spread by joins.
    """
    side = tile_side(plan)
    tile = [F.floor(F.col(a) / side) for a in "zyx"]
    cells = cut(
        labels.select("image_id", "z", "y", "x", "label").groupBy("image_id", *(t.alias(f"t{a}") for t, a in zip(tile, "zyx")))
        .applyInPandas(_tile_components(plan), "image_id long, z int, y int, x int, p long, label long, local long, next_z long, next_y long, next_x long")
    )
    if tiles(plan.shape, side) == (1, 1, 1):
        return cells, None, None
    rims = cut(_neighbours(cells, plan, "local", side))
    ties = rims.where("label_a = label_b").select("image_id", "a", "b")
    both = cut(ties.union(ties.select("image_id", F.col("b"), F.col("a"))).distinct())
    roots = cut(both.groupBy("image_id", F.col("a").alias("local")).agg(F.min("b").alias("m")).select("image_id", "local", F.least("local", "m").alias("comp")))
    while True:
        near = both.join(roots.select("image_id", F.col("local").alias("b"), "comp"), ["image_id", "b"]).select("image_id", F.col("a").alias("local"), "comp", F.lit(None).cast("long").alias("own"))
        least = near.union(roots.select("image_id", "local", "comp", F.col("comp").alias("own"))).groupBy("image_id", "local").agg(F.min("comp").alias("to"), F.max("own").alias("was"))
        jump = roots.select("image_id", F.col("local").alias("to"), F.col("comp").alias("far"))
        new = cut(least.join(jump, ["image_id", "to"]).select("image_id", "local", F.least("to", "far").alias("comp"), "was"))
        roots = new.select("image_id", "local", "comp")
        if new.where("comp <> was").isEmpty():
            return cells, roots, rims


def split_large(cells: DataFrame, plan: SlicPlan) -> DataFrame:
    """Components of more than max_size pixels become chunks of max_size in breadth-first order from their first pixel."""
    _, ny, nx = plan.shape
    most = max(plan.max_size, 1)
    sizes = cells.groupBy("image_id", "comp").agg(F.count("*").alias("size"))
    large = cells.join(sizes.where(F.col("size") > most).select("image_id", "comp"), ["image_id", "comp"])

    def chunks(pdf: pd.DataFrame) -> pd.DataFrame:
        z, y, x, p = (pdf[c].to_numpy() for c in ("z", "y", "x", "p"))
        row, order, queue = {int(v): i for i, v in enumerate(p)}, [], deque([int(p.min())])
        seen = {queue[0]}
        while queue:
            q = queue.popleft()
            order.append(row[q])
            i = row[q]
            for ok, step in ((z[i] > 0, -ny * nx), (y[i] > 0, -nx), (x[i] > 0, -1), (x[i] < nx - 1, 1), (y[i] < ny - 1, nx), (True, ny * nx)):
                t = q + step
                if ok and t in row and t not in seen:
                    seen.add(t)
                    queue.append(t)
        chunk = np.empty(len(p), np.int64)
        chunk[order] = np.arange(len(p)) // most
        return pdf.assign(comp=pd.Series(p).groupby(chunk).transform("min").to_numpy())

    columns = "image_id long, z int, y int, x int, p long, label long, comp long"
    done = large.select("image_id", "z", "y", "x", "p", "label", "comp").groupBy("image_id", "comp").applyInPandas(chunks, columns)
    return cut(cells.join(sizes.where(F.col("size") <= most).select("image_id", "comp"), ["image_id", "comp"]).select(*done.columns).union(done))


def _merge(least: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        around: dict[int, list[int]] = {int(c): [int(v) for v in n] for c, n in zip(pdf["comp"], pdf["near"])}
        size = dict(zip(pdf["comp"].astype(int), pdf["size"].astype(int)))
        number: dict[int, int] = {}
        waiting, fresh = [], 0
        for c in sorted(size):
            if size[c] >= least:
                number[c], fresh = fresh, fresh + 1
            elif known := [number[n] for n in around[c] if n in number]:
                number[c] = min(known)
            else:
                waiting.append(c)
        while waiting:
            left = []
            for c in waiting:
                if known := [number[n] for n in around[c] if n in number]:
                    number[c] = min(known)
                else:
                    left.append(c)
            if len(left) == len(waiting):  # an image of small components only
                number[left[0]], fresh = fresh, fresh + 1
                left = left[1:]
            waiting = left
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "comp": list(number), "merged": list(number.values())})

    return run


def _numbered(sizes: DataFrame, faces: DataFrame, plan: SlicPlan) -> DataFrame:
    """image_id, comp, segment of components (image_id, comp, size) with faces (image_id, a, b): merged, then numbered by their first pixels, which are their names."""
    if plan.min_size > 0:
        pairs = faces.select("image_id", F.col("a").alias("comp"), "b").union(faces.select("image_id", F.col("b"), F.col("a"))).groupBy("image_id", "comp").agg(F.array_sort(F.collect_set("b")).alias("near"))
        graph = sizes.join(pairs, ["image_id", "comp"], "left").select("image_id", "comp", "size", F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))
        merged = cut(graph.groupBy("image_id").applyInPandas(_merge(plan.min_size), "image_id long, comp long, merged long"))
    else:
        merged = sizes.select("image_id", "comp", F.col("comp").alias("merged"))
    first = merged.groupBy("image_id", "merged").agg(F.min("comp").alias("first"))
    dense = first.select("image_id", "merged", (F.dense_rank().over(Window.partitionBy("image_id").orderBy("first")) - 1).cast("long").alias("segment"))
    return merged.join(dense, ["image_id", "merged"]).select("image_id", "comp", "segment")


def enforce(labels: DataFrame, plan: SlicPlan) -> DataFrame:
    """image_id, z, y, x, label: connected segments numbered from 0 in raster order of their first pixels.

    Components under min_size go, in raster order, to their lowest-numbered face neighbour; those that come
    before any of their neighbours wait until the others are numbered. The order is sequential, so
    one task walks an image's graph of components, which has no pixels in it. Pixels are counted by part of a tile and give their
    inner faces once; all else happens between parts, until each pixel gets the segment of its part.
    """
    cells, roots, rims = tiled_components(labels, plan)
    parts = cut(_rooted(cells.groupBy("image_id", "local").agg(F.count("*").alias("size")), roots))
    sizes = parts.groupBy("image_id", "comp").agg(F.sum("size").alias("size"))
    if 0 < plan.max_size and not sizes.where(F.col("size") > plan.max_size).isEmpty():
        whole = split_large(_rooted(cells, roots), plan)
        counts = whole.groupBy("image_id", "comp").agg(F.count("*").alias("size"))
        segments = _numbered(counts, _neighbours(whole, plan, "comp").select("image_id", "a", "b"), plan)
        return whole.join(segments, ["image_id", "comp"]).select("image_id", "z", "y", "x", F.col("segment").alias("label"))
    ahead = F.filter(F.array("next_z", "next_y", "next_x"), lambda v: v >= 0)
    faces = cells.where("next_z >= 0 or next_y >= 0 or next_x >= 0").select("image_id", F.col("local").alias("a"), F.explode(ahead).alias("b")).distinct()
    if rims is not None:
        faces = faces.union(rims.select("image_id", "a", "b"))
    faces = _rooted(_rooted(faces, roots, "a", "a"), roots, "b", "b").select("image_id", "a", "b").where("a <> b").distinct()
    segments = parts.join(_numbered(sizes, faces, plan), ["image_id", "comp"]).select("image_id", "local", "segment")
    return cells.join(segments, ["image_id", "local"]).select("image_id", "z", "y", "x", F.col("segment").alias("label"))
