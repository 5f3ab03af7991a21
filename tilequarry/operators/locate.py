"""Connected components inside tiles, as horizontal runs of cells.

A region is a maximal 4-connected set of cells of one class.  It is kept as runs
(y, x0, x1), half open, in image coordinates; area, perimeter, centroid and box are
exact sums over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import dealt, shuffle_width

RUNS = "image_id long, tile_id long, rid long, label int, y long, x0 long, x1 long"
#: Regions a tile can number; rid = tile_id * REGIONS + number, so ids sort by tile.
REGIONS = 1 << 24


def united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each node's component over links (a, b), as its smallest node; ``root`` is 0, 1, ..."""
    while len(a):  # smallest label over edges, then pointers to pointers
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            break
    return root


def label_runs(group: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """For disjoint runs sorted by (group, y, x0), of which touching ones in a row differ
    in class: each run's region as the first run of the region."""
    n = len(x0)
    root = np.arange(n)
    if not n:
        return root
    new_row = np.ones(n, bool)
    new_row[1:] = (group[1:] != group[:-1]) | (y[1:] != y[:-1])
    row_start = np.flatnonzero(new_row)
    row_of = np.cumsum(new_row) - 1
    follows = np.zeros(len(row_start), bool)  # whether the next row lies right below
    follows[:-1] = (group[row_start[1:]] == group[row_start[:-1]]) & (y[row_start[1:]] == y[row_start[:-1]] + 1)
    low = int(x0.min())
    width = int(x1.max()) - low + 2
    begin, stop = row_of * width + (x0 - low), row_of * width + (x1 - low)
    # runs of the next row that overlap: those that end after this one begins and begin before it ends
    first, last = np.searchsorted(stop, begin + width, "right"), np.searchsorted(begin, stop + width, "left")
    many = np.where(follows[row_of], np.maximum(last - first, 0), 0)
    a = np.repeat(np.arange(n), many)
    b = np.arange(len(a)) + np.repeat(first - (np.cumsum(many) - many), many)
    same = cls[a] == cls[b]
    return united(root, a[same], b[same])


def _joined(image, tile, y, x0, x1, cls) -> list[np.ndarray]:
    """The same cells with runs that continue the one before joined to it."""
    fresh = np.ones(len(y), bool)
    fresh[1:] = (image[1:] != image[:-1]) | (tile[1:] != tile[:-1]) | (y[1:] != y[:-1]) | (x0[1:] != x1[:-1]) | (cls[1:] != cls[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(y))[: len(first)] - 1
    return [image[first], tile[first], y[first], x0[first], x1[last], cls[first]]


def _apart(image, tile, y, x0, x1, cls) -> list[np.ndarray]:
    """Sorted runs without overlaps: a cell that is there more than once has its
    smallest class."""
    over = np.zeros(len(y), bool)
    if len(y) > 1:
        over[1:] = (image[1:] == image[:-1]) & (tile[1:] == tile[:-1]) & (y[1:] == y[:-1]) & (x0[1:] < x1[:-1])
    if not over.any():
        return [image, tile, y, x0, x1, cls]
    size = x1 - x0
    x = np.arange(int(size.sum())) + np.repeat(x0 - (np.cumsum(size) - size), size)
    image, tile, y, cls = (np.repeat(c, size) for c in (image, tile, y, cls))
    order = np.lexsort((cls, x, y, tile, image))
    image, tile, y, x, cls = (c[order] for c in (image, tile, y, x, cls))
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (tile[1:] != tile[:-1]) | (image[1:] != image[:-1])
    image, tile, y, x, cls = (c[fresh] for c in (image, tile, y, x, cls))
    return [image, tile, y, x, x + 1, cls]


def runs(cells: DataFrame, background: int = -1) -> DataFrame:
    """Runs of all regions of ``cells`` (image_id, tile_id, y, x, cls) but those of
    class ``background``.  Cells that follow one another where they are read become
    runs before they are dealt, by (image, tile), so an image stored row by row moves a
    row a run; many small tiles share a batch."""
    names = ["image_id", "tile_id", "y", "x0", "x1", "cls"]

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            image, tile, y, x, cls = (batch.column(c).to_numpy() for c in ("image_id", "tile_id", "y", "x", "cls"))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _joined(image, tile, y, x, x + 1, cls)], names)

    def regions(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        image, tile, y, x0, x1, cls = _joined(*_apart(*(np.concatenate([p.column(c).to_numpy() for p in parts]) for c in names)))
        change = np.ones(len(image), bool)
        change[1:] = (image[1:] != image[:-1]) | (tile[1:] != tile[:-1])
        group = np.cumsum(change) - 1
        root = label_runs(group, y, x0, x1, cls)
        heads = np.unique(root)  # in order of the first cell, so of (tile, y, x)
        of_group = group[heads]
        number = np.arange(len(heads)) - np.searchsorted(of_group, of_group)
        rid = tile * REGIONS + number[np.searchsorted(heads, root)]
        return pa.RecordBatch.from_arrays([pa.array(image), pa.array(tile), pa.array(rid), pa.array(cls, pa.int32()), pa.array(y), pa.array(x0), pa.array(x1)], [c.split()[0] for c in RUNS.split(", ")])

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            image, tile = batch.column("image_id").to_numpy(), batch.column("tile_id").to_numpy()
            change = np.flatnonzero((image[1:] != image[:-1]) | (tile[1:] != tile[:-1])) + 1
            if held:
                end = held[-1]
                if (end.column("image_id")[-1].as_py(), end.column("tile_id")[-1].as_py()) != (image[0], tile[0]):
                    yield regions(held)
                    held = []
            if len(change):
                held.append(batch.slice(0, change[-1]))
                yield regions(held)
                held = [batch.slice(change[-1])]
            else:
                held.append(batch)
        if held:
            yield regions(held)

    cells = cells.where((F.col("cls") != background) & F.col("cls").isNotNull()).select("image_id", "tile_id", F.col("y").cast("long"), F.col("x").cast("long"), F.col("cls").cast("int"))
    rows = cells.mapInArrow(narrowed, "image_id long, tile_id long, y long, x0 long, x1 long, cls int").repartition(shuffle_width(cells.sparkSession), "image_id", "tile_id")
    return rows.sortWithinPartitions("image_id", "tile_id", "y", "x0", "cls").mapInArrow(located, RUNS)


def measures(runs_df: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, area, perimeter, cx, cy, minx, miny, maxx, maxy).  The perimeter
    counts exposed cell edges, those of holes included."""
    keys = keys or ("image_id", "tile_id", "rid")
    width = F.col("x1") - F.col("x0")
    below = runs_df.select(*keys, (F.col("y") - 1).alias("y"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1"))
    touch = runs_df.join(dealt(below), [*keys, "y"]).where("bx0 < x1 AND bx1 > x0").groupBy(*keys).agg(F.sum(F.least("x1", "bx1") - F.greatest("x0", "bx0")).alias("vertical"))
    out = runs_df.groupBy(*keys).agg(F.first("label").alias("label"), F.sum(width).alias("area"), F.sum(width - 1).alias("horizontal"), F.sum(width * (F.col("x0") + F.col("x1")) / 2).alias("sx"), F.sum(width * (F.col("y") + 0.5)).alias("sy"), F.min("x0").alias("minx"), F.min("y").alias("miny"), F.max("x1").alias("maxx"), (F.max("y") + 1).alias("maxy"))
    out = out.join(dealt(touch), list(keys), "left")
    perimeter = 4 * F.col("area") - 2 * (F.col("horizontal") + F.coalesce("vertical", F.lit(0)))
    return out.select(*keys, "label", "area", perimeter.alias("perimeter"), (F.col("sx") / F.col("area")).alias("cx"), (F.col("sy") / F.col("area")).alias("cy"), "minx", "miny", "maxx", "maxy")


def representative(runs_df: DataFrame, *keys: str) -> DataFrame:
    """A cell of each region: its first in (y, x) order."""
    keys = keys or ("image_id", "tile_id", "rid")
    return runs_df.groupBy(*keys).agg(F.min(F.struct("y", "x0")).alias("p")).select(*keys, F.col("p.y").alias("y"), F.col("p.x0").alias("x"))
