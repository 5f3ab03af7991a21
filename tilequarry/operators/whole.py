"""Objects of whole images: what ``merge`` does by joins, over arrays of many images at
once, for images small enough to lie in one task's memory."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import shuffle_width
from .locate import united

#: Rows that are gathered before a call, each counted as often as closing spreads it, and
#: pairs of runs that are compared at once.
BATCH = 1 << 18
PAIRS = 1 << 20
#: A label that is null; larger than any other.
NONE = 1 << 40


def covered(key: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int, least: int) -> list[np.ndarray]:
    """As regions.covered, over arrays with one key."""
    rows = 2 * reach + 1
    at = (y[:, None] + np.arange(-reach, reach + 1)).ravel()
    key, y, x = np.tile(np.repeat(key, rows), 2), np.tile(at, 2), np.concatenate([np.repeat(x0, rows), np.repeat(x1, rows)])
    d = np.repeat([1, -1], len(at))
    order = np.lexsort((x, y, key))
    key, y, x, d = key[order], y[order], x[order], d[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(fresh)
    inside = np.cumsum(np.add.reduceat(d, first)) >= least if len(first) else np.zeros(0, bool)
    before = np.zeros(len(inside), bool)  # a row's ends add up to 0, so none begins inside
    before[1:] = inside[:-1]
    begin, end = first[inside & ~before], first[before & ~inside]
    return [key[begin], y[begin], x[begin], x[end]]


def closed(key: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> list[np.ndarray]:
    """As merge.closed, over arrays with one key."""
    key, y, x0, x1 = covered(key, y, x0 - reach, x1 + reach, reach, 1)
    x0, x1 = x0 + reach, x1 - reach
    kept = x0 < x1
    return covered(key[kept], y[kept], x0[kept], x1[kept], reach, 2 * reach + 1)


def _dense(image: np.ndarray, number: np.ndarray) -> np.ndarray:
    """One number from 0 for each pair."""
    values, number = np.unique(number, return_inverse=True)
    return np.unique(image * len(values) + number, return_inverse=True)[1]


def _met(a: list[np.ndarray], b: list[np.ndarray], tolerance: float, labelled: bool) -> Iterator[np.ndarray]:
    """Pairs of regions, (a, b) a row, of runs nearer than the tolerance.  Both sides are
    (region, tile, label, y, x0, x1); a run of ``a`` meets those of ``b`` in its tile
    whose rows and begins are near."""
    reach = math.ceil(tolerance)
    low, high = min(a[3].min(), b[3].min()) - reach, max(a[3].max(), b[3].max()) + reach
    row_of = lambda tile, y: tile * (high - low + 1) + (y - low)
    order = np.lexsort((b[4], b[3], b[1]))
    b = [c[order] for c in b]
    rows, row = np.unique(row_of(b[1], b[3]), return_inverse=True)
    left = b[4].min()
    wide = b[4].max() - left + 2
    begins = row * wide + (b[4] - left)
    longest = (b[5] - b[4]).max()
    for dy in range(-reach, reach + 1):
        want = row_of(a[1], a[3] + dy)
        row = np.minimum(np.searchsorted(rows, want), len(rows) - 1)
        k = np.flatnonzero(rows[row] == want)
        row = row[k]
        first = np.searchsorted(begins, row * wide + np.clip(a[4][k] - reach - longest - left, 0, wide - 1))
        last = np.searchsorted(begins, row * wide + np.clip(a[5][k] + reach - left, 0, wide - 1))
        many = np.maximum(last - first, 0)
        total = np.cumsum(many)
        start = 0
        while start < len(k):
            done = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, done + PAIRS, "right")))
            n = many[start:stop]
            p = np.repeat(k[start:stop], n)
            q = np.arange(len(p)) + np.repeat(first[start:stop] - (np.cumsum(n) - n), n)
            gap_x = np.maximum(np.maximum(a[4][p] - b[5][q], b[4][q] - a[5][p]), 0)
            gap_y = max(abs(dy) - 1, 0)
            near = gap_x * gap_x + gap_y * gap_y < tolerance * tolerance
            if labelled:
                near &= (a[2][p] == b[2][q]) & (a[2][p] != NONE)
            yield np.unique(np.stack([a[0][p[near]], b[0][q[near]]], 1), axis=0)
            start = stop


def _objects(image, side, tile, rid, label, y, x0, x1, tolerance: float, labelled: bool) -> list[np.ndarray] | None:
    """(image, object, label, y, x0, x1) of the rows that ``merged`` deals out, of whole
    images; None without runs."""
    of_tile = _dense(np.tile(image, 2), np.concatenate([tile, np.where(side, rid, tile)]))
    of_tile, of_other = of_tile[: len(tile)], of_tile[len(tile) :]
    across, begin, other, a_from, b_to = label[side], of_tile[side], of_other[side], y[side], x0[side]
    image, of_tile, rid, label, y, x0, x1 = (c[~side] for c in (image, of_tile, rid, label, y, x0, x1))
    if not len(image):
        return None
    order = np.lexsort((x0, y, rid, image))
    image, of_tile, rid, label, y, x0, x1 = (c[order] for c in (image, of_tile, rid, label, y, x0, x1))
    fresh = np.ones(len(image), bool)
    fresh[1:] = (image[1:] != image[:-1]) | (rid[1:] != rid[:-1])
    head = np.flatnonzero(fresh)
    region = np.cumsum(fresh) - 1
    low = {1: np.minimum.reduceat(x0, head), 0: y[head]}
    high = {1: np.maximum.reduceat(x1, head), 0: np.maximum.reduceat(y, head) + 1}
    home = of_tile[head]
    root = np.arange(len(head))
    linked = []
    for way in (1, 0) if tolerance > 0 else ():
        sides = across == way
        n = max(int(home.max()), int(begin[sides].max(initial=0)), int(other[sides].max(initial=0))) + 1
        after, before = np.full(n, -1), np.full(n, -1)
        after[begin[sides]] = np.flatnonzero(sides)
        before[other[sides]] = np.flatnonzero(sides)
        s, t = after[home], before[home]
        reaches = s >= 0
        reaches[reaches] = high[way][reaches] >= a_from[s[reaches]]
        reached = t >= 0
        reached[reached] = low[way][reached] <= b_to[t[reached]]
        a, b = np.flatnonzero(reaches[region]), np.flatnonzero(reached[region])
        if len(a) and len(b):
            rest = lambda k: [label[k], y[k], x0[k], x1[k]]
            linked += _met([region[a], other[s[region[a]]], *rest(a)], [region[b], of_tile[b], *rest(b)], tolerance, labelled)
    if linked:
        pairs = np.concatenate(linked)
        root = united(root, pairs[:, 0], pairs[:, 1])
    many = np.bincount(root, minlength=len(root))[root] > 1
    named = label[head]
    if not labelled and many.any():  # the label with the largest area, of equals the smallest
        area = np.add.reduceat(x1 - x0, head)
        k = np.flatnonzero(many)
        k = k[np.lexsort((named[k], root[k]))]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (root[k][1:] != root[k][:-1]) | (named[k][1:] != named[k][:-1])
        first = np.flatnonzero(fresh)
        each, size = k[first], np.add.reduceat(area[k], first)
        best = np.lexsort((named[each], -size, root[each]))[::-1]  # an object's best comes last
        chosen = named.copy()
        chosen[root[each[best]]] = named[each[best]]
        named = chosen
    joined = many[region]
    one, more = np.flatnonzero(~joined), np.flatnonzero(joined)
    of, yc, c0, c1 = closed(root[region[more]], y[more], x0[more], x1[more], math.ceil(tolerance))
    of = np.concatenate([region[one], of])
    return [image[head][of], rid[head][of], named[of], np.concatenate([y[one], yc]), np.concatenate([x0[one], c0]), np.concatenate([x1[one], c1])]


def merged(runs: DataFrame, sides: DataFrame, tolerance: float, labelled: bool) -> DataFrame:
    """(image_id, object_id, label, y, x0, x1) as ``merge`` has them, of ``runs`` (image_id,
    tile_id, rid, label, y, x0, x1) and ``sides`` (image_id, tile_id, other, across, a_from,
    b_to) of the tiles.  Both are dealt by image in one shuffle and read as a stream; a
    call gets many images, or one."""
    kinds = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
    schema = f"image_id {kinds['image_id']}, object_id {kinds['rid']}, label int, y {kinds['y']}, x0 {kinds['x0']}, x1 {kinds['x1']}"
    long = lambda c, name: F.col(c).cast("long").alias(name)
    as_rows = sides.select("image_id", F.lit(True).alias("side"), long("tile_id", "tile_id"), long("other", "rid"), long("across", "label"), F.ceil("a_from").cast("long").alias("y"), F.floor("b_to").cast("long").alias("x0"), F.lit(0).cast("long").alias("x1"))
    own = runs.where("image_id IS NOT NULL AND rid IS NOT NULL").select("image_id", F.lit(False).alias("side"), *[F.coalesce(F.col(c).cast("long"), F.lit(NONE if c == "label" else -1)).alias(c) for c in ("tile_id", "rid", "label", "y", "x0", "x1")])

    def called(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        images = table.column("image_id").combine_chunks().dictionary_encode()
        side = table.column("side").to_numpy()
        out = _objects(images.indices.to_numpy().astype(np.int64), side, *(table.column(c).to_numpy() for c in ("tile_id", "rid", "label", "y", "x0", "x1")), tolerance, labelled)
        if out is None:
            return
        image, rid, label, y, x0, x1 = out
        label = pa.array(np.where(label == NONE, 0, label), mask=label == NONE).cast(pa.int32())
        whole = pa.Table.from_arrays([images.dictionary.take(pa.array(image)), pa.array(rid), label, pa.array(y), pa.array(x0), pa.array(x1)], ["image_id", "object_id", "label", "y", "x0", "x1"])
        yield from whole.to_batches(max_chunksize=1 << 16)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            image = batch.column("image_id")
            if n >= BATCH:  # up to the last image that is there in whole
                fresh = [0] if held[-1].column("image_id")[-1] != image[0] else []
                fresh += (np.flatnonzero(np.asarray(pc.not_equal(image[1:], image[:-1]))) + 1).tolist()
                if fresh:
                    cut = fresh[-1]
                    yield from called([*held, batch.slice(0, cut)])
                    held, n, batch = [], 0, batch.slice(cut)
            held.append(batch)
            n += batch.num_rows * (2 * math.ceil(tolerance) + 1)
        if held:
            yield from called(held)

    dealt_out = own.unionByName(as_rows).repartition(shuffle_width(runs.sparkSession), "image_id").sortWithinPartitions("image_id")
    found = dealt_out.mapInArrow(streamed, "image_id {}, object_id long, label int, y long, x0 long, x1 long".format(kinds["image_id"]))
    return found.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")])
