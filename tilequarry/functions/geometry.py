"""Outlines, WKT and shape measures of regions kept as runs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..tables import shuffle_width

#: Outlines of regions of that many runs are kept for others of the same shape.
SMALL_RUNS = 12


def rings(runs: list[tuple[int, int, int]]) -> list[list[tuple[int, int]]]:
    """Closed corner rings of runs (y, x0, x1): outlines clockwise on the screen,
    holes the other way; at corners where cells meet, rings stay apart."""
    cells = {(y, x) for y, a, b in runs for x in range(a, b)}
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for y, x in cells:  # each exposed side, the cell on its right
        for (oy, ox), a, b in (((y - 1, x), (x, y), (x + 1, y)), ((y, x + 1), (x + 1, y), (x + 1, y + 1)), ((y + 1, x), (x + 1, y + 1), (x, y + 1)), ((y, x - 1), (x, y + 1), (x, y))):
            if (oy, ox) not in cells:
                edges.setdefault(a, []).append(b)
    out = []
    for start in sorted(edges):
        while start in edges:
            at, ring, heading = start, [start], None
            while True:
                options = edges[at]
                if heading is not None and len(options) > 1:  # turn right: stay with the same cell
                    options.sort(key=lambda b: -(heading[0] * (b[1] - at[1]) - heading[1] * (b[0] - at[0])))
                to = options.pop(0)
                if not options:
                    del edges[at]
                step = (to[0] - at[0], to[1] - at[1])
                if step == heading:
                    ring[-1] = to
                else:
                    ring.append(to)
                at, heading = to, step
                if at == start:
                    break
            if len(ring) > 3 and (ring[1][0] - ring[0][0]) * (ring[-1][1] - ring[-2][1]) == (ring[1][1] - ring[0][1]) * (ring[-1][0] - ring[-2][0]):
                ring = [*ring[1:-1], ring[1]]
            out.append(ring)
    return out


def signed_area(ring: list[tuple[int, int]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def polygons(runs: list[tuple[int, int, int]]) -> list[list[list[tuple[int, int]]]]:
    """Shells of a region, each with its holes."""
    found = rings(runs)
    shells = [r for r in found if signed_area(r) > 0]
    holes = [r for r in found if signed_area(r) < 0]
    parts: list[list[list[tuple[int, int]]]] = [[s] for s in shells]
    for hole in holes:
        inside = [p for p in parts if _covers(p[0], hole)]
        (min(inside, key=lambda p: signed_area(p[0])) if inside else parts[0]).append(hole)
    return parts


def wkt(runs: list[tuple[int, int, int]]) -> str:
    """POLYGON or MULTIPOLYGON of a region."""
    return _text(polygons(runs), 0, 0)


def _text(parts: list[list[list[tuple[int, int]]]], dx: int, dy: int) -> str:
    text = ["(" + ", ".join("(" + ", ".join(f"{x + dx} {y + dy}" for x, y in ring) + ")" for ring in part) + ")" for part in parts]
    return f"POLYGON {text[0]}" if len(text) == 1 else f"MULTIPOLYGON ({', '.join(text)})" if text else "POLYGON EMPTY"


def _covers(shell: list[tuple[int, int]], hole: list[tuple[int, int]]) -> bool:
    px, py = (hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2
    py += 0.25 if hole[0][1] == hole[1][1] else 0.0
    px += 0.25 if hole[0][0] == hole[1][0] else 0.0
    hit = False
    for (ax, ay), (bx, by) in zip(shell, shell[1:]):
        if (ay > py) != (by > py) and px < ax + (py - ay) / (by - ay) * (bx - ax):
            hit = not hit
    return hit


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of integer points, in order."""
    pts = sorted(map(tuple, points.tolist()))
    if len(pts) < 3:
        return np.array(pts)

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def circularity(runs: list[tuple[int, int, int]]) -> float:
    """4 pi area / perimeter squared of the convex hull: near 1 for discs, pi / 4 for
    squares, whatever the staircase of their pixels."""
    h = hull(np.array(list({(x, y + d) for y, a, b in runs for x in (a, b) for d in (0, 1)})))
    step = np.roll(h, -1, axis=0) - h
    area = abs(float((h[:, 0] * np.roll(h[:, 1], -1) - np.roll(h[:, 0], -1) * h[:, 1]).sum())) / 2
    return 4 * math.pi * area / float(np.hypot(step[:, 0], step[:, 1]).sum()) ** 2


def _shape(runs: tuple[tuple[int, int, int], ...]) -> tuple[list, float]:
    return polygons(runs), circularity(runs)


_known = lru_cache(maxsize=1 << 15)(_shape)


def shape(runs: list[tuple[int, int, int]]) -> tuple[str, float]:
    """(wkt, circularity).  Both are found with the region moved to the origin, so that
    small regions of one shape share the work."""
    dy, dx = min(r[0] for r in runs), min(r[1] for r in runs)
    own = tuple((y - dy, a - dx, b - dx) for y, a, b in runs)
    parts, round_ = (_known if len(own) <= SMALL_RUNS else _shape)(own)
    return _text(parts, dx, dy), round_


def shapes(runs: DataFrame, *keys: str) -> DataFrame:
    """(keys, wkt, circularity) of each region; one region and a batch of rows are in
    memory at a time."""
    schema = ", ".join([*(f"`{k}` {runs.schema[k].dataType.simpleString()}" for k in keys), "wkt string, circularity double"])
    names = [*keys, "wkt", "circularity"]

    def outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, kinds = None, [], None

        def emitted(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, pa.string(), pa.float64()])], names)

        for batch in batches:
            kinds, rows = [batch.schema.field(k).type for k in keys], []
            at = zip(*(batch.column(k).to_pylist() for k in keys)) if keys else [()] * batch.num_rows
            for k, run in zip(at, zip(*(batch.column(c).to_pylist() for c in ("y", "x0", "x1")))):
                if k != key:
                    if own:
                        rows.append((*key, *shape(own)))
                    key, own = k, []
                own.append(run)
            if rows:
                yield emitted(rows)
        if own:
            yield emitted([(*key, *shape(own))])

    rows = runs.select(*keys, "y", "x0", "x1").repartition(shuffle_width(runs.sparkSession) if keys else 1, *keys)
    return rows.sortWithinPartitions(*keys, "y", "x0").mapInArrow(outlined, schema)
