"""What has to hold at any size, read off plans and small cases: no join that grows with
the rules, no broadcast of growing tables, no call a region."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilequarry import tables
from tilequarry.errors import TileReadError
from tilequarry.functions import geometry, regions
from tilequarry.operators import dispatch, locate, merge, segment, tiling, whole
from tilequarry.plans import workflow


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_staged_rules_do_not_pile_up_joins(spark):
    rows = spark.createDataFrame([(1, 9), (2, 5), (2, 1), (3, 1), (None, 9), (4, 0)], "id long, w long")
    rules = [lambda d: d.where("w > 6"), lambda d: d.where("w > 3").unionByName(d.sparkSession.createDataFrame([(1, 0), (7, 0)], d.schema)), lambda d: d.where("w > 0")]
    out = dispatch.staged(rows, rules, ["a", "b", "c"], ["id"])
    assert plan(out).count("SortMergeJoin") == 1 and "Broadcast" not in plan(out)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 9, "a"), (2, 5, "b"), (2, 1, "b"), (3, 1, "c"), (None, 9, None), (4, 0, None)], key=str)
    assert dispatch.staged(rows, [], [], ["id"]).select("dispatch").distinct().collect() == [(None,)]


def test_growing_tables_are_not_broadcast(spark):
    cells = spark.createDataFrame([(1, 1, 0, x, 1) for x in (0, 1, 3)] + [(1, 2, 0, x, 1) for x in (4, 5)], "image_id long, tile_id long, y long, x long, cls int")
    images = spark.createDataFrame([(1, 8, 1, 1)], "image_id long, width long, height long, channels int")
    tiles = tiling.tiles(images, tiling.Grid(4, 4, 0))
    runs = locate.runs(cells, 0)
    regions = merge.boxes(runs)
    merged = merge.merge(runs, tiles, 1)
    near = merge.candidates(regions, tiles, 1)
    member = merge.objects_of(regions, merge.links(near, runs, 1))
    wins = spark.createDataFrame([(7, 1, 3, "0", 0, 0, 4, 1)], "window_id long, image_id long, parent long, stage string, off_x long, off_y long, width long, height long")
    pixels = spark.createDataFrame([(1, 0, 0, 1.0)], "image_id long, y long, x long, v double")
    cut = workflow.window_rasters(wins, pixels, merged.withColumn("stage", F.lit("0")))[1]
    for df in (near, member, merge.links(near, runs, 1), merge.object_labels(regions, member), merged, locate.measures(merged, "image_id", "object_id"), cut):
        assert "Join" in plan(df) and "Broadcast" not in plan(df)
    found = merged.groupBy("object_id", "label").agg(F.sum(F.col("x1") - F.col("x0")).alias("n")).collect()
    assert sorted(r.n for r in found) == [2, 3]


@pytest.fixture
def short_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_outlines_without_a_call_a_region(spark, short_batches):
    draw = random.Random(5)
    own = {(i, r): sorted((y, x, x + 1) for y in range(5) for x in range(0, 9, 2) if (y, x) == (0, 0) or draw.random() < 0.5) for i in (1, 2, 3) for r in range(4)}
    runs = spark.createDataFrame([(*k, y + k[1], a + k[0], b + k[0]) for k, rs in own.items() for y, a, b in rs], "image_id long, rid long, y long, x0 long, x1 long")
    out = geometry.shapes(runs, "image_id", "rid")
    moved = {k: [(y + k[1], a + k[0], b + k[0]) for y, a, b in rs] for k, rs in own.items()}
    assert sorted(map(tuple, out.collect())) == sorted((*k, geometry.wkt(rs), geometry.circularity(rs)) for k, rs in moved.items())
    assert "Groups" not in plan(out)


@pytest.mark.parametrize("size", [1, 2])
def test_models_without_a_task_call_a_tile(spark, short_batches, size):
    rows = [(i, t, 0, x, float(i + t + x)) for i in (1, 2) for t in range(1, 6) for x in range(t * 3)]

    def model(frames):
        if any(f.image_id.iloc[0] == 2 and f.tile_id.iloc[0] == 3 for f in frames):
            raise TileReadError("third")
        assert len(frames) <= size and all(f.tile_id.nunique() == 1 and list(f.index) == list(range(len(f))) for f in frames if size == 1)
        return [f.assign(cls=len(f))[["image_id", "tile_id", "y", "x", "cls"]] for f in frames]

    tiles = spark.createDataFrame(rows, "image_id long, tile_id long, y long, x long, v double")
    out = segment.by_batch(tiles, model, "image_id long, tile_id long, y long, x long, cls int", size)
    assert sorted(map(tuple, out.collect())) == sorted((i, t, y, x, t * 3) for i, t, y, x, _ in rows if (i, t) != (2, 3))
    assert "Groups" not in plan(out)


def test_polygons_are_dealt_to_all_partitions(spark):
    square = [[{"x": 0.0, "y": 0.0}, {"x": 3.0, "y": 0.0}, {"x": 3.0, "y": 3.0}, {"x": 0.0, "y": 3.0}]]
    polygons = spark.createDataFrame([(k, square) for k in range(5)], "image_id long, rings array<array<struct<x: double, y: double>>>")
    out = regions.from_polygons(polygons, "image_id", fill_holes=True)
    assert out.count() == 15 and plan(out).split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2
    assert plan(out).split("Initial Plan")[-1].count("REPARTITION_BY_NUM") == 2  # else a few tasks hold all


def _drawn(images: int, seed: int):
    """Random cells in tiles of 6 x 5 that share 2 columns and rows, of images of two sizes."""
    draw = random.Random(seed)
    sizes = {i: (draw.choice([5, 17]), draw.choice([4, 14])) for i in range(images)}
    cells = [(i, y, x, draw.choice([0, 0, 0, 1, 1, 2])) for i, (w, h) in sizes.items() for y in range(h) for x in range(w)]
    return [(i, w, h, 1) for i, (w, h) in sizes.items()], cells


@pytest.mark.parametrize(("tolerance", "labelled"), [(0, True), (1, True), (2.5, False)])
def test_whole_images_merge_as_by_joins(spark, short_batches, tolerance, labelled, monkeypatch):
    sizes, cells = _drawn(12, 3)
    images = spark.createDataFrame(sizes, "image_id long, width long, height long, channels int")
    pixels = spark.createDataFrame(cells, "image_id long, y long, x long, cls int")
    grid = tiling.Grid(6, 5, 2)
    tiles = tiling.tiles(images, grid)
    runs = locate.runs(tiling.tile_pixels(images, pixels, grid), 0).localCheckpoint()
    runs = runs if labelled else runs.withColumn("label", F.expr("nullif(rid % 3, 2)").cast("int"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    joined = merge.merge_by_joins(runs, tiles, tolerance, labelled)
    monkeypatch.setattr(whole, "BATCH", 40)
    for one_task in (1 << 19, 150):
        found = merge.merge(runs, tiles, tolerance, labelled, one_task)
        assert rows(found) == rows(joined) and found.schema == joined.schema
    assert joined.select("image_id").distinct().count() == 12


def test_small_images_are_merged_without_a_join_of_runs(spark):
    sizes, cells = _drawn(12, 3)
    images = spark.createDataFrame(sizes, "image_id long, width long, height long, channels int")
    runs = locate.runs(spark.createDataFrame(cells, "image_id long, y long, x long, cls int").withColumn("tile_id", F.lit(1).cast("long")), 0)
    before = len(tables._kept.get(spark.sparkContext.applicationId, []))
    out = merge.merge(runs, tiling.tiles(images, tiling.Grid(20, 20, 2)), 1)
    assert len(tables._kept[spark.sparkContext.applicationId]) == before + 1
    assert plan(out).split("Initial Plan")[-1].count("SortMergeJoin") == 1
    assert plan(out).split("Initial Plan")[-1].count("REPARTITION_BY_NUM") == 1


@pytest.mark.parametrize("tolerance", [1, 2.5])
def test_runs_that_meet_are_found_in_parts(tolerance, monkeypatch):
    draw = np.random.default_rng(4)
    side = lambda n: [draw.integers(0, 9, n), draw.integers(0, 2, n), draw.integers(0, 2, n), draw.integers(-5, 8, n), draw.integers(-9, 30, n)]
    a, b = ([*c, c[4] + draw.integers(1, 9, len(c[0]))] for c in (side(60), side(70)))
    gap = lambda p, q: max(p[4] - q[5], q[4] - p[5], 0) ** 2 + max(abs(p[3] - q[3]) - 1, 0) ** 2
    for labelled in (True, False):
        near = {(p[0], q[0]) for p in zip(*a) for q in zip(*b) if p[1] == q[1] and (p[2] == q[2] or not labelled) and gap(p, q) < tolerance**2}
        for pairs in (7, 1 << 20):
            monkeypatch.setattr(whole, "PAIRS", pairs)
            assert {tuple(r) for part in whole._met(a, b, tolerance, labelled) for r in part} == near
