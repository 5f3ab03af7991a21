"""Tilings, regions, merges and whole workflows on drawn images."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tilequarry.errors import ConflictingParts, ImageReadError, MissingPart, TileReadError
from tilequarry.functions import regions
from tilequarry.operators import dispatch, locate, merge, segment, tiling
from tilequarry.plans import workflow as wf
from tilequarry.plans.builder import ChainBuilder, DetectionBuilder, LabellingBuilder
from tilequarry.sources import rasters


def v():
    return F.col("v")


def dims(spark, *sizes):
    return spark.createDataFrame([(k, w, h, 1) for k, (w, h) in enumerate(sizes)], "image_id long, width long, height long, channels int")


def disc(y, x, r):
    """Cells of a drawn circle: those within r of the centre."""
    yy, xx = np.mgrid[y - r : y + r + 1, x - r : x + r + 1]
    on = (yy - y) ** 2 + (xx - x) ** 2 <= r * r + r
    return yy[on], xx[on]


def square(y, x, side):
    """Cells of a drawn square: corners included."""
    yy, xx = np.mgrid[y : y + side + 1, x : x + side + 1]
    return yy.ravel(), xx.ravel()


def drawn(spark, width, height, *shapes):
    """An image of (cells, value) shapes, whose black cells have no rows."""
    cells = pd.concat([pd.DataFrame({"image_id": 0, "y": y, "x": x, "v": float(value)}) for (y, x), value in shapes]).drop_duplicates(["y", "x"], keep="last") if shapes else None
    kind = "image_id long, y long, x long, v double"
    pixels = spark.createDataFrame([], kind) if cells is None else spark.createDataFrame(cells, kind)
    return dims(spark, (width, height)), pixels


def grid_of(spark, size, grid):
    return [r.asDict() for r in tiling.tiles(dims(spark, size), grid).orderBy("tile_id").collect()]


def test_windows_are_clipped(spark):
    asked = dims(spark, (2500, 1750)).crossJoin(spark.createDataFrame([(1250, 1300, 250, 300), (1250, 1300, 1000, 1000), (2400, 1650, 300, 300), (2500, 0, 9, 9)], "ox long, oy long, mw long, mh long"))
    found = tiling.window(asked, F.col("ox"), F.col("oy"), F.col("mw"), F.col("mh")).collect()
    assert [(r.w, r.h) for r in found[:1] if r.inside] and sorted((r.w, r.h) for r in found if r.inside) == [(100, 100), (250, 300), (1000, 450)]
    assert [r.inside for r in found if r.off_x == 2500] == [False]


@pytest.mark.parametrize("size, grid, shape, last", [((700, 700), tiling.Grid(700, 700, 100), (1, 1), (700, 700)), ((700, 700), tiling.Grid(300, 300, 100), (3, 3), (300, 300)), ((600, 450), tiling.Grid(300, 300, 100), (3, 2), (200, 250)), ((525, 450), tiling.Grid(175, 175, 0, "skip"), (3, 2), (175, 175)), ((450, 525), tiling.Grid(175, 175, 0, "skip"), (2, 3), (175, 175)), ((50, 100), tiling.Grid(45, 45, 0, "skip"), (1, 2), (45, 45)), ((50, 100), tiling.Grid(45, 45, 0, "extend"), (2, 3), (45, 45))])
def test_grids(spark, size, grid, shape, last):
    found = grid_of(spark, size, grid)
    assert (found[-1]["n_cols"], found[-1]["n_rows"]) == shape and len(found) == shape[0] * shape[1]
    assert (found[-1]["tile_w"], found[-1]["tile_h"]) == last
    assert [r["tile_id"] for r in found] == list(range(1, len(found) + 1))
    if grid.borders == "extend":
        assert {r["off_x"] for r in found} == {0, 5} and {r["off_y"] for r in found} == {0, 45, 55}
    elif grid.width == 300 and size == (700, 700):
        assert {r["off_x"] for r in found} == {0, 200, 400}


def test_neighbours(spark):
    of = lambda size, grid, k: tiling.neighbours(tiling.tiles(dims(spark, size), grid)).where(f"tile_id = {k}").first()
    assert of((700, 700), tiling.Grid(300, 300, 100), 5)[2:] == (2, 8, 4, 6)
    assert of((450, 525), tiling.Grid(175, 175, 0, "skip"), 4)[2:] == (2, 6, 3, None)


@pytest.mark.parametrize("n, many", [(5, 5), (1, 1), (10, 9), (9, 9)])
def test_batches_of_tiles(spark, n, many):
    found = tiling.batches(tiling.tiles(dims(spark, (600, 700)), tiling.Grid(300, 300, 100)), n).orderBy("tile_id").collect()
    batch = [r.batch for r in found]
    assert len(found) == 9 and batch == sorted(batch) and len(set(batch)) == many
    sizes = [batch.count(b) for b in sorted(set(batch))]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] - sizes[-1] <= 1


def located(spark, width, height, *shapes):
    images, pixels = drawn(spark, width, height, *shapes)
    runs = locate.runs(segment.semantic(tiling.tile_pixels(images, pixels, tiling.Grid(width, height, 0)), v().cast("int")), 0)
    return sorted(locate.measures(runs).collect(), key=lambda r: r.label)


def test_located_shapes(spark):
    assert located(spark, 600, 400) == []
    (box,) = located(spark, 600, 400, (np.mgrid[5:251, 5:301].reshape(2, -1), 255))
    assert (box.minx, box.miny, box.maxx, box.maxy, box.area, box.perimeter) == (5, 5, 301, 251, 246 * 296, 2 * (246 + 296))
    one, two = located(spark, 300, 200, (np.mgrid[3:126, 40:151].reshape(2, -1), 1), (disc(150, 250, 40), 2))
    assert (one.label, one.area, two.label) == (1, 123 * 111, 2) and abs(two.area / (math.pi * 40 * 41) - 1) < 0.025


def test_a_disc_cut_in_six_is_one_object(spark):
    images, pixels = drawn(spark, 1024, 768, (disc(360, 600, 250), 1))
    grid = tiling.Grid(512, 256, 0)
    runs = locate.runs(segment.semantic(tiling.tile_pixels(images, pixels, grid), v().cast("int")), 0)
    assert runs.select("rid").distinct().count() == 6
    merged = merge.merge(runs, tiling.tiles(images, grid), 5)
    assert merged.select("object_id").distinct().count() == 1
    found = {(r.y, x) for r in merged.collect() for x in range(r.x0, r.x1)}
    true = set(zip(*map(np.ndarray.tolist, disc(360, 600, 250))))
    assert true <= found and len(found - true) <= 0.002 * len(true)


@pytest.mark.parametrize("tolerance, labels, many", [(1, False, 1), (0, False, 4), (0.5, False, 1), (3, False, 1), (1, True, 2)])
def test_pieces_meet_by_tolerance_and_label(spark, tolerance, labels, many):
    """A square over four tiles, its lower half of another class."""
    cells = np.mgrid[6:14, 6:14].reshape(2, -1)
    images, pixels = drawn(spark, 20, 20, (cells, 1))
    grid = tiling.Grid(10, 10, 0)
    rule = F.when(F.col("y") < 10, 1).otherwise(2)
    runs = locate.runs(segment.semantic(tiling.tile_pixels(images, pixels, grid), rule), 0)
    merged = merge.merge(runs, tiling.tiles(images, grid), tolerance, labels)
    area = {r.object_id: r.area for r in locate.measures(merged, "image_id", "object_id").collect()}
    assert len(area) == many and sum(area.values()) == 64


def test_closing_equals_its_definition(spark):
    rng = np.random.default_rng(5)
    for reach in (1, 2):
        image = rng.random((14, 17)) < 0.4
        y, x = map(np.ndarray.tolist, np.nonzero(image))
        cells = spark.createDataFrame([(7, a, b) for a, b in zip(y, x)], "k long, y long, x long")
        found = merge.closed(regions.from_cells(cells, "k"), reach, "k").collect()
        on = set(zip(y, x))
        step = range(-reach, reach + 1)
        wide = {(a + i, b + j) for a, b in on for i in step for j in step}
        want = {(a, b) for a, b in wide if all((a + i, b + j) in wide for i in step for j in step)}
        assert {(r.y, c) for r in found for c in range(r.x0, r.x1)} == want
        assert len(found) == sum((a, b - 1) not in want for a, b in want)  # maximal runs


def circles_and_squares():
    area, perimeter = F.col("area"), F.col("perimeter")
    build = DetectionBuilder().set_segmenter((v() > 0).cast("int")).set_needs_pixels()
    shade = (F.when(v() > 200, 1).otherwise(0), F.lit(1.0))
    round_ = perimeter * perimeter > 17 * area  # a disc's staircase has its box's perimeter
    return build.add_classifier(round_, shade, "circle").add_classifier(~round_, shade)


def test_detection_of_drawn_shapes(spark):
    empty = circles_and_squares().get().process(*drawn(spark, 200, 200)).objects
    assert empty.collect() == []
    images = drawn(spark, 2000, 2000, (disc(500, 1500, 100), 255), (disc(1500, 600, 100), 127), (square(500, 500, 200), 255), (square(1500, 1500, 200), 127), (square(1000, 1000, 300), 255))
    found = circles_and_squares().get().process(*images).objects.collect()
    assert sorted((r.minx, r.dispatch, r.pred, r.proba) for r in found) == [(500, "1", 1, 1.0), (500, "circle", 0, 1.0), (1000, "1", 1, 1.0), (1400, "circle", 1, 1.0), (1500, "1", 0, 1.0)]
    assert {r.area for r in found if r.dispatch == "1"} == {201**2, 301**2}


def test_one_shot_and_undispatched(spark):
    images = drawn(spark, 1000, 1000, (disc(125, 125, 10), 255), (disc(750, 250, 25), 255), (square(250, 250, 26), 255), (square(750, 750, 50), 127))
    sized = lambda df: df.withColumn("dispatch", F.when(F.col("area") > 1000, "BIG").otherwise("SMALL"))
    build = DetectionBuilder().set_segmenter((v() > 0).cast("int")).set_one_shot_dispatcher(sized, {"SMALL": (F.lit(0), F.lit(1.0)), "BIG": (F.lit(1), F.lit(1.0))})
    found = build.get().process(*images).objects.orderBy("area").collect()
    assert [(r.dispatch, r.pred) for r in found] == [("SMALL", 0), ("SMALL", 0), ("BIG", 1), ("BIG", 1)]
    some = drawn(spark, 300, 100, (disc(40, 100, 25), 255), (disc(60, 200, 35), 255))
    big = DetectionBuilder().set_segmenter((v() > 0).cast("int")).add_classifier(F.col("area") > 2500, (F.lit(3), F.lit(0.5)), "big").get()
    found = big.process(*some).objects.orderBy("area").collect()
    assert [(r.dispatch, r.pred, r.proba) for r in found] == [(None, None, 0.0), ("big", 3, 0.5)]


def test_labelling_of_drawn_squares(spark):
    shapes = [(10, (10, 10), 85), (15, (50, 150), 255), (20, (130, 50), 190), (30, (10, 90), 85), (50, (70, 150), 190)]
    images = drawn(spark, 250, 200, *((square(a, b, side), value) for side, (a, b), value in shapes))
    flow = LabellingBuilder().set_segmenter(v().cast("int")).set_background_class(0).set_tile_size(100, 90).get()
    found = flow.process(*images).objects.collect()
    assert sum(r.label == 85 for r in found) == 2 and {r.area for r in found if r.label == 85} == {11**2, 31**2}
    big = drawn(spark, 250, 200, (square(10, 10, 180), 255))
    flow = LabellingBuilder().set_segmenter(v().cast("int")).set_background_class(0).set_tile_size(190, 190).set_border_tiles("extend").get()
    assert [(r.label, r.area) for r in flow.process(*big).objects.collect()] == [(255, 181**2)]


def test_a_model_of_tiles_gets_batches(spark):
    """Three tiles a call; calls of another size would find nothing."""

    def model(frames):
        full = [len(f) == 100 for f in frames]
        return [f.assign(cls=((f["v"] > 0) & all(full) & (len(frames) in (3, 1))).astype("int32"))[["image_id", "tile_id", "y", "x", "cls"]] for f in frames]

    images, pixels = rasters.from_arrays(spark, {0: np.pad(np.ones((11, 9)), ((3, 6), (2, 9)))})
    build = LabellingBuilder().set_segmenter(segment.TileModel(model)).set_background_class(0).set_tile_size(10, 10).set_overlap(0)
    flow = build.set_border_tiles("skip").set_seg_batch_size(3).get()
    assert flow.seg_batch_size == 3
    found = flow.process(images, pixels).objects.collect()
    assert [(r.minx, r.miny, r.maxx, r.maxy) for r in found] == [(2, 3, 11, 14)]


def test_a_chain_looks_into_what_it_found(spark):
    """Squares of one grey that hold four brighter ones each."""
    outer = [(y, x) for y in (100, 400) for x in (100, 400, 700)]
    shapes = [(square(y, x, 100), 100) for y, x in outer] + [(square(y + dy, x + dx, 10), 200) for y, x in outer for dy in (20, 70) for dx in (20, 70)]
    first = LabellingBuilder().set_segmenter((v() > 0).cast("int")).set_background_class(0).set_tile_size(256, 256).get()
    second = LabellingBuilder().set_segmenter((v() > 150).cast("int")).set_background_class(0).get()
    chain = ChainBuilder().set_first_workflow(first).add_executor(second, label="inner").get()
    found = chain.process(*drawn(spark, 1000, 700, *shapes))
    assert {(r.stage, r.stage_ord, r.n) for r in found.groupBy("stage", "stage_ord").agg(F.count("*").alias("n")).collect()} == {("0", 0, 6), ("inner", 1, 24)}
    inner = found.where("stage = 'inner'").collect()
    assert {(r.miny, r.minx) for r in inner} == {(y + dy, x + dx) for y, x in outer for dy in (20, 70) for dx in (20, 70)}
    replaced = wf.with_stage(found, "inner", found.where("stage = 'inner'").limit(2))
    assert replaced.where("stage = 'inner' AND stage_ord = 1").count() == 2
    assert wf.with_stage(found, "more", found.where("stage = '0'")).where("stage = 'more' AND stage_ord = 2").count() == 6


def test_builders_check_their_parts(spark):
    rule = (F.lit(1), F.lit(1.0))
    with pytest.raises(MissingPart):
        DetectionBuilder().add_classifier(v() > 0, rule).get()
    with pytest.raises(MissingPart):
        DetectionBuilder().set_segmenter(v()).get()
    with pytest.raises(ConflictingParts):
        DetectionBuilder().set_segmenter(v()).add_classifier(v() > 0, rule).set_one_shot_dispatcher(lambda d: d, {"a": rule}).get()
    with pytest.raises(ValueError):
        LabellingBuilder().set_segmenter(v()).set_seg_batch_size(2).get()
    with pytest.raises(ValueError):
        LabellingBuilder().set_distance_tolerance(None)
    with pytest.raises(MissingPart):
        ChainBuilder().get()
    flow = LabellingBuilder().set_segmenter(v()).get()
    with pytest.raises(ConflictingParts):
        ChainBuilder().set_first_workflow(flow, "a").add_executor(flow, label="a").get()
    chain = ChainBuilder().set_first_workflow(flow).add_executor(flow, masked=False).add_executor(flow).get()
    assert [chain.label, *(s.label for s in chain.stages)] == ["0", "1", "2"] and [s.masked for s in chain.stages] == [False, True]
    assert (flow.grid, flow.tolerance, flow.background) == (tiling.Grid(1024, 1024, 7, "keep"), 1, -1)
    assert DetectionBuilder().set_segmenter(v()).add_classifier(v() > 0, rule).add_catchall_classifier(rule).get().labels == ["0", "catchall"]
    assert dispatch.label_count(None) == 0 and dispatch.label_count(["a", "b"]) == 2


def test_failed_tiles_and_sources(spark):
    images, pixels = rasters.from_arrays(spark, {3: np.arange(24.0).reshape(4, 6), 5: np.ones((2, 2))})
    tiled = tiling.tile_pixels(images, pixels, tiling.Grid(3, 2, 0)).select("image_id", "tile_id", "y", "x", "v")

    def model(frame):
        if frame["tile_id"].iloc[0] == 2:
            raise TileReadError("gone")
        return frame.assign(cls=1)[["image_id", "tile_id", "y", "x", "cls"]]

    kind = "image_id long, tile_id long, y long, x long, cls int"
    for found in (segment.by_tile(tiled, model, kind), segment.by_batch(tiled, lambda fs: [model(f) for f in fs], kind, 4)):
        assert {(r.image_id, r.tile_id): r.n for r in found.groupBy("image_id", "tile_id").agg(F.count("*").alias("n")).collect()} == {(3, 1): 6, (3, 3): 6, (3, 4): 6, (5, 1): 4}

    def broken():
        raise ImageReadError("no file")

    with pytest.raises(ImageReadError):
        rasters.collection([(images, pixels), broken])
    with pytest.warns(UserWarning):
        both = rasters.collection([(images, pixels), broken, lambda: (images, pixels)], silent_fail=True)
    assert both[0].count() == 4


def test_windows_and_masks_of_polygons(spark):
    ring = lambda *p: [list(p)]
    kind = "image_id long, rings array<array<struct<x: double, y: double>>>"
    polygons = spark.createDataFrame([(0, ring((5.0, 5.0), (20.0, 5.0), (20.0, 20.0), (5.0, 20.0))), (1, ring((30.0, 2.0), (31.0, 2.0), (31.0, 3.0))), (2, None), (3, [[]])], kind)
    images = dims(spark, (25, 25), (25, 25), (25, 25))
    runs = regions.from_polygons(polygons, "image_id").collect()
    assert {(r.image_id, r.y, r.x0, r.x1) for r in runs if r.image_id == 0} == {(0, y, 5, 20) for y in range(5, 20)}
    found = regions.windows_of(images, polygons, strict=False).collect()
    assert [tuple(r) for r in found] == [(0, 5, 5, 15, 15)]
    with pytest.raises(Exception, match="outside image"):
        regions.windows_of(images, polygons).collect()
    wins = spark.createDataFrame([(0, 6, 4, 5, 5)], "image_id long, off_x long, off_y long, width long, height long")
    parent = regions.from_polygons(polygons, "image_id")
    cut = regions.composed(wins, None, parent, "image_id").collect()
    assert {(r.y, r.x0, r.x1) for r in cut} == {(y, 0, 5) for y in range(1, 5)}
    assert regions.composed(wins, None, None, "image_id") is None
