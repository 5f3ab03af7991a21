"""Sets of cells as horizontal runs (keys, y, x0, x1), half open: polygons rasterised,
intersections, buffers, distances and masks of windows.  Every function is a plan over
runs; no cell is a row of its own and no region is gathered anywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import dealt, shuffle_width


def covered(runs: DataFrame, reach: int, least: int, *keys: str) -> DataFrame:
    """Runs (keys, y, x0, x1) of the cells that at least ``least`` of the given runs
    cover, each of which counts in its own row and ``reach`` rows up and down."""
    at = runs.select(*keys, F.explode(F.sequence(F.col("y") - reach, F.col("y") + reach)).alias("y"), "x0", "x1")
    ends = F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d")))).alias("e")
    ends = at.select(*keys, "y", ends).repartition(shuffle_width(runs.sparkSession), *keys, "y")  # a row's ends once for the sums and the order
    ends = ends.select(*keys, "y", F.col("e.x").alias("x"), F.col("e.d").alias("d")).groupBy(*keys, "y", "x").agg(F.sum("d").alias("d")).where("d <> 0")
    row = Window.partitionBy(*keys, "y").orderBy("x")
    inside = F.sum("d").over(row.rowsBetween(Window.unboundedPreceding, 0)) >= least
    turns = ends.select(*keys, "y", "x", inside.alias("inside")).withColumn("before", F.lag("inside", 1, False).over(row)).where("inside <> before")
    return turns.withColumn("x1", F.lead("x").over(row)).where("inside").select(*keys, "y", F.col("x").alias("x0"), "x1")


def dilated(runs: DataFrame, reach: int, *keys: str) -> DataFrame:
    """Runs widened by a square of side 2 * reach + 1; overlapping ones are joined."""
    return covered(runs.withColumns({"x0": F.col("x0") - reach, "x1": F.col("x1") + reach}), reach, 1, *keys)


def from_cells(cells: DataFrame, *keys: str) -> DataFrame:
    """Maximal runs of cells (keys, y, x)."""
    return covered(cells.select(*keys, "y", F.col("x").alias("x0"), (F.col("x") + 1).alias("x1")), 0, 1, *keys)


def from_polygons(polygons: DataFrame, *keys: str, fill_holes: bool = False) -> DataFrame:
    """Runs of the cells whose centres lie in polygons (keys, rings array<array<struct<x,
    y>>>), by the even-odd rule over all rings; with ``fill_holes`` each ring is filled
    by itself and the rings are joined.  A ring may be open or closed.  Centres on a
    left edge are in, on a right one out; null, empty and flat rings cover nothing."""
    ring = polygons.select(*keys, F.posexplode("rings").alias("ring", "p")).where(F.size("p") > 2)
    after = F.concat(F.slice("p", 2, F.size("p") - 1), F.slice("p", 1, 1))
    side = ring.select(*keys, "ring", F.explode(F.arrays_zip(F.col("p").alias("a"), after.alias("b"))).alias("e"))
    side = side.select(*keys, "ring", *[F.col(f"e.{e}.{c}").cast("double").alias(e + c) for e in "ab" for c in "xy"])
    first, last = F.ceil(F.least("ay", "by") - 0.5), F.ceil(F.greatest("ay", "by") - 0.5) - 1
    side = side.withColumns({"first": first, "last": last}).where("first <= last")
    hit = side.withColumn("y", F.explode(F.sequence("first", "last"))).withColumn("x", F.col("ax") + (F.col("y") + 0.5 - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay")))
    own = [*keys, "ring"] if fill_holes else list(keys)
    row = Window.partitionBy(*own, "y").orderBy("x")
    hit = hit.select(*own, "y", "x").repartition(shuffle_width(polygons.sparkSession), *own, "y")
    pair = hit.select(*own, "y", "x", F.row_number().over(row).alias("k"), F.lead("x").over(row).alias("to")).where("k % 2 = 1")
    runs = pair.select(*keys, "y", F.ceil(F.col("x") - 0.5).alias("x0"), F.ceil(F.col("to") - 0.5).alias("x1")).where("x0 < x1")
    return covered(runs, 0, 1, *keys)


def box_of(polygons: DataFrame, *keys: str) -> DataFrame:
    """(keys, box_x, box_y, box_w, box_h): the integer box round each polygon's rings."""
    at = polygons.select(*keys, F.explode(F.flatten("rings")).alias("p"))
    at = at.groupBy(*keys).agg(F.floor(F.min("p.x")).alias("box_x"), F.floor(F.min("p.y")).alias("box_y"), F.ceil(F.max("p.x")).alias("fx"), F.ceil(F.max("p.y")).alias("fy"))
    return at.select(*keys, "box_x", "box_y", (F.col("fx") - F.col("box_x")).alias("box_w"), (F.col("fy") - F.col("box_y")).alias("box_h"))


def windows_of(images: DataFrame, polygons: DataFrame, *keys: str, strict: bool = True) -> DataFrame:
    """(image_id, keys, off_x, off_y, width, height): the window of each polygon's box in
    its image, clipped at the right and bottom.  A box whose origin lies outside the
    image raises an error when the row is read; without ``strict`` it has no row."""
    boxes = box_of(polygons, "image_id", *keys).join(images.select("image_id", F.col("width").alias("iw"), F.col("height").alias("ih")), "image_id")
    inside = (F.col("box_x") >= 0) & (F.col("box_x") < F.col("iw")) & (F.col("box_y") >= 0) & (F.col("box_y") < F.col("ih"))
    if strict:
        origin = F.when(inside, F.col("box_x")).otherwise(F.raise_error(F.concat(F.lit("the box of a polygon begins outside image "), F.col("image_id"))).cast("long"))
        boxes = boxes.withColumn("box_x", origin)
    else:
        boxes = boxes.where(inside)
    return boxes.select("image_id", *keys, F.col("box_x").alias("off_x"), F.col("box_y").alias("off_y"), F.least("box_w", F.col("iw") - F.col("box_x")).alias("width"), F.least("box_h", F.col("ih") - F.col("box_y")).alias("height"))


def intersected(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Runs in both ``a`` (keys, ..., y, x0, x1) and ``b`` (keys, y, x0, x1), with the
    other columns of ``a``."""
    b = b.select(*keys, "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    both = a.join(dealt(b), [*keys, "y"]).where("x0 < b1 AND b0 < x1")
    return both.withColumns({"x0": F.greatest("x0", "b0"), "x1": F.least("x1", "b1")}).select(a.columns)


def composed(windows: DataFrame, child: DataFrame | None, parent: DataFrame | None, *keys: str) -> DataFrame | None:
    """The mask of windows (keys, off_x, off_y, width, height) cut from masked images,
    as runs in window coordinates: ``child`` (in window coordinates) where it meets
    ``parent`` (in the parent's); one alone where the other is None, the parent's cut to
    the window; None where neither is given.  Keys without runs have empty masks."""
    if parent is None:
        return child
    place = windows.select(*keys, "off_x", "off_y", "width", "height")
    moved = parent.select(*keys, "y", "x0", "x1").join(dealt(place), list(keys))
    moved = moved.withColumns({"y": F.col("y") - F.col("off_y"), "x0": F.greatest(F.col("x0") - F.col("off_x"), F.lit(0)), "x1": F.least(F.col("x1") - F.col("off_x"), F.col("width"))})
    moved = moved.where("y >= 0 AND y < height AND x0 < x1").select(*keys, "y", "x0", "x1")
    return moved if child is None else intersected(child.select(*keys, "y", "x0", "x1"), moved, *keys)


def _gap(low: Column, high: Column) -> Column:
    return F.greatest(low, high, F.lit(0))


def nearest(pairs: DataFrame | None, runs: DataFrame, within: float, *keys: str) -> DataFrame:
    """(keys, a, b, distance) of ``pairs`` (keys, a, b: rids), or of all pairs with a < b,
    whose cells come nearer than ``within``, strictly; 0 where they touch or share
    cells.  ``runs`` is (keys, rid, y, x0, x1).  Only runs whose rows are that near meet,
    by an equi-join."""
    reach = math.ceil(within)
    a = runs.select(*keys, F.col("rid").alias("a"), F.col("y").alias("ya"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    b = runs.select(*keys, F.col("rid").alias("b"), F.col("y").alias("yb"), F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    a = a if pairs is None else pairs.select(*keys, "a", "b").join(dealt(a), [*keys, "a"])
    a = a.withColumn("yb", F.explode(F.sequence(F.col("ya") - reach, F.col("ya") + reach)))
    gap_x = _gap(F.col("a0") - F.col("b1"), F.col("b0") - F.col("a1"))
    gap_y = F.greatest(F.abs(F.col("ya") - F.col("yb")) - 1, F.lit(0))
    square = (gap_x * gap_x + gap_y * gap_y).alias("square")
    both = a.join(dealt(b), [*keys, "yb"]).where("a < b") if pairs is None else a.join(dealt(b), [*keys, "b", "yb"])
    near = both.select(*keys, "a", "b", square).where(F.col("square") < within * within)
    return near.groupBy(*keys, "a", "b").agg(F.sqrt(F.min("square").cast("double")).alias("distance"))


def same(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """(keys, same) for the keys of either: whether their cells are equal.  Both hold
    maximal runs."""
    tag = lambda df, x: df.select(*keys, "y", "x0", "x1").distinct().withColumn("side", F.lit(x))
    each = tag(a, 1).unionByName(tag(b, 2)).groupBy(*keys, "y", "x0", "x1").agg(F.sum("side").alias("sides"))
    return each.groupBy(*keys).agg((F.min("sides") == 3).alias("same"))
