"""Objects cut by tile borders, reunited.

Regions of neighbouring tiles (right and bottom; the relation is symmetric) with
equal labels meet in an equi-join on image, tile and label, pruned by the strip
along the shared side and by boxes; exact distances come from runs of nearby rows.
Links closer than the tolerance give objects by connected components; objects of
several regions are closed by a square of the tolerance, others pass unchanged.
That is what is done with large images; ``whole`` does the same to small ones, without
a join of runs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regions import covered, nearest
from ..tables import components, dealt, written
from . import whole
from .tiling import neighbours

#: Rows of an image that one task merges at most: a run counts once for each row of cells
#: that closing spreads it to, a tile twice.
ONE_TASK_ROWS = 1 << 19


def boxes(runs: DataFrame) -> DataFrame:
    return runs.groupBy("image_id", "tile_id", "rid", "label").agg(F.min("x0").alias("minx"), F.min("y").alias("miny"), F.max("x1").alias("maxx"), (F.max("y") + 1).alias("maxy"), F.sum(F.col("x1") - F.col("x0")).alias("area"))


def sides(tiles: DataFrame, tolerance: float) -> DataFrame:
    """(image_id, tile_id, other, across, a_from, b_to): each tile's right and bottom
    neighbours.  Regions of the tile that end at ``a_from`` or later and regions of the
    neighbour that begin at ``b_to`` or earlier reach the strips along the shared side."""
    if tolerance is None or tolerance < 0:
        raise ValueError("the tolerance must be a number, 0 or more")
    near = neighbours(tiles, "off_x", "off_y", "tile_w", "tile_h")
    side = lambda other, end, across: F.struct(F.col(other).alias("other"), (F.col(end[0]) + F.col(end[1])).alias("end"), F.lit(across).alias("across"))
    near = near.select("image_id", "tile_id", F.explode(F.array(side("right", ("off_x", "tile_w"), True), side("bottom", ("off_y", "tile_h"), False))).alias("s")).select("image_id", "tile_id", "s.*").where("other IS NOT NULL")
    far = tiles.select("image_id", F.col("tile_id").alias("other"), F.col("off_x").alias("ox"), F.col("off_y").alias("oy"))
    begin = F.when(F.col("across"), F.col("ox")).otherwise(F.col("oy"))
    strip = tolerance + F.col("end") - begin
    return near.join(dealt(far), ["image_id", "other"]).select("image_id", "tile_id", "other", "across", (F.col("end") - strip).alias("a_from"), (begin + strip).alias("b_to"))


def candidates(regions: DataFrame, tiles: DataFrame, tolerance: float, labelled: bool = True) -> DataFrame:
    """(image_id, a, b): pairs of regions of neighbouring tiles whose boxes reach the
    strips along the shared side and lie within the tolerance of one another."""
    near = sides(tiles, tolerance)
    a = regions.select("image_id", "tile_id", F.col("rid").alias("a"), "label", *[F.col(c).alias(f"a_{c}") for c in ("minx", "miny", "maxx", "maxy")])
    b = regions.select("image_id", F.col("tile_id").alias("other"), F.col("rid").alias("b"), F.col("label").alias("b_label"), *[F.col(c).alias(f"b_{c}") for c in ("minx", "miny", "maxx", "maxy")])
    a = a.join(dealt(near), ["image_id", "tile_id"]).where(F.when(F.col("across"), F.col("a_maxx")).otherwise(F.col("a_maxy")) >= F.col("a_from"))
    pairs = a.join(dealt(b), ["image_id", "other"])
    pairs = pairs.where(F.when(F.col("across"), F.col("b_minx")).otherwise(F.col("b_miny")) <= F.col("b_to"))
    if labelled:
        pairs = pairs.where("label = b_label")
    gap_x = F.greatest(F.col("a_minx") - F.col("b_maxx"), F.col("b_minx") - F.col("a_maxx"), F.lit(0))
    gap_y = F.greatest(F.col("a_miny") - F.col("b_maxy"), F.col("b_miny") - F.col("a_maxy"), F.lit(0))
    return pairs.where(gap_x * gap_x + gap_y * gap_y < tolerance * tolerance).select("image_id", "a", "b").distinct()


def links(pairs: DataFrame, runs: DataFrame, tolerance: float) -> DataFrame:
    """(image_id, a, b) of ``pairs`` nearer than ``tolerance``, strictly."""
    return nearest(pairs, runs, tolerance, "image_id").select("image_id", "a", "b")


def objects_of(regions: DataFrame, linked: DataFrame) -> DataFrame:
    """(image_id, rid, object_id): each region's object, the smallest region in it."""
    node = lambda c: F.struct("image_id", F.col(c).alias("rid"))
    joined = components(linked.select(node("a").alias("a"), node("b").alias("b")), "objects")
    joined = joined.select("node.image_id", "node.rid", F.col("component.rid").alias("object_id"))
    return regions.select("image_id", "rid").join(dealt(joined), ["image_id", "rid"], "left").select("image_id", "rid", F.coalesce("object_id", "rid").alias("object_id"))


def object_labels(regions: DataFrame, membership: DataFrame) -> DataFrame:
    """(image_id, object_id, label, n_regions): the label with the largest summed
    area; of equals the smallest."""
    by = regions.join(dealt(membership), ["image_id", "rid"]).groupBy("image_id", "object_id", "label").agg(F.sum("area").alias("area"), F.count("*").alias("n"))
    best = F.max(F.struct("area", (-F.col("label")).alias("label"))).alias("best")
    return by.groupBy("image_id", "object_id").agg(best, F.sum("n").alias("n_regions")).select("image_id", "object_id", (-F.col("best.label")).cast("int").alias("label"), "n_regions")


def closed(runs: DataFrame, tolerance: float, *keys: str) -> DataFrame:
    """Morphological closing of the cells of ``runs`` (keys, y, x0, x1), which may
    overlap, by a square of side 2 * ceil(tolerance) + 1.  Runs are widened and spread
    to the rows around, joined, narrowed, and kept where all rows around have them; no
    cell is a row of its own."""
    reach = math.ceil(tolerance)
    wide = covered(runs.withColumns({"x0": F.col("x0") - reach, "x1": F.col("x1") + reach}), reach, 1, *keys)
    narrow = wide.withColumns({"x0": F.col("x0") + reach, "x1": F.col("x1") - reach}).where("x0 < x1")
    return covered(narrow, reach, 2 * reach + 1, *keys)


def cells_of(runs: DataFrame) -> DataFrame:
    return runs.select(*[c for c in runs.columns if c not in ("x0", "x1")], F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))


def merge(runs: DataFrame, tiles: DataFrame, tolerance: float = 1, labelled: bool = True, one_task: int = ONE_TASK_ROWS) -> DataFrame:
    """(image_id, object_id, label, y, x0, x1): runs of the merged objects.  Images of at
    most ``one_task`` rows are merged whole, many in a call; larger ones by joins."""
    near = sides(tiles, tolerance)
    runs = written(runs, "runs")
    rows = runs.select("image_id", F.lit(2 * math.ceil(tolerance) + 1).alias("n")).union(tiles.select("image_id", F.lit(2).alias("n")))
    rows = rows.where("image_id IS NOT NULL").groupBy("image_id").agg(F.sum("n").alias("n")).where(F.col("n") > one_task)
    large = [r.image_id for r in rows.select("image_id").collect()]  # one in so many rows at most
    if not large:
        return whole.merged(runs, near, tolerance, labelled)
    among = F.col("image_id").isin(large)
    return whole.merged(runs.where(~among), near.where(~among), tolerance, labelled).unionByName(merge_by_joins(runs.where(among), tiles.where(among), tolerance, labelled))


def merge_by_joins(runs: DataFrame, tiles: DataFrame, tolerance: float, labelled: bool) -> DataFrame:
    """As ``merge``, of images of any size: no task holds more than a few rows of one."""
    regions = written(boxes(runs), "regions")
    linked = links(candidates(regions, tiles, tolerance, labelled), runs, tolerance)
    member = written(objects_of(regions, linked), "members")
    member = written(member.join(dealt(object_labels(regions, member)), ["image_id", "object_id"]), "labels")
    placed = runs.drop("label").join(dealt(member), ["image_id", "rid"]).select("image_id", "object_id", "label", "n_regions", "y", "x0", "x1")
    single = placed.where("n_regions = 1").drop("n_regions")
    return single.unionByName(closed(placed.where("n_regions > 1"), tolerance, "image_id", "object_id", "label"))
