"""The engine's queries over the driver's tables, and the same rows in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TileReadError
from ..functions import arrays, geometry, regions, timing
from ..operators import dispatch, locate, merge, segment, tiling
from ..sources import rasters
from ..tables import dealt
from . import workflow as wf
from .builder import ChainBuilder, DetectionBuilder, LabellingBuilder

QUERIES, ORACLES = {}, {}
KEEP = tiling.Grid(300, 200, 20)
SKIP = tiling.Grid(300, 200, 20, "skip")
EXTEND = tiling.Grid(300, 200, 20, "extend")
SMALL = tiling.Grid(5, 5, 1)


def v():
    return F.col("v")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- pieces of SQL -----------------------------------------------------------

EMB = "emb8 AS (SELECT vec_id AS image_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i))"
DIMS = "dims AS (SELECT p_partkey AS image_id, CAST(p_size * 37 AS BIGINT) AS width, (p_partkey % 50 + 1) * 53 AS height FROM part)"
SIDES = "sides AS (SELECT *, CAST(CASE WHEN width < 300 THEN 1 ELSE ceil((width - 20) / 280.0) END AS BIGINT) AS n_cols, CAST(CASE WHEN height < 200 THEN 1 ELSE ceil((height - 20) / 180.0) END AS BIGINT) AS n_rows FROM dims)"
THIN = "thin AS (SELECT image_id, width, height, n_cols - CASE WHEN least(300, width - (n_cols - 1) * 280) < 300 OR height < 200 THEN 1 ELSE 0 END AS n_cols, n_rows - CASE WHEN least(200, height - (n_rows - 1) * 180) < 200 OR width < 300 THEN 1 ELSE 0 END AS n_rows FROM sides)"
PLACE = "SELECT image_id, k + 1 AS tile_id, k // n_cols AS \"row\", k % n_cols AS col, {x} AS off_x, {y} AS off_y, least(300, width - {x}) AS tile_w, least(200, height - {y}) AS tile_h, n_cols, n_rows FROM {src}, LATERAL (SELECT unnest(range(0, n_cols * n_rows)) AS k)"
PLAIN = {"x": "((k % n_cols) * 280)", "y": "((k // n_cols) * 180)"}
MOVED = {"x": "(CASE WHEN k % n_cols = n_cols - 1 THEN greatest(width - 300, 0) ELSE (k % n_cols) * 280 END)", "y": "(CASE WHEN k // n_cols = n_rows - 1 THEN greatest(height - 200, 0) ELSE (k // n_cols) * 180 END)"}
GRID = f"WITH {DIMS}, {SIDES}, g AS ({PLACE.format(src='sides', **PLAIN)}) "
#: Pixels of emb8 in tiles of 5 x 5 with overlap 1: 2 x 2 tiles at 0 and 4.
TILED = f"{EMB}, tp AS (SELECT image_id, ty * 2 + tx + 1 AS tile_id, tx * 4 AS off_x, ty * 4 AS off_y, y, x, v FROM emb8, range(0, 2) a(tx), range(0, 2) b(ty) WHERE x >= tx * 4 AND x < least(tx * 4 + 5, 8) AND y >= ty * 4 AND y < least(ty * 4 + 5, 8))"
CLASS = "CASE WHEN v > 0.1 THEN 2 WHEN v < -0.1 THEN 1 ELSE 0 END"
#: Components of cells c (image_id, tile_id, y, x, cls): the smallest y * 8 + x that is reached.
REACH = "reach AS (SELECT image_id, tile_id, cls, y, x, y * 8 + x AS root FROM c UNION SELECT n.image_id, n.tile_id, n.cls, n.y, n.x, r.root FROM reach r JOIN c n ON n.image_id = r.image_id AND n.tile_id = r.tile_id AND n.cls = r.cls AND abs(n.y - r.y) + abs(n.x - r.x) = 1), lab AS (SELECT image_id, tile_id, cls, y, x, min(root) AS root FROM reach GROUP BY ALL)"
CELLS = f"WITH RECURSIVE {TILED}, c AS (SELECT image_id, tile_id, y, x, {CLASS} AS cls FROM tp WHERE v > 0.1 OR v < -0.1), {REACH}"
WHOLE = f"WITH RECURSIVE {EMB}, c AS (SELECT image_id, 1 AS tile_id, y, x, 1 AS cls FROM emb8 WHERE v > 0.1), {REACH}"
#: Regions and their links across tiles at tolerance 1: boxes of cells closer than 1 touch or share a cell.
LINKS = "near AS (SELECT * FROM (VALUES (1, 2), (3, 4), (1, 3), (2, 4)) t(ta, tb)), links AS (SELECT DISTINCT a.image_id, a.tile_id AS ta, a.root AS ra, b.tile_id AS tb, b.root AS rb FROM lab a JOIN near ON near.ta = a.tile_id JOIN lab b ON b.image_id = a.image_id AND b.tile_id = near.tb AND b.cls = a.cls AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1)"
NODES = "node AS (SELECT DISTINCT image_id, tile_id * 100 + root AS id FROM lab), edge AS (SELECT image_id, ta * 100 + ra AS a, tb * 100 + rb AS b FROM links UNION SELECT image_id, tb * 100 + rb, ta * 100 + ra FROM links), walk AS (SELECT image_id, id, id AS root FROM node UNION SELECT w.image_id, e.b, w.root FROM walk w JOIN edge e ON e.image_id = w.image_id AND e.a = w.id), obj AS (SELECT image_id, id, min(root) AS object FROM walk GROUP BY ALL)"
BOX = "boxes AS (SELECT l_orderkey * 8 + l_linenumber AS box_id, l_partkey % 500 AS minx, l_suppkey % 400 AS miny, l_partkey % 500 + l_orderkey % 60 + 1 AS maxx, CAST(l_suppkey % 400 + l_linenumber * 7 AS BIGINT) AS maxy FROM lineitem), shape AS (SELECT *, maxx - minx AS w, maxy - miny AS h FROM boxes)"
EVENTS = "t AS (SELECT 'app.' || event_type || '.u' || CAST(user_id % 7 AS VARCHAR) AS phase, value AS duration FROM events)"


# --- sources and tiling -------------------------------------------------------

@query(f"WITH {EMB} SELECT * FROM emb8")
def raster_emb8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.emb8(spark, sf_dir)[1]


@query("SELECT CAST(0 AS BIGINT) AS image_id, user_id AS y, CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT) AS x, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2, 3")
def raster_evgrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.event_grid(spark, sf_dir)


@query(f"WITH {DIMS}, {SIDES} SELECT image_id, n_cols, n_rows, n_cols * n_rows AS n_tiles FROM sides")
def tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.counts(rasters.part_dims(spark, sf_dir), KEEP)


@query(GRID + "SELECT * FROM g")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tiles(rasters.part_dims(spark, sf_dir), KEEP)


@query(f"WITH {DIMS}, {SIDES}, {THIN} " + PLACE.format(src="thin", **PLAIN))
def tile_grid_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tiles(rasters.part_dims(spark, sf_dir), SKIP)


@query(f"WITH {DIMS}, {SIDES} " + PLACE.format(src="sides", **MOVED))
def tile_grid_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tiles(rasters.part_dims(spark, sf_dir), EXTEND)


NEAR = 'SELECT image_id, tile_id, CASE WHEN "row" > 0 THEN tile_id - n_cols END AS top, CASE WHEN "row" < n_rows - 1 THEN tile_id + n_cols END AS bottom, CASE WHEN col > 0 THEN tile_id - 1 END AS "left", CASE WHEN col < n_cols - 1 THEN tile_id + 1 END AS "right" FROM g'


@query(GRID + NEAR)
def tile_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.neighbours(tiling.tiles(rasters.part_dims(spark, sf_dir), KEEP))


@query(f"WITH {DIMS}, {SIDES}, {THIN}, g AS ({PLACE.format(src='thin', **PLAIN)}) {NEAR}")
def tile_neighbours_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.neighbours(tiling.tiles(rasters.part_dims(spark, sf_dir), SKIP))


@query(GRID + "SELECT image_id, tile_id, CAST(ntile(4) OVER (PARTITION BY image_id ORDER BY tile_id) AS INTEGER) AS batch FROM g")
def tile_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.batches(tiling.tiles(rasters.part_dims(spark, sf_dir), KEEP), 4)


@query(f"WITH {DIMS}, b AS (SELECT image_id, k FROM dims, (VALUES (-1), (0), (3), (4), (900)) t(k)) SELECT image_id, CAST(k AS BIGINT) AS tile_id FROM b JOIN (SELECT image_id, n_cols * n_rows AS n FROM (WITH {SIDES} SELECT * FROM sides)) USING (image_id) WHERE k < 1 OR k > n")
def tile_check_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = rasters.part_dims(spark, sf_dir)
    asked = images.select("image_id", F.explode(F.array(*[F.lit(k).cast("long") for k in (-1, 0, 3, 4, 900)])).alias("tile_id"))
    return tiling.check_ids(asked, images, KEEP)


@query(f"WITH {DIMS}, o AS (SELECT *, image_id % 2000 - 50 AS ox, image_id * 7 % 3000 AS oy FROM dims) SELECT image_id, ox AS off_x, oy AS off_y, least(256, width - ox) AS w, least(128, height - oy) AS h, ox >= 0 AND ox < width AND oy >= 0 AND oy < height AS inside FROM o")
def window_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("image_id")
    return tiling.window(rasters.part_dims(spark, sf_dir), key % 2000 - 50, key * 7 % 3000, F.lit(256), F.lit(128))


@query("WITH b AS (SELECT l_orderkey * 8 + l_linenumber AS box_id, l_extendedprice / 100 AS x0, l_quantity * 1.3 AS y0, l_extendedprice / 100 + l_tax * 1000 AS x1, l_quantity * 1.3 + l_discount * 500 AS y1 FROM lineitem) SELECT box_id, CAST(floor(x0) AS BIGINT) AS box_x, CAST(floor(y0) AS BIGINT) AS box_y, CAST(ceil(x1) - floor(x0) AS BIGINT) AS box_w, CAST(ceil(y1) - floor(y0) AS BIGINT) AS box_h FROM b")
def polygon_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x, y = F.col("l_extendedprice") / 100, F.col("l_quantity") * F.lit(1.3)
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("box_id"), *tiling.box(x, y, x + F.col("l_tax") * 1000, y + F.col("l_discount") * 500))


@query(f"WITH {TILED} SELECT image_id, tile_id, off_x, off_y, y, x, v FROM tp")
def tile_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tile_pixels(*rasters.emb8(spark, sf_dir), SMALL).drop("n_cols")


# --- segment -------------------------------------------------------------------

@query(f"WITH {EMB} SELECT image_id, y, x, CASE WHEN v > 0.1 THEN 255 ELSE 0 END AS cls FROM emb8")
def segment_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.binary(rasters.emb8(spark, sf_dir)[1], segment.above(v(), 0.1)).drop("v")


@query(f"WITH {EMB} SELECT image_id, y, x, CASE WHEN v > -0.05 AND v < 0.1 THEN 1 ELSE 0 END AS cls FROM emb8")
def segment_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.semantic(rasters.emb8(spark, sf_dir)[1], segment.between(v(), -0.05, 0.1).cast("int")).drop("v")


PROBA = "p AS (SELECT vec_id AS image_id, i AS y, [CAST(embedding[i * 4 + 1] AS DOUBLE), CAST(embedding[i * 4 + 2] AS DOUBLE), CAST(embedding[i * 4 + 3] AS DOUBLE), CAST(embedding[i * 4 + 4] AS DOUBLE)] AS p FROM embeddings, range(0, 16) r(i))"


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), F.col("embedding").cast("array<double>").alias("e"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("y"))
    return rows.select("image_id", "y", F.slice("e", (F.col("y") * 4 + 1).cast("int"), 4).alias("p"))


@query(f"WITH {PROBA} SELECT image_id, y, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS cls FROM p")
def segment_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probabilities(spark, sf_dir).select("image_id", "y", segment.argmax(F.col("p")).alias("cls"))


@query(f"WITH {PROBA} SELECT image_id, y, ([125, 128, 129, 200])[list_position(p, list_max(p))] AS cls FROM p")
def segment_true_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probabilities(spark, sf_dir).select("image_id", "y", segment.true_labels(segment.argmax(F.col("p")), [125, 128, 129, 200]).alias("cls"))


def _half(frame):
    """A model of a tile's neighbourhood: above half the tile's largest value."""
    if frame["tile_id"].iloc[0] == 3 and frame["image_id"].iloc[0] % 5 == 0:
        raise TileReadError("a tile of the fifth images")
    return frame.assign(cls=(frame["v"] > frame["v"].max() / 2).astype("int32"))[["image_id", "tile_id", "y", "x", "cls"]]


HALF = f"WITH {TILED} SELECT image_id, tile_id, y, x, CAST(v > max(v) OVER (PARTITION BY image_id, tile_id) / 2 AS INTEGER) AS cls FROM tp"
TILE_CLASSES = "image_id long, tile_id long, y long, x long, cls int"


def _tile_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tile_pixels(*rasters.emb8(spark, sf_dir), SMALL).select("image_id", "tile_id", "y", "x", "v")


@query(f"SELECT * FROM ({HALF}) WHERE NOT (tile_id = 3 AND image_id % 5 = 0)")
def segment_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model a tile; tiles that can't be read have no rows."""
    return segment.by_tile(_tile_pixels(spark, sf_dir), _half, TILE_CLASSES)


@query(f"SELECT * FROM ({HALF}) WHERE NOT (tile_id = 3 AND image_id % 5 = 0)")
def segment_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model for three tiles a call."""
    return segment.by_batch(_tile_pixels(spark, sf_dir), lambda frames: [_half(f) for f in frames], TILE_CLASSES, 3)


# --- locate ---------------------------------------------------------------------

def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary regions of whole emb8 images."""
    images, pixels = rasters.emb8(spark, sf_dir)
    cells = segment.semantic(tiling.tile_pixels(images, pixels, tiling.Grid(8, 8, 0)), segment.above(v(), 0.1).cast("int"))
    return locate.runs(cells, 0)


def _tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of two classes in 5 x 5 tiles of emb8 images."""
    images, pixels = rasters.emb8(spark, sf_dir)
    rule = F.when(v() > 0.1, 2).when(v() < -0.1, 1).otherwise(0)
    return locate.runs(segment.semantic(tiling.tile_pixels(images, pixels, SMALL), rule), 0)


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tiles(rasters.emb8(spark, sf_dir)[0], SMALL)


def root():
    """A region's first cell, as SQL names it."""
    return F.min(F.col("y") * 8 + F.col("x0"))


@query(WHOLE + " SELECT image_id, root, count(*) AS area FROM lab GROUP BY ALL")
def slice_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir).groupBy("image_id", "rid").agg(root().alias("root"), F.sum(F.col("x1") - F.col("x0")).alias("area")).drop("rid")


@query(WHOLE + " SELECT image_id, root, y, x FROM lab")
def locate_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _whole(spark, sf_dir)
    roots = runs.groupBy("image_id", "rid").agg(root().alias("root"))
    return merge.cells_of(runs.join(dealt(roots), ["image_id", "rid"]).select("image_id", "root", "y", "x0", "x1"))


@query(CELLS + " SELECT image_id, tile_id, cls, root, count(*) AS area FROM lab GROUP BY ALL")
def locate_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _tiled(spark, sf_dir)
    return runs.groupBy("image_id", "tile_id", "rid").agg(F.first("label").alias("cls"), root().alias("root"), F.sum(F.col("x1") - F.col("x0")).alias("area")).drop("rid")


@query(WHOLE + ", m AS (SELECT image_id, root, count(*) AS area, avg(x + 0.5) AS cx, avg(y + 0.5) AS cy, min(x) AS minx, min(y) AS miny, max(x) + 1 AS maxx, max(y) + 1 AS maxy FROM lab GROUP BY ALL), e AS (SELECT a.image_id, a.root, count(*) AS n FROM lab a JOIN lab b ON a.image_id = b.image_id AND a.root = b.root AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.y = a.y + 1 AND b.x = a.x)) GROUP BY ALL) SELECT m.image_id, area, 4 * area - 2 * coalesce(n, 0) AS perimeter, round(cx, 6) AS cx, round(cy, 6) AS cy, minx, miny, maxx, maxy FROM m LEFT JOIN e ON m.image_id = e.image_id AND m.root = e.root")
def region_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = locate.measures(_whole(spark, sf_dir))
    return m.select("image_id", "area", "perimeter", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "minx", "miny", "maxx", "maxy")


@query(WHOLE + ", g AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, root, y ORDER BY x) AS g FROM lab) SELECT image_id, y, min(x) AS x0, max(x) + 1 AS x1 FROM g GROUP BY image_id, root, y, g")
def region_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir).select("image_id", "y", "x0", "x1")


@query(WHOLE + " SELECT image_id, root // 8 AS y, root % 8 AS x FROM (SELECT DISTINCT image_id, root FROM lab)")
def region_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.representative(_whole(spark, sf_dir)).select("image_id", "y", "x")


# --- regions as sets of cells --------------------------------------------------------

PARTS = "s AS (SELECT p_partkey AS image_id, CAST(p_size % 20 + 3 AS DOUBLE) AS w, CAST(p_partkey % 15 + 4 AS DOUBLE) AS h FROM part)"
CORNERS = [[("0", "0"), ("w", "0"), ("w", "h"), ("w / 2", "h / 2"), ("0", "h")], [("w / 4", "h / 8"), ("w / 2", "h / 8"), ("w / 2", "h / 4"), ("w / 4", "h / 4")]]
SIDES_OF = ", ".join(f"{{r: {r}, ax: CAST({a[0]} AS DOUBLE), ay: CAST({a[1]} AS DOUBLE), bx: CAST({b[0]} AS DOUBLE), b_y: CAST({b[1]} AS DOUBLE)}}" for r, ring in enumerate(CORNERS) for a, b in zip(ring, ring[1:] + ring[:1]))
INSIDE = f"WITH {PARTS}, edge AS (SELECT image_id, e.* FROM (SELECT image_id, unnest([{SIDES_OF}]) AS e FROM s)), cell AS (SELECT image_id, x, y FROM s, range(0, 23) a(x), range(0, 19) b(y) WHERE x < w AND y < h), hit AS (SELECT c.image_id, {{own}} y, x FROM cell c JOIN edge e ON e.image_id = c.image_id AND ((ay <= y + 0.5 AND b_y > y + 0.5) OR (b_y <= y + 0.5 AND ay > y + 0.5)) AND ax + (y + 0.5 - ay) * (bx - ax) / (b_y - ay) <= x + 0.5 GROUP BY ALL HAVING count(*) % 2 = 1), g AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM (SELECT DISTINCT image_id, y, x FROM hit)) SELECT image_id, y, min(x) AS x0, max(x) + 1 AS x1 FROM g GROUP BY image_id, y, g"


def _polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concave ring and a second one inside or across it for each part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    sizes = part.select(F.col("p_partkey").alias("image_id"), (F.col("p_size") % 20 + 3).cast("double").alias("w"), (F.col("p_partkey") % 15 + 4).cast("double").alias("h"))
    point = lambda x, y: F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))
    return sizes.select("image_id", F.array(*[F.array(*[point(x, y) for x, y in ring]) for ring in CORNERS]).alias("rings"))


@query(INSIDE.replace("{own}", ""))
def polygon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.from_polygons(_polygons(spark, sf_dir), "image_id")


@query(INSIDE.replace("{own}", "r,"))
def polygon_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.from_polygons(_polygons(spark, sf_dir), "image_id", fill_holes=True)


@query(f"WITH {DIMS}, {PARTS} SELECT image_id, CAST(0 AS BIGINT) AS off_x, CAST(0 AS BIGINT) AS off_y, least(CAST(ceil(s.w) AS BIGINT), width) AS width, least(CAST(ceil(s.h) AS BIGINT), height) AS height FROM s JOIN dims USING (image_id)")
def polygon_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.windows_of(rasters.part_dims(spark, sf_dir), _polygons(spark, sf_dir))


@query(WHOLE + " SELECT a.image_id, a.root AS root_a, b.root AS root_b, round(sqrt(min(greatest(abs(a.x - b.x) - 1, 0) ** 2 + greatest(abs(a.y - b.y) - 1, 0) ** 2)), 9) AS distance FROM lab a JOIN lab b ON a.image_id = b.image_id AND a.root < b.root GROUP BY ALL HAVING min(greatest(abs(a.x - b.x) - 1, 0) ** 2 + greatest(abs(a.y - b.y) - 1, 0) ** 2) < 6.25")
def region_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _whole(spark, sf_dir)
    names = runs.groupBy("image_id", "rid").agg(root().alias("root"))
    near = regions.nearest(None, runs, 2.5, "image_id")
    for c in ("a", "b"):
        near = near.join(dealt(names.select("image_id", F.col("rid").alias(c), F.col("root").alias(f"root_{c}"))), ["image_id", c])
    return near.select("image_id", F.least("root_a", "root_b").alias("root_a"), F.greatest("root_a", "root_b").alias("root_b"), F.round("distance", 9).alias("distance"))


@query(WHOLE + " SELECT image_id, root, count(*) AS area FROM (SELECT DISTINCT image_id, root, y + dy AS y, x + dx AS x FROM lab, range(-2, 3) a(dy), range(-2, 3) b(dx)) GROUP BY ALL")
def region_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _whole(spark, sf_dir)
    roots = runs.groupBy("image_id", "rid").agg(root().alias("root"))
    wide = regions.dilated(runs, 2, "image_id", "rid").groupBy("image_id", "rid").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))
    return wide.join(dealt(roots), ["image_id", "rid"]).select("image_id", "root", "area")


@query(f"WITH {EMB} SELECT image_id, count(*) FILTER (WHERE v > 0.1) = count(*) FILTER (WHERE v > 0.1 AND v < 0.25) AS same FROM emb8 GROUP BY 1 HAVING count(*) FILTER (WHERE v > 0.1) > 0")
def region_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = rasters.emb8(spark, sf_dir)[1].where("v > 0.1")
    return regions.same(regions.from_cells(cells, "image_id"), regions.from_cells(cells.where("v < 0.25"), "image_id"), "image_id")


@query(f"WITH {EMB} SELECT image_id, y - 1 AS y, x - 2 AS x FROM emb8 WHERE x >= 2 AND x < 7 AND y >= 1 AND y < 5 AND v > -0.05 AND v < 0.15")
def mask_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masks of windows of 5 x 4 at (2, 1) in masked images."""
    images, pixels = rasters.emb8(spark, sf_dir)
    wins = images.select("image_id", F.lit(2).alias("off_x"), F.lit(1).alias("off_y"), F.lit(5).alias("width"), F.lit(4).alias("height"))
    child = pixels.where("v > -0.05 AND x >= 2 AND y >= 1").select("image_id", (F.col("y") - 1).alias("y"), (F.col("x") - 2).alias("x"))
    mask = regions.composed(wins, regions.from_cells(child, "image_id"), regions.from_cells(pixels.where("v < 0.15"), "image_id"), "image_id")
    return merge.cells_of(mask)


# --- merge -----------------------------------------------------------------------

def _rooted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Runs, and (image_id, rid, node): the region as SQL names it."""
    runs = _tiled(spark, sf_dir)
    return runs, runs.groupBy("image_id", "tile_id", "rid").agg((F.col("tile_id") * 100 + root()).alias("node")).select("image_id", "rid", "node")


def _named(pairs: DataFrame, names: DataFrame) -> DataFrame:
    for c in ("a", "b"):
        pairs = pairs.join(dealt(names.select("image_id", F.col("rid").alias(c), F.col("node").alias(f"node_{c}"))), ["image_id", c])
    return pairs.select("image_id", "node_a", "node_b")


BOXES = ", bx AS (SELECT image_id, tile_id, cls, root, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM lab GROUP BY ALL), near AS (SELECT * FROM (VALUES (1, 2), (3, 4), (1, 3), (2, 4)) t(ta, tb))"


@query(CELLS + BOXES + " SELECT a.image_id, a.tile_id * 100 + a.root AS node_a, b.tile_id * 100 + b.root AS node_b FROM bx a JOIN near ON ta = a.tile_id JOIN bx b ON b.image_id = a.image_id AND b.tile_id = tb AND b.cls = a.cls WHERE greatest(a.x0 - b.x1, b.x0 - a.x1, 0) ** 2 + greatest(a.y0 - b.y1, b.y0 - a.y1, 0) ** 2 < 1 AND CASE WHEN tb = ta + 1 THEN a.x1 >= 3 AND b.x0 <= 6 ELSE a.y1 >= 3 AND b.y0 <= 6 END")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, names = _rooted(spark, sf_dir)
    return _named(merge.candidates(merge.boxes(runs), _tiles(spark, sf_dir), 1), names)


@query(CELLS + ", " + LINKS + " SELECT image_id, ta * 100 + ra AS node_a, tb * 100 + rb AS node_b FROM links")
def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, names = _rooted(spark, sf_dir)
    return _named(merge.links(merge.candidates(merge.boxes(runs), _tiles(spark, sf_dir), 1), runs, 1), names)


@query(CELLS + ", " + LINKS + ", " + NODES + " SELECT image_id, id AS node, object FROM obj")
def merge_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, names = _rooted(spark, sf_dir)
    regions = merge.boxes(runs)
    member = merge.objects_of(regions, merge.links(merge.candidates(regions, _tiles(spark, sf_dir), 1), runs, 1))
    top = names.select("image_id", F.col("rid").alias("object_id"), F.col("node").alias("object"))
    return member.join(dealt(names), ["image_id", "rid"]).join(dealt(top), ["image_id", "object_id"]).select("image_id", "node", "object")


SUMS = ", area AS (SELECT o.image_id, o.object, l.cls % 2 AS label, count(*) AS area FROM obj o JOIN lab l ON l.image_id = o.image_id AND l.tile_id * 100 + l.root = o.id GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY image_id, object ORDER BY area DESC, label) AS k FROM area)"
#: As LINKS, whatever the classes.
ANY = LINKS.replace(" AND b.cls = a.cls", "")


@query(CELLS + ", " + ANY + ", " + NODES + SUMS + " SELECT image_id, object, label FROM best WHERE k = 1")
def merge_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, names = _rooted(spark, sf_dir)
    regions = merge.boxes(runs).withColumn("label", F.col("label") % 2)
    member = merge.objects_of(regions, merge.links(merge.candidates(regions, _tiles(spark, sf_dir), 1, labelled=False), runs, 1))
    top = names.select("image_id", F.col("rid").alias("object_id"), F.col("node").alias("object"))
    return merge.object_labels(regions, member).join(dealt(top), ["image_id", "object_id"]).select("image_id", "object", "label")


CLOSE = ", own AS (SELECT DISTINCT o.image_id, o.object, l.cls, l.y, l.x FROM obj o JOIN lab l ON l.image_id = o.image_id AND l.tile_id * 100 + l.root = o.id), n AS (SELECT image_id, object, count(*) AS n FROM obj GROUP BY ALL), wide AS (SELECT DISTINCT own.image_id, own.object, cls, y + dy AS y, x + dx AS x FROM own JOIN n ON n.image_id = own.image_id AND n.object = own.object AND n > 1, range(-1, 2) a(dy), range(-1, 2) b(dx)), shut AS (SELECT image_id, object, cls, y + dy AS y, x + dx AS x FROM wide, range(-1, 2) a(dy), range(-1, 2) b(dx) GROUP BY ALL HAVING count(*) = 9), done AS (SELECT * FROM shut UNION ALL SELECT own.* FROM own JOIN n ON n.image_id = own.image_id AND n.object = own.object AND n = 1)"


@query(CELLS + ", " + LINKS + ", " + NODES + CLOSE + " SELECT image_id, cls AS label, count(*) AS area, min(x) AS minx, min(y) AS miny FROM done GROUP BY image_id, object, cls")
def merge_closing_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge.merge(_tiled(spark, sf_dir), _tiles(spark, sf_dir), 1)
    return merged.groupBy("image_id", "object_id", "label").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"), F.min("x0").alias("minx"), F.min("y").alias("miny")).drop("object_id")


# --- dispatch and classify ---------------------------------------------------------

ROUTE = "r AS (SELECT *, CASE WHEN w * h > 1500 THEN 'big' WHEN w > 2 * h THEN 'wide' WHEN h > 2 * w THEN 'tall' END AS dispatch FROM shape)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.line_boxes(spark, sf_dir).withColumns({"w": F.col("maxx") - F.col("minx"), "h": F.col("maxy") - F.col("miny")})


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("w"), F.col("h")
    return dispatch.rule_based(_boxes(spark, sf_dir), [w * h > 1500, w > 2 * h, h > 2 * w], ["big", "wide", "tall"])


@query(f"WITH {BOX}, {ROUTE} SELECT box_id, dispatch FROM r")
def dispatch_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("box_id", "dispatch")


@query(f"WITH {BOX}, {ROUTE} SELECT box_id, dispatch, CASE dispatch WHEN 'tall' THEN 0 WHEN 'big' THEN 1 ELSE -1 END AS dispatch_idx FROM r")
def dispatch_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch.indexed(_routed(spark, sf_dir), ["tall", "big"]).select("box_id", "dispatch", "dispatch_idx")


@query(f"WITH {BOX}, {ROUTE} SELECT dispatch, count(*) AS n FROM r GROUP BY 1")
def dispatch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch.counts(_routed(spark, sf_dir))


@query(f"WITH {BOX} SELECT box_id, CASE WHEN w * h > 1000 THEN 'BIG' ELSE 'SMALL' END AS dispatch, CASE WHEN w * h > 1000 THEN 1 ELSE 0 END AS pred FROM shape")
def dispatch_one_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = _boxes(spark, sf_dir).withColumn("dispatch", F.when(F.col("w") * F.col("h") > 1000, "BIG").otherwise("SMALL"))
    out = dispatch.classify(dispatch.indexed(routed, ["SMALL", "BIG"]), [(F.lit(0), F.lit(1.0)), (F.lit(1), F.lit(1.0))])
    return out.select("box_id", "dispatch", "pred")


@query(f"WITH {BOX}, {ROUTE} SELECT box_id, dispatch FROM r")
def dispatch_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [lambda d: d.where("w * h > 1500"), lambda d: d.where("w > 2 * h"), lambda d: d.where("h > 2 * w")]
    return dispatch.staged(_boxes(spark, sf_dir), rules, ["big", "wide", "tall"], ["box_id"]).select("box_id", "dispatch")


@query(f"WITH {BOX}, {ROUTE} SELECT box_id, dispatch, CASE dispatch WHEN 'big' THEN CAST(w * h > 3000 AS INTEGER) WHEN 'wide' THEN 7 END AS pred, CAST(CASE dispatch WHEN 'big' THEN 0.5 WHEN 'wide' THEN 0.25 ELSE 0 END AS FLOAT) AS proba FROM r")
def classify_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dispatch.indexed(_routed(spark, sf_dir), ["big", "wide"])
    return dispatch.classify(rows, [((F.col("w") * F.col("h") > 3000).cast("int"), F.lit(0.5)), (F.lit(7), F.lit(0.25))]).select("box_id", "dispatch", "pred", "proba")


@query(f"WITH {BOX}, {ROUTE} SELECT count(*) AS n, count(*) FILTER (WHERE dispatch IS NULL) AS undispatched FROM r")
def classify_undispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dispatch.classify(dispatch.indexed(_routed(spark, sf_dir), ["big", "wide", "tall"]), [(F.lit(1), F.lit(1.0))] * 3)
    return rows.agg(F.count("*").alias("n"), F.sum((F.col("pred").isNull() & (F.col("proba") == 0)).cast("long")).alias("undispatched"))


@query(f"WITH {BOX}, {ROUTE} SELECT box_id, CASE dispatch WHEN 'big' THEN CAST(w AS INTEGER) % 3 WHEN 'tall' THEN 5 END AS pred FROM r")
def classify_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dispatch.indexed(_routed(spark, sf_dir), ["big", "tall"])
    models = [lambda d: (d["w"] % 3, [1.0] * len(d)), lambda d: ([5] * len(d), [0.5] * len(d))]
    return dispatch.classify_models(rows, models).select("box_id", "pred")


@query(WHOLE + ", m AS (SELECT image_id, root, count(*) AS area, avg(x + 0.5) AS cx, avg(y + 0.5) AS cy FROM lab GROUP BY ALL) SELECT m.image_id, area, CAST(v > 0.12 AS INTEGER) AS pred FROM m JOIN emb8 e ON e.image_id = m.image_id AND e.x = floor(cx) AND e.y = floor(cy)")
def classify_center_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = dispatch.centre_pixel(locate.measures(_whole(spark, sf_dir)), rasters.emb8(spark, sf_dir)[1])
    return objects.select("image_id", "area", (v() > 0.12).cast("int").alias("pred"))


@query(WHOLE + " SELECT l.image_id, l.root, count(*) AS n, round(avg(v), 9) AS mean, min(v) AS low, max(v) AS high FROM lab l JOIN emb8 e ON e.image_id = l.image_id AND e.y = l.y AND e.x = l.x GROUP BY ALL")
def classify_zonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _whole(spark, sf_dir)
    roots = runs.groupBy("image_id", "rid").agg(root().alias("root"))
    stats = dispatch.zonal(runs, rasters.emb8(spark, sf_dir)[1], "image_id", "rid")
    return stats.join(dealt(roots), ["image_id", "rid"]).select("image_id", "root", "n", F.round("mean", 9).alias("mean"), "low", "high")


# --- workflows and chains ---------------------------------------------------------

def _detection() -> wf.Detection:
    area = F.col("area")
    build = DetectionBuilder().set_segmenter(segment.above(v(), 0.1).cast("int")).set_tile_size(5, 5).set_overlap(1)
    return build.add_classifier(area > 3, (F.lit(1), F.lit(1.0)), "big").add_classifier(area > 1, (F.lit(0), F.lit(0.5)), "small").get()


BINARY = CELLS.replace(f"{CLASS} AS cls FROM tp WHERE v > 0.1 OR v < -0.1", "1 AS cls FROM tp WHERE v > 0.1")
OBJECTS = BINARY + ", " + LINKS + ", " + NODES + CLOSE + ", o AS (SELECT image_id, object, count(*) AS area, min(x) AS minx, min(y) AS miny, max(x) + 1 AS maxx, max(y) + 1 AS maxy FROM done GROUP BY image_id, object)"


@query(OBJECTS + " SELECT image_id, area, minx, miny, maxx, maxy, CASE WHEN area > 3 THEN 'big' WHEN area > 1 THEN 'small' END AS dispatch, CASE WHEN area > 3 THEN 1 WHEN area > 1 THEN 0 END AS pred, CAST(CASE WHEN area > 3 THEN 1 WHEN area > 1 THEN 0.5 ELSE 0 END AS FLOAT) AS proba FROM o")
def workflow_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _detection().process(*rasters.emb8(spark, sf_dir)).objects
    return found.select("image_id", "area", "minx", "miny", "maxx", "maxy", "dispatch", "pred", "proba")


@query(CELLS + ", " + LINKS + ", " + NODES + CLOSE + " SELECT image_id, CAST(cls AS INTEGER) AS label, count(*) AS area, min(x) AS minx, min(y) AS miny, max(x) + 1 AS maxx, max(y) + 1 AS maxy FROM done GROUP BY image_id, object, cls")
def workflow_labelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.when(v() > 0.1, 2).when(v() < -0.1, 1).otherwise(0)
    flow = LabellingBuilder().set_segmenter(rule).set_background_class(0).set_tile_size(5, 5).set_overlap(1).get()
    return flow.process(*rasters.emb8(spark, sf_dir)).objects.select("image_id", "label", "area", "minx", "miny", "maxx", "maxy")


WINS = ", w AS (SELECT * FROM o WHERE area > 3)"


@query(OBJECTS + WINS + " SELECT image_id, area FROM w")
def chain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = ChainBuilder().set_first_workflow(_detection()).get()
    return chain.process(*rasters.emb8(spark, sf_dir)).where("area > 3").select("image_id", "area")


@query(OBJECTS + WINS + " SELECT image_id, minx AS off_x, miny AS off_y, maxx - minx AS width, maxy - miny AS height FROM w")
def chain_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = ChainBuilder().set_first_workflow(_detection()).get()
    return wf.windows(chain.process(*rasters.emb8(spark, sf_dir)).where("area > 3")).select("image_id", "off_x", "off_y", "width", "height")


STAGE2 = OBJECTS + WINS + ", c2 AS (SELECT d.image_id * 1000 + d.object AS win, d.y, d.x FROM done d JOIN w ON w.image_id = d.image_id AND w.object = d.object JOIN emb8 e ON e.image_id = d.image_id AND e.y = d.y AND e.x = d.x WHERE v > 0.15), reach2 AS (SELECT win, y, x, y * 8 + x AS root FROM c2 UNION SELECT n.win, n.y, n.x, r.root FROM reach2 r JOIN c2 n ON n.win = r.win AND abs(n.y - r.y) + abs(n.x - r.x) = 1), lab2 AS (SELECT win, y, x, min(root) AS root FROM reach2 GROUP BY ALL)"


@query(STAGE2 + " SELECT '0' AS stage, image_id, area, minx, miny FROM o UNION ALL SELECT '1', win // 1000, count(*), min(x), min(y) FROM lab2 GROUP BY win, root")
def chain_stage2(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = LabellingBuilder().set_segmenter(segment.above(v(), 0.15).cast("int")).set_background_class(0).get()
    chain = ChainBuilder().set_first_workflow(_detection()).add_executor(second, lambda d: d.where("stage = '0' AND area > 3")).get()
    return chain.process(*rasters.emb8(spark, sf_dir)).select("stage", "image_id", "area", "minx", "miny")


@query("SELECT o_orderkey AS id, o_totalprice AS area FROM orders UNION ALL SELECT l_orderkey, l_extendedprice FROM lineitem")
def info_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("area"))
    b = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_tax").alias("extra"), F.col("l_extendedprice").alias("area"), F.col("l_orderkey").alias("id"))
    return wf.merge_results(a, b)


@query(WHOLE + " SELECT e.image_id, e.y, e.x, CASE WHEN l.root IS NULL THEN 0 ELSE 255 END AS alpha FROM emb8 e LEFT JOIN lab l ON l.image_id = e.image_id AND l.y = e.y AND l.x = e.x")
def alpha_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = merge.cells_of(_whole(spark, sf_dir).select("image_id", "y", "x0", "x1"))
    return arrays.alpha_plane(rasters.emb8(spark, sf_dir)[1], cells, "image_id").select("image_id", "y", "x", "alpha")


@query(WHOLE + " SELECT image_id, y, x FROM lab l WHERE (SELECT count(*) FROM lab n WHERE n.image_id = l.image_id AND n.root = l.root AND abs(n.y - l.y) + abs(n.x - l.x) = 1) = 4")
def alpha_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = merge.cells_of(_whole(spark, sf_dir).select("image_id", "rid", "y", "x0", "x1"))
    return arrays.without_outline(cells, "image_id", "rid").select("image_id", "y", "x")


@query("SELECT c, CASE WHEN c IN (2, 4) THEN true ELSE false END AS has_alpha, CASE WHEN c IN (1, 3) THEN c + 1 ELSE c END AS masked FROM (SELECT DISTINCT CAST(p_size % 5 + 1 AS INTEGER) AS c FROM part)")
def alpha_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_size") % 5 + 1).cast("int").alias("c")).distinct()
    return c.select("c", arrays.has_alpha(F.col("c")).alias("has_alpha"), arrays.masked_channels(F.col("c"), F.lit(True)).alias("masked"))


@query("SELECT vec_id, CAST(embedding[4] AS DOUBLE) AS a, CAST(embedding[1] AS DOUBLE) AS b, CAST(embedding[64] AS DOUBLE) AS c FROM embeddings")
def array_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", arrays.take(F.col("embedding").cast("array<double>"), F.array(F.lit(3), F.lit(0), F.lit(63))).alias("t"))
    return e.select("vec_id", F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


@query("SELECT c_custkey AS pos, CASE WHEN c_custkey % 3 = 0 THEN -1.0 ELSE c_acctbal END AS value FROM customer")
def array_emplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("pos"), F.col("c_acctbal").alias("value"))
    return arrays.emplace(c, c.where("pos % 3 = 0").select("pos", F.lit(-1.0).alias("value")))


# --- timing ----------------------------------------------------------------------

def _phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select(F.concat(F.lit("app."), "event_type", F.lit(".u"), (F.col("user_id") % 7).cast("string")).alias("phase"), F.col("value").alias("duration"))


@query(f"WITH {EVENTS} SELECT phase, count(*) AS n, round(avg(duration), 6) AS mean, round(stddev_pop(duration), 6) AS std, min(duration) AS low, max(duration) AS high, round(sum(duration), 4) AS total FROM t GROUP BY 1")
def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = timing.statistics(_phases(spark, sf_dir))
    return s.select("phase", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "low", "high", F.round("total", 4).alias("total"))


@query(f"WITH {EVENTS}, u AS (SELECT * FROM t UNION ALL SELECT 'app.extra', duration FROM t WHERE duration > 50) SELECT phase, count(*) AS n FROM u GROUP BY 1")
def timing_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _phases(spark, sf_dir)
    b = a.where("duration > 50").withColumn("phase", F.lit("app.extra"))
    return timing.statistics(a.unionByName(b)).select("phase", "n")


@query(f"WITH {EVENTS}, p AS (SELECT array_to_string(string_split(phase, '.')[1:d], '.') AS prefix, CAST(d AS INTEGER) AS depth, duration FROM t, range(1, 4) r(d)) SELECT prefix, depth, count(*) AS n, round(sum(duration), 4) AS total FROM p GROUP BY 1, 2")
def timing_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.rolled_up(_phases(spark, sf_dir)).withColumn("total", F.round("total", 4))


@query(r"SELECT p, regexp_full_match(p, '[^.]+(\.[^.]+)*') AS ok FROM (SELECT DISTINCT CASE event_type WHEN 'click' THEN 'a.' || event_type WHEN 'view' THEN '.' || event_type WHEN 'purchase' THEN 'a..b' ELSE event_type END AS p FROM events)")
def timing_valid_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    p = F.when(kind == "click", F.concat(F.lit("a."), kind)).when(kind == "view", F.concat(F.lit("."), kind)).when(kind == "purchase", F.lit("a..b")).otherwise(kind)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(p.alias("p")).distinct().select("p", timing.valid(F.col("p")).alias("ok"))


@query()
def region_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WKT outlines and hull circularity."""
    return geometry.shapes(_whole(spark, sf_dir), "image_id", "rid")
