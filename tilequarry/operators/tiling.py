"""Tile grids by arithmetic: no grid is stored, and a pixel finds its tiles without
a join to one.

Borders: ``keep`` clips the last column and row, ``skip`` drops them where they are
not full, ``extend`` moves them back so that every tile is full (where the image is
large enough).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    width: int = 1024
    height: int = 1024
    overlap: int = 7
    borders: str = "keep"

    def __post_init__(self) -> None:
        if self.borders not in ("keep", "skip", "extend"):
            raise ValueError(f"borders: {self.borders!r} is not keep, skip or extend")
        if min(self.width, self.height) <= self.overlap or self.overlap < 0:
            raise ValueError("the overlap must be smaller than a tile")


def tile_count_1d(length: Column, tile: int, overlap: int = 0) -> Column:
    return F.when(length < tile, F.lit(1)).otherwise(F.ceil((length - overlap) / (tile - overlap))).cast("long")


def _sides(grid: Grid) -> dict[str, Column]:
    """Columns of the topology of an image with columns width and height."""
    w, h, o = F.col("width"), F.col("height"), grid.overlap
    cols, rows = tile_count_1d(w, grid.width, o), tile_count_1d(h, grid.height, o)
    if grid.borders == "skip":
        last_w = F.least(F.lit(grid.width), w - (cols - 1) * (grid.width - o))
        last_h = F.least(F.lit(grid.height), h - (rows - 1) * (grid.height - o))
        thin = (last_w < grid.width) | (h < grid.height)
        low = (last_h < grid.height) | (w < grid.width)
        cols, rows = cols - thin.cast("long"), rows - low.cast("long")
    return {"n_cols": cols, "n_rows": rows}


def _offset(index: Column, count: Column, length: Column, tile: int, grid: Grid) -> Column:
    step = index * (tile - grid.overlap)
    if grid.borders == "extend":
        return F.when(index == count - 1, F.greatest(length - tile, F.lit(0))).otherwise(step).cast("long")
    return step.cast("long")


def _placed(df: DataFrame, grid: Grid) -> DataFrame:
    """df (width, height, n_cols, n_rows, row, col) with the tile's id, offset and size."""
    df = df.withColumns({"tile_id": (F.col("row") * F.col("n_cols") + F.col("col") + 1).cast("long"), "off_x": _offset(F.col("col"), F.col("n_cols"), F.col("width"), grid.width, grid), "off_y": _offset(F.col("row"), F.col("n_rows"), F.col("height"), grid.height, grid)})
    return df.withColumns({"tile_w": F.least(F.lit(grid.width).cast("long"), F.col("width") - F.col("off_x")), "tile_h": F.least(F.lit(grid.height).cast("long"), F.col("height") - F.col("off_y"))})


def counts(images: DataFrame, grid: Grid) -> DataFrame:
    """(image_id, n_cols, n_rows, n_tiles)."""
    df = images.withColumns(_sides(grid))
    return df.select("image_id", "n_cols", "n_rows", (F.col("n_cols") * F.col("n_rows")).alias("n_tiles"))


def tiles(images: DataFrame, grid: Grid) -> DataFrame:
    """(image_id, tile_id, row, col, off_x, off_y, tile_w, tile_h, n_cols, n_rows):
    every tile, numbered from 1 in row-major order."""
    df = images.withColumns(_sides(grid)).where("n_cols > 0 AND n_rows > 0")
    df = df.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_cols") * F.col("n_rows") - 1)))
    df = df.withColumns({"row": F.expr("k div n_cols"), "col": F.expr("k % n_cols")})
    return _placed(df, grid).select("image_id", "tile_id", "row", "col", "off_x", "off_y", "tile_w", "tile_h", "n_cols", "n_rows")


def check_ids(tile_ids: DataFrame, images: DataFrame, grid: Grid) -> DataFrame:
    """(image_id, tile_id) that are no tiles of their image: below 1 or past the last."""
    return tile_ids.join(counts(images, grid), "image_id").where("tile_id < 1 OR tile_id > n_tiles").select("image_id", "tile_id")


def neighbours(tiles_df: DataFrame, *more: str) -> DataFrame:
    """(image_id, tile_id, top, bottom, left, right), null at a border, and the columns
    ``more``."""
    t, n = F.col("tile_id"), F.col("n_cols")
    return tiles_df.select("image_id", "tile_id", F.when(F.col("row") > 0, t - n).alias("top"), F.when(F.col("row") < F.col("n_rows") - 1, t + n).alias("bottom"), F.when(F.col("col") > 0, t - 1).alias("left"), F.when(F.col("col") < n - 1, t + 1).alias("right"), *more)


def batches(tiles_df: DataFrame, n: int) -> DataFrame:
    """Tiles of whole grids in ``n`` contiguous batches an image, the first ones one
    larger: by arithmetic on ids and grid sizes."""
    k, total = F.col("tile_id") - 1, F.col("n_cols") * F.col("n_rows")
    size, longer = F.expr(f"(n_cols * n_rows) div {n}"), total % n
    within = F.when(k < longer * (size + 1), F.floor(k / (size + 1))).otherwise(longer + F.floor((k - longer * (size + 1)) / F.greatest(size, F.lit(1))))
    return tiles_df.select("image_id", "tile_id", (within + 1).cast("int").alias("batch"))


def window(images: DataFrame, off_x: Column, off_y: Column, max_w: Column, max_h: Column) -> DataFrame:
    """Crops clipped at the right and bottom, with whether the origin is inside."""
    inside = (off_x >= 0) & (off_x < F.col("width")) & (off_y >= 0) & (off_y < F.col("height"))
    return images.select("image_id", off_x.cast("long").alias("off_x"), off_y.cast("long").alias("off_y"), F.least(max_w, F.col("width") - off_x).cast("long").alias("w"), F.least(max_h, F.col("height") - off_y).cast("long").alias("h"), inside.alias("inside"))


def box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> list[Column]:
    """Integer box of real bounds: offset and size."""
    x, y = F.floor(minx), F.floor(miny)
    return [x.cast("long").alias("box_x"), y.cast("long").alias("box_y"), (F.ceil(maxx) - x).cast("long").alias("box_w"), (F.ceil(maxy) - y).cast("long").alias("box_h")]


def tile_pixels(images: DataFrame, pixels: DataFrame, grid: Grid) -> DataFrame:
    """(image_id, tile_id, n_cols, off_x, off_y, y, x, ...): each pixel once for each
    tile that holds it."""
    dims = images.select("image_id", "width", "height").withColumns(_sides(grid))

    def candidates(at: Column, tile: int, count: Column) -> Column:
        step = tile - grid.overlap
        first = F.greatest(F.ceil((at - tile + 1) / step), F.lit(0))
        last = F.least(F.floor(at / step), count - 1)
        span = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<long>"))
        return F.array_distinct(F.concat(span, F.array(count - 1))) if grid.borders == "extend" else span

    df = pixels.join(dims, "image_id").where("n_cols > 0 AND n_rows > 0")
    if grid.overlap == 0 and grid.borders != "extend":  # one tile at most, by division
        df = df.withColumns({"col": F.floor(F.col("x") / grid.width), "row": F.floor(F.col("y") / grid.height)}).where("col < n_cols AND row < n_rows")
    else:
        df = df.withColumn("col", F.explode(candidates(F.col("x"), grid.width, F.col("n_cols")))).withColumn("row", F.explode(candidates(F.col("y"), grid.height, F.col("n_rows"))))
    df = _placed(df, grid).where("x >= off_x AND x < off_x + tile_w AND y >= off_y AND y < off_y + tile_h")
    kept = [c for c in pixels.columns if c not in ("image_id", "y", "x")]
    return df.select("image_id", "tile_id", "n_cols", "off_x", "off_y", "y", "x", *kept)
