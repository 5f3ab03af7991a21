"""Scatter, gather, batches and alpha planes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import dealt


def take(source: Column, index: Column) -> Column:
    """The elements of array ``source`` at the 0-based positions in array ``index``."""
    return F.transform(index, lambda i: F.get(source, i))


def emplace(dest: DataFrame, src: DataFrame, position: str = "pos", value: str = "value") -> DataFrame:
    """``dest`` (position, value) with the values of ``src`` at its positions."""
    new = src.select(position, F.col(value).alias("_new"), F.lit(True).alias("_hit"))
    return dest.join(new, position, "left").select(position, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(value)).alias(value))


def batch_sizes(n: int, batches: int) -> list[int]:
    """Sizes of contiguous batches of ``n`` items: the first ones one larger, and no
    empty ones."""
    if batches >= n:
        return [1] * n
    return [n // batches + (k < n % batches) for k in range(batches)]


def split(items: Sequence, batches: int) -> list[list]:
    out, at = [], 0
    for size in batch_sizes(len(items), batches):
        out.append(list(items[at : at + size]))
        at += size
    return out


def has_alpha(channels: Column) -> Column:
    return channels.isin(2, 4)


def masked_channels(channels: Column, masked: Column) -> Column:
    """Channels of a window: one more where a mask is laid on 1 or 3."""
    return channels + F.when(masked & channels.isin(1, 3), 1).otherwise(0)


def alpha_plane(pixels: DataFrame, cells: DataFrame, *keys: str, opaque: int = 255) -> DataFrame:
    """``pixels`` with alpha: ``opaque`` on the cells of a region, 0 elsewhere.  ``cells``
    is (keys, y, x); an empty region gives zeros everywhere."""
    inside = cells.select(*keys, "y", "x").distinct().withColumn("_in", F.lit(True))
    return pixels.join(dealt(inside), [*keys, "y", "x"], "left").withColumn("alpha", F.when(F.col("_in"), opaque).otherwise(0)).drop("_in")


def without_outline(cells: DataFrame, *keys: str) -> DataFrame:
    """``cells`` but those with a free side: a mask whose outline is left out."""
    near = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))]))
    around = cells.select(*keys, "y", "x", near.alias("d")).select(*keys, (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    full = around.groupBy(*keys, "y", "x").count().where("count = 4").drop("count")
    return cells.join(dealt(full), [*keys, "y", "x"], "left_semi")
