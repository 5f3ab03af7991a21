"""Images as relations: images (image_id, width, height, channels) and pixels
(image_id, y, x, v).  Pixel tables may be sparse: a cell that is absent is never
foreground."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ImageReadError


def from_arrays(spark: SparkSession, arrays: dict[int, np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """In-memory images ([h, w] or [h, w, c]) as (images, pixels); with several
    channels, v is an array."""
    images, parts, deep = [], [], any(a.ndim == 3 for a in arrays.values())
    for key, a in arrays.items():
        images.append((key, a.shape[1], a.shape[0], a.shape[2] if a.ndim == 3 else 1))
        y, x = np.indices(a.shape[:2]).reshape(2, -1)
        v = list(a.reshape(len(y), -1).astype(float)) if deep else a.ravel().astype(float)
        parts.append(pd.DataFrame({"image_id": key, "y": y, "x": x, "v": v}))
    kind = "array<double>" if deep else "double"
    pixels = spark.createDataFrame(pd.concat(parts), f"image_id long, y long, x long, v {kind}") if parts else spark.createDataFrame([], f"image_id long, y long, x long, v {kind}")
    return spark.createDataFrame(images, "image_id long, width long, height long, channels int"), pixels


def from_parquet(spark: SparkSession, images: str, pixels: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(images), spark.read.parquet(pixels)


def from_image_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JPEG, PNG, ... by Spark's image source; unreadable files are dropped.  v holds
    the channels in the order of the file's decoder (blue first for colours)."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select(F.xxhash64("image.origin").alias("image_id"), "image.*")
    n = F.col("nChannels")
    cell = F.posexplode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("k", "i")
    byte = lambda c: F.conv(F.hex(F.expr(f"substring(data, int(i * nChannels + {c + 1}), 1)")), 16, 10).cast("double")
    pixels = raw.select("image_id", "width", "nChannels", "data", cell)
    values = F.when(n == 1, F.array(byte(0))).when(n == 3, F.array(byte(0), byte(1), byte(2))).otherwise(F.array(byte(0), byte(1), byte(2), byte(3)))
    pixels = pixels.select("image_id", F.expr("i div width").cast("long").alias("y"), (F.col("i") % F.col("width")).cast("long").alias("x"), values.alias("v"))
    images = raw.select("image_id", F.col("width").cast("long"), F.col("height").cast("long"), n.alias("channels"))
    return images, pixels


def collection(parts: Iterable[tuple[DataFrame, DataFrame] | Callable[[], tuple[DataFrame, DataFrame]]], silent_fail: bool = False) -> tuple[DataFrame, DataFrame]:
    """Several sources as one: a bag union of images and of pixels.  A source may be a
    function that opens it; with ``silent_fail``, those that raise ImageReadError are
    left out with a warning.  None left is an ImageReadError."""
    found = []
    for part in parts:
        try:
            found.append(part() if callable(part) else part)
        except ImageReadError as error:
            if not silent_fail:
                raise
            warnings.warn(f"an image source is left out: {error}", stacklevel=2)
    if not found:
        raise ImageReadError("no source of images is left")
    images, pixels = zip(*found)
    out = [images[0], pixels[0]]
    for i, p in zip(images[1:], pixels[1:]):
        out = [out[0].unionByName(i), out[1].unionByName(p)]
    return out[0], out[1]


def emb8(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each 64-vector of ``embeddings`` as an 8 x 8 image."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v"))
    pixels = rows.select("image_id", F.expr("i div 8").cast("long").alias("y"), (F.col("i") % 8).cast("long").alias("x"), F.col("v").cast("double").alias("v"))
    images = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), F.lit(8).cast("long").alias("width"), F.lit(8).cast("long").alias("height"), F.lit(1).alias("channels"))
    return images, pixels


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a sparse raster: a row a user, a column an hour, v the count."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(1704067200)) / 3600).cast("long")
    return ev.groupBy(F.col("user_id").alias("y"), hour.alias("x")).agg(F.count("*").cast("double").alias("v")).select(F.lit(0).cast("long").alias("image_id"), "y", "x", "v")


def part_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image sizes from ``part``, for topology over many images."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 37).cast("long").alias("width"), ((F.col("p_partkey") % 50 + 1) * 53).cast("long").alias("height"), F.lit(1).alias("channels"))


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer rectangles from ``lineitem`` keys: (box_id, minx, miny, maxx, maxy)."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    minx, miny = F.col("l_partkey") % 500, F.col("l_suppkey") % 400
    return li.select(key.cast("long").alias("box_id"), minx.alias("minx"), miny.alias("miny"), (minx + F.col("l_orderkey") % 60 + 1).alias("maxx"), (miny + F.col("l_linenumber") * 7).cast("long").alias("maxy"))
