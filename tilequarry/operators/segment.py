"""Pixel to class: projections over the pixel relation."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TileReadError
from ..tables import shuffle_width


def semantic(pixels: DataFrame, rule: Column) -> DataFrame:
    """``pixels`` with cls, an integer class by any expression of the pixel."""
    return pixels.withColumn("cls", rule.cast("int"))


def binary(pixels: DataFrame, foreground: Column, classes: Sequence[int] = (0, 255)) -> DataFrame:
    return semantic(pixels, F.when(foreground, classes[1]).otherwise(classes[0]))


def above(value: Column, cut: float) -> Column:
    return value > cut


def between(value: Column, low: float, high: float) -> Column:
    """Strictly inside the band."""
    return (value > low) & (value < high)


def argmax(probabilities: Column) -> Column:
    """Index of the largest probability, the first of equals."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def true_labels(cls: Column, classes: Sequence[int] | None) -> Column:
    """Class index to class label."""
    if not classes:
        raise ValueError("classes are not defined")
    return F.element_at(F.array(*map(F.lit, classes)), cls + 1)


def class_count(classes: Sequence[int] | None) -> int:
    return len(classes) if classes else -1


def _tolerant(model: Callable) -> Callable:
    """``model`` with failed tiles as no rows and a warning in the task's log."""

    def run(frame):
        try:
            return model(frame)
        except TileReadError as error:
            warnings.warn(f"tile {frame['tile_id'].iloc[0]} of image {frame['image_id'].iloc[0]} is left out: {error}", stacklevel=2)
            return None

    return run


@dataclass(frozen=True)
class TileModel:
    """A segmenter that looks at whole tiles: ``model`` gets a list of pandas frames, one
    a tile, and returns a frame (image_id, tile_id, y, x, cls) for each."""

    model: Callable
    schema: str = "image_id long, tile_id long, y long, x long, cls int"


def by_tile(tile_pixels: DataFrame, model: Callable, schema: str) -> DataFrame:
    """A model that needs a tile's neighbourhoods: ``model`` gets each tile's pixels
    as a pandas frame and returns frames of ``schema``.  One tile is in memory.  A tile
    for which it raises TileReadError has no rows; other errors fail the job."""
    return by_batch(tile_pixels, lambda frames: [model(f) for f in frames], schema, 1)


def by_batch(tile_pixels: DataFrame, model: Callable, schema: str, size: int) -> DataFrame:
    """As ``by_tile`` with ``size`` tiles of following ids a call: ``model`` gets a list
    of frames and returns one frame for each.  Where a call fails with TileReadError, its
    tiles are tried one by one, so that only failing ones are left out."""
    names = [c.split()[0].strip("`") for c in schema.split(",")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frames = [f for _, f in frame.groupby("tile_id", sort=True)] if size > 1 else [frame]
        try:
            found = model(frames)
        except TileReadError:
            found = [_tolerant(lambda f: model([f])[0])(f) for f in frames]
        found = [f for f in found if f is not None and len(f)]
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=names)

    def called(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of the rows of a call, which follow one another."""
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            key = frame[["image_id", "call"]]
            if held:
                last = held[-1][["image_id", "call"]].iloc[-1]
                key = pd.concat([last.to_frame().T.astype(key.dtypes), key])
            before = key.shift()
            fresh = ((key != before) & ~(key.isna() & before.isna())).any(axis=1).to_numpy()[1 if held else 0 :]
            cuts = np.flatnonzero(fresh)
            frame = frame.reset_index(drop=True)
            out = []
            if len(cuts) and held:
                out.append(run(pd.concat([*held, frame.iloc[: cuts[0]]], ignore_index=True).drop(columns="call")))
                held = []
            whole = frame.drop(columns="call")
            out += [run(whole.iloc[a:b].reset_index(drop=True)) for a, b in zip(cuts[:-1], cuts[1:])]
            held.append(frame.iloc[cuts[-1] :] if len(cuts) else frame)
            out = [f for f in out if len(f)]
            if out:
                yield pd.concat(out, ignore_index=True)
        if held:
            yield run(pd.concat(held, ignore_index=True).drop(columns="call"))

    calls = tile_pixels.withColumn("call", F.expr(f"(tile_id - 1) div {int(size)}")).repartition(shuffle_width(tile_pixels.sparkSession), "image_id", "call")
    return calls.sortWithinPartitions("image_id", "call", "tile_id").mapInPandas(called, schema)
