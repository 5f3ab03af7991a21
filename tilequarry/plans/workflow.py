"""Whole pipelines over any number of images or windows in one job.

A detection workflow segments to two classes, locates, merges, dispatches and
classifies; a labelling workflow segments to many classes, locates, and merges
regions of equal label.  Both return objects, one row each, and keep the objects'
runs for whoever needs their cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.logs import Log, SilentLog
from ..functions.timing import Timings
from ..operators import dispatch, locate, merge, segment, tiling
from ..tables import dealt, written


@dataclass
class Detected:
    """objects (image_id, object_id, label, measures, ...) and runs (image_id,
    object_id, label, y, x0, x1)."""

    objects: DataFrame
    runs: DataFrame
    timings: Timings = field(default_factory=Timings)


@dataclass
class Workflow:
    """segmenter: a class expression over v, a model of whole tiles, of which
    ``seg_batch_size`` go into a call, or a function of all tile pixels that returns them
    with cls."""

    segmenter: Column | segment.TileModel | Callable[[DataFrame], DataFrame] | None = None
    grid: tiling.Grid = tiling.Grid()
    tolerance: int = 1
    background: int = -1
    labelled: bool = True
    log: Log = field(default_factory=SilentLog)
    root: str = "workflow.label"
    seg_batch_size: int = 1

    def _segmented(self, tile_pixels: DataFrame) -> DataFrame:
        if isinstance(self.segmenter, segment.TileModel):
            return segment.by_batch(tile_pixels, self.segmenter.model, self.segmenter.schema, self.seg_batch_size)
        if callable(self.segmenter):
            return self.segmenter(tile_pixels)
        return segment.semantic(tile_pixels, self.segmenter)

    def _regions(self, images: DataFrame, pixels: DataFrame, timings: Timings) -> Detected:
        with timings.phase("locate"):
            cells = self._segmented(tiling.tile_pixels(images, pixels, self.grid))
            runs = locate.runs(cells, self.background)
        with timings.phase("merge"):
            merged = written(merge.merge(runs, tiling.tiles(images, self.grid), self.tolerance, self.labelled), "objects")
        return Detected(locate.measures(merged, "image_id", "object_id"), merged, timings)

    def process(self, images: DataFrame, pixels: DataFrame) -> Detected:
        out = self._regions(images, pixels, Timings(self.root))
        self.log.info("objects are located and merged")
        return out


@dataclass
class Detection(Workflow):
    """rules and labels: first-match routing; classifiers: a (class, probability)
    pair of expressions for each; mapping: routes to places among classifiers."""

    background: int = 0
    labelled: bool = False
    root: str = "workflow.detect"
    rules: Sequence[Column] = ()
    labels: Sequence[str] | None = None
    dispatcher: Callable[[DataFrame], DataFrame] | None = None
    mapping: Sequence[str] | None = None
    classifiers: Sequence[tuple[Column, Column]] = ()
    needs_pixels: bool = False

    def process(self, images: DataFrame, pixels: DataFrame) -> Detected:
        out = self._regions(images, pixels, Timings(self.root))
        with out.timings.phase("dispatch_classify"):
            objects = dispatch.centre_pixel(out.objects, pixels) if self.needs_pixels else out.objects
            if self.dispatcher is not None:
                objects = self.dispatcher(objects)
            else:
                objects = dispatch.rule_based(objects, self.rules, self.labels)
            names = self.mapping if self.mapping is not None else self.labels if self.labels is not None else [str(k) for k in range(len(self.rules))]
            objects = dispatch.classify(dispatch.indexed(objects, names), self.classifiers)
        return Detected(objects, out.runs, out.timings)


def keep_all(stages: DataFrame) -> DataFrame:
    return stages


@dataclass
class Stage:
    """A further workflow on windows around objects of earlier stages."""

    workflow: Workflow
    chosen: Callable[[DataFrame], DataFrame] = keep_all
    label: str | None = None
    translate: bool = True
    masked: bool = True


@dataclass
class Chain:
    """A first workflow on whole images, then stages on windows of what earlier ones
    found.  All windows of all images of a stage run in one job."""

    first: Workflow
    stages: Sequence[Stage] = ()
    label: str = "0"

    def process(self, images: DataFrame, pixels: DataFrame) -> DataFrame:
        """(stage, stage_ord, image_id, object_id, parent_object_id, ...) of all stages;
        columns that a stage lacks are null."""
        found = self.first.process(images, pixels)
        tag = lambda df, k, name: df.withColumns({"stage": F.lit(name), "stage_ord": F.lit(k)})
        objects = tag(found.objects.withColumn("parent_object_id", F.lit(None).cast("long")), 0, self.label)
        runs = tag(found.runs, 0, self.label)
        objects, runs = written(objects, "stage-objects"), written(runs, "stage-runs")
        for k, stage in enumerate(self.stages, 1):
            name = stage.label if stage.label is not None else str(k)
            wins = written(windows(stage.chosen(objects)), "windows")
            part_images, part_pixels = window_rasters(wins, pixels, runs if stage.masked else None)
            part = stage.workflow.process(part_images, part_pixels)
            back = wins.select(F.col("window_id").alias("image_id"), F.col("image_id").alias("base"), F.col("parent").alias("parent_object_id"), "off_x", "off_y")
            one = _translated(part.objects.join(dealt(back), "image_id"), stage.translate, ("minx", "maxx", "cx"), ("miny", "maxy", "cy"))
            moved = _translated(part.runs.join(dealt(back), "image_id"), stage.translate, ("x0", "x1"), ("y",))
            objects = written(objects.unionByName(tag(one, k, name), allowMissingColumns=True), "stage-objects")
            runs = written(runs.unionByName(tag(moved.drop("parent_object_id"), k, name), allowMissingColumns=True), "stage-runs")
        return objects


def _translated(df: DataFrame, shift: bool, xs: Sequence[str], ys: Sequence[str]) -> DataFrame:
    if shift:
        df = df.withColumns({c: F.col(c) + F.col("off_x") for c in xs} | {c: F.col(c) + F.col("off_y") for c in ys})
    return df.withColumn("object_id", F.xxhash64("image_id", "object_id")).drop("image_id", "off_x", "off_y").withColumnRenamed("base", "image_id")


def windows(objects: DataFrame) -> DataFrame:
    """(window_id, image_id, parent, stage, off_x, off_y, width, height): the box of
    each object, in its image."""
    box = tiling.box(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"))
    df = objects.select("image_id", "stage", F.col("object_id").alias("parent"), *box)
    return df.select(F.xxhash64("image_id", "stage", "parent").alias("window_id"), "image_id", "parent", "stage", F.col("box_x").alias("off_x"), F.col("box_y").alias("off_y"), F.col("box_w").alias("width"), F.col("box_h").alias("height"))


def window_rasters(wins: DataFrame, pixels: DataFrame, runs: DataFrame | None, bin: int = 64) -> tuple[DataFrame, DataFrame]:
    """Windows as images and pixels of their own.  Pixels and windows meet on coarse
    bins of the plane; with ``runs``, only the parent's cells stay."""
    images = wins.select(F.col("window_id").alias("image_id"), "width", "height", F.lit(1).alias("channels"))
    span = lambda at, size: F.explode(F.sequence(F.floor(at / bin), F.floor((at + size - 1) / bin)))
    keyed = wins.withColumn("bx", span(F.col("off_x"), F.col("width"))).withColumn("by", span(F.col("off_y"), F.col("height")))
    cells = pixels.withColumns({"bx": F.floor(F.col("x") / bin), "by": F.floor(F.col("y") / bin)})
    part = cells.join(dealt(keyed), ["image_id", "bx", "by"]).where("x >= off_x AND x < off_x + width AND y >= off_y AND y < off_y + height")
    if runs is not None:
        mask = merge.cells_of(runs.select("image_id", "stage", F.col("object_id").alias("parent"), "y", "x0", "x1"))
        part = part.join(dealt(mask), ["image_id", "stage", "parent", "y", "x"], "left_semi")
    kept = [c for c in pixels.columns if c not in ("image_id", "x", "y")]
    part = part.select(F.col("window_id").alias("image_id"), (F.col("y") - F.col("off_y")).alias("y"), (F.col("x") - F.col("off_x")).alias("x"), *kept)
    return images, part


def with_stage(information: DataFrame, label: str, rows: DataFrame) -> DataFrame:
    """Information on a chain (stage, stage_ord, ...) with ``rows`` as the stage
    ``label``: in place of that stage's rows if it is there, after the last one if not.
    Columns that one side lacks are null."""
    place = information.where(F.col("stage") == label).agg(F.min("stage_ord").alias("own"))
    place = place.join(information.agg((F.coalesce(F.max("stage_ord"), F.lit(-1)) + 1).alias("next"))).select(F.coalesce("own", "next").cast("int").alias("stage_ord"))
    new = rows.drop("stage", "stage_ord").withColumn("stage", F.lit(label)).join(F.broadcast(place))  # one row
    return information.where(F.col("stage") != label).unionByName(new, allowMissingColumns=True)


def merge_results(first: DataFrame, other: DataFrame) -> DataFrame:
    """Both results' rows with the columns of ``first``, all of which ``other`` must
    have; what only ``other`` has is left out."""
    missing = [c for c in first.columns if c not in other.columns]
    if missing:
        raise TypeError(f"the other result has no {', '.join(missing)}")
    return first.unionByName(other.select(first.columns))
