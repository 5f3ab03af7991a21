"""Fluent builders: setters return the builder, ``get`` checks, builds and resets."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame

from ..errors import ConflictingParts, MissingPart
from ..functions.logs import Log, SilentLog
from ..operators import dispatch
from ..operators.segment import TileModel
from ..operators.tiling import Grid
from .workflow import Chain, Detection, Stage, Workflow, keep_all


class _Builder:
    def __init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self._grid, self.tolerance, self.log, self.segmenter = {}, 1, SilentLog(), None
        self.seg_batch_size, self.n_jobs = 1, 1

    @property
    def grid(self) -> Grid:
        """Checked only when it is whole: setters may come in any order."""
        return Grid(**self._grid)

    def set_segmenter(self, segmenter: Column | TileModel | Callable):
        self.segmenter = segmenter
        return self

    def set_tile_size(self, height: int, width: int):
        self._grid |= {"height": height, "width": width}
        return self

    def set_overlap(self, overlap: int):
        self._grid["overlap"] = overlap
        return self

    def set_border_tiles(self, borders: str):
        self._grid["borders"] = borders
        return self

    def set_distance_tolerance(self, tolerance: int):
        if tolerance is None:
            raise ValueError("a tolerance is needed")
        self.tolerance = tolerance
        return self

    def set_seg_batch_size(self, size: int):
        """Tiles of a TileModel's call.  Clipped border tiles can't be stacked, so a batch
        needs another border policy."""
        self.seg_batch_size = size
        return self

    def set_n_jobs(self, n: int):
        """Kept for callers; the cluster decides how much runs at once."""
        self.n_jobs = n
        return self

    def set_logger(self, log: Log):
        self.log = log
        return self

    def _check(self) -> None:
        if self.segmenter is None:
            raise MissingPart("segmenter")
        if self.seg_batch_size > 1 and self.grid.borders == "keep":
            raise ValueError("batches of tiles need tiles of one size: skip or extend the borders")


class DetectionBuilder(_Builder):
    def _reset(self) -> None:
        super()._reset()
        self.rules, self.labels, self.classifiers, self.one_shot, self.pixels = [], [], [], None, False

    def add_classifier(self, rule: Column, classifier: tuple[Column, Column], label: str | None = None):
        self.labels.append(str(len(self.rules)) if label is None else label)
        self.rules.append(rule)
        self.classifiers.append(classifier)
        return self

    def add_catchall_classifier(self, classifier: tuple[Column, Column], label: str = "catchall"):
        return self.add_classifier(dispatch.catch_all(), classifier, label)

    def set_one_shot_dispatcher(self, dispatcher: Callable[[DataFrame], DataFrame], classifiers: Mapping[str, tuple[Column, Column]]):
        """A dispatcher of its own (adds column dispatch) and a classifier a label."""
        self.one_shot = (dispatcher, dict(classifiers))
        return self

    def set_needs_pixels(self, needed: bool = True):
        """Rules and classifiers may use v, the pixel under the centroid."""
        self.pixels = needed
        return self

    def get(self) -> Detection:
        self._check()
        if self.one_shot and self.rules:
            raise ConflictingParts("rules and a one-shot dispatcher exclude one another")
        if not self.one_shot and not self.rules:
            raise MissingPart("dispatching rules and classifiers")
        base = {"segmenter": self.segmenter, "grid": self.grid, "tolerance": self.tolerance, "log": self.log, "needs_pixels": self.pixels, "seg_batch_size": self.seg_batch_size}
        if self.one_shot:
            dispatcher, by = self.one_shot
            out = Detection(**base, dispatcher=dispatcher, mapping=list(by), classifiers=list(by.values()))
        else:
            out = Detection(**base, rules=self.rules, labels=self.labels, classifiers=self.classifiers)
        self._reset()
        return out


class LabellingBuilder(_Builder):
    def _reset(self) -> None:
        super()._reset()
        self.background = -1

    def set_background_class(self, background: int):
        self.background = background
        return self

    def get(self) -> Workflow:
        self._check()
        out = Workflow(self.segmenter, self.grid, self.tolerance, self.background, True, self.log, seg_batch_size=self.seg_batch_size)
        self._reset()
        return out


class ChainBuilder:
    def __init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self.first, self.label, self.stages = None, "0", []

    def set_first_workflow(self, workflow: Workflow, label: str | None = None):
        self.first, self.label = workflow, "0" if label is None else label
        return self

    def add_executor(self, workflow: Workflow, chosen: Callable[[DataFrame], DataFrame] = keep_all, label: str | None = None, translate: bool = True, masked: bool = True):
        """A further stage; ``masked``: it sees only the cells of the objects it looks at."""
        self.stages.append(Stage(workflow, chosen, str(len(self.stages) + 1) if label is None else label, translate, masked))
        return self

    def get(self) -> Chain:
        if self.first is None:
            raise MissingPart("first workflow")
        labels = [self.label, *(s.label for s in self.stages)]
        if len(set(labels)) < len(labels):
            raise ConflictingParts(f"stages need labels of their own: {', '.join(labels)}")
        out = Chain(self.first, self.stages, self.label)
        self._reset()
        return out
