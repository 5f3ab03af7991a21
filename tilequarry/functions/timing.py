"""Durations of phases: a recorder for drivers, and the same sums over tables."""

from __future__ import annotations

import re
from contextlib import contextmanager
from time import perf_counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PHASE = r"^[^.]+(\.[^.]+)*$"


class Timings(dict):
    """Phase (dotted path, under ``root`` if there is one) to its durations in seconds."""

    def __init__(self, root: str | None = None):
        super().__init__()
        if root is not None:
            self.check(root)
        self.root, self._running = root, {}

    @staticmethod
    def check(phase: str) -> None:
        if not phase or not re.match(PHASE, phase):
            raise ValueError(f"{phase!r} is no phase: names separated by single dots")

    def full(self, phase: str) -> str:
        self.check(phase)
        return phase if self.root is None else f"{self.root}.{phase}"

    def start(self, phase: str) -> None:
        self._running[self.full(phase)] = perf_counter()

    def end(self, phase: str) -> None:
        name = self.full(phase)
        self.setdefault(name, []).append(perf_counter() - self._running.pop(name))

    @contextmanager
    def phase(self, name: str):
        self.start(name)
        try:
            yield self
        finally:
            self.end(name)

    def total(self, phase: str) -> float:
        return float(sum(self[self.full(phase)]))

    def statistics(self, full_phase: str) -> dict[str, float]:
        x = np.array(self[full_phase], float)
        return {"count": len(x), "mean": float(x.mean()), "std": float(x.std()), "min": float(x.min()), "max": float(x.max()), "sum": float(x.sum())}

    def merge(self, other: Timings) -> Timings:
        if not isinstance(other, Timings):
            raise TypeError("only timings can be merged")
        if other is not self:
            for phase, values in other.items():
                self.setdefault(phase, []).extend(values)
        return self

    def hierarchy(self) -> dict:
        """Phases as a tree; an unrecorded node with one child is joined with it."""
        tree: dict = {}
        for phase in sorted(self):
            at = tree
            for part in phase.split("."):
                at = at.setdefault(part, {})

        def joined(node: dict, path: str) -> dict:
            out = {}
            for name, below in node.items():
                full = f"{path}.{name}" if path else name
                while len(below) == 1 and full not in self:
                    (only, deeper), = below.items()
                    name, full, below = f"{name}.{only}", f"{full}.{only}", deeper
                out[name] = joined(below, full)
            return out

        return joined(tree, "")

    def report(self, log, indent: str = "  ") -> None:
        def show(node: dict, path: str, depth: int) -> None:
            for name, below in node.items():
                full = f"{path}.{name}" if path else name
                stats = f" {self.statistics(full)['count']} x {self.statistics(full)['mean']:.5f} s, {self.statistics(full)['sum']:.5f} s" if full in self else ""
                log(f"{indent * depth}{name}:{stats}")
                show(below, full, depth + 1)

        show(self.hierarchy(), "", 0)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, float(d)) for p, ds in self.items() for d in ds], "phase string, duration double")


def merged(a: Timings, b: Timings) -> Timings:
    return Timings().merge(a).merge(b)


def valid(phase: Column) -> Column:
    return F.coalesce(phase.rlike(PHASE), F.lit(False))


def statistics(timings: DataFrame) -> DataFrame:
    """(phase, n, mean, std, low, high, total), std over the population."""
    d = F.col("duration")
    return timings.groupBy("phase").agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.min(d).alias("low"), F.max(d).alias("high"), F.sum(d).alias("total"))


def rolled_up(timings: DataFrame) -> DataFrame:
    """(prefix, depth, n, total): each phase counted under all its prefixes."""
    parts = F.split("phase", r"\.")
    df = timings.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts))))
    df = df.withColumn("prefix", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "."))
    return df.groupBy("prefix", "depth").agg(F.count("*").alias("n"), F.sum("duration").alias("total"))
