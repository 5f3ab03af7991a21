"""First-match routing of objects and per-route classification."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import dealt, shuffle_width, written


def catch_all() -> Column:
    return F.lit(True)


def labels_index(labels: Sequence) -> dict:
    """Label to position; a label given twice keeps the last."""
    return {label: k for k, label in enumerate(labels)}


def label_count(mapping: Sequence | Mapping | None) -> int:
    """Labels of a mapping; none without one."""
    return 0 if mapping is None else len(mapping) if isinstance(mapping, Mapping) else len(labels_index(mapping))


def rule_based(objects: DataFrame, rules: Sequence[Column], labels: Sequence | None = None) -> DataFrame:
    """``objects`` with dispatch: the label of the first rule that holds, null if none
    does.  Rules are expressions; later ones are not evaluated where one held."""
    labels = [str(k) for k in range(len(rules))] if labels is None else labels
    if len(labels) != len(rules):
        raise ValueError("as many labels as rules are needed")
    route = F.lit(None).cast("string")
    for rule, label in list(zip(rules, labels))[::-1]:
        route = F.when(rule, F.lit(str(label))).otherwise(route)
    return objects.withColumn("dispatch", route)


def staged(objects: DataFrame, rules: Sequence[Callable[[DataFrame], DataFrame]], labels: Sequence[str], key: Sequence[str]) -> DataFrame:
    """As rule_based, for costly rules: each gets only the rows no rule before took and
    returns the keys it takes, which are written.  What rules have taken so far meets the
    objects in one sort-merge join a rule, dealt to as many partitions as a shuffle has,
    however many rules there were before.  Rows with null keys are never taken."""
    spread = lambda df: df.repartition(shuffle_width(objects.sparkSession), *key)
    wide = spread(objects)
    rest, taken = wide, None
    for k, rule in enumerate(rules[: len(labels)]):
        hit = written(rule(rest).select(*key).distinct().withColumn("_route", F.lit(k)), "taken")
        taken = hit if taken is None else taken.unionByName(hit)
        rest = wide.join(dealt(spread(taken.select(*key))), list(key), "left_anti")
    if taken is None:
        return objects.withColumn("dispatch", F.lit(None).cast("string"))
    first = taken.groupBy(*key).agg(F.min("_route").alias("_route"))
    route = F.lit(None).cast("string")
    for k, label in enumerate(labels[: len(rules)]):
        route = F.when(F.col("_route") == k, F.lit(label)).otherwise(route)
    return wide.join(dealt(first), list(key), "left").select(*objects.columns, route.alias("dispatch"))


def indexed(objects: DataFrame, mapping: Sequence | Mapping | None) -> DataFrame:
    """``objects`` with dispatch_idx, the label's place in ``mapping``, -1 if absent;
    without a mapping the label itself is the index."""
    if mapping is None:
        return objects.withColumn("dispatch_idx", F.coalesce(F.col("dispatch").cast("int"), F.lit(-1)))
    places = mapping if isinstance(mapping, Mapping) else labels_index(mapping)
    pairs = [F.lit(x) for label, k in places.items() for x in (str(label), int(k))]
    index = F.element_at(F.create_map(*pairs), F.col("dispatch")) if pairs else F.lit(None)
    return objects.withColumn("dispatch_idx", F.coalesce(index.cast("int"), F.lit(-1)))


def counts(objects: DataFrame) -> DataFrame:
    """(dispatch, n), undispatched objects under null."""
    return objects.groupBy("dispatch").agg(F.count("*").alias("n"))


def classify(objects: DataFrame, classifiers: Sequence[tuple[Column, Column]]) -> DataFrame:
    """``objects`` with pred and proba from the (class, probability) expressions of
    their dispatch_idx; undispatched ones get null and 0."""
    pred, proba = F.lit(None).cast("int"), F.lit(0.0)
    for k, (c, p) in enumerate(classifiers):
        pred = F.when(F.col("dispatch_idx") == k, c.cast("int")).otherwise(pred)
        proba = F.when(F.col("dispatch_idx") == k, p.cast("double")).otherwise(proba)
    return objects.withColumns({"pred": pred, "proba": F.coalesce(proba, F.lit(0.0)).cast("float")})


def classify_models(objects: DataFrame, models: Sequence[Callable], batch: str = "dispatch_idx") -> DataFrame:
    """As classify, with models from a pandas frame of objects to (classes,
    probabilities).  Batches are Arrow's; rows of one route go to its model together."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            frame = frame.assign(pred=pd.array([None] * len(frame), "Int32"), proba=0.0)
            for k, part in frame.groupby(batch):
                if k >= 0:
                    pred, proba = models[int(k)](part)
                    frame.loc[part.index, "pred"] = pd.array(list(pred), "Int32")
                    frame.loc[part.index, "proba"] = list(proba)
            yield frame

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in objects.schema.fields)
    return objects.mapInPandas(run, f"{kinds}, pred int, proba float")


def centre_pixel(objects: DataFrame, pixels: DataFrame) -> DataFrame:
    """``objects`` with v, the pixel under the centroid (null if there is none)."""
    at = objects.withColumns({"y": F.floor("cy").cast("long"), "x": F.floor("cx").cast("long")})
    return at.join(dealt(pixels.select("image_id", "y", "x", "v")), ["image_id", "y", "x"], "left").drop("y", "x")


def zonal(runs: DataFrame, pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, mean, low, high) of the pixels under each region's runs."""
    from .merge import cells_of

    cells = cells_of(runs.select(*keys, "y", "x0", "x1"))
    return cells.join(dealt(pixels.select("image_id", "y", "x", "v")), ["image_id", "y", "x"]).groupBy(*keys).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
