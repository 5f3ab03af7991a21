"""Connected components and tables of the shared folder."""

from __future__ import annotations

import random

import pytest

from tilequarry import tables


def roots(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def shuffled_chain(n):
    ids = list(range(n))
    random.Random(n).shuffle(ids)
    return list(zip(ids, ids[1:]))


SHAPES = {
    "chain in order": [(i, i + 1) for i in range(300)],
    "shuffled chain": shuffled_chain(3000),
    "stars": [(i, i % 7 - 50) for i in range(400)] + [(1000, i) for i in range(1001, 1200)],
    "repeated and self links": [(1, 2), (2, 1), (1, 2), (3, 3), (5, 4), (4, 4)],
    "random": [(random.Random(i).randrange(900), random.Random(-i - 1).randrange(900)) for i in range(500)],
}


@pytest.mark.parametrize("one_task", [60, 20_000])
@pytest.mark.parametrize("shape", SHAPES)
def test_components(spark, shape, one_task):
    links = SHAPES[shape]
    found = tables.components(spark.createDataFrame(links, "a long, b long"), one_task=one_task).collect()
    assert {r.node: r.component for r in found} == roots(links) and len(found) == len(roots(links))


def test_components_of_nothing_and_of_nulls(spark):
    none = spark.createDataFrame([(None, 1), (2, None)], "a long, b long")
    assert tables.components(none).collect() == []
    named = spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")
    assert {tuple(r) for r in tables.components(named, one_task=0).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


@pytest.mark.parametrize("one_task", [0, 100])
def test_components_of_pairs(spark, one_task):
    links = spark.createDataFrame([((1, 5), (1, 4)), ((1, 4), (1, 3)), ((2, 4), (2, 9))], "a struct<i: long, r: long>, b struct<i: long, r: long>")
    found = {(tuple(r.node), tuple(r.component)) for r in tables.components(links, one_task=one_task).collect()}
    assert found == {((1, 3), (1, 3)), ((1, 4), (1, 3)), ((1, 5), (1, 3)), ((2, 4), (2, 4)), ((2, 9), (2, 4))}


def test_release_deletes_tables(spark):
    kept = tables.written(spark.range(3), "some")
    assert kept.count() == 3 and tables.release(spark) >= 1
    with pytest.raises(Exception):
        spark.read.schema("id long").parquet(*kept.inputFiles()).count()
    assert tables.release(spark) == 0
