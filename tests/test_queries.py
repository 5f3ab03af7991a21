"""Every registered query of the engine against its SQL."""

from __future__ import annotations

import os

import pytest

from compare import SMALL, differences, oracle
from tilequarry.plans import registry

WHERE = os.environ.get("TEST_SF_DIR", SMALL)


@pytest.mark.parametrize("name", registry.ORACLES)
def test_query_equals_sql(spark, name):
    found = registry.QUERIES[name](spark, WHERE).toArrow()
    assert not differences(found, oracle(registry.ORACLES[name], WHERE))


def test_every_query_has_sql_but_the_outlines():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"region_shapes"}
