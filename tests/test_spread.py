"""Queries with much to work out for each row of a small file run on all cores."""

import pytest

from test_queries import DIR, pytestmark  # noqa: F401
from wagerlake import registry


@pytest.mark.parametrize("name", ["M34_poisson_rate", "F11_country_code", "A43_agent_consensus", "F13_plain_positions"])
def test_rows_of_a_small_file_are_dealt_to_all_cores(spark, name):
    assert registry.queries()[name](spark, DIR).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
