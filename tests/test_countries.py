"""Country names to codes."""

import pytest
from pyspark.sql import functions as F

from wagerlake.plans.countries import country_code


@pytest.mark.parametrize(
    "name, code",
    [
        ("Portugal", "prt"), (" South  Korea ", "kor"), ("southkorea", "kor"), ("Switzerland National Team", "sui"), ("CHE", "sui"), ("sui", "sui"), ("alg", "dza"), ("IRI", "irn"), ("Côte d'Ivoire", "civ"), ("Iran women", "irn"), ("united states of america", "usa"), ("Costa Rica U21", "crc"),
        ("xyz", None), ("", None), ("  ", None), (None, None), ("Atlantis", None),
    ],
)
def test_country_code(spark, name, code):
    got = spark.createDataFrame([(name,)], "name string").select(country_code(F.col("name")).alias("x")).head().x
    assert got == code
