"""The bounded content profile against sorting whole columns."""

import random

import pytest
from pyspark.sql import functions as F

from postpulse.sources import schema


@pytest.mark.parametrize("order", ["n", None])
def test_smallest_values_of_every_column(spark, order):
    rng = random.Random(3)
    rows = [(rng.randrange(500), rng.choice([None, "x", f"v{i}"]), None if i % 9 else i / 2, None) for i in range(3000)]
    df = spark.createDataFrame(rows, "n int, text string, `odd name` double, nothing string").repartition(7)
    found = schema.column_values(df, order, k=50)
    assert found.filter("ordinal < 0").first()["rows"] == 3000
    place = F.col("n") if order else F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    for i, c in enumerate(df.columns):
        text = F.col(f"`{c}`").cast("string")
        want = [r["v"] for r in df.select(place.alias("o"), text.alias("v")).filter("v is not null").orderBy("o", "v").limit(50).collect()]
        assert [r["value"] for r in found.filter(F.col("ordinal") == i).orderBy("pos").collect()] == want
    assert "nothing" in [r["column"] for r in schema.column_candidates(df, order).collect()]


def test_profile_of_empty_and_narrow_frames(spark):
    none = spark.createDataFrame([], "text string, n int")
    assert [(r["row_count"], r["column"]) for r in schema.profile_table(none).collect()] == [(0, "text"), (0, "n")]
    plan = schema.column_values(spark.createDataFrame([("a", 1)], "text string, n int"))
    assert plan.count() == 3
