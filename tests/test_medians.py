import random
import statistics

import pytest
from pyspark.sql import functions as F

from corelode.operators import checks, medians

KINDS = {
    "normal": lambda r: r.gauss(0, 1), "ties": lambda r: float(r.choice([1, 1, 1, 2, 3])), "one": lambda r: 4.5, "wide": lambda r: r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300),
    "half": lambda r: r.choice([1.0, 1.0 + r.random()]), "outliers": lambda r: r.choice([r.random()] * 50 + [1e308, -1e308]),
}


@pytest.mark.parametrize("kind", KINDS)
def test_equal_to_plain_medians(spark, kind):
    rng = random.Random(kind)
    rows = [(g, KINDS[kind](rng)) for g, n in (("a", 3001), ("b", 4000), ("c", 1), (None, 2), ("d", 12)) for _ in range(n)]
    rows += [("a", None), ("z", None), ("b", float("nan")), ("b", float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    want = {g: statistics.median([v for k, v in rows if k == g and v is not None and abs(v) < float("inf")]) for g in ("a", "b", "c", "d", None)}
    for most in (40, 10_000):
        got = medians.exact_medians(df, "g", "v", most)
        assert {g: m for g, (_, m) in got.items()} == want
        assert got["a"][0] == 3001 and got[None][0] == 2


def test_no_rows_and_too_many_groups(spark):
    assert medians.exact_medians(spark.createDataFrame([], "g string, v double"), "g", "v") == {}
    with pytest.raises(ValueError):
        medians.exact_medians(spark.range(2000).select(F.col("id").alias("g"), F.lit(1.0).alias("v")), "g", "v")


def test_the_issue_tells_the_median(spark):
    rows = [("h", i * 1.0, i + 1.0, 0.0, 0.0, -i * (3.2 + i / 100), 0.0, 0.0, -(i + 1) * (3.2 + i / 100), 0.0, 0.0, 0.0) for i in range(5)]
    rows = [(h, a, b, 0.0, 0.0, -a, 0.0, 0.0, -a - f, 0.0, 0.0, -a - f / 2) for (h, a, b, *_), f in zip(rows, (3.25, 3.28, 3.3, 1.0, 3.29), strict=True)]
    df = spark.createDataFrame(rows, "hole_id string, from_m double, to_m double, x_from double, y_from double, z_from double, x_to double, y_to double, z_to double, x_mid double, y_mid double, z_mid double")
    told = [r["message"] for r in checks.geometry_checks(df).where("check = 'geometry_unit_mismatch'").collect()]
    assert len(told) == 1 and "3.285 times" in told[0]
