import math
import random

from pyspark.sql import functions as F

from corelode.operators import joins


def plain(spans, cuts, tolerance=1e-6):
    out = []
    for k, a, b in spans:
        if a is None or b is None or not b - a > tolerance:
            continue
        inside = sorted({c for q, c in cuts if k is not None and q == k and c is not None and a + tolerance < c < b - tolerance})
        edges = [a, *inside, b]
        out += [(k, x, y) for x, y in zip(edges, edges[1:], strict=False) if y - x > tolerance]
    return sorted(out, key=repr)


def split(spark, spans, cuts):
    a = spark.createDataFrame(spans, "hole_id string, from_m double, to_m double").repartition(3)
    b = spark.createDataFrame(cuts, "hole_id string, at_m double").repartition(3)
    return joins.split_intervals(a, b)


def test_intervals_of_all_lengths(spark):
    """From millimetres to light years, at borders of nodes, negative, null and reversed."""
    rng = random.Random(1)
    spans, cuts = [], []
    for _ in range(600):
        a = rng.choice([0.0, 64.0, -64.0, 128.0, rng.uniform(-500, 500), rng.uniform(-1e5, 1e5)])
        size = rng.choice([64.0, 128.0, 256.0, 1e-3, 63.999999999, 64.000000001, rng.uniform(0, 100), 10 ** rng.uniform(0, 17)])
        spans.append((rng.choice("ab"), a, a + size))
    spans += [("a", None, 5.0), ("a", 5.0, None), ("a", 7.0, 3.0), ("c", 0.0, 10.0), (None, 0.0, 10.0), ("a", 1.0, 1.0)]
    for _ in range(300):
        cuts.append((rng.choice("ab"), rng.choice([0.0, 64.0, 128.0, -64.0, rng.uniform(-600, 600), rng.uniform(-2e5, 2e5), 10 ** rng.uniform(0, 17)])))
    cuts += [("a", None), ("z", 1.0), (None, 5.0), ("a", math.nextafter(64.0, 65.0))]
    got = sorted((tuple(r) for r in split(spark, spans, cuts).collect()), key=repr)
    assert got == plain(spans, cuts)


def test_no_node_gathers_more_than_an_interval_asks_for(spark):
    """A hot key with very many boundaries, short intervals of it, and one long interval of another key."""
    cuts = spark.range(200_000).select(F.lit("h").alias("hole_id"), (F.col("id") * 0.5).alias("at_m"))
    spans = spark.range(50).select(F.lit("h").alias("hole_id"), (F.col("id") * 1900.0).alias("from_m"), (F.col("id") * 1900.0 + 3).alias("to_m"))
    spans = spans.unionByName(spark.createDataFrame([("x", 0.0, 1e6)], "hole_id string, from_m double, to_m double"))
    asked = spans.withColumn("__ic", joins._level(F.col("to_m") - F.col("from_m"))).withColumn("__ib", joins._node(F.col("from_m"), F.col("__ic"))).select(F.col("hole_id").alias("__ik"), "__ic", "__ib")
    filed = joins._filed(cuts, asked, "at_m", "hole_id").select("__by", "__c", F.size("__cuts").alias("n")).collect()
    assert 50 <= len(filed) <= 100 and {r["__c"] for r in filed} == {0} and max(r["n"] for r in filed) <= 256
    out = joins.split_intervals(spans, cuts)
    assert out.where("hole_id = 'h'").count() == 50 * 6 and out.where("hole_id = 'x'").count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
