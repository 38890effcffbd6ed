import random

import pytest
from pyspark.sql import functions as F

from corelode.operators import blocks

SCHEMA = "_row long, x double, y double, z double, dx double, dy double, dz double, rock string"


def brute(points, model):
    out = {}
    for i, px, py, pz in points:
        known = [b for b in model if None not in b[1:4]]
        if None in (px, py, pz) or not known:
            out[i] = (None, True)
            continue
        d = lambda b: ((px - b[1]) * (px - b[1]) + (py - b[2]) * (py - b[2]) + (pz - b[3]) * (pz - b[3]), b[0])  # noqa: B023, E731
        b = min(known, key=d)
        held = None not in b[4:7] and all(abs(p - c) <= s / 2 + blocks.TOLERANCE for p, c, s in zip((px, py, pz), b[1:4], b[4:7], strict=True))
        out[i] = (b[7] if held else None, not held)
    return out


def check(spark, points, model):
    got = blocks.nearest_block(spark.createDataFrame(points, "id long, x_mid double, y_mid double, z_mid double").repartition(3), spark.createDataFrame(model, SCHEMA).repartition(2), ["rock"])
    assert {r["id"]: (r["rock"], r["outside_model"]) for r in got.collect()} == brute(points, model)
    return brute(points, model)


def grid(n, size=10.0, start=0, at=0.0):
    cells = [(i, j, k) for i in range(n) for j in range(n) for k in range(n)]
    return [(start + m, at + i * size, at + j * size, at + k * size, size, size, size, f"g{start + m}") for m, (i, j, k) in enumerate(cells)]


def scattered(rng, n, low, high):
    return [(i, *(float(rng.choice([rng.randint(low, high), rng.uniform(low, high)])) for _ in range(3))) for i in range(n)]


def test_one_block_far_larger_than_the_others(spark):
    """Small blocks around and in a block a thousand times as large: many points in it are nearer to some small centroid, which doesn't hold them."""
    rng = random.Random(1)
    model = [*grid(6), (9000, 4000.0, 0.0, 0.0, 1e4, 1e4, 1e4, "giant")]
    points = scattered(rng, 300, -20, 80) + [(1000 + i, rng.uniform(-1000, 9000), rng.uniform(-5000, 5000), rng.uniform(-5000, 5000)) for i in range(300)]
    want = check(spark, points, model)
    assert {"giant", None} < {r for r, _ in want.values()} and sum(r == "giant" for r, _ in want.values()) > 50


@pytest.mark.parametrize("seed", range(3))
def test_random_models_of_mixed_sizes(spark, seed):
    """Sizes over five decades, repeated centroids, ties at equal distance, blocks without size or place, points without place."""
    rng = random.Random(seed)
    size = lambda: rng.choice([0.1, 1.0, 4.0, 10.0, 10.0, 200.0, 5000.0])
    model = []
    for i in range(250):
        s = size()
        at = [float(rng.randint(-30, 30) * 2) for _ in range(3)]
        model.append((i, *at, s, rng.choice([s, s / 3]), s, f"r{i}"))
    model += [(500 + i, *model[i][1:4], *model[i + 1][4:7], f"twin{i}") for i in range(20)]
    model += [(700, 1.0, 1.0, 1.0, 0.0, 5.0, 5.0, "flat"), (701, 3.0, 3.0, 3.0, None, 5.0, 5.0, "null"), (702, None, 3.0, 3.0, 9.0, 9.0, 9.0, "nowhere"), (703, 5.0, 5.0, 5.0, -4.0, 4.0, 4.0, "negative")]
    rng.shuffle(model)
    points = scattered(rng, 400, -70, 70) + [(1000, None, 1.0, 1.0), (1001, 1e7, 0.0, 0.0)]
    want = check(spark, points, model)
    assert 5 < sum(not out for _, out in want.values()) < 400


def test_regular_models_pass_one_join(spark):
    rng = random.Random(4)
    model = grid(5)
    points = scattered(rng, 300, -8, 52)
    check(spark, points, model)
    plan = blocks.nearest_block(spark.createDataFrame(points, "id long, x_mid double, y_mid double, z_mid double"), spark.createDataFrame(model, SCHEMA), ["rock"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join ") + plan.count("HashJoin") <= 2 and "__lost" not in plan


def test_lists_stay_short_whatever_one_block(spark):
    """The filed lists of 8,000 small blocks with a giant among them."""
    model = spark.createDataFrame([*grid(20), (9000, 100.0, 100.0, 100.0, 1e4, 1e4, 1e4, "giant")], SCHEMA)
    known = model.withColumn("h", blocks._half())
    low = known.agg(F.min("h")).collect()[0][0]
    cells = blocks.cells_of({n: F.col(n) for n in "xyz"}, F.col("h"), F.lit(low * (1 + 1e-8)))
    rows = known.where(F.col("h") < 2 * low)
    for n, c in zip("xyz", cells, strict=True):
        rows = rows.withColumn(f"c{n}", F.explode(c))
    assert rows.groupBy("cx", "cy", "cz").count().agg(F.max("count")).collect()[0][0] < 100
    subs = blocks.box_pyramid(model.select("x", "y", "z", F.col("_row").alias("o")), [14, 6]).agg(F.max(F.size("subs"))).collect()[0][0]
    assert subs <= 512


def test_no_blocks_and_no_points(spark):
    points = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "id long, x_mid double, y_mid double, z_mid double")
    model = spark.createDataFrame([], SCHEMA)
    assert [(r["rock"], r["outside_model"]) for r in blocks.nearest_block(points, model, ["rock"]).collect()] == [(None, True)]
    mixed = spark.createDataFrame([*grid(2), (99, 0.0, 0.0, 0.0, 500.0, 500.0, 500.0, "big")], SCHEMA)
    assert blocks.nearest_block(points.limit(0), mixed, ["rock"]).collect() == []


def test_long_lists_dont_go_over_the_driver(spark):
    """Lists that are short once they are exchanged aren't taken for small: a model of one size with more than blocks.FEW blocks."""
    model = spark.range(1_200).selectExpr("id _row", "double(id % 20) x", "double(id div 20 % 10) y", "double(id div 200) z", "1D dx", "1D dy", "1D dz", "'r' rock")
    points = spark.range(500).selectExpr("id", "id % 19 + 0.2 x_mid", "id % 7 + 0.3 y_mid", "id % 4 + 0.1 z_mid")
    found = blocks.nearest_block(points, model, ["rock"])
    assert found.where("not outside_model").count() == 500
    rows = found.collect()
    assert len(rows) == 500 and "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
