import math
import random

import pytest

from corelode.operators import neighbours, select

SCHEMA = "id long, x_mid double, y_mid double, z_mid double, nearest string"


def brute(rows):
    known = [r for r in rows if None not in r[1:4]]
    return {r[0]: min((math.dist(r[1:4], q[1:4]) for q in known if q[0] != r[0]), default=None) if None not in r[1:4] else None for r in rows}


def cases(kind):
    rng = random.Random(kind)
    wide = lambda: [rng.uniform(-1e4, 1e4) for _ in range(3)]
    crowd = lambda: [500 + rng.random() * 1e-3 for _ in range(3)]
    at = {
        "even": lambda i: wide(), "crowd and lone": lambda i: crowd() if i % 2 else wide(), "grid": lambda i: [float(i % 7), float(i // 7 % 7), float(i // 49)], "line": lambda i: [float(2 ** (i % 40)), 0.0, 0.0],
        "one place": lambda i: [1.5, 2.5, 3.5], "tiny": lambda i: [1e9 + rng.random() * 1e-4, 0.0, rng.random() * 1e-6],
    }[kind]
    return [(i, *at(i), "s") for i in range(300)] + [(900, None, 1.0, 1.0, None), (901, 1.0, 1.0, None, None)]


@pytest.mark.parametrize("kind", ["even", "crowd and lone", "grid", "line", "one place", "tiny"])
def test_equal_to_brute_force(spark, kind):
    rows = cases(kind)
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows, SCHEMA).repartition(3), "id")
    assert got.columns == [*(c.split()[0] for c in SCHEMA.split(", ")), "nearest_m"]
    want, got = brute(rows), {r["id"]: r["nearest_m"] for r in got.collect()}
    assert got.keys() == want.keys() and len(got) == len(rows)
    assert all((want[i] is None) == (got[i] is None) and (want[i] is None or math.isclose(want[i], got[i], rel_tol=1e-12, abs_tol=1e-300)) for i in want)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_places(spark, n):
    rows = [(i, 3.0 * i, 4.0 * i, 0.0, None) for i in range(n)]
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), "id")
    assert {r["id"]: r["nearest_m"] for r in got.collect()} == {i: (5.0 if n > 1 else None) for i in range(n)}


def test_mean_equals_the_selection_measure(spark):
    import numpy as np

    rows = [r for r in cases("even")[:40]]
    df = spark.createDataFrame(rows, SCHEMA)
    assert math.isclose(neighbours.mean_nearest(df, "id").collect()[0][0], select.spread(np.array([r[1:4] for r in rows])), rel_tol=1e-12)
    lost = spark.createDataFrame([*rows, (77, None, 0.0, 0.0, None)], SCHEMA)
    assert neighbours.mean_nearest(lost, "id").collect()[0][0] == neighbours.mean_nearest(df.limit(1), "id").collect()[0][0] == 0.0
