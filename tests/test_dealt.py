import re

import pytest
from pyspark.sql import functions as F

from corelode.operators import geometry, intervals, joins, scans

N = 400


def tables(spark, shared):
    """Samples of a metre in ten holes, cut at 7.3 and 15; with `shared` some ids stand in two holes."""
    k = F.col("id")
    hole, at = (k % 10).cast("string"), F.floor(k / 10).cast("double")
    name = F.when((k % 10 < 2) & (at < 5), F.concat(F.lit("s"), at.cast("int"))).otherwise(F.concat(hole, F.lit("-"), at.cast("int"))) if shared else F.concat(hole, F.lit("-"), at.cast("int"))
    assay = spark.range(N).select(hole.alias("hole_id"), name.alias("sample_id"), at.alias("from_m"), (at + 1).alias("to_m"), (k * 1.5).alias("elem_zn"))
    holes = spark.range(10)
    litho = holes.select(F.col("id").cast("string").alias("hole_id"), F.explode(F.array(*(F.struct(F.lit(a).alias("from_m"), F.lit(b).alias("to_m"), F.lit(c).alias("logged_code")) for a, b, c in ((0.0, 7.3, "A"), (7.3, 15.0, "B"), (15.0, 30.0, "C"))))).alias("l")).select("hole_id", "l.*")
    lookup = spark.createDataFrame([("A", "ONE"), ("B", "TWO")], "logged_code string, geomet_domain string")
    collar = holes.select(F.col("id").cast("string").alias("hole_id"), (k * 10.0).alias("east"), F.lit(0.0).alias("north"), F.lit(100.0).alias("rl"), F.lit(50.0).alias("total_depth"))
    survey = holes.select(F.col("id").cast("string").alias("hole_id"), F.explode(F.array(F.lit(0.0), F.lit(20.0))).alias("depth"), F.lit(-80.0).alias("dip")).withColumn("azimuth", F.col("depth") * 2)
    return assay, litho, lookup, geometry.traces(collar, survey)


def framework(spark, shared, tasks):
    assay, litho, lookup, trace = tables(spark, shared)
    return geometry.with_coordinates(intervals.build_framework(assay, litho, lookup, (), None, tasks), trace, tasks=tasks, dealt=True)


@pytest.mark.parametrize("shared", [False, True])
def test_rows_dealt_once_are_the_same(spark, shared):
    plain, dealt = framework(spark, shared, None), framework(spark, shared, 7)
    assert plain.columns == dealt.columns
    want, got = (sorted(map(tuple, d.select([F.round(c, 9) if t == "double" else F.col(c) for c, t in d.dtypes]).collect())) for d in (plain, dealt))
    assert len(got) == N + 10 and got == want  # 7.3 lies inside a sample of each hole
    assert sum("_" in r[plain.columns.index("interval_id")] for r in got) == 20 + 10 * shared


def test_samples_are_exchanged_by_hole_alone_and_once(spark):
    found = framework(spark, False, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\((parent_)?sample_id", plan)
    assert plan.count("Union") >= 4 and not re.search(r"Exchange [^\n]*\n[^\n]*Union", plan)  # of samples with logs or stations


def test_long_logs_are_filed_by_nodes(spark, monkeypatch):
    """Where a hole has more boundaries than an interval may look through, pieces are the same."""
    assay, litho, _, _ = tables(spark, False)
    cuts = intervals.contacts(litho)
    brief = sorted(map(tuple, joins.split_intervals(assay, cuts, tasks=7).collect()))
    monkeypatch.setattr(joins, "BRIEF", 3)
    assert brief == sorted(map(tuple, joins.split_intervals(assay, cuts, tasks=7).collect())) == sorted(map(tuple, joins.split_intervals(assay, cuts).collect()))


def test_shuffle_files_are_cleaned_and_the_setting_comes_back(spark):
    before = spark.conf.get(scans.CLEANUP, "false")
    with pytest.raises(ValueError, match="x"), scans.cleaned(spark):
        assert spark.conf.get(scans.CLEANUP) == "true"
        raise ValueError("x")
    assert spark.conf.get(scans.CLEANUP, "false") == before
