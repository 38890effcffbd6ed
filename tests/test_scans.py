import random

import pytest
from pyspark.sql import functions as F

from corelode.operators import checks, geometry, joins, runs, scans

WANTED = {"number": None, "total": "v", "before": "v", "highest": "v", "known": "v", "previous": "v", "following": "v"}


def table(spark, n=3000, seed=1, hot=0.5):
    """Half of the rows have one key; positions repeat and may be null, values too."""
    rng = random.Random(seed)
    rows = [("h" if rng.random() < hot else rng.choice("abcdefgh") if rng.random() < 0.95 else None, rng.choice([None, *range(400)]), i, rng.choice([None, rng.randint(-50, 50)])) for i in range(n)]
    return spark.createDataFrame([(k, None if p is None else p / 4, i, v) for k, p, i, v in rows], "key string, at double, id long, v long").repartition(5)


def asked():
    return {k: (k, F.col(v) if v else None) for k, v in WANTED.items()}


def test_pieces_give_what_one_window_gives(spark):
    rows = table(spark)
    hot = scans.hot_keys(rows, "key", "at")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = {r["__key"]: r["__splits"] for r in hot.splits.collect()}
    assert "h" in keys and len(keys) < tasks and 4 < len(keys["h"]) < hot.pieces <= (scans.PIECES + 1) * tasks
    one = scans.scanned(rows, "key", ["at", "id"], None, **asked())
    cut = scans.scanned(rows, "key", ["at", "id"], hot, **asked())
    assert one.columns == cut.columns == ["key", "at", "id", "v", *WANTED]
    assert sorted(one.collect(), key=lambda r: r["id"]) == sorted(cut.collect(), key=lambda r: r["id"])


def test_values_by_hand(spark):
    rows = spark.createDataFrame([("h", float(i), i, None if i % 3 == 2 else i) for i in range(60)], "key string, at double, id long, v long")
    hot = scans.HotKeys(spark.createDataFrame([("h", [10.0, 10.5, 40.0])], "__key string, __splits array<double>"), 4)
    got = {r["id"]: r for r in scans.scanned(rows, "key", ["at", "id"], hot, **asked()).collect()}
    sums, top, known = 0, None, None
    for i in range(60):
        v = None if i % 3 == 2 else i
        before = sums if i else None
        sums, known = sums + (v or 0), known if v is None else v
        at = lambda k: None if not 0 <= k < 60 or k % 3 == 2 else k  # noqa: B023, E731
        assert tuple(got[i][4:]) == (i + 1, sums, before, top, known, at(i - 1), at(i + 1)), i
        top = v if top is None else max(top, v or top)


@pytest.mark.parametrize("case", ["none", "null_key", "one_position", "empty", "null_positions"])
def test_odd_keys(spark, case):
    rows = {
        "none": [(f"k{i}", float(i), i, i) for i in range(400)], "null_key": [(None, float(i), i, i) for i in range(300)] + [("a", 1.0, 999, 1)],
        "one_position": [("h", 7.0, i, i) for i in range(300)] + [("a", 1.0, 999, 1)], "empty": [], "null_positions": [("h", None, i, i) for i in range(300)],
    }[case]
    df = spark.createDataFrame(rows, "key string, at double, id long, v long")
    hot = scans.hot_keys(df, "key", "at")
    assert (hot is None) == (case in ("none", "empty"))
    one, cut = (scans.scanned(df, "key", ["at", "id"], h, **asked()).collect() for h in (None, hot))
    assert sorted(one, key=lambda r: r["id"]) == sorted(cut, key=lambda r: r["id"])


def test_a_hot_key_is_dealt_over_tasks(spark):
    """Half of the rows in one key: with pieces no task of the scan holds more than a small part of them."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit("h")).otherwise(F.col("id").cast("string")).alias("key"), F.col("id").cast("double").alias("at"), F.col("id").alias("v"))
    kept = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        most, parts = {}, {}
        for name, hot in (("one", None), ("pieces", scans.hot_keys(rows, "key", "at"))):
            out = scans.scanned(rows, "key", ["at"], hot, t=("total", F.col("v")))
            per = out.where("key = 'h'").groupBy(F.spark_partition_id().alias("p")).agg(F.count("t").alias("n")).collect()
            most[name], parts[name] = max(r["n"] for r in per), len(per)
        assert most["one"] == 20_000 and parts["one"] == 1
        assert parts["pieces"] >= 16 and most["pieces"] < 20_000 / 5
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(key" in plan and "__piece" in plan
    finally:
        for n, v in kept.items():
            spark.conf.set(n, v)


def intervals(spark, seed=2, n=1500):
    rng, rows, at = random.Random(seed), [], {}
    for i in range(n):
        hole = "h" if rng.random() < 0.5 else rng.choice("abc")
        a = at.get(hole, 0.0) + rng.choice([0, 0, 0, 0.05, 0.5, -0.5, -3.0])
        at[hole] = b = a + rng.choice([1.0, 2.0])
        rows.append((hole, a, b, f"s{i}", rng.choice([None, 1.0, 2.0]), rng.random() < 0.05, rng.choice("xxxy"), b - a))
    return spark.createDataFrame(rows, "hole_id string, from_m double, to_m double, sample_id string, elem_zn double, low_recovery boolean, rock string, length_m double")


def key(rows):
    return sorted(tuple(r) for r in rows.select("sample_id", *(c for c in rows.columns if c != "sample_id")).collect())


def test_runs_and_checks_of_hot_holes(spark):
    rows = intervals(spark)
    hot = scans.hot_keys(rows)
    rules = runs.BreakRules(0.1, (("rock", "rock"),), primary_grade="elem_zn")
    one, cut = (runs.segment_runs(rows, rules, ("from_m", "to_m", "sample_id"), h) for h in (None, hot))
    assert one.columns == cut.columns and repr(key(one)) == repr(key(cut))
    one, cut = (checks.interval_checks(rows, "assay", hot=h).select("severity", "check", "count").collect() for h in (None, hot))
    assert sorted(one) == sorted(cut) and len(one) >= 4


def test_asof_join_of_hot_keys(spark):
    rows = intervals(spark)
    logs = intervals(spark, seed=3, n=300).select("hole_id", "from_m", "sample_id", "rock")
    one, cut = (joins.asof_join(rows, logs, "hole_id", (F.col("from_m") + F.col("to_m")) / 2, F.col("from_m"), ["rock", "sample_id"], [F.col("sample_id")], "log", h).select("sample_id", "log") for h in (None, scans.hot_keys(rows)))
    assert repr(key(one)) == repr(key(cut)) and one.where("log is not null").count() > 1000


def test_traces_of_hot_holes(spark):
    rng = random.Random(4)
    survey = [("h" if i % 2 else f"k{i % 10}", i * 3.0, -60 + rng.random() * 20, 100 + rng.random() * 60) for i in range(1000)]
    survey = spark.createDataFrame(survey, "hole_id string, depth double, dip double, azimuth double")
    collar = spark.createDataFrame([("h", 1.0, 2.0, 3.0, 9000.0), *((f"k{i}", 1.0, 2.0, 3.0, 2000.0) for i in range(10))], "hole_id string, east double, north double, rl double, total_depth double")
    hot = scans.hot_keys(survey, "hole_id", "depth")
    points = spark.createDataFrame([("h", i * 7.7, str(i)) for i in range(1200)] + [("k2", i * 9.1, f"k{i}") for i in range(200)], "hole_id string, depth_m double, id string")
    told = []
    for h in (None, hot):
        trace = geometry.traces(collar, survey, hot=h)
        placed = geometry.positions(points, trace, hot=h).select("id", "at.*")
        told.append(([tuple(r) for r in trace.select("hole_id", "depth", "x", "y", "z", "length", "first", "last").orderBy("hole_id", "depth").collect()], [tuple(r) for r in placed.orderBy("id").collect()]))
    for one, cut in zip(*told, strict=True):
        assert len(one) == len(cut) > 1000
        for a, b in zip(one, cut, strict=True):
            assert all(x == y or abs(x - y) < 1e-7 for x, y in zip(a, b, strict=True))


def test_prefix_sums_need_no_single_task(spark):
    rng = random.Random(9)
    for n in (0, 1, 15, 4000):
        rows = [(f"H{i:05d}", rng.randint(0, 5)) for i in range(n)] + ([(None, 3)] if n else [])
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "hole string, n long").repartition(3)
        got = {r["hole"]: r["before"] for r in scans.prefix_sums(df, "hole", "n", "before").collect()}
        sums, want = 0, {}
        for k, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "")):
            want[k], sums = sums, sums + v
        assert got == want
    plan = scans.prefix_sums(df, "hole", "n", "before")._jdf.queryExecution().executedPlan().toString()
    # What meets in one task is the last row of each range.
    main = plan.split("Subquery")[0] if "Subquery" in plan else plan
    assert "hashpartitioning(__piece" in plan
    for part in plan.split("SinglePartition")[1:]:
        assert any(x in "".join(part.splitlines()[1:4]) for x in ("Filter isnull(", "TakeOrderedAndProject", "collect_list"))
    assert "Window" in main


def test_sessions_of_hot_users(spark):
    rng = random.Random(11)
    rows = [(1 if rng.random() < 0.6 else rng.randint(2, 9), i, rng.choice([None, rng.randint(0, 4000) * 10])) for i in range(2500)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, s long").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts")).repartition(4)
    hot = scans.hot_keys(events, "user_id", runs.micros("ts"))
    assert hot is not None
    one, cut = (sorted(runs.sessions(events, gap_seconds=60, hot=h).collect(), key=repr) for h in (None, hot))
    assert one == cut and len(one) > 300


def test_tasks_follow_the_rows(spark, monkeypatch):
    """Beyond shuffle partitions a join along the axis is dealt to as many tasks as its rows need, with the same rows."""
    from corelode.operators import intervals

    monkeypatch.setattr(scans, "SHARE", 40, raising=False)
    assay = spark.range(400).selectExpr("id % 20 hole_id", "double(id div 20) from_m", "double(id div 20 + 1) to_m", "id")
    litho = spark.range(40).selectExpr("id % 20 hole_id", "double(id div 20 * 10) from_m", "double(id div 20 * 10 + 9) to_m", "string(id) logged_code")
    assert scans.tasks_for(assay.limit(100)) is None and (tasks := scans.tasks_for(assay)) == 10
    dealt = intervals.logged_at_middle(assay, litho, tasks=tasks)
    assert dealt.rdd.getNumPartitions() == 10
    assert sorted(dealt.collect()) == sorted(intervals.logged_at_middle(assay, litho).collect())


def test_pieces_follow_the_rows(spark, monkeypatch):
    """A large table goes to a task for each SHARE of rows, and what pieces carry on is told from rows of hot keys alone, exchanged once for both scans."""
    rows = table(spark, 6000)
    few = scans.hot_keys(rows, "key", "at")
    monkeypatch.setattr(scans, "SHARE", 100)
    hot = scans.hot_keys(rows, "key", "at")
    assert few.tasks is None and hot.tasks == 60 and hot.pieces > few.pieces
    assert len(hot.splits.where("__key = 'h'").first()["__splits"]) > 100
    axis = scans.Axis("key", ("at", "id"), hot)
    cut = axis.done(axis.scan(axis.scan(axis.deal(rows), **asked()), again=("total", F.col("number").cast("long"))))
    plain = scans.Axis("key", ("at", "id"))
    one = plain.scan(plain.scan(rows, **asked()), again=("total", F.col("number").cast("long")))
    assert sorted(one.collect(), key=lambda r: r["id"]) == sorted(cut.collect(), key=lambda r: r["id"])
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    dealt = [x for x in plan.splitlines() if "RepartitionByExpression" in x]
    assert dealt and all(", 60" in x for x in dealt)
    assert "Inner" in plan  # cold rows meet no piece before they would be exchanged


@pytest.mark.parametrize("name", ["run_break_reasons", "candidate_windows", "best_window_per_start"])
def test_windows_and_reasons_follow_the_rows(spark, monkeypatch, name):
    """Both exchanges of the samples go to a task for each SHARE of rows, what follows sorts them where they are, and the rows are the same."""
    from corelode.plans import demo

    d = "/root/testdata/sf0.001"
    plain = sorted(demo.queries()[name](spark, d).collect(), key=repr)
    monkeypatch.setattr(scans, "SHARE", 200)
    tasks = -(-spark.read.parquet(f"{d}/lineitem.parquet").count() // 200)
    dealt = demo.queries()[name](spark, d)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {tasks}), REPARTITION_BY_NUM") == 2
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and ("hole_id" in x or "l_suppkey" in x) and f", {tasks})" not in x]
    assert sorted(dealt.collect(), key=repr) == plain
