import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 40


@needs_data
def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns[:2] == ["hole_id", "run_no"] and rows.count() > 0


def key(row):
    return ["" if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.9g}" if isinstance(x, float) else str(x) for x in row]


@needs_data
@pytest.mark.parametrize("name", ["interval_split", "asof_litho_domain", "block_assign_nearest", "run_segmentation", "candidate_windows", "allocation_targets", "dq_intervals", "parse_grades", "event_sessions"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted(key(r) for r in df.select(*names).collect()) == sorted(key(r) for r in cur.fetchall())


def test_streams(spark, tmp_path):
    from corelode.streaming.sessions import stream_counts, stream_sessions

    rows = [(1, "2024-01-01 00:00:00", "a", 1.0), (1, "2024-01-01 00:10:00", "a", 2.0), (1, "2024-01-01 02:00:00", "b", 3.0), (2, "2024-01-01 00:05:00", "a", 4.0)]
    spark.createDataFrame(rows, "user_id long, ts string, event_type string, value double").selectExpr("user_id", "cast(ts as timestamp) as ts", "event_type", "value").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("user_id long, ts timestamp, event_type string, value double").parquet(f"{tmp_path}/e")
    for name, out, mode, want in (("sess", stream_sessions(stream), "complete", [(1, 1), (1, 2), (2, 1)]), ("cnt", stream_counts(stream), "complete", [("a", 3), ("b", 1)])):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        got = spark.table(name)
        assert sorted((r[0], r["n"]) for r in got.select(got.columns[0] if name == "sess" else "event_type", "n").collect()) == want
