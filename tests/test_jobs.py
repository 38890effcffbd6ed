import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from jobs import note_values, queries, run_register
from jobs.common import read_config

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def key(row):
    return ["" if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.9g}" if isinstance(x, float) else str(x) for x in row]


def rows_of(df):
    names = sorted(df.columns)
    return sorted(key(r) for r in df.select(*names).collect())


def by_sql(name, **views):
    con = duckdb.connect()
    for t, path in views.items():
        con.execute(f"create view {t} as select * from '{path}'")
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(key([r[i] for i in order]) for r in cur.fetchall())


@needs_data
def test_register_equals_sql_and_leaves_settings(spark):
    before = dict(spark.sparkContext.getConf().getAll()) | {r["key"]: r["value"] for r in spark.sql("set").collect()}
    got = queries.job1_run_register(spark, DATA)
    assert rows_of(got) == by_sql("job1_run_register", lineitem=f"{DATA}/lineitem.parquet", supplier=f"{DATA}/supplier.parquet")
    assert {r["verdict"] for r in got.select("verdict").distinct().collect()} >= {"unusable", "unavailable", "run_too_short", "sample"}
    after = dict(spark.sparkContext.getConf().getAll()) | {r["key"]: r["value"] for r in spark.sql("set").collect()}
    assert before == after


@needs_data
def test_register_of_some_projects_leaves_the_others(spark, tmp_path):
    cfg = read_config(run_register.CONFIG)
    first = run_register.run(spark, DATA, str(tmp_path), cfg)
    read = lambda: rows_of(spark.read.schema(run_register.RUNS).parquet(f"{tmp_path}/runs"))
    whole = read()
    assert first["runs"] == len(whole) and first["assay"] == 6000
    files = {p.parent.name: p for p in tmp_path.glob("runs/project=*/*.parquet")}
    assert len(files) > 1
    one = sorted(files)[0]
    kept = {n: p.stat().st_mtime_ns for n, p in files.items() if n != one}
    shutil.rmtree(tmp_path / "runs" / one)
    assert read() != whole
    run_register.run(spark, DATA, str(tmp_path), cfg | {"projects": [one.split("=")[1]]})
    assert read() == whole
    assert all(files[n].stat().st_mtime_ns == t for n, t in kept.items())


def test_register_by_hand(spark, tmp_path):
    """A hole of six intervals over two domains, one of low recovery; a gone hole; a hole without project."""
    at = tmp_path / "in"
    spark.createDataFrame([("A", "north", "AVAILABLE"), ("B", "south", "UNAVAILABLE")], "hole string, area string, state string").write.csv(f"{at}/holes", header=True)
    assay = [("A", i * 4.0, i * 4.0 + 4, 1.0 if i != 4 else 2.0) for i in range(6)] + [("B", 0.0, 8.0, 1.0), ("C", 0.0, 8.0, 1.0)]
    spark.createDataFrame(assay, "hole string, f double, t double, zn double").write.csv(f"{at}/assay", header=True)
    spark.createDataFrame([("A", 0.0, 10.0, "x"), ("A", 10.0, 24.0, "y"), ("B", 0.0, 9.0, "x")], "hole string, f double, t double, code string").write.json(f"{at}/log")
    text = {"header": True}
    cfg = {
        "files_per_project": 1, "loss": 1.0, "density": 2.7, "core_diameter_mm": 63.5, "remaining_fraction": 1.0, "primary_grade": "elem_zn", "max_gap_m": 0.1, "min_length_m": 6.0, "min_mass_kg": 40.0, "domains": {"x": "X", "y": "Y"},
        "sources": {
            "holes": {"path": "holes", "format": "csv", "options": text, "columns": {"hole_id": "hole", "project": "area", "availability": "state", "core_diameter_mm": "cast(null as double)", "remaining_fraction": "cast(null as double)"}},
            "assay": {"path": "assay", "format": "csv", "options": text, "columns": {"hole_id": "hole", "sample_id": "concat(hole, f)", "from_m": "double(f)", "to_m": "double(t)", "elem_zn": "double(zn)", "density": "cast(null as double)", "low_recovery": "double(zn) > 1"}},
            "litho": {"path": "log", "format": "json", "columns": {"hole_id": "hole", "from_m": "f", "to_m": "t", "logged_code": "code"}},
        },
    }
    out = tmp_path / "out"
    run_register.run(spark, str(at), str(out), cfg)
    got = [(r["project"], r["hole_id"], r["from_m"], r["to_m"], r["geomet_domain"], r["verdict"]) for r in spark.read.parquet(f"{out}/runs").orderBy("hole_id", "from_m").collect()]
    assert got == [("north", "A", 0, 10, "X", "sample"), ("north", "A", 10, 16, "Y", "sample"), ("north", "A", 16, 20, "Y", "unusable"), ("north", "A", 20, 24, "Y", "run_too_short"), ("south", "B", 0, 8, "X", "unavailable")]
    told = {(r["project"], r["check"], r["count"]) for r in spark.read.json(f"{out}/issues").collect()}
    assert told == {("north", "density_missing", 6), ("south", "density_missing", 1), ("north", "low_recovery", 1)}


@needs_data
def test_notes_equal_sql(spark):
    assert rows_of(queries.job2_note_values(spark, DATA)) == by_sql("job2_note_values", documents=f"{DATA}/documents.parquet")


TEXTS = [
    [(1, "Assay (2.5%) over 3 m, <0.01ppm; then -4 g/t? -4g/t nan 1e3", "en"), (2, None, "en"), (3, "", None), (4, "keine Zahlen", "de")],
    [(5, "9999 -99.0 12oz/t\n\t.5. 1.5d", None), (1, "7", "en")],
    [(6, "x" * 200_000 + " 8PPM " + "y1" * 1000, "de")],
]


def test_notes_take_only_what_is_new(spark, tmp_path):
    cfg = read_config(note_values.CONFIG)
    at, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "doc_id long, text string, lang string"

    def add(k):
        spark.createDataFrame(TEXTS[k], schema).coalesce(1).write.parquet(f"{tmp_path}/new{k}")
        os.makedirs(f"{at}/documents.parquet", exist_ok=True)
        part = next(p for p in os.listdir(f"{tmp_path}/new{k}") if p.endswith(".parquet"))
        shutil.move(f"{tmp_path}/new{k}/{part}", f"{at}/documents.parquet/{k}.parquet")

    add(0)
    assert note_values.run(spark, at, out, mark, cfg)["texts"] == 4
    first = note_values.read_values(spark, out, cfg).collect()
    said = {(r["doc_id"], r["place"], r["word"], r["unit"], r["value"], r["ppm"], r["state"], r["lang"]) for r in first}
    assert said == {
        (1, 0, "2.5%", "pct", 2.5, 25000.0, "ok", "en"), (1, 1, "3", None, 3.0, None, "ok", "en"), (1, 2, "<0.01ppm", "ppm", 0.005, 0.005, "below_detection", "en"),
        (1, 3, "-4", None, None, None, "negative", "en"), (1, 4, "-4g/t", "gpt", None, None, "negative", "en"), (1, 5, "1e3", None, 1000.0, None, "ok", "en"),
    }
    assert note_values.run(spark, at, out, mark, cfg) == {"texts": 0, "words": 6}
    add(1)
    add(2)
    assert note_values.run(spark, at, out, mark, cfg | {"max_files": 1}) == {"texts": 3, "words": 14}
    whole = note_values.read_values(spark, out, cfg)
    assert set(first) <= set(whole.collect()) and whole.count() == 14
    assert rows_of(whole) == by_sql("job2_note_values", documents=f"{at}/documents.parquet/*.parquet")
    once = f"{tmp_path}/once"
    note_values.run(spark, at, once, f"{once}/mark", cfg)
    assert rows_of(note_values.read_values(spark, once, cfg)) == rows_of(whole)
    summary = {(r[0], r[1]): r[2] for r in spark.read.csv(f"{out}/summary", header=True).collect()}
    assert summary[("de", "ok")] == "1" and summary[(None, "declared_null")] == "2"


def test_a_run_that_broke_off_before_its_end_adds_nothing_twice(spark, tmp_path):
    """As after a crash while a batch is noted: by the checkpoint alone (its output counts already), or by the sink too (it is done again, and the files of the
    first attempt don't count)."""
    cfg = read_config(note_values.CONFIG)
    at, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for k, rows in enumerate(TEXTS[:2]):
        spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.mode("append").parquet(f"{at}/documents.parquet")
        assert note_values.run(spark, at, out, mark, cfg)["texts"] == len(rows)
    before = rows_of(note_values.read_values(spark, out, cfg))
    last = max(int(p.name) for p in (tmp_path / "mark" / "commits").iterdir() if p.name.isdigit())
    for lost, again in ((["mark/commits"], 0), (["mark/commits", "out/values/_spark_metadata"], len(TEXTS[1]))):
        for folder in lost:
            for name in (f"{last}", f".{last}.crc"):
                (tmp_path / folder / name).unlink(missing_ok=True)
        assert note_values.run(spark, at, out, mark, cfg) == {"texts": again, "words": len(before)}
        assert rows_of(note_values.read_values(spark, out, cfg)) == before


def test_notes_without_files(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/in/documents.parquet")
    cfg = read_config(note_values.CONFIG)
    for _ in range(2):
        assert note_values.run(spark, str(tmp_path / "in"), f"{tmp_path}/out", f"{tmp_path}/mark", cfg) == {"texts": 0, "words": 0}


@needs_data
def test_command_line(tmp_path):
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": "--master local[2] pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", "jobs.note_values", "--input", DATA, "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "new texts" in done.stderr and any(p.suffix == ".parquet" for p in (tmp_path / "out/values").rglob("*"))


def test_a_large_table_is_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    """Shuffles of the register follow the assay's rows; the setting is given back, also after an error."""
    monkeypatch.setattr(run_register.scans, "SHARE", 500)
    name, seen = "spark.sql.shuffle.partitions", []
    before = spark.conf.get(name)
    monkeypatch.setattr(run_register, "register", lambda *a: seen.append(int(spark.conf.get(name))) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run_register.run(spark, DATA, str(tmp_path), read_config(run_register.CONFIG))
    assert seen == [-(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500)] and seen[0] > int(before) == int(spark.conf.get(name))
