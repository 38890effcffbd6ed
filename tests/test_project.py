import os
import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import zipfile

import project_files
import pytest
import yaml
from pyspark.sql import functions as F

from corelode import cli
from corelode.config import parse_config
from corelode.plans import project, report
from corelode.sources import infer
from corelode.sources.readers import MappingError, read_text


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tiny")
    cfg = parse_config(project_files.make(at), str(at))
    state = project.run(spark, cfg)
    for k in ("runs", "candidates", "allocation", "selected"):
        state.tables[k] = state.tables[k].cache()
    return state


def counts(rows, column):
    return {r[0]: r[1] for r in rows.groupBy(column).agg(F.count("*")).collect()}


def test_framework(tiny):
    rows = tiny.tables["intervals"]
    assert rows.count() == 480 and rows.where("outside_model").count() == 40
    assert counts(rows, "domain_match") == {True: 400, False: 40, None: 40}
    assert rows.where("abs(mass_kg / length_m - 3.8478) > 0.001").count() == 0


def test_runs(tiny):
    reasons = counts(tiny.tables["runs"].where("break_reason <> ''"), "break_reason")
    assert reasons == {"hole": 8, "outside_model": 32, "attribute:weathering": 16, "attribute:geomet_domain": 8}
    usable = tiny.tables["run_summary"].where("usable").collect()
    assert sorted({(round(r["from_m"]), round(r["to_m"])) for r in usable}) == [(5, 25), (25, 30), (30, 60)]
    assert tiny.tables["gaps"].where("scope = 'run'").count() == 8


def test_candidates_and_targets(tiny):
    assert tiny.tables["candidates"].count() == 7 * (10 + 20)
    got = {r["allocation_domain"]: (r["tonnes"], r["weighted_tonnes"], r["target"], r["deficit"]) for r in tiny.tables["allocation"].collect()}
    assert got["SEDIMENT-FRESH-LOW"][0] == pytest.approx(4_665_600) and got["VOLCANIC-OXIDE-HIGH"][1] == pytest.approx(4_665_600)
    assert {v[2:] for v in got.values()} == {(3, 3)}


def test_selection(tiny):
    rows = tiny.tables["selected"].collect()
    assert len(rows) == 6 and counts(tiny.tables["selected"], "allocation_domain") == {"SEDIMENT-FRESH-LOW": 3, "VOLCANIC-OXIDE-HIGH": 3}
    assert max(counts(tiny.tables["selected"], "hole_id").values()) <= 2 and all(r["mass_kg"] >= 40 and r["reason"] for r in rows)
    assert sorted(r["sample_no"] for r in rows) == [f"GM-{i:03d}" for i in range(1, 7)] and "DDH008" not in {r["hole_id"] for r in rows}
    ids = [i for r in rows for i in r["interval_ids"]]
    assert len(ids) == len(set(ids)) == tiny.tables["picks"].count()
    assert {(r["fit"], r["samples"]) for r in tiny.tables["objective"].collect()} == {(0, 6)}


def test_other_units_and_names_give_the_same(spark, tiny, tmp_path):
    cfg = parse_config(project_files.make(tmp_path, feet=True, down=True, names="u_").replace("min_length_m: 6,", "min_length_m: 5.9999,"), str(tmp_path))
    other = project.run(spark, cfg).tables["selected"].collect()
    key = lambda rows: sorted((r["hole_id"], round(r["from_m"], 3), round(r["to_m"], 3), r["allocation_domain"]) for r in rows)
    assert key(other) == key(tiny.tables["selected"].collect())


def test_planned_holes(spark, tmp_path):
    text = project_files.make(tmp_path)
    (tmp_path / "pc.csv").write_text("h,e,n,z,d\nPLAN1,1003,2001,500,60.4\n", "utf-8")
    (tmp_path / "ps.csv").write_text("h,d,dip,azi\nPLAN1,0,-90,0\n", "utf-8")
    more = "  planned_collar: {path: pc.csv, columns: {hole_id: h, east: e, north: n, rl: z, total_depth: d}}\n  planned_survey: {path: ps.csv, columns: {hole_id: h, depth: d, dip: dip, azimuth: azi}}\n"
    text = text.replace("attributes:\n", more + "attributes:\n", 1) + "block_model_options: {planned_grade_source: block_model}\n"
    state = project.stage_geometry(project.stage_load(spark, parse_config(text, str(tmp_path))))
    rows = state.tables["intervals"].where("is_planned").collect()
    assert len(rows) == 60 and rows[0]["interval_id"].startswith("PLAN1_PLAN_") and all(r["elem_Zn"] == r["bm_elem_Zn"] for r in rows) and sum(r["outside_model"] for r in rows) == 5


def test_validation_and_gate(spark, tmp_path):
    text = project_files.make(tmp_path)
    with (tmp_path / "assay.csv").open("a", encoding="utf-8", newline="") as f:
        f.write("DDH999,0,1,abc,2.7,N\r\nDDH001,60,61,<0.01,9,Y\r\nDDH001,61,62,-3,2.7,N\r\n")
    cfg = parse_config(text, str(tmp_path))
    found = {(r["severity"], r["check"], r["source"]): r for r in project.validate(spark, cfg).collect()}
    assert ("ERROR", "orphan_hole", "assay") in found and ("ERROR", "density_range", "assay") in found and ("WARN", "beyond_total_depth", "assay") in found
    assert found["ERROR", "value_unparseable", "assay"]["message"].startswith("Zn_pct: 'abc' x 1; lines 482") and ("INFO", "below_detection", "assay") in found and ("ERROR", "grade_negative", "assay") in found
    assert ("INFO", "geometry_checks_skipped", "geometry") in found
    with pytest.raises(project.ValidationFailed, match="orphan_hole"):
        project.run(spark, cfg, "geometry")


def test_mapping_errors_come_together(spark, tmp_path):
    text = project_files.make(tmp_path).replace("east: Easting", "east: Nowhere").replace("logged_code: Code", "logged_code: Cod")
    with pytest.raises(MappingError, match="(?s)Nowhere.*'Cod'"):
        project.stage_load(spark, parse_config(text, str(tmp_path)))


@pytest.mark.parametrize(("old", "new"), [("primary: true", "primary: false"), ("[0, 2, 999]", "[0, 2, 2]"), ("rock, weathering, grade_bin", "geomet_domain"), ("min_mass_kg: 40", "min_mass_kg: 60"), ("name: tiny", "name: tiny, nmae: x"), ("dip_convention: negative_down", "azimuth_reference: grid")])
def test_bad_configurations(tmp_path, old, new):
    text = project_files.make(tmp_path)
    assert old in text
    with pytest.raises(ValueError):
        parse_config(text.replace(old, new))


def test_sheets_workbook_and_cache(spark, tiny, tmp_path):
    sheets = report.sheets(tiny)
    assert list(sheets) == ["Summary", "Allocation", "Composites", "Pick_List", "Gap_Register", "Validation", "Candidates"]
    assert "Zn_pct" in sheets["Pick_List"].columns and {"Zn_pct", "bm_rock"} <= set(report.present(tiny.tables["intervals"], report.shown_by(tiny.cfg)).columns)
    assert sheets["Allocation"].columns == list(report.ALLOCATION) and abs(sum(r["weighted_pct"] for r in sheets["Allocation"].collect()) - 100) < 0.02
    assert sheets["Composites"].columns[:3] == ["sample_no", "hole_id", "from_m"] and sheets["Composites"].columns[-1] == "reason" and "quality" not in sheets["Composites"].columns
    report.write_workbook({k: sheets[k] for k in ("Summary", "Composites")}, f"{tmp_path}/x/book.xlsx")
    with zipfile.ZipFile(f"{tmp_path}/x/book.xlsx") as z:
        assert "GM-001" in z.read("xl/worksheets/sheet2.xml").decode() and 'state="frozen"' in z.read("xl/worksheets/sheet1.xml").decode()
    assert report.chart_data(tiny)["allocation"].count() == 2
    first = project.run(spark, tiny.cfg, "geometry", cache=f"{tmp_path}/cache").tables["intervals"]
    again = project.run(spark, tiny.cfg, "geometry", cache=f"{tmp_path}/cache").tables["intervals"]
    assert first.count() == again.count() == 480 and set(first.inputFiles()) == set(again.inputFiles())


def test_command_line(spark, tmp_path):
    (tmp_path / "p.yaml").write_text(project_files.make(tmp_path), "utf-8")
    assert cli.main(["allocate", str(tmp_path / "p.yaml"), "--out", str(tmp_path / "a")], spark) == 0
    assert spark.read.csv(f"{tmp_path}/a/allocate", header=True).count() == 2
    assert len((tmp_path / "a" / "allocate.csv").read_text("utf-8").splitlines()) == 3
    assert cli.main(["init", "--out", str(tmp_path / "d.yaml"), *(x for k in ("collar", "survey", "assay", "litho") for x in (f"--{k}", str(tmp_path / f"{k}.csv")))], spark) == 0
    text = (tmp_path / "d.yaml").read_text("utf-8")
    got = yaml.safe_load(text)
    assert "# CONFIRM" in text and got["conventions"]["dip_convention"] == "negative_down" and got["elements"]["Zn"]["drillhole"] == {"field": "Zn_pct", "units": "pct"} and got["sources"]["assay"]["density"]["source"] == "BD_tonnes_m3"
    assert got["sources"]["collar"]["columns"]["east"] == "Easting" and got["sources"]["availability"]["path"] == "PATH_REQUIRED" and got["sources"]["assay"]["flags"]["low_recovery"]["source"] is None
    assert "# dip_convention follows" in text and "# primary element: Zn" in text and "LowRec" not in text.split("project:")[0].replace("columns that nothing uses: LowRec", "") and "PATH_REQUIRED stands for files that weren't given: domain_lookup, block_model, availability" in text
    whole = parse_config(text)
    assert whole.domaining.allocation_key == ["grade_bin"] and whole.primary == "Zn" and whole.compositing.target_mass_kg == 50 and whole.sources.domain_lookup.path == "PATH_REQUIRED"


def test_a_failed_run_leaves_its_report(spark, tmp_path):
    (tmp_path / "p.yaml").write_text(project_files.make(tmp_path), "utf-8")
    with (tmp_path / "assay.csv").open("a", encoding="utf-8", newline="") as f:
        f.write("DDH999,0,1,1,2.7,N\r\n")
    assert cli.main(["run", str(tmp_path / "p.yaml"), "--out", str(tmp_path / "o")], spark) == 1
    told = {r["check"]: r["count"] for r in spark.read.csv(f"{tmp_path}/o/validation_report", header=True).collect()}
    assert told["orphan_hole"] == "1"


def test_all_keys_of_a_configuration(tmp_path):
    text = project_files.make(tmp_path)
    for old, new in (
        ("name: tiny,", "name: tiny, crs: null,"), ("target_mass_kg: 50,", "target_mass_kg: 50, allow_multi_hole: false,"), ("{1: 2.0}", "{1: 2.0, default: 0.5}"), ("swap_iterations: 50", "swap_iterations: 50, method: greedy_with_swap"),
        ("elements:\n", "elements:\n  Pb: {drillhole: {field: Pb, units: pct}, block_model: {field: null, units: null}}\n"), ("flags: {low_recovery: {source: ", "null_values: [NS, -99, NO]\n    flags: {low_recovery: {true_values: [Y, 1, TRUE], source: "),
    ):
        assert old in text
        text = text.replace(old, new, 1)
    cfg = parse_config(text + "desurvey: {method: minimum_curvature, fill_collar_survey: false}\nreporting: {formats: [csv], include_plots: no}\n")
    assert cfg.allocation.label_weights == {"1": 2.0} and cfg.allocation.default_weight == 0.5 and cfg.elements["Pb"].block_model is None
    assert cfg.sources.assay.null_values == ["NS", "-99", "NO"] and cfg.sources.assay.flags["low_recovery"].true_values == ["Y", "1", "TRUE"] and cfg.sources.availability.value_map["UNAVAILABLE"] == ["DISPOSED", "NO"]
    assert not cfg.desurvey.fill_collar_survey and not cfg.reporting.include_plots and cfg.reporting.formats == ["csv"]


def test_cache_follows_contents(spark, tmp_path):
    cfg = parse_config(project_files.make(tmp_path), str(tmp_path))
    first = project.run(spark, cfg, "geometry", cache=f"{tmp_path}/cache").tables["intervals"]
    assert first.count() == 480
    path = next(p for p in (tmp_path / "cache").rglob("intervals") if p.is_dir())
    (path / "_SUCCESS").unlink()  # as after a broken write
    assert project.run(spark, cfg, "geometry", cache=f"{tmp_path}/cache").tables["intervals"].count() == 480
    lines = (tmp_path / "assay.csv").read_bytes().split(b"\r\n")
    (tmp_path / "assay.csv").write_bytes(b"\r\n".join(lines[:100]) + b"\r\n")
    assert project.run(spark, cfg, "geometry", cache=f"{tmp_path}/cache").tables["intervals"].count() == 99


def test_content_keys_follow_bytes_and_nothing_else(spark, tmp_path):
    at = tmp_path / "some dir"
    at.mkdir()
    rng = random.Random(3)
    for k in range(3):
        (at / f"{k} ä.csv").write_bytes(b"\n".join(bytes(rng.choices(range(256), k=rng.randint(0, 60))) for _ in range(300)))
    first = project.content_key(spark, str(at))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in (900, 6000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            assert project.content_key(spark, str(at)) == first
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
        spark.conf.set("spark.sql.files.openCostInBytes", kept[1])
    one = at / "1 ä.csv"
    data, times = bytearray(one.read_bytes()), one.stat()
    data[1234] ^= 1
    one.write_bytes(data)
    os.utime(one, ns=(times.st_atime_ns, times.st_mtime_ns))
    assert project.content_key(spark, str(at)) != first
    data[1234] ^= 1
    one.write_bytes(data)
    assert project.content_key(spark, str(at)) == first
    one.rename(at / "9.csv")
    assert project.content_key(spark, str(at)) != first
    assert project.content_key(spark, str(at / "9.csv")) != project.content_key(spark, str(at / "0 ä.csv"))


def test_lines_are_dense_over_many_files(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.csv").write_text("a,b\n" + "".join(f"{k},{i}\n" for i in range(7 + k)), "utf-8")
    rows = read_text(spark, str(tmp_path)).collect()
    assert sorted(r["_row"] for r in rows) == list(range(sum(7 + k for k in range(5))))
    (tmp_path / "g.csv").write_bytes("a\nfine \ufffd sign\n".encode())
    assert read_text(spark, f"{tmp_path}/g.csv").collect()[0]["a"] == "fine \ufffd sign"


def test_fallback_densities_and_blank_ids_are_counted(spark, tmp_path):
    text = project_files.make(tmp_path).replace("to_m: To_m}", "to_m: To_m, sample_id: LowRec}").replace("{source: BD_tonnes_m3}", "{source: BD_tonnes_m3, fallback_constant: 2.6}")
    told = {r["check"]: r["count"] for r in project.stage_load(spark, parse_config(text, str(tmp_path))).data.issues.collect()}
    assert "density_fallback" not in told and "sample_id_blank" not in told
    with (tmp_path / "assay.csv").open("a", encoding="utf-8", newline="") as f:
        f.write("DDH001,60,61,1,,\r\nDDH001,61,62,1,,Y\r\n")
    told = {r["check"]: r["count"] for r in project.stage_load(spark, parse_config(text, str(tmp_path))).data.issues.collect()}
    assert told["density_fallback"] == 2 and told["sample_id_blank"] == 1


def test_encodings(spark, tmp_path):
    (tmp_path / "w.csv").write_bytes("näme,v\r\nfünf “x”,€5\r\n,\"a\nb\"\r\n".encode("cp1252"))
    rows = read_text(spark, f"{tmp_path}/w.csv").orderBy("_row").collect()
    assert [tuple(r) for r in rows] == [("fünf “x”", "€5", 0), ("", "a\nb", 1)]
    (tmp_path / "u.csv").write_bytes("﻿a, b \r\n1,ü\r\n".encode())
    assert read_text(spark, f"{tmp_path}/u.csv").columns == ["a", "b", "_row"]


def test_validate_shows_orientation(spark, tmp_path):
    (tmp_path / "p.yaml").write_text(project_files.make(tmp_path) + "reporting: {formats: [csv], include_plots: no}\n", "utf-8")
    assert cli.main(["validate", str(tmp_path / "p.yaml"), "--out", str(tmp_path / "o")], spark) == 0
    ends = spark.read.csv(f"{tmp_path}/o/hole_orientation", header=True).collect()
    assert len(ends) == 8 and {r["rises"] for r in ends} == {"false"}


def test_availability_is_required(tmp_path):
    text = project_files.make(tmp_path)
    cut = "\n".join(x for x in text.split("\n") if not x.startswith("  availability:"))
    with pytest.raises(ValueError, match="availability"):
        parse_config(cut)


def test_long_tables_are_no_worksheet_and_no_single_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(report, "SHEET_ROWS", 4)
    monkeypatch.setattr(report, "MOST_ROWS", 4)
    tables = {"few": spark.range(4).repartition(3), "many": spark.range(5).repartition(3)}
    assert report.write_workbook(tables, f"{tmp_path}/b.xlsx") == ["many"]
    with zipfile.ZipFile(f"{tmp_path}/b.xlsx") as z:
        assert sum(n.startswith("xl/worksheets/") for n in z.namelist()) == 1
    report.write_csv(tables, f"{tmp_path}/c")
    assert sorted((tmp_path / "c" / "few.csv").read_text().split()) == ["0", "1", "2", "3", "id"] and not (tmp_path / "c" / "many.csv").exists()
    assert spark.read.csv(f"{tmp_path}/c/many", header=True).count() == 5
    report.write_csv({"few": spark.range(9)}, f"{tmp_path}/c")
    assert not (tmp_path / "c" / "few.csv").exists()


def test_headers_and_units(spark):
    shown = report.Shown({"Zn": "pct"}, {"Zn": "ppm", "Ag": "gpt"}, ("rock",))
    rows = spark.createDataFrame([(20000.0, 30000.0, 500.0, 3.0, "a", "b")], "elem_Zn double, wtd_Zn double, bm_elem_Zn double, bm_elem_Ag double, attr_rock string, bm_attr_rock string")
    got = report.present(rows, shown)
    assert got.columns == ["Zn_pct", "Zn_pct_wtd", "bm_Zn_ppm", "bm_Ag_gpt", "rock", "bm_rock"] and got.collect() == [(2.0, 3.0, 500.0, 3.0, "a", "b")]
    assert report.present(rows.select("wtd_Zn", "attr_rock", F.lit(1).alias("rock")), shown).columns == ["Zn_pct", "rock", "rock_2"]


def test_categories_are_counted_exactly(spark, tmp_path):
    rows = [(f"c{i % 50}", f"d{i % 51}", "x") for i in range(3000)]
    spark.createDataFrame(rows, "fifty string, more string, one string").write.parquet(f"{tmp_path}/t.parquet")
    assert infer.inspect(spark, f"{tmp_path}/t.parquet", ["hole_id"])["attributes"] == ["fifty"]


def test_name_matching():
    assert [infer.element_of(c) for c in ("Znpct", "Au gpt", "Ag-ozt", "agt", "Zinc_pct", "Zn", "Z1_pct")] == [("Zn", "pct"), ("Au", "gpt"), ("Ag", "oz_t"), None, None, None, None] and infer.role_of("Rock Type (main)") == "rock_type_main"
    assert infer.match_column("hole_id", ["X", "HoleID"]) == "HoleID" and infer.match_column("azimuth", ["Azimuth_deg"]) == "Azimuth_deg" and infer.match_column("dip", ["foo"]) is None
    assert infer.element_of("Zn_pct") == ("Zn", "pct") and infer.element_of("Density") is None
