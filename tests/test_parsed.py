"""Parsed values of sources: how often a text is parsed."""

import os

import project_files

from corelode.config import parse_config
from corelode.plans import project
from corelode.sources import readers


def test_a_value_is_parsed_once_a_row(spark, tmp_path):
    """However often it is used: in projections and in filters, which would be pushed below the parsing and copy it."""
    cfg = parse_config(project_files.make(tmp_path / "files"), str(tmp_path / "files"))
    rows = readers.load(spark, cfg).tables["assay"].where("to_m - from_m > 0.5 and elem_Zn > 0 and elem_Zn < 1e6").selectExpr("hole_id", "to_m - from_m AS size", "elem_Zn * (to_m - from_m) / to_m AS share")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("rlike") <= 5  # four numbers, and the limit of a grade
    assert rows.count() == 480


def test_long_sources_are_parsed_once(spark, tmp_path):
    """Every check read and parsed the files anew."""
    cfg = parse_config(project_files.make(tmp_path / "files"), str(tmp_path / "files"))
    state = project.stage_load(spark, cfg)
    plan = state.issues._jdf.queryExecution().optimizedPlan().toString()
    assert "Zn_pct#" not in plan  # a column of the file
    told = sorted((r["check"], r["source"], r["count"]) for r in state.issues.collect())
    assert ("tier2_fallback", "assay", 1) in told
    folders = list(state.data.folders)
    assert len(folders) == 3 and all(spark.read.parquet(f).count() for f in folders)
    state.close()
    assert not any(os.path.exists(f.removeprefix("file:")) for f in folders)
