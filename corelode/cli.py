"""Command line: validate, desurvey, candidates, allocate, select, run, init."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from corelode.config import load_config
from corelode.operators import checks
from corelode.plans import project, report
from corelode.sources import infer

SHOWS = {"desurvey": ("geometry", "intervals"), "candidates": ("candidates", "candidates"), "allocate": ("allocate", "allocation"), "select": ("select", "selected")}


def _tell(notice: str) -> None:
    if notice:
        print(notice, file=sys.stderr)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="corelode", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("validate", *SHOWS, "run"):
        c = sub.add_parser(name)
        c.add_argument("config")
        c.add_argument("--out")
        c.add_argument("--force", action="store_true")
        c.add_argument("--cache")
    c = sub.add_parser("init")
    c.add_argument("--out")
    for name in infer.NEEDED:
        c.add_argument(f"--{name.replace('_', '-')}", dest=name)
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("corelode").getOrCreate()
    if a.command == "init":
        text = infer.draft(spark, {k: v for k in infer.NEEDED if (v := getattr(a, k))})
        if a.out:
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            sys.stdout.write(text)
        return 0
    cfg = load_config(a.config)
    out = a.out or cfg.path(cfg.project.output_dir)
    if a.command == "validate":
        state = project.checked(spark, cfg)
        report.write_csv({"validation_report": report.present(checks.ordered(state.issues))}, out)
        _tell(report.write_orientation(state, out))
        failed = state.issues.where("severity = 'ERROR'").count() > 0 and not a.force
        state.close()
        return int(failed)
    stage, table = SHOWS.get(a.command, ("select", ""))
    try:
        state = project.run(spark, cfg, stage, a.force, a.cache)
    except project.ValidationFailed as e:
        report.write_csv({"validation_report": report.present(checks.ordered(e.issues))}, out)
        print(f"{e}; see validation_report in {out}", file=sys.stderr)
        return 1
    if a.command == "run":
        sheets, r = report.sheets(state), cfg.reporting
        if "csv" in r.formats:
            report.write_csv({k: v for k, v in sheets.items() if r.include_gap_register or k != "Gap_Register"}, out)
        report.write_csv({"validation_report": sheets["Validation"]}, out)
        if r.include_plots:
            report.write_csv(report.chart_data(state), f"{out}/charts")
        if "xlsx" in r.formats and "://" not in out:
            large = report.write_workbook(sheets, f"{out}/{cfg.project.name}.xlsx")
            _tell(f"too long for a worksheet, see their CSV: {', '.join(large)}" if large else "")
    else:
        report.write_csv({a.command: report.present(state.tables[table], report.shown_by(cfg))}, out)
    if a.command in ("run", "desurvey"):
        _tell(report.write_orientation(state, out))
    state.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
