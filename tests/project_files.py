"""A tiny project of eight vertical holes, made anew for the tests."""

from __future__ import annotations

import csv
import random
from pathlib import Path

FEET = 0.3048


def _write(path: Path, head: list[str], rows, quote: bool = False, bom: bool = False) -> None:
    with path.open("w", newline="", encoding="utf-8-sig" if bom else "utf-8") as f:
        w = csv.writer(f, quoting=csv.QUOTE_ALL if quote else csv.QUOTE_MINIMAL, lineterminator="\r\n")
        w.writerow(head)
        w.writerows(rows)


def make(folder: Path, feet: bool = False, down: bool = False, names: str = "") -> str:
    """Writes the files and returns the configuration. `names` goes in front of every column name."""
    folder.mkdir(parents=True, exist_ok=True)
    rng, u = random.Random(7), (lambda x: f"{x / FEET:.10f}") if feet else str
    n = lambda c: names + c
    holes = [f"DDH{i + 1:03d}" for i in range(8)]
    _write(folder / "collar.csv", [n("HoleID"), n("Easting"), n("Northing"), n("Elevation"), n("Length_m")], [[h, u(1000 + 40 * i), u(2001 + 25 * (i % 3)), u(500), u(60)] for i, h in enumerate(holes)])
    _write(folder / "survey.csv", [n("HoleID"), n("Depth_m"), n("Dip"), n("Azimuth")], [[h, u(d), 90 if down else -90, 0] for h in holes for d in (0, 60)], quote=True)
    _write(folder / "litho.csv", [n("holeid"), n("from"), n("to"), n("Code")], [r for i, h in enumerate(holes) for r in ([h, u(0), u(30), "TUFF" if i % 2 else "VOLC"], [h, u(30), u(60), "SDST"])])
    grade = lambda d: round(max((6.0 if d < 30 else 0.8) + rng.gauss(0, 0.15), 0.01), 4)
    _write(folder / "assay.csv", [n("HoleID"), n("From_m"), n("To_m"), n("Zn_pct"), n("BD_tonnes_m3"), n("LowRec")], [[h, u(d), u(d + 1), grade(d), 2.7, "N"] for h in holes for d in range(60)], bom=True)
    _write(folder / "lookup.csv", ["code", "domain"], [["VOLC", "VOLCANIC"], ["TUFF", "VOLCANIC"], ["SDST", "SEDIMENT"]])
    _write(folder / "availability.csv", ["hole", "state", "diameter", "fraction"], [[h, "DISPOSED" if i == 7 else "IN STORAGE", 63.5, 0.5] for i, h in enumerate(holes)])
    blocks = []
    for x in range(9):
        for y in range(3):
            for z in range(6):
                top = 490 - 10 * z
                rich = top > 470
                blocks.append([u(1000 + 40 * x), u(1980 + 40 * y), u(top), u(40), u(40), u(10), "VOLCANIC" if rich else "SEDIMENT", "OXIDE" if 500 - top < 25 else "FRESH", 6.0 if rich else 0.8, 2.7, 1 if rich else 2])
    _write(folder / "blocks.csv", ["X", "Y", "Z", "DX", "DY", "DZ", "ROCKTYPE", "WEATHERING", "ZN_PCT", "DENSITY", "PERIOD"], blocks)
    return f"""
project: {{name: tiny, output_dir: out}}
conventions: {{length_units: {"ft" if feet else "m"}, dip_convention: {"positive_down" if down else "negative_down"}}}
sources:
  collar: {{path: collar.csv, columns: {{hole_id: {n("HoleID")}, east: {n("Easting")}, north: {n("Northing")}, rl: {n("Elevation")}, total_depth: {n("Length_m")}}}}}
  survey: {{path: survey.csv, columns: {{hole_id: {n("HoleID")}, depth: {n("Depth_m")}, dip: {n("Dip")}, azimuth: {n("Azimuth")}}}}}
  litho: {{path: litho.csv, columns: {{hole_id: {n("holeid")}, from_m: {n("from")}, to_m: {n("to")}, logged_code: {n("Code")}}}}}
  assay:
    path: assay.csv
    columns: {{hole_id: {n("HoleID")}, from_m: {n("From_m")}, to_m: {n("To_m")}}}
    density: {{source: {n("BD_tonnes_m3")}}}
    flags: {{low_recovery: {{source: {n("LowRec")}}}}}
  domain_lookup: {{path: lookup.csv, columns: {{logged_code: code, geomet_domain: domain}}}}
  block_model: {{path: blocks.csv, columns: {{x: X, y: Y, z: Z, dx: DX, dy: DY, dz: DZ, period: PERIOD}}, density: {{source: DENSITY}}}}
  availability: {{path: availability.csv, columns: {{hole_id: hole, availability: state, core_diameter_mm: diameter, remaining_fraction: fraction}}, value_map: {{AVAILABLE: [IN STORAGE, Y], UNAVAILABLE: [DISPOSED, NO]}}}}
attributes:
  rock: {{block_model: ROCKTYPE}}
  weathering: {{block_model: WEATHERING}}
elements:
  Zn: {{primary: true, drillhole: {{field: {n("Zn_pct")}, units: pct}}, block_model: {{field: ZN_PCT, units: pct}}}}
domaining:
  hard_break_on: [geomet_domain, weathering]
  domain_match_attribute: rock
  allocation_key: [rock, weathering, grade_bin]
  grade_bins: {{element: Zn, edges: [0, 2, 999], labels: [LOW, HIGH]}}
compositing: {{min_length_m: 6, max_length_m: 20.0001, target_mass_kg: 50, min_mass_kg: 40}}
allocation: {{method: proportional, total_samples: 6, period_weights: {{1: 2.0}}}}
selection: {{max_samples_per_hole: 2, swap_iterations: 50}}
"""
