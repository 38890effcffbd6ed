"""Single operators on literal frames."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corelode.functions import numbers, units
from corelode.operators import allocate, blocks, checks, geometry, intervals, joins, runs, select, windows

SPANS = "hole_id string, from_m double, to_m double"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_split_and_code(spark):
    assay = frame(spark, [("A", 10.0, 12.0, "S1", 3e4), ("A", 12.0, 14.0, "S2", 1.0), ("B", 0.0, 10.0, "S3", 1.0), ("C", 0.0, 1.0, "S4", 2.0)], f"{SPANS}, sample_id string, elem_zn double")
    litho = frame(spark, [("A", 0.0, 11.0, "V"), ("A", 11.0, 13.0, "S"), ("B", 0.0, 3.0, "V"), ("B", 3.0, 7.0, "S"), ("B", 7.0, 10.0, "Q")], f"{SPANS}, logged_code string")
    lookup = frame(spark, [("V", "VOLCANIC"), ("S", "SEDIMENT")], "logged_code string, geomet_domain string")
    rows = {r["interval_id"]: r for r in intervals.build_framework(assay, litho, lookup).collect()}
    assert {k: (r["from_m"], r["to_m"], r["geomet_domain"]) for k, r in rows.items()} == {
        "S1_1": (10, 11, "VOLCANIC"), "S1_2": (11, 12, "SEDIMENT"), "S2_1": (12, 13, "SEDIMENT"), "S2_2": (13, 14, None), "S3_1": (0, 3, "VOLCANIC"), "S3_2": (3, 7, "SEDIMENT"), "S3_3": (7, 10, None), "S4": (0, 1, None)}
    assert rows["S1_1"]["elem_zn"] == rows["S1_2"]["elem_zn"] == 3e4


def test_split_edges(spark):
    one = frame(spark, [("A", 0.0, 5.0), ("A", 5.0, 5.0), ("A", None, 3.0)], SPANS)
    at = frame(spark, [("A", 5.0), ("A", 5e-7), ("A", None), ("B", 2.0)], "hole_id string, at_m double")
    assert [tuple(r) for r in joins.split_intervals(one, at).collect()] == [("A", 0.0, 5.0)]


def test_asof_takes_the_last_of_equals(spark):
    left = frame(spark, [("A", 1.0), ("A", 5.0), ("B", 1.0), (None, 1.0), ("A", None)], "k string, at double")
    right = frame(spark, [("A", 2.0, "x"), ("A", 5.0, "y"), ("A", 5.0, "z"), (None, 0.0, "n")], "k string, at double, v string")
    got = joins.asof_join(left, right, "k", F.col("at"), F.col("at"), ["v"], [F.col("v")])
    assert sorted(((r["k"] or "", r["at"] or 0.0, r["asof"] and r["asof"]["v"]) for r in got.collect()), key=str) == sorted([("A", 1.0, None), ("A", 5.0, "z"), ("B", 1.0, None), ("", 1.0, None), ("A", 0.0, None)], key=str)


@pytest.mark.parametrize("width", [1.0, 7.0, 1000.0])
def test_overlaps_equal_brute_force(spark, width):
    rng = np.random.default_rng(1)
    make = lambda n: [(f"H{rng.integers(3)}", float(a), float(a + rng.integers(0, 15))) for a in rng.integers(0, 80, n)]
    a, b = make(60), make(60)
    for tolerance in (0.0, 1e-6):
        got = joins.overlap_join(frame(spark, a, SPANS), frame(spark, b, SPANS), tolerance=tolerance, width=width).collect()
        want = sorted((x, y) for x in a for y in b if x[0] == y[0] and y[2] > x[1] + tolerance and y[1] < x[2] - tolerance)
        assert sorted((tuple(r["l"]), tuple(r["r"])) for r in got) == want


def trace(spark, stations, east=0.0, north=0.0, rl=0.0, depth=None):
    collar = frame(spark, [("H", east, north, rl, depth)], "hole_id string, east double, north double, rl double, total_depth double")
    return geometry.traces(collar, frame(spark, [("H", *s) for s in stations], "hole_id string, depth double, dip double, azimuth double"))


def places(spark, t, depths):
    p = geometry.positions(frame(spark, [("H", float(d)) for d in depths], "hole_id string, depth_m double"), t)
    return {r["depth_m"]: tuple(r["at"]) for r in p.collect()}


def test_straight_holes(spark):
    assert places(spark, trace(spark, [(0.0, -90.0, 0.0), (100.0, -90.0, 0.0)], 1000.0, 2000.0, 500.0), [100])[100] == pytest.approx((1000, 2000, 400))
    assert places(spark, trace(spark, [(0.0, -45.0, 90.0)], depth=100.0), [100])[100] == pytest.approx((70.7107, 0, -70.7107), abs=1e-4)
    far = places(spark, trace(spark, [(0.0, 0.0, 0.0), (100.0, 0.0, 0.0)]), [130, -10])
    assert far[130] == pytest.approx((0, 130, 0), abs=1e-9) and far[-10] == pytest.approx((0, -10, 0), abs=1e-9)


def test_published_dogleg(spark):
    rows = trace(spark, [(3000.0, 15.0 - 90.0, 20.0), (3100.0, 25.0 - 90.0, 45.0)]).orderBy("depth").collect()
    a, b = rows[-2], rows[-1]
    assert (b["y"] - a["y"], b["x"] - a["x"], a["z"] - b["z"]) == pytest.approx((27.2173, 19.4503, 94.0091), abs=0.01)


def test_arc_length(spark):
    t = trace(spark, [(0.0, -75.0, 20.0), (100.0, -60.0, 45.0)])
    p = places(spark, t, np.linspace(0, 100, 501))
    points = np.array([p[k] for k in sorted(p)])
    assert np.sqrt((np.diff(points, axis=0) ** 2).sum(axis=1)).sum() == pytest.approx(100, rel=1e-5)


def test_discretise(spark):
    holes = frame(spark, [("A", 10.0), ("B", 2.0), ("C", 7.4)], "hole_id string, total_depth double")
    got = intervals.discretise(holes, 2.5).groupBy("hole_id").agg(F.count("*").alias("n"), F.max("to_m").alias("t")).collect()
    assert {r["hole_id"]: (r["n"], r["t"]) for r in got} == {"A": (4, 10.0), "C": (2, 5.0)}


def test_nearest_block_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    boxes = [(i, *(float(v) for v in rng.integers(0, 60, 3)), *(float(v) for v in rng.choice([4, 10, 25], 3)), f"b{i}") for i in range(60)]
    points = [(i, *(float(v) + 0.37 for v in rng.integers(-5, 65, 3))) for i in range(200)] + [(900, None, 1.0, 1.0)]
    model = frame(spark, boxes, "_row long, x double, y double, z double, dx double, dy double, dz double, name string")
    got = {r["i"]: r["name"] for r in blocks.nearest_block(frame(spark, points, "i long, x_mid double, y_mid double, z_mid double"), model, ["name"]).collect()}
    for i, *p in points:
        if p[0] is None:
            assert got[i] is None
            continue
        _, k = min((sum((a - b) ** 2 for a, b in zip(p, x[1:4], strict=True)), n) for n, x in enumerate(boxes))
        x = boxes[k]
        assert got[i] == (x[7] if all(abs(a - b) <= d / 2 + 1e-6 for a, b, d in zip(p, x[1:4], x[4:7], strict=True)) else None)


def run_reasons(spark, rows, **rules):
    df = frame(spark, rows, f"{SPANS}, dom string, low_recovery boolean, elem_zn double")
    return [r["break_reason"] for r in runs.segment_runs(df, runs.BreakRules(keys=(("geomet_domain", "dom"),), primary_grade="elem_zn", **rules)).orderBy("hole_id", "from_m").collect()]


def test_break_reasons(spark):
    rows = [("A", 0.0, 1.0, "X", False, 1.0), ("A", 1.0, 2.0, "X", False, 1.0), ("A", 2.0, 3.0, "Y", False, 1.0), ("A", 3.05, 4.0, "Y", False, 1.0), ("A", 5.0, 6.0, "Z", False, 1.0), ("A", 6.0, 7.0, "Z", True, 1.0), ("A", 7.0, 8.0, "Z", False, 1.0), ("A", 8.0, 9.0, "Z", False, None), ("A", 9.0, 10.0, None, False, 1.0), ("A", 10.0, 11.0, None, False, 1.0), ("B", 0.0, 1.0, "X", False, 1.0)]
    assert run_reasons(spark, rows) == ["hole", "", "attribute:geomet_domain", "", "gap", "low_recovery", "after_unusable", "missing_primary_grade", "attribute:geomet_domain", "", "hole"]
    assert run_reasons(spark, rows, low_recovery=False)[5:7] == ["", ""]


def test_mass(spark):
    for d, want in ((36.5, 1.41), (47.6, 2.40), (63.5, 4.27), (85.0, 7.66)):
        got = spark.range(1).select((units.core_area(F.lit(d)) * 0.5 * 2.7 * 1000).alias("m")).collect()[0]["m"]
        assert got == pytest.approx(want, abs=0.01)
    rows = frame(spark, [("A", 1.0, 2.7, None), ("B", 1.0, None, 3.1), ("C", 1.0, None, None)], "hole_id string, length_m double, density double, bm_density double")
    known = frame(spark, [("A", "AVAILABLE", None, 1.0)], "hole_id string, availability string, core_diameter_mm double, remaining_fraction double")
    got = {r["hole_id"]: r for r in blocks.with_mass(blocks.with_core(rows, known, 85.0, 0.5), 1.0, 2.5).collect()}
    assert got["A"]["availability"] == "AVAILABLE" and got["B"]["availability"] == got["C"]["availability"] == "UNAVAILABLE"
    assert [round(got[k]["mass_kg"] / (math.pi * 0.0425**2 * 1000), 6) for k in "ABC"] == [2.7, 1.55, 1.25]


def windows_brute(rows, r):
    """Best (quality, length) for each start."""
    out = {}
    for i in range(len(rows)):
        best = None
        for j in range(i + 1, len(rows) + 1):
            part = rows[i:j]
            length, mass = sum(x[0] for x in part), sum(x[1] for x in part)
            if length > r.max_length:
                break
            if length >= r.min_length and mass >= r.min_mass:
                mean = sum(x[0] * x[2] for x in part) / length
                cv = math.sqrt(max(sum(x[0] * x[2] ** 2 for x in part) / length - mean**2, 0)) / mean
                if cv <= r.max_cv:
                    q = min(mass / r.target_mass, r.mass_cap) / (1 + cv)
                    if best is None or q > best[0] + 1e-12:
                        best = (q, j - i)
            if mass > 1.5 * r.target_mass:
                break
        if best:
            out[i] = best
    return out


def test_candidates_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(float(rng.integers(5, 20)) / 10, float(rng.integers(10, 90)) / 10, float(rng.integers(1, 50)) * 100) for _ in range(120)]
    at, table = 0.0, []
    for i, (n, m, g) in enumerate(rows):
        table.append(("A", 1, at, at + n, n, m, g, f"i{i}"))
        at += n
    r = windows.WindowRules(4.0, 9.9999, 30.0, 20.0, "elem_zn", max_cv=0.8, same_bin=False)
    got = windows.candidates(frame(spark, table, "hole_id string, run_no long, from_m double, to_m double, length_m double, mass_kg double, elem_zn double, interval_id string"), r).collect()
    want = windows_brute(rows, r)
    assert {int(x["interval_ids"][0][1:]): (round(x["quality"], 9), x["intervals"]) for x in got} == {i: (round(q, 9), n) for i, (q, n) in want.items()}


def test_rounding(spark):
    rows = frame(spark, [("a", 1.7), ("b", 1.2), ("c", 1.1)], "allocation_domain string, v double")
    assert {r["allocation_domain"]: r["n"] for r in allocate.largest_remainder(rows, "v", 5, "n").collect()} == {"a": 2, "b": 2, "c": 1}
    zero = frame(spark, [("a", 0.0), ("b", 0.0), ("c", 0.0)], "allocation_domain string, v double")
    assert sum(r["n"] for r in allocate.largest_remainder(zero, "v", 6, "n").collect()) == 3 and sum(r["n"] for r in allocate.largest_remainder(zero, "v", 6, "n", zeros=True).collect()) == 0


def test_largest_remainder_takes_ties_by_name(spark):
    rows = frame(spark, [("c", 1.5), ("a", 1.5), ("b", 1.0)], "allocation_domain string, v double")
    assert {r["allocation_domain"]: r["n"] for r in allocate.largest_remainder(rows, "v", 4, "n").collect()} == {"a": 2, "b": 1, "c": 1}


def test_targets(spark):
    tonnage = frame(spark, [("A", 60.0, 60.0, 60.0), ("B", 30.0, 30.0, 30.0), ("C", 10.0, 10.0, 10.0)], "allocation_domain string, tonnes double, weighted_tonnes double, tonnes_pct double")
    got = lambda **k: {r["allocation_domain"]: r["deficit"] for r in allocate.targets(tonnage, 100, **k).collect()}
    assert got(method="proportional") == {"A": 60, "B": 30, "C": 10}
    assert got(method="manual", manual={"A": 1.0, "C": 3.0}) == {"A": 25, "B": 0, "C": 75}
    have = frame(spark, [("A", 60)], "allocation_domain string, existing long")
    assert got(method="proportional", existing=have) == {"A": 0, "B": 75, "C": 25}
    spread = frame(spark, [("A", 1.0), ("B", 3.0)], "allocation_domain string, grade_sd double")
    assert sum(got(method="neyman", dispersion=spread).values()) == 100


def chosen(rows, deficits, **rules):
    table = pd.DataFrame(rows, columns=["candidate_id", "hole_id", "from_m", "to_m", "allocation_domain", "x_mid", "y_mid", "z_mid", "cv_primary", "domain_match", "base"])
    return select.choose(table, deficits, select.SelectRules(**({"swaps": 0} | rules)))["candidate_id"].tolist()


def row(i, hole="H", start=0.0, dom="A", x=0.0, cv=0.1, base=1.0, match=True):
    return (i, hole, start, start + 5, dom, x, 0.0, 0.0, cv, match, base)


def test_selection_rules():
    assert chosen([row("a", "H1", cv=0.3), row("b", "H2", cv=0.2)], {"A": 1}) == ["b"]
    assert len(chosen([row(f"c{i}", start=10.0 * i) for i in range(6)], {"A": 6}, max_per_hole=2)) == 2
    assert len(chosen([row("a", "H1", x=0.0), row("b", "H2", x=30.0), row("c", "H3", x=60.0)], {"A": 3}, min_separation=50.0)) == 2
    assert len(chosen([row("a", start=0.0), row("b", start=3.0), row("c", start=5.0)], {"A": 3}, max_per_hole=9)) == 2
    assert chosen([row("a"), row("b", "H2", dom="B")], {"B": 1}) == ["b"]
    assert chosen([row("a", base=1.0), row("b", "H2", base=1.0 + 1e-7, cv=0.5)], {"A": 1}) == ["a"]


def test_swap_only_gains():
    rng = np.random.default_rng(0)
    rows = [row(f"c{i}", f"H{i % 9}", 10.0 * (i // 9), x=float(rng.integers(0, 999)), cv=float(rng.random()), base=float(rng.random()), match=bool(i % 3)) for i in range(60)]
    table = pd.DataFrame(rows, columns=["candidate_id", "hole_id", "from_m", "to_m", "allocation_domain", "x_mid", "y_mid", "z_mid", "cv_primary", "domain_match", "base"])
    c = select.Choice(table, {"A": 12}, select.SelectRules(swaps=300))
    c.greedy()
    before = c.objective(c.taken)
    assert c.swap() > 0 and c.objective(c.taken) > before and len(set(c.taken)) == 12
    assert chosen(rows, {"A": 12}, swaps=300) == chosen(rows, {"A": 12}, swaps=300)


def test_spread():
    assert select.spread(np.array([[0.0, 0, 0], [30, 40, 0]])) == 50 and select.spread(np.array([[0.0, 0, 0], [np.nan, 0, 0]])) == 0


def parsed(spark, text, grade=False, **rules):
    f = numbers.parse_grade if grade else numbers.parse_number
    return tuple(frame(spark, [(text,)], "t string").select(f(F.col("t"), numbers.ParseRules(**rules)).alias("p")).collect()[0]["p"])


@pytest.mark.parametrize(
    ("text", "grade", "rules", "want"),
    [
        ("<0.01", True, {}, (0.005, "below_detection")), ("-99", True, {}, (None, "negative")), ("-99.0", True, {"null_values": ("-99",)}, (None, "declared_null")), ("-4", True, {"negative_is_below_detection": True}, (2.0, "below_detection")),
        ("-", False, {}, (None, "unparsed")), ("NA", False, {}, (None, "unparsed")), ("na", False, {"null_values": ("NA",)}, (None, "declared_null")), ("nan", False, {}, (None, "unparsed")), ("inf", False, {}, (None, "unparsed")),
        ("1e999", False, {}, (None, "unparsed")), (" 1.5e2 ", False, {}, (150.0, "ok")), (".5", False, {}, (0.5, "ok")), ("5.", False, {}, (5.0, "ok")), ("1.5d", False, {}, (None, "unparsed")), ("", False, {}, (None, "blank")), ("-3", False, {}, (-3.0, "ok")), (None, False, {}, (None, "blank")),
    ],
)
def test_parsing(spark, text, grade, rules, want):
    assert parsed(spark, text, grade, **rules) == want


def test_bins_labels_and_schedule(spark):
    rows = frame(spark, [(0.0,), (1e4,), (2e4,), (999.0e4,), (None,), (-1.0,)], "v double")
    b = lambda closed: [r[0] for r in rows.select(units.grade_bin(F.col("v"), [0, 2e4, 999e4], ["LOW", "HIGH"], closed)).collect()]
    assert b(False) == ["LOW", "LOW", "HIGH", None, None, None] and b(True) == ["LOW", "LOW", "HIGH", "HIGH", None, None]
    t = frame(spark, [("1",), ("",), (None,), ("nan",), ("WASTE",)], "p string")
    assert [r[0] for r in t.select(units.is_scheduled(F.col("p"), ["waste"])).collect()] == [True, False, False, False, False]
    assert frame(spark, [("volcanic", None, "high")], "a string, b string, c string").select(units.compose_label([F.col(c) for c in "abc"])).collect()[0][0] == "VOLCANIC-UNKNOWN-HIGH"
    assert [r["p"] for r in frame(spark, [("10",), ("LATE",), (None,), ("9",)], "p string").orderBy(*units.period_order(F.col("p"))).collect()] == ["9", "10", "LATE", None]


def test_domain_match(spark):
    rows = frame(spark, [("a", "A", None, None), ("a", "b", "c", "C"), (None, "x", "c", None)], "p string, q string, r string, s string")
    assert [r["domain_match"] for r in blocks.domain_match(rows, [("p", "q"), ("r", "s")]).collect()] == [True, False, None]


def test_geometry_checks(spark):
    cols = [f"{a}_{e} double" for e in ("from", "to", "mid") for a in "xyz"]
    good = lambda h, a, b, k=1.0: (h, a, b, 0.0, 0.0, -a * k, 0.0, 0.0, -b * k, 0.0, 0.0, -(a + b) / 2 * k)
    rows = frame(spark, [good("A", 0.0, 10.0), good("A", 10.0, 20.0), good("F", 0.0, 10.0, 3.2808), ("M", 0.0, 10.0, 0.0, 0.0, 0.0, 0.0, 0.0, -10.0, 5.0, 0.0, -5.0), ("N", 0.0, 1.0, *[None] * 9)], f"{SPANS}, {', '.join(cols)}")
    got = {r["check"]: r["count"] for r in checks.geometry_checks(rows).collect()}
    assert got == {"coordinates_missing": 1, "geometry_unit_mismatch": 1, "geometry_midpoint_offset": 1}


def test_run_checks_tells_holes(spark):
    rows = frame(spark, [("A", 0.0, 1.0), ("A", 0.5, 2.0), ("B", 3.0, 2.0), ("C", 0.0, None)], SPANS)
    got = {r["check"]: (r["count"], r["detail"]["holes"]) for r in checks.interval_checks(rows, "assay").collect()}
    assert got == {"interval_overlap": (1, "A"), "interval_order": (1, "B"), "interval_depth_missing": (1, "C")}
    assert checks.ordered(checks.interval_checks(rows, "assay")).collect()[0]["severity"] == "ERROR"


def test_hot_and_long_intervals_are_split(spark):
    rng = np.random.default_rng(11)
    spans = [("H", float(a), float(a) + float(n)) for a, n in zip(rng.integers(-300, 3000, 40), rng.choice([1, 40, 64, 65, 300, 5000, 70000], 40), strict=True)]
    cuts = sorted({float(x) / 2 for x in rng.integers(-600, 8000, 300)})
    got = joins.split_intervals(frame(spark, spans, SPANS), frame(spark, [("H", c) for c in cuts], "hole_id string, at_m double")).collect()
    want = []
    for _, a, b in spans:
        edges = [a, *(c for c in cuts if a + 1e-6 < c < b - 1e-6), b]
        want += zip(edges, edges[1:], strict=False)
    assert sorted((r["from_m"], r["to_m"]) for r in got) == sorted(want)


@pytest.mark.parametrize("text", ["5.2\t", "\t5.2", " 5.2 ", "\r\n5.2 "])
def test_blanks_of_all_kinds(spark, text):
    assert parsed(spark, text) == (5.2, "ok") and parsed(spark, text.replace("5.2", "")) == (None, "blank")


def test_odd_periods_have_the_default_weight(spark):
    rows = frame(spark, [(p,) for p in ("NaN", "Infinity", "1e30", "-1e30", "2.7", " 2 ", "-0.5", None, "x")], "p string")
    got = [r[0] for r in rows.select(units.period_weight(F.col("p"), {"2": 5.0, "0": 7.0}, 1.5)).collect()]
    assert got == [1.5, 1.5, 1.5, 1.5, 5.0, 5.0, 7.0, 1.5, 1.5]


def test_issues_show_the_least_lines_and_top_values(spark):
    rows = spark.range(5000).selectExpr("id as _row", "case when id % 10 = 3 then concat('bad', id % 70) when id % 2 = 0 then '-99' else '1' end as t").repartition(7)
    rows = rows.withColumn("p", numbers.parse_grade(F.col("t"), numbers.ParseRules(("-99",))))
    got = {r["check"]: r for r in numbers.parse_issues(rows, "assay", {"zn": ("t", "p")}).collect()}
    assert got["null_value"]["count"] == 2500 and got["null_value"]["message"].endswith("lines 2, 4, 6, 8, 10")
    assert got["null_value"]["detail"]["lines"].split(",") == [str(k) for k in range(2, 42, 2)]
    assert got["value_unparseable"]["message"].startswith("zn: 'bad3' x 72, 'bad13' x 72, 'bad23' x 72, 'bad33' x 71, 'bad43' x 71 and 2 more; lines 5, 15")


def test_many_holes_are_cut_to_twenty(spark):
    rows = spark.range(3000).selectExpr("id as hole_id", "1.0D as from_m", "0.5D as to_m")
    r = checks.interval_checks(rows, "assay").collect()[0]
    assert (r["check"], r["count"], r["detail"]["holes"]) == ("interval_order", 3000, ",".join(map(str, range(20))))


def test_duplicate_collars_place_once(spark):
    collar = frame(spark, [(5, "H", 100.0, 0.0, 0.0, 10.0), (9, "H", 900.0, 0.0, 0.0, 10.0)], "_row long, hole_id string, east double, north double, rl double, total_depth double")
    t = geometry.traces(collar, frame(spark, [("H", 0.0, -90.0, 0.0)], "hole_id string, depth double, dip double, azimuth double"))
    assert sorted((r["depth"], r["x"]) for r in t.collect()) == [(0.0, 100.0), (10.0, 100.0)]


def test_swap_draws_from_domains_without_deficit():
    rng = np.random.default_rng(4)
    rows = [row(f"c{i:02d}", f"H{i % 5}", 10.0 * (i // 5), dom="AB"[i % 2], cv=float(rng.random()), base=float(rng.random())) for i in range(30)]
    table = pd.DataFrame(rows, columns=["candidate_id", "hole_id", "from_m", "to_m", "allocation_domain", "x_mid", "y_mid", "z_mid", "cv_primary", "domain_match", "base"])
    c = select.Choice(table.sort_values(["hole_id", "from_m"], ignore_index=True), {"A": 4}, select.SelectRules(swaps=80))
    c.greedy()
    now, value, pool = list(c.taken), c.objective(c.taken), [i for i in range(30) if i not in c.taken]
    draw = np.random.default_rng(42)
    assert len(pool) == 26 and any(c.domain[i] == "B" for i in pool)
    for _ in range(80):
        at, new = int(draw.integers(4)), pool[int(draw.integers(26))]
        trial = [*now[:at], new, *now[at + 1 :]]
        if new not in now and c.free(new, now[:at] + now[at + 1 :])[0] and c.objective(trial) > value + 1e-12:
            now, value = trial, c.objective(trial)
    c.swap()
    assert c.taken == now


def test_selection_tells(spark):
    cand = frame(spark, [("a", "H", 0.0, 5.0, "A", 0.0, 0.0, 0.0, 0.1, True, 0.8, ["x", "y"]), ("b", "H", 5.0, 9.0, "A", 3.0, 4.0, 0.0, 0.2, False, 0.7, ["y"])], f"candidate_id string, {SPANS}, allocation_domain string, x_mid double, y_mid double, z_mid double, cv_primary double, domain_match boolean, quality double, interval_ids array<string>")
    wanted = frame(spark, [("A", 3), ("B", 0)], "allocation_domain string, deficit long")
    got = select.greedy_select(cand, wanted)
    assert {r["check"]: r["count"] for r in checks.selection_checks(cand, wanted, got).collect()} == {"selection_exhausted": 1, "interval_reused": 1}
    none = select.greedy_select(cand.limit(0), wanted)
    assert [r["check"] for r in checks.selection_checks(cand.limit(0), wanted, none).collect()] == ["no_candidates"]
    r = select.objective_parts(got, wanted).collect()[0]
    assert (r["fit"], r["separation"], r["samples"], r["match_rate"]) == (1, 5.0, 2, 0.5) and r["objective"] == pytest.approx(0.05 - 10 - 0.3 + 2.5)


def test_greedy_equals_plain_search():
    rng = np.random.default_rng(8)
    for trial in range(6):
        rows = [row(f"c{i:02d}", f"H{rng.integers(6)}", float(rng.integers(0, 60)), dom="ABC"[rng.integers(3)], x=float(rng.integers(0, 200)), cv=float(rng.random()), base=float(rng.integers(1, 9)) / 4) for i in range(50)]
        rules = {"max_per_hole": 2, "min_separation": 15.0 * (trial % 2)}
        table = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
        left, got = {"A": 3, "B": 4, "C": 1}, []
        for _ in range(8):
            ok = [r for r in table if r not in got and sum(p[1] == r[1] for p in got) < 2 and not any(p[1] == r[1] and r[2] < p[3] and r[3] > p[2] for p in got)]
            ok = [r for r in ok if left[r[4]] > 0 and not any(math.dist(r[5:8], p[5:8]) < rules["min_separation"] for p in got)]
            if not ok:
                break
            top = max(left[r[4]] * r[10] for r in ok)
            got.append(min((r for r in ok if abs(left[r[4]] * r[10] - top) <= 1e-8 + 1e-5 * top), key=lambda r: (r[8], r[1], r[2])))
            left[got[-1][4]] -= 1
        assert chosen(rows, {"A": 3, "B": 4, "C": 1}, **rules) == [r[0] for r in got]
