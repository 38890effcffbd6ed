"""Data-quality checks: predicates over a source, counted in one aggregation, one issue row for each that is met."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corelode.functions.units import is_scheduled
from corelode.operators.geometry import first_collar, no_survey
from corelode.operators.medians import exact_medians
from corelode.operators.scans import HotKeys, scanned
from corelode.schema import FROM, HOLE, LENGTH, TO

SHOWN = 20
ORDER = ("ERROR", "WARN", "INFO")
#: Plausible densities, t/m3.
DENSITY_RANGE = (1.5, 6.0)
M_PER_FT = 0.3048
FEET = ("coordinates in feet", "depths in feet")


@dataclass(frozen=True)
class Check:
    name: str
    severity: str
    met: Column
    message: str


def run_checks(rows: DataFrame, source: str, checks: list[Check], hole: str | None = HOLE) -> DataFrame:
    """Issue rows of the checks that at least one row meets, with the first twenty hole ids. Rows are counted per hole; of the holes each
    task passes on twenty for a check, so neither a hot hole nor very many holes meet in one task."""
    met = [F.coalesce(c.met, F.lit(False)) for c in checks]
    flagged = rows.select(*([F.col(hole).alias("__hole")] if hole else []), *(m.alias(f"m{i}") for i, m in enumerate(met)))
    counts = [F.sum(F.col(f"m{i}").cast("long")).alias(f"n{i}") for i in range(len(checks))]
    per = flagged.groupBy("__hole").agg(*counts) if hole else flagged.agg(*counts)
    told = [
        F.struct(F.lit(i).alias("i"), F.lit(c.severity).alias("severity"), F.lit(c.name).alias("check"), F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias("count"), F.lit(c.message).alias("message"))
        for i, c in enumerate(checks)
    ]
    out = per.agg(F.array(*told).alias("all")).select(F.explode("all").alias("c")).select("c.*").where("count > 0")
    names = F.lit("")
    if hole:
        marked = F.filter(F.array(*(F.when(F.col(f"n{i}") > 0, F.lit(i)) for i in range(len(checks)))), lambda i: i.isNotNull())
        holes = per.where(F.col("__hole").isNotNull()).select("__hole", F.explode(marked).alias("i"))
        first = holes.withColumn("k", F.row_number().over(W.partitionBy("i").orderBy("__hole"))).where(F.col("k") <= SHOWN)
        few = first.groupBy("i").agg(F.sort_array(F.collect_list("__hole")).cast("array<string>").alias("holes"))
        out = out.join(F.broadcast(few), "i", "left")  # a row for each check
        names = F.coalesce(F.array_join("holes", ","), names)
    return out.select("severity", "check", F.lit(source).alias("source"), F.lit(None).cast("string").alias("hole_id"), "count", "message", F.create_map(F.lit("holes"), names).alias("detail"))


def told(rows: DataFrame, source: str, name: str, severity: str, message: str) -> DataFrame:
    """One issue row that counts all rows, if there are any."""
    return run_checks(rows, source, [Check(name, severity, F.lit(True), message)], HOLE if HOLE in rows.columns else None)


def duplicated(rows: DataFrame, keys: list[str], name: str, source: str) -> DataFrame:
    many = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return run_checks(many.withColumn(HOLE, F.concat_ws(",", *keys)), source, [Check(name, "ERROR", F.col("n") > 1, f"{', '.join(keys)} repeats")])


def orphans(rows: DataFrame, collar: DataFrame, source: str) -> DataFrame:
    """Counted are the rows of holes without a collar."""
    return told(rows.select(HOLE).join(collar.select(HOLE), HOLE, "left_anti"), source, "orphan_hole", "ERROR", "holes that aren't among the collars")


def with_previous(rows: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    return scanned(rows, HOLE, [FROM, TO], hot, prev_to=("previous", F.col(TO)), max_to=("highest", F.col(TO)))


def interval_checks(rows: DataFrame, source: str, gap_tolerance: float = 0.10, hot: HotKeys | None = None) -> DataFrame:
    gap, missing = F.col(FROM) - F.col("prev_to"), F.col(FROM).isNull() | F.col(TO).isNull()
    return run_checks(with_previous(rows, hot), source, [
        Check("interval_depth_missing", "ERROR", missing, "from or to is missing"),
        Check("interval_order", "ERROR", F.col(FROM) >= F.col(TO), "from isn't above to"),
        Check("interval_overlap", "ERROR", gap < -1e-9, "begins before the one above ends"),
        Check("interval_overlap_nested", "INFO", (F.col(FROM) - F.col("max_to") < -1e-9) & ~(gap < -1e-9), "begins before one further above ends"),
        Check("interval_gap", "INFO", (gap > 1e-9) & (gap <= gap_tolerance), "a gap within the tolerance"),
        Check("interval_gap", "WARN", gap > gap_tolerance, "a gap"),
    ])


def beyond_depth(rows: DataFrame, collar: DataFrame, source: str) -> DataFrame:
    known = first_collar(collar).select(HOLE, "total_depth")
    return run_checks(rows.join(known, HOLE), source, [Check("beyond_total_depth", "WARN", F.col(TO) > F.col("total_depth") + 1e-6, "deeper than the hole")])


def survey_checks(survey: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    rows = scanned(survey, HOLE, ["depth", "dip", "azimuth"], hot, prev=("previous", F.col("depth")))
    return run_checks(rows, "survey", [
        Check("azimuth_range", "ERROR", (F.col("azimuth") < 0) | (F.col("azimuth") >= 360), "azimuth outside 0 to 360"),
        Check("dip_range", "ERROR", F.abs("dip") > 90, "dip beyond 90"),
        Check("survey_duplicate_depth", "WARN", F.col("depth") == F.col("prev"), "a repeated depth"),
        Check("survey_incomplete", "WARN", F.col("depth").isNull() | F.col("dip").isNull() | F.col("azimuth").isNull(), "a reading isn't complete"),
    ]).unionByName(empty(survey, "survey", "survey_empty", "ERROR", "no readings"))


def empty(rows: DataFrame, source: str, name: str, severity: str, message: str) -> DataFrame:
    return run_checks(rows.limit(1).agg(F.count("*").alias("n")), source, [Check(name, severity, F.col("n") == 0, message)], None)


def dip_sign(survey: DataFrame) -> DataFrame:
    share = survey.agg(F.avg((F.col("dip") > 0).cast("int")).alias("share"))
    return run_checks(share, "survey", [Check("dip_sign", "WARN", F.col("share") > 0.9, "nearly all dips point up: is the convention right?")], None)


def density_checks(rows: DataFrame, source: str) -> DataFrame:
    low, high = DENSITY_RANGE
    hole = HOLE if HOLE in rows.columns else None
    return run_checks(rows, source, [
        Check("density_missing", "WARN", F.col("density").isNull(), "no density"),
        Check("density_range", "ERROR", (F.col("density") < low) | (F.col("density") > high), f"density outside {low} to {high}"),
    ], hole)


def block_checks(blocks: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    live = is_scheduled(F.col("period"), excluded)
    rows = run_checks(blocks, "block_model", [
        Check("block_dimension", "ERROR", (F.col("dx") <= 0) | (F.col("dy") <= 0) | (F.col("dz") <= 0), "a size that isn't positive"),
        Check("period_unscheduled", "INFO", ~live, "not scheduled"),
    ], None)
    none = blocks.agg(F.count("*").alias("n"), F.count_if(live).alias("live"))
    whole = run_checks(none, "block_model", [Check("block_model_empty", "ERROR", F.col("n") == 0, "no blocks"), Check("period_empty", "ERROR", (F.col("n") > 0) & (F.col("live") == 0), "nothing is scheduled")], None)
    return rows.unionByName(whole).unionByName(duplicated(blocks, ["x", "y", "z"], "block_duplicate_centroid", "block_model"))


def geometry_checks(rows: DataFrame) -> DataFrame:
    """Of intervals that bring their own coordinates: chord against length, middle against halfway, touching rows against each other, direction."""
    point = lambda e: [F.col(f"{a}_{e}") for a in "xyz"]
    far = lambda p, q: F.sqrt(sum(F.pow(a - b, F.lit(2.0)) for a, b in zip(p, q, strict=True)))
    by = W.partitionBy(HOLE).orderBy(FROM, TO)
    prev = {f"p_{c}": F.lag(c).over(by) for c in (TO, "x_to", "y_to", "z_to")}
    rows = rows.withColumns(prev)
    length, chord = F.col(TO) - F.col(FROM), far(point("to"), point("from"))
    ratio, slack = chord / length, F.greatest(F.lit(0.05), 0.05 * length)
    wrong = F.abs(chord - length) > slack
    coords_ft, depths_ft = wrong & (F.abs(ratio * M_PER_FT - 1) < 0.05), wrong & (F.abs(ratio / M_PER_FT - 1) < 0.05)
    medians = {r["which"]: f": the chord is about {r['median_ratio']:.3f} times the length" for r in unit_ratio(rows).collect()}
    touch = F.abs(F.col(FROM) - F.col(f"p_{TO}")) <= 1e-8 + 1e-5 * F.abs(F.col(f"p_{TO}"))
    half = [(a + b) / 2 for a, b in zip(point("from"), point("to"), strict=True)]
    missing = F.lit(False)
    for e in ("from", "to", "mid"):
        for c in point(e):
            missing = missing | c.isNull()
    ok = length > 0
    out = run_checks(rows, "samples", [
        Check("coordinates_missing", "WARN", missing, "a coordinate is missing"),
        Check("geometry_unit_mismatch", "ERROR", ok & coords_ft, "coordinates look like feet, depths like metres" + medians.get(FEET[0], "")),
        Check("geometry_unit_mismatch", "ERROR", ok & depths_ft, "depths look like feet, coordinates like metres" + medians.get(FEET[1], "")),
        Check("geometry_length_mismatch", "WARN", ok & wrong & ~coords_ft & ~depths_ft, "the chord isn't as long as the interval"),
        Check("geometry_midpoint_offset", "WARN", ok & (far(point("mid"), half) > slack), "the middle isn't halfway"),
        Check("geometry_discontinuous", "WARN", touch & (far(point("from"), [F.col(f"p_{c}") for c in ("x_to", "y_to", "z_to")]) > 0.05), "touching rows are apart"),
    ])
    dz = F.col("z_to") - F.col("z_from")
    steep = F.abs(dz) > 0.01 * length
    turns = rows.groupBy(HOLE).agg(F.max((steep & (dz > 0)).cast("int")).alias("up"), F.max((steep & (dz < 0)).cast("int")).alias("down"))
    return out.unionByName(run_checks(turns, "samples", [Check("hole_changes_vertical_direction", "WARN", (F.col("up") == 1) & (F.col("down") == 1), "rises and falls")]))


def direction_checks(ends: DataFrame) -> DataFrame:
    share = ends.agg(F.avg(F.col("rises").cast("int")).alias("share"))
    some = run_checks(ends, "geometry", [Check("hole_rises_with_depth", "INFO", F.col("rises"), "the toe is above the collar")])
    return some.unionByName(run_checks(share, "geometry", [Check("most_holes_rise", "WARN", F.col("share") > 0.5, "most holes rise: are dips the right way up?")], None))


def extent_check(rows: DataFrame, error_fraction: float = 0.5) -> DataFrame:
    share = rows.agg(F.avg(F.col("outside_model").cast("int")).alias("share"))
    some = run_checks(rows, "block_model", [Check("outside_model", "INFO", F.col("outside_model"), "intervals outside every block can't be sampled")])
    return some.unionByName(run_checks(share, "block_model", [Check("off_model_extent", "ERROR", F.col("share") > error_fraction, "too many intervals lie outside the model")], None))


def unit_ratio(rows: DataFrame) -> DataFrame:
    """(which, rows, median_ratio): of intervals whose chord and length differ by the factor between feet and metres, the exact median of
    chord / length. A row for each of the two kinds that there is."""
    far = F.sqrt(sum(F.pow(F.col(f"{a}_to") - F.col(f"{a}_from"), F.lit(2.0)) for a in "xyz"))
    length = F.col(TO) - F.col(FROM)
    ratio = far / length
    which = F.when(F.abs(ratio * M_PER_FT - 1) < 0.05, FEET[0]).when(F.abs(ratio / M_PER_FT - 1) < 0.05, FEET[1])
    bad = rows.where((length > 0) & (F.abs(far - length) > F.greatest(F.lit(0.05), 0.05 * length)))
    ratios = bad.select(which.alias("which"), ratio.alias("r")).where("which is not null")
    found = [(k, n, m) for k, (n, m) in exact_medians(ratios, "which", "r").items()]
    return rows.sparkSession.createDataFrame(sorted(found), "which string, rows long, median_ratio double")


def placed_checks(rows: DataFrame) -> DataFrame:
    """Of the framework. Where no interval has a position, that is told instead of each."""
    planned = F.coalesce(F.col("is_planned"), F.lit(False)) if "is_planned" in rows.columns else F.lit(False)
    found = run_checks(rows, "geometry", [
        Check("interval_not_desurveyed", "WARN", F.col("x_mid").isNull(), "no position"),
        Check("interval_not_logged", "WARN", F.col("logged_code").isNull() & ~planned, "no code at the middle"),
        Check("logged_code_unmapped", "ERROR", F.col("logged_code").isNotNull() & F.col("geomet_domain").isNull(), "the code has no domain"),
    ])
    places = rows.agg(F.count("*").alias("n"), F.count("x_mid").alias("placed"))
    return found.unionByName(run_checks(places, "survey", [Check("no_desurveyed_midpoints", "WARN", (F.col("n") > 0) & (F.col("placed") == 0), "no interval has a position: no block is assigned")], None))


def without_survey(collar: DataFrame, survey: DataFrame) -> DataFrame:
    return told(no_survey(collar, survey), "survey", "no_survey", "WARN", "holes without a complete reading have no trace")


def without_lithology(assay: DataFrame, litho: DataFrame) -> DataFrame:
    lost = assay.select(HOLE).distinct().join(litho.select(HOLE), HOLE, "left_anti")
    return told(lost, "litho", "no_lithology", "WARN", "holes with assays and without a log have no domains")


def codes_unmapped(logged: DataFrame, lookup: DataFrame) -> DataFrame:
    """Counted are the codes, before any interval is coded."""
    codes = logged.where("logged_code is not null").select("logged_code").distinct().join(lookup.select("logged_code"), "logged_code", "left_anti")
    return run_checks(codes, "domain_lookup", [Check("logged_code_unmapped", "ERROR", F.lit(True), "codes without a domain")], "logged_code")


def inherited(samples: DataFrame) -> DataFrame:
    """What a samples table that brings its coordinates implies."""
    n = samples.limit(1).agg(F.count("*").alias("n"))
    fixed = run_checks(n, "samples", [
        Check("geometry_supplied", "INFO", F.lit(True), "coordinates are taken as supplied; checks of collars, surveys and total depths don't apply"),
        Check("boundaries_inherited", "INFO", F.lit(True), "intervals are the table's rows, not cut at contacts"),
    ], None)
    shared = samples.where("sample_id is not null").groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1")
    return fixed.unionByName(run_checks(shared, "samples", [Check("sample_split_upstream", "INFO", F.lit(True), "sample ids on more than one row")], None))


def testwork_checks(testwork: DataFrame, intervals: DataFrame, excluded: bool = True) -> DataFrame:
    """Records without depths, and intervals whose core earlier testwork used; nothing where that core counts as available."""
    lost = testwork.where(F.col(FROM).isNull() | F.col(TO).isNull())
    if not excluded:
        return told(lost.limit(0), "existing_testwork", "prior_testwork_unlocated", "WARN", "")
    used = intervals.where("prior_testwork")
    return told(lost, "existing_testwork", "prior_testwork_unlocated", "WARN", "records without depths can't be excluded").unionByName(
        told(used, "existing_testwork", "prior_testwork_excluded", "INFO", "intervals whose core earlier testwork used"))


def undomained(placed: DataFrame) -> DataFrame:
    """placed: testwork with its domain."""
    return told(placed.where("domain is null"), "existing_testwork", "existing_testwork_undomained", "WARN", "records that match no interval count for no target")


def allocation_checks(allocation: DataFrame, method: str = "neyman", dispersion: bool = True, manual: tuple[str, ...] = ()) -> DataFrame:
    """Of the table of targets (a row for each domain): what keeps it from meaning something. `dispersion`: the model has grades."""
    few = allocation.agg(
        F.count("*").alias("n"), F.coalesce(F.sum("deficit_raw"), F.lit(0.0)).alias("short"), F.count_if(F.col("grade_sd") > 0).alias("spread"),
        F.count_if(F.col("allocation_domain").isin(list(manual)) if manual else F.lit(False)).alias("named"),
    )
    some = F.col("n") > 0
    out = [
        Check("no_scheduled_tonnage", "ERROR", ~some, "nothing is scheduled, so there are no targets"),
        Check("no_deficit", "WARN", some & (F.col("short") <= 0), "testwork covers every target: nothing is allocated"),
    ]
    if method == "neyman":
        out.append(Check("neyman_no_block_grade", "WARN", some & F.lit(not dispersion), "the model has no grade of the primary element: allocation is proportional"))
        out.append(Check("neyman_no_dispersion", "WARN", some & F.lit(dispersion) & (F.col("spread") == 0), "grades don't vary inside any domain"))
    if method == "manual":
        out.append(Check("manual_targets_missing", "ERROR", some & (F.col("named") == 0), "no domain of the model is in manual_targets"))
    return run_checks(few, "allocation", out, None)


def selection_checks(candidates: DataFrame, allocation: DataFrame, selected: DataFrame) -> DataFrame:
    """What the choice has to tell. selected: with `swaps` and interval_ids."""
    n = candidates.limit(1).agg(F.count("*").alias("n"))
    wanted = allocation.agg(F.coalesce(F.sum("deficit"), F.lit(0)).alias("wanted"))
    got = selected.agg(F.count("*").alias("got"), F.coalesce(F.max("swaps"), F.lit(0)).alias("swaps"))
    one = n.withColumn("k", F.lit(1)).join(wanted.withColumn("k", F.lit(1)), "k").join(got.withColumn("k", F.lit(1)), "k")  # a row each
    some, due = F.col("n") > 0, F.col("wanted") > 0
    counts = [
        ("ERROR", "no_candidates", ~some, F.lit(1), "no window met the rules: nothing can be chosen"),
        ("WARN", "no_deficit", some & ~due, F.lit(1), "no domain has a deficit: nothing is chosen"),
        ("WARN", "selection_exhausted", some & due & (F.col("got") < F.col("wanted")), F.col("wanted") - F.col("got"), "samples for which no candidate was left"),
        ("INFO", "swap_improvements", F.col("swaps") > 0, F.col("swaps"), "samples that the swap pass replaced"),
    ]
    rows = F.array(*(F.when(met, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("check"), many.cast("long").alias("count"), F.lit(m).alias("message"))) for s, c, met, many, m in counts))
    out = one.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("c")).select("c.*")
    out = out.select("severity", "check", F.lit("selection").alias("source"), F.lit(None).cast("string").alias("hole_id"), "count", "message", F.create_map(F.lit("holes"), F.lit("")).alias("detail"))
    return out.unionByName(told(reused_intervals(selected), "selection", "interval_reused", "ERROR", "intervals in more than one sample"))


def reused_intervals(selected: DataFrame) -> DataFrame:
    return selected.select(F.explode("interval_ids").alias("interval_id")).groupBy("interval_id").agg(F.count("*").alias("n")).where("n > 1")


def ordered(issues: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*(F.lit(x) for x in ORDER)), F.col("severity"))
    return issues.orderBy(rank, "check", "source")

