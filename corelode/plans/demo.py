"""The registered queries: each operator over the derived tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corelode.functions import numbers, units
from corelode.operators import allocate, blocks, checks, geometry, intervals, joins, neighbours, runs, scans, select, windows
from corelode.plans import files, project, report
from corelode.plans import views as v
from corelode.plans.views import shared_dir
from corelode.sources import readers

RULES = windows.WindowRules(min_length=6.0, max_length=20.005, target_mass=50.0, min_mass=40.0, primary="elem_zn", edges=v.EDGES, labels=v.LABELS, max_cv=1.0, same_bin=False, keep=("geomet_domain",), label=("geomet_domain", "grade_bin"))
TOTAL = 40
WEIGHTS = {"1": 2.0, "2": 1.5, "3": 0.5}


def _r(c: str, digits: int) -> Column:
    """Rounded, with no negative zero."""
    return (F.round(F.col(c), digits) + 0.0).alias(c)


def interval_split(s: SparkSession, d: str) -> DataFrame:
    cut = joins.split_intervals(v.assay(s, d), intervals.contacts(v.litho(s, d)))
    return cut.select("hole_id", "sample_id", _r("from_m", 2), _r("to_m", 2), _r("elem_zn", 2))


def interval_split_lengths(s: SparkSession, d: str) -> DataFrame:
    cut = joins.split_intervals(v.assay(s, d), intervals.contacts(v.litho(s, d)))
    return cut.groupBy("hole_id").agg(F.count("*").alias("pieces"), F.round(F.sum(F.col("to_m") - F.col("from_m")), 4).alias("metres"))


def asof_litho_domain(s: SparkSession, d: str) -> DataFrame:
    rows = intervals.domain_of_code(intervals.logged_at_middle(v.assay(s, d), v.litho(s, d)), v.lookup(s, d))
    return rows.select("sample_id", "logged_code", "geomet_domain")


def unmapped_codes(s: SparkSession, d: str) -> DataFrame:
    return intervals.unmapped_codes(intervals.logged_at_middle(v.assay(s, d), v.litho(s, d)), v.lookup(s, d))


def sample_ids_suffix(s: SparkSession, d: str) -> DataFrame:
    cut = joins.split_intervals(v.assay(s, d), intervals.contacts(v.litho(s, d)))
    return intervals.with_interval_ids(cut).select("sample_id", "interval_id", _r("from_m", 2))


def desurvey_stations(s: SparkSession, d: str) -> DataFrame:
    return geometry.traces(v.collar(s, d), v.survey(s, d)).select("hole_id", _r("depth", 2), _r("x", 4), _r("y", 4), _r("z", 4))


def desurvey_midpoints(s: SparkSession, d: str) -> DataFrame:
    placed = geometry.with_coordinates(v.assay(s, d), geometry.traces(v.collar(s, d), v.survey(s, d)), ("mid",))
    return placed.select("sample_id", _r("x_mid", 3), _r("y_mid", 3), _r("z_mid", 3))


def planned_discretise(s: SparkSession, d: str) -> DataFrame:
    holes = v.collar(s, d).withColumn("total_depth", 100.0 + F.col("hole_id") % 7 * 10.5)
    return intervals.discretise(holes, 4.0).select("hole_id", "from_m", "to_m")


def hole_ends_orientation(s: SparkSession, d: str) -> DataFrame:
    placed = geometry.with_coordinates(v.assay(s, d), geometry.traces(v.collar(s, d), v.survey(s, d)), ("from", "to"))
    return geometry.hole_ends(placed).select("hole_id", _r("collar_z", 3), _r("toe_z", 3), "rises")


def _assigned(s: SparkSession, d: str) -> DataFrame:
    return blocks.nearest_block(v.points(s, d), v.blocks(s, d), ["_row", "period", "bm_attr_rock", "bm_elem_zn"])


def block_assign_nearest(s: SparkSession, d: str) -> DataFrame:
    return _assigned(s, d).select("point_id", F.col("_row").alias("block"), "outside_model")


def block_assign_mixed(s: SparkSession, d: str) -> DataFrame:
    """Nearest blocks in a model of mixed sizes."""
    found = blocks.nearest_block(v.points(s, d), v.mixed_blocks(s, d), ["_row"])
    return found.select("point_id", F.col("_row").alias("block"), "outside_model")


def nearest_neighbours(s: SparkSession, d: str) -> DataFrame:
    """Parts as places: most of them scattered, every fifth in a crowd of a metre, some at one place."""
    found = neighbours.nearest_neighbours(v.places(s, d), "place_id", "x", "y", "z")
    return found.select("place_id", _r("nearest_m", 6))


def outside_model_fraction(s: SparkSession, d: str) -> DataFrame:
    return blocks.outside_fraction(_assigned(s, d)).select(_r("outside_fraction", 9))


def _two_sided(s: SparkSession, d: str) -> DataFrame:
    """Parts with a logged and a modelled attribute, either of which may be missing."""
    k = F.col("p_partkey")
    return v.table(s, d, "part").select(k, F.when(k % 5 != 0, F.substring("p_brand", 1, 7)).alias("dh_attr_rock"), F.when(k % 3 != 0, F.upper(F.substring("p_brand", 1, 8))).alias("bm_attr_rock"))


def resolve_attributes(s: SparkSession, d: str) -> DataFrame:
    return blocks.resolve_attributes(_two_sided(s, d), ["rock"]).select("p_partkey", "attr_rock")


def domain_match_rate(s: SparkSession, d: str) -> DataFrame:
    rows = blocks.domain_match(_two_sided(s, d), [("dh_attr_rock", "bm_attr_rock")])
    return rows.groupBy("domain_match").agg(F.count("*").alias("n"))


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return blocks.label_rows(v.blocks(s, d), "bm_elem_zn", list(v.EDGES), list(v.LABELS), ["bm_attr_rock", "grade_bin"])


def grade_bins(s: SparkSession, d: str) -> DataFrame:
    return _labelled(s, d).groupBy("grade_bin").agg(F.count("*").alias("n"))


def allocation_domain_labels(s: SparkSession, d: str) -> DataFrame:
    return _labelled(s, d).select(F.col("_row").alias("block"), "allocation_domain")


def _massed(s: SparkSession, d: str) -> DataFrame:
    return blocks.with_mass(blocks.with_core(v.assay(s, d), v.availability(s, d), 47.6, 0.5), 0.9, 2.7)


def interval_mass_fail_closed(s: SparkSession, d: str) -> DataFrame:
    return _massed(s, d).select("sample_id", "availability", _r("mass_kg", 5))


def prior_testwork_overlap(s: SparkSession, d: str) -> DataFrame:
    rows = allocate.mark_testwork(intervals.with_interval_ids(v.assay(s, d)), v.testwork(s, d))
    return rows.select("interval_id", "prior_testwork", F.array_join("prior_testwork_ids", ",").alias("ids"))


def _placed_testwork(s: SparkSession, d: str) -> DataFrame:
    rows = intervals.domain_of_code(intervals.logged_at_middle(v.assay(s, d), v.litho(s, d)), v.lookup(s, d)).withColumnRenamed("geomet_domain", "allocation_domain")
    known = s.createDataFrame([("VOLCANIC",), ("SEDIMENT",)], "allocation_domain string")
    return allocate.testwork_domains(v.testwork(s, d), rows, known)


def testwork_modal_domain(s: SparkSession, d: str) -> DataFrame:
    return _placed_testwork(s, d).select("sample_id", "domain")


def existing_coverage(s: SparkSession, d: str) -> DataFrame:
    return allocate.existing_coverage(_placed_testwork(s, d))


def _segmented(s: SparkSession, d: str) -> DataFrame:
    coded = intervals.logged_at_middle(_massed(s, d), v.litho(s, d), tasks=scans.tasks_for(v.table(s, d, "lineitem")))
    rows = intervals.domain_of_code(coded, v.lookup(s, d))
    rows = rows.withColumn("elem_zn", F.when(F.col("elem_zn") > 0, F.col("elem_zn")))
    return runs.segment_runs(rows, runs.BreakRules(0.1, (("geomet_domain", "geomet_domain"),), primary_grade="elem_zn"))


def run_segmentation(s: SparkSession, d: str) -> DataFrame:
    return runs.with_run_ids(_segmented(s, d)).select("sample_id", "run_id", "break_reason", "usable")


def run_break_reasons(s: SparkSession, d: str) -> DataFrame:
    return _segmented(s, d).groupBy("break_reason").agg(F.count("*").alias("n"))


def run_summary(s: SparkSession, d: str) -> DataFrame:
    rows = runs.summarise_runs(_segmented(s, d), ("geomet_domain",))
    return rows.select("hole_id", "run_no", _r("from_m", 2), _r("to_m", 2), "intervals", _r("length_m", 3), "break_reason", "usable", _r("mass_kg", 4), "geomet_domain")


def short_runs(s: SparkSession, d: str) -> DataFrame:
    rows = runs.short_runs(runs.summarise_runs(_segmented(s, d)), 6.004, 40.0)
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


HOT_ORDER = ("from_m", "to_m", "sample_id", "elem_zn", "dh_attr_rock", "low_recovery")


def hot_hole_runs(s: SparkSession, d: str) -> DataFrame:
    """Runs where one hole has half of all rows: it is scanned in pieces."""
    rows = v.hot_assay(s, d)
    found = runs.segment_runs(rows, runs.BreakRules(0.25, (("rock", "dh_attr_rock"),), primary_grade="elem_zn"), HOT_ORDER, scans.hot_keys(rows))
    return found.select("hole_id", "sample_id", "run_no", "break_reason", "usable")


def hot_hole_codes(s: SparkSession, d: str) -> DataFrame:
    rows = v.hot_assay(s, d)
    return intervals.logged_at_middle(rows, v.hot_litho(s, d), hot=scans.hot_keys(rows)).select("hole_id", "sample_id", "logged_code")


def hot_hole_gaps(s: SparkSession, d: str) -> DataFrame:
    rows = v.hot_assay(s, d)
    return _counts(checks.interval_checks(rows, "assay", 0.25, scans.hot_keys(rows)))


def event_sessions(s: SparkSession, d: str) -> DataFrame:
    events = v.table(s, d, "events")
    rows = runs.sessions(events, gap_seconds=6 * 3600, hot=scans.hot_keys(events, "user_id", runs.micros("ts")))
    return rows.select("user_id", "session_no", "n", F.unix_micros(F.col("start_ts").cast("timestamp")).alias("start_us"))


def _usable(s: SparkSession, d: str) -> DataFrame:
    return _segmented(s, d).where("usable and availability <> 'UNAVAILABLE'").withColumn("interval_id", F.col("sample_id"))


def candidate_windows(s: SparkSession, d: str) -> DataFrame:
    rows = windows.windows(_usable(s, d), RULES)
    return rows.groupBy("hole_id", "run_no").agg(F.count("*").alias("windows"), F.sum("n").cast("long").alias("intervals"))


def best_window_per_start(s: SparkSession, d: str) -> DataFrame:
    return windows.candidates(_usable(s, d), RULES).select("hole_id", "run_no", _r("from_m", 2), _r("quality", 5))


def domain_tonnage(s: SparkSession, d: str) -> DataFrame:
    return allocate.domain_tonnage(_labelled(s, d), WEIGHTS).select("allocation_domain", _r("tonnes", 2), _r("weighted_tonnes", 2), _r("tonnes_pct", 6))


def tonnage_by_period(s: SparkSession, d: str) -> DataFrame:
    return allocate.tonnage_by_period(_labelled(s, d)).select("allocation_domain", "period", _r("tonnes", 2))


def neyman_dispersion(s: SparkSession, d: str) -> DataFrame:
    return allocate.grade_dispersion(_labelled(s, d), "bm_elem_zn").select("allocation_domain", _r("grade_sd", 4))


def allocation_targets(s: SparkSession, d: str) -> DataFrame:
    labelled = _labelled(s, d)
    got = allocate.targets(allocate.domain_tonnage(labelled, WEIGHTS), TOTAL, "neyman", allocate.grade_dispersion(labelled, "bm_elem_zn"), min_samples=1, min_pct=1.0)
    return got.select("allocation_domain", _r("target_raw", 5), _r("deficit_raw", 5), "target", "deficit")


def _targets(s: SparkSession, d: str, method: str, **more) -> DataFrame:
    return allocate.targets(allocate.domain_tonnage(_labelled(s, d), WEIGHTS), TOTAL, method, **more)


RISKS = {"BRAND#11-MED": 2.0, "BRAND#55-MED": 0.5}
MANUAL = {"BRAND#12-MED": 3.0, "BRAND#21-HIGH": 1.0, "BRAND#34-MED": 2.5}


def targets_proportional_risk(s: SparkSession, d: str) -> DataFrame:
    return _targets(s, d, "proportional", risk=RISKS).select("allocation_domain", _r("target_raw", 5), "target", "deficit")


def targets_manual(s: SparkSession, d: str) -> DataFrame:
    return _targets(s, d, "manual", manual=MANUAL).select("allocation_domain", _r("target_raw", 5), "target", "deficit")


def largest_remainder(s: SparkSession, d: str) -> DataFrame:
    per = v.table(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    share = per.withColumn("share", 1000.0 * F.col("n") / F.sum("n").over(allocate.W.partitionBy()))
    return allocate.largest_remainder(share, "share", 1000, "given", "o_orderpriority").select("o_orderpriority", "given")


_HELD: list[DataFrame] = []


def _held(rows: DataFrame) -> DataFrame:
    """rows, kept in memory until the next query that needs some, so one table at most is held."""
    while _HELD:
        _HELD.pop().unpersist()
    _HELD.append(rows.persist())
    return _HELD[0]


def _choice(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = geometry.with_coordinates(_usable(s, d), geometry.traces(v.collar(s, d), v.survey(s, d)), ("mid",))
    found = windows.with_candidate_ids(_held(windows.candidates(rows, RULES)))  # read for numbers, tonnage, scores and the picks
    tonnage = found.groupBy("allocation_domain").agg(F.sum("mass_kg").alias("tonnes"), F.sum("mass_kg").alias("weighted_tonnes")).withColumn("tonnes_pct", F.lit(100.0))
    allocation = allocate.targets(tonnage, TOTAL, "proportional")
    return found, allocation


def greedy_select(s: SparkSession, d: str) -> DataFrame:
    found, allocation = _choice(s, d)
    return select.greedy_select(found, allocation).select("sample_no", "candidate_id", "allocation_domain", "hole_id", "from_m", "to_m", "quality", "picked", "reason")


def pick_list(s: SparkSession, d: str) -> DataFrame:
    found, allocation = _choice(s, d)
    return windows.pick_list(select.greedy_select(found, allocation), _usable(s, d), ["elem_zn"])


def unmet_gaps(s: SparkSession, d: str) -> DataFrame:
    """Targets for all domains of the block model; what drilling could fill is counted in whole samples a hole."""
    allocation = _targets(s, d, "proportional").select("allocation_domain", "deficit")
    per = v.table(s, d, "part").groupBy(F.concat_ws("-", F.upper("p_brand"), F.lit("MED")).alias("allocation_domain")).agg(F.count("*").alias("n"))
    return allocate.unmet(allocation, per.select("allocation_domain", (F.col("n") % 3).alias("achieved")))


def unmet_after_selection(s: SparkSession, d: str) -> DataFrame:
    found, allocation = _choice(s, d)
    few = select.SelectRules(max_per_hole=1, min_separation=400.0)
    return allocate.unmet(allocation, select.achieved(select.greedy_select(found, allocation, few)))


def objective_components(s: SparkSession, d: str) -> DataFrame:
    found, allocation = _choice(s, d)
    return select.objective_parts(select.greedy_select(found, allocation), allocation)


def _counts(issues: DataFrame) -> DataFrame:
    return issues.select("severity", "check", "count")


def dq_intervals(s: SparkSession, d: str) -> DataFrame:
    rows = v.assay(s, d)
    k = F.col("elem_zn")
    moved = rows.withColumns({"from_m": F.when(k == 10000, F.col("from_m") - 0.3).when(k == 20000, F.col("from_m") + 0.05).when(k == 50000, F.col("from_m") + 0.3).otherwise(F.col("from_m")), "to_m": F.when(k == 80000, F.lit(None).cast("double")).otherwise(F.col("to_m"))})
    return _counts(checks.interval_checks(moved, "assay"))


def dq_orphans(s: SparkSession, d: str) -> DataFrame:
    return _counts(checks.orphans(v.assay(s, d), v.collar(s, d).where("hole_id % 5 <> 0"), "assay"))


def dq_beyond_depth(s: SparkSession, d: str) -> DataFrame:
    return _counts(checks.beyond_depth(v.assay(s, d), v.collar(s, d).withColumn("total_depth", F.lit(700.0)), "assay"))


def dq_density_range(s: SparkSession, d: str) -> DataFrame:
    rows = v.assay(s, d).withColumn("density", F.when(F.col("density") > 2.85, F.col("density") * 3).when(F.col("density") > 2.55, F.col("density")))
    return _counts(checks.density_checks(rows, "assay"))


def dq_survey(s: SparkSession, d: str) -> DataFrame:
    rows = v.survey(s, d).withColumns({"azimuth": F.when(F.col("depth") == 100, F.col("azimuth") + 200).otherwise(F.col("azimuth")), "dip": F.when(F.col("depth") == 150, F.lit(None).cast("double")).otherwise(F.col("dip")), "depth": F.when(F.col("depth") == 250, 200.0).otherwise(F.col("depth"))})
    return _counts(checks.survey_checks(rows))


def dq_duplicates(s: SparkSession, d: str) -> DataFrame:
    return _counts(checks.duplicated(v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b")), ["a", "b"], "collar_duplicate", "collar"))


def dq_framework(s: SparkSession, d: str) -> DataFrame:
    """Every 17th hole without readings, every 19th without a log."""
    survey, litho = v.survey(s, d).where("hole_id % 17 <> 0"), v.litho(s, d).where("hole_id % 19 <> 0")
    return _counts(checks.without_survey(v.collar(s, d), survey).unionByName(checks.without_lithology(v.assay(s, d), litho)))


def dq_placed(s: SparkSession, d: str) -> DataFrame:
    rows = intervals.domain_of_code(intervals.logged_at_middle(v.assay(s, d), v.litho(s, d)), v.lookup(s, d))
    rows = rows.withColumn("x_mid", F.when(F.col("hole_id") % 17 != 0, F.col("from_m")))
    return _counts(checks.placed_checks(rows).unionByName(checks.codes_unmapped(v.litho(s, d), v.lookup(s, d))))


def dq_extent(s: SparkSession, d: str) -> DataFrame:
    return _counts(checks.extent_check(_assigned(s, d).withColumnRenamed("point_id", "hole_id"), 0.05))


def dq_testwork(s: SparkSession, d: str) -> DataFrame:
    """Every 12th record without a depth, and those of every 5th hole in no hole that has samples."""
    k = F.col("_row")
    work = v.testwork(s, d).withColumns({"to_m": F.when(k % 12 != 0, F.col("to_m")), "hole_id": F.when(k % 5 == 0, -k).otherwise(k)})
    rows = intervals.domain_of_code(intervals.logged_at_middle(v.assay(s, d), v.litho(s, d)), v.lookup(s, d)).withColumnRenamed("geomet_domain", "allocation_domain")
    marked = allocate.mark_testwork(intervals.with_interval_ids(rows), work)
    known = s.createDataFrame([("VOLCANIC",), ("SEDIMENT",)], "allocation_domain string")
    return _counts(checks.testwork_checks(work, marked).unionByName(checks.undomained(allocate.testwork_domains(work, rows, known))))


def dq_allocation(s: SparkSession, d: str) -> DataFrame:
    """The things that targets tell: nothing scheduled, no deficit, no grades, no spread, no named domain."""
    tonnage = allocate.domain_tonnage(_labelled(s, d), WEIGHTS)
    flat = tonnage.select("allocation_domain", F.lit(0.0).alias("grade_sd"))
    done = tonnage.select("allocation_domain", F.lit(1000).cast("long").alias("existing"))
    found = [
        checks.allocation_checks(allocate.targets(tonnage.where("tonnes < 0"), TOTAL)), checks.allocation_checks(allocate.targets(tonnage, TOTAL, "proportional", existing=done), "proportional"),
        checks.allocation_checks(allocate.targets(tonnage, TOTAL), dispersion=False), checks.allocation_checks(allocate.targets(tonnage, TOTAL, dispersion=flat, min_samples=1)),
        checks.allocation_checks(allocate.targets(tonnage, TOTAL, "manual", manual={"NOWHERE": 1.0}, min_samples=1), "manual", manual=("NOWHERE",)),
    ]
    return _counts(found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).unionByName(found[4]))


def dq_samples(s: SparkSession, d: str) -> DataFrame:
    """A samples table in which two rows share an id where they have one order."""
    rows = v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"))
    return _counts(checks.inherited(rows))


def unit_mismatch_ratio(s: SparkSession, d: str) -> DataFrame:
    """Vertical intervals: every third in feet, every fourth of the others with depths in feet, the rest right."""
    k = F.col("hole_id")
    factor = F.when(k % 3 == 0, 1 / 0.3048).when(k % 4 == 0, 0.3048).otherwise(1.0)
    zero = F.lit(0.0)
    rows = v.assay(s, d).withColumns({"x_from": zero, "y_from": zero, "x_to": zero, "y_to": zero, "z_from": -F.col("from_m") * factor, "z_to": -F.col("to_m") * factor})
    return checks.unit_ratio(rows).select("which", "rows", _r("median_ratio", 6))


def dq_blocks(s: SparkSession, d: str) -> DataFrame:
    rows = v.blocks(s, d).withColumns({"dx": F.when(F.col("_row") % 50 == 0, 0.0).otherwise(F.col("dx")), "x": F.when(F.col("_row") % 40 == 0, F.col("x") - 40).otherwise(F.col("x"))})
    return _counts(checks.block_checks(rows))


def _texts(s: SparkSession, d: str) -> DataFrame:
    """Values as a file would spell them."""
    k = F.col("event_id") % 12
    cents = F.floor(F.col("value") * 100).cast("string")
    text = F.when(k == 0, "").when(k == 1, "-99.00").when(k == 2, "NA").when(k == 3, "<0.01").when(k == 4, F.concat(F.lit("< "), cents)).when(k == 5, "nan").when(k == 6, "-5").when(k == 7, "1.5d").when(k == 8, F.concat(F.lit(" \t"), cents, F.lit("\t"))).when(k == 9, F.concat(cents, F.lit("e2"))).otherwise(cents)
    return v.table(s, d, "events").select("event_id", text.alias("t"))


PARSE = numbers.ParseRules(null_values=("-99", "na"))


def csv_line_breaks(s: SparkSession, d: str) -> DataFrame:
    """Texts with quotes and line breaks, written as CSV files into a folder of this call's own and read again in parallel."""
    at = f"{shared_dir(s)}/csv-{uuid.uuid4().hex}"
    v.table(s, d, "documents").select("doc_id", "text", "lang").write.csv(at, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = readers.read_text(s, at, "utf-8", True)
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("sha256"))


def project_issues(s: SparkSession, d: str) -> DataFrame:
    """What loading a whole project of CSV files tells."""
    return project.stage_load(s, files.make(s, d)).issues.select("severity", "check", "source", "count")


def project_faults(s: SparkSession, d: str) -> DataFrame:
    """What loading tells of a project with faults of mapping and convention."""
    told = project.stage_load(s, files.make(s, d, True)).issues
    return told.groupBy("severity", "check", "source").agg(F.sum("count").alias("count"))


def dq_geometry(s: SparkSession, d: str) -> DataFrame:
    """Vertical intervals with coordinates of their own: by hole in feet, with depths in feet, shifted, off the middle, incomplete, turned round."""
    k, zero = F.col("hole_id") % 7, F.lit(0.0)
    z = lambda depth: F.when(k == 0, -depth / 0.3048).when(k == 1, -depth * 0.3048).when((k == 5) & (F.col("from_m") >= 50), depth).otherwise(-depth)
    rows = v.assay(s, d).withColumns({
        "x_from": zero, "y_from": zero, "z_from": z(F.col("from_m")), "x_to": F.when(k == 2, 10.0).otherwise(zero), "y_to": zero, "z_to": z(F.col("to_m")),
        "x_mid": F.when(k != 4, zero), "y_mid": zero, "z_mid": z((F.col("from_m") + F.col("to_m")) / 2) + F.when(k == 3, 1.0).otherwise(zero),
    })
    return _counts(checks.geometry_checks(rows))


def _rising(s: SparkSession, d: str, steps: int) -> DataFrame:
    """Ends of vertical holes, of which those with an id that `steps` divides rise."""
    up, zero = F.when(F.col("hole_id") % steps == 0, 1.0).otherwise(-1.0), F.lit(0.0)
    rows = v.assay(s, d).withColumns({"x_from": zero, "y_from": zero, "z_from": up * F.col("from_m"), "x_to": zero, "y_to": zero, "z_to": up * F.col("to_m")})
    return geometry.hole_ends(rows)


def dq_direction(s: SparkSession, d: str) -> DataFrame:
    """Once with every third hole upside down, once with all."""
    return _counts(checks.direction_checks(_rising(s, d, 3)).unionByName(checks.direction_checks(_rising(s, d, 1))))


def candidate_numbers(s: SparkSession, d: str) -> DataFrame:
    return windows.with_candidate_ids(windows.candidates(_usable(s, d), RULES)).select("candidate_id", "hole_id", _r("from_m", 2))


def presented_grades(s: SparkSession, d: str) -> DataFrame:
    """Grades in the units of their side under plain headers."""
    i = F.col("p_partkey")
    rows = v.table(s, d, "part").select(i, (i * 13.7).alias("elem_zn"), (i * 11.3).alias("wtd_zn"), (F.col("p_retailprice") * 50).alias("bm_elem_zn"), F.col("p_brand").alias("bm_attr_rock"), F.lower("p_brand").alias("attr_rock"))
    shown = report.Shown({"zn": "pct"}, {"zn": "oz_t"}, ("rock",))
    return report.present(rows, shown)


def parse_issue_values(s: SparkSession, d: str) -> DataFrame:
    """The five most frequent values of each kind, and the first lines."""
    rows = _texts(s, d).select(F.col("event_id").alias("_row"), "t", numbers.parse_grade(F.col("t"), PARSE).alias("p"))
    return numbers.parse_issues(rows, "assay", {"zn": ("t", "p")}).select("check", "message")


def project_intervals(s: SparkSession, d: str) -> DataFrame:
    """The interval framework of a whole project of CSV files: read, mapped, parsed, cut, coded, placed, put into blocks and massed."""
    rows = project.stage_geometry(project.stage_load(s, files.make(s, d))).tables["intervals"]
    return rows.select(
        "interval_id", F.col("hole_id").cast("bigint").alias("hole_id"), _r("from_m", 2), _r("to_m", 2), "logged_code", "geomet_domain", "low_recovery", _r("elem_Zn", 2), _r("density", 4), "availability", _r("mass_kg", 4),
        _r("x_mid", 2), _r("y_mid", 2), _r("z_mid", 2), "outside_model", "attr_rock", "period", "grade_bin", "allocation_domain")


def windows_same_bin(s: SparkSession, d: str) -> DataFrame:
    """Windows whose grade bin is the most frequent one of their run."""
    edges = (0.0, 20011.0, 60013.0, 200000.0)  # no mean of a window lies on one
    binned = _usable(s, d).withColumn("grade_bin", units.grade_bin(F.col("elem_zn"), edges, v.LABELS))
    found = windows.windows(binned, replace(RULES, same_bin=True, edges=edges))
    return found.groupBy("hole_id", "run_no", "grade_bin").agg(F.count("*").alias("windows"), F.sum("n").cast("long").alias("intervals"))


def parse_numbers(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("event_id", numbers.parse_number(F.col("t"), PARSE).alias("p")).select("event_id", "p.value", "p.state")


def parse_grades(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("event_id", numbers.parse_grade(F.col("t"), PARSE).alias("p")).select("event_id", "p.value", "p.state")


def parse_issues(s: SparkSession, d: str) -> DataFrame:
    rows = _texts(s, d).select(F.col("event_id").alias("_row"), "t", numbers.parse_grade(F.col("t"), PARSE).alias("p"))
    return numbers.parse_issues(rows, "assay", {"zn": ("t", "p")}).select("severity", "check", "count")


def unit_conversions(s: SparkSession, d: str) -> DataFrame:
    x = F.col("p_retailprice")
    return v.table(s, d, "part").select("p_partkey", F.round(units.length_to_metres(x, "ft"), 6).alias("metres"), F.round(units.density_to_t_m3(x, "lb_ft3"), 6).alias("t_m3"), F.round(units.grade_to_ppm(x, "oz_t"), 4).alias("ppm"), F.round(units.ppm_to_units(x, "pct"), 9).alias("pct"), F.round(units.azimuth_to_grid(-x, "true", 12.5), 6).alias("azimuth"), F.round(units.core_area(x / 10), 8).alias("area"))


def period_weights(s: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    label = F.when(size % 4 == 0, size.cast("string")).when(size % 4 == 1, F.concat(size.cast("string"), F.lit(".7"))).when(size % 4 == 2, "LATE")
    return v.table(s, d, "part").select("p_partkey", units.period_weight(label, {"1": 2.0, "4": 1.5, "5": 3.0, "LATE": 0.25}, 1.0).alias("weight"), units.is_scheduled(label, ["late"]).alias("scheduled"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        interval_split, interval_split_lengths, asof_litho_domain, unmapped_codes, sample_ids_suffix, desurvey_stations, desurvey_midpoints, planned_discretise, hole_ends_orientation,
        block_assign_nearest, block_assign_mixed, nearest_neighbours, outside_model_fraction, resolve_attributes, domain_match_rate, grade_bins, allocation_domain_labels, interval_mass_fail_closed, prior_testwork_overlap,
        testwork_modal_domain, existing_coverage, run_segmentation, run_break_reasons, run_summary, short_runs, event_sessions, hot_hole_runs, hot_hole_codes, hot_hole_gaps, candidate_windows, best_window_per_start, domain_tonnage,
        tonnage_by_period, neyman_dispersion, allocation_targets, largest_remainder, greedy_select, pick_list, unmet_gaps, unmet_after_selection, objective_components, targets_proportional_risk, targets_manual,
        dq_framework, dq_placed, dq_extent, dq_testwork, dq_allocation, dq_samples, unit_mismatch_ratio, dq_intervals, dq_orphans, dq_beyond_depth,
        dq_density_range, dq_survey, dq_duplicates, dq_blocks, csv_line_breaks, project_issues, project_faults, project_intervals, dq_geometry, dq_direction, candidate_numbers, presented_grades, parse_issue_values, windows_same_bin, parse_numbers, parse_grades, parse_issues, unit_conversions, period_weights,
    )
    return {f.__name__: f for f in named}
