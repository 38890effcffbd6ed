"""A project from configuration to selected samples: lazy tables stage by stage, with a gate on errors between them.

Stages: load, geometry, candidates, allocate, select. A stage's tables are Parquet in the cache folder, if one is given, under a key of
configuration, contents of the inputs and engine version; a later call goes on from the latest stage that is there.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelode import __version__
from corelode.config import Config, digest
from corelode.functions.units import GRADE
from corelode.operators import allocate, blocks, checks, geometry, intervals, runs, scans, select, windows
from corelode.schema import FROM, GAPS, HOLE, ISSUES, TO, block_attribute, block_element, element, hole_attribute, key_column
from corelode.sources import quoted
from corelode.sources.readers import Dataset, load

STAGES = ("load", "geometry", "candidates", "allocate", "select")


class ValidationFailed(RuntimeError):
    """A stage met errors and wasn't forced. issues: all that was told so far."""

    def __init__(self, said: str, issues: DataFrame):
        super().__init__(said)
        self.issues = issues


@dataclass
class State:
    cfg: Config
    data: Dataset
    issues: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    held: list[DataFrame] = field(default_factory=list)
    trace: DataFrame | None = None

    def close(self) -> None:
        """Gives back what run() keeps and load() has parsed."""
        while self.held:
            _released(self.held.pop())
        while self.data.folders:
            target, store = store_of(self.issues.sparkSession, self.data.folders.pop())
            store.delete(target, True)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None


def _settle(state: State, new: DataFrame, force: bool, known: list | None = None) -> list:
    """Issues are a row for each check and source: they are computed once and kept as rows. Errors stop the run unless it is forced."""
    rows = new.collect()
    bad = [r for r in rows if r["severity"] == "ERROR"]
    rows = [*(known or []), *rows]
    state.issues = new.sparkSession.createDataFrame(rows, ISSUES)
    if bad and not force:
        raise ValidationFailed("; ".join(f"{r['source']}: {r['check']} ({r['count']})" for r in bad), state.issues)
    return rows


def _all(issues: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def stage_load(spark: SparkSession, cfg: Config) -> State:
    data = load(spark, cfg)
    t, issues = data.tables, [data.issues]
    if "samples" in t:
        issues += [checks.interval_checks(t["samples"], "samples", cfg.domaining.max_interval_gap_m), checks.density_checks(t["samples"], "samples"), checks.geometry_checks(t["samples"]), checks.inherited(t["samples"])]
    else:
        issues += [checks.duplicated(t["collar"], [HOLE], "collar_duplicate", "collar"), checks.survey_checks(t["survey"]), checks.dip_sign(t["survey"]), checks.density_checks(t["assay"], "assay")]
        issues += [checks.orphans(t[n], t["collar"], n) for n in ("survey", "assay", "litho")]
        issues += [checks.interval_checks(t[n], n, cfg.domaining.max_interval_gap_m) for n in ("assay", "litho")]
        issues += [checks.beyond_depth(t[n], t["collar"], n) for n in ("assay", "litho")]
    issues.append(checks.block_checks(t["block_model"], tuple(cfg.block_model_options.excluded_periods)))
    issues.append(checks.codes_unmapped(t["samples" if "samples" in t else "litho"], t["domain_lookup"]))
    return State(cfg, data, _all(issues))


def _labels(cfg: Config, side: str) -> dict:
    bins = cfg.domaining.grade_bins
    factor = GRADE[getattr(cfg.elements[bins.element], bins.source).units]
    parts = [k if k in ("grade_bin", "period") else block_attribute(k) for k in cfg.domaining.allocation_key]
    return {"bin_on": block_element(bins.element) if side == "blocks" or bins.source == "block_model" else element(bins.element), "edges": [e * factor for e in bins.edges], "labels": bins.labels, "parts": parts}


def stage_geometry(state: State) -> State:
    cfg, t, spark = state.cfg, state.data.tables, state.issues.sparkSession
    roles = list(cfg.attributes)
    logged = tuple(hole_attribute(r) for r in roles if "litho" in t and hole_attribute(r) in t["litho"].columns)
    trace = tasks = None
    if "samples" in t:
        rows = intervals.framework_from_samples(t["samples"], t["domain_lookup"])
    else:
        trace = geometry.traces(t["collar"], t["survey"], cfg.desurvey.fill_collar_survey, scans.hot_keys(t["survey"], HOLE, "depth"))
        hot = scans.hot_keys(t["assay"])
        tasks = None if hot else scans.tasks_for(t["assay"])  # pieces of hot holes are dealt on their own
        rows = intervals.build_framework(t["assay"].drop("_row"), t["litho"], t["domain_lookup"], logged, hot, tasks)
        rows = geometry.with_coordinates(rows, trace, hot=hot, tasks=tasks, dealt=True)
    rows = rows.withColumn("is_planned", F.lit(False))
    if "planned_collar" in t:
        planned = geometry.traces(t["planned_collar"], t["planned_survey"], cfg.desurvey.fill_collar_survey)
        rows = rows.unionByName(_planned(planned, cfg), allowMissingColumns=True)
        trace = trace.unionByName(planned) if trace is not None else planned
    # While rows are dealt by hole, and before they are dealt by place.
    none = spark.createDataFrame([], f"{HOLE} string, availability string, core_diameter_mm double, remaining_fraction double")
    before = rows.columns
    rows = blocks.with_core(rows, t.get("availability", none), cfg.mass.default_core_diameter_mm, cfg.mass.default_remaining_fraction)
    core = [c for c in rows.columns if c not in before]
    model = blocks.label_rows(t["block_model"], **_labels(cfg, "blocks"))
    carry = ["period", "bm_density", *(c for c in model.columns if c.startswith(("bm_attr_", "bm_elem_")))]
    rows = blocks.nearest_block(rows, model.withColumnRenamed("density", "bm_density"), carry, tasks=tasks)
    if cfg.block_model_options.planned_grade_source == "block_model":
        grades = [(element(k), block_element(k)) for k, e in cfg.elements.items() if e.drillhole and e.block_model]
        rows = rows.withColumns({a: F.when(F.col("is_planned"), F.coalesce(a, b)).otherwise(F.col(a)) for a, b in grades})
    pairs = [(hole_attribute(r), block_attribute(r)) for r in roles if hole_attribute(r) in rows.columns and block_attribute(r) in rows.columns]
    if m := cfg.domaining.domain_match_attribute:
        pairs.append(("geomet_domain", block_attribute(m)))
    rows = blocks.resolve_attributes(blocks.domain_match(rows, pairs), roles)
    rows = blocks.label_rows(rows, **_labels(cfg, "intervals"))
    rows = rows.select(*(c for c in rows.columns if c not in core), *core)
    density = (cfg.sources.samples or cfg.sources.assay).density
    rows = blocks.with_mass(rows, cfg.mass.loss_factor, density.fallback_constant if density else None)
    if "existing_testwork" in t:
        rows = allocate.mark_testwork(rows, t["existing_testwork"])
        if cfg.mass.prior_testwork_core == "available":
            rows = rows.withColumn("prior_testwork", F.lit(False))
    state.tables |= {"intervals": rows, "blocks": model}
    state.trace = trace
    return state


def _planned(trace: DataFrame, cfg: Config) -> DataFrame:
    """Planned holes in whole steps along their traces, whose last station is the deepest reading or the total depth."""
    depth = trace.groupBy(HOLE).agg(F.max("depth").alias("total_depth"))
    steps = intervals.discretise(depth, cfg.block_model_options.planned_discretisation_m)
    placed = geometry.with_coordinates(steps, trace)
    name = F.concat(F.col(HOLE), F.lit("_PLAN_"), F.format_string("%.2f", F.col(FROM)))
    return placed.withColumns({"sample_id": name, "parent_sample_id": name, "interval_id": name, "is_planned": F.lit(True)})


def hold(state: State, *names: str) -> None:
    """Computes tables that several later stages read; close() gives them back."""
    for k in names:
        state.tables[k] = _held(state.tables[k])
        state.held.append(state.tables[k])


def geometry_issues(state: State) -> DataFrame:
    """Also adds the holes' ends, which rest on the intervals as they are held by now."""
    state.tables["hole_ends"] = geometry.hole_ends(state.tables["intervals"], state.trace)
    rows, t = state.tables["intervals"], state.data.tables
    found = [checks.placed_checks(rows), checks.extent_check(rows, state.cfg.block_model_options.off_model_error_fraction)]
    found += [checks.direction_checks(state.tables["hole_ends"]), checks.empty(state.tables["blocks"], "block_model", "block_model_empty", "WARN", "no blocks: every interval lies outside")]
    found += [checks.without_survey(t[c], t[s]) for c, s in (("collar", "survey"), ("planned_collar", "planned_survey")) if c in t and s in t]
    if "litho" in t:
        found.append(checks.without_lithology(t["assay"], t["litho"]))
    if "existing_testwork" in t:
        found.append(checks.testwork_checks(t["existing_testwork"], rows, state.cfg.mass.prior_testwork_core == "exclude"))
    return _all(found)


def window_rules(cfg: Config) -> windows.WindowRules:
    c, bins = cfg.compositing, _labels(cfg, "intervals")
    parts = [p for p in bins["parts"] if p != "grade_bin"]
    return windows.WindowRules(
        c.min_length_m, c.max_length_m, c.target_mass_kg, c.min_mass_kg, element(cfg.primary), tuple(element(k) for k, e in cfg.elements.items() if e.drillhole and k != cfg.primary), tuple(bins["edges"]), tuple(bins["labels"]),
        c.max_cv_primary, c.require_grade_bin_match, cfg.selection.mass_margin_cap, cfg.selection.domain_mismatch_factor, tuple(dict.fromkeys([*parts, "geomet_domain", "period"])), tuple(bins["parts"]),
    )


def break_rules(cfg: Config) -> runs.BreakRules:
    d = cfg.domaining
    return runs.BreakRules(d.max_interval_gap_m, tuple((k, key_column(k)) for k in d.hard_break_on), d.break_on_low_recovery, element(cfg.primary) if d.break_on_missing_primary_grade else None)


def stage_candidates(state: State) -> State:
    cfg = state.cfg
    hot = scans.hot_keys(state.tables["intervals"])
    rows = runs.with_run_ids(runs.segment_runs(state.tables["intervals"], break_rules(cfg), (FROM, TO, "interval_id"), hot))
    summary = runs.summarise_runs(rows, ("run_id", "geomet_domain"))
    usable = rows.where("usable and availability <> 'UNAVAILABLE'")
    best = _held(windows.candidates(usable, window_rules(cfg)))  # read for the numbers of all holes, then for the rows
    state.held.append(best)
    found = windows.with_candidate_ids(best, hot)
    short = runs.short_runs(summary, cfg.compositing.min_length_m, cfg.compositing.min_mass_kg)
    gone = rows.where("availability = 'UNAVAILABLE'").groupBy(HOLE).agg(F.count("*").alias("n"))
    gaps = short.select(F.lit("run").alias("scope"), F.col("run_id").alias("key"), "reason", F.create_map(F.lit("hole_id"), F.col(HOLE).cast("string"), F.lit("length_m"), F.round("length_m", 3).cast("string")).alias("detail"))
    gaps = gaps.unionByName(gone.select(F.lit("hole").alias("scope"), F.col(HOLE).cast("string").alias("key"), F.lit("core_unavailable").alias("reason"), F.create_map(F.lit("intervals"), F.col("n").cast("string")).alias("detail")))
    if "prior_testwork" in rows.columns:
        used = rows.where("prior_testwork and availability <> 'UNAVAILABLE'").groupBy(HOLE).agg(F.count("*").alias("n"))
        gaps = gaps.unionByName(used.select(F.lit("hole").alias("scope"), F.col(HOLE).cast("string").alias("key"), F.lit("prior_testwork").alias("reason"), F.create_map(F.lit("intervals"), F.col("n").cast("string")).alias("detail")))
    state.tables |= {"runs": rows, "run_summary": summary, "candidates": found, "gaps": gaps}
    return state


def stage_allocate(state: State) -> State:
    cfg, model = state.cfg, state.tables["blocks"]
    a, excluded = cfg.allocation, cfg.block_model_options.excluded_periods
    tonnage = allocate.domain_tonnage(model, a.label_weights, a.default_weight, excluded)
    grade = block_element(cfg.primary)
    spread = allocate.grade_dispersion(model, grade, excluded) if a.method == "neyman" and grade in model.columns else None
    existing = None
    if "existing_testwork" in state.data.tables:
        placed = allocate.testwork_domains(state.data.tables["existing_testwork"], state.tables["intervals"], tonnage.select(allocate.DOMAIN))
        existing = allocate.existing_coverage(placed)
        state.tables["testwork"] = placed
    state.tables |= {"tonnage": tonnage, "tonnage_by_period": allocate.tonnage_by_period(model, excluded)}
    state.tables["allocation"] = allocate.targets(tonnage, a.total_samples, a.method, spread, existing, a.risk_multipliers, a.manual_targets, a.min_samples_per_domain, a.min_domain_tonnage_pct, cfg.zero_targets_without_deficit)
    return state


def allocation_issues(state: State) -> DataFrame:
    a, t = state.cfg.allocation, state.tables
    found = checks.allocation_checks(t["allocation"], a.method, block_element(state.cfg.primary) in t["blocks"].columns, tuple(a.manual_targets))
    return found.unionByName(checks.undomained(t["testwork"])) if "testwork" in t else found


def selection_issues(state: State) -> DataFrame:
    return checks.selection_checks(state.tables["candidates"], state.tables["allocation"], state.tables["selected"])


def stage_select(state: State) -> State:
    s, a = state.cfg.selection, state.cfg.allocation
    w = s.objective_weights
    rules = select.SelectRules(s.max_samples_per_hole, s.min_separation_m, s.swap_iterations, s.random_seed, s.planned_penalty, w.allocation, w.separation, w.cv, w.match)
    picked = select.greedy_select(state.tables["candidates"], state.tables["allocation"], rules, a.label_weights, a.default_weight)
    short = allocate.unmet(state.tables["allocation"], select.achieved(picked))
    more = short.select(F.lit("domain").alias("scope"), F.col(allocate.DOMAIN).alias("key"), F.lit("deficit_unmet").alias("reason"), F.create_map(F.lit("missing"), F.col("missing").cast("string")).alias("detail"))
    grades = [c for c in state.tables["runs"].columns if c.startswith("elem_")]
    state.tables |= {"selected": picked, "picks": windows.pick_list(picked, state.tables["runs"], ["sample_id", *grades]), "gaps": state.tables["gaps"].unionByName(more), "objective": select.objective_parts(picked, state.tables["allocation"], rules)}
    return state


def run(spark: SparkSession, cfg: Config, through: str = "select", force: bool = False, cache: str | None = None) -> State:
    """The state after `through`. With a cache folder each stage's tables are written there, read back, and found by the next call."""
    if through not in STAGES:
        raise ValueError(f"no stage {through}")
    state = stage_load(spark, cfg)
    try:
        known = _settle(state, state.issues, force)
    except ValidationFailed:
        state.close()
        raise
    key = run_key(spark, cfg) if cache else ""
    for name, stage in (("geometry", stage_geometry), ("candidates", stage_candidates), ("allocate", stage_allocate), ("select", stage_select)):
        if STAGES.index(name) > STAGES.index(through):
            break
        before = dict(state.tables)
        state = stage(state)
        if cache:
            for k, t in state.tables.items():
                if before.get(k) is not t:
                    state.tables[k] = _kept(spark, t, f"{cache}/{key}/{name}/{k}")
        if not cache and name in HOLDS:
            hold(state, *HOLDS[name])
        if name in TELLS:
            try:
                known = _settle(state, TELLS[name](state), force or name != "geometry", known)
            except ValidationFailed:
                state.close()
                raise
    return state


HOLDS = {"geometry": ("intervals",), "candidates": ("candidates",), "select": ("selected",)}
TELLS = {"geometry": geometry_issues, "allocate": allocation_issues, "select": selection_issues}


def _held(t: DataFrame) -> DataFrame:
    """t, computed once: in the shared checkpoint folder, where the session has one, which also cuts the plan short; else in memory."""
    return t.checkpoint() if t.sparkSession.sparkContext.getCheckpointDir() else t.persist()


def _released(t: DataFrame) -> None:
    plan = t._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        t.unpersist()
        return
    path = plan.rdd().getCheckpointFile()
    if path.isDefined():
        target, store = store_of(t.sparkSession, path.get())
        store.delete(target, True)


def store_of(spark: SparkSession, path: str):
    """The path as Hadoop knows it, and its file system."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(sc._jsc.hadoopConfiguration())


#: Prime modulus and base of the order-sensitive sum of line digests.
MODULUS, BASE = (1 << 127) - 1, 0x2545F4914F6CDD1D9E3779B97F4A7C15 % ((1 << 127) - 1)


def _digests(batches):
    """(file, block, n, h): of each split the number of its lines and the sum of their digests times BASE to the power of their place."""
    found: dict[tuple[str, int], list[int]] = {}
    for b in batches:
        for file, block, line in zip(*(b.column(c).to_pylist() for c in ("file", "block", "line")), strict=True):
            mine = found.setdefault((file, block), [0, 0, 1])
            mine[1] = (mine[1] + int.from_bytes(hashlib.sha256(line).digest()[:16], "big") * mine[2]) % MODULUS
            mine[0], mine[2] = mine[0] + 1, mine[2] * BASE % MODULUS
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found]), pa.array([k[1] for k in found], pa.int64()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([str(v[1]) for v in found.values()])], names=["file", "block", "n", "h"])


def content_key(spark: SparkSession, path: str) -> str:
    """Of what a source holds, in any store: names, lengths and contents of its files. Each split digests its own lines, in its task; the driver gets a row a
    split and puts them together in order, so the key is the same however the files are split."""
    rows = quoted.lines(spark, path).mapInArrow(_digests, "file string, block long, n long, h string").collect()
    p, store = store_of(spark, path)
    base, files, said = store.makeQualified(p).toString(), store.listFiles(p, True), {}
    while files.hasNext():
        f = files.next()
        said[unquote(f.getPath().toString()).removeprefix(base)] = [f.getLen(), 0, 0]
    for r in sorted(rows):
        mine = said.setdefault(unquote(r["file"]).replace("file:///", "file:/").removeprefix(base), [0, 0, 0])
        mine[1:] = mine[1] + r["n"], (mine[2] + int(r["h"]) * pow(BASE, mine[1], MODULUS)) % MODULUS
    return digest("\n".join(f"{k}:{v}" for k, v in sorted(said.items()) if not k.rpartition("/")[2].startswith((".", "_"))))


def run_key(spark: SparkSession, cfg: Config) -> str:
    """Of configuration, inputs and engine: another content under the same name gives another key."""
    named = {k: getattr(cfg.sources, k) for k in type(cfg.sources).model_fields}
    return digest(cfg.model_dump_json() + __version__ + ";".join(f"{k}={content_key(spark, cfg.path(s.path))}" for k, s in named.items() if s))


def _kept(spark: SparkSession, t: DataFrame, path: str) -> DataFrame:
    """The table at path; where it isn't there whole it is written aside and moved there, so a broken write leaves nothing that counts."""
    done, store = store_of(spark, f"{path}/_SUCCESS")
    if not store.exists(done):
        aside = f"{path}.{uuid.uuid4().hex}"
        t.write.parquet(aside)
        target, _ = store_of(spark, path)
        store.delete(target, True)
        if not store.rename(store_of(spark, aside)[0], target) and not store.exists(done):
            raise OSError(f"{aside} can't be moved to {path}")
    return spark.read.schema(t.schema).parquet(path)


def checked(spark: SparkSession, cfg: Config) -> State:
    """The state with all issues, and the holes' ends; geometry is left out, and that told, where loading met errors. The caller closes it."""
    state = stage_load(spark, cfg)
    known = _settle(state, state.issues, True)
    if any(r["severity"] == "ERROR" for r in known):
        skipped = spark.createDataFrame([("INFO", "geometry_checks_skipped", "geometry", None, 1, "loading met errors", {})], ISSUES)
        state.issues = state.issues.unionByName(skipped)
        return state
    state = stage_geometry(state)
    hold(state, "intervals")
    _settle(state, geometry_issues(state), True, known)
    return state


def validate(spark: SparkSession, cfg: Config) -> DataFrame:
    """All issues in order."""
    state = checked(spark, cfg)
    state.close()
    return checks.ordered(state.issues)


__all__ = ["FROM", "GAPS", "TO", "State", "ValidationFailed", "checked", "run", "validate"]
