"""Which unbroken stretches of core can make a sample, and why the others can't: a register of runs by project.

Reads assay intervals, the lithology log and the holes; cuts the intervals at logged contacts, gives them domains and masses, breaks holes
into runs and judges each run. Writes

    <output>/runs    Parquet, partitioned by project: a row for each run
    <output>/issues  JSON: what is wrong with the assay's depths, of the projects that were computed, partitioned by project

Partitions are overwritten one by one, so a rerun gives the same files' content, and one for some projects leaves the others as they are. A project
whose holes are gone keeps its last partition.

    python -m jobs.run_register --input DIR --output DIR [--config FILE]
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelode.operators import blocks, checks, intervals, joins, runs, scans
from corelode.schema import FROM, HOLE, LENGTH, TO
from jobs.common import arguments, counted, dealt_to, log, read_config, session, source

CONFIG = Path(__file__).with_suffix(".yaml")
RUNS = "hole_id bigint, run_no bigint, from_m double, to_m double, length_m double, intervals bigint, mass_kg double, geomet_domain string, break_reason string, verdict string, project string"


def of_projects(rows: DataFrame, holes: DataFrame) -> DataFrame:
    return rows.join(joins.small(holes.select(HOLE, "project")), HOLE)


def judged(summary: DataFrame, min_length: float, min_mass: float) -> DataFrame:
    """`verdict`: sample, or the first reason why a run can't be one."""
    reasons = F.when(~F.col("usable"), "unusable").when(F.col("availability") == "UNAVAILABLE", "unavailable")
    reasons = reasons.when(F.col(LENGTH) < min_length, "run_too_short").when(F.coalesce(F.col("mass_kg"), F.lit(0.0)) < min_mass, "run_too_light")
    return summary.withColumn("verdict", reasons.otherwise("sample"))


def register(assay: DataFrame, litho: DataFrame, holes: DataFrame, lookup: DataFrame, cfg: dict) -> DataFrame:
    hot = scans.hot_keys(assay)
    cut = joins.split_intervals(assay, intervals.contacts(litho)).withColumn(LENGTH, F.col(TO) - F.col(FROM))
    named = intervals.domain_of_code(intervals.logged_at_middle(cut, litho, hot=hot), lookup)
    massed = blocks.with_mass(blocks.with_core(named, holes, cfg["core_diameter_mm"], cfg["remaining_fraction"]), cfg["loss"], cfg["density"])
    found = runs.segment_runs(massed, runs.BreakRules(cfg["max_gap_m"], (("geomet_domain", "geomet_domain"),), primary_grade=cfg["primary_grade"]), (FROM, TO, "sample_id"), hot)
    # The project is the hole's, so it takes part in no exchange of its own.
    return judged(runs.summarise_runs(found, ("geomet_domain", "availability", "project")), cfg["min_length_m"], cfg["min_mass_kg"])


def run(spark: SparkSession, input_path: str, output_path: str, cfg: dict) -> dict[str, int]:
    """Computes and writes the register; returns the rows read and written. A large table is dealt to more tasks, so that none spills."""
    with dealt_to(spark, scans.tasks_for(source(spark, input_path, cfg["sources"]["assay"]))):
        return _run(spark, input_path, output_path, cfg)


def _run(spark: SparkSession, input_path: str, output_path: str, cfg: dict) -> dict[str, int]:
    holes = source(spark, input_path, cfg["sources"]["holes"])
    if cfg.get("projects"):
        holes = holes.where(F.col("project").isin(list(cfg["projects"])))
    assay, read = counted(source(spark, input_path, cfg["sources"]["assay"]), "assay")
    litho, logged = counted(source(spark, input_path, cfg["sources"]["litho"]), "litho")
    lookup = spark.createDataFrame(sorted(cfg["domains"].items()), "logged_code string, geomet_domain string")
    mine = of_projects(assay, holes)
    rows = register(mine, litho, holes, lookup, cfg)
    names = [c.split()[0] for c in RUNS.split(", ")]
    rows, wrote = counted(rows.select(*names), "runs")
    dealt = rows.repartition(F.col("project"), F.pmod(F.hash(HOLE), F.lit(int(cfg["files_per_project"]))))
    dealt.sortWithinPartitions("project", HOLE, "run_no").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(f"{output_path}/runs")
    told, issues = counted(depth_issues(of_projects(source(spark, input_path, cfg["sources"]["assay"]), holes)), "issues")
    told.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").json(f"{output_path}/issues")
    figures = {"assay": read.get["rows"], "litho": logged.get["rows"], "runs": wrote.get["rows"], "issues": issues.get["rows"]}
    log.info("read %(assay)d assay intervals and %(litho)d logged ones; wrote %(runs)d runs and %(issues)d issues", figures)
    return figures


def depth_issues(assay: DataFrame) -> DataFrame:
    """(project, check, count) of rows whose depths are missing or in the wrong order, and of densities out of range; a row for each project and check."""
    wrong = {
        "interval_depth_missing": F.col(FROM).isNull() | F.col(TO).isNull(), "interval_order": F.col(FROM) >= F.col(TO), "density_missing": F.col("density").isNull(),
        "density_range": ~F.col("density").between(*checks.DENSITY_RANGE), "low_recovery": F.col("low_recovery"),
    }
    told = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in wrong.items())), lambda x: x.isNotNull())
    return assay.select("project", F.explode(told).alias("check")).groupBy("project", "check").agg(F.count("*").alias("count"))


def main(argv: list[str] | None = None) -> None:
    a = arguments(__doc__, CONFIG, argv=argv)
    spark = session("run_register")
    try:
        run(spark, a.input, a.output, read_config(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
