"""From scheduled tonnage to exact whole sample targets per domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corelode.functions.units import is_scheduled, period_weight
from corelode.operators.joins import overlap_join
from corelode.schema import FROM, HOLE, TO, TOLERANCE

DOMAIN = "allocation_domain"


def domain_tonnage(blocks: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, excluded: Sequence[str] = ()) -> DataFrame:
    """Scheduled tonnes, weighted tonnes and per cent of all tonnes by domain."""
    live = blocks.where(is_scheduled(F.col("period"), excluded) & F.col(DOMAIN).isNotNull())
    out = live.groupBy(DOMAIN).agg(F.sum("tonnes").alias("tonnes"), F.sum(F.col("tonnes") * period_weight(F.col("period"), weights or {}, default_weight)).alias("weighted_tonnes"))
    return out.withColumn("tonnes_pct", 100.0 * F.col("tonnes") / F.sum("tonnes").over(W.partitionBy()))  # a row for each domain


def tonnage_by_period(blocks: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    live = blocks.where(is_scheduled(F.col("period"), excluded) & F.col(DOMAIN).isNotNull() & F.col("period").isNotNull())
    return live.groupBy(DOMAIN, "period").agg(F.sum("tonnes").alias("tonnes"))


def grade_dispersion(blocks: DataFrame, grade: str, excluded: Sequence[str] = ()) -> DataFrame:
    """Population standard deviation of the known block grades by domain."""
    live = blocks.where(is_scheduled(F.col("period"), excluded) & F.col(DOMAIN).isNotNull())
    return live.groupBy(DOMAIN).agg(F.stddev_pop(grade).alias("grade_sd"))


def _mapped(values: dict[str, float], default: float | None) -> Column:
    out = F.lit(None if default is None else float(default)).cast("double")
    for k, v in values.items():
        out = F.when(F.col(DOMAIN) == k, F.lit(float(v))).otherwise(out)
    return out


def largest_remainder(rows: DataFrame, value: str, total: int, into: str, name: str = DOMAIN, zeros: bool = False) -> DataFrame:
    """Whole numbers that add up to `total`: floors, then one more for the largest remainders (ties by name), each domain at most once. With
    `zeros`, values that are all 0 stay 0 instead."""
    everything = W.partitionBy()  # a row for each domain
    low = F.floor(F.col(value))
    short = F.lit(total) - F.sum(low).over(everything)
    rank = F.row_number().over(W.orderBy(F.desc(F.col(value) - low), F.col(name)))
    nothing = F.max(F.abs(F.col(value))).over(everything) == 0
    given = low + (rank <= short).cast("long")
    return rows.withColumn(into, (F.when(nothing, F.lit(0)).otherwise(given) if zeros else given).cast("long"))


def targets(tonnage: DataFrame, total: int, method: str = "neyman", dispersion: DataFrame | None = None, existing: DataFrame | None = None, risk: dict[str, float] | None = None, manual: dict[str, float] | None = None, min_samples: int = 0, min_pct: float = 0.0, zeros: bool = True) -> DataFrame:
    """tonnage plus grade_sd, target_raw, existing, deficit_raw and the whole target and deficit.

    neyman: weighted tonnes x sd x risk, a missing sd being the mean of the others (1 without any); proportional: weighted
    tonnes x risk; manual: the given numbers. A domain of `min_pct` per cent or more gets `min_samples` at least. What exists is taken off and the rest scaled to the
    total again."""
    everything = W.partitionBy()  # a row for each domain
    rows = tonnage.join(dispersion, DOMAIN, "left") if dispersion is not None else tonnage.withColumn("grade_sd", F.lit(None).cast("double"))
    weighted, risky = F.col("weighted_tonnes"), _mapped(risk or {}, 1.0)
    if method == "neyman":
        basis = weighted * F.coalesce("grade_sd", F.avg("grade_sd").over(everything), F.lit(1.0)) * risky
    elif method == "proportional":
        basis = weighted * risky
    elif method == "manual":
        basis = _mapped(manual or {}, 0.0)
    else:
        raise ValueError(f"unknown method {method}")
    rows = rows.withColumn("__basis", basis)
    share = F.lit(float(total)) * F.col("__basis") / F.sum("__basis").over(everything)
    rows = rows.withColumn("target_raw", F.coalesce(F.when(F.sum("__basis").over(everything) > 0, share), F.lit(0.0)))
    rows = rows.withColumn("target_raw", F.when(F.col("tonnes_pct") >= min_pct, F.greatest("target_raw", F.lit(float(min_samples)))).otherwise(F.col("target_raw")))
    rows = rows.join(existing, DOMAIN, "left") if existing is not None else rows.withColumn("existing", F.lit(0).cast("long"))
    rows = rows.withColumn("existing", F.coalesce("existing", F.lit(0).cast("long")))
    rows = rows.withColumn("__short", F.greatest(F.col("target_raw") - F.col("existing"), F.lit(0.0)))
    scaled = F.when(F.sum("__short").over(everything) > 0, F.col("__short") * F.lit(float(total)) / F.sum("__short").over(everything)).otherwise(F.lit(0.0))
    rows = rows.withColumn("deficit_raw", scaled)
    rows = largest_remainder(rows, "target_raw", total, "target", zeros=zeros)
    return largest_remainder(rows, "deficit_raw", total, "deficit", zeros=zeros).drop("__basis", "__short")


def testwork_domains(testwork: DataFrame, intervals: DataFrame, known: DataFrame) -> DataFrame:
    """testwork plus `domain`: its own where that is a known one, else the most frequent of the intervals that it overlaps (no tolerance; ties
    by name). testwork has _row as its key."""
    own = known.select(F.col(DOMAIN).alias("__own")).distinct()
    rows = testwork.join(own, F.col("geomet_domain") == F.col("__own"), "left")
    met = overlap_join(testwork.select("_row", HOLE, FROM, TO), intervals.select(HOLE, FROM, TO, DOMAIN).where(F.col(DOMAIN).isNotNull()))
    modal = met.groupBy(F.col("l._row").alias("__r")).agg(F.mode(F.col(f"r.{DOMAIN}"), True).alias("__modal"))
    out = rows.join(modal, F.col("_row") == F.col("__r"), "left")
    return out.select(*testwork.columns, F.coalesce("__own", "__modal").alias("domain"))


def existing_coverage(placed: DataFrame) -> DataFrame:
    """(allocation_domain, existing) of testwork_domains()."""
    return placed.where("domain is not null").groupBy(F.col("domain").alias(DOMAIN)).agg(F.count("*").alias("existing"))


def mark_testwork(intervals: DataFrame, testwork: DataFrame) -> DataFrame:
    """intervals plus prior_testwork and, in file order, prior_testwork_ids: of the testwork that overlaps by more than the tolerance."""
    met = overlap_join(intervals.select("interval_id", HOLE, FROM, TO), testwork.select("_row", HOLE, FROM, TO, "sample_id"), tolerance=TOLERANCE)
    ids = met.groupBy(F.col("l.interval_id").alias("__i")).agg(F.sort_array(F.collect_list(F.struct("r._row", "r.sample_id"))).alias("t"))
    out = intervals.join(ids, F.col("interval_id") == F.col("__i"), "left")
    return out.select(*intervals.columns, F.col("t").isNotNull().alias("prior_testwork"), F.coalesce(F.col("t.sample_id"), F.array().cast("array<string>")).alias("prior_testwork_ids"))


def unmet(allocation: DataFrame, achieved: DataFrame) -> DataFrame:
    """Domains with fewer selected samples than their deficit."""
    rows = allocation.select(DOMAIN, "deficit").join(achieved, DOMAIN, "left").withColumn("achieved", F.coalesce("achieved", F.lit(0).cast("long")))
    return rows.where("achieved < deficit").withColumn("missing", F.col("deficit") - F.col("achieved"))
