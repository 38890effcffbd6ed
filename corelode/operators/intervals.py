"""The interval framework: assay intervals cut at lithology contacts, with codes and domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corelode.operators.joins import asof_join, small, split_intervals
from corelode.operators.scans import HotKeys, cleaned
from corelode.schema import FROM, HOLE, LENGTH, TO, TOLERANCE


def contacts(litho: DataFrame) -> DataFrame:
    """(hole_id, at_m): every start and end of a logged interval."""
    return litho.select(HOLE, F.explode(F.array(FROM, TO)).alias("at_m")).where("at_m is not null").distinct()


def logged_at_middle(intervals: DataFrame, litho: DataFrame, carry: tuple[str, ...] = ("logged_code",), hot: HotKeys | None = None, tasks: int | None = None, dealt: bool = False) -> DataFrame:
    """`carry` columns of the last logged interval that begins at or before the middle, where that interval reaches beyond it. There is
    no second choice: an earlier interval that also covers the middle isn't looked for."""
    middle = (F.col(FROM) + F.col(TO)) / 2
    fresh = [c for c in carry if c not in intervals.columns]
    out = asof_join(intervals, litho, HOLE, middle, F.col(FROM), [TO, *fresh], [F.col(TO)], "__log", hot, tasks, dealt)
    valid = middle < F.col(f"__log.{TO}")
    return out.select(*intervals.columns, *(F.when(valid, F.col(f"__log.{c}")).alias(c) for c in fresh))


def domain_of_code(intervals: DataFrame, lookup: DataFrame) -> DataFrame:
    """Left lookup of geomet_domain; codes that aren't there leave null. The first row of a code counts (callers dedupe by file order)."""
    few = small(lookup.select(F.col("logged_code").alias("__code"), "geomet_domain"))  # a shuffle by code would deal all rows to a few tasks
    return intervals.join(few, F.col("logged_code") == F.col("__code"), "left").drop("__code")


def unmapped_codes(intervals: DataFrame, lookup: DataFrame) -> DataFrame:
    used = intervals.where("logged_code is not null").groupBy("logged_code").agg(F.count("*").alias("n"))
    return used.join(lookup.select("logged_code"), "logged_code", "left_anti")


def with_interval_ids(intervals: DataFrame, parent: str = "sample_id", by: tuple[str, ...] = ()) -> DataFrame:
    """interval_id: the parent's id, with _1, _2, ... in (hole, from) order where the parent occurs more than once. Rows that differ in `by` have no parent in
    common: those that are dealt by it stay where they are."""
    same = W.partitionBy(*by, parent)
    k = F.row_number().over(same.orderBy(HOLE, FROM, TO))
    return intervals.withColumn("interval_id", F.when(F.count("*").over(same) > 1, F.concat_ws("_", parent, k.cast("string"))).otherwise(F.col(parent)))


def one_each(rows: DataFrame, key: str) -> bool:
    """Whether no two rows have one key. Hashes are counted; two keys with one hash, or two rows without a key, count as one key."""
    with cleaned(rows.sparkSession):
        return rows.groupBy(F.xxhash64(key).alias("__k")).agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0


def build_framework(assay: DataFrame, litho: DataFrame, lookup: DataFrame, attributes: tuple[str, ...] = (), hot: HotKeys | None = None, tasks: int | None = None) -> DataFrame:
    """With `tasks` rows are dealt to as many by hole once, where holes have few contacts and ids tell rows apart, and leave so: what follows along holes needs no
    exchange of its own."""
    cut = split_intervals(assay, contacts(litho), tasks=tasks)
    alone = (HOLE,) if tasks and one_each(assay, "sample_id") else ()
    named = with_interval_ids(cut.withColumn("parent_sample_id", F.col("sample_id")), "parent_sample_id", alone)
    coded = logged_at_middle(named, litho, ("logged_code", *attributes), hot, tasks, bool(alone))
    ids = ["parent_sample_id", "interval_id"]
    coded = coded.select(*(c for c in coded.columns if c not in ids), *ids)
    return domain_of_code(coded, lookup).withColumn(LENGTH, F.col(TO) - F.col(FROM))


def framework_from_samples(samples: DataFrame, lookup: DataFrame) -> DataFrame:
    """Samples that carry their own coordinates aren't cut."""
    named = with_interval_ids(samples.withColumn("parent_sample_id", F.col("sample_id")), "parent_sample_id")
    return domain_of_code(named, lookup).withColumn(LENGTH, F.col(TO) - F.col(FROM)).where(F.col(LENGTH) > TOLERANCE)


def discretise(holes: DataFrame, step_m: float) -> DataFrame:
    """Whole steps of each (hole_id, total_depth); the rest at the end is dropped."""
    steps = F.floor((F.col("total_depth") + TOLERANCE) / F.lit(step_m)).cast("int")
    ks = F.when(steps >= 1, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>"))
    out = holes.select(HOLE, F.explode(ks).alias("k"))
    return out.select(HOLE, (F.col("k") * F.lit(step_m)).alias(FROM), ((F.col("k") + 1) * F.lit(step_m)).alias(TO), F.lit(step_m).alias(LENGTH))
