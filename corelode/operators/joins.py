"""Joins along an ordered axis: as-of, overlap, split.

as-of: both sides are sorted together once by (key, position) and the last row of the right side is carried forward, so there is one
exchange and no pair is tried. overlap: both sides are filed under buckets of the axis and joined by (key, bucket), so a key with very
many rows is dealt over its buckets; a pair shows in the bucket of its later start only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelode.operators.scans import HotKeys, cleaned, scanned
from corelode.schema import FROM, HOLE, TO, TOLERANCE


#: Rows up to which a lookup table is sent to all executors.
SMALL = 100_000


def shuffled(rows: DataFrame) -> DataFrame:
    """rows for a join by shuffle. Spark guesses sizes from files: what an explode makes of few bytes, or lists that shrink in an exchange, it would take for small
    and send over the driver."""
    return rows.hint("merge")


def small(rows: DataFrame, most: int = SMALL) -> DataFrame:
    """rows with a broadcast hint if they are `most` at most, which a count that stops beyond it tells; else a join shuffles."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else shuffled(rows)


def asof_join(left: DataFrame, right: DataFrame, by: str, left_on: Column, right_on: Column, carry: list[str], tie: list[Column] = (), into: str = "asof", hot: HotKeys | None = None, tasks: int | None = None, dealt: bool = False) -> DataFrame:
    """left plus a struct `into` of the `carry` columns of the last right row with the same key whose position isn't over that of the left row; of
    equal positions the last by `tie`. Null where there is none or a position is null. Keys in `hot`, cut along either side's positions, go in pieces. Rows are
    dealt to `tasks`, else to shuffle partitions; left rows that an as-of join has `dealt` to as many by the same key stay where they are."""
    kept = F.struct(*(F.col(c) for c in left.columns))
    n = len(tie)
    ties = [c.alias(f"__t{i}") for i, c in enumerate(tie)]
    found = right.where(right_on.isNotNull()).select(F.col(by).alias("__by"), right_on.alias("__at"), F.lit(0).alias("__side"), *ties, F.lit(None).cast(left.select(kept.alias("k")).schema["k"].dataType).alias("__left"), F.struct(*(F.col(c) for c in carry)).alias("__right"))
    blank = [F.lit(None).cast(found.schema[f"__t{i}"].dataType).alias(f"__t{i}") for i in range(n)]
    asked = left.select(F.col(by).alias("__by"), left_on.alias("__at"), F.lit(1).alias("__side"), *blank, kept.alias("__left"), F.lit(None).cast(found.schema["__right"].dataType).alias("__right"))
    alone = bool(tasks and dealt)
    met = (found.repartition(tasks, "__by") if alone else found).unionByName(asked)
    both = scanned(met.repartition(tasks, "__by") if tasks and not alone else met, "__by", ["__at", "__side", *(f"__t{i}" for i in range(n))], hot, **{into: ("known", F.col("__right"))})
    # The key comes from the window's own column, so that what follows knows how the rows are dealt and sorts them no more.
    own = [F.col("__by").alias(c) if c == by else F.col(f"__left.{c}") for c in left.columns]
    return both.where("__side = 1").select(*own, F.when(F.col("__at").isNotNull() & F.col("__by").isNotNull(), F.col(into)).alias(into))


def _buckets(start: Column, end: Column, width: float) -> Column:
    low, high = F.floor(start / width), F.floor(end / width)
    return F.explode(F.sequence(low, F.greatest(low, high)))


def overlap_join(left: DataFrame, right: DataFrame, by: str = HOLE, left_span: tuple[str, str] = (FROM, TO), right_span: tuple[str, str] = (FROM, TO), tolerance: float = 0.0, width: float = 64.0) -> DataFrame:
    """Pairs (struct `l`, struct `r`) with the same key for which r.end > l.start + tolerance and r.start < l.end - tolerance. Rows with a null or
    reversed span take no part."""
    (ls, le), (rs, re_) = left_span, right_span
    good = lambda d, s, e: d.where(F.col(s).isNotNull() & F.col(e).isNotNull() & (F.col(e) >= F.col(s)))
    a = good(left, ls, le).select(F.col(by).alias("__by"), F.struct("*").alias("l"), _buckets(F.col(ls), F.col(le), width).alias("__b"))
    b = good(right, rs, re_).select(F.col(by).alias("__by"), F.struct("*").alias("r"), _buckets(F.col(rs), F.col(re_), width).alias("__b"))
    l0, l1, r0, r1 = F.col(f"l.{ls}"), F.col(f"l.{le}"), F.col(f"r.{rs}"), F.col(f"r.{re_}")
    met = (r1 > l0 + tolerance) & (r0 < l1 - tolerance) & (F.floor(F.greatest(l0, r0) / width) == F.col("__b"))
    return a.join(b, ["__by", "__b"]).where(met).select("l", "r")


#: Width of the finest nodes of the axis; each level's are twice as wide as those of the one below.
FINEST, LEVELS = 64.0, 60


def _level(size: Column) -> Column:
    """The lowest level whose nodes are as wide as `size`."""
    k = F.least(F.greatest(F.ceil(F.log2(size / FINEST)), F.lit(0)), F.lit(LEVELS))
    return F.when(size > FINEST * F.pow(F.lit(2.0), k), F.least(k + 1, F.lit(LEVELS))).otherwise(k).cast("int")


def _node(at: Column, level: Column) -> Column:
    return F.floor(at / (FINEST * F.pow(F.lit(2.0), level)))


def _filed(boundaries: DataFrame, asked: DataFrame, at: str, by: str) -> DataFrame:
    """(key, level, node, cuts): for each node that is asked for, its boundaries and those of the next node, in order."""
    levels = asked.agg(F.collect_set("__ic").alias("k")).scalar()  # LEVELS at most, one or two as a rule
    rows = boundaries.where(F.col(at).isNotNull()).select(F.col(by).alias("__by"), F.col(at).alias("__at"), F.explode(levels).alias("__c"))
    here = _node(F.col("__at"), F.col("__c"))
    rows = rows.select("__by", "__at", "__c", F.explode(F.array(here, here - 1)).alias("__b"))
    nodes = asked.distinct()
    wanted = rows.join(nodes, (F.col("__by") == F.col("__ik")) & (F.col("__c") == F.col("__ic")) & (F.col("__b") == F.col("__ib")), "left_semi")
    return wanted.groupBy("__by", "__c", "__b").agg(F.sort_array(F.collect_set("__at")).alias("__cuts"))


#: Boundaries of a key that each of its intervals may look through.
BRIEF = 256


def brief(boundaries: DataFrame, by: str = HOLE) -> bool:
    """Whether no key has more than BRIEF boundaries."""
    with cleaned(boundaries.sparkSession):
        return (boundaries.groupBy(by).agg(F.count("*").alias("n")).agg(F.max("n")).collect()[0][0] or 0) <= BRIEF


def split_intervals(intervals: DataFrame, boundaries: DataFrame, at: str = "at_m", by: str = HOLE, start: str = FROM, end: str = TO, tolerance: float = TOLERANCE, tasks: int | None = None) -> DataFrame:
    """Each interval cut at the boundaries of its key that lie inside by more than `tolerance`; other columns are copied. Spans that are
    null or not longer than the tolerance are dropped after the cut.

    The axis is a dyadic tree. An interval meets one row only: the boundaries in the node where it begins, of the level whose nodes are as wide as
    itself, and in the next. So work follows an interval's length, not its key's, and a hot key is dealt over its nodes. A boundary is filed only in
    nodes that some interval asks for: none gathers a key's boundaries but for an interval as long as they reach. A null key has no boundaries. With `tasks` rows are dealt to
    as many by key and stay so, where no key has more than BRIEF boundaries: an interval then meets all of its key's."""
    lo, hi = F.col(start), F.col(end)
    size = hi - lo
    out = intervals.where(size > tolerance)
    if tasks and brief(boundaries, by):
        known = boundaries.where(F.col(at).isNotNull()).withColumnRenamed(by, "__by").repartition(tasks, "__by")  # else Spark deals both sides anew
        filed = known.groupBy("__by").agg(F.sort_array(F.collect_set(at)).alias("__cuts"))
        out = out.repartition(tasks, by).join(shuffled(filed), F.col(by) == F.col("__by"), "left")
    else:
        out = out.withColumn("__ic", _level(size)).withColumn("__ib", _node(lo, F.col("__ic")))
        filed = _filed(boundaries, out.select(F.col(by).alias("__ik"), "__ic", "__ib"), at, by)
        out = out.join(filed, (F.col(by) == F.col("__by")) & (F.col("__ic") == F.col("__c")) & (F.col("__ib") == F.col("__b")), "left")
    inside = F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda x: (x > lo + tolerance) & (x < hi - tolerance))
    edges = F.concat(F.array(lo), inside, F.array(hi))
    out = out.withColumn("__edges", edges)
    pieces = F.transform(F.sequence(F.lit(1), F.size("__edges") - 1), lambda k: F.struct(F.get("__edges", k - 1).alias("a"), F.get("__edges", k).alias("b")))
    out = out.withColumn("__piece", F.explode(pieces))
    cols = [F.col("__piece.a").alias(start) if x == start else F.col("__piece.b").alias(end) if x == end else F.col(x) for x in intervals.columns]
    return out.select(*cols).where(F.col(end) - F.col(start) > tolerance)
