"""Running values along an ordered axis, in two levels where a key holds too many rows for one task.

A window over a key is one task's work, however many rows the key has. A hot key is therefore cut into pieces along its axis, and a scan goes in two
levels: within each (key, piece) by ordinary windows, then over the pieces. The last (or first) row of a piece holds all that the next pieces
need of it: the running sum, count, maximum, last known value and the row itself. These rows, one a piece, are scanned in their turn and come back to the rows
as what they carry in. Rows are exchanged by (key, piece): all once, those of hot keys once more for what they carry.

Keys that aren't hot have one piece and nothing is carried in; without hot keys the plan is the ordinary window and nothing else. A key is hot if
it holds more rows than one task's share, so there are fewer hot keys than tasks, and `PIECES` times as many pieces besides. Tasks are shuffle
partitions, or one for each SHARE of rows where that is more: a row for each piece is all that is broadcast here.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corelode.schema import FROM, HOLE

#: Pieces that a task's share of rows is cut into.
PIECES = 4
#: Pieces of one key at most: quantiles are asked for on this grid.
GRID = 4096
#: Ranges of a prefix sum, and sampled keys for each of them.
RANGES, SAMPLED = 256, 16
#: Rows of a large table that one task sorts, on the average.
SHARE = 200_000

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What runs here takes its shuffle files with it when it is done; else they stay until the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@dataclass(frozen=True)
class HotKeys:
    """(__key, __splits): a row for each hot key, positions at which its next piece begins, in order; and the pieces in all. Or, with `fixed`, a
    column with the splits of all rows as one key. Rows are dealt to `tasks`, else to shuffle partitions."""

    splits: DataFrame | None
    pieces: int
    fixed: Column | None = None
    tasks: int | None = None


def tasks_for(rows: DataFrame) -> int | None:
    """Tasks that rows are to be dealt to by key so that each sorts SHARE of them; None where shuffle partitions are enough for that."""
    return _tasks(rows.sparkSession, rows.count())


def _tasks(spark: SparkSession, n: int) -> int | None:
    wanted = -(-n // SHARE)
    return wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def _passed(splits: str, at: Column, most: int) -> Column:
    """How many of the splits, in order and `most` at most, are no higher than `at`: by halves, as each step is told row by row."""
    steps = [F.lit(1 << k) for k in reversed(range(most.bit_length()))]
    return F.aggregate(F.array(*steps), F.lit(0), lambda n, step: F.when(F.get(splits, n + step - 1) <= at, n + step).otherwise(n)) if steps else F.lit(0)


def hot_keys(rows: DataFrame, by: str = HOLE, at: str | Column = FROM) -> HotKeys | None:
    """The hot keys of rows, cut at approximate quantiles of the position `at` (a number); None if there are none. Two passes over those two
    columns at most, each summed in its tasks. Rows at one position stay together."""
    few = rows.select(F.col(by).alias("__key"), (F.col(at) if isinstance(at, str) else at).cast("double").alias("__at"))
    counts = few.groupBy("__key").agg(F.count("*").alias("n"))
    total = few.count()
    more = _tasks(rows.sparkSession, total)
    tasks = more or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = counts.where(F.col("n") * tasks > total).select("__key", "n").collect()  # fewer rows than tasks
    wanted = {r["__key"]: min(GRID, -(-r["n"] * PIECES * tasks // total)) for r in hot}
    if max(wanted.values(), default=0) < 2:
        return None
    grid = max(wanted.values())
    spark, kind = rows.sparkSession, few.schema["__key"].dataType.simpleString()
    asked = spark.createDataFrame([(k, m) for k, m in wanted.items()], f"__k {kind}, m int")
    at_quantiles = F.percentile_approx("__at", [k / grid for k in range(1, grid)], max(10_000, 4 * grid))
    found = few.join(F.broadcast(asked), F.col("__key").eqNullSafe(F.col("__k"))).groupBy("__key").agg(F.first("m").alias("m"), at_quantiles.alias("q")).collect()
    cut = [(r["__key"], sorted({r["q"][k * grid // r["m"] - 1] for k in range(1, r["m"])})) for r in found if r["q"]]
    return HotKeys(spark.createDataFrame(cut, f"__key {kind}, __splits array<double>"), sum(len(s) + 1 for _, s in cut), tasks=more)


def prefix_sums(rows: DataFrame, key: str, value: str, into: str) -> DataFrame:
    """rows, one a key, plus `into`: the sum of `value` over all smaller keys (null is the smallest). Keys are dealt into ranges, whose borders are
    those of a sample by hash, the same whenever they are asked for; ranges are summed on their own, and a row for each of them is scanned. The sample is a
    subquery: no job runs before its time."""
    sample = rows.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key), key).limit(RANGES * SAMPLED)
    borders = sample.agg(F.filter(F.sort_array(F.collect_list(key)), lambda s, i: (i > 0) & (i % SAMPLED == 0)).alias("b")).scalar()
    whole = rows.withColumn("__all", F.lit(0))
    return scanned(whole, "__all", [key], HotKeys(None, RANGES, borders), **{into: ("before", F.col(value))}).withColumn(into, F.coalesce(into, F.lit(0))).drop("__all")


@dataclass(frozen=True)
class Axis:
    """Rows of a key in an order whose first part is the position `at`, nulls first; the order should tell all rows apart that differ in what is asked."""

    by: str
    order: tuple[str | Column, ...]
    hot: HotKeys | None = None
    at: str | Column | None = None

    def deal(self, rows: DataFrame) -> DataFrame:
        """rows with their piece, where there are hot keys; scan() needs it, done() takes it away."""
        if self.hot is None:
            return rows
        at = self.order[0] if self.at is None else self.at
        at = F.col(at) if isinstance(at, str) else at
        if self.hot.splits is None:
            held = rows.withColumn("__splits", self.hot.fixed)  # a subquery may not stand within a lambda's function
            return held.withColumns({"__piece": F.size(F.filter("__splits", lambda s: s <= at)), "__hot": F.lit(True)}).drop("__splits")
        out = rows.join(F.broadcast(self.hot.splits), F.col(self.by).eqNullSafe(F.col("__key")), "left")  # a row for each hot key
        piece = F.when(F.col("__splits").isNotNull(), _passed("__splits", at, self.hot.pieces)).otherwise(F.lit(0))
        dealt = out.withColumns({"__piece": piece, "__hot": F.col("__splits").isNotNull()}).drop("__key", "__splits")
        return dealt.repartition(*([self.hot.tasks] if self.hot.tasks else []), self.by, "__piece")  # what is carried shares this exchange

    def done(self, rows: DataFrame) -> DataFrame:
        return rows.drop("__piece", "__hot")

    def scan(self, rows: DataFrame, **wanted: tuple[str, Column | None]) -> DataFrame:
        """Dealt rows plus a column for each of `wanted`, name: (kind, value). Kinds: `number` (1, 2, ...), `total` (running sum), `before` (the same without
        the row's own), `highest` (running maximum without the row's own), `known` (last value up to the row that isn't null), `previous` and
        `following` (the neighbour's value)."""
        parts = (self.by,) if self.hot is None else (self.by, "__hot", "__piece")
        local = W.partitionBy(*parts).orderBy(*self.order)
        upto, earlier = local.rowsBetween(W.unboundedPreceding, 0), local.rowsBetween(W.unboundedPreceding, -1)
        own = {
            "number": lambda v: F.row_number().over(local), "total": lambda v: F.sum(v).over(upto), "before": lambda v: F.sum(v).over(earlier), "highest": lambda v: F.max(v).over(earlier),
            "known": lambda v: F.last(v, ignorenulls=True).over(upto), "previous": lambda v: F.lag(F.struct(v.alias("v"))).over(local), "following": lambda v: F.lead(F.struct(v.alias("v"))).over(local),
        }
        neighbours = [n for n, (kind, _) in wanted.items() if kind in ("previous", "following")]
        if self.hot is None:
            out = rows.withColumns({n: own[kind](v) for n, (kind, v) in wanted.items()})
            return out.withColumns({n: F.col(f"{n}.v") for n in neighbours}) if neighbours else out
        within = rows.withColumns({n: own[kind](v) for n, (kind, v) in wanted.items()})
        edges = within.where("__hot").withColumns({"__first": F.row_number().over(local) == 1, "__last": F.lead(F.lit(True)).over(local).isNull()})
        whole = {"number": lambda v: F.row_number().over(local), "total": own["total"], "before": own["total"], "highest": lambda v: F.max(v).over(upto), "known": own["known"]}
        ends = edges.withColumns({f"__e_{n}": whole[kind](v) if kind in whole else F.struct(v.alias("v")) for n, (kind, v) in wanted.items()})
        came = self._carried(ends, {n: kind for n, (kind, _) in wanted.items() if kind != "following"}, "__last", False)
        goes = self._carried(ends, {n: kind for n, (kind, _) in wanted.items() if kind == "following"}, "__first", True)
        out = within
        for side in (came, goes):
            if side is not None:
                out = out.join(F.broadcast(side), F.col(self.by).eqNullSafe(F.col("__k")) & (F.col("__piece") == F.col("__p")), "left").drop("__k", "__p")  # a row for each piece
        both = {
            "number": lambda a, b: a + F.coalesce(b, F.lit(0)), "total": lambda a, b: F.coalesce(a + b, a, b), "before": lambda a, b: F.coalesce(a + b, a, b), "highest": lambda a, b: F.greatest(a, b), "known": lambda a, b: F.coalesce(a, b),
            "previous": lambda a, b: F.coalesce(a, b)["v"], "following": lambda a, b: F.coalesce(a, b)["v"],
        }
        out = out.withColumns({n: both[kind](F.col(n), F.col(f"__c_{n}")) for n, (kind, _) in wanted.items()})
        return out.drop(*(f"__c_{n}" for n in wanted))

    def _carried(self, ends: DataFrame, kinds: dict[str, str], edge: str, back: bool) -> DataFrame | None:
        """(__k, __p, __c_<name>...): what each piece of a hot key gets from those before it, or after it if `back`."""
        if not kinds:
            return None
        few = ends.where(edge).select(F.col(self.by).alias("__k"), F.col("__piece").alias("__p"), *(f"__e_{n}" for n in kinds))
        over = W.partitionBy("__k").orderBy(F.desc("__p") if back else "__p")
        earlier = over.rowsBetween(W.unboundedPreceding, -1)
        carry = {
            "number": lambda c: F.sum(c).over(earlier), "total": lambda c: F.sum(c).over(earlier), "before": lambda c: F.sum(c).over(earlier), "highest": lambda c: F.max(c).over(earlier),
            "known": lambda c: F.last(c, ignorenulls=True).over(earlier), "previous": lambda c: F.lag(c).over(over), "following": lambda c: F.lag(c).over(over),
        }
        return few.select("__k", "__p", *(carry[kind](F.col(f"__e_{n}")).alias(f"__c_{n}") for n, kind in kinds.items()))


def scanned(rows: DataFrame, by: str, order: Sequence[str | Column], hot: HotKeys | None = None, at: str | Column | None = None, **wanted: tuple[str, Column | None]) -> DataFrame:
    """rows plus the wanted columns, by one scan."""
    axis = Axis(by, tuple(order), hot, at)
    return axis.done(axis.scan(axis.deal(rows), **wanted))
