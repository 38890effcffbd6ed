"""Exact medians of few groups, by distributed selection: no task and no row ever holds a group's values.

Each round asks for a quantile sketch of what is still open around a wanted rank, then counts exactly what lies below, on and between the two marks next to
it. The rank is on a mark, and done, or strictly between them: some hundredth of the values go on to the next round. Ties don't slow it,
since marks are values. What is left goes to the driver once it is a bounded number of values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks of a sketch, its accuracy, values that the driver takes of a rank at most, and groups.
MARKS, ACCURACY, MOST_VALUES, MOST_GROUPS = 512, 10_000, 10_000, 1_000


@dataclass
class _Open:
    """A rank that isn't found yet: it is the `rank`-th of `n` values strictly between `low` and `high`."""

    group: object
    rank: int
    n: int
    low: float = float("-inf")
    high: float = float("inf")


def _between(values: DataFrame, still: list[_Open]) -> DataFrame:
    """(slot, v): the open values of each slot. still has two entries a group at most."""
    spark, kind = values.sparkSession, values.schema["g"].dataType.simpleString()
    table = spark.createDataFrame([(i, o.group, o.low, o.high) for i, o in enumerate(still)], f"slot int, __g {kind}, low double, high double")
    met = values.join(F.broadcast(table), F.col("g").eqNullSafe(F.col("__g")))
    return met.where((F.col("v") > F.col("low")) & (F.col("v") < F.col("high"))).select("slot", "v")


def _marks(o: _Open, quantiles: list[float]) -> tuple[float, float]:
    """The marks that surely have the rank between or on them: beside it by two steps of the sketch."""
    k = (o.rank + 0.5) / o.n * MARKS
    low, high = int(k) - 2, int(k) + 2
    return (quantiles[low] if low >= 0 else o.low), (quantiles[high] if high < len(quantiles) else o.high)


def exact_medians(rows: DataFrame, by: str, value: str, most_values: int = MOST_VALUES) -> dict:
    """{group: (count, median)}: the mean of the two middle values, as usual. Null and NaN values don't count; infinite ones are none either. A null
    group is one."""
    values = rows.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    counts = {r["g"]: r["n"] for r in values.groupBy("g").agg(F.count("*").alias("n")).limit(MOST_GROUPS + 1).collect()}
    if len(counts) > MOST_GROUPS:
        raise ValueError(f"over {MOST_GROUPS} groups: take a plain aggregation")
    middle = {g: sorted({(n - 1) // 2, n // 2}) for g, n in counts.items()}
    still, found = [_Open(g, k, counts[g]) for g, ks in middle.items() for k in ks], {}
    names = [(o.group, o.rank) for o in still]
    while still:
        few, many = [i for i, o in enumerate(still) if o.n <= most_values], [i for i, o in enumerate(still) if o.n > most_values]
        if few:
            got: dict[int, list[float]] = {i: [] for i in range(len(few))}
            for r in _between(values, [still[i] for i in few]).collect():
                got[r["slot"]].append(r["v"])
            for k, i in enumerate(few):
                found[names[i]] = sorted(got[k])[still[i].rank]
        if many:
            left, some = [], [still[i] for i in many]
            within = _between(values, some)
            sketch = within.groupBy("slot").agg(F.percentile_approx("v", [k / MARKS for k in range(1, MARKS)], ACCURACY).alias("q")).collect()
            marks = {r["slot"]: _marks(some[r["slot"]], r["q"]) for r in sketch}
            table = values.sparkSession.createDataFrame([(i, *m) for i, m in marks.items()], "__s int, a double, b double")
            v, a, b = F.col("v"), F.col("a"), F.col("b")
            split = within.join(F.broadcast(table), F.col("slot") == F.col("__s")).groupBy("slot").agg(*(F.count_if(c).alias(n) for n, c in (("below", v < a), ("on_a", v == a), ("inside", (v > a) & (v < b)), ("on_b", v == b))))
            for r in split.collect():
                o, name, (low, high) = some[r["slot"]], names[many[r["slot"]]], marks[r["slot"]]
                k = o.rank - r["below"]
                if k < 0:  # the sketch was further off than it says: what lies below goes on
                    left.append((name, _Open(o.group, o.rank, r["below"], o.low, low)))
                elif k < r["on_a"]:
                    found[name] = low
                elif (k := k - r["on_a"]) < r["inside"]:
                    left.append((name, _Open(o.group, k, r["inside"], low, high)))
                elif (k := k - r["inside"]) < r["on_b"]:
                    found[name] = high
                else:
                    rest = o.n - r["below"] - r["on_a"] - r["inside"] - r["on_b"]
                    left.append((name, _Open(o.group, k - r["on_b"], rest, high, o.high)))
            names, still = [n for n, _ in left], [o for _, o in left]
        else:
            still = []
    return {g: (counts[g], sum(found[(g, k)] for k in ks) / len(ks)) for g, ks in middle.items()}
