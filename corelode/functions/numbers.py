"""Text to number, with every value that isn't one accounted for.

A parsed value is a struct of the number and its state: ``ok``, ``blank``, ``declared_null``, ``unparsed``, and for grades
``below_detection`` (a value such as <0.01, or a negative one where those stand for it) and ``negative``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
BELOW = r"^<\s*((\d+\.?\d*|\.\d+)([eE][-+]?\d+)?)$"
#: All blanks of Unicode and the ASCII separators.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SHOWN_VALUES, SHOWN_LINES, DETAIL_LINES = 5, 5, 20
#: The header is line 1 and row 0 is line 2.
FIRST_LINE = 2

SEVERITY = {"declared_null": ("INFO", "null_value"), "unparsed": ("ERROR", "value_unparseable"), "below_detection": ("INFO", "below_detection"), "negative": ("ERROR", "grade_negative")}


@dataclass(frozen=True)
class ParseRules:
    null_values: tuple[str, ...] = ()
    negative_is_below_detection: bool = False


def strip(text: Column) -> Column:
    """text without blanks of any kind around it; F.trim knows only the space."""
    return F.btrim(text, F.lit(SPACES))


def _finite(value: Column) -> Column:
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def _read(bare: Column) -> Column:
    """The number that a text without blanks around it spells, perhaps an infinite one. The pattern keeps out nan, inf and type suffixes, which a cast takes."""
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def plain_number(text: Column) -> Column:
    """A finite number or null."""
    return _finite(_read(strip(text)))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def _declared_null(bare: Column, number: Column, rules: ParseRules) -> Column:
    """A token matches as a word in any case, and a numeric one also any spelling of its value."""
    if not rules.null_values:
        return F.lit(False)
    words = sorted({v.strip().upper() for v in rules.null_values})
    numbers = []
    for v in words:
        try:
            numbers.append(float(v))
        except ValueError:
            continue
    found = F.upper(bare).isin(words)
    if numbers := [n for n in numbers if n == n and abs(n) != float("inf")]:
        found = found | F.coalesce(number.isin(numbers), F.lit(False))
    return found


def _parsed(value: Column, state: Column) -> Column:
    return F.struct(value.alias("value"), state.alias("state"))


def _limit(bare: Column) -> Column:
    """The limit in a text such as <0.01, perhaps an infinite one, or null."""
    return F.when(bare.startswith("<"), _read(F.regexp_extract(bare, BELOW, 1)))


def _number_state(bare: Column, number: Column, rules: ParseRules) -> Column:
    return F.when(F.coalesce(bare, F.lit("")) == "", "blank").when(_declared_null(bare, number, rules), "declared_null").when(number.isNull(), "unparsed").otherwise("ok")


def _grade_state(bare: Column, number: Column, limit: Column, rules: ParseRules) -> Column:
    low = F.lit("below_detection" if rules.negative_is_below_detection else "negative")
    return (
        F.when(F.coalesce(bare, F.lit("")) == "", "blank").when(_declared_null(bare, number, rules), "declared_null").when(limit.isNotNull(), "below_detection")
        .when(number.isNull(), "unparsed").when(number < 0, low).otherwise("ok")
    )


def _number(number: Column, state: Column) -> Column:
    return _parsed(F.when(state == "ok", number), state)


def _grade(number: Column, limit: Column, state: Column) -> Column:
    return _parsed(F.when(state == "ok", number).when(state == "below_detection", F.coalesce(limit, F.abs(number)) / 2), state)


def parse_number(text: Column, rules: ParseRules = ParseRules()) -> Column:
    number = plain_number(text)
    return _number(number, _number_state(strip(text), number, rules))


def parse_grade(text: Column, rules: ParseRules = ParseRules()) -> Column:
    number, limit = plain_number(text), _finite(_limit(strip(text)))
    return _grade(number, limit, _grade_state(strip(text), number, limit, rules))


def with_parsed(rows: DataFrame, wanted: dict[str, tuple[Column, bool]], rules: ParseRules = ParseRules(), into: str = "__p") -> DataFrame:
    """rows plus a struct `into` with a parsed value for each of `wanted`, name: (text without blanks around it, whether it is a grade).

    Numbers, states and values are columns that rest on one another, each worked out once a row. The last step is a generator of one row: the optimizer would copy
    the parsing to each use of a value, and filters above would be pushed below it, until the code is too long to be compiled."""
    if not wanted:
        return rows
    limited = [k for k, (_, grade) in wanted.items() if grade]
    part = lambda kind: {k: F.col(f"__{kind}_{k}") for k in wanted}
    number, limit, state = part("n"), part("l"), part("s")
    found = rows.select("*", *(_read(text).alias(f"__n_{k}") for k, (text, _) in wanted.items()), *(_limit(wanted[k][0]).alias(f"__l_{k}") for k in limited))
    found = found.withColumns({f"__n_{k}": _finite(number[k]) for k in wanted} | {f"__l_{k}": _finite(limit[k]) for k in limited})
    found = found.withColumns({f"__s_{k}": _grade_state(text, number[k], limit[k], rules) if grade else _number_state(text, number[k], rules) for k, (text, grade) in wanted.items()})
    values = F.struct(*((_grade(number[k], limit[k], state[k]) if grade else _number(number[k], state[k])).alias(k) for k, (_, grade) in wanted.items()))
    return found.select(*(F.col(f"`{c}`") for c in rows.columns), F.explode(F.array(values)).alias(into))


def _first_rows(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key with their rank; each task cuts its own rows before the exchange, so no task gathers more than
    `most` rows from each other one."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def parse_issues(rows: DataFrame, source: str, columns: dict[str, tuple[str, str]], line: str = "_row") -> DataFrame:
    """Issue rows of all parsed columns. columns: {shown name: (text column, parsed column)}; `line` is the row's number in the file, from
    0. Shown are the five most frequent values, ties in file order, and the first lines."""
    each = [
        F.struct(F.lit(name).alias("column"), F.col(text).alias("value"), F.col(f"{parsed}.state").alias("state"))
        for name, (text, parsed) in columns.items()
    ]
    key = ["column", "state"]
    long = rows.select(F.col(line).alias("line"), F.explode(F.array(*each)).alias("c")).select("line", "c.*").where(F.col("state").isin(*SEVERITY))
    by_value = long.groupBy(*key, "value").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    by_state = by_value.groupBy(*key).agg(F.sum("n").alias("count"), F.count("*").alias("different"))
    top = _first_rows(by_value, key, [F.desc("n"), F.col("first"), F.col("value")], SHOWN_VALUES)
    top = top.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("top"))
    first = _first_rows(long.select(*key, "line"), key, [F.col("line")], DETAIL_LINES)
    first = first.groupBy(*key).agg(F.sort_array(F.collect_list(F.col("line") + FIRST_LINE)).alias("lines"))
    told = by_state.join(top, key).join(first, key)  # a row for each column and state
    shown = F.array_join(F.transform("top", lambda v: F.format_string("'%s' x %d", v["value"], v["n"])), ", ")
    more = F.format_string(" and %d more", F.col("different") - SHOWN_VALUES)
    shown = F.when(F.col("different") > SHOWN_VALUES, F.concat(shown, more)).otherwise(shown)
    at = F.array_join(F.slice("lines", 1, SHOWN_LINES).cast("array<string>"), ", ")
    pick = lambda k: F.coalesce(*(F.when(F.col("state") == s, F.lit(v[k])) for s, v in SEVERITY.items()))
    return told.select(
        pick(0).alias("severity"), pick(1).alias("check"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("hole_id"), "count",
        F.concat(F.col("column"), F.lit(": "), shown, F.lit("; lines "), at).alias("message"),
        F.create_map(F.lit("column"), F.col("column"), F.lit("lines"), F.array_join(F.col("lines").cast("array<string>"), ",")).alias("detail"),
    )
