r"""Quality rules: a threshold table compiled into one projection of built-in functions.

Words are runs of anything but blanks (``[^\x20\x09-\x0D]+``). Every figure of a document comes from its own row, so
the plan is a scan and projections: no exchange, no Python.

Defined results: a null or empty text has no words, zero figures and fails the base rule; ids may be null or repeated,
each row is judged alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "das dem den der des die ein eine für im in ist mit nicht sich und von zu auf "
    "au avec ce dans de des du en est et il la le les ne par pas pour qui que sur un une "
    "al con de del el en es la las lo los no para por que se su un una y"
).split()


class Rule(NamedTuple):
    """A document passes if low * base <= 100 * (figure + slack) and 100 * figure <= high * base."""

    name: str
    figure: str
    base: str
    low: int | None
    high: int | None
    slack: int = 0


#: Percentages. The slack of the stop-word rule lets a text of some thirty words pass without any.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 6, None, 2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for all its uses inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    bare = F.expr(r"trim(BOTH ' \u0009\u000a\u000b\u000c\u000d' FROM __text)")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, _SPACE))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more. Equal hashes are neighbours after sorting; then each
    repeated window adds the words up to the next repeated one, `WINDOW` at most."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))

    def total(p: Column) -> Column:
        step = F.transform(p, lambda i, k: F.coalesce(F.least(F.get(p, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    return _let(_let(pairs, repeated), total)


def quality_figures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and a long for each figure that rules name."""
    text = F.col("__text")
    d = df.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    d = d.withColumns({
        "__words": F.when(text.rlike(r"[^\x20\x09-\x0D]"), _words(text)).otherwise(F.array().cast("array<string>")),
        "__lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    words = F.col("__words")
    at = lambda i, k: F.get(words, i + k)
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
    d = d.withColumn("__hashes", F.when(F.size(words) > WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    hashes, lines = F.col("__hashes"), F.col("__lines")
    figures = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, _SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_covered(hashes)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    # A generator of one row: filters above it aren't pushed below, where the optimizer would repeat all of this for each use of a figure.
    return d.select(F.col(id_col), F.explode(F.array(figures)).alias("__f")).select(F.col(id_col), "__f.*")


def compiled(rules=RULES) -> dict[str, Column]:
    """A boolean column for each rule, true where it is met."""
    out = {}
    for r in rules:
        met, figure, base = F.lit(True), F.col(r.figure), F.col(r.base)
        if r.low is not None:
            met = met & (100 * (figure + r.slack) >= r.low * base)
        if r.high is not None:
            met = met & (100 * figure <= r.high * base)
        out[f"ok_{r.name}"] = met
    return out


def judge_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Figures, one boolean a rule, ``base_failed`` and ``kept``."""
    checks = compiled(rules)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = ~F.col("base_failed")
    for name in checks:
        kept = kept & F.col(name)
    return quality_figures(df, id_col, text_col).withColumns(checks).withColumn("base_failed", failed).withColumn("kept", kept)
