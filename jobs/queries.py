"""The jobs as registered queries: each runs twice into one new folder and gives back what is there after the second run."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corelode.functions.numbers import SPACES
from corelode.plans.oracles import _ASSAY, _CODED, _CUT, _LITHO, _MASSED, _RUN_SUMMARY, _RUNS, _q
from corelode.plans.views import shared_dir
from jobs import note_values, run_register
from jobs.common import read_config


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that no other call has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_run_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg, at = read_config(run_register.CONFIG), new_folder(spark, "job1")
    for _ in range(2):
        run_register.run(spark, sf_dir, at, cfg)
    rows = spark.read.schema(run_register.RUNS).parquet(f"{at}/runs")
    return rows.withColumns({c: F.round(c, 4) + 0.0 for c in ("from_m", "to_m", "length_m", "mass_kg")})


def job2_note_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg, at = read_config(note_values.CONFIG), new_folder(spark, "job2")
    for _ in range(2):
        note_values.run(spark, sf_dir, at, f"{at}/checkpoint", cfg)
    return note_values.read_values(spark, at, cfg)


_REGISTER = _q("""SELECT hole_id, run_no, round(from_m, 4) + 0 AS from_m, round(to_m, 4) + 0 AS to_m, round(length_m, 4) + 0 AS length_m, intervals, round(mass_kg, 4) + 0 AS mass_kg, geomet_domain, break_reason,
  CASE WHEN NOT usable THEN 'unusable' WHEN s_suppkey % 13 = 0 OR s_suppkey % 11 = 0 THEN 'unavailable' WHEN length_m < 6.004 THEN 'run_too_short' WHEN coalesce(mass_kg, 0) < 40 THEN 'run_too_light' ELSE 'sample' END AS verdict,
  printf('P%02d', s_nationkey) AS project FROM summary JOIN supplier ON hole_id = s_suppkey""", _ASSAY.replace("assay AS (", "whole AS ("), _LITHO, _CUT, _CODED, _MASSED, _RUNS, _RUN_SUMMARY)

_TRIMMED = SPACES.replace("'", "''")
_VALUES = rf"""
WITH said AS (
  SELECT doc_id, lang, unnest(w) AS raw, generate_subscripts(w, 1) - 1 AS place
  FROM (SELECT doc_id, lang, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: regexp_matches(x, '[0-9]')) AS w FROM documents WHERE text IS NOT NULL)),
words AS (SELECT doc_id, lang, place, regexp_replace(regexp_replace(raw, '^[(\[{{"'']+', ''), '[)\]}}"'',;:.!?]+$', '') AS word FROM said),
suffixed AS (SELECT *, CASE WHEN lower(word) LIKE '%oz/t' THEN 'oz_t' WHEN lower(word) LIKE '%g/t' THEN 'gpt' WHEN lower(word) LIKE '%pct' OR word LIKE '%\%' ESCAPE '\' THEN 'pct' WHEN lower(word) LIKE '%ppm' THEN 'ppm' END AS unit FROM words),
bare AS (SELECT *, trim(CASE WHEN unit IS NULL THEN word WHEN word LIKE '%\%' ESCAPE '\' THEN word[:-2] WHEN unit = 'oz_t' THEN word[:-5] ELSE word[:-4] END, '{_TRIMMED}') AS t FROM suffixed),
read AS (
  SELECT *, CASE WHEN regexp_full_match(t, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(t AS DOUBLE) END AS n0,
    CASE WHEN regexp_full_match(t, '<\s*([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?') THEN TRY_CAST(trim(t[2:], '{_TRIMMED}') AS DOUBLE) END AS lim FROM bare),
finite AS (SELECT *, CASE WHEN isfinite(n0) THEN n0 END AS n FROM read),
stated AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN n IN (-99, 9999) THEN 'declared_null' WHEN isfinite(lim) THEN 'below_detection' WHEN n IS NULL THEN 'unparsed' WHEN n < 0 THEN 'negative' ELSE 'ok' END AS state FROM finite),
valued AS (SELECT *, CASE state WHEN 'ok' THEN n WHEN 'below_detection' THEN lim / 2 END AS value FROM stated)
SELECT doc_id, place, word, unit, value, value * CASE unit WHEN 'pct' THEN 10000 WHEN 'oz_t' THEN 34.2857142857 ELSE CASE WHEN unit IS NOT NULL THEN 1 END END::DOUBLE AS ppm, state, lang FROM valued"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_run_register": job1_run_register, "job2_note_values": job2_note_values}


def oracle_sql() -> dict[str, str]:
    return {"job1_run_register": _REGISTER, "job2_note_values": _VALUES}
