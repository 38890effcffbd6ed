"""A whole project written as CSV files from the derived tables, as a user's export would spell it, and its configuration."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corelode.config import Config, parse_config
from corelode.operators.scans import cleaned
from corelode.plans import views as v

CONFIG = """
project: {name: exported, output_dir: out}
conventions: {length_units: m, dip_convention: positive_down}
sources:
  collar: {path: collar, encoding: utf-8, multiline: false, columns: {hole_id: Hole, east: East, north: North, rl: RL, total_depth: EOH}}
  survey: {path: survey, encoding: utf-8, multiline: false, columns: {hole_id: Hole, depth: At, dip: Dip, azimuth: Azi}}
  litho: {path: litho, encoding: utf-8, multiline: false, columns: {hole_id: Hole, from_m: From, to_m: To, logged_code: Code}}
  assay:
    path: assay
    columns: {hole_id: Hole, sample_id: Sample, from_m: From, to_m: To}
    density: {source: SG, fallback_constant: 2.7}
    flags: {low_recovery: {source: Rec, type: threshold, threshold: 50, direction: below}}
    null_values: ["-99"]
  domain_lookup: {path: lookup, columns: {logged_code: Code, geomet_domain: Domain}}
  block_model: {path: blocks, encoding: utf-8, multiline: false, columns: {x: X, y: Y, z: Z, dx: DX, dy: DY, dz: DZ, period: Period}, density: {source: SG}}
  availability: {path: availability, columns: {hole_id: Hole, availability: State, core_diameter_mm: Diameter, remaining_fraction: Rest}, value_map: {AVAILABLE: [IN STORAGE], UNAVAILABLE: [GONE]}}
attributes:
  rock: {block_model: Rock}
elements:
  Zn: {primary: true, drillhole: {field: Zn_pct, units: pct}, block_model: {field: Zn_ppm, units: ppm}}
domaining:
  hard_break_on: [geomet_domain]
  allocation_key: [rock, grade_bin]
  grade_bins: {element: Zn, edges: [0, 2, 6, 20], labels: [LOW, MED, HIGH]}
compositing: {min_length_m: 6, max_length_m: 20.005, target_mass_kg: 50, min_mass_kg: 40}
allocation: {method: proportional, total_samples: 40}
mass: {default_core_diameter_mm: 47.6, default_remaining_fraction: 0.5, loss_factor: 0.9}
"""


def spelled(grade: Column, key: Column) -> Column:
    """A grade in per cent as laboratories write it: some below detection, some not done, some garbled."""
    k = key % 50
    return F.when(k == 1, "<0.01").when(k == 2, "-99").when(k == 3, "n/a").when(k == 4, "").when(k == 5, F.concat(F.lit(" "), grade.cast("string"))).otherwise(grade.cast("string"))


def number_of(sample: str) -> Column:
    """Centimetres at which a sample begins, and its hole."""
    return F.substring_index(sample, "-", -1).cast("long") + F.substring_index(sample, "-", 1).cast("long")


def make(spark: SparkSession, sf_dir: str, faults: bool = False) -> Config:
    """Writes the files, each part of them packed, into a folder of this call's own. With `faults`: dips the wrong way up, a code twice, states without a meaning, blank sample ids,
    and neither total depths nor recoveries mapped."""
    at = f"{v.shared_dir(spark)}/project-{uuid.uuid4().hex}"
    assay = v.assay(spark, sf_dir)
    number = number_of("sample_id")
    tables: dict[str, DataFrame] = {
        "collar": v.collar(spark, sf_dir).toDF("Hole", "East", "North", "RL", "EOH"),
        "survey": v.survey(spark, sf_dir).select(F.col("hole_id").alias("Hole"), F.col("depth").alias("At"), (-F.col("dip")).alias("Dip"), F.col("azimuth").alias("Azi")),
        "litho": v.litho(spark, sf_dir).toDF("Hole", "From", "To", "Code"),
        "assay": assay.select(F.col("hole_id").alias("Hole"), F.col("sample_id").alias("Sample"), F.col("from_m").alias("From"), F.col("to_m").alias("To"), spelled(F.col("elem_zn") / 1e4, number).alias("Zn_pct"), F.when(number % 20 != 7, F.col("density")).alias("SG"), F.when(F.col("low_recovery"), 10).otherwise(95).alias("Rec")),
        "lookup": v.lookup(spark, sf_dir).toDF("Code", "Domain"),
        "blocks": v.blocks(spark, sf_dir).select(*(F.col(c).alias(c.upper()) for c in ("x", "y", "z", "dx", "dy", "dz")), F.col("period").alias("Period"), F.col("bm_attr_rock").alias("Rock"), F.col("bm_elem_zn").alias("Zn_ppm"), F.col("density").alias("SG")),
        "availability": v.availability(spark, sf_dir).select(F.col("hole_id").alias("Hole"), F.when(F.col("availability") == "AVAILABLE", "In storage").otherwise("gone").alias("State"), F.col("core_diameter_mm").alias("Diameter"), F.col("remaining_fraction").alias("Rest")),
    }
    text = CONFIG
    if faults:
        tables["lookup"] = tables["lookup"].unionByName(tables["lookup"].where("Code in ('L0', 'L3')"))
        tables["availability"] = tables["availability"].withColumn("State", F.when(F.col("Hole") % 7 == 1, "lost").otherwise(F.col("State")))
        tables["assay"] = tables["assay"].withColumn("Sample", F.when(number_of("Sample") % 30 != 3, F.col("Sample")))
        for old, new in (("dip_convention: positive_down", "dip_convention: negative_down"), (", total_depth: EOH", ""), ("{source: Rec, type: threshold, threshold: 50, direction: below}", "{source: null}")):
            text = text.replace(old, new)
    with cleaned(spark):
        for name, rows in tables.items():
            rows.write.csv(f"{at}/{name}", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, compression="gzip")
    return parse_config(text, at)
