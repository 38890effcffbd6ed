"""Drill-like tables derived from the driver's generic ones, in whole centimetres, so that any engine gets the same numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corelode.operators.scans import tasks_for

ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
EDGES, LABELS = (0.0, 20000.0, 60000.0, 200000.0), ("LOW", "MED", "HIGH")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint folder; one in the warehouse where it names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir")


def assay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier s is hole s; its line items, in a full order, are consecutive samples."""
    rows = table(spark, sf_dir, "lineitem")
    tasks = tasks_for(rows)
    rows = (rows.repartition(tasks, "l_suppkey") if tasks else rows).withColumn("len_cm", (50 + F.col("l_quantity") * 3).cast("long"))
    to_cm = F.sum("len_cm").over(W.partitionBy("l_suppkey").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("to_cm", to_cm).withColumn("from_cm", F.col("to_cm") - F.col("len_cm"))
    return rows.select(
        F.col("l_suppkey").alias("hole_id"), (F.col("from_cm") / 100).alias("from_m"), (F.col("to_cm") / 100).alias("to_m"), (F.col("len_cm") / 100).alias("length_m"),
        F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("from_cm").cast("string")).alias("sample_id"),
        (F.col("l_discount") * 1e6).alias("elem_zn"), (2.5 + F.col("l_tax") * 5).alias("density"), (F.col("l_quantity") < 3).alias("low_recovery"), F.col("l_returnflag").alias("dh_attr_rock"),
    )


def hot_assay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all line items are samples of hole 0, the others of their supplier's. An order's lines follow one another, orders are a metre apart."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    from_cm = k * 1500 + (n - 1) * 200
    to_cm = from_cm + F.when(F.col("l_quantity") > 8, 200).otherwise(180)
    return table(spark, sf_dir, "lineitem").select(
        F.when(k % 2 == 0, F.lit(0)).otherwise(F.col("l_suppkey") + 1).cast("bigint").alias("hole_id"), (from_cm / 100).alias("from_m"), (to_cm / 100).alias("to_m"),
        F.concat_ws("-", k.cast("string"), n.cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("sample_id"),
        F.when(F.col("l_discount") > 0, F.col("l_discount") * 1e6).alias("elem_zn"), (F.col("l_quantity") < 3).alias("low_recovery"), F.col("l_returnflag").alias("dh_attr_rock"),
    )


def hot_litho(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of 12 m for each order, in hole 0 or in the holes of ten suppliers."""
    k = F.col("o_orderkey")
    hole = F.when(k % 2 == 0, F.lit(0)).otherwise(F.col("o_custkey") % 10 + 1).cast("bigint")
    return table(spark, sf_dir, "orders").select(hole.alias("hole_id"), (k * 15.0).alias("from_m"), (k * 15.0 + 12.0).alias("to_m"), F.concat(F.lit("L"), (F.col("o_custkey") % 8).cast("string")).alias("logged_code"))


def litho(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = F.col("s_suppkey"), F.col("k")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(21))).alias("k"))
    return rows.select(s.alias("hole_id"), (k * 37.0).alias("from_m"), ((k + 1) * 37.0).alias("to_m"), F.concat(F.lit("L"), ((s * 7 + k * 3) % 8).cast("string")).alias("logged_code"))


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L7 has no domain."""
    rows = [(f"L{i}", ("VOLCANIC", "SEDIMENT", "INTRUSIVE")[i % 3]) for i in range(7)]
    return spark.createDataFrame(rows, "logged_code string, geomet_domain string")


def collar(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("hole_id"), (10000.0 + 40.0 * (k % 10)).alias("east"), (20000.0 + 55.0 * (F.floor(k / 10) % 10)).alias("north"), F.lit(450.0).alias("rl"), F.lit(820.0).alias("total_depth"))


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, i = F.col("s_suppkey"), F.col("i")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("i"))
    return rows.select(k.alias("hole_id"), (i * 50.0).alias("depth"), (-60.0 - 5.0 * (k % 4) + 0.5 * i).alias("dip"), ((k * 37 + i * 2) % 360).cast("double").alias("azimuth"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part p is block p of a 20 x 10 grid in levels."""
    i = F.col("p_partkey") - 1
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("_row"), (10020.0 + 40.0 * (i % 20)).alias("x"), (20030.0 + 60.0 * (F.floor(i / 20) % 10)).alias("y"), (400.0 - 100.0 * F.floor(i / 200)).alias("z"), F.lit(40.0).alias("dx"), F.lit(60.0).alias("dy"), F.lit(100.0).alias("dz"),
        F.when(F.col("p_size") % 7 == 0, "").otherwise((F.col("p_size") % 7).cast("string")).alias("period"), F.col("p_brand").alias("bm_attr_rock"), (F.col("p_retailprice") * 50).alias("bm_elem_zn"),
        (2.6 + (F.col("p_size") % 5) * 0.1).alias("density"), (40.0 * 60.0 * 100.0 * (2.6 + (F.col("p_size") % 5) * 0.1)).alias("tonnes"),
    )


def mixed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same grid with every tenth block a quarter as wide, and block 1 some sixty times as large, below the first levels."""
    k = F.col("_row")
    rows = blocks(spark, sf_dir).withColumns({d: F.when(k == 1, size).when(k % 10 == 3, F.col(d) / 4).otherwise(F.col(d)) for d, size in (("dx", 2000.0), ("dy", 2000.0), ("dz", 6000.0))})
    return rows.withColumn("z", F.when(k == 1, F.lit(-905.0)).otherwise(F.col("z")))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    crowd = k % 5 == 0
    wide = {"x": (k * 7919) % 10007, "y": (k * 1299) % 9973, "z": (k * 389) % 4999}
    close = {"x": (k * 31) % 97, "y": (k * 17) % 89, "z": (k * 7) % 11}
    return table(spark, sf_dir, "part").select(k.alias("place_id"), *(F.when(crowd, close[n] / 100.0).otherwise(wide[n].cast("double")).alias(n) for n in "xyz"))


def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 11th hole is gone, every 13th isn't listed."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").where(k % 13 != 0)
    return rows.select(k.alias("hole_id"), F.when(k % 11 == 0, "UNAVAILABLE").otherwise("AVAILABLE").alias("availability"), F.when(k % 2 == 0, 63.5).alias("core_diameter_mm"), F.lit(None).cast("double").alias("remaining_fraction"))


def testwork(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of 4 to 18 m in every third hole."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").where(k % 3 == 0)
    return rows.select(k.alias("_row"), k.alias("hole_id"), F.lit(4.0).alias("from_m"), F.lit(18.0).alias("to_m"), F.concat(F.lit("T"), k.cast("string")).alias("sample_id"), F.when(k % 9 == 0, "VOLCANIC").alias("geomet_domain"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points in and around the grid, off block faces."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("point_id"), (10001.0 + (k * 7) % 830).alias("x_mid"), (20001.0 + (k * 11) % 640).alias("y_mid"), (440.5 - (k * 13) % 1200).alias("z_mid"))
