"""Distances to nearest neighbours, by boxes of places that get finer around each place.

Each place starts with the smallest cell of a grid of levels that it shares with another place, whose diagonal bounds its distance, and with the cells around
a ball of that radius. In a round it looks at the boxes of places three levels finer: each box bounds the distance from above, boxes beyond the best bound are
out, single places give exact distances, the others go on. So neither crowds nor lone places are compared with all others, and no list is longer than 512.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.operators.blocks import FINER, box_pyramid, cells_of, kept
from corelode.operators.joins import shuffled

#: Levels of the grid on which a start is looked for; places closer than the finest begin there.
DEPTH = 24


def nearest_neighbours(places: DataFrame, id_col: str, x: str = "x_mid", y: str = "y_mid", z: str = "z_mid", into: str = "nearest_m") -> DataFrame:
    """places plus the distance to the nearest other row; 0 for rows at one place. Null for a row without a place, and where there is no other. id_col
    tells rows apart."""
    at = {"x": x, "y": y, "z": z}
    known = places.where(" and ".join(f"{c} is not null and not isnan({c})" for c in at.values())).select(F.col(id_col).alias("o"), *(F.col(c).cast("double").alias(n) for n, c in at.items()))
    # Rows at one place are each other's neighbours; of each place one stands for all.
    spots = kept(known.groupBy("x", "y", "z").agg(F.min("o").alias("o"), F.count("*").alias("n")))
    lone = spots.where("n = 1").select("o", *(F.col(n).alias(f"p{n}") for n in "xyz"))
    found = _distances(lone, spots.select("o", "x", "y", "z"))
    far = known.join(spots.where("n > 1").select("x", "y", "z", F.lit(0.0).alias("__zero")), ["x", "y", "z"], "left").join(found, "o", "left")
    far = far.select(F.col("o").alias("__o"), F.coalesce("__zero", F.sqrt("__d")).alias(into))
    return places.join(far, F.col(id_col) == F.col("__o"), "left").drop("__o")


def _distances(asked: DataFrame, sites: DataFrame) -> DataFrame:
    """(o, __d): squared distances of asked (o, px, py, pz) to the nearest of sites (o, x, y, z; no two at one place) but itself."""
    ends = sites.agg(*(f(n).alias(f"{k}{n}") for n in "xyz" for k, f in (("l", F.min), ("h", F.max)))).collect()[0]
    if ends["lx"] is None:
        return asked.select("o", F.lit(0.0).alias("__d")).limit(0)
    spans = [ends[f"h{n}"] - ends[f"l{n}"] for n in "xyz"]
    top, whole = math.ceil(math.log2(max(*spans, 1e-9))), sum(s * s for s in spans)
    p = {n: F.col(f"p{n}") for n in "xyz"}
    levels = F.explode(F.sequence(F.lit(top - DEPTH), F.lit(top)))
    cell = lambda c, n: F.floor((c - ends[f"l{n}"]) / F.pow(F.lit(2.0), F.col("level")))
    crowded = sites.withColumn("level", levels).groupBy("level", *(cell(F.col(n), n).alias(f"c{n}") for n in "xyz")).agg(F.count("*").alias("n")).where("n > 1")
    shared = asked.withColumn("level", levels).withColumns({f"c{n}": cell(c, n) for n, c in p.items()}).join(shuffled(crowded), ["level", "cx", "cy", "cz"], "left_semi").groupBy("o").agg(F.min("level").alias("level"))
    front = asked.join(shuffled(shared), "o", "left").withColumn("__d", F.least(F.coalesce(3 * F.pow(F.lit(4.0), F.col("level")), F.lit(whole)), F.lit(whole)) * (1 + 1e-9)).drop("level")
    radius = F.sqrt("__d")
    front = front.withColumns({"level": F.ceil(F.log2(F.greatest(radius * 2, F.lit(1e-300)) * (1 + 1e-9))).cast("int"), "best": F.lit(float("inf"))})
    for n, cells in zip("xyz", cells_of(p, radius * (1 + 1e-12), F.pow(F.lit(2.0), F.col("level"))), strict=True):
        front = front.withColumn(f"c{n}", F.explode(cells))
    done = asked.select("o", F.lit(0.0).alias("__d")).limit(0)
    names = ["px", "py", "pz"]
    while True:
        front = kept(front)
        some = sorted(r[0] for r in front.select("level").distinct().collect())
        if not some:
            return done
        met = front.join(shuffled(box_pyramid(sites, some).withColumnRenamed("subs", "s")), ["level", "cx", "cy", "cz"], "left")
        least = lambda s: sum(F.pow(F.greatest(F.lit(0.0), s[f"l{n}"] - p[n], p[n] - s[f"h{n}"]), F.lit(2.0)) for n in "xyz")
        most = lambda s: sum(F.pow(F.greatest(F.abs(p[n] - s[f"l{n}"]), F.abs(p[n] - s[f"h{n}"])), F.lit(2.0)) for n in "xyz")
        square = lambda s: sum((p[n] - s[f"l{n}"]) * (p[n] - s[f"l{n}"]) for n in "xyz")
        one = lambda s: (s["lx"] == s["hx"]) & (s["ly"] == s["hy"]) & (s["lz"] == s["hz"])
        inf = F.lit(float("inf"))
        own = lambda s: one(s) & (s["o"] == F.col("o"))
        exact = F.array_min(F.transform("s", lambda s: F.when(one(s) & ~own(s), square(s)).otherwise(inf)))
        bound = F.array_min(F.transform("s", lambda s: F.when(own(s), inf).otherwise(most(s))))
        on = F.transform(F.filter("s", lambda s: ~one(s) & (least(s) <= F.col("__d") * (1 + 1e-12))), lambda s: F.struct((F.col("level") - FINER).alias("level"), s["sx"].alias("x"), s["sy"].alias("y"), s["sz"].alias("z"), least(s).alias("d")))
        told = met.select("o", *names, F.least("best", F.coalesce(exact, inf)).alias("best"), F.least("__d", F.coalesce(bound, inf) * (1 + 1e-12)).alias("__d"), F.coalesce(on, F.array().cast("array<struct<level:int,x:bigint,y:bigint,z:bigint,d:double>>")).alias("on"))
        told = told.groupBy("o").agg(*(F.first(c).alias(c) for c in names), F.min("best").alias("best"), F.min("__d").alias("__d"), F.flatten(F.collect_list("on")).alias("on"))
        told = kept(told.withColumn("on", F.filter("on", lambda c: c["d"] <= F.least(F.col("__d"), F.col("best")) * (1 + 1e-12))))
        done = done.union(told.where("size(on) = 0 and best < double('infinity')").select("o", F.col("best").alias("__d")))
        left = told.withColumn("c", F.explode("on"))
        front = left.select("o", *names, F.least("__d", "best").alias("__d"), "c.level", "best", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("c.z").alias("cz"))


def mean_nearest(places: DataFrame, id_col: str, x: str = "x_mid", y: str = "y_mid", z: str = "z_mid") -> DataFrame:
    """One row, `separation`: the mean distance to the nearest other place; 0 for fewer than two rows, or where a place isn't known."""
    far = nearest_neighbours(places, id_col, x, y, z)
    return far.agg(F.when((F.count("*") > 1) & (F.count("nearest_m") == F.count("*")), F.avg("nearest_m")).otherwise(F.lit(0.0)).alias("separation"))
