"""Block model: nearest block with containment, attributes, labels and mass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelode.functions.units import compose_label, core_mass, grade_bin
from corelode.operators.joins import shuffled, small
from corelode.schema import attribute, block_attribute, hole_attribute

TOLERANCE = 1e-6
#: Blocks of a level up to which their cells go to all executors: points of a whole model meet in a few cells of a level of large blocks.
FEW = 1_000


def _half(tolerance: float = TOLERANCE) -> Column:
    """Half a block's diagonal: it holds no point that is farther from its centroid. A block without a size holds none."""
    return F.coalesce(F.sqrt(sum(F.pow(F.abs(F.col(d)) / 2 + tolerance, F.lit(2.0)) for d in ("dx", "dy", "dz"))), F.lit(tolerance))


def _squared(at: dict[str, Column], b: Column) -> Column:
    return sum((at[n] - b[n]) * (at[n] - b[n]) for n in "xyz")


def cells_of(at: dict[str, Column], half: Column, width: Column) -> list[Column]:
    return [F.sequence(F.floor((c - half) / width), F.floor((c + half) / width)) for c in at.values()]


def nearest_block(points: DataFrame, blocks: DataFrame, carry: list[str], x: str = "x_mid", y: str = "y_mid", z: str = "z_mid", order: str = "_row", tasks: int | None = None) -> DataFrame:
    """points plus `carry` columns of the block whose centroid is nearest, if it holds the point, and `outside_model`. Of equally near
    ones the least `order` counts. Points are dealt to `tasks`, else to shuffle partitions.

    Blocks have levels by their half diagonal, each level a grid of cells as wide as its blocks' reach; a block is filed under the cells that its own reach
    touches (three a side at most), and a point asks one cell a level. A nearest block that holds the point is found so, whatever other blocks'
    sizes are. What is found is then the nearest of all, unless a smaller block's centroid is nearer still without reaching the point. Where all blocks are of
    one size there is none, and points pass one join; else rivals() tells. A cell's list is as long as there are blocks of its level near it: some tens."""
    known = blocks.where("x is not null and y is not null and z is not null").withColumn("__h", _half())
    r = known.agg(F.min("__h").alias("low"), F.max("__h").alias("high"), F.count("*").alias("n")).collect()[0]
    low, mixed = r["low"] or 1.0, (r["high"] or 1.0) > (r["low"] or 1.0) * (1 + 1e-9)
    level = F.ceil(F.log2(F.col("__h") / low) - 1e-9).cast("int") if mixed else F.lit(0)
    known = known.withColumn("__level", F.greatest(level, F.lit(0)))
    sizes = dict(sorted((row[0], row[1]) for row in known.groupBy("__level").agg(F.count("*")).collect())) if mixed else {0: r["n"]}
    at = dict(zip("xyz", (F.col(c) for c in (x, y, z)), strict=True))
    block = F.struct(F.col(order).alias("o"), "x", "y", "z", "dx", "dy", "dz", *(F.col(c).alias(f"v_{c}") for c in carry))
    kind = known.select(block.alias("b")).schema["b"].dataType
    met = points.withColumns({"__d": F.lit(float("inf")), "__best": F.lit(None).cast(kind)})
    keys = ["__cx", "__cy", "__cz"]
    for k, n in sizes.items():
        width = low * 2.0**k * (1 + 1e-8)
        filed = known.where(F.col("__level") == k).select(block.alias("__block"), *(c.alias(f"__s{n}") for n, c in zip("xyz", cells_of({n: F.col(n) for n in "xyz"}, F.col("__h"), F.lit(width)), strict=True)))
        for axis in "xyz":
            filed = filed.withColumn(f"__c{axis}", F.explode(f"__s{axis}")).drop(f"__s{axis}")
        many = tasks and n > FEW
        filed = (filed.repartition(tasks, *keys) if many else filed).groupBy(*keys).agg(F.collect_list("__block").alias("__near"))
        asked = met.withColumns({f"__c{axis}": F.floor(c / width) for axis, c in at.items()})
        asked = asked.repartition(tasks, *keys) if many else asked
        met = asked.join(F.broadcast(filed) if n <= FEW else shuffled(filed), keys, "left").drop(*keys)
        first = F.array_min(F.transform("__near", lambda b, i: F.struct(_squared(at, b).alias("d"), b["o"].alias("o"), i.alias("i"))))
        met = met.withColumn("__first", first)
        nearer = F.coalesce((F.col("__first.d") < F.col("__d")) | ((F.col("__first.d") == F.col("__d")) & (F.col("__first.o") < F.col("__best.o"))), F.lit(False))
        met = met.withColumns({"__d": F.when(nearer, F.col("__first.d")).otherwise(F.col("__d")), "__best": F.when(nearer, F.get("__near", F.col("__first.i"))).otherwise(F.col("__best"))}).drop("__near", "__first")
    inside = F.lit(True)
    for n in "xyz":
        inside = inside & (F.abs(at[n] - F.col(f"__best.{n}")) <= F.col(f"__best.d{n}") / 2 + TOLERANCE)
    met = met.withColumn("__in", F.coalesce(inside, F.lit(False)))
    if mixed:
        met = kept(met.withColumn("__id", F.monotonically_increasing_id()))
        asked = met.where(F.col("__in") & (F.col("__d") > low * low)).select("__id", *(c.alias(f"p{n}") for n, c in at.items()), "__d", F.col("__best.o").alias("__o"))
        lost = rivals(asked, known.select("x", "y", "z", F.col(order).alias("o")))
        met = met.join(shuffled(lost.select("__id", F.lit(True).alias("__lost"))), "__id", "left").withColumn("__in", F.col("__in") & F.col("__lost").isNull())
    return met.select(*points.columns, *(F.when(F.col("__in"), F.col(f"__best.v_{c}")).alias(c) for c in carry), (~F.col("__in")).alias("outside_model"))


def kept(rows: DataFrame) -> DataFrame:
    """rows, computed once and for all: in the shared checkpoint folder; on one machine without such a folder in memory."""
    sc = rows.sparkSession.sparkContext
    if sc.getCheckpointDir():
        return rows.checkpoint()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return rows.persist()


#: A cell is told as up to 8 x 8 x 8 cells that are three levels finer.
FINER = 3


def box_pyramid(sites: DataFrame, levels: list[int]) -> DataFrame:
    """(level, cell, subs): for each cell that holds a site, its finer cells with sites: their place, the box around the sites and the least order."""
    width = F.pow(F.lit(2.0), F.col("level"))
    rows = sites.withColumn("level", F.explode(F.array(*(F.lit(k) for k in levels))))
    fine = {f"s{n}": F.floor(F.col(n) / (width / 2**FINER)) for n in "xyz"}
    rows = rows.withColumns(fine).groupBy("level", *fine).agg(*(f(n).alias(f"{k}{n}") for n in "xyz" for k, f in (("l", F.min), ("h", F.max))), F.min("o").alias("o"))
    sub = F.struct("sx", "sy", "sz", "lx", "ly", "lz", "hx", "hy", "hz", "o")
    return rows.groupBy("level", *(F.floor(F.col(f"s{n}") / 2**FINER).alias(f"c{n}") for n in "xyz")).agg(F.collect_list(sub).alias("subs"))


def rivals(asked: DataFrame, sites: DataFrame) -> DataFrame:
    """(__id): the points that have a site nearer than __d (squared), or as near and of less order than __o. asked: (__id, px, py, pz, __d, __o); sites:
    (x, y, z, o).

    A point starts with the cells around its ball, at most eight of the level that is twice as wide as its radius. A finer cell whose box of sites lies in the
    ball decides; one whose box doesn't meet it is out; only cells on the ball's surface go on, three levels finer, until boxes are single places. So a
    crowd of sites in a ball is never listed, and no list is longer than 512."""
    p = {n: F.col(f"p{n}") for n in "xyz"}
    radius = F.sqrt("__d")
    top = F.ceil(F.log2(F.greatest(radius * 2, F.lit(1e-9)) * (1 + 1e-9))).cast("int")
    front = asked.withColumn("level", top)
    for n, cells in zip("xyz", cells_of(p, radius * (1 + 1e-12), F.pow(F.lit(2.0), F.col("level"))), strict=True):
        front = front.withColumn(f"c{n}", F.explode(cells))
    lost = asked.select("__id").limit(0)
    while True:
        front = kept(front)
        levels = sorted(r[0] for r in front.select("level").distinct().collect())  # some tens at most
        if not levels:
            return lost
        met = shuffled(front).join(shuffled(box_pyramid(sites, levels)), ["level", "cx", "cy", "cz"])
        least = lambda s: sum(F.pow(F.greatest(F.lit(0.0), s[f"l{n}"] - p[n], p[n] - s[f"h{n}"]), F.lit(2.0)) for n in "xyz")
        most = lambda s: sum(F.pow(F.greatest(F.abs(p[n] - s[f"l{n}"]), F.abs(p[n] - s[f"h{n}"])), F.lit(2.0)) for n in "xyz")
        one = lambda s: (s["lx"] == s["hx"]) & (s["ly"] == s["hy"]) & (s["lz"] == s["hz"])
        at = lambda s: sum((p[n] - s[f"l{n}"]) * (p[n] - s[f"l{n}"]) for n in "xyz")
        d, o = F.col("__d"), F.col("__o")
        sure = lambda s: F.when(one(s), (at(s) < d) | ((at(s) == d) & (s["o"] < o))).otherwise(most(s) < d)
        # Rounding may put a box that touches the ball just outside: a hair more goes on.
        open_ = lambda s: ~one(s) & ~(most(s) < d) & (least(s) <= d * (1 + 1e-12))
        met = met.select("__id", "px", "py", "pz", "__d", "__o", "level", F.exists("subs", sure).alias("sure"), F.transform(F.filter("subs", open_), lambda s: F.struct("level", s["sx"].alias("x"), s["sy"].alias("y"), s["sz"].alias("z"))).alias("on"))
        told = kept(met.groupBy("__id").agg(*(F.first(c).alias(c) for c in ("px", "py", "pz", "__d", "__o")), F.bool_or("sure").alias("sure"), F.flatten(F.collect_list("on")).alias("on")))
        lost = lost.union(told.where("sure").select("__id"))
        left = told.where("not sure").withColumn("c", F.explode("on"))
        front = left.select("__id", "px", "py", "pz", "__d", "__o", (F.col("c.level") - FINER).alias("level"), F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("c.z").alias("cz"))


def resolve_attributes(rows: DataFrame, roles: list[str]) -> DataFrame:
    """attr_<role>: the logged value, else the modelled one."""
    out = {}
    for role in roles:
        sides = [F.col(c) for c in (hole_attribute(role), block_attribute(role)) if c in rows.columns]
        out[attribute(role)] = F.coalesce(*sides) if sides else F.lit(None).cast("string")
    return rows.withColumns(out)


def domain_match(rows: DataFrame, pairs: list[tuple[str, str]], into: str = "domain_match") -> DataFrame:
    """True if all pairs of which both sides are known agree in any case, false if one doesn't, null if none is known."""
    known, agree = F.lit(False), F.lit(True)
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        known, agree = known | both, agree & F.when(both, F.upper(a) == F.upper(b)).otherwise(F.lit(True))
    return rows.withColumn(into, F.when(known, agree))


def label_rows(rows: DataFrame, bin_on: str | None, edges: list[float], labels: list[str], parts: list[str]) -> DataFrame:
    """grade_bin, then allocation_domain of the key's parts; a column that isn't there counts as unknown."""
    value = F.col(bin_on) if bin_on and bin_on in rows.columns else F.lit(None).cast("double")
    rows = rows.withColumn("grade_bin", grade_bin(value, edges, labels))
    return rows.withColumn("allocation_domain", compose_label([F.col(p) if p in rows.columns else F.lit(None).cast("string") for p in parts]))


def with_core(rows: DataFrame, availability: DataFrame, diameter: float, fraction: float) -> DataFrame:
    """Availability, core diameter and remaining fraction of the hole; a hole that isn't listed is UNAVAILABLE."""
    known = small(availability.select(F.col("hole_id").alias("__hole"), "availability", "core_diameter_mm", "remaining_fraction"))
    out = rows.join(known, F.col("hole_id") == F.col("__hole"), "left").drop("__hole")
    return out.withColumns({"availability": F.coalesce("availability", F.lit("UNAVAILABLE")), "core_diameter_mm": F.coalesce("core_diameter_mm", F.lit(float(diameter))), "remaining_fraction": F.coalesce("remaining_fraction", F.lit(float(fraction)))})


def with_mass(rows: DataFrame, loss: float, constant: float | None = None) -> DataFrame:
    """mass_kg with the row's own density, else the block's, else the constant."""
    chain: list[Column] = [F.col(c) for c in ("density", "bm_density") if c in rows.columns] + ([F.lit(float(constant))] if constant is not None else [])
    return rows.withColumn("mass_kg", core_mass(F.col("length_m"), F.col("core_diameter_mm"), F.coalesce(*chain), F.col("remaining_fraction"), loss))


def outside_fraction(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg(F.col("outside_model").cast("int")).alias("outside_fraction"))
