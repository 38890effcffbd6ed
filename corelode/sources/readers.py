"""Sources: any table is read as text, its declared columns are renamed and parsed, and what can't be parsed becomes an issue.

A path that ends in .parquet is read as Parquet (cast to text), everything else as CSV.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corelode.config import Config, Flag, Source
from corelode.functions import units
from corelode.functions.numbers import SEVERITY, ParseRules, is_blank, parse_issues, strip, with_parsed
from corelode.operators.checks import Check, run_checks
from corelode.schema import COORDS, FROM, HOLE, ISSUES, TO, block_attribute, block_element, element, hole_attribute
from corelode.sources.quoted import records

# Characters that Windows-1252 has at 0x80 to 0x9F, where Latin-1 has controls.
C1 = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
WINDOWS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


class MappingError(ValueError):
    """Declared columns that a file doesn't have; told for all sources at once."""


def _csv(spark: SparkSession, path: str, encoding: str, multiline: bool) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=multiline, quote='"', escape='"', nullValue="\x00", emptyValue="", encoding=encoding)


def _look(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Whether the lines are UTF-8, and whether any has an odd number of quotes, so that a quoted line break may be in it: one aggregation."""
    v = F.col("value")
    odd = (F.octet_length(v) - F.octet_length(F.replace(v, F.lit('"'), F.lit("")))) % 2 == 1
    r = spark.read.text(path).agg(F.coalesce(F.bool_and(F.is_valid_utf8(v)), F.lit(True)), F.coalesce(F.bool_or(odd), F.lit(False))).collect()[0]
    return r[0], r[1]


def _bare(names: list[str]) -> list[str]:
    return [c.strip().removeprefix("\ufeff") for c in names]


def numbered(df: DataFrame) -> DataFrame:
    """df plus _row: 0, 1, 2, ... without gaps, by file name and place in the file, however the splits are dealt to tasks. df has to be a scan of files:
    its splits are the same each time it is read."""
    place = F.monotonically_increasing_id()
    if df.rdd.getNumPartitions() < 2 and len(df.inputFiles()) < 2:
        return df.withColumn("_row", place)
    split = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")]
    found = df.select(*split, place.alias("__place")).groupBy("__file", "__block").agg(F.count("*").alias("n"), F.min("__place").alias("first"))
    before, offsets = 0, []
    for r in sorted(found.collect()):  # a row for each split
        offsets.append((r["__file"], r["__block"], before - r["first"]))
        before += r["n"]
    at = df.sparkSession.createDataFrame(offsets or [("", 0, 0)], "__f string, __b long, __shift long")
    out = df.select("*", *split, place.alias("__place")).join(F.broadcast(at), (F.col("__file") == F.col("__f")) & (F.col("__block") == F.col("__b")))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__place") + F.col("__shift")).alias("_row"))


def _windows(data: bytes) -> str:
    return data.decode("latin-1").translate(str.maketrans(C1, WINDOWS))


def _utf8(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _quoted(spark: SparkSession, path: str, windows: bool) -> DataFrame:
    """The columns of a CSV with quoted line breaks, and _row: records are put together by their splits, then parsed one by one."""
    names = _csv(spark, path, "ISO-8859-1" if windows else "utf-8", True).columns  # the first record tells
    found = records(spark, path, _windows if windows else _utf8)
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {"quote": '"', "escape": '"', "nullValue": "\x00", "emptyValue": "", "multiLine": "true"}
    rows = found.select("_row", F.from_csv(F.regexp_replace("text", "\r$", ""), schema, options).alias("r"))
    return rows.select(*(F.col(f"r.c{i}").alias(c.translate(str.maketrans(C1, WINDOWS)) if windows else c) for i, c in enumerate(names)), "_row")


def read_text(spark: SparkSession, path: str, encoding: str = "auto", multiline: bool | None = None) -> DataFrame:
    """All columns as text, blanks as '', plus _row from 0 in file order. `auto` takes UTF-8, and Windows-1252 if the file isn't that.
    A CSV is cut into tasks, with quoted line breaks or without; `multiline` tells which, else one look at the file does."""
    if path.rstrip("/").endswith(".parquet"):
        df = numbered(spark.read.parquet(path))
        df = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns if c != "_row"), "_row")
    else:
        if encoding == "auto" or multiline is None:
            utf8, broken = _look(spark, path)
            encoding = ("utf-8" if utf8 else "cp1252") if encoding == "auto" else encoding
            multiline = broken if multiline is None else multiline
        windows = encoding.lower() in ("cp1252", "windows-1252")
        if multiline and (windows or encoding.lower() in ("utf-8", "utf8")):
            df = _quoted(spark, path, windows)
        elif windows:
            df = numbered(_csv(spark, path, "ISO-8859-1", multiline))
            df = df.select(*(F.translate(f"`{c}`", C1, WINDOWS).alias(c.translate(str.maketrans(C1, WINDOWS))) for c in df.columns if c != "_row"), "_row")
        else:
            df = numbered(_csv(spark, path, encoding, multiline))
    bare = _bare([c for c in df.columns if c != "_row"])
    return df.toDF(*bare, "_row").select(*(F.coalesce(strip(F.col(f"`{c}`")), F.lit("")).alias(c) for c in bare), "_row")


def mapping_problems(df: DataFrame, src: Source, name: str, more: list[str]) -> list[str]:
    wanted = [c for c in [*src.columns.values(), *src.carry_through, *more] if c]
    lost = [c for c in dict.fromkeys(wanted) if c not in df.columns]
    return [f"{name}: no column {c!r}; there are {', '.join(x for x in df.columns if x != '_row')}" for c in lost]


@dataclass
class Dataset:
    tables: dict[str, DataFrame]
    issues: DataFrame
    #: Folders of parsed sources.
    folders: list[str] = field(default_factory=list)

    def __getattr__(self, name: str) -> DataFrame | None:
        return self.tables.get(name)


@dataclass
class Reader:
    """One source while it is read: text columns in, typed columns out, with what has to be told about it."""

    cfg: Config
    src: Source
    name: str
    raw: DataFrame
    out: dict[str, Column] = field(default_factory=dict)
    parsed: dict[str, tuple[str, str]] = field(default_factory=dict)
    wanted: dict[str, tuple[Column, bool]] = field(default_factory=dict)
    texts: list[str] = field(default_factory=list)
    told: list[tuple[str, str, str]] = field(default_factory=list)
    counted: list[Check] = field(default_factory=list)

    def __post_init__(self):
        self.rules = ParseRules(tuple(str(v) for v in self.src.null_values), self.src.negative_is_below_detection)
        for c in self.src.carry_through:
            self.out[c] = F.col(f"`{c}`")
            self.texts.append(c)

    def has(self, canonical: str) -> bool:
        return bool(self.src.columns.get(canonical))

    def text(self, canonical: str, column: str | None = None, null: bool = False) -> None:
        c = column or self.src.columns.get(canonical)
        value = F.col(f"`{c}`") if c else F.lit(None).cast("string")
        self.texts += [c] if c else []
        self.out[canonical] = F.when(value != "", value) if null else value

    def number(self, canonical: str, column: str | None = None, convert=lambda c: c, grade: bool = False) -> None:
        c = column or self.src.columns.get(canonical)
        if not c:
            self.out[canonical] = F.lit(None).cast("double")
            return
        self.wanted[canonical] = (F.col(f"`{c}`"), grade)
        self.parsed[c] = (f"__t_{canonical}", f"__p.`{canonical}`")
        self.out[canonical] = convert(F.col(f"__p.`{canonical}`.value"))

    def length(self, *names: str) -> None:
        for n in names:
            self.number(n, convert=lambda c: units.length_to_metres(c, self.cfg.conventions.length_units))

    def density(self) -> None:
        d = self.src.density
        if d is None:
            self.out["density"] = F.lit(None).cast("double")
        elif d.source is None:
            self.out["density"] = F.lit(float(d.fallback_constant))
            self.told.append(("INFO", "tier2_fallback", "density is a constant"))
        else:
            self.number("density", d.source, lambda c: units.density_to_t_m3(c, self.cfg.conventions.density_units))
            if d.fallback_constant is not None:
                missing = self.out["density"].isNull()
                self.out["density"] = F.coalesce(self.out["density"], F.lit(float(d.fallback_constant)))
                self.counted.append(Check("density_fallback", "WARN", missing, f"missing densities become {d.fallback_constant}"))

    def flag(self, canonical: str) -> None:
        f: Flag | None = self.src.flags.get(canonical)
        if f is None or f.source is None:
            self.out[canonical] = F.lit(False)
            self.told.append(("INFO", "tier2_fallback", f"{canonical} isn't mapped"))
        elif f.type == "boolean":
            self.texts.append(f.source)
            self.out[canonical] = F.upper(strip(F.col(f"`{f.source}`"))).isin([v.strip().upper() for v in f.true_values])
        else:
            self.number(f"__f_{canonical}", f.source)
            value = self.out.pop(f"__f_{canonical}")
            self.out[canonical] = F.coalesce(value < f.threshold if f.direction == "below" else value > f.threshold, F.lit(False))

    def parse(self, folder: str | None = None) -> None:
        """Puts values, and the texts of those that have to be told, beside the columns that are texts. With a folder the rows are parsed once and read back from
        there: many checks and joins read some columns each."""
        said = [F.when(F.col(f"__p.`{k}`.state").isin(*SEVERITY), text).alias(f"__t_{k}") for k, (text, _) in self.wanted.items()]
        kept = [F.col(f"`{c}`") for c in dict.fromkeys(self.texts)]
        rows = with_parsed(self.raw, self.wanted, self.rules).select(*kept, *(["__p"] if self.wanted else []), *said, "_row")
        if folder:
            rows.write.parquet(folder)
            rows = rows.sparkSession.read.schema(rows.schema).parquet(folder)
        self.raw = rows

    def table(self) -> DataFrame:
        return self.raw.select(*(v.alias(k) for k, v in self.out.items()), "_row")

    def issues(self) -> DataFrame:
        spark = self.raw.sparkSession
        said = spark.createDataFrame([(s, c, self.name, None, 1, m, {}) for s, c, m in self.told], ISSUES)
        if self.counted:
            said = said.unionByName(run_checks(self.raw, self.name, self.counted, None))
        return said.unionByName(parse_issues(self.raw, self.name, self.parsed)) if self.parsed else said


def _needs(src: Source, cfg: Config, name: str) -> list[str]:
    """User columns that a source needs besides its own mapping."""
    out = [f.source for f in src.flags.values() if f.source]
    if src.density and src.density.source:
        out.append(src.density.source)
    if name in ("assay", "samples"):
        out += [e.drillhole.field for e in cfg.elements.values() if e.drillhole]
    if name == "block_model":
        out += [e.block_model.field for e in cfg.elements.values() if e.block_model] + [a.block_model for a in cfg.attributes.values() if a.block_model]
    return out


def _interval(r: Reader) -> None:
    r.text(HOLE)
    r.length(FROM, TO)
    made = F.concat(r.out[HOLE], F.lit("_"), F.coalesce(F.format_string("%.2f", r.out[FROM]), F.lit("NA")))
    if r.has("sample_id"):
        r.text("sample_id", null=True)
        r.counted.append(Check("sample_id_blank", "WARN", is_blank(F.col(f"`{r.src.columns['sample_id']}`")), "rows without a sample id get one of hole and depth"))
        r.out["sample_id"] = F.coalesce(r.out["sample_id"], made)
    else:
        r.out["sample_id"] = made
        r.told.append(("WARN", "tier2_fallback", "sample ids are made up"))
    r.density()
    r.flag("low_recovery")
    for k, e in r.cfg.elements.items():
        if e.drillhole:
            r.number(element(k), e.drillhole.field, lambda c, u=e.drillhole.units: units.grade_to_ppm(c, u), grade=True)
    for role, a in r.cfg.attributes.items():
        if a.drillhole and a.drillhole in r.raw.columns:
            r.text(hole_attribute(role), a.drillhole)


def _first(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy("_row"))).where("__n = 1").drop("__n")


def read_collar(r: Reader) -> None:
    r.text(HOLE)
    r.length("east", "north", "rl", "total_depth")
    if not r.has("total_depth"):
        r.told.append(("INFO", "tier2_fallback", "total_depth isn't mapped"))


def read_survey(r: Reader) -> None:
    c = r.cfg.conventions
    r.text(HOLE)
    r.length("depth")
    r.number("dip", convert=lambda x: units.dip_to_negative_down(x, c.dip_convention))
    r.number("azimuth", convert=lambda x: units.azimuth_to_grid(x, c.azimuth_reference, c.magnetic_declination_deg))


def read_litho(r: Reader) -> None:
    r.text(HOLE)
    r.length(FROM, TO)
    r.text("logged_code")
    for role, a in r.cfg.attributes.items():
        if a.drillhole and a.drillhole in r.raw.columns:
            r.text(hole_attribute(role), a.drillhole)


def read_samples(r: Reader) -> None:
    _interval(r)
    r.text("logged_code", null=True)
    r.length(*COORDS)


def read_lookup(r: Reader) -> None:
    r.text("logged_code")
    r.text("geomet_domain")


def read_blocks(r: Reader) -> None:
    r.length("x", "y", "z", "dx", "dy", "dz")
    r.text("period")
    r.out["period"] = F.when(~F.lower(strip(r.out["period"])).isin("", "nan"), r.out["period"])
    r.density()
    for role, a in r.cfg.attributes.items():
        if a.block_model:
            r.text(block_attribute(role), a.block_model)
    for k, e in r.cfg.elements.items():
        if e.block_model:
            r.number(block_element(k), e.block_model.field, lambda c, u=e.block_model.units: units.grade_to_ppm(c, u), grade=True)
    r.out["tonnes"] = r.out["dx"] * r.out["dy"] * r.out["dz"] * r.out["density"]


def read_availability(r: Reader) -> None:
    r.text(HOLE)
    r.text("availability")
    known = {k: k for k in ("AVAILABLE", "UNAVAILABLE", "PLANNED")} | {w.strip().upper(): k for k, words in r.src.value_map.items() for w in words}
    state = F.upper(strip(r.out["availability"]))
    mapped = F.lit(None).cast("string")
    for k, v in known.items():
        mapped = F.when(state == k, F.lit(v)).otherwise(mapped)
    r.out["availability_unmapped"] = mapped.isNull()
    r.out["availability"] = F.coalesce(mapped, F.lit("UNAVAILABLE"))
    r.number("core_diameter_mm")
    r.number("remaining_fraction")


def read_testwork(r: Reader) -> None:
    r.text(HOLE)
    r.length(FROM, TO)
    r.text("sample_id", null=True)
    r.out["sample_id"] = F.coalesce(r.out["sample_id"], r.out[HOLE])
    r.text("geomet_domain", null=True)
    r.text("test_package", null=True)


KINDS = {"collar": read_collar, "survey": read_survey, "assay": _interval, "litho": read_litho, "samples": read_samples, "domain_lookup": read_lookup, "block_model": read_blocks, "availability": read_availability, "existing_testwork": read_testwork, "planned_collar": read_collar, "planned_survey": read_survey}
#: Sources that are parsed once into the shared checkpoint folder, where the session has one.
LONG = ("assay", "litho", "samples", "block_model")
FIRST_OF = {"domain_lookup": "logged_code", "availability": HOLE}


def load(spark: SparkSession, cfg: Config) -> Dataset:
    """Every declared source. Problems of mapping are gathered from all of them before one error tells them."""
    readers, problems = [], []
    for name in KINDS:
        if src := getattr(cfg.sources, name):
            raw = read_text(spark, cfg.path(src.path), src.encoding, src.multiline)
            problems += mapping_problems(raw, src, name, _needs(src, cfg, name))
            if name == "samples":
                problems += [f"samples: {c} isn't mapped" for c in (HOLE, FROM, TO, "logged_code", *COORDS) if not src.columns.get(c)]
            readers.append((name, src, raw))
    if problems:
        raise MappingError("\n".join(problems))
    tables, issues, folders = {}, spark.createDataFrame([], ISSUES), []
    shared = spark.sparkContext.getCheckpointDir()
    for name, src, raw in readers:
        r = Reader(cfg, src, name, raw)
        KINDS[name](r)
        if name in LONG and shared:
            folders.append(f"{shared}/parsed-{uuid.uuid4().hex}")
        r.parse(folders[-1] if name in LONG and shared else None)
        table = r.table()
        issues = issues.unionByName(r.issues())
        if name == "domain_lookup":
            many = table.groupBy("logged_code").agg(F.count("*").alias("n"))
            issues = issues.unionByName(run_checks(many, name, [Check("domain_lookup_duplicate", "ERROR", F.col("n") > 1, "a code repeats; its first row counts")], None))
        if name == "availability":
            issues = issues.unionByName(run_checks(table, name, [Check("availability_unmapped", "ERROR", F.col("availability_unmapped"), "a state that isn't in value_map")]))
        tables[name] = _first(table, FIRST_OF[name]) if name in FIRST_OF else table
    return Dataset(tables, issues, folders)
