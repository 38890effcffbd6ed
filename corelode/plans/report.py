"""What a run shows: sheets as tables in declared units, CSV folders, one workbook, and the data behind charts."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corelode.config import Config
from corelode.functions.units import period_order, ppm_to_units
from corelode.operators.checks import ordered
from corelode.plans.project import State, store_of
from corelode.schema import attribute, block_attribute, block_element, element, weighted

MAX_WIDTH = 46
#: Rows up to which a table is one named CSV file, and rows of a worksheet without its header.
MOST_ROWS, SHEET_ROWS = 1_000_000, 1_048_575


@dataclass(frozen=True)
class Shown:
    """How columns are shown: units of an element by side, and the attributes' roles."""

    hole: dict[str, str]
    block: dict[str, str]
    roles: tuple[str, ...] = ()

    def of(self, columns: list[str]) -> dict[str, tuple[str, str | None]]:
        """{column: (header, units)} of those that have a header of their own. A block's grade is in the block model's units where it declares some, all
        others in the drillhole's; an interval's own grade goes before a composite's mean of the same element."""
        out: dict[str, tuple[str, str | None]] = {}
        for k in dict.fromkeys([*self.hole, *self.block]):
            units = self.hole.get(k) or self.block[k]
            side = self.block.get(k) or units
            own, mean = element(k), weighted(k)
            out |= {own: (f"{k}_{units}", units), block_element(k): (f"bm_{k}_{side}", side), mean: (f"{k}_{units}_wtd" if own in columns else f"{k}_{units}", units)}
        for r in self.roles:
            out |= {attribute(r): (r, None), block_attribute(r): (f"bm_{r}", None)}
        return {c: v for c, v in out.items() if c in columns}


def shown_by(cfg: Config) -> Shown:
    side = lambda name: {k: s.units for k, e in cfg.elements.items() if (s := getattr(e, name))}
    return Shown(side("drillhole"), side("block_model"), tuple(cfg.attributes))


def present(rows: DataFrame, shown: Shown | None = None, digits: int = 3) -> DataFrame:
    """Grades in their declared units under plain headers, attributes under their roles, arrays joined, doubles rounded half-even. A header that
    another column has already gets a number."""
    headers = shown.of(rows.columns) if shown else {}
    out: list[Column] = []
    seen: dict[str, int] = {}
    for f in rows.schema.fields:
        name, units = headers.get(f.name, (f.name, None))
        c = F.col(f"`{f.name}`")
        if units:
            c = ppm_to_units(c, units)
        if isinstance(f.dataType, T.DoubleType):
            c = F.bround(c, digits)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ", ")
        elif isinstance(f.dataType, T.MapType):
            c = F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "; ")
        seen[name] = seen.get(name, 0) + 1
        out.append(c.alias(name if seen[name] == 1 else f"{name}_{seen[name]}"))
    return rows.select(*out)


def summary(state: State) -> DataFrame:
    """(item, value) rows."""
    count = lambda name, rows: rows.agg(F.lit(name).alias("item"), F.count("*").cast("string").alias("value"))
    out = count("intervals", state.tables["intervals"])
    for name in ("run_summary", "candidates", "selected", "gaps"):
        if name in state.tables:
            out = out.unionByName(count(name, state.tables[name]))
    if "selected" in state.tables:
        out = out.unionByName(state.tables["selected"].agg(F.lit("holes").alias("item"), F.count_distinct("hole_id").cast("string").alias("value")))
    return out.unionByName(state.issues.groupBy("severity").agg(F.count("*").cast("string").alias("value")).select(F.concat(F.lit("issues "), "severity").alias("item"), "value"))


#: What the workbook's lists begin with; a composite's reason comes last.
ALLOCATION = ("allocation_domain", "tonnes", "tonnes_pct", "weighted_pct", "target", "existing", "deficit", "achieved", "shortfall")
COMPOSITES = ("sample_no", "hole_id", "from_m", "to_m", "length_m", "intervals", "mass_kg", "allocation_domain", "geomet_domain", "period", "grade_bin", "cv_primary", "domain_match", "is_planned")
INTERNAL = ("quality", "score", "missing", "swaps", "picked")


def allocation_sheet(allocation: DataFrame, selected: DataFrame) -> DataFrame:
    rows = allocation.join(selected.groupBy("allocation_domain").agg(F.count("*").alias("achieved")), "allocation_domain", "left")
    rows = rows.withColumn("achieved", F.coalesce("achieved", F.lit(0).cast("long"))).withColumn("shortfall", F.col("deficit") - F.col("achieved"))
    whole = F.sum("weighted_tonnes").over(W.partitionBy())  # a row for each domain
    rows = rows.withColumn("weighted_pct", F.when(whole > 0, 100.0 * F.col("weighted_tonnes") / whole).otherwise(F.lit(0.0)))
    return rows.select(*ALLOCATION).orderBy("allocation_domain")


def composites_sheet(selected: DataFrame) -> DataFrame:
    lead = [c for c in COMPOSITES if c in selected.columns]
    rest = [c for c in selected.columns if c not in (*lead, *INTERNAL, "reason")]
    return selected.select(*lead, *rest, "reason").orderBy("sample_no")


def sheets(state: State) -> dict[str, DataFrame]:
    """The workbook's tables. What is for the core shed has two digits, the candidates three."""
    t, shown = state.tables, shown_by(state.cfg)
    return {
        "Summary": summary(state), "Allocation": present(allocation_sheet(t["allocation"], t["selected"]), shown, 2), "Composites": present(composites_sheet(t["selected"]), shown, 2),
        "Pick_List": present(t["picks"], shown, 2), "Gap_Register": present(t["gaps"].orderBy("scope", "key")), "Validation": present(ordered(state.issues)),
        "Candidates": present(t["candidates"].orderBy("candidate_id"), shown),
    }


def write_orientation(state: State, folder: str) -> str:
    """Writes the holes' collars and toes as CSV, for each run that has built geometry; returns what to look at before its results are used."""
    ends = state.tables.get("hole_ends")
    if ends is None:
        return ""
    write_csv({"hole_orientation": present(ends.orderBy("hole_id"))}, folder)
    r = ends.agg(F.count("*").alias("n"), F.count_if("rises").alias("up")).collect()[0]
    return f"{r['n']} holes, {r['up']} of them end above their collar: look at hole_orientation in {folder} first, since a wrong dip sign, elevation or unit shows there"


def chart_data(state: State) -> dict[str, DataFrame]:
    """Tables that plots would draw: tonnes by domain and period, targets against picks, grades and masses of picks, hole directions."""
    t = state.tables
    return {
        "tonnes_by_period": t["tonnage_by_period"].orderBy("allocation_domain", *period_order(F.col("period"))),
        "allocation": t["allocation"].select("allocation_domain", "target", "deficit").join(t["selected"].groupBy("allocation_domain").agg(F.count("*").alias("achieved")), "allocation_domain", "left").na.fill(0, ["achieved"]),
        "hole_orientation": t["hole_ends"],
        "grade_histogram": t["candidates"].select(F.floor(F.col("mean_primary") / 1000).alias("bin")).groupBy("bin").agg(F.count("*").alias("n")),
        "sample_places": t["selected"].select("sample_no", "x_mid", "y_mid", "z_mid", "mass_kg"),
    }


def write_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """A folder of CSV parts for each table, by Spark, so that it may be in any store; of a table of up to MOST_ROWS rows also one file, <name>.csv."""
    for name, rows in tables.items():
        held = rows.persist()
        small = held.limit(MOST_ROWS + 1).count() <= MOST_ROWS
        (held.coalesce(1) if small else held).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        held.unpersist()
        target, store = store_of(rows.sparkSession, f"{folder}/{name}.csv")
        store.delete(target, False)  # of an earlier run
        if small:
            sc = rows.sparkSession.sparkContext
            parts = store.globStatus(store_of(rows.sparkSession, f"{folder}/{name}/part-*.csv")[0])
            sc._jvm.org.apache.hadoop.fs.FileUtil.copy(store, parts[0].getPath(), store, target, False, True, sc._jsc.hadoopConfiguration())


def _column(k: int) -> str:
    out = ""
    while True:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
        if k < 0:
            return out


def _cell(ref: str, value, style: int = 0) -> str:
    if value is None:
        return ""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return f'<c r="{ref}" t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'
    return f'<c r="{ref}" s="{style}"><v>{value}</v></c>' if value == value else ""


def _sheet(names: list[str], rows: Iterable) -> str:
    rows = [list(r) for r in rows] or [["(no rows)"]]
    widths = [min(MAX_WIDTH, 2 + max(len(str(n)), *(len(str(r[i])) for r in rows if i < len(r) and r[i] is not None), 0)) for i, n in enumerate(names)]
    cols = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths))
    head = "".join(_cell(f"{_column(i)}1", n, 1) for i, n in enumerate(names))
    body = "".join(f'<row r="{k}">' + "".join(_cell(f"{_column(i)}{k}", x) for i, x in enumerate(r)) + "</row>" for k, r in enumerate(rows, 2))
    return (
        '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        f'<cols>{cols}</cols><sheetData><row r="1">{head}</row>{body}</sheetData><autoFilter ref="A1:{_column(len(names) - 1)}{len(rows) + 1}"/></worksheet>'
    )


def write_workbook(tables: dict[str, DataFrame], path: str) -> list[str]:
    """One .xlsx on the driver, of tables that are small by nature (selected samples and what is told about them). A table with more rows than a
    worksheet can hold is left to its CSV; returned are the names of those."""
    large = [k for k, rows in tables.items() if rows.limit(SHEET_ROWS + 1).count() > SHEET_ROWS]
    tables = {k: rows for k, rows in tables.items() if k not in large}
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        n = len(tables)
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, n + 1)) + "</Types>")
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(k)}" sheetId="{i}" r:id="rId{i}"/>' for i, k in enumerate(tables, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1)) + f'<Relationship Id="rId{n + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        for i, rows in enumerate(tables.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet(rows.columns, rows.toLocalIterator()))
    return large
