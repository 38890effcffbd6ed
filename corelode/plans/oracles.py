"""DuckDB SQL for the registered queries, written from the rules, not from the plans."""

from corelode.functions.numbers import SPACES

_ASSAY = """
assay0 AS (
  SELECT *, CAST(50 + l_quantity * 3 AS BIGINT) AS len_cm,
    CAST(sum(CAST(50 + l_quantity * 3 AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS to_cm
  FROM lineitem),
assay AS (
  SELECT l_suppkey AS hole_id, CAST(to_cm - len_cm AS DOUBLE) / 100 AS from_m, CAST(to_cm AS DOUBLE) / 100 AS to_m, CAST(len_cm AS DOUBLE) / 100 AS length_m,
    l_suppkey || '-' || (to_cm - len_cm) AS sample_id, l_discount * CAST(1e6 AS DOUBLE) AS elem_zn, CAST(2.5 AS DOUBLE) + l_tax * 5 AS density, l_quantity < 3 AS low_recovery
  FROM assay0)"""

_LITHO = """
litho AS (
  SELECT s_suppkey AS hole_id, CAST(k * 37 AS DOUBLE) AS from_m, CAST((k + 1) * 37 AS DOUBLE) AS to_m, 'L' || ((s_suppkey * 7 + k * 3) % 8) AS logged_code
  FROM supplier, range(0, 22) t(k)),
lookup AS (
  SELECT 'L' || i AS logged_code, ['VOLCANIC', 'SEDIMENT', 'INTRUSIVE'][CAST(i % 3 AS INT) + 1] AS geomet_domain FROM range(0, 7) t(i))"""

_PIECES = """
bounds AS (SELECT DISTINCT hole_id, cut FROM (SELECT hole_id, from_m AS cut FROM litho UNION ALL SELECT hole_id, to_m FROM litho)),
edges AS (
  SELECT sample_id, hole_id, elem_zn, to_m AS last, from_m AS cut FROM assay
  UNION ALL SELECT a.sample_id, a.hole_id, a.elem_zn, a.to_m, b.cut FROM assay a JOIN bounds b ON a.hole_id = b.hole_id AND b.cut > a.from_m + 1e-6 AND b.cut < a.to_m - 1e-6),
pieces AS (
  SELECT hole_id, sample_id, elem_zn, cut AS from_m, coalesce(lead(cut) OVER (PARTITION BY sample_id ORDER BY cut), last) AS to_m FROM edges)"""

_CUT = """
bounds AS (SELECT DISTINCT hole_id, cut FROM (SELECT hole_id, from_m AS cut FROM litho UNION ALL SELECT hole_id, to_m FROM litho)),
edges AS (
  SELECT *, from_m AS cut FROM whole UNION ALL SELECT w.*, b.cut FROM whole w JOIN bounds b ON w.hole_id = b.hole_id AND b.cut > w.from_m + 1e-6 AND b.cut < w.to_m - 1e-6),
assay AS (
  SELECT hole_id, sample_id AS parent, sample_id || '/' || cut AS sample_id, elem_zn, density, low_recovery, cut AS from_m, last AS to_m, last - cut AS length_m
  FROM (SELECT *, coalesce(lead(cut) OVER (PARTITION BY sample_id ORDER BY cut), to_m) AS last FROM edges))"""

_CODED = """
coded AS (
  SELECT a.*, CASE WHEN (a.from_m + a.to_m) / 2 < l.to_m THEN l.logged_code END AS logged_code
  FROM (SELECT *, (from_m + to_m) / 2 AS mid FROM assay) a ASOF LEFT JOIN litho l ON a.hole_id = l.hole_id AND a.mid >= l.from_m),
domained AS (SELECT c.*, k.geomet_domain FROM coded c LEFT JOIN lookup k ON c.logged_code = k.logged_code)"""

_SURVEY = """
readings AS (
  SELECT s_suppkey AS hole_id, CAST(i * 50 AS DOUBLE) AS depth, CAST(-60 - 5 * (s_suppkey % 4) AS DOUBLE) + 0.5 * i AS dip, CAST((s_suppkey * 37 + i * 2) % 360 AS DOUBLE) AS az
  FROM supplier, range(0, 17) t(i)
  UNION ALL SELECT s_suppkey, CAST(820 AS DOUBLE), CAST(-60 - 5 * (s_suppkey % 4) AS DOUBLE) + 8, CAST((s_suppkey * 37 + 32) % 360 AS DOUBLE) FROM supplier),
tangents AS (
  SELECT hole_id, depth, sin(radians(90 + dip)) * sin(radians(az)) AS te, sin(radians(90 + dip)) * cos(radians(az)) AS tn, cos(radians(90 + dip)) AS td FROM readings),
steps AS (
  SELECT *, lead(te) OVER w AS ue, lead(tn) OVER w AS un, lead(td) OVER w AS ud, lead(depth) OVER w - depth AS md FROM tangents WINDOW w AS (PARTITION BY hole_id ORDER BY depth)),
angles AS (SELECT *, acos(greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), te * ue + tn * un + td * ud))) AS dl FROM steps),
moves AS (SELECT *, md / 2 * CASE WHEN dl <= 1e-9 THEN 1 ELSE 2 / dl * tan(dl / 2) END AS f FROM angles),
stations AS (
  SELECT hole_id, depth, te, tn, td, ue, un, ud, md, dl,
    CAST(10000 + 40 * (hole_id % 10) AS DOUBLE) + coalesce(sum(f * (te + ue)) OVER w, 0) AS x,
    CAST(20000 + 55 * ((hole_id // 10) % 10) AS DOUBLE) + coalesce(sum(f * (tn + un)) OVER w, 0) AS y,
    450 - coalesce(sum(f * (td + ud)) OVER w, 0) AS z
  FROM moves WINDOW w AS (PARTITION BY hole_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

_PLACED = """
asked AS (
  SELECT sample_id, hole_id, from_m, to_m, 'from' AS what, from_m AS d FROM assay UNION ALL SELECT sample_id, hole_id, from_m, to_m, 'to', to_m FROM assay UNION ALL SELECT sample_id, hole_id, from_m, to_m, 'mid', (from_m + to_m) / 2 FROM assay),
found AS (SELECT a.*, s.* EXCLUDE (hole_id), d - s.depth AS past FROM asked a ASOF JOIN stations s ON a.hole_id = s.hole_id AND a.d >= s.depth),
turned AS (
  SELECT *, CASE WHEN dl <= 1e-9 THEN te ELSE sin((1 - past / md) * dl) / sin(dl) * te + sin(past / md * dl) / sin(dl) * ue END AS ve,
    CASE WHEN dl <= 1e-9 THEN tn ELSE sin((1 - past / md) * dl) / sin(dl) * tn + sin(past / md * dl) / sin(dl) * un END AS vn,
    CASE WHEN dl <= 1e-9 THEN td ELSE sin((1 - past / md) * dl) / sin(dl) * td + sin(past / md * dl) / sin(dl) * ud END AS vd FROM found),
bent AS (SELECT *, acos(greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), te * ve + tn * vn + td * vd))) AS bl FROM turned),
placed AS (
  SELECT sample_id, hole_id, from_m, to_m, what,
    x + CASE WHEN past <= 0 OR md IS NULL THEN past * te ELSE g * (te + ve) END AS x, y + CASE WHEN past <= 0 OR md IS NULL THEN past * tn ELSE g * (tn + vn) END AS y,
    z - CASE WHEN past <= 0 OR md IS NULL THEN past * td ELSE g * (td + vd) END AS z
  FROM (SELECT *, past / 2 * CASE WHEN bl <= 1e-9 THEN 1 ELSE 2 / bl * tan(bl / 2) END AS g FROM bent))"""

_BLOCKS = """
blocks0 AS (SELECT *, p_partkey - 1 AS i FROM part),
blocks AS (
  SELECT p_partkey AS block, CAST(10020 + 40 * (i % 20) AS DOUBLE) AS x, CAST(20030 + 60 * ((i // 20) % 10) AS DOUBLE) AS y, CAST(400 - 100 * (i // 200) AS DOUBLE) AS z,
    CASE WHEN p_size % 7 = 0 THEN '' ELSE CAST(p_size % 7 AS VARCHAR) END AS period, p_brand AS rock, p_retailprice * 50 AS zn,
    CAST(240000 AS DOUBLE) * (CAST(2.6 AS DOUBLE) + (p_size % 5) * CAST(0.1 AS DOUBLE)) AS tonnes
  FROM blocks0),
labelled AS (
  SELECT *, CASE WHEN zn >= 0 AND zn < 20000 THEN 'LOW' WHEN zn >= 20000 AND zn < 60000 THEN 'MED' WHEN zn >= 60000 AND zn < 200000 THEN 'HIGH' END AS grade_bin FROM blocks),
domains AS (SELECT *, upper(coalesce(rock, 'UNKNOWN')) || '-' || upper(coalesce(grade_bin, 'UNKNOWN')) AS allocation_domain FROM labelled)"""

_TONNAGE = """
tonnage AS (
  SELECT allocation_domain, sum(tonnes) AS tonnes, sum(tonnes * CASE period WHEN '1' THEN 2.0 WHEN '2' THEN 1.5 WHEN '3' THEN 0.5 ELSE 1.0 END::DOUBLE) AS weighted_tonnes FROM domains WHERE period <> '' GROUP BY 1)"""

_POINTS = """
points AS (SELECT o_orderkey AS point_id, CAST(10001 + (o_orderkey * 7) % 830 AS DOUBLE) AS px, CAST(20001 + (o_orderkey * 11) % 640 AS DOUBLE) AS py, CAST(440.5 AS DOUBLE) - (o_orderkey * 13) % 1200 AS pz FROM orders),
nearest AS (
  SELECT point_id, any_value(px) AS px, any_value(py) AS py, any_value(pz) AS pz, arg_min({'block': block, 'x': x, 'y': y, 'z': z}, {'d': (px - x) ** 2 + (py - y) ** 2 + (pz - z) ** 2, 'block': block}) AS b FROM points, blocks GROUP BY 1),
assigned AS (SELECT point_id, b.block AS near, NOT (abs(px - b.x) <= 20 + 1e-6 AND abs(py - b.y) <= 30 + 1e-6 AND abs(pz - b.z) <= 50 + 1e-6) AS outside FROM nearest)"""

_MIXED = """
mixed AS (
  SELECT block, x, y, CASE WHEN block = 1 THEN -905 ELSE z END AS z, CASE WHEN block = 1 THEN 1000 WHEN block % 10 = 3 THEN 5 ELSE 20 END AS hx, CASE WHEN block = 1 THEN 1000 WHEN block % 10 = 3 THEN 7.5 ELSE 30 END AS hy,
    CASE WHEN block = 1 THEN 3000 WHEN block % 10 = 3 THEN 12.5 ELSE 50 END AS hz FROM blocks),
near_mixed AS (
  SELECT point_id, any_value(px) AS px, any_value(py) AS py, any_value(pz) AS pz, arg_min({'block': block, 'x': x, 'y': y, 'z': z, 'hx': hx, 'hy': hy, 'hz': hz}, {'d': (px - x) ** 2 + (py - y) ** 2 + (pz - z) ** 2, 'block': block}) AS b FROM points, mixed GROUP BY 1),
in_mixed AS (SELECT point_id, b.block AS near, NOT (abs(px - b.x) <= b.hx + 1e-6 AND abs(py - b.y) <= b.hy + 1e-6 AND abs(pz - b.z) <= b.hz + 1e-6) AS outside FROM near_mixed)"""

_MASSED = """
massed AS (
  SELECT d.*, coalesce(v.availability, 'UNAVAILABLE') AS availability,
    length_m * (pi() * (coalesce(v.diameter, 47.6) / 2000.0::DOUBLE) ** 2) * density * 0.5::DOUBLE * 1000 * 0.9::DOUBLE AS mass_kg
  FROM domained d LEFT JOIN (SELECT s_suppkey AS hole_id, CASE WHEN s_suppkey % 11 = 0 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS availability, CASE WHEN s_suppkey % 2 = 0 THEN 63.5::DOUBLE END AS diameter FROM supplier WHERE s_suppkey % 13 <> 0) v USING (hole_id))"""

_RUNS = """
marked AS (
  SELECT * REPLACE (CASE WHEN elem_zn > 0 THEN elem_zn END AS elem_zn), low_recovery OR NOT coalesce(elem_zn > 0, false) AS spoiled FROM massed),
reasoned AS (
  SELECT *, CASE WHEN lag(sample_id) OVER w IS NULL THEN 'hole' WHEN from_m - lag(to_m) OVER w > 0.1::DOUBLE THEN 'gap' WHEN geomet_domain IS DISTINCT FROM lag(geomet_domain) OVER w THEN 'attribute:geomet_domain'
    WHEN low_recovery THEN 'low_recovery' WHEN elem_zn IS NULL THEN 'missing_primary_grade' WHEN lag(spoiled) OVER w THEN 'after_unusable' ELSE '' END AS break_reason
  FROM marked WINDOW w AS (PARTITION BY hole_id ORDER BY from_m)),
numbered AS (
  SELECT *, NOT spoiled AS usable, CAST(sum(CASE WHEN break_reason <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY hole_id ORDER BY from_m ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_no,
    CAST(sum(CASE WHEN break_reason <> '' THEN 1 ELSE 0 END) OVER (ORDER BY hole_id, from_m ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_global FROM reasoned)"""

_RUN_SUMMARY = """
summary AS (
  SELECT hole_id, run_no, min(from_m) AS from_m, max(to_m) AS to_m, count(*) AS intervals, sum(length_m) AS length_m, arg_min(break_reason, from_m) AS break_reason, bool_and(usable) AS usable, sum(mass_kg) AS mass_kg, arg_min(geomet_domain, from_m) FILTER (geomet_domain IS NOT NULL) AS geomet_domain
  FROM numbered GROUP BY hole_id, run_no)"""

_WINDOWS = """
usable AS (
  SELECT hole_id, run_no, from_m, length_m AS len, mass_kg AS mass, elem_zn AS g, row_number() OVER (PARTITION BY hole_id, run_no ORDER BY from_m) AS k FROM numbered WHERE usable AND availability <> 'UNAVAILABLE'),
sums AS (
  SELECT *, sum(len) OVER w AS cl, sum(mass) OVER w AS cm, sum(len * g) OVER w AS cg, sum(len * g * g) OVER w AS cgg FROM usable WINDOW w AS (PARTITION BY hole_id, run_no ORDER BY k ROWS UNBOUNDED PRECEDING)),
pairs AS (
  SELECT a.hole_id, a.run_no, a.from_m, b.k - a.k + 1 AS n, b.cl - a.cl + a.len AS len, b.cm - a.cm + a.mass AS mass, b.mass AS last_mass, b.cg - a.cg + a.len * a.g AS lg, b.cgg - a.cgg + a.len * a.g * a.g AS lgg
  FROM sums a JOIN sums b ON a.hole_id = b.hole_id AND a.run_no = b.run_no AND b.k >= a.k AND b.cl - a.cl + a.len <= 20.005::DOUBLE),
valid AS (
  SELECT *, lg / len AS mean, sqrt(greatest(lgg / len - (lg / len) ** 2, 0)) / (lg / len) AS cv FROM pairs WHERE len >= 6 AND mass >= 40 AND (n = 1 OR mass - last_mass <= 75)),
rated AS (SELECT *, least(mass / 50, 1.25::DOUBLE) / (1 + cv) AS quality FROM valid WHERE cv <= 1 AND mean >= 0 AND mean <= 200000)"""

_TESTWORK = """
testwork AS (SELECT s_suppkey AS hole_id, 4.0::DOUBLE AS a, 18.0::DOUBLE AS b, 'T' || s_suppkey AS sample_id, CASE WHEN s_suppkey % 9 = 0 THEN 'VOLCANIC' END AS own FROM supplier WHERE s_suppkey % 3 = 0)"""

_MODAL = """
met AS (SELECT t.sample_id, d.geomet_domain, count(*) AS n FROM testwork t JOIN domained d ON t.hole_id = d.hole_id AND d.to_m > t.a AND d.from_m < t.b WHERE d.geomet_domain IS NOT NULL GROUP BY 1, 2),
modal AS (SELECT sample_id, geomet_domain FROM met QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, geomet_domain) = 1),
placed_work AS (SELECT t.sample_id, coalesce(t.own, m.geomet_domain) AS domain FROM testwork t LEFT JOIN modal m USING (sample_id))"""

_SPELLED = """
numbered_assay AS (SELECT *, CAST(round(from_m * 100) AS BIGINT) + hole_id AS k FROM plain_assay),
whole AS (
  SELECT hole_id, from_m, to_m, sample_id, low_recovery, CASE k % 50 WHEN 1 THEN 50 WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE elem_zn END AS elem_zn, CASE WHEN k % 20 = 7 THEN 2.7 ELSE density END AS density FROM numbered_assay)"""

_IN_BLOCKS = """
middles AS (SELECT p.sample_id, p.x, p.y, p.z FROM placed p WHERE what = 'mid'),
closest AS (
  SELECT m.sample_id, any_value(m.x) AS px, any_value(m.y) AS py, any_value(m.z) AS pz, arg_min({'x': b.x, 'y': b.y, 'z': b.z, 'rock': b.rock, 'period': b.period}, {'d': (m.x - b.x) ** 2 + (m.y - b.y) ** 2 + (m.z - b.z) ** 2, 'block': b.block}) AS b
  FROM middles m, blocks b GROUP BY 1),
housed AS (SELECT *, NOT (abs(px - b.x) <= 20 + 1e-6 AND abs(py - b.y) <= 30 + 1e-6 AND abs(pz - b.z) <= 50 + 1e-6) AS outside FROM closest)"""

_SAME_BIN = """
binned AS (SELECT *, CASE WHEN g >= 0 AND g < 20011 THEN 'LOW' WHEN g >= 20011 AND g < 60013 THEN 'MED' WHEN g >= 60013 AND g < 200000 THEN 'HIGH' END AS bin FROM usable),
modal_bin AS (SELECT hole_id, run_no, bin FROM (SELECT hole_id, run_no, bin, count(*) AS n FROM binned WHERE bin IS NOT NULL GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY hole_id, run_no ORDER BY n DESC, bin) = 1),
in_bin AS (
  SELECT r.*, CASE WHEN mean >= 0 AND mean < 20011 THEN 'LOW' WHEN mean >= 20011 AND mean < 60013 THEN 'MED' WHEN mean >= 60013 AND mean <= 200000 THEN 'HIGH' END AS grade_bin FROM rated r)"""

_TEXTS = """
texts0 AS (SELECT event_id, event_id % 12 AS k, CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) AS cents FROM events),
texts AS (
  SELECT event_id, CASE k WHEN 0 THEN '' WHEN 1 THEN '-99.00' WHEN 2 THEN 'NA' WHEN 3 THEN '<0.01' WHEN 4 THEN '< ' || cents WHEN 5 THEN 'nan' WHEN 6 THEN '-5' WHEN 7 THEN '1.5d' WHEN 8 THEN ' ' || chr(9) || cents || chr(9) WHEN 9 THEN cents || 'e2' ELSE cents END AS t FROM texts0),
plain AS (
  SELECT event_id, t, CASE WHEN regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(t AS DOUBLE) END AS n,
    CASE WHEN regexp_full_match(t, '<\\s*([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?') THEN CAST(trim(substr(t, 2)) AS DOUBLE) END AS lim FROM (SELECT event_id, trim(t, ' ' || chr(9)) AS t FROM texts)),
grades AS (
  SELECT *, CASE WHEN t = '' THEN 'blank' WHEN upper(t) IN ('-99', 'NA') OR n = -99 THEN 'declared_null' WHEN lim IS NOT NULL THEN 'below_detection' WHEN n IS NULL THEN 'unparsed' WHEN n < 0 THEN 'negative' ELSE 'ok' END AS state FROM plain)"""


_HOT = """
hot AS (
  SELECT CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_suppkey + 1 END AS hole_id, CAST(l_orderkey * 1500 + (l_linenumber - 1) * 200 AS DOUBLE) / 100 AS from_m,
    CAST(l_orderkey * 1500 + (l_linenumber - 1) * 200 + CASE WHEN l_quantity > 8 THEN 200 ELSE 180 END AS DOUBLE) / 100 AS to_m, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS sample_id,
    CASE WHEN l_discount > 0 THEN l_discount * CAST(1e6 AS DOUBLE) END AS elem_zn, l_quantity < 3 AS low_recovery, l_returnflag AS rock FROM lineitem)"""

_HOT_RUNS = """
hot_reasoned AS (
  SELECT *, low_recovery OR elem_zn IS NULL AS spoiled, CASE WHEN row_number() OVER w = 1 THEN 'hole' WHEN from_m - lag(to_m) OVER w > 0.25::DOUBLE THEN 'gap' WHEN rock IS DISTINCT FROM lag(rock) OVER w THEN 'attribute:rock'
    WHEN low_recovery THEN 'low_recovery' WHEN elem_zn IS NULL THEN 'missing_primary_grade' WHEN lag(low_recovery OR elem_zn IS NULL) OVER w THEN 'after_unusable' ELSE '' END AS break_reason
  FROM hot WINDOW w AS (PARTITION BY hole_id ORDER BY from_m, to_m, sample_id, elem_zn NULLS FIRST, rock, low_recovery)),
hot_runs AS (
  SELECT hole_id, sample_id, CAST(sum(CASE WHEN break_reason <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY hole_id ORDER BY from_m, to_m, sample_id, elem_zn NULLS FIRST, rock, low_recovery ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_no,
    break_reason, NOT spoiled AS usable FROM hot_reasoned)"""

_HOT_CODES = """
hot_litho AS (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_custkey % 10 + 1 END AS hole_id, CAST(o_orderkey * 15 AS DOUBLE) AS from_m, CAST(o_orderkey * 15 + 12 AS DOUBLE) AS to_m, 'L' || (o_custkey % 8) AS logged_code FROM orders),
hot_coded AS (
  SELECT h.hole_id, h.sample_id, CASE WHEN h.mid < l.to_m THEN l.logged_code END AS logged_code
  FROM (SELECT *, (from_m + to_m) / 2 AS mid FROM hot) h ASOF LEFT JOIN hot_litho l ON h.hole_id = l.hole_id AND h.mid >= l.from_m)"""

_HOT_GAPS = """
moved AS (SELECT *, from_m - lag(to_m) OVER w AS gap, from_m - max(to_m) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS deep FROM hot WINDOW w AS (PARTITION BY hole_id ORDER BY from_m, to_m))"""


def _q(select: str, *parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def _rounded(basis: str, select: str = "SELECT allocation_domain, round(raw, 5) + 0 AS target_raw, target, deficit FROM given") -> str:
    """Targets of 40 samples in proportion to `basis`, floors and largest remainders."""
    return _q(select, _BLOCKS, _TONNAGE, f"""
      shares AS (SELECT allocation_domain, coalesce(40 * b / nullif(sum(b) OVER (), 0), 0) AS raw FROM (SELECT *, {basis} AS b FROM tonnage)),
      given AS (SELECT *, target AS deficit FROM (
        SELECT *, CAST(floor(raw) + CASE WHEN row_number() OVER (ORDER BY raw - floor(raw) DESC, allocation_domain) <= 40 - sum(floor(raw)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS target FROM shares))""")


_SEGMENTED = (_ASSAY, _LITHO, _CODED, _MASSED, _RUNS)
_COUNTS = "SELECT severity, \"check\", CAST(n AS BIGINT) AS count FROM found WHERE n > 0"


def _issues(base: str, *checks: tuple[str, str, str], extra: tuple[str, ...] = ()) -> str:
    rows = " UNION ALL ".join(f"SELECT '{s}' AS severity, '{c}' AS \"check\", count(*) AS n FROM {base} WHERE {p}" for s, c, p in checks)
    return _q(_COUNTS, *extra, f"\nfound AS ({rows})")


_MOVED = """
moved0 AS (SELECT hole_id, CASE elem_zn WHEN 10000 THEN from_m - 0.3::DOUBLE WHEN 20000 THEN from_m + 0.05::DOUBLE WHEN 50000 THEN from_m + 0.3::DOUBLE ELSE from_m END AS from_m, CASE WHEN elem_zn <> 80000 THEN to_m END AS to_m FROM assay),
moved AS (SELECT *, from_m - lag(to_m) OVER w AS gap, from_m - max(to_m) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS deep FROM moved0 WINDOW w AS (PARTITION BY hole_id ORDER BY from_m NULLS FIRST, to_m NULLS FIRST))"""

_SPACES = SPACES.replace("'", "''")

ORACLES: dict[str, str] = {
    "csv_line_breaks": f"SELECT doc_id, coalesce(trim(lang, '{_SPACES}'), '') AS lang, CAST(length(t) AS BIGINT) AS chars, sha256(t) AS sha256 FROM (SELECT *, coalesce(trim(text, '{_SPACES}'), '') AS t FROM documents)",
    "interval_split": _q("SELECT hole_id, sample_id, round(from_m, 2) + 0 AS from_m, round(to_m, 2) + 0 AS to_m, round(elem_zn, 2) + 0 AS elem_zn FROM pieces", _ASSAY, _LITHO, _PIECES),
    "interval_split_lengths": _q("SELECT hole_id, count(*) AS pieces, round(sum(to_m - from_m), 4) AS metres FROM pieces GROUP BY 1", _ASSAY, _LITHO, _PIECES),
    "asof_litho_domain": _q("SELECT sample_id, logged_code, geomet_domain FROM domained", _ASSAY, _LITHO, _CODED),
    "unmapped_codes": _q("SELECT logged_code, count(*) AS n FROM domained WHERE logged_code IS NOT NULL AND geomet_domain IS NULL GROUP BY 1", _ASSAY, _LITHO, _CODED),
    "sample_ids_suffix": _q("SELECT sample_id, CASE WHEN count(*) OVER (PARTITION BY sample_id) > 1 THEN sample_id || '_' || row_number() OVER (PARTITION BY sample_id ORDER BY from_m) ELSE sample_id END AS interval_id, round(from_m, 2) + 0 AS from_m FROM pieces", _ASSAY, _LITHO, _PIECES),
    "desurvey_stations": _q("SELECT hole_id, round(depth, 2) + 0 AS depth, round(x, 4) + 0 AS x, round(y, 4) + 0 AS y, round(z, 4) + 0 AS z FROM stations", _SURVEY),
    "desurvey_midpoints": _q("SELECT sample_id, round(x, 3) + 0 AS x_mid, round(y, 3) + 0 AS y_mid, round(z, 3) + 0 AS z_mid FROM placed WHERE what = 'mid'", _ASSAY, _SURVEY, _PLACED),
    "planned_discretise": "SELECT s_suppkey AS hole_id, k * 4.0::DOUBLE AS from_m, (k + 1) * 4.0::DOUBLE AS to_m FROM supplier, range(0, 60) t(k) WHERE (k + 1) * 4 <= 100 + s_suppkey % 7 * 10.5 + 1e-6",
    "hole_ends_orientation": _q("SELECT hole_id, round(arg_min(z, from_m) FILTER (what = 'from'), 3) + 0 AS collar_z, round(arg_max(z, to_m) FILTER (what = 'to'), 3) + 0 AS toe_z, arg_max(z, to_m) FILTER (what = 'to') > arg_min(z, from_m) FILTER (what = 'from') + 1e-6 AS rises FROM placed GROUP BY 1", _ASSAY, _SURVEY, _PLACED),
    "block_assign_nearest": _q("SELECT point_id, CASE WHEN NOT outside THEN near END AS block, outside AS outside_model FROM assigned", _BLOCKS, _POINTS),
    "block_assign_mixed": _q("SELECT point_id, CASE WHEN NOT outside THEN near END AS block, outside AS outside_model FROM in_mixed", _BLOCKS, _POINTS, _MIXED),
    "nearest_neighbours": """WITH places AS (
      SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN (p_partkey * 31) % 97 / 100.0::DOUBLE ELSE (p_partkey * 7919) % 10007 END AS x, CASE WHEN p_partkey % 5 = 0 THEN (p_partkey * 17) % 89 / 100.0::DOUBLE ELSE (p_partkey * 1299) % 9973 END AS y,
        CASE WHEN p_partkey % 5 = 0 THEN (p_partkey * 7) % 11 / 100.0::DOUBLE ELSE (p_partkey * 389) % 4999 END AS z FROM part)
      SELECT a.k AS place_id, round(sqrt(min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)), 6) + 0 AS nearest_m FROM places a JOIN places b ON a.k <> b.k GROUP BY a.k""",
    "outside_model_fraction": _q("SELECT round(avg(CAST(outside AS INT)), 9) + 0 AS outside_fraction FROM assigned", _BLOCKS, _POINTS),
    "resolve_attributes": "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_brand[1:7] END, CASE WHEN p_partkey % 3 <> 0 THEN upper(p_brand[1:8]) END) AS attr_rock FROM part",
    "domain_match_rate": "SELECT CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 THEN upper(p_brand[1:7]) = upper(p_brand[1:8]) END AS domain_match, count(*) AS n FROM part GROUP BY 1",
    "grade_bins": _q("SELECT grade_bin, count(*) AS n FROM labelled GROUP BY 1", _BLOCKS),
    "allocation_domain_labels": _q("SELECT block, allocation_domain FROM domains", _BLOCKS),
    "interval_mass_fail_closed": _q("SELECT sample_id, availability, round(mass_kg, 5) + 0 AS mass_kg FROM massed", _ASSAY, _LITHO, _CODED, _MASSED),
    "prior_testwork_overlap": _q("SELECT a.sample_id AS interval_id, count(t.sample_id) > 0 AS prior_testwork, coalesce(string_agg(t.sample_id, ',' ORDER BY t.sample_id), '') AS ids FROM assay a LEFT JOIN testwork t ON a.hole_id = t.hole_id AND t.b > a.from_m + 1e-6 AND t.a < a.to_m - 1e-6 GROUP BY 1", _ASSAY, _TESTWORK),
    "testwork_modal_domain": _q("SELECT sample_id, domain FROM placed_work", _ASSAY, _LITHO, _CODED, _TESTWORK, _MODAL),
    "existing_coverage": _q("SELECT domain AS allocation_domain, count(*) AS existing FROM placed_work WHERE domain IS NOT NULL GROUP BY 1", _ASSAY, _LITHO, _CODED, _TESTWORK, _MODAL),
    "run_segmentation": _q("SELECT sample_id, 'R' || lpad(CAST(run_global AS VARCHAR), 6, '0') AS run_id, break_reason, usable FROM numbered", *_SEGMENTED),
    "run_break_reasons": _q("SELECT break_reason, count(*) AS n FROM numbered GROUP BY 1", *_SEGMENTED),
    "run_summary": _q("SELECT hole_id, run_no, round(from_m, 2) + 0 AS from_m, round(to_m, 2) + 0 AS to_m, intervals, round(length_m, 3) + 0 AS length_m, break_reason, usable, round(mass_kg, 4) + 0 AS mass_kg, geomet_domain FROM summary", *_SEGMENTED, _RUN_SUMMARY),
    "short_runs": _q("SELECT CASE WHEN length_m < 6.004 THEN 'run_too_short' ELSE 'run_too_light' END AS reason, count(*) AS n FROM summary WHERE usable AND (length_m < 6.004 OR mass_kg < 40) GROUP BY 1", *_SEGMENTED, _RUN_SUMMARY),
    "hot_hole_runs": _q("SELECT * FROM hot_runs", _HOT, _HOT_RUNS),
    "hot_hole_codes": _q("SELECT * FROM hot_coded", _HOT, _HOT_CODES),
    "hot_hole_gaps": _issues("moved", ("ERROR", "interval_overlap", "gap < -1e-9"), ("INFO", "interval_overlap_nested", "deep < -1e-9 AND NOT coalesce(gap < -1e-9, false) AND gap IS NOT NULL"),
      ("INFO", "interval_gap", "gap > 1e-9 AND gap <= 0.25::DOUBLE"), ("WARN", "interval_gap", "gap > 0.25::DOUBLE"), extra=(_HOT, _HOT_GAPS)),
    "project_issues": _q("""SELECT severity, "check", source, CAST(n AS BIGINT) AS count FROM (
      SELECT 'WARN' AS severity, 'density_fallback' AS "check", 'assay' AS source, count(*) AS n FROM numbered_assay WHERE k % 20 = 7 UNION ALL SELECT 'INFO', 'below_detection', 'assay', count(*) FROM numbered_assay WHERE k % 50 = 1
      UNION ALL SELECT 'INFO', 'null_value', 'assay', count(*) FROM numbered_assay WHERE k % 50 = 2 UNION ALL SELECT 'ERROR', 'value_unparseable', 'assay', count(*) FROM numbered_assay WHERE k % 50 = 3
      UNION ALL SELECT 'WARN', 'beyond_total_depth', 'assay', count(*) FROM plain_assay WHERE to_m > 820 + 1e-6 UNION ALL SELECT 'INFO', 'period_unscheduled', 'block_model', count(*) FROM blocks WHERE period = ''
      UNION ALL SELECT 'ERROR', 'logged_code_unmapped', 'domain_lookup', count(DISTINCT logged_code) FROM litho WHERE logged_code NOT IN (SELECT logged_code FROM lookup)) WHERE n > 0""",
      _ASSAY.replace("assay AS (", "plain_assay AS ("), _LITHO, _SPELLED, _BLOCKS),
    "project_faults": _q("""SELECT severity, "check", source, CAST(sum(n) AS BIGINT) AS count FROM (
      SELECT 'WARN' AS severity, 'density_fallback' AS "check", 'assay' AS source, count(*) AS n FROM numbered_assay WHERE k % 20 = 7 UNION ALL SELECT 'INFO', 'below_detection', 'assay', count(*) FROM numbered_assay WHERE k % 50 = 1
      UNION ALL SELECT 'INFO', 'null_value', 'assay', count(*) FROM numbered_assay WHERE k % 50 = 2 UNION ALL SELECT 'ERROR', 'value_unparseable', 'assay', count(*) FROM numbered_assay WHERE k % 50 = 3
      UNION ALL SELECT 'INFO', 'period_unscheduled', 'block_model', count(*) FROM blocks WHERE period = ''
      UNION ALL SELECT 'ERROR', 'logged_code_unmapped', 'domain_lookup', count(DISTINCT logged_code) FROM litho WHERE logged_code NOT IN (SELECT logged_code FROM lookup)
      UNION ALL SELECT 'ERROR', 'domain_lookup_duplicate', 'domain_lookup', 2 UNION ALL SELECT 'WARN', 'sample_id_blank', 'assay', count(*) FROM numbered_assay WHERE k % 30 = 3
      UNION ALL SELECT 'ERROR', 'availability_unmapped', 'availability', count(*) FROM supplier WHERE s_suppkey % 13 <> 0 AND s_suppkey % 7 = 1
      UNION ALL SELECT 'WARN', 'dip_sign', 'survey', CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM supplier UNION ALL SELECT 'INFO', 'tier2_fallback', 'collar', 1 UNION ALL SELECT 'INFO', 'tier2_fallback', 'assay', 1) WHERE n > 0 GROUP BY 1, 2, 3""",
      _ASSAY.replace("assay AS (", "plain_assay AS ("), _LITHO, _SPELLED, _BLOCKS),
    "dq_geometry": _q("""SELECT severity, "check", CAST(n AS BIGINT) AS count FROM (
      SELECT 'WARN' AS severity, 'coordinates_missing' AS "check", count(*) AS n FROM rows WHERE k = 4 UNION ALL SELECT 'ERROR', 'geometry_unit_mismatch', count(*) FROM rows WHERE k = 0 UNION ALL SELECT 'ERROR', 'geometry_unit_mismatch', count(*) FROM rows WHERE k = 1
      UNION ALL SELECT 'WARN', 'geometry_length_mismatch', count(*) FROM rows WHERE k = 2 UNION ALL SELECT 'WARN', 'geometry_midpoint_offset', count(*) FROM rows WHERE k IN (2, 3)
      UNION ALL SELECT 'WARN', 'geometry_discontinuous', count(*) FROM rows WHERE prev IS NOT NULL AND (k = 2 OR k = 5 AND from_m >= 50 AND prev < 50)
      UNION ALL SELECT 'WARN', 'hole_changes_vertical_direction', count(*) FROM (SELECT hole_id FROM rows WHERE k = 5 GROUP BY 1 HAVING min(from_m) < 50 AND max(from_m) >= 50)) WHERE n > 0""",
      _ASSAY, " rows AS (SELECT *, hole_id % 7 AS k, lag(from_m) OVER (PARTITION BY hole_id ORDER BY from_m) AS prev FROM assay)"),
    "dq_direction": """SELECT severity, "check", CAST(n AS BIGINT) AS count FROM (
      SELECT 'INFO' AS severity, 'hole_rises_with_depth' AS "check", count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_suppkey % 3 = 0 UNION ALL SELECT 'INFO', 'hole_rises_with_depth', count(DISTINCT l_suppkey) FROM lineitem
      UNION ALL SELECT 'WARN', 'most_holes_rise', CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM lineitem UNION ALL SELECT 'WARN', 'most_holes_rise', CASE WHEN avg(CASE WHEN h % 3 = 0 THEN 1 ELSE 0 END) > 0.5 THEN 1 ELSE 0 END FROM (SELECT DISTINCT l_suppkey AS h FROM lineitem)) WHERE n > 0""",
    "candidate_numbers": _q("SELECT 'C' || lpad(CAST(row_number() OVER (ORDER BY hole_id, from_m, run_no) AS VARCHAR), 6, '0') AS candidate_id, hole_id, round(from_m, 2) + 0 AS from_m FROM (SELECT DISTINCT hole_id, run_no, from_m FROM rated)", *_SEGMENTED, _WINDOWS),
    "presented_grades": "SELECT p_partkey, round_even(p_partkey * 13.7::DOUBLE / 10000, 3) AS zn_pct, round_even(p_partkey * 11.3::DOUBLE / 10000, 3) AS zn_pct_wtd, round_even(p_retailprice * 50 / 34.2857142857::DOUBLE, 3) AS bm_zn_oz_t, p_brand AS bm_rock, lower(p_brand) AS rock FROM part",
    "parse_issue_values": _q("""SELECT CASE c.state WHEN 'declared_null' THEN 'null_value' WHEN 'unparsed' THEN 'value_unparseable' WHEN 'negative' THEN 'grade_negative' ELSE c.state END AS "check",
      'zn: ' || top || CASE WHEN different > 5 THEN ' and ' || (different - 5) || ' more' ELSE '' END || '; lines ' || lines AS message FROM (SELECT state, count(DISTINCT t) AS different FROM said GROUP BY 1) c JOIN tops USING (state) JOIN firsts USING (state)""", _TEXTS, """
      said AS (SELECT g.event_id, x.t, g.state FROM grades g JOIN texts x USING (event_id) WHERE g.state NOT IN ('ok', 'blank')),
      ranked AS (SELECT state, t, count(*) AS n, min(event_id) AS first FROM said GROUP BY 1, 2),
      tops AS (SELECT state, string_agg(chr(39) || t || chr(39) || ' x ' || n, ', ' ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY n DESC, first, t) AS r FROM ranked) WHERE r <= 5 GROUP BY 1),
      firsts AS (SELECT state, string_agg(CAST(event_id + 2 AS VARCHAR), ', ' ORDER BY event_id) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY event_id) AS r FROM said) WHERE r <= 5 GROUP BY 1)"""),
    "project_intervals": _q("""SELECT CASE WHEN count(*) OVER (PARTITION BY parent) > 1 THEN parent || '_' || row_number() OVER (PARTITION BY parent ORDER BY from_m) ELSE parent END AS interval_id, hole_id, round(from_m, 2) + 0 AS from_m, round(to_m, 2) + 0 AS to_m, logged_code, geomet_domain, low_recovery,
      round(elem_zn, 2) + 0 AS "elem_Zn", round(density, 4) + 0 AS density, availability, round(mass_kg, 4) + 0 AS mass_kg, round(px, 2) + 0 AS x_mid, round(py, 2) + 0 AS y_mid, round(pz, 2) + 0 AS z_mid, outside AS outside_model, CASE WHEN NOT outside THEN b.rock END AS attr_rock,
      CASE WHEN NOT outside AND b.period <> '' THEN b.period END AS period, bin AS grade_bin, upper(coalesce(CASE WHEN NOT outside THEN b.rock END, 'UNKNOWN')) || '-' || upper(coalesce(bin, 'UNKNOWN')) AS allocation_domain
      FROM (SELECT *, CASE WHEN elem_zn >= 0 AND elem_zn < 20000 THEN 'LOW' WHEN elem_zn >= 20000 AND elem_zn < 60000 THEN 'MED' WHEN elem_zn >= 60000 AND elem_zn < 200000 THEN 'HIGH' END AS bin FROM massed) JOIN housed USING (sample_id)""",
      _ASSAY.replace("assay AS (", "plain_assay AS ("), _LITHO, _SPELLED, _CUT, _CODED, _MASSED, _SURVEY, _PLACED, _BLOCKS, _IN_BLOCKS),
    "windows_same_bin": _q("SELECT hole_id, run_no, grade_bin, count(*) AS windows, CAST(sum(n) AS BIGINT) AS intervals FROM in_bin JOIN modal_bin USING (hole_id, run_no) WHERE grade_bin = bin GROUP BY 1, 2, 3", *_SEGMENTED, _WINDOWS, _SAME_BIN),
    "event_sessions": """WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      n AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM e)
      SELECT user_id, session_no, count(*) AS n, epoch_us(min(ts)) AS start_us FROM n GROUP BY 1, 2""",
    "candidate_windows": _q("SELECT hole_id, run_no, count(*) AS windows, CAST(sum(n) AS BIGINT) AS intervals FROM rated GROUP BY 1, 2", *_SEGMENTED, _WINDOWS),
    "best_window_per_start": _q("SELECT hole_id, run_no, round(from_m, 2) + 0 AS from_m, round(max(quality), 5) + 0 AS quality FROM rated GROUP BY hole_id, run_no, from_m", *_SEGMENTED, _WINDOWS),
    "domain_tonnage": _q("SELECT allocation_domain, round(tonnes, 2) + 0 AS tonnes, round(weighted_tonnes, 2) + 0 AS weighted_tonnes, round(100 * tonnes / sum(tonnes) OVER (), 6) + 0 AS tonnes_pct FROM tonnage", _BLOCKS, _TONNAGE),
    "tonnage_by_period": _q("SELECT allocation_domain, period, round(sum(tonnes), 2) + 0 AS tonnes FROM domains WHERE period <> '' GROUP BY 1, 2", _BLOCKS),
    "neyman_dispersion": _q("SELECT allocation_domain, round(stddev_pop(zn), 4) + 0 AS grade_sd FROM domains WHERE period <> '' GROUP BY 1", _BLOCKS),
    "allocation_targets": _q("""SELECT allocation_domain, round(target_raw, 5) + 0 AS target_raw, round(deficit_raw, 5) + 0 AS deficit_raw,
      CAST(floor(target_raw) + CASE WHEN row_number() OVER (ORDER BY target_raw - floor(target_raw) DESC, allocation_domain) <= 40 - sum(floor(target_raw)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS target,
      CAST(floor(deficit_raw) + CASE WHEN row_number() OVER (ORDER BY deficit_raw - floor(deficit_raw) DESC, allocation_domain) <= 40 - sum(floor(deficit_raw)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS deficit FROM scaled""",
      _BLOCKS, _TONNAGE, """
      spread AS (SELECT allocation_domain, stddev_pop(zn) AS sd FROM domains WHERE period <> '' GROUP BY 1),
      basis AS (SELECT t.*, 100 * tonnes / sum(tonnes) OVER () AS pct, weighted_tonnes * sd AS basis FROM tonnage t JOIN spread USING (allocation_domain)),
      floored AS (SELECT *, CASE WHEN pct >= 1 THEN greatest(40 * basis / sum(basis) OVER (), 1) ELSE 40 * basis / sum(basis) OVER () END AS target_raw FROM basis),
      scaled AS (SELECT *, target_raw * 40 / sum(target_raw) OVER () AS deficit_raw FROM floored)"""),
    "largest_remainder": """WITH s AS (SELECT o_orderpriority, 1000.0::DOUBLE * count(*) / sum(count(*)) OVER () AS share FROM orders GROUP BY 1)
      SELECT o_orderpriority, CAST(floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, o_orderpriority) <= 1000 - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS given FROM s""",
    "dq_intervals": _issues("moved", ("ERROR", "interval_depth_missing", "from_m IS NULL OR to_m IS NULL"), ("ERROR", "interval_order", "from_m >= to_m"), ("ERROR", "interval_overlap", "gap < -1e-9"),
      ("INFO", "interval_overlap_nested", "deep < -1e-9 AND NOT coalesce(gap < -1e-9, false) AND gap IS NOT NULL"), ("INFO", "interval_gap", "gap > 1e-9 AND gap <= 0.1::DOUBLE"), ("WARN", "interval_gap", "gap > 0.1::DOUBLE"), extra=(_ASSAY, _MOVED)),
    "dq_orphans": "SELECT 'ERROR' AS severity, 'orphan_hole' AS \"check\", count(*) AS count FROM lineitem WHERE l_suppkey % 5 = 0 OR l_suppkey NOT IN (SELECT s_suppkey FROM supplier) HAVING count(*) > 0",
    "dq_beyond_depth": _q("SELECT 'WARN' AS severity, 'beyond_total_depth' AS \"check\", count(*) AS count FROM assay JOIN supplier ON hole_id = s_suppkey WHERE to_m > 700 + 1e-6 HAVING count(*) > 0", _ASSAY),
    "dq_density_range": _issues("dense", ("WARN", "density_missing", "density IS NULL"), ("ERROR", "density_range", "density < 1.5 OR density > 6"),
      extra=(_ASSAY, " dense AS (SELECT CASE WHEN density > 2.85::DOUBLE THEN density * 3 WHEN density > 2.55::DOUBLE THEN density END AS density FROM assay)")),
    "dq_survey": _issues("read", ("ERROR", "azimuth_range", "az < 0 OR az >= 360"), ("ERROR", "dip_range", "abs(dip) > 90"), ("WARN", "survey_duplicate_depth", "depth = prev"), ("WARN", "survey_incomplete", "dip IS NULL"), extra=("""
      read0 AS (SELECT s_suppkey AS hole_id, CAST(CASE WHEN i = 5 THEN 200 ELSE i * 50 END AS DOUBLE) AS depth, CASE WHEN i <> 3 THEN -60 - 5 * (s_suppkey % 4) + 0.5 * i END AS dip, (s_suppkey * 37 + i * 2) % 360 + CASE WHEN i = 2 THEN 200 ELSE 0 END AS az FROM supplier, range(0, 17) t(i)),
      read AS (SELECT *, lag(depth) OVER (PARTITION BY hole_id ORDER BY depth) AS prev FROM read0)""",)),
    "dq_framework": """SELECT 'WARN' AS severity, 'no_survey' AS "check", count(*) AS count FROM supplier WHERE s_suppkey % 17 = 0 HAVING count(*) > 0
      UNION ALL SELECT 'WARN', 'no_lithology', count(DISTINCT l_suppkey) FROM lineitem WHERE l_suppkey % 19 = 0 HAVING count(*) > 0""",
    "dq_placed": _q("""SELECT severity, "check", n AS count FROM (
      SELECT 'WARN' AS severity, 'interval_not_desurveyed' AS "check", count(*) AS n FROM domained WHERE hole_id % 17 = 0 UNION ALL SELECT 'WARN', 'interval_not_logged', count(*) FROM domained WHERE logged_code IS NULL
      UNION ALL SELECT 'ERROR', 'logged_code_unmapped', count(*) FROM domained WHERE logged_code IS NOT NULL AND geomet_domain IS NULL
      UNION ALL SELECT 'ERROR', 'logged_code_unmapped', count(DISTINCT logged_code) FROM litho WHERE logged_code NOT IN (SELECT logged_code FROM lookup)) WHERE n > 0""", _ASSAY, _LITHO, _CODED),
    "dq_extent": _q("""SELECT severity, "check", CAST(n AS BIGINT) AS count FROM (
      SELECT 'INFO' AS severity, 'outside_model' AS "check", count(*) AS n FROM assigned WHERE outside UNION ALL SELECT 'ERROR', 'off_model_extent', CASE WHEN avg(CAST(outside AS INT)) > 0.05 THEN 1 ELSE 0 END FROM assigned) WHERE n > 0""", _BLOCKS, _POINTS),
    "dq_testwork": _q("""SELECT severity, "check", CAST(n AS BIGINT) AS count FROM (
      SELECT 'WARN' AS severity, 'prior_testwork_unlocated' AS "check", count(*) AS n FROM work WHERE b IS NULL
      UNION ALL SELECT 'INFO', 'prior_testwork_excluded', count(*) FROM domained d WHERE EXISTS (SELECT 1 FROM work t WHERE t.hole_id = d.hole_id AND t.b > d.from_m + 1e-6 AND t.a < d.to_m - 1e-6)
      UNION ALL SELECT 'WARN', 'existing_testwork_undomained', count(*) FROM work t WHERE own IS NULL AND NOT EXISTS (SELECT 1 FROM domained d WHERE t.hole_id = d.hole_id AND d.to_m > t.a AND d.from_m < t.b AND d.geomet_domain IS NOT NULL)) WHERE n > 0""",
      _ASSAY, _LITHO, _CODED, _TESTWORK, " work AS (SELECT a, own, CASE WHEN hole_id % 12 <> 0 THEN b END AS b, CASE WHEN hole_id % 5 = 0 THEN -hole_id ELSE hole_id END AS hole_id FROM testwork)"),
    "dq_allocation": """SELECT * FROM (VALUES ('ERROR', 'no_scheduled_tonnage'), ('WARN', 'no_deficit'), ('WARN', 'neyman_no_block_grade'), ('WARN', 'neyman_no_dispersion'), ('ERROR', 'manual_targets_missing')) t(severity, "check"), (SELECT CAST(1 AS BIGINT) AS count)""",
    "dq_samples": """SELECT 'INFO' AS severity, 'geometry_supplied' AS "check", CAST(1 AS BIGINT) AS count UNION ALL SELECT 'INFO', 'boundaries_inherited', 1
      UNION ALL SELECT 'INFO', 'sample_split_upstream', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1) HAVING count(*) > 0""",
    "unit_mismatch_ratio": _q("""SELECT CASE WHEN f > 1 THEN 'coordinates in feet' ELSE 'depths in feet' END AS which, count(*) AS rows, round(median((to_m * f - from_m * f) / (to_m - from_m)), 6) AS median_ratio FROM (
      SELECT *, CASE WHEN hole_id % 3 = 0 THEN 1 / 0.3048::DOUBLE WHEN hole_id % 4 = 0 THEN 0.3048::DOUBLE ELSE 1 END AS f FROM assay) WHERE f <> 1 GROUP BY 1""", _ASSAY),
    "targets_proportional_risk": _rounded("weighted_tonnes * CASE allocation_domain WHEN 'BRAND#11-MED' THEN 2 WHEN 'BRAND#55-MED' THEN 0.5 ELSE 1 END::DOUBLE"),
    "targets_manual": _rounded("CASE allocation_domain WHEN 'BRAND#12-MED' THEN 3 WHEN 'BRAND#21-HIGH' THEN 1 WHEN 'BRAND#34-MED' THEN 2.5 ELSE 0 END::DOUBLE"),
    "unmet_gaps": _rounded("weighted_tonnes", """SELECT allocation_domain, deficit, coalesce(n, 0) AS achieved, deficit - coalesce(n, 0) AS missing
      FROM given LEFT JOIN (SELECT upper(p_brand) || '-MED' AS allocation_domain, count(*) % 3 AS n FROM part GROUP BY 1) USING (allocation_domain) WHERE coalesce(n, 0) < deficit"""),
    "dq_duplicates": "SELECT 'ERROR' AS severity, 'collar_duplicate' AS \"check\", count(*) AS count FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) HAVING count(*) > 0",
    "dq_blocks": _q("""SELECT severity, "check", CAST(n AS BIGINT) AS count FROM (
      SELECT 'ERROR' AS severity, 'block_dimension' AS "check", count(*) AS n FROM blocks WHERE block % 50 = 0 UNION ALL SELECT 'INFO', 'period_unscheduled', count(*) FROM blocks WHERE period = ''
      UNION ALL SELECT 'ERROR', 'block_duplicate_centroid', count(*) FROM (SELECT 1 FROM (SELECT CASE WHEN block % 40 = 0 THEN x - 40 ELSE x END AS x, y, z FROM blocks) GROUP BY x, y, z HAVING count(*) > 1)) WHERE n > 0""", _BLOCKS),
    "parse_numbers": _q("SELECT event_id, CASE WHEN state IN ('ok', 'negative') THEN n END AS value, CASE state WHEN 'below_detection' THEN 'unparsed' WHEN 'negative' THEN 'ok' ELSE state END AS state FROM grades", _TEXTS),
    "parse_grades": _q("SELECT event_id, CASE state WHEN 'ok' THEN n WHEN 'below_detection' THEN lim / 2 END AS value, state FROM grades", _TEXTS),
    "parse_issues": _q("SELECT CASE state WHEN 'declared_null' THEN 'INFO' WHEN 'below_detection' THEN 'INFO' ELSE 'ERROR' END AS severity, CASE state WHEN 'declared_null' THEN 'null_value' WHEN 'unparsed' THEN 'value_unparseable' WHEN 'negative' THEN 'grade_negative' ELSE state END AS \"check\", count(*) AS count FROM grades WHERE state NOT IN ('ok', 'blank') GROUP BY 1, 2", _TEXTS),
    "unit_conversions": "SELECT p_partkey, round(p_retailprice * 0.3048::DOUBLE, 6) AS metres, round(p_retailprice * 0.0160184634::DOUBLE, 6) AS t_m3, round(p_retailprice * 34.2857142857::DOUBLE, 4) AS ppm, round(p_retailprice / 10000, 9) AS pct, round(((12.5 - p_retailprice) % 360 + 360) % 360, 6) AS azimuth, round(pi() * (p_retailprice / 10 / 2000) ** 2, 8) AS area FROM part",
    "period_weights": """SELECT p_partkey, CASE WHEN k = 3 THEN 1.0 WHEN k = 2 THEN 0.25 WHEN p_size = 1 THEN 2.0 WHEN p_size = 4 THEN 1.5 WHEN p_size = 5 THEN 3.0 ELSE 1.0 END::DOUBLE AS weight, k < 2 AS scheduled FROM (SELECT *, p_size % 4 AS k FROM part)""",
}
