"""DuckDB SQL for the queries that SQL can express.

Left out: 1 (token-budget windows feed one of its columns), 3 (expressions are parsed), 5, 7 to 10 and 12 (hashes, models and tokenizers that
DuckDB lacks). Their tests hold them against brute-force versions, round trips and held-out rows.
"""

from __future__ import annotations

from corelode.llm.quality_rules import STOP_WORDS

_BLANK = r"[\x20\x09-\x0D]+"
_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

_QUALITY = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
split AS (
  SELECT *, list_filter(string_split_regex(text, '{_BLANK}'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base),
grams AS (SELECT r, i, words[i:i + 4] AS gram FROM split, unnest(range(1, len(words) - 3)) t(i)),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, gram) AS n FROM grams) WHERE n > 1),
hit AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 5) u(k) GROUP BY r),
figures AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_BLANK}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, len(list_filter(words, lambda x: x IN ({_STOPS}))) AS n_stop
  FROM split LEFT JOIN hit USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1200 * n_words AND 100 * n_symbols <= 10 * n_words AND 100 * (n_stop + 2) >= 6 * n_words AND 100 * n_dup_lines <= 50 * n_lines AS kept
FROM judged"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LEAKS = rf"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW.format("text")}, '{_WORD}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) t(i) WHERE len(w) > 0),
docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
spots AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM docs, (SELECT DISTINCT size FROM windows) s, unnest(range(1, len(w) - size + 2)) t(i)),
met AS (SELECT r, i, m.size, item FROM spots s JOIN windows m ON s.size = m.size AND s.gram = m.gram),
hit AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT DISTINCT r, i, size FROM met) m, unnest(range(0, size)) u(k) GROUP BY r),
names AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM met GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN names USING (r)"""

# Rows are numbered by (id, CRC-32, size). A step is one Feistel round; after four, numbers outside the range begin anew.
_SHARDS = """
WITH RECURSIVE polynomial AS (
  SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(0, 256) x(n)),
octets AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
sums AS (
  SELECT doc_id, CAST(n + 1 AS BIGINT) AS size,
    xor(list_reduce(list_transform(range(0, n), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)), lambda c, o: xor(c >> 8, t[(xor(c, o) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc
  FROM octets, polynomial),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS v, count(*) OVER () AS total FROM sums),
halved AS (SELECT v, total, greatest(1, (length(bin(greatest(total - 1, 1))) + 1) // 2) AS bits FROM numbered),
walk AS (
  SELECT v, total, bits, 0 AS k, v >> bits AS l, v & ((1 << bits) - 1) AS r FROM halved
  UNION ALL
  SELECT v, total, bits, CASE WHEN k < 4 THEN k + 1 ELSE 0 END, CASE WHEN k < 4 THEN r ELSE ((l << bits) | r) >> bits END,
    CASE WHEN k < 4 THEN xor(l, CAST(xor(x, x >> 15)::HUGEINT * [668265263, 3266489917, 2246822519, 2654435761][k + 1] % 4294967296 AS BIGINT) >> 7 & ((1 << bits) - 1)) ELSE ((l << bits) | r) & ((1 << bits) - 1) END
  FROM (SELECT *, CAST((r + 20 + k)::HUGEINT * [2654435761, 2246822519, 3266489917, 668265263][least(k, 3) + 1] % 4294967296 AS BIGINT) AS x FROM walk WHERE k < 4 OR ((l << bits) | r) >= total)),
done AS (SELECT v, (l << bits) | r AS p FROM walk WHERE k = 4 AND ((l << bits) | r) < total)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(p % 8 AS INT) AS shard, p // 8 AS slot, CAST(NULL AS INT) AS grown_shard FROM numbered JOIN done USING (v)"""

_CODES = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, range(0, 4) t(p)),
first AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept),
book0 AS MATERIALIZED (SELECT p, e, x AS c FROM parts JOIN first USING (r) WHERE e < 256),
""" + "".join(f"""
near{k} AS MATERIALIZED (
  SELECT r, p, min(CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) * 256 + e) AS m
  FROM parts JOIN book{k} USING (p) GROUP BY r, p),
""" + (f"""
mean{k} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, m % 256 AS e, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM near{k} JOIN parts USING (r, p), unnest(range(1, len(x) + 1)) t(i) GROUP BY p, m % 256, i)
  GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{k}.c, book{k}.c) AS c FROM book{k} LEFT JOIN mean{k} USING (p, e)),
""" if k < 4 else "") for k in range(5)) + """
coded AS (SELECT r, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM near4 GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS d FROM book4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, d AS codebooks_sha256 FROM kept JOIN coded USING (r), digest"""

ORACLES: dict[str, str] = {"op2_quality_rules": _QUALITY, "op4_sharding": _SHARDS, "op6_decontamination": _LEAKS, "op11_vector_codes": _CODES}
