"""DuckDB SQL for those of this subpackage's queries that SQL can express."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op2_exact_dedup"] = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

ORACLE_SQL["op9_mixing"] = """
WITH c AS (SELECT source, count(*) AS n, sqrt(count(*)) AS weight FROM documents GROUP BY source),
rates AS (SELECT source, weight / sum(weight) OVER () * sum(n) OVER () / n AS rate FROM c),
steps AS (
  SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM (SELECT source, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT))) AS k FROM rates)),
drawn AS (
  SELECT doc_id, source, text, n_chars, CAST('0x' || substr(md5(doc_id || ':17'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
counted AS (
  SELECT d.doc_id, d.source, d.n_chars, d.text, CAST(count(s.k) AS INTEGER) AS n_copies
  FROM drawn d JOIN steps s ON s.source IS NOT DISTINCT FROM d.source AND s.cdf <= d.u
  GROUP BY ALL)
SELECT doc_id, source, n_copies, copy_no, md5(doc_id || ':17:' || copy_no) AS mix_key, n_chars, md5(coalesce(text, '')) AS text_md5
FROM (SELECT *, CAST(unnest(generate_series(1, n_copies)) AS INTEGER) AS copy_no FROM counted)
"""

#: A SHA-1 in hexadecimal, five digits for four characters of base32.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * j + 1}, 5) AS INTEGER) >> {shift}) & 31 AS INTEGER) + 1, 1)" for j in range(8) for shift in (15, 10, 5, 0))

ORACLE_SQL["op5_warc"] = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
k AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS keeper FROM p)
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM k
"""

ORACLE_SQL["op6_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS pos FROM d),
w AS (SELECT doc_id, pos, substr(h, 2 * pos + 1, 2) AS byte, CASE WHEN 2 * pos + 200 <= length(h) THEN substr(h, 2 * pos + 1, 200) END AS s FROM p),
f AS (SELECT doc_id, pos, byte, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) > 1 AS late FROM w),
c AS (SELECT doc_id, pos, byte, max(CAST(late AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM c),
g AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
             sha256(unhex(coalesce(string_agg(byte, '' ORDER BY pos) FILTER (NOT gone), ''))) AS kept_sha256 FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL["op7_url_rules"] = f"""
WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
t AS (SELECT *, CASE WHEN url IS NULL THEN [] ELSE list_distinct(list_concat(list_concat(list_concat(
        CASE WHEN instr(url, '://') > 1 THEN ['scheme=' || lower(split_part(url, '://', 1))] ELSE [] END,
        CASE WHEN host <> '' THEN ['host=' || host] ELSE [] END),
        list_concat(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'label=' || x),
                    list_transform(list_filter(string_split(path, '/'), lambda x: regexp_matches(x, '[A-Za-z]')), lambda x: 'segment=' || x))),
        list_concat(list_transform(list_filter(list_transform(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: split_part(x, '=', 1)), lambda x: x <> ''), lambda x: 'key=' || x),
                    CASE WHEN contains(url, '#') THEN ['fragment'] ELSE [] END))) END AS toks FROM p),
known AS (SELECT toks, quality = 0 OR toxic = 1 AS bad FROM t JOIN labels ON doc_id = page_id WHERE (quality = 0 OR toxic = 1) IS NOT NULL),
least AS (SELECT greatest(ceil(0.002 * count(*)), 5) AS c FROM known),
often AS (SELECT tok FROM (SELECT unnest(toks) AS tok FROM known WHERE bad) GROUP BY tok HAVING count(*) >= (SELECT c FROM least)),
alone AS (SELECT coalesce(list(tok), []) AS held FROM often),
cut AS (SELECT list_sort(list_filter(toks, lambda x: list_contains(held, x))) AS ts FROM known, alone WHERE bad),
sets AS (SELECT list_filter(ts, lambda x, i: (m >> (i - 1)) & 1 = 1) AS s FROM (SELECT ts, unnest(generate_series(1, (1 << len(ts)) - 1)) AS m FROM cut WHERE len(ts) > 0)),
frequent AS (SELECT s, count(*) AS n FROM sets GROUP BY s HAVING count(*) >= (SELECT c FROM least)),
rules AS (SELECT s FROM frequent JOIN known ON list_has_all(toks, s) GROUP BY s, n HAVING n >= 0.5 * count(*)),
blocked AS (SELECT DISTINCT page_id FROM t JOIN rules ON list_has_all(toks, s)),
fits AS (SELECT t.*, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM t)
SELECT f.page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN b.page_id IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM fits f LEFT JOIN blocked b ON b.page_id = f.page_id
"""

ORACLE_SQL["op10_cross_entropy"] = f"""
WITH good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
d AS (SELECT row_number() OVER () AS r, d.doc_id, g.doc_id IS NOT NULL AS target, regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') AS ws
      FROM documents d LEFT JOIN good g ON g.doc_id = d.doc_id),
k AS (SELECT r, target, unnest(ws) AS w, unnest(list_concat([''], ws[1:len(ws) - 1])) AS h FROM d WHERE len(ws) > 0),
one AS (SELECT w, count(*) AS b, count(*) FILTER (target) AS t FROM k GROUP BY w),
ctx AS (SELECT h, count(*) AS b, count(*) FILTER (target) AS t FROM k GROUP BY h),
two AS (SELECT h, w, count(*) AS b, count(*) FILTER (target) AS t FROM k GROUP BY h, w),
n AS (SELECT sum(b) AS b, sum(t) AS t, 0.1::DOUBLE * (count(*) + 1) AS mass FROM one),
l AS (SELECT r, avg(-ln((two.t + 200 * (one.t + 0.1::DOUBLE) / (n.t + n.mass)) / (ctx.t + 200))) AS tl,
             avg(-ln((two.b + 200 * (one.b + 0.1::DOUBLE) / (n.b + n.mass)) / (ctx.b + 200))) AS bl
      FROM k JOIN one USING (w) JOIN ctx USING (h) JOIN two ON two.h = k.h AND two.w = k.w, n GROUP BY r)
SELECT doc_id, len(ws) AS n_tokens, round(tl, 9) AS target_loss, round(bl, 9) AS background_loss, round(tl - bl, 9) AS score
FROM d LEFT JOIN l USING (r)
"""
