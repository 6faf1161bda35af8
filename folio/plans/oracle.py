"""The same results in DuckDB SQL, written independently of the Spark expressions."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

DOCS = """docs AS (
  SELECT doc_id AS id, source AS book, ['document','skill','styleguide','memory'][CAST(doc_id % 4 + 1 AS INTEGER)] AS namespace,
         ['document','skill','styleguide','memory'][CAST(doc_id % 4 + 1 AS INTEGER)] || '/d' || doc_id AS concept_id,
         lang AS language, text, [lang, 't' || (doc_id % 5)] AS tags
  FROM documents)"""


def bm25(query: list[str], k: int, where: str = "true", name: str = "lex") -> str:
    terms = ", ".join(f"'{t}'" for t in query)
    return f"""toks AS (SELECT id, book, language, regexp_extract_all(lower(strip_accents(text || ' ' || concept_id)), '[\\p{{L}}\\p{{N}}]+') AS ts FROM docs),
asked AS (SELECT term, count(*) AS times FROM (SELECT unnest([{terms}]) AS term) GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM toks),
tf AS (SELECT id, book, language, len(ts) AS dl, term, times, len(list_filter(ts, lambda x: x = term)) AS f FROM toks, asked),
df AS (SELECT term, count(*) FILTER (f > 0) AS df FROM tf GROUP BY term),
{name} AS (
  SELECT id, sum(times * (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END)
             * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean))) AS score
  FROM tf JOIN df USING (term), st WHERE f > 0 AND ({where}) GROUP BY id ORDER BY score DESC, id LIMIT {k})"""


Q = "and the erst onnd thor the".split()
VEC = """vec AS (
  SELECT vec_id AS id, 0::DOUBLE - list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS score
  FROM embeddings ORDER BY score DESC, id LIMIT 32)"""

ORACLE_SQL["bm25_topk"] = f"WITH {DOCS}, {bm25(Q, 32)} SELECT id, round(score, 6) AS score FROM lex"
ORACLE_SQL["ranges_topk"] = f"WITH {DOCS}, {bm25(['the', 'of', 'and'], 16)} SELECT id, round(score, 6) AS score FROM lex"
ORACLE_SQL["incremental_search"] = f"""WITH {DOCS.replace('docs AS', 'every AS', 1)},
docs AS (SELECT coalesce(book, 'none') || '/' || namespace || '/' || concept_id || '#0' AS id, book, language, text, concept_id FROM every WHERE text IS NOT NULL), {bm25(Q, 32)}
SELECT id, round(score, 6) AS score FROM lex"""
ORACLE_SQL["knn_l2_topk"] = f"WITH {VEC} SELECT id, round(score, 6) AS score FROM vec"
ORACLE_SQL["hybrid_rrf"] = f"""WITH {DOCS}, {bm25(Q, 32)}, {VEC},
legs AS (
  SELECT id, rank() OVER (ORDER BY CAST(score AS FLOAT) DESC) - 1 AS r, row_number() OVER (ORDER BY score DESC, id) AS seen FROM vec
  UNION ALL SELECT id, rank() OVER (ORDER BY CAST(score AS FLOAT) DESC) - 1, 1000 + row_number() OVER (ORDER BY score DESC, id) FROM lex)
SELECT id, round(sum(1::DOUBLE / (60 + r)), 6) AS score FROM legs GROUP BY id ORDER BY sum(1::DOUBLE / (60 + r)) DESC, min(seen), id LIMIT 8"""
ORACLE_SQL["filtered_search"] = f"""WITH {DOCS}, {bm25(['und', 'der', 'einheit'], 10, "language = 'de' AND book IN ('src0','src1','src2','src3')")}
SELECT id, round(score, 6) AS score FROM lex"""
ORACLE_SQL["empty_filter_list"] = f"WITH {DOCS}, {bm25(Q, 10, 'false')} SELECT id, round(score, 6) AS score FROM lex"
ORACLE_SQL["tag_overlap_filter"] = f"WITH {DOCS} SELECT id, book FROM docs WHERE list_has_any(tags, ['fr', 't3'])"
ORACLE_SQL["rules_dedup_best_passage"] = f"""WITH {DOCS}, {bm25(Q, 64)},
best AS (SELECT lex.id, score, book FROM lex JOIN docs USING (id) QUALIFY row_number() OVER (PARTITION BY book ORDER BY score DESC, lex.id) = 1)
SELECT id, round(score, 6) AS score, book, row_number() OVER (ORDER BY score DESC, id) - 1 AS place FROM best ORDER BY score DESC, id LIMIT 8"""
ORACLE_SQL["unique_concept_ranks"] = f"""WITH {DOCS}, {bm25(Q, 200)},
best AS (SELECT lex.id, score, book || '/' || language AS uri FROM lex JOIN docs USING (id) QUALIFY row_number() OVER (PARTITION BY book, language ORDER BY score DESC, lex.id) = 1)
SELECT uri, row_number() OVER (ORDER BY score DESC, id) AS rank FROM best"""

ORACLE_SQL["advisory_rerank"] = f"""WITH {DOCS}, {bm25(Q, 20)},
h AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS place FROM lex),
p AS (SELECT *, CASE WHEN place % 3 <> 1 THEN (id % 7) / 7.0::DOUBLE END AS p FROM h)
SELECT id, place, round(p, 6) AS p, row_number() OVER (ORDER BY place >= 8, CASE WHEN place < 8 THEN p END DESC NULLS LAST, place) - 1 AS at FROM p"""

EVAL = f"""{DOCS},
expected AS (SELECT item_id AS query, id AS uri FROM docs, benchmark b WHERE contains(docs.text, b.text)),
bt AS (SELECT item_id AS query, regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}]+')[1:32] AS ts FROM benchmark),
asked AS (SELECT query, term, count(*) AS times FROM (SELECT query, unnest(ts) AS term FROM bt) GROUP BY ALL),
toks AS (SELECT id, regexp_extract_all(lower(strip_accents(text || ' ' || concept_id)), '[\\p{{L}}\\p{{N}}]+') AS ts FROM docs),
st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM toks),
post AS (SELECT id, dl, term, count(*) AS f FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM toks) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (
  SELECT query, id AS uri, sum(times * (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END)
    * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean))) AS score
  FROM post JOIN df USING (term) JOIN asked USING (term), st GROUP BY query, id),
ranking AS (SELECT query, uri, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, uri) AS rank FROM scored QUALIFY rank <= 40),
per AS (
  SELECT query, count(*) FILTER (rank <= 1)::DOUBLE / count(*) AS r1, count(*) FILTER (rank <= 5)::DOUBLE / count(*) AS r5,
         count(*) FILTER (rank <= 10)::DOUBLE / count(*) AS r10, coalesce(1::DOUBLE / min(rank), 0) AS rr
  FROM expected LEFT JOIN ranking USING (query, uri) GROUP BY query)"""
ORACLE_SQL["eval_recall_mrr"] = f"""WITH {EVAL}
SELECT count(*) AS queries, round(avg(r1), 6) AS recall_1, round(avg(r5), 6) AS recall_5, round(avg(r10), 6) AS recall_10, round(avg(rr), 6) AS mrr FROM per"""
ORACLE_SQL["eval_threshold_checks"] = f"""WITH {EVAL}
SELECT 'recall_5' AS metric, round(avg(r5), 6) AS observed, 0.95::DOUBLE AS floor, avg(r5) + 1e-6 >= 0.95 AS passed FROM per
UNION ALL SELECT 'mrr', round(avg(rr), 6), 0.5::DOUBLE, avg(rr) + 1e-6 >= 0.5 FROM per"""
ORACLE_SQL["eval_label_hygiene"] = "SELECT doc_id * 3 AS uri FROM labels EXCEPT SELECT doc_id FROM documents"
ORACLE_SQL["eval_absent_window"] = f"WITH {EVAL} SELECT query, uri, rank FROM ranking WHERE rank IN (2, 7) AND rank <= 5"

MD = """md AS (
  SELECT doc_id AS id, '# ' || source || chr(10) || chr(10) || left(text, length(text) // 2) || chr(10) || chr(10) || '## ' || lang
         || chr(10) || chr(10) || substr(text, length(text) // 2 + 1) AS body
  FROM documents)"""
_WORD = r"[^\s\p{Z}\x{85}]+"
_INVISIBLE = r"[\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]"
#: The cut as two recursions: over the lines of blocks that exceed the room, and over runs of blocks that don't.
ORACLE_SQL["chunk_passages"] = f"""WITH RECURSIVE {MD}, src AS (SELECT doc_id AS id, source, 1 + len(regexp_extract_all(source, '{_WORD}')) AS tw FROM documents),
ln AS (SELECT id, unnest(string_split(body, chr(10))) AS line, unnest(range(0, len(string_split(body, chr(10))))) AS n FROM md),
hd AS (SELECT *, length(regexp_extract(line, '^ {{0,3}}(#{{1,6}})[ \t]', 1)) AS level, trim(regexp_replace(trim(regexp_extract(line, '^ {{0,3}}#{{1,6}}[ \t]+(.*)$', 1)), '(^|[ \t]+)#+$', '')) AS title FROM ln),
w0 AS (SELECT id, n, line, len(regexp_extract_all(line, '{_WORD}')) AS w, title <> '' AS head, level, title, CAST(count(*) FILTER (title <> '') OVER (PARTITION BY id ORDER BY n) AS INTEGER) AS s0 FROM hd),
hs AS (SELECT id, s0, level, title FROM w0 WHERE head),
paths AS (SELECT i.id, i.s0 AS sec, string_agg(j.title, ' › ' ORDER BY j.s0) AS path FROM hs i JOIN hs j ON j.id = i.id AND j.s0 <= i.s0
  WHERE NOT EXISTS (SELECT 1 FROM hs k WHERE k.id = i.id AND k.s0 > j.s0 AND k.s0 <= i.s0 AND k.level <= j.level) GROUP BY i.id, i.s0),
bare AS (SELECT id, s0, coalesce(sum(w) FILTER (NOT head), 0) = 0 AS bare FROM w0 GROUP BY id, s0),
joined AS (SELECT id, s0, coalesce(min(s0) FILTER (NOT bare) OVER (PARTITION BY id ORDER BY s0 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(s0) FILTER (NOT bare) OVER (PARTITION BY id), max(s0) OVER (PARTITION BY id)) AS sec FROM bare),
w AS (SELECT id, n, line, w, head, sec FROM w0 JOIN joined USING (id, s0)),
doc AS (SELECT id, coalesce(max(n) FILTER (w > 0), 0) AS b, (4 * tw + 2) // 3 + (4 * sum(w) + 2) // 3 + 4 <= 220 AS fits FROM w JOIN src USING (id) GROUP BY id, tw),
sec AS (SELECT id, sec, min(n) AS a, max(n) FILTER (w > 0) AS b, CAST(sum(w) AS BIGINT) AS words, (4 * (tw + 1 + len(regexp_extract_all(path, '{_WORD}'))) + 2) // 3 AS p FROM w JOIN src USING (id) JOIN doc USING (id) JOIN paths USING (id, sec) WHERE NOT fits GROUP BY id, sec, tw, path),
open AS (SELECT id, sec, greatest(216 - p, 32) AS room FROM sec WHERE p + (4 * words + 2) // 3 + 4 > 220),
runs AS (SELECT id, sec, room, n - row_number() OVER (PARTITION BY id, sec ORDER BY n) AS run, n, w, head FROM w JOIN open USING (id, sec) WHERE w > 0),
span AS (SELECT id, sec, room, min(n) AS a, max(n) AS b, CAST(sum(w) AS BIGINT) AS words, bool_and(head) AND count(*) = 1 AS head, row_number() OVER (PARTITION BY id, sec ORDER BY run) AS r, count(*) OVER (PARTITION BY id, sec) AS total FROM runs GROUP BY id, sec, room, run),
block_of AS (SELECT *, min(r) FILTER (NOT head OR r = total) OVER (PARTITION BY id, sec ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g FROM span),
blk AS (SELECT id, sec, room, min(a) AS a, max(b) AS b, CAST(sum(words) AS BIGINT) AS words, row_number() OVER (PARTITION BY id, sec ORDER BY min(a)) AS k, (4 * sum(words) + 2) // 3 > room AS big
        FROM block_of GROUP BY id, sec, room, g),
cut AS (SELECT id, sec, k, room, b, a AS i, a AS start, w.w AS words, CASE WHEN head THEN 0 ELSE w.w END AS said FROM blk JOIN w USING (id, sec) WHERE big AND w.n = a
  UNION ALL SELECT c.id, c.sec, c.k, room, b, n, CASE WHEN said > 0 AND (4 * (words + w) + 2) // 3 > room THEN n ELSE start END, CASE WHEN said > 0 AND (4 * (words + w) + 2) // 3 > room THEN w ELSE words + w END,
         CASE WHEN head THEN 0 ELSE w END + CASE WHEN said > 0 AND (4 * (words + w) + 2) // 3 > room THEN 0 ELSE said END
  FROM cut c JOIN w ON w.id = c.id AND w.n = c.i + 1 WHERE c.i < c.b),
packed AS (SELECT id, sec, k, room, b, CASE WHEN big THEN NULL ELSE a END AS start, words FROM blk WHERE k = 1
  UNION ALL SELECT m.id, m.sec, n.k, m.room, n.b, CASE WHEN big THEN NULL WHEN start IS NOT NULL AND (4 * (m.words + n.words) + 2) // 3 <= m.room THEN start ELSE a END,
         CASE WHEN start IS NOT NULL AND NOT big AND (4 * (m.words + n.words) + 2) // 3 <= m.room THEN m.words + n.words ELSE n.words END
  FROM packed m JOIN blk n ON n.id = m.id AND n.sec = m.sec AND n.k = m.k + 1),
ranges AS (SELECT id, -1 AS sec, 0 AS a, b FROM doc WHERE fits
  UNION ALL SELECT id, sec, a, b FROM sec ANTI JOIN open USING (id, sec)
  UNION ALL SELECT id, sec, start, max(i) FROM cut GROUP BY id, sec, k, start
  UNION ALL SELECT id, sec, start, max(b) FROM packed WHERE start IS NOT NULL GROUP BY id, sec, start),
texts AS (SELECT r.id, r.sec, r.a, r.b, regexp_replace(string_agg(line, chr(10) ORDER BY n), '[\\s\\p{{Z}}\\x{{85}}]+$', '') AS said FROM ranges r JOIN w ON w.id = r.id AND w.n BETWEEN r.a AND r.b GROUP BY r.id, r.sec, r.a, r.b),
full_texts AS (SELECT id, a, b, coalesce(path, '') AS heading_path, 'Concept: ' || source || coalesce(chr(10) || 'Section: ' || path, '') || chr(10) || chr(10) || said AS t FROM texts JOIN src USING (id) LEFT JOIN paths USING (id, sec))
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY a) - 1 AS INTEGER) AS ordinal, regexp_replace(t, '{_INVISIBLE}', '', 'g') AS passage, heading_path, CAST(a + 1 AS INTEGER) AS start_line, CAST(b + 1 AS INTEGER) AS end_line,
       CAST(len(regexp_extract_all(t, '{_INVISIBLE}')) AS INTEGER) AS invisible FROM full_texts"""
ORACLE_SQL["chunk_coverage_invariant"] = f"""WITH {MD}
SELECT id, count(*) AS covered, count(*) AS lines FROM (SELECT id, unnest(string_split(body, chr(10))) AS line FROM md) WHERE regexp_matches(line, '\\S') GROUP BY id"""
ORACLE_SQL["token_estimates"] = """
SELECT doc_id AS id, CAST(ceil(len(regexp_extract_all(text, '[^\\s\\p{Z}\\x{85}]+')) * 4 / 3.0) AS BIGINT) AS tokens,
       CAST(length(cjk) + ceil((length(text) - length(cjk)) / 3.0) AS BIGINT) AS dense, CAST(octet_length(encode(text)) // 4 AS BIGINT) AS quarter_bytes
FROM (SELECT *, regexp_replace(text, '[^\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Hangul}]', '', 'g') AS cjk FROM documents)"""
ORACLE_SQL["invisible_strip"] = """
SELECT doc_id AS id, CAST(CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n, md5(text) AS stripped FROM documents"""
ORACLE_SQL["concept_hash"] = """
WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
h AS (SELECT id, n, array_to_string(list_reverse(regexp_extract_all(printf('%016X', octet_length(encode(t))), '..')), '') || hex(encode(t)) AS part FROM l)
SELECT id, sha256(unhex(string_agg(part, '' ORDER BY n))) AS text_hash FROM h GROUP BY id"""

SNAP = """stored AS (SELECT doc_id AS id, md5(CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 0),
now AS (SELECT doc_id AS id, md5(text) AS h FROM documents WHERE doc_id % 10 <> 2)"""
ORACLE_SQL["staleness_diff"] = f"""WITH {SNAP}
SELECT coalesce(s.id, n.id) AS id, CASE WHEN s.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN s.h <> n.h THEN 'changed' ELSE 'unchanged' END AS state
FROM stored s FULL OUTER JOIN now n ON s.id = n.id"""
ORACLE_SQL["reconcile_apply"] = f"""WITH {SNAP}
SELECT n.id, n.h AS text_hash, CASE WHEN s.id IS NULL THEN 'current' ELSE 'stored' END AS origin FROM now n LEFT JOIN stored s ON s.id = n.id AND s.h = n.h"""
ORACLE_SQL["index_status_rollup"] = f"""WITH {DOCS}
SELECT book, namespace, count(*) AS passages, count(DISTINCT concept_id) AS concepts FROM docs GROUP BY ROLLUP (book, namespace)"""
ORACLE_SQL["namespace_counts_pivot"] = f"""WITH {DOCS}
SELECT book, count(*) FILTER (namespace = 'document') AS document, count(*) FILTER (namespace = 'skill') AS skill,
       count(*) FILTER (namespace = 'memory') AS memory, count(*) FILTER (namespace = 'styleguide') AS styleguide, 0::BIGINT AS other
FROM docs GROUP BY book"""
ORACLE_SQL["duplicate_ids"] = """
SELECT md5(text) AS concept_id, count(DISTINCT source) AS roots, string_agg(DISTINCT source, ',' ORDER BY source) AS books
FROM documents GROUP BY md5(text) HAVING count(DISTINCT source) > 1"""
ORACLE_SQL["trust_effective_tier"] = """
WITH r AS (SELECT d.doc_id AS id, source, quality, CAST(substr(source, 4) AS INTEGER) % 3 AS k FROM documents d LEFT JOIN labels l USING (doc_id)),
o AS (SELECT *, CASE quality WHEN 1 THEN 2 WHEN 0 THEN 1 ELSE 0 END AS claim, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS cap FROM r)
SELECT id, ['unverified', 'machine-confirmed', 'human-reviewed'][(CASE WHEN source = 'src0' THEN claim ELSE least(claim, cap) END) + 1] AS trust FROM o"""
ORACLE_SQL["skill_shadowing"] = """
SELECT p_partkey, p_type AS name, row_number() OVER (PARTITION BY p_type ORDER BY p_brand, p_partkey) > 1 AS is_shadowed FROM part"""

TREES = f"""{DOCS}, a AS (SELECT concept_id AS path, sha256(text) AS h FROM docs WHERE id % 11 <> 0),
b AS (SELECT concept_id AS path, sha256(CASE WHEN id % 17 = 0 THEN upper(text) ELSE text END) AS h FROM docs WHERE id % 13 <> 0)"""
ORACLE_SQL["tree_change_counts"] = f"""WITH {TREES},
c AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change
      FROM a FULL OUTER JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h)
SELECT CASE WHEN path LIKE 'skill/%' THEN 'skill' WHEN path LIKE 'styleguide/%' THEN 'styleguide' ELSE 'other' END AS bucket, change, count(*) AS files FROM c GROUP BY ALL"""
ORACLE_SQL["integrity_mismatch"] = f"""WITH {TREES}
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'unlisted' WHEN b.path IS NULL THEN 'missing' ELSE 'mismatch' END AS problem
FROM a FULL OUTER JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h"""
_SNAPSHOTS = """s AS (SELECT doc_id AS id, doc_id // 64 AS g, coalesce(lang, 'none') AS la, coalesce(source, 'none') AS so, text FROM documents),
a AS (SELECT la || '/' || so || '/g' || g || '/d' || id AS path, sha256(text) AS h FROM s),
b AS (SELECT la || '/' || so || '/g' || g || '/d' || id AS path, sha256(CASE WHEN g % 5 = 0 AND id % 3 = 0 THEN text || '!' ELSE text END) AS h FROM s WHERE g % 7 <> 3
      UNION ALL SELECT 'new/' || la || '/d' || id, sha256(text) FROM s WHERE g % 11 = 5),
f AS (SELECT coalesce(a.path, b.path) AS path, a.path IS NOT NULL AS was, b.path IS NOT NULL AS is_there,
      CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.h IS DISTINCT FROM b.h THEN 'changed' END AS change FROM a FULL OUTER JOIN b ON a.path = b.path)"""
ORACLE_SQL["merkle_changes"] = f"WITH {_SNAPSHOTS} SELECT path, change FROM f WHERE change IS NOT NULL"
ORACLE_SQL["merkle_folders"] = f"""WITH {_SNAPSHOTS}, p AS (SELECT *, string_split(path, '/') AS x FROM f),
u AS (SELECT *, unnest(range(0, len(x))) AS depth FROM p), w AS (SELECT *, array_to_string(x[1:depth], '/') AS folder, depth = len(x) - 1 AS inside FROM u)
SELECT folder, CAST(depth AS INTEGER) AS depth,
       CASE WHEN NOT bool_or(was) THEN 'added' WHEN NOT bool_or(is_there) THEN 'removed' WHEN bool_or(change IS NOT NULL) THEN 'changed' ELSE 'same' END AS change,
       coalesce(bool_or(change IS NOT NULL) FILTER (inside), false) AS own_differs, count(*) FILTER (was) AS files_before, count(*) FILTER (is_there) AS files_after
FROM w GROUP BY folder, depth"""
ORACLE_SQL["update_files"] = f"""WITH {_SNAPSHOTS}
SELECT n.so AS name, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'removed') AS removed
FROM (SELECT DISTINCT so FROM s) n LEFT JOIN f ON split_part(path, '/', 2) = n.so GROUP BY n.so"""
ORACLE_SQL["bundle_hash"] = f"""WITH {DOCS}
SELECT book, sha256(string_agg(concept_id || chr(10) || sha256(text) || chr(10), '' ORDER BY concept_id <> 'document/d4', concept_id)) AS bundle_hash FROM docs GROUP BY book"""
ORACLE_SQL["update_plan"] = """
SELECT s_name AS name, sha256(s_suppkey::VARCHAR) AS from_commit,
       CASE WHEN s_suppkey % 7 <> 0 THEN sha256((s_suppkey + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END)::VARCHAR) END AS to_commit,
       s_suppkey % 7 <> 0 AND s_suppkey % 3 <> 0 AS up_to_date
FROM supplier"""
ORACLE_SQL["stamp_matrix"] = """
WITH s AS (
  SELECT s_suppkey, s_suppkey % 5 <> 0 AS fine, CASE s_suppkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'h' || (s_suppkey % 4) END AS stamp,
         CASE WHEN s_suppkey % 2 = 0 THEN 'h' || (s_suppkey % 8 % 4) END AS side FROM supplier)
SELECT s_suppkey, CASE
  WHEN side IS NULL THEN CASE WHEN stamp IS NULL OR stamp = 'none' THEN 'ok' ELSE 'sidecar missing' END
  WHEN stamp = 'none' THEN 'sidecar appeared'
  WHEN stamp IS NOT NULL AND stamp <> side THEN 'sidecar changed'
  WHEN fine THEN 'ok' ELSE 'contents differ' END AS state
FROM s"""
ORACLE_SQL["sync_status"] = """
SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'pulled' WHEN s_suppkey % 7 = 0 THEN 'failed' WHEN s_suppkey % 6 = 0 THEN 'integrity failed'
            WHEN s_suppkey % 8 <> s_suppkey % 4 THEN 'drifted' ELSE 'at pin' END AS state, count(*) AS n
FROM supplier GROUP BY ALL"""

FOUND = f"""{DOCS},
c AS (
  SELECT concept_id, namespace, id,
    CASE WHEN id % 6 = 0 THEN ' ' WHEN id % 9 <> 0 THEN CASE namespace WHEN 'styleguide' THEN CASE WHEN id % 5 = 0 THEN 'Note' ELSE 'Rule' END WHEN 'skill' THEN 'Skill' ELSE 'Note' END END AS type
  FROM docs),
v AS (
  SELECT concept_id, 'DOC-1' AS requirement, 'error' AS severity, 'a concept needs a type' AS message FROM c WHERE namespace = 'document' AND trim(coalesce(type, '')) = ''
  UNION ALL SELECT concept_id, 'MEM-1', 'error', 'a memory note needs a type' FROM c WHERE namespace = 'memory' AND trim(coalesce(type, '')) = ''
  UNION ALL SELECT concept_id, 'STG-1', 'error', 'a rule needs a type' FROM c WHERE namespace = 'styleguide' AND trim(coalesce(type, '')) = ''
  UNION ALL SELECT concept_id, 'STG-2', 'error', 'a rule''s type must be Rule' FROM c WHERE namespace = 'styleguide' AND type = 'Note'
  UNION ALL SELECT concept_id, 'STG-3', 'error', 'a rule needs a description' FROM c WHERE namespace = 'styleguide' AND id % 7 = 0
  UNION ALL SELECT concept_id, 'STG-4', 'warning', 'a rule should name its language and category' FROM c WHERE namespace = 'styleguide' AND id % 3 = 0
  UNION ALL SELECT concept_id, 'STG-9', 'warning', 'the priority isn''t one of error, warn, info' FROM c WHERE namespace = 'styleguide' AND id % 4 = 2 AND id % 5 = 1
  UNION ALL SELECT concept_id, 'STG-10', 'warning', 'the pattern doesn''t compile' FROM c WHERE namespace = 'styleguide' AND id % 10 = 2
  UNION ALL SELECT concept_id, 'SKL-3', 'error', 'a skill''s type must be Skill' FROM c WHERE namespace = 'skill' AND trim(coalesce(type, '')) <> 'Skill'
  UNION ALL SELECT concept_id, 'SKL-4', 'error', 'a skill needs a description' FROM c WHERE namespace = 'skill' AND id % 7 = 0
  UNION ALL SELECT concept_id, 'SKL-5', 'error', 'a skill needs a body' FROM c WHERE namespace = 'skill' AND id % 8 = 1)"""
ORACLE_SQL["validation_findings"] = f"WITH {FOUND} SELECT * FROM v"
ORACLE_SQL["validation_verdict"] = f"""WITH {FOUND}
SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos,
       count(*) FILTER (severity = 'error') = 0 AS conformant FROM v"""
ORACLE_SQL["uri_parse"] = f"""WITH {DOCS}
SELECT id, CASE WHEN id % 9 NOT BETWEEN 1 AND 5 THEN book END AS book, CASE WHEN id % 9 NOT BETWEEN 1 AND 5 THEN namespace END AS namespace,
       CASE WHEN id % 9 NOT BETWEEN 1 AND 5 THEN 'd' || id END AS name FROM docs"""
ORACLE_SQL["heading_lines"] = f"""WITH {MD},
l AS (SELECT id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS pos FROM md)
SELECT id, CAST(pos AS INTEGER) AS pos, CAST(length(regexp_extract(line, '^#+')) AS INTEGER) AS level, trim(regexp_extract(line, '^#+ (.*)$', 1)) AS title
FROM l WHERE regexp_matches(line, '^#{{1,6}} +[^ #]')"""
ORACLE_SQL["identifier_extract"] = """
WITH n AS (SELECT doc_id AS id, unnest(list_filter(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z_][a-zA-Z0-9_]{2,}'))) AS name, generate_subscripts(list_filter(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z_][a-zA-Z0-9_]{2,}')), 1) AS spot FROM documents),
f AS (SELECT id, name, min(spot) AS spot FROM n GROUP BY ALL),
g AS (SELECT id, string_agg(name, ',' ORDER BY spot) AS found, count(*) AS names FROM f GROUP BY id)
SELECT doc_id AS id, md5(coalesce(found, '')) AS names_md5, coalesce(names, 0) AS names FROM documents LEFT JOIN g ON g.id = doc_id"""
ORACLE_SQL["html_outline"] = """
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>')) AS tag, generate_subscripts(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>'), 1) - 1 AS pos FROM pages)
SELECT page_id, CAST(pos AS INTEGER) AS pos, CAST(regexp_extract(tag, '(?i)^<h([1-6])', 1) AS INTEGER) AS level, trim(regexp_extract(tag, '(?is)^<h[1-6][^>]*>(.*)</h[1-6]>$', 1), ' ') AS title FROM h"""
ORACLE_SQL["zoom_lines"] = """
WITH l AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no FROM documents)
SELECT path, line_no, lpad(line_no::VARCHAR, 5, ' ') || ' | ' || line AS shown FROM l WHERE line_no BETWEEN 2 AND 4"""

EDGES = """defs AS (SELECT DISTINCT l_suppkey AS path, l_partkey::VARCHAR AS ident FROM lineitem WHERE l_linenumber = 1),
refs AS (SELECT DISTINCT l_suppkey AS path, l_partkey::VARCHAR AS ident FROM lineitem WHERE l_linenumber <> 1),
definers AS (SELECT ident, min(path) AS dst FROM defs GROUP BY ident HAVING count(*) <= 5),
users AS (SELECT ident, sqrt(count(*)) * CASE WHEN ident IN ('7', '42') THEN 10 ELSE 1 END AS w FROM refs GROUP BY ident),
edges AS (SELECT r.path AS src, dst, sum(w) AS weight FROM refs r JOIN definers USING (ident) JOIN users USING (ident) WHERE r.path <> dst GROUP BY ALL)"""
ORACLE_SQL["def_ref_edges"] = f"WITH {EDGES} SELECT src, dst, round(weight, 6) AS weight FROM edges"


def _rank(rounds: int) -> str:
    out = f"""{EDGES},
nodes AS (SELECT s_suppkey AS node FROM supplier), total AS (SELECT src, sum(weight) AS total FROM edges GROUP BY src),
share AS (SELECT e.src, dst, weight / total AS share FROM edges e JOIN total t ON t.src = e.src),
seed AS (SELECT DISTINCT path AS node FROM defs JOIN nodes ON node = path WHERE ident IN ('7', '42')),
base AS (
  SELECT n.node, CASE WHEN (SELECT count(*) FROM seed) = 0 THEN 1::DOUBLE / (SELECT count(*) FROM nodes) WHEN s.node IS NULL THEN 0 ELSE 1::DOUBLE / (SELECT count(*) FROM seed) END AS bias,
         t.src IS NULL AS dangling, (SELECT count(*) FROM nodes) AS n
  FROM nodes n LEFT JOIN seed s ON s.node = n.node LEFT JOIN total t ON t.src = n.node),
r0 AS MATERIALIZED (SELECT node, 1::DOUBLE / n AS score FROM base)"""
    for i in range(1, rounds + 1):
        out += f""",
r{i} AS MATERIALIZED (
  SELECT b.node, 0.15::DOUBLE / n + 0.85::DOUBLE * (SELECT coalesce(sum(score), 0) FROM r{i - 1} JOIN base d ON d.node = r{i - 1}.node WHERE d.dangling) / n
         + 0.85::DOUBLE * coalesce(g.given, 0) + 0.15::DOUBLE * bias AS score
  FROM base b LEFT JOIN (SELECT dst, sum(score * share) AS given FROM share JOIN r{i - 1} ON r{i - 1}.node = share.src GROUP BY dst) g ON g.dst = b.node)"""
    return out


ORACLE_SQL["pagerank"] = f"WITH {_rank(8)} SELECT node, round(score, 6) AS score FROM r8"
TOP = f"""{_rank(8)},
top AS (
  SELECT path, ident, line, round(score, 6) + CASE WHEN ident IN ('7', '42') THEN 10 ELSE 0 END AS score
  FROM (SELECT DISTINCT l_suppkey AS path, l_partkey::VARCHAR AS ident, l_linenumber AS line FROM lineitem WHERE l_linenumber = 1) d JOIN r8 ON node = path
  ORDER BY score DESC, path, line, ident LIMIT 100)"""
ORACLE_SQL["top_defs"] = f"WITH {TOP} SELECT path, ident, line, round(score, 6) AS score FROM top"
ORACLE_SQL["repomap_budget"] = f"""WITH {TOP},
s AS (SELECT path, ident, score, sum(length(ident) + 4) OVER w AS running, row_number() OVER w AS place FROM top WINDOW w AS (ORDER BY score DESC, path, line, ident))
SELECT path, ident, round(score, 6) AS score, CAST(running AS BIGINT) AS running, place FROM s WHERE running <= 170 OR place = 1"""
ORACLE_SQL["call_edges_range_join"] = """
WITH c AS (SELECT user_id AS path, event_type AS callee, event_id AS line FROM events WHERE event_id % 3 <> 0),
s AS (SELECT user_id AS path, event_type AS name, event_id AS a FROM events WHERE event_id % 3 = 0)
SELECT c.path, c.callee, c.line, s.name AS caller, s.a AS caller_start, (SELECT min(t.a) FROM s t WHERE t.path = c.path AND t.name = c.callee) AS callee_start
FROM c JOIN s ON s.path = c.path AND c.line BETWEEN s.a AND s.a + 400"""

HOPS = """hops AS (
  SELECT n_nationkey AS src, (n_nationkey * 3 + n_regionkey) % 25 AS dst FROM nation
  UNION ALL SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation WHERE n_nationkey % 4 = 1)"""
ORACLE_SQL["impact_closure"] = f"""WITH RECURSIVE {HOPS},
w AS (SELECT n_nationkey AS source, n_nationkey AS node, 0 AS depth FROM nation WHERE n_nationkey < 4
      UNION SELECT source, dst, depth + 1 FROM w JOIN hops ON src = node WHERE depth < 26)
SELECT source, node, min(depth) AS depth FROM w WHERE node <> source GROUP BY source, node"""
ORACLE_SQL["call_tree_depth"] = f"""WITH RECURSIVE {HOPS},
steps AS (SELECT DISTINCT src, dst FROM hops),
w AS (SELECT [n_nationkey] AS trail, n_nationkey AS node, 0 AS level, false AS is_cycle FROM nation WHERE n_nationkey IN (1, 2)
      UNION ALL SELECT list_append(trail, dst), dst, level + 1, list_contains(trail, dst) FROM w JOIN steps ON src = node WHERE level < 5 AND NOT is_cycle)
SELECT array_to_string(trail, '>') AS trail, node, level, is_cycle FROM w"""

LINE = lambda n: f"coalesce(string_split(text, chr(10))[{n}], 'none')"
ORACLE_SQL["diff_added_lines"] = f"""
SELECT doc_id AS diff_id, 'docs/' || doc_id || '.md' AS path, CAST(unnest([doc_id % 9 + 2, doc_id % 9 + 3, doc_id % 9 + 40]) AS INTEGER) AS line_no,
       unnest([{LINE(1)}, {LINE(2)}, {LINE(3)}]) AS text FROM documents"""
ORACLE_SQL["diff_hunk_ranges"] = """
SELECT doc_id AS diff_id, 'docs/' || doc_id || '.md' AS path, CAST(unnest([doc_id % 9 + 1, doc_id % 9 + 40]) AS INTEGER) AS start,
       CAST(unnest([doc_id % 9 + 4, doc_id % 9 + 40]) AS INTEGER) AS "end" FROM documents"""

RUNS = """l AS (SELECT doc_id AS diff_id, source || '/' || doc_id AS path, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS no FROM documents),
rules AS (FROM (VALUES (0, 'tion', 'P1', 'tion([^\\p{L}\\p{M}\\p{N}_]|$)'), (1, 'capital', 'P2', '^[A-Z][a-z]+ a'), (2, 'ing', 'P3', 'ing[,.]')) t(rule_seq, label, priority, pattern)),
m AS (SELECT diff_id, path, no, rule_seq, label, priority, no - row_number() OVER (PARTITION BY diff_id, rule_seq ORDER BY no) AS island FROM l, rules WHERE regexp_matches(line, pattern)),
runs AS (SELECT diff_id, path, rule_seq, label, priority, min(no) AS line_start, max(no) AS line_end FROM m GROUP BY diff_id, path, rule_seq, label, priority, island),
r1 AS (SELECT *, row_number() OVER (PARTITION BY diff_id, rule_seq ORDER BY line_start) AS nth FROM runs),
r2 AS (SELECT *, max(CAST(nth > 10 AS INTEGER)) OVER (PARTITION BY diff_id) AS cut FROM r1),
found AS (SELECT *, '[' || priority || '] `' || label || '` pattern match in `' || path || '`' AS title, cut = 1 AS truncated,
          'book://rules/styleguide/en/words/' || label AS uri FROM r2 WHERE nth <= 10)"""
ORACLE_SQL["prepass_findings"] = f"WITH {RUNS} SELECT diff_id, rule_seq, path, line_start, line_end, priority, title, truncated FROM found"
ORACLE_SQL["finding_grounding"] = f"""WITH {RUNS}
SELECT path, rule_seq, line_start, line_end FROM found WHERE (diff_id % 2 = 0 AND line_start >= 1 AND line_end <= 2) OR (diff_id % 3 = 0 AND line_start >= 3 AND line_end <= 9)"""
IDS = RUNS + """,
ids AS (SELECT *, substr(sha256(array_to_string(['pattern', 'review', title, 'body', priority, path, line_start::VARCHAR, line_end::VARCHAR, '1065353216', uri, ''], chr(0))), 1, 24) AS finding_id FROM found)"""
ORACLE_SQL["finding_ids"] = f"WITH {IDS} SELECT finding_id, path, line_start FROM ids"
ORACLE_SQL["findings_filter_export"] = f"""WITH {IDS}
SELECT finding_id, title, 'error' AS level, 'ERROR' AS severity FROM ids WHERE priority = 'P1' AND contains(lower(path), 'src1')"""
ORACLE_SQL["findings_rdjsonl"] = f"""WITH {IDS}
SELECT '{{"message":"' || title || '","location":{{"path":"' || path || '","range":{{"start":{{"line":' || line_start || '}},"end":{{"line":' || line_end || '}}}}}},"severity":"'
       || CASE priority WHEN 'P1' THEN 'ERROR' WHEN 'P2' THEN 'WARNING' ELSE 'INFO' END || '"}}' AS value FROM ids"""
ORACLE_SQL["todo_scan"] = """
SELECT doc_id AS path, 2 AS line_no, ['TODO', 'FIXME', 'XXX', '', 'HACK'][CAST(doc_id % 5 + 1 AS INTEGER)] AS keyword,
       trim((CASE doc_id % 5 WHEN 0 THEN 'fix ' WHEN 1 THEN 'x) ' ELSE '' END) || CASE WHEN doc_id % 7 = 0 THEN '' ELSE doc_id::VARCHAR END) AS item
FROM documents WHERE doc_id % 5 <> 3 AND (doc_id % 7 <> 0 OR doc_id % 5 IN (0, 1))"""
ORACLE_SQL["conflict_list"] = """
SELECT doc_id::VARCHAR AS path, 1 AS nth, 2 AS line_start, CASE WHEN doc_id % 3 = 0 THEN 9 ELSE 5 END AS line_end,
       CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS ours_lines, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS theirs_lines, doc_id % 3 = 0 AS has_base
FROM documents WHERE doc_id % 3 < 2"""
ORACLE_SQL["conflict_resolve"] = """
WITH d AS (SELECT doc_id, left(replace(text, chr(10), ' '), 30) AS head FROM documents)
SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 3 < 2 THEN 1 ELSE 0 END AS resolved,
       'top' || chr(10) || CASE doc_id % 3 WHEN 0 THEN head || chr(10) || 'second' || chr(10) WHEN 1 THEN head || chr(13) || chr(10)
                           ELSE '<<<<<<< open' || chr(10) || 'x' || chr(10) || '=======' || chr(10) END || 'end' || chr(10) AS content
FROM d"""
ORACLE_SQL["provenance_decorate"] = """
WITH c AS (SELECT doc_id AS id, source, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '… [cut: read the whole concept]' ELSE text END AS t FROM documents)
SELECT id, CASE WHEN source = 'src0' THEN 'local' ELSE 'imported' END AS origin, md5(source) AS source_commit,
       md5(CASE WHEN source = 'src0' THEN t ELSE '<untrusted book="' || source || '">' || chr(10) || t || chr(10) || '</untrusted>' END) AS shown FROM c"""
ORACLE_SQL["default_scope"] = f"WITH {DOCS} SELECT id, namespace FROM docs WHERE book = 'src0' OR namespace <> 'memory'"
ORACLE_SQL["json_facets"] = """
SELECT event_type, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS k_total, count(*) FILTER ((props->>'$.k') IS NULL) AS k_missing FROM events GROUP BY event_type"""
ORACLE_SQL["session_ttl"] = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM s GROUP BY user_id, n"""
ORACLE_SQL["cache_hits"] = """
WITH e AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
p AS (SELECT *, lag(n) OVER w AS before, lag(ts) OVER w AS used FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY n)),
b AS (SELECT p.user_id, p.n, count(DISTINCT e.event_type) AS others FROM p JOIN e ON e.user_id = p.user_id AND e.n > p.before AND e.n < p.n GROUP BY ALL)
SELECT p.event_id, p.user_id, p.event_type, before IS NOT NULL AND ts - used <= INTERVAL 1 HOUR AND coalesce(others, 0) < 3 AS hit
FROM p LEFT JOIN b ON b.user_id = p.user_id AND b.n = p.n"""
ORACLE_SQL["event_windows"] = """
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""
ORACLE_SQL["mean_pooled_labels"] = """
WITH c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i)
SELECT label, round(max(m) FILTER (i = 1) / sqrt(sum(m * m)), 6) AS first FROM c GROUP BY label"""
ORACLE_SQL["frontmatter_parse"] = """
SELECT doc_id AS id, CASE WHEN doc_id % 6 <> 0 THEN 'Note' END AS type, CASE WHEN doc_id % 6 <> 0 THEN lang END AS language,
       CASE WHEN doc_id % 6 <> 0 THEN source || ',x' ELSE '' END AS tags, CASE WHEN doc_id % 6 <> 0 THEN 'body ' || doc_id END AS body, doc_id % 6 = 0 AS failed
FROM documents"""

ORACLE_SQL["hashed_text_vectors"] = """
WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+')) AS term FROM benchmark),
h AS (SELECT item_id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 32 AS slot, CASE WHEN CAST('0x' || substr(md5(term), 9, 8) AS BIGINT) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM t),
s AS (SELECT item_id, slot, sum(sign) AS x FROM h GROUP BY ALL),
n AS (SELECT item_id, sqrt(sum(x * x)) AS norm FROM s GROUP BY item_id)
SELECT b.item_id, CAST(g.slot AS INTEGER) AS slot, round(coalesce(CASE WHEN norm > 0 THEN x / norm ELSE x END, 0), 6) AS x
FROM benchmark b CROSS JOIN (SELECT unnest(range(0, 32)) AS slot) g LEFT JOIN s ON s.item_id = b.item_id AND s.slot = g.slot LEFT JOIN n ON n.item_id = b.item_id"""


def _rows(rows: list[tuple], names: str) -> str:
    """A table of SQL expressions over a document's number k (its text t, and so on)."""
    return " UNION ALL ".join("SELECT k, " + ", ".join(f"{x} AS {n}" for x, n in zip(row, names.split(), strict=True)) + f" FROM {row_of}" for row_of, row in rows)


FILES = """f AS (SELECT doc_id AS k, doc_id % 300 AS r, doc_id % 9 AS c, len(string_split(coalesce(text, ''), chr(10))) AS n,
  CASE doc_id % 3 WHEN 0 THEN 'src/d' || doc_id || '.py' WHEN 1 THEN 'docs/d' || doc_id || '.md' ELSE 'src/d' || doc_id || '.rs' END AS path FROM documents),
py AS (SELECT * FROM f WHERE k % 3 = 0), md AS (SELECT * FROM f WHERE k % 3 = 1), rs AS (SELECT * FROM f WHERE k % 3 = 2)"""
_SYMBOLS = [
    ("py", ("path", "'Store' || k", "'class'", "6", "12", "'class Store' || k", "''", "false", "NULL::VARCHAR", "NULL::INTEGER")),
    ("py", ("path", "'load'", "'method'", "7", "8", "'def load(self, path)'", "'Store' || k", "false", "'Store' || k", "6")),
    ("py", ("path", "'save'", "'method'", "10", "12", "'def save(self, path, data)'", "'Store' || k", "false", "'Store' || k", "6")),
    ("py", ("path", "'read' || r", "'function'", "15", "16", "'def read' || r || '(path)'", "''", "false", "NULL", "NULL")),
    ("py", ("path", "'write'", "'function'", "19", "20", "'def write(path, data)'", "''", "false", "NULL", "NULL")),
    ("md", ("path", "'Top ' || k", "'h1'", "1", "n + 6", "'# Top ' || k", "''", "false", "NULL", "NULL")),
    ("md", ("path", "'Part'", "'h2'", "n + 4", "n + 6", "'## Part'", "''", "false", "'Top ' || k", "1")),
    ("rs", ("path", "'Node' || k", "'struct'", "1", "3", "'pub struct Node' || k || ' {'", "''", "true", "NULL", "NULL")),
    ("rs", ("path", "'x'", "'field'", "2", "2", "'x: u32,'", "'Node' || k", "false", "'Node' || k", "1")),
    ("rs", ("path", "'Node' || k", "'impl'", "5", "10", "'impl Node' || k || ' {'", "''", "false", "NULL", "NULL")),
    ("rs", ("path", "'new'", "'method'", "6", "9", "'pub fn new(x: u32) -> Self {'", "'Node' || k", "true", "'Node' || k", "5")),
    ("rs", ("path", "'check' || c", "'function'", "12", "12", "'fn check' || c || '(x: u32) {}'", "''", "false", "NULL", "NULL")),
]
_SYMBOL_ROWS = _rows(_SYMBOLS, "path name kind start_row end_row signature scope exported parent parent_start")
ORACLE_SQL["code_symbols"] = f"WITH {FILES}, s AS ({_SYMBOL_ROWS}) SELECT path, name, kind, CAST(start_row AS INTEGER) AS start_row, CAST(end_row AS INTEGER) AS end_row, signature, scope, exported FROM s"
ORACLE_SQL["code_outline"] = f"WITH {FILES}, s AS ({_SYMBOL_ROWS}) SELECT path, name, kind, CAST(start_row AS INTEGER) AS start_row, parent, CAST(parent_start AS INTEGER) AS parent_start FROM s"
_STORE, _READ = "'Store' || k", "'read' || r"
_CALL_ROWS = _rows(
    [
        ("py", ("path", _READ, _STORE, "6", "8", "15")), ("py", ("path", _READ, "'load'", "7", "8", "15")),
        ("py", ("path", "'load'", _STORE, "6", "11", "7")), ("py", ("path", "'load'", "'save'", "10", "11", "7")),
        ("py", ("path", "'write'", _STORE, "6", "12", "19")), ("py", ("path", "'write'", "'save'", "10", "12", "19")),
        ("py", ("path", "'open'", _READ, "15", "16", "NULL::INTEGER")), ("py", ("path", "'print'", "'write'", "19", "20", "NULL")),
        ("rs", ("path", "'check' || c", "'Node' || k", "5", "7", "12")), ("rs", ("path", "'check' || c", "'new'", "6", "7", "12")),
    ],
    "path callee caller caller_start line callee_start",
)
ORACLE_SQL["code_calls"] = f"WITH {FILES}, s AS ({_CALL_ROWS}) SELECT path, callee, caller, CAST(caller_start AS INTEGER) AS caller_start, CAST(line AS INTEGER) AS line, CAST(callee_start AS INTEGER) AS callee_start FROM s"
#: Units of files whose symbols are known as they are made: a unit a line of the document.
_UNIT_ROWS = [
    ("0", "w || 'x' || i", "'function'", "4 * i + 2", "4 * i + 4", "''"), ("1", "w || '_' || i", "'method'", "6 * i + 2", "6 * i + 6", "''"),
    ("2", "w || i", "'class'", "5 * i + 1", "5 * i + 5", "''"), ("2", "'text'", "'field'", "5 * i + 2", "5 * i + 2", "w || i"), ("2", "'draw'", "'method'", "5 * i + 3", "5 * i + 4", "w || i"),
    ("3", "w || '_' || i", "'function'", "4 * i + 1", "4 * i + 3", "''"),
]
ORACLE_SQL["code_lexed"] = """WITH d AS (SELECT doc_id AS k, string_split(lower(coalesce(text, '')), chr(10)) AS ls FROM documents),
l AS (SELECT k, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM d),
u AS (SELECT k, i, coalesce(nullif(regexp_extract(line, '[a-z]{3,}'), ''), 'none') AS w FROM l),
s AS (""" + " UNION ALL ".join(f"SELECT k, {name} AS name, {kind} AS kind, {a} AS a, {b} AS b, {scope} AS scope FROM u WHERE k % 4 = {c}" for c, name, kind, a, b, scope in _UNIT_ROWS) + """)
SELECT k AS id, name, kind, CAST(a AS INTEGER) AS start_row, CAST(b AS INTEGER) AS end_row, scope FROM s"""
_LINES = """d AS (SELECT doc_id AS k, string_split(lower(coalesce(text, '')), chr(10)) AS ls FROM documents),
l AS (SELECT k, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM d),
u AS (SELECT k, i, coalesce(nullif(regexp_extract(line, '[a-z]{3,}'), ''), 'none') AS w, regexp_replace(line, '[^a-z]+', ' ', 'g') AS t FROM l)"""
_FOUND = [
    ("0", "8 * i + 4", "8 * i + 4", "'store(a.' || w || '(s, ' || i || ')?, vec![' || i || ', 2])'"), ("0", "8 * i + 5", "8 * i + 7", "'store(' || chr(10) || '        s,' || chr(10) || '    )'"),
    ("1", "4 * i + 2", "4 * i + 2", "'v.' || w || ' == null'"), ("1", "4 * i + 3", "4 * i + 3", "'v.a + 1 == v.' || w"),
    ("2", "4 * i + 3", "4 * i + 3", "'s := \"}} ' || w || '\" + `{` + string(''}'')'"),
]
ORACLE_SQL["structure_search"] = f"WITH {_LINES}, s AS (" + " UNION ALL ".join(f"SELECT k, {a} AS a, {b} AS b, {said} AS matched FROM u WHERE k % 3 = {c}" for c, a, b, said in _FOUND) + ") SELECT k AS id, CAST(a AS INTEGER) AS line_start, CAST(b AS INTEGER) AS line_end, matched, CASE WHEN a < b THEN 'store( ...' ELSE matched END AS preview FROM s"
_TSX = "'function ' || w || i || '(v: View) {' || chr(10) || '  if (v.' || w || ' == null) { trace(v, [`}} ' || t || '`]); }' || chr(10) || '  /* log(v, 1) */ return v.a + 1 == v.' || w || ' && trace(f(v, ' || i || '), [\"(\"]);' || chr(10) || '}' || chr(10)"
_RS = "'fn ' || w || '_' || i || '(a: u32) {' || chr(10) || '    // store(' || w || ', 0);' || chr(10) || '    let s = \"store(' || t || ', 1)\";' || chr(10) || '    store(a.' || w || '(s, ' || i || ')?, vec![' || i || ', 2]);' || chr(10) || '    store(' || chr(10) || '        s,' || chr(10) || '    );' || chr(10) || '}' || chr(10)"
ORACLE_SQL["structure_rewrite"] = f"WITH {_LINES} SELECT k AS id, k % 2 = 0 AS changed, false AS error_introduced, md5(string_agg(CASE WHEN k % 2 = 0 THEN {_TSX} ELSE {_RS} END, '' ORDER BY i)) AS content_md5 FROM u GROUP BY k"
_GO = "'// } ' || t || ' {' || chr(10) || 'func ' || w || 'x' || i || '(a int) {' || chr(10) || chr(9) || 's := \"}} ' || w || '\" + `{` + string(''}'')' || chr(10) || '}' || chr(10)"
_RB = "'# end ' || t || chr(10) || 'def ' || w || '_' || i || '(a)' || chr(10) || '  x = \"end # ' || w || '\"' || chr(10) || '  if a then' || chr(10) || '  end' || chr(10) || 'end' || chr(10)"
ORACLE_SQL["code_zooms"] = f"""WITH {_LINES}, c AS (SELECT k, string_split(string_agg(CASE WHEN k % 2 = 0 THEN {_GO} ELSE {_RB} END, '' ORDER BY i), chr(10)) AS x FROM u GROUP BY k),
z AS (SELECT k, CASE WHEN k % 2 = 0 THEN w || 'x' || i ELSE w || '_' || i END AS name, CASE WHEN k % 2 = 0 THEN 4 * i + 2 ELSE 6 * i + 2 END AS a, CASE WHEN k % 2 = 0 THEN 4 * i + 4 ELSE 6 * i + 6 END AS b, x FROM u JOIN c USING (k)),
r AS (SELECT k, name, greatest(a - 3, 1) AS p, least(b + 3, len(x)) AS q, x FROM z)
SELECT k AS id, name, CAST(p AS INTEGER) AS first_line, CAST(q AS INTEGER) AS last_line, md5(array_to_string(x[p:q], chr(10))) AS lines_md5 FROM r"""
ORACLE_SQL["key_scopes"] = """WITH d AS (SELECT doc_id AS k, string_split(lower(coalesce(text, '')), chr(10)) AS ls FROM documents),
l AS (SELECT k, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM d),
u AS (SELECT k, i, coalesce(nullif(regexp_extract(line, '[a-z]{3,}'), ''), 'none') AS w FROM l),
s AS (SELECT k, w || i AS name, 'key' AS kind, 7 * i + 1 AS a, 7 * i + 7 AS b, '' AS scope FROM u WHERE k % 2 = 0
  UNION ALL SELECT k, 'in "' || w, 'key', 7 * i + 2, 7 * i + 3, w || i FROM u WHERE k % 2 = 0
  UNION ALL SELECT k, 'list', 'key', 7 * i + 5, 7 * i + 7, w || i FROM u WHERE k % 2 = 0
  UNION ALL SELECT k, 'deep', 'key', 7 * i + 6, 7 * i + 6, w || i || '.list' FROM u WHERE k % 2 = 0
  UNION ALL SELECT k, 'more', 'key', 7 * i + 7, 7 * i + 7, w || i || '.list' FROM u WHERE k % 2 = 0
  UNION ALL SELECT k, 'tool.' || w || i, 'table', 6 * i + 1, 6 * i + 5, '' FROM u WHERE k % 2 = 1
  UNION ALL SELECT k, 'a.' || w, 'key', 6 * i + 2, 6 * i + 4, 'tool.' || w || i FROM u WHERE k % 2 = 1
  UNION ALL SELECT k, 'b', 'key', 6 * i + 5, 6 * i + 5, 'tool.' || w || i FROM u WHERE k % 2 = 1)
SELECT k AS id, name, kind, CAST(a AS INTEGER) AS start_row, CAST(b AS INTEGER) AS end_row, scope FROM s"""
ORACLE_SQL["code_zoom"] = """SELECT * FROM (VALUES (12, '        write(path, data)'), (13, ''), (14, ''), (15, 'def read3(path):'), (16, '    return os.open(path)'), (17, ''), (18, ''), (19, 'def write(path, data):')) t(line_no, line)"""
ORACLE_SQL["repo_map_edges"] = f"""WITH {FILES}, g AS (SELECT r, count(*) AS n, min(path) AS dst FROM py GROUP BY r HAVING count(*) <= 5)
SELECT path AS src, dst, round(sqrt(g.n), 6) AS weight FROM py JOIN g USING (r) WHERE path <> dst"""
ORACLE_SQL["ast_search"] = f"""WITH {FILES}, s AS ({_rows([("py", ("path", "8", "'read' || r || '(path)'")), ("py", ("path", "11", "'self.load(path)'")), ("py", ("path", "12", "'write(path, data)'")), ("py", ("path", "16", "'os.open(path)'")), ("py", ("path", "20", "'print(path, data)'"))], "path line_start matched")})
SELECT path, CAST(line_start AS INTEGER) AS line_start, CAST(line_start AS INTEGER) AS line_end, matched FROM s"""
ORACLE_SQL["ast_rewrite"] = f"""WITH {FILES}
SELECT path, k % 3 = 0 AS changed, false AS error_introduced, md5(CASE WHEN k % 3 <> 0 THEN '' ELSE
  concat_ws(chr(10), '--- a/' || path, '+++ b/' || path, '@@ -9,7 +9,7 @@', ' ', '     def save(self, path, data):', '         self.load(path)', '-        write(path, data)',
            '+        store(data, path, retry=True)', ' ', ' ', ' def read' || r || '(path):', '') END) AS diff_md5 FROM f"""
ORACLE_SQL["ignore_rules"] = """
WITH u AS (SELECT page_id, url IS NULL AS none, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS rest FROM pages),
p AS (SELECT *, rtrim(regexp_extract(host, '[^.]*$') || '/' || host || rest, '/') AS path FROM u),
s AS (SELECT *, string_split(path, '/') AS parts FROM p),
f AS (SELECT *, parts[1] AS d1, parts[2] AS d2, parts[3] AS d3, parts[-1] AS leaf, len(parts) AS n FROM s)
SELECT page_id, CASE WHEN NOT none THEN path END AS path, CASE WHEN NOT none THEN
  coalesce((d2 LIKE 'blog.%' AND d2 NOT LIKE 'blog.t%') OR (d2 LIKE 'spam-%' AND n > 2), false)
  OR coalesce((d1 = 'net' AND d3 = 'es' AND n > 3) OR (d1 = 'org' AND d2 = 'thther.example.org' AND d3 = 'en'), false)
  OR coalesce(leaf LIKE '%.html' AND NOT (d1 = 'com' AND leaf LIKE '1%.html') AND d1 <> 'org', false) END AS ignored FROM f"""
ORACLE_SQL["yaml_import"] = """
WITH d AS (SELECT doc_id AS k, source, coalesce(lang, 'any') AS lang, 'rules/' || doc_id || '.yaml' AS path FROM documents),
r AS (
  SELECT k, path, 'styleguide/' || lang || '/prose/rule-' || k AS concept_id, 'Words of ' || source AS description, 'prose' AS category, 'warn' AS priority, 'a' || k || chr(10) || 'b' AS pattern, 'x' AS good, 'y' AS bad FROM d WHERE k % 7 <> 0
  UNION ALL SELECT k, path, 'styleguide/' || lang || '/own/own', NULL, 'own', CASE WHEN k % 2 = 0 THEN 'error' ELSE 'info' END, NULL, 'g' || k, NULL FROM d)
SELECT path, concept_id, description, category, priority, pattern, good, bad, false AS failed FROM r WHERE k % 10 <> 3
UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM d WHERE k % 10 = 3"""

#: Without CJK a text has a token for three characters; three parts of five of what is kept stand before the mark.
ORACLE_SQL["budget_fit"] = """
WITH RECURSIVE c AS (SELECT conv_id, turn, role, text, CAST(ceil(length(role) / 3.0) AS BIGINT) + 6 AS around FROM conversations),
r AS (
  SELECT conv_id, turn, role, around, text AS t, CAST(ceil(length(text) / 3.0) AS BIGINT) AS est, 0 AS step FROM c
  UNION ALL
  SELECT conv_id, turn, role, around, t, CAST(ceil(length(t) / 3.0) AS BIGINT), step FROM (
    SELECT conv_id, turn, role, around, step + 1 AS step, left(t, (3 * (est // 2) - 3) * 3 // 5) || ' … ' || right(t, 3 * (est // 2) - 3 - (3 * (est // 2) - 3) * 3 // 5) AS t
    FROM r WHERE around + est > 64 AND est > 8)),
last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY step DESC) = 1)
SELECT c.conv_id, c.turn, '{"role":' || to_json(c.role) || ',"text":' || to_json(c.text) || '}' AS state, '{"role": ' || to_json(c.role) || ', "text": ' || to_json(t) || '}' AS fitted,
       c.around + c.est AS tokens_before, l.around + l.est AS tokens_after
FROM (SELECT *, CAST(ceil(length(text) / 3.0) AS BIGINT) AS est FROM c) c JOIN last l ON l.conv_id = c.conv_id AND l.turn = c.turn"""
