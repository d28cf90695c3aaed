"""DuckDB SQL that gives the registered queries' rows."""

from __future__ import annotations

from lodeweave.functions.globs import glob_regex, plan_glob
from lodeweave.plans import engine_queries, function_queries
from lodeweave.plans.queries import EVERY, GLOBS, GREP, PER_QUERY, SKILL_WORDS, TOP

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_NODES = """nodes AS (SELECT doc_id AS id, source AS collection, lang || '/' || doc_id || '.md' AS path, text AS content, length(text) AS size_bytes,
  '/docs/' || source || '/' || lang || '/' || doc_id || '.md' AS vfs_path, 'ctx://docs/' || source || '/' || lang || '/' || doc_id || '.md' AS uri FROM documents)"""
_SOURCES = """sources AS (SELECT d.doc_id AS id, 'doc-' || d.doc_id AS name, d.source AS collection, 'lang ' || d.lang AS detail,
  CASE WHEN l.quality = 0 THEN 'failed' WHEN l.toxic = 1 THEN 'needs_ocr' ELSE 'ready' END AS status FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _scored(words: list[str], exact: str, loose: str, name: str = "scored", density: str = "") -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""{name} AS (SELECT doc_id, ({exact})::INTEGER::BIGINT AS exact,
  len(list_filter([{listed}], lambda q: list_contains(w, q)))::BIGINT AS terms,
  {density or f"len(list_filter(w, lambda x: list_contains([{listed}], x)))"}::DOUBLE AS density
  FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE {loose})"""


def _has(word: str) -> str:
    return f"list_contains(w, '{word}')"


_ALL = " AND ".join(map(_has, ("the", "that", "from")))
_ANY = " OR ".join(map(_has, ("the", "that", "from")))
_ANY_OTHER = " OR ".join(map(_has, ("which", "have", "been")))
_ALL_OTHER = " AND ".join(map(_has, ("which", "have", "been")))
_OF_THE = "len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the'))"
_ORDER = "exact DESC, terms DESC, density DESC, doc_id"


def _topk(words: list[str], exact: str, loose: str, k: int = TOP, density: str = "") -> str:
    return f"WITH {_scored(words, exact, loose, density=density)} SELECT 0::BIGINT AS query_id, doc_id, exact, terms, density, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM scored ORDER BY {_ORDER} LIMIT {k}"


_MAIN = _scored(["the", "that", "from"], _ALL, f"({_ANY})")
_RANKED = f"ranked AS (SELECT doc_id, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM scored)"


_NOT = "NOT list_contains(w, '{}')"
#: For each of the queries' negated alternatives: its words, what it asks for, its density.
_WITHOUT = (
    (["the"], _NOT.format("the"), "0"),
    (["which", "of"], f"{_has('which')} OR {_NOT.format('of')}", "len(list_filter(w, lambda x: x = 'which'))"),
    (["of", "the", "that"], f"{_OF_THE} > 0 OR {_NOT.format('that')}", _OF_THE),
    (["the", "of", "and"], " AND ".join(map(_NOT.format, ("the", "of", "and"))), "0"),
    (["the", "from", "that"], f"{_has('the')} OR ({_has('from')} AND {_NOT.format('that')})", "len(list_filter(w, lambda x: x IN ('the', 'from')))"),
)


def _without() -> str:
    parts = [f"SELECT {i}::BIGINT AS query_id, * FROM (WITH {_scored(words, 'true', f'({where})', density=density)} SELECT doc_id, exact, terms, density, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM scored ORDER BY {_ORDER} LIMIT 40)" for i, (words, where, density) in enumerate(_WITHOUT)]
    return " UNION ALL ".join(parts)


def _nearest(where: str = "true", extra: str = "", queries: str = f"vec_id % {EVERY} = 0", k: int = TOP) -> str:
    return f"""near AS (SELECT * FROM (SELECT q.vec_id AS query_id, b.vec_id, distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, b.vec_id) AS rank
  FROM (SELECT * FROM embeddings WHERE {queries}) q, (SELECT * FROM embeddings WHERE {where}) b,
  LATERAL (SELECT round(1 - list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS distance)) WHERE rank <= {k} {extra})"""


def _lists(two: bool) -> str:
    other = f", {_scored(['which', 'have', 'been'], _ALL_OTHER, f'({_ANY_OTHER})', 'scored2')}, ranked2 AS (SELECT doc_id, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM scored2)" if two else ""
    more = f"UNION ALL SELECT 'fts:1', doc_id, rank FROM ranked2 WHERE rank <= {PER_QUERY}" if two else ""
    vecs = "7, 11" if two else "7"
    return f"""WITH {_MAIN}, {_RANKED} {other}, {_nearest(queries=f"vec_id IN ({vecs})", k=PER_QUERY)},
lists AS (SELECT 'fts:0' AS list, doc_id AS id, rank FROM ranked WHERE rank <= {PER_QUERY} {more}
  UNION ALL SELECT CASE query_id WHEN 7 THEN 'vec:0' ELSE 'vec:1' END, vec_id, rank FROM near)"""


_FUSE = "SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score, sum(1.0 / (60 + rank)) AS exact_score, min(rank) AS best, string_agg(DISTINCT list, ',' ORDER BY list) AS via FROM {} GROUP BY id"


def _fused(two: bool, limit: int) -> str:
    return f"{_lists(two)}, fused AS ({_FUSE.format('lists')}) SELECT id, score, best, via FROM fused ORDER BY exact_score DESC, best, id::VARCHAR LIMIT {limit}"


def _grep(prefix: str, where: str = "true", lines: str = "true", tail: str = "") -> str:
    return f"""WITH {_NODES}, files AS (SELECT * FROM nodes WHERE regexp_matches(content, '({prefix}m){GREP}') AND {where}),
cut AS (SELECT id AS node_id, uri, vfs_path AS path, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files)
SELECT node_id, uri, path, line::BIGINT AS line, substring(trim(raw, ' '), 1, 300) AS text FROM cut WHERE regexp_matches(raw, '({prefix}s){GREP}') AND {lines} {tail}"""


def _glob(pattern: str) -> str:
    return f"WITH {_NODES} SELECT vfs_path AS path, uri, 'doc' AS role, size_bytes FROM nodes WHERE regexp_matches(vfs_path, '(?s){plan_glob(pattern).regex}')"


def _children(prefix: str) -> str:
    depth = prefix.count("/") + 2 if prefix else 1
    inside = f"AND starts_with(path, '{prefix}/')" if prefix else ""
    return f"""WITH {_NODES} SELECT split_part(path, '/', {depth}) AS name, len(string_split(path, '/')) > {depth} AS directory, count(*) AS count, min(uri) AS uri, 'doc' AS role, max(size_bytes) AS size
FROM nodes WHERE collection = 'src2' {inside} GROUP BY 1, 2"""


_REVISED = """current AS (SELECT doc_id, source AS collection, doc_id::VARCHAR AS name, sha256(text) AS hash, CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'ready' END AS status FROM documents WHERE doc_id % 10 <> 3),
incoming AS (SELECT source AS collection, doc_id::VARCHAR AS name, sha256(CASE WHEN doc_id % 10 = 5 THEN text || ' more' ELSE text END) AS hash FROM documents)"""

_SKILL_LIST = ", ".join(f"'{w}'" for w in SKILL_WORDS)

ORACLES: dict[str, str] = {
    "fts_topk": _topk(["the", "that", "from"], _ALL, f"({_ANY})"),
    "fts_negation": _topk(["the", "for"], f"{_has('the')} AND NOT {_has('for')}", f"{_has('the')} AND NOT {_has('for')}"),
    "fts_phrase": _topk(["of", "the"], f"{_OF_THE} > 0", f"{_OF_THE} > 0", density=_OF_THE),
    "fts_cover": f"""WITH words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM words WHERE {_has('the')} AND {_has('that')} AND NOT {_has('for')}),
pairs AS (SELECT doc_id, word, place, lag(word) OVER o AS before, lag(place) OVER o AS began FROM places WHERE word IN ('the', 'that') WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
scored AS (SELECT doc_id, 1::BIGINT AS exact, 2::BIGINT AS terms, round(sum(1.0::DOUBLE / (place - began)) FILTER (WHERE word <> before), 6)::DOUBLE AS density FROM pairs GROUP BY doc_id)
SELECT 0::BIGINT AS query_id, doc_id, exact, terms, density, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM scored ORDER BY {_ORDER} LIMIT {TOP}""",
    "subscription_notices": """WITH log AS (SELECT doc_id // 40 AS version, 'ctx://docs/' || source || '/' || (doc_id % 7) AS uri FROM documents),
wanted AS (SELECT DISTINCT lang AS subscriber, 'ctx://docs/' || source || '/' || (doc_id % 7) AS uri FROM documents WHERE doc_id % 3 = 0)
SELECT DISTINCT subscriber, uri, version, 'written' AS change FROM log JOIN wanted USING (uri)""",
    "fts_without": _without(),
    "best_fragments": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), hit AS (SELECT doc_id, w, i FROM d, range(1, len(w) + 1) AS t(i) WHERE w[i] IN ('the', 'that', 'from')),
counted AS (SELECT doc_id, i, len(list_distinct(list_filter(w[i : i + 31], lambda x: x IN ('the', 'that', 'from')))) AS terms, len(list_filter(w[i : i + 31], lambda x: x IN ('the', 'that', 'from'))) AS hits,
  (SELECT max(k) FROM range(i, least(i + 32, len(w) + 1)) AS u(k) WHERE w[k] IN ('the', 'that', 'from')) AS last FROM hit)
SELECT doc_id, i - 1 AS start, last AS stop, terms, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY terms DESC, hits DESC, i) AS r FROM counted) WHERE r = 1""",
    "fts_stored_postings": _topk(["the", "that", "from"], _ALL, f"({_ANY})"),
    "vector_cells": f"SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % {EVERY} = 0",
    "vector_distance": "SELECT b.vec_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS distance FROM embeddings b, embeddings q WHERE q.vec_id = 7",
    "vfs_scope": f"WITH {_SOURCES} SELECT id, name FROM sources WHERE collection = 'src3' AND status = 'ready'",
    "uri_decoded": f"WITH {_NODES} SELECT id, collection AS root, path FROM nodes",
    "text_clips": r"SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(substring(text, 1, 79), '\s+\S*$', '') || '…' END AS clip FROM documents",
    "conservative_estimates": "SELECT doc_id, least(32000, ceil(length(text) / 3))::BIGINT AS tokens FROM documents",
    "embed_batches": r"SELECT doc_id, 64::BIGINT AS dims, CASE WHEN regexp_matches(text, '[\p{L}\p{N}]') THEN 1.0 ELSE 0.0 END::DOUBLE AS squares, true AS fine FROM documents",
    "dense_numbers": "SELECT 101::BIGINT AS least, 100 + count(*) AS most, count(*) AS numbers FROM documents",
    "result_links": f"WITH {_MAIN}, {_RANKED} SELECT source AS uri, min(rank) AS rank FROM ranked JOIN documents USING (doc_id) WHERE rank <= 100 GROUP BY source ORDER BY 2, 1 LIMIT 20",
    "ingest_last_of_name": "SELECT source AS collection, (doc_id % 40)::VARCHAR AS name, 'file:/' || lpad(max(doc_id)::VARCHAR, 12, '0') AS origin_uri FROM documents GROUP BY 1, 2",
    "chunk_bounds": r"SELECT doc_id, regexp_matches(text, '\S') AS chunked, true AS fine FROM documents",
    "fts_or": _topk(["that", "which"], f"{_has('that')} OR {_has('which')}", f"({_has('that')} OR {_has('which')})"),
    "fts_terms_coverage": f"WITH {_MAIN} SELECT terms, count(*) AS docs FROM scored GROUP BY terms",
    "fts_exact_flag": f"WITH {_MAIN} SELECT doc_id, exact FROM scored",
    "postings_terms": f"SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS places FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY term",
    "skill_discovery_weighted": rf"""WITH words AS (
  SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[\p{{L}}\p{{N}}]+')) AS term, 1.0 AS weight FROM part
  UNION ALL SELECT p_partkey, unnest(regexp_extract_all(lower(p_brand || ' ' || p_type), '[\p{{L}}\p{{N}}]+')), 0.4 FROM part),
found AS (SELECT p_partkey, count(DISTINCT term) AS terms, sum(weight) AS d FROM words WHERE term IN ({_SKILL_LIST}) GROUP BY 1)
SELECT p_partkey, terms, round(d::DOUBLE, 4) AS density, row_number() OVER (ORDER BY terms DESC, d DESC, p_partkey) AS rank FROM found QUALIFY rank <= {TOP}""",
    "vector_topk": f"WITH {_nearest()} SELECT query_id, vec_id, distance, rank FROM near",
    "vector_max_distance": f"WITH {_nearest(extra='AND distance <= 0.7')} SELECT query_id, vec_id, distance, rank FROM near",
    "vector_scoped": f"WITH {_nearest('label = 1')} SELECT query_id, vec_id, distance, rank FROM near",
    "hybrid_rrf": _fused(False, TOP),
    "multi_query_rrf": _fused(True, PER_QUERY),
    "rrf_tiebreak": f"{_lists(False)}, coarse AS (SELECT list, id, ceil(rank / 10)::BIGINT AS rank FROM lists), fused AS ({_FUSE.format('coarse')}) SELECT id, score, best, via, row_number() OVER (ORDER BY exact_score DESC, best, id::VARCHAR) AS place FROM fused",
    "candidate_union": f"{_lists(False)} SELECT DISTINCT id FROM lists",
    "near_duplicates": f"""WITH {_MAIN}, {_RANKED}, best AS (SELECT doc_id, list_distinct({_WORDS}) AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM ranked WHERE rank <= {PER_QUERY}))
SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) AS share FROM best a JOIN best b ON a.doc_id < b.doc_id WHERE share > 0.85""",
    "near_duplicates_all": f"""WITH sets AS (SELECT doc_id, source, list_sort(list_distinct({_WORDS})) AS w FROM documents), classes AS (SELECT source, w, min(doc_id) AS class FROM sets WHERE len(w) > 0 GROUP BY source, w)
SELECT a.class AS a, b.class AS b, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) AS share FROM classes a JOIN classes b ON a.source IS NOT DISTINCT FROM b.source AND a.class < b.class WHERE len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) > 0.85
UNION ALL SELECT class, doc_id, 1.0 FROM sets s JOIN classes c ON s.source IS NOT DISTINCT FROM c.source AND s.w = c.w WHERE doc_id <> class""",
    "per_document_cap": f"""WITH {_MAIN}, {_RANKED}, placed AS (SELECT d.source, d.doc_id, r.rank, row_number() OVER (PARTITION BY d.source ORDER BY r.rank) AS place FROM ranked r JOIN documents d USING (doc_id) WHERE r.rank <= 100)
SELECT * FROM placed WHERE place <= 3""",
    "grep_lines": _grep("?"),
    "grep_ignore_case": _grep("?i"),
    "grep_path_glob": _grep("?i", f"regexp_matches(vfs_path, '{glob_regex('/docs/src1/en/*.md')}')"),
    "grep_keyset_page": f"""WITH {_NODES}, files AS (SELECT * FROM nodes WHERE id >= 100 AND regexp_matches(content, '(?im){GREP}') ORDER BY id LIMIT 200),
cut AS (SELECT id AS node_id, uri, vfs_path AS path, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files)
SELECT node_id, uri, path, line::BIGINT AS line, substring(trim(raw, ' '), 1, 300) AS text FROM cut WHERE regexp_matches(raw, '(?is){GREP}') AND (node_id <> 100 OR line > 1) ORDER BY node_id, line LIMIT 60""",
    "grep_file_window": f"""WITH {_NODES}, files AS (SELECT id FROM nodes WHERE regexp_matches(content, '(?i)the') ORDER BY id LIMIT 201), head AS (SELECT id FROM files ORDER BY id LIMIT 200)
SELECT (SELECT count(*) FROM head) AS scanned_files, (SELECT max(id) FROM head) AS last_node_id, (SELECT count(*) > 200 FROM files) AS has_more_files""",
    "glob_page": f"WITH {_NODES} SELECT vfs_path AS path, uri, 'doc' AS role, size_bytes FROM nodes WHERE regexp_matches(vfs_path, '(?s){plan_glob('/docs/src[0-3]/**').regex}') ORDER BY path, uri LIMIT 50 OFFSET 25",
    "ls_root": "SELECT 0::BIGINT AS skills, count(*) AS docs, count(DISTINCT source) AS collections FROM documents d LEFT JOIN labels USING (doc_id)",
    "ls_collections": "SELECT source AS collection, count(*) AS docs FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "ls_children": _children(""),
    "ls_children_deep": _children("de"),
    "catalog_collections": f"""WITH {_SOURCES}, c AS (SELECT doc_id AS id, len(string_split(text, chr(10))) AS n FROM documents)
SELECT collection, count(*) FILTER (WHERE status = 'ready') AS docs, sum(n)::BIGINT AS chunks, count(*) FILTER (WHERE status = 'needs_ocr') AS needs_ocr, count(*) FILTER (WHERE status = 'failed') AS failed FROM sources JOIN c USING (id) GROUP BY collection""",
    "catalog_top_titles": f"WITH {_SOURCES}, placed AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY id DESC, name) AS place FROM sources WHERE status = 'ready') SELECT collection, string_agg(name, ', ' ORDER BY place) AS titles FROM placed WHERE place <= 6 GROUP BY collection",
    "catalog_problems": f"WITH {_SOURCES} SELECT name, collection, status, detail FROM sources WHERE status <> 'ready'",
    "source_report": f"""WITH {_SOURCES} SELECT s.id, s.collection, s.name, s.status, 1::BIGINT AS files, len(string_split(d.text, chr(10)))::BIGINT AS chunks,
  (SELECT count(*) FROM embeddings e WHERE e.vec_id = s.id) AS embedded FROM sources s JOIN documents d ON d.doc_id = s.id""",
    "status_histogram": f"WITH {_SOURCES} SELECT status, count(*) AS n FROM sources GROUP BY status",
    "resource_list_page": f"""WITH {_NODES}, all_rows AS (SELECT 0 AS grp, '' AS sort, 'ctx://index' AS uri UNION ALL SELECT 1, url, url FROM pages UNION ALL SELECT 2, path, uri FROM nodes)
SELECT * FROM all_rows ORDER BY grp, sort, uri LIMIT 100 OFFSET 100""",
    "uri_encode": "SELECT page_id, replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS encoded FROM pages",
    "vfs_path": f"WITH {_NODES} SELECT id, vfs_path AS path, uri FROM nodes",
    "token_estimates": "SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens FROM documents",
    "content_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "ingest_dedup_by_hash": "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "ingest_diff": f"WITH {_REVISED} SELECT i.collection, i.name, CASE WHEN c.doc_id IS NULL THEN 'new' WHEN c.hash = i.hash AND c.status = 'ready' THEN 'unchanged' ELSE 'changed' END AS change FROM incoming i LEFT JOIN current c USING (collection, name)",
    "rename_reclaim": f"""WITH {_REVISED}, moved AS (SELECT collection, name || '-moved' AS name, hash FROM incoming WHERE name::BIGINT % 7 = 0)
SELECT m.collection, m.name, c.name AS old_name FROM moved m JOIN current c USING (collection, hash) WHERE c.doc_id % 2 <> 0""",
    "distinct_paths": r"""WITH d AS (SELECT doc_id AS id, source AS c, lang || (n_chars % 50) AS stem FROM documents),
stored AS (SELECT DISTINCT c, stem, CASE WHEN id % 2 = 0 THEN 0 ELSE id % 4 END AS n FROM d WHERE id % 3 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY c, stem ORDER BY id) AS no FROM d WHERE id % 3 <> 0),
free AS (SELECT g.c, g.stem, k, row_number() OVER (PARTITION BY g.c, g.stem ORDER BY k) AS no
  FROM (SELECT c, stem, max(no) AS most FROM placed GROUP BY 1, 2) g, range(0, g.most + 5) AS t(k)
  WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.c = g.c AND s.stem = g.stem AND s.n = k))
SELECT id, stem || CASE k WHEN 0 THEN '' ELSE '-' || k END || '.md' AS path FROM placed JOIN free USING (c, stem, no)""",
    "chunk_neighbours": "SELECT a.conv_id AS node_id, a.turn AS ord, b.turn AS near, b.role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 AND a.turn <> b.turn",
    "read_window": "SELECT conv_id AS node_id, turn AS ord, role, text FROM conversations WHERE conv_id = 12 AND turn BETWEEN 2 AND 4 AND turn <> 3",
    "lines_explode": "SELECT doc_id, i AS line_no, length(line) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)",
    "paragraphs": r"SELECT doc_id, i - 1 AS pos, sha256(trim(part, ' ')) AS hash FROM (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\n[ \t]*\n') AS p FROM documents))",
    "html_title_h1": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1 FROM pages",
    "eval_recall_mrr": f"""WITH {_nearest()}, hits AS (SELECT n.query_id, w.label AS wanted, n.rank, e.label = w.label AS hit FROM near n JOIN embeddings e USING (vec_id) JOIN embeddings w ON w.vec_id = n.query_id)
SELECT query_id, round(count(*) FILTER (WHERE hit AND rank <= 5) / (SELECT count(*) FROM embeddings e WHERE e.label = wanted), 6) AS recall5, round(coalesce(1 / min(rank) FILTER (WHERE hit), 0.0), 6) AS reciprocal_rank FROM hits GROUP BY query_id, wanted""",
    "completion_prefix": "SELECT DISTINCT source FROM documents WHERE source ILIKE 'SRC1%' ORDER BY source LIMIT 100",
    "changes_since": "SELECT DISTINCT 'ctx://docs/users/' || user_id AS uri FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND uri > 'ctx://docs/users/2' ORDER BY uri LIMIT 50",
    "json_rows": "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region",
} | {name: _glob(pattern) for name, pattern in GLOBS.items()} | engine_queries.ORACLES | function_queries.ORACLES
