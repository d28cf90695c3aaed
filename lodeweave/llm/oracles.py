"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from lodeweave.llm.chat import CONFLICT
from lodeweave.llm.mixing import PART, SEED, TABLE
from lodeweave.llm.queries import CONFLICT_TEXT, MIX
from lodeweave.llm.winnow import WINDOW

_OP2 = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONFLICT_TEXT}'
  UNION ALL SELECT -1, 1, 'assistant', '{CONFLICT_TEXT}'
), written AS (
  SELECT *, length(regexp_replace(text, '{CONFLICT}', '\\1\\\\\\2\\3', 'g')) + CASE role
      WHEN 'system' THEN 18 WHEN 'user' THEN 18 WHEN 'assistant' THEN 6
      ELSE 21 + length(regexp_replace(role, '{CONFLICT}', '\\1\\\\\\2\\3', 'g')) END AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""

_MIX_WEIGHT = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX.items()) + " ELSE 1.0 END"


def mix_sql(docs: str = "documents") -> str:
    """The rows of poisson_mix() over the relation `docs`."""
    return f"""
WITH counts AS (SELECT source, count(*) AS n, ({_MIX_WEIGHT})::DOUBLE AS w FROM {docs} GROUP BY source),
rates AS (SELECT source, w * ((sum(n) OVER ())::DOUBLE / sum(w) OVER ()) / n AS rate FROM counts),
parted AS (SELECT source, rate, greatest(1, ceil(rate / {PART}))::BIGINT AS parts FROM rates),
pmf AS (SELECT source, parts, k, exp(-(rate / parts) + k * ln(rate / parts) - lgamma(k + 1)) AS p FROM parted, range(0, {TABLE + 1}) AS t(k)),
cdf AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
drawn AS (SELECT d.doc_id, r.source, j, (('0x' || substr(md5('{SEED}:' || d.doc_id || ':' || j), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM {docs} d JOIN parted r ON d.source IS NOT DISTINCT FROM r.source, range(1, r.parts + 1) AS t(j)),
tables AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
copies AS (SELECT DISTINCT doc_id, j, len(list_filter(cs, lambda c: c < u)) AS n FROM drawn JOIN tables USING (source)),
totals AS (SELECT doc_id, sum(n)::BIGINT AS n FROM copies GROUP BY doc_id)
SELECT d.*, i::INTEGER AS copy_no, substr(md5('{SEED}/' || d.doc_id || '/' || i), 1, 16) AS mix_key
FROM {docs} d JOIN totals USING (doc_id), range(1, n + 1) AS t(i)
"""


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every window of every document is compared with those of the items.
_OP13 = f"""
WITH items AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS win FROM items, range(1, greatest(len(w) - {WINDOW - 2}, 2)) AS t(i) WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM docs, (SELECT DISTINCT n FROM wins) k, range(1, len(w) - n + 2) AS t(i)),
met AS (SELECT DISTINCT r, i, n, win FROM places WHERE win IN (SELECT win FROM wins)),
hit AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM met, range(0, n) AS t(j) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM met JOIN wins USING (n, win)) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""



def _assigned(k: int) -> str:
    """The nearest entry of book{k} to each part, and its distance."""
    return f"""assigned{k} AS (SELECT r, p, (min(d * 64 + e) % 64)::BIGINT AS e, (min(d * 64 + e) // 64)::BIGINT AS d
  FROM (SELECT r, p, e, sum((a.x - b.x) * (a.x - b.x)) AS d FROM parts a JOIN book{k} b USING (p, j) GROUP BY r, p, e) GROUP BY r, p)"""


def _moved(k: int) -> str:
    """book{k}: the entries of the book before, moved to the means, rounded down, of what is nearest."""
    return f"""book{k} AS (SELECT p, b.e, j, CASE WHEN n IS NULL THEN b.x ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS x
  FROM book{k - 1} b LEFT JOIN (SELECT p, e, j, count(*) AS n, sum(x) AS s FROM parts JOIN assigned{k - 1} USING (r, p) GROUP BY p, e, j) USING (p, e, j))"""


_OP11 = f"""
WITH whole AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, (i - 1) // (len(v) // 16) AS p, (i - 1) % (len(v) // 16) AS j, v[i] AS x FROM whole, range(1, len(v) + 1) AS t(i)),
book0 AS (SELECT p, r - 1 AS e, j, x FROM parts WHERE r <= 64),
{_assigned(0)}, {_moved(1)}, {_assigned(1)}, {_moved(2)}, {_assigned(2)},
codes AS (SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM assigned2 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) FROM book2) AS codebooks_sha256
FROM whole JOIN codes USING (r)
"""

ORACLES: dict[str, str] = {"op11_segment_means": _OP11, "op13_winnowing": _OP13, "op2_chat_round_trip": _OP2, "op7_poisson_mix": mix_sql()}
