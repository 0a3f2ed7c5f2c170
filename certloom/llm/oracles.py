"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = f"regexp_extract_all({_LOW.format('text')}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
_SPACES = f"regexp_extract_all({_LOW.format('text')}, '[^\\x20\\x09-\\x0D]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_LETTERS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_LETTERS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS k FROM (SELECT item, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
lists AS (SELECT doc_id, n, list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')) AS ks FROM d, lens WHERE len(w) >= n),
dw AS (SELECT doc_id, n, unnest(ks) AS k, generate_subscripts(ks, 1) AS i FROM lists),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, item FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
met AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN met USING (doc_id)
"""

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACES} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sets sa ON a = sa.doc_id JOIN sets sb ON b = sb.doc_id WHERE 100 * n >= 75 * (len(sa.s) + len(sb.s) - n)),
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM ends UNION SELECT r.doc_id, b.b FROM reach r JOIN ends b ON r.other = b.a),
named AS (SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(min(r.other), s.doc_id)) AS component_id FROM sets s LEFT JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id, len(s.s))
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM named
"""

#: The same links at another limit, with their number.
JACCARD_JOIN = NEAR_DEDUP.replace("100 * n >= 75", "100 * n >= 80").rpartition("SELECT")[0] + """
SELECT n.doc_id, n_shingles, component_id, coalesce(k, 0) AS n_links FROM named n LEFT JOIN (SELECT a, count(*) AS k FROM ends GROUP BY a) e ON n.doc_id = e.a
"""


def chat(control: str) -> str:
    escaped = lambda c: f"regexp_replace({c}, '<(\\\\*)\\|', '<\\\\\\1|', 'g')"
    role = escaped("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")
    return f"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{control}'), (-1, 1, 'assistant', '{control}')),
made AS (SELECT *, 12 + length({role}) + 1 + length({escaped('text')}) + 11 AS chars, CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'tool' THEN 't' ELSE 'x' END AS letter FROM rows_)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(chars) AS BIGINT) AS formatted_chars, regexp_full_match(string_agg(letter, '' ORDER BY turn, role, text), 's?ut*a([ut]t*a)*') AS valid
FROM made GROUP BY conv_id
"""
