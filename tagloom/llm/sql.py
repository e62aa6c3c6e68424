"""SQL (DuckDB) of those corpus queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SUBSTRINGS = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_PLAIN}') AS ws FROM documents),
g AS (SELECT doc_id, k, array_to_string(ws[k:k + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS k FROM w WHERE len(ws) >= 13)),
f AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS earliest FROM g),
h AS (SELECT DISTINCT doc_id, k + j AS p FROM f, range(0, 13) AS t(j) WHERE earliest < doc_id),
p AS (SELECT w.doc_id, x.p, x.word FROM w, LATERAL (SELECT unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p) AS x),
kept AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.p) AS kept, count(*) AS n FROM p ANTI JOIN h ON p.doc_id = h.doc_id AND p.p = h.p GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""

CONTAMINATION = f"""WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM documents),
b AS (SELECT item_id, ws, least(13, len(ws)) AS n FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM benchmark) WHERE len(ws) > 0),
bg AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS s FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM b)),
dg AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS s FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, (SELECT DISTINCT n FROM bg) WHERE len(ws) >= n)),
hits AS (SELECT doc_id, k, dg.n, item_id FROM dg JOIN bg ON dg.s = bg.s AND dg.n = bg.n),
hit AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM (SELECT doc_id, k, unnest(range(0, n)) AS j FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit ON w.doc_id = hit.doc_id LEFT JOIN items ON w.doc_id = items.doc_id"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(reach.b) AS component_id FROM w JOIN reach ON reach.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id"""

#: The others learn a model, sign lines, encode sound or pieces, or add spans: tests/llm holds them against brute force.
ORACLES = {"op3_substring_dedup": SUBSTRINGS, "op4_decontamination": CONTAMINATION, "op8_jaccard_join": JACCARD}
