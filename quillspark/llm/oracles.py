"""DuckDB SQL for the corpus queries that SQL can express, for small tables: it compares all pairs."""

from __future__ import annotations

from . import licenses

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT t.vec_id, (SELECT count(*) FROM link WHERE x = t.vec_id) AS n_links, least(t.vec_id, coalesce((SELECT min(y) FROM reach WHERE x = t.vec_id), t.vec_id)) AS component_id, t.vec_id <= coalesce((SELECT min(y) FROM reach WHERE x = t.vec_id), t.vec_id) AS kept FROM embeddings t
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id, d.doc_id <= coalesce(y, d.doc_id) AS kept FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN least_of ON d.doc_id = x
"""

_PHRASES = [(label, phrase, True) for phrase, label in licenses.BASE.items()] + [(label, phrase, False) for label, phrase in licenses.TEMPLATES]
_PAIRS = ", ".join(f"({k}, '{label}', {str(base).lower()}, {len(w) - 1}, {t}, '{w[t]}', '{w[t + 1]}')" for k, (label, phrase, base) in enumerate(_PHRASES) for w in [phrase.split()] for t in range(len(w) - 1))
_PLACE, _STANDS = "base AND cover >= 1", f"((base AND cover >= 1) OR (NOT base AND cover >= {licenses.COVER}))"

LICENSES = f"""
WITH known(template, label, base, pairs, t, w1, w2) AS (VALUES {_PAIRS}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM} AS w FROM documents),
p AS (SELECT rid, p - 1 AS p, w[p] AS w1, w[p + 1] AS w2 FROM (SELECT rid, w, unnest(range(1, len(w))) AS p FROM d)),
h AS (SELECT rid, template, label, base, pairs, p, t, p - t AS diagonal FROM p JOIN known USING (w1, w2)),
g AS (SELECT rid, template, base, diagonal, min(p) AS low, max(p) AS high FROM h GROUP BY ALL),
a AS (SELECT *, lag(diagonal) OVER o AS last, max(high) OVER (PARTITION BY rid, template ORDER BY diagonal, low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g WINDOW o AS (PARTITION BY rid, template ORDER BY diagonal, low)),
b AS (SELECT *, sum(CASE WHEN base OR last IS NULL OR diagonal - last > {licenses.SHIFT} OR low - reach > {licenses.GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY rid, template ORDER BY diagonal, low) AS part FROM a),
l AS (SELECT h.rid, h.template, label, h.base, pairs, part, list(h.t ORDER BY h.p, h.t) AS ts, min(h.p) AS start FROM h JOIN b ON h.rid = b.rid AND h.template = b.template AND h.diagonal = b.diagonal GROUP BY ALL),
m AS (SELECT rid, label, base, start, len(list_filter(range(1, len(ts) + 1), lambda i: i = 1 OR ts[i] > list_max(ts[1 : i - 1])))::DOUBLE / pairs AS cover FROM l),
f AS (SELECT rid, count(*) FILTER ({_PLACE}) AS n_base, min(start) FILTER ({_PLACE}) AS first_word, max(start) FILTER ({_PLACE}) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER ({_PLACE}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER ({_STANDS}) AS labels, max(cover) AS score FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN f USING (rid)
"""

DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_ALNUM} AS w FROM benchmark),
wi AS (SELECT DISTINCT item, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
wd AS (SELECT rid, k, p, array_to_string(w[p : p + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM wi) WHERE len(w) >= k)),
hit AS (SELECT rid, p, k, item FROM wd JOIN wi USING (k, g)),
h AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM hit) GROUP BY 1),
f AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (rid) LEFT JOIN f USING (rid)
"""
