"""SQL for the operators that it can express, written apart from their plans."""

from __future__ import annotations

from . import decontamination as dc
from . import licenses

#: Highest inner products of the quantised vectors, ties to the smaller vec_id.
TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
u AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM u AS q JOIN v AS c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def license_scan() -> str:
    """Grams are compared by their words, where the plan joins hashes first."""
    values = ", ".join(f"({i}, '{label}', {i < len(licenses.PHRASES)}, '{text}')" for i, (label, text) in enumerate(licenses.PHRASES + licenses.NOTICES))
    words = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    k = licenses.K
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words("text")} AS w FROM documents),
g AS (SELECT rid, pos, w[pos + 1:pos + {k}] AS gram FROM (SELECT rid, w, unnest(range(len(w) - {k - 1})) AS pos FROM d)),
t AS (SELECT template, label, base, {words("text")} AS w FROM (VALUES {values}) AS v(template, label, base, text)),
p AS (SELECT template, label, base, len(w) - {k - 1} AS grams, tpos, w[tpos + 1:tpos + {k}] AS gram FROM (SELECT *, unnest(range(len(w) - {k - 1})) AS tpos FROM t)),
votes AS (SELECT rid, template, label, base, grams, tpos, pos - tpos AS diagonal FROM g JOIN p USING (gram)),
diagonals AS (SELECT rid, template, label, base, grams, diagonal, count(*) AS n FROM votes GROUP BY ALL),
starts AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <= {licenses.GAP} THEN 0 ELSE 1 END AS new FROM diagonals),
chains AS (SELECT *, sum(new) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span FROM starts),
spans AS (
    SELECT c.rid, c.template, any_value(c.label) AS label, any_value(c.base) AS base, any_value(c.grams) AS grams, max(c.diagonal) - min(c.diagonal) AS width, count(DISTINCT tpos) / any_value(c.grams) AS share
    FROM chains c JOIN votes v USING (rid, template, diagonal) GROUP BY c.rid, c.template, c.span
),
bases AS (SELECT rid, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM diagonals WHERE base AND n = grams GROUP BY rid),
named AS (
    SELECT rid, label FROM diagonals WHERE base AND n = grams UNION SELECT rid, label FROM spans WHERE NOT base AND share >= {licenses.COVERAGE} AND width <= grams / 2
),
labels AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM named GROUP BY rid),
scores AS (SELECT rid, max(share) AS share FROM spans WHERE NOT base GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    CASE WHEN n_base > 0 THEN CAST(1.0 AS DOUBLE) ELSE coalesce(share, CAST(0.0 AS DOUBLE)) END AS score
FROM d LEFT JOIN bases USING (rid) LEFT JOIN labels USING (rid) LEFT JOIN scores USING (rid)
"""


def leaks() -> str:
    """Windows are compared by their words, where the plan joins hashes first."""
    place = f"""CASE WHEN t[1] BETWEEN '0' AND '9' OR lower(t) IN ({_list(dc.NUMBERS)}) THEN '{dc.NUM}' WHEN lower(t) IN ({_list(dc.UNITS)}) THEN '{dc.UNIT}'
    WHEN t[1] <> lower(t[1]) AND substr(t, 2) = lower(substr(t, 2)) THEN '{dc.NAME}' ELSE lower(t) END"""
    marks = _list([dc.NUM, dc.UNIT, dc.NAME])
    parts = lambda key, source: f"SELECT {key}, list_filter(string_split_regex(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS w FROM {source}"
    forms = lambda name: f"SELECT *, list_transform(w, lambda t: lower(t)) AS low, list_transform(w, lambda t: {place}) AS can, len(w) AS n FROM {name}"
    window = lambda name: f"""SELECT *, low[pos + 1:pos + k] AS words, can[pos + 1:pos + k] AS places FROM (SELECT *, unnest(range(n - k + 1)) AS pos FROM {name} WHERE n >= k)"""
    slots = f"len(list_filter(places, lambda t: t IN ({marks})))"
    return f"""
WITH i0 AS ({parts("item_id", "benchmark")}), i1 AS (SELECT *, least(n, {dc.WINDOW}) AS k FROM ({forms("i0")}) WHERE n > 0), i2 AS ({window("i1")}),
d0 AS ({parts("doc_id", "documents")}), d1 AS (SELECT * FROM ({forms("d0")}) CROSS JOIN (SELECT DISTINCT k FROM i1)), d2 AS ({window("d1")}),
met AS (
    SELECT d.doc_id, i.item_id, i.n, i.k, d.pos, i.pos AS item_pos, FALSE AS template, i.words AS iw, d.words AS dw, i.places FROM d2 d JOIN i2 i ON d.k = i.k AND d.words = i.words
    UNION ALL
    SELECT d.doc_id, i.item_id, i.n, i.k, d.pos, i.pos, TRUE, i.words, d.words, i.places FROM d2 d JOIN (SELECT * FROM i2 WHERE {slots} > 0 AND {slots} <= k - least({dc.LITERAL}, k - 1)) i ON d.k = i.k AND d.places = i.places
),
covered AS (SELECT doc_id, item_id, pos - item_pos AS diagonal, template, unnest(range(item_pos, item_pos + k)) AS word FROM met),
words AS (SELECT doc_id, item_id, diagonal, count(DISTINCT word) FILTER (WHERE NOT template) AS plain, count(DISTINCT word) AS every FROM covered GROUP BY ALL),
paired AS (SELECT doc_id, item_id, pos - item_pos AS diagonal, unnest(list_zip(iw, dw, places)) AS p FROM met),
agreed AS (SELECT doc_id, item_id, diagonal, count(DISTINCT (p[1], p[2])) FILTER (WHERE p[3] IN ({marks})) = count(DISTINCT p[1]) FILTER (WHERE p[3] IN ({marks})) AS agree FROM paired GROUP BY ALL),
starts AS (SELECT doc_id, item_id, pos - item_pos AS diagonal, any_value(n) AS n, min(pos) AS first_word FROM met GROUP BY ALL),
passages AS (
    SELECT *, CASE WHEN plain >= least({dc.RUN}, ceil(n * CAST({dc.SHARE} AS DOUBLE))) THEN 'verbatim' WHEN every >= least({dc.RUN}, ceil(n * CAST({dc.SHARE} AS DOUBLE))) AND agree THEN 'reparameterised' END AS kind
    FROM words JOIN agreed USING (doc_id, item_id, diagonal) JOIN starts USING (doc_id, item_id, diagonal)
),
sized AS (SELECT *, CASE WHEN kind = 'verbatim' THEN plain ELSE every END AS n_words FROM passages WHERE kind IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_words DESC, first_word, kind DESC) AS r FROM sized)
SELECT doc_id, item_id, first_word, n_words, n_words / n AS coverage, kind FROM best WHERE r = 1
"""
