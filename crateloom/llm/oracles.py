"""DuckDB statements for the operators that SQL can express, written from their definitions."""
from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"

NGRAM_JACCARD = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
nodes AS (SELECT s, min(doc_id) AS node, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT node, n, unnest(s) AS x FROM nodes),
common AS (SELECT a.node AS a, b.node AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
           FROM items a JOIN items b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * i >= 90 * (na + nb - i)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(comp.c, sets.doc_id) AS component_id
FROM sets LEFT JOIN nodes ON len(sets.s) > 0 AND nodes.s = sets.s LEFT JOIN comp ON comp.a = nodes.node"""

LINE_TEMPLATES = r"""
WITH texts AS (SELECT DISTINCT md5(text) AS k, text FROM documents WHERE text IS NOT NULL),
cut AS (SELECT k, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM texts),
toks AS (SELECT k, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda t: t <> '') AS t FROM cut),
lines AS (SELECT k, line, t, len(t) || ':' || array_to_string(list_transform(t[1:4], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END), ' ') AS leaf
          FROM toks WHERE len(t) >= 3),
fields AS (SELECT k, line, leaf, len(t) AS n, unnest(t) AS tok, unnest(range(len(t))) AS pos FROM lines),
common AS (SELECT leaf, pos, tok FROM fields WHERE NOT regexp_matches(tok, '[0-9]') GROUP BY ALL HAVING count(DISTINCT k) >= 3),
shape AS (SELECT f.k, f.line, f.leaf, any_value(n) AS n, count(*) AS fixed, string_agg(f.pos || '=' || f.tok, ' ' ORDER BY f.pos) AS tpl
          FROM fields f JOIN common c ON c.leaf = f.leaf AND c.pos = f.pos AND c.tok = f.tok GROUP BY f.k, f.line, f.leaf),
good AS (SELECT * FROM shape WHERE fixed >= 0.5 * n),
totals AS (SELECT leaf, tpl, min(k) AS first FROM good GROUP BY ALL HAVING count(DISTINCT k) >= 3),
shared AS (SELECT line, min(k) AS first FROM lines GROUP BY line HAVING count(DISTINCT k) >= 2),
whose AS (SELECT l.k, l.line, coalesce(t.first, s.first) AS first FROM lines l LEFT JOIN good g ON g.k = l.k AND g.line = l.line
          LEFT JOIN totals t ON t.leaf = g.leaf AND t.tpl = g.tpl LEFT JOIN shared s ON s.line = l.line),
gone AS (SELECT k, list(line) AS drop_lines FROM whose WHERE k <> first GROUP BY k),
split AS (SELECT doc_id, text, coalesce(string_split(text, chr(10)), []) AS ls, coalesce(drop_lines, []) AS dl FROM documents LEFT JOIN gone ON gone.k = md5(text))
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(list_filter(ls, lambda x: list_contains(dl, x))) AS BIGINT) AS n_dropped,
       CASE WHEN text IS NOT NULL THEN array_to_string(list_filter(ls, lambda x: NOT list_contains(dl, x)), chr(10)) END AS text
FROM split"""

MIX_SOURCES = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(source, '') AS src, CAST(source IS NULL AS INT) AS none, CAST(coalesce(len(regexp_extract_all(text, {WORDS})), 0) AS BIGINT) AS size,
         md5('29:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS h FROM documents),
s AS (SELECT src, none, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY none, src) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM r),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM w),
f AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS try FROM c),
t AS (SELECT f.*, least(cap, coalesce((SELECT arg_min(try, ratio) FROM f WHERE try <= ratio), 0) * weight) AS target,
             CAST(ceil(source_size / 32.0) AS BIGINT) AS blocks, CAST(ceil(total / 32.0) AS BIGINT) AS seats FROM f),
awards AS (SELECT rank, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank, k) AS place
           FROM t, unnest(range(0, seats)) AS q(k) WHERE target > 0 AND k <= target / 32.0 * 2 + 2),
quota AS (SELECT t.rank, least(count(a.rank), 3 * any_value(blocks)) AS q FROM t LEFT JOIN awards a ON a.rank = t.rank AND a.place <= t.seats GROUP BY t.rank),
plan AS (SELECT t.*, q, CAST('0x' || substr(md5('29:' || src || ':' || none), 1, 12) AS BIGINT) % greatest(blocks, 1) AS shift FROM t JOIN quota USING (rank)),
laid AS (SELECT d.*, source_size, target, blocks, q, shift, CAST(sum(size) OVER (PARTITION BY d.src, d.none ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
         FROM d JOIN plan ON plan.src = d.src AND plan.none = d.none),
hit AS (SELECT *, unnest(CASE WHEN size > 0 THEN range((upto - size) // 32, (upto - 1) // 32 + 1) ELSE [0] END) AS i FROM laid)
SELECT doc_id, size, source_size, target, source,
       CAST(sum(CASE WHEN size = 0 THEN 0 ELSE (least(upto, (i + 1) * 32) - greatest(upto - size, i * 32))
                * (q // blocks + CASE WHEN (i * 2147483647 + shift) % blocks < q % blocks THEN 1 ELSE 0 END) END) AS BIGINT) AS taken
FROM hit GROUP BY doc_id, size, source_size, target, source, h, upto"""


HARD_NEGATIVES = """
WITH v AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.id AS anchor_id, v.id AS other, a.label = v.label AS same, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score
      FROM v AS a JOIN v ON a.id % 100 = 0 AND a.id <> v.id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
