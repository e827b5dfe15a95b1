"""DuckDB SQL for the contract queries that SQL can express."""

from korral.llm.license_scan import BASE, TEMPLATES

OP1 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
"""

# The quotas in closed form: sources in the order of their cap per weight; the first whose
# share of what is left stays under its cap ends the capped ones.
OP6 = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2 * n / weight::DOUBLE, source IS NULL, encode(source)) AS k FROM w),
l AS (
  SELECT *, 1.5 * (sum(n) OVER ())::DOUBLE - coalesce(sum(2 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS remaining,
         (sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS weights
  FROM o),
f AS (SELECT min(k) AS k FROM l WHERE weight * (remaining / weights) < 2 * n),
t AS (
  SELECT source, n,
         CASE WHEN l.k < coalesce(f.k, 9223372036854775807) THEN (2 * n)::DOUBLE
              ELSE weight * (SELECT remaining / weights FROM l AS x WHERE x.k = f.k) END AS target
  FROM l, f),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS quota FROM t),
r AS (SELECT *, CASE WHEN n > 0 THEN quota // n ELSE 0 END AS passes, CASE WHEN n > 0 THEN quota % n ELSE 0 END AS rest FROM q),
c AS (
  SELECT d.*, r.n, r.target, r.passes, r.rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
m AS (SELECT *, rest > 0 AND size > 0 AND 2 * run + size <= 2 * rest AS more FROM c),
g AS (SELECT *, rest - sum(CASE WHEN more THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM m),
p AS (
  SELECT *, rest > 0 AND gap <> 0 AND more = (gap < 0) AND abs(size - abs(gap)) < abs(gap) AS fits FROM g),
b AS (
  SELECT *, fits AND row_number() OVER (PARTITION BY source, fits ORDER BY abs(size - abs(gap)), h, doc_id) = 1 AS flip FROM p)
SELECT doc_id, size, n AS source_size, target,
       (size * (passes + CASE WHEN more <> flip THEN 1 ELSE 0 END))::BIGINT AS taken
FROM b
"""

ORACLES = {"op1_exact_dedup": OP1, "op6_source_mixing": OP6}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT *, string_split(notice, ' ') AS nw, string_split(phrase, ' ') AS kw FROM (VALUES {', '.join(f"({i}, '{a}', '{b}', '{c}', {str(i < BASE).lower()})" for i, (a, b, c) in enumerate(TEMPLATES))}) AS t(i, notice, phrase, label, base)),
v AS (SELECT DISTINCT unnest(nw) AS word FROM t),
x AS (SELECT DISTINCT uid, lower(word) AS word FROM (SELECT uid, unnest(w) AS word FROM d)),
f AS (SELECT v.word, ln(((SELECT count(*) FROM d) + 1) / (count(uid) + 1)::DOUBLE) + 1 AS idf FROM v LEFT JOIN x USING (word) GROUP BY v.word),
z AS (SELECT i, j, nw[j] AS word, idf / sum(idf) OVER (PARTITION BY i) AS weight FROM t, LATERAL (SELECT unnest(range(1, len(nw) + 1)) AS j), f WHERE f.word = nw[j]),
l AS (SELECT i, min(s) AS lead FROM t, LATERAL (SELECT unnest(range(0, len(nw))) AS s) WHERE list_slice(nw, s + 1, s + len(kw)) = kw GROUP BY i),
q AS (SELECT uid, unnest(range(1, len(w) + 1)) AS at, unnest(w) AS word FROM d),
p AS (SELECT q.uid, q.at - 1 AS start, t.i, t.label, t.base, l.lead FROM q JOIN t ON q.word = t.kw[1] JOIN l USING (i) JOIN d USING (uid) WHERE list_slice(d.w, q.at, q.at + len(t.kw) - 1) = t.kw),
s AS (SELECT p.uid, p.i, p.start, sum(CASE WHEN p.start - p.lead + z.j >= 1 AND d.w[p.start - p.lead + z.j] = z.word THEN z.weight ELSE 0 END) AS score FROM p JOIN z USING (i) JOIN d USING (uid) GROUP BY ALL),
a AS (
  SELECT p.uid, count(*) FILTER (base) AS n_base, min(p.start) FILTER (base) AS first_word, max(p.start) FILTER (base) AS last_word,
         coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(score) AS score
  FROM p JOIN s ON s.uid = p.uid AND s.i = p.i AND s.start = p.start GROUP BY p.uid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(least(1.0, coalesce(score, 0)), 9) AS score
FROM d LEFT JOIN a USING (uid)
"""

OP8 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT uid, array_to_string(list_slice(w, i, i + 4), ' ') AS gram FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i)),
n AS (SELECT uid, count(*) AS n FROM g GROUP BY uid),
o AS (SELECT a.uid AS a, b.uid AS b, count(*) AS i FROM g a JOIN g b ON a.gram = b.gram AND a.uid <> b.uid GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.uid = a JOIN n y ON y.uid = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT uid AS a, uid AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(t.doc_id) AS component_id
FROM d LEFT JOIN n USING (uid) JOIN r ON r.a = d.uid JOIN d t ON t.uid = r.b GROUP BY d.uid, d.doc_id
"""

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win FROM b, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i)),
x AS (SELECT uid, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win FROM d, (SELECT DISTINCT m FROM k), LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i)),
h AS (SELECT uid, i, x.m, item_id FROM x JOIN k ON x.m = k.m AND x.win = k.win),
c AS (SELECT uid, count(DISTINCT pos) AS n_hit FROM (SELECT uid, unnest(range(i, i + m)) AS pos FROM (SELECT DISTINCT uid, i, m FROM h)) GROUP BY uid),
s AS (SELECT uid, count(*) AS n_items, array_to_string(list(item ORDER BY item), ',') AS items FROM (SELECT DISTINCT uid, item_id::VARCHAR AS item FROM h) GROUP BY uid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (uid) LEFT JOIN s USING (uid)
"""

OP2 = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS uid, doc_id, CASE WHEN length(text) > 0 THEN string_split(text, chr(10)) ELSE [] END AS ls FROM documents),
l AS (SELECT uid, i - 1 AS line, regexp_extract_all(translate(ls[i], {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM d, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
g AS (SELECT DISTINCT uid, line, unnest(w) AS gram FROM l),
s AS (SELECT uid, line, count(*) AS n, array_to_string(list_sort(list(gram)), chr(31)) AS key FROM g GROUP BY ALL),
c AS (SELECT row_number() OVER () AS id, key, min((uid, line)) AS first, any_value(n) AS n FROM s GROUP BY key),
t AS (SELECT c.id, c.first, c.n, unnest(string_split(c.key, chr(31))) AS gram FROM c),
o AS (SELECT a.id, a.n, b.n AS m, count(*) AS i FROM t a JOIN t b ON a.gram = b.gram AND 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n AND b.first < a.first GROUP BY a.id, b.id, a.n, b.n),
x AS (SELECT DISTINCT id FROM o WHERE 100 * i >= 75 * (n + m - i)),
r AS (SELECT s.uid, s.line FROM s JOIN c USING (key) WHERE (s.uid, s.line) <> c.first OR id IN (SELECT id FROM x)),
y AS (SELECT uid, count(*) AS n, array_to_string(list(line ORDER BY line), ',') AS removed FROM r GROUP BY uid)
SELECT doc_id, len(ls) AS n_lines, coalesce(y.n, 0) AS n_removed, coalesce(removed, '') AS removed FROM d LEFT JOIN y USING (uid)
"""

ORACLES |= {"op2_line_dedup": OP2, "op7_license_scan": OP7, "op8_ngram_jaccard_join": OP8, "op10_decontamination": OP10}
