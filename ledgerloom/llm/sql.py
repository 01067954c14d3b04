"""DuckDB SQL for the rows of the queries that SQL can express."""

UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

_SQUEEZED = rf"trim(regexp_replace(translate({{}}, {UPPER}, {LOWER}), '[ \t\n\r\x0b\x0c]+', ' ', 'g'), ' ')"

QUOTES = rf"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS id, conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations),
l AS (
  SELECT id, k, regexp_extract(line, '^((?:[ \t]*>)+)[ \t]?', 1) AS mark, line
  FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM m)),
q AS (
  SELECT id, k, length(mark) - length(replace(mark, '>', '')) AS level,
    CASE WHEN mark = '' THEN line ELSE regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') END AS rest FROM l),
g AS (
  SELECT *, k - row_number() OVER (PARTITION BY id, level ORDER BY k) AS island FROM q),
p AS (
  SELECT id, level, min(k) AS place, {_SQUEEZED.format("string_agg(rest, ' ' ORDER BY k)")} AS passage
  FROM g WHERE level > 0 GROUP BY id, level, island),
b AS (
  SELECT m.id, m.conv_id, m.turn, m.role, CASE WHEN count(*) FILTER (q.level > 0) = 0 THEN any_value(m.text)
    ELSE trim(coalesce(string_agg(q.rest, chr(10) ORDER BY q.k) FILTER (q.level = 0), ''), E' \t\r\n') END AS body
  FROM m LEFT JOIN q ON m.id = q.id GROUP BY ALL),
o AS (
  SELECT DISTINCT conv_id, turn, {_SQUEEZED.format("part")} AS passage FROM (
    SELECT conv_id, turn, body AS part FROM b UNION ALL
    SELECT conv_id, turn, unnest(regexp_split_to_array(body, '\n[ \t\r]*\n')) FROM b UNION ALL
    SELECT conv_id, turn, unnest(string_split(body, chr(10))) FROM b)),
f AS (SELECT conv_id, passage, min(turn) AS original FROM o GROUP BY ALL),
k AS (
  SELECT m.conv_id, m.turn, p.level, p.place, f.original FROM p JOIN m USING (id) JOIN f ON f.conv_id = m.conv_id AND f.passage = p.passage
  WHERE p.passage <> '' AND f.original < m.turn),
parents AS (SELECT conv_id, turn, arg_min(original, (level, place)) AS parent, count(*) AS n_linked FROM k GROUP BY ALL),
climb AS (
  SELECT conv_id, turn, parent AS up, CAST(1 AS BIGINT) AS depth FROM parents UNION ALL
  SELECT c.conv_id, c.turn, p.parent, c.depth + 1 FROM climb c JOIN parents p ON p.conv_id = c.conv_id AND p.turn = c.up),
t AS (SELECT conv_id, turn, arg_max(up, depth) AS root, max(depth) AS depth FROM climb GROUP BY ALL),
x AS (
  SELECT b.conv_id, b.turn, b.role, b.body, parents.parent, coalesce(t.root, b.turn) AS root, coalesce(t.depth, 0) AS depth,
    (SELECT count(*) FROM p WHERE p.id = b.id AND passage <> '') AS n_quotes, coalesce(n_linked, 0) AS n_linked
  FROM b LEFT JOIN parents ON b.conv_id = parents.conv_id AND b.turn = parents.turn LEFT JOIN t ON b.conv_id = t.conv_id AND b.turn = t.turn)
SELECT conv_id, turn, role, body, parent, root, depth, row_number() OVER (PARTITION BY conv_id ORDER BY root, depth, turn) - 1 AS position, n_quotes, n_linked FROM x
"""

#: A word is a run of digits, a-z and characters beyond ASCII, so \x01 splits safely.
_WORDS = rf"[x FOR x IN string_split_regex(translate(coalesce({{}}, ''), {UPPER}, {LOWER}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> '']"

DECONTAMINATE = rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT size FROM v),
p AS (
  SELECT n, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT n, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, s WHERE len(w) >= size)),
h AS (SELECT p.n, p.i, p.size, v.item FROM p JOIN v ON p.size = v.size AND p.win = v.win),
hit AS (SELECT n, count(DISTINCT pos) AS n_hit FROM (SELECT n, unnest(generate_series(i, i + size - 1)) AS pos FROM h) GROUP BY n),
items AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT n, item FROM h) GROUP BY n)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (n) LEFT JOIN items USING (n)
"""

TOP_K = """
WITH e AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a * c.v[i] FOR a, i IN q.v]) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
