"""DuckDB twins of this subpackage's queries, where SQL can express them.

None for the packing order of op1, parsed pages (op3), the piece lattice (op4),
trained scores (op8), learned rules (op9) and eigenvectors (op11): tests hold these
against brute force, round trips or held-out labels.
"""

from __future__ import annotations

from .licenses import BASE, TEMPLATES, template_grams

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = r"""WITH t AS (
  SELECT conv_id, speaker, text, place, place // 64 AS part FROM (
    SELECT conv_id, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS place FROM conversations)),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
pieces AS (
  SELECT t.conv_id, perspective, part, place, speaker = perspective AS own, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) AS body,
    CASE WHEN speaker = 'system' THEN '<|system|>' WHEN speaker = perspective THEN '<|assistant|>' ELSE '<|user name=' || regexp_replace(regexp_replace(speaker, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') || '|>' END || chr(10) AS head
  FROM t JOIN people p ON p.conv_id IS NOT DISTINCT FROM t.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begin_at FROM pieces)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY place) AS rendered,
  coalesce(string_agg(CAST(CAST(begin_at AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begin_at + length(body) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY place) FILTER (own), '') AS loss_spans,
  CAST(coalesce(sum(length(body) - 1) FILTER (own), 0) AS BIGINT) AS n_loss
FROM placed GROUP BY conv_id, perspective, part"""

OP5 = r"""WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS shuffle FROM documents),
s AS (
  SELECT source, source_size, n, CAST(n % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS most FROM (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS n FROM d GROUP BY source)),
climb AS (
  SELECT most / weight AS ratio, n,
    ((SELECT sum(source_size)::DOUBLE FROM s) - (sum(most) OVER w - most)) / ((SELECT sum(weight) FROM s) - (sum(weight) OVER w - weight)) AS level
  FROM s WINDOW w AS (ORDER BY most / weight, n ROWS UNBOUNDED PRECEDING)),
lev AS (SELECT level FROM climb WHERE ratio >= level ORDER BY ratio, n LIMIT 1),
goal AS (SELECT s.*, least(most, level * weight) AS target FROM s, lev),
q AS (
  SELECT d.*, g.source_size, g.target, g.n, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffle, d.doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM d JOIN goal g ON g.source IS NOT DISTINCT FROM d.source),
tags AS (SELECT n, size, turn * source_size + upto AS served, (turn * source_size + upto) / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS turn) WHERE size > 0 AND target > 0),
line AS (SELECT n, served, sum(size) OVER (ORDER BY finish, n, served ROWS UNBOUNDED PRECEDING) AS spent FROM tags),
cut AS (SELECT n, max(served) AS last_served FROM line WHERE spent <= (SELECT sum(source_size) FROM s) GROUP BY n),
done AS (
  SELECT q.*, CASE WHEN upto <= coalesce(last_served, -1) THEN 1 ELSE 0 END + CASE WHEN upto + source_size <= coalesce(last_served, -1) THEN 1 ELSE 0 END
    + CASE WHEN upto + 2 * source_size <= coalesce(last_served, -1) THEN 1 ELSE 0 END AS times
  FROM q LEFT JOIN cut ON cut.n = q.n)
SELECT doc_id, size, source_size, target, CAST(size * times AS BIGINT) AS taken, source, times FROM done"""

OP6 = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS words FROM documents),
g AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(words) - 3, 2)), lambda i: array_to_string(words[i:i + 4], ' ')))) END AS grams FROM w),
f AS (SELECT doc_id, md5(array_to_string(grams, '|')) AS set_id, grams FROM g),
c AS (SELECT set_id, min(doc_id) AS copy_id, count(*) AS n_copies, any_value(grams) AS grams, len(any_value(grams)) AS n FROM f GROUP BY set_id),
u AS (SELECT set_id, n, unnest(grams) AS gram FROM c),
p AS (SELECT a.set_id AS x, b.set_id AS y FROM u a JOIN u b ON a.gram = b.gram AND a.set_id <> b.set_id GROUP BY a.set_id, b.set_id, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
reach AS (SELECT set_id AS x, set_id AS y FROM c UNION SELECT r.x, p.y FROM reach r JOIN p ON p.x = r.y),
named AS (SELECT r.x AS set_id, min(c.copy_id) AS class_id FROM reach r JOIN c ON c.set_id = r.y GROUP BY r.x),
linked AS (SELECT p.x AS set_id, count(*) AS n_text_links, sum(c.n_copies) AS n_docs FROM p JOIN c ON c.set_id = p.y GROUP BY p.x)
SELECT f.doc_id, class_id, copy_id, n_copies, coalesce(n_text_links, 0) AS n_text_links, CAST(n_copies - 1 + coalesce(n_docs, 0) AS BIGINT) AS n_links
FROM f JOIN c USING (set_id) JOIN named USING (set_id) LEFT JOIN linked USING (set_id)"""

_GRAMS = ", ".join(f"({t}, '{label}', {str(base).lower()}, {n}, {at}, '{gram}')" for t, label, base, n, at, gram in template_grams(BASE, TEMPLATES, 3))

OP7 = f"""WITH grams(template, label, is_base, n_template, place, gram) AS (VALUES {_GRAMS}),
d AS (SELECT row_number() OVER () AS row_id, doc_id, {WORDS} AS words FROM documents),
e AS (SELECT row_id, unnest(range(0, len(words) - 2)) AS at_word, words FROM d WHERE len(words) >= 3),
r AS (SELECT row_id, at_word, array_to_string(words[at_word + 1:at_word + 3], ' ') AS gram FROM e),
v AS (SELECT DISTINCT row_id, template, label, is_base, n_template, at_word - place AS diagonal, place FROM r JOIN grams USING (gram)),
g AS (SELECT row_id, template, label, is_base, n_template, diagonal, count(*) = n_template - 2 AS exact FROM v GROUP BY row_id, template, label, is_base, n_template, diagonal),
m AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row_id, template ORDER BY diagonal) <= 2 THEN 0 ELSE 1 END AS fresh FROM g),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY row_id, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM m),
k AS (SELECT n.row_id, n.template, n.span, count(DISTINCT v.place + o.step) AS covered FROM n JOIN v ON v.row_id = n.row_id AND v.template = n.template AND v.diagonal = n.diagonal, (SELECT unnest([0, 1, 2]) AS step) o GROUP BY ALL),
s AS (
  SELECT n.row_id, n.label, n.is_base, count(*) FILTER (n.exact) AS n_exact, min(n.diagonal) FILTER (n.exact) AS first_exact, max(n.diagonal) FILTER (n.exact) AS last_exact, k.covered / n.n_template AS score
  FROM n JOIN k ON k.row_id = n.row_id AND k.template = n.template AND k.span = n.span GROUP BY n.row_id, n.template, n.label, n.is_base, n.n_template, n.span, k.covered),
h AS (SELECT * FROM s WHERE n_exact > 0 OR NOT is_base AND score >= 0.6),
a AS (
  SELECT row_id, sum(n_exact) FILTER (is_base) AS n_base, min(first_exact) FILTER (is_base) AS first_word, max(last_exact) FILTER (is_base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM h GROUP BY row_id)
SELECT doc_id, len(words) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN a USING (row_id)"""

OP10 = """WITH v AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row_id AS query_row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.vector, c.vector) AS BIGINT) AS score
  FROM v q JOIN v c ON c.row_id <> q.row_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id, query_row ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""



def _rounds(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Lloyd's rounds over whole numbers, written out."""
    near = lambda t: f"""n{t} AS MATERIALIZED (
  SELECT row_id, vec_id, vector, c, CAST(distance AS BIGINT) AS distance FROM (
    SELECT v.row_id, v.vec_id, v.vector, c.c, list_sum(list_transform(list_zip(v.vector, c.centre), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM v, c{t} c)
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY distance, c) = 1)"""  # noqa: E731
    moved = lambda t: f"""s{t} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(vector) AS x, unnest(range({dims})) AS j FROM n{t}) GROUP BY c, j),
c{t + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(m.centre, o.centre) AS centre FROM c{t} o
  LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS centre FROM s{t} GROUP BY c) m ON m.c = o.c)"""  # noqa: E731
    body = ",\n".join(f"{near(t)},\n{moved(t)}" for t in range(rounds))
    return f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, vector) - 1 AS c, vector AS centre FROM (
  SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, vector FROM v ORDER BY h NULLS LAST, vector LIMIT {k})),
{body},
{near(rounds)}
SELECT vec_id, CAST(n.c AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(centre, ',')) AS centroid_sha256
FROM n{rounds} n JOIN c{rounds} c ON c.c = n.c"""


OP12 = _rounds()

OP13 = """WITH p AS (SELECT row_number() OVER () AS row_id, page_id, encode(coalesce(html, '')) AS payload FROM pages),
r AS (
  SELECT page_id, payload, first_value(page_id) OVER w AS main_id, octet_length(payload) >= 1000 AND row_number() OVER w > 1 AS again
  FROM p WINDOW w AS (PARTITION BY payload ORDER BY page_id DESC NULLS LAST, row_id))
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN main_id END AS refers_to FROM r"""

ORACLES: dict[str, str] = {
    "op2_perspectives": OP2,
    "op5_fair_mix": OP5,
    "op6_chosen_path_join": OP6,
    "op7_license_diagonals": OP7,
    "op10_uniform_threshold": OP10,
    "op12_va_clusters": OP12,
    "op13_transactions": OP13,
}
