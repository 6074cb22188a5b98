"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: Words and windows of whole texts, hits by position, items by window.
OP10 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT r, i, x.n, win.item
  FROM (SELECT r, sizes.n, i, array_to_string(w[i : i + sizes.n - 1], ' ') AS s
        FROM d, sizes, unnest(range(1, len(w) - sizes.n + 2)) AS t(i) WHERE len(w) >= sizes.n) x
  JOIN win ON win.s = x.s AND win.n = x.n),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM occ) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

#: The same similarity join, its prefixes by each word's occurrences in distinct lines.
OP4 = r"""
WITH l AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, trim(regexp_replace(lower(x), '[\t\n\x0B\f\r ]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
  WHERE trim(regexp_replace(x, '[\t\n\x0B\f\r ]+', ' ', 'g')) <> ''),
c AS (SELECT line, min((doc_id, line_no)) AS p, list_distinct(string_split(line, ' ')) AS w FROM l GROUP BY line),
f AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM c) GROUP BY w),
k AS (
  SELECT line, len(ws) AS n, x.w AS w FROM (
    SELECT line, unnest(w) AS w, w AS ws FROM c) x JOIN f ON f.w = x.w
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY f.n, x.w) <= len(ws) - CAST(ceil(len(ws) * 4 / 5.0) AS INTEGER) + 1),
near AS (
  SELECT DISTINCT a.line AS la, b.line AS lb FROM k a JOIN k b
  ON a.w = b.w AND a.line <> b.line AND 4 * a.n <= 5 * b.n AND 4 * b.n <= 5 * a.n),
later AS (
  SELECT DISTINCT la FROM near JOIN c x ON x.line = la JOIN c y ON y.line = lb
  WHERE y.p < x.p AND 9 * len(list_intersect(x.w, y.w)) >= 4 * (len(x.w) + len(y.w))),
kept AS (SELECT p[1] AS doc_id, p[2] AS line_no FROM c WHERE line NOT IN (SELECT la FROM later)),
gone AS (
  SELECT l.doc_id, count(*) AS n_lines, list(l.line_no ORDER BY l.line_no) FILTER (kept.line_no IS NULL) AS removed
  FROM (SELECT DISTINCT doc_id, line_no FROM l) l LEFT JOIN kept ON kept.doc_id = l.doc_id AND kept.line_no = l.line_no GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(len(coalesce(removed, [])) AS INTEGER) AS n_removed,
       coalesce(removed, CAST([] AS INTEGER[])) AS removed
FROM documents d LEFT JOIN gone ON gone.doc_id = d.doc_id
"""

ORACLES = {"op4_line_dedup": OP4, "op10_decontamination": OP10}
