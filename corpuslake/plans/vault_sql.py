"""The queries over the vault as DuckDB SQL: links come from the rules that made them, not from the notes' text."""

from __future__ import annotations

VAULT = """n AS (SELECT count(*) AS n FROM documents),
  v AS (SELECT doc_id AS i, source AS s, doc_id // 20 % 5 AS g, doc_id % 21 = 3 AS readme, doc_id % 21 <> 3 AND doc_id % 23 = 4 AS old,
    CASE WHEN doc_id % 21 = 3 THEN source || '/g' || (doc_id // 20 % 5) || '/x' || doc_id || '/readme.md' WHEN doc_id % 23 = 4 THEN source || '/archive/d' || doc_id || '.md' ELSE source || '/g' || (doc_id // 20 % 5) || '/d' || doc_id || '.md' END AS path,
    CASE WHEN doc_id % 21 = 3 THEN 'readme' ELSE 'd' || doc_id END AS name FROM documents),
  top AS (SELECT min(path) AS path FROM v WHERE readme),
  of_s AS (SELECT s, min(path) AS path FROM v WHERE readme GROUP BY 1),
  of_g AS (SELECT s, g, min(path) AS path FROM v WHERE readme GROUP BY 1, 2),
  one AS (SELECT min(path) AS path FROM v WHERE readme HAVING count(*) = 1),
  links AS (
    SELECT v.*, 'wiki' AS syntax, '' AS display, 'd' || ((v.i * 7 + 3) % n.n) AS raw, t.path AS target, 1 AS pos FROM v CROSS JOIN n LEFT JOIN v t ON t.name = 'd' || ((v.i * 7 + 3) % n.n) WHERE v.i % 2 = 0
    UNION ALL SELECT v.*, 'wiki', '', 'readme', CASE WHEN v.readme THEN v.path WHEN v.old THEN coalesce(of_s.path, (SELECT path FROM top)) ELSE coalesce(of_g.path, of_s.path, (SELECT path FROM top)) END, 2
      FROM v LEFT JOIN of_s USING (s) LEFT JOIN of_g ON of_g.s = v.s AND of_g.g = v.g WHERE v.i % 3 = 0
    UNION ALL SELECT v.*, 'wiki', '', 'al' || ((v.i * 5 + 1) % n.n), t.path, 3 FROM v CROSS JOIN n LEFT JOIN v t ON t.i = (v.i * 5 + 1) % n.n AND t.i % 9 = 1 WHERE v.i % 4 = 1
    UNION ALL SELECT v.*, 'md', 'see (it)', '../g' || ((v.i + 20) // 20 % 5) || '/d' || ((v.i + 20) % n.n) || '.md#top', t.path, 4 FROM v CROSS JOIN n
      LEFT JOIN v t ON NOT t.readme AND t.path = v.s || CASE WHEN v.readme THEN '/g' || v.g ELSE '' END || '/g' || ((v.i + 20) // 20 % 5) || '/d' || ((v.i + 20) % n.n) || '.md' WHERE v.i % 5 = 2
    UNION ALL SELECT v.*, 'wiki', '', 'docs/guide' || (i % 4), CASE WHEN i % 4 < 3 THEN 'docs/guide' || (i % 4) || '.md' END, 5 FROM v WHERE i % 6 = 1
    UNION ALL SELECT v.*, 'wiki', '', 'pic' || (i % 6) || '.png', NULL, 6 FROM v WHERE i % 7 = 2
    UNION ALL SELECT v.*, 'md', 'gone', 'gone%20by/g' || i || '.md', NULL, 7 FROM v WHERE i % 8 = 3
    UNION ALL SELECT v.*, 'wiki', '', 'link', NULL, 8 FROM v WHERE i % 10 = 4
    UNION ALL SELECT v.*, 'md', 'x', '[y/z' || i || '.md', NULL, 9 FROM v WHERE i % 11 = 6),
  edges AS (SELECT path AS src, target AS dst, syntax AS link_syntax, count(*) AS count, arg_min(raw, pos) AS raw_target FROM links WHERE target <> path GROUP BY 1, 2, 3),
  broken AS (SELECT path AS source, syntax, raw, CASE WHEN raw = 'link' THEN 'CLIP-JUNK' WHEN raw LIKE 'docs/%' THEN 'META-DOC' WHEN old THEN 'ARCHIVED' WHEN raw IN ('pic0.png', 'pic2.png') THEN 'ATTACHMENT-EXISTS'
      WHEN raw LIKE '[%' THEN 'SYNTAX-NOISE' WHEN syntax = 'wiki' AND raw NOT LIKE '%.png' THEN 'CONCEPT-CANDIDATE' ELSE 'REAL-BROKEN' END AS category,
    CASE WHEN raw LIKE '%/%' THEN 'path not found: ' ELSE 'basename not found: ' END || CASE WHEN raw LIKE '%\\%20%' ESCAPE '\\' THEN replace(raw, '%20', ' ') ELSE split_part(raw, '#', 1) END AS reason FROM links WHERE target IS NULL)"""

SQL: dict[str, str] = {
    "vault_links": f"WITH {VAULT} SELECT path AS source, syntax, display, raw, target FROM links",
    "vault_ambiguous": f"WITH {VAULT} SELECT path AS source, target FROM links WHERE raw = 'readme'",
    "vault_edges": f"WITH {VAULT} SELECT * FROM edges",
    "vault_degrees": f"""WITH {VAULT}, i AS (SELECT dst AS path, count(*) AS n FROM edges GROUP BY 1), o AS (SELECT src AS path, count(*) AS n FROM edges GROUP BY 1)
      SELECT path, s AS category, old AS archived, coalesce(i.n, 0) AS in_degree_wiki, coalesce(o.n, 0) AS out_degree_wiki FROM v LEFT JOIN i USING (path) LEFT JOIN o USING (path)""",
    "vault_broken": f"WITH {VAULT} SELECT source, syntax, raw, category, CASE WHEN category = 'ATTACHMENT-EXISTS' THEN CASE raw WHEN 'pic0.png' THEN 'a/pic0.png' ELSE 'a/Pic2.PNG' END END AS attachment, reason FROM broken",
    "vault_broken_categories": f"WITH {VAULT} SELECT category, count(*) AS n FROM broken GROUP BY 1",
    "vault_orphans": f"""WITH {VAULT}, named AS (SELECT DISTINCT regexp_replace(regexp_replace(split_part(raw, '#', 1), '^.*/', ''), '(.)\\.[^.]*$', '\\1') AS name FROM links)
      SELECT 'stem' AS by, path FROM v WHERE name NOT IN (SELECT name FROM named) UNION ALL SELECT 'graph', path FROM v WHERE path NOT IN (SELECT dst FROM edges)""",
    "vault_backlinks": f"WITH {VAULT} SELECT DISTINCT path AS source, syntax AS link_type, raw FROM links WHERE target = (SELECT min(target) FROM links WHERE raw = 'readme')",
    "vault_path": f"""WITH RECURSIVE {VAULT}, und AS (SELECT src AS a, dst AS b, link_syntax AS t, src || '|' || dst || '|' || link_syntax AS o FROM edges UNION ALL SELECT dst, src, link_syntax, src || '|' || dst || '|' || link_syntax FROM edges),
      walk(node, hop) AS (SELECT path, 0 FROM v WHERE i = 1 UNION SELECT b, hop + 1 FROM walk JOIN und ON a = node WHERE hop < 12),
      dist AS (SELECT node, min(hop) AS d FROM walk GROUP BY 1),
      pred AS (SELECT x.b AS node, q.d, arg_min(x.a, x.o || chr(0) || x.a) AS prev, arg_min(x.t, x.o || chr(0) || x.a) AS t FROM und x JOIN dist p ON p.node = x.a JOIN dist q ON q.node = x.b WHERE q.d = p.d + 1 GROUP BY 1, 2),
      way(node, d, t, prev) AS (SELECT node, d, t, prev FROM pred WHERE node = (SELECT path FROM v WHERE i = 158) UNION ALL SELECT p.node, p.d, p.t, p.prev FROM way JOIN pred p ON p.node = way.prev)
      SELECT CAST(d AS INTEGER) AS step, node AS path, t AS edge_type FROM way UNION ALL SELECT 0, path, 'start' FROM v WHERE i = 1 AND (SELECT count(*) FROM way) > 0""",
}
