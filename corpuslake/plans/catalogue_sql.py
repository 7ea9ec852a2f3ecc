"""The catalogue as DuckDB SQL over the same tables."""

from __future__ import annotations

from corpuslake.functions.links import LINK_SUFFIXES
from corpuslake.operators.lint import CONTENT_PATTERNS, ENDS
from corpuslake.plans.catalogue import QUERIES, QUERY, TERMS

DOCS = "docs AS (SELECT doc_id, 'd' || doc_id AS path, coalesce(text, '') AS content FROM documents)"
NOTES = """notes AS (SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN 'memory/' WHEN doc_id % 10 = 0 THEN source || '/archive/' ELSE source || '/' END || 'd' || doc_id || '.md' AS path,
  'd' || doc_id AS basename, coalesce(text, '') AS content, (doc_id * 37) % 1100 AS age_days FROM documents)"""
FEATURES = """features AS (SELECT *, split_part(path, '/', 1) AS category, path LIKE '%/archive/%' AS archived FROM notes)"""
CAT = f"{NOTES}, {FEATURES}"
LINKS = NOTES + """, linked AS (SELECT doc_id, path, basename, content || chr(10) || '[[d' || ((doc_id * 7 + 3) % (SELECT count(*) FROM documents)) || ']] [[d' || ((doc_id * doc_id + 1) % (SELECT count(*) FROM documents)) || '|x]]'
    || CASE WHEN doc_id % 13 = 0 THEN ' [[missing' || doc_id || ']]' ELSE '' END AS content FROM notes),
  raws AS (SELECT path AS source, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM (SELECT path, regexp_extract_all(content, '\\[\\[([^\\[\\]|#\\n]+?)(?:#[^\\]|\\n]*)?(?:\\|[^\\]\\n]*)?\\]\\]', 1) AS l FROM linked)),
  resolved AS (SELECT r.source, r.raw, r.pos, n.path AS target FROM raws r LEFT JOIN notes n ON n.basename = r.raw),
  edges AS (SELECT source AS src, target AS dst, count(*) AS count, arg_min(raw, pos) AS raw_target FROM resolved WHERE target IS NOT NULL AND target <> source GROUP BY 1, 2)"""
DEGREES = LINKS + f""", {FEATURES},
  din AS (SELECT dst AS path, count(*) AS n FROM edges GROUP BY 1), dout AS (SELECT src AS path, count(*) AS n FROM edges GROUP BY 1),
  nodes AS (SELECT f.path, f.category, f.archived, coalesce(din.n, 0) AS in_degree_wiki, coalesce(dout.n, 0) AS out_degree_wiki FROM features f LEFT JOIN din USING (path) LEFT JOIN dout USING (path))"""


def chunks(source: str) -> str:
    return f"""chunks AS (SELECT path, CAST(i AS INTEGER) AS chunk_index, substr(content, CAST(i * 2700 + 1 AS BIGINT), 3000) AS chunk_text FROM
  (SELECT path, content, unnest(range(CASE WHEN length(content) <= 3000 THEN 1 ELSE 1 + CAST(ceil((length(content) - 3000) / 2700.0) AS BIGINT) END)) AS i FROM {source})),
  toks AS (SELECT path, chunk_index, regexp_extract_all(lower(chunk_text), '[a-z0-9]+') AS tokens FROM chunks),
  stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM toks),
  postings AS (SELECT path, chunk_index, dl, term, count(*) AS tf FROM (SELECT path, chunk_index, len(tokens) AS dl, unnest(tokens) AS term FROM toks) GROUP BY ALL),
  terms AS (SELECT term, count(*) AS df, greatest(0.0, ((SELECT n FROM stats) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings GROUP BY 1)"""


def _gain(words: str, keys: str = "path, chunk_index") -> str:
    return f"""SELECT {keys}, sum(t.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / (SELECT avgdl FROM stats)))) AS score
  FROM postings p JOIN terms t USING (term) JOIN ({words}) w USING (term) GROUP BY {keys} HAVING score > 0"""


def _words(text: str) -> str:
    return f"SELECT DISTINCT unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS term"


BM25 = f"{DOCS}, {chunks('docs')}"
QVEC = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), vecs AS (SELECT vec_id, 'v' || vec_id AS path, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
COS = "list_inner_product(q, v) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(v, v)) + 1e-10)"
SIM = """vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
  allpairs AS (SELECT a.vec_id AS a, b.vec_id AS b, round(CASE WHEN a.n * b.n = 0 THEN 0 ELSE list_inner_product(a.v, b.v) / (a.n * b.n) END, 6) AS similarity FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id),
  sim AS (SELECT a, b, similarity FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS r FROM allpairs) WHERE r <= 8 AND similarity >= 0.30),
  sedges AS (SELECT CAST(a AS VARCHAR) AS src, CAST(b AS VARCHAR) AS dst, similarity AS weight, CASE WHEN similarity >= 0.35 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence FROM sim WHERE similarity > 0.30),
  sin AS (SELECT dst AS path, count(*) AS n FROM sedges GROUP BY 1), sout AS (SELECT src AS path, count(*) AS n FROM sedges GROUP BY 1),
  snodes AS (SELECT CAST(vec_id AS VARCHAR) AS path, vec_id, label, 'c' || label AS category, coalesce(sin.n, 0) AS in_sem, coalesce(sout.n, 0) AS out_sem FROM embeddings LEFT JOIN sin ON sin.path = CAST(vec_id AS VARCHAR) LEFT JOIN sout ON sout.path = CAST(vec_id AS VARCHAR))"""
COMMUNITIES = SIM + """, m AS (SELECT path, label AS community_id, 'k' || (vec_id % 3) AS category, in_sem AS total_in FROM snodes),
  sizes AS (SELECT community_id, count(*) AS size FROM m GROUP BY 1),
  inn AS (SELECT DISTINCT a.community_id, least(src, dst) AS lo, greatest(src, dst) AS hi FROM sedges JOIN m a ON a.path = src JOIN m b ON b.path = dst WHERE a.community_id = b.community_id),
  lk AS (SELECT community_id, count(*) AS n FROM inn GROUP BY 1),
  cats AS (SELECT community_id, list(struct_pack(category := category, n := n) ORDER BY n DESC, category) AS c FROM (SELECT community_id, category, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1),
  hubs AS (SELECT community_id, list(path ORDER BY r) AS h FROM (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY total_in DESC, path) AS r FROM m) WHERE r <= 5 GROUP BY 1),
  cstats AS (SELECT community_id, size, CASE WHEN size > 1 THEN round_even(coalesce(lk.n, 0) / (size * (size - 1) / 2.0), 2) ELSE 0.0 END AS cohesion, c, h
    FROM sizes LEFT JOIN lk USING (community_id) JOIN cats USING (community_id) JOIN hubs USING (community_id) ORDER BY size DESC, community_id LIMIT 15)"""
DUP_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id = 0"
POLICY = "policy AS (SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 9 = 1 THEN 'allow' WHEN doc_id % 9 = 2 THEN 'llm_skip' ELSE 'skip' END AS action FROM documents WHERE doc_id % 3 <> 0)"
GATE = "CASE WHEN size_bytes <= 3000 OR p.action = 'allow' THEN 'pass' ELSE coalesce(p.action, 'pending') END"
HASH = "substr(sha256(coalesce(text, '')), 1, 16)"


def _best(words: str, k: int) -> str:
    return f"(SELECT path, max(score) AS score FROM ({_gain(words)}) GROUP BY 1 ORDER BY round(max(score), 6) DESC, path LIMIT {k})"


_TARGET = "trim(regexp_extract(url_decode(trim(target)), '^([^#?]*)', 1))"

_ENDS = f"[^{ENDS}]"
CONTEXTS = f"""{DOCS}, words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{8,}}')) AS term FROM benchmark),
  hits AS (SELECT term, path, content, instr(lower(content), term) - 1 AS pos, length(term) AS n FROM words JOIN docs ON contains(lower(content), term)),
  parts AS (SELECT term, path, regexp_extract(substr(content, 1, greatest(pos - 80, 0)), '(?s)((?:[{ENDS}])?{_ENDS}*)$', 1) || substr(content, greatest(pos - 80, 0) + 1, least(pos, 80) + n + 80) || regexp_extract(substr(content, pos + n + 81), '^({_ENDS}*)', 1) AS x FROM hits),
  shown AS (SELECT term, path, trim(replace(x, chr(10), ' '), ' ') AS x FROM parts)"""

SQL: dict[str, str] = {
    "rename_changed": f"""WITH d AS (SELECT doc_id, 'd' || doc_id AS path, coalesce(text, '') AS content FROM documents),
      o AS (SELECT 'old/' || path AS path, content, sha256(content) AS h FROM d WHERE doc_id % 3 <> 0),
      n AS (SELECT path, content, sha256(content) AS h FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN 'new/' ELSE 'old/' END || path AS path, CASE WHEN doc_id % 8 = 0 THEN content || chr(10) || 'added to d' || doc_id || ' in a later year' ELSE content END AS content FROM d WHERE doc_id % 2 = 0)),
      missing AS (SELECT * FROM o WHERE path NOT IN (SELECT path FROM n)), added AS (SELECT * FROM n WHERE path NOT IN (SELECT path FROM o)),
      exact AS (SELECT a.p AS old_path, b.p AS new_path FROM (SELECT h, min(path) AS p FROM missing GROUP BY 1 HAVING count(*) = 1) a JOIN (SELECT h, min(path) AS p FROM added GROUP BY 1 HAVING count(*) = 1) b USING (h)),
      side AS (SELECT 0 AS side, path, content FROM missing WHERE path NOT IN (SELECT old_path FROM exact) UNION ALL SELECT 1, path, content FROM added WHERE path NOT IN (SELECT new_path FROM exact)),
      words AS (SELECT side, path, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM (SELECT side, path, list_filter(regexp_split_to_array(content, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM side)),
      shingles AS (SELECT side, path, i, greatest(n - 4, 1) AS m, substr(md5(string_agg(word, ' ') OVER (PARTITION BY side, path ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)), 1, 16) AS h FROM words),
      sig AS (SELECT DISTINCT side, path, h FROM (SELECT side, path, i, m, min(h) OVER (PARTITION BY side, path ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS h FROM shingles WHERE i <= m) WHERE i <= greatest(m - 3, 1)),
      whole AS (SELECT side, path, count(*) AS n, string_agg(h, '' ORDER BY h) AS x FROM sig GROUP BY 1, 2),
      alone AS (SELECT side, path, n FROM whole QUALIFY count(*) OVER (PARTITION BY side, x) = 1),
      scored AS (SELECT a.path AS old_path, b.path AS new_path, count(*) / greatest(min(a.n), min(b.n)) AS s FROM alone a JOIN sig p ON p.side = 0 AND p.path = a.path JOIN sig q ON q.side = 1 AND q.h = p.h JOIN alone b ON b.side = 1 AND b.path = q.path WHERE a.side = 0 GROUP BY 1, 2 HAVING s >= 0.8),
      alike AS (SELECT old_path, new_path FROM scored QUALIFY row_number() OVER (PARTITION BY old_path ORDER BY s DESC, new_path) = 1 AND row_number() OVER (PARTITION BY new_path ORDER BY s DESC, old_path) = 1),
      found AS (SELECT * FROM exact UNION ALL SELECT * FROM alike)
      SELECT 'rename' AS action, old_path, new_path FROM found UNION ALL SELECT 'archive', path, NULL FROM missing WHERE path NOT IN (SELECT old_path FROM found)""",
    "rename_history": "SELECT 'd' || doc_id || '_0' AS old, 'd' || doc_id || '_' || (doc_id % 5 + 1) AS new FROM documents WHERE doc_id % 7 <> 0",
    "planted_secrets": "WITH f AS (SELECT 'd' || doc_id AS path, coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN ' sk-' || md5(doc_id::VARCHAR) ELSE '' END || CASE WHEN doc_id % 8 = 1 THEN ' AKIA' || upper(substr(md5(doc_id::VARCHAR), 1, 16)) ELSE '' END || CASE WHEN doc_id % 9 = 2 THEN ' ghp_' || md5(doc_id::VARCHAR) || 'abcd' ELSE '' END || CASE WHEN doc_id % 10 = 3 THEN ' xoxb-' || md5(doc_id::VARCHAR) ELSE '' END || CASE WHEN doc_id % 11 = 4 THEN ' AIza' || md5(doc_id::VARCHAR) || 'abc' ELSE '' END || CASE WHEN doc_id % 12 = 5 THEN chr(10) || '-----BEGIN RSA PRIVATE KEY-----' || chr(10) ELSE '' END || CASE WHEN doc_id % 13 = 6 THEN ' sk-' || substr(md5(doc_id::VARCHAR), 1, 19) ELSE '' END AS c FROM documents) " + " UNION ALL ".join(f"SELECT path, '{k}' AS kind FROM f WHERE regexp_matches(c, '{p}')" for k, p in CONTENT_PATTERNS.items()),
    "term_contexts": f"WITH {CONTEXTS} SELECT term, count(*) OVER (PARTITION BY term) AS notes, path, CASE WHEN length(x) > 200 THEN substr(x, 1, 200) || '...' ELSE x END AS context FROM shown QUALIFY row_number() OVER (PARTITION BY term ORDER BY path) <= 4",
    "contradiction_candidates": f"WITH {CONTEXTS} SELECT term, count(DISTINCT path) AS n FROM hits GROUP BY 1 HAVING n >= 2 ORDER BY n DESC, term LIMIT 8",
    "private_paths": """WITH p AS (SELECT doc_id, source || '/' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'd' || doc_id || '/' END || ['.aws/credentials', 'x.aws/config', 'a.gnupg/k.txt', '.SSH/known', 'my Password.md', 'plain.md', 'id_rsa', 'token/plain.md'][doc_id % 8 + 1] AS path FROM documents) SELECT path FROM p WHERE doc_id % 8 IN (0, 3, 4, 6)""",
    "chunk_windows": f"WITH {DOCS}, c AS (SELECT doc_id, length(content) AS n, CASE WHEN length(content) <= 3000 THEN 1 ELSE 1 + CAST(ceil((length(content) - 3000) / 2700.0) AS INTEGER) END AS k FROM docs) SELECT doc_id, CAST(k AS INTEGER) AS n_chunks, CAST(least(n, 3000) AS INTEGER) AS first_len, CAST(n - (k - 1) * 2700 AS INTEGER) AS last_len FROM c",
    "token_stats": f"WITH {DOCS}, t AS (SELECT doc_id, regexp_extract_all(lower(content), '[a-z0-9]+') AS x FROM docs) SELECT doc_id, CAST(len(x) AS INTEGER) AS n_tokens, CAST(len(list_distinct(x)) AS INTEGER) AS n_distinct FROM t",
    "bm25_corpus_stats": f"WITH {BM25} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "bm25_term_stats": f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM terms WHERE term IN {TERMS!r}",
    "bm25_vocabulary": f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "bm25_search": f"WITH {BM25} SELECT path, chunk_index, round(score, 6) AS score FROM ({_gain(_words(repr(QUERY)))}) ORDER BY 3 DESC, 1, 2 LIMIT 10",
    "bm25_search_scoped": f"WITH {NOTES}, {chunks('notes')} SELECT path, round(max(score), 6) AS score FROM ({_gain(_words(repr(QUERY)))}) WHERE path NOT LIKE 'memory/%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "bm25_search_many": f"WITH {BM25}, words AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark), s AS ({_gain('SELECT * FROM words', 'query_id, path, chunk_index')}) SELECT query_id, CAST(r AS INTEGER) AS rank, path, chunk_index, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, path, chunk_index) AS r FROM s) WHERE r <= 3",
    "dense_topk": f"WITH {QVEC} SELECT 'label' || label AS path, round(max({COS}), 6) AS score FROM vecs, q GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "dense_decay": f"WITH {QVEC} SELECT path, round({COS} * CASE WHEN (vec_id * 37) % 1100 / 365.25 < 1 THEN 1.0 WHEN (vec_id * 37) % 1100 / 365.25 < 2 THEN 0.8 ELSE 0.5 END, 6) AS score FROM vecs, q ORDER BY 2 DESC, 1 LIMIT 10",
    "mean_vectors": "WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) SELECT label, CAST(p - 1 AS INTEGER) AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM e GROUP BY 1, 2",
    "related_notes": f"WITH {SIM} SELECT a, b, similarity FROM sim",
    "hybrid_fusion": f"""WITH {BM25}, {QVEC}, d AS (SELECT 'd' || vec_id AS path, {COS} AS d FROM vecs, q ORDER BY round({COS}, 6) DESC, 1 LIMIT 20),
      s AS (SELECT path, max(score) AS s FROM (SELECT * FROM ({_gain(_words(repr(QUERY)))}) ORDER BY round(score, 6) DESC, path, chunk_index LIMIT 20) GROUP BY 1),
      b AS (SELECT path, coalesce(d, 0) AS d, coalesce(s, 0) AS s FROM d FULL OUTER JOIN s USING (path)),
      r AS (SELECT min(d) AS dl, CASE WHEN max(d) > min(d) THEN max(d) - min(d) ELSE 1 END AS dr, min(s) AS sl, CASE WHEN max(s) > min(s) THEN max(s) - min(s) ELSE 1 END AS sr FROM b)
      SELECT path, round(0.6 * (d - dl) / dr + 0.4 * (s - sl) / sr, 6) AS score FROM b, r ORDER BY 2 DESC, 1 LIMIT 10""",
    "escalation_decision": f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
      qs AS (SELECT a.vec_id AS query_id, list_transform(list_zip(a.v, b.v), lambda z: z[1] + z[2]) AS q FROM v a JOIN v b ON b.vec_id = a.vec_id + 100 WHERE a.vec_id < 5),
      s AS (SELECT query_id, vec_id, 'v' || vec_id AS path, round({COS}, 6) AS score FROM qs, v),
      b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) = 1)
      SELECT query_id, path, score, score < 0.6 AS low_confidence, score BETWEEN 0.5 AND 0.7 AND (vec_id * 37) % 1100 / 365.25 > 1.0 AS gray_zone FROM b""",
    "duplicate_check": f"WITH {BM25} SELECT path, round(score, 6) AS score FROM {_best(DUP_WORDS, 10)}",
    "iterative_merge": f"""WITH {BM25}, r1 AS (SELECT * FROM {_best(_words(repr(QUERIES[0])), 5)}),
      u AS (SELECT path, max(score) AS score FROM (SELECT * FROM {_best(_words(repr(QUERIES[1])), 5)} UNION ALL SELECT * FROM {_best(_words(repr(QUERIES[2])), 5)}) GROUP BY 1),
      r2 AS (SELECT * FROM u WHERE path NOT IN (SELECT path FROM r1) ORDER BY round(score, 6) DESC, path LIMIT 5)
      SELECT 1 AS round, path, round(score, 6) AS score FROM r1 UNION ALL SELECT 2, path, round(score, 6) FROM r2""",
    "path_features": f"WITH {CAT} SELECT path, category, archived, basename AS stem, '-' AS date, path LIKE 'memory/%' AS in_memory FROM features",
    "content_hashes": f"SELECT {HASH} AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "rename_diff": f"""WITH d AS (SELECT doc_id, 'd' || doc_id AS path, {HASH} AS h FROM documents),
      o AS (SELECT 'old/' || path AS path, h FROM d WHERE doc_id % 3 <> 0), n AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'new/' ELSE 'old/' END || path AS path, h FROM d WHERE doc_id % 2 = 0),
      missing AS (SELECT * FROM o WHERE path NOT IN (SELECT path FROM n)), added AS (SELECT * FROM n WHERE path NOT IN (SELECT path FROM o)),
      pairs AS (SELECT a.p AS old_path, b.p AS new_path FROM (SELECT h, min(path) AS p FROM missing GROUP BY 1 HAVING count(*) = 1) a JOIN (SELECT h, min(path) AS p FROM added GROUP BY 1 HAVING count(*) = 1) b USING (h))
      SELECT 'rename' AS action, old_path, new_path FROM pairs UNION ALL SELECT 'archive', path, NULL FROM missing WHERE path NOT IN (SELECT old_path FROM pairs)""",
    "incremental_plan": f"""WITH d AS (SELECT doc_id, 'd' || doc_id AS path, length(coalesce(text, '')) AS size_bytes, {HASH} AS h FROM documents), {POLICY},
      k AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE h END AS kh FROM d WHERE doc_id % 7 <> 0), c AS (SELECT * FROM d WHERE doc_id % 11 <> 0),
      g AS (SELECT c.path, {GATE} AS gate FROM c LEFT JOIN policy p USING (path)), j AS (SELECT path, h, kh, gate FROM c FULL OUTER JOIN k USING (path) LEFT JOIN g USING (path))
      SELECT path, CASE WHEN h IS NULL THEN 'delete' WHEN gate = 'llm_skip' THEN CASE WHEN kh IS NOT NULL THEN 'delete' ELSE 'skip' END WHEN gate IN ('pending', 'skip') THEN 'wait' WHEN kh IS NULL THEN 'add' WHEN kh = h THEN 'skip' ELSE 'change' END AS action FROM j""",
    "oversize_gate": f"WITH d AS (SELECT 'd' || doc_id AS path, CAST(length(coalesce(text, '')) AS BIGINT) AS size_bytes FROM documents), {POLICY} SELECT path, size_bytes, {GATE} AS gate FROM d LEFT JOIN policy p USING (path)",
    "wikilink_edges": f"WITH {LINKS} SELECT src, dst, count, raw_target FROM edges",
    "broken_links": f"WITH {LINKS} SELECT DISTINCT source, raw, 'wiki' AS syntax, 'basename not found: ' || raw AS reason FROM resolved WHERE target IS NULL",
    "broken_categories": f"WITH {LINKS} SELECT CASE WHEN source LIKE '%/archive/%' THEN 'ARCHIVED' ELSE 'CONCEPT-CANDIDATE' END AS category, count(*) AS n FROM resolved WHERE target IS NULL GROUP BY 1",
    "backlinks": f"WITH {LINKS} SELECT DISTINCT src AS source, 'user-wikilink' AS type FROM edges WHERE dst = (SELECT path FROM notes WHERE doc_id = 5)",
    "orphans_stem": f"WITH {LINKS} SELECT path FROM notes WHERE basename NOT IN (SELECT raw FROM raws)",
    "orphans_graph": f"WITH {DEGREES} SELECT path FROM nodes WHERE in_degree_wiki = 0",
    "node_degrees": f"WITH {DEGREES}, {SIM} SELECT path, category, archived, in_degree_wiki, out_degree_wiki, 0 AS in_degree_semantic, 0 AS out_degree_semantic FROM nodes UNION ALL SELECT path, category, false, 0, 0, in_sem, out_sem FROM snodes",
    "god_nodes": f"WITH {DEGREES} SELECT path, in_degree_wiki AS total_in FROM nodes WHERE NOT archived AND in_degree_wiki > 0 ORDER BY 2 DESC, 1 LIMIT 15",
    "cross_category": f"""WITH {SIM}, x AS (SELECT src, dst, a.category AS src_cat, b.category AS dst_cat, weight FROM sedges JOIN snodes a ON a.path = src JOIN snodes b ON b.path = dst WHERE confidence = 'INFERRED' AND a.category <> b.category),
      one AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY src, dst) = 1) SELECT src, dst, src_cat, dst_cat, weight FROM one ORDER BY weight DESC, src, dst LIMIT 10""",
    "community_stats": f"WITH {COMMUNITIES} SELECT community_id, size, cohesion, array_to_string(list_transform(c, lambda x: x.category || '=' || x.n), ',') AS categories, array_to_string(h, ',') AS hubs FROM cstats",
    "deviation_signals": f"WITH {COMMUNITIES}, p AS (SELECT community_id, size, cohesion, c[1].category AS top_cat, CAST(round_even(c[1].n / size * 100, 0) AS INTEGER) AS top_pct, c[2].category AS second_cat, CAST(round_even(c[2].n / size * 100, 0) AS INTEGER) AS second_pct FROM cstats WHERE len(c) >= 2) SELECT *, 'cross-category' AS type FROM p WHERE second_pct >= 30",
    "neighbors_2hop": f"""WITH {LINKS}, s AS (SELECT path FROM notes WHERE doc_id = 1), h1 AS (SELECT DISTINCT dst FROM edges WHERE src = (SELECT path FROM s) AND dst <> (SELECT path FROM s)),
      syn AS (SELECT src, dst, 'user-wikilink' AS edge_type, 1.0 AS weight FROM edges) SELECT dst AS path, edge_type, CAST(weight AS DOUBLE) AS weight, 1 AS hop FROM syn WHERE src = (SELECT path FROM s) UNION ALL SELECT dst, edge_type, CAST(weight AS DOUBLE), 2 FROM syn WHERE src IN (SELECT dst FROM h1)""",
    "shortest_path_len": f"""WITH RECURSIVE {LINKS}, und AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
      walk(node, hop) AS (SELECT path, 0 FROM notes WHERE doc_id = 1 UNION SELECT b, hop + 1 FROM walk JOIN und ON a = node WHERE hop < 12)
      SELECT (SELECT path FROM notes WHERE doc_id = 1) AS src, path AS dst, CAST(min(hop) AS INTEGER) AS hops FROM walk JOIN notes ON path = node WHERE doc_id = 42 GROUP BY 2""",
    "tags_topics": "SELECT role AS tag, count(*) AS n, min('t' || conv_id || '_' || turn) AS first_path FROM conversations GROUP BY 1",
    "manifest_counts": f"WITH {CAT} SELECT category, count(*) AS n, count(*) < 40 AS sparse FROM features GROUP BY 1",
    "health_summary": f"WITH {DEGREES} SELECT count(*) AS total, count(*) FILTER (category = '(inbox)') AS inbox, count(DISTINCT category) AS categories, count(*) FILTER (in_degree_wiki = 0) AS orphans, count(*) FILTER (in_degree_wiki = 0 AND NOT archived) AS active_orphans, count(*) FILTER (in_degree_wiki = 0 AND archived) AS archived_orphans, count(*) FILTER (category = '(inbox)') > 5 AS inbox_alert, count(*) FILTER (in_degree_wiki = 0 AND NOT archived) > 20 AS orphan_alert FROM nodes",
    "orphan_report": f"WITH {DEGREES} SELECT archived, category, count(*) AS n FROM nodes WHERE in_degree_wiki = 0 GROUP BY 1, 2",
    "confidence_mix": f"WITH {SIM} SELECT confidence, count(*) AS n, round_even(100 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM sedges GROUP BY 1",
    "trend_append": "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS total, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1",
    "workflow_frequency": "SELECT 'u' || user_id AS path, round_even(least(count(*) FILTER (ts > TIMESTAMP '2024-01-25 12:00:00' - INTERVAL 30 DAY) / 30.0, 1.0), 3) AS frequency, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events WHERE ts <= TIMESTAMP '2024-01-25 12:00:00' GROUP BY 1",
    "note_states": """WITH e AS (SELECT 'u' || user_id AS path, ts, event_type AS h FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
      l AS (SELECT path, max(ts) AS ts FROM e GROUP BY 1), b AS (SELECT e.path, max(e.ts) AS ts FROM e JOIN l USING (path) WHERE e.ts < l.ts GROUP BY 1)
      SELECT path, strftime(l.ts, '%Y-%m-%d %H:%M:%S') AS ts, (SELECT max(h) FROM e WHERE e.path = l.path AND e.ts = l.ts) AS content_hash,
        CASE WHEN l.ts + INTERVAL 7 DAY < (SELECT max(ts) FROM e) - INTERVAL 1 HOUR THEN 'dormant' ELSE 'active' END AS status, coalesce(l.ts > b.ts + INTERVAL 7 DAY, false) AS woken FROM l LEFT JOIN b USING (path)""",
    "lifecycle_channels": """WITH m AS (SELECT doc_id AS i, 'm' || doc_id AS path, CASE doc_id % 4 WHEN 0 THEN 'workflow' WHEN 1 THEN 'feedback' WHEN 2 THEN 'project' ELSE 'reference' END AS type,
      CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 10) / 100 END AS f, (doc_id * 37) % 500 AS used, CASE WHEN doc_id % 3 = 0 THEN 'dormant' ELSE 'active' END AS live, CASE WHEN doc_id % 7 <> 0 THEN (doc_id * 53) % 500 END AS conf, doc_id % 6 AS cc,
      CASE WHEN doc_id % 2 = 0 AND doc_id % 8 = 2 THEN 'complete' ELSE 'active' END AS status, (doc_id * 11) % 200 AS comp FROM documents)
      SELECT path, type, CASE type WHEN 'workflow' THEN CASE WHEN f IS NULL THEN 'UNKNOWN' WHEN f < 0.05 AND used > 180 THEN 'DECAY' WHEN f >= 0.03 AND f < 0.05 THEN 'BORDERLINE' ELSE 'ACTIVE' END
        WHEN 'feedback' THEN CASE WHEN conf IS NULL THEN 'UNKNOWN' WHEN live = 'active' AND conf > 180 THEN 'DORMANT' WHEN live = 'dormant' AND conf > 365 THEN 'ARCHIVE' WHEN live = 'active' AND cc >= 3 THEN 'STABLE' WHEN live = 'dormant' THEN 'DORMANT' ELSE 'ACTIVE' END
        WHEN 'project' THEN CASE WHEN status = 'complete' AND comp > 90 THEN 'STALE' WHEN status = 'complete' THEN 'FRESH' ELSE 'ACTIVE' END ELSE 'INACTIVE' END AS signal FROM m""",
    "active_session": "WITH e AS (SELECT * FROM events WHERE user_id = 8), n AS (SELECT count(*) AS a FROM e WHERE abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-20')) <= 86400000000) SELECT arg_max(event_type, ts) AS model, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts, (SELECT a FROM n) AS active, (SELECT a FROM n) <> 1 AS degraded FROM e",
    "orphan_concepts": r"""WITH t AS (SELECT trim(unnest(regexp_extract_all(coalesce(html, ''), '<a href="[^"]*">([^<]{2,30})</a>', 1))) AS term FROM pages),
      f AS (SELECT term, count(*) AS count FROM t WHERE length(term) BETWEEN 3 AND 25 AND regexp_matches(term, '[A-Za-z]') AND regexp_matches(term, '^[A-Z][a-zA-Z0-9_\-/]+$') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60), q AS (SELECT * FROM f WHERE count >= 3),
      taken AS (SELECT DISTINCT term FROM q, nation WHERE lower(n_name) = lower(term) OR (length(n_name) > 2 AND length(term) > 2 AND (contains(lower(n_name), lower(term)) OR contains(lower(term), lower(n_name))) AND greatest(length(n_name), length(term)) / least(length(n_name), length(term)) <= 2))
      SELECT term, count FROM q WHERE term NOT IN (SELECT term FROM taken) ORDER BY 2 DESC, 1 LIMIT 20""",
    "stale_years": "SELECT 'o' || o_orderkey AS path, CAST(year(o_orderdate) AS INTEGER) AS year, 'Order of ' || strftime(o_orderdate, '%Y-%m-%d') || ' is open.' AS context FROM orders WHERE year(o_orderdate) BETWEEN 2000 AND 2024",
    "secret_scan": "WITH f AS (SELECT 'd' || doc_id AS path, coalesce(text, '') AS c FROM documents UNION ALL SELECT 'p' || page_id, coalesce(html, '') FROM pages) " + " UNION ALL ".join(f"SELECT path, '{k}' AS kind FROM f WHERE regexp_matches(c, '{p}')" for k, p in CONTENT_PATTERNS.items()),
    "page_links": rf"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1)) AS target FROM pages), t AS (SELECT page_id, target, {_TARGET} AS t FROM h),
      x AS (SELECT *, lower(regexp_extract(regexp_replace(t, '/+$', ''), '[^/](\.[^./]+)$', 1)) AS ext FROM t)
      SELECT page_id, count(*) AS n, min(target) AS first_target FROM x WHERE t <> '' AND NOT contains(t, '@') AND NOT starts_with(lower(t), 'www.') AND NOT regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9+.-]*:')
      AND CASE WHEN ext <> '' THEN ext IN ({', '.join(map(repr, LINK_SUFFIXES))}) WHEN regexp_matches(t, '^[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}(/.*)?$') THEN false ELSE contains(t, '/') END GROUP BY 1""",
    "repo_profile": """WITH f AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'office' WHEN doc_id % 50 = 1 THEN 'legacy' ELSE 'md' END AS k FROM documents), c AS (SELECT count(*) FILTER (k = 'md') AS notes, count(*) FILTER (k = 'office') AS office, count(*) FILTER (k = 'legacy') AS legacy FROM f)
      SELECT notes, office, legacy, CAST(0 AS BIGINT) AS hosts, round(10 / notes, 6) AS orphan_ratio, CAST(CASE WHEN notes <= 500 THEN 5 ELSE 10 END AS INTEGER) AS inbox_threshold, CAST(CASE WHEN notes < 100 THEN 10 WHEN notes <= 500 THEN 20 ELSE 40 END AS INTEGER) AS orphan_threshold, CAST(CASE WHEN notes < 100 THEN 2 ELSE 3 END AS INTEGER) AS sparse_threshold,
      array_to_string(list_filter([CASE WHEN notes + office < 10 THEN 'tiny' END, CASE WHEN office > notes THEN 'office-heavy' END, CASE WHEN legacy > 0 THEN 'legacy-office' END, CASE WHEN 10 / notes > 0.3 THEN 'many-orphans' END], lambda x: x IS NOT NULL), ',') AS hints FROM c""",
    "token_coverage": f"WITH {NOTES} SELECT t AS token FROM (SELECT DISTINCT source || '/' AS t FROM documents UNION ALL SELECT 'absent/') WHERE NOT EXISTS (SELECT 1 FROM notes WHERE starts_with(path, t))",
    "category_top_notes": f"WITH {CAT} SELECT path, category, CAST(n AS INTEGER) AS n_chars, CAST(r AS INTEGER) AS rank FROM (SELECT path, category, length(content) AS n, row_number() OVER (PARTITION BY category ORDER BY length(content) DESC, path) AS r FROM features) WHERE r <= 3",
}
