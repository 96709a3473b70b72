"""SQL for DuckDB of the corpus operators whose results don't depend on hashes, samples or training.

These compare all pairs or all strings, in memory: they are for the small tables at which results are compared.
"""

#: Groups of ``link(a, b)`` over ``node(id)``: the least id that links lead to.
GROUPS = """reach(id, other) AS (SELECT id, id FROM node UNION SELECT r.id, l.b FROM reach r JOIN (SELECT a, b FROM link UNION ALL SELECT b, a FROM link) l ON l.a = r.other),
grouped AS (SELECT id, min(other) AS least FROM reach GROUP BY id)"""

#: All pairs of vectors by cosine; numbers the vectors, so that ids may repeat.
EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS MATERIALIZED (SELECT id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x != 0)) > 0),
link AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM sound a JOIN sound b ON a.id < b.id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
node AS (SELECT id FROM v), {GROUPS},
links AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM link UNION ALL SELECT b FROM link) GROUP BY id)
SELECT v.vec_id, coalesce(n, 0) AS n_links, w.vec_id AS component_id, v.vec_id = w.vec_id AS kept
FROM v JOIN grouped USING (id) JOIN v w ON w.id = grouped.least LEFT JOIN links ON links.id = v.id"""

#: Exact Jaccard of sets of five-word shingles, through the shingles that two documents share.
MINHASH = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
same AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM same JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
node AS (SELECT id FROM d), {GROUPS}
SELECT d.doc_id, e.doc_id AS class_id, d.doc_id = e.doc_id AS kept FROM d JOIN grouped USING (id) JOIN d e ON e.id = grouped.least"""

#: All 200-byte strings by their places; a hexadecimal digit is half a byte, and pieces keep ``substr`` short. Runs that touch are one.
SUFFIXES = """WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
piece AS (SELECT id, 1000 * k AS o, substr(h, 2000 * k + 1, 2398) AS x FROM (SELECT id, h, unnest(range(0, len(h) // 2000 + 1)) AS k FROM d)),
place AS (SELECT id, o, x, unnest(range(0, len(x) // 2 - 199)) AS q FROM piece),
named AS MATERIALIZED (SELECT id, o + q AS p, md5(substr(x, 2 * q + 1, 400)) AS s FROM place),
twice AS (SELECT s FROM named GROUP BY s HAVING count(*) > 1),
found AS (SELECT id, p, CAST(p > 200 + lag(p, 1, -1000) OVER (PARTITION BY id ORDER BY p) AS INT) AS starts FROM named JOIN twice USING (s)),
run AS (SELECT id, p, sum(starts) OVER (PARTITION BY id ORDER BY p) AS k FROM found),
span AS (SELECT id, min(p) AS lo, max(p) + 200 AS hi FROM run GROUP BY id, k),
part AS (SELECT id, lag(hi, 1, 0) OVER (PARTITION BY id ORDER BY lo) AS a, lo AS b FROM span
  UNION ALL SELECT d.id, coalesce(max(hi), 0), any_value(len(h) // 2) FROM d LEFT JOIN span USING (id) GROUP BY d.id),
kept AS (SELECT id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS k FROM part JOIN d USING (id) GROUP BY id),
figures AS (SELECT id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM span GROUP BY id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (id) LEFT JOIN figures USING (id)"""

ORACLES = {"op2_embedding_dedup": EMBEDDINGS, "op8_suffix_dedup": SUFFIXES, "op9_minhash": MINHASH}
