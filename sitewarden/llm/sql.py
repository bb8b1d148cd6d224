"""DuckDB SQL for the queries that SQL can express, over whole tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5(coalesce(text, '')) AS tie FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs,
         [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INT) + 1]::DOUBLE AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s
), l AS (
  SELECT *,
    (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f
), t AS (
  SELECT source, source_size, n_docs, round(least(cap, coalesce(lv * weight, cap)), 6) AS target
  FROM (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS lv FROM l)
), k AS (
  SELECT d.*, t.source_size, t.target,
    CAST(floor(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), tie)), 1, 8))::BIGINT / 4294967296.0::DOUBLE
      * ceil(n_docs / 2048.0)) AS BIGINT) AS chunk
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY chunk, CASE WHEN chunk % 2 = 0 THEN size ELSE -size END,
    doc_id ASC NULLS FIRST, tie) AS k,
    ('0x' || substr(md5('mix-1:' || coalesce('s' || source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
  FROM k
)
SELECT doc_id, size, source_size, target,
  CAST(floor(u + rate * k) - floor(u + rate * (k - 1)) AS BIGINT) * size AS taken
FROM r
"""

OP5 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents
), g AS (
  SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3
), c AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM g
), p AS (
  SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM c, (SELECT unnest([0, 1, 2]) AS o) WHERE n >= 2 GROUP BY rid
), l AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(array_to_string(regexp_extract_all(text, '[#*$%&|<>]'), '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN l USING (rid) LEFT JOIN p USING (rid)
), b AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (word_chars < 2 * n_words)::INT
    + 8 * (word_chars > 14 * n_words)::INT + 16 * (10 * n_symbols > n_words)::INT + 32 * (n_dup_lines >= 2 AND 10 * n_dup_lines > 3 * n_lines)::INT AS BIGINT) AS fail_bits
  FROM m
)
SELECT *, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""

OP2 = r"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS line
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
), s AS (
  SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), w AS (
  SELECT doc_id, i AS i0, lead(i, 1) OVER o AS i1, lead(i, 2) OVER o AS i2,
    line AS a, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c
  FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i0) AS k FROM w WHERE i2 IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, unnest([i0, i1, i2]) AS i FROM r WHERE k > 1
), x AS (
  SELECT l.doc_id, string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i) AS t,
    count(*) FILTER (WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) AS n_lines, count(g.i) AS n_removed_lines
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines,
  sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN x ON d.doc_id = x.doc_id
"""

OP8 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM d)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM d
  UNION
  SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id
"""

OP10 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), g AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r AS (
  SELECT vec_id AS x, vec_id AS y FROM v
  UNION
  SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) k ON k.x = v.vec_id
JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = v.vec_id
"""



def _op12(k: int = 40, dims: int = 64, rounds: int = 5) -> str:
    """All rounds as a chain of tables: ``a<r>`` assigns, ``c<r>`` has the centres. Vectors and centres are one row per component."""
    near = "SELECT vec_id, n, i AS cluster, d FROM (SELECT x.vec_id, x.n, c.i, CAST(sum((x.x - c.x) * (x.x - c.x)) AS BIGINT) AS d FROM v x JOIN c{r} c ON x.j = c.j GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, i) = 1"
    chain = [
        f"e AS (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        "v AS (SELECT vec_id, n, unnest(v) AS x, unnest(range(len(v))) AS j FROM e)",
        f"c0 AS (SELECT i, unnest(v) AS x, unnest(range(len(v))) AS j FROM (SELECT v, row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), v) - 1 AS i FROM e) WHERE i < {k})",
    ]
    for r in range(rounds + 1):
        chain.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        if r < rounds:
            mean = f"SELECT a.cluster AS i, v.j, sum(v.x) AS s, count(*) AS m FROM a{r} a JOIN v ON a.n = v.n GROUP BY 1, 2"
            chain.append(f"c{r + 1} AS MATERIALIZED (SELECT c.i, c.j, CASE WHEN m IS NULL THEN c.x ELSE CAST((s - ((s % m) + m) % m) // m AS BIGINT) END AS x FROM c{r} c LEFT JOIN ({mean}) t ON c.i = t.i AND c.j = t.j)")
    chain.append(f"h AS (SELECT i, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY i)")
    return (
        f"WITH {', '.join(chain)} SELECT vec_id, CAST(cluster AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN h ON i = cluster"
    )


ORACLE = {
    "op12_sort_means": _op12(),
    "op10_cap_filters": OP10,
    "op2_line_dedup": OP2,
    "op8_ngram_jaccard": OP8,
    "op4_source_mixing": OP4,
    "op5_quality_rules": OP5,
}
