"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

SQL: dict[str, str] = {}

SQL["op4_mix_sources"] = rf"""
WITH d AS (
  SELECT doc_id, source, {WORDS}::BIGINT AS size,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i
  FROM d GROUP BY source
), r AS (
  SELECT source, source_size, i, [3.0, 1.0, 2.0][((i - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS lim FROM s
), b AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(lim) OVER (ORDER BY lim / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS left_over,
    sum(w) OVER (ORDER BY lim / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest,
    row_number() OVER (ORDER BY lim / w, i) AS k
  FROM r
), o AS (
  SELECT min(k) AS k0 FROM b WHERE left_over * w < lim * w_rest
), t AS (
  SELECT b.source, b.source_size,
    CASE WHEN b.k >= o.k0 THEN b.w * f.left_over / f.w_rest ELSE b.lim END AS target
  FROM b CROSS JOIN o LEFT JOIN b AS f ON f.k = o.k0
), p AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS sure,
    coalesce(target / nullif(source_size, 0), 0) - floor(coalesce(target / nullif(source_size, 0), 0)) AS pi
  FROM t
), e AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.sure, p.pi, d.source, p.target - p.sure * p.source_size AS open_words,
    CASE WHEN p.pi > 0 AND d.size > 0 THEN (d.u / (1 - d.u)) / (p.pi / (1 - p.pi)) END AS q
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), g AS (
  SELECT *, sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS run
  FROM e
)
SELECT doc_id, size, source_size, target,
  (sure + CASE WHEN q IS NOT NULL AND open_words > 0 AND run - size / 2.0::DOUBLE <= open_words THEN 1 ELSE 0 END) * size AS taken
FROM g
"""

FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

SQL["op2_embedding_dedup"] = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {FINITE}
), p AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y
  ON x.label = y.label AND x.vec_id <> y.vec_id AND list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.98
), r(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
), l AS (
  SELECT a, count(*) AS n FROM p GROUP BY a
)
SELECT c.a AS vec_id, coalesce(l.n, 0)::BIGINT AS n_links, c.component_id, c.a = c.component_id AS kept
FROM c LEFT JOIN l ON l.a = c.a
"""

SQL["op10_line_dedup"] = r"""
WITH s AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), l AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM s
), k AS (
  SELECT doc_id, i, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)
)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE f.first < k.doc_id)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE f.first IS NULL OR f.first = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key
GROUP BY k.doc_id
"""
