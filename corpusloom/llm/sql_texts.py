"""DuckDB SQL for the queries that SQL can express."""

OP6 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM per
), levels AS (
  SELECT *, (3 * source_size)::DOUBLE / weight::DOUBLE AS ratio,
    (sum(source_size) OVER () - (sum(3 * source_size) OVER w - 3 * source_size))::DOUBLE
      / (sum(weight) OVER () - (sum(weight) OVER w - weight))::DOUBLE AS level
  FROM weighted
  WINDOW w AS (ORDER BY (3 * source_size)::DOUBLE / weight::DOUBLE, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)
), final AS (
  SELECT level FROM levels WHERE ratio >= level ORDER BY ratio, source ASC NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size,
    CASE WHEN ratio < (SELECT level FROM final) THEN (3 * source_size)::DOUBLE ELSE (SELECT level FROM final) * weight END AS target
  FROM levels
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate FROM targets
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(sha1('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0
    < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source
"""

OP8 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), joined AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
    sum(length(regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g')) + length(url_encode(role)) + 15)::BIGINT AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM joined
"""


def clusters(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256) -> str:
    """Rounds of exact assignment and floored means, one after the other."""
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS cluster, x FROM v QUALIFY cluster < {k})",
    ]
    for i in range(rounds + 1):
        apart = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, v.x, cluster, {apart} AS distance FROM v, c{i} AS c QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT cluster, d, sum(x[d])::BIGINT AS s, count(*) AS n FROM a{i}, generate_series(1, {dims}) AS g(d) GROUP BY cluster, d)")
            steps.append(f"m{i} AS MATERIALIZED (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY d) AS x FROM s{i} GROUP BY cluster)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (cluster))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} AS c USING (cluster)"""


OP11 = clusters()

OP13 = """
WITH v AS MATERIALIZED (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), met AS (
  SELECT q.vec_id AS query_id, q.e AS e, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v AS q JOIN v AS c ON len(q.e) = len(c.e) AND (q.vec_id <> c.vec_id OR q.e <> c.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM met QUALIFY rank <= 20
"""

#: Smallest reachable node of a table of links ``l`` (u, v), for nodes that have any.
REACHED = """e AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
cc(node, component) USING KEY (node) AS (
  SELECT DISTINCT u, u FROM e UNION
  SELECT e.v, min(cc.component) FROM cc JOIN e ON e.u = cc.node JOIN recurring.cc AS own ON own.node = e.v WHERE cc.component < own.component GROUP BY e.v
)"""

OP4 = (
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), x AS MATERIALIZED (
  SELECT doc_id, unnest(s) AS t FROM g
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM x AS a JOIN x AS b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT u, v FROM p JOIN g AS gu ON gu.doc_id = u JOIN g AS gv ON gv.doc_id = v WHERE 100 * n >= 85 * (len(gu.s) + len(gv.s) - n)
), """
    + REACHED
    + """
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM g LEFT JOIN cc ON node = doc_id
"""
)

OP7 = (
    """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), """
    + REACHED
    + """, n AS (SELECT u, count(*) AS n FROM e GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN cc ON node = vec_id LEFT JOIN n ON u = vec_id
"""
)
