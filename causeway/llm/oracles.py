"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

#: Words of a text, as mixing counts them.
_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

_MIX = f"""
WITH sized AS (
  SELECT doc_id, source, {_SIZE}::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(source, 'null')) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS class
  FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][class + 1]::BIGINT AS w FROM sources),
level AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
         sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM weighed),
stops AS (
  SELECT *, (150 * total - 200 * stopped)::BIGINT AS room, w * (150 * total - 200 * stopped) > 200 * source_size * w_left AS stop FROM level),
opened AS (
  SELECT *, max(CASE WHEN NOT stop THEN 1 ELSE 0 END) OVER (ORDER BY source_size / w, source NULLS LAST) AS open FROM stops),
final AS (SELECT max(w_left)::BIGINT AS wl, max_by(room, w_left) AS rm FROM opened WHERE open = 1),
targets AS (
  SELECT source, source_size, class,
         CASE WHEN open = 0 THEN (200 * source_size)::DOUBLE / 100.0::DOUBLE
              ELSE (w * (SELECT rm FROM final))::DOUBLE / (100 * (SELECT wl FROM final))::DOUBLE END AS target
  FROM opened),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.class,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
"""

_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS z FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
q AS (SELECT vec_id AS query_id, min(z) AS z FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
s AS (
  SELECT q.query_id, v.vec_id, list_sum(list_transform(list_zip(q.z, v.z), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM q JOIN v ON v.vec_id <> q.query_id AND len(v.z) = len(q.z)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

# every order is run over the documents themselves
_AUDIT = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id AS id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(quality, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS bad,
         concat(CASE WHEN len(words) < 50 THEN 'A' ELSE '' END,
                CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END,
                CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN l ON id = doc_id),
p(filter_order, i) AS (
  SELECT '', 0 UNION ALL
  SELECT filter_order || x.f, i + 1 FROM p, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) x(f) WHERE i < 5 AND NOT contains(filter_order, x.f)),
o AS (SELECT filter_order, s.step, filter_order[s.step] AS f, filter_order[1:s.step - 1] AS earlier FROM p, (SELECT unnest(range(1, 6))::INTEGER AS step) s WHERE i = 5),
g AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(bad) AS bad FROM d GROUP BY ALL),
c AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (NOT gone AND NOT own), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (own AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (own AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (own AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM (SELECT *, contains(fails, f) AS own, translate(fails, earlier, '') <> fails AS gone FROM g, o) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM c"""

_CUTS = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM u),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, CASE WHEN form <> 'plain' THEN array_to_string(u[1:a], '') END AS pre, CASE WHEN form <> 'plain' THEN array_to_string(u[a + 1:b], '') END AS mid,
         CASE WHEN form <> 'plain' THEN array_to_string(u[b + 1:], '') END AS suf FROM f)
SELECT doc_id, n, form, length(pre)::BIGINT AS prefix_chars, length(mid)::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p"""

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": _MIX + """
SELECT doc_id, size, source_size, target,
       (size * (CASE WHEN size > 0 AND (2 * before + size)::DOUBLE <= 2 * target THEN 1 ELSE 0 END
              + CASE WHEN size > 0 AND (2 * (source_size + before) + size)::DOUBLE <= 2 * target THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed""",
    "op3_exact_topk": _TOPK,
    "op12_filter_audit": _AUDIT,
    "op13_fill_middle": _CUTS,
}
