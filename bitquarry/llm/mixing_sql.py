"""DuckDB SQL for op6, over the table documents."""

MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, 1.0::DOUBLE + ((row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1) % 3) AS weight, 3.0::DOUBLE * source_size AS stop FROM s0),
s2 AS (SELECT *, stop / weight AS ratio, sum(source_size) OVER ()::DOUBLE AS total FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(stop) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s2),
s4 AS (SELECT *, max(CASE WHEN lev <= ratio THEN lev END) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS share FROM s3),
t AS (SELECT source, source_size, CASE WHEN share IS NULL THEN stop ELSE least(share * weight, stop) END AS target FROM s4),
c0 AS (SELECT source, length(bin(size)) AS cls, sum(size)::DOUBLE AS csize FROM d GROUP BY ALL HAVING sum(size) > 0),
c1 AS (SELECT c0.*, t.target, 16.0::DOUBLE / (16.0::DOUBLE + cls) AS w FROM c0 JOIN t ON c0.source IS NOT DISTINCT FROM t.source),
c2 AS (SELECT *, greatest(target - coalesce(sum(3.0::DOUBLE * csize) OVER (PARTITION BY source ORDER BY cls ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)
       / sum(w * csize) OVER (PARTITION BY source ORDER BY cls ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM c1),
c3 AS (SELECT *, max(CASE WHEN lev * w <= 3.0 THEN lev END) OVER (PARTITION BY source ORDER BY cls ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS share FROM c2),
c AS (SELECT source, cls, CASE WHEN share IS NULL THEN 3.0::DOUBLE ELSE least(share * w, 3.0::DOUBLE) END AS rate FROM c3),
r0 AS (SELECT d.*, t.source_size, t.target, coalesce(c.rate, 0) AS rate,
       (('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
       FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source AND length(bin(d.size)) = c.cls),
r1 AS (SELECT *, floor(rate) AS whole, rate - floor(rate) AS f FROM r0),
r2 AS (SELECT *, CASE WHEN f * size > 0 THEN (u / (1.0::DOUBLE - u)) / (f / (1.0::DOUBLE - f)) END AS q,
       target - sum(whole * size) OVER (PARTITION BY source) AS need FROM r1),
r3 AS (SELECT *, need - coalesce(sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM r2)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (whole * size + CASE WHEN q IS NULL THEN 0 ELSE greatest(0, least(round(room), size)) END)::BIGINT AS taken
FROM r3
"""
