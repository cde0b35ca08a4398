"""DuckDB SQL for op10, over the table documents."""

from bitquarry.llm.licenses import TEMPLATES

_VALUES = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))

LICENSES = rf"""
WITH t AS (SELECT * FROM (VALUES {_VALUES}) AS x(template, license, notice)),
tt AS (SELECT template, license, term, count(*) AS n FROM (SELECT template, license, unnest(regexp_split_to_array(lower(notice), '[^a-z0-9]+')) AS term FROM t) WHERE term <> '' GROUP BY ALL),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source, lang,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM documents),
f AS (SELECT rid, doc_id, text, words <= 60 AS is_file,
      '/' || coalesce(source, '') || '/' || coalesce(lang, '') || CASE WHEN words <= 60 AND coalesce(doc_id, 0) % 2 = 0 THEN '' WHEN words <= 60 THEN '/' || length(bin(words)) ELSE '/' || length(bin(words)) || '/' || coalesce(doc_id, 0) % 5 END AS folder FROM d),
dt AS (SELECT DISTINCT rid, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS term FROM f),
w AS (SELECT v.term, ln((1 + (SELECT count(*) FROM f)) / (1 + count(dt.rid))::DOUBLE) + 1 AS weight FROM (SELECT term FROM tt UNION SELECT term FROM dt) v LEFT JOIN dt ON v.term = dt.term GROUP BY v.term),
tv AS (SELECT template, license, tt.term, n * weight / sqrt(sum(n * weight * n * weight) OVER (PARTITION BY template)) AS share FROM tt JOIN w USING (term)),
u1 AS (SELECT rid, unit, line FROM (SELECT rid, unnest(regexp_split_to_array(regexp_replace(text, '([.!?;])[ \t]+', '\1' || chr(10), 'g'), '\n')) AS line, generate_subscripts(regexp_split_to_array(regexp_replace(text, '([.!?;])[ \t]+', '\1' || chr(10), 'g'), '\n'), 1) AS unit FROM f)),
u3 AS (SELECT *, lead(line) OVER o AS second, lead(line, 2) OVER o AS third FROM u1 WINDOW o AS (PARTITION BY rid ORDER BY unit)),
u AS (SELECT rid, unit * 4 AS unit, line FROM u3 UNION ALL SELECT rid, unit * 4 + 1, line || ' ' || second FROM u3 WHERE second IS NOT NULL UNION ALL SELECT rid, unit * 4 + 2, line || ' ' || second || ' ' || third FROM u3 WHERE third IS NOT NULL),
tf AS (SELECT rid, unit, term, count(*) AS n FROM (SELECT rid, unit, unnest(regexp_split_to_array(lower(line), '[^a-z0-9]+')) AS term FROM u) WHERE term <> '' GROUP BY ALL),
x AS (SELECT rid, unit, tf.term, n * weight AS x FROM tf JOIN w USING (term)),
nm AS (SELECT rid, unit, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
s AS (SELECT x.rid, x.unit, template, license, round(sum(x.x * share) / any_value(norm), 6) AS similarity FROM x JOIN tv USING (term) JOIN nm ON x.rid = nm.rid AND x.unit = nm.unit GROUP BY ALL),
own AS (SELECT rid, license AS own_license, similarity FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY similarity DESC, template) AS k FROM s WHERE similarity >= 0.75) WHERE k = 1),
n AS (SELECT f.rid, doc_id, folder || '/' || coalesce(doc_id::VARCHAR, 'null') AS path, folder, is_file, own_license, similarity FROM f LEFT JOIN own USING (rid)),
g AS (SELECT * FROM (SELECT folder, own_license, path, row_number() OVER (PARTITION BY folder ORDER BY similarity DESC, path) AS k FROM n WHERE is_file AND own_license IS NOT NULL) WHERE k = 1)
SELECT doc_id, n.path, n.own_license, similarity,
       coalesce(n.own_license, a.own_license, b.own_license, c.own_license) AS license,
       CASE WHEN n.own_license IS NOT NULL THEN n.path ELSE coalesce(a.path, b.path, c.path) END AS license_path
FROM n LEFT JOIN g a ON n.folder = a.folder LEFT JOIN g b ON a.folder IS NULL AND regexp_replace(n.folder, '/[^/]*$', '') = b.folder
LEFT JOIN g c ON a.folder IS NULL AND b.folder IS NULL AND regexp_replace(n.folder, '/[^/]*/[^/]*$', '') = c.folder
"""
