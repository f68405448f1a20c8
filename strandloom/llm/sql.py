"""SQL for DuckDB that gives the results of those queries that SQL can express, written from the statements of the problems."""

P2_FOUND = r"""
WITH labels AS (
  SELECT upper(regexp_replace(coalesce(compound_class, ''), '^\s+|\s+$', '', 'g')) AS label FROM mibig_records
), map AS (
  SELECT upper(trim(product)) AS label, min(compound_class) AS c FROM class_map GROUP BY 1
), classed AS (
  SELECT CASE WHEN l.label = '' THEN 'UNKNOWN' WHEN t.compound_class IS NOT NULL THEN l.label ELSE coalesce(m.c, 'OTHER') END AS c
  FROM labels l LEFT JOIN (SELECT DISTINCT compound_class FROM class_targets) t ON t.compound_class = l.label LEFT JOIN map m ON m.label = l.label
), counts AS (SELECT c, count(*) AS n FROM classed GROUP BY c),
size AS (SELECT count(*) // 4 AS n FROM mibig_records)
SELECT t.compound_class
FROM class_targets t CROSS JOIN size s LEFT JOIN counts k ON k.c = t.compound_class
WHERE coalesce(k.n, 0) < greatest(t.min_records, CAST(ceil(t.target_permille * s.n / 1000.0) AS BIGINT))
"""

P4_FOUND = r"""
WITH cut AS (
  SELECT record_id,
    lower(regexp_replace(split, '^\s+|\s+$', '', 'g')) AS raw,
    list_filter(regexp_split_to_array(regexp_extract(lower(coalesce(taxonomic_tag, '')), '(?:^|[;|])\s*s__([^;|]*)', 1), '[^\p{L}]+'), lambda x: x <> '') AS words,
    regexp_replace(upper(regexp_replace(accession, '\s+', '', 'g')), '\.[0-9]+$', '') AS acc
  FROM mibig_records
), keyed AS (
  SELECT record_id,
    CASE WHEN raw IN ('valid', 'validation') THEN 'val' ELSE nullif(raw, '') END AS split,
    CASE WHEN len(words) >= 2 AND words[2] NOT IN ('sp', 'spp') THEN 's:' || words[1] || ' ' || words[2] ELSE 'a:' || nullif(acc, '') END AS key
  FROM cut
), torn AS (SELECT key FROM keyed WHERE key IS NOT NULL AND split IS NOT NULL GROUP BY key HAVING count(DISTINCT split) > 1)
SELECT record_id FROM keyed WHERE split IS NOT NULL AND key IN (SELECT key FROM torn)
"""

P5_FOUND = r"""
WITH RECURSIVE long AS (
  SELECT record_id, length(sequence) AS n, regexp_extract_all(sequence, '[Nn]+|[^Nn]+') AS runs FROM mibig_records WHERE length(sequence) > 8000
), placed AS (
  SELECT record_id, n, runs, list_transform(range(1, len(runs) + 1), lambda i: list_sum(list_transform(runs[1:i], lambda x: length(x)))) AS ends FROM long
), gaps AS (
  SELECT record_id, n, list_transform(list_filter(range(1, len(runs) + 1), lambda i: length(runs[i]) >= 20 AND lower(runs[i][1]) = 'n'), lambda i: ends[i]) AS b FROM placed
), genes AS (
  SELECT record_id, list(DISTINCT g.e) AS b FROM (SELECT record_id, unnest(genes) AS g FROM domain_annotations) GROUP BY record_id
), bounds AS (
  SELECT g.record_id, g.n, list_filter(list_concat(list_transform(g.b, lambda x: CAST(x AS BIGINT)), list_transform(coalesce(e.b, []), lambda x: CAST(x AS BIGINT))), lambda x: x > 0 AND x < g.n) AS b
  FROM gaps g LEFT JOIN genes e ON e.record_id = g.record_id
), pieces AS (
  SELECT record_id, n, b, CAST(0 AS BIGINT) AS s, coalesce(list_max(list_filter(b, lambda x: x > 400 AND x <= 8000)), 8000) AS e FROM bounds
  UNION ALL
  SELECT record_id, n, b, e - 400, CASE WHEN n - (e - 400) <= 8000 THEN n ELSE coalesce(list_max(list_filter(b, lambda x: x > e AND x <= e - 400 + 8000)), e - 400 + 8000) END
  FROM pieces WHERE e < n
)
SELECT record_id, CAST(s AS INTEGER) AS piece_start, CAST(e AS INTEGER) AS piece_end FROM pieces
"""
