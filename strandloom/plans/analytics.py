"""Similarity, sampling, window, rule, statistics, vector and function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import frames, names, sequence
from strandloom.operators import joins, ranking, rules, sampling, similarity, stats, vectors, windows
from strandloom.plans.catalogue import query, rounded, table

_RC = "reverse(translate({}, 'ACGTN', 'TGCAN'))"
_H = "CAST('0x' || substr(md5({}), 1, 8) AS UBIGINT)"


def _records(spark, d):
    return table(spark, d, "mibig_records")


def _kset(k: int, canonical: bool = True) -> str:
    kmer = f"substring(s, i, {k})"
    return f"list_distinct(list_transform(range(1, greatest(length(s) - {k} + 2, 1)), lambda i: {f'least({kmer}, {_RC.format(kmer)})' if canonical else kmer}))"


_SETS = f"SELECT record_id, {_kset(21)} AS ks FROM (SELECT record_id, upper(sequence) AS s FROM mibig_records WHERE sequence IS NOT NULL)"


@query(f"SELECT record_id, len(ks) AS n, md5(list_aggregate(list_sort(ks), 'string_agg', '')) AS digest FROM ({_SETS})")
def sim1_sim2_canonical_kmers(spark, d):
    rows = _records(spark, d).where("sequence is not null").select("record_id", sequence.canonical_kmer_set(F.col("sequence"), 21).alias("ks"))
    digest = F.when(F.size("ks") > 0, F.md5(F.encode(F.array_join(F.array_sort("ks"), ""), "utf-8")))
    return rows.select("record_id", F.size("ks").cast("bigint").alias("n"), digest.alias("digest"))


@query()
def sim3_crc_kmers(spark, d):
    rows = _records(spark, d).where("sequence is not null")
    return rows.select("record_id", F.size(sequence.crc_set(sequence.canonical_kmer_set(F.col("sequence"), 21))).alias("n"))


_SKETCH = f"SELECT record_id, list_sort(list_distinct(list_transform(ks, lambda k: {_H.format('k')})))[1:64] AS sk FROM ({_SETS})"


def _sketches(spark, d):
    kmers = sequence.canonical_kmer_set(F.col("sequence"), 21)
    return _records(spark, d).where("sequence is not null").select("record_id", sequence.bottom_sketch(F.transform(kmers, sequence.hash32), 64).alias("sk"))


@query(f"SELECT record_id, list_transform(sk, lambda x: CAST(x AS BIGINT)) AS sk FROM ({_SKETCH})")
def sim4_sketch(spark, d):
    return _sketches(spark, d)


@query(
    f"""WITH k AS (SELECT *, row_number() OVER (ORDER BY record_id) AS n FROM ({_SKETCH})), p AS (SELECT a.record_id, b.record_id AS other, a.sk, b.sk AS o FROM k a JOIN k b ON b.n = CASE WHEN a.n = (SELECT max(n) FROM k) THEN 1 ELSE a.n + 1 END),
    u AS (SELECT record_id, other, list_sort(list_distinct(list_concat(sk, o)))[1:64] AS un, sk, o FROM p)
    SELECT record_id, other, round(CASE WHEN len(un) > 0 THEN len(list_intersect(list_intersect(un, sk), o)) / len(un) ELSE 0 END, 6) AS jaccard FROM u"""
)
def sim5_sim17_rotation_jaccard(spark, d):
    pairs = similarity.rotated_pairs(_sketches(spark, d), "record_id", "sk")
    return rounded(pairs.select("record_id", "other", sequence.sketch_jaccard(F.col("sk"), F.col("other_value"), 64).alias("jaccard")))


def _search_sql(canonical: bool, k: int, keep: int) -> str:
    text = "upper(sequence)" if canonical else "sequence"
    return f"""WITH s AS MATERIALIZED (SELECT record_id, sequence, {_kset(k, canonical)} AS ks FROM (SELECT min(record_id) AS record_id, sequence, {text} AS s FROM mibig_records WHERE sequence IS NOT NULL GROUP BY sequence)), e AS MATERIALIZED (SELECT record_id, len(ks) AS n, unnest(ks) AS h FROM s),
    q AS (SELECT m.record_id AS q, s.record_id AS a, s.sequence, len(ks) AS n FROM mibig_records m JOIN s ON s.sequence = m.sequence WHERE m.record_id % 20 = 0), p AS (SELECT x.record_id AS a, y.record_id AS b, count(*) / any_value(x.n) AS c FROM e x JOIN e y ON x.h = y.h AND x.record_id <> y.record_id WHERE x.record_id IN (SELECT a FROM q) GROUP BY 1, 2),
    f AS (SELECT q, b, c FROM q JOIN p USING (a) UNION ALL SELECT q, min(m.record_id), 1 FROM q JOIN mibig_records m ON m.sequence = q.sequence AND m.record_id <> q WHERE n > 0 GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, b) AS r FROM f)
    SELECT q AS record_id, b AS match_record_id, round(c, 6) AS containment FROM r WHERE r <= {keep}"""


def _search(spark, d, canonical: bool, k: int):
    rows = _records(spark, d).where("sequence is not null")
    return rounded(similarity.full_search(rows.where("record_id % 20 = 0"), rows, "record_id", "sequence", k, 3, canonical))


@query(_search_sql(True, 21, 3))
def sim6_sim7_containment_search(spark, d):
    return _search(spark, d, True, 21)


@query(_search_sql(False, 15, 3))
def sim9_plain_kmers(spark, d):
    return _search(spark, d, False, 15)


_ALL_PAIRS = f"""WITH s AS MATERIALIZED (SELECT record_id, {_kset(21)} AS ks FROM (SELECT min(record_id) AS record_id, upper(sequence) AS s FROM mibig_records WHERE sequence IS NOT NULL GROUP BY sequence)), e AS MATERIALIZED (SELECT record_id, len(ks) AS n, unnest(ks) AS h FROM s),
    p AS (SELECT a.record_id AS a, b.record_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.h = b.h AND a.record_id <> b.record_id GROUP BY 1, 2)"""


def _full_links(spark, d, least):
    rows = _records(spark, d)
    return rows, similarity.full_links(rows, "record_id", "sequence", 21, least)


def _either_way(links):
    """(a, b, containment), a < b: of the two directions the greater one, which is that of the smaller set."""
    return links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("containment").alias("containment"))


@query(f"{_ALL_PAIRS} SELECT a, b, round(shared / na, 6) AS containment FROM p WHERE shared / na >= 0.5")
def jn17_all_links(spark, d):
    return rounded(_full_links(spark, d, 0.5)[1])


_CLASSES = f"""WITH RECURSIVE l AS MATERIALIZED (SELECT a, b FROM ({_ALL_PAIRS} SELECT a, b FROM p WHERE a < b AND shared / least(na, nb) >= 0.6)), n AS (SELECT a, b FROM l UNION SELECT b, a FROM l), t AS (SELECT a AS x, a AS y FROM n UNION SELECT t.x, n.b FROM t JOIN n ON n.a = t.y), c AS (SELECT x AS rep, min(y) AS class_id FROM t GROUP BY 1),
    r AS (SELECT record_id, sequence, CASE WHEN sequence IS NOT NULL THEN min(record_id) OVER (PARTITION BY sequence) ELSE record_id END AS rep, CASE WHEN sequence IS NOT NULL THEN count(*) OVER (PARTITION BY sequence) ELSE 1 END AS copies FROM mibig_records), k AS (SELECT DISTINCT rep, copies FROM r), d AS (SELECT n.a AS rep, sum(copies) AS deg FROM n JOIN k ON k.rep = n.b GROUP BY 1)
    SELECT record_id, coalesce(class_id, r.rep) AS class_id, CAST(coalesce(deg, 0) + copies - 1 AS BIGINT) AS links FROM r LEFT JOIN c ON c.rep = r.rep LEFT JOIN d ON d.rep = r.rep"""


@query(_CLASSES.replace(">= 0.6", ">= 0.5"))
def jn17_link_classes(spark, d):
    rows, links = _full_links(spark, d, 0.5)
    return similarity.link_classes(rows, "record_id", "sequence", _either_way(links))


@query(f"""WITH s AS MATERIALIZED ({_SETS}), e AS MATERIALIZED (SELECT record_id, len(ks) AS n, unnest(ks) AS h FROM s),
    p AS (SELECT a.record_id, b.record_id AS r, count(*) / any_value(a.n) AS c FROM e a JOIN e b ON a.h = b.h AND a.record_id <> b.record_id WHERE a.record_id % 20 = 0 GROUP BY 1, 2), b AS (SELECT record_id, max(c) AS c, arg_min(r, (-c, r)) AS m FROM p GROUP BY 1)
    SELECT r.record_id, m AS nearest, round(coalesce(c, 0), 6) AS max_containment, CASE WHEN coalesce(c, 0) >= 0.95 THEN 'FAIL' WHEN coalesce(c, 0) >= 0.8 THEN 'WARN' ELSE 'PASS' END AS tier FROM mibig_records r LEFT JOIN b USING (record_id) WHERE r.record_id % 20 = 0 AND sequence IS NOT NULL""")
def sim8_full_novelty(spark, d):
    rows = _records(spark, d).where("sequence is not null")
    return rounded(similarity.full_nearest(rows.where("record_id % 20 = 0"), rows, "record_id", "sequence", 21))


@query(f"{_ALL_PAIRS} SELECT a, b, round(shared / least(na, nb), 6) AS containment FROM p WHERE a < b AND shared / least(na, nb) >= 0.6")
def sim10_full_links(spark, d):
    return rounded(_either_way(_full_links(spark, d, 0.6)[1]))


@query(_CLASSES)
def sim11_link_classes(spark, d):
    rows, links = _full_links(spark, d, 0.6)
    return similarity.link_classes(rows, "record_id", "sequence", _either_way(links))


_GREEDY = f"""WITH RECURSIVE l AS MATERIALIZED (SELECT a, b FROM ({_ALL_PAIRS} SELECT a, b FROM p WHERE a < b AND shared / least(na, nb) >= 0.6)), n AS (SELECT a, b FROM l UNION SELECT b, a FROM l), o AS (SELECT a AS x, list(b) AS near, row_number() OVER (ORDER BY a) AS i FROM n GROUP BY 1),
    g AS (SELECT CAST(0 AS BIGINT) AS i, []::BIGINT[] AS kept UNION ALL SELECT o.i, CASE WHEN list_has_any(kept, near) THEN kept ELSE list_append(kept, x) END FROM g JOIN o ON o.i = g.i + 1)
    SELECT record_id FROM (SELECT min(record_id) AS record_id FROM mibig_records WHERE sequence IS NOT NULL GROUP BY sequence) WHERE record_id NOT IN (SELECT x FROM o) OR record_id IN (SELECT unnest(kept) FROM g WHERE i = (SELECT max(i) FROM g))"""


@query(_GREEDY)
def sim11_greedy_distinct(spark, d):
    rows, links = _full_links(spark, d, 0.6)
    return similarity.greedy_distinct(rows, "record_id", "sequence", _either_way(links))


@query(f"""{_ALL_PAIRS}, v AS (SELECT shared / least(na, nb) AS c FROM p WHERE a < b), t AS (SELECT count(*) AS n FROM s), q AS (SELECT unnest(list_concat((SELECT list(c) FROM v), list_resize([]::DOUBLE[], CAST(n * (n - 1) / 2 - (SELECT count(*) FROM v) AS BIGINT), 0))) AS c FROM t)
    SELECT (SELECT n FROM t) AS texts, count(*) AS pairs, count(*) FILTER (c > 0) AS meeting, round(median(c), 6) AS median, round(max(c), 6) AS greatest FROM q""")
def sim12_pairwise(spark, d):
    rows = _records(spark, d)
    return rounded(similarity.pairwise_summary(rows, "record_id", "sequence", 21))


@query(f"SELECT count(*) AS rows, count(DISTINCT class_id) AS classes, count(*) FILTER (links > 0) / count(*) AS near_dup_share, max(n) AS largest FROM (SELECT *, count(*) OVER (PARTITION BY class_id) AS n FROM ({_CLASSES}))")
def sim12_set_summary(spark, d):
    rows, links = _full_links(spark, d, 0.6)
    return similarity.set_summary(similarity.link_classes(rows, "record_id", "sequence", _either_way(links)))


@query("SELECT r.record_id, coalesce(max(bit_score), 0) AS best FROM mibig_records r LEFT JOIN domain_hits h USING (record_id) GROUP BY 1")
def sim13_best_identity(spark, d):
    return similarity.best_identity(_records(spark, d), "record_id", table(spark, d, "domain_hits"), "bit_score")


_NORM = "(SELECT record_id, CASE WHEN lower(trim(split)) IN ('valid', 'validation') THEN 'val' ELSE lower(trim(split)) END AS split, md5(sequence) AS c FROM mibig_records)"


@query(
    f"""WITH r AS {_NORM}, t AS (SELECT c FROM r WHERE split = 'train' AND c IS NOT NULL), te AS (SELECT * FROM r WHERE split = 'test' AND (c IS NULL OR c NOT IN (SELECT c FROM t))),
    v AS (SELECT * FROM r WHERE split = 'val' AND (c IS NULL OR (c NOT IN (SELECT c FROM t) AND c NOT IN (SELECT c FROM te WHERE c IS NOT NULL))))
    SELECT record_id FROM r WHERE split IS NULL OR split NOT IN ('val', 'test') UNION ALL SELECT record_id FROM te UNION ALL SELECT record_id FROM v"""
)
def sim15_cleaned_splits(spark, d):
    s = F.lower(F.trim("split"))
    rows = _records(spark, d).withColumn("split", F.when(s.isin("valid", "validation"), "val").otherwise(s))
    return similarity.cleaned_splits(rows, "record_id", "split", F.md5(F.encode("sequence", "utf-8"))).select("record_id")


@query(
    f"""{_ALL_PAIRS}, l AS MATERIALIZED (SELECT a, b FROM p WHERE shared / least(na, nb) >= 0.6), n AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT record_id, record_id FROM s),
    r AS (SELECT record_id, CASE WHEN lower(trim(split)) IN ('valid', 'validation') THEN 'val' ELSE lower(trim(split)) END AS split, CASE WHEN sequence IS NOT NULL THEN min(record_id) OVER (PARTITION BY sequence) END AS rep FROM mibig_records),
    tr AS (SELECT DISTINCT n.a AS rep FROM r JOIN n ON n.b = r.rep WHERE split = 'train'), te AS (SELECT * FROM r WHERE split = 'test' AND (rep IS NULL OR rep NOT IN (SELECT rep FROM tr))), ne AS (SELECT DISTINCT n.a AS rep FROM te JOIN n ON n.b = te.rep)
    SELECT record_id FROM r WHERE split IS NULL OR split NOT IN ('val', 'test') UNION ALL SELECT record_id FROM te UNION ALL SELECT record_id FROM r WHERE split = 'val' AND (rep IS NULL OR (rep NOT IN (SELECT rep FROM tr) AND rep NOT IN (SELECT rep FROM ne)))"""
)
def sim15_near_cleaned_splits(spark, d):
    s = F.lower(F.trim("split"))
    rows = _records(spark, d).withColumn("split", F.when(s.isin("valid", "validation"), "val").otherwise(s))
    return similarity.near_cleaned_splits(rows, "record_id", "split", "sequence", _full_links(spark, d, 0.6)[1]).select("record_id")


@query("SELECT source, count(*) AS before, count(*) FILTER (record_id IN (SELECT record_id FROM domain_hits)) AS removed, count(*) FILTER (record_id NOT IN (SELECT record_id FROM domain_hits)) AS \"after\" FROM mibig_records GROUP BY source")
def sim16_excluded_report(spark, d):
    return similarity.excluded(_records(spark, d), table(spark, d, "domain_hits"), "record_id", "source")[1]


@query(
    """WITH k AS (SELECT record_id, training_text AS t, row_number() OVER (ORDER BY record_id) AS n FROM mibig_records), p AS (SELECT a.record_id, b.record_id AS other, a.t AS x, b.t AS y FROM k a JOIN k b ON b.n = CASE WHEN a.n = (SELECT max(n) FROM k) THEN 1 ELSE a.n + 1 END)
    SELECT record_id, other, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN coalesce(list_min(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: x[i] <> y[i])) - 1, least(length(x), length(y))) END AS shared FROM p"""
)
def sim18_common_prefix(spark, d):
    pairs = similarity.rotated_pairs(_records(spark, d), "record_id", "training_text")
    return pairs.select("record_id", "other", similarity.common_prefix(F.col("training_text"), F.col("other_value")).alias("shared"))


@query(
    """WITH k AS (SELECT record_id, row_number() OVER (ORDER BY record_id) AS n, count(*) OVER () AS t FROM mibig_records), p AS (SELECT a.record_id, b.record_id AS other FROM (SELECT record_id, CASE WHEN n = t THEN 1 ELSE n + 1 END AS n FROM k) a JOIN k b ON b.n = a.n),
    m AS (SELECT record_id, unnest(list_transform(range(1, greatest(length(sequence) - 3, 1)), lambda i: upper(substring(sequence, i, 5)))) AS m FROM mibig_records), c AS MATERIALIZED (SELECT record_id, m, CAST(count(*) AS DOUBLE) AS n FROM m GROUP BY 1, 2), g AS MATERIALIZED (SELECT * FROM c WHERE NOT regexp_matches(m, '[^ACGT]')),
    q AS MATERIALIZED (SELECT record_id, sqrt(sum(n * n)) AS q FROM g GROUP BY 1), x AS MATERIALIZED (SELECT p.record_id, p.other, g.m, g.n FROM p JOIN g ON g.record_id = p.record_id), d AS MATERIALIZED (SELECT x.record_id, x.other, sum(x.n * g.n) AS d FROM x JOIN g ON g.record_id = x.other AND g.m = x.m GROUP BY 1, 2)
    SELECT p.record_id, p.other, round(1 - coalesce(d, 0) / (y.q * z.q), 6) AS distance FROM p LEFT JOIN d ON d.record_id = p.record_id AND d.other = p.other LEFT JOIN q y ON y.record_id = p.record_id LEFT JOIN q z ON z.record_id = p.other"""
)
def sim19_profile_distance(spark, d):
    rows = _records(spark, d)
    pairs = similarity.rotated_pairs(rows, "record_id", "accession")
    return rounded(similarity.profile_distances(pairs, rows, "record_id", "other", "sequence", 5))


@query(
    """WITH s AS (SELECT record_id, list_sort(list(DISTINCT acc)) AS a FROM domain_hits WHERE acc IS NOT NULL GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY record_id) AS n FROM s),
    p AS (SELECT a.record_id, b.record_id AS other, a.a AS x, b.a AS y FROM k a JOIN k b ON b.n = CASE WHEN a.n = (SELECT max(n) FROM k) THEN 1 ELSE a.n + 1 END)
    SELECT record_id, other, round(1 - len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS distance FROM p"""
)
def sim20_jaccard_distance(spark, d):
    sets = table(spark, d, "domain_hits").where("acc is not null").groupBy("record_id").agg(F.array_sort(F.collect_set("acc")).alias("a"))
    return rounded(similarity.rotated_pairs(sets, "record_id", "a").select("record_id", "other", similarity.jaccard_distance(F.col("a"), F.col("other_value")).alias("distance")))


@query(
    """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings), q AS (SELECT a.vec_id, b.vec_id AS o, list_distance(a.e, b.e) AS dist FROM x a JOIN x b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, o) AS n FROM q) SELECT vec_id, round(avg(dist), 5) AS mean_distance, arg_min(o, n) AS nearest FROM r WHERE n <= 5 GROUP BY 1"""
)
def sim21_nearest_vectors(spark, d):
    bank = table(spark, d, "embeddings")
    return rounded(similarity.nearest_vectors(bank.where("vec_id % 20 = 0"), bank, "vec_id", "embedding", 5), 5)


@query("WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM x a JOIN x b ON b.vec_id = a.vec_id + 1")
def sim22_cosine(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return rounded(a.join(b, "vec_id").select("vec_id", similarity.cosine(F.col("x"), F.col("y")).alias("cosine")))


# -- samples and splits ------------------------------------------------------------------------------------------------

_MD5 = "md5('{}|' || CAST(record_id AS VARCHAR))"


@query(
    f"""WITH x AS (SELECT record_id, compound_class AS c, row_number() OVER (PARTITION BY compound_class ORDER BY {_MD5.format(7)}, record_id) AS r, count(*) OVER (PARTITION BY compound_class) AS n FROM mibig_records),
    y AS (SELECT *, greatest(1, CAST(round(n * 0.1) AS BIGINT)) AS v, greatest(1, CAST(round(n * 0.2) AS BIGINT)) AS t FROM x)
    SELECT record_id, c AS compound_class, CASE WHEN n - v - t < 1 THEN 'train' WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'val' ELSE 'train' END AS split FROM y"""
)
def sp1_stratified_split(spark, d):
    return sampling.stratified_split(_records(spark, d), "record_id", "compound_class", 0.1, 0.2, "7")


@query("SELECT record_id, CASE WHEN length(taxonomic_tag) > 0 THEN 'g::' || taxonomic_tag WHEN length(accession) > 0 THEN 'a::' || accession ELSE 'h::' || md5(coalesce(sequence, '')) END AS key FROM mibig_records")
def sp2_fn27_group_key(spark, d):
    return _records(spark, d).select("record_id", names.group_key(F.col("taxonomic_tag"), F.col("accession"), F.col("sequence")).alias("key"))


@query()
def sp3_group_split(spark, d):
    rows = _records(spark, d).withColumn("g", names.group_key(F.col("taxonomic_tag"), F.col("accession"), F.col("sequence")))
    return sampling.assign_groups(rows, "g", "compound_class", {"train": 0.8, "val": 0.1, "test": 0.1})


@query(
    """WITH RECURSIVE k AS (SELECT compound_class AS c, CASE WHEN length(taxonomic_tag) > 0 THEN 'g::' || taxonomic_tag WHEN length(accession) > 0 THEN 'a::' || accession ELSE 'h::' || md5(coalesce(sequence, '')) END AS g FROM mibig_records), z AS (SELECT c, g, count(*) AS n FROM k GROUP BY 1, 2),
    s AS (SELECT coalesce(c, chr(0)) AS c, g, n, row_number() OVER (PARTITION BY c ORDER BY n DESC, g) AS r, CAST(sum(n) OVER (PARTITION BY c) AS DOUBLE) AS t FROM z),
    w AS (SELECT c, CAST(0 AS BIGINT) AS r, '' AS g, '' AS split, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, CAST(0 AS BIGINT) AS z FROM s GROUP BY c
    UNION ALL SELECT c, r, g, split, x + CASE split WHEN 'train' THEN n ELSE 0 END, y + CASE split WHEN 'val' THEN n ELSE 0 END, z + CASE split WHEN 'test' THEN n ELSE 0 END FROM (
      SELECT w.c, s.r, s.g, s.n, x, y, z, CASE WHEN (0.8::DOUBLE * t - x) / (0.8::DOUBLE * t) >= (0.1::DOUBLE * t - y) / (0.1::DOUBLE * t) AND (0.8::DOUBLE * t - x) / (0.8::DOUBLE * t) >= (0.1::DOUBLE * t - z) / (0.1::DOUBLE * t) THEN 'train' WHEN (0.1::DOUBLE * t - y) / (0.1::DOUBLE * t) >= (0.1::DOUBLE * t - z) / (0.1::DOUBLE * t) THEN 'val' ELSE 'test' END AS split FROM w JOIN s ON s.c = w.c AND s.r = w.r + 1))
    SELECT CASE WHEN c <> chr(0) THEN c END AS compound_class, g, split FROM w WHERE r > 0"""
)
def sp4_deficit_split(spark, d):
    rows = _records(spark, d).withColumn("g", names.group_key(F.col("taxonomic_tag"), F.col("accession"), F.col("sequence")))
    return sampling.deficit_split(rows, "compound_class", "g", {"train": 0.8, "val": 0.1, "test": 0.1})


@query("SELECT taxonomic_tag, count(DISTINCT split) AS splits FROM mibig_records WHERE split IS NOT NULL AND taxonomic_tag IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def sp5_torn_groups(spark, d):
    return sampling.torn_groups(_records(spark, d), "taxonomic_tag", "split")


@query(
    """WITH m AS (SELECT compound_class, count(DISTINCT taxonomic_tag) AS groups, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b FROM mibig_records GROUP BY 1)
    SELECT compound_class, groups, concat_ws(',', CASE WHEN a < 30 THEN 'train<30' END, CASE WHEN b < 5 THEN 'test<5' END, CASE WHEN groups < 20 THEN 'groups<20' END) AS reasons FROM m"""
)
def sp6_viability(spark, d):
    return sampling.viability(_records(spark, d), "compound_class", "taxonomic_tag", "split", {"train": 30, "test": 5}, 20)


def _budget_cells(spark, d):
    rows = _records(spark, d).withColumn("phylum", F.coalesce(F.upper(names.tag_rank(F.col("taxonomic_tag"), "p")), F.lit("P__UNKNOWN")))
    rows = rows.withColumn("bucket", F.coalesce(names.bucket_label(F.length("sequence"), [1000, 2000, 4000, 8000]), F.lit("none"))).withColumn("cls", F.upper(F.coalesce("compound_class", F.lit("UNKNOWN"))))
    return sampling.budget_cells(rows, "cls", ["phylum", "bucket"], 40)


@query()
def sp7_budget_cells(spark, d):
    return _budget_cells(spark, d)


_CELLS = """SELECT upper(coalesce(compound_class, 'UNKNOWN')) AS cls, coalesce(nullif(upper(trim(regexp_extract(taxonomic_tag, '(?i)(?:^|[;|])\\s*p__([^;|]*)', 1))), ''), 'P__UNKNOWN') AS phylum,
    CASE WHEN length(sequence) <= 1000 THEN 1 WHEN length(sequence) <= 2000 THEN 2 WHEN length(sequence) <= 4000 THEN 3 WHEN length(sequence) <= 8000 THEN 4 WHEN sequence IS NOT NULL THEN 5 END AS bucket, count(*) AS n FROM mibig_records GROUP BY 1, 2, 3"""


@query(f"SELECT cls, count(*) AS cells, CAST(sum(n) AS BIGINT) AS available, CAST(least(40, sum(n)) AS BIGINT) AS quota, CAST(greatest(0, count(*) - 40) AS BIGINT) AS without, true AS within FROM ({_CELLS}) GROUP BY 1")
def sp7_budget_totals(spark, d):
    """What must hold of the quotas whatever the rounding: they add up, stay within what there is and leave no cell out."""
    q = _budget_cells(spark, d)
    return q.groupBy("cls").agg(F.count("*").alias("cells"), F.sum("available").alias("available"), F.sum("quota").alias("quota"), F.count_if(F.col("quota") == 0).alias("without"), F.bool_and(F.col("quota") <= F.col("available")).alias("within"))


@query(
    f"""WITH x AS (SELECT record_id, compound_class AS c, coalesce(source = 'lab_upload', false) AS f FROM mibig_records), u AS (SELECT c, count(*) FILTER (f) AS n FROM x GROUP BY 1),
    o AS (SELECT record_id, c, row_number() OVER (PARTITION BY c ORDER BY {_MD5.format(3)}, record_id) AS r FROM x WHERE NOT f)
    SELECT record_id FROM x WHERE f UNION ALL SELECT record_id FROM o JOIN u ON o.c IS NOT DISTINCT FROM u.c WHERE r <= greatest(20 - n, 0)"""
)
def sp8_capped(spark, d):
    return sampling.capped(_records(spark, d), "record_id", "compound_class", F.col("source") == "lab_upload", 20, "3").select("record_id")


@query(f"SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY compound_class ORDER BY {_MD5.format(5)}, record_id) AS r FROM mibig_records) WHERE r <= 10")
def sp9_balanced(spark, d):
    return sampling.balanced(_records(spark, d), "record_id", "compound_class", 10, "5").select("record_id")


@query(
    f"""WITH x AS (SELECT record_id, upper(trim(compound_class)) AS c, substring(sequence, 1, 2000) AS s FROM mibig_records WHERE length(sequence) >= 200), k AS (SELECT c FROM x GROUP BY 1 HAVING count(*) >= 5),
    r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY {_MD5.format(9)}, record_id) AS r FROM x WHERE c IN (SELECT c FROM k)) SELECT record_id, c AS label, length(s) AS n FROM r WHERE r <= 50"""
)
def sp10_probe_sample(spark, d):
    rows = _records(spark, d).where(F.length("sequence") >= 200).select("record_id", F.upper(F.trim("compound_class")).alias("label"), F.length(F.substring("sequence", 1, 2000)).cast("bigint").alias("n"))
    big = rows.groupBy("label").agg(F.count("*").alias("c")).where("c >= 5")
    return sampling.balanced(rows.join(big, "label", "left_semi"), "record_id", "label", 50, "9").select("record_id", "label", "n")


@query(
    f"""WITH t AS (SELECT count(*) FILTER (source = 'lab_upload') AS m, count(DISTINCT source) FILTER (NOT source = 'lab_upload') AS l FROM mibig_records),
    o AS (SELECT record_id, row_number() OVER (PARTITION BY source ORDER BY {_MD5.format(2)}, record_id) AS r FROM mibig_records WHERE source <> 'lab_upload')
    SELECT record_id FROM mibig_records WHERE source = 'lab_upload' UNION ALL SELECT record_id FROM o CROSS JOIN t WHERE r <= m // greatest(l, 1)"""
)
def sp11_parity(spark, d):
    return sampling.parity(_records(spark, d), "record_id", "source", ["lab_upload"], "2").select("record_id")


@query(f"SELECT record_id FROM mibig_records ORDER BY {_MD5.format(1)}, record_id LIMIT 100")
def sp12_fixed_sample(spark, d):
    return sampling.fixed_sample(_records(spark, d), "record_id", 100, "1").select("record_id")


@query(
    f"""WITH x AS (SELECT record_id, source, length(sequence) AS n FROM mibig_records WHERE sequence IS NOT NULL AND source IS NOT NULL), e AS (SELECT quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.5) AS b, quantile_cont(n, 0.75) AS c FROM x),
    y AS (SELECT record_id, source, CAST(a < n AS INTEGER) + CAST(b < n AS INTEGER) + CAST(c < n AS INTEGER) AS bin FROM x CROSS JOIN e), s AS (SELECT bin, source, count(*) AS k FROM y GROUP BY 1, 2), m AS (SELECT bin, min(k) AS k FROM s GROUP BY 1 HAVING count(*) > 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY bin, source ORDER BY {_MD5.format(4)}, record_id) AS r FROM y) SELECT record_id, source, r.bin FROM r JOIN m ON m.bin = r.bin WHERE r <= k"""
)
def sp13_matched_bins(spark, d):
    rows = _records(spark, d).withColumn("n", F.length("sequence"))
    return sampling.matched_bins(rows, "record_id", "source", "n", 4, "4")


@query()
def sp15_shuffled(spark, d):
    rows = _records(spark, d)
    return rows.select("record_id", sampling.shuffled(F.col("sequence"), F.col("record_id"), "1").alias("bases"), sampling.shuffled(F.col("sequence"), F.col("record_id"), "1", 3).alias("codons"))


@query("SELECT t.taxonomic_tag, l.label, r.repeat FROM (SELECT DISTINCT taxonomic_tag FROM mibig_records WHERE taxonomic_tag IS NOT NULL) t CROSS JOIN (SELECT unnest(['PKS', 'NRPS', 'RIPP']) AS label) l CROSS JOIN (SELECT unnest([0, 1, 2]) AS repeat) r")
def sp16_experiment_plan(spark, d):
    return sampling.experiment_plan(_records(spark, d), "taxonomic_tag", ["PKS", "NRPS", "RIPP"], 3)


@query("SELECT record_id FROM mibig_records WHERE split IN ('test', 'val') ORDER BY split <> 'test', record_id LIMIT 50")
def sp17_prompt_set(spark, d):
    return sampling.prompt_set(_records(spark, d), "record_id", "split", 50).select("record_id")


@query(
    f"""WITH a AS (SELECT record_id, compound_class, CAST((row_number() OVER (PARTITION BY compound_class ORDER BY {_MD5.format(6)}, record_id) - 1) % 5 AS INTEGER) AS fold, CAST(CAST('0x' || substr(md5('6|' || coalesce(taxonomic_tag, '')), 1, 8) AS UBIGINT) % 5 AS INTEGER) AS group_fold,
      row_number() OVER (ORDER BY {_MD5.format(6)}, record_id) AS n FROM mibig_records), b AS (SELECT compound_class AS shuffled_label, row_number() OVER (ORDER BY {_MD5.format('6-labels')}, record_id) AS n FROM mibig_records)
    SELECT record_id, compound_class, fold, group_fold, shuffled_label FROM a JOIN b ON a.n = b.n"""
)
def sp18_folds(spark, d):
    return sampling.folds(_records(spark, d), "record_id", "compound_class", "taxonomic_tag", 5, "6")


# -- windows -----------------------------------------------------------------------------------------------------------


@query(
    """WITH x AS (SELECT record_id, length(sequence) AS n FROM mibig_records WHERE sequence IS NOT NULL), c AS (SELECT *, CASE WHEN n <= 2000 THEN 1 ELSE 1 + CAST(ceil((n - 2000) / 1800) AS BIGINT) END AS k FROM x),
    w AS (SELECT record_id, n, unnest(range(0, k)) AS k FROM c) SELECT record_id, CAST(k AS INTEGER) AS "window", CAST(k * 1800 AS INTEGER) AS nt_start, CAST(least(k * 1800 + 2000, n) AS INTEGER) AS nt_end, least(k * 1800 + 2000, n) >= n AS last FROM w"""
)
def ch1_ch2_ch4_ch11_tiles(spark, d):
    size, stride = windows.budget(2255, 250, 0, 5, 200)
    return windows.tiles(_records(spark, d).select("record_id", F.length("sequence").alias("n")), F.col("n"), size, stride).select("record_id", "window", "nt_start", "nt_end", "last")


@query(
    """WITH RECURSIVE g AS (SELECT record_id, max(genes) AS genes FROM domain_annotations WHERE genes IS NOT NULL GROUP BY 1), r AS (SELECT m.record_id, CAST(length(sequence) AS BIGINT) AS n, list_sort(list_transform(list_filter(coalesce(genes, []), lambda x: x.s IS NOT NULL AND x.e IS NOT NULL), lambda x: {'s': x.s, 'e': x.e})) AS g FROM mibig_records m LEFT JOIN g USING (record_id) WHERE sequence IS NOT NULL),
    p AS (SELECT record_id, n, g, CAST(0 AS BIGINT) AS a, CASE WHEN n <= 2000 THEN n WHEN len(g) = 0 THEN 2000 ELSE coalesce((SELECT CASE WHEN f > 0 THEN f END FROM (SELECT list_filter(g, lambda x: x.s >= 0 AND x.s < 2000 AND x.e <= 2000)[-1].e AS f)), 2000) END AS e FROM r
    UNION ALL SELECT record_id, n, g, b, CASE WHEN n - b <= 2000 THEN n WHEN len(g) = 0 THEN b + 2000 ELSE coalesce(CASE WHEN f > b THEN f END, b + 2000) END
      FROM (SELECT *, list_filter(g, lambda x: x.s >= b AND x.s < b + 2000 AND x.e <= b + 2000)[-1].e AS f FROM (SELECT *, CASE WHEN len(g) = 0 THEN a + 1800 WHEN e - 200 > a THEN e - 200 ELSE e END AS b FROM p WHERE n - a > 2000)))
    SELECT record_id, CAST(a AS INTEGER) AS nt_start, CAST(e AS INTEGER) AS nt_end FROM p"""
)
def ch3_gene_tiles(spark, d):
    genes = table(spark, d, "domain_annotations").where("genes is not null").groupBy("record_id").agg(F.max("genes").alias("genes"))
    rows = _records(spark, d).select("record_id", F.length("sequence").alias("n")).join(genes, "record_id", "left")
    return windows.gene_tiles(rows, "record_id", "n", "genes", 2000, 200)


@query("WITH x AS (SELECT strlen(left(training_text, length(training_text) - length(sequence))) AS n FROM mibig_records WHERE sequence IS NOT NULL AND training_text IS NOT NULL) SELECT max(n) AS longest, round(avg(n), 6) AS mean, round(max(n) - avg(n), 6) AS slack FROM x")
def ch5_longest_prefix(spark, d):
    rows = _records(spark, d).where("sequence is not null and training_text is not null")
    return rounded(windows.longest_prefix(rows, F.substring(F.col("training_text"), F.lit(1), F.length("training_text") - F.length("sequence"))))


@query(
    """WITH x AS (SELECT record_id, sequence AS s, length(sequence) AS n, '|' || coalesce(compound_class, '') || '|' AS p FROM mibig_records WHERE sequence IS NOT NULL), w AS (SELECT *, unnest(range(0, CASE WHEN n <= 2000 THEN 1 ELSE 1 + CAST(ceil((n - 2000) / 1800) AS BIGINT) END)) AS k FROM x)
    SELECT record_id, CAST(k AS INTEGER) AS "window", md5(CASE WHEN k = 0 THEN p ELSE p || '+' END || substring(s, k * 1800 + 1, least(k * 1800 + 2000, n) - k * 1800) || CASE WHEN k * 1800 + 2000 >= n THEN '|END|' ELSE '' END) AS digest FROM w"""
)
def ch6_prj3_window_text(spark, d):
    rows = _records(spark, d).where("sequence is not null").select("record_id", "sequence", F.length("sequence").alias("n"), F.concat(F.lit("|"), F.coalesce("compound_class", F.lit("")), F.lit("|")).alias("p"))
    t = windows.tiles(rows, F.col("n"), 2000, 1800)
    text = windows.window_text(F.col("sequence"), F.col("nt_start"), F.col("nt_end"), F.col("last"), F.col("p"), F.concat(F.col("p"), F.lit("+")), "|END|", 2255)
    return t.select("record_id", "window", F.md5(F.encode(text, "utf-8")).alias("digest"))


@query(
    """WITH x AS (SELECT vec_id, list_transform(embedding[1:label + 3], lambda v: CAST(round(v * 100) AS INTEGER)) AS t FROM embeddings)
    SELECT vec_id, list_concat(t, list_resize([]::INTEGER[], 16 - len(t), 0)) AS ids, list_concat(list_resize([]::INTEGER[], 2, -100), list_concat(t[3:], list_resize([]::INTEGER[], 16 - len(t), -100))) AS labels FROM x"""
)
def ch7_padded_labels(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", F.lit(1), F.col("label") + 3), lambda v: F.round(v * 100).cast("int")).alias("t"))
    ids, labels = windows.padded_labels(F.col("t"), F.lit(2), 16)
    return rows.select("vec_id", ids.alias("ids"), labels.alias("labels"))


@query(
    """WITH a AS (SELECT record_id, max(spans) AS sp FROM domain_annotations WHERE spans IS NOT NULL GROUP BY 1), x AS (SELECT r.record_id, sequence AS s, sp, unnest(range(0, greatest(length(sequence) - 500 + 1, 0), 500)) AS t FROM mibig_records r LEFT JOIN a USING (record_id) WHERE sequence IS NOT NULL)
    SELECT record_id, CAST(t AS INTEGER) AS nt_start, CAST(t + 500 AS INTEGER) AS nt_end FROM x WHERE len(list_filter(coalesce(sp, []), lambda q: q.e > t AND q.s < t + 500)) = 0 AND length(regexp_replace(substring(s, t + 1, 500), '[^Nn]', '', 'g')) <= 5"""
)
def ch8_free_windows(spark, d):
    spans = table(spark, d, "domain_annotations").where("spans is not null").groupBy("record_id").agg(F.max("spans").alias("spans"))
    rows = _records(spark, d).select("record_id", "sequence").join(spans, "record_id", "left")
    return windows.free_windows(rows, "record_id", "sequence", "spans", 500)


@query(
    """WITH a AS (SELECT record_id, max(length) AS n, max(spans) AS sp FROM domain_annotations WHERE length IS NOT NULL GROUP BY 1), i AS (SELECT record_id, n, list_filter(coalesce(sp, []), lambda x: x.is_class AND x.e > x.s AND x.e > 0 AND x.s < n) AS ins FROM a WHERE n > 0),
    c AS (SELECT *, list_sort(list_distinct(list_concat([0, n], flatten(list_transform(ins, lambda x: [greatest(x.s, 0), least(x.e, n)]))))) AS cuts FROM i), r AS (SELECT *, unnest(range(1, len(cuts))) AS k FROM c), q AS (SELECT record_id, n, ins, cuts[k] AS s, cuts[k + 1] AS e FROM r),
    w AS (SELECT record_id, n, s, e, CASE WHEN len(list_filter(ins, lambda x: x.s <= s AND x.e >= e)) > 0 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM q) SELECT record_id, s AS start, e AS "end", round(w / (sum(w * (e - s)) OVER (PARTITION BY record_id) / n), 6) AS w FROM w"""
)
def ch9_weight_runs(spark, d):
    rows = table(spark, d, "domain_annotations").where("length is not null").groupBy("record_id").agg(F.max("length").alias("length"), F.max("spans").alias("spans"))
    return rounded(windows.weight_runs(rows, "record_id", "length", "spans", 3.0))


@query(
    """WITH g AS (SELECT DISTINCT record_id, g.s AS s, g.e AS e, g.strand AS strand FROM (SELECT record_id, unnest(genes) AS g FROM domain_annotations))
    SELECT record_id, s, e, strand, CAST(CASE WHEN strand >= 0 THEN (s + 10 - s) % 3 ELSE (e - 1 - (s + 10)) % 3 END AS INTEGER) AS phase FROM g WHERE s + 10 < e"""
)
def ch10_codon_phase(spark, d):
    genes = table(spark, d, "domain_annotations").select("record_id", F.explode("genes").alias("g")).select("record_id", "g.s", "g.e", "g.strand").distinct()
    phase = windows.codon_phase(F.col("s") + 10, F.col("s"), F.col("e"), F.col("strand"))
    return genes.where("s + 10 < e").select("record_id", "s", "e", "strand", phase.cast("int").alias("phase"))


@query("SELECT record_id, substring(training_text, 1, 512) AS head FROM mibig_records")
def ch12_truncated(spark, d):
    return _records(spark, d).select("record_id", F.substring("training_text", 1, 512).alias("head"))


# -- functions ---------------------------------------------------------------------------------------------------------


@query(
    """SELECT record_id, CASE WHEN n <= 1000 THEN '<=1000' WHEN n <= 8000 THEN '<=8000' WHEN n > 8000 THEN '>8000' END AS exact, CASE WHEN n <= 16384 THEN '<=16k' WHEN n <= 131072 THEN '<=131k' WHEN n > 131072 THEN '>131k' END AS thousands,
    CASE WHEN n >= 0 AND n < 500 THEN '[0, 500)' WHEN n >= 500 AND n < 5000 THEN '[500, 5000)' END AS half_open FROM (SELECT record_id, length(sequence) AS n FROM mibig_records)"""
)
def fn4_fn5_fn6_buckets(spark, d):
    n = F.length("sequence")
    return _records(spark, d).select("record_id", names.bucket_label(n, [1000, 8000]).alias("exact"), names.bucket_label_k(n, [16384, 131072]).alias("thousands"), names.half_open_label(n, [0, 500, 5000]).alias("half_open"))


@query(
    """WITH p AS (SELECT record_id, unnest(list_transform(range(1, greatest(length(sequence), 1)), lambda i: upper(substring(sequence, i, 2)))) AS p FROM mibig_records), c AS (SELECT record_id, p, count(*) AS n FROM p GROUP BY 1, 2), t AS (SELECT record_id, sum(n) AS t FROM c GROUP BY 1),
    h AS (SELECT c.record_id, -sum(n / t * log2(n / t)) AS h FROM c JOIN t ON c.record_id = t.record_id GROUP BY 1) SELECT record_id, abs(round(coalesce(h, CASE WHEN sequence IS NOT NULL THEN 0 END), 6)) AS entropy FROM mibig_records LEFT JOIN h USING (record_id)"""
)
def fn7_pair_entropy(spark, d):
    return rounded(_records(spark, d).select("record_id", F.abs(sequence.pair_entropy(F.col("sequence"))).alias("entropy")))


_REF = {"AA": 1.1, "CG": 0.9, "TA": 0.8, "GC": 1.2}


@query(
    """WITH s AS (SELECT record_id, upper(sequence) AS s, length(sequence) AS n FROM mibig_records WHERE length(sequence) >= 2), k AS (SELECT record_id, unnest(list_transform(range(1, n), lambda i: substring(s, i, 2))) AS p FROM s),
    c AS (SELECT record_id, p, count(*) AS m FROM k GROUP BY 1, 2), v(p, r) AS (VALUES ('AA', 1.1), ('CG', 0.9), ('TA', 0.8), ('GC', 1.2)),
    o AS (SELECT record_id, CAST(r AS DOUBLE) AS r, m / (CAST(n - length(replace(s, p[1], '')) AS DOUBLE) / n * (n - length(replace(s, p[2], ''))) / n * (n - 1)) AS ratio FROM c JOIN v USING (p) JOIN s USING (record_id))
    SELECT record_id, round(sqrt(avg((ratio - r) * (ratio - r))), 6) AS rmsd FROM o GROUP BY 1"""
)
def fn8_fn9_pair_rmsd(spark, d):
    rows = _records(spark, d).where("length(sequence) >= 2")
    return rounded(rows.select("record_id", sequence.rmsd(sequence.pair_ratios(F.upper("sequence")), _REF).alias("rmsd")).where(F.col("rmsd") < 1e300))


_WEIGHTS = sequence.relative_adaptiveness({c: 1.0 + (i % 7) for i, c in enumerate(sorted(sequence.codon_table()))})


@query(
    "WITH w(c, w) AS (VALUES "
    + ", ".join(f"('{c}', {w!r})" for c, w in sorted(_WEIGHTS.items()) if w > 0)
    + """), k AS (SELECT record_id, unnest(list_transform(range(1, greatest(length(sequence) - 1, 1), 3), lambda i: upper(substring(sequence, i, 3)))) AS c FROM mibig_records), l AS (SELECT record_id, exp(avg(ln(w))) AS cai FROM k JOIN w ON w.c = k.c GROUP BY 1)
    SELECT record_id, round(cai, 6) AS cai FROM mibig_records LEFT JOIN l USING (record_id)"""
)
def fn10_fn11_adaptation(spark, d):
    return rounded(_records(spark, d).select("record_id", sequence.adaptation_index(F.col("sequence"), _WEIGHTS).alias("cai")))


@query()
def fn12_open_frames(spark, d):
    return frames.open_frames(_records(spark, d), "record_id", "sequence", 50)


@query(
    "WITH w(c, a) AS (VALUES "
    + ", ".join(f"('{c}', '{a}')" for c, a in sorted(sequence.codon_table().items()))
    + """), k AS (SELECT record_id, unnest(list_transform(range(1, greatest(length(sequence) - 1, 1), 3), lambda i: upper(substring(sequence, i, 3)))) AS c, unnest(range(1, greatest(length(sequence) - 1, 1), 3)) AS i FROM mibig_records), l AS (SELECT record_id, string_agg(coalesce(a, 'X'), '' ORDER BY i) AS aa FROM k LEFT JOIN w ON w.c = k.c GROUP BY 1)
    SELECT record_id, coalesce(aa, CASE WHEN sequence IS NOT NULL THEN '' END) AS aa FROM mibig_records LEFT JOIN l USING (record_id)"""
)
def fn14_translated(spark, d):
    return _records(spark, d).select("record_id", sequence.translated(F.col("sequence")).alias("aa"))


@query(
    """WITH g AS (SELECT DISTINCT record_id, g.s AS s, g.e AS e, g.strand AS st FROM (SELECT record_id, unnest(genes) AS g FROM domain_annotations))
    SELECT record_id, s, e, st AS strand, greatest(s, CASE WHEN st >= 0 THEN s + 3 * 4 ELSE e - 3 * 20 END) AS first, least(e, CASE WHEN st >= 0 THEN s + 3 * 20 ELSE e - 3 * 4 END) AS last FROM g"""
)
def fn15_residue_span(spark, d):
    genes = table(spark, d, "domain_annotations").select("record_id", F.explode("genes").alias("g")).select("record_id", "g.s", "g.e", "g.strand").distinct()
    a, b = sequence.residue_span(F.col("s"), F.col("e"), F.col("strand"), F.lit(5), F.lit(20))
    return genes.select("record_id", "s", "e", "strand", a.alias("first"), b.alias("last"))


@query("WITH x AS (SELECT record_id, sequence AS s, list_max(list_filter(range(1, greatest(length(sequence) - 1, 1)), lambda i: upper(substring(sequence, i, 3)) IN ('TAA', 'TAG', 'TGA'))) AS i FROM mibig_records) SELECT record_id, CASE WHEN i IS NULL THEN length(s) ELSE i + 2 END AS n FROM x")
def fn16_last_stop(spark, d):
    return _records(spark, d).select("record_id", F.length(sequence.last_stop_trim(F.col("sequence"))).cast("bigint").alias("n"))


@query()
def fn17_lineage_tag(spark, d):
    ranks = {"superkingdom": "domain", "domain": "domain", "phylum": "phylum", "class": "class", "order": "order", "family": "family", "genus": "genus", "species": "species"}
    rows = joins.lineage(table(spark, d, "taxa_nodes"), "taxid", "parent", "tax_rank", "name", ranks)
    cols = {r: F.col(f"`{r}`") for r in names.RANKS}
    return rows.select(F.col("node").alias("taxid"), names.lineage_tag(cols).alias("upper_tag"), names.lineage_tag(cols, upper=False).alias("native_tag"))


@query("SELECT record_id, nullif(trim(regexp_extract(taxonomic_tag, '(?i)(?:^|[;|])\\s*p__([^;|]*)', 1)), '') AS phylum, nullif(trim(regexp_extract(taxonomic_tag, '(?i)(?:^|[;|])\\s*s__([^;|]*)', 1)), '') AS species FROM mibig_records")
def fn20_fn21_fn23_ranks(spark, d):
    t = F.col("taxonomic_tag")
    return _records(spark, d).select("record_id", names.tag_rank(t, "p").alias("phylum"), names.tag_rank(t, "s").alias("species"))


@query("SELECT record_id, coalesce(CASE WHEN starts_with(upper(trim(accession)), 'BGC') THEN 'compounds' END, source, 'core') AS origin, split_part(gbk_member, '.region', 1) AS genome FROM mibig_records")
def fn24_fn26_source(spark, d):
    return _records(spark, d).select("record_id", names.source_of(F.col("accession"), F.col("source"), {"BGC": "compounds"}, "core").alias("origin"), names.genome_of(F.col("gbk_member")).alias("genome"))


@query("WITH x AS (SELECT record_id, regexp_replace(regexp_replace(lower(trim(coalesce(compound_names_all[1], ''))), '\\s+', '_', 'g'), '[^a-z0-9_+-]', '', 'g') AS t FROM mibig_records) SELECT record_id, CASE WHEN t <> '' THEN t ELSE 'unknown' END AS token FROM x")
def fn25_compound_token(spark, d):
    return _records(spark, d).select("record_id", names.compound_token(F.get("compound_names_all", F.lit(0))).alias("token"))


@query(
    """WITH p AS (SELECT vec_id, list_transform(embedding[1:6], lambda v: abs(CAST(v AS DOUBLE)) + 0.01) AS v FROM embeddings), n AS (SELECT vec_id, list_transform(v, lambda x: x / list_sum(v)) AS p FROM p)
    SELECT vec_id, round(list_sum(list_transform(p, lambda x: -x * ln(x))) / ln(6), 6) AS entropy, round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 6) AS margin FROM n"""
)
def fn28_entropy_margin(spark, d):
    v = F.transform(F.slice("embedding", 1, 6), lambda x: F.abs(x.cast("double")) + 0.01)
    rows = table(spark, d, "embeddings").select("vec_id", v.alias("v")).withColumn("t", F.aggregate("v", F.lit(0.0), lambda s, x: s + x))
    m = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct(i.cast("string").alias("k"), (F.get("v", i) / F.col("t")).alias("v"))))
    return rounded(rows.select("vec_id", m.alias("m")).select("vec_id", names.map_entropy(F.col("m")).alias("entropy"), names.map_margin(F.col("m")).alias("margin")))


@query(
    """WITH h AS (SELECT record_id, count(*) FILTER (strand > 0) AS p, count(*) FILTER (strand < 0) AS m, count(*) AS n, max(env_to) - min(env_from) AS w, count(*) FILTER (acc IN (SELECT acc FROM domain_models WHERE compound_class IS NOT NULL)) AS bio FROM domain_hits GROUP BY 1)
    SELECT record_id, round(greatest(p, m) / n, 6) AS co_orientation, w AS span, round(bio / n, 6) AS fraction FROM h"""
)
def fn31_orientation(spark, d):
    ours = table(spark, d, "domain_models").where("compound_class is not null and acc is not null").select("acc").distinct().withColumn("bio", F.lit(1))
    hits = table(spark, d, "domain_hits").join(ours, "acc", "left")
    n = F.count("*")
    return rounded(hits.groupBy("record_id").agg((F.greatest(F.count_if(F.col("strand") > 0), F.count_if(F.col("strand") < 0)) / n).alias("co_orientation"), (F.max("env_to") - F.min("env_from")).alias("span"), (F.count("bio") / n).alias("fraction")))


@query(
    """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE))) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM x)
    SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.p) + 1), lambda i: a.p[i] * ln(a.p[i] / b.p[i]))), 6) AS kl FROM p a JOIN p b ON b.vec_id = a.vec_id + 1"""
)
def fn32_divergence(spark, d):
    e = F.transform("embedding", lambda v: F.exp(v.cast("double")))
    rows = table(spark, d, "embeddings").select("vec_id", e.alias("e")).withColumn("t", F.aggregate("e", F.lit(0.0), lambda s, x: s + x)).select("vec_id", F.transform("e", lambda x: x / F.col("t")).alias("p"))
    both = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")
    return rounded(both.select("vec_id", F.aggregate(F.zip_with("p", "q", lambda a, b: a * F.log(a / b)), F.lit(0.0), lambda s, x: s + x).alias("kl")))


@query("SELECT record_id, CAST(nullif(regexp_extract(gbk_member, '.*batch[_-]?([0-9]+)', 1), '') AS BIGINT) AS step, CAST(record_id - record_id % 8 AS BIGINT) AS resume FROM mibig_records")
def fn33_fn35_steps(spark, d):
    path = F.regexp_replace("gbk_member", "batch", "step")
    return _records(spark, d).select("record_id", names.path_step(path).alias("step"), names.floored(F.col("record_id"), 8).alias("resume"))


@query("WITH x AS (SELECT record_id, substring(upper(sequence), 1, 200) AS h FROM mibig_records) SELECT record_id, CASE WHEN regexp_full_match(h, '[ACGT]+') THEN length(regexp_replace(h, '[^GC]', '', 'g')) / length(h) BETWEEN 0.25 AND 0.65 END AS ok FROM x")
def fn34_gc_range(spark, d):
    return _records(spark, d).select("record_id", sequence.within_range(F.col("sequence"), 200, 0.25, 0.65).alias("ok"))


@query("SELECT l_returnflag, round(sum(l_tax * l_quantity * CAST(l_linenumber <> 1 AS INTEGER)) / greatest(sum(l_quantity * CAST(l_linenumber <> 1 AS INTEGER)), 1e-8), 8) AS loss FROM lineitem GROUP BY 1")
def fn36_weighted_loss(spark, d):
    keep = (F.col("l_linenumber") != 1).cast("int")
    return rounded(table(spark, d, "lineitem").groupBy("l_returnflag").agg((F.sum(F.col("l_tax") * F.col("l_quantity") * keep) / F.greatest(F.sum(F.col("l_quantity") * keep), F.lit(1e-8))).alias("loss")), 8)


@query(
    """WITH k AS (SELECT record_id, upper(sequence) AS s, unnest(range(1, greatest(length(sequence) - 1, 1), 3)) AS i FROM mibig_records), c AS (SELECT record_id, i, substring(s, i, 2) AS two, substring(s, i + 2, 1) AS b FROM k)
    SELECT record_id, count(*) AS open_contexts FROM c WHERE (two = 'TA' AND b NOT IN ('A', 'G')) OR (two = 'TG' AND b <> 'A') GROUP BY 1"""
)
def fn37_stop_contexts(spark, d):
    codons = F.explode_outer(sequence.codons(F.col("sequence"))).alias("c")
    rows = _records(spark, d).where("sequence is not null").select("record_id", codons)
    third = F.substring("c", 3, 1)
    opened = (F.col("c").startswith("TA") & ~third.isin("A", "G")) | (F.col("c").startswith("TG") & (third != "A"))
    return rows.where(opened).groupBy("record_id").agg(F.count("*").alias("open_contexts"))


# -- rules -------------------------------------------------------------------------------------------------------------

_ANN = "(SELECT record_id, max(genes) AS genes, max(length) AS n FROM domain_annotations WHERE error IS NULL AND genes IS NOT NULL GROUP BY 1)"


def _genes(spark, d):
    ann = table(spark, d, "domain_annotations").where("error is null and genes is not null").groupBy("record_id").agg(F.max("genes").alias("genes"), F.max("length").alias("n"))
    return ann.select("record_id", "n", F.explode_outer("genes").alias("g")).select("record_id", "n", F.col("g.s").alias("s"), F.col("g.e").alias("e"), F.col("g.strand").alias("strand"))


@query(
    f"""WITH g AS (SELECT record_id, n, unnest(CASE WHEN len(genes) > 0 THEN genes ELSE [NULL] END) AS g FROM {_ANN}), per AS (SELECT record_id, max(n) AS n, count(g.s) AS genes, max(floor((g.e - g.s) / 3)) AS longest FROM g GROUP BY 1),
    w AS (SELECT record_id, g.s AS s, g.e AS e, max(g.e) OVER (PARTITION BY record_id ORDER BY g.s, g.e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM g WHERE g.e > g.s), c AS (SELECT record_id, sum(greatest(e - greatest(s, coalesce(t, s)), 0)) AS covered FROM w GROUP BY 1),
    p AS (SELECT record_id, unnest(list_transform(range(1, greatest(length(sequence), 1)), lambda i: upper(substring(sequence, i, 2)))) AS p FROM mibig_records), k AS (SELECT record_id, p, count(*) AS n FROM p GROUP BY 1, 2), t AS (SELECT record_id, sum(n) AS t FROM k GROUP BY 1), h AS (SELECT k.record_id, -sum(n / t * log2(n / t)) AS h FROM k JOIN t ON k.record_id = t.record_id GROUP BY 1),
    x AS (SELECT r.record_id, coalesce(covered, 0) / nullif(per.n, 0) AS density, genes, longest, abs(coalesce(h, CASE WHEN sequence IS NOT NULL THEN 0 END)) AS entropy FROM mibig_records r JOIN per USING (record_id) LEFT JOIN c USING (record_id) LEFT JOIN h USING (record_id))
    SELECT record_id, round(density, 6) AS density, genes, CAST(longest AS BIGINT) AS longest, round(entropy, 6) AS entropy, coalesce(density >= 0.5 AND genes >= 1 AND longest >= 100 AND entropy >= 2.5, false) AS passed FROM x"""
)
def ru1_coding_sanity(spark, d):
    genes = _genes(spark, d)
    covered = joins.islands(genes, "record_id")
    per = genes.groupBy("record_id").agg(F.max("n").alias("n"), F.count("s").alias("genes"), F.max(F.floor((F.col("e") - F.col("s")) / 3)).alias("longest"))
    rows = _records(spark, d).select("record_id", F.abs(sequence.pair_entropy(F.col("sequence"))).alias("entropy")).join(per, "record_id").join(covered, "record_id", "left")
    density = F.coalesce("covered", F.lit(0)) / F.nullif(F.col("n"), F.lit(0))
    return rounded(rows.select("record_id", density.alias("density"), "genes", "longest", "entropy", rules.coding_sanity(density, F.col("genes"), F.col("longest"), F.col("entropy")).alias("passed")))


@query("WITH f AS (SELECT record_id, list_sort(list(DISTINCT compound_class)) AS f FROM domain_annotations WHERE compound_class IS NOT NULL GROUP BY 1) SELECT record_id, CASE WHEN len(f) > 0 THEN list_contains(f, compound_class) OR (compound_class = 'PKS_NRPS_HYBRID' AND list_contains(f, 'PKS') AND list_contains(f, 'NRPS')) END AS matched FROM mibig_records JOIN f USING (record_id)")
def ru2_class_match(spark, d):
    found = table(spark, d, "domain_annotations").where("compound_class is not null").groupBy("record_id").agg(F.array_sort(F.collect_set("compound_class")).alias("found"))
    rows = _records(spark, d).select("record_id", "compound_class").join(found, "record_id")
    return rows.select("record_id", rules.class_match(F.col("compound_class"), F.col("found"), {"PKS_NRPS_HYBRID": ["PKS", "NRPS"]}).alias("matched"))


@query(
    """WITH p AS (SELECT compound_class AS c, list_sort(list(DISTINCT acc)) AS need FROM domain_models WHERE compound_class IS NOT NULL AND acc IS NOT NULL GROUP BY 1), h AS (SELECT record_id, list(DISTINCT acc) AS have FROM domain_hits WHERE acc IN (SELECT acc FROM domain_models) GROUP BY 1)
    SELECT record_id, array_to_string(list_filter(need, lambda x: list_contains(coalesce(have, []), x)), ',') AS present, array_to_string(list_filter(need, lambda x: NOT list_contains(coalesce(have, []), x)), ',') AS missing, need IS NULL AS unknown_class,
    CASE WHEN compound_class = 'OTHER' OR need IS NULL THEN NULL ELSE len(list_filter(need, lambda x: list_contains(coalesce(have, []), x))) > 0 END AS passed FROM mibig_records LEFT JOIN p ON c = compound_class LEFT JOIN h USING (record_id)"""
)
def ru3_marker_check(spark, d):
    return rules.marker_check(_records(spark, d), "record_id", "compound_class", table(spark, d, "domain_hits"), "acc", table(spark, d, "domain_models"), "acc", "compound_class")


@query("SELECT vec_id, CASE WHEN c >= 0.95 THEN 'FAIL' WHEN c >= 0.8 THEN 'no_verdict' WHEN c IS NULL THEN 'skipped' ELSE 'PASS' END AS verdict FROM (SELECT vec_id, CASE WHEN label <> 3 THEN abs(CAST(embedding[1] AS DOUBLE)) * 4 END AS c FROM embeddings)")
def ru4_ru11_novelty(spark, d):
    c = F.when(F.col("label") != 3, F.abs(F.get("embedding", F.lit(0)).cast("double")) * 4)
    passed, skipped = rules.novelty_check(c)
    return table(spark, d, "embeddings").select("vec_id", rules.verdict(passed, skipped).alias("verdict"))


@query(
    """WITH g AS (SELECT DISTINCT record_id, orf FROM domain_hits), f AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY orf) AS r FROM g), h AS (SELECT DISTINCT record_id, orf FROM domain_hits WHERE evalue < 1e-10), p AS (SELECT f.record_id, count(*) AS genes, count(h.orf) AS with_hit FROM f LEFT JOIN h USING (record_id, orf) WHERE r <= 20 GROUP BY 1)
    SELECT record_id, coalesce(genes, 0) AS genes, coalesce(with_hit, 0) AS with_hit, CASE WHEN genes > 0 THEN with_hit / genes >= 0.5 END AS passed FROM (SELECT DISTINCT record_id FROM mibig_records) LEFT JOIN p USING (record_id)"""
)
def ru5_homology(spark, d):
    hits = table(spark, d, "domain_hits")
    return rules.homology_check(_records(spark, d), "record_id", hits.select("record_id", "orf").distinct(), "orf", hits.where("evalue < 1e-10"), "orf")


@query(
    """WITH s AS (SELECT record_id, upper(sequence) AS s, length(sequence) AS n, taxonomic_tag AS tag FROM mibig_records WHERE length(sequence) >= 2), k AS (SELECT record_id, unnest(list_transform(range(1, n), lambda i: substring(s, i, 2))) AS p FROM s), m AS (SELECT record_id, p, count(*) AS m FROM k GROUP BY 1, 2), v(p, r) AS (VALUES ('AA', 1.1), ('CG', 0.9), ('TA', 0.8), ('GC', 1.2)),
    o AS (SELECT record_id, CAST(r AS DOUBLE) AS r, m / (CAST(n - length(replace(s, p[1], '')) AS DOUBLE) / n * (n - length(replace(s, p[2], ''))) / n * (n - 1)) AS ratio FROM m JOIN v USING (p) JOIN s USING (record_id)), d AS (SELECT record_id, sqrt(avg((ratio - r) * (ratio - r))) AS d FROM o GROUP BY 1),
    w(c, w) AS (VALUES """
    + ", ".join(f"('{c}', {w!r})" for c, w in sorted(_WEIGHTS.items()) if w > 0)
    + """), q AS (SELECT record_id, unnest(list_transform(range(1, greatest(n - 1, 1), 3), lambda i: substring(s, i, 3))) AS c FROM s), l AS (SELECT record_id, exp(avg(ln(w))) AS cai FROM q JOIN w ON w.c = q.c GROUP BY 1),
    g AS (SELECT *, length(regexp_replace(s, '[^ACGT]', '', 'g')) AS b, length(regexp_replace(s, '[^GC]', '', 'g')) AS gc FROM s)
    SELECT record_id, CASE WHEN tag IS NOT NULL THEN coalesce(CAST(CASE WHEN b > 0 THEN gc / b ELSE 0 END BETWEEN 0.35 AND 0.65 AS INTEGER), 0) + coalesce(CAST(cai >= 0.3 AS INTEGER), 0) + coalesce(CAST(d < 0.25 AS INTEGER), 0) >= 2 END AS faithful FROM g LEFT JOIN l USING (record_id) LEFT JOIN d USING (record_id)"""
)
def ru7_faithfulness(spark, d):
    s = F.upper("sequence")
    gc, cai, distance = sequence.gc_of_acgt(s), sequence.adaptation_index(s, _WEIGHTS), sequence.rmsd(sequence.pair_ratios(s), _REF)
    rows = _records(spark, d).where("length(sequence) >= 2")
    return rows.select("record_id", rules.faithful(gc, (0.35, 0.65), cai, 0.3, distance, 0.25, F.col("taxonomic_tag").isNotNull()).alias("faithful"))


@query(
    """WITH h AS (SELECT DISTINCT * FROM domain_hits WHERE acc IS NOT NULL), t AS (SELECT acc, row_number() OVER (ORDER BY count(*) DESC, acc) AS r FROM h GROUP BY 1), o AS (SELECT record_id, string_agg(CASE r WHEN 1 THEN 'x' ELSE 'y' END, '' ORDER BY orf * 10000 + env_from, h.acc) AS s FROM h JOIN t ON t.acc = h.acc AND r <= 2 GROUP BY 1),
    c AS (SELECT record_id, CAST(least(length(replace(s, 'y', '')), length(replace(s, 'x', ''))) AS INTEGER) AS module_count, CAST(len(regexp_extract_all(s, 'x+y')) AS INTEGER) AS ordered_count FROM o)
    SELECT record_id, module_count, ordered_count, round(CASE WHEN module_count > 0 THEN ordered_count / module_count END, 6) AS in_order, ordered_count >= 1 AS passed FROM c"""
)
def ru6_fn29_fn30_modules(spark, d):
    hits = table(spark, d, "domain_hits").where("acc is not null").distinct()
    top = [r["acc"] for r in ranking.top_groups(hits, "acc", 2).collect()]
    return rounded(rules.module_architecture(hits, "record_id", F.col("orf") * 10000 + F.col("env_from"), "acc", top))


@query("SELECT record_id, count(bit_score) AS scored, count(*) FILTER (bit_score >= 80) AS over, CASE WHEN count(bit_score) > 0 THEN count(*) FILTER (bit_score >= 80) * 2 > count(bit_score) END AS passed FROM domain_hits GROUP BY 1")
def ru8_majority(spark, d):
    return rules.majority(table(spark, d, "domain_hits"), "record_id", "bit_score", 80)


@query("SELECT vec_id, CASE WHEN label < 6 THEN list_position(embedding[1:6], list_max(embedding[1:6])) - 1 = label END AS agrees FROM embeddings")
def ru9_probe_check(spark, d):
    m = F.map_from_entries(F.array(*[F.struct(F.lit(str(k)).alias("k"), F.get("embedding", F.lit(k)).alias("v")) for k in range(6)]))
    return table(spark, d, "embeddings").select("vec_id", rules.probe_check(m, F.col("label").cast("string")).alias("agrees"))


@query(
    """WITH a AS (SELECT record_id, CASE WHEN bool_or(error IS NULL) THEN CASE WHEN max(n_domains) FILTER (error IS NULL) > 0 THEN 'PASS' ELSE 'FAIL' END ELSE 'skipped' END AS a FROM domain_annotations GROUP BY 1), p AS (SELECT record_id, CASE WHEN count(DISTINCT acc) >= 2 THEN 'PASS' ELSE 'FAIL' END AS p FROM domain_hits GROUP BY 1),
    x AS (SELECT record_id, a, p, CASE WHEN sequence IS NOT NULL THEN CASE WHEN length(sequence) >= 500 THEN 'PASS' ELSE 'FAIL' END END AS f FROM mibig_records LEFT JOIN a USING (record_id) LEFT JOIN p USING (record_id))
    SELECT record_id, CASE WHEN a IS NOT NULL AND a <> 'skipped' THEN a WHEN p IS NOT NULL THEN p WHEN f IS NOT NULL THEN f ELSE 'skipped' END AS verdict, CASE WHEN a IS NOT NULL AND a <> 'skipped' THEN 'annotation' WHEN p IS NOT NULL THEN 'hits_proxy' WHEN f IS NOT NULL THEN 'length_floor' ELSE 'none' END AS source FROM x"""
)
def ru10_ru13_derived(spark, d):
    ok = F.col("error").isNull()
    ann = table(spark, d, "domain_annotations").groupBy("record_id").agg(F.when(F.bool_or(ok), F.when(F.max(F.when(ok, F.col("n_domains"))) > 0, "PASS").otherwise("FAIL")).otherwise("skipped").alias("a"))
    hits = table(spark, d, "domain_hits").groupBy("record_id").agg(F.when(F.countDistinct("acc") >= 2, "PASS").otherwise("FAIL").alias("p"))
    floor = F.when(F.col("sequence").isNotNull(), F.when(F.length("sequence") >= 500, "PASS").otherwise("FAIL"))
    rows = _records(spark, d).select("record_id", floor.alias("f")).join(ann, "record_id", "left").join(hits, "record_id", "left")
    v, s = rules.derived(F.col("a"), F.col("p"), F.col("f"), ("annotation", "hits_proxy", "length_floor"))
    return rows.select("record_id", v.alias("verdict"), s.alias("source"))


@query(
    """WITH b AS (SELECT avg(l_extendedprice) AS m, avg(l_quantity) AS l FROM lineitem WHERE l_linenumber = 1), g AS (SELECT l_linenumber, avg(l_extendedprice) AS mean, avg(l_extendedprice) - 1.645 * stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice)) AS low, avg(l_quantity) AS n FROM lineitem GROUP BY 1)
    SELECT l_linenumber, round(mean, 4) AS mean, round(low, 4) AS low, round(n / l, 4) AS length_ratio, low > m AND abs(n / l - 1) <= 0.1 AS usable FROM g CROSS JOIN b"""
)
def ru14_usable_dose(spark, d):
    return rounded(rules.usable_dose(table(spark, d, "lineitem"), "l_linenumber", "l_extendedprice", "l_quantity", 1), 4)


# -- statistics --------------------------------------------------------------------------------------------------------


def _choose(n: str, k: str) -> str:
    return f"exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) - {n} * ln(2))"


@query(
    f"""WITH c AS (SELECT acc, count(*) FILTER (bit_score > 60) AS wins, count(*) FILTER (bit_score < 60) AS losses, count(*) FILTER (bit_score = 60) AS ties FROM domain_hits WHERE bit_score IS NOT NULL GROUP BY 1)
    SELECT acc, wins, losses, ties, round(1e-9 + CASE WHEN wins + losses = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda i: {_choose('(wins + losses)', 'i')}))) END, 6) AS p FROM c"""
)
def st1_sign_test(spark, d):
    rows = table(spark, d, "domain_hits").where("bit_score is not null").withColumn("diff", F.col("bit_score") - 60)
    return rounded(stats.sign_test(rows, ["acc"], "diff").withColumn("p", F.col("p") + 1e-9))


@query(
    f"""WITH c AS (SELECT acc, count(*) FILTER (bit_score > 60) AS wins, count(*) FILTER (bit_score < 60) AS losses, count(*) FILTER (bit_score = 60) AS ties FROM domain_hits WHERE bit_score IS NOT NULL GROUP BY 1)
    SELECT acc, wins, losses, ties, round(1e-9 + CASE WHEN wins + losses = 0 THEN 1 ELSE least(1, list_sum(list_transform(range(wins, wins + losses + 1), lambda i: {_choose('(wins + losses)', 'i')}))) END, 6) AS p FROM c"""
)
def st2_one_sided(spark, d):
    rows = table(spark, d, "domain_hits").where("bit_score is not null").withColumn("diff", F.col("bit_score") - 60)
    return rounded(stats.sign_test(rows, ["acc"], "diff", one_sided=True).withColumn("p", F.col("p") + 1e-9))


@query(
    """WITH c AS (SELECT acc, count(*) FILTER (strand > 0) AS k, count(*) AS n FROM domain_hits GROUP BY 1)
    SELECT acc, round(greatest(0, (k / n + 1.96 * 1.96 / (2 * n) ) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) AS low,
    round(least(1, (k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) AS high FROM c"""
)
def st3_wilson(spark, d):
    c = table(spark, d, "domain_hits").groupBy("acc").agg(F.count_if(F.col("strand") > 0).alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rounded(c.select("acc", low.alias("low"), high.alias("high")))


@query(
    """WITH c AS (SELECT acc, count(*) FILTER (strand > 0 AND bit_score > 60) AS a, count(*) FILTER (strand > 0 AND NOT bit_score > 60) AS b, count(*) FILTER (NOT strand > 0 AND bit_score > 60) AS c, count(*) FILTER (NOT strand > 0 AND NOT bit_score > 60) AS d FROM domain_hits WHERE strand IS NOT NULL AND bit_score IS NOT NULL GROUP BY 1),
    m AS (SELECT *, a + b AS r, a + c AS s, a + b + c + d AS n FROM c), f AS (SELECT *, list_transform(range(greatest(0, r + s - n), least(r, s) + 1), lambda x: lgamma(r + 1) - lgamma(x + 1) - lgamma(r - x + 1) + lgamma(n - r + 1) - lgamma(s - x + 1) - lgamma(n - r - s + x + 1) - lgamma(n + 1) + lgamma(s + 1) + lgamma(n - s + 1)) AS l FROM m)
    SELECT acc, a, b, c, d, round(1e-9 + least(1, list_sum(list_transform(list_filter(l, lambda x: x <= l[a - greatest(0, r + s - n) + 1] + 1e-9), lambda x: exp(x)))), 5) AS p FROM f"""
)
def st4_fisher(spark, d):
    rows = table(spark, d, "domain_hits")
    return rounded(stats.fisher_test(rows, ["acc"], F.col("strand") > 0, F.col("bit_score") > 60).withColumn("p", F.col("p") + 1e-9), 5)


@query(
    """WITH x AS (SELECT l_linenumber AS g, l_discount AS v, l_returnflag = 'R' AS f FROM lineitem), r AS (SELECT g, v, f, rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2.0 AS r FROM x)
    SELECT g AS l_linenumber, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, sum(r) FILTER (f) - count(*) FILTER (f) * (count(*) FILTER (f) + 1) / 2.0 AS u, round((sum(r) FILTER (f) - count(*) FILTER (f) * (count(*) FILTER (f) + 1) / 2.0) / (count(*) FILTER (f) * count(*) FILTER (NOT f)), 6) AS effect FROM r GROUP BY 1"""
)
def st5_mann_whitney(spark, d):
    return rounded(stats.mann_whitney(table(spark, d, "lineitem"), ["l_linenumber"], "l_discount", F.col("l_returnflag") == "R")).drop("p")


@query(
    """WITH x AS (SELECT event_type AS g, round(value, 1) - 5 AS d FROM events), y AS (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2.0 AS r FROM (SELECT g, round(d, 1) AS d FROM x) WHERE d <> 0)
    SELECT g AS event_type, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus FROM y GROUP BY 1"""
)
def st6_wilcoxon(spark, d):
    rows = table(spark, d, "events").withColumn("d", F.round(F.round("value", 1) - 5, 1))
    return rounded(stats.wilcoxon(rows, ["event_type"], "d")).drop("p")


@query(
    """WITH o AS (SELECT max(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'A'), c AS (SELECT l_extendedprice AS x FROM lineitem WHERE l_returnflag = 'R')
    SELECT v AS observed, count(x) AS controls, round((count(*) FILTER (x >= v) + 1) / (count(*) + 1), 8) AS p, round((v - avg(x)) / stddev_samp(x), 6) AS z, count(*) FILTER (x >= v) = 0 AS at_floor FROM c CROSS JOIN o GROUP BY v"""
)
def st8_permutation(spark, d):
    return rounded(stats.permutation(table(spark, d, "lineitem"), [], "l_extendedprice", "l_returnflag", "A", "R"), 8).withColumn("z", F.round("z", 6))


@query("SELECT l_linenumber, count(l_discount) AS n, round(avg(l_discount), 8) AS mean, round(stddev_pop(l_discount), 8) AS sd, round(avg(l_discount) / (stddev_pop(l_discount) / sqrt(count(l_discount))), 4) AS t FROM lineitem GROUP BY 1")
def st9_paired_t(spark, d):
    return rounded(stats.paired_t(table(spark, d, "lineitem"), ["l_linenumber"], "l_discount"), 8).withColumn("t", F.round("t", 4))


@query()
def st10_st11_probe(spark, d):
    rows = table(spark, d, "embeddings").withColumn("fold", F.pmod(F.col("vec_id"), F.lit(3)).cast("int"))
    return rounded(stats.probe(rows, "embedding", "label", "fold"), 4)


@query(
    """WITH x AS (SELECT label, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS pr, CAST(list_max(embedding[1:10]) AS DOUBLE) AS c FROM embeddings), n AS (SELECT label, pr, count(*) AS k, sum(c) AS s FROM x GROUP BY 1, 2)
    SELECT label, CAST(sum(k) AS BIGINT) AS n, round(coalesce(sum(k) FILTER (label = pr), 0) / sum(k), 6) AS hit_rate, round(sum(s) / sum(k), 6) AS mean_confidence, CASE WHEN label = 0 THEN arg_min(pr, (-k, pr)) END AS landed FROM n GROUP BY 1"""
)
def st12_calibration(spark, d):
    head = F.slice("embedding", 1, 10)
    rows = table(spark, d, "embeddings").select("label", (F.array_position(head, F.array_max(head)) - 1).alias("pr"), F.array_max(head).cast("double").alias("c"))
    return rounded(stats.calibration(rows, "label", "pr", "c", 0))


@query(
    f"""WITH x AS (SELECT l_orderkey AS p, l_linenumber AS a, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2), y AS (SELECT *, count(*) OVER (PARTITION BY p) - 1 AS n, (sum(v) OVER (PARTITION BY p) - v) / nullif(count(*) OVER (PARTITION BY p) - 1, 0) AS o FROM x), t AS (SELECT a, count(*) AS n, avg(v - o) AS mean, median(v - o) AS median, count(*) FILTER (round(v - o, 12) > 0) AS wins, count(*) FILTER (round(v - o, 12) < 0) AS losses FROM y WHERE n >= 2 GROUP BY 1 HAVING count(*) >= 3),
    q AS (SELECT *, CASE WHEN wins + losses = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda i: {_choose('(wins + losses)', 'i')}))) END AS p FROM t)
    SELECT a AS l_linenumber, n, round(mean, 8) AS mean, round(median, 8) AS median, round(p, 5) AS p, round(least(1, p * count(*) OVER ()), 5) AS p_adjusted FROM q"""
)
def st13_against_others(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.avg("l_discount").alias("v"))
    found = rounded(stats.against_others(rows, "l_orderkey", "l_linenumber", "v"), 8)
    return found.withColumn("p", F.round("p", 5)).withColumn("p_adjusted", F.round("p_adjusted", 5))


# -- vectors -----------------------------------------------------------------------------------------------------------

def _axes(source: str) -> str:
    """SQL of the contrast axes (label, axis) of a table with label and embedding."""
    return f"""(WITH m AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM {source}) GROUP BY 1, 2),
    c AS (SELECT label, i, m - (sum(m) OVER (PARTITION BY i) - m) / (count(*) OVER (PARTITION BY i) - 1) AS c FROM m), n AS (SELECT label, sqrt(sum(c * c)) AS n FROM c GROUP BY 1) SELECT label, list(c / n ORDER BY i) AS axis FROM c JOIN n USING (label) GROUP BY 1)"""


_HALF = "CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 4) AS UBIGINT) % 2"

_MEANS = "(SELECT label, i, avg(x) AS m, count(*) AS n FROM (SELECT label, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2)"


@query(
    f"""WITH c AS (SELECT label, i, m - (sum(m) OVER (PARTITION BY i) - m) / (count(*) OVER (PARTITION BY i) - 1) AS c FROM {_MEANS}), n AS (SELECT label, sqrt(sum(c * c)) AS n FROM c GROUP BY 1)
    SELECT label, list(round(c / n, 6) ORDER BY i) AS axis FROM c JOIN n USING (label) GROUP BY 1"""
)
def ve1_contrast_axes(spark, d):
    return vectors.contrast_axes(table(spark, d, "embeddings"), "label", "embedding").select("label", F.transform("axis", lambda x: F.round(x, 6)).alias("axis"))


@query(f"SELECT label, list(round(c, 6) ORDER BY i) AS axis FROM (SELECT label, i, m - sum(m * n) OVER (PARTITION BY i) / sum(n) OVER (PARTITION BY i) AS c FROM {_MEANS}) GROUP BY 1")
def ve2_global_axes(spark, d):
    return vectors.global_axes(table(spark, d, "embeddings"), "label", "embedding").select("label", F.transform("axis", lambda x: F.round(x, 6)).alias("axis"))


@query()
def ve3_first_component(spark, d):
    _, share, rows = vectors.first_component(table(spark, d, "embeddings"), "vec_id", "embedding")
    return rounded(rows.agg(F.abs(F.corr("coordinate", "norm")).alias("norm_correlation"), F.stddev_pop("coordinate").alias("sd")).withColumn("variance_share", F.lit(share)), 4)


@query(
    f"""WITH a AS {_axes(f'(SELECT * FROM embeddings WHERE {_HALF} = 0)')}, b AS {_axes(f'(SELECT * FROM embeddings WHERE {_HALF} = 1)')}, s AS (SELECT label, list_cosine_similarity(a.axis, b.axis) AS stability FROM a JOIN b USING (label)),
    c AS (SELECT a.label, e.label = a.label AS own, list_dot_product(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), axis) AS c FROM embeddings e CROSS JOIN a WHERE {_HALF} = 1), r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY c) + (count(*) OVER (PARTITION BY label, c) - 1) / 2.0 AS r FROM c),
    u AS (SELECT label, (sum(r) FILTER (own) - count(*) FILTER (own) * (count(*) FILTER (own) + 1) / 2.0) / (count(*) FILTER (own) * count(*) FILTER (NOT own)) AS auc FROM r GROUP BY 1) SELECT label, round(stability, 4) AS stability, round(auc, 4) AS auc FROM s JOIN u USING (label)"""
)
def ve4_split_half(spark, d):
    rows = table(spark, d, "embeddings")
    return rounded(vectors.split_half(rows, "vec_id", "label", "embedding").join(vectors.held_out_auc(rows, "vec_id", "label", "embedding"), "label"), 4)


def _dealt(k: int) -> str:
    rows = "SELECT vec_id, embedding, row_number() OVER (ORDER BY md5('rows|' || CAST(vec_id AS VARCHAR)), vec_id) AS n FROM embeddings"
    labels = f"SELECT label, row_number() OVER (ORDER BY md5('labels-{k}|' || CAST(vec_id AS VARCHAR)), vec_id) AS n FROM embeddings"
    dealt = f"(SELECT vec_id, embedding, label FROM ({rows}) JOIN ({labels}) USING (n))"
    halves = [_axes(f"(SELECT * FROM {dealt} WHERE {_HALF} = {h})") for h in (0, 1)]
    return f"SELECT {k} AS round, avg(list_cosine_similarity(a.axis, b.axis)) AS stability FROM {halves[0]} a JOIN {halves[1]} b USING (label)"


_BAND = " UNION ALL ".join(map(_dealt, range(3)))


@query(f"SELECT round, round(stability, 4) AS stability FROM ({_BAND})")
def ve5_null_band(spark, d):
    return rounded(vectors.null_band(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 3), 4)


@query(f"SELECT round(avg(stability), 4) AS mean, round(quantile_cont(stability, 0.95), 4) AS p95, count(*) AS rounds FROM ({_BAND})")
def ve5_band(spark, d):
    return rounded(vectors.band(vectors.null_band(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 3)), 4)


@query(
    f"""WITH c AS (SELECT label, i, m - (sum(m) OVER (PARTITION BY i) - m) / (count(*) OVER (PARTITION BY i) - 1) AS c FROM {_MEANS}), n AS (SELECT label, sqrt(sum(c * c)) AS n FROM c GROUP BY 1), a AS (SELECT label AS axis_label, list(c / n ORDER BY i) AS axis FROM c JOIN n USING (label) GROUP BY 1),
    k AS (SELECT vec_id, label, axis_label, list_dot_product(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), axis) AS c FROM embeddings CROSS JOIN a)
    SELECT vec_id, label, axis_label, round(c, 6) AS coordinate, round((c - avg(c) OVER (PARTITION BY axis_label)) / stddev_pop(c) OVER (PARTITION BY axis_label), 6) AS z FROM k"""
)
def ve6_coordinates(spark, d):
    rows = table(spark, d, "embeddings")
    return rounded(vectors.coordinates(rows, "vec_id", "label", "embedding", vectors.contrast_axes(rows, "label", "embedding")))


@query("WITH x AS (SELECT label, i, stddev_samp(x) AS s, avg(x) AS m FROM (SELECT label, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2) SELECT label, list(round(m / s, 5) ORDER BY i) AS direction FROM x GROUP BY 1")
def ve7_logit_direction(spark, d):
    cells = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_samp(F.col("x").cast("double")).alias("s"))
    lists = cells.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("v"))
    out = vectors.logit_direction(F.transform("v", lambda x: x["m"]), F.transform("v", lambda x: x["s"]))
    return lists.select("label", F.transform(out, lambda x: F.round(x, 5)).alias("direction"))


@query(
    f"""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e, axis, list_dot_product(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), axis) AS d FROM embeddings JOIN {_axes('embeddings')} USING (label))
    SELECT vec_id, round(d, 5) AS before, round(abs(list_dot_product(list_transform(range(1, len(e) + 1), lambda i: e[i] - d * axis[i]), axis)), 5) AS after, round(list_dot_product(list_transform(range(1, len(e) + 1), lambda i: e[i] + (1 - d) * axis[i]), axis), 5) AS moved FROM x"""
)
def ve8_ablated(spark, d):
    rows = table(spark, d, "embeddings")
    axes = vectors.contrast_axes(rows, "label", "embedding")
    both = rows.join(axes, "label").withColumn("kept", vectors.without_axis(F.col("embedding"), F.col("axis"))).withColumn("moved", vectors.at_coordinate(F.col("embedding"), F.col("axis"), F.lit(1.0)))
    return rounded(both.select("vec_id", similarity.dot(F.col("embedding"), F.col("axis")).alias("before"), F.abs(similarity.dot(F.col("kept"), F.col("axis"))).alias("after"), similarity.dot(F.col("moved"), F.col("axis")).alias("moved")), 5)
