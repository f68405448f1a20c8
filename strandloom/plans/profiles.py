"""Queries of taxon profiles, detection and check drivers, parsed records, invariants of samples, and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import names
from strandloom.operators import aggregates, rules, sampling, stats, vectors
from strandloom.plans.catalogue import query, rounded, table


def _records(spark, d):
    return table(spark, d, "mibig_records")


@query(
    """WITH s AS (SELECT coalesce(upper(trim(compound_class)), 'UNKNOWN') AS cls, upper(sequence) AS s, row_number() OVER (PARTITION BY coalesce(upper(trim(compound_class)), 'UNKNOWN') ORDER BY record_id) AS r FROM mibig_records WHERE sequence IS NOT NULL),
    k AS (SELECT cls, 'codon' AS kind, unnest(list_transform(range(1, greatest(length(s) - 1, 1), 3), lambda i: substring(s, i, 3))) AS item FROM s WHERE r <= 50
      UNION ALL SELECT cls, 'base', unnest(list_transform(range(1, length(s) + 1), lambda i: s[i])) FROM s WHERE r <= 50
      UNION ALL SELECT cls, 'pair', unnest(list_transform(range(1, greatest(length(s), 1)), lambda i: substring(s, i, 2))) FROM s WHERE r <= 50)
    SELECT cls, kind, item, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY cls, kind), 6) AS share FROM k GROUP BY 1, 2, 3"""
)
def ag8_taxon_profiles(spark, d):
    rows = _records(spark, d).withColumn("cls", F.coalesce(F.upper(F.trim("compound_class")), F.lit("UNKNOWN")))
    return rounded(aggregates.text_profile(rows, "cls", "sequence", "record_id", 50))


@query(
    """WITH s AS (SELECT upper(sequence) AS s FROM mibig_records WHERE sequence IS NOT NULL), k AS (SELECT 'codon' AS kind, unnest(list_transform(range(1, greatest(length(s) - 1, 1), 3), lambda i: substring(s, i, 3))) AS item FROM s
      UNION ALL SELECT 'base', unnest(list_transform(range(1, length(s) + 1), lambda i: s[i])) FROM s UNION ALL SELECT 'pair', unnest(list_transform(range(1, greatest(length(s), 1)), lambda i: substring(s, i, 2))) FROM s)
    SELECT kind, item, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY kind), 6) AS share FROM k GROUP BY 1, 2"""
)
def ag9_whole_profile(spark, d):
    return rounded(aggregates.text_profile(_records(spark, d).withColumn("all", F.lit("all")), "all", "sequence", "record_id").drop("all"))


@query(
    """WITH m AS (SELECT lower(trim(product)) AS p, min(compound_class) AS c FROM class_map WHERE product IS NOT NULL AND compound_class IS NOT NULL GROUP BY 1), x AS (SELECT row_id, compound_class, unnest(antismash_products) AS product FROM core_records),
    y AS (SELECT row_id, m.c, x.product FROM x LEFT JOIN m ON m.p = lower(trim(x.product)) WHERE x.product IS NOT NULL), g AS (SELECT row_id, list_sort(list(DISTINCT c) FILTER (c IS NOT NULL)) AS found, list_sort(list(DISTINCT product) FILTER (c IS NULL)) AS unmapped FROM y GROUP BY 1)
    SELECT r.row_id, g.row_id IS NOT NULL AS detected, coalesce(found, []) AS found, coalesce(unmapped, []) AS unmapped,
    CASE WHEN len(coalesce(found, [])) > 0 THEN list_contains(found, compound_class) OR (compound_class = 'PKS_NRPS_HYBRID' AND list_contains(found, 'PKS') AND list_contains(found, 'NRPS')) WHEN g.row_id IS NULL THEN false END AS matched FROM core_records r LEFT JOIN g USING (row_id)"""
)
def ru2_cluster_detection(spark, d):
    return rules.cluster_detection(table(spark, d, "core_records"), "row_id", "compound_class", "antismash_products", table(spark, d, "class_map"), "product", "compound_class", {"PKS_NRPS_HYBRID": ["PKS", "NRPS"]})


@query(
    """SELECT record_id, CASE WHEN sequence IS NULL THEN 'skipped' WHEN length(sequence) >= 500 THEN 'PASS' ELSE 'FAIL' END AS length_floor, CASE WHEN compound_class IS NULL THEN 'skipped' WHEN compound_class = upper(compound_class) THEN 'PASS' ELSE 'FAIL' END AS spelling, 'skipped' AS tag,
    list_filter(['length_floor', 'spelling'], lambda x: (x = 'length_floor' AND length(sequence) < 500) OR (x = 'spelling' AND compound_class <> upper(compound_class))) AS failed FROM mibig_records"""
)
def ru13_check_driver(spark, d):
    checks = {
        "length_floor": (F.length("sequence") >= 500, F.col("sequence").isNull()),
        "spelling": (F.col("compound_class") == F.upper("compound_class"), F.col("compound_class").isNull()),
        "tag": (F.col("taxonomic_tag").contains("s__"), F.col("taxonomic_tag").isNull()),
    }
    return rules.run_checks(_records(spark, d), checks, skip=["tag"]).select("record_id", "length_floor", "spelling", "tag", "failed")


@query("SELECT record_id, true AS probe_skipped FROM mibig_records")
def ru12_missing_resource(spark, d):
    return rules.require_resource(_records(spark, d).select("record_id"), False, False, "probe")


@query("""SELECT record_id, CASE WHEN trim(accession) NOT IN ('', '.') THEN trim(accession) END AS organism, CAST(record_id AS INTEGER) AS taxon_id, ['Bacteria', trim(coalesce(source, 'none'))] AS lineage,
    CASE WHEN trim(accession) NOT IN ('', '.') THEN '|D__BACTERIA;P__' || trim(regexp_replace(upper(coalesce(source, 'none')), '[^A-Z0-9]+', '_', 'g'), '_') || ';S__' || trim(regexp_replace(upper(trim(accession)), '[^A-Z0-9]+', '_', 'g'), '_') || '|' ELSE '|TAX:UNKNOWN|' END AS tag FROM mibig_records""")
def fn17_fn18_fn19_parsed_organism(spark, d):
    rows = _records(spark, d)
    text = F.concat(F.lit("  ORGANISM  "), F.coalesce("accession", F.lit("")), F.lit("\n            Bacteria; "), F.coalesce("source", F.lit("none")), F.lit('.\nFEATURES\n                     /db_xref="taxon:'), F.col("record_id").cast("string"), F.lit('"\n'))
    return rows.select("record_id", names.organism(text).alias("organism"), names.taxon_id(text).alias("taxon_id"), names.organism_lineage(text).alias("lineage"), names.positional_tag(text).alias("tag"))


@query("SELECT record_id, length(sequence) AS n, " + ", ".join(f"length(sequence) - length(replace(sequence, '{c}', '')) AS n_{c.lower()}" for c in "ACGT") + ", CAST(length(sequence) // 3 * 3 AS BIGINT) AS in_codons FROM mibig_records")
def sp15_kept_letters(spark, d):
    shuffled = sampling.shuffled(F.col("sequence"), F.col("record_id"), "1")
    rows = _records(spark, d).select("record_id", shuffled.alias("s"), F.length(sampling.shuffled(F.col("sequence"), F.col("record_id"), "1", 3)).cast("bigint").alias("in_codons"))
    n = F.length("s").cast("bigint")
    return rows.select("record_id", n.alias("n"), *[(n - F.length(F.replace("s", F.lit(c), F.lit("")))).alias(f"n_{c.lower()}") for c in "ACGT"], "in_codons")


@query("SELECT count(*) AS rows, count(DISTINCT CASE WHEN length(taxonomic_tag) > 0 THEN 'g::' || taxonomic_tag WHEN length(accession) > 0 THEN 'a::' || accession ELSE 'h::' || md5(coalesce(sequence, '')) END) AS groups FROM mibig_records")
def sp5_sp3_disjoint(spark, d):
    """The greedy split by groups, asserted to tear none; fails if it does."""
    rows = _records(spark, d).withColumn("g", names.group_key(F.col("taxonomic_tag"), F.col("accession"), F.col("sequence")))
    plan = sampling.assign_groups(rows, "g", "compound_class", {"train": 0.8, "val": 0.1, "test": 0.1})
    sound = sampling.require_disjoint(sampling.routed(rows.select("record_id", "g"), plan, "g"), "g", "split")
    return sound.agg(F.count("*").alias("rows"), F.countDistinct("g").alias("groups"))


@query()
def st10_st11_probe_control(spark, d):
    rows = table(spark, d, "embeddings").withColumn("fold", F.pmod(F.col("vec_id"), F.lit(3)).cast("int"))
    return rounded(stats.probe_summary(rows, "vec_id", ["embedding"], "label", "fold"), 4)


@query()
def ve4_admissible(spark, d):
    return rounded(vectors.admissible(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 5), 4)


@query(
    """WITH k AS (SELECT record_id, upper(sequence) AS s, unnest(range(1, greatest(length(sequence) - 1, 1), 3)) AS i FROM mibig_records), c AS (SELECT record_id, i = max(i) OVER (PARTITION BY record_id) AS last, substring(s, i, 2) AS two, substring(s, i + 2, 1) AS b FROM k WHERE i + 2 <= length(s)),
    m AS (SELECT record_id, last, CASE two WHEN 'TA' THEN 0.5::DOUBLE WHEN 'TG' THEN 0.25::DOUBLE ELSE 0 END AS m, two = 'TA' AND b IN ('A', 'G') OR two = 'TG' AND b = 'A' AS stop FROM c)
    SELECT record_id, count(*) FILTER (NOT (last AND stop)) AS positions, round(coalesce(sum(m) FILTER (NOT (last AND stop)), 0) / nullif(count(*) FILTER (NOT (last AND stop)), 0), 6) AS stop_mass FROM m GROUP BY 1"""
)
def fn37_stop_mass(spark, d):
    rows = _records(spark, d).where("sequence is not null").select("record_id", F.upper("sequence").alias("s"))
    places = rows.select("record_id", F.posexplode(F.split("s", "")).alias("place", "base")).withColumns({"a": F.lit(0.25), "g": F.lit(0.25)})
    return rounded(aggregates.stop_mass(places, "record_id", "place", "base", "a", "g"))
