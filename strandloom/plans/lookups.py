"""Projection, filter, join and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import names, sequence
from strandloom.operators import joins, ranking, records
from strandloom.plans.catalogue import query, rounded, table


def _rank_sql(letter: str) -> str:
    return f"nullif(trim(regexp_extract(taxonomic_tag, '(?i)(?:^|[;|])\\s*{letter}__([^;|]*)', 1)), '') AS rank_{dict(d='domain', p='phylum', c='class', o='order', f='family', g='genus', s='species')[letter]}"


@query(f"SELECT record_id, source, length(sequence) AS length, round(CASE WHEN sequence = '' THEN 0 ELSE coalesce(length(regexp_replace(upper(sequence), '[^GC]', '', 'g')) / nullif(length(regexp_replace(upper(sequence), '[^ACGT]', '', 'g')), 0), CASE WHEN sequence IS NOT NULL THEN 0 END) END, 6) AS gc, round(CASE WHEN sequence = '' THEN 0 ELSE 1 - length(regexp_replace(upper(sequence), '[^ACGT]', '', 'g')) / length(sequence) END, 6) AS n_frac, {', '.join(map(_rank_sql, 'dpcofgs'))} FROM mibig_records")
def prj1_fn22_summary_row(spark, d):
    return rounded(records.summary_row(table(spark, d, "mibig_records"), "sequence", ["record_id", "source"], "taxonomic_tag"))


@query("SELECT record_id, '|COMPOUND_CLASS:' || coalesce(compound_class, 'UNKNOWN') || '|' || coalesce(taxonomic_tag, '') AS prefix FROM mibig_records")
def prj2_prefix(spark, d):
    return table(spark, d, "mibig_records").select("record_id", records.training_prefix(F.col("compound_class"), F.col("taxonomic_tag")).alias("prefix"))


@query("SELECT record_id, left(training_text, length(training_text) - length(sequence)) AS prefix FROM mibig_records WHERE sequence IS NOT NULL AND training_text IS NOT NULL AND suffix(training_text, sequence)")
def prj3_prj4_recovered_prefix(spark, d):
    rows = table(spark, d, "mibig_records").where("sequence is not null and training_text is not null and endswith(training_text, sequence)")
    plain = records.training_prefix(F.col("compound_class"), F.col("taxonomic_tag"))
    return rows.select("record_id", records.recovered_prefix(F.col("training_text"), plain, F.col("sequence")).alias("prefix"))


@query("SELECT record_id, CASE WHEN length(sequence) > 2000 THEN substring(sequence, length(sequence) // 2 - 1000 + 1, 2000) ELSE sequence END AS core FROM mibig_records")
def prj5_centre(spark, d):
    return table(spark, d, "mibig_records").select("record_id", sequence.centre(F.col("sequence"), 2000).alias("core"))


@query("SELECT record_id, substring(sequence, 1, 600) AS head, substring(sequence, CAST(floor(length(sequence) * 0.25) AS BIGINT) + 1, CAST(floor(length(sequence) * 0.5) AS BIGINT)) AS middle FROM mibig_records")
def prj6_prj10_windows(spark, d):
    s = F.col("sequence")
    return table(spark, d, "mibig_records").select("record_id", F.substring(s, 1, 600).alias("head"), sequence.fraction(s, 0.5, 0.25).alias("middle"))


@query(
    """SELECT record_id, context, substring(sequence, greatest(400 - context, 0) + 1, 400 - greatest(400 - context, 0)) AS "left", substring(sequence, 401, 200) AS target
    FROM mibig_records CROSS JOIN (SELECT unnest([0, 100, 400, 1000]) AS context)"""
)
def prj7_contexts(spark, d):
    rows = table(spark, d, "mibig_records").select("record_id", "sequence")
    return records.contexts(rows, "sequence", 400, 200, [0, 100, 400, 1000]).select("record_id", "context", "left", "target")


@query("SELECT record_id, lpad(accession, CAST(max(length(accession)) OVER (PARTITION BY source) AS INTEGER), ' ') AS padded FROM mibig_records")
def prj8_padded(spark, d):
    return records.padded(table(spark, d, "mibig_records").select("record_id", "source", "accession"), "source", "accession").select("record_id", "padded")


@query(
    """WITH x AS (SELECT doc_id, text, split_part(text, '|END|', 1) AS head FROM documents)
    SELECT doc_id, regexp_extract(upper(head), '^[ACGTN]*') AS kept, contains(text, '|END|') AS ended, length(regexp_extract(upper(head), '^[ACGTN]*')) < length(head) AS cut FROM x"""
)
def prj9_cleaned(spark, d):
    kept, ended, cut = sequence.cleaned(F.col("text"))
    return table(spark, d, "documents").select("doc_id", kept.alias("kept"), ended.alias("ended"), cut.alias("cut"))


@query("SELECT row_id, coalesce(length(sequence) >= 500 AND NOT coalesce(contig_edge, false) AND NOT regexp_matches(upper(sequence), '[^ACGT]'), false) AS good FROM core_records")
def flt1_quality(spark, d):
    return table(spark, d, "core_records").select("row_id", records.good_quality(F.col("sequence"), F.col("contig_edge"), 500).alias("good"))


@query("SELECT record_id FROM mibig_records WHERE length(sequence) >= 500 AND length(sequence) <= 10000")
def flt2_flt3_length(spark, d):
    return table(spark, d, "mibig_records").where((F.length("sequence") >= 500) & (F.length("sequence") <= 10000)).select("record_id")


@query("SELECT record_id, s.acc AS acc, s.s AS s, s.e AS e FROM (SELECT record_id, unnest(spans) AS s FROM domain_annotations) WHERE s.is_class")
def flt4_feature_filter(spark, d):
    spans = table(spark, d, "domain_annotations").select("record_id", F.explode("spans").alias("x"))
    return spans.where("x.is_class").select("record_id", "x.acc", "x.s", "x.e")


@query("SELECT record_id, coalesce(length(regexp_replace(upper(sequence), '[^N]', '', 'g')) / nullif(length(sequence), 0) <= 0.01, false) AS clean FROM mibig_records")
def flt5_n_fraction(spark, d):
    s = F.col("sequence")
    share = F.when(F.length(s) > 0, sequence.occurrences(s, "Nn") / F.length(s))
    return table(spark, d, "mibig_records").select("record_id", F.coalesce(share <= 0.01, F.lit(False)).alias("clean"))


_OK = "coalesce(length(sequence) >= 1000 AND length(regexp_replace(upper(sequence), '[^ACGT]', '', 'g')) >= 0.8 * length(sequence), false)"


@query(f"SELECT record_id, NOT {_OK} AS input_rejected, CASE WHEN {_OK} THEN compound_class IS NOT NULL ELSE false END AS detected FROM mibig_records")
def flt6_preflight(spark, d):
    rows = table(spark, d, "mibig_records").withColumn("detected", F.col("compound_class").isNotNull())
    return records.with_rejections(rows, "sequence", "detected").select("record_id", "input_rejected", "detected")


@query("SELECT record_id FROM mibig_records WHERE upper(trim(compound_class)) IN ('TERPENE', 'PKS') AND upper(trim(regexp_extract(taxonomic_tag, '(?i)(?:^|[;|])\\s*p__([^;|]*)', 1))) = 'ROMENEOTA'")
def flt7_class_and_phylum(spark, d):
    rows = table(spark, d, "mibig_records")
    return rows.where(F.upper(F.trim("compound_class")).isin("TERPENE", "PKS") & (F.upper(names.tag_rank(F.col("taxonomic_tag"), "p")) == "ROMENEOTA")).select("record_id")


@query("SELECT record_id, length(sequence) <= 8192 - (length(training_text) - length(sequence)) - 5 AS fits FROM mibig_records WHERE sequence IS NOT NULL AND training_text IS NOT NULL")
def flt8_flt9_whole_fits(spark, d):
    rows = table(spark, d, "mibig_records").where("sequence is not null and training_text is not null")
    n = F.length("sequence")
    return rows.select("record_id", records.whole_fits(n, F.length("training_text") - n, 8192, 5).alias("fits"))


@query("SELECT count(*) FILTER (coalesce(source = 'legacy_dump', false)) AS legacy, count(*) AS n FROM mibig_records")
def flt10_legacy_report(spark, d):
    rows = table(spark, d, "mibig_records").withColumn("legacy", F.col("source") == "legacy_dump")
    return records.without_legacy(rows, "legacy")[1]


@query("SELECT record_id, count(DISTINCT acc) >= 2 AS proxy FROM domain_hits WHERE acc IN (SELECT acc FROM domain_models WHERE compound_class IS NOT NULL) GROUP BY record_id")
def flt11_two_members(spark, d):
    ours = table(spark, d, "domain_models").where("compound_class is not null and acc is not null")
    hits = joins.only(table(spark, d, "domain_hits"), ours, "acc")
    return hits.groupBy("record_id").agg((F.countDistinct("acc") >= 2).alias("proxy"))


@query("WITH s AS (SELECT DISTINCT user_id AS step FROM events) SELECT step FROM s WHERE (step % 5 = 0 OR step = (SELECT max(step) FROM s)) AND step NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def flt12_milestones(spark, d):
    events = table(spark, d, "events").withColumnRenamed("user_id", "step")
    return records.milestones(events, "step", 5, events.where("event_type = 'error'").select("step").distinct())


@query("WITH m AS (SELECT lower(trim(product)) AS k, min(compound_class) AS c FROM class_map GROUP BY 1) SELECT record_id, coalesce(c, 'OTHER') AS class FROM mibig_records LEFT JOIN m ON lower(trim(compound_class)) = k")
def jn1_lookup(spark, d):
    return joins.lookup(table(spark, d, "mibig_records").select("record_id", "compound_class"), "compound_class", table(spark, d, "class_map"), "product", "compound_class", "class", "OTHER").select("record_id", "class")


@query(
    """WITH m AS (SELECT lower(trim(product)) AS k, min(compound_class) AS c FROM class_map GROUP BY 1), j AS (SELECT row_id, regexp_split_to_array(lower(array_to_string(antismash_products, ',')), '[\\s,]+') AS p FROM core_records),
    e AS (SELECT row_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM j), f AS (SELECT row_id, c, min(i) AS i FROM e JOIN m ON k = p GROUP BY 1, 2),
    g AS (SELECT row_id, count(*) FILTER (c IN ('PKS', 'NRPS')) AS b, arg_min(c, i) FILTER (c <> 'OTHER') AS f FROM f GROUP BY 1)
    SELECT row_id, CASE WHEN b = 2 THEN 'PKS_NRPS_HYBRID' ELSE coalesce(f, 'OTHER') END AS class FROM core_records LEFT JOIN g USING (row_id)"""
)
def jn2_class_of_products(spark, d):
    return joins.class_of_products(table(spark, d, "core_records"), "row_id", "antismash_products", table(spark, d, "class_map"), "product", "compound_class")


@query(
    """WITH r AS (SELECT n_nationkey AS old, n_nationkey - 1 AS new FROM nation WHERE n_nationkey % 5 = 4) SELECT c_custkey, n_name AS name FROM customer LEFT JOIN r ON c_nationkey = old LEFT JOIN nation ON n_nationkey = coalesce(new, c_nationkey)"""
)
def jn3_redirected(spark, d):
    nation = table(spark, d, "nation")
    moved = nation.where("n_nationkey % 5 = 4").select(F.col("n_nationkey").alias("old"), (F.col("n_nationkey") - 1).alias("new"))
    return joins.redirected(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", moved, "old", "new", nation, "n_nationkey", "n_name", "name").select("c_custkey", "name")


@query(
    """WITH a AS (SELECT record_id, min(compound_class) AS c FROM domain_annotations WHERE error IS NULL GROUP BY 1), m AS (SELECT lower(trim(product)) AS k, min(compound_class) AS c FROM class_map GROUP BY 1)
    SELECT r.record_id, coalesce(a.c, m.c) AS class FROM mibig_records r LEFT JOIN a USING (record_id) LEFT JOIN m ON lower(trim(r.compound_class)) = k"""
)
def jn4_fallback_chain(spark, d):
    ann = table(spark, d, "domain_annotations").where("error is null").groupBy("record_id").agg(F.min("compound_class").alias("c"))
    words = table(spark, d, "class_map").groupBy(F.lower(F.trim("product")).alias("k")).agg(F.min("compound_class").alias("c"))
    rows = table(spark, d, "mibig_records").select("record_id", "compound_class")
    return joins.first_of(rows, [(ann, "record_id", "c", F.col("record_id")), (words, "k", "c", F.lower(F.trim("compound_class")))], "class").select("record_id", "class")


_RANKS = {"superkingdom": "domain", "domain": "domain", "phylum": "phylum", "class": "class", "order": "order", "family": "family", "genus": "genus", "species": "species"}


@query(
    """WITH RECURSIVE t AS (SELECT CAST(taxid AS BIGINT) AS n, min(CAST(parent AS BIGINT)) AS p, min(trim(tax_rank)) AS r, min(trim(name)) AS name FROM taxa_nodes WHERE taxid IS NOT NULL GROUP BY 1),
    w AS (SELECT n AS node, n AS a, 0 AS dist, [n] AS path FROM t UNION ALL SELECT node, t.p, dist + 1, list_append(path, t.p) FROM w JOIN t ON w.a = t.n WHERE t.p IS NOT NULL AND NOT list_contains(path, t.p)),
    j AS (SELECT node, dist, CASE WHEN r IN ('superkingdom', 'domain') THEN 'domain' ELSE r END AS r, name FROM w JOIN t ON w.a = t.n WHERE name <> '')
    SELECT node, """
    + ", ".join(f"arg_min(name, dist) FILTER (r = '{r}') AS \"{r}\"" for r in dict.fromkeys(_RANKS.values()))
    + " FROM j GROUP BY node"
)
def jn5_lineage(spark, d):
    return joins.lineage(table(spark, d, "taxa_nodes"), "taxid", "parent", "tax_rank", "name", _RANKS)


@query(
    """WITH n AS (SELECT lower(trim(name)) AS k, min(taxid) AS v FROM taxa_nodes WHERE name IS NOT NULL GROUP BY 1),
    s AS (SELECT record_id, lower(trim(replace(trim(regexp_extract(taxonomic_tag, '(?i)(?:^|[;|])\\s*s__([^;|]*)', 1)), '_', ' '))) AS q FROM mibig_records),
    w AS (SELECT record_id, q, regexp_split_to_array(q, '\\s+') AS w FROM s)
    SELECT record_id, coalesce(a.v, b.v, c.v) AS taxid FROM w LEFT JOIN n a ON a.k = q LEFT JOIN n b ON len(w) > 2 AND b.k = w[1] || ' ' || w[2] LEFT JOIN n c ON c.k = w[1]"""
)
def jn6_fuzzy_name(spark, d):
    rows = table(spark, d, "mibig_records").select("record_id", F.translate(names.tag_rank(F.col("taxonomic_tag"), "s"), "_", " ").alias("organism"))
    return joins.fuzzy_name(rows, "organism", table(spark, d, "taxa_nodes"), "name", "taxid", "taxid").select("record_id", "taxid")




@query("""WITH e AS (SELECT record_id AS k, max(class_domain_nt > 0) AS f FROM domain_annotations GROUP BY 1) SELECT count(*) FILTER (k IS NOT NULL) AS matched, count(*) FILTER (k IS NULL) AS missing FROM mibig_records LEFT JOIN e ON k = record_id""")
def jn7_flag_report(spark, d):
    flags = table(spark, d, "domain_annotations").select("record_id", (F.col("class_domain_nt") > 0).alias("flag"))
    return joins.enriched_with_flag(table(spark, d, "mibig_records").select("record_id"), "record_id", flags, "record_id", "flag")[1]


@query("SELECT r.record_id, max(a.class_domain_nt > 0) IS TRUE AS flag FROM mibig_records r LEFT JOIN domain_annotations a USING (record_id) GROUP BY 1")
def jn7_flag(spark, d):
    flags = table(spark, d, "domain_annotations").select("record_id", (F.col("class_domain_nt") > 0).alias("flag"))
    return joins.enriched_with_flag(table(spark, d, "mibig_records").select("record_id"), "record_id", flags, "record_id", "flag")[0].select("record_id", F.coalesce("flag", F.lit(False)).alias("flag"))


@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def jn8_cross_checked(spark, d):
    side = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    named = side.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    return joins.cross_checked(side, named, "o_orderkey", "o_custkey")


@query("SELECT a.label_id, a.doc_id, b.label_id AS b_label_id FROM review_labels a JOIN review_labels b ON a.label_id = b.label_id")
def jn9_by_position(spark, d):
    rows = table(spark, d, "review_labels").select("label_id", "doc_id")
    return joins.by_position(rows, rows, "label_id", "label_id", "doc_id").select("label_id", "doc_id", "b_label_id")


_ARM = "(SELECT l_orderkey AS k, avg(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = '{}' GROUP BY 1)"


@query(f"SELECT a.k AS l_orderkey, round(a.v, 4) AS \"left\", round(b.v, 4) AS \"right\", round(b.v - a.v, 4) AS difference FROM {_ARM.format('R')} a JOIN {_ARM.format('A')} b ON a.k = b.k")
def jn10_jn11_paired(spark, d):
    items = table(spark, d, "lineitem")
    return rounded(joins.paired(items.where("l_returnflag = 'R'"), items.where("l_returnflag = 'A'"), "l_orderkey", "l_extendedprice"), 4)


@query("SELECT record_id FROM mibig_records WHERE record_id NOT IN (SELECT record_id FROM domain_hits WHERE record_id IS NOT NULL)")
def jn12_anti(spark, d):
    return joins.without(table(spark, d, "mibig_records").select("record_id"), table(spark, d, "domain_hits"), "record_id")


@query("SELECT record_id FROM mibig_records WHERE record_id IN (SELECT record_id FROM domain_hits)")
def jn13_semi(spark, d):
    return joins.only(table(spark, d, "mibig_records").select("record_id"), table(spark, d, "domain_hits"), "record_id")


def _genes(spark, d):
    return table(spark, d, "domain_annotations").select("record_id", F.explode("genes").alias("g")).select("record_id", F.col("g.s").alias("s"), F.col("g.e").alias("e")).distinct()


def _spans(spark, d):
    return table(spark, d, "domain_annotations").select("record_id", F.explode("spans").alias("g")).select("record_id", F.col("g.acc").alias("acc"), F.col("g.s").alias("o_s"), F.col("g.e").alias("o_e")).distinct()


_G = "(SELECT DISTINCT record_id, g.s AS s, g.e AS e FROM (SELECT record_id, unnest(genes) AS g FROM domain_annotations))"
_S = "(SELECT DISTINCT record_id, g.acc AS acc, g.s AS o_s, g.e AS o_e FROM (SELECT record_id, unnest(spans) AS g FROM domain_annotations))"


@query(f"SELECT s.record_id, s.acc, s.o_s AS s, s.o_e AS e, g.s AS o_s, g.e AS o_e FROM {_S} s JOIN {_G} g ON s.record_id = g.record_id WHERE s.o_s >= g.s AND s.o_e <= g.e")
def jn14_contained(spark, d):
    spans = _spans(spark, d).withColumnsRenamed({"o_s": "s", "o_e": "e"})
    genes = _genes(spark, d).withColumnsRenamed({"s": "o_s", "e": "o_e"})
    return joins.contained(spans, genes, ["record_id"])


@query(f"SELECT g.record_id, g.s, g.e, acc, o_s, o_e, greatest(s, o_s) AS c_s, least(e, o_e) AS c_e FROM {_G} g JOIN {_S} s ON s.record_id = g.record_id WHERE e > o_s AND s < o_e")
def jn15_overlapping(spark, d):
    return joins.overlapping(_genes(spark, d), _spans(spark, d), ["record_id"], 2000)


@query(f"SELECT g.record_id, g.s, g.e FROM {_G} g WHERE NOT EXISTS (SELECT 1 FROM {_S} x WHERE x.record_id = g.record_id AND g.e > x.o_s AND g.s < x.o_e)")
def jn16_touching_none(spark, d):
    genes = _genes(spark, d).withColumn("row", F.concat_ws(":", "record_id", "s", "e"))
    return joins.touching_none(genes, _spans(spark, d), ["record_id"], "row", 2000).select("record_id", "s", "e")


@query("SELECT doc_id, d.accession, s.n FROM documents d LEFT JOIN (SELECT accession AS k, count(*) AS n FROM mibig_records GROUP BY 1) s ON k = coalesce(d.accession, CAST(doc_id AS VARCHAR))")
def jn18_fallback_key(spark, d):
    side = table(spark, d, "mibig_records").groupBy("accession").agg(F.count("*").alias("n"))
    return joins.with_fallback_key(table(spark, d, "documents").select("doc_id", "accession"), side, [F.col("accession"), F.col("doc_id")], "accession", "n")


@query(
    """WITH p AS (SELECT acc AS k, min(name) AS v FROM domain_models GROUP BY 1) SELECT h.record_id, h.acc, h.env_from, h.orf, coalesce(a.v, b.v) AS name FROM domain_hits h LEFT JOIN p a ON a.k = h.acc LEFT JOIN p b ON b.k = upper(h.acc)"""
)
def jn19_profile(spark, d):
    hits = table(spark, d, "domain_hits").select("record_id", "acc", "env_from", "orf")
    return joins.resolved_profile(hits, "acc", "acc", table(spark, d, "domain_models"), "acc", "name")


@query(
    """WITH n AS (SELECT taxonomic_tag AS t, compound_class AS c, count(DISTINCT record_id) AS n FROM mibig_records GROUP BY 1, 2)
    SELECT a.t AS taxonomic_tag, a.c AS label_a, b.c AS label_b, CAST(CASE WHEN a.c = b.c THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS BIGINT) AS pairs FROM n a JOIN n b ON a.t = b.t AND a.c <= b.c WHERE a.c < b.c OR a.n > 1"""
)
def jn20_cross_class_pairs(spark, d):
    return joins.cross_class_pairs(table(spark, d, "mibig_records"), "taxonomic_tag", "compound_class", "record_id")


@query(
    """WITH a AS (SELECT record_id AS id, compound_class AS k, length(sequence) AS n, row_number() OVER (PARTITION BY compound_class ORDER BY length(sequence) DESC, record_id) AS r FROM mibig_records WHERE source = 'lab_upload' AND sequence IS NOT NULL AND compound_class IS NOT NULL),
    b AS (SELECT record_id AS id, compound_class AS k, length(sequence) AS n, row_number() OVER (PARTITION BY compound_class ORDER BY length(sequence) DESC, record_id) AS r FROM mibig_records WHERE source = 'main_release' AND sequence IS NOT NULL AND compound_class IS NOT NULL)
    SELECT a.id, a.k AS compound_class, a.n AS size, b.id AS control_id, b.n AS control_size FROM a LEFT JOIN b ON a.k = b.k AND a.r = b.r"""
)
def jn21_sp14_nearest_size(spark, d):
    rows = table(spark, d, "mibig_records").where("sequence is not null and compound_class is not null").select(F.col("record_id").alias("id"), "compound_class", "source", F.length("sequence").cast("bigint").alias("size"))
    return joins.nearest_size(rows.where("source = 'lab_upload'").drop("source"), rows.where("source = 'main_release'").drop("source"), "compound_class", "size", "size")


@query(
    f"""WITH o AS (SELECT record_id, s, e, max(e) OVER (PARTITION BY record_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM {_G} WHERE e > s)
    SELECT record_id, CAST(sum(greatest(e - greatest(s, coalesce(t, s)), 0)) AS BIGINT) AS covered, CAST(sum(CASE WHEN t IS NULL OR s > t THEN 1 ELSE 0 END) AS BIGINT) AS pieces FROM o GROUP BY 1"""
)
def wn15_islands(spark, d):
    return joins.islands(_genes(spark, d), "record_id")


@query("SELECT record_id FROM (SELECT record_id, sequence, row_number() OVER (PARTITION BY md5(sequence) ORDER BY record_id) AS r FROM mibig_records) WHERE sequence IS NULL OR r = 1")
def wn1_sim14_first_of_content(spark, d):
    return ranking.first_of_content(table(spark, d, "mibig_records").select("record_id", "sequence"), "sequence", "record_id").select("record_id")


@query("SELECT acc, record_id, env_from, bit_score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY acc ORDER BY bit_score DESC NULLS LAST, record_id, orf, env_from, env_to) AS INTEGER) AS rank FROM (SELECT DISTINCT * FROM domain_hits)) WHERE rank <= 3")
def wn2_top_per_key(spark, d):
    hits = table(spark, d, "domain_hits").distinct().withColumn("tie", F.struct("record_id", "orf", "env_from", "env_to"))
    return ranking.top_per_key(hits, "acc", F.col("bit_score"), "tie", 3).select("acc", "record_id", "env_from", "bit_score", "rank")


@query("SELECT acc, max(bit_score) AS bit_score, (SELECT min(record_id) FROM domain_hits x WHERE x.acc IS NOT DISTINCT FROM h.acc AND x.bit_score = max(h.bit_score)) AS record_id FROM domain_hits h WHERE bit_score IS NOT NULL GROUP BY acc")
def wn3_best_per_key(spark, d):
    return ranking.best_per_key(table(spark, d, "domain_hits").where("bit_score is not null"), "acc", "bit_score", "record_id")


@query("SELECT taxonomic_tag, count(*) AS n FROM mibig_records WHERE taxonomic_tag IS NOT NULL GROUP BY 1 ORDER BY n DESC, taxonomic_tag LIMIT 15")
def wn4_top_groups(spark, d):
    return ranking.top_groups(table(spark, d, "mibig_records").where("taxonomic_tag is not null"), "taxonomic_tag", 15)


@query("SELECT record_id FROM mibig_records WHERE taxonomic_tag IN (SELECT taxonomic_tag FROM mibig_records WHERE taxonomic_tag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, taxonomic_tag LIMIT 15)")
def wn5_within_top(spark, d):
    return ranking.within_top_groups(table(spark, d, "mibig_records").where("taxonomic_tag is not null"), "taxonomic_tag", 15).select("record_id")


@query(
    """WITH x AS (SELECT record_id, compound_class, taxonomic_tag, md5('7|' || CAST(record_id AS VARCHAR)) AS h FROM mibig_records), g AS (SELECT *, CAST(row_number() OVER (PARTITION BY compound_class, taxonomic_tag ORDER BY h, record_id) > 1 AS INTEGER) AS rep FROM x)
    SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY compound_class ORDER BY rep, h, record_id) AS r FROM g) WHERE r <= 12"""
)
def wn6_wn7_spread_first(spark, d):
    h = F.md5(F.concat(F.lit("7|"), F.col("record_id").cast("string")))
    rows = table(spark, d, "mibig_records").select("record_id", "compound_class", "taxonomic_tag")
    return ranking.spread_first(rows, "compound_class", "taxonomic_tag", h, "record_id", 12).select("record_id")


@query(
    """SELECT vec_id, list_transform(list_sort(list_transform(range(0, 8), lambda k: struct_pack(v := -CAST(embedding[k + 1] AS DOUBLE), k := CAST(k AS VARCHAR)))), lambda e: e.k) AS ranked FROM embeddings"""
)
def wn8_ranked_labels(spark, d):
    scores = F.map_from_entries(F.array(*[F.struct(F.lit(str(k)).alias("k"), F.get("embedding", F.lit(k)).cast("double").alias("v")) for k in range(8)]))
    return table(spark, d, "embeddings").select("vec_id", ranking.ranked_labels(scores).alias("ranked"))


_ARMS = "(SELECT acc, avg(bit_score) AS m, stddev_samp(bit_score) / sqrt(count(*)) AS se FROM domain_hits WHERE acc IS NOT NULL GROUP BY 1 HAVING count(*) >= 5)"


@query(f"SELECT acc FROM {_ARMS} WHERE m >= (SELECT m - se FROM {_ARMS} ORDER BY m DESC, se DESC LIMIT 1)")
def wn9_tied_with_best(spark, d):
    arms = table(spark, d, "domain_hits").where("acc is not null").groupBy("acc").agg(F.avg("bit_score").alias("m"), (F.stddev_samp("bit_score") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n")).where("n >= 5")
    return ranking.tied_with_best(arms, "m", "se").select("acc")


@query("SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS last, round(avg(o_totalprice), 4) AS mean, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS lowest_at FROM orders GROUP BY 1")
def wn10_last_of_trace(spark, d):
    return rounded(ranking.last_of_trace(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice"), 4)


@query("SELECT l_linenumber, round(avg(l_tax) FILTER (l_returnflag = 'R'), 8) AS one, round(avg(l_tax) FILTER (l_returnflag = 'A'), 8) AS other, round(avg(l_tax) FILTER (l_returnflag = 'R') - avg(l_tax) FILTER (l_returnflag = 'A'), 8) AS gap FROM lineitem GROUP BY 1")
def wn11_gap_by_step(spark, d):
    return rounded(ranking.gap_by_step(table(spark, d, "lineitem"), "l_linenumber", "l_returnflag", "l_tax", "R", "A"), 8)


@query("SELECT record_id, arg_max(orf, (bit_score, -orf)) FILTER (strand > 0 AND bit_score IS NOT NULL) AS chosen FROM domain_hits GROUP BY 1")
def wn12_chosen_candidate(spark, d):
    hits = table(spark, d, "domain_hits").withColumn("ok", (F.col("strand") > 0) & F.col("bit_score").isNotNull())
    return ranking.chosen_candidate(hits, "record_id", "orf", "bit_score", "ok")


@query(
    """WITH b AS (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    l AS (SELECT *, max(CASE WHEN best IS NULL OR value <= best - 0.5 THEN n END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM b)
    SELECT user_id, min(event_id) FILTER (n - last >= 3) AS stop FROM l GROUP BY 1"""
)
def wn13_early_stop(spark, d):
    return ranking.early_stop(table(spark, d, "events"), "user_id", "event_id", "value", 3, 0.5)


@query("SELECT event_id, round(value - first_value(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS delta FROM events")
def wn14_delta_to_step(spark, d):
    return rounded(ranking.delta_to_step(table(spark, d, "events"), "user_id", "event_id", "value").select("event_id", "delta"))


@query("SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(text, '(?s)A+|C+|G+|T+|[^ACGT]'), lambda r: length(r))), CASE WHEN text IS NOT NULL THEN 0 END) AS run FROM (SELECT record_id AS doc_id, regexp_replace(upper(sequence), '[^ACGT]', 'x', 'g') AS text FROM mibig_records WHERE NOT regexp_matches(upper(sequence), '[^ACGT]{2}') OR sequence IS NULL)")
def wn16_fn3_longest_run(spark, d):
    s = F.regexp_replace(F.upper("sequence"), "[^ACGT]", "x")
    rows = table(spark, d, "mibig_records").where("not upper(sequence) rlike '[^ACGT]{2}' or sequence is null")
    return rows.select(F.col("record_id").alias("doc_id"), sequence.longest_run(s).alias("run"))


@query("SELECT count(*) FILTER (p) AS positives, count(*) FILTER (NOT p) AS negatives, round((sum(r) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2.0) / (count(*) FILTER (p) * count(*) FILTER (NOT p)), 6) AS auc FROM (SELECT p, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM (SELECT label >= 5 AS p, embedding[1] AS s FROM embeddings))")
def wn17_st7_auc(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("label") >= 5).alias("p"), F.get("embedding", F.lit(0)).alias("s"))
    return rounded(ranking.auc(rows, "s", "p"))
