"""Aggregation queries over records, documents, hits and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import names, sequence
from strandloom.operators import aggregates as ag
from strandloom.plans.catalogue import query, rounded, table



def _records(spark, d):
    rows = table(spark, d, "mibig_records")
    return rows.withColumns({"cls": F.upper(F.coalesce(F.trim("compound_class"), F.lit("UNKNOWN"))), "part": F.coalesce(F.lower(F.trim("split")), F.lit("none")), "size": F.length("sequence").cast("bigint")})


REC = "(SELECT *, upper(coalesce(trim(compound_class), 'UNKNOWN')) AS cls, coalesce(lower(trim(split)), 'none') AS part, length(sequence) AS size FROM mibig_records)"


@query(f"SELECT cls, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM {REC} GROUP BY cls")
def ag1_count_report(spark, d):
    return rounded(ag.count_report(_records(spark, d), "cls"))


@query(f"SELECT cls, count(*) AS total, count(*) FILTER (part = 'train') AS train, count(*) FILTER (part = 'val') AS val, count(*) FILTER (part = 'test') AS test FROM {REC} GROUP BY cls")
def ag2_crosstab(spark, d):
    return ag.crosstab(_records(spark, d), "cls", "part", ["train", "val", "test"])


@query(
    f"""WITH c AS (SELECT cls, count(*) AS total, count(*) FILTER (part = 'train') AS train, count(*) FILTER (part = 'test') AS test FROM {REC} GROUP BY cls)
    SELECT cls, total, round(coalesce(100.0 * train / nullif(sum(train) OVER (), 0), 0), 6) AS train, round(coalesce(100.0 * test / nullif(sum(test) OVER (), 0), 0), 6) AS test FROM c"""
)
def ag3_crosstab_percent(spark, d):
    return rounded(ag.crosstab(_records(spark, d), "cls", "part", ["train", "test"], normalised=True))


@query(
    f"""SELECT cls, count(*) AS total, count(*) FILTER (source = 'main_release') AS main_release, count(*) FILTER (source = 'core_import') AS core_import,
    count(*) FILTER (source = 'lab_upload') AS lab_upload, count(*) FILTER (source = 'legacy_dump') AS legacy_dump FROM {REC} GROUP BY cls"""
)
def ag4_by_source(spark, d):
    return ag.crosstab(_records(spark, d), "cls", "source", ["main_release", "core_import", "lab_upload", "legacy_dump"])


@query("SELECT compound_class, count(*) AS n, count(contig_edge) AS known, round(avg(CAST(contig_edge AS INTEGER)), 6) AS rate, round(avg(region_len), 6) AS mean_size FROM core_records GROUP BY 1")
def ag5_edge_rate(spark, d):
    return rounded(ag.flag_rates(table(spark, d, "core_records"), "compound_class", "contig_edge", "region_len"))


@query(
    f"""SELECT cls, count(size) AS n, median(size) AS median, round(avg(CAST(size <= 8192 AS INTEGER)), 6) AS within,
    CAST(min(size) AS DOUBLE) AS minimum, round(quantile_cont(size, 0.25), 6) AS q1, median(size) AS middle, round(quantile_cont(size, 0.75), 6) AS q3, CAST(max(size) AS DOUBLE) AS maximum FROM {REC} GROUP BY cls"""
)
def ag6_ag47_length_spread(spark, d):
    return rounded(ag.spread(_records(spark, d), "cls", "size", 8192))


@query(
    f"""SELECT source, cls, count(*) AS n, count(DISTINCT taxonomic_tag) AS entities, CAST(sum(count(*)) OVER (PARTITION BY cls) AS BIGINT) AS category_total
    FROM {REC} GROUP BY source, cls"""
)
def ag7_composition(spark, d):
    return ag.composition(_records(spark, d), "source", "cls", "taxonomic_tag")


@query(
    f"""WITH p AS (SELECT cls, unnest(list_transform(range(1, greatest(length(sequence), 1)), lambda i: upper(substring(sequence, i, 2)))) AS pair FROM {REC} WHERE sequence IS NOT NULL)
    SELECT cls, pair, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY cls), 6) AS share FROM p GROUP BY cls, pair"""
)
def ag8_ag9_pair_profile(spark, d):
    return rounded(ag.pair_profile(_records(spark, d), "cls", "sequence", "record_id"))


@query(f"SELECT cls, count(*) AS n FROM {REC} GROUP BY cls HAVING count(*) >= 20")
def ag10_having(spark, d):
    return ag.at_least(_records(spark, d), "cls", 20)


@query(
    """WITH h AS (SELECT h.record_id, h.acc, r.cls FROM domain_hits h JOIN """
    + REC
    + """ r USING (record_id)), per AS (SELECT cls, count(DISTINCT record_id) AS e FROM h GROUP BY cls),
    tot AS (SELECT sum(e) AS a FROM per), pairs AS (SELECT DISTINCT cls, record_id, acc FROM h WHERE acc IS NOT NULL),
    hits AS (SELECT cls, acc, count(*) AS n, sum(count(*)) OVER (PARTITION BY acc) AS na FROM pairs GROUP BY cls, acc),
    s AS (SELECT cls, acc, n, n / e AS frequency, (n / e) / (na / a) AS enrichment, (n / e) * least((n / e) / (na / a), 10.0) AS score FROM hits JOIN per USING (cls) CROSS JOIN tot),
    r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY round(score, 9) DESC, acc) AS rank FROM s)
    SELECT cls, acc, n, round(frequency, 6) AS frequency, round(enrichment, 6) AS enrichment, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20"""
)
def ag11_markers(spark, d):
    rows = table(spark, d, "domain_hits").join(_records(spark, d).select("record_id", "cls"), "record_id")
    return rounded(ag.enriched(rows, "cls", "record_id", "acc", 20))


def _verdicts(spark, d):
    """Per reviewed document: verdicts of three gates derived from its reviews; null reviews are skipped."""
    v = F.lower(F.trim("verdict"))
    rows = table(spark, d, "review_labels").select("doc_id", v.alias("v"))
    one = lambda bad: F.when(F.col("v").isNull(), "skipped").when(~F.col("v").isin("clean", "abusive", "hateful", "sexual"), "no_verdict").when(F.col("v").isin(*bad), "FAIL").otherwise("PASS")
    return rows.select("doc_id", one(["abusive"]).alias("polite"), one(["hateful"]).alias("fair"), one(["sexual", "hateful"]).alias("decent"))


def _gate(bad: str) -> str:
    return f"CASE WHEN v IS NULL THEN 'skipped' WHEN v NOT IN ('clean', 'abusive', 'hateful', 'sexual') THEN 'no_verdict' WHEN v IN ({bad}) THEN 'FAIL' ELSE 'PASS' END"


VER = f"""(SELECT doc_id, {_gate("'abusive'")} AS polite, {_gate("'hateful'")} AS fair, {_gate("'sexual', 'hateful'")} AS decent FROM (SELECT doc_id, lower(trim(verdict)) AS v FROM review_labels))"""


@query(
    f"""WITH l AS (UNPIVOT {VER} ON polite, fair, decent INTO NAME question VALUE v)
    SELECT question, count(*) FILTER (v = 'PASS') AS "PASS", count(*) FILTER (v = 'FAIL') AS "FAIL", count(*) FILTER (v = 'no_verdict') AS no_verdict, count(*) FILTER (v = 'skipped') AS skipped,
    round(count(*) FILTER (v = 'PASS') / nullif(count(*) FILTER (v IN ('PASS', 'FAIL')), 0), 6) AS rate FROM l GROUP BY question"""
)
def ag12_verdict_tally(spark, d):
    return rounded(ag.verdict_tally(_verdicts(spark, d), ["polite", "fair", "decent"]))


@query(
    "SELECT "
    + ", ".join(
        f"count(*) FILTER ({g} = 'PASS') AS {g}_pass, count(*) FILTER ({g} IN ('PASS', 'FAIL')) AS {g}_evaluated, round(count(*) FILTER ({g} = 'PASS') / nullif(count(*) FILTER ({g} IN ('PASS', 'FAIL')), 0), 6) AS {g}_rate"
        for g in ("polite", "fair", "decent")
    )
    + f" FROM {VER}"
)
def ag13_headline(spark, d):
    return rounded(ag.headline(_verdicts(spark, d), ["polite", "fair", "decent"]))


@query(
    f"""WITH e AS (SELECT * FROM {VER} WHERE polite IN ('PASS', 'FAIL') AND fair IN ('PASS', 'FAIL') AND decent IN ('PASS', 'FAIL')), n AS (SELECT count(*) AS evaluated FROM e),
    s AS (SELECT 1 AS stage, 'polite' AS gate, count(*) FILTER (polite = 'PASS') AS passing FROM e UNION ALL SELECT 2, 'fair', count(*) FILTER (polite = 'PASS' AND fair = 'PASS') FROM e
    UNION ALL SELECT 3, 'decent', count(*) FILTER (polite = 'PASS' AND fair = 'PASS' AND decent = 'PASS') FROM e)
    SELECT stage, gate, passing, evaluated, round(passing / nullif(evaluated, 0), 6) AS rate FROM s CROSS JOIN n"""
)
def ag14_funnel(spark, d):
    return rounded(ag.funnel(_verdicts(spark, d), ["polite", "fair", "decent"]))


@query(
    """WITH s AS (SELECT coalesce(reviewer, 'none') AS source FROM review_labels)
    SELECT 'polite' AS question, source, count(*) AS n, source NOT IN ('rev-01', 'none') AS proxy FROM s GROUP BY source"""
)
def ag15_provenance(spark, d):
    rows = table(spark, d, "review_labels").select(F.create_map(F.lit("polite"), F.coalesce("reviewer", F.lit("none"))).alias("m"))
    return ag.provenance(rows, "m", "rev-01")


@query(
    """SELECT acc, count(*) AS n, count(*) FILTER (NOT coalesce(evalue < 1e-5, false)) AS skipped, count(*) FILTER (coalesce(evalue < 1e-5, false)) AS scored,
    round(count(*) FILTER (evalue < 1e-5 AND strand > 0) / nullif(count(*) FILTER (evalue < 1e-5 AND strand IS NOT NULL), 0), 6) AS forward_rate,
    round(avg(bit_score) FILTER (evalue < 1e-5), 6) AS bit_score_mean, round(stddev_samp(bit_score) FILTER (evalue < 1e-5), 6) AS bit_score_sd,
    round(stddev_samp(bit_score) FILTER (evalue < 1e-5) / nullif(sqrt(count(bit_score) FILTER (evalue < 1e-5)), 0), 6) AS bit_score_se FROM domain_hits GROUP BY acc"""
)
def ag16_ag17_ag49_arm_summary(spark, d):
    rows = table(spark, d, "domain_hits").withColumn("forward", F.col("strand") > 0)
    return rounded(ag.arm_summary(rows, ["acc"], ["forward"], ["bit_score"], F.col("evalue") < 1e-5))


CONF = f"""(SELECT r.cls AS wanted, upper(trim(a.compound_class)) AS got FROM {REC} r JOIN domain_annotations a USING (record_id) WHERE a.compound_class IS NOT NULL)"""


def _confused(spark, d):
    ann = table(spark, d, "domain_annotations").select("record_id", F.upper(F.trim("compound_class")).alias("got"))
    return _records(spark, d).select("record_id", F.col("cls").alias("wanted")).join(ann, "record_id")


@query(f"SELECT wanted, got, count(*) AS n FROM {CONF} WHERE wanted IS NOT NULL GROUP BY wanted, got")
def ag18_confusion(spark, d):
    return ag.confusion(_confused(spark, d), "wanted", "got")


@query(
    f"""WITH p AS (SELECT wanted, count(*) AS n, count(*) FILTER (wanted = got) AS hits FROM {CONF} GROUP BY wanted)
    SELECT wanted, n, hits, round(sum(hits) OVER () / sum(n) OVER (), 6) AS accuracy, round(max(n) OVER () / sum(n) OVER (), 6) AS prior, round(hits / n, 6) AS recall FROM p"""
)
def ag18_recall(spark, d):
    return rounded(ag.confusion_summary(ag.confusion(_confused(spark, d), "wanted", "got")))


@query(
    """WITH e AS (SELECT label AS truth, embedding AS v FROM embeddings),
    s AS (SELECT truth, list_transform(range(0, 10), lambda k: round(CAST(v[k + 1] AS DOUBLE), 9)) AS sc, truth AS t FROM e),
    r AS (SELECT truth, sc[truth + 1] AS own, len(list_filter(range(0, 10), lambda k: k <> t AND (sc[k + 1] > sc[t + 1] OR (sc[k + 1] = sc[t + 1] AND CAST(k AS VARCHAR) < CAST(t AS VARCHAR))))) + 1 AS rank,
      sc[t + 1] - list_max(list_transform(list_filter(range(0, 10), lambda k: k <> t), lambda k: sc[k + 1])) AS margin FROM s)
    SELECT CAST(truth AS VARCHAR) AS truth, count(*) AS n, round(avg(CAST(rank <= 1 AS INTEGER)), 6) AS top1, round(avg(CAST(rank <= 3 AS INTEGER)), 6) AS top3, round(avg(CAST(rank <= 5 AS INTEGER)), 6) AS top5,
    round(avg(1.0 / rank), 6) AS mrr, round(avg(margin), 6) AS margin FROM r GROUP BY truth"""
)
def ag19_ranking_metrics(spark, d):
    rows = table(spark, d, "embeddings")
    scores = F.map_from_entries(F.array(*[F.struct(F.lit(str(k)).alias("k"), F.round(F.get("embedding", F.lit(k)).cast("double"), 9).alias("v")) for k in range(10)]))
    return rounded(ag.ranking_metrics(rows.select(F.col("label").cast("string").alias("label"), scores.alias("scores")), "label", "scores"))


@query(
    f"""WITH x AS (SELECT cls, part, CAST(size AS DOUBLE) AS size, length(taxonomic_tag) AS tag FROM {REC}),
    g AS (SELECT cls, avg(size) FILTER (part = 'train') - avg(size) FILTER (part = 'test') AS size_shift, avg(tag) FILTER (part = 'train') - avg(tag) FILTER (part = 'test') AS tag_shift FROM x GROUP BY cls)
    SELECT cls, round(size_shift, 6) AS size_shift, round(tag_shift, 6) AS tag_shift, coalesce(CAST(size_shift > 5 AS INTEGER), 0) + coalesce(CAST(tag_shift > 5 AS INTEGER), 0) AS votes,
    CASE WHEN size_shift IS NULL AND tag_shift IS NULL THEN 'no_data' WHEN 2 * (coalesce(CAST(size_shift > 5 AS INTEGER), 0) + coalesce(CAST(tag_shift > 5 AS INTEGER), 0)) > 2 THEN 'steers' ELSE 'no_effect' END AS verdict FROM g"""
)
def ag20_effect(spark, d):
    rows = _records(spark, d).withColumn("tag", F.length("taxonomic_tag"))
    return rounded(ag.effect_by_label(rows, "cls", "part", "train", "test", ["size", "tag"], 5))


_BOUNDS = [1000, 2000, 4000, 8000, 16000]
_CASE = "CASE " + " ".join(f"WHEN size <= {b} THEN '<={b}'" for b in _BOUNDS) + f" WHEN size > {_BOUNDS[-1]} THEN '>{_BOUNDS[-1]}' END"


@query(
    f"""WITH x AS (SELECT cls, {_CASE} AS bucket, size FROM {REC} WHERE size IS NOT NULL)
    SELECT cls, bucket, count(*) AS n, round(avg(size), 6) AS mean FROM x GROUP BY cls, bucket UNION ALL SELECT 'POOLED', bucket, count(*), round(avg(size), 6) FROM x GROUP BY bucket"""
)
def ag21_ag22_ag39_pooled(spark, d):
    rows = _records(spark, d).where("size is not null").withColumn("bucket", names.bucket_label(F.col("size"), _BOUNDS))
    return rounded(ag.with_pooled(rows, ["cls", "bucket"], [F.count("*").alias("n"), F.avg("size").alias("mean")]))


@query("SELECT acc, round(avg(bit_score), 6) AS mean, round(median(bit_score), 6) AS median, round(max(bit_score), 6) AS greatest, round(avg(CAST(bit_score >= 100 AS INTEGER)), 6) AS share_over FROM domain_hits GROUP BY acc")
def ag23_over_threshold(spark, d):
    return rounded(ag.over_threshold(table(spark, d, "domain_hits"), "acc", "bit_score", 100))


@query(
    f"""SELECT count(*) AS n, count(*) FILTER (size >= 1000) AS long, count(*) FILTER (part = 'train') AS train, count(*) FILTER (cls = 'TERPENE') AS terpene,
    count(*) FILTER (size >= 1000 AND part = 'train' AND cls = 'TERPENE') AS joint FROM {REC}"""
)
def ag24_joint_pass(spark, d):
    return ag.joint_pass(_records(spark, d), {"long": F.col("size") >= 1000, "train": F.col("part") == "train", "terpene": F.col("cls") == "TERPENE"})


@query(
    f"""WITH x AS (SELECT cls, list_sort(list(size)) AS v FROM {REC} WHERE size IS NOT NULL GROUP BY cls)
    SELECT cls, len(v) AS n, v[CAST(floor(0.1 * (len(v) - 1)) AS BIGINT) + 1] AS q10, v[CAST(floor(0.5 * (len(v) - 1)) AS BIGINT) + 1] AS q50, v[CAST(floor(0.95 * (len(v) - 1)) AS BIGINT) + 1] AS q95 FROM x"""
)
def ag25_floor_quantiles(spark, d):
    return ag.floor_quantiles(_records(spark, d), "cls", "size", [0.1, 0.5, 0.95])


@query("SELECT acc, round(sum(bit_score * (env_to - env_from)) / nullif(sum(env_to - env_from), 0), 6) AS weighted, CAST(sum(env_to - env_from) AS BIGINT) AS weight FROM domain_hits WHERE bit_score IS NOT NULL AND env_to IS NOT NULL AND env_from IS NOT NULL GROUP BY acc")
def ag26_weighted_mean(spark, d):
    return rounded(ag.weighted_mean(table(spark, d, "domain_hits").withColumn("w", F.col("env_to") - F.col("env_from")), "acc", "bit_score", "w"))


@query("SELECT count(*) AS n, count(DISTINCT accession) AS distinct_accession, count(DISTINCT sequence) AS distinct_sequence FROM mibig_records")
def ag27_distinct(spark, d):
    return ag.distinct_counts(table(spark, d, "mibig_records"), "accession", "sequence")


@query(
    """WITH x AS (SELECT lang, CAST(length(text) AS DOUBLE) AS c, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS w FROM documents WHERE text IS NOT NULL)
    SELECT lang, count(*) AS n, round(sum(c) / sum(w), 6) AS micro, round(avg(c / w), 6) AS macro, round(median(c / w), 6) AS median, round(min(c / w), 6) AS least, round(max(c / w), 6) AS greatest FROM x WHERE w > 0 GROUP BY lang"""
)
def ag28_micro_macro(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    docs = docs.select("lang", F.length("text").alias("c"), F.size(F.regexp_extract_all("text", F.lit("[^ \\t\\n\\r]+"), F.lit(0))).alias("w"))
    return rounded(ag.micro_macro(docs, "lang", "c", "w"))


@query(f"SELECT cls, count(*) AS n, round(avg(CAST(size <= 4096 AS INTEGER)), 6) AS share FROM {REC} WHERE size IS NOT NULL GROUP BY cls")
def ag29_fits(spark, d):
    rows = _records(spark, d).where("size is not null")
    return rounded(rows.groupBy("cls").agg(F.count("*").alias("n"), F.avg((F.col("size") <= 4096).cast("int")).alias("share")))


@query(
    """WITH l AS (SELECT unnest([1024, 4096, 8192, 32768]) AS at_limit), x AS (SELECT length(sequence) AS n FROM mibig_records WHERE sequence IS NOT NULL)
    SELECT at_limit, round(avg(CAST(n <= at_limit AS INTEGER)), 6) AS fits, round(avg(CAST(n > at_limit AS INTEGER)), 6) AS cut, round(sum(greatest(n - at_limit, 0)) / sum(n), 6) AS lost FROM x CROSS JOIN l GROUP BY at_limit"""
)
def ag30_limit_effects(spark, d):
    return rounded(ag.limit_effects(_records(spark, d), "size", [1024, 4096, 8192, 32768]))


@query(
    f"""SELECT part, CAST(CASE WHEN size < 100 THEN 0 WHEN size >= 300000 THEN 60 ELSE floor((log10(size) - 2) / ((log10(300000) - 2) / 59)) + 1 END AS BIGINT) AS bin, count(*) AS n
    FROM {REC} WHERE size > 0 GROUP BY part, bin"""
)
def ag31_log_histogram(spark, d):
    return ag.log_histogram(_records(spark, d), "part", "size", 100.0, 300000.0, 59)


@query(
    f"""WITH m AS (SELECT cls, count(*) AS n, count(DISTINCT taxonomic_tag) AS groups, count(sequence) - count(DISTINCT sequence) AS repeats, median(size) AS median FROM {REC} GROUP BY cls)
    SELECT *, concat_ws(',', CASE WHEN n < 20 THEN 'rows<20' END, CASE WHEN groups < 10 THEN 'groups<10' END) AS reasons, n >= 20 AND groups >= 10 AS viable FROM m"""
)
def ag32_manifest(spark, d):
    return ag.manifest(_records(spark, d), "cls", "taxonomic_tag", "sequence", "size", 20, 10)


@query(
    """WITH x AS (SELECT DISTINCT lower(trim(split)) AS s, taxonomic_tag AS t FROM mibig_records WHERE split IS NOT NULL AND taxonomic_tag IS NOT NULL)
    SELECT a.s AS split_a, b.s AS split_b, count(*) AS shared FROM x a JOIN x b ON a.t = b.t AND a.s < b.s GROUP BY 1, 2"""
)
def ag33_split_overlap(spark, d):
    return ag.split_overlap(table(spark, d, "mibig_records").withColumn("split", F.lower(F.trim("split"))), "split", "taxonomic_tag")


_DOSE = "(SELECT l_linenumber AS dose, l_discount AS v, l_returnflag = 'R' AS f FROM lineitem)"


@query(f"SELECT dose, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(avg(CAST(f AS INTEGER)), 6) AS flip_rate FROM {_DOSE} GROUP BY dose")
def ag34_dose_response(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("dose"), F.col("l_discount").alias("v"), (F.col("l_returnflag") == "R").alias("f"))
    return rounded(ag.dose_response(rows, "dose", "v", "f"))


@query(f"SELECT min(dose) AS lowest FROM (SELECT dose, avg(v) AS mean FROM {_DOSE} GROUP BY dose) WHERE mean >= 0.05")
def ag34_lowest_dose(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("dose"), F.col("l_discount").alias("v"), (F.col("l_returnflag") == "R").alias("f"))
    return ag.lowest_dose(ag.dose_response(rows, "dose", "v", "f"), "dose", "mean", 0.05)


@query(
    """WITH g AS (SELECT compound_class, unnest(genes) AS g FROM domain_annotations)
    SELECT compound_class, coalesce(n, 0) AS lengths_n, m AS lengths_mean FROM (SELECT DISTINCT compound_class FROM domain_annotations) k LEFT JOIN
    (SELECT compound_class AS c, count(g.e - g.s) AS n, round(avg(g.e - g.s), 6) AS m FROM g GROUP BY 1) x ON k.compound_class IS NOT DISTINCT FROM x.c"""
)
def ag35_list_means(spark, d):
    rows = table(spark, d, "domain_annotations").withColumn("lengths", F.transform("genes", lambda g: g["e"] - g["s"]))
    return rounded(ag.list_means(rows, "compound_class", ["lengths"]))


@query("SELECT label, max(embedding[1]) AS peak FROM embeddings GROUP BY label")
def ag36_nested_peak(spark, d):
    return ag.nested_peak(table(spark, d, "embeddings"), "label", "embedding")


@query(
    f"""WITH x AS (SELECT r.cls, a.error IS NULL AS ok, CASE WHEN a.error IS NULL THEN a.n_domains > 0 END AS det, a.class_domain_nt > 0 AS m, a.compound_class AS p FROM {REC} r JOIN domain_annotations a USING (record_id))
    SELECT cls, count(*) AS n, count(*) FILTER (det IS NULL) AS errors, round(avg(CAST(det AS INTEGER)), 6) AS detection_rate, round(count(*) FILTER (det AND m) / nullif(count(*) FILTER (det), 0), 6) AS match_rate,
    count(DISTINCT p) FILTER (det) AS products FROM x GROUP BY cls"""
)
def ag37_ag38_detection(spark, d):
    ann = table(spark, d, "domain_annotations").select("record_id", F.when(F.col("error").isNull(), F.col("n_domains") > 0).alias("det"), (F.col("class_domain_nt") > 0).alias("m"), F.col("compound_class").alias("p"))
    return rounded(ag.detection(_records(spark, d).select("record_id", "cls").join(ann, "record_id"), "cls", "det", "m", "p"))


@query(
    f"""SELECT cls, round(avg(size) FILTER (part = 'train'), 6) AS one, round(avg(size) FILTER (part = 'test'), 6) AS other,
    round(avg(size) FILTER (part = 'train') / nullif(avg(size) FILTER (part = 'test'), 0), 6) AS ratio FROM {REC} GROUP BY cls"""
)
def ag40_ratio_of_groups(spark, d):
    return rounded(ag.ratio_of_groups(_records(spark, d), "part", "cls", "size", "train", "test"))


@query(
    """WITH m AS (SELECT l_linenumber, avg(l_quantity) AS mean FROM lineitem GROUP BY 1)
    SELECT l_linenumber, round(mean, 6) AS mean, round(mean - first_value(mean) OVER (ORDER BY l_linenumber), 6) AS delta FROM m"""
)
def ag41_delta_to_first(spark, d):
    return rounded(ag.delta_to_first(table(spark, d, "lineitem"), "l_linenumber", "l_quantity"))


@query("SELECT record_id, round(avg(bit_score) FILTER (strand > 0), 6) AS inside, round(avg(bit_score) FILTER (NOT strand > 0), 6) AS outside FROM domain_hits GROUP BY record_id")
def ag42_masked_means(spark, d):
    return rounded(ag.masked_means(table(spark, d, "domain_hits").withColumn("fwd", F.col("strand") > 0), "record_id", "bit_score", "fwd"))


@query(
    """WITH x AS (SELECT l_returnflag = 'R' AS b, l_quantity > 25 AS a FROM lineitem)
    SELECT count(*) FILTER (b) AS had, round(count(*) FILTER (b AND a) / nullif(count(*) FILTER (b), 0), 6) AS kept, round(count(*) FILTER (NOT b AND a) / nullif(count(*) FILTER (NOT b), 0), 6) AS gained FROM x"""
)
def ag43_kept_and_gained(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("b"), (F.col("l_quantity") > 25).alias("a"))
    return rounded(ag.kept_and_gained(rows, "b", "a"))


@query(
    """WITH m AS (SELECT event_type, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1)
    SELECT event_type, n, round(mean, 6) AS mean, round(mean - (SELECT mean FROM m WHERE event_type = 'view'), 6) AS mean_delta FROM m"""
)
def ag44_delta_to_baseline(spark, d):
    arms = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return rounded(ag.delta_to_baseline(arms, "event_type", "view", ["mean"]))


@query(
    """SELECT l_returnflag AS m, coalesce(l_linestatus, '') AS c, round(avg(l_tax), 6) AS mean FROM lineitem GROUP BY 1, 2 UNION ALL SELECT l_returnflag, 'ALL', round(avg(l_tax), 6) FROM lineitem GROUP BY 1"""
)
def ag45_model_means(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("c"), F.col("l_returnflag").alias("m"), "l_tax")
    return rounded(ag.with_pooled(rows, ["c", "m"], [F.avg("l_tax").alias("mean")], pooled="ALL"))


@query("SELECT upper(regexp_extract(taxonomic_tag, '(?i)(?:^|[;|])\\s*p__([^;|]*)', 1)) AS phylum, count(*) AS n FROM mibig_records WHERE regexp_matches(taxonomic_tag, '(?i)(?:^|[;|])\\s*p__[^;|]') GROUP BY 1")
def ag46_per_phylum(spark, d):
    rows = table(spark, d, "mibig_records").select(F.upper(names.tag_rank(F.col("taxonomic_tag"), "p")).alias("phylum")).where("phylum is not null")
    return rows.groupBy("phylum").agg(F.count("*").alias("n"))


_DIFF_A = "(SELECT o_orderkey AS k, o_orderstatus AS s, round(o_totalprice, 0) AS p FROM orders)"
_DIFF_B = "(SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, round(o_totalprice, 0) + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS p FROM orders WHERE o_orderkey % 11 <> 0)"


@query(
    f"""SELECT k, CASE WHEN b.k2 IS NULL THEN 'missing' WHEN a.s IS DISTINCT FROM b.s THEN 'fatal' ELSE 'benign' END AS kind,
    concat_ws(',', CASE WHEN a.s IS DISTINCT FROM b.s THEN 's' END, CASE WHEN a.p IS DISTINCT FROM b.p THEN 'p' END) AS differing
    FROM {_DIFF_A} a LEFT JOIN (SELECT k AS k2, s, p FROM {_DIFF_B}) b ON a.k = b.k2 WHERE b.k2 IS NULL OR a.s IS DISTINCT FROM b.s OR a.p IS DISTINCT FROM b.p"""
)
def ag48_table_diff(spark, d):
    orders = table(spark, d, "orders")
    a = orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.round("o_totalprice", 0).alias("p"))
    b = orders.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"), (F.round("o_totalprice", 0) + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).alias("p"))
    return ag.table_diff(a, b, "k", ["s", "p"], ["p"])


@query(
    """SELECT record_id, length(sequence) AS n, round(coalesce(CAST(length(regexp_replace(upper(sequence), '[^GC]', '', 'g')) AS DOUBLE) / nullif(length(regexp_replace(upper(sequence), '[^ACGT]', '', 'g')), 0), CASE WHEN sequence IS NOT NULL THEN 0 END), 6) AS gc,
    round(coalesce(CAST(length(regexp_replace(upper(sequence), '[^GC]', '', 'g')) AS DOUBLE) / nullif(length(sequence), 0), CASE WHEN sequence IS NOT NULL THEN 0 END), 6) AS gc_length,
    round(coalesce(1 - CAST(length(regexp_replace(upper(sequence), '[^ACGT]', '', 'g')) AS DOUBLE) / nullif(length(sequence), 0), CASE WHEN sequence IS NOT NULL THEN 0 END), 6) AS other FROM mibig_records"""
)
def fn1_fn2_composition(spark, d):
    s = F.col("sequence")
    rows = table(spark, d, "mibig_records")
    return rounded(rows.select("record_id", F.length(s).cast("bigint").alias("n"), sequence.gc_of_acgt(s).alias("gc"), sequence.gc_of_length(s).alias("gc_length"), sequence.other_share(s).alias("other")))
