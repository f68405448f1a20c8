"""The queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.labels import normal_split, with_class

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.near_dup import class_pairs, near_duplicates

    return class_pairs(near_duplicates(table(spark, sf_dir, "mibig_records"), "record_id", "sequence", count_links=False))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "mibig_records"), "record_id", "sequence")


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "mibig_records").select("record_id", "compound_class", "source", "split")
    return with_class(rows, "compound_class", table(spark, sf_dir, "class_targets"), table(spark, sf_dir, "class_map"))


def _quota(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from strandloom.llm.quota_sample import quota_sample

    rows = _classed(spark, sf_dir)
    return quota_sample(rows, "record_id", "class", table(spark, sf_dir, "class_targets"), rows.count() // 4)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quota(spark, sf_dir)[1].where("shortfall > 0").select(F.col("category").alias("compound_class"))


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quota(spark, sf_dir)[0]


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quota(spark, sf_dir)[1]


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.related_splits import relation_key

    rows = table(spark, sf_dir, "mibig_records").select("record_id", "taxonomic_tag", "accession", "compound_class", normal_split(F.col("split")).alias("split"))
    return rows.withColumn("key", relation_key(F.col("taxonomic_tag"), F.col("accession")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.related_splits import broken_relations

    return broken_relations(_related(spark, sf_dir), "record_id", "key", "split").withColumnRenamed("id", "record_id")


def _assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, int]]:
    from strandloom.llm.related_splits import related_splits

    shares = {r["split"]: r["target_permille"] for r in table(spark, sf_dir, "split_targets").collect()}
    rows = with_class(_related(spark, sf_dir), "compound_class", table(spark, sf_dir, "class_targets"), table(spark, sf_dir, "class_map"))
    found = related_splits(rows, "record_id", "key", "class", shares).withColumnRenamed("id", "record_id")
    return found.join(rows.select("record_id", "key", "class"), "record_id"), shares


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir)[0].select("record_id", "assigned")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.related_splits import split_report

    rows, shares = _assigned(spark, sf_dir)
    return split_report(rows, "assigned", "class", shares)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.chunks import split_oversized

    genes = table(spark, sf_dir, "domain_annotations").select("record_id", "genes")
    return split_oversized(table(spark, sf_dir, "mibig_records"), "record_id", "sequence", genes).withColumnRenamed("id", "record_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.shared_spans import shared_spans

    return shared_spans(table(spark, sf_dir, "mibig_records"), "record_id", "sequence").withColumnRenamed("id", "record_id")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.shared_spans import shared_report, shared_spans

    rows = table(spark, sf_dir, "mibig_records")
    return shared_report(rows, "record_id", "sequence", shared_spans(rows, "record_id", "sequence")).withColumnRenamed("id", "record_id")


def p3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.shared_spans import aligned_passages

    found = aligned_passages(table(spark, sf_dir, "mibig_records"), "record_id", "sequence")
    return found.withColumnRenamed("a", "record_id_a").withColumnRenamed("b", "record_id_b")


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "mibig_records")
    return rows.withColumn("split", normal_split(F.col("split")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.cross_split import split_overlaps

    pairs = split_overlaps(_splits(spark, sf_dir), "record_id", "sequence", "split")
    return pairs.select(F.least("eval_id", "train_id").alias("record_id_a"), F.greatest("eval_id", "train_id").alias("record_id_b"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.cross_split import overlap_report, split_overlaps

    rows = _splits(spark, sf_dir)
    return overlap_report(rows, split_overlaps(rows, "record_id", "sequence", "split"), "record_id", "split", "source")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.tokens import encoded

    return encoded(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.tokens import decoded, encoded

    back = decoded(encoded(table(spark, sf_dir, "documents"), "doc_id", "text"), "id", "ids")
    return back.select(F.col("id").alias("doc_id"), F.md5(F.encode("text", "utf-8")).alias("text_md5"), F.size("starts").alias("n_tokens"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from strandloom.llm.mixing import mix_sources
    from strandloom.llm.tokens import encoded
    from strandloom.runtime import materialize

    rows = encoded(table(spark, sf_dir, "documents"), "doc_id", "text", counts_only=True, keep=("source",))
    rows = materialize(rows.withColumnRenamed("id", "doc_id"))
    return mix_sources(rows, "doc_id", "source", "n", table(spark, sf_dir, "source_weights"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1].where("unmet").select("source")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p8_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.abuse import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("flagged").select(F.col("id").alias("doc_id"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(F.col("id").alias("doc_id"), "source", "lang", "score", "flagged")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.abuse import rate_report

    return rate_report(_scored(spark, sf_dir))


def queries() -> dict[str, Query]:
    own = [p1_found, p1_classes, p2_found, p2_sample, p2_report, p3_found, p3_report, p3_passages, p4_found, p4_splits, p4_report, p5_found]
    own += [p6_found, p6_report, p7_ids, p7_round_trip, p8_found, p8_report, p8_copies, p9_found, p9_scores, p9_rates]
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    from strandloom.llm import sql

    return {"p2_found": sql.P2_FOUND, "p4_found": sql.P4_FOUND, "p5_found": sql.P5_FOUND}
