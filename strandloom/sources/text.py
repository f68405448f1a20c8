"""Readers of line-oriented files: JSON lines, FASTA, delimited tables, taxonomy dumps, rule files, class maps.

All return lazy DataFrames; files are split by the reader, and records that span lines are cut by their separator.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A core record as it is delivered; ``region_number`` may not be numeric and is kept as text.
CORE_RECORD = "accession string, genome_accession string, region_number string, compound_class string, antismash_products array<string>, contig_edge boolean, taxonomic_tag string, sequence string, region_start bigint, region_end bigint, strict_core_genes int, region_len bigint, training_text string, gbk_member string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per non-blank line of JSON; the schema is declared, never inferred."""
    return spark.read.schema(schema).json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, report): malformed lines are dropped from the rows and counted in the report (lines, malformed)."""
    full = T._parse_datatype_string(schema).add("_corrupt_record", T.StringType())
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    report = rows.agg(F.count("*").alias("lines"), F.count("_corrupt_record").alias("malformed"))
    return rows.where("_corrupt_record is null").drop("_corrupt_record"), report


def read_sequences(spark: SparkSession, path: str, schema: str, column: str = "sequence", limit: int | None = None) -> DataFrame:
    """JSON lines with a non-empty sequence, the first ``limit`` if one is given."""
    rows = read_jsonl(spark, path, schema).where(F.length(column) > 0)
    return rows.limit(limit) if limit is not None else rows


def read_fasta(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """(id, header, sequence[, label]): one row per record, cut at lines that start with ``>``.

    The id is the header's first word; sequence lines are joined without blanks. Text before the first header is skipped.
    """
    parts = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace(F.col("value"), "^>", "")
    head = F.regexp_replace(F.substring_index(text, "\n", 1), "\r$", "")
    body = F.regexp_replace(F.substring(text, F.length(F.substring_index(text, "\n", 1)) + 1, F.length(text)), r"\s+", "")
    rows = parts.select(F.regexp_extract(head, r"^\s*(\S*)", 1).alias("id"), F.trim(head).alias("header"), body.alias("sequence")).where("id <> ''")
    return rows.withColumn("label", F.lit(label)) if label is not None else rows


def read_table(spark: SparkSession, path: str, schema: str, separator: str = "\t", header: bool = True) -> DataFrame:
    """A delimited table with declared types."""
    return spark.read.schema(schema).option("sep", separator).option("header", header).csv(path)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """(query): distinct first columns of a tab-separated hit table without header."""
    return spark.read.option("sep", "\t").csv(path).select(F.col("_c0").alias("query")).where("query is not null").distinct()


def read_dump(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a taxonomy dump, whose fields end with tab, bar, tab."""
    fields = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t")
    return spark.read.text(path).select(*[F.trim(F.get(fields, F.lit(i))).alias(c) for i, c in enumerate(columns)])


def read_taxonomy(spark: SparkSession, nodes: str, names: str) -> DataFrame:
    """(taxid, parent, tax_rank, name): nodes with their scientific name; of several the first in alphabetical order."""
    n = read_dump(spark, nodes, ["taxid", "parent", "tax_rank"])
    own = read_dump(spark, names, ["taxid", "name", "unique_name", "name_class"]).where("name_class = 'scientific name'").groupBy("taxid").agg(F.min("name").alias("name"))
    return n.join(own, "taxid", "left").select(F.col("taxid").cast("int"), F.col("parent").cast("int"), "tax_rank", "name")


def read_lineage_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lineages, redirects) of one JSON document (also .gz): ``mappings`` id -> lineage map, ``deprecated_ids`` old -> new.

    Always both, empty where the document lacks them.
    """
    schema = "mappings map<string, map<string, string>>, deprecated_ids map<string, string>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    lineages = doc.select(F.explode_outer("mappings").alias("taxid", "lineage")).where("taxid is not null")
    redirects = doc.select(F.explode_outer("deprecated_ids").alias("old", "new")).where("old is not null")
    return lineages, redirects


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    """(product, compound_class) of a flat ``product: CLASS`` file, products in lower case without blanks; a vocabulary, read by the driver."""
    rows = []
    with open(path, encoding="utf-8") as f:
        for line in f:
            m = re.match(r"\s+?['\"]?([^#'\":]+)['\"]?\s*:\s*['\"]?([A-Za-z0-9_]+)['\"]?\s*(?:#.*)?$", " " + line.rstrip())
            if m:
                rows.append((m.group(1).strip().lower(), m.group(2)))
    return spark.createDataFrame(rows, "product string, compound_class string")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(product, category) of rule files: blocks of ``RULE name ... CATEGORY name``."""
    text = spark.read.text(path, wholetext=True)
    blocks = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)RULE\s+\S+.*?CATEGORY\s+\S+"), F.lit(0))).alias("b"))
    return blocks.select(F.regexp_extract("b", r"RULE\s+(\S+)", 1).alias("product"), F.regexp_extract("b", r"CATEGORY\s+(\S+)", 1).alias("category"))


def read_records_with_files(spark: SparkSession, meta: str, files: DataFrame, least: int = 30) -> DataFrame:
    """One row per JSON document of a folder that has a class, a name and a matching file with at least ``least`` bases.

    ``files``: accession, sequence (see ``genbank.read_genbank``). An inner join on accession; the rest is dropped.
    """
    schema = "accession string, biosynthesis struct<classes: array<struct<class: string>>>, compounds array<struct<name: string>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(meta)
    rows = docs.select("accession", F.get("biosynthesis.classes", F.lit(0))["class"].alias("compound_class"), F.get("compounds", F.lit(0))["name"].alias("compound"))
    both = rows.where("compound_class is not null and compound is not null").join(files.select("accession", "sequence"), "accession")
    return both.where(F.length("sequence") >= least)
