"""Normal forms of the hand-written labels in the records: splits, classes, species, accessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as white space around a label.
SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normal_split(c: Column) -> Column:
    """train, val or test in lower case; valid and validation mean val; blank is null; other names stay, in lower case."""
    s = F.lower(stripped(c))
    return F.when(s.isin("valid", "validation"), "val").when(s == "", F.lit(None)).otherwise(s)


def species(tag: Column) -> Column:
    """``genus epithet`` in lower case from the species rank of a lineage tag; null if there is none.

    Ranks end at a semicolon or pipe; words are cut at anything that is no letter. Strain names after the epithet are
    ignored, and ``sp`` in its place means that no species is named.
    """
    rank = F.regexp_extract(F.lower(tag), r"(?:^|[;|])\s*s__([^;|]*)", 1)
    words = F.filter(F.split(rank, r"[^\p{L}]+"), lambda w: w != "")
    named = (F.size(words) >= 2) & ~F.get(words, F.lit(1)).isin("sp", "spp")
    return F.when(named, F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))))


def normal_accession(c: Column) -> Column:
    """Upper case, without blanks and ``.version``; blank is null."""
    s = F.regexp_replace(F.upper(F.regexp_replace(c, f"{SPACE}+", "")), r"\.[0-9]+$", "")
    return F.when(s != "", s)


def with_class(df: DataFrame, label: str, targets: DataFrame, class_map: DataFrame, name: str = "class") -> DataFrame:
    """Adds each row's class: the label if it is a target, else what the map gives for it, UNKNOWN if blank, else OTHER.

    White space around the label and its case are ignored. Both tables are vocabularies, one row a class or product; a
    product with several classes takes the first in alphabetical order. They are joined by key, not collected.
    """
    known = targets.select(F.col("compound_class").alias("__label")).where("__label is not null").distinct().withColumn("__known", F.lit(True))
    mapped = class_map.select(F.upper(stripped(F.col("product"))).alias("__label"), F.col("compound_class").alias("__c")).where("__label is not null and __c is not null")
    mapped = mapped.groupBy("__label").agg(F.min("__c").alias("__mapped"))
    words = known.join(mapped, "__label", "full")
    text = F.upper(stripped(F.col(label)))
    rows = df.withColumn("__label", F.coalesce(text, F.lit("")))
    out = F.when(F.col("__label") == "", "UNKNOWN").when(F.col("__known"), F.col("__label")).otherwise(F.coalesce("__mapped", F.lit("OTHER")))
    return rows.join(words, "__label", "left").withColumn(name, out).drop("__label", "__known", "__mapped")
