"""Projections, filters and text composition on records: no shuffle unless stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import sequence


def summary_row(df: DataFrame, seq: str, keep: list[str], tag: str | None = None) -> DataFrame:
    """A slim row per record: kept columns, length, GC, share of other letters and, of a lineage tag, its seven ranks."""
    from strandloom.functions.names import tag_columns

    s = F.col(seq)
    cols = [*keep, F.length(s).alias("length"), sequence.gc_of_acgt(s).alias("gc"), sequence.other_share(s).alias("n_frac")]
    return df.select(*cols, *[c.alias(f"rank_{k}") for k, c in (tag_columns(F.col(tag)).items() if tag else ())])


def training_prefix(label: Column, tag: Column, default: str = "UNKNOWN") -> Column:
    return F.concat(F.lit("|COMPOUND_CLASS:"), F.coalesce(label, F.lit(default)), F.lit("|"), F.coalesce(tag, F.lit("")))


def window_prefix(start: Column, whole: Column, continued: Column) -> Column:
    """The full prefix for a record's first window, the continuation prefix for those inside."""
    return F.when(start == 0, whole).otherwise(continued)


def recovered_prefix(text: Column, expected: Column, seq: Column) -> Column:
    """The prefix of a stored training text: ``expected`` if it and the sequence make up the text, else what precedes the
    sequence; the query fails for a text that does not end with its sequence."""
    rest = F.substring(text, F.lit(1), F.length(text) - F.length(seq))
    return F.when(text == F.concat(expected, seq), expected).when(text.endswith(seq), rest).when(text.isNotNull() & seq.isNotNull(), F.raise_error(F.lit("the text does not end with its sequence")).cast("string"))


def contexts(df: DataFrame, seq: str, target_start: int, target: int, sizes: list[int]) -> DataFrame:
    """For each context size one row: the same target stretch and that many characters before it (fewer at the start)."""
    n = F.explode(F.array(*map(F.lit, sizes))).alias("context")
    rows = df.select("*", n)
    first = F.greatest(F.lit(target_start) - F.col("context"), F.lit(0))
    left = F.substring(F.col(seq), first + 1, F.lit(target_start) - first)
    return rows.withColumn("left", left).withColumn("target", F.substring(seq, target_start + 1, target))


def padded(df: DataFrame, batch: str, text: str) -> DataFrame:
    """Texts padded on the left with blanks to the longest of their batch."""
    most = F.max(F.length(text)).over(Window.partitionBy(batch))
    return df.withColumn("padded", F.lpad(F.col(text), most, F.lit(" ")))


def good_quality(seq: Column, edge: Column, least: int) -> Column:
    """At least ``least`` long, not at a contig edge (only a true flag counts), and A, C, G, T throughout in any case."""
    return F.coalesce((F.length(seq) >= least) & ~F.coalesce(edge, F.lit(False)) & ~F.upper(seq).rlike("[^ACGT]"), F.lit(False))


def acceptable(seq: Column, least: int = 1000, share: float = 0.8) -> Column:
    """Whether an input can be measured at all: long enough and enough A, C, G, T; null counts as not."""
    return F.coalesce((F.length(seq) >= least) & (sequence.n_acgt(seq) >= share * F.length(seq)), F.lit(False))


def with_rejections(df: DataFrame, seq: str, detected: str) -> DataFrame:
    """Unacceptable inputs are measured negatives: detected false and marked, rather than dropped."""
    ok = acceptable(F.col(seq))
    return df.withColumn("input_rejected", ~ok).withColumn(detected, F.when(ok, F.col(detected)).otherwise(False))


def without_legacy(df: DataFrame, legacy: str, allow: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, report): legacy rows are refused unless allowed; the report says how many there were."""
    flag = F.coalesce(F.col(legacy), F.lit(False))
    return (df if allow else df.where(~flag)), df.agg(F.count_if(flag).alias("legacy"), F.count("*").alias("n"))


def whole_fits(length: Column, prefix: Column, budget: int, end: int) -> Column:
    return length <= F.lit(budget) - prefix - end


def shares_members(items: Column, reference: Column, least: int = 2) -> Column:
    """Whether at least ``least`` distinct members of ``items`` are in ``reference``."""
    return F.size(F.array_intersect(items, reference)) >= least


def milestones(df: DataFrame, step: str, stride: int, done: DataFrame | None = None) -> DataFrame:
    """Steps at multiples of ``stride`` and the newest one, less those in ``done``, ascending."""
    newest = F.max(step).over(Window.partitionBy(F.lit(0)))
    some = df.select(step).distinct().withColumn("__new", newest).where((F.col(step) % stride == 0) | (F.col(step) == F.col("__new"))).select(step)
    return (some.join(done.select(step), step, "left_anti") if done is not None else some).orderBy(step)


def fasta_lines(identifier: Column, seq: Column, tags: dict[str, Column] | None = None, width: int = 80) -> Column:
    """One record of FASTA: a header of id and ``key=value`` tags (nulls left out), the sequence wrapped at ``width``."""
    parts = [F.concat(F.lit(f" {k}="), v.cast("string")) for k, v in (tags or {}).items()]
    head = F.concat(F.lit(">"), identifier, *[F.coalesce(p, F.lit("")) for p in parts])
    body = F.rtrim(F.regexp_replace(F.coalesce(seq, F.lit("")), f"(.{{{width}}})", "$1\n"))
    return F.concat_ws("\n", head, F.when(body != "", F.regexp_replace(body, "\n$", "")))
