"""Checks on measured columns, verdicts with their source, and nothing that turns a missing measurement into a result.

A check gives true, false or null (measured but undecided); ``skipped`` says that it was not measured. Tables of rules
(markers of a class, module patterns) are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def verdict(passed: Column, skipped: Column | None = None) -> Column:
    """PASS, FAIL, no_verdict for null, skipped where it was not measured."""
    out = F.when(passed, "PASS").when(~passed, "FAIL").otherwise("no_verdict")
    return out if skipped is None else F.when(F.coalesce(skipped, F.lit(True)), "skipped").otherwise(out)


def coding_sanity(density: Column, genes: Column, longest: Column, entropy: Column) -> Column:
    """Enough of the sequence codes, in at least one gene, the longest of some length, and it is not monotonous."""
    return F.coalesce((density >= 0.5) & (genes >= 1) & (longest >= 100) & (entropy >= 2.5), F.lit(False))


def composite(checks: list[Column], least: int) -> Column:
    """Whether at least ``least`` of the checks hold; null ones do not."""
    return sum((F.coalesce(c.cast("int"), F.lit(0)) for c in checks), F.lit(0)) >= least


def faithful(gc: Column, gc_range: tuple[float, float], adaptation: Column, least_adaptation: float, distance: Column, most_distance: float, known: Column) -> Column:
    """Whether two of GC share, codon adaptation and pair distance agree with a profile; null without a profile."""
    checks = [(gc >= gc_range[0]) & (gc <= gc_range[1]), adaptation >= least_adaptation, distance < most_distance]
    return F.when(known, composite(checks, 2))


def class_match(expected: Column, found: Column, parts: dict[str, list[str]] | None = None) -> Column:
    """Whether the expected class is among those found; a class of ``parts`` also if all its parts are. Null without any."""
    hit = F.array_contains(found, expected)
    for name, need in (parts or {}).items():
        hit = hit | ((expected == name) & (F.size(F.array_except(F.array(*map(F.lit, need)), found)) == 0))
    return F.when(F.size(found) > 0, hit)


def cluster_detection(df: DataFrame, row: str, expected: str, products: str, words: DataFrame, word: str, value: str, parts: dict[str, list[str]] | None = None) -> DataFrame:
    """(row, detected, found, unmapped, matched): the classes that a row's products map to, and products the map lacks.

    ``products`` is an array; case and blanks do not matter for the map, of several classes the first in order counts.
    detected: there is any product. matched: ``class_match`` of what was found; false where nothing was detected, null
    where only unmapped products were.
    """
    known = words.where(F.col(word).isNotNull() & F.col(value).isNotNull()).groupBy(F.lower(F.trim(word)).alias("__w")).agg(F.min(value).alias("__c"))
    each = df.select(row, F.explode(products).alias("__p")).where("__p is not null").withColumn("__w", F.lower(F.trim("__p"))).join(known, "__w", "left")
    per = each.groupBy(row).agg(F.array_sort(F.collect_set("__c")).alias("found"), F.array_sort(F.collect_set(F.when(F.col("__c").isNull(), F.col("__p")))).alias("unmapped"))
    both = df.select(row, expected).join(per, row, "left")
    none = F.array().cast("array<string>")
    out = F.when(F.col("found").isNull(), False).otherwise(class_match(F.col(expected), F.col("found"), parts))
    return both.select(row, F.col("found").isNotNull().alias("detected"), F.coalesce("found", none).alias("found"), F.coalesce("unmapped", none).alias("unmapped"), out.alias("matched"))


def run_checks(df: DataFrame, checks: dict[str, tuple[Column, Column]], skip: list[str] = ()) -> DataFrame:
    """Adds a verdict column for each check, name -> (passed, skipped), and ``failed``, the names of those that failed.

    Checks of ``skip`` are skipped in every row and not computed.
    """
    out = {n: F.lit("skipped") if n in skip else verdict(p, s) for n, (p, s) in checks.items()}
    failed = F.array_compact(F.array(*[F.when(v == "FAIL", F.lit(n)) for n, v in out.items()]))
    return df.withColumns(out | {"failed": failed})


def marker_check(df: DataFrame, row: str, expected: str, hits: DataFrame, item: str, markers: DataFrame, marker: str, label: str, neutral: str = "OTHER") -> DataFrame:
    """(row, present, missing, unknown_class, passed): which markers of its class a row has.

    passed: any is there. Null for the ``neutral`` class and for classes without markers (unknown_class).
    """
    per = markers.where(F.col(label).isNotNull() & F.col(marker).isNotNull()).groupBy(F.col(label).alias("__c")).agg(F.array_sort(F.collect_set(marker)).alias("need"))
    known = markers.select(F.col(marker).alias("__m")).where("__m is not null").distinct()
    own = hits.select(F.col(row), F.col(item).alias("__m")).distinct().join(known, "__m", "left_semi").groupBy(row).agg(F.array_sort(F.collect_set("__m")).alias("have"))
    both = df.select(row, F.col(expected).alias("__c")).join(per, "__c", "left").join(own, row, "left")
    have, need = F.coalesce("have", F.array().cast("array<string>")), F.col("need")
    present = F.array_intersect(need, have)
    out = F.when((F.col("__c") == neutral) | need.isNull(), F.lit(None).cast("boolean")).otherwise(F.size(present) > 0)
    return both.select(row, F.array_join(present, ",").alias("present"), F.array_join(F.array_except(need, have), ",").alias("missing"), need.isNull().alias("unknown_class"), out.alias("passed"))


def novelty_check(containment: Column, fail: float = 0.95, warn: float = 0.8) -> tuple[Column, Column]:
    """(passed, skipped): false from ``fail`` on, undecided from ``warn`` on; without a measurement it is skipped."""
    return F.when(containment >= fail, False).when(containment >= warn, F.lit(None)).when(containment.isNotNull(), True), containment.isNull()


def homology_check(df: DataFrame, row: str, genes: DataFrame, order: str, hits: DataFrame, gene: str, first: int = 20, least: float = 0.5) -> DataFrame:
    """(row, genes, with_hit, passed): share of a row's first ``first`` genes that have a hit; none at all fails, no gene is null."""
    rank = F.row_number().over(Window.partitionBy(row).orderBy(order))
    few = genes.withColumn("__r", rank).where(F.col("__r") <= first)
    flags = hits.select(row, gene).distinct().withColumn("__hit", F.lit(1))
    per = few.join(flags, [row, gene], "left").groupBy(row).agg(F.count("*").alias("genes"), F.count("__hit").alias("with_hit"))
    out = df.select(row).distinct().join(per, row, "left").withColumns({"genes": F.coalesce("genes", F.lit(0).cast("bigint")), "with_hit": F.coalesce("with_hit", F.lit(0).cast("bigint"))})
    return out.withColumn("passed", F.when(F.col("genes") > 0, F.col("with_hit") / F.col("genes") >= least))


def ordered_count(items: Column, pattern: list[str]) -> Column:
    """How often the pattern occurs in order and without overlap, other items between allowed (greedy)."""
    want = F.array(*map(F.lit, pattern))
    step = F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"))

    def go(s: Column, x: Column) -> Column:
        hit = x == F.get(want, s["at"])
        full = hit & (s["at"] == len(pattern) - 1)
        return F.struct((s["n"] + full.cast("int")).alias("n"), F.when(full, 0).when(hit, s["at"] + 1).otherwise(s["at"]).alias("at"))

    return F.aggregate(items, step, go, lambda s: s["n"])


def module_count(items: Column, pattern: list[str]) -> Column:
    """How many modules the items would make if order did not matter: the least count over the pattern."""

    def count(item: str) -> Column:
        return F.size(F.filter(items, lambda x: x == item))

    return F.array_min(F.array(*map(count, pattern)))


def module_architecture(hits: DataFrame, row: str, start: Column, item: str, pattern: list[str]) -> DataFrame:
    """(row, module_count, ordered_count, in_order, passed): modules of a pattern along the sequence, by place of the domain."""
    own = hits.where(F.col(item).isin(*pattern))
    seq = own.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct(start.alias("p"), F.col(item).alias("i")))), lambda x: x["i"]).alias("items"))
    out = seq.select(row, module_count(F.col("items"), pattern).alias("module_count"), ordered_count(F.col("items"), pattern).alias("ordered_count"))
    return out.withColumn("in_order", F.when(F.col("module_count") > 0, F.col("ordered_count") / F.col("module_count"))).withColumn("passed", F.col("ordered_count") >= 1)


def majority(df: DataFrame, row: str, value: str, limit: float) -> DataFrame:
    """(row, scored, over, passed): more than half of those that were scored reach the limit; null if none was scored."""
    out = df.groupBy(row).agg(F.count(value).alias("scored"), F.count_if(F.col(value) >= limit).alias("over"))
    return out.withColumn("passed", F.when(F.col("scored") > 0, F.col("over") * 2 > F.col("scored")))


def probe_check(probabilities: Column, expected: Column) -> Column:
    """Whether the likeliest class is the expected one; null for a class that the probe does not know."""
    from strandloom.functions.names import map_best

    return F.when(F.try_element_at(probabilities, expected).isNotNull(), map_best(probabilities) == expected)


def derived(authority: Column, proxy: Column, floor: Column, names: tuple[str, str, str]) -> tuple[Column, Column]:
    """(verdict, source): the authority's where it has one, else the proxy's, else the floor's, with which it was.

    Inputs are verdicts; ``skipped`` and null mean not available. Nothing available: skipped, source none.
    """
    out, source = F.lit("skipped"), F.lit("none")
    for v, name in reversed(list(zip((authority, proxy, floor), names, strict=True))):
        there = v.isNotNull() & (v != "skipped")
        out, source = F.when(there, v).otherwise(out), F.when(there, name).otherwise(source)
    return out, source


def require_resource(df: DataFrame, available: bool, gating: bool, check: str) -> DataFrame:
    """Missing resources: a gating check raises at once, a diagnostic one is marked skipped in a column named after it."""
    if not available and gating:
        raise FileNotFoundError(f"{check} cannot run: its resource is missing")
    return df.withColumn(f"{check}_skipped", F.lit(not available))


def usable_dose(df: DataFrame, dose: str, value: str, length: str, control: float) -> DataFrame:
    """(dose, mean, low, length_ratio, usable): doses whose mean less 1.645 standard errors exceeds the control's mean and whose
    mean length is within a tenth of the control's (the rows of dose ``control``)."""
    base = df.where(F.col(dose) == control).agg(F.struct(F.avg(value).alias("m"), F.avg(length).alias("l"))).scalar()
    out = df.groupBy(dose).agg(F.avg(value).alias("mean"), (F.avg(value) - 1.645 * F.stddev_samp(value) / F.sqrt(F.count(value))).alias("low"), F.avg(length).alias("__n"))
    out = out.withColumn("__b", base).withColumn("length_ratio", F.col("__n") / F.nullif(F.col("__b.l"), F.lit(0.0)))
    return out.select(dose, "mean", "low", "length_ratio", ((F.col("low") > F.col("__b.m")) & (F.abs(F.col("length_ratio") - 1) <= 0.1)).alias("usable"))
