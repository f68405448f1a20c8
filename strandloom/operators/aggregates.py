"""Counting, summarising and comparing groups.

Every operator reduces partially before its shuffle. Rates state their denominator: a rate over nothing is null, never 0.
Windows without a partition only run over tables that are already one row per group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.runtime import running_before


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; null for an empty whole."""
    return F.when(whole != 0, part / whole)


def _everything() -> Window:
    return Window.partitionBy(F.lit(0))


def count_report(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key and their percentage of all."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(_everything()))


def crosstab(df: DataFrame, row: str, column: str, values: list, normalised: bool = False) -> DataFrame:
    """Counts of each ``column`` value per ``row``, missing ones 0, with the row total; or percentages of column totals."""
    cells = df.groupBy(row).agg(F.count("*").alias("total"), *[F.count_if(F.col(column).eqNullSafe(F.lit(v))).alias(str(v)) for v in values])
    if not normalised:
        return cells
    shares = [F.coalesce(ratio(100.0 * F.col(f"`{v}`"), F.sum(f"`{v}`").over(_everything())), F.lit(0.0)).alias(str(v)) for v in map(str, values)]
    return cells.select(row, "total", *shares)


def flag_rates(df: DataFrame, key: str, flag: str, size: str) -> DataFrame:
    """Per key: rows, rows with a known flag, its rate among those, and the mean size."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count(flag).alias("known"), F.avg(F.col(flag).cast("int")).alias("rate"), F.avg(size).alias("mean_size"))


def spread(df: DataFrame, key: str, value: str, within: float) -> DataFrame:
    """Per key: n, exact median, share of values up to ``within``, and the five-number summary."""
    five = F.percentile(value, F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    out = df.groupBy(key).agg(F.count(value).alias("n"), F.median(value).alias("median"), F.avg((F.col(value) <= within).cast("int")).alias("within"), five.alias("five"))
    names = ("minimum", "q1", "middle", "q3", "maximum")
    return out.select(key, "n", "median", "within", *[F.get("five", F.lit(i)).alias(name) for i, name in enumerate(names)])


def composition(df: DataFrame, group: str, category: str, entity: str) -> DataFrame:
    """Per (group, category): rows, distinct entities, and the category's rows over all groups."""
    cells = df.groupBy(group, category).agg(F.count("*").alias("n"), F.countDistinct(entity).alias("entities"))
    return cells.withColumn("category_total", F.sum("n").over(Window.partitionBy(category)))


def at_least(df: DataFrame, key: str, n: int) -> DataFrame:
    """Keys with at least ``n`` rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= n)


def pair_profile(df: DataFrame, group: str, text: str, order: str, cap: int | None = None) -> DataFrame:
    """Per (group, neighbouring pair): count and share over all texts, or the first ``cap`` of each group in ``order``.

    Pairs are counted in part before the shuffle, so a task sends one number per group and distinct pair.
    """
    from strandloom.functions.sequence import kmers
    from strandloom.runtime import spread

    rows = df.where(F.col(text).isNotNull())
    if cap is not None:
        first = Window.partitionBy(group).orderBy(order)
        rows = rows.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= cap)
    pairs = spread(rows.select(group, text)).select(group, F.explode_outer(kmers(F.upper(F.col(text)), 2)).alias("pair")).where("pair is not null")
    out = pairs.groupBy(group, "pair").agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def text_profile(df: DataFrame, group: str, text: str, order: str, cap: int | None = None) -> DataFrame:
    """(group, kind, item, n, share): in-frame codons, single bases and neighbouring pairs over all texts of a group, or
    over its first ``cap`` in ``order``; shares are within a kind. Counted in part before the shuffle."""
    from strandloom.functions.sequence import codons, kmers
    from strandloom.runtime import spread

    rows = df.where(F.col(text).isNotNull())
    if cap is not None:
        first = Window.partitionBy(group).orderBy(order)
        keep = rows.select(order, F.row_number().over(first).alias("__r")).where(F.col("__r") <= cap).select(order)
        rows = rows.join(keep, order, "left_semi")
    t = F.upper(F.col(text))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("items")) for k, v in (("codon", codons(F.col(text))), ("base", kmers(t, 1)), ("pair", kmers(t, 2)))]))
    items = spread(rows.select(group, text)).select(group, kinds.alias("k")).select(group, "k.kind", F.explode("k.items").alias("item"))
    out = items.groupBy(group, "kind", "item").agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group, "kind")))


def stop_mass(places: DataFrame, record: str, place: str, base: str, p_a: str, p_g: str) -> DataFrame:
    """(record, positions, stop_mass): mean probability that a codon's last base completes a stop, over its third places.

    ``places`` has a row a position, 0-based and without gaps, with its base and the probabilities of A and G there: after
    TA both complete a stop, after TG only A, after others none. A record's last whole codon is left out where it is a
    stop, as the end is meant to be there. Records without a whole codon have no row.
    """
    at = F.floor(F.col(place) / 3)
    parts = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.upper(base).alias("b"), F.col(p_a).alias("a"), F.col(p_g).alias("g"))))
    codons = places.groupBy(record, at.alias("codon")).agg(parts.alias("c")).where(F.size("c") == 3)
    two, third = F.concat(F.get("c", F.lit(0))["b"], F.get("c", F.lit(1))["b"]), F.get("c", F.lit(2))
    mass = F.when(two == "TA", third["a"] + third["g"]).when(two == "TG", third["a"]).otherwise(0.0)
    stop = ((two == "TA") & third["b"].isin("A", "G")) | ((two == "TG") & (third["b"] == "A"))
    own = codons.select(record, "codon", mass.alias("m"), stop.alias("stop"))
    # the last codon rides along in the aggregate instead of a window
    last = F.max(F.struct("codon", "stop", "m"))
    out = own.groupBy(record).agg(F.count("*").alias("n"), F.sum("m").alias("s"), last.alias("l"))
    n = F.col("n") - F.col("l.stop").cast("int")
    return out.select(record, n.alias("positions"), F.when(n > 0, (F.col("s") - F.when(F.col("l.stop"), F.col("l.m")).otherwise(0.0)) / n).alias("stop_mass"))


def enriched(df: DataFrame, category: str, entity: str, item: str, top: int, ceiling: float = 10.0) -> DataFrame:
    """Per category the ``top`` items by frequency times enrichment (at most ``ceiling``) among its distinct entities.

    frequency: share of the category's entities with the item; background: the same over all entities. Ties by item.
    """
    pairs = df.select(category, entity, item).where(F.col(item).isNotNull()).distinct()
    per = df.groupBy(category).agg(F.countDistinct(entity).alias("entities"))
    hits = pairs.groupBy(category, item).agg(F.count("*").alias("n"))
    hits = hits.withColumn("n_all", F.sum("n").over(Window.partitionBy(item)))
    both = hits.join(per, category).withColumn("all", per.agg(F.sum("entities")).scalar())
    both = both.withColumn("frequency", F.col("n") / F.col("entities")).withColumn("enrichment", F.col("frequency") / (F.col("n_all") / F.col("all")))
    scored = both.withColumn("score", F.col("frequency") * F.least("enrichment", F.lit(ceiling)))
    rank = F.row_number().over(Window.partitionBy(category).orderBy(F.desc(F.round("score", 9)), item))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select(category, item, "n", "frequency", "enrichment", "score", "rank")


def verdict_tally(df: DataFrame, verdicts: list[str]) -> DataFrame:
    """Per question (a column of PASS, FAIL, no_verdict, skipped): the four counts and PASS / (PASS + FAIL)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(q).alias("question"), F.coalesce(F.col(q), F.lit("skipped")).alias("v")) for q in verdicts])).alias("x")).select("x.question", "x.v")
    out = long.groupBy("question").agg(*[F.count_if(F.col("v") == v).alias(v) for v in ("PASS", "FAIL", "no_verdict", "skipped")])
    return out.withColumn("rate", ratio(F.col("PASS"), F.col("PASS") + F.col("FAIL")))


def headline(df: DataFrame, gates: list[str]) -> DataFrame:
    """One row: for each gate the passes and the rate over rows where that gate was evaluated."""
    cols = []
    for g in gates:
        done = F.col(g).isin("PASS", "FAIL")
        cols += [F.count_if(F.col(g) == "PASS").alias(f"{g}_pass"), F.count_if(done).alias(f"{g}_evaluated"), ratio(F.count_if(F.col(g) == "PASS"), F.count_if(done)).alias(f"{g}_rate")]
    return df.agg(*cols)


def funnel(df: DataFrame, gates: list[str]) -> DataFrame:
    """(stage, gate, passing, evaluated, rate): rows that pass all gates so far, over the rows where every gate was
    evaluated; one denominator, so stages can only shrink. Rates are null if no row was evaluated by all."""
    full = reduce(lambda a, b: a & b, [F.coalesce(F.col(g).isin("PASS", "FAIL"), F.lit(False)) for g in gates])
    cols, ok = [F.count_if(full).alias("evaluated")], full
    for i, g in enumerate(gates):
        ok = ok & (F.col(g) == "PASS")
        cols.append(F.count_if(ok).alias(f"s{i}"))
    stages = F.array(*[F.struct(F.lit(i + 1).alias("stage"), F.lit(g).alias("gate"), F.col(f"s{i}").alias("passing")) for i, g in enumerate(gates)])
    out = df.agg(*cols).select("evaluated", F.explode(stages).alias("x")).select("x.stage", "x.gate", "x.passing", "evaluated")
    return out.withColumn("rate", ratio(F.col("passing"), F.col("evaluated")))


def provenance(df: DataFrame, sources: str, authority: str) -> DataFrame:
    """Per (question, source) of a map column: rows, and whether the source is only a proxy for ``authority``."""
    long = df.select(F.explode(sources).alias("question", "source"))
    return long.groupBy("question", "source").agg(F.count("*").alias("n")).withColumn("proxy", ~F.col("source").isin(authority, "none"))


def arm_summary(df: DataFrame, keys: list[str], flags: list[str], values: list[str] = (), scored: Column | None = None) -> DataFrame:
    """Per arm: n, skipped, scored, rates of flags over scored rows only, and mean, sample sd and standard error of values."""
    own = F.lit(True) if scored is None else F.coalesce(scored, F.lit(False))
    aggs = [F.count("*").alias("n"), F.count_if(~own).alias("skipped"), F.count_if(own).alias("scored")]
    aggs += [ratio(F.count_if(own & F.col(f)), F.count_if(own & F.col(f).isNotNull())).alias(f"{f}_rate") for f in flags]
    for v in values:
        x = F.when(own, F.col(v))
        aggs += [F.avg(x).alias(f"{v}_mean"), F.stddev_samp(x).alias(f"{v}_sd"), ratio(F.stddev_samp(x), F.sqrt(F.count(x))).alias(f"{v}_se")]
    return df.groupBy(*keys).agg(*aggs)


def confusion(df: DataFrame, wanted: str, got: str) -> DataFrame:
    """(wanted, got, n) of rows with both labels."""
    return df.where(F.col(wanted).isNotNull() & F.col(got).isNotNull()).groupBy(F.col(wanted).alias("wanted"), F.col(got).alias("got")).agg(F.count("*").alias("n"))


def confusion_summary(cells: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Per wanted label: n, hits, recall, and over all: diagonal share and the share of the commonest wanted label.

    With ``labels`` (wanted) labels without rows appear with n 0 and a null recall.
    """
    per = cells.groupBy("wanted").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("wanted") == F.col("got"), F.col("n")).otherwise(0)).alias("hits"))
    w = _everything()
    per = per.withColumn("accuracy", F.sum("hits").over(w) / F.sum("n").over(w)).withColumn("prior", F.max("n").over(w) / F.sum("n").over(w))
    if labels is not None:
        zero = F.lit(0).cast("bigint")
        per = labels.select("wanted").distinct().join(per, "wanted", "left").withColumns({"n": F.coalesce("n", zero), "hits": F.coalesce("hits", zero)})
        per = per.withColumns({"accuracy": F.max("accuracy").over(w), "prior": F.max("prior").over(w)})
    return per.withColumn("recall", ratio(F.col("hits"), F.col("n")))


def ranking_metrics(df: DataFrame, truth: str, scores: str) -> DataFrame:
    """Per true label: n, top-1/3/5 rates, mean reciprocal rank and mean margin to the best other label.

    ``scores`` is a map label -> score. Rank: one more than the labels with a greater score, or an equal one and a lesser
    name. Rows whose map lacks the truth or has one entry only are left out.
    """
    own = F.try_element_at(scores, F.col(truth))
    others = F.filter(F.map_entries(scores), lambda e: e["key"] != F.col(truth))
    ahead = F.size(F.filter(others, lambda e: (e["value"] > own) | ((e["value"] == own) & (e["key"] < F.col(truth)))))
    rows = df.where(own.isNotNull() & (F.size(scores) > 1)).select(F.col(truth).alias("truth"), (ahead + 1).alias("rank"), (own - F.array_max(F.transform(others, lambda e: e["value"]))).alias("margin"))
    tops = [F.avg((F.col("rank") <= k).cast("int")).alias(f"top{k}") for k in (1, 3, 5)]
    return rows.groupBy("truth").agg(F.count("*").alias("n"), *tops, F.avg(1.0 / F.col("rank")).alias("mrr"), F.avg("margin").alias("margin"))


def effect_by_label(df: DataFrame, group: str, label: str, target: str, source: str, values: list[str], margin: float) -> DataFrame:
    """Per group: for each value the mean at ``target`` less that at ``source``, and how many exceed ``margin``.

    A group lacking one of the two labels is marked ``no_data`` and has null differences.
    """
    diffs = [(F.avg(F.when(F.col(label) == target, F.col(v))) - F.avg(F.when(F.col(label) == source, F.col(v)))).alias(f"{v}_shift") for v in values]
    out = df.groupBy(group).agg(*diffs)
    votes = reduce(lambda a, b: a + b, [F.coalesce((F.col(f"{v}_shift") > margin).cast("int"), F.lit(0)) for v in values])
    none = reduce(lambda a, b: a & b, [F.col(f"{v}_shift").isNull() for v in values])
    return out.withColumn("votes", votes).withColumn("verdict", F.when(none, "no_data").when(votes * 2 > len(values), "steers").otherwise("no_effect"))


def with_pooled(df: DataFrame, keys: list[str], aggs: list[Column], pooled: str = "POOLED") -> DataFrame:
    """Aggregates per ``keys`` and, in one pass, over all values of the first key (shown as ``pooled``)."""
    first, rest = keys[0], keys[1:]
    out = df.groupingSets([[F.col(k) for k in keys], [F.col(k) for k in rest]], *[F.col(k) for k in keys]).agg(F.grouping(first).alias("__pooled"), *aggs)
    return out.withColumn(first, F.when(F.col("__pooled") == 1, pooled).otherwise(F.col(first).cast("string"))).drop("__pooled")


def over_threshold(df: DataFrame, key: str, value: str, limit: float) -> DataFrame:
    """Per key: mean, exact median, greatest value and the share at or over ``limit``."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.max(value).alias("greatest"), F.avg((F.col(value) >= limit).cast("int")).alias("share_over"))


def joint_pass(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: rows that meet each condition, and those that meet all at once; null conditions are not met."""
    met = {k: F.coalesce(c, F.lit(False)) for k, c in conditions.items()}
    return df.agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in met.items()], F.count_if(reduce(lambda a, b: a & b, met.values())).alias("joint"))


def floor_quantiles(df: DataFrame, key: str, value: str, points: list[float]) -> DataFrame:
    """Per key the order statistics sorted[min(n - 1, int(q * (n - 1)))], without interpolation.

    Values are first counted, so the running sum is over distinct values rather than rows.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("__c"))
    ranked = running_before(counted, [key], value, "__c", "__to").withColumn("__to", F.col("__to") + F.col("__c"))
    sizes = counted.groupBy(F.col(key).alias("__k")).agg(F.sum("__c").alias("__n"))
    ranked = ranked.join(sizes, ranked[key].eqNullSafe(sizes["__k"])).drop("__k")
    picks = [F.min(F.when(F.col("__to") > F.floor(F.lit(q) * (F.col("__n") - 1)), F.col(value))).alias(f"q{round(q * 100)}") for q in points]
    return ranked.groupBy(key).agg(F.max("__n").alias("n"), *picks)


def weighted_mean(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Per key sum(value * weight) / sum(weight) over rows with both."""
    known = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    return known.groupBy(key).agg(ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("weighted"), F.sum(weight).alias("weight"))


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(f"distinct_{c}") for c in columns])


def micro_macro(df: DataFrame, key: str, part: str, whole: str) -> DataFrame:
    """Per key: ratio of sums, and mean, median, least and greatest of the rows' ratios; rows without whole left out."""
    rows = df.where(F.col(whole) > 0).withColumn("__r", F.col(part) / F.col(whole))
    return rows.groupBy(key).agg(F.count("*").alias("n"), (F.sum(part) / F.sum(whole)).alias("micro"), F.avg("__r").alias("macro"), F.median("__r").alias("median"), F.min("__r").alias("least"), F.max("__r").alias("greatest"))


def limit_effects(df: DataFrame, value: str, limits: list[int]) -> DataFrame:
    """Per limit: share of rows that fit, share of rows cut, share of the total beyond the limit. One scan."""
    aggs = []
    for x in limits:
        aggs += [F.avg((F.col(value) <= x).cast("int")).alias(f"f{x}"), F.avg((F.col(value) > x).cast("int")).alias(f"c{x}"), ratio(F.sum(F.greatest(F.col(value) - x, F.lit(0))), F.sum(value)).alias(f"m{x}")]
    row = df.where(F.col(value).isNotNull()).agg(*aggs)
    out = F.array(*[F.struct(F.lit(x).alias("at_limit"), F.col(f"f{x}").alias("fits"), F.col(f"c{x}").alias("cut"), F.col(f"m{x}").alias("lost")) for x in limits])
    return row.select(F.explode(out).alias("x")).select("x.at_limit", "x.fits", "x.cut", "x.lost")


def log_histogram(df: DataFrame, key: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Per key and bin of equal width in log10: count; values outside [low, high] are bins 0 and bins + 1."""
    at = F.width_bucket(F.log10(F.col(value)), F.log10(F.lit(low)), F.log10(F.lit(high)), F.lit(bins))
    return df.where(F.col(value) > 0).groupBy(key, at.alias("bin")).agg(F.count("*").alias("n"))


def manifest(df: DataFrame, key: str, group: str, content: str, value: str, least_rows: int, least_groups: int) -> DataFrame:
    """Per key: rows, groups, repeated contents, median value, and the reasons why the key is not viable (empty: it is)."""
    out = df.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(group).alias("groups"), (F.count(content) - F.countDistinct(content)).alias("repeats"), F.median(value).alias("median"))
    reasons = F.array_compact(F.array(F.when(F.col("n") < least_rows, F.lit(f"rows<{least_rows}")), F.when(F.col("groups") < least_groups, F.lit(f"groups<{least_groups}"))))
    return out.withColumn("reasons", F.array_join(reasons, ",")).withColumn("viable", F.size(reasons) == 0)


def split_overlap(df: DataFrame, split: str, entity: str) -> DataFrame:
    """(split_a, split_b, shared): distinct entities that occur in both splits, for every pair of splits."""
    per = df.where(F.col(split).isNotNull() & F.col(entity).isNotNull()).groupBy(entity).agg(F.array_sort(F.collect_set(split)).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    return per.where(F.size("s") > 1).select(F.explode(pairs).alias("p")).groupBy("p.split_a", "p.split_b").agg(F.count("*").alias("shared"))


def dose_response(df: DataFrame, dose: str, value: str, flipped: str) -> DataFrame:
    """Per dose: n, mean, median and the rate of flips."""
    return df.groupBy(dose).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.avg(F.col(flipped).cast("int")).alias("flip_rate"))


def lowest_dose(curve: DataFrame, dose: str, value: str, limit: float) -> DataFrame:
    """One row: the least dose at which the value reaches ``limit``; null if none does."""
    return curve.agg(F.min(F.when(F.col(value) >= limit, F.col(dose))).alias("lowest"))


def list_means(df: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """Per key and list column: the mean of all members with its own denominator; null members do not count."""
    aggs = []
    for c in lists:
        known = F.filter(F.col(c), lambda x: x.isNotNull())
        aggs += [F.sum(F.coalesce(F.size(known), F.lit(0))).alias(f"{c}_n"), ratio(F.sum(F.aggregate(known, F.lit(0.0), lambda s, x: s + x.cast("double"))), F.sum(F.coalesce(F.size(known), F.lit(0)))).alias(f"{c}_mean")]
    return df.groupBy(key).agg(*aggs)


def nested_peak(df: DataFrame, key: str, lists: str, at: int = 1) -> DataFrame:
    """Per key the greatest ``at``-th member of a list column; shorter and null lists do not count."""
    return df.groupBy(key).agg(F.max(F.try_element_at(F.col(lists), F.lit(at))).alias("peak"))


def detection(df: DataFrame, key: str, detected: str, matched: str, products: str) -> DataFrame:
    """Per key: n, errors (detected is null), detection rate over the rest, match rate among the detected, and products."""
    hit = F.coalesce(F.col(detected), F.lit(False))
    return df.groupBy(key).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(detected).isNull()).alias("errors"),
        F.avg(F.col(detected).cast("int")).alias("detection_rate"),
        ratio(F.count_if(hit & F.col(matched)), F.count_if(hit)).alias("match_rate"),
        F.countDistinct(F.when(hit, F.col(products))).alias("products"),
    )


def ratio_of_groups(df: DataFrame, group: str, window: str, value: str, one: str, other: str) -> DataFrame:
    """Per window: the mean of each of two groups and their ratio; windows that lack one have a null ratio."""
    out = df.groupBy(window).agg(F.avg(F.when(F.col(group) == one, F.col(value))).alias("one"), F.avg(F.when(F.col(group) == other, F.col(value))).alias("other"))
    return out.withColumn("ratio", ratio(F.col("one"), F.col("other")))


def delta_to_first(df: DataFrame, step: str, value: str) -> DataFrame:
    """Per step: mean value and its difference from that of the least step."""
    out = df.groupBy(step).agg(F.avg(value).alias("mean"))
    return out.withColumn("delta", F.col("mean") - F.first("mean").over(Window.partitionBy(F.lit(0)).orderBy(step)))


def masked_means(df: DataFrame, record: str, value: str, inside: str) -> DataFrame:
    """Per record: mean of the value inside and outside of the mask; null where one is empty."""
    return df.groupBy(record).agg(F.avg(F.when(F.col(inside), F.col(value))).alias("inside"), F.avg(F.when(~F.col(inside), F.col(value))).alias("outside"))


def kept_and_gained(df: DataFrame, before: str, after: str) -> DataFrame:
    """One row: rates of ``after`` among rows that had ``before`` (kept) and among those that had not (gained)."""
    b, a = F.col(before), F.col(after)
    return df.agg(F.count_if(b).alias("had"), ratio(F.count_if(b & a), F.count_if(b)).alias("kept"), ratio(F.count_if(~b & a), F.count_if(~b)).alias("gained"))


def require_positive(df: DataFrame, flag: str, what: str) -> DataFrame:
    """``df``, which fails when run if no row has ``flag``: a control that never fires cannot support a comparison."""
    fired = F.max(F.coalesce(F.col(flag), F.lit(False))).over(_everything())
    return df.withColumn("__ok", F.when(fired, True).otherwise(F.raise_error(F.lit(f"{what}: the control rate is 0")).cast("boolean"))).where("__ok").drop("__ok")


def delta_to_baseline(df: DataFrame, arm: str, baseline: str, values: list[str], on: list[str] = ()) -> DataFrame:
    """Rows of all arms with each value's difference from the baseline arm's row (per ``on``)."""
    base = df.where(F.col(arm) == baseline).select(*on, *[F.col(v).alias(f"__b_{v}") for v in values])
    if not on:
        row = base.agg(*[F.first(f"__b_{v}").alias(f"__b_{v}") for v in values])
        joined = df.withColumn("__b", row.select(F.struct(*row.columns)).scalar()).select(*df.columns, "__b.*")
    else:
        joined = df.join(base, list(on), "left")
    return joined.select(*df.columns, *[(F.col(v) - F.col(f"__b_{v}")).alias(f"{v}_delta") for v in values])


def table_diff(a: DataFrame, b: DataFrame, key: str, columns: list[str], benign: list[str]) -> DataFrame:
    """(key, kind, differing): rows of two result tables that differ; ``missing`` on one side, ``benign`` if only benign
    columns differ, else ``fatal``. Nulls equal nulls."""
    x = a.select(F.col(key), F.struct(*columns).alias("x"))
    y = b.select(F.col(key), F.struct(*columns).alias("y"))
    j = x.join(y, key, "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), F.lit(c)) for c in columns]))
    kind = F.when(F.col("x").isNull() | F.col("y").isNull(), "missing").when(F.size(F.array_except(changed, F.array(*map(F.lit, benign)) if benign else F.array().cast("array<string>"))) > 0, "fatal").otherwise("benign")
    return j.where((F.size(changed) > 0) | F.col("x").isNull() | F.col("y").isNull()).select(key, kind.alias("kind"), F.array_join(changed, ",").alias("differing"))
