"""Splits, budgets and samples. Random choices order rows by MD5 of seed and key, so any engine can repeat them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import blocks
from strandloom.runtime import rank_by_md5, salted_join


def md5_order(key: Column, seed: str) -> Column:
    return F.md5(F.encode(F.concat(F.lit(f"{seed}|"), key.cast("string")), "utf-8"))


def stratified_split(df: DataFrame, row: str, label: str, val: float, test: float, seed: str = "0") -> DataFrame:
    """(row, label, split): per label max(1, round(n * share)) rows to test, then to val, the rest to train; a label too small
    for a training row goes to train whole."""
    sizes = df.groupBy(label).agg(F.count("*").alias("__n"))
    sizes = sizes.withColumn("__v", F.greatest(F.lit(1), F.round(F.col("__n") * val).cast("int"))).withColumn("__t", F.greatest(F.lit(1), F.round(F.col("__n") * test).cast("int")))
    ranked = rank_by_md5(df.select(row, label), [label], row, "__r", seed)
    both = ranked.join(sizes, ranked[label].eqNullSafe(sizes[label])).select(ranked[row], ranked[label], "__r", "__n", "__v", "__t")
    split = F.when(F.col("__n") - F.col("__v") - F.col("__t") < 1, "train").when(F.col("__r") <= F.col("__t"), "test").when(F.col("__r") <= F.col("__t") + F.col("__v"), "val").otherwise("train")
    return both.select(row, label, split.alias("split"))


def _dealt(score: Callable[[int, np.ndarray], np.ndarray], splits: int, m: int, at_once: int = 1 << 20) -> Iterator[tuple[int, int, int]]:
    """(split, low, high): runs of ``m`` equal items dealt one by one to the split with the greatest score; ties: the first.

    ``score`` gives a split's score when it has got 0, 1, 2, ... of them and falls with that number, so the order in which
    items are dealt is that of all scores sorted, and no step depends on the one before.
    """
    taken, low = np.zeros(splits, np.int64), 0
    while low < m:
        n = min(m - low, at_once)
        values = np.concatenate([score(s, taken[s] + np.arange(n)) for s in range(splits)])
        picks = np.lexsort((np.repeat(np.arange(splits), n), -values))[:n] // n
        taken += np.bincount(picks, minlength=splits)
        ends = np.append(np.flatnonzero(np.diff(picks)) + 1, n)
        yield from zip(picks[ends - 1].tolist(), (low + np.append(0, ends[:-1])).tolist(), (low + ends).tolist(), strict=True)
        low += n


def assign_groups(df: DataFrame, group: str, label: str, shares: dict[str, float]) -> DataFrame:
    """(group, split): whole groups to splits, greedily, the largest first.

    A group goes to the split with the greatest sum over its labels of rows * (share still open of that label); ties: the
    first split. Groups of equal composition are alike, so the greedy pass sees one line per composition and how many
    groups have it; order: size, composition, and within one composition the group key. Only compositions reach the
    single task; the groups are ranked and joined back in parallel.
    """
    cells = df.groupBy(group, label).agg(F.count("*").alias("n"))
    parts = cells.groupBy(group).agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(label).cast("string"), F.lit("")).alias("c"), "n"))).alias("cells"))
    parts = parts.withColumn("key", F.to_json("cells"))
    kinds = parts.groupBy("key", "size").agg(F.count("*").alias("m"), F.first("cells").alias("cells"))
    names = list(shares)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable")
        rows = [({c["c"]: c["n"] for c in cs}, int(m), k) for cs, m, k in zip(pdf["cells"], pdf["m"], pdf["key"], strict=True)]
        totals: dict[str, int] = {}
        for cs, m, _ in rows:
            for c, n in cs.items():
                totals[c] = totals.get(c, 0) + n * m
        have = {s: dict.fromkeys(totals, 0.0) for s in names}
        out = []
        for cs, m, key in rows:

            def open_share(k: int, got: np.ndarray, cs: dict[str, int] = cs) -> np.ndarray:
                return sum(n * (totals[c] * shares[names[k]] - (have[names[k]][c] + got * n)) / totals[c] for c, n in cs.items())

            for k, low, high in list(_dealt(open_share, len(names), m)):
                out.append([key, names[k], low, high])
                for c, n in cs.items():
                    have[names[k]][c] += n * (high - low)
        return pd.DataFrame(out, columns=["key", "split", "low", "high"])

    plan = kinds.groupBy(F.lit("all")).applyInPandas(greedy, "key string, split string, low bigint, high bigint")
    ranked = parts.select(group, "key").withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(group)))
    return ranked.join(plan, "key").where("r > low and r <= high").select(group, "split")


def routed(df: DataFrame, assignment: DataFrame, group: str) -> DataFrame:
    """Every row with the split of its group; a group that holds many rows is joined in parts."""
    return salted_join(df, assignment, [group])


def deficit_split(df: DataFrame, label: str, group: str, shares: dict[str, float]) -> DataFrame:
    """(label, group, split): within each label whole groups, largest first, to the split furthest below its quota in relative
    terms; ties: the first split. Labels are independent; a task gets one label's table of group sizes with their counts."""
    sizes = df.groupBy(label, group).agg(F.count("*").alias("size"))
    ranked = sizes.withColumn("r", F.row_number().over(Window.partitionBy(label, "size").orderBy(group)))
    kinds = sizes.groupBy(label, "size").agg(F.count("*").alias("m"))
    names = list(shares)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        total = int((pdf["size"] * pdf["m"]).sum())
        have = dict.fromkeys(names, 0)
        out = []
        for size, m in sorted(zip(pdf["size"].tolist(), pdf["m"].tolist(), strict=True), reverse=True):

            def deficit(k: int, got: np.ndarray, size: int = size) -> np.ndarray:
                quota = shares[names[k]] * total
                return (quota - (have[names[k]] + got * size)) / max(quota, 1e-9)

            runs = list(_dealt(deficit, len(names), m))
            for k, low, high in runs:
                out.append([size, names[k], low, high])
                have[names[k]] += size * (high - low)
        res = pd.DataFrame(out, columns=["size", "split", "low", "high"])
        res.insert(0, "label", pdf[label].iloc[0])
        return res

    plan = kinds.groupBy(label).applyInPandas(greedy, "label string, size bigint, split string, low bigint, high bigint")
    both = ranked.join(plan, (ranked[label].eqNullSafe(plan["label"])) & (ranked["size"] == plan["size"]))
    return both.where("r > low and r <= high").select(ranked[label], ranked[group], "split")


def torn_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups with rows in more than one split; empty for a sound split."""
    return df.where(F.col(split).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def require_disjoint(df: DataFrame, group: str, split: str) -> DataFrame:
    """``df`` itself, if no group has rows in more than one split; the query fails where one has.

    The number of torn groups is one value that every row is checked against, so nothing is joined or collected.
    """
    torn = torn_groups(df, group, split).agg(F.count("*")).scalar()
    checked = df.withColumn("__torn", torn)
    fine = F.when(F.col("__torn") == 0, True).otherwise(F.raise_error(F.concat(F.col("__torn").cast("string"), F.lit(f" groups of {group} are in more than one {split}"))).cast("boolean"))
    return checked.where(fine).drop("__torn")


def viability(df: DataFrame, label: str, group: str, split: str, least: dict[str, int], least_groups: int) -> DataFrame:
    """(label, groups, reasons): per label the minimums it misses; no reasons means viable."""
    counts = [F.count_if(F.col(split) == s).alias(f"n_{s}") for s in least]
    out = df.groupBy(label).agg(F.countDistinct(group).alias("groups"), *counts)
    reasons = [F.when(F.col(f"n_{s}") < n, F.lit(f"{s}<{n}")) for s, n in least.items()] + [F.when(F.col("groups") < least_groups, F.lit(f"groups<{least_groups}"))]
    return out.select(label, "groups", F.array_join(F.array_compact(F.array(*reasons)), ",").alias("reasons"))


def budget_cells(df: DataFrame, label: str, cell: list[str], budget: int, floor: int = 1) -> DataFrame:
    """(label, cell..., available, quota): each label's budget over its cells in proportion to what is available.

    Whole parts first, the rest by largest remainder (ties: cell order), never more than there is; then every cell gets
    ``floor`` (or all it has), borrowed from the cell with the most to spare. A label within budget keeps everything.
    """
    cells = df.groupBy(label, *cell).agg(F.count("*").alias("available"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema)

    def allot(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cell, kind="stable", na_position="first").reset_index(drop=True)
        have = pdf["available"].tolist()
        total = sum(have)
        if total <= budget:
            return pdf.assign(quota=have)
        raw = [budget * n / total for n in have]
        quota = [math.floor(x) for x in raw]
        for i in sorted(range(len(have)), key=lambda i: (-(raw[i] - quota[i]), i))[: budget - sum(quota)]:
            quota[i] += 1
        for i, n in enumerate(have):
            while quota[i] < min(floor, n):
                j = max((j for j in range(len(have)) if j != i), key=lambda j: (quota[j] - min(floor, have[j]), -j))
                if quota[j] <= min(floor, have[j]):
                    break
                quota[j] -= 1
                quota[i] += 1
        return pdf.assign(quota=quota)

    return cells.groupBy(label).applyInPandas(allot, f"{fields}, quota bigint")


def capped(df: DataFrame, row: str, label: str, forced: Column, cap: int, seed: str = "0") -> DataFrame:
    """Forced rows, all of them, and as many others per label as the cap leaves room for; forced rows may exceed the cap."""
    f = F.coalesce(forced, F.lit(False))
    used = df.groupBy(label).agg(F.count_if(f).alias("__f"))
    others = rank_by_md5(df.where(~f).select(row, label), [label], row, "__r", seed)
    both = others.join(used, others[label].eqNullSafe(used[label])).where(F.col("__r") <= F.greatest(F.lit(cap) - F.col("__f"), F.lit(0))).select(others[row])
    return df.where(f).unionByName(df.where(~f).join(both, row, "left_semi"))


def balanced(df: DataFrame, row: str, label: str, k: int, seed: str = "0") -> DataFrame:
    """At most ``k`` rows of each label, at random."""
    few = rank_by_md5(df.select(row, label), [label], row, "__r", seed).where(F.col("__r") <= k).select(row)
    return df.join(few, row, "left_semi")


def parity(df: DataFrame, row: str, label: str, minority: list[str], seed: str = "0") -> DataFrame:
    """All rows of the minority labels, and of each other label an equal part so that the others together are as many."""
    inside = F.col(label).isin(*minority)
    target = df.agg(F.count_if(inside).alias("__m"), F.countDistinct(F.when(~inside, F.col(label))).alias("__l")).select(F.floor(F.col("__m") / F.greatest(F.col("__l"), F.lit(1)))).scalar()
    others = rank_by_md5(df.where(~inside).select(row, label), [label], row, "__r", seed)
    keep = others.where(F.col("__r") <= target).select(row)
    return df.where(inside).unionByName(df.where(~inside).join(keep, row, "left_semi"))


def fixed_sample(df: DataFrame, row: str, k: int, seed: str = "0") -> DataFrame:
    """``k`` rows at random: those with the least digests. A top-k, so each task sends k rows at most."""
    return df.withColumn("__h", md5_order(F.col(row), seed)).orderBy("__h", row).limit(k).drop("__h")


def matched_bins(df: DataFrame, row: str, label: str, value: str, bins: int, seed: str = "0") -> DataFrame:
    """Equal numbers of each label in each quantile bin of ``value``; bins with fewer than two labels are dropped."""
    edges = F.percentile(value, F.array(*[F.lit(i / bins) for i in range(1, bins)])) if bins > 1 else F.array().cast("array<double>")
    cut = df.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    rows = cut.withColumn("__e", cut.agg(edges).scalar()).withColumn("bin", F.size(F.filter("__e", lambda e: e < F.col(value)))).drop("__e")
    sizes = rows.groupBy("bin", label).agg(F.count("*").alias("__n"))
    least = sizes.groupBy("bin").agg(F.min("__n").alias("__k"), F.count("*").alias("__l")).where("__l > 1")
    ranked = rank_by_md5(rows.select(row, label, "bin"), ["bin", label], row, "__r", seed)
    return ranked.join(least, "bin").where("__r <= __k").select(row, label, "bin")


def shuffled(text: Column, key: Column, seed: str, unit: int = 1) -> Column:
    """The text's characters (or groups of ``unit``, such as codons; a rest at the end is dropped) in a random order."""
    parts = F.transform(blocks(text, unit), lambda t, i: F.struct(F.xxhash64(F.lit(seed), key, i).alias("h"), i.alias("i"), t.alias("t")))
    return F.when(text.isNotNull(), F.array_join(F.transform(F.array_sort(parts), lambda p: p["t"]), ""))


def experiment_plan(df: DataFrame, taxon: str, labels: list[str], repeats: int) -> DataFrame:
    """Every taxon with every label and repeat."""
    plan = F.explode(F.flatten(F.transform(F.array(*map(F.lit, labels)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda r: F.struct(c.alias("label"), r.alias("repeat"))))))
    return df.select(taxon).where(F.col(taxon).isNotNull()).distinct().select(taxon, plan.alias("p")).select(taxon, "p.label", "p.repeat")


def prompt_set(df: DataFrame, row: str, split: str, n: int) -> DataFrame:
    """The first ``n`` rows of test, filled up from val, in row order."""
    order = F.when(F.col(split) == "test", 0).when(F.col(split) == "val", 1)
    return df.withColumn("__o", order).where("__o is not null").orderBy("__o", row).limit(n).drop("__o")


def folds(df: DataFrame, row: str, label: str, group: str, k: int, seed: str = "0") -> DataFrame:
    """(row, label, fold, group_fold, shuffled_label): stratified folds, folds that keep groups together, and as a control
    each row with the label of the row of equal rank in another random order."""
    ranked = rank_by_md5(df.select(row, label, group), [label], row, "__r", seed)
    group_fold = F.pmod(F.conv(F.substring(md5_order(F.coalesce(F.col(group).cast("string"), F.lit("")), seed), 1, 8), 16, 10).cast("bigint"), F.lit(k)).cast("int")
    out = ranked.withColumn("fold", F.pmod(F.col("__r") - 1, F.lit(k)).cast("int")).withColumn("group_fold", group_fold)
    a = rank_by_md5(out, [], row, "__a", seed)
    b = rank_by_md5(out.select(F.col(row), F.col(label).alias("shuffled_label")), [], row, "__a", f"{seed}-labels").select("__a", "shuffled_label")
    return a.join(b, "__a").select(row, label, "fold", "group_fold", "shuffled_label")
