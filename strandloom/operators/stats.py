"""Tests on small numbers that aggregates produce. Exact sums run on one row per group, in Arrow batches where they need loops."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.runtime import rank_by_md5, running_before


def _batch(fn: Callable[..., float | None], *columns: Column) -> Column:
    @F.pandas_udf("double")
    def run(*values: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(x) for x in row) else fn(*row) for row in zip(*values, strict=True)], dtype="float64")

    return run(*columns)


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def sign_p(wins: int, losses: int) -> float:
    """Two-sided exact probability of a split at least as uneven under a fair coin; 1.0 for none."""
    n, k = int(wins + losses), int(min(wins, losses))
    if n == 0:
        return 1.0
    return min(1.0, 2 * sum(math.exp(_log_choose(n, i) - n * math.log(2)) for i in range(k + 1)))


def sign_p_one_sided(wins: int, losses: int) -> float:
    n = int(wins + losses)
    return min(1.0, sum(math.exp(_log_choose(n, i) - n * math.log(2)) for i in range(int(wins), n + 1))) if n else 1.0


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact probability of a 2 x 2 table: the sum over tables of equal margins that are no likelier."""
    a, b, c, d = map(int, (a, b, c, d))
    r, s, n = a + b, a + c, a + b + c + d

    def logp(x: int) -> float:
        return _log_choose(r, x) + _log_choose(n - r, s - x) - _log_choose(n, s)

    own = logp(a)
    return min(1.0, sum(math.exp(p) for x in range(max(0, r + s - n), min(r, s) + 1) if (p := logp(x)) <= own + 1e-9))


def sign_test(df: DataFrame, keys: list[str], difference: str, one_sided: bool = False) -> DataFrame:
    """(keys, wins, losses, ties, p) of paired differences; ties and NaN are left out of the test."""
    d = F.col(difference)
    out = df.where(d.isNotNull() & ~F.isnan(d.cast("double"))).groupBy(*keys).agg(F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"))
    return out.withColumn("p", _batch(sign_p_one_sided if one_sided else sign_p, F.col("wins"), F.col("losses")))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95 % interval of a rate, clamped to [0, 1]; (0, 0) for n = 0."""
    some = n > 0
    n = F.when(some, n)
    p = successes / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(some, F.greatest(F.lit(0.0), middle - half)).otherwise(0.0), F.when(some, F.least(F.lit(1.0), middle + half)).otherwise(0.0)


def fisher_test(df: DataFrame, keys: list[str], one: Column, two: Column) -> DataFrame:
    """(keys, a, b, c, d, p) of the 2 x 2 table of two flags per group; rows where one is null do not count."""
    rows = df.where(one.isNotNull() & two.isNotNull())
    out = rows.groupBy(*keys).agg(F.count_if(one & two).alias("a"), F.count_if(one & ~two).alias("b"), F.count_if(~one & two).alias("c"), F.count_if(~one & ~two).alias("d"))
    return out.withColumn("p", _batch(fisher_p, *map(F.col, "abcd")))


def normal_p(z: Column) -> Column:
    """Two-sided probability of a standard normal value."""
    return _batch(lambda x: math.erfc(abs(x) / math.sqrt(2)), z)


def mann_whitney(df: DataFrame, keys: list[str], value: str, first: Column) -> DataFrame:
    """(keys, n1, n2, u, effect, p): U of the rows with the flag, A = U / (n1 * n2), normal p with tie correction.

    Values are counted first; mid-ranks are running sums over distinct values, by ranges.
    """
    rows = df.where(F.col(value).isNotNull() & first.isNotNull())
    cells = rows.groupBy(*keys, value).agg(F.count_if(first).alias("x"), F.count_if(~first).alias("y"))
    cells = running_before(cells, keys, value, "y", "__y").withColumn("t", F.col("x") + F.col("y"))
    out = cells.groupBy(*keys).agg(F.sum("x").alias("n1"), F.sum("y").alias("n2"), F.sum(F.col("x") * (F.col("__y") + F.col("y") / 2.0)).alias("u"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("__t"))
    pairs, n = (F.col("n1") * F.col("n2")).cast("double"), (F.col("n1") + F.col("n2")).cast("double")
    sd = F.sqrt(pairs / 12 * ((n + 1) - F.col("__t") / F.nullif(n * (n - 1), F.lit(0.0))))
    out = out.withColumn("effect", F.when(pairs > 0, F.col("u") / pairs)).withColumn("__z", F.when(sd > 0, (F.col("u") - pairs / 2) / sd))
    return out.withColumn("p", normal_p(F.col("__z"))).drop("__t", "__z")


def wilcoxon(df: DataFrame, keys: list[str], difference: str) -> DataFrame:
    """(keys, n, w_plus, w_minus, p): signed ranks of the non-zero differences, mid-ranks for ties, normal p with tie correction."""
    d = F.col(difference)
    rows = df.where(d.isNotNull() & (d != 0)).withColumn("__a", F.abs(d))
    cells = rows.groupBy(*keys, "__a").agg(F.count_if(d > 0).alias("x"), F.count_if(d < 0).alias("y")).withColumn("t", F.col("x") + F.col("y"))
    cells = running_before(cells, keys, "__a", "t", "__before").withColumn("__r", F.col("__before") + (F.col("t") + 1) / 2.0)
    out = cells.groupBy(*keys).agg(F.sum("t").alias("n"), F.sum(F.col("x") * F.col("__r")).alias("w_plus"), F.sum(F.col("y") * F.col("__r")).alias("w_minus"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("__t"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("__t") / 48)
    return out.withColumn("p", normal_p(F.when(sd > 0, (F.col("w_plus") - n * (n + 1) / 4) / sd))).drop("__t")


def permutation(df: DataFrame, keys: list[str], value: str, kind: str, observed: str, control: str) -> DataFrame:
    """(keys, observed, controls, p, z, at_floor): (controls at least as great + 1) / (controls + 1), z against the controls,
    and whether p is as small as so many controls allow."""
    obs = df.where(F.col(kind) == observed).groupBy(*keys).agg(F.max(value).alias("observed"))
    con = df.where(F.col(kind) == control)
    both = con.join(obs, keys) if keys else con.withColumn("observed", obs.scalar())
    out = both.groupBy(*keys, "observed").agg(F.count(value).alias("controls"), F.count_if(F.col(value) >= F.col("observed")).alias("__ge"), F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    return out.select(*keys, "observed", "controls", ((F.col("__ge") + 1) / (F.col("controls") + 1)).alias("p"), F.when(F.col("__s") > 0, (F.col("observed") - F.col("__m")) / F.col("__s")).alias("z"), (F.col("__ge") == 0).alias("at_floor"))


def paired_t(df: DataFrame, keys: list[str], difference: str) -> DataFrame:
    """(keys, n, mean, sd, t) with the population sd; t is null for no spread."""
    out = df.groupBy(*keys).agg(F.count(difference).alias("n"), F.avg(difference).alias("mean"), F.stddev_pop(difference).alias("sd"))
    return out.withColumn("t", F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n"))))


def against_others(df: DataFrame, pair: str, arm: str, value: str, least_arms: int = 2, least_pairs: int = 3) -> DataFrame:
    """(arm, n, mean, median, p, p_adjusted): each arm's value less the mean of the other arms of its pair.

    Pairs need ``least_arms`` others, arms ``least_pairs`` pairs; p by sign test, times the number of arms tested. What
    differs only beyond the twelfth decimal, as sums in another order do, is a tie.
    """
    w = Window.partitionBy(pair)
    rows = df.where(F.col(value).isNotNull()).withColumn("__n", F.count("*").over(w) - 1).withColumn("__o", (F.sum(value).over(w) - F.col(value)) / F.nullif(F.col("__n"), F.lit(0)))
    rows = rows.where(F.col("__n") >= least_arms).withColumn("d", F.col(value) - F.col("__o"))
    out = rows.groupBy(arm).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.median("d").alias("median"), F.count_if(F.round("d", 12) > 0).alias("__w"), F.count_if(F.round("d", 12) < 0).alias("__l")).where(F.col("n") >= least_pairs)
    out = out.withColumn("p", _batch(sign_p, F.col("__w"), F.col("__l")))
    return out.withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p") * F.count("*").over(Window.partitionBy(F.lit(0))))).drop("__w", "__l")


def calibration(df: DataFrame, label: str, predicted: str, confidence: str, negative: str) -> DataFrame:
    """(label, n, hit_rate, mean_confidence, landed): per true label how often it is found, how sure the model is, and for rows
    of the ``negative`` label where they land most (ties: the first label)."""
    n = df.groupBy(label, predicted).agg(F.count("*").alias("c"), F.sum(confidence).alias("s"))
    out = n.groupBy(label).agg(F.sum("c").alias("n"), (F.sum(F.when(F.col(label) == F.col(predicted), F.col("c")).otherwise(0)) / F.sum("c")).alias("hit_rate"), (F.sum("s") / F.sum("c")).alias("mean_confidence"), F.min(F.struct((-F.col("c")).alias("c"), F.col(predicted).alias("p"))).alias("__top"))
    return out.withColumn("landed", F.when(F.col(label) == negative, F.col("__top.p"))).drop("__top")


def probe(df: DataFrame, vector: str, label: str, fold: str, regularisation: float = 1.0) -> DataFrame:
    """(fold, label, n, hits, recall): class-weighted logistic regression on standardised vectors, trained per fold on the others.

    Every label is weighted by the inverse of its share; regParam = 1 / (C * n). Recall is null for labels absent from a
    fold. Balanced accuracy is the mean of a fold's recalls.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, StringIndexer
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).withColumn("x", array_to_vector(F.col(vector)))
    rows = StringIndexer(inputCol=label, outputCol="y").fit(rows).transform(rows)
    rows = rows.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy(label)))
    parts = []
    for k in [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]:
        train, test = rows.where(F.col(fold) != k), rows.where(F.col(fold) == k)
        scaler = StandardScaler(inputCol="x", outputCol="z", withMean=True).fit(train)
        n = train.count()
        model = LogisticRegression(featuresCol="z", labelCol="y", weightCol="w", regParam=1.0 / (regularisation * max(1, n)), standardization=False, maxIter=50).fit(scaler.transform(train))
        parts.append(model.transform(scaler.transform(test)).select(F.col(fold), F.col(label), (F.col("prediction") == F.col("y")).alias("hit")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(fold, label).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).withColumn("recall", F.col("hits") / F.col("n"))


def probe_summary(df: DataFrame, row: str, layers: list[str], label: str, fold: str, regularisation: float = 1.0, seed: str = "0") -> DataFrame:
    """(layer, labels, folds, balanced_accuracy, sem): probes of every vector column, on the labels as they are and dealt anew.

    Balanced accuracy is the mean of a fold's recalls, averaged over folds; sem is the standard error over folds. Dealt
    labels are those of the row of equal rank in another random order: what a probe reaches on them is chance.
    """
    rows = rank_by_md5(df, [], row, "__n", seed)
    dealt = rank_by_md5(df.select(F.col(row).alias("__o"), F.col(label).alias("__dealt")), [], "__o", "__n", f"{seed}-labels").select("__n", "__dealt")
    both = rows.join(dealt, "__n")
    out = None
    for layer in layers:
        for name, column in (("real", label), ("dealt", "__dealt")):
            per = probe(both, layer, column, fold, regularisation).groupBy(fold).agg(F.avg("recall").alias("b"))
            one = per.agg(F.count("*").alias("folds"), F.avg("b").alias("balanced_accuracy"), (F.stddev_samp("b") / F.sqrt(F.count("*"))).alias("sem"))
            one = one.select(F.lit(layer).alias("layer"), F.lit(name).alias("labels"), "folds", "balanced_accuracy", "sem")
            out = one if out is None else out.unionByName(one)
    return out
