"""First, best and running rows. All orders end in a unique key, so results do not depend on the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.runtime import running_before


def first_of_content(df: DataFrame, content: str, order: str) -> DataFrame:
    """Exact dedup: of rows with equal content the first in ``order``; null contents are kept, each by itself.

    The rows' numbers, not the contents, are reduced and joined back, so a content that fills a third of the table is
    reduced before the shuffle.
    """
    digest = F.md5(F.encode(F.col(content), "utf-8"))
    keep = df.where(F.col(content).isNotNull()).groupBy(digest.alias("__h")).agg(F.min(order).alias(order)).select(order)
    return df.where(F.col(content).isNotNull()).join(keep, order, "left_semi").unionByName(df.where(F.col(content).isNull()))


def top_per_key(df: DataFrame, key: str, score: Column, tie: str, m: int) -> DataFrame:
    """The ``m`` rows of each key with the greatest score, ties by ``tie``, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(score.desc(), tie))).where(F.col("rank") <= m)


def best_per_key(df: DataFrame, key: str, score: str, item: str) -> DataFrame:
    """(key, item, score) of the greatest score of each key, ties: the least item. A partial aggregate, no sort."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(item)).alias("i")))
    return df.groupBy(key).agg(best.alias("b")).select(key, (-F.col("b.i")).alias(item), F.col("b.s").alias(score))


def top_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most frequent keys; ties in key order."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def within_top_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.join(top_groups(df, key, n).select(key), key, "left_semi")


def spread_first(df: DataFrame, cell: str, group: str, order: Column, tie: str, k: int) -> DataFrame:
    """``k`` rows of each cell, rows of distinct groups first and repeats of a group only then."""
    inner = F.row_number().over(Window.partitionBy(cell, group).orderBy(order, tie))
    rows = df.withColumn("__g", (inner > 1).cast("int")).withColumn("__h", order)
    rank = F.row_number().over(Window.partitionBy(cell).orderBy("__g", "__h", tie))
    return rows.withColumn("__r", rank).where(F.col("__r") <= k).drop("__g", "__h", "__r")


def ranked_labels(scores: Column) -> Column:
    """Labels of a map label -> score, greatest score first, ties by label."""
    entries = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return F.transform(entries, lambda e: e["k"])


def tied_with_best(df: DataFrame, score: str, error: str) -> DataFrame:
    """Rows whose score is within the best row's standard error of the best."""
    best = df.agg(F.max(F.struct(score, F.col(error)))).scalar()
    return df.withColumn("__b", best).where(F.col(score) >= F.col(f"__b.{score}") - F.col(f"__b.{error}")).drop("__b")


def last_of_trace(df: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """Per key the value at its last step, the mean and the step of the least value (ties: the first)."""
    low = F.min(F.struct(F.col(value).alias("v"), F.col(step).alias("s")))
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, step).alias("last"), F.avg(value).alias("mean"), low.alias("low")).select(key, "last", "mean", F.col("low.s").alias("lowest_at"))


def gap_by_step(df: DataFrame, step: str, arm: str, value: str, one: str, other: str) -> DataFrame:
    """Per step the mean of one arm less that of the other; steps that lack an arm have a null gap."""
    out = df.groupBy(step).agg(F.avg(F.when(F.col(arm) == one, F.col(value))).alias("one"), F.avg(F.when(F.col(arm) == other, F.col(value))).alias("other"))
    return out.withColumn("gap", F.col("one") - F.col("other"))


def chosen_candidate(df: DataFrame, key: str, index: str, objective: str, usable: str) -> DataFrame:
    """Per key the index of the usable row with the greatest objective, ties: the least; null if none is usable."""
    pick = F.max(F.when(F.col(usable), F.struct(F.col(objective).alias("o"), (-F.col(index)).alias("i"))))
    return df.groupBy(key).agg(pick.alias("p")).select(key, (-F.col("p.i")).alias("chosen"))


def early_stop(df: DataFrame, run: str, step: str, loss: str, patience: int, delta: float) -> DataFrame:
    """Per run the first step at which ``patience`` steps in a row did not beat the best loss before by ``delta``.

    Runs that never stop have a null step. The best so far is a running minimum; steps since the last gain are the
    distance to the last step with one (gaps and islands).
    """
    order = Window.partitionBy(run).orderBy(step)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__best", F.min(loss).over(before)).withColumn("__n", F.row_number().over(order))
    gain = F.col("__best").isNull() | (F.col(loss) <= F.col("__best") - delta)
    rows = rows.withColumn("__last", F.max(F.when(gain, F.col("__n"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(run).agg(F.min(F.when(F.col("__n") - F.col("__last") >= patience, F.col(step))).alias("stop"))


def delta_to_step(df: DataFrame, arm: str, step: str, value: str) -> DataFrame:
    """Adds each row's difference from its arm's value at the least step."""
    base = F.first(value).over(Window.partitionBy(arm).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("delta", F.col(value) - base)


def auc(df: DataFrame, score: str, positive: str, keys: list[str] = ()) -> DataFrame:
    """Area under the ROC curve with half credit for ties; null where a class is missing.

    Scores are counted per distinct value first; the ranks are running sums over those, per key.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull())
    cells = rows.groupBy(*keys, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    cells = running_before(cells, list(keys), score, "q", "__below")
    wins = F.sum(F.col("p") * (F.col("__below") + F.col("q") / 2.0))
    pairs = F.sum("p") * F.sum("q")
    return cells.groupBy(*keys).agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.when(pairs > 0, wins / pairs).alias("auc"))
