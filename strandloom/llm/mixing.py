"""Mixing sources to target shares of tokens by entropy balancing.

Every document gets a rate, the expected number of its copies. Among all rates that meet a source's target and its
cap, those closest to one copy each in relative entropy are exponentially tilted in the document's size. The tilt of
each source is the root of the convex dual, found by safeguarded Newton steps; each step is one distributed sum over
documents that were first counted by (source, size), and returns one row a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.labels import stripped
from strandloom.runtime import materialize


def _looked_up(key: Column, values: dict[str, float]) -> Column:
    pairs = [F.lit(x) for k in sorted(values) for x in (k, float(values[k]))]
    return F.element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("double")


def _tilts(counted: DataFrame, need: dict[str, int], cap: dict[str, float], mean: dict[str, float], steps: int, close: float) -> tuple[dict[str, float], set[str], dict[str, float]]:
    """(tilt, unmet, residual) per source: the root of the dual's gradient, the sources that have none, and what is off in the end.

    ``need`` are tokens in thousandths, so that the first step is exact.

    The gradient, tokens reached less the goal, rises with the tilt up to that of all rates at their cap. The first step
    takes it there, in whole tokens: where it is still negative the dual has no root, the source stays at its cap and is
    unmet; where it is zero, or the goal is, the root is infinite. All others are solved by Newton steps inside a bracket.
    """
    top = {r["source"]: int(r["t"]) for r in counted.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("t")).collect()}
    goal = {s: n / 1000 for s, n in need.items()}
    ends = {s: top.get(s, 0) * int(cap[s]) * 1000 - n for s, n in need.items()}
    unmet = {s for s, e in ends.items() if e < 0}
    done = {s: math.inf for s, e in ends.items() if e <= 0} | {s: -math.inf for s, e in ends.items() if e > 0 and goal[s] == 0}
    residual = dict.fromkeys(goal, 0.0)
    open_ = {s: 0.0 for s in goal if s not in done}
    low, high = dict.fromkeys(open_, -64.0), dict.fromkeys(open_, 64.0)
    for _ in range(steps):
        if not open_:
            break
        tilt, most, size = _looked_up(F.col("source"), open_), _looked_up(F.col("source"), cap), F.col("size") / _looked_up(F.col("source"), mean)
        power = tilt * size
        free = power < F.log(most)
        rate = F.when(free, F.exp(power)).otherwise(most)
        rows = counted.where(F.col("source").isin(*sorted(open_))).select("source", (rate * F.col("size") * F.col("n")).alias("t"), F.when(free, rate * F.col("size") * size * F.col("n")).otherwise(0.0).alias("d"))
        for r in rows.groupBy("source").agg(F.sum("t").alias("t"), F.sum("d").alias("d")).collect():
            s = r["source"]
            off = r["t"] - goal[s]
            residual[s] = off / max(1.0, goal[s])
            if abs(off) <= close * max(1.0, goal[s]):
                done[s] = open_.pop(s)
                continue
            if off > 0:
                high[s] = open_[s]
            else:
                low[s] = open_[s]
            step = open_[s] - off / r["d"] if r["d"] > 0 else math.inf
            open_[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    return done | open_, unmet, residual


def mix_sources(df: DataFrame, id_col: str, source_col: str, size_col: str, weights: DataFrame, total: int | None = None, seed: int = 0, steps: int = 60, close: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """(copies, report): how often each row goes into a mix whose sources have their target shares, and what was reached.

    ``weights``: source, target_permille, max_repeats, one row a source, a vocabulary that is read by the driver
    (repeated names: the greatest values; null names are ignored). Source names are compared without case and
    surrounding white space. The mix has ``total`` tokens, by default those of all rows of the sources of ``weights``.
    A source that its cap keeps from its target is taken ``max_repeats`` times whole and reported.

    copies: id, source, size, rate, copies; rows of other or null sources have rate and copies 0, null or negative sizes
    count as 0 and such rows come once. Rates are rounded up or down by a hash of the id, never above the cap.
    report: one row per source of ``weights``: documents, tokens, target_share, target_tokens, reached_tokens,
    reached_share, unmet (the dual has no root within the caps), residual (of the rates from the target, relative; beyond
    ``close`` if ``steps`` did not suffice). An empty table gives an empty mix; with a total of 0 no source is unmet.
    """
    spark = df.sparkSession
    name = F.lower(stripped(F.col("source")))
    listed = weights.where("source is not null").groupBy(name.alias("source")).agg(F.max("target_permille").alias("w"), F.max("max_repeats").alias("m")).collect()
    share = {r["source"]: int(r["w"] or 0) for r in listed}
    cap = {r["source"]: float(max(0, r["m"] or 0)) for r in listed}
    rows = df.select(F.col(id_col).alias("id"), F.lower(stripped(F.col(source_col))).alias("source"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("bigint").alias("size"))
    counted = materialize(rows.where(F.col("source").isin(*sorted(share))).groupBy("source", "size").agg(F.count("*").alias("n")))
    sums = {r["source"]: (r["docs"], r["tokens"]) for r in counted.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("tokens")).collect()}
    tokens = {s: int(sums.get(s, (0, 0))[1]) for s in share}
    whole = sum(tokens.values()) if total is None else total
    need = {s: share[s] * whole for s in share}
    mean = {s: max(1.0, tokens[s] / sums[s][0]) if s in sums else 1.0 for s in share}
    tilts, unmet, residual = _tilts(counted, need, cap, mean, steps, close)
    finite = {s: t for s, t in tilts.items() if math.isfinite(t)}
    source, size = F.col("source"), F.col("size")
    inside = source.isin(*sorted(finite)) if finite else F.lit(False)
    power = _looked_up(source, finite) * size / _looked_up(source, mean)
    most = F.coalesce(_looked_up(source, cap), F.lit(0.0))
    tilted = F.when(power < F.log(most), F.exp(power)).otherwise(most)
    none = [s for s in share if not share[s] or not cap[s]]
    rate = F.when(inside, tilted).when(source.isin(*none) if none else F.lit(False), 0.0).otherwise(most)
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    copies = rows.withColumn("rate", F.when(size > 0, rate).otherwise(F.when(most > 0, 1.0).otherwise(0.0)))
    copies = copies.withColumn("copies", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("bigint")).cast("int"))
    got = copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("reached_tokens"))
    plan = [(s, int(sums.get(s, (0, 0))[0]), tokens[s], share[s] / 1000, need[s] / 1000, s in unmet, residual[s]) for s in sorted(share)]
    report = spark.createDataFrame(plan, "source string, documents bigint, tokens bigint, target_share double, target_tokens double, unmet boolean, residual double")
    report = report.join(got, "source", "left").withColumn("reached_tokens", F.coalesce("reached_tokens", F.lit(0)))
    everything = F.sum("reached_tokens").over(Window.partitionBy(F.lit(0)))
    return copies, report.withColumn("reached_share", F.when(everything > 0, F.col("reached_tokens") / everything))
