"""Samples that match target category proportions, by swap repair over category signatures.

A row's signature is the set of its categories, one or several. Rows are reduced to counts per signature. A random start
that satisfies the floors is repaired by exchanging counts between signatures as long as that lowers the deviation from
the targets; rows are then drawn at random by count. Only the counts per signature reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.runtime import rank_by_hash

Signature = tuple[str, ...]


def wanted_counts(targets: dict[str, tuple[int, int]], size: int) -> dict[str, int]:
    """The larger of the floor and the share of ``size``, rounded up."""
    return {c: max(floor, -(-permille * size // 1000)) for c, (permille, floor) in targets.items()}


def _random_start(signs: list[Signature], stock: np.ndarray, floors: dict[str, int], size: int, rng: np.random.Generator) -> np.ndarray:
    """Counts per signature of a random sample that holds the floors where there is stock and room."""
    taken = np.zeros(len(stock), np.int64)
    for c in sorted(floors, key=lambda c: (floors[c], c)):
        has = np.array([c in s for s in signs], bool)
        need = min(floors[c] - int(taken[has].sum()), size - int(taken.sum()), int((stock - taken)[has].sum()))
        if need > 0:
            taken[has] += rng.multivariate_hypergeometric((stock - taken)[has], need, method="marginals")
    left = size - int(taken.sum())
    if left > 0:
        taken += rng.multivariate_hypergeometric(stock - taken, left, method="marginals")
    return taken


def swap_repair(available: dict[Signature, int], targets: dict[str, tuple[int, int]], size: int, seed: int = 0) -> tuple[dict[Signature, int], dict[str, float]]:
    """(rows to take of each signature, figures): ``size`` rows in all, no more than there are.

    ``targets``: category -> (share in thousandths, least rows). The squared deviation of the categories' counts from
    their shares of ``size`` is lowered by the best exchange of m rows of one signature for m of another, until none lowers
    it; no exchange takes a category below its floor. Rows without any target category count as a category with share 0.
    Floors that exceed ``size`` together are filled smallest first. figures: swaps, deviation before and after (the root
    of the squared sum, in rows).
    """
    signs = sorted(available)
    stock = np.array([available[s] for s in signs], np.int64)
    size = min(size, int(stock.sum()))
    if not signs or size == 0:
        return dict.fromkeys(signs, 0), {"swaps": 0, "before": 0.0, "after": 0.0}
    names = [*sorted(targets), ""]
    member = np.array([[c in s if c else not any(x in targets for x in s) for c in names] for s in signs], np.int64)
    share = np.array([targets[c][0] * size / 1000 if c else 0.0 for c in names])
    floor = np.array([targets[c][1] if c else 0 for c in names], np.int64)
    floor = np.minimum(floor, stock @ member)
    taken = _random_start(signs, stock, {c: int(f) for c, f in zip(names, floor, strict=True) if c and f}, size, np.random.default_rng(seed))
    apart = (member**2).sum(1)[:, None] + (member**2).sum(1)[None] - 2 * member @ member.T
    swaps, before = 0, float(np.sqrt(((taken @ member - share) ** 2).sum()))
    while True:
        counts = taken @ member
        pull = member @ (counts - share)
        slope = pull[None, :] - pull[:, None]
        # what each category has above its floor bounds what a signature may give; a category both have is not touched
        spare = np.maximum(0, counts - floor)
        give = np.full((len(signs), len(signs)), np.iinfo(np.int64).max)
        for c in range(len(names)):
            loses = (member[:, c][:, None] > member[:, c][None, :])
            give[loses] = np.minimum(give[loses], spare[c])
        room = np.minimum(np.minimum(taken[:, None], (stock - taken)[None, :]), give)
        with np.errstate(divide="ignore", invalid="ignore"):
            ideal = np.where(apart > 0, -slope / np.maximum(apart, 1), 0.0)
        m = np.minimum(room, np.maximum(1, np.rint(ideal)).astype(np.int64))
        won = np.where((m > 0) & (apart > 0), -2 * m * slope - m**2 * apart, 0.0)
        best = int(won.argmax())
        if won.flat[best] <= 1e-9:
            break
        a, b = divmod(best, len(signs))
        taken[a] -= m[a, b]
        taken[b] += m[a, b]
        swaps += 1
    after = float(np.sqrt(((taken @ member - share) ** 2).sum()))
    return {s: int(n) for s, n in zip(signs, taken, strict=True)}, {"swaps": swaps, "before": before, "after": after}


def quota_sample(df: DataFrame, id_col: str, category: str, targets: DataFrame, size: int, seed: int = 0, most: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(sample, report): ``size`` rows of ``df`` whose category shares follow ``targets``, and what was wanted and reached.

    ``category`` is a string column or an array of strings, whose distinct values without nulls form a row's signature; a
    null is an empty one. ``targets`` has compound_class, target_permille and min_records, one row a category (repeated
    rows count once; nulls count as 0); it is a vocabulary and read by the driver. Categories without target are left out
    of signatures, so their rows are only drawn where the targets cannot fill the sample; over ``most`` signatures are an
    error. ``id_col`` is unique and not null; extra columns, whatever their names, pass through to the sample.

    The report has one row per target category: category, available, wanted, taken, share, target_share, shortfall (what
    the repaired sample lacks of what is wanted, though it holds every row there is), swaps, deviation_before and
    deviation_after (of the whole sample, in rows). An empty ``df`` gives an empty sample and a report of shortfalls.
    """
    spark = df.sparkSession
    goal: dict[str, tuple[int, int]] = {}
    for r in targets.where("compound_class is not null").groupBy("compound_class").agg(F.max(F.coalesce("target_permille", F.lit(0))), F.max(F.coalesce("min_records", F.lit(0)))).collect():
        goal[r[0]] = (int(r[1]), int(r[2]))
    single = dict(df.dtypes)[category] == "string"
    values = F.array(F.col(category)) if single else F.coalesce(F.col(category), F.array().cast("array<string>"))
    signature = F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isin(*sorted(goal)))))
    rows = df.select(F.col(id_col).alias("__id"), signature.alias("__sign"))
    counts = rows.groupBy("__sign").agg(F.count("*").alias("n"))
    found = counts.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} signatures of categories")
    available = {tuple(r[0]): r[1] for r in found}
    taken, figures = swap_repair(available, goal, size, seed)
    wanted = wanted_counts(goal, size)
    report = []
    for c in sorted(goal):
        there, got = (sum(n for s, n in x.items() if c in s) for x in (available, taken))
        report.append((c, there, wanted[c], got, goal[c][0] / 1000, wanted[c] - got if got == there and got < wanted[c] else 0, figures["swaps"], figures["before"], figures["after"]))
    schema = "category string, available bigint, wanted bigint, taken bigint, target_share double, shortfall bigint, swaps int, deviation_before double, deviation_after double"
    report = spark.createDataFrame(report, schema).withColumn("share", F.col("taken") / F.lit(max(1, sum(taken.values()))))
    quota = spark.createDataFrame([(list(s), n) for s, n in taken.items()], "__sign array<string>, __n bigint")
    ranked = rank_by_hash(rows.withColumn("__key", F.concat_ws("\u0001", "__sign")), ["__key"], "__id", "__rank", seed=seed)
    drawn = ranked.join(quota.withColumn("__key", F.concat_ws("\u0001", "__sign")).select("__key", "__n"), "__key").where("__rank <= __n")
    sample = df.join(drawn.select(F.col("__id").alias(id_col)), id_col, "left_semi")
    return sample, report
