"""Splits that keep related records together, by min-cost flow over bundles of components.

Records that share a species (or, without one, an accession) form a component. Components of like size and label
profile are bundled, so the flow problem has as many rows as there are kinds of components, not components. The flow
sends each bundle's rows to the splits at the least cost of deviation from the quotas of size and of every main label; it
is rounded to whole components and repaired on whole label profiles, and members of a bundle are assigned by their hash.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.labels import normal_accession, species
from strandloom.runtime import materialize, rank_by_hash, salted_join


def relation_key(tag: Column, accession: Column) -> Column:
    """What a record's relatives share: ``s:genus epithet``, else ``a:ACCESSION``; null if it has neither."""
    name, own = species(tag), normal_accession(accession)
    return F.coalesce(F.concat(F.lit("s:"), name), F.concat(F.lit("a:"), own))


def broken_relations(df: DataFrame, id_col: str, key: str, split: str) -> DataFrame:
    """(id): rows with a non-null split for which a row with the same non-null key has another non-null split.

    Splits are reduced to their least and greatest per key before the shuffle; a key that holds a third of all rows is
    joined back in several parts.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(split).isNotNull()).select(F.col(id_col).alias("id"), F.col(key).alias("key"), F.col(split).alias("split"))
    torn = rows.groupBy("key").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a < b").select("key")
    return salted_join(rows, torn, ["key"]).select("id")


def _size_class(n: Column) -> Column:
    """n itself up to 64, then two significant binary digits more than its magnitude: bounded in number, within 7 % of n."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double"))) - 4)
    return F.when(n <= 64, n.cast("bigint")).otherwise((F.floor(n / step) * step).cast("bigint"))


class _Flow:
    """Successive shortest paths with potentials on a small network with integer capacities and costs."""

    def __init__(self, nodes: int):
        self.edges: list[list[list[int]]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, capacity: int, cost: int) -> tuple[int, int]:
        self.edges[a].append([b, capacity, cost, len(self.edges[b])])
        self.edges[b].append([a, 0, -cost, len(self.edges[a]) - 1])
        return a, len(self.edges[a]) - 1

    def used(self, edge: tuple[int, int]) -> int:
        to, _, _, back = self.edges[edge[0]][edge[1]]
        return self.edges[to][back][1]

    def run(self, source: int, sink: int) -> None:
        n = len(self.edges)
        potential = [0] * n
        while True:
            distance, before = [None] * n, [None] * n
            distance[source] = 0
            queue = [(0, source)]
            while queue:
                d, x = heapq.heappop(queue)
                if d > distance[x]:
                    continue
                for k, (y, capacity, cost, _) in enumerate(self.edges[x]):
                    if capacity > 0:
                        e = d + cost + potential[x] - potential[y]
                        if distance[y] is None or e < distance[y]:
                            distance[y], before[y] = e, (x, k)
                            heapq.heappush(queue, (e, y))
            if distance[sink] is None:
                return
            for i in range(n):
                if distance[i] is not None:
                    potential[i] += distance[i]
            flow, y = None, sink
            while y != source:
                x, k = before[y]
                flow = self.edges[x][k][1] if flow is None else min(flow, self.edges[x][k][1])
                y = x
            y = sink
            while y != source:
                x, k = before[y]
                edge = self.edges[x][k]
                edge[1] -= flow
                self.edges[y][edge[3]][1] += flow
                y = x


class Bundle(NamedTuple):
    """Components of like size and label profile: how many, rows each, and what share of the rows each label has."""

    count: int
    size: int
    profile: dict[str, float]


def allocate(bundles: list[Bundle], shares: dict[str, int]) -> list[dict[str, int]]:
    """Components of each bundle for each split.

    Network: bundle -> (main label, split) -> split -> sink. What a label sends to a split, and what a split receives,
    costs nothing up to its quota and rises in steps beyond, so sizes and label mixes deviate as little as components
    allow. Flows are rows; they are rounded to whole components largest bundle first, each left over going where most is
    owed to the split and to its label there. The rounded plan is then repaired on whole profiles (``_repair``).
    """
    splits = sorted(shares)
    main = [max(sorted(b.profile), key=b.profile.get) for b in bundles]
    total = sum(b.count * b.size for b in bundles)
    weight = max(1, sum(shares.values()))
    by_label: dict[str, int] = {}
    for b, label in zip(bundles, main, strict=True):
        by_label[label] = by_label.get(label, 0) + b.count * b.size
    labels = sorted(by_label)
    nb, nl, ns = len(bundles), len(labels), len(splits)
    at_cell = {(c, s): 1 + nb + i * ns + j for i, c in enumerate(labels) for j, s in enumerate(splits)}
    at_split = {s: 1 + nb + nl * ns + j for j, s in enumerate(splits)}
    sink = 1 + nb + nl * ns + ns
    net = _Flow(sink + 1)
    for (c, s), node in at_cell.items():
        quota = by_label[c] * shares[s] // weight
        net.add(node, at_split[s], quota, 0)
        net.add(node, at_split[s], max(1, quota // 10), 2)
        net.add(node, at_split[s], total, 6)
    for s, node in at_split.items():
        quota = -(-total * shares[s] // weight)
        net.add(node, sink, quota, 0)
        net.add(node, sink, max(1, quota // 50), 3)
        net.add(node, sink, total, 20)
    ways = []
    for i, (b, label) in enumerate(zip(bundles, main, strict=True)):
        net.add(0, 1 + i, b.count * b.size, 0)
        ways.append({s: net.add(1 + i, at_cell[label, s], b.count * b.size, 0) for s in splits})
    net.run(0, sink)
    # what the plan owes each split, and each label in it, for the bundles rounded so far
    out: list[dict[str, int]] = [{} for _ in bundles]
    owed = dict.fromkeys(splits, 0.0)
    owed_label = {(c, s): 0.0 for c in labels for s in splits}
    for i in sorted(range(nb), key=lambda i: (-bundles[i].size, main[i], i)):
        b, label = bundles[i], main[i]
        planned = {s: net.used(ways[i][s]) for s in splits}
        got = {s: planned[s] // b.size for s in splits}
        for s in splits:
            owed[s] += planned[s] - got[s] * b.size
            owed_label[label, s] += planned[s] - got[s] * b.size
        for _ in range(b.count - sum(got.values())):
            s = max(splits, key=lambda s: (owed[s] + owed_label[label, s], shares[s], s))
            got[s] += 1
            owed[s] -= b.size
            owed_label[label, s] -= b.size
        out[i] = got
    return _repair(bundles, shares, out)


def _repair(bundles: list[Bundle], shares: dict[str, int], plan: list[dict[str, int]], heavy: float = 3.0, steps: int = 5000, few: int = 100) -> list[dict[str, int]]:
    """Moves components between splits while that lowers the squared deviation of labels and, ``heavy`` times, of sizes.

    Deviations of a label are measured against its own quota's root, so rare labels count beside common ones. Each step
    takes the best move of the best number of one bundle's components, or else the best exchange with another bundle's,
    among the ``few`` that pull most; it ends when none helps, or after ``steps``.
    """
    splits = sorted(shares)
    if not bundles or len(splits) < 2:
        return plan
    labels = sorted({c for b in bundles for c in b.profile})
    at = {c: k for k, c in enumerate(labels)}
    vector = np.zeros((len(bundles), len(labels) + 1))
    for i, b in enumerate(bundles):
        for c, share in b.profile.items():
            vector[i, at[c]] = share * b.size
        vector[i, -1] = b.size
    part = np.array([shares[s] for s in splits], float) / max(1, sum(shares.values()))
    size, count = vector[:, -1].copy(), np.array([b.count for b in bundles], float)
    vector = vector / np.sqrt(np.maximum(1.0, count @ vector))
    vector[:, -1] *= heavy
    got = np.array([[p.get(s, 0) for s in splits] for p in plan], np.int64)
    off = got.T @ vector - part[:, None] * (count @ vector)[None]
    weight = (vector**2).sum(1)

    def shift(i: int, s: int, t: int, n: int) -> None:
        got[i, s] -= n
        got[i, t] += n
        off[s] -= n * vector[i]
        off[t] += n * vector[i]

    for _ in range(steps):
        pull = vector @ off.T
        slope = pull[:, None, :] - pull[:, :, None]
        # m components of a bundle from the second index's split to the third's
        m = np.clip(np.rint(-slope / (2 * np.maximum(weight, 1e-12))[:, None, None]), 1, np.maximum(1, got)[:, :, None])
        change = 2 * m * slope + 2 * m**2 * weight[:, None, None]
        change[np.broadcast_to((got == 0)[:, :, None], change.shape)] = 0.0
        for s in range(len(splits)):
            change[:, s, s] = 0.0
        best = int(change.argmin())
        if change.flat[best] < -1e-9:
            i, s, t = (int(x) for x in np.unravel_index(best, change.shape))
            shift(i, s, t, int(m[i, s, t]))
            continue
        found, exchange = -1e-9, None
        for s in range(len(splits)):
            for t in range(len(splits)):
                pulls = slope[:, s, t] / np.sqrt(np.maximum(weight, 1e-12))
                there, back = (np.flatnonzero(got[:, x] > 0) for x in (s, t))
                if s == t or not len(there) or not len(back):
                    continue
                there, back = there[np.argsort(pulls[there], kind="stable")[:few]], back[np.argsort(-pulls[back], kind="stable")[:few]]
                # as many components each way as make up for their sizes
                n = np.maximum(1, np.rint(size[back][None] / size[there][:, None]))
                k = np.maximum(1, np.rint(size[there][:, None] / size[back][None]))
                room = np.minimum(got[there, s][:, None] // n, got[back, t][None] // k)
                line = n * slope[there, s, t][:, None] - k * slope[back, s, t][None]
                bend = n**2 * weight[there][:, None] + k**2 * weight[back][None] - 2 * n * k * (vector[there] @ vector[back].T)
                times = np.clip(np.rint(-line / (2 * np.maximum(bend, 1e-12))), 1, np.maximum(1, room))
                won = np.where(room > 0, 2 * times * line + 2 * times**2 * bend, 0.0)
                x = int(won.argmin())
                if won.flat[x] < found:
                    a, b = divmod(x, len(back))
                    found, exchange = won.flat[x], (int(there[a]), int(back[b]), s, t, int(n[a, b] * times[a, b]), int(k[a, b] * times[a, b]))
        if exchange is None:
            break
        i, j, s, t, n, k = exchange
        shift(i, s, t, n)
        shift(j, t, s, k)
    return [{s: int(n) for s, n in zip(splits, row, strict=True)} for row in got]


def related_splits(df: DataFrame, id_col: str, key: str, label: str, shares: dict[str, int], seed: int = 0, most: int = 20_000) -> DataFrame:
    """(id, assigned): a split for every row, one for all rows with the same ``key``; rows with null key stand alone.

    ``shares`` are weights per split. Sizes follow them as far as components allow, and each label is spread alike. A
    component's profile are the labels with at least an eighth of its rows, in quarters; components reach the driver only
    as counts per (size class, profile) with the exact label sums of each such bundle, and more than ``most`` bundles are an
    error. ``id_col`` is unique and not null; a null label is a label of its own. Other columns are not read. An empty
    table gives an empty result.
    """
    own = F.coalesce(F.concat(F.lit("k:"), F.col(key)), F.concat(F.lit("i:"), F.col(id_col).cast("string")))
    rows = df.select(F.col(id_col).alias("id"), own.alias("key"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"))
    per = materialize(rows.groupBy("key", "label").agg(F.count("*").alias("n")))
    sizes = per.groupBy("key").agg(F.sum("n").alias("size"))
    quarter = F.floor(F.col("n") / F.col("size") * 4 + 0.5).cast("int")
    main = F.when(F.col("n") * 8 >= F.col("size"), F.concat(F.col("label"), F.lit("\u0001"), quarter.cast("string")))
    parts = per.join(sizes, "key").groupBy("key", "size").agg(F.concat_ws("\u0002", F.sort_array(F.collect_list(main))).alias("profile"))
    parts = materialize(parts.select("key", "size", _size_class(F.col("size")).alias("size_class"), "profile"))
    counts = parts.groupBy("size_class", "profile").agg(F.count("*").alias("n"), F.sum("size").alias("rows")).orderBy("size_class", "profile").limit(most + 1).collect()
    if len(counts) > most:
        raise ValueError(f"more than {most} bundles of components")
    sums: dict[tuple[int, str], dict[str, int]] = {}
    for r in salted_join(per, parts.select("key", "size_class", "profile"), ["key"]).groupBy("size_class", "profile", "label").agg(F.sum("n").alias("n")).collect():
        sums.setdefault((r["size_class"], r["profile"]), {})[r["label"]] = r["n"]
    bundles = [Bundle(r["n"], max(1, round(r["rows"] / r["n"])), {c: n / r["rows"] for c, n in sums[r["size_class"], r["profile"]].items()}) for r in counts]
    plan = []
    for r, got in zip(counts, allocate(bundles, shares) if bundles else [], strict=True):
        low = 0
        for s in sorted(got):
            if got[s]:
                plan.append((r["size_class"], r["profile"], s, low, low + got[s]))
                low += got[s]
    spark = df.sparkSession
    quotas = spark.createDataFrame(plan, "size_class bigint, profile string, assigned string, low bigint, high bigint")
    ranked = rank_by_hash(parts.select("key", "size_class", "profile"), ["size_class", "profile"], "key", "rank", seed=seed)
    placed = ranked.join(quotas, ["size_class", "profile"]).where("rank > low and rank <= high").select("key", "assigned")
    return salted_join(rows.select("id", "key"), placed, ["key"]).select("id", "assigned")


def split_report(df: DataFrame, assigned: str, label: str, shares: dict[str, int]) -> DataFrame:
    """(assigned, label, rows, share, target): what part of each label each split got."""
    out = df.groupBy(F.col(assigned).alias("assigned"), F.col(label).alias("label")).agg(F.count("*").alias("rows"))
    per = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    target = F.lit(None).cast("double")
    for s, w in shares.items():
        target = F.when(F.col("assigned") == s, w / sum(shares.values())).otherwise(target)
    both = out.join(per, out["label"].eqNullSafe(per["label"])).select(out["assigned"], out["label"], "rows", (F.col("rows") / F.col("n")).alias("share"))
    return both.withColumn("target", target)
