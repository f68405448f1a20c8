"""Long exact spans shared between records, by seeds, collinear chains and alignment.

Seeds are minimizers dense enough that every span of the asked length holds one, and equal spans hold equal ones. A
seed travels with the bases around it, so matches are extended where the seeds meet and no sequence is moved again.
Matches of two records are chained with gap costs through a Fenwick tree; the exact runs of the chains are the shared
spans, and the chains themselves are the fuzzy passages around them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import dna
from strandloom.llm.near_dup import as_bits
from strandloom.runtime import materialize, salted_join, sorted_groups, spread, task_slots


def _flank(codes: np.ndarray, at: np.ndarray, size: int, step: int) -> np.ndarray:
    """Rows of ``size`` codes walking from ``at`` by ``step``; 4 beyond the array."""
    p = at[:, None] + step * np.arange(size)
    out = codes[np.clip(p, 0, len(codes) - 1)]
    out[(p < 0) | (p >= len(codes))] = 4
    return out


def _pack_rows(rows: np.ndarray) -> pa.Array:
    """Rows of codes as binaries: the number of leading letters, then two bits a base."""
    m, size = rows.shape
    other = rows >= 4
    clear = np.where(other.any(1), other.argmax(1), size).astype("<u2")
    wide = np.zeros((m, -(-size // 4) * 4), np.uint8)
    wide[:, :size] = rows & 3
    q = wide.reshape(m, -1, 4)
    body = (q[..., 0] << 6) | (q[..., 1] << 4) | (q[..., 2] << 2) | q[..., 3]
    data = np.concatenate([clear[:, None].view(np.uint8), body], 1)
    offsets = np.arange(m + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _unpack_rows(column: pa.Array, size: int) -> np.ndarray:
    """Codes of ``_pack_rows``; positions from the first other character on are 4."""
    n = len(column)
    width = 2 + -(-size // 4)
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    data = np.frombuffer(column.buffers()[2], np.uint8)[start : start + n * width].reshape(n, width)
    clear, body = data[:, 0].astype(np.int32) | (data[:, 1].astype(np.int32) << 8), data[:, 2:]
    rows = np.stack([(body >> 6) & 3, (body >> 4) & 3, (body >> 2) & 3, body & 3], -1).reshape(n, -1)[:, :size]
    rows = rows.copy()
    rows[np.arange(size)[None, :] >= clear[:, None]] = 4
    return rows


def seeds(df: DataFrame, id_col: str, seq_col: str, span: int, k: int) -> DataFrame:
    """(seed, id, place, left, right): minimizers of windows of span - k + 1 k-mers, with the span - k bases on each side."""
    flank, width = span - k, span - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for low, _, codes, starts, _ in dna.encoded(batch.column(1), dna.CODE):
                forward, _, valid = dna.packed(codes, k, both=False)
                at = dna.minimizers(dna.mixed(forward), valid, width)
                for part in np.array_split(at, -(-len(at) // 20_000)) if len(at) else ():
                    row = np.searchsorted(starts, part, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(forward[part].view(np.int64)),
                            pa.array(ids[low + row]),
                            pa.array((part - starts[row]).astype(np.int32)),
                            _pack_rows(_flank(codes, part - 1, flank, -1)),
                            _pack_rows(_flank(codes, part + k, flank, 1)),
                        ],
                        names=["seed", "id", "place", "left", "right"],
                    )

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(seq_col).alias("seq")).where(f"id is not null and length(seq) >= {span}")
    return spread(rows).mapInArrow(run, "seed bigint, id bigint, place int, left binary, right binary")


def _links(seed: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one seed and two records, so few that each row has a link for every span it shares.

    For each split of the span's flanks into left and right, rows with equal flanks form a class, sorted by record; a
    row is linked to the next record of its class, or to the one before if there is none. Classes of n rows so give n
    links, never n * n.
    """
    size = left.shape[1]
    weight = dna.mixed(np.arange(1, size + 1, dtype=np.uint64))
    to_left = np.concatenate([np.zeros((len(seed), 1), np.uint64), np.cumsum((left.astype(np.uint64) + 1) * weight, 1, dtype=np.uint64)], 1)
    to_right = np.concatenate([np.zeros((len(seed), 1), np.uint64), np.cumsum((right.astype(np.uint64) + 1) * weight, 1, dtype=np.uint64)], 1)
    clear_left = np.where((left >= 4).any(1), (left >= 4).argmax(1), size)
    clear_right = np.where((right >= 4).any(1), (right >= 4).argmax(1), size)
    own = dna.mixed(seed.view(np.uint64))
    rank = np.arange(len(seed))
    found: list[np.ndarray] = []
    for a in range(size + 1):
        at = np.flatnonzero((clear_left >= a) & (clear_right >= size - a))
        if len(at) < 2:
            continue
        kind = dna.mixed(own[at] + dna.mixed(to_left[at, a]) * np.uint64(3) + dna.mixed(to_right[at, size - a]) * np.uint64(5))
        order = np.lexsort((rank[at], ids[at], kind))
        at, kind = at[order], kind[order]
        who = ids[at]
        new_class = np.concatenate([[True], kind[1:] != kind[:-1]])
        new_run = new_class | np.concatenate([[True], who[1:] != who[:-1]])
        run = np.cumsum(new_run) - 1
        first = np.flatnonzero(new_run)
        of = (np.cumsum(new_class) - 1)[first]
        last = np.concatenate([first[1:], [len(at)]]) - 1
        nxt = np.where(np.concatenate([of[1:] == of[:-1], [False]]), np.concatenate([first[1:], [0]]), -1)
        prv = np.where(np.concatenate([[False], of[1:] == of[:-1]]), np.concatenate([[0], last[:-1]]), -1)
        partner = np.where(nxt >= 0, nxt, prv)[run]
        has = partner >= 0
        x, y = at[has], at[partner[has]]
        found.append(np.unique(np.minimum(x, y) * len(seed) + np.maximum(x, y)))
    if not found:
        return rank[:0], rank[:0]
    pairs = np.unique(np.concatenate(found))
    return pairs // len(seed), pairs % len(seed)


_FOUND = "a bigint, b bigint, at_a int, at_b int, size int, seed bigint, left binary, right binary"


def _row(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    """A batch of ``_FOUND`` with nulls where a column is not given."""
    kinds = {"a": pa.int64(), "b": pa.int64(), "at_a": pa.int32(), "at_b": pa.int32(), "size": pa.int32(), "seed": pa.int64(), "left": pa.binary(), "right": pa.binary()}
    return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, t)) for k, t in kinds.items()], names=list(kinds))


def matches(rows: DataFrame, span: int, k: int, slots: int, most: int = 20_000) -> DataFrame:
    """(a, b, at_a, at_b, size): exact matches of at least ``span`` letters around shared seeds, a < b.

    A seed with over ``most`` places is not compared in one task; its places go through ``_by_window``.
    """
    flank = span - k

    def some(table: pa.Table) -> Iterable[pa.RecordBatch]:
        seed, ids, place = table["seed"].to_numpy(), table["id"].to_numpy(), table["place"].to_numpy().astype(np.int64)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(seed)) + 1])
        count = np.diff(np.concatenate([cut, [len(seed)]]))
        differ = np.minimum.reduceat(ids, cut) != np.maximum.reduceat(ids, cut)
        keep = np.flatnonzero(np.repeat(differ, count))
        if not len(keep):
            return
        table = table.take(pa.array(keep)).combine_chunks()
        seed, ids, place, count = seed[keep], ids[keep], place[keep], count[differ]
        left, right = (_unpack_rows(table[c].chunk(0), flank) for c in ("left", "right"))
        starts = np.cumsum(count) - count
        two = starts[count == 2]
        x, y = [two], [two + 1]
        many = np.flatnonzero(np.repeat(count > 2, count))
        if len(many):
            p, q = _links(seed[many], ids[many], left[many], right[many])
            x.append(many[p])
            y.append(many[q])
        a, b = np.concatenate(x), np.concatenate(y)
        swap = ids[a] > ids[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        bases = []
        for side in (left, right):
            apart = (side[a] != side[b]) | (side[a] >= 4)
            bases.append(np.where(apart.any(1), apart.argmax(1), flank))
        size = bases[0] + k + bases[1]
        good = size >= span
        a, b, back, size = a[good], b[good], bases[0][good], size[good]
        cols = {"a": ids[a], "b": ids[b], "at_a": (place[a] - back).astype(np.int32), "at_b": (place[b] - back).astype(np.int32), "size": size.astype(np.int32)}
        yield _row({c: pa.array(v) for c, v in cols.items()}, len(a))

    def run(table: pa.Table) -> Iterable[pa.RecordBatch]:
        # whole groups of a seed, about 50,000 rows at a time
        seed = table["seed"].to_numpy()
        ends = np.append(np.flatnonzero(np.diff(seed)) + 1, len(seed))
        low = 0
        while low < len(seed):
            high = int(ends[min(np.searchsorted(ends, low + 50_000), len(ends) - 1)])
            yield from some(table.slice(low, high - low))
            low = high

    def large(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        yield _row({"a": batch["id"], "at_a": batch["place"], "seed": batch["seed"], "left": batch["left"], "right": batch["right"]}, batch.num_rows)

    found = materialize(sorted_groups(rows, ["seed"], ["id", "place"], _FOUND, run, partitions=slots, most=most, large=large))
    pairs = found.where("seed is null").select("a", "b", "at_a", "at_b", "size")
    hot = found.where("seed is not null").select("seed", F.col("a").alias("id"), F.col("at_a").alias("place"), "left", "right")
    return pairs.union(_by_window(hot, span, k))


def _by_window(hot: DataFrame, span: int, k: int) -> DataFrame:
    """Matches of exactly ``span`` letters for places of very frequent seeds.

    Every window of ``span`` letters around a place becomes a row under the hash of its letters, and the records of each
    class of equal windows are linked as in ``_links``, n links for n records, but by shuffles instead of within a task.
    """
    flank = span - k

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 5000):
                batch = whole.slice(low, 5000)
                n = batch.num_rows
                seed, ids, place = batch["seed"].to_numpy().view(np.uint64), batch["id"].to_numpy(), batch["place"].to_numpy()
                left, right = _unpack_rows(batch["left"], flank), _unpack_rows(batch["right"], flank)
                forms = np.zeros((2, n, flank + 1), np.uint64)
                clear = np.zeros((2, n), np.int64)
                for i, side in enumerate((left, right)):
                    weight = dna.mixed(np.arange(1 + 1000 * i, flank + 1 + 1000 * i, dtype=np.uint64))
                    forms[i, :, 1:] = np.cumsum((side.astype(np.uint64) + 1) * weight, 1, dtype=np.uint64)
                    clear[i] = np.where((side >= 4).any(1), (side >= 4).argmax(1), flank)
                row, a = np.nonzero((np.arange(flank + 1)[None] <= clear[0][:, None]) & (flank - np.arange(flank + 1)[None] <= clear[1][:, None]))
                kind = dna.mixed(dna.mixed(seed[row]) + dna.mixed(forms[0, row, a] + a.astype(np.uint64)) * np.uint64(3) + dna.mixed(forms[1, row, flank - a]) * np.uint64(5))
                yield pa.RecordBatch.from_arrays([pa.array(kind.view(np.int64)), pa.array(ids[row]), pa.array((place[row] - a).astype(np.int32))], names=["kind", "id", "at"])

    rows = hot.mapInArrow(windows, "kind bigint, id bigint, at int")
    # every record of a class is linked to the first one, and that to the last: sums without a sort, whatever the class holds
    ends = rows.groupBy("kind").agg(F.min(F.struct("id", "at")).alias("low"), F.max(F.struct("id", "at")).alias("high")).where("low.id < high.id")
    both = salted_join(rows, ends, ["kind"]).withColumn("o", F.when(F.col("id") == F.col("low.id"), F.col("high")).otherwise(F.col("low")))
    both = both.select("id", "at", F.col("o.id").alias("other"), F.col("o.at").alias("there"))
    ahead = F.col("id") < F.col("other")
    pick = lambda x, y: F.when(ahead, F.col(x)).otherwise(F.col(y))
    return both.select(pick("id", "other").alias("a"), pick("other", "id").alias("b"), pick("at", "there").alias("at_a"), pick("there", "at").alias("at_b"), F.lit(span).alias("size"))


class _Best:
    """A Fenwick tree over ranks that gives the best (score, item) among ranks up to a limit."""

    __slots__ = ("score", "item")

    def __init__(self, size: int):
        self.score = [float("-inf")] * (size + 1)
        self.item = [-1] * (size + 1)

    def put(self, rank: int, score: float, item: int) -> None:
        rank += 1
        while rank < len(self.score):
            if score > self.score[rank]:
                self.score[rank], self.item[rank] = score, item
            rank += rank & -rank

    def best(self, below: int) -> tuple[float, int]:
        score, item = float("-inf"), -1
        while below > 0:
            if self.score[below] > score:
                score, item = self.score[below], self.item[below]
            below -= below & -below
        return score, item


def chain(x: np.ndarray, y: np.ndarray, size: np.ndarray, gap_cost: float) -> np.ndarray:
    """The chain number of each match of two records.

    A match follows the one before it (both ends at or before its starts) that gives the best sum of sizes less
    ``gap_cost`` per base skipped in either record, or starts a chain where none pays. Predecessors are found with a
    sweep over x and a Fenwick tree over the ends in y; a match followed by several matches keeps the best of them.
    """
    n = len(x)
    if n == 1:
        return np.zeros(1, np.int64)
    end_x, end_y = x + size, y + size
    ranks = np.unique(end_y)
    of_start = np.searchsorted(ranks, y, "right")
    of_end = np.searchsorted(ranks, end_y)
    tree = _Best(len(ranks))
    by_start, by_end = np.lexsort((y, x)).tolist(), np.argsort(end_x, kind="stable").tolist()
    before, total, k = [-1] * n, [0.0] * n, 0
    xs, ys, sizes, ex, ey = x.tolist(), y.tolist(), size.tolist(), end_x.tolist(), end_y.tolist()
    for i in by_start:
        while k < n and ex[by_end[k]] <= xs[i]:
            j = by_end[k]
            tree.put(int(of_end[j]), total[j] + gap_cost * (ex[j] + ey[j]), j)
            k += 1
        score, j = tree.best(int(of_start[i]))
        gain = score - gap_cost * (xs[i] + ys[i])
        total[i] = sizes[i] + max(0.0, gain)
        before[i] = j if j >= 0 and gain > 0 else -1
    out, used, number = [-1] * n, [False] * n, 0
    for i in sorted(range(n), key=lambda i: (-total[i], xs[i], ys[i])):
        if out[i] >= 0:
            continue
        j = i
        while j >= 0 and out[j] < 0:
            out[j], j = number, before[j]
        number += 1
    return np.array(out)


def chained(found: DataFrame, gap_cost: float, slots: int) -> DataFrame:
    """(a, b, chain, at_a, at_b, size): the maximal exact runs of each pair of records, with the chain each belongs to."""

    def run(table: pa.Table) -> Iterable[pa.RecordBatch]:
        a, b = table["a"].to_numpy(), table["b"].to_numpy()
        x, size = table["at_a"].to_numpy().astype(np.int64), table["size"].to_numpy().astype(np.int64)
        diagonal = table["diagonal"].to_numpy().astype(np.int64)
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        line = np.cumsum(new | np.concatenate([[True], diagonal[1:] != diagonal[:-1]]))
        # on one diagonal overlapping matches are one longer match
        shift = line * (1 << 40)
        reach = np.maximum.accumulate(x + size + shift)
        head = np.concatenate([[True], (x + shift)[1:] > reach[:-1]])
        first = np.flatnonzero(head)
        last = np.concatenate([first[1:], [len(x)]]) - 1
        a, b, diagonal, pair = a[first], b[first], diagonal[first], np.cumsum(new)[first]
        x, size = x[first], reach[last] - shift[last] - x[first]
        y = x + diagonal
        cut = np.flatnonzero(np.diff(pair)) + 1
        number = np.zeros(len(x), np.int64)
        for low, high in zip([0, *cut.tolist()], [*cut.tolist(), len(x)], strict=True):
            if high - low > 1:
                number[low:high] = chain(x[low:high], y[low:high], size[low:high], gap_cost)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.array(v.astype(np.int32)) for v in (number, x, y, size))], names=["a", "b", "chain", "at_a", "at_b", "size"])

    rows = found.withColumn("diagonal", F.col("at_b") - F.col("at_a"))
    return sorted_groups(rows, ["a", "b"], ["diagonal", "at_a"], "a bigint, b bigint, chain int, at_a int, at_b int, size int", run, partitions=slots)


def merged(spans: DataFrame, slots: int) -> DataFrame:
    """(id, span_start, span_end): the union of half-open intervals of each id; touching intervals become one."""

    def run(table: pa.Table) -> Iterable[pa.RecordBatch]:
        ids, s, e = table["id"].to_numpy(), table["s"].to_numpy().astype(np.int64), table["e"].to_numpy().astype(np.int64)
        shift = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]])) * (1 << 40)
        reach = np.maximum.accumulate(e + shift)
        first = np.flatnonzero(np.concatenate([[True], (s + shift)[1:] > reach[:-1]]))
        last = np.concatenate([first[1:], [len(s)]]) - 1
        yield pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(s[first].astype(np.int32)), pa.array((reach[last] - shift[last]).astype(np.int32))], names=["id", "span_start", "span_end"])

    return sorted_groups(spans, ["id"], ["s", "e"], "id bigint, span_start int, span_end int", run, partitions=slots)


def passages(df: DataFrame, id_col: str, seq_col: str, span: int = 100, k: int = 31, gap_cost: float = 0.2, most: int = 20_000) -> DataFrame:
    """The exact runs (a, b, chain, at_a, at_b, size) behind ``shared_spans``, by pair of linked records and chain.

    A chain from its first to its last run is a fuzzy passage: a stretch that two records share up to edits. Records
    are linked so that every shared span has a link, not every pair of its holders.
    """
    if not k <= min(31, span) or span - k > 65_535:
        raise ValueError("k must be at most 31 and at most span, and span at most 65,535 more")
    slots = task_slots(df.sparkSession)
    return chained(matches(seeds(df, id_col, seq_col, span, k), span, k, slots, most), gap_cost, slots)


def aligned_passages(df: DataFrame, id_col: str, seq_col: str, span: int = 100, k: int = 31, gap_cost: float = 0.2, most: int = 20_000) -> DataFrame:
    """(a, b, start_a, end_a, start_b, end_b, exact, edits, identity): the fuzzy passages of linked records, one row a chain.

    A chain's exact runs are joined by aligning the gaps between them: ``exact`` counts the letters of the runs, ``edits``
    the substitutions, insertions and deletions in the gaps, and identity is 1 - edits / the longer side. Runs that
    overlap in one of the records count as far as they go beyond the one before. Chains of one run need no text; for others
    the letters of both records are brought together, at two bits each. Rows and ids as in ``shared_spans``.
    """
    runs = materialize(passages(df, id_col, seq_col, span, k, gap_cost, most))
    per = runs.groupBy("a", "b", "chain").agg(F.sort_array(F.collect_list(F.struct("at_a", "at_b", "size"))).alias("runs"))
    per = materialize(per)
    whole = per.where(F.size("runs") == 1).select("a", "b", F.element_at("runs", 1).alias("r"))
    whole = whole.select("a", "b", F.col("r.at_a").alias("start_a"), (F.col("r.at_a") + F.col("r.size")).alias("end_a"), F.col("r.at_b").alias("start_b"), (F.col("r.at_b") + F.col("r.size")).alias("end_b"))
    whole = whole.withColumn("exact", F.col("end_a") - F.col("start_a")).withColumn("edits", F.lit(0))
    bits = as_bits(df, id_col, seq_col, dna.CODE)
    several = per.where(F.size("runs") > 1).join(bits.select(F.col("id").alias("a"), F.col("bits").alias("bits_a")), "a").join(bits.select(F.col("id").alias("b"), F.col("bits").alias("bits_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            out = np.zeros((6, batch.num_rows), np.int32)
            for i, runs_ in enumerate(rows):
                x, y = dna.from_bits(batch.column(3)[i].as_py()), dna.from_bits(batch.column(4)[i].as_py())
                end_a, end_b = runs_[0]["at_a"], runs_[0]["at_b"]
                exact = edits = 0
                for r in runs_:
                    skip = max(0, end_a - r["at_a"], end_b - r["at_b"])
                    if skip >= r["size"]:
                        continue
                    a, b = r["at_a"] + skip, r["at_b"] + skip
                    edits += dna.distance(x[end_a:a], y[end_b:b])[0]
                    exact += r["size"] - skip
                    end_a, end_b = r["at_a"] + r["size"], r["at_b"] + r["size"]
                out[:, i] = (runs_[0]["at_a"], end_a, runs_[0]["at_b"], end_b, exact, edits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out)], names=["a", "b", "start_a", "end_a", "start_b", "end_b", "exact", "edits"])

    fuzzy = several.select("a", "b", "runs", "bits_a", "bits_b").mapInArrow(run, "a bigint, b bigint, start_a int, end_a int, start_b int, end_b int, exact int, edits int")
    longer = F.greatest(F.col("end_a") - F.col("start_a"), F.col("end_b") - F.col("start_b"))
    return whole.union(fuzzy).withColumn("identity", 1 - F.col("edits") / longer)


def shared_spans(df: DataFrame, id_col: str, seq_col: str, span: int = 100, k: int = 31, gap_cost: float = 0.2, most: int = 20_000) -> DataFrame:
    """(id, span_start, span_end): maximal runs of positions that lie in some stretch of ``span`` letters, all A, C, G, T,
    that occurs in another row's sequence too.

    Positions are 0-based, intervals half open, letter case is ignored, only the same strand counts, and a span repeated
    within one row alone is not shared. Rows with null id, null or short sequences take no part; ids are unique
    integers. No other columns are read; an empty table gives an empty result.
    """
    runs = passages(df, id_col, seq_col, span, k, gap_cost, most)
    sides = F.array(F.struct(F.col("a").alias("id"), F.col("at_a").alias("s")), F.struct(F.col("b").alias("id"), F.col("at_b").alias("s")))
    spans = runs.select("size", F.explode(sides).alias("x")).select("x.id", "x.s", (F.col("x.s") + F.col("size")).alias("e"))
    return merged(spans, task_slots(df.sparkSession))


def shared_report(df: DataFrame, id_col: str, seq_col: str, spans: DataFrame) -> DataFrame:
    """(id, spans, shared, length, share): how much of every row is shared elsewhere; rows without spans have 0, rows
    with null sequence a null share, rows with an empty one 0."""
    per = spans.groupBy("id").agg(F.count("*").alias("spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.length(seq_col).alias("length"))
    zero = F.lit(0).cast("bigint")
    out = rows.join(per, "id", "left").select("id", F.coalesce("spans", zero).alias("spans"), F.coalesce("shared", zero).alias("shared"), "length")
    return out.withColumn("share", F.when(F.col("length") > 0, F.col("shared") / F.col("length")).when(F.col("length") == 0, F.lit(0.0)))
