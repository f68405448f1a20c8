"""Near-duplicate sequences by a prefix-tree join of n-gram sets.

Every distinct content (either strand) is reduced to the smallest hashes of its canonical n-grams. Hash order is the
global order of the sets. Each set is sent to the tree of each of its n-grams together with the tail of greater ones;
in a tree the sorted tails share their common paths, a query walks all paths that still can reach the overlap, and
subtrees whose remaining length cannot are pruned. Pairs found there are checked base by base, and classes are the
connected components of what holds. Short records have spaced grams, as contiguous ones seldom survive many edits there.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, OrderedDict
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import dna
from strandloom.operators.graph import connected_components
from strandloom.operators.similarity import _PACKED, _arrays, _bucketed, _grouped, _packed, _restored, _split, _squeezed
from strandloom.runtime import _in_ranges, by_bucket, materialize, salted_join, sorted_groups, spread, task_slots


def content_key(codes: np.ndarray) -> bytes:
    """128 bits that are equal for equal letters, whichever strand and case they are stored in."""
    a, b = codes.tobytes(), dna.reverse_complement(codes).tobytes()
    return min(hashlib.md5(a).digest(), hashlib.md5(b).digest())


def _smallest(hashes: np.ndarray, places: np.ndarray, length: int, size: int) -> np.ndarray:
    """The ``size`` smallest distinct hashes, ascending, cut to 60 bits; below these the 16th of the record each is in."""
    if len(hashes) > 8 * size:
        some = hashes < np.uint64(min(2**64 - 1, int(4 * size / len(hashes) * 2**64)))
        if some.sum() >= 2 * size:
            hashes, places = hashes[some], places[some]
    found = np.sort((hashes & ~np.uint64(15)) | (places.astype(np.uint64) * np.uint64(16) // np.uint64(max(1, length))))
    # of a gram's places the first stands for all
    first = np.concatenate([[True], (found[1:] ^ found[:-1]) > np.uint64(15)]) if len(found) else np.zeros(0, bool)
    return found[first][:size]


#: Spaced patterns of 14 compared places, for short records. Their hits depend less on each other than those
#: of contiguous grams do, so a short record with many edits keeps some.
PATTERNS = ("111011010011010111011", "110111001110101101011", "1101001111011001110101", "11110100110110010101101")


def _spaced(codes: np.ndarray, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """The canonical value of every window's compared places, two bits each, and whether the window is all A, C, G, T."""
    span, at = len(pattern), [i for i, c in enumerate(pattern) if c == "1"]
    n = len(codes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    x = (codes & 3).astype(np.uint64)
    forward, backward = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for p in at:
        forward = (forward << np.uint64(2)) | x[p : p + n]
        backward = (backward << np.uint64(2)) | (np.uint64(3) - x[span - 1 - p : span - 1 - p + n])
    bad = np.concatenate([[0], np.cumsum(codes >= 4, dtype=np.int32)])
    return np.minimum(forward, backward), bad[span:] == bad[:-span]


def _spaced_grams(codes: np.ndarray, size: int) -> np.ndarray:
    """The smallest hashes over all patterns of one short record."""
    hashes, places = [], []
    for number, pattern in enumerate(PATTERNS, 1):
        values, valid = _spaced(codes, pattern)
        hashes.append(dna.mixed(values[valid] + np.uint64(number << 60)))
        places.append(np.flatnonzero(valid))
    return _smallest(np.concatenate(hashes), np.concatenate(places), len(codes), size)


def sketched(df: DataFrame, id_col: str, seq_col: str, k: int = 16, size: int = 256, min_letters: int = 60, short: int = 800, max_edit: float = 0.2) -> DataFrame:
    """(id, content, letters, grams, spaced): the smallest hashed canonical k-mers of each row with enough letters.

    Records of under ``short`` letters have ``spaced`` grams instead, and those within ``max_edit`` of that length have
    both, so that any two that can be near-duplicates have one kind in common. The low four bits of a gram are its place.
    """
    above, below = short * (1 - 1.1 * max_edit), short / (1 - 1.1 * max_edit)

    def lists(rows: list[np.ndarray]) -> pa.Array:
        offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in batches:
            ids = batch.column(0)
            for low, high, codes, starts, lengths in dna.encoded(batch.column(1), dna.LETTERS):
                forward, backward, valid = dna.packed(codes, k)
                hashes = dna.mixed(np.minimum(forward, backward))
                at, keys, letters, grams, spaced = [], [], [], [], []
                for r in range(high - low):
                    a, n = int(starts[r]), int(lengths[r])
                    own = codes[a : a + n]
                    m = int((own < 4).sum())
                    if m < min_letters:
                        continue
                    h = hashes[a : max(a, a + n - k + 1)]
                    at.append(low + r)
                    keys.append(content_key(own))
                    letters.append(m)
                    whole = np.flatnonzero(valid[a : a + len(h)])
                    grams.append(_smallest(h[whole], whole, n, size) if m >= above else none)
                    spaced.append(_spaced_grams(own, size) if m < below else none)
                if at:
                    columns = [ids.take(pa.array(at)), pa.array(keys, pa.binary()), pa.array(letters, pa.int32()), lists(grams), lists(spaced)]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "content", "letters", "grams", "spaced"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(seq_col).alias("seq")).where("id is not null and seq is not null")
    return spread(rows).mapInArrow(run, "id bigint, content binary, letters int, grams array<bigint>, spaced array<bigint>")


class _Tree:
    """A prefix tree over ascending integer tuples; every node knows the longest way down from it."""

    __slots__ = ("kids", "ends", "depth")

    def __init__(self) -> None:
        self.kids: dict[int, _Tree] = {}
        self.ends: list[int] = []
        self.depth = 0

    def insert(self, tail: list[int], item: int) -> None:
        node, left = self, len(tail)
        for t in tail:
            node.depth = max(node.depth, left)
            left -= 1
            node = node.kids.setdefault(t, _Tree())
        node.ends.append(item)

    def search(self, tail: list[int], need: int, marks: list[int] | None = None) -> dict[int, tuple[int, int]]:
        """Items that share at least ``need`` members with ``tail``: that number, and the union of the shared members' marks."""
        found: dict[int, tuple[int, int]] = {}
        size = len(tail)
        place = {t: i for i, t in enumerate(tail)}
        stack = [(self, 0, 0, 0)]
        while stack:
            node, at, shared, mark = stack.pop()
            if shared + min(size - at, node.depth) < need:
                continue
            if shared >= need:
                for item in node.ends:
                    found[item] = max((shared, mark), found.get(item, (0, 0)))
            for t, kid in node.kids.items():
                i = place.get(t, -1)
                if i >= at:
                    stack.append((kid, i + 1, shared + 1, mark | marks[i] if marks else 0))
                else:
                    # t is no member: members below are greater than t, so smaller ones of the query are spent
                    nxt = at
                    while nxt < size and tail[nxt] < t:
                        nxt += 1
                    stack.append((kid, nxt, shared, mark))
        return found


class _Set:
    """A set in one gram's list: item, kind, letters, the gram's own place in the record, the grams before it and after it."""

    __slots__ = ("item", "kind", "letters", "mark", "head", "tail", "marks")

    def __init__(self, item: int, kind: int, letters: int, place: int, head: list[int], tail: list[int]):
        self.item, self.kind, self.letters, self.mark, self.head = item, kind, letters, 1 << place, head
        self.tail = [t >> 4 for t in tail]
        self.marks = [1 << (t & 15) for t in tail]

    def meets_first(self, other: _Set) -> bool:
        """Whether the two share no smaller gram: the one list in which all they share is seen, and the pair is taken."""
        return not self.head or not other.head or {t >> 4 for t in self.head}.isdisjoint([t >> 4 for t in other.head])


def _fits(x: _Set, y: _Set, ratio: float) -> bool:
    return min(x.letters, y.letters) >= ratio * max(x.letters, y.letters)


def _spread(mark: int, letters: int, apart: int) -> bool:
    """Whether shared grams (marked 16ths of a record) are more than one shared stretch.

    They must lie ``apart`` 16ths from each other, or less in records whose 16ths are few bases. In records of 1,000 letters
    or more, where edits leave several grams, they must fall into two separate stretches or reach six 16ths.
    """
    if mark.bit_length() - (mark & -mark).bit_length() < min(apart, letters // 200):
        return False
    return not apart or letters < 1000 or (mark & ~(mark << 1)).bit_count() > 1 or mark.bit_count() >= 6


def _join_list(sets: list[_Set], need: int, crowd: int, alike: float, trust: bool, ratio: float, apart: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Pairs of a tree's sets of different kinds with ``need`` shared members, and its leaders.

    Pairs must fit in length, and the shared grams must not all lie in one place of the later set's record, as those of a
    shared stretch do. In a list longer than ``crowd`` a set that shares ``alike`` of the smaller one with an earlier leader
    of its own kind is left to that leader. With ``trust`` a leader of another kind will do: it is linked to the best such
    leader alone. Others become leaders, linked to all leaders they overlap.
    """
    if len(sets) == 2:
        x, y = sets
        if x.kind == y.kind or not _fits(x, y, ratio):
            return [], []
        own = dict(zip(y.tail, y.marks, strict=True))
        shared = [own[t] for t in x.tail if t in own]
        mark = y.mark
        for m in shared:
            mark |= m
        return ([(x.item, y.item)] if len(shared) >= need and _spread(mark, y.letters, apart) and x.meets_first(y) else []), []
    pairs, leaders = [], []
    led = len(sets) > crowd
    # sets that share a smaller gram have met there: a large group of them needs no search within itself
    group: list[int | None] = [None] * len(sets)
    if crowd and len(sets) > 16:
        size = Counter(t >> 4 for x in sets for t in x.head)
        most = [max((t >> 4 for t in x.head), key=lambda t: (size[t], t), default=None) for x in sets]
        own_size = Counter(most)
        group = [g if g is not None and own_size[g] > 8 else None for g in most]
    trees = {g: _Tree() for g in group}
    if len(trees) == 1 and None not in trees:
        return [], []
    for x, own in enumerate(sets):
        found = {}
        for g, tree in trees.items():
            if (tree.kids or tree.ends) and (g is None or g != group[x]):
                found |= tree.search(own.tail, need, own.marks)
        found = {y: f for y, f in found.items() if _fits(own, sets[y], ratio)}
        if led:
            near = {y: n / max(1, min(len(own.tail), len(sets[y].tail))) for y, (n, _) in found.items() if trust or sets[y].kind == own.kind}
            best = max(near, key=lambda y: (near[y], -y), default=None)
            if best is not None and near[best] >= alike:
                if sets[best].kind != own.kind:
                    pairs.append((sets[best].item, own.item))
                continue
            leaders.append(x)
        pairs += [(sets[y].item, own.item) for y, (_, mark) in found.items() if sets[y].kind != own.kind and _spread(mark | own.mark, own.letters, apart) and own.meets_first(sets[y])]
        trees[group[x]].insert(own.tail, x)
    return pairs, leaders


def _tiny_pairs(sets: list[_Set], ratio: float) -> list[tuple[int, int]]:
    """All pairs of different kinds that fit in length, each kind by its first item."""
    first: dict[int, _Set] = {}
    for x in sets:
        first.setdefault(x.kind, x)
    return [(x.item, y.item) for x, y in combinations(first.values(), 2) if _fits(x, y, ratio)]


_COLUMNS = ["item", "kind", "letters", "place", "gram", "head", "tail"]
_FOUND = "role int, other bigint, item bigint, kind bigint, letters int, place int, gram bigint, head array<int>, tail array<int>"


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    lists = table[name].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()


def _members(table: pa.Table, name: str) -> Iterator[list[int]]:
    values, offsets = (x.tolist() for x in _flat(table, name))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield values[a:b]


def _sets(table: pa.Table) -> list[_Set]:
    columns = (table[c].to_pylist() for c in ("item", "kind", "letters", "place"))
    return [_Set(*row) for row in zip(*columns, _members(table, "head"), _members(table, "tail"), strict=True)]


def _lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    gram, part = table["gram"].to_numpy(), table["part"].to_numpy()
    cut = np.flatnonzero((np.diff(gram) != 0) | (np.diff(part) != 0)) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(gram)]])


def _twos(table: pa.Table, need: int, ratio: float, apart: int) -> list[tuple[int, int]]:
    """The pairs of a table whose lists have two sets each, rows 0 and 1, 2 and 3 and so on; as ``_join_list``."""
    kind, letters = table["kind"].to_numpy(), table["letters"].to_numpy()
    fits = np.minimum(letters[::2], letters[1::2]) >= ratio * np.maximum(letters[::2], letters[1::2])
    at = np.flatnonzero((kind[::2] != kind[1::2]) & fits)
    if not len(at):
        return []
    table = table.take(pa.array(np.stack([2 * at, 2 * at + 1], 1).reshape(-1)))
    values, offsets = _flat(table, "tail")
    of = np.repeat(np.arange(len(table)) // 2, np.diff(offsets))
    both = np.sort((of << 33) | ((values.astype(np.int64) >> 4 & 0xFFFFFFF) << 4) | (values & 15))
    same = np.flatnonzero((both[1:] >> 4) == (both[:-1] >> 4))
    shared = np.bincount(both[same] >> 33, minlength=len(at))
    mark = np.left_shift(1, table["place"].to_numpy()[1::2].astype(np.int64))
    np.bitwise_or.at(mark, both[same] >> 33, np.left_shift(1, both[same] & 15))
    letters = table["letters"].to_numpy()[1::2]
    good = [k for k in np.flatnonzero(shared >= need).tolist() if _spread(int(mark[k]), int(letters[k]), apart)]
    if not good:
        return []
    rows = _sets(table.take(pa.array([r for k in good for r in (2 * k, 2 * k + 1)])))
    return [(x.item, y.item) for x, y in zip(rows[::2], rows[1::2], strict=True) if x.meets_first(y)]


def _by_length(sets: list[_Set], ratio: float, least: int = 32) -> Iterator[list[_Set]]:
    """A long list in overlapping classes of length, so that any two sets that fit are together in one."""
    if ratio <= 0 or len(sets) <= least:
        yield sets
        return
    step = -math.log(ratio)
    classes: dict[int, list[_Set]] = {}
    for x in sets:
        own = int(math.log(max(1, x.letters)) / step)
        for c in (own, own + 1):
            classes.setdefault(c, []).append(x)
    yield from (c for c in classes.values() if len(c) > 1)


def _trees(routes: DataFrame, need: int, crowd: int, alike: float, trust: bool, ratio: float, apart: int) -> DataFrame:
    """Joins the sets of every (gram, part); rows of role 0 are pairs, rows of role 1 leaders of parted lists."""

    def run(table: pa.Table) -> Iterable[pa.RecordBatch]:
        low, high = _lists(table)
        size, parted = high - low, table["parts"].to_numpy()[low] > 1
        kind, tiny = table["kind"].to_numpy(), table["tiny"].to_numpy(zero_copy_only=False)
        mixed = np.minimum.reduceat(kind, low) != np.maximum.reduceat(kind, low)
        pairs: set[tuple[int, int]] = set()
        led: list[int] = low[parted & (size < 2)].tolist()
        plain = np.flatnonzero((size == 2) & mixed & ~parted & (np.add.reduceat(tiny.astype(np.int64), low) < 2))
        if len(plain):
            rows = table.take(pa.array(np.stack([low[plain], low[plain] + 1], 1).reshape(-1)))
            pairs.update((min(p), max(p)) for p in _twos(rows, need - 1, ratio, apart))
        rest = np.setdiff1d(np.flatnonzero((size > 1) & (mixed | parted)), plain)
        if len(rest):
            at = np.repeat(low[rest] - np.cumsum(size[rest]) + size[rest], size[rest]) + np.arange(size[rest].sum())
            everything = _sets(table.take(pa.array(at)))
            begin = np.cumsum(size[rest]) - size[rest]
            for k, a in zip(rest.tolist(), begin.tolist(), strict=True):
                sets = everything[a : a + int(size[k])]
                if parted[k]:
                    got, leaders = _join_list(sets, need - 1, 0, alike, trust, ratio, apart)
                    led += [int(low[k]) + x for x in leaders]
                else:
                    got = [p for part in _by_length(sets, ratio) for p in _join_list(part, need - 1, crowd, alike, trust, ratio, apart)[0]]
                few = [x for x, small in zip(sets, tiny[low[k] : high[k]], strict=True) if small]
                if len(few) > 1:
                    ids = [x.item for x in few]
                    got += _tiny_pairs(few, ratio) if not trust or len(few) <= crowd else [*zip(ids, ids[1:], strict=False), *((ids[0], x) for x in ids[1:])]
                pairs.update((min(p), max(p)) for p in got)
        if pairs:
            a, b = np.array(sorted(pairs), np.int64).T
            n = len(a)
            none = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(a), pa.array(b), *none], names=["role", "other", *_COLUMNS])
        if led:
            rows = table.take(pa.array(led)).combine_chunks()
            role, none = pa.array(np.ones(len(led), np.int32)), pa.nulls(len(led), pa.int64())
            yield from pa.Table.from_arrays([role, none, *(rows[c] for c in _COLUMNS)], names=["role", "other", *_COLUMNS]).to_batches()

    return sorted_groups(routes, ["gram", "part"], ["item"], _FOUND, run)


def _between_parts(leaders: DataFrame, need: int, most: int, tiny: int, ratio: float, apart: int) -> DataFrame:
    """Pairs (a, b) of leaders with ``need`` shared members, the gram included: all of every list.

    A list is cut into parts of about half of ``most``; a task joins two of its parts, so none holds more than one list may.
    """
    size = leaders.groupBy("gram").agg(F.count("*").alias("n"))
    cut = leaders.join(size, "gram").withColumn("of", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(most / 2)).cast("int")))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("item"), F.col("of")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    cut = cut.select(*_COLUMNS, (F.least("own", "with") * F.col("of") + F.greatest("own", "with")).alias("part"))

    def run(table: pa.Table) -> Iterable[pa.RecordBatch]:
        sets = _sets(table)
        for low, high in zip(*(x.tolist() for x in _lists(table)), strict=True):
            if high - low < 2:
                continue
            pairs = _join_list(sets[low:high], need - 1, high - low, 1.0, False, ratio, apart)[0]
            pairs += _tiny_pairs([x for x in sets[low:high] if len(x.tail) < tiny], ratio)
            if pairs:
                a, b = np.array([(min(p), max(p)) for p in pairs], np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return materialize(sorted_groups(cut, ["gram", "part"], ["tail", "item"], "a bigint, b bigint", run))


def shared_grams(sets: DataFrame, entries: int = 300_000) -> DataFrame:
    """(gram, df): grams that sets (kind, grams) of two or more kinds hold, and how many sets do.

    Most grams are held once, so they travel as packed arrays rather than rows. Tasks add up what they have of a gram
    before they send it, so one that every set holds arrives as a few entries; buckets follow the number of grams.
    """
    total = sets.agg(F.sum(F.size("grams"))).first()[0] or 0
    buckets = max(task_slots(sets.sparkSession), -(-int(total) // entries))

    def summed(gram: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(gram)
        gram, n, low, high = gram[order], n[order], low[order], high[order]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        return gram[first], np.add.reduceat(n, first).astype(np.int32), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            gram, kind = (np.concatenate(c) for c in zip(*held, strict=True))
            gram, n, low, high = summed(gram, np.ones(len(gram), np.int32), kind, kind)
            bucket = dna.mixed(gram.view(np.uint64)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            rows = []
            for b in range(buckets):
                some = order[cut[b] : cut[b + 1]]
                if len(some):
                    # what is mostly 0 packs well
                    rows.append((b, gram[some].tobytes(), (n[some] - 1).tobytes(), low[some].tobytes(), (high[some] - low[some]).tobytes()))
            names = ["bucket", "gram", "n", "low", "wide"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                kind, lists = batch.column(0).slice(at, 1000), batch.column(1).slice(at, 1000)
                gram = lists.flatten().to_numpy(zero_copy_only=False) >> 4
                if len(gram):
                    held.append((gram, np.repeat(kind.to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))))
                    size += len(gram)
                if size >= entries:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            gram, n, low, high = summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            some = low < high
            return pa.RecordBatch.from_arrays([pa.array(gram[some]), pa.array(n[some].astype(np.int64))], names=["gram", "df"])

        parts: list[tuple[np.ndarray, ...]] = []
        current = None
        for batch in batches:
            for r in range(batch.num_rows):
                if (b := batch.column(0)[r].as_py()) != current:
                    if parts:
                        yield done(parts)
                    parts, current = [], b
                gram, n, low, wide = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in ((1, np.int64), (2, np.int32), (3, np.int64), (4, np.int64)))
                parts.append((gram, n + 1, low, low + wide))
        if parts:
            yield done(parts)

    sent = spread(sets.select("kind", "grams")).mapInArrow(send, "bucket int, gram binary, n binary, low binary, wide binary")
    return by_bucket(sent, buckets).mapInArrow(count, "gram bigint, df bigint")


def _tree_pairs(sets: DataFrame, need: int, crowd: int, alike: float, most: int, tiny: int, trust: bool, ratio: float, apart: int) -> DataFrame:
    """As ``candidate_pairs``, in the prefix trees of all grams.

    Grams of one kind only are dropped first: they link nothing. A gram with over ``most`` sets is joined in parts, and
    the leaders of its parts are joined in further rounds until one list holds them. Where a round has none to absorb,
    the sets are unlike, and every two parts are joined instead.

    In lists over ``crowd`` a set that shares ``alike`` with another of its own kind is left to that one, so kinds should be
    classes that are known to belong together; with ``alike`` over 1 none is left to another. With ``trust`` any set much like it will do, and parts without leaders to absorb are
    left: a cheap first look, whose losses a second call without it, on the kinds found so far, makes good.
    """
    grams = sets.select("item", "kind", "letters", "tiny", F.explode("grams").alias("g")).select("item", "kind", "letters", "tiny", F.shiftright("g", 4).alias("gram"), F.col("g").bitwiseAND(F.lit(15)).cast("int").alias("place"))
    # a small table of what is shared, unlike that of all grams, can be sent to where the sets are
    counts = materialize(shared_grams(sets))
    kept = grams.join(counts, "gram").groupBy("item", "kind", "letters", "tiny").agg(F.sort_array(F.collect_list(F.struct("gram", "place", "df"))).alias("grams"))
    kept = materialize(kept)
    member = F.transform("grams", lambda g: F.shiftright(g["gram"], 28).cast("int").bitwiseAND(F.lit(~15)).bitwiseOR(g["place"]))
    routes = kept.select("item", "kind", "letters", "tiny", F.posexplode("grams").alias("at", "g"), member.alias("all"))
    routes = routes.where((F.size("all") - F.col("at") >= need) | F.col("tiny"))
    parts = F.ceil(F.col("g.df") / F.lit(float(most))).cast("int")
    routes = routes.select("item", "kind", "letters", "tiny", F.col("g.place").alias("place"), F.col("g.gram").alias("gram"), parts.alias("parts"), F.expr("slice(all, 1, at)").alias("head"), F.expr("slice(all, at + 2, size(all))").alias("tail"))
    routes = routes.withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"))
    found = materialize(_trees(routes, need, crowd, alike, trust, ratio, apart))
    pairs = found.where("role = 0").select(F.col("other").alias("a"), F.col("item").alias("b"))
    leaders = found.where("role = 1").select(*_COLUMNS)
    while (most_left := leaders.groupBy("gram").count().agg(F.max("count")).first()[0]) is not None:
        last = most_left <= most
        size = leaders.groupBy("gram").agg(F.count("*").alias("n"))
        again = leaders.join(size, "gram").withColumn("parts", F.lit(1) if last else F.ceil(F.col("n") / F.lit(float(most))).cast("int"))
        again = again.withColumn("part", F.pmod(F.xxhash64("item", F.lit(most_left)), F.col("parts")).cast("int")).withColumn("tiny", F.size("tail") < tiny)
        found = materialize(_trees(again, need, crowd, alike, trust, ratio, apart))
        pairs = pairs.union(found.where("role = 0").select(F.col("other").alias("a"), F.col("item").alias("b")))
        left = found.where("role = 1").select(*_COLUMNS)
        if last:
            break
        if left.count() >= leaders.count():
            if not trust:
                pairs = pairs.union(_between_parts(left, need, most, tiny, ratio, apart))
            break
        leaders = left
    return pairs.distinct()


def _planed(values: np.ndarray) -> bytes:
    """Integers as byte planes, of as many bytes as the largest needs (all eight for negative ones); that number comes first."""
    values = values.astype("<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.reshape(-1).view("<u8")


#: Above the place in the low four bits of an entry's flag: its set is tiny, its record has 1,000 letters, and then how many
#: 16ths shared grams must lie apart there.
_TINY, _LONG, _APART = 16, 32, 6


def _spread_marks(mark: np.ndarray, flag: np.ndarray, apart: int) -> np.ndarray:
    """As ``_spread``, of many marks and flags."""
    if not apart:
        return np.ones(len(mark), bool)
    high, low = (np.frexp(m.astype(np.float64))[1] for m in (mark, mark & -mark))
    runs = np.bitwise_count(mark & ~(mark << 1))
    return (high - low >= flag >> _APART) & ((flag & _LONG == 0) | (runs > 1) | (np.bitwise_count(mark) >= 6))


def _listed(sets: DataFrame, crowd: int, ratio: float, apart: int, entries: int) -> tuple[DataFrame, int]:
    """Packed, and the number of buckets: in role 2 the pairs (lesser, greater item, flag of the greater) of different kinds that
    fit in length, once for each gram they share in a list of up to ``crowd`` sets; in role 3 the items of longer lists.

    An entry is a few bytes and goes to its list alone, so a gram that two texts share by chance costs no more than others. The
    grams are cut to twelve bits more than their number needs: few unlike ones coincide, and no equal ones part.
    """
    total = int(sets.agg(F.sum(F.size("grams"))).first()[0] or 0)
    buckets = max(task_slots(sets.sparkSession), -(-total // (2 * entries)))
    bits = np.uint64(64 - min(60, max(40, total.bit_length() + 12)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            gram, item, kind, letters, flag = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(gram)
            gram, item, kind, letters, flag = gram[order], item[order], kind[order], letters[order], flag[order]
            cut = np.searchsorted(((gram >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
            gram, back = gram >> bits, item - kind
            rows = []
            for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                if x < y:
                    own = slice(x, y)
                    rows.append((b, gram[x].tobytes() + _planed(np.diff(gram[own])), _planed(item[own]), _squeezed(back[own], 8) if back[own].any() else b"", _planed(letters[own]), _planed(flag[own])))
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 5), strict=True)], names=["bucket", "gram", "item", "kind", "letters", "flag"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                item, kind, letters, tiny, lists = (batch.column(c).slice(at, 1000) for c in range(5))
                grams, n = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
                if len(grams):
                    letters = letters.to_numpy(zero_copy_only=False).astype(np.int64)
                    flag = _TINY * tiny.to_numpy(zero_copy_only=False) + _LONG * (letters >= 1000) + (np.minimum(apart, letters // 200) << _APART)
                    own = (np.repeat(c, n) for c in (item.to_numpy(zero_copy_only=False), kind.to_numpy(zero_copy_only=False), letters.astype(np.int32), flag))
                    item, kind, letters, flag = own
                    held.append((dna.mixed((grams >> 4).view(np.uint64)), item, kind, letters, (flag | grams & 15).astype(np.int16)))
                    size += len(grams)
                if size >= entries:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    def paired(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        for gram, item, kind, letters, flag in zip(*(table[c].to_pylist() for c in ("gram", "item", "kind", "letters", "flag")), strict=True):
            steps, own = _unplaned(gram[8:]), _unplaned(item).view(np.int64)
            first = np.frombuffer(gram, np.uint64, 1)
            back = _restored(kind, len(own)).view(np.int64) if kind else 0
            for c, v in zip(columns, (np.concatenate([first, first + np.cumsum(steps, dtype=np.uint64)]), own, own - back, _unplaned(letters).astype(np.int32), _unplaned(flag).astype(np.int32)), strict=True):
                c.append(v)
        gram, item, kind, letters, flag = map(np.concatenate, columns)
        order = np.argsort(gram, kind="stable")
        gram, item, kind, letters, flag = gram[order], item[order], kind[order], letters[order], flag[order]
        start = np.concatenate([[0], np.flatnonzero(gram[1:] != gram[:-1]) + 1])
        size = np.diff(np.append(start, len(gram)))
        mixed = np.minimum.reduceat(kind, start) != np.maximum.reduceat(kind, start)
        for s in np.unique(size[mixed & (size <= crowd)]).tolist():
            i, j = np.triu_indices(s, 1)
            own, step = start[mixed & (size == s)], max(1, (1 << 20) // len(i))
            for low in range(0, len(own), step):
                at = own[low : low + step, None]
                x, y = (at + i).reshape(-1), (at + j).reshape(-1)
                fits = np.minimum(letters[x], letters[y]) >= ratio * np.maximum(letters[x], letters[y])
                x, y = x[some := fits & (kind[x] != kind[y])], y[some]
                turned = item[x] > item[y]
                x, y = np.where(turned, y, x), np.where(turned, x, y)
                tiny = flag[x] & flag[y] & _TINY
                rows = [(b, 2, _planed(p), _planed(q), _planed(f)) for b, p, q, f in _split(_bucketed(item[x] * 31 + item[y], buckets), item[x], item[y], flag[y] & ~_TINY | tiny)]
                if rows:
                    yield _packed(rows)
        if len(many := np.flatnonzero(mixed & (size > crowd))):
            yield _packed([(0, 3, np.unique(np.concatenate([item[a : a + n] for a, n in zip(start[many], size[many], strict=True)])), b"", b"")])

    sent = spread(sets.select("item", "kind", "letters", "tiny", "grams")).mapInArrow(send, "bucket int, gram binary, item binary, kind binary, letters binary, flag binary")
    return materialize(_grouped(sent, buckets, _PACKED, paired)), buckets


def _often(listed: DataFrame, buckets: int, need: int, apart: int, most: int = 4_000_000) -> DataFrame:
    """Pairs (a, b) that are listed ``need`` times, in places far enough apart, or once if both are tiny."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = list(zip(*(table[c].to_pylist() for c in "xyz"), strict=True))
        passes = -(-sum((len(x) - 1) // x[0] for x, _, _ in rows) // most)
        for turn in range(passes):
            parts = []
            for x, y, z in rows:
                own = (_unplaned(x).view(np.int64), _unplaned(y).view(np.int64), _unplaned(z).astype(np.int64))
                some = _bucketed(own[0] * 37 + own[1], passes) == turn
                parts.append([c[some] for c in own])
            a, b, flag = (np.concatenate(c) for c in zip(*parts, strict=True))
            if not len(a):
                continue
            order = np.lexsort((b, a))
            a, b, flag = a[order], b[order], flag[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            n = np.diff(np.append(first, len(a)))
            mark = np.bitwise_or.reduceat(np.left_shift(1, flag & 15), first)
            kept = (n >= need) & _spread_marks(mark, flag[first], apart) | (np.bitwise_or.reduceat(flag, first) & _TINY > 0)
            if kept.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[first][kept]), pa.array(b[first][kept])], names=["a", "b"])

    return _grouped(listed.where("role = 2"), buckets, "a bigint, b bigint", run)


def _crowded_pairs(sets: DataFrame, need: int, ratio: float, apart: int, owners: int = 2048, dense: int = 4096) -> DataFrame:
    """Pairs (a, b) of different kinds among a few long lists' sets with ``need`` shared members, or one if both are tiny.

    Every two ranges of items meet in a task. Grams that many of both hold are counted by matrix products, one for each place
    in the greater item's record, the others pair by pair; so a list of n sets costs n * n / 2 products and never so many rows.
    """
    grams = sets.select("item", "kind", "letters", "tiny", F.explode("grams").alias("g")).withColumn("gram", F.shiftright("g", 4))
    kept = grams.join(materialize(shared_grams(sets)), "gram").groupBy("item", "kind", "letters", "tiny").agg(F.collect_set("g").alias("grams"))
    kept = materialize(kept)
    groups = max(-(-kept.count() // owners), math.isqrt(2 * task_slots(sets.sparkSession)) + 1)
    placed = _in_ranges(kept, "item", groups).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    placed = placed.withColumn("bucket", (F.least("__b", "with") * groups + F.greatest("__b", "with")).cast("int")).drop("with")

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        low, high = divmod(int(table["bucket"][0].as_py()), groups)
        table = table.take(pa.array(np.argsort(table["item"].to_numpy())))
        item, kind, letters = (table[c].to_numpy() for c in ("item", "kind", "letters"))
        tiny = table["tiny"].to_numpy()
        values, offsets = _flat(table, "grams")
        row = np.repeat(np.arange(len(item)), np.diff(offsets))
        side = table["__b"].to_numpy()
        left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
        if not len(left) or not len(right):
            return
        of = [(values[some] >> 4, row[some] - rows[0], values[some] & 15) for rows in (left, right) if (some := np.isin(row, rows)) is not None]
        names = np.intersect1d(of[0][0], of[1][0])
        (gx, x, _), (gy, y, place) = ([c[has] for c in own] for own in of if (has := np.isin(own[0], names)) is not None)
        gx, gy = np.searchsorted(names, gx), np.searchsorted(names, gy)
        ox, oy = np.argsort(gx, kind="stable"), np.argsort(gy, kind="stable")
        gx, x, gy, y, place = gx[ox], x[ox], gy[oy], y[oy], place[oy]
        nx, ny = np.bincount(gx, minlength=len(names)), np.bincount(gy, minlength=len(names))
        count, mark = np.zeros((len(left), len(right)), np.int32), np.zeros((len(left), len(right)), np.int32)
        many = np.flatnonzero(nx * ny > dense)
        for at in range(0, len(many), 1024):
            some = many[at : at + 1024]
            ex, ey = np.isin(gx, some), np.isin(gy, some)
            a = np.zeros((len(left), len(some)), np.float32)
            a[x[ex], np.searchsorted(some, gx[ex])] = 1
            for p in np.unique(place[ey]).tolist():
                own = ey & (place == p)
                b = np.zeros((len(right), len(some)), np.float32)
                b[y[own], np.searchsorted(some, gy[own])] = 1
                met = (a @ b.T).astype(np.int32)
                count += met
                mark |= (met > 0).astype(np.int32) << p
        begin = np.cumsum(nx) - nx
        few = np.flatnonzero((nx * ny <= dense)[gy])
        n = nx[gy[few]]
        for at in np.split(few, np.flatnonzero(np.diff(np.cumsum(n) // (1 << 22))) + 1):
            n = nx[gy[at]]
            i = x[np.repeat(begin[gy[at]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            j = np.repeat(y[at], n)
            np.add.at(count, (i, j), 1)
            np.bitwise_or.at(mark, (i, j), np.repeat(np.left_shift(1, place[at]), n).astype(np.int32))
        i, j = np.nonzero(np.triu(count, 1) if low == high else count)
        n, mark, i, j = count[i, j], mark[i, j], left[i], right[j]
        flag = _LONG * (letters[j] >= 1000) + (np.minimum(apart, letters[j] // 200) << _APART)
        fits = (kind[i] != kind[j]) & (np.minimum(letters[i], letters[j]) >= ratio * np.maximum(letters[i], letters[j]))
        kept = fits & ((n >= need) & _spread_marks(mark, flag, apart) | tiny[i] & tiny[j])
        yield pa.RecordBatch.from_arrays([pa.array(item[i[kept]]), pa.array(item[j[kept]])], names=["a", "b"])

    return _grouped(placed, groups * groups, "a bigint, b bigint", run)


def few_sent(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A stored table of two or so numbers a row, marked to be sent to all tasks if it has up to ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def candidate_pairs(sets: DataFrame, need: int = 2, crowd: int = 128, alike: float = 0.5, most: int = 4096, tiny: int = 3, trust: bool = False, ratio: float = 0.0, apart: int = 0, entries: int = 1_000_000) -> DataFrame:
    """Pairs (a, b), a < b, of items of different kinds whose gram sets (item, kind, letters, grams) share at least ``need``
    members, or one if both have no more than ``tiny`` (such as stretches of one repeat). A column tiny may tell the latter.

    The low four bits of a gram say in which 16th of its record it is and take no part in comparing; shared grams must lie
    at least ``apart`` 16ths from each other. The lesser number of letters must be at least ``ratio`` of the greater.

    Pairs are counted over the lists of grams with up to ``crowd`` sets, so what unlike texts share by chance, which grows with
    the collection, is never sent with its sets. The sets of longer lists are compared whole among themselves: in prefix trees,
    where sets may stand for others, or if none may (``alike`` over 1, without ``trust``) range by range.
    """
    if "tiny" not in sets.columns:
        small = sets.where(F.size("grams") <= tiny).select("item", F.lit(True).alias("tiny")).distinct()
        sets = sets.join(small, "item", "left").withColumn("tiny", F.coalesce("tiny", F.lit(False)))
    listed, buckets = _listed(sets, crowd, ratio, apart, entries)
    pairs = _often(listed, buckets, need, apart)

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, *_ in _arrays(batch, 3, np.int64, np.uint8, np.uint8):
                yield pa.RecordBatch.from_arrays([pa.array(own)], names=["item"])

    many = materialize(listed.where("role = 3").mapInArrow(items, "item bigint").distinct())
    if many.limit(1).count():
        own = materialize(sets.select("item", "kind", "letters", "tiny", "grams").join(few_sent(many), "item", "left_semi"))
        if trust or alike <= 1:
            pairs = pairs.union(_tree_pairs(own, need, crowd, alike, most, tiny, trust, ratio, apart))
        else:
            pairs = pairs.union(_crowded_pairs(own, need, ratio, apart))
    return pairs.distinct()


def as_bits(df: DataFrame, id_col: str, seq_col: str, table: np.ndarray = dna.LETTERS) -> DataFrame:
    """(id, bits): every row's letters at two bits a base; ``table`` gives the code of each character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, codes, starts, lengths in dna.encoded(batch.column(1), table):
                bits = [dna.to_bits(codes[a : a + n]) for a, n in zip(starts, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(bits, pa.binary())], names=["id", "bits"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(seq_col).alias("seq")).where("id is not null and seq is not null")
    return spread(rows).mapInArrow(run, "id bigint, bits binary")


def match_pairs(pairs: DataFrame, bits: DataFrame, max_edit: float = 0.2) -> DataFrame:
    """(a, b, letters_a, letters_b, matched_a, matched_b, part_b) for pairs of ids: the exact check behind candidates.

    part_b: matched bases of b within the best part of b that is about as long as a.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, dna.Indexed] = OrderedDict()
        held = 0

        def get(i: int, data) -> dna.Indexed:
            nonlocal held
            if i in known:
                known.move_to_end(i)
                return known[i]
            x = known[i] = dna.Indexed(dna.from_bits(data.as_py()))
            held += len(x.codes)
            while held > 1_000_000 and len(known) > 2:
                held -= len(known.popitem(last=False)[1].codes)
            return x

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = np.zeros((5, len(a)), np.int32)
            for i in range(len(a)):
                x, y = get(a[i], batch.column(2)[i]), get(b[i], batch.column(3)[i])
                out[:, i] = (x.letters, y.letters, *dna.matched(x, y, max_edit))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out)], names=["a", "b", "letters_a", "letters_b", "matched_a", "matched_b", "part_b"])

    left = bits.select(F.col("id").alias("a"), F.col("bits").alias("bits_a"))
    right = bits.select(F.col("id").alias("b"), F.col("bits").alias("bits_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "bits_a", "bits_b")
    return both.mapInArrow(run, "a bigint, b bigint, letters_a int, letters_b int, matched_a int, matched_b int, part_b int")


def near_duplicates(df: DataFrame, id_col: str, seq_col: str, max_edit: float = 0.2, min_letters: int = 60, k: int = 16, size: int = 256, need: int = 2, first: int = 48, apart: int = 2, count_links: bool = True) -> DataFrame:
    """(id, class_id, n_links): the class of near-duplicates of every row that takes part.

    Two rows are linked if at most ``max_edit`` of the longer one's bases are left without an equal partner, on either
    strand and wherever blocks lie; letter case and gap characters do not matter. class_id is the smallest id of the
    class; n_links counts the rows linked directly, exact copies included. ``id_col`` holds unique integers.

    Null ids, null or empty sequences and rows with under ``min_letters`` letters out of A, C, G, T take no part and
    have no row in the result. Exact copies are handled once. Other columns are not read, so their names cannot clash.
    An empty table gives an empty result. The check aligns bases (``dna.matched``); a tenth of ``max_edit`` is allowed for
    what it misjudges.

    Two looks: the ``first`` smallest hashes of a set find the easy pairs, whose classes are the kinds of the second look
    over all ``size`` hashes. That one compares all sets of different kinds that share a gram, so it also makes good what
    the first look loses. Shared grams must lie at least ``apart`` 16ths of a record from each other, as those of two records
    that share one stretch only do not. No set stands for another there, however crowded a list is. Neither look compares all
    within a class, so ``n_links`` takes a check of every two contents of a class; without ``count_links`` it is null.
    """
    base = materialize(sketched(df, id_col, seq_col, k, size, min_letters, max_edit=max_edit))
    contents = materialize(base.groupBy("content").agg(F.min("id").alias("item"), F.count("*").alias("copies")))
    # copies are fewer than contents, and mostly few enough to be sent to where the sets are
    copied = materialize(base.join(contents.where("copies > 1"), "content").where("id > item").select("id"))
    own = base.join(few_sent(copied), "id", "left_anti")
    tiny = F.exists(F.array("grams", "spaced"), lambda g: (F.size(g) > 0) & (F.size(g) <= 3)).alias("tiny")
    sets = own.select(F.col("id").alias("item"), "letters", tiny, F.explode(F.array("grams", "spaced")).alias("grams")).where(F.size("grams") > 0)
    ratio = 1 - 1.1 * max_edit
    bits = as_bits(df, id_col, seq_col)

    def held(pairs: DataFrame) -> DataFrame:
        checked = match_pairs(pairs, bits, max_edit)
        edits = F.greatest(F.col("letters_a") - F.col("matched_a"), F.col("letters_b") - F.col("matched_b"))
        return materialize(checked.where(edits <= 1.1 * max_edit * F.greatest("letters_a", "letters_b")).select("a", "b"))

    easy = held(candidate_pairs(sets.select("item", F.col("item").alias("kind"), "letters", "tiny", F.slice("grams", 1, first).alias("grams")), need, trust=True, ratio=ratio, apart=apart))
    kinds = connected_components(easy).withColumnRenamed("node", "item")
    known = sets.join(few_sent(kinds), "item", "left").select("item", F.coalesce("class_id", "item").alias("kind"), "letters", "tiny", "grams")
    hard = held(candidate_pairs(known, need, alike=math.inf, ratio=ratio, apart=apart))
    links = easy.union(hard)
    # the second look joins kinds, so only these and not all links need another round of labels
    kind = known.select("item", "kind").distinct()
    joined = hard.join(kind.select(F.col("item").alias("a"), F.col("kind").alias("x")), "a").join(kind.select(F.col("item").alias("b"), F.col("kind").alias("y")), "b")
    merged = connected_components(joined.select(F.col("x").alias("a"), F.col("y").alias("b")))
    classes = kind.join(merged.select(F.col("node").alias("kind"), "class_id"), "kind", "left").select(F.col("item").alias("node"), F.coalesce("class_id", "kind").alias("class_id"))
    if not count_links:
        of = contents.select("content", "item").join(classes.withColumnRenamed("node", "item"), "item", "left")
        of = of.select("content", F.coalesce("class_id", "item").alias("class_id"), F.lit(None).cast("bigint").alias("n_links"))
        return salted_join(base.select("id", "content"), of, ["content"]).select("id", "class_id", "n_links")
    classes = materialize(classes)
    inside = class_pairs(classes.withColumnRenamed("node", "id")).withColumnsRenamed({"record_id_a": "a", "record_id_b": "b"})
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = links.union(held(inside.join(links, ["a", "b"], "left_anti")))
    copies = contents.select(F.col("item").alias("b"), "copies")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(copies, "b").groupBy(F.col("a").alias("item")).agg(F.sum("copies").alias("n"))
    of = contents.select("content", "item", "copies").join(classes.withColumnRenamed("node", "item"), "item", "left").join(degree, "item", "left")
    of = of.select("content", F.coalesce("class_id", "item").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return salted_join(base.select("id", "content"), of, ["content"]).select("id", "class_id", "n_links")


def class_pairs(classes: DataFrame) -> DataFrame:
    """(record_id_a, record_id_b), a < b: every two rows of one class."""
    size = classes.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1")
    own = classes.join(size, "class_id", "left_semi").select("class_id", "id")
    a, b = own.withColumnRenamed("id", "record_id_a"), own.withColumnRenamed("id", "record_id_b")
    return a.join(b, "class_id").where("record_id_a < record_id_b").select("record_id_a", "record_id_b")
