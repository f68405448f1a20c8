"""Containment, novelty and distances of texts and vectors.

``full_links`` and ``full_search`` use every k-mer and lose no pair: all k-mers meet in hash parts as compressed blocks.
For links, what pairs share is then counted; for the search, what can hold is verified on the texts.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import sequence
from strandloom.operators.graph import connected_components
from strandloom.runtime import by_bucket, materialize, rank_by_value, spread, task_slots


def novelty_tier(containment: Column, fail: float = 0.95, warn: float = 0.8) -> Column:
    """FAIL from ``fail`` on, WARN from ``warn`` on, else PASS; null stays null."""
    return F.when(containment >= fail, "FAIL").when(containment >= warn, "WARN").when(containment.isNotNull(), "PASS")


#: Each letter's partner, for texts of one byte a letter.
_PARTNER = bytes.maketrans(b"ATCG", b"TAGC")


@functools.cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _windows(codes: np.ndarray, k: int, base: int, backward: bool, step: int = 1 << 13) -> np.ndarray:
    """The polynomial of every ``k`` codes, the first with the greatest power or, ``backward``, the least; of an odd base.

    Windows are differences of running sums, from which the power of their place is taken by its inverse, so it takes the same
    steps for any ``k``. Sums begin anew after ``step`` windows.
    """
    out = np.empty(len(codes) - k + 1, np.uint64)
    up, down = _powers(base, step + k), _powers(pow(base, -1, 2**64), step + k)
    for low in range(0, len(out), step):
        own = codes[low : low + step + k - 1]
        n = len(own) - k + 1
        sums = own * (up if backward else down)[: len(own)]
        np.cumsum(sums, out=sums)
        part = out[low : low + n]
        part[0] = sums[k - 1]
        np.subtract(sums[k:], sums[: n - 1], out=part[1:])
        part *= down[:n] if backward else up[k - 1 : k - 1 + n]
    return out


def _all_hashes(text: str, k: int, canonical: bool = True) -> np.ndarray:
    """The 64-bit hashes of a text's k-mers as they follow; if ``canonical`` a k-mer and its reverse complement have one."""
    n = len(text) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if text.isascii():
        raw = text.encode("ascii")
        codes = np.frombuffer(raw, np.uint8).astype(np.uint64)
        turned = np.frombuffer(raw.translate(_PARTNER), np.uint8).astype(np.uint64) if canonical else None
    else:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        turned = np.where(codes < 256, np.frombuffer(_PARTNER, np.uint8)[np.minimum(codes, 255).astype(np.int64)], codes)
    base = 0x9E3779B97F4A7C15
    h = _windows(codes, k, base, False)
    if canonical:
        h = np.minimum(h, _windows(turned, k, base, True))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def _kmer_hashes(text: str, k: int, canonical: bool = True) -> np.ndarray:
    """The distinct hashes of ``_all_hashes``, ascending."""
    h = _all_hashes(text, k, canonical)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _squeezed(values: np.ndarray, width: int) -> bytes:
    """Small unsigned integers by byte planes, each Huffman-coded."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width])
    packer = zlib.compressobj(1, zlib.DEFLATED, 15, 8, zlib.Z_HUFFMAN_ONLY)
    return packer.compress(planes.tobytes()) + packer.flush()


def _restored(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.reshape(-1).view("<u8")


def _width(values: np.ndarray) -> int:
    return max(1, (int(values.max()).bit_length() + 7) // 8)


def _cut_bits(letters: int) -> int:
    return min(60, max(20, letters.bit_length() + 7))


def _kmer_parts(texts: DataFrame, k: int, canonical: bool = True, block: int = 1 << 22, held: int = 3_000_000) -> DataFrame:
    """(part, n, first, grams, owners, items): all k-mers of (item, packed, length) in blocks by hash part, as sorted differences.

    Hashes are cut to seven bits more than the k-mers need, so that few unlike ones coincide: what shares a k-mer always
    meets, what meets need not share one.
    """
    letters = texts.agg(F.sum("length")).first()[0] or 0
    bits = _cut_bits(int(letters))
    parts = max(task_slots(texts.sparkSession), -(-int(letters) // held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[np.ndarray] = []
        items: list[int] = []
        size = 0

        def blocks() -> pa.RecordBatch:
            # the owner takes the place of bits that are cut off, so that values are sorted rather than indices
            low = np.uint64(64 - max(32, bits))
            if len(grams) >> int(low):
                h = np.concatenate(grams)
                owner = np.repeat(np.arange(len(grams), dtype=np.uint64), [len(g) for g in grams])
                order = np.argsort(h, kind="stable")
                h, owner = h[order], owner[order]
            else:
                h = np.concatenate([g >> low << low | np.uint64(i) for i, g in enumerate(grams)])
                h.sort()
                owner = h & ((np.uint64(1) << low) - np.uint64(1))
            # the first value of each part: value * parts // 2**32 of the upper half
            edges = [-(-(p << 32) // parts) << 32 for p in range(parts)]
            cut = np.append(np.searchsorted(h, np.array(edges, np.uint64)), len(h))
            h = h >> np.uint64(64 - bits)
            rows: list[tuple] = []
            for p in range(parts):
                low, high = int(cut[p]), int(cut[p + 1])
                if low < high:
                    own = owner[low:high].astype(np.int64)
                    here = np.zeros(len(items), np.int64)
                    here[own] = 1
                    used, local = np.flatnonzero(here), (np.cumsum(here) - 1)[own]
                    steps = np.diff(h[low:high])
                    first = int(h[low])
                    rows.append((p, high - low, first, _squeezed(steps, _width(steps)) if len(steps) else b"", _squeezed(local, _width(local)), np.array(items, np.int64)[used]))
            names = ["part", "n", "first", "grams", "owners", "items"]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = _kmer_hashes(_unpacked(text), k, canonical)
                if len(own):
                    grams.append(own)
                    items.append(item)
                    size += len(own)
                if size >= block:
                    yield blocks()
                    grams, items, size = [], [], 0
        if size:
            yield blocks()

    return spread(texts.select("item", "packed")).mapInArrow(run, "part int, n int, first bigint, grams binary, owners binary, items array<bigint>")


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(hash, item) of a part's entries, ascending by hash."""
    rows = list(zip(*(table[c].to_pylist() for c in ("n", "first", "grams", "owners", "items")), strict=True))
    names = np.unique(np.concatenate([np.array(items, np.int64) for *_, items in rows]))
    h, owner = [], []
    for n, first, grams, owners, items in rows:
        steps = _restored(grams, n - 1) if n > 1 else np.zeros(0, np.uint64)
        h.append(np.concatenate([[np.uint64(first)], np.uint64(first) + np.cumsum(steps, dtype=np.uint64)]))
        owner.append(np.searchsorted(names, np.array(items, np.int64)).astype(np.uint64)[_restored(owners, n).astype(np.int64)])
    h, owner = np.concatenate(h), np.concatenate(owner)
    low = np.uint64(len(names).bit_length())
    if int(h.max()).bit_length() + int(low) <= 64:
        # one sort of values is much faster than one of indices
        h = h << low | owner
        h.sort()
        return h >> low, names[(h & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)]
    order = np.argsort(h, kind="stable")
    return h[order], names[owner[order].astype(np.int64)]


def _met(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, owners, starts, sizes) of a part: owners of the entries whose gram has two or more, by gram."""
    h, owner = _entries(table)
    names, owner = np.unique(owner, return_inverse=True)
    start = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1])
    size = np.diff(np.append(start, len(h)))
    many = np.repeat(size > 1, size)
    owner, size = owner[many], size[size > 1]
    return names, owner, np.cumsum(size) - size, size


def _expanded(probes: np.ndarray, owner: np.ndarray, start: np.ndarray, size: np.ndarray, gram: np.ndarray, width: int, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys (prober * width + other) of probing entries with all entries of their grams, and how often each is met."""
    n = size[gram[probes]]
    total = np.cumsum(n)
    low = 0
    while low < len(probes):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + most, "right")))
        some, m = probes[low:high], n[low:high]
        at = np.repeat(start[gram[some]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        a, b = np.repeat(owner[some], m), owner[at]
        yield np.unique((a * width + b)[a != b], return_counts=True)
        low = high


def _texts(df: DataFrame, row: str, text: str, upper: bool = True) -> DataFrame:
    """(item, packed, second, d, length): one row per distinct text, Huffman-coded, its least and second least row."""
    digest = F.md5(F.encode(F.col(text), "utf-8"))
    once = df.where(F.col(text).isNotNull()).select(F.col(row).cast("bigint").alias("r"), digest.alias("d"))
    two = once.groupBy("d").agg(F.min("r").alias("item"), F.max("r").alias("last"), F.count("*").alias("copies"))
    second = once.join(two.where("copies > 1"), "d").where("r > item").groupBy("item").agg(F.min("r").alias("second"))
    own = df.select(F.col(row).cast("bigint").alias("item"), (F.upper(text) if upper else F.col(text)).alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for x in batch.column(1):
                packer = zlib.compressobj(1, zlib.DEFLATED, 15, 8, zlib.Z_HUFFMAN_ONLY)
                packed.append(packer.compress(x.as_py().encode("utf-8")) + packer.flush())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], names=["item", "packed", "length"])

    packed = spread(own).select("item", "text", F.length("text").alias("length")).mapInArrow(run, "item bigint, packed binary, length int")
    return materialize(packed.join(two.select("item", "d"), "item").join(second, "item", "left"))


def _distinct_texts(df: DataFrame, row: str, text: str) -> DataFrame:
    """(item, packed, length) of ``_texts`` alone, for which the table is read once."""
    digest = F.unhex(F.md5(F.encode(F.col(text), "utf-8")))
    own = df.where(F.col(text).isNotNull()).select(F.col(row).cast("bigint").alias("item"), digest.alias("d"), F.upper(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, length = [], []
            for x in batch.column(2).to_pylist():
                packer = zlib.compressobj(1, zlib.DEFLATED, 15, 8, zlib.Z_HUFFMAN_ONLY)
                packed.append(packer.compress(x.encode("utf-8")) + packer.flush())
                length.append(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), pa.array(length, pa.int32())], names=["item", "d", "packed", "length"])

    rows = materialize(spread(own).mapInArrow(run, "item bigint, d binary, packed binary, length int"))
    least = rows.groupBy("d").agg(F.min("item").alias("item")).select("item")
    return materialize(rows.select("item", "packed", "length").join(least, "item"))


def _unpacked(value) -> str:
    return zlib.decompress(value.as_py()).decode("utf-8")


def _shared_kmers(pairs: DataFrame, texts: DataFrame, k: int, canonical: bool = True) -> DataFrame:
    """(a, b, shared, n_a, n_b): k-mers of both texts, and of each, over the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()
        held = 0

        def get(i: int, value) -> np.ndarray:
            nonlocal held
            if i in known:
                known.move_to_end(i)
                return known[i]
            x = known[i] = _kmer_hashes(_unpacked(value), k, canonical)
            held += len(x)
            while held > 4_000_000 and len(known) > 2:
                held -= len(known.popitem(last=False)[1])
            return x

        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                x, y = get(a, batch.column(2)[i]), get(b, batch.column(3)[i])
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                found = at < len(large)
                found[found] = large[at[found]] == small[found]
                out[:, i] = found.sum(), len(x), len(y)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out)], names=["a", "b", "shared", "n_a", "n_b"])

    slots = task_slots(pairs.sparkSession)
    left, right = texts.select(F.col("item").alias("a"), F.col("packed").alias("ta")), texts.select(F.col("item").alias("b"), F.col("packed").alias("tb"))
    # few bytes but much work a row: a fixed number of parts, as they are otherwise merged by size
    both = pairs.select("a", "b").join(right, "b").repartition(slots, "a").join(left.repartition(slots, "a").hint("merge"), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a bigint, b bigint, shared bigint, n_a bigint, n_b bigint")


def _grouped(df: DataFrame, buckets: int, schema: str, fn: Callable[[pa.Table], Iterable[pa.RecordBatch]]) -> DataFrame:
    """Runs ``fn`` on the whole rows of each bucket, a task each; they are few and packed, so their bytes say little of the work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            table = pa.Table.from_batches(held)
            bucket = table["bucket"].to_numpy()
            for own in np.unique(bucket):
                yield from fn(table.filter(pa.array(bucket == own)))

    return by_bucket(df, buckets).mapInArrow(run, schema)


_PACKED = "bucket int, role int, x binary, y binary, z binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (bucket, role, x, y, z) with arrays or bytes in the last three."""
    columns = list(zip(*rows, strict=True)) or [()] * 5
    raw = [[v if isinstance(v, bytes) else np.ascontiguousarray(v).tobytes() for v in c] for c in columns[2:]]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.binary()) for c in raw)], names=["bucket", "role", "x", "y", "z"])


def _arrays(table: pa.Table | pa.RecordBatch, role: int, *types: type) -> list[tuple[np.ndarray, ...]]:
    """The arrays of the rows of one role."""
    own = table.filter(pa.array(table["role"].to_numpy() == role))
    return [tuple(np.frombuffer(v, t) for v, t in zip(row, types, strict=True)) for row in zip(*(own[c].to_pylist() for c in "xyz"), strict=True)]


def _bucketed(values: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of integers by hash."""
    h = values.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return ((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _split(key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(value, *columns) for each value of ``key``, the order within a value kept."""
    order = np.argsort(key, kind="stable")
    at = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1, [len(key)]]) if len(key) else [0]
    for low, high in zip(at[:-1], at[1:], strict=True):
        yield int(key[order[low]]), *(c[order[low:high]] for c in columns)


_CUT = "bucket int, block int, first bigint, steps binary, far binary"


def _short_steps(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Ascending values as the first, the lower 16 bits of the steps between them, and places and the rest of the longer steps;
    the values span less than 2**32."""
    steps = np.diff(values)
    far = np.flatnonzero(steps >> np.uint64(16))
    return int(values[0]), steps.astype(np.uint16).tobytes(), far.astype(np.uint32).tobytes() + (steps[far] >> np.uint64(16)).astype(np.uint16).tobytes()


def _of_steps(first: int, steps: bytes, far: bytes) -> np.ndarray:
    out = np.empty(len(steps) // 2 + 1, np.uint64)
    out[0], out[1:] = first, np.frombuffer(steps, np.uint16)
    n = len(far) // 6
    at, rest = np.frombuffer(far, np.uint32, n), np.frombuffer(far, np.uint16, n, 4 * n)
    out[at.astype(np.int64) + 1] += rest.astype(np.uint64) << np.uint64(16)
    return np.cumsum(out, out=out)


def _met_kmers(texts: DataFrame, k: int, entries: int = 3_000_000) -> tuple[DataFrame, int]:
    """Packed, and the number of parts: in role 0 items and their numbers of k-mers; in role 1, by part of the hashes, items, the
    uncut hashes of the k-mers that another text may share, and whose they are as places in the items.

    A first pass, on hashes cut to seven bits more than the k-mers need, only says which values come twice. Blocks of texts send
    their sorted values without owners, no value more than twice, and get back those that came from anywhere else or twice from
    here; so what texts share always meets, and what meets need not be shared.
    """
    letters = int(texts.agg(F.sum("length")).first()[0] or 0)
    bits = _cut_bits(letters)
    cut, parts = np.uint64(64 - bits), max(task_slots(texts.sparkSession), -(-letters // entries))
    edges = np.array([-(-(p << bits) // parts) for p in range(parts)], np.uint64)
    # the larger a block, the shorter the steps between its values
    many = max(task_slots(texts.sparkSession), -(-letters // (2 * entries)))
    blocks = texts.select(F.pmod(F.xxhash64("item"), F.lit(many)).cast("int").alias("bucket"), "item", "packed")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def sent(block: int) -> pa.RecordBatch:
            h = np.concatenate(held)
            h.sort()
            h = h[np.concatenate([[True] * min(2, len(h)), h[2:] != h[:-2]])]
            at = np.append(np.searchsorted(h, edges), len(h)).tolist()
            rows = [(p, block, *_short_steps(h[low:high])) for p, (low, high) in enumerate(zip(at[:-1], at[1:], strict=True)) if low < high]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "block", "first", "steps", "far"])

        last, size = -1, 0
        for batch in batches:
            for block, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                # what is left of a block may go on its own
                if held and (block != last or size > 4 * entries):
                    yield sent(last)
                    held, size = [], 0
                h = _all_hashes(_unpacked(text), k)
                h >>= cut
                last, size = block, size + len(h)
                if len(h):
                    held.append(h)
        if held:
            yield sent(last)

    def meet(table: pa.Table) -> Iterator[pa.RecordBatch]:
        part = int(table["bucket"][0].as_py())
        block = table["block"].to_pylist()
        own = [_of_steps(*row) - edges[part] for row in zip(*(table[c].to_pylist() for c in ("first", "steps", "far")), strict=True)]
        key = np.concatenate(own)
        key <<= np.uint64(32)
        key |= np.arange(len(key), dtype=np.uint64)
        key.sort()
        value = key >> np.uint64(32)
        same = value[1:] == value[:-1]
        twice = np.zeros(len(key), bool)
        twice[(key[np.concatenate([[False], same]) | np.concatenate([same, [False]])] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
        rows, at = [], 0
        for b, values in zip(block, own, strict=True):
            found = values[twice[at : at + len(values)]].astype(np.uint32)
            at += len(values)
            if len(found):
                rows.append((b, 1, part, found.tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int32(), pa.int64(), pa.binary()], strict=True)], names=["bucket", "role", "item", "packed"])

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        role = table["role"].to_numpy()
        back, texts_of = table.filter(pa.array(role == 1)), table.filter(pa.array(role == 0))
        met = [np.frombuffer(v, np.uint32).astype(np.uint64) + edges[p] for p, v in zip(back["item"].to_pylist(), back["packed"].to_pylist(), strict=True)]
        met = np.concatenate([np.zeros(0, np.uint64), *met])
        met.sort()
        # most k-mers are told by a table of the values' upper bits
        upper = min(bits, 24)
        some, down = np.zeros(1 << upper, bool), np.uint64(64 - upper)
        some[(met >> np.uint64(bits - upper)).astype(np.int64)] = True
        items, sizes, likely = texts_of["item"].to_numpy(), [], []
        for text in texts_of["packed"]:
            h = _kmer_hashes(_unpacked(text), k)
            sizes.append(len(h))
            likely.append(h[some.take((h >> down).view(np.int64))])
        if not len(items):
            return
        yield _packed([(0, 0, items, np.array(sizes, np.int64), b"")])
        own, h = np.repeat(np.arange(len(items)), [len(x) for x in likely]), np.concatenate(likely)
        if len(met) and len(h):
            value = h >> cut
            kept = met[np.minimum(np.searchsorted(met, value), len(met) - 1)] == value
            own, h = own[kept], h[kept]
            rows = []
            for p, i, g in _split(((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts < 1 << 16 else np.int64), own, h):
                here = np.zeros(len(items), np.int64)
                here[i] = 1
                rows.append((p, 1, items[here > 0], g, (np.cumsum(here) - 1)[i].astype(np.uint32)))
            yield _packed(rows)

    cuts = by_bucket(blocks, many).mapInArrow(send, _CUT)
    met = _grouped(cuts, parts, "bucket int, role int, item bigint, packed binary", meet)
    both = met.unionByName(blocks.select("bucket", F.lit(0).alias("role"), "item", "packed"))
    return materialize(_grouped(both, many, _PACKED, whole)), parts


def _cold_pairs(owner: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, block: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Keys (lesser * width + greater) of the pairs of owners of each gram, and how often each comes; owners ascend within a gram."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    held: list[np.ndarray] = []

    def add() -> None:
        u, n = np.unique(np.concatenate(held), return_counts=True)
        keys.append(u)
        counts.append(n)
        held.clear()

    for s in np.unique(size).tolist():
        i, j = np.triu_indices(s, 1)
        own, step = start[size == s], max(1, block // len(i))
        for low in range(0, len(own), step):
            m = owner[own[low : low + step, None] + np.arange(s)]
            held.append((m[:, i] * width + m[:, j]).reshape(-1))
            if sum(map(len, held)) >= block:
                add()
    if held:
        add()
    return _summed(np.concatenate(keys), np.concatenate(counts))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _dense(gram_x: np.ndarray, x: np.ndarray, gram_y: np.ndarray, y: np.ndarray, shape: tuple[int, int], step: int = 1024) -> np.ndarray:
    """How many grams each x shares with each y, as a matrix; entries (gram, x) and (gram, y)."""
    out = np.zeros(shape, np.float32)
    grams = np.intersect1d(gram_x, gram_y)
    if not len(grams):
        return out
    px, py = np.isin(gram_x, grams), np.isin(gram_y, grams)
    gx, x, gy, y = np.searchsorted(grams, gram_x[px]), x[px], np.searchsorted(grams, gram_y[py]), y[py]
    # grams with the same first owner, such as those of one family of texts, go together
    least = np.full(len(grams), shape[0], np.int64)
    np.minimum.at(least, gx, x)
    place = np.empty(len(grams), np.int64)
    place[np.argsort(least, kind="stable")] = np.arange(len(grams))
    gx, gy = place[gx], place[gy]
    ox, oy = np.argsort(gx, kind="stable"), np.argsort(gy, kind="stable")
    gx, x, gy, y = gx[ox], x[ox], gy[oy], y[oy]
    for low in range(0, len(grams), step):
        a, b = (slice(*np.searchsorted(g, [low, low + step])) for g in (gx, gy))
        ux, ix = np.unique(x[a], return_inverse=True)
        uy, iy = np.unique(y[b], return_inverse=True)
        left, right = np.zeros((len(ux), step), np.float32), np.zeros((len(uy), step), np.float32)
        left[ix, gx[a] - low], right[iy, gy[b] - low] = 1, 1
        out[np.ix_(ux, uy)] += left @ right.T
    return out


def _counted(texts: DataFrame, k: int, schema: str, fn: Callable[..., pa.RecordBatch], hot: int = 64, entries: int = 3_000_000, owners: int = 2048, pairs: int = 2_000_000) -> DataFrame:
    """``fn`` (a, b, shared, n_a, n_b) over all pairs of texts a < b that share a canonical k-mer: how many they share and have.

    Nothing is verified pair by pair. K-mers of up to ``hot`` texts are expanded to pairs within hash parts. Those of more,
    such as of a block that many texts share, have few entries but very many pairs: they are counted by matrix products of two
    groups of texts each, where also the sums of the parts end, so that no list of all pairs is ever written.
    """
    spark = texts.sparkSession
    met, fine = _met_kmers(texts, k, entries)
    total = met.where("role = 1").agg(F.sum(F.length("y"))).first()[0] or 0
    parts = min(fine, max(task_slots(spark), -(-int(total) // (8 * entries))))

    def paired(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket = int(table["bucket"][0].as_py())
        rows = _arrays(table, 1, np.int64, np.uint64, np.uint32)
        names, gram = np.sort(np.concatenate([r[0] for r in rows])), np.concatenate([r[1] for r in rows])
        names = names[np.concatenate([[True], names[1:] != names[:-1]])]
        owner = np.concatenate([np.searchsorted(names, items)[at] for items, _, at in rows])
        order = np.argsort(gram)
        owner, gram = owner[order], gram[order]
        start = np.concatenate([[0], np.flatnonzero(gram[1:] != gram[:-1]) + 1])
        size = np.diff(np.append(start, len(gram)))
        # owners ascend within a gram
        owner += np.repeat(np.arange(len(size)), size) << 32
        owner.sort()
        owner &= 0xFFFFFFFF
        cold = (size > 1) & (size <= hot)
        keys, counts = _cold_pairs(owner, start[cold], size[cold], len(names))
        for low in range(0, len(keys), 1_000_000):
            u = keys[low : low + 1_000_000]
            yield _packed([(0, 2, names[u // len(names)], names[u % len(names)], counts[low : low + len(u)].astype(np.int32))])
        if (size > hot).any():
            number = np.repeat((bucket << 32) + np.arange(len(size)), size)
            some = np.repeat(size > hot, size)
            yield _packed([(0, 3, names[owner[some]], number[some], b"")])

    placed = met.where("role = 1").withColumn("bucket", F.expr(f"cast(cast(bucket as bigint) * {parts} div {fine} as int)"))
    found = materialize(_grouped(placed, parts, _PACKED, paired))

    def hot_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for items, *_ in _arrays(batch, 3, np.int64, np.int64, np.uint8):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(items))], names=["item"])

    many = found.where("role = 3").mapInArrow(hot_owners, "item bigint").distinct().count()
    partial = found.where("role = 2").agg(F.sum(F.length("z"))).first()[0] or 0
    groups = max(-(-many // owners), math.isqrt(2 * task_slots(spark)) + 1, math.isqrt(int(partial) // (2 * pairs)) + 1)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks(group: int) -> Iterator[int]:
            return (min(group, g) * groups + max(group, g) for g in range(groups))

        for batch in batches:
            for items, sizes, _ in _arrays(batch, 0, np.int64, np.int64, np.uint8):
                yield _packed([(b, 0, i, n, b"") for g, i, n in _split(_bucketed(items, groups), items, sizes) for b in blocks(g)])
            for a, b, n in _arrays(batch, 2, np.int64, np.int64, np.int32):
                x, y = _bucketed(a, groups), _bucketed(b, groups)
                yield _packed([(block, 2, *c) for block, *c in _split(np.minimum(x, y) * groups + np.maximum(x, y), a, b, n)])
            for items, number, _ in _arrays(batch, 3, np.int64, np.int64, np.uint8):
                yield _packed([(b, 3, i, n, b"") for g, i, n in _split(_bucketed(items, groups), items, number) for b in blocks(g)])

    def ended(table: pa.Table) -> Iterator[pa.RecordBatch]:
        items, sizes = (np.concatenate(c) for c in list(zip(*_arrays(table, 0, np.int64, np.int64, np.uint8), strict=True))[:2])
        order = np.argsort(items)
        items, sizes = items[order], sizes[order]
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b, n in _arrays(table, 2, np.int64, np.int64, np.int32):
            keys.append(np.searchsorted(items, a) * len(items) + np.searchsorted(items, b))
            counts.append(n.astype(np.int64))
        if rows := _arrays(table, 3, np.int64, np.int64, np.uint8):
            owner, number = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            low, high = divmod(int(table["bucket"][0].as_py()), groups)
            group = _bucketed(owner, groups)
            (ux, x), (uy, y) = (np.unique(owner[group == g], return_inverse=True) for g in (low, high))
            met = _dense(number[group == low], x, number[group == high], y, (len(ux), len(uy)))
            i, j = np.nonzero(np.triu(met, 1) if low == high else met)
            n = met[i, j].astype(np.int64)
            i, j = np.searchsorted(items, ux)[i], np.searchsorted(items, uy)[j]
            keys.append(np.minimum(i, j) * len(items) + np.maximum(i, j))
            counts.append(n)
        keys, counts = _summed(np.concatenate(keys), np.concatenate(counts))
        i, j = keys // max(1, len(items)), keys % max(1, len(items))
        for at in range(0, len(keys), 1_000_000):
            x, y = i[at : at + 1_000_000], j[at : at + 1_000_000]
            yield fn(items[x], items[y], counts[at : at + len(x)], sizes[x], sizes[y])

    return _grouped(met.where("role = 0").union(found).mapInArrow(routed, _PACKED), groups * groups, schema, ended)


def full_links(df: DataFrame, row: str, text: str, k: int = 21, least: float = 0.5) -> DataFrame:
    """(a, b, containment): pairs of distinct texts of which b holds at least ``least`` of a's canonical k-mers.

    Over all k-mers and all rows; equal texts are reduced to their least row first. What pairs share is counted in whole
    (``_counted``), and those that reach the share in either direction are kept where they are counted.
    """

    def kept(a: np.ndarray, b: np.ndarray, shared: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> pa.RecordBatch:
        ahead, behind = shared / n_a, shared / n_b
        x, y = ahead >= least, behind >= least
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ((a[x], b[y]), (b[x], a[y]), (ahead[x], behind[y]))], names=["a", "b", "containment"])

    return materialize(_counted(_distinct_texts(df, row, text), k, "a bigint, b bigint, containment double", kept))


def full_search(queries: DataFrame, reference: DataFrame, row: str, text: str, k: int = 21, keep: int = 3, canonical: bool = True) -> DataFrame:
    """(row, match_row, containment) of each query's best ``keep`` other texts, by the share of its k-mers that they hold.

    Over every reference and all k-mers; queries are rows of the reference. The k-mers a query shares with each reference
    are counted in hash parts, never too low; the ``keep`` with most are verified on the texts, and so is every other one
    whose count can still reach the least of them. Equal texts count once, by their least row; those equal to the query by
    their least other row. Ties: the lesser row. References that share nothing are no match; null texts and texts
    shorter than ``k`` have no row. With ``canonical`` off, k-mers are compared as they are written, case included.
    """
    texts = _texts(reference, row, text, canonical)
    digest = F.md5(F.encode(F.col(text), "utf-8"))
    asked = materialize(queries.select(F.col(row).alias("q"), digest.alias("d")).distinct())
    marked = texts.join(asked.select("d").where("d is not null").distinct().withColumn("asked", F.lit(True)), "d", "left").select("item", "packed", "length", F.coalesce("asked", F.lit(False)).alias("asked"))

    def counted(table: pa.Table) -> pa.Table:
        names, owner, start, size = _met(table)
        # the lowest bit of a name says whether it is asked for
        gram = np.repeat(np.arange(len(size)), size)
        probes = np.flatnonzero((names[owner] & 1).astype(bool)) if len(owner) else np.zeros(0, np.int64)
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for u, c in _expanded(probes, owner, start, size, gram, len(names)) if len(probes) else ():
            keys.append(u)
            counts.append(c)
        u = np.concatenate(keys)
        return pa.table({"a": names[u // len(names)] >> 1, "b": names[u % len(names)] >> 1, "c": np.concatenate(counts)})

    named = marked.select((F.shiftleft("item", 1) + F.col("asked").cast("bigint")).alias("item"), "packed", "length")
    met = _kmer_parts(named, k, canonical).groupBy("part").applyInArrow(counted, "a bigint, b bigint, c bigint")
    bound = materialize(met.groupBy("a", "b").agg(F.sum("c").alias("c")))
    # a limit on a rank is taken within partitions first, so no task holds all that one query meets
    most = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), "b"))
    first = bound.withColumn("__n", most).where(F.col("__n") <= keep).select("a", "b")
    verified = materialize(_shared_kmers(first, texts, k, canonical))
    floor = verified.groupBy("a").agg(F.when(F.count("*") >= keep, F.min("shared")).otherwise(0).alias("floor"))
    open_ = bound.join(materialize(floor), "a").where("c >= floor and c > 0").select("a", "b").join(verified.select("a", "b"), ["a", "b"], "left_anti")
    exact = verified.union(materialize(_shared_kmers(open_, texts, k, canonical))).where("shared > 0").select("a", "b", (F.col("shared") / F.col("n_a")).alias("containment"))
    own = asked.join(texts.select("d", F.col("item").alias("a"), "second", (F.col("length") >= k).alias("has")), "d")
    copies = own.where("has and second is not null").select("q", F.when(F.col("a") == F.col("q"), F.col("second")).otherwise(F.col("a")).alias("b"), F.lit(1.0).alias("containment"))
    found = own.join(exact, "a").select("q", "b", "containment").union(copies)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("containment"), "b"))
    return found.withColumn("__rank", rank).where(F.col("__rank") <= keep).select(F.col("q").alias(row), F.col("b").alias(f"match_{row}"), "containment")


def full_nearest(queries: DataFrame, reference: DataFrame, row: str, text: str, k: int = 21) -> DataFrame:
    """(row, nearest, max_containment, tier): each query's best other text by ``full_search``, with the tier of what it holds.

    Queries without match, be they too short, null or unlike all others, have 0 and no reference.
    """
    best = full_search(queries, reference, row, text, k, 1).withColumnsRenamed({f"match_{row}": "nearest", "containment": "c"})
    out = queries.select(row).distinct().join(best, row, "left")
    c = F.coalesce("c", F.lit(0.0))
    return out.select(row, "nearest", c.alias("max_containment"), novelty_tier(c).alias("tier"))


def link_classes(df: DataFrame, row: str, text: str, links: DataFrame) -> DataFrame:
    """(row, class_id, links): one row per text with k-mers or not: its class and the number of other rows linked to its
    text directly or equal to it. Null texts are classes of their own without links."""
    digest = F.md5(F.encode(F.col(text), "utf-8"))
    # the texts are read once
    rows = materialize(df.select(F.col(row).alias("r"), digest.alias("d")))
    reps = rows.where("d is not null").groupBy("d").agg(F.min("r").alias("rep"), F.count("*").alias("copies"))
    links = materialize(links.select("a", "b"))
    classes = connected_components(links).withColumnRenamed("node", "rep")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(reps.select(F.col("rep").alias("b"), "copies"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("deg"))
    of = reps.join(classes, "rep", "left").join(degree, "rep", "left").select("d", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("deg", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return rows.join(of, "d", "left").select(F.col("r").alias(row), F.coalesce("class_id", "r").alias("class_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def greedy_distinct(df: DataFrame, row: str, text: str, links: DataFrame) -> DataFrame:
    """(row): the texts that a pass in order of ``row`` would count as distinct: each is kept unless linked to one kept before.

    The pass is sequential, its result is not: in rounds, texts without an undecided linked text before them are kept and
    those linked to them are dropped. Only linked texts take part; all others are distinct. Equal texts count once.
    """
    digest = F.md5(F.encode(F.col(text), "utf-8"))
    reps = df.where(F.col(text).isNotNull()).groupBy(digest.alias("__d")).agg(F.min(row).alias("r")).select("r")
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    left = materialize(pairs)
    nodes = left.select(F.col("a").alias("r")).union(left.select(F.col("b").alias("r"))).distinct()
    undecided = materialize(nodes)
    alone = reps.join(undecided, "r", "left_anti")
    kept = [alone]
    while undecided.limit(1).count():
        free = materialize(undecided.join(left.select(F.col("b").alias("r")).distinct(), "r", "left_anti"))
        kept.append(free)
        gone = left.join(free.select(F.col("r").alias("a")), "a", "left_semi").select(F.col("b").alias("r")).distinct()
        undecided = materialize(undecided.join(free.union(gone), "r", "left_anti"))
        left = left.join(undecided.select(F.col("r").alias("a")), "a", "left_semi").join(undecided.select(F.col("r").alias("b")), "b", "left_semi")
        left = materialize(left.select("a", "b"))
    out = kept[0]
    for k in kept[1:]:
        out = out.union(k)
    return out.select(F.col("r").alias(row))


def pairwise_summary(df: DataFrame, row: str, text: str, k: int = 21) -> DataFrame:
    """One row: texts, pairs, meeting (pairs that share a k-mer), median and greatest containment over all pairs.

    Containment is that of the smaller set, 0 for pairs that share nothing; these are counted, not made. What pairs share
    is counted in whole (``_counted``) and only the tally of the values is kept. Equal texts count once.
    """

    def tallied(a: np.ndarray, b: np.ndarray, shared: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> pa.RecordBatch:
        c, n = np.unique(shared / np.minimum(n_a, n_b), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], names=["c", "n"])

    met = _counted(_distinct_texts(df, row, text), k, "c double, n bigint", tallied)
    n = df.where(F.col(text).isNotNull()).agg(F.countDistinct(F.md5(F.encode(F.col(text), "utf-8"))).alias("n"))
    counts = materialize(met.groupBy("c").agg(F.sum("n").alias("n")))
    values = counts.agg(F.sum("n").alias("meeting"), F.max("c").alias("greatest"))
    one = n.withColumns({"meeting": values.select(F.coalesce("meeting", F.lit(0))).scalar(), "greatest": values.select("greatest").scalar()})
    one = one.withColumn("pairs", F.expr("n * (n - 1) div 2"))
    zeros = counts.select("c", "n").union(one.select(F.lit(0.0), F.col("pairs") - F.col("meeting")))
    median = zeros.where("n > 0").agg(F.expr("percentile(c, 0.5, n)").alias("m")).scalar()
    return one.select(F.col("n").alias("texts"), "pairs", "meeting", median.alias("median"), F.coalesce("greatest", F.when(F.col("pairs") > 0, 0.0)).alias("greatest"))


def near_cleaned_splits(df: DataFrame, row: str, split: str, text: str, links: DataFrame) -> DataFrame:
    """As ``cleaned_splits``, but a row also goes if its text is linked to one in a split above, not only equal to it.

    ``links``: (a, b) of representatives, the least rows of equal texts, as ``full_links`` gives them. val and test are
    cleaned against train, then val against the cleaned test. Null texts match nothing.
    """
    digest = F.md5(F.encode(F.col(text), "utf-8"))
    reps = df.where(F.col(text).isNotNull()).groupBy(digest.alias("__d")).agg(F.min(row).alias("__rep"))
    rows = df.withColumn("__d", digest).join(reps, "__d", "left").drop("__d")
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())

    def near(above: DataFrame) -> DataFrame:
        own = above.where("__rep is not null").select("__rep").distinct()
        return own.union(both.join(own.select(F.col("__rep").alias("b")), "b").select(F.col("a").alias("__rep"))).distinct()

    of = lambda name: rows.where(F.col(split) == name)
    train = materialize(near(of("train")))
    test = of("test").join(train, "__rep", "left_anti")
    val = of("val").join(train, "__rep", "left_anti").join(near(test), "__rep", "left_anti")
    return rows.where(~F.coalesce(F.col(split).isin("val", "test"), F.lit(False))).unionByName(test).unionByName(val).drop("__rep")


def set_summary(classes: DataFrame) -> DataFrame:
    """One row: rows, classes, share of rows with a link, and the size of the largest class."""
    sizes = classes.groupBy("class_id").agg(F.count("*").alias("n"), F.count_if(F.col("links") > 0).alias("linked"))
    return sizes.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"), (F.sum("linked") / F.sum("n")).alias("near_dup_share"), F.max("n").alias("largest"))


def best_identity(df: DataFrame, row: str, hits: DataFrame, score: str) -> DataFrame:
    """Per row of ``df`` the greatest score of its hits; 0.0 without hits."""
    best = hits.groupBy(row).agg(F.max(score).alias("best"))
    return df.select(row).distinct().join(best, row, "left").select(row, F.coalesce("best", F.lit(0.0)).alias("best"))


def cleaned_splits(df: DataFrame, row: str, split: str, content: Column) -> DataFrame:
    """Evaluation rows whose content is in a split above them removed, in order: val and test against train, then val against
    the cleaned test. Rows of train and of other splits stay; null contents match nothing."""
    rows = df.withColumn("__c", content)
    of = lambda name: rows.where(F.col(split) == name)
    train = of("train").select("__c").where("__c is not null").distinct()
    test = of("test").join(train, "__c", "left_anti")
    val = of("val").join(train, "__c", "left_anti").join(test.select("__c").where("__c is not null").distinct(), "__c", "left_anti")
    return rows.where(~F.coalesce(F.col(split).isin("val", "test"), F.lit(False))).unionByName(test).unionByName(val).drop("__c")


def excluded(df: DataFrame, near: DataFrame, row: str, group: str) -> tuple[DataFrame, DataFrame]:
    """(rows kept, report): rows listed in ``near`` are dropped; per group: before, removed, after."""
    flags = near.select(row).distinct().withColumn("__near", F.lit(True))
    both = df.join(flags, row, "left")
    report = both.groupBy(group).agg(F.count("*").alias("before"), F.count("__near").alias("removed"), F.count_if(F.col("__near").isNull()).alias("after"))
    return both.where("__near is null").drop("__near"), report


def rotated_pairs(df: DataFrame, row: str, value: str, width: int = 4096) -> DataFrame:
    """Each row with the next one in order of ``row``, the last with the first: mismatched pairs as a floor for similarity."""
    ranked = rank_by_value(df.select(row, value), row, width, "n")
    last = ranked.agg(F.max("n")).scalar()
    nxt = ranked.select(F.col("n").alias("m"), F.col(row).alias("other"), F.col(value).alias("other_value"))
    here = ranked.withColumn("m", F.when(F.col("n") == last, F.lit(1)).otherwise(F.col("n") + 1))
    return here.join(nxt, "m").select(row, value, "other", "other_value")


def common_prefix(a: Column, b: Column, most: int = 1 << 20) -> Column:
    """Length of the longest common prefix, by halving steps: twenty comparisons at most, none per character. Null with null."""
    steps = [1 << i for i in range(most.bit_length() - 1, -1, -1)]
    shortest = F.least(F.length(a), F.length(b))
    found = F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, s: F.when((at + s <= shortest) & (F.substring(a, at + 1, s) == F.substring(b, at + 1, s)), at + s).otherwise(at),
    )
    return F.when(a.isNotNull() & b.isNotNull(), found)


def profile_distances(pairs: DataFrame, rows: DataFrame, row: str, other: str, text: str, k: int = 5) -> DataFrame:
    """(row, other, distance): 1 - cosine of the k-mer counts (A, C, G, T only) of each pair; null if one has none.

    K-mers are counted once per row, in part before the shuffle, and pairs meet on the k-mers they share.
    """
    kmers = rows.where(F.col(text).isNotNull()).select(F.col(row).alias("__r"), F.explode(sequence.kmers(F.upper(F.col(text)), k)).alias("__k"))
    counted = kmers.where(~F.col("__k").rlike("[^ACGT]")).groupBy("__r", "__k").agg(F.count("*").cast("double").alias("__n"))
    norms = counted.groupBy("__r").agg(F.sqrt(F.sum(F.col("__n") * F.col("__n"))).alias("__norm"))
    ids = pairs.select(row, other)
    left = ids.join(counted.select(F.col("__r").alias(row), "__k", F.col("__n").alias("__a")), row)
    met = left.join(counted.select(F.col("__r").alias(other), "__k", F.col("__n").alias("__b")), [other, "__k"])
    dots = met.groupBy(row, other).agg(F.sum(F.col("__a") * F.col("__b")).alias("__dot"))
    out = ids.join(norms.select(F.col("__r").alias(row), F.col("__norm").alias("__x")), row, "left").join(norms.select(F.col("__r").alias(other), F.col("__norm").alias("__y")), other, "left").join(dots, [row, other], "left")
    return out.select(row, other, F.when(F.col("__x").isNotNull() & F.col("__y").isNotNull(), 1 - F.coalesce("__dot", F.lit(0.0)) / (F.col("__x") * F.col("__y"))).alias("distance"))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - shared / all members of two sets; 0.0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, 1 - F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def nearest_vectors(queries: DataFrame, bank: DataFrame, row: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """(row, mean_distance, nearest): Euclidean distance of each query to its ``k`` nearest other vectors of the bank.

    Both sides are cut into blocks by hash, about ``block`` rows each; one task compares a block of queries with a block
    of the bank by a matrix product and keeps k per query, and the partial lists are merged. Null vectors take no part.
    """
    nq = max(1, -(-queries.count() // block))
    nb = max(1, -(-bank.count() // block))
    q = queries.where(F.col(vector).isNotNull()).select(F.col(row).alias("r"), F.col(vector).alias("v"), F.lit(0).alias("side"), F.pmod(F.xxhash64(row), F.lit(nq)).alias("qb"))
    q = q.withColumn("bb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nb - 1).cast("bigint"))))
    b = bank.where(F.col(vector).isNotNull()).select(F.col(row).alias("r"), F.col(vector).alias("v"), F.lit(1).alias("side"), F.pmod(F.xxhash64(row), F.lit(nb)).alias("bb"))
    b = b.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nq - 1).cast("bigint")))).select("r", "v", "side", "qb", "bb")

    def compare(t: pa.Table) -> pa.Table:
        side, ids = t["side"].to_numpy(), t["r"].to_numpy()
        vectors = np.array(t["v"].to_pylist(), np.float64).reshape(len(ids), -1)
        x, y = vectors[side == 0], vectors[side == 1]
        own, other = ids[side == 0], ids[side == 1]
        out: dict[str, list] = {"r": [], "o": [], "d": []}
        for low in range(0, len(x), 512):
            part = x[low : low + 512]
            d = np.maximum((part**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * part @ y.T, 0)
            d[own[low : low + 512, None] == other[None]] = np.inf
            for i in range(len(part)):
                for j in np.lexsort((other, d[i]))[:k]:
                    if np.isfinite(d[i, j]):
                        out["r"].append(own[low + i])
                        out["o"].append(other[j])
                        out["d"].append(float(np.sqrt(((part[i] - y[j]) ** 2).sum())))
        return pa.table({"r": pa.array(out["r"], pa.int64()), "o": pa.array(out["o"], pa.int64()), "d": pa.array(out["d"], pa.float64())})

    near = q.select("r", "v", "side", "qb", "bb").unionByName(b).withColumn("r", F.col("r").cast("bigint")).groupBy("qb", "bb").applyInArrow(compare, "r bigint, o bigint, d double")
    rank = F.row_number().over(Window.partitionBy("r").orderBy("d", "o"))
    near = near.withColumn("n", rank).where(F.col("n") <= k)
    return near.groupBy(F.col("r").alias(row)).agg(F.avg("d").alias("mean_distance"), F.min_by("o", "n").alias("nearest"))
