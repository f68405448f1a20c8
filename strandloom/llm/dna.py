"""NumPy primitives on batches of DNA: codes, packed k-mers, minimizers, and base-level matching of two sequences.

Codes are 0..3 for A, C, G, T in any case and 4 for every other character. Positions count characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

OTHER = np.uint8(4)
_DROP = 5
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)

CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    CODE[_c] = CODE[_c + 32] = _i
#: As CODE, but gap characters and white space vanish: they stand for no base.
LETTERS = CODE.copy()
LETTERS[[ord(c) for c in "-.*~ \t\r\n"]] = _DROP


def encoded(column: pa.Array, table: np.ndarray = CODE, bases: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Cuts a string column into slices of about ``bases`` characters.

    Yields (first row, end row, codes, starts, lengths); the codes of consecutive rows are separated by one code 4, so
    no k-mer spans two rows. A row longer than ``bases`` is a slice of its own. Nulls have length 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + bases, "right")) - 1)
        raw, lengths = data[offsets[low] : offsets[high]], np.diff(offsets[low : high + 1])
        if len(raw) and raw.max() >= 128:
            rows = [x.encode("ascii", "replace") for x in column.slice(low, high - low).to_pylist()]
            raw, lengths = np.frombuffer(b"".join(rows), np.uint8), np.array([len(x) for x in rows], np.int64)
        codes = table[raw]
        if table[ord("-")] == _DROP and (drop := codes == _DROP).any():
            kept = np.concatenate([[0], np.cumsum(~drop)])
            ends = np.cumsum(lengths)
            lengths = kept[ends] - kept[ends - lengths]
            codes = codes[~drop]
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        out = np.full(len(codes) + high - low, 4, np.uint8)
        out[np.arange(len(codes)) + np.repeat(np.arange(high - low), lengths)] = codes
        yield low, high, out, starts, lengths
        low = high


def reverse_complement(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < 4, 3 - codes, codes)[::-1].astype(np.uint8)


def packed(codes: np.ndarray, k: int, both: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Every k-mer (k <= 31) as 2 bits a base: forward value, reverse-complement value, and whether it is all A, C, G, T."""
    n = len(codes) - k + 1
    if n <= 0:
        z = np.zeros(0, np.uint64)
        return z, z, np.zeros(0, bool)
    x = (codes & 3).astype(np.uint64)
    forward, backward, size = x, 3 - x, 1
    whole_f = whole_b = None
    have = 0
    left = k
    while True:
        if left & 1:
            if whole_f is None:
                whole_f, whole_b, have = forward, backward, size
            else:
                m = len(codes) - have - size + 1
                whole_f = (whole_f[:m] << np.uint64(2 * size)) | forward[have : have + m]
                if both:
                    whole_b = whole_b[:m] | (backward[have : have + m] << np.uint64(2 * have))
                have += size
        left >>= 1
        if not left:
            break
        m = len(codes) - 2 * size + 1
        forward = (forward[:m] << np.uint64(2 * size)) | forward[size : size + m]
        if both:
            backward = backward[:m] | (backward[size : size + m] << np.uint64(2 * size))
        size *= 2
    bad = np.concatenate([[0], np.cumsum(codes >= 4, dtype=np.int32)])
    return whole_f, whole_b if both else None, bad[k:] == bad[:-k]


def mixed(values: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mix, so that the order of hashes says nothing about the bases."""
    h = values * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    out, size = values, 1
    while size * 2 <= width:
        out = op(out[:-size], out[size:])
        size *= 2
    return op(out[: len(out) - (width - size)], out[width - size :]) if width > size else out


def minimizers(hashes: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Positions that are minimal in some window of ``width`` consecutive k-mers.

    Every run of ``width`` valid k-mers has at least one, chosen by content alone: equal runs choose equal ones.
    """
    if not len(hashes):
        return np.zeros(0, np.int64)
    h = np.where(valid, hashes, _MAX)
    pad = np.full(width - 1, _MAX, np.uint64)
    least = _sliding(np.concatenate([pad, h, pad]), width, np.minimum)
    return np.flatnonzero((_sliding(least, width, np.maximum) == h) & valid)


def to_bits(codes: np.ndarray) -> bytes:
    """Two bits a base behind a length and the runs of other characters; about a quarter of the text's size."""
    n = len(codes)
    other = np.flatnonzero(np.diff(np.concatenate([[0], (codes >= 4).view(np.int8), [0]])))
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = codes & 3
    q = padded.reshape(-1, 4)
    body = (q[:, 0] << 6) | (q[:, 1] << 4) | (q[:, 2] << 2) | q[:, 3]
    return np.concatenate([[n, len(other)], other]).astype(np.int32).tobytes() + body.astype(np.uint8).tobytes()


def from_bits(data: bytes) -> np.ndarray:
    n, m = np.frombuffer(data, np.int32, 2)
    runs = np.frombuffer(data, np.int32, m, 8)
    body = np.frombuffer(data, np.uint8, -1, 8 + 4 * int(m))
    codes = np.empty((len(body), 4), np.uint8)
    for i in range(4):
        codes[:, i] = (body >> (6 - 2 * i)) & 3
    codes = codes.reshape(-1)[:n]
    for a, b in runs.reshape(-1, 2):
        codes[a:b] = 4
    return codes


class Indexed:
    """A sequence with its sorted k-mers, ready to be matched against others."""

    __slots__ = ("codes", "k", "keys", "places", "letters", "_turned")

    def __init__(self, codes: np.ndarray, k: int = 12):
        self.codes, self.k = codes, k
        values, _, valid = packed(codes, k, both=False)
        places = np.flatnonzero(valid)
        # the place rides in the low bits, so that one sort orders both
        joined = np.sort((values[places] << np.uint64(32)) | places.astype(np.uint64))
        self.keys, self.places = joined >> np.uint64(32), (joined & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.letters = int((codes < 4).sum())
        self._turned: Indexed | None = None

    @property
    def turned(self) -> Indexed:
        if self._turned is None:
            self._turned = Indexed(reverse_complement(self.codes), self.k)
        return self._turned


def _anchors(a: Indexed, b: Indexed, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of shared k-mers and their diagonals; those with over ``most`` partners only on the two outer diagonals."""
    low = np.searchsorted(b.keys, a.keys, "left")
    hit = low < len(b.keys)
    hit[hit] = b.keys[low[hit]] == a.keys[hit]
    if not hit.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, keys, at = low[hit], a.keys[hit], a.places[hit]
    count = np.searchsorted(b.keys, keys, "right") - low
    few = count <= most
    c = count[few]
    i = np.repeat(at[few], c)
    j = b.places[np.repeat(low[few], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
    d = j - i
    if not few.all():
        n, m, k = len(a.codes), len(b.codes), a.k
        for diagonal in {0, m - n}:
            x = at[~few]
            x = x[(x + diagonal >= 0) & (x + diagonal + k <= m)]
            if len(x):
                same = (a.codes[x[:, None] + np.arange(k)] == b.codes[x[:, None] + diagonal + np.arange(k)]).all(1)
                i, d = np.concatenate([i, x[same]]), np.concatenate([d, np.full(same.sum(), diagonal)])
    order = np.lexsort((i, d))
    return i[order], d[order]


def _runs(a: Indexed, b: Indexed, i: np.ndarray, d: np.ndarray, gap: int, least: int, reach: int, bridge: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal runs (start, end, diagonal) of anchors, their ends extended by up to ``reach`` while matches outweigh mismatches.

    Runs of one diagonal up to ``bridge`` bases apart are one run if over 0.55 of the bases between them are equal, which
    unrelated bases (0.25) do not reach.
    """
    if not len(i):
        return i, i, d
    cut = np.flatnonzero((np.diff(d) != 0) | (np.diff(i) > gap)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(i)]]) - 1
    start, end, diagonal = i[first], i[last] + a.k, d[first]
    n, m = len(a.codes), len(b.codes)
    x, y = np.append(a.codes, 7), np.append(b.codes, 6)
    between = start[1:] - end[:-1]
    near = np.flatnonzero((diagonal[1:] == diagonal[:-1]) & (between <= bridge) & (between > 0))
    if len(near):
        size = between[near]
        p = np.repeat(end[near], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        same = np.add.reduceat(x[p] == y[p + np.repeat(diagonal[near], size)], np.cumsum(size) - size)
        head = np.ones(len(start), bool)
        head[1 + near[same > 0.55 * size]] = False
        first = np.flatnonzero(head)
        start, end, diagonal = start[first], end[np.append(first[1:], len(end)) - 1], diagonal[first]
    keep = end - start >= least
    start, end, diagonal = start[keep], end[keep], diagonal[keep]
    if not len(start):
        return start, end, diagonal
    step = np.arange(reach)
    for toward in (-1, 1):
        p = (start[:, None] - 1 - step) if toward < 0 else (end[:, None] + step)
        q = p + diagonal[:, None]
        inside = (p >= 0) & (p < n) & (q >= 0) & (q < m)
        same = x[np.where(inside, p, n)] == y[np.where(inside, q, m)]
        score = np.cumsum(np.where(same, 2, -3), 1)
        best = score.argmax(1)
        grown = np.where(score[np.arange(len(best)), best] > 0, best + 1, 0)
        if toward < 0:
            start = start - grown
        else:
            end = end + grown
    return start, end, diagonal


def _mark(a: Indexed, b: Indexed, runs: tuple[np.ndarray, np.ndarray, np.ndarray], in_a: np.ndarray, in_b: np.ndarray) -> None:
    start, end, diagonal = runs
    size = end - start
    p = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    q = p + np.repeat(diagonal, size)
    same = (a.codes[p] == b.codes[q]) & (a.codes[p] < 4)
    in_a[p[same]] = True
    in_b[q[same]] = True


def distance(x: np.ndarray, y: np.ndarray, inside: bool = False) -> tuple[int, int]:
    """The edit distance of two code arrays, by bit-parallel columns; code 4 equals nothing.

    With ``inside`` it is the least distance of x to any stretch of y. The second value is where that stretch ends.
    """
    n = len(x)
    if not n:
        return (0 if inside else len(y)), len(y)
    masks = [int.from_bytes(np.packbits(x == c, bitorder="little").tobytes(), "little") for c in range(4)] + [0]
    full, top, first = (1 << n) - 1, 1 << (n - 1), 0 if inside else 1
    up, down, score = full, 0, n
    best, at = (n, 0)
    for j, c in enumerate(y.tolist()):
        equal = masks[c]
        still = equal | down
        carry = (((equal & up) + up) ^ up) | equal
        plus, minus = down | (full & ~(carry | up)), up & carry
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        if score < best:
            best, at = score, j + 1
        plus = ((plus << 1) | first) & full
        up = ((minus << 1) & full) | (full & ~(still | plus))
        down = plus & still
    return (best, at) if inside else (score, len(y))


def _whole(a: Indexed, b: Indexed, in_a: np.ndarray, in_b: np.ndarray, slack: int = 64) -> None:
    """Marks what the best place for all of a short ``a`` in b leaves untouched; right in number, not in place."""
    i, d = _anchors(a, b, 64)
    n = len(a.codes)
    if len(d):
        # the place where most anchors are
        low = int(d[np.argmax(np.searchsorted(d, d + slack, "right") - np.arange(len(d)))])
        lo, hi = max(0, low - slack), min(len(b.codes), low + n + 2 * slack)
    elif len(b.codes) <= 2 * n:
        lo, hi = 0, len(b.codes)
    else:
        return
    off, at = distance(a.codes, b.codes[lo:hi], inside=True)
    if off <= 0.3 * n:
        in_a[: n - off] = True
        in_b[max(lo, lo + at - (n - off)) : lo + at] = True


def _aligned(a: Indexed, b: Indexed, in_a: np.ndarray, in_b: np.ndarray, widest: int = 400, drift: int = 100) -> None:
    """Marks what lies between collinear runs of shared k-mers, by the edit distance of each gap.

    A run is followed by the next one in both sequences, up to ``widest`` bases and ``drift`` diagonals away. The bases of
    a gap that its edit distance leaves untouched are counted if the distance is under 0.38 of the longer side, while
    unrelated bases need about 0.5; ends of a chain are followed outwards under the stricter 0.3. Marks in a gap are
    right in number, not in place.
    """
    start, end, diagonal = _runs(a, b, *_anchors(a, b, 8), 32, a.k, 32)
    if not len(start):
        return
    _mark(a, b, (start, end, diagonal), in_a, in_b)
    order = np.argsort(start, kind="stable")
    start, end, diagonal = start[order].tolist(), end[order].tolist(), diagonal[order].tolist()
    n = len(start)
    followed = [False] * n
    length = [e - s for s, e in zip(start, end, strict=True)]
    begins = [True] * n
    n_a, n_b = len(a.codes), len(b.codes)

    def outwards(p: int, q: int, step: int) -> None:
        room = min(p, q) if step < 0 else min(n_a - p, n_b - q)
        size = min(room, widest)
        while size >= 8:
            lo_a, lo_b = (p - size, q - size) if step < 0 else (p, q)
            off = distance(a.codes[lo_a : lo_a + size], b.codes[lo_b : lo_b + size])[0]
            if off <= 0.3 * size:
                in_a[lo_a : lo_a + size - off] = True
                in_b[lo_b : lo_b + size - off] = True
                return
            size //= 2

    for r in range(n):
        for s in range(r + 1, min(n, r + 9)):
            gap_a, turn = start[s] - end[r], diagonal[s] - diagonal[r]
            if gap_a > widest:
                break
            gap_b = gap_a + turn
            # runs that were extended into each other follow each other, too, without a gap
            if min(gap_a, gap_b) <= -min(64, end[s] - start[s]) or gap_b > widest or abs(turn) > drift:
                continue
            followed[r], begins[s] = True, False
            length[s] += length[r]
            if gap_a > 0 and gap_b > 0:
                p, q = end[r], end[r] + diagonal[r]
                off = distance(a.codes[p : p + gap_a], b.codes[q : q + gap_b])[0]
                if off <= 0.38 * max(gap_a, gap_b) or max(gap_a, gap_b) <= 8:
                    in_a[p : p + max(0, gap_a - off)] = True
                    in_b[q : q + max(0, gap_b - off)] = True
            break
    for r in range(n):
        # a lone short anchor may be chance and is not followed
        if begins[r] and (followed[r] or length[r] >= 24):
            outwards(start[r], start[r] + diagonal[r], -1)
        if not followed[r] and length[r] >= 24:
            outwards(end[r], end[r] + diagonal[r], 1)


def matched(a: Indexed, b: Indexed, limit: float = 0.2, gap: int = 32, least: int = 16, reach: int = 64, most: int = 8, short: int = 600) -> tuple[int, int, int]:
    """How many bases of each sequence lie opposite an equal base of the other, and how many of b's in one part of a's size.

    Blocks may be moved or turned around: every diagonal run of shared k-mers (at least ``least`` bases, ends extended by
    up to ``reach`` while that pays) counts wherever it lies, on either strand. k-mers with over ``most`` places in b
    start no run except on the two outer diagonals; inside runs and gaps they are compared like all others. Where this
    leaves a or b with more than ``limit`` of its bases unmatched, an ``a`` of up to ``short`` bases is aligned whole, and of
    others the gaps between the runs, if these hold 0.15 of a. What is left uncovered is what substitutions, insertions and deletions touch.
    """
    in_a, in_b = np.zeros(len(a.codes), bool), np.zeros(len(b.codes), bool)
    turned = np.zeros(len(a.codes), bool)
    ahead = _runs(a, b, *_anchors(a, b, most), gap, least, reach)
    _mark(a, b, ahead, in_a, in_b)
    behind = None
    if in_b.sum() < b.letters or in_a.sum() < a.letters:
        behind = _runs(a.turned, b, *_anchors(a.turned, b, most), gap, least, reach)
        _mark(a.turned, b, behind, turned, in_b)
        in_a |= turned[::-1]
    done, of_b = in_a.sum() / max(1, a.letters), in_b.sum() / max(1, b.letters)
    for way, least_done, most_done in ((_whole, -1.0, 1 - limit), (_aligned, 0.15, 1 - limit)):
        if way is _whole and len(a.codes) > short:
            continue
        if least_done < done < most_done or (done >= most_done and least_done < of_b < most_done):
            # counted anew: marks that are right in number only must not add to others
            other_a, other_b, turned = np.zeros(len(a.codes), bool), np.zeros(len(b.codes), bool), np.zeros(len(a.codes), bool)
            way(a, b, other_a, other_b)
            if other_a.sum() < most_done * a.letters:
                way(a.turned, b, turned, other_b)
                other_a |= turned[::-1]
            if other_a.sum() + other_b.sum() > in_a.sum() + in_b.sum():
                in_a, in_b = other_a, other_b
                done, of_b = in_a.sum() / max(1, a.letters), in_b.sum() / max(1, b.letters)
    part, size = int(in_b.sum()), len(a.codes) + len(a.codes) // 4 + 16
    whole = part
    if len(b.codes) > size:
        total = np.concatenate([[0], np.cumsum(in_b)])
        part = int((total[size:] - total[:-size]).max())
    return int(in_a.sum()), whole, part
