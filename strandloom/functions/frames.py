"""Open reading frames in all six frames, by NumPy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.runtime import spread


_LETTER = np.full(256, 64, np.int16)
for _i, _c in enumerate(b"ACGT"):
    _LETTER[_c] = _i
_ATG, _STOPS = 14, (48, 50, 56)


def _frames(seq: bytes, least: int) -> list[tuple[int, int]]:
    """(start, end) of ATG ... stop on one strand, end behind the stop, each from the first ATG after the stop before it."""
    x = _LETTER[np.frombuffer(seq, np.uint8)]
    if len(x) < 3:
        return []
    codon = 16 * x[:-2] + 4 * x[1:-1] + x[2:]
    found: list[tuple[int, int]] = []
    for frame in range(3):
        own = codon[frame::3]
        stops, starts = np.flatnonzero(np.isin(own, _STOPS)), np.flatnonzero(own == _ATG)
        if not len(stops) or not len(starts):
            continue
        after = np.concatenate([[-1], stops[:-1]])
        at = np.searchsorted(starts, after, "right")
        first = starts[np.minimum(at, len(starts) - 1)]
        good = (at < len(starts)) & (first < stops) & (stops - first >= least)
        found += zip((frame + 3 * first[good]).tolist(), (frame + 3 * stops[good] + 3).tolist(), strict=True)
    return found


def open_frames(df: DataFrame, row: str, seq: str, least: int = 50, grain: int = 100) -> DataFrame:
    """(row, s, e, strand, aa): frames of at least ``least`` residues on both strands, in forward coordinates.

    Of frames that start within the same ``grain`` bases of one strand only the longest stays (ties: the first). Null and
    short sequences have none.
    """
    swap = bytes.maketrans(b"ACGTacgt", b"TGCATGCA")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not s:
                    continue
                forward = s.upper().encode("ascii", "replace")
                best: dict[tuple[int, int], tuple[int, int]] = {}
                for strand, text in ((1, forward), (-1, forward.translate(swap)[::-1])):
                    for a, b in _frames(text, least):
                        lo, hi = (a, b) if strand > 0 else (len(text) - b, len(text) - a)
                        key = (lo // grain, strand)
                        if key not in best or hi - lo > best[key][1] - best[key][0]:
                            best[key] = (lo, hi)
                out += [(i, lo, hi, strand) for (_, strand), (lo, hi) in sorted(best.items())]
            cols = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), *(pa.array(c.astype(np.int32)) for c in cols[1:])], names=["row", "s", "e", "strand"])

    rows = df.select(F.col(row).cast("bigint").alias("row"), F.col(seq).alias("seq"))
    found = spread(rows).mapInArrow(run, "row bigint, s int, e int, strand int")
    return found.select(F.col("row").alias(row), "s", "e", "strand", (F.floor((F.col("e") - F.col("s")) / 3) - 1).alias("aa"))
