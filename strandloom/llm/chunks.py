"""Splitting oversized sequences at natural boundaries by structure-tree packing.

The tree of a sequence: the whole, cut at the ends of gaps into blocks, cut at the ends of genes into leaves. Packing
takes whole siblings while they fit behind the piece's start and descends only into the node that does not; a leaf
that is still too long is cut at the limit.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_ends(seq, least: int = 20):
    """Column: the ends (0-based, exclusive) of runs of at least ``least`` N in any case, without the end of the sequence."""
    # runs of N and of anything else take turns; a running sum of their lengths places them
    runs = F.regexp_extract_all(seq, F.lit("[Nn]+|[^Nn]+"), F.lit(0))
    ends = F.aggregate(
        runs,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p)).alias("at"),
            F.when((F.length(p) >= least) & F.substring(p, 1, 1).isin("N", "n"), F.concat(s["ends"], F.array(s["at"] + F.length(p)))).otherwise(s["ends"]).alias("ends"),
        ),
        lambda s: s["ends"],
    )
    return F.filter(ends, lambda e: e < F.length(seq))


class Node:
    """A stretch [start, end) of a sequence and the consecutive stretches it is made of."""

    __slots__ = ("start", "end", "kids", "ends")

    def __init__(self, start: int, end: int, kids: list[Node] = ()):
        self.start, self.end, self.kids = start, end, list(kids)
        self.ends = [k.end for k in self.kids]


def structure(length: int, gaps: list[int], genes: list[int]) -> Node:
    """Whole -> blocks that end with gaps -> leaves that end with genes; boundaries outside (0, length) are ignored."""
    outer = [0, *sorted({g for g in gaps if 0 < g < length}), length]
    inner = sorted({g for g in genes if 0 < g < length})
    blocks, i = [], 0
    for a, b in zip(outer, outer[1:], strict=False):
        cuts = [a]
        while i < len(inner) and inner[i] < b:
            if inner[i] > a:
                cuts.append(inner[i])
            i += 1
        cuts.append(b)
        blocks.append(Node(a, b, [Node(x, y) for x, y in zip(cuts, cuts[1:], strict=False)] if len(cuts) > 2 else ()))
    return Node(0, length, blocks)


def furthest(node: Node, above: int, limit: int) -> int:
    """The last boundary in (above, limit]: whole siblings first, then down into the one that crosses the limit."""
    best = -1
    while node.kids:
        i = bisect_right(node.ends, limit)
        if i and node.ends[i - 1] > above:
            best = max(best, node.ends[i - 1])
        if i == len(node.kids):
            break
        node = node.kids[i]
    return best


def pack(root: Node, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of at most ``limit`` that overlap by ``overlap``; each ends at the last boundary that fits, else at the limit."""
    pieces, start = [], 0
    while root.end - start > limit:
        end = furthest(root, start + overlap, start + limit)
        if end < 0:
            end = start + limit
        pieces.append((start, end))
        start = end - overlap
    pieces.append((start, root.end))
    return pieces


def split_oversized(df: DataFrame, id_col: str, seq_col: str, genes: DataFrame | None = None, genes_id: str = "record_id", genes_col: str = "genes", limit: int = 8000, overlap: int = 400, least_gap: int = 20) -> DataFrame:
    """(id, piece_start, piece_end): all pieces of each sequence longer than ``limit`` characters.

    Pieces overlap by ``overlap`` and end at genes or gaps where one lies more than ``overlap`` behind their start.
    ``genes`` may have several rows an id, unsorted, repeated or outside the sequence; null arrays, members and ends are
    ignored. Null and short sequences have no rows; ids must be unique and not null. Only positions are shuffled, never
    sequences; no other columns are read. An empty table gives an empty result.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    long = df.where((F.length(seq_col) > limit) & F.col(id_col).isNotNull())
    rows = long.select(F.col(id_col).cast("bigint").alias("id"), F.length(seq_col).alias("length"), gap_ends(F.col(seq_col), least_gap).alias("gaps"))
    if genes is None:
        rows = rows.withColumn("genes", F.array().cast("array<int>"))
    else:
        ends = genes.where(F.col(genes_id).isNotNull()).select(F.col(genes_id).cast("bigint").alias("id"), F.array_distinct(F.transform(genes_col, lambda g: g["e"].cast("int"))).alias("e"))
        ends = ends.where("e is not null").join(rows.select("id"), "id", "left_semi").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("e"))).alias("genes"))
        rows = rows.join(ends, "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, start, end = [], [], []
            for i, n, gaps, inner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = pack(structure(n, gaps or [], [g for g in inner or [] if g is not None]), limit, overlap)
                ids += [i] * len(found)
                start += [s for s, _ in found]
                end += [e for _, e in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(start, np.int32)), pa.array(np.array(end, np.int32))], names=["id", "piece_start", "piece_end"])

    return rows.select("id", "length", "gaps", "genes").mapInArrow(run, "id bigint, piece_start int, piece_end int")
