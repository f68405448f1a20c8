"""Cutting records into windows and labelling positions. Closed forms; Python only where each cut depends on the last."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def budget(limit: int, prefix: int, slack: int = 0, end: int = 0, overlap: int = 0) -> tuple[int, int]:
    """(budget, stride) in characters; an error if nothing is left or the overlap is not below it."""
    b = limit - prefix - slack - end
    if b <= 0:
        raise ValueError(f"limit {limit} leaves nothing beside prefix {prefix}, slack {slack} and end {end}")
    if not 0 <= overlap < b:
        raise ValueError(f"overlap {overlap} must be at least 0 and below the budget {b}")
    return b, b - overlap


def window_count(length: Column, size: int, stride: int) -> Column:
    """How many windows cover a length: 1 + ceil((length - size) / stride), 1 if it fits."""
    return F.when(length <= size, F.lit(1)).otherwise(1 + F.ceil((length - size) / stride).cast("int"))


def tiles(df: DataFrame, length: Column, size: int, stride: int) -> DataFrame:
    """One row per window: adds window (0, 1, ...), nt_start, nt_end, last. Null lengths have none; length 0 has one empty."""
    n = window_count(length, size, stride)
    rows = df.where(length.isNotNull()).withColumn("window", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("window") * stride
    return rows.withColumn("nt_start", start).withColumn("nt_end", F.least(start + size, length)).withColumn("last", F.col("nt_end") >= length)


def gene_tiles(df: DataFrame, row: str, length: str, genes: str, size: int, overlap: int) -> DataFrame:
    """(row, nt_start, nt_end): windows that end at the last gene end that fits, cut at the limit where no gene does.

    ``genes``: array of structs with s and e. The next window starts ``overlap`` before the end, or at the end if that
    would not advance. Records without genes are tiled evenly. Null lengths have no windows.
    """
    stride = size - overlap

    def spans(n: int, bounds: list[tuple[int, int]]) -> list[tuple[int, int]]:
        if n <= size:
            return [(0, n)]
        starts = np.array([g[0] for g in bounds], np.int64)
        ends = np.array([g[1] for g in bounds], np.int64)
        out, at = [], 0
        while at < n:
            if n - at <= size:
                out.append((at, n))
                break
            if not len(starts):
                end = at + size
            else:
                fits = ends[(starts >= at) & (starts < at + size) & (ends <= at + size)]
                end = int(fits[-1]) if len(fits) and fits[-1] > at else at + size
            out.append((at, end))
            back = at + stride if not len(starts) else end - overlap
            at = back if back > at else end
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, start, end = [], [], []
            for i, n, gs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bounds = sorted((g["s"], g["e"]) for g in gs or [] if g and g["s"] is not None and g["e"] is not None)
                for s, e in spans(n, bounds):
                    ids.append(i)
                    start.append(s)
                    end.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["row", "nt_start", "nt_end"])

    rows = df.where(F.col(length).isNotNull()).select(F.col(row).cast("bigint").alias("row"), F.col(length).cast("int").alias("length"), F.transform(genes, lambda g: F.struct(g["s"].alias("s"), g["e"].alias("e"))).alias("genes"))
    return rows.mapInArrow(run, "row bigint, nt_start int, nt_end int").withColumnRenamed("row", row)


def longest_prefix(df: DataFrame, prefix: Column) -> DataFrame:
    """One row: the most bytes any prefix takes, the mean, and their difference (the slack)."""
    n = F.octet_length(prefix)
    return df.agg(F.max(n).alias("longest"), F.avg(n).alias("mean"), (F.max(n) - F.avg(n)).alias("slack"))


def window_text(text: Column, start: Column, end: Column, last: Column, whole: Column, continued: Column, mark: str, limit: int) -> Column:
    """Prefix (full at the start, continuation inside), the stretch, and ``mark`` on the last window; over ``limit`` fails."""
    out = F.concat(F.when(start == 0, whole).otherwise(continued), F.substring(text, start + 1, end - start), F.when(last, F.lit(mark)).otherwise(""))
    return F.when(F.length(out) > limit, F.raise_error(F.concat(F.lit("a window exceeds the limit by "), (F.length(out) - limit).cast("string"))).cast("string")).otherwise(out)


def padded_labels(tokens: Column, prefix: Column, limit: int, pad: int = 0, ignore: int = -100) -> tuple[Column, Column]:
    """(ids, labels) of length ``limit``: padded on the right; labels ignore the prefix and the padding."""
    n = F.size(tokens)
    ids = F.concat(tokens, F.array_repeat(F.lit(pad), F.greatest(F.lit(limit) - n, F.lit(0))))
    labels = F.concat(F.array_repeat(F.lit(ignore), F.least(prefix, n)), F.slice(tokens, F.least(prefix, n) + 1, F.greatest(n - prefix, F.lit(0))), F.array_repeat(F.lit(ignore), F.greatest(F.lit(limit) - n, F.lit(0))))
    return F.slice(ids, 1, limit), F.slice(labels, 1, limit)


def free_windows(df: DataFrame, row: str, seq: str, spans: str, size: int, most_other: float = 0.01) -> DataFrame:
    """(row, nt_start, nt_end): windows on a grid of ``size`` that touch no span [s, e) and hold at most ``most_other`` of N."""
    n = F.length(seq)
    grid = F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(size))).otherwise(F.array().cast("array<int>"))
    rows = df.where(F.col(seq).isNotNull()).select(row, seq, spans, F.explode(grid).alias("nt_start"))
    part = F.substring(F.col(seq), F.col("nt_start") + 1, F.lit(size))
    free = ~F.exists(F.coalesce(F.col(spans), F.array().cast(df.schema[spans].dataType)), lambda x: (x["e"] > F.col("nt_start")) & (x["s"] < F.col("nt_start") + size))
    few = F.length(part) - F.length(F.translate(part, "Nn", "")) <= most_other * size
    return rows.where(free & few).select(row, "nt_start", (F.col("nt_start") + size).alias("nt_end"))


def weight_runs(df: DataFrame, row: str, length: str, spans: str, weight: float) -> DataFrame:
    """(row, start, end, w): runs of positions with equal loss weight, 1 outside and ``weight`` inside of class spans, divided by
    the record's mean so that every record counts alike. Runs instead of positions: a record of any length stays small."""
    n = F.col(length)
    inside = F.filter(F.coalesce(F.col(spans), F.array().cast(df.schema[spans].dataType)), lambda x: x["is_class"] & (x["e"] > x["s"]) & (x["e"] > 0) & (x["s"] < n))
    ends = F.flatten(F.transform(inside, lambda x: F.array(F.greatest(x["s"], F.lit(0)), F.least(x["e"], n))))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), n), ends)))
    runs = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: F.struct(F.get("cuts", i - 1).alias("s"), F.get("cuts", i).alias("e")))
    weighed = F.transform("runs", lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), F.when(F.exists("inside", lambda x: (x["s"] <= r["s"]) & (x["e"] >= r["e"])), F.lit(weight)).otherwise(1.0).alias("w")))
    rows = df.where(n > 0).select(row, n.alias("n"), cuts.alias("cuts"), inside.alias("inside"))
    rows = rows.withColumn("runs", runs).withColumn("weighed", weighed)
    mean = F.aggregate("weighed", F.lit(0.0), lambda s, r: s + r["w"] * (r["e"] - r["s"])) / F.col("n")
    return rows.withColumn("mean", mean).select(row, F.explode("weighed").alias("r"), "mean").select(row, F.col("r.s").alias("start"), F.col("r.e").alias("end"), (F.col("r.w") / F.col("mean")).alias("w"))


def codon_phase(position: Column, start: Column, end: Column, strand: Column) -> Column:
    """0, 1 or 2 inside the gene [start, end), counted from its high end on the reverse strand; -1 outside."""
    inside = (position >= start) & (position < end)
    return F.when(inside, F.when(strand >= 0, F.pmod(position - start, F.lit(3))).otherwise(F.pmod(end - 1 - position, F.lit(3)))).otherwise(-1)
