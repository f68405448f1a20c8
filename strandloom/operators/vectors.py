"""Analytics on stored vectors. Means and axes are computed per component after a partial aggregate; what is collected or
broadcast is one vector per class."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.similarity import cosine, dot


def load_vectors(spark, path: str, manifest: dict) -> DataFrame:
    """Stored vectors, refused unless the manifest says what made them (``model``, ``layer``)."""
    if not manifest.get("model") or "layer" not in manifest:
        raise ValueError("vectors without provenance are not read")
    return spark.read.parquet(path)


def read_npz(spark, path: str, ids: str = "ids", vectors: str = "vectors") -> DataFrame:
    """(id, vector, model, layer): rows of NumPy archives, a task a file, each refused unless it says what made it.

    An archive holds two arrays of equal length, ``ids`` (integers) and ``vectors``, and the provenance ``model`` and
    ``layer`` as single values. One that lacks either fails the query; so do lengths that differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with store.open_input_file(at) as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as z:
                    if not {"model", "layer"} <= set(z.files) or not str(z["model"]):
                        raise ValueError(f"{name}: vectors without provenance are not read")
                    own, rows = z[ids].astype(np.int64), z[vectors].astype(np.float32)
                    if len(own) != len(rows):
                        raise ValueError(f"{name}: {len(own)} ids for {len(rows)} vectors")
                    model, layer = str(z["model"]), int(z["layer"])
                for low in range(0, len(own), 4096):
                    part = rows[low : low + 4096]
                    lists = pa.ListArray.from_arrays(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32), pa.array(part.reshape(-1)))
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(own[low : low + 4096]), lists, pa.array([model] * n), pa.array([layer] * n, pa.int32())], names=["id", "vector", "model", "layer"])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, "id bigint, vector array<float>, model string, layer int")


def component_means(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, i, m, n): mean of each component per label."""
    return df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))


def _assembled(cells: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value))), lambda s: s[value]).alias(name))


def contrast_axes(df: DataFrame, label: str, vector: str, unit: bool = True) -> DataFrame:
    """(label, axis): each label's mean less the mean of the other labels' means, of length 1 unless ``unit`` is off."""
    m = component_means(df, label, vector)
    w = Window.partitionBy("i")
    cells = m.withColumn("c", F.col("m") - (F.sum("m").over(w) - F.col("m")) / F.nullif(F.count("*").over(w) - 1, F.lit(0)))
    out = _assembled(cells, [label], "c", "axis")
    norm = F.sqrt(dot(F.col("axis"), F.col("axis")))
    return out.withColumn("axis", F.when(norm > 0, F.transform("axis", lambda x: x / norm)).otherwise(F.col("axis"))) if unit else out


def global_axes(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, axis): each label's mean less the mean of all rows."""
    m = component_means(df, label, vector)
    w = Window.partitionBy("i")
    return _assembled(m.withColumn("c", F.col("m") - F.sum(F.col("m") * F.col("n")).over(w) / F.sum("n").over(w)), [label], "c", "axis")


def first_component(df: DataFrame, row: str, vector: str) -> tuple[list[float], float, DataFrame]:
    """(axis, its share of the variance, (row, coordinate, norm)): the first principal component."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(vector).isNotNull()).withColumn("__v", array_to_vector(F.col(vector)))
    model = PCA(k=1, inputCol="__v", outputCol="__p").fit(rows)
    axis = [float(x) for x in model.pc.toArray()[:, 0]]
    ref = F.array(*map(F.lit, axis))
    return axis, float(model.explainedVariance[0]), df.select(row, dot(F.col(vector), ref).alias("coordinate"), F.sqrt(dot(F.col(vector), F.col(vector))).alias("norm"))


def without_axis(vector: Column, axis: Column) -> Column:
    """The vector less its part along an axis of length 1."""
    d = dot(vector, axis)
    return F.zip_with(vector, axis, lambda x, a: x.cast("double") - d * a)


def at_coordinate(vector: Column, axis: Column, value: Column) -> Column:
    """The vector moved along an axis of length 1 until its coordinate is ``value``."""
    d = dot(vector, axis)
    return F.zip_with(vector, axis, lambda x, a: x.cast("double") + (value - d) * a)


def coordinates(df: DataFrame, row: str, label: str, vector: str, axes: DataFrame) -> DataFrame:
    """(row, label, axis_label, coordinate, z): every row along every label's axis, z over all rows of the axis.

    ``axes`` has one row a label; it is packed into one array, bounded by labels times components, that every row unfolds.
    """
    packed = axes.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("axis_label"), "axis")))).scalar()
    both = df.where(F.col(vector).isNotNull()).withColumn("__axes", packed).select(row, label, vector, F.explode("__axes").alias("x"))
    out = both.select(row, label, "x.axis_label", dot(F.col(vector), F.col("x.axis")).alias("coordinate"))
    stats = out.groupBy("axis_label").agg(F.avg("coordinate").alias("__m"), F.stddev_pop("coordinate").alias("__s"))
    return out.join(stats, "axis_label").select(row, label, "axis_label", "coordinate", F.when(F.col("__s") > 0, (F.col("coordinate") - F.col("__m")) / F.col("__s")).alias("z"))


def split_half(df: DataFrame, row: str, label: str, vector: str) -> DataFrame:
    """(label, stability): cosine of the axes of two halves of the rows, by MD5 of the row."""
    half = F.pmod(F.conv(F.substring(F.md5(F.encode(F.col(row).cast("string"), "utf-8")), 1, 4), 16, 10).cast("int"), F.lit(2))
    a = contrast_axes(df.where(half == 0), label, vector).withColumnRenamed("axis", "a")
    b = contrast_axes(df.where(half == 1), label, vector).withColumnRenamed("axis", "b")
    return a.join(b, label).select(label, cosine(F.col("a"), F.col("b")).alias("stability"))


def held_out_auc(df: DataFrame, row: str, label: str, vector: str) -> DataFrame:
    """(label, auc): axes from one half of the rows, how well they tell their label apart in the other."""
    from strandloom.operators.ranking import auc

    half = F.pmod(F.conv(F.substring(F.md5(F.encode(F.col(row).cast("string"), "utf-8")), 1, 4), 16, 10).cast("int"), F.lit(2))
    axes = contrast_axes(df.where(half == 0), label, vector)
    c = coordinates(df.where(half == 1), row, label, vector, axes)
    return auc(c.withColumn("own", F.col(label) == F.col("axis_label")), "coordinate", "own", ["axis_label"]).select(F.col("axis_label").alias(label), "auc")


def null_band(df: DataFrame, row: str, label: str, vector: str, rounds: int) -> DataFrame:
    """(round, stability): mean split-half stability when labels are dealt out anew in each round; their mean and 95th
    percentile are the band that a real axis must exceed."""
    from strandloom.runtime import rank_by_md5

    out = None
    base = rank_by_md5(df.select(row, vector), [], row, "__n", "rows")
    for k in range(rounds):
        labels = rank_by_md5(df.select(F.col(row).alias("__o"), label), [], "__o", "__n", f"labels-{k}").select("__n", label)
        one = split_half(base.join(labels, "__n"), row, label, vector).agg(F.avg("stability").alias("stability")).withColumn("round", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.select("round", "stability")


def band(rounds: DataFrame) -> DataFrame:
    """One row: mean and 95th percentile of the stability of the rounds of ``null_band``, and how many there were."""
    return rounds.agg(F.avg("stability").alias("mean"), F.percentile("stability", 0.95).alias("p95"), F.count("*").alias("rounds"))


def admissible(df: DataFrame, row: str, label: str, vector: str, rounds: int, least_auc: float = 0.6) -> DataFrame:
    """(label, stability, auc, limit, admissible): whether an axis is stabler than the 95th percentile of dealt labels and tells
    its label apart in held-out rows."""
    limit = band(null_band(df, row, label, vector, rounds)).select("p95").scalar()
    both = split_half(df, row, label, vector).join(held_out_auc(df, row, label, vector), label).withColumn("limit", limit)
    return both.withColumn("admissible", F.coalesce((F.col("stability") > F.col("limit")) & (F.col("auc") >= least_auc), F.lit(False)))


def without_first_component(df: DataFrame, row: str, vector: str, name: str = "kept") -> DataFrame:
    """``df`` with every vector less its part along the first principal component; null vectors stay null."""
    axis, _, _ = first_component(df, row, vector)
    return df.withColumn(name, without_axis(F.col(vector), F.array(*map(F.lit, axis))))


def logit_direction(coefficients: Column, deviations: Column) -> Column:
    """A direction fitted on standardised vectors, in raw space: coefficients over standard deviations (0 where there is none)."""
    return F.zip_with(coefficients, deviations, lambda c, s: F.when(s > 0, c / s).otherwise(0.0))
