"""Session-level helpers: durable intermediate tables, sorted Arrow groups, skew-proof joins and ranks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIRS: list[str] = []
_OWN_TABLES: list[tuple[SparkSession, str]] = []


def _remove_own() -> None:
    for spark, path in _OWN_TABLES:
        try:
            _delete(spark, path)
        except Exception:  # the session or its store is gone
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
    for path in _OWN_DIRS:
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_remove_own)


def _delete(spark: SparkSession, path: str) -> None:
    """Removes a folder through the file system of its own scheme, wherever the store is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Removes the tables that ``materialize`` wrote for this application; frames that read them cannot be used any more."""
    for _, path in _OWN_TABLES:
        _delete(spark, path)
    _OWN_TABLES.clear()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session's cluster, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_strandloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="strandloom-"), "strandloom.zip")
    _OWN_DIRS.append(os.path.dirname(out))
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("strandloom", os.path.relpath(path, root)))
    sc.addPyFile(out)
    sc._strandloom_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query``, sure that the workers can import this package."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where the setting is absent a temporary folder is made in local mode only, where driver and executors are one process;
    on a cluster it is an error.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="strandloom-")
        _OWN_DIRS.append(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder for files of this application, removed with its tables."""
    path = f"{shared_dir(spark).rstrip('/')}/strandloom/{uuid.uuid4().hex}"
    _OWN_TABLES.append((spark, path))
    return path


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    Cuts the lineage like a reliable checkpoint, survives lost executors, and keeps column pruning for the reader.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def task_slots(spark: SparkSession) -> int:
    """Partitions to aim for when a stage's work is in CPU rather than bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def partitions_for(df: DataFrame, target: int = 64 << 20) -> int:
    """Partitions for a shuffle of ``df``: one a slot, more where the planner's estimate of its bytes asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(task_slots(df.sparkSession), min(-(-size // target), 1 << 20))


def by_bucket(df: DataFrame, buckets: int, bucket: str = "bucket", most: int = 1 << 20) -> DataFrame:
    """``df`` with each bucket, numbered from 0, in a partition of its own; beyond ``most`` several share one, in order."""
    placed = df.repartitionById(min(buckets, most), bucket)
    return placed if buckets <= most else placed.sortWithinPartitions(bucket)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work whose cost lies in CPU rather than bytes.

    A table of few files or row groups otherwise runs on few cores. Tables with enough partitions are left as they are,
    and so are plans with shuffles, whose partitions are only known when they run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().executedPlan().nodeName().startswith("AdaptiveSparkPlan"):
        return df
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def sorted_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    schema: str,
    fn: Callable[[pa.Table], Iterable[pa.RecordBatch]],
    partitions: int | None = None,
    most: int | None = None,
    large: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]] | None = None,
) -> DataFrame:
    """Runs ``fn`` on Arrow tables that hold whole groups of ``keys`` (many groups per call), each sorted by ``order``.

    Unlike a grouped map it makes one Python call per batch rather than per group, so millions of small groups stay cheap.
    Partitions grow with the bytes that arrive, unless ``partitions`` are given. A group of over ``most`` rows is never held: its rows stream through ``large`` batch by batch, which typically hands
    them on to a distributed path. Which groups are large depends on the data alone, up to one Arrow batch.
    """
    spread = df.repartition(partitions or partitions_for(df), *keys)
    spread = spread.sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        streaming = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if streaming is not None:
                lo, hi = 0, batch.num_rows
                while lo < hi:
                    mid = (lo + hi) // 2
                    if [batch.column(k)[mid].as_py() for k in keys] == streaming:
                        lo = mid + 1
                    else:
                        hi = mid
                if lo:
                    yield from large(batch.slice(0, lo))
                if lo == batch.num_rows:
                    continue
                batch, streaming = batch.slice(lo), None
            if held:
                last, first = held[-1], batch
                same = 0
                tail = [last.column(k)[last.num_rows - 1].as_py() for k in keys]
                head = [first.column(k)[0].as_py() for k in keys]
                if tail == head:
                    final = [first.column(k)[first.num_rows - 1].as_py() for k in keys]
                    if final == tail:
                        held.append(batch)
                        if most is not None and sum(b.num_rows for b in held) > most:
                            for b in held:
                                yield from large(b)
                            held, streaming = [], tail
                        continue
                    lo, hi = 0, first.num_rows - 1
                    while lo < hi:
                        mid = (lo + hi) // 2
                        if [first.column(k)[mid].as_py() for k in keys] == tail:
                            lo = mid + 1
                        else:
                            hi = mid
                    same = lo
                    held.append(batch.slice(0, same))
                yield from fn(pa.Table.from_batches(held))
                held = []
                batch = batch.slice(same)
            last_key = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
            lo, hi = 0, batch.num_rows - 1
            while lo < hi:
                mid = (lo + hi) // 2
                if [batch.column(k)[mid].as_py() for k in keys] == last_key:
                    hi = mid
                else:
                    # rows are sorted, so all rows up to mid belong to earlier groups
                    lo = mid + 1
            if lo:
                yield from fn(pa.Table.from_batches([batch.slice(0, lo)]))
            held = [batch.slice(lo)]
            if most is not None and held[0].num_rows > most:
                yield from large(held[0])
                held, streaming = [], last_key
        if held:
            yield from fn(pa.Table.from_batches(held))

    return spread.mapInArrow(run, schema)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = 8) -> DataFrame:
    """Equi-join for a ``left`` whose keys may be very skewed and a ``right`` with few rows per key.

    Rows of ``left`` are spread over ``salts`` sub-keys by a hash of the whole row and ``right`` is repeated per
    sub-key, so no task gets all rows of a hot key.
    """
    hashable = [c for c, t in left.dtypes if not t.startswith(("map", "variant"))]
    a = left.withColumn("__salt", F.pmod(F.xxhash64(*hashable), F.lit(salts)))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return a.join(b, [*on, "__salt"], how).drop("__salt")


def rank_by_hash(df: DataFrame, groups: list[str], key: str, name: str = "rank", buckets: int = 1024, seed: int = 0) -> DataFrame:
    """Exact 1-based rank of each row within ``groups`` in the order of a seeded hash of ``key`` (ties by ``key``).

    The hash range is cut into ``buckets``; rows are only sorted within (group, bucket), and a small table of bucket
    sizes gives each bucket its offset. A group that holds a third of all rows is thus ranked by many tasks.
    Null keys rank by the hash of null. Requires ``key`` unique within a group for a total order.
    """
    hashed = df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key)))
    hashed = hashed.withColumn("__b", F.pmod(F.col("__h"), F.lit(buckets)))
    return _ranked(hashed, df.columns, groups, ["__h", key], name)


def rank_by_md5(df: DataFrame, groups: list[str], key: str, name: str = "rank", seed: str = "0") -> DataFrame:
    """Exact 1-based rank of each row within ``groups`` in the order of md5(``seed|key``), ties by ``key``.

    The same order in every engine with MD5. Ranks come from 4,096 buckets of the digest, as in ``rank_by_hash``, so a
    hot group is ranked by many tasks. Group values may be null; ``key`` must be unique within a group.
    """
    hashed = df.withColumn("__h", F.md5(F.encode(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))), "utf-8")))
    return _ranked(hashed.withColumn("__b", F.substring("__h", 1, 3)), df.columns, groups, ["__h", key], name)


def rank_by_value(df: DataFrame, key: str, width: int, name: str = "rank") -> DataFrame:
    """Exact 1-based rank of each row by a unique integer ``key``, from buckets of ``width`` consecutive values."""
    return _ranked(df.withColumn("__b", F.floor(F.col(key) / width)), df.columns, [], [key], name)


def _ranked(hashed: DataFrame, columns: list[str], groups: list[str], order: list[str], name: str) -> DataFrame:
    sizes = hashed.groupBy(*groups, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    ranked = hashed.withColumn("__r", F.row_number().over(Window.partitionBy(*groups, "__b").orderBy(*order)))
    cond = ranked["__b"] == offsets["__b"]
    for g in groups:
        cond = cond & ranked[g].eqNullSafe(offsets[g])
    return ranked.join(offsets, cond).select(*[ranked[c] for c in columns], (ranked["__r"] + offsets["__off"]).alias(name))


def _in_ranges(df: DataFrame, order: str, ranges: int) -> DataFrame:
    """``df`` with the number (__b) of the range of ``order`` each row is in; ranges hold about equal numbers of rows.

    The edges are approximate quantiles, one short array that goes to every task; what they are does not matter for a
    result that adds up offsets.
    """
    value = F.col(order).cast("double")
    edges = df.agg(F.coalesce(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10_000), F.array().cast("array<double>"))).scalar()
    return df.withColumn("__e", edges).withColumn("__b", F.size(F.filter("__e", lambda e: e < value))).drop("__e")


def running_before(df: DataFrame, keys: list[str], order: str, value: str, name: str, ranges: int = 64) -> DataFrame:
    """Adds the sum of ``value`` over the rows of equal ``keys`` (null safe) with a smaller ``order``, a number unique per key.

    Sums run within ranges of ``order`` only and a small table gives each range its offset, so a key with very many rows
    is summed by many tasks; the work of a range that holds one key's rows alone grows with their number over ``ranges``.
    """
    # edges, offsets and sums read the same rows, which are mostly the result of an aggregate
    marked = _in_ranges(materialize(df), order, ranges)
    sums = marked.groupBy(*keys, "__b").agg(F.sum(value).alias("__s"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("__o", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s")
    inside = Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = marked.withColumn("__r", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    cond = summed["__b"] == offsets["__b"]
    for k in keys:
        cond = cond & summed[k].eqNullSafe(offsets[k])
    return summed.join(offsets, cond).select(*[summed[c] for c in df.columns], (summed["__r"] + offsets["__o"]).alias(name))


def rank_by_order(df: DataFrame, order: str, name: str = "rank", ranges: int = 64) -> DataFrame:
    """Exact 1-based rank of each row by a number (ties in any order), from ranges with offsets; nulls come first."""
    return _ranked(_in_ranges(df, order, ranges), df.columns, [], [order], name)
