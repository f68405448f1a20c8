"""Writers: JSON lines, routed splits, FASTA, manifests, id lists, append logs, fingerprints, atomic publication."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.records import fasta_lines


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, other letters unescaped, nulls left out."""
    df.write.mode("overwrite").json(path)


def write_routed(df: DataFrame, path: str, split: str = "split", form: str = "parquet") -> None:
    """Every row to the folder of its split, in one pass."""
    df.write.mode("overwrite").partitionBy(split).format(form).save(path)


def write_fasta(df: DataFrame, path: str, identifier: Column, seq: Column, tags: dict[str, Column] | None = None, width: int = 80) -> None:
    df.select(fasta_lines(identifier, seq, tags, width).alias("value")).write.mode("overwrite").text(path)


def write_manifest(summary: DataFrame, path: str, parameters: dict) -> dict:
    """The rows of a summary (one a class or split, so few) and the parameters as one JSON document; merged into one that exists."""
    new = {"parameters": parameters, "rows": [json.loads(r) for r in summary.toJSON().collect()]}
    runs = []
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            runs = json.load(f)["runs"]
    doc = {"runs": [*runs, new]}
    publish_text(json.dumps(doc, ensure_ascii=False, indent=1), path)
    return doc


def publish_text(text: str, path: str) -> None:
    """Written beside the target and moved onto it, so readers see the old file or the new one."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(part, path)


def publish_table(df: DataFrame, path: str) -> None:
    """A Parquet folder that appears at once: written beside the target, then moved, on whatever file system the path names."""
    jvm = df.sparkSession._jvm.org.apache.hadoop.fs
    part, old, target = (jvm.Path(f"{path}{end}") for end in (f".{uuid.uuid4().hex}.part", f".{uuid.uuid4().hex}.old", ""))
    store = target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    df.write.parquet(part.toString())
    replaced = store.exists(target)
    if replaced:
        store.rename(target, old)
    if not store.rename(part, target):
        raise OSError(f"{part.toString()} could not be moved to {path}")
    if replaced:
        store.delete(old, True)


def append_row(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("append").json(path)


def write_ids(df: DataFrame, column: str, path: str) -> None:
    """Distinct non-null ids, sorted, one a line."""
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().orderBy("value").write.mode("overwrite").text(path)


def _digests(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(path, sha256, bytes, lines) of each file, read in pieces where the tasks are; of its ``first`` lines if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                digest, size, lines = hashlib.sha256(), 0, 0
                with store.open_input_stream(at, compression=None) as f:
                    while piece := f.read(8 << 20):
                        n = piece.count(b"\n")
                        if first is not None and lines + n >= first:
                            piece = b"\n".join(piece.split(b"\n")[: first - lines])
                            digest.update(piece)
                            size, lines = size + len(piece), first
                            break
                        digest.update(piece)
                        size, lines = size + len(piece), lines + n
                rows.append((name, digest.hexdigest(), size, lines))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)] if rows else [], names=["path", "sha256", "bytes", "lines"] if rows else [])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, "path string, sha256 string, bytes bigint, lines bigint")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes, lines) of each file, computed where the files are, whatever their size."""
    return _digests(spark, path)


def head_fingerprint(spark: SparkSession, path: str, lines: int = 100) -> DataFrame:
    """(path, sha256): digest of the first ``lines`` lines of each file without the last line end, an older and weaker form."""
    return _digests(spark, path, lines).select("path", "sha256")


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): files added, removed or with other content between two fingerprint tables."""
    a, b = before.select("path", F.col("sha256").alias("x")), after.select("path", F.col("sha256").alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed")
    return a.join(b, "path", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("path", change.alias("change"))


def readiness(spark: SparkSession, paths: list[str], commands: list[str]) -> DataFrame:
    """(kind, name, ready): whether paths exist and commands can be found, on the driver."""
    rows = [("path", p, os.path.exists(p)) for p in paths] + [("command", c, shutil.which(c) is not None) for c in commands]
    return spark.createDataFrame(rows, "kind string, name string, ready boolean")
