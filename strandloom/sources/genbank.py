"""GenBank flat files from folders, and tar archives of them through a Python data source.

A record ends with ``//``; text readers cut there, so a file of many records is parsed in parallel. Archives are read
member by member, one partition an archive; an archive that breaks off gives the members before the break.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import os
import tarfile
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandloom.functions import names


def parsed(text: Column) -> dict[str, Column]:
    """Columns of one flat-file record: accession, organism, taxon id, lineage tag, features text, sequence."""
    origin = F.regexp_extract(text, r"(?ms)^ORIGIN[^\n]*\n(.*)", 1)
    return {
        "accession": F.coalesce(F.nullif(F.regexp_extract(text, r"(?m)^ACCESSION\s+(\S+)", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"(?m)^LOCUS\s+(\S+)", 1), F.lit(""))),
        "organism": names.organism(text),
        "taxon_id": names.taxon_id(text),
        "taxonomic_tag": names.positional_tag(text),
        "features": F.regexp_extract(text, r"(?ms)^FEATURES[^\n]*\n(.*?)^(?:ORIGIN|CONTIG|BASE)", 1),
        "sequence": F.upper(F.regexp_replace(F.substring_index(origin, "//", 1), r"[^A-Za-z]", "")),
    }


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """(accession, organism, taxon_id, taxonomic_tag, features, sequence): one row per record; broken records are left out."""
    parts = spark.read.option("lineSep", "\n//").text(path)
    cols = parsed(F.col("value"))
    rows = parts.where(F.col("value").contains("LOCUS") & F.col("value").contains("ORIGIN"))
    return rows.select(*[c.alias(n) for n, c in cols.items()]).where("accession is not null")


def features(df: DataFrame, row: str = "accession") -> DataFrame:
    """(row, kind, s, e, strand, qualifiers): features of parsed records, half open and 0-based; joins span first to last part.

    qualifiers: map name -> array of values.
    """
    blocks = F.regexp_extract_all("features", F.lit(r"(?m)^ {5}\S[^\n]*(?:\n {10,}[^\n]*)*"), F.lit(0))
    one = df.select(row, F.explode(blocks).alias("b"))
    place = F.regexp_replace(F.regexp_extract("b", r"^ {5}\S+\s+((?:[^/\n]+\n?\s*)*)", 1), r"\s+", "")
    numbers = F.transform(F.regexp_extract_all(place, F.lit(r"[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    quals = F.regexp_extract_all("b", F.lit(r'/(\w+="(?:[^"]|"")*"|\w+=[^\s"]+)'), F.lit(1))
    pairs = F.transform(quals, lambda q: F.struct(F.substring_index(q, "=", 1).alias("k"), F.regexp_replace(F.regexp_replace(F.substring(q, F.length(F.substring_index(q, "=", 1)) + 2, F.length(q)), '^"|"$', ""), r"\s+", " ").alias("v")))
    by_name = F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda p: p["k"])), lambda k: F.struct(k.alias("k"), F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]).alias("v"))))
    rows = one.select(row, F.regexp_extract("b", r"^ {5}(\S+)", 1).alias("kind"), (F.array_min(numbers) - 1).alias("s"), F.array_max(numbers).alias("e"), F.when(place.contains("complement"), -1).otherwise(1).alias("strand"), by_name.alias("qualifiers"))
    return rows.where("e is not null")


def _archives(path: str) -> list[str]:
    """Addresses of the archives of a file, a pattern in the last part of a path, or a folder, on the file system it names."""
    whole = path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:"))
    scheme, rest = whole.split("://", 1)
    base, last = os.path.split(rest)
    pattern = any(c in last for c in "*?[")
    store, at = fs.FileSystem.from_uri(f"{scheme}://{base if pattern else rest}")
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [whole]
    if info.type == fs.FileType.NotFound:
        return []
    inside = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File)
    folder = base if pattern else rest.rstrip("/")
    return [f"{scheme}://{folder}/{x}" for x in inside if fnmatch.fnmatch(x, last if pattern else "*.tar*")]


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [_Archive(p) for p in _archives(self.options["path"])]

    def read(self, partition) -> Iterator[tuple]:
        suffixes = tuple(self.options.get("suffixes", ".gbk,.gbk.gz,.gb").split(","))
        after, limit = self.options.get("after"), int(self.options.get("limit", -1))
        waiting, n = after is not None, 0
        try:
            store, at = fs.FileSystem.from_uri(partition.path)
            with store.open_input_stream(at, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
                for member in tar:
                    if waiting:
                        waiting = member.name != after
                        continue
                    if not member.isfile() or not member.name.endswith(suffixes):
                        continue
                    if n == limit:
                        return
                    data = tar.extractfile(member).read()
                    try:
                        text = (gzip.decompress(data) if member.name.endswith(".gz") else data).decode("utf-8", "replace")
                    except (OSError, EOFError):
                        text = None
                    n += 1
                    yield partition.path, member.name, text
        except (tarfile.ReadError, EOFError, OSError, io.UnsupportedOperation):
            return


class GenBankArchive(DataSource):
    """``spark.read.format("genbank_tar")``: (archive, member, text) of the members of tar archives.

    Options: path (file, pattern or folder), suffixes, after (resume behind this member), limit (members per archive).
    Members that cannot be unpacked have a null text; a truncated archive ends early without an error.
    """

    @classmethod
    def name(cls) -> str:
        return "genbank_tar"

    def schema(self) -> str:
        return "archive string, member string, text string"

    def reader(self, schema):
        return _ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Parsed records of tar archives with their archive and member; members without text have no rows."""
    spark.dataSource.register(GenBankArchive)
    members = spark.read.format("genbank_tar").options(path=path, **options).load()
    records = members.where("text is not null").select("archive", "member", F.explode(F.split("text", r"(?m)^//\s*$")).alias("value"))
    good = records.where(F.col("value").contains("LOCUS") & F.col("value").contains("ORIGIN"))
    return good.select("archive", "member", *[c.alias(n) for n, c in parsed(F.col("value")).items()])
