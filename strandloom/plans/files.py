"""Queries that write whole test tables with a sink, read them back with a source and compare with the table itself."""

from __future__ import annotations

import io
import json
import os
import re
import tarfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import vectors
from strandloom.plans.catalogue import query, table
from strandloom.runtime import scratch
from strandloom.sources import genbank, sinks, text


def _digest(c: str):
    return F.md5(F.encode(F.col(c), "utf-8"))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(re.sub("^file:", "", path)))


def _written(df: DataFrame, path: str, suffix: str, body) -> None:
    """One file a partition of ``df``, made by ``body`` from its rows; empty partitions make none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if rows:
            store, at = _store(path)
            store.create_dir(at)
            name = re.sub(r"\W", "", str(min(next(iter(r.values())) for r in rows)))
            with store.open_output_stream(f"{at}/{name}{suffix}", compression=None) as f:
                f.write(body(rows))
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])

    df.mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


@query("SELECT row_id, accession, region_number, contig_edge, antismash_products, region_len, md5(sequence) AS digest FROM core_records")
def src1_snk1_jsonl(spark, d):
    path = scratch(spark)
    sinks.write_jsonl(table(spark, d, "core_records"), path)
    return text.read_jsonl(spark, path, "row_id bigint, " + text.CORE_RECORD).select("row_id", "accession", "region_number", "contig_edge", "antismash_products", "region_len", _digest("sequence").alias("digest"))


@query("SELECT count(*) AS lines, count(*) FILTER (row_id % 7 = 0) AS malformed, count(*) FILTER (row_id % 7 <> 0) AS kept FROM core_records")
def src2_tolerant_jsonl(spark, d):
    path = scratch(spark)
    line = F.to_json(F.struct("row_id", "accession", "region_len"))
    table(spark, d, "core_records").select(F.when(F.col("row_id") % 7 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    rows, report = text.read_jsonl_tolerant(spark, path, "row_id bigint, accession string, region_len bigint")
    return report.withColumn("kept", rows.agg(F.count("*")).scalar())


@query("SELECT record_id, length(sequence) AS n FROM mibig_records WHERE length(sequence) > 0")
def src3_sequences(spark, d):
    path = scratch(spark)
    sinks.write_jsonl(table(spark, d, "mibig_records").select("record_id", "sequence"), path)
    return text.read_sequences(spark, path, "record_id bigint, sequence string").select("record_id", F.length("sequence").cast("bigint").alias("n"))


@query("SELECT record_id, 'all' AS label, md5(regexp_replace(sequence, '\\s', '', 'g')) AS digest FROM mibig_records WHERE sequence IS NOT NULL")
def src4_src5_snk3_snk4_fasta(spark, d):
    path = scratch(spark)
    rows = table(spark, d, "mibig_records").where("sequence is not null")
    sinks.write_fasta(rows, path, F.col("record_id").cast("string"), F.col("sequence"), {"source": F.col("source")})
    return text.read_fasta(spark, path, "all").select(F.col("id").cast("bigint").alias("record_id"), "label", _digest("sequence").alias("digest"))


def _flat_files(spark, d) -> DataFrame:
    """(record_id, value): one GenBank record of every sequence, its genes as features."""
    genes = table(spark, d, "domain_annotations").where("genes is not null").groupBy("record_id").agg(F.max("genes").alias("genes"))
    rows = table(spark, d, "mibig_records").where("sequence is not null").select("record_id", "sequence").join(genes, "record_id", "left")
    place = lambda g: F.concat((g["s"] + 1).cast("string"), F.lit(".."), g["e"].cast("string"))
    line = lambda g: F.concat(F.lit("     CDS             "), F.when(g["strand"] < 0, F.concat(F.lit("complement("), place(g), F.lit(")"))).otherwise(place(g)), F.lit('\n                     /gene="g"\n'))
    features = F.array_join(F.transform(F.coalesce("genes", F.array().cast("array<struct<s:int,e:int,strand:int>>")), line), "")
    name = F.concat(F.lit("R"), F.col("record_id").cast("string"))
    value = F.concat(F.lit("LOCUS       "), name, F.lit("\nACCESSION   "), name, F.lit("\nFEATURES             Location/Qualifiers\n"), features, F.lit("ORIGIN\n        1 "), F.lower("sequence"), F.lit("\n//\n"))
    return rows.select("record_id", value.alias("value"))


_LETTERS = "SELECT record_id, md5(upper(regexp_replace(sequence, '[^A-Za-z]', '', 'g'))) AS digest FROM mibig_records WHERE sequence IS NOT NULL"


@query(_LETTERS)
def src7_src8_genbank_files(spark, d):
    path = scratch(spark)
    _flat_files(spark, d).select(F.rtrim(F.regexp_replace("value", "\n$", "")).alias("value")).write.text(path)
    return genbank.read_genbank(spark, path).select(F.substring("accession", 2, 20).cast("bigint").alias("record_id"), _digest("sequence").alias("digest"))


@query("""WITH a AS (SELECT record_id, max(genes) AS genes FROM domain_annotations WHERE genes IS NOT NULL GROUP BY 1), g AS (SELECT record_id, unnest(genes) AS g FROM a WHERE record_id IN (SELECT record_id FROM mibig_records WHERE sequence IS NOT NULL))
    SELECT record_id, count(*) AS genes, sum(g.s) AS s, sum(g.e) AS e, count(*) FILTER (g.strand < 0) AS turned FROM g GROUP BY 1""")
def src7_features(spark, d):
    path = scratch(spark)
    _flat_files(spark, d).select(F.rtrim(F.regexp_replace("value", "\n$", "")).alias("value")).write.text(path)
    found = genbank.features(genbank.read_genbank(spark, path)).where("kind = 'CDS'")
    return found.groupBy(F.substring("accession", 2, 20).cast("bigint").alias("record_id")).agg(F.count("*").alias("genes"), F.sum("s").alias("s"), F.sum("e").alias("e"), F.count_if(F.col("strand") < 0).alias("turned"))


def _tarred(rows: list[dict]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for r in rows:
            data = r["value"].encode()
            entry = tarfile.TarInfo(f"{r['record_id']}.gbk")
            entry.size = len(data)
            tar.addfile(entry, io.BytesIO(data))
    return out.getvalue()


@query(_LETTERS)
def src6_archives(spark, d):
    path = scratch(spark)
    _written(_flat_files(spark, d).repartition(8, "record_id"), path, ".tar.gz", _tarred)
    return genbank.read_archives(spark, path).select(F.regexp_extract("member", r"(\d+)\.gbk$", 1).cast("bigint").alias("record_id"), _digest("sequence").alias("digest"))


@query("""SELECT record_id, compound_class, length(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) AS n FROM mibig_records
    WHERE compound_class IS NOT NULL AND compound_token IS NOT NULL AND length(regexp_replace(sequence, '[^A-Za-z]', '', 'g')) >= 30""")
def src9_records_with_files(spark, d):
    path, files = scratch(spark), scratch(spark)
    name = F.concat(F.lit("R"), F.col("record_id").cast("string"))
    kinds = F.struct(F.array(F.struct(F.col("compound_class").alias("class"))).alias("classes"))
    docs = table(spark, d, "mibig_records").select(name.alias("accession"), kinds.alias("biosynthesis"), F.array(F.struct(F.col("compound_token").alias("name"))).alias("compounds"))
    _written(docs.repartition(8, "accession"), path, ".json", lambda rows: json.dumps(rows).encode())
    _flat_files(spark, d).select(F.rtrim(F.regexp_replace("value", "\n$", "")).alias("value")).write.text(files)
    found = text.read_records_with_files(spark, path, genbank.read_genbank(spark, files))
    return found.select(F.substring("accession", 2, 20).cast("bigint").alias("record_id"), "compound_class", F.length("sequence").cast("bigint").alias("n"))


@query("SELECT DISTINCT taxid, trim(tax_rank) AS tax_rank, trim(name) AS name FROM taxa_nodes WHERE taxid IS NOT NULL")
def src10_lineage_map(spark, d):
    path = scratch(spark)
    rows = table(spark, d, "taxa_nodes").where("taxid is not null").groupBy("taxid").agg(F.min(F.trim("tax_rank")).alias("r"), F.min(F.trim("name")).alias("n"))
    entry = F.struct(F.col("taxid").cast("string").alias("k"), F.map_from_arrays(F.array("r"), F.array("n")).alias("v"))
    doc = F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("mappings"), F.create_map(F.lit("9"), F.lit("10")).alias("deprecated_ids")))
    rows.agg(doc.alias("value")).coalesce(1).write.option("compression", "gzip").text(path)
    lineages, _ = text.read_lineage_map(spark, path)
    return lineages.select(F.col("taxid").cast("int").alias("taxid"), F.explode("lineage").alias("tax_rank", "name"))


@query("SELECT taxid, min(parent) AS parent, min(trim(tax_rank)) AS tax_rank, min(trim(name)) AS name FROM taxa_nodes WHERE taxid IS NOT NULL GROUP BY 1")
def src11_taxonomy_dump(spark, d):
    nodes, name_path = scratch(spark), scratch(spark)
    rows = table(spark, d, "taxa_nodes").where("taxid is not null")
    line = lambda *c: F.concat(F.array_join(F.array(*[x.cast("string") for x in c]), "\t|\t", ""), F.lit("\t|")).alias("value")
    rows.select(line(F.col("taxid"), F.col("parent"), F.col("tax_rank"))).write.text(nodes)
    both = rows.select(line(F.col("taxid"), F.col("name"), F.lit(""), F.lit("scientific name"))).union(rows.select(line(F.col("taxid"), F.lit("A wrong name"), F.lit(""), F.lit("synonym"))))
    both.write.text(name_path)
    found = text.read_taxonomy(spark, nodes, name_path)
    return found.groupBy("taxid").agg(F.min("parent").alias("parent"), F.min("tax_rank").alias("tax_rank"), F.min("name").alias("name"))


@query("SELECT DISTINCT lower(trim(product)) AS product, compound_class FROM class_map WHERE product IS NOT NULL AND compound_class IS NOT NULL")
def src12_class_map(spark, d):
    path = scratch(spark)
    rows = table(spark, d, "class_map").where("product is not null and compound_class is not null")
    os.makedirs(os.path.dirname(re.sub("^file:(//)?", "", path)), exist_ok=True)
    sinks.publish_text("# classes\n" + "".join(f"{r['product']}: {r['compound_class']}\n" for r in rows.toLocalIterator()), re.sub("^file:(//)?", "", path))
    return text.read_class_map(spark, re.sub("^file:(//)?", "", path)).distinct()


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderdate) AS first_date FROM orders GROUP BY 1")
def src13_src14_delimited(spark, d):
    path = scratch(spark)
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    rows.write.option("sep", "\t").option("header", True).csv(path)
    back = text.read_table(spark, path, rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    return back.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderdate").alias("first_date"))


@query("SELECT DISTINCT CAST(record_id AS VARCHAR) AS query FROM domain_hits WHERE record_id IS NOT NULL")
def src15_hits(spark, d):
    path = scratch(spark)
    table(spark, d, "domain_hits").select("record_id", "acc", "bit_score").write.option("sep", "\t").csv(path)
    return text.read_hits(spark, path)


@query("SELECT DISTINCT regexp_replace(trim(product), '\\s+', '_', 'g') AS product, compound_class AS category FROM class_map WHERE product IS NOT NULL AND compound_class IS NOT NULL")
def src16_rules(spark, d):
    path = scratch(spark)
    rows = table(spark, d, "class_map").where("product is not null and compound_class is not null").select(F.regexp_replace(F.trim("product"), r"\s+", "_").alias("p"), "compound_class").distinct()
    rows.select(F.concat(F.lit("RULE "), F.col("p"), F.lit("\n    DESCRIPTION of it\n    CATEGORY "), F.col("compound_class"), F.lit("\n    CUTOFF 20\n")).alias("value")).write.text(path)
    return text.read_rules(spark, path)


def _zipped(rows: list[dict]) -> bytes:
    out = io.BytesIO()
    np.savez(out, ids=np.array([r["vec_id"] for r in rows], np.int64), vectors=np.array([r["embedding"] for r in rows], np.float32), model=np.array("m-1"), layer=np.array(7))
    return out.getvalue()


@query("SELECT vec_id, 'm-1' AS model, 7 AS layer, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 4) AS total FROM embeddings")
def src17_vectors(spark, d):
    path = scratch(spark)
    _written(table(spark, d, "embeddings").select("vec_id", "embedding").repartition(8, "vec_id"), path, ".npz", _zipped)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return vectors.read_npz(spark, path).select(F.col("id").alias("vec_id"), "model", "layer", F.size("vector").cast("bigint").alias("n"), F.round(total, 4).alias("total"))


@query("SELECT lower(trim(split)) AS split, count(*) AS n, sum(length(sequence)) AS bases FROM mibig_records GROUP BY 1")
def snk2_routed(spark, d):
    path = scratch(spark)
    sinks.write_routed(table(spark, d, "mibig_records").select("record_id", "sequence", F.lower(F.trim("split")).alias("split")), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length("sequence")).alias("bases"))


@query("SELECT compound_class, count(*) AS n, 20 AS cap FROM mibig_records GROUP BY 1")
def snk5_manifest(spark, d):
    path = re.sub("^file:(//)?", "", scratch(spark))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    counts = table(spark, d, "mibig_records").groupBy("compound_class").agg(F.count("*").alias("n"))
    sinks.write_manifest(counts, path, {"cap": 20})
    doc = spark.read.schema("runs array<struct<parameters: struct<cap: int>, rows: array<struct<compound_class: string, n: bigint>>>>").option("multiLine", True).json(path)
    return doc.select(F.explode("runs").alias("r")).select("r.parameters.cap", F.explode("r.rows").alias("x")).select("x.compound_class", "x.n", "cap")


@query("SELECT n_regionkey AS step, count(*) AS n FROM nation GROUP BY 1")
def snk6_appended_log(spark, d):
    path = scratch(spark)
    nations = table(spark, d, "nation")
    for k in range(5):
        sinks.append_row(nations.where(F.col("n_regionkey") == k).groupBy(F.col("n_regionkey").alias("step")).agg(F.count("*").alias("n")), path)
    return text.read_jsonl(spark, path, "step int, n bigint").select(F.col("step").cast("bigint").alias("step"), "n")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 5")
def snk7_published(spark, d):
    path = scratch(spark)
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    sinks.publish_table(nations, path)
    sinks.publish_table(nations.where("n_nationkey >= 5"), path)
    return spark.read.parquet(path)


@query("SELECT DISTINCT CAST(accession AS VARCHAR) AS value FROM mibig_records WHERE accession IS NOT NULL")
def snk8_id_list(spark, d):
    path = scratch(spark)
    sinks.write_ids(table(spark, d, "mibig_records"), "accession", path)
    return spark.read.text(path)


def _one_file(spark, d) -> str:
    path = scratch(spark)
    table(spark, d, "nation").orderBy("n_nationkey").select(F.col("n_name").alias("value")).coalesce(1).write.text(path)
    return f"{path}/*.txt"


@query("SELECT sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS sha256, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS bytes, count(*) AS lines FROM nation")
def snk9_fingerprint(spark, d):
    return sinks.fingerprints(spark, _one_file(spark, d)).drop("path")


@query("SELECT sha256(string_agg(n_name, chr(10) ORDER BY n_nationkey)) AS sha256 FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 10)")
def snk11_head_fingerprint(spark, d):
    return sinks.head_fingerprint(spark, _one_file(spark, d), 10).select("sha256")


@query("SELECT 'path' AS kind, 'tables' AS name, true AS ready UNION ALL SELECT 'path', 'nowhere', false UNION ALL SELECT 'command', 'no-such-command', false")
def snk10_readiness(spark, d):
    found = sinks.readiness(spark, [d, f"{d}/nowhere"], ["no-such-command"])
    return found.withColumn("name", F.when(F.col("name") == d, "tables").when(F.col("name").endswith("/nowhere"), "nowhere").otherwise(F.col("name")))
