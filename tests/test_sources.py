import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from strandloom.functions.frames import open_frames
from strandloom.sources import genbank, sinks, text
from strandloom.streaming import logs

GBK = """LOCUS       AB0001               60 bp    DNA
ACCESSION   AB0001
SOURCE      x
  ORGANISM  Abcella defum QX-1
            Bacteria; Somophyla; Someclassia; Someales;
            Someaceae; Abcella.
FEATURES             Location/Qualifiers
     source          1..60
                     /db_xref="taxon:1234"
     CDS             complement(4..30)
                     /locus_tag="a1"
                     /product="some long
                     name"
     region          1..60
                     /tool="finder"
                     /product="terpene"
                     /product="ripp"
ORIGIN
        1 acgtacgtac gtacgtacgt acgtacgtac
       31 acgtacgtac gtacgtacgt acgtacgtnn
//
"""


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"accession": "x", "sequence": "ACGT", "region_number": 3}\n\n{"accession": "y", "sequence": ""}\n{broken\n')
    rows, report = text.read_jsonl_tolerant(spark, str(p), "accession string, sequence string")
    assert [r["accession"] for r in rows.orderBy("accession").collect()] == ["x", "y"]
    assert tuple(report.first()) == (3, 1)
    assert text.read_sequences(spark, str(p), "accession string, sequence string", limit=5).count() == 1
    assert "region_number" in text.read_jsonl(spark, str(p), text.CORE_RECORD).columns


def test_fasta_round_trip(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">one first kind=x\nACGT\nAC GT\r\n>two\n\n>three\nNNN\n")
    got = {r["id"]: r["sequence"] for r in text.read_fasta(spark, str(p), "C").collect()}
    assert got == {"one": "ACGTACGT", "two": "", "three": "NNN"}
    df = spark.createDataFrame([("a", "A" * 205, None), ("b", "C" * 80, 7)], "id string, seq string, n int")
    sinks.write_fasta(df, str(tmp_path / "out"), F.col("id"), F.col("seq"), {"n": F.col("n")})
    back = {r["id"]: (r["sequence"], r["header"]) for r in text.read_fasta(spark, str(tmp_path / "out")).collect()}
    assert back == {"a": ("A" * 205, "a"), "b": ("C" * 80, "b n=7")}
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert max(map(len, lines)) == 80


def test_genbank(spark, tmp_path):
    p = tmp_path / "a.gbk"
    p.write_text(GBK + GBK.replace("AB0001", "AB0002") + "LOCUS broken\n")
    rows = genbank.read_genbank(spark, str(p)).orderBy("accession").collect()
    assert [r["accession"] for r in rows] == ["AB0001", "AB0002"]
    assert rows[0]["taxon_id"] == 1234 and rows[0]["organism"] == "Abcella defum QX-1" and len(rows[0]["sequence"]) == 60
    assert rows[0]["taxonomic_tag"] == "|D__BACTERIA;P__SOMOPHYLA;C__SOMECLASSIA;O__SOMEALES;F__SOMEACEAE;G__ABCELLA;S__ABCELLA_DEFUM_QX_1|"
    found = {r["kind"]: r for r in genbank.features(genbank.read_genbank(spark, str(p)).where("accession = 'AB0001'")).collect()}
    assert (found["CDS"]["s"], found["CDS"]["e"], found["CDS"]["strand"]) == (3, 30, -1)
    assert found["CDS"]["qualifiers"]["product"] == ["some long name"] and found["region"]["qualifiers"]["product"] == ["terpene", "ripp"]


def test_archives(spark, tmp_path):
    folder = tmp_path / "tars"
    folder.mkdir()
    for name in ("a", "b"):
        with tarfile.open(folder / f"{name}.tar", "w") as tar:
            for i in range(4):
                data = GBK.replace("AB0001", f"{name}{i}").encode()
                member, data = (f"{name}{i}.gbk.gz", gzip.compress(data)) if i % 2 else (f"{name}{i}.gbk", data)
                info = tarfile.TarInfo(member)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
            info = tarfile.TarInfo("readme.txt")
            tar.addfile(info)
    assert {r["accession"] for r in genbank.read_archives(spark, str(folder)).collect()} == {f"{n}{i}" for n in "ab" for i in range(4)}
    assert {r["accession"] for r in genbank.read_archives(spark, str(folder / "a.tar"), after="a1.gbk.gz", limit="1").collect()} == {"a2"}
    whole = (folder / "a.tar").read_bytes()
    (tmp_path / "cut.tar").write_bytes(whole[: len(whole) // 3])
    assert 0 < genbank.read_archives(spark, str(tmp_path / "cut.tar")).count() < 4


def test_tables_and_vocabularies(spark, tmp_path):
    (tmp_path / "hits.tsv").write_text("q1\tr1\t0.9\nq1\tr2\t0.8\nq2\tr1\t0.7\n")
    assert {r["query"] for r in text.read_hits(spark, str(tmp_path / "hits.tsv")).collect()} == {"q1", "q2"}
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tsuperkingdom\t|\n")
    (tmp_path / "names.dmp").write_text("2\t|\tBacteria\t|\t\t|\tscientific name\t|\n2\t|\teubacteria\t|\t\t|\tsynonym\t|\n")
    assert {tuple(r) for r in text.read_taxonomy(spark, str(tmp_path / "nodes.dmp"), str(tmp_path / "names.dmp")).collect()} == {(1, 1, "no rank", None), (2, 1, "superkingdom", "Bacteria")}
    with gzip.open(tmp_path / "taxa.json.gz", "wt") as f:
        json.dump({"mappings": {"7": {"genus": "Abcella"}}, "deprecated_ids": {"6": "7"}}, f)
    lineages, redirects = text.read_lineage_map(spark, str(tmp_path / "taxa.json.gz"))
    assert lineages.first()["lineage"] == {"genus": "Abcella"} and tuple(redirects.first()) == ("6", "7")
    (tmp_path / "map.yaml").write_text("classes:\n  # comment\n  Terpene : TERPENE\n  'acyl-HSL': HSERLACTONE  # note\n")
    assert {tuple(r) for r in text.read_class_map(spark, str(tmp_path / "map.yaml")).collect()} == {("terpene", "TERPENE"), ("acyl-hsl", "HSERLACTONE")}
    (tmp_path / "rules.txt").write_text("RULE terp\n    CATEGORY terpene\n    CONDITIONS x\nRULE lanthi\n  DESCRIPTION y\n  CATEGORY RiPP\n")
    assert {tuple(r) for r in text.read_rules(spark, str(tmp_path / "rules.txt")).collect()} == {("terp", "terpene"), ("lanthi", "RiPP")}
    (tmp_path / "t.tsv").write_text("arm\tn\nx\t3\n")
    assert text.read_table(spark, str(tmp_path / "t.tsv"), "arm string, n int").first()["n"] == 3
    meta = tmp_path / "meta"
    meta.mkdir()
    for i, (c, name) in enumerate([("PKS", "a"), (None, "b"), ("NRPS", None), ("RIPP", "d")]):
        (meta / f"{i}.json").write_text(json.dumps({"accession": f"A{i}", "biosynthesis": {"classes": [{"class": c}] if c else []}, "compounds": [{"name": name}] if name else []}))
    files = spark.createDataFrame([("A0", "ACGT" * 10), ("A3", "ACGT")], "accession string, sequence string")
    assert [r["accession"] for r in text.read_records_with_files(spark, str(meta), files).collect()] == ["A0"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", "é"), (2, "val", None), (3, "train", "x")], "id int, split string, t string")
    sinks.write_routed(df, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).where("split = 'train'").count() == 2
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert any("é" in r["value"] for r in spark.read.text(str(tmp_path / "j")).collect())
    assert len(sinks.write_manifest(df.groupBy("split").count(), str(tmp_path / "m.json"), {"a": 1})["runs"]) == 1
    assert len(sinks.write_manifest(df.groupBy("split").count(), str(tmp_path / "m.json"), {"a": 2})["runs"]) == 2
    sinks.publish_table(df, str(tmp_path / "p"))
    sinks.publish_table(df.limit(1), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    sinks.append_row(df.limit(1), str(tmp_path / "log"))
    sinks.append_row(df.limit(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.write_ids(df, "t", str(tmp_path / "ids"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "ids")).collect()) == ["x", "é"]
    (tmp_path / "f.txt").write_text("a\nb\n")
    before = spark.createDataFrame(sinks.fingerprints(spark, str(tmp_path / "f.txt")).collect())
    assert before.first()["lines"] == 2 and before.first()["bytes"] == 4
    (tmp_path / "f.txt").write_text("a\nc\n")
    assert sinks.changed_files(before, sinks.fingerprints(spark, str(tmp_path / "f.txt"))).first()["change"] == "changed"
    assert len(sinks.head_fingerprint(spark, str(tmp_path / "f.txt")).first()["sha256"]) == 64
    assert {(r["name"], r["ready"]) for r in sinks.readiness(spark, [str(tmp_path), "/none"], ["sh", "no-such-command"]).collect()} == {(str(tmp_path), True), ("/none", False), ("sh", True), ("no-such-command", False)}


def test_open_frames(spark):
    gene = "ATG" + "GCT" * 60 + "TAA"
    turned = gene[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [(1, "CC" + gene + "CCCC"), (2, "C" + turned + "GG"), (3, None), (4, ""), (5, "ATGTAA")]
    got = [(r["id"], r["s"], r["e"], r["strand"], r["aa"]) for r in open_frames(spark.createDataFrame(rows, "id bigint, s string"), "id", "s").collect()]
    assert sorted(got) == [(1, 2, 188, 1, 61), (2, 1, 187, -1, 61)]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"run": "r", "step": i, "loss": x, "ts": f"2024-01-01T00:{i:02d}:00"}) for i, x in enumerate([1.0, 0.9, 0.85, 0.85, 0.85, 0.85, 0.84])) + "\n{bad\n")
    stream = logs.log_stream(spark, str(src), "run string, step bigint, loss double, ts timestamp")
    q = logs.early_stops(stream, "run", "step", "loss", 3, 0.001).writeStream.format("memory").queryName("stops").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("stops").collect()] == [("r", 5)]
    q = logs.windowed_means(stream, "ts", "run", "loss", "5 minutes").writeStream.format("memory").queryName("means").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("means").collect()) == [2, 5]


def test_shipped_package_has_all_modules(tmp_path):
    import __spark_entry__ as entry

    assert len(entry.queries()) > 100 and set(entry.oracle_sql()) <= set(entry.queries())
    with pytest.raises(ValueError):
        from strandloom.operators.vectors import load_vectors

        load_vectors(None, "x", {})
