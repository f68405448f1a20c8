"""Running sums by ranges, assertions, check drivers, profiles, stop mass, vectors from archives, files on shared stores."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom import runtime
from strandloom.functions.frames import _frames
from strandloom.operators import aggregates, rules, sampling, vectors
from strandloom.sources import genbank, sinks


def test_running_sums_by_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([0.5, -3.0, 1e9, float(i)]) + i * 1e-3, rng.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, id bigint, v double, n bigint")
    for ranges in (2, 16):
        got = {r["id"]: r["before"] for r in runtime.running_before(df, ["k"], "v", "n", "before", ranges).collect()}
        assert got == {i: sum(m for q, _, w, m in rows if q == k and w < v) for k, i, v, _ in rows}
    ranks = {r["id"]: r["rank"] for r in runtime.rank_by_order(df, "v").collect()}
    assert [i for i, _ in sorted(ranks.items(), key=lambda x: x[1])] == [r[1] for r in sorted(rows, key=lambda r: r[2])]
    assert runtime.running_before(df.limit(0), ["k"], "v", "n", "before").count() == 0


def test_partitions_follow_bytes(spark):
    df = spark.range(1000)
    assert runtime.partitions_for(df, 64) > runtime.partitions_for(df) >= runtime.task_slots(spark)


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session())


def test_release_removes_tables(spark):
    held, runtime._OWN_TABLES[:] = list(runtime._OWN_TABLES), []
    table = runtime.materialize(spark.range(5))
    assert table.count() == 5
    runtime.release(spark)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(*[f.rsplit("/", 1)[0] for f in table.inputFiles()[:1]]).count()
    runtime._OWN_TABLES[:] = held


def slow_frames(seq, least):
    found = []
    for frame in range(3):
        start = None
        for i in range(frame, len(seq) - 2, 3):
            c = seq[i : i + 3]
            if start is None and c == b"ATG":
                start = i
            elif c in (b"TAA", b"TAG", b"TGA"):
                if start is not None and (i - start) // 3 >= least:
                    found.append((start, i + 3))
                start = None
    return found


def test_frames_equal_a_scan():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 7, 50, 400, 3000):
        for letters in ("ACGT", "ATG", "ACGTN"):
            s = "".join(rng.choice(letters) for _ in range(n)).encode()
            for least in (0, 3):
                assert sorted(_frames(s, least)) == sorted(slow_frames(s, least))


def test_disjoint_or_error(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "train"), ("b", "val"), (None, "val"), ("c", None)], "g string, split string")
    assert sampling.require_disjoint(rows, "g", "split").count() == 5
    assert sampling.require_disjoint(rows.limit(0), "g", "split").count() == 0
    torn = rows.union(spark.createDataFrame([("a", "test")], "g string, split string"))
    with pytest.raises(Exception, match="1 groups of g"):
        sampling.require_disjoint(torn, "g", "split").collect()


def test_cluster_detection(spark):
    words = spark.createDataFrame([("nrps", "NRPS"), (" T1PKS ", "PKS"), ("t1pks", "ZED"), (None, "X")], "product string, cls string")
    rows = [(1, "NRPS", ["NRPS", "odd"]), (2, "HYB", ["nrps", "T1PKS"]), (3, "PKS", ["odd", None]), (4, "PKS", []), (5, None, None), (6, "PKS", ["nrps"])]
    df = spark.createDataFrame(rows, "id bigint, want string, products array<string>")
    got = {r["id"]: (r["detected"], r["found"], r["unmapped"], r["matched"]) for r in rules.cluster_detection(df, "id", "want", "products", words, "product", "cls", {"HYB": ["NRPS", "PKS"]}).collect()}
    assert got[1] == (True, ["NRPS"], ["odd"], True) and got[2] == (True, ["NRPS", "PKS"], [], True)
    assert got[3] == (True, [], ["odd"], None) and got[4] == (False, [], [], False) == got[5] and got[6][3] is False


def test_check_driver(spark):
    df = spark.createDataFrame([(1, 5), (2, 1), (3, None)], "id bigint, n int")
    checks = {"big": (F.col("n") > 3, F.col("n").isNull()), "costly": (F.raise_error(F.lit("computed")).cast("boolean"), F.lit(False))}
    got = {r["id"]: (r["big"], r["costly"], r["failed"]) for r in rules.run_checks(df, checks, skip=["costly"]).collect()}
    assert got == {1: ("PASS", "skipped", []), 2: ("FAIL", "skipped", ["big"]), 3: ("skipped", "skipped", [])}


def test_profiles_of_odd_texts(spark):
    df = spark.createDataFrame([("x", 1, "acgA"), ("x", 2, None), ("y", 3, ""), (None, 4, "GG")], "g string, id bigint, s string")
    got = {(r["g"], r["kind"], r["item"]): r["n"] for r in aggregates.text_profile(df, "g", "s", "id").collect()}
    assert got == {("x", "codon", "ACG"): 1, ("x", "base", "A"): 2, ("x", "base", "C"): 1, ("x", "base", "G"): 1, ("x", "pair", "AC"): 1, ("x", "pair", "CG"): 1, ("x", "pair", "GA"): 1, (None, "base", "G"): 2, (None, "pair", "GG"): 1}
    assert aggregates.text_profile(df, "g", "s", "id", cap=1).where("g = 'x' and kind = 'base'").count() == 3


def test_stop_mass(spark):
    rows = [(r, i, b, 0.5, 0.25) for r, s in ((1, "TACTGCTAA"), (2, "TAATAC"), (3, "TAG"), (4, "TA")) for i, b in enumerate(s)]
    df = spark.createDataFrame(rows, "r bigint, p int, b string, a double, g double")
    got = {x["r"]: (x["positions"], x["stop_mass"]) for x in aggregates.stop_mass(df, "r", "p", "b", "a", "g").collect()}
    # the last codon of 1 and all of 3 is where the end is meant to be
    assert got == {1: (2, pytest.approx((0.75 + 0.5) / 2)), 2: (2, pytest.approx(0.75)), 3: (0, None)}


def test_npz_needs_provenance(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.mkdir(), bad.mkdir()
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.savez(good / "a.npz", ids=np.arange(4), vectors=x, model=np.array("m"), layer=np.array(3))
    np.savez(good / "none.npz", ids=np.zeros(0, np.int64), vectors=np.zeros((0, 3), np.float32), model=np.array("m"), layer=np.array(3))
    got = {r["id"]: (r["vector"], r["model"], r["layer"]) for r in vectors.read_npz(spark, str(good)).collect()}
    assert got == {i: (x[i].tolist(), "m", 3) for i in range(4)}
    np.savez(bad / "a.npz", ids=np.arange(4), vectors=x)
    with pytest.raises(Exception, match="without provenance"):
        vectors.read_npz(spark, str(bad)).collect()


def test_fingerprints_by_pieces(spark, tmp_path):
    data = b"line\n" * 300 + b"no end"
    (tmp_path / "a.txt").write_bytes(data)
    (tmp_path / "b.txt").write_bytes(b"")
    got = {r["path"].rsplit("/", 1)[1]: (r["sha256"], r["bytes"], r["lines"]) for r in sinks.fingerprints(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == (hashlib.sha256(data).hexdigest(), len(data), 300)
    assert got.get("b.txt", (hashlib.sha256(b"").hexdigest(), 0, 0)) == (hashlib.sha256(b"").hexdigest(), 0, 0)
    head = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in sinks.head_fingerprint(spark, str(tmp_path), 10).collect()}
    assert head["a.txt"] == hashlib.sha256(b"\n".join([b"line"] * 10)).hexdigest()


def test_archive_addresses(tmp_path):
    for name in ("a.tar", "b.tar.gz", "c.txt"):
        (tmp_path / name).write_bytes(b"")
    assert [p.rsplit("/", 1)[1] for p in genbank._archives(str(tmp_path))] == ["a.tar", "b.tar.gz"]
    assert [p.rsplit("/", 1)[1] for p in genbank._archives(f"file://{tmp_path}/*.gz")] == ["b.tar.gz"]
    assert genbank._archives(str(tmp_path / "a.tar")) == [f"file://{tmp_path}/a.tar"] and genbank._archives(str(tmp_path / "nothing")) == []


def test_axes_without_the_first_component(spark):
    rng = np.random.default_rng(3)
    base = np.array([3.0, 4.0, 0.0]) / 5
    rows = [(i, (rng.normal() * 10 * base + rng.normal(0, 0.1, 3)).tolist()) for i in range(200)] + [(200, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    kept = np.array([r["kept"] for r in vectors.without_first_component(df.where("v is not null"), "id", "v").collect()])
    assert np.abs(kept @ base).max() < 0.5 and len(kept) == 200
