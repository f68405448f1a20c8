"""Hand-computed cases of the core operators, with nulls, empty tables, ties and repeated rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import names, sequence
from strandloom.operators import aggregates, graph, joins, ranking, records, rules, sampling, similarity, stats, vectors, windows
from strandloom.runtime import rank_by_hash, rank_by_md5, rank_by_value, salted_join


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_windows_closed_form(spark):
    size, stride = windows.budget(32768, 207, 0, 5, 2048)
    assert (size, stride) == (32556, 30508)
    df = spark.createDataFrame([(32556,), (32557,), (100000,), (262144,), (0,), (None,)], "n int")
    got = {r["n"]: r["count"] for r in windows.tiles(df, F.col("n"), size, stride).groupBy("n").count().collect()}
    assert got == {32556: 1, 32557: 2, 100000: 4, 262144: 9, 0: 1}
    for bad in ((100, 100, 0, 0, 0), (100, 10, 0, 0, 90)):
        with pytest.raises(ValueError):
            windows.budget(*bad)


def test_windows_cover(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 400, 7)], "n int")
    rows = windows.tiles(df, F.col("n"), 50, 40).collect()
    by = {}
    for r in rows:
        by.setdefault(r["n"], []).append((r["nt_start"], r["nt_end"]))
    for n, spans in by.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == n and all(b[0] <= a[1] for a, b in zip(spans, spans[1:], strict=False))


def test_gene_tiles(spark):
    df = spark.createDataFrame(
        [(1, 250, [(0, 80), (70, 95), (100, 230)]), (2, 90, None), (3, 250, []), (4, 250, [(0, 10), (10, 240)]), (5, None, [])], "id bigint, n int, genes array<struct<s int, e int>>"
    )
    got = {}
    for r in windows.gene_tiles(df, "id", "n", "genes", 100, 20).collect():
        got.setdefault(r["id"], []).append((r["nt_start"], r["nt_end"]))
    assert got[1] == [(0, 95), (75, 175), (155, 250)] and got[2] == [(0, 90)]
    assert got[3] == [(0, 100), (80, 180), (160, 250)]
    assert got[4][0] == (0, 10) and got[4][-1][1] == 250 and 5 not in got


def test_phase_and_spans(spark):
    phase = [one(spark, windows.codon_phase(F.lit(p), F.lit(3), F.lit(12), F.lit(s)).cast("int")) for s in (1, -1) for p in (2, 3, 4, 5, 11, 12)]
    assert phase == [-1, 0, 1, 2, 2, -1, -1, 2, 1, 0, 0, -1]
    for strand, first, want in ((1, 1, (100, 103)), (-1, 1, (397, 400)), (1, 99, (394, 397))):
        a, b = sequence.residue_span(F.lit(100), F.lit(400), F.lit(strand), F.lit(first), F.lit(first))
        assert (one(spark, a), one(spark, b)) == want
    a, b = sequence.residue_span(F.lit(50), F.lit(200), F.lit(1), F.lit(45), F.lit(60))
    assert (one(spark, a), one(spark, b)) == (182, 200)


def test_sequence_functions(spark):
    assert one(spark, sequence.longest_run(F.lit("ACCCGG"))) == 3 and one(spark, sequence.longest_run(F.lit(""))) == 0
    assert one(spark, sequence.pair_entropy(F.lit("A"))) == 0.0 and abs(one(spark, sequence.pair_entropy(F.lit("GC" * 8000))) - 1) < 1e-3
    assert one(spark, sequence.gc_of_acgt(F.lit("GCNN"))) == 1.0 and one(spark, sequence.gc_of_length(F.lit("GCNN"))) == 0.5
    assert one(spark, sequence.gc_of_acgt(F.lit(None).cast("string"))) is None and one(spark, sequence.other_share(F.lit(""))) == 0.0
    assert one(spark, sequence.kmers(F.lit("ab\ncd"), 2)) == ["ab", "b\n", "\nc", "cd"] and one(spark, sequence.kmers(F.lit("a"), 2)) == []
    assert one(spark, sequence.translated(F.lit("atgGCNtaaC"))) == "MX*"
    assert one(spark, sequence.last_stop_trim(F.lit("ccTAAcTGAcc"))) == "ccTAAcTGA"
    assert one(spark, sequence.reverse_complement(F.lit("AACGtn"))) == "naCGTT"
    w = sequence.relative_adaptiveness({"GCT": 2.0, "GCC": 1.0})
    assert abs(one(spark, sequence.adaptation_index(F.lit("GCTGCCGCTGCC"), w)) - math.sqrt(0.5)) < 1e-9
    assert one(spark, sequence.adaptation_index(F.lit("NNN"), w)) is None
    kept, ended, cut = sequence.cleaned(F.lit("acgtxx|END|acgt"))
    assert (one(spark, kept), one(spark, ended), one(spark, cut)) == ("ACGT", True, True)
    assert one(spark, sequence.centre(F.lit("0123456789"), 4)) == "3456"


def test_containment(spark):
    a = "ACGTACGTGGCCAATTACGGTACA"
    turned = a[::-1].translate(str.maketrans("ACGT", "TGCA"))
    k = lambda s: sequence.canonical_kmer_set(F.lit(s), 5)
    assert one(spark, sequence.containment(k(a), k(a))) == 1.0 == one(spark, sequence.containment(k(a), k(turned)))
    assert one(spark, sequence.containment(k("A" * 20), k("C" * 20))) == 0.0
    assert [one(spark, similarity.novelty_tier(F.lit(x))) for x in (0.99, 0.85, 0.5)] == ["FAIL", "WARN", "PASS"]


def test_fragment_beats_distractors(spark):
    rng = random.Random(1)
    ref = "".join(rng.choice("ACGT") for _ in range(4000))
    rows = [(0, ref[1000:2000]), (1, ref)] + [(i, ref[1000:1500] + "".join(rng.choice("ACGT") for _ in range(500))) for i in range(2, 6)] + [(7, None), (8, ""), (9, "ACGT")]
    df = spark.createDataFrame(rows, "id bigint, s string")
    best = {r["id"]: r for r in similarity.full_nearest(df.where("id in (0, 8, 9)"), df, "id", "s", 15).collect()}
    assert best[0]["nearest"] == 1 and best[0]["max_containment"] >= 0.99 and best[0]["tier"] == "FAIL"
    assert best[8]["max_containment"] == 0.0 and best[8]["nearest"] is None


def test_classes_of_a_set(spark):
    rng = random.Random(2)
    same = "".join(rng.choice("ACGT") for _ in range(2000))
    rows = [(i, same) for i in range(5)] + [(i, "".join(rng.choice("ACGT") for _ in range(2000))) for i in range(5, 10)] + [(10, None)]
    df = spark.createDataFrame(rows, "id bigint, s string")
    classes = similarity.link_classes(df, "id", "s", similarity.full_links(df, "id", "s", 21, 0.8).where("a < b"))
    got = {r["id"]: (r["class_id"], r["links"]) for r in classes.collect()}
    assert all(got[i] == (0, 4) for i in range(5)) and all(got[i] == (i, 0) for i in range(5, 11))
    s = similarity.set_summary(classes).first()
    assert (s["rows"], s["classes"], s["largest"]) == (11, 7, 5)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["class_id"] for r in graph.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_verdicts_and_funnel(spark):
    rows = [("PASS", "PASS", "PASS")] * 2 + [("PASS", "skipped", "PASS")] * 8 + [("FAIL", "PASS", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    tally = {r["question"]: r for r in aggregates.verdict_tally(df, ["a", "b", "c"]).collect()}
    assert tally["b"]["rate"] == 1.0 and tally["b"]["skipped"] == 8 and tally["a"]["FAIL"] == 1
    steps = [r["passing"] for r in aggregates.funnel(df, ["a", "b", "c"]).orderBy("stage").collect()]
    assert steps == [2, 2, 2]
    none = aggregates.funnel(df.where("a = 'x'"), ["a"]).first()
    assert none["evaluated"] == 0 and none["rate"] is None
    v, s = rules.derived(F.lit("skipped"), F.lit(None).cast("string"), F.lit("FAIL"), ("x", "y", "z"))
    assert (one(spark, v), one(spark, s)) == ("FAIL", "z")
    passed, skipped = rules.novelty_check(F.lit(None).cast("double"))
    assert one(spark, rules.verdict(passed, skipped)) == "skipped"


def test_joint_and_confusion(spark):
    df = spark.createDataFrame([(True, 0.9)] * 4 + [(False, 0.1)] * 6, "on boolean, nt double")
    got = aggregates.joint_pass(df, {"on": F.col("on"), "low": F.col("nt") < 0.5}).first()
    assert (got["on"], got["low"], got["joint"]) == (4, 6, 0)
    rows = [("NRPS", "NRPS")] * 4 + [("TERPENE", "TERPENE"), ("TERPENE", "NRPS"), ("PKS", "PKS"), ("PKS", None)]
    per = {r["wanted"]: r for r in aggregates.confusion_summary(aggregates.confusion(spark.createDataFrame(rows, "w string, g string"), "w", "g"), spark.createDataFrame([("X",), ("PKS",), ("NRPS",), ("TERPENE",)], "wanted string")).collect()}
    assert abs(per["PKS"]["accuracy"] - 6 / 7) < 1e-9 and per["TERPENE"]["recall"] == 0.5 and abs(per["PKS"]["prior"] - 4 / 7) < 1e-9 and per["X"]["recall"] is None


def test_ranking_metrics(spark):
    rows = [("A", {"A": 0.9, "B": 0.5, "C": 0.1, "D": 0.0}), ("A", {"A": 0.4, "B": 0.8, "C": 0.1, "D": 0.0}), ("A", {"A": 0.7, "B": 0.1}), ("A", {"A": 0.7})]
    got = aggregates.ranking_metrics(spark.createDataFrame(rows, "t string, s map<string,double>"), "t", "s").first()
    assert got["n"] == 3 and abs(got["top1"] - 2 / 3) < 1e-9 and got["top3"] == 1.0 and abs(got["mrr"] - 2.5 / 3) < 1e-9


def test_profile_cap(spark):
    df = spark.createDataFrame([(1, "g", "aaa"), (2, "g", "ccc"), (3, None, None), (4, "h", "")], "id int, g string, t string")
    assert {(r["g"], r["pair"], r["n"]) for r in aggregates.pair_profile(df, "g", "t", "id", 1).collect()} == {("g", "AA", 2)}
    assert aggregates.pair_profile(df, "g", "t", "id").count() == 2


def test_modules(spark):
    pattern = ["C", "A", "T"]
    items = lambda x: F.array(*map(F.lit, x))
    assert one(spark, rules.ordered_count(items("CATxCAT"), pattern)) == 2 and one(spark, rules.ordered_count(items("TACTAC"), pattern)) == 0
    assert one(spark, rules.module_count(items("TACTAC"), pattern)) == 2


def test_faithfulness(spark):
    ok = lambda gc, cai, d, known=True: one(spark, rules.faithful(F.lit(gc), (0.4, 0.6), F.lit(cai), 0.5, F.lit(d), 0.2, F.lit(known)))
    assert ok(0.5, 0.6, 0.9) is True and ok(0.5, 0.1, 0.9) is False and ok(0.5, 0.6, 0.1, False) is None
    assert one(spark, rules.composite([F.lit(None).cast("boolean"), F.lit(True)], 2)) is False


def test_early_stop(spark):
    rows = [("a", i, x) for i, x in enumerate([1.0, 0.9, 0.85, 0.85, 0.85, 0.85, 0.84])] + [("b", i, 1.0 - i / 10) for i in range(8)]
    got = {r["run"]: r["stop"] for r in ranking.early_stop(spark.createDataFrame(rows, "run string, step int, loss double"), "run", "step", "loss", 3, 0.001).collect()}
    assert got == {"a": 5, "b": None}


def test_statistics(spark):
    assert abs(stats.sign_p(8, 0) - 2 * 0.5**8) < 1e-12 and abs(stats.sign_p(3, 1) - 0.625) < 1e-12 and stats.sign_p(0, 0) == 1.0
    assert abs(stats.fisher_p(3, 1, 1, 3) - 0.4857142857) < 1e-9 and stats.fisher_p(0, 0, 0, 0) == 1.0
    low, high = stats.wilson(F.lit(0), F.lit(0))
    assert (one(spark, low), one(spark, high)) == (0.0, 0.0)
    df = spark.createDataFrame([(1.0, True), (2.0, True), (2.0, False), (3.0, False), (None, True)], "v double, f boolean")
    got = stats.mann_whitney(df, [], "v", F.col("f")).first()
    assert got["u"] == 0.5 and got["effect"] == 0.125
    assert ranking.auc(df, "v", "f").first()["auc"] == 0.125 and ranking.auc(df.where("f"), "v", "f").first()["auc"] is None
    w = stats.wilcoxon(spark.createDataFrame([(1.0,), (-2.0,), (3.0,), (0.0,), (2.0,)], "d double"), [], "d").first()
    assert (w["n"], w["w_plus"], w["w_minus"]) == (4, 1 + 2.5 + 4, 2.5)
    p = stats.permutation(spark.createDataFrame([("o", 5.0), ("c", 1.0), ("c", 2.0), ("c", 6.0)], "k string, v double"), [], "v", "k", "o", "c").first()
    assert p["p"] == 0.5 and not p["at_floor"]


def test_group_splits(spark):
    rng = random.Random(3)
    rows = [(i, f"g{i // 3}", rng.choice(["TERPENE", "NRPS", None])) for i in range(600)] + [(1000 + i, "big", "NRPS") for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, g string, c string")
    shares = {"train": 0.8, "val": 0.1, "test": 0.1}
    a = sampling.assign_groups(df, "g", "c", shares)
    assert a.count() == 201 and a.select("g").distinct().count() == 201
    routed = sampling.routed(df, a, "g")
    assert routed.count() == 800 and sampling.torn_groups(routed, "g", "split").count() == 0
    part = {r["split"]: r["count"] / 800 for r in routed.groupBy("split").count().collect()}
    assert abs(part["train"] - 0.8) < 0.05
    b = sampling.deficit_split(df, "c", "g", shares)
    assert b.select("c", "g").distinct().count() == b.count() == df.select("c", "g").distinct().count()
    assert sampling.assign_groups(df.limit(0), "g", "c", shares).count() == 0


def test_budget_and_caps(spark):
    df = spark.createDataFrame([("a", "x")] * 90 + [("a", "y")] * 9 + [("a", "z")] + [("b", "x")] * 3, "c string, k string").withColumn("id", F.monotonically_increasing_id())
    got = {(r["c"], r["k"]): r["quota"] for r in sampling.budget_cells(df, "c", ["k"], 10).collect()}
    assert got[("b", "x")] == 3 and got[("a", "z")] == 1 and sum(v for (c, _), v in got.items() if c == "a") == 10
    assert sampling.capped(df, "id", "c", F.col("k") == "y", 5).where("c = 'a'").count() == 9
    assert {r["c"]: r["count"] for r in sampling.balanced(df, "id", "c", 2).groupBy("c").count().collect()} == {"a": 2, "b": 2}
    text = one(spark, sampling.shuffled(F.lit("AACCGGTTA"), F.lit(1), "s"))
    assert sorted(text) == sorted("AACCGGTTA") and len(one(spark, sampling.shuffled(F.lit("AACCGGTT"), F.lit(1), "s", 3))) == 6


def test_ranks(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "hot" if i % 2 else f"k{i % 7}") for i in range(500)], "id bigint, g string")
    for ranked in (rank_by_hash(df, ["g"], "id", buckets=8), rank_by_md5(df, ["g"], "id")):
        by = {}
        for r in ranked.collect():
            by.setdefault(r["g"], []).append(r["rank"])
        assert sum(map(len, by.values())) == 500 and all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values())
    assert [r["rank"] for r in rank_by_value(df, "id", 7).orderBy("id").collect()] == list(range(1, 501))
    right = spark.createDataFrame([("hot", 1), ("k1", 2)], "g string, v int")
    assert salted_join(df, right, ["g"]).count() == df.join(right, "g").count()
    assert salted_join(df, right, ["g"], "left").count() == 500


def test_interval_joins(spark):
    rng = random.Random(4)
    make = lambda n, a, b: [(i, rng.choice("xy"), s, s + rng.randrange(0, 60)) for i in range(n) for s in [rng.randrange(0, 300)]]
    xs, ys = make(60, "s", "e"), make(40, "o_s", "o_e")
    a = spark.createDataFrame(xs, "i int, c string, s int, e int")
    b = spark.createDataFrame([(c, s, e) for _, c, s, e in ys], "c string, o_s int, o_e int")
    got = sorted((r["i"], r["o_s"], r["o_e"]) for r in joins.overlapping(a, b, ["c"], 25).collect())
    want = sorted((i, s2, e2) for i, c, s, e in xs for _, c2, s2, e2 in ys if c == c2 and e > s2 and s < e2)
    assert got == want
    inside = sorted((r["i"], r["o_s"], r["o_e"]) for r in joins.contained(a, b, ["c"], 25).collect())
    assert inside == sorted((i, s2, e2) for i, c, s, e in xs for _, c2, s2, e2 in ys if c == c2 and s >= s2 and e <= e2)
    free = {r["i"] for r in joins.touching_none(a, b, ["c"], "i", 25).collect()}
    assert free == {i for i, *_ in xs} - {w[0] for w in want}
    cov = {r["c"]: r["covered"] for r in joins.islands(a, "c").collect()}
    assert cov == {k: len({p for _, c, s, e in xs if c == k for p in range(s, e)}) for k in cov}


def test_failing_checks(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "row int, acc string")
    b = spark.createDataFrame([(1, "x", 5), (2, "z", 6)], "row int, acc string, v int")
    with pytest.raises(Exception, match="differs"):
        joins.cross_checked(a, b, "row", "acc").collect()
    assert joins.cross_checked(a, b.where("row = 1"), "row", "acc").count() == 1
    with pytest.raises(Exception, match="line up"):
        joins.by_position(a, b, "row", "row", "acc").collect()
    with pytest.raises(Exception, match="control"):
        aggregates.require_positive(a.withColumn("f", F.lit(False)), "f", "arm").collect()
    with pytest.raises(Exception, match="sequence"):
        a.select(records.recovered_prefix(F.col("acc"), F.lit("p"), F.lit("q"))).collect()
    with pytest.raises(FileNotFoundError):
        rules.require_resource(a, False, True, "m")
    assert rules.require_resource(a, False, False, "m").where("m_skipped").count() == 2


def test_tags_and_products(spark):
    assert one(spark, names.tag_rank(F.lit("d__Bacteria; p__ Some "), "p")) == "Some" and one(spark, names.tag_rank(F.lit("|S__|"), "s")) is None
    assert one(spark, names.bucket_label_k(F.lit(5000), [16384, 131072])) == "<=16k" and one(spark, names.bucket_label_k(F.lit(200000), [16384, 131072])) == ">131k"
    words = spark.createDataFrame([("t1pks", "PKS"), ("nrps", "NRPS"), ("Other", "OTHER")], "p string, c string")
    rows = spark.createDataFrame([(1, ["T1PKS, NRPS"]), (2, ["other", "nrps"]), (3, ["zzz"]), (4, None), (5, []), (6, ["other"])], "id int, ps array<string>")
    got = {r["id"]: r["class"] for r in joins.class_of_products(rows, "id", "ps", words, "p", "c").collect()}
    assert got == {1: "PKS_NRPS_HYBRID", 2: "NRPS", 3: "OTHER", 4: "OTHER", 5: "OTHER", 6: "OTHER"}


def test_hierarchy_with_cycles(spark):
    nodes = spark.createDataFrame([(1, 1, "no rank", "root"), (2, 1, "superkingdom", " Bact "), (3, 2, "genus", "Abc"), (4, 3, "species", "Abc def"), (10, 11, "genus", "Loop"), (11, 10, "family", "Loopaceae"), (4, 3, "species", "Abc def")], "id int, parent int, r string, name string")
    got = {r["node"]: r for r in joins.lineage(nodes, "id", "parent", "r", "name", {"superkingdom": "domain", "genus": "genus", "species": "species", "family": "family"}).collect()}
    assert got[4]["domain"] == "Bact" and got[4]["genus"] == "Abc" and got[10]["family"] == "Loopaceae" and got[11]["genus"] == "Loop"


def test_vectors(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, [float(i % 3 == k) * 3 + rng.gauss(0, 0.3) for k in range(4)]) for i in range(90)] + [(99, None, None)]
    df = spark.createDataFrame(rows, "id bigint, y int, v array<float>")
    axes = {r["y"]: r["axis"] for r in vectors.contrast_axes(df, "y", "v").collect()}
    assert all(max(range(4), key=lambda i: axes[k][i]) == k and abs(sum(x * x for x in axes[k]) - 1) < 1e-9 for k in range(3))
    assert all(r["stability"] > 0.95 for r in vectors.split_half(df.where("y is not null"), "id", "y", "v").collect())
    assert all(r["auc"] > 0.99 for r in vectors.held_out_auc(df.where("y is not null"), "id", "y", "v").collect())
    near = {r["id"]: r for r in similarity.nearest_vectors(df.where("id < 10"), df, "id", "v", 3, block=16).collect()}
    for i in range(10):
        dist = sorted((math.dist([float(F_) for F_ in r[2]], rows[i][2]), r[0]) for r in rows[:90] if r[0] != i)
        assert abs(near[i]["mean_distance"] - sum(d for d, _ in dist[:3]) / 3) < 1e-3


def test_dedup_and_cleaning(spark):
    df = spark.createDataFrame([(3, "x", "train"), (1, "x", "val"), (2, None, "val"), (4, None, "test"), (5, "y", "val"), (6, "y", "test"), (7, "z", None)], "id int, s string, split string")
    assert {r["id"] for r in ranking.first_of_content(df, "s", "id").collect()} == {1, 2, 4, 5, 7}
    assert {r["id"] for r in similarity.cleaned_splits(df, "id", "split", F.col("s")).collect()} == {3, 2, 4, 6, 7}
