"""Quota samples, related splits, chunks, tokens, mixing and the abuse classifier on small, hostile fixtures."""

import os
import random

import pytest
from pyspark.sql import functions as F

from strandloom.llm import abuse
from strandloom.llm.chunks import furthest, pack, split_oversized, structure
from strandloom.llm.labels import normal_accession, normal_split, species, stripped, with_class
from strandloom.llm.mixing import mix_sources
from strandloom.llm.quota_sample import quota_sample, swap_repair
from strandloom.llm.related_splits import Bundle, allocate, broken_relations, related_splits, relation_key, split_report
from strandloom.llm.tokens import BYTE_BPE, Vocabulary, byte_characters, decoded, encoded

needs_vocabulary = pytest.mark.skipif(not os.path.exists(BYTE_BPE), reason="no vocabulary file")


def test_labels(spark):
    tags = [
        ("|D__X;G__A;S__ABCELLA_DEFUM_QX_12|", "abcella defum"),
        ("d__X; s__Abcella defum str. 7", "abcella defum"),
        ("|s__abcella-defum |", "abcella defum"),
        ("|S__ABCELLA__DEFUM|", "abcella defum"),
        ("|s__Abcella sp. QX-1|", None),
        ("|S__ABCELLA_SP_QX_1|", None),
        ("|S__|", None),
        ("|G__ABCELLA|", None),
        ("|TAX:UNKNOWN|", None),
        ("", None),
        (None, None),
    ]
    df = spark.createDataFrame(tags, "tag string, want string")
    assert df.where(~species(F.col("tag")).eqNullSafe(F.col("want"))).count() == 0
    splits = [(" Train ", "train"), ("VALIDATION", "val"), ("valid", "val"), ("\t", None), (None, None), ("x", "x")]
    assert spark.createDataFrame(splits, "s string, w string").where(~normal_split(F.col("s")).eqNullSafe(F.col("w"))).count() == 0
    accs = [(" bgc01.3 ", "BGC01"), ("B G C01", "BGC01"), ("", None), (None, None)]
    assert spark.createDataFrame(accs, "s string, w string").where(~normal_accession(F.col("s")).eqNullSafe(F.col("w"))).count() == 0
    targets = spark.createDataFrame([("PKS",), ("UNKNOWN",), (None,)], "compound_class string")
    words = spark.createDataFrame([("pks-like", "PKS"), ("Odd", "RARE"), (None, "PKS"), ("x", None)], "product string, compound_class string")
    rows = spark.createDataFrame([(1, " pks\t"), (2, "PKS-LIKE"), (3, None), (4, "  "), (5, "what"), (6, "odd")], "id int, label string")
    got = {r["id"]: r["class"] for r in with_class(rows, "label", targets, words).collect()}
    assert got == {1: "PKS", 2: "PKS", 3: "UNKNOWN", 4: "UNKNOWN", 5: "OTHER", 6: "RARE"}
    assert spark.range(1).select(stripped(F.lit("  a b 　")).alias("x")).first()["x"] == "a b"


def test_swap_repair():
    rng = random.Random(1)
    for seed in range(40):
        available = {(c,): rng.randrange(0, 200) for c in "abcde"} | {(): rng.randrange(0, 200)}
        targets = {c: (rng.randrange(0, 300), rng.randrange(0, 30)) for c in "abcde"}
        size = rng.randrange(0, sum(available.values()) + 10)
        got, figures = swap_repair(available, targets, size, seed)
        assert sum(got.values()) == min(size, sum(available.values())) and figures["after"] <= figures["before"]
        assert all(0 <= got[c] <= available[c] for c in got)
        floors = {c: min(available[c], targets[c[0]][1] if c else 0) for c in got}
        if sum(floors.values()) <= size:
            assert all(got[c] >= floors[c] for c in got)
            share = {c: (targets[c[0]][0] if c else 0) * min(size, sum(available.values())) / 1000 for c in got}
            cost = sum((got[c] - share[c]) ** 2 for c in got)
            for c in got:
                for d in got:
                    if c != d and got[c] > floors[c] and got[d] < available[d]:
                        other = cost - (got[c] - share[c]) ** 2 - (got[d] - share[d]) ** 2 + (got[c] - 1 - share[c]) ** 2 + (got[d] + 1 - share[d]) ** 2
                        assert other >= cost - 1e-6
    assert swap_repair({}, {}, 5)[0] == {}


def test_signatures_of_several_categories(spark):
    """Rows with two categories count for both, so the exchange must see whole signatures."""
    targets = {"a": (500, 10), "b": (500, 10), "c": (250, 40)}
    got, figures = swap_repair({("a", "b"): 100, ("a", "c"): 100, ("b", "c"): 100, ("a",): 100, ("b",): 100, (): 100}, targets, 200)
    counts = {c: sum(n for s, n in got.items() if c in s) for c in "abc"}
    assert abs(counts["a"] - 100) <= 1 and abs(counts["b"] - 100) <= 1 and abs(counts["c"] - 50) <= 1 and got[()] <= 51
    rows = [(i, [["x"], ["x", "y"], ["y", None, "y"], ["z"], [], None][i % 6]) for i in range(600)]
    df = spark.createDataFrame(rows, "record_id bigint, labels array<string>")
    goal = spark.createDataFrame([("x", 600, 0), ("y", 600, 0), ("q", 10, 3)], "compound_class string, target_permille int, min_records int")
    sample, report = quota_sample(df, "record_id", "labels", goal, 100)
    got = {r["category"]: r for r in report.collect()}
    assert sample.count() == 100 and abs(got["x"]["taken"] - 60) <= 1 and abs(got["y"]["taken"] - 60) <= 1
    assert got["q"]["shortfall"] == 3 and got["x"]["shortfall"] == 0 and got["x"]["swaps"] > 0 and got["x"]["deviation_after"] <= got["x"]["deviation_before"]


def test_quota_sample(spark):
    targets = spark.createDataFrame([("a", 500, 5), ("b", 300, 5), ("c", 150, 20), ("d", 50, 10), (None, 1, 1)], "compound_class string, target_permille int, min_records int")
    rows = [(i, "abce"[min(3, i % 10 // 3)] if i < 900 else "a", "k", 1) for i in range(1000)] + [(5000 + i, "c", "k", 1) for i in range(3)]
    df = spark.createDataFrame(rows, "record_id bigint, category string, key string, `rank` int")
    sample, report = quota_sample(df, "record_id", "category", targets, 200)
    assert sample.columns == df.columns and sample.count() == 200 and sample.select("record_id").distinct().count() == 200
    got = {r["category"]: r for r in report.collect()}
    assert got["d"]["shortfall"] == 10 and got["d"]["taken"] == 0 and abs(got["a"]["share"] - 0.5) < 0.06 and got["a"]["shortfall"] == 0
    counts = {r["category"]: r["count"] for r in sample.groupBy("category").count().collect()}
    assert all(counts.get(c, 0) == r["taken"] for c, r in got.items())
    empty, short = quota_sample(df.limit(0), "record_id", "category", targets, 0)
    assert empty.count() == 0 and {r["category"] for r in short.where("shortfall > 0").collect()} == {"a", "b", "c", "d"}


def test_related_splits(spark):
    rng = random.Random(2)
    rows, n = [], 0
    for g in range(300):
        for _ in range(400 if g == 0 else rng.choice([1, 1, 1, 2, 3, 8])):
            rows.append((n, None if g == 1 else f"s:{g}", rng.choice(["p", "q", None]), "x"))
            n += 1
    df = spark.createDataFrame(rows, "record_id bigint, key string, label string, assigned string")
    shares = {"train": 800, "val": 100, "test": 100}
    out = related_splits(df, "record_id", "key", "label", shares).withColumnRenamed("id", "record_id")
    assert out.count() == n
    both = df.drop("assigned").join(out, "record_id")
    assert both.where("key is not null").groupBy("key").agg(F.countDistinct("assigned").alias("n")).where("n > 1").count() == 0
    part = {r["assigned"]: r["count"] / n for r in both.groupBy("assigned").count().collect()}
    assert abs(part["train"] - 0.8) < 0.05 and abs(part["val"] - 0.1) < 0.04
    for r in split_report(both, "assigned", "label", shares).collect():
        assert abs(r["share"] - r["target"]) < 0.06, r
    assert related_splits(df.limit(0), "record_id", "key", "label", shares).count() == 0


def test_allocation_is_whole():
    got = allocate([Bundle(10, 1, {"a": 1.0}), Bundle(1, 7, {"a": 1.0}), Bundle(3, 2, {"b": 0.5, "a": 0.5})], {"train": 8, "val": 1, "test": 1})
    assert [sum(g.values()) for g in got] == [10, 1, 3]
    assert got[1]["train"] == 1


def test_repair_sees_whole_profiles():
    """Two kinds of components have the same main label; only their minor labels tell where they must go."""
    bundles = [Bundle(20, 10, {"a": 0.6, "b": 0.4}), Bundle(20, 10, {"a": 0.6, "c": 0.4})]
    got = allocate(bundles, {"x": 1, "y": 1})
    assert [g["x"] for g in got] == [10, 10]


def test_broken_relations(spark):
    rows = [
        (1, "|S__AB_CD|", None, "train"),
        (2, "s__ab cd str. 3", None, "VAL"),
        (3, "|S__AB_EF|", None, "train"),
        (4, None, "acc.1", "train"),
        (5, "|s__ab sp. 3|", " ACC ", "test"),
        (6, None, None, "test"),
        (7, None, None, "train"),
        (8, "|S__AB_CD|", None, None),
        (9, "|S__GH_IJ|", "acc", "test"),
        (10, "|S__AB_EF|", None, "Train "),
    ]
    df = spark.createDataFrame(rows, "record_id bigint, tag string, accession string, split string")
    df = df.withColumn("key", relation_key(F.col("tag"), F.col("accession"))).withColumn("split", normal_split(F.col("split")))
    assert {r["id"] for r in broken_relations(df, "record_id", "key", "split").collect()} == {1, 2, 4, 5}
    assert broken_relations(df.limit(0), "record_id", "key", "split").count() == 0


def brute_pieces(n, bounds, limit, overlap):
    out, s = [], 0
    while n - s > limit:
        fit = [b for b in bounds if s + overlap < b <= s + limit]
        e = max(fit) if fit else s + limit
        out.append((s, e))
        s = e - overlap
    return [*out, (s, n)]


def test_pack_is_the_last_boundary_that_fits():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 900)
        gaps, genes = ([rng.randrange(-5, n + 50) for _ in range(rng.randrange(0, k))] for k in (6, 30))
        inside = {b for b in gaps + genes if 0 < b < n}
        assert pack(structure(n, gaps, genes), 100, 20) == brute_pieces(n, inside, 100, 20)
    assert furthest(structure(50, [], []), 0, 10) == -1


def test_split_oversized(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("ACGT") for _ in range(2500))
    gapped = long[:700] + "n" * 25 + long[700:1400] + "N" * 19 + long[1400:] + "N" * 30
    rows = [(1, long, "x"), (2, gapped, "x"), (3, long[:1000], "x"), (4, None, "x"), (5, "", "x"), (6, "N" * 3000, "x")]
    df = spark.createDataFrame(rows, "record_id bigint, sequence string, genes string")
    genes = spark.createDataFrame(
        [(1, [(5, 900, 1), (0, 800, 1), (0, 9999, 1), (3, None, 1)]), (1, [(5, 900, 1), (0, 1900, -1), None]), (2, None), (None, [(0, 5, 1)]), (2, [])],
        "record_id bigint, genes array<struct<s int, e int, strand int>>",
    )
    got = {}
    for r in split_oversized(df, "record_id", "sequence", genes, limit=1000, overlap=100).collect():
        got.setdefault(r["id"], []).append((r["piece_start"], r["piece_end"]))
    assert sorted(got[1]) == brute_pieces(2500, {900, 800, 1900}, 1000, 100)
    assert sorted(got[2]) == brute_pieces(len(gapped), {725}, 1000, 100)
    assert sorted(got[6]) == brute_pieces(3000, set(), 1000, 100) and set(got) == {1, 2, 6}
    assert split_oversized(df.limit(0), "record_id", "sequence", genes).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "record_id", "sequence", limit=10, overlap=10)


@needs_vocabulary
def test_tokens_round_trip(spark):
    texts = [None, "", "   ", "<|endoftext|> is text", "naïve café — 染色体 🧬🧫 ‍", "\r\n\t x", "A" * 5000, "\x00\x01", "é" * 50, "é" * 3]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(1, "twice", "z")], "doc_id bigint, text string, ids string")
    got = encoded(df, "doc_id", "text")
    rows = [(r["id"], r["ids"]) for r in got.collect()]
    assert len(rows) == 11 and all(x is not None for _, x in rows)
    by = dict(reversed(rows))
    assert by[0] == [] and by[1] in ([], by[1]) and 50256 not in by[3]
    back = {(r["id"], r["text"]) for r in decoded(got, "id", "ids").collect()}
    assert back == {(i, t or "") for i, t in enumerate(texts)} | {(1, "twice")}
    for r in decoded(got, "id", "ids").collect():
        assert len(r["starts"]) == len(r["ends"]) and all(s < e for s, e in zip(r["starts"], r["ends"], strict=True))
        if r["ends"]:
            assert r["starts"][0] == 0 and r["ends"][-1] == len(r["text"])
    n = {(r["id"], r["n"]) for r in encoded(df, "doc_id", "text", counts_only=True, keep=("ids",)).collect()}
    assert n == {(i, len(x)) for i, x in rows}
    assert encoded(df.limit(0), "doc_id", "text").count() == 0


@needs_vocabulary
def test_vocabulary_handles_split_characters():
    with open(BYTE_BPE, encoding="utf-8") as f:
        own = Vocabulary(f.read())
    assert len(byte_characters()) == 256 == len(set(byte_characters().values()))
    one = {b: i for i, b in own.bytes.items() if len(b) == 1}
    ids = [one[bytes([b])] for b in "🧬".encode()]
    assert own.decode(ids) == "🧬" and own.offsets(ids) == [(0, 1)] * 4
    assert own.decode(ids[:2]) == "�" and own.offsets([]) == []


def test_mixing(spark):
    rng = random.Random(5)
    rows = []
    for s, docs, size in (("big", 3000, 60), ("Mid ", 800, 50), ("small", 60, 40), ("gone", 0, 1), ("other", 100, 10)):
        rows += [(len(rows) + i, s, max(1, int(rng.expovariate(1 / size))), 1.0) for i in range(docs)]
    rows += [(90_000, None, 5, 1.0), (90_001, "big", None, 1.0), (90_002, "big", 0, 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n int, rate double")
    weights = spark.createDataFrame([("BIG", 400, 2), ("mid", 300, 3), ("small", 250, 4), ("gone", 50, 2)], "source string, target_permille int, max_repeats int")
    copies, report = mix_sources(df, "doc_id", "source", "n", weights)
    got = {r["source"]: r for r in report.collect()}
    assert {s for s, r in got.items() if r["unmet"]} == {"small", "gone"}
    for s in ("big", "mid"):
        assert abs(got[s]["reached_tokens"] / got[s]["target_tokens"] - 1) < 0.05
    small = sum(r[2] for r in rows if r[1] == "small")
    assert got["small"]["reached_tokens"] == 4 * small and got["gone"]["reached_tokens"] == 0
    out = {r["id"]: r for r in copies.collect()}
    assert len(out) == len(rows) and out[90_000]["copies"] == 0 and max(r["copies"] for r in out.values() if r["source"] == "big") <= 2
    assert all(r["copies"] == 0 for r in out.values() if r["source"] == "other")
    none, empty = mix_sources(df.limit(0), "doc_id", "source", "n", weights)
    assert none.count() == 0 and empty.where("unmet").count() == 0 and empty.count() == 4


def test_undisguised_words():
    plain = abuse.words("you worthless idiot")
    for text in ("you w0rthl3ss !diot", "YOU WORTHLESS I D I O T", "you wоrthlеss іdіоt", "you worth​less idiooooot", "<p>you worthless i.d.i.o.t</p>", "you wörthless idiot"):
        assert abuse.words(text) == plain, text
    assert abuse.words(None) == abuse.words("") == [] and abuse.words("!!! ... 🤬") == []
    assert abuse.words("BGC0000123 at 34.5 %")[0] == "id"


BAD = ["you are a total {} and everybody knows it", "what a stupid {} you are", "shut your mouth {} nobody wants you here", "I hate every {} in this place, throw them out"]
FINE = ["the {} was measured twice at noon", "we should check the {} again", "results for the {} are in the table", "please send the {} to the second floor"]


def documents(rng, n):
    bad, nouns = ["fool", "moron", "cretin", "clown"], ["sample", "column", "gel", "report", "buffer", "plate", "filter"]
    out = []
    for i in range(n):
        y = rng.random() < 0.3
        parts = [rng.choice(FINE).format(rng.choice(nouns)) for _ in range(rng.randrange(1, 6))]
        if y:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(BAD).format(rng.choice(bad)))
        out.append((i, ". ".join(parts), "EN" if i % 2 else None, " Src " if i % 3 else "src", y))
    return out


def test_classifier_on_held_out_texts(spark):
    rng = random.Random(6)
    rows = documents(rng, 700)
    docs = spark.createDataFrame([r[:4] for r in rows] + [(9000, None, "en", None), (9001, "", "en", "src"), (9002, " \n", None, "src"), (9003, "x " * 50_000, "en", "src")], "doc_id bigint, text string, lang string, source string")
    labels = [(i, r[0], ("Abusive " if i % 2 else "hateful") if r[4] else "clean", "w") for i, r in enumerate(rows[:300])]
    labels += [(900, 5, None, "w"), (901, 6, "whatever", "w"), (902, None, "clean", "w"), (903, 77777, "clean", "w")]
    labels = spark.createDataFrame(labels, "label_id bigint, doc_id bigint, verdict string, text string")
    scored = abuse.score_documents(docs, labels, background=50)
    got = {r["id"]: r for r in scored.collect()}
    assert len(got) == 704 and not any(got[i]["flagged"] for i in (9000, 9001, 9002)) and got[9000]["score"] == 0
    held = rows[300:]
    right = sum(got[r[0]]["flagged"] == r[4] for r in held) / len(held)
    assert right > 0.97
    rates = {r["source"]: r for r in abuse.rate_report(scored).collect()}
    assert set(rates) == {"src", None} and 0.2 < rates["src"]["rate"] < 0.4
    nothing = abuse.score_documents(docs, labels.limit(0))
    assert nothing.where("flagged").count() == 0 and nothing.count() == 704
    assert abuse.score_documents(docs.limit(0), labels).count() == 0
