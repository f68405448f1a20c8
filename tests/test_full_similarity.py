"""Links and nearest records over all k-mers and all rows, against brute force."""

import random

import numpy as np
import pyarrow.compute
import pytest

from strandloom.operators import similarity
from strandloom.plans import registry


def seq(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def kmers(s, k=21):
    turned = s.upper()[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
    return {min(s.upper()[i : i + k], turned[len(s) - k - i : len(s) - i]) for i in range(len(s) - k + 1)}


@pytest.fixture(scope="module")
def rows():
    """Thirty variants of one text, parts of it, short texts and their parts, copies, and texts without k-mers."""
    rng = random.Random(5)
    base, short = seq(rng, 600), [seq(rng, 60) for _ in range(6)]
    out = [base[:i] + rng.choice("ACGT") + base[i + 1 :] for i in range(100, 400, 10)] + [base[:400], base[200:600][::-1].translate(str.maketrans("ACGT", "TGCA"))]
    out += [x for s in short for x in (s, s[:50], s[20:] + seq(rng, 30))] + [short[0], short[0].lower(), "NN" + short[1], "", "ACGT", None]
    return [(20 * i + 1, s) for i, s in enumerate(out)]


def brute(rows, least):
    once = {}
    for i, s in rows:
        if s is not None:
            once.setdefault(s, i)
    sets = {i: kmers(s) for s, i in once.items()}
    return {(a, b): len(x & y) / len(x) for a, x in sets.items() for b, y in sets.items() if a != b and x and len(x & y) / len(x) >= least}


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "record_id bigint, sequence string").write.parquet(f"{path}/mibig_records.parquet")
    return str(path)


def test_join_has_every_link_of_every_row(spark, rows, folder):
    want = brute(rows, 0.5)
    got = {(r["a"], r["b"]): r["containment"] for r in registry.queries()["jn17_all_links"](spark, folder).collect()}
    assert got == pytest.approx(want, abs=1e-6) and max(sum(a == x for a, _ in want) for x, _ in want) > 20
    classes = registry.queries()["jn17_link_classes"](spark, folder).collect()
    assert len(classes) == len(rows) and max(r["links"] for r in classes) > 20
    assert similarity.full_links(spark.createDataFrame([], "id bigint, s string"), "id", "s").count() == 0


def test_classes_and_summary_rest_on_all_kmers(spark, rows, folder):
    links = {(min(p), max(p)) for p in brute(rows, 0.6)}
    assert {(r["a"], r["b"]) for r in registry.queries()["sim10_full_links"](spark, folder).collect()} == links
    root = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    once = {}
    for i, s in rows:
        root[i] = root[once.setdefault(s, i)] if s is not None else i
    got = {r["record_id"]: r["class_id"] for r in registry.queries()["sim11_link_classes"](spark, folder).collect()}
    assert got == root
    summary = registry.queries()["sim12_set_summary"](spark, folder).first()
    assert (summary["rows"], summary["classes"]) == (len(rows), len(set(root.values())))


def test_nearest_is_the_greatest_containment(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, s string")
    sets = {i: kmers(s) for i, s in rows if s is not None}
    want = {}
    for a, x in sets.items():
        c, b = max(((len(x & y) / len(x), -b) for b, y in sets.items() if b != a and x & y), default=(0.0, None))
        want[a] = (b and -b, c)
    got = {r["id"]: (r["nearest"], r["max_containment"]) for r in similarity.full_nearest(df.where("s is not null"), df, "id", "s").collect()}
    assert got == want


def test_search_keeps_the_best_of_all(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, s string")
    sets = {i: kmers(s) for i, s in rows if s is not None}
    text = {i: s for i, s in rows}
    want = {}
    for a, x in sets.items():
        once = {}
        for b, y in sorted(sets.items()):
            if b != a and x & y:
                once.setdefault(text[b], (-len(x & y) / len(x), b))
        want[a] = [(b, -c) for c, b in sorted(once.values())[:3]]
    got = {a: [] for a in sets}
    for r in similarity.full_search(df.where("s is not null"), df, "id", "s").orderBy("id", (-similarity.F.col("containment")), "match_id").collect():
        got[r["id"]].append((r["match_id"], r["containment"]))
    assert got == want


def test_short_copies_are_found(spark):
    """Texts of a few letters, each delivered twice: every one is a copy of the other."""
    rng = random.Random(6)
    texts = [seq(rng, 24) for _ in range(40)]
    df = spark.createDataFrame([(2 * i + j, s) for i, s in enumerate(texts) for j in (0, 1)], "id bigint, s string")
    got = similarity.full_nearest(df, df, "id", "s").collect()
    assert len(got) == 80 and {r["tier"] for r in got} == {"FAIL"} and all(r["nearest"] == r["id"] ^ 1 for r in got)


def test_letters_as_they_are_written(spark):
    df = spark.createDataFrame([(1, "ACGTTGCAAGGTCA"), (2, "TGACCTTGCAACGT"), (3, "acgttgcaaggtca")], "id bigint, s string")
    assert similarity.full_search(df, df, "id", "s", 7, 3, False).count() == 0
    assert similarity.full_search(df, df, "id", "s", 7, 3).count() == 6


def test_greedy_distinct(spark):
    rng = random.Random(7)
    for n, m in ((12, 8), (30, 40), (30, 90)):
        links = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a < b}
        kept = []
        for i in range(n):
            if not any((j, i) in links for j in kept):
                kept.append(i)
        df = spark.createDataFrame([(i, f"t{i}") for i in range(n)] + [(n, "t0"), (n + 1, None)], "id bigint, s string")
        got = similarity.greedy_distinct(df, "id", "s", spark.createDataFrame(sorted(links), "a bigint, b bigint"))
        assert sorted(r["id"] for r in got.collect()) == kept
    none = spark.createDataFrame([], "id bigint, s string")
    assert similarity.greedy_distinct(none, "id", "s", spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_pairwise_summary(spark, rows):
    texts = sorted({s for _, s in rows if s is not None})
    sets = [kmers(s) for s in texts]
    values = sorted(len(x & y) / min(len(x), len(y)) if x & y else 0.0 for i, x in enumerate(sets) for y in sets[i + 1 :])
    middle = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
    r = similarity.pairwise_summary(spark.createDataFrame(rows, "id bigint, s string"), "id", "s").first()
    assert (r["texts"], r["pairs"], r["meeting"]) == (len(texts), len(values), sum(v > 0 for v in values))
    assert r["median"] == pytest.approx(middle) and r["greatest"] == pytest.approx(values[-1])
    empty = similarity.pairwise_summary(spark.createDataFrame([], "id bigint, s string"), "id", "s").first()
    assert empty["texts"] == 0 and empty["pairs"] == 0 and empty["greatest"] is None


def test_near_cleaned_splits(spark):
    rows = [(1, "train", "aa"), (2, "test", "aa"), (3, "test", "bb"), (4, "val", "cc"), (5, "val", "dd"), (6, "test", "ee"), (7, "val", None), (8, None, "aa"), (9, "val", "ff")]
    df = spark.createDataFrame(rows, "id bigint, split string, s string")
    links = spark.createDataFrame([(1, 4), (3, 5)], "a bigint, b bigint")
    got = {r["id"] for r in similarity.near_cleaned_splits(df, "id", "split", "s", links).collect()}
    assert got == {1, 3, 6, 7, 8, 9}


@pytest.fixture(scope="module")
def block():
    """Ninety edited copies of a block with own letters behind it, and texts of their own."""
    rng = random.Random(9)
    base = seq(rng, 80)
    out = [base[: (i := rng.randrange(80))] + rng.choice("ACGT") + base[i + 1 :] + seq(rng, rng.randrange(10, 90)) for _ in range(90)] + [base] + [seq(rng, 70) for _ in range(9)]
    return [(7 * i + 3, s) for i, s in enumerate(out)]


def refuse(*_):
    raise AssertionError("pairs are verified one by one")


def test_pairwise_summary_counts_pairs_of_a_common_block(spark, block, monkeypatch):
    """A block in most texts: nearly all pairs meet, and none is taken to its texts."""
    monkeypatch.setattr(similarity, "_shared_kmers", refuse)
    sets = [kmers(s) for _, s in block]
    values = sorted(len(x & y) / min(len(x), len(y)) for i, x in enumerate(sets) for y in sets[i + 1 :])
    r = similarity.pairwise_summary(spark.createDataFrame(block, "id bigint, s string"), "id", "s").first()
    assert (r["pairs"], r["meeting"]) == (len(values), sum(v > 0 for v in values)) and r["meeting"] > 3000
    assert r["median"] == pytest.approx((values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2) and r["greatest"] == values[-1]


@pytest.mark.parametrize("hot, owners", [(1, 8), (20, 40), (1000, 2048)])
def test_counts_of_both_ways_add_up(spark, block, hot, owners):
    sets = {i: kmers(s) for i, s in block}
    want = {(a, b): (len(x & y), len(x), len(y)) for a, x in sets.items() for b, y in sets.items() if a < b and x & y}
    keep = lambda *c: similarity.pa.RecordBatch.from_arrays([similarity.pa.array(x) for x in c], names=["a", "b", "n", "x", "y"])
    texts = similarity._texts(spark.createDataFrame(block, "id bigint, s string"), "id", "s")
    got = similarity._counted(texts, 21, "a bigint, b bigint, n bigint, x bigint, y bigint", keep, hot=hot, owners=owners, pairs=500).collect()
    assert {(r["a"], r["b"]): (r["n"], r["x"], r["y"]) for r in got} == want and len(got) == len(want)


@pytest.fixture(scope="module")
def block_folder(spark, block, tmp_path_factory):
    path = tmp_path_factory.mktemp("block")
    spark.createDataFrame(block, "record_id bigint, sequence string").write.parquet(f"{path}/mibig_records.parquet")
    return str(path)


def test_link_classes_of_a_common_block(spark, block, block_folder, monkeypatch):
    monkeypatch.setattr(similarity, "_shared_kmers", refuse)
    links = {(min(p), max(p)) for p in brute(block, 0.5)}
    got = {r["record_id"]: r["links"] for r in registry.queries()["jn17_link_classes"](spark, block_folder).collect()}
    assert got == {i: sum(i in p for p in links) for i, _ in block} and max(got.values()) > 50


def test_all_links_of_a_common_block(spark, block, block_folder, monkeypatch):
    monkeypatch.setattr(similarity, "_shared_kmers", refuse)
    got = {(r["a"], r["b"]): r["containment"] for r in registry.queries()["jn17_all_links"](spark, block_folder).collect()}
    assert got == pytest.approx(brute(block, 0.5), abs=1e-6) and len(got) > 500


def test_set_summary_of_a_common_block(spark, block, block_folder, monkeypatch):
    monkeypatch.setattr(similarity, "_shared_kmers", refuse)
    linked = {x for p in brute(block, 0.6) for x in p}
    r = registry.queries()["sim12_set_summary"](spark, block_folder).first()
    assert r["rows"] == len(block) and r["near_dup_share"] == pytest.approx(len(linked) / len(block)) and linked


@pytest.mark.parametrize("k", [1, 2, 3, 7, 8, 21, 31, 64])
def test_windows_are_put_together_in_few_steps(k):
    """The value of a window is the plain polynomial of its letters, from windows of half the width each."""
    rng = random.Random(k)
    base = 0x9E3779B97F4A7C15
    codes = [rng.randrange(2**21) for _ in range(150)]
    for backward in (False, True):
        powers = [pow(base, j if backward else k - 1 - j, 2**64) for j in range(k)]
        want = [sum(c * p for c, p in zip(codes[i:], powers, strict=False)) % 2**64 for i in range(len(codes) - k + 1)]
        assert similarity._windows(np.array(codes, np.uint64), k, base, backward).tolist() == want


def test_hashes_of_strands_and_of_letters_beyond_one_byte():
    for text in ("ACGTTGCAACCGN", "acgtACGTAC", "ACGT\u00e9ACG\u4e2dTTACG", "\u00c1CGT"):
        turned = text[::-1].translate(str.maketrans("ACGT", "TGCA"))
        for k in (1, 3, 4):
            own = similarity._kmer_hashes(text, k)
            assert own.tolist() == similarity._kmer_hashes(turned, k).tolist() == sorted(set(own.tolist()))
            least = {min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))) for w in (text[i : i + k] for i in range(len(text) - k + 1))}
            assert len(own) == len(least)
            assert len(similarity._kmer_hashes(text, k, False)) == len({text[i : i + k] for i in range(len(text) - k + 1)})


def test_entries_of_parts_are_those_of_the_texts(spark):
    """However the owners are sorted along with the k-mers, each part has every (k-mer, text) once."""
    rng = random.Random(5)
    texts = {i * 10**12 - 7: "".join(rng.choice("ACGT") for _ in range(rng.randrange(5, 90))) for i in range(60)}
    packed = [(i, bytearray(similarity.zlib.compress(t.encode())), len(t)) for i, t in texts.items()]
    df = spark.createDataFrame(packed, "item bigint, packed binary, length int")
    for block in (100, 1 << 22):
        rows = similarity._kmer_parts(df, 9, block=block, held=300).toArrow()
        bits = np.uint64(64 - similarity._cut_bits(sum(map(len, texts.values()))))
        got = []
        for part in set(rows["part"].to_pylist()):
            h, owner = similarity._entries(rows.filter(pyarrow.compute.equal(rows["part"], part)))
            assert (np.diff(h.astype(np.int64)) >= 0).all()
            got += zip(h.tolist(), owner.tolist(), strict=True)
        assert sorted(got) == sorted((int(h), i) for i, t in texts.items() for h in similarity._kmer_hashes(t, 9) >> bits)


def test_links_read_the_table_once_and_send_kmers_without_owners(spark, rows, folder, monkeypatch):
    monkeypatch.setattr(similarity, "_texts", refuse)
    monkeypatch.setattr(similarity, "_kmer_parts", refuse)
    got = {(r["a"], r["b"]): r["containment"] for r in registry.queries()["jn17_all_links"](spark, folder).collect()}
    assert got == pytest.approx(brute(rows, 0.5), abs=1e-6) and got


def test_met_kmers_are_all_that_two_texts_share(spark, block):
    """With blocks and parts of few k-mers, long masked stretches and a text that repeats itself."""
    sets = {i: "N" * 60 + s if i % 2 else s for i, s in block} | {-5: "ACGGT" * 40}
    want = {i: similarity._kmer_hashes(s, 21) for i, s in sets.items()}
    held = np.concatenate(list(want.values()))
    several = {int(h) for h, n in zip(*np.unique(held, return_counts=True), strict=True) if n > 1}
    met, parts = similarity._met_kmers(similarity._distinct_texts(spark.createDataFrame(list(sets.items()), "id bigint, s string"), "id", "s"), 21, entries=300)
    table = met.toArrow()
    assert parts > 20 and {i: n for items, sizes, _ in similarity._arrays(table, 0, np.int64, np.int64, np.uint8) for i, n in zip(items.tolist(), sizes.tolist(), strict=True)} == {i: len(h) for i, h in want.items()}
    got = [(int(items[at]), int(h)) for items, grams, own in similarity._arrays(table, 1, np.int64, np.uint64, np.uint32) for h, at in zip(grams, own, strict=True)]
    assert len(got) == len(set(got)) and {(i, int(h)) for i, own in want.items() for h in own if int(h) in several} <= set(got)
    assert len(got) < len(held) and all(h in set(want[i].tolist()) for i, h in got[:500])


def test_steps_of_sorted_values_come_back():
    rng = random.Random(11)
    values = np.array(sorted(2**40 + rng.randrange(2**32) for _ in range(3000)) + [2**40 + 2**32 - 1] * 2, np.uint64)
    for some in (values, values[:1], values[-2:], values[:1].repeat(2)):
        assert similarity._of_steps(*similarity._short_steps(some)).tolist() == some.tolist()


def test_classes_read_the_texts_once(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, s string")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    links = spark.createDataFrame([(a, b) for a, b in brute(rows, 0.6) if a < b], "a bigint, b bigint")
    summary = similarity.set_summary(similarity.link_classes(df.mapInArrow(counted, df.schema), "id", "s", links)).first()
    assert summary["rows"] == len(rows) == reads.value and summary["largest"] > 20
