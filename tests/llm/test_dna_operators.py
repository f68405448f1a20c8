"""Near-duplicates, shared spans and cross-split overlaps against brute force on small, hostile fixtures."""

import random

import numpy as np
import pytest

from strandloom.llm import dna
from strandloom.llm.cross_split import overlap_report, split_overlaps
from strandloom.llm.near_dup import _Tree, candidate_pairs, class_pairs, near_duplicates
from strandloom.llm.shared_spans import aligned_passages, chain, passages, shared_report, shared_spans

SCHEMA = "record_id bigint, sequence string, id string, class_id string, seq string, side string, letters string, split string, source string"


def seq(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def turned(s):
    return s[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))


def edited(rng, s, rate):
    out = []
    for c in s:
        r = rng.random()
        if r < rate * 0.6:
            out.append(rng.choice("ACGT".replace(c, "")))
        elif r < rate * 0.8:
            out.append(c + rng.choice("ACGT"))
        elif r >= rate:
            out.append(c)
    return "".join(out)


def table(spark, rows):
    """rows: (id, sequence[, split, source]); the other columns clash with names the operators use inside."""
    full = [(r[0], r[1], "x", "y", "z", "s", "l", r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_codes_and_kmers():
    column = __import__("pyarrow").array(["ACGTN-acgt", None, "", "é" + "ACGT" * 3])
    got = list(dna.encoded(column, dna.CODE))
    assert [n for x in got for n in x[4]] == [10, 0, 0, 13]
    stripped = list(dna.encoded(column, dna.LETTERS))
    assert [n for x in stripped for n in x[4]] == [9, 0, 0, 13]
    rng = random.Random(1)
    codes = np.array([rng.randrange(5) for _ in range(200)], np.uint8)
    for k in (1, 2, 11, 16, 31):
        forward, backward, valid = dna.packed(codes, k)
        for i in range(len(codes) - k + 1):
            w = codes[i : i + k]
            assert valid[i] == (w < 4).all()
            if valid[i]:
                assert forward[i] == sum(int(c) << (2 * (k - 1 - j)) for j, c in enumerate(w))
                assert backward[i] == sum((3 - int(c)) << (2 * j) for j, c in enumerate(w))
    assert (dna.from_bits(dna.to_bits(codes)) == np.minimum(codes, 4)).all()
    assert len(dna.from_bits(dna.to_bits(codes[:0]))) == 0


def test_minimizers_cover_every_window():
    rng = random.Random(2)
    codes = np.array([rng.randrange(4) for _ in range(500)], np.uint8)
    forward, _, valid = dna.packed(codes, 11, both=False)
    at = set(dna.minimizers(dna.mixed(forward), valid, 20).tolist())
    assert all(at & set(range(i, i + 20)) for i in range(len(forward) - 19))
    assert set(dna.minimizers(dna.mixed(forward[100:300]), valid[100:300], 20).tolist()) & set(range(19, 150)) == {x - 100 for x in at} & set(range(19, 150))


@pytest.fixture(scope="module")
def family(spark):
    rng = random.Random(3)
    base = seq(rng, 1500)
    a, b, c = base[:500], base[500:1000], base[1000:]
    rows = [
        (1, base),
        (2, base.lower()),
        (3, turned(base)),
        (4, edited(rng, base, 0.1)),
        (5, b + turned(a) + c),
        (6, base[:300] + seq(rng, 1200)),  # one shared block only
        (7, seq(rng, 1500)),
        (8, None),
        (9, ""),
        (10, "N" * 400),
        (11, base[:59]),
        (12, "A" * 3000),  # low complexity
        (13, "A" * 2900),
        (14, seq(rng, 20_000)),
        (15, base[:700] + "-" * 30 + base[700:]),
    ]
    return rows


def test_near_duplicates(spark, family):
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in near_duplicates(table(spark, family), "record_id", "sequence").collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 12, 13, 14, 15}
    assert {i for i, (c, _) in got.items() if c == 1} == {1, 2, 3, 4, 5, 15}
    assert got[12][0] == got[13][0] == 12
    assert got[6] == (6, 0) and got[7] == (7, 0) and got[14] == (14, 0)
    assert got[1][1] == 5


def test_class_pairs_and_empty(spark, family):
    classes = near_duplicates(table(spark, family), "record_id", "sequence")
    assert pairs(class_pairs(classes)) == {(a, b) for a in (1, 2, 3, 4, 5, 15) for b in (1, 2, 3, 4, 5, 15) if a < b} | {(12, 13)}
    assert near_duplicates(table(spark, []), "record_id", "sequence").count() == 0


def test_tree_finds_what_sets_share():
    rng = random.Random(4)
    sets = [sorted(rng.sample(range(60), rng.randrange(1, 20))) for _ in range(80)]
    tree = _Tree()
    for i, s in enumerate(sets[:-1]):
        tree.insert(s, i)
    for need in (1, 2, 4, 7):
        want = {i: len(set(s) & set(sets[-1])) for i, s in enumerate(sets[:-1]) if len(set(s) & set(sets[-1])) >= need}
        assert {i: n for i, (n, _) in tree.search(sets[-1], need).items()} == want


def test_crowded_lists_keep_their_links(spark):
    """One gram list over everything, in parts and with leaders: the classes stay whole."""
    rng = random.Random(5)
    rows = []
    for k in range(3):
        core = [rng.getrandbits(58) << 4 for _ in range(30)]
        for i in range(60):
            rows.append((100 * k + i, 100 * k + i, 100, sorted({1 << 40, *rng.sample(core, 27), *(rng.getrandbits(58) << 4 for _ in range(3))})))
    sets = spark.createDataFrame(rows, "item bigint, kind bigint, letters int, grams array<bigint>")
    found = pairs(candidate_pairs(sets, need=2, crowd=8, most=16, trust=True))
    near = {i: {i} for i, *_ in rows}
    for a, b in found:
        assert a < b
        group = near[a] | near[b]
        for x in group:
            near[x] = group
    for k in range(3):
        assert {100 * k + i for i in range(60)} <= near[100 * k]
    assert len(found) < 180 * 60


def brute_spans(rows, span):
    own = {}
    for i, s in rows:
        for p in range(len(s or "") - span + 1):
            w = s[p : p + span].upper()
            if set(w) <= set("ACGT"):
                own.setdefault(w, set()).add(i)
    out = set()
    for i, s in rows:
        covered = [False] * len(s or "")
        for p in range(len(s or "") - span + 1):
            if len(own.get(s[p : p + span].upper(), ())) > 1:
                covered[p : p + span] = [True] * span
        p = 0
        while p < len(covered):
            if covered[p]:
                e = p
                while e < len(covered) and covered[e]:
                    e += 1
                out.add((i, p, e))
                p = e
            else:
                p += 1
    return out


def test_shared_spans(spark):
    rng = random.Random(6)
    x, y = seq(rng, 400), seq(rng, 130)
    rows = [
        (1, seq(rng, 200) + x + seq(rng, 50)),
        (2, seq(rng, 33) + x[100:350].lower() + seq(rng, 70) + y),
        (3, y + y + seq(rng, 20)),
        (4, x[:99] + seq(rng, 300)),
        (5, y[:60] + "N" + y[60:]),
        (6, "ACGT" * 60),
        (7, "ACGT" * 40 + seq(rng, 30)),
        (8, turned(x)),
        (9, None),
        (10, ""),
        (11, seq(rng, 150) * 2),
        (12, x[50:250] + x[150:400]),
        (13, seq(rng, 5) + x),
        (14, x),
    ]
    df = table(spark, [*rows, (15, "é" + x[:120])])
    want = brute_spans([*rows, (15, "é" + x[:120])], 100)
    spans = shared_spans(df, "record_id", "sequence")
    assert pairs(spans) == want
    report = {r["id"]: r for r in shared_report(df, "record_id", "sequence", spans).collect()}
    assert report[14]["share"] == 1.0 and report[9]["share"] is None and report[10]["share"] == 0.0 and report[8]["shared"] == 0
    assert shared_spans(table(spark, []), "record_id", "sequence").count() == 0


def test_random_spans(spark):
    rng = random.Random(7)
    pieces = [seq(rng, rng.randrange(40, 160)) for _ in range(12)]
    rows = [(i, "".join(rng.choice([*pieces, seq(rng, 30), "NN"]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    want = brute_spans(rows, 60)
    assert pairs(shared_spans(table(spark, rows), "record_id", "sequence", span=60, k=21)) == want
    for most in (1, 3, 8):
        # nearly all, or the frequent seeds, take the path by windows
        assert pairs(shared_spans(table(spark, rows), "record_id", "sequence", span=60, k=21, most=most)) == want


def test_chains():
    x, y, size = np.array([0, 50, 500, 120]), np.array([0, 52, 10, 125]), np.array([40, 50, 40, 60])
    got = chain(x, y, size, 0.2)
    assert got[0] == got[1] == got[3] != got[2]


def test_passages_follow_edits(spark):
    rng = random.Random(8)
    s = seq(rng, 1200)
    other = s[:300] + "A" + s[300:700] + s[705:]
    runs = passages(table(spark, [(1, s), (2, other)]), "record_id", "sequence").collect()
    assert len({r["chain"] for r in runs}) == 1 and sum(r["size"] for r in runs) >= 1190
    assert all(s[r["at_a"] : r["at_a"] + r["size"]] == other[r["at_b"] : r["at_b"] + r["size"]] for r in runs)


@pytest.mark.parametrize("span", [300, 1000])
def test_long_spans(spark, span):
    rng = random.Random(11)
    x = seq(rng, span + 40)
    rows = [(1, seq(rng, 70) + x + seq(rng, 30)), (2, x[10:] + seq(rng, 100)), (3, x[: span - 1]), (4, x[:150] + "N" + x[151:]), (5, seq(rng, 2000)), (6, None), (7, x[20:])]
    want = brute_spans(rows, span)
    assert want and pairs(shared_spans(table(spark, rows), "record_id", "sequence", span=span)) == want
    assert pairs(shared_spans(table(spark, rows), "record_id", "sequence", span=span, most=1)) == want


def test_aligned_passages(spark):
    rng = random.Random(12)
    s = seq(rng, 1200)
    other = seq(rng, 50) + s[:300] + "A" + s[300:700] + s[705:]
    alone = seq(rng, 500)
    rows = [(1, s), (2, other), (3, alone), (4, alone[:200]), (5, None), (6, "")]
    got = {(r["a"], r["b"]): r for r in aligned_passages(table(spark, rows), "record_id", "sequence").collect()}
    r = got[1, 2]
    assert set(got) == {(1, 2), (3, 4)}
    assert (r["start_a"], r["end_a"], r["start_b"], r["end_b"]) == (0, 1200, 50, 1246) and 1 <= r["edits"] <= 6 and r["identity"] > 0.994
    assert (got[3, 4]["exact"], got[3, 4]["edits"], got[3, 4]["identity"]) == (200, 0, 1.0)
    assert aligned_passages(table(spark, []), "record_id", "sequence").count() == 0


def test_split_overlaps(spark):
    rng = random.Random(9)
    s, t = seq(rng, 900), seq(rng, 2000)
    rows = [
        (1, s, "train", "a"),
        (2, s, "val", "a"),
        (3, edited(rng, turned(s), 0.1), "test", "b"),
        (4, t, "train", "b"),
        (5, t[600:1300], "test", None),
        (6, t[:300] + seq(rng, 700), "val", "b"),
        (7, t[:250] + t[1500:1800], "val", "b"),  # two parts of the training record far apart
        (8, s, None, "a"),
        (9, None, "val", "a"),
        (10, s[:40], "val", "a"),
        (11, s[450:] + s[:450], "val", "a"),
        (12, s, "train", "c"),
        (13, s, "extra", "c"),
    ]
    df = table(spark, rows)
    found = split_overlaps(df, "record_id", "sequence", "split")
    assert {(r["eval_id"], r["train_id"]) for r in found.collect()} == {(e, t_) for e in (2, 3, 11) for t_ in (1, 12)} | {(5, 4)}
    report = {(r["split"], r["source"]): r for r in overlap_report(df, found, "record_id", "split", "source").collect()}
    assert report["val", "a"]["records"] == 4 and report["val", "a"]["leaked"] == 2 and report["test", None]["exact"] == 1
    assert {(r["eval_id"], r["train_id"]) for r in split_overlaps(df, "record_id", "sequence", "split", crowd=0).collect()} == {(e, t_) for e in (2, 3, 11) for t_ in (1, 12)} | {(5, 4)}
    assert split_overlaps(table(spark, []), "record_id", "sequence", "split").count() == 0


def test_one_content_in_a_third_of_all_rows(spark):
    rng = random.Random(10)
    s = seq(rng, 400)
    rows = [(i, s if i % 3 == 0 else seq(rng, 300), "train" if i % 2 else "test", "x") for i in range(300)]
    df = table(spark, rows)
    classes = near_duplicates(df, "record_id", "sequence")
    assert classes.where("class_id = 0").count() == 100 and classes.where("class_id = 0 and n_links = 99").count() == 100
    assert split_overlaps(df, "record_id", "sequence", "split").count() == 50 * 50
    assert shared_spans(df, "record_id", "sequence").count() == 100
