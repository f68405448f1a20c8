"""Lists of one frequent gram over many unlike sets."""

import math
import random
from itertools import combinations

import pytest

from strandloom.llm import near_dup
from strandloom.llm.near_dup import candidate_pairs, shared_grams


def test_unlike_leaders_of_different_parts_meet(spark):
    """169 sets hold one gram; any two share at most one more, so no round absorbs a leader and all meet only there."""
    rows = [(13 * a + b, 13 * a + b, 100, [1 << 40, *((2 + 13 * s + (a * s + b) % 13) << 41 for s in range(6))]) for a in range(13) for b in range(13)]
    want = {(x, y) for x, _, _, g in rows for y, _, _, h in rows if x < y and len(set(g) & set(h)) > 1}
    found = {tuple(r) for r in candidate_pairs(spark.createDataFrame(rows, "item bigint, kind bigint, letters int, grams array<bigint>"), most=16, crowd=8).collect()}
    assert want <= found and len(want) > 1000


def test_shared_grams_are_counted_whole(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(20), sorted({rng.randrange(-60, 60) << 4 | rng.randrange(16) for _ in range(rng.randrange(0, 9))})) for i in range(150)]
    want = {}
    for _, kind, grams in rows:
        for g in grams:
            n, kinds = want.setdefault(g >> 4, (0, set()))
            want[g >> 4] = (n + 1, kinds | {kind})
    sets = spark.createDataFrame(rows, "item bigint, kind bigint, grams array<bigint>").repartition(5)
    for entries in (7, 1_000_000):
        got = {r["gram"]: r["df"] for r in shared_grams(sets, entries).collect()}
        assert got == {g: n for g, (n, kinds) in want.items() if len(kinds) > 1}
    assert shared_grams(sets.limit(0)).count() == 0


def test_alike_sets_of_one_kind_stand_for_each_other(spark):
    """Two kinds of 200 alike sets each share a stretch: the second look pairs the kinds without all pairs of their sets."""
    rng = random.Random(4)
    shared, own = [rng.getrandbits(58) << 4 for _ in range(6)], [[rng.getrandbits(58) << 4 for _ in range(40)] for _ in range(2)]
    rows = [(1000 * k + i, 1000 * k, 500, sorted(shared + rng.sample(own[k], 36))) for k in (0, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "item bigint, kind bigint, letters int, grams array<bigint>")
    found = [tuple(r) for r in candidate_pairs(df, crowd=32).collect()]
    assert 0 < len(found) < 2000 and all((a < 1000) != (b < 1000) for a, b in found)


def test_lengths_and_places(spark):
    grams = [(3 + i) << 30 for i in range(4)]
    rows = [(1, 1, 5000, [g | 2 for g in grams]), (2, 2, 4500, [g | 2 for g in grams]), (3, 3, 5000, [grams[0] | 1, grams[1] | 9, grams[2] | 12]), (4, 4, 2000, [g | 2 for g in grams])]
    df = spark.createDataFrame(rows, "item bigint, kind bigint, letters int, grams array<bigint>")
    # 1 and 2 share one place only; 4 fits nobody in length
    assert {tuple(r) for r in candidate_pairs(df, ratio=0.78, apart=2).collect()} <= {(1, 3), (2, 3)}
    assert {(1, 2), (1, 3), (2, 3)} == {tuple(r) for r in candidate_pairs(df, ratio=0.78).collect()}


@pytest.fixture(scope="module")
def chance():
    """400 sets of grams drawn from few, as those of a large collection are, among them tiny ones and alike ones of one kind,
    and the pairs that hold by the scalar rules."""
    rng = random.Random(8)
    rows = []
    for i in range(400):
        kind = i if i % 7 else i - i % 21
        grams = {rng.randrange(1, 900) << 46: rng.randrange(16) for _ in range(rng.choice([2, 3, 12, 20, 20]))}
        grams |= {(1000 + j) << 46: i % 16 if i % 3 else 5 * j for j in range(3) if i % 4 == 0}
        grams = sorted(g << 4 | place for g, place in grams.items())
        rows.append((3 * i - 50, 3 * kind - 50, rng.choice([150, 390, 450, 900, 1100, 1300]), grams))
    want = set()
    for (a, kind_a, n_a, x), (b, kind_b, n_b, y) in combinations(rows, 2):
        places = {g >> 4: 1 << (g & 15) for g in y}
        mark, shared = 0, {g >> 4 for g in x} & set(places)
        for g in shared:
            mark |= places[g]
        if kind_a != kind_b and min(n_a, n_b) >= 0.78 * max(n_a, n_b) and shared:
            if len(x) <= 3 and len(y) <= 3 or len(shared) >= 2 and near_dup._spread(mark, n_b, 2):
                want.add((a, b))
    return rows, want


@pytest.mark.parametrize(("crowd", "entries"), [(1000, 1_000_000), (1000, 50), (8, 1_000_000), (1, 300)])
def test_sets_are_not_sent_with_each_gram_they_share(spark, monkeypatch, chance, crowd, entries):
    """What unlike sets share by chance, and what crowded lists hold, is counted: neither goes with all its grams to a tree."""
    rows, want = chance

    def never(*_):
        raise AssertionError("sets sent whole")

    monkeypatch.setattr(near_dup, "_trees", never)
    monkeypatch.setattr(near_dup, "_between_parts", never)
    df = spark.createDataFrame(rows, "item bigint, kind bigint, letters int, grams array<bigint>").repartition(3)
    found = candidate_pairs(df, crowd=crowd, alike=math.inf, ratio=0.78, apart=2, entries=entries).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 100


def test_products_and_single_pairs_count_alike(spark, chance):
    rows, want = chance
    df = spark.createDataFrame([(*r, len(r[3]) <= 3) for r in rows], "item bigint, kind bigint, letters int, grams array<bigint>, tiny boolean")
    for owners, dense in ((30, 1), (2048, 4096)):
        assert {tuple(r) for r in near_dup._crowded_pairs(df, 2, 0.78, 2, owners, dense).collect()} == want
