import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import names as N

SAME = [
    ["Gokidro Mizisuk Contracting FZE", "gokidro mizisuk contracting", "M/s Gokidro Mizisuk Contracting L.L.C.", "Mizisuk Gokidro Contracting", "Gokidro-Mizisuk  Contracting (FZE)", "Gokidro Mzisuk Contracting", "Gokidor Mizisuk Contracting", "GokidroMizisuk Contracting", "Gokidro & Mizisuk Contracting / Alex", "Gokid. Mizisuk Contracting"],
    ["Thomas Brihirkothi", "Brihirkothi, Thomas", "Tom Brihirkothi", "Mr. Thomas B. Brihirkothi", "T. Brihirkothi", "THOMAS BRIHIRKOTI"],
    ["Katherine Brihirkothi", "Kathy Brihirkothi"],
    ["Lithahor Fogra Retail FZE", "Lithahor Fogra FZE"],
    ["Plodet Raguva Retail LLC"],
    ["Zofemau Mauvus Joinery Works", "Zofemau Mauvus", "Zofemau Mauvus JW"],
]


@pytest.fixture(scope="module")
def groups(spark):
    names = [("client", n) for g in SAME for n in g] + [("supplier", "Thomas Brihirkothi"), ("client", None), ("client", "  "), ("client", "L.L.C."), ("client", "x" * 4000), (None, "Nobody")]
    # words that stand on several names may be dropped
    names += [("client", f"{a} {b} {c}") for a, b in zip(("Dugothel", "Kawopur", "Hiaraund", "Besekash", "Nemaste", "Wulokim"), ("Stevox", "Klabre", "Nomapa", "Trefum", "Desesti", "Pauwond")) for c in ("Retail", "Joinery Works")]
    got = N.link(spark.createDataFrame(names + names[:5], "kind string, name string")).collect()
    return {(r["kind"], r["name"]): r["group"] for r in got}


@pytest.mark.parametrize("group", SAME, ids=lambda g: g[0])
def test_spellings_of_one_name_are_linked(groups, group):
    assert len({groups["client", n] for n in group}) == 1


def test_different_names_and_kinds_stay_apart(groups):
    firsts = [groups["client", g[0]] for g in SAME] + [groups["supplier", "Thomas Brihirkothi"], groups["client", "L.L.C."], groups["client", "x" * 4000]]
    assert len(set(firsts)) == len(firsts)
    assert ("client", "  ") not in groups and (None, "Nobody") not in groups


def test_ambiguous_initials_are_not_linked(spark):
    names = ["Thomas Brihirkothi", "Theodore Brihirkothi", "T Brihirkothi"]
    got = {r["name"]: r["group"] for r in N.link(spark.createDataFrame([("c", n) for n in names], "kind string, name string")).collect()}
    assert len(set(got.values())) == 3


def test_empty_table(spark):
    assert N.link(spark.createDataFrame([], "kind string, name string")).count() == 0


def test_index_finds_every_pair_that_brute_force_finds(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 10)))
    base = [sorted([word(), word()]) for _ in range(25)]

    def edit(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]])

    every = {tuple(sorted(b)) for b in base} | {tuple(sorted([edit(b[0]), b[1]])) for b in base} | {tuple(sorted([b[0], edit(edit(b[1]))])) for b in base}
    rows = [(i, "c", list(w), ["".join(w)]) for i, w in enumerate(sorted(every))]
    sigs = spark.createDataFrame(rows, "sig bigint, kind string, words array<string>, runs array<string>")
    got = {tuple(r) for r in N.firm_edges(sigs).select(F.least("a", "b"), F.greatest("a", "b")).collect()}
    want = set()
    for (i, _, a, ra), (j, _, b, rb) in itertools.combinations(rows, 2):
        if N.align(a, b) <= 0.75 or ra == rb:
            want.add((i, j))
    assert want <= got


@pytest.mark.parametrize("a, b, linked", [("mizisuk", "mizsuk", True), ("mizisuk", "mziisuk", True), ("mizisuk", "mzsk", True), ("gikau", "gkau", True), ("gikau", "gukao", False), ("abc", "abd", False)])
def test_word_cost(a, b, linked):
    assert (N.word_cost(a, b) <= 1) == linked


@pytest.mark.parametrize("n", [1, 2, 5, 6])
def test_assignment_is_optimal(n):
    rng = random.Random(n)
    for _ in range(60):
        costs = [[rng.choice([0.25, 0.5, 0.4, 9.0, 1.0]) for _ in range(n)] for _ in range(n)]
        assert N.assignment(costs) == pytest.approx(min(sum(costs[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n))))


def test_names_of_many_words_are_aligned_whole():
    a, b = ([f"abcdefgh{i}{end}" for i in range(30)] for end in "xy")
    assert N.align(a, b) == pytest.approx(7.5) and N.align(a[:3] + b[3:], b) == pytest.approx(0.75)


@pytest.mark.parametrize("length", [25, 40, 90, 500])
def test_long_words_meet_within_two_edits(spark, length):
    rng = random.Random(length)
    word = "".join(rng.choice("abcdefgh") for _ in range(length))
    cut = length * 2 // 5
    others = [word[:cut] + word[cut + 1 :], word[: cut - 1] + word[cut] + word[cut - 1] + word[cut + 1 :], word[:3] + "z" + word[3:cut] + "z" + word[cut:], word[1:-1]]
    others.append(word[: cut - 1] + word[cut] + word[cut - 1] + word[cut + 1 : -2] + word[-1] + word[-2])  # two swaps
    far = "zz" + word[:cut] + "z" + word[cut:]
    sigs = spark.createDataFrame([(i, "c", [w], [w]) for i, w in enumerate([word, *others, far])], "sig bigint, kind string, words array<string>, runs array<string>")
    near = {r["other"] for r in N.near_words(sigs).filter(F.col("word") == word).collect()}
    assert near == set(others)


def test_alignment_is_optimal():
    rng = random.Random(3)
    for _ in range(200):
        a = ["".join(rng.choice("abc") for _ in range(rng.randint(4, 6))) for _ in range(3)]
        b = ["".join(rng.choice("abc") for _ in range(rng.randint(4, 6))) for _ in range(3)]
        left, right = list(a), list(b)
        for w in set(a) & set(b):
            left.remove(w)
            right.remove(w)
        best = min((sum(N.word_cost(x, y) for x, y in zip(left, p)) for p in itertools.permutations(right)), default=0.0)
        assert min(N.align(a, b), 9) == pytest.approx(min(best, 9))


def edited(rng, w):
    i = rng.randrange(len(w))
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]])


def test_index_finds_edits_in_several_words(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 10)))
    every = set()
    for _ in range(15):
        a, b, c = word(), word(), word()
        every |= {(a, b), (edited(rng, a), edited(rng, b)), (edited(rng, edited(rng, a)), edited(rng, b)), (a[0] + a[1:-1].translate(str.maketrans("", "", "aeiou")) + a[-1], edited(rng, b))}
        every |= {(a, b, c), (edited(rng, a), edited(rng, b), c), (edited(rng, a), edited(rng, b), edited(rng, c))}
    rows = [(i, "c", sorted(w), ["".join(w)]) for i, w in enumerate(sorted({tuple(sorted(w)) for w in every}))]
    sigs = spark.createDataFrame(rows, "sig bigint, kind string, words array<string>, runs array<string>")
    got = {tuple(r) for r in N.firm_edges(sigs).select(F.least("a", "b"), F.greatest("a", "b")).collect()}
    want = {(x[0], y[0]) for x, y in itertools.combinations(rows, 2) if N.align(x[2], y[2]) <= 0.75 or x[3] == y[3]}
    assert got == want and any(not set(rows[i][2]) & set(rows[j][2]) and len(rows[i][2]) == 3 for i, j in want)


@pytest.mark.parametrize("common", [400, 0])
def test_misspelt_names_link_whether_or_not_their_words_are_common(spark, monkeypatch, common):
    monkeypatch.setattr(N, "COMMON", common)  # 0: no word is common, as no surname is in a large table
    pairs = [("Fabraunufazl Yuosef", "Yousef Fabraunufazol"), ("Brihirkothi Nico", "Nick Brihirkoti")]
    others = [f"{first} Brihirkothi" for first in ("Ursula", "Penelope", "Gregory", "Deborah", "Charles", "Fatima")]
    got = {r["name"]: r["group"] for r in N.link(spark.createDataFrame([("client", n) for n in [*sum(pairs, ()), *others]], "kind string, name string")).collect()}
    assert all(got[a] == got[b] for a, b in pairs) and len(set(got.values())) == 8


def test_short_words_link_beside_misspelt_ones(spark):
    same = [("Thomas Nomapa", "T. Nompa"), ("Katherine Plodet Raguva", "Kathy Plodett Raguvva"), ("William Fogra", "Bill Fogrra"), ("Gregory Zofemau Mauvus", "Greg Zofemu Mauvus")]
    apart = ["Daniel Hautrem Vesokom", "Deborah Hautrem Vesokom", "D. Hautrm Vesokom"]
    got = {r["name"]: r["group"] for r in N.link(spark.createDataFrame([("client", n) for n in [*sum(same, ()), *apart]], "kind string, name string")).collect()}
    assert all(got[a] == got[b] for a, b in same) and len(set(got.values())) == 7
