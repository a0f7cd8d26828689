import itertools
import random

import numpy as np
import pytest

from attesta.llm import minhash
from attesta.llm.common import connected_components
from llm_rows import words


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, percent):
    sets = {k: shingles(t) for k, t in rows}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: (len(sets[k]), root(k), root(k) == k) for k in sets}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_brute_force(docs, rows, percent):
    assert found(minhash.near_duplicates(docs, percent)) == brute([r[:2] for r in rows], percent)


@pytest.mark.parametrize("percent", [80, 85])
def test_crowds_of_versions_equal_brute_force(spark, percent):
    """Versions of two texts with 0 to 9 changes, near the threshold on both sides, some of which build on each other; no text they derive from need be there."""
    r = random.Random(percent)
    rows = []
    for base in (words(9, 150), words(10, 60)):
        made = [base.split()]
        for k in range(90):
            w = list(made[r.randrange(len(made))] if k % 3 == 0 else made[0])
            for _ in range(k % 10):
                at = r.randrange(len(w))
                w[at : at + r.randint(0, 2)] = [f"edit{r.random()}"]
            made.append(w)
        rows += [(len(rows) + i, " ".join(w)) for i, w in enumerate(made[1:])]
    assert found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), percent)) == brute(rows, percent)


def test_a_crowd_makes_few_pairs(spark):
    """Versions that differ from their text too much to be linked are told apart without pairing them."""
    base = words(9, 150).split()
    rows = []
    for k in range(300):
        w = list(base)
        for j in range(6):
            w[(37 * k + 23 * j) % 150] = f"edit{k}x{j}"
        rows.append((k, k, " ".join(w)))
    texts = spark.createDataFrame(rows, "set bigint, label bigint, text string")
    pairs = minhash._pairs(minhash._leading(texts.select("set", "label"), texts.select("set", "text"), 85, 5), 85)
    assert pairs.count() < 300


def test_empty_nameless_and_repeated_rows(spark, empty):
    assert minhash.near_duplicates(empty, 85).count() == 0
    a, b = words(21, 40), words(22, 40)
    got = minhash.near_duplicates(spark.createDataFrame([(None, a), (7, a), (7, b), (8, b), (9, a)], "doc_id bigint, text string"), 85).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (7, 7, True), (7, 7, True), (8, 7, False), (9, 7, False)]


@pytest.mark.parametrize("n", [1, 2, 7, 40, 400, 5000])
def test_sketch_fills_every_coordinate_and_estimates_similarity(n):
    rng = np.random.default_rng(n)
    a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    s = minhash.sketch(a, 180)
    assert (s != np.iinfo(np.uint64).max).all() and (minhash.sketch(a[::-1], 180) == s).all()
    if n >= 400:
        b = np.concatenate([a[: n * 3 // 4], np.unique(rng.integers(0, 1 << 63, n // 4).astype(np.uint64))])
        assert abs((minhash.sketch(b, 2000) == minhash.sketch(a, 2000)).mean() - 0.6) < 0.06


def test_linked_packs_words_exactly():
    many = [str(i).encode() for i in range(6000)]
    assert minhash.linked(many, [*many, b"x"], 85) and not minhash.linked(many[:100], many[50:150], 85)
    assert minhash.linked([b"a", b"b"], [b"a", b"b"], 85) and not minhash.linked([b"a", b"b"], [b"b", b"a"], 85)


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(500, 500), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(20)}
