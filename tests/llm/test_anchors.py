import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import anchors
from attesta.llm.anchors import op11_anchor_dedup, remove_shared
from llm_rows import words


def brute(rows, window=13):
    low, split = {}, [(k, (t or "").encode().split()) for k, t in rows]
    for k, ws in split:
        for i in range(len(ws) - window + 1):
            w = tuple(ws[i : i + window])
            low[w] = min(k, low.get(w, k))
    out = []
    for k, ws in split:
        gone = {j for i in range(len(ws) - window + 1) if low[tuple(ws[i : i + window])] < k for j in range(i, i + window)}
        out.append((k, len(ws), sorted(gone), b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()))
    return sorted(out)


def found(df):
    return sorted((r["doc_id"], r["n_words"], [i for x in r["runs"] for i in range(x["start"], x["stop"])], r["kept"]) for r in df.collect())


def pieces(n: int, seed: int):
    """Documents made of slices of a few sources at every alignment, with edited words, short words in common and documents shorter than a window."""
    r = random.Random(seed)
    sources = [words(50 + k, 90).split() for k in range(4)] + [["a", "b"] * 40, ["same"] * 60, ["é", "ü"] * 30]
    for k in range(n):
        ws = []
        for _ in range(r.randint(0, 4)):
            s = r.choice(sources)
            a = r.randrange(len(s))
            ws += s[a : a + r.randint(3, 40)] + ([f"w{k}"] if r.random() < 0.6 else [])
        yield k, r.choice([" ", "\n", "\t \r"]).join(ws) + r.choice(["", " "])


@pytest.fixture(scope="module")
def mixed_rows():
    return list(pieces(220, 7))


def test_equals_brute_force(spark, mixed_rows):
    assert found(remove_shared(spark.createDataFrame(mixed_rows, "doc_id bigint, text string").repartition(5))) == brute(mixed_rows)


@pytest.mark.parametrize("window", [8, 20])
def test_other_windows_equal_brute_force(spark, mixed_rows, window):
    rows = mixed_rows[:90]
    assert found(remove_shared(spark.createDataFrame(rows, "doc_id bigint, text string"), window=window)) == brute(rows, window)


def test_exact_join_beyond_the_bitmap(spark, mixed_rows, monkeypatch):
    monkeypatch.setattr(anchors, "MAX_SLOTS", 4)
    rows = mixed_rows[:120]
    assert found(remove_shared(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)


def test_a_full_bitmap_loses_nothing(spark, mixed_rows, monkeypatch):
    monkeypatch.setattr(anchors, "SLOTS_EACH", 0)
    rows = mixed_rows[:120]
    assert found(remove_shared(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)


def test_every_offset_and_length_of_a_match(spark):
    base = words(77, 40).split()
    rows = [(0, " ".join(base))] + [(1 + 20 * a + n, " ".join([f"p{a}_{i}" for i in range(a)] + base[5 + a : 5 + a + n] + ["tail"])) for a in range(14) for n in range(10, 20)]
    assert found(remove_shared(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)


def test_corpus_with_nulls_clashing_columns_and_long_texts(docs, rows):
    assert found(remove_shared(docs)) == brute([r[:2] for r in rows])


def test_empty_nameless_and_repeated_rows(spark, empty):
    assert remove_shared(empty).count() == 0
    t = words(3, 40)
    rows = [(None, t), (1, t), (1, t), (2, t), (2, "z " + t), (3, "one " * 12), (4, "one " * 12)]
    got = sorted((r["doc_id"] or 0, r["n_words"], len(r["kept"].split())) for r in remove_shared(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(0, 40, 40), (1, 40, 40), (1, 40, 40), (2, 40, 0), (2, 41, 1), (3, 12, 12), (4, 12, 12)]


def test_query_columns(spark, tmp_path):
    t = words(8, 30)
    spark.createDataFrame([(1, t), (2, t.replace(" ", "\n")), (3, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in op11_anchor_dedup(spark, str(tmp_path)).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert got == {1: (30, 0, hashlib.sha256(t.encode()).hexdigest()), 2: (30, 30, none), 3: (0, 0, none)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\té"), max_size=40), min_size=1, max_size=6))
def test_words_are_hashed_alike_in_slices_of_any_size(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.cumsum([0, *map(len, raw)])
    whole, counts = anchors.word_hashes(data, bounds)
    assert counts.tolist() == [len(r.split()) for r in raw]
    size = anchors.SLICE
    try:
        anchors.SLICE = 5
        assert anchors.word_hashes(data, bounds)[0].tolist() == whole.tolist()
    finally:
        anchors.SLICE = size
    flat = [w for r in raw for w in r.split()]
    assert all((whole[i] == whole[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


def test_rolling_sums():
    h = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for width in (1, 2, 7, 13, 39):
        want = [sum(int(x) * pow(anchors._STEP, k, 1 << 64) for k, x in enumerate(h[i : i + width])) % (1 << 64) for i in range(40 - width)]
        assert anchors.rolling(h, width).tolist() == want


def test_the_cover_aligns_every_two_positions():
    assert all(any((i + d) % 7 in anchors.COVER and (j + d) % 7 in anchors.COVER for d in range(7)) for i in range(7) for j in range(7))
