"""Containment, provider batches, canonical JSON and budgets of documents against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from attesta.functions import claims
from attesta.operators import containment, merge, models, serving


def pieces(seed, n):
    r = random.Random(seed)
    base = "".join(r.choice("abcdé 中文") for _ in range(600))
    for _ in range(n):
        a = r.randrange(560)
        yield base[a : a + r.randint(4, 40)] + (r.choice("xyz") if r.random() < 0.3 else "")


@pytest.mark.parametrize("size", [containment.SLICE, 40])
def test_contained_equals_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(containment, "SLICE", size)
    texts = [(i, i % 2, "".join(pieces(i, 5))) for i in range(60)] + [(98, 0, None), (99, 1, "")]
    passages = [(i, i % 2, t) for i, t in enumerate(pieces(1, 150))] + [(998, 0, None), (999, 1, "a" * 20)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} int, page int, text string")
    held = lambda a, b: b is not None and a is not None and len(b.encode()) >= containment.LEAST and b in a
    got = {(r["t"], r["p"]) for r in containment.contained(frame(texts, "t"), frame(passages, "p"), "t", "p").collect()}
    assert got == {(i, j) for i, _, a in texts for j, _, b in passages if held(a, b)} and got
    within = {(r["t"], r["p"]) for r in containment.contained(frame(texts, "t"), frame(passages, "p"), "t", "p", ["page"]).collect()}
    assert within == {(i, j) for i, g, a in texts for j, h, b in passages if g == h and held(a, b)}


def test_texts_give_only_the_anchors_of_passages(spark):
    r = random.Random(3)
    line = "every one of these texts holds this line, and every passage begins in it, "
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} int, text string")
    texts = frame([(i, "".join(r.choice("abcdef ") for _ in range(400)) + line + str(i)) for i in range(40)], "t")
    passages = frame([(i, line[i:] + str(i)) for i in range(10)], "p")
    theirs = containment._anchored(passages.withColumnRenamed("text", "passage"), ["p"], "passage", True)
    mine = containment._anchored(texts, ["t"], "text", False, containment.TIERS, containment._bitmap(theirs))
    assert theirs.count() == 10 and mine.count() < 40 * 20
    assert {(x["t"], x["p"]) for x in containment.contained(texts, passages, "t", "p").collect()} == {(i, j) for i in range(40) for j in range(10) if str(i).startswith(str(j))}


def test_outermost_passages(spark):
    texts = {1: "a full refund in 7 days", 2: "we give a full refund in 7 days and more", 3: "we give a full refund in 7 days and more", 4: "short", 5: "short", 6: "something else, no terms"}
    df = spark.createDataFrame([(i, "p", t) for i, t in texts.items()] + [(7, "q", texts[1])], "id int, page string, text string")
    assert sorted(r["id"] for r in containment.outermost(df, "id", ["page"]).collect()) == [2, 4, 5, 6, 7]


def calls(spark, rows, provider, **limits):
    return {r["id"]: (r["vector"], r["error"]) for r in models.embedded(spark.createDataFrame(rows, "id int, text string").coalesce(1), provider, **limits).collect()}


def test_calls_are_packed_by_number_and_bytes(spark):
    def provider(texts):
        return [(i, [float(len(texts)), float(sum(len(t.encode()) for t in texts))]) for i in reversed(range(len(texts)))]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # calls are filled across Arrow batches
    try:
        got = calls(spark, [(i, " é" * 5) for i in range(10)] + [(10, " "), (11, None), (12, "x" * 4001)], provider, most_texts=4)
        by_bytes = calls(spark, [(i, "x" * 40) for i in range(6)], provider, most_bytes=100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got[i][0][0] for i in range(10)] == [4.0] * 8 + [2.0] * 2 and got[10] == got[11] == (None, "text of no length") and got[12] == (None, "text too long")
    assert [v[0] for v, _ in by_bytes.values()] == [[2.0, 80.0][0]] * 6


@pytest.mark.parametrize(("answer", "error"), [
    (lambda t: [(0, [1.0])], "incomplete answer"), (lambda t: [(0, [1.0]), (0, [1.0])], "incomplete answer"), (lambda t: [(0, [1.0]), (1, [1.0, 2.0])], "unequal dimensions"), (lambda t: [(0, []), (1, [])], "unequal dimensions"),
    (lambda t: [(0, [float("nan")]), (1, [1.0])], "numbers that are not finite"), (lambda t: 1 / 0, "division by zero"),
])
def test_answers_that_do_not_hold_are_errors_of_their_rows(spark, answer, error):
    assert calls(spark, [(1, "a"), (2, "b")], answer) == {1: (None, error), 2: (None, error)}


def test_one_bad_call_leaves_the_others(spark):
    got = calls(spark, [(1, "a"), (2, "bad"), (3, "c")], lambda t: [(0, [1.0, 2.0] if "bad" not in t else [1.0])], most_texts=1)
    assert got == {1: ([1.0, 2.0], None), 2: (None, "unequal dimensions"), 3: ([1.0, 2.0], None)}


def test_canonical_json(spark):
    same = ['{"b": [1, 2.50, {"z": null, "a": "é\\u0041"}], "a": {}}', '{"a":{},"b":[1,2.5,{"a":"éA","z":null}]}']
    other = ['{"b": [2.5, 1], "a": {}}', '{"a": 1, "a": 2}', "{", "", None, '"x"', "[]"]
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in same + other], "t string").select(claims.canonical_json(F.col("t")), claims.json_digest(F.col("t"))).collect()]
    assert got[0] == got[1] and got[0][0] == '{"a":{},"b":[1,2.5,{"a":"éA","z":null}]}' and got[2][1] not in (None, got[0][1])
    assert [g[0] for g in got[3:]] == [None, None, None, None, '"x"', "[]"]


def test_reviews_are_cut_from_the_tail(spark):
    rows = [(1, ['a "quoted", text: {x}', "é" * 30, "c\\d\n", "tail"]), (2, []), (3, None), (4, ["x" * 500])]
    df = spark.createDataFrame(rows, "id int, reviews array<string>")
    for most in (*range(20, 140, 7), 200, 525, 526, 527, 528, 1000):
        got = {r["id"]: (r["reviews"], r["captured"], r["retained"]) for r in serving.kept_reviews(df, most_bytes=most).collect()}
        for i, reviews in rows:
            kept = list(reviews or [])
            while kept and len(json.dumps({"id": i, "reviews": kept}, ensure_ascii=False).encode()) > most:
                kept.pop()
            assert got[i] == (kept or None, len(reviews or []), len(kept)), (most, i)


def test_keyed_merge_counts_what_it_leaves_out(spark):
    old = spark.createDataFrame([("s", str(i), i, f"o{i}") for i in range(25)] + [(None, "x", 1, "o")], "owner string, item string, pos int, payload string")
    new = spark.createDataFrame([("s", str(i), i, f"n{i}") for i in range(20, 30)], "owner string, item string, pos int, payload string")
    got = merge.keyed(old, new, ["owner", "item"]).orderBy("owner", "rank").collect()
    mine = [r for r in got if r["owner"] == "s"]
    assert len(mine) == 20 and {r["omitted"] for r in mine} == {10} and [r["payload"] for r in mine[:10]] == [f"n{i}" for i in range(20, 30)] and mine[10]["payload"] == "o0"
    assert [(r["owner"], r["omitted"]) for r in got if r["owner"] is None] == [(None, 0)]


def test_storable_json(spark):
    sound = ['{"a": [1, "x"]}', '"\\ud83d\\ude00"', '"a\\\\u0000b"', '"\\\\ud800"', '"é😀"', '"NaN"', "{}"]
    bad = ['"a\\u0000b"', '"\\ud800"', '"\\ude00"', '"\\ude00\\ud83d"', '"\\ud83dx\\ude00"', '"\\\\\\ud800"', '{"a": NaN}', '{"a": 1, "a": 2}', "{", "", None, '"a\x00"']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in sound + bad], "t string").select(claims.storable(F.col("t"))).collect()]
    assert got == [True] * len(sound) + [False] * len(bad)
