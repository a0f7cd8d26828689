"""Similar pairs against all pairs, whatever the pivots and blocks."""

import random

import numpy as np
import pytest

from attesta.operators import similarity

SCHEMA = "supplier string, id bigint, vector array<double>"


def table(seed, n=260, d=6, spread=0.15):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, d))
    rows = [("s" if i % 3 else "t", i, (centres[i % 9] + spread * r.normal(size=d)).tolist()) for i in range(n)]
    rows += [("s", n + i, rows[4][2]) for i in range(5)] + [("s", n + 9, [0.0] * d), ("t", n + 10, None), ("t", n + 11, [])]
    random.Random(seed).shuffle(rows)
    return rows


def brute(rows, threshold):
    groups = {}
    for s, i, v in rows:
        if v and any(v):
            groups.setdefault((s, tuple(v)), []).append(i)
    reps = [(s, min(ids), np.array(v), len(ids)) for (s, v), ids in groups.items()]
    out = {(s, i, i): n * (n - 1) // 2 for s, i, _, n in reps if n > 1}
    for s, i, v, n in reps:
        for t, j, w, m in reps:
            if s == t and i < j and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                out[s, i, j] = n * m
    return out


@pytest.mark.parametrize(("threshold", "block"), [(0.88, 16), (0.5, 40), (0.97, 1024), (0.0, 30)])
def test_pairs_equal_all_pairs(spark, threshold, block):
    rows = table(3)
    got = similarity.similar_pairs(spark.createDataFrame(rows, SCHEMA), threshold, block).collect()
    assert {(r["supplier"], r["a"], r["b"]): r["weight"] for r in got} == brute(rows, threshold) and len(got) == len(brute(rows, threshold))


def test_blocks_out_of_reach_do_not_meet(spark):
    """Of vectors around a few centres only the blocks of one centre are multiplied with each other."""
    r = np.random.default_rng(1)
    centres = np.linalg.qr(r.normal(size=(12, 12)))[0]
    rows = spark.createDataFrame([("s", i, 1, (centres[i % 8] + 0.01 * r.normal(size=12)).tolist()) for i in range(800)], "supplier string, id bigint, copies bigint, v array<double>")
    far = similarity.pivots(rows)
    packed = similarity.blocks(rows, far, 0.5, 20)
    n, met = packed.count(), similarity.reachable(packed, len(far), 0.5).count()
    assert n >= 40 and met < n * (n + 1) / 2 / 4


def test_suppliers_of_different_dimensions(spark):
    rows = [("s", i, [1.0, 0.1 * i]) for i in range(6)] + [("t", i, [0.0, 1.0, 0.05 * i, 0.0]) for i in range(6)]
    got = similarity.similar_pairs(spark.createDataFrame(rows, SCHEMA), 0.99, 2).collect()
    assert {(r["supplier"], r["a"], r["b"]): r["weight"] for r in got} == brute(rows, 0.99)


def test_empty_tables(spark):
    assert similarity.similar_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert similarity.similar_pairs(spark.createDataFrame([("s", 1, [0.0, 0.0]), ("s", 2, None)], SCHEMA)).count() == 0


def test_a_dense_block_leaves_in_small_batches(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(similarity, "ROWS", 100)
    block = [{"id": 2 * n, "copies": 1 + n % 2, "v": [1.0, n / 1000]} for n in range(40)]
    row = pa.RecordBatch.from_pylist([{"supplier": 1, "i": 0, "j": 0, "left": block, "right": block}])
    found = list(similarity.similar_in(row, 0.5))
    assert max(map(len, found)) <= 100
    rows = [r for b in found for r in b.to_pylist()]
    assert len(rows) == 40 * 39 // 2 + 20 and {(r["a"], r["b"], r["weight"]) for r in rows if r["a"] == r["b"]} == {(2 * n, 2 * n, 1) for n in range(1, 40, 2)}
    assert sum(r["weight"] for r in rows) == 60 * 59 // 2
