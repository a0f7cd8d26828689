import random

import numpy as np
import pytest

from attesta.llm import whitening
from attesta.llm.whitening import op13_whitening, whiten

SCHEMA = "vec_id bigint, embedding array<double>, label int, x string, id string, component string"


def brute(rows, k=4):
    """{vec_id: (n, deviation, whitened, explained)} for vectors of one length, by the covariance of all distinct vectors at once."""
    xs = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows}
    fit = sorted({tuple(x) for x in xs.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([s / n for s in sums])
    gaps = np.array(fit, float) - mean
    e, v = np.linalg.eigh(gaps.T @ gaps / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return {i: (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), (np.array(x, float) - mean) @ v / np.sqrt(e), e / (gaps**2).sum() * n) for i, x in xs.items()}


def same(got, rows):
    want, signs = brute(rows), None
    for i, (n, deviation, w, share) in want.items():
        mine = sorted((r for r in got if r["vec_id"] == i), key=lambda r: r["component"])
        assert [r["component"] for r in mine] == [1, 2, 3, 4] and {r["n"] for r in mine} == {n} and {int(r["deviation"]) for r in mine} == {deviation}
        values = np.array([r["whitened"] for r in mine])
        signs = np.sign(values * w) if signs is None else signs
        assert np.allclose(values, w * signs, atol=1e-8) and np.allclose([r["explained"] for r in mine], share, rtol=1e-8)
        assert max(r["identity_error"] for r in mine) < 1e-9
    assert len(got) == 4 * len(want)


@pytest.mark.parametrize("parts", [1, 70])
def test_equals_the_covariance_of_all_vectors(spark, parts):
    """Also in a tree of three levels; repeated vectors count once, vectors with a large common part lose no digits."""
    r = random.Random(5)
    rows = [(i, [1e6 + r.gauss(0, 3), r.gauss(0, 2), r.gauss(-4e3, 1.2), r.gauss(0, 0.7), r.gauss(0, 0.4), 7.0]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]
    df = spark.createDataFrame([(i, v, 1, "clash", "clash", "clash") for i, v in rows], SCHEMA)
    same(whiten(df.repartition(parts)).collect(), rows)


def test_merging_is_lossless():
    g = np.random.default_rng(1)
    x = g.integers(-(2**40), 2**40, (97, 9))
    parts = [whitening.summary(p) for p in (x[:1], x[1:5], x[5:60], x[60:])]
    n, sums, mean, sigma, vectors = whitening.merged([whitening.merged(parts[:2]), whitening.merged(parts[2:])])
    assert n == 97 and sums == [int(c) for c in x.astype(object).sum(axis=0)]
    scatter = (sigma[:, None] * vectors).T @ (sigma[:, None] * vectors)
    gaps = x - x.mean(axis=0)
    assert np.allclose(scatter, gaps.T @ gaps, rtol=1e-10) and len(sigma) == 9


def test_left_out_and_degenerate_vectors(spark):
    inf, nan = float("inf"), float("nan")
    bad = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [-inf, 1.0]), (6, [])]
    rows = bad + [(None, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [3.0, 5.0]), (8, [0.0, 4.0]), (9, [5.0] * 3), (10, [5.0] * 3), (11, [1e300, -1e300, 0.0, 1.0, 2.0])]
    got = whiten(spark.createDataFrame([(i, v, None, None, None, None) for i, v in rows], SCHEMA)).collect()
    by = lambda i: [r for r in got if r["vec_id"] == i]
    assert not any(by(i) for i in range(1, 7))
    assert len(by(None)) == 2 and len(by(7)) == 4 and {r["n"] for r in by(7)} == {3} and by(7)[0]["identity_error"] < 1e-12
    assert [(r["n"], r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in by(9)] == [(1, None, 0.0, None, "0")] * 3
    assert [r["deviation"] for r in by(11)] == ["0"] * 4
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_huge_entries_keep_exact_deviations(spark, tmp_path):
    rows = [(1, [3e16, 1.0]), (2, [-3e16, 2.0]), (3, [1e9, 3.0])]
    spark.createDataFrame([(*r, 0, "", "", "") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r for r in op13_whitening(spark, str(tmp_path)).where("component = 1").collect()}
    x = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows}
    sums = [sum(v[k] for v in x.values()) for k in (0, 1)]
    exact = {i: sum((3 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in x.items()}
    assert {i: int(r["deviation_digits"]) for i, r in got.items()} == exact
    assert all(got[i]["deviation"] == (v if v < 2**63 else None) for i, v in exact.items())


def test_registered_query_equals_brute_force(spark):
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    same(op13_whitening(spark, "/root/testdata/sf0.001").collect(), rows)
