import random
import re
from collections import Counter

import numpy as np
import pytest

from attesta.llm import collocations as c
from attesta.llm.collocations import collocations
from llm_rows import SCHEMA, words


def brute(rows, least, top=2000, most=5, percent=100):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, most + 1) for i in range(len(ws) - k + 1))
    big = {g: a for g, a in f.items() if a >= least and len(g[1]) > 1}
    inside = Counter()
    for (lang, p), a in big.items():
        for s in range(len(p)):
            for e in range(s + 1, len(p) + 1):
                if e - s < len(p):
                    inside[lang, p[s:e]] = max(inside[lang, p[s:e]], a)
    out = {}
    for (lang, p), a in big.items():
        if 100 * inside[lang, p] >= percent * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def found(df):
    return sorted(tuple(r) for r in df.collect())


def texts(n, seed):
    r = random.Random(seed)
    vocabulary = ["New", "york", "éa", "the", "of", "\x00z", "AND", "x" * 30, " nb"]
    fixed = ["the new york of éa", "AND the of", "x x x x x x x"]
    for _ in range(n):
        ws = [r.choice(vocabulary) if r.random() < 0.7 else r.choice(fixed) for _ in range(r.randint(0, 40))]
        yield r.choice(["en", "fr", None, "und"]), "".join(w + r.choice([" ", " ", " ", "  \t", ", ", "\n", ".", " ;"]) for w in ws)


@pytest.fixture(scope="module")
def mixed():
    return [*texts(300, 3), (None, None), ("en", ""), ("en", " .,\t")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, None, "clash", 3) for i, (lang, t) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("block", [c.BLOCK, 37])
def test_equals_brute_force(spark, mixed, block):
    """Also where nearly every text is cut into several blocks, so phrases reach over two and more of them."""
    assert found(collocations(frame(spark, mixed).repartition(3), least=4, block=block)) == brute(mixed, 4)


def test_pairs_of_frequent_words_are_dealt_into_parts(spark, mixed, monkeypatch):
    monkeypatch.setattr(c, "HOT", 8)
    rows = mixed[:150]
    assert found(collocations(frame(spark, rows).repartition(3), least=3, block=300)) == brute(rows, 3)


def test_parameters_equal_brute_force(spark, mixed):
    rows = mixed[:120]
    assert found(collocations(frame(spark, rows), least=3, top=4, most_words=3, cover_percent=60)) == brute(rows, 3, 4, 3, 60)


def test_long_text_in_small_blocks(spark):
    rows = [("en", (words(9, 30) + " ") * 60 + "A.B, c d")]
    assert found(collocations(frame(spark, rows), least=50, block=64)) == brute(rows, 50)


def test_empty_tables_and_nothing_frequent(spark, empty, docs):
    assert collocations(empty).count() == 0
    assert collocations(docs, least=10**6).count() == 0


def test_repeated_rows_count_each(spark):
    rows = [("en", "one two")] * 100
    assert found(collocations(frame(spark, rows))) == [("en", 1, "one two", 100, 100, 100, 200, 2000)]


def test_products_beyond_64_bits_are_exact(spark):
    a, l, r, n = 3 * 10**11 + 7, 4 * 10**11 + 1, 5 * 10**11 + 3, 9 * 10**13 + 11
    row = spark.createDataFrame([(a, n, [l], [r])], "f bigint, total bigint, heads array<bigint>, tails array<bigint>")
    assert row.selectExpr(f"({c._CUTS}).score").first()[0] == 1000 * a * n // (l * r)
    tie = spark.createDataFrame([(3, 10, [5, 7, 4], [4, 7, 5])], "f bigint, total bigint, heads array<bigint>, tails array<bigint>")
    assert tuple(tie.selectExpr(f"{c._CUTS} as c").select("c.*").first()) == (612, 1, 7, 7)


def test_slices_lie_between_words():
    raw = np.frombuffer(b"aaaaaaaaaaaaaaaaaaaa bb ccc. ddddd", np.uint8)
    got = list(c.slices(raw, np.array([0, 0, 24, len(raw)]), 4))
    assert b"".join(raw[a:b].tobytes() for a, b, _ in got) == raw.tobytes()
    assert all(a in (0, 24) or raw[a] in b" ." for a, _, _ in got) and [g for _, _, g in got][-1]
