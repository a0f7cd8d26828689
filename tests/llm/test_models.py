"""Held-out accuracy of what is trained, and brute-force versions of what is computed."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import langid, media, mixing, toxicity

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")


def naive_proba(model, row):
    """The network's distribution for one window, filter by filter."""
    pooled = [max(sum(t[j][row[p + j], f] for j in range(w)) for p in range(len(row) - w + 1)) for w, t in model.tables.items() for f in range(langid.FILTERS)]
    z = np.maximum(np.array(pooled) + model.bias, 0) @ model.dense + model.offset
    z = np.exp(z - z.max())
    return z / z.sum()


def test_pair_tables_equal_the_network():
    rng = np.random.default_rng(1)
    f = langid.FILTERS
    model = langid.ByteConvNet(["a", "b"], {w: rng.normal(0, 0.5, (w, 256, f)).astype(np.float32) for w in langid.WIDTHS}, rng.normal(0, 0.1, f * 3).astype(np.float32), rng.normal(0, 0.3, (f * 3, 2)).astype(np.float32), np.zeros(2, np.float32))
    rows = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    assert np.allclose(model.windows_proba(rows), [naive_proba(model, r) for r in rows], atol=2e-3)
    long = "ab c" * 100
    (lang,), (score,) = langid.predict_texts(model, [long])
    raw = long.encode()
    parts = [raw[i : i + langid.WINDOW] for i in range(0, len(raw), langid.WINDOW)]
    p = sum(len(x) * model.windows_proba(np.frombuffer(x.ljust(langid.WINDOW, b"\0"), np.uint8)[None])[0] for x in parts) / len(raw)
    assert lang == model.langs[p.argmax()] and abs(score - p.max()) < 1e-6


@needs_data
def test_language_of_held_out_rows(spark):
    got = langid.op2_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_of_odd_texts(spark, docs, empty):
    assert langid.fit(empty).langs == [] and langid.predict_texts(langid.ByteConvNet([]), ["abc", None]) == (["und", "und"], [0.0, 0.0])
    model = langid.fit(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["kept"]) for r in langid.identify(docs, model, lang_col="lang_pred").collect()}
    assert {k: got[k][0] for k in (7, 8, 9, 16)} == dict.fromkeys((7, 8, 9, 16), "und") and got[1][0] in ("en", "fr") and len(got) == 17
    assert langid.identify(empty, model).count() == 0


@needs_data
def test_toxicity_of_held_out_rows(spark):
    larger = DATA.replace("sf0.01", "sf0.1")  # with a hundred toxic rows to learn from
    labels = spark.read.parquet(f"{larger}/labels.parquet").select("doc_id", "toxic")
    got = toxicity.op7_toxicity(spark, larger).join(labels, "doc_id").where("held_out").toPandas()
    pos, neg = got[got.toxic == 1].score.values, got[got.toxic == 0].score.values
    auc = np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])
    assert auc > 0.95 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()


def test_toxicity_of_odd_tables(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, label int")
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (7, 0)], "doc_id bigint, label int")
    assert {r["score"] for r in toxicity.score(docs, one).collect()} == {1.0}
    assert toxicity.score(empty, none).count() == 0


def test_toxicity_scores_every_row_and_rises_with_what_it_learned(spark):
    """Repeated and nameless rows are scored each; equal texts get equal scores, and those of the learned kind the higher ones."""
    kinds = ["plain words about the weather of day {}", "you idiot and moron number {}, you scum"]
    rows = [(k, kinds[k % 2].format(k)) for k in range(120)] + [(3, kinds[1].format(3)), (None, kinds[1].format(3)), (None, None), (500, "")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id bigint, label int")
    got = toxicity.score(spark.createDataFrame(rows, "doc_id bigint, text string"), labels).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    held = got[got.doc_id.between(80, 119)]
    assert held[held.doc_id % 2 == 1].score.min() > held[held.doc_id % 2 == 0].score.max() and got[got.doc_id == 3].score.nunique() == 1


def test_features_see_insults_pronouns_and_disguise():
    at = {n: i for i, n in enumerate(toxicity.FEATURES)}
    known = toxicity._Words({})
    x = toxicity.features("You are an IDIOT, an id1ot and an i d i o t!!", known)
    assert x[at["insults"]] > 0 and x[at["nearest"]] == 3 / 50 and x[at["undone"]] == 2 and x[at["exclamations"]] > 0 and x[at["shouted"]] > 0
    assert [v for v in toxicity.features(None, known) if v] == [1.0] == [v for v in toxicity.features("", known) if v]
    assert len(x) == len(toxicity.FEATURES)


def test_mixture_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    kinds = {"good": "plain words that go on and on without end or marks {}", "low": "## ## || || {} ## || ##", "toxic": "you idiot moron scum {} trash loser"}
    rows, labels = [], []
    for k in range(300):
        d = ["good", "good", "low", "toxic"][k % 4]
        rows.append((k, " ".join(kinds[d].format(rng.integers(99)) for _ in range(int(rng.integers(1, 6))))))
        if k // 4 % 2:
            labels.append((k, int(d != "low"), int(d == "toxic")))
    docs = spark.createDataFrame([*rows, (400, None), (401, "")], "doc_id bigint, text string").withColumn("_rate", F.lit("clash"))
    table = spark.createDataFrame([*labels, (1, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    mixture, held = mixing.mixture_for(docs, table, {"good": 0.9, "low": 0.06, "toxic": 0.04})
    got = mixture.rated(held).toPandas()
    p, q, t = np.array(got["_p"].tolist()), np.array(got["_q"].tolist()), got["_tokens"].to_numpy(float)
    assert len(got) == 302 and np.allclose(p.sum(1), 1) and np.allclose(q.sum(1), 1) and np.abs(p - q).max() < 2 / mixing.GRID
    r, have = np.ones(len(got)), p.T @ t
    for _ in range(mixing.ITERATIONS):
        gap = (p.T @ (t * r) - mixture.targets) / have
        if np.abs(gap).max() < mixing.TOLERANCE:
            break
        r = np.clip(r - q @ gap, 0, 1)
    assert np.allclose(r, got["_rate"], atol=1e-6)
    assert np.allclose(p.T @ (t * r), mixture.targets, rtol=0.01)


def test_posteriors_equal_brute_force(spark, docs):
    rng = np.random.default_rng(12)
    model = mixing.DomainModel(["a", "b", "c"], [0.5, 0.5, 0.0], rng.normal(0, 1, (3, 6)).tolist(), rng.uniform(0.2, 2, (3, 6)).tolist())
    held = mixing.measured(docs.drop("_tokens")).toPandas()
    got = np.array(model.rated(mixing.measured(docs.drop("_tokens"))).toPandas()["_p"].tolist())
    for x, p in zip(held["_x"], got, strict=True):
        logs = [np.log(w) - sum(np.log(v) / 2 + (a - m) ** 2 / (2 * v) for a, m, v in zip(x, mean, var, strict=True)) if w else -np.inf for w, mean, var in zip(model.priors, model.means, model.variances, strict=True)]
        e = np.exp(np.array(logs) - max(logs))
        assert np.allclose(p, e / e.sum())


def test_the_plan_grows_with_the_domains_and_steps_only(spark, tmp_path):
    """The features are measured once a document whatever the number of steps, and no step is evaluated inside another."""
    docs = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    model = mixing.DomainModel(["a", "b"], [0.5, 0.5], [[0.0] * 6, [1.0] * 6], [[1.0] * 6] * 2)

    def size(steps):
        frame = mixing.Mixture(model, [1.0, 1.0], [[0.1, 0.2]] * steps, None, [1.0, 1.0]).rated(mixing.measured(docs))
        return str(frame._jdf.queryExecution().optimizedPlan())

    assert size(8).count("regexp_count") <= 4 and len(size(40)) < len(size(20)) + 40 * len(size(0)) / 20


def test_mixed_keeps_repeats_nameless_rows_and_clashing_columns(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    twice = docs.unionByName(docs).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    got = mixing.mixed(twice.withColumn("_copies", F.lit("clash")), labels)
    assert got.columns == [*docs.columns, "_copies"] and got.count() == 35 and got.where("doc_id is null").count() == 1


def test_scarce_domain_thins_no_other(spark):
    kinds = {"good": "plain words that go on and on without end or marks {}", "low": "## ## || || {} ## || ##", "toxic": "you idiot moron scum {} trash loser"}
    pick = lambda k: "toxic" if k % 500 == 7 else "low" if k % 20 == 3 else "good"
    docs = spark.createDataFrame([(k, " ".join(kinds[pick(k)].format(k * 7 + j) for j in range(1 + k % 3))) for k in range(2000)], "doc_id bigint, text string")
    table = spark.createDataFrame([(k, int(pick(k) != "low"), int(pick(k) == "toxic")) for k in range(2000)], "doc_id bigint, quality int, toxic int")
    mixture, held = mixing.mixture_for(docs, table, {"good": 0.93, "low": 0.05, "toxic": 0.02}, max_rate=None)
    got = mixture.rated(held).withColumn("copies", mixing.copies(F.col("_rate"))).toPandas()
    p, t, r = np.array(got["_p"].tolist()), got["_tokens"].to_numpy(float), got["_rate"].to_numpy()
    assert mixture.gap < 0.01 and np.isclose(sum(mixture.targets), t.sum()) and np.allclose(p.T @ (t * r), mixture.achieved, rtol=1e-6)
    kind = got.doc_id.map(pick)
    assert abs((got.copies[kind == "good"] > 0).mean() - mixture.targets[0] / t[kind == "good"].sum()) < 0.03 and got.copies[kind == "toxic"].min() >= 4
    assert abs((t * got.copies).sum() / t.sum() - 1) < 0.05 and ((got.copies == np.floor(r)) | (got.copies == np.floor(r) + 1)).all()


def test_missed_targets_are_reported():
    model = mixing.DomainModel(["a", "b"], [0.5, 0.5], [[0.0], [1.0]], [[1.0], [1.0]])
    with pytest.warns(UserWarning, match="b 10 of 50"):
        mixing.Mixture(model, [50.0, 50.0], [], None, [50.0, 10.0]).report()


def test_mixture_of_odd_tables(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for frame, n in ((empty, 0), (docs, 17)):
        mixture, held = mixing.mixture_for(frame, labels)
        rates = [r["_rate"] for r in mixture.rated(held).select("_rate").collect()]
        assert len(rates) == n and all(0 <= r <= 1 for r in rates)


def turned(p, degrees):
    """The picture turned about its centre, edges repeated."""
    h, w = p.shape
    y, x = np.mgrid[0:h, 0:w]
    c, cy, cx = np.deg2rad(degrees), (h - 1) / 2, (w - 1) / 2
    sx = np.clip(np.cos(c) * (x - cx) + np.sin(c) * (y - cy) + cx, 0, w - 1.001)
    sy = np.clip(-np.sin(c) * (x - cx) + np.cos(c) * (y - cy) + cy, 0, h - 1.001)
    x0, y0 = sx.astype(int), sy.astype(int)
    fx, fy = sx - x0, sy - y0
    return (p[y0, x0] * (1 - fx) * (1 - fy) + p[y0, x0 + 1] * fx * (1 - fy) + p[y0 + 1, x0] * (1 - fx) * fy + p[y0 + 1, x0 + 1] * fx * fy).astype(np.uint8)


def test_copies_of_images(spark):
    rng = np.random.default_rng(4)
    images = {k: media.render(rng.normal(0, 1, 64)) for k in range(24)}
    junk = [(30, None), (31, b"junk"), (32, media.pgm(np.zeros((96, 96), np.uint8))), (33, media.pgm(np.zeros((3, 2), np.uint8)))]
    base = spark.createDataFrame([*images.items(), *junk], "class_id bigint, image binary")
    edits = {
        "crop": lambda p, k: media.pixels_of(media.edited(media.pgm(p), k)),
        "quarter": lambda p, k: p[k : k + 48, 40 - k : 88 - k],
        "square": lambda p, k: np.rot90(p, k % 4),
        "turn15": lambda p, k: turned(p, 15),
        "turn45": lambda p, k: turned(p, 45),
        "double": lambda p, k: media._shrunk(p[None].astype(np.float32), 0.5)[0].astype(np.uint8),
        "noise": lambda p, k: np.clip(p + np.random.default_rng(k).normal(0, 4, p.shape), 0, 255).astype(np.uint8),
        "blur": lambda p, k: media._box(p[None].astype(np.float32), 1)[0].astype(np.uint8),
    }
    asked, meant = [(9000, media.render(rng.normal(0, 1, 64))), (9001, None)], {}
    for i, (name, edit) in enumerate(edits.items()):
        for k in images:
            asked.append((1000 * i + k, media.pgm(np.ascontiguousarray(edit(media.pixels_of(images[k]), k)))))
            meant.setdefault(name, set()).add((1000 * i + k, k))
    got = {(r["query_class"], r["class_id"]) for r in media.copies(spark.createDataFrame(asked, "class_id bigint, image binary"), base).collect()}
    recall = {name: len(pairs & got) / len(pairs) for name, pairs in meant.items()}
    assert not got - set().union(*meant.values()) and min(recall.values()) >= 0.9, recall


def test_search_finds_every_pair_within_the_distance(spark):
    """The tables, in one block and in several, against brute force over all pairs of descriptors, from 0 bits apart to beyond the distance."""
    rng = np.random.default_rng(8)
    base = rng.integers(-(1 << 63), 1 << 63, (60, 4), dtype=np.int64)
    asked = []
    for k in range(300):
        bits = np.unpackbits(base[k % 60].astype(">i8").view(np.uint8))
        bits[rng.choice(256, k % 20, replace=False)] ^= 1
        asked.append(np.packbits(bits).view(">i8").astype(np.int64))
    frame = lambda rows: spark.createDataFrame([tuple(map(int, d)) for d in rows], "d0 bigint, d1 bigint, d2 bigint, d3 bigint")
    named = frame(base).select("*", *(F.col(c).alias(f"b_{c}") for c in media.BITS))
    apart = lambda a, b: int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
    want = {(tuple(map(int, b)), tuple(map(int, a))) for a in asked for b in base if apart(a, b) <= media.DISTANCE}
    for block in (40, 1 << 14):
        rows = media.matches(named, frame(asked), block=block).collect()
        assert {(tuple(r[f"b_{c}"] for c in media.BITS), tuple(r[f"q_{c}"] for c in media.BITS)) for r in rows} == want and len(rows) == len(want) >= 200


def test_votes_are_counted_without_a_row_for_each_cell(spark, monkeypatch):
    """A large group of near copies: counts by pairs of images equal brute force at every batch size, and no plan expands a pair of corners into its cells."""
    rng = np.random.default_rng(12)
    columns = ["query_class", "class_id", "x", "y", "zoom", "spin0", "spin1", "tx0", "tx1", "ty0", "ty1"]
    rows = [tuple(map(int, r)) for r in np.column_stack([rng.integers(0, 3, 3000), rng.integers(0, 40, 3000), rng.integers(0, 3, (3000, 2)), rng.integers(-1, 1, 3000), rng.integers(0, 2, (3000, 6))])]
    cells = {}
    for q, c, x, y, zoom, *places in rows:
        for i in range(8):
            cells.setdefault((q, c, zoom, i, places[i >> 2], places[2 + (i >> 1 & 1)], places[4 + (i & 1)]), set()).add((x, y))
    want = {}
    for (q, c, *_), at in cells.items():
        want[q, c] = max(want.get((q, c), 0), len(at))
    placed = spark.createDataFrame(rows, ", ".join(f"{c} {'bigint' if k < 2 else 'int'}" for k, c in enumerate(columns)))
    for size in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = [tuple(r) for r in media._agreed(placed, 4).collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len({g[:2] for g in got}) and {g[:2]: g[2] for g in got} == {k: n for k, n in want.items() if n >= 4}
    plans, write = [], media.materialize
    monkeypatch.setattr(media, "materialize", lambda df, *more: plans.append(df._jdf.queryExecution().toString()) or write(df, *more))
    picture = media.render(rng.normal(0, 1, 64))
    images = spark.createDataFrame([(1, picture), (2, picture)], "class_id bigint, image binary")
    assert {tuple(r)[:2] for r in media.copies(images, images).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert plans and not any("Generate" in p for p in plans)


def test_image_query_on_odd_tables(spark, tmp_path):
    rng = np.random.default_rng(6)
    v = rng.normal(0, 1, (4, 64)).tolist()
    rows = [(0, v[0]), (1, v[0]), (100, v[1]), (200, None), (201, None), (300, v[2]), (300, v[2]), (5, []), (None, v[3])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/a/embeddings.parquet")
    got = {r["vec_id"]: (r["class_id"], r["class_size"], r["is_query"], list(r["matches"])) for r in media.op4_image_copies(spark, f"{tmp_path}/a").collect()}
    assert got == {0: (0, 2, True, [0]), 1: (0, 2, False, []), 100: (100, 1, True, [100]), 200: (5, 3, True, []), 201: (5, 3, False, []), 300: (300, 2, True, [300]), 5: (5, 3, False, [])}
    spark.createDataFrame([], "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert media.op4_image_copies(spark, f"{tmp_path}/b").count() == 0


def test_classes_of_equal_images(spark):
    df = spark.createDataFrame([(3, b"a"), (1, b"a"), (2, b"b"), (4, None), (5, None), (None, b"a")], "vec_id bigint, image binary")
    assert {r["vec_id"]: (r["class_id"], r["class_size"]) for r in media.classes(df, "vec_id").collect()} == {3: (1, 2), 1: (1, 2), 2: (2, 1), 4: (4, 2), 5: (4, 2)}


def test_languages_are_told_for_few_rows_at_a_time(spark, docs):
    """A batch of many rows comes back as several, in order, so neither side holds all its texts twice."""
    import pyarrow as pa

    class Rows:
        schema, sparkSession = docs.select("doc_id", "text").schema, spark

        def mapInArrow(self, run, schema):
            return run

    n = 3 * langid.ROWS + 1
    run = langid.identify(Rows(), langid.ByteConvNet([]))
    parts = list(run(iter([pa.record_batch({"doc_id": pa.array(range(n)), "text": pa.array(["some text"] * n)})])))
    assert max(p.num_rows for p in parts) <= langid.ROWS
    assert [k for p in parts for k in p.column("doc_id").to_pylist()] == list(range(n))


def test_base_is_searched_where_it_is_described(spark, monkeypatch):
    """Descriptors of the base are not written, and tables offer each pair once, however few candidates are looked at together."""
    names, write = [], media.materialize
    monkeypatch.setattr(media, "materialize", lambda df, name, *more: names.append(name) or write(df, name, *more))
    rng = np.random.default_rng(14)
    images = spark.createDataFrame([(k, media.render(rng.normal(0, 1, 64))) for k in range(3)], "class_id bigint, image binary")
    assert {tuple(r)[:2] for r in media.copies(images, images).collect()} >= {(k, k) for k in range(3)} and "descriptors" not in names
    bits = np.tile(rng.integers(-(1 << 63), 1 << 63, (6, 4), dtype=np.int64), (20, 1))
    bits[:, 0] ^= 1 << rng.integers(0, 63, 120)
    want = {(i, j) for i in range(120) for j in range(120) if np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)).sum() <= 15}
    for pairs in (5, 1 << 20):
        monkeypatch.setattr(media, "PAIRS", pairs)
        got = [p for mine, theirs in media.Tables(bits).within(bits, 15) for p in zip(mine.tolist(), theirs.tolist(), strict=True)]
        assert len(got) == len(want) and set(got) == want
