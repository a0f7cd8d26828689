"""The defaults of the operators on literal rows."""

import pytest
from pyspark.sql import functions as F

from attesta.functions import scalars, text as tx, urls
from attesta.operators import admission, identity, merge, policy, reviews, scoring, serving, similarity, workflow


def one(df):
    got = df.collect()
    assert len(got) == 1
    return got[0].asDict()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_duplicates_fold_case_and_punctuation(spark):
    r = rows(spark, [("s", "a", "BAD QUALITY!!!"), ("s", "b", "bad   quality"), ("s", "c", "short"), ("s", "d", "short"), ("t", "e", None)], "supplier string, evidence_id string, text string")
    assert one(reviews.exact_duplicates(r)) == {"supplier": "s", "duplicate_groups": 1, "duplicate_reviews": 2, "review_count": 4, "strength": 0.5}


def test_topics_use_the_lexicon_in_three_scripts(spark):
    r = rows(spark, [("s", "poor quality item"), ("s", "质量差"), ("s", "giao chậm"), ("s", "fine"), ("s", None)], "supplier string, text string")
    assert one(reviews.topics(r)) == {"supplier": "s", "category": "QUALITY", "review_count": 2}


def test_burst_window_includes_exactly_24_hours(spark):
    r = rows(spark, [("s", f"2026-10-0{d}T00:00:00Z") for d in (1, 2)] + [("s", "2026-10-01T12:00:00+00:00"), ("s", "2026-10-09T00:00:00Z"), ("s", "2026-10-20T00:00:00Z"), ("s", "2026-10-01 00:00:00")], "supplier string, t string").withColumn("ts", scalars.instant(F.col("t")))
    got = one(reviews.timing_bursts(r, ["supplier"]))
    assert (got["burst_count"], got["timed"], got["strength"]) == (3, 5, 0.6)


def test_reliability_of_a_single_review(spark):
    counts = rows(spark, [("s", 1), ("t", 0)], "supplier string, review_count bigint")
    none = rows(spark, [], "supplier string, kind string, strength double, reliability double")
    assert {r["supplier"]: r["reliability"] for r in reviews.reliability(counts, none).collect()} == {"s": 0.125, "t": 0.0}


def test_coercion_names_reviews_and_rejects_repeated_ids(spark):
    ok = rows(spark, [("s", 0, None, "x"), ("s", 1, " ", "y"), ("s", 2, "k", "  ")], "supplier string, ordinal int, evidence_id string, text string")
    assert sorted(r["evidence_id"] for r in reviews.coerced(ok).collect()) == ["review:0", "review:1"]
    bad = rows(spark, [("s", 0, "k", "x"), ("s", 1, "k", "y")], "supplier string, ordinal int, evidence_id string, text string")
    with pytest.raises(Exception, match="unique"):
        reviews.coerced(bad).collect()


def test_clusters_are_transitive_and_hold_copies(spark):
    data = [("s", 1, [1.0, 0.0]), ("s", 2, [0.95, 0.31]), ("s", 3, [0.81, 0.59]), ("s", 4, [0.0, -1.0]), ("s", 5, [0.0, 0.0]), ("s", 6, [0.0, 0.0]), ("s", 7, [1.0, 0.0]), ("s", 8, [0.0, -1.0]), ("t", 9, [1.0, 0.0]), ("s", 10, None)]
    v = rows(spark, data, "supplier string, id bigint, vector array<double>")
    for block in (1, 2, 1024):
        pairs = similarity.similar_pairs(v, block=block)
        assert {(r["a"], r["b"], r["weight"]) for r in pairs.collect()} == {(1, 2, 2), (2, 3, 1), (1, 1, 1), (4, 4, 1)}
    got = similarity.clusters(pairs, similarity.members(v))
    assert {r["id"]: r["cluster"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 4: 4, 8: 4}
    stats = {r["cluster"]: r for r in similarity.cluster_statistics(pairs, got).collect()}
    assert stats[1]["members"] == 4 and stats[4]["avg_similarity"] == 1.0 and stats[4]["number"] == 1


def test_blocks_find_what_all_pairs_find(spark):
    import numpy as np

    m = np.random.default_rng(2).normal(0, 1, (120, 6))
    v = rows(spark, [("s", k, x.tolist()) for k, x in enumerate(m)], "supplier string, id bigint, vector array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if u[a] @ u[b] >= 0.6}
    assert {(r["a"], r["b"]) for r in similarity.similar_pairs(v, 0.6, block=16).collect()} == want and len(want) > 100


def test_a_chain_of_pairs_is_one_cluster(spark):
    pairs = rows(spark, [("s", i, i + 1, 0.9) for i in range(40)], "supplier string, a bigint, b bigint, similarity double")
    assert {r["cluster"] for r in similarity.clusters(pairs).collect()} == {0}


def test_missing_dimension_is_null_and_floor_needs_every_rule(spark):
    schema = "supplier string, evidence_id string, dimension string, severity double, reliability double, importance double, review_derived boolean, critical_candidate boolean, independently_verified boolean, corroborating int"
    s = rows(spark, [("s", "e", "PRODUCT_QUALITY", 40.0, 1.0, 0.5, False, False, False, 1), ("s", "f", "PRODUCT_QUALITY", 80.0, 1.0, 0.5, False, False, False, 1), ("t", "g", "PRICING", 95.0, 0.95, 0.01, False, True, True, 2), ("t", "h", "PRODUCT_QUALITY", 0.0, 1.0, 1.0, False, False, False, 1)], schema)
    conf = s.select("supplier", "dimension").distinct().withColumn("confidence", F.lit(1.0))
    factors = rows(spark, [("s", 0.9, 0.9, 0.9, 0.9), ("t", 0.9, 0.9, 0.9, 0.9), ("u", 0.9, 0.9, 0.9, 0.9), ("v", 0.1, 0.9, 0.9, 0.9)], "supplier string, data_coverage double, source_reliability double, sample_adequacy double, data_freshness double")
    got = {r["supplier"]: r for r in scoring.assess(s, conf, factors).collect()}
    assert (got["s"]["overall_risk"], got["s"]["risk_label"], got["s"]["missing_dimensions"]) == (60.0, "MODERATE", 4)
    assert (got["t"]["overall_risk"], got["t"]["risk_label"], got["t"]["critical"]) == (65.0, "HIGH", True)
    assert got["u"]["overall_risk"] is None and got["u"]["risk_label"] == got["v"]["risk_label"] == "INSUFFICIENT_INFORMATION"


def test_identity_without_evidence_and_by_claims_alone(spark):
    ev = rows(spark, [("a", "FACTORY", 0.9, 0.9, "PLATFORM_PROFILE")] * 4 + [("b", "FACTORY", 1.0, 1.0, "SELF_CLAIM")] * 4 + [("c", "NEUTRAL", 1.0, 1.0, "DOCUMENT")] + [("d", "FACTORY", 0.9, 0.9, "DOCUMENT"), ("d", "TRADER", 0.9, 0.9, "DOCUMENT")], "supplier string, direction string, strength double, reliability double, source_kind string")
    got = {r["supplier"]: r for r in identity.classified(identity.masses(ev)).collect()}
    assert (got["a"]["classification"], got["a"]["factory_likelihood"]) == ("FACTORY", 1.0)
    assert got["b"]["confidence"] == 0.25 and got["b"]["classification"] == "UNCERTAIN"
    assert (got["c"]["confidence"], got["c"]["factory_likelihood"]) == (0.0, 0.5)
    assert got["d"]["contradictory"]


@pytest.mark.parametrize(("old", "new", "want"), [(1, 3, 3), (3, 3, 3), (3, 1, 3), (3, 0, 3), (0, 3, 3)])
def test_multiset_counts(spark, old, new, want):
    o, n = rows(spark, [("x",)] * old, "k string"), rows(spark, [("x",)] * new, "k string")
    assert one(merge.multiset(o, n, "k"))["copies"] == want


def test_keyed_merge_prefers_new_items_and_counts_what_it_omits(spark):
    o = rows(spark, [("p", f"o{i}", i, "old") for i in range(15)] + [("p", "both", 15, "old")], "owner string, item string, pos int, payload string")
    n = rows(spark, [("p", f"n{i}", i, "new") for i in range(9)] + [("p", "both", 9, None)], "owner string, item string, pos int, payload string")
    got = merge.keyed(o, n, ["owner", "item"]).orderBy("rank").collect()
    assert len(got) == 20 and got[0]["item"] == "n0" and got[0]["omitted"] == 5
    assert [(r["payload"], r["lineage"]) for r in got if r["item"] == "both"] == [("old", "old,new")]


def test_two_level_admission_does_not_charge_rejected_requests(spark):
    r = rows(spark, [(1, "a", 1), (2, "b", 2), (3, "a", 3), (4, "c", 4), (5, "a", 5)], "request_id int, subject string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {x["request_id"]: x["outcome"] for x in admission.two_level(r, 2, 3, 3600, "subject").collect()}
    assert got == {1: "ACCEPTED", 2: "ACCEPTED", 3: "ACCEPTED", 4: "GLOBAL_LIMIT", 5: "OWN_LIMIT"}


def test_claims_and_failures(spark):
    at = F.lit("2026-01-01").cast("timestamp")
    null = F.lit(None).cast("timestamp")
    assert value(spark, workflow.claim_outcome(F.lit(None).cast("string"), null, null, F.lit(0), at)) == "unknown"
    assert value(spark, workflow.claim_outcome(F.lit("QUEUED"), null, null, F.lit(0), at)) == "acquired"
    assert value(spark, workflow.claim_outcome(F.lit("QUEUED"), null, null, F.lit(5), at)) == "final"
    f = value(spark, workflow.failure(F.lit(3), F.lit(True), at))
    assert (f["status"], f["delay_seconds"]) == ("FAILED_RETRYABLE", 8.0)
    assert value(spark, workflow.failure(F.lit(5), F.lit(True), at))["status"] == "FAILED_FINAL"


def test_upsert_and_replay(spark):
    stored, new = rows(spark, [(1, "a")], "id int, v string"), rows(spark, [(1, "b"), (2, "c")], "id int, v string")
    added, conflicts = serving.insert_absent(stored, new, ["id"], "v")
    assert [r["id"] for r in added.collect()] == [2] and [r["id"] for r in conflicts.collect()] == [1]
    assert {r["id"]: r["v"] for r in serving.upserted(stored, new, ["id"], ["v"], refresh=False).collect()} == {1: "a", 2: "c"}


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://detail.1688.com/offer/700000000001.html?spm=1", "https://detail.1688.com/offer/700000000001.html"),
        ("https://user@detail.1688.com/offer/700000000001.html", None),
        ("https://detail.1688.com:443/offer/700000000001.html", None),
        ("http://detail.1688.com/offer/700000000001.html", None),
        ("https://m.1688.com/offer/700000000001.html", None),
        ("https://detail.1688.com/offer/700000000001.html#x", None),
        (" https://detail.1688.com/offer/700000000001.html", None),
        ("https://detail.1688.com/offer/12345.html", None),
        ("https://detail.1688.com/offer/700000000001.html?" + "x" * 2048, None),
        ("https://item.taobao.com/item.htm?spm=2&id=7", "https://item.taobao.com/item.htm?id=7"),
        ("https://item.taobao.com/item.htm?id=07", None),
        ("https://item.taobao.com/item.htm?id=7&id=5", None),
        ("https://item.taobao.com/item.htm?id=7&id", None),
        ("https://item.taobao.com/item.htm", None),
        ("https://detail.tmall.com/item.htm?id=7", None),
        ("https://shop12.taobao.com/?a=1", "https://shop12.taobao.com/"),
        ("https://shop12.world.taobao.com/index.htm", "https://shop12.world.taobao.com/index.htm"),
        ("https://shop12.taobao.com/search.htm", None),
        ("https://login.taobao.com/", None),
        ("https://www.alibaba.com/product-detail/Some-thing_1600000000001.html?x", "https://www.alibaba.com/product-detail/Some-thing_1600000000001.html"),
        ("https://www.alibaba.com/product-detail/_1600000000001.html", None),
        ("https://some-co.en.alibaba.com/company_profile.html", "https://some-co.en.alibaba.com/company_profile.html"),
        ("https://some-co.m.en.alibaba.com/company_profile.html", None),
        ("https://some-co.en.alibaba.com/company_profile.html#", None),
        ("", None),
        (None, None),
    ],
)
def test_addresses(spark, url, want):
    assert value(spark, urls.normalize(F.lit(url).cast("string"))) == want


def test_linked_addresses(spark):
    of = lambda f, *u: [value(spark, f(F.lit(x))) for x in u]
    assert of(urls.company_alibaba, "https://co.m.en.alibaba.com/", "https://co.en.alibaba.com/index.html?a", "https://co.en.alibaba.com/x", "https://a.b.en.alibaba.com/") == ["https://co.en.alibaba.com/"] * 2 + [None] * 2
    assert value(spark, urls.company_alibaba(F.lit("https://co.en.alibaba.com/"), profile=True)) is None
    assert of(urls.shop_1688, "https://some.1688.com", "https://detail.1688.com/", "https://some.1688.com/page") == ["https://some.1688.com/", None, None]
    card = "https://sale.1688.com/factory/card.html?memberId="
    assert of(urls.factory_1688, "https://www.1688.com/factory/ab_c.html?x", card + "ab_c&facMemId=ab_c", card + "ab&facMemId=cd", card + "ab&memberId=ab", card + "A") == ["https://www.1688.com/factory/ab_c.html"] * 2 + [None] * 3
    assert of(urls.page_kind, "https://item.taobao.com/item.htm?id=7", "https://detail.1688.com/offer/700000000001.html", "https://co.en.alibaba.com/", "https://example.com/") == ["paused", "product", "company", "unsupported"]
    assert of(urls.source_label, "https://item.taobao.com/item.htm?id=7", "https://co.en.alibaba.com/company_profile.html", "x") == ["Taobao", "Alibaba", "1688"]


def test_reviews_are_folded_by_nfkc(spark):
    import unicodedata

    texts = [unicodedata.normalize("NFD", "Chất lượng kém!"), "ＰＯＯＲ　ＱＵＡＬＩＴＹ", "poor quality", "fine"]
    r = rows(spark, [("s", t) for t in texts], "supplier string, text string")
    assert one(reviews.topics(r))["review_count"] == 3
    assert one(reviews.exact_duplicates(r))["duplicate_reviews"] == 2


def test_sample_credibility_and_claims(spark):
    counts = rows(spark, [("a", 10, 0.9, False, False), ("b", 10, 0.9, True, False), ("c", 10, 0.9, True, True), ("d", 10, 0.3, True, True), ("e", 9, 0.9, False, False), ("f", 10, 0.9, False, False)], "supplier string, review_count int, review_confidence double, no_timestamps boolean, no_ratings boolean")
    got = policy.preliminary_credibility(counts, rows(spark, [("f",)], "supplier string"))
    assert {r["supplier"]: r["confidence"] for r in got.collect()} == {"a": 0.6, "b": 0.45, "c": 0.4, "d": 0.3}
    schema = "dimension string, severity string, fields array<string>, quotes map<string,string>, fragments map<string,array<string>>, metrics array<struct<label:string,value:string>>, reviews int"
    metric, q = [("Response rate", "95%")], "Refund within 7 days of delivery"
    data = [
        ("SUPPLIER_IDENTITY", "LOW", ["certifications"], {"certifications": "x"}, {"certifications": ["x"]}, None, 5), ("PRICING", "LOW", ["reviews"], {"reviews": "x"}, {"reviews": ["x"]}, None, 5),
        ("AFTER_SALES", "LOW", ["page_context"], {"page_context": q}, {"page_context": [q]}, None, 5), ("PRICING", "LOW", ["page_context"], {"page_context": q}, {"page_context": [q]}, None, 5),
        ("AFTER_SALES", "LOW", ["page_context"], {"page_context": "short"}, {"page_context": ["short"]}, None, 5), ("AFTER_SALES", "HIGH", ["products"], {"products": "full refund"}, {"products": ["full refund"]}, None, 5),
        ("AFTER_SALES", "HIGH", ["products"], {"products": "no refunds, full refund denied"}, {"products": ["no refunds, full refund denied"]}, None, 5), ("COMMUNICATION", "LOW", ["transaction_signals"], {"transaction_signals": "Response rate 95%"}, {"transaction_signals": ["Response rate 95%"]}, metric, 5),
        ("COMMUNICATION", "LOW", ["transaction_signals"], {"transaction_signals": "Response rate"}, {"transaction_signals": ["Response rate"]}, metric, 5), ("DELIVERY", "LOW", ["transaction_signals"], {"transaction_signals": "Store return rate 9%"}, {"transaction_signals": ["Store return rate 9%"]}, [("Store return rate", "9%")], 5),
        ("DELIVERY", "LOW", ["reviews"], {"reviews": "late"}, {"reviews": ["it was late"]}, None, 1), ("AFTER_SALES", "HIGH", ["reviews"], {"reviews": "late"}, {"reviews": ["it was late"]}, None, 1), ("DELIVERY", "LOW", ["reviews"], {"reviews": "never"}, {"reviews": ["it was late"]}, None, 3),
    ]
    c = F.col
    got = [r[0] for r in rows(spark, data, schema).coalesce(1).select(policy.gate(c("dimension"), c("severity"), c("fields"), c("quotes"), c("fragments"), c("metrics"), c("reviews"), F.lit(0.5))).collect()]
    assert got == ["skipped", "out of scope", None, "off topic", "no such passage", "a promise is no concern", None, None, "no metric quoted", "ambiguous rate", "too few reviews", None, "quote not in the source"]
    assert value(spark, policy.claim_confidence(F.lit("AFTER_SALES"), F.lit(0.9), F.lit(0.8), F.lit(True), F.lit(1))) == 0.4 and value(spark, policy.claim_confidence(F.lit("PRICING"), F.lit(0.9), F.lit(0.8), F.lit(False), F.lit(1))) == 0.7


def test_text_functions(spark):
    assert value(spark, F.transform(tx.chunks(F.lit("x" * 1500)), F.length)) == [900, 800, 100]
    assert value(spark, F.transform(tx.chunks(F.lit("x" * 7000)), F.length)) == [900] * 9
    assert value(spark, F.size(tx.chunks(F.lit("x" * 710)))) == 1 and value(spark, F.size(tx.chunks(F.lit("质量" * 4)))) == 1 and value(spark, F.size(tx.chunks(F.lit("x" * 15)))) == 0
    assert value(spark, tx.folded_nfkc(F.lit("Straße ＡＢＣ!!"))) == "strasse abc"
    assert value(spark, tx.unfenced(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert value(spark, tx.claims_map(F.lit("a: 1; b: x:y"))) == {"a": "1", "b": "x:y"}
    assert value(spark, scalars.rating(F.lit("true"))) is None
    assert value(spark, scalars.rating(F.lit("4.5"))) == 4.5
    assert value(spark, scalars.instant(F.lit("2026-10-0700"))) is None
    assert value(spark, merge.maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))) == {"a": "1", "b": "3"}


def test_signals_name_the_reviews_they_rest_on(spark):
    from attesta.operators import reviews as rv

    r = [("s", "a", "BAD QUALITY!!!", 5.0, "2026-10-01T00:00:00Z"), ("s", "b", "bad   quality", 4.0, "2026-10-01T12:00:00Z"), ("s", "c", "fine thing here", 5.0, "2026-10-02T00:00:00Z"), ("s", "d", "short", 1.0, "2026-10-02T00:00:01Z"), ("s", "e", "short", None, None), ("t", "f", "poor quality", 5.0, None)]
    df = rows(spark, r, "supplier string, evidence_id string, text string, rating double, t string").withColumn("ts", scalars.instant(F.col("t")))
    got = {(x["supplier"], x["kind"], x["evidence_id"]) for x in rv.signal_evidence(df).collect()}
    assert got == {("s", "EXACT_DUPLICATE_TEXT", i) for i in "ab"} | {("s", "TIMING_BURST", i) for i in "abc"} | {("s", "RATING_TEXT_MISMATCH", i) for i in "ab"}
    assert {(x["evidence_id"], x["copies"], x["first_id"]) for x in rv.duplicate_members(df).collect()} == {("a", 2, "a"), ("b", 2, "a")}


def test_a_risk_at_the_threshold_is_material_however_it_was_summed(spark):
    rows = [("a", "PRICING", 55 - 1.5e-14, 0.4 - 1e-16), ("b", "PRICING", 55.0, 1.0), ("c", "PRICING", 54.999999, 1.0), ("d", "REVIEW_MANIPULATION", 60.0, 1.0), ("e", "PRICING", None, 1.0)]
    got = spark.createDataFrame(rows, "k string, dimension string, risk double, confidence double").select("k", policy.material(F.col("dimension"), F.col("risk"), F.col("confidence")).alias("m"))
    assert {r["k"]: r["m"] for r in got.collect()} == {"a": True, "b": True, "c": False, "d": False, "e": False}


def test_members_of_duplicates_are_folded_once_in_small_batches(spark):
    held = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(held)
    rows = spark.createDataFrame([("s", 1, "BAD quality!!"), ("s", 2, "bad   quality"), ("s", 3, "fine things"), ("t", 4, None)], "supplier string, evidence_id int, text string")
    got = reviews.duplicate_members(rows)
    assert "EvalPython" not in got._jdf.queryExecution().executedPlan().toString() and spark.conf.get(held) == before
    assert {(r["evidence_id"], r["copies"], r["first_id"]) for r in got.collect()} == {(1, 2, 1), (2, 2, 1)}
