"""Chains of captures: literal cases and a plain fold over random chains."""

import json
import random

import pytest

from attesta.operators.lineage import folded, item_key

SCHEMA = "page string, seq int, snapshot_id string, extracted_at string, platform string, offer_id string, data string"


def chain(spark, *captures, platform="1688"):
    rows = [("p", i, f"s{i}", f"2026-09-0{i + 1}T00:00:00Z", platform, "1", json.dumps(c) if isinstance(c, dict) else c) for i, c in enumerate(captures)]
    return folded(spark.createDataFrame(rows, SCHEMA)).first()


def test_values_keep_the_name_of_the_first_capture_over_repeated_merges(spark):
    r = chain(spark, {"supplier_name": "Public", "company_information": {"location": "Guangzhou", "registration": "claim"}}, {"supplier_name": "First", "company_information": {"location": "Shenzhen"}}, {"supplier_name": "Second", "company_information": {"location": "Beijing"}})
    assert json.loads(r["document"])["company_information"] == {"location": "Beijing", "registration": "claim"}
    assert r["key_sources"] == {"company_information": {"location": ["EXTENSION_DOM"], "registration": ["snapshot:s0"]}}
    assert r["field_sources"] == {"supplier_name": ["EXTENSION_DOM"], "company_information": ["EXTENSION_DOM", "snapshot:s0"]}
    assert (r["source_snapshots"], r["first_extracted_at"], r["standalone"], r["captures"]) == (["s0"], "2026-09-01T00:00:00Z", False, 3)


def test_prior_fields_are_kept_and_items_deduplicated(spark):
    old = {"supplier_name": "Old", "company_information": {"location": "G"}, "products": [{"offer_id": "9", "title": "Dress", "attributes": [1]}], "reviews": [{"text": "Good quality", "rating": 5}]}
    r = chain(spark, old, {"supplier_name": "Now", "price_information": {"display_text": "20"}, "products": [{"offer_id": "9", "title": "Dress"}], "reviews": [{"text": " good   QUALITY "}, {"text": "On time"}]})
    d = json.loads(r["document"])
    assert d["products"] == [{"offer_id": "9", "title": "Dress", "attributes": [1]}] and d["reviews"] == [{"text": " good   QUALITY ", "rating": 5}, {"text": "On time"}]
    assert r["field_sources"]["reviews"] == ["snapshot:s0", "EXTENSION_DOM"] and r["item_sources"]["reviews"]["on time"] == ["EXTENSION_DOM"] and r["completeness"] == 0.4167


def test_items_stop_at_the_cap_and_the_newer_win(spark):
    items = lambda who, a: {"reviews": [{"text": f"{who} {i}"} for i in range(20)], "products": [{"offer_id": str(i + a)} for i in range(20)], "company_information": {who: 1}}
    r = chain(spark, items("old", 0), items("new", 20))
    d = json.loads(r["document"])
    assert [len(d["reviews"]), len(d["products"]), r["omitted_reviews"], r["omitted_products"]] == [20] * 4
    assert d["reviews"][0]["text"] == "new 0" and d["products"][0]["offer_id"] == "20" and r["field_sources"]["reviews"] == ["EXTENSION_DOM"]


@pytest.mark.parametrize("old, new", [(0, 3), (1, 3), (3, 3), (3, 1), (3, 0)])
def test_cards_of_the_first_platform_keep_their_number(spark, old, new):
    reviews = lambda n: {"reviews": [{"text": "Repeated", "url": 1}] * n or None, "company_information": {"a": 1}}
    r = chain(spark, reviews(old), {"reviews": [{"text": "Repeated"}] * new})
    assert len(json.loads(r["document"])["reviews"]) == 3
    assert r["field_sources"]["reviews"] == (["snapshot:s0"] if old > new else []) + (["EXTENSION_DOM"] if new else [])
    other = chain(spark, reviews(old), {"reviews": [{"text": "Repeated"}] * new}, platform="TAOBAO")
    assert len(json.loads(other["document"])["reviews"]) == 1


def test_captures_of_other_pages_and_broken_ones_are_rejected(spark):
    rows = [("p", 0, "a", None, "1688", "1", '{"rating": 1}'), ("p", 1, "b", None, "1688", "2", '{"rating": 2}'), ("p", 2, "c", None, "1688", "1", "{"), ("p", 3, "d", None, "1688", "1", None), ("q", 0, "e", None, None, None, "[]"), (None, 0, "f", None, None, None, '{"rating": 0, "categories": []}')]
    got = {r["page"]: r for r in folded(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got["p"]["captures"], got["p"]["rejected"], json.loads(got["p"]["document"])["rating"], got["p"]["standalone"]) == (1, 3, 1, True)
    assert (got["q"]["captures"], got["q"]["rejected"]) == (0, 1) and got[None]["field_sources"] == {"rating": ["EXTENSION_DOM"], "categories": ["EXTENSION_DOM"]} and "categories" not in got[None]["missing_fields"]
    assert folded(spark.createDataFrame([], SCHEMA)).count() == 0


def plain(captures):
    """Sources of products over a chain, by keeping for every kept product the captures and names that matter."""
    state = []  # (key, item, sources)
    for at, c in captures:
        new, merged = c.get("products") or [], {k: (dict(i), s) for k, i, s in state}
        order, groups = [k for k, _, _ in state], {}
        for x in new:
            groups.setdefault(item_key("products", x), []).append(x)
        for k, xs in groups.items():
            old = merged.get(k)
            item = dict(old[0]) if old else {}
            kept_old = old is not None and any(xs[0].get(n) is None for n in old[0])
            first = True
            for x in xs:
                item = dict(x) if first and not old else {**item, **{n: v for n, v in x.items() if v is not None}}
                first = False
            merged[k] = (item, list(dict.fromkeys((old[1] if kept_old else []) + [at])))
            order += [] if k in order else [k]
        order = [k for k in order if k in groups] + [k for k in order if k not in groups]
        state = [(k, *merged[k]) for k in order[:20]]
    return [(k, i) for k, i, _ in state], {k: s for k, _, s in state}


def test_random_chains_equal_a_plain_fold(spark):
    r, rows, want = random.Random(2), [], {}
    for page in range(40):
        captures = []
        for seq in range(r.randint(1, 9)):
            products = [{"offer_id": str(r.randint(0, 25)), **{n: r.choice([None, 1, 2]) for n in "abc" if r.random() < 0.5}} for _ in range(r.randint(0, 12))]
            captures.append((f"s{seq}", {"products": products}))
            rows.append((str(page), seq, f"s{seq}", None, "ALIBABA", "1", json.dumps(captures[-1][1])))
        want[str(page)] = (captures[-1][0], *plain(captures))
    for got in folded(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect():
        now, items, sources = want[got["page"]]
        assert [(item_key("products", i), i) for i in json.loads(got["document"])["products"] or []] == items
        assert (got["item_sources"].get("products") or {}) == {k: ["EXTENSION_DOM" if s == now else f"snapshot:{s}" for s in v] for k, v in sources.items()}
