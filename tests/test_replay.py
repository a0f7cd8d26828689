"""Replay of kept fields: every layout whole, and payloads that differ in one place."""

import json

import pytest

from attesta.operators import replay

AT = "2026-10-01T00:00:00+00:00"
URLS = {
    "offer": "https://detail.1688.com/offer/700000000001.html", "item": "https://item.taobao.com/item.htm?id=1001", "shop": "https://shop15.taobao.com/", "product": "https://www.alibaba.com/product-detail/Thing_1600.html", "profile": "https://acme.en.alibaba.com/company_profile.html",
}
FIELDS = {
    "offer": {
        "title": " Dress ", "shop_info": {"authCompanyName": "Reg Co", "companyName": "Shown Co", "byrRepeatRate3m": "12%"}, "rate_info": {"goodsGrade": 4.5, "goodRates": None, "commonTagNodeList": [{"name": "全部", "count": 7}]}, "price": {"offerMinPrice": "9.5", "offerMaxPrice": 12, "offerBeginAmount": 2},
        "offer_base": {"offerId": 700000000001, "sellerUserId": 55, "province": "浙江", "location": "x"}, "reviews": [{"text": " good ", "source_url": URLS["offer"]}, {"text": "good", "source_url": URLS["offer"]}],
    },
    "item": {
        "seller": {"shopName": "Shop", "shopId": "15", "sellerId": 9, "pcShopUrl": "//shop15.taobao.com", "sellerType": "C", "tmall": False}, "item": {"title": None, "itemId": "1001", "vagueSellCount": "9+"}, "ssrItemId": 1001, "prices": {"price": {"priceText": "¥5"}, "extraPrice": {}}, "starting_price_text": "3",
        "rate": {"sales_display_text": "9+", "review_count_display_text": None}, "reviews": [], "shop_metrics_display_text": ["平均24小时发货", "x"], "dom_title": "Shirt",
    },
    "shop": {"seller": {"shopName": "Shop", "shopId": 15}, "shopDuration": "12年老店", "evaluates": [{"title": "Service", "score": "4.8"}, {"title": " ", "score": "1"}], "products": [{"offer_id": "1", "title": "a", "source_url": "https://item.taobao.com/item.htm?id=1"}, {"offer_id": "1", "title": "b", "source_url": "https://item.taobao.com/item.htm?id=1"}]},
    "product": {
        "product_identity": 1600, "jsonld_identity": [{"sku": "1600", "offers": []}], "seller": {"companyName": "Acme", "subDomain": "acme.en.alibaba.com", "companyProfileUrl": "https://acme.en.alibaba.com/company_profile.html", "companyJoinYears": "5", "home_identity": {"hostname": "acme.en.alibaba.com", "path": "/"}},
        "subject": "Thing", "breadcrumb_names": ["A", " B ", "A"], "offer_price": {"productRangePrices": {"dollarPriceRangeLow": 1.5, "dollarPriceRangeHigh": "3"}, "moq": "10"}, "storeReview": {"averageStar": "4.9", "totalReviewCount": 12}, "tradeHalfYear": {"ordCnt6m": 3}, "onlinePerformance": [{"title": "Response time ⓘ", "value": "2h"}, {"title": "Reorder", "value": "9%"}],
        "delivery": {"packagingDesc": "box", "ladderPeriodList": [{"minQuantity": 1, "maxQuantity": 5, "processPeriod": 7}]}, "review_bodies": [{"text": "fine", "source_url": URLS["product"]}],
    },
    "profile": {
        "esiteSubDomain": "acme.en.alibaba.com", "supplierPerformance": {"companyName": "Acme", "years": {"value": "6 yrs"}, "reviews": {"value": "4.7", "count": 30}, "reorderRate": {"label": "Reorder", "value": "15%"}, "responseTime": {"label": "Reply", "amount": "3h"}}, "supplierActionBar": {"companyName": "Acme", "rating": 4.6},
        "factoryCapability": [{"label": "Floor", "value": "900"}], "markets": [{"name": "EU", "percentage": "40%"}, {"name": "US"}], "company_card_claims": ["CN"], "categories": [{"text": "Bags &amp; more", "href": "/productgrouplist-1.html"}], "certifications": [{"name": "CE", "category": "Safety"}, {"name": None, "category": "x"}],
        "products": [{"offer_id": "7", "title": "Bag &lt;1&gt;", "source_url": "https://www.alibaba.com/product-detail/Bag_7.html"}],
    },
}
VERSIONS = {"offer": "1688-http.v1", "item": "taobao-http.v1", "shop": "taobao-http.v1", "product": "alibaba-http.v1", "profile": "alibaba-http.v1"}


def case(kind, *changes, **outer):
    """A capture of a layout; changes are (path..., value) within the payload."""
    raw = json.loads(json.dumps({"source_url": URLS[kind], "captured_at": AT, "html_sha256": "a" * 64, "public_fields": FIELDS[kind]}))
    for *path, key, value in changes:
        at = raw
        for k in path:
            at = at[k]
        if value is KeyError:
            del at[key]
        else:
            at[key] = value
    row = {"source_url": URLS[kind], "extraction_method": "PUBLIC_HTTP", "analysis_mode": "ACCOUNT_PUBLIC", "extracted_at": AT, "extractor_version": VERSIONS[kind], "raw": json.dumps(raw, ensure_ascii=False)}
    return tuple((row | outer).values())


def run(spark, cases):
    rows = [(f"s{i}", *c) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "snapshot_id string, source_url string, extraction_method string, analysis_mode string, extracted_at string, extractor_version string, raw string")
    got = {r["snapshot_id"]: r for r in replay.replayed(df).collect()}
    return [got[f"s{i}"] for i in range(len(rows))]


def test_every_layout_is_read_again(spark):
    offer, item, shop, product, profile = run(spark, [case(k) for k in URLS])
    assert [r["reason"] for r in (offer, item, shop, product, profile)] == [None] * 5
    assert (offer["supplier_name"], offer["supplier_id"], offer["offer_id"], offer["rating"], offer["reviews"], offer["price"]) == ("Reg Co", "55", "700000000001", 4.5, ["good"], {"minimum": "9.5", "maximum": "12", "minimum_order_quantity": "2"})
    assert offer["signals"] == {"review_count": "7", "repeat_purchase_rate": "12%"} and offer["company"] == {"registered_name": "Reg Co", "display_name": "Shown Co", "location": "浙江"} and [p["title"] for p in offer["products"]] == ["Dress"] and offer["completeness"] == 0.5833
    assert (item["supplier_id"], item["products"][0]["title"], item["price"], item["signals"], [d["value"] for d in item["delivery"]], len(item["metrics"])) == ("9", "Shirt", {"price": "¥5", "starting_price_text": "3"}, {"sales_display_text": "9+"}, ["平均24小时发货"], 2)
    assert (shop["years_active"], [(p["offer_id"], p["title"]) for p in shop["products"]], [m["label"] for m in shop["metrics"]], shop["offer_id"]) == (12, [("1", "a")], ["Service"], None)
    assert (product["supplier_id"], product["years_active"], product["categories"], product["rating"], product["signals"], product["price"]["currency"]) == ("acme.en.alibaba.com", 5, ["A", "B"], 4.9, {"review_count": "12"}, "USD")
    assert [m["label"] for m in product["metrics"]] == ["Reorder", "Online orders (past 6 months)"] and [m["label"] for m in product["delivery"]] == ["Response time ⓘ", "Packaging"]
    assert (profile["years_active"], profile["categories"], profile["certifications"], profile["products"][0]["title"], profile["company"]) == (6, ["Bags & more"], ["CE (Safety)"], "Bag <1>", {"Floor": "900", "company_name": "Acme", "markets_display_text": "EU 40% · US", "register_country": "CN"})
    assert [m["value"] for m in profile["metrics"]] == ["15%", "4.6"] and [m["value"] for m in profile["delivery"]] == ["3h"] and profile["rating"] == 4.7


F_ = "public_fields"
SHAPE = [
    *(("offer", (F_, *p, "extra", 1)) for p in ((), ("shop_info",), ("rate_info",), ("price",), ("offer_base",), ("reviews", 0), ("rate_info", "commonTagNodeList", 0))), ("item", (F_, "prices", "price", "x", 1)), ("shop", (F_, "products", 0, "x", 1)), ("product", (F_, "seller", "home_identity", "x", 1)), ("product", (F_, "delivery", "ladderPeriodList", 0, "x", 1)),
    ("profile", (F_, "supplierPerformance", "years", "x", 1)), ("profile", (F_, "markets", 0, "x", 1)), ("offer", ("extra", 1)), ("offer", ("html_sha256", 5)), *(("offer", (F_, "offer_base", "offerId", v)) for v in (True, {}, [])), ("offer", (F_, "title", 5)), ("offer", (F_, "rate_info", "goodsGrade", "4.5")), ("offer", (F_, "rate_info", "goodRates", "99%")),
    ("offer", (F_, "shop_info", None)), ("offer", (F_, "reviews", None)), ("offer", (F_, "rate_info", "commonTagNodeList", 0, "count", 1.5)), ("item", (F_, "ssrItemId", "01")), ("item", (F_, "seller", "tmall", "no")), ("product", (F_, "product_identity", None)), ("product", (F_, "storeReview", "totalReviewCount", 1.5)), ("product", (F_, "storeReview", "averageStar", -1)),
    ("profile", (F_, "supplierPerformance", "reviews", "count", "many")), ("item", (F_, "shop_metrics_display_text", ["x"] * 2001)), ("shop", (F_, "evaluates", {})),
]


def test_what_no_capture_keeps_is_unexpected(spark):
    assert [r["reason"] for r in run(spark, [case(k, c) for k, c in SHAPE])] == ["UNEXPECTED_FIELD"] * len(SHAPE)


CONFLICTS = [
    ("MISSING_FIELD", case("offer", (F_, "price", KeyError))), ("UNBOUND", case("offer", (F_, "offer_base", "offerId", 700000000002))), ("UNBOUND_REVIEW", case("offer", (F_, "reviews", 0, "source_url", "x"))), ("UNBOUND_REVIEW", case("offer", (F_, "reviews", 0, "text", None))), ("NO_IDENTITY", case("offer", (F_, "title", ""), (F_, "shop_info", {}))),
    ("SELLER_CONFLICT", case("item", (F_, "seller", "pcShopUrl", "https://shop1.taobao.com/"))), ("SELLER_CONFLICT", case("shop", (F_, "seller", "sellerType", "B"))), ("SELLER_CONFLICT", case("item", (F_, "seller", "tmall", True))), ("SELLER_CONFLICT", case("shop", (F_, "seller", "shopId", "16"))), ("UNBOUND", case("item", (F_, "ssrItemId", "1002"))),
    ("UNBOUND", case("item", (F_, "ssrItemId", None), (F_, "item", "itemId", None))), (None, case("item", (F_, "ssrItemId", None))), (None, case("item", (F_, "item", "itemId", None))), ("UNBOUND_PRODUCT", case("shop", (F_, "products", 0, "offer_id", "2"))), ("UNBOUND", case("product", (F_, "product_identity", 1601))), ("UNBOUND", case("product", (F_, "jsonld_identity", 0, "sku", 1601))),
    ("SUPPLIER_CONFLICT", case("product", (F_, "seller", "subDomain", "other.en.alibaba.com"))), ("SUPPLIER_CONFLICT", case("product", (F_, "seller", "subDomain", "evil.test"))), ("PRICE_CONFLICT", case("product", (F_, "offer_price", "productRangePrices", "dollarPriceRangeLow", 5))), ("OUT_OF_RANGE", case("product", (F_, "storeReview", "averageStar", 6))),
    ("LEAD_TIME_CONFLICT", case("product", (F_, "delivery", "ladderPeriodList", 0, "minQuantity", 9))), (None, case("product", (F_, "jsonld_identity", KeyError))), ("UNBOUND", case("profile", (F_, "esiteSubDomain", "b.en.alibaba.com"))), ("SUPPLIER_CONFLICT", case("profile", (F_, "supplierActionBar", "companyName", "B"))), ("TENURE", case("profile", (F_, "supplierPerformance", "years", "value", "long"))),
    ("UNSUPPORTED_CLAIM", case("profile", (F_, "company_card_claims", ["VN"]))), *(("UNBOUND_CATEGORY", case("profile", (F_, "categories", 0, "href", h))) for h in ("https://other.en.alibaba.com/productgrouplist-1.html", "http://acme.en.alibaba.com/productgrouplist-1.html", "/unrelated.html")), ("UNBOUND_PRODUCT", case("profile", (F_, "products", 0, "offer_id", "8"))),
    *(("REVISION", case("offer", extractor_version=v)) for v in ("unknown", "1688-http.v99", "taobao-http.v1", "public-browser.v1")), ("REVISION", case("offer", ("extractor_version", "1688-http.v2"))), ("PROVENANCE", case("offer", ("html_sha256", "A" * 64))), ("PROVENANCE", case("offer", ("captured_at", "x"))), ("PROVENANCE", case("offer", ("source_url", URLS["item"]))),
    ("UNEXPECTED_FIELD", case("offer", ("renormalized_from_snapshot_id", "s"))), ("NOT_PUBLIC", case("offer", analysis_mode="GUEST_PUBLIC")), ("NOT_PUBLIC", case("offer", extraction_method="EXTENSION_DOM")), ("UNSUPPORTED_ADDRESS", case("offer", source_url=URLS["offer"] + "?a=1")), ("PROVENANCE", case("offer", ("captured_at", "2026-10-01T00:00:00"), extracted_at="2026-10-01T00:00:00")),
    ("PROVENANCE", case("offer", extraction_method="PUBLIC_BROWSER", extractor_version="public-browser.v1")),
    (None, case("offer", ("extractor_version", "public-browser.v1"), ("rendered_at", AT), ("rendered_html_sha256", "b" * 64), ("extraction_method", "PUBLIC_BROWSER"), extraction_method="PUBLIC_BROWSER", extractor_version="public-browser.v1")),
    ("UNEXPECTED_FIELD", case("offer", raw="{")), ("UNEXPECTED_FIELD", case("offer", raw=None)), ("UNEXPECTED_FIELD", case("offer", raw="[]")), ("UNEXPECTED_FIELD", case("offer", (F_, "title", "a\x00b"))),
]


def test_conflicts_carry_no_evidence(spark):
    got = run(spark, [c for _, c in CONFLICTS])
    assert [r["reason"] for r in got] == [why for why, _ in CONFLICTS]
    assert all((r["status"], r["supplier_name"], r["completeness"]) == ("UNSUPPORTED", None, None) for r in got if r["reason"])


@pytest.mark.parametrize("name", list(replay.SHAPES))
def test_shapes_name_known_kinds(name):
    def kinds(shape):
        if isinstance(shape, dict):
            return {k for s in shape.values() for k in kinds(s)}
        return kinds(shape[1] if isinstance(shape, tuple) else shape[0]) if isinstance(shape, (list, tuple)) else {shape}

    assert kinds(replay.SHAPES[name]) <= {"string", "scalar", "rating", "integer", "boolean", "key", "id", "number_key", "number", "whole"}
