"""Linked bundles, saved pages and their snapshots on literal rows."""

import datetime
from functools import reduce

import pytest
from pyspark.sql import functions as F

from attesta.operators import linked, merge

SHOP, FACTORY, OFFER = "https://shopabcdef123.1688.com/", "https://www.1688.com/factory/b2b-abcdef123.html", "https://detail.1688.com/offer/1027322610455.html"
TODAY = datetime.date(2026, 10, 11)
PAIR = "array<struct<name:string,value:string>>"
SCHEMAS = {
    "products": f"job_id int, source_url string, offer_id string, supplier_name string, product_title string, reviews array<string>, attributes {PAIR}, shop_url string, guided boolean",
    "shops": "job_id int, source_url string, credit_url string, company_name string, factory_url string", "factories": f"job_id int, source_url string, canonical_url string, shop_url string, claims {PAIR}, description string",
    "outcomes": "job_id int, page string, status string", "pages": "job_id int, page string, source_url string, html string",
}


def selected():
    return {
        "products": [{"source_url": OFFER, "offer_id": "1027322610455", "supplier_name": "Supplier", "product_title": "Shirt", "reviews": ["Good fabric"] * 10, "attributes": [("a", "1")], "shop_url": SHOP, "guided": None}],
        "shops": [{"source_url": SHOP, "credit_url": SHOP + "page/creditdetail.html", "company_name": None, "factory_url": FACTORY}],
        "factories": [{"source_url": FACTORY, "canonical_url": FACTORY, "shop_url": SHOP, "claims": [("成立时间", "2025.07.14"), ("员工总数", "11~50人")], "description": "经销批发"}],
        "outcomes": [{"page": "SHOP", "status": "OK"}, {"page": "FACTORY", "status": "OK"}], "pages": [],
    }


def run(spark, cases, function, schemas):
    """The rows of many cases at once; a case is a dict of tables."""
    frames = []
    for table, schema in schemas.items():
        names = [f.strip().split()[0] for f in schema.replace(PAIR, "pairs").split(",")][1:]
        rows = [(i, *(row.get(n) for n in names)) for i, case in enumerate(cases) for row in case[table]]
        frames.append(spark.createDataFrame(rows, schema))
    return {r["job_id"]: r for r in function(*frames, F.lit(TODAY)).collect()}


def change(*path_and_value):
    *path, value = path_and_value
    case = selected()
    reduce(lambda at, key: at[key], path[:-1], case)[path[-1]] = value
    return case


OTHER = "https://shopdifferent123.1688.com/"
PAGE = "<html><head><link rel='canonical' href='{url}'></head><body>{body}</body></html>"


def page(kind, url, body):
    return {"page": kind, "source_url": url, "html": PAGE.format(url=url, body=body)}


SHOP_BODY = f"<div class='module-wrapper'>We make <div id='bd_2_container_0'><a href='{SHOP}page/creditdetail.html'>credit</a></div></div><h1 id='pcMainCompanyNameV2'>Acme Ltd</h1>"
FACTORY_BODY = f"<div id='pc_card_baseinfo'><a href='{SHOP}'>shop</a></div><div id='pc_card_exhibition'><div>工厂展厅</div><div>a hall</div><div class='ability_info'><p class='ability_key'>工厂面积</p><p class='ability_value'>3600m²</p></div></div>"
PRODUCT_BODY = f"<div id='shopNavigation'><a class='shop-company-name' href='{SHOP}'>x</a></div><div id='description'>Soft <b>cotton</b></div><div id='capture-review-bodies'><p class='review-item'>Good fabric</p><p class='review-item'>new one</p></div><table id='productAttributes'><tr><th class='ant-descriptions-item-label'>Size</th><td class='ant-descriptions-item-content'>XL</td></tr></table>"


def with_pages(*pages, **changes):
    case = selected()
    case["pages"] = list(pages)
    for key, value in changes.items():
        case["shops"][0][key] = value
    return case


REJECTED = {
    "SHOP_MISMATCH": change("shops", 0, "source_url", OTHER), "FACTORY_MISMATCH": change("factories", 0, "shop_url", OTHER), "UNSUPPORTED_CLAIM": change("factories", 0, "claims", [("CCC", "recommended company")]), "CREDIT_MISMATCH": change("shops", 0, "credit_url", OTHER),
    "FOUNDING_DATE": change("factories", 0, "claims", [("成立时间", "2030.07.14")]), "SENSITIVE_STATE": change("factories", 0, "description", "access_token=private"), "OUTCOMES_DIFFER": change("outcomes", 1, "status", "UNAVAILABLE"), "OFFER_MISMATCH": change("products", 0, "offer_id", "1027322610456"),
    "CONFLICTING_CLAIMS": change("factories", 0, "claims", [("成立时间", "2025.07.14"), ("成立时间", "2024.07.14")]), "NO_CLAIMS": change("factories", 0, "claims", []), "FACTORY_NOT_LINKED": change("shops", 0, "factory_url", None), "UNSUPPORTED_SHOP": change("products", 0, "shop_url", "https://login.1688.com/"),
    "UNUSABLE_PRODUCT": {**selected(), "products": [selected()["products"][0] | {"supplier_name": " ", "product_title": None}]}, "SHOP_WITHOUT_IDENTITY": change("shops", 0, "credit_url", None), "REPEATED_PAGE": {**selected(), "shops": selected()["shops"] * 2},
    "UNSUPPORTED_FACTORY": change("shops", 0, "factory_url", "https://www.1688.com/factory/..%2Fhztxsy.html"), "HTML_NOT_LINKED": with_pages(page("SHOP", OTHER, SHOP_BODY)), "HTML_WITHOUT_PAGE": {**with_pages(page("SHOP", SHOP, SHOP_BODY)), "shops": [], "factories": [], "outcomes": []},
    "HTML_NO_BACKLINK": with_pages(page("FACTORY", FACTORY, FACTORY_BODY.replace(SHOP, OTHER))), "HTML_SHOP_CONFLICT": with_pages(page("PRODUCT", OFFER, PRODUCT_BODY.replace(SHOP, OTHER))), "HTML_NAME_CONFLICT": with_pages(page("SHOP", SHOP, SHOP_BODY), company_name="Other"),
    "HTML_CLAIMS_CONFLICT": with_pages(page("FACTORY", FACTORY, FACTORY_BODY.replace("工厂面积", "员工总数"))), "HTML_FAULT": with_pages(page("SHOP", SHOP, SHOP_BODY + "<script>x</script>")),
}


def test_one_contradiction_rejects_the_bundle(spark):
    got = run(spark, list(REJECTED.values()), linked.bundles_1688, SCHEMAS)
    assert [got[i]["reason"] for i in range(len(REJECTED))] == list(REJECTED)
    assert all(r["status"] == "REJECTED" and r["claims"] is None and r["supplier_name"] is None for r in got.values())


def test_bundles_that_hold(spark):
    plain, no_pages = selected(), selected()
    no_pages |= {"shops": [], "factories": [], "outcomes": [{"page": p, "status": "NO_PERMISSION"} for p in ("SHOP", "FACTORY")]}
    guided = change("products", 0, "guided", True) | {"shops": [], "outcomes": []}
    numbers = change("factories", 0, "claims", [("企业面积", "2100m²"), ("工厂面积", "3600m²"), ("生产线数量", "4条"), ("员工总数", "11~50人")])
    captured = with_pages(page("SHOP", SHOP, SHOP_BODY), page("FACTORY", FACTORY, FACTORY_BODY), page("PRODUCT", OFFER, PRODUCT_BODY))
    header = with_pages(page("SHOP", SHOP, "<h1 id='pcMainCompanyNameV2'>Acme Ltd</h1>"), credit_url=None, company_name="Acme Ltd")
    got = run(spark, [plain, no_pages, guided, numbers, captured, header], linked.bundles_1688, SCHEMAS)
    assert [got[i]["reason"] for i in range(6)] == [None] * 6
    assert (got[0]["years_active"], got[0]["factory_url"], len(got[0]["reviews"]), got[0]["employees"], got[0]["collection_status"]) == (1, FACTORY, 10, "11~50人", {"SHOP": "OK", "FACTORY": "OK"})
    assert {"certifications", "activity_history"} <= set(got[0]["missing_fields"]) and got[0]["completeness"] == 0.4167
    assert got[1]["claims"] is None and "company_information" in got[1]["missing_fields"] and got[1]["collection_status"] == {"SHOP": "NO_PERMISSION", "FACTORY": "NO_PERMISSION"}
    assert (got[3]["company_area_sqm"], got[3]["factory_area_sqm"], got[3]["production_lines"], got[3]["claims"]["企业面积"]) == (2100.0, 3600.0, 4.0, "2100m²")
    assert (got[4]["factory_area_sqm"], got[4]["showroom"], got[4]["shop_name"], got[4]["shop_scope"]) == (3600.0, "a hall", "Acme Ltd", "SHOP_HEADER_AND_INTRODUCTION") and got[4]["introduction"].startswith("We make credit")
    assert got[4]["reviews"] == ["Good fabric", "new one"] + ["Good fabric"] * 9 and got[4]["attributes"] == [("a", "1"), ("Size", "XL")] and got[4]["product_texts"]["description"] == "Soft cotton"
    assert [(p["page"], p["status"]) for p in got[4]["pages"]] == [("PRODUCT", "PARSED"), ("SHOP", "PARSED"), ("FACTORY", "PARSED")] and got[0]["pages"][1]["status"] == "NOT_CAPTURED"
    assert got[5]["shop_scope"] == "SHOP_HEADER_ONLY" and got[5]["introduction"] is None


def test_faults_of_snapshots(spark):
    bodies = [
        "", "<iframe></iframe>", "<p style='x'>", "<a href='http://a.1688.com/'>", "<a href='https://evil.test/'>", "<a href='https://u@a.1688.com/'>", "<a href='https://a.1688.com/#x'>", "<link rel='canonical' href='x'>", "<p>password: hunter2", "<noscript>x</noscript>", "<i>" * 30_001, "x" * 2_000_001, "<a href='https://a.1688.com/p?q=1'>",
    ]
    rows = [(i, "SHOP", SHOP, PAGE.format(url=SHOP, body=b)) for i, b in enumerate(bodies)] + [(99, "SHOP", SHOP, None)]
    read = linked.snapshots(spark.createDataFrame(rows, SCHEMAS["pages"]))
    got = {r["job_id"]: r["f"] for r in read.select("job_id", linked.snapshot_fault(F.struct(*(c for c in read.columns if c != "job_id"))).alias("f")).collect()}
    unsafe = "UNSAFE_LINK"
    assert [got[i] for i in range(len(bodies))] == [None, "FORBIDDEN_CONTENT", "UNSUPPORTED_ATTRIBUTES", unsafe, unsafe, unsafe, unsafe, unsafe, "SENSITIVE_STATE", "FORBIDDEN_CONTENT", "TOO_MANY_ELEMENTS", "TOO_LARGE", None]
    assert got[99] == "CANONICAL_CONFLICT"


A_SHOP, A_PRODUCT = "https://acme.en.alibaba.com/", "https://www.alibaba.com/product-detail/Shirt_1600147809763.html"
A_PROFILE = A_SHOP + "company_profile.html"
A_SCHEMAS = SCHEMAS | {
    "products": f"job_id int, source_url string, canonical_url string, offer_id string, supplier_name string, product_title string, reviews array<string>, attributes {PAIR}, price_text string, rating double, review_count bigint, metrics {PAIR}, shop_url string, guided boolean",
    "factories": f"job_id int, source_url string, canonical_url string, shop_url string, company_name string, claims {PAIR}, description string",
}
A_BODY = {
    "PRODUCT": f"<h1 id='capture-alibaba-title'>Shirt</h1><a id='capture-alibaba-shop-link' href='{A_SHOP}'>s</a><p id='capture-alibaba-supplier'>Acme Co 5 yrs</p><p id='capture-alibaba-price'>50 - 99 pieces $2</p><p id='capture-alibaba-review-summary'>4.5 Based on 1,234 reviews</p><div id='capture-alibaba-policy'>refund</div><div id='capture-review-bodies'><p class='review-item'>fine</p></div><div id='capture-alibaba-attributes'><dl><dt>Fit</dt><dd>slim</dd></dl></div>",
    "SHOP": f"<p id='capture-alibaba-company-name'>Acme Co</p><a id='capture-alibaba-own-shop' href='{A_SHOP}'>o</a><p id='capture-alibaba-introduction'>We sew</p>",
    "FACTORY": f"<p id='capture-alibaba-company-name'>Acme Co</p><a id='capture-alibaba-own-shop' href='{A_SHOP}'>o</a><div id='capture-alibaba-company-claims'><dl><dt>Year established</dt><dd>2011</dd></dl><dl><dt>Total employees</dt><dd>120</dd></dl></div>",
}


def alibaba(**bodies):
    product = {
        "source_url": A_PRODUCT, "offer_id": "1600147809763", "supplier_name": "Acme Co", "product_title": "Shirt", "reviews": ["fine"], "attributes": [("Fit", "slim")], "price_text": "50 - 99 pieces $2", "rating": 4.5, "review_count": 1234, "metrics": [("Years", "5 yrs")], "shop_url": A_SHOP,
    }
    urls = {"PRODUCT": A_PRODUCT, "SHOP": A_SHOP, "FACTORY": A_PROFILE}
    return {
        "products": [product], "shops": [{"source_url": A_SHOP, "company_name": "Acme Co", "factory_url": A_PROFILE}], "factories": [{"source_url": A_PROFILE, "canonical_url": A_PROFILE, "shop_url": A_SHOP, "company_name": "Acme Co", "claims": [("Year established", "2011"), ("Total employees", "120")]}],
        "outcomes": [{"page": p, "status": "OK"} for p in ("SHOP", "FACTORY")], "pages": [page(k, urls[k], bodies.get(k, b)) for k, b in A_BODY.items() if bodies.get(k, b) is not None],
    }


def test_alibaba_bundles(spark):
    def with_product(**values):
        case = alibaba()
        case["products"][0] |= values
        return case

    def with_factory(**values):
        case = alibaba()
        case["factories"][0] |= values
        return case

    swap = lambda k, a, b: alibaba(**{k: A_BODY[k].replace(a, b)})
    cases = {
        None: alibaba(), "OFFER_MISMATCH": with_product(offer_id="1"), "CANONICAL_CONFLICT": with_product(canonical_url=A_PRODUCT.replace("1600", "1700")), "UNSUPPORTED_SHOP": with_product(shop_url="https://acme.m.en.alibaba.com/"), "COMPANY_NAMES_DIFFER": with_product(supplier_name="Other Co"),
        "UNSUPPORTED_CLAIM": with_factory(claims=[("Year established", "-")]), "FOUNDING_DATE": with_factory(claims=[("Year established", "2031")]), "NO_PRODUCT_HTML": alibaba(PRODUCT=None), "PAGE_WITHOUT_HTML": alibaba(SHOP=None), "HTML_TITLE_CONFLICT": swap("PRODUCT", "Shirt", "Hat"),
        "HTML_PRICE_CONFLICT": with_product(price_text="$9"), "HTML_TOTALS_CONFLICT": swap("PRODUCT", "1,234", "1,235"), "HTML_REVIEWS_CONFLICT": with_product(reviews=["fine", "fine"]), "HTML_ATTRIBUTES_CONFLICT": with_product(attributes=[("Fit", "wide")]), "HTML_SUPPLIER_CONFLICT": with_product(metrics=[("Years", "9 yrs")]),
        "HTML_NAME_CONFLICT": swap("SHOP", "Acme Co", "Acme"), "HTML_NO_BACKLINK": swap("FACTORY", f"href='{A_SHOP}'", f"href='{A_PROFILE}'"), "HTML_CLAIMS_CONFLICT": swap("FACTORY", "2011", "2012"), "RAGGED_LIST": swap("FACTORY", "<dd>120</dd>", ""), "AMBIGUOUS_REGION": alibaba(SHOP=A_BODY["SHOP"] + "<p id='capture-alibaba-introduction'>b"),
        "HTML_FAULT": alibaba(SHOP=A_BODY["SHOP"] + "<a href='https://other.en.alibaba.com/'>x</a>"), "SHOP_MISMATCH": {**alibaba(), "shops": [{"source_url": A_SHOP, "company_name": None}]}, "FACTORY_MISMATCH": with_factory(shop_url=A_PROFILE), "HTML_SHOP_CONFLICT": swap("PRODUCT", f"href='{A_SHOP}'", f"href='{A_PROFILE}'"),
    }
    got = run(spark, list(cases.values()), linked.bundles_alibaba, A_SCHEMAS)
    assert [got[i]["reason"] for i in range(len(cases))] == list(cases)
    r = got[0]
    assert (r["minimum_order"], r["employees"], r["year_established"], r["introduction"], r["services"], r["reviews"], r["rating"], r["supplier_name"]) == (50, 120, "2011", "We sew", "refund", ["fine"], 4.5, "Acme Co")


def test_saved_pages(spark):
    product, shop, factory = (PAGE.format(url=u, body=b) for u, b in ((OFFER, PRODUCT_BODY), (SHOP, SHOP_BODY), (FACTORY, FACTORY_BODY.replace("工厂面积", "成立时间").replace("3600m²", "2015.10.12"))))
    cases = [
        (None, product, shop, factory, FACTORY), ("PRODUCT_MISMATCH", product.replace("1027322610455.html'>", "1027322610456.html'>"), shop, factory, FACTORY), ("SHOP_LINK", product.replace(SHOP, "https://login.1688.com/"), shop, factory, FACTORY), ("SHOP_MISMATCH", product, shop.replace("page/creditdetail", "page/x"), factory, FACTORY),
        ("FACTORY_BACKLINK", product, shop, factory.replace(f"href='{SHOP}'", "href='x'"), FACTORY), ("FACTORY_MISMATCH", product, shop, factory, FACTORY.replace("abc", "xyz")), ("FOUNDING_DATE", product, shop, factory.replace("2015.10.12", "2027.1.1"), FACTORY), ("NO_CLAIMS", product, shop, factory.replace("ability_key", "k"), FACTORY),
        ("PAGES_MISSING", product, shop, None, FACTORY), ("FACTORY_BACKLINK", product, shop, factory.replace("<div id='pc_card_baseinfo'>", "<div id='pc_card_baseinfo'></div><div>"), FACTORY),
    ]
    pages = [(i, k, h) for i, c in enumerate(cases) for k, h in zip(("PRODUCT", "SHOP", "FACTORY"), c[1:4]) if h is not None]
    got = linked.saved_1688(
        spark.createDataFrame([(i, OFFER) for i in range(len(cases))], "job_id int, source_url string"), spark.createDataFrame(pages, "job_id int, page string, html string"), spark.createDataFrame([(i, c[4]) for i, c in enumerate(cases)], "job_id int, factory_url string"), F.lit(TODAY)
    )
    got = {r["job_id"]: r for r in got.collect()}
    assert [got[i]["reason"] for i in range(len(cases))] == [c[0] for c in cases]
    assert (got[0]["years_active"], got[0]["shop_url"], got[0]["showroom"], got[0]["claims"]) == (10, SHOP, "a hall", {"成立时间": "2015.10.12"})


@pytest.mark.parametrize("old, new, kept", [(["a"], ["A ", "a", "a"], ["A ", "a", "a"]), (["a"] * 3, ["a"] * 3, ["a"] * 3), (["a"] * 3, ["a"], ["a"] * 3), (["a"] * 3, None, ["a"] * 3), (None, ["a"] * 3, ["a"] * 3), (["b", "a"], ["c"], ["c", "b", "a"]), ([str(i) for i in range(30)], ["x"], ["x"] + [str(i) for i in range(19)])])
def test_cards_keep_the_larger_count(spark, old, new, kept):
    row = spark.createDataFrame([(old, new)], "o array<string>, n array<string>")
    assert row.select(merge.cards(F.col("o"), F.col("n")).alias("c")).first()["c"] == kept
