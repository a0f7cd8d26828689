"""Linked bundles: the product, shop and factory pages of one supplier as one document.

Captures arrive as tables, a row for each page of a collection (job_id), and are joined by it. A bundle holds only if all its pages agree on who the supplier is: the
product's shop link, the shop's own page and the factory's backlink have to name one shop. One contradiction rejects the whole bundle, with the first reason
in the order of the checks; pages that could not be opened are stated by outcomes and do not.

Snapshots (sanitised HTML of the pages) are read once, in Arrow batches, into their regions; every rule about them is columns. The state of each page is kept beside the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import claims, html as reader, scalars, text as tx, urls
from attesta.operators import merge

MOST_BYTES, MOST_ELEMENTS = 2_000_000, 30_000
MOST_CLAIMS, MOST_ATTRIBUTES, MOST_CARDS = 32, 100, 20
#: What a sanitised snapshot may not hold, and the attributes it may.
FORBIDDEN = frozenset("script style iframe form input textarea select button object embed svg img video audio source canvas template noscript".split())
ATTRIBUTES = frozenset("id class href rel charset".split())
#: What the ids of elements that the capturing tool adds begin with; they are known here as `own-` and the rest.
MARK = "capture"
#: Regions of the pages, by element id, and the most characters of their texts.
TEXTS = {
    "description": 800, "productPackInfo": 800, "sizeChart": 800, "productWarning": 800, "officialInspection": 800, "mainServices": 800, "pcMainCompanyNameV2": 240, "pcV2SellerTagYear": 240, "pcV2MainCateLabel": 240,
    "pcV2ServiceScoreLabel": 240, "pcV2ServiceScoreValue": 240, "own-alibaba-title": 500, "own-alibaba-supplier": 2000, "own-alibaba-price": 1200, "own-alibaba-review-summary": 180, "own-alibaba-policy": 1800,
    "own-alibaba-company-name": 240, "own-alibaba-introduction": 1600, "own-alibaba-shop-claims": 1600,
}
LINKS = {"shopNavigation": "shop-company-name", "bd_2_container_0": None, "pc_card_baseinfo": None}
OWN_LINKS = ("own-alibaba-shop-link", "own-alibaba-own-shop")
LISTS = ("own-alibaba-attributes", "own-alibaba-company-claims")
CREDIT_PAGE, SHOWROOM = "page/creditdetail.html", "工厂展厅"
#: Labels of a company overview that are kept.
COMPANY_LABELS = [
    "Business type", "Country / Region", "Main Products", "Total employees", "Total Annual Revenue", "Year established", "Main Markets", "Factory Size", "Factory Country/Region", "No. of Production Lines", "Contract Manufacturing",
    "Annual Output Value", "Average Lead Time", "Accepted Delivery Terms", "Accepted Payment Currency", "Accepted payment methods",
]
STATES = ("OK", "NO_PERMISSION", "LINK_UNAVAILABLE", "UNAVAILABLE", "TIMEOUT")

REGIONS = """bytes bigint, elements int, forbidden boolean, attributes_fit boolean, hrefs array<string>, canonicals array<string>, body string, texts map<string,string>, several array<string>,
links array<struct<region:string,href:string>>, pairs array<struct<region:string,name:string,value:string>>, ragged boolean, cards array<string>, introduction string, showroom string"""


def regions(page: reader.Page, mark: str = MARK) -> tuple:
    """What a parsed page holds in the known regions, in the order of REGIONS without its size."""
    nodes = page.nodes
    named = {}
    for n in nodes:
        name = n.attrs.get("id")
        if name:
            named.setdefault(f"own-{name.removeprefix(f'{mark}-')}" if name.startswith(f"{mark}-") else name, []).append(n)
    texts = {k: page.text_of(named[k][0], most) for k, most in TEXTS.items() if k in named}
    links, pairs, ragged = [], [], False
    for region, kind in LINKS.items():
        links += [(region, n.attrs["href"]) for top in named.get(region, []) for n in page.within(top) if n.tag == "a" and n.attrs.get("href") and (kind is None or kind in n.classes)]
    links += [(k, n.attrs["href"]) for k in OWN_LINKS for n in named.get(k, []) if n.attrs.get("href")]

    def label_and_next(region, label, value, inside=None):
        for top in named.get(region, []):
            for n in page.within(top):
                after = page.next_of(n) if label in n.classes else None
                if after is not None and value in after.classes and (inside is None or any(inside in m.classes for m in _above(nodes, n, top))):
                    yield region, page.text_of(n, 80), page.text_of(after, 240)

    pairs += label_and_next("productAttributes", "ant-descriptions-item-label", "ant-descriptions-item-content")
    pairs += label_and_next("pc_card_exhibition", "ability_key", "ability_value", "ability_info")
    for region in LISTS:
        for row in (n for top in named.get(region, []) for n in page.within(top) if n.tag == "dl"):
            names, values = ([n for n in page.within(row) if n.tag == t] for t in ("dt", "dd"))
            if len(names) == len(values) == 1:
                pairs.append((region, page.text_of(names[0]), page.text_of(values[0])))
            else:
                ragged = True
    cards = [t for top in named.get("own-review-bodies", []) for n in page.within(top) if "review-item" in n.classes and (t := page.text_of(n, 2000))][:MOST_CARDS]
    credit = next((n for top in named.get("bd_2_container_0", []) for n in page.within(top) if n.tag == "a" and (n.attrs.get("href") or "").endswith("/" + CREDIT_PAGE)), None)
    module = None if credit is None else next((m for m in [credit, *_above(nodes, credit)] if "module-wrapper" in m.classes), None)
    room = next((n for top in named.get("pc_card_exhibition", []) for n in page.within(top) if n.tag == "div" and page.text_of(n) == SHOWROOM), None)
    after = None if room is None else page.next_of(room)
    shape = len(nodes) + sum(t not in {n.tag for n in nodes} for t in ("html", "head", "body"))
    fits = all(a in ATTRIBUTES for n in nodes for a in n.attrs)
    canonicals = [n.attrs.get("href") for n in nodes if n.tag == "link" and n.attrs.get("rel") == "canonical"]
    return (
        shape, any(n.tag in FORBIDDEN for n in nodes), fits, [n.attrs["href"] for n in nodes if n.attrs.get("href")], canonicals, page.text, texts, [k for k in TEXTS if len(named.get(k, [])) > 1], links, pairs, ragged, cards,
        None if module is None else page.text_of(module, 1600), None if after is None else page.text_of(after, 1600),
    )


def _above(nodes, node, top=None):
    while node.parent >= 0 and (top is None or node.at != top.at):
        node = nodes[node.parent]
        yield node


def snapshots(pages: DataFrame, mark: str = MARK) -> DataFrame:
    """job_id, page, source_url and REGIONS of pages (job_id, page, source_url, html); pages beyond MOST_BYTES are not parsed, null ones are empty."""
    kind = pages.schema["job_id"].dataType.simpleString()

    def run(batches):
        import re

        import pyarrow as pa

        fields = [pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string())]
        pair = [("region", pa.string()), ("name", pa.string()), ("value", pa.string())]
        fields += [pa.list_(pa.struct([("region", pa.string()), ("href", pa.string())])), pa.list_(pa.struct(pair)), pa.bool_(), pa.list_(pa.string()), pa.string(), pa.string()]
        names = re.findall(r"(?:^|,\s)\s*(\w+) ", REGIONS)
        for batch in batches:
            out = []
            for source in batch.column("html").to_pylist():
                size = len((source or "").encode())
                found = list(regions(reader.read(source if size <= MOST_BYTES else "", tree=True), mark))
                found[6], found[8] = list(found[6].items()), [dict(zip(("region", "href"), x, strict=True)) for x in found[8]]
                found[9] = [dict(zip(("region", "name", "value"), x, strict=True)) for x in found[9]]
                found[1] = found[1] or re.search(r"(?i)<(?:template|noscript)[\s>]", source or "") is not None
                out.append((size, *found))
            columns = list(zip(*out, strict=True)) or [()] * len(fields)
            keys = ["job_id", "page", "source_url"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(c, t) for c, t in zip(columns, fields, strict=True))], [*keys, *names])

    return pages.select("job_id", "page", "source_url", "html").mapInArrow(run, f"job_id {kind}, page string, source_url string, {REGIONS}")


def snapshot_fault(s: Column, allowed: Column | None = None) -> Column:
    """Why a snapshot (struct of source_url and REGIONS) cannot be taken; null if it can or is not there. allowed: the only addresses it may link, else any of the first platform."""
    plain = lambda u: u.rlike(r"^https://[^/?#@:]+(?:[/?][^#]*)?$")
    near = lambda u: F.array_contains(allowed, u) if allowed is not None else u.rlike(r"^https://(?:[^/?#@:]+\.)?1688\.com(?:[/?]|$)")
    return (
        F.when(s.isNull(), F.lit(None)).when(s["bytes"] > MOST_BYTES, "TOO_LARGE").when(s["forbidden"], "FORBIDDEN_CONTENT").when(s["elements"] > MOST_ELEMENTS, "TOO_MANY_ELEMENTS").when(~s["attributes_fit"], "UNSUPPORTED_ATTRIBUTES")
        .when(F.exists(s["hrefs"], lambda u: ~(plain(u) & F.coalesce(near(u), F.lit(False)))), "UNSAFE_LINK").when((F.size(s["canonicals"]) != 1) | ~F.coalesce(F.get(s["canonicals"], 0) == s["source_url"], F.lit(False)), "CANONICAL_CONFLICT")
        .when(tx.page_state(s["body"]), "SENSITIVE_STATE")
    )


def hrefs(s: Column, region: str) -> Column:
    return F.array_distinct(F.transform(F.filter(s["links"], lambda x: x["region"] == region), lambda x: x["href"]))


def pairs(s: Column, region: str) -> Column:
    """Labels and values of a region, those with both, as an array of (name, value)."""
    found = F.filter(s["pairs"], lambda x: (x["region"] == region) & (x["name"] != "") & (x["value"] != ""))
    return F.transform(found, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))


def conflicting(named: Column) -> Column:
    """Whether a name has two values."""
    each = F.array_distinct(named)
    return F.coalesce(F.size(F.array_distinct(F.transform(each, lambda x: x["name"]))) < F.size(each), F.lit(False))


def _value(named: Column, name: str) -> Column:
    """The first value of a name, or null."""
    return F.get(F.filter(named, lambda x: x["name"] == name), 0)["value"]


def _as_map(named: Column) -> Column:
    """Names and values without conflict as a map; an empty one where there is a conflict."""
    return F.map_from_entries(F.when(~conflicting(named), F.array_distinct(named)).otherwise(F.slice(F.array_distinct(named), 1, 0)))


def _one(rows: DataFrame, name: str) -> DataFrame:
    """job_id, `name` (the row as a struct), `name`_n: how many there are. Only one row a job leaves a task."""
    inner = [c for c in rows.columns if c != "job_id"]
    return rows.groupBy("job_id").agg(F.any_value(F.struct(*inner)).alias(name), F.count("*").alias(f"{name}_n"))


def joined(products: DataFrame, shops: DataFrame, factories: DataFrame, outcomes: DataFrame, pages: DataFrame, mark: str = MARK) -> DataFrame:
    """One row for each product: p, shop, factory (structs or null), states (map of page to outcome), product_page, shop_page, factory_page (snapshots), several: whether a part is there twice."""
    out = _one(products, "p").join(_one(shops, "shop"), "job_id", "left").join(_one(factories, "factory"), "job_id", "left")
    told = outcomes.groupBy("job_id", "page").agg(F.any_value("status").alias("status"), F.count("*").alias("n"))
    told = told.groupBy("job_id").agg(*(F.max(F.when(F.col("page") == p, F.col("status"))).alias(f"told_{p}") for p in ("SHOP", "FACTORY")), F.max("n").alias("told_n"), F.count("*").alias("told"), F.count_if(~F.col("page").isin("SHOP", "FACTORY") | ~F.col("status").isin(*STATES)).alias("odd"))
    whole = snapshots(pages, mark)
    inner = F.struct(*(c for c in whole.columns if c not in ("job_id", "page")))
    read = whole.groupBy("job_id").agg(*(F.any_value(F.when(F.col("page") == p.upper(), inner), True).alias(f"{p}_page") for p in ("product", "shop", "factory")), F.count("*").alias("read"), F.count_distinct("page").alias("kinds"))
    out = out.join(told, "job_id", "left").join(read, "job_id", "left")
    several = (F.greatest("p_n", F.coalesce("shop_n", F.lit(1)), F.coalesce("factory_n", F.lit(1)), F.coalesce("told_n", F.lit(1))) > 1) | F.coalesce(F.col("read") > F.col("kinds"), F.lit(False))
    return out.withColumn("several", several).drop("p_n", "shop_n", "factory_n", "told_n", "read", "kinds")


def _first(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that holds; null ones do not."""
    return reduce(lambda c, x: c.when(F.coalesce(x[0], F.lit(False)), x[1]), checks[1:], F.when(F.coalesce(checks[0][0], F.lit(False)), checks[0][1]))


def _outcomes_differ(shop: Column, factory: Column) -> Column:
    """Whether outcomes are there and are not those of both pages as they were collected."""
    state = lambda p, there: F.coalesce(F.col(f"told_{p}") == "OK", F.lit(False)) != there
    return F.col("told").isNotNull() & ((F.col("told") != 2) | (F.col("odd") > 0) | state("SHOP", shop) | state("FACTORY", factory))


def _states(pages: dict[str, tuple[Column, Column, Column]]) -> Column:
    """page, status and digest-free provenance of each page that is part of a bundle: PARSED or NOT_CAPTURED; name -> (part of it, address, snapshot)."""
    each = [F.when(here, F.struct(F.lit(n).alias("page"), url.alias("source_url"), F.when(s.isNotNull(), "PARSED").otherwise("NOT_CAPTURED").alias("status"), s["bytes"].alias("html_bytes"))) for n, (here, url, s) in pages.items()]
    return F.array_compact(F.array(*each))


def _document(rows: DataFrame, platform: str, fields: dict[str, Column], held: dict[str, Column]) -> DataFrame:
    missing = F.array_compact(F.array(*(F.lit(n) if n not in held else F.when(~F.coalesce(held[n], F.lit(False)), n) for n in scalars.COVERAGE_FIELDS)))
    sound = F.col("_reason").isNull()
    rows = rows.withColumns({f"_f_{n}": c for n, c in fields.items()}).withColumn("_missing", missing)
    return rows.select(
        "job_id", F.lit(platform).alias("platform"), F.when(sound, "LINKED").otherwise("REJECTED").alias("status"), F.col("_reason").alias("reason"), *(F.when(sound, F.col(f"_f_{n}")).alias(n) for n in fields),
        F.when(sound, F.round(1 - F.size("_missing") / len(scalars.COVERAGE_FIELDS), 4)).alias("completeness"), F.when(sound, F.col("_missing")).alias("missing_fields"),
    )


def _founded(text: Column) -> Column:
    return F.try_to_date(F.when(text.rlike(r"^[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2}$"), text), "yyyy.M.d")


def bundles_1688(products: DataFrame, shops: DataFrame, factories: DataFrame, outcomes: DataFrame, pages: DataFrame, today: Column, mark: str = MARK) -> DataFrame:
    """Bundles of the first platform, one row for each product: job_id, status LINKED or REJECTED, reason, and the document's fields.

    products: job_id, source_url, offer_id, supplier_name, product_title, reviews (array<string>), attributes (array of name, value), shop_url, guided (the user opened the
    pages). shops: job_id, source_url, credit_url, company_name, factory_url. factories: job_id, source_url, canonical_url, shop_url, claims (array of name, value),
    description. outcomes: job_id, page, status. pages: job_id, page, source_url, html. Pages without a product are no bundle.
    """
    rows = joined(products, shops, factories, outcomes, pages, mark)
    p, shop, factory = F.col("p"), F.col("shop"), F.col("factory")
    here, made = shop.isNotNull(), factory.isNotNull()
    rows = rows.withColumns({"_shop": urls.shop_1688(p["shop_url"]), "_profile": urls.factory_1688(factory["source_url"]), "_source": urls.normalize_1688(p["source_url"])})
    own, profile, source = F.col("_shop"), F.col("_profile"), F.col("_source")
    sp, pp, fp = F.col("shop_page"), F.col("product_page"), F.col("factory_page")
    name = F.when(~F.array_contains(sp["several"], "pcMainCompanyNameV2"), F.nullif(sp["texts"]["pcMainCompanyNameV2"], F.lit("")))
    credits = F.filter(hrefs(sp, "bd_2_container_0"), lambda u: u == F.concat(own, F.lit(CREDIT_PAGE)))
    given = factory["claims"]
    shown = F.filter(pairs(fp, "pc_card_exhibition"), lambda x: x["name"].isin(claims.FACTORY_FIELDS))
    stated = F.concat(F.coalesce(given, F.slice(shown, 1, 0)), F.coalesce(shown, F.slice(given, 1, 0)))
    old = _value(given, "成立时间")
    founded = _founded(old)
    no = lambda a, b: ~F.coalesce(a == b, F.lit(False))
    selected = F.to_json(F.struct(p, shop, factory))
    reason = _first(
        (F.col("several"), "REPEATED_PAGE"), (tx.page_state(selected) | F.contains(selected, F.lit("\\u0000")), "SENSITIVE_STATE"), (source.isNull() | no(urls.offer_id_1688(p["source_url"]), p["offer_id"]), "OFFER_MISMATCH"),
        (F.coalesce(F.trim(p["supplier_name"]), F.lit("")).eqNullSafe("") & F.coalesce(F.trim(p["product_title"]), F.lit("")).eqNullSafe(""), "UNUSABLE_PRODUCT"), (p["shop_url"].isNotNull() & own.isNull(), "UNSUPPORTED_SHOP"),
        (here & no(urls.shop_1688(shop["source_url"]), own), "SHOP_MISMATCH"), (here & shop["credit_url"].isNotNull() & no(shop["credit_url"], F.concat(own, F.lit(CREDIT_PAGE))), "CREDIT_MISMATCH"),
        (here & shop["credit_url"].isNull() & (F.coalesce(F.trim(shop["company_name"]), F.lit("")).eqNullSafe("") | sp.isNull()), "SHOP_WITHOUT_IDENTITY"), (here & shop["factory_url"].isNotNull() & urls.factory_1688(shop["factory_url"]).isNull(), "UNSUPPORTED_FACTORY"),
        (made & (~here | shop["factory_url"].isNull()) & ~(F.coalesce(p["guided"], F.lit(False)) & own.isNotNull() & ~here), "FACTORY_NOT_LINKED"),
        (made & (profile.isNull() | here & no(urls.factory_1688(shop["factory_url"]), profile) | no(factory["canonical_url"], profile) | no(urls.shop_1688(factory["shop_url"]), own)), "FACTORY_MISMATCH"),
        (made & F.exists(given, lambda x: ~F.coalesce(x["name"].isin(claims.FACTORY_FIELDS), F.lit(False))), "UNSUPPORTED_CLAIM"), (made & conflicting(given), "CONFLICTING_CLAIMS"), (made & (F.coalesce(F.size(given), F.lit(0)) == 0), "NO_CLAIMS"),
        (made & (F.size(given) > MOST_CLAIMS), "TOO_MANY_CLAIMS"), (made & old.isNotNull() & (founded.isNull() | (founded > today)), "FOUNDING_DATE"), (_outcomes_differ(here, made), "OUTCOMES_DIFFER"),
        (sp.isNotNull() & ~here | fp.isNotNull() & ~made, "HTML_WITHOUT_PAGE"), (pp.isNotNull() & no(pp["source_url"], source) | sp.isNotNull() & no(sp["source_url"], own) | fp.isNotNull() & no(fp["source_url"], profile), "HTML_NOT_LINKED"),
        (F.coalesce(*(snapshot_fault(s) for s in (pp, sp, fp))).isNotNull(), "HTML_FAULT"), (pp.isNotNull() & own.isNotNull() & no(hrefs(pp, "shopNavigation"), F.array(own)), "HTML_SHOP_CONFLICT"),
        (sp.isNotNull() & shop["company_name"].isNotNull() & no(name, shop["company_name"]), "HTML_NAME_CONFLICT"), (sp.isNotNull() & (F.size(credits) == 0) & name.isNull(), "SHOP_WITHOUT_IDENTITY"),
        (fp.isNotNull() & ~F.array_contains(hrefs(fp, "pc_card_baseinfo"), own), "HTML_NO_BACKLINK"), (fp.isNotNull() & conflicting(stated), "HTML_CLAIMS_CONFLICT"),
    )
    all_claims = F.when(made, _as_map(stated))
    numbers = claims.factory_numbers(all_claims)
    reviews = merge.cards(p["reviews"], pp["cards"], MOST_CARDS)
    attributes = F.slice(F.array_distinct(F.concat(F.coalesce(p["attributes"], F.slice(pairs(pp, "productAttributes"), 1, 0)), F.coalesce(pairs(pp, "productAttributes"), F.slice(p["attributes"], 1, 0)))), 1, MOST_ATTRIBUTES)
    age = F.year(today) - F.year(founded) - (F.date_format(today, "MMdd") < F.date_format(founded, "MMdd")).cast("int")
    has_company = made | sp.isNotNull()
    fields = {
        "source_url": source, "shop_url": F.when(has_company, own), "factory_url": profile, "supplier_name": tx.squeezed(p["supplier_name"]), "product_title": tx.squeezed(p["product_title"]), "years_active": age, "founded": founded, "claims": all_claims,
        "company_area_sqm": numbers["company_area_sqm"], "factory_area_sqm": numbers["factory_area_sqm"], "production_lines": numbers["production_line_count"], "equipment": numbers["equipment_count"], "employees": numbers["employee_count_display_text"],
        "shop_name": name, "shop_scope": F.when(sp.isNotNull(), F.when(F.size(credits) > 0, "SHOP_HEADER_AND_INTRODUCTION").otherwise("SHOP_HEADER_ONLY")), "introduction": F.when(F.size(credits) > 0, sp["introduction"]),
        "description": factory["description"], "showroom": fp["showroom"], "reviews": reviews, "attributes": attributes,
        "product_texts": F.map_filter(pp["texts"], lambda _, v: v != ""), "pages": _states({"PRODUCT": (F.lit(True), source, pp), "SHOP": (here, own, sp), "FACTORY": (made, profile, fp)}),
        "collection_status": F.when(F.col("told").isNotNull(), F.create_map(F.lit("SHOP"), F.col("told_SHOP"), F.lit("FACTORY"), F.col("told_FACTORY"))),
    }
    held = {"supplier_name": F.nullif(fields["supplier_name"], F.lit("")).isNotNull(), "products": F.nullif(fields["product_title"], F.lit("")).isNotNull(), "company_information": has_company, "years_active": founded.isNotNull(), "reviews": F.size(reviews) > 0}
    return _document(rows.withColumn("_reason", reason), "1688", fields, held)


def bundles_alibaba(products: DataFrame, shops: DataFrame, factories: DataFrame, outcomes: DataFrame, pages: DataFrame, today: Column, mark: str = MARK) -> DataFrame:
    """Bundles of the other platform, whose every part has to be repeated by its snapshot: one row for each product, as bundles_1688.

    products: besides job_id, source_url, offer_id, supplier_name, product_title, reviews, attributes, shop_url, guided also canonical_url, price_text, rating, review_count, metrics (array of
    name, value). factories: also company_name, its claims with COMPANY_LABELS. The product's snapshot is needed.
    """
    rows = joined(products, shops, factories, outcomes, pages, mark)
    p, shop, factory = F.col("p"), F.col("shop"), F.col("factory")
    here, made = shop.isNotNull(), factory.isNotNull()
    rows = rows.withColumns({"_shop": urls.company_alibaba(p["shop_url"]), "_source": urls.normalize_alibaba(p["source_url"])})
    own, source = F.col("_shop"), F.col("_source")
    profile = F.concat(own, F.lit("company_profile.html"))
    pp, sp, fp = F.col("product_page"), F.col("shop_page"), F.col("factory_page")
    no = lambda a, b: ~F.coalesce(a == b, F.lit(False))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    linked_name = F.coalesce(F.when(here, shop["company_name"]), F.when(made, factory["company_name"]))
    allowed = F.array_compact(F.array(source, own, profile))
    text = lambda s, k: F.nullif(s["texts"][k], F.lit(""))
    given = factory["claims"]
    shown = pairs(fp, "own-alibaba-company-claims")
    year = _value(given, "Year established")
    summary = F.coalesce(text(pp, "own-alibaba-review-summary"), F.lit(""))
    stars = F.nullif(F.regexp_extract(summary, r"^([0-5](?:\.[0-9]+)?)\b", 1), F.lit("")).cast("double")
    total = F.nullif(F.replace(F.regexp_extract(summary, r"(?i)Based on ([0-9,]+) reviews", 1), F.lit(",")), F.lit("")).try_cast("bigint")
    supplier_text = F.coalesce(text(pp, "own-alibaba-supplier"), F.lit(""))
    bodies = F.transform(pp["cards"], tx.squeezed)
    squeezed = F.transform(p["reviews"], tx.squeezed)
    gone = F.exists(squeezed, lambda t: F.size(F.filter(squeezed, lambda o: o == t)) > F.size(F.filter(bodies, lambda o: o == t)))
    sections = ("own-alibaba-title", "own-alibaba-supplier", "own-alibaba-price", "own-alibaba-review-summary", "own-alibaba-policy")
    company = ("own-alibaba-company-name", "own-alibaba-introduction", "own-alibaba-shop-claims")
    page_named = lambda s, who: no(text(s, "own-alibaba-company-name"), who)
    back = lambda s: no(F.transform(F.filter(s["links"], lambda x: x["region"] == "own-alibaba-own-shop"), lambda x: x["href"]), F.array(own))
    several = lambda s, names: F.arrays_overlap(s["several"], F.array(*map(F.lit, names)))
    selected = F.to_json(F.struct(p, shop, factory))
    reason = _first(
        (F.col("several"), "REPEATED_PAGE"), (tx.page_state(selected) | F.contains(selected, F.lit("\\u0000")), "SENSITIVE_STATE"), (no(urls.alibaba_identity(p["source_url"]), F.concat(F.lit("product:"), p["offer_id"])), "OFFER_MISMATCH"),
        (p["canonical_url"].isNotNull() & no(urls.normalize_alibaba(p["canonical_url"]), source), "CANONICAL_CONFLICT"), (p["shop_url"].isNotNull() & no(p["shop_url"], own), "UNSUPPORTED_SHOP"),
        (here & (no(shop["source_url"], own) | shop["credit_url"].isNotNull() | blank(shop["company_name"])), "SHOP_MISMATCH"), (here & shop["factory_url"].isNotNull() & no(shop["factory_url"], profile), "FACTORY_MISMATCH"),
        (made & (no(factory["source_url"], profile) | no(factory["canonical_url"], profile) | no(factory["shop_url"], own) | blank(factory["company_name"])), "FACTORY_MISMATCH"),
        (made & ~here & ~F.coalesce(p["guided"], F.lit(False)), "FACTORY_NOT_LINKED"), (here & made & no(shop["company_name"], factory["company_name"]), "COMPANY_NAMES_DIFFER"), (blank(p["product_title"]), "UNUSABLE_PRODUCT"),
        (~blank(p["supplier_name"]) & linked_name.isNotNull() & (p["supplier_name"] != linked_name), "COMPANY_NAMES_DIFFER"),
        (made & (F.exists(given, lambda x: ~F.coalesce(x["name"].isin(COMPANY_LABELS), F.lit(False)) | F.coalesce(x["value"] == "-", F.lit(True))) | conflicting(given)), "UNSUPPORTED_CLAIM"), (made & (F.coalesce(F.size(given), F.lit(0)) == 0), "NO_CLAIMS"),
        (made & year.isNotNull() & (~year.rlike("^(?:19|20)[0-9]{2}$") | (year.try_cast("int") > F.year(today))), "FOUNDING_DATE"), (pp.isNull(), "NO_PRODUCT_HTML"), (sp.isNotNull() & ~here | fp.isNotNull() & ~made, "HTML_WITHOUT_PAGE"),
        (no(pp["source_url"], source) | sp.isNotNull() & no(sp["source_url"], own) | fp.isNotNull() & no(fp["source_url"], profile), "HTML_NOT_LINKED"), (here & sp.isNull() | made & fp.isNull(), "PAGE_WITHOUT_HTML"),
        (F.coalesce(*(snapshot_fault(s, allowed) for s in (pp, sp, fp))).isNotNull(), "HTML_FAULT"), (several(pp, sections) | several(sp, company) | several(fp, company), "AMBIGUOUS_REGION"), (no(text(pp, "own-alibaba-title"), p["product_title"]), "HTML_TITLE_CONFLICT"),
        (own.isNotNull() & no(F.transform(F.filter(pp["links"], lambda x: x["region"] == "own-alibaba-shop-link"), lambda x: x["href"]), F.array(own)), "HTML_SHOP_CONFLICT"),
        ((~blank(p["supplier_name"]) & ~F.contains(supplier_text, p["supplier_name"])) | F.coalesce(F.exists(p["metrics"], lambda x: ~F.contains(supplier_text, x["value"])), F.lit(False)), "HTML_SUPPLIER_CONFLICT"),
        (~blank(p["price_text"]) & no(text(pp, "own-alibaba-price"), p["price_text"]), "HTML_PRICE_CONFLICT"), (p["rating"].isNotNull() & no(stars, p["rating"]) | p["review_count"].isNotNull() & no(total, p["review_count"]), "HTML_TOTALS_CONFLICT"),
        (gone, "HTML_REVIEWS_CONFLICT"), (pp["ragged"] | F.coalesce(fp["ragged"], F.lit(False)), "RAGGED_LIST"), (F.size(F.array_except(p["attributes"], pairs(pp, "own-alibaba-attributes"))) > 0, "HTML_ATTRIBUTES_CONFLICT"),
        (sp.isNotNull() & page_named(sp, shop["company_name"]) | fp.isNotNull() & page_named(fp, factory["company_name"]), "HTML_NAME_CONFLICT"), (sp.isNotNull() & back(sp) | fp.isNotNull() & back(fp), "HTML_NO_BACKLINK"),
        (made & (conflicting(shown) | (F.size(F.array_except(F.array_distinct(given), shown)) > 0) | (F.size(F.array_except(shown, given)) > 0)), "HTML_CLAIMS_CONFLICT"), (_outcomes_differ(here, made), "OUTCOMES_DIFFER"),
    )
    all_claims = F.when(made, _as_map(given))
    count = lambda label: F.when(all_claims[label].rlike("^[1-9][0-9]{0,8}$"), all_claims[label].try_cast("int"))
    least = F.nullif(F.replace(F.regexp_extract(p["price_text"], r"\b([0-9][0-9,]*)\s*-\s*[0-9,]+\s+pieces\b", 1), F.lit(",")), F.lit("")).try_cast("bigint")
    reviews = merge.cards(p["reviews"], bodies, MOST_CARDS)
    fields = {
        "source_url": source, "shop_url": own, "factory_url": F.when(made, profile), "supplier_name": F.coalesce(F.nullif(F.trim(p["supplier_name"]), F.lit("")), linked_name), "product_title": p["product_title"], "price_text": p["price_text"], "minimum_order": least,
        "rating": p["rating"], "review_count": p["review_count"], "claims": all_claims, "business_type": all_claims["Business type"], "location": all_claims["Country / Region"], "employees": count("Total employees"), "production_lines": count("No. of Production Lines"),
        "year_established": all_claims["Year established"], "main_products": all_claims["Main Products"], "services": text(pp, "own-alibaba-policy"), "introduction": F.coalesce(text(sp, "own-alibaba-introduction"), text(fp, "own-alibaba-introduction"), factory["description"]),
        "reviews": reviews, "pages": _states({"PRODUCT": (F.lit(True), source, pp), "SHOP": (here, own, sp), "FACTORY": (made, profile, fp)}),
    }
    there = lambda n: F.nullif(fields[n], F.lit("")).isNotNull()
    held = {
        "supplier_name": there("supplier_name"), "products": there("product_title"), "company_information": own.isNotNull(), "reviews": F.size(reviews) > 0, "rating": p["rating"].isNotNull(), "price_information": there("price_text"), "categories": there("main_products"),
        "transaction_signals": p["review_count"].isNotNull() | (F.coalesce(F.size(p["metrics"]), F.lit(0)) > 0),
    }
    return _document(rows.withColumn("_reason", reason), "ALIBABA", fields, held)


def saved_1688(bases: DataFrame, pages: DataFrame, factory_urls: DataFrame, today: Column) -> DataFrame:
    """Pages that a user saved (product, shop, factory) added to a base document: job_id, status, reason, shop_url, factory_url, claims, founded, years_active, showroom.

    bases: job_id, source_url. pages: job_id, page, html. factory_urls: job_id, factory_url. All three pages are needed and have to name one another; nothing is read from hidden elements or scripts.
    """
    whole = snapshots(pages.withColumn("source_url", F.lit(None).cast("string")))
    inner = F.struct(*(c for c in whole.columns if c not in ("job_id", "page", "source_url")))
    read = whole.groupBy("job_id").agg(*(F.any_value(F.when(F.col("page") == p, inner), True).alias(f"saved_{p}") for p in ("PRODUCT", "SHOP", "FACTORY")), F.count("*").alias("n"))
    rows = _one(bases, "b").join(_one(factory_urls, "f"), "job_id", "left").join(read, "job_id", "left")
    pp, sp, fp = F.col("saved_PRODUCT"), F.col("saved_SHOP"), F.col("saved_FACTORY")
    source = urls.normalize_1688(F.col("b.source_url"))
    bare = lambda array: F.array_distinct(F.transform(array, lambda u: F.substring_index(u, "?", 1)))
    of_host = lambda u: F.when(u.rlike(r"^https://[a-z0-9-]+\.1688\.com(?:[/?#]|$)"), urls.shop_1688(F.concat(F.regexp_extract(u, r"^(https://[a-z0-9-]+\.1688\.com)", 1), F.lit("/"))))
    shops = F.array_distinct(F.transform(hrefs(pp, "shopNavigation"), lambda u: F.coalesce(of_host(u), F.lit(""))))
    rows = rows.withColumns({"_shop": F.when(F.size(shops) == 1, F.nullif(F.get(shops, 0), F.lit(""))), "_profile": urls.factory_1688(F.col("f.factory_url"))})
    own, profile = F.col("_shop"), F.col("_profile")
    stated = pairs(fp, "pc_card_exhibition")
    founded = _founded(_value(stated, "成立时间"))
    no = lambda a, b: ~F.coalesce(a == b, F.lit(False))
    reason = _first(
        (source.isNull() | no(source, F.col("b.source_url")), "BASE_MISMATCH"), (pp.isNull() | sp.isNull() | fp.isNull() | (F.col("n") > 3) | (F.col("b_n") > 1), "PAGES_MISSING"), (F.greatest(pp["bytes"], sp["bytes"], fp["bytes"]) > MOST_BYTES, "TOO_LARGE"),
        (no(urls.normalize_1688(F.get(pp["canonicals"], 0)), source), "PRODUCT_MISMATCH"), (own.isNull(), "SHOP_LINK"), ((F.size(sp["canonicals"]) > 0) & no(of_host(F.get(sp["canonicals"], 0)), own), "SHOP_MISMATCH"),
        (~F.array_contains(bare(hrefs(sp, "bd_2_container_0")), F.concat(own, F.lit(CREDIT_PAGE))), "SHOP_MISMATCH"), (~F.array_contains(bare(hrefs(fp, "pc_card_baseinfo")), own), "FACTORY_BACKLINK"), (profile.isNull() | no(F.get(fp["canonicals"], 0), profile), "FACTORY_MISMATCH"),
        (conflicting(stated), "CONFLICTING_CLAIMS"), (F.size(F.array_distinct(stated)) > MOST_CLAIMS, "TOO_MANY_CLAIMS"), (F.size(stated) == 0, "NO_CLAIMS"), (F.exists(stated, lambda x: x["name"] == "成立时间") & (founded.isNull() | (founded > today)), "FOUNDING_DATE"),
    )
    sound = F.col("_reason").isNull()
    age = F.year(today) - F.year(founded) - (F.date_format(today, "MMdd") < F.date_format(founded, "MMdd")).cast("int")
    fields = {"shop_url": own, "factory_url": profile, "claims": _as_map(stated), "founded": founded, "years_active": age, "showroom": fp["showroom"]}
    rows = rows.withColumn("_reason", reason)
    return rows.select("job_id", F.when(sound, "ENRICHED").otherwise("REJECTED").alias("status"), F.col("_reason").alias("reason"), *(F.when(sound, c).alias(n) for n, c in fields.items()))
