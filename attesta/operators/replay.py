"""Replay of kept fields: what earlier captures retained as JSON, checked whole against the shape it may have and read again into the contract.

The payload is a VARIANT. A shape (nested dicts, one-element lists, names of scalar kinds) is compiled into one boolean column that looks at every key and value of a payload,
used or not: unknown keys, wrong types and long lists make it unsupported. Nothing is borrowed from the earlier document; what cannot be read again is missing.
All layouts are replayed in one pass over the stored payloads, in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import scalars, text as tx, urls

MOST_ITEMS, MOST_KEPT = 2000, 20
NUMBERS = "BIGINT|DOUBLE|FLOAT|DECIMAL"
ID = "^[1-9][0-9]{0,19}$"

_TEXTS = lambda *names, **more: dict.fromkeys(names, "string") | more
_REVIEW, _PRODUCT, _HINT = _TEXTS("text", "source_url"), _TEXTS("offer_id", "title", "source_url"), _TEXTS("hostname", "path")
_SELLER = _TEXTS("shopName", "pcShopUrl", "sellerType", shopId="id", sellerId="id", tmall="boolean")
_AMOUNT, _PRICE = _TEXTS("amount", "value", "label"), _TEXTS("priceText", "priceTitle", "priceUnit", "priceDesc")
#: The fields that captures of a layout keep, and what each of them may be.
SHAPES = {
    "offer": {
        "title": "string", "shop_info": _TEXTS("authCompanyName", "companyName", byrRepeatRate3m="scalar"), "rate_info": {"goodsGrade": "rating", "goodRates": "rating", "commonTagNodeList": ("optional", [_TEXTS("name", count="integer")])},
        "price": dict.fromkeys(("offerMinPrice", "offerMaxPrice", "offerBeginAmount"), "scalar"), "offer_base": _TEXTS("province", "location", offerId="scalar", sellerUserId="key"), "reviews": [_REVIEW],
    },
    "item": {
        "seller": _SELLER, "item": _TEXTS("title", "vagueSellCount", itemId="id"), "ssrItemId": "id", "prices": {"price": _PRICE, "extraPrice": _PRICE}, "starting_price_text": "string",
        "rate": _TEXTS("sales_display_text", "review_count_display_text", "positive_review_rate_display_text"), "reviews": [_REVIEW | {"original_length": "integer", "retained_length": "integer", "normalized_limit": "integer", "truncated": "boolean"}],
        "shop_metrics_display_text": ["string"], "dom_title": "string",
    },
    "shop": {"seller": _SELLER, "shopDuration": "string", "evaluates": [_TEXTS("type", "title", "score", "levelText")], "products": [_PRODUCT]},
    "product": {
        "product_identity": "number_key", "jsonld_identity": [{"sku": "number_key", "offers": [_HINT]}], "subject": "string", "breadcrumb_names": ["string"],
        "seller": _TEXTS("subDomain", "companyProfileUrl", "companyName", "companyBusinessType", "companyRegisterCountry", "localCompanyJoinYears", companyJoinYears="whole", home_identity=_HINT),
        **dict.fromkeys(("productBasicProperties", "productKeyIndustryProperties", "productOtherProperties"), [_TEXTS("attrName", "attrValue")]),
        "offer_price": {"productRangePrices": _TEXTS("priceRangeText") | dict.fromkeys(("dollarPriceRangeLow", "dollarPriceRangeHigh", "priceRangeLow", "priceRangeHigh"), "number"), "unit": "string", "moq": "whole"},
        "storeReview": _TEXTS("reviewRatingText", averageStar="number", totalReviewCount="whole"), "tradeHalfYear": {"ordAmt": "string", "ordAmt6m": "number", "ordCnt6m": "whole"}, "onlinePerformance": [_TEXTS("title", "value", "desc")],
        "delivery": _TEXTS("packagingDesc", "unitSize", "unitWeight", "supplierOnTimeDeliveryRate", "responseTimeText", ladderPeriodList=[dict.fromkeys(("minQuantity", "maxQuantity", "processPeriod"), "whole")]),
        "review_bodies": [_REVIEW | {"original_length": "integer", "truncated": "boolean"}],
    },
    "profile": {
        "esiteSubDomain": "string", "supplierPerformance": {"companyName": "string", "years": _TEXTS("label", "value"), "reviews": _TEXTS("value", "label", count="whole"), **dict.fromkeys(("onlineTransactions", "bigBuyerCount", "reorderRate", "shippingDays", "responseTime"), _AMOUNT)},
        "supplierActionBar": {"companyName": "string", "rating": "number", "reviewCount": "whole"}, "factoryCapability": [_TEXTS("fieldName", "label", "type", "value")], "markets": [_TEXTS("name", "percentage")], "company_card_claims": ["string"],
        "categories": [_TEXTS("text", "href")], "certifications": [_TEXTS("name", "category")], "products": [_PRODUCT | _TEXTS("price_display_text", "minimum_order_display_text")],
    },
}
#: Fields that a layout may lack.
SPARE = {"product": {"jsonld_identity", "productBasicProperties", "productKeyIndustryProperties", "productOtherProperties"}, "profile": {"company_card_claims"}}
ENVELOPE = ("source_url", "captured_at", "html_sha256", "rendered_html_sha256", "extraction_method", "extractor_version", "rendered_at")
DELIVERY_LABELS = ("Response time ⓘ", "On-time dispatch rate ⓘ", "Average dispatch time ⓘ")

METRIC = "array<struct<label:string,value:string,scope:string>>"
EVIDENCE = {
    "supplier_id": "string", "offer_id": "string", "supplier_name": "string", "company": "map<string,string>", "years_active": "int", "categories": "array<string>", "certifications": "array<string>", "products": "array<struct<offer_id:string,title:string,source_url:string>>",
    "price": "map<string,string>", "signals": "map<string,string>", "metrics": METRIC, "rating": "double", "reviews": "array<string>", "delivery": METRIC,
}


def _scalar(v: Column, kind: str) -> Column:
    of, text = F.schema_of_variant(v), v.try_cast("string")
    number = text.try_cast("double")
    counted = of.rlike(f"^(?:STRING|{NUMBERS})") & F.coalesce((number >= 0) & (number < float("inf")), F.lit(False))
    void = of == "VOID"
    return {
        "string": void | (of == "STRING"), "scalar": void | of.rlike(f"^(?:STRING|{NUMBERS})"), "rating": void | of.rlike(f"^(?:{NUMBERS})"), "integer": void | (of == "BIGINT"), "boolean": void | (of == "BOOLEAN"), "key": void | of.isin("STRING", "BIGINT"),
        "id": void | (of.isin("STRING", "BIGINT") & F.coalesce(text.rlike(ID), F.lit(False))), "number_key": of.isin("STRING", "BIGINT") & F.coalesce(text.rlike(ID), F.lit(False)), "number": void | counted,
        "whole": void | (counted & F.coalesce(text.try_cast("decimal(38,9)") == F.floor(text.try_cast("decimal(38,9)")), F.lit(False))),
    }[kind]


def fits(v: Column, shape) -> Column:
    """Whether a variant has a shape: a dict of keys that it may have, a list of one shape for all items, ("optional", shape), or the name of a scalar kind."""
    of = F.schema_of_variant(v)
    if isinstance(shape, dict):
        inner = v.try_cast("map<string,variant>")
        part = lambda k: F.try_element_at(inner, F.lit(k))
        checks = [part(k).isNull() | F.coalesce(fits(part(k), s), F.lit(False)) for k, s in shape.items()]
        known = F.forall(F.map_keys(inner), lambda k: k.isin(list(shape)))
        return of.startswith("OBJECT") & F.coalesce(reduce(lambda a, b: a & b, checks, known), F.lit(False))
    if isinstance(shape, list):
        items = v.try_cast("array<variant>")
        return of.startswith("ARRAY") & F.coalesce((F.size(items) <= MOST_ITEMS) & F.forall(items, lambda x: fits(x, shape[0])), F.lit(False))
    if isinstance(shape, tuple):
        return (of == "VOID") | fits(v, shape[1])
    return _scalar(v, shape)


def _at(v: Column, *path: str) -> Column:
    """A scalar of a variant as trimmed text; null for absent, null and blank ones."""
    return F.nullif(F.trim(F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path), "string")), F.lit(""))


def _items(v: Column, *path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, "$" + "".join(f"['{p}']" for p in path), "array<variant>"), F.array().cast("array<variant>"))


def _some(values: dict[str, Column]) -> Column:
    """The values that are there, as a map; null without any."""
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in values.items())), lambda e: e["value"].isNotNull())
    return F.when(F.size(entries) > 0, F.map_from_entries(entries))


def _list(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def _texts(values: Column) -> Column:
    return _list(F.array_distinct(F.filter(values, lambda t: t.isNotNull() & (t != ""))))


def _reviews(items: Column) -> Column:
    return _list(F.slice(F.array_distinct(F.filter(F.transform(items, lambda r: tx.bounded(F.try_variant_get(r, "$.text", "string"))), lambda t: t != "")), 1, MOST_KEPT))


def _unbound(items: Column, url: Column) -> Column:
    return F.exists(items, lambda r: ~F.coalesce((F.try_variant_get(r, "$.source_url", "string") == url) & F.try_variant_get(r, "$.text", "string").isNotNull(), F.lit(False)))


def _metric(label: Column, value: Column, scope: str | Column) -> Column:
    scope = F.lit(scope) if isinstance(scope, str) else scope
    return F.when(label.isNotNull() & value.isNotNull(), F.struct(label.alias("label"), value.alias("value"), scope.alias("scope")))


def _metrics(*columns: Column) -> Column:
    return F.filter(F.array(*columns), lambda m: m.isNotNull())


def _first_offers(products: Column) -> Column:
    """Products, the first of each offer, MOST_KEPT at most."""
    return _list(F.slice(F.filter(products, lambda p, i: ~F.exists(F.slice(products, 1, i), lambda q: q["offer_id"] == p["offer_id"])), 1, MOST_KEPT))


def _product(offer: Column, title: Column, url: Column) -> Column:
    return F.struct(offer.alias("offer_id"), title.alias("title"), url.alias("source_url"))


def _one_product(offer: Column, title: Column, url: Column) -> Column:
    return F.when(title.isNotNull(), F.array(_product(offer, title, url)))


def _chosen(*checks: tuple[Column, str]) -> Column:
    return reduce(lambda c, x: c.when(F.coalesce(x[0], F.lit(False)), x[1]), checks[1:], F.when(F.coalesce(checks[0][0], F.lit(False)), checks[0][1]))


def _seller_conflicts(v: Column, expected: Column | None = None) -> Column:
    """Whether a shop is a brand store, is not the one expected, or has an address of another."""
    shop, url = _at(v, "seller", "shopId"), _at(v, "seller", "pcShopUrl")
    whole = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    whole = F.when(whole.rlike("^https://[^/]+$"), F.concat(whole, F.lit("/"))).otherwise(whole)
    bad = F.coalesce(_at(v, "seller", "tmall") == "true", F.lit(False)) | F.coalesce(_at(v, "seller", "sellerType").isin("B", "TMALL", "tmall"), F.lit(False))
    bad = bad | (url.isNotNull() & ~F.coalesce(urls.taobao_identity(whole) == F.concat(F.lit("shop:"), shop), F.lit(False)))
    return bad if expected is None else bad | ~F.coalesce(shop == expected, F.lit(False))


def _offer(v: Column, url: Column) -> tuple[Column, dict[str, Column]]:
    offer, reviews = urls.offer_id_1688(url), _items(v, "reviews")
    name, title = F.coalesce(_at(v, "shop_info", "authCompanyName"), _at(v, "shop_info", "companyName")), _at(v, "title")
    counted = F.filter(_items(v, "rate_info", "commonTagNodeList"), lambda t: (F.try_variant_get(t, "$.name", "string") == "全部") & F.try_variant_get(t, "$.count", "bigint").isNotNull())
    base = lambda k: _at(v, "offer_base", k)
    fields = {
        "supplier_id": base("sellerUserId"), "offer_id": offer, "supplier_name": name, "company": _some({"registered_name": _at(v, "shop_info", "authCompanyName"), "display_name": _at(v, "shop_info", "companyName"), "location": F.coalesce(base("province"), base("location"))}),
        "products": _one_product(offer, title, F.lit(None).cast("string")), "price": _some({"minimum": _at(v, "price", "offerMinPrice"), "maximum": _at(v, "price", "offerMaxPrice"), "minimum_order_quantity": _at(v, "price", "offerBeginAmount")}),
        "signals": _some({"review_count": F.try_variant_get(F.get(counted, 0), "$.count", "bigint"), "positive_review_rate": _at(v, "rate_info", "goodRates"), "repeat_purchase_rate": _at(v, "shop_info", "byrRepeatRate3m")}),
        "rating": _at(v, "rate_info", "goodsGrade").try_cast("double"), "reviews": _reviews(reviews),
    }
    return _chosen((~F.coalesce(base("offerId") == offer, F.lit(False)), "UNBOUND"), (_unbound(reviews, url), "UNBOUND_REVIEW"), (name.isNull() & title.isNull(), "NO_IDENTITY")), fields


def _item(v: Column, url: Column) -> tuple[Column, dict[str, Column]]:
    item, reviews = urls.item_taobao(url), _items(v, "reviews")
    ids = F.array_compact(F.array(_at(v, "item", "itemId"), _at(v, "ssrItemId")))
    name, title = _at(v, "seller", "shopName"), F.coalesce(_at(v, "item", "title"), _at(v, "dom_title"))
    shown = F.filter(F.transform(_items(v, "shop_metrics_display_text"), lambda m: F.trim(m.try_cast("string"))), lambda m: m != "")
    fields = {
        "supplier_id": _at(v, "seller", "sellerId"), "offer_id": item, "supplier_name": name, "products": _one_product(item, title, F.lit(None).cast("string")),
        "price": _some({"price": _at(v, "prices", "price", "priceText"), "extraPrice": _at(v, "prices", "extraPrice", "priceText"), "starting_price_text": _at(v, "starting_price_text")}),
        "signals": _some({k: _at(v, "rate", k) for k in SHAPES["item"]["rate"]}), "metrics": _list(F.transform(shown, lambda m: F.struct(F.lit(None).cast("string").alias("label"), m.alias("value"), F.lit("SHOP").alias("scope")))),
        "delivery": _list(F.transform(F.filter(shown, lambda m: m.rlike("^平均[0-9]+小时发货$")), lambda m: F.struct(F.lit(None).cast("string").alias("label"), m.alias("value"), F.lit("SHOP").alias("scope")))), "reviews": _reviews(reviews),
    }
    bad = (F.size(ids) == 0) | F.exists(ids, lambda i: ~F.coalesce(i == item, F.lit(False)))
    return _chosen((bad, "UNBOUND"), (_seller_conflicts(v), "SELLER_CONFLICT"), (_unbound(reviews, url), "UNBOUND_REVIEW"), (name.isNull() & title.isNull(), "NO_IDENTITY")), fields


def _shop(v: Column, url: Column) -> tuple[Column, dict[str, Column]]:
    shop, entries = F.regexp_extract(urls.taobao_identity(url), "^shop:(.*)$", 1), _items(v, "products")
    text = lambda x, k: F.nullif(F.trim(F.try_variant_get(x, f"$.{k}", "string")), F.lit(""))
    products = F.transform(entries, lambda p: _product(text(p, "offer_id"), text(p, "title"), urls.normalize_taobao(text(p, "source_url"))))
    odd = F.exists(products, lambda p: ~F.coalesce(urls.item_taobao(p["source_url"]) == p["offer_id"], F.lit(False)))
    metrics = F.filter(F.transform(_items(v, "evaluates"), lambda e: _metric(text(e, "title"), text(e, "score"), "SHOP")), lambda m: m.isNotNull())
    name, kept = _at(v, "seller", "shopName"), _first_offers(products)
    fields = {"supplier_id": _at(v, "seller", "sellerId"), "supplier_name": name, "years_active": F.nullif(F.regexp_extract(_at(v, "shopDuration"), "^([0-9]{1,3})年老店$", 1), F.lit("")).cast("int"), "products": kept, "metrics": _list(metrics)}
    return _chosen((_seller_conflicts(v, shop), "SELLER_CONFLICT"), (odd, "UNBOUND_PRODUCT"), (name.isNull() & kept.isNull(), "NO_IDENTITY")), fields


def _host(text: Column) -> Column:
    """The supplier's host of an address or a bare host; `?` if it is neither."""
    bare = F.regexp_extract(text, r"^(?:(?:https:)?//)?([^/?#@:]+)(?:/|/index\.html|/company_profile\.html)?$", 1)
    return F.when(text.isNotNull(), F.when(bare.rlike(rf"^{urls.LABEL}\.(?:m\.)?en\.alibaba\.com$"), bare).otherwise("?"))


def _alibaba_product(v: Column, url: Column) -> tuple[Column, dict[str, Column]]:
    own = F.regexp_extract(urls.alibaba_identity(url), "^product:(.*)$", 1)
    text = lambda x, k: F.nullif(F.trim(F.try_variant_get(x, f"$.{k}", "string")), F.lit(""))
    home = F.concat(_at(v, "seller", "home_identity", "hostname"), F.coalesce(_at(v, "seller", "home_identity", "path"), F.lit("")))
    hosts = F.array_distinct(F.array_compact(F.array(_host(_at(v, "seller", "subDomain")), _host(_at(v, "seller", "companyProfileUrl")), _host(home))))
    skus = F.exists(_items(v, "jsonld_identity"), lambda e: F.coalesce(text(e, "sku") != own, F.lit(False)))
    ranges, store, trade = ("offer_price", "productRangePrices"), ("storeReview",), ("tradeHalfYear",)
    low, high = _at(v, *ranges, "dollarPriceRangeLow"), _at(v, *ranges, "dollarPriceRangeHigh")
    quote = _some({"minimum": low, "maximum": high, "currency": F.when(low.isNotNull() | high.isNotNull(), "USD"), "display_text": _at(v, *ranges, "priceRangeText"), "unit": _at(v, "offer_price", "unit"), "minimum_order_quantity": _at(v, "offer_price", "moq")})
    performance = F.transform(_items(v, "onlinePerformance"), lambda m: _metric(text(m, "title"), text(m, "value"), "supplier performance"))
    traded = _metrics(_metric(F.lit("Online order amount (past 6 months)"), _at(v, *trade, "ordAmt"), "supplier tradeHalfYear"), _metric(F.lit("Online order amount (past 6 months)"), _at(v, *trade, "ordAmt6m"), "supplier tradeHalfYear"), _metric(F.lit("Online orders (past 6 months)"), _at(v, *trade, "ordCnt6m"), "supplier tradeHalfYear"))
    metrics = F.concat(F.filter(performance, lambda m: m.isNotNull()), traded)
    packed = [_metric(F.lit(label), _at(v, "delivery", k), scope) for k, label, scope in (("packagingDesc", "Packaging", "main product packaging"), ("unitSize", "Package size", "main product packaging"), ("unitWeight", "Package weight", "main product packaging"), ("supplierOnTimeDeliveryRate", "On-time dispatch rate", "supplier performance"), ("responseTimeText", "Response time", "supplier performance"))]
    ladder = F.exists(_items(v, "delivery", "ladderPeriodList"), lambda s: F.coalesce(text(s, "minQuantity").cast("decimal(20,0)") > text(s, "maxQuantity").cast("decimal(20,0)"), F.lit(False)))
    name, title, reviews = _at(v, "seller", "companyName"), _at(v, "subject"), _items(v, "review_bodies")
    stars, years = _at(v, *store, "averageStar").try_cast("double"), _at(v, "seller", "companyJoinYears").try_cast("int")
    fields = {
        "supplier_id": F.get(hosts, 0), "offer_id": own, "supplier_name": name, "company": _some({"company_name": name, "business_type": _at(v, "seller", "companyBusinessType"), "register_country": _at(v, "seller", "companyRegisterCountry")}), "years_active": years,
        "products": _one_product(own, title, url), "categories": _texts(F.transform(_items(v, "breadcrumb_names"), lambda c: F.trim(c.try_cast("string")))), "price": F.when(low.isNotNull() | high.isNotNull() | quote["display_text"].isNotNull(), quote), "rating": stars, "signals": _some({"review_count": _at(v, *store, "totalReviewCount")}),
        "metrics": _list(F.filter(metrics, lambda m: ~m["label"].isin(*DELIVERY_LABELS))), "delivery": _list(F.concat(F.filter(metrics, lambda m: m["label"].isin(*DELIVERY_LABELS)), _metrics(*packed))), "reviews": _reviews(reviews),
    }
    reason = _chosen(
        ((_at(v, "product_identity") != own) | skus, "UNBOUND"), (F.array_contains(hosts, "?") | (F.size(hosts) > 1), "SUPPLIER_CONFLICT"), (low.try_cast("double") > high.try_cast("double"), "PRICE_CONFLICT"), ((stars > 5) | (years > 200), "OUT_OF_RANGE"), (ladder, "LEAD_TIME_CONFLICT"), (_unbound(reviews, url), "UNBOUND_REVIEW"), (name.isNull() & title.isNull(), "NO_IDENTITY"),
    )
    return reason, fields


def _profile(v: Column, url: Column) -> tuple[Column, dict[str, Column]]:
    host = F.concat(F.regexp_extract(urls.alibaba_identity(url), "^profile:(.*)$", 1), F.lit(".en.alibaba.com"))
    text = lambda x, k: F.nullif(F.trim(F.try_variant_get(x, f"$.{k}", "string")), F.lit(""))
    p, bar = ("supplierPerformance",), ("supplierActionBar",)
    names = F.array_distinct(F.array_compact(F.array(_at(v, *p, "companyName"), _at(v, *bar, "companyName"))))
    tenure = _at(v, *p, "years", "value")
    links = F.transform(_items(v, "categories"), lambda c: F.coalesce(F.try_variant_get(c, "$.href", "string"), F.lit("")))
    odd_links = F.exists(links, lambda u: ~(u.rlike(r"^(?:(?:https:)?//[^/?#]+)?/[^?#]*productgrouplist-|^/productgrouplist-") & F.coalesce((F.regexp_extract(u, r"^(?:https:)?//([^/?#]+)", 1) == "") | (F.regexp_extract(u, r"^(?:https:)?//([^/?#]+)", 1) == host), F.lit(False))))
    claims = F.transform(_items(v, "company_card_claims"), lambda c: c.try_cast("string"))
    products = F.transform(_items(v, "products"), lambda x: _product(text(x, "offer_id"), F.trim(unescaped(text(x, "title"))), text(x, "source_url")))
    odd = F.exists(products, lambda x: ~F.coalesce(urls.alibaba_identity(x["source_url"]) == F.concat(F.lit("product:"), x["offer_id"]), F.lit(False)))
    able = F.filter(F.transform(_items(v, "factoryCapability"), lambda c: F.struct(text(c, "label").alias("key"), text(c, "value").alias("value"))), lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    last = F.filter(able, lambda e, i: ~F.exists(F.slice(able, i + 2, F.size(able)), lambda o: o["key"] == e["key"]))
    markets = F.array_join(F.transform(_items(v, "markets"), lambda m: F.trim(F.concat_ws(" ", text(m, "name"), text(m, "percentage")))), " · ")
    own = F.coalesce(_some({"company_name": F.get(names, 0), "markets_display_text": F.nullif(markets, F.lit("")), "business_type": F.when(F.array_contains(claims, "Custom Manufacturer"), "Custom Manufacturer"), "register_country": F.when(F.array_contains(claims, "CN"), "CN")}), F.create_map().cast("map<string,string>"))
    company = F.map_concat(F.map_filter(F.map_from_entries(last), lambda k, _: ~F.map_contains_key(own, k)), own)
    measure = lambda k: _metric(_at(v, *p, k, "label"), F.coalesce(_at(v, *p, k, "amount"), _at(v, *p, k, "value")), "supplier performance")
    stars, action = _at(v, *p, "reviews", "value"), _at(v, *bar, "rating")
    held = F.filter(F.transform(_items(v, "certifications"), lambda c: F.when(text(c, "name").isNotNull() & text(c, "category").isNotNull(), F.concat(text(c, "name"), F.lit(" ("), text(c, "category"), F.lit(")")))), lambda c: c.isNotNull())
    kept = _first_offers(products)
    fields = {
        "supplier_id": host, "supplier_name": F.get(names, 0), "company": F.when(F.size(F.map_keys(company)) > 0, company), "years_active": F.nullif(F.regexp_extract(tenure, "^([0-9]{1,3}) yrs?$", 1), F.lit("")).cast("int"),
        "categories": _texts(F.transform(_items(v, "categories"), lambda c: F.trim(unescaped(text(c, "text"))))), "certifications": _texts(held), "products": kept, "rating": stars.try_cast("double"), "signals": _some({"review_count": _at(v, *p, "reviews", "count")}),
        "metrics": _list(_metrics(*map(measure, ("onlineTransactions", "bigBuyerCount", "reorderRate")), _metric(F.lit("Rating"), action, "supplier action bar"))), "delivery": _list(_metrics(*map(measure, ("shippingDays", "responseTime")))),
    }
    reason = _chosen(
        (~F.coalesce(_at(v, "esiteSubDomain") == host, F.lit(False)), "UNBOUND"), (F.size(names) > 1, "SUPPLIER_CONFLICT"), (tenure.isNotNull() & ~tenure.rlike("^[0-9]{1,3} yrs?$"), "TENURE"), (F.exists(claims, lambda c: ~c.isin("Custom Manufacturer", "CN")), "UNSUPPORTED_CLAIM"),
        (odd_links, "UNBOUND_CATEGORY"), (odd, "UNBOUND_PRODUCT"), (stars.isNotNull() & ~F.coalesce(stars.try_cast("double").between(0, 5), F.lit(False)) | F.coalesce(action.try_cast("double") > 5, F.lit(False)), "OUT_OF_RANGE"), ((F.size(names) == 0) & kept.isNull(), "NO_IDENTITY"),
    )
    return reason, fields


def unescaped(text: Column) -> Column:
    """The five named character references and the numeric ones of apostrophes as characters."""
    for name, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(to))
    return text


LAYOUTS = {"offer": _offer, "item": _item, "shop": _shop, "product": _alibaba_product, "profile": _profile}


def layout(url: Column) -> Column:
    """The layout of a canonical address, else null."""
    return (
        F.when(urls.normalize_1688(url) == url, "offer").when((urls.normalize_taobao(url) == url) & urls.item_taobao(url).isNotNull(), "item").when(urls.normalize_taobao(url) == url, "shop")
        .when((urls.normalize_alibaba(url) == url) & urls.alibaba_identity(url).startswith("product:"), "product").when(urls.normalize_alibaba(url) == url, "profile")
    )


def replayed(captures: DataFrame) -> DataFrame:
    """captures: snapshot_id, source_url, extraction_method, analysis_mode, extracted_at, extractor_version, raw (JSON). One row each.

    snapshot_id, source_url, layout, EVIDENCE, completeness, missing_fields, status (REPLAYED or UNSUPPORTED) and reason. Captures that were replays themselves, of another
    revision, with other provenance than their payload names, or with a field that no capture of the layout keeps are unsupported and carry no evidence.
    """
    url, method = F.col("source_url"), F.col("extraction_method")
    rows = captures.withColumns({"_v": F.try_parse_json("raw"), "layout": layout(url)})
    v, of = F.col("_v"), F.col("layout")
    fields = F.try_variant_get(v, "$.public_fields", "variant")
    envelope = v.try_cast("map<string,variant>")
    said = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    platform = F.when(of == "offer", "1688").when(of.isin("item", "shop"), "taobao").otherwise("alibaba")
    version = F.when(method == "PUBLIC_HTTP", F.concat(platform, F.lit("-http.v1"))).when(method == "PUBLIC_BROWSER", "public-browser.v1")
    digest = lambda c: F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))
    no = lambda a, b: ~F.coalesce(a == b, F.lit(False))
    browser = method == "PUBLIC_BROWSER"
    sound_envelope = F.forall(F.map_keys(envelope), lambda k: k.isin("public_fields", *ENVELOPE)) & F.forall(F.map_values(F.map_filter(envelope, lambda k, _: k != "public_fields")), lambda x: _scalar(x, "string"))
    shape, complete, reason, found = F.lit(False), F.lit(False), None, {}
    for name, read in LAYOUTS.items():
        why, values = read(fields, url)
        shape, complete = F.when(of == name, fits(fields, SHAPES[name])).otherwise(shape), F.when(of == name, F.size(F.array_except(F.array(*(F.lit(k) for k in SHAPES[name] if k not in SPARE.get(name, ()))), F.map_keys(fields.try_cast("map<string,variant>")))) == 0).otherwise(complete)
        reason = F.when(of == name, why) if reason is None else reason.when(of == name, why)
        for k, kind in EVIDENCE.items():
            value = values.get(k, F.lit(None)).cast(kind)
            found[k] = F.when(of == name, value) if k not in found else found[k].when(of == name, value)
    why = F.coalesce(
        _chosen(
            (of.isNull(), "UNSUPPORTED_ADDRESS"), (~method.isin("PUBLIC_HTTP", "PUBLIC_BROWSER") | no(F.col("analysis_mode"), F.lit("ACCOUNT_PUBLIC")) | method.isNull(), "NOT_PUBLIC"), (~F.coalesce(sound_envelope, F.lit(False)), "UNEXPECTED_FIELD"),
            (no(said("source_url"), url) | no(said("captured_at"), F.col("extracted_at")) | ~digest(said("html_sha256")), "PROVENANCE"), (no(F.col("extractor_version"), version) | (F.coalesce(said("extractor_version"), version) != version), "REVISION"), (F.coalesce(said("extraction_method"), method) != method, "PROVENANCE"),
            (~F.col("extracted_at").rlike(r"(?:[zZ]|[+-][0-9]{2}:?[0-9]{2})$") | F.col("extracted_at").try_cast("timestamp").isNull(), "PROVENANCE"), (browser & (no(said("extractor_version"), version) | no(said("rendered_at"), F.col("extracted_at")) | ~digest(said("rendered_html_sha256"))), "PROVENANCE"),
            (F.contains("raw", F.lit("\\u0000")), "UNEXPECTED_FIELD"), (~F.coalesce(shape, F.lit(False)), "UNEXPECTED_FIELD"), (~F.coalesce(complete, F.lit(False)), "MISSING_FIELD"),
        ),
        reason,
    )
    rows = rows.withColumn("reason", why).withColumns({k: F.when(F.col("reason").isNull(), c) for k, c in found.items()})
    there = {
        "supplier_name": "supplier_name", "company_information": "company", "years_active": "years_active", "categories": "categories", "certifications": "certifications", "products": "products", "price_information": "price", "rating": "rating", "reviews": "reviews", "delivery_information": "delivery",
    }
    lacks = {n: F.col(c).isNull() for n, c in there.items()} | {"transaction_signals": F.col("signals").isNull() & F.col("metrics").isNull()}
    missing = F.array_compact(F.array(*(F.when(lacks.get(n, F.lit(True)), n) for n in scalars.COVERAGE_FIELDS)))
    sound = F.col("reason").isNull()
    return rows.select(
        "snapshot_id", "source_url", "layout", *EVIDENCE, F.when(sound, F.round(1 - F.size(missing) / len(scalars.COVERAGE_FIELDS), 4)).alias("completeness"), F.when(sound, missing).alias("missing_fields"), F.when(sound, "REPLAYED").otherwise("UNSUPPORTED").alias("status"), "reason",
    )
