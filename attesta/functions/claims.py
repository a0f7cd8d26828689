"""What suppliers claim about themselves and what models cite, as columns. Unless a function says otherwise, null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of factory profiles that are kept, and the numeric field and unit of those that are numbers.
FACTORY_FIELDS = ["成立时间", "年交易额", "员工总数", "定制起订量", "贴牌起订量", "接外贸订单", "加工方式", "增值税发票", "企业面积", "工厂面积", "厂房面积", "生产线数量", "设备总数", "经营模式"]
AREA = r"^([0-9]+(?:\.[0-9]+)?)\s*(?:m²|m2|㎡|平方米)$"
NUMERIC_CLAIMS = {
    "company_area_sqm": [("企业面积", AREA)],
    "factory_area_sqm": [("工厂面积", AREA), ("厂房面积", AREA)],
    "production_line_count": [("生产线数量", r"^([0-9]+)\s*(?:条|条生产线)?$")],
    "equipment_count": [("设备总数", r"^([0-9]+)\s*(?:台|台设备)?$")],
}
SHOWN_CLAIMS = {"employee_count_display_text": "员工总数", "processing_methods_display_text": "加工方式", "business_type": "经营模式"}
#: Words of a business type.
FACTORY_WORDS = "manufacturer|factory|manufacturing|生产|工厂"
TRADER_WORDS = "trading|trader|wholesale|贸易|经销"
PROCESSING_WORDS = "来样加工|来图加工|生产|加工定制"
MOST_QUOTE = 400


def years_active(text: Column) -> Column:
    """The years of `12年老店` or `12 yrs`, else null."""
    pattern = r"^([0-9]{1,3})(?:年老店| yrs?)$"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1).cast("int"))


def business_directions(business_type: Column) -> Column:
    """FACTORY, TRADER or both, by the words of a business type; an empty array if it says neither."""
    text = F.lower(business_type)
    return F.when(text.isNotNull(), F.array_compact(F.array(F.when(text.rlike(FACTORY_WORDS), "FACTORY"), F.when(text.rlike(TRADER_WORDS), "TRADER"))))


def labelled_claims(display_text: Column) -> Column:
    """The known labels of `label: value; label: value` as a map."""
    parts = F.filter(F.split(display_text, ";"), lambda p: F.contains(p, F.lit(":")))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("value")))
    known = F.filter(pairs, lambda e: e["key"].isin(FACTORY_FIELDS))
    last = F.filter(known, lambda e, i: ~F.exists(F.slice(known, i + 2, F.size(known)), lambda later: later["key"] == e["key"]))  # of a repeated label the last holds
    return F.map_from_entries(last)


def factory_numbers(claims: Column) -> Column:
    """A struct of the numbers above 0 and shown texts of labelled claims; a number that two labels state differently is null. Area of a company is no factory's."""
    out = []
    for field, labels in NUMERIC_CLAIMS.items():
        values = F.array_compact(F.array(*(F.when(claims[label].rlike(p), F.nullif(F.regexp_extract(claims[label], p, 1).cast("double"), F.lit(0.0))) for label, p in labels)))
        out.append(F.when(F.size(F.array_distinct(values)) == 1, values[0]).alias(field))
    return F.struct(*out, *(F.nullif(claims[label], F.lit("")).alias(field) for field, label in SHOWN_CLAIMS.items()))


def metric(label: Column, value: Column, scope: Column, description: Column) -> Column:
    """A platform metric as a struct; null without a label or a value."""
    return F.when((F.trim(label) != "") & (F.trim(value) != ""), F.struct(F.trim(label).alias("label"), F.trim(value).alias("value"), scope.alias("scope"), F.nullif(F.trim(description), F.lit("")).alias("description")))


def product_key(offer_id: Column, source_url: Column) -> Column:
    """What tells products apart: the offer, else the address, whatever the case; never null."""
    return F.lower(F.coalesce(F.nullif(offer_id, F.lit("")), source_url, F.lit("")))


def percent(value: Column) -> Column:
    """A share as a whole percentage, halves up."""
    return F.concat(F.floor(value * 100 + 0.5).cast("string"), F.lit("%"))


def bar_width(value: Column) -> Column:
    """The width of a bar for a share, from 0% to 100%; 0% for null."""
    return F.concat(F.coalesce(F.greatest(F.lit(0), F.least(F.lit(100), F.floor(value * 100 + 0.5))), F.lit(0)).cast("string"), F.lit("%"))


def canonical_quotes(quotes: Column, allowed: list[str]) -> Column:
    """Quotes by source field (map) with dotted names taken back to their root: a struct of the map and of an error, one of which is null.

    Null quotes are left out. Errors: an unsupported field, a quote that is blank or too long, two different quotes of one field.
    """
    named = F.transform(F.map_entries(quotes), lambda e: F.struct(F.substring_index(e["key"], ".", 1).alias("key"), e["value"].alias("value")))
    given = F.array_distinct(F.filter(named, lambda e: e["value"].isNotNull()))
    roots = F.array_distinct(F.transform(given, lambda e: e["key"]))
    error = (
        F.when(F.exists(named, lambda e: ~e["key"].isin(allowed)), "unsupported field").when(F.exists(given, lambda e: (F.trim(e["value"]) == "") | (F.length(e["value"]) > MOST_QUOTE)), "quote of no length")
        .when(F.size(roots) < F.size(given), "conflicting quotes")
    )
    return F.struct(F.when(error.isNull(), F.map_from_entries(F.when(error.isNull(), given))).alias("quotes"), error.alias("error"))


def media_fingerprint(data_url: Column) -> Column:
    """The digest of the bytes of a base64 data URL of an image; null for anything else."""
    pattern = r"^data:image/(?:png|jpeg|webp);base64,([A-Za-z0-9+/]+={0,2})$"
    return F.when(data_url.rlike(pattern), F.sha2(F.try_to_binary(F.regexp_extract(data_url, pattern, 1), F.lit("base64")), 256))


#: Escapes that no stored JSON may hold, behind an even number of backslashes: NUL, and halves of surrogate pairs without the other half.
_ESCAPED, _HIGH, _LOW = r"(?<!\\)(?:\\\\)*+", r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
UNSTORABLE = rf"{_ESCAPED}\\u0000|{_ESCAPED}{_HIGH}(?!{_LOW})|(?<!{_HIGH}){_ESCAPED}(?<!{_HIGH}){_LOW}"


def storable(text: Column) -> Column:
    """Whether a JSON text can be kept as evidence: well formed, no repeated keys, no NUL, no half of a surrogate pair and no number that is none."""
    return F.coalesce(F.try_parse_json(text).isNotNull() & ~F.contains(text, F.lit("\u0000")) & ~text.rlike(UNSTORABLE) & ~text.rlike(r"(?<![\"\w])(?:NaN|-?Infinity)(?![\"\w])"), F.lit(False))


def canonical_json(text: Column) -> Column:
    """The one form of equal JSON: keys in order at every depth, no spaces, numbers without trailing zeros. Null for malformed texts and those with repeated keys. Stays in the JVM."""
    return F.to_json(F.try_parse_json(text))


def json_digest(text: Column) -> Column:
    """The digest by which replays are told from other content: that of the canonical form."""
    return F.sha2(canonical_json(text), 256)
