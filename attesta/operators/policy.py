"""Rules between evidence and score: credibility of small samples, mapping of findings to dimensions, gates for claims of a model, search and accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators import extraction

#: Severities of labels and the dimension of every complaint category.
SEVERITY = {"NONE": 0.0, "LOW": 25.0, "MEDIUM": 55.0, "HIGH": 80.0}
DIMENSION = {"QUALITY": "PRODUCT_QUALITY", "PRODUCT_MISMATCH": "PRODUCT_QUALITY", "PACKAGING": "PRODUCT_QUALITY", "DELIVERY": "DELIVERY", "AFTER_SALES": "AFTER_SALES"}
SKIPPED = ("SUPPLIER_IDENTITY", "REVIEW_MANIPULATION")
#: Fields that can support a dimension.
DIMENSION_FIELDS = {
    "PRODUCT_QUALITY": ["reviews", "transaction_signals", "certifications"],
    "SUPPLIER_IDENTITY": ["company_information", "certifications", "activity_history"],
    "DELIVERY": ["delivery_information", "transaction_signals", "reviews"],
    "REVIEW_MANIPULATION": ["reviews"],
    "AFTER_SALES": ["reviews", "transaction_signals", "company_information", "products", "page_context"],
    "PRICING": ["price_information", "page_context"],
    "COMMUNICATION": ["reviews", "transaction_signals"],
}
#: What quotes have to be about, and what they must not rest on.
AMBIGUOUS_RATES = ["store return rate", "dropshipping buyer's return rate", "return customer rate"]
RATE_QUOTE = "(?i)回头率|store return rate|return customer rate|dropshipping buyer.s return rate"
AFTER_SALES_TOPIC = "(?i)售后|退款|退货|换货|赔付|refund|return|exchange|warranty|after.sales|dispute|compensation|hoàn tiền|đổi trả|hậu mãi"
PRICING_TOPIC = "(?i)¥|￥|价格|起批|USD|CNY|RMB|price|MOQ|minimum|payment"
PROTECTION = "(?i)guaranteed compensation|free return shipping|full refund|赔付保障|无理由退货"
RESTRICTION = "(?i)not refundable|non.refundable|no refunds|refus|denied|all sales final|buyer pays|buyer.s expense|不退|拒绝|不支持退|不能退"
SUPPLIER_CAP, AFTER_SALES_CAP, SINGLE_REVIEW_CAP = 0.7, 0.6, 0.4


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def after_sales_cap(dimension: Column, reviews: Column) -> Column:
    """The most that a statement on AFTER_SALES is worth: less if fewer than two reviews are accessible. 1 for other dimensions."""
    return F.when(dimension == "AFTER_SALES", F.when(reviews < 2, SINGLE_REVIEW_CAP).otherwise(AFTER_SALES_CAP)).otherwise(1.0)


def score_inputs(findings: DataFrame) -> DataFrame:
    """Semantic review findings as signals: adds dimension, severity and reliability. Categories without a dimension and findings of severity NONE give none.

    findings: category, severity_label, confidence, review_reliability, media_factor (the mean factor of the cited reviews' media; null counts
    as 1) and accessible_reviews.
    """
    rows = findings.withColumns({"dimension": _map(DIMENSION)[F.col("category")], "severity": _map(SEVERITY)[F.col("severity_label")]}).where("dimension is not null and severity_label <> 'NONE' and severity is not null")
    worth = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("review_reliability") * F.col("confidence") * F.coalesce("media_factor", F.lit(1.0))))
    return rows.withColumn("reliability", F.least(worth, after_sales_cap(F.col("dimension"), F.col("accessible_reviews"))))


def pattern_signals(patterns: DataFrame) -> DataFrame:
    """Suspicious patterns (supplier, kind, strength, reliability) as signals of REVIEW_MANIPULATION with a severity of a hundred times their strength."""
    return patterns.select("supplier", F.concat(F.lit("review-pattern:"), "kind").alias("evidence_id"), F.lit("REVIEW_MANIPULATION").alias("dimension"), (F.col("strength") * 100).alias("severity"), "reliability", F.lit("DERIVED").alias("source_kind"), F.lit(False).alias("review_derived"))


def preliminary_credibility(counts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Suppliers with ten reviews or more and no pattern get one mild manipulation signal of severity 35.

    counts: supplier, review_count, review_confidence, and whether timestamps and ratings are missing (no_timestamps, no_ratings). The confidence is the
    reviews' own, at most 0.6, 0.45 without timestamps and 0.4 without ratings.
    """
    clean = counts.where("review_count >= 10").join(patterns.select("supplier").distinct(), "supplier", "left_anti")
    confidence = F.least("review_confidence", F.lit(0.6), F.when(F.col("no_timestamps"), 0.45).otherwise(1.0), F.when(F.col("no_ratings"), 0.4).otherwise(1.0))
    return clean.select("supplier", F.lit("review-sample:credibility").alias("evidence_id"), F.lit("REVIEW_MANIPULATION").alias("dimension"), F.lit(35.0).alias("severity"), confidence.alias("confidence"))


def gate(dimension: Column, severity: Column, fields: Column, quotes: Column, fragments: Column, metrics: Column, reviews: Column, confidence: Column) -> Column:
    """The first rule that a model's claim about a dimension breaks, or null.

    fields: cited source fields; quotes: map of a field to its quote; fragments: map of a field to the texts of its value, at any depth; metrics: the
    labels and values of the supplier's platform metrics, null if there are none; reviews: how many are accessible.
    """
    in_context, sales = F.array_contains(fields, "page_context"), dimension == "AFTER_SALES"
    context, products, signals = quotes["page_context"], quotes["products"], quotes["transaction_signals"]
    concern = severity.isin("MEDIUM", "HIGH")
    keys = F.map_keys(quotes)
    scope = F.create_map(*(x for d, names in DIMENSION_FIELDS.items() for x in (F.lit(d), F.array(*map(F.lit, names)))))[dimension]
    about = F.array_join(F.map_values(quotes), " ")
    promised = about.rlike(PROTECTION) & ~about.rlike(RESTRICTION)
    with_metrics = F.array_contains(fields, "transaction_signals") & metrics.isNotNull()
    ambiguous = F.exists(metrics, lambda m: F.lower(m["label"]).isin(AMBIGUOUS_RATES) & F.contains(signals, m["label"]))
    quoted = F.exists(metrics, lambda m: F.contains(signals, m["label"]) & F.contains(signals, m["value"]))
    unsupported = F.exists(fields, lambda f: ~F.coalesce(F.exists(fragments[f], lambda x: F.contains(x, quotes[f])), F.lit(False)))
    rules = [
        (dimension.isin(*SKIPPED), "skipped"),
        (F.coalesce(severity, F.lit("UNKNOWN")) == "UNKNOWN", "unknown severity"),
        (F.coalesce(F.size(fields), F.lit(0)) <= 0, "no fields"),
        (F.coalesce((F.size(F.array_except(fields, keys)) > 0) | (F.size(F.array_except(keys, fields)) > 0), F.lit(True)), "fields are not quoted"),
        (~F.coalesce(F.arrays_overlap(fields, scope), F.lit(False)), "out of scope"),
        (in_context & ~extraction.quote_supported(context, fragments["page_context"]), "no such passage"),
        (in_context & context.rlike(RATE_QUOTE), "ambiguous rate"),
        (in_context & (sales & ~context.rlike(AFTER_SALES_TOPIC) | (dimension == "PRICING") & ~context.rlike(PRICING_TOPIC)), "off topic"),
        (sales & F.array_contains(fields, "products") & ~products.rlike(AFTER_SALES_TOPIC), "off topic"),
        (sales & concern & ~F.arrays_overlap(fields, F.array(F.lit("reviews"), F.lit("transaction_signals"))) & promised, "a promise is no concern"),
        (with_metrics & ambiguous, "ambiguous rate"),
        (with_metrics & ~quoted, "no metric quoted"),
        (unsupported, "quote not in the source"),
        (F.array_contains(fields, "reviews") & (reviews < 2) & ~(sales & concern), "too few reviews"),
        (F.coalesce(confidence, F.lit(0.0)) <= 0, "no confidence"),
    ]
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for broken, name in rules:
        out = out.when(F.coalesce(broken, F.lit(False)), name)
    return out


def claim_confidence(dimension: Column, confidence: Column, overall: Column, review_derived: Column, reviews: Column) -> Column:
    """What a claim that passed the gate is worth: its own and the interpretation's confidence, at most SUPPLIER_CAP, and less for AFTER_SALES."""
    sales = dimension == "AFTER_SALES"
    return F.least(confidence, overall, F.lit(SUPPLIER_CAP), F.when(sales, AFTER_SALES_CAP).otherwise(1.0), F.when(sales & review_derived & (reviews < 2), SINGLE_REVIEW_CAP).otherwise(1.0))


def without_review_overlap(claims: DataFrame, inputs: DataFrame) -> DataFrame:
    """Drops claims drawn from reviews for dimensions that review findings support already. Both: supplier, dimension, review_derived."""
    held = inputs.where("review_derived").select("supplier", "dimension").distinct().withColumn("_held", F.lit(True))
    return claims.join(held, ["supplier", "dimension"], "left").where("_held is null or not review_derived").drop("_held")


def confidence_factors(run_confidence: Column, review_reliability: Column, identity_confidence: Column, reviews: Column, uploaded: Column) -> Column:
    """source_reliability (mean of what is known), sample_adequacy (reviews of SAMPLE) and data_freshness (0 for pages that a user saved)."""
    known = F.array_compact(F.array(run_confidence, F.when(reviews > 0, review_reliability), identity_confidence))
    mean = F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size(known), F.lit(1))
    return F.struct(
        F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)).alias("source_reliability"), F.least(F.lit(1.0), F.coalesce(reviews, F.lit(0)) / 8).alias("sample_adequacy"),
        F.when(F.coalesce(uploaded, F.lit(False)), 0.0).otherwise(1.0).alias("data_freshness"),
    )


def material(dimension: Column, risk: Column, confidence: Column) -> Column:
    """Sums of the same signals in another order differ in their last digits, so the thresholds are held against nine decimals: a risk of 55 is material however it was summed."""
    return F.coalesce((F.round(risk, 9) >= 55) & (F.round(confidence, 9) >= 0.4) & ~dimension.isin("REVIEW_MANIPULATION"), F.lit(False))


def matches(query: str, *columns: Column) -> Column:
    """Whether any of the columns contains the words asked for, whatever their case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(query.lower())), F.lit(False))
    return found


def account_state(users: DataFrame, entitlements: DataFrame, usage: DataFrame, at: Column, limits: tuple[int, int] = (20, 40)) -> DataFrame:
    """Per user the preferred entitlement (active first, then the latest start), the limit it gives, and what is used and left of it."""
    active = (F.col("status") == "ACTIVE") & (F.col("starts_at") <= at) & (F.col("expires_at").isNull() | (F.col("expires_at") > at))
    ranked = entitlements.withColumn("active", F.coalesce(active, F.lit(False))).withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("active"), F.desc("starts_at"), "entitlement"))).where("r = 1")
    joined = users.join(ranked.select("user_id", "entitlement", "active"), "user_id", "left").join(usage, "user_id", "left")
    limit = F.when(F.coalesce("active", F.lit(False)), limits[1]).otherwise(limits[0])
    return joined.select("user_id", "entitlement", F.coalesce("active", F.lit(False)).alias("active"), limit.alias("limit"), F.coalesce("used", F.lit(0)).alias("used"), F.greatest(limit - F.coalesce("used", F.lit(0)), F.lit(0)).alias("remaining"))


def missing_copies(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys of which fewer copies are present than wanted: key, missing."""
    w = wanted.groupBy(key).agg(F.count("*").alias("w"))
    p = present.groupBy(key).agg(F.count("*").alias("p"))
    return w.join(p, key, "left").select(key, (F.col("w") - F.coalesce("p", F.lit(0))).alias("missing")).where("missing > 0")
