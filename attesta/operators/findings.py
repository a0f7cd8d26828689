"""What assessments leave behind: findings, evidence and signals of all suppliers as rows.

Findings have the columns supplier, finding_key, finding_type, dimension, severity, confidence; evidence has supplier, evidence_id, source_kind, source_field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators import policy
from attesta.operators.reviews import categories, folded

FINDING = ("supplier", "finding_key", "finding_type", "dimension", "severity", "confidence")


def _finding(rows: DataFrame, key: Column, kind: str, dimension: Column, severity: Column, confidence: Column) -> DataFrame:
    return rows.select("supplier", key.alias("finding_key"), F.lit(kind).alias("finding_type"), dimension.cast("string").alias("dimension"), severity.cast("double").alias("severity"), confidence.cast("double").alias("confidence"))


def _text(*parts: Column) -> Column:
    return F.concat(*(p.cast("string") for p in parts))


def adapted_reviews(snapshots: DataFrame) -> DataFrame:
    """The reviews of stored documents: supplier, evidence_id, text, aggregate_count. snapshots: supplier, reviews (array of struct text), transaction_review_count.

    Reviews are named after their place in the document, counted before blank and missing ones are left out; a negative total is none.
    """
    each = snapshots.select("supplier", F.when(F.col("transaction_review_count") >= 0, F.col("transaction_review_count")).alias("aggregate_count"), F.posexplode("reviews").alias("pos", "review"))
    return each.where(F.trim("review.text") != "").select("supplier", _text(F.lit("review:"), F.col("pos")).alias("evidence_id"), F.col("review.text").alias("text"), "aggregate_count")


def topics(reviews: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Complaint topics with two reviews or more, numbered in the order of their names: supplier, number, category, evidence_ids (sorted), reliability."""
    each = folded(reviews).select("supplier", "evidence_id", F.explode(categories(F.col("folded"), lexicon)).alias("category"))
    per = each.groupBy("supplier", "category").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"), F.count("*").alias("n")).where("n >= 2")
    return per.select("supplier", (F.row_number().over(Window.partitionBy("supplier").orderBy("category")) - 1).alias("number"), "category", "evidence_ids", F.lit(1.0).alias("reliability"))


def topic_findings(found: DataFrame) -> DataFrame:
    return _finding(found, _text(F.lit("review-topic:"), F.col("number"), F.lit(":"), F.col("category")), "REVIEW_COMPLAINT_TOPIC", policy._map(policy.DIMENSION)[F.col("category")], F.lit(None), F.col("reliability"))


def review_findings(found: DataFrame) -> DataFrame:
    """Semantic findings (supplier, number, category, severity_label, confidence, evidence_ids)."""
    key = F.concat_ws(":", F.lit("review"), F.col("number").cast("string"), "category", F.array_join("evidence_ids", ","))
    return _finding(found, key, "REVIEW_FINDING", policy._map(policy.DIMENSION)[F.col("category")], policy._map(policy.SEVERITY)[F.col("severity_label")], F.col("confidence"))


def pattern_findings(patterns: DataFrame) -> DataFrame:
    """Suspicious patterns (supplier, number, kind, strength, reliability)."""
    return _finding(patterns, _text(F.lit("review-pattern:"), F.col("number"), F.lit(":"), F.col("kind")), "REVIEW_PATTERN", F.lit("REVIEW_MANIPULATION"), F.col("strength") * 100, F.col("reliability"))


def identity_findings(assessed: DataFrame) -> DataFrame:
    """One finding a supplier (confidence, contradictory): of severity 60 where factory and trader evidence conflict, else of none."""
    return _finding(assessed, F.lit("identity:assessment"), "IDENTITY_ASSESSMENT", F.lit("SUPPLIER_IDENTITY"), F.when(F.col("contradictory"), 60.0), F.col("confidence"))


def identity_inputs(assessed: DataFrame) -> DataFrame:
    """The signal that a conflict is for SUPPLIER_IDENTITY: supplier, evidence_id, dimension, severity, reliability, confidence."""
    return assessed.where("contradictory").select("supplier", F.lit("identity:contradictory").alias("evidence_id"), F.lit("SUPPLIER_IDENTITY").alias("dimension"), F.lit(60.0).alias("severity"), F.greatest("confidence", F.lit(0.25)).alias("reliability"), "confidence")


def media_findings(found: DataFrame) -> DataFrame:
    """Findings on review media (supplier, number, media_id, confidence)."""
    return _finding(found, _text(F.lit("media:"), F.col("number"), F.lit(":"), F.col("media_id")), "MEDIA_CONSISTENCY", F.lit(None), F.lit(None), F.col("confidence"))


def supplier_findings(runs: DataFrame) -> DataFrame:
    """A model's positive, risk and uncertainty signals: supplier, and arrays of struct(confidence, evidence_fields) named positive, risk and uncertainty. Runs are passed over once."""
    of = lambda name: F.transform(name, lambda s, i: F.struct(F.lit(name).alias("kind"), i.alias("number"), s["confidence"].cast("double").alias("confidence")))
    listed = map(of, ("positive", "risk", "uncertainty"))
    each = runs.select("supplier", F.explode(F.flatten(F.array_compact(F.array(*listed)))).alias("s"))
    return each.select(
        "supplier", _text(F.lit("supplier_"), F.col("s.kind"), F.lit(":"), F.col("s.number")).alias("finding_key"), F.concat(F.lit("SUPPLIER_"), F.upper("s.kind")).alias("finding_type"),
        F.lit(None).cast("string").alias("dimension"), F.lit(None).cast("double").alias("severity"), "s.confidence",
    )


def supplier_evidence(runs: DataFrame) -> DataFrame:
    """The source fields that those signals cite, each once a supplier."""
    fields = F.array_distinct(F.flatten(F.transform(F.concat("positive", "risk", "uncertainty"), lambda s: s["evidence_fields"])))
    each = runs.select("supplier", F.explode(fields).alias("field"))
    return each.select("supplier", F.concat(F.lit("supplier:"), "field").alias("evidence_id"), F.lit("SUPPLIER_DATA").alias("source_kind"), F.col("field").alias("source_field")).distinct()


def cited_reviews(found: DataFrame, payload: Column) -> DataFrame:
    """The reviews that topics or patterns cite as evidence, with a payload of their own."""
    return found.select("supplier", F.explode("evidence_ids").alias("evidence_id"), F.lit("REVIEW").alias("source_kind"), F.lit("reviews").alias("source_field"), payload.alias("payload"))


def first_written(*groups: DataFrame) -> DataFrame:
    """Evidence of several groups, the first of an id counts."""
    ranked = None
    for n, group in enumerate(groups):
        part = group.withColumn("_group", F.lit(n))
        ranked = part if ranked is None else ranked.unionByName(part, allowMissingColumns=True)
    first = Window.partitionBy("supplier", "evidence_id").orderBy("_group", *(c for c in ("payload",) if c in ranked.columns))
    return ranked.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank", "_group")


def business_evidence(profiles: DataFrame) -> DataFrame:
    """What a business type and certificates say of factory or trader: evidence as operators.identity takes it. profiles: supplier, directions, certifications."""
    claimed = profiles.select("supplier", F.explode("directions").alias("direction")).select("supplier", F.concat(F.lit("company_information.business_type."), F.lower("direction")).alias("evidence_id"), "direction", F.lit(0.75).alias("strength"), F.lit(0.55).alias("reliability"), F.lit("SELF_CLAIM").alias("source_kind"))
    certified = profiles.where(F.size("certifications") > 0).select("supplier", F.lit("certifications.present").alias("evidence_id"), F.lit("NEUTRAL").alias("direction"), F.lit(0.0).alias("strength"), F.lit(0.5).alias("reliability"), F.lit("PLATFORM_PROFILE").alias("source_kind"))
    return claimed.unionByName(certified)


def factory_claim_evidence(profiles: DataFrame) -> DataFrame:
    """What a factory profile's labelled claims say: the profile itself, sizes (neutral), and processing for others. profiles: supplier, profile_url (canonical or null), claims (map)."""
    from attesta.functions.claims import PROCESSING_WORDS

    row = lambda name, direction, strength, reliability, kind: F.struct(F.lit(f"company_information.{name}").alias("evidence_id"), F.lit(direction).alias("direction"), F.lit(strength).alias("strength"), F.lit(reliability).alias("reliability"), F.lit(kind).alias("source_kind"))
    c = F.col("claims")
    items = F.array_compact(
        F.array(
            row("factory_profile_source_url", "FACTORY", 0.35, 0.5, "SELF_CLAIM"),
            F.when(c["企业面积"] != "", row("factory_profile_claims.company_area", "NEUTRAL", 0.0, 0.6, "PLATFORM_PROFILE")),
            F.when(c["员工总数"] != "", row("factory_profile_claims.staffing", "NEUTRAL", 0.0, 0.6, "PLATFORM_PROFILE")),
            F.when(c["加工方式"].rlike(PROCESSING_WORDS), row("processing_methods_display_text", "FACTORY", 0.6, 0.55, "SELF_CLAIM")),
        )
    )
    return profiles.where((F.size("claims") > 0) & F.col("profile_url").isNotNull()).select("supplier", F.explode(items).alias("e")).select("supplier", "e.*")


def model_runs(runs: DataFrame) -> DataFrame:
    """Calls of models as provenance rows: costs are reported only if every call of a run states one, tokens are summed. runs: supplier, run_kind, prompt_tokens, completion_tokens, cost_usd, latency_ms, created_at, a row a call."""
    whole = F.count("cost_usd") == F.count("*")
    return runs.groupBy("supplier", "run_kind").agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        F.when(whole, F.sum("cost_usd")).alias("cost_usd"), F.when(whole, "REPORTED").otherwise("UNAVAILABLE").alias("cost_status"), F.max("latency_ms").alias("latency_ms"), F.min("created_at").alias("created_at"),
    )
