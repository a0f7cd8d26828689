"""Report documents: findings in their parts with the evidence they cite, ordered events, limits and actions, the redacted preview.

Limits and actions are codes; their wording belongs to whoever shows them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.scalars import COVERAGE_FIELDS

RISK_TYPES = ["SUPPLIER_RISK", "REVIEW_FINDING", "REVIEW_PATTERN"]


def ordered_list(rows: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """Per key the rows as one array of structs in order."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("items"))


def finding_part(kind: Column, severity: Column, consistency: Column | None = None) -> Column:
    """key_risks, positive or other: an identity counts as a risk with a severity, media if they contradict their review."""
    contradicts = F.lit(False) if consistency is None else F.coalesce(consistency == "CONTRADICTS", F.lit(False))
    risk = kind.isin(RISK_TYPES) | ((kind == "IDENTITY_ASSESSMENT") & severity.isNotNull()) | ((kind == "MEDIA_CONSISTENCY") & contradicts)
    return F.when(risk, "key_risks").when(kind == "SUPPLIER_POSITIVE", "positive").otherwise("other")


def parts(findings: DataFrame, key: str) -> DataFrame:
    """Numbers of findings by part: key, key_risks, positive, other, max_severity. findings: key, finding_type, severity, consistency."""
    part = finding_part(F.col("finding_type"), F.col("severity"), F.col("consistency"))
    return findings.groupBy(key).agg(*(F.count_if(part == p).alias(p) for p in ("key_risks", "positive", "other")), F.max("severity").alias("max_severity"))


def evidence_ids(kind: Column, review_ids: Column, media_id: Column, review_id: Column, supporting: Column, fields: Column) -> Column:
    """The evidence that a finding cites, by its type, each id once and in order; blank ids are left out."""
    none = F.array().cast("array<string>")
    of = (
        F.when(kind.startswith("REVIEW_"), F.coalesce(review_ids, none)).when(kind == "MEDIA_CONSISTENCY", F.array_compact(F.array(F.concat(F.lit("media:"), F.nullif(media_id, F.lit(""))), review_id)))
        .when(kind == "IDENTITY_ASSESSMENT", F.coalesce(supporting, none)).when(kind.startswith("SUPPLIER_"), F.transform(F.filter(F.coalesce(fields, none), lambda f: f != ""), lambda f: F.concat(F.lit("supplier:"), f))).otherwise(none)
    )
    return F.array_distinct(F.filter(of, lambda x: x != ""))


def resolved(evidence: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """Evidence (key, evidence_id, source_kind, source_field, payload) with the value of canonical source fields taken from the stored document (key, fields), and from nowhere else."""
    rows = evidence.join(snapshots.select(key, F.col("fields").alias("_fields")), key, "left")
    canonical = (F.col("source_kind") == "SUPPLIER_DATA") & F.col("source_field").isin(*COVERAGE_FIELDS)
    value = F.map_concat(F.map_filter("payload", lambda k, _: k != "value"), F.create_map(F.lit("value"), F.col("_fields")[F.col("source_field")]))
    return rows.withColumn("payload", F.when(F.coalesce(canonical, F.lit(False)), value).otherwise(F.col("payload"))).drop("_fields")


def overlaid(evidence: DataFrame, reviews: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Stored reviews (key, ordinal, payload) over the evidence of their ids; where both state a part of the payload, the review's holds. Reviews without evidence are added.

    Both sides are shuffled into `partitions`, or as many as the session says.
    """
    named = reviews.select(key, F.concat(F.lit("review:"), F.col("ordinal").cast("string")).alias("evidence_id"), F.col("payload").alias("_new"))
    if partitions:
        evidence, named = (x.repartition(partitions, key, "evidence_id") for x in (evidence, named))
    both = evidence.join(named, [key, "evidence_id"], "full")
    kept = F.map_filter(F.coalesce("payload", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys("_new"), k))
    new = F.col("_new").isNotNull()
    return both.select(
        key, "evidence_id", F.when(new, "REVIEW").otherwise(F.col("source_kind")).alias("source_kind"), F.when(new, "reviews").otherwise(F.col("source_field")).alias("source_field"),
        F.when(new, F.map_concat(kept, "_new")).otherwise(F.col("payload")).alias("payload"),
    )


def built(findings: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """One report a key: key_risks, positive_signals and other_findings (arrays of struct, in order), evidence_ids (sorted), missing_evidence (cited by a risk or a positive signal and not there; a sound report has none).

    findings: key, number, finding_key, finding_type, severity, confidence, consistency, evidence_ids. A report's findings and evidence are bounded by its document.
    """
    part = finding_part(F.col("finding_type"), F.col("severity"), F.col("consistency"))
    rows = findings.withColumn("_part", part)
    item = F.struct("number", "finding_key", "finding_type", "severity", "confidence", "evidence_ids")
    listed = rows.groupBy(key).agg(*(F.array_sort(F.collect_list(F.when(F.col("_part") == p, item))).alias(name) for p, name in (("key_risks", "key_risks"), ("positive", "positive_signals"), ("other", "other_findings"))))
    there = evidence.groupBy(key).agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    gaps = missing_evidence(rows.where("_part <> 'other'"), evidence, key).groupBy(key).agg(F.array_sort(F.collect_set("evidence_id")).alias("missing_evidence"))
    none = F.array().cast("array<string>")
    return listed.join(there, key, "left").join(gaps, key, "left").withColumns({c: F.coalesce(c, none) for c in ("evidence_ids", "missing_evidence")})


def review_summary(mode: Column, assessment: Column, semantic: list[str], deterministic: list[str]) -> Column:
    """The part of a review assessment (struct) that a report shows for its mode, as JSON that names the mode."""
    shown = lambda name, fields: F.to_json(F.struct(F.lit(name).alias("mode"), *(assessment[f].alias(f) for f in fields)), {"ignoreNullFields": "false"})
    return F.when(mode == "semantic", shown("semantic", semantic)).otherwise(shown("deterministic", deterministic))


def limitations(label: Column, missing_fields: Column, method: Column, pages_missing: Column, has_context: Column, html_incomplete: Column, identity_uncertain: Column, mode: Column) -> Column:
    """The limits that a reader has to know, in a fixed order; two hold for every report."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.array_compact(
        F.array(
            F.when(yes(label == "INSUFFICIENT_INFORMATION"), "INSUFFICIENT_INFORMATION"), F.lit("AS_OF_COLLECTION"), F.lit("NO_VERIFICATION"), F.when(yes(F.size(missing_fields) > 0), "FIELDS_UNKNOWN"),
            F.when(yes(method == "USER_UPLOAD"), "AGE_OF_SAVED_PAGE_UNKNOWN"), F.when(yes(pages_missing), "PAGES_NOT_COLLECTED"), F.when(yes(has_context), "CONTEXT_IS_AN_EXCERPT"), F.when(yes(html_incomplete), "HTML_INCOMPLETE"),
            F.when(yes(identity_uncertain), "IDENTITY_UNCERTAIN"), F.when(yes(mode == "semantic"), F.lit(None).cast("string")).otherwise("NO_SEMANTIC_REVIEWS"),
        )
    )


def actions(label: Column, missing_dimensions: Column, identity_uncertain: Column, recommended: Column) -> Column:
    """Recommended steps, each once, in order: three always, those that follow from gaps, and what the interpretation asks to verify."""
    lacks = lambda d: F.coalesce(F.array_contains(missing_dimensions, d), F.lit(False))
    none = F.array().cast("array<string>")
    own = F.array(
        F.lit("VERIFY_LEGAL_ENTITY"), F.lit("REQUEST_SAMPLE"), F.lit("WRITTEN_TERMS"), F.when(F.coalesce(label == "INSUFFICIENT_INFORMATION", F.lit(False)) | F.coalesce(F.size(missing_dimensions) > 0, F.lit(False)), "COMPLETE_EVIDENCE"),
        F.when(lacks("DELIVERY"), "DELIVERY_PROOF"), F.when(lacks("AFTER_SALES"), "AFTER_SALES_CONTACT"), F.when(F.coalesce(identity_uncertain, F.lit(False)), "CAPACITY_PROOF"),
    )
    asked = F.filter(F.transform(F.coalesce(recommended, none), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.array_compact(F.concat(own, asked)))


def preview(reports: DataFrame) -> DataFrame:
    """What a guest may see: no evidence, no findings, no numbers but the label and the completeness."""
    return reports.select("analysis_id", "risk_label", "completeness")


def missing_evidence(findings: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Citations of findings (key, evidence_ids) without a row of evidence; a sound report has none."""
    cited = findings.select(key, F.explode("evidence_ids").alias("evidence_id")).distinct()
    return cited.join(evidence.select(key, "evidence_id").distinct(), [key, "evidence_id"], "left_anti")


def captured_for(evidence: DataFrame, key: str) -> DataFrame:
    """Which dimensions the captured source fields bear on: key, dimension, evidence_ids (sorted). evidence: key, evidence_id, source_kind, source_field, value.

    Values that are missing or empty bear on nothing; passages of a page count only if they are about the dimension.
    """
    from attesta.operators.policy import AFTER_SALES_TOPIC, PRICING_TOPIC

    fields = {"PRODUCT_QUALITY": ["reviews", "transaction_signals", "certifications"], "SUPPLIER_IDENTITY": ["company_information", "certifications", "activity_history"], "REVIEW_MANIPULATION": ["reviews", "rating", "transaction_signals"], "AFTER_SALES": ["reviews", "transaction_signals", "company_information", "page_context"], "PRICING": ["price_information", "page_context"]}
    bears = F.explode(F.array_compact(F.array(*(F.when(F.col("source_field").isin(names), d) for d, names in fields.items())))).alias("dimension")
    held = evidence.where("source_kind = 'SUPPLIER_DATA'").where(~F.coalesce(F.col("value").isin("", "[]", "{}", "null"), F.lit(True)))
    topic = F.when(F.col("dimension") == "AFTER_SALES", F.col("value").rlike(AFTER_SALES_TOPIC)).otherwise(F.col("value").rlike(PRICING_TOPIC))
    rows = held.select(key, "evidence_id", "source_field", "value", bears).where((F.col("source_field") != "page_context") | topic)
    return rows.groupBy(key, "dimension").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
