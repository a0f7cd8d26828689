"""Weighted evidence: risk of dimensions, manipulation, confidence, coverage, floor and label, for all suppliers at once.

Signals have the columns supplier, evidence_id, dimension, severity (0 to 100), reliability, importance, review_derived and, for the
floor, critical_candidate, independently_verified, corroborating. A dimension without signals is a row with a null risk, never 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the dimensions by scoring version, and of the confidence factors.
WEIGHTS = {
    "v0.1.0": {"PRODUCT_QUALITY": 0.25, "SUPPLIER_IDENTITY": 0.15, "DELIVERY": 0.15, "REVIEW_MANIPULATION": 0.15, "AFTER_SALES": 0.15, "PRICING": 0.10, "COMMUNICATION": 0.05},
    "v0.2.1": {"PRODUCT_QUALITY": 0.3125, "SUPPLIER_IDENTITY": 0.1875, "REVIEW_MANIPULATION": 0.1875, "AFTER_SALES": 0.1875, "PRICING": 0.125},
}
CONFIDENCE = {"data_coverage": 0.40, "source_reliability": 0.25, "sample_adequacy": 0.20, "data_freshness": 0.15}
REVIEW_BASED = ("PRODUCT_QUALITY", "DELIVERY", "AFTER_SALES")
MIN_COVERAGE, MIN_CONFIDENCE, MAX_REDUCTION, FLOOR = 0.45, 0.40, 0.50, 65.0
CRITICAL_SEVERITY, CRITICAL_RELIABILITY, CRITICAL_SOURCES = 90.0, 0.90, 2


def mass() -> Column:
    return F.col("importance") * F.col("reliability")


def dimension_risk(signals: DataFrame) -> DataFrame:
    """supplier, dimension, signals, risk (mean severity by importance * reliability, null without mass), review_share."""
    total = F.sum(mass())
    return signals.groupBy("supplier", "dimension").agg(
        F.count("*").alias("signals"),
        F.when(total > 0, F.sum(mass() * F.col("severity")) / total).alias("risk"),
        F.coalesce(F.when(total > 0, F.least(F.lit(1.0), F.sum(F.when(F.col("review_derived"), mass()).otherwise(0.0)) / total)), F.lit(0.0)).alias("review_share"),
    )


def weights_table(spark, version: str) -> DataFrame:
    return spark.createDataFrame(list(WEIGHTS[version].items()), "dimension string, weight double")


def scaffolded(suppliers: DataFrame, risks: DataFrame, version: str) -> DataFrame:
    """Every supplier with every dimension of the version; risks of other dimensions are left out, missing ones are null. The dimensions are exploded from a literal, no join."""
    weights = WEIGHTS[version]
    dims = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(w).alias("weight")) for d, w in weights.items()))).alias("d")
    return suppliers.select("supplier", dims).select("supplier", "d.dimension", "d.weight").join(risks, ["supplier", "dimension"], "left")


def effective_confidence(scored: DataFrame) -> DataFrame:
    """Adds effective_confidence: review-based dimensions lose up to half of theirs by the share of reviews and the manipulation risk. scored: scaffolded rows with confidence."""
    manipulation = scored.where("dimension = 'REVIEW_MANIPULATION'").select("supplier", F.col("risk").alias("manipulation"))
    joined = scored.join(manipulation, "supplier", "left")
    reduction = F.when(F.col("dimension").isin(*REVIEW_BASED), F.coalesce("review_share", F.lit(0.0)) * F.coalesce("manipulation", F.lit(0.0)) / 100 * MAX_REDUCTION).otherwise(0.0)
    return joined.withColumn("effective_confidence", F.col("confidence") * (1 - reduction))


def overall_risk(scored: DataFrame) -> DataFrame:
    """supplier, overall (null if no dimension has risk and confidence), dimensions, missing."""
    useful = F.col("risk").isNotNull() & (F.col("effective_confidence") > 0)
    w = F.when(useful, F.col("weight") * F.col("effective_confidence"))
    return scored.groupBy("supplier").agg((F.sum(w * F.col("risk")) / F.sum(w)).alias("overall"), F.count_if(useful).alias("dimensions"), F.count_if(F.col("risk").isNull()).alias("missing"))


def overall_confidence(factors: DataFrame) -> DataFrame:
    return factors.select("supplier", "data_coverage", sum((F.col(c) * w for c, w in CONFIDENCE.items()), F.lit(0.0)).alias("confidence"))


def critical(signals: DataFrame) -> DataFrame:
    """Suppliers with a signal that forces the floor: supplier, critical_signals."""
    eligible = (
        F.col("critical_candidate") & F.col("independently_verified") & ~F.col("review_derived") & (F.col("severity") >= CRITICAL_SEVERITY)
        & (F.col("reliability") >= CRITICAL_RELIABILITY) & (F.col("corroborating") >= CRITICAL_SOURCES) & F.col("evidence_id").isNotNull()
    )
    return signals.where(eligible).groupBy("supplier").agg(F.count("*").alias("critical_signals"))


def label(overall: Column, coverage: Column, confidence: Column) -> Column:
    risk = F.round(overall, 4)
    return F.when(overall.isNull() | (F.round(coverage, 4) < MIN_COVERAGE) | (F.round(confidence, 4) < MIN_CONFIDENCE), "INSUFFICIENT_INFORMATION").when(risk <= 34, "LOW").when(risk <= 64, "MODERATE").otherwise("HIGH")


def assess(signals: DataFrame, confidences: DataFrame, factors: DataFrame, version: str = "v0.2.1") -> DataFrame:
    """The whole assessment: supplier, overall_risk, confidence, risk_label, missing_dimensions, critical.

    confidences: supplier, dimension, confidence; factors: supplier and the confidence factors. Suppliers are those of factors.
    """
    scored = scaffolded(factors.select("supplier"), dimension_risk(signals), version).join(confidences, ["supplier", "dimension"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    out = overall_risk(effective_confidence(scored)).join(overall_confidence(factors), "supplier").join(critical(signals), "supplier", "left")
    floored = F.when(F.col("critical_signals").isNotNull(), F.greatest(F.col("overall"), F.lit(FLOOR))).otherwise(F.col("overall"))
    floored = F.when(F.col("overall").isNotNull(), floored)
    risk_label = label(floored, F.col("data_coverage"), F.col("confidence"))
    return out.select(
        "supplier", F.round(F.when(risk_label != "INSUFFICIENT_INFORMATION", floored), 4).alias("overall_risk"), F.round("confidence", 4).alias("confidence"),
        risk_label.alias("risk_label"), F.col("missing").alias("missing_dimensions"), F.col("critical_signals").isNotNull().alias("critical"),
    )


def merged_confidence(groups: DataFrame) -> DataFrame:
    """Inputs of one dimension from several groups as one: supplier, dimension, signals, confidence (mean by reliability, 0 without any)."""
    return groups.groupBy("supplier", "dimension").agg(F.count("*").alias("signals"), F.coalesce(F.sum(F.col("confidence") * F.col("reliability")) / F.nullif(F.sum("reliability"), F.lit(0.0)), F.lit(0.0)).alias("confidence"))


def dimension_coverage(signals: DataFrame, completeness: DataFrame, version: str = "v0.2.1") -> DataFrame:
    """min(completeness, weight of the dimensions that have signals): supplier, coverage."""
    weight = F.create_map(*(F.lit(x) for pair in WEIGHTS[version].items() for x in pair))
    held = signals.select("supplier", "dimension").distinct().groupBy("supplier").agg(F.sum(F.coalesce(weight[F.col("dimension")], F.lit(0.0))).alias("held"))
    return completeness.join(held, "supplier", "left").select("supplier", F.least("completeness", F.coalesce("held", F.lit(0.0))).alias("coverage"))
