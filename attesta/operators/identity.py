"""Factory or trader: likelihoods, confidence and class from weighted evidence. Evidence: supplier, direction, strength, reliability, source_kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTRADICTION, UNCERTAIN, CLEAR = 0.35, 0.4, 0.7
LOW_RELIABILITY = 0.5

#: Strengths of numeric profile fields, all with reliability 0.7.
FIELD_STRENGTH = {"factory_area_sqm": 0.75, "production_line_count": 0.9, "qc_staff_count": 0.55, "rd_team_count": 0.45, "employee_count": 0.3, "equipment_count": 0.6}


def numeric_evidence(profiles: DataFrame) -> DataFrame:
    """Unpivots the numeric profile fields that are above 0 into evidence for a factory."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("source_field"), F.col(f).cast("double").alias("value"), F.lit(s).alias("strength")) for f, s in FIELD_STRENGTH.items()))).alias("e")
    return profiles.select("supplier", each).where("e.value > 0").select("supplier", "e.source_field", "e.value", F.lit("FACTORY").alias("direction"), "e.strength", F.lit(0.7).alias("reliability"), F.lit("PLATFORM_PROFILE").alias("source_kind"))


def masses(evidence: DataFrame) -> DataFrame:
    """Per supplier: n, factory and trader mass, strongest of each, best independent reliability, whether all is self-claimed."""
    m = F.col("strength") * F.col("reliability")
    of = lambda d: F.col("direction") == d
    directed = F.col("direction") != "NEUTRAL"
    return evidence.groupBy("supplier").agg(
        F.count_if(directed).alias("n"), F.sum(F.when(of("FACTORY"), m).otherwise(0.0)).alias("factory"), F.sum(F.when(of("TRADER"), m).otherwise(0.0)).alias("trader"),
        F.coalesce(F.max(F.when(of("FACTORY"), m)), F.lit(0.0)).alias("top_factory"), F.coalesce(F.max(F.when(of("TRADER"), m)), F.lit(0.0)).alias("top_trader"),
        F.coalesce(F.max(F.when(directed & (F.col("source_kind") != "SELF_CLAIM"), F.col("reliability"))), F.lit(0.0)).alias("independent"),
        F.coalesce(F.bool_and(F.when(directed, F.col("source_kind") == "SELF_CLAIM")), F.lit(False)).alias("claims_only"),
    )


def classified(totals: DataFrame) -> DataFrame:
    """supplier, factory_likelihood, trader_likelihood, confidence, contradictory, classification."""
    total = F.col("factory") + F.col("trader")
    like = F.when(total > 0, F.col("factory") / total).otherwise(0.5)
    contradictory = (F.col("top_factory") >= CONTRADICTION) & (F.col("top_trader") >= CONTRADICTION)
    dominance = F.abs(2 * like - 1)
    raw = F.least(F.lit(1.0), F.col("n") / 4) * (0.45 + 0.55 * dominance) * (0.5 + 0.5 * F.col("independent"))
    raw = F.when(F.col("claims_only"), F.least(raw, F.lit(0.25))).otherwise(raw)
    confidence = F.when(F.col("n") == 0, 0.0).otherwise(F.when(contradictory, raw * 0.45).otherwise(raw))
    out = totals.select("supplier", "n", F.round(like, 4).alias("factory_likelihood"), F.round(1 - like, 4).alias("trader_likelihood"), F.round(confidence, 4).alias("confidence"), contradictory.alias("contradictory"))
    return out.withColumn("classification", kind(F.col("confidence"), F.col("factory_likelihood")))


def uncertainty(totals: DataFrame) -> DataFrame:
    """Why an identity is uncertain, from the masses: supplier, reasons (array, in a fixed order; empty for none)."""
    n, own = F.col("n"), F.col("claims_only")
    contradictory = (F.col("top_factory") >= CONTRADICTION) & (F.col("top_trader") >= CONTRADICTION)
    reasons = [
        F.when(n == 0, "NO_DIRECTIONAL_EVIDENCE"), F.when(own, "SELF_CLAIM_ONLY"), F.when(contradictory, "CONTRADICTORY_EVIDENCE"), F.when((n > 0) & (n < 2), "LIMITED_EVIDENCE"),
        F.when((F.col("independent") < LOW_RELIABILITY) & (n > 0) & ~own, "LOW_INDEPENDENT_RELIABILITY"),
    ]
    return totals.select("supplier", F.array_compact(F.array(*reasons)).alias("reasons"))


def kind(confidence: Column, factory: Column) -> Column:
    return F.when(confidence < UNCERTAIN, "UNCERTAIN").when(factory >= CLEAR, "FACTORY").when(factory <= 1 - CLEAR, "TRADER").otherwise("MIXED")
