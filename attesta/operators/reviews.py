"""Review signals of all suppliers in one job: topics, duplicates, bursts, rating against text, volume, reliability.

Reviews have the columns supplier (key), evidence_id, text, and where an operator says so rating, ts, ordinal. Suppliers are grouping keys throughout,
so a job over all of them shuffles once per signal, with partial aggregation; only `timing_bursts` sorts within a supplier.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import scalars, text as tx
from attesta.sources.scratch import cut

#: Complaint phrases by category.
LEXICON = {
    "QUALITY": ["poor quality", "bad quality", "defective", "broken", "poor stitching", "bad fabric", "thin fabric", "chất lượng kém", "bị lỗi", "bị rách", "质量差", "有瑕疵", "破损", "做工差"],
    "DELIVERY": ["arrived late", "late delivery", "shipping delay", "slow shipping", "giao chậm", "giao trễ", "phát hàng chậm", "发货慢", "物流慢", "延迟"],
    "AFTER_SALES": ["refund refused", "no refund", "return refused", "seller ignored", "no response", "không hoàn tiền", "không phản hồi", "đổi trả khó", "拒绝退款", "不退款", "客服不回复", "售后差"],
    "PRODUCT_MISMATCH": ["not as described", "different from description", "wrong item", "wrong color", "wrong size", "không giống mô tả", "sai sản phẩm", "sai màu", "sai kích thước", "货不对板", "与描述不符", "颜色不符", "尺码不符"],
    "PACKAGING": ["package damaged", "damaged packaging", "poor packaging", "bao bì hỏng", "đóng gói kém", "包装破损", "包装差"],
}
WEIGHTS = {"EXACT_DUPLICATE": 0.35, "TIMING_BURST": 0.25, "RATING_TEXT_MISMATCH": 0.25, "VOLUME_INCONSISTENCY": 0.15}
#: Texts that are folded at a time.
BATCH = 256
MIN_DUPLICATE_LENGTH = 8
HIGH_RATING = 4.0
SAMPLE = 8
PENALTY_CAP = 0.75


def coerced(reviews: DataFrame) -> DataFrame:
    """From rows (supplier, ordinal, evidence_id, text): blank texts go, ids default to `review:<ordinal>`; a repeated id in a supplier is an error."""
    kept = reviews.where(F.trim("text") != "").withColumn("evidence_id", F.coalesce(F.nullif(F.trim("evidence_id"), F.lit("")), F.concat(F.lit("review:"), F.col("ordinal").cast("string"))))
    repeated = F.count("*").over(Window.partitionBy("supplier", "evidence_id")) > 1
    return kept.withColumn("evidence_id", F.when(repeated, F.raise_error(F.lit("evidence ids must be unique"))).otherwise(F.col("evidence_id")))


def folded(reviews: DataFrame, out: str = "folded") -> DataFrame:
    """Adds the folded text (NFKC, case folding), once a review: what every signal on texts compares."""
    return reviews.withColumn(out, tx.folded_nfkc(F.col("text")))


def categories(text: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """The categories of which a folded text contains a phrase, as an array in the lexicon's order: one alternation a category, no join."""
    found = [F.when(F.coalesce(text.rlike("|".join(re.escape(tx.fold(p)) for p in phrases)), F.lit(False)), F.lit(name)) for name, phrases in (lexicon or LEXICON).items()]
    return F.array_compact(F.array(*found))


def topics(reviews: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Complaint topics with two reviews or more: supplier, category, review_count."""
    each = folded(reviews.select("supplier", "text")).select("supplier", F.explode(categories(F.col("folded"), lexicon)).alias("category"))
    return each.groupBy("supplier", "category").agg(F.count("*").alias("review_count")).where("review_count >= 2")


def exact_duplicates(reviews: DataFrame) -> DataFrame:
    """Suppliers with texts that are equal once folded (8 characters or more): supplier, duplicate_groups, duplicate_reviews, review_count, strength."""
    keyed = folded(reviews.select("supplier", "text")).select("supplier", F.sha2("folded", 256).alias("key"), F.length("folded").alias("length"))
    groups = keyed.groupBy("supplier", "key", "length").agg(F.count("*").alias("n"))
    repeated = (F.col("length") >= MIN_DUPLICATE_LENGTH) & (F.col("n") >= 2)
    per = groups.groupBy("supplier").agg(F.sum(repeated.cast("bigint")).alias("duplicate_groups"), F.sum(F.when(repeated, F.col("n")).otherwise(0)).alias("duplicate_reviews"), F.sum("n").alias("review_count"))
    return per.where("duplicate_groups > 0").withColumn("strength", F.round(F.least(F.lit(1.0), F.col("duplicate_reviews") / F.col("review_count")), 4))


def duplicate_members(reviews: DataFrame) -> DataFrame:
    """The reviews of duplicate groups, a row each: supplier, evidence_id, copies, first_id (the group's smallest id). The largest groups with the smallest ids come first in a report.

    Groups are joined by the digest of their folded text, none is collected. Texts are folded once, few at a time; digests are what is written.
    """
    digests = cut(folded(reviews.select("supplier", "evidence_id", "text")).select("supplier", "evidence_id", F.length("folded").alias("size"), F.sha2("folded", 256).alias("key")), BATCH)  # a filter here would fold twice
    keyed = digests.where(F.col("size") >= MIN_DUPLICATE_LENGTH).drop("size")
    groups = keyed.groupBy("supplier", "key").agg(F.count("*").alias("copies"), F.min("evidence_id").alias("first_id")).where("copies >= 2")
    return keyed.join(groups, ["supplier", "key"]).select("supplier", "evidence_id", "copies", "first_id")


def burst_members(reviews: DataFrame, bursts: DataFrame, hours: int = 24) -> DataFrame:
    """The reviews (supplier, evidence_id, ts) within the burst of their supplier: supplier, evidence_id."""
    at = F.col("ts").cast("timestamp")
    inside = (at >= F.col("burst_start")) & (at <= F.col("burst_start") + F.make_interval(hours=F.lit(hours)))
    return reviews.join(bursts.select("supplier", "burst_start"), "supplier").where(inside).select("supplier", "evidence_id")


def mismatch_members(reviews: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """High ratings on complaints, of suppliers with two at least: supplier, evidence_id."""
    bad = folded(reviews).where((scalars.rating(F.col("rating")) >= HIGH_RATING) & (F.size(categories(F.col("folded"), lexicon)) > 0)).select("supplier", "evidence_id")
    several = bad.groupBy("supplier").agg(F.count("*").alias("n")).where("n >= 2")
    return bad.join(several, "supplier", "left_semi")


def signal_evidence(reviews: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Which reviews each suspicious pattern rests on, a row each: supplier, kind, evidence_id. reviews: supplier, evidence_id, text, rating, ts."""
    bursts = timing_bursts(reviews.select("supplier", "ts"), ["supplier"])
    kinds = {"EXACT_DUPLICATE_TEXT": duplicate_members(reviews), "TIMING_BURST": burst_members(reviews, bursts), "RATING_TEXT_MISMATCH": mismatch_members(reviews, lexicon)}
    parts = [rows.select("supplier", F.lit(kind).alias("kind"), "evidence_id") for kind, rows in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def timing_bursts(events: DataFrame, keys: list[str], hours: int = 24, least: int = 3, min_ratio: float = 0.6) -> DataFrame:
    """The fullest inclusive window of `hours` for each key: keys, burst_start, burst_count, timed, strength.

    Windows start at a row each; of windows as full the earliest counts. The range frame sorts once within a key.
    """
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    by = Window.partitionBy(*keys).orderBy("us").rangeBetween(Window.currentRow, hours * 3_600_000_000)
    counted = events.where("ts is not null").withColumn("us", seconds).withColumn("n", F.count("*").over(by))
    best = counted.groupBy(*keys).agg(F.count("*").alias("timed"), F.max(F.struct(F.col("n"), (-F.col("us")).alias("neg"))).alias("top"))
    out = best.select(*keys, F.timestamp_micros(-F.col("top.neg")).alias("burst_start"), F.col("top.n").alias("burst_count"), "timed", F.round(F.col("top.n") / F.col("timed"), 4).alias("strength"))
    return out.where((F.col("burst_count") >= least) & (F.col("burst_count") / F.col("timed") >= min_ratio))


def rating_mismatch(reviews: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """High ratings on complaints, two at least: supplier, mismatches, rated_complaints, strength, reliability."""
    rated = folded(reviews).withColumns({"bad": F.size(categories(F.col("folded"), lexicon)) > 0, "r": scalars.rating(F.col("rating"))})
    per = rated.groupBy("supplier").agg(
        F.count_if(F.col("bad") & (F.col("r") >= HIGH_RATING)).alias("mismatches"), F.count_if(F.col("bad") & F.col("r").isNotNull()).alias("rated_complaints"),
        F.round(F.count("r") / F.count("*"), 4).alias("reliability"),
    )
    return per.where("mismatches >= 2").withColumn("strength", F.round(F.col("mismatches") / F.col("rated_complaints"), 4))


def volume_inconsistency(captured: DataFrame, declared: DataFrame) -> DataFrame:
    """Suppliers that declare fewer reviews than were captured. captured: supplier, review_count; declared: supplier, aggregate_count."""
    both = captured.join(declared, "supplier").where("aggregate_count >= 0 and aggregate_count < review_count")
    return both.withColumn("strength", F.round((F.col("review_count") - F.col("aggregate_count")) / F.col("review_count"), 4))


def reliability(counts: DataFrame, patterns: DataFrame) -> DataFrame:
    """min(1, n / 8) * (1 - min(0.75, sum of weight * strength * reliability)). counts: supplier, review_count; patterns: supplier, kind, strength, reliability."""
    weight = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))[F.col("kind")]
    penalty = patterns.groupBy("supplier").agg(F.sum(weight * F.col("strength") * F.col("reliability")).alias("raw"))
    joined = counts.join(penalty, "supplier", "left")
    value = F.least(F.lit(1.0), F.col("review_count") / SAMPLE) * (1 - F.least(F.lit(PENALTY_CAP), F.coalesce("raw", F.lit(0.0))))
    return joined.select("supplier", "review_count", F.round(value, 4).alias("reliability"))


def missing_inputs(reviews: DataFrame, declared: DataFrame) -> DataFrame:
    """Which inputs of the signals are incomplete: supplier, missing (joined by commas, in a fixed order)."""
    per = reviews.groupBy("supplier").agg(F.count("*").alias("n"), F.count("ts").alias("timed"), F.count("rating").alias("rated")).join(declared, "supplier", "left")
    parts = F.array_compact(F.array(F.when(F.col("timed") < F.col("n"), "timestamps"), F.when(F.col("rated") < F.col("n"), "ratings"), F.when(F.col("aggregate_count").isNull(), "aggregate_count")))
    return per.select("supplier", F.array_join(parts, ",").alias("missing"))
