"""Relational serving: history, watchlists, blind samples, entitlements, and the latest row of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the order given; the rank filter is pushed below the shuffle as a group limit."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")


def history(analyses: DataFrame, snapshots: DataFrame, reports: DataFrame, user: int | None = None, limit: int = 50) -> DataFrame:
    """An account's analyses, newest first, with what is known of them; the limit is that of a page, between 1 and 100."""
    mine = analyses if user is None else analyses.where(F.col("user_id") == user)
    order = F.desc("created_at"), F.desc("analysis_id")
    page = F.broadcast(mine.orderBy(*order).limit(max(1, min(limit, 100))))  # 100 rows at most meet the other tables
    joined = snapshots.join(page, "analysis_id", "right").join(F.broadcast(page.select("analysis_id")).join(reports, "analysis_id"), "analysis_id", "left")
    return joined.withColumn("report_available", F.col("report_id").isNotNull()).orderBy(*order)


def watchlist(entries: DataFrame, analyses: DataFrame) -> DataFrame:
    """Every entry (user_id, supplier) with the latest completed analysis of that pair, if any."""
    done = latest(analyses.where("status = 'COMPLETED'"), ["user_id", "supplier"], F.desc("created_at"), F.desc("analysis_id"))
    return entries.join(done, ["user_id", "supplier"], "left")


def unlabelled(cases: DataFrame, labels: DataFrame, keys: list[str], reviewer: int) -> DataFrame:
    """Cases that this reviewer has not labelled; other reviewers' labels do not matter."""
    return cases.join(labels.where(F.col("reviewer_id") == reviewer).select(*keys).distinct(), keys, "left_anti")


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """start <= at < end, open-ended if the end is null."""
    return (start <= at) & (end.isNull() | (end > at))


def exists_flag(rows: DataFrame, others: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds whether any row of others has the keys."""
    marks = others.select(*keys).distinct().withColumn(name, F.lit(True))
    return rows.join(marks, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def insert_absent(stored: DataFrame, arriving: DataFrame, keys: list[str], payload: str) -> tuple[DataFrame, DataFrame]:
    """Idempotent insert: the rows to add, and the conflicts, whose payload differs from the stored one. Equal replays vanish."""
    added = arriving.join(stored, keys, "left_anti")
    kept = stored.select(*keys, F.col(payload).alias("_stored"))
    conflicts = arriving.join(kept, keys).where(~F.col(payload).eqNullSafe(F.col("_stored"))).drop("_stored")
    return added, conflicts


def upserted(stored: DataFrame, arriving: DataFrame, keys: list[str], columns: list[str], refresh: bool = True) -> DataFrame:
    """Upsert on the keys: with refresh a new value replaces a stored one unless it is null, without it only gaps are filled."""
    o = stored.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in columns))
    n = arriving.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in columns))
    pick = lambda c: F.coalesce(f"_n_{c}", f"_o_{c}") if refresh else F.coalesce(f"_o_{c}", f"_n_{c}")
    return o.join(n, keys, "full").select(*keys, *(pick(c).alias(c) for c in columns))


def owned_report(reports: DataFrame, analyses: DataFrame, owner: str, value: Column | str | int, actor: str, since: Column | None = None) -> DataFrame:
    """Completed reports of an owner (a customer's id or a guest's key) that may be shown; guests' only if they are recent enough."""
    mine = analyses.where((F.col(owner) == value) & (F.col("actor_type") == actor) & (F.col("status") == "COMPLETED"))
    if since is not None:
        mine = mine.where(F.col("created_at") >= since)
    return reports.join(mine.select("analysis_id"), "analysis_id")


def watched_supplier(analyses: DataFrame, snapshots: DataFrame, suppliers: DataFrame) -> DataFrame:
    """The supplier that a customer's analysis is about: analysis_id, user_id, supplier_id."""
    mine = analyses.where("actor_type = 'CUSTOMER'").select("analysis_id", "user_id", "snapshot_id")
    return mine.join(snapshots.select("snapshot_id", "supplier_id"), "snapshot_id").join(suppliers.select("supplier_id"), "supplier_id").select("analysis_id", "user_id", "supplier_id")


def renormalize_source(analyses: DataFrame, snapshots: DataFrame, suppliers: DataFrame, results: DataFrame) -> DataFrame:
    """What a new analysis from kept fields starts with: a customer's analysis with its snapshot, supplier and result; without one of them there is nothing to start with."""
    mine = analyses.where("actor_type = 'CUSTOMER'")
    return mine.join(snapshots, "snapshot_id").join(suppliers, "supplier_id").join(results, "analysis_id")


def assessment_snapshot(analyses: DataFrame, snapshots: DataFrame, token: str | None = None) -> DataFrame:
    """The snapshot of each analysis, if both name each other, with whether the claim is current (status ASSESSING and, if given, the token)."""
    both = analyses.join(snapshots, ["snapshot_id", "analysis_id"])
    current = F.col("status") == "ASSESSING"
    return both.withColumn("current", F.coalesce(current if token is None else current & (F.col("claim_token") == token), F.lit(False)))


def unknown_reviews(media: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Media that refer to a review that is not there, or is blank; sound input has none."""
    told = reviews.where(F.trim("text") != "").select(key, F.col("evidence_id").alias("review_id"))
    return media.join(told, [key, "review_id"], "left_anti")


def kept_reviews(documents: DataFrame, items: str = "reviews", most_bytes: int = 47_000) -> DataFrame:
    """Documents whose reviews are cut from the tail until the document, written as JSON with spaces after separators, has most_bytes at most. Adds captured and retained.

    `items` is an array of strings or structs. Sizes add up along a document's own array, so nothing is shuffled; without a review left the array is null. A document that is too
    large without any review stays so.
    """
    pretty = lambda c: _spaced(F.to_json(c, {"ignoreNullFields": "false"}))
    empty = F.array().cast(documents.schema[items].dataType)
    own = F.coalesce(F.col(items), empty)
    bare = F.octet_length(pretty(F.struct(*(empty.alias(items) if c == items else F.col(c).alias(c) for c in documents.columns))))
    sizes = F.transform(own, lambda x: F.octet_length(pretty(F.struct(x.alias("x")))) - len('{"x": }'))
    sums = F.aggregate(sizes, F.array(bare.cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x + F.when(F.size(a) > 1, 2).otherwise(0))))
    rows = documents.withColumns({"_sums": sums, "captured": F.size(own)})
    rows = rows.withColumn("retained", F.greatest(F.lit(0), F.size(F.filter("_sums", lambda x: x <= most_bytes)) - 1))
    return rows.withColumn(items, F.when(F.col("retained") > 0, F.slice(items, F.lit(1), F.col("retained")))).drop("_sums")


def _spaced(text: Column) -> Column:
    """JSON with a space behind every separator outside strings."""
    return F.regexp_replace(text, r'\G((?:"(?:[^"\\]|\\.)*+"|[^",:])*+[,:])', "$1 ")


def page_of(rows: DataFrame, number: int, *order: Column, size: int = 5) -> DataFrame:
    """One page of a sorted list, from page 0."""
    return rows.orderBy(*order).offset(number * size).limit(size)
