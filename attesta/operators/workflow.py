"""The life of an analysis as columns: claims, retries, replays, the latest status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import scalars

MAX_ATTEMPTS = 5
LEASE_SECONDS = 300


def claim_outcome(status: Column, claimed_until: Column, next_retry_at: Column, attempts: Column, now: Column) -> Column:
    """What a worker gets that asks for a row: unknown, completed, final, busy, waiting or acquired."""
    return (
        F.when(status.isNull(), "unknown").when(status == "COMPLETED", "completed").when((status == "FAILED_FINAL") | (attempts >= MAX_ATTEMPTS), "final")
        .when(claimed_until > now, "busy").when(next_retry_at > now, "waiting").otherwise("acquired")
    )


def phase(has_assessment: Column, has_snapshot: Column) -> Column:
    return F.when(has_assessment, "REPORTING").when(has_snapshot, "ASSESSING").otherwise("PROCESSING")


def failure(attempts: Column, retryable: Column, now: Column) -> Column:
    """The state after a failure: status, delay and next_retry_at."""
    final = ~retryable | (attempts >= MAX_ATTEMPTS)
    delay = F.when(~final, scalars.backoff(attempts))
    return F.struct(F.when(final, "FAILED_FINAL").otherwise("FAILED_RETRYABLE").alias("status"), delay.alias("delay_seconds"), F.timestamp_micros((F.unix_micros(now.cast("timestamp")) + delay * 1_000_000).cast("bigint")).alias("next_retry_at"))


def latest_status(events: DataFrame, key: str) -> DataFrame:
    """The status of the last event (by id) of every key."""
    return events.groupBy(key).agg(F.max_by("status", "event_id").alias("status"), F.max("event_id").alias("event_id"), F.count("*").alias("events"))


def dead_letters(rows: DataFrame, reason: str, description: str) -> DataFrame:
    """Final failures with reason and description at their lengths."""
    return rows.where("status = 'FAILED_FINAL'").withColumns({"reason": F.substring(F.col(reason), 1, 64), "description": F.substring(F.col(description), 1, 256)})


def changed(before: Column, after: Column) -> Column:
    """IS DISTINCT FROM."""
    return ~before.eqNullSafe(after)


def queue_heads(queue: DataFrame, now: Column, limit: int = 1, due: str = "available_at", claimed: str = "claimed_until", key: str = "analysis_id") -> DataFrame:
    """The rows that are due and not claimed, the longest due first: what a worker, or a micro-batch of `limit`, takes next."""
    free = queue.where((F.col(due) <= now) & (F.col(claimed).isNull() | (F.col(claimed) < now)))
    return free.orderBy(due, key).limit(limit)


def claimed(rows: DataFrame, now: Column, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """Taken rows of a queue with their lease and one more attempt."""
    until = F.timestamp_micros(F.unix_micros(now.cast("timestamp")) + lease_seconds * 1_000_000)
    return rows.withColumns({"claimed_until": until, "attempts": F.col("attempts") + 1})


def delivered(analyses: DataFrame, outbox: DataFrame, observed: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """What an observed delivery (analysis_id) changes: outbox rows become published and free, and an analysis that failed only because it could not be published is queued again."""
    seen = observed.select("analysis_id").distinct().withColumn("_seen", F.lit(True))
    box = outbox.join(seen, "analysis_id", "left")
    got = F.coalesce("_seen", F.lit(False))
    box = box.withColumns({"state": F.when(got, "PUBLISHED").otherwise(F.col("state")), "published_at": F.when(got, F.coalesce("published_at", now.cast("timestamp"))).otherwise(F.col("published_at")), "leased_until": F.when(~got, F.col("leased_until"))}).drop("_seen")
    exhausted = (F.col("status") == "FAILED_FINAL") & (F.col("failure_code") == "OUTBOX_PUBLISH_EXHAUSTED") & (F.col("final_disposition") == "PUBLICATION_FAILED")
    again = F.coalesce("_seen", F.lit(False)) & F.coalesce(exhausted, F.lit(False))
    out = analyses.join(seen, "analysis_id", "left").withColumn("_again", again)
    kept = {c: F.when(~F.col("_again"), F.col(c)) for c in ("failure_code", "final_disposition")}
    return out.withColumns({"status": F.when(F.col("_again"), "QUEUED").otherwise(F.col("status")), **kept}).drop("_seen", "_again"), box


def presentation(status: Column, extraction: Column, method: Column) -> Column:
    """How a client shows an analysis: step (0 to 4), complete, final, terminal, should_poll and tone.

    A completed analysis of a live source without evidence is blocked: final, and not complete.
    """
    state = F.coalesce(status, F.lit("QUEUED"))
    live = F.coalesce(method.isin("PUBLIC_HTTP", "PUBLIC_BROWSER"), F.lit(False)) | extraction.isNotNull()
    usable = F.coalesce(extraction.isin("SUCCESS", "PARTIAL"), F.lit(False))
    done = state == "COMPLETED"
    blocked = done & live & ~usable
    complete, final = done & ~blocked, (state == "FAILED_FINAL") | blocked
    step = F.when(complete, 4).when(state == "REPORTING", 3).when(state == "ASSESSING", 2).when(state.isin("PROCESSING", "FAILED_RETRYABLE"), 1).otherwise(0)
    tone = F.when(blocked | F.coalesce(extraction == "PARTIAL", F.lit(False)) | final | (state == "FAILED_RETRYABLE"), "warning").when(complete, "good").otherwise("neutral")
    return F.struct(step.alias("step"), complete.alias("complete"), final.alias("final"), (done | final).alias("terminal"), (~done & ~final).alias("should_poll"), tone.alias("tone"))


def verdict(status: Column, extraction: Column, report_label: Column) -> Column:
    """A report in a line: headline code, whether polling goes on, and the risk label of a valid report; the source counts as unavailable if a completed analysis has no usable extraction."""
    done = status == "COMPLETED"
    blocked = F.coalesce(done & extraction.isNotNull() & ~extraction.isin("SUCCESS", "PARTIAL"), F.lit(False))
    terminal = F.coalesce(status.isin("COMPLETED", "FAILED_FINAL"), F.lit(False))
    return F.struct(F.when(status.isNull(), "LOADING").when(blocked, "SOURCE_UNAVAILABLE").otherwise(status).alias("headline"), terminal.alias("terminal"), (~terminal).alias("poll"), F.when(F.coalesce(done, F.lit(False)), report_label).alias("risk_label"))


def eligible(status: Column, mode: Column, method: Column, same_source: Column, html_bytes: Column, fields: Column, dom_signal: Column, enabled: bool = True, most_bytes: int = 2_000_000) -> Column:
    """Why a page is not rendered in a browser, or null if it is: the first reason that holds."""
    return (
        F.when(F.lit(not enabled), "DISABLED").when(~F.coalesce(status == "PARTIAL", F.lit(False)), "INELIGIBLE_STATUS").when(~F.coalesce(mode.isin("GUEST_PUBLIC", "ACCOUNT_PUBLIC"), F.lit(False)), "INELIGIBLE_MODE")
        .when(~F.coalesce((method == "PUBLIC_HTTP") & same_source, F.lit(False)), "INVALID_EVIDENCE").when(html_bytes > most_bytes, "INPUT_LIMIT").when(fields >= 6, "ENOUGH_FIELDS").when(~F.coalesce(dom_signal, F.lit(False)), "NO_DOM_SIGNAL")
    )


def allowed(rows: DataFrame, role: str, *roles: str) -> DataFrame:
    """The rows whose principal has one of the roles."""
    return rows.where(F.col(role).isin(*roles))
