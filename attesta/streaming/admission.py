"""Admission, collections and sinks over streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECISION = "scope string, subject string, request_id bigint, window_number bigint, accepted boolean"
OUTCOME = "analysis_id string, digest string, outcome string"


def admitted(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """A decision per request (scope, subject, request_id, ts): accepted while its window has room. State is one counter per key and window, and
    goes once the watermark has passed the window's end."""

    def decide(key, frames: Iterator, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        frame = pd.concat(list(frames)).sort_values(["ts", "request_id"])
        accepted = [used + i < limit for i in range(len(frame))]
        used += sum(accepted)
        yield pd.DataFrame({"scope": key[0], "subject": key[1], "request_id": frame["request_id"].to_numpy(), "window_number": key[2], "accepted": accepted})
        state.update((used,))
        end = (key[2] + 1) * seconds * 1000
        if end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(int(end))
        else:
            state.remove()

    keyed = requests.withColumn("window_number", F.floor(F.unix_seconds("ts") / seconds).cast("bigint"))
    return keyed.groupBy("scope", "subject", "window_number").applyInPandasWithState(decide, DECISION, "used int", "append", GroupStateTimeout.EventTimeTimeout)


def usage(requests: DataFrame, seconds: int, lateness: str = "1 hour") -> DataFrame:
    """Requests by scope, subject and tumbling window; rows later than the watermark are dropped and windows appended once closed."""
    return requests.withWatermark("ts", lateness).groupBy(F.window("ts", f"{seconds} seconds"), "scope", "subject").agg(F.count("*").alias("requests")).select("scope", "subject", F.col("window.start").alias("window_start"), "requests")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions of a subject, closed after a gap."""
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "subject").agg(F.count("*").alias("events")).select("subject", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "events")


def collections(steps: DataFrame, seconds: int = 60) -> DataFrame:
    """Two-phase collection: rows (analysis_id, step begin|finish, digest, ts). A finish within `seconds` of its begin is FINISHED; if event time passes the
    deadline first, the outcome is TIMEOUT with the begun digest, and a later finish is LATE; a repeated finish is a REPLAY if its digest is the same, else a CONFLICT."""

    def step(key, frames: Iterator, state: GroupState):
        import pandas as pd

        out = []
        phase, digest, deadline = state.get if state.exists else ("NEW", "", 0)
        if state.hasTimedOut:
            if phase == "OPEN":
                out.append((key[0], digest, "TIMEOUT"))
                phase = "EXPIRED"
        else:
            rows = pd.concat(list(frames)).sort_values(["ts", "step"])
            for row in rows.itertuples():
                at = int(row.ts.value // 1_000_000)
                if row.step == "begin" and phase == "NEW":
                    phase, digest, deadline = "OPEN", row.digest, at + seconds * 1000
                elif row.step == "finish" and phase == "OPEN" and at <= deadline:
                    phase, digest = "DONE", row.digest
                    out.append((key[0], digest, "FINISHED"))
                elif row.step == "finish" and phase == "DONE":
                    out.append((key[0], row.digest, "REPLAY" if row.digest == digest else "CONFLICT"))
                elif row.step == "finish":
                    if phase == "OPEN":
                        out.append((key[0], digest, "TIMEOUT"))
                        phase = "EXPIRED"
                    out.append((key[0], row.digest, "LATE"))
        state.update((phase, digest, deadline))
        if phase == "OPEN":
            state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["analysis_id", "digest", "outcome"])

    return steps.groupBy("analysis_id").applyInPandasWithState(step, OUTCOME, "phase string, digest string, deadline bigint", "append", GroupStateTimeout.EventTimeTimeout)


def deduplicated(rows: DataFrame, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """Exact replays within the watermark vanish."""
    return rows.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def idempotent_sink(path: str):
    """A foreachBatch function that writes every batch to its own folder, so that a batch run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def split_dead_letters(path: str, dead_path: str, error: str = "error"):
    """A foreachBatch function for rows with an error column: the sound and the dead go to folders of their own, a batch at a time."""

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        held.where(F.col(error).isNull()).drop(error).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        held.where(F.col(error).isNotNull()).withColumn(error, F.substring(error, 1, 64)).write.mode("overwrite").parquet(f"{dead_path}/batch={batch_id}")
        held.unpersist()

    return write
