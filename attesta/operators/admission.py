"""Fixed-window admission: requests (request_id, scope, subject, ts) against a limit a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import scalars


def admitted(requests: DataFrame, limit: int, seconds: int, by: list[str]) -> DataFrame:
    """Adds window_number, place (in order of ts and request_id) and accepted: the first `limit` of every key and window; a rejected request uses nothing up."""
    rows = requests.withColumn("window_number", scalars.window_number(F.col("ts"), seconds))
    place = F.row_number().over(Window.partitionBy(*by, "window_number").orderBy("ts", "request_id"))
    return rows.withColumn("place", place).withColumn("accepted", F.col("place") <= limit)


def usage(requests: DataFrame, limit: int, seconds: int, by: list[str]) -> DataFrame:
    """used and remaining a key and window; partial counts are combined before the shuffle."""
    rows = requests.withColumn("window_number", scalars.window_number(F.col("ts"), seconds))
    used = rows.groupBy(*by, "window_number").agg(F.count("*").alias("requests"))
    return used.withColumn("used", F.least(F.col("requests"), F.lit(limit))).withColumn("remaining", F.greatest(F.lit(limit) - F.col("used"), F.lit(0)))


def two_level(requests: DataFrame, own_limit: int, all_limit: int, seconds: int, subject: str) -> DataFrame:
    """Own limit first, then the limit over all, both in one transaction: a request that the second rejects does not use up the first.

    Once the second limit is reached in a window it rejects every later request there, and before that it rejects none. So the places among
    the own requests and then among the survivors, at most own_limit a subject and window, are exact. A rejected request met its own limit
    only if its subject has been admitted that often.
    """
    rows = admitted(requests, own_limit, seconds, [subject]).withColumnRenamed("place", "own_place")
    # the bound on the place is a group limit: every task keeps all_limit rows of a window before they meet
    survivors = rows.where("accepted").withColumn("all_place", F.row_number().over(Window.partitionBy("window_number").orderBy("ts", "request_id"))).where(F.col("all_place") <= all_limit)
    out = rows.drop("accepted").join(survivors.select("request_id", "all_place"), "request_id", "left")
    out = out.withColumn("accepted", F.col("all_place").isNotNull())
    used = F.count_if("accepted").over(Window.partitionBy(subject, "window_number"))
    return out.withColumn("outcome", F.when(F.col("accepted"), "ACCEPTED").when(used < own_limit, "GLOBAL_LIMIT").otherwise("OWN_LIMIT"))
