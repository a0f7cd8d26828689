"""Helpers shared by the operators: lineage cuts in the shared folder and a distributed connected-components job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="attesta-shared-"))
    return _OWN_DIR[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/attesta-{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a query's shuffle files go when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them back: a lineage cut that outlives executors. The shuffles behind it are not kept.

    `codec` is for tables of text that are large on disk; others are written as the session says.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._attesta_path = path
    return back


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder and all below it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame | None) -> None:
    """Deletes the tables that materialize() wrote for these frames, once nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_attesta_path", None)
        if path:
            delete(df.sparkSession, path)
            df._attesta_path = None


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node that has a link: (node, component), the component being its smallest node.

    links has the columns a and b; direction and repetition do not matter, loops and nulls are ignored. Large-star and
    small-star rounds alternate until nothing changes; each keeps at most as many links as before, and a star's
    centre is joined, never collected. The minima are written before they are joined, so that both sides of a join are plain
    exchanges and adaptive execution can split the partition of a hot centre. Only two scalars a round reach the driver.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "edges")
    seen = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low2, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = materialize(small, "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges, low, large, low2)
        edges = new
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    centres = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
