"""One stream of results into several tables: a result with its lists becomes a row of the head table and rows of a table for each list.

A batch is written under its number, the lists first and the head last, and readers take rows of a batch only if the head table has it: they see whole batches, and a
batch that broke off leaves nothing to see. A batch that runs again compares itself with what is stored and adds nothing; what differs goes to the conflicts. A result whose key
another batch has stored is dropped if it is the same and a conflict otherwise. Spark's file commits are the only protocol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD, CONFLICTS = "head", "conflicts"


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def fan_out(path: str, key: str, lists: list[str]):
    """A foreachBatch function for rows (key, columns of the head, arrays of structs): writes to path/head, path/<list> and path/conflicts, each by batch.

    Rows of one batch that repeat a key are one if they are equal and conflicts otherwise; rows without a key are conflicts. Lists may be null or empty.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, plain = batch.sparkSession, [c for c in batch.columns if c not in lists]
        marked = batch.withColumn("digest", F.sha2(F.to_json(F.struct(*sorted(batch.columns)), {"ignoreNullFields": "false"}), 256)).persist()
        digests = marked.groupBy(key).agg(F.min("digest").alias("digest"), F.max("digest").alias("other"))
        sound = digests.where(F.col(key).isNotNull() & (F.col("digest") == F.col("other"))).select(key, "digest")
        bad = digests.where(F.col(key).isNull() | (F.col("digest") != F.col("other"))).select(key, "digest", F.lit("REPEATED_KEY").alias("reason"))
        stored = read(spark, path, HEAD).select(key, F.col("digest").alias("stored"), F.col("batch").alias("by")) if _there(spark, f"{path}/{HEAD}") else None
        done = stored is not None and not stored.where(F.col("by") == batch_id).isEmpty()
        fresh = sound
        if stored is not None:
            met = sound.join(stored.select(key, "stored"), key, "left").persist()
            fresh = met.where("stored is null").select(key, "digest")
            bad = bad.unionByName(met.where("stored <> digest").select(key, "digest", F.lit("STORED_DIFFERS").alias("reason")))
        if done:  # this batch has been written whole: a new key in it is another difference
            bad = bad.unionByName(fresh.select(key, "digest", F.lit("NOT_STORED").alias("reason")))
        bad.write.mode("overwrite").parquet(f"{path}/{CONFLICTS}/batch={batch_id}")
        if not done:
            rows = marked.join(fresh, [key, "digest"], "left_semi").dropDuplicates([key])
            for name in lists:
                rows.select(key, F.posexplode(name).alias("ordinal", "item")).select(key, "ordinal", "item.*").write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
            rows.select(*plain, "digest").write.mode("overwrite").parquet(f"{path}/{HEAD}/batch={batch_id}")
        marked.unpersist()

    return write


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The rows of a table with their batch, of whole batches only."""
    whole = spark.read.option("basePath", f"{path}/{HEAD}").parquet(f"{path}/{HEAD}")
    if table == HEAD:
        return whole
    rows = spark.read.option("basePath", f"{path}/{table}").parquet(f"{path}/{table}")
    return rows if table == CONFLICTS else rows.join(whole.select("batch").distinct(), "batch", "left_semi").select(*rows.columns)
