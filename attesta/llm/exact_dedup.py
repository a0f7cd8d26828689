"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive runs of bytes of their normalised text, most significant first. A round groups what
is still undecided by (group so far, next bytes, whether the text ends there); a group of one is decided, a group whose
texts end is decided, the others go on with the bytes that follow. Equality is that of the bytes themselves, no digest
takes part in it. Runs grow from round to round (64 bytes, then 16 times as many each), so the number of jobs is
the logarithm of the longest text that has a partner, and only texts that still share their whole prefix with another
are read again.

A round aggregates before it shuffles (one row per group and task), writes the groups of two or more and joins them back. Written
groups make both sides of that join plain exchanges, so adaptive execution splits the partition of a hot group. The groups grow with the
input, so they are merged and never broadcast, at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import discard, materialize

FIRST_RUN = 64
GROWTH = 16


def normalized(text: str = "text"):
    """Each run of ASCII white space becomes one space (a lone space already is); null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_run: int = FIRST_RUN, growth: int = GROWTH) -> DataFrame:
    """One row per document: the id, keep_id, group_size, kept, text_sha256.

    Empty and null texts are equal to each other. Rows without an id cannot be named by others: each stays, as a group of its own
    with keep_id null. Of rows that repeat one id with equal text exactly one is kept. Other columns are not read.
    An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalized(text_col).cast("binary").alias("rest")).withColumn("rid", F.monotonically_increasing_id())
    nameless = rows.where("id is null").select("id", F.lit(None).cast(docs.schema[id_col].dataType).alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.sha2("rest", 256).alias("text_sha256"))
    # the numbers of the rows are written before they are joined with themselves; the plain number of a scan would do only for plain scans
    active = rows.where("id is not null").select("id", "rid", F.lit(0).cast("bigint").alias("grp"), "rest", F.sha2("rest", 256).alias("sha"))
    active = materialize(active, "numbered")
    decided, run = [], first_run
    while True:
        keyed = active.withColumns({"run": F.substring("rest", 1, run), "ended": F.octet_length("rest") <= run})
        groups = (
            keyed.groupBy("grp", "run", "ended")
            .agg(F.count("*").alias("n"), F.min(F.struct("id", "rid")).alias("first"), F.min("rid").alias("label"))
            .where("n > 1")
        )
        groups = materialize(groups, "groups")
        joined = keyed.join(groups.hint("merge"), ["grp", "run", "ended"], "left")
        open_ = F.col("n").isNotNull() & ~F.col("ended")
        step = joined.select(
            "id",
            F.when(open_, F.col("rid")).alias("rid"),
            F.when(open_, F.col("label")).alias("grp"),
            F.when(open_, F.substring(F.col("rest"), F.lit(run + 1), F.octet_length("rest"))).alias("rest"),
            "sha",
            F.coalesce(F.col("first.id"), F.col("id")).alias("keep_id"),
            F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
            (F.col("n").isNull() | (F.col("first.rid") == F.col("rid"))).alias("kept"),
            open_.alias("open"),
        )
        step = materialize(step, "radix")
        decided.append(step.where(~F.col("open")).select("id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")))
        discard(groups)
        active = step.where("open").select("id", "rid", "grp", "rest", "sha")
        if active.isEmpty():
            break
        run *= growth
    out = nameless
    for part in decided:
        out = out.unionByName(part)
    return out.withColumnRenamed("id", id_col)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
g as (select doc_id, norm, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g
"""
