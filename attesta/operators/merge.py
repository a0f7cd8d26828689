"""Merging an older and a newer capture of one page, keeping where each value came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.sources.scratch import cut


def keyed(old: DataFrame, new: DataFrame, keys: list[str], cap: int = 20) -> DataFrame:
    """Items by natural key: a new value wins over an old one, a missing one takes the other. Columns: owner, item, pos, payload.

    New items come first, each side in its own order; per owner the first `cap` are kept and the rest counted in `omitted`.
    Lineage says which captures hold the item.
    """
    o = old.select(*keys, F.col("pos").alias("old_pos"), F.col("payload").alias("old_payload"))
    n = new.select(*keys, F.col("pos").alias("new_pos"), F.col("payload").alias("new_payload"))
    joined = n.join(o, keys, "full")
    lineage = F.array_join(F.array_compact(F.array(F.when(F.col("old_pos").isNotNull(), "old"), F.when(F.col("new_pos").isNotNull(), "new"))), ",")
    rows = cut(joined.select(*keys, F.coalesce("new_payload", "old_payload").alias("payload"), lineage.alias("lineage"), F.col("new_pos").isNull().alias("_late"), F.coalesce("new_pos", "old_pos").alias("_pos")))
    rank = F.row_number().over(Window.partitionBy(keys[0]).orderBy("_late", "_pos", *keys[1:]))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= cap).drop("_late", "_pos")  # the rank filter goes below the shuffle as a group limit
    omitted = rows.groupBy(keys[0]).agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("omitted"))
    return first.join(omitted.withColumnRenamed(keys[0], "_owner"), F.col(keys[0]).eqNullSafe(F.col("_owner"))).drop("_owner")


def multiset(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Of every key as many as the side that has more of it: key, copies. The counts are joined, not the rows."""
    o = old.groupBy(key).agg(F.count("*").alias("o"))
    n = new.groupBy(key).agg(F.count("*").alias("n"))
    return o.join(n, key, "full").select(key, F.greatest(F.coalesce("o", F.lit(0)), F.coalesce("n", F.lit(0))).alias("copies"))


def cards(old: Column, new: Column, most: int = 20) -> Column:
    """Review cards of two captures (arrays of texts): of each text as many as the capture that has more of it, the newer capture's first. Texts are told apart as review_key does."""
    some = F.array().cast("array<string>")
    a, b = F.coalesce(old, some), F.coalesce(new, some)
    same = lambda among, x: F.size(F.filter(among, lambda y: tx.review_key(y) == tx.review_key(x)))
    return F.slice(F.concat(b, F.filter(a, lambda x, i: same(F.slice(a, 1, i + 1), x) > same(b, x))), 1, most)


def scalars(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Single values: the newer one, or the older where the newer is null; `<column>_from` names the side."""
    o = old.select(key, *(F.col(c).alias(f"old_{c}") for c in columns))
    n = new.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    side = lambda c: F.when(F.col(f"new_{c}").isNotNull(), "new").when(F.col(f"old_{c}").isNotNull(), "old")
    return n.join(o, key, "full").select(key, *(F.coalesce(f"new_{c}", f"old_{c}").alias(c) for c in columns), *(side(c).alias(f"{c}_from") for c in columns))


def maps(old: Column, new: Column) -> Column:
    """A shallow merge of two maps; keys of the newer win. Null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    o, n = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(o, lambda k, _: ~F.map_contains_key(n, k)), n)


def first_written(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of every key by an explicit order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
