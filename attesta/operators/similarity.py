"""Near-duplicate reviews by the cosine of their vectors, clusters of them, and what follows for reliability.

Equal vectors of a supplier are one representative with a number of copies. Representatives are dealt into blocks of some BLOCK vectors by their nearest pivot and
their angle to it, and two blocks are multiplied as matrices only if they can hold a similar pair: the angle is a metric, so vectors whose angles to a pivot differ by more
than the threshold's angle are never similar. Blocks in reach of each other are found by a join on the pivot and a band of angles, then held against all pivots. Any
pivots give the same pairs; far-apart ones leave fewer blocks. A large supplier is many rows of bounded size, no task holds a supplier, and no pair below the
threshold leaves a task. Pairs are those of representatives; `members` says who is one of them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.sources.scratch import cut

THRESHOLD = 0.88
BLOCK = 1024
#: Rows of two blocks in a batch, and pairs in one that a task gives back.
BATCH, ROWS = 8, 1 << 16
#: Pivots, the vectors they are chosen from, and the bands that the threshold's angle is cut into.
PIVOTS, SAMPLE, BANDS = 16, 512, 2


def members(vectors: DataFrame) -> DataFrame:
    """supplier, id, rep (the smallest id with the same vector), copies. vectors: supplier, id, vector; null and empty vectors are left out."""
    keyed = vectors.where(F.size("vector") > 0).select("supplier", "id", "vector", F.sha2(F.to_json("vector"), 256).alias("key"))
    reps = keyed.groupBy("supplier", "key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    return keyed.select("supplier", "id", "key").join(reps, ["supplier", "key"]).select("supplier", "id", "rep", "copies")


def pivots(vectors: DataFrame, most: int = PIVOTS):
    """Unit vectors far apart, chosen from SAMPLE of the vectors (by a hash of their ids, the same at every run): each next one is farthest from those before."""
    import numpy as np

    some = np.array([r[0] for r in vectors.orderBy(F.xxhash64("id"), "id").select("v").limit(SAMPLE).collect()], np.float64)
    if not len(some):
        return some.reshape(0, 0)
    some = some / np.sqrt((some * some).sum(1, keepdims=True))
    chosen, near = [0], some @ some[0]
    while len(chosen) < min(most, len(some)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, some @ some[chosen[-1]])
    return some[chosen]


def _angles(rows: DataFrame, far) -> DataFrame:
    """Adds angles, those to the pivots."""
    held = rows.sparkSession.sparkContext.broadcast(far)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("v")
            m = np.asarray(lists.flatten()).reshape(len(lists), -1) if len(lists) else np.zeros((0, held.value.shape[1]))
            found = np.arccos(np.clip(m @ held.value.T / np.sqrt((m * m).sum(1, keepdims=True)), -1.0, 1.0))
            ends = pa.array(np.arange(len(m) + 1, dtype=np.int32) * found.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], [*batch.schema.names, "angles"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, angles array<double>")


def blocks(rows: DataFrame, far, reach: float, size: int = BLOCK) -> DataFrame:
    """supplier, block, own (pivot), low and high (angles to every pivot), rows: vectors of one nearest pivot and one band of angles to it, about `size` at most."""
    band = max(reach / BANDS, 1e-3)
    own = F.array_position("angles", F.array_min("angles")).cast("int") - 1
    placed = _angles(rows, far).withColumn("own", own).withColumn("band", F.floor(F.get("angles", F.col("own")) / band))
    cells = placed.groupBy("supplier", "own", "band").agg(F.ceil(F.count("*") / size).alias("parts"))
    dealt = placed.join(cells, ["supplier", "own", "band"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    each = range(len(far))
    packed = dealt.groupBy("supplier", "own", "band", "part").agg(
        F.array(*(F.min(F.get("angles", F.lit(p))) for p in each)).alias("low"), F.array(*(F.max(F.get("angles", F.lit(p))) for p in each)).alias("high"), F.collect_list(F.struct("id", "copies", "v")).alias("rows")
    )
    return cut(packed.select("supplier", F.monotonically_increasing_id().alias("block"), "own", "low", "high", "rows"))


def reachable(packed: DataFrame, n: int, reach: float) -> DataFrame:
    """supplier, i, j (i <= j): the pairs of blocks that may hold a pair within reach. A block looks around its own pivot, the others are listed under each pivot."""
    band = max(reach / BANDS, 1e-3)
    of = packed.select("supplier", "block", "own", "low", "high")
    at = lambda angle: F.floor(angle / band)
    mine = of.select("supplier", F.col("block").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"), F.col("own").alias("pivot"), F.explode(F.sequence(at(F.get("low", F.col("own")) - reach), at(F.get("high", F.col("own")) + reach))).alias("band"))
    listed = of.select("supplier", F.col("block").alias("j"), "low", "high", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pivot"))
    theirs = listed.withColumn("band", F.explode(F.sequence(at(F.get("low", F.col("pivot"))), at(F.get("high", F.col("pivot"))))))
    apart = F.exists(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: (F.get("low_i", p) - F.get("high", p) > reach) | (F.get("low", p) - F.get("high_i", p) > reach))
    return mine.join(theirs, ["supplier", "pivot", "band"]).where((F.col("i") <= F.col("j")) & ~apart).select("supplier", "i", "j").distinct()


def similar_in(row, threshold: float):
    """The similar pairs of a row of two blocks (an Arrow batch: supplier, i, j, left, right), as Arrow batches of ROWS rows at most."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def side(name):
        rows = row.column(name)[0].values
        m = np.asarray(rows.field("v").flatten(), np.float64).reshape(len(rows), -1)
        return rows.field("id"), np.asarray(rows.field("copies"), np.int64), m / np.sqrt((m * m).sum(1, keepdims=True))

    (ids, copies, m), (other, more, k) = side("left"), side("right")
    found, same = np.clip(m @ k.T, -1.0, 1.0), row.column("i")[0].as_py() == row.column("j")[0].as_py()
    left, right = np.nonzero(found >= threshold)
    if same:  # each pair of a block once, and a representative with itself if it has copies
        keep = (left < right) | (left == right) & (copies[left] > 1)
        left, right = left[keep], right[keep]
    for at in range(0, len(left), ROWS):
        p, q = left[at : at + ROWS], right[at : at + ROWS]
        a, b = ids.take(pa.array(p)), other.take(pa.array(q))
        first, alone = pc.less(a, b), (p == q) & same
        similarity = np.where(alone, 1.0, found[p, q])
        weight = np.where(alone, copies[p] * (copies[p] - 1) // 2, copies[p] * more[q])
        supplier = row.column("supplier").take(pa.array(np.zeros(len(p), np.int64)))
        yield pa.RecordBatch.from_arrays([supplier, pc.if_else(first, a, b), pc.if_else(first, b, a), pa.array(similarity), pa.array(weight)], ["supplier", "a", "b", "similarity", "weight"])


def similar_pairs(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Pairs within a supplier with a cosine of at least the threshold: supplier, a, b, similarity, weight.

    a < b are representatives, or a = b for one that has copies; weight is the number of pairs of reviews that the row stands for. A vector of zeros is similar to none.
    """
    whole = members(vectors)
    reps = whole.where("id = rep").dropDuplicates(["supplier", "id"])
    kind, number = vectors.schema["supplier"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    some = vectors.where(F.exists("vector", lambda x: x != 0)).withColumn("v", F.transform("vector", lambda x: x.cast("double")))
    width = some.agg(F.max(F.size("vector"))).first()[0] or 0  # zeros behind a shorter supplier's vectors change none of their angles
    some = some.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
    rows = cut(some.join(reps.select("supplier", "id", "copies"), ["supplier", "id"]).dropDuplicates(["supplier", "id"]).select("supplier", "id", "copies", "v"))
    far = pivots(rows)
    if not len(far):
        return vectors.sparkSession.createDataFrame([], f"supplier {kind}, a {number}, b {number}, similarity double, weight bigint")
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    packed = blocks(rows, far, reach, block)

    def run(batches):
        for batch in batches:
            for n in range(len(batch)):
                yield from similar_in(batch.slice(n, 1), threshold)

    left = packed.select("supplier", F.col("block").alias("i"), F.col("rows").alias("left"))
    right = packed.select("supplier", F.col("block").alias("j"), F.col("rows").alias("right"))
    met = reachable(packed, len(far), reach).join(left, ["supplier", "i"]).join(right, ["supplier", "j"]).select("supplier", "i", "j", "left", "right")
    return cut(met.mapInArrow(run, f"supplier {kind}, a {number}, b {number}, similarity double, weight bigint"), BATCH)  # a row is two blocks


def clusters(pairs: DataFrame, belonging: DataFrame | None = None, rounds: int = 40) -> DataFrame:
    """Transitive clusters by propagation of the smallest id: supplier, id, cluster (its smallest id). Nodes without a pair are in none.

    With `belonging` (members) the copies of a representative are in its cluster. Every round takes the least label among a node's neighbours and then that
    label's own label, so paths shrink by halves; tables are checkpointed, and one count a round reaches the driver.
    """
    both = cut(pairs.select("supplier", "a", "b").unionByName(pairs.select("supplier", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("supplier", F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("cluster")))
    for _ in range(rounds):
        near = both.join(labels.select("supplier", F.col("id").alias("b"), "cluster"), ["supplier", "b"]).groupBy("supplier", F.col("a").alias("id")).agg(F.min("cluster").alias("near"))
        lower = labels.join(near, ["supplier", "id"]).select("supplier", "id", "cluster", F.least("cluster", "near").alias("next"))
        jump = lower.join(labels.select("supplier", F.col("id").alias("next"), F.col("cluster").alias("far")), ["supplier", "next"], "left")
        new = cut(jump.select("supplier", "id", F.least(F.col("next"), F.coalesce("far", "next")).alias("cluster"), "cluster").toDF("supplier", "id", "cluster", "old"))
        changed = new.where("cluster <> old").limit(1).count()
        labels = new.select("supplier", "id", "cluster")
        if not changed:
            break
    else:
        raise RuntimeError("clusters did not settle")
    if belonging is None:
        return labels
    return belonging.select("supplier", "id", "rep").join(labels.withColumnRenamed("id", "rep"), ["supplier", "rep"]).select("supplier", "id", "cluster")


def cluster_statistics(pairs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """supplier, cluster, members, min_similarity, avg_similarity, reliability, number (by first member, from 0). Pairs count as often as they weigh."""
    inside = pairs.join(labels.withColumnRenamed("id", "a").dropDuplicates(["supplier", "a"]), ["supplier", "a"])
    stats = inside.groupBy("supplier", "cluster").agg(F.min("similarity").alias("min_similarity"), (F.sum(F.col("similarity") * F.col("weight")) / F.sum("weight")).alias("avg_similarity"))
    sizes = labels.groupBy("supplier", "cluster").agg(F.count("*").alias("members"))
    strength = F.least(F.lit(1.0), (F.col("avg_similarity") - threshold) / max(1 - threshold, 1e-9) * 0.25 + 0.75)
    number = F.dense_rank().over(Window.partitionBy("supplier").orderBy("cluster")) - 1
    return stats.join(sizes, ["supplier", "cluster"]).withColumns({"reliability": strength, "number": number})


def combined_patterns(deterministic: DataFrame, statistics: DataFrame, counts: DataFrame) -> DataFrame:
    """The deterministic patterns and one a cluster: supplier, kind, strength, reliability. A cluster is as strong as its share of the supplier's reviews."""
    share = F.round(F.col("members") / F.greatest("review_count", F.lit(1)), 4)
    near = statistics.join(counts, "supplier").select("supplier", F.lit("SEMANTIC_NEAR_DUPLICATE").alias("kind"), share.alias("strength"), F.round("reliability", 4).alias("reliability"))
    return deterministic.select("supplier", "kind", "strength", "reliability").unionByName(near)


def semantic_penalty(statistics: DataFrame, counts: DataFrame) -> DataFrame:
    """min(0.5, share of clustered reviews * mean reliability * 0.5): supplier, clustered, penalty. counts: supplier, review_count."""
    per = statistics.groupBy("supplier").agg(F.sum("members").alias("clustered"), F.avg("reliability").alias("mean"))
    joined = counts.join(per, "supplier", "left")
    return joined.select("supplier", F.coalesce("clustered", F.lit(0)).alias("clustered"), F.round(F.least(F.lit(0.5), F.coalesce(F.col("clustered") / F.col("review_count") * F.col("mean") * 0.5, F.lit(0.0))), 4).alias("penalty"))


def reduced_reliability(reliability: DataFrame, penalties: DataFrame) -> DataFrame:
    """A supplier's review reliability less the penalty's share of it: supplier, reliability."""
    return reliability.join(penalties.select("supplier", "penalty"), "supplier", "left").select("supplier", F.round(F.col("reliability") * (1 - F.coalesce("penalty", F.lit(0.0))), 4).alias("reliability"))
