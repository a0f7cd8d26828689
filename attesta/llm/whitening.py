"""Embedding whitening by hierarchical SVD merging.

The vectors are quantised, each distinct one counts once, and no covariance is ever formed. A task folds its share of the distinct vectors into a
summary: their number, their mean, exact sums, and all singular values and right vectors of the centred vectors (a full rank: as many as dimensions,
none is cut off). Two summaries merge by a decomposition of their stacked rows, value times vector, and of one row more, the difference of the means
times sqrt(n m / (n + m)), which is what centring about the common mean adds. Nothing is lost but rounding, as the rows stacked have the
scatter matrix of all vectors together. Summaries merge in rounds of FAN; a merge holds FAN matrices of the size of the dimension squared, whatever the rows.

The driver holds the mean and the leading components, some numbers for each dimension. Vectors of different lengths lie in different spaces: each length is fitted
and whitened by itself.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import discard, materialize

SCALE = 256
COMPONENTS = 4
FAN = 8
#: Numbers of means and components that the driver may hold for all lengths of vectors together.
MOST_NUMBERS = 1 << 24
#: An eigenvalue below this part of the largest one is rounding: its component has no scale to whiten by.
RANK_TOLERANCE = 1e-20

SUMMARY = "dim int, id bigint, n bigint, sums array<decimal(38,0)>, mean array<double>, sigma array<double>, vectors array<double>"
WHITENED = "component int, n bigint, deviation string, whitened double, explained double, identity_error double"


class Space(NamedTuple):
    """What is fitted for the vectors of one length. `components` are rows; `error` is the largest distance of the whitened covariance from the identity."""

    n: int
    sums: list[int]
    components: object
    values: object
    trace: float
    error: float = 0.0


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, x): the vectors without null or non-finite entries as longs. Null vectors are left out."""
    x = F.col(vector_col).cast("array<double>")
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(sound).select(F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))


def _svd(rows):
    """All singular values and right vectors of some rows, as many as there are columns."""
    import numpy as np

    d = rows.shape[1]
    if len(rows) > d:
        rows = np.linalg.qr(rows, mode="r")
    elif len(rows) < d:
        rows = np.vstack([rows, np.zeros((d - len(rows), d))])
    _, sigma, vectors = np.linalg.svd(rows)
    return sigma, vectors


def merged(summaries):
    """One summary (n, sums, mean, sigma, vectors) of several; sums are exact integers."""
    import numpy as np

    n, sums, mean, sigma, vectors = summaries[0]
    rows = [sigma[:, None] * vectors]
    for m, more, other, s, v in summaries[1:]:
        rows += [s[:, None] * v, np.sqrt(n / (n + m) * m) * (other - mean)[None, :]]
        n, sums = n + m, [a + b for a, b in zip(sums, more, strict=True)]
        mean = np.array([a / n for a in sums])
    return n, sums, mean, *_svd(np.vstack(rows))


def summary(x):
    """The summary of some rows of longs."""
    import numpy as np

    sums = [int(a) + (int(b) << 32) for a, b in zip((x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0), strict=True)]
    mean = np.array([s / len(x) for s in sums])
    return len(x), sums, mean, *_svd(x - mean)


def _record(dim: int, at: int, found):
    import pyarrow as pa
    from decimal import Decimal

    n, sums, mean, sigma, vectors = found
    columns = [[dim], [at], [n], [[Decimal(s) for s in sums]], [mean.tolist()], [sigma.tolist()], [vectors.ravel().tolist()]]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0)), *[pa.list_(pa.float64())] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["dim", "id", "n", "sums", "mean", "sigma", "vectors"])


def _summaries(batch):
    import numpy as np

    for row in batch.to_pylist():
        d = row["dim"]
        yield row["n"], [int(s) for s in row["sums"]], np.array(row["mean"]), np.array(row["sigma"]), np.array(row["vectors"]).reshape(d, d)


def by_length(column):
    """(dim, rows, matrix) for each length of the vectors in an Arrow column of lists without nulls."""
    import numpy as np

    lengths, flat = column.value_lengths().to_numpy(zero_copy_only=False), np.asarray(column.flatten())
    ends = np.cumsum(lengths)
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        if d:
            yield d, rows, flat.reshape(-1, d) if len(rows) == len(lengths) else flat[(ends[rows] - d)[:, None] + np.arange(d)]


def _leaves(distinct: DataFrame) -> DataFrame:
    """A summary for each task and length."""

    def run(batches):
        from pyspark import TaskContext

        held = {}
        for batch in batches:
            for d, _, x in by_length(batch.column("x")):
                now = summary(x)
                held[d] = merged([held[d], now]) if d in held else now
        for d, found in held.items():
            yield _record(d, TaskContext.get().partitionId(), found)

    return distinct.mapInArrow(run, SUMMARY)


def _merged_once(summaries: DataFrame) -> DataFrame:
    """Every FAN summaries of a length become one."""

    def run(keys, table):
        import pyarrow as pa

        rows = [s for b in table.sort_by("id").to_batches() for s in _summaries(b)]
        return pa.Table.from_batches([_record(keys[0].as_py(), keys[1].as_py(), merged(rows))])

    return summaries.groupBy("dim", F.floor(F.col("id") / FAN).alias("group")).applyInArrow(run, SUMMARY)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Space]:
    """The space of each length of the distinct x vectors of `vectors`."""
    import numpy as np

    spark = vectors.sparkSession
    distinct = materialize(vectors.select("x").distinct(), "distinct")
    summaries = materialize(_leaves(distinct), "summaries")
    top = summaries.agg(F.max("id")).first()[0] or 0
    tree = summaries
    while top:
        tree, top = _merged_once(tree), top // FAN
    tree = materialize(tree, "merged")
    width = tree.agg(F.sum(F.col("dim").cast("bigint"))).first()[0] or 0
    if width * (components + 1) > MOST_NUMBERS:
        raise ValueError(f"vectors of too many lengths: {width} dimensions together")
    spaces = {}
    leading = F.slice("vectors", 1, F.col("dim") * components).alias("vectors")
    for row in tree.select("dim", "n", "sums", "sigma", leading).collect():
        e = np.array(row["sigma"]) ** 2 / row["n"]
        v = np.array(row["vectors"]).reshape(-1, row["dim"])
        v = v * np.where(v[np.arange(len(v)), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]  # the largest entry is positive
        usable = (e[: len(v)] > e[0] * RANK_TOLERANCE) & (e[: len(v)] > 0)
        spaces[row["dim"]] = Space(row["n"], [int(s) for s in row["sums"]], v, np.where(usable, e[: len(v)], np.nan), float(e.sum()))
    spaces = _with_errors(distinct, spaces, spark)
    discard(distinct, summaries, tree)
    return spaces


def projected(space: Space, x):
    """The whitened rows: one column a component, NaN where it has no scale."""
    import numpy as np

    mean = np.array([s / space.n for s in space.sums])
    return (x - mean) @ space.components.T / np.sqrt(space.values)


def _with_errors(distinct: DataFrame, spaces: dict[int, Space], spark) -> dict[int, Space]:
    """Measures the covariance of the whitened distinct vectors, task by task, centred in each task and corrected for the means as above."""
    import numpy as np

    held = spark.sparkContext.broadcast(spaces)

    def run(batches):
        import pyarrow as pa

        found = {}
        for batch in batches:
            for d, _, x in by_length(batch.column("x")):
                w = projected(held.value[d], x)
                n, mean = len(w), w.mean(axis=0)
                scatter = (w - mean).T @ (w - mean)
                if d in found:
                    m, other, more = found[d]
                    gap = mean - other
                    n, mean, scatter = n + m, other + gap * (n / (n + m)), scatter + more + np.outer(gap, gap) * (n * (m / (n + m)))
                found[d] = n, mean, scatter
        for d, (n, mean, scatter) in found.items():
            i, j = (np.arange(scatter.size) // len(mean), np.arange(scatter.size) % len(mean))
            columns = [pa.array(np.full(scatter.size, v, kind)) for v, kind in ((d, np.int32), (n, np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, (i, j, scatter.ravel(), mean[i], mean[j]))], ["dim", "n", "i", "j", "s", "l", "r"])

    parts = distinct.mapInArrow(run, "dim int, n bigint, i bigint, j bigint, s double, l double, r double")
    n = F.sum("n")
    between = F.sum(F.col("n") * F.col("l") * F.col("r")) - F.sum(F.col("n") * F.col("l")) * F.sum(F.col("n") * F.col("r")) / n
    gaps = parts.groupBy("dim", "i", "j").agg(F.abs((F.sum("s") + between) / n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)).alias("gap"))
    errors = gaps.groupBy("dim").agg(F.max(F.when(~F.isnan("gap"), F.col("gap"))).alias("error")).collect()
    held.unpersist()
    return {r["dim"]: spaces[r["dim"]]._replace(error=r["error"]) for r in errors}


def deviations(space: Space, x) -> list[int]:
    """Per row the sum over dimensions of (n x - S)^2, as exact integers."""
    import numpy as np

    most = space.n * (int(np.abs(x.astype(np.float64)).max()) + 1) + max(abs(s) for s in space.sums)
    kind = np.int64 if most * most * x.shape[1] < 1 << 63 else object
    gap = x.astype(kind) * space.n - np.array(space.sums, dtype=kind)
    return [int(s) for s in (gap * gap).sum(axis=1)]


def whitened(vectors: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """The columns (id, component, n, deviation, whitened, explained, identity_error) of rows (id, x), a row for each component.

    Components without a scale (equal vectors, fewer dimensions than vectors need) give null for whitened and 0 for explained. deviation is a string of
    digits, as it has no bound.
    """
    held = vectors.sparkSession.sparkContext.broadcast(spaces)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for d, rows, x in by_length(batch.column("x")):
                space = held.value[d]
                w = projected(space, x)
                k = w.shape[1]
                share = np.nan_to_num(space.values / space.trace if space.trace else space.values * 0)
                exact = pa.array([str(v) for v in deviations(space, x)])
                columns = [
                    batch.column("id").take(pa.array(np.repeat(rows, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(rows) * k, space.n)),
                    exact.take(pa.array(np.repeat(np.arange(len(rows)), k))),
                    pa.array(w.ravel(), from_pandas=True),
                    pa.array(np.tile(share, len(rows))),
                    pa.array([space.error] * (len(rows) * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, {WHITENED}")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Whitens the vectors on their leading components; one row for each vector and component.

    Vectors that are null or hold null or non-finite entries are left out, as are vectors without entries; entries too large for a long become the largest or
    least long. Vectors of several lengths are fitted each length by itself. Repeated rows and ids count once in the fit if their vectors are equal, and each gives
    its own rows; null ids stay null. An empty table gives no rows. Only the two columns named are read.
    """
    x = quantised(vectors, id_col, vector_col, scale)
    return whitened(x, fit(x, components)).withColumnRenamed("id", id_col)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """deviation is null where it does not fit a long; deviation_digits has it in any case."""
    done = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("deviation", "deviation_digits")
    return done.withColumn("deviation", F.col("deviation_digits").try_cast("bigint")).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits")
