"""Language identification by a byte convolutional network.

A text is cut into windows of WINDOW bytes, one after the other, to its end. In a window, filters of several widths run over the
bytes; each takes its largest response (max pooling), and a softmax layer turns the pooled responses into a
distribution over the learned languages. A text's distribution is the mean of its windows', weighted by the bytes in them.

Because the input of the first layer is one of 256 byte values, a filter of width w is w tables of 256 rows, and its response a
sum of w table rows. For inference the tables of neighbouring bytes are added up once to tables over byte pairs,
as 16-bit integers, so a width of 4 costs two look-ups.

Training is numpy on the driver, on a bounded sample: SAMPLE_PER_LANG rows a language at most, drawn by a hash of doc_id, and
TRAIN_WINDOWS windows of each at hashed places. Inference is Arrow batches on the executors; the model that travels is some 40,000 floats.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE_PER_LANG = 1500
TRAIN_WINDOWS = 4
#: Rows whose texts a task holds as Python strings, and returns, at a time.
ROWS = 256


def held_out(id_col: str = "doc_id", modulus: int = 3, remainder: int = 1) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder


@dataclass
class ByteConvNet:
    """Filters by width as arrays (width, 256, FILTERS), their biases, and the softmax layer."""

    langs: list[str]
    tables: dict = field(default_factory=dict)
    bias: object = None
    dense: object = None
    offset: object = None
    _pairs: dict | None = None

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}

    def pair_tables(self):
        """Integer tables over byte pairs (and single bytes for odd widths), with the common scale."""
        import numpy as np

        if self._pairs is None:
            scale = 8000.0 / max(1e-6, max(float(np.abs(t).sum(0).max()) for t in self.tables.values()))
            self._pairs = {"scale": scale}
            for w, t in self.tables.items():
                q = np.rint(t * scale).astype(np.int16)
                self._pairs[w] = [(j, (q[j][:, None, :] + q[j + 1][None, :, :]).reshape(65536, -1)) for j in range(0, w - 1, 2)] + ([(w - 1, q[w - 1])] if w % 2 else [])
        return self._pairs

    def windows_proba(self, rows):
        """Distributions for an array of windows (n, WINDOW) of bytes."""
        import numpy as np

        tables, n = self.pair_tables(), rows.shape[1]
        pairs = (rows[:, :-1].astype(np.int32) << 8) | rows[:, 1:]
        singles = rows.astype(np.int32)
        pooled = []
        for w in self.tables:
            length, total = n - w + 1, None
            for j, table in tables[w]:
                at = (pairs if len(table) == 65536 else singles)[:, j : j + length]
                part = np.take(table, at, axis=0)
                total = part if total is None else np.add(total, part, out=total)
            pooled.append(total.max(axis=1))
        h = np.maximum(np.concatenate(pooled, 1) / np.float32(tables["scale"]) + self.bias, 0)
        z = h @ self.dense + self.offset
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(windows, labels, langs: list[str], epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 7) -> ByteConvNet:
    """Fits the network to windows (n, WINDOW) of bytes by Adam on the cross-entropy; gradients flow through the pooled places only."""
    import numpy as np

    rng = np.random.default_rng(seed)
    f = FILTERS
    p = {f"t{w}": rng.normal(0, 0.3, (w, 256, f)).astype(np.float32) for w in WIDTHS}
    p |= {"b": np.zeros(f * len(WIDTHS), np.float32), "d": rng.normal(0, 0.2, (f * len(WIDTHS), len(langs))).astype(np.float32), "o": np.zeros(len(langs), np.float32)}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    columns = np.arange(f)
    epochs = max(epochs, -(-300 * batch // max(1, len(windows))))  # some 300 steps at least
    for _ in range(min(epochs, 60)):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), batch):
            x, y = windows[order[start : start + batch]], labels[order[start : start + batch]]
            best, places = [], []
            for w in WIDTHS:
                length = x.shape[1] - w + 1
                response = sum(p[f"t{w}"][j][x[:, j : j + length]] for j in range(w))
                places.append(response.argmax(1))
                best.append(np.take_along_axis(response, places[-1][:, None, :], 1)[:, 0])
            raw = np.concatenate(best, 1) + p["b"]
            h = np.maximum(raw, 0)
            z = h @ p["d"] + p["o"]
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(y)), y] -= 1
            z /= len(y)
            dh = (z @ p["d"].T) * (raw > 0)
            g = {"d": h.T @ z, "o": z.sum(0), "b": dh.sum(0)}
            for i, w in enumerate(WIDTHS):
                g[f"t{w}"] = np.zeros_like(p[f"t{w}"])
                part = dh[:, i * f : (i + 1) * f]
                for j in range(w):
                    seen = np.take_along_axis(x, places[i] + j, 1)
                    np.add.at(g[f"t{w}"][j], (seen, np.broadcast_to(columns, seen.shape)), part)
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return ByteConvNet(langs, {w: p[f"t{w}"] for w in WIDTHS}, p["b"], p["d"], p["o"])


def fit(labelled: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> ByteConvNet:
    """Learns from the rows (doc_id, text, lang) of a labelled table; rows with null or empty text or null lang teach nothing.

    The languages are counted over all rows; of each, about per_lang rows are drawn by a hash of doc_id.
    """
    import numpy as np

    usable = labelled.where("lang is not null and octet_length(text) > 0")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return ByteConvNet([])
    langs = sorted(counts)
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, per_lang / counts[k]))))
    drawn = usable.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    raw = F.col("text").cast("binary")
    places = F.transform(F.sequence(F.lit(0), F.lit(TRAIN_WINDOWS - 1)), lambda i: F.substring(raw, (1 + F.pmod(F.xxhash64(i, "doc_id"), F.greatest(F.octet_length("text") - WINDOW + 1, F.lit(1)))).cast("int"), F.lit(WINDOW)))
    order = F.xxhash64(F.lit(11), "doc_id")  # the bound is twice what is drawn on average; should it bind, the same rows stay
    rows = drawn.select("doc_id", "lang", places.alias("windows")).orderBy(order, "doc_id", "windows").limit(2 * per_lang * len(langs)).toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    cut = [(langs.index(lang), bytes(w)) for lang, ws in zip(rows["lang"], rows["windows"], strict=True) for w in ws]
    windows = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for _, w in cut), np.uint8).reshape(-1, WINDOW)
    return train(windows, np.array([k for k, _ in cut]), langs)


def predict_texts(model: ByteConvNet, texts: list[str | None], chunk: int = 512) -> tuple[list[str], list[float]]:
    """Language and score of whole texts; `und` and 0.0 for texts that are null or have no letter, or if nothing was learned."""
    import numpy as np

    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    group, size = [], 0

    def flush():
        raw = [texts[i].encode() for i in group]
        counts = np.array([-(-len(b) // WINDOW) for b in raw])
        rows = np.frombuffer(b"".join(b.ljust(c * WINDOW, b"\0") for b, c in zip(raw, counts, strict=True)), np.uint8).reshape(-1, WINDOW)
        starts = np.cumsum(counts) - counts
        weight = np.full(len(rows), float(WINDOW))
        weight[starts + counts - 1] = [len(b) - (c - 1) * WINDOW for b, c in zip(raw, counts, strict=True)]
        p = np.concatenate([model.windows_proba(rows[k : k + chunk]) for k in range(0, len(rows), chunk)])
        p = np.add.reduceat(p * weight[:, None], starts, 0) / np.add.reduceat(weight, starts)[:, None]
        for i, k, s in zip(group, p.argmax(1), p.max(1), strict=True):
            langs[i], scores[i] = model.langs[k], min(1.0, float(s))

    for i, text in enumerate(texts):
        if text and model.langs and any(map(str.isalpha, text)):
            group.append(i)
            size += len(text)
        if size > 1 << 21 or (group and i == len(texts) - 1):
            flush()
            group, size = [], 0
    return langs, scores


def identify(docs: DataFrame, model: ByteConvNet, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """Adds the predicted language and its score to every row; columns of these names are replaced, all others pass through."""
    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([f for f in docs.schema.fields if f.name not in (lang_col, score_col)]).add(lang_col, StringType()).add(score_col, DoubleType())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = [n for n in batch.schema.names if n not in (lang_col, score_col)]
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                langs, scores = predict_texts(shared.value, part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, lang_col, score_col])
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out()))
    found = identify(docs.select("doc_id", "text"), model, score_col="score").drop("text")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
