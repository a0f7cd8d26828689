"""Near-duplicate detection by fast similarity sketching (Dahlgaard, Knudsen and Thorup, 2017), banding and exact verification.

A sketch has t coordinates. In round i < t every shingle falls into one hashed bin and competes for it with the key (i, hash); later rounds only
fill bins that are still empty, and round t + b sends every shingle to bin b, so each coordinate is filled after 2t rounds at most.
Coordinates of two sets agree with the probability of their similarity and with Chernoff-type concentration, at a cost of
O(n + t log t) hashes where plain MinHash takes n t.

Bands of `rows` coordinates make candidates. The number of bands follows from the threshold, so that a pair exactly at it is
missed with a probability below `miss` (1e-6). The candidates are the pairs of sets that share a bucket. They are not emitted:

1. documents of the same words collapse to one set of shingles;
2. every set is verified against one set it shares a bucket with, the one whose buckets hold most members: in a group of versions that is the text that
   the others are versions of. Sets linked so far get a label in common; a pair of one label needs no link more;
3. sets in buckets of several labels are paired by an exact filter: put the shingles of all these sets in one order, rarest first. Two sets of sizes
   a <= b can only be linked if they share ceil(t (a + b) / (1 + t)) shingles, so the first one they share stands so near the start of both that as many
   can follow. Only such leading shingles are joined, by size classes, and only in groups of more than one label, those of other labels than
   the most frequent one against all. A crowd of versions with changes of their own has nothing but unshared shingles there and gives no pairs.
   The pairs that remain and share a band are verified.

The filter is exact, whatever the size of a bucket or group; nothing is capped or dropped. Verification is on the full sets, computed again from the
texts of the candidates, not on sketches or hashes.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import connected_components, discard, materialize

WORDS = 5
ROWS = 6
MISS = 1e-6
#: Size classes for each factor of the threshold; more make the filter closer and its rows more.
CLASSES = 4


def band_count(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands for which a pair of the threshold's similarity is missed with a probability of at most `miss`."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after A-Z become lower case; bytes.lower and bytes.split follow ASCII exactly so."""
    return (text or "").encode().lower().split()


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 1 << 17:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def _word_hashes() -> _WordHashes:
    return _WordHashes()


def _mix(x):
    """The finishing steps of splitmix64, on unsigned 64-bit arrays."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _seeds(n: int):
    import numpy as np

    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_hashes(words: list[bytes], k: int = WORDS):
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it is shorter; empty without words."""
    import numpy as np

    if not words:
        return np.empty(0, np.uint64)
    table = _word_hashes()
    w = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    n, width = max(1, len(words) - k + 1), min(k, len(words))
    total = np.full(n, width, np.uint64)
    for j in range(width):
        total += w[j : j + n] * (_seeds(k)[j] | np.uint64(1))
    return np.unique(_mix(total))


def sketch(hashes, t: int):
    """The t coordinates of a non-empty set of 64-bit hashes; the round stands in the upper 16 bits of a coordinate."""
    import numpy as np

    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    seeds, low, n = _seeds(2 * t), np.uint64((1 << 44) - 1), len(hashes)
    start = 0
    while start < t:
        stop = min(t, start + max(1, 4 * t // n))
        x = _mix(hashes[None, :] ^ seeds[start:stop, None])
        bins = ((x >> np.uint64(44)) * np.uint64(t)) >> np.uint64(20)
        keys = (x & low) | (np.arange(start, stop, dtype=np.uint64)[:, None] << np.uint64(48))
        np.minimum.at(out, bins.ravel().astype(np.int64), keys.ravel())
        if out.max() >> np.uint64(48) < t:
            return out
        start = stop
    for b in np.flatnonzero(out >> np.uint64(48) >= t):
        out[b] = (_mix(hashes ^ seeds[t + b]) & low).min() | np.uint64((t + b) << 48)
    return out


def band_keys(coordinates, rows: int):
    import numpy as np

    parts = coordinates.reshape(-1, rows)
    keys = _seeds(len(parts)).copy()
    for j in range(rows):
        keys = _mix(keys ^ parts[:, j])
    return keys.view(np.int64)


def sketches(docs: DataFrame, percent: int, k: int = WORDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (a digest of the words; null without any), bands."""
    bands = band_count(percent, rows)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sizes, keys, found = [], [], []
            for text in batch.column("text"):  # one after the other: a list of them is as large as the batch
                words = words_of(text.as_py())
                h = shingle_hashes(words, k)
                sizes.append(len(h))
                keys.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if len(h) else None)
                if len(h):
                    found.append(band_keys(sketch(h, bands * rows), rows))
            offsets = np.concatenate([[0], np.cumsum([bands if n else 0 for n in sizes])]).astype(np.int32)
            values = np.concatenate(found) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                ["doc_id", "text_hash", "n_shingles", "set_key", "bands"],
            )

    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def linked(a: list[bytes], b: list[bytes], percent: int, k: int = WORDS) -> bool:
    """Whether 100 * |intersection| >= percent * |union| for the exact shingle sets of two non-empty word lists."""
    import numpy as np

    names = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    if len(names) < 4096 and k == 5 and min(len(a), len(b)) >= k:  # five 12-bit names fit into one integer

        def packed(words):
            x = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
            n = len(x) - 4
            return np.unique(x[:n] << 48 | x[1 : n + 1] << 36 | x[2 : n + 2] << 24 | x[3 : n + 3] << 12 | x[4 : n + 4])

        p, q = packed(a), packed(b)
        both = len(np.intersect1d(p, q, assume_unique=True))
    else:
        p, q = ({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} for words in (a, b))
        both = len(p & q)
    return 100 * both >= percent * (len(p) + len(q) - both)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) of sets with `ok`, whether they are links. texts: set and the text of one document of it."""

    def run(batches):
        import pyarrow as pa

        held_words = lru_cache(maxsize=16)(words_of)
        for batch in batches:
            ok = [linked(held_words(x.as_py()), words_of(y.as_py()), percent, k) for x, y in zip(batch.column("text_a"), batch.column("text_b"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    both = pairs.join(texts.select(F.col("set").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("set").alias("a"), F.col("text").alias("text_a")), "a")
    return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, ok boolean"), "links")


def _stars(live: DataFrame) -> DataFrame:
    """(a, b): every set b of a bucket (bucket, set, members) and the set a of its buckets that has most company, if that is another."""
    company = materialize(live.groupBy("set").agg(F.sum("members").alias("company")), "company")
    named = live.select("bucket", "set").join(company, "set")
    centres = materialize(named.groupBy("bucket").agg(F.max(F.struct("company", F.col("set").alias("centre"))).alias("best")), "centres")
    chosen = live.select("bucket", "set").join(centres, "bucket").groupBy("set").agg(F.max("best").alias("best"))
    stars = materialize(chosen.select(F.col("best.centre").alias("a"), F.col("set").alias("b")).where("a <> b"), "stars")
    discard(company, centres)
    return stars


def _open(live: DataFrame, done: DataFrame) -> DataFrame:
    """(set, label) of the sets in buckets of several labels; sets of one label are connected by links."""
    components = connected_components(done.where("ok"))
    labels = materialize(live.select("set").distinct().join(components.select(F.col("node").alias("set"), "component"), "set", "left").select("set", F.coalesce("component", "set").alias("label")), "labels")
    labelled = live.select("bucket", "set").join(labels, "set")
    mixed = materialize(labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket"), "mixed")
    open_ = materialize(live.join(mixed, "bucket").select("set").distinct().join(labels, "set"), "open")
    discard(labels, mixed)
    return open_


def needed(a, b, percent: int):
    """How many shingles two sets of sizes a and b must share to be linked; for integers and columns."""
    return ((a + b) * percent + (99 + percent)) / (100 + percent)


def _leading(open_: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """The leading shingles of open sets: (shingle, class, lesser, set, label, n, pos), pos from 1 in the order from rare to frequent.

    A set stands under the class of its own size as the lesser of a pair, and under every class of size a lesser partner can have as the greater.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = [shingle_hashes(words_of(t), k).view(np.int64) for t in part.column("text").to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(h) for h in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("set"), part.column("label"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["set", "label", "shingles"])

    hashed = materialize(texts.join(open_, "set").select("set", "label", "text").mapInArrow(run, "set bigint, label bigint, shingles array<bigint>"), "shingles")
    each = hashed.select("set", "label", F.size("shingles").cast("bigint").alias("n"), F.explode("shingles").alias("shingle"))
    often = materialize(each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    order = each.join(often, "shingle").groupBy("set", "label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("common"))
    width = math.log(100 / percent) / CLASSES
    class_of = lambda n: F.floor(F.log(n.cast("double")) / width)
    n = F.col("n")
    small = F.ceil(n * percent / 100)
    roles = F.concat(
        F.array(F.struct(class_of(n).alias("class"), F.lit(True).alias("lesser"), (n - F.floor(needed(n, n, percent)) + 1).alias("limit"))),
        F.transform(
            F.sequence(class_of(small), class_of(n)),
            lambda c: F.struct(c.alias("class"), F.lit(False).alias("lesser"), (n - F.floor(needed(F.greatest(small, F.floor(F.exp(c * width)) - 1), n, percent)) + 1).alias("limit")),
        ),
    )
    spots = order.select("set", "label", "n", (n - F.size("common")).alias("rare"), "common", F.explode(roles).alias("role")).where("role.limit > rare")
    led = spots.select("set", "label", "n", "rare", "role", F.posexplode(F.slice("common", F.lit(1), (F.col("role.limit") - F.col("rare")).cast("int"))).alias("at", "spot"))
    led = materialize(led.select(F.col("spot.shingle").alias("shingle"), F.col("role.class").alias("class"), F.col("role.lesser").alias("lesser"), "set", "label", "n", (F.col("rare") + F.col("at") + 1).alias("pos")), "leading")
    discard(hashed, often)
    return led


def _pairs(led: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets of two labels that the leading shingles leave possible."""
    key = ["shingle", "class"]
    counts = led.groupBy(*key, "label").agg(F.count("*").alias("c"))
    main = materialize(counts.groupBy(*key).agg(F.max(F.struct("c", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").select(*key, F.col("main.label").alias("main")), "main")
    rows = materialize(led.join(main, key), "contested")
    few = rows.where("label <> main").select(*key, F.col("lesser").alias("x_lesser"), F.col("set").alias("x"), F.col("label").alias("x_label"), F.col("n").alias("x_n"), F.col("pos").alias("x_pos"))
    need = F.floor(needed(F.col("x_n"), F.col("n"), percent))
    before = (F.col("x_n") < F.col("n")) | ((F.col("x_n") == F.col("n")) & (F.col("x") < F.col("set")))
    met = few.join(rows, key).where((F.col("x_label") != F.col("label")) & (F.col("x_lesser") != F.col("lesser")) & (F.col("x_lesser") == before))
    met = met.where((F.col("x_pos") <= F.col("x_n") - need + 1) & (F.col("pos") <= F.col("n") - need + 1) & (100 * F.least("x_n", "n") >= percent * F.greatest("x_n", "n")))
    pairs = materialize(met.select(F.least("x", "set").alias("a"), F.greatest("x", "set").alias("b")).distinct(), "pairs")
    discard(main, rows)
    return pairs


def near_duplicates(docs: DataFrame, percent: int, k: int = WORDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Texts without words (null, empty, blank) have no shingles and link with nothing. Rows without an id stay, with component_id null.
    Rows that repeat an id are one node: their links are shared, and all of them carry the same component. Other columns are not
    read. An empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows_ = materialize(sketches(source, percent, k, rows), "sketches")
    with_set = rows_.where("set_key is not null and doc_id is not null")
    sets = with_set.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.any_value("bands").alias("bands"))
    sets = materialize(sets.select("set_key", "first.doc_id", "first.text_hash", "bands", F.monotonically_increasing_id().alias("set")), "sets")
    buckets = sets.select("set", F.explode("bands").alias("bucket"))
    shared = materialize(buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "shared")
    live = materialize(buckets.join(shared, "bucket"), "buckets")
    candidates = sets.join(live.select("set").distinct(), "set").select("set", "doc_id", "text_hash")
    texts = materialize(source.where("text is not null").join(candidates, ["doc_id", "text_hash"]).select("set", "text").dropDuplicates(["set"]), "texts")

    stars = _stars(live)
    done = _verified(stars, texts, percent, k)
    open_ = _open(live, done)
    links = done
    if not open_.isEmpty():
        led = _leading(open_, texts, percent, k)
        pairs = _pairs(led, percent).join(done.select("a", "b").unionByName(done.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
        bands = sets.select("set", "bands")
        pairs = pairs.join(bands.select(F.col("set").alias("a"), F.col("bands").alias("bands_a")), "a").join(bands.select(F.col("set").alias("b"), F.col("bands").alias("bands_b")), "b")
        pairs = materialize(pairs.where(F.arrays_overlap("bands_a", "bands_b")).select("a", "b"), "pairs")
        links = links.unionByName(_verified(pairs, texts, percent, k))
        discard(led, pairs)
    nodes = with_set.select("doc_id", "set_key").join(sets.select("set_key", "set"), "set_key").select("doc_id", "set")
    nodes = materialize(nodes.distinct(), "nodes")
    repeated = nodes.groupBy("doc_id").agg(F.min("set").alias("a"), F.max("set").alias("high")).where("a <> high").select("doc_id", "a")
    repeated = nodes.join(repeated, "doc_id").select("a", F.col("set").alias("b"))
    components = connected_components(links.where("ok").select("a", "b").unionByName(repeated))
    members = materialize(nodes.join(components.withColumnRenamed("node", "set"), "set", "left").select("doc_id", F.coalesce("component", "set").alias("label")).distinct(), "members")
    low = materialize(members.groupBy("label").agg(F.min("doc_id").alias("component_id")), "lows")
    reached = materialize(members.join(low, "label").select("doc_id", "component_id"), "reached")
    discard(sets, shared, live, texts, stars, open_, done, links, nodes, members, low, components)
    return (
        rows_.select("doc_id", "n_shingles").join(reached, "doc_id", "left")
        .select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
