"""Which texts hold which passages: a substring join by anchors.

A passage names one of its strings of some bytes as its anchor, that of the least hash within its first bytes; TIERS says how many, long passages have long anchors, which few texts
share. A text names the least string of every so many bytes on end; where the passage stands in it, that is the passage's anchor. A bitmap of the passages' anchors, of
MOST_BITS at most, keeps the others out of the join. Both sides are joined on the hash, and every pair that meets is compared exactly, so the join loses no pair and
keeps no wrong one. Texts are read once for anchors, in Arrow batches, and shuffled once, to the pairs that they are in; neither side is multiplied with the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The least bytes of a passage, and the bytes of its anchor.
TIERS = ((16, 8), (32, 24), (60, 56), (120, 112))
LEAST = TIERS[0][0]
SLICE, ROWS = 1 << 20, 1 << 16
MOST_BITS, BUCKET = 1 << 27, 1 << 15


def _hashes(raw: bytes, gram: int):
    """A 64-bit hash of each string of `gram` bytes, a multiple of 8."""
    import numpy as np

    n, h = len(raw) - gram + 1, np.uint64(gram)
    for at in range(0, gram, 8):
        h = (np.ndarray((n,), "<u8", raw, at, (1,)) ^ h) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def anchors(raw: bytes, tier: tuple[int, int], first_only: bool = False):
    """The anchors of a text as longs, a slice of it at a time; none for one shorter than the tier's least bytes."""
    import numpy as np

    least, gram = tier
    for base in range(0, min(len(raw) - least + 1, 1 if first_only else len(raw)), SLICE):
        h = _hashes(raw[base : base + (least if first_only else SLICE + least - 1)], gram)
        yield np.unique(np.lib.stride_tricks.sliding_window_view(h, least - gram + 1).min(axis=1)).view(np.int64)


def _anchored(rows: DataFrame, keys: list[str], text: str, first_only: bool, tiers=TIERS, bits=None) -> DataFrame:
    """keys and anchor: of passages (first_only) the one of their tier, of texts those of all tiers that the bitmap has; an anchor may come once for each slice of a text."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    held = None if bits is None else rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = None if held is None else np.frombuffer(held.value, np.uint8)

        def ready(batch, at, found):
            places = pa.array(np.repeat(np.array(at, np.int64), [len(f) for f in found]))
            return pa.RecordBatch.from_arrays([*(batch.column(k).take(places) for k in keys), pa.array(np.concatenate(found))], [*keys, "anchor"])

        for batch in batches:
            at, found, size = [], [], 0
            for n, value in enumerate(batch.column(text)):
                raw = (value.as_py() or "").encode()
                for tier in [t for t in tiers if t[0] <= len(raw)][-1:] if first_only else tiers:
                    for some in anchors(raw, tier, first_only):
                        if known is not None:
                            place = some & (len(known) * 8 - 1)
                            some = some[(known[place >> 3] >> (place & 7) & 1).astype(bool)]
                        if len(some):
                            at, found, size = [*at, n], [*found, some], size + len(some)
                        if size >= ROWS or len(at) >= 1024:
                            yield ready(batch, at, found)
                            at, found, size = [], [], 0
            if found:
                yield ready(batch, at, found)

    return rows.select(*keys, text).mapInArrow(run, f"{kinds}, anchor bigint")


def _bitmap(anchored: DataFrame) -> bytes:
    """The anchors as bits at their last digits; some sixteen bits for each, MOST_BITS at most."""
    wanted, size = 16 * anchored.count(), BUCKET
    while size < min(wanted, MOST_BITS):
        size *= 2
    place = F.col("anchor").bitwiseAND(F.lit(size - 1))
    rows = anchored.select(F.shiftright(place, 15).alias("bucket"), place.bitwiseAND(F.lit(BUCKET - 1)).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = bytearray(size // 8)
    for r in rows.toLocalIterator():
        out[r["bucket"] * BUCKET // 8 : (r["bucket"] + 1) * BUCKET // 8] = r["bits"]
    return bytes(out)


def contained(texts: DataFrame, passages: DataFrame, text_id: str, passage_id: str, within: list[str] | None = None) -> DataFrame:
    """text_id, passage_id and the `within` columns for every text that holds a passage; both tables have their id, `text` and the `within` columns, which have to agree.

    Ids are unique; null texts hold nothing and are in nothing. Passages under LEAST bytes say too little and are in nothing. Texts equal to a passage hold it.
    """
    keys = within or []
    passages = passages.select(passage_id, *keys, F.col("text").alias("passage"))
    theirs = _anchored(passages, [passage_id, *keys], "passage", True)
    lengths = passages.agg(F.min(F.when(F.octet_length("passage") >= LEAST, F.octet_length("passage"))).alias("low"), F.max(F.octet_length("passage")).alias("high")).first()
    tiers = [t for t, then in zip(TIERS, [*(t[0] for t in TIERS[1:]), 1 << 62], strict=True) if lengths["low"] is not None and lengths["low"] < then and lengths["high"] >= t[0]]
    mine = _anchored(texts, [text_id, *keys], "text", False, tiers, _bitmap(theirs))
    met = mine.join(theirs, [*keys, "anchor"]).select(text_id, passage_id).distinct()
    pairs = met.join(passages, passage_id)
    return pairs.join(texts.select(text_id, "text"), text_id).where(F.contains("text", F.col("passage"))).select(text_id, passage_id, *keys)


def outermost(passages: DataFrame, passage_id: str, within: list[str]) -> DataFrame:
    """The passages that no other one of their `within` group holds; of equal ones the smallest id stays, and short ones stay."""
    inner = passages.select(F.col(passage_id).alias("_inner"), *within, "text")
    pairs = contained(passages, inner, passage_id, "_inner", within).where(F.col(passage_id) != F.col("_inner"))
    sizes = passages.select(passage_id, F.octet_length("text").alias("size"))
    told = pairs.join(sizes, passage_id).join(sizes.select(F.col(passage_id).alias("_inner"), F.col("size").alias("own")), "_inner")
    gone = told.where((F.col("size") > F.col("own")) | (F.col(passage_id) < F.col("_inner"))).select(F.col("_inner").alias(passage_id)).distinct()
    return passages.join(gone, passage_id, "left_anti")
