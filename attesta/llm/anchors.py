"""Shared windows of words by difference-cover anchors.

COVER is a difference cover of PERIOD: any two positions can be shifted by the same number below PERIOD so that both fall on a position which, modulo
PERIOD, lies in COVER. Two equal windows therefore share an anchor, the window - PERIOD + 1 words that start at such a position, at the same
place of either, whatever their alignment; only three of seven positions are hashed and compared.

1. Anchors of each document are grouped by a hash of their words; those in two documents or more are shared. A bitmap of the shared hashes, sized by their
   number, keeps the others from being shuffled again; with more than MAX_SLOTS allows, an exact join does it.
2. A shared anchor extends by PERIOD - 1 words to either side, to its context: all windows that hold it at that place. Equal contexts are one group, and
   the windows of all its members but those of its smallest document are repeats as they stand.
3. What is left are the first documents of contexts whose anchor has other contexts as well, which is at the edges of a match: their windows are
   grouped each by itself, and those of a larger document than the group's smallest are repeats.

Groups are aggregated before they are shuffled, and joined with both sides written, so a passage in a third of all documents is split over tasks. Words are
compared by hashes: 64 bits of a word, and then 64 of an anchor beside 64 of its context, or 128 of a window, so two different windows count as equal with a
probability of the order of 1e-19 for each pair of words with unlike texts. The text itself is never cut for a comparison.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import discard, materialize

WINDOW = 13
PERIOD = 7
COVER = (1, 2, 4)
#: Bytes that are hashed together.
SLICE = 1 << 20
#: Rows that a task holds cut at a time.
ROWS = 1024
#: Slots of the bitmap for each hash in it, and the most slots it may have (32 MB).
SLOTS_EACH = 16
MAX_SLOTS = 1 << 28
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xC2B2AE3D27D4EB4F
_SIZE = 0xD6E8FEB86659FD93


@lru_cache(maxsize=4)
def _powers(n: int):
    """The powers of the base from 0 to n, and those of its inverse."""
    import numpy as np

    one = np.ones(1, np.uint64)
    return [np.concatenate([one, np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]


def mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(raw, bounds):
    """(hash of every word, words of each document) of the bytes `raw` of documents that begin at `bounds`, whose last entry is the end.

    Words are cut at ASCII white space and at documents. Slices are hashed one after the other; a word that reaches over several is put together.
    """
    import numpy as np

    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    powers, inverse = _powers(SLICE)
    begins = np.zeros(len(raw) + 1, bool)
    begins[bounds] = True
    sums, sizes, starts, open_ = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], False
    for base in range(0, len(raw), SLICE):
        b = raw[base : base + SLICE]
        inside, begin = ~space[b], begins[base + 1 : base + len(b)]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | begin
        last[:-1] &= ~inside[1:] | begin
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers[: len(b)], out=total[1:])
        poly, size = (total[stop] - total[start]) * inverse[start], stop - start
        if open_ and inside[0] and not begins[base]:
            k = next(k for k in range(len(sums) - 1, -1, -1) if len(sums[k]))
            sums[k][-1:] += poly[:1] * np.uint64(pow(_BASE, int(sizes[k][-1]), 1 << 64))
            sizes[k][-1] += size[0]
            poly, size, start = poly[1:], size[1:], start[1:]
        sums.append(poly), sizes.append(size), starts.append(start + base)
        open_ = inside[-1]
    h = mixed(np.concatenate(sums) + np.concatenate(sizes).astype(np.uint64) * np.uint64(_SIZE))
    return h, np.diff(np.searchsorted(np.concatenate(starts), bounds))


def rolling(h, width: int):
    """The sums of `width` hashes from each on, each times a power of its place."""
    import numpy as np

    n, out, at, span, block = len(h) - width + 1, None, 0, 1, h
    while width >> (span.bit_length() - 1):
        if width & span:
            part = block[at : at + n] * np.uint64(pow(_STEP, at, 1 << 64))
            out, at = part if out is None else out + part, at + span
        block = block[:-span] + block[span:] * np.uint64(pow(_STEP, span, 1 << 64))
        span *= 2
    return out


def documents(batch):
    """(first row, raw bytes, bounds) of runs of documents of SLICE bytes or one document."""
    import numpy as np
    import pyarrow as pa

    raw = batch.column("raw").cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(raw):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + SLICE, "right")) - 1)
        yield row, data[ends[row] : ends[last]], ends[row : last + 1] - ends[row]
        row = last


def _anchors(raw, bounds, window: int):
    """(anchor, context, document, place) of the cover positions of documents of a window or more."""
    import numpy as np

    h, counts = word_hashes(raw, bounds)
    gap = window - 1
    doc = np.repeat(np.arange(len(counts)), counts)
    apart = np.zeros(len(h) + gap * (len(counts) + 1), np.uint64)
    apart[np.arange(len(h)) + gap * (doc + 1)] = h
    place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    width = window - PERIOD + 1
    room = counts[doc]
    cover = np.flatnonzero(np.isin(place % PERIOD, COVER) & (place <= room - width) & (room >= window))
    at = cover + gap * (doc[cover] + 1)
    anchor = mixed(rolling(apart, width)[at]) if len(at) else apart[:0]
    if len(at):
        wide = rolling(np.concatenate([apart, np.zeros(gap, np.uint64)]), window)
        context = mixed(wide[at - PERIOD + 1] * np.uint64(_SIZE) + wide[at])
    else:
        context = apart[:0]
    return anchor.view(np.int64), context.view(np.int64), doc[cover], place[cover]


def _record(columns: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def anchor_hashes(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(anchor, doc) of the anchors at cover positions."""

    def run(batches):
        import numpy as np

        for batch in batches:
            docs = np.asarray(batch.column("doc"))
            for row, raw, bounds in documents(batch):
                anchor, _, doc, _ = _anchors(raw, bounds, window)
                yield _record({"anchor": anchor, "doc": docs[row + doc]})

    return texts.mapInArrow(run, "anchor bigint, doc bigint")


def bitmap(shared: DataFrame, n: int):
    """A bitmap in which the n hashes of `shared` (anchor) are set, by their lower bits."""
    import numpy as np

    slots = max(1 << 10, min(MAX_SLOTS, 1 << (SLOTS_EACH * n).bit_length()))
    slot = F.col("anchor").bitwiseAND(F.lit(slots - 1).cast("bigint"))
    words = shared.select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63).cast("bigint")).cast("int").alias("bit")).groupBy("word")
    rows = words.agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    bits = np.zeros(slots // 64, np.uint64)
    bits[np.asarray(rows.column("word"))] = np.asarray(rows.column("bits")).view(np.uint64)
    return bits


def is_set(bits, hashes):
    """Whether hashes are set in a bitmap."""
    import numpy as np

    slot = hashes & (len(bits) * 64 - 1)
    return (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


def _places(texts: DataFrame, bits, window: int) -> DataFrame:
    """(anchor, context, doc, th, pos) of the anchors in the bitmap, or of all without one."""
    held = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        import numpy as np

        for batch in batches:
            docs, ths, bits = np.asarray(batch.column("doc")), np.asarray(batch.column("th")), held.value
            for row, raw, bounds in documents(batch):
                anchor, context, doc, pos = _anchors(raw, bounds, window)
                if bits is not None:
                    there = is_set(bits, anchor)
                    anchor, context, doc, pos = anchor[there], context[there], doc[there], pos[there]
                yield _record({"anchor": anchor, "context": context, "doc": docs[row + doc], "th": ths[row + doc], "pos": pos})

    return texts.mapInArrow(run, "anchor bigint, context bigint, doc bigint, th bigint, pos bigint")


def _edge_windows(rows: DataFrame, window: int) -> DataFrame:
    """(one, two, doc, th, start): two hashes of every window that holds one of the anchors in rows (doc, th, raw, spots), each window once."""

    def run(batches):
        import numpy as np

        for batch in batches:
            spots = batch.column("spots").to_pylist()
            docs, ths = np.asarray(batch.column("doc")), np.asarray(batch.column("th"))
            for row, raw, bounds in documents(batch):
                h, counts = word_hashes(raw, bounds)
                first = np.cumsum(counts) - counts
                starts = []
                for k, n in enumerate(counts.tolist()):
                    at = np.unique((np.array(spots[row + k])[:, None] - np.arange(PERIOD)).ravel())
                    starts.append(at[(at >= 0) & (at <= n - window)])
                doc, start = np.repeat(np.arange(len(counts)), [len(s) for s in starts]), np.concatenate(starts)
                if len(start):
                    at = first[doc] + start
                    other = mixed(h ^ np.uint64(_SIZE))
                    one, two = (mixed(rolling(x, window)[at]).view(np.int64) for x in (h, other))
                    yield _record({"one": one, "two": two, "doc": docs[row + doc], "th": ths[row + doc], "start": start})

    return rows.mapInArrow(run, "one bigint, two bigint, doc bigint, th bigint, start bigint")


def repeated(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, th, anchors, starts): places of anchors of which all windows are repeats, and starts of repeated windows, of the documents that have any.

    texts: doc, th (a hash of the text that tells rows of one doc apart), raw.
    """
    shared = anchor_hashes(texts, window).groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("anchor")
    shared = materialize(shared, "shared")
    n = shared.count()
    if n <= MAX_SLOTS // 2:
        places = materialize(_places(texts, bitmap(shared, n), window), "places")
    else:
        places = materialize(_places(texts, None, window).join(shared.hint("merge"), "anchor", "left_semi"), "places")
    groups = materialize(places.groupBy("anchor", "context").agg(F.min("doc").alias("low"), F.max("doc").alias("high")), "contexts")
    edges = groups.groupBy("anchor").agg(F.min("low").alias("least"), F.max("low").alias("most")).where("least < most")
    edges = materialize(edges.select("anchor", F.lit(True).alias("edge")), "edges")
    told = groups.join(edges.hint("merge"), "anchor", "left").select("anchor", "context", "low", F.coalesce("edge", F.lit(False)).alias("edge"), (F.col("low") < F.col("high")).alias("again"))
    told = materialize(told.where("again or edge").drop("again"), "told")
    discard(shared, groups, edges)
    spots = places.join(told.hint("merge"), ["anchor", "context"]).where("doc > low or edge").select("doc", "th", "pos", (F.col("doc") > F.col("low")).alias("whole"))
    spots = materialize(spots, "spots")
    discard(places, told)
    rest = spots.where("not whole").groupBy("doc", "th").agg(F.collect_list("pos").alias("spots"))
    windows = materialize(_edge_windows(texts.join(rest, ["doc", "th"]).select("doc", "th", "raw", "spots"), window), "windows")
    least = windows.groupBy("one", "two").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("one", "two", "low")
    least = materialize(least, "least")
    single = windows.join(least.hint("merge"), ["one", "two"]).where("doc > low").select("doc", "th", F.lit(None).cast("bigint").alias("anchor"), "start")
    found = spots.where("whole").select("doc", "th", F.col("pos").alias("anchor"), F.lit(None).cast("bigint").alias("start")).unionByName(single)
    found = materialize(found.groupBy("doc", "th").agg(F.collect_set("anchor").alias("anchors"), F.collect_set("start").alias("starts")), "repeated")
    discard(spots, windows, least)
    return found


def _kept(rows: DataFrame, window: int) -> DataFrame:
    """(doc, kept, runs, n_words) of rows (doc, raw, anchors, starts)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        runs_of = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            kept, runs, size = [], [], []
            for raw, anchors, starts in zip(*(batch.column(c).to_pylist() for c in ("raw", "anchors", "starts")), strict=True):
                words = raw.split()
                n = len(words)
                size.append(n)
                if not anchors and not starts:
                    kept.append(b" ".join(words))
                    runs.append([])
                    continue
                depth = np.zeros(n + 1, np.int64)
                for at, before, after in ((anchors, PERIOD - 1, window), (starts, 0, window)):
                    at = np.array(at or [], np.int64)
                    np.add.at(depth, np.maximum(0, at - before), 1)
                    np.add.at(depth, np.minimum(n, at + after), -1)
                gone = np.cumsum(depth[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).view(np.int8))).tolist()
                runs.append([{"start": a, "stop": b} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                kept.append(b" ".join(w for a, b in zip([0, *edge[1::2]], [*edge[::2], n], strict=True) for w in words[a:b]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(runs, runs_of), pa.array(size, pa.int64())], ["doc", "kept", "runs", "n_words"])

    return rows.mapInArrow(run, "doc bigint, kept string, runs array<struct<start:bigint,stop:bigint>>, n_words bigint")


def remove_shared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: id, kept (the words that stay, joined by one space), runs (start and stop of the runs of removed words), n_words.

    A word is removed if it lies in a window of `window` words (PERIOD at least) that also starts in a document with a smaller id. Null and
    empty texts have no words, and shorter texts than a window lose none. Rows without an id are left whole and are no source; rows that repeat an id are one document,
    judged against smaller ids alone, each by its own text. An empty table gives no rows; other columns are not read.
    """
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw")).withColumn("th", F.xxhash64("raw"))
    found = repeated(rows.where("doc is not null"), window)
    return _kept(rows.join(found.hint("merge"), ["doc", "th"], "left").select("doc", "raw", "anchors", "starts"), window).withColumnRenamed("doc", id_col)


def op11_anchor_dedup(spark, sf_dir: str) -> DataFrame:
    done = remove_shared(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, r: a + (r["stop"] - r["start"]))
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents),
starts as (select doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) as s from d),
windows as (select doc_id, s, list_slice(words, s, s + 12) as w from starts),
least as (select w, min(doc_id) as low from windows group by w having min(doc_id) < max(doc_id)),
hits as (select distinct doc_id, unnest(range(s, s + 13)) as spot from windows join least using (w) where doc_id > low),
gone as (select doc_id, list(spot) as places from hits group by doc_id),
kept as (
    select doc_id, len(words) as n_words, coalesce(len(places), 0) as n_removed,
        array_to_string(list_filter(words, lambda w, i: not list_contains(coalesce(places, []), i)), ' ') as kept
    from d left join gone using (doc_id)
)
select doc_id, n_words, n_removed, sha256(kept) as kept_sha256 from kept
"""
