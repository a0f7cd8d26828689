"""Phrase collocations by hierarchical pair naming.

Phrases of k words are named level by level. A frequent word has a global id; where two ids of frequent phrases of k - 1 words stand at adjacent places, the pair of
them is a phrase of k words (the two overlap in k - 2), and pairs that are frequent get ids in turn. Every part of a frequent phrase is frequent, so
no phrase is missed, and what is rare at a level never becomes a row of the next.

Texts are cut into blocks of words. A block keeps its words as numbers of its own dictionary and gives one row for each distinct entry, with its count, so the
counts are summed before they are shuffled. One shuffle brings the blocks' rows of an entry together, which sums them and names the entry after its first
place; the rows of frequent entries go back to their blocks, which replace them by their ids and write the next level's pairs. Pairs travel in one row for
each block and bucket of first parts, and those of a very frequent first part are dealt by the second as well. A block holds bounded text, and a hot pair is in each block once.

An id's pair doubles as its parent pointers: first is the phrase without its last word, second the one without its first. The counts of all heads and tails
that a cut needs come down these pointers with one join a level each, and a phrase inside a longer one of nearly its count is found by the pointers of the longer
one: counts only fall as phrases grow, so if any longer phrase covers it, one that is a word longer does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import discard, materialize

MOST_WORDS = 5
LEAST_COUNT = 100
TOP = 2000
COVER_PERCENT = 100
UNKNOWN = "und"
#: Bytes of text in a block; a longer text becomes several, cut between words.
BLOCK = 1 << 22
SEPARATORS = b".,;:!?\n\v\f\r"
BLANKS = b" \t"

WORD_ROWS = "block bigint, carry int, seq binary, idx int, lang string, word string, n bigint"
BLOCKS = "block bigint, carry int, seq binary"
PAIR_ROWS = "block bigint, idx int, bucket int, firsts array<bigint>, seconds array<bigint>, counts array<int>"
#: Bits of a place for the number of a block in its task, and for that of an entry in its block.
BLOCK_BITS, ENTRY_BITS = 20, 22
#: Buckets of pairs for each shuffle partition.
BUCKETS_EACH = 4
#: Occurrences of a phrase beyond which its pairs are dealt into twice as many parts, and four times those, and so on.
HOT = 1 << 16


def _tables():
    import numpy as np

    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    separator, blank = np.zeros(256, bool), np.zeros(256, bool)
    separator[list(SEPARATORS)], blank[list(BLANKS)] = True, True
    return lower, separator, separator | blank


def runs(sizes, limit: int):
    """(first, last) of the runs of documents of these sizes in bytes: as many as do not pass the limit together, or one."""
    import numpy as np

    bounds, k = np.concatenate([[0], np.cumsum(sizes)]), 0
    while k < len(sizes):
        last = max(k + 1, int(np.searchsorted(bounds, bounds[k] + limit, "right")) - 1)
        yield k, last
        k = last


def slices(raw, bounds, limit: int):
    """(start, stop, goes on) of the blocks of bytes of documents that begin at `bounds`: runs of whole documents, or parts of one that are cut between words."""
    import numpy as np

    outside, k = _tables()[2], 0
    while k < len(bounds) - 1:
        last = max(k + 1, int(np.searchsorted(bounds, bounds[k] + limit, "right")) - 1)
        start, stop = int(bounds[k]), int(bounds[last])
        goes_on = False
        while stop - start > limit:
            cut = start + limit
            while cut < stop and not (there := outside[raw[cut : cut + limit]]).any():
                cut += limit
            if cut >= stop:
                break
            cut += int(there.argmax())
            yield start, cut, goes_on
            start, goes_on = cut, True
        yield start, stop, goes_on
        k = last


def words_of(raw, begins):
    """(words as an Arrow array, whether a piece begins before each word, whether one ends after the last) of lower-cased bytes; documents begin where `begins` is set."""
    import numpy as np
    import pyarrow as pa

    lower, separator, outside = _tables()
    raw = lower[raw]
    inside = ~outside[raw]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1] | begins[1:]
    start = np.flatnonzero(edge)
    edge = inside.copy()
    edge[:-1] &= ~inside[1:] | begins[1:]
    stop = np.flatnonzero(edge) + 1
    parts = separator[raw]  # where a piece ends, by a separator or a beginning of a document
    parts |= begins
    parts = np.flatnonzero(parts)
    letters = raw[inside]
    del raw, inside, edge
    ends = np.zeros(len(start) + 1, np.int32)
    np.cumsum(stop - start, out=ends[1:])
    words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    passed = np.searchsorted(parts, start, "right")  # a word may itself be at the beginning of a document
    new = passed != np.concatenate([[0], passed[:-1]])
    return words, new, bool(len(start) and len(parts) > passed[-1])


def packed(seq) -> bytes:
    """Numbers from -1 on, as bytes in the order of their value, so that those of small numbers lie together and are compressed away."""
    import numpy as np

    return (seq + 1).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(raw: bytes):
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel() - np.int32(1)


def numbered(seq, ids, parts, buckets: int):
    """The pairs of adjacent places of seq whose entries both have ids: (places, number of the pair at each, and by number its left and right entry and its bucket).

    Pairs are numbered by bucket, left and right. Buckets are of distinct pairs, and what has a row a place is held as briefly and as narrow as may be: tasks run it side by side.
    """
    import numpy as np

    width, frequent = np.int64(len(ids)), (ids >= 0)[seq]
    at = np.flatnonzero(frequent[:-1] & frequent[1:]).astype(np.int32)
    del frequent
    pair = seq[at].astype(np.int64)
    pair *= width
    pair += seq[at + 1]
    order = np.argsort(pair).astype(np.int32)
    pair = pair[order]
    new = np.ones(len(pair), bool)
    np.not_equal(pair[1:], pair[:-1], out=new[1:])
    pair = pair[new]
    number = np.empty(len(at), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    del order, new
    left, right = pair // width, pair % width
    salt = (ids[right] ^ ids[right] >> ENTRY_BITS) % parts[left]
    bucket = ((ids[left] ^ ids[left] >> ENTRY_BITS) + salt * 0x9E3779B1) % buckets
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return at, place[number], left[order], right[order], bucket[order]


def _word_rows(docs: DataFrame, limit: int, most_words: int) -> DataFrame:
    """WORD_ROWS of documents (lang, raw): a row with carry and seq for each block, and a row for each word in it."""

    def block_rows(block, carry, words, places, lang):
        import numpy as np
        import pyarrow as pa

        coded = words.dictionary_encode()
        numbers = coded.indices.to_numpy(zero_copy_only=False)
        seq = np.full(int(places[-1]) + 1, -1, np.int32)
        seq[places] = numbers
        counts = np.bincount(numbers[places >= carry], minlength=len(coded.dictionary))
        names = WORD_ROWS.replace(",", "").split()[::2]
        one, many = [block], np.full(len(counts), block)
        none = lambda n, kind: pa.nulls(n, kind)
        yield pa.RecordBatch.from_arrays([pa.array(one), pa.array([carry], pa.int32()), pa.array([packed(seq)], pa.binary()), none(1, pa.int32()), none(1, pa.string()), none(1, pa.string()), none(1, pa.int64())], names)
        n = len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(many), none(n, pa.int32()), none(n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array([lang]).take(pa.array(np.zeros(n, np.int32))), coded.dictionary, pa.array(counts)], names)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << BLOCK_BITS
        for batch in batches:
            texts = batch.column("raw")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            for lang in pc.unique(batch.column("lang")).to_pylist():
                of = np.flatnonzero(pc.equal(batch.column("lang"), lang).to_numpy(zero_copy_only=False))
                for first, last in runs(sizes[of], limit):  # a batch is many blocks: only the texts of one are copied
                    bounds = np.concatenate([[0], np.cumsum(sizes[of[first:last]])])
                    chosen = texts.take(pa.array(of[first:last]))
                    raw = np.frombuffer(chosen.buffers()[2] or b"", np.uint8)[: bounds[-1]]
                    begins = np.zeros(len(raw) + 1, bool)
                    begins[bounds] = True
                    held, gaps, broken = None, None, False
                    for start, stop, goes_on in slices(raw, bounds, limit):
                        words, new, after = words_of(raw[start:stop], begins[start:stop])
                        if not len(words):
                            broken |= bool(_tables()[1][raw[start:stop]].any())
                            continue
                        if goes_on and held is not None:
                            new[0] |= broken
                            words, new, carry = pa.concat_arrays([held, words]), np.concatenate([gaps, new]), len(held)
                        else:
                            carry = 0
                        places = np.arange(len(words)) + np.cumsum(new)
                        yield from block_rows(block, int(places[carry]), words, places, lang)
                        block += 1
                        held, gaps, broken = words[-(most_words - 1) :] if most_words > 1 else None, new[-(most_words - 1) :], after
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, WORD_ROWS)


def _next(blocks: DataFrame, named: DataFrame, k: int, pairs: bool) -> DataFrame:
    """From the blocks of the level below and the frequent phrases there (of, idx, id, f): the pairs of k words (PAIR_ROWS), or the blocks with their numbers (BLOCKS).

    Pairs are numbered by bucket, first and second part, so those of a row have numbers from idx on. The numbers follow from a block and its frequent
    phrases alone, so the two kinds agree, and pairs need not be written: they go straight to the shuffle that sums them.
    """
    buckets = BUCKETS_EACH * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(key, blocks, names):
        import numpy as np
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        names_of = (PAIR_ROWS if pairs else BLOCKS).replace(",", "").split()[::2]
        kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 2, pa.list_(pa.int32())] if pairs else [pa.int64(), pa.int32(), pa.binary()]
        table = lambda columns: pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names_of)
        empty = table([[] for _ in kinds])
        if not blocks.num_rows or not names.num_rows:
            return empty
        block, carry, seq = key[0].as_py(), blocks.column("carry")[0].as_py(), unpacked(blocks.column("seq")[0].as_py())
        width = int(seq.max()) + 2
        ids, parts = np.full(width, -1, np.int64), np.ones(width, np.int64)  # the last stays for places without a phrase
        entry = names.column("idx").to_numpy()
        ids[entry] = names.column("id").to_numpy()
        parts[entry] = 1 << np.ceil(np.log2(np.maximum(1, names.column("f").to_numpy() / HOT))).astype(np.int64)
        at, number, left, right, bucket = numbered(seq, ids, parts, buckets)
        if not len(at):
            return empty
        if not pairs:
            now = np.full(len(seq) - 1, -1, np.int32)
            now[at] = number
            return table([[block], [carry], [packed(now)]])
        counts = np.bincount(number[at >= carry - k + 1], minlength=len(bucket)).astype(np.int32)
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = pa.array(np.append(start, len(bucket)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids[left], ids[right], counts)]
        return table([np.full(len(start), block), start, bucket[start], *lists])

    return blocks.groupBy("block").cogroup(named.groupBy("of")).applyInArrow(run, PAIR_ROWS if pairs else BLOCKS)


def _place() -> Column:
    """A number for a row's block and entry together, which no other row has."""
    return F.shiftleft("block", ENTRY_BITS).bitwiseOR(F.col("idx").cast("bigint"))


def _named(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The rows (block, idx, keys, n) of entries that occur `least` times or more, as written: of (the block), idx, place, keys, f (occurrences) and id (the entry's first place)."""
    same = Window.partitionBy(*keys)
    found = rows.withColumn("place", _place()).withColumns({"f": F.sum("n").over(same), "id": F.min("place").over(same)}).where(F.col("f") >= least)
    return materialize(found.select(F.col("block").alias("of"), "idx", "place", *keys, "f", "id"), "named")


def _pairs(rows: DataFrame) -> DataFrame:
    """PAIR_ROWS as one row a pair: block, idx, bucket, first, second, n."""
    dealt = rows.select("block", F.col("idx").alias("start"), "bucket", "firsts", "seconds", "counts").repartition("bucket")
    each = dealt.select("block", "start", "bucket", F.posexplode(F.arrays_zip("firsts", "seconds", "counts")).alias("at", "p"))
    return each.select("block", (F.col("start") + F.col("at")).alias("idx"), "bucket", F.col("p.firsts").alias("first"), F.col("p.seconds").alias("second"), F.col("p.counts").cast("bigint").alias("n"))


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = MOST_WORDS, least: int = LEAST_COUNT, block: int = BLOCK) -> list[DataFrame]:
    """Per length the frequent phrases: id, first, second (ids of the length below), f, lang, total (words of the lang), phrase, last, heads, tails (counts)."""
    source = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    words = materialize(_word_rows(source, block, most_words), "words")
    entries = words.where("idx is not null").select("block", "idx", "lang", "word", "n")
    totals = materialize(entries.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    named = _named(entries, ["lang", "word"], least)
    blocks = materialize(words.where("seq is not null").select("block", "carry", "seq"), "blocks")
    discard(words)
    none, link = F.array().cast("array<bigint>"), F.lit(None).cast("bigint")
    level = named.where("place = id").join(totals, "lang")
    level = level.select("id", link.alias("first"), link.alias("second"), "f", "lang", "total", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("heads"), none.alias("tails"))
    levels = [materialize(level, "phrases")]
    for k in range(2, most_words + 1):
        below_ids = named.select("of", "idx", "id", "f")
        fresh = materialize(_next(blocks, below_ids, k, False), "blocks") if k < most_words else None
        now = _named(_pairs(_next(blocks, below_ids, k, True)), ["bucket", "first", "second"], least)
        discard(blocks, named)
        blocks, named = fresh, now
        below = levels[-1]
        left = below.select(F.col("id").alias("first"), "lang", "total", F.col("phrase").alias("head"), F.array_append("heads", F.col("f")).alias("heads"))
        right = below.select(F.col("id").alias("second"), "last", F.array_append("tails", F.col("f")).alias("tails"))
        level = named.where("place = id").select("id", "first", "second", "f").join(left, "first").join(right, "second")
        levels.append(materialize(level.select("id", "first", "second", "f", "lang", "total", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "heads", "tails"), "phrases"))
    discard(blocks, named, totals)
    return levels


#: Of the cuts after the first 1, 2, ... words the lowest floor(1000 a n / (l r)), ties to the earliest; decimals of 38 digits hold the products.
_CUTS = """
array_min(transform(heads, (l, i) -> struct(
    (cast(1000 as decimal(4,0)) * cast(f as decimal(20,0)) * cast(total as decimal(20,0))) div (cast(l as decimal(19,0)) * cast(tails[size(heads) - 1 - i] as decimal(19,0))) as score,
    i as cut, l as l, tails[size(heads) - 1 - i] as r)))
"""


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = MOST_WORDS, least: int = LEAST_COUNT, top: int = TOP, cover_percent: int = COVER_PERCENT, block: int = BLOCK) -> DataFrame:
    """Each language's first `top` phrases of 2 to most_words words: lang, rank, phrase, a, l, r, n, score.

    A phrase goes if a phrase a word longer, or more, holds it and has cover_percent of its occurrences. Null languages are `und`; null and empty texts
    have no words; repeated rows count as often as they stand, ties are in the order of the phrase's bytes. A table without frequent phrases gives no rows. Other
    columns are not read.
    """
    levels = phrases(docs, text_col, lang_col, most_words, least, block)
    kept = []
    for at, level in enumerate(levels[1:], 1):
        if at + 1 < len(levels):
            longer = levels[at + 1]
            covers = longer.select(F.col("first").alias("id"), "f").unionByName(longer.select(F.col("second").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("cover"))
            level = level.join(covers, "id", "left").where(F.coalesce(F.col("cover") * 100 < F.col("f") * cover_percent, F.lit(True)))
        kept.append(level.select("lang", "phrase", "f", "total", F.expr(_CUTS).alias("best")))
    rated = kept[0]
    for other in kept[1:]:
        rated = rated.unionByName(other)
    rated = materialize(rated.select("lang", "phrase", F.col("f").alias("a"), F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("total").alias("n"), F.col("best.score").alias("score")), "rated")
    discard(*levels)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = rated.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
with recursive pieces as (
    select coalesce(lang, 'und') as lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
),
split as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as words from pieces),
totals as (select lang, sum(len(words))::bigint as n from split group by lang),
spots as (select lang, words, unnest(range(1, len(words) + 1)) as s from split),
grams as (select lang, words[s : s + k - 1] as p from spots, (select unnest(range(1, 6)) as k) where s + k - 1 <= len(words)),
f as (select lang, p, count(*) as a from grams group by lang, p having count(*) >= 100),
cuts as (
    select f.lang, f.p, f.a, h.a as l, t.a as r, n, k, (1000::hugeint * f.a * n) // (h.a::hugeint * t.a) as score
    from f join totals using (lang), lateral (select unnest(range(1, len(f.p))) as k)
    join f h on h.lang = f.lang and h.p = f.p[1 : k] join f t on t.lang = f.lang and t.p = f.p[k + 1 :]
),
best as (select * from cuts qualify row_number() over (partition by lang, p order by score, k) = 1),
inner_parts as (
    select distinct lang, p[s : e] as p, a from f, lateral (select unnest(range(1, len(p) + 1)) as s), lateral (select unnest(range(s + 1, len(p) + 1)) as e)
    where e - s + 1 < len(p)
),
covered as (select distinct b.lang, b.p from best b join inner_parts i on i.lang = b.lang and i.p = b.p where 100 * i.a >= 100 * b.a),
rated as (select lang, array_to_string(p, ' ') as phrase, a, l, r, n, score from best anti join covered using (lang, p)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from rated)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked where rank <= 2000
"""
