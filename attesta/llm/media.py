"""Cropped or edited copies of images by local descriptors.

An image is a binary PGM (P5) column. Corners (Harris response, all local maxima that stand out) are found on every level of a pyramid whose levels
shrink by the root of two; each gets an orientation from the intensity centroid of its patch and a descriptor of 256 binary tests turned by it.

A descriptor is cut into TABLES parts of 256 / TABLES bits. Of two descriptors within DISTANCE bits one part differs in one bit at most, as
DISTANCE < 2 TABLES; so tables of the queries' parts and all their neighbours at one bit, joined by equality with the parts of the base, find every
such pair. Such a part lies in a quarter that differs in DISTANCE / 4 bits at most, and that in a half that differs in DISTANCE / 2, so most of what the
tables offer is let go by one word; the full Hamming distance is checked before a pair leaves the join. Tests that tell much the same are dealt to
different parts, so few descriptors share one. The stated queries meet all rows in blocks of BLOCK distinct descriptors: a task describes CHUNK corners of
the base, holds them, sorted by part, against one block after the other, and gives only what it found; the base's descriptors are neither written nor
shuffled. Distinct descriptors are joined, not corners. A pair of images is a copy if enough descriptor pairs agree on one similarity transform (scale,
rotation, shift), found by votes over the transform that each pair proposes, in bins that overlap.

Equal images are one class: classes are described and joined once, so groups of identical images are never expanded into pairs.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import discard, materialize

LEVEL = math.sqrt(2)
BORDER = 13
#: Corners below this share of the strongest response of their level do not stand out.
STANDS_OUT = 0.003
TABLES = 8
DISTANCE = 2 * TABLES - 1
INLIERS = 4
TURNS = 90
#: Distinct descriptors of queries that meet the base at a time: tables of 264 keys each in a task.
BLOCK = 1 << 15
#: Blocks that go to the tasks in one broadcast, of 32 bytes a descriptor; with more of them the base is passed again.
BLOCKS = 16
#: Corners of the base that a task holds, looks at together, and pairs that it checks together.
CHUNK, SLICE, PAIRS = 1 << 19, 1 << 16, 1 << 20
#: Images described together; more of them leave the processor's cache.
STACK = 8
DESCRIPTOR = "x float, y float, scale float, angle float, d0 bigint, d1 bigint, d2 bigint, d3 bigint"


def pgm(pixels) -> bytes:
    """The P5 file of a two-dimensional array of bytes."""
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def pixels_of(image: bytes | None):
    """The pixels of a P5 file with 8 bits a pixel; None for null and for what is no such file."""
    import numpy as np

    try:
        head, body = image.split(b"\n", 1)
        magic, width, height, top = head.split()
        if magic != b"P5" or top != b"255":
            return None
        return np.frombuffer(body, np.uint8).reshape(int(height), int(width))
    except (AttributeError, ValueError):
        return None


def _dealt(a, b, reach: float = 4.0):
    """An order of tests between the points a and b in which tests that tell much the same, where what lies within `reach` is alike, are in different parts."""
    import numpy as np

    like = lambda p, q: np.exp(-((p[:, None] - q) ** 2).sum(2) / (2 * reach * reach))
    same = like(a, a) + like(b, b) - like(a, b) - like(b, a)
    same = same**2 / np.maximum(1e-9, np.outer(same.diagonal(), same.diagonal()))
    left, parts = list(range(len(a))), [[] for _ in range(TABLES)]
    while left:
        for part in parts:
            part.append(left.pop(int(np.argmin(same[np.ix_(left, part)].sum(1)))))
    return np.concatenate(parts)


@lru_cache(maxsize=1)
def _patterns():
    """The offsets of the 256 tests, turned by TURNS steps, and of the disc for the centroid."""
    import numpy as np

    rng = np.random.default_rng(20240)
    tests = np.clip(rng.normal(0, 4.2, (512, 2)), -9, 9)
    order = _dealt(tests[:256], tests[256:])
    tests = np.concatenate([tests[:256][order], tests[256:][order]])
    turned = []
    for step in range(TURNS):
        a = 2 * math.pi * step / TURNS
        turned.append(np.rint(tests @ np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]])).astype(np.int64))
    y, x = np.mgrid[-8:9, -8:9]
    inside = x * x + y * y <= 64
    return np.stack(turned), np.stack([x[inside], y[inside]], 1)


def _shrunk(stack, factor: float):
    """Bilinear resampling of a stack of images (n, h, w)."""
    import numpy as np

    h, w = int(stack.shape[1] / factor), int(stack.shape[2] / factor)
    y, x = np.linspace(0, stack.shape[1] - 1, h, dtype=np.float32), np.linspace(0, stack.shape[2] - 1, w, dtype=np.float32)
    y0, x0 = np.minimum(y.astype(int), stack.shape[1] - 2), np.minimum(x.astype(int), stack.shape[2] - 2)
    fy, fx = (y - y0)[None, :, None], (x - x0)[None, None, :]
    top = stack[:, y0][:, :, x0] * (1 - fx) + stack[:, y0][:, :, x0 + 1] * fx
    low = stack[:, y0 + 1][:, :, x0] * (1 - fx) + stack[:, y0 + 1][:, :, x0 + 1] * fx
    return top * (1 - fy) + low * fy


def _box(stack, r: int):
    """Mean over a square of 2r + 1 pixels, edges repeated."""
    import numpy as np

    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        total = np.cumsum(np.pad(stack, pad, mode="edge"), axis=axis, dtype=np.float32)
        n = total.shape[axis]
        stack = (np.take(total, range(2 * r + 1, n), axis) - np.take(total, range(n - 2 * r - 1), axis)) / np.float32(2 * r + 1)
    return stack


def describe(stack):
    """Descriptors of a stack of images of one size (n, h, w): image number, x, y, scale, angle, and the tests as four 64-bit integers."""
    import numpy as np

    turned, disc = _patterns()
    parts, scale, level = [], 1.0, stack.astype(np.float32)
    while min(stack.shape[1:]) / scale > 2 * BORDER + 2:
        if scale > 1:
            level = _shrunk(_box(stack.astype(np.float32), 1 if scale < 3 else 2), scale)
        n, h, w = level.shape
        smooth = _box(level, 1)
        softer = _box(smooth, 1)
        gy, gx = np.zeros_like(smooth), np.zeros_like(smooth)
        gy[:, 1:-1] = smooth[:, 2:] - smooth[:, :-2]
        gx[:, :, 1:-1] = smooth[:, :, 2:] - smooth[:, :, :-2]
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = (a * b - c * c - 0.05 * (a + b) ** 2)[:, BORDER:-BORDER, BORDER:-BORDER]
        peak = r[:, 1:-1, 1:-1].copy()
        for dy in range(3):
            for dx in range(3):
                if (dy, dx) != (1, 1):
                    near = r[:, dy : dy + peak.shape[1], dx : dx + peak.shape[2]]
                    beaten = near > r[:, 1:-1, 1:-1] if (dy, dx) > (1, 1) else near >= r[:, 1:-1, 1:-1]
                    peak[beaten] = 0
        image, y, x = np.nonzero(peak > np.maximum(10.0, STANDS_OUT * peak.max((1, 2), keepdims=True)))
        y, x = y + BORDER + 1, x + BORDER + 1
        around = level[image[:, None], y[:, None] + disc[:, 1], x[:, None] + disc[:, 0]]
        around = around - around.min(1, keepdims=True)
        angle = np.arctan2((around * disc[:, 1]).sum(1), (around * disc[:, 0]).sum(1))
        offsets = turned[np.rint(angle / (2 * math.pi / TURNS)).astype(int) % TURNS]
        values = softer[image[:, None], y[:, None] + np.clip(offsets[:, :, 1], -BORDER, BORDER), x[:, None] + np.clip(offsets[:, :, 0], -BORDER, BORDER)]
        bits = np.packbits(values[:, :256] < values[:, 256:], axis=1).view(">i8").astype(np.int64)
        parts.append((image, (x * scale).astype(np.float32), (y * scale).astype(np.float32), np.full(len(x), scale, np.float32), angle.astype(np.float32), bits))
        scale *= LEVEL
    if not parts:
        empty = np.empty(0, np.float32)
        return np.empty(0, np.int64), empty, empty, empty, empty, np.empty((0, 4), np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def parts_of(bits, count: int = TABLES):
    """(count, n): the first parts of descriptors (n, 4)."""
    import numpy as np

    width, per = 256 // TABLES, TABLES // 4
    return np.stack([((bits[:, t // per].view(np.uint64) << np.uint64(t % per * width)) >> np.uint64(64 - width)).astype(np.uint32) for t in range(count)])


def probes(part):
    """(n * (width + 1)): for each value of a part itself and all values that differ from it in one bit."""
    import numpy as np

    flips = np.concatenate([[0], 1 << np.arange(256 // TABLES, dtype=np.int64)]).astype(np.uint32)
    return (part[:, None] ^ flips).ravel()


def _described(batches):
    """Batches of corners of batches of images (class_id, image)."""
    import numpy as np
    import pyarrow as pa

    names = ["class_id", "x", "y", "scale", "angle", *BITS]
    for batch in batches:
        for start in range(0, batch.num_rows, STACK):
            part = batch.slice(start, STACK)
            by_shape: dict[tuple, list] = {}
            for key, image in zip(part.column("class_id").to_pylist(), part.column("image").to_pylist(), strict=True):
                p = pixels_of(image)
                if p is not None:
                    by_shape.setdefault(p.shape, []).append((key, p))
            for group in by_shape.values():
                n, x, y, s, a, bits = describe(np.stack([p for _, p in group]))
                ids = np.array([k for k, _ in group], np.int64)[n]
                yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in (ids, x, y, s, a)), *(pa.array(np.ascontiguousarray(bits[:, j])) for j in range(4))], names)


def _chunks(batches, rows: int):
    """The batches put together to some `rows` rows."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def descriptors(images: DataFrame) -> DataFrame:
    """One row per corner of the images (class_id, image); images that cannot be read or have no corner give none."""
    return images.select("class_id", "image").mapInArrow(lambda batches: _chunks(_described(batches), 1 << 12), f"class_id bigint, {DESCRIPTOR}")


BITS = ("d0", "d1", "d2", "d3")


LOW = (1 << 32) - 1


class Tables:
    """The Hamming tables of some descriptors (n, 4), fewer than 2 ** 32: for each part the sorted probes, each above the row that it is of."""

    def __init__(self, bits):
        import numpy as np

        self.bits = bits
        row = np.repeat(np.arange(len(bits), dtype=np.uint64), 256 // TABLES + 1)
        self.near = [np.sort(probes(part).astype(np.uint64) << np.uint64(32) | row) for part in parts_of(bits)]

    def within(self, bits, distance: int):
        """(row of bits, row of the tables) of all pairs within the distance, at most DISTANCE, each once; some PAIRS candidates are held at a time."""
        import numpy as np

        low, rows = np.uint64(LOW), np.arange(len(bits), dtype=np.uint64)
        for t, (part, near) in enumerate(zip(parts_of(bits), self.near, strict=True)):
            ordered = np.sort(part.astype(np.uint64) << np.uint64(32) | rows)  # searches in order stay in the cache
            first, last = np.searchsorted(near, ordered & ~low, "left"), np.searchsorted(near, ordered | low, "right")
            some = np.flatnonzero(last > first)
            mine, first, n = (ordered[some] & low).astype(np.int64), first[some], (last - first)[some]
            ends, i = np.cumsum(n), 0
            while i < len(n):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
                k = n[i:j]
                at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[i:j], k)
                yield self._checked(t, bits, np.repeat(mine[i:j], k), (near[at] & low).astype(np.int64), distance)
                i = j

    def _checked(self, t: int, bits, mine, theirs, distance: int):
        """Those of the candidates of a table that are within the distance and that no table before it offers."""
        import numpy as np

        per = TABLES // 4
        apart = np.bitwise_count((bits[mine, t // per] ^ self.bits[theirs, t // per]).view(np.uint64))
        mine, theirs = mine[apart <= distance // 4], theirs[apart <= distance // 4]
        differ = bits[mine] ^ self.bits[theirs]
        words = np.bitwise_count(differ.view(np.uint64))
        halves = words[:, ::2] + words[:, 1::2]
        offered = np.bitwise_count(parts_of(differ[:, : t // per + 1], t + 1)).T <= 1
        tables = np.arange(t + 1)
        offered &= (words[:, tables // per] <= distance // 4) & (halves[:, tables // (2 * per)] <= distance // 2)
        chosen = (words.sum(1) <= distance) & (offered.argmax(1) == t) & offered[:, t]
        return mine[chosen], theirs[chosen]


def _searched(rows: DataFrame, schema, asked: DataFrame, distance: int, block: int, name: str, corners=None) -> DataFrame:
    """The corners of rows, or those that `corners` makes of their batches, with q_d0 ... q_d3, once for each distinct descriptor of asked within `distance` bits.

    schema: the fields of the corners as (name, type) pairs, BITS among them.
    """
    spark = rows.sparkSession
    kept = [c for c, _ in schema if c not in BITS]
    found_schema = ", ".join([*(f"{c} {kind}" for c, kind in schema if c in kept), *(f"q_{c} bigint" for c in BITS)])
    distinct = asked.select(*BITS).distinct()
    passes = max(1, math.ceil(distinct.count() / (block * BLOCKS)))
    dealt = materialize(distinct.withColumn("pass", F.pmod(F.xxhash64(*BITS), F.lit(passes))), "asked")
    out = None
    for k in range(passes):
        held = spark.sparkContext.broadcast(_bits(dealt.where(F.col("pass") == k).select(*BITS).toArrow()))  # some block * BLOCKS rows of four numbers

        def run(batches, held=held):
            import numpy as np
            import pyarrow as pa

            tables, at = None, None
            for chunk in _chunks(corners(batches) if corners else batches, CHUNK):
                bits = _bits(chunk)
                for start in range(0, len(held.value), block):
                    if at != start:
                        tables = None  # one block's tables at a time
                        tables, at = Tables(held.value[start : start + block]), start
                    for i in range(0, len(bits), SLICE):
                        for mine, theirs in tables.within(bits[i : i + SLICE], distance):
                            chosen = pa.array(mine + i)
                            yield pa.RecordBatch.from_arrays([*(chunk.column(c).take(chosen) for c in kept), *(pa.array(np.ascontiguousarray(tables.bits[theirs, j])) for j in range(4))], [*kept, *(f"q_{c}" for c in BITS)])

        found = materialize(rows.mapInArrow(run, found_schema), name)
        out = found if out is None else out.unionByName(found)
    discard(dealt)
    return out


def matches(described: DataFrame, asked: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """The rows of described with q_d0 ... q_d3, once for each distinct descriptor of asked within `distance` bits, at most DISTANCE."""
    return _searched(described, [(f.name, f.dataType.simpleString()) for f in described.schema.fields], asked, distance, block, "matches")


def _bits(rows):
    import numpy as np

    return np.ascontiguousarray(np.stack([np.asarray(rows.column(c)) for c in BITS], 1)) if rows.num_rows else np.empty((0, 4), np.int64)


def _agreed(placed: DataFrame, inliers: int) -> DataFrame:
    """(query_class, class_id, inliers): the most corners of a pair of images that share a cell of one of the eight grids, for pairs with `inliers` at least.

    placed: query_class, class_id, x, y (a corner of the base image), and its places zoom, spin0, spin1, tx0, tx1, ty0, ty1; a grid takes one of each two. Rows
    are sorted by images and corners and counted in one pass, which holds one corner's rows and the cells of one pair of images.
    """
    order = ["query_class", "class_id", "x", "y"]
    columns = [*order, "zoom", "spin0", "spin1", "tx0", "tx1", "ty0", "ty1"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def new(m):
            """Whether a row of a sorted array differs from the one before."""
            return np.concatenate([np.ones(min(1, len(m)), bool), (m[1:] != m[:-1]).any(1)])

        def ordered(m):
            return m[np.lexsort(m.T[::-1])]

        def added(cells):
            """One row for each cell, with the sum of the last column."""
            cells = ordered(cells)
            first = np.flatnonzero(new(cells[:, :-1]))
            return np.column_stack([cells[first, :-1], np.add.reduceat(cells[:, -1], first)])

        def counted(m):
            """(query_class, class_id, zoom, grid, spin, tx, ty, n) of whole corners."""
            votes = np.concatenate([np.column_stack([m[:, :5], np.full(len(m), grid), m[:, 5 + (grid >> 2)], m[:, 7 + (grid >> 1 & 1)], m[:, 9 + (grid & 1)]]) for grid in range(8)])
            votes = ordered(votes)
            votes = votes[new(votes)]
            return added(np.column_stack([votes[:, [0, 1, 4, 5, 6, 7, 8]], np.ones(len(votes), np.int64)]))

        def best(cells):
            first = np.flatnonzero(new(cells[:, :2]))
            most = np.maximum.reduceat(cells[:, -1], first)
            chosen = most >= inliers
            return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(cells[first[chosen], i])) for i in range(2)), pa.array(most[chosen])], ["query_class", "class_id", "inliers"])

        held, cells = np.empty((0, len(columns)), np.int64), np.empty((0, 8), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.concatenate([held, np.column_stack([np.asarray(batch.column(c)).astype(np.int64) for c in columns])])
            corner = np.flatnonzero(new(m[:, :4]))[-1]  # the last corner may go on in the next batch
            held, m = m[corner:], m[:corner]
            if not len(m):
                continue
            cells = added(np.concatenate([cells, counted(m)]))
            pair = np.flatnonzero(new(cells[:, :2]))[-1]
            if pair:
                yield best(cells[:pair])
            cells = cells[pair:]
        if len(held):
            yield best(added(np.concatenate([cells, counted(held)])))

    return placed.repartition("query_class", "class_id").sortWithinPartitions(*order).select(*columns).mapInArrow(run, "query_class bigint, class_id bigint, inliers bigint")


def copies(queries: DataFrame, base: DataFrame, distance: int = DISTANCE, inliers: int = INLIERS) -> DataFrame:
    """Pairs (query_class, class_id, inliers) of images (class_id, image) of which the query is a cropped or edited copy of the base image.

    Both sides hold one row per class. Every pair with `inliers` agreeing corners whose descriptors are within `distance` bits is found. The transform of a pair
    of images has a scale of any power of the root of two (others as far as descriptors bear them) and any rotation.
    """
    q = materialize(descriptors(queries), "query_descriptors")
    near = _searched(base.select("class_id", "image"), [c.split() for c in f"class_id bigint, {DESCRIPTOR}".split(", ")], q, distance, BLOCK, "matches", _described)
    named = q.select(F.col("class_id").alias("query_class"), *(F.col(c).alias(f"q_{c}") for c in ("x", "y", "scale", "angle", *BITS)))
    pairs = near.join(named, [f"q_{c}" for c in BITS])
    turn = F.col("q_angle") - F.col("angle")
    ratio = F.col("q_scale") / F.col("scale")
    moved_x = F.col("q_x") - ratio * (F.cos(turn) * F.col("x") - F.sin(turn) * F.col("y"))
    moved_y = F.col("q_y") - ratio * (F.sin(turn) * F.col("x") + F.cos(turn) * F.col("y"))
    twelfth = turn / (math.pi / 6)
    placed = pairs.select(
        "query_class", "class_id", F.round("x").cast("int").alias("x"), F.round("y").cast("int").alias("y"), F.rint(F.log2(ratio) * 2).cast("int").alias("zoom"),
        *(F.pmod(F.floor(twelfth + i / 2), F.lit(12)).cast("int").alias(f"spin{i}") for i in range(2)),
        *(F.floor((moved + 8 * i) / 16).cast("int").alias(f"{name}{i}") for name, moved in (("tx", moved_x), ("ty", moved_y)) for i in range(2)),
    )
    found = materialize(_agreed(placed, inliers), "copies")
    discard(q)
    return found


def classes(images: DataFrame, id_col: str) -> DataFrame:
    """(id, class_id, class_size): images of equal bytes are one class, named after its smallest id. Null images are one class without copies."""
    keyed = images.select(F.col(id_col).cast("bigint").alias(id_col), F.sha2("image", 256).alias("digest")).where(F.col(id_col).isNotNull())
    named = materialize(keyed.groupBy("digest").agg(F.min(id_col).alias("class_id"), F.count("*").alias("class_size")), "classes")
    return keyed.join(named, F.coalesce(keyed.digest, F.lit("")) == F.coalesce(named.digest, F.lit(""))).select(id_col, "class_id", "class_size")


def render(vector, size: int = 96) -> bytes | None:
    """A picture of a vector: its values are the weights of waves of all pairs of frequencies along both sides. Stands in for a media column in the test tables."""
    import numpy as np

    v = np.nan_to_num(np.asarray(vector if vector is not None else [], np.float32))
    side = int(math.isqrt(len(v)))
    if side < 2:
        return None
    wave = 1.0 + np.arange(side)[:, None]
    basis = np.cos(2 * math.pi * (wave * np.arange(size) / size + wave * (math.sqrt(5) - 1) / 2)).astype(np.float32)
    picture = basis.T @ v[: side * side].reshape(side, side) @ basis
    scale = float(np.abs(picture).max()) or 1.0
    return pgm(np.clip(128 + 110 * picture / scale, 0, 255).astype(np.uint8))


def edited(image: bytes | None, seed: int) -> bytes | None:
    """A crop to three quarters at a place that follows from the seed, darker and with less contrast."""
    import numpy as np

    p = pixels_of(image)
    if p is None:
        return None
    h, w = (3 * p.shape[0]) // 4, (3 * p.shape[1]) // 4
    y, x = seed * 7 % (p.shape[0] - h + 1), seed * 13 % (p.shape[1] - w + 1)
    return pgm((p[y : y + h, x : x + w].astype(np.float32) * 0.8 + 10).astype(np.uint8))


def _pictures(vectors: DataFrame, change: bool) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("vec_id").to_pylist()
            images = [render(v) for v in batch.column("embedding").to_pylist()]
            if change:
                images = [edited(x, k // 100) for x, k in zip(images, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(images, pa.binary())], ["vec_id", "image"])

    return vectors.mapInArrow(run, "vec_id bigint, image binary")


def op4_image_copies(spark, sf_dir: str) -> DataFrame:
    """The rows of embeddings rendered as images are the base. Queries are cropped, darkened copies of every row whose id is divisible by 100.

    One row per row: vec_id, class_id (smallest id of equal images), class_size, is_query, n_matches, matches (class ids, in order, of
    the images that the query was found to be a copy of; empty for rows that are no query). Images are made where they are read, not stored. Rows that
    repeat a vec_id stand for the first of their images; null vectors are one class without corners; rows without a vec_id are left out.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").where("vec_id is not null")
    asked_of = vectors.where("vec_id % 100 = 0")
    member = materialize(classes(_pictures(vectors, False), "vec_id"), "members")
    asked_class = materialize(classes(_pictures(asked_of, True), "vec_id"), "asked_members")

    def one(rows: DataFrame, ids: DataFrame, change: bool) -> DataFrame:
        first = rows.join(ids.where("vec_id = class_id").select("vec_id").distinct(), "vec_id").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        first = first.repartition(2 * spark.sparkContext.defaultParallelism, F.xxhash64("vec_id"))  # vectors are small and their pictures are work: even shares, whatever their bytes
        return _pictures(first, change).withColumnRenamed("vec_id", "class_id")

    found = copies(one(asked_of, asked_class, True), one(vectors, member, False))
    lists = found.groupBy("query_class").agg(F.array_sort(F.collect_set("class_id")).alias("matches"))
    of_query = asked_class.select("vec_id", F.col("class_id").alias("query_class")).distinct().join(lists, "query_class", "left").groupBy("vec_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("matches", F.array().cast("array<bigint>")))))).alias("matches"), F.lit(True).alias("q"))
    return member.join(of_query, "vec_id", "left").select(
        "vec_id", "class_id", "class_size", F.coalesce("q", F.lit(False)).alias("is_query"),
        F.coalesce(F.size("matches"), F.lit(0)).alias("n_matches"), F.coalesce("matches", F.array().cast("array<bigint>")).alias("matches"),
    )
