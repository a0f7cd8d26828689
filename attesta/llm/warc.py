"""WARC archives in seekable Zstandard bundles.

A bundle is one file. Records are grouped into frames of about FRAME bytes, each an independent Zstandard frame, so that any record
can be read by decompressing one frame. A skippable frame at the end holds the seek table (the public "Zstandard Seekable Format":
compressed and decompressed size of every frame, then a footer of 9 bytes), so a reader needs no outside index to find frames. The
write job also returns an index that maps every record identifier to (bundle, frame, offset in the frame, length).

Spark partitions the rows; a task writes bundles of bounded size, each under a name of its own that no other attempt of the task uses. The
index is committed by Spark with the tasks that count, and readers open only the bundles that it names: what a lost, repeated or speculative attempt
left behind is never read. Readers seek: they load the footer and one frame at a time, never a whole bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.anchors import MAX_SLOTS, bitmap, is_set
from attesta.llm.common import fresh_path, materialize

FRAME = 1 << 18
BUNDLE = 1 << 24
#: Fixed values of the Zstandard Seekable Format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id bigint, record_id string, bundle string, frame int, frame_offset bigint, length bigint"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload_intact boolean"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str = "") -> str:
    """A name that follows from the page alone, so repeated runs agree; from the payload's digest where the page has no id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'payload:{digest}' if page_id is None else f'page:{page_id}')}>"


def one_line(text: str | None) -> str:
    """Header values may not hold line breaks or other control characters."""
    return "".join(c if c >= " " and c != "\x7f" else " " for c in text or "").strip()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit carries no payload, but its length and digest stay in the header."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of the records in the bytes of a frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        yield head, block[block.index(b"\r\n\r\n") + 4 :]
        at = end + 4 + size + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *s) for s in sizes)
    footer = struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def frame_sizes(file) -> list[tuple[int, int]]:
    """Compressed and decompressed size of every frame of a bundle, a seekable file, from its footer."""
    end = file.seek(0, 2) and file.tell()
    file.seek(max(0, end - 9))
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("no seek table")
    file.seek(end - 9 - 8 * count)
    return list(struct.iter_unpack("<II", file.read(8 * count)))


def read_frames(file, frames: list[int] | None = None) -> Iterator[bytes]:
    """Some frames of a bundle, or all, in order, found through the seek table; one is held at a time."""
    import zstandard

    sizes, at = frame_sizes(file), 0
    wanted = None if frames is None else set(frames)
    for k, (packed, plain) in enumerate(sizes):
        if wanted is None or k in wanted:
            file.seek(at)
            yield zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=max(1, plain))
        at += packed


def _write_bundles(rows: Iterator[tuple], folder: str, frame_bytes: int, bundle_bytes: int) -> Iterator[tuple]:
    import pyarrow.fs as pafs
    import zstandard

    fs, base = pafs.FileSystem.from_uri(folder)
    squeeze = zstandard.ZstdCompressor(level=3)
    frames, sizes, buffer, index = [], [], bytearray(), []

    def close_frame():
        frames.append(squeeze.compress(bytes(buffer)))
        sizes.append((len(frames[-1]), len(buffer)))
        buffer.clear()

    def close_bundle():
        nonlocal frames, sizes, index
        if buffer:
            close_frame()
        if not frames:
            return
        name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            for f in frames:
                out.write(f)
            out.write(seek_table(sizes))
        yield from ((p, r, name, f, o, n) for p, r, f, o, n in index)
        frames, sizes, index = [], [], []

    for page_id, url, payload, digest, refers_to in rows:
        data = record(page_id, url, payload, digest, refers_to)
        index.append((page_id, record_id(page_id, digest), len(frames), len(buffer), len(data)))
        buffer += data
        if len(buffer) >= frame_bytes:
            close_frame()
            if sum(s for s, _ in sizes) >= bundle_bytes:
                yield from close_bundle()
    yield from close_bundle()


def _table(rows: list[tuple], ddl: str):
    import pyarrow as pa

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [c.split() for c in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _digested(pages: DataFrame, bits=None, there: bool = True) -> DataFrame:
    """page_id, url, payload, payload_digest and slot (a number made of the digest) of the pages whose slot is set in the bitmap, or is not; of all without one."""
    named = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    held = pages.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            html = [(x or "").encode() for x in batch.column("html").to_pylist()]
            digests = [hashlib.sha1(h).digest() for h in html]
            slots = np.array([int.from_bytes(d[:8], "little") >> 1 for d in digests], np.int64)
            names = [base64.b32encode(d).decode() for d in digests]
            whole = pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(html, pa.binary()), pa.array(names, pa.string()), pa.array(slots)], ["page_id", "url", "payload", "payload_digest", "slot"])
            yield whole if held.value is None else whole.filter(pa.array(is_set(held.value, slots) == there))

    return named.mapInArrow(run, "page_id bigint, url string, payload binary, payload_digest string, slot bigint")


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, and refers_to: the smallest page of the same payload, null on that page itself.

    The digests that several pages have are written before pages are joined to them, so both sides of that join are plain exchanges and a hot payload is split over
    tasks. Pages whose digest no other page has do not take part: a bitmap of the repeated ones, sized by their number, lets nearly none of them through.
    """
    told = _digested(pages).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"), F.any_value("slot").alias("anchor")).where("n > 1").drop("n")
    told = materialize(told, "repeated")
    n = told.count()
    bits = bitmap(told.select("anchor"), n) if n <= MAX_SLOTS // 2 else None
    later = F.coalesce(F.col("first_id") < F.col("page_id"), F.lit(True))  # a page without an id revisits the first that has one
    several = _digested(pages, bits).join(told.drop("anchor").hint("merge"), "payload_digest", "left")
    several = several.select("page_id", "url", "payload", "payload_digest", F.when(later, F.col("first_id")).alias("refers_to"))
    if bits is None:
        return several
    return several.unionByName(_digested(pages, bits, False).select("page_id", "url", "payload", "payload_digest", F.lit(None).cast("bigint").alias("refers_to")))


def write_archives(pages: DataFrame, folder: str, frame_bytes: int = FRAME, bundle_bytes: int = BUNDLE) -> DataFrame:
    """Writes bundles of the pages (page_id, url, html) to the folder, a URI that driver and executors share. Returns the index, written beside them.

    Null html is an empty payload; rows without a page_id are archived under a name made of their payload and nothing refers to them; of rows that repeat
    a page_id with the same payload all are responses or revisits alike, as their id says. Other columns are ignored. An empty table gives an empty index and no bundle.
    """

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "refers_to")), strict=True)

        out = []
        for row in _write_bundles(rows(), folder, frame_bytes, bundle_bytes):
            out.append(row)
            if len(out) >= 5000:
                yield _table(out, INDEX)
                out = []
        if out:
            yield _table(out, INDEX)

    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    with_digests(pages).mapInArrow(run, INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _read(bundles: DataFrame, folder: str) -> DataFrame:
    """The records (see RECORD) of rows (bundle, places): of the places (frame, frame_offset, length) of a bundle, or all where places is null."""

    def of(head, payload):
        digest, refers, page = head["WARC-Payload-Digest"].removeprefix("sha1:"), head.get("X-Refers-To-Page-ID"), head["X-Page-ID"]
        whole = head["WARC-Type"] == "revisit" or (payload_digest(payload) == digest and len(payload) == int(head["X-Payload-Length"]))
        return (int(page) if page else None, head["WARC-Target-URI"], int(head["X-Payload-Length"]), digest, head["WARC-Type"], refers and int(refers), whole)

    def run(batches):
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for bundle, places in zip(batch.column("bundle").to_pylist(), batch.column("places").to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{bundle}") as file:
                    frames = None if places is None else sorted({p["frame"] for p in places})
                    for k, data in enumerate(read_frames(file, frames)):
                        parts = [data] if places is None else [data[p["frame_offset"] : p["frame_offset"] + p["length"]] for p in places if p["frame"] == frames[k]]
                        yield _table([of(*r) for part in parts for r in records(part)], RECORD)

    n = bundles.select("bundle").distinct().count()
    return bundles.repartition(max(1, min(n, 1 << 14)), "bundle").mapInArrow(run, RECORD)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the bundles that the folder's index names, read back frame by frame through the seek tables (see RECORD for the columns)."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    return _read(index.select("bundle", F.lit(None).cast("array<struct<frame:int,frame_offset:bigint,length:bigint>>").alias("places")).distinct(), folder)


def lookup(spark: SparkSession, folder: str, page_ids: DataFrame) -> DataFrame:
    """Records of some pages (column page_id): only the frames that the index names are read and decompressed."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index").join(page_ids.select("page_id").distinct(), "page_id", "left_semi")
    return _read(index.groupBy("bundle").agg(F.collect_list(F.struct("frame", "frame_offset", "length")).alias("places")), folder)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_intact")
