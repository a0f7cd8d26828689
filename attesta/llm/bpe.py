"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts longer than PIECE characters are cut before encoding, only where the split pattern must begin a new match anyway. No alternative of the pattern has white space after
another kind of character, none holds letters and digits, and none holds other characters beside either, but for an apostrophe before letters. So a text may be cut before
white space that follows anything else, and where letters, digits and other characters meet, but not behind an apostrophe. No look-ahead reaches over such a
place: the ids of the pieces, put in a row, are those of the whole text. Cut are only places between characters of ASCII and common Han and CJK punctuation, whose kinds no
version of Unicode changes. What has no such place is one run of letters or of white space, which the pattern matches as one: it is encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 16
#: Rows that a task holds encoded at a time.
ROWS = 128
RANKS = "byte_bpe_multi_50k.tiktoken"
_LETTER, _DIGIT, _OTHER = "A-Za-z\u4e00-\u9fff", "0-9", "!-/:-@\\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
_OPEN = _OTHER.replace("!-/", "!-&(-/")  #: the other characters without the apostrophe
_BREAK = re.compile(f"(?<=\\S)(?=[ \\t\\r\\n])|(?<=[{_LETTER}])(?=[{_DIGIT}{_OTHER}])|(?<=[{_DIGIT}])(?=[{_LETTER}{_OTHER}])|(?<=[{_OPEN}])(?=[{_LETTER}{_DIGIT}])")


@lru_cache(maxsize=2)
def encoding(path: str | None = None):
    """The tokenizer of a rank file, built once a process; path defaults to the public multilingual ranks."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """Cuts a text at the first safe place after every `limit` characters."""
    start = 0
    while len(text) - start > limit:
        found = _BREAK.search(text, start + limit)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode_text(enc, text: str | None, limit: int = PIECE) -> bytes:
    """Ids as little-endian unsigned 32-bit integers; null and empty texts have none."""
    return b"".join(enc.encode_to_numpy(p, disallowed_special=()).astype("<u4").tobytes() for p in pieces(text or "", limit) if p)


def decode_ids(enc, ids: bytes | None) -> bytes:
    """The bytes that the ids stand for, which need not be valid UTF-8."""
    import numpy as np

    return enc.decode_bytes(np.frombuffer(ids or b"", "<u4").tolist())


def _map_columns(df: DataFrame, steps: list[tuple], dropped: tuple[str, ...] = ()) -> DataFrame:
    """Adds a binary column for each of `steps` (source, target, function), a later one from earlier ones if it likes; the other columns but those `dropped` pass through untouched."""
    from pyspark.sql.types import BinaryType, StructType

    targets = [target for _, target, _ in steps]
    kept = [f for f in df.schema.fields if f.name not in (*targets, *dropped)]
    schema, keep = StructType(kept), [f.name for f in kept]
    for target in targets:
        schema = schema.add(target, BinaryType())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part, made = batch.slice(start, ROWS), {}
                for source, target, each in steps:
                    column = made[source] if source in made else part.column(source)
                    made[target] = pa.array((each(x.as_py()) for x in column), pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), *made.values()], [*keep, *made])
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", ranks_path: str | None = None) -> DataFrame:
    """Adds the ids of every whole text (little-endian u32); a column of that name is replaced. Null counts as empty."""
    return _map_columns(docs, [(text_col, ids_col, lambda text: encode_text(encoding(ranks_path), text))])


def decode(tokens: DataFrame, ids_col: str = "token_ids", bytes_col: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """Adds the raw bytes of every row's ids. Null ids decode to no bytes."""
    return _map_columns(tokens, [(ids_col, bytes_col, lambda ids: decode_ids(encoding(ranks_path), ids))])


def round_trip(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", bytes_col: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """Encodes every whole text and decodes its ids: the columns of encode() and decode() without the text. One pass, so that a task needs one Python process with one tokenizer."""
    there = (text_col, ids_col, lambda text: encode_text(encoding(ranks_path), text))
    back = (ids_col, bytes_col, lambda ids: decode_ids(encoding(ranks_path), ids))
    return _map_columns(docs, [there, back], (text_col,))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256. Null ids and repeated rows stay as they are."""
    coded = round_trip(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return coded.select(
        F.col("doc_id").alias(id_col),
        (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
