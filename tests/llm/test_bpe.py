import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import bpe


def test_digests_equal_the_library(docs, rows, empty):
    enc = bpe.encoding()
    got = {r["doc_id"]: r for r in bpe.digests(docs).collect()}
    for k, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.digests(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab '\n\t.é中 　1s|<，tn\x1c\x85-_5"), max_size=60), st.integers(1, 9))
def test_pieces_do_not_change_the_ids(text, limit):
    enc = bpe.encoding()
    assert "".join(bpe.pieces(text, limit)) == text
    assert bpe.encode_text(enc, text, limit) == b"".join(i.to_bytes(4, "little") for i in enc.encode_ordinary(text))
    assert bpe.decode_ids(enc, bpe.encode_text(enc, text, limit)) == text.encode()


@pytest.mark.parametrize("text", ["<|endoftext|> x", "a" * 200_000, " " * 5000, None])
def test_odd_texts(text):
    enc = bpe.encoding()
    assert bpe.decode_ids(enc, bpe.encode_text(enc, text, 100)) == (text or "").encode()


@pytest.mark.parametrize("text", ["漢字仮" * 20 + "，" , "line of text\n", "a1", "x='y';", "word, ", "1.5e3\t"])
def test_long_texts_of_every_kind_are_cut(text):
    """Texts without a plain space between words are cut as well, into pieces of about the limit, and keep their ids."""
    whole = text * (300_000 // len(text))
    parts = list(bpe.pieces(whole))
    assert "".join(parts) == whole and max(map(len, parts)) <= bpe.PIECE + 100
    enc, some = bpe.encoding(), text * 400
    assert bpe.encode_text(enc, some, 50) == b"".join(i.to_bytes(4, "little") for i in enc.encode_ordinary(some))


def test_repeated_and_null_ids(spark):
    got = bpe.digests(spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "d"), (None, None)], "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 0), (0, 1), (1, 1), (1, 2), (1, 2)]


def test_a_task_needs_one_python_process_for_both_directions(spark, docs):
    coded = bpe.round_trip(docs)
    assert coded._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert bpe.digests(docs)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    two = bpe.decode(bpe.encode(docs).drop("text"))
    assert coded.columns == two.columns and sorted(coded.collect(), key=str) == sorted(two.collect(), key=str)
