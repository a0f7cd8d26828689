"""What a block of collocations holds in a task."""

import tracemalloc

import numpy as np
import pytest

from attesta.llm import collocations


def block(n, entries, seed):
    r = np.random.default_rng(seed)
    seq = r.integers(-1, entries, n).astype(np.int32)
    ids = np.append(np.where(r.random(entries) < 0.8, r.integers(0, 1 << 44, entries), -1), -1)
    return seq, ids, 1 << r.integers(0, 3, entries + 1)


@pytest.mark.parametrize("n, entries", [(2, 1), (50, 3), (5000, 40), (5000, 3000)])
def test_pairs_are_numbered_by_bucket_left_and_right(n, entries):
    seq, ids, parts = block(n, entries, n + entries)
    at, number, left, right, bucket = collocations.numbered(seq, ids, parts, 12)
    want = []
    for i in range(n - 1):
        a, b = int(seq[i]), int(seq[i + 1])
        if a >= 0 and b >= 0 and ids[a] >= 0 and ids[b] >= 0:
            salt = (int(ids[b]) ^ int(ids[b]) >> 22) % int(parts[a])
            want.append((i, (((int(ids[a]) ^ int(ids[a]) >> 22) + salt * 0x9E3779B1) % 12, a, b)))
    names = sorted({p for _, p in want})
    assert list(zip(bucket.tolist(), left.tolist(), right.tolist(), strict=True)) == names
    assert list(zip(at.tolist(), number.tolist(), strict=True)) == [(i, names.index(p)) for i, p in want]


def test_a_place_takes_few_bytes():
    seq, ids, parts = block(1 << 19, 2000, 1)
    raw = collocations.packed(seq)
    tracemalloc.start()
    try:
        collocations.numbered(collocations.unpacked(raw), ids, parts, 48)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 64 * len(seq)


def word_rows(batch, limit):
    """The rows of blocks (seq) and of words that a task makes of a batch."""
    from unittest import mock

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    with mock.patch("pyspark.TaskContext.get") as task:
        task.return_value.partitionId.return_value = 0
        return list(collocations._word_rows(Rows(), limit, 5)(iter([batch])))


def test_words_of_a_block_take_few_bytes():
    raw = np.frombuffer(b"some words, and more of them. " * 40_000, np.uint8)
    begins = np.zeros(len(raw), bool)
    begins[::3000] = True
    collocations.words_of(raw[:100], begins[:100])
    tracemalloc.start()
    try:
        words, new, after = collocations.words_of(raw, begins)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(words) == 240_000 and after and new.sum() == 80_000
    assert most < 12 * len(raw)


def test_words_are_not_carried_into_a_document_that_begins_with_blanks():
    """Its first slice holds no word, so nothing of it may be joined with the block before, which is another document's."""
    import pyarrow as pa

    batch = pa.record_batch({"lang": pa.array(["en", "en"]), "raw": pa.array([b"one two three four five six", b" " * 90 + b"seven eight"])})
    seqs = [(r["carry"], collocations.unpacked(r["seq"]).tolist()) for part in word_rows(batch, 40) for r in part.to_pylist() if r["seq"] is not None]
    assert sum(1 for _, seq in seqs for x in seq if x >= 0) == 8
    assert [carry for carry, _ in seqs][0] <= 1 and all(carry <= 1 for carry, _ in seqs)


def test_blocks_do_not_depend_on_how_texts_are_copied():
    sizes = np.array([10, 25, 5, 100, 3, 0, 0, 37, 1])
    assert list(collocations.runs(sizes, 40)) == [(0, 3), (3, 4), (4, 8), (8, 9)]
