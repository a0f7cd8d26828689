import io

import pytest

from attesta.llm import warc


@pytest.fixture(scope="module")
def pages():
    return [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2\r\nX: y", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 5000), (6, "u", "x\r\n\r\nWARC/1.1\r\n"), (0, "u", "<p>one</p>")]


def want(pages):
    first = {}
    for k, _, h in sorted(pages):
        first.setdefault(h or "", k)
    return {k: (len((h or "").encode()), warc.payload_digest((h or "").encode()), "response" if first[h or ""] == k else "revisit", None if first[h or ""] == k else first[h or ""]) for k, _, h in pages}


@pytest.mark.parametrize(("frame", "bundle"), [(1, 1), (700, 2000), (1 << 18, 1 << 24)])
def test_round_trip(spark, tmp_path, pages, frame, bundle):
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("payload", __import__("pyspark").sql.functions.lit("clash"))
    index = warc.write_archives(df, f"file://{tmp_path}/w", frame, bundle)
    got = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want(pages)
    assert len(got) == len(pages) == index.count() and all(r["payload_intact"] for r in got)
    some = spark.createDataFrame([(2,), (5,), (99,)], "page_id bigint")
    assert sorted(r["page_id"] for r in warc.lookup(spark, f"file://{tmp_path}/w", some).collect()) == [2, 5]


def test_frames_are_independent_and_bundles_plain_zstandard(spark, tmp_path, pages):
    import zstandard

    rows = [(k, u, (h or "").encode(), warc.payload_digest((h or "").encode()), None) for k, u, h in pages]
    index = list(warc._write_bundles(iter(rows), f"file://{tmp_path}", 100, 1 << 20))
    data = (tmp_path / index[0][2]).read_bytes()
    assert len(warc.frame_sizes(io.BytesIO(data))) > 2
    for page, rid, _, frame, offset, length in index:
        (head, payload), *_ = warc.records(next(warc.read_frames(io.BytesIO(data), [frame]))[offset : offset + length])
        assert head["WARC-Record-ID"] == rid and payload == dict((r[0], r[2]) for r in rows)[page]
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).readall() for _ in range(1))
    assert whole.count(b"WARC/1.1\r\nWARC-Type") == len(pages)


def test_leftovers_of_other_attempts_are_not_read(spark, tmp_path, pages):
    """A bundle that no committed task wrote, whole or torn, changes nothing."""
    folder = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(pages, "page_id bigint, url string, html string"), folder)
    list(warc._write_bundles(iter([(1, "u", b"stale", warc.payload_digest(b"stale"), None)]), folder, 100, 100))
    (tmp_path / "w" / "bundle-torn.warc.zst").write_bytes(b"torn")
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == len(pages) and {r["page_id"]: r["payload_digest"] for r in got} == {k: v[1] for k, v in want(pages).items()}


def test_empty_and_nameless(spark, tmp_path):
    df = spark.createDataFrame([(None, "u", "x"), (None, "v", "y"), (4, "u", "y")], "page_id bigint, url string, html string")
    assert warc.write_archives(df, f"file://{tmp_path}/n").count() == 3
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, f"file://{tmp_path}/n").collect())
    assert got == [(0, "response", None), (0, "revisit", 4), (4, "response", None)]
    assert warc.write_archives(df.limit(0), f"file://{tmp_path}/e").count() == 0
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0


def test_hot_payloads_are_joined_as_plain_exchanges(spark, tmp_path, pages):
    """Both sides of the join on the digest are exchanges, so adaptive execution can split a hot one; pages whose payload is alone take no part."""
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    plan = warc.with_digests(df)._jdf.queryExecution().executedPlan().toString()
    lines = [x.strip(" +-:*(0123456789)") for x in plan.splitlines()]
    at = next(i for i, x in enumerate(lines) if x.startswith("SortMergeJoin"))
    below = [x.split()[0] for x in lines[at + 1 :] if x and not x.startswith("Union")]
    assert below[:2] == ["Sort", "Exchange"] and "HashAggregate" not in below
    got = {r["page_id"]: r["refers_to"] for r in warc.with_digests(df).collect()}
    assert got == {k: w[3] for k, w in want(pages).items()}


def test_repeated_and_nameless_pages(spark, tmp_path):
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "v", "same"), (None, "w", "same"), (None, "w", "alone"), (3, "x", "other"), (3, "x", "third")]
    got = warc.read_archives(spark, (warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"), f"file://{tmp_path}/w") and None) or f"file://{tmp_path}/w").collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in got) == [(0, "response", 0), (0, "revisit", 1), (1, "response", 0), (1, "response", 0), (2, "revisit", 1), (3, "response", 0), (3, "response", 0)]


def test_exact_join_beyond_the_bitmap(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "MAX_SLOTS", 0)
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    assert {r["page_id"]: r["refers_to"] for r in warc.with_digests(df).collect()} == {k: w[3] for k, w in want(pages).items()}
