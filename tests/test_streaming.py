"""Streams over files give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from attesta.operators import admission as batch
from attesta.streaming import admission as stream


def drained(spark, frame, path, sink=None):
    writer = frame.writeStream.option("checkpointLocation", f"{path}/ckpt").trigger(availableNow=True)
    if sink:
        writer.foreachBatch(sink).start().awaitTermination(120)
        return None
    name = "t" + str(abs(hash(path)))
    q = writer.format("memory").queryName(name).outputMode("append").start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{path}/in")
    return spark.readStream.schema(schema).json(f"{path}/in").withColumn("ts", F.timestamp_seconds("s"))


def test_admission_equals_batch(spark, tmp_path):
    schema = "scope string, subject string, request_id bigint, s bigint"
    rows = [("g", f"u{i % 3}", i, 86400 + 10 * i) for i in range(40)]
    live = stream.admitted(source(spark, rows, schema, tmp_path).withWatermark("ts", "1 hour"), 2, 120)
    got = {(r["request_id"], r["accepted"]) for r in drained(spark, live, tmp_path).collect()}
    frame = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s"))
    assert got == {(r["request_id"], r["accepted"]) for r in batch.admitted(frame, 2, 120, ["scope", "subject"]).collect()}


def test_collections(spark, tmp_path):
    schema = "analysis_id string, step string, digest string, s bigint"
    rows = [("a", "begin", "x", 100), ("a", "finish", "y", 130), ("a", "finish", "y", 131), ("a", "finish", "z", 132), ("b", "begin", "x", 100), ("b", "finish", "y", 161)]
    live = stream.collections(source(spark, rows, schema, tmp_path).withWatermark("ts", "10 seconds"))
    got = sorted((r["analysis_id"], r["outcome"]) for r in drained(spark, live, tmp_path).collect())
    assert got == [("a", "CONFLICT"), ("a", "FINISHED"), ("a", "REPLAY"), ("b", "LATE"), ("b", "TIMEOUT")]


@pytest.mark.parametrize("again", [False, True])
def test_sinks_replace_a_repeated_batch(spark, tmp_path, again):
    frame = spark.createDataFrame([(1, None), (2, "bad")], "k int, error string")
    for _ in range(1 + again):
        stream.split_dead_letters(f"{tmp_path}/ok", f"{tmp_path}/dead")(frame, 7)
        stream.idempotent_sink(f"{tmp_path}/all")(frame, 7)
    assert [r["k"] for r in spark.read.parquet(f"{tmp_path}/ok").collect()] == [1]
    assert [r["k"] for r in spark.read.parquet(f"{tmp_path}/dead").collect()] == [2]
    assert spark.read.parquet(f"{tmp_path}/all").count() == 2


LISTS = "analysis_id string, label string, runs array<struct<kind:string>>, findings array<struct<finding_key:string,severity:string>>, evidence array<struct<evidence_id:string>>"


def results(spark, *keys, label="LOW"):
    return spark.createDataFrame([(k, label, [("SUPPLIER",), ("REVIEW",)], [("f1", "HIGH")] if k != "c" else None, []) for k in keys], LISTS)


def test_fan_out_inserts_once_and_tells_conflicts(spark, tmp_path):
    from attesta.streaming import fanout

    path = f"file://{tmp_path}/out"
    write = fanout.fan_out(path, "analysis_id", ["runs", "findings", "evidence"])
    table = lambda name: sorted(tuple(r) for r in fanout.read(spark, path, name).drop("digest").collect())
    write(results(spark, "a", "b"), 0)
    before = table("head"), table("runs"), table("findings")
    assert before == ([("a", "LOW", 0), ("b", "LOW", 0)], sorted((k, i, kind, 0) for k in "ab" for i, kind in enumerate(("SUPPLIER", "REVIEW"))), [("a", 0, "f1", "HIGH", 0), ("b", 0, "f1", "HIGH", 0)])
    write(results(spark, "a", "b"), 0)
    assert (table("head"), table("runs"), table("findings")) == before and fanout.read(spark, path, "conflicts").count() == 0
    write(results(spark, "a", "b", label="HIGH").unionByName(results(spark, "z")), 0)
    assert (table("head"), table("runs"), table("findings")) == before
    assert sorted((r["analysis_id"], r["reason"]) for r in fanout.read(spark, path, "conflicts").collect()) == [("a", "STORED_DIFFERS"), ("b", "STORED_DIFFERS"), ("z", "NOT_STORED")]
    write(results(spark, "a", "c").unionByName(results(spark, "b", label="HIGH")).unionByName(results(spark, "d")).unionByName(results(spark, "d", label="X")), 1)
    assert [(k, b) for k, _, b in table("head")] == [("a", 0), ("b", 0), ("c", 1)] and [r for r in table("runs") if r[0] == "d"] == []
    assert sorted((r["analysis_id"], r["reason"]) for r in fanout.read(spark, path, "conflicts").where("batch = 1").collect()) == [("b", "STORED_DIFFERS"), ("d", "REPEATED_KEY")]


def test_readers_see_whole_batches_only(spark, tmp_path):
    from attesta.streaming import fanout

    path = f"file://{tmp_path}/out"
    fanout.fan_out(path, "analysis_id", ["runs"])(results(spark, "a").select("analysis_id", "runs"), 0)
    results(spark, "b").selectExpr("analysis_id", "0 as ordinal", "'SUPPLIER' as kind").write.parquet(f"{path}/runs/batch=7")
    assert {r["analysis_id"] for r in fanout.read(spark, path, "runs").collect()} == {"a"}


def test_fan_out_over_a_stream_that_starts_again(spark, tmp_path):
    from attesta.streaming import fanout

    path = f"file://{tmp_path}/out"
    results(spark, "a", "b").coalesce(1).write.json(f"{tmp_path}/in")
    for state in ("one", "two"):  # the second query has lost its checkpoint and sends everything again
        live = spark.readStream.schema(LISTS).json(f"{tmp_path}/in")
        live.writeStream.foreachBatch(fanout.fan_out(path, "analysis_id", ["runs", "findings", "evidence"])).option("checkpointLocation", f"{tmp_path}/{state}").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["analysis_id"] for r in fanout.read(spark, path, "head").collect()) == ["a", "b"] and fanout.read(spark, path, "runs").count() == 4


def test_orders_are_fanned_out_with_whole_lines(spark, tmp_path, monkeypatch):
    from attesta.plans import captures
    from attesta.streaming import fanout

    monkeypatch.setattr(captures, "shared_path", lambda spark, name: f"file://{tmp_path}/{name}")
    spark.createDataFrame([(1, "F", 2.0), (2, "O", 3.0)], "o_orderkey bigint, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 2, 7, 30.0, "A"), (1, 1, 7, 5.0, "N")], "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r["analysis_id"]: (r["batch"], r["lines"]) for r in captures.fanned_out(spark, str(tmp_path)).collect()} == {1: (0, 2), 2: (1, 0)}
    lines = fanout.read(spark, f"file://{tmp_path}/fanout", "lines").orderBy("ordinal").collect()
    assert [(r["analysis_id"], r["l_linenumber"], r["l_partkey"], r["l_quantity"]) for r in lines] == [(1, 1, 7, 5.0), (1, 2, 7, 30.0)]
