"""Work that must not grow faster than the tables: what is passed over once, filtered early or spread over more tasks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from attesta.operators import findings, lineage

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")


def test_a_capture_costs_its_own_items_only(monkeypatch):
    keys, plain = [], lineage.item_key
    monkeypatch.setattr(lineage, "item_key", lambda field, x: keys.append(field) or plain(field, x))
    chain = lineage.Chain()
    for i in range(100):
        chain.add(f"s{i}", None, ("1688", "1"), {"products": [{"offer_id": str(i)}]})
    assert len(keys) == 100 and chain.omitted["products"] == 1 and len(json.loads(chain.row()[3])["products"]) == 20


def test_a_long_chain_keeps_the_times_of_captures_that_count():
    chain = lineage.Chain()
    chain.add("first", "2026-01-01", ("1688", "1"), {"rating": 1})
    for i in range(500):
        chain.add(f"s{i}", "2026-02-02", ("1688", "1"), {"categories": [i]})
    assert len(chain.extracted) <= 64 and chain.row()[8:10] == (["first"], "2026-01-01")


@tables
def test_only_pages_that_are_shown_are_folded(spark, monkeypatch):
    from attesta.plans import captures

    seen, plain = [], lineage.folded
    monkeypatch.setattr(captures.lineage, "folded", lambda rows: seen.append(rows) or plain(rows))
    captures.item_lineage(spark, DATA)
    most = seen[0].select("page", F.explode("parts").alias("part")).groupBy("page").agg(F.count_distinct("part").alias("n")).agg(F.max("n")).first()[0]
    assert most is not None and most <= 20


def test_signals_are_passed_over_once(spark):
    kind = "array<struct<confidence:float,evidence_fields:array<string>>>"
    runs = spark.createDataFrame([("a", [(0.5, ["x"]), (None, None)], None, [(1.0, [])]), ("b", None, None, None), ("c", [], [(0.25, [])], [])], f"supplier string, positive {kind}, risk {kind}, uncertainty {kind}")
    found = findings.supplier_findings(runs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    want = [("a", "supplier_positive:0", "SUPPLIER_POSITIVE", 0.5), ("a", "supplier_positive:1", "SUPPLIER_POSITIVE", None), ("a", "supplier_uncertainty:0", "SUPPLIER_UNCERTAINTY", 1.0), ("c", "supplier_risk:0", "SUPPLIER_RISK", 0.25)]
    assert sorted((r["supplier"], r["finding_key"], r["finding_type"], r["confidence"]) for r in found.collect()) == want
    assert found.columns == list(findings.FINDING) and {r["dimension"] for r in found.collect()} == {None}


@tables
@pytest.mark.parametrize("name", ["supplier_findings", "evidence_overlay"])
def test_what_a_task_holds_follows_what_a_task_reads(spark, name):
    from attesta.plans import evidence  # noqa: F401  this registers them
    from attesta.plans.registry import QUERIES
    from attesta.sources.tables import read_table, spread

    n = spread(read_table(spark, DATA, "lineitem"))
    assert n > int(spark.conf.get("spark.sql.shuffle.partitions")) and QUERIES[name].run(spark, DATA).rdd.getNumPartitions() == n
