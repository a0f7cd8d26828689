import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from attesta.llm.exact_dedup import exact_groups


def brute(rows):
    norm = {k: re.sub("[\x20\x09-\x0d]+", " ", t or "") for k, t in rows}
    groups = {}
    for k, t in norm.items():
        groups.setdefault(t, []).append(k)
    return {k: (min(groups[t]), len(groups[t]), k == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for k, t in norm.items()}


def found(df):
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()}


def test_groups_equal_brute_force(docs, rows):
    assert found(exact_groups(docs)) == brute([r[:2] for r in rows])
    assert found(exact_groups(docs, first_run=3, growth=2)) == brute([r[:2] for r in rows])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab \n", max_size=9), max_size=12))
def test_random_texts(spark, texts):
    rows = list(enumerate(texts))
    assert found(exact_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), first_run=2, growth=2)) == brute(rows)


def test_empty_nameless_and_repeated_rows(spark, empty):
    assert exact_groups(empty).count() == 0
    got = exact_groups(spark.createDataFrame([(None, "a"), (None, "a"), (5, "a"), (5, "a"), (5, "b"), (6, "b")], "doc_id bigint, text string")).collect()
    assert sum(r["doc_id"] is None and r["kept"] and r["keep_id"] is None for r in got) == 2
    assert sorted((r["doc_id"], r["group_size"], r["kept"]) for r in got if r["doc_id"]) == [(5, 2, False), (5, 2, True), (5, 2, True), (6, 2, False)]
