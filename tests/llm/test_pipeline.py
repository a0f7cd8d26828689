import hashlib

import corpus_pipeline
from attesta.llm import bpe
from llm_rows import words


def put(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    near = words(1, 200).replace(words(1, 200).split()[100], "other", 1)
    rows = [(k, words(k, 200), "en", "s", 1) for k in range(1, 40)] + [(50, words(1, 200), "en", "s", 1), (51, near, "en", "s", 1), (52, "123 !!", "en", "s", 1), (53, None, "en", "s", 1), (None, words(70, 90), "en", None, None)]
    sf = put(spark, tmp_path / "t", rows, [(k, 1, 0) for k in range(1, 30)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(docs.count())
        assert docs.columns == columns or name == "byte_bpe"
    assert sizes == [42, 41, 40, 40, 40]
    texts = {r[0]: r[1] for r in rows}
    for r in docs.collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        assert bytes(r["token_ids"]) == bpe.encode_text(bpe.encoding(), texts[r["doc_id"]])


def test_empty_tables(spark, tmp_path):
    sf = put(spark, tmp_path / "e", [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_names_of_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "byte_bpe"] and corpus_pipeline.ORACLE_SQL is None
