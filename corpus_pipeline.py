"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir); its rows are written as Parquet and read again as the next one's docs. Every stage but the
last returns the columns of documents, whatever they are beside doc_id and text, for the rows that it keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import bpe, exact_dedup, langid, minhash, mixing
from attesta.llm.common import discard, materialize

MIN_LANGUAGE_SCORE = 0.5
NEAR_PERCENT = 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those whose language is not recognised with MIN_LANGUAGE_SCORE. Learns from docs.lang; with no language to learn, keeps all."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    if not model.langs:
        return docs
    found = langid.identify(docs, model, lang_col="_lang_pred", score_col="_lang_score")
    return found.where((F.col("_lang_pred") != langid.UNKNOWN) & (F.col("_lang_score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def first_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space the one with the smallest doc_id stays, once; rows without doc_id stay."""
    kept = exact_dedup.exact_groups(docs).where("kept and doc_id is not null").select("doc_id", F.col("text_sha256").alias("_sha"))
    marked = docs.where("doc_id is not null").withColumn("_sha", F.sha2(exact_dedup.normalized().cast("binary"), 256))
    chosen = marked.join(kept, ["doc_id", "_sha"], "left_semi").dropDuplicates(["doc_id", "_sha"]).select(*docs.columns)
    return chosen.unionByName(docs.where("doc_id is null"))


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id; rows without doc_id stay."""
    dropped = minhash.near_duplicates(docs, percent=NEAR_PERCENT).where("not kept").select("doc_id")
    return docs.join(materialize(dropped, "dropped"), "doc_id", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by their fitted rates; a rate above 1 repeats its document, so the tokens stay as many and scarce domains thin no other."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (little-endian u32), ids_sha256 and decoded_sha256, which is the digest of the text itself."""
    coded = bpe.round_trip(docs.select("doc_id", "text"))
    return coded.select("doc_id", (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"), "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", known_language), ("exact_dedup", first_of_equal), ("near_dedup", one_of_near), ("mixing", mixed), ("byte_bpe", tokens)]

#: SQL expresses neither the network nor the fitted mixture; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done = materialize(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = done
    return docs
