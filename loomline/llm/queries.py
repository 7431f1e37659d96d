"""The subpackage's registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from fractions import Fraction
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import ann, bpe, chat, jaccard, langid, mixing, quality, sharding, topk, urlfilter
from loomline.llm.oracle import ORACLES as ORACLES

#: The vocabulary file of the registered queries, by the name that public_tokenizers knows.
VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    return import_module("public_tokenizers").path(VOCABULARY)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.tokenise(docs, vocabulary(), ids=None).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=8)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, intercept = urlfilter.fit(urlfilter.labelled_urls(spark))
    return urlfilter.judge(table(spark, sf_dir, "pages"), weights, intercept)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    rows = topk.saved(rows.select("id", F.transform("v", lambda x: F.floor(x * 64).cast("double")).alias("v")))
    return topk.search(rows, rows.filter("id % 20 = 0"), k=20)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", langid.held_out())
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    forest = quality.fit(docs.filter(~F.col("held_out")), labels.filter(~langid.held_out()))
    scored = quality.score(docs, forest)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), width=3, threshold=Fraction(9, 10))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_bpe, op3_sharding, op4_nearest, op5_url_filter, op6_mixing, op7_exact_topk, op8_chat, op9_quality, op10_jaccard, pipeline)}
