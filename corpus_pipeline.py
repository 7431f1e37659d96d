"""A corpus pipeline: quality, language, near copies, mixing, tokens.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. Every stage works on all rows that the one before
kept; all but the last return the columns of docs.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bpe, jaccard, langid, mixing, quality
from loomline.llm.queries import table, vocabulary
from loomline.llm.sparkkit import key_filter, saved, sieve, spread_join

#: The least posterior probability with which a language counts as identified.
SURE = 0.5
#: Near copies: words of a shingle, and the Jaccard similarity from which on documents are one group.
SHINGLE, ALIKE = 5, Fraction(8, 10)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the classifier learns as op9 does."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~langid.held_out())
    forest = quality.fit(docs.filter(~langid.held_out()), labels)
    return quality.score(docs, forest, out="__score").filter(F.col("__score") >= quality.THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified: they hold letters, and one learned language is likelier than not."""
    model = langid.fit(docs.filter(~langid.held_out()))
    found = langid.identify(docs, model, out="__lang", score="__score")
    return found.filter((F.col("__lang") != "und") & (F.col("__score") >= SURE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of least doc_id, nulls last, then of least hash of doc_id and text.

    A row is known by that hash: a doc_id may have several texts, or be null. Rows alike in doc_id and text are one.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*names, F.xxhash64("doc_id", "text").alias("__row"))
    ids = rows.groupBy("__row").agg(F.first("doc_id").alias("__id"), F.count(F.lit(1)).alias("__times"))
    found = jaccard.join(rows, SHINGLE, ALIKE, key="__row").groupBy("__row").agg(F.max("component_id").alias("__root"))
    placed = saved(found.join(ids, "__row"))
    best = placed.groupBy("__root").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__row")).alias("__best"), F.count(F.lit(1)).alias("__size"))
    decided = spread_join(placed, saved(best.select("__root", F.col("__best.__row").alias("__kept"), "__size")), ["__root"], "__size")
    decided = decided.select("__row", (F.col("__row") == F.col("__kept")).alias("__keep"), "__times")
    special = saved(decided.filter("not __keep or __times > 1").select("__row", "__keep"))
    # Rows that are neither dropped nor repeated stay where they are; only the others, and the few that the filter takes for them, are shuffled.
    words = key_filter(special.select("__row"))
    firsts = sieve(rows, "__row", words, True).groupBy("__row").agg(F.min(F.struct(*names)).alias("__first"))
    firsts = firsts.join(special.hint("merge"), "__row", "left").filter(F.coalesce("__keep", F.lit(True))).select("__first.*")
    return sieve(rows, "__row", words, False).select(*names).unionByName(firsts.select(*names))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources has it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document: doc_id, source, n_tokens, hashes of ids and of the decoded text, and the ids."""
    return bpe.tokenise(docs.select("doc_id", "source", "text"), vocabulary()).drop("text")


STAGES = [
    ("quality", keep_quality),
    ("language", keep_identified),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("encode", encode),
]

#: No SQL expresses the classifiers; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
