"""A corpus, stage by stage, from documents to packed training sequences.

Every stage but the last returns the columns of its documents, with their types,
whatever further columns there are.  Null ids and repeated rows pass every
stage but the n-gram join, which keeps one of equal documents, and all without
an id; null and empty texts, which have no language, go at the first stage; an
empty table gives an empty one.  Of ties the smallest document id stays.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.llm import langid, lines, ngramjoin, packing, pii
from cutloom.llm.common import dropped, table, written
from cutloom.llm.queries import vocabulary

#: A text whose cosine with every language's prototype is below this is no language.
MIN_COSINE = 0.1
#: With fewer letters in its different words even a clean text's cosine may be lower, so it stays.
LEAST_LETTERS = 100


#: Columns that the stages themselves read.
READ = {"doc_id", "text", "lang", "n_chars"}


def _kept(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that leaves all other columns of the documents alone, whatever their names: they travel under names of no operator."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        safe = [c if c in READ else f"own_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*safe), sf_dir).select(*safe).toDF(*docs.columns)

    return run


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


@_kept
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts without letters, and those long enough to judge that are like no prototype, go."""
    found = langid.predict(docs, langid.fit(docs))
    words = F.array_distinct(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "), " "))
    short = F.length(F.array_join(words, "")) < LEAST_LETTERS
    return found.filter((F.col("lang_pred") != "und") & ((F.col("score") >= MIN_COSINE) | short)).select(*docs.columns)


@_kept
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated lines; those of which nothing is left go."""
    found = lines.dedup(docs)
    return _sized(found.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))).select(*docs.columns)


@_kept
def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id (of equal ids the smallest digest of its text); those without id stay."""
    groups = ngramjoin.near_duplicates(docs)
    one = groups.filter("class_no is not null").groupBy("class_no").agg(F.min(F.struct("doc_id", "text_md5")).alias("one")).select("one.*")
    alone = groups.filter("class_no is null and doc_id is not null").select("doc_id", "text_md5")
    named = docs.withColumn("text_md5", F.md5(F.coalesce("text", F.lit("")))).join(one.unionByName(alone), ["doc_id", "text_md5"], "left_semi")
    named = named.dropDuplicates(["doc_id", "text_md5"])
    return named.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


@_kept
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that disclose it, generalised."""
    return _sized(pii.sanitise(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    pieces = packing.pack(docs, vocabulary("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("personal_data", personal_data),
    ("pack", pack),
]
#: Language prototypes, shingle joins and tokens have no SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is a table in the shared folder, deleted when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if i:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
