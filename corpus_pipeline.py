"""A training corpus from `documents`: language, toxicity, near duplicates, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of `documents`; the last returns the packing plan of the documents that remain. An empty table gives
an empty table at every stage. What a stage does with nulls, repeated rows and odd texts stands with it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelcube.llm import language_id, toxicity
from parcelcube.llm.common import free_name, settle, table
from parcelcube.llm.decontaminate import leaks
from parcelcube.llm.minhash import near_duplicates
from parcelcube.llm.packing import pack_documents

#: A document whose best mean language probability is lower is in no known language; with four languages it is 0.25 at least.
MIN_LANGUAGE_SCORE = 0.28


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no language that the labelled ones show, go.

    Null and empty texts go; without any labelled document, all go; repeated rows are judged each; columns of any name stay as they are.
    """
    network = language_id.train(docs)
    names = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    named = language_id.with_language(docs, network, names=names)
    return named.where((F.col(names[0]) != language_id.UNKNOWN) & (F.col(names[1]) >= MIN_LANGUAGE_SCORE)).select(docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.

    Null and empty texts are scored as texts without evidence; without labels of both classes all stay unless every label is
    toxic; repeated rows are scored each; columns of any name stay as they are.
    """
    name = free_name(docs, "toxic_score")
    scorer = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_toxicity(docs, scorer, name=name).where(F.col(name) < 0.5).select(docs.columns)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key per document: its doc_id, or beyond all usual ids a number made of the text of a row without one."""
    key = free_name(docs, "document")
    made = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62)
    return docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), made)), key


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id: five-word shingles, similarity 0.8.

    Rows that share a doc_id are one document: the row of the least text stays. A row without a doc_id is known by its text and comes
    after all others of its group. Texts without words are linked with nothing; columns of any name stay as they are.
    """
    rows, key = _keyed(docs)
    found = settle(near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), k=5, percent=80))
    gone = found.where("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(key))
    left = rows.join(gone, key, "left_anti")
    nth = free_name(rows, "nth")
    one = left.join(twice, key, "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy("text"))).where(F.col(nth) == 1)
    return left.join(twice, key, "left_anti").select(docs.columns).union(one.select(docs.columns))


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; rows that share a doc_id go together; a row without a doc_id is known by its text; an empty benchmark
    leaves all; columns of any name stay as they are.
    """
    rows, key = _keyed(docs)
    gone = leaks(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(gone, key, "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens.

    Null and empty texts are an end token alone; every row is packed, repeated ones and those without a doc_id too; other columns are left out.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("toxicity", clean),
    ("near_dedup", distinct),
    ("decontamination", unleaked),
    ("packing", packed),
]

#: Trained models decide in two stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
