"""A training corpus from the documents table: five filtering and packing stages.

Every stage works on all rows its predecessor kept.  All but the last return the columns of their
input unchanged, whatever they are called; the last returns one row per packed piece.  ``run`` writes
each stage's rows as a Parquet table into the cluster's shared folder and rereads it, so a lost
executor repeats tasks of one stage only.

Null ids, null texts, repeated rows and empty tables follow the operators' own docstrings: a null or
empty text is not toxic, is of unknown language, and so leaves at the second stage.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwork.llm import decontam, langid, packing, simhash, toxicity
from tabwork.llm.common import saved, table

LEAST_LANGUAGE = 1 / 3  # share of a text that its language must have: mixed texts in two languages stay


def _kept(docs: DataFrame, judge: Callable[[DataFrame, str], DataFrame], keep: Column) -> DataFrame:
    """Rows that ``judge``'s columns keep; the columns travel under names that clash with none."""
    plain = [f"_column{i}" for i in range(len(docs.columns))]
    judged = judge(docs.toDF(*plain), plain[docs.columns.index("text")])
    return judged.filter(keep).select(*plain).toDF(*docs.columns)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counterfactual-regularised classifier, learned from all labels, does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learned(docs, labels)
    return _kept(docs, lambda d, text: toxicity.scored(d, model, text), F.col("predicted") == 0)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mostly written in one language that the corpus names."""
    model = langid.learned(docs)
    keep = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)
    return _kept(docs, lambda d, text: langid.predicted(d, model, text), keep)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of SimHash near-duplicates."""
    return simhash.deduplicated(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim benchmark window."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _kept(docs, lambda d, text: decontam.judged(d, benchmark, text), ~F.col("contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as power-of-two pieces with their places."""
    return packing.digest(packing.sequences(docs, packing.default_tokenizer()))


STAGES = [
    ("toxicity", toxic_out),
    ("language", known_language),
    ("near_copies", near_copies_out),
    ("benchmark", benchmark_out),
    ("packing", packed),
]

#: models, fingerprints and token ids are beyond SQL; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = saved(stage(spark, rows, sf_dir), f"stage-{name}")
    return rows
