"""The corpus pipeline: documents in, cleaned and tokenised documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
back as the next stage's docs. All but the last return the columns of documents.

Defined results: documents whose text is null or has no letter go in the first stage; a null doc_id is learned
from by the first stage, comes first where documents are ordered by id, and is kept like any other; repeated rows are treated
alike (near_dedup keeps one of them); empty tables give empty ones; other columns pass through to tokenise, but for a null lang,
which the first stage fills.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm import bpe, decontam, langid, linededup, neardup
from threatloom.llm.common import held_path, table

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from all labelled rows; drop documents without a letter and those in no learned language. Where `lang` is null, it becomes the language found.

    Texts that mix learned languages get a low score for each but are familiar, so they stay.
    """
    return langid.accepted(docs, langid.train(docs), into="lang")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later copies of repeated line runs; documents of which nothing is left go."""
    cut = linededup.dedup_lines(docs)
    left = cut.filter((F.col("n_removed") == 0) | (F.regexp_replace("text", r"\s", "") != ""))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id."""
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids, and whether decoding them gives the text back."""
    encoded = bpe.encode(docs.select("doc_id", "text", "lang", "source"), BYTE_BPE, round_trip="round_trip")
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "slice_ids", "round_trip")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("tokenise", tokenise)]
#: Language identification, near-duplicate search and BPE can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = held_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
