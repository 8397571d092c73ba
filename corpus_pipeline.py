"""Corpus preparation: quality filter, boilerplate lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir); ``docs`` has the columns of documents, and so has what a
stage returns, but for the last, which returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resampla.llm import boilerplate, decontaminate, ngram_join, packing, quality
from resampla.llm.common import materialize
from resampla.llm.queries import read, tokenizer_path

QUALITY_THRESHOLD = 0.3
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives a probability of good quality under the threshold go."""
    net = quality.train_quality(docs, read(spark, sf_dir, "labels"))
    return quality.keep_quality(docs, net, QUALITY_THRESHOLD)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that more than a tenth of their source's documents hold go; other documents keep their text as it is."""
    clean = boilerplate.drop_boilerplate(docs, F.col("source"), F.col("text"), out_col="_clean")
    cut = F.col("_lines.n_dropped") > 0
    text = F.when(cut, F.col("_clean")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.when(cut, F.length("_clean").cast("long")).otherwise(F.col("n_chars"))}
    return clean.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; documents without words all stay."""
    return ngram_join.one_of_each(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is tokenised and packed."""
    return packing.pack_documents(docs, tokenizer_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None  # a trained network and a byte-level vocabulary are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
