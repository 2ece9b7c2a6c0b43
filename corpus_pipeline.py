"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's documents.

toxicity (rejected documents go), quality rules (rejected documents go), line dedup (repeated lines go, from all documents but the last
that holds them), n-gram Jaccard join (one document of each group stays), best-fit packing (returns the pieces and their sequences).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from embedlens.llm import line_dedup, ngram_join, packing, quality, toxicity
from embedlens.llm.queries import vocabulary
from embedlens.llm.shared import Scratch, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.with_score(docs, read(spark, sf_dir, "labels"), threshold=0.7, keep="clean")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judged(docs, keep_rows=True)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(docs, min_chars=40, min_docs=5, emit="text")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each_group(docs, shingle=5, percent=80)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=1, max_tokens=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("best_fit_packing", pack_documents),
]
#: Model-based stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
