"""A training corpus from raw documents.

Stages: language ID, line dedup, SimHash near-dedup, benchmark
decontamination, packing. Each takes (spark, docs, sf_dir) and works on all
that its predecessor kept; ``run`` writes each result and reads it again.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, language, lines, packing, simhash
from factloom.llm.common import Workspace, scope, table

#: A text of which the chosen language knows fewer n-grams than this share is in none of the languages.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages learned go: texts without letters, or that no filter knows."""
    model = language.train(docs.where(~language.held_out()))
    found = language.identify(docs, model)
    return found.where((F.col("lang_pred") != language.UND) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut; documents of which nothing is left go, others get their new n_chars."""
    found = lines.dedup_lines(docs)
    cut = F.col("n_deleted") > 0
    left = found.where(~cut | (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return left.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, that with the smallest id."""
    return simhash.kept(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where("not contaminated").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training windows, with their token ids; ``packing.sequences`` joins them to windows."""
    pieces = packing.pack(docs.select("doc_id", "text", "source"), packing.vocabulary(), temper=packing.TEMPER, with_ids=True)
    return pieces.select("doc_id", "source", *[c.split()[0] for c in packing.PIECE.split(", ")], "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixture_packing", packed),
]

#: Language models, pivots and token ids are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read as the next one's input.
    A stage's work tables go when it has been written, its input when the next one has."""
    ws = Workspace(spark)
    docs, held = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with scope():
            docs = ws.write(stage(spark, docs, sf_dir))
        if held is not None:
            ws.drop(held)
        held = docs
    return docs
