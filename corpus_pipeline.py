"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs is the stage before's result, written and read again.
All but the last return the columns of documents, and work on every row that the stage before kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import langid
from tracewell.llm.common import delete_path, release, scope, scratch_path, table
from tracewell.llm.decontaminate import contaminated
from tracewell.llm.line_dedup import dedup_lines
from tracewell.llm.minhash import near_duplicates
from tracewell.llm.packing import pack
from tracewell.session import ship

SCOPE = "pipeline"


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Run f with its scratch tables in the pipeline's scope; those of the stage before go, as its result has been written."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        release(spark, SCOPE)
        with scope(SCOPE):
            return f(spark, docs, sf_dir)

    return run


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model doesn't take for one of the learned languages go: texts without a letter, other scripts and languages, and
    those it is less than half sure of. Rows are judged one by one by their own text, whatever their id; nothing else changes."""
    return langid.keep_identified(docs, langid.train(docs.select("doc_id", "text", "lang")))


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents share stay in the largest doc_id only; n_chars follows. Documents stay, even if nothing is left of them.
    Rows that repeat a doc_id, null included, are one document."""
    out = dedup_lines(docs)
    kind = dict(docs.dtypes).get("n_chars")
    return out.select(*[F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, the smallest doc_id. Rows go one by one: of two rows with one doc_id and
    other texts, only the one whose text is a copy goes."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("tw_gone"), F.col("text_hash").alias("tw_text")).distinct()
    copy = (docs["doc_id"] == gone["tw_gone"]) & (F.xxhash64(docs["text"]) == gone["tw_text"])
    return docs.join(gone.hint("shuffle_hash"), copy, "left_anti")


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover an item of the benchmark go; rows that repeat a doc_id are judged together. An empty benchmark clears all."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    gone = found.filter("contaminated").select(F.col("doc_id").alias("tw_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["tw_gone"]), "left_anti")


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token that is left, in sequences of at most 4096: one row per piece. Every row has at least one, whatever its text or id."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Language ID's model can't be expressed in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents; each stage's result is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")  # goes with the session, or sooner
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
