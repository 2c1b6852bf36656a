"""The corpus pipeline: language, boilerplate lines, near duplicates, benchmark leaks, token ids.

Every stage works on all rows that the one before it kept. ``run`` writes each stage's
result into the shared folder and reads it again, so that a lost executor costs no more
than the stage at hand; what a stage read goes once it is written.

Null and empty texts have no language and leave in the first stage. Rows equal in doc_id
and text are one document: one of them stays. Further columns travel along, and empty
tables pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sceneloom.llm import decontaminate, langid, line_dedup, minhash, sentencepieces
from sceneloom.llm.common import table
from sceneloom.llm.queries import MIN_MARGIN, MODEL_PATH, SITES, taught
from sceneloom.session import discard_folder, ensure_checkpoint_dir

#: A text that would lose more of itself to boilerplate lines is a copy, which near-dedup judges whole.
MOST_LOST = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose language is undecided: no letter, or a narrow margin."""
    return langid.drop_undecided(docs, langid.learn(taught(table(spark, sf_dir, "documents"))), MIN_MARGIN)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes cross-site boilerplate lines out of the texts, but for texts that are mostly such lines; every row stays."""
    return line_dedup.drop_spread_lines(docs, SITES, most=MOST_LOST).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return minhash.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts; (doc_id, ids, n_ids, round_trip)."""
    return sentencepieces.encode(docs, MODEL_PATH)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark),
          ("token_ids", token_ids)]

#: Language models by compression, sketches and token ids can't be put into SQL; tests hold brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard_folder(spark, before)
        before = path
    return docs
