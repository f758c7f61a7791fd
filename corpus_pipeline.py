"""The corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
Stages pass every column of `documents` on; the last adds n_tokens, ids and round_trip.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import common, decontamination, jaccard, language, lines, pieces


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters or without a recognised language."""
    return language.language_stage(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the lines that repeat an earlier line, or are one word from it, out of the texts; one that loses lines and keeps no letter or digit goes."""
    return lines.line_dedup_stage(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group linked by 5-word shingles of Jaccard 0.8 or more; documents without words all stay."""
    return jaccard.near_duplicate_stage(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover a twentieth of the words or more; the others stay as they were."""
    return decontamination.decontamination_stage(docs, common.table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the pieces of every text: n_tokens, ids and round_trip; drops nothing."""
    return pieces.encode(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", to_pieces),
]

# language ID is a trained model, which SQL can't express; the tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    place = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{place}/{i}-{name}")
        docs = spark.read.parquet(f"{place}/{i}-{name}")
    return docs
