"""A training corpus from ``documents``: five stages, each one operator of ``plumbline.llm``.

All stages but the last return the columns of ``documents``. Each stage's result
is written to the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import langid, lines, mixing, ngrams, packing
from plumbline.llm.common import settle, table
from plumbline.llm.queries import DOMAIN, WEIGHTS, tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter or a likely language go."""
    return langid.known_language(docs)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier; those that lose all their text go."""
    out = lines.dedup_lines(docs)
    out = out.where(~((F.col("kept_lines") < F.col("n_lines")) & F.expr(r"text not rlike '\\S'")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return ngrams.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight tenths of the tokens, mixed to the weights, with at most two epochs of a leaf; a cut document keeps its first words."""
    out = mixing.mix(docs, F.expr(DOMAIN), 0.8, 2, WEIGHTS)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [
    ("language_id", language),
    ("line_dedup", unique_lines),
    ("ngram_jaccard_join", one_of_each),
    ("mixing", mixture),
    ("best_fit_packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
