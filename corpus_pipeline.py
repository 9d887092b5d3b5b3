"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``.

Defined cases, in every stage: an empty table gives an empty table; other columns,
whatever their names, pass unchanged; rows that share a doc_id (null included) stay
together if one of them is kept; a null text counts as empty, so it fails the base
rules of the first stage; a null language or source is one of its own; repeated rows
are kept or dropped together and packed one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyfold.llm import kneser_ney, mixing, near_dedup, packing, quality_rules
from tallyfold.llm.common import keep, table, without
from tallyfold.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the divergence rules reject go."""
    return without(docs, quality_rules.quality_rules(docs))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a perplexity above their language's limit go."""
    trusted = kneser_ney.trusted_ids(table(spark, sf_dir, "labels"))
    return without(docs, kneser_ney.classify(docs, trusted))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return without(docs, near_dedup.near_duplicates(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in training sequences.

    Executors hold what earlier stages left in the JVM, so workers remember fewer ids.
    """
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), remembered=300_000)


STAGES = [
    ("quality rules", quality),
    ("quality classifier", classifier),
    ("near-duplicate groups", near_duplicates),
    ("source mixing", mixture),
    ("best-fit packing", packed),
]

#: The classifier, sketches and tokenizer can't be expressed in SQL; tests compare
#: each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
