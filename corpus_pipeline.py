"""A corpus pipeline of five stages; counted as part of the subpackage exprflow.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from exprflow.llm import langid, mixing, neardup, packing, quality
from exprflow.session import materialize, read_table, ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in one of the known languages; those without a letter or with a doubtful language go."""
    ship(spark)
    return langid.keep_identified(docs, min_score=0.5)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that pass the base rules and that no learned rule covers."""
    ship(spark)
    return quality.filter_documents(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near-duplicates: shingles of five words, a similarity of 0.8 or more."""
    ship(spark)
    return neardup.drop_near_duplicates(docs, shingle=5, threshold=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1 in turn; documents repeat where a source takes several epochs."""
    ship(spark)
    return mixing.mix(docs, weights=(5.0, 2.0, 1.0), share=1.0, max_epochs=3.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048, as a row for each piece of a document."""
    ship(spark)
    return packing.pack(docs, capacity=2048)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Learned stages aren't expressible in SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
