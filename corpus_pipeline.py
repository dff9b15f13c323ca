"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and, but for the last,
returns the columns of documents, whatever they are named.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from embdrift.llm import compression, mixing, packing, rules, simhash, tokens
from embdrift.llm.common import marks, packed, read, stored, unpacked
from embdrift.llm.queries import quality_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that fail the base rule or the learned list go."""
    stats = stored(rules.text_stats(packed(docs, "doc_id", "text")).drop("text"), "rules")  # texts are in there once, as inputs
    learned = rules.learn_rules(stats.join(marks(read(spark, sf_dir, "labels"), "quality"), "doc_id"))
    return unpacked(rules.apply_rules(stats, learned).where("kept"), docs)


def apply_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that score below 0.3 go."""
    model = quality_model(docs, read(spark, sf_dir, "labels"))
    return unpacked(compression.score(spark, packed(docs, "text"), model).where("score >= 0.3"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group of SimHash near-duplicates the smallest doc_id stays."""
    return simhash.keep_one(docs, shingle=4, distance=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents repeat, or go, so that sources come near their target weights."""
    return mixing.repeated(docs, weights=(3, 1, 2), share=1.5, max_repeat=2)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one row per piece, with its sequence and place."""
    return packing.pack(packing.cut_pieces(docs, tokens.vocabulary(), capacity=2048, end_id=0), capacity=2048)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", apply_quality_rules),
    ("quality_classifier", apply_quality_classifier),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_best_fit", pack_sequences),
]

#: The learned rules, the classifier, XXH64 and the tokenizer have no SQL form: tested by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
