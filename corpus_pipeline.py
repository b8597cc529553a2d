"""From raw documents to packed training sequences, one written table a stage.

Stages keep rows with null or empty texts, and repeated rows, but for what each says; empty tables of
documents, labels or benchmark items give what is left without them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm import common, decontaminate, line_dedup, near_dedup, packing, toxicity
from tarnlake.llm.queries import table, tokenizer

#: Fits of a model and a global near-duplicate search: SQL can't express them.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, scores 0.5 or more go; without labels none."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go; so do documents of which nothing is left. Null and empty texts stay."""
    return line_dedup.drop_emptied(docs, every=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share three quarters of their five-word shingles the one of the smallest id stays.

    Rows that share an id stay or go together; texts without words, and rows without id, stay.
    """
    return near_dedup.drop_near_copies(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a test item, or all of a shorter one, go; without items none."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their token ids, and their places in sequences of 2048 tokens.

    A null or empty text is one token, the end of a document.
    """
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each reads what the one before it wrote.

    What a stage wrote for itself goes at its end, and its documents once the next stage is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with common.cleared() as kept:
            docs = common.materialize(stage(spark, docs, sf_dir), name)
            kept.append(docs)
        if before is not None:
            common.release(before)
        before = docs
    with common.cleared() as kept:
        packed = common.materialize(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
        kept.append(packed)
    common.release(docs)
    return packed
