"""Corpus preparation in five stages; each works on all documents that the one before it kept.

Language identification drops what it rejects, near-duplicate groups keep one document,
documents that hold benchmark items go, personal data is generalised in place, and the
rest is packed into sequences. Stages before the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from fissure.llm import decontam, langid, packing, pii, sketch
from fissure.llm.shared import collect_garbage, materialise, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_heaps(stage: Stage) -> Stage:
    """The stage, begun when executors have given back what earlier work touched."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_garbage(spark)
        return stage(spark, docs, sf_dir)

    return begun



@in_small_heaps
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a language model, trained on a bounded sample of their own labels, accepts."""
    return langid.accepted(docs, langid.train(docs))


@in_small_heaps
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more."""
    return sketch.one_of_each_group(docs, n=5, percent=80)


@in_small_heaps
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontam.without_copies(docs, table(spark, sf_dir, "benchmark"))


@in_small_heaps
def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that disclose it generalised."""
    return pii.sanitise(docs)


@in_small_heaps
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language identification", identify_language),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("pii", sanitise),
    ("packing", pack),
]
#: SQL can't express the models, sketches and tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
