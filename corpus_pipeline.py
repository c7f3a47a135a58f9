"""A corpus run end to end: toxicity, exact dedup, near dedup, mixing, BPE. Part of the webdelta.llm subpackage.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return the columns of documents.

Defined results: a null text counts as empty in every stage. It is scored like a text without words, all empty texts are
copies of one another, texts without words are near copies of nothing, their draws in mixing are by the rate of their
source, and they encode to no tokens. Of rows that repeat id and text one stays. Extra columns of documents are carried to
the mix, whatever their names; the last stage returns its own columns. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webdelta.llm import bpe, exact_dedup, minhash, mixing, toxicity
from webdelta.llm.common import documents, stored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score reaches the threshold; the classifier learns from labelled rows of docs."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each text."""
    return exact_dedup.deduplicated(docs, keep="smallest")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group: five-word shingles, Jaccard 0.8 or more."""
    return minhash.deduplicated(docs, k=5, threshold="0.8")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as their source's target weight asks: 0, 1 or 2 times."""
    return mixing.taken(docs, weights=(3, 1, 2), share=1.5, cap=2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes each document."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("mixing", mix),
    ("bpe", tokens),
]

#: The classifier, the signatures and the draws have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
