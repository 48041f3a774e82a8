"""Training-corpus pipeline over documents: five stages, each written and read again as Parquet.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents, whatever their names, as they are; the last returns the token ids.

In every stage a null text counts as empty, long texts are worked on whole, and an empty table gives
an empty result. Empty texts are kept by the classifier, are equal to each other, link with nothing
by shingles, have size 0 in the mix and no ids. Rows that share an id, and those without one, are told
apart by their texts; rows equal in both are copies. Ties are settled by the smallest id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chelate.llm import exact_dedup, jaccard_join, mixing, quality, subwords
from chelate.llm.common import checkpoint_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go; a score of just the bar is rejected, copies fare alike."""
    return quality.drop_bad(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space one document stays, the one with the smallest id; a null id counts as the largest."""
    return exact_dedup.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles at a similarity of 0.8 connect, one stays."""
    return jaccard_join.drop_near(docs, words=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times; a null source is a source, the last."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each document, each copy cut by itself, and whether they decode to its text."""
    return subwords.encode(subwords.numbered(docs), check=True, copy_col="copy")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing to target weights", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: The classifier and the encoder have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Stage results go to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
