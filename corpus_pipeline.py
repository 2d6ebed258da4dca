"""A corpus from raw documents to packed training sequences, as stages that are each written and reread.

Each stage but the last returns the columns it is given, with any others that ``documents`` has.
Null and empty texts are texts without words: the classifier scores them like others, they are
nobody's copy, lose no words and give a sequence piece of one end token. Rows that repeat an id are
rows of their own; copies among them have one id, so all of them stay. Rows without an id are nobody's copy
and neither lose words nor make others lose any. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.llm import packing, quality_gam, signature_tree, window_dedup
from spendscope.llm.storage import ready, remove, shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_gam.train(docs, labels)
    score = "_" * (1 + max(map(len, docs.columns)))  # longer than any name, so another one
    good = quality_gam.scored(docs, model, score_col=score)
    return good.where(F.col(score) >= quality_gam.THRESHOLD).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of exact and near copies."""
    return signature_tree.one_per_component(docs).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long passages that an earlier one has; n_chars counts what is left."""
    return window_dedup.with_cut_text(docs).withColumn("n_chars", F.length("text").cast("long"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of tokens."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", one_of_each),
    ("repeated_passages", without_repeats),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents.

    What each keeps is written to the shared folder and removed when the next stage is written;
    the caller owns the last one's, which the result reads.
    """
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs


# Training, shingles by the million and a tokenizer are no SQL; tests hold it against brute force.
ORACLE_SQL = None
