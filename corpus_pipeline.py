"""A corpus pipeline of five stages over ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of documents. Each works on all that the stage before it kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlens.llm import language, mixing, neardup, packing, substrings
from freightlens.llm.queries import tokenizer_path
from freightlens.session import ensure_checkpoint_dir, ship_package


def _named(docs: DataFrame, *needed: str) -> DataFrame:
    """``docs`` with plain names for all columns but the needed ones, since columns of
    documents may have the names that an operator uses itself."""
    return docs.toDF(*[c if c in needed else f"c{i}" for i, c in enumerate(docs.columns)])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. The labels of one fifth of the ids
    are not learned from."""
    model = language.fit(docs.where(~language.held_out("doc_id", 5, 0)))
    named = _named(docs, "text")
    kept = language.identify(named, model).where("not rejected")
    return kept.select(*named.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, with the smallest id."""
    named = _named(docs, "doc_id", "text")
    return neardup.one_of_each(named).select(*named.columns).toDF(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words and more that an earlier document has;
    texts that lose nothing stay as they are, line ends included."""
    return substrings.cut_repeats(docs).withColumn(
        "n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn mix: a row for each document and each time it is taken."""
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Centroids, the drawn mix and the tokenizer are beyond SQL.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the
    shared folder as Parquet and read again. A stage's folder goes when the next one
    is written; the one that the result reads stays."""
    ship_package(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return STAGES[-1][1](spark, docs, sf_dir)
