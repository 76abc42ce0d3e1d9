"""A cleaning pipeline over ``documents``: quality, lines, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the
last return the columns of ``docs``, whichever these are beside doc_id and text (but for names of an
operator's outputs, which its values replace); the last returns
pieces. Rows of one id are one document to the near-duplicate stage and stay or go together.

Edge cases: null and empty texts pass every stage but quality, which judges them by their page
columns; null ids are kept by lines and near_duplicates and carried on; an empty table gives
empty tables; repeated rows are judged alike. Each operator's docstring has the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import co_training, line_dedup, minhash_dedup, packing, soft_mixing
from tidewatch.llm.common import materialize


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return co_training.classify(docs, _labels(spark, sf_dir), columns=tuple(docs.columns)).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that at least three share, but for the one with the largest id."""
    cleaned = line_dedup.LineIndex.build(docs).clean(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    gone = minhash_dedup.near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


COPIES = 8  # of a document that are written one after another


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says; rates meet the targets of clean, low and toxic tokens.

    Copies are dealt out a few at a time: thousands of one long text in a row would be one task's,
    and one batch's, memory in whatever reads them next.
    """
    mixed = soft_mixing.mix(docs, _labels(spark, sf_dir)).withColumn("__copies", soft_mixing.copies()).where("__copies > 0")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.col("__copies") - 1) / COPIES).cast("int")), lambda i: F.least(F.lit(COPIES), F.col("__copies") - COPIES * i))
    dealt = mixed.select(*docs.columns, F.explode(parts).alias("__some")).hint("rebalance")
    return dealt.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__some"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 2048 tokens."""
    return packing.digest(packing.pack(docs, packing.default_tokenizer()))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", pack)]

#: Trained models, iterative fitting and tokenizers have no SQL; tests hold each stage against a model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
