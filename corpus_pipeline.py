"""Corpus pipeline over `documents`: quality, near-duplicates, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.llm import common, crf, debruijn, mixing, packing, simhash_anchor


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject."""
    model = crf.train(docs, common.table(spark, sf_dir, "labels"))
    return crf.classify(docs, model).where("predicted = 1").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash_anchor.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that a document of smaller id has; those left without words go."""
    out = debruijn.dedup(docs, keep_text=True)
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept")), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.where("n_removed < n_words or n_removed = 0").select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document, whole, as often as the mixture takes it."""
    out = mixing.mix(docs, keep=True, whole=True).where("taken > 0")
    out = out.select("row", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))).alias("copy"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixture", mixture), ("sequences", sequences)]
#: The classifier, the fingerprints and the tokenizer have no SQL form; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; an empty table gives no rows.

    Rows with null ids or texts, repeated rows and odd columns go through as each stage's operator states.
    """
    docs = common.table(spark, sf_dir, "documents")
    tables = common.Tables(spark)
    for at, (name, stage) in enumerate(STAGES[:-1]):
        docs = tables.put(name, stage(spark, docs, sf_dir))
        if at:
            tables.drop(STAGES[at - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
