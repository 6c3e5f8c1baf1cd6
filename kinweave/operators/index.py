"""Document statistics over the corpus (src 2 and 3), always within a country."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as tx


def exploded(records: DataFrame, column: str) -> DataFrame:
    """(country, id, src, token): a row per distinct token of a record's normal form."""
    return records.select("country", "id", "src", F.explode(tx.tokens(F.col(column))).alias("token"))


def document_frequency(records: DataFrame, column: str) -> DataFrame:
    """(country, token, df) over the corpus, without any cap."""
    return exploded(records.where("src <> 1"), column).groupBy("country", "token").agg(F.count("*").alias("df"))


def corpus_size(records: DataFrame) -> DataFrame:
    """(country, n) over all corpus records, empty ones too."""
    return records.where("src <> 1").groupBy("country").agg(F.count("*").alias("n"))


def idf(records: DataFrame, column: str, cap: int) -> DataFrame:
    """(country, token, df, idf) of tokens within the cap that some record lacks: ln(n / df)."""
    df = document_frequency(records, column).where(F.col("df") <= cap)
    return df.join(corpus_size(records), "country").where("df < n").select("country", "token", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def smoothed_idf(records: DataFrame, column: str) -> DataFrame:
    """(country, token, idf) of every token of src 1: ln((n+1)/(df+1)) + 1, df 0 for tokens the corpus lacks."""
    seen = exploded(records.where("src = 1"), column).select("country", "token").distinct()
    df = seen.join(document_frequency(records, column), ["country", "token"], "left").join(corpus_size(records), "country")
    return df.select("country", "token", (F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf"))


def postings(records: DataFrame, column: str, cap: int) -> DataFrame:
    """(country, id, src, token, w): idf over the record's norm, both over the tokens that survive the cap."""
    rows = exploded(records, column).join(idf(records, column, cap), ["country", "token"])
    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("country", "id")))
    return rows.select("country", "id", "src", "token", (F.col("idf") / norm).alias("w"))


def text_vectors(records: DataFrame, column: str, cap: int) -> DataFrame:
    """(country, text, t, w): the postings of each distinct text as parallel arrays; texts without any have no row."""
    texts = records.select("country", F.col(column).alias("text")).distinct()
    rows = texts.select("country", "text", F.explode(tx.tokens(F.col("text"))).alias("token")).join(idf(records, column, cap).drop("df"), ["country", "token"])
    held = rows.groupBy("country", "text").agg(F.collect_list(F.struct("token", "idf")).alias("p"))
    norm = F.sqrt(F.aggregate("p", F.lit(0.0), lambda s, x: s + x["idf"] * x["idf"]))
    return held.withColumn("norm", norm).select("country", "text", F.col("p.token").alias("t"), F.transform("p", lambda x: x["idf"] / F.col("norm")).alias("w"))
