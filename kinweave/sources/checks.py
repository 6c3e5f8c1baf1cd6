"""Format checks of tab-separated result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def check_tsv(spark: SparkSession, path: str, header: str) -> DataFrame:
    """(check, n): offending lines of a two-column file: header, carriage returns, fields, repeated rows, repeated ids."""
    lines = spark.read.text(path, lineSep="\n").select(F.col("value").alias("line"))
    heads = lines.where(F.col("line") == header).count()
    body = lines.where(F.col("line") != header)
    parts = body.withColumn("n", F.size(F.split("line", "\t"))).withColumn("id", F.split("line", "\t")[0])
    checks = {
        "header": spark.range(1).where(F.lit(heads != 1)),
        "carriage return": lines.where(F.col("line").contains("\r")),
        "fields": parts.where("n <> 2"),
        "repeated row": body.groupBy("line").count().where("count > 1"),
        "repeated id": parts.groupBy("id").count().where("count > 1"),
    }
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def read_result(spark: SparkSession, path: str, to: str) -> DataFrame:
    """(q, to): ids as an array, empty where there are none."""
    df = spark.read.csv(path, sep="\t", header=True, schema="q string, ids string", quote="", escape="")
    return df.select("q", F.filter(F.split(F.coalesce("ids", F.lit("")), ","), lambda x: x != "").alias(to))
