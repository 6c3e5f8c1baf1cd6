"""Record tables: one clean list (src 1) and noisy corpora (src 2, 3) as (country, id, src, name, addr)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

SOURCE_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "business_name", "business_address", "country")])
TRUTH_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("source1_entity_id", "matched_entity_ids")])


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` read as three record sources: names full of near-collisions, addresses with house and postal numbers."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    src = (F.lit(1) + F.col("p_partkey") % 3).cast("int")
    return p.select(
        F.col("p_type").alias("country"),
        F.concat(F.lit("S"), src.cast("string"), F.lit("-"), F.col("p_partkey").cast("string")).alias("id"),
        src.alias("src"),
        F.col("p_partkey").alias("k"),
        F.concat_ws(" ", "p_name", F.lower("p_type")).alias("raw_name"),
        F.concat_ws(" ", F.col("p_size").cast("string"), F.translate(F.lower("p_brand"), "#", " "), (F.lit(10000) + F.col("p_partkey") % 97).cast("string")).alias("raw_addr"),
    )


def read_source_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated source with a header; quotes are ordinary characters, every column is a string."""
    return spark.read.csv(path, sep="\t", header=True, schema=SOURCE_SCHEMA, quote="", escape="", nullValue="\u0000", emptyValue="")


def read_truth_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth; an entity without matches has "", not null."""
    df = spark.read.csv(path, sep="\t", header=True, schema=TRUTH_SCHEMA, quote="", escape="", nullValue="\u0000", emptyValue="")
    return df.withColumn("matched_entity_ids", F.coalesce("matched_entity_ids", F.lit("")))


def explode_truth(df: DataFrame) -> DataFrame:
    """(q, c): one row per true link."""
    links = df.select(F.col("source1_entity_id").alias("q"), F.explode(F.split("matched_entity_ids", ",")).alias("c"))
    return links.where("c <> ''")


def write_partitioned(df: DataFrame, path: str, key: str = "country") -> None:
    """Parquet by country; a rerun replaces only the countries it holds."""
    df.write.option("compression", "zstd").option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(key).parquet(path)


def load_shard(spark: SparkSession, root: str, split: str, country: str | None = None) -> DataFrame:
    """Sources 1 to 3 of a split as one record table; a country prunes partitions, none keeps all."""
    out = None
    for src in (1, 2, 3):
        df = spark.read.parquet(f"{root}/{split}_source{src}")
        if country is not None:
            df = df.where(F.col("country") == country)
        df = df.select("country", F.col("entity_id").alias("id"), F.lit(src).alias("src"), F.col("business_name").alias("raw_name"), F.col("business_address").alias("raw_addr"))
        out = df if out is None else out.unionByName(df)
    return out


def counts_by(df: DataFrame, key: str = "country") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def file_stamp(df: DataFrame) -> DataFrame:
    """Path, size and time of every file behind a table."""
    return df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
