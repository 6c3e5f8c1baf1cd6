"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions alone.

A source's target is its share of the budget by weight, held at `most` times its size, the excess shared again among
the others. A source takes each document floor(target / size) times; the rest of its target is filled in the order
of exponential keys -ln(u) / quality, u fixed by the document's id and text. Keys are first dealt into buckets of key
ranges with about as many rows each, sums over buckets give each bucket its start, and only rows of one bucket are
sorted together, so that a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common

#: Rows that one bucket of keys is to hold, about; classes of quality that the buckets' bounds come from.
BUCKET_ROWS, CLASSES = 1_000, 16
#: The least quality that counts, so that every document has a finite key.
LEAST_QUALITY = 0.05
WEIGHTS, MOST = (5, 2, 1), 3
#: Sources that are ranked together, at least.
SOURCE_ROWS = 10_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """0.2 to 1: how near the mean characters a word (the space included) are to six; exact rational arithmetic of longs."""
    chars = F.coalesce(F.char_length(text), F.lit(0)).cast("long")
    mean = F.when(size > 0, chars / size).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.2), F.lit(1.0) / (F.lit(1.0) + F.abs(mean - 6.0) / 6.0))


def ranked(sizes: DataFrame) -> DataFrame:
    """sizes with place: sources by code point from 0, null last. Ranges of sources are ranked by themselves, then moved up."""
    n = sizes.count()
    ranges = max(1, n // SOURCE_ROWS)
    none = F.col("source").isNull()
    if ranges == 1:
        return sizes.withColumn("place", F.row_number().over(Window.orderBy(none, "source")) - 1)
    spread = common.cut(sizes.repartitionByRange(ranges, none, F.col("source")).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy("part").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).select("part", "start")
    within = F.row_number().over(Window.partitionBy("part").orderBy(none, "source")) - 1
    return spread.withColumn("own", within).join(F.broadcast(starts), "part").select(*sizes.columns, (F.col("own") + F.col("start")).alias("place"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, source_size: a row per source) with target.

    Sources that reach `most` times their size are held there, what they leave is shared again by weight, and so on until
    none is above: each round is one sum over the sources, and only sums come to the driver.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    df = common.cut(ranked(sizes).withColumn("w", w.cast("long")))
    whole = df.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    left, w_left, rate = whole["size"] or 0, whole["w"] or 1, None
    while rate != (rate := left / w_left):
        over = most * F.col("source_size") <= F.col("w") * F.lit(rate)
        held = df.where(over).agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
        if not held["w"] or held["w"] == whole["w"]:
            break
        left, w_left = whole["size"] - most * held["size"], whole["w"] - held["w"]
    target = F.when(most * F.col("source_size") <= F.col("w") * F.lit(rate), (most * F.col("source_size")).cast("double")).otherwise(F.col("w") * F.lit(rate))
    return df.select("source", "source_size", target.alias("target"))


def bucket_of(docs: DataFrame, rows: int) -> Column:
    """Buckets of the column key, ascending like it, of about BUCKET_ROWS rows: keys through their distribution over all rows.

    That is a mixture of one exponential per class of quality, weighed by the rows of that class.
    """
    buckets = max(1, math.ceil(rows / BUCKET_ROWS))
    kind = F.least(F.floor(F.col("quality") * CLASSES), F.lit(CLASSES - 1))
    classes = docs.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.avg("quality").alias("q")).orderBy("kind").collect()  # CLASSES rows at most
    if not classes:
        return F.lit(0)
    share = reduce(lambda a, b: a + b, [F.lit(c["n"] / rows) * (1 - F.exp(-F.col("key") * F.lit(c["q"]))) for c in classes])
    return F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, quality_col: str | None = None, whole: bool = False
) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of each row; with keep also `row`.

    Sources go by code point, null last, and weigh `weights` in turn. Documents weigh quality_col (0 to 1, null and less
    than LEAST_QUALITY as that), or else how near their mean characters a word are to six. Keys follow from id and text
    (null: a fixed one), so reruns agree; rows that repeat both take turns in any order, which changes no total. The
    document at which the fractional part reaches its target gives its first words only, so a source takes its target to the
    word; with whole, it counts as a whole or not at all, whichever is nearer. A null text has size 0 and takes
    nothing; a corpus without words takes nothing. An empty table gives no rows.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if keep else []
    text = F.col(f"`{text_col}`")
    given = F.lit(None).cast("double") if quality_col is None else F.least(F.greatest(F.coalesce(F.col(f"`{quality_col}`").cast("double"), F.lit(0.0)), F.lit(LEAST_QUALITY)), F.lit(1.0))
    name = F.concat(F.coalesce(F.col(f"`{id_col}`").cast("long").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), size_of(text).alias("size"), text.alias("text"), name.alias("name"), given.alias("quality"), *row)
    if quality_col is None:
        docs = docs.withColumn("quality", quality_of(F.col("text"), F.col("size")))
    u = (F.conv(F.substring(F.md5(F.col("name").cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    docs = docs.withColumn("key", -F.log(u) / F.col("quality")).drop("text")
    if not keep:
        docs = common.cut(docs)
    count = docs.agg(F.count("*")).first()[0] if not keep else df.count()
    docs = docs.withColumn("bucket", bucket_of(docs, count))
    per_bucket = common.cut(docs.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket")))
    per_source = per_bucket.groupBy("source").agg(F.sum("in_bucket").alias("source_size"))
    plan = targets(per_source, weights, most)
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.withColumn("start", F.coalesce(F.sum("in_bucket").over(so_far), F.lit(0))).drop("in_bucket")
    starts = starts.join(plan, starts["source"].eqNullSafe(plan["source"])).select(starts["source"], "bucket", "start", "source_size", "target")
    docs = docs.join(starts, docs["source"].eqNullSafe(starts["source"]) & (docs["bucket"] == starts["bucket"])).select(docs["*"], "start", "source_size", "target")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = docs.withColumn("before", F.col("start") + F.sum("size").over(within) - F.col("size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long") - F.col("before")
    part = F.when(2 * rest >= F.col("size"), F.col("size")).otherwise(F.lit(0)) if whole else F.greatest(F.lit(0), F.least(F.col("size"), rest))
    taken = epochs * F.col("size") + part
    return docs.select(*(["row"] if keep else []), "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op10_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents`, mixed."""
    return mix(common.only(common.table(spark, sf_dir, "documents"), "doc_id", "source", "text"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         COALESCE(length(text), 0) AS chars,
         (CAST(('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || md5(COALESCE(text, ''))), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents
), k AS (
  SELECT doc_id, source, size,
         -ln(u) / greatest(0.2::DOUBLE, 1.0::DOUBLE / (1.0::DOUBLE + abs(CASE WHEN size > 0 THEN chars::DOUBLE / size::DOUBLE ELSE 0.0::DOUBLE END - 6.0::DOUBLE) / 6.0::DOUBLE)) AS key
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s
), r AS (
  SELECT *, source_size::DOUBLE / w::DOUBLE AS ratio,
         CAST(COALESCE(sum(source_size) OVER (ORDER BY source_size::DOUBLE / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
         CAST(sum(w) OVER (ORDER BY source_size::DOUBLE / w::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_left,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM w
), h AS (
  SELECT *, (total - 3 * before)::DOUBLE / w_left::DOUBLE AS rate FROM r
), f AS (
  SELECT *, (3 * source_size)::DOUBLE <= w * rate AS held FROM h
), t AS (
  SELECT source, source_size, CASE WHEN held THEN (3 * source_size)::DOUBLE
         ELSE w * (SELECT arg_min(rate, ratio) FROM f WHERE NOT held) END AS target FROM f
), p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         CAST(CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS BIGINT) AS epochs,
         CAST(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - k.size AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(round(target - epochs * source_size) AS BIGINT) - before)) AS BIGINT) AS taken
FROM p
"""
