"""Probes for leaks: whether ids, row places or odd records tell matched corpus records from others.

links are (country, q, c); records (country, id, src, name, addr, raw_name, raw_addr). Ranks run per country and source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .pairs import r6


def number(c: str) -> Column:
    return F.regexp_extract(c, r"-(\d+)$", 1)


def id_format(records: DataFrame) -> DataFrame:
    """(src, country, n, numeric, low, high, distinct) of the ids' numbers."""
    n = F.when(number("id") != "", number("id").cast("long"))
    return records.groupBy(F.col("src").cast("long").alias("src"), "country").agg(
        F.count("*").alias("n"), r6(F.avg(n.isNotNull().cast("int"))).alias("numeric"), F.min(n).alias("low"), F.max(n).alias("high"), F.count_distinct(n).alias("distinct")
    )


def owner_neighbours(links: DataFrame) -> DataFrame:
    """(source, links, same, random): neighbours by number within a source that have one owner, against chance.

    Chance is the sum of the owners' squared shares.
    """
    t = links.select(F.substring("c", 1, 2).alias("source"), "country", "q", number("c").cast("long").alias("n"))
    w = Window.partitionBy("source", "country").orderBy("n", "q")
    same = t.withColumn("same", (F.lag("q").over(w) == F.col("q")).cast("long")).groupBy("source").agg(F.count("*").alias("links"), F.coalesce(F.sum("same"), F.lit(0)).alias("same"))
    per = t.groupBy("source", "country", "q").agg(F.count("*").alias("m")).groupBy("source").agg(F.sum(F.col("m") * F.col("m")).alias("squares"))
    return same.join(per, "source").select("source", "links", "same", F.round(F.col("squares") / (F.col("links") * F.col("links")), 9).alias("random"))


def _marked(records: DataFrame, links: DataFrame) -> DataFrame:
    used = links.select("country", F.col("c").alias("id")).distinct().withColumn("matched", F.lit(1))
    return records.where("src <> 1").join(used, ["country", "id"], "left").na.fill(0, ["matched"])


def rank_spread(records: DataFrame, links: DataFrame) -> DataFrame:
    """(src, country, matched, n, q10, q50, q90): where matched and other records stand in the order of their numbers, 0 to 1."""
    w = Window.partitionBy("src", "country")
    m = _marked(records, links).withColumn("at", (F.row_number().over(w.orderBy(number("id").cast("long"), "id")) - 1) / F.count("*").over(w))
    return m.groupBy(F.col("src").cast("long").alias("src"), "country", "matched").agg(F.count("*").alias("n"), *[r6(F.percentile("at", x / 100)).alias(f"q{x}") for x in (10, 50, 90)])


def rank_offsets(records: DataFrame, links: DataFrame) -> DataFrame:
    """(source, n, mean, q10, q50, q90) of a record's rank less its entity's, by number within a source, 0 to 1."""
    w = Window.partitionBy("src")
    at = records.select("country", "id", "src", ((F.row_number().over(w.orderBy(number("id").cast("long"), "id")) - 1) / F.count("*").over(w)).alias("at"))
    t = links.join(at.select("country", F.col("id").alias("q"), F.col("at").alias("a")), ["country", "q"]).join(at.select("country", F.col("id").alias("c"), F.col("at").alias("b")), ["country", "c"])
    t = t.select(F.substring("c", 1, 2).alias("source"), (F.col("b") - F.col("a")).alias("off"))
    return t.groupBy("source").agg(F.count("*").alias("n"), r6(F.avg("off")).alias("mean"), *[r6(F.percentile("off", x / 100)).alias(f"q{x}") for x in (10, 50, 90)])


def signatures(records: DataFrame, links: DataFrame) -> DataFrame:
    """(src, feature, matched, other): means of record features over matched and other corpus records, and whether src 1 has the name."""
    s1 = records.where("src = 1").select(F.lower("raw_name").alias("_n")).distinct().withColumn("in_s1", F.lit(1))
    m = _marked(records, links).withColumn("_n", F.lower("raw_name")).join(s1, "_n", "left")
    name, addr = F.col("raw_name"), F.coalesce(F.col("raw_addr"), F.lit(""))
    tokens = F.filter(F.split(name, r"[ \t\n\r]+"), lambda v: v != "")
    features = {
        "name chars": F.length(name), "name tokens": F.size(tokens), "addr chars": F.length(addr), "addr empty": addr == "", "devanagari": name.rlike("[\\u0900-\\u097F]"),
        "junk marks": name.rlike(r"<<|>>|--|##|\*\*"), "all caps": (F.upper(name) == name) & (F.lower(name) != name), "all lower": (F.lower(name) == name) & (F.upper(name) != name),
        "digit in name": name.rlike("[0-9]"), "outer space": F.trim(name) != name, "double space": F.contains(name, F.lit("  ")), "postcode": addr.rlike(r"\b[0-9]{5,6}\b"), "name of src 1": F.col("in_s1").isNotNull(),
    }
    rows = m.select("src", "matched", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("double").alias("v")) for k, v in features.items()])).alias("f")).select("src", "matched", "f.*")
    return rows.groupBy(F.col("src").cast("long").alias("src"), "feature").agg(r6(F.avg(F.when(F.col("matched") == 1, F.col("v")))).alias("matched"), r6(F.avg(F.when(F.col("matched") == 0, F.col("v")))).alias("other"))


def twin_rates(records: DataFrame, links: DataFrame) -> DataFrame:
    """(matched, n, twins): S2 records, and those whose lower-cased raw name an S3 record of the country bears."""
    s3 = records.where("src = 3").select("country", F.lower("raw_name").alias("_n")).distinct().withColumn("twin", F.lit(1))
    m = _marked(records, links).where("src = 2").withColumn("_n", F.lower("raw_name")).join(s3, ["country", "_n"], "left")
    return m.groupBy("matched").agg(F.count("*").alias("n"), F.count("twin").alias("twins"))


def random_pairs(records: DataFrame, per_entity: int = 1) -> DataFrame:
    """(country, q, c): each entity with corpus records drawn without looking at texts - the background for pair statistics.

    Entities and records are numbered per country in the order of digests; an entity takes the records of the same number, so
    the draw is a join on numbers.
    """
    def placed(rows: DataFrame, to: str) -> DataFrame:
        w = Window.partitionBy("country")
        return rows.select("country", F.col("id").alias(to), (F.row_number().over(w.orderBy(F.md5(F.col("id").cast("binary")), "id")) - 1).alias("at"), F.count("*").over(w).alias("n"))

    a = placed(records.where("src = 1"), "q").select("country", "q", F.explode(F.sequence(F.lit(0), F.lit(per_entity - 1))).alias("k"), "at")
    b = placed(records.where("src <> 1"), "c")
    size = b.select("country", "n").distinct()
    a = a.join(size, "country").select("country", "q", F.pmod(F.col("at") * per_entity + F.col("k"), F.col("n")).alias("at"))
    return a.join(b.select("country", "c", "at"), ["country", "at"]).select("country", "q", "c")
