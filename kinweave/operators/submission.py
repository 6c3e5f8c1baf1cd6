"""Result rows, their validation and their profile."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F


def rows(scored: DataFrame, entities: DataFrame, to: str) -> DataFrame:
    """(q, to): a row per entity, its records joined by commas, best first; empty if none."""
    best = scored.groupBy("country", "q", "c").agg(F.max("p").alias("p")).groupBy("country", "q")
    best = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("o"), "c"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["c"]), ",")
    return entities.select("country", "q").join(best, ["country", "q"], "left").select("q", F.coalesce(text, F.lit("")).alias(to))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", escape="", emptyValue="")


def validate(matches: DataFrame, candidates: DataFrame, entities: DataFrame, corpus: DataFrame) -> DataFrame:
    """(check, n): offending rows of each rule; matches (q, ids), candidates (q, ids), corpus (id)."""
    m = matches.select("q", F.filter(F.split("ids", ","), lambda x: x != "").alias("m"))
    c = candidates.select("q", F.filter(F.split("ids", ","), lambda x: x != "").alias("c"))
    known = corpus.select(F.col("id").alias("x")).distinct()
    ids = m.select(F.explode("m").alias("x")).union(c.select(F.explode("c").alias("x")))
    checks = {
        "missing entity": entities.select("q").join(m, "q", "left_anti"),
        "extra entity": m.join(entities.select("q"), "q", "left_anti"),
        "repeated entity": m.groupBy("q").count().where("count > 1"),
        "bad prefix": ids.where(~F.col("x").rlike("^S[23]-")),
        "unknown record": ids.join(known, "x", "left_anti"),
        "repeated record": m.where(F.size(F.array_distinct("m")) < F.size("m")),
        "match not a candidate": m.join(c, "q").where(F.size(F.array_except("m", "c")) > 0),
    }
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def profile(accepted: DataFrame, cand: DataFrame, entities: DataFrame) -> DataFrame:
    """Per country and for ALL: entities, mean records, share without any, share of S2, mean candidates."""
    key = ["country", "q"]
    a = accepted.groupBy(*key).agg(F.count("*").alias("k"), F.sum(F.col("c").startswith("S2-").cast("long")).alias("s2"))
    n = cand.groupBy(*key).agg(F.count("*").alias("nc"))
    df = entities.select(*key).join(a, key, "left").join(n, key, "left").na.fill(0)
    out = df.rollup("country").agg(
        F.count("*").alias("entities"), F.round(F.avg("k"), 6).alias("mean_k"), F.round(F.avg((F.col("k") == 0).cast("int")), 6).alias("singletons"),
        F.round(F.when(F.sum("k") > 0, F.sum("s2") / F.sum("k")).otherwise(0.0), 6).alias("s2_share"), F.round(F.avg("nc"), 6).alias("mean_cand"),
    )
    return out.withColumn("country", F.coalesce("country", F.lit("ALL")))


def violations(accepted: DataFrame) -> DataFrame:
    """(contested, wrong, worst): records with several owners, links that must be wrong, the most owners of one."""
    n = accepted.groupBy("country", "c").agg(F.count_distinct("q").alias("n")).where("n > 1")
    return n.agg(F.count("*").alias("contested"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("wrong"), F.coalesce(F.max("n"), F.lit(0)).alias("worst"))


# Results by country that a later run may reuse.


def fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def safe_name(country: str) -> str:
    """A folder name for a country, different for different countries."""
    plain = "".join(c if c.isalnum() or c in "-_" else "_" for c in country)
    return plain if plain == country and country else f"{plain}-{hashlib.sha256(country.encode()).hexdigest()[:8]}"


def _path(folder: str, country: str) -> str:
    return f"{folder}/country={safe_name(country)}"


def write_partial(df: DataFrame, folder: str, country: str, config: dict) -> None:
    """A country's rows and, last, its manifest: rows, their order-free digest and the configuration's."""
    path = _path(folder, country)
    df.write.mode("overwrite").parquet(f"{path}/rows")
    kept = df.sparkSession.read.parquet(f"{path}/rows")
    n, digest = kept.agg(F.count("*"), F.coalesce(F.expr(f"bit_xor(xxhash64({', '.join(kept.columns)}))"), F.lit(0))).first()
    df.sparkSession.createDataFrame([(n, digest, fingerprint(config))], "n long, digest long, config string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def check_partial(spark: SparkSession, folder: str, country: str, config: dict) -> str | None:
    """None if a country's rows can be reused, else why not."""
    path = _path(folder, country)
    try:
        m = spark.read.parquet(f"{path}/manifest").first()
        kept = spark.read.parquet(f"{path}/rows")
        n, digest = kept.agg(F.count("*"), F.coalesce(F.expr(f"bit_xor(xxhash64({', '.join(kept.columns)}))"), F.lit(0))).first()
    except Exception as e:  # absent or not whole
        return f"no partial: {type(e).__name__}"
    if m["config"] != fingerprint(config):
        return "another configuration"
    return None if (n, digest) == (m["n"], m["digest"]) else "rows differ from the manifest"


def concat_partials(spark: SparkSession, folder: str, countries: list[str]) -> DataFrame:
    return spark.read.parquet(*[f"{_path(folder, c)}/rows" for c in countries])


def cardinality(spark: SparkSession, folder: str, country: str, column: str = "matched_ids") -> DataFrame:
    """(k, n): a finished country's rows by how many records they hold."""
    k = F.size(F.filter(F.split(column, ","), lambda x: x != ""))
    return spark.read.parquet(f"{_path(folder, country)}/rows").groupBy(k.cast("long").alias("k")).agg(F.count("*").alias("n"))


def write_result(spark: SparkSession, folder: str, countries: list[str], out: str) -> dict[str, int]:
    """Both result files (matches, candidates) of finished countries as tab-separated files with a header; rows, and rows with a match."""
    rows = concat_partials(spark, folder, countries)
    for column, to, name in (("matched_ids", "matched_entity_ids", "matches"), ("candidate_ids", "candidate_entity_ids", "candidates")):
        write_tsv(rows.select(F.col("q").alias("source1_entity_id"), F.col(column).alias(to)), f"{out}/{name}")
    n, hit = rows.agg(F.count("*"), F.sum((F.col("matched_ids") != "").cast("long"))).first()
    return {"rows": n, "with a match": hit or 0}


def clear(spark: SparkSession, folder: str, countries: list[str]) -> None:
    """Remove finished countries' rows and manifests, and nothing else."""
    for c in countries:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_path(folder, c))
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
