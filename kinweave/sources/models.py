"""Learnt tables read from JSON: absent files are None, broken ones raise."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.translit import Model


def read_json(path: str) -> tuple[dict, str] | None:
    """(content, SHA-256) of a driver-side configuration file."""
    p = Path(path)
    if not p.exists():
        return None
    raw = p.read_bytes()
    return json.loads(raw), hashlib.sha256(raw).hexdigest()


def _listed(spark: SparkSession, tables: dict) -> DataFrame:
    """Every entry of a mined grammar's tables, in the order of precedence: at, field, kind, q, c, w."""
    fields = ("name", "address")
    parts = [("abbrev", "name", tables.get("abbreviations", {}).get("name")), ("region", "address", tables.get("region_codes", {}).get("entries")), ("cover", "address", tables.get("abbreviations", {}).get("address"))]
    parts += [(kind, f, tables.get(of, {}).get(f)) for kind, of in (("cover", "acronyms"), ("forbid", "forbidden")) for f in fields]
    flat = [(kind, f, json.dumps(e)) for kind, f, entries in parts for e in entries or ()]  # a table of learnt entries, read on the driver
    raw = spark.createDataFrame([(i, *row) for i, row in enumerate(flat)], "at long, kind string, field string, entry string")
    e = raw.select("at", "kind", F.when(F.col("field") == "name", "name").otherwise("addr").alias("field"), F.from_json("entry", "s1 string, s2 string, long string, short string, direction string, p_s2_given_s1 double").alias("e"))
    one, many = F.array("e.short"), F.filter(F.split("e.long", r"\s+"), lambda t: t != "")
    q = F.when(F.col("e.s1").isNotNull(), F.array("e.s1")).when(F.col("e.direction") == "contract", many).when(F.col("e.direction") == "expand", one)
    c = F.when(F.col("e.s1").isNotNull(), F.array("e.s2")).when(F.col("e.direction") == "contract", one).when(F.col("e.direction") == "expand", many)
    w = F.when(F.col("kind") == "abbrev", F.col("e.p_s2_given_s1")).otherwise(1.0)
    return e.select("at", "field", "kind", F.array_distinct(q).alias("q"), F.array_distinct(c).alias("c"), w.alias("w"))


def grammar_entries(spark: SparkSession, tables: dict) -> DataFrame:
    """(field, kind, q, c, w) of a mined grammar. The first to name a pair keeps it: name abbreviations, region codes,
    address abbreviations, acronyms, forbidden pairs. Entries with foreign characters, weights outside 0 to 1 or a token on
    both sides are left out. Kind "cover" explains tokens without weight.
    """
    plain = F.forall(F.concat("q", "c"), lambda t: t.rlike(r"^[0-9a-z]+\z"))
    fit = (F.size("q") > 0) & (F.size("c") > 0) & plain & F.col("w").between(0, 1) & ~F.arrays_overlap("q", "c")
    first = Window.partitionBy("field", "q", "c").orderBy("at")
    return _listed(spark, tables).where(fit).withColumn("r", F.row_number().over(first)).where("r = 1").orderBy("at").select("field", "kind", "q", "c", "w")


def load_grammar(spark: SparkSession, path: str) -> DataFrame | None:
    got = read_json(path)
    return None if got is None else grammar_entries(spark, got[0])


def load_translit(path: str) -> Model | None:
    """A learnt transliteration (lexicon, tables, opts), for with_norm."""
    got = read_json(path)
    return None if got is None else Model(**{k: dict(got[0][k]) for k in ("lexicon", "tables", "opts")})
