"""Evaluation, audits and diagnostics of links, candidates and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..checkpoints import kept
from ..functions import text as tx
from . import index
from .decision import entity_scores, f05
from .pairs import r6
from .retrieval import CHANNELS


def blocking_recall(cand: DataFrame, truth: DataFrame, names: tuple[str, ...] = CHANNELS) -> DataFrame:
    """(channel, found, links, recall) for each channel and for all of them."""
    hit = truth.join(cand, ["country", "q", "c"], "left")
    kinds = [F.struct(F.lit(n).alias("channel"), (F.coalesce(F.col(n), F.lit(0.0)) > 0).alias("hit")) for n in names]
    kinds.append(F.struct(F.lit("any").alias("channel"), F.col("max_chan").isNotNull().alias("hit")))
    rows = hit.select(F.explode(F.array(*kinds)).alias("k")).select("k.*")
    out = rows.groupBy("channel").agg(F.sum(F.col("hit").cast("long")).alias("found"), F.count("*").alias("links"))
    return out.withColumn("recall", r6(F.col("found") / F.col("links")))


def blocking_ceiling(cand: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """Per country: a perfect matcher's F0.5 on these candidates, whole entities found, candidates an entity (mean, median, p95, most, none)."""
    right = cand.join(truth.select("country", "q", "c").distinct(), ["country", "q", "c"], "left_semi")
    s = entity_scores(right, truth, entities)
    n = cand.groupBy("country", "q").agg(F.count("*").alias("n_cand"))
    s = s.join(n, ["country", "q"], "left").na.fill(0, ["n_cand"])
    return s.groupBy("country").agg(
        r6(F.avg(f05(F.col("hit"), F.col("n"), F.col("hit")))).alias("ceiling"), r6(F.avg((F.col("hit") == F.col("n")).cast("int"))).alias("complete"),
        r6(F.avg("n_cand")).alias("mean_cand"), r6(F.percentile("n_cand", 0.5)).alias("median_cand"), r6(F.percentile("n_cand", 0.95)).alias("p95_cand"),
        F.max("n_cand").alias("max_cand"), F.sum((F.col("n_cand") == 0).cast("long")).alias("no_cand"),
    )


def errors(scored: DataFrame, accepted: DataFrame, truth: DataFrame) -> DataFrame:
    """scored with rank, yes (true) and got (accepted)."""
    key = ["country", "q", "c"]
    w = Window.partitionBy("country", "q").orderBy(F.desc("p"), "c")
    df = scored.join(truth.select(*key).distinct().withColumn("yes", F.lit(1)), key, "left").join(accepted.select(*key).distinct().withColumn("got", F.lit(1)), key, "left")
    return df.na.fill(0, ["yes", "got"]).withColumn("rank", F.row_number().over(w) - 1)


def false_positives(err: DataFrame, owner: DataFrame, records: DataFrame) -> DataFrame:
    """(category, digit, n): whose record was taken - a chain's (same name), a sibling's, nobody's - and whether digits agree."""
    fp = err.where("got = 1 and yes = 0").join(owner, ["country", "c"], "left")
    s = records.select("country", "id", "name", tx.digit_tokens(tx.tokens(F.concat_ws(" ", "name", "addr"))).alias("d"))
    fp = fp.join(s.select("country", F.col("id").alias("q"), F.col("name").alias("qn"), F.col("d").alias("qd")), ["country", "q"])
    fp = fp.join(s.select("country", F.col("id").alias("c"), F.col("d").alias("cd")), ["country", "c"])
    fp = fp.join(s.select("country", F.col("id").alias("owner"), F.col("name").alias("on")), ["country", "owner"], "left")
    cat = F.when(F.col("owner").isNull(), "distractor").when(F.col("qn") == F.col("on"), "chain").otherwise("sibling")
    return fp.groupBy(cat.alias("category"), F.arrays_overlap("qd", "cd").cast("int").alias("digit")).agg(F.count("*").alias("n"))


def false_negatives(err: DataFrame) -> DataFrame:
    """(category, n): ranked out (a wrong one was taken), stopped early (only right ones stand before it), buried."""
    w = Window.partitionBy("country", "q")
    k = F.sum("got").over(w)
    wrong_taken = F.sum(F.when((F.col("got") == 1) & (F.col("yes") == 0), 1).otherwise(0)).over(w)
    before = F.sum(F.when((F.col("got") == 0) & (F.col("yes") == 0), 1).otherwise(0)).over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cat = F.when(F.col("_w") > 0, "ranked out").when(F.col("_b") == 0, "stopped early").otherwise("buried")
    df = err.withColumn("_k", k).withColumn("_w", wrong_taken).withColumn("_b", before).where("yes = 1 and got = 0")
    return df.groupBy(cat.alias("category")).agg(F.count("*").alias("n"))


def misses(cand: DataFrame, truth: DataFrame, records: DataFrame, name_cap: int, addr_cap: int) -> DataFrame:
    """(category, n) of true links that no channel retrieved: reachable (a shared token survives its cap), too common, or without any shared token.

    Both sides are read from compressed files, a small part of what their rows take in memory, so neither may be broadcast for its size.
    """
    lost = kept(truth.join(cand.select("country", "q", "c").hint("merge"), ["country", "q", "c"], "left_anti"))
    least = least_shared_df(lost, records)
    cat = (
        F.when((F.col("name_df") <= name_cap) | (F.col("addr_df") <= addr_cap), "reachable").when(F.col("addr_df").isNotNull(), "address too common")
        .when(F.col("name_df").isNotNull(), "name too common").otherwise("no signal")
    )
    return least.groupBy(cat.alias("category")).agg(F.count("*").alias("n"))


def least_shared_df(links: DataFrame, records: DataFrame) -> DataFrame:
    """links with name_df and addr_df: the least document frequency of a shared token, null if none is shared.

    Links move once to each of their records, whatever their size seems to be; frequencies are looked up for shared tokens alone.
    """
    fields = ("name", "addr")
    toks = F.struct(*[tx.tokens(F.col(f)).alias(f) for f in fields])
    x, y = (records.select("country", F.col("id").alias(k), toks.alias(to)) for k, to in (("q", "x"), ("c", "y")))
    both = links.select("country", "q", "c").hint("merge").join(y, ["country", "c"], "left").hint("merge").join(x, ["country", "q"], "left")
    none = F.array().cast("array<struct<field:string,token:string>>")

    def shared(f: str) -> Column:
        return F.coalesce(F.transform(F.array_intersect(f"x.{f}", f"y.{f}"), lambda t: F.struct(F.lit(f).alias("field"), t.alias("token"))), none)

    rows = both.select("country", "q", "c", F.explode_outer(F.concat(*map(shared, fields))).alias("t")).select("country", "q", "c", "t.field", "t.token")
    name, addr = (index.document_frequency(records, f).withColumn("field", F.lit(f)) for f in fields)
    rows = rows.join(name.unionByName(addr), ["country", "field", "token"], "left")
    return rows.groupBy("country", "q", "c").agg(*[F.min(F.when(F.col("field") == f, F.col("df"))).alias(f"{f}_df") for f in fields])


def cap_frontier(links: DataFrame, records: DataFrame, caps: tuple[int, ...]) -> DataFrame:
    """(cap, name, addr, either): share of links with a shared token within the cap."""
    least = least_shared_df(links, records)
    rows = least.select(F.explode(F.array(*[F.lit(c) for c in caps])).alias("cap"), "name_df", "addr_df")
    n, a = F.coalesce(F.col("name_df") <= F.col("cap"), F.lit(False)), F.coalesce(F.col("addr_df") <= F.col("cap"), F.lit(False))
    return rows.groupBy(F.col("cap").cast("long").alias("cap")).agg(*[r6(F.avg(x.cast("int"))).alias(k) for k, x in (("name", n), ("addr", a), ("either", n | a))])


def channel_strata(cand: DataFrame, truth: DataFrame) -> DataFrame:
    """(country, source, links, recall): with totals over either and both (ALL)."""
    hit = truth.join(cand.select("country", "q", "c", F.lit(1).alias("h")), ["country", "q", "c"], "left").withColumn("source", F.substring("c", 1, 2))
    out = hit.cube("country", "source").agg(F.count("*").alias("links"), r6(F.avg(F.coalesce("h", F.lit(0)))).alias("recall"))
    return out.select(F.coalesce("country", F.lit("ALL")).alias("country"), F.coalesce("source", F.lit("ALL")).alias("source"), "links", "recall")


def record_reuse(truth: DataFrame) -> DataFrame:
    """(uses, n): records by the number of entities that claim them."""
    return truth.groupBy("c").agg(F.count_distinct("q").alias("uses")).groupBy("uses").agg(F.count("*").alias("n"))


def country_crossing(truth: DataFrame, records: DataFrame) -> DataFrame:
    """(links, crossing): links whose two records are of different countries."""
    r = records.select("id", F.col("country").alias("k"))
    t = truth.join(r.select(F.col("id").alias("q"), F.col("k").alias("a")), "q").join(r.select(F.col("id").alias("c"), F.col("k").alias("b")), "c")
    return t.agg(F.count("*").alias("links"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("crossing"))


def joint_counts(truth: DataFrame, entities: DataFrame) -> DataFrame:
    """(n_s2, n_s3, n): entities by their matches in either source."""
    t = truth.groupBy("country", "q").agg(F.sum(F.col("c").startswith("S2-").cast("long")).alias("n_s2"), F.sum(F.col("c").startswith("S3-").cast("long")).alias("n_s3"))
    return entities.select("country", "q").join(t, ["country", "q"], "left").na.fill(0).groupBy("n_s2", "n_s3").agg(F.count("*").alias("n"))


def distractors(truth: DataFrame, records: DataFrame) -> DataFrame:
    """(src, records, matched, distractor_share) of the corpus."""
    used = truth.select("country", F.col("c").alias("id")).distinct().withColumn("m", F.lit(1))
    out = records.where("src <> 1").join(used, ["country", "id"], "left").groupBy(F.col("src").cast("long").alias("src")).agg(F.count("*").alias("records"), F.coalesce(F.sum("m"), F.lit(0)).alias("matched"))
    return out.withColumn("distractor_share", r6(1 - F.col("matched") / F.col("records")))


def separability(pairs: DataFrame) -> DataFrame:
    """(kind, n, ...) of labelled pairs (kind, nm_jac, ad_jac, nm_exact, dg_shared): what tells true pairs from others."""
    return pairs.groupBy("kind").agg(
        F.count("*").alias("n"), r6(F.avg("nm_exact")).alias("name_equal"), r6(F.avg("nm_jac")).alias("nm_mean"), r6(F.percentile("nm_jac", 0.5)).alias("nm_median"),
        r6(F.avg((F.col("nm_jac") == 0).cast("int"))).alias("nm_zero"), r6(F.avg((F.col("nm_jac") >= 0.5).cast("int"))).alias("nm_half"), r6(F.avg("ad_jac")).alias("ad_mean"), r6(F.avg((F.col("dg_shared") > 0).cast("int"))).alias("digit"),
    )


def chain_groups(records: DataFrame) -> DataFrame:
    """(country, size, groups): names that several src-1 records share."""
    g = records.where("src = 1 and name <> ''").groupBy("country", "name").agg(F.count("*").alias("size")).where("size > 1")
    return g.groupBy("country", "size").agg(F.count("*").alias("groups"))


def frequent_tokens(records: DataFrame, column: str, limit: int = 25) -> DataFrame:
    """The commonest tokens by records: a top list."""
    t = index.exploded(records, column).groupBy("token").agg(F.count("*").alias("n"))
    return t.orderBy(F.desc("n"), "token").limit(limit)


def script_presence(records: DataFrame, column: str) -> DataFrame:
    """(src, records, devanagari, non_ascii)."""
    s = F.col(column)
    return records.groupBy(F.col("src").cast("long").alias("src")).agg(F.count("*").alias("records"), F.sum(s.rlike("[\\u0900-\\u097F]").cast("long")).alias("devanagari"), F.sum(s.rlike("[^\\x00-\\x7F]").cast("long")).alias("non_ascii"))


def id_adjacency(truth: DataFrame) -> DataFrame:
    """(links, adjacent): records next to each other by number within a source that have one owner."""
    num = F.regexp_extract("c", r"-(\d+)$", 1).cast("long")
    w = Window.partitionBy("country", F.substring("c", 1, 2)).orderBy(num)
    t = truth.withColumn("same", (F.lag("q").over(w) == F.col("q")).cast("long"))
    return t.agg(F.count("*").alias("links"), F.coalesce(F.sum("same"), F.lit(0)).alias("adjacent"))


def id_correlation(truth: DataFrame) -> DataFrame:
    """(country, spearman): correlation of the ranks of the two records' numbers."""
    a, b = (F.regexp_extract(c, r"-(\d+)$", 1).cast("long") for c in ("q", "c"))
    t = truth.select("country", a.alias("a"), b.alias("b"))

    def rank(c: str):
        w = Window.partitionBy("country").orderBy(c)
        return F.rank().over(w) + (F.count("*").over(Window.partitionBy("country", c)) - 1) / 2

    return t.select("country", rank("a").alias("x"), rank("b").alias("y")).groupBy("country").agg(r6(F.corr("x", "y")).alias("spearman"))
