"""Features of candidate pairs and of records."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from . import index
from .retrieval import CHANNELS


#: Entries up to which a grammar is broadcast.
SMALL_GRAMMAR = 20_000


def _sets(name: Column, addr: Column) -> list[Column]:
    n, a = tx.tokens(name), tx.tokens(addr)
    led = F.filter(F.array_union(n, a), lambda t: t.rlike("^[0-9]"))
    return [name.alias("name"), addr.alias("addr"), F.length(name).alias("len"), n.alias("n"), a.alias("a"), led.alias("d"), tx.ngrams(name).alias("g")]


def record_sets(records: DataFrame) -> DataFrame:
    """A record's token sets: name (n), address (a), digit-led tokens (d), name 4-grams (g)."""
    return records.select("country", "id", *_sets(F.col("name"), F.col("addr")))


def with_sets(cand: DataFrame, records: DataFrame) -> DataFrame:
    """Candidates with both records' sets as structs x (query) and y (candidate).

    The joins carry the two texts alone. The sets, several times as wide, are made of them behind the joins, and of those
    only what is read.
    """
    texts = records.select("country", "id", "name", "addr")
    q = texts.select("country", F.col("id").alias("q"), F.col("name").alias("_xn"), F.col("addr").alias("_xa"))
    c = texts.select("country", F.col("id").alias("c"), F.col("name").alias("_yn"), F.col("addr").alias("_ya"))
    both = cand.join(c, ["country", "c"]).join(q, ["country", "q"])
    return both.select(*cand.columns, F.struct(*_sets(F.col("_xn"), F.col("_xa"))).alias("x"), F.struct(*_sets(F.col("_yn"), F.col("_ya"))).alias("y"))


def with_texts(links: DataFrame, records: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(country, q, c, x, y): links with the fields of both records, moved once to each of the two."""
    x, y = (records.select("country", F.col("id").alias(k), F.struct(*fields).alias(to)) for k, to in (("q", "x"), ("c", "y")))
    return links.select("country", "q", "c").join(y, ["country", "c"]).join(x, ["country", "q"])


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _shared(f: str) -> Column:
    return F.size(F.array_intersect(F.col(f"x.{f}"), F.col(f"y.{f}")))


def jaccard(f: str) -> Column:
    return ratio(_shared(f), F.size(F.col(f"x.{f}")) + F.size(F.col(f"y.{f}")) - _shared(f))


def containment(f: str) -> Column:
    return ratio(_shared(f), F.least(F.size(F.col(f"x.{f}")), F.size(F.col(f"y.{f}"))))


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


_STRING = "country string, q string, c string, nm_jac double, nm_cont double, nm_4gram double, nm_exact int, nm_lenratio double, ad_jac double, ad_cont double, ad_empty_q int, ad_empty_c int"


def string_features(sets: DataFrame) -> DataFrame:
    """Name and address likeness of (country, q, c). Only the texts go to Arrow batches, and within one each distinct pair of
    them is compared once: in Spark, set functions are interpreted row by row."""
    texts = sets.select("country", "q", "c", *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for f in ("name", "addr") for s in ("x", "y")])
    return texts.mapInArrow(_likeness, _STRING)


def _over(a: float, b: float) -> float:
    return math.floor(a / b * 1e6 + 0.5) / 1e6 if b > 0 else 0.0


def _token_set(s: str) -> frozenset[str]:
    return frozenset(t for t in s.split(" ") if t)


def _of_addresses(x: frozenset[str], y: frozenset[str]) -> tuple:
    i = len(x & y)
    return _over(i, len(x) + len(y) - i), _over(i, min(len(x), len(y))), not x, not y


@lru_cache(1 << 16)
def _of_names(x: str, y: str) -> tuple:
    (a, g), (b, h) = ((_token_set(s), {t[i : i + 4] for t in [s.replace(" ", "")] for i in range(len(t) - 3)}) for s in (x, y))
    i, j = len(a & b), len(g & h)
    return _over(i, len(a) + len(b) - i), _over(i, min(len(a), len(b))), _over(j, len(g) + len(h) - j), x == y != "", _over(min(len(x), len(y)), max(len(x), len(y)))


def _distinct(x: pa.Array, y: pa.Array, of: Callable, prepare: Callable) -> np.ndarray:
    """of(x, y) of each row, as columns."""
    codes = pa.concat_arrays([x, y]).dictionary_encode()
    words, at = [prepare(t) for t in codes.dictionary.to_pylist()], codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pair, back = np.unique(at[: len(x)] * len(words) + at[len(x) :], return_inverse=True)
    first, second = np.divmod(pair, len(words))
    return np.array([of(words[i], words[j]) for i, j in zip(first.tolist(), second.tolist())], float)[back].T


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            name = _distinct(b["x_name"], b["y_name"], _of_names, str)
            addr = _distinct(b["x_addr"], b["y_addr"], _of_addresses, _token_set)
            flags = [pa.array(v.astype(np.int32)) for v in (name[3], addr[2], addr[3])]
            columns = [b["country"], b["q"], b["c"], *map(pa.array, name[:3]), flags[0], pa.array(name[4]), *map(pa.array, addr[:2]), *flags[1:]]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _STRING.split(", ")])


def digit_features(sets: DataFrame) -> DataFrame:
    both = (F.size("x.d") > 0) & (F.size("y.d") > 0)
    return sets.select("country", "q", "c", r6(jaccard("d")).alias("dg_jac"), _shared("d").alias("dg_shared"), both.cast("int").alias("dg_both_have"))


def geometry(cand: DataFrame, names: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Where a pair stands among its query's candidates; ranks count from 0 and ties share the best."""
    group = Window.partitionBy("country", "q")
    top = F.max("max_chan").over(group)
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    chan = sum((F.when(F.col(n) > 0, 1).otherwise(0) for n in names[1:]), F.when(F.col(names[0]) > 0, 1).otherwise(0))
    return cand.select(
        "country", "q", "c", r6(F.col("max_chan")).alias("max_chan"), r6(total).alias("sum_chan"), chan.cast("long").alias("n_chan"),
        (F.rank().over(group.orderBy(F.desc("max_chan"))) - 1).cast("long").alias("rank"), F.count("*").over(group).alias("n_cand"),
        r6(top - F.col("max_chan")).alias("gap_top"), r6(F.col("max_chan") / F.greatest(top, F.lit(1e-6))).alias("ratio_top"), F.col("c").startswith("S3-").cast("int").alias("is_s3"),
    )


def name_dup(records: DataFrame) -> DataFrame:
    """(country, id, name_dup): other src-1 records of the whole country with the same name; 0 for the empty name."""
    s1 = records.where("src = 1")
    same = s1.groupBy("country", "name").agg((F.count("*") - 1).alias("name_dup"))
    return s1.join(same, ["country", "name"]).select("country", "id", F.when(F.col("name") == "", 0).otherwise(F.col("name_dup")).cast("long").alias("name_dup"))


def rare_shared(sets: DataFrame, records: DataFrame, cap: int) -> DataFrame:
    """(country, q, c, nm_rare_shared): the greatest idf of a shared name token, 0 if none survives the cap."""
    tok = sets.select("country", "q", "c", F.explode_outer(F.array_intersect("x.n", "y.n")).alias("token"))
    hit = tok.join(index.idf(records, "name", cap), ["country", "token"], "left")
    return hit.groupBy("country", "q", "c").agg(r6(F.coalesce(F.max("idf"), F.lit(0.0))).alias("nm_rare_shared"))


RELATIVE = ("nm_jac", "nm_cont", "nm_4gram", "ad_jac", "ad_cont", "dg_jac", "nm_lenratio")


def relative(features: DataFrame, names: tuple[str, ...] = RELATIVE) -> DataFrame:
    """Gap to the entity's best and competition rank, per feature and for nm_4gram + ad_cont; n_near_combo within 0.1."""
    group = Window.partitionBy("country", "q")
    df = features.withColumn("combo", F.col("nm_4gram") + F.col("ad_cont"))
    out = ["country", "q", "c"]
    for n in (*names, "combo"):
        out += [r6(F.max(n).over(group) - F.col(n)).alias(f"{n}_gap"), (F.rank().over(group.orderBy(F.desc(n))) - 1).cast("long").alias(f"{n}_rank")]
    df = df.select(*out)
    return df.withColumn("n_near_combo", F.sum(F.when(F.col("combo_gap") <= 0.1, 1).otherwise(0)).over(group))


def record_flags(records: DataFrame, column: str) -> DataFrame:
    """Marks of a raw name: length, case, double spaces, junk before or behind (a run of full stops alone is none)."""
    s = F.col(column)
    words = F.size(F.filter(F.split(s, r"[\s\p{Z}]+"), lambda t: t != ""))
    tail = F.regexp_extract(s, r"([\p{P}\p{S}]+)$", 1)
    junk = s.rlike(r"^[\p{P}\p{S}]") | ((tail != "") & ~tail.rlike(r"^\.+$"))
    return records.select(
        "country", "id", words.cast("long").alias("n_tokens"), F.char_length(s).cast("long").alias("n_chars"),
        ((F.upper(s) == s) & (F.lower(s) != s)).cast("int").alias("all_caps"), ((F.lower(s) == s) & (F.upper(s) != s)).cast("int").alias("all_lower"),
        s.contains("  ").cast("int").alias("double_space"), junk.cast("int").alias("junk_affix"),
    )


def grammar_features(sets: DataFrame, grammar: DataFrame) -> DataFrame:
    """Effects of a corruption grammar (field, kind, q, c, w): an entry fires if its q tokens are the query's alone and its
    c tokens the candidate's alone. Kinds: abbrev, region, forbid. A forbidden entry whose tokens other entries explain is void.

    abbrev_matched sums the fired name abbreviations' weights, abbrev_jaccard counts explained tokens as shared, forbidden
    counts fired forbidden entries of both fields and region the fired region entries of addresses. The grammar is a
    configuration of some hundred entries, broadcast up to SMALL_GRAMMAR of them.
    """
    sides = sets.select("country", "q", "c", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.array_except(f"x.{k}", f"y.{k}").alias("xo"), F.array_except(f"y.{k}", f"x.{k}").alias("yo")) for f, k in (("name", "n"), ("addr", "a"))
    ])).alias("s")).select("country", "q", "c", "s.*")
    g = grammar.select("field", "kind", F.col("q").alias("gq"), F.col("c").alias("gc"), "w")
    g = F.broadcast(g) if grammar.count() <= SMALL_GRAMMAR else g
    fired = sides.join(g, "field").where((F.size(F.array_except("gq", "xo")) == 0) & (F.size(F.array_except("gc", "yo")) == 0))
    by_pair = fired.groupBy("country", "q", "c", "field").agg(
        F.sum(F.when(F.col("kind") == "abbrev", F.col("w")).otherwise(0.0)).alias("w"), F.sum(F.when(F.col("kind") == "region", 1).otherwise(0)).alias("region"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kind") != "forbid", F.col("gq"))))).alias("eq"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kind") != "forbid", F.col("gc"))))).alias("ec"),
        F.collect_list(F.when(F.col("kind") == "forbid", F.struct("gq", "gc"))).alias("bad"),
    )
    hits = F.size(F.filter("bad", lambda b: (F.size(F.array_except(b["gq"], "eq")) > 0) | (F.size(F.array_except(b["gc"], "ec")) > 0)))
    name = by_pair.where("field = 'name'").select("country", "q", "c", "w", F.least(F.size("eq"), F.size("ec")).alias("e"))
    both = by_pair.select("country", "q", "c", hits.alias("hits"), F.when(F.col("field") == "addr", F.col("region")).otherwise(0).alias("region"))
    both = both.groupBy("country", "q", "c").agg(F.sum("hits").alias("hits"), F.sum("region").alias("region"))
    df = sets.join(name, ["country", "q", "c"], "left").join(both, ["country", "q", "c"], "left")
    i, e = _shared("n"), F.coalesce("e", F.lit(0))
    return df.select(
        "country", "q", "c", r6(F.coalesce("w", F.lit(0.0))).alias("abbrev_matched"), r6(ratio(i + e, F.size("x.n") + F.size("y.n") - i - e)).alias("abbrev_jaccard"),
        F.coalesce("hits", F.lit(0)).cast("long").alias("forbidden"), F.coalesce("region", F.lit(0)).cast("long").alias("region"),
    )


def triangulation(scored: DataFrame, sets: DataFrame, anchors: int = 10) -> DataFrame:
    """How a pair agrees with its entity's other best candidates (the anchors, at most `anchors` by p).

    tri_nm: best 4-gram likeness to an anchor times its p; tri_nm_p: that anchor's p; tri_dg and tri_dg_p the same for
    digits; tri_conf: anchors above one half that share a digit token; tri_rank: rank by p; tri_p: p; tri_xsrc: best p of the
    other source; tri_xsrc_top: whether the entity's best candidate is of the other source. Every pair meets at most
    `anchors` rows.
    """
    w = Window.partitionBy("country", "q").orderBy(F.desc("p"), "c")
    rows = scored.join(sets.select("country", "q", "c", "y"), ["country", "q", "c"]).withColumn("r", F.row_number().over(w))
    near = rows.where(F.col("r") <= anchors + 1).select("country", "q", F.col("c").alias("j"), F.col("p").alias("pj"), F.col("r").alias("rj"), F.col("y").alias("z"))
    pairs = rows.join(near, ["country", "q"], "left").where("j is null or c <> j")
    pairs = pairs.where((F.col("rj") - F.when(F.col("r") < F.col("rj"), 1).otherwise(0)) <= anchors)

    def like(f: str) -> Column:
        shared = F.size(F.array_intersect(f"y.{f}", f"z.{f}"))
        return ratio(shared, F.size(f"y.{f}") + F.size(f"z.{f}") - shared)

    nm, dg = r6(like("g") * F.col("pj")), r6(like("d") * F.col("pj"))
    pairs = pairs.withColumn("nm", nm).withColumn("dg", dg)
    got = pairs.groupBy("country", "q", "c").agg(
        F.max(F.struct("nm", "pj")).alias("a"), F.max(F.struct("dg", "pj")).alias("b"),
        F.sum(F.when((F.col("pj") > 0.5) & F.arrays_overlap("y.d", "z.d"), 1).otherwise(0)).alias("tri_conf"),
        F.max(F.when(F.col("c").startswith("S3-") != F.col("j").startswith("S3-"), F.col("pj"))).alias("x"),
    )
    group = Window.partitionBy("country", "q")
    top = F.max(F.when(F.col("r") == 1, F.col("c").startswith("S3-"))).over(group)
    base = rows.withColumn("top", top).select("country", "q", "c", "p", (F.col("top") != F.col("c").startswith("S3-")).cast("int").alias("tri_xsrc_top"), F.rank().over(Window.partitionBy("country", "q").orderBy(F.desc("p"))).alias("rk"))
    z = F.lit(0.0)
    return base.join(got, ["country", "q", "c"], "left").select(
        "country", "q", "c", F.coalesce("a.nm", z).alias("tri_nm"), F.coalesce("a.pj", z).alias("tri_nm_p"), F.coalesce("b.dg", z).alias("tri_dg"), F.coalesce("b.pj", z).alias("tri_dg_p"),
        F.coalesce("tri_conf", F.lit(0)).cast("long").alias("tri_conf"), (F.col("rk") - 1).cast("long").alias("tri_rank"), F.col("p").alias("tri_p"), F.coalesce("x", z).alias("tri_xsrc"), "tri_xsrc_top",
    )
