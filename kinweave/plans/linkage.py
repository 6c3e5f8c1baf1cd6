"""The linkage queries: each name with its Spark plan and its DuckDB statement."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..checkpoints import cut, kept, shared_dir
from ..functions import text as tx, translit
from ..operators import decision, evaluate, index, mining, pairs, probes, retrieval, scoring, submission, translit_mining
from ..sources import records as src
from . import oracle
from .oracle import K, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# A small literal grammar over the test tables' words: (field, kind, query tokens, candidate tokens, weight).
GRAMMAR = [
    ("name", "abbrev", ["large"], ["small"], 0.45), ("name", "abbrev", ["steel"], ["brass"], 0.6), ("name", "abbrev", ["ring", "bolt"], ["nut"], 0.7),
    ("name", "forbid", ["red"], ["blue"], 1.0), ("name", "forbid", ["large"], ["small"], 1.0), ("addr", "region", ["brand", "1"], ["brand", "2"], 1.0), ("addr", "abbrev", ["11"], ["12"], 0.5),
]
#: Pairs of normal forms with abbreviations, acronyms, region codes, typing errors, swaps and reorders: country, c, field, x, y, times.
WRITTEN = [
    ("x", "S2-1", "name", "sharma global corporation", "sharma global corp", 6), ("y", "S3-1", "name", "acme trading corporation", "acme trading corp", 3), ("x", "S2-2", "name", "state bank india limited", "sbi limited", 4),
    ("x", "S3-2", "name", "ibm services group", "international business machines services group", 3), ("x", "S2-3", "name", "sharma medical store", "sharma medicl store", 5), ("x", "S2-4", "addr", "12 mill road pune maharashtra", "12 mill rd pune mh", 7),
    ("y", "S3-3", "addr", "4 high street austin texas", "4 high st austin tx", 6), ("x", "S3-4", "addr", "9 temple lane uttar pradesh", "9 temple lane up", 5), ("y", "S2-5", "name", "global foods incorporated", "foods global corporation", 2), ("y", "S2-6", "name", "", "foods", 1),
]
#: Negative categories' shares of the negative weight.
MIX = {"same_name": 0.4, "sibling": 0.3, "blocker": 0.3}
CAPS = (5, 10, 20, 50, 100, 500)


class Work:
    """The frames that queries share, made once over one directory and cut: one plan feeds many queries."""

    last: tuple[tuple, Work] | None = None

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Work:
        """The work of the last call if session, directory and its files are the same, else a new one."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/part.parquet")
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        key = (spark.sparkContext.applicationId, sf_dir, status.getModificationTime(), status.getLen())
        if cls.last is None or cls.last[0] != key:
            cls.forget()
            cls.last = (key, cls(spark, sf_dir))
        return cls.last[1]

    @classmethod
    def forget(cls) -> None:
        """Drop the last call's work, so that the next starts from the files."""
        if cls.last is not None:
            records = cls.last[1].__dict__.get("records")
            if records is not None:
                records.unpersist()
            cls.last = None

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @cached_property
    def records(self) -> DataFrame:
        raw = src.part_records(self.spark, self.dir)
        return (raw.withColumn("name", tx.norm_ascii(F.col("raw_name"))).withColumn("addr", tx.norm_ascii(F.col("raw_addr")))).cache()

    @cached_property
    def entities(self) -> DataFrame:
        return self.records.where("src = 1").select("country", F.col("id").alias("q"))

    @cached_property
    def cand(self) -> DataFrame:
        return kept(retrieval.candidates(self.records, K))

    @cached_property
    def sets(self) -> DataFrame:
        return pairs.with_sets(self.cand, self.records)

    @cached_property
    def features(self) -> DataFrame:
        return kept(pairs.string_features(self.sets))

    @cached_property
    def scored(self) -> DataFrame:
        return kept(scoring.simple_score(pairs.string_features(self.sets)))

    @cached_property
    def p_zero(self) -> DataFrame:
        return kept(decision.product_p_zero(self.scored, self.entities))

    @cached_property
    def accepted(self) -> DataFrame:
        return kept(decision.choose_k(self.scored, self.p_zero))

    @cached_property
    def owner(self) -> DataFrame:
        return kept(retrieval.nearest_owner(self.records))

    @cached_property
    def truth(self) -> DataFrame:
        return self.owner.select("country", F.col("owner").alias("q"), "c")

    @cached_property
    def blocks(self) -> DataFrame:
        return kept(retrieval.block_owner(self.records))

    @cached_property
    def mined(self) -> DataFrame:
        """Events of the candidates' names and addresses and of some written pairs that hold every kind of event."""
        fields = ("name", "addr")
        each = [F.struct(F.lit(f).alias("field"), F.col(f"x.{f}").alias("x"), F.col(f"y.{f}").alias("y")) for f in fields]
        both = pairs.with_texts(self.cand, self.records, fields).select("country", "c", F.explode(F.array(*each)).alias("t")).select("country", "c", "t.*")
        written = self.spark.createDataFrame(WRITTEN, "country string, c string, field string, x string, y string, n int")
        written = written.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
        return kept(mining.mine(both.unionByName(written)))

    @cached_property
    def events(self) -> DataFrame:
        return kept(mining.event_table(self.mined))

    @cached_property
    def errors(self) -> DataFrame:
        return evaluate.errors(self.scored, self.accepted, self.truth)

    @cached_property
    def near(self) -> DataFrame:
        return kept(retrieval.neighbours(self.records, "name", K.name_df_cap, K.name_top_k))

    def texts(self, links: DataFrame, field: str) -> DataFrame:
        """links with both records' field as x and y."""
        both = pairs.with_texts(links, self.records, (field,))
        return both.select("country", "q", "c", F.col(f"x.{field}").alias("x"), F.col(f"y.{field}").alias("y"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, statement: str | None = None):
    def register(f: Callable[[Work], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Work.of(spark, sf_dir))
        if statement is not None:
            ORACLES[name] = statement
        return f

    return register


def r6(c: str) -> str:
    return f"round({c}, 6)"


# Sources and text.

query("s1_counts", sql("SELECT country, count(*) AS n FROM r WHERE src = 1 GROUP BY ALL"))(lambda w: src.counts_by(w.records.where("src = 1")))
query("load_shard", sql("SELECT id, name, addr FROM r WHERE country = 'PROMO'"))(lambda w: _shard(w, "PROMO"))



def _shard(w: Work, country: str) -> DataFrame:
    """One country's records, written as three partitioned sources and loaded again."""
    root = f"{shared_dir(w.spark)}/kinweave-shards-{uuid.uuid4().hex}"
    for n in (1, 2, 3):
        one = src.part_records(w.spark, w.dir).where(F.col("src") == n)
        src.write_partitioned(one.select(F.col("id").alias("entity_id"), F.col("raw_name").alias("business_name"), F.col("raw_addr").alias("business_address"), "country"), f"{root}/train_source{n}")
    rows = src.load_shard(w.spark, root, "train", country)
    return rows.select("id", tx.norm_ascii(F.col("raw_name")).alias("name"), tx.norm_ascii(F.col("raw_addr")).alias("addr"))


_REDUCED = "trim(regexp_replace(translate(replace(replace(replace(lower(coalesce({c}, '')), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^0-9a-z]+', ' ', 'g'))"


@query("norm_reduced", f"SELECT doc_id, md5({_REDUCED.format(c='text')}) AS norm_md5, length({_REDUCED.format(c='text')}) AS n FROM documents")
def _(w):
    n = tx.norm_reduced(F.col("text"))
    return w.table("documents").select("doc_id", F.md5(n.cast("binary")).alias("norm_md5"), F.char_length(n).cast("long").alias("n"))


@query("norm_benchmark", f"SELECT item_id, {_REDUCED.format(c='text')} AS norm FROM benchmark")
def _(w):
    return w.table("benchmark").select("item_id", tx.norm_reduced(F.col("text")).alias("norm"))


_INITIALS = [("S.A.R.L. du Midi", "sarl du midi"), ("A.B.C. Traders", "abc traders"), ("J. Smith", "j smith"), ("M/s. A.B.C. Traders", "ms abc traders"), ("Joe's B & B", "joes bb"), ("A/B/C Ltd", "abc ltd"), ("L.L.C. pc", "llc pc")]


@query("initials_merge", "SELECT id, norm FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, (_, n) in enumerate(_INITIALS)) + ") t(id, norm)")
def _(w):
    df = w.spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(_INITIALS)], "id int, raw string")
    return df.select("id", tx.norm_ascii(F.col("raw")).alias("norm"))


@query("char_ngrams4", sql("SELECT country, id, CAST(len(g) AS BIGINT) AS n, array_to_string(list_sort(g), ',') AS grams FROM sets"))
def _(w):
    s = pairs.record_sets(w.records)
    return s.select("country", "id", F.size("g").cast("long").alias("n"), F.array_join(F.array_sort("g"), ",").alias("grams"))


def _fold_sql(c: str) -> str:
    for a, b in tx.FOLDS:
        c = f"replace({c}, '{a}', '{b}')"
    doubles = c
    for ch in "abcdefghijklmnopqrstuvwxyz0123456789 ":
        doubles = f"regexp_replace({doubles}, '{ch}{ch}+', '{ch}', 'g')"
    return doubles


@query("fold_skeleton", sql(f"SELECT country, id, f AS folded, array_to_string(list_filter(list_transform(string_split(f, ' '), lambda v: regexp_replace(v, '[aeiou]', '', 'g')), lambda v: length(v) > 1), ' ') AS skeleton FROM (SELECT country, id, {_fold_sql('name')} AS f FROM r)"))
def _(w):
    return w.records.select("country", "id", tx.fold(F.col("name")).alias("folded"), tx.skeleton(F.col("name")).alias("skeleton"))


@query("distinct_norm", sql("SELECT count(*) AS n, count(DISTINCT raw_name) AS names, count(DISTINCT raw_addr) AS addrs FROM r"))
def _(w):
    return w.records.agg(F.count("*").alias("n"), F.count_distinct("raw_name").alias("names"), F.count_distinct("raw_addr").alias("addrs"))


@query("translit")
def _(w):
    words = ["शर्मा", "कमला", "राम", "अंबानी मार्ट", "Société Générale", "M/s. A.B.C. Traders", "తెలుగు", None, ""]
    df = w.spark.createDataFrame([(i, t) for i, t in enumerate(words)], "id int, raw string")
    return tx.with_norm(df, "raw", "norm")


# Index.

query("token_df", sql("SELECT country, token, df FROM ndf"))(lambda w: index.document_frequency(w.records, "name"))
query("idf_capped", sql(f"SELECT country, token, df, {r6('idf')} AS idf FROM aidf"))(lambda w: index.idf(w.records, "addr", K.addr_df_cap).withColumn("idf", F.round("idf", 6)))
query("smoothed_idf", sql("SELECT country, token, round(ln((n + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1, 6) AS idf FROM (SELECT DISTINCT country, token FROM nt WHERE src = 1) LEFT JOIN ndf USING (country, token) JOIN cn USING (country)"))(
    lambda w: index.smoothed_idf(w.records, "name").withColumn("idf", F.round("idf", 6))
)
query("postings_l2", sql("SELECT country, id, token, round(w, 6) AS w FROM apost"))(lambda w: index.postings(w.records, "addr", K.addr_df_cap).select("country", "id", "token", F.round("w", 6).alias("w")))

# Retrieval.

query("c2_name_topk", sql("SELECT country, q, c, score FROM c2"))(lambda w: retrieval.token_top_k(w.records, "name", K.name_df_cap, K.name_top_k))
query("c6_addr_topk", sql("SELECT country, q, c, score FROM c6"))(lambda w: retrieval.token_top_k(w.records, "addr", K.addr_df_cap, K.addr_top_k))
query("c1_canonical", sql("SELECT country, q, c, score FROM c1"))(lambda w: retrieval.canonical(w.records, "name", K.canonical_cap))
query("c5_postal_number", sql("SELECT country, q, c, score FROM c5"))(lambda w: retrieval.postal_number(w.records, "addr", K.key_cap))
query("c3_rarest_pair", sql("SELECT country, q, c, round(score, 6) AS score FROM c3"))(lambda w: retrieval.rarest_pair(w.records, "name", K).withColumn("score", F.round("score", 6)))
query("c4_addr_pair", sql("SELECT country, q, c, round(score, 6) AS score FROM c4"))(lambda w: retrieval.rarest_pair(w.records, "addr", K, True).withColumn("score", F.round("score", 6)))
_CH = list(oracle.CHANNELS)
query("channel_union", sql("SELECT country, q, c, " + ", ".join(f"round({n}, 6) AS {n}" for n in _CH) + " FROM uni"))(
    lambda w: retrieval.all_channels(w.records, K).select("country", "q", "c", *[F.round(n, 6).alias(n) for n in _CH])
)
query("cap_candidates", sql("SELECT country, q, c, round(max_chan, 6) AS max_chan FROM cand"))(lambda w: w.cand.select("country", "q", "c", F.round("max_chan", 6).alias("max_chan")))
query("s1_neighbours", sql("SELECT country, q, c, score FROM near"))(lambda w: w.near)
query("xsrc_twin", sql("SELECT country, id, CAST(count(DISTINCT src) OVER (PARTITION BY country, lower(raw_name)) > 1 AS INTEGER) AS twin FROM r WHERE src <> 1"))(lambda w: retrieval.cross_source_twin(w.records, "raw_name"))
query("record_owner", sql("SELECT country, c, owner FROM own"))(lambda w: w.owner)
_AUDIT = "trim(regexp_replace(replace(lower(strip_accents({c})), 'ß', 'ss'), '[^0-9a-z]+', ' ', 'g'))"
query("audit_norm", f"SELECT item_id, {_AUDIT.format(c='text')} AS norm FROM benchmark")(lambda w: w.table("benchmark").select("item_id", tx.norm_audit(F.col("text")).alias("norm")))
query("benchmark_retrieval", f"""WITH r AS (SELECT item_id AS id, 1 AS src, {_REDUCED.format(c='text')} AS name FROM benchmark UNION ALL SELECT doc_id, 2, {_REDUCED.format(c='text')} FROM documents),
  t AS (SELECT DISTINCT id, src, unnest(string_split(name, ' ')) AS token FROM r), d AS (SELECT token, count(*) AS df FROM t WHERE src = 2 AND token <> '' GROUP BY ALL HAVING count(*) <= 50),
  p AS (SELECT id, src, token, idf / sqrt(sum(idf * idf) OVER (PARTITION BY src, id)) AS w FROM t JOIN (SELECT token, ln((SELECT count(*) FROM documents)::DOUBLE / df) AS idf FROM d) USING (token))
  SELECT item_id, doc_id, score FROM (SELECT a.id AS item_id, b.id AS doc_id, round(sum(a.w * b.w), 6) AS score, row_number() OVER (PARTITION BY a.id ORDER BY round(sum(a.w * b.w), 6) DESC, b.id) AS rn
  FROM p a JOIN p b USING (token) WHERE a.src = 1 AND b.src = 2 GROUP BY 1, 2) WHERE rn <= 3""")(
    lambda w: _benchmark(w)
)


def _benchmark(w: Work) -> DataFrame:
    """The three nearest documents of each benchmark item by the name channel, over whole texts."""
    a = w.table("benchmark").select(F.lit("").alias("country"), F.concat(F.lit("b"), F.lpad(F.col("item_id").cast("string"), 19, "0")).alias("id"), F.lit(1).alias("src"), tx.norm_reduced(F.col("text")).alias("name"))
    b = w.table("documents").select(F.lit("").alias("country"), F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 19, "0")).alias("id"), F.lit(2).alias("src"), tx.norm_reduced(F.col("text")).alias("name"))
    top = retrieval.token_top_k(a.unionByName(b), "name", 50, 3)
    return top.select(F.substring("q", 2, 19).cast("long").alias("item_id"), F.substring("c", 2, 19).cast("long").alias("doc_id"), "score")


# Features.

_GEO = f"""SELECT country, q, c, round(max_chan, 6) AS max_chan, round({' + '.join(_CH)}, 6) AS sum_chan, {' + '.join(f'CAST({n} > 0 AS BIGINT)' for n in _CH)} AS n_chan, rank() OVER (PARTITION BY country, q ORDER BY max_chan DESC) - 1 AS rank,
  count(*) OVER (PARTITION BY country, q) AS n_cand, round(max(max_chan) OVER (PARTITION BY country, q) - max_chan, 6) AS gap_top, round(max_chan / greatest(max(max_chan) OVER (PARTITION BY country, q), 1e-6::DOUBLE), 6) AS ratio_top, CAST(starts_with(c, 'S3-') AS INTEGER) AS is_s3 FROM cand"""
query("pair_geometry", sql(_GEO))(lambda w: pairs.geometry(w.cand))
query("pair_string_features", sql("SELECT * FROM sf"))(lambda w: w.features)
query("pair_digit_features", sql("SELECT * FROM df_"))(lambda w: pairs.digit_features(w.sets))
query("rare_shared_idf", sql("SELECT p.country, p.q, p.c, round(coalesce(max(i.idf), 0.0::DOUBLE), 6) AS nm_rare_shared FROM cand p LEFT JOIN nt a ON p.country = a.country AND p.q = a.id LEFT JOIN nt b ON p.country = b.country AND p.c = b.id AND a.token = b.token LEFT JOIN nidf i ON i.country = b.country AND i.token = b.token GROUP BY ALL"))(
    lambda w: pairs.rare_shared(w.sets, w.records, K.name_df_cap)
)
query("name_dup", sql("SELECT country, id, CASE WHEN name = '' THEN 0 ELSE count(*) OVER (PARTITION BY country, name) - 1 END AS name_dup FROM r WHERE src = 1"))(lambda w: pairs.name_dup(w.records))


def _grammar_sql() -> str:
    rows = ", ".join(f"('{f}', '{k}', {q}, {c}, {w}::DOUBLE)" for f, k, q, c, w in GRAMMAR)
    return f"""SELECT country, q, c, round(coalesce(sum(w) FILTER (field = 'name' AND kind = 'abbrev'), 0.0::DOUBLE), 6) AS abbrev_matched, round(CASE WHEN any_value(nx + ny - i) - any_value(e) > 0 THEN (any_value(i) + any_value(e))::DOUBLE / (any_value(nx + ny - i) - any_value(e)) ELSE 0.0::DOUBLE END, 6) AS abbrev_jaccard,
      count(*) FILTER (kind = 'forbid' AND NOT (len(list_intersect(gq, eq)) = len(gq) AND len(list_intersect(gc, ec)) = len(gc))) AS forbidden, count(*) FILTER (kind = 'region' AND field = 'addr') AS region
      FROM (SELECT *, least(len(CASE WHEN field = 'name' THEN eq ELSE [] END), len(CASE WHEN field = 'name' THEN ec ELSE [] END)) AS e0, coalesce(max(least(len(CASE WHEN field = 'name' THEN eq ELSE [] END), len(CASE WHEN field = 'name' THEN ec ELSE [] END))) OVER (PARTITION BY country, q, c), 0) AS e FROM (
        SELECT s.*, g.kind, g.gq, g.gc, g.w, coalesce(list_distinct(flatten(list(CASE WHEN g.kind <> 'forbid' THEN g.gq ELSE [] END) OVER (PARTITION BY s.country, s.q, s.c, s.field))), []) AS eq, coalesce(list_distinct(flatten(list(CASE WHEN g.kind <> 'forbid' THEN g.gc ELSE [] END) OVER (PARTITION BY s.country, s.q, s.c, s.field))), []) AS ec
        FROM (SELECT country, q, c, 'name' AS field, len(xn) AS nx, len(yn) AS ny, len(list_intersect(xn, yn)) AS i, list_filter(xn, lambda v: NOT list_contains(yn, v)) AS xo, list_filter(yn, lambda v: NOT list_contains(xn, v)) AS yo FROM ps
          UNION ALL SELECT country, q, c, 'addr', len(xn), len(yn), len(list_intersect(xn, yn)), list_filter(xa, lambda v: NOT list_contains(ya, v)), list_filter(ya, lambda v: NOT list_contains(xa, v)) FROM ps) s
        LEFT JOIN (VALUES {rows}) g(field, kind, gq, gc, w) ON s.field = g.field AND len(list_intersect(g.gq, s.xo)) = len(g.gq) AND len(list_intersect(g.gc, s.yo)) = len(g.gc))) GROUP BY country, q, c"""


@query("grammar_features", sql(_grammar_sql()))
def _(w):
    g = w.spark.createDataFrame(GRAMMAR, "field string, kind string, q array<string>, c array<string>, w double")
    return pairs.grammar_features(w.sets, g)


_REL = "SELECT country, q, c, " + ", ".join(f"round(max({n}) OVER g - {n}, 6) AS {n}_gap, rank() OVER (PARTITION BY country, q ORDER BY {n} DESC) - 1 AS {n}_rank" for n in (*pairs.RELATIVE, "combo")) + " FROM (SELECT *, nm_4gram + ad_cont AS combo FROM sf JOIN df_ USING (country, q, c)) WINDOW g AS (PARTITION BY country, q)"
query("relative_features", sql(f"SELECT *, count(*) FILTER (combo_gap <= 0.1) OVER (PARTITION BY country, q) AS n_near_combo FROM ({_REL})"))(
    lambda w: pairs.relative(w.features.join(pairs.digit_features(w.sets), ["country", "q", "c"]))
)
query("record_flags", sql("""SELECT country, id, CAST(len(list_filter(string_split_regex(raw_addr, '[\\s\\p{Z}]+'), lambda v: v <> '')) AS BIGINT) AS n_tokens, length(raw_addr) AS n_chars, CAST(upper(raw_addr) = raw_addr AND lower(raw_addr) <> raw_addr AS INTEGER) AS all_caps,
  CAST(lower(raw_addr) = raw_addr AND upper(raw_addr) <> raw_addr AS INTEGER) AS all_lower, CAST(contains(raw_addr, '  ') AS INTEGER) AS double_space,
  CAST(regexp_matches(raw_addr, '^[\\p{P}\\p{S}]') OR (regexp_matches(raw_addr, '[\\p{P}\\p{S}]$') AND NOT regexp_matches(regexp_extract(raw_addr, '([\\p{P}\\p{S}]+)$', 1), '^\\.+$')) AS INTEGER) AS junk_affix FROM r"""))(
    lambda w: pairs.record_flags(w.records, "raw_addr")
)


def _tri_sql() -> str:
    def like(f: str) -> str:
        i = f"len(list_intersect(y{f}, z{f}))"
        return f"round((CASE WHEN len(y{f}) + len(z{f}) - {i} > 0 THEN {i}::DOUBLE / (len(y{f}) + len(z{f}) - {i}) ELSE 0.0::DOUBLE END) * pj, 6)"

    return f"""SELECT b.country, b.q, b.c, coalesce(a.nm, 0.0::DOUBLE) AS tri_nm, coalesce(a.nmp, 0.0::DOUBLE) AS tri_nm_p, coalesce(a.dg, 0.0::DOUBLE) AS tri_dg, coalesce(a.dgp, 0.0::DOUBLE) AS tri_dg_p, coalesce(a.conf, 0) AS tri_conf,
      rank() OVER (PARTITION BY b.country, b.q ORDER BY b.p DESC) - 1 AS tri_rank, b.p AS tri_p, coalesce(a.xs, 0.0::DOUBLE) AS tri_xsrc, CAST(first_value(starts_with(b.c, 'S3-')) OVER (PARTITION BY b.country, b.q ORDER BY b.p DESC, b.c) <> starts_with(b.c, 'S3-') AS INTEGER) AS tri_xsrc_top FROM sc b LEFT JOIN (
      SELECT country, q, c, max(nm) AS nm, max(struct_pack(v := nm, pj := pj)).pj AS nmp, max(dg) AS dg, max(struct_pack(v := dg, pj := pj)).pj AS dgp, CAST(sum(CASE WHEN pj > 0.5 AND len(list_intersect(yd, zd)) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS conf, max(pj) FILTER (starts_with(c, 'S3-') <> starts_with(j, 'S3-')) AS xs
      FROM (SELECT *, {like('g')} AS nm, {like('d')} AS dg FROM (SELECT a.country, a.q, a.c, a.r, z.c AS j, z.p AS pj, z.r AS rj, a.yg, a.yd, z.yg AS zg, z.yd AS zd FROM tr a JOIN tr z ON a.country = z.country AND a.q = z.q AND a.c <> z.c) WHERE rj - CASE WHEN r < rj THEN 1 ELSE 0 END <= 10) GROUP BY ALL) a USING (country, q, c)"""


query("triangulation", sql(_tri_sql(), tr="SELECT s.country, s.q, s.c, s.p, row_number() OVER (PARTITION BY s.country, s.q ORDER BY s.p DESC, s.c) AS r, ps.yg, ps.yd FROM sc s JOIN ps ON s.country = ps.country AND s.q = ps.q AND s.c = ps.c"))(
    lambda w: pairs.triangulation(w.scored, w.sets)
)

# Scores and decisions.

query("scored_pairs", sql("SELECT country, q, c, p FROM sc"))(lambda w: w.scored)
query("linkage_flagship", sql("SELECT country, q, c, p FROM acc"))(lambda w: w.accepted)
query("product_p_zero", sql("SELECT country, q, round(p_zero, 6) AS p_zero FROM pz"))(lambda w: w.p_zero.withColumn("p_zero", F.round("p_zero", 6)))
query("choose_k", sql(f"SELECT country, q, count(*) AS k, round(sum(p), 6) AS mass FROM ({oracle.accept('sc', 'pz', 0.9, '1.1::DOUBLE')}) GROUP BY ALL"))(
    lambda w: decision.choose_k(w.scored, w.p_zero, 0.9, 1.1).groupBy("country", "q").agg(F.count("*").alias("k"), F.round(F.sum("p"), 6).alias("mass"))
)
query("fixed_topk_policy", sql("SELECT country, q, c, p FROM (SELECT *, row_number() OVER (PARTITION BY country, q ORDER BY p DESC, c) AS rn FROM sc) WHERE rn <= 2"))(lambda w: decision.fixed_top(w.scored, 2))
query("threshold_policy", sql("SELECT country, q, c, p FROM sc WHERE p > 0.5"))(lambda w: decision.above(w.scored, 0.5))
query("sinkhorn_closed_form", sql("SELECT country, q, c, round(least(p, o / (1 + sum(o) OVER (PARTITION BY country, c))), 6) AS p FROM (SELECT *, least(p, 1 - 1e-9::DOUBLE) / (1 - least(p, 1 - 1e-9::DOUBLE)) AS o FROM sc)"))(
    lambda w: decision.sinkhorn(w.scored).withColumn("p", F.round("p", 6))
)
query("cardinality_hist", sql("SELECT country, k, count(*) AS n FROM es GROUP BY ALL"))(lambda w: decision.cardinality(w.accepted, w.entities))
query("macro_f05", sql("SELECT country, round(avg(f), 6) AS f05, count(*) AS n FROM es GROUP BY ALL"))(lambda w: decision.macro_f05(w.accepted, w.truth, w.entities))
query("entity_scores", sql("SELECT country, q, hit, n, k, round(f, 6) AS f FROM es"))(lambda w: decision.entity_scores(w.accepted, w.truth, w.entities).withColumn("f", F.round("f", 6)))


def _sweep_sql() -> str:
    lift = "SELECT country, q, least(1.0::DOUBLE, p_zero * {x}::DOUBLE) AS p_zero FROM pz"
    top = "SELECT country, q, c FROM (SELECT *, row_number() OVER (PARTITION BY country, q ORDER BY p DESC, c) AS rn FROM sc) WHERE rn <= {k}"
    runs = [(f"top{k}", top.format(k=k)) for k in (2, 3)] + [(f"above{t}", f"SELECT country, q, c FROM sc WHERE p > {t}") for t in (0.3, 0.5)]
    runs += [(f"recall{r}", oracle.accept("sc", "pz", r)) for r in (0.9, 1.0)] + [(f"lift{x}", oracle.accept("sc", f"({lift.format(x=x)})", 1.0)) for x in (0.5, 1.0)]
    return " UNION ALL ".join(f"SELECT '{n}' AS policy, round(avg(f), 6) AS f05 FROM ({oracle.entity(f'({b})')})" for n, b in runs)


query("decision_sweep", sql(_sweep_sql()))(lambda w: decision.sweep(w.scored, w.p_zero, w.truth, w.entities))

_S_POINTS = f"SELECT country, q, max(p) * {oracle.FF} / greatest(any_value(p_zero), 1e-300::DOUBLE) AS s FROM sc JOIN pz USING (country, q) GROUP BY ALL"
query("calibrate_breakpoints", sql(f"SELECT country, q, round(s, 6) AS s FROM ({_S_POINTS})"))(lambda w: decision.abstention_scales(w.scored, w.p_zero).withColumn("s", F.round("s", 6)))
_REFERENCE = (0.3, 2.0)


def _solve_sql(points: str, want: str, low: str, high: str) -> str:
    return f"""SELECT country, least({high}::DOUBLE, greatest({low}::DOUBLE, CASE WHEN nx IS NULL OR isinf(nx) THEN CASE WHEN v > 0 THEN v * 2 ELSE 1.0::DOUBLE END WHEN v <= 0 THEN nx / 2 ELSE sqrt(v * nx) END)) AS x FROM (
      SELECT *, row_number() OVER (PARTITION BY country ORDER BY abs(upto - greatest(0.0::DOUBLE, want)), upto) AS rn FROM (
        SELECT country, v, CAST(sum(n) OVER o AS BIGINT) AS upto, lead(v) OVER o AS nx FROM (SELECT country, v, count(*) AS n FROM {points} GROUP BY ALL) WINDOW o AS (PARTITION BY country ORDER BY v)
        UNION ALL SELECT country, 0.0::DOUBLE, 0, min(v) FROM {points} GROUP BY country) JOIN {want} USING (country)) WHERE rn = 1"""


_CAL = {
    "sp": _S_POINTS,
    "spv": "SELECT country, s AS v FROM sp",
    "sw": f"SELECT country, {_REFERENCE[0]}::DOUBLE * n - (n - held) AS want FROM (SELECT country, count(*) AS n FROM ent GROUP BY ALL) JOIN (SELECT country, count(*) AS held FROM sp GROUP BY ALL) USING (country)",
    "ss": _solve_sql("spv", "sw", "1e-4", "1e4"),
    "lv": "SELECT country, q FROM sp JOIN ss USING (country) WHERE s > x",
    "mp": f"""SELECT country, q, k, min(CASE WHEN bar > 0 THEN p / bar WHEN p > 0 THEN 'inf'::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY country, q ORDER BY k) AS m FROM (SELECT *, 0.8::DOUBLE * (1.25::DOUBLE * b / (0.25::DOUBLE * n + k)) AS bar FROM (
      SELECT s.*, row_number() OVER (PARTITION BY country, q ORDER BY p DESC, c) - 1 AS k, {oracle._B} AS b, greatest(sum(p) OVER (PARTITION BY country, q), 1e-9::DOUBLE) AS n FROM sc s)) WHERE k > 0""",
    "mv": "SELECT country, m AS v FROM mp JOIN lv USING (country, q)",
    "mw": f"SELECT country, a.n - ({_REFERENCE[1]}::DOUBLE - 1) * b.n AS want FROM (SELECT country, count(*) AS n FROM mv GROUP BY ALL) a JOIN (SELECT country, count(*) AS n FROM lv GROUP BY ALL) b USING (country)",
    "st": _solve_sql("mv", "mw", "0.1", "10.0"),
    "cal": "SELECT ss.country, ss.x AS s, coalesce(st.x, 1.0::DOUBLE) AS t FROM ss LEFT JOIN st ON ss.country = st.country",
    "pzs": "SELECT country, q, least(1.0::DOUBLE, s * greatest(p_zero, 1e-300::DOUBLE)) AS p_zero, t FROM pz JOIN cal USING (country)",
}


def _scales(w: Work) -> DataFrame:
    return decision.calibrate(w.scored, w.p_zero, w.spark.createDataFrame([_REFERENCE], "singleton_rate double, mean_k double"))


query("calibrate_fit", sql("SELECT country, round(s, 6) AS s, round(t, 6) AS t FROM cal", **_CAL))(lambda w: _scales(w).select("country", F.round("s", 6).alias("s"), F.round("t", 6).alias("t")))
query("calibrate_apply", sql(oracle.accept("sc", "pzs", 1.0, "t"), **_CAL))(lambda w: decision.apply_calibration(w.scored, w.p_zero, _scales(w)))
query("resolve_conflicts")(lambda w: decision.resolve_conflicts(w.scored, w.accepted, w.p_zero))


def _head_sql() -> str:
    return f"""SELECT e.country, e.q, coalesce(n_cand, 0) AS n_cand, coalesce(n_s2, 0) AS n_s2, coalesce(n_s3, 0) AS n_s3, coalesce(best, 0.0::DOUBLE) AS best, coalesce(best_s2, 0.0::DOUBLE) AS best_s2, coalesce(best_s3, 0.0::DOUBLE) AS best_s3, coalesce(top2, 0.0::DOUBLE) AS top2,
      coalesce(n_above, 0) AS n_above, coalesce(sum_p, 0.0::DOUBLE) AS sum_p, coalesce(indep_logp0, 0.0::DOUBLE) AS indep_logp0, {', '.join(f'coalesce(best_{n}, 0.0::DOUBLE) AS best_{n}' for n in _CH)}, coalesce(name_rarity_mean, 0.0::DOUBLE) AS name_rarity_mean, coalesce(name_rarity_max, 0.0::DOUBLE) AS name_rarity_max,
      name_tokens, addr_tokens, round(coalesce(best, 0.0::DOUBLE) - coalesce(top2, 0.0::DOUBLE), 6) AS gap12 FROM ent e LEFT JOIN (SELECT country, q, count(*) AS n_cand, count(*) FILTER (starts_with(c, 'S2-')) AS n_s2, count(*) FILTER (starts_with(c, 'S3-')) AS n_s3, max(p) AS best, max(p) FILTER (starts_with(c, 'S2-')) AS best_s2,
      max(p) FILTER (starts_with(c, 'S3-')) AS best_s3, max(p) FILTER (rn = 2) AS top2, count(*) FILTER (p > 0.5) AS n_above, round(sum(p), 6) AS sum_p, round(sum(ln(greatest(1 - p, 1e-6::DOUBLE))), 6) AS indep_logp0, {', '.join(f'round(max({n}), 6) AS best_{n}' for n in _CH)}
      FROM (SELECT s.*, {', '.join(f'u.{n}' for n in _CH)}, row_number() OVER (PARTITION BY s.country, s.q ORDER BY s.p DESC, s.c) AS rn FROM sc s JOIN cand u ON s.country = u.country AND s.q = u.q AND s.c = u.c) GROUP BY ALL) a ON e.country = a.country AND e.q = a.q
      LEFT JOIN (SELECT country, id AS q, round(avg(idf), 6) AS name_rarity_mean, round(max(idf), 6) AS name_rarity_max FROM nt JOIN (SELECT country, token, ln((n + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT country, token FROM nt WHERE src = 1) LEFT JOIN ndf USING (country, token) JOIN cn USING (country)) USING (country, token) WHERE src = 1 GROUP BY ALL) b ON e.country = b.country AND e.q = b.q
      JOIN (SELECT country, id AS q, CAST(len(n) AS BIGINT) AS name_tokens, CAST(len(a) AS BIGINT) AS addr_tokens FROM sets) t ON e.country = t.country AND e.q = t.q"""


query("entity_head_features", sql(_head_sql()))(lambda w: scoring.entity_features(w.scored, w.cand, w.entities, w.records))
query("hard_neg_categories", sql("SELECT country, q, c, category FROM hn", hn="""SELECT s.country, s.q, s.c, CASE WHEN t.c IS NOT NULL THEN 'positive' WHEN rq.name = ro.name THEN 'same_name' WHEN nb.c IS NOT NULL THEN 'sibling' ELSE 'blocker' END AS category FROM sc s LEFT JOIN truth t ON s.country = t.country AND s.q = t.q AND s.c = t.c
  LEFT JOIN own o ON s.country = o.country AND s.c = o.c LEFT JOIN r rq ON rq.country = s.country AND rq.id = s.q LEFT JOIN r ro ON ro.country = s.country AND ro.id = o.owner LEFT JOIN near nb ON nb.country = s.country AND nb.q = s.q AND nb.c = o.owner"""))(
    lambda w: _hard(w).select("country", "q", "c", "category")
)


def _hard(w: Work) -> DataFrame:
    return scoring.hard_negative_category(scoring.with_label(w.scored, w.truth), w.owner, w.records, w.near)


_HN = ORACLES["hard_neg_categories"].rpartition(" SELECT country, q, c, category FROM hn")[0]
query("hard_neg_weights", _HN + f""" SELECT category, n, round(CASE WHEN category = 'positive' THEN 1.0::DOUBLE ELSE least(20.0::DOUBLE, m / sum(m) OVER w * sum(n) OVER w / n) END, 6) AS weight FROM (SELECT category, count(*) AS n, CASE category {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in MIX.items())} END AS m FROM hn GROUP BY ALL) WINDOW w AS (PARTITION BY category <> 'positive')""")(
    lambda w: scoring.mix_weights(_hard(w), MIX)
)

_FEATURES = ["nm_jac", "nm_cont", "nm_4gram", "nm_lenratio", "ad_jac", "ad_cont"]
query("gbt_scores")(lambda w: _gbt(w))
query("oof_scores")(lambda w: scoring.out_of_fold(_labelled(w), _FEATURES, 3, rounds=5, depth=4).select("country", "q", "c", "y", "p"))
query("isotonic")(lambda w: _isotonic(w))
query("singleton_head")(lambda w: _head(w))


def _labelled(w: Work) -> DataFrame:
    return scoring.with_label(w.features, w.truth)


def _gbt(w: Work) -> DataFrame:
    df = _labelled(w).cache()
    return scoring.predict(df, scoring.fit_pairs(df, _FEATURES, rounds=5, depth=4), _FEATURES).select("country", "q", "c", "y", "p")


def _isotonic(w: Work) -> DataFrame:
    df = scoring.with_label(w.scored, w.truth).cache()
    return scoring.apply_isotonic(df, scoring.fit_isotonic(df)).select("country", "q", "c", "y", "p")


def _head(w: Work) -> DataFrame:
    none = w.entities.join(w.truth.select("country", "q").distinct().withColumn("_t", F.lit(1)), ["country", "q"], "left").select("country", "q", F.col("_t").isNull().cast("int").alias("y"))
    df = scoring.entity_features(w.scored, w.cand, w.entities, w.records).join(none, ["country", "q"])
    return scoring.singleton_head(df, ["n_cand", "best", "top2", "gap12", "sum_p", "indep_logp0", "name_rarity_mean"], 3)


# Evaluation and audits.

query("blocking_recall", sql(" UNION ALL ".join(f"SELECT '{n}' AS channel, count(*) FILTER (coalesce({n}, 0) > 0) AS found, count(*) AS links, round(count(*) FILTER (coalesce({n}, 0) > 0)::DOUBLE / count(*), 6) AS recall FROM tc" for n in (*_CH, "max_chan")).replace("'max_chan'", "'any'"), tc="SELECT t.*, " + ", ".join(f"u.{n}" for n in (*_CH, "max_chan")) + " FROM truth t LEFT JOIN cand u ON t.country = u.country AND t.q = u.q AND t.c = u.c"))(
    lambda w: evaluate.blocking_recall(w.cand, w.truth)
)
query("blocking_ceiling", sql(f"""SELECT country, round(avg(CASE WHEN n = 0 AND hit = 0 THEN 1.0::DOUBLE WHEN 0.25::DOUBLE * n + hit > 0 THEN 1.25::DOUBLE * hit / (0.25::DOUBLE * n + hit) ELSE 0.0::DOUBLE END), 6) AS ceiling, round(avg(CAST(hit = n AS INTEGER)), 6) AS complete, round(avg(nc), 6) AS mean_cand,
  round(quantile_cont(nc::DOUBLE, 0.5), 6) AS median_cand, round(quantile_cont(nc::DOUBLE, 0.95), 6) AS p95_cand, max(nc) AS max_cand, count(*) FILTER (nc = 0) AS no_cand FROM (SELECT e.*, coalesce(x.nc, 0) AS nc FROM ({oracle.entity('cand')}) e LEFT JOIN (SELECT country, q, count(*) AS nc FROM cand GROUP BY ALL) x ON e.country = x.country AND e.q = x.q) GROUP BY country"""))(
    lambda w: evaluate.blocking_ceiling(w.cand, w.truth, w.entities)
)
_DG = "list_filter(list_distinct(string_split({n} || ' ' || {a}, ' ')), lambda v: regexp_matches(v, '[0-9]'))"
query("fp_categories", sql(f"""SELECT CASE WHEN o.owner IS NULL THEN 'distractor' WHEN rq.name = ro.name THEN 'chain' ELSE 'sibling' END AS category, CAST(len(list_intersect({_DG.format(n='rq.name', a='rq.addr')}, {_DG.format(n='rc.name', a='rc.addr')})) > 0 AS INTEGER) AS digit, count(*) AS n
  FROM err e LEFT JOIN own o ON e.country = o.country AND e.c = o.c JOIN r rq ON rq.country = e.country AND rq.id = e.q JOIN r rc ON rc.country = e.country AND rc.id = e.c LEFT JOIN r ro ON ro.country = e.country AND ro.id = o.owner WHERE e.got = 1 AND e.yes = 0 GROUP BY ALL"""))(
    lambda w: evaluate.false_positives(w.errors, w.owner, w.records)
)
query("fn_categories", sql("""SELECT CASE WHEN wt > 0 THEN 'ranked out' WHEN bf = 0 THEN 'stopped early' ELSE 'buried' END AS category, count(*) AS n FROM (SELECT *, sum(CASE WHEN got = 1 AND yes = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY country, q) AS wt,
  sum(CASE WHEN got = 0 AND yes = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY country, q ORDER BY rank) AS bf FROM err2) WHERE yes = 1 AND got = 0 GROUP BY ALL"""))(lambda w: evaluate.false_negatives(evaluate.errors(w.scored, w.accepted, w.blocks)))  # fmt: skip
query("miss_categories", sql(f"SELECT CASE WHEN name_df <= {K.name_df_cap} OR addr_df <= {K.addr_df_cap} THEN 'reachable' WHEN addr_df IS NOT NULL THEN 'address too common' WHEN name_df IS NOT NULL THEN 'name too common' ELSE 'no signal' END AS category, count(*) AS n FROM lsd2 l WHERE NOT EXISTS (SELECT 1 FROM cand x WHERE x.country = l.country AND x.q = l.q AND x.c = l.c) GROUP BY ALL"))(
    lambda w: evaluate.misses(w.cand, w.blocks, w.records, K.name_df_cap, K.addr_df_cap)
)
query("dfcap_frontier", sql(f"SELECT cap::BIGINT AS cap, round(avg(CAST(coalesce(name_df <= cap, false) AS INTEGER)), 6) AS name, round(avg(CAST(coalesce(addr_df <= cap, false) AS INTEGER)), 6) AS addr, round(avg(CAST(coalesce(name_df <= cap, false) OR coalesce(addr_df <= cap, false) AS INTEGER)), 6) AS either FROM lsd, (SELECT unnest([{', '.join(map(str, CAPS))}]) AS cap) GROUP BY cap"))(
    lambda w: evaluate.cap_frontier(w.truth, w.records, CAPS)
)
query("channel_recall_strata", sql("SELECT coalesce(country, 'ALL') AS country, coalesce(source, 'ALL') AS source, count(*) AS links, round(avg(h), 6) AS recall FROM (SELECT t.country, substr(t.c, 1, 2) AS source, CAST(x.c IS NOT NULL AS INTEGER) AS h FROM truth t LEFT JOIN cand x ON t.country = x.country AND t.q = x.q AND t.c = x.c) GROUP BY CUBE (country, source)"))(
    lambda w: evaluate.channel_strata(w.cand, w.truth)
)
query("record_reuse", sql("SELECT uses, count(*) AS n FROM (SELECT c, count(DISTINCT q) AS uses FROM acc GROUP BY ALL) GROUP BY ALL"))(lambda w: evaluate.record_reuse(w.accepted))
query("country_crossing", sql("SELECT count(*) AS links, count(*) FILTER (a.country <> b.country) AS crossing FROM truth t JOIN r a ON t.q = a.id JOIN r b ON t.c = b.id"))(lambda w: evaluate.country_crossing(w.truth, w.records))
query("joint_counts", sql("SELECT n_s2, n_s3, count(*) AS n FROM (SELECT e.country, e.q, count(t.c) FILTER (starts_with(t.c, 'S2-')) AS n_s2, count(t.c) FILTER (starts_with(t.c, 'S3-')) AS n_s3 FROM ent e LEFT JOIN truth t ON e.country = t.country AND e.q = t.q GROUP BY ALL) GROUP BY ALL"))(lambda w: evaluate.joint_counts(w.truth, w.entities))
query("distractor_share", sql("SELECT r.src::BIGINT AS src, count(*) AS records, count(t.c) AS matched, round(1 - count(t.c)::DOUBLE / count(*), 6) AS distractor_share FROM r LEFT JOIN (SELECT DISTINCT country, c FROM truth) t ON r.country = t.country AND r.id = t.c WHERE r.src <> 1 GROUP BY ALL"))(lambda w: evaluate.distractors(w.truth, w.records))
query("pair_separability", sql("""SELECT kind, count(*) AS n, round(avg(nm_exact), 6) AS name_equal, round(avg(nm_jac), 6) AS nm_mean, round(quantile_cont(nm_jac, 0.5), 6) AS nm_median, round(avg(CAST(nm_jac = 0 AS INTEGER)), 6) AS nm_zero, round(avg(CAST(nm_jac >= 0.5 AS INTEGER)), 6) AS nm_half, round(avg(ad_jac), 6) AS ad_mean, round(avg(CAST(dg_shared > 0 AS INTEGER)), 6) AS digit
  FROM (SELECT s.*, d.dg_shared, CASE WHEN t.c IS NULL THEN 'other' ELSE 'true' END AS kind FROM sf s JOIN df_ d USING (country, q, c) LEFT JOIN truth t ON s.country = t.country AND s.q = t.q AND s.c = t.c) GROUP BY kind"""))(
    lambda w: evaluate.separability(scoring.with_label(w.features.join(pairs.digit_features(w.sets), ["country", "q", "c"]), w.truth).withColumn("kind", F.when(F.col("y") == 1, "true").otherwise("other")))
)
query("chain_groups", sql("SELECT country, size, count(*) AS groups FROM (SELECT country, name, count(*) AS size FROM r WHERE src = 1 AND name <> '' GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL"))(lambda w: evaluate.chain_groups(w.records))
query("frequent_tokens", sql("SELECT token, count(*) AS n FROM atk GROUP BY ALL ORDER BY n DESC, token LIMIT 25"))(lambda w: evaluate.frequent_tokens(w.records, "addr"))
query("script_presence", "SELECT doc_id % 3 AS src, count(*) AS records, count(*) FILTER (regexp_matches(text, '[\\x{0900}-\\x{097F}]')) AS devanagari, count(*) FILTER (regexp_matches(text, '[^\\x00-\\x7F]')) AS non_ascii FROM documents GROUP BY ALL")(
    lambda w: evaluate.script_presence(w.table("documents").withColumn("src", F.col("doc_id") % 3), "text")
)
query("id_adjacency", sql("SELECT count(*) AS links, CAST(coalesce(sum(CAST(same AS BIGINT)), 0) AS BIGINT) AS adjacent FROM (SELECT lag(q) OVER (PARTITION BY country, substr(c, 1, 2) ORDER BY CAST(substr(c, 4) AS BIGINT)) = q AS same FROM truth)"))(lambda w: evaluate.id_adjacency(w.truth))
query("id_spearman", sql("SELECT country, round(corr(x, y), 6) AS spearman FROM (SELECT country, rank() OVER (PARTITION BY country ORDER BY a) + (count(*) OVER (PARTITION BY country, a) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY country ORDER BY b) + (count(*) OVER (PARTITION BY country, b) - 1) / 2.0::DOUBLE AS y FROM (SELECT country, CAST(substr(q, 4) AS BIGINT) AS a, CAST(substr(c, 4) AS BIGINT) AS b FROM truth)) GROUP BY country"))(
    lambda w: evaluate.id_correlation(w.truth)
)

# Mining.

_SUBS = {
    "dif": "SELECT country, q, c, list_filter(list_distinct(string_split(x, ' ')), lambda v: NOT list_contains(string_split(y, ' '), v) AND v <> '') AS a, list_filter(list_distinct(string_split(y, ' ')), lambda v: NOT list_contains(string_split(x, ' '), v) AND v <> '') AS b FROM pairs",
    "sb0": "SELECT country, q, c, a[1] AS a, b[1] AS b, 1 - levenshtein(a[1], b[1])::DOUBLE / greatest(length(a[1]), length(b[1]), 1) AS e FROM dif WHERE len(a) = 1 AND len(b) = 1",
    "sb": """SELECT country, q, c, a, b, e, CASE WHEN a = b THEN 'identity' WHEN e < 0.8 AND ab THEN 'abbrev' WHEN e < 0.8 AND ba THEN 'expansion' ELSE 'typo' END AS kind, CASE WHEN e < 0.8 AND (ab OR ba) THEN 0.9::DOUBLE ELSE e END AS score FROM (SELECT *, length(b) >= 2 AND length(b) < length(a) AND regexp_matches(a || b, '^[a-z]+$') AND regexp_matches(a, '^' || array_to_string(string_split(b, ''), '.*')) AS ab,
      length(a) >= 2 AND length(a) < length(b) AND regexp_matches(a || b, '^[a-z]+$') AND regexp_matches(b, '^' || array_to_string(string_split(a, ''), '.*')) AS ba FROM sb0)""",
}


def _subs(w: Work) -> DataFrame:
    return mining.substitutions(w.texts(w.cand, "name"))


query("substitutions", sql("SELECT country, q, c, a, b, round(score, 6) AS score, kind FROM sb", **_SUBS))(_subs)
query("abbreviations", sql("SELECT a, b, kind, n, n_s2, n_s3, round(n / sum(n) OVER (PARTITION BY a), 6) AS p_b_given_a, round(n / sum(n) OVER (PARTITION BY b), 6) AS p_a_given_b FROM (SELECT a, b, kind, count(*) AS n, count(*) FILTER (starts_with(c, 'S2-')) AS n_s2, count(*) FILTER (starts_with(c, 'S3-')) AS n_s3 FROM sb GROUP BY ALL) QUALIFY n >= 2", **_SUBS))(
    lambda w: mining.substitution_table(_subs(w), 2)
)
query("token_drop_by_idf", sql("SELECT CAST(floor(ln((n + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1e-9::DOUBLE) AS BIGINT) AS bucket, count(*) AS n, CAST(sum(gone) AS BIGINT) AS dropped, round(sum(gone)::DOUBLE / count(*), 6) AS rate FROM (SELECT country, token, CAST(NOT list_contains(string_split(y, ' '), token) AS INTEGER) AS gone FROM (SELECT country, y, unnest(list_distinct(string_split(x, ' '))) AS token FROM tp)) JOIN cn USING (country) LEFT JOIN adf USING (country, token) GROUP BY 1"))(
    lambda w: mining.token_drops(w.texts(w.truth, "addr"), index.document_frequency(w.records, "addr"), index.corpus_size(w.records))
)
query("numeral_mutation", sql("SELECT CASE WHEN list_contains(dy, t) THEN 'identity' WHEN len(list_filter(dy, lambda v: NOT list_contains(dx, v))) > 0 THEN 'changed' ELSE 'dropped' END AS outcome, count(*) AS n FROM (SELECT *, unnest(dx) AS t FROM (SELECT list_filter(list_distinct(string_split(x, ' ')), lambda v: regexp_matches(v, '[0-9]')) AS dx, list_filter(list_distinct(string_split(y, ' ')), lambda v: regexp_matches(v, '[0-9]')) AS dy FROM tp)) GROUP BY 1"))(
    lambda w: mining.numeral_changes(w.texts(w.truth, "addr"))
)
query("junk_tokens", sql("SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(list_distinct(string_split(y, ' ')), lambda v: NOT list_contains(string_split(x, ' '), v))) AS token FROM tp) WHERE token <> '' GROUP BY ALL ORDER BY n DESC, token LIMIT 50"))(
    lambda w: mining.junk_tokens(w.texts(w.truth, "addr"))
)
_AFFIX = " UNION ALL ".join(f"SELECT '{p}' AS place, regexp_extract(props, '{r}', 1) AS affix, regexp_extract(event_type, '{r}', 1) AS o FROM events" for p, r in (("prefix", "^([\\p{P}\\p{S}]+)"), ("suffix", "([\\p{P}\\p{S}]+)$")))
_INFIX = "SELECT 'infix' AS place, unnest(list_distinct(list_filter(list_filter(string_split_regex(trim(props), '\\s+'), lambda v: v <> '')[2:-2], lambda v: regexp_full_match(v, '[\\p{P}\\p{S}]+')))) AS affix FROM events"
query("junk_affixes", f"SELECT place, affix, count(*) AS n FROM (SELECT place, affix FROM ({_AFFIX}) WHERE affix <> '' AND affix <> o AND NOT regexp_matches(affix, '^\\.+$') UNION ALL {_INFIX}) GROUP BY ALL")(
    lambda w: mining.junk_affixes(w.table("events").select(F.col("event_type").alias("x"), F.col("props").alias("y")))
)

_TRIALS = 100
_FORBID = {
    "fev": "SELECT a, b FROM sb WHERE (kind <> 'typo' OR round(score, 6) < 0.5) AND regexp_matches(a, '^[a-z]+$') AND regexp_matches(b, '^[a-z]+$')",
    "fvo": "SELECT t, sum(ch) AS ch, sum(ta) AS ta FROM (SELECT a AS t, 1 AS ch, 0 AS ta FROM fev UNION ALL SELECT b, 0, 1 FROM fev) GROUP BY t HAVING count(*) >= 5 ORDER BY count(*) DESC, t LIMIT 300",
    "fto": "SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(list_distinct(string_split(x, ' ')), lambda v: v <> '')) AS token FROM pairs) GROUP BY ALL",
    "fpa": "SELECT x.t AS a, y.t AS b, x.ch, y.ta, n FROM fvo x JOIN fto ON x.t = token JOIN fvo y ON x.t <> y.t WHERE n >= 100 AND y.ta >= 5 AND NOT EXISTS (SELECT 1 FROM sb WHERE sb.a = x.t AND sb.b = y.t)",
    "fsi": "SELECT *, 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b), 1) AS e, (length(b) >= 2 AND length(b) < length(a) AND regexp_matches(a, '^' || array_to_string(string_split(b, ''), '.*'))) OR (length(a) >= 2 AND length(a) < length(b) AND regexp_matches(b, '^' || array_to_string(string_split(a, ''), '.*'))) AS ab FROM fpa",
}
query("forbidden_pairs", sql("SELECT a, b, n AS n_trials, round(3.0::DOUBLE / n, 6) AS bound, round(ch * ta / greatest((SELECT count(*) FROM fev), 1)::DOUBLE, 6) AS expected, round(s, 6) AS alike, CAST(s >= 0.5 OR substr(a, 1, 1) = substr(b, 1, 1) AS INTEGER) AS trap FROM (SELECT *, CASE WHEN e < 0.8 AND ab THEN 0.9::DOUBLE ELSE e END AS s FROM fsi)", **_SUBS, **_FORBID))(
    lambda w: mining.forbidden_pairs(_subs(w), w.texts(w.cand, "name").select(F.explode(tx.tokens(F.col("x"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")), _TRIALS)
)
_PERM = {
    "pmo": "SELECT string_split(x, ' ') AS x, string_split(y, ' ') AS y FROM pairs WHERE list_sort(string_split(x, ' ')) = list_sort(string_split(y, ' ')) AND len(list_distinct(string_split(x, ' '))) = len(string_split(x, ' '))",
    "pm": "SELECT len(x) AS n, list_transform(y, lambda t: list_position(x, t) - 1) AS m, range(0, len(x)) AS s FROM pmo",
    "pk": """SELECT n, CASE WHEN n < 2 THEN 'n<2' WHEN m = s THEN 'none' WHEN n = 2 THEN 'swap2' WHEN m = list_concat([n - 1], range(0, n - 1)) THEN 'last_to_front' WHEN m = list_concat(range(1, n), [0]) THEN 'first_to_end' WHEN m = list_reverse(s) THEN 'reverse'
      WHEN len(list_filter(s, lambda i: m[i + 1] <> i)) = 2 AND list_filter(s, lambda i: m[i + 1] <> i)[2] = list_filter(s, lambda i: m[i + 1] <> i)[1] + 1 THEN 'adjacent_swap' WHEN len(list_filter(s, lambda i: list_filter(m, lambda v: v <> i) = list_filter(s, lambda v: v <> i))) > 0 THEN 'single_move' ELSE 'other' END AS kind FROM pm""",
}
query("permutations", sql("""SELECT n AS length, kind, count(*) AS n, round(CASE WHEN n < 2 THEN NULL WHEN n = 2 THEN CASE kind WHEN 'swap2' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN kind IN ('last_to_front', 'first_to_end', 'reverse') THEN 1.0::DOUBLE WHEN kind = 'adjacent_swap' THEN n - 1.0::DOUBLE
  WHEN kind = 'single_move' THEN (n - 1) * (n - 2) - 2.0::DOUBLE WHEN kind = 'other' THEN factorial(n::INTEGER) - 2.0::DOUBLE - (n - 1) * (n - 1) ELSE 0.0::DOUBLE END / (factorial(n::INTEGER) - 1.0::DOUBLE), 6) AS random FROM pk GROUP BY pk.n, kind""".replace("SELECT n AS length, kind, count(*) AS n,", "SELECT CAST(pk.n AS BIGINT) AS length, kind, count(*) AS n,"), **_PERM))(lambda w: mining.permutations(w.texts(w.cand, "name")))
query("js_divergence", sql("""WITH e AS (SELECT kind AS family, CAST(substr(c, 2, 1) AS INTEGER) AS src, a || '>' || b AS event FROM sb), g AS (SELECT family, src, event, count(*) AS n FROM e GROUP BY ALL), p AS (SELECT family, src, event, n / sum(n) OVER (PARTITION BY family, src) AS p FROM g),
  d AS (SELECT family, event, coalesce(max(p) FILTER (src = 2), 0.0::DOUBLE) AS p, coalesce(max(p) FILTER (src = 3), 0.0::DOUBLE) AS q FROM p GROUP BY ALL)
  SELECT family, round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END / 2 + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END / 2), 6) AS js FROM d GROUP BY ALL""", **_SUBS).replace(" WITH e AS", ", e AS", 1))(
    lambda w: mining.js_divergence(_subs(w).select(F.col("kind").alias("family"), F.substring("c", 2, 1).cast("int").alias("src"), F.concat_ws(">", "a", "b").alias("event")))
)
query("align_tokens")(lambda w: mining.aligned(w.texts(w.cand, "name")))
query("lexicon_majority", sql("SELECT a, b, n FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rn, sum(n) OVER (PARTITION BY a) AS t FROM (SELECT a, b, count(*) AS n FROM sb GROUP BY ALL)) WHERE rn = 1 AND n >= 3 AND n >= 0.1 * t", **_SUBS))(
    lambda w: mining.majority(_subs(w), "a", "b", 3, 0.1)
)

# Results.

_ROWS = "SELECT e.q, coalesce(string_agg(s.c, ',' ORDER BY s.p DESC, s.c), '') AS {to} FROM ent e LEFT JOIN {t} s ON e.country = s.country AND e.q = s.q GROUP BY e.q"
query("submission_rows", sql(f"SELECT m.q, matched_ids, candidate_ids FROM ({_ROWS.format(to='matched_ids', t='acc')}) m JOIN ({_ROWS.format(to='candidate_ids', t='sc')}) k ON m.q = k.q"))(
    lambda w: submission.rows(w.accepted, w.entities, "matched_ids").join(submission.rows(w.scored, w.entities, "candidate_ids"), "q")
)
_CHECKS = ("missing entity", "extra entity", "repeated entity", "bad prefix", "unknown record", "repeated record", "match not a candidate")
query("submission_validate", sql(" UNION ALL ".join(f"SELECT '{c}' AS \"check\", 0 AS n" for c in _CHECKS)))(
    lambda w: submission.validate(submission.rows(w.accepted, w.entities, "ids"), submission.rows(w.scored, w.entities, "ids"), w.entities, w.records.where("src <> 1"))
)
query("submission_profile", sql("SELECT coalesce(e.country, 'ALL') AS country, count(*) AS entities, round(avg(coalesce(a.k, 0)), 6) AS mean_k, round(avg(CAST(coalesce(a.k, 0) = 0 AS INTEGER)), 6) AS singletons, round(CASE WHEN sum(a.k) > 0 THEN sum(a.s2)::DOUBLE / sum(a.k) ELSE 0.0::DOUBLE END, 6) AS s2_share, round(avg(coalesce(x.nc, 0)), 6) AS mean_cand FROM ent e LEFT JOIN (SELECT country, q, count(*) AS k, count(*) FILTER (starts_with(c, 'S2-')) AS s2 FROM acc GROUP BY ALL) a ON e.country = a.country AND e.q = a.q LEFT JOIN (SELECT country, q, count(*) AS nc FROM cand GROUP BY ALL) x ON e.country = x.country AND e.q = x.q GROUP BY ROLLUP (e.country)"))(
    lambda w: submission.profile(w.accepted, w.cand, w.entities)
)
query("disjointness_violations", sql("SELECT count(*) AS contested, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS wrong, coalesce(max(n), 0) AS worst FROM (SELECT country, c, count(DISTINCT q) AS n FROM acc GROUP BY ALL HAVING count(DISTINCT q) > 1)"))(lambda w: submission.violations(w.accepted))

query("stage_compare", sql("SELECT kind, count(y) AS right, count(*) - count(y) AS wrong FROM (SELECT x.*, t.c AS y FROM (SELECT country, q, c, 'gained' AS kind FROM top2 WHERE NOT EXISTS (SELECT 1 FROM acc a WHERE a.country = top2.country AND a.q = top2.q AND a.c = top2.c) UNION ALL SELECT country, q, c, 'lost' FROM acc WHERE NOT EXISTS (SELECT 1 FROM top2 a WHERE a.country = acc.country AND a.q = acc.q AND a.c = acc.c)) x LEFT JOIN truth t ON x.country = t.country AND x.q = t.q AND x.c = t.c) GROUP BY kind", top2="SELECT country, q, c FROM (SELECT *, row_number() OVER (PARTITION BY country, q ORDER BY p DESC, c) AS rn FROM sc) WHERE rn <= 2"))(
    lambda w: decision.compare_stages(w.accepted, decision.fixed_top(w.scored, 2), w.truth)
)
query("redecide")(lambda w: decision.redecide(w.scored, w.accepted, w.p_zero))
query("loss_table")(lambda w: decision.loss_table(decision.entity_scores(w.accepted, w.truth, w.entities), w.errors))
query("density_verdict", sql("SELECT country, mean_k, CASE WHEN mean_k / 2.0::DOUBLE - 1 > 0.12 THEN 'denser' WHEN mean_k / 2.0::DOUBLE - 1 < -0.05 THEN 'sparser' ELSE 'in line' END AS verdict FROM (SELECT coalesce(country, 'ALL') AS country, round(avg(k), 6) AS mean_k FROM es GROUP BY ROLLUP (country))"))(lambda w: decision.density(submission.profile(w.accepted, w.cand, w.entities), 2.0))
_CAND = "SELECT country, q, c FROM (SELECT *, row_number() OVER (PARTITION BY country, q ORDER BY m DESC, c) AS rn FROM (SELECT country, q, c, max(score) AS m FROM long WHERE {where} GROUP BY ALL)) WHERE rn <= " + str(K.candidate_cap)
query("channel_report", sql("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN f.c IS NOT NULL AND l.c IS NOT NULL THEN 'kept' WHEN f.c IS NOT NULL THEN 'gained' ELSE 'pushed out' END AS kind FROM own2 t LEFT JOIN fullc f ON t.country = f.country AND t.q = f.q AND t.c = f.c LEFT JOIN lessc l ON t.country = l.country AND t.q = l.q AND t.c = l.c WHERE f.c IS NOT NULL OR l.c IS NOT NULL) GROUP BY kind", fullc=_CAND.format(where="true"), lessc=_CAND.format(where="ch <> 'c4_addr_pair'")))(
    lambda w: retrieval.without_channel(w.records, K, w.blocks)
)
query("stacked_scores")(lambda w: scoring.stack(_labelled(w), _FEATURES, w.sets, 2, rounds=3, depth=3).select("country", "q", "c", "y", "p"))

# Learnt tables, transliteration, probes, splits.

query("mining_provenance")(lambda w: mining.provenance(w.mined))
query("replacements_by_country")(lambda w: mining.replacement_table(w.events, mining.confident_tokens(w.mined), ("abbrev", "expansion"), 1))
query("typos")(lambda w: mining.replacement_table(w.events, mining.confident_tokens(w.mined), ("typo",), 2))
query("acronym_table")(lambda w: _acronyms(w))
query("region_codes")(lambda w: mining.region_codes(mining.replacement_table(w.events, mining.confident_tokens(w.mined), ("abbrev", "expansion"), 1), _acronyms(w)))


def _acronyms(w: Work) -> DataFrame:
    return mining.replacement_table(w.events, mining.confident_tokens(w.mined), ("contract", "expand"), 1)


# Latin records and what a Devanagari source makes of them, with repeats.
_SCRIPTS = [
    ("sharma private limited", "शर्मा प्राइवेट लिमिटेड", 12), ("kamal traders", "कमल ट्रेडर्स", 9), ("ambani mart", "अंबानी मार्ट", 8), ("kamla devi", "कमला देवी", 7), ("gupta private limited", "गुप्ता प्राइवेट लिमिटेड", 11),
    ("rama stores", "रामा स्टोर्स", 6), ("sarkar foods", "सरकार फूड्स", 6), ("hindi press", "हिंदी प्रेस", 5), ("mumbai motors", "मुंबई मोटर्स", 9), ("sundar motors limited", "सुंदर मोटर्स लिमिटेड", 10),
]


def _scripts(w: Work) -> DataFrame:
    rows = w.spark.createDataFrame(_SCRIPTS, "x string, y string, n int")
    return translit_mining.word_pairs(rows.select("x", "y", F.explode(F.sequence(F.lit(1), F.col("n")))))


def _fit_report(w: Work) -> DataFrame:
    pairs_ = cut(_scripts(w))
    own = pairs_.where(~translit_mining.held_out("word"))
    return translit_mining.report(pairs_.where(translit_mining.held_out("word")), own, translit_mining.fit(own, 3, 0.6, 2, 2))


query("source_signatures")(lambda w: mining.signatures(w.mined))
query("neighbour_coverage", sql("SELECT count(*) AS pairs, count(n.c) AS covered, round(count(n.c)::DOUBLE / count(*), 6) AS share FROM (SELECT s.country, s.q, o.owner FROM sc s JOIN own o ON s.country = o.country AND s.c = o.c WHERE o.owner <> s.q) x LEFT JOIN near n ON n.country = x.country AND n.q = x.q AND n.c = x.owner"))(
    lambda w: scoring.neighbour_coverage(w.scored, w.owner, w.near)
)
query("policy_comparison", sql(f"SELECT policy, round(avg(f), 6) AS f05, round(avg(f) FILTER (size > 1), 6) AS f05_chains, sum(k)::BIGINT AS accepted FROM (SELECT 'choose_k' AS policy, * FROM es UNION ALL SELECT 'top2', * FROM ({oracle.entity('t2')})) e JOIN (SELECT country, id AS q, count(*) OVER (PARTITION BY country, name) AS size FROM r WHERE src = 1) USING (country, q) GROUP BY policy", t2="SELECT country, q, c FROM (SELECT *, row_number() OVER (PARTITION BY country, q ORDER BY p DESC, c) AS rn FROM sc) WHERE rn <= 2"))(
    lambda w: scoring.compare_policies({"choose_k": w.accepted, "top2": decision.fixed_top(w.scored, 2)}, w.truth, w.entities, w.records)
)
query("break_even", sql("SELECT country, q, round(f / (1 + f), 6) AS least FROM es"))(lambda w: decision.entity_scores(w.accepted, w.truth, w.entities).select("country", "q", F.round(scoring.break_even(F.col("f")), 6).alias("least")))
query("translit_word_pairs")(_scripts)
query("translit_unit_cuts")(lambda w: translit_mining.cut_units(_scripts(w)).select("word", "latin", F.array_join("subs", "|").alias("subs")))
query("translit_options")(lambda w: translit_mining.match_rates(_scripts(w), {str(sorted(k for k, v in o.items() if v)): translit.Model(opts=o).by_units for o in translit_mining.OPTIONS}))
query("translit_lexicon")(lambda w: translit_mining.lexicon(_scripts(w), translit.Model(), 5, 0.6))
query("translit_report")(_fit_report)

_UNITS = [("शर्मा", "श:C र्:H मा:M", "sharmaa", "sharma"), ("कमला", "क:C म:C ला:M", "kamalaa", "kamla"), ("कमल", "क:C म:C ल:C", "kamal", "kamal"), ("अंबानी", "अ:V ं:N बा:M नी:M", "anbaanee", "ambani"), ("सरकार", "स:C र:C का:M र:C", "sarakaar", "sarkar"), ("दुःख", "दु:M ः:X ख:C", "duhkh", "duhkh")]


@query("translit_units", "SELECT word, units, rules, options FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in _UNITS) + ") t(word, units, rules, options)")
def _(w):
    @F.pandas_udf("units string, rules string, options string")
    def spell(s):
        import pandas as pd

        model = translit.Model(opts={"schwa": True, "nasal": True, "short": True})
        return pd.DataFrame([(" ".join(f"{u.key}:{u.kind}" for u in translit.units(t)), translit.by_rules(t), model.by_units(t)) for t in s], columns=["units", "rules", "options"])

    return w.spark.createDataFrame([(u[0],) for u in _UNITS], "word string").select("word", spell("word").alias("s")).select("word", "s.*")


_NUM = "CAST(regexp_extract({c}, '-([0-9]+)$', 1) AS BIGINT)"
query("id_format", sql(f"SELECT CAST(src AS BIGINT) AS src, country, count(*) AS n, 1.0::DOUBLE AS numeric, min({_NUM.format(c='id')}) AS low, max({_NUM.format(c='id')}) AS high, count(DISTINCT {_NUM.format(c='id')}) AS \"distinct\" FROM r GROUP BY src, country"))(lambda w: probes.id_format(w.records))
query("owner_neighbours", sql(f"SELECT source, links, same, round(squares / (links * links)::DOUBLE, 9) AS random FROM (SELECT source, count(*) AS links, CAST(coalesce(sum(s), 0) AS BIGINT) AS same FROM (SELECT substr(c, 1, 2) AS source, CAST(lag(q) OVER (PARTITION BY substr(c, 1, 2), country ORDER BY {_NUM.format(c='c')}, q) = q AS BIGINT) AS s FROM truth) GROUP BY source) JOIN (SELECT source, sum(m * m) AS squares FROM (SELECT substr(c, 1, 2) AS source, count(*) AS m FROM truth GROUP BY substr(c, 1, 2), country, q) GROUP BY source) USING (source)"))(
    lambda w: probes.owner_neighbours(w.truth)
)
_MARKED = "SELECT r.*, CAST(t.c IS NOT NULL AS INTEGER) AS matched FROM r LEFT JOIN (SELECT DISTINCT country, c FROM own2 WHERE CAST(substr(c, 4) AS BIGINT) % 4 <> 0) t ON r.country = t.country AND r.id = t.c WHERE r.src <> 1"
query("rank_spread", sql(f"SELECT CAST(src AS BIGINT) AS src, country, matched, count(*) AS n, {', '.join(f'round(quantile_cont(pos, 0.{x}), 6) AS q{x}' for x in (10, 50, 90))} FROM (SELECT *, (row_number() OVER (PARTITION BY src, country ORDER BY {_NUM.format(c='id')}, id) - 1)::DOUBLE / count(*) OVER (PARTITION BY src, country) AS pos FROM mk) GROUP BY src, country, matched", mk=_MARKED))(
    lambda w: probes.rank_spread(w.records, _some_links(w))
)
query("rank_offsets", sql(f"SELECT source, count(*) AS n, round(avg(d), 6) AS mean, {', '.join(f'round(quantile_cont(d, 0.{x}), 6) AS q{x}' for x in (10, 50, 90))} FROM (SELECT substr(t.c, 1, 2) AS source, b.pos - a.pos AS d FROM truth t JOIN ra a ON a.country = t.country AND a.id = t.q JOIN ra b ON b.country = t.country AND b.id = t.c) GROUP BY source", ra=f"SELECT country, id, (row_number() OVER (PARTITION BY src ORDER BY {_NUM.format(c='id')}, id) - 1)::DOUBLE / count(*) OVER (PARTITION BY src) AS pos FROM r"))(
    lambda w: probes.rank_offsets(w.records, w.truth)
)
_FEATS = {
    "name chars": "length(raw_name)", "name tokens": "len(list_filter(string_split_regex(raw_name, '[ \\t\\n\\r]+'), lambda v: v <> ''))", "addr chars": "length(raw_addr)", "addr empty": "CAST(raw_addr = '' AS INTEGER)", "devanagari": "CAST(regexp_matches(raw_name, '[\\x{0900}-\\x{097F}]') AS INTEGER)",
    "junk marks": "CAST(regexp_matches(raw_name, '<<|>>|--|##|\\*\\*') AS INTEGER)", "all caps": "CAST(upper(raw_name) = raw_name AND lower(raw_name) <> raw_name AS INTEGER)", "all lower": "CAST(lower(raw_name) = raw_name AND upper(raw_name) <> raw_name AS INTEGER)",
    "digit in name": "CAST(regexp_matches(raw_name, '[0-9]') AS INTEGER)", "outer space": "CAST(trim(raw_name) <> raw_name AS INTEGER)", "double space": "CAST(contains(raw_name, '  ') AS INTEGER)", "postcode": "CAST(regexp_matches(raw_addr, '\\b[0-9]{5,6}\\b') AS INTEGER)",
    "name of src 1": "CAST(lower(raw_name) IN (SELECT lower(raw_name) FROM r WHERE src = 1) AS INTEGER)",
}
query("record_signatures", sql(" UNION ALL ".join(f"SELECT CAST(src AS BIGINT) AS src, '{k}' AS feature, round(avg(CASE WHEN matched = 1 THEN ({v})::DOUBLE END), 6) AS matched, round(avg(CASE WHEN matched = 0 THEN ({v})::DOUBLE END), 6) AS other FROM mk GROUP BY src" for k, v in _FEATS.items()), mk=_MARKED))(
    lambda w: probes.signatures(w.records, _some_links(w))
)
query("twin_rates", sql("SELECT matched, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM r x WHERE x.src = 3 AND x.country = mk.country AND lower(x.raw_name) = lower(mk.raw_name))) AS twins FROM mk WHERE src = 2 GROUP BY matched", mk=_MARKED))(lambda w: probes.twin_rates(w.records, _some_links(w)))


def _some_links(w: Work) -> DataFrame:
    """The block truth without every fourth record, so that there are records of both kinds."""
    return w.blocks.where(F.substring("c", 4, 20).cast("long") % 4 != 0)


_PLACED = "SELECT country, id, row_number() OVER (PARTITION BY country ORDER BY md5(id), id) - 1 AS pos, count(*) OVER (PARTITION BY country) AS n FROM r WHERE src {s} 1"
_RANDOM = f"SELECT a.country, a.id AS q, b.id AS c FROM ({_PLACED.format(s='=')}) a JOIN ({_PLACED.format(s='<>')}) b ON a.country = b.country AND a.pos % b.n = b.pos"
query("random_pair_separability", sql("""SELECT 'random' AS kind, count(*) AS n, round(avg(nm_exact), 6) AS name_equal, round(avg(nm_jac), 6) AS nm_mean, round(quantile_cont(nm_jac, 0.5), 6) AS nm_median, round(avg(CAST(nm_jac = 0 AS INTEGER)), 6) AS nm_zero, round(avg(CAST(nm_jac >= 0.5 AS INTEGER)), 6) AS nm_half, round(avg(ad_jac), 6) AS ad_mean, round(avg(CAST(dg_shared > 0 AS INTEGER)), 6) AS digit
  FROM sf JOIN df_ USING (country, q, c)""", cand=_RANDOM))(lambda w: _random_separability(w))  # fmt: skip


def _random_separability(w: Work) -> DataFrame:
    s = cut(pairs.with_sets(probes.random_pairs(w.records), w.records))
    return evaluate.separability(pairs.string_features(s).join(pairs.digit_features(s), ["country", "q", "c"]).withColumn("kind", F.lit("random")))


query("entity_split", sql("SELECT country, q, CASE WHEN r < 40 THEN 'train' WHEN r < 40 + floor(least(n - 40, 30) / 2.0) THEN 'calibrate' ELSE 'held out' END AS part FROM (SELECT country, q, row_number() OVER (PARTITION BY country ORDER BY md5(q), q) - 1 AS r, count(*) OVER (PARTITION BY country) AS n FROM ent) WHERE r < 70"))(
    lambda w: scoring.split_entities(w.entities, 40, 30)
)

# One bad row of each kind: the matches, the candidates, the entities and the corpus ids they are checked against.
_BAD = (
    [("e1", "S2-1,S2-1"), ("e2", "S2-2"), ("e2", "S2-2"), ("x9", ""), ("e3", "S9-7"), ("e4", "S3-3")],
    [("e1", "S2-1"), ("e2", "S2-2"), ("e3", "S9-7"), ("e4", "")], ["e1", "e2", "e3", "e4", "e5"], ["S2-1", "S2-2", "S3-3"],
)
_COUNTS = {"missing entity": 1, "extra entity": 1, "repeated entity": 1, "bad prefix": 2, "unknown record": 2, "repeated record": 1, "match not a candidate": 1}
query("submission_bad_rows", " UNION ALL ".join(f"SELECT '{k}' AS \"check\", CAST({n} AS BIGINT) AS n" for k, n in _COUNTS.items()))(
    lambda w: submission.validate(*(w.spark.createDataFrame(x, "q string, ids string") for x in _BAD[:2]), *(w.spark.createDataFrame([(v,) for v in x], f"{c} string") for x, c in zip(_BAD[2:], ("q", "id"))))
)
