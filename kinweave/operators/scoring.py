"""Pair models, calibration and entity features."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..checkpoints import cut
from ..functions import text as tx
from . import index
from .retrieval import CHANNELS


def simple_score(features: DataFrame) -> DataFrame:
    """(country, q, c, p) by a fixed rule, for tests and queries without a model."""
    return features.select("country", "q", "c", F.least(F.lit(0.99), F.round(0.5 * F.col("nm_jac") + 0.5 * F.col("ad_jac"), 4)).alias("p"))


def with_label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with y: 1 for true links (country, q, c)."""
    t = truth.select("country", "q", "c").distinct().withColumn("y", F.lit(1))
    return pairs.join(t, ["country", "q", "c"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def fold_of(q: Column, folds: int) -> Column:
    """An entity's fold; all its pairs share it."""
    return F.pmod(F.crc32(q.cast("binary")), F.lit(folds)).cast("int")


def split_entities(entities: DataFrame, train: int, valid: int) -> DataFrame:
    """(country, q, part): per country `train` entities to learn from and `valid` more, half to calibrate, half held out.

    Entities come in the order of a digest of their id, so each part is a fixed draw; the rest have no row.
    """
    order = Window.partitionBy("country").orderBy(F.md5(F.col("q").cast("binary")), "q")
    df = entities.select("country", "q").withColumn("r", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("country")))
    rest = F.least(F.col("n") - train, F.lit(valid))
    part = F.when(F.col("r") < train, "train").when(F.col("r") < train + F.floor(rest / 2), "calibrate").otherwise("held out")
    return df.where(F.col("r") < train + valid).select("country", "q", part.alias("part"))


def _vectors(df: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="_x", handleInvalid="keep").transform(df)


def fit_pairs(df: DataFrame, names: list[str], rounds: int = 20, depth: int = 5, weight: str | None = None):
    """A boosted-tree classifier of y on the named columns."""
    gbt = GBTClassifier(featuresCol="_x", labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=7)
    if weight:
        gbt = gbt.setWeightCol(weight)
    return gbt.fit(_vectors(df, names))


def predict(df: DataFrame, model, names: list[str], to: str = "p") -> DataFrame:
    out = model.transform(_vectors(df, names))
    return out.withColumn(to, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def out_of_fold(df: DataFrame, names: list[str], folds: int = 4, **kw) -> DataFrame:
    """df with p from a model that saw none of the entity's pairs. A side without both labels scores its share."""
    df = cut(df.withColumn("_fold", fold_of(F.col("q"), folds)))
    out = None
    for i in range(folds):
        rest, own = df.where(F.col("_fold") != i), df.where(F.col("_fold") == i)
        n, y = rest.agg(F.count("*"), F.sum("y")).first()
        if not n or y in (0, n):
            one = own.withColumn("p", F.lit(float(y or 0) / n if n else 0.5))
        else:
            one = predict(own, fit_pairs(rest, names, **kw), names)
        out = one if out is None else out.unionByName(one)
    return out.drop("_fold")


def fit_isotonic(df: DataFrame, score: str = "p"):
    return IsotonicRegression(featuresCol=score, labelCol="y", predictionCol="_iso").fit(df.withColumn(score, F.col(score).cast("double")))


def apply_isotonic(df: DataFrame, model, score: str = "p") -> DataFrame:
    """Interpolated between boundaries, constant outside."""
    return model.transform(df).withColumn(score, F.col("_iso")).drop("_iso")


def entity_features(scored: DataFrame, cand: DataFrame, entities: DataFrame, records: DataFrame) -> DataFrame:
    """What an entity's candidates and text say about whether it has any match; zeros without candidates."""
    group = Window.partitionBy("country", "q").orderBy(F.desc("p"), "c")
    rows = scored.join(cand.select("country", "q", "c", *CHANNELS), ["country", "q", "c"]).withColumn("_r", F.row_number().over(group))
    s2, s3 = F.col("c").startswith("S2-"), F.col("c").startswith("S3-")
    agg = rows.groupBy("country", "q").agg(
        F.count("*").alias("n_cand"), F.sum(s2.cast("long")).alias("n_s2"), F.sum(s3.cast("long")).alias("n_s3"), F.max("p").alias("best"),
        F.max(F.when(s2, F.col("p"))).alias("best_s2"), F.max(F.when(s3, F.col("p"))).alias("best_s3"), F.max(F.when(F.col("_r") == 2, F.col("p"))).alias("top2"),
        F.sum((F.col("p") > 0.5).cast("long")).alias("n_above"), F.round(F.sum("p"), 6).alias("sum_p"), F.round(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-6)))), 6).alias("indep_logp0"),
        *[F.round(F.max(n), 6).alias(f"best_{n}") for n in CHANNELS],
    )
    tok = index.exploded(records.where("src = 1"), "name").join(index.smoothed_idf(records, "name"), ["country", "token"])
    rare = tok.groupBy("country", F.col("id").alias("q")).agg(F.round(F.avg("idf"), 6).alias("name_rarity_mean"), F.round(F.max("idf"), 6).alias("name_rarity_max"))
    text = records.where("src = 1").select("country", F.col("id").alias("q"), F.size(tx.tokens(F.col("name"))).cast("long").alias("name_tokens"), F.size(tx.tokens(F.col("addr"))).cast("long").alias("addr_tokens"))
    df = entities.select("country", "q").join(agg, ["country", "q"], "left").join(rare, ["country", "q"], "left").join(text, ["country", "q"], "left").na.fill(0)
    return df.withColumn("gap12", F.round(F.col("best") - F.col("top2"), 6))


def singleton_head(df: DataFrame, names: list[str], folds: int = 4) -> DataFrame:
    """(country, q, p_zero): out-of-fold probability that an entity has no match, then isotonic; df holds y = (n = 0)."""
    scored = out_of_fold(df, names, folds, rounds=10, depth=3)
    return apply_isotonic(scored, fit_isotonic(scored)).select("country", "q", F.col("p").alias("p_zero"))


def hard_negative_category(pairs: DataFrame, owner: DataFrame, records: DataFrame, near: DataFrame) -> DataFrame:
    """pairs (with y) and category: positive, same_name (the owner bears the entity's name), sibling (the owner is one of its
    neighbours), else blocker."""
    names = records.where("src = 1").select("country", "id", "name")
    df = pairs.join(owner, ["country", "c"], "left")
    df = df.join(names.select("country", F.col("id").alias("q"), F.col("name").alias("_qn")), ["country", "q"], "left")
    df = df.join(names.select("country", F.col("id").alias("owner"), F.col("name").alias("_on")), ["country", "owner"], "left")
    df = df.join(near.select("country", "q", F.col("c").alias("owner"), F.lit(1).alias("_near")), ["country", "q", "owner"], "left")
    cat = F.when(F.col("y") == 1, "positive").when(F.col("_qn") == F.col("_on"), "same_name").when(F.col("_near") == 1, "sibling").otherwise("blocker")
    return df.withColumn("category", cat).drop("_qn", "_on", "_near")


def mix_weights(pairs: DataFrame, mix: dict[str, float], most: float = 20.0) -> DataFrame:
    """(category, n, weight): each negative category's share of all negative weight is its mix; empty ones are shared out."""
    n = pairs.groupBy("category").agg(F.count("*").alias("n"))
    share = F.create_map(*[x for k, v in mix.items() for x in (F.lit(k), F.lit(float(v)))])
    neg = Window.partitionBy((F.col("category") != "positive").cast("int"))
    n = n.withColumn("m", F.when(F.col("category") != "positive", F.coalesce(share[F.col("category")], F.lit(0.0))))
    per = F.least(F.lit(most), F.col("m") / F.sum("m").over(neg) * F.sum("n").over(neg) / F.col("n"))
    return n.select("category", "n", F.round(F.when(F.col("category") == "positive", 1.0).otherwise(per), 6).alias("weight"))


def importance(model, names: list[str]) -> list[tuple[str, float]]:
    """Features by the trees' gain, the greatest first."""
    return sorted(zip(names, map(float, model.featureImportances.toArray())), key=lambda x: (-x[1], x[0]))


def stack(df: DataFrame, names: list[str], sets: DataFrame, folds: int = 4, **kw) -> DataFrame:
    """Two stages: out-of-fold scores, then a second model that also sees how a pair agrees with its entity's best."""
    from .pairs import triangulation

    first = cut(out_of_fold(df, names, folds, **kw))
    extra = triangulation(first.select("country", "q", "c", "p"), sets)
    more = [c for c in extra.columns if c.startswith("tri_")]
    second = first.withColumnRenamed("p", "p_first").join(extra, ["country", "q", "c"])
    return out_of_fold(second, [*names, *more], folds, **kw)


def gate(head: DataFrame, product: DataFrame, least: float = 0.55) -> DataFrame:
    """(precision, head_f05, product_f05, passes): whether to trust a head. Both frames hold entity_scores' columns; a head
    passes if what it abstains on is mostly without matches and its F0.5 is no worse.
    """
    none = F.col("k") == 0
    h = head.agg((F.sum((none & (F.col("n") == 0)).cast("int")) / F.greatest(F.sum(none.cast("int")), F.lit(1))).alias("precision"), F.avg("f").alias("head_f05"))
    p = product.agg(F.avg("f").alias("product_f05"))
    return h.crossJoin(p).withColumn("passes", (F.col("precision") >= least) & (F.col("head_f05") >= F.col("product_f05")))


def category_coverage(pairs: DataFrame) -> DataFrame:
    """(category, n, mean_p) of categorised pairs with p."""
    return pairs.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"))


def break_even(f: Column) -> Column:
    """The precision of "no match" from which abstaining is worth more than answers of score f."""
    return f / (1 + f)


def neighbour_coverage(pairs: DataFrame, owner: DataFrame, near: DataFrame) -> DataFrame:
    """(pairs, covered, share): wrong candidates with an owner, and those whose owner is among the entity's neighbours."""
    wrong = pairs.join(owner, ["country", "c"]).where("owner <> q").select("country", "q", "owner")
    n = wrong.join(near.select("country", "q", F.col("c").alias("owner"), F.lit(1).alias("hit")), ["country", "q", "owner"], "left")
    return n.agg(F.count("*").alias("pairs"), F.count("hit").alias("covered")).withColumn("share", F.round(F.col("covered") / F.col("pairs"), 6))


def compare_policies(accepted: dict[str, DataFrame], truth: DataFrame, entities: DataFrame, records: DataFrame) -> DataFrame:
    """(policy, f05, f05_chains, accepted) of several decisions: over all entities, and over those that share their name."""
    from .decision import entity_scores

    name = Window.partitionBy("country", "name")
    size = records.where("src = 1").select("country", F.col("id").alias("q"), F.count("*").over(name).alias("size"))
    out = None
    for policy, rows in accepted.items():
        s = entity_scores(rows, truth, entities).join(size, ["country", "q"])
        one = s.agg(F.round(F.avg("f"), 6).alias("f05"), F.round(F.avg(F.when(F.col("size") > 1, F.col("f"))), 6).alias("f05_chains"), F.sum("k").alias("accepted"))
        one = one.select(F.lit(policy).alias("policy"), "f05", "f05_chains", "accepted")
        out = one if out is None else out.unionByName(one)
    return out
