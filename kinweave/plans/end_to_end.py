"""Train, predict and resume: a whole linkage run whose finished countries are not made again."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..checkpoints import cut
from ..config import Config
from ..operators import decision, pairs, retrieval, scoring, submission

FEATURES = ["nm_jac", "nm_cont", "nm_4gram", "nm_lenratio", "nm_exact", "ad_jac", "ad_cont"]


def train(features: DataFrame, truth: DataFrame, entities: DataFrame, n_train: int, n_valid: int):
    """(model, calibration, held-out scores): a pair model on the training part, isotonic on the calibration part (None without both labels)."""
    parts = cut(scoring.split_entities(entities, n_train, n_valid))
    labelled = cut(scoring.with_label(features.join(parts, ["country", "q"]), truth))
    model = scoring.fit_pairs(labelled.where("part = 'train'"), FEATURES, rounds=10, depth=4)
    rest = cut(scoring.predict(labelled.where("part <> 'train'"), model, FEATURES))
    both = rest.where("part = 'calibrate'").agg(F.count_distinct("y")).first()[0] == 2
    calibration = scoring.fit_isotonic(rest.where("part = 'calibrate'")) if both else None
    held = rest.where("part = 'held out'")
    return model, calibration, held if calibration is None else scoring.apply_isotonic(held, calibration)


def run(spark: SparkSession, records: DataFrame, truth: DataFrame, folder: str, cfg: Config = Config(), n_train: int = 12_000, n_valid: int = 6_000) -> DataFrame:
    """(q, matched_ids, candidate_ids) of every entity: candidates, model, calibration, decisions, one owner a record.

    records: (country, id, src, name, addr); truth: (country, q, c). Each country's rows are written with their manifest; a
    later run with the same configuration reuses what is whole, and trains nothing if all is.
    """
    config = asdict(cfg) | {"n_train": n_train, "n_valid": n_valid, "features": FEATURES}
    countries = [r["country"] for r in records.where("src = 1").select("country").distinct().orderBy("country").collect()]  # a partition each
    todo = [c for c in countries if submission.check_partial(spark, folder, c, config) is not None]
    if todo:
        records = cut(records)
        entities = records.where("src = 1").select("country", F.col("id").alias("q"))
        cand = cut(retrieval.candidates(records, cfg))
        features = cut(pairs.string_features(pairs.with_sets(cand, records)))
        model, calibration, _ = train(features, truth, entities, n_train, n_valid)
        scored = scoring.predict(features, model, FEATURES).select("country", "q", "c", "p")
        scored = cut(scored if calibration is None else scoring.apply_isotonic(scored, calibration))
        p_zero = cut(decision.product_p_zero(scored, entities))
        accepted = cut(decision.resolve_conflicts(scored, cut(decision.choose_k(scored, p_zero, cfg.recall, cfg.bar_scale)), p_zero, cfg.recall))
        for c in todo:
            own = F.col("country") == c
            rows = submission.rows(accepted.where(own), entities.where(own), "matched_ids").join(submission.rows(scored.where(own), entities.where(own), "candidate_ids"), "q")
            submission.write_partial(rows, folder, c, config)
    return submission.concat_partials(spark, folder, countries)
