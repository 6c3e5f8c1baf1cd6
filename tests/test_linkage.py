"""Named queries against DuckDB, and operators against plain Python."""

import random
import re

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from kinweave.config import SMALL
from kinweave.functions import text as tx, translit
from kinweave.operators import decision, graph, mining, probes, scoring, submission, translit_mining
from kinweave.plans import end_to_end
from kinweave.plans.catalog import ORACLES, QUERIES
from kinweave.sources import records as src

SOME = ["linkage_flagship", "norm_reduced", "channel_union", "pair_string_features", "grammar_features", "triangulation", "choose_k", "calibrate_fit", "decision_sweep", "abbreviations", "submission_rows", "fold_skeleton", "fn_categories", "miss_categories", "channel_report", "junk_affixes", "load_shard", "submission_bad_rows", "forbidden_pairs", "permutations", "density_verdict", "translit_units", "id_format", "owner_neighbours", "rank_spread", "rank_offsets", "record_signatures", "twin_rates", "random_pair_separability", "entity_split", "neighbour_coverage", "policy_comparison", "break_even"]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_oracle(spark, sf, oracle, name):
    same_rows(QUERIES[name](spark, sf), oracle.sql(ORACLES[name]))


def test_norm_of_ascii_columns_equals_the_plain_function(spark):
    rng = random.Random(3)
    words = ["S.A.R.L.", "M/s.", "Joe's", "B & B", "A/B/C", "Ltd", "12-B", "x", "y z", "", "  ", "a/b", "ab/c"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", tx.norm_ascii(F.col("t")).alias("n")).collect()}
    assert [got[i] for i in range(len(texts))] == [tx.norm_plain(t) for t in texts]


def test_norm_of_other_scripts():
    assert tx.norm_plain("Sœur") == tx.norm_plain("Soeur") == "soeur"
    assert tx.norm_plain("शर्मा") == "sharmaa" and tx.norm_plain("कमला") == "kamalaa" and tx.norm_plain("राम") == "raam"
    assert tx.norm_plain("McDonald’s") == "mcdonalds" and tx.norm_plain(None) == ""
    assert tx.norm_plain("प्राइवेट", translit.Model({"प्राइवेट": "private"})) == "private" and tx.norm_plain("कमल ९", translit.Model(opts={"schwa": True})) == "kamal 9"


def test_units_and_tables():
    kinds = lambda w: [(u.key, u.kind) for u in translit.units(w)]
    assert kinds("ज़मीन") == [("\u095b", "C"), ("मी", "M"), ("न", "C")] and kinds("क्\u200dष") == [("क्", "H"), ("ष", "C")]
    word = translit.units("सरकार")
    assert translit.kept(word, False) == [True, True, False, False] and translit.kept(word, True) == [True, False, False, False]
    assert [translit.context(word, i, translit.kept(word, True)) for i in range(4)] == ["^|C|1", "v|M|0", "\u093e|", "v|$|0"]
    assert translit.context(translit.units("अंबानी"), 1, [False] * 4) == "ं|p"
    assert translit.Model(opts={"schwa": True, "short": True, "nasal": True}).by_units("अंबानी") == "ambani" and translit.Model().by_units("कमला") == "kamalaa"
    assert translit.Model(tables={"vowel": {"\u093e|": "o"}, "cons": {"र": "rr"}, "schwa": {"^|C|1": 0}}).by_units("सरकार") == "srrakorr"
    assert translit.by_rules("राम \u093e क् ९अ") == "raam aa k 9a" and translit.by_rules("कx") == "kax"


def test_transliteration_is_learnt(spark):
    got = translit_mining.align_words("sharma private limited", "शर्मा प्राइवेट लिमिटेड")
    assert got == [("शर्मा", "sharma"), ("प्राइवेट", "private"), ("लिमिटेड", "limited")] and not translit_mining.align_words("शर्मा", "शर्मा") and not translit_mining.align_words("zzz qqq", "शर्मा")
    words = [("शर्मा", "sharma"), ("वर्मा", "varma"), ("कमला", "kamla"), ("विमला", "vimla"), ("सरकार", "sarkar"), ("दरबार", "darbar"), ("अंबानी", "ambani"), ("मुंबई", "mumbai"), ("रामा", "rama"), ("प्राइवेट", "private")]
    pairs = spark.createDataFrame([(w, t, 10) for w, t in words], "word string, latin string, n long")
    model = translit_mining.fit(pairs, 5, 0.6, 2, 2)
    assert all(model.word(w) == t for w, t in words) and model.opts["schwa"] and model.by_units("परमार") == "parmar"
    assert model.lexicon.get("प्राइवेट") == "private" and "रामा" not in model.lexicon
    rates = {(r.words, r.variant): r for r in translit_mining.report(pairs, pairs.where("latin <> 'rama'"), model).collect()}
    assert rates["all", "tables and lexicon"].exact == 1.0 and rates["all", "rules"].exact < 0.3 and rates["new", "rules with options"].n == 10
    cuts = {r.word: r.subs for r in translit_mining.cut_units(pairs).collect()}
    assert cuts["कमला"] == ["ka", "m", "la"] and cuts["अंबानी"] == ["a", "m", "ba", "ni"]


def choose(p, none, recall=1.0):
    p = sorted(p, reverse=True)
    if not p or p[0] * decision.FIRST_FACTOR <= none:
        return 0
    n, c = max(sum(p) / recall, 1e-9), 0.0
    for k, x in enumerate(p):
        if k and x <= 0.8 * (1.25 * c / (0.25 * n + k)):
            return k
        c += x
    return len(p)


def test_choose_k_equals_the_loop(spark):
    rng = random.Random(1)
    rows, none = [], []
    for q in range(200):
        for c in range(rng.randint(0, 8)):
            rows.append(("x", f"S1-{q}", f"S2-{q}-{c}", round(rng.random(), 3)))
        none.append(("x", f"S1-{q}", rng.random() ** 2))
    scored = spark.createDataFrame(rows, "country string, q string, c string, p double")
    pz = spark.createDataFrame(none, "country string, q string, p_zero double")
    got = {r.q: r.n for r in decision.choose_k(scored, pz, 0.9).groupBy("q").agg(F.count("*").alias("n")).collect()}
    for _, q, z in none:
        assert got.get(q, 0) == choose([r[3] for r in rows if r[1] == q], z, 0.9)


def test_conflicts_leave_one_owner(spark):
    rows = [("x", "A", "r1", 0.9), ("x", "B", "r1", 0.6), ("x", "B", "r2", 0.9), ("x", "C", "r3", 0.7), ("x", "D", "r3", 0.7)]
    scored = spark.createDataFrame(rows, "country string, q string, c string, p double")
    pz = spark.createDataFrame([("x", q, 0.01) for q in "ABCD"], "country string, q string, p_zero double")
    got = {(r.q, r.c) for r in decision.resolve_conflicts(scored, scored, pz).collect()}
    assert got == {("A", "r1"), ("B", "r2"), ("C", "r3")}


def brute_owners(rows, none):
    """The rule over all accepted pairs at once, without parting them."""
    total, n = {}, {}
    for q, _, p in rows:
        total[q], n[q] = total.get(q, 0) + p, n.get(q, 0) + 1
    n_hat = dict(total)
    kept = {(q, c): p for q, c, p in rows}

    def expected(q, s, k):
        return 1.25 * s / (0.25 * n_hat[q] + k) if k else none

    claims = {}
    for q, c, p in rows:
        claims.setdefault(c, []).append((q, p))
    for c, who in sorted(((c, w) for c, w in claims.items() if len(w) > 1), key=lambda x: (-max(p for _, p in x[1]), x[0])):
        gains = {q: expected(q, total[q], n[q]) - expected(q, total[q] - p, n[q] - 1) for q, p in who}
        best = min(gains, key=lambda q: (-gains[q], q))
        for q, p in who:
            if q != best or gains[best] <= 0:
                del kept[q, c]
                total[q] -= p
                n[q] -= 1
    return set(kept)


@pytest.mark.parametrize("kind", ["chain", "random"])
def test_conflicts_settle_over_whole_components(spark, kind):
    rng = random.Random(4)
    if kind == "chain":  # each of 80 entities shares a record with the next
        rows = [(f"q{i:02d}", f"r{j:02d}", round(rng.uniform(0.3, 0.95), 4)) for i in range(80) for j in (i, i + 1)]
    else:
        rows = [(q, c, p) for (q, c), p in {(f"q{rng.randrange(120):03d}", f"r{rng.randrange(150):03d}"): round(rng.uniform(0.2, 0.99), 4) for _ in range(260)}.items()]
    df = spark.createDataFrame([("x", *r) for r in rows], "country string, q string, c string, p double")
    none = spark.createDataFrame([("x", q, 0.05) for q in {r[0] for r in rows}], "country string, q string, p_zero double")
    got = {(r.q, r.c) for r in decision.resolve_conflicts(df, df, none).collect()}
    assert got == brute_owners(rows, 0.05) and len({c for _, c in got}) == len(got)


def test_components(spark):
    rng = random.Random(2)
    for edges in ([(i, i + 1) for i in range(200)], [(rng.randrange(300), rng.randrange(300)) for _ in range(220)], [(5, 5), (7, 6)]):
        label = {i: i for e in edges for i in e}
        for _ in label:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == label
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shapley_shares_sum_to_the_loss():
    for c, n, k, m, f in [(2, 4, 3, 1, 2), (0, 3, 2, 2, 1), (3, 3, 3, 0, 0), (1, 1, 4, 3, 0)]:
        wrong, missed = decision.shapley(c, n, k, m, f)
        def score(h, t):
            return 1.0 if n == t == 0 else 1.25 * h / (0.25 * n + t)
        assert abs(m * wrong + f * missed - (score(c + f, k - m + f) - score(c, k))) < 1e-12


def test_assignment_is_the_best():
    from itertools import permutations

    rng = random.Random(5)
    for _ in range(60):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        s = [[rng.random() for _ in range(m)] for _ in range(n)]
        got = sum(s[i][j] for i, j in mining.assign(s, 0.5))
        best = max(sum(s[i][j] for i, j in enumerate(p) if j < m and s[i][j] >= 0.5) for p in permutations(range(m + n), n))
        assert abs(got - best) < 1e-9


def test_alignment_and_acronyms(spark):
    def tokens(x, y):
        a, b = x.split(), y.split()
        return {(a[i] if i >= 0 else "", b[j] if j >= 0 else "", s) for i, j, s in mining.align_tokens(x, y)}

    assert tokens("sharma global corporation", "global sharma corp") == {("sharma", "sharma", 1.0), ("global", "global", 1.0), ("corporation", "corp", 0.9)}
    assert tokens("a a b", "a c") == {("a", "a", 1.0), ("a", "", 0.0), ("b", "", 0.0), ("", "c", 0.0)}
    assert mining.acronyms(["sgc"], [0], ["sharma", "global", "corp"], [0, 1, 2]) == [(0, [0, 1, 2])] and mining.acronyms(["sgc"], [0], ["sharma", "global", "corp"], [0, 2]) == []
    long = " ".join(f"a{i}" for i in range(40))
    df = spark.createDataFrame([("x", "S1-1", "S2-1", long, long.replace("a", "zzz")), ("x", "S1-2", "S2-2", "red nut", "red nuts"), ("x", "S1-3", "S2-3", None, "")], "country string, q string, c string, x string, y string")
    got = sorted((r.q, r.a, r.b, r.skipped) for r in mining.aligned(df).collect())
    assert got == [("S1-1", "", "", 1), ("S1-2", "nut", "nuts", 0), ("S1-2", "red", "red", 0)]


def test_permutation_kinds(spark):
    from itertools import permutations as every
    from math import factorial

    perms = [list(p) for n in (1, 2, 3, 4, 5) for p in every(range(n))]
    df = spark.createDataFrame([(p,) for p in perms], "m array<int>")
    kinds = {tuple(r.m): r.kind for r in df.select("m", mining.permutation_kind(F.col("m")).alias("kind")).collect()}
    want = {(0,): "n<2", (0, 1): "none", (1, 0): "swap2", (2, 0, 1): "last_to_front", (1, 2, 0): "first_to_end", (2, 1, 0): "reverse", (1, 0, 2): "adjacent_swap", (2, 0, 1, 3): "single_move", (3, 1, 2, 0): "other"}
    assert {k: kinds[k] for k in want} == want
    rows = [(n, k) for n in (2, 3, 4, 5) for k in {kinds[tuple(p)] for p in perms if len(p) == n} - {"none"}]
    chance = {(r.n, r.k): r.c for r in spark.createDataFrame(rows, "n int, k string").select("n", "k", mining.permutation_chance(F.col("n"), F.col("k")).alias("c")).collect()}
    for (n, k), c in chance.items():
        assert abs(c - sum(kinds[tuple(p)] == k for p in perms if len(p) == n) / (factorial(n) - 1)) < 1e-9


def test_mined_tables(spark):
    assert mining.events_of("sharma global corporation", "sharma global corp") == ("confident", [("identity", "sharma", "sharma", 0.0), ("identity", "global", "global", 0.5), ("abbrev", "corporation", "corp", 1.0)])
    state, events = mining.events_of("state bank india limited", "sbi limited")
    assert state == "confident" and ("contract", "state bank india", "sbi", 0.0) in events and len(events) == 2
    assert mining.events_of("red nut", "blue bolt")[0] == "doubtful" and mining.events_of("", "x") == ("empty", []) and mining.events_of(" ".join(map(str, range(99))), "z")[0] == "skipped"
    assert ("swap", "ltd", "corporation", 1.0) in mining.events_of("global foods ltd", "foods global corporation")[1]
    rows = [("x", "S2-1", "addr", "12 mill road maharashtra", "12 mill rd mh")] * 3 + [("y", "S3-1", "addr", "4 high road texas", "4 high rd tx"), ("x", "S2-2", "addr", "7 old lane uttar pradesh", "7 old lane up"), ("x", "S2-3", "name", "red nut", "blue bolt"), ("x", "S2-4", "name", None, "a")]
    mined = mining.mine(spark.createDataFrame(rows, "country string, c string, field string, x string, y string"))
    state = {(r.src, r.field): (r.pairs, r.confident, r.doubtful, r.empty, r.skipped) for r in mining.provenance(mined).collect()}
    assert state == {("S2", "addr"): (4, 4, 0, 0, 0), ("S3", "addr"): (1, 1, 0, 0, 0), ("S2", "name"): (2, 0, 1, 1, 0)}
    events, tokens = mining.event_table(mined), mining.confident_tokens(mined)
    short = mining.replacement_table(events, tokens, ("abbrev", "expansion"), 1)
    got = {(r.a, r.b): (r.n, r.n_s2, r.n_s3, r.p_b_given_a, r.mean_place, r.by_country) for r in short.collect()}
    assert got[("road", "rd")] == (4, 3, 1, 1.0, 0.667, "x:3,y:1") and got[("texas", "tx")] == (1, 0, 1, 1.0, 1.0, "y:1")
    phrases = mining.replacement_table(events, tokens, ("contract", "expand"), 1)
    assert {(r.long, r.short, r.by) for r in mining.region_codes(short, phrases).collect()} == {("road", "rd", "place"), ("maharashtra", "mh", "place"), ("texas", "tx", "place"), ("uttar pradesh", "up", "initials")}


def test_grammar_of_json(spark, tmp_path):
    import json

    from kinweave.sources import models

    tables = {
        "abbreviations": {"name": [{"s1": "corporation", "s2": "corp", "kind": "abbrev", "p_s2_given_s1": 0.45}, {"s1": "a b", "s2": "c", "p_s2_given_s1": 0.5}, {"s1": "x", "s2": "y", "p_s2_given_s1": 1.5}], "address": [{"s1": "haryana", "s2": "hr"}, {"s1": "road", "s2": "rd"}]},
        "region_codes": {"entries": [{"s1": "haryana", "s2": "hr"}, {"long": "uttar pradesh", "short": "up", "direction": "contract"}]}, "acronyms": {"name": [{"long": "red nut", "short": "rn", "direction": "expand"}]},
        "forbidden": {"name": [{"s1": "corporation", "s2": "corp"}, {"s1": "corporation", "s2": "inc"}], "address": [{"s1": "road", "s2": "road"}]},
    }
    (tmp_path / "g.json").write_text(json.dumps(tables))
    got = [tuple(r) for r in models.load_grammar(spark, str(tmp_path / "g.json")).collect()]
    assert got == [
        ("name", "abbrev", ["corporation"], ["corp"], 0.45), ("addr", "region", ["haryana"], ["hr"], 1.0), ("addr", "region", ["uttar", "pradesh"], ["up"], 1.0), ("addr", "cover", ["road"], ["rd"], 1.0),
        ("name", "cover", ["rn"], ["red", "nut"], 1.0), ("name", "forbid", ["corporation"], ["inc"], 1.0),
    ]
    assert models.load_grammar(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "t.json").write_text(json.dumps({"lexicon": {"कमल": "kamal"}, "tables": {"cons": {"र": "rr"}}, "opts": {"schwa": True}}))
    assert models.load_translit(str(tmp_path / "t.json")).text("कमल सरकार") == "kamal sarrkaarr"


def test_models_calibration_and_gate(spark):
    rng = random.Random(7)
    rows = [("x", f"S1-{i % 40}", f"S2-{i}", rng.random()) for i in range(600)]
    df = spark.createDataFrame([(*r, r[3] + 0.2 * rng.random(), int(r[3] + 0.3 * rng.random() > 0.65)) for r in rows], "country string, q string, c string, a double, b double, y int")
    model = scoring.fit_pairs(df, ["a", "b"], rounds=5, depth=3)
    out = scoring.predict(df, model, ["a", "b"]).toPandas()
    assert ((out.p > 0.5) == (out.y == 1)).mean() > 0.85 and {n for n, _ in scoring.importance(model, ["a", "b"])} == {"a", "b"}
    oof = scoring.out_of_fold(df, ["a", "b"], 3, rounds=5, depth=3).toPandas()
    assert len(oof) == 600 and 0.75 < ((oof.p > 0.5) == (oof.y == 1)).mean() < 1
    assert {r.p for r in scoring.out_of_fold(df.withColumn("y", F.lit(1)), ["a"], 2).collect()} == {1.0}
    rough = df.withColumn("p", F.col("a") / 2)
    calm = scoring.apply_isotonic(rough, scoring.fit_isotonic(rough)).toPandas().sort_values("a")
    assert calm.p.is_monotonic_increasing and abs(calm.p.mean() - calm.y.mean()) < 1e-6
    s = lambda rows: spark.createDataFrame(rows, "hit int, n int, k int, f double")
    good = scoring.gate(s([(0, 0, 0, 1.0), (1, 1, 1, 1.0)]), s([(0, 0, 1, 0.0), (1, 1, 1, 1.0)])).first()
    bad = scoring.gate(s([(0, 2, 0, 0.0), (1, 1, 1, 1.0)]), s([(1, 1, 1, 1.0)])).first()
    assert good.passes and good.precision == 1.0 and not bad.passes
    head = scoring.singleton_head(spark.createDataFrame([("x", f"S1-{i}", i / 100, int(i > 60)) for i in range(100)], "country string, q string, best double, y int"), ["best"], 2).toPandas()
    assert len(head) == 100 and head.p_zero.between(0, 1).all() and head.p_zero[head.q == "S1-95"].iloc[0] > 0.5


def two_countries(spark):
    """A chain of branches and one record without text, and another country."""
    rows = [("India", f"S1-{i}", 1, "sharma medical store", f"{i} mill road") for i in range(1, 13)] + [("India", "S1-99", 1, "", "")]
    rows += [("India", f"S{2 + i % 2}-{i}", 2 + i % 2, "sharma medical store", f"{i} mill rd") for i in range(1, 13)] + [("Mexico", f"S1-{i}", 1, f"tacos {n}", "1 calle") for i, n in ((50, "gordo"), (51, "flaco"))]
    rows += [("Mexico", "S2-60", 2, "tacos gordo", "1 calle"), ("Mexico", "S3-61", 3, "tacos flaco", "1 calle")]
    truth = [("India", f"S1-{i}", f"S{2 + i % 2}-{i}") for i in range(1, 13)] + [("Mexico", "S1-50", "S2-60"), ("Mexico", "S1-51", "S3-61")]
    return spark.createDataFrame(rows, "country string, id string, src int, name string, addr string"), spark.createDataFrame(truth, "country string, q string, c string")


def test_train_predict_and_resume(spark, tmp_path, monkeypatch):
    records, truth = two_countries(spark)
    folder = str(tmp_path / "run")
    first = {r.q: (r.matched_ids, r.candidate_ids) for r in end_to_end.run(spark, records, truth, folder, SMALL, 10, 4).collect()}
    assert len(first) == 15 and first["S1-99"] == ("", "") and any(m for m, _ in first.values())
    owners = [c for m, _ in first.values() for c in m.split(",") if c]
    assert len(owners) == len(set(owners)) and all(set(filter(None, m.split(","))) <= set(k.split(",")) for m, k in first.values())
    monkeypatch.setattr(end_to_end, "train", lambda *a: pytest.fail("nothing is left to train"))
    assert {r.q: (r.matched_ids, r.candidate_ids) for r in end_to_end.run(spark, records, truth, folder, SMALL, 10, 4).collect()} == first
    monkeypatch.undo()
    assert {r.k: r.n for r in submission.cardinality(spark, folder, "Mexico").collect()} == {sum(c != "" for c in first[q][0].split(",")): sum(len(list(filter(None, first[x][0].split(",")))) == len(list(filter(None, first[q][0].split(",")))) for x in ("S1-50", "S1-51")) for q in ("S1-50", "S1-51")}
    got = submission.write_result(spark, folder, ["India", "Mexico"], str(tmp_path / "result"))
    assert got == {"rows": 15, "with a match": sum(m != "" for m, _ in first.values())} and submission.safe_name("Côte d'Ivoire") != submission.safe_name("Côte d-Ivoire")
    lines = spark.read.csv(str(tmp_path / "result" / "matches"), sep="\t", header=True).collect()
    assert {(r.source1_entity_id, r.matched_entity_ids or "") for r in lines} == {(q, m) for q, (m, _) in first.items()}
    import shutil

    shutil.rmtree(f"{folder}/country=Mexico/rows")
    again = {r.q: (r.matched_ids, r.candidate_ids) for r in end_to_end.run(spark, records, truth, folder, SMALL, 10, 4).collect()}
    submission.clear(spark, folder, ["Mexico"])
    assert submission.check_partial(spark, folder, "Mexico", {}).startswith("no partial") and submission.check_partial(spark, folder, "India", {}) == "another configuration"
    assert {q: v for q, v in again.items() if q < "S1-50"} == {q: v for q, v in first.items() if q < "S1-50"} and len(again) == 15


def test_profile_and_sources(spark, tmp_path):
    import time

    from kinweave.operators.profiling import Profile
    from kinweave.sources import checks

    p = Profile()
    with p.stage("outer", 10):
        with p.stage("inner"):
            time.sleep(0.05)
    rows = {r[0]: r for r in p.table()}
    assert rows["inner"][1] >= 0.05 > rows["outer"][1] and rows["outer"][2] == 10 and rows["outer"][4] > 0 and Profile(False).table() == []
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-2\nS1-2\t\n")
    truth = src.read_truth_tsv(spark, str(tmp_path / "t.tsv"))
    assert [(r[0], r[1]) for r in truth.orderBy("source1_entity_id").collect()] == [("S1-1", "S2-1,S3-2"), ("S1-2", "")]
    df = spark.createDataFrame([("a", 1), ("b", 2)], "country string, v int")
    for part in (df, df.where("country = 'b'").withColumn("v", F.lit(9))):
        src.write_partitioned(part, str(tmp_path / "parts"))
    assert {(r.country, r.v) for r in spark.read.parquet(str(tmp_path / "parts")).collect()} == {("a", 1), ("b", 9)}
    assert src.file_stamp(spark.read.parquet(str(tmp_path / "parts"))).count() == 2
    assert [r.n for r in spark.createDataFrame([("ﬁne Œuvre №",), (None,)], "t string").select(tx.norm_audit(F.col("t")).alias("n")).collect()] == ["fine uvre no", ""]
    (tmp_path / "bad.tsv").write_text("q\tids\nS1-1\tS2-1\nS1-1\tS2-1\nS1-2\tS2-2\tx\nS1-3\t\r\nq\tids\n")
    assert {r.check: r.n for r in checks.check_tsv(spark, str(tmp_path / "bad.tsv"), "q\tids").collect()} == {"header": 1, "carriage return": 1, "fields": 1, "repeated row": 1, "repeated id": 1}
    assert {r.q: r.c for r in checks.read_result(spark, str(tmp_path / "t.tsv"), "c").collect()} == {"S1-1": ["S2-1", "S3-2"], "S1-2": []}


def test_random_pairs_and_splits(spark):
    records, _ = two_countries(spark)
    got = probes.random_pairs(records, 2).collect()
    assert len(got) == 30 and all(not r.c.startswith("S1") for r in got)
    parts = scoring.split_entities(records.where("src = 1").select("country", F.col("id").alias("q")), 6, 5).groupBy("country", "part").count().collect()
    assert {(r.country, r.part): r["count"] for r in parts} == {("India", "train"): 6, ("India", "calibrate"): 2, ("India", "held out"): 3, ("Mexico", "train"): 2}


def test_tsv_and_partials(spark, tmp_path):
    path = tmp_path / "s.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tThe "Quoted\t1 Rd\tFrance\nS1-2\tB\t\tIndia\n')
    df = src.read_source_tsv(spark, str(path))
    assert [r.business_name for r in df.orderBy("entity_id").collect()] == ['The "Quoted', "B"]
    truth = spark.createDataFrame([("S1-1", "S2-1,S3-4"), ("S1-2", "")], src.TRUTH_SCHEMA)
    assert {tuple(r) for r in src.explode_truth(truth).collect()} == {("S1-1", "S2-1"), ("S1-1", "S3-4")}
    out = str(tmp_path / "parts")
    submission.write_partial(df, out, "France", {"cap": 1})
    assert submission.check_partial(spark, out, "France", {"cap": 1}) is None
    assert submission.check_partial(spark, out, "France", {"cap": 2}) == "another configuration"
    assert submission.check_partial(spark, out, "India", {"cap": 1}).startswith("no partial")


def test_incremental_linking(spark, tmp_path):
    from kinweave.streaming import incremental

    clean = spark.createDataFrame([("x", "S1-1", 1, "red ring", "1 road"), ("x", "S1-2", 1, "blue nut", "2 road")], "country string, id string, src int, name string, addr string")
    clean.write.parquet(str(tmp_path / "clean"))
    spark.createDataFrame([("x", "S2-9", 2, "ring red", "1 road")], clean.schema).write.parquet(str(tmp_path / "in"))
    q = incremental.link_stream(spark.readStream.schema(clean.schema).parquet(str(tmp_path / "in")), spark.read.parquet(str(tmp_path / "clean")), str(tmp_path / "out"), str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert [(r.q, r.c) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("S1-1", "S2-9")]


def test_top_k_by_blocks(spark, monkeypatch):
    """Blocks far smaller than a country give the rows that all pairs give: copies, ties, texts without an answer, oneself."""
    from kinweave.operators import index, retrieval, topk

    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = [("x" if i % 5 else "y", f"S{1 + i % 3}-{i}", 1 + i % 3, " ".join(rng.choices(words, k=rng.randint(0, 4)))) for i in range(400)]
    rows += [("x", f"S{1 + i % 3}-{i}", 1 + i % 3, "w1 w2 w3") for i in range(400, 460)]
    records = spark.createDataFrame(rows, "country string, id string, src int, name string")
    post = index.postings(records, "name", 120)
    seen = []
    monkeypatch.setattr(topk, "best", lambda v, k, f=topk.best: (seen.append(k), f(v, k, (8, 16)))[1])
    for answer, got in (("src <> 1", retrieval.token_top_k(records, "name", 120, 7)), ("src = 1", retrieval.neighbours(records, "name", 120, 7))):
        a, b = post.where("src = 1").withColumnsRenamed({"id": "q", "w": "wq"}).drop("src"), post.where(answer).withColumnsRenamed({"id": "c", "w": "wc"}).drop("src")
        want = retrieval.top_k(a.join(b, ["country", "token"]).where("q <> c").groupBy("country", "q", "c").agg(F.round(F.sum(F.col("wq") * F.col("wc")), 6).alias("score")), 7)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert seen == [8, 8]


def test_joins_before_features_carry_texts_alone(spark):
    """Sets are made behind the joins, so no shuffle holds one; empty texts and copies have their features."""
    from kinweave.operators import pairs

    texts = [("a b", "1 x"), ("a b", ""), ("", "1 x"), ("abcd e", "2 x y"), ("abcde", "2")]
    records = spark.createDataFrame([("x", f"S{1 + i % 3}-{i}", *t) for i, t in enumerate(texts)], "country string, id string, name string, addr string")
    cand = records.select("country", F.col("id").alias("q")).crossJoin(records.select(F.col("id").alias("c")))
    sets = pairs.with_sets(cand, records)
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan[plan.index("Join") :]
    got = {(r.q, r.c): r for r in pairs.string_features(sets).collect()}
    assert len(got) == 25
    copy, other = got["S1-0", "S2-1"], got["S1-3", "S2-4"]
    assert (copy.nm_jac, copy.nm_exact, copy.ad_jac, copy.ad_empty_q, copy.ad_empty_c) == (1.0, 1, 0.0, 0, 1)
    assert (other.nm_jac, other.nm_4gram, other.nm_lenratio, other.ad_jac, other.ad_cont) == (0.0, 1.0, 0.833333, 0.333333, 1.0)
    assert (got["S3-2", "S3-2"].nm_exact, got["S3-2", "S3-2"].nm_lenratio) == (0, 0.0)


def test_channels_meet_once(spark, sf):
    """Pair matches counted in the union give the channels' own scores, and a channel's bit says that it found a pair."""
    from kinweave.operators import retrieval
    from kinweave.plans.linkage import Work

    records = Work.of(spark, sf).records
    got = retrieval.all_channels(records, SMALL)
    want = retrieval.union_channels(retrieval.channels(records, SMALL))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def _rows_of_joins(plan) -> list[int]:
    """Rows that each join of an executed plan gave."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _rows_of_joins(plan.executedPlan())
    if name.endswith("QueryStage"):
        return _rows_of_joins(plan.plan())
    kids = plan.children()
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in name else []
    return own + [n for i in range(kids.size()) for n in _rows_of_joins(kids.apply(i))]


def test_nearest_owner_makes_no_pairs_of_a_name(spark):
    """Against all pairs of a name: ties, equal numbers under different ids, names without an owner; joins give a row a record."""
    from kinweave.operators import retrieval

    rng = random.Random(5)
    rows = [(rng.choice("xy"), f"S{s}-{rng.choice(['', '0'])}{rng.randint(0, 150)}", s, rng.choice(["n", "m", "", None])) for s in rng.choices((1, 2, 3), k=600)]
    rows += [("x", "S2-7", 2, "lone")]
    frame = retrieval.nearest_owner(spark.createDataFrame(rows, "country string, id string, src int, name string"))
    got = {(r.country, r.c): r.owner for r in frame.collect()}
    want = {}
    for country, c, s, name in rows:
        near = [(abs(int(q[3:]) - int(c[3:])), q) for at, q, t, other in rows if s > 1 == t and at == country and other == name is not None]
        if near:
            want[country, c] = min([*near, *([want[country, c]] if (country, c) in want else [])])
    assert got == {k: v[1] for k, v in want.items()}
    assert max(_rows_of_joins(frame._jdf.queryExecution().executedPlan())) <= len(rows)


def test_blocks_of_small_countries_go_to_tasks_by_number(spark, monkeypatch):
    """Countries have several blocks, tasks several countries' blocks; the rows are those of one block a country."""
    from kinweave.operators import retrieval, topk

    rng = random.Random(8)
    rows = [(f"x{i % 3}", f"S{1 + i % 3}-{i}", 1 + i // 3 % 3, " ".join(rng.choices([f"w{j}" for j in range(25)], k=rng.randint(0, 4)))) for i in range(400)]
    records = spark.createDataFrame(rows, "country string, id string, src int, name string")
    want = sorted(map(tuple, retrieval.token_top_k(records, "name", 120, 5).collect()))
    monkeypatch.setattr(topk, "LEAST", 16)
    for tasks in (topk.TASKS, 5):
        monkeypatch.setattr(topk, "TASKS", tasks)
        assert sorted(map(tuple, retrieval.token_top_k(records, "name", 120, 5).collect())) == want


def test_keys_and_ranks_are_made_once(spark):
    """A channel's keys are not made anew for each side, and accepted pairs come from windows of one order."""
    from kinweave.operators import retrieval

    records = spark.createDataFrame([("x", f"S{1 + i % 3}-{i}", 1 + i % 3, f"a b{i % 4} c{i % 5}") for i in range(60)], "country string, id string, src int, name string")
    plan = retrieval.rarest_pair(records, "name", SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    scored = spark.createDataFrame([("x", "a", "r1", 0.9), ("x", "a", "r2", 0.9), ("x", "a", "r3", 0.1)], "country string, q string, c string, p double")
    chosen = decision.choose_k(scored, decision.product_p_zero(scored, scored.select("country", "q").distinct()))
    assert sorted(r.c for r in chosen.collect()) == ["r1", "r2"]
    windows = [x for x in chosen._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x and "ASC" in x]
    assert windows and all("p#" in x and "DESC" in x for x in windows)


def test_sweep_reads_its_pairs_once(spark):
    """All policies are counted in one pass; entities without pairs, true links that no channel found."""
    scored = spark.createDataFrame([("x", "a", "r1", 0.9), ("x", "a", "r2", 0.4), ("x", "b", "r3", 0.2)], "country string, q string, c string, p double")
    truth = spark.createDataFrame([("x", "a", "r1"), ("x", "b", "r9"), ("x", "b", "r9")], "country string, q string, c string")
    entities = spark.createDataFrame([("x", q) for q in "abd"], "country string, q string")
    p_zero = decision.product_p_zero(scored, entities)
    frame = decision.sweep(scored, p_zero, truth, entities, top=(1, 2), thresholds=(0.3,), recalls=(1.0,), lifts=(0.5,))
    got = {r.policy: r.f05 for r in frame.collect()}
    for name, accepted in (("top1", decision.fixed_top(scored, 1)), ("top2", decision.fixed_top(scored, 2)), ("above0.3", decision.above(scored, 0.3)), ("recall1.0", decision.choose_k(scored, p_zero))):
        assert got[name] == decision.entity_scores(accepted, truth, entities).agg(F.round(F.avg("f"), 6)).first()[0]
    assert set(got) == {"top1", "top2", "above0.3", "recall1.0", "lift0.5"}
    once = decision.sweep(scored, spark.range(1).selectExpr("'x' as country", "'a' as q", "0.1D as p_zero"), truth, spark.range(1).selectExpr("'x' as country", "'a' as q"))
    assert once._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2


def test_misses_look_for_lost_links_once(spark):
    """Links that no channel found are kept before each field's tokens are joined to them."""
    from kinweave.operators import evaluate

    records = spark.createDataFrame([("x", "S1-1", 1, "a b", "1"), ("x", "S2-2", 2, "a c", "2"), ("x", "S2-3", 2, "d", "3")], "country string, id string, src int, name string, addr string")
    truth = spark.createDataFrame([("x", "S1-1", "S2-2"), ("x", "S1-1", "S2-3")], "country string, q string, c string")
    got = evaluate.misses(truth.limit(0), truth, records, 5, 5)
    assert {(r.category, r.n) for r in got.collect()} == {("reachable", 1), ("no signal", 1)}
    assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()


def _broadcast(df):
    """What stands below the plan's broadcasts."""
    found, top = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        top = None if top is not None and depth <= top else top
        if top is not None:
            found.append(line)
        elif "BroadcastExchange" in line:
            top = depth
    return found


def test_misses_broadcast_no_links(spark):
    """Files of links are far smaller than their rows: neither links nor candidates nor records go to the driver for a join, however small."""
    from kinweave.checkpoints import kept
    from kinweave.operators import evaluate, retrieval

    rows = [("x", "S1-1", 1, 0, "a b", "1 z"), ("x", "S2-2", 2, 1, "a c", "2 z"), ("x", "S2-3", 2, 2, "d", "3"), ("x", "S2-5", 2, 4, "e a", None), ("y", "S2-4", 2, 3, "a b", "z"), (None, "S2-6", 2, 5, "a", "1"), (None, "S1-6", 1, 6, "a", "1"), ("x", "S2-7", 2, 60, None, "z")]
    records = kept(spark.createDataFrame(rows, "country string, id string, src int, k long, name string, addr string"))
    links = [("x", "S1-1", c) for c in ("S2-2", "S2-2", "S2-3", "S2-5", "S2-7", "S2-9")] + [("y", "S1-9", "S2-4")]
    truth, cand = kept(spark.createDataFrame(links, "country string, q string, c string")), kept(spark.createDataFrame(links[2:3], "country string, q string, c string"))
    least = evaluate.least_shared_df(truth, records)
    assert {(r.c, r.name_df, r.addr_df) for r in least.collect()} == {("S2-2", 2, 2), ("S2-3", None, None), ("S2-5", 2, None), ("S2-7", None, 2), ("S2-9", None, None), ("S2-4", None, None)} and least.count() == 6
    got = evaluate.misses(cand, truth, records, 1, 1)
    assert {(r.category, r.n) for r in got.collect()} == {("address too common", 2), ("name too common", 1), ("no signal", 2)}
    assert not [x for x in _broadcast(got) if re.search(r"\b(q|c|id)#", x)]
    owned = retrieval.block_owner(records, 50)
    assert sorted(tuple(r) for r in owned.collect()) == [("x", "S1-1", c) for c in ("S2-2", "S2-3", "S2-5")]
    assert not _broadcast(owned)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _corrupted(rng, n):
    words = "a b sbi state bank india limited ltd corp corporation sharma store stores 12 13 10034 1 mill road rd mh maharashtra ibm international business machines".split()
    texts = [[rng.choice(words) for _ in range(rng.randint(0, 6))] for _ in range(n)]
    pairs_ = [(x, [t for t in x if rng.random() < 0.8] + [rng.choice(words) for _ in range(rng.randint(0, 2))]) for x in texts]
    long = [f"a{i}" for i in range(130)]
    return [(" ".join(x), " ".join(y)) for x, y in pairs_] + [("sbi limited", "state bank india limited"), ("state bank india limited", "sbi limited"), (" ".join(long), " ".join(long[5:])), (" ".join(long[:30]), "z"), (None, "a"), ("a", None)]


def test_mining_counts_where_the_texts_are(spark):
    """Facts are those of the pairs one by one, and neither pairs nor events are shuffled."""
    rng = random.Random(11)
    rows = [(("x", "y")[i % 2], f"S{2 + i % 3 % 2}-{i}", "name", x, y) for i, (x, y) in enumerate(_corrupted(rng, 400) * 2)]
    mined = mining.mine(spark.createDataFrame(rows, "country string, c string, field string, x string, y string"))
    assert "Exchange" not in _plan(mined)
    want, tokens, states = {}, {}, {}
    for country, c, field, x, y in rows:
        state, events = mining.events_of(x or "", y or "")
        states[c[:2], state] = states.get((c[:2], state), 0) + 1
        for e in events if state == "confident" else []:
            n, places = want.get((country, c[:2], *e[:3]), (0, 0.0))
            want[country, c[:2], *e[:3]] = (n + 1, places + e[3])
        for t in x.split() if state == "confident" else []:
            tokens[t] = tokens.get(t, 0) + 1
    got = {(r.country, r.src, r.kind, r.a, r.b): (r.n, r.places) for r in mining.event_table(mined).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()} and all(abs(got[k][1] - p) < 1e-6 for k, (_, p) in want.items())
    assert {"contract", "expand", "swap", "insert", "drop", "abbrev", "typo"} <= {k[2] for k in got} and {r.a: r.n_a for r in mining.confident_tokens(mined).collect()} == tokens
    found = {(r.src, s): r[s] for r in mining.provenance(mined).collect() for s in mining.STATES if r[s]}
    assert found == states and {s for _, s in states} == set(mining.STATES)


def test_aligned_moves_no_texts(spark):
    """Rows are those of the pairs one by one, and the pairs do not meet their alignments in a join."""
    rows = [("x", f"S1-{i}", f"S2-{i}", x, y) for i, (x, y) in enumerate(_corrupted(random.Random(12), 300))]
    out = mining.aligned(spark.createDataFrame(rows, "country string, q string, c string, x string, y string"))
    assert "Exchange" not in _plan(out) and "Join" not in _plan(out)
    want = []
    for _, q, _, x, y in rows:
        a, b = [*(x or "").split(), ""], [*(y or "").split(), ""]
        got = mining.align_tokens(x or "", y or "")
        want += [(q, "", "", 0.0, 1)] if got is None else [(q, a[i], b[j], s, 0) for i, j, s in got]
    assert sorted((r.q, r.a, r.b, r.score, r.skipped) for r in out.collect()) == sorted(want)


def test_kept_tables_leave_no_shuffle_files(spark):
    import time

    from kinweave.checkpoints import kept

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        names = disk.getAllFiles()
        return {names.apply(i).getName() for i in range(names.size()) if names.apply(i).getName().startswith("shuffle_")}

    before = shuffles()
    out = kept(spark.range(20_000).groupBy((F.col("id") % 500).alias("k")).agg(F.count("*").alias("n")))
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before and out.count() == 500 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_abstention_needs_no_ranks(spark):
    scored = spark.createDataFrame([("x", "S1-1", "S2-1", 0.2), ("x", "S1-1", "S2-2", 0.6), ("x", "S1-2", "S2-1", 0.1)], "country string, q string, c string, p double")
    p_zero = spark.createDataFrame([("x", "S1-1", 0.5), ("x", "S1-2", 0.0), ("x", "S1-3", 1.0)], "country string, q string, p_zero double")
    out = decision.abstention_scales(scored, p_zero)
    assert "Window" not in _plan(out) and {r.q: r.s for r in out.collect()} == {"S1-1": 0.6 * decision.FIRST_FACTOR / 0.5, "S1-2": 0.1 * decision.FIRST_FACTOR / 1e-300}


@pytest.mark.parametrize("fine", [1, 1024])
def test_breakpoints_by_buckets(spark, monkeypatch, fine):
    """Cuts are those of all values in order, though only one bucket of them is put in order."""
    monkeypatch.setattr(decision, "FINE", fine)
    rng, points, want, expect = random.Random(fine), [], [], {}
    for k in range(40):
        v = [rng.choice([0.0, round(rng.uniform(0, 3), 2), rng.uniform(0, 1e-3), rng.expovariate(0.01), float("inf")]) for _ in range(rng.randint(1, 60))]
        w = rng.uniform(-5, 70)
        points += [(f"c{k}", x) for x in v]
        want.append((f"c{k}", w))
        steps = sorted(set(v))
        cuts = [(0.0, 0, steps[0])] + [(x, sum(y <= x for y in v), steps[i + 1] if i + 1 < len(steps) else None) for i, x in enumerate(steps)]
        x, _, after = min(cuts, key=lambda c: (abs(c[1] - max(w, 0)), c[1]))
        mid = (x * 2 if x > 0 else 1.0) if after in (None, float("inf")) else after / 2 if x <= 0 else (x * after) ** 0.5
        expect[f"c{k}"] = min(1e4, max(1e-4, mid))
    got = decision.solve_breakpoint(spark.createDataFrame(points, "country string, v double"), spark.createDataFrame(want, "country string, want double"), 1e-4, 1e4)
    got = {r.country: r.x for r in got.collect()}
    assert got.keys() == expect.keys() and all(abs(got[k] - x) <= 1e-12 * x for k, x in expect.items())


def test_stopping_ratios_move_no_candidates(spark):
    rng = random.Random(4)
    rows = [("x", f"S1-{i % 30}", f"S2-{i}", round(rng.random(), 1)) for i in range(400)]
    scored = spark.createDataFrame(rows, "country string, q string, c string, p double")
    out = decision.stop_ratios(scored, scored.select("country", "q").distinct())
    moved = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line]
    want = []
    for q in {r[1] for r in rows}:
        p, least = sorted((r[3] for r in rows if r[1] == q), reverse=True), float("inf")
        for k in range(1, len(p)):
            bar = 0.8 * 1.25 * sum(p[:k]) / (0.25 * max(sum(p), 1e-9) + k)
            least = min(least, p[k] / bar if bar > 0 else float("inf") if p[k] > 0 else 0.0)
            want.append((q, k, round(least, 9)))
    assert moved and not any(" c#" in line or ",c#" in line or "[c#" in line for line in moved) and sorted((r.q, r.k, round(r.m, 9)) for r in out.collect()) == sorted(want)
