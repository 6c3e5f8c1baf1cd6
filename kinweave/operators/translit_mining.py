"""Learning a transliteration from records whose text is in Devanagari on one side and in Latin letters on the other.

Words align with tokens by how alike their romanised forms are; counts of (word, latin) are all that later steps read.
Grapheme units align with substrings by hard EM: each round the best cut of every distinct pair (a batch of pairs a
task) is counted by (unit, substring) in Spark, and the counts, an alphabet's worth, go out with the next round.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..checkpoints import cut
from ..functions import text as tx, translit as tl
from .mining import _ratio, assign

#: Likeness below which a word stays unaligned, and the share of a record's words that must align.
FLOOR, SHARE = 0.5, 0.5
#: Longest substring of a unit; rounds of EM; weight of an edit against the rules' spelling.
LONGEST, ROUNDS, PRIOR = 5, 4, 2.0
OPTIONS = [{"schwa": s, "nasal": n, "short": v} for s in (False, True) for n in (False, True) for v in (False, True)]


def fold(s: str) -> str:
    for a, b in tx.FOLDS:
        s = s.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", s)


def bones(s: str) -> str:
    return re.sub("[aeiou]", "", fold(s))


def alike(a: str, b: str) -> float:
    """Likeness of a romanised word and a token, blind to vowels and aspiration; words of one bone have none to compare."""
    x, y = bones(a), bones(b)
    return max(_ratio(fold(a), fold(b)) if a and b else 0.0, _ratio(x, y) if len(x) > 1 and len(y) > 1 else 0.0)


def joined(s: str) -> str:
    return tx.norm_plain(s).replace(" ", "")


def align_words(latin: str, other: str) -> list[tuple[str, str]]:
    """(word, token) of one pair of texts; none if the scripts are not as expected or too few words align."""
    words, tokens = tl.WORD.findall(other or ""), tx.norm_plain(latin).split()
    if not words or not tokens or tl.WORD.search(latin):
        return []
    score = [[alike(joined(tl.by_rules(w)), t) for t in tokens] for w in words]
    got = [(words[i], tokens[j]) for i, j in assign(score, 0.0) if score[i][j] >= FLOOR]
    return got if len(got) >= SHARE * len(words) else []


def word_pairs(texts: DataFrame) -> DataFrame:
    """(word, latin, n) over texts (x in Latin letters, y in Devanagari); each distinct pair of texts is aligned once."""
    distinct = texts.where(F.col("x").isNotNull() & F.col("y").rlike("[\\u0900-\\u097F]")).groupBy("x", "y").agg(F.count("*").alias("m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(w, t, m) for x, y, m in zip(pdf.x, pdf.y, pdf.m) for w, t in align_words(x, y)], columns=["word", "latin", "m"])

    return distinct.mapInPandas(run, "word string, latin string, m long").groupBy("word", "latin").agg(F.sum("m").alias("n"))


@cache
def prior(unit: tl.Unit, sub: str) -> float:
    """Log-likeness of a unit's spelling to what the rules would make of it under any options."""
    spellings = {tl.Model(opts=o).spelled([unit])[0] for o in OPTIONS}
    if unit.kind == "C":
        spellings |= {tl._ALL[unit.cons], tl._ALL[unit.cons] + "a"}
    if unit.kind in "NX":
        spellings |= {"m", ""}
    return -PRIOR * min(round((1 - _ratio(sub, v)) * max(len(sub), len(v))) for v in spellings)


def best_cut(word: list[tl.Unit], latin: str, score: Callable[[tl.Unit, str], float]) -> list[str] | None:
    """The substrings of latin, one a unit in order and LONGEST letters at most, of the greatest total score; None if it cannot be cut."""
    reach: dict[int, tuple[float, tuple[str, ...]]] = {0: (0.0, ())}
    for at, u in enumerate(word):
        after: dict[int, tuple[float, tuple[str, ...]]] = {}
        room = LONGEST * (len(word) - at - 1)
        for j, (total, subs) in reach.items():
            for end in range(max(j, len(latin) - room), min(len(latin), j + LONGEST) + 1):
                sub = latin[j:end]
                option = (total + score(u, sub), (*subs, sub))
                if end not in after or option[0] > after[end][0]:
                    after[end] = option
        reach = after
    return list(reach[len(latin)][1]) if len(latin) in reach else None


def cut_units(pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(word, latin, subs): each distinct pair's best cut after `rounds` of hard EM; pairs count once."""
    distinct = cut(pairs.select("word", "latin").distinct())
    counts: dict[tuple[str, str], dict[str, int]] = {}

    def step(counts: dict) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = {u: sum(c.values()) for u, c in counts.items()}

            def score(u: tl.Unit, sub: str) -> float:
                c = counts.get((u.key, u.kind))
                return prior(u, sub) if c is None else math.log((c.get(sub, 0) + math.exp(prior(u, sub))) / (total[u.key, u.kind] + 1))

            for pdf in batches:
                rows = []
                for w, latin in zip(pdf.word, pdf.latin):
                    word = tl.units(w)
                    if word and all(u.kind != "U" for u in word) and len(latin) <= 4 * len(word):
                        subs = best_cut(word, latin, score)
                        if subs is not None:
                            rows.append((w, latin, subs, [{"key": u.key, "kind": u.kind, "sub": s} for u, s in zip(word, subs)]))
                yield pd.DataFrame(rows, columns=["word", "latin", "subs", "votes"])

        return distinct.mapInPandas(run, "word string, latin string, subs array<string>, votes array<struct<key: string, kind: string, sub: string>>")

    for _ in range(rounds):
        new: dict[tuple[str, str], dict[str, int]] = {}
        for r in step(counts).select(F.explode("votes").alias("v")).groupBy("v").agg(F.count("*").alias("n")).collect():  # units times their spellings
            new.setdefault((r["v"]["key"], r["v"]["kind"]), {})[r["v"]["sub"]] = r["n"]
        counts = new
    return step(counts).select("word", "latin", "subs")


def votes(cuts: DataFrame, opts: dict[str, bool]) -> DataFrame:
    """(name, key, value): what each unit's cut says for the tables of a model with these options."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for w, subs in zip(pdf.word, pdf.subs):
                word = tl.units(w)
                keep = tl.kept(word, opts["schwa"])
                for i, (u, sub) in enumerate(zip(word, subs)):
                    key = tl.context(word, i, keep)
                    if u.cons:
                        head = re.match("[^aeiou]*", sub)[0]
                        tail = sub[len(head) :]
                        if head:
                            rows.append(("cons", u.cons, head))
                            if u.kind == "C" and tail in ("", "a"):
                                rows.append(("schwa", key, str(int(tail == "a"))))
                            elif u.kind == "M" and tail:
                                rows.append(("vowel", key, tail))
                    else:
                        rows.append(({"V": "vowel", "N": "nasal"}.get(u.kind, "other"), key, sub))
            yield pd.DataFrame(rows, columns=["name", "key", "value"])

    return cuts.mapInPandas(run, "name string, key string, value string")


def tables(cuts: DataFrame, opts: dict[str, bool], support: int = 5, context_support: int = 10) -> dict[str, dict]:
    """Each decision's majority where it has enough votes; consonants spelt as the rules do are left out. An alphabet's worth."""
    n = votes(cuts, opts).groupBy("name", "key", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("name", "key")
    n = n.withColumn("all", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "value"))).where("r = 1")
    out: dict[str, dict] = {t: {} for t in ("cons", "vowel", "nasal", "schwa", "other")}
    for r in n.where(F.col("all") >= F.when(F.col("name") == "schwa", context_support).otherwise(support)).orderBy("name", "key").collect():
        if r["name"] != "cons" or tl._ALL[r["key"]] != r["value"]:
            out[r["name"]][r["key"]] = int(r["value"]) if r["name"] == "schwa" else r["value"]
    return out


def match_rates(pairs: DataFrame, spellings: dict[str, Callable[[str], str]]) -> DataFrame:
    """(variant, n, exact, folded): the share of words, weighed by n, whose spelling is the token; pairs: word, latin, n."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, spell in spellings.items():
                got = [joined(spell(w)) for w in pdf.word]
                hit = [g == t for g, t in zip(got, pdf.latin)]
                near = [fold(g) == fold(t) for g, t in zip(got, pdf.latin)]
                yield pd.DataFrame({"variant": name, "m": pdf.n, "hit": pdf.n * hit, "near": pdf.n * near})

    rows = pairs.mapInPandas(run, "variant string, m long, hit long, near long").groupBy("variant").agg(*[F.sum(c).alias(c) for c in ("m", "hit", "near")])
    return rows.select("variant", F.col("m").alias("n"), F.round(F.col("hit") / F.col("m"), 6).alias("exact"), F.round(F.col("near") / F.col("m"), 6).alias("folded"))


def best_options(pairs: DataFrame) -> dict[str, bool]:
    """The rule options that spell most words right."""
    rates = match_rates(pairs, {json.dumps(o): tl.Model(opts=o).by_units for o in OPTIONS}).collect()
    return json.loads(max(rates, key=lambda r: (r["exact"], r["variant"]))["variant"]) if rates else OPTIONS[0]


def lexicon(pairs: DataFrame, model: tl.Model, support: int = 5, share: float = 0.6) -> DataFrame:
    """(word, latin, n): words whose commonest spelling has enough support and share, and which the units spell otherwise."""
    w = Window.partitionBy("word")
    top = pairs.withColumn("all", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "latin")))
    top = top.where((F.col("r") == 1) & (F.col("all") >= support) & (F.col("n") >= share * F.col("all")))

    @F.pandas_udf("string")
    def spell(s: pd.Series) -> pd.Series:
        return s.map(model.by_units)

    return top.where(spell("word") != F.col("latin")).select("word", "latin", "n")


def fit(pairs: DataFrame, support: int = 5, share: float = 0.6, table_support: int = 5, context_support: int = 10) -> tl.Model:
    """A model from (word, latin, n): options, then tables of units, then the lexicon (a language's words)."""
    pairs = cut(pairs)
    model = tl.Model(opts=best_options(pairs))
    model.tables = tables(cut_units(pairs), model.opts, table_support, context_support)
    model.lexicon = {r["word"]: r["latin"] for r in lexicon(pairs, model, support, share).collect()}
    return model


def held_out(name: str = "x"):
    """Whether a text is of the fifth that reports are made on."""
    return F.crc32(F.coalesce(F.col(name), F.lit("")).cast("binary")) % 5 == 0


def report(test: DataFrame, train: DataFrame, model: tl.Model) -> DataFrame:
    """(variant, words, n, exact, folded) on held-out pairs: all words, and those that training lacks."""
    variants = {"rules": tl.by_rules, "rules with options": tl.Model(opts=model.opts).by_units, "tables": model.by_units, "tables and lexicon": model.word}
    new = test.join(train.select("word").distinct(), "word", "left_anti")
    return match_rates(test, variants).withColumn("words", F.lit("all")).unionByName(match_rates(new, variants).withColumn("words", F.lit("new")))
