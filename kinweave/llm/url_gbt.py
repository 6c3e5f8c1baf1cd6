"""URL filter: host rules first, else gradient-boosted trees on lexical features.

The trees are trained from URLs that a rule decides: 1 blocked, 0 allowed; a fifth of them, by hash, is held out and says
how well the trees do. Features are the URL's length, depth, digit ratio, entropy, parameters and marks, and how often
training URLs of the same host suffix and of the same first path segment are blocked. For the training URLs
themselves these rates come from the other folds, so no URL sees its own label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common
from .textkernel import utf8

#: (host, path start, verdict) of the contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: URLs that training takes at most; trees, their depth, bins of a feature; folds, of which one is held out.
SAMPLE, TREES, DEPTH, BINS, RATE, FOLDS = 20_000, 40, 4, 32, 0.2, 5
#: Counts that a group's rate of blocked URLs is drawn to the mean with.
PRIOR = 10


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; null or without "://": both empty."""
    whole = r"(?s)://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, whole, i), F.lit("")) for i in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none if rule is None else rule), (none if verdict is None else verdict)


#: What the rates are kept for, as Spark expressions: the host's last label, its last two, the path's first segment.
GROUPS = ("xxhash64('last', substring_index(host, '.', -1))", "xxhash64('two', substring_index(host, '.', -2))", "xxhash64('first', regexp_extract(path, '^/([^/]*)', 1))")
LEXICAL = 17


def _class(chars: str) -> np.ndarray:
    t = np.zeros(256, np.float64)
    t[[ord(c) for c in chars]] = 1
    return t


_SLASH, _DOT, _DASH, _DIGIT, _VOWEL, _AND = map(_class, ("/", ".", "-", "0123456789", "aeiou", "&"))


def _counts(data: np.ndarray, offsets: np.ndarray, of: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0.0], np.cumsum(of[data])])
    return run[offsets[1:]] - run[offsets[:-1]]


def _entropy(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits a byte of each text."""
    out = np.zeros(len(offsets) - 1)
    for at in range(0, len(out), 2_048):
        o = offsets[at : at + 2_049]
        rows = np.repeat(np.arange(len(o) - 1), np.diff(o))
        count = np.bincount(rows * 256 + data[o[0] : o[-1]], minlength=256 * (len(o) - 1)).reshape(-1, 256)
        share = count / np.maximum(count.sum(1, keepdims=True), 1)
        out[at : at + 2_048] = -(share * np.log2(np.where(count > 0, share, 1))).sum(1)
    return out


def _longest_label(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if len(offsets) < 2:
        return np.zeros(0)
    cut = np.union1d(np.flatnonzero(data == 46), offsets)
    size = np.diff(np.append(cut, len(data)))
    size = size - (np.append(data, 0)[cut] == 46)
    return np.where(np.diff(offsets) > 0, np.maximum.reduceat(size, np.searchsorted(cut, offsets[:-1])), 0)


def lexical(url: pa.Array, host: pa.Array, path: pa.Array, tail: pa.Array) -> np.ndarray:
    """LEXICAL features of URLs, given their hosts, paths and parameters."""
    (u, uo), (h, ho), (p, po), (t, to) = map(utf8, (url, host, path, tail))
    size, hosts, tails = np.diff(uo), np.diff(ho), np.diff(to)
    digits = _counts(u, uo, _DIGIT)
    secure = pa.compute.fill_null(pa.compute.starts_with(url, "https"), False).to_numpy(zero_copy_only=False)
    anchor = pa.compute.fill_null(pa.compute.match_substring(url, "#"), False).to_numpy(zero_copy_only=False)
    return np.stack([
        size, hosts, np.diff(po), _counts(p, po, _SLASH), _counts(h, ho, _DOT), _counts(h, ho, _DASH), digits, digits / np.maximum(size, 1), _counts(h, ho, _DIGIT), _entropy(u, uo), _entropy(h, ho),
        _counts(t, to, _AND) + (tails > 0), tails, anchor, secure, _counts(h, ho, _VOWEL) / np.maximum(hosts, 1), _longest_label(h, ho),
    ], axis=1).astype(np.float64)


class Rates:
    """Smoothed rates of blocked URLs by group; groups that training lacks have the mean."""

    def __init__(self, groups: np.ndarray, y: np.ndarray):
        self.mean = (y.sum() + 1) / (len(y) + 2)
        self.keys, back = np.unique(groups, return_inverse=True)
        hit, n = (np.bincount(back.ravel(), weights=np.repeat(w, groups.shape[1]), minlength=len(self.keys)) for w in (y, np.ones(len(y))))
        self.values = (hit + PRIOR * self.mean) / (n + PRIOR)

    def __call__(self, groups: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(groups.shape, self.mean)
        at = np.minimum(np.searchsorted(self.keys, groups), len(self.keys) - 1)
        return np.where(self.keys[at] == groups, self.values[at], self.mean)


class Trees:
    """Boosted regression trees for the logistic loss, on binned features."""

    def __init__(self, base: float, edges: list[np.ndarray], trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.base, self.edges, self.trees = base, edges, trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, l2: float = 1.0) -> Trees:
        if not len(y):
            return cls(0.0, [], [])
        share = (y.sum() + 1) / (len(y) + 2)
        base = math.log(share / (1 - share))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        score, out = np.full(len(y), base), []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            feature, split = np.full((1 << depth) - 1, -1), np.zeros((1 << depth) - 1, np.int64)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, width = (1 << level) - 1, 1 << level
                best = np.full(width, 1e-6)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    k = (node - first) * (bins + 1) + b[:, j]
                    gs, hs = (np.bincount(k, weights=v, minlength=width * (bins + 1)).reshape(width, -1) for v in (g, h))
                    gl, hl = np.cumsum(gs, 1)[:, :-1], np.cumsum(hs, 1)[:, :-1]
                    gt, ht = gs.sum(1)[:, None], hs.sum(1)[:, None]
                    gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best[better] = top[better]
                    feature[first : first + width][better] = j
                    split[first : first + width][better] = at[better]
                f = feature[node]
                node = 2 * node + 1 + np.where(f >= 0, b[np.arange(len(y)), np.maximum(f, 0)] > split[node], False)
            leaf = node - ((1 << depth) - 1)
            value = np.bincount(leaf, weights=g, minlength=1 << depth) / (np.bincount(leaf, weights=h, minlength=1 << depth) + l2) * rate
            score = score + value[leaf]
            out.append((feature, split, value))
        return cls(base, edges, out)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.base)
        if len(x) and self.trees:
            b = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)
            for feature, split, value in self.trees:
                node = np.zeros(len(x), np.int64)
                while node[0] < len(feature):
                    f = feature[node]
                    node = 2 * node + 1 + np.where(f >= 0, b[np.arange(len(x)), np.maximum(f, 0)] > split[node], False)
                s += value[node - len(feature)]
        return 1 / (1 + np.exp(-s))


class Filter:
    """Trees and the rates they read; auc: on the held-out URLs, None if these are all of one kind."""

    def __init__(self, trees: Trees, rates: Rates, auc: float | None):
        self.trees, self.rates, self.auc = trees, rates, auc

    def score(self, x: np.ndarray, groups: np.ndarray) -> np.ndarray:
        return self.trees.score(np.concatenate([x, self.rates(groups)], axis=1))


def area(score: np.ndarray, y: np.ndarray) -> float | None:
    """Area under the curve: the chance that a 1 scores above a 0, ties half."""
    if not 0 < y.sum() < len(y):
        return None
    _, back, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[back]
    ones = y.sum()
    return float((rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones)))


def _described(rows: DataFrame, more: str, names: tuple[str, ...]) -> DataFrame:
    """rows (url, host, path and the columns `names` of schema `more`) as features: names, x (bytes of doubles), groups."""
    tail = F.regexp_extract("url", r"(?s)\?([^#]*)", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in common.byte_slices(b, "url"):
                x = lexical(*(part.column(c) for c in ("url", "host", "path", "tail")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array([r.tobytes() for r in x], pa.binary()), *(part.column(f"g{i}") for i in range(len(GROUPS)))], [*names, "x", *(f"g{i}" for i in range(len(GROUPS)))])

    src = rows.select(*names, *(c for c in ("url", "host", "path") if c not in names), tail.alias("tail"), *[F.expr(g).alias(f"g{i}") for i, g in enumerate(GROUPS)])
    return src.mapInArrow(run, f"{more}, x binary, " + ", ".join(f"g{i} long" for i in range(len(GROUPS))))


def _arrays(part: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features and groups of described rows."""
    x = np.frombuffer(b"".join(part.column("x").to_pylist()), np.float64).reshape(-1, LEXICAL)
    return x, np.stack([part.column(f"g{i}").to_numpy() for i in range(len(GROUPS))], axis=1)


def train(labelled: DataFrame, sample: int = SAMPLE) -> Filter:
    """From (url, host, path, blocked 0/1): at most `sample` distinct URLs, those of least hash; a fifth is held out.

    Only features come to the driver, so that long URLs do not. No URLs: every score is one half.
    """
    rows = labelled.where("url is not null and blocked is not null").groupBy("url", "host", "path").agg(F.max("blocked").alias("blocked"))
    rows = common.least_hashed(rows, "url", sample).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), F.col("url")), F.lit(FOLDS)))
    got = _described(rows, "blocked int, fold long", ("blocked", "fold")).toArrow().sort_by([("fold", "ascending"), ("g0", "ascending"), ("x", "ascending")]).combine_chunks()  # `sample` rows at most
    x, groups = _arrays(got)
    y, fold = got.column("blocked").to_numpy().astype(np.float64), got.column("fold").to_numpy()
    own = fold != 0
    rates = Rates(groups[own], y[own])
    seen = rates(groups)
    for f in range(1, FOLDS):
        mine = fold == f
        seen[mine] = Rates(groups[own & ~mine], y[own & ~mine])(groups[mine])
    trees = Trees.fit(np.concatenate([x, seen], axis=1)[own], y[own])
    model = Filter(trees, rates, None)
    model.auc = area(model.score(x[~own], groups[~own]), y[~own])
    return model


def judge(df: DataFrame, url_col: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """df with host, path, rule, score (the trees' P(blocked)) and verdict; columns of these names give way.

    The longest fitting rule decides, else the score. A null URL and one without "://" have an empty host and path, fit no
    rule and are scored like any other. If no URL fits a rule, every score is one half. Repeated rows stay, very long URLs
    are described like others, other columns pass through; an empty table gives no rows.
    """
    added = ("host", "path", "rule", "score", "verdict")
    keep = [c for c in df.columns if c.lower() not in added]
    host, path = host_path(F.col(f"`{url_col}`"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{url_col}`").alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule).withColumn("by_rule", verdict)
    model = train(rows.select("url", "host", "path", F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0).alias("blocked")))
    names = ("row", "host", "path", "rule", "by_rule")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(model.score(*_arrays(b)))], [*names, "score"])

    kind = rows.schema["row"].dataType.simpleString()
    same = f"row {kind}, host string, path string, rule string, by_rule string"
    out = _described(rows, same, names).mapInArrow(run, f"{same}, score double")
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict")
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "host", "path", "rule", verdict, "score")


def op2_url_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all `pages`."""
    return judge(common.only(common.table(spark, sf_dir, "pages"), "page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
