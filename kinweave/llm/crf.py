"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A label's score is linear in the features of the line and of the lines before and after
it; a 2 x 2 matrix scores neighbouring labels. Training maximises the likelihood of chains whose lines all have
their document's label. A document's quality is the mean probability of "good" of its lines, from forward-backward
marginals, weighted by the lines' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common
from .textkernel import Words, lower, utf8

#: Bounds of the training sample: labelled documents, and lines in a row of each; folds, threshold.
SAMPLE, LINES, FOLDS, THRESHOLD = 4_000, 400, 5, 0.3
FEATURES = (
    "log words", "no words", "upper case", "digits", "exclamations", "bars", "symbols", "full stops and commas", "other marks", "beyond ASCII",
    "repeats the word before", "words seen before", "word length", "long words", "words of symbols' ends", "one-letter words", "begins lower", "ends open",
)


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, np.float32)
    t[[ord(c) for c in chars]] = 1
    return t


_UPPER, _DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_BANG, _BAR, _SYMBOL, _STOP = _table("!"), _table("|"), _table("#$%&*@^~=+<>\\"), _table(".,")
_OTHER = _table("\"'()-/:;?[]_`{}")
_HIGH = np.zeros(256, np.float32)
_HIGH[0xC0:] = 1
_CONT = np.zeros(256, np.float32)
_CONT[0x80:0xC0] = 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all lines, with the end as last, and each text's first line; each text has one at least."""
    edge = np.zeros(len(data) + 1, bool)
    edge[1:][data == 10] = True
    starts = np.union1d(np.flatnonzero(edge), offsets[:-1])
    starts = starts[starts < len(data)] if len(data) else starts
    # A line that begins where an empty text stands belongs to the next text; empty texts get a line of their own.
    empty = np.diff(offsets) == 0
    count = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    count = np.where(empty, 1, count)
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(first[-1] + 1, np.int64)
    at = np.ones(first[-1], bool)
    at[first[:-1][empty]] = False
    out[:-1][at] = starts
    out[:-1][~at] = offsets[:-1][empty]
    out[-1] = len(data)
    return out, first


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, code points of each line, each text's first line with the end as last)."""
    data, offsets = utf8(texts)
    at, first = lines(data, offsets)
    n = np.diff(at)
    sums = {}
    for name, t in (("upper", _UPPER), ("digit", _DIGIT), ("bang", _BANG), ("bar", _BAR), ("symbol", _SYMBOL), ("stop", _STOP), ("other", _OTHER), ("high", _HIGH), ("cont", _CONT)):
        run = np.concatenate([[0], np.cumsum(t[data], dtype=np.float64)])
        sums[name] = run[at[1:]] - run[at[:-1]]
    chars = n - sums["cont"]
    words = Words(data, at)
    count = words.counts.astype(np.float64)
    line = words.text_of()
    h = Words(lower(data), at).hashes()
    total = len(n)

    def per_line(x: np.ndarray) -> np.ndarray:
        return np.bincount(line, weights=x, minlength=total)

    size = words.ends - words.starts
    same = np.zeros(len(h))
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((h, line))
    seen = np.zeros(len(h))
    if len(h):
        seen[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (line[order[1:]] == line[order[:-1]])
    last = data[words.ends - 1] if len(h) else np.zeros(0, np.uint8)
    lead = data[words.starts] if len(h) else np.zeros(0, np.uint8)
    has = count > 0
    safe, per_char = np.maximum(count, 1), np.maximum(chars, 1)
    first_lead, final = np.zeros(total), np.zeros(total)
    first_lead[has] = ((lead >= 97) & (lead <= 122))[words.first[:-1][has]]
    final[has] = (_STOP[last] == 0)[words.first[1:][has] - 1]
    out = np.stack(
        [
            np.log1p(count) / 5, ~has, sums["upper"] / per_char, sums["digit"] / per_char, sums["bang"] / per_char * 5, sums["bar"] / per_char * 5, sums["symbol"] / per_char * 5,
            sums["stop"] / per_char * 5, sums["other"] / per_char * 5, sums["high"] / per_char * 3, per_line(same) / safe, per_line(seen) / safe, np.minimum(per_line(size) / safe, 40) / 10,
            per_line(size > 14) / safe * 3, per_line(_SYMBOL[last]) / safe, per_line(size == 1) / safe * 3, first_lead, final,
        ],
        axis=1,
    )
    return out.astype(np.float32), np.maximum(chars, 1), first


def context(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features with those of the lines before and after, and 1, first-line and last-line marks."""
    n, d = x.shape
    out = np.zeros((n, 3 * d + 3), np.float32)
    out[:, d : 2 * d] = x
    out[1:, :d] = x[:-1]
    out[:-1, 2 * d : 3 * d] = x[1:]
    out[:, 3 * d] = 1
    begin, end = first[:-1], first[1:] - 1
    out[begin, :d], out[begin, 3 * d + 1] = 0, 1
    out[end, 2 * d : 3 * d], out[end, 3 * d + 2] = 0, 1
    return out


class Chains:
    """Texts sorted by their number of lines, so that step t of all chains is a leading slice."""

    def __init__(self, first: np.ndarray):
        n = np.diff(first)
        self.order = np.argsort(-n, kind="stable")
        self.first, self.n = first[:-1][self.order], n[self.order]
        self.live = [int(k) for k in np.searchsorted(-self.n, -np.arange(self.n[0] if len(n) else 0), "left")]

    def marginals(self, unary: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of each line, expected label pairs (2 x 2) and log Z; unary: the score of "good" over "bad"."""
        u = np.exp(np.stack([-np.maximum(unary, 0), np.minimum(unary, 0)], 1)) # both at most 1
        t = np.exp(trans - trans.max())
        log_z = float(np.maximum(unary, 0).sum() + trans.max() * np.maximum(self.n - 1, 0).sum())
        a, b = np.zeros_like(u), np.ones_like(u)
        scale = np.ones(len(u))
        for step, k in enumerate(self.live):
            i = self.first[:k] + step
            x = u[i] if step == 0 else (a[i - 1] @ t) * u[i]
            scale[i] = x.sum(1)
            a[i] = x / scale[i][:, None]
        pairs = np.zeros((2, 2))
        for step in range(len(self.live) - 1, 0, -1):
            i = self.first[: self.live[step]] + step
            back = u[i] * b[i] / scale[i][:, None]
            pairs += (a[i - 1][:, :, None] * back[:, None, :]).sum(0) * t
            b[i - 1] = back @ t.T
        return (a * b)[:, 1], pairs, log_z + float(np.log(scale).sum())


class Model:
    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.weights, self.trans = weights, trans

    @classmethod
    def fit(cls, x: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 80, l2: float = 1e-4, memory: int = 8) -> Model:
        """Limited-memory BFGS on the mean log-likelihood per text; label: 1 good, 0 bad, per text. No texts: all scores are one half."""
        ctx = context(x, first)
        d = ctx.shape[1]
        theta = np.zeros(d + 4)
        if not len(label):
            return cls(theta[:d], theta[d:].reshape(2, 2))
        chains, lines_of = Chains(first), np.diff(first)
        y = np.repeat(label, lines_of).astype(np.float64)
        held = np.diag([np.maximum(lines_of[label == c] - 1, 0).sum() for c in (0, 1)]).astype(np.float64)

        def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
            u, t = (ctx @ v[:d].astype(np.float32)).astype(np.float64), v[d:].reshape(2, 2)
            p, pairs, log_z = chains.marginals(u, t)
            slope = np.concatenate([ctx.T @ (p - y).astype(np.float32), (pairs - held).ravel()]).astype(np.float64)
            return (log_z - y @ u - (held * t).sum()) / len(label) + l2 / 2 * v @ v, slope / len(label) + l2 * v

        value, slope = loss(theta)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(rounds):
            go, saved = -slope, []
            for s, g in reversed(steps):
                saved.append(s @ go / (s @ g))
                go = go - saved[-1] * g
            if steps:
                s, g = steps[-1]
                go = go * (s @ g) / (g @ g)
            for (s, g), c in zip(steps, reversed(saved)):
                go = go + (c - g @ go / (s @ g)) * s
            size = 1.0 if steps else min(1.0, 1 / np.abs(slope).sum())
            for _ in range(20):
                new, new_slope = loss(theta + size * go)
                if new <= value + 1e-4 * size * (slope @ go):
                    break
                size /= 2
            else:
                break
            s, g = size * go, new_slope - slope
            if s @ g > 1e-10 * (g @ g):
                steps = [*steps[1 - memory :], (s, g)]
            done = value - new < 1e-6 * max(1e-3, abs(value))
            theta, value, slope = theta + s, new, new_slope
            if done:
                break
        return cls(theta[:d], theta[d:].reshape(2, 2))

    def score(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.zeros(0)
        p, _, _ = Chains(first).marginals(context(x, first) @ self.weights, self.trans)
        return np.clip(np.add.reduceat(p * size, first[:-1]) / np.add.reduceat(size, first[:-1]), 0.0, 1.0)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled documents (those of least id hash), never from held-out ids.

    Labels other than 0 and 1 and null ids are left out; of several labels for one id the least counts, and of several
    texts the least. A document of more than LINES lines gives as many in a row, from a place fixed by its id.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y"))
    chosen = common.least_hashed(known, "id", sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in common.byte_slices(b, "t"):
                x, _, first = features(part.column("t"))
                raw = []
                for i, s, e in zip(part.column("id").to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                    s += (i * 0x9E3779B1 >> 7) % (e - s - LINES + 1) if e - s > LINES else 0
                    raw.append(x[s : min(e, s + LINES)].tobytes())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array(raw, pa.binary())], ["id", "y", "x"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"))
    one = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("y").alias("y"), F.min("t").alias("t"))
    rows = one.select("id", "y", "t").mapInArrow(run, "id long, y int, x binary").toArrow()  # `sample` documents of LINES lines at most
    rows = rows.sort_by("id").combine_chunks()
    parts = [np.frombuffer(r, np.float32).reshape(-1, len(FEATURES)) for r in rows.column("x").to_pylist()]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    x = np.concatenate([np.zeros((0, len(FEATURES)), np.float32), *parts])
    return Model.fit(x, first, rows.column("y").to_numpy())


def classify(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score (0 to 1) and predicted (1 if score >= threshold); columns of these names give way.

    Null and empty texts are one empty line. An empty table gives no rows; other columns pass through.
    """
    names = [c for c in df.columns if c.lower() not in ("score", "predicted")]
    src = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("__text"))
    weights, trans = model.weights, model.trans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, trans)
        for b in batches:
            for part in common.byte_slices(b, "__text"):
                score = own.score(*features(part.column("__text")))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[:-1])
    return src.mapInArrow(run, f"{kind}, score double, predicted int")


def op9_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all `documents`, learnt from `labels` that are not held out."""
    docs = common.only(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    out = classify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", "predicted")
