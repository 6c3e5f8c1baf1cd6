"""Best-fit packing by patterns: few-document length patterns fitted to the histogram of lengths.

A pattern is two to four lengths that fill a sequence exactly. For each length that occurs, those patterns are
enumerated in which it is the longest and whose other parts are the most plentiful; they share their shorter lengths, so
non-negative least squares has to share these out when it fits how often each pattern repeats. Repeats are rounded,
down first, then up by decreasing fraction while the pieces last, and what they leave is fitted again. The residual goes by decreasing length into the
fullest sequence that takes it, new ones if none does. Should the plan need more sequences than best fit alone, the
repeats are cut back step by step until it does not. All this happens on the histogram, so the plan has a size of its own
however many pieces there are; each piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common
from .tokens import Encoder

LENGTH, END = 4_096, 1
#: Patterns of three and of four parts that a longest length takes each.
PER_LENGTH = 3
#: Fits to what the ones before left, at most.
ROUNDS = 6
#: Rows of one length that are ranked together, at least; beyond its square a length has the root of its rows.
SALT_ROWS = 100


def patterns(counts: dict[int, int], most: int, per: int = PER_LENGTH) -> list[tuple[int, ...]]:
    """Descending lengths that occur and sum to `most`, two to four of them, by decreasing longest length."""
    have = np.zeros(most + 1, np.int64)
    for n, c in counts.items():
        if n < most:
            have[n] = c
    # The most plentiful pair of each sum: its longer part and how often it is there.
    longer, pairs = np.zeros(most + 1, np.int64), np.zeros(most + 1, np.int64)
    for total in range(2, most):
        x = np.arange((total + 1) // 2, total)
        there = np.minimum(have[x], have[total - x])
        if total % 2 == 0:
            there[0] = have[total // 2] // 2
        best = int(there.argmax())
        longer[total], pairs[total] = x[best], there[best]
    out: dict[tuple[int, ...], None] = {}
    for a in np.flatnonzero(have)[::-1].tolist():
        rest = most - a
        if rest <= a and have[rest]:
            out[a, rest] = None
        x = np.arange(1, min(a, rest - 1) + 1)
        for there, tail in ((np.minimum(have[x], have[rest - x]), lambda y: (rest - y,)), (np.minimum(have[x], pairs[rest - x]), lambda y: (int(longer[rest - y]), rest - y - int(longer[rest - y])))):
            for i in np.argsort(-there, kind="stable")[:per].tolist():
                p = tuple(sorted((a, int(x[i]), *tail(int(x[i]))), reverse=True))
                if there[i] > 0 and p[0] == a:
                    out[p] = None
    return list(out)


def nnls(columns: list[list[tuple[int, float]]], target: np.ndarray, weight: np.ndarray, sweeps: int = 8) -> np.ndarray:
    """x >= 0 that makes the weighted squares of target - sum of x_j * column_j least, by coordinate descent.

    Columns are sparse: (row, value) pairs. Exact after one sweep where columns share no row.
    """
    x, left = np.zeros(len(columns)), target.astype(float).tolist()
    w2 = (weight * weight).tolist()
    norm = [sum(w2[r] * v * v for r, v in c) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, c in enumerate(columns):
            step = max(-x[j], sum(w2[r] * v * left[r] for r, v in c) / norm[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for r, v in c:
                    left[r] -= step * v
        if moved < 1e-3:
            break
    return x


class Plan:
    """Kinds of sequences: each a list of (length, times) slots and how many sequences are alike; fitted: those of patterns."""

    def __init__(self, counts: dict[int, int], most: int = LENGTH, per: int = PER_LENGTH):
        counts = {n: c for n, c in counts.items() if c}
        self._build(counts, most, per, 0.0)
        alone = self.sequences()
        for share in (1.0, 0.9, 0.8, 0.65, 0.5, 0.25) if per else ():
            self._build(counts, most, per, share)
            if self.sequences() <= alone:
                return
        self._build(counts, most, per, 0.0)

    @staticmethod
    def _fit(counts: dict[int, int], kinds: list[tuple[int, ...]], most: int) -> np.ndarray:
        """How often each pattern repeats; fractions."""
        have = np.zeros(most + 1)
        for n, c in counts.items():
            have[n] = c
        # Short pieces fill what is left over anyway: their misfit weighs little.
        weight = np.clip(np.arange(most + 1) / most * 4, 0.05, 1.0)
        return nnls([[(n, float(p.count(n))) for n in sorted(set(p))] for p in kinds], have, weight)

    def _build(self, counts: dict[int, int], most: int, per: int, share: float) -> None:
        self.most, self.kinds, self.left, self.fitted = most, [], dict(counts), 0
        if most in self.left:
            self.kinds.append([[(most, 1)], self.left.pop(most)])
        for _ in range(ROUNDS if share else 0):  # what rounding left is fitted again
            kinds = patterns(self.left, most, per)
            times = self._round(kinds, self._fit(self.left, kinds, most) * share)
            self.kinds += [[[(n, 1) for n in p], t] for p, t in zip(kinds, times) if t]
            self.fitted += sum(times)
            if sum(times) < 0.01 * self.fitted:
                break
        self._rest()

    def _round(self, kinds: list[tuple[int, ...]], repeat: np.ndarray) -> list[int]:
        """Whole repeats, for which there are pieces: down first, then up by decreasing fraction."""
        left, times = self.left, [0] * len(kinds)
        whole = np.floor(repeat + 1e-6)
        part = repeat - whole
        for up in (False, True):
            for j in np.argsort(-part, kind="stable").tolist() if up else np.flatnonzero(whole).tolist():
                p = kinds[j]
                t = min(1 if up else int(whole[j]), *(left[n] // p.count(n) for n in p)) if part[j] >= 0.05 or not up else 0
                for n in p if t else ():
                    left[n] -= t
                times[j] += t
        return times

    def _rest(self) -> None:
        free: dict[int, list[int]] = {}
        mask = 0

        def put(kind: int) -> None:
            nonlocal mask
            slots, _ = self.kinds[kind]
            room = self.most - sum(n * t for n, t in slots)
            if room:
                free.setdefault(room, []).append(kind)
                mask |= 1 << room

        def add(kind: int, n: int, t: int, sequences: int) -> None:
            """t pieces of length n into `sequences` sequences of this kind, the others stay."""
            slots, count = self.kinds[kind]
            if sequences < count:
                self.kinds[kind][1] = count - sequences
                put(kind)
                self.kinds.append([[*slots, (n, t)], sequences])
                put(len(self.kinds) - 1)
            else:
                slots.append((n, t))
                put(kind)

        for k in range(len(self.kinds)):
            put(k)
        for n in sorted(self.left, reverse=True):
            c = self.left[n]
            while c:
                fit = mask >> n
                if not fit:
                    per = self.most // n
                    if c >= per:
                        self.kinds.append([[(n, per)], c // per])
                        put(len(self.kinds) - 1)
                        c %= per
                    if c:
                        self.kinds.append([[(n, c)], 1])
                        put(len(self.kinds) - 1)
                    break
                room = n + (fit & -fit).bit_length() - 1
                kind = free[room].pop()
                if not free[room]:
                    mask &= ~(1 << room)
                t = min(room // n, c)
                sequences = min(self.kinds[kind][1], c // t)
                add(kind, n, t, sequences)
                c -= t * sequences
            self.left[n] = 0

    def table(self) -> dict[str, np.ndarray]:
        """Per slot, by length and rank: length, rank (first), base (first sequence), times (pieces a sequence), at (offset)."""
        used: dict[int, int] = {}
        rows, base = [], 0
        for slots, count in self.kinds:
            at = 0
            for n, t in slots:
                rows.append((n, used.get(n, 0), base, t, at))
                used[n] = used.get(n, 0) + t * count
                at += n * t
            base += count
        rows.sort()
        return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "rank", "base", "times", "at"))}

    def sequences(self) -> int:
        return sum(c for _, c in self.kinds)


def place(pieces: DataFrame, order: list[str], length_col: str = "length", most: int = LENGTH) -> DataFrame:
    """pieces with sequence_id and offset. order: columns that tell rows of one length apart (alike rows are alike).

    Lengths are 1 to `most`. The plan comes from one count per length. Ranks within a length run over its salts, each
    ranked by itself behind the salts before it, so that a length with a third of all rows is no single task's.
    """
    pieces = common.cut(pieces)
    names = pieces.columns
    counts = {r[length_col]: r["count"] for r in pieces.groupBy(length_col).count().collect()}  # at most `most` rows
    if any(not 0 < n <= most for n in counts):
        raise ValueError(f"lengths must be 1 to {most}")
    plan = Plan(counts, most).table()
    key = (plan["length"] << 44) + plan["rank"]
    # Salts per length, one row each; rows go to them by their place in what was cut, so that alike rows part too.
    salts = pieces.sparkSession.createDataFrame([(n, -(-c // max(SALT_ROWS, math.isqrt(c)))) for n, c in counts.items()], "_length long, _salts long")
    salted = pieces.withColumn("_at", F.monotonically_increasing_id()).join(F.broadcast(salts), F.col(length_col) == F.col("_length"))
    salted = salted.select(*names, F.pmod(F.xxhash64("_at"), F.col("_salts")).alias("_salt"))
    sizes = salted.groupBy(length_col, "_salt").count()
    before = Window.partitionBy(length_col).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(length_col, "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(length_col, "_salt").orderBy(*order)
    ranked = salted.withColumn("_rank", F.row_number().over(within).cast("long") - 1).join(sizes, [length_col, "_salt"])
    ranked = ranked.select(*names, (F.col("_rank") + F.col("_before")).alias("_rank"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column(length_col).to_numpy(), b.column("_rank").to_numpy()
            i = np.searchsorted(key, (n << 44) + rank, "right") - 1
            k = rank - plan["rank"][i]
            cols = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(plan["base"][i] + k // plan["times"][i]), pa.array(plan["at"][i] + k % plan["times"][i] * n)], [*names, "sequence_id", "offset"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(find, f"{kind}, sequence_id long, offset long")


def tokenised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, most: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of each text's ids and the end id: doc_id, piece, start, length, ids_crc32; only longer texts have several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path)
        for b in batches:
            for part in common.byte_slices(b, "t"):
                ids, at = coder.encode(part.column("t"))
                rows = ([], [], [], [], [])
                for row in range(len(part)):
                    one = np.append(ids[at[row] : at[row + 1]], end).astype("<u4")
                    for piece, start in enumerate(range(0, len(one), most)):
                        cut = one[start : start + most]
                        for to, v in zip(rows, (row, piece, start, len(cut), zlib.crc32(cut))):
                            to.append(v)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"))
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, most: int = LENGTH) -> DataFrame:
    """Every piece of every text with its sequence and its place there; sequences have no gaps and at most `most` ids.

    Null and empty texts are the end id alone. Rows with null or repeated ids are documents like any other; an empty
    table gives no rows. Other columns are not read.
    """
    return place(tokenised(df, id_col, text_col, path, most), ["doc_id", "piece", "ids_crc32"], most=most)


def op4_pattern_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in sequences of at most 4096 ids."""
    return pack(common.table(spark, sf_dir, "documents"))
