"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives every vector a long string: each letter names the axis, of 32 axes of a random rotation, along which
the centred unit vector reaches farthest, and its sign. The tree keeps the strings sorted. A query descends in each
tree to its longest matching prefix and then ascends in all trees at once, letter by letter, until the prefixes hold
`ascend` times the indexed rows in sum over the trees (or LEAST, in small tables); the rows under them are compared with it.

Sorted strings lie in segments of bounded size (a prefix, salted where one prefix is heavy); a query visits each segment
its prefixes reach, so no task holds a whole tree. Segments hold vectors rounded to one byte a component: the NEAR best of
a segment by the rounded cosine, then of all segments, are scored by their exact cosine. Equal vectors are indexed once, with
the smallest of their ids, as many as can be asked for.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common

TREES, LETTERS, AXES, SEED = 32, 5, 32, 20
#: Bits of a letter; letters whose prefixes are counted, at most (64**3 counts a tree).
LETTER_BITS, COUNTED = 6, 3
SEGMENT_ROWS, LEAST = 16_384, 500
#: Share of the rows that the prefixes reach, in sum over the trees, before a query stops to ascend.
ASCEND = 0.1


def near(k: int) -> int:
    """Rows by rounded cosine that are scored exactly."""
    return 4 * (k + 1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, exactly, so that neither their squares overflow nor all of them vanish."""
    _, exponent = np.frexp(np.abs(x).max(1, initial=0))
    return np.ldexp(x, -exponent[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = scaled(a), scaled(b)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


@functools.lru_cache(maxsize=64)
def rotation(tree: int, dim: int) -> tuple[np.ndarray, ...]:
    """One matrix of axes (dim x at most AXES) a letter, orthogonal within a letter."""
    rng = np.random.default_rng(SEED + tree)
    return tuple(np.linalg.qr(rng.normal(size=(dim, min(dim, AXES))))[0] for _ in range(LETTERS))


def labels(x: np.ndarray, tree: int) -> np.ndarray:
    """The string of each row, its first letter in the highest bits."""
    out = np.zeros(len(x), np.int64)
    for a in rotation(tree, x.shape[1]):
        y = x @ a
        best = np.abs(y).argmax(1)
        out = out << LETTER_BITS | best << 1 | (y[np.arange(len(x)), best] > 0)
    return out


def coded(u: np.ndarray) -> np.ndarray:
    """Unit vectors rounded to one byte a component."""
    return np.rint(u * (127 / np.abs(u).max(1, keepdims=True))).astype(np.int8)


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v), once each: rows that take part have a known id, finite components that are not all zero, the usual length."""
    v = F.col("v")
    df = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    df = df.where(F.col("id").isNotNull() & (F.size(v) > 0)).where(
        ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    usual = df.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return df.where(F.size("v") == (usual[0]["n"] if usual else 0)).groupBy("id", "v").agg(F.lit(0)).select("id", "v")


def _centre(vectors: DataFrame) -> np.ndarray:
    """Mean of the unit vectors, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for b in batches:
            if b.num_rows:
                total, n = total + unit(_matrix(b.column("v"))).sum(0), n + b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["total", "n"])

    sums = vectors.select("v").mapInArrow(run, "total array<double>, n long")
    rows = sums.select(F.posexplode("total"), "n").groupBy("pos").agg(F.sum("col").alias("t"), F.sum("n").alias("n")).orderBy("pos").collect()
    return np.array([r["t"] / r["n"] for r in rows])


def search(df: DataFrame, id_col: str, vector_col: str, is_query, k: int = 5, trees: int = TREES, ascend: float = ASCEND) -> DataFrame:
    """The k nearest rows by cosine of each row for which is_query(id column) holds: query_id, rank, vec_id, score, compared.

    compared is the number of rows, repeated ones counted anew, that the query was compared with. Rows with a null id or
    an unusable vector (null, empty, zero, null or non-finite components, not the usual length) neither ask nor answer. Rows
    that repeat an id count once with their best score, and none answers its own id. Ties go to the smaller id. Fewer rows
    than k: all of them; an empty table: no rows. Other columns are not read.
    """
    rows = common.cut(_usable(df, id_col, vector_col))
    first = Window.partitionBy("v").orderBy("id")
    some = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    vectors = common.cut(some.withColumn("key", F.monotonically_increasing_id()))
    centre = _centre(vectors)
    n = vectors.count()
    counted = min(LETTERS, COUNTED, 2 if n < 10_000_000 else 3)
    bits = LETTERS * LETTER_BITS

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u = unit(_matrix(b.column("v")))
            code = pa.array([c.tobytes() for c in coded(u)], pa.binary())
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(np.full(len(u), t, np.int32)), pa.array(labels(u - centre, t)), code], ["key", "tree", "label", "code"])

    labelled = vectors.mapInArrow(label, "key long, tree int, label long, code binary")
    # Counts of the prefixes of each length: at most trees * 64**COUNTED of them, however many rows there are.
    levels = {x: np.zeros((trees, 1 << (LETTER_BITS * x)), np.int64) for x in range(counted + 1)}
    found = labelled.groupBy("tree", F.shiftright("label", bits - LETTER_BITS * counted).alias("p")).count().toArrow()
    np.add.at(levels[counted], (found.column("tree").to_numpy(), found.column("p").to_numpy()), found.column("count").to_numpy())
    for x in range(counted):
        levels[x] = levels[counted].reshape(trees, 1 << (LETTER_BITS * x), -1).sum(2)
    cut_at = min(LETTER_BITS * counted, max(0, math.ceil(math.log2(max(n, 1) / SEGMENT_ROWS)))) if n else 0
    salts = np.maximum(1, -(-levels[counted].reshape(trees, 1 << cut_at, -1).sum(2) // (2 * SEGMENT_ROWS)))

    def segment(t: np.ndarray, p: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return ((t.astype(np.int64) << cut_at) + p << 20) + salt

    def to_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in label(batches):
            key, t, lab = (b.column(c).to_numpy() for c in ("key", "tree", "label"))
            p = lab >> (bits - cut_at)
            yield pa.RecordBatch.from_arrays([pa.array(segment(t, p, (key * 0x9E3779B1 >> 7) % salts[t, p])), b.column("key"), b.column("label"), b.column("code")], ["seg", "key", "label", "code"])

    def depths(own: np.ndarray) -> np.ndarray:
        """Letters at which each query stops, from its strings in all trees; beyond a tree's longest match it holds nothing."""
        depth = np.full(own.shape[1], -1)
        for level in range(counted, -1, -1):
            held = sum(levels[level][t, own[t] >> (bits - LETTER_BITS * level)] for t in range(trees))
            depth = np.where((depth < 0) & ((held >= max(ascend * n, LEAST)) | (level == 0)), level, depth)
        return depth

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u, ids = unit(_matrix(b.column("v"))), b.column("id").to_numpy()
            code = coded(u)
            own = np.stack([labels(u - centre, t) for t in range(trees)])
            for i, (d, qid) in enumerate(zip(depths(own).tolist(), ids)):
                seg, low, high = [], [], []
                free = bits - LETTER_BITS * d
                for t in range(trees if d else 1):  # every tree's root holds all rows
                    lo = int(own[t, i]) >> free << free
                    hi = lo + (1 << free)
                    for p in range(lo >> (bits - cut_at), ((hi - 1) >> (bits - cut_at)) + 1):
                        s = segment(np.full(salts[t, p], t), np.full(salts[t, p], p), np.arange(salts[t, p]))
                        seg.append(s)
                        low.append(np.full(len(s), lo))
                        high.append(np.full(len(s), hi))
                seg = np.concatenate(seg)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg), pa.array(np.full(len(seg), qid)), pa.array(np.concatenate(low)), pa.array(np.concatenate(high)), pa.array([code[i].tobytes()] * len(seg), pa.binary())],
                    ["seg", "query_id", "low", "high", "code"],
                )

    most = near(k)

    def nearest(_key, held: pa.Table, asked: pa.Table) -> pa.Table:
        found = ([], [], [], [])
        if held.num_rows and asked.num_rows:
            lab = held.column("label").to_numpy()
            order = np.argsort(lab, kind="stable")
            lab, keys = lab[order], held.column("key").to_numpy()[order]
            x = np.frombuffer(b"".join(held.column("code").to_pylist()), np.int8).reshape(len(lab), -1)[order].astype(np.float32)
            x /= np.sqrt((x * x).sum(1))[:, None]
            q = np.frombuffer(b"".join(asked.column("code").to_pylist()), np.int8).reshape(asked.num_rows, -1).astype(np.float32)
            q /= np.sqrt((q * q).sum(1))[:, None]
            qid, low, high = (asked.column(c).to_numpy() for c in ("query_id", "low", "high"))
            by = np.lexsort((high, low))
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(low[by]) != 0) | (np.diff(high[by]) != 0), [True]]))
            for s, e in zip(edge[:-1], edge[1:]):  # queries of one prefix
                a, z = np.searchsorted(lab, (low[by[s]], high[by[s]]))
                if a == z:
                    continue
                step = max(1, (1 << 22) // int(z - a))
                for at in range(s, e, step):
                    who = by[at : min(e, at + step)]
                    score = q[who] @ x[a:z].T
                    m = min(most, int(z - a))
                    top = np.argpartition(-score, m - 1, axis=1)[:, :m]
                    found[0].append(np.repeat(qid[who], m))
                    found[1].append(keys[a:z][top].ravel())
                    found[2].append(np.take_along_axis(score, top, 1).ravel().astype(np.float64))
                    found[3].append(np.tile(np.concatenate([[z - a], np.zeros(m - 1, np.int64)]), len(who)))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        return pa.table({c: np.concatenate([*f, z]) for c, f, z in zip(("query_id", "key", "rough", "compared"), found, none)})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = cosine(_matrix(b.column("q")), _matrix(b.column("v"))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("ids"), pa.array(s), b.column("compared")], ["query_id", "ids", "score", "compared"])

    queries = rows.where(is_query(F.col("id")))
    held = vectors.mapInArrow(to_segments, "seg long, key long, label long, code binary")
    asked = queries.mapInArrow(ask, "seg long, query_id long, low long, high long, code binary")
    hits = held.groupBy("seg").cogroup(asked.groupBy("seg")).applyInArrow(nearest, "query_id long, key long, rough double, compared long")
    one = hits.groupBy("query_id", "key").agg(F.max("rough").alias("rough"), F.sum("compared").alias("compared"))
    one = one.withColumn("compared", F.sum("compared").over(Window.partitionBy("query_id")))
    best = one.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rough"), "key"))).where(F.col("r") <= most)
    pairs = best.select("query_id", "key", "compared").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id").join(vectors, "key")
    exact = pairs.select("query_id", "ids", "q", "v", "compared").mapInArrow(score, "query_id long, ids array<long>, score double, compared long")
    each = exact.select("query_id", F.explode("ids").alias("vec_id"), "score", "compared").where("vec_id <> query_id")
    each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max("compared").alias("compared"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "compared")


def op1_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of `embeddings` whose id is divisible by 50 against all rows."""
    return search(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda i: i % 50 == 0)
