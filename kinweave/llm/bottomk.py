"""Bottom-k sketches of word-shingle hashes: mergeable fingerprints that estimate resemblance, containment and size."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common
from .textkernel import Grams, Words, lower, utf8

#: Hashes kept, words of a shingle, bits of a hash.
K, SHINGLE, HASH_BITS = 256, 5, 48


def sketches(texts: pa.Array, k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The k smallest distinct shingle hashes of each text, ascending; fewer words than a shingle: one of them all."""
    data, offsets = utf8(texts)
    words = Words(lower(data), offsets)
    gram = Grams(words.hashes())
    out = []
    n = np.where(words.counts > 0, np.maximum(words.counts - shingle + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], n)
    h = gram(at, np.minimum(at + shingle, np.repeat(words.first[1:], n)), 6) >> np.uint64(64 - HASH_BITS)
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        part = h[a:z]
        if z - a > 8 * k:  # the k smallest are nearly always below this bar
            low = part[part < np.uint64((4 * k << HASH_BITS) // (z - a))]
            low = np.unique(low)
            part = low if len(low) >= k else np.unique(part)
        else:
            part = np.unique(part)
        out.append(part[:k])
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of two parts."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness of the shingle sets, exact while their union has at most k; two empty texts: 1."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated distinct shingles, exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**HASH_BITS)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; an empty a: 1."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def to_string(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_string(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).reshape(-1).view(">u8").astype(np.uint64)


def _fingerprint_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in common.byte_slices(b, "t"):
            s = sketches(part.column("t"))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([to_string(x) for x in s], pa.string()), pa.array([distinct(x) for x in s], pa.float64())], ["id", "fingerprint", "n_shingles"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint and n_shingles (estimated) of each row; null and empty texts have the empty fingerprint."""
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"))
    return src.mapInArrow(_fingerprint_column, "id long, fingerprint string, n_shingles double")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, guest, id descending): each row that is no guest with the one after it."""

    def done(rows: list[tuple], last: bool) -> Iterator[pa.RecordBatch]:
        out = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
        if not out:
            return
        own = sketches(pa.array([r[3] for r in rows], pa.large_string()))
        edited = []
        for i in out:
            text, cut = rows[i][3], len(rows[i][3]) // 3
            edited.append(text[: len(text) - cut] + rows[i + 1][3][:cut])
        new = sketches(pa.array(edited, pa.large_string()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in out], pa.int64()),
                pa.array([len(rows[i][3]) for i in out], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([to_string(own[i]) for i in out], pa.string()),
                pa.array([to_string(s) for s in new], pa.string()),
                pa.array([resemblance(own[i], s) for i, s in zip(out, new)], pa.float64()),
                pa.array([resemblance(own[i], own[i + 1]) for i in out], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    rows: list[tuple] = []
    for b in batches:
        for part in common.byte_slices(b, "t"):
            got = list(zip(*(part.column(c).to_pylist() for c in ("bucket", "guest", "id", "t"))))
            rows += [(k, g, i, t or "") for k, g, i, t in got]
            yield from done(rows, False)
            rows = rows[-1:]


def compare_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each row and of its edited text, and how near they and the next row's are.

    The next row is the one of the next smaller id (rows of equal id in the order of a hash of their text; null ids
    come last), after the last the first; the edited text has its last third of code points replaced by the first as
    many of the next row. Null texts are empty. A table of one row is its own next row; an empty table gives no rows.
    Texts move once: ids are dealt into ranges, a range to a task, and the row that follows each range's last goes there
    as well.
    """
    spark = df.sparkSession
    lowest = -(1 << 63)
    src = df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(lowest)).alias("id"), F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{text_col}`").alias("t"))
    ids = src.select("id")
    n = common.partitions(spark)
    bounds = np.unique(np.array(ids.approxQuantile("id", [i / n for i in range(1, n)], 0.1 / n), np.int64))

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.searchsorted(bounds, b.column("id").to_numpy(), "right").astype(np.int32))], ["id", "bucket"])

    # One row per range, at most as many as shuffle partitions.
    tops = {r["bucket"]: r["top"] for r in ids.mapInArrow(bucketed, "id long, bucket int").groupBy("bucket").agg(F.max("id").alias("top")).collect()}
    order = sorted(tops)
    visits = [(tops[order[i - 1]], order[i]) for i in range(len(order))]  # range 0 is followed by the overall first

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = np.searchsorted(bounds, b.column("id").to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to), pa.array(np.zeros(b.num_rows, bool))], [*b.schema.names, "bucket", "guest"])

    rows = src.mapInArrow(deal, "id long, none boolean, t string, bucket int, guest boolean")
    # Of several rows of a range's top id the one that comes first visits, alone.
    guests = src.join(F.broadcast(spark.createDataFrame(visits, "id long, bucket int")), "id").groupBy("bucket", "id").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "none", "t")).alias("r"))
    guests = guests.select("id", "r.none", "r.t", "bucket", F.lit(True).alias("guest"))
    dealt = rows.union(guests).repartitionById(n, F.col("bucket"))
    dealt = dealt.sortWithinPartitions("bucket", "guest", F.desc("id"), F.xxhash64("t"))
    dealt = dealt.select("bucket", "guest", F.when(~F.col("none"), F.col("id")).alias("id"), "t")
    return dealt.mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all `documents`."""
    return compare_with_edits(common.table(spark, sf_dir, "documents"))
