"""SimHash near-duplicates, linked by anchor-point covering.

The 64 bits split into m blocks of odd length; an anchor is a word of the product of the blocks' repetition codes,
so it is named by one majority bit per block, and every fingerprint has one nearest anchor. Of two fingerprints
within three bits, some point on the way lies within one bit of one and two bits of the other, and its anchor is in
reach of both. So each fingerprint goes to each anchor whose majority bits it reaches by two flips at most - all
inside the covering radius plus the threshold - and fingerprints that share an anchor are compared. m grows with
the number of distinct fingerprints, which keeps the groups short; exact copies are one fingerprint from the start.
Fingerprints of an anchor that has more than GROUP of them go on to a code with more anchors instead, where every pair
of them meets again; with the finest code a group is bounded by the points near one anchor.

Documents of a likeness (keep_one) take wide fingerprints of five-word shingles, whose differing bits estimate the
Jaccard likeness. Theirs are too many bits for one code: they split into blocks, an anchor is a word of one block, and a
fingerprint goes to its own word and to those that its least decided bits of the block, flipped, give.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, components
from .textkernel import Grams, Words, lower, mix, utf8

SHINGLE, SEED, MOST_BITS = 3, 42, 3
#: Wide fingerprints: bits, words of a shingle, likeness of near-duplicates.
WIDE, WIDE_SHINGLE, ALIKE = 512, 5, 0.8
#: Fingerprints of one anchor up to this many are compared in one matrix, more of them row by row.
MATRIX = 1_500
#: Fingerprints of one anchor beyond this go on to a finer code: one of FINER more majority bits, FINEST at most.
GROUP, FINER, FINEST = 4_000, 14, 60


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 if over half of the shingles' XXH64 have it; A-Z count as a-z; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(n + 1) - 1
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    start, end = (end - n)[: 1 - shingle].tolist(), end[shingle - 1 :].tolist()
    ones, count = np.zeros(64, np.int64), len(start)
    for at in range(0, count, 65_536):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start[at : at + 65_536], end[at : at + 65_536])), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tid, fp) of each row, fp as a signed long, tid a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in common.byte_slices(b, "t", 16 << 20):
                fp = np.array([fingerprint(t or b"") for t in part.column("t").cast(pa.binary()).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tid"), pa.array(fp.view(np.int64))], ["doc_id", "tid", "fp"])

    t = F.col(f"`{text_col}`")
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(t).alias("tid"), t.alias("t"))
    return src.mapInArrow(run, "doc_id long, tid long, fp long")


def block_sizes(m: int) -> list[int]:
    """m odd lengths that sum to 64, m even and at least 14: fives and threes, or threes and ones."""
    if m < 22:
        fives = (64 - 3 * m) // 2
        return [5] * fives + [3] * (m - fives)
    threes = (64 - m) // 2
    return [3] * threes + [1] * (m - threes)


def code_length(n: int) -> int:
    """Majority bits for n distinct fingerprints."""
    return min(FINEST, max(14, 2 * int((math.log2(max(n, 2)) - 1) // 2)))


def anchors(fp: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for each anchor in reach of each fingerprint."""
    bit, cost, at = [], [], 0
    for n in sizes:
        ones = np.bitwise_count(fp & np.uint64(((1 << n) - 1) << at)).astype(np.int64)
        bit.append(ones > n // 2)
        cost.append(np.where(bit[-1], ones - n // 2, n // 2 + 1 - ones))
        at += n
    bit, cost = np.stack(bit, 1), np.stack(cost, 1)
    flip = 1 << np.arange(len(sizes), dtype=np.int64)
    home = bit @ flip
    rows, to = [np.arange(len(fp))], [home]
    r, j = np.nonzero(cost <= 2)
    rows.append(r)
    to.append(home[r] ^ flip[j])
    first, second = np.triu_indices(len(sizes), 1)
    r, p = np.nonzero((cost[:, first] == 1) & (cost[:, second] == 1))
    rows.append(r)
    to.append(home[r] ^ flip[first[p]] ^ flip[second[p]])
    return np.concatenate(rows), np.concatenate(to)


def forest(fp: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what chains of at most `most` differing bits connect, one less than each group's size."""
    n = len(fp)
    if n <= MATRIX:
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= most
        np.fill_diagonal(near, False)
        live = np.flatnonzero(near.any(1))
        near, fp = near[np.ix_(live, live)], fp[live]
        n = len(fp)
    else:
        near = None
    left, a, b = np.arange(n), [], []
    while len(left):
        root, left, front = left[0], left[1:], [left[0]]
        while front and len(left):
            i = front.pop()
            hit = near[i, left] if near is not None else np.bitwise_count(fp[left] ^ fp[i]) <= most
            if hit.any():
                found = left[hit]
                left = left[~hit]
                front += found.tolist()
                a.append(np.full(len(found), fp[root]))
                b.append(fp[found])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def meet(distinct: DataFrame, bits: int, group: int | None) -> DataFrame:
    """(a, b): edges among the fingerprints (column fp) of each anchor; (fp, null) for those of anchors with more than group."""
    sizes = block_sizes(bits)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fp = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(all_fp), 8_192):
                fp = all_fp[at : at + 8_192]
                row, to = anchors(fp, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(fp[row].view(np.int64))], ["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        anchor, n = None, 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            if 1 < n and held:
                a, b = forest(np.concatenate(held).view(np.uint64))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
            held, n = [], 0

        for batch in batches:  # sorted by anchor; a group may go on in the next batch
            to, fp = batch.column("anchor").to_numpy(), batch.column("fp").to_numpy()
            if not len(to):
                continue
            edge = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]])
            for s, e in zip(edge[:-1], edge[1:]):
                if to[s] != anchor:
                    yield from close()
                    anchor = to[s]
                held.append(fp[s:e])
                n += e - s
                if group is not None and n > group:  # handed on as they come
                    out = np.concatenate(held)
                    held = []
                    yield pa.RecordBatch.from_arrays([pa.array(out), pa.nulls(len(out), pa.int64())], ["a", "b"])
        yield from close()

    spread_out = distinct.mapInArrow(spread, "anchor long, fp long").repartition(common.partitions(distinct.sparkSession), "anchor")
    return spread_out.sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long")


def links(distinct: DataFrame, n: int, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp), enough to connect all that are linked."""
    bits, edges = code_length(n), None
    while True:
        found = common.cut(meet(distinct, bits, group if bits < FINEST else None))
        some = found.where("b is not null")
        edges = some if edges is None else edges.union(some)
        distinct = found.where("b is null").select(F.col("a").alias("fp")).distinct()
        if bits == FINEST or distinct.isEmpty():
            return edges
        bits = min(FINEST, bits + FINER)


def _labelled(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(prints: doc_id, tid, fp of each row; label: fp, root of each fingerprint)."""
    prints = common.cut(fingerprints(df, id_col, text_col))
    distinct = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    tree = components.roots(links(distinct.select("fp"), distinct.count()))
    label = distinct.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    return prints, label


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest id that links reach) of each row.

    Links are fingerprints with three or fewer differing bits. A null text has no words, hence fingerprint zero,
    and links like any other. Rows with a null id take part; a component of such rows alone has a null component_id.
    Rows that repeat an id stay as they are. An empty table gives no rows; other columns are not read.
    """
    prints, label = _labelled(df, id_col, text_col)
    lowest = label.groupBy("root").agg(F.min("low").alias("component_id"))
    label = label.join(lowest, "root").select("fp", "component_id")
    return prints.join(label, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def wide(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of WIDE bits as rows of words, how decided each bit is) over the texts' distinct five-word shingles.

    A-Z count as a-z; a text of fewer words is one shingle, one of none has the fingerprint zero.
    """
    data, offsets = utf8(texts)
    words = Words(lower(data), offsets)
    n = np.where(words.counts > 0, np.maximum(words.counts - WIDE_SHINGLE + 1, 1), 0)
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n - words.first[:-1], n)
    h = Grams(words.hashes())(at, np.minimum(at + WIDE_SHINGLE, words.first[1:][text]), 7)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    ones = np.zeros((len(n), WIDE), np.int32)
    for s in range(0, len(h), 1 << 15):
        part, of = h[s : s + (1 << 15)], text[s : s + (1 << 15)]
        start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        for j in range(0, WIDE, 64):
            bits = np.unpackbits(mix(part, 11 + j).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[of[start], j : j + 64] += np.add.reduceat(bits, start, axis=0, dtype=np.int32)
    many = np.bincount(text, minlength=len(n))[:, None]
    off = 2 * ones - many
    decided = np.minimum(255, 64 * np.abs(off) / np.sqrt(np.maximum(many, 1))).astype(np.uint8)
    return np.packbits(off > 0, axis=1, bitorder="little").view(np.uint64), decided


def most_differing(alike: float) -> int:
    """Bits within which fingerprints are taken for texts of that Jaccard likeness: the mean of such pairs and one standard error."""
    share = math.acos(2 * alike / (1 + alike)) / math.pi
    return int(WIDE * share + math.sqrt(WIDE * share * (1 - share)))


def layout(n: int) -> tuple[int, int, int]:
    """(bits of a block, blocks, bits to flip) for n distinct fingerprints: a block's words are about as many as they."""
    bits = min(40, max(12, math.ceil(math.log2(max(n, 2)))))
    return bits, min(WIDE // bits, bits), 2 if bits < 22 else 3


def wide_anchors(fp: np.ndarray, decided: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for each anchor that each wide fingerprint goes to."""
    bits, blocks, flips = layout(n)
    all_bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little").astype(np.int64)
    power = np.int64(1) << np.arange(bits, dtype=np.int64)
    rows, to = [], []
    for k in range(blocks):
        own = all_bits[:, k * bits : (k + 1) * bits] @ power
        weak = np.argsort(decided[:, k * bits : (k + 1) * bits], axis=1, kind="stable")[:, :flips]
        for m in range(1 << flips):
            word = own.copy()
            for j in range(flips):
                if m >> j & 1:
                    word ^= power[weak[:, j]]
            rows.append(np.arange(len(fp)))
            to.append(np.int64(k) << 48 | word)
    return np.concatenate(rows), np.concatenate(to)


def wide_forest(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of edges that connect what chains of at most `most` differing bits connect, one less than each group's size."""

    def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(a[..., j] ^ b[..., j]).astype(np.uint16) for j in range(fp.shape[1]))

    near = differing(fp[:, None], fp[None]) <= most if len(fp) <= MATRIX // 2 else None
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        root, left, front = left[0], left[1:], [left[0]]
        while front and len(left):
            i = front.pop()
            hit = near[i, left] if near is not None else differing(fp[left], fp[i]) <= most
            if hit.any():
                found, left = left[hit], left[~hit]
                front += found.tolist()
                a.append(np.full(len(found), root))
                b.append(found)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def wide_links(distinct: DataFrame, n: int, most: int) -> DataFrame:
    """Edges (a, b) between the keys of distinct wide fingerprints (key, fp, decided), enough to connect all that anchors bring together."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fp, decided = (np.frombuffer(b"".join(part.column(c).to_pylist()), kind).reshape(part.num_rows, -1) for c, kind in (("fp", np.uint64), ("decided", np.uint8)))
                row, to = wide_anchors(fp, decided, n)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(to), part.column("key").take(row), part.column("fp").take(row)], ["anchor", "key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, keys, prints = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(keys) > 1:
                key = np.array(keys, np.int64)
                a, b = wide_forest(np.frombuffer(b"".join(prints), np.uint64).reshape(len(key), -1), most)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(key[b])], ["a", "b"])
            keys.clear()
            prints.clear()

        for batch in batches:  # sorted by anchor; a group may go on in the next batch
            for to, key, fp in zip(*(batch.column(c).to_pylist() for c in ("anchor", "key", "fp"))):
                if to != anchor:
                    yield from close()
                    anchor = to
                keys.append(key)
                prints.append(fp)
        yield from close()

    rows = distinct.mapInArrow(spread, "anchor long, key long, fp binary").repartition(common.partitions(distinct.sparkSession), "anchor")
    return rows.sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", alike: float = ALIKE) -> DataFrame:
    """df with one row of each group of near-duplicates: that of the smallest id (null last), then of the least hash of its text.

    Texts link if their wide fingerprints say that their five-word shingles have a Jaccard likeness of `alike` or more, to
    within a standard error; groups are what links connect. Equal texts always link, texts without words with each
    other. Repeated rows are one group; an empty table gives no rows; other columns pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in common.byte_slices(b, "t"):
                fp, decided = wide(part.column("t"))
                binary = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (fp, decided)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("none", "id", "tid")), *binary], ["none", "id", "tid", "fp", "decided"])

    t, key = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long")
    row = {"none": key.isNull(), "id": F.coalesce(key, F.lit(0)), "tid": F.xxhash64(t)}
    src = df.select(*[v.alias(k) for k, v in row.items()], t.alias("t"))
    prints = src.mapInArrow(run, "none boolean, id long, tid long, fp binary, decided binary")
    tables = common.Tables(df.sparkSession)
    first = prints.groupBy("fp").agg(F.min(F.struct("none", "id", "tid", "decided")).alias("row"))  # copies meet before anything is compared
    distinct = tables.put("prints", first.select("fp", "row.*").withColumn("key", F.monotonically_increasing_id()))
    tree = components.roots(tables.put("links", wide_links(distinct, distinct.count(), most_differing(alike)).distinct()))
    label = distinct.select("key", "none", "id", "tid").join(tree.withColumnRenamed("node", "key"), "key", "left")
    chosen = tables.put("chosen", label.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min(F.struct("none", "id", "tid")).alias("row")).select("row.*").distinct())
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[v.alias(k) for k, v in row.items()])
    kept = rows.join(chosen, ["none", "id", "tid"], "left_semi").dropDuplicates(["none", "id", "tid"])
    return kept.select(*[F.col("row")[c].alias(c) for c in df.columns])


def op7_simhash_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all `documents`."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))
