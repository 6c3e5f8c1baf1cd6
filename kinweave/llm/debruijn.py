"""Substring dedup on a compacted de Bruijn graph of word k-mers.

An edge of the graph is a window of 50 words, from the node of its first 49 words to that of its last 49. A window that
begins in several documents is a repeated edge; what goes is found on paths of them:

1. Cutting: consecutive windows that share a minimizer (the least hash among their 16-word k-mers, leftmost first) are
   one piece, so equal windows always lie in pieces of equal minimizer. Pieces are named by a digest of their words;
   those whose minimizer is of one document alone hold no repeated edge and drop out. What goes of a document depends on
   a window's words only, so a piece that its text has had before is left out, and step 4 finds it again: a line that a
   text repeats a thousand times is two or three pieces.
2. Branches: where a minimizer has one piece only, the piece is a path. Where it has several, their windows become edges,
   the in- and out-edges of every node are counted, and pieces are cut into segments at nodes that branch. The end
   of a piece counts as an edge of its own, so windows of one segment occur together or not at all.
3. Compaction: joins tell each segment whether all its occurrences have the same neighbour before and behind; segments
   that only ever follow each other become one path. The end of a document, or of what step 1 kept, is a neighbour too,
   so every occurrence of a path is whole.
4. Verification: the smallest document of a path is its source. Its words at the path's coordinates are read again, and
   every later occurrence compares its own; then all later occurrences go, and with them the same windows of pieces that
   their text repeats.

Digests are 128 bits of keyed BLAKE2b over the words' bytes (branches compare 64 of them, among the edges of one node
or one segment only), under a key drawn for each call, so that no text can be made to clash.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common
from .textkernel import Grams, Words, utf8, windows

WINDOW, KMER = 50, 16


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each `width` consecutive values, the leftmost if several."""
    n = len(values) - width + 1
    best, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        span += step
    return best[: max(n, 0)]


class Spaced:
    """The words' bytes in a row, one space after each, and digests of runs of words."""

    def __init__(self, words: Words, key: bytes):
        size = words.ends - words.starts
        out = np.full(int(size.sum()) + len(size), 32, np.uint8)
        at = np.repeat(np.arange(len(size)), size)
        at += np.arange(len(at))
        out[at] = words.data[words.full]
        self.raw, self.key = out.tobytes(), key
        self.edge = np.concatenate([[0], np.cumsum(size + 1)])

    def digests(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """128 bits (two longs) of each run of words first to end - 1."""
        raw, key, digest = self.raw, self.key, hashlib.blake2b
        got = b"".join([digest(raw[s:e], digest_size=16, key=key).digest() for s, e in zip(self.edge[first].tolist(), (self.edge[end] - 1).tolist())])
        return np.frombuffer(got, "<i8").reshape(-1, 2)


def cuts(words: Words, window: int, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where many texts are cut: each piece's text, first word (of all texts' words), number of windows and minimizer."""
    hashes = words.hashes()
    gram = Grams(hashes)
    at, _ = windows(words, window)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    all_k = np.arange(len(hashes) - kmer + 1)
    k_hash = gram(all_k, all_k + kmer, 1)
    least = sliding_argmin(k_hash, window - kmer + 1)[at]  # windows lie within a text, and so do their k-mers
    text = words.text_of()[at]
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])]))
    return text[new], at[new], np.diff(np.concatenate([new, [len(at)]])), k_hash[least[new]].view(np.int64)


def firsts(*keys: np.ndarray) -> np.ndarray:
    """For each row the first row of the same keys."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    out = np.empty(len(order), np.int64)
    out[order] = order[new][np.cumsum(new) - 1]
    return out


def pieces(words: Words, window: int, kmer: int, key: bytes) -> dict[str, np.ndarray]:
    """Distinct pieces of each of many texts: text, pos (first word of the first window, in its text), n (windows), h, c, c2."""
    text, at, n, h = cuts(words, window, kmer)
    name = Spaced(words, key).digests(at, at + n - 1 + window)
    one = np.flatnonzero(firsts(text, name[:, 0], name[:, 1]) == np.arange(len(text)))
    return {"text": text[one], "pos": (at - words.first[text])[one], "n": n[one], "h": h[one], "c": name[one, 0], "c2": name[one, 1]}


def repeats(words: Words, window: int, kmer: int, key: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces that pieces() leaves out: text, pos of the same piece before (in its text), own pos and n."""
    text, at, n, h = cuts(words, window, kmer)
    lead = firsts(text, h)
    some = np.flatnonzero(np.bincount(lead, minlength=len(lead))[lead] > 1)  # few, as a rule
    text, at, n = text[some], at[some], n[some]
    if not len(some):
        return text, at, at, n
    name = Spaced(words, key).digests(at, at + n - 1 + window)
    lead = firsts(text, name[:, 0], name[:, 1])
    late = np.flatnonzero(lead != np.arange(len(lead)))
    pos = at - words.first[text]
    return text[late], pos[lead[late]], pos[late], n[late]


def _cut_texts(window: int, kmer: int, key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in common.byte_slices(b, "t"):
                p = pieces(Words(*utf8(part.column("t"))), window, kmer, key)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(p["text"])), part.column("tid").take(pa.array(p["text"])), pa.array(p["pos"].astype(np.int64) << 32 | p["n"]), pa.array(p["h"]), pa.array(p["c"]), pa.array(p["c2"])],
                    ["id", "tid", "span", "h", "c", "c2"],
                )

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for shuffles; null stays null."""
    press = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        for part in common.byte_slices(b, "t"):
            z = [None if t is None else press(t.encode()) for t in part.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "t"), pa.array(z, pa.binary())], [*(c for c in part.schema.names if c != "t"), "z"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of batches with their texts, from column t or packed in z."""
    open_up = zstandard.ZstdDecompressor().decompress
    for b in batches:
        packed = "z" in b.schema.names
        for part in common.byte_slices(b, "z" if packed else "t", common.CHUNK_BYTES // 3 if packed else common.CHUNK_BYTES):
            if packed:
                yield part, pa.array([None if z is None else open_up(z).decode() for z in part.column("z").to_pylist()], pa.large_string())
            else:
                yield part, part.column("t")


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of packed (pos << 32 | n): owner, pos and n."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.int64()))
    packed = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(column)), lengths), packed >> 32, packed & 0xFFFFFFFF


def _flat(column: pa.Array, names: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """Lists of structs of longs: the owner of each struct and its fields; a null list is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), lengths), *(flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names)


def _read_nodes(window: int, key: bytes):
    """Every node of the pieces at the given coordinates: j (its place), x (its hash), the edges into it and out of it.

    edge_in and edge_out are 64 bits of the windows' digests, 0 at the piece's ends; out2 completes edge_out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _unpack(batches):
            words = Words(*utf8(texts))
            gram, spaced = Grams(words.hashes()), Spaced(words, key)
            owner, span, c, c2 = _flat(part.column("spans"), ("span", "c", "c2"))
            start, n = words.first[owner] + (span >> 32), span & 0xFFFFFFFF
            step = 1 << 13
            for at in range(0, len(owner), step):
                first, m, which = start[at : at + step], n[at : at + step], np.arange(at, min(at + step, len(owner)))
                piece = np.repeat(np.arange(len(m)), m + 1)
                j = np.arange(len(piece)) - np.repeat(np.cumsum(m + 1) - m - 1, m + 1)
                node = first[piece] + j
                real = j < m[piece]
                edge = np.zeros((len(node), 2), np.int64)
                edge[real] = spaced.digests(node[real], node[real] + window)
                into = np.concatenate([[0], edge[:-1, 0]])
                into[j == 0] = 0
                columns = [c[which][piece], c2[which][piece], j, gram(node, node + window - 1, 4).view(np.int64), into, edge[:, 0], edge[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["c", "c2", "j", "x", "edge_in", "edge_out", "out2"])

    return run


def _read_sources(window: int, key: bytes):
    """Digests of the words of paths at the given coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _unpack(batches):
            words = Words(*utf8(texts))
            owner, pos, n, p, p2 = _flat(part.column("spans"), ("pos", "n", "p", "p2"))
            first = words.first[owner] + pos
            d = Spaced(words, key).digests(first, first + n - 1 + window)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, p2, d[:, 0], d[:, 1])], ["p", "p2", "d", "d2"])

    return run


def covered(words: Words, at: np.ndarray, n: np.ndarray, window: int, before: np.ndarray, again: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether a window to go covers each word: n windows from each word `at`; of the m from `again` those that go from `before`."""
    turn = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(turn, at, 1)
    np.add.at(turn, at + n, -1)
    go = np.cumsum(turn)[:-1] > 0
    step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    go[np.repeat(again, m) + step] = go[np.repeat(before, m) + step]
    total = np.concatenate([[0], np.cumsum(go)])
    end = np.arange(1, len(go) + 1)
    return total[end] > total[np.maximum(end - window, 0)]  # windows lie within a text


def _finish(window: int, keep_text: bool, key: bytes, kmer: int = KMER):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, column in _unpack(batches):
            data, offsets = utf8(column)
            words = Words(data, offsets)
            owner, pos, n, d, d2 = _flat(part.column("spans"), ("pos", "n", "d", "d2"))
            gone = np.zeros(len(words.starts), bool)
            if len(owner):
                first = words.first[owner] + pos
                own = Spaced(words, key).digests(first, first + n - 1 + window)
                if (own[:, 0] != d).any() or (own[:, 1] != d2).any():
                    raise RuntimeError("a repeated passage differs from its source's words")
                some = np.unique(owner)
                text, before, again, m = repeats(Words(*utf8(column.take(pa.array(some)))), window, kmer, key)
                base = words.first[some[text]]
                gone = covered(words, first, n, window, base + before, base + again, m)
            removed = np.concatenate([[0], np.cumsum(gone)])
            removed = removed[words.first[1:]] - removed[words.first[:-1]]
            raw, texts = data.tobytes(), []
            for i, (a, z) in enumerate(zip(words.first[:-1], words.first[1:])):
                if removed[i] or not keep_text:
                    if removed[i]:
                        stay = a + np.flatnonzero(~gone[a:z])
                        texts.append(b" ".join([raw[s:e] for s, e in zip(words.starts[stay].tolist(), words.ends[stay].tolist())]))
                    else:
                        texts.append(b" ".join(raw[offsets[i] : offsets[i + 1]].split()))
                else:
                    texts.append(raw[offsets[i] : offsets[i + 1]])
            what = pa.array(texts, pa.binary()).cast(pa.string()) if keep_text else pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), what], ["row", "n_words", "n_removed", "kept"])

    return run


def _apart(name: str, to: str) -> Column:
    """The key under another value: a sum per key does not fix the join's exchange then, and Spark can split hot keys."""
    return F.bitwise_not(name).alias(to)


def _keyed(df: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    t = F.col(f"`{text_col}`")
    return df.select(*more, F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(t).alias("tid"), t.alias("t"))


def _chain(rows: DataFrame, *fields: str) -> DataFrame:
    """(id, tid, chain): each text's rows in the order of their spans, repeated rows once."""
    return rows.groupBy("id", "tid").agg(F.array_sort(F.collect_set(F.struct("span", *fields))).alias("chain"))


#: Whether element k of a chain begins where the one before ends.
_ADJACENT = "coalesce(shiftright(e.span, 32) = shiftright(get(chain, k - 1).span, 32) + (get(chain, k - 1).span & 4294967295), false)"


def shared_pieces(src: DataFrame, window: int, kmer: int, key: bytes) -> DataFrame:
    """(id, tid, span, c, c2, several): each text's pieces whose minimizer occurs under several ids; several: in several pieces."""
    every = src.mapInArrow(_cut_texts(window, kmer, key), "id long, tid long, span long, h long, c long, c2 long")
    ends = every.groupBy("h").agg(*[f(x).alias(f"{f.__name__}_{x}") for x in ("id", "c", "c2") for f in (F.min, F.max)])
    spread = ends.where("min_id < max_id").select(_apart("h", "g"), F.expr("min_c <> max_c or min_c2 <> max_c2").alias("several"))
    return every.join(spread, F.bitwise_not(every["h"]) == spread["g"]).select("id", "tid", "span", "c", "c2", "several")


def nodes(shared: DataFrame, packed: DataFrame, window: int, key: bytes) -> DataFrame:
    """The nodes of each distinct piece whose minimizer has several, read at the piece's first coordinates."""
    one = shared.where("several").groupBy("c", "c2").agg(F.min(F.struct("id", "tid", "span")).alias("at"))
    asked = one.select("at.id", "at.tid", F.struct("at.span", "c", "c2").alias("s")).groupBy("id", "tid").agg(F.collect_list("s").alias("spans"))
    return packed.join(asked, ["id", "tid"]).select("z", "spans").mapInArrow(_read_nodes(window, key), "c long, c2 long, j long, x long, edge_in long, edge_out long, out2 long")


def segments(shared: DataFrame, node: DataFrame) -> DataFrame:
    """(id, tid, span, s, s2): occurrences of segments, each named by its first window (a whole piece: by its words)."""
    degree = node.groupBy("x").agg(*[f(x).alias(f"{f.__name__}_{x}") for x in ("edge_in", "edge_out") for f in (F.min, F.max)])
    branch = degree.where("min_edge_in <> max_edge_in or min_edge_out <> max_edge_out").select(_apart("x", "y"))
    inner = node.where("edge_in <> 0 and edge_out <> 0")
    cuts = inner.join(branch, F.bitwise_not(inner["x"]) == branch["y"], "left_semi").union(node.where("edge_in = 0"))
    heads = cuts.groupBy("c", "c2").agg(F.array_sort(F.collect_list(F.struct("j", F.col("edge_out").alias("s"), F.col("out2").alias("s2")))).alias("heads"))
    heads = heads.select(_apart("c", "b"), F.col("c2").alias("b2"), "heads")
    cut = shared.where("several").join(heads, (F.bitwise_not(shared["c"]) == heads["b"]) & (shared["c2"] == heads["b2"]))
    part = "transform(heads, (e, k) -> struct(shiftleft(shiftright(span, 32) + e.j, 32) + coalesce(get(heads, k + 1).j, span & 4294967295) - e.j as span, e.s as s, e.s2 as s2))"
    cut = cut.select("id", "tid", F.explode(F.expr(part)).alias("e")).select("id", "tid", "e.*")
    return shared.where("not several").select("id", "tid", "span", F.col("c").alias("s"), F.col("c2").alias("s2")).union(cut)


def neighbours(segment: DataFrame) -> DataFrame:
    """segments with before and behind: 64 bits of the adjacent segments' names in that text, 0 where there is none."""
    before = f"transform(chain, (e, k) -> struct(e.span as span, e.s as s, e.s2 as s2, case when {_ADJACENT} then chain[k - 1].s else 0 end as before))"
    behind = "transform(chain, (e, k) -> struct(e.span as span, e.s as s, e.s2 as s2, e.before as before, case when get(chain, k + 1).before <> 0 then chain[k + 1].s else 0 end as behind))"
    chain = _chain(segment, "s", "s2").select("id", "tid", F.expr(before).alias("chain"))
    return chain.select("id", "tid", F.explode(F.expr(behind)).alias("e")).select("id", "tid", "e.*")


def paths(linked: DataFrame) -> DataFrame:
    """(id, tid, pos, n, p, p2): occurrences of paths under several ids, named by their first segment."""
    ends = linked.groupBy("s", "s2").agg(*[f(x).alias(f"{f.__name__}_{x}") for x in ("id", "before", "behind") for f in (F.min, F.max)])
    ends = ends.where("min_id < max_id").select(
        _apart("s", "r"), F.col("s2").alias("r2"), F.expr("min_before = max_before and min_before <> 0").alias("one_in"), F.expr("min_behind = max_behind and min_behind <> 0").alias("one_out")
    )
    known = linked.join(ends, (F.bitwise_not(linked["s"]) == ends["r"]) & (linked["s2"] == ends["r2"]))
    chain = _chain(known, "s", "s2", "one_in", "one_out")
    inside = f"{_ADJACENT} and get(chain, k - 1).one_out and e.one_in"
    marked = chain.select("id", "tid", F.expr(f"transform(chain, (e, k) -> struct(e.span as span, e.s as s, e.s2 as s2, not ({inside}) as head))").alias("chain"))
    first = F.expr("filter(chain, (e, k) -> e.head)").alias("first")
    last = F.expr("filter(chain, (e, k) -> coalesce(get(chain, k + 1).head, true))").alias("last")
    each = "transform(first, (e, k) -> struct(shiftright(e.span, 32) as pos, shiftright(last[k].span, 32) + (last[k].span & 4294967295) - shiftright(e.span, 32) as n, e.s as p, e.s2 as p2))"
    return marked.select("id", "tid", first, last).select("id", "tid", F.explode(F.expr(each)).alias("e")).select("id", "tid", "e.*")


def spans_to_go(df: DataFrame, id_col: str, text_col: str, key: bytes, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """(id, tid, spans): places (pos, n windows) of paths that also begin in a row of smaller id, and the source's digest.

    The same windows of pieces that the text repeats go as well and are not among them (repeats() finds them).
    tid is a hash of the text: rows that repeat an id with another text have coordinates of their own.
    """
    src = _keyed(df, id_col, text_col).where("id is not null and t is not null")
    packed = src.mapInArrow(_pack, "id long, tid long, z binary")
    tables = common.Tables(df.sparkSession)
    shared = tables.put("pieces", shared_pieces(src, window, kmer, key))
    node = tables.put("nodes", nodes(shared, packed, window, key))
    segment = tables.put("segments", segments(shared, node))
    tables.drop("pieces", "nodes")
    linked = tables.put("linked", neighbours(segment))
    tables.drop("segments")
    path = tables.put("paths", paths(linked))
    tables.drop("linked")
    source = path.groupBy("p", "p2").agg(F.min(F.struct("id", "tid", "pos", "n")).alias("at")).select("p", "p2", "at.*")
    source = tables.put("sources", source)
    asked = source.groupBy("id", "tid").agg(F.collect_list(F.struct("pos", "n", "p", "p2")).alias("spans"))
    digest = tables.put("digests", packed.join(asked, ["id", "tid"]).select("z", "spans").mapInArrow(_read_sources(window, key), "p long, p2 long, d long, d2 long"))
    low = source.select("p", "p2", F.col("id").alias("low")).join(digest.distinct(), ["p", "p2"]).select(_apart("p", "q"), F.col("p2").alias("q2"), "low", "d", "d2")
    late = path.join(low, (F.bitwise_not(path["p"]) == low["q"]) & (path["p2"] == low["q2"])).where("id > low")
    out = tables.put("spans", late.groupBy("id", "tid").agg(F.collect_list(F.struct("pos", "n", "d", "d2")).alias("spans")))
    tables.drop("paths", "sources", "digests")
    return out


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, kmer: int = KMER, keep_text: bool = False) -> DataFrame:
    """row (all columns of df), n_words, n_removed and kept: the kept words' text, or (keep_text false) its SHA-256.

    A word goes if a window of `window` words that also begins in a row of smaller id covers it; windows are judged
    on the input. Rows of equal id never compare with each other. A null text has no words; rows with a null id keep
    everything and are no source. Texts that lose nothing come back unchanged with keep_text. Extra columns pass
    through in `row`, whatever their names; an empty table gives no rows.
    """
    key = secrets.token_bytes(16)
    go = spans_to_go(df, id_col, text_col, key, window, kmer)
    if keep_text:
        rows = _keyed(df, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).drop("t")
        joined = rows.join(go, ["id", "tid"], "left").select("row", F.col("row")[text_col].alias("t"), "spans")
    else:
        rows = _keyed(df, id_col, text_col).mapInArrow(_pack, "id long, tid long, z binary")
        joined = rows.join(go, ["id", "tid"], "left").select(F.struct(F.col("id").alias(id_col)).alias("row"), "z", "spans")
    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(_finish(window, keep_text, key, kmer), f"row {kind}, n_words long, n_removed long, kept string")


def op8_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-word windows out of all `documents`."""
    out = dedup(common.only(common.table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), e AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d
), s AS (
  SELECT doc_id, word, i, CASE WHEN i + 49 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) END AS win FROM e
), f AS (
  SELECT win, min(doc_id) AS low FROM s WHERE win IS NOT NULL GROUP BY win
), g AS (
  SELECT s.doc_id, word, i, CASE WHEN f.low < s.doc_id THEN 1 ELSE 0 END AS late FROM s LEFT JOIN f USING (win)
), c AS (
  SELECT doc_id, word, i, max(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM g
), k AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, COALESCE(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept FROM c GROUP BY doc_id
)
SELECT doc_id, CAST(COALESCE(n_words, 0) AS BIGINT) AS n_words, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)
"""
