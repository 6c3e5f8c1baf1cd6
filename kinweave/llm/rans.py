"""Token ids as binary files under a static range asymmetric numeral system (rANS).

All files of a folder share one table of frequencies over all documents. A file holds blocks of whole documents;
a block is coded by itself in interleaved lanes (token i is of lane i mod lanes), begins with the checkpoint from
which its decoder starts - the state of every lane - and carries checksums of its bytes and of its ids. The file's
index of blocks stands at its end, so that any block decodes anywhere, apart from all others.

Layout, little-endian: magic, blocks, index (JSON), its length (uint32), magic. A block: document ids (int64),
their lengths (uint32), lane states (uint64), words (uint32).
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common
from .tokens import END, Encoder

MAGIC = b"KWRANS01"
SCALE = 20
LANES, STEPS, BLOCK_TOKENS = 4_096, 32, 1 << 20
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


class Table:
    """Frequencies of ids, scaled to sum to 2**SCALE, every id that occurs at least 1."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        total, used = counts.sum(), counts > 0
        if not total:
            return cls(np.zeros(1, np.int64))
        if used.sum() > 1 << SCALE:
            raise ValueError("more ids than the scale has slots")
        freq = np.where(used, np.maximum(1, counts * ((1 << SCALE) / total)).astype(np.int64), 0)
        order = np.argsort(-freq, kind="stable")
        at, over = 0, int(freq.sum()) - (1 << SCALE)
        while over:  # the commonest give or take what rounding left
            i = order[at % len(order)]
            step = max(-over, -int(freq[i]) // 2) if over > 0 else -over
            if freq[i] + step >= 1:
                freq[i] += step
                over += step
            at += 1
        return cls(freq)

    def symbols(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint16), self.freq.astype(np.int64))


def encode(ids: np.ndarray, table: Table, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """(states, words): what decode needs to give the ids back."""
    state = np.full(lanes, _LOW, np.uint64)
    scale, rest = np.uint64(SCALE), np.uint64(63 - SCALE)
    words = []
    for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes) if len(ids) else ():
        s = ids[at : at + lanes]
        x, f = state[: len(s)], table.freq[s]
        full = x >= f << rest
        words.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        x = np.where(full, x >> _WORD, x)
        q = x // f
        state[: len(s)] = (q << scale) + (x - q * f) + table.start[s]
    return state, np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)


def decode(n: int, state: np.ndarray, words: np.ndarray, table: Table, symbols: np.ndarray) -> np.ndarray:
    lanes, at, out = len(state), 0, np.zeros(n, np.uint16)
    state, mask, scale = state.copy(), np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    words = words.astype(np.uint64)
    for i in range(0, n, lanes):
        x = state[: min(lanes, n - i)]
        slot = x & mask
        s = symbols[slot]
        out[i : i + lanes] = s
        x = table.freq[s] * (x >> scale) + slot - table.start[s]
        low = np.flatnonzero(x < _LOW)
        x[low] = (x[low] << _WORD) | words[at : at + len(low)]
        at += len(low)
        state[: len(x)] = x
    if at != len(words) or (state != _LOW).any():
        raise ValueError("a block's words do not end with its ids")
    return out


def write_block(doc_ids: np.ndarray, nulls: int, parts: list[np.ndarray], table: Table) -> tuple[bytes, dict]:
    ids = np.concatenate([np.zeros(0, np.uint16), *parts])
    lanes = int(min(LANES, max(1, len(ids) // STEPS)))
    state, words = encode(ids, table, lanes)
    raw = doc_ids.astype("<i8").tobytes() + np.array([len(p) for p in parts], "<u4").tobytes() + state.astype("<u8").tobytes() + words.astype("<u4").tobytes()
    return raw, {"bytes": len(raw), "docs": len(parts), "nulls": nulls, "tokens": len(ids), "lanes": lanes, "crc": zlib.crc32(raw), "ids_crc": zlib.crc32(ids.astype("<u2").tobytes())}


def read_block(raw: bytes, b: dict, table: Table, symbols: np.ndarray) -> tuple[list, list[np.ndarray]]:
    """Document ids and the ids of each."""
    if zlib.crc32(raw) != b["crc"]:
        raise ValueError("a block's bytes differ from its checksum")
    n, k = b["docs"], b["lanes"]
    docs, lengths = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u4", n, 8 * n)
    ids = decode(b["tokens"], np.frombuffer(raw, "<u8", k, 12 * n), np.frombuffer(raw, "<u4", -1, 12 * n + 8 * k), table, symbols)
    if zlib.crc32(ids.astype("<u2").tobytes()) != b["ids_crc"]:
        raise ValueError("a block's ids differ from their checksum")
    return [None] * b["nulls"] + docs[b["nulls"] :].tolist(), np.split(ids, np.cumsum(lengths)[:-1])


class Output:
    """A file that appears whole or not at all; another attempt at the same task writes the same bytes."""

    def __init__(self, folder: str, name: str):
        self.store, path = fs.FileSystem.from_uri(folder)
        self.store.create_dir(path, recursive=True)
        self.path, self.trial, self.size = f"{path}/{name}", f"{path}/.{name}.{uuid.uuid4().hex}", 0
        self.stream = self.store.open_output_stream(self.trial)

    def write(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.size += len(raw)

    def close(self) -> None:
        self.stream.close()
        self.store.move(self.trial, self.path)


def _get(folder: str, name: str, at: int | None = None, size: int | None = None) -> bytes:
    store, path = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{path}/{name}") as f:
        return f.read() if at is None else f.read_at(size, at if at >= 0 else f.size() + at)


def _tokenised(df: DataFrame, id_col: str, text_col: str, path: str | None, end: int) -> DataFrame:
    """(bucket, id, ids): ids of each whole text and the end id, dealt into ranges of ids by quantiles; null ids first."""
    n = common.partitions(df.sparkSession)
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"))
    bounds = np.unique(np.array(src.select("id").approxQuantile("id", [i / n for i in range(1, n)], 0.1 / n), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, tail = Encoder(path), np.array([end], np.uint16).tobytes()
        for b in batches:
            for part in common.byte_slices(b, "t"):
                ids, at = coder.encode(part.column("t"))
                raw, at = ids.tobytes(), (2 * at).tolist()
                to = np.searchsorted(bounds, pa.compute.fill_null(part.column("id"), -(1 << 63)).to_numpy(), "right")
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), part.column("id"), pa.array([raw[s:e] + tail for s, e in zip(at, at[1:])], pa.binary())], ["bucket", "id", "ids"])

    return src.mapInArrow(run, "bucket int, id long, ids binary").repartitionById(n, F.col("bucket"))


def write(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END) -> list[dict]:
    """Files of all texts' ids in ascending order of document ids (null ids first, equal ids by their token ids).

    Null and empty texts have the end id alone; an empty table gives no file but the table's. Returns, per file in
    order: name, docs and tokens. Only ids are moved, once, and kept in the shared folder between the two passes
    (frequencies, then coding). A file's blocks hold whole documents and about BLOCK_TOKENS ids, or one longer one, and go
    to the file as they close.
    """
    spark = df.sparkSession
    tokens = common.cut(_tokenised(df, id_col, text_col, path, end).sortWithinPartitions("bucket", "id", "ids"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            column = b.column("ids")
            if len(column):
                total += np.bincount(np.frombuffer(b"".join(column.to_pylist()), np.uint16), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["token", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for r in tokens.select("ids").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[r["token"]] = r["n"]
    table = Table.of(counts)
    raw = table.freq.astype("<u4").tobytes()
    out = Output(folder, "table.bin")
    out.write(MAGIC + np.array([SCALE, zlib.crc32(raw)], "<u4").tobytes() + raw)
    out.close()

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, out, index = None, None, []
        docs, parts, size = [], [], 0

        def close_block() -> None:
            nonlocal out, docs, parts, size
            if docs:
                if out is None:
                    out = Output(folder, f"part-{bucket:06d}.rans")
                    out.write(MAGIC)
                raw, b = write_block(np.array([d or 0 for d in docs], np.int64), sum(d is None for d in docs), parts, table)
                index.append(b | {"at": out.size})
                out.write(raw)
            docs, parts, size = [], [], 0

        def close_file() -> Iterator[pa.RecordBatch]:
            nonlocal out, index
            close_block()
            if index:
                tail = json.dumps({"scale": SCALE, "blocks": index}).encode()
                out.write(tail + np.array([len(tail)], "<u4").tobytes() + MAGIC)
                out.close()
                sums = [pa.array([sum(b[k] for b in index)], pa.int64()) for k in ("docs", "tokens")]
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([f"part-{bucket:06d}.rans"]), *sums], ["bucket", "name", "docs", "tokens"])
            out, index = None, []

        for b in batches:
            for to, doc, ids in zip(b.column("bucket").to_pylist(), b.column("id").to_pylist(), b.column("ids").to_pylist()):
                if to != bucket:
                    yield from close_file()
                    bucket = to
                docs.append(doc)
                parts.append(np.frombuffer(ids, np.uint16))
                size += len(parts[-1])
                if size >= BLOCK_TOKENS:
                    close_block()
        yield from close_file()

    made = tokens.mapInArrow(files, "bucket int, name string, docs long, tokens long").collect()
    return [r.asDict() for r in sorted(made, key=lambda r: r["bucket"])]


def read_table(folder: str) -> Table:
    raw = _get(folder, "table.bin")
    scale, crc = np.frombuffer(raw, "<u4", 2, len(MAGIC))
    if raw[: len(MAGIC)] != MAGIC or scale != SCALE or zlib.crc32(raw[len(MAGIC) + 8 :]) != crc:
        raise ValueError("not a table of this format")
    return Table(np.frombuffer(raw, "<u4", -1, len(MAGIC) + 8).astype(np.int64))


def read_index(folder: str, name: str) -> list[dict]:
    tail = _get(folder, name, -(len(MAGIC) + 4), len(MAGIC) + 4)
    if tail[4:] != MAGIC:
        raise ValueError(f"{name} is not whole")
    n = int(np.frombuffer(tail, "<u4", 1)[0])
    return json.loads(_get(folder, name, -(n + len(tail)), n))["blocks"]


def read(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document in the files."""
    start, rows = 0, []
    for f in files:  # one row per file
        rows.append((f["name"], start))
        start += f["tokens"]
    blocks = spark.createDataFrame(rows, "name string, start long").repartition(max(1, min(len(rows), common.partitions(spark))))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                for b in read_index(folder, name):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([json.dumps(b)])], ["name", "start", "block"])
                    at += b["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = read_table(folder)
        symbols = table.symbols()
        for batch in batches:
            for name, at, block in zip(*(batch.column(c).to_pylist() for c in ("name", "start", "block"))):
                b = json.loads(block)
                docs, parts = read_block(_get(folder, name, b["at"], b["bytes"]), b, table, symbols)
                n = np.array([len(p) for p in parts], np.int64)
                crc = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(at + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    each = blocks.mapInArrow(index, "name string, start long, block string").repartition(common.partitions(spark), "name", "start")
    return each.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` to files in the shared folder and back."""
    folder = f"{common.Tables(spark).folder}/rans"
    return read(spark, folder, write(common.table(spark, sf_dir, "documents"), folder))
