"""Exact best rows by the dot product of sparse vectors, block against block in numpy.

A country's asking and answering vectors are dealt over blocks of bounded size, and every asking block meets every answering
one. Either side is moved once for each block of the other, so blocks are large; small countries have some as well, for the tasks' sake.
Blocks' best rows merge by (asking text): nothing is left out, whatever a country's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Tokens of an asking and of an answering block, about.
ASK, ANSWER = 1 << 17, 1 << 20
#: Asking blocks that a country has at least, if each gets LEAST tokens.
SPREAD, LEAST = 4, 1 << 12
#: Tasks at most; beyond that a task takes several blocks, one after the other.
TASKS = 2_000


def best(vectors: DataFrame, k: int, sizes: tuple[int, int] = (ASK, ANSWER)) -> DataFrame:
    """(country, text, best): the k best ids of each asking text as (less, c), by the score rounded to six digits, then c.

    vectors: (country, text, t, w, asks, ids), read several times; ids (sorted) are all of a text's that may be among the k
    best, null of texts that do not answer. less is the score's negative. Only ids that share a token are found.
    """

    def tokens(which: str) -> Column:
        return F.sum(F.when(F.expr(which), F.size("t")).otherwise(0)).alias(which.split()[0])

    count = {r["country"]: [-(-r["asks"] // sizes[0]) or 1, -(-r["ids"] // sizes[1]) or 1, min(SPREAD, r["asks"] // LEAST)] for r in vectors.groupBy("country").agg(tokens("asks"), tokens("ids is not null")).collect()}
    blocks = [(country, max(i, spread), j) for country, (i, j, spread) in count.items()]
    base = np.concatenate([[0], np.cumsum([i * j for _, i, j in blocks])]).astype(np.int64)
    total = int(base[-1])
    # Blocks are numbered over all countries and go to tasks by their numbers; by a hash some tasks would get several, others none.
    numbers = [pa.array([c for c, *_ in blocks], pa.string()), *(pa.array([b[x] for b in blocks], pa.int32()) for x in (1, 2)), pa.array(base[:-1])]
    n = F.broadcast(vectors.sparkSession.createDataFrame(pa.table(numbers, ["country", "is", "js", "base"])))
    dealt = vectors.join(n, "country").withColumn("h", F.xxhash64("text"))
    i, j = (F.pmod(F.col("h"), F.col(x)) for x in ("is", "js"))
    every = {x: F.explode(F.sequence(F.lit(0), F.col(x) - 1)) for x in ("is", "js")}
    left = dealt.where("asks").select("country", "text", "t", "w", F.lit(None).cast("array<string>").alias("ids"), "base", "js", i.alias("i"), every["js"].alias("j"))
    right = dealt.where("ids is not null").select("country", F.lit(None).cast("string").alias("text"), "t", "w", "ids", "base", "js", j.alias("j"), every["is"].alias("i"))
    tasks = max(1, min(total, TASKS))
    both = left.unionByName(right).withColumn("b", F.col("base") + F.col("i") * F.col("js") + F.col("j")).select("b", "country", "text", "t", "w", "ids")
    both = both.repartitionById(tasks, F.pmod(F.col("b"), F.lit(tasks)).cast("int")).sortWithinPartitions("b")
    found = both.mapInArrow(lambda batches: _blocks(batches, k), "country string, text string, best array<struct<less: double, c: string>>")
    merged = found.groupBy("country", "text").agg(F.collect_list("best").alias("l"))
    whole = F.when(F.size("l") == 1, F.col("l")[0]).otherwise(F.slice(F.array_sort(F.flatten("l")), 1, k))
    return merged.select("country", "text", whole.alias("best"))


def _blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The blocks of one task, whose rows lie together; rows with ids answer."""
    held: list[pa.RecordBatch] = []

    def meet() -> list[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        answers = rows["ids"].is_valid()
        answer = rows.filter(answers)
        return block(rows.filter(pc.invert(answers)), answer.rename_columns([f"a_{c}" for c in answer.column_names]), k).to_batches()

    for batch in batches:
        b = batch["b"].to_numpy()
        edges = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
        for start, end in zip(edges, edges[1:]):
            if end > start:
                if held and held[0]["b"][0].as_py() != b[start]:
                    yield from meet()
                    held.clear()
                held.append(batch.slice(start, end - start))
    if held:
        yield from meet()


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets and values of a list column."""
    one = pa.concat_arrays(column.chunks)
    return np.concatenate([[0], np.cumsum(one.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64), one.flatten()


_BEST = pa.list_(pa.struct([("less", pa.float64()), ("c", pa.string())]))


def block(ask: pa.Table, answer: pa.Table, k: int) -> pa.Table:
    """The k best ids of each asking vector of one block among the answering vectors (a_t, a_w, a_ids) of another."""
    if not ask.num_rows or not answer.num_rows:
        return pa.table({"country": pa.array([], pa.string()), "text": pa.array([], pa.string()), "best": pa.array([], _BEST)})
    (qo, qt), (co, ct), (mo, ids) = _flat(ask["t"]), _flat(answer["a_t"]), _flat(answer["a_ids"])
    codes = pa.concat_arrays([qt.cast(pa.string()), ct.cast(pa.string())]).dictionary_encode()
    words, codes = len(codes.dictionary), codes.indices.to_numpy(zero_copy_only=False)
    qw, cw = _flat(ask["w"])[1].to_numpy(zero_copy_only=False), _flat(answer["a_w"])[1].to_numpy(zero_copy_only=False)
    qt, ct = codes[: len(qw)], codes[len(qw) :]
    order = np.argsort(ct, kind="stable")
    at = np.searchsorted(ct[order], np.arange(words + 1))
    row, weight = np.repeat(np.arange(len(co) - 1), np.diff(co))[order], cw[order]
    most = np.zeros(words)
    np.maximum.at(most, ct, cw)
    held, place = np.diff(mo), np.empty(len(ids), np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    acc, sizes, scores, members = np.zeros(len(held)), np.zeros(len(qo) - 1, np.int64), [], []
    for n in range(len(qo) - 1):
        t, w = qt[qo[n] : qo[n + 1]], qw[qo[n] : qo[n + 1]]
        rare = np.argsort(at[t + 1] - at[t], kind="stable")
        t, w = t[rare].tolist(), w[rare].tolist()
        lists = [(row[at[x] : at[x + 1]], weight[at[x] : at[x + 1]]) for x in t]
        for (r, v), y in zip(lists, w):
            acc[r] += v * y
        # What only later lists hold scores at most their bound: once k ids are above it, they are not looked at.
        bound = np.cumsum([most[x] * y for x, y in zip(reversed(t), reversed(w))])[::-1]
        rows, got, done = np.empty(0, np.int64), np.empty(0, np.int64), False
        for m, (r, _) in enumerate(lists):
            if not done:
                v = acc[r]
                new = v > 0  # a row met before is zero again
                rows, got = np.concatenate([rows, r[new]]), np.concatenate([got, np.floor(v[new] * 1e6 + 0.5).astype(np.int64)])
                if m + 1 < len(lists):
                    rows, got, full = _top(rows, got, held, k)
                    done = full is not None and full > bound[m + 1] * 1e6 + 1
            acc[r] = 0.0
        rows, got, _ = _top(rows, got, held, k)
        n_ids = held[rows]
        inside = np.arange(n_ids.sum()) - np.repeat(np.cumsum(n_ids) - n_ids, n_ids)
        id_, score = np.repeat(mo[rows], n_ids) + inside, np.repeat(got, n_ids)
        first = np.lexsort((place[id_], -score))[:k]
        members.append(id_[first])
        scores.append(score[first])
        sizes[n] = len(first)
    some = np.flatnonzero(sizes)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32))
    less = pa.array(-np.concatenate(scores).astype(np.float64) / 1e6)
    lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([less, ids.take(pa.array(np.concatenate(members))).cast(pa.string())], ["less", "c"]))
    return pa.table({"country": ask["country"].take(pa.array(some)), "text": ask["text"].take(pa.array(some)), "best": lists})


def _top(rows: np.ndarray, got: np.ndarray, held: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int | None]:
    """The rows that hold the k best ids, ties included, and the least score of these; None, if there are fewer."""
    if len(rows) > k:
        high = np.sort(got[np.argpartition(-got, k - 1)[:k]])[0]
        keep = got >= high
        rows, got = rows[keep], got[keep]
    order = np.argsort(-got, kind="stable")
    enough = np.searchsorted(np.cumsum(held[rows[order]]), k)
    if enough >= len(rows):
        return rows, got, None
    least = got[order[enough]]
    keep = got >= least
    return rows[keep], got[keep], int(least)
