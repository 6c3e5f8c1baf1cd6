"""Token ids of whole texts by a public tokenizer, through a bounded memo of its pre-tokens.

The tokenizer of word_bpe_49k.json drops white space, lower-cases, and treats a run of letters and a run of marks as
tokens apart. So words of Latin letters and ASCII marks split into such runs over all bytes at once, equal runs are
found by their hashes and then compared byte by byte, and only runs that the memo lacks go to the library, many at a
time, held apart by a token that none of them can yield. The memo's keys are the runs themselves. Any other word - digits, apostrophes, other letters, control or special tokens - goes to
the library whole. A text's ids are those of its runs in a row.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa

from .textkernel import hash_spans, lower, same_spans, utf8

END = 2
#: Runs and bytes of runs that the memo holds; it starts anew beyond that.
MEMO, MEMO_BYTES = 250_000, 8 << 20
_GAP, _LETTER, _MARK, _OTHER = 0, 1, 2, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, 0x0A]] = _GAP
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = _MARK
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = _LETTER
#: Byte pairs that make a word one of the others: the times and division signs, the dotted capital I, a special token's start.
_PAIRS = (0xC397, 0xC3B7, 0xC4B0, 0x3C7C)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """The file's tokenizer, and its model behind a plain split at spaces, for runs of lower-case ASCII."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(path)
    plain = Tokenizer.from_str(tok.to_str())
    plain.normalizer, plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
    return tok, plain


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    def __init__(self, path: str | None = None):
        self.tok, self.plain = tokenizer(path or default_path())
        assert self.tok.get_vocab_size() <= 1 << 16
        (self.apart,) = self.tok.encode("|", add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.held = 0
        self.pool, self.filled = np.zeros(1 << 16, np.uint16), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _store(self, runs: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at, n = len(self.memo), len(runs)
        while at + n > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.size[at : at + n] = sizes
        self.start[at : at + n] = self.filled + np.cumsum(sizes) - sizes
        self.filled += len(ids)
        keys = [r.encode() for r in runs]
        self.held += sum(map(len, keys))
        self.memo.update(zip(keys, range(at, at + n)))

    def _one_by_one(self, runs: list[str]) -> None:
        ids = [self.tok.encode(r, add_special_tokens=False).ids for r in runs]
        self._store(runs, np.array([i for x in ids for i in x], np.uint16), np.array([len(x) for x in ids], np.int64))

    def _many(self, runs: list[str], tok) -> None:
        """Runs without bars or white space."""
        for at in range(0, len(runs), 10_000):
            part = runs[at : at + 10_000]
            (got,) = tok.encode_batch_fast([" | ".join(part)], add_special_tokens=False)
            ids = np.array(got.ids, np.uint16)
            bar = ids == self.apart
            if bar.sum() != len(part) - 1:
                self._one_by_one(part)
                continue
            edge = np.concatenate([[-1], np.flatnonzero(bar), [len(ids)]])
            self._store(part, ids[~bar], np.diff(edge) - 1)

    def _learn(self, runs: list[str]) -> None:
        """Distinct runs that the memo lacks."""
        sets: dict[str, list[str]] = {"ascii": [], "latin": [], "odd": []}
        for r in runs:
            kind = "odd" if "|" in r or r.split() != [r] else "ascii" if r.isascii() and r.isprintable() and (r.islower() and r.isalpha() or not any(map(str.isalnum, r)) and "'" not in r) else "latin"
            sets[kind].append(r)
        self._many(sets["ascii"], self.plain)
        self._many(sets["latin"], self.tok)
        self._one_by_one(sets["odd"])

    def _index(self, runs: list[bytes]) -> np.ndarray:
        """Places of runs in the memo, which learns those it lacks."""
        get = self.memo.get
        at = np.array([get(r, -1) for r in runs], np.int64)
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self._learn([r.decode() for r in dict.fromkeys(runs[i] for i in new)])
            at[new] = [get(runs[i]) for i in new]
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): all ids in a row (uint16), and where each text's begin, with the end as last; null: no ids."""
        data, offsets = utf8(texts)
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
        kind = _KIND[data]
        pair = data[:-1].astype(np.uint16) << 8 | data[1:]
        for p in _PAIRS:
            kind[:-1][pair == p] = _OTHER
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        gap = kind == _GAP
        # Words with a byte of another kind are one run each.
        starts = np.flatnonzero(~gap & (edge[:-1] | np.concatenate([[True], gap[:-1]])))
        ends = np.flatnonzero(~gap & (edge[1:] | np.concatenate([gap[1:], [True]]))) + 1
        odd = np.concatenate([[0], np.cumsum(kind == _OTHER)])
        odd = odd[ends] > odd[starts]
        whole = np.zeros(len(data) + 1, np.int8)
        whole[starts[odd]] += 1
        whole[ends[odd]] -= 1
        whole = np.cumsum(whole[:-1], dtype=np.int8) > 0
        kind[whole] = _OTHER
        edge[1:-1] |= kind[1:] != kind[:-1]
        edge[0] = edge[-1] = True
        cut = np.flatnonzero(edge)
        starts, ends = cut[:-1], cut[1:]
        real = ~gap[starts]
        starts, ends = starts[real], ends[real]
        low = np.where(whole, data, lower(data))
        first = np.searchsorted(starts, offsets)
        _, where, back = np.unique(hash_spans(low, starts, ends), return_index=True, return_inverse=True)
        if len(self.memo) > MEMO or self.held > MEMO_BYTES:
            self._clear()
        raw = low.tobytes()
        index = self._index([raw[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist())])[back]
        clash = ~same_spans(low, starts, ends, starts[where][back], ends[where][back])
        if clash.any():
            index[clash] = self._index([raw[s:e] for s, e in zip(starts[clash].tolist(), ends[clash].tolist())])
        n = self.size[index]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(self.start[index] - total[:-1], n) + np.arange(total[-1])]
        return ids, total[first]
