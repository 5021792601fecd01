"""Encoding of texts with a public byte-level BPE vocabulary, by this package's own merger.

Each word of the pre-tokenizer is merged on a contiguous array: the array holds the part boundaries and, for each
boundary, the rank of the pair that starts there; the least rank is found by a scan, its right boundary deleted and
the two neighbouring ranks refreshed. Words above ``LONG_WORD`` bytes use a heap over linked boundaries, which
gives the same merges in n log n. Words are merged once per worker while they stay in a bounded memo.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_WORD = 96
MEMO_WORDS = 200_000
NONE = 1 << 60


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """``ids(text)``: token ids of a text; no special tokens, nothing trimmed or normalised, null and empty give []."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        self.words = regex.compile(pattern).findall
        ranks, merge = self.ranks, self.merge

        class Memo(dict):
            def __missing__(self, word: str) -> list[int]:
                raw = word.encode("utf-8")
                one = ranks.get(raw)
                found = [one] if one is not None else merge(raw)
                if len(self) >= MEMO_WORDS:
                    self.clear()
                self[word] = found
                return found

        self.memo = Memo()

    def merge(self, raw: bytes) -> list[int]:
        return self._short(raw) if len(raw) <= LONG_WORD else self._long(raw)

    def _short(self, raw: bytes) -> list[int]:
        rank = self.ranks.get
        at = list(range(len(raw) + 1))
        pair = [rank(raw[i : i + 2], NONE) for i in range(len(raw) - 1)]
        while pair:
            least = min(pair)
            if least == NONE:
                break
            i = pair.index(least)
            del at[i + 1]
            del pair[i]
            if i < len(pair):
                pair[i] = rank(raw[at[i] : at[i + 2]], NONE)
            if i:
                pair[i - 1] = rank(raw[at[i - 1] : at[i + 1]], NONE)
        return [self.ranks[raw[a:b]] for a, b in zip(at, at[1:])]

    def _long(self, raw: bytes) -> list[int]:
        rank, n = self.ranks.get, len(raw)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\x01") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(raw[i : i + 2], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := rank(raw[i : end[stop]], NONE)) != NONE:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := rank(raw[p:stop], NONE)) != NONE:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, out = self.memo, []
        for word in self.words(text):
            out += memo[word]
        return out


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def encoder(path: str, pattern: str) -> ByteBpe:
    """The worker's encoder of this vocabulary, loaded once."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


def encode_batch(bpe: ByteBpe, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of the texts, back to back."""
    flat: list[int] = []
    ends = [0]
    memo, words = bpe.memo, bpe.words
    for text in texts:
        if text:
            for word in words(text):
                flat += memo[word]
        ends.append(len(flat))
    return np.asarray(ends, dtype=np.int64), np.asarray(flat, dtype=np.int32)


def _default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(df: DataFrame, key: str, text: str, path: str | None = None, pattern: str | None = None, out: str = "ids") -> DataFrame:
    """(key, ids array<int>) for every row, by a vocabulary file of ranks (``path``) and its word pattern.

    A null and an empty text give the empty list. Text that looks like a special token is ordinary text. Repeated
    rows stay repeated; other columns are dropped, whatever their names. The input's partitions are kept: no shuffle.
    """
    path, pattern = path or vocabulary_path(), pattern or _default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            ends, ids = encode_batch(bpe, batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, out])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, `{out}` array<int>")
