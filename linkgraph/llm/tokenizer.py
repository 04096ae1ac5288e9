"""Encoding by a public byte-level BPE, in two tiers.

Texts are cut into pre-tokens. A pre-token that is a whole entry of the vocabulary is resolved by a
minimal perfect hash over the vocabulary; any other is merged on a linked list of its bytes, with a
heap that always yields the leftmost pair of lowest rank. The vocabulary has a fixed size, so it is
broadcast; texts of any length stream through in Arrow batches.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the rank file lies; a parameter of every entry point.
RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern of the public vocabulary.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens remembered by a worker, and the longest one worth remembering; bounds its memory.
CACHE_ENTRIES, CACHE_LENGTH = 200_000, 64

_STEP, _MIX, _ALL = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xFFFFFFFFFFFFFFFF


def load_ranks(path: str = RANKS_PATH) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys, n slots, one probe and one comparison.

    Keys fall into buckets; a bucket of several keys gets the first displacement that sends all of
    them to free slots, a bucket of one key names its slot.
    """

    def __init__(self, entries: dict[bytes, int]):
        keys = list(entries)
        self.n = len(keys)
        self.buckets = max(1, self.n // 3)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        at = (h % np.uint64(self.buckets)).astype(np.int64)
        free = np.ones(self.n, bool)
        slot_of = np.empty(self.n, np.int64)
        move = np.zeros(self.buckets, np.int64)
        order = np.argsort(at, kind="stable")
        names, starts, counts = np.unique(at[order], return_index=True, return_counts=True)
        singles = []
        for i in np.argsort(-counts, kind="stable"):
            members = order[starts[i] : starts[i] + counts[i]]
            if counts[i] == 1:
                singles.append((names[i], members[0]))
                continue
            base = 0
            while True:
                tries = np.arange(base, base + 64)
                with np.errstate(over="ignore"):
                    x = h[members, None] + tries.astype(np.uint64) * np.uint64(_STEP)
                    slots = (((x ^ x >> np.uint64(29)) * np.uint64(_MIX) >> np.uint64(20)) % np.uint64(self.n)).astype(np.int64)
                good = free[slots].all(axis=0) & (np.diff(np.sort(slots, axis=0), axis=0) > 0).all(axis=0)
                if good.any():
                    j = int(np.argmax(good))
                    move[names[i]] = tries[j]
                    slot_of[members] = slots[:, j]
                    free[slots[:, j]] = False
                    break
                base += 64
        for (bucket, member), slot in zip(singles, np.flatnonzero(free), strict=True):
            move[bucket] = -1 - slot
            slot_of[member] = slot
        self.move = move.tolist()
        self.keys: list[bytes] = [b""] * self.n
        self.values = [0] * self.n
        for k, s in zip(keys, slot_of.tolist(), strict=True):
            self.keys[s], self.values[s] = k, entries[k]

    def get(self, key: bytes) -> int:
        """The value of key, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.move[h % self.buckets]
        if d < 0:
            s = -1 - d
        else:
            x = h + d * _STEP & _ALL
            s = ((x ^ x >> 29) * _MIX & _ALL) >> 20
            s %= self.n
        return self.values[s] if self.keys[s] == key else -1


class BytePairEncoder:
    """Ids of texts by a byte-level BPE given as ranks; every single byte must have a rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = PerfectHash(ranks)
        self.longest = max(map(len, ranks))
        self.find = regex.compile(PRE_TOKEN).findall
        self.cache: dict[str, tuple[int, ...]] = {}

    def state(self) -> tuple:
        """Plain data from which an executor sets up the same encoder without building the hash."""
        t = self.table
        return t.n, t.buckets, t.move, t.keys, t.values, self.longest

    @classmethod
    def of_state(cls, state: tuple) -> BytePairEncoder:
        self, t = cls.__new__(cls), PerfectHash.__new__(PerfectHash)
        t.n, t.buckets, t.move, t.keys, t.values, self.longest = state
        self.table, self.find, self.cache = t, regex.compile(PRE_TOKEN).findall, {}
        return self

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token by merging its bytes, lowest rank first, leftmost first."""
        n, get, longest = len(piece), self.table.get, self.longest
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # of the symbol that starts here; 0 once it is merged away
        heap = []
        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) >= 0:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if j >= n or end[j] != stop or not end[i]:
                continue  # one of the two has changed since
            end[i], end[j] = stop, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if end[k] - i <= longest and (r := get(piece[i : end[k]])) >= 0:
                    heapq.heappush(heap, (r, i, end[k]))
            if (p := before[i]) >= 0 and stop - p <= longest and (r := get(piece[p:stop])) >= 0:
                heapq.heappush(heap, (r, p, stop))
        ids, i = [], 0
        while i < n:
            ids.append(get(piece[i : end[i]]))
            i = after[i]
        return ids

    def piece(self, text: str) -> tuple[int, ...]:
        raw = text.encode()
        whole = self.table.get(raw) if len(raw) <= self.longest else -1
        ids = (whole,) if whole >= 0 else tuple(self.merge(raw))
        if len(text) <= CACHE_LENGTH:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty list for an empty and for a null text."""
        out: list[int] = []
        if text:
            known, piece = self.cache, self.piece
            for p in self.find(text):
                out.extend(known.get(p) or piece(p))
        return out


def _shared(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(BytePairEncoder(load_ranks(path)).state())


def encode_column(df: DataFrame, key: str, text: str, path: str = RANKS_PATH) -> DataFrame:
    """key and ids ARRAY<INT> of each row; an empty list for an empty and for a null text."""
    encoder = _shared(df, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = BytePairEncoder.of_state(encoder.value)
        for b in batches:
            lists = [bpe.encode(t) for t in b.column(1).to_pylist()]
            flat = np.fromiter((i for x in lists for i in x), np.int32, count=sum(map(len, lists)))
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def count_column(df: DataFrame, text: str, keep: list[str], path: str = RANKS_PATH) -> DataFrame:
    """The columns keep and n_tokens BIGINT of each row's text; 0 for an empty and for a null text."""
    encoder = _shared(df, path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = BytePairEncoder.of_state(encoder.value)
        for b in batches:
            n = pa.array([len(bpe.encode(t)) for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], names=[*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text)).mapInArrow(count, f"{kinds}, n_tokens bigint")
