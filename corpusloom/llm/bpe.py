"""Operator 9: byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (one slot a token, no collisions, no empty slots) resolves whole
pre-tokens that are themselves tokens; the slot's token is compared, so a stranger is never taken for a member. Tier
two, for the rest: merges by rank through a heap over a doubly linked list of bytes, O(n log n) in a pre-token's
length.

The vocabulary is read by the driver and sent to the workers as bytes; its size is fixed by the tokenizer. A worker
remembers the encodings of at most `CACHE` pre-tokens. Ids are decoded by gathering token bytes, not by keeping texts.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 400_000
_MASK = (1 << 64) - 1
_BUILT: dict = {}


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class PerfectHash:
    """Minimal perfect hash by hash and displace: keys fall into buckets, the fullest first, and each bucket gets the
    first displacement that sends all its keys to free slots; buckets of one key are given a free slot outright."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = m = max(1, n // 3)
        codes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(codes)) < n:
            raise ValueError("two keys share a 64-bit code")
        where = (codes >> np.uint64(40)) % np.uint64(m)
        order = np.argsort(where, kind="stable")
        starts = np.searchsorted(where[order], np.arange(m + 1, dtype=np.uint64))
        self.shift = np.zeros(m, np.int64)
        self.keys: list[bytes | None] = [None] * n
        self.values = np.zeros(n, np.int64)
        free = np.ones(n, bool)
        sizes = np.diff(starts)
        spare = None
        for b in np.argsort(-sizes, kind="stable"):
            own = order[starts[b] : starts[b + 1]]
            if len(own) == 0:
                break
            if len(own) == 1:
                spare = iter(np.flatnonzero(free)) if spare is None else spare
                slots, self.shift[b] = np.array([next(spare)]), 0
                self.shift[b] = -int(slots[0]) - 1
            else:
                d = 0
                while True:
                    slots = self._slots(codes[own], d)
                    if free[slots].all() and len(np.unique(slots)) == len(own):
                        break
                    d += 1
                self.shift[b] = d
            free[slots] = False
            for i, s in zip(own, slots, strict=True):
                self.keys[s], self.values[s] = keys[i], i

    def _slots(self, codes: np.ndarray, d: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (codes ^ np.uint64(d * 0x9E3779B97F4A7C15 & _MASK)) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(29)) % np.uint64(self.n)).astype(np.int64)

    def __call__(self, key: bytes) -> int:
        """The key's number, or -1."""
        code = xxhash.xxh3_64_intdigest(key)
        d = int(self.shift[(code >> 40) % self.buckets])
        slot = -d - 1 if d < 0 else ((((code ^ (d * 0x9E3779B97F4A7C15 & _MASK)) * 0xBF58476D1CE4E5B9 & _MASK) >> 29) % self.n)
        return int(self.values[slot]) if self.keys[slot] == key else -1


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: always the pair with the lowest rank, leftmost first, by a heap over linked bytes."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if after[i] <= n else n
        if end[i] < 0 or j >= n or end[j] != stop:  # one side has changed since
            continue
        end[i], end[j], after[i] = stop, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        tokens = sorted(ranks, key=ranks.get)
        self.member, self.member_ids = PerfectHash(tokens), [ranks[t] for t in tokens]
        table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            table[i] = token
        self.sizes = np.array([len(t) for t in table])
        self.starts = np.cumsum([0, *self.sizes[:-1]])
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.known: dict[str, str] = {}

    def word(self, text: str) -> list[int]:
        data = text.encode("utf-8", "replace")
        at = self.member(data)
        return [self.member_ids[at]] if at >= 0 else merge(data, self.ranks)

    def encode_to_text(self, text: str) -> str:
        """Decimal ids joined by spaces."""
        known, words = self.known, self.find(text)
        try:
            return " ".join([known[w] for w in words])
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = " ".join(map(str, self.word(w)))
            return " ".join([known[w] for w in words])

    def encode(self, text: str) -> np.ndarray:
        return as_ids(self.encode_to_text(text))

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        total = int(sizes.sum())
        if not total:
            return b""
        jump = np.repeat(self.starts[ids] - np.cumsum(sizes) + sizes, sizes)
        return self.bytes[np.arange(total) + jump].tobytes()


def as_ids(text: str) -> np.ndarray:
    return np.fromstring(text, np.int64, sep=" ") if text else np.zeros(0, np.int64)


def codec(data: bytes, pattern: str) -> Codec:
    """One per worker and vocabulary."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Codec(read_ranks(data), pattern)
    return _BUILT[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves
    as `ids` (little-endian unsigned 32-bit) if asked for.

    Null counts as empty; an empty text has no tokens and the digests of no bytes. Texts are encoded whole, one at a
    time, whatever their length; repeated rows and rows without doc_id each; an empty table gives no rows. Other columns,
    whatever they are called, are not read.
    """
    spark = docs.sparkSession
    data = spark.sparkContext.broadcast(read_vocabulary(vocabulary))  # a fixed file of a tokenizer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(data.value, pattern)
        for batch in batches:
            n, by_ids, by_bytes, raw = [], [], [], []
            for cell in batch.column("text"):
                said = own.encode_to_text(cell.as_py() or "")
                ids = as_ids(said)
                n.append(len(ids))
                by_ids.append(hashlib.sha256(said.encode()).hexdigest())
                by_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if with_ids:
                    raw.append(ids.astype("<u4").tobytes())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(by_ids), pa.array(by_bytes)] + [pa.array(raw, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
