"""Byte-level BPE encoding and decoding.

Two tiers: a pre-token that is itself in the vocabulary is resolved by a minimal perfect hash; any other is
merged with a heap over a linked list of its bytes. Pre-tokens already resolved are kept in a bounded
table per Python worker, so that the tiers see each word of a partition about once.

The vocabulary is read once, on the driver, from the path given, and broadcast: its size is fixed by the file. Rows
stay in their partitions; nothing is shuffled.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.textbytes import U64, byte_sums, chunks, map_batches, mix, span_hash, utf8

#: Resolved pre-tokens kept by a worker, and the most characters of one; the table is emptied when full, longer ones are resolved again.
KEPT, KEPT_CHARS = 300_000, 64


def hashes(keys: list[bytes]) -> np.ndarray:
    sizes = np.array([len(k) for k in keys], dtype=np.int64)
    ends = np.cumsum(sizes)
    return span_hash(byte_sums(np.frombuffer(b"".join(keys), np.uint8)), ends - sizes, ends)


class PerfectHash:
    """A minimal perfect hash by displacement: n keys, n slots; a foreign key meets a slot whose key differs."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        h = hashes(keys)
        self.shift = np.zeros(max(1, n // 4), dtype=np.int64)
        bucket = (h % U64(len(self.shift))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(len(self.shift) + 1))
        taken = np.zeros(n, dtype=bool)
        slot_of = np.empty(n, dtype=np.int64)
        singles = []
        for b in np.argsort(-np.diff(edges), kind="stable"):
            own = order[edges[b] : edges[b + 1]]
            if len(own) < 2:
                singles.append((b, own))
                continue
            d = 1
            while True:  # 64 displacements at once
                tries = self._place(h[own][None, :], np.arange(d, d + 64, dtype=np.uint64)[:, None])
                fits = ~taken[tries].any(axis=1)
                if len(own) > 1:
                    s = np.sort(tries, axis=1)
                    fits &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if fits.any():
                    k = int(np.argmax(fits))
                    self.shift[b] = d + k
                    slot_of[own] = tries[k]
                    taken[tries[k]] = True
                    break
                d += 64
        free = iter(np.flatnonzero(~taken))
        for b, own in singles:
            if len(own):
                slot_of[own] = slot = next(free)
                self.shift[b] = -1 - slot
        self.keys: list[bytes] = [b""] * n
        self.values = np.empty(n, dtype=np.int64)
        for rank, slot in enumerate(slot_of):
            self.keys[slot] = keys[rank]
            self.values[slot] = rank

    def _place(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (mix(h + d * U64(0xD6E8FEB86659FD93)) % U64(self.n)).astype(np.int64)

    def ranks(self, keys: list[bytes]) -> list[int]:
        """Each key's rank, or -1 for one that isn't in the set."""
        if not self.n or not keys:
            return [-1] * len(keys)
        h = hashes(keys)
        d = self.shift[(h % U64(len(self.shift))).astype(np.int64)]
        slots = np.where(d < 0, -1 - d, self._place(h, np.maximum(d, 0).astype(np.uint64)))
        return [rank if self.keys[slot] == key else -1 for key, slot, rank in zip(keys, slots.tolist(), self.values[slots].tolist())]


def pair_table(vocabulary: list[bytes], ranks: dict[bytes, int]) -> dict[int, int]:
    """For two adjacent tokens a, b, at key a << 32 | b, the rank of their join where it is a token."""
    pairs = {}
    for joined, r in ranks.items():
        for k in range(1, len(joined)):
            a, b = ranks.get(joined[:k]), ranks.get(joined[k:])
            if a is not None and b is not None:
                pairs[a << 32 | b] = r
    return pairs


_COUNT = list(range(-1, 257))


def merge_bytes(piece: bytes, single: list[int], first: list[int], pairs: dict[int, int], push=heapq.heappush, pop=heapq.heappop) -> list[int]:
    """BPE by a heap of adjacent pairs over a linked list: the lowest rank first, the leftmost of equals.

    A heap entry is rank << 32 | place; first holds the ranks of byte pairs at a << 8 | b, or -1.
    """
    n = len(piece)
    heap = [r << 32 | k for k, (x, y) in enumerate(zip(piece, piece[1:])) if (r := first[x << 8 | y]) >= 0]
    ids = [single[c] for c in piece]
    if not heap:
        return ids
    get = pairs.get
    heapq.heapify(heap)
    after, before = (_COUNT[2 : n + 2], _COUNT[:n]) if n <= 256 else (list(range(1, n + 1)), list(range(-1, n - 1)))
    while heap:
        top = pop(heap)
        k = top & 0xFFFFFFFF
        r = top >> 32
        a = ids[k]
        if a < 0:
            continue
        nxt = after[k]
        if nxt >= n or get(a << 32 | ids[nxt]) != r:
            continue  # one of the two has been merged since
        ids[k] = r
        ids[nxt] = -1
        after[k] = nxt = after[nxt]
        if nxt < n:
            before[nxt] = k
            new = get(r << 32 | ids[nxt])
            if new is not None:
                push(heap, new << 32 | k)
        prev = before[k]
        if prev >= 0:
            new = get(ids[prev] << 32 | r)
            if new is not None:
                push(heap, new << 32 | prev)
    return [i for i in ids if i >= 0]


class Codec:
    """A vocabulary's encoder and decoder, with this worker's table of resolved pre-tokens."""

    def __init__(self, vocabulary: list[bytes], perfect: PerfectHash, pattern: str):
        self.vocabulary, self.perfect = vocabulary, perfect
        ranks = {b: i for i, b in enumerate(vocabulary)}
        self.single = [ranks[bytes([c])] for c in range(256)]
        self.pairs = pair_table(vocabulary, ranks)
        self.first = [self.pairs.get(a << 32 | b, -1) for a in self.single for b in self.single]
        # white space as Unicode has it, whatever the library's own \s
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.kept: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's token ids as packed little-endian unsigned 32-bit integers."""
        pieces = [self.find(t) for t in texts]
        new = set().union(*pieces).difference(self.kept)
        if len(self.kept) + len(new) > KEPT:
            self.kept = {}
            new = set().union(*pieces)
        words = list(new)
        raw = [p.encode() for p in words]
        long = []
        for piece, key, rank in zip(words, raw, self.perfect.ranks(raw)):
            self.kept[piece] = rank.to_bytes(4, "little") if rank >= 0 else array("I", merge_bytes(key, self.single, self.first, self.pairs)).tobytes()
            if len(piece) > KEPT_CHARS:
                long.append(piece)
        known = self.kept.__getitem__
        out = [b"".join(map(known, p)) for p in pieces]
        for piece in long:
            del self.kept[piece]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def _loaded(path: str) -> tuple[list[bytes], PerfectHash]:
    with open(path, "rb") as lines:
        ranked = {int(r): base64.b64decode(t) for t, r in (line.split() for line in lines if line.strip())}
    vocabulary = [ranked[r] for r in range(len(ranked))]
    return vocabulary, PerfectHash(vocabulary)


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(shared, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    key = (shared.id if hasattr(shared, "id") else id(shared), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(*shared.value, pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per row doc_id, n_tokens and ids (binary: packed little-endian uint32) of the whole text.

    vocabulary: path of a rank file, read on the driver; its ranks are 0..n-1. A null text is empty and gives no ids;
    other columns are ignored; repeated rows give repeated rows; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_loaded(vocabulary))

    def run(batches) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            column = batch.column("text")
            _, offs = utf8(column)
            for i, j in chunks(offs):
                ids = codec.encode([t or "" for t in column.slice(i, j - i).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Add `decoded` (binary), the bytes that `ids` stand for; null ids give empty bytes. Keeps all columns."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(_loaded(vocabulary))
    names = [c for c in encoded.columns if c != "decoded"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            _, offs = utf8(batch.column("ids"))
            for i, j in chunks(offs):
                part = batch.slice(i, j - i)
                text = pa.array([codec.decode(x) if x else b"" for x in part.column("ids").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), text], [*names, "decoded"])

    fields = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in names)
    return map_batches(encoded.select(*names), run, f"{fields}, decoded binary")
