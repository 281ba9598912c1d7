"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the others."""
from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from marketloom.llm.common import texts

#: Pre-tokens that a task remembers; more are worked out again.
REMEMBERED = 300_000
#: White space as the tokenizer's own regular expressions define it; Python's ``\s`` has four control characters more.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


def read_ranks(content: bytes) -> dict[bytes, int]:
    """A .tiktoken file: a base64 byte sequence and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


class PerfectHash:
    """Keys to values without a collision and without an empty slot (hash and displace).

    Keys fall into buckets of about four. Each bucket, largest first, gets the seed that sends its keys to
    free slots; a bucket of one key names its slot, as ``-1 - slot``.
    """

    def __init__(self, table: dict[bytes, int]):
        self.n, self.m = len(table), max(1, len(table) // 4)
        buckets: list[list[bytes]] = [[] for _ in range(self.m)]
        for key in table:
            buckets[xxhash.xxh64_intdigest(key) % self.m].append(key)
        self.seeds = array("q", [0]) * self.m
        self.keys: list[bytes | None] = [None] * self.n
        order = sorted(range(self.m), key=lambda b: -len(buckets[b]))
        for b in order:
            if len(buckets[b]) < 2:
                break
            seed = 1
            while True:
                slots = {xxhash.xxh64_intdigest(k, seed) % self.n for k in buckets[b]}
                if len(slots) == len(buckets[b]) and all(self.keys[s] is None for s in slots):
                    break
                seed += 1
            self.seeds[b] = seed
            for k in buckets[b]:
                self.keys[xxhash.xxh64_intdigest(k, seed) % self.n] = k
        free = iter([s for s in range(self.n) if self.keys[s] is None])
        for b in order:
            if len(buckets[b]) == 1:
                slot = next(free)
                self.seeds[b], self.keys[slot] = -1 - slot, buckets[b][0]
        self.values = array("q", [table[k] for k in self.keys])

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        if not self.n:
            return -1
        seed = self.seeds[xxhash.xxh64_intdigest(key) % self.m]
        slot = -1 - seed if seed < 0 else xxhash.xxh64_intdigest(key, seed) % self.n
        return self.values[slot] if self.keys[slot] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the pair of neighbours with the least rank is merged, the leftmost first, until none is known."""
    n = len(piece)
    ends = list(range(1, n + 1))  # of the part that begins here; 0 once it is merged away
    before = list(range(-1, n))  # the part that ends here begins there
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        middle = ends[i]
        if not middle or middle >= n or ends[middle] != end:
            continue  # one of the two has changed since
        ends[i], ends[middle] = end, 0
        if end < n:
            before[end] = i
            far = ends[end]
            if (r := ranks.get(piece[i:far])) is not None:
                heapq.heappush(heap, (r, i, far))
        if i:
            p = before[i]
            if (r := ranks.get(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:ends[i]]])
        i = ends[i]
    return out


class Codec(dict):
    """Pre-tokens and their ids as little-endian unsigned 32-bit integers; looks up or works out what it doesn't hold."""

    def __init__(self, content: bytes, pattern: str):
        super().__init__()
        self.ranks = read_ranks(content)
        self.whole = PerfectHash(self.ranks)
        self.pieces = compiled(pattern).findall
        self.bytes = {v: k for k, v in self.ranks.items()}

    def __missing__(self, token: str) -> bytes:
        piece = token.encode()
        rank = self.whole.get(piece)
        ids = array("I", [rank] if rank >= 0 else merge(piece, self.ranks))
        if sys.byteorder == "big":
            ids.byteswap()
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = out = ids.tobytes()
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        numbers = array("I", ids)
        if sys.byteorder == "big":
            numbers.byteswap()
        return b"".join(map(self.bytes.__getitem__, numbers))


CODECS: dict[tuple[bytes, str], Codec] = {}


def codec(content: bytes, pattern: str) -> Codec:
    """One codec a worker process, kept for its next tasks."""
    key = hashlib.sha1(content).digest(), pattern
    if key not in CODECS:
        CODECS.clear()
        CODECS[key] = Codec(content, pattern)
    return CODECS[key]


def encoded(docs: DataFrame, content: bytes, pattern: str, ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, and ``ids`` (little-endian 32-bit integers) if asked for.

    A null or empty text has no ids and the digests of nothing. Repeated rows get equal rows; extra columns
    are ignored; an empty table gives an empty result. A vocabulary must hold all 256 single bytes.
    """
    blob = docs.sparkSession.sparkContext.broadcast(content)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(blob.value, pattern)
        for b in batches:
            n, first, second, all_ids = [], [], [], []
            for t in b.column(1).to_pylist():
                e = own.encode(t)
                n.append(len(e) // 4)
                first.append(hashlib.sha256(e).hexdigest())
                second.append(hashlib.sha256(own.decode(e)).hexdigest())
                if ids:
                    all_ids.append(e)
            columns = {"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(first, pa.string()), "decoded_sha256": pa.array(second, pa.string())}
            if ids:
                columns["ids"] = pa.array(all_ids, pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if ids else ""))
