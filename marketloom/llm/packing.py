"""Packing into fixed-length sequences: cutting stock by column generation over the length histogram.

A document's ids are cut into whole sequences, at most one half sequence and a rest. The lengths of the
halves and rests, in classes of GRAIN tokens, are the demands of a cutting-stock problem: a linear program over patterns, columns priced
by an unbounded knapsack, solutions rounded down, and what rounding leaves packed first-fit. Only the
histogram (at most LENGTH / 2 / GRAIN rows) and the patterns reach the driver; documents find their place by
their rank within their class.
"""
from __future__ import annotations

import base64
import functools
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import texts
from marketloom.sources.shared import materialize

LENGTH, GRAIN, END_ID = 2048, 4, 1
#: Columns are added until none improves the bound by more than this share.
GAP = 5e-4


@functools.lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str):
    """An encoder over a vocabulary of byte sequences and ranks (the content of a .tiktoken file)."""
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer's .json file, which stand for themselves wherever a text contains them."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens", [])
    if any(t.get(k) for t in found for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("an added token that depends on its surroundings")
    return {t["content"]: t["id"] for t in found}


@functools.lru_cache(maxsize=2)
def splitter(contents: frozenset[str]) -> re.Pattern | None:
    """Finds the added tokens, of those that begin at one place the longest."""
    return re.compile("(" + "|".join(re.escape(c) for c in sorted(contents, key=lambda c: (-len(c), c))) + ")") if contents else None


def token_bytes(text: str, enc, added: dict[str, int] | None = None) -> bytes:
    """The ids as little-endian unsigned 32-bit integers; what lies between added tokens is encoded for itself."""
    cut = splitter(frozenset(added)) if added else None
    if cut is None or not cut.search(text):
        ids = array("I", enc.encode_ordinary(text))
    else:
        ids = array("I")
        for k, part in enumerate(cut.split(text)):
            ids.extend([added[part]] if k % 2 else enc.encode_ordinary(part))
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


def cuts(n: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids. Without the half, texts a little over a half would leave much padding."""
    at = 0
    while at < n:
        size = LENGTH if n - at >= LENGTH else LENGTH // 2 if n - at >= LENGTH // 2 else n - at
        yield at, size
        at += size


def pieces(docs: DataFrame, ranks: bytes, pattern: str, added: dict[str, int]) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, cls, part, rank``: whole sequences are class 0, shorter pieces count their grains.

    ``rank`` counts the pieces of a class within its partition ``part``.
    """
    blob = docs.sparkSession.sparkContext.broadcast(ranks)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoding(blob.value, pattern), TaskContext.get().partitionId()
        seen = [0] * (LENGTH // GRAIN + 1)
        end = END_ID.to_bytes(4, "little")
        for b in batches:
            rows = []
            for k, t in enumerate(b.column(1).to_pylist()):
                ids = token_bytes(t, enc, added) + end
                n = len(ids) // 4
                for a, size in cuts(n):
                    c = 0 if size == LENGTH else -(-size // GRAIN)
                    rows.append((k, a, size, zlib.crc32(ids[4 * a:4 * (a + size)]), n, c, seen[c]))
                    seen[c] += 1
            if rows:
                r = np.array(rows, np.int64).T
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r[0])), *map(pa.array, r[1:6]), pa.array(np.full(r.shape[1], part)), pa.array(r[6])],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "part", "rank"])

    return texts(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls long, part long, rank long")


def knapsack(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, dict[int, int]]:
    """The best value of a pattern, and its items with their numbers: unbounded knapsack by dynamic programming."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for t in range(1, room + 1):
        n = np.searchsorted(sizes, t, side="right")
        best[t] = best[t - 1]
        if n:
            v = best[t - sizes[:n]] + value[:n]
            k = int(v.argmax())
            if v[k] > best[t]:
                best[t], pick[t] = v[k], k
    t, items = room, {}
    while t > 0:
        if pick[t] < 0:
            t -= 1
        else:
            items[int(pick[t])] = items.get(int(pick[t]), 0) + 1
            t -= int(sizes[pick[t]])
    return float(best[room]), items


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP, most: int = 1_500) -> list[tuple[dict[int, int], int]]:
    """Patterns (numbers of each size, by position in ``sizes``) and how often each is used, covering ``demand`` exactly.

    ``sizes`` ascend. Prices are smoothed towards those of the best lower bound so far, which keeps the
    first columns from being wild; columns are added until the bound is within ``gap``. ``most`` bounds the
    simplex steps; stopping early costs padding, never pieces.
    """
    m = len(sizes)
    if not m:
        return []
    basis = [{k: int(room // s)} for k, s in enumerate(sizes.tolist())]
    at = {s: k for k, s in enumerate(sizes.tolist())}
    for s, k in at.items():  # sizes that fill a sequence together make a better start
        j = at.get(room - s)
        if j is not None and s > room - s:
            basis[k if demand[k] <= demand[j] else j] = {k: 1, j: 1}

    def times(items: dict[int, int]) -> np.ndarray:
        """The inverse times a column. Products are sums here: a driver process that has forked may have no BLAS threads left."""
        return (inverse[:, list(items)] * np.array(list(items.values()), float)).sum(axis=1)

    inverse = np.diag([1.0 / items[k] for k, items in enumerate(basis)])
    for k, items in enumerate(basis):  # a pair's column has a second entry, in the row of a size with a column of its own
        for j in items.keys() - {k}:
            inverse[j, k] = -items[j] / items[k] / basis[j][j]
    x = np.maximum((inverse * demand).sum(axis=1), 0)
    best = sizes / room
    bound = float((demand * best).sum())
    for _ in range(most):
        if x.sum() <= bound * (1 + gap):
            break
        price = inverse.sum(axis=0)  # every sequence costs one
        for trial in (0.9 * best + 0.1 * price, price):
            worth, items = knapsack(trial, sizes, room)
            if (demand * trial).sum() / worth > bound:
                bound, best = float((demand * trial).sum() / worth), trial / worth
            if sum(price[k] * n for k, n in items.items()) > 1 + 1e-9:
                break
        else:
            break  # optimal
        step = times(items)
        able = step > 1e-9
        ratio = np.where(able, x / np.where(able, step, 1), np.inf)
        r = int(ratio.argmin())
        if not able[r]:
            break
        took = ratio[r]
        x -= took * step
        x[r] = took
        np.maximum(x, 0, out=x)
        row = inverse[r] / step[r]
        inverse -= np.outer(step, row)
        inverse[r] = row
        basis[r] = items
    rest = demand.astype(np.int64).copy()
    used = []
    for items, n in zip(basis, np.floor(x + 1e-9).astype(np.int64).tolist(), strict=True):
        n = min([n, *(int(rest[k]) // c for k, c in items.items())])
        if n > 0:
            used.append((items, n))
            for k, c in items.items():
                rest[k] -= n * c
    return used + first_fit(sizes, rest, room)


def first_fit(sizes: np.ndarray, rest: np.ndarray, room: int) -> list[tuple[dict[int, int], int]]:
    """Each sequence takes the largest pieces that still fit; equal sequences are one pattern."""
    used, rest = [], rest.copy()
    while rest.any():
        left, items = room, {}
        for k in range(len(sizes) - 1, -1, -1):
            n = int(min(rest[k], left // sizes[k]))
            if n:
                items[k] = n
                left -= n * int(sizes[k])
        times = min(int(rest[k]) // n for k, n in items.items())
        for k, n in items.items():
            rest[k] -= times * n
        used.append((items, times))
    return used


def places(classes: np.ndarray, used: list[tuple[dict[int, int], int]], first: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By class: the rank at which each pattern begins, its pieces of the class per sequence, and its first sequence."""
    at: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    for items, times in used:
        for k, n in items.items():
            c = int(classes[k])
            rows.setdefault(c, []).append((at.get(c, 0), n, first))
            at[c] = at.get(c, 0) + n * times
        first += times
    return {c: tuple(np.array(r, np.int64).T) for c, r in rows.items()}


def pack(docs: DataFrame, ranks: bytes, pattern: str, added: dict[str, int] | None = None) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: every id of every document in one piece.

    A null or empty text is the end id alone. Repeated rows are packed each for itself. Extra columns are
    ignored; an empty table gives an empty result.
    """
    cut = materialize(pieces(docs, ranks, pattern, added or {}), "packing-pieces")
    counts = cut.groupBy("cls", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("cls", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    demand = {r["cls"]: r["n"] for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect()}  # at most LENGTH / 2 / GRAIN + 1 rows
    classes = np.array(sorted(c for c in demand if c), np.int64)
    used = column_generation(classes, np.array([demand[c] for c in classes.tolist()], float), LENGTH // GRAIN)
    plan = places(classes, used, demand.get(0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, rank = b["cls"].to_numpy(), b["rank"].to_numpy() + b["base"].to_numpy()
            sequence, slot = rank.copy(), np.zeros_like(rank)
            for k in np.unique(c[c > 0]).tolist():
                mine = np.flatnonzero(c == k)
                starts, per, first = plan[k]
                p = np.searchsorted(starts, rank[mine], side="right") - 1
                inside = rank[mine] - starts[p]
                sequence[mine], slot[mine] = first[p] + inside // per[p], inside % per[p]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(sequence), pa.array(slot)], names=[*b.schema.names[:6], "sequence_id", "slot"])

    ranked = cut.join(base, ["cls", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "rank", "base")
    placed = ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls long, sequence_id long, slot long")
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("cls"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.filter("cls = 0").withColumn("offset", F.lit(0).cast("long"))
    parts = placed.filter("cls > 0").withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0).cast("long")))
    return whole.unionByName(parts).drop("cls", "slot")


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def pack_default(spark: SparkSession, docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """With the public 50k byte-level BPE; ``path`` is its file of ranks, ``tokenizer`` the .json file of the same vocabulary with its added tokens."""
    import public_tokenizers

    added = added_tokens(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return pack(docs, vocabulary(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, added)
