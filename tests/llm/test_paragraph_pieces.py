"""Texts are cut and pairs compared many at a time, with the results of one at a time."""
from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from marketloom.llm import paragraphs as P
from marketloom.llm.common import mix, words
from marketloom.sources.shared import CLEANUP, materialize


def cut_alone(text: bytes) -> tuple[list[int], list[tuple[int, int, int]]]:
    """First words of all paragraphs of a text, and bounds and hash of those that have a shingle."""
    h = [int.from_bytes(xxhash.xxh64_digest(w), "little") for w in words(text)]
    many = lambda x: int(mix(np.array([x % 2**64], np.uint64))[0])
    m = [int(x) for x in P.MULTIPLIERS]
    pair = [many(a * m[0] + b * m[1]) for a, b in zip(h, h[1:], strict=False)]
    near = lambda k, d: pair[max(0, k - P.REACH):k] if d < 0 else pair[k + 1:k + 1 + P.REACH]
    starts = [0] if h else []
    starts += [k for k in range(1, len(pair)) if all(pair[k] < x for x in near(k, -1)) and all(pair[k] <= x for x in near(k, 1))]
    shingle = lambda k: many(sum(x * y for x, y in zip(h[k:k + P.SHINGLE], m, strict=True)))
    bounds = [(a, b) for a, b in zip(starts, [*starts[1:], len(h)], strict=False) if b - a >= P.SHINGLE]
    return starts, [(a, b, many(sum(shingle(k) for k in range(a, b - P.SHINGLE + 1)))) for a, b in bounds]


def extents_alone(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    def equal(x, y):
        return next((k for k, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))

    i = j = equal(a, b)
    lost, out = 0, [(i, i, 0)]
    for _ in range(P.CROSSINGS):
        more, _, x, y = max((equal(a[i + x:], b[j + y:]), -max(x, y), x, y) for x in range(P.CHANGED + 1) for y in range(P.CHANGED + 1) if x or y)
        if more < P.SHINGLE:
            break
        i, j, lost = i + x + more, j + y + more, lost + P.SHINGLE - 1 + max(x, y)
        out.append((i, j, lost))
    return out


@pytest.fixture
def odd_texts():
    rng = random.Random(11)
    texts = ["", " ", "a", "\n a b ", "A b C d", "a b c d e", "x " * 700, "\x0b\x0ca\x85b \x1cc É e f g", "", ""]
    texts += [" ".join(rng.choice("abcdefgh") + rng.choice(("", "É", "\x00")) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    return texts + ["".join(rng.choice("aB é\t\n\x0b\x0c\r\x1c\x1f\x85 ") for _ in range(rng.randint(0, 60))) for _ in range(80)] + [""]


@pytest.mark.parametrize("piece", [1, 100, 4_000_000])
def test_texts_cut_together_are_cut_alike(odd_texts, monkeypatch, piece):
    monkeypatch.setattr(P, "PIECE", piece)
    seen = 0
    for row, column in P.pieces(pa.array(odd_texts)):
        assert row == seen
        seen += len(column)
        every, (c, _, names) = P.cut_texts(column), P.paragraphs(column)
        for k, t in enumerate(column.to_pylist()):
            starts, bounds = cut_alone(t.encode())
            own = c.text == k
            assert (every.starts[every.text == k] - every.begin[k]).tolist() == starts
            assert list(zip((c.starts[own] - c.begin[k]).tolist(), (c.ends[own] - c.begin[k]).tolist(), names[own].tolist(), strict=True)) == bounds
    assert seen == len(odd_texts) and not list(P.pieces(pa.array([], pa.string())))


def test_work_outside_the_words_does_not_grow_with_texts(monkeypatch):
    calls = []
    monkeypatch.setattr(P, "mix", lambda x: calls.append(len(x)) or mix(x))
    counts = []
    for texts in (["one two three four five six seven"], [f"one two three four five six seven {k}" for k in range(500)]):
        calls.clear()
        P.paragraphs(pa.array(texts))
        counts.append(len(calls))
    assert counts[0] == counts[1] == 3  # pairs, shingles, names


def test_pairs_compared_together_are_compared_alike(monkeypatch):
    monkeypatch.setattr(P, "MATRIX", 3000)
    rng = random.Random(2)
    pairs = [([], []), ([], [1]), (list(range(400)), [*range(150), -1 % 2**32, *range(151, 400)])]
    for _ in range(400):
        a = [rng.choice((rng.randrange(3), rng.randrange(2**32))) for _ in range(rng.randint(0, 70))]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            k = rng.randint(0, len(b))
            b[k:k + rng.randint(0, 3)] = [rng.randrange(4) for _ in range(rng.randint(0, 3))]
        pairs.append((a, b[:rng.randint(0, 90)]))
    n, rows = P.all_extents(*([np.array(x, np.uint32).tobytes() for x in side] for side in zip(*pairs, strict=True)))
    got = iter(map(tuple, rows.tolist()))
    assert [[next(got) for _ in range(k)] for k in n.tolist()] == [extents_alone(a, b) for a, b in pairs]
    assert len(P.all_extents([], [])[0]) == 0


def test_digests_are_those_of_the_library():
    rng = random.Random(1)
    known = ["".join(rng.choice("abcé漢x0") for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["", "x" * 31, "x" * 32, "x" * 500]
    for array in (pa.array(known), pa.array(known, pa.large_string()), pa.array(known).slice(7, 900), pa.array([], pa.string()), pa.array([""])):
        assert P.digests(array).tobytes() == b"".join(xxhash.xxh64_digest(w.encode()) for w in array.to_pylist())


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    setting = spark.conf.get(CLEANUP)
    rows = materialize(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "clean")
    assert rows.count() == 7 and spark.conf.get(CLEANUP) == setting
    assert tracker.shuffleStatuses().size() <= before + 1  # the count's own; the write's are gone
