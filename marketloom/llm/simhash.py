"""SimHash near duplicates: pigeonhole buckets, pivot distance tables, components."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import as_bytes, bucket_links, components, spread, text_key, texts, words
from marketloom.sources.shared import materialize

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Fingerprints at most DISTANCE bits apart agree in at least two of these blocks of bits.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
PIVOTS = 32


def fingerprint(text: bytes) -> int:
    """Majority bits of the XXH64 of each 4-word shingle, repeats included; all words if there are fewer; 0 without a word."""
    w = words(text)
    if not w:
        return 0
    joined, digest = b" ".join(w), xxhash.xxh64_digest
    if len(w) <= SHINGLE:
        hashes = digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1:].tolist(), strict=False)])
    n = len(hashes) // 8
    bits = np.zeros(64, np.int64)
    for k in range(0, n, 8192):
        bits += np.unpackbits(np.frombuffer(hashes, np.uint8)[8 * k:8 * (k + 8192)].reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, fp``: one row per row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([fingerprint(t) for t in as_bytes(b.column(2))], pa.int64())], names=["doc_id", "text_key", "fp"])

    return texts(docs).select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, fp long")


def pivots() -> np.ndarray:
    return spread(PIVOTS)


def near(unit: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in each unit.

    Distances to the pivots are computed once per member. Two members whose distances to any pivot differ
    by more than DISTANCE can't link (triangle inequality); only the others are compared bit by bit.
    """
    x = unit["id"].to_numpy().view(np.uint64)
    far = np.bitwise_count(x[:, None] ^ pivots()[None, :]).astype(np.int8)
    size = np.diff(starts)
    a = starts[:-1][size == 2]
    a = a[(np.abs(far[a] - far[a + 1]) <= DISTANCE).all(axis=1)]
    a = a[np.bitwise_count(x[a] ^ x[a + 1]) <= DISTANCE]
    u, v = [x[a]], [x[a + 1]]
    for s, n in zip(starts[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
        rest = np.arange(s, s + n)
        while len(rest) > 1:
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                at = front.pop()
                maybe = np.flatnonzero((np.abs(far[rest] - far[at]) <= DISTANCE).all(axis=1))
                hit = maybe[np.bitwise_count(x[rest[maybe]] ^ x[at]) <= DISTANCE]
                if len(hit):
                    found = rest[hit]
                    u.append(np.full(len(found), x[at]))
                    v.append(x[found])
                    front.extend(found.tolist())
                    rest = np.delete(rest, hit)
    return np.concatenate(u).view(np.int64), np.concatenate(v).view(np.int64)


def link_classes(prints: DataFrame) -> DataFrame:
    """``fp, root`` of each distinct fingerprint that links to another one."""
    def part(low: int, bits: int):
        return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))

    keys = [F.shiftleft(part(*one), 11).bitwiseOR(part(*two)).bitwiseOR(F.lit(k << 22)) for k, (one, two) in enumerate(combinations(BLOCKS, 2))]
    rows = prints.select("fp").distinct().select(F.explode(F.array(*keys)).alias("key"), F.col("fp").alias("id"))
    return components(bucket_links(rows, near), "simhash-components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, fingerprint, component_id`` for each row of ``docs``.

    Equal fingerprints are one class, found by grouping; only different ones are searched for links.
    Texts without a word, null ones included, have fingerprint zero and link like any other. Repeated rows
    stay and get equal results. ``component_id`` ignores null ids; it is null if a component has no id.
    Extra columns are ignored; an empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs), "simhash-prints")
    roots = link_classes(prints).withColumnRenamed("node", "fp")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = materialize(classes, "simhash-classes")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = classes.join(least, "root").select("fp", "component_id", "root")
    return prints.join(labels, "fp").select("doc_id", "text_key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("root").alias("class"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one of each group: the smallest ``doc_id`` (null last), then text key.

    Identical rows are one document, and one of them stays.
    """
    found = materialize(near_duplicates(docs), "simhash-groups")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    first = found.groupBy("class").agg(F.min(order).alias("k")).select("class", "k.doc_id", "k.text_key")
    keep = materialize(first.select(F.col("doc_id").alias("__keep_id"), F.col("text_key").alias("__keep_key")), "simhash-keep")
    mine = docs.withColumn("__text_key", text_key())
    kept = mine.join(keep, F.col("doc_id").eqNullSafe(F.col("__keep_id")) & (F.col("__text_key") == F.col("__keep_key")), "left_semi")
    repeated = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = repeated.join(keep, repeated.doc_id.eqNullSafe(keep["__keep_id"]) & (repeated.text_key == keep["__keep_key"]), "left_semi")
    if not again.isEmpty():  # shuffles whole rows, so only if rows do repeat
        kept = kept.dropDuplicates(["doc_id", "__text_key"])
    return kept.drop("__text_key")
