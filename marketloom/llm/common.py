"""Helpers shared by the text operators: tables, words, groups in sorted streams, links and components."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.sources.shared import materialize

#: Words of every word-based operator: runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, whatever other columns there are; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Words of UTF-8 text with A-Z in lower case; ``bytes.split`` cuts at exactly the separators of ``WORD``."""
    return text.lower().split()


def text_key() -> Column:
    """Tells rows of one ``doc_id`` with different texts apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a stream sorted by ``keys``: a table and the rows at which its groups begin, its end included.

    Only the last group of a batch waits for the next batch, so memory is bounded by a batch and a group.
    """
    waiting: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([waiting, now]).combine_chunks() if waiting is not None else now
        if not now.num_rows:
            continue
        new = np.zeros(now.num_rows - 1, bool)
        for k in keys:
            v = now[k].to_numpy()
            new |= v[1:] != v[:-1]
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        if len(starts) > 1:
            yield now.slice(0, starts[-1]), starts
        waiting = now.slice(starts[-1])
    if waiting is not None and waiting.num_rows:
        yield waiting, np.array([0, waiting.num_rows])


Link = Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]]


def bucket_links(rows: DataFrame, link: Link, cap: int = 4000) -> DataFrame:
    """Edges ``u, v`` between members of a bucket. ``rows``: ``key``, ``id`` (both long) and what ``link`` reads.

    ``link`` gets whole units and returns a spanning forest of the links inside each, so the output is
    linear in the members. A bucket over ``cap`` members is dealt into blocks, and each pair of blocks is
    a unit of its own: no task ever holds more than two blocks, and every pair of members meets.
    """
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / cap).cast("int")
    sized = rows.join(sizes, "key").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("mine")))
    units = (sized.withColumn("other", F.explode(others))
             .withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
             .drop("n", "blocks", "mine", "other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, starts in sorted_groups(batches, ["key", "low", "high"]):
            u, v = link(unit, starts)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return units.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "id").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """``node, root`` of every node with an edge ``u, v``; the root is the smallest node of its component.

    Alternating large-star and small-star steps until the edges no longer change; each round is written
    to the shared folder, and only a count and a checksum reach the driver.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), purpose)
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(small, purpose)
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def spread(n: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, the same everywhere (splitmix64 of 1, 2, ...)."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``x`` with ``a x = b`` by elimination with row pivots. No BLAS: a driver process that has forked may have lost its threads."""
    m = np.concatenate([a, b[:, None]], axis=1)
    n = len(a)
    for k in range(n):
        p = k + int(np.abs(m[k:, k]).argmax())
        m[[k, p]] = m[[p, k]]
        m[k] /= m[k, k]
        rest = m[k + 1:, k].copy()
        m[k + 1:] -= rest[:, None] * m[k]
    x = m[:, n].copy()
    for k in range(n - 1, 0, -1):
        x[:k] -= m[:k, k] * x[k]
    return x
