"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import as_bytes, solve, texts
from marketloom.sources.shared import materialize

FEATURES = ("log_words", "word_bytes", "upper", "digits", "symbols", "marks", "stops", "lines", "high", "distinct", "repeats", "longest_repeat")
#: Number of random features, width of the Gaussian kernel in standard deviations, ridge, bins of the calibration, partial sums at most.
WIDTH, BANDWIDTH, RIDGE, BINS, PARTS = 256, 3.0, 1e-3, 1000, 64
THRESHOLD = 0.7
#: Rows with this remainder of crc32(doc_id as text) by 4 never teach.
HELD_OUT = 2


def statistics(text: bytes) -> list[float]:
    """FEATURES of a text; all zero without a word."""
    w = text.split()
    if not w:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = max(1, len(text) - int(count[9:14].sum() + count[32]))
    repeats = sum(a == b for a, b in zip(w, w[1:], strict=False))
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())

    def share(marks: bytes) -> float:
        return float(np.sqrt(sum(int(count[m]) for m in marks) / chars))

    lines = int(count[10]) + 1
    return [float(np.log1p(len(w))), float(np.log(chars / len(w))), float(np.sqrt(upper / max(1, upper + lower))), share(b"0123456789"), share(b"#*$%&|<>"), share(b"!?"), share(b".,;:"),
            float(np.sqrt(lines / (lines + len(w)))), float(np.sqrt(count[128:].sum() / chars)), float(np.log(len(set(w))) / np.log(len(w) + 1)), float(np.sqrt(repeats / len(w))),
            float(np.log1p(max(map(len, w))))]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: FEATURES of every whole text, one row per row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return texts(docs).mapInArrow(run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Model:
    """A fitted classifier; ``edges`` and ``levels`` are the calibration's steps. Without teachers every score is ``prior``."""
    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    edges: np.ndarray | None = None
    levels: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(20)
        omega = rng.standard_normal((len(FEATURES), WIDTH)) / BANDWIDTH
        phase = rng.uniform(0, 2 * np.pi, WIDTH)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / WIDTH) * np.cos(z @ omega + phase), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return np.interp(self.raw(x), self.edges, self.levels)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of least weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def matrix(b: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return b[name].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def held_out(remainder: int, of: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == remainder, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """From labelled rows that aren't held out: moments, normal equations and calibration counts are sums over partitions.

    Rows without a doc_id or a label of 0 or 1 don't teach; of repeated labels of an id the largest holds.
    """
    marks = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    taught = materialize(stats.join(marks, "doc_id").filter(~held_out(HELD_OUT, 4)).select("x", "y"), "quality-taught")
    d = len(FEATURES)
    row = taught.agg(F.count(F.lit(1)), F.coalesce(F.avg("y"), F.lit(0.5)), *[f(F.col("x")[k]) for k in range(d) for f in (F.avg, F.stddev_pop)]).first()
    n, prior = row[0], row[1]
    if prior in (0.0, 1.0) or not n:
        return Model(prior)
    base = Model(prior, np.array(row[2::2]), np.maximum(np.array(row[3::2]), 1e-3))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WIDTH + 1, WIDTH + 2))
        for b in batches:
            z = base.features(matrix(b))
            total += z.T @ np.concatenate([z, b["y"].to_numpy()[:, None]], axis=1)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "s"])

    sums = taught.coalesce(PARTS).mapInArrow(equations, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    a = np.zeros((WIDTH + 1, WIDTH + 2))
    for r in sums.toLocalIterator():  # (WIDTH + 1) (WIDTH + 2) numbers, whatever the input
        a[r["i"], r["j"]] = r["s"]
    weights = solve(a[:, :-1] + RIDGE * n * np.eye(WIDTH + 1), a[:, -1])
    model = Model(prior, base.mean, base.scale, weights)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = np.clip(np.floor((model.raw(matrix(b)) + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k), b["y"]], names=["bin", "y"])

    counts = taught.mapInArrow(bins, "bin int, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()  # at most BINS rows
    level = isotonic(np.array([r["y"] for r in counts]), np.array([float(r["n"]) for r in counts]))
    return Model(prior, base.mean, base.scale, weights, (np.array([r["bin"] for r in counts]) + 0.5) / BINS * 2 - 0.5, np.clip(level, 0, 1))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per row of ``docs``, repeated rows and null ids too.

    Null and empty texts have a score like any other, that of all-zero statistics. Without labels of both
    kinds to learn from, every score is the share of label 1 (0.5 without labels). A null doc_id isn't held
    out. Extra columns are ignored; an empty table gives an empty result.
    """
    stats = materialize(document_statistics(docs), "quality-statistics")
    model = fit(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(model.score(matrix(b)))], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(HELD_OUT, 4).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score reaches THRESHOLD. Without labels of both kinds nothing can be told, and all rows stay."""
    model = fit(document_statistics(docs), labels)
    if model.weights is None:
        return docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([statistics(t) for t in as_bytes(b.column(at))])
                yield b.filter(pa.array(model.score(x) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
