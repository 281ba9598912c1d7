"""Embedding whitening: exact integer moments, spectral divide and conquer by polar decompositions, broadcast projection."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.sources.shared import materialize

#: Components that a row is whitened to, and the scale that turns an entry into an integer.
COMPONENTS, SCALE = 4, 256
#: An eigenvalue below this share of the trace is rounding: its component has no scale, its whitened values are null.
RANK = 1e-12
#: Rows of partial sums meet in this many tasks before the last one.
FAN_IN = 32


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix: dynamically weighted Halley steps, by QR while the weights are large, then by Cholesky."""
    n = len(a)
    one = np.eye(n)
    x = a / np.linalg.norm(a)
    low = np.finfo(float).eps / 2
    for _ in range(40):
        s = low * low
        d = np.cbrt(4 * (1 - s) / (s * s)) if s < 1 else 0.0
        g = np.sqrt(1 + d)
        wa = g + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - s) / (s * g), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.concatenate([np.sqrt(wc) * x, one]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            c = np.linalg.cholesky(one + wc * (x.T @ x))
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(c.T, np.linalg.solve(c, x.T)).T
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(low * (wa + wb * s) / (1 + wc * s), 1.0)
        if moved < 1e-15 * n and low > 1 - 1e-15:
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the invariant subspaces above and below a shift between the least and the greatest eigenvalue.

    The mean eigenvalue lies between them. A shift that meets an eigenvalue leaves no projector; then the next one is tried.
    """
    n = len(a)
    mean = np.trace(a) / n
    width = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    best = None
    for nudge in (0.0, 0.11, -0.11, 0.23, -0.23, 0.37, -0.37, 0.05, -0.05):
        u = polar(a - (mean + nudge * width) * np.eye(n))
        projector = (u + np.eye(n)) / 2
        rank = int(round(np.trace(projector)))
        fault = np.linalg.norm(u @ u - np.eye(n))
        if not 0 < rank < n:
            continue
        up, down = subspace(projector, rank)
        rest = np.linalg.norm(down.T @ a @ up)
        if best is None or rest < best[0]:
            best = (rest, up, down)
        if fault < 1e-12 * n and rest < 1e-13 * np.linalg.norm(a) * n:
            break
    if best is None:
        raise ArithmeticError("no shift divides the spectrum")
    return best[1], best[2]


def subspace(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Bases of range and null space of ``projector``: subspace iteration from its columns of most weight, then a full QR."""
    n = len(projector)
    rng = np.random.default_rng(7)
    basis = projector[:, np.argsort(-np.diag(projector), kind="stable")[:rank]]
    for _ in range(4):
        q, r = np.linalg.qr(projector @ basis)
        if np.abs(np.diag(r)).min() < 1e-3:  # dependent columns: begin with random ones, which a projector keeps apart
            q, _ = np.linalg.qr(projector @ rng.standard_normal((n, rank)))
        basis = q
    whole, _ = np.linalg.qr(np.concatenate([basis, (np.eye(n) - projector) @ rng.standard_normal((n, n - rank))], axis=1))
    return basis, whole[:, rank:]


def leading_components(a: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues, falling, with unit eigenvectors as rows.

    Recursion divides the upper subspace first and leaves a lower one whole once enough components are above it.
    """
    size = np.linalg.norm(a)

    def divide(block: np.ndarray, basis: np.ndarray, need: int) -> list[tuple[float, np.ndarray]]:
        n = len(block)
        if n == 1:
            return [(float(block[0, 0]), basis[:, 0])]
        if np.linalg.norm(block - np.trace(block) / n * np.eye(n)) <= 4 * n * np.finfo(float).eps * size:  # one eigenvalue n times
            return [(float(block[k, k]), basis[:, k]) for k in range(n)]
        up, down = split(block)
        found = divide(symmetric(up.T @ block @ up), basis @ up, need)
        if len(found) < need:
            found += divide(symmetric(down.T @ block @ down), basis @ down, need - len(found))
        return found

    pairs = divide(symmetric(a), np.eye(len(a)), min(wanted, len(a)))
    vectors = np.array([v / np.linalg.norm(v) for _, v in pairs])
    values = np.einsum("ki,ij,kj->k", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")[:wanted]
    vectors = vectors[order]
    sign = np.sign(vectors[np.arange(len(order)), np.abs(vectors).argmax(axis=1)])
    return values[order], vectors * np.where(sign == 0, 1, sign)[:, None]


def symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def integers(embeddings: DataFrame, vector: str) -> DataFrame:
    """``vec_id, x``: rows that take part, each entry c as floor(256 c)."""
    v = F.col(vector).cast("array<double>")
    sound = v.isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return embeddings.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c * SCALE).cast("long")).alias("x")).where(F.size("x") > 0)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def moments(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension; a partition sends one number a dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0), d)
                exact = x if abs(int(x.max())) + abs(int(x.min())) < 2 ** 62 // len(x) else x.astype(object)
                n, total = n + len(x), [t + int(s) for t, s in zip(total, exact.sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(v) for v in (n, *total)])], names=["i", "v"])

    sums = fit.select("x").mapInArrow(run, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v")).collect()  # d + 1 numbers
    at = {r["i"]: int(r["v"]) for r in sums}
    return at.get(-1, 0), [at.get(i, 0) for i in range(d)]


def covariance(fit: DataFrame, n: int, mean: np.ndarray) -> DataFrame:
    """One row with the bytes of the covariance, divisor ``n``: products of centred vectors, summed by partition, then in a tree."""
    d = len(mean)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros((d, d)), False
        for b in batches:
            if b.num_rows:
                c = matrix(b.column(0), d) - mean
                total, any_ = total + c.T @ c, True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros((d, d)), False
        for b in batches:
            for m in b.column(0).to_pylist():
                total, any_ = total + np.frombuffer(m).reshape(d, d), True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = fit.select("x").mapInArrow(products, "m binary")
    return parts.repartition(FAN_IN).mapInArrow(add, "m binary").repartition(1).mapInArrow(add, "m binary")


def components_of(fit: DataFrame, n: int, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, eigenvectors and trace; a task decomposes the matrix and sends COMPONENTS vectors to the driver."""
    d = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.column(0).to_pylist():
                a = symmetric(np.frombuffer(m).reshape(d, d) / n)
                values, vectors = leading_components(a) if a.any() else (np.zeros(min(d, COMPONENTS)), np.eye(d)[:COMPONENTS])
                yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(vectors).tobytes()], pa.binary()), pa.array([float(np.trace(a))])], names=["e", "u", "t"])

    row = covariance(fit, n, mean).mapInArrow(run, "e binary, u binary, t double").first()
    return np.frombuffer(row["e"]), np.frombuffer(row["u"]).reshape(-1, d), row["t"]


def whiten(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, one row for each row that takes part and component.

    Rows with a null vector or a null, infinite or not-a-number entry take no part, nor do empty vectors, nor vectors
    of another length than the most frequent one (of equals the longest). Repeated rows and ids stay, each with its
    rows; the fit list has each integer vector once. A null ``vec_id`` stays null. ``deviation`` is null beyond the
    range of a long. A component whose eigenvalue is no more than rounding of the trace has null ``whitened`` and
    doesn't count in ``identity_error``, which is then the largest error among the others (0 if there are none);
    ``explained`` is null if the trace is 0. Fewer dimensions than components give as many rows as there are
    dimensions. An empty table gives an empty result; extra columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = integers(embeddings, vector)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    d = lengths[0]["d"]
    rows = rows.where(F.size("x") == d)
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    n, sums = moments(fit, d)
    mean = np.array([s // n + (s % n) / n for s in sums])
    values, vectors, trace = components_of(fit, n, mean)
    live = [bool(e > RANK * trace and trace > 0) for e in values]
    scale = np.array([1 / np.sqrt(e) if ok else 0.0 for e, ok in zip(values, live, strict=True)])
    explained = [float(e / trace) if trace > 0 else None for e in values]
    k = len(values)

    def project(x: np.ndarray) -> np.ndarray:
        return np.einsum("ij,kj->ik", x - mean, vectors) * scale

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = project(matrix(b.column(0), d))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, j]) for j in range(k)], names=[f"w{j}" for j in range(k)])

    pairs = [(i, j) for i in range(k) for j in range(i, k) if live[i] and live[j]]
    error = 0.0
    if pairs:
        w = fit.select("x").mapInArrow(fitted, ", ".join(f"w{j} double" for j in range(k)))
        got = w.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)

    total = np.array(sums, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            x = matrix(b.column(1), d)
            most = max(abs(int(x.max())), abs(int(x.min()))) * n + max(abs(s) for s in sums)
            if most * most * d < 2 ** 63:
                deviation = ((x * n - total.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [v if v < 2 ** 63 else None for v in ((x.astype(object) * n - total) ** 2).sum(axis=1).tolist()]
            w = project(x)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.asarray(b.column(0).fill_null(0)), k), pa.int64(), mask=np.repeat(np.asarray(b.column(0).is_null()), k)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array([n] * (m * k), pa.int64()),
                pa.array([v for v in deviation for _ in range(k)], pa.int64()), pa.array(w.reshape(-1), mask=np.tile(~np.array(live), m)),
                pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64())], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, schema)
