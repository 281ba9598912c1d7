"""Window operators over per-key daily series.

A series table holds one row per (key, session), so a window partition is bounded
by the number of sessions of one key (about 25 000 rows per century) however many
raw ticks or trades the key has: raw rows are reduced with combinable aggregates
first.  All windows of one operator share the same partitioning, so Spark plans
one exchange for the whole chain.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from marketloom.functions.scalar import col

UNBOUNDED = Window.unboundedPreceding


def over(keys: list[str] | str = "ticker", order: list[str | Column] | str = "trade_date") -> WindowSpec:
    keys = [keys] if isinstance(keys, str) else keys
    order = [order] if isinstance(order, str) else order
    return Window.partitionBy(*keys).orderBy(*order)


def trailing(n: int, w: WindowSpec, offset: int = 0) -> WindowSpec:
    """The last ``n`` rows ending ``offset`` rows before the current one."""
    return w.rowsBetween(-(n - 1) - offset, -offset)


def canonical_bars(bars: DataFrame, keys: tuple[str, ...] = ("ticker", "trade_date")) -> DataFrame:
    """One bar per key: the manual provider first, else the latest ingested.

    A ``max_by`` aggregate combines map-side, unlike a ``row_number`` window.
    """
    rest = [c for c in bars.columns if c not in keys]
    rank = F.struct((F.col("provider") == "manual").cast("int"), F.col("ingested_at"), F.col("provider"))
    return (bars.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("b"))
            .select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest]))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The whole row with the greatest ordering tuple per key, as a combinable aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[col(o) for o in order])).alias("r"))
            .select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]))


def session_no(w: WindowSpec) -> Column:
    return F.row_number().over(w)


def returns(c: str | Column, n: int, w: WindowSpec) -> Column:
    """close / close n sessions earlier - 1."""
    past = F.lag(col(c), n).over(w)
    return F.when(past != 0, col(c) / past - 1)


def rolling(fn, c: str | Column, n: int, w: WindowSpec, min_periods: int | None = None, offset: int = 0) -> Column:
    """``fn`` over a trailing frame, null until ``min_periods`` values are present."""
    frame = trailing(n, w, offset)
    return F.when(F.count(col(c)).over(frame) >= (min_periods or n), fn(col(c)).over(frame))


def true_range(w: WindowSpec) -> Column:
    prior = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior))


def zscore_vs_prior(c: str, n: int, w: WindowSpec) -> Column:
    """Today against the mean and sample deviation of the prior n rows."""
    prior = trailing(n, w, 1)
    sd = F.stddev_samp(c).over(prior)
    return F.when(sd > 0, (F.col(c) - F.avg(c).over(prior)) / sd)


def ema(df: DataFrame, value: str, out: str, alpha: float, keys: list[str], order: str,
        min_periods: int = 1) -> DataFrame:
    """Recursive exponential mean (first value seeds it) in linear time with built-in windows.

    The recursion is linear, so inside a block of rows it is a scaled prefix sum:
    ema_t = decay^(t+1) * carry + sum(alpha * x_i * decay^(t-i)).  Blocks are sized so
    that ``decay^block`` is about 1e-15; the carry therefore needs only the previous
    block's own sum.  Rows with a null value are skipped by the recursion.
    """
    decay = 1.0 - alpha
    block = max(2, math.ceil(math.log(1e-15) / math.log(decay)))
    w = over(keys, order)
    present = F.col(value).isNotNull()
    n = F.sum(present.cast("int")).over(w.rowsBetween(UNBOUNDED, 0))
    d = df.withColumn("_n", F.when(present, n))
    pos = F.pmod(F.col("_n") - 1, F.lit(block))
    d = d.withColumns({"_b": F.floor((F.col("_n") - 1) / block), "_p": pos})
    scaled = F.when(F.col("_n") == 1, F.col(value)).otherwise(F.col(value) * alpha) * F.pow(F.lit(decay), -F.col("_p"))
    wb = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(UNBOUNDED, 0)
    d = d.withColumn("_s", F.when(present, F.sum(scaled).over(wb) * F.pow(F.lit(decay), F.col("_p"))))
    ended = F.when(F.col("_p") == block - 1, F.col("_s"))
    carry = F.coalesce(F.last(ended, ignorenulls=True).over(w.rowsBetween(UNBOUNDED, -1)), F.lit(0.0))
    result = F.col("_s") + carry * F.pow(F.lit(decay), F.col("_p") + 1)
    return (d.withColumn(out, F.when(F.col("_n") >= min_periods, result))
            .drop("_n", "_b", "_p", "_s"))


def rsi(df: DataFrame, out: str, alpha: float, keys: list[str], order: str, close: str = "close") -> DataFrame:
    """RSI from exponential means of gains and losses; 50 where both are zero."""
    diff = F.col(close) - F.lag(close).over(over(keys, order))
    d = df.withColumns({"_gain": F.greatest(diff, F.lit(0.0)), "_loss": F.greatest(-diff, F.lit(0.0))})
    # greatest() skips nulls, so restore the null of the first session
    d = d.withColumns({c: F.when(diff.isNotNull(), F.col(c)) for c in ("_gain", "_loss")})
    d = ema(ema(d, "_gain", "_g", alpha, keys, order, 2), "_loss", "_l", alpha, keys, order, 2)
    total = F.col("_g") + F.col("_l")
    return (d.withColumn(out, F.when(total == 0, 50.0).otherwise(100 * F.col("_g") / total))
            .drop("_gain", "_loss", "_g", "_l"))


def drawdown(value: str, w: WindowSpec, floor: float | None = None) -> Column:
    """value / running peak - 1, the peak optionally floored at the initial capital."""
    peak = F.max(value).over(w.rowsBetween(UNBOUNDED, 0))
    if floor is not None:
        peak = F.greatest(peak, F.lit(floor))
    return F.when(peak > 0, F.col(value) / peak - 1)


def streak(flag: Column, w: WindowSpec) -> Column:
    """Number of consecutive true rows ending at the current one (gaps and islands)."""
    n = F.row_number().over(w)
    last_break = F.max(F.when(~F.coalesce(flag, F.lit(False)), n)).over(w.rowsBetween(UNBOUNDED, 0))
    return n - F.coalesce(last_break, F.lit(0))


def average_tie_rank(value: str | Column, partition: list[str | Column]) -> Column:
    """Percentile rank in (0, 1] with average ties, over the non-null values of a cross-section.

    Average rank = (first rank + last rank of the tie) / 2; both come from one ordered window, so
    several ranks of a cross-section share the exchange on ``partition``.
    """
    v = col(value)
    whole = Window.partitionBy(*partition)
    w = whole.orderBy(v.asc_nulls_last())
    last_rank = F.round(F.cume_dist().over(w) * F.count(F.lit(1)).over(whole))
    return F.when(v.isNotNull(), (F.rank().over(w) + last_rank) / 2 / F.count(v).over(whole))


def non_overlapping(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Greedy selection: keep a row only if it starts after the end of the last kept one.

    A chain in the order of starts: the narrow (start, end) pairs of a key stream through a task sorted, one value of
    state each, however many there are; the wide rows are joined back by key and start. Rows without a start are
    left out; after a kept row without an end the next one is kept.
    """
    narrow = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(start).alias("_s"), F.col(end).alias("_e")).where(F.col("_s").isNotNull())
    names = [f"_k{i}" for i in range(len(keys))]
    kept_schema = T.StructType([f for f in narrow.schema.fields if f.name != "_e"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for b in batches:
            keep = []
            for at, (*now, s, e) in enumerate(zip(*(b[n].to_pylist() for n in [*names, "_s", "_e"]), strict=True)):
                if key != now or last is None or s > last:
                    key, last = now, e
                    keep.append(at)
            yield b.select([*names, "_s"]).take(pa.array(keep, pa.int64()))

    kept = narrow.repartition(*names).sortWithinPartitions(*names, "_s", "_e").mapInArrow(chain, kept_schema).distinct()
    kept = kept.select(*[F.col(n).alias(f"_j{n}") for n in [*names, "_s"]])
    on = [F.col(k).eqNullSafe(F.col(f"_j{n}")) for k, n in zip([*keys, start], [*names, "_s"], strict=True)]
    return df.join(kept, on, "left_semi")


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Running sums that stay distributed for a hot key.

    ``bucket`` is any column that never decreases along ``order`` (a day, an hour).  Rows are
    summed per (key, bucket) with map-side combine; only those totals are scanned per key, and
    the row-level window is partitioned by (key, bucket).  ``values`` maps output -> expression;
    use DECIMAL expressions for sums that must not depend on row order.
    """
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(v).alias(f"_t_{o}") for o, v in values.items()])
    wb = over(keys, bucket).rowsBetween(UNBOUNDED, -1)
    offsets = totals.select(*keys, bucket, *[
        F.coalesce(F.sum(f"_t_{o}").over(wb), F.lit(0)).alias(f"_o_{o}") for o in values])
    w = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(UNBOUNDED, 0)
    rows = df.withColumns({f"_c_{o}": F.sum(v).over(w) for o, v in values.items()})
    return (rows.join(offsets, [*keys, bucket])
            .withColumns({o: F.coalesce(F.col(f"_c_{o}"), F.lit(0)) + F.col(f"_o_{o}") for o in values})
            .drop(*[f"_c_{o}" for o in values], *[f"_o_{o}" for o in values]))


def every_nth(df: DataFrame, keys: list[str], order: str, n: Column) -> DataFrame:
    """Rows 0, n, 2n, ... of each key."""
    return (df.withColumn("_i", F.row_number().over(over(keys, order)) - 1)
            .where(F.pmod(F.col("_i"), n) == 0).drop("_i"))
