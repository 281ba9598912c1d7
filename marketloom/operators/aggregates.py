"""Aggregations that need more than a single built-in call."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.functions.scalar import col


def percentile_rank_of(value: Column | str, current: Column | str) -> Column:
    """Rank of ``current`` in a group's values, ties counted half, 0..100."""
    v, c = col(value), col(current)
    return (F.count_if(v < c) + 0.5 * F.count_if(v == c)) / F.count(v) * 100


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    accuracy: int = 10_000) -> DataFrame:
    """Linearly interpolated quantiles, exact, with bounded memory for any group size.

    ``percentile`` buffers every distinct value of a group in one task.  Here a bounded
    sketch brackets each wanted rank, exact counts below the bracket come from a combinable
    aggregate, and only the bracket's distinct values (about 8/accuracy of the group) are ordered.
    """
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    slack = 4.0 / accuracy
    names = list(probs)
    edges = [x for p in probs.values() for x in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = d.groupBy(*keys).agg(F.percentile_approx("_v", edges, accuracy).alias("_e"), F.count("*").alias("_n"))
    small = F.col("_n") <= accuracy  # a small group is ranked whole; brackets only narrow large ones
    brackets = sketch.select(*keys, "_n", F.explode(F.array(*[
        F.struct(F.lit(name).alias("_q"),
                 # the ends of the range are exact min/max ranks, so open them fully
                 F.when(small | F.lit(probs[name] - slack <= 0), float("-inf")).otherwise(F.col("_e")[2 * i]).alias("_lo"),
                 F.when(small | F.lit(probs[name] + slack >= 1), float("inf")).otherwise(F.col("_e")[2 * i + 1]).alias("_hi"),
                 ((F.col("_n") - 1) * probs[name]).alias("_pos")) for i, name in enumerate(names)])).alias("b"))
    brackets = brackets.select(*keys, "_n", "b.*")
    counts = d.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    cond = [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = cond[0] if cond else F.lit(True)
    for c in cond[1:]:
        on = on & c
    j = counts.alias("c").join(brackets.alias("b"), on).select(
        *[F.col(f"c.{k}").alias(k) for k in keys], "_v", "_c", "_n", "_q", "_lo", "_hi", "_pos")
    below = j.where("_v < _lo").groupBy(*keys, "_q").agg(F.sum("_c").alias("_below"))
    inside = j.where("_v >= _lo and _v <= _hi")
    bw = [F.col(f"i.{k}").eqNullSafe(F.col(f"w.{k}")) for k in [*keys, "_q"]]
    on2 = bw[0]
    for c in bw[1:]:
        on2 = on2 & c
    inside = inside.alias("i").join(below.alias("w"), on2, "left").select("i.*", F.coalesce("_below", F.lit(0)).alias("_below"))
    cum = F.sum("_c").over(Window.partitionBy(*keys, "_q").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = inside.withColumn("_hi_rank", F.col("_below") + cum)  # ranks [_hi_rank - _c, _hi_rank)
    lower, frac = F.floor("_pos"), F.col("_pos") - F.floor("_pos")
    upper = F.least(lower + 1, F.col("_n") - 1)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_hi_rank") - F.col("_c")) & (rank < F.col("_hi_rank")), F.col("_v")))

    vals = ranked.groupBy(*keys, "_q").agg(at(lower).alias("_a"), at(upper).alias("_b"), F.max(frac).alias("_f"))
    est = vals.withColumn("_x", F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f"))
    return est.groupBy(*keys).pivot("_q", names).agg(F.first("_x"))


def histogram_counts(df: DataFrame, keys: list[str], category: str, values: list[str]) -> DataFrame:
    """One count column per category value plus the total, by conditional aggregation."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), *[
        F.count_if(F.col(category) == v).alias(f"n_{v.lower()}") for v in values])


def herfindahl(weight: str) -> Column:
    return F.sum(F.col(weight) * F.col(weight))


def geometric_product(c: Column | str) -> Column:
    """Product of a group's factors (null for an empty group)."""
    return F.exp(F.sum(F.log(col(c))))


def complete_or_null(value: Column | str, incomplete: Column | str) -> Column:
    """Sum that is null as soon as any member is incomplete."""
    return F.when(F.max(col(incomplete).cast("int")) == 0, F.sum(col(value)))


def capped_top(df: DataFrame, partition: list[str], group: str, score: str, ticker: str,
               k: int, per_group: int | None, rank_col: str = "pick") -> DataFrame:
    """Best ``k`` rows per partition with at most ``per_group`` of a group, ties by ticker.

    Taking the best ``per_group`` of each group and then the best ``k`` of those equals the
    greedy walk down the ranking.
    """
    order = [F.col(score).desc_nulls_last(), F.col(ticker)]
    d = df
    if per_group is not None:
        d = d.withColumn("_g", F.row_number().over(Window.partitionBy(*partition, group).orderBy(*order))).where(F.col("_g") <= per_group)
    d = d.withColumn(rank_col, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    return d.where(F.col(rank_col) <= k).drop("_g")
