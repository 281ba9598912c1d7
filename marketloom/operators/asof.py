"""As-of, interval, nearest and forward joins on ordered keys, without row pairs."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str,
              values: list[str], strict: bool = False, tolerance_days: int | None = None,
              matched_ts: str | None = None, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Attach to each left row the last right row at or before it (strictly before if ``strict``).

    Both sides are unioned and scanned once in order: linear in the rows, no candidate pairs.
    A hot key is split by giving ``bucket``, a non-decreasing function of the timestamp (for
    example ``lambda t: F.trunc(t, "month")``): rows are scanned per (key, bucket), and the last
    right row of earlier buckets is carried in through a table of one row per (key, bucket).
    Ties on the right timestamp resolve to the greatest ``values`` tuple.
    """
    out_ts = matched_ts or "_matched"
    payload = F.struct(F.col(right_ts).alias(out_ts), *[F.col(v) for v in values])
    first, second = (1, 0) if strict else (0, 1)
    r = right.where(F.col(right_ts).isNotNull()).select(
        *on, F.col(right_ts).alias("_ts"), F.lit(first).alias("_side"), payload.alias("_v"))
    lcols = left.columns
    lrow = left.select(*on, F.col(left_ts).alias("_ts"), F.lit(second).alias("_side"),
                       F.struct(*lcols).alias("_l"))
    both = r.withColumn("_l", F.lit(None).cast(lrow.schema["_l"].dataType)).unionByName(
        lrow.withColumn("_v", F.lit(None).cast(r.schema["_v"].dataType)))
    part = list(on)
    if bucket is not None:
        both = both.withColumn("_b", bucket(F.col("_ts")))
        part.append("_b")
    w = Window.partitionBy(*part).orderBy("_ts", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_hit", F.last("_v", ignorenulls=True).over(w))
    rows = both.where(F.col("_l").isNotNull())
    if bucket is not None:
        ends = both.groupBy(*on, "_b").agg(F.max("_v").alias("_end"))
        carry_w = Window.partitionBy(*on).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*on, "_b", F.last("_end", ignorenulls=True).over(carry_w).alias("_carry"))
        rows = rows.join(ends, [*on, "_b"], "left").withColumn("_hit", F.coalesce("_hit", "_carry"))
    hit = F.col("_hit")
    if tolerance_days is not None:
        hit = F.when(F.datediff(F.col("_ts"), hit[out_ts]) <= tolerance_days, hit)
    rows = rows.withColumn("_hit", hit)
    extra = ([F.col(f"_hit.{out_ts}").alias(out_ts)] if matched_ts else []) + [
        F.col(f"_hit.{v}").alias(v) for v in values]
    return rows.select(*[F.col(f"_l.{c}").alias(c) for c in lcols], *extra)


def asof_joins(left: DataFrame, rights: list[tuple[DataFrame, str, list[str], bool]], on: list[str], left_ts: str) -> DataFrame:
    """Several as-of joins on the same keys and timestamp in one shuffle and one ordered scan.

    ``rights``: (table, its timestamp, the values to attach, whether strictly before). As in ``asof_join``, ties on a
    table's timestamp resolve to its greatest values.
    """
    lrow = left.select(*on, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    payloads = [F.struct(F.col(ts).alias("_at"), *[F.col(v) for v in values]) for _, ts, values, _ in rights]
    parts = [lrow] + [r.where(F.col(ts).isNotNull()).select(*on, F.col(ts).alias("_ts"), F.lit(2 if strict else 0).alias("_side"), p.alias(f"_v{k}"))
                      for k, ((r, ts, _, strict), p) in enumerate(zip(rights, payloads, strict=True))]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    names = [f"_v{k}" for k in range(len(rights))]
    w = Window.partitionBy(*on).orderBy("_ts", "_side", *names).rowsBetween(Window.unboundedPreceding, 0)
    hits = both.withColumns({f"_h{k}": F.last(n, ignorenulls=True).over(w) for k, n in enumerate(names)}).where(F.col("_l").isNotNull())
    return hits.select(*[F.col(f"_l.{c}").alias(c) for c in left.columns], *[F.col(f"_h{k}.{v}").alias(v) for k, (_, _, values, _) in enumerate(rights) for v in values])


def validity_intervals(changes: DataFrame, keys: list[str], from_col: str, to_col: str) -> DataFrame:
    """Close each version at the start of the next: [from, to) with null for the open end."""
    w = Window.partitionBy(*keys).orderBy(from_col)
    return changes.withColumn(to_col, F.lead(from_col).over(w))


DAY_ZERO = 719528  # days from 0000-01-01 to the epoch: day numbers of all dates are positive
LEVELS = 8  # blocks of 1, 8, 64, ... days; the widest, 8^7 days, covers every date


def _day_number(date: Column) -> Column:
    return (F.unix_date(date) + DAY_ZERO).cast("long")


def _point_blocks(day: Column) -> Column:
    """The one block of every level that holds a day."""
    return F.array(*[F.struct(F.lit(level).alias("_level"), F.shiftright(day, 3 * level).alias("_block")) for level in range(LEVELS)])


def _interval_blocks(first: Column, last: Column) -> Column:
    """The fewest blocks that cover the days ``first`` to ``last`` without overlap: at most 14 a level."""
    def between(level: int, low: Column, high: Column) -> Column:  # low <= block < high
        some = F.transform(F.sequence(low, high - 1), lambda k: F.struct(F.lit(level).alias("_level"), k.alias("_block")))
        return F.when(high > low, some).otherwise(F.array().cast("array<struct<_level:int,_block:bigint>>"))

    parts = []
    for level in range(LEVELS):
        size = 1 << (3 * level)
        low, high = F.shiftright(first + (size - 1), 3 * level), F.shiftright(last + 1, 3 * level)
        if level + 1 == LEVELS:
            parts.append(between(level, low, high))
            continue
        wide = size * 8
        up_low, up_high = F.shiftright(first + (wide - 1), 3 * level + 3), F.shiftright(last + 1, 3 * level + 3)
        inner = up_high > up_low  # wider blocks take the middle
        parts += [between(level, low, F.when(inner, up_low * 8).otherwise(high)), between(level, F.when(inner, up_high * 8).otherwise(high), high)]
    return F.concat(*parts)


def valid_at(rel: DataFrame, points: DataFrame, on: list[str], at: str, from_col: str, to_col: str,
             how: str = "inner") -> DataFrame:
    """SCD2 interval join: relations whose [from, to] contains the point (open end allowed).

    An interval is cut into date blocks of 8^k days, a point lies in one block a level, and they meet by equality of
    keys and block: each match is found in exactly one block, so the cost is linear in points, intervals and matches,
    and a key with many rows is spread over its blocks. A point without a date or a key matches nothing.
    """
    last = F.coalesce(F.col(to_col), F.lit("9999-12-31").cast("date"))
    r = rel.where(F.col(from_col) <= last).withColumn("_b", F.explode(_interval_blocks(_day_number(F.col(from_col)), _day_number(last)))).select(*rel.columns, "_b.*")
    if how == "inner":
        return points.withColumn("_b", F.explode(_point_blocks(_day_number(F.col(at))))).select(*points.columns, "_b.*").join(r, [*on, "_level", "_block"]).select(
            *points.columns, *[c for c in rel.columns if c not in on])
    if how != "left":
        raise ValueError("how is inner or left")
    rows = points.withColumn("_row", F.struct(*points.columns))
    hits = valid_at(rel, points.distinct(), on, at, from_col, to_col).select(F.struct(*points.columns).alias("_row"), *[F.col(c).alias(f"_r_{c}") for c in rel.columns if c not in on])
    keyed = rows.join(hits, rows["_row"].eqNullSafe(hits["_row"]), "left")
    return keyed.select(*points.columns, *[F.col(f"_r_{c}").alias(c) for c in rel.columns if c not in on])


def first_above(rows: DataFrame, steps: DataFrame, on: list[str], level: Column, value: str, at: str, name: str) -> DataFrame:
    """Adds ``name``: the first ``at`` of ``steps`` from which the date ``value`` is above ``level``; null if it never is.

    ``value`` never decreases along ``at``, so the least value above the level decides: an as-of join on negated days.
    """
    s = steps.where(F.col(value).isNotNull()).groupBy(*on, (-F.unix_date(value)).alias("_down")).agg(F.min(at).alias(name))
    return asof_join(rows.withColumn("_level", -F.unix_date(level)), s, on, "_level", "_down", [name], strict=True).drop("_level")


def nearest_by_day(anchors: DataFrame, candidates: DataFrame, on: list[str], anchor_date: str,
                   candidate_date: str, window_days: int, recency: str, keep: list[str],
                   not_after: str | None = None) -> DataFrame:
    """For each anchor the candidate whose date is nearest, at most ``window_days`` away.

    Each anchor is expanded to its 2*window+1 admissible days and equi-joined by day, so the
    work is linear in both inputs.  Ties go to the greater ``recency``; ``not_after`` names an
    anchor column the candidate's recency must not pass.
    """
    offsets = F.sequence(F.lit(-window_days), F.lit(window_days))
    days = anchors.withColumn("_o", F.explode(offsets)).withColumn("_day", F.date_add(anchor_date, F.col("_o")))
    c = candidates.select(*on, F.col(candidate_date).alias("_day"), F.struct(*keep).alias("_c"), F.col(recency).alias("_r"))
    j = days.join(c, [*on, "_day"])
    if not_after:
        j = j.where(F.col("_r") <= F.col(not_after))
    best = j.groupBy(*anchors.columns).agg(
        F.max_by(F.struct("_c", "_o"), F.struct(-F.abs("_o"), F.col("_r"))).alias("_b"))
    return best.select(*anchors.columns, *[F.col(f"_b._c.{k}").alias(f"near_{k}") for k in keep],
                       F.abs(F.col("_b._o")).alias("distance_days"))


def forward_sessions(c: str, n: int, keys: list[str], order: str) -> Column:
    """The value n sessions ahead (null while that session does not exist yet)."""
    return F.lead(c, n).over(Window.partitionBy(*keys).orderBy(order))
