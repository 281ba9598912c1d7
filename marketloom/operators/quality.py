"""Input validation and data-quality checks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.functions import dates as D, text as T
from marketloom.functions.scalar import finite


def validate_bars(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) bars: unique dates, finite positive prices, non-negative volume, OHLC order."""
    px = ["open", "high", "low", "close"]
    missing = [c for c in (*px, "volume") if c not in bars.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    fin = finite("volume").isNotNull()
    pos = F.lit(True)
    for c in px:
        fin, pos = fin & finite(c).isNotNull(), pos & (F.col(c) > 0)
    ordered = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high"))
    n = F.count("*").over(Window.partitionBy("ticker", "trade_date"))
    d = bars.withColumn("reject_reason", F.when(n > 1, "DUPLICATE_DATE").when(~fin, "NOT_FINITE").when(~pos, "NOT_POSITIVE").when(F.col("volume") < 0, "NEGATIVE_VOLUME").when(~ordered, "HIGH_LOW_ORDER"))
    return d.where("reject_reason IS NULL").drop("reject_reason"), d.where("reject_reason IS NOT NULL")


def validate_import(rows: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Typed trade rows with every error per row; exact repeats after the first are flagged, within ``scope`` (a file)."""
    d = rows.withColumns({"trade_date": D.strict_date("date"), "ticker_n": T.normalize_ticker("ticker"), "side_n": T.trade_side("side"), "quantity": T.import_number("shares"),
                          "price_n": T.import_number("price"), "fee_n": F.coalesce(T.import_number("fee"), F.lit(0.0))})
    e = lambda c, t: F.when(c, F.lit(t))
    d = d.withColumn("_wrong", F.array_compact(F.array(
        e(F.col("trade_date").isNull(), "DATE"), e(F.col("ticker_n").isNull(), "TICKER"), e(F.col("side_n").isNull(), "SIDE"), e(F.coalesce(F.col("quantity") <= 0, F.lit(True)), "QUANTITY"),
        e(F.coalesce(F.col("price_n") <= 0, F.lit(True)), "PRICE"), e(F.col("fee_n") < 0, "FEE"))))
    key = F.concat_ws("\u0001", *scope, F.col("trade_date").cast("string"), "ticker_n", "side_n", F.col("quantity").cast("string"), F.col("price_n").cast("string"), F.col("fee_n").cast("string"), *[c for c in ("note",) if c in rows.columns])
    d = d.withColumn("row_key", F.sha2(key, 256))
    first = d.where(F.size("_wrong") == 0).groupBy("row_key").agg(F.min("row_no").alias("_first"))  # one row per distinct key, combinable
    repeated = (F.size("_wrong") == 0) & (F.col("row_no") > F.col("_first"))
    return d.join(first, "row_key", "left").withColumn("errors", F.when(repeated, F.array(F.lit("DUPLICATE"))).otherwise(F.col("_wrong"))).drop("_first", "_wrong")


def price_check(bars: DataFrame, scope: DataFrame, expected: Column) -> DataFrame:
    """MISSING / STALE / INCONSISTENT / CURRENT per ticker (several providers per day allowed)."""
    day = bars.groupBy("ticker", "trade_date").agg(F.max("close").alias("_hi"), F.min("close").alias("_lo"), F.bool_or((F.col("high") < F.col("low")) | (F.col("close") > F.col("high")) | (F.col("close") < F.col("low"))).alias("_bad"))
    last = day.groupBy("ticker").agg(F.max("trade_date").alias("latest"), F.max_by(F.struct("_hi", "_lo", "_bad"), "trade_date").alias("x"))
    d = scope.select("ticker").distinct().join(last, "ticker", "left")
    spread = F.col("x._hi") / F.col("x._lo") - 1
    return d.select("ticker", "latest", F.when(F.col("latest").isNull(), "MISSING").when(F.col("latest") < expected, "STALE").when(F.col("x._bad") | (spread > 0.001), "INCONSISTENT").otherwise("CURRENT").alias("status"))


def dated_output_checks(expected: DataFrame, outputs: dict[str, DataFrame], as_of: Column, max_age: dict[str, int]) -> DataFrame:
    """Expected grid (ticker x output) against the latest dated row of each output."""
    rows = None
    for name, df in outputs.items():
        got = df.groupBy("ticker").agg(F.max("day").alias("latest"))
        r = expected.select("ticker").join(got, "ticker", "left").select("ticker", F.lit(name).alias("check_key"), "latest", F.lit(max_age[name]).alias("_age"))
        rows = r if rows is None else rows.unionByName(r)
    return rows.select("ticker", "check_key", "latest", F.when(F.col("latest").isNull(), "MISSING").when(F.datediff(as_of, "latest") > F.col("_age"), "STALE").otherwise("CURRENT").alias("status"))


def overall_status(checks: DataFrame) -> DataFrame:
    """Counts by status and the overall verdict per ticker."""
    g = checks.groupBy("ticker").agg(F.count("*").alias("checks"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("MISSING", "STALE", "INCONSISTENT")])
    return g.withColumn("overall", F.when(F.col("missing") + F.col("inconsistent") > 0, "FAILED").when(F.col("stale") > 0, "DEGRADED").otherwise("HEALTHY"))


def coverage(bars: DataFrame, min_history: int = 253) -> DataFrame:
    """First and last date, rows, and the first date with enough history per ticker."""
    n = F.row_number().over(Window.partitionBy("ticker").orderBy("trade_date"))
    return bars.withColumn("_n", n).groupBy("ticker").agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.count("*").alias("rows"),
                                                          F.min(F.when(F.col("_n") >= min_history, F.col("trade_date"))).alias("first_eligible"))


def freshness(tables: dict[str, DataFrame]) -> DataFrame:
    """Latest day and row count per ticker and table, one column pair per table."""
    out = None
    for name, df in tables.items():
        g = df.groupBy("ticker").agg(F.max("day").alias(f"{name}_latest"), F.count("*").alias(f"{name}_rows"))
        out = g if out is None else out.join(g, "ticker", "full_outer")
    return out


def step_summary(results: DataFrame) -> DataFrame:
    """Totals, failures and status per step."""
    g = results.groupBy("step").agg(F.count("*").alias("total"), F.count_if(~F.col("ok")).alias("failed"))
    return g.withColumn("status", F.when(F.col("failed") == 0, "SUCCEEDED").when(F.col("failed") == F.col("total"), "FAILED").otherwise("PARTIAL"))


def residual_check(df: DataFrame, keys: list[str], residual: Column, tolerance: float) -> DataFrame:
    """Largest absolute residual of an identity per key and whether it holds."""
    return df.groupBy(*keys).agg(F.max(F.abs(residual)).alias("max_residual")).withColumn("holds", F.col("max_residual") <= tolerance)


def stale_results(stored: DataFrame, recomputed: DataFrame, keys: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Keys whose stored value differs from the recomputed one or is absent."""
    j = recomputed.select(*keys, F.col(value).alias("_new")).join(stored.select(*keys, F.col(value).alias("_old")), keys, "left")
    return j.where(F.col("_old").isNull() | (F.abs(F.col("_new") - F.col("_old")) > tolerance)).select(*keys, F.when(F.col("_old").isNull(), "ABSENT").otherwise("CHANGED").alias("finding"))


def audit_counts(parents: DataFrame, children: DataFrame, key: str, expected: str) -> DataFrame:
    """Parents whose number of child rows differs from the expected count."""
    n = children.groupBy(key).agg(F.count("*").alias("found"))
    return parents.join(n, key, "left").withColumn("found", F.coalesce("found", F.lit(0))).where(F.col("found") != F.col(expected)).select(key, expected, "found")
