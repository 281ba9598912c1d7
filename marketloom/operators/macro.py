"""Macro indicators: latest pair per date, rate regime, context rows and events."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.functions.scalar import rnd

# Indicator -> kind.
INDICATORS = {"US10Y_YIELD": "YIELD", "US13W_YIELD": "YIELD", "US10Y_FUTURES": "PRICE", "FED_FUNDS_FUTURES": "FED_FUNDS", "LONG_TREASURY_ETF": "PRICE"}


def indicator_changes(bars: DataFrame) -> DataFrame:
    """Each observation with its predecessor and the change in the indicator's own unit."""
    w = Window.partitionBy("indicator_key").orderBy("trade_date")
    kind = F.coalesce(*[F.when(F.col("indicator_key") == k, F.lit(v)) for k, v in INDICATORS.items()])
    d = bars.withColumns({"kind": kind, "previous": F.lag("close").over(w)})
    diff = F.col("close") - F.col("previous")
    return d.withColumns({
        "change_bps": rnd(F.when(F.col("kind") == "YIELD", diff * 100).when(F.col("kind") == "FED_FUNDS", -diff * 100), 2),
        "change_pct": rnd(F.when((F.col("kind") == "PRICE") & (F.col("previous") != 0), diff / F.col("previous")), 6),
        "implied_rate": rnd(F.when(F.col("kind") == "FED_FUNDS", 100 - F.col("close")), 4)})


def regime(ten_year_bps: Column, expected_bps: Column) -> Column:
    up = lambda c, t: F.coalesce(c >= t, F.lit(False))
    head = up(ten_year_bps, 10) | up(expected_bps, 5)
    tail = up(-ten_year_bps, 10) | up(-expected_bps, 5)
    return F.when(head & tail, "MIXED").when(head, "RATE_HEADWIND").when(tail, "RATE_TAILWIND").otherwise("NEUTRAL")


def severity(ten_year_bps: Column, expected_bps: Column) -> Column:
    t, e = F.abs(F.coalesce(ten_year_bps, F.lit(0.0))), F.abs(F.coalesce(expected_bps, F.lit(0.0)))
    return F.when((t >= 25) | (e >= 15), "P1").when((t >= 10) | (e >= 5), "P2").otherwise("P3")


def market_context(bars: DataFrame) -> DataFrame:
    """One row per date with the latest change of every indicator on or before it, regime and severity."""
    c = indicator_changes(bars)
    value = F.coalesce("change_bps", "change_pct")
    p = c.groupBy("trade_date").pivot("indicator_key", list(INDICATORS)).agg(F.max(F.struct(F.lit(1).alias("seen"), value.alias("v"))))
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)  # the date dimension
    p = p.select("trade_date", *[F.last(k, True).over(w)["v"].alias(k) for k in INDICATORS])
    t, e = F.col("US10Y_YIELD"), F.col("FED_FUNDS_FUTURES")
    return p.withColumns({"regime": regime(t, e), "severity": severity(t, e)})


def macro_events(context: DataFrame) -> DataFrame:
    """Event rows for dates whose regime is not neutral."""
    e = context.where(F.col("severity").isin("P1", "P2") & (F.col("regime") != "NEUTRAL"))
    return e.select("trade_date", "regime", "severity", F.concat_ws(":", F.lit("MACRO_RATES"), F.col("trade_date").cast("string"), "regime").alias("event_key"))


def risk_regime(vol20: Column, ret21: Column) -> Column:
    return F.when(vol20 >= 0.025, "HIGH_VOLATILITY").when(ret21 >= 0.03, "RISK_ON").when(ret21 <= -0.03, "RISK_OFF").otherwise("BALANCED")
