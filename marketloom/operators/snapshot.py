"""The parts of the point-in-time feature snapshot that come from other tables: industry benchmark, statements,
valuation of the company and of its peers, events. Each adds columns to (ticker, trade_date) rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.functions.scalar import change, premium, ratio, rnd
from marketloom.operators.asof import asof_join, asof_joins, valid_at
from marketloom.operators.events import trailing_event_features
from marketloom.operators.fundamentals import change_points

#: Every annual period that was ever filed stays in reach (a century).
ANNUAL_REACH = 36600
STATEMENT_METRICS = ["revenue", "grossProfit", "netIncome", "operatingCashFlow", "capitalExpenditure"]


def industry_features(rows: DataFrame, prices: DataFrame, industries: DataFrame, prefix: str = "industry") -> DataFrame:
    """Returns of the last bar on or before each date of the ticker's industry symbol. ``industries``: ``ticker, industry``."""
    p = prices.select(F.col("ticker").alias("industry"), "trade_date", F.col("close").alias(f"{prefix}_close"), *[F.col(f"return_{n}d").alias(f"{prefix}_{n}d") for n in (21, 63, 126)])
    at = rows.join(industries.select("ticker", "industry"), "ticker", "left")
    return asof_join(at, p, ["industry"], "trade_date", "trade_date", [c for c in p.columns if c not in ("industry", "trade_date")]).drop("industry")


def statement_states(annual: DataFrame) -> DataFrame:
    """Growth and ratios of the newest annual period, once per (ticker, filing date): ``cp`` is known strictly after.

    ``annual``: ``ticker, metric_key, period_start, period_end, filed_at, value``, restatements as further rows.
    """
    w = Window.partitionBy("ticker", "metric_key", "period_end").orderBy("filed_at")
    versions = annual.withColumns({"valid_from": F.col("filed_at"), "valid_to": F.lead("filed_at").over(w)})
    d = change_points(versions, "revenue", STATEMENT_METRICS, ANNUAL_REACH)
    now, before = F.get("qs", F.lit(0)), F.get("qs", F.lit(1))
    return d.select(
        "ticker", "cp", now["end"].alias("fiscal_period_end"), F.col("cp").alias("statement_filed_at"), rnd(change(now["revenue"], before["revenue"]), 6).alias("revenue_growth"),
        rnd(ratio(now["grossProfit"], now["revenue"]), 6).alias("gross_margin"), rnd(ratio(now["netIncome"], now["revenue"]), 6).alias("net_margin"),
        rnd(ratio(now["operatingCashFlow"], now["revenue"]), 6).alias("cash_flow_margin"),
        rnd(F.when(now["netIncome"] != 0, now["operatingCashFlow"] / F.abs(now["netIncome"])), 6).alias("cash_conversion"),
        rnd(F.when(now["revenue"] != 0, F.abs(now["capitalExpenditure"]) / F.abs(now["revenue"])), 6).alias("capex_intensity"))


def price_earnings(close: Column, eps: Column) -> Column:
    return rnd(F.when(eps > 0, close / eps), 4)


def known_earnings(ttm: DataFrame, ntm: DataFrame) -> list[tuple[DataFrame, str, list[str], bool]]:
    """For ``asof_joins``: trailing EPS is known strictly after its filing, the NTM consensus from its own date on.

    The consensus brings its date and, if ``ntm`` has one, its ``quality_status``.
    """
    status = F.col("quality_status") if "quality_status" in ntm.columns else F.lit(None).cast("string")
    n = ntm.where(F.col("eps_value").isNotNull()).select("ticker", "as_of", rnd("eps_value", 4).alias("ntm_eps"), F.col("as_of").alias("estimate_as_of"), status.alias("estimate_quality"))
    return [(ttm, "cp", ["ttm_eps"], True), (n, "as_of", ["ntm_eps", "estimate_as_of", "estimate_quality"], False)]


def with_price_earnings(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"static_pe": price_earnings(F.col("close"), F.col("ttm_eps")), "forward_pe": price_earnings(F.col("close"), F.col("ntm_eps"))})


def company_features(rows: DataFrame, ttm: DataFrame, ntm: DataFrame, revisions: DataFrame, annual: DataFrame) -> DataFrame:
    """Valuation, estimate revision (``ticker, as_of, eps_revision``) and statements as known at each date, in one scan."""
    s = statement_states(annual)
    known = [*known_earnings(ttm, ntm), (revisions, "as_of", ["eps_revision"], False), (s, "cp", [c for c in s.columns if c not in ("ticker", "cp")], True)]
    return with_price_earnings(asof_joins(rows, known, ["ticker"], "trade_date"))


def peer_features(rows: DataFrame, relations: DataFrame, prices: DataFrame, ttm: DataFrame, ntm: DataFrame) -> DataFrame:
    """Medians of the PE of the peers that are active at each date, and the company's premium against them.

    A peer's PE uses its last close on or before the date, so peers without a bar that day count. Each (peer, date)
    is valued once, however many companies it is a peer of.
    """
    pairs = valid_at(relations, rows.select("ticker", "trade_date"), ["ticker"], "trade_date", "active_from", "active_to").select("ticker", "trade_date", "related_ticker")
    asked = pairs.select(F.col("related_ticker").alias("ticker"), "trade_date").distinct()
    closes = (prices.select("ticker", F.col("trade_date").alias("bar_date"), "close"), "bar_date", ["close"], False)
    valued = with_price_earnings(asof_joins(asked, [closes, *known_earnings(ttm, ntm)], ["ticker"], "trade_date")).select(F.col("ticker").alias("related_ticker"), "trade_date", "static_pe", "forward_pe")
    m = pairs.join(valued, ["related_ticker", "trade_date"]).groupBy("ticker", "trade_date").agg(
        F.median("static_pe").alias("_ms"), F.median("forward_pe").alias("_mf"), F.count_if(F.col("static_pe").isNotNull() | F.col("forward_pe").isNotNull()).alias("peer_samples"))
    d = rows.join(m, ["ticker", "trade_date"], "left")
    return d.withColumns({"peer_static_pe": rnd("_ms", 4), "peer_forward_pe": rnd("_mf", 4), "static_premium": rnd(premium("static_pe", "_ms"), 6),
                          "forward_premium": rnd(premium("forward_pe", "_mf"), 6)}).drop("_ms", "_mf")


def peer_margins(rows: DataFrame, relations: DataFrame, statements: DataFrame) -> DataFrame:
    """Adds the median gross margin of the peers that are active at each row's date, as filed before it. ``statements``: of ``statement_states``."""
    key = ["ticker", "trade_date"]
    pairs = valid_at(relations, rows.select(*key).distinct(), ["ticker"], "trade_date", "active_from", "active_to").select(*key, "related_ticker")
    s = statements.select(F.col("ticker").alias("related_ticker"), "cp", F.col("gross_margin").alias("_margin"))
    known = asof_join(pairs, s, ["related_ticker"], "trade_date", "cp", ["_margin"], strict=True)
    return rows.join(known.groupBy(*key).agg(F.median("_margin").alias("peer_gross_margin")), key, "left")


def event_score_features(rows: DataFrame, events: DataFrame, days: int = 30) -> DataFrame:
    """Signed severity of the trailing days' events; null without any."""
    e = trailing_event_features(events, rows.select("ticker", F.col("trade_date").alias("as_of")), days)
    e = e.select("ticker", F.col("as_of").alias("trade_date"), F.when(F.col("events") > 0, F.col("event_score")).alias("event_score"), F.col("events").alias("events_30d"),
                 (F.col("events") - F.col("proxy")).alias("direct_events_30d"), F.col("proxy").alias("proxy_events_30d"), F.col("official_high_risk").alias("official_risk_30d"))
    return rows.join(e, ["ticker", "trade_date"], "left")


def risk_regime(volatility: Column, return_21d: Column) -> Column:
    return (F.when(volatility >= 0.025, "HIGH_VOLATILITY").when(return_21d >= 0.03, "RISK_ON").when(return_21d <= -0.03, "RISK_OFF").otherwise("BALANCED"))
