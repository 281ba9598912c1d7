"""Tick-direction flow: minute aggregates, daily scores, large trades and imbalance flags."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.functions.scalar import clamp, ratio, rnd
from marketloom.operators.aggregates import exact_quantiles


def latest_trade_date(ticks: DataFrame, bars: DataFrame) -> DataFrame:
    """Latest day of a ticker over ticks and bars with volume."""
    b = bars.where(F.coalesce("volume", F.lit(0)) > 0).select("ticker", "trade_date")
    return ticks.select("ticker", "trade_date").unionByName(b).groupBy("ticker").agg(F.max("trade_date").alias("latest"))


# Score bands, imbalance thresholds and the large-trade quantile.
BANDS = (("STRONG_INFLOW", 35), ("INFLOW", 12))
LARGE_QUANTILE, MIN_LARGE_TICKS, SESSION_MINUTES = 0.95, 20, 390


def normalize_ticks(raw: DataFrame) -> DataFrame:
    """Valid ticks only, direction folded to BUY/SELL/NEUTRAL, turnover defaulting to price x volume.

    Stateless, so the same function serves a batch frame and a stream.
    """
    up = F.upper(F.trim("direction"))
    d = raw.where(F.col("sequence").isNotNull() & F.col("trade_time").isNotNull()
                  & F.col("price").isNotNull() & F.col("volume").isNotNull())
    turnover = F.col("turnover") if "turnover" in raw.columns else F.lit(None).cast("double")
    session = F.col("session") if "session" in raw.columns else F.lit(None).cast("string")
    return d.withColumns({
        "direction": F.when(up.isin("BUY", "SELL"), up).otherwise("NEUTRAL"),
        "turnover": F.coalesce(turnover, F.col("price") * F.col("volume")),
        "session": F.coalesce(session, F.lit("RTH"))})


def direction_sums() -> list[Column]:
    """Buy / sell / neutral turnover and counts, volume: exact DECIMAL sums, combinable map-side."""
    amount = F.col("turnover").cast("decimal(28,6)")
    out = []
    for side in ("BUY", "SELL", "NEUTRAL"):
        hit = F.col("direction") == side
        out += [F.sum(F.when(hit, amount).otherwise(0)).cast("double").alias(f"{side.lower()}_turnover"),
                F.count_if(hit).alias(f"{side.lower()}_count")]
    return out + [F.sum("volume").alias("volume")]


def minute_flow(ticks: DataFrame) -> DataFrame:
    """Minute table of a batch of ticks: direction sums and the last price by (time, sequence)."""
    return (normalize_ticks(ticks).withColumn("minute", F.date_trunc("minute", "trade_time"))
            .groupBy("ticker", "trade_date", "minute", "session")
            .agg(*direction_sums(), F.max_by("price", F.struct("trade_time", "sequence")).alias("last_price")))


def daily_direction(ticks: DataFrame) -> DataFrame:
    """Active turnover, net, ratio and direction coverage per (ticker, day)."""
    t = normalize_ticks(ticks)
    d = t.groupBy("ticker", "trade_date").agg(
        *direction_sums(), F.countDistinct(F.date_trunc("minute", "trade_time")).alias("tick_minutes"),
        F.max_by("price", F.struct("trade_time", "sequence")).alias("latest_price"))
    active = F.col("buy_turnover") + F.col("sell_turnover")
    n_active = F.col("buy_count") + F.col("sell_count")
    return d.withColumns({
        "active_count": n_active, "tick_count": n_active + F.col("neutral_count"), "active_turnover": active,
        "net_active_turnover": F.col("buy_turnover") - F.col("sell_turnover"),
        "active_ratio": F.when(active > 0, (F.col("buy_turnover") - F.col("sell_turnover")) / active),
        "direction_coverage": ratio(active, active + F.col("neutral_turnover")),
        "count_coverage": ratio(n_active, n_active + F.col("neutral_count"))})


def large_trades(ticks: DataFrame) -> DataFrame:
    """Large-trade ratio: sums over the active ticks of a day at or above their 95th percentile."""
    active = normalize_ticks(ticks).where(F.col("direction").isin("BUY", "SELL"))
    key = ["ticker", "trade_date"]
    n = active.groupBy(*key).agg(F.count("*").alias("_n"))
    limits = exact_quantiles(active, key, "turnover", {"_q95": LARGE_QUANTILE}).join(n, key)
    marked = active.join(limits.select(*key, F.when(F.col("_n") >= MIN_LARGE_TICKS, F.col("_q95")).alias("_limit")), key, "left")
    amount = F.when(F.col("turnover") >= F.col("_limit"), F.col("turnover").cast("decimal(28,6)"))
    g = marked.groupBy("ticker", "trade_date").agg(
        F.max("_limit").alias("large_threshold"), F.count("*").alias("large_sample"),
        F.sum(F.when(F.col("direction") == "BUY", amount)).cast("double").alias("_b"),
        F.sum(F.when(F.col("direction") == "SELL", amount)).cast("double").alias("_s"))
    b, s = F.coalesce("_b", F.lit(0.0)), F.coalesce("_s", F.lit(0.0))
    return g.withColumns({"large_buy_turnover": b, "large_sell_turnover": s,
                          "large_ratio": F.when(b + s > 0, (b - s) / (b + s))}).drop("_b", "_s")


def vwap_and_minute_direction(minute_bars: DataFrame) -> DataFrame:
    """VWAP, bar count and the close-to-close directional ratio of the minute bars of a day."""
    w = Window.partitionBy("ticker", "trade_date").orderBy("bar_time")  # at most one day's minutes
    amount = (F.col("close") * F.col("volume"))
    prev = F.lag("close").over(w)
    b = minute_bars.withColumns({"_t": amount, "_s": F.signum(F.col("close") - prev)})
    dec = lambda c: F.sum(c.cast("decimal(28,6)")).cast("double")
    g = b.groupBy("ticker", "trade_date").agg(
        F.count("*").alias("bar_count"), dec(F.col("_t")).alias("_turnover"), F.sum("volume").alias("bar_volume"),
        dec(F.col("_s") * F.col("_t")).alias("_signed"), dec(F.when(F.col("_s").isNotNull(), F.col("_t"))).alias("_cmp"),
        F.max_by("close", "bar_time").alias("last_close"))
    return g.withColumns({"vwap": ratio("_turnover", "bar_volume"),
                          "minute_ratio": F.when(F.col("_cmp") > 0, F.col("_signed") / F.col("_cmp"))}
                         ).drop("_turnover", "_signed", "_cmp")


def intraday_flow(ticks: DataFrame, minute_bars: DataFrame) -> DataFrame:
    """Score, signal, confidence and data level per (ticker, day) from ticks and minute bars."""
    key = ["ticker", "trade_date"]
    d = (daily_direction(ticks).join(large_trades(ticks), key, "left")
         .join(vwap_and_minute_direction(minute_bars), key, "full_outer"))
    bars = F.coalesce("bar_count", F.lit(0))
    avail = F.coalesce((F.col("active_count") >= 10) & (F.col("active_turnover") > 0), F.lit(False))
    price = F.coalesce("latest_price", "last_close")
    d = d.withColumns({
        "available": avail, "bars": bars,
        "price_vs_vwap": F.when(F.col("vwap") > 0, price / F.col("vwap") - 1),
        "minute_coverage": F.when(bars > 0, F.least(F.lit(1.0), F.coalesce("tick_minutes", F.lit(0)) / bars)),
        "session_progress": F.least(F.lit(1.0), bars / SESSION_MINUTES)})
    zero = F.lit(0.0)
    cover = F.coalesce("minute_coverage", zero)
    scale = 0.35 + 0.65 * F.sqrt(cover)
    bar_score = F.when(F.col("minute_ratio").isNotNull(),
                       F.col("minute_ratio") * 10 + clamp(F.coalesce("price_vs_vwap", zero) * 1000, -10, 10)).otherwise(0.0)
    score = F.when(F.col("available"), clamp(
        (F.col("active_ratio") * 60 + F.coalesce("large_ratio", zero) * 20) * scale + bar_score, -100, 100)
    ).when(F.col("minute_ratio").isNotNull(), clamp(F.col("minute_ratio") * 45, -45, 45)).otherwise(0.0)
    raw = F.when(F.col("available"), F.least(
        F.lit(90.0), 20 + F.least("tick_count", F.lit(1500)) / 1500 * 35 + F.coalesce("count_coverage", zero) * 25
        + F.least("bars", F.lit(SESSION_MINUTES)) / SESSION_MINUTES * 10)
    ).otherwise(F.least(F.lit(35.0), F.least("bars", F.lit(SESSION_MINUTES)) / SESSION_MINUTES * 35))
    conf = F.when(F.col("available"), raw * (0.4 + 0.6 * cover) * (0.55 + 0.45 * F.sqrt("session_progress"))).otherwise(raw)
    d = d.withColumns({"raw_score": score, "confidence": rnd(conf, 2)})
    s = F.col("raw_score")
    signal = (F.when(~(F.col("available") | (F.col("bars") >= 10)), "INSUFFICIENT")
              .when(s >= 35, "STRONG_INFLOW").when(s >= 12, "INFLOW")
              .when(s <= -35, "STRONG_OUTFLOW").when(s <= -12, "OUTFLOW").otherwise("NEUTRAL"))
    level = (F.when(F.col("available"), F.when(F.col("minute_coverage") >= 0.5, "TICK_DIRECTION").otherwise("TICK_DIRECTION_PARTIAL"))
             .when(F.col("bars") > 0, "MINUTE_PROXY").otherwise("NO_INTRADAY_DATA"))
    return d.withColumns({"score": rnd("raw_score", 2), "signal": signal, "data_level": level}).drop("raw_score")


def imbalance_flags(flow: DataFrame) -> DataFrame:
    """Active and large-trade imbalance anomalies of a day."""
    a, lr = F.col("active_ratio"), F.col("large_ratio")
    active = F.when(F.col("available") & (F.abs(a) >= 0.25), F.struct(
        F.when(a > 0, "ACTIVE_BUY_IMBALANCE").otherwise("ACTIVE_SELL_IMBALANCE").alias("code"),
        F.when(F.abs(a) >= 0.45, "P1").otherwise("P2").alias("severity")))
    large = F.when(F.abs(lr) >= 0.35, F.struct(
        F.when(lr > 0, "LARGE_BUY_IMBALANCE").otherwise("LARGE_SELL_IMBALANCE").alias("code"), F.lit("P2").alias("severity")))
    return flow.withColumn("anomalies", F.array_compact(F.array(active, large)))


def incomplete_sessions(minute_bars: DataFrame, scope: DataFrame, minutes: int = SESSION_MINUTES) -> DataFrame:
    """Scope tickers with fewer minute bars than one full session."""
    n = minute_bars.groupBy("ticker").agg(F.count("*").alias("bars"))
    return (scope.select("ticker").distinct().join(n, "ticker", "left")
            .withColumn("bars", F.coalesce("bars", F.lit(0))).where(F.col("bars") < minutes))
