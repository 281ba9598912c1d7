"""Daily money flow: indicators, component scores, signals, confidence and anomalies for every date."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.functions.scalar import available_weight, clamp, ratio, rnd, weighted_mean
from marketloom.operators.series import over, returns, trailing

# Component weights, volume-alert thresholds and the history considered per date.
COMPONENT_WEIGHTS = {"directional_notional": 0.30, "cmf20": 0.25, "mfi14": 0.15,
                     "up_down_volume": 0.15, "close_location": 0.10, "obv_slope": 0.05}
ALERT_RATIO, ALERT_MOVE, HISTORY = 1.5, 0.02, 90


def flow_metrics(bars: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All per-date flow metrics; one exchange and one sort, as every frame shares the key and order."""
    w = over(keys or ["ticker"])
    c, h, lo, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    typical = (h + lo + c) / 3
    d = bars.withColumns({
        "_prev": F.lag("close").over(w), "_typ": typical, "_n": F.row_number().over(w)})
    d = d.withColumn("_ptyp", F.lag("_typ").over(w))
    tradable = (v > 0) & F.col("_prev").isNotNull()
    sign = F.signum(c - F.col("_prev"))
    mult = F.when((h > lo) & (v > 0), (2 * c - h - lo) / (h - lo))
    d = d.withColumns({
        "_dir": F.when(tradable, sign), "_notional": F.when(tradable, c * v), "_vol": F.when(tradable, v),
        "_mult": mult, "_mflow": F.when(F.col("_ptyp").isNotNull(), F.col("_typ") * v),
        "_posvol": F.when(v > 0, v)})
    f14, f20, f20p, f5 = trailing(14, w), trailing(20, w), trailing(20, w, 1), trailing(5, w)
    pos = F.sum(F.when(F.col("_typ") > F.col("_ptyp"), F.col("_mflow")).otherwise(0.0)).over(f14)
    neg = F.sum(F.when(F.col("_typ") < F.col("_ptyp"), F.col("_mflow")).otherwise(0.0)).over(f14)
    obs = F.count("_mflow").over(f14)
    mfi = (F.when((F.col("_n") < 10) | (obs < 8), None)
           .when(neg == 0, F.when(pos > 0, 100.0).otherwise(50.0))
           .otherwise(100 - 100 / (1 + pos / neg)))
    cmf_volume = F.sum(F.when(F.col("_mult").isNotNull(), v)).over(f20)
    cmf = F.when(F.count("_mult").over(f20) >= 10, clamp(F.sum(F.col("_mult") * v).over(f20) / cmf_volume, -1, 1))
    base = F.avg("_posvol").over(f20p)
    sd = F.stddev_samp("_posvol").over(f20p)
    avg5, avg20 = F.avg("volume").over(f5), F.avg("volume").over(f20)
    updown = ratio(F.sum(F.col("_dir") * F.col("_vol")).over(f20), F.sum("_vol").over(f20))
    trend = ratio(avg5, avg20) - 1
    m = d.withColumns({
        "mfi14": mfi, "cmf20": cmf,
        "directional_notional": ratio(F.sum(F.col("_dir") * F.col("_notional")).over(f20), F.sum("_notional").over(f20)),
        "up_down_volume": updown, "obv_slope": updown,
        "close_location": F.when(h > lo, (2 * c - h - lo) / (h - lo)),
        "relative_volume": F.when((v > 0) & (base > 0), v / base),
        "volume_z": F.when(sd > 0, (v - base) / sd),
        "daily_return": returns("close", 1, w), "return_5d": returns("close", 5, w), "return_20d": returns("close", 20, w),
        "volume_trend_pct": trend,
        "sample_size": F.col("_n"),
        "volume_sample": F.count("_posvol").over(trailing(HISTORY, w))})
    return m.withColumn("volume_trend", F.when(F.col("volume_trend_pct").isNull(), "INSUFFICIENT")
                        .when(F.col("volume_trend_pct") >= 0.20, "RISING")
                        .when(F.col("volume_trend_pct") <= -0.20, "FALLING").otherwise("STABLE")
                        ).drop("_prev", "_typ", "_ptyp", "_dir", "_notional", "_vol", "_mult", "_mflow", "_posvol", "_n")


def component_scores(m: DataFrame) -> DataFrame:
    """Six component scores on -100..100, rounded to two decimals; missing stays null."""
    raw = {k: F.col(k) * 100 for k in COMPONENT_WEIGHTS}
    raw["mfi14"] = (F.col("mfi14") - 50) * 2
    return m.withColumns({f"score_{k}": rnd(clamp(x, -100, 100), 2) for k, x in raw.items()})


def flow_score(m: DataFrame) -> DataFrame:
    """Score renormalised over the available weight, signal band and confidence."""
    s = component_scores(m)
    parts = [(F.col(f"score_{k}"), wt) for k, wt in COMPONENT_WEIGHTS.items()]
    available = (F.col("sample_size") >= 10) & (F.col("volume_sample") >= 8)
    s = s.withColumns({"available": available, "coverage": available_weight(parts)})
    s = s.withColumn("raw_score", F.when(F.col("available"), F.coalesce(clamp(weighted_mean(parts), -100, 100), F.lit(0.0))).otherwise(0.0))
    majority = F.signum("raw_score")
    signs = [F.signum(p) for p, _ in parts]
    nonzero = sum((F.when(x != 0, 1).otherwise(0) for x in signs), F.lit(0))
    agree = sum((F.when((x != 0) & (x == majority), 1).otherwise(0) for x in signs), F.lit(0))
    agreement = F.when(nonzero > 0, agree / nonzero).otherwise(0.0)
    confidence = F.when(F.col("available"), F.least(
        F.lit(72.0), 25 + F.col("coverage") * 30 + F.least("sample_size", F.lit(60)) / 60 * 10 + agreement * 10)
    ).otherwise(F.least(F.lit(35.0), F.col("sample_size") / 10 * 20 + F.col("volume_sample") / 8 * 15))
    return s.withColumns({"score": rnd("raw_score", 2), "confidence": rnd(confidence, 2),
                          "signal": signal_band("raw_score", "available")}).drop("raw_score")


def signal_band(score: str, available: str) -> Column:
    s = F.col(score)
    return (F.when(~F.col(available), "INSUFFICIENT").when(s >= 50, "STRONG_ACCUMULATION").when(s >= 20, "ACCUMULATION")
            .when(s <= -50, "STRONG_DISTRIBUTION").when(s <= -20, "DISTRIBUTION").otherwise("NEUTRAL"))


def anomalies(m: DataFrame) -> DataFrame:
    """Anomaly codes of a day as an array of (code, severity, direction)."""
    rv, dr, r5, cmf, loc = (F.col(x) for x in ("relative_volume", "daily_return", "return_5d", "cmf20", "close_location"))
    loud = rv >= ALERT_RATIO

    def flag(cond: Column, code: str, severity: str, direction: str) -> Column:
        return F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(direction).alias("direction")))

    return m.withColumn("anomalies", F.array_compact(F.array(
        flag(loud & (dr >= ALERT_MOVE), "HIGH_VOLUME_RISE", "P2", "INFLOW"),
        flag(loud & (dr <= -ALERT_MOVE), "HIGH_VOLUME_FALL", "P1", "OUTFLOW"),
        flag((r5 >= 0.03) & (cmf <= -0.05), "PRICE_FLOW_BEARISH_DIVERGENCE", "P2", "OUTFLOW"),
        flag((r5 <= -0.03) & (cmf >= 0.05), "PRICE_FLOW_BULLISH_DIVERGENCE", "P2", "INFLOW"),
        flag(loud & (loc >= 0.65), "HIGH_VOLUME_CLOSE_NEAR_HIGH", "P2", "INFLOW"),
        flag(loud & (loc <= -0.65), "HIGH_VOLUME_CLOSE_NEAR_LOW", "P1", "OUTFLOW"))))


def evidence_top(m: DataFrame, k: int = 4) -> DataFrame:
    """The k components with the largest absolute contribution, ties in component order."""
    items = [F.struct((-F.abs(F.col(f"score_{n}") * w)).alias("a"), F.lit(i).alias("i"), F.lit(n).alias("key"),
                      F.when(F.col(f"score_{n}") > 8, "INFLOW").when(F.col(f"score_{n}") < -8, "OUTFLOW").otherwise("NEUTRAL").alias("direction"),
                      rnd(F.col(f"score_{n}") * w, 2).alias("contribution"))
             for i, (n, w) in enumerate(COMPONENT_WEIGHTS.items())]
    ranked = F.array_sort(F.filter(F.array(*items), lambda x: x["a"].isNotNull()))
    return m.withColumn("evidence", F.slice(ranked, 1, k))


def volume_alerts(m: DataFrame) -> DataFrame:
    """One alert row per anomaly with its stable event key."""
    a = anomalies(m).select("ticker", "trade_date", F.explode("anomalies").alias("a"))
    return a.select("ticker", "trade_date", "a.*",
                    F.concat_ws(":", F.lit("CAPITAL_FLOW"), "ticker", F.col("trade_date").cast("string"), "a.code").alias("event_key"))


def market_overlay(flow: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Join the benchmark's SMA200, 20-day return and risk-off flag by date."""
    w = over("ticker")
    sma = F.when(F.count("close").over(trailing(200, w)) == 200, F.avg("close").over(trailing(200, w)))
    b = benchmark.select("trade_date", F.col("close").alias("market_close"), sma.alias("market_sma200"),
                         returns("close", 20, w).alias("market_return_20d"))
    b = b.withColumn("risk_off", F.col("market_close") < F.col("market_sma200"))
    return flow.join(b, "trade_date", "left")


def adjusted_bars(bars: DataFrame) -> DataFrame:
    """Scale OHLC by adjusted_close / close."""
    k = F.col("adjusted_close") / F.col("close")
    return bars.withColumns({c: F.col(c) * k for c in ("open", "high", "low")} | {"close": F.col("adjusted_close")})
