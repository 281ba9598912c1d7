"""Daily money flow (FLOW-*)."""
from pyspark.sql import functions as F

from marketloom.functions.scalar import rnd
from marketloom.operators import flow as O
from marketloom.operators.series import over
from marketloom.plans import sqlviews as S
from marketloom.plans.registry import register
from marketloom.sources import views as V

r, clamp = S.rnd, S.clamp
KEY = ["ticker", "trade_date"]
FR = lambda n, off=0: f"(PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN {n - 1 + off} PRECEDING AND {off} PRECEDING)".replace("0 PRECEDING)", "CURRENT ROW)") if off == 0 else f"(PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN {n - 1 + off} PRECEDING AND {off} PRECEDING)"

# Independent statement of the metrics: signed sums per frame from row-level helper columns.
METRICS = f"""b0 AS (SELECT *, lag(close) OVER w AS pc, (high + low + close) / 3 AS typ, row_number() OVER w AS rn FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)),
b1 AS (SELECT *, lag(typ) OVER (PARTITION BY ticker ORDER BY trade_date) AS ptyp, CASE WHEN pc IS NOT NULL AND volume > 0 THEN sign(close - pc) END AS dir,
  CASE WHEN pc IS NOT NULL AND volume > 0 THEN volume END AS vol, CASE WHEN high > low AND volume > 0 THEN (2 * close - high - low) / (high - low) END AS mult, CASE WHEN volume > 0 THEN volume END AS pv FROM b0),
b2 AS (SELECT *, count(ptyp) OVER {FR(14)} AS mobs, sum(CASE WHEN typ > ptyp THEN typ * volume ELSE 0 END) OVER {FR(14)} AS mpos, sum(CASE WHEN typ < ptyp THEN typ * volume ELSE 0 END) OVER {FR(14)} AS mneg,
  count(mult) OVER {FR(20)} AS cobs, sum(mult * volume) OVER {FR(20)} AS cnum, sum(CASE WHEN mult IS NOT NULL THEN volume END) OVER {FR(20)} AS cden,
  sum(dir * close * vol) OVER {FR(20)} AS dn, sum(close * vol) OVER {FR(20)} AS dd, sum(dir * vol) OVER {FR(20)} AS un, sum(vol) OVER {FR(20)} AS ud,
  avg(pv) OVER {FR(20, 1)} AS base, stddev_samp(pv) OVER {FR(20, 1)} AS sd, avg(volume) OVER {FR(5)} AS a5, avg(volume) OVER {FR(20)} AS a20, count(pv) OVER {FR(90)} AS volume_sample,
  close / pc - 1 AS daily_return, close / lag(close, 5) OVER (PARTITION BY ticker ORDER BY trade_date) - 1 AS return_5d, close / lag(close, 20) OVER (PARTITION BY ticker ORDER BY trade_date) - 1 AS return_20d FROM b1),
m AS (SELECT ticker, trade_date, open, high, low, close, volume, daily_return, return_5d, return_20d, volume_sample, rn AS sample_size,
  CASE WHEN rn < 10 OR mobs < 8 THEN NULL WHEN mneg = 0 THEN CASE WHEN mpos > 0 THEN 100e0 ELSE 50e0 END ELSE 100 - 100 / (1 + mpos / mneg) END AS mfi14,
  CASE WHEN cobs >= 10 THEN least(greatest(cnum / cden, -1e0), 1e0) END AS cmf20, CASE WHEN dd > 0 THEN dn / dd END AS directional_notional, CASE WHEN ud > 0 THEN un / ud END AS up_down_volume,
  CASE WHEN ud > 0 THEN un / ud END AS obv_slope, CASE WHEN high > low THEN (2 * close - high - low) / (high - low) END AS close_location, CASE WHEN volume > 0 AND base > 0 THEN volume / base END AS relative_volume,
  CASE WHEN sd > 0 THEN (volume - base) / sd END AS volume_z, a5 / a20 - 1 AS volume_trend_pct FROM b2)"""

_COMP = {"directional_notional": ("directional_notional * 100", 0.30), "cmf20": ("cmf20 * 100", 0.25), "mfi14": ("(mfi14 - 50) * 2", 0.15),
         "up_down_volume": ("up_down_volume * 100", 0.15), "close_location": ("close_location * 100", 0.10), "obv_slope": ("obv_slope * 100", 0.05)}
SCORED = METRICS + ",\ns AS (SELECT *, sample_size >= 10 AND volume_sample >= 8 AS available, " + ", ".join(
    f"{r(clamp(e, -100, 100), 2)} AS score_{k}" for k, (e, _) in _COMP.items()) + " FROM m),\n" + (
    "s2 AS (SELECT *, " + " + ".join(f"CASE WHEN score_{k} IS NULL THEN 0e0 ELSE {w}e0 END" for k, (_, w) in _COMP.items()) + " AS coverage, "
    + " + ".join(f"coalesce(score_{k} * {w}e0, 0e0)" for k, (_, w) in _COMP.items()) + " AS wsum FROM s),\n"
    "s3 AS (SELECT *, CASE WHEN available AND coverage > 0 THEN least(greatest(wsum / coverage, -100e0), 100e0) ELSE 0e0 END AS raw FROM s2),\n"
    "s4 AS (SELECT *, list_filter([" + ", ".join(f"sign(score_{k})" for k in _COMP) + "], lambda x: x IS NOT NULL AND x <> 0) AS signs FROM s3),\n"
    f"flow AS (SELECT *, {r('raw', 2)} AS score, CASE WHEN NOT available THEN 'INSUFFICIENT' WHEN raw >= 50 THEN 'STRONG_ACCUMULATION' WHEN raw >= 20 THEN 'ACCUMULATION' WHEN raw <= -50 THEN 'STRONG_DISTRIBUTION' WHEN raw <= -20 THEN 'DISTRIBUTION' ELSE 'NEUTRAL' END AS signal, "
    + r("CASE WHEN available THEN least(72e0, 25 + coverage * 30 + least(sample_size, 60) / 60 * 10 + CASE WHEN len(signs) > 0 THEN len(list_filter(signs, lambda x: x = sign(raw))) / len(signs) ELSE 0e0 END * 10) ELSE least(35e0, sample_size / 10 * 20 + volume_sample / 8 * 15) END", 2)
    + " AS confidence FROM s4)")


def metrics(spark, d):
    return O.flow_metrics(V.bars(spark, d))


def scored(spark, d):
    return O.flow_score(metrics(spark, d))


@register("flow_01_mfi", S.sql("bars", f"SELECT ticker, trade_date, {r('mfi14', 4)} AS mfi14 FROM m", METRICS))
def mfi(spark, d):
    return metrics(spark, d).select(*KEY, rnd("mfi14", 4).alias("mfi14"))


@register("flow_02_cmf", S.sql("bars", f"SELECT ticker, trade_date, {r('cmf20', 6)} AS cmf20 FROM m", METRICS))
def cmf(spark, d):
    return metrics(spark, d).select(*KEY, rnd("cmf20", 6).alias("cmf20"))


_M = ["directional_notional", "up_down_volume", "obv_slope", "close_location", "relative_volume", "volume_z", "daily_return", "return_5d", "return_20d", "volume_trend_pct"]


@register("flow_03_metrics", S.sql("bars", "SELECT ticker, trade_date, " + ", ".join(f"{r(c, 6)} AS {c}" for c in _M) +
          ", CASE WHEN volume_trend_pct IS NULL THEN 'INSUFFICIENT' WHEN volume_trend_pct >= 0.2 THEN 'RISING' WHEN volume_trend_pct <= -0.2 THEN 'FALLING' ELSE 'STABLE' END AS volume_trend FROM m", METRICS))
def flow_metrics(spark, d):
    return metrics(spark, d).select(*KEY, *[rnd(c, 6).alias(c) for c in _M], "volume_trend")


@register("flow_04_score", S.sql("bars", "SELECT ticker, trade_date, score, signal FROM flow", SCORED))
def score(spark, d):
    return scored(spark, d).select(*KEY, "score", "signal")


@register("flow_04_component_scores", S.sql("bars", "SELECT ticker, trade_date, " + ", ".join(f"score_{k}" for k in _COMP) + " FROM flow", SCORED))
def components(spark, d):
    return scored(spark, d).select(*KEY, *[f"score_{k}" for k in O.COMPONENT_WEIGHTS])


@register("flow_05_signal_counts", S.sql("bars", "SELECT ticker, signal, count(*) AS days FROM flow GROUP BY 1, 2", SCORED))
def signal_counts(spark, d):
    return scored(spark, d).groupBy("ticker", "signal").agg(F.count("*").alias("days"))


@register("flow_06_confidence", S.sql("bars", "SELECT ticker, trade_date, confidence FROM flow", SCORED))
def confidence(spark, d):
    return scored(spark, d).select(*KEY, "confidence")


_ANOM = """list_filter([CASE WHEN relative_volume >= 1.5 AND daily_return >= 0.02 THEN 'HIGH_VOLUME_RISE' END, CASE WHEN relative_volume >= 1.5 AND daily_return <= -0.02 THEN 'HIGH_VOLUME_FALL' END,
  CASE WHEN return_5d >= 0.03 AND cmf20 <= -0.05 THEN 'PRICE_FLOW_BEARISH_DIVERGENCE' END, CASE WHEN return_5d <= -0.03 AND cmf20 >= 0.05 THEN 'PRICE_FLOW_BULLISH_DIVERGENCE' END,
  CASE WHEN relative_volume >= 1.5 AND close_location >= 0.65 THEN 'HIGH_VOLUME_CLOSE_NEAR_HIGH' END, CASE WHEN relative_volume >= 1.5 AND close_location <= -0.65 THEN 'HIGH_VOLUME_CLOSE_NEAR_LOW' END], lambda x: x IS NOT NULL)"""


@register("flow_07_anomalies", S.sql("bars", f"SELECT ticker, trade_date, array_to_string({_ANOM}, ',') AS codes FROM m WHERE len({_ANOM}) > 0", METRICS))
def anomalies(spark, d):
    return O.anomalies(metrics(spark, d)).where(F.size("anomalies") > 0).select(*KEY, F.array_join(F.col("anomalies.code"), ",").alias("codes"))


_EV = "SELECT ticker, trade_date, string_agg(key, ',' ORDER BY rn) AS evidence, count(*) AS items FROM (SELECT ticker, trade_date, key, row_number() OVER (PARTITION BY ticker, trade_date ORDER BY abs(sc * wt) DESC, i) AS rn FROM (" + " UNION ALL ".join(
    f"SELECT ticker, trade_date, '{k}' AS key, {i} AS i, score_{k} AS sc, {w}e0 AS wt FROM flow WHERE score_{k} IS NOT NULL" for i, (k, (_, w)) in enumerate(_COMP.items())) + ")) WHERE rn <= 4 GROUP BY 1, 2"


@register("top_02_evidence", S.sql("bars", _EV, SCORED))
def evidence(spark, d):
    e = O.evidence_top(scored(spark, d)).where(F.size("evidence") > 0)
    return e.select(*KEY, F.array_join(F.col("evidence.key"), ",").alias("evidence"), F.size("evidence").alias("items"))


@register("flow_08_evidence_directions", S.sql("bars", "SELECT ticker, key, direction, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT ticker, '{k}' AS key, CASE WHEN score_{k} > 8 THEN 'INFLOW' WHEN score_{k} < -8 THEN 'OUTFLOW' ELSE 'NEUTRAL' END AS direction FROM flow WHERE score_{k} IS NOT NULL" for k in _COMP) + ") GROUP BY 1, 2, 3", SCORED))
def evidence_directions(spark, d):
    e = O.evidence_top(scored(spark, d), len(_COMP)).select("ticker", F.explode("evidence").alias("e"))
    return e.groupBy("ticker", F.col("e.key").alias("key"), F.col("e.direction").alias("direction")).agg(F.count("*").alias("n"))


@register("flow_09_recent_days_with_ticks", S.sql("tick_day_bars ticks", f"""SELECT flow.ticker, flow.trade_date, score, signal, buy_count, sell_count FROM flow
  LEFT JOIN (SELECT ticker, trade_date, count(*) FILTER (WHERE direction = 'BUY') AS buy_count, count(*) FILTER (WHERE direction = 'SELL') AS sell_count FROM ticks GROUP BY 1, 2) t USING (ticker, trade_date)
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) <= 10""", SCORED.replace("FROM bars", "FROM tick_day_bars")))
def recent_days(spark, d):
    from pyspark.sql import Window
    f = O.flow_score(O.flow_metrics(V.tick_day_bars(spark, d)))
    t = V.ticks(spark, d).groupBy("ticker", "trade_date").agg(F.count_if(F.col("direction") == "BUY").alias("buy_count"), F.count_if(F.col("direction") == "SELL").alias("sell_count"))
    f = f.withColumn("_r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("trade_date").desc()))).where("_r <= 10")
    return f.join(t, KEY, "left").select(*KEY, "score", "signal", "buy_count", "sell_count")


@register("flow_10_volume_alerts", S.sql("bars", f"SELECT ticker, trade_date, 'CAPITAL_FLOW:' || ticker || ':' || trade_date || ':' || code AS event_key, CASE WHEN code IN ('HIGH_VOLUME_FALL', 'HIGH_VOLUME_CLOSE_NEAR_LOW') THEN 'P1' ELSE 'P2' END AS severity FROM (SELECT ticker, trade_date, unnest({_ANOM}) AS code FROM m)", METRICS))
def alerts(spark, d):
    return O.volume_alerts(metrics(spark, d)).select(*KEY, "event_key", "severity")


@register("flow_11_market_overlay", S.sql("bars", f"""SELECT b.ticker, b.trade_date, {r('s.sma', 4)} AS market_sma200, {r('s.ret', 6)} AS market_return_20d, s.close < s.sma AS risk_off FROM bars b LEFT JOIN
  (SELECT trade_date, close, CASE WHEN count(*) OVER f = 200 THEN avg(close) OVER f END AS sma, close / lag(close, 20) OVER (ORDER BY trade_date) - 1 AS ret FROM bars WHERE ticker = 'T00'
   WINDOW f AS (ORDER BY trade_date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)) s USING (trade_date)"""))
def overlay(spark, d):
    b = V.bars(spark, d)
    return O.market_overlay(b, b.where("ticker = 'T00'")).select(*KEY, rnd("market_sma200", 4).alias("market_sma200"), rnd("market_return_20d", 6).alias("market_return_20d"), "risk_off")


@register("flow_12_adjusted_flow", S.sql("bars", "SELECT ticker, trade_date, score, signal FROM flow", "adj AS (SELECT ticker, trade_date, open * k AS open, high * k AS high, low * k AS low, close * k AS close, volume FROM (SELECT *, CASE WHEN year(trade_date) < 1998 THEN 0.5e0 ELSE 1e0 END AS k FROM bars)),\n" + SCORED.replace("FROM bars", "FROM adj")))
def adjusted(spark, d):
    b = V.bars(spark, d).withColumn("adjusted_close", F.col("close") * F.when(F.year("trade_date") < 1998, 0.5).otherwise(1.0))
    return O.flow_score(O.flow_metrics(O.adjusted_bars(b))).select(*KEY, "score", "signal")
