"""Window operators over the daily bars (WIN-*)."""
from pyspark.sql import Window, functions as F

from marketloom.functions.scalar import rnd
from marketloom.operators import series as O
from marketloom.plans import sqlviews as S
from marketloom.plans.registry import register
from marketloom.sources import views as V

r = S.rnd
W = "WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)"
KEY = ["ticker", "trade_date"]


@register("win_01_canonical_bar", S.sql("provider_bars", f"""SELECT ticker, trade_date, provider, {r('close', 6)} AS close FROM provider_bars
  QUALIFY row_number() OVER (PARTITION BY ticker, trade_date ORDER BY CASE WHEN provider = 'manual' THEN 0 ELSE 1 END, ingested_at DESC) = 1"""))
def canonical(spark, d):
    return O.canonical_bars(V.provider_bars(spark, d)).select(*KEY, "provider", rnd("close", 6).alias("close"))


@register("win_02_session_no", S.sql("bars", f"SELECT ticker, trade_date, row_number() OVER w AS session_no FROM bars {W}"))
def session_no(spark, d):
    return V.bars(spark, d).select(*KEY, O.session_no(O.over()).alias("session_no"))


@register("win_03_recent_three", S.sql("bars", f"""SELECT ticker, trade_date, row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) AS recency
  FROM bars QUALIFY recency <= 3"""))
def recent(spark, d):
    w = Window.partitionBy("ticker").orderBy(F.col("trade_date").desc())
    return V.bars(spark, d).select(*KEY, F.row_number().over(w).alias("recency")).where("recency <= 3")


@register("win_04_lagged_returns", S.sql("bars", "SELECT ticker, trade_date, " + ", ".join(
    f"{r(f'close / lag(close, {n}) OVER w - 1', 6)} AS return_{n}d" for n in (5, 20, 21, 63, 126)) + f" FROM bars {W}"))
def lagged(spark, d):
    w = O.over()
    return V.bars(spark, d).select(*KEY, *[rnd(O.returns("close", n, w), 6).alias(f"return_{n}d") for n in (5, 20, 21, 63, 126)])


F20 = "OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
P20 = "OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@register("win_05_rolling_20", S.sql("bars", f"""SELECT ticker, trade_date, CASE WHEN count(close) {F20} >= 20 THEN {r(f'avg(close) {F20}', 6)} END AS sma20,
  CASE WHEN count(volume) {F20} >= 20 THEN sum(volume) {F20} END AS volume20, CASE WHEN count(high) {F20} >= 20 THEN {r(f'max(high) {F20}', 6)} END AS high20,
  CASE WHEN count(low) {F20} >= 20 THEN {r(f'min(low) {F20}', 6)} END AS low20 FROM bars"""))
def rolling(spark, d):
    w = O.over()
    return V.bars(spark, d).select(
        *KEY, rnd(O.rolling(F.avg, "close", 20, w), 6).alias("sma20"), O.rolling(F.sum, "volume", 20, w).alias("volume20"),
        rnd(O.rolling(F.max, "high", 20, w), 6).alias("high20"), rnd(O.rolling(F.min, "low", 20, w), 6).alias("low20"))


@register("win_06_prior_20", S.sql("bars", f"""SELECT ticker, trade_date, CASE WHEN count(high) {P20} >= 20 THEN {r(f'max(high) {P20}', 6)} END AS breakout_high,
  CASE WHEN count(volume) {P20} >= 20 THEN {r(f'avg(volume) {P20}', 6)} END AS volume_base, CASE WHEN count(low) {P20} >= 20 THEN {r(f'min(low) {P20}', 6)} END AS prior_low FROM bars"""))
def prior(spark, d):
    w = O.over()
    return V.bars(spark, d).select(
        *KEY, rnd(O.rolling(F.max, "high", 20, w, offset=1), 6).alias("breakout_high"),
        rnd(O.rolling(F.avg, "volume", 20, w, offset=1), 6).alias("volume_base"),
        rnd(O.rolling(F.min, "low", 20, w, offset=1), 6).alias("prior_low"))


@register("win_07_true_range_atr", S.sql("bars", f"""SELECT ticker, trade_date, {r('tr', 6)} AS true_range, CASE WHEN count(tr) OVER f >= 14 THEN {r('avg(tr) OVER f', 6)} END AS atr14 FROM t
  WINDOW f AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""",
    f"""t AS (SELECT ticker, trade_date, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars {W})"""))
def atr(spark, d):
    w = O.over()
    b = V.bars(spark, d).withColumn("tr", O.true_range(w))
    return b.select(*KEY, rnd("tr", 6).alias("true_range"), rnd(O.rolling(F.avg, "tr", 14, w), 6).alias("atr14"))


ALPHA20 = 2 / 21


@register("win_08_ema20", S.sql("bars", f"""SELECT ticker, trade_date, CASE WHEN row_number() OVER w >= 20 THEN {r(f'''list_reduce(list(close) OVER (PARTITION BY ticker ORDER BY trade_date
  ROWS BETWEEN 400 PRECEDING AND CURRENT ROW), lambda a, v: a * (1 - 2e0 / 21e0) + v * (2e0 / 21e0))''', 4)} END AS ema20 FROM bars {W}"""))
def ema20(spark, d):
    return O.ema(V.bars(spark, d), "close", "ema20", ALPHA20, ["ticker"], "trade_date", 20).select(*KEY, rnd("ema20", 4).alias("ema20"))


_RSI = """c AS (SELECT ticker, trade_date, close - lag(close) OVER (PARTITION BY ticker ORDER BY trade_date) AS diff FROM bars),
g AS (SELECT ticker, trade_date, diff, greatest(diff, 0e0) AS gain, greatest(-diff, 0e0) AS loss FROM c WHERE diff IS NOT NULL),
m AS (SELECT ticker, trade_date, row_number() OVER (PARTITION BY ticker ORDER BY trade_date) AS n,
  list_reduce(list(gain) OVER f, lambda a, v: a * 0.5e0 + v * 0.5e0) AS g, list_reduce(list(loss) OVER f, lambda a, v: a * 0.5e0 + v * 0.5e0) AS l FROM g
  WINDOW f AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 80 PRECEDING AND CURRENT ROW))"""


@register("win_09_rsi2", S.sql("bars", f"""SELECT bars.ticker, bars.trade_date, CASE WHEN n >= 2 THEN CASE WHEN g + l = 0 THEN 50 ELSE {r('100 * g / (g + l)', 4)} END END AS rsi2
  FROM bars LEFT JOIN m USING (ticker, trade_date)""", _RSI))
def rsi2(spark, d):
    return O.rsi(V.bars(spark, d), "rsi2", 0.5, ["ticker"], "trade_date").select(*KEY, rnd("rsi2", 4).alias("rsi2"))


@register("win_10_volatility_20d", S.sql("bars", f"""SELECT ticker, trade_date, {r('stddev_samp(ret) OVER f', 8)} AS volatility_20d FROM t
  WINDOW f AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    f"t AS (SELECT ticker, trade_date, close / lag(close) OVER w - 1 AS ret FROM bars {W})"))
def volatility(spark, d):
    w = O.over()
    b = V.bars(spark, d).withColumn("ret", O.returns("close", 1, w))
    return b.select(*KEY, rnd(F.stddev_samp("ret").over(O.trailing(20, w)), 8).alias("volatility_20d"))


@register("win_11_volume_zscore", S.sql("bars", f"""SELECT ticker, trade_date, {r(f'volume / avg(volume) {P20}', 6)} AS relative_volume,
  CASE WHEN stddev_samp(volume) {P20} > 0 THEN {r(f'(volume - avg(volume) {P20}) / stddev_samp(volume) {P20}', 6)} END AS volume_z FROM bars"""))
def zscore(spark, d):
    w = O.over()
    return V.bars(spark, d).select(*KEY, rnd(F.col("volume") / F.avg("volume").over(O.trailing(20, w, 1)), 6).alias("relative_volume"),
                                   rnd(O.zscore_vs_prior("volume", 20, w), 6).alias("volume_z"))


@register("win_12_drawdown", S.sql("bars", f"""SELECT ticker, {r('min(dd)', 6)} AS max_drawdown, arg_min(trade_date, (dd, trade_date)) AS trough_date, arg_min(peak_date, (dd, trade_date)) AS peak_date
  FROM (SELECT *, close / peak - 1 AS dd, max(CASE WHEN close = peak AND prev_peak IS DISTINCT FROM peak THEN trade_date END) OVER (PARTITION BY ticker ORDER BY trade_date) AS peak_date
        FROM (SELECT *, lag(peak) OVER (PARTITION BY ticker ORDER BY trade_date) AS prev_peak FROM p)) GROUP BY ticker""",
    "p AS (SELECT ticker, trade_date, close, max(close) OVER (PARTITION BY ticker ORDER BY trade_date) AS peak FROM bars)"))
def max_drawdown(spark, d):
    w = O.over()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    b = V.bars(spark, d).withColumns({"dd": O.drawdown("close", w), "peak": F.max("close").over(upto)})
    b = b.withColumn("_new", ~F.col("peak").eqNullSafe(F.lag("peak").over(w)))
    b = b.withColumn("peak_date", F.max(F.when(F.col("_new"), F.col("trade_date"))).over(upto))
    at = F.struct("dd", "trade_date")
    return b.groupBy("ticker").agg(rnd(F.min("dd"), 6).alias("max_drawdown"), F.min_by("trade_date", at).alias("trough_date"),
                                   F.min_by("peak_date", at).alias("peak_date"))


@register("win_13_running_position", S.sql("trades", """SELECT id, ticker, CAST(sum(CAST(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END AS DECIMAL(18,6))) OVER w AS DOUBLE) AS position,
  CAST(sum(CAST(CASE side WHEN 'BUY' THEN -1 ELSE 1 END * quantity * price - fee AS DECIMAL(18,6))) OVER w AS DOUBLE) AS cash
  FROM trades WINDOW w AS (PARTITION BY ticker ORDER BY trade_date, id)"""))
def running_position(spark, d):
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    t = O.running_total(V.trades(spark, d), ["ticker"], "trade_date", ["id"], {
        "position": (sign * F.col("quantity")).cast("decimal(18,6)"),
        "cash": (-sign * F.col("quantity") * F.col("price") - F.col("fee")).cast("decimal(18,6)")})
    return t.select("id", "ticker", F.col("position").cast("double").alias("position"), F.col("cash").cast("double").alias("cash"))


@register("win_14_up_streak", S.sql("bars", """SELECT ticker, trade_date, CASE WHEN up THEN count(*) FILTER (WHERE up) OVER (PARTITION BY ticker, island ORDER BY trade_date) ELSE 0 END AS up_streak
  FROM (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY trade_date) AS island FROM u)""",
    f"u AS (SELECT ticker, trade_date, coalesce(close > lag(close) OVER w, false) AS up FROM bars {W})"))
def up_streak(spark, d):
    w = O.over()
    return V.bars(spark, d).withColumn("up", F.col("close") > F.lag("close").over(w)).select(
        *KEY, O.streak(F.col("up"), w).cast("long").alias("up_streak"))


F5 = "OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@register("win_15_days_above", S.sql("bars", f"""SELECT ticker, trade_date, count(*) FILTER (WHERE ret >= 0.01) {F5} AS up_days_5, count(*) FILTER (WHERE ret <= -0.01) {F5} AS down_days_5 FROM t""",
    f"t AS (SELECT ticker, trade_date, close / lag(close) OVER w - 1 AS ret FROM bars {W})"))
def days_above(spark, d):
    w = O.over()
    b = V.bars(spark, d).withColumn("ret", O.returns("close", 1, w))
    f = O.trailing(5, w)
    return b.select(*KEY, F.count_if(F.col("ret") >= 0.01).over(f).alias("up_days_5"), F.count_if(F.col("ret") <= -0.01).over(f).alias("down_days_5"))


def _rank_sql(part):
    return f"""(rank() OVER (PARTITION BY {part} ORDER BY volume) + (count(*) OVER (PARTITION BY {part}, volume) - 1) / 2e0) / count(*) OVER (PARTITION BY {part})"""


@register("win_16_cross_rank", S.sql("bars", f"SELECT ticker, trade_date, {r(_rank_sql('trade_date'), 8)} AS volume_rank FROM bars"))
def cross_rank(spark, d):
    return V.bars(spark, d).select(*KEY, rnd(O.average_tie_rank("volume", ["trade_date"]), 8).alias("volume_rank"))


@register("win_17_group_rank", S.sql("bars securities", f"SELECT ticker, trade_date, sector, {r(_rank_sql('trade_date, sector'), 8)} AS volume_rank FROM bars JOIN securities USING (ticker)"))
def group_rank(spark, d):
    b = V.bars(spark, d).join(V.securities(spark, d), "ticker")
    return b.select(*KEY, "sector", rnd(O.average_tie_rank("volume", ["trade_date", "sector"]), 8).alias("volume_rank"))


@register("win_18_previous_row", S.sql("bars", f"""SELECT ticker, trade_date, lag(trade_date) OVER w AS previous_date, {r('close - lag(close) OVER w', 6)} AS close_change,
  volume - lag(volume) OVER w AS volume_change FROM bars {W}"""))
def previous_row(spark, d):
    w = O.over()
    b = V.bars(spark, d).withColumn("p", F.lag(F.struct("trade_date", "close", "volume")).over(w))
    return b.select(*KEY, F.col("p.trade_date").alias("previous_date"), rnd(F.col("close") - F.col("p.close"), 6).alias("close_change"),
                    (F.col("volume") - F.col("p.volume")).alias("volume_change"))


@register("win_19_month_end_rows", S.sql("bars", f"""SELECT ticker, trade_date, {r('close', 6)} AS close FROM
  (SELECT ticker, trade_date, close, lead(trade_date) OVER w AS nxt FROM bars {W}) WHERE nxt IS NOT NULL AND month(nxt) <> month(trade_date)"""))
def month_end(spark, d):
    b = V.bars(spark, d).withColumn("nxt", F.lead("trade_date").over(O.over()))
    return b.where("month(nxt) <> month(trade_date)").select(*KEY, rnd("close", 6).alias("close"))


@register("win_20_non_overlapping", S.sql("bars", """SELECT ticker, trade_date, target_date FROM sel""",
    f"""s AS (SELECT ticker, trade_date, lead(trade_date, 5) OVER w AS target_date, volume FROM bars {W}),
sig AS (SELECT ticker, trade_date, target_date, row_number() OVER (PARTITION BY ticker ORDER BY trade_date) AS n FROM s WHERE target_date IS NOT NULL AND volume >= 50),
nx AS (SELECT a.ticker, a.n, a.trade_date, a.target_date, (SELECT min(b.n) FROM sig b WHERE b.ticker = a.ticker AND b.trade_date > a.target_date) AS next_n FROM sig a),
sel AS (WITH RECURSIVE walk AS (SELECT ticker, n, trade_date, target_date, next_n FROM nx WHERE n = 1
  UNION ALL SELECT x.ticker, x.n, x.trade_date, x.target_date, x.next_n FROM walk JOIN nx x ON x.ticker = walk.ticker AND x.n = walk.next_n) SELECT * FROM walk)"""))
def non_overlap(spark, d):
    b = V.bars(spark, d).withColumn("target_date", F.lead("trade_date", 5).over(O.over()))
    sig = b.where("target_date IS NOT NULL AND volume >= 50").select(*KEY, "target_date")
    return O.non_overlapping(sig, ["ticker"], "trade_date", "target_date")


@register("win_21_every_nth", S.sql("bars", f"SELECT ticker, trade_date FROM (SELECT ticker, trade_date, row_number() OVER w - 1 AS i FROM bars {W}) WHERE i % 21 = 0"))
def nth(spark, d):
    return O.every_nth(V.bars(spark, d).select(*KEY), ["ticker"], "trade_date", F.lit(21))


@register("win_22_confirmed_transition", S.sql("bars", f"""SELECT ticker, trade_date, stage, before FROM (SELECT *, lag(stage) OVER w AS p1, lag(stage, 2) OVER w AS before FROM t {W})
  WHERE stage = p1 AND stage <> before""",
    f"t AS (SELECT ticker, trade_date, CASE WHEN close >= avg(close) {F20} THEN 'ABOVE' ELSE 'BELOW' END AS stage FROM bars)"))
def transition(spark, d):
    w = O.over()
    b = V.bars(spark, d).withColumn("stage", F.when(F.col("close") >= F.avg("close").over(O.trailing(20, w)), "ABOVE").otherwise("BELOW"))
    b = b.withColumns({"p1": F.lag("stage").over(w), "before": F.lag("stage", 2).over(w)})
    return b.where("stage = p1 AND stage <> before").select(*KEY, "stage", "before")


_DENSE = """cal AS (SELECT DISTINCT trade_date FROM bars), grid AS (SELECT t.ticker, cal.trade_date, b.close FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN cal
  LEFT JOIN bars b ON b.ticker = t.ticker AND b.trade_date = cal.trade_date)"""


@register("win_23_complete_history", S.sql("bars", """SELECT ticker, trade_date, count(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) = 10 AS complete_10 FROM grid""", _DENSE))
def complete_history(spark, d):
    from marketloom.operators.factors import densify
    g = densify(V.bars(spark, d).select(*KEY, "close"))
    return g.select(*KEY, (F.count("close").over(O.trailing(10, O.over())) == 10).alias("complete_10"))


@register("win_24_skip_month_momentum", S.sql("bars", f"SELECT ticker, trade_date, {r('lag(close, 21) OVER w / lag(close, 252) OVER w - 1', 6)} AS momentum FROM bars {W}"))
def momentum(spark, d):
    w = O.over()
    return V.bars(spark, d).select(*KEY, rnd(F.lag("close", 21).over(w) / F.lag("close", 252).over(w) - 1, 6).alias("momentum"))
