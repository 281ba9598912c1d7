"""Tick flow (TICK-*) and streaming (STM-*)."""
from pyspark.sql import functions as F, types as T

from marketloom.functions.scalar import rnd
from marketloom.operators import ticks as O
from marketloom.plans import sqlviews as S
from marketloom.plans.registry import register
from marketloom.sources import views as V
from marketloom.sources.shared import shared_dir
from marketloom.streaming import ticks as ST

r = S.rnd
KEY = ["ticker", "trade_date"]
DAY = """dd AS (SELECT ticker, trade_date, coalesce(CAST(sum(CAST(price * volume AS DECIMAL(28,6))) FILTER (WHERE direction = 'BUY') AS DOUBLE), 0) AS buy_turnover,
  coalesce(CAST(sum(CAST(price * volume AS DECIMAL(28,6))) FILTER (WHERE direction = 'SELL') AS DOUBLE), 0) AS sell_turnover, coalesce(CAST(sum(CAST(price * volume AS DECIMAL(28,6))) FILTER (WHERE direction = 'NEUTRAL') AS DOUBLE), 0) AS neutral_turnover,
  count(*) FILTER (WHERE direction <> 'NEUTRAL') AS active_count, count(*) AS tick_count, count(DISTINCT date_trunc('minute', trade_time)) AS tick_minutes, arg_max(price, (trade_time, sequence)) AS latest_price FROM ticks GROUP BY 1, 2),
smp AS (SELECT ticker, trade_date, direction, price * volume AS t FROM ticks WHERE direction <> 'NEUTRAL'),
lim AS (SELECT ticker, trade_date, count(*) AS large_sample, CASE WHEN count(*) >= 20 THEN quantile_cont(t, 0.95) END AS lim FROM smp GROUP BY 1, 2),
lg AS (SELECT ticker, trade_date, any_value(lim) AS large_threshold, any_value(large_sample) AS large_sample, coalesce(CAST(sum(CAST(t AS DECIMAL(28,6))) FILTER (WHERE t >= lim AND direction = 'BUY') AS DOUBLE), 0) AS lb,
  coalesce(CAST(sum(CAST(t AS DECIMAL(28,6))) FILTER (WHERE t >= lim AND direction = 'SELL') AS DOUBLE), 0) AS ls FROM smp JOIN lim USING (ticker, trade_date) GROUP BY 1, 2),
mb AS (SELECT *, close * volume AS t, sign(close - lag(close) OVER (PARTITION BY ticker, trade_date ORDER BY bar_time)) AS s FROM minute_bars),
vw AS (SELECT ticker, trade_date, count(*) AS bar_count, CAST(sum(CAST(t AS DECIMAL(28,6))) AS DOUBLE) / sum(volume) AS vwap, CAST(sum(CAST(s * t AS DECIMAL(28,6))) AS DOUBLE) / nullif(CAST(sum(CAST(CASE WHEN s IS NOT NULL THEN t END AS DECIMAL(28,6))) AS DOUBLE), 0) AS minute_ratio FROM mb GROUP BY 1, 2),
j AS (SELECT *, buy_turnover + sell_turnover AS act, CASE WHEN buy_turnover + sell_turnover > 0 THEN (buy_turnover - sell_turnover) / (buy_turnover + sell_turnover) END AS active_ratio, CASE WHEN lb + ls > 0 THEN (lb - ls) / (lb + ls) END AS large_ratio,
  latest_price / vwap - 1 AS price_vs_vwap, least(1e0, tick_minutes / bar_count) AS cov, least(1e0, bar_count / 390) AS prog, active_count / tick_count AS count_cov FROM dd LEFT JOIN lg USING (ticker, trade_date) LEFT JOIN vw USING (ticker, trade_date)),
jj AS (SELECT *, active_count >= 10 AND act > 0 AS available FROM j),
k AS (SELECT *, CASE WHEN available THEN least(greatest((active_ratio * 60 + coalesce(large_ratio, 0) * 20) * (0.35e0 + 0.65e0 * sqrt(cov)) + CASE WHEN minute_ratio IS NULL THEN 0 ELSE minute_ratio * 10 + least(greatest(price_vs_vwap * 1000, -10), 10) END, -100), 100)
  WHEN minute_ratio IS NOT NULL THEN least(greatest(minute_ratio * 45, -45), 45) ELSE 0 END AS raw FROM jj)"""


def flow(spark, d):
    return O.intraday_flow(V.ticks(spark, d), V.minute_bars(spark, d))


@register("tick_01_daily_direction", S.sql("ticks minute_bars", f"SELECT ticker, trade_date, buy_turnover, sell_turnover, neutral_turnover, tick_count, {r('active_ratio', 6)} AS active_ratio, {r('act / (act + neutral_turnover)', 6)} AS direction_coverage, {r('count_cov', 6)} AS count_coverage FROM j", DAY))
def direction(spark, d):
    return O.daily_direction(V.ticks(spark, d)).select(*KEY, "buy_turnover", "sell_turnover", "neutral_turnover", "tick_count", *[rnd(c, 6).alias(c) for c in ("active_ratio", "direction_coverage", "count_coverage")])


@register("tick_02_large_trades", S.sql("ticks minute_bars", f"SELECT ticker, trade_date, {r('large_threshold', 4)} AS large_threshold, large_sample, lb AS large_buy_turnover, ls AS large_sell_turnover, {r('CASE WHEN lb + ls > 0 THEN (lb - ls) / (lb + ls) END', 6)} AS large_ratio FROM lg", DAY))
def large(spark, d):
    return O.large_trades(V.ticks(spark, d)).select(*KEY, rnd("large_threshold", 4).alias("large_threshold"), "large_sample", "large_buy_turnover", "large_sell_turnover", rnd("large_ratio", 6).alias("large_ratio"))


@register("tick_03_vwap", S.sql("ticks minute_bars", f"SELECT ticker, trade_date, {r('vwap', 6)} AS vwap, {r('price_vs_vwap', 6)} AS price_vs_vwap FROM j", DAY))
def vwap(spark, d):
    return flow(spark, d).select(*KEY, rnd("vwap", 6).alias("vwap"), rnd("price_vs_vwap", 6).alias("price_vs_vwap"))


@register("tick_04_minute_direction", S.sql("ticks minute_bars", f"SELECT ticker, trade_date, bar_count, {r('minute_ratio', 6)} AS minute_ratio FROM vw", DAY))
def minute_direction(spark, d):
    return O.vwap_and_minute_direction(V.minute_bars(spark, d)).select(*KEY, "bar_count", rnd("minute_ratio", 6).alias("minute_ratio"))


@register("tick_05_score", S.sql("ticks minute_bars", f"""SELECT ticker, trade_date, {r('raw', 2)} AS score, CASE WHEN NOT available AND bar_count < 10 THEN 'INSUFFICIENT' WHEN raw >= 35 THEN 'STRONG_INFLOW' WHEN raw >= 12 THEN 'INFLOW' WHEN raw <= -35 THEN 'STRONG_OUTFLOW' WHEN raw <= -12 THEN 'OUTFLOW' ELSE 'NEUTRAL' END AS signal,
  {r('CASE WHEN available THEN least(90, 20 + least(tick_count, 1500) / 1500 * 35 + count_cov * 25 + least(bar_count, 390) / 390 * 10) * (0.4e0 + 0.6e0 * cov) * (0.55e0 + 0.45e0 * sqrt(prog)) ELSE least(35, least(bar_count, 390) / 390 * 35) END', 2)} AS confidence FROM k""", DAY))
def score(spark, d):
    return flow(spark, d).select(*KEY, "score", "signal", "confidence")


@register("tick_06_imbalances", S.sql("ticks minute_bars", """SELECT ticker, trade_date, CASE WHEN active_ratio > 0 THEN 'ACTIVE_BUY_IMBALANCE' ELSE 'ACTIVE_SELL_IMBALANCE' END AS code, CASE WHEN abs(active_ratio) >= 0.45 THEN 'P1' ELSE 'P2' END AS severity FROM k WHERE available AND abs(active_ratio) >= 0.25
  UNION ALL SELECT ticker, trade_date, CASE WHEN large_ratio > 0 THEN 'LARGE_BUY_IMBALANCE' ELSE 'LARGE_SELL_IMBALANCE' END, 'P2' FROM k WHERE abs(large_ratio) >= 0.35""", DAY))
def imbalances(spark, d):
    return O.imbalance_flags(flow(spark, d)).select(*KEY, F.explode("anomalies").alias("a")).select(*KEY, "a.code", "a.severity")


@register("tick_07_data_level", S.sql("ticks minute_bars", "SELECT ticker, trade_date, CASE WHEN available THEN CASE WHEN cov >= 0.5 THEN 'TICK_DIRECTION' ELSE 'TICK_DIRECTION_PARTIAL' END WHEN bar_count > 0 THEN 'MINUTE_PROXY' ELSE 'NO_INTRADAY_DATA' END AS data_level FROM k", DAY))
def level(spark, d):
    return flow(spark, d).select(*KEY, "data_level")


MIN = """SELECT ticker, trade_date, date_trunc('minute', trade_time) AS minute, CAST(sum(CAST(CASE WHEN direction = 'BUY' THEN price * volume ELSE 0 END AS DECIMAL(28,6))) AS DOUBLE) AS buy_turnover,
  CAST(sum(CAST(CASE WHEN direction = 'SELL' THEN price * volume ELSE 0 END AS DECIMAL(28,6))) AS DOUBLE) AS sell_turnover, count(*) FILTER (WHERE direction = 'BUY') AS buy_count, count(*) FILTER (WHERE direction = 'SELL') AS sell_count,
  count(*) FILTER (WHERE direction = 'NEUTRAL') AS neutral_count, sum(volume) AS volume, arg_max(price, (trade_time, sequence)) AS last_price FROM ticks GROUP BY ALL"""
MIN_COLS = ["ticker", "trade_date", "minute", "buy_turnover", "sell_turnover", "buy_count", "sell_count", "neutral_count", "volume", "last_price"]


@register("tick_08_minutes_latest", S.sql("ticks", f"SELECT * FROM ({MIN}) ORDER BY minute DESC, ticker"))
def minutes(spark, d):
    return O.minute_flow(V.ticks(spark, d)).select(*MIN_COLS).orderBy(F.col("minute").desc(), "ticker")


@register("stm_05_minute_rebuild", S.sql("ticks", MIN))
def rebuild(spark, d):
    return O.minute_flow(V.ticks(spark, d)).select(*MIN_COLS)


EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
                       T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def _ticks_of(events):
    et = F.col("event_type")
    return events.select(V.ticker_of("user_id").alias("ticker"), F.col("event_id").alias("sequence"), F.col("ts").cast("timestamp").alias("trade_time"),
                         F.to_date("ts").alias("trade_date"), F.col("value").alias("price"), (1 + F.col("event_id") % 50).cast("double").alias("volume"),
                         F.when(et.isin("purchase", "click"), "buy").when(et == "error", "Sell").otherwise("other").alias("direction"))


def tick_stream(spark, d):
    return ST.read_tick_stream(spark, d, "events*.parquet", EVENTS, _ticks_of)


def late_tick_stream(spark, d):
    """The events out of order in several files, one file a batch: most ticks come days after later ones."""
    folder = shared_dir(spark, "event-files")
    V.table(spark, d, "events").repartition(4, F.xxhash64("event_id")).write.parquet(folder)
    return ST.read_tick_stream(spark, folder, "*.parquet", EVENTS, _ticks_of, files_per_batch=1)


@register("stm_04_minute_stream", S.sql("ticks", f"SELECT * EXCLUDE (trade_date) FROM ({MIN})"))
def minute_stream(spark, d):
    out = ST.minute_flow_table(late_tick_stream(spark, d))
    return out.select("ticker", F.col("minute").cast("timestamp_ntz").alias("minute"), *MIN_COLS[3:])


@register("stm_09_day_stream", S.sql("ticks minute_bars", f"SELECT ticker, trade_date, buy_turnover, sell_turnover, neutral_turnover, {r('active_ratio', 6)} AS active_ratio FROM j", DAY))
def day_stream(spark, d):
    out = ST.day_flow_table(late_tick_stream(spark, d))
    return out.select(*KEY, "buy_turnover", "sell_turnover", "neutral_turnover", rnd("active_ratio", 6).alias("active_ratio"))


@register("stm_03_exactly_once", S.sql("ticks", "SELECT ticker, trade_date, sequence, price FROM ticks"))
def once(spark, d):
    s = late_tick_stream(spark, d)
    return ST.run_to_table(ST.exactly_once(s.unionByName(tick_stream(spark, d))), "append", None, "dedupe").select(*KEY, "sequence", "price")


@register("stm_01_event_lines", S.sql("ticks", "SELECT ticker, sequence, trade_date, price, volume, upper(direction) AS direction FROM ticks"))
def lines(spark, d):
    """Ticks framed as prefixed JSON lines between unprefixed noise, parsed back."""
    t = V.ticks(spark, d).withColumn("trade_time", F.col("trade_time").cast("timestamp"))
    body = F.concat(F.lit(ST.LINE_PREFIX), F.to_json(F.struct("ticker", "sequence", "trade_time", "trade_date", "price", "volume", "direction")))
    framed = t.select(F.explode(F.array(body, F.lit("log: heartbeat"), F.lit(ST.LINE_PREFIX + "{broken"))).alias("value"))
    return ST.parse_event_lines(framed).select("ticker", "sequence", "trade_date", "price", "volume", "direction")


@register("stm_02_normalize", S.sql("ticks", "SELECT ticker, sequence, direction, price * volume AS turnover FROM ticks"))
def normalize(spark, d):
    raw = _ticks_of(V.table(spark, d, "events")).withColumn("direction", F.when(F.col("direction") == "buy", " BUY ").otherwise(F.col("direction")))
    return O.normalize_ticks(raw).select("ticker", "sequence", "direction", "turnover")


@register("stm_10_alert_once", S.sql("ticks", "SELECT DISTINCT 'FLOW:' || ticker || ':' || trade_date AS event_key FROM ticks WHERE direction = 'SELL'"))
def alert_once(spark, d):
    s = late_tick_stream(spark, d).where("direction = 'Sell'")
    a = s.select(F.concat_ws(":", F.lit("FLOW"), "ticker", F.col("trade_date").cast("string")).alias("event_key"), "trade_time")
    return ST.run_to_table(ST.alerts_once(a), "append", None, "alerts").select("event_key")


@register("stm_11_first_sync_silent", S.sql("ticks", "SELECT ticker, sequence FROM ticks t WHERE trade_time > (SELECT min(trade_time) + INTERVAL 10 DAY FROM ticks u WHERE u.ticker = t.ticker)"))
def first_sync(spark, d):
    f = V.ticks(spark, d).groupBy("ticker").agg((F.min("trade_time").cast("timestamp") + F.expr("INTERVAL 10 DAY")).alias("first_sync"))
    s = tick_stream(spark, d)
    return ST.run_to_table(ST.news_only_after_first_sync(s, f, "ticker", "trade_time"), "append", None, "first-sync").select("ticker", "sequence")


@register("stm_12_sliding_day", S.sql("ticks", f"""SELECT ticker, window_end, c AS current_24h, p AS previous_24h, t AS total_168h, CASE WHEN p > 0 THEN {r('(c - p) / p', 4)} END AS buzz_change FROM (
  SELECT g.ticker, g.e AS window_end, coalesce(sum(h.n) FILTER (WHERE h.hr >= g.e - INTERVAL 24 HOUR), 0) AS c, coalesce(sum(h.n) FILTER (WHERE h.hr < g.e - INTERVAL 24 HOUR AND h.hr >= g.e - INTERVAL 48 HOUR), 0) AS p, coalesce(sum(h.n), 0) AS t
  FROM (SELECT ticker, unnest(generate_series(min(date_trunc('hour', trade_time)) + INTERVAL 1 HOUR, max(date_trunc('hour', trade_time)) + INTERVAL 168 HOUR, INTERVAL 1 HOUR)) AS e FROM ticks GROUP BY 1) g
  LEFT JOIN (SELECT ticker, date_trunc('hour', trade_time) AS hr, count(*) AS n FROM ticks GROUP BY 1, 2) h ON h.ticker = g.ticker AND h.hr < g.e AND h.hr >= g.e - INTERVAL 168 HOUR GROUP BY 1, 2)"""))
def sliding(spark, d):
    panes = ST.run_to_table(late_tick_stream(spark, d), "append", None, "panes", ST.hourly_panes("ticker", "trade_time"))
    return ST.sliding_totals(panes, "ticker").withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@register("stm_08_bar_upsert", S.sql("ticks minute_bars", "SELECT ticker, bar_time, close * 1.001e0 AS close, minute(bar_time) % 2 = 0 AS is_final FROM minute_bars"))
def bar_upsert(spark, d):
    b = V.minute_bars(spark, d).select("ticker", "bar_time", "close")
    first = b.withColumns({"is_final": F.minute("bar_time") % 2 == 0, "ingested_at": F.lit(1)})
    second = b.withColumns({"close": F.col("close") * 1.001, "is_final": F.lit(False), "ingested_at": F.lit(2)})
    return ST.upsert_final_bars(first, second, ["ticker", "bar_time"]).select("ticker", "bar_time", "close", "is_final")
