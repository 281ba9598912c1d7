"""Persistent flow stages (BEH-*)."""
from pyspark.sql import functions as F

from marketloom.functions.scalar import rnd
from marketloom.operators import behavior as O, flow as FL, ticks as TK
from marketloom.plans import sqlviews as S
from marketloom.plans.q_flow import SCORED
from marketloom.plans.q_ticks import DAY
from marketloom.plans.registry import register
from marketloom.sources import views as V

r = S.rnd
KEY = ["ticker", "trade_date"]

STAGED = SCORED + f""",
c0 AS (SELECT *, confidence AS daily_confidence FROM flow),
c1 AS (SELECT *, count(*) FILTER (WHERE score >= 15) OVER f5 AS pos, count(*) FILTER (WHERE score <= -15) OVER f5 AS neg, count(*) OVER f5 AS n5, list(score) OVER f5 AS l5 FROM c0
  WINDOW f5 AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
c2 AS (SELECT *, CAST(CASE WHEN score >= 15 THEN coalesce(list_position(list_reverse(list_transform(l5, lambda x: x < 15)), true) - 1, len(l5)) WHEN score <= -15 THEN coalesce(list_position(list_reverse(list_transform(l5, lambda x: x > -15)), true) - 1, len(l5)) ELSE 0 END AS INT) AS streak FROM c1),
c3 AS (SELECT *, CASE WHEN signal = 'INSUFFICIENT' THEN 'INSUFFICIENT' WHEN return_5d >= 0.03 AND score <= -15 AND neg >= 2 THEN 'DISTRIBUTION_INTO_STRENGTH' WHEN return_5d <= -0.03 AND score >= 15 AND pos >= 2 THEN 'ABSORPTION'
  WHEN score >= 40 AND pos >= 3 AND streak >= 2 AND relative_volume >= 1.1 THEN 'ACCELERATED_ACCUMULATION' WHEN score <= -40 AND neg >= 3 AND streak >= 2 AND relative_volume >= 1.1 THEN 'ACCELERATED_DISTRIBUTION'
  WHEN score >= 18 AND pos >= 3 THEN 'ACCUMULATION' WHEN score <= -18 AND neg >= 3 THEN 'DISTRIBUTION' ELSE 'NEUTRAL' END AS stage FROM c2),
st AS (SELECT * REPLACE ({r("CASE WHEN stage = 'INSUFFICIENT' THEN least(35e0, daily_confidence) ELSE least(72e0, daily_confidence * 0.65e0 + least(1e0, n5 / 5) * 10 + greatest(pos, neg) / n5 * 10) END", 2)} AS confidence),
  CASE WHEN stage IN ('ACCELERATED_ACCUMULATION', 'ACCUMULATION', 'ABSORPTION') THEN 'BULLISH' WHEN stage IN ('DISTRIBUTION_INTO_STRENGTH', 'DISTRIBUTION', 'ACCELERATED_DISTRIBUTION') THEN 'BEARISH' ELSE 'NEUTRAL' END AS direction FROM c3)"""


def staged(spark, d):
    return O.stages(O.composite(FL.flow_score(FL.flow_metrics(V.bars(spark, d)))))


@register("beh_02_stages", S.sql("bars", "SELECT ticker, trade_date, stage, direction, pos AS positive_days, neg AS negative_days, streak AS directional_streak FROM st", STAGED))
def stage(spark, d):
    return staged(spark, d).select(*KEY, "stage", "direction", "positive_days", "negative_days", "directional_streak")


@register("beh_03_confidence", S.sql("bars", f"SELECT ticker, trade_date, confidence, {r('greatest(pos, neg) / n5 * 100', 2)} AS persistence FROM st", STAGED))
def confidence(spark, d):
    return staged(spark, d).select(*KEY, "confidence", "persistence")


@register("beh_01_composite_with_ticks", S.sql("tick_day_bars ticks minute_bars", f"""SELECT ticker, trade_date, {r("""least(greatest((fl.score * 0.65e0 + CASE WHEN k.available AND active_ratio IS NOT NULL THEN active_ratio * 100 * 0.25e0 ELSE 0 END + CASE WHEN price_vs_vwap IS NULL THEN 0 ELSE least(greatest(price_vs_vwap * 2000, -100), 100) * 0.1e0 END)
  / (0.65e0 + CASE WHEN k.available AND active_ratio IS NOT NULL THEN 0.25e0 ELSE 0e0 END + CASE WHEN price_vs_vwap IS NULL THEN 0e0 ELSE 0.1e0 END), -100), 100)""", 2)} AS score FROM flow fl LEFT JOIN k USING (ticker, trade_date)""",
    SCORED.replace("FROM bars", "FROM tick_day_bars") + ",\n" + DAY))
def composite(spark, d):
    f = FL.flow_score(FL.flow_metrics(V.tick_day_bars(spark, d)))
    i = TK.intraday_flow(V.ticks(spark, d), V.minute_bars(spark, d))
    return O.composite(f, i).select(*KEY, "score")


VAL = STAGED + ",\nva AS (" + " UNION ALL ".join(
    f"""SELECT ticker, trade_date, {h} AS horizon, stage, direction, confidence, close, lead(trade_date, {h}) OVER w AS td, lead(close, {h}) OVER w AS tc, max(high) OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS hi,
  min(low) OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS lo FROM st WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)""" for h in O.HORIZONS) + f"""),
vb AS (SELECT *, CASE WHEN direction = 'NEUTRAL' THEN 'EXCLUDED' WHEN td IS NULL THEN 'PENDING' ELSE 'MATURED' END AS status FROM va),
val AS (SELECT ticker, trade_date, horizon, stage, direction, confidence, status, CASE WHEN status = 'MATURED' THEN td END AS actual_date, CASE WHEN status = 'MATURED' THEN {r('tc / close - 1', 8)} END AS actual_return,
  CASE WHEN status = 'MATURED' THEN {r("CASE direction WHEN 'BULLISH' THEN greatest(0, hi / close - 1) ELSE greatest(0, 1 - lo / close) END", 8)} END AS favorable,
  CASE WHEN status = 'MATURED' THEN {r("CASE direction WHEN 'BULLISH' THEN least(0, lo / close - 1) ELSE least(0, 1 - hi / close) END", 8)} END AS adverse,
  CASE WHEN status = 'MATURED' THEN CASE direction WHEN 'BULLISH' THEN tc / close - 1 > 0.01 ELSE tc / close - 1 < -0.01 END END AS hit FROM vb)"""


@register("beh_04_forward_validation", S.sql("bars", f"SELECT ticker, trade_date, horizon, status, actual_date, {r('actual_return', 6)} AS actual_return, {r('favorable', 6)} AS favorable, {r('adverse', 6)} AS adverse, hit FROM val WHERE direction <> 'NEUTRAL'", VAL))
def forward(spark, d):
    v = O.validate_forward(staged(spark, d)).where("direction <> 'NEUTRAL'")
    return v.select(*KEY, "horizon", "status", "actual_date", *[rnd(c, 6).alias(c) for c in ("actual_return", "favorable", "adverse")], "hit")


REL = VAL + """,
mv AS (SELECT ticker, horizon, trade_date, actual_date, row_number() OVER (PARTITION BY ticker, horizon ORDER BY trade_date) AS n FROM val WHERE status = 'MATURED'),
nx AS (SELECT a.*, b.n AS next_n FROM mv a ASOF LEFT JOIN mv b ON a.ticker = b.ticker AND a.horizon = b.horizon AND a.actual_date < b.trade_date),
sel AS (WITH RECURSIVE wk AS (SELECT ticker, horizon, n, trade_date, next_n FROM nx WHERE n = 1 UNION ALL SELECT x.ticker, x.horizon, x.n, x.trade_date, x.next_n FROM wk JOIN nx x ON x.ticker = wk.ticker AND x.horizon = wk.horizon AND x.n = wk.next_n) SELECT ticker, horizon, trade_date FROM wk),
g AS (SELECT ticker, horizon, count(*) AS effective, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE favorable > abs(adverse)) AS wins, avg(confidence) AS conf, avg(CASE direction WHEN 'BULLISH' THEN actual_return ELSE -actual_return END) AS fwd FROM val JOIN sel USING (ticker, horizon, trade_date) GROUP BY 1, 2),
cn AS (SELECT ticker, horizon, count(*) AS total, count(*) FILTER (WHERE status = 'MATURED') AS matured, count(*) FILTER (WHERE status = 'PENDING') AS pending, CASE horizon WHEN 1 THEN 30 WHEN 3 THEN 24 WHEN 5 THEN 20 WHEN 10 THEN 14 ELSE 10 END AS required FROM val GROUP BY 1, 2),
rl AS (SELECT *, """ + r("coalesce(hits / effective, 0) * 65 + coalesce(wins / effective, 0) * 10 + coalesce(conf, 0) / 100 * 10 + least(1e0, coalesce(effective, 0) / required) * 15", 2) + " AS reliability_score FROM cn LEFT JOIN g USING (ticker, horizon))"


@register("beh_05_reliability", S.sql("bars", f"""SELECT ticker, horizon, total, matured, pending, coalesce(effective, 0) AS effective, required, {r('hits / effective', 6)} AS accuracy, {r('fwd', 6)} AS average_forward_return, reliability_score,
  CASE WHEN coalesce(effective, 0) < required THEN 'INSUFFICIENT' WHEN reliability_score >= 85 THEN 'PUBLISHED' ELSE 'OBSERVE' END AS status FROM rl""", REL))
def reliability(spark, d):
    x = O.reliability(O.validate_forward(staged(spark, d)))
    return x.select("ticker", "horizon", "total", "matured", "pending", "effective", "required", "accuracy", rnd("average_forward_return", 6).alias("average_forward_return"), "reliability_score", "status")


@register("beh_06_transitions", S.sql("bars", "SELECT ticker, trade_date, stage, previous_stage, 'BEHAVIOR:' || ticker || ':' || trade_date || ':' || stage AS event_key FROM (SELECT *, lag(stage) OVER w AS p1, lag(stage, 2) OVER w AS previous_stage FROM st WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)) WHERE stage = p1 AND stage <> previous_stage AND stage <> 'INSUFFICIENT'", STAGED))
def transitions(spark, d):
    return O.confirmed_transitions(staged(spark, d))


@register("beh_07_incremental_keys", S.sql("bars", "SELECT ticker, trade_date FROM (SELECT ticker, trade_date, bool_or(status = 'PENDING') AS p FROM val GROUP BY 1, 2) QUALIFY p OR row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) <= 4", VAL))
def incremental(spark, d):
    return O.pending_window(O.validate_forward(staged(spark, d)))


@register("flt_13_as_of_masking", S.sql("bars", f"""SELECT ticker, trade_date, horizon, CASE WHEN actual_date > DATE '1999-12-31' THEN 'PENDING' ELSE status END AS status, CASE WHEN actual_date <= DATE '1999-12-31' THEN {r('actual_return', 6)} END AS actual_return FROM val WHERE trade_date <= DATE '1999-12-31' AND direction <> 'NEUTRAL'""", VAL))
def masked(spark, d):
    v = O.mask_as_of(O.validate_forward(staged(spark, d)), F.lit("1999-12-31").cast("date")).where("direction <> 'NEUTRAL'")
    return v.select(*KEY, "horizon", "status", rnd("actual_return", 6).alias("actual_return"))


@register("beh_08_overview", S.sql("bars", "SELECT ticker, arg_max(trade_date, trade_date) AS as_of, arg_max(stage, trade_date) AS stage, arg_max(score, trade_date) AS score, count(*) FILTER (WHERE direction = 'BULLISH') AS bullish_days, count(*) FILTER (WHERE direction = 'BEARISH') AS bearish_days FROM st GROUP BY 1", STAGED))
def overview(spark, d):
    return staged(spark, d).groupBy("ticker").agg(
        F.max("trade_date").alias("as_of"), F.max_by("stage", "trade_date").alias("stage"), F.max_by("score", "trade_date").alias("score"),
        F.count_if(F.col("direction") == "BULLISH").alias("bullish_days"), F.count_if(F.col("direction") == "BEARISH").alias("bearish_days"))
