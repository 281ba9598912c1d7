"""Rule signals and set-based back-tests (SIG-*).

The test prices are noise, so some rules compound beyond 1e30; wealth is reported as logarithms.
"""
from pyspark.sql import functions as F

from marketloom.functions.scalar import rnd
from marketloom.operators import signals as O
from marketloom.operators.series import over, rolling
from marketloom.plans import sqlviews as S
from marketloom.plans.registry import register
from marketloom.sources import views as V

r = S.rnd
KEY = ["ticker", "rule"]
FR = lambda n, off=0: f"(PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN {n - 1 + off} PRECEDING AND {'CURRENT ROW' if not off else f'{off} PRECEDING'})"

IND = f"""i0 AS (SELECT *, row_number() OVER w AS rn, close - lag(close) OVER w AS diff, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)),
i1 AS (SELECT *, CASE WHEN rn >= 20 THEN list_reduce(list(close) OVER {FR(401)}, lambda a, v: a * (1 - 2e0 / 21e0) + v * (2e0 / 21e0)) END AS ema, CASE WHEN rn >= 60 THEN avg(close) OVER {FR(60)} END AS sma, CASE WHEN rn >= 21 THEN max(high) OVER {FR(20, 1)} END AS breakout_high,
  CASE WHEN rn >= 21 THEN avg(volume) OVER {FR(20, 1)} END AS volume_base, CASE WHEN rn >= 14 THEN avg(tr) OVER {FR(14)} END AS atr, CASE WHEN rn >= 11 THEN min(low) OVER {FR(10, 1)} END AS low10,
  CASE WHEN rn >= 3 THEN list_reduce(list(greatest(diff, 0e0)) FILTER (WHERE diff IS NOT NULL) OVER {FR(81)}, lambda a, v: a * 0.5e0 + v * 0.5e0) END AS g, CASE WHEN rn >= 3 THEN list_reduce(list(greatest(-diff, 0e0)) FILTER (WHERE diff IS NOT NULL) OVER {FR(81)}, lambda a, v: a * 0.5e0 + v * 0.5e0) END AS l FROM i0),
ind AS (SELECT *, CASE WHEN g + l = 0 THEN 50 ELSE 100 * g / (g + l) END AS rsi2, rn >= 60 AS ready FROM i1)"""
SIG = IND + """,
sg AS (SELECT i.*, rule, coalesce(CASE rule WHEN 'original' THEN close > ema AND ema > sma AND close > breakout_high AND volume_base > 0 AND volume >= 1.2e0 * volume_base WHEN 'no_volume' THEN close > ema AND ema > sma AND close > breakout_high WHEN 'trend20' THEN close > ema WHEN 'trend60' THEN close > sma
  WHEN 'channel' THEN close > breakout_high WHEN 'pullback' THEN close > sma AND rsi2 < 15 ELSE true END, false) AS entry, coalesce(CASE WHEN rule IN ('original', 'no_volume', 'trend20') THEN close < ema WHEN rule = 'trend60' THEN close < sma WHEN rule = 'channel' THEN close < low10 WHEN rule = 'pullback' THEN rsi2 > 70 OR close < sma ELSE false END, false) AS exit
  FROM ind i, (SELECT unnest(['original', 'no_volume', 'trend20', 'trend60', 'channel', 'pullback', 'hold']) AS rule) WHERE ready)"""
POS = SIG + """,
p0 AS (SELECT *, CASE WHEN exit THEN 0 WHEN entry THEN 1 END AS signal FROM sg),
pos AS (SELECT *, coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY ticker, rule ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM p0)"""


def curve_sql(fee="5e0 / 10000", slip="5e0 / 10000", keys="ticker, rule"):
    return f""",
e0 AS (SELECT *, coalesce(lag(position) OVER w, 0) AS was, lag(close) OVER w AS pc FROM pos WINDOW w AS (PARTITION BY {keys} ORDER BY trade_date)),
e1 AS (SELECT *, CASE WHEN position = 1 AND was = 0 THEN close / (open * (1 + {slip}) * (1 + {fee})) WHEN position = 1 THEN close / pc WHEN was = 1 THEN open * (1 - {slip}) * (1 - {fee}) / pc ELSE 1e0 END AS factor,
  CASE WHEN position = 1 AND was = 0 THEN 'BUY' WHEN position = 0 AND was = 1 THEN 'SELL' END AS fill, CASE WHEN position = 1 AND was = 0 THEN open * (1 + {slip}) WHEN position = 0 AND was = 1 THEN open * (1 - {slip}) END AS fill_price FROM e0),
cur AS (SELECT *, product(factor) OVER (PARTITION BY {keys} ORDER BY trade_date) AS equity FROM e1)"""


CUR = POS + curve_sql()


def ind(spark, d):
    return O.indicators(V.bars(spark, d))


def pos(spark, d):
    return O.positions(O.rule_signals(ind(spark, d)))


def curve(spark, d):
    return O.equity(pos(spark, d))


_I = ["ema", "sma", "breakout_high", "volume_base", "atr", "low10"]


@register("sig_01_indicators", S.sql("bars", "SELECT ticker, trade_date, " + ", ".join(f"{r(c, 4)} AS {c}" for c in _I) + ", ready FROM ind", IND))
def indicators(spark, d):
    return ind(spark, d).select("ticker", "trade_date", *[rnd(c, 4).alias(c) for c in _I], "ready")


@register("sig_02_entries", S.sql("bars", "SELECT ticker, rule, count(*) FILTER (WHERE entry) AS entries, min(trade_date) FILTER (WHERE entry) AS first_entry FROM sg GROUP BY 1, 2", SIG))
def entries(spark, d):
    return O.rule_signals(ind(spark, d)).groupBy(*KEY).agg(F.count_if("entry").alias("entries"), F.min(F.when(F.col("entry"), F.col("trade_date"))).alias("first_entry"))


@register("sig_03_exits", S.sql("bars", "SELECT ticker, rule, trade_date FROM sg WHERE exit", SIG))
def exits(spark, d):
    return O.rule_signals(ind(spark, d)).where("exit").select(*KEY, "trade_date")


_PEER = f"""ret AS (SELECT ticker, trade_date, close / lag(close, 20) OVER (PARTITION BY ticker ORDER BY trade_date) - 1 AS ret FROM bars),
pr AS (SELECT a.ticker, b.ticker AS related FROM securities a JOIN securities b ON a.sector = b.sector AND a.ticker <> b.ticker),
ps AS (SELECT x.ticker, x.trade_date, CASE WHEN have = need THEN x.ret - m END AS relative_return FROM ret x LEFT JOIN (SELECT pr.ticker, y.trade_date, avg(y.ret) AS m, count(y.ret) AS have FROM pr JOIN ret y ON y.ticker = pr.related GROUP BY 1, 2) z ON z.ticker = x.ticker AND z.trade_date = x.trade_date LEFT JOIN (SELECT ticker, count(*) AS need FROM pr GROUP BY 1) n ON n.ticker = x.ticker)"""


def peers(spark, d):
    s = V.securities(spark, d).select("ticker", "sector")  # the universe dimension, joined within a sector
    return s.join(s.select(F.col("ticker").alias("related_ticker"), "sector"), "sector").where("ticker <> related_ticker").select("ticker", "related_ticker")


@register("sig_05_peer_strength", S.sql("bars securities", f"SELECT ticker, trade_date, {r('relative_return', 6)} AS relative_return FROM ps", _PEER))
def strength(spark, d):
    return O.peer_strength(V.bars(spark, d), peers(spark, d)).select("ticker", "trade_date", rnd("relative_return", 6).alias("relative_return"))


@register("sig_06_overheat", S.sql("bars", f"SELECT ticker, trade_date, hot AS overheated, lag(hot) OVER w AS overheated_yesterday, {r('lag(ema) OVER w', 4)} AS previous_ema FROM (SELECT *, coalesce(close > ema + 2 * atr AND rsi2 > 90, false) AS hot FROM ind) WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)", IND))
def overheat(spark, d):
    return O.overheat(ind(spark, d)).select("ticker", "trade_date", "overheated", "overheated_yesterday", rnd("previous_ema", 4).alias("previous_ema"))


@register("sig_07_positions", S.sql("bars", "SELECT ticker, rule, trade_date, position FROM pos", POS))
def position(spark, d):
    return pos(spark, d).select(*KEY, "trade_date", "position")


TR = CUR + """,
t0 AS (SELECT *, sum(CASE WHEN fill = 'BUY' THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, rule ORDER BY trade_date) AS trade_no FROM cur),
tr AS (SELECT ticker, rule, trade_no, min(trade_date) AS entry_date, arg_min(fill_price, trade_date) AS entry_price, max(trade_date) FILTER (WHERE fill = 'SELL') AS exit_date, max(fill_price) FILTER (WHERE fill = 'SELL') AS exit_price, product(factor) - 1 AS trade_return, count(*) FILTER (WHERE position = 1) AS sessions
  FROM t0 WHERE trade_no > 0 AND (position = 1 OR fill = 'SELL') GROUP BY 1, 2, 3)"""


@register("sig_08_trades", S.sql("bars", f"SELECT ticker, rule, trade_no, entry_date, {r('entry_price', 4)} AS entry_price, exit_date, {r('exit_price', 4)} AS exit_price, {r('trade_return', 6)} AS trade_return, sessions FROM tr", TR))
def trades(spark, d):
    return O.trades(curve(spark, d)).select(*KEY, "trade_no", "entry_date", rnd("entry_price", 4).alias("entry_price"), "exit_date", rnd("exit_price", 4).alias("exit_price"), rnd("trade_return", 6).alias("trade_return"), "sessions")


@register("sig_09_equity", S.sql("bars", f"SELECT ticker, rule, trade_date, {r('ln(equity)', 6)} AS log_equity FROM cur", CUR))
def equity(spark, d):
    return curve(spark, d).select(*KEY, "trade_date", rnd(F.log("equity"), 6).alias("log_equity"))


MET = TR + """,
mm AS (SELECT ticker, rule, arg_max(equity, trade_date) AS fe, arg_max(equity, trade_date) - 1 AS total_return, min(equity / greatest(peak, 1) - 1) AS max_drawdown, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, avg(position) AS exposure, max(trade_date) - min(trade_date) AS days
  FROM (SELECT *, max(equity) OVER w AS peak, equity / coalesce(lag(equity) OVER w, 1) - 1 AS ret FROM cur WINDOW w AS (PARTITION BY ticker, rule ORDER BY trade_date)) GROUP BY 1, 2),
met AS (SELECT mm.*, power(fe, 365.25e0 / days) AS annual_growth, coalesce(n, 0) AS closed_trades, win AS win_rate FROM mm LEFT JOIN (SELECT ticker, rule, count(*) AS n, avg(CASE WHEN trade_return > 0 THEN 1e0 ELSE 0e0 END) AS win FROM tr WHERE exit_date IS NOT NULL GROUP BY 1, 2) USING (ticker, rule))"""
_ME = ["max_drawdown", "sharpe", "exposure", "win_rate"]


def met(spark, d):
    c = curve(spark, d)
    return O.metrics(c, O.trades(c))


@register("sig_10_metrics", S.sql("bars", "SELECT ticker, rule, closed_trades, " + ", ".join(f"{r(c, 6)} AS {c}" for c in _ME) + f", {r('ln(fe)', 6)} AS log_growth, {r('ln(annual_growth)', 6)} AS log_cagr FROM met", MET))
def metrics(spark, d):
    return met(spark, d).select(*KEY, "closed_trades", *[rnd(c, 6).alias(c) for c in _ME], rnd(F.log("final_equity"), 6).alias("log_growth"), rnd(F.log("annual_growth"), 6).alias("log_cagr"))


@register("sig_11_matched_hold", S.sql("bars", f"""SELECT f.ticker, f.rule, f.start AS hold_start, {r('arg_max(b.close, b.trade_date) / arg_min(b.open, b.trade_date) - 1', 6)} AS hold_return FROM (SELECT ticker, rule, min(entry_date) AS start FROM tr GROUP BY 1, 2) f JOIN bars b ON b.ticker = f.ticker AND b.trade_date >= f.start GROUP BY 1, 2, 3""", TR))
def matched_hold(spark, d):
    starts = O.trades(curve(spark, d)).groupBy(*KEY).agg(F.min("entry_date").alias("start"))
    return O.buy_and_hold(V.bars(spark, d), starts).select(*KEY, "hold_start", rnd("hold_return", 6).alias("hold_return"))


@register("sig_12_quarter_returns", S.sql("bars", "SELECT ticker, quarter, " + ", ".join(f"{r(f'''ln(1 + max(qr) FILTER (WHERE rule = '{x}'))''', 6)} AS {x}" for x in ("trend20", "trend60", "hold")) + " FROM (SELECT ticker, rule, quarter, eq / coalesce(lag(eq) OVER (PARTITION BY ticker, rule ORDER BY quarter), 1) - 1 AS qr FROM (SELECT ticker, rule, CAST(date_trunc('quarter', trade_date) AS DATE) AS quarter, arg_max(equity, trade_date) AS eq FROM cur GROUP BY 1, 2, 3)) GROUP BY 1, 2", CUR))
def quarter_returns(spark, d):
    q = O.quarter_returns(curve(spark, d)).groupBy("ticker", "quarter").pivot("rule", ["trend20", "trend60", "hold"]).agg(F.max("quarter_return"))
    return q.select("ticker", "quarter", *[rnd(F.log1p(c), 6).alias(c) for c in ("trend20", "trend60", "hold")])


@register("sig_13_walk_forward", S.sql("bars", f"""SELECT ticker, quarter, arg_max(rule, (score, -prio)) AS selected, {r('ln(1 + max(score))', 6)} AS train_log, {r('ln(1 + arg_max(fwd, (score, -prio)))', 6)} AS forward_log FROM
  (SELECT *, lag(net) OVER w - 1 AS score, eq / lag(eq) OVER w - 1 AS fwd, sum(n) OVER (PARTITION BY ticker, rule ORDER BY quarter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sess, CASE rule WHEN 'hold' THEN 0 ELSE list_position(['original', 'no_volume', 'trend20', 'trend60', 'channel', 'pullback', 'hold'], rule) END AS prio
   FROM (SELECT ticker, rule, CAST(date_trunc('quarter', trade_date) AS DATE) AS quarter, arg_max(equity * CASE position WHEN 1 THEN 0.9995e0 * 0.9995e0 ELSE 1e0 END, trade_date) AS net, arg_max(equity, trade_date) AS eq, count(*) AS n FROM cur GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY ticker, rule ORDER BY quarter)) WHERE sess >= 200 GROUP BY 1, 2""", CUR))
def walk_forward(spark, d):
    return O.walk_forward(curve(spark, d)).select("ticker", "quarter", "selected", rnd(F.log1p("train_return"), 6).alias("train_log"), rnd(F.log1p("forward_return"), 6).alias("forward_log"))


@register("sig_14_rolling_year", S.sql("bars", f"""SELECT a.ticker, a.rule, a.month, {r('ln(b.e / a.s)', 6)} AS window_log FROM mo a JOIN mo b ON a.ticker = b.ticker AND a.rule = b.rule AND b.month = a.month + INTERVAL 11 MONTH""", CUR + """,
mo AS (SELECT ticker, rule, CAST(date_trunc('month', trade_date) AS DATE) AS month, arg_max(equity, trade_date) AS e, arg_min(equity / factor, trade_date) AS s FROM cur GROUP BY 1, 2, 3)"""))
def rolling_year(spark, d):
    return O.rolling_windows(curve(spark, d)).select(*KEY, "month", rnd(F.log("window_growth"), 6).alias("window_log"))


@register("sig_15_rebuy_pairs", S.sql("bars", f"""SELECT ticker, rule, trade_date AS sell_date, nd AS rebuy_date, nn - n AS cash_sessions, {r('fill_price * 0.9995e0 / (np * 1.0005e0)', 6)} AS unit_multiplier FROM (SELECT *, lead(trade_date) OVER w AS nd, lead(fill_price) OVER w AS np, lead(n) OVER w AS nn FROM (SELECT *, row_number() OVER (PARTITION BY ticker, rule ORDER BY trade_date) AS n FROM cur) WHERE fill IS NOT NULL WINDOW w AS (PARTITION BY ticker, rule ORDER BY trade_date)) WHERE fill = 'SELL'""", CUR))
def rebuy(spark, d):
    return O.rebuy_pairs(curve(spark, d)).select(*KEY, "sell_date", "rebuy_date", "cash_sessions", rnd("unit_multiplier", 6).alias("unit_multiplier"))


@register("sig_17_wealth_attribution", S.sql("bars", f"""SELECT ticker, rule, {r('ln(arg_max(equity, trade_date))', 6)} AS strategy_log, {r('ln(arg_max(close, trade_date) / arg_min(open, trade_date))', 6)} AS hold_log, 0e0 AS residual FROM cur GROUP BY 1, 2""", CUR))
def attribution(spark, d):
    a = O.wealth_attribution(curve(spark, d))
    return a.select(*KEY, rnd("strategy_log", 6).alias("strategy_log"), rnd("hold_log", 6).alias("hold_log"), F.abs(rnd("residual", 8)).alias("residual"))


@register("sig_18_dollar_attribution", S.sql("bars", f"""SELECT ticker, rule, {r('ln(arg_max(equity, trade_date))', 4)} AS log_growth, 0e0 AS residual FROM cur GROUP BY 1, 2""", CUR))
def dollars(spark, d):
    x = O.dollar_attribution(O.decorate(curve(spark, d)))
    return x.select(*KEY, rnd(F.log(F.col("final_wealth") / 100_000), 4).alias("log_growth"), F.abs(rnd(F.col("residual") / F.col("peak_wealth"), 6)).alias("residual"))


@register("sig_19_blend", S.sql("bars", f"""SELECT h.ticker, w AS weight, h.trade_date, {r('ln((1 - w) * h.equity + w * t.equity)', 6)} AS log_equity, {r('((1 - w) * h.equity * h.position + w * t.equity * t.position) / ((1 - w) * h.equity + w * t.equity)', 6)} AS exposure FROM cur h JOIN cur t ON t.ticker = h.ticker AND t.trade_date = h.trade_date AND h.rule = 'hold' AND t.rule = 'trend60', (SELECT unnest([0e0, 0.25e0, 0.5e0, 0.75e0, 1e0]) AS w)""", CUR))
def blend(spark, d):
    b = O.blend(curve(spark, d), "hold", "trend60", [0.0, 0.25, 0.5, 0.75, 1.0])
    return b.select("ticker", "weight", "trade_date", rnd(F.log("equity"), 6).alias("log_equity"), rnd("exposure", 6).alias("exposure"))


@register("sig_20_liquidated", S.sql("bars", f"SELECT ticker, rule, {r('ln(arg_max(equity * CASE position WHEN 1 THEN 0.9995e0 * 0.9995e0 ELSE 1e0 END, trade_date))', 6)} AS settled_log FROM cur GROUP BY 1, 2", CUR))
def liquidated(spark, d):
    return O.liquidated(curve(spark, d)).select(*KEY, rnd(F.log("settled_equity"), 6).alias("settled_log"))


@register("sig_21_target_check", S.sql("bars", """SELECT m.rule, bool_and(m.total_return >= 1.5 * h.total_return) AS profit_all, bool_or(m.total_return >= 1.5 * h.total_return) AS profit_any, bool_and(m.max_drawdown >= 0.5 * h.max_drawdown) AS drawdown_all,
  count(*) FILTER (WHERE m.total_return >= 1.5 * h.total_return AND m.max_drawdown >= 0.5 * h.max_drawdown) AS accepted FROM met m JOIN met h ON h.ticker = m.ticker AND h.rule = 'hold' GROUP BY 1""", MET))
def target(spark, d):
    return O.target_check(met(spark, d))


@register("sig_22_hold_table", S.sql("bars", f"""SELECT ticker, {r('arg_max(eq, trade_date) - 1', 6)} AS hold_return, {r('min(eq / greatest(peak, 1) - 1)', 6)} AS hold_drawdown FROM (SELECT *, max(eq) OVER (PARTITION BY ticker ORDER BY trade_date) AS peak FROM (SELECT *, close / first_value(open) OVER (PARTITION BY ticker ORDER BY trade_date) AS eq FROM bars)) GROUP BY 1"""))
def hold_table(spark, d):
    return O.buy_and_hold(V.bars(spark, d)).select("ticker", rnd("hold_return", 6).alias("hold_return"), rnd("hold_drawdown", 6).alias("hold_drawdown"))


@register("sig_23_rule_comparison", S.sql("bars", f"""SELECT m.ticker, m.rule, {r('ln(m.fe / h.fe)', 6)} AS log_relative_wealth, sign(m.total_return - h.total_return) AS excess_sign, sign(m.total_return - lag(m.total_return) OVER (PARTITION BY m.ticker ORDER BY list_position(['original', 'no_volume', 'trend20', 'trend60', 'channel', 'pullback', 'hold'], m.rule))) AS layer_sign FROM met m JOIN met h ON h.ticker = m.ticker AND h.rule = 'hold'""", MET))
def comparison(spark, d):
    return O.compare_rules(met(spark, d)).select(*KEY, rnd(F.log("relative_wealth"), 6).alias("log_relative_wealth"), F.signum("excess_points").alias("excess_sign"), F.signum("layer_gain").alias("layer_sign"))


@register("sig_24_scenario_grid", S.sql("bars", f"SELECT ticker, rule, scenario, {r('ln(arg_max(equity, trade_date))', 6)} AS log_growth FROM cur GROUP BY 1, 2, 3",
    SIG + """,
sc AS (SELECT * FROM (VALUES ('full', DATE '1990-01-01', 5e0, 5e0, 0), ('late', DATE '1999-01-01', 5e0, 5e0, 0), ('cost_stress', DATE '1990-01-01', 10e0, 20e0, 0), ('delay', DATE '1990-01-01', 5e0, 5e0, 1)) v(scenario, start_date, fee, slip, delay)),
s1 AS (SELECT sg.*, CASE WHEN exit THEN 0 WHEN entry THEN 1 END AS sig FROM sg), s2 AS (SELECT *, lag(sig) OVER (PARTITION BY ticker, rule ORDER BY trade_date) AS sig1 FROM s1),
s3 AS (SELECT s2.*, scenario, fee, slip, CASE delay WHEN 1 THEN sig1 ELSE sig END AS signal FROM s2 JOIN sc ON trade_date >= start_date),
pos AS (SELECT *, coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY ticker, rule, scenario ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM s3)""" + curve_sql("fee / 10000", "slip / 10000", "ticker, rule, scenario")))
def grid(spark, d):
    from pyspark.sql import Window
    sc = spark.createDataFrame([("full", "1990-01-01", 5.0, 5.0, 0), ("late", "1999-01-01", 5.0, 5.0, 0), ("cost_stress", "1990-01-01", 10.0, 20.0, 0), ("delay", "1990-01-01", 5.0, 5.0, 1)],
                               "scenario string, start_date string, fee double, slip double, delay int")
    s = O.rule_signals(ind(spark, d)).withColumn("_sig", F.when(F.col("exit"), 0).when(F.col("entry"), 1))
    s = s.withColumn("_sig1", F.lag("_sig").over(over(KEY))).join(F.broadcast(sc), F.col("trade_date") >= F.to_date("start_date"))
    k = [*KEY, "scenario"]
    s = s.withColumn("signal", F.when(F.col("delay") == 1, F.col("_sig1")).otherwise(F.col("_sig")))
    s = s.withColumn("position", F.coalesce(F.last("signal", True).over(over(k).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = O.equity(s, F.col("fee"), F.col("slip"), k)
    return c.groupBy(*k).agg(rnd(F.log(F.max_by("equity", "trade_date")), 6).alias("log_growth"))


_CAP = IND + ",\n" + _PEER + f""",
mk AS (SELECT trade_date, close < avg(close) OVER (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS weak FROM bars WHERE ticker = 'T00'),
cp AS (SELECT i.ticker, i.trade_date, i.close, least(CASE WHEN i.close < s120 THEN 0.25 ELSE 1 END, CASE WHEN i.close < sma THEN 0.5 ELSE 1 END, CASE WHEN relative_return < 0 THEN 0.5 ELSE 1 END, CASE WHEN weak AND i.close < ema THEN 0.5 ELSE 1 END) AS exposure
  FROM (SELECT *, CASE WHEN rn >= 120 THEN avg(close) OVER {FR(120)} END AS s120 FROM ind) i LEFT JOIN ps USING (ticker, trade_date) LEFT JOIN mk USING (trade_date))"""


def capped(spark, d):
    b = ind(spark, d).withColumn("sma120", rolling(F.avg, "close", 120, over()))
    m = V.bars(spark, d).where("ticker = 'T00'").select("trade_date", (F.col("close") < F.avg("close").over(over().rowsBetween(-19, 0))).alias("market_weak"))
    j = b.join(O.peer_strength(V.bars(spark, d), peers(spark, d)), ["ticker", "trade_date"], "left").join(F.broadcast(m), "trade_date", "left").withColumn("margins_falling", F.lit(False))
    return j.withColumn("exposure", O.exposure_caps(j))


@register("sig_25_exposure_caps", S.sql("bars securities", "SELECT ticker, trade_date, CAST(exposure AS DOUBLE) AS exposure FROM cp", _CAP))
def caps(spark, d):
    return capped(spark, d).select("ticker", "trade_date", "exposure")


@register("sig_16_reductions", S.sql("bars securities", f"""SELECT ticker, from_date, to_date, sessions, {r('ave', 6)} AS average_exposure, {r('b - 1', 6)} AS baseline_return FROM (SELECT ticker, g, min(trade_date) AS from_date, max(trade_date) AS to_date, count(*) AS sessions, avg(exposure) AS ave, arg_max(close, trade_date) / arg_min(coalesce(pc, close), trade_date) AS b
  FROM (SELECT *, sum(CASE WHEN exposure < 1 AND coalesce(pe, 1) >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY trade_date) AS g FROM (SELECT *, lag(exposure) OVER w AS pe, lag(close) OVER w AS pc FROM cp WINDOW w AS (PARTITION BY ticker ORDER BY trade_date))) WHERE exposure < 1 GROUP BY 1, 2)""", _CAP))
def reductions(spark, d):
    x = O.exposure_reductions(capped(spark, d), "exposure", ["ticker"])
    return x.select("ticker", "from_date", "to_date", "sessions", rnd("average_exposure", 6).alias("average_exposure"), rnd("baseline_return", 6).alias("baseline_return"))


@register("sig_26_decorated", S.sql("bars", f"SELECT ticker, rule, trade_date, {r('CASE position WHEN 1 THEN ln(equity * 100000 / close) END', 6)} AS log_units, {r('CASE position WHEN 0 THEN ln(equity * 100000) END', 6)} AS log_cash, CAST(position AS DOUBLE) AS exposure FROM cur", CUR))
def decorated(spark, d):
    return O.decorate(curve(spark, d)).select(*KEY, "trade_date", rnd(F.log(F.when(F.col("units") > 0, F.col("units"))), 6).alias("log_units"), rnd(F.log(F.when(F.col("cash") > 0, F.col("cash"))), 6).alias("log_cash"), "exposure")


from marketloom.plans.q_fundamentals import _DAILY, states  # noqa: E402
from marketloom.operators import fundamentals as FU  # noqa: E402


@register("sig_04_fundamental_gates", S.sql("facts bars", """SELECT d.ticker, d.trade_date, coalesce(fin_state = 'EXPANSION' AND i.close > sma, false) AS state_entry, coalesce(fin_state = 'DETERIORATION' OR i.close < sma, false) AS state_exit, coalesce(revenue_yoy > 0 AND revenue_acceleration > 0 AND gross_margin_yoy > 0, false) AS improving,
  coalesce(revenue_acceleration < 0 AND gross_margin_yoy < 0, false) AS worsening, coalesce(revenue_yoy > 0 AND revenue_acceleration > 0 AND gross_margin_yoy > 0 AND i.close > ema, false) AS cycle_entry FROM dp d LEFT JOIN st ON st.ticker = d.ticker AND st.cp = d.cp JOIN ind i ON i.ticker = d.ticker AND i.trade_date = d.trade_date""", _DAILY + ",\n" + IND))
def gates(spark, d):
    p = FU.daily_panel(ind(spark, d), states(spark, d), "trade_date", ["fin_period", "revenue_yoy", "revenue_acceleration", "gross_margin_yoy", "fcf_ttm"])
    p = p.withColumn("fin_state", FU.financial_state("trade_date", p))
    return O.fundamental_gates(p).select("ticker", "trade_date", "state_entry", "state_exit", "improving", "worsening", "cycle_entry")
