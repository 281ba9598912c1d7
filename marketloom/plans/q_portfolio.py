"""Portfolio (PF-*), risk (RISK-*) and trading calendar (DAT-*)."""
from pyspark.sql import functions as F

from marketloom.functions import dates as D
from marketloom.functions.scalar import rnd
from marketloom.operators import portfolio as O
from marketloom.plans import sqlviews as S
from marketloom.plans.registry import register
from marketloom.sources import views as V

r = S.rnd


def _easter(y):
    a, b, c = f"({y} % 19)", f"({y} // 100)", f"({y} % 100)"
    h = f"((19 * {a} + {b} - {b} // 4 - ({b} - ({b} + 8) // 25 + 1) // 3 + 15) % 30)"
    l = f"((32 + 2 * ({b} % 4) + 2 * ({c} // 4) - {h} - {c} % 4) % 7)"
    n = f"({h} + {l} - 7 * (({a} + 11 * {h} + 22 * {l}) // 451) + 114)"
    return f"make_date({y}, {n} // 31, {n} % 31 + 1)"


def _obs(day):
    return f"({day} + CASE dayofweek({day}) WHEN 6 THEN -1 WHEN 0 THEN 1 ELSE 0 END)"


CAL = f"""bnd AS (SELECT min(CAST(o_orderdate AS DATE)) - 15 AS a, greatest(max(CAST(o_orderdate AS DATE)), (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)) + 15 AS b FROM orders),
yrs AS (SELECT CAST(unnest(range(year(a) - 1, year(b) + 2)) AS INT) AS y FROM bnd),
hol AS (SELECT {_obs('make_date(y, 1, 1)')} AS h FROM yrs UNION SELECT {_obs('make_date(y, 7, 4)')} FROM yrs UNION SELECT {_obs('make_date(y, 12, 25)')} FROM yrs UNION SELECT {_obs('make_date(y, 6, 19)')} FROM yrs WHERE y >= 2022
  UNION SELECT {_easter('y')} - 2 FROM yrs UNION SELECT max(d) FROM (SELECT y, CAST(unnest(generate_series(make_date(y, 5, 1), make_date(y, 5, 31), INTERVAL 1 DAY)) AS DATE) AS d FROM yrs) WHERE dayofweek(d) = 1 GROUP BY y
  UNION SELECT d FROM (SELECT d, row_number() OVER (PARTITION BY y, month(d), dayofweek(d) ORDER BY d) AS k, y FROM (SELECT y, CAST(unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), INTERVAL 1 DAY)) AS DATE) AS d FROM yrs))
    WHERE (month(d) = 1 AND dayofweek(d) = 1 AND k = 3 AND y >= 1998) OR (month(d) = 2 AND dayofweek(d) = 1 AND k = 3) OR (month(d) = 9 AND dayofweek(d) = 1 AND k = 1) OR (month(d) = 11 AND dayofweek(d) = 4 AND k = 4)),
days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM bnd),
ses AS (SELECT day AS s, row_number() OVER (ORDER BY day) AS no FROM days WHERE dayofweek(day) NOT IN (0, 6) AND day NOT IN (SELECT h FROM hol)),
cal AS (SELECT day, day IN (SELECT s FROM ses) AS is_session, (SELECT count(*) FROM ses WHERE s <= day) AS session_no, (SELECT max(s) FROM ses WHERE s < day) AS previous_session, (SELECT min(s) FROM ses WHERE s > day) AS next_session FROM days)"""


def calendar(spark, d):
    o = V.table(spark, d, "orders").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("o"))
    li = V.table(spark, d, "lineitem").agg(F.max(F.to_date("l_shipdate")).alias("l"))
    return D.trading_calendar(o.join(F.broadcast(li)).select("a", F.greatest("o", "l").alias("b")), "a", "b")


@register("dat_01_trading_calendar", "WITH " + CAL + " SELECT * FROM cal")
def trading_calendar(spark, d):
    return calendar(spark, d)


@register("dat_02_nth_session", S.sql("bars", "SELECT ticker, trade_date, t.s AS target_date FROM bars JOIN cal ON day = trade_date LEFT JOIN ses t ON t.no = session_no + 21", CAL))
def nth_session(spark, d):
    c = calendar(spark, d)
    target = c.where("is_session").select(F.col("session_no").alias("_no"), F.col("day").alias("target_date"))
    b = V.bars(spark, d).select("ticker", "trade_date").join(F.broadcast(c.select(F.col("day").alias("trade_date"), (F.col("session_no") + 21).alias("_no"))), "trade_date")
    return b.join(F.broadcast(target), "_no", "left").select("ticker", "trade_date", "target_date")


@register("dat_04_trade_session", S.sql("trades", "SELECT id, CASE WHEN is_session THEN day ELSE next_session END AS session_date FROM trades JOIN cal ON day = trade_date", CAL))
def trade_session(spark, d):
    roll = D.session_on_or_after(calendar(spark, d)).withColumnRenamed("day", "trade_date")
    return V.trades(spark, d).join(F.broadcast(roll), "trade_date").select("id", "session_date")


@register("dat_08_month_end_sessions", "WITH " + CAL + " SELECT day FROM cal WHERE is_session AND month(next_session) <> month(day)")
def month_end_sessions(spark, d):
    return calendar(spark, d).where("is_session AND month(next_session) <> month(day)").select("day")


@register("join_12_previous_session", S.sql("bars", f"SELECT b.ticker, b.trade_date, previous_session, {r('b.close - p.close', 6)} AS change FROM bars b JOIN cal ON day = trade_date LEFT JOIN bars p ON p.ticker = b.ticker AND p.trade_date = previous_session", CAL))
def previous_session(spark, d):
    b = V.bars(spark, d).select("ticker", "trade_date", "close")
    c = calendar(spark, d).select(F.col("day").alias("trade_date"), "previous_session")
    p = b.select("ticker", F.col("trade_date").alias("previous_session"), F.col("close").alias("pc"))
    return (b.join(F.broadcast(c), "trade_date").join(p, ["ticker", "previous_session"], "left")
            .select("ticker", "trade_date", "previous_session", rnd(F.col("close") - F.col("pc"), 6).alias("change")))


FIFO = """tq AS (SELECT *, sum(CAST(quantity AS DECIMAL(28,8))) OVER (PARTITION BY ticker, side ORDER BY trade_date, id) AS hi, CASE side WHEN 'BUY' THEN (quantity * price + fee) / quantity ELSE (quantity * price - fee) / quantity END AS unit FROM trades),
tl AS (SELECT *, hi - CAST(quantity AS DECIMAL(28,8)) AS lo FROM tq),
fm AS (SELECT b.ticker, b.id AS buy_id, s.id AS sell_id, CAST(least(b.hi, s.hi) - greatest(b.lo, s.lo) AS DOUBLE) AS quantity, b.unit AS unit_cost, s.unit AS unit_proceeds, s.trade_date AS sell_date
  FROM tl b JOIN tl s ON b.ticker = s.ticker AND b.side = 'BUY' AND s.side = 'SELL' AND b.lo < s.hi AND s.lo < b.hi)"""
M = lambda e: f"CAST(sum(CAST({e} AS DECIMAL(38,10))) AS DOUBLE)"
LOTS = FIFO + f""",
cash AS (SELECT ticker, sum(CASE side WHEN 'BUY' THEN quantity ELSE 0 END) AS bought, sum(CASE side WHEN 'SELL' THEN quantity ELSE 0 END) AS sold, {M("CASE side WHEN 'BUY' THEN quantity * price + fee ELSE 0 END")} AS buy_cash,
  {M("CASE side WHEN 'SELL' THEN quantity * price - fee ELSE 0 END")} AS sell_cash FROM trades GROUP BY 1),
used AS (SELECT ticker, {M('quantity * unit_cost')} AS consumed FROM fm GROUP BY 1),
lots AS (SELECT *, bought - sold AS quantity, buy_cash - coalesce(consumed, 0) AS remaining_cost, sell_cash - coalesce(consumed, 0) AS realized_pnl FROM cash LEFT JOIN used USING (ticker)),
pos AS (SELECT *, quantity * current_price AS market_value, quantity * current_price - remaining_cost AS unrealized_pnl, quantity * current_price - remaining_cost + realized_pnl AS total_pnl FROM lots
  LEFT JOIN (SELECT ticker, arg_max(close, trade_date) AS current_price, max(trade_date) AS price_date FROM bars GROUP BY 1) USING (ticker))"""


@register("flt_10_held", S.sql("trades", "SELECT ticker, sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END) AS position FROM trades WHERE trade_date <= DATE '1998-06-30' GROUP BY 1 HAVING position > 0"))
def held(spark, d):
    return O.held(V.trades(spark, d), F.lit("1998-06-30").cast("date"))


@register("pf_01_position", S.sql("trades", "SELECT ticker, trade_date, sum(sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END)) OVER (PARTITION BY ticker ORDER BY trade_date) AS position FROM trades GROUP BY 1, 2"))
def position(spark, d):
    from pyspark.sql import Window
    t = V.trades(spark, d).groupBy("ticker", "trade_date").agg(F.sum(O.signed_quantity()).alias("q"))
    return t.select("ticker", "trade_date", F.sum("q").over(O.over().rowsBetween(Window.unboundedPreceding, 0)).alias("position"))


@register("pf_02_fifo_matches", S.sql("trades", f"SELECT ticker, buy_id, sell_id, quantity, {r('quantity * (unit_proceeds - unit_cost)', 4)} AS realized FROM fm", FIFO))
def fifo(spark, d):
    return O.fifo_matches(V.trades(spark, d), 500).select("ticker", "buy_id", "sell_id", "quantity", rnd(F.col("quantity") * (F.col("unit_proceeds") - F.col("unit_cost")), 4).alias("realized"))


@register("flt_09_oversells", S.sql("trades", "SELECT id, ticker, CAST(running AS DOUBLE) AS running FROM (SELECT *, sum(CASE side WHEN 'BUY' THEN CAST(quantity AS DECIMAL(28,8)) ELSE -CAST(quantity AS DECIMAL(28,8)) END) OVER (PARTITION BY ticker ORDER BY trade_date, id) AS running FROM trades) WHERE side = 'SELL' AND running < -1e-8"))
def oversells(spark, d):
    return O.oversells(V.trades(spark, d)).select("id", "ticker", "running")


@register("pf_03_lots_summary", S.sql("trades bars", f"SELECT ticker, quantity, {r('remaining_cost', 4)} AS remaining_cost, {r('remaining_cost / quantity', 4)} AS average_cost, {r('realized_pnl', 4)} AS realized_pnl, {r('buy_cash', 4)} AS buy_cash, {r('sell_cash', 4)} AS sell_cash FROM lots", LOTS))
def lots(spark, d):
    return O.lots_summary(V.trades(spark, d)).select("ticker", "quantity", *[rnd(c, 4).alias(c) for c in ("remaining_cost", "average_cost", "realized_pnl", "buy_cash", "sell_cash")])


_PF4 = ["market_value", "unrealized_pnl", "total_pnl"]


@register("pf_04_valuation", S.sql("trades bars", f"SELECT ticker, price_date, {', '.join(f'{r(c, 4)} AS {c}' for c in _PF4)}, {r('total_pnl / buy_cash', 6)} AS total_return FROM pos", LOTS))
def valuation(spark, d):
    return O.positions(V.trades(spark, d), V.bars(spark, d)).select("ticker", "price_date", *[rnd(c, 4).alias(c) for c in _PF4], rnd("total_return", 6).alias("total_return"))


@register("pf_06_totals", S.sql("trades bars", "SELECT " + ", ".join(f"{r(f'{M(c)}', 2)} AS {c}" for c in _PF4 + ["realized_pnl"]) + " FROM pos", LOTS))
def totals(spark, d):
    p = O.positions(V.trades(spark, d), V.bars(spark, d))
    return p.agg(*[rnd(F.sum(F.col(c).cast(O.MONEY)).cast("double"), 2).alias(c) for c in _PF4 + ["realized_pnl"]])


DAILY = CAL + f""",
tr AS (SELECT ticker, CASE WHEN is_session THEN day ELSE next_session END AS trade_date, side, quantity, price, fee FROM trades JOIN cal ON day = trade_date),
fl AS (SELECT ticker, trade_date, sum(CASE side WHEN 'BUY' THEN quantity ELSE 0 END) AS bought, sum(CASE side WHEN 'SELL' THEN quantity ELSE 0 END) AS sold, {M("CASE side WHEN 'BUY' THEN quantity * price + fee ELSE 0 END")} AS buy_cash, {M("CASE side WHEN 'SELL' THEN quantity * price - fee ELSE 0 END")} AS sell_cash FROM tr GROUP BY 1, 2),
cu AS (SELECT ticker, trade_date AS cd, sum(bought - sold) OVER (PARTITION BY ticker ORDER BY trade_date) AS q FROM fl),
a AS (SELECT b.ticker, b.trade_date, b.close, coalesce(cu.q, 0) AS beginning_quantity FROM bars b ASOF LEFT JOIN cu ON b.ticker = cu.ticker AND b.trade_date > cu.cd),
e AS (SELECT a.*, fl.ticker IS NOT NULL AS traded, coalesce(buy_cash, 0) AS buy_cash, coalesce(sell_cash, 0) AS sell_cash, beginning_quantity + coalesce(bought, 0) - coalesce(sold, 0) AS ending_quantity FROM a LEFT JOIN fl USING (ticker, trade_date)),
f AS (SELECT e.*, cal.previous_session, p.close AS previous_close, NOT (beginning_quantity > 1e-8) OR p.close IS NOT NULL AS complete FROM e JOIN cal ON day = e.trade_date LEFT JOIN bars p ON p.ticker = e.ticker AND p.trade_date = cal.previous_session WHERE beginning_quantity > 1e-8 OR ending_quantity > 1e-8 OR traded),
pnl AS (SELECT *, CASE WHEN complete THEN ending_quantity * close + sell_cash - buy_cash - beginning_quantity * coalesce(previous_close, 0) END AS pnl FROM f)"""


@register("pf_05_daily_pnl", S.sql("trades bars", f"SELECT ticker, trade_date, beginning_quantity, ending_quantity, complete, {r('pnl', 4)} AS pnl FROM pnl", DAILY))
def daily(spark, d):
    return O.daily_pnl(V.trades(spark, d), V.bars(spark, d), calendar(spark, d)).select("ticker", "trade_date", "beginning_quantity", "ending_quantity", "complete", rnd("pnl", 4).alias("pnl"))


@register("pf_07_monthly_performance", S.sql("trades bars", f"""SELECT year, month, {r(M('known'), 2)} AS known_pnl, CASE WHEN max(bad) = 0 THEN {r(M('known'), 2)} END AS total_pnl, sum(bad) AS incomplete_days FROM
  (SELECT year(trade_date) AS year, month(trade_date) AS month, sum(CAST(coalesce(pnl, 0) AS DECIMAL(38,10))) AS known, max(CASE WHEN complete THEN 0 ELSE 1 END) AS bad FROM pnl GROUP BY trade_date) GROUP BY ROLLUP (year, month)""", DAILY))
def monthly(spark, d):
    x = O.performance_rollup(O.daily_pnl(V.trades(spark, d), V.bars(spark, d), calendar(spark, d)))
    return x.select("year", "month", rnd("known_pnl", 2).alias("known_pnl"), rnd("total_pnl", 2).alias("total_pnl"), "incomplete_days")


@register("pf_08_yearly_by_ticker", S.sql("trades bars", f"SELECT year(trade_date) AS year, month(trade_date) AS month, ticker, {r(M('coalesce(pnl, 0)'), 2)} AS known_pnl, count(*) FILTER (WHERE NOT complete) AS incomplete_days, CASE WHEN bool_and(complete) THEN {r(M('coalesce(pnl, 0)'), 2)} END AS total_pnl FROM pnl GROUP BY 1, 2, 3", DAILY))
def yearly(spark, d):
    x = O.daily_pnl(V.trades(spark, d), V.bars(spark, d), calendar(spark, d))
    known = rnd(F.sum(F.coalesce("pnl", F.lit(0.0)).cast(O.MONEY)).cast("double"), 2)
    return x.groupBy(F.year("trade_date").alias("year"), F.month("trade_date").alias("month"), "ticker").agg(
        known.alias("known_pnl"), F.count_if(~F.col("complete")).alias("incomplete_days"), F.when(F.bool_and("complete"), known).alias("total_pnl"))


SNAP = LOTS + f""",
cd AS (SELECT ticker, trade_date, sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END) AS q, sum(CAST(CASE side WHEN 'BUY' THEN quantity * price + fee ELSE 0 END AS DECIMAL(38,10))) AS bc, sum(CAST(CASE side WHEN 'SELL' THEN quantity * price - fee ELSE 0 END AS DECIMAL(38,10))) AS sc FROM trades GROUP BY 1, 2),
ud AS (SELECT ticker, sell_date AS trade_date, sum(CAST(quantity * unit_cost AS DECIMAL(38,10))) AS u FROM fm GROUP BY 1, 2),
ru AS (SELECT ticker, trade_date AS d0, sum(q) OVER w AS quantity, CAST(sum(bc) OVER w AS DOUBLE) AS bc, CAST(sum(sc) OVER w AS DOUBLE) AS sc, CAST(sum(coalesce(u, 0)) OVER w AS DOUBLE) AS u FROM cd LEFT JOIN ud USING (ticker, trade_date) WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)),
snap AS (SELECT b.ticker, b.trade_date, quantity, bc - u AS remaining_cost, sc - u AS realized_pnl, quantity * close AS market_value, quantity * close - (bc - u) AS unrealized_pnl FROM bars b ASOF JOIN ru ON b.ticker = ru.ticker AND b.trade_date >= ru.d0)"""


@register("pf_09_daily_snapshots", S.sql("trades bars", f"SELECT ticker, trade_date, quantity, {', '.join(f'{r(c, 3)} AS {c}' for c in ('remaining_cost', 'realized_pnl', 'market_value', 'unrealized_pnl'))} FROM snap", SNAP))
def snapshots(spark, d):
    s = O.daily_snapshots(V.trades(spark, d), V.bars(spark, d))
    return s.select("ticker", "trade_date", "quantity", *[rnd(c, 3).alias(c) for c in ("remaining_cost", "realized_pnl", "market_value", "unrealized_pnl")])


@register("pf_10_sized_trade", S.sql("bars", f"""SELECT ticker, trade_date, {r('CASE WHEN gap >= 0 THEN gap / (open * (1 + 0.6e0 * 0.00100025e0)) ELSE gap / (open * (1 - 0.6e0 * 0.00099975e0)) END', 6)} AS units
  FROM (SELECT ticker, trade_date, open, 0.6e0 * (10000 + volume * open) - volume * open AS gap FROM bars)"""))
def sized(spark, d):
    u = O.sized_trade(F.lit(10000.0), F.col("volume"), F.col("open"), F.lit(0.6), 5.0, 5.0)
    return V.bars(spark, d).select("ticker", "trade_date", rnd(u, 6).alias("units"))


RISK = LOTS + f""",
wt AS (SELECT ticker, market_value / sum(market_value) OVER () AS weight, total_pnl / buy_cash AS total_return FROM pos WHERE quantity > 0 AND market_value > 0),
rr AS (SELECT ticker, trade_date, close / lag(close) OVER (PARTITION BY ticker ORDER BY trade_date) - 1 AS ret FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) <= 91)),
rt AS (SELECT * FROM rr WHERE ret IS NOT NULL),
pr AS (SELECT trade_date, sum(ret * weight) / sum(weight) AS ret, sum(weight) AS cover FROM rt JOIN wt USING (ticker) GROUP BY 1 HAVING sum(weight) >= 0.8),
co AS (SELECT l.ticker AS "left", r.ticker AS "right", count(*) AS pairs, CASE WHEN count(*) >= 20 THEN corr(l.ret, r.ret) END AS correlation FROM rt l JOIN rt r ON l.trade_date = r.trade_date AND l.ticker < r.ticker WHERE l.ticker IN (SELECT ticker FROM wt) AND r.ticker IN (SELECT ticker FROM wt) GROUP BY 1, 2)"""


def risk_inputs(spark, d):
    w = O.weights(O.positions(V.trades(spark, d), V.bars(spark, d)))
    rets = O.recent_returns(V.bars(spark, d)).join(w.select("ticker"), "ticker", "left_semi")
    return w, rets


@register("risk_01_recent_returns", S.sql("trades bars", f"SELECT ticker, trade_date, {r('ret', 8)} AS ret FROM rt", RISK))
def risk_returns(spark, d):
    return O.recent_returns(V.bars(spark, d)).select("ticker", "trade_date", rnd("ret", 8).alias("ret"))


@register("risk_02_portfolio_returns", S.sql("trades bars", f"SELECT trade_date, {r('ret', 8)} AS ret FROM pr", RISK))
def port_returns(spark, d):
    w, rets = risk_inputs(spark, d)
    return O.portfolio_returns(rets, w).select("trade_date", rnd("ret", 8).alias("ret"))


@register("risk_03_correlations", S.sql("trades bars", f'SELECT "left", "right", pairs, {r("correlation", 4)} AS correlation FROM co', RISK))
def corr(spark, d):
    return O.correlations(risk_inputs(spark, d)[1]).select("left", "right", "pairs", rnd("correlation", 4).alias("correlation"))


@register("risk_04_summary", S.sql("trades bars securities", f"""SELECT positions, lp AS largest_position, ls AS largest_sector, hhi, {r('vol', 6)} AS annual_volatility, {r('ac', 4)} AS average_correlation, {r('score', 2)} AS risk_score, CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 45 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM
  (SELECT *, least(100, lp * 55 + ls * 25 + greatest(0, coalesce(ac, 0)) * 10 + least(1, vol / 0.5e0) * 10) AS score FROM (SELECT (SELECT count(*) FROM wt) AS positions, (SELECT {r('max(weight)', 6)} FROM wt) AS lp, (SELECT {r(f"sum(power({r('weight', 6)}, 2))", 6)} FROM wt) AS hhi,
   (SELECT {r('max(s)', 6)} FROM (SELECT sum(weight) AS s FROM wt JOIN securities USING (ticker) GROUP BY sector)) AS ls, (SELECT stddev_samp(ret) * sqrt(252) FROM pr) AS vol, (SELECT avg({r('correlation', 4)}) FROM co) AS ac))""", RISK))
def risk_summary(spark, d):
    w, rets = risk_inputs(spark, d)
    return O.risk_summary(w, V.securities(spark, d).select("ticker", "sector"), O.portfolio_returns(rets, w), O.correlations(rets))


@register("risk_05_drawdown", S.sql("trades bars", f"""SELECT {r('min(dd)', 6)} AS max_drawdown, max(CASE WHEN peak IS DISTINCT FROM pp THEN trade_date END) AS peak_date, arg_min(trade_date, (dd, trade_date)) AS trough_date, count(*) AS days FROM
  (SELECT *, v / peak - 1 AS dd, lag(peak) OVER (ORDER BY trade_date) AS pp FROM (SELECT trade_date, v, max(v) OVER (ORDER BY trade_date) AS peak FROM (SELECT trade_date, {M('market_value')} AS v FROM snap WHERE quantity > 0 GROUP BY 1)))""", SNAP))
def risk_drawdown(spark, d):
    x = O.historical_drawdown(O.daily_snapshots(V.trades(spark, d), V.bars(spark, d)))
    return x.select(rnd("max_drawdown", 6).alias("max_drawdown"), "peak_date", "trough_date", "days")


@register("risk_06_review_actions", S.sql("trades bars filings", """SELECT ticker, CASE WHEN EXISTS (SELECT 1 FROM filings f WHERE f.ticker = wt.ticker AND f.filed_at >= (SELECT max(filed_at) - 30 FROM filings) AND contains(f.items, '4.02')) THEN 'EXIT_RISK_REVIEW'
  WHEN weight > 0.35 THEN 'REDUCE_CONCENTRATION_REVIEW' WHEN total_return <= -0.15 THEN 'REDUCE_RISK_REVIEW' ELSE 'HOLD_REVIEW' END AS action FROM wt""", RISK))
def review(spark, d):
    w, _ = risk_inputs(spark, d)
    f = V.filings(spark, d)
    recent = f.join(F.broadcast(f.agg(F.max("filed_at").alias("m")))).where("filed_at >= date_sub(m, 30) AND contains(items, '4.02')")
    w = w.join(recent.select("ticker").distinct().withColumn("risk", F.lit(True)), "ticker", "left")
    return w.select("ticker", O.review_action(F.coalesce("risk", F.lit(False)), F.col("weight"), F.col("total_return"), F.lit("BEARISH")).alias("action"))
