"""Rule signals and set-based back-test statistics for many tickers and rules at once."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.functions.scalar import ratio
from marketloom.operators.series import drawdown, ema, over, returns, rolling, rsi, trailing, true_range

RULES = ("original", "no_volume", "trend20", "trend60", "channel", "pullback", "hold")
UNBOUNDED = Window.unboundedPreceding
KEY = ["ticker", "rule"]


def indicators(bars: DataFrame, volume_multiple: float = 1.2) -> DataFrame:
    """EMA20, SMA60, prior 20-day high, prior volume base, ATR14, prior 10-day low, RSI2, readiness."""
    w = over()
    d = ema(bars, "close", "ema", 2 / 21, ["ticker"], "trade_date", 20)
    d = rsi(d, "rsi2", 0.5, ["ticker"], "trade_date")
    d = d.withColumn("_tr", true_range(w))
    d = d.withColumns({
        "sma": rolling(F.avg, "close", 60, w), "breakout_high": rolling(F.max, "high", 20, w, offset=1),
        "volume_base": rolling(F.avg, "volume", 20, w, offset=1), "atr": rolling(F.avg, "_tr", 14, w),
        "low10": rolling(F.min, "low", 10, w, offset=1)}).drop("_tr")
    ready = F.col("ema").isNotNull() & F.col("sma").isNotNull() & F.col("breakout_high").isNotNull() & F.col("volume_base").isNotNull() & F.col("atr").isNotNull()
    c = F.col("close")
    return d.withColumns({"ready": ready, "entry_condition": F.coalesce(
        ready & (c > F.col("ema")) & (F.col("ema") > F.col("sma")) & (c > F.col("breakout_high"))
        & (F.col("volume_base") > 0) & (F.col("volume") >= volume_multiple * F.col("volume_base")), F.lit(False))})


def rule_signals(ind: DataFrame) -> DataFrame:
    """(ticker, rule, date) rows from the first ready session, with entry and exit flags per rule.

    Exits are the stateless part of each rule; path-dependent stops are not expressible as columns.
    """
    c, e, s = F.col("close"), F.col("ema"), F.col("sma")
    table = {
        "original": (F.col("entry_condition"), c < e), "no_volume": ((c > e) & (e > s) & (c > F.col("breakout_high")), c < e),
        "trend20": (c > e, c < e), "trend60": (c > s, c < s), "channel": (c > F.col("breakout_high"), c < F.col("low10")),
        "pullback": ((c > s) & (F.col("rsi2") < 15), (F.col("rsi2") > 70) | (c < s)), "hold": (F.lit(True), F.lit(False))}
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(a, F.lit(False)).alias("entry"), F.coalesce(b, F.lit(False)).alias("exit")) for r, (a, b) in table.items()])
    d = ind.where("ready").withColumn("_r", F.explode(rows))
    return d.select(*ind.columns, "_r.*")


def positions(sig: DataFrame, entry: str | Column = "entry", exit_: str | Column = "exit") -> DataFrame:
    """Position by "last non-null signal wins", filled at the next open: 1 held, 0 flat."""
    w = over(KEY)
    entry = F.col(entry) if isinstance(entry, str) else entry
    exit_ = F.col(exit_) if isinstance(exit_, str) else exit_
    d = sig.withColumn("signal", F.when(exit_, 0).when(entry, 1))
    want = F.last("signal", ignorenulls=True).over(w.rowsBetween(UNBOUNDED, -1))
    return d.withColumn("position", F.coalesce(want, F.lit(0)))


def equity(pos: DataFrame, fee_bps: float | Column = 5.0, slippage_bps: float | Column = 5.0, keys: list[str] | None = None) -> DataFrame:
    """Net equity per session as the running product of exact day factors.

    Fills are at the open with slippage and fee; the factor of an entry day runs from the fill to
    the close, of an exit day from the previous close to the fill.
    """
    w = over(keys or KEY)
    fee = (fee_bps if isinstance(fee_bps, Column) else F.lit(fee_bps)) / 10_000
    slip = (slippage_bps if isinstance(slippage_bps, Column) else F.lit(slippage_bps)) / 10_000
    d = pos.withColumns({"_was": F.coalesce(F.lag("position").over(w), F.lit(0)), "_pc": F.lag("close").over(w)})
    now, was = F.col("position") == 1, F.col("_was") == 1
    buy, sell = F.col("open") * (1 + slip) * (1 + fee), F.col("open") * (1 - slip) * (1 - fee)
    factor = (F.when(now & ~was, F.col("close") / buy).when(now & was, F.col("close") / F.col("_pc"))
              .when(~now & was, sell / F.col("_pc")).otherwise(1.0))
    d = d.withColumns({
        "factor": factor, "fill": F.when(now & ~was, "BUY").when(~now & was, "SELL"),
        "fill_price": F.when(now & ~was, F.col("open") * (1 + slip)).when(~now & was, F.col("open") * (1 - slip))})
    return d.withColumn("equity", F.exp(F.sum(F.log("factor")).over(w.rowsBetween(UNBOUNDED, 0)))).drop("_was", "_pc")


def trades(curve: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Holding intervals by gaps and islands; the last one may be open."""
    k = keys or KEY
    w = over(k)
    d = curve.withColumn("_island", F.sum((F.col("fill") == "BUY").cast("int")).over(w.rowsBetween(UNBOUNDED, 0)))
    d = d.where(F.coalesce(F.col("_island"), F.lit(0)) > 0).where((F.col("position") == 1) | (F.col("fill") == "SELL"))
    g = d.groupBy(*k, F.col("_island").alias("trade_no")).agg(
        F.min("trade_date").alias("entry_date"), F.min_by("fill_price", "trade_date").alias("entry_price"),
        F.max(F.when(F.col("fill") == "SELL", F.col("trade_date"))).alias("exit_date"),
        F.max(F.when(F.col("fill") == "SELL", F.col("fill_price"))).alias("exit_price"),
        F.exp(F.sum(F.log("factor"))).alias("growth"), F.count_if(F.col("position") == 1).alias("sessions"))
    return g.withColumns({"trade_return": F.col("growth") - 1, "is_open": F.col("exit_date").isNull()})


def metrics(curve: DataFrame, trade_rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Return, CAGR (a year or more), maximum drawdown, Sharpe, exposure, win rate, closed trades."""
    k = keys or KEY
    w = over(k)
    d = curve.withColumns({"_ret": F.col("equity") / F.coalesce(F.lag("equity").over(w), F.lit(1.0)) - 1, "_dd": drawdown("equity", w, 1.0)})
    g = d.groupBy(*k).agg(
        F.max_by("equity", "trade_date").alias("final_equity"), F.min("_dd").alias("max_drawdown"),
        F.when(F.stddev_samp("_ret") > 0, F.avg("_ret") / F.stddev_samp("_ret") * F.sqrt(F.lit(252.0))).alias("sharpe"),
        F.avg(F.col("position").cast("double")).alias("exposure"), F.datediff(F.max("trade_date"), F.min("trade_date")).alias("days"))
    annual = F.when(F.col("days") >= 365, F.pow(F.col("final_equity"), 365.25 / F.col("days")))
    g = g.withColumns({"total_return": F.col("final_equity") - 1, "annual_growth": annual, "cagr": annual - 1})
    t = trade_rows.where(~F.col("is_open")).groupBy(*k).agg(F.count("*").alias("closed_trades"), F.avg((F.col("trade_return") > 0).cast("double")).alias("win_rate"))
    return g.join(t, k, "left").fillna(0, ["closed_trades"])


def buy_and_hold(bars: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """First open to last close and maximum drawdown per ticker, optionally from per-key start dates."""
    b = bars if starts is None else bars.join(starts, "ticker").where(F.col("trade_date") >= F.col("start"))
    k = ["ticker"] if starts is None else [c for c in starts.columns if c != "start"]
    b = b.withColumn("_open", F.first("open").over(over(k).rowsBetween(UNBOUNDED, 0)))
    b = b.withColumn("_eq", F.col("close") / F.col("_open"))
    b = b.withColumn("_dd", drawdown("_eq", over(k), 1.0))
    return b.groupBy(*k).agg((F.max_by("_eq", "trade_date") - 1).alias("hold_return"), F.min("_dd").alias("hold_drawdown"), F.min("trade_date").alias("hold_start"))


def quarter_returns(curve: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Return of each calendar quarter from the last equity of the previous one."""
    k = keys or KEY
    q = curve.groupBy(*k, F.to_date(F.date_trunc("quarter", "trade_date")).alias("quarter")).agg(F.max_by("equity", "trade_date").alias("equity"))
    return q.withColumn("quarter_return", F.col("equity") / F.coalesce(F.lag("equity").over(over(k, "quarter")), F.lit(1.0)) - 1)


def walk_forward(curve: DataFrame, fee_bps: float = 5.0, slippage_bps: float = 5.0, min_sessions: int = 200) -> DataFrame:
    """Rule chosen per (ticker, quarter) by net wealth known before the quarter; hold wins ties.

    The wealth at a quarter's end (less the cost of closing an open position) is the score of the
    next quarter, so one windowed aggregate replaces the retraining loop.
    """
    exit_cost = (1 - slippage_bps / 10_000) * (1 - fee_bps / 10_000)
    net = F.col("equity") * F.when(F.col("position") == 1, exit_cost).otherwise(1.0)
    q = curve.groupBy("ticker", "rule", F.to_date(F.date_trunc("quarter", "trade_date")).alias("quarter")).agg(
        F.max_by(net, "trade_date").alias("_net"), F.max_by("equity", "trade_date").alias("_eq"), F.count("*").alias("_n"), F.min("trade_date").alias("decision_date"))
    w = over(KEY, "quarter")
    q = q.withColumns({"score": F.lag("_net").over(w) - 1, "sessions": F.coalesce(F.sum("_n").over(w.rowsBetween(UNBOUNDED, -1)), F.lit(0)),
                       "forward_return": F.col("_eq") / F.lag("_eq").over(w) - 1})
    q = q.where(F.col("sessions") >= min_sessions)
    prio = F.when(F.col("rule") == "hold", 0).otherwise(F.array_position(F.array(*[F.lit(r) for r in RULES]), F.col("rule")).cast("int"))
    best = F.struct(F.col("score"), -prio)
    return q.groupBy("ticker", "quarter").agg(F.max_by("rule", best).alias("selected"), F.max("score").alias("train_return"),
                                              F.max_by("forward_return", best).alias("forward_return"), F.min("decision_date").alias("decision_date"))


def rolling_windows(curve: DataFrame, months: int = 12, keys: list[str] | None = None) -> DataFrame:
    """Return of every window of ``months`` starting each month; complete windows only."""
    k = keys or KEY
    m = curve.groupBy(*k, F.trunc("trade_date", "month").alias("month")).agg(F.max_by("equity", "trade_date").alias("end_equity"), F.min_by(F.struct("equity", "factor"), "trade_date").alias("f"))
    m = m.withColumn("start_equity", F.col("f.equity") / F.col("f.factor"))
    end = m.select(*k, F.add_months("month", -(months - 1)).alias("month"), F.col("end_equity").alias("_end"))
    return m.select(*k, "month", "start_equity").join(end, [*k, "month"]).withColumn("window_growth", F.col("_end") / F.col("start_equity")).withColumn("window_return", F.col("window_growth") - 1).drop("_end", "start_equity")


def rebuy_pairs(curve: DataFrame, fee_bps: float = 5.0) -> DataFrame:
    """Each sell with the next buy: unit multiplier net of both fees, sessions in cash, open pairs."""
    w = over(KEY)
    fee = fee_bps / 10_000
    d = curve.withColumn("_n", F.row_number().over(w)).where("fill IS NOT NULL")
    d = d.withColumns({c: F.lead(x).over(w) for c, x in (("rebuy_date", "trade_date"), ("rebuy_price", "fill_price"), ("_m", "_n"))})
    s = d.where("fill = 'SELL'")
    return s.select(*KEY, F.col("trade_date").alias("sell_date"), F.col("fill_price").alias("sell_price"), "rebuy_date", "rebuy_price", (F.col("_m") - F.col("_n")).alias("cash_sessions"),
                    (F.col("sell_price") * (1 - fee) / (F.col("rebuy_price") * (1 + fee))).alias("unit_multiplier"), F.col("rebuy_date").isNull().alias("is_open"))


def exposure_reductions(curve: DataFrame, exposure: str, keys: list[str]) -> DataFrame:
    """Intervals of reduced exposure with the baseline's move over each (gaps and islands)."""
    w = over(keys)
    low = F.col(exposure) < 1
    d = curve.withColumn("_start", low & ~F.coalesce(F.lag(exposure).over(w) < 1, F.lit(False)))
    d = d.withColumns({"_i": F.sum(F.col("_start").cast("int")).over(w.rowsBetween(UNBOUNDED, 0)), "_pc": F.lag("close").over(w)}).where(low)
    return d.groupBy(*keys, F.col("_i").alias("interval")).agg(
        F.min("trade_date").alias("from_date"), F.max("trade_date").alias("to_date"), F.count("*").alias("sessions"), F.avg(exposure).alias("average_exposure"),
        (F.max_by("close", "trade_date") / F.min_by(F.coalesce("_pc", "close"), "trade_date") - 1).alias("baseline_return"))


def wealth_attribution(curve: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Log wealth against holding: missed rallies, avoided declines, costs, and a residual that must be zero."""
    k = keys or KEY
    w = over(k)
    d = curve.withColumns({"_pc": F.lag("close").over(w), "_hold": F.log(F.col("close") / F.coalesce(F.lag("close").over(w), F.col("open"))), "_log": F.log("factor")})
    buy, sell = F.col("fill") == "BUY", F.col("fill") == "SELL"
    gap = F.when(F.coalesce(buy, F.lit(False)), F.log(F.col("open") / F.coalesce("_pc", "open"))).when(F.coalesce(sell, F.lit(False)), F.log(F.col("close") / F.col("open"))) \
        .when(F.col("position") == 0, F.col("_hold")).otherwise(0.0)
    d = d.withColumns({"_missed": gap, "_cost": F.col("_hold") - gap - F.col("_log")})
    g = d.groupBy(*k).agg(F.sum("_log").alias("strategy_log"), F.sum("_hold").alias("hold_log"), F.sum(F.when(F.col("_missed") > 0, F.col("_missed")).otherwise(0.0)).alias("missed_rallies"),
                          F.sum(F.when(F.col("_missed") < 0, -F.col("_missed")).otherwise(0.0)).alias("avoided_declines"),
                          F.sum(F.when(F.col("fill").isNotNull(), F.col("_cost")).otherwise(0.0)).alias("costs"))
    return g.withColumn("residual", F.col("strategy_log") - (F.col("hold_log") - F.col("missed_rallies") + F.col("avoided_declines") - F.col("costs")))


def decorate(curve: DataFrame, initial: float = 100_000.0, fee_bps: float = 5.0, keys: list[str] | None = None) -> DataFrame:
    """Cash, units, exposure, unit change and fee columns of an all-in / all-out curve."""
    w = over(keys or KEY)
    wealth = F.col("equity") * initial
    d = curve.withColumn("units", F.when(F.col("position") == 1, wealth / F.col("close")).otherwise(0.0))
    d = d.withColumns({"cash": F.when(F.col("position") == 1, 0.0).otherwise(wealth), "exposure": F.col("position").cast("double"),
                       "delta_units": F.when(F.col("fill") == "BUY", F.col("units")).when(F.col("fill") == "SELL", -F.lag("units").over(w)).otherwise(0.0)})
    return d.withColumn("fee", F.abs("delta_units") * F.coalesce("fill_price", F.lit(0.0)) * fee_bps / 10_000)


def dollar_attribution(dec: DataFrame, initial: float = 100_000.0, keys: list[str] | None = None) -> DataFrame:
    """P&L split into overnight, intraday, slippage and fees with a zero residual."""
    k = keys or KEY
    w = over(k)
    d = dec.withColumns({"_u": F.coalesce(F.lag("units").over(w), F.lit(0.0)), "_pc": F.lag("close").over(w)})
    g = d.groupBy(*k).agg(
        F.sum(F.col("_u") * (F.col("open") - F.coalesce("_pc", "open"))).alias("overnight"), F.sum(F.col("units") * (F.col("close") - F.col("open"))).alias("intraday"),
        F.sum(F.abs("delta_units") * F.abs(F.coalesce(F.col("fill_price") - F.col("open"), F.lit(0.0)))).alias("slippage"), F.sum("fee").alias("fees"),
        F.max_by(F.col("equity") * initial, "trade_date").alias("final_wealth"), F.max(F.col("equity") * initial).alias("peak_wealth"))
    return g.withColumn("residual", F.col("final_wealth") - initial - (F.col("overnight") + F.col("intraday") - F.col("slippage") - F.col("fees")))


def blend(curve: DataFrame, core: str, tactical: str, weights: list[float]) -> DataFrame:
    """Two-sleeve blends of rule curves per weight of the tactical sleeve (sleeves drift, no rebalancing)."""
    c = curve.where(F.col("rule").isin(core, tactical))
    p = c.groupBy("ticker", "trade_date").agg(*[e for r in (core, tactical) for e in (
        F.max(F.when(F.col("rule") == r, F.col("equity"))).alias(f"{r}_eq"), F.max(F.when(F.col("rule") == r, F.col("position"))).alias(f"{r}_pos"))])
    p = p.withColumn("weight", F.explode(F.array(*[F.lit(w) for w in weights])))
    a, b = (1 - F.col("weight")) * F.col(f"{core}_eq"), F.col("weight") * F.col(f"{tactical}_eq")
    return p.select("ticker", "trade_date", "weight", (a + b).alias("equity"), ((a * F.col(f"{core}_pos") + b * F.col(f"{tactical}_pos")) / (a + b)).alias("exposure"))


def liquidated(curve: DataFrame, fee_bps: float = 5.0, slippage_bps: float = 5.0, keys: list[str] | None = None) -> DataFrame:
    """Final equity per key after closing an open position."""
    k = (1 - slippage_bps / 10_000) * (1 - fee_bps / 10_000)
    return curve.groupBy(*(keys or KEY)).agg(F.max_by(F.col("equity") * F.when(F.col("position") == 1, k).otherwise(1.0), "trade_date").alias("settled_equity"))


def compare_rules(m: DataFrame) -> DataFrame:
    """Metrics per rule against the hold row, and the gain of each added layer in rule order."""
    hold = m.where("rule = 'hold'").select("ticker", F.col("total_return").alias("_h"), F.col("final_equity").alias("_hd"))
    order = F.array_position(F.array(*[F.lit(r) for r in RULES]), F.col("rule"))
    d = m.join(hold, "ticker").withColumn("rule_order", order)
    w = over("ticker", "rule_order")
    return d.withColumns({"excess_points": F.col("total_return") - F.col("_h"), "relative_wealth": F.col("final_equity") / F.col("_hd"),
                          "layer_gain": F.col("total_return") - F.lag("total_return").over(w)}).drop("_h", "_hd")


def target_check(m: DataFrame, profit_multiple: float = 1.5, drawdown_share: float = 0.5) -> DataFrame:
    """Does a rule reach the profit multiple of hold and halve its drawdown; accepted if any ticker and all do."""
    hold = m.where("rule = 'hold'").select("ticker", F.col("total_return").alias("_h"), F.col("max_drawdown").alias("_hd"))
    d = m.join(hold, "ticker").withColumns({"profit_ok": F.col("total_return") >= profit_multiple * F.col("_h"), "drawdown_ok": F.col("max_drawdown") >= drawdown_share * F.col("_hd")})
    return d.groupBy("rule").agg(F.bool_and("profit_ok").alias("profit_all"), F.bool_or("profit_ok").alias("profit_any"),
                                 F.bool_and("drawdown_ok").alias("drawdown_all"), F.count_if(F.col("profit_ok") & F.col("drawdown_ok")).alias("accepted"))


def overheat(ind: DataFrame) -> DataFrame:
    """Close above EMA by two ATR with RSI2 above 90, and the same of the prior session."""
    hot = F.coalesce((F.col("close") > F.col("ema") + 2 * F.col("atr")) & (F.col("rsi2") > 90), F.lit(False))
    d = ind.withColumn("overheated", hot)
    w = over()
    return d.withColumns({"overheated_yesterday": F.lag("overheated").over(w), "previous_close": F.lag("close").over(w), "previous_ema": F.lag("ema").over(w)})


def peer_strength(bars: DataFrame, peers: DataFrame, sessions: int = 20) -> DataFrame:
    """20-session return minus the mean of the peers' on the same date; null unless every peer has one."""
    r = bars.select("ticker", "trade_date", returns("close", sessions, over()).alias("ret"))
    p = r.select(F.col("ticker").alias("related_ticker"), "trade_date", F.col("ret").alias("_p"))
    n = peers.groupBy("ticker").agg(F.count("*").alias("_need"))
    m = peers.join(p, "related_ticker").groupBy("ticker", "trade_date").agg(F.avg("_p").alias("_mean"), F.count("_p").alias("_have"))
    d = r.join(m, ["ticker", "trade_date"], "left").join(n, "ticker", "left")
    return d.select("ticker", "trade_date", F.when(F.col("_have") == F.col("_need"), F.col("ret") - F.col("_mean")).alias("relative_return"))


def exposure_caps(ind: DataFrame, relative_return: str = "relative_return", market_weak: str = "market_weak", margins_falling: str = "margins_falling") -> Column:
    """Stateless exposure cap: the lowest of the triggered limits."""
    c = F.col("close")
    return F.least(F.when(c < F.col("sma120"), 0.25).otherwise(1.0), F.when(c < F.col("sma"), 0.5).otherwise(1.0),
                   F.when(F.col(relative_return) < 0, 0.5).otherwise(1.0), F.when(F.col(market_weak) & (c < F.col("ema")), 0.5).otherwise(1.0),
                   F.when(F.col(margins_falling), 0.5).otherwise(1.0))


def fundamental_gates(panel: DataFrame) -> DataFrame:
    """Entry and exit gates on the point-in-time state: state with trend, operating improvement and worsening."""
    c, s = F.col("close"), F.col("sma")
    up = (F.col("revenue_yoy") > 0) & (F.col("revenue_acceleration") > 0) & (F.col("gross_margin_yoy") > 0)
    down = (F.col("revenue_acceleration") < 0) & (F.col("gross_margin_yoy") < 0)
    f = lambda x: F.coalesce(x, F.lit(False))
    return panel.withColumns({
        "state_entry": f((F.col("fin_state") == "EXPANSION") & (c > s)), "state_exit": f((F.col("fin_state") == "DETERIORATION") | (c < s)),
        "improving": f(up), "worsening": f(down), "cycle_entry": f(up & (c > F.col("ema")))})
