"""FIFO lots, positions, daily and monthly P&L, risk - set-based over all tickers and dates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.functions.scalar import ratio, rnd
from marketloom.operators.aggregates import complete_or_null
from marketloom.operators.asof import asof_join
from marketloom.operators.series import drawdown, over, returns, running_total

QTY = "decimal(28,8)"      # quantities add exactly, whatever the order
MONEY = "decimal(38,10)"
UNBOUNDED = Window.unboundedPreceding


def signed_quantity() -> Column:
    return F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))


def _hot(day: Column) -> Column:
    return F.trunc(day, "month")


def oversells(trades: DataFrame) -> DataFrame:
    """Sells that take the running position below zero (first violation rows of the ledger)."""
    t = running_total(trades, ["ticker"], "trade_date", ["id"], {"running": signed_quantity().cast(QTY)})
    return t.where((F.col("side") == "SELL") & (F.col("running") < -1e-8)).withColumn("running", F.col("running").cast("double"))


def fifo_matches(trades: DataFrame, rows_per_bucket: int = 100_000) -> DataFrame:
    """(ticker, buy_id, sell_id, quantity, unit_cost, unit_proceeds, sell_date): one row per matched slice.

    Buys and sells each tile the quantity axis of a ticker with half-open intervals.  Between two
    consecutive interval starts exactly one buy lot and one sell are active, so a single ordered
    scan over the starts ("last buy start, last sell start") yields every slice: linear, with no
    pairs.  A hot ticker's axis is cut into buckets of about ``rows_per_bucket`` trades; the lots
    still open at a bucket's edge are carried in from a one-row-per-bucket table.
    """
    cum = running_total(trades.where("quantity > 0"), ["ticker", "side"], "trade_date", ["id"],
                        {"hi": F.col("quantity").cast(QTY)})
    qty = F.col("quantity")
    gross = qty * F.col("price")
    unit = F.when(F.col("side") == "BUY", (gross + F.col("fee")) / qty).otherwise((gross - F.col("fee")) / qty)
    lot = F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"), F.col("id").alias("id"), F.col("unit").alias("unit"), F.col("trade_date").alias("day"))
    rows = (cum.withColumns({"lo": (F.col("hi") - F.col("quantity").cast(QTY)).cast(QTY), "unit": unit, "hi": F.col("hi").cast(QTY)})
            .select("ticker", "lo", "side", lot.alias("lot")))
    # bucket width per ticker from plain totals: no need to wait for the running sums
    totals = trades.where("quantity > 0").groupBy("ticker", "side").agg(F.sum(F.col("quantity").cast(QTY)).cast("double").alias("_t"), F.count("*").alias("_n"))
    width = totals.groupBy("ticker").agg((F.max("_t") / F.ceil(F.sum("_n") / rows_per_bucket)).alias("_w"))
    rows = rows.join(width, "ticker").withColumn("_b", F.floor(F.col("lo").cast("double") / F.col("_w")))
    rows = rows.withColumns({"_buy": F.when(F.col("side") == "BUY", F.col("lot")), "_sell": F.when(F.col("side") == "SELL", F.col("lot"))})
    wb = Window.partitionBy("ticker").orderBy("_b").rowsBetween(UNBOUNDED, -1)
    carry = rows.groupBy("ticker", "_b").agg(F.max("_buy").alias("_cb"), F.max("_sell").alias("_cs")).select(
        "ticker", "_b", F.last("_cb", True).over(wb).alias("_cb"), F.last("_cs", True).over(wb).alias("_cs"))
    w = Window.partitionBy("ticker", "_b").orderBy("lo", "side")
    seen = w.rowsBetween(UNBOUNDED, 0)
    rows = rows.withColumns({"_lb": F.last("_buy", True).over(seen), "_ls": F.last("_sell", True).over(seen), "_next": F.lead("lo").over(w)})
    rows = rows.where(F.col("_next").isNull() | (F.col("_next") != F.col("lo"))).join(carry, ["ticker", "_b"])
    rows = rows.withColumns({"b": F.coalesce("_lb", "_cb"), "s": F.coalesce("_ls", "_cs")})
    matched = F.least("b.hi", "s.hi") - F.col("lo")
    return rows.where(F.col("b").isNotNull() & F.col("s").isNotNull() & (matched > 0)).select(
        "ticker", F.col("b.id").alias("buy_id"), F.col("s.id").alias("sell_id"), matched.cast("double").alias("quantity"),
        F.col("b.unit").alias("unit_cost"), F.col("s.unit").alias("unit_proceeds"), F.col("s.day").alias("sell_date"))


def trade_cash(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Bought / sold quantity and cash with fees (in cost and against proceeds) per key."""
    gross, buy = F.col("quantity") * F.col("price"), F.col("side") == "BUY"

    def total(c: Column, t: str) -> Column:
        return F.sum(c.cast(t)).cast("double")

    return trades.groupBy(*keys).agg(
        total(F.when(buy, F.col("quantity")).otherwise(0), QTY).alias("bought"),
        total(F.when(~buy, F.col("quantity")).otherwise(0), QTY).alias("sold"),
        total(F.when(buy, gross + F.col("fee")).otherwise(0), MONEY).alias("buy_cash"),
        total(F.when(~buy, gross - F.col("fee")).otherwise(0), MONEY).alias("sell_cash"))


def lots_summary(trades: DataFrame) -> DataFrame:
    """Quantity, remaining cost, average cost, realized P&L and cash totals per ticker."""
    cash = trade_cash(trades, ["ticker"])
    used = fifo_matches(trades).groupBy("ticker").agg(
        F.sum((F.col("quantity") * F.col("unit_cost")).cast(MONEY)).cast("double").alias("consumed"))
    d = cash.join(used, "ticker", "left").withColumn("consumed", F.coalesce("consumed", F.lit(0.0)))
    d = d.withColumns({"quantity": F.col("bought") - F.col("sold"), "remaining_cost": F.col("buy_cash") - F.col("consumed"),
                       "realized_pnl": F.col("sell_cash") - F.col("consumed")})
    return d.withColumn("average_cost", F.when(F.col("quantity") > 1e-8, F.col("remaining_cost") / F.col("quantity")))


def positions(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Lots valued at the latest close: market value, unrealized and total P&L, total return."""
    latest = bars.groupBy("ticker").agg(F.max_by("close", "trade_date").alias("current_price"), F.max("trade_date").alias("price_date"))
    p = lots_summary(trades).join(latest, "ticker", "left")
    p = p.withColumn("market_value", F.col("quantity") * F.col("current_price"))
    p = p.withColumn("unrealized_pnl", F.col("market_value") - F.col("remaining_cost"))
    p = p.withColumn("total_pnl", F.col("unrealized_pnl") + F.col("realized_pnl"))
    return p.withColumn("total_return", F.when(F.col("buy_cash") > 1e-8, F.col("total_pnl") / F.col("buy_cash")))


def held(trades: DataFrame, as_of: Column | str | None = None) -> DataFrame:
    """Tickers with a positive position at the as-of date."""
    t = trades if as_of is None else trades.where(F.col("trade_date") <= as_of)
    return (t.groupBy("ticker").agg(F.sum(signed_quantity().cast(QTY)).cast("double").alias("position"))
            .where(F.col("position") > 1e-8))


def daily_pnl(trades: DataFrame, bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """P&L per (ticker, priced day) with same-day cash flows.

    Trades on closed days roll to the next session.  A day that needs yesterday's close is
    complete only if the exact previous session is priced; it never bridges a gap.
    """
    from marketloom.functions.dates import session_on_or_after
    roll = session_on_or_after(calendar).withColumnRenamed("day", "trade_date")
    t = trades.join(F.broadcast(roll), "trade_date").drop("trade_date").withColumnRenamed("session_date", "trade_date")
    flows = trade_cash(t, ["ticker", "trade_date"])
    w = over().rowsBetween(UNBOUNDED, 0)
    cum = flows.withColumn("cum_qty", F.sum(F.col("bought") - F.col("sold")).over(w))
    px = bars.select("ticker", "trade_date", "close")
    px = asof_join(px, cum, ["ticker"], "trade_date", "trade_date", ["cum_qty"], strict=True)
    px = px.join(flows, ["ticker", "trade_date"], "left").fillna(0.0, ["bought", "sold", "buy_cash", "sell_cash", "cum_qty"])
    px = px.withColumns({"beginning_quantity": F.col("cum_qty"), "traded": F.col("bought") + F.col("sold") > 0})
    px = px.withColumn("ending_quantity", F.col("beginning_quantity") + F.col("bought") - F.col("sold"))
    px = px.where((F.col("beginning_quantity") > 1e-8) | (F.col("ending_quantity") > 1e-8) | F.col("traded"))
    prev_day = calendar.select(F.col("day").alias("trade_date"), "previous_session")
    prev_px = bars.select("ticker", F.col("trade_date").alias("previous_session"), F.col("close").alias("previous_close"))
    px = px.join(F.broadcast(prev_day), "trade_date").join(prev_px, ["ticker", "previous_session"], "left")
    needs = F.col("beginning_quantity") > 1e-8
    complete = ~needs | F.col("previous_close").isNotNull()
    pnl = (F.col("ending_quantity") * F.col("close") + F.col("sell_cash") - F.col("buy_cash")
           - F.col("beginning_quantity") * F.coalesce("previous_close", F.lit(0.0)))
    return px.withColumns({"complete": complete, "pnl": F.when(complete, pnl)}).select(
        "ticker", "trade_date", "previous_session", "beginning_quantity", "ending_quantity", "close", "previous_close",
        "buy_cash", "sell_cash", "complete", "pnl")


def performance_rollup(daily: DataFrame) -> DataFrame:
    """Year and month totals; a total is null as soon as one of its days is incomplete."""
    days = daily.groupBy("trade_date").agg(
        F.sum(F.coalesce("pnl", F.lit(0.0)).cast(MONEY)).alias("known"), F.max((~F.col("complete")).cast("int")).alias("bad"))
    return days.rollup(F.year("trade_date").alias("year"), F.month("trade_date").alias("month")).agg(
        F.sum("known").cast("double").alias("known_pnl"), complete_or_null("known", "bad").cast("double").alias("total_pnl"),
        F.sum("bad").alias("incomplete_days"))


def daily_snapshots(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Position per (ticker, priced day): quantity, remaining cost, realized and unrealized P&L.

    Remaining cost on a day is the cost bought so far less the cost FIFO sells consumed so far,
    so no lot state is replayed per day.
    """
    cash = trade_cash(trades, ["ticker", "trade_date"])
    used = fifo_matches(trades).groupBy("ticker", F.col("sell_date").alias("trade_date")).agg(
        F.sum((F.col("quantity") * F.col("unit_cost")).cast(MONEY)).cast("double").alias("consumed"))
    d = cash.join(used, ["ticker", "trade_date"], "left").fillna(0.0, ["consumed"])
    w = over().rowsBetween(UNBOUNDED, 0)
    run = lambda c: F.sum(c.cast(MONEY)).over(w).cast("double")
    d = d.select("ticker", "trade_date", run(F.col("bought") - F.col("sold")).alias("quantity"), run(F.col("buy_cash")).alias("_bc"),
                 run(F.col("sell_cash")).alias("_sc"), run(F.col("consumed")).alias("_used"))
    s = asof_join(bars.select("ticker", "trade_date", "close"), d, ["ticker"], "trade_date", "trade_date", ["quantity", "_bc", "_sc", "_used"])
    s = s.where("quantity IS NOT NULL").withColumns({"remaining_cost": F.col("_bc") - F.col("_used"), "realized_pnl": F.col("_sc") - F.col("_used"),
                                                      "market_value": F.col("quantity") * F.col("close")})
    return s.withColumn("unrealized_pnl", F.col("market_value") - F.col("remaining_cost")).drop("_bc", "_sc", "_used")


def sized_trade(cash: Column, units: Column, open_: Column, target: Column, fee_bps: float, slippage_bps: float) -> Column:
    """Units to trade so the position is ``target`` of the post-cost net value (one asset, closed form)."""
    fee, slip = fee_bps / 10_000, slippage_bps / 10_000
    nav = cash + units * open_
    gap = target * nav - units * open_
    buy_rate, sell_rate = slip + (1 + slip) * fee, slip + (1 - slip) * fee
    return F.when(gap >= 0, gap / (open_ * (1 + target * buy_rate))).otherwise(gap / (open_ * (1 - target * sell_rate)))


# ---- portfolio risk ----------------------------------------------------------------------------

def weights(pos: DataFrame) -> DataFrame:
    """Market-value weights of the open positions (one row per held ticker)."""
    p = pos.where("quantity > 0 AND market_value > 0")
    total = p.agg(F.sum("market_value").alias("_total"))
    return p.join(F.broadcast(total)).withColumn("weight", F.col("market_value") / F.col("_total"))


def recent_returns(bars: DataFrame, sessions: int = 91) -> DataFrame:
    """Daily returns of the latest ``sessions`` closes of each ticker."""
    newest = Window.partitionBy("ticker").orderBy(F.col("trade_date").desc())
    b = bars.select("ticker", "trade_date", "close").withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= sessions)
    return b.withColumn("ret", returns("close", 1, over())).where("ret IS NOT NULL").select("ticker", "trade_date", "ret")


def portfolio_returns(rets: DataFrame, w: DataFrame, min_cover: float = 0.8) -> DataFrame:
    """Weighted return per date, renormalised; only dates with enough covered weight."""
    j = rets.join(w.select("ticker", "weight"), "ticker")
    return (j.groupBy("trade_date").agg((F.sum(F.col("ret") * F.col("weight")) / F.sum("weight")).alias("ret"), F.sum("weight").alias("cover"))
            .where(F.col("cover") >= min_cover))


def correlations(rets: DataFrame, min_pairs: int = 20) -> DataFrame:
    """Correlation of each unordered pair of held tickers over their common dates.

    The result lists pairs by definition; its size is bounded by the holdings of one portfolio
    and the 90 latest returns of each, not by the tables.
    """
    left = rets.select(F.col("ticker").alias("left"), "trade_date", F.col("ret").alias("_l"))
    right = rets.select(F.col("ticker").alias("right"), "trade_date", F.col("ret").alias("_r"))
    j = left.join(right, "trade_date").where(F.col("left") < F.col("right"))
    return j.groupBy("left", "right").agg(F.count("*").alias("pairs"), F.when(F.count("*") >= min_pairs, F.corr("_l", "_r")).alias("correlation"))


def historical_drawdown(snapshots: DataFrame) -> DataFrame:
    """Maximum drawdown of the total market value with peak and trough dates (one row per day)."""
    v = snapshots.where("quantity > 0").groupBy("trade_date").agg(F.sum(F.coalesce("market_value", F.lit(0.0)).cast(MONEY)).cast("double").alias("value"))
    w = Window.orderBy("trade_date")  # the day dimension
    d = v.withColumns({"dd": drawdown("value", w), "_peak": F.max("value").over(w.rowsBetween(UNBOUNDED, 0))})
    d = d.withColumn("_new", ~F.col("_peak").eqNullSafe(F.lag("_peak").over(w)))
    d = d.withColumn("peak_date", F.last(F.when(F.col("_new"), F.col("trade_date")), True).over(w.rowsBetween(UNBOUNDED, 0)))
    low = F.struct("dd", "trade_date")
    return d.agg(F.min("dd").alias("max_drawdown"), F.max("peak_date").alias("peak_date"), F.min_by("trade_date", low).alias("trough_date"), F.count("*").alias("days"))


def risk_summary(w: DataFrame, sectors: DataFrame, port: DataFrame, corr: DataFrame) -> DataFrame:
    """Concentration, volatility, mean correlation, risk score and level: one row."""
    s = w.join(sectors, "ticker", "left").groupBy(F.coalesce("sector", F.lit("UNCLASSIFIED")).alias("sector")).agg(F.sum("weight").alias("sw"))
    one = (w.agg(F.count("*").alias("positions"), rnd(F.max("weight"), 6).alias("largest_position"), rnd(F.sum(F.pow(rnd("weight", 6), 2)), 6).alias("hhi"))
           .join(F.broadcast(s.agg(rnd(F.max("sw"), 6).alias("largest_sector"))))
           .join(F.broadcast(port.agg(F.stddev_samp("ret").alias("_sd"))))
           .join(F.broadcast(corr.agg(F.avg(rnd("correlation", 4)).alias("_corr")))))
    vol = F.col("_sd") * (252 ** 0.5)
    score = F.least(F.lit(100.0), F.col("largest_position") * 55 + F.col("largest_sector") * 25
                    + F.greatest(F.lit(0.0), F.coalesce("_corr", F.lit(0.0))) * 10 + F.least(F.lit(1.0), F.coalesce(vol, F.lit(0.0)) / 0.5) * 10)
    return one.select("positions", "largest_position", "largest_sector", "hhi", rnd(vol, 6).alias("annual_volatility"), rnd("_corr", 4).alias("average_correlation"),
                      rnd(score, 2).alias("risk_score"), F.when(score >= 70, "HIGH").when(score >= 45, "MEDIUM").otherwise("LOW").alias("risk_level"))


def review_action(official_risk: Column, weight: Column, total_return: Column, stance: Column) -> Column:
    """Review priority: official risk, concentration, losing and bearish, hold."""
    return (F.when(official_risk, "EXIT_RISK_REVIEW").when(weight > 0.35, "REDUCE_CONCENTRATION_REVIEW")
            .when((total_return <= -0.15) & (stance == "BEARISH"), "REDUCE_RISK_REVIEW").otherwise("HOLD_REVIEW"))
