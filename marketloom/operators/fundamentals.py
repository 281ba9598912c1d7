"""Point-in-time (bitemporal) fundamentals.

A fact version is visible from its first usable session until it is superseded.  State is
computed once per change point (a session on which some visible version changes) and joined
to sessions by interval; there is no day x fact product.  Work per company grows with its
reporting history, a few rows per quarter.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.functions.dates import disclosure_day
from marketloom.functions.scalar import change, ratio
from marketloom.operators.asof import asof_join, first_above, valid_at
from marketloom.operators.series import latest_per_key

QUARTER_DAYS, ALLOWED_FORMS = (70, 110), ("10-K", "10-Q", "10-K/A", "10-Q/A")


def reject_reason(metrics: tuple[str, ...], unit: str = "USD", forms: tuple[str, ...] = ALLOWED_FORMS) -> Column:
    """Why a flow fact cannot be used; null for a usable one."""
    start, end, filed = (F.col(c) for c in ("period_start", "period_end", "filed_at"))
    days = F.datediff(end, start) + 1
    value = F.col("value")
    return (F.when(~F.col("metric_key").isin(*metrics) | (F.col("unit") != unit), "UNSUPPORTED_METRIC_OR_UNIT")
            .when(~F.col("form").isin(*forms), "UNSUPPORTED_FORM")
            .when(start.isNull() | end.isNull() | filed.isNull() | (end < start) | (end > filed), "INVALID_PERIOD")
            .when(~days.between(70, 380) | value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), "INVALID_DURATION_OR_VALUE"))


def with_known_day(facts: DataFrame, filings: DataFrame | None = None) -> DataFrame:
    """Add ``known``: the filing date, or the later Eastern acceptance date where a filing is given."""
    if filings is None:
        return facts.withColumn("known", F.col("filed_at"))
    f = filings.select("accession_number", F.col("accepted_at").alias("_acc"))
    j = facts.join(f, "accession_number", "left")
    return j.withColumn("known", F.when(F.col("_acc").isNull(), F.col("filed_at")).otherwise(disclosure_day("filed_at", "_acc"))).drop("_acc")


def first_usable_session(facts: DataFrame, calendar: DataFrame, delay: int = 0) -> DataFrame:
    """Add ``usable_from``: the first session strictly after the known day, plus ``delay`` sessions."""
    if delay == 0:
        nxt = calendar.select(F.col("day").alias("known"), F.col("next_session").alias("usable_from"))
        return facts.join(F.broadcast(nxt), "known").where("usable_from IS NOT NULL")
    at = calendar.select(F.col("day").alias("known"), (F.col("session_no") + 1 + delay).alias("_no"))
    to = calendar.where("is_session").select(F.col("session_no").alias("_no"), F.col("day").alias("usable_from"))
    return facts.join(F.broadcast(at), "known").join(F.broadcast(to), "_no").drop("_no")


def vintages(facts: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Versions per (ticker, metric, start, end) with validity [valid_from, valid_to).

    Latest known first, then the lowest tag priority; values that still disagree become null.
    """
    key = ["ticker", "metric_key", "period_start", "period_end"]
    g = facts.groupBy(*key, "usable_from", "known", "tag_priority").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    best = g.groupBy(*key, "usable_from").agg(F.max_by(F.struct("_lo", "_hi", "known"), F.struct("known", -F.col("tag_priority"))).alias("b"))
    conflict = F.col("b._hi") - F.col("b._lo") > F.greatest(F.lit(tolerance), 1e-9 * F.abs("b._hi"))
    w = Window.partitionBy(*key).orderBy("usable_from")
    return best.select(*key, F.col("usable_from").alias("valid_from"), F.lead("usable_from").over(w).alias("valid_to"),
                       F.col("b.known").alias("known"), F.when(~conflict, F.col("b._lo")).alias("value"), conflict.alias("conflict"))


def quarter_values(v: DataFrame) -> DataFrame:
    """Single-quarter versions: direct facts first, else cumulative minus the earlier cumulative.

    Both inputs of a difference carry validity intervals, so the difference is valid on their
    intersection; until the earlier cumulative is visible the derived quarter is null, never an
    older quarter.  One self-join on (ticker, metric, period start) does it; direct quarters ride
    along unmatched.
    """
    key = ["ticker", "metric_key", "period_end"]
    span = F.datediff("period_end", "period_start") + 1
    direct, cumulative = span.between(*QUARTER_DAYS), span > QUARTER_DAYS[1]
    seen = Window.partitionBy(*key)
    c = v.where(direct | cumulative).withColumns({
        "_cum": cumulative, "_direct_from": F.min(F.when(direct, F.col("valid_from"))).over(seen)})
    prev = v.select(F.col("ticker").alias("_t"), F.col("metric_key").alias("_m"), F.col("period_start").alias("_s"), F.col("period_end").alias("_pe"),
                    F.col("valid_from").alias("_pf"), F.col("valid_to").alias("_pt"), F.col("value").alias("_pv"))
    j = c.join(prev, (F.col("ticker") == F.col("_t")) & (F.col("metric_key") == F.col("_m")) & (F.col("period_start") == F.col("_s"))
               & F.col("_cum") & F.datediff("period_end", "_pe").between(*QUARTER_DAYS), "left")
    version = Window.partitionBy(*key, "period_start", "valid_from")
    j = j.withColumn("_first", F.min("_pf").over(version))
    open_end = F.lit("9999-12-31").cast("date")
    overlap = (F.coalesce("valid_to", open_end) > F.col("_pf")) & (F.coalesce("_pt", open_end) > F.col("valid_from"))
    waiting = F.col("_first").isNull() | ((F.col("_pf") == F.col("_first")) & (F.col("_first") > F.col("valid_from")))

    def row(start: Column, frm: Column, to: Column, value: Column) -> Column:
        return F.struct(start.alias("period_start"), frm.alias("valid_from"), to.alias("valid_to"), value.alias("value"), F.col("_cum").alias("derived"))

    # least() skips nulls, so an open end never wins
    rows = F.array_compact(F.array(
        F.when(~F.col("_cum"), row(F.col("period_start"), F.col("valid_from"), F.col("valid_to"), F.col("value"))),
        F.when(F.col("_cum") & overlap, row(F.date_add("_pe", 1), F.greatest("valid_from", "_pf"), F.least("valid_to", "_pt"), F.col("value") - F.col("_pv"))),
        F.when(F.col("_cum") & waiting, row(F.col("period_start"), F.col("valid_from"), F.least("valid_to", "_first"), F.lit(None).cast("double")))))
    q = j.select(*key, "known", "conflict", "_direct_from", F.explode(rows).alias("r")).select(*key, "known", "conflict", "_direct_from", "r.*")
    late = F.col("derived") & (F.col("valid_from") >= F.col("_direct_from"))
    return q.where(~F.coalesce(late, F.lit(False))).withColumn(
        "valid_to", F.when(F.col("derived"), F.least("valid_to", "_direct_from")).otherwise(F.col("valid_to"))).drop("_direct_from")


def change_points(q: DataFrame, lead_metric: str, metrics: list[str], reach: int = 600) -> DataFrame:
    """Per (ticker, change point) the visible quarters, newest first, as a bounded array.

    However old a quarter is, it counts; left out are those that end more than ``reach`` days before one that
    stays visible for good (the consumers look back 490 days from the newest, or over four quarters in a row).

    Each element holds end, start and one value per metric; a metric whose quarter does not
    start where the lead metric's does is null.
    """
    stays = F.when((F.col("metric_key") == lead_metric) & F.col("valid_to").isNull(), F.col("period_end"))
    cps = q.groupBy("ticker", F.col("valid_from").alias("cp")).agg(F.max(stays).alias("_newest"))
    cps = cps.withColumn("_newest", F.max("_newest").over(Window.partitionBy("ticker").orderBy("cp")))  # one row per change point
    # a quarter is asked for from its first day in force to the day before it is replaced or falls out of reach
    q = first_above(q, cps, ["ticker"], F.date_add("period_end", reach), "_newest", "cp", "_gone")
    q = q.withColumn("_until", F.least(F.date_sub("valid_to", 1), F.date_sub("_gone", 1)))
    vis = valid_at(q, cps.select("ticker", "cp"), ["ticker"], "cp", "valid_from", "_until")
    per = vis.groupBy("ticker", "cp", "period_end").agg(
        F.max(F.when(F.col("metric_key") == lead_metric, F.col("period_start"))).alias("start"),
        *[F.max(F.when(F.col("metric_key") == m, F.struct(F.col("period_start").alias("s"), F.col("value").alias("v")))).alias(m) for m in metrics])
    per = per.where(F.col("start").isNotNull())
    elem = F.struct(F.col("period_end").alias("end"), "start", *[
        F.when(F.col(f"{m}.s") == F.col("start"), F.col(f"{m}.v")).alias(m) for m in metrics])
    return per.groupBy("ticker", "cp").agg(F.sort_array(F.collect_list(elem), asc=False).alias("qs"))


def _find(qs: Column, end: Column, lo: int, hi: int, target: int | None) -> Column:
    """The quarter ending lo..hi days before ``end``: nearest to ``target``, else the newest."""
    near = F.filter(qs, lambda x: F.datediff(end, x["end"]).between(lo, hi))
    if target is None:
        return F.get(near, F.lit(0))
    best = F.array_min(F.transform(near, lambda x: F.struct(F.abs(F.datediff(end, x["end"]) - target).alias("d"), x["end"].alias("end"))))
    return F.get(F.filter(near, lambda x: x["end"] == best["end"]), F.lit(0))


def trailing_four(panel: DataFrame, lead: str, metrics: list[str]) -> DataFrame:
    """Sums over the newest four quarters if they are contiguous (gap of at most 3 days) and complete."""
    q4 = F.slice("qs", 1, 4)
    whole = (F.size("qs") >= 4)
    gaps_ok = F.forall(F.sequence(F.lit(0), F.lit(2)), lambda i: F.abs(F.datediff(F.col("q4")[i]["start"], F.col("q4")[i + 1]["end"]) - 1) <= 3)
    complete = F.forall("q4", lambda x: _all([x[m].isNotNull() for m in metrics]))
    d = panel.withColumn("q4", F.when(whole, q4))
    d = d.withColumn("valid4", F.coalesce(F.when(F.col("q4").isNotNull(), gaps_ok & complete), F.lit(False)))

    def total(m: str) -> Column:
        return F.when(F.col("valid4"), F.aggregate("q4", F.lit(0.0), lambda acc, x: acc + x[m]))

    return d.withColumns({f"{m}_ttm": total(m) for m in metrics} | {"fin_period": F.get("qs", F.lit(0))["end"]}).drop("q4")


def _all(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def growth_state(panel: DataFrame) -> DataFrame:
    """Revenue YoY and its acceleration, gross margin with YoY, operating margin and FCF TTM per change point."""
    qs = F.col("qs")
    d = panel.withColumns({"q0": F.get(qs, F.lit(0))})
    d = d.withColumns({"y0": _find(qs, F.col("q0.end"), 350, 380, 365), "p0": _find(qs, F.col("q0.end"), 70, 110, None)})
    d = d.withColumn("py", _find(qs, F.col("p0.end"), 350, 380, 365))

    def growth(now: str, old: str) -> Column:
        span = lambda q: F.datediff(F.col(f"{q}.end"), F.col(f"{q}.start"))
        return F.when((F.col(f"{old}.revenue") > 0) & (F.abs(span(now) - span(old)) <= 14), F.col(f"{now}.revenue") / F.col(f"{old}.revenue") - 1)

    def margin(q: str, metric: str) -> Column:
        return F.when(F.col(f"{q}.revenue") > 0, F.col(f"{q}.{metric}") / F.col(f"{q}.revenue"))

    d = d.withColumns({
        "fin_period": F.col("q0.end"), "revenue_yoy": growth("q0", "y0"), "_pg": growth("p0", "py"),
        "gross_margin": margin("q0", "grossProfit"), "operating_margin": margin("q0", "operatingIncome"),
        "net_margin": margin("q0", "netIncome"), "ocf_margin": margin("q0", "operatingCashFlow"),
        "_gy": margin("y0", "grossProfit"), "_oy": margin("y0", "operatingIncome"), "_cy": margin("y0", "operatingCashFlow"),
        "_pgm": margin("p0", "grossProfit") - margin("py", "grossProfit"),
        "cash_conversion": F.when(F.col("q0.netIncome") != 0, F.col("q0.operatingCashFlow") / F.abs("q0.netIncome"))})
    d = d.withColumns({
        "revenue_acceleration": F.col("revenue_yoy") - F.col("_pg"), "gross_margin_yoy": F.col("gross_margin") - F.col("_gy"),
        "operating_margin_yoy": F.col("operating_margin") - F.col("_oy"), "ocf_margin_yoy": F.col("ocf_margin") - F.col("_cy")})
    d = d.withColumn("gross_margin_acceleration", F.col("gross_margin_yoy") - F.col("_pgm"))
    t = trailing_four(d.withColumn("qs", F.transform("qs", lambda x: x.withField("fcf", F.when(x["capitalExpenditure"] >= 0, x["operatingCashFlow"] - x["capitalExpenditure"])))),
                      "revenue", ["fcf"])
    return t.drop("q0", "y0", "p0", "py", "_pg", "_gy", "_oy", "_cy", "_pgm", "valid4", "qs")


def financial_state(day: str, d: DataFrame) -> Column:
    """EXPANSION / DETERIORATION / NEUTRAL / STALE / UNKNOWN on a day."""
    yoy, gm, fcf = F.col("revenue_yoy"), F.col("gross_margin_yoy"), F.col("fcf_ttm")
    return (F.when(F.col("fin_period").isNull(), "UNKNOWN").when(F.datediff(F.col(day), F.col("fin_period")) > 180, "STALE")
            .when(yoy.isNull() | gm.isNull() | fcf.isNull(), "UNKNOWN").when((yoy > 0) & (gm >= 0) & (fcf > 0), "EXPANSION")
            .when((yoy < 0) & (gm < 0), "DETERIORATION").otherwise("NEUTRAL"))


def daily_panel(sessions: DataFrame, states: DataFrame, day: str, columns: list[str]) -> DataFrame:
    """State of every (ticker, session): the newest change point at or before the session."""
    return asof_join(sessions, states, ["ticker"], day, "cp", columns)


def balance_vintages(facts: DataFrame) -> DataFrame:
    """Balance-sheet instants with the same disclosure clock as flows."""
    return vintages(facts.withColumn("period_start", F.col("period_end")))


def quality_ratios(ttm: DataFrame, balance: DataFrame) -> DataFrame:
    """Net margin, cash-flow margin and -liabilities/assets at the newest period, per change point."""
    b = balance.where(F.col("metric_key").isin("assets", "liabilities"))
    x = ttm.drop("qs")
    vis = x.alias("x").join(b.alias("b"), (F.col("x.ticker") == F.col("b.ticker")) & (F.col("b.period_end") == F.col("x.fin_period"))
                            & (F.col("b.valid_from") <= F.col("x.cp")) & (F.col("b.valid_to").isNull() | (F.col("b.valid_to") > F.col("x.cp"))), "left")
    d = vis.groupBy(*[F.col(f"x.{c}") for c in x.columns]).agg(
        F.max(F.when(F.col("metric_key") == "assets", F.col("b.value"))).alias("assets"),
        F.max(F.when(F.col("metric_key") == "liabilities", F.col("b.value"))).alias("liabilities"))
    ok = F.col("valid4") & (F.col("revenue_ttm") > 0) & (F.col("assets") > 0) & (F.col("liabilities") >= 0)
    return d.withColumns({"net_margin_ttm": F.when(ok, F.col("netIncome_ttm") / F.col("revenue_ttm")),
                          "ocf_margin_ttm": F.when(ok, F.col("operatingCashFlow_ttm") / F.col("revenue_ttm")),
                          "balance_safety": F.when(ok, -F.col("liabilities") / F.col("assets"))})


def annual_series(facts: DataFrame) -> DataFrame:
    """One annual value per (ticker, metric, period_end): latest filed, then lowest tag priority."""
    return latest_per_key(facts, ["ticker", "metric_key", "period_end"], ["filed_at", -F.col("tag_priority")])


def year_ago_period(periods: DataFrame, keys: list[str], lo: int = 250, hi: int = 470) -> DataFrame:
    """The comparable period about a year earlier: nearest to 365 days, ties to the newer.

    One row per reporting period and key, so the in-key comparison is bounded by a company's
    own reporting history.
    """
    a, b = periods.alias("a"), periods.alias("b")
    on = F.datediff("a.period_end", "b.period_end").between(lo, hi)
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    j = a.join(b, on)
    best = j.groupBy(*[F.col(f"a.{c}") for c in periods.columns]).agg(F.max_by(
        F.struct(F.col("b.period_end").alias("e"), F.col("b.value").alias("v")),
        F.struct(-F.abs(F.datediff("a.period_end", "b.period_end") - 365), F.col("b.period_end"))).alias("_p"))
    return best.select(*periods.columns, F.col("_p.e").alias("prior_end"), F.col("_p.v").alias("prior_value"))


def derived_liabilities(facts: DataFrame) -> DataFrame:
    """liabilities = assets - equity of one filing and period end, where no liabilities fact exists
    there and each input is a single distinct value."""
    key = ["ticker", "accession_number", "period_end", "filed_at"]
    g = facts.groupBy(*key).agg(*[
        e for m in ("assets", "equity") for e in (
            F.max(F.when(F.col("metric_key") == m, F.col("value"))).alias(m),
            F.countDistinct(F.when(F.col("metric_key") == m, F.col("value"))).alias(f"n_{m}"))],
        F.count_if(F.col("metric_key") == "liabilities").alias("_has"))
    return (g.where("n_assets = 1 AND n_equity = 1 AND _has = 0 AND assets >= equity")
            .select(*key, (F.col("assets") - F.col("equity")).alias("liabilities")))


def split_factor(points: DataFrame, splits: DataFrame, on: str, after: str, through: str | None, genuine_only: bool, out: str) -> DataFrame:
    """Product of the split ratios dated in (after, through] per row (1 where there is none)."""
    s = splits.where("genuine") if genuine_only else splits
    cond = (F.col(f"p.{on}") == F.col(f"s.{on}")) & (F.col("s.split_date") > F.col(f"p.{after}"))
    if through:
        cond = cond & (F.col("s.split_date") <= F.col(f"p.{through}"))
    j = points.alias("p").join(s.alias("s"), cond, "left")
    return (j.groupBy(*[F.col(f"p.{c}") for c in points.columns])
            .agg(F.coalesce(F.product("s.ratio"), F.lit(1.0)).alias(out)))


def visible_shares(days: DataFrame, records: DataFrame, splits: DataFrame, max_age: int = 550) -> DataFrame:
    """Shares outstanding known strictly before a day: newest period end, lowest priority, newest
    filing, null on conflict, scaled by genuine splits since the period end.

    ``records``: ticker, end, known, priority, value.  Share versions become change points, so
    days join one row each.
    """
    cps = records.select("ticker", F.col("known").alias("cp")).distinct()
    vis = cps.join(records, "ticker").where((F.col("known") <= F.col("cp")) & (F.col("end") >= F.date_sub("cp", 2 * max_age)))
    rank = F.struct(F.col("end"), -F.col("priority"), F.col("known"))
    top = vis.groupBy("ticker", "cp").agg(F.max(rank).alias("k"))
    best = (vis.join(top, ["ticker", "cp"]).where(rank == F.col("k")).groupBy("ticker", "cp")
            .agg(F.max("end").alias("share_end"), F.min("value").alias("_lo"), F.max("value").alias("_hi")))
    best = best.withColumn("shares_raw", F.when(F.col("_hi") - F.col("_lo") <= 1e-9 * F.col("_hi"), F.col("_lo")))
    d = asof_join(days, best, ["ticker"], "trade_date", "cp", ["share_end", "shares_raw"], strict=True)
    d = d.withColumn("shares_raw", F.when(F.datediff("trade_date", "share_end") <= max_age, F.col("shares_raw")))
    d = split_factor(d, splits, "ticker", "share_end", "trade_date", True, "_k")
    return d.withColumn("shares", F.col("shares_raw") * F.col("_k")).drop("shares_raw", "_k")


def local_market_cap(price: Column, shares: Column, adr_ratio: Column, currency: Column, fx: Column) -> Column:
    """Market value in the reporting currency (TWD quotes multiply, EUR quotes divide)."""
    usd = price * shares / adr_ratio
    return F.when(currency == "TWD", usd * fx).when(currency == "EUR", usd / fx).otherwise(usd)


def period_table(facts: DataFrame, metrics: list[str], latest: int = 8) -> DataFrame:
    """Latest periods per ticker and period type with one column per metric."""
    best = latest_per_key(facts, ["ticker", "period_type", "period_end", "metric_key"], ["filed_at", -F.col("tag_priority")])
    p = best.groupBy("ticker", "period_type", "period_end").pivot("metric_key", metrics).agg(F.max("value"))
    w = Window.partitionBy("ticker", "period_type").orderBy(F.col("period_end").desc())
    return p.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= latest)


def period_analysis(p: DataFrame) -> DataFrame:
    """QoQ and YoY revenue change, margins, free cash flow and cash conversion per period."""
    w = Window.partitionBy("ticker").orderBy("period_end")
    prior_q = F.when(F.datediff("period_end", F.lag("period_end").over(w)).between(70, 120), F.lag("revenue").over(w))
    ya = year_ago_period(p.select("ticker", "period_end", F.col("revenue").alias("value")), ["ticker"])
    d = p.withColumn("_pq", prior_q).join(ya.select("ticker", "period_end", "prior_value"), ["ticker", "period_end"], "left")
    return d.withColumns({
        "revenue_qoq": change("revenue", "_pq"), "revenue_yoy": change("revenue", "prior_value"),
        "gross_margin": ratio("grossProfit", "revenue"), "operating_margin": ratio("operatingIncome", "revenue"), "net_margin": ratio("netIncome", "revenue"),
        "free_cash_flow": F.col("operatingCashFlow") - F.abs("capitalExpenditure"),
        "cash_conversion": F.when(F.col("netIncome") != 0, F.col("operatingCashFlow") / F.abs("netIncome"))}).drop("_pq", "prior_value")


def comparable_series(facts: DataFrame) -> DataFrame:
    """Each period of a corporate-action metric with the previous period of the same type and its change."""
    best = latest_per_key(facts, ["ticker", "metric_key", "period_type", "period_end"], ["filed_at", -F.col("tag_priority")])
    w = Window.partitionBy("ticker", "metric_key", "period_type").orderBy("period_end")
    d = best.withColumns({"previous_end": F.lag("period_end").over(w), "previous_value": F.lag("value").over(w)})
    return d.withColumn("change_pct", change("value", "previous_value"))
