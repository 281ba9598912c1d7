"""Factor ranks, capped selection and accounts (FAC-*)."""
from pyspark.sql import functions as F

from marketloom.functions.scalar import rnd
from marketloom.operators import factors as O, fundamentals as FU
from marketloom.operators.asof import asof_join
from marketloom.plans import sqlviews as S
from marketloom.plans.q_fundamentals import TTM_METRICS, _QUAL, balance, panel as pit_panel
from marketloom.plans.registry import register
from marketloom.sources import views as V
from marketloom.sources.shared import materialize

r = S.rnd
VARIANTS = [("balanced", 0.4, 0.4, 0.2), ("quality", 0.6, 0.2, 0.2), ("momentum", 0.2, 0.6, 0.2)]
_MR = "(rank() OVER (PARTITION BY {p} ORDER BY {c}) + (count(*) OVER (PARTITION BY {p}, {c}) - 1) / 2e0) / count(*) OVER (PARTITION BY {p})"
mr = lambda c, p="month": _MR.format(c=c, p=p)

PANEL = _QUAL + """,
qs AS (SELECT ticker, cp, CASE WHEN n = 4 AND contiguous AND rev > 0 THEN ni / rev END AS net_margin_ttm, CASE WHEN n = 4 AND contiguous AND rev > 0 THEN ocf / rev END AS ocf_margin_ttm, CASE WHEN n = 4 AND contiguous AND rev > 0 THEN -liabilities / assets END AS balance_safety, CASE WHEN n = 4 AND contiguous THEN ni END AS income_ttm, CASE WHEN n = 4 AND contiguous THEN ocf END AS ocf_ttm FROM ttm JOIN ba USING (ticker, cp)),
mb AS (SELECT *, last_day(trade_date) AS month FROM (SELECT ticker, trade_date, close, lag(close, 21) OVER w / lag(close, 252) OVER w - 1 AS momentum, row_number() OVER w >= 253 AS price_ready FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)) QUALIFY row_number() OVER (PARTITION BY ticker, last_day(trade_date) ORDER BY trade_date DESC) = 1),
mp AS (SELECT m.ticker, m.month, m.trade_date, m.close, m.momentum, m.price_ready, q.* EXCLUDE (ticker, cp), income_ttm / (m.close * 1000000) AS earnings_yield, ocf_ttm / (m.close * 1000000) AS ocf_yield, sector FROM mb m ASOF LEFT JOIN qs q ON q.ticker = m.ticker AND m.trade_date >= q.cp JOIN securities s ON s.ticker = m.ticker),
el AS (SELECT * FROM mp WHERE price_ready AND net_margin_ttm IS NOT NULL AND ocf_margin_ttm IS NOT NULL AND balance_safety IS NOT NULL AND momentum IS NOT NULL),
""" + f"""rk AS (SELECT *, ({mr('net_margin_ttm')} + {mr('ocf_margin_ttm')} + {mr('balance_safety')}) / 3 AS quality_rank, {mr('momentum')} AS momentum_rank FROM el),
vr AS (SELECT *, 0.5e0 * quality_rank + 0.5e0 * momentum_rank AS combined, ({mr('earnings_yield', 'month, sector')} + {mr('ocf_yield', 'month, sector')}) / 2 AS value_rank FROM rk),
sc AS (SELECT vr.*, variant, wq * quality_rank + wm * momentum_rank + wv * value_rank AS score FROM vr, (VALUES ('balanced', 0.4e0, 0.4e0, 0.2e0), ('quality', 0.6e0, 0.2e0, 0.2e0), ('momentum', 0.2e0, 0.6e0, 0.2e0)) v(variant, wq, wm, wv)),
sel AS (SELECT variant, month, ticker, sector, score, row_number() OVER (PARTITION BY variant, month ORDER BY score DESC, ticker) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY variant, month, sector ORDER BY score DESC, ticker) AS g FROM sc) WHERE g <= 2 QUALIFY pick <= 5)"""
SRC = "facts bars securities"


def panel(spark, d):
    t = FU.trailing_four(pit_panel(spark, d), "revenue", TTM_METRICS)
    q = FU.quality_ratios(t, balance(spark, d)).select("ticker", "cp", *O.QUALITY, F.col("netIncome_ttm").alias("income_ttm"), F.col("operatingCashFlow_ttm").alias("ocf_ttm"))
    m = asof_join(O.month_end_panel(V.bars(spark, d)), q, ["ticker"], "trade_date", "cp", [*O.QUALITY, "income_ttm", "ocf_ttm"])
    m = O.yields(m.withColumn("market_cap", F.col("close") * 1_000_000)).join(V.securities(spark, d).select("ticker", "sector"), "ticker")
    # one row per ticker and month, read several times below: written once instead of recomputed
    return materialize(O.with_eligibility(m, [*O.QUALITY, "momentum"]), "factor-panel")


def ranked(spark, d):
    return O.quality_momentum_ranks(panel(spark, d))


def scored(spark, d):
    v = spark.createDataFrame(VARIANTS, "variant string, w_quality double, w_momentum double, w_value double")  # fixed weight sets
    return O.three_factor_scores(ranked(spark, d), v)


def picks(spark, d):
    return O.select_capped(scored(spark, d), ["variant", "month"])


def base(spark, d):
    return materialize(picks(spark, d).where("variant = 'balanced'").select("month", "ticker", "sector", "weight"), "picks")


@register("fac_03_panel", S.sql(SRC, f"SELECT ticker, month, {r('momentum', 6)} AS momentum, price_ready, {r('net_margin_ttm', 6)} AS net_margin, price_ready AND net_margin_ttm IS NOT NULL AND momentum IS NOT NULL AND balance_safety IS NOT NULL AS eligible FROM mp", PANEL))
def fac_panel(spark, d):
    return panel(spark, d).select("ticker", "month", rnd("momentum", 6).alias("momentum"), "price_ready", rnd("net_margin_ttm", 6).alias("net_margin"), "eligible")


@register("fac_04_value_yields", S.sql(SRC, f"SELECT ticker, month, {r('earnings_yield', 6)} AS earnings_yield, {r('ocf_yield', 6)} AS ocf_yield FROM mp WHERE earnings_yield IS NOT NULL", PANEL))
def value_yields(spark, d):
    return panel(spark, d).where("earnings_yield IS NOT NULL").select("ticker", "month", rnd("earnings_yield", 6).alias("earnings_yield"), rnd("ocf_yield", 6).alias("ocf_yield"))


@register("fac_05_ranks", S.sql(SRC, f"SELECT ticker, month, {r('quality_rank', 6)} AS quality_rank, {r('momentum_rank', 6)} AS momentum_rank, {r('combined', 6)} AS combined FROM vr", PANEL))
def fac_ranks(spark, d):
    return ranked(spark, d).select("ticker", "month", *[rnd(c, 6).alias(c) for c in ("quality_rank", "momentum_rank", "combined")])


@register("fac_06_scores", S.sql(SRC, f"SELECT variant, ticker, month, {r('value_rank', 6)} AS value_rank, {r('score', 6)} AS score FROM sc", PANEL))
def fac_scores(spark, d):
    return scored(spark, d).select("variant", "ticker", "month", rnd("value_rank", 6).alias("value_rank"), rnd("score", 6).alias("score"))


@register("fac_07_capped_selection", S.sql(SRC, "SELECT variant, month, ticker, sector, pick FROM sel", PANEL))
def selection(spark, d):
    return picks(spark, d).select("variant", "month", "ticker", "sector", "pick")


@register("fac_08_reasons", S.sql(SRC, """SELECT variant, month, ticker, CASE WHEN picked THEN 'SELECTED' WHEN coalesce(above, 0) >= 2 THEN 'GROUP_CAP' ELSE 'OUTRANKED' END AS reason FROM (SELECT *, sum(CASE WHEN picked THEN 1 ELSE 0 END) OVER (PARTITION BY variant, month, sector ORDER BY score DESC, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above
  FROM (SELECT sc.*, sel.ticker IS NOT NULL AS picked FROM sc LEFT JOIN sel USING (variant, month, ticker)))""", PANEL))
def reasons(spark, d):
    s = scored(spark, d)
    return O.selection_reasons(s, O.select_capped(s, ["variant", "month"]), ["variant", "month"]).select("variant", "month", "ticker", "reason")


@register("fac_09_selection_checks", S.sql(SRC, "SELECT variant, month, sum(n) AS picks, max(n) AS largest_group, sum(n) = 5 AND max(n) <= 2 AS valid FROM (SELECT variant, month, sector, count(*) AS n FROM sel GROUP BY 1, 2, 3) GROUP BY 1, 2", PANEL))
def checks(spark, d):
    return O.selection_checks(picks(spark, d), V.securities(spark, d), ["variant", "month"]).select("variant", "month", "picks", "largest_group", "valid")


REB = PANEL + """,
bs AS (SELECT month, ticker, sector, 0.2e0 AS w FROM sel WHERE variant = 'balanced'),
mo AS (SELECT month, lead(month) OVER (ORDER BY month) AS nxt FROM (SELECT DISTINCT month FROM bs)),
ln AS (SELECT coalesce(a.month, b.month) AS month, coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.w, 0) AS target_weight, coalesce(b.w, 0) AS previous_weight FROM bs a FULL OUTER JOIN (SELECT nxt AS month, ticker, w FROM bs JOIN mo USING (month) WHERE nxt IS NOT NULL) b ON a.month = b.month AND a.ticker = b.ticker)"""


@register("fac_10_rebalance_lines", S.sql(SRC, f"SELECT month, ticker, CASE WHEN previous_weight = 0 THEN 'BUY' WHEN target_weight = 0 THEN 'SELL' ELSE 'HOLD' END AS action, {r('(target_weight - previous_weight) * 1000000', 2)} AS delta_value FROM ln", REB))
def rebalance(spark, d):
    return O.rebalance_lines(base(spark, d), "month", 1_000_000.0).select("month", "ticker", "action", rnd("delta_value", 2).alias("delta_value"))


ACC = REB + """,
nd AS (SELECT month, count(*) AS need FROM bs GROUP BY 1),
ex AS (SELECT nd.month, min(trade_date) FILTER (WHERE have = need) AS execution_date FROM nd LEFT JOIN (SELECT bs.month, b.trade_date, count(*) AS have FROM bs JOIN bars b ON b.ticker = bs.ticker AND b.trade_date > bs.month AND b.trade_date <= bs.month + 31 GROUP BY 1, 2) x USING (month) GROUP BY 1),
pe AS (SELECT month, execution_date AS ed, lead(execution_date) OVER (ORDER BY month) AS ne FROM ex WHERE execution_date IS NOT NULL),
gr AS (SELECT pe.month, b.trade_date, sum(0.2e0 * b.close / s.close) + 1 - 0.2e0 * count(*) AS g FROM pe JOIN bs USING (month) JOIN bars b ON b.ticker = bs.ticker AND b.trade_date >= ed AND (ne IS NULL OR b.trade_date <= ne) JOIN bars s ON s.ticker = bs.ticker AND s.trade_date = ed JOIN nd USING (month) GROUP BY pe.month, b.trade_date HAVING count(*) = max(need)),
eb AS (SELECT month, coalesce(exp(sum(ln(eg)) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS base FROM (SELECT month, arg_max(g, trade_date) AS eg FROM gr GROUP BY 1)),
ac AS (SELECT month, trade_date, base * g AS equity FROM gr JOIN eb USING (month))"""


@register("fac_11_execution", S.sql(SRC, "SELECT month, execution_date, CASE WHEN execution_date IS NULL THEN 'PENDING' ELSE 'EXECUTED' END AS status FROM ex", ACC))
def execution(spark, d):
    return O.execution_days(base(spark, d), V.bars(spark, d), "month")


@register("fac_12_account_curve", S.sql(SRC, f"SELECT month, trade_date, {r('ln(equity)', 6)} AS log_equity FROM ac", ACC))
def account(spark, d):
    return O.account_curve(base(spark, d), V.bars(spark, d), "month").select("month", "trade_date", rnd(F.log("equity"), 6).alias("log_equity"))


@register("fac_13_hold_benchmark", S.sql("bars", f"SELECT month, {r('v', 6)} AS value, {r('v / lag(v) OVER (ORDER BY month) - 1', 6)} AS monthly_return FROM (SELECT month, avg(c / p0) AS v FROM (SELECT ticker, last_day(trade_date) AS month, arg_max(close, trade_date) AS c FROM bars GROUP BY 1, 2) JOIN (SELECT ticker, arg_min(close, trade_date) AS p0 FROM bars GROUP BY 1) USING (ticker) GROUP BY 1)"))
def benchmark(spark, d):
    return O.hold_benchmark(V.bars(spark, d)).select("month", rnd("value", 6).alias("value"), rnd("monthly_return", 6).alias("monthly_return"))


@register("fac_14_phase_performance", S.sql(SRC, f"SELECT phase, {r('ln(arg_max(equity, trade_date) / arg_min(equity, trade_date))', 5)} AS log_growth, {r('min(dd)', 6)} AS max_drawdown, count(*) AS days FROM (SELECT *, equity / max(equity) OVER (PARTITION BY phase ORDER BY trade_date) - 1 AS dd FROM (SELECT trade_date, max(equity) AS equity, CASE WHEN trade_date < DATE '2000-01-01' THEN 'HISTORICAL' ELSE 'FORWARD' END AS phase FROM ac GROUP BY trade_date)) GROUP BY 1", ACC))
def phases(spark, d):
    c = O.account_curve(base(spark, d), V.bars(spark, d), "month").groupBy("trade_date").agg(F.max("equity").alias("equity"))
    return O.phase_performance(c, F.lit("2000-01-01").cast("date")).select("phase", rnd(F.log("growth"), 5).alias("log_growth"), rnd("max_drawdown", 6).alias("max_drawdown"), "days")


@register("fac_15_variant_overlap", S.sql(SRC, f"SELECT a.month, {r('count(b.ticker) / 5e0', 4)} AS overlap FROM sel a LEFT JOIN sel b ON b.variant = 'momentum' AND b.month = a.month AND b.ticker = a.ticker WHERE a.variant = 'quality' GROUP BY 1", PANEL))
def overlap(spark, d):
    p = picks(spark, d)
    return O.holdings_overlap(p.where("variant = 'quality'"), p.where("variant = 'momentum'"), ["month"], "ticker", 5).select("month", rnd("overlap", 4).alias("overlap"))


@register("fac_16_leave_one_out", S.sql(SRC, "SELECT excluded, month, ticker, row_number() OVER (PARTITION BY excluded, month ORDER BY score DESC, ticker) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY excluded, month, sector ORDER BY score DESC, ticker) AS g FROM sc JOIN (SELECT ticker AS excluded FROM securities) ON ticker <> excluded WHERE variant = 'balanced') WHERE g <= 2 QUALIFY pick <= 5", PANEL))
def loo(spark, d):
    return O.leave_one_out(scored(spark, d).where("variant = 'balanced'"), ["month"], 5, 2, universe=V.securities(spark, d))


@register("fac_17_breadth_exposure", S.sql("bars", f"""SELECT trade_date, {r('breadth', 6)} AS breadth, CAST(CASE WHEN coalesce(NOT mu, false) THEN 0.5 ELSE 1 END AS DOUBLE) AS market_rule, CAST(CASE WHEN coalesce(NOT au, false) THEN 0 ELSE 1 END AS DOUBLE) AS all_down_rule, CAST(CASE WHEN breadth < 0.25 THEN 0.25 WHEN breadth < 0.5 THEN 0.5 ELSE 1 END AS DOUBLE) AS breadth_rule,
  CAST(CASE WHEN coalesce(NOT mu, false) AND breadth < 0.5 THEN 0.25 WHEN coalesce(NOT mu, false) OR breadth < 0.5 THEN 0.5 ELSE 1 END AS DOUBLE) AS combined_rule FROM (SELECT trade_date, avg(CASE WHEN up THEN 1e0 WHEN NOT up THEN 0e0 END) AS breadth, bool_or(up) FILTER (WHERE ticker = 'T00') AS mu, bool_or(up) AS au
  FROM (SELECT *, CASE WHEN count(*) OVER f = 200 THEN close > avg(close) OVER f END AS up FROM bars WINDOW f AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)) GROUP BY 1)"""))
def breadth(spark, d):
    return O.breadth_exposure(V.bars(spark, d), "T00").select("trade_date", rnd("breadth", 6).alias("breadth"), "market_rule", "all_down_rule", "breadth_rule", "combined_rule")


@register("fac_18_weight_maxima", S.sql(SRC, f"SELECT month, {r('max(n) * 0.2e0', 4)} AS largest_group_weight, 0.2e0 AS largest_name_weight FROM (SELECT month, sector, count(*) AS n FROM bs GROUP BY 1, 2) GROUP BY 1", REB))
def maxima(spark, d):
    return O.group_weight_maxima(base(spark, d), "month").select("month", rnd("largest_group_weight", 4).alias("largest_group_weight"), "largest_name_weight")


@register("fac_19_turnover", S.sql(SRC, f"SELECT month, {r('sum(abs(target_weight - previous_weight))', 6)} AS gross_turnover, {r('sum(abs(target_weight - previous_weight)) * 10 / 10000', 8)} AS cost_drag FROM ln GROUP BY 1", REB))
def turnover(spark, d):
    t = O.rebalance_turnover(O.rebalance_lines(base(spark, d), "month", 1.0), "month", 10.0)
    return t.select("month", rnd("gross_turnover", 6).alias("gross_turnover"), rnd("cost_drag", 8).alias("cost_drag"))


@register("fac_20_one_date_ranking", S.sql(SRC, f"SELECT ticker, {r('combined', 6)} AS combined, row_number() OVER (ORDER BY combined DESC, ticker) AS rank FROM vr WHERE month = DATE '2000-06-30'", PANEL))
def one_date(spark, d):
    from pyspark.sql import Window
    x = O.quality_momentum_ranks(panel(spark, d).where("month = DATE '2000-06-30'"))
    return x.select("ticker", rnd("combined", 6).alias("combined"), F.row_number().over(Window.partitionBy("month").orderBy(F.col("combined").desc(), "ticker")).alias("rank"))


@register("fac_21_saved_preferred", S.sql(SRC, "SELECT month, ticker, 'SAVED' AS origin FROM sel WHERE variant = 'quality' AND year(month) = 1999 UNION ALL SELECT month, ticker, 'COMPUTED' FROM sel WHERE variant = 'balanced' AND month NOT IN (SELECT month FROM sel WHERE variant = 'quality' AND year(month) = 1999)", PANEL))
def saved(spark, d):
    p = picks(spark, d)
    s = p.where("variant = 'quality' AND year(month) = 1999").select("month", "ticker")
    return O.prefer_saved(p.where("variant = 'balanced'").select("month", "ticker"), s, ["month"]).select("month", "ticker", "origin")


@register("fac_01_adjusted_bars", S.sql("bars", f"SELECT ticker, trade_date, {r('open * k', 6)} AS open, {r('high * k', 6)} AS high, {r('close * k', 6)} AS close FROM (SELECT *, CASE WHEN year(trade_date) < 1998 THEN 0.5e0 ELSE 1e0 END AS k FROM bars)"))
def adjusted(spark, d):
    from marketloom.operators.flow import adjusted_bars
    b = V.bars(spark, d).withColumn("adjusted_close", F.col("close") * F.when(F.year("trade_date") < 1998, 0.5).otherwise(1.0))
    return adjusted_bars(b).select("ticker", "trade_date", *[rnd(c, 6).alias(c) for c in ("open", "high", "close")])


@register("fac_02_nominal_close", S.sql("bars", f"""SELECT ticker, trade_date, {r("close * CASE WHEN trade_date < DATE '1998-03-02' THEN 6 WHEN trade_date < DATE '2000-06-01' THEN 3 ELSE 1 END", 4)} AS nominal_close FROM bars"""))
def nominal(spark, d):
    b = V.bars(spark, d).select("ticker", "trade_date", "close")
    sp = b.select("ticker").distinct().select("ticker", F.explode(F.array(
        F.struct(F.lit("1998-03-02").cast("date").alias("split_date"), F.lit(2.0).alias("ratio"), F.lit(True).alias("genuine")),
        F.struct(F.lit("2000-06-01").cast("date").alias("split_date"), F.lit(3.0).alias("ratio"), F.lit(True).alias("genuine")))).alias("s")).select("ticker", "s.*")
    x = FU.split_factor(b, sp, "ticker", "trade_date", None, False, "k")
    return x.select("ticker", "trade_date", rnd(F.col("close") * F.col("k"), 4).alias("nominal_close"))
