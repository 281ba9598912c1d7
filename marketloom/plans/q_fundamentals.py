"""Point-in-time fundamentals (PIT-*)."""
from pyspark.sql import functions as F

from marketloom.functions.scalar import rnd
from marketloom.operators import fundamentals as O
from marketloom.plans import sqlviews as S
from marketloom.plans.q_portfolio import CAL, calendar
from marketloom.plans.registry import register
from marketloom.sources import views as V

r = S.rnd
FLOWS = ["revenue", "grossProfit", "operatingIncome", "netIncome", "operatingCashFlow", "capitalExpenditure"]

# A version is usable from the first session strictly after its filing date.
VIN = CAL + """,
us AS (SELECT f.*, (SELECT min(s) FROM ses WHERE s > f.filed_at) AS usable_from FROM facts f),
vin AS (SELECT ticker, metric_key, period_start, period_end, usable_from AS valid_from, lead(usable_from) OVER (PARTITION BY ticker, metric_key, period_start, period_end ORDER BY usable_from) AS valid_to, value FROM us WHERE usable_from IS NOT NULL)"""


def usable(spark, d, delay=0):
    return O.first_usable_session(O.with_known_day(V.facts(spark, d)), calendar(spark, d), delay)


def vintages(spark, d):
    return O.vintages(usable(spark, d))


@register("pit_01_usable_session", S.sql("facts", "SELECT f.ticker, f.metric_key, f.period_end, f.filed_at, t.s AS usable_from FROM facts f JOIN cal ON day = filed_at JOIN ses t ON t.no = session_no + 3", CAL))
def usable_session(spark, d):
    return usable(spark, d, 2).select("ticker", "metric_key", "period_end", "filed_at", "usable_from")


@register("pit_02_vintages", S.sql("facts", f"SELECT ticker, metric_key, period_start, period_end, valid_from, valid_to, {r('value', 3)} AS value FROM vin", VIN))
def vint(spark, d):
    return vintages(spark, d).select("ticker", "metric_key", "period_start", "period_end", "valid_from", "valid_to", rnd("value", 3).alias("value"))


_EPSQ = CAL + """,
ef AS (SELECT *, (SELECT min(s) FROM ses WHERE s > filed_at) AS uf FROM eps_facts),
qd AS (SELECT ticker, period_end, period_start, uf AS valid_from, value, false AS derived FROM ef WHERE period_end - period_start + 1 BETWEEN 70 AND 110 AND uf IS NOT NULL),
qc AS (SELECT c.ticker, c.period_end, p.period_end AS pe, c.period_start AS cs, c.uf AS cu, p.uf AS pu, c.value AS cv, p.value AS pv FROM ef c LEFT JOIN ef p ON p.ticker = c.ticker AND p.period_start = c.period_start AND c.period_end - p.period_end BETWEEN 70 AND 110 AND p.uf IS NOT NULL WHERE c.period_end - c.period_start + 1 > 110 AND c.uf IS NOT NULL),
qq AS (SELECT * FROM qd UNION ALL SELECT ticker, period_end, pe + 1, greatest(cu, pu), cv - pv, true FROM qc WHERE pu IS NOT NULL UNION ALL SELECT ticker, period_end, cs, cu, NULL, true FROM qc WHERE pu IS NULL OR pu > cu)"""


@register("pit_03_quarter_values", S.sql("eps_facts", f"SELECT q.ticker, q.period_end, q.period_start, q.valid_from, q.derived, {r('q.value', 4)} AS value FROM qq q LEFT JOIN qd d ON d.ticker = q.ticker AND d.period_end = q.period_end WHERE NOT q.derived OR d.valid_from IS NULL OR q.valid_from < d.valid_from", _EPSQ))
def quarters(spark, d):
    e = V.eps_facts(spark, d).withColumns({"metric_key": F.lit("epsDiluted"), "known": F.col("filed_at")})
    q = O.quarter_values(O.vintages(O.first_usable_session(e, calendar(spark, d))))
    return q.select("ticker", "period_end", "period_start", "valid_from", "derived", rnd("value", 4).alias("value"))


# Direct statement: every change point sees the latest version of every quarter.
PANEL = VIN + """,
cps AS (SELECT DISTINCT ticker, valid_from AS cp FROM vin),
vis AS (SELECT c.ticker, c.cp, v.period_start, v.period_end, v.metric_key, v.value FROM cps c JOIN vin v ON v.ticker = c.ticker AND v.valid_from <= c.cp AND (v.valid_to IS NULL OR v.valid_to > c.cp)),
per AS (SELECT ticker, cp, period_start, period_end, """ + ", ".join(f"max(value) FILTER (WHERE metric_key = '{m}') AS {a}" for m, a in zip(FLOWS, ("rev", "gp", "oi", "ni", "ocf", "capex"))) + """,
  row_number() OVER (PARTITION BY ticker, cp ORDER BY period_end DESC) AS k FROM vis GROUP BY 1, 2, 3, 4),
ttm AS (SELECT ticker, cp, max(period_end) AS fin_period, count(*) AS n, sum(rev) AS rev, sum(ni) AS ni, sum(ocf) AS ocf, sum(CASE WHEN capex >= 0 THEN ocf - capex END) AS fcf,
  bool_and(gap IS NULL OR abs(gap - 1) <= 3) AS contiguous FROM (SELECT *, period_start - lag(period_end) OVER (PARTITION BY ticker, cp ORDER BY period_end) AS gap FROM per WHERE k <= 4) GROUP BY 1, 2)"""


def panel(spark, d):
    return O.change_points(O.quarter_values(vintages(spark, d)), "revenue", FLOWS)


TTM_METRICS = ["revenue", "netIncome", "operatingCashFlow"]


@register("pit_04_trailing_four", S.sql("facts", f"SELECT ticker, cp, fin_period, CASE WHEN n = 4 AND contiguous THEN {r('rev', 2)} END AS revenue_ttm, CASE WHEN n = 4 AND contiguous THEN {r('ni', 2)} END AS income_ttm, CASE WHEN n = 4 AND contiguous THEN {r('ocf', 2)} END AS ocf_ttm FROM ttm", PANEL))
def ttm(spark, d):
    t = O.trailing_four(panel(spark, d), "revenue", TTM_METRICS)
    return t.select("ticker", "cp", "fin_period", rnd("revenue_ttm", 2).alias("revenue_ttm"), rnd("netIncome_ttm", 2).alias("income_ttm"), rnd("operatingCashFlow_ttm", 2).alias("ocf_ttm"))


def balance(spark, d):
    base = V.facts(spark, d).where("metric_key = 'revenue'")
    a = base.withColumns({"metric_key": F.lit("assets"), "value": F.col("value") * 10})
    li = base.withColumns({"metric_key": F.lit("liabilities"), "value": F.col("value") * (4 + F.month("period_end") / 12)})
    both = a.unionByName(li).withColumn("period_start", F.col("period_end"))
    return O.vintages(O.first_usable_session(O.with_known_day(both), calendar(spark, d)))


_QUAL = PANEL + """,
ba AS (SELECT t.ticker, t.cp, v.value * 10 AS assets, v.value * (4 + month(v.period_end) / 12) AS liabilities FROM ttm t JOIN vin v ON v.ticker = t.ticker AND v.metric_key = 'revenue' AND v.period_end = t.fin_period AND v.valid_from <= t.cp AND (v.valid_to IS NULL OR v.valid_to > t.cp))"""
_OK = "n = 4 AND contiguous AND rev > 0"


@register("pit_05_quality_ratios", S.sql("facts", f"SELECT ticker, cp, CASE WHEN {_OK} THEN {r('ni / rev', 6)} END AS net_margin, CASE WHEN {_OK} THEN {r('ocf / rev', 6)} END AS ocf_margin, CASE WHEN {_OK} THEN {r('-liabilities / assets', 6)} END AS balance_safety FROM ttm JOIN ba USING (ticker, cp)", _QUAL))
def quality(spark, d):
    t = O.trailing_four(panel(spark, d), "revenue", TTM_METRICS)
    q = O.quality_ratios(t, balance(spark, d))
    return q.select("ticker", "cp", rnd("net_margin_ttm", 6).alias("net_margin"), rnd("ocf_margin_ttm", 6).alias("ocf_margin"), rnd("balance_safety", 6).alias("balance_safety"))


@register("pit_06_balance_vintages", S.sql("facts", f"SELECT ticker, period_end, valid_from, valid_to, {r('value * 10', 2)} AS assets FROM vin WHERE metric_key = 'revenue'", VIN))
def balance_vintages(spark, d):
    return balance(spark, d).where("metric_key = 'assets'").select("ticker", "period_end", "valid_from", "valid_to", rnd("value", 2).alias("assets"))


_ST = PANEL + """,
h AS (SELECT c.ticker, c.cp, a.period_start AS s0, a.period_end AS e0, a.rev AS r0, a.gp AS g0, a.oi AS o0, a.ni AS n0, a.ocf AS c0, (SELECT p FROM per p WHERE p.ticker = c.ticker AND p.cp = c.cp AND a.period_end - p.period_end BETWEEN 350 AND 380 ORDER BY abs(a.period_end - p.period_end - 365) LIMIT 1) AS y,
  (SELECT p FROM per p WHERE p.ticker = c.ticker AND p.cp = c.cp AND a.period_end - p.period_end BETWEEN 70 AND 110 ORDER BY p.period_end DESC LIMIT 1) AS p FROM cps c JOIN per a ON a.ticker = c.ticker AND a.cp = c.cp AND a.k = 1),
h2 AS (SELECT *, (SELECT x FROM per x WHERE x.ticker = h.ticker AND x.cp = h.cp AND h.p.period_end - x.period_end BETWEEN 350 AND 380 ORDER BY abs(h.p.period_end - x.period_end - 365) LIMIT 1) AS py FROM h),
st AS (SELECT h2.ticker, h2.cp, e0 AS fin_period, r0 / y.rev - 1 AS revenue_yoy, (r0 / y.rev - 1) - (p.rev / py.rev - 1) AS revenue_acceleration, g0 / r0 AS gross_margin, g0 / r0 - y.gp / y.rev AS gross_margin_yoy,
  (g0 / r0 - y.gp / y.rev) - (p.gp / p.rev - py.gp / py.rev) AS gross_margin_acceleration, o0 / r0 AS operating_margin, o0 / r0 - y.oi / y.rev AS operating_margin_yoy, n0 / r0 AS net_margin, c0 / r0 AS ocf_margin, c0 / r0 - y.ocf / y.rev AS ocf_margin_yoy, c0 / abs(n0) AS cash_conversion,
  CASE WHEN n = 4 AND contiguous THEN fcf END AS fcf_ttm FROM h2 JOIN ttm USING (ticker, cp))"""
_G = ["revenue_yoy", "revenue_acceleration", "gross_margin", "gross_margin_yoy", "gross_margin_acceleration", "operating_margin"]


def states(spark, d):
    return O.growth_state(panel(spark, d))


@register("pit_07_growth", S.sql("facts", "SELECT ticker, cp, fin_period, " + ", ".join(f"{r(c, 6)} AS {c}" for c in _G) + f", {r('fcf_ttm', 2)} AS fcf_ttm FROM st", _ST))
def growth(spark, d):
    return states(spark, d).select("ticker", "cp", "fin_period", *[rnd(c, 6).alias(c) for c in _G], rnd("fcf_ttm", 2).alias("fcf_ttm"))


_X = ["operating_margin_yoy", "net_margin", "ocf_margin", "ocf_margin_yoy", "cash_conversion"]


@register("pit_10_extra_margins", S.sql("facts", "SELECT ticker, cp, " + ", ".join(f"{r(c, 6)} AS {c}" for c in _X) + " FROM st", _ST))
def margins(spark, d):
    return states(spark, d).select("ticker", "cp", *[rnd(c, 6).alias(c) for c in _X])


_DAILY = _ST + """,
dp AS (SELECT b.ticker, b.trade_date, st.cp, st.fin_period, CASE WHEN st.fin_period IS NULL THEN 'UNKNOWN' WHEN b.trade_date - st.fin_period > 180 THEN 'STALE' WHEN revenue_yoy IS NULL OR gross_margin_yoy IS NULL OR fcf_ttm IS NULL THEN 'UNKNOWN'
  WHEN revenue_yoy > 0 AND gross_margin_yoy >= 0 AND fcf_ttm > 0 THEN 'EXPANSION' WHEN revenue_yoy < 0 AND gross_margin_yoy < 0 THEN 'DETERIORATION' ELSE 'NEUTRAL' END AS fin_state FROM bars b ASOF LEFT JOIN st ON st.ticker = b.ticker AND b.trade_date >= st.cp)"""


def daily(spark, d):
    s = V.bars(spark, d).select("ticker", "trade_date")
    p = O.daily_panel(s, states(spark, d), "trade_date", ["fin_period", "revenue_yoy", "gross_margin_yoy", "fcf_ttm"])
    return p.withColumn("fin_state", O.financial_state("trade_date", p))


@register("pit_09_daily_panel", S.sql("facts bars", "SELECT ticker, trade_date, fin_period, fin_state FROM dp", _DAILY))
def daily_panel(spark, d):
    return daily(spark, d).select("ticker", "trade_date", "fin_period", "fin_state")


@register("pit_08_state_days", S.sql("facts bars", "SELECT ticker, fin_state, count(*) AS days FROM dp GROUP BY 1, 2", _DAILY))
def state_days(spark, d):
    return daily(spark, d).groupBy("ticker", "fin_state").agg(F.count("*").alias("days"))


ANNUAL = """an AS (SELECT ticker, metric_key, CAST(date_trunc('year', period_end) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS period_end, CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS value FROM
  (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY ticker, metric_key, period_end ORDER BY filed_at DESC) = 1) GROUP BY 1, 2, 3 HAVING count(*) = 4)"""


def annual(spark, d):
    f = O.annual_series(V.facts(spark, d))
    g = f.groupBy("ticker", "metric_key", F.make_date(F.year("period_end"), F.lit(12), F.lit(31)).alias("period_end")).agg(
        F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("value"), F.count("*").alias("n"))
    return g.where("n = 4").drop("n")


@register("pit_11_annual_series", S.sql("facts", f"SELECT ticker, metric_key, period_end, {r('value', 2)} AS value FROM an", ANNUAL))
def annual_series(spark, d):
    return annual(spark, d).select("ticker", "metric_key", "period_end", rnd("value", 2).alias("value"))


@register("pit_12_derived_liabilities", S.sql("quarter_totals", f"SELECT ticker, period_end, {r('value * 6', 2)} AS liabilities FROM quarter_totals WHERE n % 3 <> 0"))
def derived_liabilities(spark, d):
    q = V.quarter_totals(spark, d).select("ticker", "period_end", F.col("period_end").alias("filed_at"), F.concat("ticker", F.col("period_end").cast("string")).alias("accession_number"), "value", "n")
    kinds = F.array(F.struct(F.lit("assets").alias("metric_key"), (F.col("value") * 10).alias("v")), F.struct(F.lit("equity").alias("metric_key"), (F.col("value") * 4).alias("v")),
                    F.when(F.col("n") % 3 == 0, F.struct(F.lit("liabilities").alias("metric_key"), (F.col("value") * 6).alias("v"))))
    f = q.select("ticker", "period_end", "filed_at", "accession_number", F.explode(F.array_compact(kinds)).alias("m")).select("*", "m.metric_key", F.col("m.v").alias("value"))
    return O.derived_liabilities(f).select("ticker", "period_end", rnd("liabilities", 2).alias("liabilities"))


_SH = """sr AS (SELECT ticker, period_end AS e, period_end + 40 AS known, 0 AS priority, CAST(n AS DOUBLE) * 1000 AS value FROM quarter_totals UNION ALL SELECT ticker, period_end, period_end + 90, 0, CAST(n AS DOUBLE) * 1000 + 7 FROM quarter_totals WHERE n % 2 = 0),
sp AS (SELECT DISTINCT ticker, make_date(1998, 3, 2) AS d, 2e0 AS ratio FROM quarter_totals UNION ALL SELECT DISTINCT ticker, make_date(2000, 6, 1), 3e0 FROM quarter_totals),
pick AS (SELECT b.ticker, b.trade_date, b.close, (SELECT arg_max(struct_pack(e := s.e, v := s.value), (s.e, -s.priority, s.known)) FROM sr s WHERE s.ticker = b.ticker AND s.known < b.trade_date) AS x FROM bars b),
sh AS (SELECT ticker, trade_date, close, CASE WHEN trade_date - x.e <= 550 THEN x.v * coalesce((SELECT product(ratio) FROM sp WHERE sp.ticker = pick.ticker AND sp.d > x.e AND sp.d <= pick.trade_date), 1) END AS shares, x.e AS share_end FROM pick)"""


def shares(spark, d):
    q = V.quarter_totals(spark, d)
    v = F.col("n").cast("double") * 1000
    base = q.select("ticker", F.col("period_end").alias("end"), F.date_add("period_end", 40).alias("known"), F.lit(0).alias("priority"), v.alias("value"))
    rev = q.where("n % 2 = 0").select("ticker", F.col("period_end").alias("end"), F.date_add("period_end", 90).alias("known"), F.lit(0).alias("priority"), (v + 7).alias("value"))
    splits = q.select("ticker").distinct().select("ticker", F.explode(F.array(
        F.struct(F.lit("1998-03-02").cast("date").alias("split_date"), F.lit(2.0).alias("ratio"), F.lit(True).alias("genuine")),
        F.struct(F.lit("2000-06-01").cast("date").alias("split_date"), F.lit(3.0).alias("ratio"), F.lit(True).alias("genuine")))).alias("s")).select("ticker", "s.*")
    return O.visible_shares(V.bars(spark, d).select("ticker", "trade_date", "close"), base.unionByName(rev), splits), splits


@register("pit_13_visible_shares", S.sql("quarter_totals bars", f"SELECT ticker, trade_date, share_end, {r('shares', 2)} AS shares FROM sh", _SH))
def visible_shares(spark, d):
    return shares(spark, d)[0].select("ticker", "trade_date", "share_end", rnd("shares", 2).alias("shares"))


@register("pit_14_market_cap", S.sql("quarter_totals bars", f"SELECT ticker, trade_date, {r("CASE WHEN ticker IN ('T01', 'T02') THEN close * shares / 5 * 30 ELSE close * shares END", 0)} AS market_cap FROM sh", _SH))
def market_cap(spark, d):
    s = shares(spark, d)[0]
    adr = F.col("ticker").isin("T01", "T02")
    cap = O.local_market_cap(F.col("close"), F.col("shares"), F.when(adr, 5).otherwise(1), F.when(adr, "TWD").otherwise("USD"), F.lit(30.0))
    return s.select("ticker", "trade_date", rnd(cap, 0).alias("market_cap"))


@register("pit_15_period_table", S.sql("facts", f"""SELECT * FROM (SELECT ticker, period_end, {r("max(value) FILTER (WHERE metric_key = 'revenue')", 2)} AS revenue, {r("max(value) FILTER (WHERE metric_key = 'netIncome')", 2)} AS net_income, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC) AS recency
  FROM (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY ticker, metric_key, period_end ORDER BY filed_at DESC) = 1) GROUP BY 1, 2) WHERE recency <= 8"""))
def period_table(spark, d):
    p = O.period_table(V.facts(spark, d).withColumn("period_type", F.lit("quarter")), ["revenue", "netIncome"])
    return p.select("ticker", "period_end", rnd("revenue", 2).alias("revenue"), rnd("netIncome", 2).alias("net_income"), "recency")


_PA = """l AS (SELECT ticker, period_end, max(value) FILTER (WHERE metric_key = 'revenue') AS rev, max(value) FILTER (WHERE metric_key = 'grossProfit') AS gp, max(value) FILTER (WHERE metric_key = 'operatingCashFlow') AS ocf, max(value) FILTER (WHERE metric_key = 'capitalExpenditure') AS cx, max(value) FILTER (WHERE metric_key = 'netIncome') AS ni
  FROM (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY ticker, metric_key, period_end ORDER BY filed_at DESC) = 1) GROUP BY 1, 2)"""


@register("pit_16_period_analysis", S.sql("facts", f"""SELECT l.ticker, l.period_end, {r('l.rev / q.rev - 1', 6)} AS revenue_qoq, {r('l.rev / y.rev - 1', 6)} AS revenue_yoy, {r('l.gp / l.rev', 6)} AS gross_margin, {r('l.ocf - l.cx', 2)} AS free_cash_flow, {r('l.ocf / l.ni', 6)} AS cash_conversion
  FROM l LEFT JOIN l q ON q.ticker = l.ticker AND l.period_end - q.period_end BETWEEN 70 AND 120 LEFT JOIN (SELECT a.ticker, a.period_end, arg_min(b.rev, abs(a.period_end - b.period_end - 365)) AS rev FROM l a JOIN l b ON a.ticker = b.ticker AND a.period_end - b.period_end BETWEEN 250 AND 470 GROUP BY 1, 2) y ON y.ticker = l.ticker AND y.period_end = l.period_end""", _PA))
def period_analysis(spark, d):
    f = O.annual_series(V.facts(spark, d))
    p = O.period_analysis(f.groupBy("ticker", "period_end").pivot("metric_key", FLOWS).agg(F.max("value")))
    return p.select("ticker", "period_end", *[rnd(c, 6).alias(c) for c in ("revenue_qoq", "revenue_yoy", "gross_margin")], rnd("free_cash_flow", 2).alias("free_cash_flow"), rnd("cash_conversion", 6).alias("cash_conversion"))


@register("pit_17_comparable_series", S.sql("facts", f"SELECT ticker, period_end, lag(period_end) OVER w AS previous_end, {r('(cx - lag(cx) OVER w) / abs(lag(cx) OVER w)', 6)} AS change_pct FROM l WINDOW w AS (PARTITION BY ticker ORDER BY period_end)", _PA))
def comparable(spark, d):
    c = O.comparable_series(V.facts(spark, d).where("metric_key = 'capitalExpenditure'").withColumn("period_type", F.lit("quarter")))
    return c.select("ticker", "period_end", "previous_end", rnd("change_pct", 6).alias("change_pct"))


@register("flt_07_fact_validation", S.sql("facts", "SELECT coalesce(reason, 'ACCEPTED') AS reason, count(*) AS n FROM (SELECT CASE WHEN metric_key NOT IN ('revenue', 'netIncome') THEN 'UNSUPPORTED_METRIC_OR_UNIT' WHEN month(period_end) = 6 THEN 'UNSUPPORTED_FORM' WHEN month(period_end) = 9 THEN 'INVALID_PERIOD' END AS reason FROM facts) GROUP BY 1"))
def validation(spark, d):
    f = V.facts(spark, d).withColumns({"unit": F.lit("USD"), "form": F.when(F.month("period_end") == 6, "8-K").otherwise("10-Q"),
                                       "filed_at": F.when(F.month("period_end") == 9, F.date_sub("period_end", 1)).otherwise(F.col("filed_at"))})
    return f.groupBy(F.coalesce(O.reject_reason(("revenue", "netIncome")), F.lit("ACCEPTED")).alias("reason")).agg(F.count("*").alias("n"))
