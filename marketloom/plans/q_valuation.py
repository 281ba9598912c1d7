"""Valuation and estimates (VAL-*, EST-*)."""
from pyspark.sql import functions as F

from marketloom.functions.scalar import rnd
from marketloom.operators import valuation as O
from marketloom.operators.series import latest_per_key
from marketloom.plans import sqlviews as S
from marketloom.plans.q_fundamentals import ANNUAL, annual
from marketloom.plans.registry import register
from marketloom.sources import views as V

r = S.rnd

TTM = """cp AS (SELECT DISTINCT ticker, filed_at AS cp FROM eps_facts),
se AS (SELECT c.ticker, c.cp, e.period_type, e.period_end, e.fiscal_period, e.value FROM cp c JOIN eps_facts e ON e.ticker = c.ticker AND e.filed_at <= c.cp),
aa AS (SELECT ticker, cp, max(period_end) AS ae, arg_max(value, period_end) AS av FROM se WHERE period_type = 'annual' GROUP BY 1, 2),
ii AS (SELECT * FROM se WHERE period_type = 'ytd' OR (period_type = 'quarter' AND fiscal_period = 'Q1')),
ci AS (SELECT i.ticker, i.cp, max(i.period_end) AS ce, arg_max(i.value, i.period_end) AS cv, arg_max(i.fiscal_period, i.period_end) AS cf FROM ii i LEFT JOIN aa USING (ticker, cp) WHERE ae IS NULL OR i.period_end > ae GROUP BY 1, 2),
pi AS (SELECT i.ticker, i.cp, arg_max(i.value, i.period_end) AS pv FROM ii i JOIN ci ON ci.ticker = i.ticker AND ci.cp = i.cp AND i.fiscal_period = cf AND ce - i.period_end BETWEEN 300 AND 430 GROUP BY 1, 2),
fq AS (SELECT ticker, cp, sum(value) AS qv, count(*) AS n, bool_and(gap IS NULL OR gap BETWEEN 60 AND 130) AS cont FROM (SELECT *, period_end - lag(period_end) OVER (PARTITION BY ticker, cp ORDER BY period_end) AS gap FROM (SELECT * FROM se WHERE period_type = 'quarter' QUALIFY row_number() OVER (PARTITION BY ticker, cp ORDER BY period_end DESC) <= 4)) GROUP BY 1, 2),
ttm AS (SELECT cp.ticker, cp.cp, CASE WHEN av IS NOT NULL AND cv IS NULL THEN av WHEN av IS NOT NULL AND pv IS NOT NULL THEN av + cv - pv WHEN av IS NULL AND n = 4 AND cont THEN qv END AS ttm_eps,
  CASE WHEN av IS NOT NULL AND cv IS NULL THEN 'LATEST_FY' WHEN av IS NOT NULL AND pv IS NOT NULL THEN 'FY_PLUS_YTD_DELTA' WHEN av IS NULL AND n = 4 AND cont THEN 'FOUR_QUARTERS' END AS ttm_method
  FROM cp LEFT JOIN aa USING (ticker, cp) LEFT JOIN ci USING (ticker, cp) LEFT JOIN pi USING (ticker, cp) LEFT JOIN fq USING (ticker, cp))"""


def ttm(spark, d, quarters=None):
    return O.ttm_eps(V.eps_facts(spark, d, quarters))


@register("val_01_ttm_eps", S.sql("eps_facts", f"SELECT ticker, cp, {r('ttm_eps', 4)} AS ttm_eps, ttm_method FROM ttm", TTM))
def ttm_eps(spark, d):
    return ttm(spark, d).select("ticker", "cp", rnd("ttm_eps", 4).alias("ttm_eps"), "ttm_method")


PE = TTM + f""",
pes AS (SELECT b.ticker, b.trade_date, b.close, t.ttm_eps, t.ttm_method, {r('b.close / t.ttm_eps', 6)} AS pe FROM bars b ASOF JOIN ttm t ON t.ticker = b.ticker AND b.trade_date > t.cp WHERE t.ttm_eps > 0)"""


@register("val_03_static_pe_series", S.sql("eps_facts bars", f"SELECT ticker, trade_date, {r('pe', 4)} AS pe, ttm_method FROM pes", PE))
def static_pe(spark, d):
    return O.static_pe_series(V.bars(spark, d), ttm(spark, d)).select("ticker", "trade_date", rnd("pe", 4).alias("pe"), "ttm_method")


# Estimates with irregular coverage, so all four NTM methods occur: every third snapshot lacks its second quarter.
EST_ROWS = """er AS (SELECT * EXCLUDE (k, m), m FROM (SELECT *, row_number() OVER (PARTITION BY ticker, as_of ORDER BY period_end) AS k, month(as_of) AS m FROM estimates) WHERE NOT (m % 3 = 0 AND k = 2)
  UNION ALL SELECT ticker, as_of, 'fiscal year', make_date(year(as_of) + CAST(j AS INT), 12, 31), e * 4 + j, e * 4 + j + 1, e * 4 + j - 1, c, NULL, NULL, 0, 0, month(as_of) FROM (SELECT ticker, as_of, min(eps_average) AS e, min(analyst_count) AS c FROM estimates GROUP BY 1, 2), (SELECT unnest(range(0, 2)) AS j)
  WHERE NOT (j = 1 AND month(as_of) IN (6, 9)) AND NOT (month(as_of) = 6 AND j = 1)),
fu AS (SELECT * FROM er WHERE period_end > as_of),
qt AS (SELECT ticker, as_of, sum(eps_average) AS v, sum(eps_high) AS hi, min(analyst_count) AS n, count(*) AS c, bool_and(gap IS NULL OR gap BETWEEN 60 AND 130) AS cont FROM (SELECT *, period_end - lag(period_end) OVER (PARTITION BY ticker, as_of ORDER BY period_end) AS gap FROM (SELECT * FROM fu WHERE horizon = 'fiscal quarter' QUALIFY row_number() OVER (PARTITION BY ticker, as_of ORDER BY period_end) <= 4)) GROUP BY 1, 2),
ye AS (SELECT ticker, as_of, max(period_end) FILTER (WHERE k = 1) AS e0, max(period_end) FILTER (WHERE k = 2) AS e1, max(eps_average) FILTER (WHERE k = 1) AS v0, max(eps_average) FILTER (WHERE k = 2) AS v1, max(eps_high) FILTER (WHERE k = 1) AS h0, max(eps_high) FILTER (WHERE k = 2) AS h1,
  max(analyst_count) FILTER (WHERE k = 1) AS n0, max(analyst_count) FILTER (WHERE k = 2) AS n1 FROM (SELECT *, row_number() OVER (PARTITION BY ticker, as_of ORDER BY period_end) AS k FROM fu WHERE horizon = 'fiscal year') GROUP BY 1, 2),
nm AS (SELECT b.ticker, b.as_of, CASE WHEN c = 4 AND cont THEN 'FOUR_QUARTER_CONSENSUS' WHEN e1 - e0 BETWEEN 300 AND 430 AND e0 - b.as_of BETWEEN 0 AND 430 THEN 'FISCAL_YEAR_BLEND' WHEN e0 - b.as_of BETWEEN 330 AND 400 THEN 'NEXT_FISCAL_YEAR_PROXY' ELSE 'INSUFFICIENT' END AS method, qt.*, ye.*, least(1e0, greatest(0e0, (e0 - b.as_of) / (e1 - e0))) AS w0
  FROM (SELECT DISTINCT ticker, as_of FROM fu) b LEFT JOIN qt ON qt.ticker = b.ticker AND qt.as_of = b.as_of LEFT JOIN ye ON ye.ticker = b.ticker AND ye.as_of = b.as_of),
ntm AS (SELECT ticker, as_of, method, CASE method WHEN 'FOUR_QUARTER_CONSENSUS' THEN v WHEN 'FISCAL_YEAR_BLEND' THEN v0 * w0 + v1 * (1 - w0) WHEN 'NEXT_FISCAL_YEAR_PROXY' THEN v0 END AS eps_value, CASE method WHEN 'FOUR_QUARTER_CONSENSUS' THEN hi WHEN 'FISCAL_YEAR_BLEND' THEN h0 * w0 + h1 * (1 - w0) WHEN 'NEXT_FISCAL_YEAR_PROXY' THEN h0 END AS eps_high,
  CASE method WHEN 'FOUR_QUARTER_CONSENSUS' THEN n WHEN 'FISCAL_YEAR_BLEND' THEN least(n0, n1) WHEN 'NEXT_FISCAL_YEAR_PROXY' THEN n0 END AS analyst_count FROM nm),
nt AS (SELECT *, CASE WHEN method = 'INSUFFICIENT' THEN 'error' WHEN method = 'NEXT_FISCAL_YEAR_PROXY' THEN 'proxy' WHEN analyst_count < 3 THEN 'limited_coverage' ELSE 'complete' END AS quality_status FROM ntm)"""


def estimate_rows(spark, d, estimates=None):
    from pyspark.sql import Window
    e = estimates if estimates is not None else V.estimates(spark, d)
    w = Window.partitionBy("ticker", "as_of").orderBy("period_end")
    q = e.withColumn("k", F.row_number().over(w)).where(~((F.month("as_of") % 3 == 0) & (F.col("k") == 2))).drop("k")
    y = e.groupBy("ticker", "as_of").agg(F.min("eps_average").alias("e"), F.min("analyst_count").alias("c")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(1))))
    y = y.where(~((F.col("j") == 1) & F.month("as_of").isin(6, 9))).select(
        "ticker", "as_of", F.lit("fiscal year").alias("horizon"), F.make_date(F.year("as_of") + F.col("j"), F.lit(12), F.lit(31)).alias("period_end"),
        (F.col("e") * 4 + F.col("j")).alias("eps_average"), (F.col("e") * 4 + F.col("j") + 1).alias("eps_high"), (F.col("e") * 4 + F.col("j") - 1).alias("eps_low"),
        F.col("c").alias("analyst_count"), F.lit(None).cast("double").alias("eps_7d"), F.lit(None).cast("double").alias("eps_30d"), F.lit(0).alias("up_30d"), F.lit(0).alias("down_30d"))
    return q.unionByName(y)


def ntm(spark, d, estimates=None):
    return O.ntm_consensus(estimate_rows(spark, d, estimates))


@register("est_01_ntm_consensus", S.sql("estimates", f"SELECT ticker, as_of, method, {r('eps_value', 4)} AS eps_value, {r('eps_high', 4)} AS eps_high FROM nt", EST_ROWS))
def ntm_consensus(spark, d):
    return ntm(spark, d).select("ticker", "as_of", "method", rnd("eps_value", 4).alias("eps_value"), rnd("eps_high", 4).alias("eps_high"))


@register("est_02_coverage_quality", S.sql("estimates", "SELECT ticker, quality_status, count(*) AS snapshots, min(analyst_count) AS fewest FROM nt GROUP BY 1, 2", EST_ROWS))
def coverage(spark, d):
    return ntm(spark, d).groupBy("ticker", "quality_status").agg(F.count("*").alias("snapshots"), F.min("analyst_count").alias("fewest"))


REV = """rv AS (SELECT ticker, as_of, sum(eps_average) AS v, sum(eps_7d) AS p7, sum(eps_30d) AS p30, sum(up_30d) AS up, sum(down_30d) AS dn FROM (SELECT * FROM estimates WHERE period_end > as_of QUALIFY row_number() OVER (PARTITION BY ticker, as_of ORDER BY period_end) <= 4) GROUP BY 1, 2)"""


@register("est_03_revisions", S.sql("estimates", f"SELECT ticker, as_of, {r('(v - p7) / abs(p7)', 6)} AS revision_7d, {r('(v - p30) / abs(p30)', 6)} AS revision_30d, CASE WHEN up + dn <> 0 THEN {r('(up - dn) / (up + dn)', 6)} END AS breadth_30d FROM rv", REV))
def revisions(spark, d):
    return O.revisions(V.estimates(spark, d)).select("ticker", "as_of", "revision_7d", "revision_30d", "breadth_30d")


@register("est_04_history", S.sql("estimates", f"SELECT ticker, as_of, recency, periods, {r('first_eps', 4)} AS first_eps FROM (SELECT ticker, as_of, count(*) AS periods, arg_min(eps_average, period_end) AS first_eps, row_number() OVER (PARTITION BY ticker ORDER BY as_of DESC) AS recency FROM estimates GROUP BY 1, 2) WHERE recency <= 30"))
def history(spark, d):
    return O.estimate_history(V.estimates(spark, d)).select("ticker", "as_of", "recency", F.size("periods").alias("periods"), rnd(F.col("periods")[0]["eps_average"], 4).alias("first_eps"))


@register("val_04_forward_pe_series", S.sql("estimates bars", f"SELECT n.ticker, n.as_of, b.trade_date AS price_date, {r('b.close / n.eps_value', 6)} AS pe FROM nt n ASOF JOIN bars b ON b.ticker = n.ticker AND n.as_of >= b.trade_date WHERE n.eps_value > 0", EST_ROWS))
def forward_pe(spark, d):
    return O.forward_pe_series(V.bars(spark, d), ntm(spark, d)).select("ticker", "as_of", "price_date", "pe")


@register("val_05_pe_distribution", S.sql("eps_facts bars", f"""SELECT ticker, count(*) AS samples, {r('min(pe)', 2)} AS minimum, {r('quantile_cont(pe, 0.5)', 2)} AS median, {r('quantile_cont(pe, 0.9)', 2)} AS p90, {r('(count(*) FILTER (WHERE pe < cur) + 0.5e0 * count(*) FILTER (WHERE pe = cur)) / count(*) * 100', 2)} AS percentile,
  CASE WHEN count(*) >= 252 THEN 'complete' WHEN count(*) >= 60 THEN 'limited_history' ELSE 'insufficient_samples' END AS quality FROM pes JOIN (SELECT ticker, arg_max(pe, trade_date) AS cur FROM pes GROUP BY 1) USING (ticker) GROUP BY 1""", PE))
def distribution(spark, d):
    s = O.static_pe_series(V.bars(spark, d), ttm(spark, d))
    cur = s.groupBy("ticker").agg(F.max_by("pe", "trade_date").alias("current"))
    return O.pe_distribution(s, cur, 60).select("ticker", "samples", "minimum", "median", "p90", "percentile", "quality")


CV = TTM + ",\n" + EST_ROWS + ",\n" + ANNUAL + f""",
ag AS (SELECT ticker, arg_max(g, period_end) AS revenue_growth, arg_max(m, period_end) AS gross_margin FROM (SELECT ticker, period_end, (rev - lag(rev) OVER w) / abs(lag(rev) OVER w) AS g, gp / rev AS m FROM (SELECT ticker, period_end, max(value) FILTER (WHERE metric_key = 'revenue') AS rev, max(value) FILTER (WHERE metric_key = 'grossProfit') AS gp FROM an GROUP BY 1, 2) WINDOW w AS (PARTITION BY ticker ORDER BY period_end)) GROUP BY 1),
cv AS (SELECT p.ticker, p.close, t.ttm_eps, n.eps_value, n.quality_status, CASE WHEN t.ttm_eps > 0 THEN {r('p.close / t.ttm_eps', 2)} END AS static_pe, CASE WHEN n.eps_value > 0 THEN {r('p.close / n.eps_value', 2)} END AS forward_pe, revenue_growth, gross_margin
  FROM (SELECT ticker, arg_max(close, trade_date) AS close FROM bars GROUP BY 1) p LEFT JOIN (SELECT ticker, arg_max(struct_pack(x := ttm_eps), cp).x AS ttm_eps FROM ttm GROUP BY 1) t USING (ticker) LEFT JOIN (SELECT ticker, arg_max(struct_pack(x := eps_value), as_of).x AS eps_value, arg_max(quality_status, as_of) AS quality_status FROM nt GROUP BY 1) n USING (ticker) LEFT JOIN ag USING (ticker))"""


def valuations(spark, d):
    px = V.bars(spark, d).groupBy("ticker").agg(F.max_by("close", "trade_date").alias("close"))
    a = annual(spark, d).groupBy("ticker", "period_end").pivot("metric_key", ["revenue", "grossProfit"]).agg(F.max("value"))
    return O.company_valuation(px, ttm(spark, d), ntm(spark, d), a)


@register("val_02_company_valuation", S.sql("eps_facts bars estimates facts", f"SELECT ticker, static_pe, forward_pe, {r('revenue_growth', 6)} AS revenue_growth, {r('gross_margin', 6)} AS gross_margin, CASE WHEN eps_value IS NULL THEN 'NO_NTM_EPS' WHEN quality_status = 'proxy' THEN 'NTM_PROXY' WHEN quality_status = 'limited_coverage' THEN 'LIMITED_COVERAGE' ELSE '' END AS issues FROM cv", CV))
def company(spark, d):
    return valuations(spark, d).select("ticker", "static_pe", "forward_pe", rnd("revenue_growth", 6).alias("revenue_growth"), rnd("gross_margin", 6).alias("gross_margin"), F.array_join("issues", ",").alias("issues"))


@register("val_06_peer_valuation", S.sql("eps_facts bars estimates facts relationships", f"""SELECT v.ticker, m.peer_static_pe, m.n AS static_samples, {r('v.static_pe / m.peer_static_pe - 1', 6)} AS static_premium, {r('v.forward_pe / m.peer_forward_pe - 1', 6)} AS forward_premium FROM cv v LEFT JOIN
  (SELECT r.ticker, {r('median(static_pe)', 2)} AS peer_static_pe, {r('median(forward_pe)', 2)} AS peer_forward_pe, count(static_pe) AS n FROM relationships r JOIN cv ON cv.ticker = r.related_ticker WHERE r.active_from <= DATE '2000-06-30' AND (r.active_to IS NULL OR r.active_to >= DATE '2000-06-30') GROUP BY 1) m USING (ticker)""", CV))
def peers(spark, d):
    at = F.lit("2000-06-30").cast("date")
    rel = V.relationships(spark, d).where((F.col("active_from") <= at) & (F.col("active_to").isNull() | (F.col("active_to") >= at))).select("ticker", "related_ticker")
    return O.peer_valuation(valuations(spark, d), rel).select("ticker", "peer_static_pe", "static_samples", "static_premium", "forward_premium")


@register("val_07_scenarios", S.sql("eps_facts bars estimates facts", f"""SELECT ticker, ec AS eps_case, pc AS pe_case, {r('eps_value * ek * forward_pe * pk', 4)} AS scenario_price FROM cv, (VALUES ('bear', 0.9e0), ('base', 1e0), ('bull', 1.1e0)) e(ec, ek), (VALUES ('low', 0.8e0), ('mid', 1e0), ('high', 1.2e0)) p(pc, pk) WHERE eps_value > 0 AND forward_pe > 0""", CV))
def scenario(spark, d):
    return O.pe_scenarios(valuations(spark, d)).select("ticker", "eps_case", "pe_case", "scenario_price")


@register("val_08_share_consistency", S.sql("quarter_totals", "SELECT ticker, period_end, CASE WHEN abs((value / 10) / (1 + n % 3) / (value / 10 / 2) - 1) <= 0.05 THEN 'CONSISTENT' ELSE 'INCONSISTENT' END AS status FROM quarter_totals"))
def share_consistency(spark, d):
    q = V.quarter_totals(spark, d)
    return q.select("ticker", "period_end", O.share_consistency(F.col("value") / 10, (1 + F.col("n") % 3).cast("double"), F.col("value") / 20).alias("status"))
