"""Features, predictions and reliability (PRED-*, REL-*), macro context (MAC-*)."""
from pyspark.sql import functions as F

from marketloom.functions.scalar import rnd
from marketloom.operators import behavior as BH, flow as FL, macro as MC, predict as O, snapshot as SN, valuation as VA
from marketloom.operators.asof import asof_join
from marketloom.operators.series import non_overlapping
from marketloom.plans import sqlviews as S
from marketloom.plans.q_behavior import STAGED
from marketloom.plans.q_text import _DIR, _MAG, _RANK
from marketloom.plans.q_valuation import EST_ROWS, REV, TTM, ntm, ttm
from marketloom.plans.registry import register
from marketloom.sources import views as V
from marketloom.sources.shared import materialize

r, clamp = S.rnd, S.clamp
KEY = ["ticker", "trade_date"]

MAC = f"""mc AS (SELECT *, lag(close) OVER (PARTITION BY indicator_key ORDER BY trade_date) AS prev FROM macro_bars),
md AS (SELECT indicator_key, trade_date, close, CASE WHEN indicator_key LIKE '%YIELD' THEN {r('(close - prev) * 100', 2)} WHEN indicator_key = 'FED_FUNDS_FUTURES' THEN {r('-(close - prev) * 100', 2)} END AS change_bps, CASE WHEN indicator_key IN ('US10Y_FUTURES', 'LONG_TREASURY_ETF') THEN {r('(close - prev) / prev', 6)} END AS change_pct FROM mc),
dt AS (SELECT DISTINCT trade_date FROM macro_bars),
cx AS (SELECT dt.trade_date, a.change_bps AS t, b.change_bps AS e FROM dt ASOF LEFT JOIN (SELECT * FROM md WHERE indicator_key = 'US10Y_YIELD') a ON dt.trade_date >= a.trade_date ASOF LEFT JOIN (SELECT * FROM md WHERE indicator_key = 'FED_FUNDS_FUTURES') b ON dt.trade_date >= b.trade_date),
ctx AS (SELECT *, CASE WHEN hd AND tl THEN 'MIXED' WHEN hd THEN 'RATE_HEADWIND' WHEN tl THEN 'RATE_TAILWIND' ELSE 'NEUTRAL' END AS regime, CASE WHEN abs(coalesce(t, 0)) >= 25 OR abs(coalesce(e, 0)) >= 15 THEN 'P1' WHEN abs(coalesce(t, 0)) >= 10 OR abs(coalesce(e, 0)) >= 5 THEN 'P2' ELSE 'P3' END AS severity
  FROM (SELECT *, coalesce(t >= 10, false) OR coalesce(e >= 5, false) AS hd, coalesce(t <= -10, false) OR coalesce(e <= -5, false) AS tl FROM cx))"""


@register("mac_01_indicator_changes", S.sql("macro_bars", "SELECT indicator_key, trade_date, change_bps, change_pct FROM md", MAC))
def changes(spark, d):
    return MC.indicator_changes(V.macro_bars(spark, d)).select("indicator_key", "trade_date", "change_bps", "change_pct")


@register("mac_02_regime", S.sql("macro_bars", "SELECT trade_date, regime, severity FROM ctx", MAC))
def regime(spark, d):
    return MC.market_context(V.macro_bars(spark, d)).select("trade_date", "regime", "severity")


@register("mac_03_macro_events", S.sql("macro_bars", "SELECT trade_date, 'MACRO_RATES:' || trade_date || ':' || regime AS event_key FROM ctx WHERE severity IN ('P1', 'P2') AND regime <> 'NEUTRAL'", MAC))
def macro_events(spark, d):
    return MC.macro_events(MC.market_context(V.macro_bars(spark, d))).select("trade_date", "event_key")


F20 = "(PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"

def _pe(close, eps):
    return f"CASE WHEN {eps} > 0 THEN {r(f'{close} / {eps}', 4)} END"


FEAT = STAGED + ",\n" + TTM + ",\n" + REV + ",\n" + MAC + ",\n" + EST_ROWS + f""",
pr AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY trade_date) - 1 AS r1 FROM bars),
pf AS MATERIALIZED (SELECT ticker, trade_date, close, row_number() OVER w AS sample_size, {', '.join(f"{r(f'close / lag(close, {n}) OVER w - 1', 6)} AS return_{n}d" for n in (5, 21, 63, 126))}, {r(f'stddev_samp(r1) OVER {F20}', 6)} AS volatility_20d, {r(f'close / avg(close) OVER {F20} - 1', 6)} AS ma_gap_20d FROM pr WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)),
mk AS (SELECT trade_date AS md, close AS market_close, return_21d AS market_21d, return_63d AS market_63d, return_126d AS market_126d, volatility_20d AS market_volatility FROM pf WHERE ticker = 'T00'),
rv2 AS (SELECT ticker AS tk, as_of, coalesce(({r('(v - p7) / abs(p7)', 6)} + {r('(v - p30) / abs(p30)', 6)}) / 2, {r('(v - p7) / abs(p7)', 6)}, {r('(v - p30) / abs(p30)', 6)}) AS eps_revision FROM rv),
zn AS MATERIALIZED (SELECT ticker AS nk, as_of AS na, {r('eps_value', 4)} AS ntm_eps FROM nt WHERE eps_value IS NOT NULL),
zx AS (SELECT ticker AS xk, min(ticker) OVER (PARTITION BY sector) AS industry FROM securities),
zi AS (SELECT ticker AS ik, trade_date AS id, close AS industry_close, return_21d AS industry_21d, return_63d AS industry_63d, return_126d AS industry_126d FROM pf),
zcp AS (SELECT DISTINCT ticker, filed_at AS cp FROM annual_facts),
zv AS (SELECT c.ticker, c.cp, a.metric_key, a.period_end, arg_max(a.value, a.filed_at) AS v FROM zcp c JOIN annual_facts a ON a.ticker = c.ticker AND a.filed_at <= c.cp GROUP BY 1, 2, 3, 4),
zr AS (SELECT ticker, cp, period_end, v AS rev, lag(v) OVER (PARTITION BY ticker, cp ORDER BY period_end) AS before, row_number() OVER (PARTITION BY ticker, cp ORDER BY period_end DESC) AS k FROM zv WHERE metric_key = 'revenue'),
zs AS MATERIALIZED (SELECT zr.ticker AS sk, zr.cp AS scp, {r('(rev - before) / abs(before)', 6)} AS revenue_growth, {r('g.v / rev', 6)} AS gross_margin, {r('o.v / rev', 6)} AS cash_flow_margin FROM zr
  LEFT JOIN zv g ON g.ticker = zr.ticker AND g.cp = zr.cp AND g.period_end = zr.period_end AND g.metric_key = 'grossProfit' LEFT JOIN zv o ON o.ticker = zr.ticker AND o.cp = zr.cp AND o.period_end = zr.period_end AND o.metric_key = 'operatingCashFlow' WHERE k = 1),
zp AS MATERIALIZED (SELECT p.ticker, p.trade_date, x.related_ticker FROM pf p JOIN relationships x ON x.ticker = p.ticker AND x.active_from <= p.trade_date AND (x.active_to IS NULL OR x.active_to >= p.trade_date)),
zq AS (SELECT a.related_ticker, a.trade_date, c.close, t.ttm_eps, n.ntm_eps FROM (SELECT DISTINCT related_ticker, trade_date FROM zp) a ASOF LEFT JOIN pf c ON c.ticker = a.related_ticker AND a.trade_date >= c.trade_date
  ASOF LEFT JOIN ttm t ON t.ticker = a.related_ticker AND a.trade_date > t.cp ASOF LEFT JOIN zn n ON n.nk = a.related_ticker AND a.trade_date >= n.na),
zm AS MATERIALIZED (SELECT zp.ticker AS mt, zp.trade_date AS mdt, median({_pe('close', 'ttm_eps')}) AS peer_s, median({_pe('close', 'ntm_eps')}) AS peer_f FROM zp JOIN zq USING (related_ticker, trade_date) GROUP BY 1, 2),
zw AS (SELECT ticker, event_date AS day, {_DIR} * {_MAG} AS w FROM research_events UNION ALL
  SELECT ticker, filed_at, CASE severity WHEN 'P0' THEN -1 WHEN 'P1' THEN -0.75 ELSE 0 END FROM (SELECT accession_number, ticker, filed_at, min({_RANK}) AS severity FROM (SELECT accession_number, ticker, filed_at, unnest(string_split(items, ',')) AS item FROM filings) GROUP BY 1, 2, 3)),
zd AS (SELECT ticker, day, sum(CAST(w AS DECIMAL(20,4))) AS w, count(*) AS n FROM zw GROUP BY 1, 2),
ze AS MATERIALIZED (SELECT p.ticker AS et, p.trade_date AS ed, CAST(least(greatest(sum(w), -1), 1) AS DOUBLE) AS event_score, sum(n) AS events_30d FROM pf p JOIN zd ON zd.ticker = p.ticker AND zd.day BETWEEN p.trade_date - 30 AND p.trade_date GROUP BY 1, 2),
f0 AS (SELECT p.*, zx.industry FROM pf p LEFT JOIN zx ON zx.xk = p.ticker),
f1 AS (SELECT f0.*, m.* EXCLUDE (md), i.* EXCLUDE (ik, id) FROM f0 ASOF LEFT JOIN mk m ON f0.trade_date >= m.md ASOF LEFT JOIN zi i ON i.ik = f0.industry AND f0.trade_date >= i.id),
f2 AS (SELECT f1.*, t.ttm_eps, n.ntm_eps FROM f1 ASOF LEFT JOIN ttm t ON t.ticker = f1.ticker AND f1.trade_date > t.cp ASOF LEFT JOIN zn n ON n.nk = f1.ticker AND f1.trade_date >= n.na),
f3 AS (SELECT f2.*, x.eps_revision, s.* EXCLUDE (sk) FROM f2 ASOF LEFT JOIN rv2 x ON x.tk = f2.ticker AND f2.trade_date >= x.as_of ASOF LEFT JOIN zs s ON s.sk = f2.ticker AND f2.trade_date > s.scp),
f4 AS (SELECT f3.*, c.regime FROM f3 ASOF LEFT JOIN (SELECT trade_date AS cd, regime FROM ctx) c ON f3.trade_date >= c.cd),
f5 AS (SELECT f4.*, CASE WHEN st.signal <> 'INSUFFICIENT' THEN {r('st.score / 100', 4)} END AS flow_score, CASE WHEN st.stage <> 'INSUFFICIENT' THEN {r('st.score / 100', 4)} END AS behavior_score, {_pe('f4.close', 'ttm_eps')} AS static_pe, {_pe('f4.close', 'ntm_eps')} AS forward_pe, peer_s, peer_f, event_score, events_30d,
  CASE WHEN market_volatility >= 0.025 THEN 'HIGH_VOLATILITY' WHEN market_21d >= 0.03 THEN 'RISK_ON' WHEN market_21d <= -0.03 THEN 'RISK_OFF' ELSE 'BALANCED' END AS risk_regime
  FROM f4 JOIN st ON st.ticker = f4.ticker AND st.trade_date = f4.trade_date LEFT JOIN zm ON mt = f4.ticker AND mdt = f4.trade_date LEFT JOIN ze ON et = f4.ticker AND ed = f4.trade_date),
ft AS (SELECT *, {r('peer_s', 4)} AS peer_static_pe, {r('peer_f', 4)} AS peer_forward_pe, CASE WHEN peer_s > 0 THEN {r('static_pe / peer_s - 1', 6)} END AS static_premium, CASE WHEN peer_f > 0 THEN {r('forward_pe / peer_f - 1', 6)} END AS forward_premium,
  CASE WHEN sample_size >= 127 THEN 30 WHEN sample_size >= 64 THEN 28 WHEN sample_size >= 22 THEN 26 ELSE 0 END + CASE WHEN market_close IS NOT NULL THEN 6 ELSE 0 END + CASE WHEN industry_close IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN flow_score IS NOT NULL THEN 9 ELSE 0 END
  + CASE WHEN behavior_score IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN ttm_eps IS NOT NULL OR ntm_eps IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN peer_s IS NOT NULL OR peer_f IS NOT NULL THEN 6 ELSE 0 END + CASE WHEN ntm_eps IS NOT NULL THEN 9 ELSE 0 END
  + CASE WHEN scp IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN cash_flow_margin IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN regime IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN events_30d > 0 THEN 3 ELSE 0 END AS quality_score FROM f5),
fe AS MATERIALIZED (SELECT *, sample_size >= 22 AND quality_score >= 35 AS eligible FROM ft)"""
FSRC = "bars eps_facts estimates macro_bars annual_facts relationships research_events filings securities"


def features(spark, d):
    """The complete snapshot: prices, two benchmarks, flow, behaviour, valuation, peers, estimates, statements, macro, events.

    What several parts read (one row per ticker and session, filing or estimate) is reduced from the raw tables once and written.
    """
    b = V.written_bars(spark, d)
    prices = O.price_features(b)
    f = O.benchmark_features(prices, b.where("ticker = 'T00'"), "market")
    f = f.withColumn("risk_regime", SN.risk_regime(F.col("market_volatility"), F.col("market_21d")))
    f = SN.industry_features(f, prices, V.industries(spark, d))
    st = BH.stages(BH.composite(FL.flow_score(FL.flow_metrics(b))))
    f = f.join(st.select(*KEY, F.when(F.col("signal") != "INSUFFICIENT", rnd(F.col("daily_score") / 100, 4)).alias("flow_score"),
                         F.when(F.col("stage") != "INSUFFICIENT", rnd(F.col("score") / 100, 4)).alias("behavior_score"),
                         F.when(F.col("stage") != "INSUFFICIENT", F.coalesce("data_level", F.lit("DAILY_BARS"))).alias("behavior_data_level")), KEY)
    quarters, est = materialize(V.quarter_totals(spark, d), "quarters"), materialize(V.estimates(spark, d), "estimates")
    trailing, forward = materialize(ttm(spark, d, quarters), "ttm"), materialize(ntm(spark, d, est), "ntm")
    f = materialize(f, "price-features")  # the rows that all further parts are joined to
    rev = VA.revisions(est).select("ticker", "as_of", O.row_mean([F.col("revision_7d"), F.col("revision_30d")]).alias("eps_revision"))
    f = SN.company_features(f, trailing, forward, rev, V.annual_facts(spark, d, quarters))
    f = SN.peer_features(f, V.relationships(spark, d), prices, trailing, forward)
    ctx = MC.market_context(V.macro_bars(spark, d)).select("trade_date", "regime")
    f = f.join(F.broadcast(ctx), "trade_date", "left")  # one row per date
    f = SN.event_score_features(f, V.filing_and_news_events(spark, d))
    has = lambda *c: F.coalesce(*[F.col(x).cast("string") for x in c]).isNotNull()
    f = f.withColumns({"has_benchmark": has("market_close"), "has_industry": has("industry_close"), "has_flow": has("flow_score"), "has_behavior": has("behavior_score"),
                       "has_valuation": has("ttm_eps", "ntm_eps"), "has_peers": has("peer_static_pe", "peer_forward_pe"), "has_earnings": has("ntm_eps"), "has_fundamentals": has("fiscal_period_end"),
                       "has_cash_flow": has("cash_flow_margin"), "has_macro": has("regime"), "has_events": F.coalesce(F.col("events_30d") > 0, F.lit(False))})
    return O.data_quality(f)


def predictions(spark, d):
    return O.predict(features(spark, d))


def evaluated(spark, d):
    return O.evaluate(predictions(spark, d))


_P = ["return_5d", "return_21d", "return_63d", "return_126d", "volatility_20d", "ma_gap_20d"]


@register("pred_01_price_features", S.sql(FSRC, f"SELECT ticker, trade_date, sample_size, {', '.join(_P)} FROM pf", FEAT))
def price(spark, d):
    return O.price_features(V.bars(spark, d)).select(*KEY, "sample_size", *_P)


@register("pred_02_benchmark_features", S.sql(FSRC, "SELECT ticker, trade_date, market_21d, market_63d, market_126d FROM f1", FEAT))
def bench(spark, d):
    b = V.bars(spark, d)
    return O.benchmark_features(O.price_features(b), b.where("ticker = 'T00'"), "market").select(*KEY, "market_21d", "market_63d", "market_126d")


@register("pred_08_data_quality", S.sql(FSRC, "SELECT ticker, trade_date, CAST(quality_score AS DOUBLE) AS quality_score, eligible FROM fe", FEAT))
def quality(spark, d):
    return features(spark, d).select(*KEY, "quality_score", "eligible")


_SNAP = ["return_21d", "market_21d", "industry_21d", "flow_score", "behavior_score", "static_pe", "forward_pe", "peer_static_pe", "peer_forward_pe", "static_premium", "forward_premium",
         "revenue_growth", "gross_margin", "cash_flow_margin", "regime", "risk_regime", "event_score"]


@register("pred_09_feature_snapshot", S.sql(FSRC, f"SELECT ticker, trade_date, {', '.join(_SNAP)}, {r('eps_revision', 6)} AS eps_revision FROM fe", FEAT))
def snapshot(spark, d):
    return features(spark, d).select(*KEY, *_SNAP, rnd("eps_revision", 6).alias("eps_revision"))


def _mean(a, b):
    return f"coalesce((({a}) + ({b})) / 2, {a}, {b})"


def _horizon_sql(h, scale, ws):
    a, b = {21: (5, 21), 63: (21, 63), 126: (63, 126)}[h]
    s = {"momentum": clamp(f"coalesce((return_{a}d + return_{b}d) / 2, return_{a}d, return_{b}d) / {scale}e0", -1, 1), "relativeStrength": clamp(f"(return_{h}d - market_{h}d) / {scale}e0", -1, 1), "capitalFlow": "flow_score",
         "valuation": _mean(*(clamp(f"CASE WHEN {c} > 0 THEN (30 - {c}) / 35 END", -1, 1) for c in ("forward_pe", "static_pe"))), "earnings": clamp("eps_revision / 0.05e0", -1, 1), "macro": "CASE WHEN regime IS NULL THEN NULL WHEN regime = 'RATE_HEADWIND' THEN -0.6e0 WHEN regime = 'RATE_TAILWIND' THEN 0.6e0 ELSE 0e0 END",
         "fundamentals": _mean(clamp("revenue_growth / 0.30e0", -1, 1), clamp("(gross_margin - 0.35e0) / 0.30e0", -1, 1)), "events": "event_score"}
    w = dict(zip(O.FACTORS, ws))
    return f"SELECT *, {h} AS horizon, {scale}e0 AS scale, " + ", ".join(f"{e} AS s_{k}, {w[k]}e0 AS w_{k}" for k, e in s.items()) + " FROM fe"


_SF = list(O.FACTORS)
PRED = FEAT + ",\nh0 AS (" + " UNION ALL ".join(_horizon_sql(h, sc, ws) for h, (sc, ws) in O.HORIZONS.items()) + "),\nh1 AS (SELECT *, " + " + ".join(f"coalesce(s_{k} * w_{k}, 0)" for k in _SF) + " AS tot, " + " + ".join(f"CASE WHEN s_{k} IS NULL THEN 0 ELSE w_{k} END" for k in _SF) + f""" AS cov FROM h0),
h2 AS (SELECT *, CASE WHEN cov > 0 THEN least(greatest(tot / cov, -1), 1) ELSE 0 END AS raw, greatest(0.35e0, quality_score / 100) AS shrink FROM h1),
h3 AS (SELECT *, least(greatest(raw * scale * shrink, -0.8e0), 2) AS ex, greatest(scale * 0.55e0, coalesce(volatility_20d * sqrt(horizon), scale) * 1.28e0) AS half FROM h2),
pd AS (SELECT ticker, trade_date, horizon, close, market_close, quality_score, eligible, {r('raw * 100', 2)} AS signal_score, {r('cov * 100', 2)} AS factor_coverage, {r('least(greatest(ex - half, -0.95e0), 3)', 6)} AS return_p10, {r('ex', 6)} AS return_p50, {r('least(greatest(ex + half, -0.95e0), 3)', 6)} AS return_p90,
  {r('least(greatest(0.5e0 + raw * 0.35e0, 0.05e0), 0.95e0)', 4)} AS probability_up, CASE WHEN ex > 0.01 THEN 'BULLISH' WHEN ex < -0.01 THEN 'BEARISH' ELSE 'NEUTRAL' END AS predicted_direction, {', '.join(f"{r(f's_{k} * w_{k} / cov * scale * shrink', 8)} AS c_{k}" for k in _SF)} FROM h3)"""


@register("pred_10_predictions", S.sql(FSRC, "SELECT ticker, trade_date, horizon, signal_score, factor_coverage, return_p10, return_p50, return_p90, probability_up, predicted_direction FROM pd", PRED))
def predict(spark, d):
    return predictions(spark, d).select(*KEY, "horizon", "signal_score", "factor_coverage", "return_p10", "return_p50", "return_p90", "probability_up", "predicted_direction")


EVAL = PRED + ",\nev0 AS (" + " UNION ALL ".join(f"SELECT *, lead(trade_date, {h}) OVER w AS td, lead(close, {h}) OVER w AS tc, lead(market_close, {h}) OVER w AS tm FROM pd WHERE horizon = {h} WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)" for h in O.HORIZONS) + f"""),
ev AS (SELECT *, CASE WHEN NOT eligible THEN 'EXCLUDED' WHEN td IS NULL THEN 'PENDING' ELSE 'MATURED' END AS status, tc / close - 1 AS ar, tm / market_close - 1 AS br FROM ev0),
em AS (SELECT *, {r('ar', 6)} AS actual_return, {r('br', 6)} AS benchmark_return, predicted_direction = CASE WHEN ar > 0.01 THEN 'BULLISH' WHEN ar < -0.01 THEN 'BEARISH' ELSE 'NEUTRAL' END AS direction_hit, ar BETWEEN return_p10 AND return_p90 AS interval_hit FROM ev WHERE status = 'MATURED')"""


@register("pred_11_evaluation", S.sql(FSRC, "SELECT ticker, trade_date, horizon, td AS actual_date, actual_return, benchmark_return, direction_hit, interval_hit FROM em", EVAL))
def evaluation(spark, d):
    return evaluated(spark, d).where("status = 'MATURED'").select(*KEY, "horizon", "actual_date", "actual_return", "benchmark_return", "direction_hit", "interval_hit")


@register("pred_20_overview_counts", S.sql(FSRC, "SELECT ticker, horizon, count(*) AS total, count(*) FILTER (WHERE status = 'MATURED') AS matured, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'EXCLUDED') AS excluded FROM ev GROUP BY 1, 2", EVAL))
def overview(spark, d):
    return evaluated(spark, d).groupBy("ticker", "horizon").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("MATURED", "PENDING", "EXCLUDED")])


REL = EVAL + f""",
sm AS (SELECT *, count(*) OVER (PARTITION BY ticker, horizon) AS raw_samples FROM em QUALIFY (row_number() OVER (PARTITION BY ticker, horizon ORDER BY trade_date) - 1) % horizon = 0),
ra AS (SELECT ticker, horizon, max(raw_samples) AS raw_samples, count(*) AS effective_samples, avg(CAST(direction_hit AS INT)) AS acc, avg(power(probability_up - CASE WHEN actual_return > 0 THEN 1 ELSE 0 END, 2)) AS brier, avg(CAST(interval_hit AS INT)) AS cov, avg(abs(actual_return - return_p50)) AS mae, avg(abs(actual_return)) AS zero, avg(abs(actual_return - benchmark_return)) AS bm,
  avg(CAST(direction_hit AS INT)) FILTER (WHERE benchmark_return >= 0) AS hp, avg(CAST(direction_hit AS INT)) FILTER (WHERE benchmark_return < 0) AS hn, count(*) FILTER (WHERE benchmark_return >= 0) AS np, count(*) FILTER (WHERE benchmark_return < 0) AS nn, avg(quality_score) AS q FROM sm GROUP BY 1, 2),
rc AS (SELECT ticker, horizon, raw_samples, effective_samples, {r('acc * 100', 2)} AS direction_accuracy, {r('least(greatest(1 - brier / 0.25e0, 0), 1) * 100', 2)} AS probability_calibration, {r('least(greatest(1 - abs(cov - 0.8e0) * 2, 0), 1) * 100', 2)} AS interval_coverage,
  {r('least(greatest(0.5e0 + (1 - mae / least(CASE WHEN zero > 0 THEN zero END, CASE WHEN bm > 0 THEN bm END)) * 0.5e0, 0), 1) * 100', 2)} AS benchmark_skill, {r('CASE WHEN np >= 2 AND nn >= 2 THEN 1 - abs(hp - hn) ELSE 0.5e0 END * 100', 2)} AS regime_stability, {r('q', 2)} AS data_quality FROM ra)"""
_RC = ["raw_samples", "effective_samples", *O.RELIABILITY_WEIGHTS]


@register("rel_01_components", S.sql(FSRC, "SELECT ticker, horizon, " + ", ".join(_RC) + " FROM rc", REL))
def components(spark, d):
    return O.reliability_components(evaluated(spark, d)).select("ticker", "horizon", *_RC)


@register("rel_02_composite", S.sql(FSRC, f"""SELECT ticker, horizon, {r('s', 2)} AS composite_score, CASE WHEN effective_samples < CASE WHEN horizon <= 21 THEN 60 WHEN horizon <= 63 THEN 32 ELSE 16 END THEN 'INSUFFICIENT' WHEN s >= 85 THEN 'PUBLISHED' WHEN s >= 75 THEN 'OBSERVE' ELSE 'REJECTED' END AS status
  FROM (SELECT *, direction_accuracy * 0.3e0 + probability_calibration * 0.15e0 + interval_coverage * 0.15e0 + benchmark_skill * 0.15e0 + regime_stability * 0.15e0 + data_quality * 0.1e0 AS s FROM rc)""", REL))
def composite(spark, d):
    return O.composite_reliability(O.reliability_components(evaluated(spark, d))).select("ticker", "horizon", "composite_score", "status")


@register("rel_03_breakdown", S.sql(FSRC, f"""SELECT horizon, predicted_direction, count(*) AS samples, count(*) FILTER (WHERE direction_hit) AS hits, {r('avg(actual_return)', 6)} AS mean_actual_return FROM em JOIN wk USING (ticker, horizon, trade_date) GROUP BY 1, 2""", EVAL + """,
mv AS (SELECT ticker, horizon, trade_date, td, row_number() OVER (PARTITION BY ticker, horizon ORDER BY trade_date) AS n FROM em),
nx AS (SELECT a.*, b.n AS next_n FROM mv a ASOF LEFT JOIN mv b ON a.ticker = b.ticker AND a.horizon = b.horizon AND a.td < b.trade_date),
wk AS (WITH RECURSIVE z AS (SELECT ticker, horizon, n, trade_date, next_n FROM nx WHERE n = 1 UNION ALL SELECT x.ticker, x.horizon, x.n, x.trade_date, x.next_n FROM z JOIN nx x ON x.ticker = z.ticker AND x.horizon = z.horizon AND x.n = z.next_n) SELECT ticker, horizon, trade_date FROM z)"""))
def breakdown(spark, d):
    e = non_overlapping(evaluated(spark, d).where("status = 'MATURED'"), ["ticker", "horizon"], "trade_date", "actual_date")
    return e.groupBy("horizon", "predicted_direction").agg(F.count("*").alias("samples"), F.count_if("direction_hit").alias("hits"), rnd(F.avg("actual_return"), 6).alias("mean_actual_return"))


@register("rel_05_masked_ledger", S.sql(FSRC, "SELECT ticker, trade_date, horizon, CASE WHEN status = 'MATURED' AND td > DATE '2000-06-30' THEN 'PENDING' ELSE status END AS status, CASE WHEN td <= DATE '2000-06-30' AND status = 'MATURED' THEN td END AS actual_date FROM ev WHERE trade_date <= DATE '2000-06-30' AND status <> 'EXCLUDED'", EVAL))
def ledger(spark, d):
    m = BH.mask_as_of(evaluated(spark, d), F.lit("2000-06-30").cast("date"), outcome=("actual_return", "direction_hit", "interval_hit"))
    return m.where("status <> 'EXCLUDED'").select(*KEY, "horizon", "status", "actual_date")


@register("pred_16_change_attribution", S.sql(FSRC, f"""SELECT ticker, trade_date, horizon, {r('return_p50 - p_r', 8)} AS return_change, CASE WHEN p_d <> predicted_direction THEN 'DIRECTION_CHANGE' WHEN abs(return_p50 - p_r) >= 0.02 OR abs(probability_up - p_p) >= 0.05 THEN 'MATERIAL_CHANGE' WHEN abs(return_p50 - p_r) >= 0.005 THEN 'MODERATE_CHANGE' ELSE 'STABLE' END AS change_type,
  {r('(close - p_c) * (1 + p_r)', 4)} AS market_price_effect, {r('coalesce(c_momentum, 0) - coalesce(p_m, 0)', 8)} AS d_momentum FROM (SELECT *, lag(return_p50) OVER w AS p_r, lag(predicted_direction) OVER w AS p_d, lag(probability_up) OVER w AS p_p, lag(close) OVER w AS p_c, lag(c_momentum) OVER w AS p_m FROM pd WINDOW w AS (PARTITION BY ticker, horizon ORDER BY trade_date)) WHERE p_d IS NOT NULL""", PRED))
def change(spark, d):
    return O.prediction_changes(predictions(spark, d)).select(*KEY, "horizon", "return_change", "change_type", "market_price_effect", "d_momentum")
