"""Advice rows of all tickers and horizons (ADV-05), provenance of predictions (PRED-21), incremental back-fill (PRED-19)."""
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from marketloom.functions.scalar import rnd
from marketloom.operators import advice as A, behavior as BH, events as EV, flow as FL, fundamentals as FU, portfolio as PF, predict as O, snapshot as SN, ticks as TK, valuation as VA
from marketloom.operators.asof import asof_joins
from marketloom.plans import sqlviews as S
from marketloom.plans.q_behavior import REL as BREL, STAGED
from marketloom.plans.q_predict import FEAT, FSRC, KEY, PRED, REL, features
from marketloom.plans.q_text import _DIR, _RANK
from marketloom.plans.q_valuation import PE, TTM, ntm, ttm
from marketloom.plans.registry import register
from marketloom.sources import views as V
from marketloom.sources.shared import materialize

r = S.rnd
AS_OF = "2001-08-20"
YEARS = 5
LEAST_STATIC, LEAST_FORWARD = 60, 20


@register("pred_21_provenance", S.sql(FSRC, f"""SELECT ticker, trade_date, horizon, previous_date, {r('quality_score - pq', 2)} AS quality_delta, {r('factor_coverage - pc', 2)} AS coverage_delta, capital_as_of, previous_capital, estimate_as_of, estimate_quality, previous_estimate, scp AS filed_at, previous_filed, total, official, previous_total FROM
  (SELECT *, lag(trade_date) OVER w AS previous_date, lag(CAST(quality_score AS DOUBLE)) OVER w AS pq, lag(factor_coverage) OVER w AS pc, lag(capital_as_of) OVER w AS previous_capital, lag(estimate_as_of) OVER w AS previous_estimate, lag(scp) OVER w AS previous_filed, lag(total) OVER w AS previous_total FROM pv WINDOW w AS (PARTITION BY ticker, horizon ORDER BY trade_date)) WHERE previous_date IS NOT NULL""",
    PRED + """,
zo AS (SELECT p.ticker AS ot, p.trade_date AS od, count(*) FILTER (WHERE severity IN ('P0', 'P1')) AS official FROM pf p JOIN (SELECT accession_number, ticker AS ft, filed_at, min(""" + _RANK + """) AS severity FROM (SELECT accession_number, ticker, filed_at, unnest(string_split(items, ',')) AS item FROM filings) GROUP BY 1, 2, 3) e ON e.ft = p.ticker AND e.filed_at BETWEEN p.trade_date - 30 AND p.trade_date GROUP BY 1, 2),
pv AS (SELECT pd.*, CASE WHEN fe.behavior_score IS NOT NULL THEN pd.trade_date END AS capital_as_of, n.na AS estimate_as_of, n.quality_status AS estimate_quality, fe.scp, coalesce(fe.events_30d, 0) AS total, coalesce(official, 0) AS official
  FROM pd JOIN fe USING (ticker, trade_date) ASOF LEFT JOIN (SELECT ticker AS nk, as_of AS na, quality_status FROM nt WHERE eps_value IS NOT NULL) n ON n.nk = pd.ticker AND pd.trade_date >= n.na LEFT JOIN zo ON ot = pd.ticker AND od = pd.trade_date)"""))
def provenance(spark, d):
    f = materialize(features(spark, d), "features")  # read for the predictions and for their provenance
    e = O.evidence_changes(O.predict(f), f)
    now, old = (lambda c: F.col(f"current_evidence.{c}")), (lambda c: F.col(f"previous_evidence.{c}"))
    return e.select(*KEY, "horizon", "previous_date", "quality_delta", "coverage_delta", now("capital.as_of").alias("capital_as_of"), old("capital.as_of").alias("previous_capital"),
                    now("earnings.as_of").alias("estimate_as_of"), now("earnings.quality_status").alias("estimate_quality"), old("earnings.as_of").alias("previous_estimate"),
                    now("fundamentals.filed_at").alias("filed_at"), old("fundamentals.filed_at").alias("previous_filed"), now("events.total").alias("total"),
                    now("events.official_high_risk").alias("official"), old("events.total").alias("previous_total"))


def percentiles(series: DataFrame, date: str, latest: DataFrame, minimum: int, name: str) -> DataFrame:
    """Rank of each ticker's last PE among those of the YEARS before its ``as_of``."""
    s = series.join(latest.select("ticker", "as_of"), "ticker").where((F.col(date) <= F.col("as_of")) & (F.col(date) >= F.add_months("as_of", -12 * YEARS)))
    current = s.groupBy("ticker").agg(F.max_by("pe", date).alias("current"))
    return VA.pe_distribution(s, current, minimum, date).select("ticker", F.col("percentile").alias(name))


def advice_inputs(spark, d, as_of: str) -> DataFrame:
    """What was known at each ticker's last session up to ``as_of``, one row for each horizon."""
    at = F.lit(as_of).cast("date")
    f = materialize(features(spark, d).where(F.col("trade_date") <= at), "features")
    p = materialize(O.predict(f), "predictions")  # read for the rows and for their reliability
    rel = O.composite_reliability(O.reliability_components(O.evaluate(p))).select("ticker", "horizon", F.col("composite_score").alias("reliability_score"), F.col("status").alias("reliability_status"))
    last = f.groupBy("ticker").agg(F.max("trade_date").alias("as_of"))
    here = lambda rows, date="trade_date": rows.join(last.select("ticker", F.col("as_of").alias(date)), ["ticker", date])
    latest = materialize(here(f).withColumn("as_of", F.col("trade_date")), "latest")  # one row a ticker
    w = O.Window.partitionBy("ticker", "horizon").orderBy("trade_date")
    moved = p.withColumn("horizon_return", F.coalesce(*[F.when(F.col("horizon") == h, F.col("close") / F.lag("close", h).over(w) - 1) for h in A.WEIGHTS]))
    rel = materialize(rel, "reliability")
    rows = here(moved).select("ticker", F.col("trade_date").alias("as_of"), "horizon", "close", "horizon_return", "return_p10", "return_p50", "probability_up")
    bars = materialize(V.bars(spark, d).where(F.col("trade_date") <= at), "bars")
    st = materialize(BH.stages(BH.composite(FL.flow_score(FL.flow_metrics(bars)))).select(
        *KEY, "stage", "direction", "confidence", "score", "daily_score", "daily_confidence", "signal", "close", "high", "low"), "stages")
    shown = here(st).select("ticker", "stage", "direction", F.col("confidence").alias("behavior_confidence"), F.col("score").alias("behavior_score"),
                            F.col("signal").alias("flow_signal"), F.col("daily_confidence").alias("flow_confidence"), F.col("daily_score").alias("flow_score"))
    trust = BH.reliability(BH.validate_forward(st, (20,))).select("ticker", F.col("status").alias("behavior_status"), F.col("reliability_score").alias("behavior_reliability"))
    tick = here(TK.intraday_flow(V.ticks(spark, d), V.minute_bars(spark, d))).select(
        "ticker", F.col("trade_date").alias("intraday_date"), F.col("data_level").alias("intraday_level"), F.col("signal").alias("intraday_signal"), F.col("confidence").alias("intraday_confidence"),
        F.col("score").alias("intraday_score"), (F.col("available") & (F.col("active_ratio") <= -0.45)).alias("sell_imbalance"))
    trailing, forward = materialize(ttm(spark, d), "ttm"), materialize(ntm(spark, d), "ntm")
    static = percentiles(VA.static_pe_series(bars, trailing), "trade_date", last, LEAST_STATIC, "static_percentile")
    ahead = percentiles(VA.forward_pe_series(bars, forward).withColumnRenamed("as_of", "estimated"), "estimated", last, LEAST_FORWARD, "forward_percentile")
    company = latest.select("ticker", "as_of", "trade_date", "regime", "static_premium", "forward_premium", "revenue_growth", "gross_margin")
    company = SN.peer_margins(company, V.relationships(spark, d), SN.statement_states(V.annual_facts(spark, d)))
    rev = VA.revisions(V.estimates(spark, d)).select("ticker", F.col("as_of").alias("revised"), "revision_7d", "revision_30d", "breadth_30d")
    company = asof_joins(company, [(rev, "revised", ["revision_7d", "revision_30d", "breadth_30d"], False)], ["ticker"], "as_of")
    facts = V.facts(spark, d).where("metric_key = 'capitalExpenditure'").join(last, "ticker").where(F.col("filed_at") <= F.col("as_of"))
    actions = FU.comparable_series(facts.withColumn("period_type", F.lit("quarter"))).groupBy("ticker", "as_of").agg(F.max("period_end").alias("_p"), F.max_by("change_pct", "period_end").alias("action_change"))
    actions = actions.select("ticker", F.datediff("as_of", "_p").alias("action_age"), "action_change")
    owned = PF.held(V.trades(spark, d), at).withColumnRenamed("position", "quantity")
    events = V.filing_and_news_events(spark, d)
    last = materialize(last, "last")
    context = reduce(DataFrame.unionByName, [EV.weighted_event_context(events, last, h).withColumn("horizon", F.lit(h)) for h in A.WEIGHTS])
    rows = rows.join(context, ["ticker", "as_of", "horizon"], "left").join(rel, ["ticker", "horizon"], "left")
    # one row a ticker each; written first, so that no plan holds them all and a lost executor repeats one part
    for part in (shown, trust, tick, static, ahead, company.drop("as_of", "trade_date"), actions, owned):
        rows = rows.join(materialize(part, "advice-part"), "ticker", "left")
    return rows.withColumn("breadth_7d", F.lit(None).cast("double"))  # the estimates count revisions of 30 days only


_AT = f"DATE '{AS_OF}'"
_SEV = "CASE severity WHEN 'P0' THEN 100 WHEN 'P1' THEN 75 WHEN 'P2' THEN 45 ELSE 20 END"
_BY = lambda values: "CASE horizon " + " ".join(f"WHEN {h} THEN {v}" for h, v in values.items()) + " END"
_MEAN = lambda parts: f"list_avg(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))"
_SIGNS = {"price": "sp", "capitalFlow": "sf", "intradayFlow": "si", "events": "se", "macro": "sm", "valuation": "sv", "earnings": "sn", "fundamentals": "su"}
_WEIGHT = {k: "(" + _BY({h: f"{A.WEIGHTS[h][i]}e0" for h in A.WEIGHTS}) + ")" for i, k in enumerate(A.COMPONENTS)}
#: Everything is cut at the as-of date first. Ticks begin in 2024, so no session up to it has an intraday score.
ADVICE = (REL + ",\n" + BREL[len(STAGED) + 2:] + "," + PE[len(TTM) + 1:]).replace("FROM pd WHERE horizon", f"FROM pd WHERE trade_date <= {_AT} AND horizon").replace("FROM st WINDOW", f"FROM (SELECT * FROM st WHERE trade_date <= {_AT}) WINDOW") + f""",
al AS MATERIALIZED (SELECT ticker, max(trade_date) AS as_of FROM bars WHERE trade_date <= {_AT} GROUP BY 1),
ap AS (SELECT *, {_BY({h: f"close / lag(close, {h}) OVER w - 1" for h in A.WEIGHTS})} AS hr FROM pd WINDOW w AS (PARTITION BY ticker, horizon ORDER BY trade_date)),
ar AS (SELECT ticker, horizon, {r('s', 2)} AS rel_score, CASE WHEN effective_samples < {_BY({21: 60, 63: 32, 126: 16})} THEN 'INSUFFICIENT' WHEN s >= 85 THEN 'PUBLISHED' ELSE 'OTHER' END AS rel_status
  FROM (SELECT *, direction_accuracy * 0.3e0 + probability_calibration * 0.15e0 + interval_coverage * 0.15e0 + benchmark_skill * 0.15e0 + regime_stability * 0.15e0 + data_quality * 0.1e0 AS s FROM rc)),
ax AS (SELECT ticker, event_date, source_type, severity, direction, CASE WHEN source_type = 'SEC_8K' THEN 1e0 WHEN source_tier = 'TIER_1' THEN 0.9e0 WHEN source_tier = 'SOCIAL' THEN 0.35e0 ELSE 0.65e0 END * CASE WHEN relation_type <> 'DIRECT' THEN 0.65e0 ELSE 1e0 END AS q FROM research_events
  UNION ALL SELECT ticker, filed_at, 'SEC_8K', severity, 'MIXED', 1e0 FROM (SELECT accession_number, ticker, filed_at, min({_RANK}) AS severity FROM (SELECT accession_number, ticker, filed_at, unnest(string_split(items, ',')) AS item FROM filings) GROUP BY 1, 2, 3)),
ec AS (SELECT al.ticker AS ct, horizon AS ch, least(greatest(sum({_DIR} * {_SEV} * q * greatest(0.25e0, 1 - (as_of - event_date) / (back + 1e0))), -100), 100) AS score, avg(q) * 100 AS quality, count(*) FILTER (WHERE source_type = 'SEC_8K' AND severity IN ('P0', 'P1')) AS critical, count(*) FILTER (WHERE source_type = 'NEWS_RISK' AND severity = 'P1') AS unverified
  FROM al JOIN (VALUES (21, 14), (63, 32), (126, 63)) z(horizon, back) ON true JOIN ax ON ax.ticker = al.ticker AND event_date BETWEEN as_of - CAST(back AS INT) AND as_of GROUP BY 1, 2),
ps AS (SELECT p.ticker, trade_date AS day, pe FROM pes p JOIN al USING (ticker) WHERE trade_date BETWEEN as_of - INTERVAL 5 YEAR AND as_of),
pfw AS (SELECT ticker, day, pe FROM (SELECT n.ticker, n.as_of AS day, {r('b.close / n.eps_value', 6)} AS pe FROM nt n ASOF JOIN bars b ON b.ticker = n.ticker AND n.as_of >= b.trade_date WHERE n.eps_value > 0) JOIN al USING (ticker) WHERE day BETWEEN as_of - INTERVAL 5 YEAR AND as_of),
""" + ",\n".join(f"""{name} AS (SELECT ticker AS {name}_t, CASE WHEN count(*) >= {least} THEN {r('(count(*) FILTER (WHERE pe < cur) + 0.5e0 * count(*) FILTER (WHERE pe = cur)) / count(*) * 100', 2)} END AS {name} FROM {src} JOIN (SELECT ticker, arg_max(pe, day) AS cur FROM {src} GROUP BY 1) USING (ticker) GROUP BY 1)"""
                 for name, src, least in (("pcs", "ps", LEAST_STATIC), ("pcf", "pfw", LEAST_FORWARD))) + f""",
pm AS (SELECT a.ticker AS pmt, median(s.gross_margin) AS peer_margin FROM (SELECT al.ticker, as_of, related_ticker FROM al JOIN relationships x ON x.ticker = al.ticker AND x.active_from <= as_of AND (x.active_to IS NULL OR x.active_to >= as_of)) a ASOF LEFT JOIN zs s ON s.sk = a.related_ticker AND a.as_of > s.scp GROUP BY 1),
ra2 AS (SELECT al.ticker AS rt, {r('(v - p7) / abs(p7)', 6)} AS c7, {r('(v - p30) / abs(p30)', 6)} AS c30, CASE WHEN up + dn <> 0 THEN {r('(up - dn) / (up + dn)', 6)} END AS b30 FROM al ASOF JOIN rv ON rv.ticker = al.ticker AND al.as_of >= rv.as_of),
ca AS (SELECT ticker AS cat, as_of - max(period_end) AS age, arg_max(ch, period_end) AS ch FROM (SELECT ticker, as_of, period_end, (value - lag(value) OVER w) / abs(lag(value) OVER w) AS ch FROM (SELECT f.*, as_of FROM facts f JOIN al USING (ticker) WHERE metric_key = 'capitalExpenditure' AND filed_at <= as_of
  QUALIFY row_number() OVER (PARTITION BY f.ticker, period_end ORDER BY filed_at DESC) = 1) WINDOW w AS (PARTITION BY ticker ORDER BY period_end)) GROUP BY ticker, as_of),
oq AS (SELECT ticker AS ot, sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END) > 0 AS pos FROM trades WHERE trade_date <= {_AT} GROUP BY 1),
a0 AS (SELECT p.ticker, al.as_of, p.horizon, p.close, hr, p.return_p10, p.return_p50, p.probability_up, rel_score, rel_status, s.stage, s.direction, s.confidence AS bc, s.score AS bs, s.signal, s.daily_confidence AS dc, ec.score AS es, ec.quality AS eq, coalesce(critical, 0) > 0 AS crit, coalesce(unverified, 0) > 0 AS unv, f.regime, f.static_premium, f.forward_premium,
  f.revenue_growth, f.gross_margin, peer_margin, pcs, pcf, c7, c30, b30, age, ca.ch, coalesce(oq.pos, false) AS pos, coalesce(s.stage <> 'INSUFFICIENT' AND s.confidence >= 60 AND s.direction <> 'NEUTRAL' AND coalesce(rl.effective, 0) >= rl.required AND rl.reliability_score >= 85, false) AS gated
  FROM al JOIN ap p ON p.ticker = al.ticker AND p.trade_date = al.as_of JOIN st s ON s.ticker = al.ticker AND s.trade_date = al.as_of JOIN fe f ON f.ticker = al.ticker AND f.trade_date = al.as_of LEFT JOIN ar ON ar.ticker = p.ticker AND ar.horizon = p.horizon LEFT JOIN rl ON rl.ticker = al.ticker AND rl.horizon = 20
  LEFT JOIN ec ON ct = al.ticker AND ch = p.horizon LEFT JOIN pcs ON pcs_t = al.ticker LEFT JOIN pcf ON pcf_t = al.ticker LEFT JOIN pm ON pmt = al.ticker LEFT JOIN ra2 ON rt = al.ticker LEFT JOIN ca ON cat = al.ticker LEFT JOIN oq ON ot = al.ticker),
a1 AS (SELECT *, {r(S.clamp('hr / (' + _BY({h: f'{v}e0' for h, v in A.SCALES.items()}) + ') * 100', -100, 100), 2)} AS sp, CASE WHEN signal <> 'INSUFFICIENT' AND dc >= 60 THEN {r('CASE WHEN gated THEN bs * 0.55e0 + bs * 0.45e0 ELSE bs END', 2)} END AS sf, CAST(NULL AS DOUBLE) AS si, {r('es', 2)} AS se,
  {r("CASE regime WHEN 'RATE_HEADWIND' THEN -50 WHEN 'RATE_TAILWIND' THEN 50 WHEN 'MIXED' THEN 0 WHEN 'NEUTRAL' THEN 0 END * (" + _BY({h: f'{v}e0' for h, v in A.MACRO_MULTIPLIER.items()}) + ")", 2)} AS sm,
  {r(_MEAN([S.clamp('-forward_premium * 250', -70, 70), S.clamp('-static_premium * 250', -70, 70), S.clamp('(50 - pcf) * 1.4e0', -70, 70), S.clamp('(50 - pcs) * 1.4e0', -70, 70)]), 2)} AS sv,
  {r(_MEAN([S.clamp('c30 * 1000', -80, 80), S.clamp('c7 * 1200', -80, 80), 'b30 * 60e0']), 2)} AS sn, {r(_MEAN([S.clamp('revenue_growth * 250', -75, 75), S.clamp('(gross_margin - peer_margin) * 250', -75, 75)]), 2)} AS su FROM a0),
a2 AS (SELECT *, {' + '.join(f'coalesce({c} * {_WEIGHT[k]}, 0)' for k, c in _SIGNS.items())} AS tot, {' + '.join(f'CASE WHEN {c} IS NULL THEN 0e0 ELSE {_WEIGHT[k]} END' for k, c in _SIGNS.items())} AS wt,
  CASE WHEN age BETWEEN 0 AND 370 THEN coalesce(CASE WHEN ch IS NOT NULL THEN least(greatest(15 + ch * 20, 0), 30) END, 10e0) ELSE 0e0 END AS adj, coalesce(rel_status = 'PUBLISHED' AND rel_score >= 85 AND return_p50 IS NOT NULL AND probability_up IS NOT NULL, false) AS formal, gated AND direction = 'BEARISH' AND bs <= -20 AS outflow FROM a1),
a3 AS (SELECT *, CASE WHEN wt > 0 THEN {r('least(greatest(tot / wt + adj, -100), 100)', 2)} ELSE 0e0 END AS imp, {r('wt * 100', 2)} AS cover FROM a2),
a4 AS (SELECT *, {r(f"least(greatest(cover * 0.6e0 + coalesce({r('eq', 2)}, 50) * 0.15e0 + coalesce(rel_score, 0) * 0.25e0, 0), 100)", 2)} AS conf, formal AND (crit OR NOT outflow) AS ready FROM a3)"""


@register("adv_05_advice_rows", S.sql(FSRC + " trades facts", f"""SELECT ticker, as_of, horizon, CASE WHEN crit THEN CASE WHEN pos THEN 'EXIT_RISK_REVIEW' ELSE 'AVOID' END WHEN outflow THEN CASE WHEN pos THEN 'REDUCE_REVIEW' ELSE 'AVOID' END WHEN NOT formal AND (unv OR imp <= -35) THEN CASE WHEN pos THEN 'EXIT_RISK_REVIEW' ELSE 'AVOID' END
  WHEN NOT formal AND imp <= -20 THEN CASE WHEN pos THEN 'REDUCE_REVIEW' ELSE 'AVOID' END WHEN NOT formal THEN CASE WHEN pos THEN 'HOLD_REVIEW' ELSE 'WATCH' END WHEN imp >= 20 AND return_p50 >= 0.03 AND probability_up >= 0.55 AND conf >= 60 THEN CASE WHEN pos THEN 'ADD_CANDIDATE' ELSE 'BUY_CANDIDATE' END
  WHEN imp <= -20 OR return_p50 <= -0.03 OR probability_up <= 0.45 THEN CASE WHEN pos THEN 'REDUCE_CANDIDATE' ELSE 'AVOID' END ELSE CASE WHEN pos THEN 'HOLD' ELSE 'WATCH' END END AS action, CASE WHEN imp >= 20 THEN 'BULLISH' WHEN imp <= -20 THEN 'BEARISH' ELSE 'NEUTRAL' END AS stance, imp AS impact_score, conf AS confidence_score, cover AS factor_coverage,
  CASE WHEN crit THEN 'RISK_OVERRIDE' WHEN outflow OR NOT formal THEN 'OBSERVE' ELSE 'PUBLISHED' END AS publication_status, ready AS formal_ready, close AS current_price, CASE WHEN ready THEN {r('close * (1 + return_p50)', 4)} END AS target_price, CASE WHEN ready AND return_p10 < 0 THEN {r('close * (1 + return_p10)', 4)} END AS stop_price,
  {', '.join(f'{c} AS "score_{k}"' for k, c in _SIGNS.items())} FROM a4""", ADVICE))
def advice(spark, d):
    return A.advice_rows(advice_inputs(spark, d, AS_OF))


#: One report a ticker and quarter; each is compared with the one before it.
_REPORTS = """rq AS (SELECT ticker, period_end, CAST(floor(value) AS BIGINT) AS price, n, lag(period_end) OVER w AS p_end, lag(CAST(floor(value) AS BIGINT)) OVER w AS p_price, lag(n) OVER w AS p_n FROM quarter_totals WINDOW w AS (PARTITION BY ticker ORDER BY period_end)),
rl0 AS (SELECT ticker, period_end, unnest(['$.report.asOf', '$.report.analysisPrice', '$.report.schemaVersion', '$.report.templateVersion', '$.operating.orders', '$.valuation.label', '$.events[0]', '$.predictions.note', '$.evidence[0].ref']) AS path,
  unnest([CAST(p_end AS VARCHAR), CAST(p_price AS VARCHAR), 's1', 't' || year(p_end), CAST(p_n AS VARCHAR), CASE WHEN p_n % 2 = 0 THEN 'HIGH' ELSE 'LOW' END, 'E' || p_n % 5, CASE WHEN p_n % 3 = 0 THEN 'x' END, 'F' || month(p_end)]) AS old,
  unnest([CAST(period_end AS VARCHAR), CAST(price AS VARCHAR), 's1', 't' || year(period_end), CAST(n AS VARCHAR), CASE WHEN n % 2 = 0 THEN 'HIGH' ELSE 'LOW' END, 'E' || n % 5, CASE WHEN n % 3 = 0 THEN 'x' END, 'F' || month(period_end)]) AS new,
  unnest(['REPORT_META', 'PRICE', 'REPORT_META', 'REPORT_META', 'OPERATING', 'VALUATION', 'EVENT', 'PREDICTION', 'EVIDENCE']) AS category FROM rq WHERE p_end IS NOT NULL),
rd AS (SELECT * FROM rl0 WHERE old IS DISTINCT FROM new)"""


def report_changes(spark, d) -> DataFrame:
    from marketloom.functions.json import flatten_tree
    q, w = V.quarter_totals(spark, d), O.Window.partitionBy("ticker").orderBy("period_end")
    n, end = F.col("n"), F.col("period_end")
    report = F.to_json(F.struct(
        F.struct(end.cast("string").alias("asOf"), F.floor("value").cast("long").alias("analysisPrice"), F.lit("s1").alias("schemaVersion"), F.concat(F.lit("t"), F.year(end)).alias("templateVersion")).alias("report"),
        F.struct(n.alias("orders")).alias("operating"), F.struct(F.when(n % 2 == 0, "HIGH").otherwise("LOW").alias("label")).alias("valuation"), F.array(F.concat(F.lit("E"), n % 5)).alias("events"),
        F.when(n % 3 == 0, F.struct(F.lit("x").alias("note"))).alias("predictions"), F.array(F.struct(F.concat(F.lit("F"), F.month(end)).alias("ref"))).alias("evidence")))
    leaves = materialize(flatten_tree(q.select("ticker", "period_end", report.alias("doc")), ["ticker", "period_end"], "doc", 4), "report-leaves")  # read as the new and as the old version
    following = q.select("ticker", "period_end", F.lead("period_end").over(w).alias("next"))
    old = leaves.join(following.where("next IS NOT NULL"), ["ticker", "period_end"]).select("ticker", F.col("next").alias("period_end"), "path", "leaf")
    new = leaves.join(following.where("next IS NOT NULL").select("ticker", F.col("next").alias("period_end")), ["ticker", "period_end"], "left_semi")
    return A.report_diff(old, new, ["ticker", "period_end"])


@register("rep_03_report_diff", S.sql("quarter_totals", """SELECT ticker, period_end, path, old, new, category, CASE WHEN path = '$.report.asOf' THEN 'ROLLING_DATE' WHEN path LIKE '%Version%' THEN 'RULE_OR_MODEL_CHANGE' ELSE 'NEW_INFORMATION_OR_CORRECTION' END AS change_type, category <> 'REPORT_META' AS material,
  CASE WHEN old IS NULL THEN 'ADDED' WHEN new IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change FROM rd""", _REPORTS))
def report_diff(spark, d):
    return report_changes(spark, d).select("ticker", "period_end", "path", "old", "new", "category", "change_type", "material", "change")


@register("rep_03_diff_summary", S.sql("quarter_totals", """SELECT ticker, period_end, count(*) AS changes, count(*) FILTER (WHERE category <> 'REPORT_META') AS material_changes, count(*) FILTER (WHERE category = 'PRICE') AS price, count(*) FILTER (WHERE category = 'PREDICTION') AS prediction,
  CASE WHEN bool_or(path = '$.report.templateVersion') THEN 'TEMPLATE_CHANGED' ELSE '' END AS warnings FROM rd GROUP BY 1, 2""", _REPORTS))
def diff_summary(spark, d):
    s = A.diff_summary(report_changes(spark, d), ["ticker", "period_end"])
    return s.select("ticker", "period_end", "changes", "material_changes", "price", "prediction", F.array_join("warnings", ",").alias("warnings"))
