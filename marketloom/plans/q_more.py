"""Further advice, report, prediction and filter queries."""
from pyspark.sql import Window, functions as F

from marketloom.functions.json import material_hash
from marketloom.functions.scalar import rnd
from marketloom.operators import advice as A, behavior as BH, factors as FA, fundamentals as FU, macro as MC, portfolio as PF, predict as PR, quality as Q, signals as SG
from marketloom.operators.series import over
from marketloom.plans import sqlviews as S
from marketloom.plans.q_behavior import REL as BREL, STAGED, staged
from marketloom.plans.q_fundamentals import _DAILY, states
from marketloom.plans.q_portfolio import CAL, DAILY, M, calendar
from marketloom.plans.q_predict import EVAL, FEAT, FSRC, MAC, features, predictions
from marketloom.plans.q_signals import CUR, IND, curve, ind
from marketloom.plans.registry import register
from marketloom.sources import views as V

r = S.rnd


@register("flt_02_strictly_before", S.sql("facts", "SELECT ticker, metric_key, count(*) AS visible FROM facts WHERE filed_at < DATE '1999-05-01' GROUP BY 1, 2"))
def before(spark, d):
    return V.facts(spark, d).where(F.col("filed_at") < F.lit("1999-05-01").cast("date")).groupBy("ticker", "metric_key").agg(F.count("*").alias("visible"))


@register("flt_04_in_list", S.sql("trades securities", "SELECT id FROM trades WHERE ticker IN (SELECT ticker FROM securities WHERE sector = 'G1')"))
def in_list(spark, d):
    return V.trades(spark, d).join(V.securities(spark, d).where("sector = 'G1'").select("ticker"), "ticker", "left_semi").select("id")


@register("agg_19_rank_correlation", S.sql("bars", f"""SELECT {r('corr(a, b)', 6)} AS close_volume, {r('corr(a, c)', 6)} AS close_range, {r('corr(b, c)', 6)} AS volume_range FROM (SELECT close_r AS a, vol_r AS b, rng_r AS c FROM (SELECT
  (rank() OVER (PARTITION BY trade_date ORDER BY close) + (count(*) OVER (PARTITION BY trade_date, close) - 1) / 2e0) / count(*) OVER (PARTITION BY trade_date) AS close_r, (rank() OVER (PARTITION BY trade_date ORDER BY volume) + (count(*) OVER (PARTITION BY trade_date, volume) - 1) / 2e0) / count(*) OVER (PARTITION BY trade_date) AS vol_r,
  (rank() OVER (PARTITION BY trade_date ORDER BY high - low) + (count(*) OVER (PARTITION BY trade_date, high - low) - 1) / 2e0) / count(*) OVER (PARTITION BY trade_date) AS rng_r FROM bars))"""))
def rank_corr(spark, d):
    from marketloom.operators.series import average_tie_rank as rk
    b = V.bars(spark, d).select(rk("close", ["trade_date"]).alias("a"), rk("volume", ["trade_date"]).alias("b"), rk(F.col("high") - F.col("low"), ["trade_date"]).alias("c"))
    return b.agg(rnd(F.corr("a", "b"), 6).alias("close_volume"), rnd(F.corr("a", "c"), 6).alias("close_range"), rnd(F.corr("b", "c"), 6).alias("volume_range"))


@register("src_19_feature_frame", S.sql("facts bars", f"SELECT i.ticker, i.trade_date, {r('sma', 4)} AS sma, {r('s120', 4)} AS sma120, fin_state, ready FROM (SELECT *, CASE WHEN rn >= 120 THEN avg(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) END AS s120 FROM ind) i JOIN dp USING (ticker, trade_date)", _DAILY + ",\n" + IND))
def feature_frame(spark, d):
    from marketloom.operators.series import rolling
    b = ind(spark, d).withColumn("sma120", rolling(F.avg, "close", 120, over()))
    p = FU.daily_panel(b, states(spark, d), "trade_date", ["fin_period", "revenue_yoy", "gross_margin_yoy", "fcf_ttm"])
    return p.select("ticker", "trade_date", rnd("sma", 4).alias("sma"), rnd("sma120", 4).alias("sma120"), FU.financial_state("trade_date", p).alias("fin_state"), "ready")


@register("pred_17_input_changes", S.sql(FSRC, f"""SELECT ticker, trade_date, input, {r('current - previous', 6)} AS delta FROM (SELECT ticker, trade_date, unnest(['return_21d', 'market_21d', 'eps_revision']) AS input, unnest([return_21d, market_21d, eps_revision]) AS current, unnest([lag(return_21d) OVER w, lag(market_21d) OVER w, lag(eps_revision) OVER w]) AS previous, row_number() OVER w AS n FROM fe WINDOW w AS (PARTITION BY ticker ORDER BY trade_date))
  WHERE n > 1 AND previous IS DISTINCT FROM current AND NOT coalesce(abs(current - previous) <= 1e-10, false)""", FEAT))
def input_changes(spark, d):
    return PR.input_changes(features(spark, d), ["return_21d", "market_21d", "eps_revision"], ["ticker"], "trade_date").select("ticker", "trade_date", "input", rnd("delta", 6).alias("delta"))


_FIX = EVAL + f""",
kn AS (SELECT ticker, horizon, trade_date, td, close * (1 + return_p10) AS lo, close * (1 + return_p50) AS mid, close * (1 + return_p90) AS hi FROM ev0 WHERE td IS NOT NULL),
an AS (SELECT ticker, horizon AS anchor_horizon, max(trade_date) AS aa, arg_max(td, trade_date) AS anchor_target FROM kn WHERE horizon IN (21, 63) GROUP BY 1, 2),
pt AS (SELECT an.*, kn.horizon, kn.lo, kn.mid, kn.hi FROM an JOIN kn ON kn.ticker = an.ticker AND kn.horizon >= an.anchor_horizon AND kn.trade_date <= aa AND abs(kn.td - anchor_target) <= 7 QUALIFY row_number() OVER (PARTITION BY an.ticker, anchor_horizon, kn.horizon ORDER BY abs(kn.td - anchor_target), kn.trade_date DESC) = 1),
fx AS (SELECT ticker, anchor_horizon, anchor_target, count(*) AS points, arg_min(mid, horizon) / arg_max(mid, horizon) - 1 AS mv, (max(mid) - min(mid)) / abs(avg(mid)) AS sp, max(lo) <= min(hi) AS ov FROM pt GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""


@register("pred_18_fixed_targets", S.sql(FSRC, f"SELECT ticker, anchor_horizon, anchor_target, points, {r('mv', 6)} AS target_change_pct, CASE WHEN mv > 0.01 THEN 'UPGRADED' WHEN mv < -0.01 THEN 'DOWNGRADED' ELSE 'STABLE' END AS revision, {r('sp', 6)} AS target_spread_pct, ov AS intervals_overlap FROM fx", _FIX))
def fixed_targets(spark, d):
    w = Window.partitionBy("ticker", "horizon").orderBy("trade_date")
    p = predictions(spark, d).withColumn("target_date", F.coalesce(*[F.when(F.col("horizon") == h, F.lead("trade_date", h).over(w)) for h in PR.HORIZONS]))
    return PR.fixed_target_comparisons(p)


@register("adv_01_component_scores", S.sql("bars", f"""SELECT ticker, trade_date, {r(S.clamp('(close / lag(close, 63) OVER w - 1) / 0.15e0 * 100', -100, 100), 2)} AS price_63, {r("(least(greatest((close / open - 1) * -250, -70), 70) + least(greatest((50 - volume) * 1.4e0, -70), 70)) / 2", 2)} AS valuation FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)"""))
def component_scores(spark, d):
    p = A.price_score(F.col("close") / F.lag("close", 63).over(over()) - 1, 63)
    return V.bars(spark, d).select("ticker", "trade_date", p.alias("price_63"), A.valuation_score([F.col("close") / F.col("open") - 1], [F.col("volume")]).alias("valuation"))


@register("adv_06_flow_gate", S.sql("bars", f"""SELECT ticker, trade_date, used, {r('CASE WHEN used THEN s0 * 0.55e0 + score * 0.45e0 ELSE s0 END', 2)} AS blended FROM (SELECT st.ticker, st.trade_date, st.score, st.score AS s0, stage <> 'INSUFFICIENT' AND confidence >= 60 AND direction <> 'NEUTRAL' AND coalesce(effective, 0) >= required AND reliability_score >= 55 AS used FROM st JOIN rl ON rl.ticker = st.ticker AND rl.horizon = 20)""", BREL))
def flow_gate(spark, d):
    from marketloom.sources.shared import materialize
    st = materialize(staged(spark, d).select("ticker", "trade_date", "score", "stage", "confidence", "direction", "close", "high", "low"), "stages")  # read by both sides below
    rel = BH.reliability(BH.validate_forward(st)).where("horizon = 20").select("ticker", F.col("status").alias("rs"), "reliability_score")
    j = st.join(rel, "ticker")
    gate = A.flow_gate(F.col("stage"), F.col("confidence"), F.col("direction"), F.when(F.col("rs") != "INSUFFICIENT", "PUBLISHED"), F.col("reliability_score"), 55.0)
    return j.select("ticker", "trade_date", F.coalesce(gate, F.lit(False)).alias("used"), rnd(A.blended_flow(F.col("score"), F.col("score"), gate), 2).alias("blended"))


@register("the_01_thesis_status", S.sql("quarter_totals", """SELECT ticker, period_end, CASE WHEN n % 17 = 0 THEN 'FALSIFIED' WHEN rev <= -0.02 THEN 'WEAKENED' WHEN rev >= 0.02 THEN 'STRENGTHENED' ELSE 'PENDING' END AS status FROM (SELECT *, value / lag(value) OVER (PARTITION BY ticker ORDER BY period_end) - 1 AS rev FROM quarter_totals)"""))
def theses(spark, d):
    q = V.quarter_totals(spark, d).withColumn("rev", F.col("value") / F.lag("value").over(over("ticker", "period_end")) - 1)
    return q.select("ticker", "period_end", A.thesis_status(F.col("rev"), F.lit(None).cast("double"), F.col("n") % 17 == 0).alias("status"))


@register("con_01_concepts", S.sql("securities", "SELECT ticker, CASE WHEN ticker IN ('T01', 'T02') THEN 'special-' || ticker ELSE 'generic-' || sector END AS concept, CASE WHEN ticker IN ('T01', 'T02') THEN 'SPECIFIC' ELSE 'GENERIC' END AS source FROM securities"))
def concepts(spark, d):
    s = V.securities(spark, d)
    spec = s.where("ticker IN ('T01', 'T02')").select("ticker", F.concat(F.lit("special-"), "ticker").alias("concept"))
    gen = s.select("sector").distinct().select("sector", F.concat(F.lit("generic-"), "sector").alias("concept"))
    return A.assign_concepts(s, spec, gen, "sector")


_REP = "x AS (SELECT s.ticker, (SELECT max(close) FROM bars b WHERE b.ticker = s.ticker) AS price, (SELECT count(*) FROM filings f WHERE f.ticker = s.ticker HAVING count(*) > 0) AS filings FROM securities s)"


@register("rep_01_report_quality", S.sql("securities bars filings", "SELECT ticker, CASE WHEN price IS NOT NULL AND filings IS NOT NULL THEN 'COMPLETE' WHEN price IS NULL AND filings IS NULL THEN 'UNAVAILABLE' ELSE 'PARTIAL' END AS report_status, concat_ws(',', CASE WHEN price IS NULL THEN 'price' END, CASE WHEN filings IS NULL THEN 'filings' END) AS issues FROM x", _REP))
def report_quality(spark, d):
    p = V.bars(spark, d).groupBy("ticker").agg(F.max("close").alias("price"))
    f = V.filings(spark, d).groupBy("ticker").agg(F.count("*").alias("filings"))
    x = V.securities(spark, d).select("ticker").join(p, "ticker", "left").join(f, "ticker", "left")
    return A.report_quality(x, ["price", "filings"]).select("ticker", "report_status", F.array_join("issues", ",").alias("issues"))


@register("rep_02_new_versions", "SELECT event_id FROM events WHERE event_id % 3 = 0")
def new_versions(spark, d):
    """A new version is stored only if the material hash differs from a stored one of the same entity."""
    e = V.table(spark, d, "events").select("event_id", F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(',"generated_at":"1"}')).alias("doc"))
    later = e.withColumn("doc", F.when(F.col("event_id") % 3 == 0, F.replace("doc", F.lit('"k"'), F.lit('"k2"'))).otherwise(F.replace("doc", F.lit('"1"'), F.lit('"2"'))))
    old = material_hash(e, ["event_id"], "doc", ("generated_at",), 1)
    return material_hash(later, ["event_id"], "doc", ("generated_at",), 1).join(old, ["event_id", "hash"], "left_anti").select("event_id")


@register("dq_07_identity_checks", S.sql("bars", "SELECT DISTINCT ticker, rule, true AS holds FROM cur", CUR))
def identities(spark, d):
    c = SG.wealth_attribution(curve(spark, d))
    return Q.residual_check(c, ["ticker", "rule"], F.col("residual"), 1e-6).select("ticker", "rule", "holds")


@register("fac_22_strategy_performance", S.sql("trades bars", f"""SELECT ticker, year(trade_date) AS year, month(trade_date) AS month, {r(M('coalesce(pnl, 0)'), 2)} AS known_pnl FROM pnl GROUP BY 1, 2, 3""", DAILY.replace("FROM trades JOIN cal", "FROM (SELECT * FROM trades WHERE note LIKE '2-%') JOIN cal")))
def strategy_performance(spark, d):
    t = V.trades(spark, d).where(F.col("note").startswith("2-"))
    x = PF.daily_pnl(t, V.bars(spark, d), calendar(spark, d))
    return x.groupBy("ticker", F.year("trade_date").alias("year"), F.month("trade_date").alias("month")).agg(rnd(F.sum(F.coalesce("pnl", F.lit(0.0)).cast(PF.MONEY)).cast("double"), 2).alias("known_pnl"))


@register("rel_06_manual_components", S.sql("quarter_totals", f"""SELECT ticker, period_end, horizon, {r('s', 2)} AS composite_score, CASE WHEN n < need THEN 'INSUFFICIENT' WHEN s >= 85 THEN 'PUBLISHED' WHEN s >= 75 THEN 'OBSERVE' ELSE 'REJECTED' END AS status FROM (SELECT *, (50 + n % 50) * 0.9e0 + 9 AS s, CASE WHEN horizon <= 21 THEN 60 WHEN horizon <= 63 THEN 32 ELSE 16 END AS need FROM quarter_totals, (SELECT unnest([21, 63, 126]) AS horizon))"""))
def manual(spark, d):
    q = V.quarter_totals(spark, d).withColumn("horizon", F.explode(F.array(F.lit(21), F.lit(63), F.lit(126))))
    q = q.withColumns({k: (50 + F.col("n") % 50).cast("double") for k in PR.RELIABILITY_WEIGHTS if k != "data_quality"} | {"data_quality": F.lit(90.0), "effective_samples": F.col("n")})
    return PR.composite_reliability(q).select("ticker", "period_end", "horizon", "composite_score", "status")


@register("the_02_event_chains", S.sql("research_events", """SELECT event_id, CASE WHEN source_type = 'NEWS_IMPACT' THEN direction WHEN source_type = 'NEWS_RISK' OR severity IN ('P0', 'P1') THEN 'NEGATIVE' ELSE 'MIXED' END AS thesis_direction,
  CASE event_id % 4 WHEN 0 THEN 'SHARE_COUNT' WHEN 1 THEN 'CAPACITY_AND_UNIT_COST' WHEN 2 THEN 'RISK_FREE_RATE' ELSE 'OTHER' END AS exposure FROM research_events"""))
def chains(spark, d):
    e = V.research_events(spark, d)
    kind = F.element_at(F.array(F.lit("buyback plan"), F.lit("new capacity"), F.lit("treasury move"), F.lit("note")), (F.col("event_id") % 4 + 1).cast("int"))
    explicit = F.when(F.col("source_type") == "NEWS_IMPACT", F.col("direction"))
    return e.select("event_id", A.thesis_direction(explicit, F.col("source_type"), kind, F.col("severity")).alias("thesis_direction"), A.transmission(kind, F.lit("title"))["exposure"].alias("exposure"))


@register("str_13_template_choice", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'SEMICONDUCTOR_CYCLE' WHEN p_partkey % 3 = 1 THEN 'TECHNOLOGY_COMPETITION' ELSE 'GENERAL_FINANCIAL' END AS template FROM part")
def templates(spark, d):
    ind_ = F.element_at(F.array(F.lit("Computer Storage Devices"), F.lit("Prepackaged Software"), F.lit("Retail")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return V.table(spark, d, "part").select("p_partkey", A.template_of(F.col("p_type"), F.col("p_brand"), ind_).alias("template"))


@register("rep_05_sections", S.sql("securities bars filings", "SELECT ticker, 1 AS section_no, 'price' AS section, CASE WHEN price IS NULL THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS status FROM x UNION ALL SELECT ticker, 2, 'filings', CASE WHEN filings IS NULL THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END FROM x", _REP))
def sections(spark, d):
    p = V.bars(spark, d).groupBy("ticker").agg(F.max("close").alias("price"))
    f = V.filings(spark, d).groupBy("ticker").agg(F.count("*").alias("filings"))
    return A.report_sections(V.securities(spark, d).select("ticker").join(p, "ticker", "left").join(f, "ticker", "left"), ["ticker"], ["price", "filings"])


@register("evt_04_driver_view", S.sql("securities filings facts macro_bars", """SELECT s.ticker, 'c-' || s.sector AS concepts, a.pe AS action_period, """ + r("a.ch", 6) + """ AS action_change, (SELECT count(*) FROM filings f WHERE f.ticker = s.ticker AND filed_at BETWEEN DATE '2000-06-30' - 30 AND DATE '2000-06-30') AS driver_events, mx.trade_date AS macro_date, mx.regime AS macro_regime, mx.severity AS macro_severity FROM securities s LEFT JOIN (SELECT * FROM ctx WHERE trade_date <= DATE '2000-06-30' ORDER BY trade_date DESC LIMIT 1) mx ON true LEFT JOIN
  (SELECT ticker, max(period_end) AS pe, arg_max(ch, period_end) AS ch FROM (SELECT ticker, period_end, (value - lag(value) OVER w) / abs(lag(value) OVER w) AS ch FROM (SELECT * FROM facts WHERE metric_key = 'capitalExpenditure' QUALIFY row_number() OVER (PARTITION BY ticker, period_end ORDER BY filed_at DESC) = 1) WINDOW w AS (PARTITION BY ticker ORDER BY period_end)) GROUP BY 1) a ON a.ticker = s.ticker""", MAC))
def drivers(spark, d):
    c = V.securities(spark, d).select("ticker", F.concat(F.lit("c-"), "sector").alias("concept"))
    a = FU.comparable_series(V.facts(spark, d).where("metric_key = 'capitalExpenditure'").withColumn("period_type", F.lit("quarter")))
    e = V.filings(spark, d).select("ticker", F.col("filed_at").alias("event_date"), F.lit("P3").alias("severity"))
    m = MC.market_context(V.macro_bars(spark, d))
    x = A.driver_view(c, a, e, m, F.lit("2000-06-30").cast("date"))
    return x.select("ticker", "concepts", "action_period", rnd("action_change", 6).alias("action_change"), "driver_events", "macro_date", "macro_regime", "macro_severity")


@register("rep_06_expectation_fields", S.sql("estimates securities", "SELECT ticker, CASE WHEN ticker IN (SELECT ticker FROM estimates WHERE analyst_count >= 3) THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS ntm_eps_status, 'UNAVAILABLE' AS company_guidance, 'UNAVAILABLE' AS revenue_consensus FROM securities"))
def expectations(spark, d):
    e = V.estimates(spark, d).where("analyst_count >= 3").groupBy("ticker").agg(F.max_by("eps_average", F.struct("as_of", "period_end")).alias("eps_value"))
    return A.expectation_fields(V.securities(spark, d).select("ticker").join(e, "ticker", "left")).select("ticker", "ntm_eps_status", "company_guidance", "revenue_consensus")
