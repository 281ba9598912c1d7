"""Advice scoring and decisions, publication rules, theses, peers and concepts, reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.functions.scalar import available_weight, clamp, ratio, rnd, row_mean, weighted_mean

# Component weights per horizon.
COMPONENTS = ("price", "capitalFlow", "intradayFlow", "events", "macro", "valuation", "earnings", "fundamentals")
WEIGHTS = {21: (0.20, 0.16, 0.10, 0.20, 0.12, 0.08, 0.08, 0.06), 63: (0.11, 0.10, 0.06, 0.17, 0.13, 0.18, 0.18, 0.07), 126: (0.08, 0.06, 0.03, 0.14, 0.14, 0.24, 0.19, 0.12)}
SCALES = {21: 0.08, 63: 0.15, 126: 0.25}
MACRO_MULTIPLIER = {21: 1.0, 63: 0.85, 126: 0.7}


def price_score(horizon_return: Column, horizon: int) -> Column:
    return rnd(clamp(horizon_return / SCALES[horizon] * 100, -100, 100), 2)


def valuation_score(premiums: list[Column], percentiles: list[Column]) -> Column:
    return rnd(row_mean([clamp(-p * 250, -70, 70) for p in premiums] + [clamp((50 - p) * 1.4, -70, 70) for p in percentiles]), 2)


def earnings_score(change30: Column, change7: Column, breadth30: Column, breadth7: Column) -> Column:
    return rnd(row_mean([clamp(change30 * 1000, -80, 80), clamp(change7 * 1200, -80, 80), breadth30 * 60, breadth7 * 50]), 2)


def fundamentals_score(growth: Column, margin: Column, peer_margin: Column) -> Column:
    return rnd(row_mean([clamp(growth * 250, -75, 75), clamp((margin - peer_margin) * 250, -75, 75)]), 2)


def macro_score(regime: Column, horizon: int) -> Column:
    base = F.when(regime == "RATE_HEADWIND", -50.0).when(regime == "RATE_TAILWIND", 50.0).when(regime.isin("MIXED", "NEUTRAL"), 0.0)
    return rnd(base * MACRO_MULTIPLIER[horizon], 2)


def corporate_action_adjustment(age_days: Column, change_pct: Column) -> Column:
    return F.when(age_days.between(0, 370), F.coalesce(clamp(15 + change_pct * 20, 0, 30), F.lit(10.0)))


def weighted_impact(components: dict[str, Column], horizon: int, adjustment: Column | None = None) -> tuple[Column, Column]:
    """(score, coverage): mean renormalised over the present components, plus the adjustment."""
    return _impact([(components[k], w) for k, w in zip(COMPONENTS, WEIGHTS[horizon])], adjustment)


def _impact(parts: list[tuple[Column, Column | float]], adjustment: Column | None) -> tuple[Column, Column]:
    cover = available_weight(parts)
    adj = F.lit(0.0) if adjustment is None else F.coalesce(adjustment, F.lit(0.0))
    return F.coalesce(rnd(clamp(weighted_mean(parts) + adj, -100, 100), 2), F.lit(0.0)), rnd(cover * 100, 2)


def flow_gate(stage: Column, confidence: Column, direction: Column, status: Column, reliability: Column, gate: float = 85.0) -> Column:
    """Continuous-flow evidence counts only when confident, directional and validated."""
    return (stage != "INSUFFICIENT") & (confidence >= 60) & (direction != "NEUTRAL") & (status == "PUBLISHED") & (reliability >= gate)


def blended_flow(daily: Column, behavior: Column, gated: Column) -> Column:
    return F.when(gated, daily * 0.55 + behavior * 0.45).otherwise(daily)


def decide(score: Column, has_position: Column, official_critical: Column, tactical_outflow: Column, validated_outflow: Column, formal_ready: Column, unverified_risk: Column,
           return_p50: Column, probability_up: Column, confidence: Column) -> Column:
    """Ordered decision table -> (action, publication status)."""
    f = lambda c: F.coalesce(c, F.lit(False))
    act = lambda held, free, status: F.struct(F.when(has_position, held).otherwise(free).alias("action"), F.lit(status).alias("publication_status"))
    ready = f(formal_ready)
    return (F.when(f(official_critical), act("EXIT_RISK_REVIEW", "AVOID", "RISK_OVERRIDE"))
            .when(f(tactical_outflow) | f(validated_outflow), act("REDUCE_REVIEW", "AVOID", "OBSERVE"))
            .when(~ready & (f(unverified_risk) | (score <= -35)), act("EXIT_RISK_REVIEW", "AVOID", "OBSERVE"))
            .when(~ready & (score <= -20), act("REDUCE_REVIEW", "AVOID", "OBSERVE")).when(~ready, act("HOLD_REVIEW", "WATCH", "OBSERVE"))
            .when((score >= 20) & (return_p50 >= 0.03) & (probability_up >= 0.55) & (confidence >= 60), act("ADD_CANDIDATE", "BUY_CANDIDATE", "PUBLISHED"))
            .when((score <= -20) | (return_p50 <= -0.03) | (probability_up <= 0.45), act("REDUCE_CANDIDATE", "AVOID", "PUBLISHED")).otherwise(act("HOLD", "WATCH", "PUBLISHED")))


def advice_rows(rows: DataFrame, gate: float = 85.0) -> DataFrame:
    """Action, stance, impact, confidence, prices and component scores of every (ticker, as_of, horizon) row.

    ``rows`` holds what was known at ``as_of``: ``horizon_return, close``; ``flow_signal, flow_confidence, flow_score``; ``stage,
    direction, behavior_confidence, behavior_score, behavior_status, behavior_reliability``; ``intraday_date, intraday_level, intraday_signal,
    intraday_confidence, intraday_score, sell_imbalance``; ``event_score, evidence_quality, official_critical, unverified_high_risk``; ``regime``;
    ``static_premium, forward_premium, static_percentile, forward_percentile``; ``revision_30d, revision_7d, breadth_30d, breadth_7d``;
    ``revenue_growth, gross_margin, peer_gross_margin``; ``action_age, action_change``; ``quantity``; ``return_p10, return_p50,
    probability_up, reliability_score, reliability_status``. A component without its inputs is null and leaves its weight to the others.
    """
    c = F.col
    at = lambda f: F.coalesce(*[F.when(c("horizon") == h, f(h)) for h in WEIGHTS])
    false = lambda x: F.coalesce(x, F.lit(False))
    gated = false(flow_gate(c("stage"), c("behavior_confidence"), c("direction"), c("behavior_status"), c("behavior_reliability"), gate))
    intraday = false((c("intraday_date") == c("as_of")) & (c("intraday_level") == "TICK_DIRECTION") & (c("intraday_confidence") >= 55))
    d = rows.withColumns({
        "_gated": gated, "_intraday": intraday,
        "score_price": rnd(clamp(c("horizon_return") / at(lambda h: F.lit(SCALES[h])) * 100, -100, 100), 2),
        "score_capitalFlow": F.when((c("flow_signal") != "INSUFFICIENT") & (c("flow_confidence") >= 60), rnd(blended_flow(c("flow_score"), c("behavior_score"), gated), 2)),
        "score_intradayFlow": F.when(intraday, c("intraday_score")), "score_events": rnd("event_score", 2), "score_macro": rnd(macro_score(c("regime"), 21) * at(lambda h: F.lit(MACRO_MULTIPLIER[h])), 2),  # the multiplier of 21 sessions is 1
        "score_valuation": valuation_score([c("forward_premium"), c("static_premium")], [c("forward_percentile"), c("static_percentile")]),
        "score_earnings": earnings_score(c("revision_30d"), c("revision_7d"), c("breadth_30d"), c("breadth_7d")),
        "score_fundamentals": fundamentals_score(c("revenue_growth"), c("gross_margin"), c("peer_gross_margin"))})
    parts = [(c(f"score_{k}"), at(lambda h, i=i: F.lit(WEIGHTS[h][i]))) for i, k in enumerate(COMPONENTS)]
    impact, cover = _impact(parts, corporate_action_adjustment(c("action_age"), c("action_change")))
    d = d.withColumns({"impact_score": impact, "factor_coverage": cover})
    d = d.withColumn("impact_score", F.when(c("factor_coverage") > 0, c("impact_score")).otherwise(0.0))
    confidence = rnd(clamp(c("factor_coverage") * 0.6 + F.coalesce(rnd("evidence_quality", 2), F.lit(50.0)) * 0.15 + F.coalesce("reliability_score", F.lit(0.0)) * 0.25, 0, 100), 2)
    critical = false(c("official_critical") > 0)
    tactical = c("_intraday") & false((c("intraday_signal") == "STRONG_OUTFLOW") & (c("intraday_confidence") >= 60) & c("sell_imbalance"))
    outflow = c("_gated") & (c("direction") == "BEARISH") & (c("behavior_score") <= -20)
    formal = false((c("reliability_status") == "PUBLISHED") & (c("reliability_score") >= gate) & c("return_p50").isNotNull() & c("probability_up").isNotNull())
    d = d.withColumns({"confidence_score": confidence, "stance": F.when(c("impact_score") >= 20, "BULLISH").when(c("impact_score") <= -20, "BEARISH").otherwise("NEUTRAL"), "_formal": formal})
    d = d.withColumn("_d", decide(c("impact_score"), false(c("quantity") > 0), critical, tactical, outflow, c("_formal"), c("unverified_high_risk") > 0, c("return_p50"), c("probability_up"), c("confidence_score")))
    d = d.withColumn("formal_ready", c("_formal") & (critical | ~(tactical | outflow)))
    low = c("close") * (1 + c("return_p10"))
    return d.select(
        "ticker", "as_of", "horizon", "_d.action", "stance", "impact_score", "confidence_score", "factor_coverage", "_d.publication_status", "formal_ready", c("close").alias("current_price"),
        F.when(c("formal_ready"), rnd(c("close") * (1 + c("return_p50")), 4)).alias("target_price"), F.when(c("formal_ready") & (low < c("close")), rnd(low, 4)).alias("stop_price"),
        *[f"score_{k}" for k in COMPONENTS])


def publication_safe(df: DataFrame, status: str, values: list[str]) -> DataFrame:
    """Null the value columns of unpublished rows and list what was redacted."""
    ok = F.col(status) == "PUBLISHED"
    red = F.when(~ok, F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in values]))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("redacted", red).withColumns({c: F.when(ok, F.col(c)) for c in values})


def thesis_status(revision30: Column, margin_change: Column, official_risk: Column) -> Column:
    """Falsified by an official risk, strengthened or weakened by revisions (2 %) and margins (1 point)."""
    up, down = (revision30 >= 0.02) | (margin_change >= 0.01), (revision30 <= -0.02) | (margin_change <= -0.01)
    return (F.when(official_risk, "FALSIFIED").when(down, "WEAKENED").when(up, "STRENGTHENED").otherwise("PENDING"))


def choose_peers(candidates: DataFrame, limit: int = 2) -> DataFrame:
    """Peers per ticker by rule priority (ticker rule, industry code, text), self excluded."""
    d = candidates.where("ticker <> related_ticker").groupBy("ticker", "related_ticker").agg(F.min("priority").alias("priority"))
    w = Window.partitionBy("ticker").orderBy("priority", "related_ticker")
    return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def update_relations(current: DataFrame, chosen: DataFrame, as_of: Column) -> DataFrame:
    """SCD2 update: relations no longer chosen are closed, new ones opened, others untouched."""
    key = ["ticker", "related_ticker"]
    open_, closed = current.where("active_to IS NULL"), current.where("active_to IS NOT NULL")
    j = open_.join(chosen.select(*key).withColumn("_c", F.lit(True)), key, "full_outer")
    return closed.unionByName(j.select(*key, F.coalesce("active_from", as_of).alias("active_from"), F.when(F.col("_c").isNull(), F.date_sub(as_of, 1)).alias("active_to")))


def assign_concepts(securities: DataFrame, specific: DataFrame, generic: DataFrame, industry: str) -> DataFrame:
    """Specific concepts of a ticker where they exist, else the generic ones of its industry."""
    s = securities.join(specific, "ticker").select("ticker", "concept", F.lit("SPECIFIC").alias("source"))
    g = securities.join(specific.select("ticker"), "ticker", "left_anti").join(generic, industry).select("ticker", "concept", F.lit("GENERIC").alias("source"))
    return s.unionByName(g)


def report_quality(parts: DataFrame, columns: list[str]) -> DataFrame:
    """Completeness status and the list of missing parts of a cross-source report row."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return parts.withColumn("issues", missing).withColumn("report_status", F.when(F.size("issues") == 0, "COMPLETE").when(F.size("issues") == len(columns), "UNAVAILABLE").otherwise("PARTIAL"))


def tree_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Changed, added and removed paths of two flattened versions."""
    j = before.select(*keys, "path", F.col("leaf").alias("old")).join(after.select(*keys, "path", F.col("leaf").alias("new")), [*keys, "path"], "full_outer")
    j = j.where(~F.col("old").eqNullSafe(F.col("new")))
    return j.withColumn("change", F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").otherwise("CHANGED"))


# What a report's paths begin with -> the category of a change there; other paths are REPORT_META.
REPORT_CATEGORIES = {"report.analysisPrice": "PRICE", "report.priceDate": "PRICE", "operating": "OPERATING", "expectations": "EXPECTATION", "valuation": "VALUATION",
                     "theses": "THESIS", "predictions": "PREDICTION", "events": "EVENT", "evidence": "EVIDENCE"}


def report_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``tree_diff`` of two report versions with the category of each change, its type and whether it is material."""
    p = F.regexp_replace("path", r"^\$\.", "")
    category = F.coalesce(*[F.when(p.startswith(k), v) for k, v in REPORT_CATEGORIES.items()], F.lit("REPORT_META"))
    kind = F.when(p == "report.asOf", "ROLLING_DATE").when(p.contains("Version"), "RULE_OR_MODEL_CHANGE").otherwise("NEW_INFORMATION_OR_CORRECTION")
    d = tree_diff(before, after, keys).withColumns({"category": category, "change_type": kind})
    return d.withColumn("material", F.col("category") != "REPORT_META")


def diff_summary(diff: DataFrame, keys: list[str]) -> DataFrame:
    """Changes, material changes and changes by category of each pair of versions; warnings if the schema or the template changed."""
    changed = lambda name: F.bool_or(F.col("path") == f"$.report.{name}")
    return diff.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("changes"), F.count_if("material").alias("material_changes"),
        *[F.count_if(F.col("category") == c).alias(c.lower()) for c in dict.fromkeys([*REPORT_CATEGORIES.values(), "REPORT_META"])],
        F.array_compact(F.array(F.when(changed("schemaVersion"), "SCHEMA_CHANGED"), F.when(changed("templateVersion"), "TEMPLATE_CHANGED"))).alias("warnings"))


def numbered_evidence(filings: DataFrame, events: DataFrame, per: str) -> DataFrame:
    """Filings and events of an entity merged by date and numbered."""
    cols = [per, "day", "kind", "ref"]
    u = filings.select(*cols).unionByName(events.select(*cols))
    w = Window.partitionBy(per, "day").orderBy("kind", "ref")
    return u.withColumn("evidence_id", F.format_string("E%s-%03d", F.date_format("day", "yyyyMMdd"), F.row_number().over(w)))


# Event-type pattern -> (exposure, affected variable), template patterns.
CHAINS = [("BUYBACK", "SHARE_COUNT", "EPS_AND_VALUATION"), ("CAPACITY|PRODUCTION", "CAPACITY_AND_UNIT_COST", "REVENUE_MARGIN_CAPEX"), ("INVESTMENT|CAPEX", "CAPEX_AND_CASH", "DEPRECIATION_AND_FCF"),
          ("SUPPLY|CUSTOMER|CONTRACT", "ORDERS_AND_CUSTOMERS", "VOLUME_PRICE_REVENUE"), ("GUIDANCE|EARNINGS", "GUIDANCE_AND_EXPECTATIONS", "EPS_ESTIMATES"), ("RATE|TREASURY|FED", "RISK_FREE_RATE", "MULTIPLE_AND_FINANCING")]
TEMPLATES = [("semiconductor|memory|storage", "SEMICONDUCTOR_CYCLE"), ("technology|software|communications|electronic|computer", "TECHNOLOGY_COMPETITION")]


def thesis_direction(explicit: Column, source_type: Column, event_type: Column, severity: Column) -> Column:
    """The tagged direction, else negative for risk types and severe events, else mixed."""
    kind = F.upper(F.concat_ws(" ", source_type, event_type))
    return (F.when(explicit.isin("POSITIVE", "NEGATIVE", "MIXED"), explicit)
            .when(kind.rlike("NEWS_RISK|CUSTOMER_LOSS|GUIDANCE_CUT|CAPACITY_CUT|BUYBACK_STOP") | severity.isin("P0", "P1"), "NEGATIVE").otherwise("MIXED"))


def transmission(event_type: Column, title: Column) -> Column:
    """(exposure, variable) an event acts through, by the first matching pattern."""
    t = F.upper(F.concat_ws(" ", event_type, title))
    pair = lambda a, b: F.struct(F.lit(a).alias("exposure"), F.lit(b).alias("variable"))
    return F.coalesce(*[F.when(t.rlike(p), pair(a, b)) for p, a, b in CHAINS], pair("OTHER", "RESULTS_OR_ASSUMPTIONS"))


def template_of(*texts: Column) -> Column:
    """Analysis template by the company's sector, industry and description text."""
    t = F.lower(F.concat_ws(" ", *texts))
    return F.coalesce(*[F.when(t.rlike(p), F.lit(k)) for p, k in TEMPLATES], F.lit("GENERAL_FINANCIAL"))


def report_sections(row: DataFrame, keys: list[str], sections: list[str]) -> DataFrame:
    """One row per report section with its availability."""
    s = F.array(*[F.struct(F.lit(i + 1).alias("section_no"), F.lit(c).alias("section"), F.when(F.col(c).isNull(), "UNAVAILABLE").otherwise("AVAILABLE").alias("status")) for i, c in enumerate(sections)])
    return row.select(*keys, F.explode(s).alias("s")).select(*keys, "s.*")


def expectation_fields(valuations: DataFrame) -> DataFrame:
    """Expectation fields of a report: what is not known is stated, never filled."""
    known = lambda c: F.when(F.col(c).isNull(), "UNAVAILABLE").otherwise("AVAILABLE")
    return valuations.withColumns({"ntm_eps_status": known("eps_value"), "actual_vs_consensus": F.lit("UNAVAILABLE"), "company_guidance": F.lit("UNAVAILABLE"), "revenue_consensus": F.lit("UNAVAILABLE")})


def driver_view(concepts: DataFrame, actions: DataFrame, events: DataFrame, macro: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """External drivers per ticker: concepts, latest corporate action, the window's driver events and the last macro row.

    ``macro``: ``trade_date, regime, severity``, one row a date; its last row up to ``as_of`` is the same for every ticker.
    """
    e = events.where(F.col("event_date").between(F.date_sub(as_of, days), as_of)).groupBy("ticker").agg(
        F.count("*").alias("driver_events"), F.count_if(F.col("severity").isin("P0", "P1")).alias("severe_events"))
    c = concepts.groupBy("ticker").agg(F.array_join(F.array_sort(F.collect_set("concept")), ",").alias("concepts"))
    a = actions.groupBy("ticker").agg(F.max("period_end").alias("action_period"), F.max_by("change_pct", "period_end").alias("action_change"))
    m = macro.where(F.col("trade_date") <= as_of).agg(F.max_by(F.struct(F.col("trade_date").alias("macro_date"), F.col("regime").alias("macro_regime"), F.col("severity").alias("macro_severity")), "trade_date").alias("_m"))
    d = c.join(a, "ticker", "full_outer").join(e, "ticker", "full_outer").fillna(0, ["driver_events", "severe_events"])
    # an aggregate without keys is one row, null if there is no macro row yet
    return d.withColumn("_k", F.lit(1)).join(F.broadcast(m.select(F.lit(1).alias("_k"), "_m.*")), "_k", "left").drop("_k")
