"""Advice rows on planted facts: gates, overrides, missing parts; provenance over two snapshots."""
import datetime as dt

from pyspark.sql import functions as F

from marketloom.operators import advice as A, predict as O

DAY = dt.date(2024, 1, 10)
TYPES = {
    "double": "horizon_return close flow_confidence flow_score behavior_confidence behavior_score behavior_reliability intraday_confidence intraday_score event_score evidence_quality static_premium forward_premium static_percentile "
              "forward_percentile revision_30d revision_7d breadth_30d breadth_7d revenue_growth gross_margin peer_gross_margin action_change quantity return_p10 return_p50 probability_up reliability_score",
    "string": "ticker flow_signal stage direction behavior_status intraday_level intraday_signal regime reliability_status", "date": "as_of intraday_date", "int": "horizon action_age", "long": "official_critical unverified_high_risk",
    "boolean": "sell_imbalance"}
SCHEMA = ", ".join(f"{c} {t}" for t, names in TYPES.items() for c in names.split())
COLUMNS = [c for names in TYPES.values() for c in names.split()]
READY = dict(close=100.0, horizon_return=0.04, reliability_status="PUBLISHED", reliability_score=90.0, return_p10=-0.1, return_p50=0.05, probability_up=0.6, quantity=5.0)


def advice(spark, *cases):
    rows = [dict({"horizon": 21, "as_of": DAY, "ticker": f"t{k}"}, **c) for k, c in enumerate(cases)]
    df = spark.createDataFrame([tuple(x.get(c) for c in COLUMNS) for x in rows], SCHEMA)
    return sorted(A.advice_rows(df).collect(), key=lambda x: x["ticker"])


def test_gates_and_overrides(spark):
    ticks = dict(intraday_date=DAY, intraday_level="TICK_DIRECTION", intraday_signal="STRONG_OUTFLOW", intraday_confidence=70.0, intraday_score=-80.0, sell_imbalance=True)
    behavior = dict(stage="DISTRIBUTION", direction="BEARISH", behavior_confidence=70.0, behavior_score=-40.0, behavior_status="PUBLISHED", behavior_reliability=88.0, flow_signal="OUTFLOW", flow_confidence=70.0, flow_score=-20.0)
    full, empty, risk, sold, stale, outflow, weak = advice(
        spark, READY, {}, READY | {"official_critical": 1, "event_score": -75.0, "evidence_quality": 100.0}, READY | ticks, READY | ticks | {"intraday_date": DAY - dt.timedelta(1)},
        READY | behavior, READY | {"reliability_status": "OBSERVE", "horizon_return": -0.03, "quantity": None})
    # one component of weight 0.2: 0.04 of a scale of 0.08; confidence 0.6 * 20 + 0.15 * 50 + 0.25 * 90
    assert (full["action"], full["impact_score"], full["factor_coverage"], full["confidence_score"], full["publication_status"]) == ("HOLD", 50.0, 20.0, 42.0, "PUBLISHED")
    assert (full["target_price"], full["stop_price"], full["formal_ready"]) == (105.0, 90.0, True)
    assert (empty["action"], empty["impact_score"], empty["factor_coverage"], empty["confidence_score"], empty["target_price"]) == ("WATCH", 0.0, 0.0, 7.5, None)
    assert (risk["action"], risk["publication_status"], risk["formal_ready"]) == ("EXIT_RISK_REVIEW", "RISK_OVERRIDE", True)
    assert (sold["action"], sold["publication_status"], sold["formal_ready"], sold["score_intradayFlow"], sold["target_price"]) == ("REDUCE_REVIEW", "OBSERVE", False, -80.0, None)
    assert (stale["action"], stale["score_intradayFlow"]) == ("HOLD", None)  # ticks of another day don't count
    assert (outflow["action"], outflow["score_capitalFlow"], outflow["formal_ready"]) == ("REDUCE_REVIEW", -29.0, False)  # 0.55 * -20 + 0.45 * -40
    assert (weak["action"], weak["impact_score"], weak["stop_price"]) == ("AVOID", -37.5, None)


def test_components_by_horizon(spark):
    case = dict(close=10.0, regime="RATE_HEADWIND", horizon_return=0.15, forward_premium=0.1, static_percentile=20.0, revision_30d=0.02, breadth_30d=0.5, revenue_growth=0.1, gross_margin=0.5, peer_gross_margin=0.4, action_age=100, action_change=0.5)
    day, = advice(spark, case | {"horizon": 63})
    # valuation (-25 + 42) / 2, earnings (20 + 30) / 2, fundamentals (25 + 25) / 2
    assert [day[f"score_{k}"] for k in ("price", "macro", "valuation", "earnings", "fundamentals")] == [100.0, -42.5, 8.5, 25.0, 25.0]
    w = dict(zip(A.COMPONENTS, A.WEIGHTS[63]))
    total = 100 * w["price"] - 42.5 * w["macro"] + 8.5 * w["valuation"] + 25 * (w["earnings"] + w["fundamentals"])
    weight = sum(w[k] for k in ("price", "macro", "valuation", "earnings", "fundamentals"))
    assert abs(day["impact_score"] - (total / weight + 25)) < 0.006 and day["factor_coverage"] == round(weight * 100, 2)  # the adjustment is 15 + 20 * 0.5


def test_evidence_changes(spark):
    f = spark.createDataFrame([("a", dt.date(2024, 1, k), 30 + k, 0.1 if k > 1 else None, "DAILY_BARS" if k > 1 else None, dt.date(2023, 12, k), "complete", dt.date(2023, 9, 30), dt.date(2023, 11, 1), k if k > 1 else None, 1, 0, 1) for k in (1, 2)],
                              "ticker string, trade_date date, sample_size int, behavior_score double, behavior_data_level string, estimate_as_of date, estimate_quality string, fiscal_period_end date, statement_filed_at date, events_30d long, direct_events_30d long, proxy_events_30d long, official_risk_30d long")
    p = spark.createDataFrame([("a", dt.date(2024, 1, k), h, 60.0 + 5 * k, 80.0 - k) for k in (1, 2) for h in (21, 63)], "ticker string, trade_date date, horizon int, quality_score double, factor_coverage double")
    rows = O.evidence_changes(p, f).orderBy("horizon").collect()
    assert [(x["horizon"], x["previous_date"], x["quality_delta"], x["coverage_delta"]) for x in rows] == [(h, dt.date(2024, 1, 1), 5.0, -1.0) for h in (21, 63)]
    new, old = rows[0]["current_evidence"], rows[0]["previous_evidence"]
    assert (new["capital"]["as_of"], old["capital"]["as_of"], new["events"]["total"], old["events"]["total"]) == (dt.date(2024, 1, 2), None, 2, 0)
    assert O.evidence_changes(p.where(F.lit(False)), f).count() == 0
