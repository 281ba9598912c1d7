"""Point-in-time features, baseline predictions, maturity, reliability and change attribution for all
(ticker, date, horizon) rows in one plan."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.functions.scalar import available_weight, clamp, direction, ratio, rnd, row_mean, weighted_mean
from marketloom.operators.asof import asof_join
from marketloom.operators.series import every_nth, over, returns, trailing

# Horizon -> scale and factor weights; reliability weights and sample minima.
FACTORS = ("momentum", "relativeStrength", "capitalFlow", "valuation", "earnings", "fundamentals", "macro", "events")
HORIZONS = {21: (0.08, (0.32, 0.14, 0.20, 0.06, 0.08, 0.04, 0.07, 0.09)),
            63: (0.15, (0.22, 0.10, 0.12, 0.18, 0.15, 0.08, 0.08, 0.07)),
            126: (0.25, (0.17, 0.07, 0.07, 0.23, 0.17, 0.14, 0.09, 0.06))}
RELIABILITY_WEIGHTS = {"direction_accuracy": 0.30, "probability_calibration": 0.15, "interval_coverage": 0.15,
                       "benchmark_skill": 0.15, "regime_stability": 0.15, "data_quality": 0.10}
MACRO_SIGNAL = {"RATE_HEADWIND": -0.6, "RATE_TAILWIND": 0.6, "MIXED": 0.0, "NEUTRAL": 0.0}


def price_features(bars: DataFrame) -> DataFrame:
    w = over()
    d = bars.withColumn("_r", returns("close", 1, w))
    f20 = trailing(20, w)
    return d.select(
        "ticker", "trade_date", "close", F.row_number().over(w).alias("sample_size"),
        *[rnd(returns("close", n, w), 6).alias(f"return_{n}d") for n in (5, 21, 63, 126)],
        rnd(F.stddev_samp("_r").over(f20), 6).alias("volatility_20d"), rnd(F.col("close") / F.avg("close").over(f20) - 1, 6).alias("ma_gap_20d"),
        rnd(ratio("volume", F.avg("volume").over(f20)), 4).alias("relative_volume_20d"))


def benchmark_features(rows: DataFrame, benchmark: DataFrame, prefix: str) -> DataFrame:
    """Returns of the benchmark's last bar on or before each date (one series, joined by date)."""
    b = price_features(benchmark).select(F.lit(1).alias("_k"), "trade_date", F.col("close").alias(f"{prefix}_close"), F.col("volatility_20d").alias(f"{prefix}_volatility"), *[F.col(f"return_{n}d").alias(f"{prefix}_{n}d") for n in (21, 63, 126)])
    dates = rows.select("trade_date").distinct().withColumn("_k", F.lit(1))
    at = asof_join(dates, b, ["_k"], "trade_date", "trade_date", [c for c in b.columns if c not in ("_k", "trade_date")]).drop("_k")
    return rows.join(F.broadcast(at), "trade_date", "left")  # one row per session date


def data_quality(f: DataFrame) -> DataFrame:
    """Quality score, eligibility for validation and the reasons against it."""
    n = F.col("sample_size")
    price = F.when(n >= 127, 30).when(n >= 64, 28).when(n >= 22, 26).otherwise(0)
    points = {"has_benchmark": 6, "has_industry": 4, "has_flow": 9, "has_behavior": 5, "has_valuation": 10, "has_peers": 6,
              "has_earnings": 9, "has_fundamentals": 8, "has_cash_flow": 5, "has_macro": 5, "has_events": 3}
    have = [F.when(F.col(c), p).otherwise(0) if c in f.columns else F.lit(0) for c, p in points.items()]
    d = f.withColumn("quality_score", sum(have, price).cast("double"))
    reasons = F.array_compact(F.array(F.when(F.col("close").isNull(), "NO_PRICE"), F.when(n < 22, "SHORT_HISTORY")))
    return d.withColumns({"exclusion_reasons": reasons, "eligible": (F.size(reasons) == 0) & (F.col("quality_score") >= 35)})


def predict(features: DataFrame) -> DataFrame:
    """Three horizons per feature row: factor signals, shrunk expected return, interval, probability, contributions."""
    w = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(s).alias("scale"), *[F.lit(x).alias(f"w_{n}") for n, x in zip(FACTORS, ws)]) for h, (s, ws) in HORIZONS.items()])
    d = features.withColumn("_h", F.explode(w)).select(*features.columns, "_h.*")
    pick = lambda cols: F.coalesce(*[F.when(F.col("horizon") == h, c) for h, c in zip(HORIZONS, cols)])
    r = {n: F.col(f"return_{n}d") for n in (5, 21, 63, 126)}
    moment = pick([row_mean([r[5], r[21]]), row_mean([r[21], r[63]]), row_mean([r[63], r[126]])])
    own, market = pick([r[21], r[63], r[126]]), pick([F.col("market_21d"), F.col("market_63d"), F.col("market_126d")])
    pe = lambda c: F.when(F.col(c) > 0, clamp((30 - F.col(c)) / 35, -1, 1))
    macro = F.coalesce(*[F.when(F.col("regime") == k, F.lit(v)) for k, v in MACRO_SIGNAL.items()])
    sig = {"momentum": clamp(moment / F.col("scale"), -1, 1), "relativeStrength": clamp((own - market) / F.col("scale"), -1, 1), "capitalFlow": F.col("flow_score"),
           "valuation": row_mean([pe("forward_pe"), pe("static_pe")]), "earnings": clamp(F.col("eps_revision") / 0.05, -1, 1),
           "fundamentals": row_mean([clamp(F.col("revenue_growth") / 0.30, -1, 1), clamp((F.col("gross_margin") - 0.35) / 0.30, -1, 1)]), "macro": macro, "events": F.col("event_score")}
    d = d.withColumns({f"s_{k}": v for k, v in sig.items()})
    total = sum((F.coalesce(F.col(f"s_{k}") * F.col(f"w_{k}"), F.lit(0.0)) for k in FACTORS), F.lit(0.0))
    cover = sum((F.when(F.col(f"s_{k}").isNotNull(), F.col(f"w_{k}")).otherwise(F.lit(0.0)) for k in FACTORS), F.lit(0.0))
    d = d.withColumn("coverage", cover).withColumn("raw", F.when(F.col("coverage") > 0, clamp(total / F.col("coverage"), -1, 1)).otherwise(0.0))
    shrink = F.greatest(F.lit(0.35), F.col("quality_score") / 100)
    d = d.withColumn("expected", clamp(F.col("raw") * F.col("scale") * shrink, -0.8, 2))
    vol = F.coalesce(F.col("volatility_20d") * F.sqrt("horizon"), F.col("scale"))
    half = F.greatest(F.col("scale") * 0.55, vol * 1.28)
    return d.select(
        "ticker", "trade_date", "horizon", "close", "quality_score", "eligible", "market_close", rnd(F.col("raw") * 100, 2).alias("signal_score"), rnd(F.col("coverage") * 100, 2).alias("factor_coverage"),
        rnd(clamp(F.col("expected") - half, -0.95, 3), 6).alias("return_p10"), rnd("expected", 6).alias("return_p50"), rnd(clamp(F.col("expected") + half, -0.95, 3), 6).alias("return_p90"),
        rnd(clamp(0.5 + F.col("raw") * 0.35, 0.05, 0.95), 4).alias("probability_up"), direction("expected").alias("predicted_direction"),
        *[rnd(F.col(f"s_{k}") * F.col(f"w_{k}") / F.col("coverage") * F.col("scale") * shrink, 8).alias(f"c_{k}") for k in FACTORS])


def evaluate(pred: DataFrame) -> DataFrame:
    """Outcome of every prediction: actual, benchmark and excess return, hits, status.

    The target is the session ``horizon`` rows ahead; each horizon has one row per session, so a
    lead inside (ticker, horizon) finds it without a join.
    """
    w = Window.partitionBy("ticker", "horizon").orderBy("trade_date")
    at = lambda c: F.coalesce(*[F.when(F.col("horizon") == h, F.lead(c, h).over(w)) for h in HORIZONS])
    d = pred.withColumns({"_d": at("trade_date"), "_c": at("close"), "_m": at("market_close")})
    matured = F.col("eligible") & F.col("_d").isNotNull()
    actual, bench = F.col("_c") / F.col("close") - 1, F.col("_m") / F.col("market_close") - 1
    when = lambda c: F.when(matured, c)
    return d.withColumns({
        "status": F.when(~F.col("eligible"), "EXCLUDED").when(F.col("_d").isNull(), "PENDING").otherwise("MATURED"),
        "actual_date": when(F.col("_d")), "actual_return": when(rnd(actual, 6)), "benchmark_return": when(rnd(bench, 6)), "excess_return": when(rnd(actual - bench, 6)),
        "direction_hit": when(F.col("predicted_direction") == direction(actual)), "interval_hit": when(actual.between(F.col("return_p10"), F.col("return_p90")))}).drop("_d", "_c", "_m")


def reliability_components(ev: DataFrame, keys: tuple[str, ...] = ("ticker", "horizon")) -> DataFrame:
    """Reliability components on every horizon-th matured prediction."""
    k = list(keys)
    m = ev.where("status = 'MATURED'")
    raw = m.groupBy(*k).agg(F.count("*").alias("raw_samples"))
    s = every_nth(m, k, "trade_date", F.col("horizon"))
    hit, actual, p50 = F.col("direction_hit").cast("double"), F.col("actual_return"), F.col("return_p50")
    up = (actual > 0).cast("double")
    b = F.col("benchmark_return")
    g = s.groupBy(*k).agg(
        F.count("*").alias("effective_samples"), F.avg(hit).alias("_acc"), F.avg(F.pow(F.col("probability_up") - up, 2)).alias("_brier"), F.avg(F.col("interval_hit").cast("double")).alias("_cov"),
        F.avg(F.abs(actual - p50)).alias("_mae"), F.avg(F.abs(actual)).alias("_zero"), F.avg(F.abs(actual - b)).alias("_bm"),
        F.avg(F.when(b >= 0, hit)).alias("_hp"), F.avg(F.when(b < 0, hit)).alias("_hn"), F.count_if(b >= 0).alias("_np"), F.count_if(b < 0).alias("_nn"), F.avg("quality_score").alias("_q"))
    base = F.least(F.when(F.col("_zero") > 0, F.col("_zero")), F.when(F.col("_bm") > 0, F.col("_bm")))
    skill = F.coalesce(1 - F.col("_mae") / base, F.lit(0.0))
    stab = F.when((F.col("_np") >= 2) & (F.col("_nn") >= 2), 1 - F.abs(F.col("_hp") - F.col("_hn"))).otherwise(0.5)
    pct = lambda c: rnd(clamp(c, 0, 1) * 100, 2)
    return raw.join(g, k).select(
        *k, "raw_samples", "effective_samples", rnd(F.col("_acc") * 100, 2).alias("direction_accuracy"), pct(1 - F.coalesce("_brier", F.lit(0.25)) / 0.25).alias("probability_calibration"),
        pct(1 - F.abs(F.col("_cov") - 0.8) * 2).alias("interval_coverage"), pct(0.5 + skill * 0.5).alias("benchmark_skill"), pct(stab).alias("regime_stability"), rnd("_q", 2).alias("data_quality"),
        rnd("_mae", 6).alias("model_mae"))


def composite_reliability(c: DataFrame, gate: float = 85.0) -> DataFrame:
    """Weighted composite and publication status by sample minimum and gate."""
    score = sum((F.col(k) * w for k, w in RELIABILITY_WEIGHTS.items()), F.lit(0.0))
    need = F.when(F.col("horizon") <= 21, 60).when(F.col("horizon") <= 63, 32).otherwise(16)
    d = c.withColumns({"required_samples": need, "_s": score})
    return d.withColumns({"composite_score": rnd("_s", 2), "status": F.when(F.col("effective_samples") < F.col("required_samples"), "INSUFFICIENT")
                          .when(F.col("_s") >= gate, "PUBLISHED").when(F.col("_s") >= gate - 10, "OBSERVE").otherwise("REJECTED")}).drop("_s")


def model_choice(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Both models' figures per (ticker, horizon); the candidate is promoted only with enough samples, +3 points and 3 % less error."""
    b = baseline.select("ticker", "horizon", F.col("composite_score").alias("baseline_score"), F.col("model_mae").alias("baseline_mae"))
    c = candidate.select("ticker", "horizon", F.col("composite_score").alias("candidate_score"), F.col("model_mae").alias("candidate_mae"), "effective_samples", "required_samples")
    better = ((F.col("effective_samples") >= F.col("required_samples")) & (F.col("candidate_score") >= F.col("baseline_score") + 3)
              & (F.col("candidate_mae") <= F.col("baseline_mae") * 0.97))
    return c.join(b, ["ticker", "horizon"]).withColumn("decision", F.when(better, "PROMOTE_CANDIDATE").otherwise("KEEP_BASELINE"))


def prediction_changes(pred: DataFrame) -> DataFrame:
    """Change of each prediction against the previous one of its horizon, attributed to factors and price."""
    w = Window.partitionBy("ticker", "horizon").orderBy("trade_date")
    prev = lambda c: F.lag(c).over(w)
    d = pred.withColumns({f"d_{k}": rnd(F.coalesce(f"c_{k}", F.lit(0.0)) - F.coalesce(prev(f"c_{k}"), F.lit(0.0)), 8) for k in FACTORS})
    d = d.withColumns({"previous_date": prev("trade_date"), "_r": F.col("return_p50") - prev("return_p50"), "_p": F.col("probability_up") - prev("probability_up"),
                       "_pd": prev("predicted_direction"), "_pc": prev("close"), "_pr": prev("return_p50")}).where("previous_date IS NOT NULL")
    kind = (F.when(F.col("_pd") != F.col("predicted_direction"), "DIRECTION_CHANGE").when((F.abs("_r") >= 0.02) | (F.abs("_p") >= 0.05), "MATERIAL_CHANGE")
            .when(F.abs("_r") >= 0.005, "MODERATE_CHANGE").otherwise("STABLE"))
    explained = sum((F.col(f"d_{k}") for k in FACTORS), F.lit(0.0))
    drivers = F.array(*[F.struct((-F.abs(f"d_{k}")).alias("a"), F.lit(i).alias("i"), F.lit(k).alias("key")) for i, k in enumerate(FACTORS)])
    top = F.slice(F.array_sort(F.filter(drivers, lambda x: x["a"] <= -0.00005)), 1, 3)
    return d.select("ticker", "trade_date", "horizon", "previous_date", rnd("_r", 8).alias("return_change"), kind.alias("change_type"),
                    rnd((F.col("close") - F.col("_pc")) * (1 + F.col("_pr")), 4).alias("market_price_effect"), rnd(F.col("close") * F.col("_r"), 4).alias("outlook_effect"),
                    rnd(F.col("_r") - explained, 8).alias("residual"), F.array_join(F.transform(top, lambda x: x["key"]), ",").alias("drivers"), *[f"d_{k}" for k in FACTORS])


def provenance(features: DataFrame) -> DataFrame:
    """For each snapshot one struct a feature group: dates, data levels, statuses and counts. Without events their counts are 0."""
    counts = {"total": "events_30d", "direct": "direct_events_30d", "proxy": "proxy_events_30d", "official_high_risk": "official_risk_30d"}
    return features.select(
        "ticker", "trade_date", F.struct(F.col("trade_date").alias("price_date"), F.col("sample_size").alias("sessions")).alias("price"),
        F.struct(F.when(F.col("behavior_score").isNotNull(), F.col("trade_date")).alias("as_of"), F.col("behavior_data_level").alias("data_level")).alias("capital"),
        F.struct(F.col("estimate_as_of").alias("as_of"), F.col("estimate_quality").alias("quality_status")).alias("earnings"),
        F.struct(F.col("fiscal_period_end").alias("period_end"), F.col("statement_filed_at").alias("filed_at")).alias("fundamentals"),
        F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(n) for n, c in counts.items()]).alias("events"))


def evidence_changes(pred: DataFrame, features: DataFrame) -> DataFrame:
    """Each prediction against the previous one of its horizon: provenance of both snapshots, change of data quality and of factor coverage.

    A snapshot's provenance is joined once and carried over by a lag, so there is one join on the key of both tables.
    """
    w = Window.partitionBy("ticker", "horizon").orderBy("trade_date")
    groups = ["price", "capital", "earnings", "fundamentals", "events"]
    d = pred.select("ticker", "trade_date", "horizon", "quality_score", "factor_coverage").join(
        provenance(features).select("ticker", "trade_date", F.struct(*groups).alias("current_evidence")), ["ticker", "trade_date"])
    prev = lambda c: F.lag(c).over(w)
    d = d.withColumns({"previous_date": prev("trade_date"), "previous_evidence": prev("current_evidence"), "quality_delta": rnd(F.col("quality_score") - prev("quality_score"), 2),
                       "coverage_delta": rnd(F.col("factor_coverage") - prev("factor_coverage"), 2)})
    return d.where("previous_date IS NOT NULL")


def fixed_target_comparisons(pred: DataFrame, target: str = "target_date", window_days: int = 7) -> DataFrame:
    """For each ticker and anchor horizon (21, 63): the predictions of the same and longer horizons whose
    target is nearest to the anchor's latest target, and how the median target moved."""
    from marketloom.operators.asof import nearest_by_day
    known = pred.where(F.col(target).isNotNull())
    latest = known.where("horizon IN (21, 63)").groupBy("ticker", F.col("horizon").alias("anchor_horizon")).agg(
        F.max("trade_date").alias("anchor_as_of"), F.max_by(target, "trade_date").alias("anchor_target"))
    hs = F.filter(F.array(*[F.lit(h) for h in HORIZONS]), lambda h: h >= F.col("anchor_horizon"))
    a = latest.withColumn("horizon", F.explode(hs))
    c = known.select("ticker", "horizon", target, "trade_date", *[(F.col("close") * (1 + F.col(f"return_{p}"))).alias(f"target_{p}") for p in ("p10", "p50", "p90")])
    p = nearest_by_day(a, c, ["ticker", "horizon"], "anchor_target", target, window_days, "trade_date", ["trade_date", "target_p10", "target_p50", "target_p90"], not_after="anchor_as_of")
    g = p.groupBy("ticker", "anchor_horizon", "anchor_target").agg(
        F.count("*").alias("points"), F.max_by("near_target_p50", "horizon").alias("_old"), F.min_by("near_target_p50", "horizon").alias("_new"),
        F.max("near_target_p10").alias("_lo"), F.min("near_target_p90").alias("_hi"), F.max("near_target_p50").alias("_mx"), F.min("near_target_p50").alias("_mn"), F.avg("near_target_p50").alias("_avg"))
    move = F.col("_new") / F.col("_old") - 1
    return g.where("points >= 2").select("ticker", "anchor_horizon", "anchor_target", "points", rnd(move, 6).alias("target_change_pct"),
                                         F.when(move > 0.01, "UPGRADED").when(move < -0.01, "DOWNGRADED").otherwise("STABLE").alias("revision"),
                                         rnd((F.col("_mx") - F.col("_mn")) / F.abs("_avg"), 6).alias("target_spread_pct"), (F.col("_lo") <= F.col("_hi")).alias("intervals_overlap"))


def input_changes(features: DataFrame, inputs: list[str], keys: list[str], order: str) -> DataFrame:
    """One row per numeric input that changed against the previous snapshot of its key."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = F.array(*[F.struct(F.lit(c).alias("input"), F.lag(c).over(w).alias("previous"), F.col(c).alias("current")) for c in inputs])
    d = features.withColumn("_i", rows).select(*keys, order, F.row_number().over(w).alias("_n"), F.explode("_i").alias("x")).select(*keys, order, "_n", "x.*")
    changed = ~F.col("previous").eqNullSafe(F.col("current")) & ~F.coalesce(F.abs(F.col("current") - F.col("previous")) <= 1e-10, F.lit(False))
    return d.where((F.col("_n") > 1) & changed).drop("_n").withColumn("delta", rnd(F.col("current") - F.col("previous"), 8))
