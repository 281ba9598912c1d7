"""The candidate model against a model fitted anew for every date, and interval joins against pairs."""
from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import predict as PR, ridge as R, snapshot as SN, valuation as VA
from marketloom.operators.asof import asof_join, asof_joins, valid_at


def fitted(x, y, at):
    """Ridge on standardised columns with a free intercept, its residuals, and the value at one row."""
    mean, scale = x.mean(axis=0), x.std(axis=0, ddof=1)
    scale[np.ptp(x, axis=0) == 0] = 1  # a flat column has rounding for a deviation
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], axis=1)
    beta = np.linalg.solve(z.T @ z + R.LAMBDA * np.diag([0] + [1] * x.shape[1]), z.T @ y)
    residual = y - z @ beta
    return beta[0] + (at - mean) / scale @ beta[1:], *np.quantile(residual, (0.1, 0.9)), residual.std(ddof=1)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    n, d = 160, 6
    x = rng.normal(size=(n, d)) * [1, 5, 0.01, 1, 1, 1] + [0, 100, 0, 0, 0, 0]
    x[:, 3] = 0.0
    x[:100, 4] = 0.37  # flat at first
    x[:, 5] = x[:, 0]  # collinear
    day = np.cumsum(rng.integers(1, 4, n)) + 9000
    known = np.where(rng.random(n) < 0.85, day + rng.integers(20, 40, n), -1)
    y = x @ rng.normal(size=d) * 0.01 + rng.normal(size=n) * 0.1
    return day, x, known, y


def test_walk_forward_equals_a_fit_for_every_date(series):
    day, x, known, y = series
    size, out = R.walk_forward(day, x, known, y, 16)
    for k in range(len(day)):
        train = np.flatnonzero((known >= 0) & (known < day[k]))
        assert size[k] == len(train)
        if len(train) < 16:
            assert np.isnan(out[k]).all()
        else:
            order = train[np.lexsort((day[train], known[train]))]
            assert np.allclose(out[k], fitted(x[order], y[order], x[k]), atol=1e-9)


def test_walk_forward_sees_no_later_label(series):
    day, x, known, y = series
    size, out = R.walk_forward(day, x, known, y, 16)
    later = y + np.where(known >= day[120], 5.0, 0.0)
    size2, out2 = R.walk_forward(day, x, known, later, 16)
    assert (size == size2).all() and np.allclose(out[:121], out2[:121], equal_nan=True, atol=1e-12)


def test_walk_forward_models_of_several_series(spark, series):
    day, x, known, y = series
    zero = dt.date(1970, 1, 1)
    date = lambda d: None if d < 0 else zero + dt.timedelta(int(d))
    rows = [(t, h, date(day[k] + shift), x[k].tolist(), date(known[k] + shift) if known[k] >= 0 else None, float(y[k])) for t, h, shift in (("A", 21, 0), ("B", 63, -9300)) for k in range(len(day))]
    rows = rows[::-1] + [("C", 21, date(9000), x[0].tolist(), None, None)]
    df = spark.createDataFrame([(t, h, zero + dt.timedelta(-300) if d is None else d, *rest) for t, h, d, *rest in rows], "ticker string, horizon int, day date, x array<double>, known date, y double")
    got = {(r.ticker, r.day): r for r in R.walk_forward_models(df, ["ticker", "horizon"], "day", "x", "known", "y", lambda key: R.MIN_SAMPLES[int(key[1])]).collect()}
    size, out = R.walk_forward(day, x, known, y, 40)
    for k in range(len(day)):
        r = got["A", date(day[k])]
        assert r.training_samples == size[k] and (r.expected is None if np.isnan(out[k, 0]) else np.allclose([r.expected, r.residual_p10, r.residual_p90, r.residual_sd], out[k], atol=1e-9))
    assert got["C", date(9000)].training_samples == 0 and got["C", date(9000)].expected is None
    assert R.walk_forward_models(df.limit(0), ["ticker", "horizon"], "day", "x", "known", "y", lambda key: 1).count() == 0


def test_candidate_intervals(spark):
    """Every registered column of a candidate follows from a fit on the rows known before its date."""
    rng = np.random.default_rng(5)
    n, h = 120, 21
    names = ["return_5d", "return_21d", "return_63d", "return_126d", "volatility_20d", "ma_gap_20d", "market_21d", "market_63d", "market_126d", "industry_21d", "industry_63d", "industry_126d", "flow_score", "behavior_score",
             "forward_premium", "static_premium", "eps_revision", "revenue_growth", "cash_flow_margin", "event_score"]
    v = rng.normal(size=(n, len(names))) * 0.1
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(n)]
    snap = spark.createDataFrame([("A", days[k], 10.0, 5.0, 80.0, True, "RATE_HEADWIND" if k % 3 else None, *map(float, v[k])) for k in range(n)],
                                 "ticker string, trade_date date, close double, market_close double, quality_score double, eligible boolean, regime string, " + ", ".join(f"{c} double" for c in names))
    y = rng.normal(size=n) * 0.1
    ev = spark.createDataFrame([("A", days[k], h, "MATURED" if k + h < n else "PENDING", days[k + h] if k + h < n else None, float(y[k]) if k + h < n else None) for k in range(n)],
                               "ticker string, trade_date date, horizon int, status string, actual_date date, actual_return double")
    got = {r.trade_date: r for r in R.candidate_predictions(snap, ev).collect()}
    f = {c: v[:, i] for i, c in enumerate(names)}
    x = np.stack([f["return_5d"], f["return_21d"], f["return_63d"], f["return_126d"], f["volatility_20d"], f["ma_gap_20d"], f["return_21d"] - f["market_21d"], f["return_21d"] - f["industry_21d"], f["flow_score"],
                  f["behavior_score"], f["forward_premium"], f["eps_revision"], f["revenue_growth"], f["cash_flow_margin"], np.where(np.arange(n) % 3, -1.0, 0.0), f["event_score"]], axis=1)
    assert sorted(got) == days[h + 40:]
    for k in range(h + 40, n):
        train = np.arange(k - h)  # matured strictly before day k
        e, low, high, sd = fitted(x[train], y[train], x[k])
        r = got[days[k]]
        assert r.training_samples == len(train) and abs(r.return_p50 - e) < 2e-6 and abs(r.return_p10 - min(e + low, e)) < 2e-6 and abs(r.return_p90 - max(e + high, e)) < 2e-6
        assert abs(r.probability_up - min(max(1 / (1 + np.exp(-e / max(0.02, sd))), 0.05), 0.95)) < 2e-4


def test_model_choice(spark):
    columns = "ticker string, horizon int, composite_score double, model_mae double, effective_samples long, required_samples int"
    base = spark.createDataFrame([(t, 21, 70.0, 0.10, 80, 60) for t in "ABCD"], columns)
    new = spark.createDataFrame([("A", 21, 73.0, 0.097, 60, 60), ("B", 21, 73.0, 0.0971, 60, 60), ("C", 21, 72.99, 0.05, 60, 60), ("D", 21, 90.0, 0.05, 59, 60)], columns)
    assert {r.ticker: r.decision for r in PR.model_choice(base, new).collect()} == {"A": "PROMOTE_CANDIDATE", "B": "KEEP_BASELINE", "C": "KEEP_BASELINE", "D": "KEEP_BASELINE"}


def test_valid_at_equals_all_pairs(spark):
    rng = np.random.default_rng(7)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(int(rng.integers(-40000, 20000)))
    rel = []
    for k in range(300):
        a = day()
        rel.append(("AB"[k % 2], k, a, None if k % 5 == 0 else a + dt.timedelta(int(rng.choice([0, 1, 7, 8, 63, 64, 500, 20000]) - (k % 50 == 7)))))
    points = [("ABC"[k % 3], k, day()) for k in range(200)] + [("A", 200, rel[0][2]), ("B", 201, rel[1][3]), ("A", 202, None), (None, 203, day()), ("A", 204, dt.date(9999, 12, 31)), ("A", 205, dt.date(1, 1, 1))]
    want = sorted((p, k) for t, p, d in points for s, k, a, b in rel if t == s and d is not None and a <= d and (b is None or b >= d))
    r = spark.createDataFrame(rel, "ticker string, k int, a date, b date")
    q = spark.createDataFrame(points, "ticker string, p int, d date")
    assert sorted((x.p, x.k) for x in valid_at(r, q, ["ticker"], "d", "a", "b").select("p", "k").collect()) == want
    outer = valid_at(r, q, ["ticker"], "d", "a", "b", "left").select("p", "k").collect()
    assert sorted((x.p, x.k) for x in outer if x.k is not None) == want and {x.p for x in outer} == set(range(206))


def test_valid_at_of_one_key_is_linear(spark):
    """10 000 facts of one issuer, valid for a day each, against 10 000 dates: pairs would be 10^8 rows."""
    facts = spark.range(10000).select(F.lit("A").alias("ticker"), "id", F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("a")).withColumn("b", F.col("a"))
    points = facts.select("ticker", F.col("id").alias("p"), F.col("a").alias("d"))
    j = valid_at(facts, points, ["ticker"], "d", "a", "b")
    assert j.where("id = p").count() == 10000 == j.count()
    assert "a <=" not in j._jdf.queryExecution().optimizedPlan().toString().split("Join")[1].split("\n")[0]


def test_several_as_of_joins_in_one_scan(spark):
    left = spark.createDataFrame([("A", 1), ("A", 5), ("B", 5), (None, 5)], "k string, t int")
    one = spark.createDataFrame([("A", 1, 10.0), ("A", 5, 11.0), ("A", 5, 12.0), ("B", 9, 13.0)], "k string, at int, v double")
    two = spark.createDataFrame([("A", 1, "x"), ("B", 4, "y")], "k string, on int, w string")
    got = asof_joins(left, [(one, "at", ["v"], True), (two, "on", ["w"], False)], ["k"], "t")
    want = asof_join(asof_join(left, one, ["k"], "t", "at", ["v"], strict=True), two, ["k"], "t", "on", ["w"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == ["k", "t", "v", "w"]


def test_statement_states_use_what_was_filed(spark):
    d = dt.date
    rows = [("A", "revenue", d(2019, 1, 1), d(2019, 12, 31), d(2020, 2, 1), 100.0), ("A", "revenue", d(2020, 1, 1), d(2020, 12, 31), d(2021, 2, 1), 150.0), ("A", "revenue", d(2019, 1, 1), d(2019, 12, 31), d(2021, 6, 1), 120.0),
            ("A", "grossProfit", d(2020, 1, 1), d(2020, 12, 31), d(2021, 2, 1), 75.0), ("A", "revenue", d(2010, 1, 1), d(2010, 12, 31), d(2011, 2, 1), 50.0)]
    annual = spark.createDataFrame(rows, "ticker string, metric_key string, period_start date, period_end date, filed_at date, value double")
    got = {r.cp: (r.revenue_growth, r.gross_margin, r.cash_flow_margin) for r in SN.statement_states(annual).collect()}
    assert got == {d(2011, 2, 1): (None, None, None), d(2020, 2, 1): (1.0, None, None), d(2021, 2, 1): (0.5, 0.5, None), d(2021, 6, 1): (0.25, 0.5, None)}


def test_peers_without_a_bar_and_without_earnings(spark):
    d = dt.date
    rows = spark.createDataFrame([("A", d(2020, 1, 5), 10.0, 20.0, 10.0), ("A", d(2020, 1, 9), 10.0, None, 10.0)], "ticker string, trade_date date, close double, static_pe double, forward_pe double")
    prices = spark.createDataFrame([("B", d(2020, 1, 3), 30.0), ("C", d(2020, 1, 5), 8.0), ("D", d(2020, 1, 5), 1.0)], "ticker string, trade_date date, close double")
    ttm = spark.createDataFrame([("B", d(2020, 1, 1), 3.0), ("C", d(2020, 1, 5), 2.0), ("D", d(2020, 1, 1), -1.0)], "ticker string, cp date, ttm_eps double")
    ntm = spark.createDataFrame([("B", d(2020, 1, 5), 5.0), ("D", d(2020, 1, 1), None)], "ticker string, as_of date, eps_value double")
    links = spark.createDataFrame([("A", "B", d(2019, 1, 1), None), ("A", "C", d(2019, 1, 1), d(2020, 1, 9)), ("A", "D", d(2019, 1, 1), d(2020, 1, 7))], "ticker string, related_ticker string, active_from date, active_to date")
    got = {r.trade_date: (r.peer_static_pe, r.peer_forward_pe, r.peer_samples, r.static_premium, r.forward_premium) for r in SN.peer_features(rows, links, prices, ttm, ntm).collect()}
    assert got == {d(2020, 1, 5): (10.0, 6.0, 1, 1.0, 0.666667), d(2020, 1, 9): (7.0, 6.0, 2, None, 0.666667)}


def test_trailing_eps_of_ten_thousand_facts(spark):
    """One issuer that restates 2 500 quarters four times: as pairs of filing dates and facts that were 10^8 rows."""
    k = F.col("id")
    start = F.date_add(F.lit("1000-01-01").cast("date"), (k * 91).cast("int"))
    quarters = spark.range(2500).select(start.alias("period_start"), F.date_add(start, 90).alias("period_end"), k.alias("q"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("v"))
    facts = quarters.select(F.lit("A").alias("ticker"), "period_start", "period_end", F.lit("quarter").alias("period_type"), F.lit(0).alias("fiscal_year"), F.lit("Q2").alias("fiscal_period"),
                            F.date_add("period_end", 10 + 20 * F.col("v")).alias("filed_at"), (F.col("q") + F.col("v") * 0.25).alias("value"), F.lit(0).alias("tag_priority"))
    got = {r.cp: r.ttm_eps for r in VA.ttm_eps(facts).collect()}
    rows = [(r.filed_at, r.q, r.value) for r in facts.withColumn("q", F.floor("value")).select("filed_at", "q", "value").collect()]
    assert len(got) == 10000
    for cp in sorted(got)[40:10000:997]:
        latest = {}
        for _, q, v in sorted(r for r in rows if r[0] <= cp):
            latest[q] = v
        assert got[cp] == sum(latest[q] for q in sorted(latest)[-4:])
