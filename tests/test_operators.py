"""Operators against hand-computed fixtures and brute force."""
import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions import dates as D, text as T
from marketloom.functions.scalar import rnd
from marketloom.operators import aggregates as AG, asof, behavior as BH, flow as FL, fundamentals as FU, portfolio as PF, predict as PR, quality as QL, series as SE, signals as SG, valuation as VA

DAY = dt.timedelta(days=1)


def daily(spark, n=120, tickers=("A", "B"), seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for t in tickers:
        p = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i in range(n):
            o, c = float(p[i] * 0.995), float(p[i])
            rows.append((t, dt.date(2025, 1, 1) + i * DAY, o, max(o, c) * 1.01, min(o, c) * 0.99, c, float(1000 + rng.integers(0, 500))))
    return spark.createDataFrame(rows, "ticker string, trade_date date, open double, high double, low double, close double, volume double")


def collect(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# ---- fixtures of the trade ledger ---------------------------------------------------------------

LEDGER = [(1, "X", "BUY", dt.date(2026, 8, 3), 10.0, 100.0, 1.0), (2, "X", "BUY", dt.date(2026, 8, 4), 5.0, 120.0, 1.0), (3, "X", "SELL", dt.date(2026, 8, 5), 8.0, 150.0, 1.0)]
SCHEMA = "id long, ticker string, side string, trade_date date, quantity double, price double, fee double"


def test_fifo_fixture(spark):
    t = spark.createDataFrame(LEDGER, SCHEMA)
    bars = spark.createDataFrame([("X", dt.date(2026, 8, 27), 160.0), ("X", dt.date(2026, 8, 28), 170.0)], "ticker string, trade_date date, close double")
    r = PF.positions(t, bars).first()
    assert r.quantity == 7
    assert r.remaining_cost == pytest.approx(801.2)
    assert r.realized_pnl == pytest.approx(398.2)
    assert r.unrealized_pnl == pytest.approx(388.8)
    cal = D.trading_calendar(spark.sql("SELECT DATE'2026-08-01' a, DATE'2026-08-31' b"), "a", "b")
    d = {x.trade_date: x for x in PF.daily_pnl(t, bars, cal).collect()}
    assert d[dt.date(2026, 8, 28)].pnl == pytest.approx(70)


def test_daily_pnl_never_bridges_a_gap(spark):
    t = spark.createDataFrame(LEDGER, SCHEMA)
    bars = spark.createDataFrame([("X", dt.date(2026, 8, 27), 160.0), ("X", dt.date(2026, 8, 31), 170.0)], "ticker string, trade_date date, close double")
    cal = D.trading_calendar(spark.sql("SELECT DATE'2026-08-01' a, DATE'2026-08-31' b"), "a", "b")
    last = PF.daily_pnl(t, bars, cal).where("trade_date = DATE'2026-08-31'").first()
    assert last.pnl is None and last.complete is False


@pytest.mark.parametrize("rows_per_bucket", [3, 7, 10_000])
def test_fifo_matches_brute_force_for_any_bucketing(spark, rows_per_bucket):
    rng = np.random.default_rng(11)
    rows, pos, i = [], {"A": 0, "B": 0}, 0
    for k in range(150):
        t = "A" if rng.random() < 0.8 else "B"
        q = int(rng.integers(1, 9))
        side = "SELL" if pos[t] >= q and rng.random() < 0.5 else "BUY"
        pos[t] += q if side == "BUY" else -q
        i += 1
        rows.append((i, t, side, dt.date(2025, 1, 1) + (k // 4) * DAY, float(q), float(rng.integers(50, 60)), 0.0))
    want = []
    for t in ("A", "B"):
        lots = []
        for r in rows:
            if r[1] != t:
                continue
            if r[2] == "BUY":
                lots.append([r[0], r[4]])
            else:
                left = r[4]
                while left > 0:
                    used = min(left, lots[0][1])
                    want.append((t, lots[0][0], r[0], used))
                    left -= used
                    lots[0][1] -= used
                    if lots[0][1] == 0:
                        lots.pop(0)
    got = PF.fifo_matches(spark.createDataFrame(rows, SCHEMA), rows_per_bucket).select("ticker", "buy_id", "sell_id", "quantity")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_oversell_is_reported(spark):
    t = spark.createDataFrame([(1, "X", "SELL", dt.date(2025, 1, 1), 5.0, 1.0, 0.0), *[(a + 1, *b) for a, *b in LEDGER]], SCHEMA)
    assert [r.id for r in PF.oversells(t).collect()] == [1]


# ---- series -------------------------------------------------------------------------------------

@pytest.mark.parametrize("alpha,n", [(0.5, 200), (2 / 21, 900)])
def test_ema_equals_recursion_across_blocks(spark, alpha, n):
    df = daily(spark, n, ("A",))
    got = [r[0] for r in SE.ema(df, "close", "e", alpha, ["ticker"], "trade_date", 5).orderBy("trade_date").select("e").collect()]
    want = pd.Series([r.close for r in df.orderBy("trade_date").collect()]).ewm(alpha=alpha, adjust=False, min_periods=5).mean()
    assert got[:4] == [None] * 4
    assert np.allclose(got[4:], want[4:], rtol=1e-11)


def test_average_tie_rank_equals_pandas(spark):
    v = [3.0, 1.0, 1.0, None, 5.0, 3.0, 3.0]
    df = spark.createDataFrame([(i, "d", x) for i, x in enumerate(v)], "i int, d string, v double")
    got = [r[0] for r in df.select("i", SE.average_tie_rank("v", ["d"]).alias("r")).orderBy("i").select("r").collect()]
    want = pd.Series(v).rank(pct=True)
    assert [None if math.isnan(x) else round(x, 12) for x in want] == [None if x is None else round(x, 12) for x in got]


def test_non_overlapping_brute_force(spark):
    rows = [("k", dt.date(2025, 1, 1) + int(i) * DAY, dt.date(2025, 1, 1) + int(i + h) * DAY) for i, h in zip([0, 1, 4, 5, 6, 9, 12], [3, 1, 1, 5, 1, 1, 2])]
    got = [r.s for r in SE.non_overlapping(spark.createDataFrame(rows, "k string, s date, e date"), ["k"], "s", "e").orderBy("s").collect()]
    want, last = [], None
    for _, s, e in rows:
        if last is None or s > last:
            want.append(s)
            last = e
    assert got == want


def test_running_total_is_exact_for_a_hot_key(spark):
    rows = [(i, "hot" if i % 10 else "cold", dt.date(2025, 1, 1) + (i // 50) * DAY, float(i % 7)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k string, d date, v double")
    got = {r.id: r.t for r in SE.running_total(df, ["k"], "d", ["id"], {"t": F.col("v").cast("decimal(18,4)")}).collect()}
    acc = {}
    for i, k, _, v in rows:
        acc[k] = acc.get(k, 0) + v
        assert float(got[i]) == acc[k]


@pytest.mark.parametrize("accuracy", [20, 200, 10_000])
def test_exact_quantiles_with_narrow_brackets(spark, accuracy):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(0, 1, 3000), np.full(1500, 0.25), rng.lognormal(0, 3, 500)])
    df = spark.createDataFrame(pd.DataFrame({"k": ["a"] * len(v) + ["b"] * 7, "v": list(v) + [1.0, 2, 3, 4, 5, 6, 8]}))
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in AG.exact_quantiles(df, ["k"], "v", probs, accuracy).collect()}
    for n, p in probs.items():
        assert got["a"][n] == pytest.approx(np.quantile(v, p), rel=1e-12)
        assert got["b"][n] == pytest.approx(np.quantile([1, 2, 3, 4, 5, 6, 8], p), rel=1e-12)


# ---- as-of --------------------------------------------------------------------------------------

@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("bucket", [None, lambda t: F.trunc(t, "month")])
def test_asof_join_brute_force(spark, strict, bucket):
    rng = np.random.default_rng(2)
    d0 = dt.date(2025, 1, 1)
    left = [(i, "A" if rng.random() < 0.9 else "B", d0 + int(rng.integers(0, 200)) * DAY) for i in range(120)]
    right = sorted({("A" if rng.random() < 0.9 else "B", d0 + int(rng.integers(0, 200)) * DAY) for _ in range(40)})
    right = [(k, d, float(j)) for j, (k, d) in enumerate(right)]
    got = asof.asof_join(spark.createDataFrame(left, "i int, k string, t date"), spark.createDataFrame(right, "k string, rt date, v double"), ["k"], "t", "rt", ["v"], strict=strict, bucket=bucket)
    for r in got.collect():
        hits = [(d, v) for k, d, v in right if k == r.k and (d < r.t if strict else d <= r.t)]
        assert r.v == (max(hits)[1] if hits else None)


# ---- flow, behaviour, prefix invariance -----------------------------------------------------------

def test_up_trend_scores_positive(spark):
    rows = [("U", dt.date(2026, 6, 1) + i * DAY, 99.5 + i, 100.2 + i, 98.0 + i, 100.0 + i, 1000.0 + 30 * i) for i in range(45)]
    f = FL.flow_score(FL.flow_metrics(spark.createDataFrame(rows, "ticker string, trade_date date, open double, high double, low double, close double, volume double")))
    last = f.orderBy(F.col("trade_date").desc()).first()
    assert last.signal == "STRONG_ACCUMULATION" and last.mfi14 == 100 and last.sample_size == 45


OPERATORS = {
    "flow": lambda b: FL.flow_score(FL.flow_metrics(b)).select("ticker", "trade_date", "score", "confidence", "signal"),
    "stages": lambda b: BH.stages(BH.composite(FL.flow_score(FL.flow_metrics(b)))).select("ticker", "trade_date", "stage", "confidence"),
    "indicators": lambda b: SG.indicators(b).select("ticker", "trade_date", rnd("ema", 8), rnd("rsi2", 8), rnd("atr", 8), "entry_condition"),
    "positions": lambda b: SG.positions(SG.rule_signals(SG.indicators(b))).select("ticker", "trade_date", "rule", "position"),
    "price_features": PR.price_features,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_prefix_invariance(spark, name):
    """Truncating the future changes nothing before the cut, and a rerun gives the same rows."""
    b = daily(spark, 110).cache()
    cut = dt.date(2025, 1, 1) + 90 * DAY
    op = OPERATORS[name]
    full = sorted(map(str, op(b).where(F.col("trade_date") <= cut).collect()))
    part = sorted(map(str, op(b.where(F.col("trade_date") <= cut)).collect()))
    assert full == part and full == sorted(map(str, op(b).where(F.col("trade_date") <= cut).collect()))


def test_equity_equals_a_cash_ledger(spark):
    b = daily(spark, 120, ("A",))
    c = SG.equity(SG.positions(SG.rule_signals(SG.indicators(b)))).where("rule = 'trend20'").orderBy("trade_date").collect()
    cash, units, prev = 1.0, 0.0, 0
    for r in c:
        if r.position == 1 and prev == 0:
            cash, units = 0.0, cash / (r.open * 1.0005 * 1.0005)
        elif r.position == 0 and prev == 1:
            cash, units = units * r.open * 0.9995 * 0.9995, 0.0
        prev = r.position
        assert r.equity == pytest.approx(cash + units * r.close, rel=1e-9)
    assert any(r.fill for r in c)


def test_attribution_residual_is_zero(spark):
    c = SG.equity(SG.positions(SG.rule_signals(SG.indicators(daily(spark, 120)))))
    for r in SG.wealth_attribution(c).collect():
        assert abs(r.residual) < 1e-9
    for r in SG.dollar_attribution(SG.decorate(c)).collect():
        assert abs(r.residual) < 1e-4


# ---- fundamentals and valuation -------------------------------------------------------------------

def test_restatement_does_not_change_earlier_days_and_q4_is_derived(spark):
    q = lambda s, e, f, v: ("T", "revenue", dt.date.fromisoformat(s), dt.date.fromisoformat(e), dt.date.fromisoformat(f), 0, float(v))
    rows = [q("2024-01-01", "2024-09-30", "2024-11-05", 300), q("2024-01-01", "2024-12-31", "2025-02-10", 420), q("2024-01-01", "2024-09-30", "2025-03-10", 310)]
    f = spark.createDataFrame(rows, "ticker string, metric_key string, period_start date, period_end date, filed_at date, tag_priority int, value double").withColumn("known", F.col("filed_at"))
    cal = D.trading_calendar(spark.sql("SELECT DATE'2024-01-01' a, DATE'2025-12-31' b"), "a", "b")
    out = FU.quarter_values(FU.vintages(FU.first_usable_session(f, cal))).where("period_end = DATE'2024-12-31'").orderBy("valid_from").collect()
    assert [(r.value, r.valid_from, r.valid_to) for r in out] == [(120.0, dt.date(2025, 2, 11), dt.date(2025, 3, 11)), (110.0, dt.date(2025, 3, 11), None)]
    assert all(r.derived and r.period_start == dt.date(2024, 10, 1) for r in out)


def test_conflicting_values_become_null(spark):
    f = spark.createDataFrame([("T", "revenue", dt.date(2024, 1, 1), dt.date(2024, 3, 31), dt.date(2024, 5, 1), dt.date(2024, 5, 1), p, v) for p, v in ((0, 1.0), (0, 2.0), (1, 9.0))],
                              "ticker string, metric_key string, period_start date, period_end date, usable_from date, known date, tag_priority int, value double")
    r = FU.vintages(f).collect()
    assert len(r) == 1 and r[0].conflict and r[0].value is None


@pytest.mark.parametrize("facts,method,value", [
    ([("annual", "2024-01-01", "2024-12-31", "FY", "2025-02-01", 4.0)], "LATEST_FY", 4.0),
    ([("annual", "2024-01-01", "2024-12-31", "FY", "2025-02-01", 4.0), ("ytd", "2025-01-01", "2025-06-30", "Q2", "2025-08-01", 3.0), ("ytd", "2024-01-01", "2024-06-30", "Q2", "2024-08-01", 1.5)], "FY_PLUS_YTD_DELTA", 5.5),
    ([("quarter", f"2024-{m:02d}-01", e, f"Q{i}", "2025-01-05", 1.0) for i, (m, e) in enumerate([(1, "2024-03-31"), (4, "2024-06-30"), (7, "2024-09-30"), (10, "2024-12-31")], 1)], "FOUR_QUARTERS", 4.0),
    ([("annual", "2024-01-01", "2024-12-31", "FY", "2025-02-01", 4.0), ("ytd", "2025-01-01", "2025-06-30", "Q2", "2025-08-01", 3.0)], None, None),
    # no fact is too old: a year filed late, and interims that follow it in the same late filings
    ([("annual", "2015-01-01", "2015-12-31", "FY", "2022-03-01", 7.0)], "LATEST_FY", 7.0),
    ([("annual", "2015-01-01", "2015-12-31", "FY", "2022-03-01", 7.0), ("ytd", "2015-01-01", "2015-06-30", "Q2", "2022-03-01", 3.0), ("ytd", "2016-01-01", "2016-06-30", "Q2", "2022-03-02", 4.0)], "FY_PLUS_YTD_DELTA", 8.0),
    # four quarters in five with one missing aren't continuous
    ([("quarter", f"2023-{m:02d}-01", e, f"Q{i}", "2025-01-05", 1.0) for i, (m, e) in enumerate([(1, "2023-03-31"), (4, "2023-06-30"), (10, "2023-12-31")], 1)] + [("quarter", "2024-01-01", "2024-03-31", "Q1", "2025-01-05", 1.0)], None, None)])
def test_ttm_methods(spark, facts, method, value):
    d = dt.date.fromisoformat
    f = spark.createDataFrame([("T", t, d(s), d(e), fp, d(fl), v, 0) for t, s, e, fp, fl, v in facts],
                              "ticker string, period_type string, period_start date, period_end date, fiscal_period string, filed_at date, value double, tag_priority int").withColumn("fiscal_year", F.year("period_end"))
    r = VA.ttm_eps(f).orderBy(F.col("cp").desc()).first()
    assert r.ttm_method == method and r.ttm_eps == value


# ---- calendar and text ----------------------------------------------------------------------------

def test_known_market_holidays(spark):
    days = {"2025-04-18": False, "2024-03-29": False, "2021-06-18": True, "2022-06-20": False, "2026-07-03": False, "1997-01-20": True, "1998-01-19": False, "2025-11-27": False, "2021-12-31": False, "2025-11-28": True}
    df = spark.createDataFrame([(k,) for k in days], "d string").select("d", D.is_trading_day(F.to_date("d")).alias("open"))
    assert {r.d: r.open for r in df.collect()} == days


def test_canonical_url_and_domain(spark):
    df = spark.createDataFrame([("https://www.bbc.co.uk/a?utm_source=x&id=7&ref=z#top",), ("http://a.b.example.com/p?ref=1",), ("ftp://x",)], "u string")
    got = [tuple(r) for r in df.select(T.canonical_url("u"), T.registrable_domain("u")).collect()]
    assert got[0] == ("https://www.bbc.co.uk/a?id=7", "bbc.co.uk") and got[1] == ("http://a.b.example.com/p", "example.com") and got[2][1] is None


def test_bad_bars_are_rejected(spark):
    with pytest.raises(ValueError):
        QL.validate_bars(daily(spark, 5).drop("volume"))
    b = daily(spark, 5, ("A",))
    ok, bad = QL.validate_bars(b.unionByName(b.limit(1)))
    assert ok.count() == 4 and bad.count() == 2
