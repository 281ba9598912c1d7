"""The candidate model: inputs, walk-forward ridge at every date, intervals, choice against the baseline (PRED-12 to PRED-15)."""
from pyspark.sql import functions as F

from marketloom.operators import predict as O, ridge as R
from marketloom.plans import sqlviews as S
from marketloom.plans.q_predict import EVAL, FSRC, KEY, features
from marketloom.plans.registry import register
from marketloom.sources.shared import materialize

r = S.rnd
N = 16
_X = ["return_5d", "return_21d", "return_63d", "return_126d", "volatility_20d", "ma_gap_20d", "CASE horizon WHEN 21 THEN return_21d - market_21d WHEN 63 THEN return_63d - market_63d ELSE return_126d - market_126d END",
      "CASE horizon WHEN 21 THEN return_21d - industry_21d WHEN 63 THEN return_63d - industry_63d ELSE return_126d - industry_126d END", "flow_score", "behavior_score", "coalesce(forward_premium, static_premium)",
      "eps_revision", "revenue_growth", "cash_flow_margin", "CASE regime WHEN 'RATE_HEADWIND' THEN -1e0 WHEN 'RATE_TAILWIND' THEN 1e0 END", "event_score"]
_PAIRS = [(i, j) for i in range(N) for j in range(i, N)]


def _cell(i: int, j: int) -> str:
    if j == N:
        return f"(q{i} - s{i} * sy / n) / d{i}"
    a, b = min(i, j), max(i, j)
    return f"CASE WHEN z{i} OR z{j} THEN {'2e0' if i == j else '0e0'} ELSE (p{a}_{b} - s{i} * s{j} / n) / (d{i} * d{j}) + {'2e0' if i == j else '0e0'} END"


def _pivot(k: int) -> str:
    """One step of elimination over all rows of the 16 x 17 system, held as one list."""
    w = N + 1
    return (f"g{k + 1} AS (SELECT * REPLACE (list_transform(range({N * w}), lambda t: CASE WHEN t // {w} = {k} THEN a[t + 1] / a[{k * w + k + 1}] "
            f"ELSE a[t + 1] - a[(t // {w}) * {w} + {k + 1}] * a[{k * w + 1} + t % {w}] / a[{k * w + k + 1}] END) AS a) FROM g{k})")


#: The model by normal equations: running sums of the labels known before each date, then elimination.
RIDGE = EVAL + f""",
vx AS MATERIALIZED (SELECT ticker, trade_date, horizon, {', '.join(f'coalesce(CAST({x} AS DOUBLE), 0e0) AS x{i}' for i, x in enumerate(_X))} FROM h0),
tx AS MATERIALIZED (SELECT vx.*, em.td, em.actual_return AS y FROM vx JOIN em USING (ticker, trade_date, horizon)),
px AS MATERIALIZED (SELECT ticker, horizon, td, count(*) OVER w AS n, sum(y) OVER w AS sy, {', '.join(f'sum(x{i}) OVER w AS s{i}, sum(x{i} * y) OVER w AS q{i}, max(x{i}) OVER w = min(x{i}) OVER w AS z{i}' for i in range(N))}, {', '.join(f'sum(x{i} * x{j}) OVER w AS p{i}_{j}' for i, j in _PAIRS)}
  FROM tx WINDOW w AS (PARTITION BY ticker, horizon ORDER BY td ROWS UNBOUNDED PRECEDING)),
ax AS (SELECT vx.*, px.* EXCLUDE (ticker, horizon, td) FROM vx ASOF JOIN px ON px.ticker = vx.ticker AND px.horizon = vx.horizon AND vx.trade_date > px.td),
dx AS (SELECT *, {', '.join(f'CASE WHEN z{i} THEN 1e0 ELSE sqrt((p{i}_{i} - s{i} * s{i} / n) / (n - 1)) END AS d{i}' for i in range(N))} FROM ax WHERE n >= CASE horizon WHEN 21 THEN 40 WHEN 63 THEN 28 ELSE 16 END),
g0 AS (SELECT ticker, trade_date, horizon, n, sy, [{', '.join(f'(x{i} - s{i} / n) / d{i}' for i in range(N))}] AS v, [{', '.join(f'd{i}' for i in range(N))}] AS d, [{', '.join(f's{i} / n' for i in range(N))}] AS mu,
  [{', '.join(_cell(i, j) for i in range(N) for j in range(N + 1))}] AS a FROM dx),
{', '.join(_pivot(k) for k in range(N))},
gx AS MATERIALIZED (SELECT ticker, trade_date, horizon, n, d, mu, sy / n AS level, [{', '.join(f'a[{i * (N + 1) + N + 1}]' for i in range(N))}] AS beta, v FROM g{N}),
ex AS MATERIALIZED (SELECT ticker, trade_date, horizon, n AS training_samples, level + list_inner_product(v, beta) AS raw, level, beta, d, mu FROM gx)"""


@register("pred_12_model_inputs", S.sql(FSRC, f"SELECT ticker, trade_date, horizon, {', '.join(f'{r(f'x{i}', 6)} AS x{i}' for i in range(N))} FROM vx", RIDGE.split(",\ntx AS")[0]))
def inputs(spark, d):
    rows = features(spark, d)
    rows = rows.select(*rows.columns, F.explode(F.array(*map(F.lit, R.MIN_SAMPLES))).alias("horizon"))
    return rows.select(*KEY, "horizon", *[O.rnd(x, 6).alias(f"x{i}") for i, x in enumerate(R.model_inputs())])


def candidates(spark, d):
    f = materialize(features(spark, d), "features")  # read by the baseline and by the candidate
    return f, R.candidate_predictions(f, O.evaluate(O.predict(f)))


@register("pred_13_ridge_walk_forward", S.sql(FSRC, f"SELECT ticker, trade_date, horizon, training_samples, {r('least(greatest(raw, -0.8e0), 2)', 6)} AS expected_return FROM ex", RIDGE))
def ridge(spark, d):
    """Out-of-sample expected returns at every date and horizon, each from a model of the labels known before it."""
    return candidates(spark, d)[1].select(*KEY, "horizon", "training_samples", F.col("return_p50").alias("expected_return"))


@register("pred_14_residual_intervals")
def intervals(spark, d):
    """Interval and probability from the residuals of each date's model on all its training rows.

    No SQL: it would join every date with every earlier one; the tests hold it against brute force.
    """
    return candidates(spark, d)[1].select(*KEY, "horizon", "return_p10", "return_p90", "probability_up")


def comparison(spark, d):
    """Reliability of baseline and candidate on the same dates, and which of them a horizon uses."""
    f, c = candidates(spark, d)
    base = O.evaluate(O.predict(f))
    candidate = materialize(O.evaluate(c), "candidate")
    score = lambda e: O.composite_reliability(O.reliability_components(e))
    return O.model_choice(score(base), score(candidate))


@register("pred_15_model_choice")
def choice(spark, d):
    """Champion against challenger. No SQL, as it needs the candidate's intervals."""
    return comparison(spark, d).select("ticker", "horizon", "candidate_score", "baseline_score", "candidate_mae", "baseline_mae", "effective_samples", "decision")
