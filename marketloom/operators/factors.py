"""Factor panel, ranks, capped selection and rebalanced account curves."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.functions.scalar import col, ratio, rnd
from marketloom.operators.aggregates import capped_top
from marketloom.operators.series import average_tie_rank, over


def densify(df: DataFrame, key: str = "ticker", date: str = "trade_date", calendar: DataFrame | None = None) -> DataFrame:
    """Left-join a series onto every session of the calendar for every key (missing stays null).

    Sessions between a key's first and last row are generated from a per-key calendar slice:
    the calendar is a date dimension, so the result has keys x sessions rows, the panel itself.
    """
    cal = (calendar or df.select(date).distinct()).groupBy().agg(F.array_sort(F.collect_set(date)).alias("_cal"))
    keys = df.select(key).distinct()
    grid = keys.join(F.broadcast(cal)).select(key, F.explode("_cal").alias(date))
    return grid.join(df, [key, date], "left")


def equal_weights(df: DataFrame, partition: list[str], score: str, ticker: str, n: int) -> DataFrame:
    """Top n by score with equal weights; no rows at all where fewer than n names qualify."""
    d = df.withColumn("_n", F.count("*").over(Window.partitionBy(*partition))).where(F.col("_n") >= n)
    return capped_top(d, partition, ticker, score, ticker, n, None).drop("_n").withColumn("weight", F.lit(1.0) / n)


def action_priority(action: str | Column) -> Column:
    """Fixed review order: sells first, holds last."""
    a = col(action)
    return (F.when(a == "SELL", 0).when(a == "REDUCE", 1).when(a == "BUY", 2)
            .when(a == "INCREASE", 3).otherwise(4))


def holdings_overlap(left: DataFrame, right: DataFrame, on: list[str], ticker: str, k: int) -> DataFrame:
    """Share of common holdings of two selections per key."""
    both = left.select(*on, ticker).join(right.select(*on, ticker).withColumn("_hit", F.lit(1)), [*on, ticker], "left")
    return both.groupBy(*on).agg((F.count("_hit") / F.lit(float(k))).alias("overlap"))


def membership_changes(picks: DataFrame, date: str, ticker: str) -> DataFrame:
    """Sorted arrays of names that entered and left against the previous selection date."""
    sets = picks.groupBy(date).agg(F.array_sort(F.collect_set(ticker)).alias("_now"))
    prev = F.coalesce(F.lag("_now").over(Window.orderBy(date)), F.array().cast("array<string>"))
    return sets.withColumn("_prev", prev).select(
        date, F.array_except("_now", "_prev").alias("entered"), F.array_except("_prev", "_now").alias("left"))


QUALITY = ["net_margin_ttm", "ocf_margin_ttm", "balance_safety"]


def month_end_panel(bars: DataFrame, history: int = 252) -> DataFrame:
    """Last bar of each (ticker, month) with skip-month momentum and the price-history flag."""
    w = over()
    d = bars.select("ticker", "trade_date", "close").withColumns({
        "momentum": F.lag("close", 21).over(w) / F.lag("close", history).over(w) - 1,
        "price_ready": F.count("close").over(w.rowsBetween(-history, 0)) == history + 1})
    month = F.last_day("trade_date")
    rest = ["trade_date", "close", "momentum", "price_ready"]
    return (d.groupBy("ticker", month.alias("month")).agg(F.max_by(F.struct(*rest), "trade_date").alias("b"))
            .select("ticker", "month", *[F.col(f"b.{c}").alias(c) for c in rest]))


def with_eligibility(panel: DataFrame, columns: list[str]) -> DataFrame:
    """Eligible rows have price history and every factor input."""
    ok = F.col("price_ready")
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return panel.withColumn("eligible", F.coalesce(ok, F.lit(False)))


def yields(panel: DataFrame) -> DataFrame:
    """Earnings and cash-flow yield against market capitalisation; exclusions become null."""
    cap = F.when(F.col("market_cap") > 0, F.col("market_cap"))
    return panel.withColumns({"earnings_yield": F.col("income_ttm") / cap, "ocf_yield": F.col("ocf_ttm") / cap})


def quality_momentum_ranks(panel: DataFrame, date: str = "month") -> DataFrame:
    """Quality, momentum and combined percentile ranks over the eligible names of each date."""
    e = panel.where("eligible")
    ranks = [average_tie_rank(c, [date]) for c in QUALITY]
    d = e.withColumns({"quality_rank": (ranks[0] + ranks[1] + ranks[2]) / 3, "momentum_rank": average_tie_rank("momentum", [date])})
    return d.withColumn("combined", 0.5 * F.col("quality_rank") + 0.5 * F.col("momentum_rank"))


def three_factor_scores(ranked: DataFrame, variants: DataFrame, date: str = "month", group: str = "sector") -> DataFrame:
    """Value rank within group and one weighted score per variant (a small dimension of weights)."""
    v = (average_tie_rank("earnings_yield", [date, group]) + average_tie_rank("ocf_yield", [date, group])) / 2
    d = ranked.withColumn("value_rank", v).join(F.broadcast(variants))
    return d.withColumn("score", F.col("w_quality") * F.col("quality_rank") + F.col("w_momentum") * F.col("momentum_rank") + F.col("w_value") * F.col("value_rank"))


def select_capped(scored: DataFrame, partition: list[str], k: int = 5, per_group: int | None = 2, group: str = "sector") -> DataFrame:
    """Equal-weight picks, at most ``per_group`` of one group."""
    return capped_top(scored, partition, group, "score", "ticker", k, per_group).withColumn("weight", F.lit(1.0 / k))


def selection_reasons(scored: DataFrame, picks: DataFrame, partition: list[str], per_group: int = 2, group: str = "sector") -> DataFrame:
    """Why each name is or is not held: selected, group cap reached by better names, or outranked."""
    p = picks.select(*partition, "ticker", F.lit(True).alias("selected"))
    d = scored.join(p, [*partition, "ticker"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    w = Window.partitionBy(*partition, group).orderBy(F.col("score").desc(), "ticker").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_above", F.coalesce(F.sum(F.col("selected").cast("int")).over(w), F.lit(0)))
    return d.withColumn("reason", F.when(F.col("selected"), "SELECTED").when(F.col("_above") >= per_group, "GROUP_CAP").otherwise("OUTRANKED")).drop("_above")


def selection_checks(picks: DataFrame, universe: DataFrame, partition: list[str], k: int = 5, per_group: int = 2, group: str = "sector") -> DataFrame:
    """One row per signal: number of picks, cap, membership and duplicates."""
    u = universe.select("ticker", F.lit(1).alias("_in"))
    g = picks.join(u, "ticker", "left").groupBy(*partition, group).agg(F.count("*").alias("_n"), F.countDistinct("ticker").alias("_d"), F.count("_in").alias("_k"))
    s = g.groupBy(*partition).agg(F.sum("_n").alias("picks"), F.max("_n").alias("largest_group"), (F.sum("_n") == F.sum("_d")).alias("no_duplicates"), (F.sum("_n") == F.sum("_k")).alias("in_universe"))
    return s.withColumn("valid", (F.col("picks") == k) & (F.col("largest_group") <= per_group) & F.col("no_duplicates") & F.col("in_universe"))


def rebalance_lines(picks: DataFrame, date: str, capital: float) -> DataFrame:
    """BUY / SELL / INCREASE / REDUCE / HOLD per name against the previous signal."""
    dates = picks.select(date).distinct().withColumn("_next", F.lead(date).over(Window.orderBy(date)))  # signal-date dimension
    now = picks.select(date, "ticker", F.col("weight").alias("target_weight"))
    before = picks.join(F.broadcast(dates), date).where("_next IS NOT NULL").select(F.col("_next").alias(date), "ticker", F.col("weight").alias("previous_weight"))
    j = now.join(before, [date, "ticker"], "full_outer").fillna(0.0, ["target_weight", "previous_weight"])
    delta = F.col("target_weight") - F.col("previous_weight")
    action = (F.when(F.col("previous_weight") == 0, "BUY").when(F.col("target_weight") == 0, "SELL")
              .when(delta > 1e-9, "INCREASE").when(delta < -1e-9, "REDUCE").otherwise("HOLD"))
    return j.withColumns({"delta_value": delta * capital, "action": action})


def execution_days(picks: DataFrame, bars: DataFrame, date: str, within_days: int = 31) -> DataFrame:
    """First session after the signal on which every pick is priced; PENDING while there is none."""
    need = picks.groupBy(date).agg(F.count("*").alias("_need"))
    days = picks.select(date, "ticker", F.explode(F.sequence(F.lit(1), F.lit(within_days))).alias("_o")).withColumn("trade_date", F.date_add(date, F.col("_o")))
    have = days.join(bars.select("ticker", "trade_date"), ["ticker", "trade_date"]).groupBy(date, "trade_date").agg(F.count("*").alias("_have"))
    first = have.join(need, date).where("_have = _need").groupBy(date).agg(F.min("trade_date").alias("execution_date"))
    return need.select(date).join(first, date, "left").withColumn("status", F.when(F.col("execution_date").isNull(), "PENDING").otherwise("EXECUTED"))


def account_curve(picks: DataFrame, bars: DataFrame, date: str) -> DataFrame:
    """Zero-cost curve: inside a period every holding drifts with its price, periods chain by product.

    Only sessions on which all holdings are priced are valued; nothing is filled forward.
    """
    ex = execution_days(picks, bars, date).where("status = 'EXECUTED'").select(date, "execution_date")
    ex = ex.withColumn("next_execution", F.lead("execution_date").over(Window.orderBy(date)))  # signal-date dimension
    h = picks.join(F.broadcast(ex), date).select(date, "ticker", "weight", "execution_date", "next_execution")
    b = bars.select("ticker", "trade_date", "close")
    cond = (F.col("b.ticker") == F.col("h.ticker")) & (F.col("trade_date") >= F.col("execution_date")) & (F.col("next_execution").isNull() | (F.col("trade_date") <= F.col("next_execution")))
    j = h.alias("h").join(b.alias("b"), cond).select(date, F.col("h.ticker").alias("ticker"), "weight", "execution_date", "trade_date", "close")
    start = j.where("trade_date = execution_date").select(date, "ticker", F.col("close").alias("_start"))
    n = picks.groupBy(date).agg(F.count("*").alias("_need"))
    g = (j.join(start, [date, "ticker"]).groupBy(date, "trade_date").agg(F.sum(F.col("weight") * F.col("close") / F.col("_start")).alias("growth"), F.count("*").alias("_have"), F.sum("weight").alias("_w"))
         .join(n, date).where("_have = _need").withColumn("growth", F.col("growth") + (1 - F.col("_w"))))
    ends = g.groupBy(date).agg(F.max_by("growth", "trade_date").alias("_end"))
    before = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(date, F.coalesce(F.exp(F.sum(F.log("_end")).over(before)), F.lit(1.0)).alias("_base"))
    return g.join(F.broadcast(ends), date).select(date, "trade_date", (F.col("_base") * F.col("growth")).alias("equity"))


def hold_benchmark(bars: DataFrame) -> DataFrame:
    """Equal-weight hold from each name's first price: month-end value, monthly and cumulative return."""
    first = bars.groupBy("ticker").agg(F.min_by("close", "trade_date").alias("_p0"))
    m = bars.groupBy("ticker", F.last_day("trade_date").alias("month")).agg(F.max_by("close", "trade_date").alias("close"))
    v = m.join(first, "ticker").groupBy("month").agg(F.avg(F.col("close") / F.col("_p0")).alias("value"))
    w = Window.orderBy("month")  # month dimension
    return v.withColumns({"monthly_return": F.col("value") / F.lag("value").over(w) - 1, "cumulative_return": F.col("value") - 1})


def phase_performance(curve: DataFrame, split: Column) -> DataFrame:
    """Return and maximum drawdown of the historical and forward phase of a curve."""
    d = curve.withColumn("phase", F.when(F.col("trade_date") < split, "HISTORICAL").otherwise("FORWARD"))
    w = Window.partitionBy("phase").orderBy("trade_date")
    d = d.withColumns({"_dd": F.col("equity") / F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1})
    return d.groupBy("phase").agg((F.max_by("equity", "trade_date") / F.min_by("equity", "trade_date")).alias("growth"), F.min("_dd").alias("max_drawdown"), F.count("*").alias("days"))


def leave_one_out(scored: DataFrame, partition: list[str], k: int, per_group: int, group: str = "sector", universe: DataFrame | None = None) -> DataFrame:
    """The selection of each signal with one name excluded: ``excluded, <partition>, ticker, pick``.

    With a ``universe`` (``ticker``) every one of its names is excluded from every signal. Without one, ``excluded`` is each
    held name, and null for any other: only the exclusion of a held name changes a selection.
    The names that can move up are among the best ``per_group`` + 1 of each group: per signal the k exclusions
    meet that short list, by equality of the signal. All other exclusions repeat the signal's k picks, one array a signal.
    """
    w = Window.partitionBy(*partition, group).orderBy(F.col("score").desc(), "ticker")
    short = scored.withColumn("_g", F.row_number().over(w)).where(F.col("_g") <= per_group + 1).drop("_g")
    base = capped_top(short, partition, group, "score", "ticker", k, per_group)
    held = base.select(*partition, F.col("ticker").alias("excluded"))
    changed = capped_top(short.join(held, partition).where(F.col("ticker") != F.col("excluded")), ["excluded", *partition], group, "score", "ticker", k, per_group)
    changed = changed.select("excluded", *partition, "ticker", "pick")
    if universe is None:
        return changed.unionByName(base.select(F.lit(None).cast("string").alias("excluded"), *partition, "ticker", "pick"))
    names = universe.select(F.col("ticker").alias("excluded")).where("excluded IS NOT NULL").distinct()
    same = base.groupBy(*partition).agg(F.collect_list(F.struct("ticker", "pick")).alias("_p"))
    same = names.join(F.broadcast(same)).where(~F.array_contains("_p.ticker", F.col("excluded")))  # one row per signal date
    return changed.join(names, "excluded", "left_semi").unionByName(same.select("excluded", *partition, F.explode("_p").alias("p")).select("excluded", *partition, "p.*"))


def breadth_exposure(bars: DataFrame, market: str, sessions: int = 200) -> DataFrame:
    """Share of names above their long average, market trend, and the exposure of four rules."""
    w = over()
    frame = w.rowsBetween(-(sessions - 1), 0)
    d = bars.withColumn("_up", F.when(F.count("close").over(frame) == sessions, F.col("close") > F.avg("close").over(frame)))
    g = d.groupBy("trade_date").agg(F.avg(F.col("_up").cast("double")).alias("breadth"), F.max(F.when(F.col("ticker") == market, F.col("_up"))).alias("market_up"), F.bool_or("_up").alias("any_up"))
    weak = F.coalesce(~F.col("market_up"), F.lit(False))
    return g.withColumns({
        "market_rule": F.when(weak, 0.5).otherwise(1.0), "all_down_rule": F.when(F.coalesce(~F.col("any_up"), F.lit(False)), 0.0).otherwise(1.0),
        "breadth_rule": F.when(F.col("breadth") < 0.25, 0.25).when(F.col("breadth") < 0.5, 0.5).otherwise(1.0),
        "combined_rule": F.when(weak & (F.col("breadth") < 0.5), 0.25).when(weak | (F.col("breadth") < 0.5), 0.5).otherwise(1.0)})


def rebalance_turnover(lines: DataFrame, date: str, cost_bps: float) -> DataFrame:
    """One-way turnover of each rebalance and its first-order cost drag."""
    t = lines.groupBy(date).agg(F.sum(F.abs(F.col("target_weight") - F.col("previous_weight"))).alias("gross_turnover"))
    return t.withColumns({"cost_drag": F.col("gross_turnover") * cost_bps / 10_000})


def group_weight_maxima(picks: DataFrame, date: str, group: str = "sector") -> DataFrame:
    """Largest group and single-name weight of each signal."""
    g = picks.groupBy(date, group).agg(F.sum("weight").alias("_g"), F.max("weight").alias("_s"))
    return g.groupBy(date).agg(F.max("_g").alias("largest_group_weight"), F.max("_s").alias("largest_name_weight"))


def prefer_saved(computed: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """Saved picks of a signal replace the computed ones where they exist."""
    have = saved.select(*keys).distinct().withColumn("_saved", F.lit(True))
    kept = computed.join(have, keys, "left_anti").withColumn("origin", F.lit("COMPUTED"))
    return kept.unionByName(saved.withColumn("origin", F.lit("SAVED")), allowMissingColumns=True)
