"""Trailing and forward EPS, PE series, distributions, peers, scenarios and estimate revisions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.functions.scalar import change, clamp, premium, ratio, rnd
from marketloom.operators.aggregates import percentile_rank_of
from marketloom.operators.asof import asof_join, first_above, valid_at
from marketloom.operators.series import latest_per_key


def ttm_eps(facts: DataFrame) -> DataFrame:
    """Trailing-twelve-month EPS at every filing date (visible strictly after it).

    In order: the latest full year; that year plus this year's interim minus last year's same
    interim; four continuous quarters.  ``cp`` is the filing date that changed the visible facts.
    No fact is too old: what a date needs is told by the newest period ends visible then.
    """
    key = ["ticker", "period_type", "period_start", "period_end", "fiscal_period"]
    kinds = {"_annual": F.col("period_type") == "annual", "_quarter": F.col("period_type") == "quarter",
             "_interim": (F.col("period_type") == "ytd") | ((F.col("period_type") == "quarter") & (F.col("fiscal_period") == "Q1"))}
    so_far = Window.partitionBy("ticker").orderBy("cp")  # one row per filing date
    cps = facts.groupBy("ticker", F.col("filed_at").alias("cp")).agg(*[F.max(F.when(is_kind, F.col("period_end"))).alias(k) for k, is_kind in kinds.items()])
    cps = cps.withColumns({k: F.max(k).over(so_far) for k in kinds})
    # asked for are the newest year, interims up to the same one a year before, and four quarters with gaps of at most 130 days:
    # a fact is in use from its filing to the day before a newer period of its kind puts it out of reach
    f = facts.drop("fiscal_year")
    for kind, days in {"_annual": 0, "_interim": 430, "_quarter": 390}.items():
        f = first_above(f, cps, ["ticker"], F.date_add("period_end", days), kind, "cp", f"_end{kind}")
    never, always = F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date")
    ends = F.greatest(*[F.when(is_kind, F.coalesce(F.date_sub(f"_end{k}", 1), always)).otherwise(never) for k, is_kind in kinds.items()])
    f = f.withColumn("_until", ends).drop(*[f"_end{k}" for k in kinds])
    seen = valid_at(f, cps.select("ticker", "cp"), ["ticker"], "cp", "filed_at", "_until")
    best = seen.groupBy("cp", *key).agg(F.max_by("value", F.struct("filed_at", -F.col("tag_priority"))).alias("value"))
    e = F.struct(F.col("period_end").alias("end"), F.col("period_type").alias("type"), F.col("fiscal_period").alias("fp"), F.col("value").alias("v"))
    d = best.groupBy("ticker", "cp").agg(F.sort_array(F.collect_list(e), asc=False).alias("f"))
    d = d.withColumns({
        "annual": F.get(F.filter("f", lambda x: x["type"] == "annual"), F.lit(0)),
        "interim": F.filter("f", lambda x: (x["type"] == "ytd") | ((x["type"] == "quarter") & (x["fp"] == "Q1"))),
        "quarters": F.slice(F.filter("f", lambda x: x["type"] == "quarter"), 1, 4)})
    d = d.withColumn("current", F.get(F.filter("interim", lambda x: F.col("annual").isNull() | (x["end"] > F.col("annual.end"))), F.lit(0)))
    d = d.withColumn("prior", F.get(F.filter("interim", lambda x: (x["fp"] == F.col("current.fp")) & F.datediff(F.col("current.end"), x["end"]).between(300, 430)), F.lit(0)))
    continuous = (F.size("quarters") == 4) & F.forall(F.sequence(F.lit(0), F.lit(2)), lambda i: F.datediff(
        F.col("quarters")[i]["end"], F.col("quarters")[i + 1]["end"]).between(60, 130))
    four = F.aggregate("quarters", F.lit(0.0), lambda a, x: a + x["v"])
    has_a, has_c, has_p = (F.col(c).isNotNull() for c in ("annual", "current", "prior"))
    return d.select(
        "ticker", "cp",
        F.when(has_a & ~has_c, F.col("annual.v")).when(has_a & has_p, F.col("annual.v") + F.col("current.v") - F.col("prior.v"))
        .when(~has_a & continuous, four).alias("ttm_eps"),
        F.when(has_a & ~has_c, "LATEST_FY").when(has_a & has_p, "FY_PLUS_YTD_DELTA").when(~has_a & continuous, "FOUR_QUARTERS").alias("ttm_method"))


def static_pe_series(bars: DataFrame, ttm: DataFrame) -> DataFrame:
    """Price over TTM EPS known strictly before each price date; only positive EPS."""
    d = asof_join(bars.select("ticker", "trade_date", "close"), ttm, ["ticker"], "trade_date", "cp", ["ttm_eps", "ttm_method"], strict=True)
    return d.where("ttm_eps > 0").withColumn("pe", rnd(F.col("close") / F.col("ttm_eps"), 6))


def forward_pe_series(bars: DataFrame, ntm: DataFrame) -> DataFrame:
    """Forward PE at each estimate date with the price on or before it; only positive EPS."""
    d = asof_join(ntm.select("ticker", "as_of", "eps_value"), bars, ["ticker"], "as_of", "trade_date", ["close"], matched_ts="price_date")
    return d.where("close IS NOT NULL AND eps_value > 0").withColumn("pe", rnd(F.col("close") / F.col("eps_value"), 6))


def pe_distribution(series: DataFrame, current: DataFrame, minimum: int, date: str = "trade_date") -> DataFrame:
    """Min / p10 / median / p90 / max, percentile of the current value, label and sample quality.

    Samples are one per session, so the exact percentile buffer of a ticker stays small.
    """
    g = series.join(current, "ticker").groupBy("ticker").agg(
        F.count("pe").alias("samples"), rnd(F.min("pe"), 2).alias("minimum"), rnd(F.percentile("pe", 0.1), 2).alias("p10"), rnd(F.percentile("pe", 0.5), 2).alias("median"),
        rnd(F.percentile("pe", 0.9), 2).alias("p90"), rnd(F.max("pe"), 2).alias("maximum"), F.max("current").alias("current"),
        percentile_rank_of("pe", "current").alias("_rank"))
    rank = F.when(F.col("samples") >= minimum, F.col("_rank"))
    g = g.withColumn("_rank", rank)
    r = F.col("_rank")
    label = (F.when(r <= 10, "LOWEST").when(r < 30, "LOW").when(r <= 70, "MIDDLE").when(r < 90, "HIGH").when(r.isNotNull(), "HIGHEST"))
    quality = F.when(F.col("samples") >= 252, "complete").when(F.col("samples") >= minimum, "limited_history").otherwise("insufficient_samples")
    return g.withColumns({"percentile": rnd("_rank", 2), "label": label, "quality": quality}).drop("_rank")


def company_valuation(latest_price: DataFrame, ttm: DataFrame, ntm: DataFrame, annual: DataFrame) -> DataFrame:
    """Static and forward PE, revenue growth, gross margin and an issue list per ticker."""
    t = latest_per_key(ttm, ["ticker"], ["cp"]).select("ticker", "ttm_eps", "ttm_method")
    n = latest_per_key(ntm, ["ticker"], ["as_of"]).select("ticker", "eps_value", "quality_status")
    w = Window.partitionBy("ticker").orderBy("period_end")
    a = annual.withColumns({"_pr": F.lag("revenue").over(w)})
    a = latest_per_key(a, ["ticker"], ["period_end"])
    a = a.select("ticker", change("revenue", "_pr").alias("revenue_growth"), ratio("grossProfit", "revenue").alias("gross_margin"))
    d = latest_price.join(t, "ticker", "left").join(n, "ticker", "left").join(a, "ticker", "left")
    issue = lambda c, text: F.when(c, F.lit(text))
    return d.withColumns({
        "static_pe": rnd(F.when(F.col("ttm_eps") > 0, F.col("close") / F.col("ttm_eps")), 2),
        "forward_pe": rnd(F.when(F.col("eps_value") > 0, F.col("close") / F.col("eps_value")), 2),
        "issues": F.array_compact(F.array(
            issue(F.col("close").isNull(), "NO_PRICE"), issue(F.col("ttm_eps").isNull(), "NO_TTM_EPS"), issue(F.col("ttm_eps") <= 0, "TTM_EPS_NOT_POSITIVE"),
            issue(F.col("eps_value").isNull(), "NO_NTM_EPS"), issue(F.col("eps_value") <= 0, "NTM_EPS_NOT_POSITIVE"),
            issue(F.col("quality_status") == "proxy", "NTM_PROXY"), issue(F.col("quality_status") == "limited_coverage", "LIMITED_COVERAGE")))})


def relative_label(p: Column) -> Column:
    return (F.when(p <= -0.2, "DEEP_DISCOUNT").when(p < -0.05, "DISCOUNT").when(p <= 0.05, "IN_LINE").when(p < 0.2, "PREMIUM").when(p.isNotNull(), "HIGH_PREMIUM"))


def peer_valuation(valuations: DataFrame, peers: DataFrame) -> DataFrame:
    """Medians of the peers' PE, growth and margin, and the target's premium against them."""
    v = valuations.select(F.col("ticker").alias("related_ticker"), "static_pe", "forward_pe", "revenue_growth", "gross_margin")
    m = peers.join(v, "related_ticker").groupBy("ticker").agg(
        *[rnd(F.median(c), 2 if c.endswith("pe") else 6).alias(f"peer_{c}") for c in ("static_pe", "forward_pe", "revenue_growth", "gross_margin")],
        F.count("static_pe").alias("static_samples"), F.count("forward_pe").alias("forward_samples"))
    d = valuations.join(m, "ticker", "left")
    d = d.withColumns({"static_premium": rnd(premium("static_pe", "peer_static_pe"), 6), "forward_premium": rnd(premium("forward_pe", "peer_forward_pe"), 6)})
    return d.withColumns({"static_label": relative_label(F.col("static_premium")), "forward_label": relative_label(F.col("forward_premium")),
                          "static_quality": F.when(F.col("static_samples") >= 2, "complete").otherwise("limited_samples")})


def pe_scenarios(valuations: DataFrame) -> DataFrame:
    """Bear / base / bull prices and the 3 x 3 sensitivity of EPS change by PE change (fixed grid)."""
    steps = F.array(*[F.struct(F.lit(n).alias("eps_case"), F.lit(k).alias("eps_k")) for n, k in (("bear", 0.9), ("base", 1.0), ("bull", 1.1))])
    pes = F.array(*[F.struct(F.lit(n).alias("pe_case"), F.lit(k).alias("pe_k")) for n, k in (("low", 0.8), ("mid", 1.0), ("high", 1.2))])
    d = valuations.where("eps_value > 0 AND forward_pe > 0").select("ticker", "close", "eps_value", "forward_pe", F.explode(steps).alias("e"))
    d = d.select("ticker", "close", "eps_value", "forward_pe", "e.*", F.explode(pes).alias("p")).select("*", "p.*").drop("p")
    price = F.col("eps_value") * F.col("eps_k") * F.col("forward_pe") * F.col("pe_k")
    return d.withColumns({"scenario_price": rnd(price, 4), "upside": rnd(price / F.col("close") - 1, 6)})


def share_consistency(net_income: Column, eps: Column, shares: Column, tolerance: float = 0.05) -> Column:
    """Implied shares (profit / EPS) against the declared ones."""
    implied = F.when(eps != 0, net_income / eps)
    gap = F.abs(implied / shares - 1)
    return F.when(gap.isNull(), "UNAVAILABLE").when(gap <= tolerance, "CONSISTENT").otherwise("INCONSISTENT")


# ---- estimates ---------------------------------------------------------------------------------

def ntm_consensus(rows: DataFrame) -> DataFrame:
    """Next-twelve-months EPS per (ticker, as_of): four continuous quarters, else a blend of two
    fiscal years weighted by days, else the next fiscal year, else an error status."""
    r = rows.where(F.col("period_end") > F.col("as_of"))
    e = F.struct(F.col("period_end").alias("end"), F.col("eps_average").alias("v"), F.col("eps_high").alias("hi"), F.col("eps_low").alias("lo"), F.col("analyst_count").alias("n"))
    pick = lambda h: F.array_sort(F.collect_list(F.when(F.col("horizon") == h, e)))
    d = r.groupBy("ticker", "as_of").agg(pick("fiscal quarter").alias("qa"), pick("fiscal year").alias("y"))
    d = d.withColumn("q", F.slice("qa", 1, 4))
    q, y, as_of = F.col("q"), F.col("y"), F.col("as_of")
    days = lambda a, b: F.datediff(b, a)
    cont = (F.size(q) == 4) & F.forall(F.sequence(F.lit(0), F.lit(2)), lambda i: days(q[i]["end"], q[i + 1]["end"]).between(60, 130))
    y0, y1 = F.get(y, F.lit(0)), F.get(y, F.lit(1))
    span, first = days(y0["end"], y1["end"]), days(as_of, y0["end"])
    blend = span.between(300, 430) & first.between(0, 430)
    proxy = first.between(330, 400)
    w0 = F.least(F.lit(1.0), F.greatest(F.lit(0.0), first / span))
    mix = lambda f: y0[f] * w0 + y1[f] * (1 - w0)
    whole = lambda f: F.when(F.forall(q, lambda x: x[f].isNotNull()), F.aggregate(q, F.lit(0.0), lambda a, x: a + x[f]))
    method = F.when(cont, "FOUR_QUARTER_CONSENSUS").when(F.coalesce(blend, F.lit(False)), "FISCAL_YEAR_BLEND").when(F.coalesce(proxy, F.lit(False)), "NEXT_FISCAL_YEAR_PROXY").otherwise("INSUFFICIENT")
    d = d.withColumn("method", method)
    by = lambda a, b, c: F.when(F.col("method") == "FOUR_QUARTER_CONSENSUS", a).when(F.col("method") == "FISCAL_YEAR_BLEND", b).when(F.col("method") == "NEXT_FISCAL_YEAR_PROXY", c)
    n = by(F.array_min(F.transform(q, lambda x: x["n"])), F.least(y0["n"], y1["n"]), y0["n"])
    return d.select(
        "ticker", "as_of", "method", by(whole("v"), mix("v"), y0["v"]).alias("eps_value"), by(whole("hi"), mix("hi"), y0["hi"]).alias("eps_high"),
        by(whole("lo"), mix("lo"), y0["lo"]).alias("eps_low"), n.alias("analyst_count"),
        F.when(F.col("method") == "INSUFFICIENT", "error").when(F.col("method") == "NEXT_FISCAL_YEAR_PROXY", "proxy").when(n < 3, "limited_coverage").otherwise("complete").alias("quality_status"))


def revisions(rows: DataFrame, periods: int = 4) -> DataFrame:
    """7- and 30-day revisions of the periods inside NTM: change only if every period has the older value."""
    w = Window.partitionBy("ticker", "as_of").orderBy("period_end")  # a handful of periods per snapshot
    inc = rows.where("period_end > as_of AND horizon = 'fiscal quarter'").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= periods)
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c))
    g = inc.groupBy("ticker", "as_of").agg(F.sum("eps_average").alias("eps_value"), whole("eps_7d").alias("previous_7d"), whole("eps_30d").alias("previous_30d"),
                                           F.sum(F.coalesce("up_30d", F.lit(0))).alias("up_30d"), F.sum(F.coalesce("down_30d", F.lit(0))).alias("down_30d"))
    total = F.col("up_30d") + F.col("down_30d")
    return g.withColumns({"revision_7d": rnd(change("eps_value", "previous_7d"), 6), "revision_30d": rnd(change("eps_value", "previous_30d"), 6),
                          "breadth_30d": rnd(F.when(total != 0, (F.col("up_30d") - F.col("down_30d")) / total), 6)})


def estimate_history(rows: DataFrame, latest: int = 30) -> DataFrame:
    """Latest snapshots per ticker with their periods nested."""
    p = F.struct("period_end", "horizon", "eps_average", "analyst_count")
    g = rows.groupBy("ticker", "as_of").agg(F.array_sort(F.collect_list(p)).alias("periods"))
    w = Window.partitionBy("ticker").orderBy(F.col("as_of").desc())
    return g.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= latest)
