"""Persistent flow stages: composite score, stage rules, forward validation and reliability."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketloom.functions.scalar import clamp, ratio, rnd, weighted_mean
from marketloom.operators.series import non_overlapping, over, streak, trailing

# Component weights, horizons and the samples a horizon needs.
WEIGHTS = {"daily": 0.65, "active": 0.25, "vwap": 0.10}
HORIZONS = (1, 3, 5, 10, 20)
REQUIRED = {1: 30, 3: 24, 5: 20, 10: 14, 20: 10}
BULLISH = ("ACCELERATED_ACCUMULATION", "ACCUMULATION", "ABSORPTION")
BEARISH = ("DISTRIBUTION_INTO_STRENGTH", "DISTRIBUTION", "ACCELERATED_DISTRIBUTION")


def composite(daily: DataFrame, intraday: DataFrame | None = None) -> DataFrame:
    """Daily score blended with active-tick and VWAP scores where they exist for the day."""
    d = daily.withColumnRenamed("score", "daily_score").withColumnRenamed("confidence", "daily_confidence")
    if intraday is not None:
        i = intraday.select("ticker", "trade_date", F.col("active_ratio"), F.col("price_vs_vwap"),
                            F.col("confidence").alias("tick_confidence"), F.col("data_level"))
        d = d.join(i, ["ticker", "trade_date"], "left")
    else:
        d = d.withColumns({"active_ratio": F.lit(None).cast("double"), "price_vs_vwap": F.lit(None).cast("double"),
                           "tick_confidence": F.lit(None).cast("double"), "data_level": F.lit(None).cast("string")})
    usable = F.coalesce(F.col("data_level").startswith("TICK_DIRECTION"), F.lit(False)) & F.col("active_ratio").isNotNull()
    d = d.withColumns({"tick_usable": usable, "has_vwap": F.col("price_vs_vwap").isNotNull()})
    active = F.when(F.col("tick_usable"), clamp(F.col("active_ratio") * 100, -100, 100))
    vwap = clamp(F.col("price_vs_vwap") * 2000, -100, 100)
    parts = [(F.col("daily_score"), WEIGHTS["daily"]), (active, WEIGHTS["active"]), (vwap, WEIGHTS["vwap"])]
    return d.withColumn("score", rnd(clamp(weighted_mean(parts), -100, 100), 2))


def stages(comp: DataFrame) -> DataFrame:
    """Stage, direction, persistence and confidence per (ticker, session)."""
    w = over()
    s, f5 = F.col("score"), trailing(5, w)
    n = F.count("score").over(f5)
    d = comp.withColumns({
        "positive_days": F.count_if(s >= 15).over(f5), "negative_days": F.count_if(s <= -15).over(f5), "_n": n,
        "directional_streak": F.when(s >= 15, F.least(streak(s >= 15, w), F.lit(5)))
        .when(s <= -15, F.least(streak(s <= -15, w), F.lit(5))).otherwise(F.lit(0)).cast("int")})
    pos, neg, st = F.col("positive_days"), F.col("negative_days"), F.col("directional_streak")
    rv, r5 = F.col("relative_volume"), F.col("return_5d")
    stage = (F.when(F.col("signal") == "INSUFFICIENT", "INSUFFICIENT")
             .when((r5 >= 0.03) & (s <= -15) & (neg >= 2), "DISTRIBUTION_INTO_STRENGTH")
             .when((r5 <= -0.03) & (s >= 15) & (pos >= 2), "ABSORPTION")
             .when((s >= 40) & (pos >= 3) & (st >= 2) & (rv >= 1.1), "ACCELERATED_ACCUMULATION")
             .when((s <= -40) & (neg >= 3) & (st >= 2) & (rv >= 1.1), "ACCELERATED_DISTRIBUTION")
             .when((s >= 18) & (pos >= 3), "ACCUMULATION").when((s <= -18) & (neg >= 3), "DISTRIBUTION").otherwise("NEUTRAL"))
    d = d.withColumns({"stage": stage, "persistence": F.greatest(pos, neg) / F.col("_n")})
    cap = F.when(F.col("tick_usable"), 82.0).when(F.col("has_vwap"), 75.0).otherwise(72.0)
    conf = F.when(F.col("stage") == "INSUFFICIENT", F.least(F.lit(35.0), F.col("daily_confidence"))).otherwise(F.least(
        cap, F.col("daily_confidence") * 0.65 + F.when(F.col("tick_usable"), F.coalesce("tick_confidence", F.lit(0.0))).otherwise(0.0) * 0.15
        + F.least(F.lit(1.0), F.col("_n") / 5) * 10 + F.col("persistence") * 10))
    return d.withColumns({"direction": stage_direction("stage"), "confidence": rnd(conf, 2),
                          "persistence": rnd(F.col("persistence") * 100, 2)}).drop("_n")


def stage_direction(stage: str) -> Column:
    return F.when(F.col(stage).isin(*BULLISH), "BULLISH").when(F.col(stage).isin(*BEARISH), "BEARISH").otherwise("NEUTRAL")


def validate_forward(staged: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Per horizon: return, favourable / adverse excursion, hit and status, from frames that look ahead."""
    w = over()
    c = F.col("close")
    per = []
    for h in horizons:
        nxt = w.rowsBetween(1, h)
        per.append(F.struct(
            F.lit(h).alias("horizon"), F.lead("trade_date", h).over(w).alias("target_date"), F.lead("close", h).over(w).alias("target_close"),
            F.max("high").over(nxt).alias("hi"), F.min("low").over(nxt).alias("lo")))
    d = staged.withColumn("_h", F.array(*per)).select("ticker", "trade_date", "stage", "direction", "confidence", "close", F.explode("_h").alias("h"))
    d = d.select("ticker", "trade_date", "stage", "direction", "confidence", "close", "h.*")
    excluded = (F.col("direction") == "NEUTRAL") | (F.col("stage") == "INSUFFICIENT")
    matured = ~excluded & F.col("target_date").isNotNull()
    bull = F.col("direction") == "BULLISH"
    ret, up, down = F.col("target_close") / c - 1, F.col("hi") / c - 1, F.col("lo") / c - 1
    zero = F.lit(0.0)
    return d.select(
        "ticker", "trade_date", "horizon", "stage", "direction", "confidence",
        F.when(excluded, "EXCLUDED").when(F.col("target_date").isNull(), "PENDING").otherwise("MATURED").alias("status"),
        F.when(matured, F.col("target_date")).alias("actual_date"), F.when(matured, rnd(ret, 8)).alias("actual_return"),
        F.when(matured, rnd(F.when(bull, F.greatest(zero, up)).otherwise(F.greatest(zero, -down)), 8)).alias("favorable"),
        F.when(matured, rnd(F.when(bull, F.least(zero, down)).otherwise(F.least(zero, -up)), 8)).alias("adverse"),
        F.when(matured, F.when(bull, ret > 0.01).otherwise(ret < -0.01)).alias("hit"))


def mask_as_of(validation: DataFrame, as_of: Column, date: str = "trade_date", actual: str = "actual_date",
               outcome: tuple[str, ...] = ("actual_return", "favorable", "adverse", "hit")) -> DataFrame:
    """Signals up to the as-of date; outcomes that matured later show as PENDING with null values."""
    later = (F.col("status") == "MATURED") & (F.col(actual) > as_of)
    d = validation.where(F.col(date) <= as_of).withColumn("_later", later)
    return d.withColumns({c: F.when(~F.col("_later"), F.col(c)) for c in (actual, *outcome)}
                         | {"status": F.when(F.col("_later"), "PENDING").otherwise(F.col("status"))}).drop("_later")


def reliability(validation: DataFrame) -> DataFrame:
    """Reliability per (ticker, horizon) on non-overlapping matured signals."""
    keys = ["ticker", "horizon"]
    counts = validation.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "MATURED").alias("matured"),
        F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status") == "EXCLUDED").alias("excluded"))
    eff = non_overlapping(validation.where("status = 'MATURED'"), keys, "trade_date", "actual_date")
    signed = F.when(F.col("direction") == "BULLISH", F.col("actual_return")).otherwise(-F.col("actual_return"))
    g = eff.groupBy(*keys).agg(
        F.count("*").alias("effective"), F.count_if("hit").alias("hits"), F.count_if(F.col("favorable") > F.abs("adverse")).alias("_wins"),
        F.avg("confidence").alias("_conf"), F.avg(signed).alias("_fwd"), F.avg("favorable").alias("_mfe"), F.avg("adverse").alias("_mae"))
    d = counts.join(g, keys, "left").fillna(0, ["effective", "hits", "_wins"])
    need = F.coalesce(*[F.when(F.col("horizon") == h, F.lit(n)) for h, n in REQUIRED.items()])
    zero = F.lit(0.0)
    acc, win = ratio(F.col("hits").cast("double"), "effective"), ratio(F.col("_wins").cast("double"), "effective")
    score = rnd(F.coalesce(acc, zero) * 65 + F.coalesce(win, zero) * 10 + F.coalesce("_conf", zero) / 100 * 10
                + F.least(F.lit(1.0), F.col("effective") / need) * 15, 2)
    d = d.withColumns({"required": need, "accuracy": rnd(acc, 6), "average_forward_return": rnd("_fwd", 8),
                       "average_favorable": rnd("_mfe", 8), "average_adverse": rnd("_mae", 8), "reliability_score": score})
    return d.withColumn("status", F.when(F.col("effective") < F.col("required"), "INSUFFICIENT")
                        .when(F.col("reliability_score") >= 85, "PUBLISHED").otherwise("OBSERVE")).drop("_wins", "_conf", "_fwd", "_mfe", "_mae")


def confirmed_transitions(staged: DataFrame) -> DataFrame:
    """Sessions whose stage holds for a second day after a change, with a stable event key."""
    w = over()
    d = staged.withColumns({"_p1": F.lag("stage").over(w), "previous_stage": F.lag("stage", 2).over(w)})
    d = d.where((F.col("stage") == F.col("_p1")) & (F.col("stage") != F.col("previous_stage")) & (F.col("stage") != "INSUFFICIENT"))
    return d.select("ticker", "trade_date", "stage", "previous_stage",
                    F.concat_ws(":", F.lit("BEHAVIOR"), "ticker", F.col("trade_date").cast("string"), "stage").alias("event_key"))


def pending_window(validation: DataFrame, sessions: int = 4) -> DataFrame:
    """The (ticker, session) keys an incremental run must recompute: the newest sessions plus pending signals."""
    days = validation.select("ticker", "trade_date", "status").groupBy("ticker", "trade_date").agg(F.bool_or(F.col("status") == "PENDING").alias("pending"))
    newest = Window.partitionBy("ticker").orderBy(F.col("trade_date").desc())
    return days.withColumn("_r", F.row_number().over(newest)).where(F.col("pending") | (F.col("_r") <= sessions)).select("ticker", "trade_date")
