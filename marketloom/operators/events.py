"""Official filing events, event lists, severity rules and alert selection."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Form 8-K item -> (label, severity).
ITEM_RULES = [
    ("1.01", "Entry into a material definitive agreement", "P3"), ("1.02", "Termination of a material definitive agreement", "P1"),
    ("1.03", "Bankruptcy or receivership", "P0"), ("1.04", "Mine safety", "P2"), ("2.01", "Completion of acquisition or disposition", "P2"),
    ("2.02", "Results of operations", "P2"), ("2.03", "Creation of a direct financial obligation", "P2"), ("2.04", "Triggering events accelerating an obligation", "P1"),
    ("2.05", "Costs of exit or disposal", "P2"), ("2.06", "Material impairments", "P1"), ("3.01", "Notice of delisting", "P1"),
    ("3.02", "Unregistered sales of equity", "P2"), ("3.03", "Modification to rights of holders", "P2"), ("4.01", "Change of accountant", "P2"),
    ("4.02", "Non-reliance on financial statements", "P1"), ("5.01", "Change in control", "P2"), ("5.02", "Departure or election of officers", "P2"),
    ("5.03", "Amendments to articles", "P3"), ("5.07", "Shareholder votes", "P3"), ("7.01", "Regulation FD disclosure", "P3"),
    ("8.01", "Other events", "P3"), ("9.01", "Financial statements and exhibits", "P3"),
]
SEVERITY_ORDER = ("P0", "P1", "P2", "P3")


def item_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ITEM_RULES, "item string, label string, severity string")


def item_codes(text: Column | str) -> Column:
    """Distinct item codes of a free-text list, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\d+\.\d+)\b"), F.lit(1)))


def classify_filings(filings: DataFrame) -> DataFrame:
    """Event type and severity of a filing, one row per accession number: the worst item decides, the first listed wins ties."""
    rank = F.create_map(*[F.lit(v) for code, _, severity in ITEM_RULES for v in (code, severity)])
    worst = F.array_min(F.transform("_codes", lambda x, i: F.struct(F.coalesce(F.try_element_at(rank, x), F.lit("P3")).alias("severity"), i.alias("pos"), x.alias("item"))))
    d = filings.dropDuplicates(["accession_number"]).withColumn("_codes", F.coalesce(item_codes("items"), F.array().cast("array<string>"))).withColumn("p", worst)
    return d.select(*filings.columns, F.size("_codes").cast("long").alias("item_count"), F.coalesce("p.severity", F.lit("P3")).alias("severity"), F.col("p.item").alias("primary_item"),
                    F.coalesce(F.concat(F.lit("SEC_8K_ITEM_"), F.replace("p.item", F.lit("."), F.lit("_"))), F.lit("SEC_8K_UNSPECIFIED")).alias("event_type"))


def index_events(filings: DataFrame, existing_keys: DataFrame) -> DataFrame:
    """Filing events with a stable key and a flag for those not indexed before."""
    e = classify_filings(filings).withColumn("event_key", F.concat_ws(":", F.lit("SEC_8K"), "accession_number"))
    seen = existing_keys.select("event_key").distinct().withColumn("_seen", F.lit(True))
    return e.join(seen, "event_key", "left").withColumn("is_new", F.col("_seen").isNull()).drop("_seen")


def official_alerts(events: DataFrame, first_sync: DataFrame) -> DataFrame:
    """New P0/P1 filing events dated after a ticker's first back-fill."""
    e = events.where(F.col("is_new") & F.col("severity").isin("P0", "P1"))
    return e.join(first_sync, "ticker").where(F.col("filed_at") > F.col("first_sync")).drop("first_sync")


def event_direction(source_type: str = "source_type", direction: str = "direction", severity: str = "severity") -> Column:
    """-1, 0 or 1: risk news and severe official filings are negative, impact news follows its tag."""
    s = F.col(source_type)
    return (F.when(s == "NEWS_RISK", -1)
            .when(s == "NEWS_IMPACT", F.when(F.col(direction) == "POSITIVE", 1).when(F.col(direction) == "NEGATIVE", -1).otherwise(0))
            .when((s == "SEC_8K") & F.col(severity).isin("P0", "P1"), -1).otherwise(0))


def trailing_event_features(events: DataFrame, points: DataFrame, days: int = 30) -> DataFrame:
    """Signed severity sum and counts over the trailing window of each (ticker, as_of).

    Events are summed per day first (combinable), so a window is a range frame over one row
    per ticker and day however many events a day has.
    """
    magnitude = F.when(F.col("severity") == "P0", 1.0).when(F.col("severity") == "P1", 0.75).when(F.col("severity") == "P2", 0.4).otherwise(0.15)
    dirn = event_direction()
    official = (F.col("source_type") == "SEC_8K") & F.col("severity").isin("P0", "P1")
    proxy = F.col("relation_type").isin("INDUSTRY_PROXY", "SUPPLY_CHAIN_PROXY")
    names = ["score", "events", "positive", "negative", "official_high_risk", "proxy"]
    daily = events.groupBy("ticker", F.col("event_date").alias("day")).agg(
        F.sum((dirn * magnitude).cast("decimal(20,4)")).alias("score"), F.count("*").alias("events"), F.count_if(dirn > 0).alias("positive"),
        F.count_if(dirn < 0).alias("negative"), F.count_if(official).alias("official_high_risk"), F.count_if(proxy).alias("proxy"))
    p = points.select("ticker", F.col("as_of").alias("day")).distinct().withColumn("_p", F.lit(True))
    u = daily.join(p, ["ticker", "day"], "full_outer").withColumn("_d", F.unix_date("day"))
    w = Window.partitionBy("ticker").orderBy("_d").rangeBetween(-days, 0)
    u = u.withColumns({n: F.coalesce(F.sum(n).over(w), F.lit(0)) for n in names})
    score = F.least(F.greatest(F.col("score").cast("double"), F.lit(-1.0)), F.lit(1.0))
    return u.where("_p").select("ticker", F.col("day").alias("as_of"), score.alias("event_score"), *names[1:])


def weighted_event_context(events: DataFrame, points: DataFrame, horizon: int) -> DataFrame:
    """Event score with severity x recency x source x relation weights for each (ticker, as_of).

    Recency is linear in the event's age (floored at a quarter), so the window sum is built from
    daily sums of the age-independent weight, one row per event day and point.
    """
    lookback = min(90, max(14, round(horizon / 2)))
    sev = F.when(F.col("severity") == "P0", 100).when(F.col("severity") == "P1", 75).when(F.col("severity") == "P2", 45).otherwise(20)
    src = (F.when(F.col("source_type") == "SEC_8K", 1.0).when(F.col("source_tier") == "TIER_1", 0.9)
           .when(F.col("source_tier") == "SOCIAL", 0.35).otherwise(0.65))
    rel = F.when(F.col("relation_type") != "DIRECT", 0.65).otherwise(1.0)
    critical = (F.col("source_type") == "SEC_8K") & F.col("severity").isin("P0", "P1")
    daily = events.groupBy("ticker", "event_date").agg(
        F.sum((event_direction() * sev * src * rel).cast("decimal(24,6)")).alias("_w"), F.sum((src * rel).cast("decimal(24,6)")).alias("_q"),
        F.count("*").alias("_n"), F.count_if(critical).alias("_c"), F.count_if((F.col("source_type") == "NEWS_RISK") & (F.col("severity") == "P1")).alias("_u"))
    days = points.select("ticker", "as_of", F.explode(F.sequence(F.lit(0), F.lit(lookback))).alias("_age")).withColumn("event_date", F.date_sub("as_of", F.col("_age")))
    recency = F.greatest(F.lit(0.25), 1 - F.col("_age") / (lookback + 1))
    j = days.join(daily, ["ticker", "event_date"])
    g = j.groupBy("ticker", "as_of").agg(F.sum((F.col("_w").cast("double") * recency).cast("decimal(24,8)")).cast("double").alias("total"),
                                         (F.sum("_q").cast("double") / F.sum("_n") * 100).alias("evidence_quality"), F.sum("_n").alias("events"),
                                         F.sum("_c").alias("official_critical"), F.sum("_u").alias("unverified_high_risk"))
    return g.withColumn("event_score", F.least(F.greatest("total", F.lit(-100.0)), F.lit(100.0))).drop("total")


def event_list(events: DataFrame, since: Column, severities: tuple[str, ...]) -> DataFrame:
    """Filtered event listing with the severity counts of its ticker."""
    e = events.where((F.col("event_date") >= since) & F.col("severity").isin(*severities))
    n = e.groupBy("ticker").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in SEVERITY_ORDER])
    return e.join(n, "ticker")
