"""Market tables derived from the generic test tables.

Each function returns one of the engine's logical tables (bars, ticks, trades,
facts, ...) from a directory of parquet files.  They read only the columns they
need and reduce raw rows with map-side-combinable aggregates (``min_by`` /
``max_by`` over an ordering struct) before any window runs, so a key that holds
a third of the raw rows never lands in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketloom.sources.shared import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ticker_of(key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit("T"), F.lpad((key % 10).cast("string"), 2, "0"))


def bar_rows(lineitem: DataFrame) -> DataFrame:
    """The raw rows of ``bars``."""
    return lineitem.select(
        ticker_of("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("trade_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").alias("q"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


BAR_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "px"]


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One OHLCV row per (ticker, trade_date)."""
    order = F.struct(*BAR_ORDER)
    return bar_rows(table(spark, sf_dir, "lineitem")).groupBy("ticker", "trade_date").agg(
        F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", order).alias("close"), F.sum("q").alias("volume"))


def bar_bounds(rows: DataFrame) -> DataFrame:
    """``ticker, trade_date, high, low, volume`` and the ``first`` and ``last`` order of each bar: fixed-size values, so rows are hashed and not sorted."""
    return rows.groupBy("ticker", "trade_date").agg(F.max("px").alias("high"), F.min("px").alias("low"), F.sum("q").alias("volume"), F.min(_place()).alias("first"), F.max(_place()).alias("last"))


def _place() -> Column:
    return F.coalesce(F.col("l_orderkey").cast("long"), F.lit(-2**63))  # a null is the least, as in a struct


def written_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``bars``, written. Only rows of orders that are the first or last of a bar are compared whole, so the raw rows need no sort."""
    lineitem = table(spark, sf_dir, "lineitem")
    bounds = materialize(bar_bounds(bar_rows(lineitem)), "bar-bounds")
    places = bounds.select(F.explode(F.array("first", "last")).alias("place")).distinct()
    order, key = F.struct(*BAR_ORDER), ["ticker", "trade_date"]
    # an order holds rows of other bars too, but none of a bar that come before its first or after its last order
    prices = (bar_rows(lineitem.join(places, _place() == F.col("place"), "left_semi"))
              .groupBy(F.col("ticker").alias("t"), F.col("trade_date").alias("d")).agg(F.min_by("px", order).alias("open"), F.max_by("px", order).alias("close")))
    same = F.col("ticker").eqNullSafe(F.col("t")) & F.col("trade_date").eqNullSafe(F.col("d"))
    return materialize(bounds.join(prices, same).select(*key, "open", "high", "low", "close", "volume"), "bars")


def provider_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bars from two feeds plus manual corrections, before consolidation."""
    b = bars(spark, sf_dir)
    day = F.dayofmonth("trade_date")
    feed_a = b.withColumns({"provider": F.lit("feed_a"), "ingested_at": F.date_add("trade_date", 1)})
    feed_b = b.where(day <= 20).withColumns({
        "provider": F.lit("feed_b"), "close": F.col("close") * 1.0005,
        "ingested_at": F.date_add("trade_date", 2)})
    manual = b.where(day == 15).withColumns({
        "provider": F.lit("manual"), "close": F.col("close") * 0.999,
        "ingested_at": F.col("trade_date")})
    return feed_a.unionByName(feed_b).unionByName(manual)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    et = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        ticker_of("user_id").alias("ticker"), F.col("event_id").alias("sequence"),
        F.col("ts").alias("trade_time"), F.to_date("ts").alias("trade_date"),
        F.col("value").alias("price"), (1 + F.col("event_id") % 50).cast("double").alias("volume"),
        F.when(et.isin("purchase", "click"), "BUY").when(et == "error", "SELL")
        .otherwise("NEUTRAL").alias("direction"))


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-minute bars of the tick stream."""
    t = ticks(spark, sf_dir).withColumn("bar_time", F.date_trunc("minute", "trade_time"))
    order = F.struct("trade_time", "sequence")
    return t.groupBy("ticker", "trade_date", "bar_time").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("volume").alias("volume"))


def tick_day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV of the tick stream, for operators that join ticks to bars."""
    order = F.struct("trade_time", "sequence")
    return ticks(spark, sf_dir).groupBy("ticker", "trade_date").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("volume").alias("volume"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), ticker_of("o_custkey").alias("ticker"),
        F.to_date("o_orderdate").alias("trade_date"),
        F.when(k % 3 == 0, "SELL").otherwise("BUY").alias("side"),
        (1 + k % 7).cast("double").alias("quantity"),
        (F.col("o_totalprice") / 1000).alias("price"), F.lit(1.0).alias("fee"),
        F.col("o_orderpriority").alias("note"))


METRIC_SHARES = {  # metric -> share of the revenue figure, used to derive the other statements
    "grossProfit": 0.4, "operatingIncome": 0.2, "netIncome": 0.1, "operatingCashFlow": 0.15,
    "capitalExpenditure": 0.05,
}


def quarter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, period_start, period_end, value, n): money summed as DECIMAL so order never matters."""
    q = (table(spark, sf_dir, "orders")
         .select(ticker_of("o_custkey").alias("ticker"),
                 F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period_start"),
                 F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
         .groupBy("ticker", "period_start")
         .agg(F.sum("v").cast("double").alias("value"), F.count("*").alias("n")))
    return q.withColumn("period_end", F.date_sub(F.add_months("period_start", 3), 1))


def facts(spark: SparkSession, sf_dir: str, quarters: DataFrame | None = None) -> DataFrame:
    """Quarterly flow facts with a restatement for every fourth order count. ``quarters``: of ``quarter_totals``, if already reduced."""
    e = quarters if quarters is not None else quarter_totals(spark, sf_dir)
    n = (F.col("n") % 20).cast("int")
    base = e.select("ticker", "period_start", "period_end",
                    F.date_add("period_end", n + 30).alias("filed_at"), F.lit(0).alias("version"), "value", "n")
    again = e.where(F.col("n") % 4 == 0).select(
        "ticker", "period_start", "period_end", F.date_add("period_end", n + 120).alias("filed_at"),
        F.lit(1).alias("version"), (F.col("value") * 1.01).alias("value"), "n")
    rows = base.unionByName(again)
    share = (0.9 + (F.col("n") % 7) / 35.0)
    metrics = [F.struct(F.lit("revenue").alias("metric_key"), F.col("value").alias("value"))] + [
        F.struct(F.lit(m).alias("metric_key"), (F.col("value") * s * share).alias("value"))
        for m, s in METRIC_SHARES.items()]
    return (rows.select("ticker", "period_start", "period_end", "filed_at", "version",
                        F.explode(F.array(*metrics)).alias("m"))
            .select("ticker", F.col("m.metric_key").alias("metric_key"), "period_start", "period_end",
                    "filed_at", F.lit(0).alias("tag_priority"), "version", F.col("m.value").alias("value")))


def annual_facts(spark: SparkSession, sf_dir: str, quarters: DataFrame | None = None) -> DataFrame:
    """Annual statements: the sum of four quarters as first filed, and again 90 days after the last restatement."""
    f = facts(spark, sf_dir, quarters).withColumn("y", F.year("period_end"))
    key = ["ticker", "metric_key", "y"]

    def year(rows: DataFrame, version: int, days: int) -> DataFrame:
        g = rows.groupBy(*key).agg(F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("value"), F.max("filed_at").alias("f"), F.count("*").alias("n"), F.max("version").alias("v"))
        g = g.where((F.col("n") == 4) & (F.col("v") == version))
        return g.select("ticker", "metric_key", F.make_date("y", F.lit(1), F.lit(1)).alias("period_start"), F.make_date("y", F.lit(12), F.lit(31)).alias("period_end"),
                        F.date_add("f", days).alias("filed_at"), "value")

    last = f.groupBy(*key, "period_end").agg(F.max_by(F.struct("value", "filed_at", "version"), "version").alias("r")).select(*key, "r.*")
    return year(f.where("version = 0"), 0, 0).unionByName(year(last, 1, 90))


def filing_and_news_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Research events and classified filings in one table, as the event index keeps them."""
    from marketloom.operators.events import classify_filings
    e = research_events(spark, sf_dir).select("ticker", "event_date", "source_type", "severity", "direction", "relation_type", "source_tier")
    return e.unionByName(classify_filings(filings(spark, sf_dir)).select(
        "ticker", F.col("filed_at").alias("event_date"), F.lit("SEC_8K").alias("source_type"), "severity", F.lit("MIXED").alias("direction"), F.lit("DIRECT").alias("relation_type"), F.lit("OFFICIAL").alias("source_tier")))


def industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol that stands for each ticker's industry: the first ticker of its sector."""
    s = securities(spark, sf_dir)
    return s.join(s.groupBy("sector").agg(F.min("ticker").alias("industry")), "sector").select("ticker", "industry")


def eps_facts(spark: SparkSession, sf_dir: str, quarters: DataFrame | None = None) -> DataFrame:
    """Diluted-EPS facts as issuers file them: Q1-Q3 quarters, cumulative YTD at Q2/Q3, the full year."""
    e = ((quarters if quarters is not None else quarter_totals(spark, sf_dir))
         .withColumns({"fy": F.year("period_start"), "qn": F.quarter("period_start"),
                       "eps": F.floor(F.col("value") / 1e4).cast("double") / 100}))
    filed = F.date_add("period_end", (F.col("n") % 20).cast("int") + 30)
    quarter = e.where("qn < 4").select(
        "ticker", "period_start", "period_end", F.lit("quarter").alias("period_type"),
        F.col("fy").alias("fiscal_year"), F.concat(F.lit("Q"), F.col("qn")).alias("fiscal_period"),
        filed.alias("filed_at"), F.col("eps").alias("value"))
    year_start = F.to_date(F.concat_ws("-", F.col("fy").cast("string"), F.lit("01"), F.lit("01")))
    cum = (e.alias("a").join(e.select("ticker", "fy", F.col("qn").alias("q0"), F.col("eps").alias("eps0")).alias("b"),
                             ["ticker", "fy"]).where("q0 <= qn")
           .groupBy("ticker", "fy", "qn", "period_end", "n")
           .agg(F.sum(F.col("eps0").cast("decimal(18,2)")).cast("double").alias("eps"), F.count("*").alias("k"))
           .where("k = qn and qn > 1"))
    cumulative = cum.select(
        "ticker", year_start.alias("period_start"), "period_end",
        F.when(F.col("qn") == 4, "annual").otherwise("ytd").alias("period_type"),
        F.col("fy").alias("fiscal_year"),
        F.when(F.col("qn") == 4, "FY").otherwise(F.concat(F.lit("Q"), F.col("qn"))).alias("fiscal_period"),
        filed.alias("filed_at"), F.col("eps").alias("value"))
    return quarter.unionByName(cumulative).withColumn("tag_priority", F.lit(0))


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly estimate snapshots with five future fiscal quarters each."""
    o = table(spark, sf_dir, "orders").select(
        ticker_of("o_custkey").alias("ticker"), F.last_day(F.to_date("o_orderdate")).alias("as_of"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    m = o.groupBy("ticker", "as_of").agg(
        F.sum("v").cast("double").alias("v"), F.count("*").alias("n"))
    k = F.col("k")
    base = F.floor(F.col("v") / F.col("n") / 1000).cast("double") / 100
    return (m.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5))))
            .select("ticker", "as_of", F.lit("fiscal quarter").alias("horizon"),
                    F.last_day(F.add_months(F.date_trunc("quarter", "as_of"), 3 * k + 2)).alias("period_end"),
                    (base + k * 0.05).alias("eps_average"), (base + k * 0.06).alias("eps_high"),
                    (base + k * 0.04).alias("eps_low"), (F.col("n") % 9).cast("int").alias("analyst_count"),
                    (base + k * 0.05 - 0.01).alias("eps_7d"), (base + k * 0.05 - 0.02 * (F.col("n") % 5 - 2)).alias("eps_30d"),
                    ((F.col("n") + k) % 4).cast("int").alias("up_30d"), (F.col("n") % 3).cast("int").alias("down_30d")))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News articles: the whole document text is the title text (never a prefix of it)."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", ticker_of("doc_id").alias("ticker"), F.col("text").alias("title"),
        F.col("source").alias("publisher"), "lang",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("published_on"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form 8-K filings with an item list per order status and priority."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("A"), k.cast("string")).alias("accession_number"), ticker_of("o_custkey").alias("ticker"),
        F.to_date("o_orderdate").alias("filed_at"),
        F.concat_ws(",", F.when(F.col("o_orderstatus") == "F", "2.02").when(F.col("o_orderstatus") == "O", "5.02"),
                    F.when(F.col("o_orderpriority") == "1-URGENT", "4.02").when(F.col("o_orderpriority") == "2-HIGH", "1.01"),
                    F.when(k % 11 == 0, "1.03"), F.lit("9.01")).alias("items"))


def research_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity-tagged research events from the events table."""
    et = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", ticker_of("user_id").alias("ticker"), F.to_date("ts").alias("event_date"),
        F.when(et == "error", "NEWS_RISK").when(et == "signup", "SEC_8K").otherwise("NEWS_IMPACT").alias("source_type"),
        F.when(F.col("event_id") % 13 == 0, "P0").when(F.col("event_id") % 5 == 0, "P1")
        .when(F.col("event_id") % 2 == 0, "P2").otherwise("P3").alias("severity"),
        F.when(et == "purchase", "POSITIVE").when(et == "view", "NEGATIVE").otherwise("MIXED").alias("direction"),
        F.when(F.col("event_id") % 4 == 0, "INDUSTRY_PROXY").otherwise("DIRECT").alias("relation_type"),
        F.when(F.col("event_id") % 3 == 0, "TIER_1").when(F.col("event_id") % 7 == 0, "SOCIAL")
        .otherwise("TIER_2").alias("source_tier"))


def macro_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five macro indicator series from the line items, one close per indicator and day."""
    li = table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") % 5).alias("i"), F.to_date("l_shipdate").alias("trade_date"),
        F.col("l_discount").cast("decimal(10,4)").alias("d"))
    key = (F.when(F.col("i") == 0, "US10Y_YIELD").when(F.col("i") == 1, "US13W_YIELD")
           .when(F.col("i") == 2, "US10Y_FUTURES").when(F.col("i") == 3, "FED_FUNDS_FUTURES")
           .otherwise("LONG_TREASURY_ETF"))
    s = li.groupBy("i", "trade_date").agg(F.sum("d").cast("double").alias("s"), F.count("*").alias("n"))
    return s.select(key.alias("indicator_key"), "trade_date",
                    (F.when(F.col("i") == 3, 95.0).when(F.col("i").isin(2, 4), 100.0).otherwise(4.0)
                     + F.col("s") / F.col("n")).alias("close"))


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-bounded competitor links between tickers."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", ticker_of("l_suppkey").alias("related_ticker"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", ticker_of("o_custkey").alias("ticker"),
                                              F.to_date("o_orderdate").alias("d"))
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .where("ticker <> related_ticker").groupBy("ticker", "related_ticker")
            .agg(F.min("d").alias("active_from"), F.max("d").alias("last_seen"), F.count("*").alias("n"))
            .select("ticker", "related_ticker", "active_from",
                    F.when(F.col("n") % 2 == 0, F.date_sub("last_seen", 365)).alias("active_to")))


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticker dimension: a name, a group and a sector for every ticker of the supplier table."""
    return (table(spark, sf_dir, "supplier")
            .select(ticker_of("s_suppkey").alias("ticker"), "s_suppkey", "s_name")
            .groupBy("ticker").agg(F.min_by("s_name", "s_suppkey").alias("name"), F.min("s_suppkey").alias("k"))
            .select("ticker", "name", F.concat(F.lit("G"), (F.col("k") % 4).cast("string")).alias("sector")))
