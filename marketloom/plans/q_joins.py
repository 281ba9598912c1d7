"""Joins (JOIN-*)."""
from pyspark.sql import Window, functions as F

from marketloom.functions.scalar import rnd
from marketloom.operators import asof as O, events as EV
from marketloom.operators.series import latest_per_key, over
from marketloom.plans import sqlviews as S
from marketloom.plans.registry import register
from marketloom.sources import views as V

r = S.rnd
KEY = ["ticker", "trade_date"]


@register("join_01_inner", S.sql("articles securities", "SELECT a.doc_id, s.name, s.sector FROM articles a JOIN securities s USING (ticker)"))
def inner(spark, d):
    return V.articles(spark, d).select("doc_id", "ticker").join(V.securities(spark, d), "ticker").select("doc_id", "name", "sector")


@register("join_02_left", "SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def left(spark, d):
    return V.table(spark, d, "documents").select("doc_id", "lang").join(V.table(spark, d, "labels"), "doc_id", "left").select("doc_id", "lang", "quality")


@register("join_03_latest_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest(spark, d):
    o = V.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return latest_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@register("join_04_semi_and_flag", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT') AS has_urgent FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def semi(spark, d):
    o, c = V.table(spark, d, "orders"), V.table(spark, d, "customer").select("c_custkey")
    urgent = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("u", F.lit(True))
    base = c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return base.join(urgent, "c_custkey", "left").select("c_custkey", F.coalesce("u", F.lit(False)).alias("has_urgent"))


@register("join_05_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti(spark, d):
    o = V.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return V.table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@register("join_06_asof", S.sql("trades bars", f"SELECT t.id, t.ticker, b.trade_date AS price_date, {r('b.close', 6)} AS close FROM trades t ASOF LEFT JOIN bars b ON t.ticker = b.ticker AND t.trade_date >= b.trade_date"))
def asof(spark, d):
    t = V.trades(spark, d).select("id", *KEY)
    return O.asof_join(t, V.bars(spark, d), ["ticker"], "trade_date", "trade_date", ["close"], matched_ts="price_date",
                       bucket=lambda x: F.trunc(x, "month")).select("id", "ticker", "price_date", rnd("close", 6).alias("close"))


@register("join_07_asof_strict_tolerance", S.sql("trades bars", f"SELECT t.id, CASE WHEN t.trade_date - b.trade_date <= 1 THEN b.trade_date END AS price_date, CASE WHEN t.trade_date - b.trade_date <= 1 THEN {r('b.close', 6)} END AS close FROM trades t ASOF LEFT JOIN bars b ON t.ticker = b.ticker AND t.trade_date > b.trade_date"))
def asof_strict(spark, d):
    t = V.trades(spark, d).select("id", *KEY)
    return O.asof_join(t, V.bars(spark, d), ["ticker"], "trade_date", "trade_date", ["close"], strict=True, tolerance_days=1,
                       matched_ts="price_date").select("id", "price_date", rnd("close", 6).alias("close"))


@register("join_08_nth_forward", S.sql("bars", f"SELECT ticker, trade_date, lead(trade_date, 21) OVER w AS target_date, {r('lead(close, 21) OVER w / close - 1', 6)} AS forward_return FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)"))
def nth_forward(spark, d):
    fwd = lambda c: O.forward_sessions(c, 21, ["ticker"], "trade_date")
    return V.bars(spark, d).select(*KEY, fwd("trade_date").alias("target_date"), rnd(fwd("close") / F.col("close") - 1, 6).alias("forward_return"))


@register("join_09_forward_range", S.sql("bars", f"SELECT ticker, trade_date, {r('max(high) OVER f', 6)} AS next_high, {r('min(low) OVER f', 6)} AS next_low FROM bars WINDOW f AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)"))
def forward_range(spark, d):
    f = over().rowsBetween(1, 10)
    return V.bars(spark, d).select(*KEY, rnd(F.max("high").over(f), 6).alias("next_high"), rnd(F.min("low").over(f), 6).alias("next_low"))


@register("join_10_interval", S.sql("relationships trades", "SELECT t.id, t.ticker, r.related_ticker FROM trades t JOIN relationships r ON t.ticker = r.ticker AND r.active_from <= t.trade_date AND (r.active_to IS NULL OR r.active_to >= t.trade_date)"))
def interval(spark, d):
    t = V.trades(spark, d).select("id", *KEY)
    return O.valid_at(V.relationships(spark, d), t, ["ticker"], "trade_date", "active_from", "active_to").select("id", "ticker", "related_ticker")


@register("join_11_nearest", S.sql("estimates bars", """SELECT ticker, as_of, near_trade_date, distance_days FROM (SELECT DISTINCT e.ticker, e.as_of, b.trade_date AS near_trade_date, abs(b.trade_date - e.as_of) AS distance_days FROM estimates e JOIN bars b ON b.ticker = e.ticker AND abs(b.trade_date - e.as_of) <= 7)
  QUALIFY row_number() OVER (PARTITION BY ticker, as_of ORDER BY distance_days, near_trade_date DESC) = 1"""))
def nearest(spark, d):
    a = V.estimates(spark, d).select("ticker", "as_of").distinct()
    b = V.bars(spark, d).select(*KEY)
    return O.nearest_by_day(a, b, ["ticker"], "as_of", "trade_date", 7, "trade_date", ["trade_date"])


@register("join_15_fuzzy_priority", S.sql("articles", """SELECT a.doc_id, coalesce(x.doc_id, y.doc_id) AS matched_id, CASE WHEN x.doc_id IS NOT NULL THEN 'SAME_URL' WHEN y.doc_id IS NOT NULL THEN 'SAME_STORY' END AS rule FROM articles a
  LEFT JOIN (SELECT title, publisher, min(doc_id) AS doc_id FROM articles GROUP BY 1, 2) x ON x.title = a.title AND x.publisher = a.publisher AND x.doc_id < a.doc_id
  LEFT JOIN (SELECT a2.doc_id AS k, min(b.doc_id) AS doc_id FROM articles a2 JOIN articles b ON a2.title = b.title AND b.doc_id < a2.doc_id AND abs(b.published_on - a2.published_on) <= 2 GROUP BY 1) y ON y.k = a.doc_id WHERE x.doc_id IS NOT NULL OR y.doc_id IS NOT NULL"""))
def fuzzy(spark, d):
    from marketloom.operators.news import earlier_match
    a = V.articles(spark, d).select("doc_id", F.sha2("title", 256).alias("story"), "publisher", "published_on")
    return earlier_match(a, "doc_id", url_key=["story", "publisher"], story_key="story", date="published_on", days=2)


@register("join_16_period_alignment", S.sql("facts", f"SELECT ticker, period_end, {r('gp / rev', 6)} AS gross_margin, {r('ni / rev', 6)} AS net_margin FROM (SELECT ticker, period_end, max(value) FILTER (WHERE metric_key = 'revenue') AS rev, max(value) FILTER (WHERE metric_key = 'grossProfit') AS gp, max(value) FILTER (WHERE metric_key = 'netIncome') AS ni FROM facts WHERE version = 0 GROUP BY 1, 2)"))
def alignment(spark, d):
    p = V.facts(spark, d).where("version = 0").groupBy("ticker", "period_end").pivot("metric_key", ["revenue", "grossProfit", "netIncome"]).agg(F.max("value"))
    return p.select("ticker", "period_end", rnd(F.col("grossProfit") / F.col("revenue"), 6).alias("gross_margin"), rnd(F.col("netIncome") / F.col("revenue"), 6).alias("net_margin"))


@register("join_17_year_ago_period", S.sql("quarter_totals", f"""SELECT a.ticker, a.period_end, b.period_end AS prior_end, {r('(a.value - b.value) / abs(b.value)', 6)} AS growth FROM quarter_totals a JOIN quarter_totals b ON a.ticker = b.ticker AND a.period_end - b.period_end BETWEEN 250 AND 470
  QUALIFY row_number() OVER (PARTITION BY a.ticker, a.period_end ORDER BY abs(a.period_end - b.period_end - 365), b.period_end DESC) = 1"""))
def year_ago(spark, d):
    from marketloom.operators.fundamentals import year_ago_period
    q = V.quarter_totals(spark, d)
    j = year_ago_period(q.select("ticker", "period_end", "value"), ["ticker"], 250, 470)
    return j.select("ticker", "period_end", "prior_end", rnd((F.col("value") - F.col("prior_value")) / F.abs("prior_value"), 6).alias("growth"))


@register("join_18_broadcast_lookup", S.sql("filings", "SELECT accession_number, x.item, s.severity FROM (SELECT accession_number, unnest(string_split(items, ',')) AS item FROM filings) x JOIN (VALUES ('1.01','P3'),('1.03','P0'),('2.02','P2'),('4.02','P1'),('5.02','P2'),('9.01','P3')) s(item, severity) ON s.item = x.item"))
def lookup(spark, d):
    f = V.filings(spark, d).select("accession_number", F.explode(F.split("items", ",")).alias("item"))
    return f.join(F.broadcast(EV.item_rules(spark).select("item", "severity")), "item").select("accession_number", "item", "severity")


@register("join_19_scenarios", S.sql("bars", f"SELECT ticker, fee, slip, {r('avg(close * (1 + (fee + slip) / 10000e0))', 4)} AS cost_price FROM bars, (VALUES (5, 5), (10, 20)) v(fee, slip) GROUP BY 1, 2, 3"))
def scenarios(spark, d):
    grid = spark.createDataFrame([(5, 5), (10, 20)], "fee int, slip int")  # fixed cost scenarios
    b = V.bars(spark, d).join(F.broadcast(grid))
    return b.groupBy("ticker", "fee", "slip").agg(rnd(F.avg(F.col("close") * (1 + (F.col("fee") + F.col("slip")) / 10000)), 4).alias("cost_price"))


@register("join_20_scalar_subqueries", S.sql("securities bars trades", "SELECT s.ticker, (SELECT min(trade_date) FROM bars b WHERE b.ticker = s.ticker) AS first_bar, (SELECT max(trade_date) FROM bars b WHERE b.ticker = s.ticker) AS last_bar, (SELECT count(*) FROM trades t WHERE t.ticker = s.ticker) AS trades FROM securities s"))
def scalar(spark, d):
    b = V.bars(spark, d).groupBy("ticker").agg(F.min("trade_date").alias("first_bar"), F.max("trade_date").alias("last_bar"))
    t = V.trades(spark, d).groupBy("ticker").agg(F.count("*").alias("trades"))
    return V.securities(spark, d).select("ticker").join(b, "ticker", "left").join(t, "ticker", "left").fillna(0, ["trades"])
