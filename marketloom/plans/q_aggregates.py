"""Aggregations (AGG-*), top-k (TOP-*) and set operations (SET-*)."""
from pyspark.sql import Window, functions as F

from marketloom.functions.scalar import rnd
from marketloom.operators import aggregates as A, series as O
from marketloom.operators.portfolio import signed_quantity
from marketloom.plans import sqlviews as S
from marketloom.plans.registry import register
from marketloom.sources import views as V

r = S.rnd


def money(c):
    return F.sum(F.col(c).cast("decimal(38,6)")).cast("double") if isinstance(c, str) else F.sum(c.cast("decimal(38,6)")).cast("double")


def smoney(e):
    return f"CAST(sum(CAST({e} AS DECIMAL(38,6))) AS DOUBLE)"


@register("agg_01_by_key", S.sql("ticks", f"SELECT ticker, trade_date, count(*) AS n, sum(volume) AS volume, min(price) AS low, max(price) AS high, {smoney('price * volume')} AS turnover FROM ticks GROUP BY 1, 2"))
def by_key(spark, d):
    return V.ticks(spark, d).groupBy("ticker", "trade_date").agg(
        F.count("*").alias("n"), F.sum("volume").alias("volume"), F.min("price").alias("low"), F.max("price").alias("high"),
        money(F.col("price") * F.col("volume")).alias("turnover"))


@register("agg_02_conditional_sums", S.sql("ticks", f"""SELECT ticker, trade_date, {smoney("CASE WHEN direction = 'BUY' THEN price * volume ELSE 0 END")} AS buy_turnover,
  {smoney("CASE WHEN direction = 'SELL' THEN price * volume ELSE 0 END")} AS sell_turnover, count(*) FILTER (WHERE direction = 'BUY') AS buy_count,
  count(*) FILTER (WHERE direction = 'NEUTRAL') AS neutral_count FROM ticks GROUP BY 1, 2"""))
def conditional(spark, d):
    t = F.col("price") * F.col("volume")
    return V.ticks(spark, d).groupBy("ticker", "trade_date").agg(
        money(F.when(F.col("direction") == "BUY", t).otherwise(0)).alias("buy_turnover"),
        money(F.when(F.col("direction") == "SELL", t).otherwise(0)).alias("sell_turnover"),
        F.count_if(F.col("direction") == "BUY").alias("buy_count"), F.count_if(F.col("direction") == "NEUTRAL").alias("neutral_count"))


@register("agg_03_count_distinct", S.sql("articles", "SELECT ticker, count(DISTINCT coalesce(nullif(publisher, ''), lang)) AS publishers, count(DISTINCT lang) AS langs FROM articles GROUP BY 1"))
def distinct_count(spark, d):
    return V.articles(spark, d).groupBy("ticker").agg(
        F.countDistinct(F.coalesce(F.nullif("publisher", F.lit("")), "lang")).alias("publishers"), F.countDistinct("lang").alias("langs"))


_POS = "sum(CASE side WHEN 'BUY' THEN quantity ELSE -quantity END)"


@register("agg_04_having_position", S.sql("trades", f"SELECT ticker, {_POS} AS position FROM trades GROUP BY 1 HAVING {_POS} > 100"))
def having(spark, d):
    return V.trades(spark, d).groupBy("ticker").agg(F.sum(signed_quantity()).alias("position")).where("position > 100")


@register("agg_05_distinct_list", S.sql("articles", "SELECT ticker, string_agg(publisher, ',' ORDER BY publisher) AS publishers FROM (SELECT DISTINCT ticker, publisher FROM articles) GROUP BY 1"))
def distinct_list(spark, d):
    return V.articles(spark, d).groupBy("ticker").agg(F.array_join(F.array_sort(F.collect_set("publisher")), ",").alias("publishers"))


@register("agg_06_mean_stddev", S.sql("bars", f"SELECT ticker, {r('avg(close)', 4)} AS mean_close, {r('stddev_samp(close)', 4)} AS sd_close FROM bars GROUP BY 1"))
def mean_sd(spark, d):
    return V.bars(spark, d).groupBy("ticker").agg(rnd(F.avg("close"), 4).alias("mean_close"), rnd(F.stddev_samp("close"), 4).alias("sd_close"))


@register("agg_07_median", S.sql("ticks", f"SELECT ticker, {r('quantile_cont(price, 0.5)', 6)} AS median_price FROM ticks GROUP BY 1"))
def median(spark, d):
    return A.exact_quantiles(V.ticks(spark, d), ["ticker"], "price", {"m": 0.5}).select("ticker", rnd("m", 6).alias("median_price"))


@register("agg_08_quantiles", "SELECT l_returnflag, " + ", ".join(f"{r(f'quantile_cont(l_extendedprice, {p})', 4)} AS {n}" for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("p100", 1.0))) + " FROM lineitem GROUP BY 1")
def quantiles(spark, d):
    q = A.exact_quantiles(V.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0})
    return q.select("l_returnflag", *[rnd(c, 4).alias(c) for c in ("p10", "p50", "p90", "p100")])


@register("agg_09_percentile_rank", S.sql("bars", f"""SELECT ticker, {r('(count(*) FILTER (WHERE close < cur) + 0.5e0 * count(*) FILTER (WHERE close = cur)) / count(close) * 100', 6)} AS percentile
  FROM bars JOIN (SELECT ticker, arg_max(close, trade_date) AS cur FROM bars GROUP BY 1) USING (ticker) GROUP BY 1"""))
def percentile_rank(spark, d):
    b = V.bars(spark, d)
    cur = b.groupBy("ticker").agg(F.max_by("close", "trade_date").alias("cur"))
    return b.join(cur, "ticker").groupBy("ticker").agg(rnd(A.percentile_rank_of("close", "cur"), 6).alias("percentile"))


@register("agg_10_correlation", S.sql("bars", f"SELECT ticker, {r('corr(close, volume)', 6)} AS price_volume_corr FROM bars GROUP BY 1"))
def correlation(spark, d):
    return V.bars(spark, d).groupBy("ticker").agg(rnd(F.corr("close", "volume"), 6).alias("price_volume_corr"))


@register("agg_12_concentration", S.sql("trades securities", f"""SELECT {r('sum(w * w)', 8)} AS hhi, {r('max(w)', 8)} AS largest_weight, {r('max(sw)', 8)} AS largest_sector FROM
  (SELECT *, sum(w) OVER (PARTITION BY sector) AS sw FROM (SELECT sector, cost / sum(cost) OVER () AS w FROM (SELECT ticker, {smoney("quantity * price")} AS cost FROM trades WHERE side = 'BUY' GROUP BY 1) JOIN securities USING (ticker)))"""))
def concentration(spark, d):
    c = (V.trades(spark, d).where("side = 'BUY'").groupBy("ticker").agg(money(F.col("quantity") * F.col("price")).alias("cost"))
         .join(V.securities(spark, d), "ticker"))
    total = c.agg(F.sum("cost").alias("total"))
    w = c.crossJoin(F.broadcast(total)).withColumn("w", F.col("cost") / F.col("total"))  # one-row total
    sector = w.groupBy("sector").agg(F.sum("w").alias("sw"))
    return w.agg(rnd(A.herfindahl("w"), 8).alias("hhi"), rnd(F.max("w"), 8).alias("largest_weight")).crossJoin(
        F.broadcast(sector.agg(rnd(F.max("sw"), 8).alias("largest_sector"))))


_CAL = """p AS (SELECT d.doc_id, l.quality, d.lang, least(greatest(0.5e0 + (d.n_chars % 100) / 250e0 - 0.2e0, 0.05e0), 0.95e0) AS prob FROM documents d JOIN labels l USING (doc_id))"""


@register("agg_13_error_metrics", "WITH " + _CAL + f""" SELECT lang, count(*) AS n, {r('avg(abs(prob - quality))', 6)} AS mae, {r('avg((prob - quality) * (prob - quality))', 6)} AS brier,
  {r('avg(CASE WHEN abs(prob - quality) <= 0.5e0 THEN 1e0 ELSE 0e0 END)', 6)} AS coverage, {r('1 - avg(abs(prob - quality)) / least(avg(abs(0.5e0 - quality)), avg(abs(quality)))', 6)} AS skill FROM p GROUP BY 1""")
def error_metrics(spark, d):
    p = F.least(F.greatest(0.5 + F.pmod("n_chars", F.lit(100)) / 250 - 0.2, F.lit(0.05)), F.lit(0.95))
    x = V.table(spark, d, "documents").select("doc_id", "lang", p.alias("p")).join(V.table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    err = F.abs(F.col("p") - F.col("quality"))
    return x.groupBy("lang").agg(F.count("*").alias("n"), rnd(F.avg(err), 6).alias("mae"), rnd(F.avg(err * err), 6).alias("brier"),
                                 rnd(F.avg(F.when(err <= 0.5, 1.0).otherwise(0.0)), 6).alias("coverage"),
                                 rnd(1 - F.avg(err) / F.least(F.avg(F.abs(0.5 - F.col("quality"))), F.avg(F.abs("quality"))), 6).alias("skill"))


@register("agg_14_group_statistics", "SELECT coalesce(nullif(lang, ''), 'UNKNOWN') AS key, count(*) AS samples, sum(quality) AS hits, " + r('avg(quality) * 100', 2) + " AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def group_stats(spark, d):
    x = V.table(spark, d, "documents").select("doc_id", "lang").join(V.table(spark, d, "labels"), "doc_id")
    return x.groupBy(F.coalesce(F.nullif("lang", F.lit("")), F.lit("UNKNOWN")).alias("key")).agg(
        F.count("*").alias("samples"), F.sum("quality").alias("hits"), rnd(F.avg("quality") * 100, 2).alias("accuracy")).orderBy(F.col("samples").desc(), "key")


@register("agg_15_rollup_complete", S.sql("trades", f"""SELECT year, month, {smoney('known')} AS known_cash, CASE WHEN max(bad) = 0 THEN {smoney('known')} END AS total_cash, sum(bad) AS incomplete_days FROM
  (SELECT year(trade_date) AS year, month(trade_date) AS month, sum(CAST(quantity * price AS DECIMAL(38,6))) AS known, CASE WHEN count(*) FILTER (WHERE side = 'SELL') = 0 THEN 1 ELSE 0 END AS bad FROM trades GROUP BY 1, 2, trade_date)
  GROUP BY ROLLUP (year, month)"""))
def rollup_complete(spark, d):
    days = V.trades(spark, d).groupBy("trade_date").agg(
        F.sum((F.col("quantity") * F.col("price")).cast("decimal(38,6)")).alias("known"),
        (F.count_if(F.col("side") == "SELL") == 0).cast("int").alias("bad"))
    return days.rollup(F.year("trade_date").alias("year"), F.month("trade_date").alias("month")).agg(
        money("known").alias("known_cash"), A.complete_or_null("known", "bad").cast("double").alias("total_cash"), F.sum("bad").alias("incomplete_days"))


@register("agg_16_category_counts", S.sql("research_events", "SELECT ticker, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE severity = 'P{i}') AS n_p{i}" for i in range(4)) + " FROM research_events GROUP BY 1"))
def category_counts(spark, d):
    return A.histogram_counts(V.research_events(spark, d), ["ticker"], "severity", ["P0", "P1", "P2", "P3"])


@register("agg_17_bool_sections", S.sql("bars", "SELECT ticker, bool_and(high >= low) AS ordered, bool_or(high = low) AS any_flat, bool_and(volume > 10) AS all_liquid FROM bars GROUP BY 1"))
def bools(spark, d):
    return V.bars(spark, d).groupBy("ticker").agg(F.bool_and(F.col("high") >= F.col("low")).alias("ordered"),
                                                  F.bool_or(F.col("high") == F.col("low")).alias("any_flat"), F.bool_and(F.col("volume") > 10).alias("all_liquid"))


@register("agg_18_pivot_metrics", S.sql("facts", "SELECT ticker, period_end, " + ", ".join(f"{r(f'''max(value) FILTER (WHERE metric_key = '{m}')''', 4)} AS {a}" for m, a in (("revenue", "revenue"), ("grossProfit", "gross_profit"), ("netIncome", "net_income"))) + " FROM facts WHERE version = 0 GROUP BY 1, 2"))
def pivot(spark, d):
    p = V.facts(spark, d).where("version = 0").groupBy("ticker", "period_end").pivot("metric_key", ["revenue", "grossProfit", "netIncome"]).agg(F.max("value"))
    return p.select("ticker", "period_end", rnd("revenue", 4).alias("revenue"), rnd("grossProfit", 4).alias("gross_profit"), rnd("netIncome", 4).alias("net_income"))


@register("agg_20_geometric_product", S.sql("bars", f"SELECT ticker, year(trade_date) AS year, {r('exp(sum(ln(1 + volume / 100000)))', 4)} AS growth FROM bars GROUP BY 1, 2"))
def product(spark, d):
    return V.bars(spark, d).groupBy("ticker", F.year("trade_date").alias("year")).agg(rnd(A.geometric_product(1 + F.col("volume") / 100000), 4).alias("growth"))


@register("agg_21_distinct", S.sql("ticks", "SELECT DISTINCT ticker, trade_date, direction FROM ticks"))
def distinct(spark, d):
    return V.ticks(spark, d).select("ticker", "trade_date", "direction").distinct()


# ---- top-k -------------------------------------------------------------------------------------

@register("top_01_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def order_limit(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)


@register("top_03_capped_top", S.sql("bars securities", """SELECT trade_date, ticker, sector, pick FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, ticker) AS pick FROM
  (SELECT *, row_number() OVER (PARTITION BY trade_date, sector ORDER BY volume DESC, ticker) AS g FROM bars JOIN securities USING (ticker)) WHERE g <= 2) WHERE pick <= 5"""))
def capped(spark, d):
    b = V.bars(spark, d).join(V.securities(spark, d), "ticker")
    return A.capped_top(b, ["trade_date"], "sector", "volume", "ticker", 5, 2).select("trade_date", "ticker", "sector", "pick")


@register("top_04_equal_weight", S.sql("bars", f"""SELECT trade_date, ticker, {r('1e0 / 3', 6)} AS weight FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, ticker) AS rn,
  count(*) OVER (PARTITION BY trade_date) AS n FROM bars) WHERE n >= 3 AND rn <= 3"""))
def equal_weight(spark, d):
    from marketloom.operators.factors import equal_weights
    return equal_weights(V.bars(spark, d), ["trade_date"], "volume", "ticker", 3).select("trade_date", "ticker", rnd("weight", 6).alias("weight"))


_ORD = "CASE status WHEN 'SELL' THEN 0 WHEN 'REDUCE' THEN 1 WHEN 'BUY' THEN 2 WHEN 'INCREASE' THEN 3 ELSE 4 END"


@register("top_05_action_order", f"""SELECT o_custkey, actions FROM (SELECT o_custkey, string_agg(status, ',' ORDER BY {_ORD}) AS actions FROM
  (SELECT DISTINCT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'SELL' WHEN 'O' THEN 'BUY' ELSE 'HOLD' END AS status FROM orders) GROUP BY 1)""")
def action_order(spark, d):
    from marketloom.operators.factors import action_priority
    s = F.when(F.col("o_orderstatus") == "F", "SELL").when(F.col("o_orderstatus") == "O", "BUY").otherwise("HOLD")
    a = V.table(spark, d, "orders").select("o_custkey", s.alias("status")).distinct()
    g = a.groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.struct(action_priority("status").alias("p"), "status"))).alias("a"))
    return g.select("o_custkey", F.array_join(F.col("a.status"), ",").alias("actions"))


@register("top_06_best_by_priority", S.sql("facts", f"""SELECT ticker, metric_key, period_end, filed_at, {r('value', 4)} AS value FROM facts
  QUALIFY row_number() OVER (PARTITION BY ticker, metric_key, period_end ORDER BY filed_at DESC, tag_priority) = 1"""))
def best(spark, d):
    f = O.latest_per_key(V.facts(spark, d), ["ticker", "metric_key", "period_end"], ["filed_at", -F.col("tag_priority")])
    return f.select("ticker", "metric_key", "period_end", "filed_at", rnd("value", 4).alias("value"))


@register("top_07_argmax_rule", S.sql("bars securities", """SELECT quarter, arg_max(sector, (score, -prio)) AS winner FROM (SELECT CAST(date_trunc('quarter', trade_date) AS DATE) AS quarter, sector,
  sum(volume) AS score, CAST(substr(sector, 2) AS INT) AS prio FROM bars JOIN securities USING (ticker) GROUP BY 1, 2) GROUP BY 1"""))
def argmax(spark, d):
    b = V.bars(spark, d).join(V.securities(spark, d), "ticker")
    g = b.groupBy(F.to_date(F.date_trunc("quarter", "trade_date")).alias("quarter"), "sector").agg(F.sum("volume").alias("score"))
    return g.groupBy("quarter").agg(F.max_by("sector", F.struct("score", -F.substring("sector", 2, 9).cast("int"))).alias("winner"))


# ---- set operations ----------------------------------------------------------------------------

@register("set_01_union_distinct", S.sql("trades relationships", "SELECT ticker FROM trades UNION SELECT related_ticker FROM relationships"))
def union_distinct(spark, d):
    return V.trades(spark, d).select("ticker").union(V.relationships(spark, d).select("related_ticker")).distinct()


@register("set_02_union_all_max", S.sql("ticks minute_bars", "SELECT ticker, max(trade_date) AS latest FROM (SELECT ticker, trade_date FROM ticks UNION ALL SELECT ticker, trade_date FROM minute_bars WHERE coalesce(volume, 0) > 0) GROUP BY 1"))
def union_max(spark, d):
    from marketloom.operators.ticks import latest_trade_date
    return latest_trade_date(V.ticks(spark, d), V.minute_bars(spark, d))


_PICKS = """p AS (SELECT trade_date, ticker, row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, ticker) AS rv, row_number() OVER (PARTITION BY trade_date ORDER BY close DESC, ticker) AS rc FROM bars)"""


@register("set_03_overlap", S.sql("bars", f"SELECT trade_date, {r('count(*) FILTER (WHERE rv <= 5 AND rc <= 5) / 5e0', 4)} AS overlap FROM p GROUP BY 1", _PICKS))
def overlap(spark, d):
    from marketloom.operators.factors import holdings_overlap
    b = V.bars(spark, d)
    a = A.capped_top(b, ["trade_date"], "ticker", "volume", "ticker", 5, None).select("trade_date", "ticker")
    c = A.capped_top(b, ["trade_date"], "ticker", "close", "ticker", 5, None).select("trade_date", "ticker")
    return holdings_overlap(a, c, ["trade_date"], "ticker", 5).select("trade_date", rnd("overlap", 4).alias("overlap"))


_REB = """m AS (SELECT last_day(trade_date) AS d, ticker, sum(volume) AS v FROM bars GROUP BY 1, 2), p AS (SELECT d, ticker FROM m QUALIFY row_number() OVER (PARTITION BY d ORDER BY v DESC, ticker) <= 5),
dd AS (SELECT d, lag(d) OVER (ORDER BY d) AS prev FROM (SELECT DISTINCT d FROM p))"""


@register("set_04_entered_left", S.sql("bars", """SELECT dd.d AS signal_date, coalesce((SELECT string_agg(ticker, ',' ORDER BY ticker) FROM (SELECT ticker FROM p WHERE p.d = dd.d EXCEPT SELECT ticker FROM p WHERE p.d = dd.prev)), '') AS entered,
  coalesce((SELECT string_agg(ticker, ',' ORDER BY ticker) FROM (SELECT ticker FROM p WHERE p.d = dd.prev EXCEPT SELECT ticker FROM p WHERE p.d = dd.d)), '') AS left_out FROM dd""", _REB))
def entered_left(spark, d):
    from marketloom.operators.factors import membership_changes
    m = V.bars(spark, d).groupBy(F.last_day("trade_date").alias("d"), "ticker").agg(F.sum("volume").alias("v"))
    p = A.capped_top(m, ["d"], "ticker", "v", "ticker", 5, None)
    return membership_changes(p, "d", "ticker").select(F.col("d").alias("signal_date"), F.array_join("entered", ",").alias("entered"), F.array_join("left", ",").alias("left_out"))


@register("set_05_missing_sessions", S.sql("bars", "SELECT t.ticker, c.trade_date FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN (SELECT DISTINCT trade_date FROM bars) c WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.ticker = t.ticker AND b.trade_date = c.trade_date)"))
def missing_sessions(spark, d):
    from marketloom.operators.factors import densify
    return densify(V.bars(spark, d).select("ticker", "trade_date", F.lit(1).alias("x"))).where("x IS NULL").select("ticker", "trade_date")


@register("set_06_full_outer", S.sql("trades articles", "SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.n, 0) AS trades, coalesce(b.n, 0) AS articles FROM (SELECT ticker, count(*) AS n FROM trades GROUP BY 1) a FULL OUTER JOIN (SELECT ticker, count(*) AS n FROM articles GROUP BY 1) b ON a.ticker = b.ticker"))
def full_outer(spark, d):
    a = V.trades(spark, d).groupBy("ticker").agg(F.count("*").alias("a"))
    b = V.articles(spark, d).groupBy("ticker").agg(F.count("*").alias("b"))
    return a.join(b, "ticker", "full_outer").select("ticker", F.coalesce("a", F.lit(0)).alias("trades"), F.coalesce("b", F.lit(0)).alias("articles"))
