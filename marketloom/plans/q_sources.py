"""Payload readers (SRC-*) and sinks (SNK-*): payloads are built from the tables by Spark, then read back."""
from pyspark.sql import functions as F

from marketloom.functions.scalar import rnd
from marketloom.operators import quality as Q
from marketloom.plans import sqlviews as S
from marketloom.plans.registry import register
from marketloom.sources import readers as R, sinks as K, views as V
from marketloom.sources.shared import shared_dir

r = S.rnd


def _ts(c):
    return F.unix_timestamp(F.col(c).cast("timestamp")) + 12 * 3600


def charts(spark, d):
    """One chart payload per ticker and month: parallel arrays of at most a month's sessions."""
    b = V.bars(spark, d).withColumn("ts", _ts("trade_date"))
    g = b.groupBy("ticker", F.trunc("trade_date", "month").alias("m")).agg(F.array_sort(F.collect_list(F.struct("ts", "open", "high", "low", "close", "volume"))).alias("a"))
    a = F.col("a")
    quote = F.struct(*[a[c].alias(c) for c in ("open", "high", "low", "close", "volume")])
    result = F.struct(a["ts"].alias("timestamp"), F.struct(F.array(quote).alias("quote"), F.array(F.struct(a["close"].alias("adjclose"))).alias("adjclose")).alias("indicators"))
    return g.select("ticker", F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))).alias("payload"))


@register("src_04_chart_payload", S.sql("bars", f"SELECT ticker, trade_date, {r('close', 6)} AS close, volume FROM bars"))
def chart(spark, d):
    return R.chart_bars(charts(spark, d)).select("ticker", "trade_date", rnd("close", 6).alias("close"), "volume")


@register("src_05_company_facts", S.sql("facts", "SELECT ticker, metric_key, period_start, period_end, filed_at, 0 AS tag_priority, 'quarter' AS period_type, " + r("value", 2) + " AS value FROM facts WHERE metric_key IN ('grossProfit', 'netIncome')"))
def facts(spark, d):
    f = V.facts(spark, d).where("metric_key IN ('grossProfit', 'netIncome')")
    tag = F.when(F.col("metric_key") == "grossProfit", "GrossProfit").otherwise("NetIncomeLoss")
    fact = F.struct(F.col("period_start").cast("string").alias("start"), F.col("period_end").cast("string").alias("end"), F.col("value").alias("val"), F.lit("10-Q").alias("form"), F.col("filed_at").cast("string").alias("filed"))
    p = f.select("ticker", F.to_json(F.struct(F.create_map(F.lit("us-gaap"), F.create_map(tag, F.struct(F.create_map(F.lit("USD"), F.array(fact)).alias("units")))).alias("facts"))).alias("payload"))
    return R.company_facts(p).select("ticker", "metric_key", "period_start", "period_end", "filed_at", "tag_priority", "period_type", rnd("value", 2).alias("value"))


@register("src_06_submissions", S.sql("filings", "SELECT accession_number, ticker, filed_at, items FROM filings WHERE filed_at >= DATE '1996-01-01'"))
def submissions(spark, d):
    f = V.filings(spark, d).withColumn("form", F.when(F.col("filed_at") >= F.lit("1996-01-01").cast("date"), "8-K").otherwise("4"))
    g = f.groupBy("ticker", "filed_at").agg(F.collect_list(F.struct("accession_number", "form", "items")).alias("a"))
    a = F.col("a")
    rec = F.struct(a["accession_number"].alias("accessionNumber"), a["form"].alias("form"), F.transform(a, lambda x: F.col("filed_at").cast("string")).alias("filingDate"), a["items"].alias("items"))
    p = g.select("ticker", F.to_json(F.struct(F.struct(rec.alias("recent")).alias("filings"))).alias("payload"))
    return R.submissions(p).select("accession_number", "ticker", "filed_at", "items")


@register("src_07_estimates", S.sql("estimates", f"SELECT ticker, as_of, horizon, period_end, {r('eps_average', 4)} AS eps_average, analyst_count FROM estimates"))
def estimates(spark, d):
    e = F.struct(F.col("period_end").cast("string").alias("date"), F.upper("horizon").alias("horizon"), F.col("eps_average").cast("string").alias("eps_estimate_average"), F.col("analyst_count").cast("string").alias("eps_estimate_analyst_count"))
    junk = F.struct(F.lit("2024-02-30").alias("date"), F.lit("fiscal month").alias("horizon"), F.lit("x").alias("eps_estimate_average"), F.lit("").alias("eps_estimate_analyst_count"))
    p = V.estimates(spark, d).select("ticker", "as_of", F.to_json(F.struct(F.array(e, junk).alias("estimates"))).alias("payload"))
    return R.estimate_rows(p).select("ticker", "as_of", "horizon", "period_end", rnd("eps_average", 4).alias("eps_average"), "analyst_count")


def _doc(spark, d):
    return V.table(spark, d, "documents").select("doc_id", V.ticker_of("doc_id").alias("ticker"), F.col("text").alias("title"), "source", (F.lit(1704067200) + F.col("doc_id") * 3600).alias("ts"))


@register("src_08_news_feed", S.sql("articles", "SELECT ticker, length(trim(title)) AS n, publisher, 0.9e0 AS relevance FROM articles WHERE trim(title) <> ''"))
def feed(spark, d):
    x = _doc(spark, d)
    a = F.struct("title", F.concat(F.lit("https://news.example.com/"), F.col("doc_id").cast("string")).alias("url"), F.date_format(F.timestamp_seconds("ts"), "yyyyMMdd'T'HHmmss").alias("time_published"), "source",
                 F.array(F.struct(F.lower("ticker").alias("ticker"), F.lit("0.9").alias("relevance_score"), F.lit("-0.2").alias("ticker_sentiment_score"))).alias("ticker_sentiment"))
    p = x.select(F.to_json(F.struct(F.array(a).alias("feed"))).alias("payload"))
    return R.news_feed(p).select("ticker", F.length("title").alias("n"), F.col("source_name").alias("publisher"), "relevance")


@register("src_09_search_news", S.sql("articles", "SELECT ticker, length(trim(title)) AS n, 1e0 AS relevance, 'example.com' AS source_domain FROM articles WHERE trim(title) <> ''"))
def search(spark, d):
    a = F.struct(F.col("doc_id").cast("string").alias("uuid"), "title", F.lit("https://www.example.com/x").alias("link"), F.col("source").alias("publisher"), F.col("ts").alias("providerPublishTime"), F.array("ticker").alias("relatedTickers"))
    p = _doc(spark, d).select("ticker", F.lit("").alias("name"), F.to_json(F.struct(F.array(a).alias("news"))).alias("payload"))
    return R.search_news(p).select("ticker", F.length("title").alias("n"), "relevance", "source_domain")


@register("src_10_discussions", "SELECT doc_id AS id, CAST(doc_id % 7 + 2 * (doc_id % 3) AS DOUBLE) AS engagement, 'SOCIAL' AS source_tier FROM documents")
def hits(spark, d):
    a = F.struct(F.col("doc_id").cast("string").alias("objectID"), F.concat(F.lit("$"), F.col("ticker"), F.lit(" "), "title").alias("title"), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
                 (F.col("doc_id") % 7).alias("points"), (F.col("doc_id") % 3).alias("num_comments"))
    p = _doc(spark, d).select("ticker", F.lit("").alias("name"), F.to_json(F.struct(F.array(a).alias("hits"))).alias("payload"))
    return R.discussions(p).select(F.col("item_id").cast("long").alias("id"), "engagement", "source_tier")


@register("src_11_rss", "SELECT doc_id AS id, 'T' || lpad(CAST(doc_id % 10 AS VARCHAR), 2, '0') || ' & \"co\"' AS title, 'reuters.com' AS source_domain, 'TIER_1' AS source_tier FROM documents")
def rss(spark, d):
    x = _doc(spark, d)
    xml = F.concat(F.lit("<rss><item><title>"), F.col("ticker"), F.lit(" &amp; &quot;co&quot; - Wire</title><link>https://x.example.com/a</link><guid>"), F.col("doc_id").cast("string"),
                   F.lit("</guid><pubDate>"), F.date_format(F.timestamp_seconds("ts"), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(' GMT</pubDate><source url="https://www.reuters.com/">Wire</source></item></rss>'))
    return R.rss_items(x.select("ticker", F.lit("").alias("name"), xml.alias("payload"))).select(F.col("item_id").cast("long").alias("id"), "title", "source_domain", "source_tier")


@register("src_12_fx_series", S.sql("macro_bars", f"SELECT trade_date AS day, {r('close', 6)} AS close FROM macro_bars WHERE indicator_key = 'LONG_TREASURY_ETF'"))
def fx(spark, d):
    m = V.macro_bars(spark, d).where("indicator_key = 'LONG_TREASURY_ETF'")
    res = F.struct(F.array(_ts("trade_date")).alias("timestamp"), F.struct(F.array(F.struct(F.array("close").alias("close"))).alias("quote")).alias("indicators"))
    p = m.select(F.lit("TWD").alias("currency"), F.to_json(F.struct(F.struct(F.array(res).alias("result")).alias("chart"))).alias("payload"))
    return R.fx_series(p).select("day", rnd("close", 6).alias("close"))


@register("src_13_split_events", S.sql("quarter_totals", "SELECT ticker, period_end AS split_date, CAST(2 + n % 3 AS DOUBLE) AS ratio, NOT (ticker = 'T03' AND period_end = DATE '1997-03-31') AS genuine FROM quarter_totals"))
def splits(spark, d):
    q = V.quarter_totals(spark, d)
    ev = F.struct(_ts("period_end").alias("date"), (2 + F.col("n") % 3).cast("double").alias("numerator"), F.lit(1.0).alias("denominator"))
    res = F.struct(F.struct(F.create_map(F.lit("k"), ev).alias("splits")).alias("events"))
    p = q.select("ticker", F.to_json(F.struct(F.struct(F.array(res).alias("result")).alias("chart"))).alias("payload"))
    ex = q.where("ticker = 'T03' AND period_end = DATE '1997-03-31'").select("ticker", F.col("period_end").alias("split_date"))
    return R.split_events(p, ex)


@register("src_14_merge_captures", S.sql("bars", f"SELECT ticker, trade_date, CASE WHEN trade_date >= DATE '1998-01-01' THEN {r('close * 2', 6)} ELSE {r('close', 6)} END AS close FROM bars"))
def merge(spark, d):
    b = V.bars(spark, d).select("ticker", "trade_date", "close")
    later = b.where("trade_date >= DATE '1998-01-01'").withColumns({"close": F.col("close") * 2, "fetched_at": F.lit(2)})
    return R.merge_by_fetch(b.withColumn("fetched_at", F.lit(1)), later, ["ticker", "trade_date"]).select("ticker", "trade_date", rnd("close", 6).alias("close"))


@register("src_15_share_records", S.sql("quarter_totals", "SELECT ticker, period_end AS \"end\", period_end + 40 AS known, 0 AS priority, CAST(n AS DOUBLE) * 10 AS value FROM quarter_totals UNION ALL SELECT ticker, period_end, period_end + 40, 1, CAST(n AS DOUBLE) * 20 / CASE WHEN period_end < DATE '1998-03-02' AND period_end + 40 >= DATE '1998-03-02' THEN 2 ELSE 1 END FROM quarter_totals"))
def share_records(spark, d):
    q = V.quarter_totals(spark, d)
    fact = lambda k: F.array(F.struct(F.col("period_end").cast("string").alias("end"), (F.col("n") * k).cast("double").alias("val"), F.date_add("period_end", 40).cast("string").alias("filed"), F.lit("a").alias("accn")))
    unit = lambda k: F.struct(F.create_map(F.lit("shares"), fact(k)).alias("units"))
    p = q.select("ticker", F.to_json(F.struct(F.create_map(F.lit("dei"), F.create_map(F.lit("EntityCommonStockSharesOutstanding"), unit(10)), F.lit("us-gaap"), F.create_map(F.lit("CommonStockSharesOutstanding"), unit(20))).alias("facts"))).alias("payload"))
    sp = q.select("ticker").distinct().select("ticker", F.lit("1998-03-02").cast("date").alias("split_date"), F.lit(2.0).alias("ratio"), F.lit(True).alias("genuine"))
    filings = V.filings(spark, d).select("accession_number", F.lit(None).cast("string").alias("accepted_at"))
    return R.share_records(p, filings, sp).select("ticker", "end", "known", "priority", "value")


@register("snk_01_upsert", S.sql("trades", "SELECT id, CASE WHEN trade_date >= DATE '1999-06-01' THEN quantity + 100 ELSE quantity END AS quantity FROM trades"))
def upsert(spark, d):
    """Two batches written as year partitions; the second overwrites only the partitions it touches."""
    path = shared_dir(spark, "upsert-table")
    t = V.trades(spark, d).select("id", "trade_date", "quantity", F.year("trade_date").alias("year"))
    K.upsert_partitions(spark, path, t, ["id"], "year")
    K.upsert_partitions(spark, path, t.where("trade_date >= DATE '1999-06-01'").withColumn("quantity", F.col("quantity") + 100), ["id"], "year")
    return spark.read.parquet(path).select("id", "quantity")


@register("snk_03_insert_absent", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def absent(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return K.insert_absent(o.where("o_orderstatus = 'F'"), o.unionByName(o), ["o_orderkey"]).select("o_orderkey")


@register("snk_05_retention", S.sql("ticks", "SELECT sequence FROM ticks WHERE trade_date >= (SELECT max(trade_date) FROM ticks) - 7"))
def retention(spark, d):
    t = V.ticks(spark, d)
    last = t.agg(F.max("trade_date").alias("today"))
    return K.keep_recent(t.join(F.broadcast(last)), "trade_date", F.col("today"), 7).select("sequence")


@register("snk_06_versioned_snapshot", S.sql("trades", "SELECT ticker, trade_date AS as_of, sum(quantity) AS quantity, 'v1' AS version FROM trades GROUP BY 1, 2"))
def versioned(spark, d):
    path = shared_dir(spark, "snapshots")
    s = V.trades(spark, d).groupBy("ticker", F.col("trade_date").alias("as_of"), F.year("trade_date").alias("y")).agg(F.sum("quantity").alias("quantity"))
    month = s.withColumn("day", F.col("as_of")).withColumn("as_of", F.trunc("as_of", "year")).drop("y")
    for _ in range(2):  # idempotent: the rerun replaces its own partitions
        K.write_snapshot(month, path, "v1")
    return spark.read.parquet(path).select("ticker", F.col("day").alias("as_of"), "quantity", "version")


@register("snk_07_replace_children", "SELECT o_orderkey, l_linenumber, CASE WHEN o_orderstatus = 'F' THEN l_quantity * 2 ELSE l_quantity END AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def children(spark, d):
    o = V.table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    li = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_quantity").alias("quantity"))
    li = li.join(K.hashed_keys(V.table(spark, d, "orders"), "o_orderkey"), "o_orderkey", "left_semi")
    return K.replace_children(o, li.join(K.hashed_keys(o, "o_orderkey"), "o_orderkey", "left_semi").withColumn("quantity", F.col("quantity") * 2), li, "o_orderkey")


@register("snk_08_definition_versions", S.sql("bars", "SELECT ticker, trade_date, sum(CASE WHEN pos IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY trade_date) AS definition_version FROM (SELECT *, lag(pos) OVER (PARTITION BY ticker ORDER BY trade_date) AS prev FROM (SELECT ticker, trade_date, volume > 60 AS pos FROM bars))"))
def versions(spark, d):
    b = V.bars(spark, d).select("ticker", "trade_date", (F.col("volume") > 60).alias("pos"))
    return K.definition_versions(b, "ticker", "trade_date", ["pos"]).select("ticker", "trade_date", "definition_version")


@register("src_17_freeze", S.sql("bars", "SELECT ticker, trade_date, 'c1' AS capture_id FROM bars WHERE trade_date <= DATE '1999-12-31'"))
def freeze(spark, d):
    path = shared_dir(spark, "freeze")
    K.freeze(V.bars(spark, d).select("ticker", "trade_date"), "trade_date", F.lit("1999-12-31").cast("date"), path, "c1")
    return spark.read.parquet(path).select("ticker", "trade_date", "capture_id")


@register("src_02_csv_round_trip", S.sql("bars", f"SELECT trade_date, {r('close', 6)} AS close FROM bars WHERE ticker = 'T01'"))
def csv(spark, d):
    """snk_04 export and src_02 read of one ticker's bars."""
    path = shared_dir(spark, "csv")
    K.export(V.bars(spark, d).where("ticker = 'T01'").select(F.col("trade_date").alias("Date"), "open", "high", "low", "close", "volume"), path, "csv")
    return R.read_bars_csv(spark, path).select("trade_date", rnd("close", 6).alias("close"))


def trade_files(spark, d):
    """Orders as import files: three lines before the header, columns in two orders, faulty rows; some files lack a column or the header."""
    o = V.table(spark, d, "orders")
    k, f = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 800)
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    cell = {"交易日期": F.when(k % 5 == 0, "2024-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), "股票代码": F.concat(F.lit("t"), (k % 10).cast("string")), "股票名称": q(F.concat(F.lit("Name, "), k.cast("string"))),
            "交易方向": F.when(k % 7 == 0, "hold").otherwise("买入"), "股数": q(F.lit("1,000")), "成交价": F.when(k % 11 == 0, "n/a").otherwise(q(F.format_number("o_totalprice", 2))), "交易费用": F.lit(""), "备注": F.lit("")}
    orders_ = [list(R.IMPORT_HEADERS), list(R.IMPORT_HEADERS)[::-1], [h for h in R.IMPORT_HEADERS if h != "成交价"]]
    kind = F.when(f % 5 == 3, 2).otherwise(f % 2)
    pick = lambda make: F.when(kind == 2, make(orders_[2])).when(kind == 1, make(orders_[1])).otherwise(make(orders_[0]))
    body = o.select(f.alias("f"), (k + 10).alias("n"), pick(lambda hs: F.concat_ws(",", *[cell[h] for h in hs])).alias("line"))
    head = F.array(F.struct(F.lit(1).cast("long").alias("n"), F.lit("Trades").alias("line")), F.struct(F.lit(2).cast("long").alias("n"), F.lit("").alias("line")), F.struct(F.lit(3).cast("long").alias("n"), F.lit("a,b").alias("line")),
                   F.struct(F.lit(4).cast("long").alias("n"), F.when(F.col("f") % 7 == 6, "no header").otherwise(F.col("h")).alias("line")))
    heads = o.select(f.alias("f"), pick(lambda hs: F.lit(",".join(hs))).alias("h")).distinct().select("f", F.explode(head).alias("x")).select("f", "x.*")
    folder = shared_dir(spark, "trade-files")
    heads.unionByName(body).repartition("f").sortWithinPartitions("f", "n").select("f", "line").write.partitionBy("f").text(folder)
    return folder + "/f=*"


@register("src_03_trade_files", """WITH o AS (SELECT *, o_orderkey // 800 AS f, row_number() OVER (PARTITION BY o_orderkey // 800 ORDER BY o_orderkey) + 4 AS row_no FROM orders)
  SELECT f AS file_no, row_no, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'DATE' END, CASE WHEN o_orderkey % 7 = 0 THEN 'SIDE' END, CASE WHEN o_orderkey % 11 = 0 THEN 'PRICE' END) AS errors, 'Name, ' || o_orderkey AS name, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS price FROM o WHERE f % 5 <> 3 AND f % 7 <> 6
  UNION ALL SELECT f, 0, CASE WHEN f % 7 = 6 THEN 'NO_HEADER' ELSE 'MISSING:成交价' END, NULL, NULL FROM o WHERE f % 5 = 3 OR f % 7 = 6 GROUP BY f""")
def import_files(spark, d):
    rows, faults = R.read_trade_import(spark, trade_files(spark, d))
    number = F.regexp_extract("file", "f=([0-9]+)", 1).cast("long").alias("file_no")
    checked = Q.validate_import(rows, ("file",)).select(number, "row_no", F.array_join("errors", ",").alias("errors"), "name", F.col("price_n").alias("price"))
    return checked.unionByName(faults.select(number, F.lit(0).alias("row_no"), F.col("error").alias("errors"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("price")))
