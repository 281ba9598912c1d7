"""Readers: payload text columns and files to typed rows, all as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketloom.functions import dates as D, text as T
from marketloom.sources.shared import materialize

# Forms and the tag priority of each metric.
FILING_FORMS = ("10-K", "10-K/A", "10-Q", "10-Q/A", "8-K", "8-K/A")
FACT_FORMS = ("10-K", "10-K/A", "10-Q", "10-Q/A")
METRIC_TAGS = {
    "revenue": ("USD", ["RevenueFromContractWithCustomerIncludingAssessedTax", "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"]),
    "grossProfit": ("USD", ["GrossProfit"]), "operatingIncome": ("USD", ["OperatingIncomeLoss"]), "netIncome": ("USD", ["NetIncomeLoss", "ProfitLoss"]),
    "epsDiluted": ("USD/shares", ["EarningsPerShareDiluted"]), "operatingCashFlow": ("USD", ["NetCashProvidedByUsedInOperatingActivities"]),
    "capitalExpenditure": ("USD", ["PaymentsToAcquirePropertyPlantAndEquipment"]), "shareRepurchases": ("USD", ["PaymentsForRepurchaseOfCommonStock"]),
    "assets": ("USD", ["Assets"]), "liabilities": ("USD", ["Liabilities"]),
    "equity": ("USD", ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"]),
    "cash": ("USD", ["CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"]),
    "dilutedShares": ("shares", ["WeightedAverageNumberOfDilutedSharesOutstanding"])}
BAR_SCHEMA = "trade_date date, open double, high double, low double, close double, volume double"
FACT = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string,frame:string>"


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily OHLCV CSV with a header row and a Date column."""
    df = spark.read.schema(BAR_SCHEMA.replace("trade_date", "Date")).csv(path, header=True, enforceSchema=False)
    return df.withColumnRenamed("Date", "trade_date")


# The headers of the trade template, in its order, and the names that rows get here; limits of a file.
IMPORT_HEADERS = {"交易日期": "date", "股票代码": "ticker", "股票名称": "name", "交易方向": "side", "股数": "shares", "成交价": "price", "交易费用": "fee", "备注": "note"}
IMPORT_BYTES, IMPORT_ROWS, IMPORT_HEADER_ROWS, IMPORT_COLUMNS = 5 * 1024 * 1024, 1000, 10, 64


def read_trade_import(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Trade-import CSV files: rows (``file, row_no`` and the template's columns as text) and faults of whole files (``file, error``).

    The header is the first of a file's first ten lines that has the date and the ticker column; columns may stand in any
    order, others are ignored. Blank rows are skipped, all others kept, whatever is in them. A file over 5 MB, without
    header, with missing columns, without rows or with over 1000 gives no rows but a fault. A file is read as one value, which
    its limit bounds; larger ones are told by their length alone, without reading them. Files without a byte are passed over.
    All files are read and parsed once, into a written table.
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= IMPORT_BYTES).select(F.col("path").alias("file"), F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "").alias("body"))
    names = list(IMPORT_HEADERS)
    parsed = lambda line: F.from_csv(line, ", ".join(f"c{i} string" for i in range(IMPORT_COLUMNS)), {"mode": "PERMISSIVE", "escape": "\""})
    cells = lambda c: F.array(*[c[f"c{i}"] for i in range(IMPORT_COLUMNS)])
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    # a file's first lines show its header; the lines after it are then parsed once, one at a time
    first = F.transform(F.transform(F.slice("lines", 1, IMPORT_HEADER_ROWS), parsed), lambda c, i: F.struct((i + 1).alias("no"), F.transform(cells(c), trimmed).alias("cells")))
    header = F.get(F.filter(first, lambda x: F.array_contains(x["cells"], names[0]) & F.array_contains(x["cells"], names[1])), F.lit(0))
    d = small.select("file", F.split("body", "\r?\n").alias("lines")).select("file", "lines", F.explode(F.array(header)).alias("h"))
    missing = F.array_join(F.array_except(F.array(*map(F.lit, names)), F.col("h.cells")), ",")
    fault = F.when(F.col("h.no").isNull(), "NO_HEADER").when(missing != "", F.concat(F.lit("MISSING:"), missing))
    d = d.select("file", F.col("h.no").alias("no"), F.array(*[F.array_position("h.cells", n).cast("int") for n in names]).alias("at"), fault.alias("fault"), (F.size("lines") - F.col("h.no") > IMPORT_ROWS).alias("long"), F.posexplode("lines").alias("pos", "line"))
    mark = F.col("pos") + 1 == F.coalesce("no", F.lit(1))  # one line of every file stands for the file itself
    d = d.withColumn("mark", mark).where(F.col("mark") | (F.col("fault").isNull() & (F.col("pos") >= F.col("no"))))
    d = d.select("file", "at", "fault", "long", "pos", "mark", parsed(F.col("line")).alias("c")).select("file", "at", "fault", "long", "pos", "mark", cells(F.col("c")).alias("cells"))
    value = lambda i: trimmed(F.element_at("cells", F.get("at", F.lit(i))))
    d = d.select("file", (F.col("pos") + 1).alias("row_no"), "fault", F.coalesce("long", F.lit(False)).alias("long"), "mark", F.explode(F.array(F.struct(*[F.when(F.col("fault").isNull(), value(i)).alias(c) for i, c in enumerate(IMPORT_HEADERS.values())]))).alias("v"))
    d = d.where(F.col("mark") | (F.concat(*[f"v.{c}" for c in IMPORT_HEADERS.values()]) != "")).select("file", "row_no", "fault", "long", "mark", "v.*")
    read = materialize(d, "trade-import")
    per_file = read.groupBy("file").agg(F.max("fault").alias("fault"), F.count_if(~F.col("mark")).alias("n"))
    faults = per_file.select("file", F.when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("n") == 0, "NO_ROWS").when(F.col("n") > IMPORT_ROWS, "TOO_MANY_ROWS").alias("error")).where("error IS NOT NULL")
    faults = faults.unionByName(files.where(F.col("length") > IMPORT_BYTES).select(F.col("path").alias("file"), F.lit("TOO_LARGE").alias("error")))
    rows = read.where(~F.col("mark")).select("file", "row_no", "long", *IMPORT_HEADERS.values())
    full = rows.where("long").join(faults.where("error = 'TOO_MANY_ROWS'").select("file"), "file", "left_anti")
    return rows.where(~F.col("long")).unionByName(full).drop("long"), faults


def chart_bars(payloads: DataFrame) -> DataFrame:
    """Chart payloads (parallel arrays) to daily rows; rows without a close are dropped."""
    q = "struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>"
    s = f"struct<chart:struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<{q}>,adjclose:array<struct<adjclose:array<double>>>>>>>>"
    r = F.from_json("payload", s)["chart"]["result"][0]
    quote = r["indicators"]["quote"][0]
    z = F.arrays_zip(r["timestamp"].alias("ts"), *[quote[c].alias(c) for c in ("open", "high", "low", "close", "volume")], F.get(r["indicators"]["adjclose"], F.lit(0))["adjclose"].alias("adjusted_close"))
    rows = payloads.select("ticker", F.explode(z).alias("b")).where("b.close IS NOT NULL")
    return rows.select("ticker", D.eastern_date(F.timestamp_seconds("b.ts")).alias("trade_date"), "b.open", "b.high", "b.low", "b.close", "b.volume", "b.adjusted_close")


def _tag_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, u, t, i) for m, (u, tags) in METRIC_TAGS.items() for i, t in enumerate(tags)], "metric_key string, unit string, tag string, tag_priority int")


def company_facts(payloads: DataFrame, taxonomies: tuple[str, ...] = ("us-gaap",), tags: DataFrame | None = None) -> DataFrame:
    """Company-facts payloads (taxonomy -> tag -> unit -> facts) to fact rows of the known metrics."""
    s = f"struct<facts:map<string,map<string,struct<label:string,units:map<string,array<{FACT}>>>>>>"
    d = payloads.select("ticker", F.explode(F.from_json("payload", s)["facts"]).alias("taxonomy", "_t")).where(F.col("taxonomy").isin(*taxonomies))
    d = d.select("ticker", "taxonomy", F.explode("_t").alias("tag", "_c")).select("ticker", "taxonomy", "tag", F.explode("_c.units").alias("unit", "_f"))
    d = d.select("ticker", "taxonomy", "tag", "unit", F.explode("_f").alias("f")).select("ticker", "taxonomy", "tag", "unit", "f.*")
    d = d.join(F.broadcast(tags if tags is not None else _tag_table(payloads.sparkSession)), ["tag", "unit"])
    d = d.where(F.col("form").isin(*FACT_FORMS) & F.col("val").isNotNull() & F.col("end").isNotNull() & F.col("filed").isNotNull())
    start, end, filed = (F.col(c).cast("date") for c in ("start", "end", "filed"))
    return d.select("ticker", "metric_key", "tag_priority", "taxonomy", "tag", "unit", start.alias("period_start"), end.alias("period_end"), D.period_class(start, end).alias("period_type"),
                    F.col("fy").alias("fiscal_year"), F.col("fp").alias("fiscal_period"), "form", filed.alias("filed_at"), F.col("accn").alias("accession_number"), F.col("val").alias("value"),
                    T.content_key(*[F.col(c) for c in ("ticker", "taxonomy", "tag", "unit", "start", "end", "fy", "fp", "form", "filed", "accn", "frame", "val")]).alias("source_key"))


def submissions(payloads: DataFrame) -> DataFrame:
    """Submission payloads (parallel arrays) to filing rows of the allowed forms."""
    names = ["accessionNumber", "form", "filingDate", "reportDate", "acceptanceDateTime", "items"]
    s = "struct<filings:struct<recent:struct<" + ",".join(f"{n}:array<string>" for n in names) + ">>>"
    rec = F.from_json("payload", s)["filings"]["recent"]
    d = payloads.select("ticker", F.explode(F.arrays_zip(*[F.coalesce(rec[n], F.array().cast("array<string>")).alias(n) for n in names])).alias("f")).select("ticker", "f.*")
    d = d.where(F.col("form").isin(*FILING_FORMS) & F.col("accessionNumber").isNotNull() & F.col("filingDate").isNotNull())
    return d.select("ticker", F.col("accessionNumber").alias("accession_number"), "form", F.col("filingDate").cast("date").alias("filed_at"), F.col("reportDate").try_cast("date").alias("report_date"),
                    F.col("acceptanceDateTime").alias("accepted_at"), "items")


def estimate_rows(payloads: DataFrame) -> DataFrame:
    """Estimate payloads with string numbers to typed rows; unsupported horizons dropped."""
    fields = ["date", "horizon", "eps_estimate_average", "eps_estimate_high", "eps_estimate_low", "eps_estimate_analyst_count", "eps_estimate_average_7_days_ago", "eps_estimate_average_30_days_ago"]
    s = "struct<estimates:array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>>"
    d = payloads.select("ticker", "as_of", F.explode(F.from_json("payload", s)["estimates"]).alias("e")).select("ticker", "as_of", "e.*")
    num = lambda c: F.col(c).try_cast("double")
    d = d.select("ticker", "as_of", F.lower("horizon").alias("horizon"), D.strict_date("date").alias("period_end"), num("eps_estimate_average").alias("eps_average"), num("eps_estimate_high").alias("eps_high"),
                 num("eps_estimate_low").alias("eps_low"), F.greatest(F.lit(0), F.floor(num("eps_estimate_analyst_count") + 0.5)).cast("int").alias("analyst_count"),
                 num("eps_estimate_average_7_days_ago").alias("eps_7d"), num("eps_estimate_average_30_days_ago").alias("eps_30d"))
    return d.where(F.col("horizon").isin("fiscal quarter", "fiscal year") & F.col("period_end").isNotNull() & F.col("eps_average").isNotNull())


def news_feed(payloads: DataFrame) -> DataFrame:
    """News feed payloads to one row per (article, ticker) with the ticker's relevance and sentiment."""
    s = ("struct<feed:array<struct<title:string,url:string,time_published:string,summary:string,source:string,source_domain:string,overall_sentiment_score:string,"
         "topics:array<struct<topic:string,relevance_score:string>>,ticker_sentiment:array<struct<ticker:string,relevance_score:string,ticker_sentiment_score:string>>>>>")
    d = payloads.select(F.explode(F.from_json("payload", s)["feed"]).alias("a")).select("a.*")
    d = d.withColumns({"published_at": D.compact_timestamp("time_published"), "url": T.valid_http_url("url"), "title": F.trim("title")}).where("published_at IS NOT NULL AND url IS NOT NULL AND title <> ''")
    d = d.withColumn("topics", F.filter(F.transform("topics", lambda t: F.trim(t["topic"])), lambda t: t != ""))
    d = d.select("*", F.explode_outer("ticker_sentiment").alias("k"))
    return d.select(T.content_key(F.lower("url"), F.col("title"), F.col("time_published")).alias("article_key"), "published_at", "title", "summary", F.col("source").alias("source_name"), "source_domain", "url",
                    T.source_tier("source_domain", F.lit("NEWS")).alias("source_tier"), F.col("overall_sentiment_score").try_cast("double").alias("sentiment"), "topics",
                    F.upper(F.trim("k.ticker")).alias("ticker"), F.col("k.relevance_score").try_cast("double").alias("relevance"), F.col("k.ticker_sentiment_score").try_cast("double").alias("ticker_sentiment"))


def _article(d: DataFrame, provider: str, kind: str) -> DataFrame:
    """Common article columns from (item_id, ticker, published_at, title, url, source_name, source_domain, relevance, engagement)."""
    s = T.text_sentiment("title")
    return d.where("title <> '' AND url IS NOT NULL AND published_at IS NOT NULL AND relevance >= 0.35").select(
        F.lit(provider).alias("provider"), F.lit(kind).alias("content_kind"), "item_id", "ticker", "published_at", "title", "url", "source_name", "source_domain",
        T.source_tier("source_domain", F.lit(kind)).alias("source_tier"), "relevance", "engagement", s.alias("sentiment"), T.sentiment_label(s).alias("sentiment_label"))


def search_news(payloads: DataFrame) -> DataFrame:
    """News search payloads; a related ticker is fully relevant, else the text decides."""
    s = "struct<news:array<struct<uuid:string,title:string,link:string,publisher:string,providerPublishTime:bigint,relatedTickers:array<string>>>>"
    d = payloads.select("ticker", "name", F.explode(F.from_json("payload", s)["news"]).alias("n")).select("ticker", "name", "n.*")
    url = T.valid_http_url("link")
    text = F.concat_ws("\n", "title", F.coalesce(url, F.lit("")))
    rel = F.when(F.array_contains("relatedTickers", F.col("ticker")), 1.0).otherwise(T.relevance(text, "ticker", "name"))
    return _article(d.select("ticker", F.coalesce("uuid", url).alias("item_id"), F.timestamp_seconds("providerPublishTime").alias("published_at"), F.trim("title").alias("title"), url.alias("url"),
                             F.coalesce("publisher", F.lit("Yahoo Finance")).alias("source_name"), T.registrable_domain(url).alias("source_domain"), rel.alias("relevance"), F.lit(0).alias("engagement")), "yahoo_finance", "NEWS")


def discussions(payloads: DataFrame) -> DataFrame:
    """Discussion payloads with engagement = points + 2 x comments."""
    s = "struct<hits:array<struct<objectID:string,title:string,url:string,created_at:string,points:double,num_comments:double>>>"
    d = payloads.select("ticker", "name", F.explode(F.from_json("payload", s)["hits"]).alias("h")).select("ticker", "name", "h.*")
    link = F.concat(F.lit("https://news.ycombinator.com/item?id="), F.url_encode("objectID"))
    rel = T.relevance(F.concat_ws("\n", "title", F.coalesce(T.valid_http_url("url"), F.lit(""))), "ticker", "name")
    eng = F.greatest(F.coalesce("points", F.lit(0.0)), F.lit(0.0)) + 2 * F.greatest(F.coalesce("num_comments", F.lit(0.0)), F.lit(0.0))
    return _article(d.select("ticker", F.col("objectID").alias("item_id"), F.try_to_timestamp("created_at").alias("published_at"), F.trim("title").alias("title"), link.alias("url"),
                             F.lit("Hacker News").alias("source_name"), F.lit("news.ycombinator.com").alias("source_domain"), rel.alias("relevance"), eng.alias("engagement")), "hacker_news", "DISCUSSION")


def rss_items(payloads: DataFrame) -> DataFrame:
    """RSS documents to article rows; a trailing " - Source" is cut from the title."""
    item = F.explode(F.regexp_extract_all("payload", F.lit(r"(?is)(<item>.*?</item>)"), F.lit(1))).alias("x")
    tag = lambda t: F.trim(T.decode_entities(F.regexp_extract("x", rf"(?is)<{t}(?:\s[^>]*)?>(.*?)</{t}>", 1)))
    d = payloads.select("ticker", "name", item)
    source = F.when(tag("source") == "", "Google News").otherwise(tag("source"))
    d = d.select("ticker", "name", tag("title").alias("raw"), source.alias("source_name"), T.valid_http_url(tag("link")).alias("url"), tag("guid").alias("guid"),
                 F.try_to_timestamp(F.regexp_replace(tag("pubDate"), r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss z")).alias("published_at"), T.registrable_domain(F.regexp_extract("x", r'(?i)<source[^>]*\surl="([^"]+)"', 1)).alias("dom"))
    suffix = F.concat(F.lit(" - "), F.col("source_name"))
    title = F.when(F.endswith("raw", suffix), F.substring("raw", F.lit(1), F.length("raw") - F.length(suffix))).otherwise(F.col("raw"))
    d = d.withColumns({"title": title, "item_id": F.coalesce(F.nullif("guid", F.lit("")), "url"), "source_domain": F.coalesce("dom", F.lower("source_name")), "engagement": F.lit(0)})
    return _article(d.withColumn("relevance", T.relevance(F.concat_ws("\n", "title", "url"), "ticker", "name")), "google_news", "NEWS")


def fx_series(payloads: DataFrame) -> DataFrame:
    """FX chart payloads to a daily series dated in the exchange's own zone."""
    s = "struct<chart:struct<result:array<struct<meta:struct<exchangeTimezoneName:string>,timestamp:array<bigint>,indicators:struct<quote:array<struct<close:array<double>>>>>>>>"
    r = F.from_json("payload", s)["chart"]["result"][0]
    d = payloads.select("currency", F.coalesce(r["meta"]["exchangeTimezoneName"], F.lit("Europe/London")).alias("z"), F.explode(F.arrays_zip(r["timestamp"].alias("ts"), r["indicators"]["quote"][0]["close"].alias("close"))).alias("p"))
    return d.where("p.close IS NOT NULL").select("currency", F.to_date(F.from_utc_timestamp(F.timestamp_seconds("p.ts"), F.col("z"))).alias("day"), F.col("p.close").alias("close"))


def split_events(payloads: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Split events of chart payloads; (ticker, split_date) pairs of ``exceptions`` are not genuine."""
    s = "struct<chart:struct<result:array<struct<events:struct<splits:map<string,struct<date:bigint,numerator:double,denominator:double>>>>>>>"
    d = payloads.select("ticker", F.explode(F.map_values(F.from_json("payload", s)["chart"]["result"][0]["events"]["splits"])).alias("e"))
    d = d.select("ticker", D.eastern_date(F.timestamp_seconds("e.date")).alias("split_date"), (F.col("e.numerator") / F.col("e.denominator")).alias("ratio"))
    x = exceptions.select("ticker", "split_date").withColumn("_x", F.lit(True))
    return d.join(x, ["ticker", "split_date"], "left").withColumn("genuine", F.col("_x").isNull()).drop("_x")


def merge_by_fetch(stored: DataFrame, fetched: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two captures of a series; the later fetch wins per key."""
    both = stored.unionByName(fetched)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "fetched_at").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def share_records(payloads: DataFrame, filings: DataFrame, splits: DataFrame) -> DataFrame:
    """Shares-outstanding facts of three namespaces with priorities; comparative values un-split."""
    from marketloom.operators.fundamentals import split_factor
    tags = payloads.sparkSession.createDataFrame([("dei", "EntityCommonStockSharesOutstanding", 0), ("us-gaap", "CommonStockSharesOutstanding", 1), ("ifrs-full", "NumberOfSharesOutstanding", 1)],
                                                 "taxonomy string, tag string, priority int")
    s = f"struct<facts:map<string,map<string,struct<units:map<string,array<{FACT}>>>>>>"
    d = payloads.select("ticker", F.explode(F.from_json("payload", s)["facts"]).alias("taxonomy", "_t")).select("ticker", "taxonomy", F.explode("_t").alias("tag", "_c"))
    d = d.join(F.broadcast(tags), ["taxonomy", "tag"]).select("ticker", "taxonomy", "priority", F.explode(F.col("_c.units")["shares"]).alias("f"))
    d = d.where("f.start IS NULL AND f.val > 0").select("ticker", "taxonomy", "priority", F.col("f.end").cast("date").alias("end"), F.col("f.filed").cast("date").alias("filed"), F.col("f.accn").alias("accession_number"), F.col("f.val").alias("raw"))
    acc = filings.select("accession_number", F.col("accepted_at").alias("_acc"))
    d = d.join(acc, "accession_number", "left").withColumn("known", F.when(F.col("_acc").isNull(), F.col("filed")).otherwise(D.disclosure_day("filed", "_acc"))).drop("_acc").where("end <= known")
    d = split_factor(d, splits, "ticker", "end", "filed", True, "_k")
    return d.withColumn("value", F.when(F.col("taxonomy") == "dei", F.col("raw")).otherwise(F.col("raw") / F.col("_k"))).drop("_k", "raw")
