"""Validation (FLT-*), quality (DQ-*), advice (ADV-*), peers, concepts, theses, reports, reviews, dates and scalars."""
from pyspark.sql import functions as F

from marketloom.functions import dates as D, scalar as SC, text as T
from marketloom.functions.scalar import rnd
from marketloom.operators import advice as A, behavior as BH, flow as FL, quality as Q
from marketloom.operators.series import over
from marketloom.plans import sqlviews as S
from marketloom.plans.q_behavior import STAGED, staged
from marketloom.plans.q_flow import SCORED
from marketloom.plans.q_portfolio import CAL, calendar
from marketloom.plans.registry import register
from marketloom.sources import views as V

r = S.rnd


@register("flt_03_calendar_window", S.sql("filings", "SELECT accession_number FROM filings WHERE filed_at BETWEEN DATE '2000-06-30' - 30 AND DATE '2000-06-30'"))
def window(spark, d):
    at = F.lit("2000-06-30").cast("date")
    return V.filings(spark, d).where(F.col("filed_at").between(F.date_sub(at, 30), at)).select("accession_number")


@register("flt_05_prefix", S.sql("trades", "SELECT id FROM trades WHERE note LIKE '1-%'"))
def prefix(spark, d):
    return V.trades(spark, d).where(F.col("note").startswith("1-")).select("id")


def dirty(spark, d):
    b = V.bars(spark, d)
    day = F.dayofmonth("trade_date")
    return b.withColumns({"high": F.when(day == 3, F.col("low") - 1).otherwise(F.col("high")), "volume": F.when(day == 7, -1.0).otherwise(F.col("volume")), "open": F.when(day == 9, float("nan")).otherwise(F.col("open"))})


@register("flt_06_bar_validation", S.sql("bars", "SELECT coalesce(CASE day(trade_date) WHEN 3 THEN 'HIGH_LOW_ORDER' WHEN 7 THEN 'NEGATIVE_VOLUME' WHEN 9 THEN 'NOT_FINITE' END, 'VALID') AS outcome, count(*) AS n FROM bars GROUP BY 1"))
def bar_validation(spark, d):
    ok, bad = Q.validate_bars(dirty(spark, d))
    return ok.select(F.lit("VALID").alias("outcome")).unionByName(bad.select(F.col("reject_reason").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


@register("flt_08_import_validation", "SELECT o_orderkey AS row_no, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'DATE' END, CASE WHEN o_orderkey % 7 = 0 THEN 'SIDE' END, CASE WHEN o_orderkey % 11 = 0 THEN 'PRICE' END) AS errors FROM orders")
def import_validation(spark, d):
    k = F.col("o_orderkey")
    rows = V.table(spark, d, "orders").select(
        k.alias("row_no"), F.when(k % 5 == 0, F.lit("2024-02-30")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), F.concat(F.lit(" t"), k.cast("string")).alias("ticker"),
        F.when(k % 7 == 0, "hold").otherwise("买入").alias("side"), F.lit("1,000").alias("shares"), F.when(k % 11 == 0, "n/a").otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).alias("price"), F.lit("").alias("fee"))
    return Q.validate_import(rows).select("row_no", F.array_join("errors", ",").alias("errors"))


@register("flt_11_publication_redaction", S.sql("bars", f"SELECT ticker, signal, CASE WHEN signal = 'NEUTRAL' THEN score END AS score, CASE WHEN signal = 'NEUTRAL' THEN '' ELSE 'score' END AS redacted, count(*) AS n FROM flow GROUP BY 1, 2, 3, 4", SCORED))
def redaction(spark, d):
    f = FL.flow_score(FL.flow_metrics(V.bars(spark, d))).withColumn("status", F.when(F.col("signal") == "NEUTRAL", "PUBLISHED").otherwise("OBSERVE"))
    return A.publication_safe(f, "status", ["score"]).groupBy("ticker", "signal", "score", F.array_join("redacted", ",").alias("redacted")).agg(F.count("*").alias("n"))


@register("dq_01_price_check", S.sql("provider_bars", """SELECT ticker, latest, CASE WHEN latest < (SELECT max(trade_date) FROM bars) THEN 'STALE' WHEN bad OR hi / lo - 1 > 0.001 THEN 'INCONSISTENT' ELSE 'CURRENT' END AS status FROM (SELECT ticker, max(trade_date) AS latest, arg_max(hi, trade_date) AS hi, arg_max(lo, trade_date) AS lo, arg_max(bad, trade_date) AS bad
  FROM (SELECT ticker, trade_date, max(close) AS hi, min(close) AS lo, bool_or(high < low OR close > high OR close < low) AS bad FROM provider_bars GROUP BY 1, 2) GROUP BY 1)"""))
def price_check(spark, d):
    p = V.provider_bars(spark, d)
    last = V.bars(spark, d).agg(F.max("trade_date").alias("m"))
    c = Q.price_check(p, V.securities(spark, d), F.lit("9999-01-01").cast("date")).drop("status")
    x = Q.price_check(p, V.securities(spark, d), F.lit("1900-01-01").cast("date")).withColumnRenamed("status", "fresh")
    return x.join(F.broadcast(last)).select("ticker", "latest", F.when(F.col("latest") < F.col("m"), "STALE").otherwise(F.col("fresh")).alias("status"))


_GRID = "SELECT ticker, 'bars' AS check_key, max(trade_date) AS latest, 40 AS age FROM bars GROUP BY 1 UNION ALL SELECT ticker, 'trades', max(trade_date), 40 FROM trades GROUP BY 1 UNION ALL SELECT ticker, 'estimates', max(as_of), 45 FROM estimates GROUP BY 1"


def grid(spark, d):
    out = {"bars": V.bars(spark, d).select("ticker", F.col("trade_date").alias("day")), "trades": V.trades(spark, d).select("ticker", F.col("trade_date").alias("day")), "estimates": V.estimates(spark, d).select("ticker", F.col("as_of").alias("day"))}
    return Q.dated_output_checks(V.securities(spark, d), out, F.lit("2001-11-04").cast("date"), {"bars": 40, "trades": 40, "estimates": 45})


@register("dq_02_dated_checks", S.sql("bars trades estimates", f"SELECT ticker, check_key, latest, CASE WHEN DATE '2001-11-04' - latest > age THEN 'STALE' ELSE 'CURRENT' END AS status FROM ({_GRID})"))
def dated(spark, d):
    return grid(spark, d)


@register("dq_03_overall_status", S.sql("bars trades estimates", f"SELECT ticker, count(*) AS checks, count(*) FILTER (WHERE DATE '2001-11-04' - latest > age) AS stale, CASE WHEN count(*) FILTER (WHERE DATE '2001-11-04' - latest > age) > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS overall FROM ({_GRID}) GROUP BY 1"))
def overall(spark, d):
    return Q.overall_status(grid(spark, d)).select("ticker", "checks", "stale", "overall")


@register("dq_04_coverage", S.sql("bars", "SELECT ticker, min(trade_date) AS first_date, max(trade_date) AS last_date, count(*) AS rows, min(trade_date) FILTER (WHERE n >= 253) AS first_eligible FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trade_date) AS n FROM bars) GROUP BY 1"))
def cover(spark, d):
    return Q.coverage(V.bars(spark, d))


@register("dq_05_freshness", S.sql("ticks trades", "SELECT ticker, ticks_latest, ticks_rows, trades_latest, trades_rows FROM (SELECT ticker, max(trade_date) AS ticks_latest, count(*) AS ticks_rows FROM ticks GROUP BY 1) FULL JOIN (SELECT ticker, max(trade_date) AS trades_latest, count(*) AS trades_rows FROM trades GROUP BY 1) USING (ticker)"))
def fresh(spark, d):
    day = lambda df: df.select("ticker", F.col("trade_date").alias("day"))
    return Q.freshness({"ticks": day(V.ticks(spark, d)), "trades": day(V.trades(spark, d))})


@register("dq_06_step_summary", "SELECT event_type AS step, count(*) AS total, count(*) FILTER (WHERE value <= 20) AS failed, CASE WHEN count(*) FILTER (WHERE value <= 20) = 0 THEN 'SUCCEEDED' WHEN count(*) FILTER (WHERE value > 20) = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS status FROM events GROUP BY 1")
def steps(spark, d):
    return Q.step_summary(V.table(spark, d, "events").select(F.col("event_type").alias("step"), (F.col("value") > 20).alias("ok")))


@register("dq_08_stale_results", S.sql("trades", "SELECT ticker, trade_date, CASE WHEN day(trade_date) = 1 THEN 'ABSENT' ELSE 'CHANGED' END AS finding FROM (SELECT ticker, trade_date FROM trades GROUP BY 1, 2) WHERE day(trade_date) IN (1, 2)"))
def stale(spark, d):
    new = V.trades(spark, d).groupBy("ticker", "trade_date").agg(F.sum("quantity").alias("q"))
    old = new.where(F.dayofmonth("trade_date") != 1).withColumn("q", F.when(F.dayofmonth("trade_date") == 2, F.col("q") + 1).otherwise(F.col("q")))
    return Q.stale_results(old, new, ["ticker", "trade_date"], "q")


@register("dq_09_audit_counts", "SELECT o_orderkey, 4 AS expected, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS found FROM orders WHERE found <> 4")
def audit(spark, d):
    o = V.table(spark, d, "orders").select("o_orderkey", F.lit(4).alias("expected"))
    li = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return Q.audit_counts(o, li, "o_orderkey", "expected")


@register("dq_10_incomplete_sessions", S.sql("minute_bars", "SELECT ticker, count(*) AS bars FROM minute_bars GROUP BY 1 HAVING count(*) < 390"))
def incomplete(spark, d):
    from marketloom.operators.ticks import incomplete_sessions
    return incomplete_sessions(V.minute_bars(spark, d), V.securities(spark, d))


@register("dat_03_latest_stable_session", "WITH " + CAL + " SELECT o_orderkey, CASE WHEN is_session AND (o_orderkey % 3 = 2 OR (o_orderkey % 3 = 1 AND day >= make_date(year(day), 4, 1) + ((7 - dayofweek(make_date(year(day), 4, 1))) % 7)::INTEGER AND day < make_date(year(day), 10, 31) - dayofweek(make_date(year(day), 10, 31))::INTEGER)) THEN day ELSE previous_session END AS stable_session FROM orders JOIN cal ON day = CAST(o_orderdate AS DATE)")
def stable(spark, d):
    k = F.col("o_orderkey")
    # 18:15 Eastern is 23:15 UTC in winter and 22:15 in summer (first Sunday of April to last of October in these years): 23:30 is final, 21:30 is not, 22:30 is in summer
    o = V.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 21 HOURS 30 MINUTES") + F.make_dt_interval(hours=(k % 3).cast("int"))).alias("ts"))
    return D.latest_stable_session(o, "ts", calendar(spark, d)).select("o_orderkey", "stable_session")


@register("dat_05_month_and_quarter", S.sql("trades", "SELECT id, CAST(date_trunc('month', trade_date) AS DATE) AS month_start, last_day(trade_date) AS month_end, CAST(trade_date - INTERVAL 3 YEAR AS DATE) AS three_years_before FROM trades"))
def months(spark, d):
    a, b = D.month_bounds("trade_date")
    return V.trades(spark, d).select("id", a.alias("month_start"), b.alias("month_end"), D.years_before("trade_date", 3).alias("three_years_before"))


@register("dat_06_period_class", S.sql("eps_facts", "SELECT ticker, period_end, period_type, CASE WHEN period_end - period_start >= 300 THEN 'annual' WHEN period_end - period_start BETWEEN 70 AND 120 THEN 'quarter' WHEN period_end - period_start > 120 THEN 'ytd' ELSE 'other' END AS class FROM eps_facts"))
def period_class(spark, d):
    return V.eps_facts(spark, d).select("ticker", "period_end", "period_type", D.period_class("period_start", "period_end").alias("class"))


@register("dat_07_disclosure_day", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS known FROM orders")
def disclosure(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    acc = F.when(F.col("o_orderkey") % 2 == 0, F.concat(day, F.lit("T16:05:00.000Z"))).otherwise(F.concat(day, F.lit("T16:05:00")))
    return V.table(spark, d, "orders").select("o_orderkey", D.disclosure_day(F.to_date("o_orderdate"), acc).alias("known"))


@register("dat_09_strict_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def strict(spark, d):
    t = F.when(F.col("o_orderkey") % 4 == 0, F.lit("1999-02-30")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return V.table(spark, d, "orders").select("o_orderkey", D.strict_date(t).alias("day"))


@register("dat_10_compact_timestamp", "SELECT event_id, date_trunc('second', ts) AS at FROM events")
def compact(spark, d):
    return V.table(spark, d, "events").select("event_id", D.compact_timestamp(F.date_format("ts", "yyyyMMdd'T'HHmmss")).cast("timestamp_ntz").alias("at"))


@register("dat_11_eastern_date", "SELECT event_id, CAST(ts - INTERVAL 5 HOUR AS DATE) AS day FROM events")
def eastern(spark, d):
    return V.table(spark, d, "events").select("event_id", D.eastern_date(F.col("ts").cast("timestamp")).alias("day"))


@register("mth_01_rounding_and_bridge", S.sql("bars", f"SELECT ticker, trade_date, {r('(1 + volume / 1000) * (1 + open / close) - 1', 4)} AS bridge, {r('1 / (1 + exp(-(close / open - 1)))', 6)} AS logit, {r(S.clamp('close - open', -5, 5), 2)} AS clamped FROM bars"))
def rounding(spark, d):
    return V.bars(spark, d).select("ticker", "trade_date", rnd(SC.volume_price_bridge(F.col("volume") / 1000, F.col("open") / F.col("close")), 4).alias("bridge"),
                                   rnd(SC.logistic(F.col("close") / F.col("open") - 1), 6).alias("logit"), rnd(SC.clamp(F.col("close") - F.col("open"), -5, 5), 2).alias("clamped"))


@register("str_14_import_fields", "SELECT o_orderkey, o_totalprice AS amount, CASE WHEN o_orderkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side FROM orders")
def fields(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", T.import_number(F.concat(F.lit(" $"), F.format_number("o_totalprice", 2))).alias("amount"), T.trade_side(F.when(F.col("o_orderkey") % 3 == 0, " sell ").otherwise("b")).alias("side"))


@register("str_15_symbols_and_urls", S.sql("filings", "SELECT accession_number, 'https://www.sec.gov/Archives/edgar/data/42/' || accession_number || '/doc.htm' AS url, replace(ticker || '.B', '.', '-') AS symbol FROM filings"))
def urls(spark, d):
    return V.filings(spark, d).select("accession_number", T.filing_url(F.lit("0000000042"), "accession_number", F.lit("doc.htm")).alias("url"), T.yahoo_symbol(F.concat("ticker", F.lit(".B"))).alias("symbol"))


_DEC = """CASE WHEN crit THEN CASE WHEN pos THEN 'EXIT_RISK_REVIEW' ELSE 'AVOID' END WHEN score <= -35 THEN CASE WHEN pos THEN 'EXIT_RISK_REVIEW' ELSE 'AVOID' END WHEN score <= -20 THEN CASE WHEN pos THEN 'REDUCE_REVIEW' ELSE 'AVOID' END ELSE CASE WHEN pos THEN 'HOLD_REVIEW' ELSE 'WATCH' END END"""


@register("adv_04_decisions", S.sql("bars", f"SELECT ticker, trade_date, {_DEC} AS action, CASE WHEN crit THEN 'RISK_OVERRIDE' ELSE 'OBSERVE' END AS publication_status FROM (SELECT *, volume > 150 AS crit, ticker < 'T05' AS pos FROM flow)", SCORED))
def decisions(spark, d):
    f = FL.flow_score(FL.flow_metrics(V.bars(spark, d)))
    no = F.lit(False)
    x = A.decide(F.col("score"), F.col("ticker") < "T05", F.col("volume") > 150, no, no, no, no, F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    return f.withColumn("x", x).select("ticker", "trade_date", "x.action", "x.publication_status")


@register("adv_03_weighted_impact", S.sql("bars macro_bars", f"""SELECT ticker, trade_date, {r('least(greatest((coalesce(p * 0.2e0, 0) + score * 0.16e0) / (CASE WHEN p IS NULL THEN 0e0 ELSE 0.2e0 END + 0.16e0), -100), 100)', 2)} AS impact, {r('(CASE WHEN p IS NULL THEN 0e0 ELSE 0.2e0 END + 0.16e0) * 100', 2)} AS coverage FROM (SELECT *, {r("least(greatest((close / lag(close, 21) OVER (PARTITION BY ticker ORDER BY trade_date) - 1) / 0.08e0 * 100, -100), 100) + CASE WHEN lag(close, 21) OVER (PARTITION BY ticker ORDER BY trade_date) IS NULL THEN NULL ELSE 0 END", 2)} AS p FROM flow)""", SCORED))
def impact(spark, d):
    f = FL.flow_score(FL.flow_metrics(V.bars(spark, d)))
    f = f.withColumn("p", A.price_score(F.col("close") / F.lag("close", 21).over(over()) - 1, 21))
    null = F.lit(None).cast("double")
    s, c = A.weighted_impact({k: null for k in A.COMPONENTS} | {"price": F.col("p"), "capitalFlow": F.col("score")}, 21)
    return f.select("ticker", "trade_date", s.alias("impact"), c.alias("coverage"))


@register("peer_01_chosen_peers", S.sql("relationships securities", "SELECT ticker, related_ticker, priority FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY priority, related_ticker) AS k FROM (SELECT ticker, related_ticker, min(priority) AS priority FROM (SELECT ticker, related_ticker, 2 AS priority FROM relationships UNION ALL SELECT a.ticker, b.ticker, 1 FROM securities a JOIN securities b USING (sector) WHERE a.ticker <> b.ticker) GROUP BY 1, 2)) WHERE k <= 2"))
def peers(spark, d):
    s = V.securities(spark, d).select("ticker", "sector")
    same = s.join(s.select(F.col("ticker").alias("related_ticker"), "sector"), "sector").select("ticker", "related_ticker", F.lit(1).alias("priority"))
    return A.choose_peers(V.relationships(spark, d).select("ticker", "related_ticker", F.lit(2).alias("priority")).unionByName(same))


@register("rvw_01_volume_context", S.sql("bars filings", f"""SELECT m.ticker, m.trade_date, {r('relative_volume', 3)} AS relative_volume, (SELECT count(*) FROM filings f WHERE f.ticker = m.ticker AND f.filed_at BETWEEN m.trade_date - 7 AND m.trade_date) AS events_7d FROM m QUALIFY row_number() OVER (PARTITION BY m.ticker ORDER BY m.trade_date DESC) <= 5""", SCORED))
def review(spark, d):
    from pyspark.sql import Window
    m = FL.flow_metrics(V.bars(spark, d)).withColumn("_r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("trade_date").desc()))).where("_r <= 5").select("ticker", "trade_date", "relative_volume")
    n = V.filings(spark, d).groupBy("ticker", F.col("filed_at").alias("day")).agg(F.count("*").alias("n"))
    days = m.withColumn("day", F.explode(F.sequence(F.date_sub("trade_date", 7), F.col("trade_date"))))
    g = days.join(n, ["ticker", "day"], "left").groupBy("ticker", "trade_date", "relative_volume").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events_7d"))
    return g.select("ticker", "trade_date", rnd("relative_volume", 3).alias("relative_volume"), "events_7d")


@register("rep_04_numbered_evidence", S.sql("filings", "SELECT accession_number AS ref, 'E' || strftime(filed_at, '%Y%m%d') || '-' || lpad(CAST(row_number() OVER (PARTITION BY ticker, filed_at ORDER BY accession_number) AS VARCHAR), 3, '0') AS evidence_id FROM filings"))
def evidence(spark, d):
    f = V.filings(spark, d).select("ticker", F.col("filed_at").alias("day"), F.lit("FILING").alias("kind"), F.col("accession_number").alias("ref"))
    return A.numbered_evidence(f, f.where("1 = 0"), "ticker").select("ref", "evidence_id")


@register("rep_03_tree_diff", "SELECT event_id, '$.k' AS path, 'CHANGED' AS change FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, '$.note', 'ADDED' FROM events WHERE event_id % 3 = 0")
def diff(spark, d):
    from marketloom.functions.json import flatten_tree
    e = V.table(spark, d, "events").select("event_id", "props")
    i = F.col("event_id")
    new = F.concat(F.lit('{"k": '), (F.get_json_object("props", "$.k").cast("long") + F.when(i % 2 == 0, 1).otherwise(0)).cast("string"), F.when(i % 3 == 0, F.lit(', "note": "x"}')).otherwise(F.lit("}")))
    return A.tree_diff(flatten_tree(e, ["event_id"], "props", 1), flatten_tree(e.select("event_id", new.alias("p")), ["event_id"], "p", 1), ["event_id"]).select("event_id", "path", "change")
