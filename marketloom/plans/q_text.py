"""Text functions (STR-*), news (NEWS-*), events (EVT-*) and JSON (JSN-*)."""
from pyspark.sql import functions as F

from marketloom.functions import text as T
from marketloom.functions.scalar import rnd
from marketloom.operators import events as EV, news as N
from marketloom.plans import sqlviews as S
from marketloom.plans.registry import register
from marketloom.sources import views as V

r = S.rnd


def pages(spark, d):
    return V.table(spark, d, "pages")


def docs(spark, d):
    return V.table(spark, d, "documents")


@register("str_01_normalize_ticker", "SELECT doc_id, CASE WHEN regexp_full_match(upper(trim(lang || source)), '[A-Z][A-Z0-9.\\-]{0,14}') THEN upper(trim(lang || source)) END AS ticker FROM documents")
def ticker(spark, d):
    return docs(spark, d).select("doc_id", T.normalize_ticker(F.concat(F.lit(" "), "lang", "source", F.lit(" "))).alias("ticker"))


@register("str_02_normalize_cik", "SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik FROM orders")
def cik(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", T.normalize_cik(F.concat(F.lit("CIK-"), F.col("o_custkey").cast("string"))).alias("cik"))


_Q = "regexp_replace(trim(url), '#.*$', '')"
CANON = f"""u AS (SELECT page_id, url, {_Q} AS u, split_part({_Q}, '?', 1) AS base, CASE WHEN contains({_Q}, '?') THEN list_filter(string_split(substr({_Q}, instr({_Q}, '?') + 1), '&'), lambda p: NOT regexp_matches(p, '(?i)^(utm_[^=]*|guccounter[^=]*|guce_referrer[^=]*|oc|ref|source)(=.*)?$')) END AS ps FROM pages),
cu AS (SELECT page_id, url, CASE WHEN ps IS NULL THEN u WHEN len(ps) = 0 THEN base ELSE base || '?' || array_to_string(ps, '&') END AS canonical_url FROM u)"""


@register("str_03_canonical_url", "WITH " + CANON + " SELECT page_id, canonical_url FROM cu")
def canonical(spark, d):
    return pages(spark, d).select("page_id", T.canonical_url("url").alias("canonical_url"))


@register("str_04_registrable_domain", "SELECT page_id, CASE WHEN len(p) <= 2 THEN h WHEN array_to_string(p[-2:], '.') IN ('co.uk','com.au','co.jp','co.in','com.cn','com.sg') THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain FROM (SELECT page_id, h, string_split(h, '.') AS p FROM (SELECT page_id, lower(regexp_extract(url, '^(?i)https?://(?:www\\.)?([^/:?#]+)', 1)) AS h FROM pages))")
def domain(spark, d):
    return pages(spark, d).select("page_id", T.registrable_domain("url").alias("domain"))


FP = "sha256(trim(regexp_replace(regexp_replace(lower({c}), '\\s+-\\s+[^-]{{2,60}}$', ''), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g')))"


@register("str_05_story_fingerprint", "SELECT doc_id, " + FP.format(c="text") + " AS fingerprint FROM documents")
def fingerprint(spark, d):
    return docs(spark, d).select("doc_id", T.story_fingerprint("text").alias("fingerprint"))


@register("str_06_content_key", "SELECT doc_id, sha256(concat_ws(chr(1), source, CAST(n_chars AS VARCHAR), text)) AS key FROM documents")
def key(spark, d):
    return docs(spark, d).select("doc_id", T.content_key(F.col("source"), F.col("n_chars"), F.col("text")).alias("key"))


# Classification runs on whole document texts with one rule phrase appended per document family.
_PHRASES = ["chapter 11 filing", "data breach reported", "expands capacity", "wins supply agreement", "strong growth and record profit", "lawsuit and recall loss", "plain note", "subpoena received"]
_CASE = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHRASES)) + " END"
NEWS = f"""nw AS (SELECT doc_id AS article_id, text || ' ' || {_CASE} AS body, lang, source AS publisher, CASE WHEN doc_id % 5 = 0 THEN 'DISCUSSION' ELSE 'NEWS' END AS content_kind, CASE WHEN doc_id % 3 = 0 THEN 0.9e0 ELSE 0.3e0 + (doc_id % 4) * 0.05e0 END AS relevance, {S.tick_of('doc_id')} AS ticker, DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS published_on FROM documents),
wd AS (SELECT *, regexp_extract_all(lower(body), '([a-z][a-z''\\-]*)', 1) AS ws FROM nw),
wc AS (SELECT *, len(list_filter(ws, lambda w: w IN ({', '.join(repr(x) for x in T.POSITIVE)}))) AS pos, len(list_filter(ws, lambda w: w IN ({', '.join(repr(x) for x in T.NEGATIVE)}))) AS neg FROM wd),
ns AS (SELECT * EXCLUDE (ws), CASE WHEN pos + neg = 0 THEN 0e0 ELSE greatest(-1e0, least(1e0, (pos - neg) / greatest(2, pos + neg))) END AS sentiment FROM wc)"""


def _risk_sql():
    esc = lambda p: "(?i)" + p.replace("'", "''")
    arms = " ".join(f"WHEN regexp_matches(body, '{esc(p)}')" + (" AND sentiment <= 0.05" if s == "P1" else "") + f" THEN '{s}:{c}'" for s, c, p in T.RISK_RULES)
    imp = " ".join(f"WHEN regexp_matches(body, '{esc(p)}') THEN '{s}:{c}:{x}'" for s, c, x, p in T.IMPACT_RULES)
    return f""",
cl AS (SELECT *, CASE WHEN relevance >= 0.35 THEN CASE {arms} WHEN sentiment <= -0.5 AND relevance >= 0.7 THEN 'P2:NEGATIVE_SENTIMENT' END END AS rk, CASE WHEN relevance >= 0.4 THEN CASE {imp} END END AS im FROM ns),
cls AS (SELECT *, CASE WHEN content_kind = 'DISCUSSION' AND rk LIKE 'P1:%' THEN 'P2:SOCIAL_' || substr(rk, 4) ELSE rk END AS risk, CASE WHEN content_kind = 'DISCUSSION' AND im LIKE 'P2:%' THEN 'P3:' || substr(im, 4) ELSE im END AS impact FROM cl)"""


CLS = NEWS + _risk_sql()


def news(spark, d):
    i = F.col("doc_id")
    phrase = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (i % 8 + 1).cast("int"))
    n = docs(spark, d).select(
        i.alias("article_id"), F.concat_ws(" ", "text", phrase).alias("body"), "lang", F.col("source").alias("publisher"),
        F.when(i % 5 == 0, "DISCUSSION").otherwise("NEWS").alias("content_kind"), F.when(i % 3 == 0, 0.9).otherwise(0.3 + (i % 4) * 0.05).alias("relevance"),
        V.ticker_of("doc_id").alias("ticker"), F.date_add(F.lit("2024-01-01").cast("date"), (i % 30).cast("int")).alias("published_on"))
    return n.withColumn("sentiment", T.text_sentiment("body"))


def classified(spark, d):
    n = news(spark, d)
    return n.withColumns({"risk": T.classify_risk("body", "sentiment", "relevance", "content_kind"), "impact": T.classify_impact("body", "relevance", "content_kind")})


@register("str_08_sentiment", "WITH " + NEWS + f" SELECT article_id, {r('sentiment', 6)} AS sentiment, CASE WHEN sentiment >= 0.35 THEN 'Bullish' WHEN sentiment <= -0.35 THEN 'Bearish' WHEN sentiment > 0 THEN 'Somewhat-Bullish' WHEN sentiment < 0 THEN 'Somewhat-Bearish' ELSE 'Neutral' END AS label FROM ns")
def sentiment(spark, d):
    return news(spark, d).select("article_id", rnd("sentiment", 6).alias("sentiment"), T.sentiment_label("sentiment").alias("label"))


@register("news_03_risk", "WITH " + CLS + " SELECT article_id, split_part(risk, ':', 1) AS severity, split_part(risk, ':', 2) AS category FROM cls WHERE risk IS NOT NULL")
def risk(spark, d):
    return N.news_events(classified(spark, d)).where("source_type = 'NEWS_RISK'").select("article_id", "severity", "category")


@register("news_04_impact", "WITH " + CLS + " SELECT article_id, split_part(impact, ':', 1) AS severity, split_part(impact, ':', 2) AS category, split_part(impact, ':', 3) AS direction FROM cls WHERE impact IS NOT NULL")
def impact(spark, d):
    one = F.explode(F.array_compact(F.array("impact"))).alias("x")  # evaluated once, nulls dropped
    return classified(spark, d).select("article_id", one).select("article_id", "x.severity", "x.category", "x.direction")


@register("news_07_event_rows", "WITH " + CLS + " SELECT article_id, ticker, 'NEWS_RISK:' || article_id || ':' || ticker AS event_key, split_part(risk, ':', 1) AS severity FROM cls WHERE risk IS NOT NULL UNION ALL SELECT article_id, ticker, 'NEWS_IMPACT:' || article_id || ':' || ticker || ':' || split_part(impact, ':', 2), split_part(impact, ':', 1) FROM cls WHERE impact IS NOT NULL")
def event_rows(spark, d):
    return N.news_events(classified(spark, d)).select("article_id", "ticker", "event_key", "severity")


@register("str_09_source_tier", "SELECT page_id, CASE WHEN regexp_matches(h, '(^|\\.)(' || '" + "|".join(x.replace(".", "\\.") for x in T.TIER_ONE) + "' || ')$') THEN 'TIER_1' ELSE 'TIER_2' END AS tier FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'www.reuters.com' WHEN 1 THEN 'notft.com' ELSE 'ft.com' END AS h FROM pages)")
def tier(spark, d):
    h = F.when(F.col("page_id") % 3 == 0, "www.reuters.com").when(F.col("page_id") % 3 == 1, "notft.com").otherwise("ft.com")
    return pages(spark, d).select("page_id", T.source_tier(h, F.lit("NEWS")).alias("tier"))


@register("str_10_relevance", "SELECT doc_id, CASE WHEN contains(t, '$' || k) THEN 1e0 WHEN contains(t, 'acme ' || k) THEN 0.95e0 WHEN regexp_matches(t, '\\b' || k || '\\b') THEN 0.72e0 ELSE 0e0 END AS relevance FROM (SELECT doc_id, source AS k, lower(text || CASE doc_id % 4 WHEN 0 THEN ' $' || source WHEN 1 THEN ' Acme ' || source WHEN 2 THEN ' ' || source ELSE '' END) AS t FROM documents)")
def relevance(spark, d):
    m = F.col("doc_id") % 4
    text = F.concat("text", F.when(m == 0, F.concat(F.lit(" $"), "source")).when(m == 1, F.concat(F.lit(" Acme "), "source")).when(m == 2, F.concat(F.lit(" "), "source")).otherwise(""))
    return docs(spark, d).select("doc_id", T.relevance(text, F.col("source"), F.concat(F.lit("Acme "), "source")).alias("relevance"))


@register("str_11_item_codes", S.sql("filings", "SELECT accession_number, array_to_string(list_distinct_ordered, ',') AS items FROM (SELECT accession_number, string_split(items, ',') AS list_distinct_ordered FROM filings)"))
def items(spark, d):
    return V.filings(spark, d).select("accession_number", F.array_join(EV.item_codes(F.concat(F.lit("Items: "), F.replace("items", F.lit(","), F.lit(" and ")), F.lit(" and 9.01"))), ",").alias("items"))


_ENT = "html"
for _src, _dst in (("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&#34;", '"'), ("&#160;", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
    _ENT = f"replace({_ENT}, '{_src}', '{_dst}')"


@register("str_12_decode_entities", f"SELECT page_id, {_ENT} AS decoded FROM pages")
def decode(spark, d):
    return pages(spark, d).select("page_id", T.decode_entities("html").alias("decoded"))


STORY = "WITH " + CANON + f""",
ar AS (SELECT d.doc_id AS article_id, coalesce(c.canonical_url, 'doc:' || d.doc_id) AS canonical_url, {FP.format(c='d.text')} AS fingerprint, CASE WHEN d.doc_id % 3 = 0 THEN 'TIER_1' ELSE 'TIER_2' END AS source_tier, CASE WHEN d.doc_id % 4 = 0 THEN 'DISCUSSION' ELSE 'NEWS' END AS content_kind, d.n_chars AS engagement, d.source AS publisher, DATE '2024-01-01' + CAST(d.doc_id % 30 AS INT) AS published_on FROM documents d LEFT JOIN cu c ON c.page_id = d.doc_id),
bu AS (SELECT canonical_url, arg_min(fingerprint, (published_on, article_id)) AS fingerprint, min(published_on) AS published_on, min(article_id) AS article_id, max(engagement) AS engagement, bool_or(source_tier = 'TIER_1') AS t1, bool_or(content_kind = 'NEWS') AS nw, count(*) AS copies FROM ar GROUP BY 1),
st AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY fingerprint ORDER BY published_on, article_id) AS story_no FROM (SELECT *, published_on - lag(published_on) OVER (PARTITION BY fingerprint ORDER BY published_on, article_id) AS gap FROM bu))
"""


def story_articles(spark, d):
    p = pages(spark, d).select(F.col("page_id").alias("doc_id"), T.canonical_url("url").alias("cu"))
    i = F.col("doc_id")
    a = docs(spark, d).select("doc_id", T.story_fingerprint("text").alias("fingerprint"), "n_chars", "source")  # texts stay where they are read
    return a.join(p, "doc_id", "left").select(
        i.alias("article_id"), F.coalesce("cu", F.concat(F.lit("doc:"), i.cast("string"))).alias("canonical_url"), "fingerprint",
        F.when(i % 3 == 0, "TIER_1").otherwise("TIER_2").alias("source_tier"), F.when(i % 4 == 0, "DISCUSSION").otherwise("NEWS").alias("content_kind"),
        F.col("n_chars").alias("engagement"), F.col("source").alias("publisher"), F.date_add(F.lit("2024-01-01").cast("date"), (i % 30).cast("int")).alias("published_on"))


@register("news_05_story_dedup", STORY + "SELECT min(article_id) AS article_id, min(published_on) AS first_published, max(published_on) AS last_published, CASE WHEN bool_or(t1) THEN 'TIER_1' ELSE 'TIER_2' END AS source_tier, CASE WHEN bool_or(nw) THEN 'NEWS' ELSE 'DISCUSSION' END AS content_kind, max(engagement) AS engagement, sum(copies) AS copies FROM st GROUP BY fingerprint, story_no")
def dedup(spark, d):
    return N.deduplicate_stories(story_articles(spark, d)).drop("fingerprint", "story_no")


@register("news_06_corroboration", STORY + "SELECT a.fingerprint, a.published_on, count(DISTINCT b.publisher) AS publishers, count(DISTINCT b.publisher) >= 2 OR bool_or(b.source_tier = 'TIER_1') AS corroborated FROM (SELECT DISTINCT fingerprint, published_on FROM ar) a JOIN ar b ON a.fingerprint = b.fingerprint AND abs(a.published_on - b.published_on) <= 2 GROUP BY 1, 2")
def corroboration(spark, d):
    return N.corroboration(story_articles(spark, d), "fingerprint")


@register("news_08_sentiment_summary", "WITH " + NEWS + f" SELECT ticker, count(*) AS articles_7d, {r('avg(sentiment)', 6)} AS mean_sentiment, count(*) FILTER (WHERE a = 0) AS articles_1d, count(*) FILTER (WHERE a = 1) AS articles_prev_1d, {r('avg(CASE WHEN sentiment < 0 THEN 1e0 ELSE 0e0 END)', 6)} AS negative_ratio, CASE WHEN avg(sentiment) FILTER (WHERE a = 0) - avg(sentiment) FILTER (WHERE a = 1) IS NULL THEN 'INSUFFICIENT' WHEN avg(sentiment) FILTER (WHERE a = 0) - avg(sentiment) FILTER (WHERE a = 1) >= 0.1 THEN 'IMPROVING' WHEN avg(sentiment) FILTER (WHERE a = 0) - avg(sentiment) FILTER (WHERE a = 1) <= -0.1 THEN 'DETERIORATING' ELSE 'STABLE' END AS trend FROM (SELECT *, DATE '2024-01-20' - published_on AS a FROM ns) WHERE a BETWEEN 0 AND 6 GROUP BY 1")
def summary(spark, d):
    s = N.sentiment_summary(news(spark, d), F.lit("2024-01-20").cast("date"))
    return s.select("ticker", "articles_7d", rnd("mean_sentiment", 6).alias("mean_sentiment"), "articles_1d", "articles_prev_1d", rnd("negative_ratio", 6).alias("negative_ratio"), "trend")


@register("news_02_combined_feeds", "SELECT feed, count(*) AS n FROM (SELECT 'documents' AS feed FROM documents UNION ALL SELECT 'pages' FROM pages UNION ALL SELECT 'conversations' FROM conversations) GROUP BY 1")
def feeds(spark, d):
    return N.combine_sources({"documents": docs(spark, d).select("text"), "pages": pages(spark, d).select("url"), "conversations": V.table(spark, d, "conversations").select("text")}).groupBy("feed").agg(F.count("*").alias("n"))


@register("news_09_article_list", S.sql("articles securities", "SELECT doc_id, s.name, (SELECT count(DISTINCT publisher) FROM articles b WHERE b.ticker = a.ticker) AS publishers, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.doc_id) AS labelled FROM articles a JOIN securities s USING (ticker)"))
def article_list(spark, d):
    a = V.articles(spark, d)
    n = a.groupBy("ticker").agg(F.countDistinct("publisher").alias("publishers"))
    lab = V.table(spark, d, "labels").select("doc_id").distinct().withColumn("l", F.lit(True))
    return (a.select("doc_id", "ticker").join(V.securities(spark, d).select("ticker", "name"), "ticker").join(n, "ticker").join(lab, "doc_id", "left")
            .select("doc_id", "name", "publishers", F.coalesce("l", F.lit(False)).alias("labelled")))


_RANK = "CASE item WHEN '1.03' THEN 'P0' WHEN '4.02' THEN 'P1' WHEN '2.02' THEN 'P2' WHEN '5.02' THEN 'P2' ELSE 'P3' END"
EVT = f"""fx AS (SELECT accession_number, ticker, filed_at, unnest(string_split(items, ',')) AS item, generate_subscripts(string_split(items, ','), 1) AS pos FROM filings),
fe AS (SELECT accession_number, ticker, filed_at, arg_min(item, ({_RANK}, pos)) AS primary_item, min({_RANK}) AS severity, count(*) AS item_count FROM fx GROUP BY 1, 2, 3)"""


@register("evt_01_filing_classification", S.sql("filings", "SELECT accession_number, primary_item, severity, item_count, 'SEC_8K_ITEM_' || replace(primary_item, '.', '_') AS event_type FROM fe", EVT))
def filing_classes(spark, d):
    return EV.classify_filings(V.filings(spark, d)).select("accession_number", "primary_item", "severity", "item_count", "event_type")


@register("evt_02_event_index", S.sql("filings", "SELECT 'SEC_8K:' || accession_number AS event_key, severity, filed_at >= DATE '2001-01-01' AS is_new FROM fe", EVT))
def event_index(spark, d):
    f = V.filings(spark, d)
    seen = f.where("filed_at < DATE '2001-01-01'").select(F.concat_ws(":", F.lit("SEC_8K"), "accession_number").alias("event_key"))
    return EV.index_events(f, seen).select("event_key", "severity", "is_new")


@register("evt_03_event_list", S.sql("research_events", "SELECT event_id, e.ticker, severity, n_p0, n_p1 FROM research_events e JOIN (SELECT ticker, count(*) FILTER (WHERE severity = 'P0') AS n_p0, count(*) FILTER (WHERE severity = 'P1') AS n_p1 FROM research_events WHERE event_date >= DATE '2024-01-10' AND severity IN ('P0', 'P1') GROUP BY 1) n ON n.ticker = e.ticker WHERE event_date >= DATE '2024-01-10' AND severity IN ('P0', 'P1')"))
def event_list(spark, d):
    return EV.event_list(V.research_events(spark, d), F.lit("2024-01-10").cast("date"), ("P0", "P1")).select("event_id", "ticker", "severity", "n_p0", "n_p1")


@register("evt_05_official_alerts", S.sql("filings", "SELECT accession_number, ticker FROM fe WHERE severity IN ('P0', 'P1') AND filed_at > DATE '2001-02-01'", EVT))
def official(spark, d):
    f = V.filings(spark, d)
    e = EV.index_events(f, f.where("filed_at < DATE '2001-01-01'").select(F.concat_ws(":", F.lit("SEC_8K"), "accession_number").alias("event_key")))
    first = f.select("ticker").distinct().withColumn("first_sync", F.lit("2001-02-01").cast("date"))
    return EV.official_alerts(e, first).select("accession_number", "ticker")


_MAG = "CASE severity WHEN 'P0' THEN 1 WHEN 'P1' THEN 0.75 WHEN 'P2' THEN 0.4 ELSE 0.15 END"
_DIR = "CASE WHEN source_type = 'NEWS_RISK' THEN -1 WHEN source_type = 'NEWS_IMPACT' THEN CASE direction WHEN 'POSITIVE' THEN 1 WHEN 'NEGATIVE' THEN -1 ELSE 0 END WHEN severity IN ('P0', 'P1') THEN -1 ELSE 0 END"


@register("pred_06_event_features", S.sql("research_events", f"""SELECT p.ticker, p.as_of, CAST(least(greatest(sum({_DIR} * {_MAG}), -1), 1) AS DOUBLE) AS event_score, count(*) AS events, count(*) FILTER (WHERE {_DIR} > 0) AS positive, count(*) FILTER (WHERE {_DIR} < 0) AS negative, count(*) FILTER (WHERE relation_type <> 'DIRECT') AS proxy
  FROM (SELECT DISTINCT ticker, event_date AS as_of FROM research_events) p JOIN research_events e ON e.ticker = p.ticker AND e.event_date BETWEEN p.as_of - 10 AND p.as_of GROUP BY 1, 2"""))
def event_features(spark, d):
    e = V.research_events(spark, d)
    return EV.trailing_event_features(e, e.select("ticker", F.col("event_date").alias("as_of")), 10).select("ticker", "as_of", "event_score", "events", "positive", "negative", "proxy")


@register("adv_02_event_context", S.sql("research_events", f"""SELECT p.ticker, p.as_of, {r(f"least(greatest(sum({_DIR} * CASE severity WHEN 'P0' THEN 100 WHEN 'P1' THEN 75 WHEN 'P2' THEN 45 ELSE 20 END * q * greatest(0.25e0, 1 - (p.as_of - e.event_date) / 15e0)), -100), 100)", 4)} AS event_score, {r('avg(q) * 100', 4)} AS evidence_quality, count(*) AS events
  FROM (SELECT DISTINCT ticker, event_date AS as_of FROM research_events) p JOIN (SELECT *, CASE WHEN source_type = 'SEC_8K' THEN 1e0 WHEN source_tier = 'TIER_1' THEN 0.9e0 WHEN source_tier = 'SOCIAL' THEN 0.35e0 ELSE 0.65e0 END * CASE WHEN relation_type <> 'DIRECT' THEN 0.65e0 ELSE 1e0 END AS q FROM research_events) e ON e.ticker = p.ticker AND e.event_date BETWEEN p.as_of - 14 AND p.as_of GROUP BY 1, 2"""))
def event_context(spark, d):
    e = V.research_events(spark, d)
    x = EV.weighted_event_context(e, e.select("ticker", F.col("event_date").alias("as_of")).distinct(), 21)
    return x.select("ticker", "as_of", rnd("event_score", 4).alias("event_score"), rnd("evidence_quality", 4).alias("evidence_quality"), "events")


@register("jsn_01_parse_fallback", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE CAST(props->>'$.k' AS BIGINT) END AS k FROM events")
def parse(spark, d):
    from marketloom.functions.json import parse_or
    p = F.when(F.col("event_id") % 3 == 0, "{broken").otherwise(F.col("props"))
    return V.table(spark, d, "events").select("event_id", parse_or(p, "k bigint", F.struct(F.lit(-1).cast("bigint").alias("k")))["k"].alias("k"))


@register("jsn_02_path_extract", "SELECT event_type, sum(CAST(props->>'$.k' AS BIGINT)) AS total FROM events GROUP BY 1")
def path(spark, d):
    return V.table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@register("jsn_04_flatten_tree", "SELECT event_id, unnest(['$.a.k', '$.a.b[0]', '$.a.b[1]', '$.type']) AS path, unnest([props->>'$.k', CAST(event_id AS VARCHAR), 'x', event_type]) AS leaf FROM events")
def flatten(spark, d):
    from marketloom.functions.json import flatten_tree
    j = F.concat(F.lit('{"a":'), F.regexp_replace("props", r"\}$", ""), F.lit(',"b":['), F.col("event_id").cast("string"), F.lit(',"x"]},"type":"'), F.col("event_type"), F.lit('"}'))
    return flatten_tree(V.table(spark, d, "events").select("event_id", j.alias("doc")), ["event_id"], "doc", 4)


@register("jsn_05_tree_hash", "SELECT event_type, count(DISTINCT h) AS versions FROM (SELECT event_type, props->>'$.k' AS h FROM events) GROUP BY 1")
def tree_hash(spark, d):
    from marketloom.functions.json import material_hash
    j = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(',"generated_at":"'), F.col("ts").cast("string"), F.lit('"}'))
    h = material_hash(V.table(spark, d, "events").select("event_id", "event_type", j.alias("doc")), ["event_id", "event_type"], "doc", ("generated_at",), 3)
    return h.groupBy("event_type").agg(F.countDistinct("hash").alias("versions"))
