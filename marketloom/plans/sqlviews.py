"""Oracle SQL fragments: the derived market tables as DuckDB CTEs.

These restate ``marketloom.sources.views`` independently in SQL; a registered
query is checked by running its own SQL over these CTEs.
"""
from __future__ import annotations


def tick_of(key: str) -> str:
    return f"'T' || lpad(CAST({key} % 10 AS VARCHAR), 2, '0')"


def rnd(x: str, d: int = 4) -> str:
    return f"(floor((({x}) + 2.220446049250313e-16) * 1e{d} + 0.5e0) / 1e{d})"


def clamp(x: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest(({x}), {lo}e0), {hi}e0) END)"


VIEWS: dict[str, str] = {
    "bars": f"""SELECT ticker, trade_date, arg_min(px, rn) AS open, max(px) AS high, min(px) AS low, arg_max(px, rn) AS close, sum(q) AS volume
  FROM (SELECT {tick_of('l_suppkey')} AS ticker, CAST(l_shipdate AS DATE) AS trade_date, l_extendedprice / l_quantity AS px, l_quantity AS q,
        row_number() OVER (PARTITION BY l_suppkey % 10, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_extendedprice / l_quantity) AS rn FROM lineitem)
  GROUP BY ticker, trade_date""",
    "provider_bars": """SELECT *, 'feed_a' AS provider, trade_date + 1 AS ingested_at FROM bars
  UNION ALL SELECT ticker, trade_date, open, high, low, close * 1.0005e0, volume, 'feed_b', trade_date + 2 FROM bars WHERE day(trade_date) <= 20
  UNION ALL SELECT ticker, trade_date, open, high, low, close * 0.999e0, volume, 'manual', trade_date FROM bars WHERE day(trade_date) = 15""",
    "ticks": f"""SELECT {tick_of('user_id')} AS ticker, event_id AS sequence, ts AS trade_time, CAST(ts AS DATE) AS trade_date, value AS price,
  CAST(1 + event_id % 50 AS DOUBLE) AS volume, CASE WHEN event_type IN ('purchase','click') THEN 'BUY' WHEN event_type = 'error' THEN 'SELL' ELSE 'NEUTRAL' END AS direction FROM events""",
    "minute_bars": """SELECT ticker, trade_date, bar_time, arg_min(price, rn) AS open, max(price) AS high, min(price) AS low, arg_max(price, rn) AS close, sum(volume) AS volume
  FROM (SELECT *, date_trunc('minute', trade_time) AS bar_time, row_number() OVER (PARTITION BY ticker, date_trunc('minute', trade_time) ORDER BY trade_time, sequence) AS rn FROM ticks)
  GROUP BY ticker, trade_date, bar_time""",
    "tick_day_bars": """SELECT ticker, trade_date, arg_min(price, rn) AS open, max(price) AS high, min(price) AS low, arg_max(price, rn) AS close, sum(volume) AS volume
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker, trade_date ORDER BY trade_time, sequence) AS rn FROM ticks) GROUP BY ticker, trade_date""",
    "trades": f"""SELECT o_orderkey AS id, {tick_of('o_custkey')} AS ticker, CAST(o_orderdate AS DATE) AS trade_date,
  CASE WHEN o_orderkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side, CAST(1 + o_orderkey % 7 AS DOUBLE) AS quantity, o_totalprice / 1000 AS price, 1e0 AS fee, o_orderpriority AS note FROM orders""",
    "quarter_totals": f"""SELECT ticker, period_start, CAST(period_start + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, value, n FROM (
  SELECT {tick_of('o_custkey')} AS ticker, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period_start,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value, count(*) AS n FROM orders GROUP BY 1, 2)""",
    "facts": """SELECT r.ticker, m.metric_key, r.period_start, r.period_end, r.filed_at, 0 AS tag_priority, r.version,
  CASE WHEN m.metric_key = 'revenue' THEN r.value ELSE r.value * m.share * (0.9e0 + (r.n % 7) / 35e0) END AS value
  FROM (SELECT ticker, period_start, period_end, period_end + CAST(30 + n % 20 AS INT) AS filed_at, 0 AS version, value, n FROM quarter_totals
        UNION ALL SELECT ticker, period_start, period_end, period_end + CAST(120 + n % 20 AS INT), 1, value * 1.01e0, n FROM quarter_totals WHERE n % 4 = 0) r
  CROSS JOIN (VALUES ('revenue', 1e0), ('grossProfit', 0.4e0), ('operatingIncome', 0.2e0), ('netIncome', 0.1e0), ('operatingCashFlow', 0.15e0), ('capitalExpenditure', 0.05e0)) m(metric_key, share)""",
    "annual_facts": """SELECT ticker, metric_key, make_date(y, 1, 1) AS period_start, make_date(y, 12, 31) AS period_end, filed_at, value FROM (
  SELECT ticker, metric_key, year(period_end) AS y, max(filed_at) AS filed_at, CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) AS value FROM facts WHERE version = 0 GROUP BY 1, 2, 3 HAVING count(*) = 4
  UNION ALL SELECT ticker, metric_key, year(period_end), max(filed_at) + 90, CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) FROM (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY ticker, metric_key, period_end ORDER BY version DESC) = 1)
  GROUP BY 1, 2, 3 HAVING count(*) = 4 AND max(version) = 1)""",
    "eps_base": """SELECT *, year(period_start) AS fy, quarter(period_start) AS qn, CAST(floor(value / 1e4) AS DOUBLE) / 100 AS eps,
  period_end + CAST(30 + n % 20 AS INT) AS filed_at FROM quarter_totals""",
    "eps_facts": """SELECT ticker, period_start, period_end, 'quarter' AS period_type, fy AS fiscal_year, 'Q' || qn AS fiscal_period, filed_at, eps AS value, 0 AS tag_priority FROM eps_base WHERE qn < 4
  UNION ALL SELECT ticker, make_date(fy, 1, 1), period_end, CASE WHEN qn = 4 THEN 'annual' ELSE 'ytd' END, fy, CASE WHEN qn = 4 THEN 'FY' ELSE 'Q' || qn END, filed_at, v, 0
  FROM (SELECT *, CAST(sum(CAST(eps AS DECIMAL(18,2))) OVER w AS DOUBLE) AS v, count(*) OVER w AS k FROM eps_base WINDOW w AS (PARTITION BY ticker, fy ORDER BY qn))
  WHERE qn > 1 AND k = qn""",
    "estimates": f"""SELECT ticker, as_of, 'fiscal quarter' AS horizon, last_day(CAST(date_trunc('quarter', as_of) + to_months(CAST(3 * k + 2 AS INT)) AS DATE)) AS period_end,
  base + k * 0.05e0 AS eps_average, base + k * 0.06e0 AS eps_high, base + k * 0.04e0 AS eps_low, CAST(n % 9 AS INT) AS analyst_count,
  base + k * 0.05e0 - 0.01e0 AS eps_7d, base + k * 0.05e0 - 0.02e0 * (n % 5 - 2) AS eps_30d, CAST((n + k) % 4 AS INT) AS up_30d, CAST(n % 3 AS INT) AS down_30d
  FROM (SELECT ticker, as_of, CAST(floor(v / n / 1000) AS DOUBLE) / 100 AS base, n FROM (
    SELECT {tick_of('o_custkey')} AS ticker, last_day(CAST(o_orderdate AS DATE)) AS as_of, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v, count(*) AS n FROM orders GROUP BY 1, 2)),
  (SELECT unnest(range(1, 6)) AS k)""",
    "articles": f"""SELECT doc_id, {tick_of('doc_id')} AS ticker, text AS title, source AS publisher, lang, DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS published_on FROM documents""",
    "filings": f"""SELECT 'A' || o_orderkey AS accession_number, {tick_of('o_custkey')} AS ticker, CAST(o_orderdate AS DATE) AS filed_at,
  concat_ws(',', CASE o_orderstatus WHEN 'F' THEN '2.02' WHEN 'O' THEN '5.02' END, CASE o_orderpriority WHEN '1-URGENT' THEN '4.02' WHEN '2-HIGH' THEN '1.01' END,
  CASE WHEN o_orderkey % 11 = 0 THEN '1.03' END, '9.01') AS items FROM orders""",
    "research_events": f"""SELECT event_id, {tick_of('user_id')} AS ticker, CAST(ts AS DATE) AS event_date,
  CASE event_type WHEN 'error' THEN 'NEWS_RISK' WHEN 'signup' THEN 'SEC_8K' ELSE 'NEWS_IMPACT' END AS source_type,
  CASE WHEN event_id % 13 = 0 THEN 'P0' WHEN event_id % 5 = 0 THEN 'P1' WHEN event_id % 2 = 0 THEN 'P2' ELSE 'P3' END AS severity,
  CASE event_type WHEN 'purchase' THEN 'POSITIVE' WHEN 'view' THEN 'NEGATIVE' ELSE 'MIXED' END AS direction,
  CASE WHEN event_id % 4 = 0 THEN 'INDUSTRY_PROXY' ELSE 'DIRECT' END AS relation_type,
  CASE WHEN event_id % 3 = 0 THEN 'TIER_1' WHEN event_id % 7 = 0 THEN 'SOCIAL' ELSE 'TIER_2' END AS source_tier FROM events""",
    "macro_bars": """SELECT CASE i WHEN 0 THEN 'US10Y_YIELD' WHEN 1 THEN 'US13W_YIELD' WHEN 2 THEN 'US10Y_FUTURES' WHEN 3 THEN 'FED_FUNDS_FUTURES' ELSE 'LONG_TREASURY_ETF' END AS indicator_key,
  trade_date, (CASE WHEN i = 3 THEN 95e0 WHEN i IN (2, 4) THEN 100e0 ELSE 4e0 END) + s / n AS close
  FROM (SELECT l_linenumber % 5 AS i, CAST(l_shipdate AS DATE) AS trade_date, CAST(sum(CAST(l_discount AS DECIMAL(10,4))) AS DOUBLE) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2)""",
    "relationships": f"""SELECT ticker, related_ticker, active_from, CASE WHEN n % 2 = 0 THEN last_seen - 365 END AS active_to FROM (
  SELECT {tick_of('o_custkey')} AS ticker, {tick_of('l_suppkey')} AS related_ticker, min(CAST(o_orderdate AS DATE)) AS active_from, max(CAST(o_orderdate AS DATE)) AS last_seen, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 10 <> l_suppkey % 10 GROUP BY 1, 2)""",
    "securities": f"""SELECT {tick_of('s_suppkey')} AS ticker, arg_min(s_name, s_suppkey) AS name, 'G' || CAST(min(s_suppkey) % 4 AS VARCHAR) AS sector FROM supplier GROUP BY 1""",
}
DEPENDS = {"provider_bars": ["bars"], "minute_bars": ["ticks"], "tick_day_bars": ["ticks"],
           "facts": ["quarter_totals"], "annual_facts": ["facts"], "eps_base": ["quarter_totals"], "eps_facts": ["eps_base"]}


def sql(views: str, select: str, ctes: str = "") -> str:
    """Assemble ``WITH <views and their inputs>, <ctes> <select>``."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for d in DEPENDS.get(name, []):
            need(d)
        if name not in ordered:
            ordered.append(name)

    for v in views.split():
        need(v)
    parts = [f"{v} AS (\n  {VIEWS[v]})" for v in ordered]
    if ctes:
        parts.append(ctes)
    return "WITH " + ",\n".join(parts) + "\n" + select
