"""Results that used to be cut: deep documents, retention, keys that move, repeated filings, numeric references, large days."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.functions.json import flatten_tree, material_hash
from marketloom.functions.text import decode_entities
from marketloom.operators.events import classify_filings
from marketloom.operators.news import corroboration
from marketloom.operators.ticks import large_trades
from marketloom.sources import sinks, views


def test_documents_of_any_depth(spark):
    deep = '{"a":{"b":{"c":{"d":{"e":[{"f":%d}]}}}},"z":2}'
    df = spark.createDataFrame([(1, deep % 1), (2, deep % 9)], "id int, doc string")
    leaves = {(r["id"], r["path"], r["leaf"]) for r in flatten_tree(df, ["id"], "doc", 1).collect()}
    assert leaves == {(1, "$.a.b.c.d.e[0].f", "1"), (1, "$.z", "2"), (2, "$.a.b.c.d.e[0].f", "9"), (2, "$.z", "2")}
    assert len({r["hash"] for r in material_hash(df, ["id"], "doc", (), 1).collect()}) == 2


def test_retention_honours_its_days(spark):
    df = spark.sql("select date_sub(date '2024-03-31', id) as d from (select explode(sequence(0, 99)) as id)")
    assert sinks.keep_recent(df, "d", F.lit(dt.date(2024, 3, 31)), 90).count() == 91
    with pytest.raises(ValueError):
        sinks.keep_recent(df, "d", F.lit(dt.date(2024, 3, 31)), 0)


def test_upsert_of_a_key_that_moves(spark, tmp_path):
    schema, path = "id int, v int, year int", str(tmp_path / "t")
    sinks.upsert_partitions(spark, path, spark.createDataFrame([(1, 10, 1998), (2, 20, 1998), (3, 30, 1997)], schema), ["id"], "year")
    for _ in range(2):
        sinks.upsert_partitions(spark, path, spark.createDataFrame([(1, 99, 1999)], schema), ["id"], "year")
        assert {tuple(r) for r in spark.read.schema(schema).parquet(path).collect()} == {(1, 99, 1999), (2, 20, 1998), (3, 30, 1997)}
    sinks.upsert_partitions(spark, path, spark.createDataFrame([(3, 31, 1999)], schema), ["id"], "year")
    assert {tuple(r) for r in spark.read.schema(schema).parquet(path).collect()} == {(1, 99, 1999), (2, 20, 1998), (3, 31, 1999)}


def test_upsert_keeps_the_rest_of_a_null_partition(spark, tmp_path):
    schema, path = "id int, v int, year int", str(tmp_path / "t")
    sinks.upsert_partitions(spark, path, spark.createDataFrame([(1, 10, None), (2, 20, None), (3, 30, None), (4, 40, 1998)], schema), ["id"], "year")
    sinks.upsert_partitions(spark, path, spark.createDataFrame([(1, 11, 1998)], schema), ["id"], "year")
    assert {tuple(r) for r in spark.read.schema(schema).parquet(path).collect()} == {(1, 11, 1998), (2, 20, None), (3, 30, None), (4, 40, 1998)}
    sinks.upsert_partitions(spark, path, spark.createDataFrame([(2, 21, None)], schema), ["id"], "year")
    assert {tuple(r) for r in spark.read.schema(schema).parquet(path).collect()} == {(1, 11, 1998), (2, 21, None), (3, 30, None), (4, 40, 1998)}


def test_repeated_filings_count_once(spark):
    df = spark.createDataFrame([("a", "Items: 1.01 and 9.01"), ("a", "Items: 1.01 and 9.01")], "accession_number string, items string")
    assert [r["item_count"] for r in classify_filings(df).collect()] == [2]


def test_numeric_references(spark):
    texts = ["&#65;&#x42;&#X1F600;&#8364;", "&#39;&#34;&#160;|&lt;&amp;&gt;", "&#0;&#xD800;&#99999999;&#;", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(decode_entities("t")).collect()] == ["AB\U0001f600€", "'\" |<&>", "&#0;&#xD800;&#99999999;&#;", "plain"]


def test_large_trades_of_a_long_day(spark):
    n = 12_000
    rng = np.random.default_rng(1)
    rows = [("T", dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 15) + dt.timedelta(milliseconds=k), k, float(p), 2, "BUY" if k % 3 else "SELL") for k, p in enumerate(rng.permutation(n) + 1)]
    df = spark.createDataFrame(rows, "ticker string, trade_date date, trade_time timestamp, sequence long, price double, volume long, direction string")
    r = large_trades(df).first()
    t = np.array([x[4] * 2 for x in rows])
    limit = np.quantile(t, 0.95)
    assert r["large_sample"] == n and r["large_threshold"] == pytest.approx(limit)
    assert r["large_buy_turnover"] == pytest.approx(sum(v for v, x in zip(t, rows, strict=True) if v >= limit and x[6] == "BUY"))


def test_replaced_children_are_not_sorted(spark):
    stored = spark.range(3000).select((F.col("id") % 1000).alias("k"), F.col("id").alias("v"))
    parents = spark.range(0, 1200, 2).select(F.col("id").alias("k"))
    new = spark.createDataFrame([(0, -1), (2, -2), (2, -3)], "k long, v long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        df = sinks.replace_children(parents, new, stored, "k")
        got = {tuple(r) for r in df.collect()}
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {(v % 1000, v) for v in range(3000) if v % 1000 % 2} | {(0, -1), (2, -2), (2, -3)}
    assert "ShuffledHashJoin" in plan and "Sort" not in plan


def test_corroboration_reads_its_articles_once(spark, tmp_path):
    day = lambda k: dt.date(2024, 1, k)
    rows = [("a", day(1), "x", "TIER_2"), ("a", day(3), "y", "TIER_2"), ("a", day(6), "y", "TIER_2"), ("a", day(6), "y", "TIER_2"), ("b", day(1), "x", "TIER_1"), ("c", day(1), None, "TIER_2"), (None, day(1), "x", "TIER_1"), ("d", None, "x", "TIER_1")]
    spark.createDataFrame(rows, "k string, published_on date, publisher string, source_tier string").write.parquet(str(tmp_path / "t"))
    df = corroboration(spark.read.parquet(str(tmp_path / "t")), "k")
    assert {tuple(r) for r in df.collect()} == {("a", day(1), 2, True), ("a", day(3), 2, True), ("a", day(6), 1, False), ("b", day(1), 1, True), ("c", day(1), 0, False)}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_filings_are_classified_row_by_row(spark):
    rows = [("a", "Items: 9.01 and 4.02"), ("b", "2.02, 5.02"), ("c", "none"), ("d", None), ("e", "8.8 and 1.03 and 8.8")]
    df = classify_filings(spark.createDataFrame(rows, "accession_number string, items string"))
    got = {r.accession_number: (r.item_count, r.severity, r.primary_item, r.event_type) for r in df.collect()}
    assert got == {"a": (2, "P1", "4.02", "SEC_8K_ITEM_4_02"), "b": (2, "P2", "2.02", "SEC_8K_ITEM_2_02"), "c": (0, "P3", None, "SEC_8K_UNSPECIFIED"),
                   "d": (0, "P3", None, "SEC_8K_UNSPECIFIED"), "e": (2, "P0", "1.03", "SEC_8K_ITEM_1_03")}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Generate" not in plan  # repeated filings are the only groups


def test_facts_of_reduced_quarters_do_not_read_orders(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    views.quarter_totals(spark, d).write.parquet(str(tmp_path / "q"))
    q = spark.read.parquet(str(tmp_path / "q"))
    for view in (views.annual_facts, views.eps_facts):
        df = view(spark, d, q)
        assert sorted(map(str, df.collect())) == sorted(map(str, view(spark, d).collect()))
        assert "o_orderkey" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_written_bars_are_the_bars_without_a_sort_of_raw_rows(spark, tmp_path):
    day = lambda k: dt.date(2024, 1, k) if k else None
    rows = [(o, n, (n or 0) * 3, s, day(k), float(e), float(q)) for o, n, s, k, e, q in [
        (5, 1, 1, 2, 50, 5), (5, 2, 1, 2, 90, 3), (5, 2, 1, 2, 80, 4), (7, 1, 1, 2, 10, 1), (6, 1, 11, 2, 1000, 1), (None, 1, 1, 3, 30, 3), (None, 2, 1, 3, 40, 5), (1, 1, 1, 3, 7, 2),
        (2, None, 2, 2, 8, 2), (2, 1, 2, 2, 9, 2), (None, 4, 2, None, 6, 3), (3, 1, None, 4, 6, 3), (3, 2, None, 4, 1, 3), (4, 1, None, None, 2, 8), (-2**63, 1, 3, 5, 1, 1), (None, 9, 3, 5, 3, 1)]]
    schema = "l_orderkey long, l_linenumber int, l_partkey int, l_suppkey long, l_shipdate date, l_extendedprice double, l_quantity double"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    for d in (str(tmp_path), "/root/testdata/sf0.001"):
        want, got = views.bars(spark, d), views.written_bars(spark, d)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = views.bar_bounds(views.bar_rows(views.table(spark, str(tmp_path), "lineitem")))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
