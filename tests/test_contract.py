"""The driver contract: names, oracle coverage and the flagship query."""
import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200


def test_flagship_query(spark):
    df = entry.entry(spark)
    assert df.columns == ["ticker", "trade_date", "score", "signal"] and df.limit(5).count() == 5
