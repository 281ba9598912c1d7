"""Streams over several batches: late files, repeats long after, restarts and replayed batches, against the batch functions."""
from __future__ import annotations

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import ticks as O
from marketloom.streaming import ticks as ST

START = dt.datetime(2024, 3, 1, 14, 0)
COLUMNS = ["ticker", "trade_date", "session", "minute", "buy_turnover", "sell_turnover", "neutral_turnover", "buy_count", "sell_count", "neutral_count", "volume", "last_price"]


def tick(rng, k, day):
    at = START + dt.timedelta(days=day, seconds=rng.randrange(600))
    return (rng.choice("AB"), k, at, at.date(), round(rng.uniform(1, 9), 2), float(rng.randint(1, 9)), None, rng.choice(["BUY", "sell", "other", None]), None)


@pytest.fixture()
def files(spark, tmp_path):
    """Four files of one batch each: every file holds all of twelve days, and repeats ticks of earlier files."""
    rng = random.Random(4)
    ticks = [tick(rng, k, rng.randrange(12)) for k in range(400)]
    parts = [ticks[k::4] for k in range(4)]
    folder = tmp_path / "in"
    for k, part in enumerate(parts):
        again = [t for p in parts[:k] for t in p[:20]]
        spark.createDataFrame(part + again, ST.TICK_SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder), spark.createDataFrame(ticks, ST.TICK_SCHEMA), tmp_path


def stream(spark, folder):
    return ST.read_tick_stream(spark, folder, "*.parquet", ST.TICK_SCHEMA, lambda x: x, files_per_batch=1)


def rows(df):
    return sorted(map(str, df.collect()))


def test_late_files_give_the_batch_result(spark, files):
    folder, ticks, _ = files
    assert rows(ST.minute_flow_table(stream(spark, folder)).select(*COLUMNS)) == rows(O.minute_flow(ticks).select(*COLUMNS))
    d = O.normalize_ticks(ticks).groupBy("ticker", "trade_date").agg(*O.direction_sums()).select("ticker", "trade_date", "buy_turnover", "sell_turnover", "neutral_turnover")
    assert rows(ST.day_flow_table(stream(spark, folder)).drop("active_ratio")) == rows(d)


def test_repeats_are_dropped_for_good(spark, files):
    """Also ten days later, in another run of the stream, and when a batch is replayed after a crash."""
    folder, ticks, tmp = files
    root = str(tmp / "state")

    def run():
        return ST.run_to_table(ST.exactly_once(stream(spark, folder)), "append", root=root)

    assert run().count() == 400
    first = ticks.limit(30).collect()
    moved = [(*t[:2], t.trade_time + dt.timedelta(days=10), *t[3:]) for t in first]  # the same tick, stamped ten days later
    rng = random.Random(9)
    fresh = [tick(rng, 1000 + k, 0) for k in range(5)]
    spark.createDataFrame(moved + fresh, ST.TICK_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    assert run().count() == 405
    commits = sorted((tmp / "state" / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)  # as after a crash between the sink and the commit
    assert run().count() == 405 == run().select("ticker", "trade_date", "sequence").distinct().count()


def test_an_alert_comes_once_ever(spark, files):
    folder, ticks, _ = files
    a = stream(spark, folder).select(F.concat_ws(":", "ticker", F.col("trade_date").cast("string")).alias("event_key"), "trade_time")
    got = [r.event_key for r in ST.run_to_table(ST.alerts_once(a), "append").collect()]
    assert len(got) == len(set(got)) and set(got) == {f"{t.ticker}:{t.trade_date}" for t in ticks.collect()}


def test_sliding_totals(spark, files):
    folder, ticks, _ = files
    panes = ST.run_to_table(ST.exactly_once(stream(spark, folder)), "append", each=ST.hourly_panes("ticker", "trade_time"))
    hours = collections.defaultdict(list)
    for t in ticks.collect():
        hours[t.ticker].append(t.trade_time)
    want = []
    for k, at in hours.items():
        end = min(at).replace(minute=0, second=0) + dt.timedelta(hours=1)
        while end <= max(at).replace(minute=0, second=0) + dt.timedelta(hours=168):
            n = lambda a, b: sum(end - dt.timedelta(hours=a) <= x < end - dt.timedelta(hours=b) for x in at)
            c, p = n(24, 0), n(48, 24)
            want.append((k, end, c, p, n(168, 0), int((c - p) / p * 1e4 + 0.5 + 1e8) / 1e4 - 1e4 if p else None))
            end += dt.timedelta(hours=1)
    got = sorted(tuple(r) for r in ST.sliding_totals(panes, "ticker").collect())
    assert [r[:5] for r in got] == [r[:5] for r in sorted(want, key=lambda r: r[:2])]
    assert all((a[5] is None) == (b[5] is None) and (a[5] is None or abs(a[5] - b[5]) < 1.1e-4) for a, b in zip(got, sorted(want, key=lambda r: r[:2]), strict=True))
