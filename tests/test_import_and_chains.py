"""Trade-import files, greedy selection of long chains, and selections with one name left out."""
from __future__ import annotations

import random

from pyspark.sql import functions as F

from marketloom.operators import factors as FA, quality as Q, series as SE
from marketloom.sources import readers as R

HEADER = list(R.IMPORT_HEADERS)
LINE = "2024-01-02,t1,N,买入,100,5.5,,"


def test_import_files(spark, tmp_path):
    files = {
        "first.csv": [",".join(HEADER), LINE],
        "fourth.csv": ["Trades", "", "x,y", ",".join(HEADER[::-1]), ",".join(LINE.split(",")[::-1]), "", ",,,,,,,", "note,0,9,-1,SELL,n,t2,2024-02-30"],
        "bom.csv": ["﻿" + ",".join([*HEADER, "更多"]), LINE + ",ignored", '2024-01-03,t1,"A, B",sell,"1,000",$7,1,"say ""so"""', LINE],
        "missing.csv": [",".join(HEADER[:5]), LINE],
        "late.csv": ["x"] * 10 + [",".join(HEADER), LINE],
        "none.csv": [",".join(HEADER), ""],
        "many.csv": [",".join(HEADER)] + [LINE] * 1001,
        "full.csv": [",".join(HEADER)] + [f"2024-01-02,t1,N,BUY,{k + 1},5.5,," for k in range(1000)],
        "empty.csv": []}  # Spark's readers pass over files without a byte
    for name, lines in files.items():
        (tmp_path / name).write_bytes("\r\n".join(lines).encode())
    (tmp_path / "large.csv").write_bytes((",".join(HEADER) + "\n").encode() + b"x" * R.IMPORT_BYTES)
    rows, faults = R.read_trade_import(spark, str(tmp_path))
    base = F.element_at(F.split("file", "/"), -1)
    assert {(r[0], r[1]) for r in faults.select(base, "error").collect()} == {("missing.csv", "MISSING:成交价,交易费用,备注"), ("late.csv", "NO_HEADER"), ("none.csv", "NO_ROWS"), ("many.csv", "TOO_MANY_ROWS"), ("large.csv", "TOO_LARGE")}
    checked = Q.validate_import(rows, ("file",)).select(base.alias("f"), "row_no", "trade_date", "ticker_n", "side_n", "quantity", "price_n", "fee_n", "name", "note", F.array_join("errors", ",").alias("errors"))
    got = {(r.f, r.row_no): r for r in checked.where("f <> 'full.csv'").collect()}
    assert set(got) == {("first.csv", 2), ("fourth.csv", 5), ("fourth.csv", 8), ("bom.csv", 2), ("bom.csv", 3), ("bom.csv", 4)}
    assert got["fourth.csv", 5][3:8] == got["first.csv", 2][3:8] and got["first.csv", 2].errors == ""
    assert got["fourth.csv", 8].errors == "DATE,QUANTITY" and got["fourth.csv", 8].note == "note"
    assert (got["bom.csv", 3].quantity, got["bom.csv", 3].price_n, got["bom.csv", 3].name, got["bom.csv", 3].note) == (1000.0, 7.0, "A, B", 'say "so"')
    assert got["bom.csv", 4].errors == "DUPLICATE" and checked.where("f = 'full.csv' AND errors = ''").count() == 1000


def test_import_files_are_parsed_once(spark, tmp_path):
    for name, n in (("a.csv", 3), ("b.csv", 1001), ("c.csv", 0)):
        (tmp_path / name).write_text("\n".join([",".join(HEADER)] + [LINE] * n + [""] * 1200))
    rows, faults = R.read_trade_import(spark, str(tmp_path))
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (rows, faults)]
    assert not any("from_csv" in p for p in plans)
    base = F.element_at(F.split("file", "/"), -1)
    assert sorted(r[0] for r in rows.select(base).collect()) == ["a.csv"] * 3
    assert sorted(map(tuple, faults.select(base, "error").collect())) == [("b.csv", "TOO_MANY_ROWS"), ("c.csv", "NO_ROWS")]


def greedy(pairs):
    kept, last = [], None
    for s, e in sorted(pairs):
        if last is None or s > last:
            kept.append(s)
            last = e
    return kept


def test_greedy_selection_of_many_keys_and_ties(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(300), 0, f"r{k}") for k in range(600)]
    rows = [(k, s, s + rng.randrange(9), n) for k, s, _, n in rows]
    df = spark.createDataFrame(rows, "k string, s long, e long, n string").repartition(7)
    got = sorted(((r.k or "", r.s, r.n) for r in SE.non_overlapping(df, ["k"], "s", "e").collect()))
    want = {k: set(greedy([(s, e) for key, s, e, _ in rows if key == k])) for k in ("a", "b", None)}
    assert got == sorted((k or "", s, n) for k, s, _, n in rows if s in want[k])
    assert SE.non_overlapping(df.limit(0), ["k"], "s", "e").count() == 0
    gaps = spark.createDataFrame([("a", 1, 9), ("a", 10, None), ("a", 11, 30), ("a", None, 5)], "k string, s long, e long")
    assert sorted(r.s for r in SE.non_overlapping(gaps, ["k"], "s", "e").collect()) == [1, 10, 11]


def test_greedy_selection_of_a_million_signals_of_one_key(spark):
    df = spark.range(1_000_000).select(F.lit("hot").alias("k"), F.col("id").alias("s"), (F.col("id") + 20).alias("e"))
    kept = SE.non_overlapping(df, ["k"], "s", "e")
    assert kept.count() == 47620 and kept.where("s % 21 <> 0").count() == 0


def test_leave_one_out_equals_selecting_without_each_name(spark):
    rng = random.Random(3)
    rows = [(d, f"T{k:02d}", "XYZ"[k % 3], rng.randrange(6) / 2) for d in range(12) for k in range(rng.randint(1, 14))]
    df = spark.createDataFrame(rows, "month int, ticker string, sector string, score double")

    def select(names):
        groups, picks = {}, []
        for _, t, g, s in sorted(names, key=lambda r: (-r[3], r[1])):
            groups[g] = groups.get(g, 0) + 1
            if groups[g] <= 2:
                picks.append(t)
        return picks[:5]

    got = {}
    for r in FA.leave_one_out(df, ["month"], 5, 2).collect():
        got.setdefault((r.month, r.excluded), {})[r.pick] = r.ticker
    for d in range(12):
        names = [r for r in rows if r[0] == d]
        base = select(names)
        assert [got[d, None][k + 1] for k in range(len(base))] == base
        for _, t, *_ in names:
            want = select([r for r in names if r[1] != t])
            mine = got.get((d, t), {} if t in base else got[d, None])
            assert [mine[k + 1] for k in range(len(mine))] == want


def test_every_name_of_the_universe_is_left_out_of_every_signal(spark):
    rng = random.Random(5)
    rows = [(d, f"T{k:02d}", "XYZ"[k % 3], rng.randrange(6) / 2) for d in range(6) for k in range(rng.randint(1, 14))]
    df = spark.createDataFrame(rows, "month int, ticker string, sector string, score double")
    universe = spark.createDataFrame([(f"T{k:02d}",) for k in range(1, 20)], "ticker string")
    want = FA.capped_top(df.join(universe.select(F.col("ticker").alias("excluded"))).where("ticker <> excluded"), ["excluded", "month"], "sector", "score", "ticker", 5, 2)
    got = FA.leave_one_out(df, ["month"], 5, 2, universe=universe)
    key = ["excluded", "month", "ticker", "pick"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    assert {r.excluded for r in got.select("excluded").collect()} == {f"T{k:02d}" for k in range(1, 20)}
