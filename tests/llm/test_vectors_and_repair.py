"""Nearest neighbours, whitening and conversation repair against brute force, on small tables with odd rows."""
from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from marketloom.llm import nearest, queries, repair, whitening

DIR = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, x long, unit long, kind int, score double, n long, component int, class string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5.0, 6, 7, "c") for i, v in rows], VECTORS)


def odd_vectors(d):
    one = [1.0] * d
    return [(2000, None), (2020, [None] + one[1:]), (2040, [float("nan")] + one[1:]), (2060, [float("inf")] + one[1:]), (2080, []), (2100, one + [1.0]), (2120, [0.0] * d)]


@pytest.fixture(scope="module")
def clustered():
    """Random directions of different lengths, a tight cluster, many copies of one vector, a repeated row, a negative zero."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 12)).astype(np.float32)
    x[100:200] = x[100] + 0.01 * rng.standard_normal((100, 12))
    x[200:400] = x[200]
    x[400, 0] = -0.0
    rows = [(i - 20, v.tolist()) for i, v in enumerate(x)]
    return rows + [rows[5], rows[40]]


def test_chi_square_quantile():
    assert abs(nearest.chi_square_quantile(0.95, 16) - 26.2962) < 1e-3 and abs(nearest.chi_square_quantile(0.5, 2) - 2 * math.log(2)) < 1e-9


def test_tree_search_without_stop_is_exact():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 10))
    y = np.concatenate([x, np.sqrt((x * x).sum(axis=1).max() - (x * x).sum(axis=1))[:, None]], axis=1) @ nearest.directions(10)
    tree, top = nearest.Tree(x, y, np.arange(3000)), float((x * x).sum(axis=1).max())
    for q in x[:20]:
        scale = math.sqrt(top / (q @ q))
        found = tree.search(q, (q * scale) @ nearest.directions(10)[:10], scale, top, -math.inf, 21, 1e9)
        assert sorted(i for _, _, i in found) == sorted(np.argsort(-(x @ q), kind="stable")[:21].tolist())


def test_nearest(spark, clustered):
    rows = vectors(spark, clustered + odd_vectors(12) + [(None, [1.0] * 12)])
    got = {}
    for r in nearest.nearest(rows).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = {i: np.array(v, float) + 0.0 for i, v in clustered}
    assert set(got) == {i for i in x if i % 20 == 0}
    hits = total = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        assert all(abs(s - float(x[v] @ x[q])) <= 1e-12 * (1 + abs(s)) for _, v, s in found)
        best = sorted((-float(np.einsum("i,i->", v, x[q])), i) for i, v in x.items() if i != q)[:20]
        hits, total = hits + sum(s >= -best[-1][0] - 1e-12 for _, _, s in found), total + 20
    assert hits / total >= 0.95
    # copies (ids 180 to 379) have one score and go by id, their own left out
    for q in range(180, 380, 20):
        copies = [v for _, v, s in got[q] if 180 <= v < 380]
        assert copies == [v for v in range(180, 380) if v != q][:len(copies)] and len({s for _, v, s in got[q] if v in copies}) == 1


def test_nearest_of_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest.nearest(vectors(spark, rows)).collect())
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 3, 2.0), (20, 2, 0, 0.0)]
    assert nearest.nearest(vectors(spark, rows[:1])).collect() == []
    assert nearest.nearest(vectors(spark, rows).limit(0)).collect() == [] and nearest.nearest(vectors(spark, odd_vectors(2)[:5])).collect() == []


def test_nearest_over_many_units(spark, monkeypatch):
    """Cells, parts of cells and blocks of queries don't change what is found."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1500, 8))
    rows = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    x = x.astype(np.float32).astype(float)
    for name, value in (("UNIT", 100), ("CELLS", 8), ("QUERIES", 20), ("SAMPLE", 200)):
        monkeypatch.setattr(nearest, name, value)
    hits = 0
    for r in nearest.nearest(rows).collect():
        s = x @ x[r["query_id"]]
        s[r["query_id"]] = -np.inf
        hits += r["score"] >= np.sort(s)[-20] - 1e-12
    assert hits / (75 * 20) >= 0.95


@pytest.mark.parametrize("kind", ["random", "identity", "low rank", "repeated", "close", "shift met"])
def test_leading_components(kind):
    rng = np.random.default_rng(2)
    n = 30
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    spectrum = {"identity": np.ones(n), "low rank": np.r_[3.0, 1.0, np.zeros(n - 2)], "repeated": np.r_[[5.0] * 3, np.ones(n - 3)], "close": np.linspace(1, 1 + 1e-6, n),
                "shift met": np.r_[3.0, 2.5, 1.0, 1.5, np.full(n - 4, 2.0)], "random": rng.random(n)}[kind]
    a = whitening.symmetric(q @ np.diag(spectrum) @ q.T)
    e, u = whitening.leading_components(a)
    assert np.abs(e - np.sort(spectrum)[::-1][:4]).max() < 1e-13
    assert np.linalg.norm(a @ u.T - u.T * e) < 1e-12 and np.abs(u @ u.T - np.eye(4)).max() < 1e-12


def test_polar():
    a = whitening.symmetric(np.random.default_rng(3).standard_normal((12, 12)))
    e, v = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - v @ np.diag(np.sign(e)) @ v.T).max() < 1e-12


def test_whitening(spark, clustered):
    found = whitening.whiten(vectors(spark, clustered + odd_vectors(12) + [(None, [1.0] * 12)])).collect()
    every = [*clustered, (2120, [0.0] * 12), (None, [1.0] * 12)]
    x = [[math.floor(256 * float(c)) for c in np.array(v, np.float32)] for _, v in every]
    fit = sorted({tuple(v) for v in x})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    assert len(found) == 4 * len(every) and {r["n"] for r in found} == {n}
    deviation = sorted((i is None, i or 0, sum((n * c - s) ** 2 for c, s in zip(v, total, strict=True))) for (i, _), v in zip(every, x, strict=True))
    assert deviation == sorted((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"]) for r in found if r["component"] == 1)
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, total, strict=True)] for v in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:4], u[:, ::-1][:, :4].T
    by = {(r["vec_id"], r["component"]): r for r in found}
    for k in range(4):
        assert abs(by[0, k + 1]["explained"] - e[k] / np.trace(centred.T @ centred / n)) < 1e-12
        want = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, total, strict=True)] for v in x]) @ u[k] / math.sqrt(e[k])
        got = np.array([by[i, k + 1]["whitened"] for i, _ in every])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9
    assert max(r["identity_error"] for r in found) < 1e-9 and len({r["identity_error"] for r in found}) == 1


def test_whitening_of_flat_and_no_data(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 4.0])]
    found = {(r["vec_id"], r["component"]): r for r in whitening.whiten(vectors(spark, rows)).collect()}
    assert len(found) == 6 and abs(abs(found[1, 1]["whitened"]) - math.sqrt(1.5)) < 1e-12 and found[1, 2]["whitened"] is None and found[1, 1]["explained"] == 1.0
    same = whitening.whiten(vectors(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert len(same) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(1, 0, None, None, 0.0)}
    large = whitening.whiten(vectors(spark, [(1, [1e12, 0.0]), (2, [-1e12, 0.0])])).collect()
    assert {r["deviation"] for r in large} == {None}
    assert whitening.whiten(vectors(spark, rows).limit(0)).collect() == [] and whitening.whiten(vectors(spark, odd_vectors(2)[:5])).collect() == []


SAID = "conv_id long, turn long, role string, text string, part long, node long, cost long, first string, same string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x", "y") for r in rows], SAID)


def damage(rows):
    kept = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return kept


def repair_by_force(rows):
    """Figures of one conversation: cheapest edits by dynamic programming over whole strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if text.rstrip(" \t\n\v\f\r")[-1] in ".!?" else "truncated")
        seen.add((role, text))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, ""), "a": (0, ""), "u": (5, "I"), "s": (10, "II")}
    for (_, role, _), fault in zip(rows[::-1], faults[::-1], strict=True):
        extra, now = 5 if fault == "truncated" else 0, {}
        for q in follow:
            ways = [(2 + best[q][0], "D" + best[q][1])]
            if fault not in ("blank", "duplicate"):
                if role[:1] and role[:1] in follow[q]:
                    ways.append((extra + best[role[:1]][0], "K" + best[role[:1]][1]))
                ways.append((1 + extra + best[follow[q][-1]][0], "R" + best[follow[q][-1]][1]))
            now[q] = min(ways)
        for _ in range(4):
            now = {q: min(v, (5 + now[follow[q][-1]][0], "I" + now[follow[q][-1]][1])) for q, v in now.items()}
        best = now
    cost, audit = best[""]
    left, state, lines = list(rows), "", []
    name = {"u": "user", "a": "assistant"}
    for edit in audit:
        if edit == "I":
            lines.append(name[follow[state][-1]] + ":")
            state = follow[state][-1]
            continue
        _, role, text = left.pop(0)
        if edit != "D":
            role = name[follow[state][-1]] if edit == "R" else role
            lines.append(f"{role}:{text}")
            state = role[0]
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows, ids):
    by = {i: [] for i in ids}
    for conv, *rest in rows:
        by[conv].append(tuple(rest))
    return {i: repair_by_force(r) for i, r in by.items()}


def said(rng, conv, n, start=0):
    roles = [rng.choice(["system", "user"])] + [["user", "assistant"][k % 2] for k in range(n)]
    return [(conv, start + k, r, rng.choice(["Yes.", "What is it?", "No", "ok!", "a longer answer that ends. ", f"number {k}."])) for k, r in enumerate(roles[:n])]


def test_repair(spark):
    rng = random.Random(8)
    rows = [r for c in range(120) for r in said(rng, c, rng.randint(1, 9))]
    rows += [(500, None, "user", "first."), (500, None, None, None), (500, 3, "tool", "x."), (500, 3, "", "y."), (501, None, None, None), (None, 1, "user", "hm?"), (None, 2, "assistant", "hm."),
             (502, 1, "user", "long " * 40000 + "."), (502, 2, "assistant", " "), (502, 2, "assistant", "\t\n"), (502, 5, "user", " "), (503, 7, "System", "é?"), (503, 7, "system", "é?")]
    rows += said(rng, 600, 700) + [(601, k, "user", "same.") for k in range(300)] + [(602, 1, "user", "same.")] * 300 + [(603, k, rng.choice("suat"), rng.choice([".", "", "x", f"{k}!"])) for k in range(4500)]
    given = conversations(spark, rows)
    broken = damage(rows)
    assert sorted(map(str, broken)) == sorted(str(tuple(r)) for r in repair.damaged(given).collect())
    ids = {r[0] for r in rows}
    want = expected(broken, ids)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repaired(repair.damaged(given), given).collect()}
    assert got == want
    assert repair.repaired(given.limit(0)).collect() == []


def test_repair_of_nothing_left(spark):
    given = conversations(spark, [(1, 1, "user", "a."), (2, 1, "user", "b.")])
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repaired(given.where("conv_id = 1"), given).collect()}
    assert got[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and got[1][5:7] == (2, "D")


def test_auction_prices_are_feasible():
    rng = random.Random(6)
    for _ in range(200):
        arcs, price = repair.lattice([(rng.choice("suat"), rng.randint(0, 3)) for _ in range(rng.randint(1, 12))], True)
        cost = repair.auction(arcs, 0, len(arcs) - 1, price)
        assert all(price[at] <= c + price[end] for at, out in enumerate(arcs) for c, _, end in out)
        assert sum(a[0] for a in repair.least_path(arcs, 0, len(arcs) - 1, price)) == cost


def test_queries_read_whole_tables(spark):
    e, c = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("embeddings", "conversations"))
    assert queries.op12_whitening(spark, DIR).count() == 4 * e.count()
    assert queries.op11_nearest_neighbours(spark, DIR).count() == 20 * e.where("vec_id % 20 = 0").count()
    found = queries.op13_conversation_repair(spark, DIR).collect()
    rows = [tuple(r) for r in c.select("conv_id", "turn", "role", "text").collect()]
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == expected(damage(rows), {r[0] for r in rows})
