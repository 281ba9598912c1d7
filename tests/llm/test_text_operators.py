"""The text operators against brute force on small tables with nulls, empty and long texts, repeated rows and clashing columns."""
from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketloom.llm import bpe, chat, lcp, packing, paragraphs, quality, queries, rules, simhash, toxicity, warc
from marketloom.llm.common import bucket_links, components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, class long, id long, key long, start int, fp long"
VOCABULARY = [f"{a}{b}{c}" for a in ("sto", "ran", "mil", "fe", "quo") for b in ("da", "ven", "ri", "lo") for c in ("n", "ta", "mer", "x", "é")]


def prose(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(VOCABULARY) + rng.choice(("x", "y", "")) + ("\n" if rng.random() < 0.05 else " ") for _ in range(n)).strip()


def frame(spark, texts, ids=None):
    rows = [(i, t, "en" if k % 2 else "de", f"s{k % 2}", len(t) if t is not None else None, 0.5, True, 1, 2, 3, 4, 5)
            for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, a shared passage, odd ones, and a null; the last two rows repeat an id."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(60, 300)) for _ in range(30)]
    passage = prose(rng, 60).replace("\n", " ")
    for k in (3, 7, 11):
        w = texts[k].split(" ")
        texts[k] = " ".join([*w[:17 + k], passage, *w[17 + k:]])
    texts += [texts[0], texts[1].replace(" ", "  "), texts[2] + " end", None, "", "   \n\t ", "one", "two words", "a b c d", "A B C D", "same " * 400, prose(rng, 6000)]
    return texts + [texts[4], texts[5], texts[5]], [*range(42), 2, 100, 100]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_components_and_hot_buckets(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges, "t").collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}
    assert components(edges.limit(0), "t").count() == 0
    rows = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 60)], "key long, id long")

    def chain(unit, starts):  # neighbours link: only pairs of blocks that hold both can see them
        u = [a for s, e in zip(starts[:-1], starts[1:], strict=True) for a in unit["id"].to_pylist()[s:e] if a + 1 in unit["id"].to_pylist()[s:e]]
        return np.array(u, np.int64), np.array(u, np.int64) + 1

    found = {tuple(r) for r in bucket_links(rows, chain, cap=8).collect()}
    assert found == {(k, k + 1) for k in range(49)}


def test_simhash(spark, corpus):
    texts, ids = corpus

    def fingerprint(t):
        w = words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        s = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    least = [min(ids[b] for b in range(len(texts)) if root[b] == root[a]) for a in range(len(texts))]
    docs = frame(spark, texts, ids)
    got = collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == collections.Counter((i, f"{f:016x}", c) for i, f, c in zip(ids, prints, least, strict=True))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert len(kept.collect()) == len(set(root)) and {prints[ids.index(r["doc_id"])] for r in kept.select("doc_id").distinct().collect()} <= set(prints)
    assert simhash.one_of_each(docs.limit(0)).count() == 0
    alone = simhash.near_duplicates(frame(spark, ["x y z w v", "x y z w v"], [None, None])).collect()
    assert [r["component_id"] for r in alone] == [None, None]


def test_simhash_links_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2 ** 63, 30, dtype=np.uint64)
    x = np.unique(np.concatenate([centre ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k % 5 + 1, 30), dtype=np.uint64), axis=0) for k in range(40)]))
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    got = {r["fp"]: r["root"] for r in simhash.link_classes(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")).withColumnRenamed("node", "fp").collect()}
    signed = x.view(np.int64)
    for k in range(len(x)):
        mine = {int(signed[j]) for j in np.flatnonzero(label == label[k])}
        if len(mine) > 1:
            assert got[int(signed[k])] == min(mine)
        else:
            assert int(signed[k]) not in got


def test_substring_dedup(spark, corpus):
    texts, ids = corpus
    docs = frame(spark, texts, ids)
    rows = paragraphs.repeated_passages(docs).collect()
    grams = collections.defaultdict(set)
    for i, t in zip(ids, texts, strict=True):
        w = words((t or "").lower())
        for k in range(len(w) - 49):
            grams[tuple(w[k:k + 50])].add(i)
    want = set().union(*[v for v in grams.values() if len(v) > 1])
    assert {3, 7, 11} <= want <= {r["doc_id"] for r in rows}
    clean = set(range(12, 30)) | {33, 34, 35, 36, 37, 38, 39}
    assert not clean & {r["doc_id"] for r in rows}
    cut = paragraphs.without_repeats(docs)
    assert cut.columns == docs.columns
    new = {(r["doc_id"], k): r for k, r in enumerate(cut.collect())}
    assert len(new) == len(texts) and sum(r["text"] is None for r in new.values()) == 1
    by_id = {r["doc_id"]: r for r in new.values()}
    assert by_id[3]["text"] == texts[3] and len(words(by_id[7]["text"])) < len(words(texts[7])) - 30 and by_id[7]["n_chars"] == len(by_id[7]["text"])
    assert by_id[20]["text"] == texts[20]
    assert paragraphs.repeated_passages(docs.limit(0)).count() == 0
    assert paragraphs.cut("a b  c\nd e", [(1, 2), (4, 1)]) == "a d "


def test_near_paragraphs_share_a_class(spark):
    rng = random.Random(1)
    long = prose(rng, 40).split()
    a, b = " ".join([*long, "tail"]), " ".join(["head", *long])
    s = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in ([*long, "tail"], ["head", *long])]
    assert len(s[0] & s[1]) / len(s[0] | s[1]) > 0.8
    found = paragraphs.repeated_passages(frame(spark, [a, b])).collect()
    assert {r["doc_id"] for r in found} == {0, 1}


def planted(rng, n, changes, copies=2):
    """Texts around copies of one passage of ``n`` words; each copy but the first has ``changes`` words replaced, evenly spread."""
    p = [f"p{rng.randrange(10**6)}" for _ in range(n)]
    out = []
    for k in range(copies):
        q = list(p)
        for c in range(changes if k else 0):
            q[(c + 1) * n // (changes + 1)] = f"z{rng.randrange(10**6)}"
        around = [f"a{rng.randrange(10**6)}" for _ in range(120)]
        out.append((" ".join(around[:60] + q + around[60:]), 60, n))
    return out


def test_passages_with_changes_are_found(spark):
    """Passages of similarity 0.8 or more inside other text: found, and to their ends. Words around them stay, but a few that a similar outer paragraph brings."""
    cases = [(51, 0, 1, 0.99), (51, 1, 0.9, 0.85), (60, 1, 0.95, 0.9), (100, 2, 0.97, 0.95), (150, 3, 0.97, 0.95)]
    rng, each = random.Random(3), 150
    texts = [x for n, changes, *_ in cases for _ in range(each) for x in planted(rng, n, changes)]
    rows = paragraphs.repeated_passages(frame(spark, [t for t, _, _ in texts])).collect()
    assert all(r["start"] >= 56 and r["start"] + r["n_words"] <= 64 + texts[r["doc_id"]][2] for r in rows)
    gone = [r for r in rows if not r["kept"]]
    assert all(r["doc_id"] % 2 == 1 and r["first_doc_id"] == r["doc_id"] - 1 for r in gone)
    assert {r["doc_id"] + 1 for r in rows if r["kept"]} == {r["doc_id"] for r in gone}
    for k, (n, _, found, marked) in enumerate(cases):
        mine = [r for r in gone if r["doc_id"] // (2 * each) == k]
        print(cases[k], len({r["doc_id"] for r in mine}) / each, sum(r["n_words"] for r in mine) / (each * n))
        assert len({r["doc_id"] for r in mine}) >= found * each and sum(r["n_words"] for r in mine) >= marked * each * n


def test_extents_cross_changes():
    a = np.arange(40, dtype=np.uint32)
    assert paragraphs.extents(a, a) == [(40, 40, 0)]
    b = a.copy()
    b[20] = 99
    assert paragraphs.extents(a, b) == [(20, 20, 0), (40, 40, 5)]
    assert paragraphs.extents(a, np.delete(b, 20)) == [(20, 20, 0), (40, 39, 5)]
    assert paragraphs.extents(a, np.concatenate([a[:20], [77, 78], a[20:]])) == [(20, 20, 0), (40, 42, 6)]
    b[22:] = 98
    assert paragraphs.extents(a, b) == [(20, 20, 0)] and paragraphs.extents(a, a[:0]) == [(0, 0, 0)]


def test_one_occurrence_of_every_passage_stays(spark):
    """Chains of overlapping passages, a text that repeats itself, long equal words, and copies: each 30-word window still occurs."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base[k:k + 120]) for k in range(0, 280, 40)] + [" ".join(base[:150])] * 3 + [" ".join(base[200:260] * 4), "same " * 500, "same " * 300, None, ""]
    docs = frame(spark, texts)
    cut = [r["text"] for r in paragraphs.without_repeats(docs).collect()]
    left = {tuple(w[k:k + 8]) for w in (words(t or "") for t in cut) for k in range(len(w) - 7)}
    once = {tuple(base[k:k + 8]) for k in range(352)}
    assert len(once - left) <= 8 * 14  # only windows across a cut
    assert sum(len(words(t or "")) for t in cut) < 0.5 * sum(len(words(t or "")) for t in texts)
    assert {x for t in cut for x in words(t or "")} >= set(base[:352])


def test_quality_rules(spark, corpus):
    texts, ids = corpus
    docs = frame(spark, texts, ids)

    def base(t):
        w, t = words(t), t or ""
        count = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if count[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    extra = ["a\nb\na\n\n\na", "x y z x y z # $", "|" * 30, "p q\r\np q\r\np q"]
    docs = docs.unionByName(frame(spark, extra, [200, 201, 202, 203]))
    got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.quality_verdicts(docs).collect())
    assert got == collections.Counter((i, *base(t)) for i, t in zip([*ids, 200, 201, 202, 203], texts + extra, strict=True))
    for r in rules.quality_verdicts(docs).collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    stay = rules.kept(docs)
    assert stay.columns == docs.columns and set(range(30)) <= {r["doc_id"] for r in stay.collect()}
    assert rules.kept(docs.limit(0)).count() == 0
    assert rules.kept(docs.withColumn("lang", F.lit(None).cast("string")).drop("source")).count() > 20


def test_outliers_go_and_clean_rows_stay(spark):
    rng = random.Random(2)
    clean = [prose(rng, rng.randint(60, 200)) for _ in range(500)]
    junk = [" ".join(w + "###" for w in prose(rng, 100).split()) for _ in range(120)]
    got = {r["doc_id"]: r["kept"] for r in rules.quality_verdicts(frame(spark, clean + junk)).collect()}
    assert all(got[k] for k in range(500)) and not any(got[k] for k in range(500, 620))


def test_a_source_that_is_two_fifths_junk(spark):
    rng = random.Random(3)
    clean = [prose(rng, rng.randint(60, 200)) for _ in range(360)]
    junk = [" ".join(w + "###" for w in prose(rng, 100).split()) for _ in range(240)]
    docs = frame(spark, clean + junk).withColumns({"lang": F.lit("en"), "source": F.lit("hot")})
    got = {r["doc_id"]: r["kept"] for r in rules.quality_verdicts(docs).collect()}
    assert all(got[k] for k in range(360)) and not any(got[k] for k in range(360, 600))


def quality_tables(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(30, 200)) for _ in range(400)] + [" ".join(w.upper() + "!!" for w in prose(rng, 60).split()) for _ in range(100)]
    labels = [(k, int(k < 400), int(k % 7 == 0)) for k in range(500)]
    texts = [t + " vileword" if k % 7 == 0 else t for k, t in enumerate(texts)]
    return frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_classifier(spark):
    docs, labels = quality_tables(spark)
    more = docs.unionByName(frame(spark, [None, "", "x" * 300_000, "x"], [900, None, 901, 901]))
    rows = quality.quality_scores(more, labels).collect()
    assert len(rows) == 504 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in [*range(500), 900, 901] if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["predicted"] == int(r["doc_id"] < 400) for r in held if r["doc_id"] < 500]) > 0.97
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.quality_scores(more, flipped).collect()
    assert sorted(r["score"] for r in again) == pytest.approx(sorted(r["score"] for r in rows))
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and abs(kept.count() - 400) < 10
    assert quality.accepted(docs, labels.limit(0)).count() == 500 and quality.quality_scores(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        v, w = rng.random(12), rng.integers(1, 5, 12).astype(float)
        fit = quality.isotonic(v, w)
        want = [max(min(np.average(v[a:b + 1], weights=w[a:b + 1]) for b in range(k, 12)) for a in range(k + 1)) for k in range(12)]
        assert np.allclose(fit, want)


def test_toxicity(spark):
    docs, labels = quality_tables(spark)
    more = docs.unionByName(frame(spark, [None, "", "word " * 60_000, "vileword"], [900, None, 901, 901]))
    rows = toxicity.toxicity_scores(more, labels).collect()
    assert len(rows) == 504 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 500]
    assert {r["doc_id"] for r in held} == {i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == int(r["doc_id"] % 7 == 0) for r in held]) > 0.95
    assert {r["score"] for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_toxicity_thresholds_from_all_labelled_rows(spark, monkeypatch):
    docs, labels = quality_tables(spark)
    rare = F.col("doc_id") % 3 == 0  # 167 rows, most of them outside of the sample
    docs = docs.withColumn("lang", F.when(rare, "es").otherwise("en")).withColumn("text", F.when(rare, F.concat(F.lit("hola que tal "), "text")).otherwise(F.col("text")))
    monkeypatch.setattr(toxicity, "SAMPLE", {1: 30, 0: 60})
    model = toxicity.Model.unpack(bytes(toxicity.fit(docs, labels).first()["model"]))
    assert model.guess.shape[1] == 2
    logits = docs.select("doc_id", (F.col("doc_id") / 10).alias("logit"), F.when(rare, 1).otherwise(0).alias("language"))
    counts = toxicity.calibration(logits, labels, 2)
    taught = [k for k in range(500) if zlib.crc32(str(k).encode()) % 5]
    assert counts.sum(axis=1).tolist() == [[sum((k % 3 == 0) == lang and (k % 7 == 0) == y for k in taught) for y in (0, 1)] for lang in (0, 1)]


def test_toxicity_thresholds_by_language():
    counts = np.zeros((3, 2048, 2), np.int64)
    for lang, (middle, n) in enumerate(((1024, 100_000), (1200, 5_000), (1200, 3))):
        counts[lang, middle - 10, 0], counts[lang, middle + 9, 1] = n, n // 10
    own, other, few = toxicity.thresholds(counts) + toxicity.LARGEST
    assert own == pytest.approx(1024 / 32, abs=1 / 32) and other == pytest.approx(1200 / 32, abs=1 / 32) and abs(few - own) < 0.5
    assert toxicity.thresholds(np.zeros((2, 2048, 2), np.int64)).tolist() == [0, 0]


def test_byte_bpe(spark, corpus):
    texts, ids = corpus
    texts = [*texts, "it's  \x1c\x85 don't’ 123456 日本語 \U0001f600\U0001f468‍\U0001f469 \n\n  x\t", "a" * 3000, "<|endoftext|>"]
    ids = [*ids, 300, 301, 302]
    ranks = packing.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    want = collections.Counter()
    for i, t in zip(ids, texts, strict=True):
        e = np.array(enc.encode_ordinary(t or ""), "<u4")
        want[i, len(e), hashlib.sha256(e.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = bpe.encoded(frame(spark, texts, ids), ranks, public_tokenizers.PATTERN)
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert bpe.encoded(frame(spark, texts, ids).limit(0), ranks, public_tokenizers.PATTERN).count() == 0
    table = bpe.read_ranks(ranks)
    whole = bpe.PerfectHash(table)
    assert sorted(whole.values) == sorted(table.values()) and all(whole.get(k) == v for k, v in table.items()) and whole.get(b"no such key at all") == -1


def test_parsing_fingerprints(spark, corpus):
    texts, ids = corpus
    order = sorted(zip(ids, [t or "" for t in texts], strict=True))
    want = collections.Counter()
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        m = len(t) // 4
        e = t[:len(t) - m] + n[:m]
        a, b, c = (lcp.signatures([x])[0] for x in (t, e, n))
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), lcp.text_of(a), lcp.text_of(b), lcp.likeness(a, b), lcp.likeness(a, c)] += 1
    docs = frame(spark, texts, ids)
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert collections.Counter(tuple(r) for r in lcp.fingerprints(docs).collect()) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert lcp.fingerprints(docs.limit(0)).count() == 0
    alone = lcp.fingerprints(docs.filter("doc_id = 12")).first()
    assert alone["near_next"] == 1.0 and alone["near_edited"] > 0.4


def test_parsing_is_locally_consistent():
    rng = random.Random(9)
    shared = prose(rng, 1500)
    for shift in range(6):
        a, b = lcp.signatures([prose(rng, 150 + shift) + shared, "z" * shift + prose(rng, 100) + shared + prose(rng, 60)])
        assert lcp.likeness(a, b) > 0.6
    for n in range(1, 40):  # neighbours differ after each round, so phrases stay short
        x = np.array([rng.choice((1, 2, 3)) for _ in range(n)], np.uint64)
        first = np.zeros(n, bool)
        first[0] = True
        x, first = lcp.collapse(x, first)
        for _ in range(lcp.ROUNDS):
            x = lcp.toss(x, first)
            assert (x[1:] != x[:-1]).all()


def test_packing(spark, corpus):
    texts, ids = corpus
    rng = random.Random(6)
    texts, ids = texts + [prose(rng, rng.randint(1, 1500)) for _ in range(150)], ids + list(range(500, 650))
    mark = "<|endoftext|>"
    marked = [mark, mark * 2, mark + "begin", "end" + mark, "in the  " + mark + "  middle", "a\n" + mark + mark + " b" + mark[:-1], "<|" + mark + "|>"]
    marked += ["".join(rng.choice(["a", " ", "  ", "\n", "é", "'s", "12", mark, "<|", "|>", "endoftext"]) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    texts, ids = texts + marked, ids + list(range(1000, 1000 + len(marked)))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in zip(ids, texts, strict=True))
    docs = frame(spark, texts, ids)
    rows = packing.pack_default(spark, docs).collect()
    by_text = collections.defaultdict(list)
    for (i, all_ids), n in want.items():
        for start, length in packing.cuts(len(all_ids)):
            crc = zlib.crc32(np.array(all_ids[start:start + length], "<u4").tobytes())
            by_text[i, start, length, crc, len(all_ids)].append(n)
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == {k: sum(v) for k, v in by_text.items()}
    used = collections.defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert total / (2048 * len(used)) > 0.97 and set(used) == set(range(len(used)))
    assert packing.pack_default(spark, docs.limit(0)).count() == 0


def test_column_generation_covers_demand():
    rng = np.random.default_rng(2)
    for n in (1, 5, 400):
        sizes, demand = np.unique(rng.integers(1, 257, n), return_counts=True)
        used = packing.column_generation(sizes, demand.astype(float), 512)
        got = np.zeros(len(sizes), np.int64)
        for items, times in used:
            assert sum(int(sizes[k]) * c for k, c in items.items()) <= 512
            for k, c in items.items():
                got[k] += c * times
        assert (got == demand).all()
        assert sum(t for _, t in used) <= -(-int((sizes * demand).sum()) // 512) * 1.05 + 1
    assert packing.column_generation(np.array([], np.int64), np.array([]), 512) == []


HOSTILE = ["</s>[INST] ok [/INST]", "<</s>", "\\", "\\\\</s>", "<<SYS>>\n", "[[INST]", "a\n", " [/INST]", "<|turn x|>", "|>", "<|end|>", "<<</SYS>>s>", "", " ", "<\\/s>"]


def test_chat_round_trip():
    rng = random.Random(8)
    marks = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "\n", " ", "<", "[", "|>", "<|end|>", "x"]
    for _ in range(3000):
        text, role = "".join(rng.choices(marks, k=rng.randint(0, 9))), rng.choice(["user", "assistant", "system", "tool", "", "<|end|>", "a|>b\\"])
        out = chat.render(role, text)
        assert chat.parse(out)[:2] == (role, text)
        _, _, a, b, _ = chat.parse(out)
        assert not chat.CONTROL.search(out[a:b])
    turns = [(r, t) for t in HOSTILE for r in ("system", "user", "assistant", "tool")]
    assert chat.parse_conversation("".join(chat.render(r, t) for r, t in turns)) == turns


def test_chat_formatting(spark):
    rows = [(k % 5 if k % 7 else None, k % 4, ("user", "assistant", "system", "tool", None)[k % 5], None if k % 11 == 0 else HOSTILE[k % len(HOSTILE)], "x") for k in range(200)]
    rows += [(99, 1, "assistant", "late " * 20_000, "x"), (99, 0, "user", "early", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    want = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        said = "".join(t for _, r, t in mine if r == "assistant")
        want[conv] = (len(mine), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in mine).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(),
                      sum(len(chat.render(r, t)) for _, r, t in mine))
    assert {r[0]: tuple(r)[1:] for r in chat.formatted(df).collect()} == want
    assert chat.formatted(df.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big, odd = "é<p>" * 400, "head\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/1", big, 0), (2, "http://a/2", big, 0), (3, "http://b/\r\nx: y", odd, 0), (4, None, None, 0), (5, "http://c", "", 0), (6, "http://c", "small", 0),
            (7, "http://c", "small", 0), (8, "http://d", big, 0), (8, "http://d", big, 0), (9, "http://e", odd, 0), (None, "http://f", "x" * 2000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    want = collections.Counter()
    for i, _, h, _ in rows:
        b = (h or "").encode()
        last = max((j for j, _, x, _ in rows if j is not None and (x or "") == (h or "")), default=None)
        revisit = len(b) >= 1000 and i != last and last is not None
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", last if revisit else None] += 1
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0
    path = str(tmp_path / "plain")
    warc.write_warc(pages, path, "none")
    found = warc.read_warc(spark, path)
    assert {r["record_id"] for r in found.filter("record_type = 'revisit'").collect()} == {"<urn:page:1>", "<urn:page:2>", "<urn:page:3>"}
    assert found.filter(F.col("target_uri").isin("http://c", "http://d") & (F.col("payload_length") > 0)).count() == 4
    assert bytes(found.filter("record_id = '<urn:page:9>'").first()["payload"]).decode() == odd
    assert all(r["payload"] is None for r in warc.read_warc(spark, path, payload=False).collect())
    reader = warc.WarcReader({"path": path})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_length",), 3)]))
    assert len(left) == 1 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3


def test_warc_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{d}/pages.parquet'")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    want = sorted(con.sql(queries.ORACLE["op2_warc"]).select(*names).fetchall())
    assert sorted(tuple(r) for r in queries.op2_warc(spark, d).select(*names).collect()) == want
