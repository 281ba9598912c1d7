"""Substring dedup: MinHash banding of content-defined paragraphs, exact Jaccard, components.

A passage can sit anywhere in a line, so line breaks can't bound the unit that is compared. A paragraph
here begins at a word whose bigram hash is the least among ``REACH`` neighbours on either side. That
depends on nearby words only, so a passage that repeats is cut the same way in every text, but for its
ends and the surroundings of a changed word. Runs of repeated paragraphs are therefore extended word by
word on both sides against the first occurrence, across changed, missing and added words as long as the
whole keeps a Jaccard similarity of ``SIMILARITY``.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import WORD, as_bytes, bucket_links, components, mix, spread, text_key, texts
from marketloom.sources.shared import materialize

SHINGLE, SIMILARITY = 5, 0.8
REACH = 4
#: One row a band: two paragraphs of similarity 0.8 collide in a band with probability 0.8, in one of three with 0.992.
BANDS = 3
#: Extended runs shorter than this many words stay: a shared phrase is no shared passage.
MIN_WORDS = 25
#: Words beside a run that are compared: this many, or the next paragraph and MARGIN more if that is longer. Equal words
#: past that margin would have been cut into an equal paragraph, so no exact repeat ends at this bound.
BESIDE, MARGIN = 48, REACH + SHINGLE
#: Changes of at most this many adjacent words are crossed, if SHINGLE equal words follow; this many on a side.
CHANGED, CROSSINGS = 2, 4
#: Candidates up to this number are broadcast (16 MB of ids), more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Texts are cut this many bytes at a time, and pairs compared this many words at a time: numpy's calls are shared by many texts, memory is bounded.
PIECE, MATRIX = 1_000_000, 250_000
#: Places between two texts in a piece, so that no word sees the text before or after its own.
GAP = REACH - 1
MULTIPLIERS = spread(SHINGLE)
#: Of XXH64.
PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


class Cut(NamedTuple):
    """Texts laid one after the other, GAP places apart: hashes of their words, where each begins and ends, and bounds and text of each paragraph."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray


def pieces(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a column of texts with about PIECE bytes, and the row each begins at."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(size):
        return
    at = (np.cumsum(size) - size) // PIECE
    bounds = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(size)]
    for x, y in zip(bounds[:-1], bounds[1:], strict=True):
        yield x, column.slice(x, y - x)


def rolled(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def digests(known: pa.Array) -> np.ndarray:
    """``xxhash.xxh64_digest`` of each string, as eight bytes. Words under 32 bytes, nearly all, are hashed by columns."""
    _, offsets, data = known.buffers()
    offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(known.type) else np.int32)[known.offset:known.offset + len(known) + 1].astype(np.int64)
    data = np.append(np.frombuffer(data or b"", np.uint8)[:offsets[-1]], np.zeros(8, np.uint8))
    lanes = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
    at, n = offsets[:-1], np.diff(offsets)
    p1, p2, p3, p4, p5 = PRIMES
    with np.errstate(over="ignore"):
        h = p5 + n.astype(np.uint64)
        for k in range(0, 24, 8):
            own = np.flatnonzero(n >= k + 8)
            h[own] = rolled(h[own] ^ (rolled(lanes[at[own] + k] * p2, 31) * p1), 27) * p1 + p4
        own = np.flatnonzero(n & 4)
        h[own] = rolled(h[own] ^ ((lanes[at[own] + (n[own] & -8)] & np.uint64(0xFFFFFFFF)) * p1), 23) * p2 + p3
        for k in range(3):
            own = np.flatnonzero((n & 3) > k)
            h[own] = rolled(h[own] ^ (data[at[own] + (n[own] & -4) + k] * p5), 11) * p1
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = (h ^ (h >> np.uint64(32))).byteswap()
    for k in np.flatnonzero(n >= 32).tolist():
        h[k:k + 1] = np.frombuffer(xxhash.xxh64_digest(data[at[k]:at[k] + n[k]].tobytes()), np.uint64)
    return h


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (as in ``common.words``) of all texts in a row, and the number of words of each; a word is hashed once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column))
    flat, bounds = lists.flatten(), lists.offsets.to_numpy()
    bounds = bounds - bounds[0]
    there = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end of a text leaves an empty word there
    before = np.concatenate([[0], np.cumsum(there)])
    coded = flat.dictionary_encode()
    return digests(coded.dictionary)[coded.indices.to_numpy()[there]], before[bounds[1:]] - before[bounds[:-1]]


def cut_texts(column: pa.Array) -> Cut:
    """Paragraphs of any length; the first of a text begins at its first word."""
    words, n = hashed(column)
    begin = np.cumsum(n + GAP) - n - GAP
    end = begin + n
    h = np.zeros(int(n.sum()) + GAP * len(n) + SHINGLE, np.uint64)
    h[np.arange(len(words)) + np.repeat(begin - np.cumsum(n) + n, n)] = words
    none = np.iinfo(np.uint64).max
    pair = np.full(len(h) + 2 * REACH, none, np.uint64)  # REACH places on either side
    here = pair[REACH:-REACH]
    with np.errstate(over="ignore"):
        here[:-1] = mix(h[:-1] * MULTIPLIERS[0] + h[1:] * MULTIPLIERS[1])
    here[(end[:, None] + np.arange(-1, GAP)).ravel()] = none  # no pair begins at a text's last word or between texts
    here[len(h) - SHINGLE:] = none
    least = pair[:len(pair) - REACH + 1].copy()  # of REACH places from here on
    for k in range(1, REACH):
        np.minimum(least, pair[k:len(pair) - REACH + 1 + k], out=least)
    first = (here < least[:len(h)]) & (here <= least[REACH + 1:])
    first[begin[n > 0]] = True
    starts = np.flatnonzero(first)
    text = np.searchsorted(begin, starts, "right") - 1
    return Cut(h, begin, end, starts, np.minimum(np.append(starts[1:], len(h)), end[text]) if len(starts) else starts, text)


def shingle_bounds(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """First shingle and end of the shingles of each paragraph, for ``reduceat``."""
    return np.stack([starts, ends - SHINGLE + 1], axis=1).ravel()


def paragraphs(column: pa.Array) -> tuple[Cut, np.ndarray, np.ndarray]:
    """The paragraphs of all texts that have a shingle, the hash of the shingle at each place, and the paragraphs' hashes."""
    c = cut_texts(column)
    whole = c.ends - c.starts >= SHINGLE
    c = c._replace(starts=c.starts[whole], ends=c.ends[whole], text=c.text[whole])
    n = len(c.hashes) - SHINGLE + 1
    with np.errstate(over="ignore"):
        shingles = c.hashes[:n] * MULTIPLIERS[0]
        for k in range(1, SHINGLE):
            shingles += c.hashes[k:n + k] * MULTIPLIERS[k]
        shingles = mix(shingles)
        # paragraphs with equal bags of shingles have one name: their similarity is 1
        names = mix(np.add.reduceat(shingles, shingle_bounds(c.starts, c.ends))[::2]) if len(c.starts) else np.empty(0, np.uint64)
    return c, shingles, names


def stretches(first: np.ndarray, n: np.ndarray, step: np.ndarray | int = 1) -> np.ndarray:
    """``n`` places from each ``first`` on, ``step`` apart, one stretch after the other."""
    return np.repeat(first, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * (step if isinstance(step, int) else np.repeat(step, n))


def binaries(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """``values``, 32 bits each, as one binary for every ``n``."""
    bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int64) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bounds), pa.py_buffer(values)])


def collisions(rows: DataFrame) -> DataFrame:
    """The distinct rows of keys with two or more different paragraphs; most keys have one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = p = np.empty(0, np.int64)  # the newest row; the next one tells whether it shares its key
        shared = False  # with the row before it
        for b in batches:
            k, p = np.append(k, b.column(0).to_numpy()), np.append(p, b.column(1).to_numpy())
            if not len(k):
                continue
            new = np.append(True, (k[1:] != k[:-1]) | (p[1:] != p[:-1]))
            k, p = k[new], p[new]
            same = k[1:] == k[:-1]
            before = np.append(shared, same)
            out = np.flatnonzero(before[:-1] | same)
            yield pa.RecordBatch.from_arrays([pa.array(k[out]), pa.array(p[out])], names=["key", "id"])
            k, p, shared = k[-1:], p[-1:], bool(before[-1])
        if shared:
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(p)], names=["key", "id"])

    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "key long, id long")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``id, shingles``: each paragraph's shingle hashes, 32 bits each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, sets = [], [], []
            for _, column in pieces(b.column(0)):
                c, shingles, names = paragraphs(column)
                size = c.ends - c.starts - SHINGLE + 1
                ids.append(names)
                sizes.append(size)
                sets.append((shingles[stretches(c.starts, size)] >> np.uint64(32)).astype(np.uint32))
            if not ids:
                continue
            name, first = np.unique(np.concatenate(ids), return_index=True)
            data = binaries(np.concatenate(sets), np.concatenate(sizes))
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), data.take(pa.array(first)).cast(pa.binary())], names=["id", "shingles"])

    return texts(docs).select("text").mapInArrow(run, "id long, shingles binary")


def similar(unit: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of Jaccard similarity SIMILARITY or more in each unit, from the shingle sets."""
    ids, u, v = unit["id"].to_numpy(), [], []
    sets = [np.frombuffer(x, np.uint32) for x in unit["shingles"].to_pylist()]
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if e - s == 2:  # most units
            a, b = set(sets[s].tolist()), set(sets[s + 1].tolist())
            if len(a & b) >= SIMILARITY * len(a | b):
                u.append(ids[s:s + 1])
                v.append(ids[s + 1:e])
            continue
        own = [np.unique(x) for x in sets[s:e]]
        size = np.array([len(x) for x in own])
        flat, place = np.unique(np.concatenate(own), return_inverse=True)
        begin = np.cumsum(size) - size
        marked = np.zeros(len(flat), np.int32)
        rest = np.ones(e - s, bool)
        for seed in range(e - s):
            if not rest[seed]:
                continue
            rest[seed], front = False, [seed]
            while front and rest.any():
                at = front.pop()
                mine = place[begin[at]:begin[at] + size[at]]
                marked[mine] = 1
                both = np.add.reduceat(marked[place], begin)
                marked[mine] = 0
                hit = np.flatnonzero(rest & (both >= SIMILARITY * (size + size[at] - both)))
                rest[hit] = False
                u.append(np.full(len(hit), ids[s + at]))
                v.append(ids[s + hit])
                front.extend(hit.tolist())
    return np.concatenate(u or [np.empty(0, np.int64)]), np.concatenate(v or [np.empty(0, np.int64)])


def occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, start, n, last, id, keys``: every paragraph of every row, whether the text ends with it, its hash and its bands' least shingle hashes.

    Of equal paragraphs in a batch only the first has keys, so a passage in a third of all rows sends few.
    """
    seeds = spread(BANDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, starts, lengths, last, ids, keys = [], [], [], [], [], []
            for row, column in pieces(b.column(2)):
                c, shingles, names = paragraphs(column)
                if not len(names):
                    continue
                at.append(row + c.text)
                starts.append(c.starts - c.begin[c.text])
                lengths.append(c.ends - c.starts)
                ids.append(names)
                last.append(c.ends == c.end[c.text])
                bounds = shingle_bounds(c.starts, c.ends)
                # shingle hashes are mixed, so the one nearest to a seed in bits is a random choice
                least = [np.minimum.reduceat(shingles ^ seed, bounds)[::2] for seed in seeds]
                keys.append(np.stack([(x & ~np.uint64(3)) | np.uint64(k) for k, x in enumerate(least)], axis=1))
            if not at:
                continue
            rows, name = pa.array(np.concatenate(at)), np.concatenate(ids)
            first = np.zeros(len(name), bool)
            first[np.unique(name, return_index=True)[1]] = True
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(first * BANDS)]).astype(np.int32)), pa.array(np.concatenate(keys)[first].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(lengths).astype(np.int32)),
                                              pa.array(np.concatenate(last)), pa.array(name.view(np.int64)), bands], names=["doc_id", "text_key", "start", "n", "last", "id", "keys"])

    return texts(docs).select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, start int, n int, last boolean, id long, keys array<long>")


def near_classes(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``node, root`` of paragraphs that are similar to a different one. ``found``: the written occurrences."""
    hits = materialize(collisions(found.select(F.explode("keys").alias("key"), "id")), "paragraph-collisions")
    wanted = hits.select("id").distinct()
    if hits.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    sets = shingle_sets(docs).join(wanted, "id", "left_semi").dropDuplicates(["id"])
    members = materialize(hits.join(sets, "id"), "paragraph-members")  # read twice: sizes and members of the buckets
    return components(bucket_links(members, similar, cap=1000), "paragraph-components")


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """``doc`` (doc_id, text_key), ``start, n, last, class, first`` (doc, start, end, last): paragraphs whose class occurs twice or more."""
    found = materialize(occurrences(docs), "paragraph-occurrences")
    roots = near_classes(docs, found).withColumnRenamed("node", "id")
    found = found.drop("keys")
    # most paragraphs occur once: ids alone are counted first, places are shuffled only of those that repeat
    ids = found.groupBy("id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("id").unionByName(roots.select("id")).distinct()
    ids = materialize(ids, "paragraph-ids")
    found = materialize(found.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "id", "left_semi"), "paragraph-repeated")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "start", "n", "last")
    each = found.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("first"))
    labelled = each.join(roots, "id", "left").withColumn("class", F.coalesce("root", "id")).filter("copies > 1 or root is not null")
    labelled = materialize(labelled.select("id", "class", "copies", "first"), "paragraph-classes")
    whole = labelled.groupBy("class").agg(F.sum("copies").alias("copies"), F.min("first").alias("first")).filter("copies > 1")
    first = F.struct(F.struct("first.doc_id", "first.text_key").alias("doc"), F.col("first.start").alias("start"), (F.col("first.start") + F.col("first.n")).alias("end"), "first.last")
    dup = labelled.select("id", "class").join(whole.select("class", first.alias("first")), "class")
    return found.join(dup, "id").select(F.struct("doc_id", "text_key").alias("doc"), "start", "n", "last", "class", "first")


def runs(docs: DataFrame) -> DataFrame:
    """``doc, start, end, last, kept, class``, and ``head, tail``: the first occurrences of its outer paragraphs. One row per run of adjacent repeated paragraphs."""
    rows = repeated_paragraphs(docs).withColumn("kept", (F.col("doc") == F.col("first.doc")) & (F.col("start") == F.col("first.start")))
    text = Window.partitionBy("doc").orderBy("start")
    before = F.lag(F.struct((F.col("start") + F.col("n")).alias("end"), "kept")).over(text)
    run = F.sum(F.when((F.col("before.end") == F.col("start")) & (F.col("before.kept") == F.col("kept")), 0).otherwise(1)).over(text)
    # identical rows of one document repeat every paragraph at the same place: one of each is enough here
    return (rows.dropDuplicates(["doc", "start"]).withColumn("before", before).withColumn("run", run).groupBy("doc", "run", "kept")
            .agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"), F.max("last").alias("last"), F.min("class").alias("class"), F.min(F.struct("start", "first")).alias("head"), F.max(F.struct("start", "first")).alias("tail"))
            .select("doc", "start", "end", "last", "kept", "class", F.col("head.first").alias("head"), F.col("tail.first").alias("tail")))


def beside(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``doc, at, after, words``: hashes of the words from each place outwards, 32 bits each. ``places``: distinct ``doc, at, after``."""
    wanted = materialize(places.groupBy("doc").agg(F.collect_list(F.struct("at", "after")).alias("places")), "paragraph-places")
    rows = texts(docs).select(F.struct("doc_id", text_key().alias("text_key")).alias("doc"), "text")
    if wanted.count() <= BROADCAST_ROWS // 2:  # 16 MB of ids; texts without a place aren't shuffled
        rows = rows.join(F.broadcast(wanted.select("doc")), "doc", "left_semi")
    rows = rows.join(wanted, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            each, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
            at, after = flat.field(0).to_numpy(), flat.field(1).to_numpy(zero_copy_only=False)
            text, first = np.repeat(np.arange(len(each)), each), np.concatenate([[0], np.cumsum(each)]).tolist()
            for row, column in pieces(b.column(2)):
                c, mine = cut_texts(column), slice(first[row], first[row + len(column)])
                up, own = after[mine], text[mine] - row
                begin, end = c.begin[own], c.end[own]
                p = begin + at[mine]
                # the end of the paragraph that begins at each place, and the beginning of the one that ends there
                ends = c.ends[np.maximum(np.searchsorted(c.starts, p, "right") - 1, 0)]
                heads = np.maximum(c.starts[np.maximum(np.searchsorted(c.starts, p, "left") - 1, 0)], begin)
                n = np.where(up, np.minimum(np.maximum(p + BESIDE, ends + MARGIN), end) - p, p - np.maximum(np.minimum(p - BESIDE, heads - MARGIN), begin))
                short = (c.hashes[stretches(np.where(up, p, p - 1), n, np.where(up, 1, -1))] >> np.uint64(32)).astype(np.uint32)
                rows = pa.array(text[mine])
                places = flat.slice(mine.start, mine.stop - mine.start)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), places.field(0), places.field(1), binaries(short, n).cast(pa.binary())], names=["doc_id", "text_key", "at", "after", "words"])

    rows = rows.select("doc.doc_id", "doc.text_key", "text", "places").mapInArrow(run, "doc_id long, text_key long, at int, after boolean, words binary")
    return rows.select(F.struct("doc_id", "text_key").alias("doc"), "at", "after", "words").dropDuplicates(["doc", "at", "after"])


def padded(flat: np.ndarray, first: np.ndarray, n: np.ndarray, width: int, none: int) -> np.ndarray:
    """A row for each stretch of ``flat``; at least its last place is ``none``."""
    out = np.full((len(n), width + 1), none, np.int64)
    out[np.arange(width + 1) < n[:, None]] = flat[stretches(first, n)]
    return out


#: Ways across a change, words of either text, the least wanted first: fewer changed words are better.
WAYS = np.array(sorted(((x, y) for x in range(CHANGED + 1) for y in range(CHANGED + 1) if x or y), key=lambda w: (-max(w), *w)))


def all_extents(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How far two texts go alike, for each pair of hashed texts: the number of its rows, and all rows.

    A row has the words of either text, and the shingles lost to the changes on the way, for none, one, ... changes.
    """
    na, nb = (np.fromiter(map(len, x), np.int64, len(x)) // 4 for x in (a, b))
    flat_a, flat_b = (np.frombuffer(b"".join(x), np.uint32) for x in (a, b))
    first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    longest = np.maximum(na, nb)
    order = np.argsort(longest, kind="stable")  # pairs of like lengths share a matrix
    pair, rows, k = [], [], 0
    while k < len(order):
        more = order[k:k + max(1, MATRIX // (int(longest[order[k]]) + 1))]
        more = more[:max(1, MATRIX // (int(longest[more[-1]]) + 1))]
        k += len(more)
        la, lb, width = na[more], nb[more], int(longest[more[-1]])
        x, y = padded(flat_a, first_a[more], la, width, -1), padded(flat_b, first_b[more], lb, width, -2)
        i = (x != y).argmax(axis=1)
        j, lost, now = i.copy(), np.zeros(len(more), np.int64), np.arange(len(more))
        pair.append(more)
        rows.append(np.stack([i, j, lost], axis=1))
        for _ in range(CROSSINGS):
            rest = np.minimum(la - i, lb - j)[now]
            now = now[rest > SHINGLE - 1]
            if not len(now):
                break
            n = int(rest.max()) + 1
            ahead = np.arange(n + CHANGED)
            own = x[now[:, None], np.minimum(i[now, None] + ahead, width)]
            other = y[now[:, None], np.minimum(j[now, None] + ahead, width)]
            best = np.max([(own[:, u:u + n] != other[:, v:v + n]).argmax(axis=1) * len(WAYS) + w for w, (u, v) in enumerate(WAYS.tolist())], axis=0)
            equal, way = best // len(WAYS), WAYS[best % len(WAYS)]
            crossed = equal >= SHINGLE
            now, equal, way = now[crossed], equal[crossed], way[crossed]
            i[now] += way[:, 0] + equal
            j[now] += way[:, 1] + equal
            lost[now] += SHINGLE - 1 + way.max(axis=1)
            pair.append(more[now])
            rows.append(np.stack([i[now], j[now], lost[now]], axis=1))
    if not pair:
        return np.empty(0, np.int64), np.empty((0, 3), np.int64)
    whose = np.concatenate(pair)
    return np.bincount(whose, minlength=len(a)), np.concatenate(rows)[np.argsort(whose, kind="stable")]


def extents(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """``all_extents`` of one pair."""
    return [tuple(x) for x in all_extents([a.astype(np.uint32).tobytes()], [b.astype(np.uint32).tobytes()])[1].tolist()]


def extended(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``found``, written runs, with ``left, right``: how far each that isn't kept goes on like its first occurrence (words, words there)."""
    gone = found.filter("not kept").select("doc", "start", "end", F.explode(F.array(
        F.struct(F.lit(False).alias("after"), F.col("start").alias("at"), F.col("head.doc").alias("there"), F.col("head.start").alias("there_at")),
        F.struct(F.lit(True).alias("after"), F.col("end").alias("at"), F.col("tail.doc").alias("there"), F.col("tail.end").alias("there_at")))).alias("side"), "last", F.col("tail.last").alias("there_last"))
    # where either text begins or ends nothing goes on
    sides = gone.select("doc", "start", "side.*", "last", "there_last").filter(F.when(F.col("after"), ~F.col("last") & ~F.col("there_last")).otherwise((F.col("at") > 0) & (F.col("there_at") > 0))).drop("last", "there_last")
    places = sides.select("doc", "at", "after").unionByName(sides.select(F.col("there").alias("doc"), F.col("there_at").alias("at"), "after")).distinct()
    near = materialize(beside(docs, places), "paragraph-beside")
    pairs = (sides.join(near.withColumnRenamed("words", "own"), ["doc", "at", "after"])
             .join(near.select(F.col("doc").alias("there"), F.col("at").alias("there_at"), "after", F.col("words").alias("other")), ["there", "there_at", "after"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rows = all_extents(as_bytes(b.column(4)), as_bytes(b.column(5)))
            each = pa.StructArray.from_arrays([pa.array(x) for x in rows.T.astype(np.int32)], names=["words", "there", "lost"])
            options = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), each)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], options], names=["doc_id", "text_key", "start", "after", "options"])

    sized = pairs.select("doc.doc_id", "doc.text_key", "start", "after", "own", "other").mapInArrow(run, "doc_id long, text_key long, start int, after boolean, options array<struct<words:int,there:int,lost:int>>")
    both = sized.groupBy(F.struct("doc_id", "text_key").alias("doc"), "start").agg(F.max(F.when(~F.col("after"), F.col("options"))).alias("lefts"), F.max(F.when(F.col("after"), F.col("options"))).alias("rights"))
    out = found.join(both, ["doc", "start"], "left")

    def taken(x, y):
        shingles = F.col("end") - F.col("start") + x["words"] + y["words"] - (SHINGLE - 1)
        lost = x["lost"] + y["lost"]
        # s - lost of the shingles are in both texts, s + lost in either
        alike = shingles - lost >= SIMILARITY * (shingles + lost)
        return F.when((lost == 0) | alike, F.struct((x["words"] + y["words"]).alias("words"), x.alias("left"), y.alias("right")))

    none = F.array(F.struct(F.lit(0).alias("words"), F.lit(0).alias("there"), F.lit(0).alias("lost")))
    lefts, rights = F.coalesce("lefts", none), F.coalesce("rights", none)
    best = F.array_max(F.flatten(F.transform(lefts, lambda x: F.transform(rights, lambda y: taken(x, y)))))
    return out.withColumn("best", best).select("doc", "start", "end", "kept", "class", "head", "tail", F.col("best.left").alias("left"), F.col("best.right").alias("right"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages that repeat: extended runs of adjacent repeated paragraphs, overlapping ones joined, one row each.

    ``doc_id, text_key, start, n_words`` (words of the text, counted from 0), ``component_id`` (the passage's
    least paragraph class), ``kept`` (it holds the first occurrence, by doc_id with nulls last, text key
    and place, of what others repeat) and ``first_doc_id``. Every occurrence has a row, the kept ones too;
    what is repeated from one text and the first of another has a row of either kind. Each word of a passage that
    is not kept has an equal or similar one earlier in that order, so one occurrence always stays. Null and empty
    texts, and texts under five words, have none. Repeated rows are occurrences like any other and get equal rows;
    extra columns are ignored; an empty table gives an empty result.
    """
    rows = materialize(extended(docs, materialize(runs(docs), "paragraph-runs")), "paragraph-extended")
    gone = ~F.col("kept")
    left, right = F.coalesce("left.words", F.lit(0)), F.coalesce("right.words", F.lit(0))
    own = rows.select("doc", (F.col("start") - left).alias("start"), (F.col("end") + right).alias("end"), "kept", "class", F.col("head.doc.doc_id").alias("first_id"))
    # what a run was extended by, at its first occurrence
    ends = F.array(F.struct(F.col("head.doc").alias("doc"), (F.col("head.start") - F.coalesce("left.there", F.lit(0))).alias("start"), F.col("head.end").alias("end")),
                   F.struct(F.col("tail.doc").alias("doc"), F.col("tail.start").alias("start"), (F.col("tail.end") + F.coalesce("right.there", F.lit(0))).alias("end")))
    there = rows.filter(gone).select(F.explode(ends).alias("e"), "class").groupBy("e.doc", "e.start", "e.end").agg(F.min("class").alias("class"))
    spans = own.unionByName(there.select("doc", "start", "end", F.lit(True).alias("kept"), "class", F.col("doc.doc_id").alias("first_id")))
    text = Window.partitionBy("doc", "kept").orderBy("start", F.desc("end"))
    reached = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    joined = (spans.withColumn("reached", reached).withColumn("passage", F.sum(F.when(F.col("start") <= F.col("reached"), 0).otherwise(1)).over(text.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("doc", "kept", "passage").agg(F.min("start").cast("long").alias("start"), F.max("end").alias("end"), F.min("class").alias("component_id"), F.min("first_id").alias("first_doc_id")))
    joined = joined.withColumn("n_words", F.col("end") - F.col("start")).filter(F.col("n_words") >= MIN_WORDS)
    return joined.select("doc.doc_id", "doc.text_key", "start", "n_words", "component_id", "kept", "first_doc_id")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` (first word, number) and the white space after them."""
    begins = [m.start() for m in re.finditer(WORD, text)] + [len(text)]
    out, at = [], 0
    for start, n in sorted(spans):
        out.append(text[at:begins[start]])
        at = begins[min(start + n, len(begins) - 1)]
    return "".join([*out, text[at:]])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeated passage cut from all texts but its first; ``n_chars``, if there, is renewed.

    No row goes; a text that was all repeats becomes empty, and a null text stays null.
    """
    gone = (repeated_passages(docs).filter("not kept").groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
            .agg(F.collect_list(F.struct("start", "n_words")).alias("__spans")))
    rows = docs.withColumn("__text_key", text_key())
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left").drop("__id", "__key", "__text_key")
    names = docs.columns
    at, schema = names.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(len(names)).to_pylist()
            columns = list(b.columns[:len(names)])
            new = [t if s is None or t is None else cut(t, [(x["start"], x["n_words"]) for x in s]) for t, s in zip(columns[at].to_pylist(), spans, strict=True)]
            columns[at] = pa.array(new, columns[at].type)
            if "n_chars" in names:
                k = names.index("n_chars")
                old = columns[k].to_pylist()
                columns[k] = pa.array([o if s is None or t is None else len(t) for o, t, s in zip(old, new, spans, strict=True)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)
