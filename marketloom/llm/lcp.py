"""Document fingerprints by locally consistent parsing.

A text is a sequence of symbols, at first its code points. Each level joins runs of one symbol, labels
every symbol by deterministic coin tossing against its left neighbour until few labels are left, and
begins a phrase at each label that is less than both neighbours. Phrases are named by their content and
are the next level's symbols. Labels depend on a few symbols to the left, so the interior of a substring
is parsed and named alike wherever it stands. A fingerprint is the least names of all upper levels,
each occurrence of a name counted.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import mix, spread, texts
from marketloom.sources.shared import materialize

#: Names in a fingerprint; the lowest level whose names count; rounds of coin tossing: 64 bits, then 7, 4 and 3 are left.
SIZE, LOWEST, ROUNDS = 64, 2, 4
#: Symbols that are parsed at once.
CHUNK = 400_000
WEIGHTS = spread(256)


def collapse(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a symbol become one, named by symbol and length. ``first`` marks where a text begins."""
    new = first.copy()
    new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    if len(at) == len(x):
        return x, first
    length = np.diff(np.append(at, len(x))).astype(np.uint64)
    y = x[at]
    many = length > 1
    with np.errstate(over="ignore"):
        y[many] = mix(y[many] * WEIGHTS[0] + length[many] * WEIGHTS[1])
    return y, first[at]


def toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the lowest bit place in which a symbol differs from its left neighbour, plus its bit there. Neighbours stay different."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    np.copyto(left, ~x, where=first)
    d = x ^ left
    place = np.minimum(np.bitwise_count((d & (~d + x.dtype.type(1))) - x.dtype.type(1)), 8 * x.itemsize - 1)
    return (2 * place + ((x >> place.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)).astype(np.uint8)


def phrases(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases, and the mark of those that begin a text."""
    with np.errstate(over="ignore"):
        label = x
        for _ in range(ROUNDS):
            label = toss(label, first)
        begins = first.copy()
        lower = np.append((label[:-1] < label[1:]) | first[1:], True)  # than the right neighbour; a text's last symbol has none
        begins[1:] |= (label[1:] < label[:-1]) & lower[1:]
        at = np.flatnonzero(begins)
        place = np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))
        return mix(np.add.reduceat(x * WEIGHTS[place & 255], at)), first[at]


def signatures(many: list[str]) -> list[np.ndarray]:
    """The SIZE least 32-bit names of each text, ascending; none for an empty text."""
    out = [np.empty(0, np.uint32)] * len(many)
    owner = np.array([k for k, t in enumerate(many) if t], np.int64)
    if not len(owner):
        return out
    if len(many) > 1 << 19:
        return signatures(many[:1 << 19]) + signatures(many[1 << 19:])
    x = np.frombuffer("".join(many).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.zeros(len(x), bool)
    first[np.concatenate([[0], np.cumsum([len(many[k]) for k in owner[:-1]])]).astype(np.int64)] = True
    x = mix(x + np.uint64(1))
    names, owners, level = [], [], 0
    while True:
        if level >= LOWEST:
            names.append(x)
            owners.append(owner[np.cumsum(first) - 1])
        x, first = collapse(x, first)
        single = first & np.append(first[1:], True)
        text = np.cumsum(first) - 1
        if level < LOWEST:
            names.append(x[single])
            owners.append(owner[text[single]])
        more = ~single
        if not more.any():
            break
        owner, x, first = owner[text[first & more]], x[more], first[more]
        x, first = phrases(x, first)
        level += 1
    # a name that occurs again counts again, so that long repetitions weigh as much as other text
    key = np.sort((np.concatenate(owners).astype(np.uint64) << np.uint64(44)) | (np.concatenate(names) >> np.uint64(20)))
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    again = (np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))).astype(np.uint64)
    with np.errstate(over="ignore"):
        hashed = mix((key << np.uint64(20)) + again * WEIGHTS[0]) >> np.uint64(32)
    key = np.unique((key >> np.uint64(44) << np.uint64(32)) | hashed)
    whose = (key >> np.uint64(32)).astype(np.int64)
    found, at = np.unique(whose, return_index=True)
    low = key.astype(np.uint32)
    for k, a, b in zip(found.tolist(), at.tolist(), [*at[1:].tolist(), len(key)], strict=True):
        out[k] = low[a:min(b, a + SIZE)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two texts' names: the share of the least names of both that are in both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, n = np.unique(np.concatenate([a, b]), return_counts=True)
    return float((n[:SIZE] == 2).mean())


def bytes_of(signature: np.ndarray) -> bytes:
    return signature.astype(">u4").tobytes()


def text_of(signature: np.ndarray) -> str:
    return bytes_of(signature).hex()


def edit(text: str, other: str) -> str:
    """The last quarter, rounded down, replaced by the first as many code points of ``other``, or all of it."""
    n = len(text) // 4
    return text[:len(text) - n] + other[:n]


COLUMNS = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
Pair = tuple[int | None, str, str]  # a document and the text of the next one


def rows(pairs: list[Pair]) -> list[tuple]:
    edited = [edit(t, n) for _, t, n in pairs]
    own, of_edited, of_next = signatures([t for _, t, _ in pairs]), signatures(edited), []
    for k, (_, _, n) in enumerate(pairs):  # most next texts are the following pair's own
        of_next.append(own[k + 1] if k + 1 < len(pairs) and pairs[k + 1][1] is n else signatures([n])[0])
    return [(i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).digest(), bytes_of(a), bytes_of(b), likeness(a, b), likeness(a, c))
            for (i, t, _), e, a, b, c in zip(pairs, edited, own, of_edited, of_next, strict=True)]


def record_batch(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
                    ("near_edited", pa.float64()), ("near_next", pa.float64())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every whole text.

    The next document is the one that follows by doc_id (null first), then text; the last one's is the
    first, and a lone document is its own. Repeated rows follow each other. A null or empty text has an
    empty fingerprint, like another empty one fully and any other text not at all. Extra columns are
    ignored; an empty table gives an empty result.

    Texts are dealt and sorted by range once. Within a partition each row meets the next as the rows pass
    by; a partition's first and last text go to a second step, two rows a partition.
    """
    wide = pa.schema([*SCHEMA, ("part", pa.int32()), ("kind", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, pairs, size = TaskContext.get().partitionId(), None, [], 0
        empty = (None,) * (len(SCHEMA) - 1)

        def done() -> pa.RecordBatch:
            return record_batch([(*r, part, 0, None) for r in rows(pairs)], wide)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if last is None:
                    yield record_batch([(i, *empty, part, 1, t)], wide)
                else:
                    pairs.append((*last, t))
                    size += len(t)
                    if size >= CHUNK:
                        yield done()
                        pairs, size = [], 0
                last = (i, t)
        if pairs:
            yield done()
        if last is not None:
            yield record_batch([(last[0], *empty, part, 2, last[1])], wide)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = opened = None
        for b in batches:
            for i, kind, t in zip(b["doc_id"].to_pylist(), b["kind"].to_pylist(), b["text"].to_pylist(), strict=True):
                if kind == 2:
                    opened = (i, t)
                    continue
                if start is None:
                    start = t
                elif opened is not None:
                    yield record_batch(rows([(*opened, t)]), SCHEMA)
        if opened is not None:
            yield record_batch(rows([(*opened, start)]), SCHEMA)

    dealt = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = materialize(dealt.mapInArrow(run, COLUMNS + ", part int, kind int, text string"), "fingerprints")
    edges = found.filter("kind > 0").select("doc_id", "part", "kind", "text").repartition(1).sortWithinPartitions("part", "kind").mapInArrow(close, COLUMNS)
    whole = found.filter("kind = 0").drop("part", "kind", "text").unionByName(edges)  # bytes are written, hex digits are not
    return whole.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
