"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy, thresholds by language.

A word's vector is that of its hash plus that of its prefix's hash. Filters of several widths slide over
the words, the largest answer of each filter is kept (max pooling), and a logistic unit weighs them. The
language that a threshold belongs to is guessed from the text; no column but the text enters a score. The
network learns from a bounded sample; thresholds come from counts over all labelled rows that aren't held out.
"""
from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import as_bytes, texts
from marketloom.llm.quality import held_out
from marketloom.sources.shared import materialize

WORDS, PREFIXES, GUESS, PREFIX_CHARS = 1 << 20, 1 << 18, 1 << 14, 4
DIM, WIDTHS, FILTERS = 4, (1, 2, 3), 4
#: Labelled rows that teach the network, at most, of each label: those with the least hashes of their ids, but for every fourth of them.
SAMPLE, CALIBRATE = {1: 4000, 0: 8000}, 4
EPOCHS, BATCH, RATE = 3, 64, 0.05
#: Languages with thresholds of their own: those with so many labelled rows. A language's errors weigh against the rates of all rows as so many rows.
LEAST_ROWS = 100
#: Languages that a text can be guessed to be in, at most (64 KB of the model each), and rows of a language that the guess learns from besides the sample.
LANGUAGES, GUESS_ROWS = 256, 400
#: Logits are counted in bins of this width, up to this size.
BIN, LARGEST = 1 / 32, 32
HELD_OUT, THRESHOLD = 0, 0.5
REMEMBERED = 300_000
CHUNK = 200_000


class Tokens(dict):
    """Raw words to word bucket and prefix bucket in one number; 0 is padding."""

    def __missing__(self, raw: bytes) -> int:
        word = raw.decode("utf-8", "replace").lower().strip(".,;:!?\"'()[]{}")
        number = 0
        if word:
            number = (1 + zlib.crc32(word.encode()) % (WORDS - 1)) | (1 + zlib.crc32(word[:PREFIX_CHARS].encode()) % (PREFIXES - 1)) << 20
        if len(self) >= REMEMBERED:
            self.clear()
        self[raw] = number
        return number

    def of(self, text: bytes) -> np.ndarray:
        w = text.split()
        return np.fromiter(map(self.__getitem__, w), np.int64, len(w))


TOKENS = Tokens()
PAD = np.zeros(max(WIDTHS) - 1, np.int64)


def joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens with padding behind each text (one token at least), and where the texts begin."""
    parts = [np.concatenate([d if len(d) else PAD[:1], PAD]) for d in docs]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts[:-1]])]).astype(np.int64)


@dataclass
class Model:
    words: np.ndarray  # WORDS x DIM
    prefixes: np.ndarray  # PREFIXES x DIM
    filters: np.ndarray  # for each width and place in it, DIM x FILTERS
    bias: np.ndarray  # for each width, FILTERS
    out: np.ndarray
    rest: np.ndarray  # one number
    guess: np.ndarray  # GUESS x languages

    def pack(self) -> bytes:
        f = io.BytesIO()
        np.savez_compressed(f, **vars(self))
        return f.getvalue()

    @staticmethod
    def unpack(content: bytes) -> Model:
        with np.load(io.BytesIO(content)) as f:
            return Model(**{k: f[k] for k in f.files})

    def embed(self, tokens: np.ndarray) -> np.ndarray:
        return self.words[tokens & (WORDS - 1)] + self.prefixes[tokens >> 20]

    def answers(self, e: np.ndarray) -> list[np.ndarray]:
        """By width, each filter's answer at each token (the padding holds the windows that stick out)."""
        out, k = [], 0
        for w, width in enumerate(WIDTHS):
            total = np.tile(self.bias[w], (len(e), 1))
            for j in range(width):
                total[:len(e) - j] += e[j:] @ self.filters[k]
                k += 1
            out.append(total)
        return out

    def logits(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Logits and guessed languages; the work on words is done once for each different one."""
        tokens, starts = joined(docs)
        different, place = np.unique(tokens, return_inverse=True)
        e = self.embed(different)
        places = np.concatenate([e @ f for f in self.filters], axis=1)
        counts = np.array([max(1, len(d)) for d in docs])
        spans = np.stack([starts, starts + counts], axis=1).ravel()
        pooled, k = [], 0
        for w, width in enumerate(WIDTHS):
            total = np.tile(self.bias[w], (len(tokens), 1))
            for j in range(width):
                total[:len(tokens) - j] += places[place[j:], k * FILTERS:(k + 1) * FILTERS]
                k += 1
            pooled.append(np.maximum.reduceat(total, spans, axis=0)[::2])
        logit = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.out + self.rest[0]
        bucket = different & (GUESS - 1)
        # a few languages at a time, so that memory doesn't grow with their number
        votes = [np.add.reduceat(self.guess[:, k:k + 8][bucket][place], starts, axis=0) for k in range(0, self.guess.shape[1], 8)]
        return logit, np.concatenate(votes, axis=1).argmax(axis=1)


def log_odds(docs: list[np.ndarray], y: np.ndarray, size: int, bucket) -> np.ndarray:
    """By bucket, the log odds of texts of label 1, shrunk where few texts have it."""
    seen = [np.zeros(size), np.zeros(size)]
    for d, label in zip(docs, y.tolist(), strict=True):
        seen[label][np.unique(bucket(d))] += 1
    n0, n1 = max(1, (y == 0).sum()), max(1, (y == 1).sum())
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    both = seen[0] + seen[1]
    return np.where(both > 0, odds * both / (both + 5), 0.0)


def train(docs: list[np.ndarray], y: np.ndarray, guess: np.ndarray) -> Model:
    """Embeddings begin with the log odds of their buckets in one place; stochastic gradients do the rest."""
    rng = np.random.default_rng(7)
    teach = np.flatnonzero(np.arange(len(docs)) % CALIBRATE != 0).tolist()  # the others keep the thresholds honest on small tables
    taught, labels = [docs[k] for k in teach], y[teach]
    model = Model(rng.normal(0, 0.05, (WORDS, DIM)).astype(np.float32), rng.normal(0, 0.05, (PREFIXES, DIM)).astype(np.float32),
                  rng.normal(0, 0.2, (sum(WIDTHS), DIM, FILTERS)), np.zeros((len(WIDTHS), FILTERS)), np.full(len(WIDTHS) * FILTERS, 0.3), np.array([-2.0]), guess)
    model.words[:, 0] = log_odds(taught, labels, WORDS, lambda d: d & (WORDS - 1)) / 2
    model.prefixes[:, 0] = log_odds(taught, labels, PREFIXES, lambda d: d >> 20) / 2
    model.words[0] = model.prefixes[0] = 0
    model.filters[:, 0, 0] = [1 / w for w in WIDTHS for _ in range(w)]
    weight = np.where(labels == 1, len(labels) / max(1, 2 * (labels == 1).sum()), len(labels) / max(1, 2 * (labels == 0).sum()))
    order = np.concatenate([rng.permutation(len(teach)) for _ in range(EPOCHS)])
    for a in range(0, len(order), BATCH):
        step(model, [taught[k] for k in order[a:a + BATCH]], labels[order[a:a + BATCH]], weight[order[a:a + BATCH]], RATE / (1 + 2 * a / len(order)))
    return model


def step(model: Model, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float) -> None:
    """One gradient step: only each filter's best window passes its gradient on."""
    tokens, starts = joined(docs)
    e = model.embed(tokens)
    counts = np.array([max(1, len(d)) for d in docs])
    answers = np.concatenate(model.answers(e), axis=1)
    best = np.stack([s + answers[s:s + n].argmax(axis=0) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)])
    top = np.take_along_axis(answers, best, axis=0)
    hidden = np.maximum(top, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.rest[0], -30, 30)))
    error = (p - y) * weight / len(docs)
    back = error[:, None] * model.out * (top > 0)
    model.out -= rate * (error[:, None] * hidden).sum(axis=0)
    model.rest -= rate * error.sum()
    k = 0
    for w, width in enumerate(WIDTHS):
        mine = slice(w * FILTERS, (w + 1) * FILTERS)
        g = back[:, mine]
        for j in range(width):
            at = best[:, mine] + j
            own = e[at]  # text, filter, DIM
            change = np.einsum("df,fk->dfk", g, model.filters[k].T) * rate * 4
            model.filters[k] -= rate * np.einsum("df,dfk->kf", g, own)
            t = tokens[at]
            real = t > 0
            np.subtract.at(model.words, t[real] & (WORDS - 1), change[real])
            np.subtract.at(model.prefixes, t[real] >> 20, change[real])
            k += 1
        model.bias[w] -= rate * g.sum(axis=0)


def guesser(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Log probabilities of word buckets by language; one column of zeros if there aren't two languages."""
    if len(counts) < 2:
        return np.zeros((GUESS, 1), np.float32)
    all_counts = np.stack([counts[x] for x in sorted(counts)], axis=1) + 0.1
    return np.log(all_counts / all_counts.sum(axis=0)).astype(np.float32)


def thresholds(counts: np.ndarray) -> np.ndarray:
    """By language, the middle of the widest place with the least errors. ``counts``: language, bin of the logit from -LARGEST, label.

    The error rate of all rows counts as LEAST_ROWS rows of every language, so a threshold moves
    from that of all rows to the language's own as its rows become more, and nothing flips at a number.
    """
    def errors(c: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(c[:, 1])]) + np.concatenate([np.cumsum(c[::-1, 0])[::-1], [0]])

    total = counts.sum(axis=0)
    if not total.sum():
        return np.zeros(len(counts))
    used = np.flatnonzero(total.sum(axis=1))
    low, high = used[0] - int(2 / BIN), used[-1] + 1 + int(2 / BIN)
    pooled, out = errors(total), []
    for own in counts:
        # whole numbers, so that equal errors are equal
        cost = errors(own).astype(object) * int(total.sum()) + LEAST_ROWS * pooled.astype(object)
        at = np.arange(low, high + 1)
        least = cost[np.clip(at, 0, len(cost) - 1)] == cost.min()
        change = np.flatnonzero(np.diff(np.concatenate([[0], least.astype(int), [0]])))
        begin, end = change[::2], change[1::2] - 1
        k = int((end - begin).argmax())
        out.append((at[begin[k]] + at[end[k]]) / 2 * BIN - LARGEST)
    return np.array(out)


def teachers(labels: DataFrame) -> DataFrame:
    """``doc_id, y`` of all labelled ids that aren't held out; of repeated labels of an id the largest holds."""
    return labels.filter("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y")).filter(~held_out(HELD_OUT, 5))


def fit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A written table with one row ``languages, model`` (the packed network), or none if labels of both kinds are missing.

    The network's teachers are at most SAMPLE rows a label, not held out; they are chosen among all by a
    hash of their id, sent to one task and trained there. Languages are those of all labelled rows; the
    guess learns from the sample and from GUESS_ROWS more of each. Rows without a doc_id or a label of
    0 or 1 don't teach.
    """
    marks = teachers(labels)
    chosen = None
    for label, n in SAMPLE.items():
        some = marks.filter(F.col("y") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = some if chosen is None else chosen.unionByName(some)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                        (F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")).alias("lang"))
    spoken = named.select("doc_id", "lang").join(marks, "doc_id")
    rows = spoken.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_ROWS)
    known = [r["lang"] for r in rows.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()]
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    more = spoken.filter(F.col("lang").isin(known)).withColumn("r", first).filter(F.col("r") <= GUESS_ROWS)  # cut in each task before rows move
    wanted = chosen.unionByName(more.select("doc_id", F.lit(None).cast("int").alias("y"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = named.join(F.broadcast(wanted), "doc_id").dropDuplicates(["doc_id"])  # at most sum(SAMPLE) + GUESS_ROWS * LANGUAGES rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, y = [], []
        counts = {x: np.zeros(GUESS) for x in known}
        for b in batches:
            for t, label, lang in zip(as_bytes(b["text"]), b["y"].to_pylist(), b["lang"].to_pylist(), strict=True):
                d = TOKENS.of(t)
                if lang in counts:
                    counts[lang] += np.bincount(d & (GUESS - 1), minlength=GUESS)
                if label is not None:
                    tokens.append(d)
                    y.append(label)
        if len(set(y)) == 2:
            model = train(tokens, np.array(y), guesser(counts))
            yield pa.RecordBatch.from_arrays([pa.array([model.guess.shape[1]], pa.int32()), pa.array([model.pack()], pa.binary())], names=["languages", "model"])

    return materialize(sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(run, "languages int, model binary"), "toxicity-model")


def calibration(logits: DataFrame, labels: DataFrame, languages: int) -> np.ndarray:
    """Counts by guessed language, bin of the logit and label over all labelled rows that aren't held out.

    The driver gets one row a language, of two numbers for each cell that has rows.
    """
    bins = int(2 * LARGEST / BIN)
    at = F.least(F.greatest(F.floor((F.col("logit") + LARGEST) / BIN), F.lit(0)), F.lit(bins - 1)).cast("int")
    cells = logits.join(teachers(labels), "doc_id").groupBy("language", (at * 2 + F.col("y")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    out = np.zeros((languages, bins, 2), np.int64)
    for r in cells.groupBy("language").agg(F.collect_list(F.struct("cell", "n")).alias("c")).select("language", "c.cell", "c.n").collect():
        out[r["language"]].reshape(-1)[r["cell"]] = r["n"]
    return out


MODELS: dict[str, Model] = {}


def model_of(name: str) -> Model:
    """One unpacked model a worker process, kept for its next tasks; ``name``: a file of the table that ``fit`` wrote."""
    if name not in MODELS:
        MODELS.clear()
        MODELS[name] = Model.unpack(pq.read_table(SparkFiles.get(name), columns=["model"])["model"][0].as_buffer().to_pybytes())
    return MODELS[name]


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per row of ``docs``, repeated rows and null ids too.

    Null and empty texts are scored as one padding word. Without labels of both kinds every score is 0. A
    null doc_id isn't held out. Extra columns are ignored; an empty table gives an empty result.
    """
    fitted = fit(docs, labels)
    found = fitted.select("languages", F.col("_metadata.file_path").alias("path")).first()
    if found is None:
        rows = texts(docs).select("doc_id", F.lit(0.0).alias("score"))
        return rows.select("doc_id", held_out(HELD_OUT, 5).alias("held_out"), "score", F.lit(0).alias("predicted"))
    docs.sparkSession.sparkContext.addFile(found["path"])  # each executor fetches the file, a replacement too; its size doesn't depend on the input
    name = found["path"].rsplit("/", 1)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(name)
        for b in batches:
            out, now, size = [], [], 0
            for t in as_bytes(b.column(1)):
                now.append(TOKENS.of(t))
                size += len(now[-1])
                if size >= CHUNK:
                    out.append(model.logits(now))
                    now, size = [], 0
            if now:
                out.append(model.logits(now))
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([x for x, _ in out])), pa.array(np.concatenate([k for _, k in out]).astype(np.int32))], names=["doc_id", "logit", "language"])

    # each text is read once: its logit counts for the thresholds and is what they are held against
    logits = materialize(texts(docs).mapInArrow(run, "doc_id long, logit double, language int"), "toxicity-logits")
    limits = thresholds(calibration(logits, labels, found["languages"]))
    over = F.col("logit") - F.array(*[F.lit(float(x)) for x in limits])[F.col("language")]
    scored = logits.withColumn("score", 1 / (1 + F.exp(-F.least(F.greatest(over, F.lit(-50.0)), F.lit(50.0)))))
    return scored.select("doc_id", held_out(HELD_OUT, 5).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
