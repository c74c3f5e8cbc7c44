"""Quality classifier: random-indexing word vectors, pooled for each document, and a two-layer network.

Every word has a fixed sparse random index vector; a word's context vector is the sum of the index vectors of its neighbours over all documents.
Words are hashed to BUCKETS places. Pooled mean and spread of a document's word vectors, and how much it repeats itself, feed a network of one hidden layer,
trained with numpy on a bounded sample of labels; a temperature, fitted on labels it didn't see, calibrates its probabilities.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lumaframe.llm.common import documents, hashed_sample, held_out, small_batches

BUCKETS, SIZE, NONZERO, REACH = 8192, 64, 4, 2
#: Labelled rows that training uses at most (those with the smallest hash of doc_id); a fifth of them fits the temperature.
LABELLED = 16_000
HIDDEN, STEPS, BATCH, RATE, DECAY = 32, 1500, 256, 5e-3, 1e-4
#: Numbers that the network gets for a document.
INPUTS = 2 * SIZE + 4
CACHE = 300_000
FAN_IN = 16
PIECES = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _bucket(piece: str) -> int:
    """The place of a run of letters, digits or signs. Words in capitals share one place, as do numbers; long runs of signs end early."""
    if piece[0].isalpha():
        key = "A" if len(piece) > 1 and piece.isupper() else "a" + piece.lower()
    else:
        key = "0" if piece[0].isdigit() else "." + piece[:3]
    return xxhash.xxh64_intdigest(key) % BUCKETS


class Pieces:
    """The places of the pieces of texts; those of known words are kept."""

    def __init__(self):
        self._reset()

    def _reset(self):
        self.index: dict[str, int] = {}
        self.pool, self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The places of all pieces, one text after another, and their number for each text."""
        split = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        words = split.flatten().dictionary_encode()
        known = words.dictionary.to_pylist()
        if len(self.index) > CACHE:
            self._reset()
        if new := [w for w in known if w not in self.index]:
            got = [[_bucket(x) for x in PIECES.findall(w)] for w in new]
            size = np.fromiter(map(len, got), np.int64, len(got))
            self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(got), np.int64, int(size.sum()))))
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        at = np.fromiter(map(self.index.__getitem__, known), np.int64, len(known))[words.indices.to_numpy()]
        size, ends = self.size[at], np.cumsum(self.size[at])
        flat = self.pool[np.repeat(self.start[at] - (ends - size), size) + np.arange(int(size.sum()))]
        per_text = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
        return flat, np.diff(np.concatenate(([0], np.concatenate(([0], ends))[per_text])))


_known = Pieces()  # of this Python worker


@lru_cache(1)
def index_entries() -> tuple[np.ndarray, np.ndarray]:
    """The index vector of each place as NONZERO dimensions and signs."""
    rng = np.random.default_rng(20_11)
    at = np.array([rng.choice(SIZE, NONZERO, replace=False) for _ in range(BUCKETS)])
    return at, rng.choice((-1.0, 1.0), at.shape)


def add_contexts(total: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
    """Add the index vectors of the REACH neighbours on both sides, within each text, to the context vectors."""
    doc, (at, sign) = np.repeat(np.arange(len(counts)), counts), index_entries()
    for k in range(1, REACH + 1):
        same = doc[k:] == doc[:-k]
        left, right = flat[:-k][same], flat[k:][same]
        for own, other in ((left, right), (right, left)):
            places = (own[:, None] * SIZE + at[other]).ravel()
            total += np.bincount(places, sign[other].ravel(), BUCKETS * SIZE).astype(np.int64).reshape(total.shape)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Sums over all rows of docs(text), as integers; each task adds up its own, then FAN_IN tasks' sums are added at a time."""

    def gather(batches):
        total = np.zeros((BUCKETS, SIZE), np.int64)
        for b in small_batches(batches, 1024):
            add_contexts(total, *_known.of(b.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def add(batches):
        total = np.zeros(BUCKETS * SIZE, np.int64)
        for b in batches:
            for x in b.column("total"):
                total += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    scan = docs.select("text")
    parts, sums = scan.rdd.getNumPartitions(), scan.mapInArrow(gather, "total binary")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        sums = sums.repartition(parts).mapInArrow(add, "total binary")
    rows = sums.collect()  # one row of 4 MB
    total = np.zeros(BUCKETS * SIZE, np.int64)
    for r in rows:
        total += np.frombuffer(r[0], np.int64)
    return total.reshape(BUCKETS, SIZE)


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """Context vectors of length 1, and their squares beside them."""
    size = np.sqrt((contexts.astype(np.float64) ** 2).sum(1))[:, None]
    vectors = contexts / np.maximum(size, 1)
    return np.concatenate((vectors, vectors * vectors), axis=1).astype(np.float32)


def pool(texts: pa.Array, both: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the word vectors of each text, its number of pieces on a log scale, the shares of pieces that equal the one before and
    the one before that, and the share of different pieces. both: the vectors and their squares."""
    flat, counts = _known.of(texts)
    out = np.zeros((len(counts), INPUTS))
    again = [np.concatenate((np.zeros(k, np.int64), np.cumsum(flat[k:] == flat[:-k]))) if len(flat) > k else np.zeros(len(flat), np.int64) for k in (1, 2)]
    for k, (n, end) in enumerate(zip(counts.tolist(), np.cumsum(counts).tolist(), strict=True)):
        if n:
            places, times = np.unique(flat[end - n : end], return_counts=True)
            out[k, : 2 * SIZE] = (times / n).astype(np.float32) @ both[places]
            repeats = [(c[end - 1] - c[min(end - n + lag - 1, end - 1)]) / n for lag, c in enumerate(again, 1)]
            out[k, 2 * SIZE :] = np.log1p(n) / 10, *repeats, len(places) / n
    mean = out[:, :SIZE]
    out[:, SIZE : 2 * SIZE] = np.sqrt(np.maximum(out[:, SIZE : 2 * SIZE] - mean * mean, 0))
    return out


class Network:
    """Inputs scaled by the sample, one tanh layer, one logit, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(7)
        self.constant = None
        if not len(y) or y.min() == y.max():
            self.constant = float((y.sum() + 0.5) / (len(y) + 1.0))
            return
        self.middle, self.scale = x.mean(0), x.std(0) + 1e-3
        x = self._scaled(x)
        part = np.arange(len(y)) % 5 == 4
        fitted, rest = np.flatnonzero(~part), np.flatnonzero(part)
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for step in range(1, STEPS + 1):
            at = rng.choice(fitted, min(BATCH, len(fitted)))
            h = np.tanh(x[at] @ p[0] + p[1])
            out = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[at]) / len(at)
            back = out[:, None] * p[2] * (1 - h * h)
            grads = [x[at].T @ back + DECAY * p[0], back.sum(0), h.T @ out + DECAY * p[2], np.array([out.sum()])]
            rate = RATE * (1 - step / (STEPS + 1))
            for a, g, mm, vv in zip(p, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                a -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
        self.p = p
        z = self._logit(x[rest])
        loss = lambda t: np.logaddexp(0, np.where(y[rest] > 0, -z, z) / t).mean()
        self.temperature = min(np.geomspace(0.25, 8, 61), key=loss) if len(rest) else 1.0

    def _scaled(self, x):
        return np.clip((x - self.middle) / self.scale, -8, 8)

    def _logit(self, x):
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._logit(self._scaled(x)) / self.temperature, -500, 500)))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, Network]:
    """Word vectors of all docs(doc_id, text), and a network fitted on at most LABELLED rows of labels(doc_id, quality) that aren't held out.

    Of rows that repeat a doc_id, and of labels that do, one counts (the label 1). Rows without doc_id or label teach nothing; labels may be
    of any number type. Without labels, or with one kind alone, every score is their rate. Long texts count whole.
    """
    vectors = word_vectors(context_vectors(docs))
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out("doc_id", 5, 0)).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("label"))
    chosen = hashed_sample(known, "doc_id", LABELLED)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for b in small_batches(batches, 1024):
            x = pool(b.column("text"), shared.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    # The chosen labels are at most LABELLED rows of two numbers.
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, label int, x binary").toPandas()
    got = got.sort_values(["doc_id", "x"], kind="stable").drop_duplicates("doc_id")
    x = np.array([np.frombuffer(r, np.float32) for r in got["x"]], np.float64).reshape(-1, INPUTS)
    order = np.random.default_rng(3).permutation(len(x))
    return vectors, Network(x[order], got["label"].to_numpy(np.float64)[order])


def score(docs: DataFrame, model: tuple[np.ndarray, Network]) -> DataFrame:
    """docs, all columns, with score (double) added; a column of that name is replaced.

    Null text is empty and scores as a document without words. Long texts are read whole; equal texts score alike; an empty table stays empty.
    """
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])

    def run(batches):
        vectors, network = shared.value
        for b in small_batches(batches, 1024):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(network.score(pool(b.column("text"), vectors)))], [*b.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
