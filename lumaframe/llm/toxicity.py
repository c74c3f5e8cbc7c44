"""Toxicity: a counterfactually regularised classifier.

A document is the set of hashed words and word beginnings in it; its score is a logistic function of their weights. Features are scaled
by their log-odds on the labelled sample, as in naive Bayes. Labelled texts get twins in which terms that name without judging are
swapped for others, and training adds PENALTY times the squared change of the log-odds between the two, so that a neutral mention
doesn't raise a score.

Terms are of two kinds: a list of names for groups of people in four languages, each swapped within its line, and terms learned from the
labelled texts, because a corpus has names that no list has: words that many of them hold and that toxic and clean ones hold about
equally often. A learned term is swapped for the ones next to it in frequency.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lumaframe.llm.common import carried, documents, hashed_sample, held_out, materialize, small_batches, text_bytes
from lumaframe.llm.decontaminate import split_words

#: Labelled rows that training uses at most (those with the smallest hash of doc_id).
LABELLED = 16_000
BITS = 16
#: How features travel to the driver.
STORED = np.uint16
#: Word beginnings that count as features, in bytes.
BEGINNINGS = (4, 6, 8)
LEAST_DOCS, STEPS, RATE, DECAY, PENALTY = 5, 80, 0.02, 1e-3, 1.0
#: Features of all labelled rows that training holds at most; beyond it fewer rows are used.
MOST_FEATURES = 20_000_000
#: Learned terms at most, documents that one needs, and the log-odds it may have.
TERMS, TERM_DOCS, VALENCE = 2000, 20, 0.7
#: Twins of a text, and the terms that are swapped in each.
TWINS, MENTIONS = 2, 6
#: Features that a training step looks at together.
RUN = 500_000
CACHE = 200_000

#: Terms that name groups of people; within a line, any may stand for any other.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "sikh"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "indigenous", "arab", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("american", "mexican", "chinese", "indian", "german", "french", "spanish", "turkish", "polish", "russian"),
    ("immigrants", "natives", "refugees", "citizens"), ("immigrant", "native", "refugee", "citizen"),
    ("old", "young"), ("elderly", "teenage"), ("blind", "deaf", "disabled", "autistic"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("christen", "muslime", "juden", "hindus", "buddhisten"),
    ("schwarze", "weiße", "asiaten", "araber"), ("einwanderer", "flüchtlinge", "bürger"), ("türken", "polen", "russen", "deutsche"),
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes"),
    ("noirs", "blancs", "asiatiques", "arabes"), ("immigrés", "réfugiés", "citoyens"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("chicas", "chicos"), ("cristianos", "musulmanes", "judíos", "hindúes", "budistas"),
    ("negros", "blancos", "asiáticos", "árabes"), ("inmigrantes", "refugiados", "ciudadanos"),
)


def swaps(terms=IDENTITY_TERMS) -> list[dict[bytes, bytes]]:
    """For each of TWINS, every term with the next one of its group, the one after that, and so on."""
    groups = [[t.encode() if isinstance(t, str) else t for t in dict.fromkeys(g)] for g in terms]
    return [{a: g[(k + step) % len(g)] for g in groups for k, a in enumerate(g) if g[(k + step) % len(g)] != a} for step in range(1, TWINS + 1)]


class WordFeatures:
    """Hashed features of words; those of known words are kept."""

    def __init__(self):
        self._reset()

    def _reset(self):
        self.index: dict[bytes, int] = {}
        self.table = np.zeros((0, 1 + len(BEGINNINGS)), np.int32)

    def _learn(self, words: list[bytes]) -> None:
        digest, mask = xxhash.xxh64_intdigest, (1 << BITS) - 1
        flat = (x for w in words for x in (digest(w) & mask, *((digest(w[:n], n) & mask) if len(w) > n else -1 for n in BEGINNINGS)))
        new = np.fromiter(flat, np.int32, len(words) * self.table.shape[1]).reshape(-1, self.table.shape[1])
        self.index.update(zip(words, range(len(self.table), len(self.table) + len(words)), strict=True))
        self.table = np.concatenate((self.table, new))

    def of(self, docs: list[set[bytes]]) -> list[np.ndarray]:
        """The distinct features of each set of words."""
        if len(self.index) > CACHE:
            self._reset()
        if new := set().union(*docs).difference(self.index):
            self._learn(list(new))
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(docs)), np.int64, int(sizes.sum()))
        seen, out = np.zeros(1 << BITS, np.int64), []
        for rows in np.split(self.table[at], np.cumsum(sizes)[:-1]):
            flat = rows[rows >= 0]
            seen[flat] = order = np.arange(len(flat))
            out.append(flat[seen[flat] == order])
        return out


_known = WordFeatures()  # of this Python worker


def features(texts: list[bytes]) -> list[np.ndarray]:
    return _known.of([set(split_words(t)) for t in texts])


def mentions(words: set[bytes], swap: dict[bytes, bytes]) -> list[bytes]:
    """At most MENTIONS terms of a text, those of smallest hash, so that common terms don't keep rare ones out."""
    return sorted(swap.keys() & words, key=xxhash.xxh3_64_intdigest)[:MENTIONS]


def twins(texts: list[bytes], swap: dict[bytes, bytes]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """The features that each text's twin has and the text hasn't, and the other way round; None if no term is named."""
    own = [set(split_words(t)) for t in texts]
    named = [mentions(w, swap) for w in own]
    other = _known.of([(w - set(n)) | {swap[x] for x in n} if n else set() for w, n in zip(own, named, strict=True)])
    return [(np.setdiff1d(f, o), np.setdiff1d(o, f)) if n else None for f, o, n in zip(other, _known.of(own), named, strict=True)]


def fit(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]] = (), penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights of the features and the intercept. pairs: for each twin, the features that it gains and loses."""
    size, n = 1 << BITS, len(rows)
    if not n or labels.min() == labels.max():
        rate = (labels.sum() + 0.5) / (n + 1.0)
        return np.zeros(size), float(np.log(rate / (1 - rate)))
    def counts(some: list[np.ndarray]) -> np.ndarray:
        return sum((np.bincount(np.concatenate(some[k : k + 500]), minlength=size) for k in range(0, len(some), 500)), np.zeros(size, np.int64))

    docs, ones = counts(rows), labels.sum()
    toxic = counts([r for r, y in zip(rows, labels, strict=True) if y])
    odds = np.log((toxic + 1) / (ones + 2) / ((docs - toxic + 1) / (n - ones + 2)))
    known = docs >= min(LEAST_DOCS, 1 + n // 100)
    kept = [r[known[r]] for r in rows]
    lengths, at = np.array([len(r) for r in kept], np.int64), np.concatenate(kept)
    del kept
    # Runs of rows, so that what a step works out at once stays small.
    edges = np.concatenate(([0], np.cumsum(lengths)))
    cuts = [0, *(np.flatnonzero(np.diff(edges[1:] // RUN)) + 1).tolist(), len(lengths)]
    runs = [(s, e, at[edges[s] : edges[e]], s + np.flatnonzero(lengths[s:e])) for s, e in zip(cuts, cuts[1:], strict=False) if e > s]
    change = np.concatenate([np.zeros(0, STORED), *(x for p in pairs for x in p)])
    sign = np.repeat(np.tile([1.0, -1.0], len(pairs)), [len(x) for p in pairs for x in p])
    twin = np.repeat(np.arange(len(pairs)), [len(gain) + len(loss) for gain, loss in pairs])
    w, b = np.full(size, 0.05), float(np.log(ones / (n - ones)))
    m = v = np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        z, weights = np.full(n, b), w * odds
        for _, _, part, full in runs:
            if len(full):
                z[full] += np.add.reduceat(weights[part], edges[full] - edges[full[0]])
        pull = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        grad = DECAY * w
        for s, e, part, _ in runs:
            grad += odds * np.bincount(part, np.repeat(pull[s:e], lengths[s:e]), size)
        if len(pairs):
            moved = np.bincount(twin, sign * (weights * known)[change], len(pairs))
            grad += odds * known * np.bincount(change, sign * (2 * penalty / len(pairs) * moved)[twin], size)
        grad = np.append(grad, pull.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return np.where(known, w * odds, 0.0), float(b)


def learned_terms(labelled: DataFrame) -> list[bytes]:
    """The terms of labelled(text, label), by frequency: words of TERM_DOCS rows or more whose log-odds stay within VALENCE, at most TERMS."""

    def words(batches):
        for b in small_batches(batches, 64):
            found = [set(split_words(t)) for t in text_bytes(b.column("text"))]
            labels = np.repeat(b.column("label").to_numpy(zero_copy_only=False), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(chain.from_iterable(found), pa.binary()), pa.array(labels, pa.int32())], ["word", "label"])

    counts = labelled.select("text", "label").mapInArrow(words, "word binary, label int").groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("toxic"))
    total, ones = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    odds = F.log((F.col("toxic") + 1) / (ones + 2.0) / ((F.col("n") - F.col("toxic") + 1) / (total - ones + 2.0)))
    found = counts.filter((F.col("n") >= TERM_DOCS) & (F.abs(odds) <= VALENCE)).orderBy(F.desc("n"), "word").limit(TERMS)
    return [bytes(r[0]) for r in found.select("word").collect()]


def train(docs: DataFrame, labels: DataFrame, terms=IDENTITY_TERMS, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """fit() on at most LABELLED rows of docs(doc_id, text) that labels(doc_id, toxic) marks and that aren't held out.

    Of rows that repeat a doc_id, and of labels that do, one counts (the label 1). Rows without doc_id or label teach nothing; null text is
    empty. labels.toxic may be of any number type. Without labels, or with one kind alone, every score is their rate.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out("doc_id", 5, 0)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    chosen = hashed_sample(known, "doc_id", LABELLED)
    # The chosen labels are at most LABELLED rows of two numbers.
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    labelled = materialize(labelled, "toxicity-labelled")
    swap = swaps((*terms, learned_terms(labelled)))

    def run(batches):
        # Few texts at a time: each is held as several sets of words.
        for b in small_batches(batches, 64):
            texts = text_bytes(b.column("text"))
            own, lists = features(texts), pa.list_(pa.binary())
            both = [[t[k] for t in each if t] for each in zip(*(twins(texts, s) for s in swap), strict=True) for k in (0, 1)]
            gains, losses = (pa.array([[x.astype(STORED).tobytes() for x in rows] for rows in both[k::2]], lists) for k in (0, 1))
            sizes = pa.array([len(f) for f in own], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), b.column("label"), sizes, pa.array([f.astype(STORED).tobytes() for f in own], pa.binary()), gains, losses], ["doc_id", "label", "n", "own", "gain", "loss"])

    table = materialize(labelled.mapInArrow(run, "doc_id string, label int, n long, own binary, gain array<binary>, loss array<binary>"), "toxicity-features")
    share = MOST_FEATURES / max(table.agg(F.sum("n")).first()[0] or 0, 1)
    if share < 1:
        table = table.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = table.drop("n").toPandas().sort_values("doc_id", kind="stable")
    rows = [np.frombuffer(x, STORED) for x in got["own"]]  # views of what came, not copies
    pairs = [(np.frombuffer(g, STORED), np.frombuffer(f, STORED)) for gain, loss in zip(got["gain"], got["loss"], strict=True) for g, f in zip(gain, loss, strict=True)]
    return fit(rows, got["label"].to_numpy(np.float64), pairs, penalty)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """docs, all columns, with score (double) added; a column of that name is replaced.

    Null text is empty and scores the intercept. Long texts are read whole; equal texts score alike; an empty table stays empty.
    """
    docs = docs.drop("score")
    return _scored(docs, model).select(*[F.col(f"row.`{c}`") for c in docs.columns], "score")


def _scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    docs = carried(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])

    def run(batches):
        weights, b0 = shared.value
        for b in small_batches(batches):
            z = np.array([weights[f].sum() + b0 for f in features(text_bytes(b.column("row").field("text")))])
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["row", "score"])

    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs, all columns as they are, without rows that score threshold or more. The rest is said at train() and score()."""
    return _scored(docs, train(docs, labels)).filter(F.col("score") < threshold).select("row.*")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
