"""Token counts of texts through a cache of digests.

Every text gets the digest of its normalised content (what the tokenizer's own normalizer makes of it). Digests are joined with the counts
that the cache holds for this version of the tokenizer; of the rest each distinct text is encoded once and its count is appended to the
cache. Texts don't travel for that: the scan that encodes knows by Bloom filters which digests miss and which stand on several rows.
A digest that surely misses and surely stands once is encoded where it is read; only texts of the others are dealt by digest, one row
of each, and compared exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.llm.common import discard, documents, materialize, new_path, small_batches
from lumaframe.llm.exact_dedup import _filter_bits, digest_filter

CACHE_SCHEMA = "digest binary, n_tokens long, version string"
#: Pieces whose counts a worker keeps at hand (some 120 bytes each), and characters of them; then it starts anew.
PIECES, PIECE_CHARS = 500_000, 30_000_000
#: Characters of a text that are cut at a time.
STRETCH = 1 << 20
#: Digests that a task remembers as sent, so that copies in one task travel once.
SENT = 200_000
#: White space of one side of Unicode's tables and regex engines, not of the other: texts with one of these are encoded whole.
UNCERTAIN = re.compile("[\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]")
#: Where byte-level pre-tokenizers always cut: before white space that follows something else, behind a run of ASCII letters or digits that no other letter
#: continues, and behind a run of ASCII signs before a letter, digit or space. Not behind an apostrophe, which may begin a contraction.
PIECE = re.compile(r"\s*(?:[A-Za-z]++(?![^\x00-\x7F])|[0-9]++(?![^\x00-\x7F])|[!-&(-/:-@\[-`{-~]++(?=[A-Za-z0-9\s]|\Z)|\S+)|\s+")
EDGE = re.compile(r"\S(?=\s)")


class TokenCounter:
    """Counts the tokens that the library gives for a .json (tokenizers) or .model (sentencepiece) file, special tokens not added."""

    def __init__(self, path: str):
        self.pieces: dict[str, int] = {}
        self.chars = 0
        self.by_piece, self.special = False, ()
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.normalizer = None
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.encode = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.normalizer = tokenizer.normalizer
        self.special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        split = json.loads(tokenizer.to_str())["pre_tokenizer"] or {}
        self.by_piece = self.normalizer is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")

    def content(self, text: str) -> str:
        """What digests are taken of: equal content has equal counts. Special strings are found before a normalizer works, so texts with one stay as they are."""
        if self.normalizer is None:
            return text
        made = self.normalizer.normalize_str(text)
        return "=" + text if any(s in text or s in made for s in self.special) else "~" + made

    def _cut(self, text: str) -> Iterator[list[str]]:
        at = 0
        while at < len(text):
            edge = EDGE.search(text, at + STRETCH) if len(text) > at + STRETCH else None
            end = edge.end() if edge else len(text)
            yield PIECE.findall(text, at, end)
            at = end

    def counts(self, texts: list[str]) -> list[int]:
        whole = [k for k, t in enumerate(texts) if not self.by_piece or UNCERTAIN.search(t) or any(s in t for s in self.special)]
        out = dict(zip(whole, self.encode([texts[k] for k in whole]), strict=True)) if whole else {}
        known = self.pieces
        for k, text in enumerate(texts):
            if k in out:
                continue
            out[k] = 0
            for pieces in self._cut(text):
                new = [p for p in dict.fromkeys(pieces) if p not in known]
                if new:
                    self.chars += sum(map(len, new))
                    known.update(zip(new, self.encode(new), strict=True))
                out[k] += sum(map(known.__getitem__, pieces))
                if len(known) > PIECES or self.chars > PIECE_CHARS:
                    known.clear()
                    self.chars = 0
        return [out[k] for k in range(len(texts))]


@lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    """One for each Python worker."""
    return TokenCounter(path)


def tokenizer_version(path: str) -> str:
    """A digest of the tokenizer's file and the library that reads it."""
    from importlib.metadata import version

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return hashlib.sha256(f"{library} {version(library)} ".encode() + Path(path).read_bytes()).hexdigest()


def _digested(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) with text filled, n_bytes and digest."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sized = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    if _counter(path).normalizer is None:
        return sized.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    schema = sized.select("*").schema.add("digest", "binary")

    def digest(batches):
        counter = _counter(path)
        for b in small_batches(batches):
            found = [hashlib.sha256(counter.content(t).encode()).digest() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], schema.names)

    return sized.mapInArrow(digest, schema)


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) that the cache holds for this version; one row for each digest, also where writers met. No rows where no cache is yet."""
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except pyspark.errors.AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CACHE_SCHEMA)
    return found.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _surely(bits: np.ndarray | None, width: int, digest: bytes) -> bool:
    """Whether the filter lacks the digest, and so the set does."""
    return bits is not None and not all(bits[x >> 3] >> (x & 7) & 1 for x in _filter_bits(digest, width))


def _encode_misses(docs: DataFrame, path: str, keys: DataFrame, todo: DataFrame, known: DataFrame) -> DataFrame:
    """(digest, n_tokens) of the digests of todo(digest, n), each encoded once."""
    spark = docs.sparkSession
    shares = spark.sparkContext.broadcast
    hits = keys.select("digest").distinct().join(known, "digest", "left_semi")
    missing = None
    if hits.limit(1).count():
        bits, width = digest_filter(todo)
        missing = shares((bits.tobytes(), width))

        def pass_by_chance(batches):
            bits, width = np.frombuffer(missing.value[0], np.uint8), missing.value[1]
            for b in batches:
                yield b.filter(pa.array([not _surely(bits, width, d) for d in b.column("digest").to_pylist()], pa.bool_()))

        hits = hits.mapInArrow(pass_by_chance, "digest binary")
    care = todo.filter("n > 1").select("digest")
    bits, width = digest_filter(care.unionByName(hits) if missing else care)
    careful = shares((bits.tobytes(), width))

    def encode(batches):
        counter, sent = _counter(path), set()
        miss, care = ((np.frombuffer(x.value[0], np.uint8), x.value[1]) if x else (None, 0) for x in (missing, careful))
        for b in small_batches(batches):
            here, away = [], []
            for k, d in enumerate(b.column("digest").to_pylist()):
                if _surely(*miss, d):
                    continue
                if _surely(*care, d):
                    here.append(k)
                elif d not in sent:
                    sent.add(d)
                    away.append(k)
            if len(sent) > SENT:
                sent.clear()
            done = b.take(pa.array(here + away, pa.int64()))
            counts = counter.counts(b.column("text").take(pa.array(here, pa.int64())).to_pylist())
            texts = pa.array([None] * len(here) + done.column("text").slice(len(here)).to_pylist(), pa.string())
            yield pa.RecordBatch.from_arrays([done.column("digest"), pa.array(counts + [None] * len(away), pa.int64()), texts], ["digest", "n_tokens", "text"])

    def encode_one(batches):
        counter = _counter(path)
        for b in small_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(counter.counts(b.column("text").to_pylist()), pa.int64())], ["digest", "n_tokens"])

    scanned = materialize(_digested(docs, path).select("digest", "text").mapInArrow(encode, "digest binary, n_tokens long, text string"), "token-count-scan")
    # A text that many tasks sent meets in two steps: a salted one first.
    one = scanned.filter("text IS NOT NULL").groupBy("digest", (F.spark_partition_id() % 64).alias("salt")).agg(F.first("text").alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    dealt = one.join(todo, "digest", "left_semi").mapInArrow(encode_one, "digest binary, n_tokens long")
    return scanned.filter("text IS NULL").select("digest", "n_tokens").unionByName(dealt)


def token_counts(docs: DataFrame, path: str, cache: str | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_bytes, n_tokens, by the tokenizer file at `path`.

    `cache` is a Parquet folder of counts by (digest, tokenizer version) that is read first and appended to; by default a new one in the
    shared folder. Null text counts as empty: no bytes, no tokens. Rows that repeat a doc_id or a text are counted one by one, and
    doc_id may be null and of any type. An empty table gives no rows. Texts of any length count whole; other columns are ignored.
    """
    spark = docs.sparkSession
    cache, version = cache or new_path(spark, "token-count-cache"), tokenizer_version(path)
    docs = docs.select("doc_id", "text")
    keys = materialize(_digested(docs, path).drop("text"), "token-count-keys")
    known = read_cache(spark, cache, version)
    todo = materialize(keys.groupBy("digest").agg(F.count("*").alias("n")).join(known, "digest", "left_anti"), "token-count-todo")
    fresh = _encode_misses(docs, path, keys, todo, known)
    fresh.withColumn("version", F.lit(version)).write.mode("append").parquet(cache)
    discard(todo)
    # Written, so that the join below stands on two plain shuffles, of which Spark can split a digest that fills one.
    counts = materialize(read_cache(spark, cache, version).join(keys.select("digest").distinct(), "digest", "left_semi"), "token-counts")
    return keys.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
