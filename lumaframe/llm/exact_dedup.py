"""Exact dedup by a log-structured merge index of text digests.

Map tasks fill a bounded memtable (digest -> surviving id, count) and flush it as sorted runs, one per digest bucket.
Compaction merges a bucket's runs in tiers into one sorted segment of the index; it keeps one identifier per digest.
A Bloom filter over the digests that occur more than once, sized by their number, tells the probing scan which texts it must ship:
all others are proven unique. Every hit is then compared, byte for byte, with the text of the row that stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.llm.common import LOWER, LOWER_BYTES, UPPER, discard, documents, materialize, partitions, small_batches, text_bytes

#: Entries of a memtable before it is flushed (about 100 bytes each).
MEMTABLE = 100_000
#: Runs merged at once by compaction.
FAN_IN = 8
#: log2 of the filter's bits at least and at most (32 MB), and bits for each digest that repeats. Beyond that more texts travel, results stay.
LEAST_BITS, MOST_BITS, DIGEST_BITS = 16, 28, 16

RUN_SCHEMA = "bucket int, n long, digests binary, ids binary, counts binary"
SEGMENT_SCHEMA = "digest binary, keep_id long, group_size long"
NO_ID = {"largest": np.iinfo(np.int64).min, "smallest": np.iinfo(np.int64).max}


def normalise(text: bytes) -> bytes:
    return text.translate(LOWER_BYTES)


def _filter_bits(digest: bytes, width: int) -> tuple[int, int, int]:
    mask = (1 << width) - 1
    wide = hashlib.blake2b(digest, digest_size=12).digest()
    return tuple(int.from_bytes(wide[i : i + 4], "little") & mask for i in (0, 4, 8))


def _flush(table: dict, buckets: int, width: int) -> Iterator[pa.RecordBatch]:
    """The memtable as sorted runs, one row for each bucket."""
    keys = sorted(table)
    digests = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), width)
    ids, counts = (np.array([table[k][i] for k in keys], np.int64) for i in (0, 1))
    head = np.zeros((len(keys), 4), np.uint8)
    head[:, : min(4, width)] = digests[:, :4]
    bucket = (head.view(">u4").ravel().astype(np.uint64) * buckets >> np.uint64(32)).astype(np.int64)
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = [(b, int(e - s), digests[s:e].tobytes(), ids[s:e].tobytes(), counts[s:e].tobytes()) for b, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if e > s]
    if rows:
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], ["bucket", "n", "digests", "ids", "counts"])


def _merge(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], keep: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sorted run of several: equal digests become one entry with one id and the summed count."""
    digests, ids, counts = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(digests, kind="stable")
    digests, ids, counts = digests[order], ids[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], digests[1:] != digests[:-1])))
    best = (np.maximum if keep == "largest" else np.minimum).reduceat(ids, first)
    return digests[first], best, np.add.reduceat(counts, first)


def build_index(docs: DataFrame, keep: str = "smallest", digest_bytes: int = 32) -> DataFrame:
    """(digest, keep_id, group_size) of docs(doc_id, text), a sorted segment for each bucket of digests."""
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    none = NO_ID[keep]
    pick = max if keep == "largest" else min

    def memtables(batches):
        table: dict = {}
        for b in small_batches(batches):
            for i, text in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text")), strict=True):
                d = hashlib.sha256(normalise(text)).digest()[:digest_bytes]
                i = none if i is None else i
                old = table.get(d)
                table[d] = (i, 1) if old is None else (pick(i, old[0]), old[1] + 1)
            if len(table) >= MEMTABLE:
                yield from _flush(table, buckets, digest_bytes)
                table = {}
        yield from _flush(table, buckets, digest_bytes)

    def compact(batches):
        tiers: dict[int, list] = {}
        now = None

        def close(tiers):
            digests, ids, counts = _merge([r for t in tiers.values() for r in t], keep)
            flat = digests.view(np.uint8).reshape(len(digests), digest_bytes)
            for at in range(0, len(ids), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in flat[part]], pa.binary()), pa.array(ids[part], mask=ids[part] == none), pa.array(counts[part])], ["digest", "keep_id", "group_size"])

        for b in batches:
            for row in b.to_pylist():
                if row["bucket"] != now and tiers:
                    yield from close(tiers)
                    tiers = {}
                now = row["bucket"]
                level, run = 0, tuple(np.frombuffer(row[k], t) for k, t in (("digests", f"S{digest_bytes}"), ("ids", np.int64), ("counts", np.int64)))
                tiers.setdefault(0, []).append(run)
                while len(tiers[level]) >= FAN_IN:
                    tiers.setdefault(level + 1, []).append(_merge(tiers[level], keep))
                    tiers[level] = []
                    level += 1
        if tiers:
            yield from close(tiers)

    runs = docs.select("doc_id", "text").mapInArrow(memtables, RUN_SCHEMA)
    return runs.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(compact, SEGMENT_SCHEMA)


def digest_filter(digests: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter over digests(digest), as bytes, and log2 of its bits, sized by their number."""
    width = min(max(LEAST_BITS, (DIGEST_BITS * digests.count()).bit_length()), MOST_BITS)

    def bits(batches):
        for b in batches:
            at = np.array([x for d in b.column("digest").to_pylist() for x in _filter_bits(d, width)], np.int64)
            words, inverse = np.unique(at >> 6, return_inverse=True)
            masks = np.zeros(len(words), np.int64)
            np.bitwise_or.at(masks, inverse, np.left_shift(np.int64(1), at & 63))
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(masks)], ["word", "mask"])

    found = digests.select("digest").mapInArrow(bits, "word long, mask long")
    rows = found.groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()  # 2^22 rows at most
    words = np.zeros(1 << (width - 6), np.int64)
    words[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64)
    return words.view(np.uint8), width


def repeat_filter(index: DataFrame) -> tuple[np.ndarray, int]:
    """The filter over digests that occur more than once."""
    return digest_filter(index.filter("group_size > 1"))


def exact_groups(docs: DataFrame, keep: str = "smallest", digest_bytes: int = 32) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Null text counts as empty. doc_id is the key of a document: rows
    that repeat it each give a row with the same decision. A null doc_id never stays unless its whole group has none. An
    empty table gives no rows; other columns of docs are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    index = materialize(build_index(docs, keep, digest_bytes), "dedup-index")
    words, width = repeat_filter(index)
    maybe = spark.sparkContext.broadcast(words.tobytes())

    def probe(batches):
        bits = np.frombuffer(maybe.value, np.uint8)
        for b in small_batches(batches):
            digests, hexes, hits = [], [], []
            for text in text_bytes(b.column("text")):
                text = normalise(text)
                sha = hashlib.sha256(text)
                d = sha.digest()[:digest_bytes]
                digests.append(d)
                hexes.append(sha.hexdigest())
                hits.append(text if all(bits[x >> 3] >> (x & 7) & 1 for x in _filter_bits(d, width)) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digests, pa.binary()), pa.array(hexes), pa.array(hits, pa.binary())], ["doc_id", "digest", "text_sha256", "hit"])

    # Written once: three joins read it.
    probed = materialize(docs.mapInArrow(probe, "doc_id long, digest binary, text_sha256 string, hit binary"), "dedup-probed")
    found = probed.join(index, "digest")
    stays = (
        probed.filter("hit IS NOT NULL").withColumnRenamed("doc_id", "keep_id")
        .join(index.filter("group_size > 1"), ["digest", "keep_id"])
        .groupBy("digest").agg(F.first("hit").alias("stays"))
    )
    checked = found.filter("group_size = 1").withColumn("other", F.lit(None).cast("binary")).drop("hit").unionByName(
        found.filter("group_size > 1").join(stays, "digest", "left").withColumn("other", F.expr("CASE WHEN stays = hit THEN NULL ELSE hit END")).drop("stays", "hit")
    )
    checked = materialize(checked, "dedup-hits")
    discard(probed)
    decided = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull())
    if not checked.filter("other IS NOT NULL").limit(1).count():
        return checked.select("doc_id", "keep_id", "group_size", decided.alias("kept"), "text_sha256")
    # Different texts share a digest: group the rows of those digests by their bytes.
    clash = checked.filter("other IS NOT NULL").select("digest").distinct()
    mixed = checked.join(clash, "digest", "left_semi")
    groups = mixed.groupBy("digest", F.coalesce("other", F.lit(b"")).alias("bytes"), F.isnull("other").alias("same")).agg((F.max if keep == "largest" else F.min)("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    redone = mixed.drop("keep_id", "group_size").withColumns({"bytes": F.coalesce("other", F.lit(b"")), "same": F.isnull("other")}).join(groups, ["digest", "bytes", "same"])
    out = checked.join(clash, "digest", "left_anti").select("doc_id", "keep_id", "group_size", "text_sha256").unionByName(redone.select("doc_id", "keep_id", "group_size", "text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", decided.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """docs without the rows that do not stay; all columns are kept. Rows that repeat a kept doc_id all stay."""
    stay = exact_groups(docs, keep).filter("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["__id"]), "left_semi")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir), keep="largest")


OP10_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
