"""SimHash near-dedup: fingerprints, and exact search for near pairs with vantage-point trees.

Distinct fingerprints are partitioned by a tree of vantage points: a node sends those within `radius` of its vantage point inward and
those farther than radius - DISTANCE outward. By the triangle inequality every pair at DISTANCE or less then meets in at least one
shard, with the boundary zone of each node in both. Inside a shard the same tree goes on down to small leaves, in which all pairs
are compared. The upper tree is built from a sample that grows with the shards; the sample only shapes them, never the result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.llm.common import LOWER_BYTES, documents, hashed_sample, materialize, small_batches, text_bytes
from lumaframe.llm.components import components

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Distinct fingerprints aimed at for a shard, and those of a leaf.
SHARD, LEAF = 40_000, 192
#: Fingerprints that shape the shards: at least, for each shard, and at most (8 MB on the driver; beyond it shards grow, and are cut in their tasks).
SAMPLE, SHARD_SAMPLE, MOST_SAMPLE = 20_000, 64, 1_000_000


def fingerprint_of(text: bytes) -> int:
    """The fingerprint of one text, straight from the definition; the batch form below is what runs."""
    words = text.translate(LOWER_BYTES).split()
    shingles = [b" ".join(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, SEED) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def _fingerprints(batches):
    digest = xxhash.xxh64_intdigest
    for b in small_batches(batches):
        hashes, counts = [], np.zeros(b.num_rows, np.int64)
        for d, text in enumerate(text_bytes(b.column("text"))):
            words = text.translate(LOWER_BYTES).split()
            if not words:
                continue
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
            first = np.concatenate(([0], ends + 1))[: len(last)]
            hashes.append([digest(joined[s:e], SEED) for s, e in zip(first.tolist(), last.tolist(), strict=True)])
            counts[d] = len(last)
        out, full = np.zeros(b.num_rows, np.uint64), np.flatnonzero(counts)
        if len(full):
            flat = np.fromiter(chain.from_iterable(hashes), np.uint64, int(counts.sum()))
            ends = np.cumsum(counts[full])
            for k, (s, e) in zip(full, zip(ends - counts[full], ends, strict=True), strict=True):
                ones = np.unpackbits(flat[s:e].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
                out[k] = np.packbits(2 * ones > e - s, bitorder="little").view(np.uint64)[0]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of docs(doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _cut(fps: np.ndarray, distance: int) -> tuple[np.uint64, int, float]:
    """A vantage point and radius for fps, by a look at some of them, and the share of fps in the larger half."""
    some = fps[:: max(1, len(fps) // 1000)]
    best = (2.0, np.uint64(0), 0)
    for v in some[:: max(1, len(some) // 6)]:
        d = np.bitwise_count(some ^ v)
        below = np.cumsum(np.bincount(d, minlength=65)) / len(some)
        for r in range(64):
            outside = 1 - (below[r - distance] if r >= distance else 0)
            cost = max(below[r], outside) + 0.1 * (below[r] + outside)
            if cost < best[0]:
                best = (cost, v, r)
    return best[1], best[2], best[0]


def _halves(fps: np.ndarray, vantage: np.uint64, radius: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.bitwise_count(fps ^ vantage).astype(np.int64)
    return d <= radius, d > radius - distance


def build_tree(fps: np.ndarray, depth: int, distance: int):
    """Nested (vantage, radius, inner, outer) over a sample of fingerprints; None is a shard."""
    if depth == 0 or len(fps) < 2:
        return None
    vantage, radius, cost = _cut(fps, distance)
    if cost > 1.05:
        return None
    inner, outer = _halves(fps, vantage, radius, distance)
    return vantage, radius, build_tree(fps[inner], depth - 1, distance), build_tree(fps[outer], depth - 1, distance)


def shards_of(tree) -> int:
    return 1 if tree is None else shards_of(tree[2]) + shards_of(tree[3])


def route(tree, fps: np.ndarray, distance: int, shard: int = 1):
    """(shard, its fingerprints): those that lie in it and those of its boundary zones."""
    if tree is None:
        yield shard, fps
    else:
        vantage, radius, inner, outer = tree
        for k, (part, side) in enumerate(zip((inner, outer), _halves(fps, vantage, radius, distance), strict=True)):
            yield from route(part, fps[side], distance, 2 * shard + k)


def _leaf_links(fps: np.ndarray, rows: np.ndarray, others: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.nonzero(np.bitwise_count(fps[rows][:, None] ^ fps[others][None, :]) <= distance)
    i, j = rows[i], others[j]
    return i[i < j], j[i < j]


def links(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Edges (place, place) that connect all fingerprints at distance or less, at most one for each fingerprint; fps are distinct."""
    parent = np.arange(len(fps)).tolist()

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    stack = [np.arange(len(fps))]
    while stack:
        at = stack.pop()
        if len(at) > LEAF:
            vantage, radius, cost = _cut(fps[at], distance)
            inner, outer = _halves(fps[at], vantage, radius, distance)
            if cost < 1.05 and max(inner.sum(), outer.sum()) < 0.95 * len(at):
                stack += [at[inner], at[outer]]
                continue
        for k in range(0, len(at), LEAF):
            for i, j in zip(*(x.tolist() for x in _leaf_links(fps, at[k : k + LEAF], at[k:], distance)), strict=True):
                i, j = find(i), find(j)
                parent[max(i, j)] = min(i, j)
    return [(x, find(x)) for x in range(len(fps)) if parent[x] != x]


def near_links(distinct: DataFrame, distance: int = DISTANCE, shard: int = SHARD) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints (fp) at distance or less: a spanning forest of each shard."""
    n = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / shard)) * 1.5)) if n > shard else 0
    tree = None
    if depth:
        size = min(max(SAMPLE, SHARD_SAMPLE * n // shard), MOST_SAMPLE)
        sample = hashed_sample(distinct.select("fp"), "fp", size, n).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
        tree = build_tree(sample, depth, distance)

    def shards(batches):
        for b in batches:
            for k, fps in route(tree, b.column("fp").to_numpy().view(np.uint64), distance):
                if len(fps):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), k, np.int64)), pa.array(fps.view(np.int64))], ["shard", "fp"])

    def pairs(batches):
        def close(key, parts):
            fps = np.unique(np.concatenate(parts)).view(np.uint64)
            found = np.array(links(fps, distance), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(fps[found[:, k]].view(np.int64)) for k in (0, 1)], ["u", "v"])

        now, parts = None, []
        for b in batches:
            keys, fps = b.column("shard").to_numpy(), b.column("fp").to_numpy()
            for s, e in zip(*_runs(keys), strict=True):
                if keys[s] != now and parts:
                    yield close(now, parts)
                    parts = []
                now = keys[s]
                parts.append(fps[s:e])
        if parts:
            yield close(now, parts)

    routed = distinct.select("fp").mapInArrow(shards, "shard long, fp long")
    return routed.repartition(shards_of(tree), "shard").sortWithinPartitions("shard").mapInArrow(pairs, "u long, v long")


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(keys))


def near_groups(docs: DataFrame, distance: int = DISTANCE, shard: int = SHARD) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, fingerprint, component_id.

    Null and empty texts have fingerprint zero and link like any other. Equal fingerprints are one node, so copies never meet in
    pairs. component_id is the smallest doc_id that is not null in the group. Rows that repeat a doc_id each give a row; an empty
    table gives none; other columns are ignored.
    """
    prints = materialize(fingerprints(docs), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(near_links(distinct, distance, shard)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Only fingerprints with links need their group's smallest id looked up.
    grouped = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(grouped, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs, all columns, with the document of smallest doc_id of each group; rows that repeat a doc_id, or have none, are one document.

    The rest is said at near_groups().
    """
    stay = near_groups(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["__id"]), "left_semi")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
