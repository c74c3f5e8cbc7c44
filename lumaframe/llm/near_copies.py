"""Near copies by the Jaccard similarity of word shingles, exactly: two texts are linked if their sets of shingles have at least `similarity` in common.

Candidates come from prefix filtering. All shingles stand in one global order, and of a set of n only the first n - ceil(similarity * n) + 1
are its prefix: two sets that are similar enough share a shingle of their prefixes, whatever the order is. How many shingles
two prefixes share bounds the overlap of the sets, and only pairs that the bound leaves are compared as whole sets.

The order goes by how many sets hold a shingle, rarest first. First one shingle in HALF is counted, over all sets: a set that has as many
shingles of its own among them as its prefix is long has its whole prefix to itself, so it is like no other and leaves. Of the sets
that stay all shingles are counted, and only those that several hold are ordered; the others come first in every prefix. What stays follows the
number of near copies, not how often prose repeats five words by chance. Tables of FEW sets or less are searched without counts first,
with the shingles last that a bounded sample shows to be frequent. The order shapes the work, never the result.

A large group of near copies never meets in pairs: first each set is compared with a hub, the one of all sets with a prefix shingle that
shares most of its own (an original among its copies), then with hubs of random orders, and after that only sets that this didn't
connect are paired. If in a search without counts a shingle would still pair more than HOT sets, then it is a phrase of texts that aren't alike, which the
sample missed: all shingles are counted, and the search starts again with the links it has. Hubs are found by aggregation and joined back, so that no prefix shingle gathers its sets in one task.
Sets are known by a 64-bit hash; equal ones are one node.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.common import LOWER_BYTES, discard, hashed_sample, materialize, small_batches, text_bytes
from lumaframe.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Documents of the sample that orders shingles, and how many of them make a shingle frequent.
SAMPLE, FREQUENT = 4000, 3
#: Rounds with hubs of a random order.
ROUNDS = 1
#: Different sets that are searched without counts first, and sets that a shingle may then still pair after the hubs; with more, shingles are counted.
FEW, HOT = 10_000, 256
#: One in so many shingles is counted over all sets.
HALF = 2
#: Texts that are compared with one copy of a hub's text.
SHARE = 512
#: Against rounding of products with the similarity; far less than one shingle of the largest set.
TIE = 1e-6


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted, different hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    m = max(1, len(w) - size + 1)
    h = np.zeros(m, np.uint64)
    for k in range(min(size, len(w))):
        h = (h ^ w[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def prefix(found: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The prefix of a sorted set in the order (frequent, hash); frequent is sorted."""
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)] == found
        found = np.concatenate((found[~late], found[late]))
    return found[: len(found) - math.ceil(similarity * len(found) - TIE) + 1] if len(found) else found


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def _frequent(docs: DataFrame, size: int) -> np.ndarray:
    def every(batches):
        for b in small_batches(batches):
            found = [shingles(t, size) for t in text_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["h"])

    sample = hashed_sample(docs.select("doc_id", "text"), "doc_id", SAMPLE)
    rows = sample.select("text").mapInArrow(every, "h long").groupBy("h").count().filter(F.col("count") >= FREQUENT).select("h").toPandas()
    return np.sort(rows["h"].to_numpy(np.int64).view(np.uint64))


def _hot(rows: DataFrame) -> np.ndarray:
    """The shingle of rows(h) that stands on most rows, if those are more than HOT."""
    counted = rows.groupBy("h").count().filter(F.col("count") > HOT)
    found = counted.orderBy(F.desc("count"), "h").limit(1).select("h").toPandas()
    return found["h"].to_numpy(np.int64).view(np.uint64)


def _key(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes())


def _some_shingles(docs: DataFrame, size: int) -> DataFrame:
    """(key, h): the shingles of each row whose hash HALF divides."""

    def run(batches):
        for b in small_batches(batches):
            found = [shingles(t, size) for t in text_bytes(b.column("text"))]
            some = [f[f % np.uint64(HALF) == 0] for f in found]
            keys = np.repeat(np.array([_key(f) for f in found], np.uint64), list(map(len, some)))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (keys, np.concatenate([np.zeros(0, np.uint64), *some]))], ["key", "h"])

    return docs.select("text").mapInArrow(run, "key long, h long")


def _all_shingles(texts: DataFrame, size: int) -> DataFrame:
    """(key, h): every shingle of texts(key, packed)."""

    def run(batches):
        read = zstandard.ZstdDecompressor().decompress
        for b in small_batches(batches):
            found = [shingles(read(t.as_py()), size) for t in b.column("packed")]
            keys = np.repeat(b.column("key").to_numpy(), list(map(len, found)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["key", "h"])

    return texts.mapInArrow(run, "key long, h long")


def _not_alone(nodes: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The nodes(key, n, ...) but for those with a whole prefix of shingles that no other set has."""
    # Copies of a set are one set: a shingle is its own if all rows of it have one key.
    own = _some_shingles(docs, size).groupBy("h").agg(F.min("key").alias("key"), F.max("key").alias("high")).filter("key = high")
    alone = nodes.join(own.groupBy("key").agg(F.count("*").alias("own")), "key").filter(F.col("own") >= F.expr(_prefix_length(similarity)))
    return nodes.join(alone.select("key"), "key", "left_anti")


def _prefix_length(similarity: float) -> str:
    return f"n - ceil({similarity} * n - {TIE}) + 1"


def _rarest_first(nodes: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """(key, n, prefix) of the nodes(key, n) with packed texts, by exact counts; prefix has only shingles that several sets hold."""
    every = _all_shingles(texts, size)
    held = every.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    lists = every.join(held, "h").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("shared"))
    # A set's own shingles come before those that it shares.
    cut = lists.join(nodes.select("key", "n"), "key").withColumn("left", F.expr(f"{_prefix_length(similarity)} - (n - size(shared))")).filter("left > 0")
    return cut.select("key", "n", F.expr("slice(shared.h, 1, cast(left as int))").alias("prefix"))


def _sets(docs: DataFrame, late: np.ndarray | None, size: int, similarity: float) -> DataFrame:
    """(doc_id, text_hash, key, n, prefix) of each row; shingles in `late` (sorted) come behind all others. Without late, prefixes are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(late)

    def run(batches):
        for b in small_batches(batches):
            found = [shingles(t, size) for t in text_bytes(b.column("text"))]
            keys = pa.array(list(map(_key, found)), pa.uint64()).view(pa.int64())
            sizes = pa.array([len(f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), keys, sizes, _lists([f[:0] if shared.value is None else prefix(f, shared.value, similarity) for f in found])], ["doc_id", "text_hash", "key", "n", "prefix"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, key long, n long, prefix array<long>")


def _packed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, packed), the compressed texts of wanted(key, text_hash); equal texts of docs each give a row."""

    def pack(batches):
        write = zstandard.ZstdCompressor(level=3).compress
        for b in small_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(map(write, text_bytes(b.column("text"))), pa.binary())], ["key", "packed"])

    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(wanted, "text_hash")
    return texts.select("key", "text").mapInArrow(pack, "key long, packed binary")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar enough.

    The text of v goes before those that are compared with it, once for each SHARE of them, so that one v of very many pairs is dealt to several tasks.
    """
    pairs = materialize(pairs, "near-candidates")
    shares = pairs.groupBy("v").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    one = lambda wanted: texts.withColumnRenamed("key", wanted.columns[0]).join(wanted, wanted.columns[0])
    hubs = one(shares).dropDuplicates(["v"]).select("v", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("u"), "packed")
    dealt = pairs.join(shares, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("shares")).cast("int").alias("share"))
    others = dealt.join(one(pairs.select("u").distinct()).dropDuplicates(["u"]), "u").select("v", "share", "u", "packed")

    def near(batches):
        read = zstandard.ZstdDecompressor().decompress
        hub, of = None, None
        for b in small_batches(batches):
            keep = []
            for v, u, packed in zip(b.column("v").to_pylist(), b.column("u").to_pylist(), b.column("packed"), strict=True):
                found = shingles(read(packed.as_py()), size)
                if u is None:
                    hub, of = found, v
                    keep.append(False)
                    continue
                if of != v:
                    raise ValueError("The text of a hub is missing.")
                both = len(np.intersect1d(found, hub, assume_unique=True))
                keep.append(both >= similarity * (len(found) + len(hub) - both) - TIE)
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    met = hubs.unionByName(others).repartition("v", "share").sortWithinPartitions("v", "share", F.asc_nulls_first("u"))
    links = materialize(met.mapInArrow(near, "u long, v long"), "near-links")
    discard(pairs)
    return links


def near_links(sets: DataFrame, texts: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, last: bool = True) -> tuple[DataFrame, np.ndarray]:
    """Edges (u, v) that connect all keys of sets(key, n, prefix), which may repeat a key, that are similar enough; texts(key, packed) has their texts.

    Unless it is the last time, a shingle that would pair too many sets is given back beside the links found so far, and nothing is paired.
    """
    every = sets.select("key", "n", F.explode("prefix").alias("h"))
    # Most shingles of prefixes stand in one set only; the others are few rows from here on.
    shared = materialize(every.groupBy("h").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select("h"), "near-shared")
    rows = materialize(every.join(shared, "h").distinct(), "near-prefixes")
    sizes = rows.groupBy("key").agg(F.count("*").alias("shared"))
    close = f"least(n, m) >= {similarity} * greatest(n, m) - {TIE}"
    # A common shingle stands in both prefixes, or behind the prefix that ends first.
    behind = f"ceil({similarity} * greatest(n, m) - {TIE}) - 1"
    enough = f"{close} AND common + {behind} >= {similarity / (1 + similarity)} * (n + m) - {TIE}"
    links, joined, tables = None, rows.join(sizes, "key").withColumn("root", F.col("key")), [shared, rows]
    for k in range(ROUNDS + 1):
        # Numbers that differ by key, so that hubs are hash aggregates of numbers.
        order = F.xxhash64("key", F.lit(k)) if k else F.shiftleft(F.least("shared", F.lit(1 << 22)), 40) + F.pmod(F.xxhash64("key"), F.lit(1 << 40))
        ranked = joined.withColumn("order", order)
        hubs = ranked.groupBy("h").agg(*[f(c, "order").alias(f"{f.__name__[:3]}_{c}") for f in (F.max_by, F.min_by) for c in ("key", "n", "root")]).filter("max_key <> min_key")
        other = [F.when(F.col("max_root") != F.col("root"), F.col(f"max_{c}")).otherwise(F.col(f"min_{c}")) for c in ("key", "n", "root")]
        met = joined.join(hubs, "h").withColumn("p", F.struct(other[0].alias("key"), other[1].alias("n"), other[2].alias("root"))).filter("p.root <> root")
        met = met.select(F.col("key").alias("u"), "n", F.col("p.key").alias("v"), F.col("p.n").alias("m")).filter(close)
        # v isn't the hub of all they share, so half of the bound is asked for; pairs that this misses meet below.
        met = met.groupBy("u", "v", "n", "m").agg((2 * F.count("*")).alias("common")).filter(enough)
        found = _verified(met.groupBy("u").agg(F.max_by("v", F.struct("common", "v")).alias("v")), texts, size, similarity)
        links = found if links is None else links.unionByName(found)
        roots = components(links).select(F.col("u").alias("key"), F.col("v").alias("root"))
        # From here on only shingles that stand in sets of several groups matter.
        rooted = rows.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        mixed = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("h")
        joined = materialize(rooted.join(mixed, "h"), "near-apart")
        rows = joined.drop("root")
        tables.append(joined)
    more = np.zeros(0, np.uint64) if last else _hot(joined)
    if len(more):
        for done in tables:
            discard(done)
        return links, more
    apart = joined.select("h", F.col("key").alias("u"), "n", "root")
    other = apart.toDF("h", "v", "m", "other")
    met = apart.join(other, "h").filter(f"u < v AND root <> other AND {close}").groupBy("u", "v", "n", "m").agg(F.count("*").alias("common"))
    links = links.unionByName(_verified(met.filter(enough).select("u", "v"), texts, size, similarity))
    for done in tables:
        discard(done)
    return links, more


def near_groups(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that is not null in the group, of each row of docs(doc_id, text).

    Null and empty texts and others without words are copies of each other; a long text counts whole. Rows that repeat a doc_id each
    give a row, an empty table gives none, and other columns are ignored.
    """
    owners = materialize(_sets(docs, None, size, similarity).drop("prefix"), "near-owners")
    # Rows of one key have one set; their texts may differ in case, spaces and repeats.
    nodes = materialize(owners.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.min("n").alias("n")), "near-nodes")
    links, more = None, nodes.filter("n > 0").count() > FEW
    if not more:
        sets = materialize(_sets(docs, _frequent(docs, size), size, similarity), "near-sets")
        texts = materialize(_packed(docs, nodes.select("key", "text_hash")), "near-texts")
        links, hot = near_links(sets, texts, size, similarity, False)
        discard(sets), discard(texts)
        more = len(hot) > 0
    if more:
        some = materialize(_not_alone(nodes.filter("n > 0"), docs, size, similarity), "near-not-alone")
        texts = materialize(_packed(docs, some.select("key", "text_hash")).groupBy("key").agg(F.min("packed").alias("packed")), "near-texts")
        sets = materialize(_rarest_first(some, texts, size, similarity), "near-sets")
        found, _ = near_links(sets, texts, size, similarity)
        links = found if links is None else links.unionByName(found)
        discard(some), discard(sets), discard(texts)
    roots = components(links).select(F.col("u").alias("key"), F.col("v").alias("root"))
    rooted = nodes.select("key", "least").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id")
    return owners.join(named, "key").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs, all columns, with the document of smallest doc_id of each group; rows that repeat a doc_id, or have none, are one document."""
    stay = near_groups(docs, size, similarity).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["__id"]), "left_semi")
