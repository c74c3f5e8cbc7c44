"""Benchmark decontamination by suffix arrays of the training documents.

Each batch of documents is a shard with its own suffix array, sorted by word. A shard indexes only suffixes whose first words
also begin a benchmark window, because no other suffix can hold one. Every benchmark suffix is searched in it by bisection: the range
of suffixes that share a whole window gives all its occurrences. Each of them is then searched in the sorted suffixes of the benchmark,
whose neighbours give the longest verbatim match there. Documents with a match that holds a window are contaminated.
The benchmark side is broadcast in blocks of at most about BLOCK_CHARS characters, one pass over the documents for each block; a block
takes memory in proportion to its words, however long an item is.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumaframe.llm.common import carried, documents, materialize, small_batches, text_bytes

WINDOW = 10
#: Characters of benchmark text in a broadcast block.
BLOCK_CHARS = 8_000_000
#: Words behind the last item, at least a window's.
DEPTH = 32
#: Words of a window's beginning that choose the suffixes of a shard.
FIRST = 3
TABLE_BITS = 22

#: A-Z to a-z; 0-9, a-z and bytes of other scripts stay; all else separates words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def _mix(ids: np.ndarray, n: int, at: np.ndarray | slice) -> np.ndarray:
    """A TABLE_BITS-bit hash of the n ids from each place on."""
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ ids[k : len(ids) - n + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)[at]


def _keys(padded: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The depth ids from each place on as byte strings that sort like them; padded ends with depth zeros."""
    return np.ascontiguousarray(padded[at[:, None] + np.arange(depth)].astype(">u4")).view(f"S{4 * depth}").ravel()


def _powers(n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))))


def _sums(ids: np.ndarray, side: int) -> np.ndarray:
    """Sums of the first 0, 1, 2... words' hashes times powers of an odd number; 0 has another hash on each side, so it equals nothing."""
    h = np.where(ids == 0, np.uint64(side) << np.uint64(62), ids.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((h ^ (h >> np.uint64(29))) * _powers(len(ids))[:-1])))


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """The places of ids in the order of what stands from each on, by doubling the length that is compared."""
    rank, width = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(len(ids), np.int64)
        after[: max(len(ids) - width, 0)] = rank[width:] + 1
        key = rank * (len(ids) + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank[order] = new
        width *= 2
        if new[-1] == len(ids) - 1 or width > len(ids):
            return order.astype(np.int32)


class Suite:
    """A block of benchmark items, ready to be searched for: one array of word ids, a 0 behind each item, and its sorted suffixes."""

    def __init__(self, rows: list[tuple], window: int = WINDOW):
        self.items, self.window, self.vocabulary, parts = [None if i is None else str(i) for i, _ in rows], window, {}, []
        counts = np.zeros(len(rows), np.int64)
        for k, (_, text) in enumerate(rows):
            words = split_words((text or "").encode())
            parts.append(np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), np.int32, len(words)))
            parts.append(np.zeros(1, np.int32))
            counts[k] = len(words)
        self.ids = np.concatenate([*parts, np.zeros(DEPTH, np.int32)])
        self.starts = np.cumsum(counts + 1) - counts - 1
        order = suffix_array(self.ids)
        owner = np.searchsorted(self.starts, order, "right") - 1
        left = self.starts[owner] + counts[owner] - order if len(rows) else np.zeros(len(order))
        # By length: the suffixes that begin with a window, sorted, and where each different window begins among them.
        self.groups = []
        for n in sorted({min(window, int(c)) for c in counts if c}):
            at = order[(left >= n) & (counts[owner] >= n)] if n == window else order[(left == n) & (counts[owner] == n)]
            same = np.ones(max(len(at) - 1, 0), bool)
            for k in range(n):
                same &= self.ids[at[1:] + k] == self.ids[at[:-1] + k]
            self.groups.append((n, at, np.append(np.flatnonzero(np.concatenate(([True], ~same))), len(at))))

    @cached_property
    def keys(self) -> list[np.ndarray]:
        """The different windows of each group."""
        return [_keys(self.ids, at[edges[:-1]], n) for n, at, edges in self.groups]

    @cached_property
    def tables(self) -> dict[int, np.ndarray]:
        """By number of words: which hashes first words of windows have."""
        out = {}
        for n, at, _ in self.groups:
            q = min(n, FIRST)
            out.setdefault(q, np.zeros(1 << TABLE_BITS, bool))[_mix(self.ids, q, at)] = True
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("keys", "tables", "owners", "sums")}

    def shard(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word ids of the texts (0: not in the benchmark; each text ends with a 0), texts' first places and word counts, and the sorted suffixes."""
        get, parts, counts = self.vocabulary.get, [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            words = split_words(t)
            counts[k] = len(words)
            parts.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
            parts.append(np.zeros(1, np.int32))
        ids = np.concatenate([*parts, np.zeros(DEPTH, np.int32)])
        starts = np.cumsum(counts + 1) - counts - 1
        keep = np.zeros(len(ids), bool)
        for q, table in self.tables.items():
            known = ids[: len(ids) - q + 1] > 0
            for k in range(1, q):
                known &= ids[k : len(ids) - q + 1 + k] > 0
            at = np.flatnonzero(known)
            keep[at[table[_mix(ids, q, at)]]] = True
        at = np.flatnonzero(keep)
        return ids, starts, counts, at[np.argsort(_keys(ids, at, self.window), kind="stable")]

    @cached_property
    def owners(self) -> list[np.ndarray]:
        """The numbers of the items of each group's suffixes."""
        return [np.searchsorted(self.starts, at, "right") - 1 for _, at, _ in self.groups]

    @cached_property
    def sums(self) -> np.ndarray:
        return _sums(self.ids, 1)

    def occurrences(self, ids: np.ndarray, array: np.ndarray):
        """(group, places in the shard, number of the window that begins at each) for each group; a place may be in several groups."""
        for g, ((n, _, _), keys) in enumerate(zip(self.groups, self.keys, strict=True)):
            own = _keys(ids, array, n)
            low, high = np.searchsorted(own, keys, "left"), np.searchsorted(own, keys, "right")
            found = np.flatnonzero(high > low)
            times = (high - low)[found]
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield g, array[np.repeat(low[found], times) + within], np.repeat(found, times)

    def longest(self, ids: np.ndarray, group: int, places: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, benchmark place) of the longest match of the shard from each place, which begins with a window of the group.

        Words are compared by sums of 64-bit hashes, in as many steps as the length has bits.
        """
        n, at, edges = self.groups[group]
        if n < self.window or not len(places):
            return np.full(len(places), n), at[edges[windows]].astype(np.int64)
        powers, sums = _powers(max(len(ids), len(self.ids))), _sums(ids, 2)
        low, high = edges[windows], edges[windows + 1]
        best, where = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            here, there = places[open_], at[middle].astype(np.int64)
            least, most = np.full(len(open_), n), np.minimum(len(ids) - here, len(self.ids) - there) - 1
            while (least < most).any():
                half = (least + most + 1) // 2
                same = (sums[here + half] - sums[here]) * powers[there] == (self.sums[there + half] - self.sums[there]) * powers[here]
                least, most = np.where(same, half, least), np.where(same, most, half - 1)
            more = least > best[open_]
            best[open_[more]], where[open_[more]] = least[more], there[more]
            after = ids[here + least] > self.ids[there + least]
            low[open_[after]] = middle[after] + 1
            high[open_[~after]] = middle[~after]
        return best, where

    def place(self, at: int) -> tuple[str | None, int]:
        """(item, word place in it) of a place."""
        item = int(np.searchsorted(self.starts, at, "right")) - 1
        return self.items[item], at - int(self.starts[item])

    def names(self, group: int, window: int) -> set[str]:
        """The items that have the window."""
        edges = self.groups[group][2]
        return {self.items[k] for k in self.owners[group][edges[window] : edges[window + 1]].tolist()} - {None}


def n_blocks(benchmark: DataFrame) -> int:
    """Blocks of the benchmark, after a look at the size of the table."""
    return -(-(benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS) or 1


def suite(benchmark: DataFrame, block: int, blocks: int) -> Suite:
    rows = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select(F.col("item_id").cast("string"), "text")
    return Suite([tuple(r) for r in rows.collect()])


def _found(docs: DataFrame, block: Suite, hits_only: bool = False) -> DataFrame:
    """docs, all columns but text, with what the block has in common with each text; the text may stand in a struct `row`.

    n_words; bits: which words are hit, null if none; items: those with windows; longest: words of the longest match that holds a window,
    longest_word: where it begins, item_id and item_word: where in the benchmark.
    """
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kept = [c for c in docs.columns if c != "text"]
    schema = docs.select(*kept).schema
    for name, kind in (("n_words", "long"), ("bits", "binary"), ("items", T.ArrayType(T.StringType())), ("longest", "long"), ("longest_word", "long"), ("item_id", "string"), ("item_word", "long")):
        schema = schema.add(name, kind)

    def run(batches):
        block = shared.value
        for b in small_batches(batches):
            ids, starts, counts, array = block.shard(text_bytes(b.column("row").field("text") if "row" in kept else b.column("text")))
            edge, items, best = np.zeros(len(ids) + 1, np.int64), [set() for _ in range(b.num_rows)], [(0, 0, 0)] * b.num_rows
            for g, places, windows in block.occurrences(ids, array):
                np.add.at(edge, places, 1)
                np.add.at(edge, places + block.groups[g][0], -1)
                words, there = block.longest(ids, g, places, windows)
                owners = np.searchsorted(starts, places, "right") - 1
                for d, w in zip(*np.unique(np.stack((owners, windows)), axis=1).tolist(), strict=True):
                    items[d].update(block.names(g, w))
                for d, *match in zip(owners.tolist(), words.tolist(), (starts[owners] - places).tolist(), there.tolist(), strict=True):
                    best[d] = max(best[d], tuple(match))
            hit = np.cumsum(edge) > 0
            some = np.concatenate(([0], np.cumsum(hit)))
            bits = [np.packbits(hit[s : s + n]).tobytes() if some[s + n] > some[s] else None for s, n in zip(starts, counts, strict=True)]
            found = [(n, -at, *block.place(there)) if n else (0, None, None, None) for n, at, there in best]
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)] if found else [pa.nulls(0, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64())]
            columns = [pa.array(counts), pa.array(bits, pa.binary()), pa.array(map(sorted, items), pa.list_(pa.string())), *columns]
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *columns], schema.names)
            yield out.filter(out.column("bits").is_valid()) if hits_only else out

    return docs.mapInArrow(run, schema)


def _hits(docs: DataFrame, benchmark: DataFrame, blocks: int) -> DataFrame:
    """What each block found in texts of docs(doc_id, text_hash, text), a row for each block and text that has something."""
    parts = [materialize(_found(docs, suite(benchmark, k, blocks), True).dropDuplicates(["doc_id", "text_hash"]), "decontaminate") for k in range(blocks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_word.

    A window is WINDOW consecutive words of an item of benchmark(item_id, text), or all words of a shorter item that has any. longest has the
    words of the longest verbatim match with an item that holds a window (0 if there is none), longest_word the first place of one (or -1).
    Null and empty texts have no words and are clean. An item without item_id counts for all but n_items and items_sha256; item_id may
    have any type. An empty benchmark leaves all documents clean; an empty table gives no rows. Rows are judged one by one, whether or
    not they repeat; texts and items of any length count whole; other columns are ignored.
    """
    blocks = n_blocks(benchmark)
    part = F.struct("bits", "items")
    if blocks == 1:
        judged = _found(docs.select("doc_id", "text"), suite(benchmark, 0, 1)).withColumn("parts", F.array(part))
    else:
        hits = _hits(_keyed(docs), benchmark, blocks)
        first = F.max(F.struct("longest", (-F.col("longest_word")).alias("at"))).alias("best")
        hits = hits.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.collect_list(part).alias("parts"), first)
        words = _found(_keyed(docs), Suite([])).select("doc_id", "text_hash", "n_words")
        judged = words.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
        judged = judged.withColumns({"longest": F.coalesce("best.longest", F.lit(0)), "longest_word": -F.col("best.at")})
    judged = judged.select("doc_id", "n_words", "parts", "longest", F.coalesce("longest_word", F.lit(-1).cast("long")).alias("longest_word"))
    schema = judged.select("doc_id", "n_words").schema.add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean").add("longest", "long").add("longest_word", "long")

    def finish(batches):
        for b in batches:
            hits, items = np.zeros(b.num_rows, np.int64), []
            for k, parts in enumerate(b.column("parts").to_pylist()):
                bits = [np.frombuffer(p["bits"], np.uint8) for p in parts or () if p["bits"]]
                hits[k] = np.bitwise_count(np.bitwise_or.reduce(bits)).sum() if bits else 0
                items.append({i for p in parts or () for i in p["items"]})
            sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            columns = [pa.array(hits), pa.array(list(map(len, items)), pa.int64()), pa.array(sha, pa.string()), pa.array(hits > 0)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), *columns, b.column("longest"), b.column("longest_word")], schema.names)

    return judged.mapInArrow(finish, schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, doc_word, n_words, item_id, item_word) of the longest verbatim match of each row of docs(doc_id, text) that holds a window.

    Of matches of equal length the first of the document is given, with one place of the benchmark that has it. Rows without one have no row.
    """
    blocks = n_blocks(benchmark)
    out = _hits(_keyed(docs), benchmark, blocks)
    best = F.max(F.struct("longest", (-F.col("longest_word")).alias("at"), "item_id", "item_word")).alias("m")
    return out.groupBy("doc_id", "text_hash").agg(best).select("doc_id", (-F.col("m.at")).alias("doc_word"), F.col("m.longest").alias("n_words"), "m.item_id", "m.item_word")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that contain a benchmark window. The rest is said at contamination()."""
    blocks = n_blocks(benchmark)
    if blocks == 1:
        return _found(carried(docs), suite(benchmark, 0, 1)).filter("longest = 0").select("row.*")
    hits = _hits(_keyed(docs), benchmark, blocks).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    rows = carried(docs, "doc_id", F.xxhash64("text").alias("text_hash"))
    return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left_anti").select("row.*")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def contamination_sql(documents: str = "documents") -> str:
    """CTEs ending in judged(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_word)."""
    words = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
dw AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS w FROM {documents}),
bw AS (SELECT item_id, row_number() OVER () AS item, {words.format("coalesce(text, '')")} AS w FROM benchmark),
windows AS (SELECT item_id, item, j, array_to_string(list_slice(w, j, j + {WINDOW - 1}), ' ') AS win, least(len(w), {WINDOW}) AS n
  FROM bw, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) r(j) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win FROM dw, sizes, unnest(range(1, len(w) - n + 2)) r(p)),
hits AS (SELECT doc_id, p, g.n, item_id, item, j FROM grams g JOIN windows USING (win)),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id),
runs AS (SELECT doc_id, min(p) AS p, count(*) + any_value(n) - 1 AS n FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item, p - j ORDER BY p) AS run FROM hits) GROUP BY doc_id, item, p - j, run),
longest AS (SELECT doc_id, max(n) AS longest, arg_min(p, (-n, p)) - 1 AS longest_word FROM runs GROUP BY doc_id),
judged AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
    coalesce(longest, 0)::BIGINT AS longest, coalesce(longest_word, -1)::BIGINT AS longest_word
  FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id) LEFT JOIN longest USING (doc_id))"""


OP1_SQL = f"WITH {contamination_sql()} SELECT * FROM judged"
