r"""Suffix-array dedup: removal of every byte covered by a SPAN-byte string that starts more than once, by a distributed merge sort of suffixes.

Which suffixes. Each SPAN-byte window has an anchor, the place of its least hashed GRAM-byte string, so equal windows have equal anchors.
An anchor's windows are split in two by how far before it they start; each half is one item with one suffix, which begins where the last
of the half's possible windows begins. All windows of an item contain the CORE bytes from there on, so an item whose core is
unique (by hash) holds no repeated window and is never sorted. Items with equal bytes are one suffix with a count.

Sorting. Tasks sort their suffixes, front-code them (length of the prefix shared with the one before, and the rest), and cut the run at
common splitters. Each range of the splitters is merged by one task with a loser tree that carries the prefix lengths: a comparison starts
behind the prefix that is known to be shared, or is decided by two lengths alone. The merge yields the sorted suffixes with their
longest common prefixes.

Reading. The window that starts e bytes before a suffix is shared by two items if their suffixes share SPAN - e bytes and the bytes before
them e. Joining neighbours by falling prefix length, smaller set into larger, and looking only at the nearest bytes before, finds
each item's shared windows without forming pairs. An item whose suffix counts twice has them all.

Cores with more than HOT different items are not gathered in one range: their windows are counted by hash, which is spread evenly.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.llm.common import discard, documents, hashed_sample, materialize, partitions, small_batches, text_bytes

SPAN, GRAM = 400, 32
#: Window starts of an item at most, and the bytes that all its windows share.
HALF = (SPAN - GRAM + 2) // 2
CORE = SPAN - HALF + 1
#: Items of one core that are sorted together; suffixes of a run; suffixes aimed at for a range; suffixes that shape the splitters.
HOT, RUN, RANGE, SAMPLE = 20_000, 20_000, 40_000, 20_000
#: Bytes of a splitter: as many as equal cores have, so that a common phrase with many different continuations is cut.
SPLIT_BYTES = CORE
#: Windows whose anchors are found together, and the bits of a place among them.
CHUNK, PLACE_BITS = 1 << 22, 27


def _window_anchors(text: bytes) -> np.ndarray:
    """The anchor of each SPAN-byte window of text; it depends on the window alone, so long texts are taken in pieces."""
    if len(text) > CHUNK + SPAN - 1:
        return np.concatenate([_window_anchors(text[k : k + CHUNK + SPAN - 1]) + k for k in range(0, len(text) - SPAN + 1, CHUNK)])
    n = len(text) - GRAM + 1
    words = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k, c in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0x27D4EB2F165667C5)):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[k : n + k] * np.uint64(c)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    # The hash above the place: the least value is the leftmost place of the least hash.
    mask = np.uint64((1 << PLACE_BITS) - 1)
    h = (h & ~mask) | np.arange(n, dtype=np.uint64)
    w = SPAN - GRAM + 1
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - w + 1], ahead[w - 1 : n]) & mask).astype(np.int64)


def items_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, low, high): the suffix begins at `at`, the item's windows low..high bytes before it."""
    if len(text) < SPAN:
        return (np.zeros(0, np.int64),) * 3
    anchor = _window_anchors(text)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(first[1:], len(anchor)) - 1
    anchor, out = anchor[first], []
    for near in (0, HALF):
        at = anchor - near
        low, high = np.maximum(0, at - last), np.minimum(at - first, HALF - 1)
        ok = low <= high
        out.append((at[ok], low[ok], high[ok]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _context(text: bytes, at: int, low: int, high: int) -> bytes:
    return text[at - high : at - low + SPAN]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    core_hash, whole_hash = xxhash.xxh64_intdigest, xxhash.xxh3_128_digest
    for b in small_batches(batches, 256):
        rows, parts, keys, wholes = [], [], [], []
        for row, text in enumerate(text_bytes(b.column("text"))):
            at, low, high = items_of(text)
            if len(at):
                rows.append(np.full(len(at), row))
                parts.append((at, low, high))
                keys += [core_hash(text[a : a + CORE]) for a in at.tolist()]
                # The lengths tell items apart whose bytes are equal but not their windows.
                wholes += [whole_hash(text[a - h : a - lo + SPAN], lo << 16 | h) for a, lo, h in zip(at.tolist(), low.tolist(), high.tolist(), strict=True)]
        if rows:
            rows = pa.array(np.concatenate(rows))
            at, low, high = (pa.array(np.concatenate(x).astype(np.int32)) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("text_hash").take(rows), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(wholes, pa.binary()), at, low, high], ["doc_id", "text_hash", "core", "item", "at", "low", "high"])


ITEMS = "doc_id long, text_hash long, core long, item binary, at int, low int, high int"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the chosen items of each document: the suffix, and what stands before it, backwards."""
    for b in small_batches(batches, 256):
        out = []
        for text, chosen in zip(text_bytes(b.column("text")), b.column("chosen").to_pylist(), strict=True):
            for c in chosen:
                at, low, high = c["at"], c["low"], c["high"]
                out.append((c["item"], c["core"], c["n"], c["hot"], low, high, text[at : at - low + SPAN], text[at - high : at][::-1]))
        if out:
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["item", "core", "n", "hot", "low", "high", "suffix", "before"])


CONTEXTS = "item binary, core long, n long, hot boolean, low int, high int, suffix binary, before binary"


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the prefix that a and b share, of which `known` bytes are known to be shared."""
    n = min(len(a), len(b))
    while known < n and a[known : known + 32] == b[known : known + 32]:
        known += 32
    if known >= n:
        return n
    while known < n and a[known] == b[known]:
        known += 1
    return known


def front_code(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted suffixes: the lengths of the prefixes shared with the one before, and the rests."""
    shared = [0, *(common_prefix(a, b) for a, b in zip(suffixes, suffixes[1:], strict=False))] if suffixes else []
    return shared, [s[n:] for s, n in zip(suffixes, shared, strict=True)]


def merge_runs(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, bytes, int]]:
    """(run, place in it, suffix, prefix shared with the suffix given before) of front-coded sorted runs, in sorted order.

    A loser tree: every inner node holds the run that lost there and the prefix it shares with the run that won. As all lengths on the
    winner's path refer to the suffix just given, the longer shared prefix is the smaller suffix, and only equal lengths look at bytes.
    """
    k = len(runs)
    head, place = [r[1][0] if r[1] else None for r in runs], [0] * k
    shared, loser = [0] * k, [-1] * k  # node 0 has the winner

    def less(a: int, b: int) -> bool:
        """Whether run a's head comes first; sets the loser's shared prefix."""
        if head[a] is None or head[b] is None:
            return head[b] is None
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        x, y = head[a], head[b]
        n = common_prefix(x, y, shared[a])
        first = x[n:] <= y[n:]
        shared[b if first else a] = n
        return first

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        first = less(a, b)
        loser[node] = b if first else a
        return a if first else b

    winner = play(1) if k > 1 else 0
    while head[winner] is not None:
        yield winner, place[winner], head[winner], shared[winner]
        place[winner] += 1
        lengths, rests = runs[winner]
        if place[winner] < len(rests):
            n = lengths[place[winner]]
            head[winner], shared[winner] = head[winner][:n] + rests[place[winner]], n
        else:
            head[winner] = None
        node = (winner + k) >> 1
        while node:
            other = loser[node]
            if not less(winner, other):
                loser[node], winner = winner, other
            node >>= 1


def shared_windows(prefixes: list[int], befores: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each of some sorted suffixes, ranges low..high such that its windows low..high bytes before it are also another's.

    prefixes: shared with the suffix before; befores: the bytes before each suffix, backwards.
    """
    found: list[list[tuple[int, int]]] = [[] for _ in befores]
    sets: dict[int, list[tuple[bytes, int]]] = {}
    root = list(range(len(befores)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in sorted(range(1, len(befores)), key=lambda k: -prefixes[k]):
        low = SPAN - prefixes[k]
        if low >= HALF:
            break
        a, b = find(k - 1), find(k)
        one, two = sets.pop(a, None) or [(befores[a], a)], sets.pop(b, None) or [(befores[b], b)]
        if len(one) < len(two):
            one, two = two, one
        for x in two:
            at = bisect_left(one, x)
            for y in one[max(at - 1, 0) : at + 1]:
                high = common_prefix(x[0], y[0])
                if high >= low:
                    found[x[1]].append((low, high))
                    found[y[1]].append((low, high))
            one.insert(at, x)
        root[b] = a
        sets[a] = one
    return found


def _pack(lists: list[bytes]) -> tuple[bytes, bytes]:
    return np.array([len(x) for x in lists], np.uint16).tobytes(), b"".join(lists)


def _unpack(lengths: bytes, joined: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(lengths, np.uint16).astype(np.int64)).tolist()
    return [joined[s:e] for s, e in zip([0, *ends], ends, strict=False)]


RUNS = "part int, items binary, ns binary, lows binary, highs binary, shared binary, rest_lengths binary, rests binary, before_lengths binary, befores binary"
COVERED = "item binary, low int, high int"


def _covered(rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["item", "low", "high"])


def _sorted_runs(splitters: list[bytes]):
    def run(batches):
        held: list[tuple] = []

        def flush():
            held.sort(key=lambda r: r[0])
            edges = [0, *(bisect_left(held, s, key=lambda r: r[0]) for s in splitters), len(held)]
            for part, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
                if e > s:
                    suffixes, befores, items, ns, lows, highs = zip(*held[s:e], strict=True)
                    shared, rests = front_code(suffixes)
                    numbers = [np.array(x, t).tobytes() for x, t in ((ns, np.int64), (lows, np.uint16), (highs, np.uint16), (shared, np.uint16))]
                    row = [part, b"".join(items), *numbers, *_pack(rests), *_pack(befores)]
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if k == 0 else pa.binary()) for k, x in enumerate(row)], [c.split()[0] for c in RUNS.split(", ")])

        for b in small_batches(batches, RUN):
            held += zip(*(b.column(c).to_pylist() for c in ("suffix", "before", "item", "n", "low", "high")), strict=True)
            if len(held) >= RUN:
                yield from flush()
                held = []
        if held:
            yield from flush()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of each range; the ranges come one after another."""

    def close(rows):
        runs, items, ns, lows, highs, befores = [], [], [], [], [], []
        for r in rows:
            runs.append((np.frombuffer(r["shared"], np.uint16).tolist(), _unpack(r["rest_lengths"], r["rests"])))
            items.append([r["items"][k : k + 16] for k in range(0, len(r["items"]), 16)])
            for out, name, kind in ((ns, "ns", np.int64), (lows, "lows", np.uint16), (highs, "highs", np.uint16)):
                out.append(np.frombuffer(r[name], kind).tolist())
            befores.append(_unpack(r["before_lengths"], r["befores"]))
        group, prefixes, out = [], [], []

        def end_group():
            shared = shared_windows(prefixes, [befores[r][k] for r, k in group])
            for (r, k), ranges in zip(group, shared, strict=True):
                low, high = lows[r][k], highs[r][k]
                if ns[r][k] > 1:
                    ranges = [(low, high)]
                for a, b in _joined([(max(a, low), min(b, high)) for a, b in ranges]):
                    out.append((items[r][k], a, b))

        for r, k, _, prefix in merge_runs(runs):
            if prefix < CORE and group:
                end_group()
                group, prefixes = [], []
            group.append((r, k))
            prefixes.append(prefix)
        if group:
            end_group()
        return _covered(out)

    now, rows = None, []
    for b in small_batches(batches, 16):
        for row in b.to_pylist():
            if row["part"] != now and rows:
                yield close(rows)
                rows = []
            now = row["part"]
            rows.append(row)
    if rows:
        yield close(rows)


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges low..high, both included, as few that do not touch; empty ones go."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(r for r in ranges if r[0] <= r[1]):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window hash, item, n, e) of each window of hot items."""
    for b in small_batches(batches, 256):
        out = []
        for r in b.to_pylist():
            text, at = r["before"][::-1] + r["suffix"], len(r["before"])
            out += [(xxhash.xxh3_128_digest(text[at - e : at - e + SPAN]), r["item"], r["n"], e) for e in range(r["low"], r["high"] + 1)]
        cols = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.binary(), pa.int64(), pa.int32()), strict=True)], ["window", "item", "n", "e"])


def covered_windows(contexts: DataFrame) -> DataFrame:
    """(item, low, high): the window starts of each item that are repeated."""
    spark = contexts.sparkSession
    sort = contexts.filter("NOT hot")
    n = sort.count()
    ranges = max(1, -(-n // RANGE))
    splitters = []
    if ranges > 1:
        some = hashed_sample(sort.select(F.substring("suffix", 1, SPLIT_BYTES).alias("s"), "item"), "item", SAMPLE, n).toPandas()["s"]
        some = sorted(bytes(x) for x in some)
        splitters = sorted({some[len(some) * k // ranges] for k in range(1, ranges)})
    runs = sort.select("suffix", "before", "item", "n", "low", "high").mapInArrow(_sorted_runs(splitters), RUNS)
    merged = runs.repartition(max(partitions(spark), len(splitters) + 1), "part").sortWithinPartitions("part").mapInArrow(_merged, COVERED)
    windows = contexts.filter("hot").select("item", "n", "low", "high", "suffix", "before").mapInArrow(_hot_windows, "window binary, item binary, n long, e int")
    again = windows.groupBy("window").agg(F.sum("n").alias("total")).filter("total > 1").select("window")
    # One row for each run of windows, as the merge gives them; a row for each window would meet every place of its item.
    places = windows.join(again, "window").groupBy("item").agg(F.collect_set("e").alias("es"))
    edge = lambda step: F.sort_array(F.filter("es", lambda e: ~F.array_contains(F.col("es"), e + step)))
    hot = places.select("item", F.explode(F.zip_with(edge(-1), edge(1), lambda low, high: F.struct(low.alias("low"), high.alias("high")))).alias("run"))
    return merged.unionByName(hot.select("item", "run.low", "run.high"))


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, text_hash, spans array<struct<start, end>>) of the documents of docs(doc_id, text, text_hash) with repeated bytes."""
    items = materialize(docs.mapInArrow(_items, ITEMS), "suffix-items")
    # As tables of their own these join by a plain exchange on both sides, so Spark can split a core that many items share.
    repeated = materialize(items.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"), "suffix-cores")
    own = materialize(items.join(repeated, "core"), "suffix-repeated")
    discard(items)
    kinds = own.groupBy("core", "item").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "at", "low", "high")).alias("one"))
    hot_cores = materialize(own.groupBy("core").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("core", F.lit(True).alias("hot")), "suffix-hot")
    chosen = kinds.join(hot_cores, "core", "left").select("one.doc_id", "one.text_hash", F.struct("item", "core", "n", F.coalesce("hot", F.lit(False)).alias("hot"), "one.at", "one.low", "one.high").alias("c"))
    by_doc = chosen.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_list("c").alias("chosen"))
    texts = docs.join(by_doc, docs["doc_id"].eqNullSafe(by_doc["__id"]) & (docs["text_hash"] == by_doc["__hash"])).select("text", "chosen")
    contexts = materialize(texts.mapInArrow(_contexts, CONTEXTS), "suffix-contexts")
    # Rows that repeat give the same contexts again; an item's count has them already.
    covered = covered_windows(contexts.dropDuplicates(["item"]) if _repeats(docs) else contexts)
    # An item has one row here, so each of its places gives one row.
    spans = own.join(covered.groupBy("item").agg(F.collect_set(F.struct("low", "high")).alias("runs")), "item")
    spans = spans.select("doc_id", "text_hash", F.transform("runs", lambda r: F.struct((F.col("at") - r["high"]).alias("start"), (F.col("at") - r["low"] + SPAN).alias("end"))).alias("some"))
    return spans.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("some")).alias("spans"))


def _repeats(docs: DataFrame) -> bool:
    """Whether rows share doc_id and text."""
    return docs.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count() > 0


def _cut(text: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """text without its spans, and the number of maximal runs that were cut."""
    runs = _joined([(s["start"], s["end"] - 1) for s in spans or ()])
    kept, at = [], 0
    for low, high in runs:
        kept.append(text[at:low])
        at = high + 1
    return b"".join([*kept, text[at:]]), len(runs)


def deduplicated(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs, all columns, with text as binary without repeated bytes, and n_bytes, n_removed, n_spans added; columns of docs with the added names are replaced.

    Null text is empty. Each row is a document of its own, also when it repeats doc_id or everything. Texts under SPAN bytes stay whole;
    an empty table stays empty. The remaining bytes need not be valid UTF-8.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans")
    rest = [c for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    found = repeated_spans(docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash")), hot)
    found = found.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "spans")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    joined = keyed.join(found, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left").select("row", "text", "spans")

    def run(batches):
        for b in small_batches(batches):
            texts, out, runs = text_bytes(b.column("text")), [], []
            for text, spans in zip(texts, b.column("spans").to_pylist(), strict=True):
                kept, n = _cut(text, spans)
                out.append(kept)
                runs.append(n)
            sizes = np.array(list(map(len, texts)), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.binary()), pa.array(sizes), pa.array(sizes - np.array(list(map(len, out)), np.int64)), pa.array(runs, pa.int64())], ["row", "text", "n_bytes", "n_removed", "n_spans"])

    schema = joined.select("row").schema.add("text", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    columns = ["text" if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return joined.mapInArrow(run, schema).select(*columns, "n_bytes", "n_removed", "n_spans")


def brute_force(texts: list[bytes]) -> list[bytes]:
    """What is left of each text, straight from the definition."""
    starts: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - SPAN + 1):
            w = hashlib.blake2b(t[p : p + SPAN]).digest()
            starts[w] = starts.get(w, 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for p in range(len(t) - SPAN + 1):
            if starts[hashlib.blake2b(t[p : p + SPAN]).digest()] > 1:
                gone[p] += 1
                gone[p + SPAN] -= 1
        out.append(np.frombuffer(t, np.uint8)[np.cumsum(gone)[:-1] == 0].tobytes())
    return out


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))
