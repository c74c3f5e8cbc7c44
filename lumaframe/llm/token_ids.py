"""Token ids in binary blocks, packed by a canonical length-limited Huffman code.

A dataset is a folder with two tables. `codes` has one row: the id symbols that occur, in canonical order, and their code
lengths (package-merge over counts of the whole corpus). `blocks` has rows (shard, block, start, doc_ids, doc_tokens, bits,
checkpoints): whole documents in ascending doc_id order, at least BLOCK ids a block unless a shard ends, MSB-first codes in
`bits`, and the bit offset of every STRIDE-th id in `checkpoints`. Blocks decode alone: all their checkpoints advance together,
one table look-up an id. `start` counts the ids of the shard before the block; shards are ordered by number.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.llm.common import discard, documents, materialize, new_path, partitions, small_batches

#: Longest code in bits; the decoding table has 2^LIMIT entries.
LIMIT = 18
BLOCK = 1 << 16
STRIDE = 256
#: Words whose ids a Python worker keeps at hand (about 150 bytes each); then it starts anew.
CACHE = 400_000
#: Words of lower-case Latin letters that no normalizer changes.
PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: Stands between words that are encoded together.
MARK = "\x01"


def _byte_level() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_LEVEL = _byte_level()


class WordCoder:
    """Ids of texts by a tokenizers file that lower-cases text and splits it at white space and at the ends of runs of letters.

    Each distinct word between ASCII white space is encoded by the library once and its ids are reused, which gives the ids of the whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Ids as stored until they are packed.
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.pool, self.start, self.size = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        # Lower-case Latin letters alone pass through normalizer and pre-tokenizer as they are: they go straight to the merges.
        plain, other, merge = [], [], self.tokenizer.model.tokenize
        for w in new:
            (plain if PLAIN.fullmatch(w) else other).append(w)
        got = [[t.id for t in merge(w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_LEVEL))] for w in plain]
        self._add(plain, np.fromiter(chain.from_iterable(got), self.dtype), np.fromiter(map(len, got), np.int64, len(got)))
        self._add(other, *self._encode(other))

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of the words at these places, one after another."""
        size = self.size[at]
        return self.pool[np.repeat(self.start[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, one after another, and their number for each word; words are encoded in runs with MARK between them."""
        runs, (mark,) = [], self.tokenizer.encode(MARK, add_special_tokens=False).ids
        marked = {i for i, w in enumerate(words) if MARK in w}
        for at in range(0, len(words), 500):
            runs.append(f" {MARK} ".join("" if i in marked else words[i] for i in range(at, min(at + 500, len(words)))) + f" {MARK}")
        ids = np.concatenate([np.zeros(0, self.dtype), *(np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False))])
        ends = np.flatnonzero(ids == mark)
        ids, size = np.delete(ids, ends), np.diff(ends, prepend=-1) - 1
        for i in sorted(marked):
            own = self.tokenizer.encode(words[i], add_special_tokens=False).ids
            ids, size[i] = np.insert(ids, size[:i].sum(), np.array(own, self.dtype)), len(own)
        return ids, size

    def _add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.pool = np.concatenate((self.pool, ids))
        at = len(self.index)
        self.index.update(zip(words, range(at, at + len(words)), strict=True))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, each text's followed by end_id; and the number of ids of each text."""
        texts = texts.cast(pa.string()).fill_null("")
        # Special tokens are found before letters are lower-cased.
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        words = split.flatten().dictionary_encode()
        # A letter before a final . or , ends a run of letters, so such a word's ids are those of its parts.
        tailed = pc.match_substring_regex(words.dictionary, "[a-z][.,]$")
        parts = pa.concat_arrays([pc.if_else(tailed, pc.utf8_slice_codeunits(words.dictionary, 0, -1), words.dictionary), pc.if_else(tailed, pc.utf8_slice_codeunits(words.dictionary, -1), "")]).dictionary_encode()
        known = parts.dictionary.to_pylist()
        if len(self.index) > CACHE:
            self._reset()
        if new := [w for w in known if w not in self.index]:
            self._learn(new)
        part = np.fromiter(map(self.index.__getitem__, known), np.int64, len(known))[parts.indices.to_numpy()].reshape(2, -1)
        # The words of this batch, and the end id, as runs of ids of their own.
        sizes = np.append(self.size[part].sum(0), 1)
        run = np.append(self._gather(part.T.ravel()), np.array(end_id, self.dtype))
        per_text = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
        at = np.insert(words.indices.to_numpy().astype(np.int64), per_text, len(sizes) - 1)
        size = sizes[at]
        ends = np.cumsum(size)
        ids = run[np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - size), size) + np.arange(int(size.sum()))]
        return ids, np.diff(np.concatenate(([0], ends[per_text + np.arange(len(per_text))])))


@lru_cache(1)
def word_coder(path: str) -> WordCoder:
    """The Python worker's own coder, kept from task to task."""
    return WordCoder(path)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of the best prefix code of positive counts in which none is above limit (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of over {limit} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64)
    leaves, row = [np.ones(n, bool)], weights
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        row = np.concatenate((weights, pairs))
        by = np.argsort(row, kind="stable")
        row = row[by]
        leaves.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(leaves):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of lengths that do not fall: each is the one before plus one, widened to its length."""
    steps = np.left_shift(np.int64(1), LIMIT - lengths)
    return (np.cumsum(steps) - steps) >> (LIMIT - lengths)


def pack(codes: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes' bits one after another, and the bit offset of each."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.zeros((int(ends[-1]) + 63 >> 6) + 1, np.uint64)
    word, room = starts >> 6, 64 - (starts & 63) - sizes
    codes = codes.astype(np.uint64)
    here = np.where(room >= 0, codes << np.maximum(room, 0).astype(np.uint64), codes >> np.maximum(-room, 0).astype(np.uint64))
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out[word[first]] = np.bitwise_or.reduceat(here, first)
    over = np.flatnonzero(room < 0)
    out[word[over] + 1] |= codes[over] << (64 + room[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: int(ends[-1]) + 7 >> 3], starts


def unpack(bits: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The n symbols of a block; table and sizes: of each LIMIT-bit look-ahead."""
    raw = np.frombuffer(bits + bytes(4), np.uint8).astype(np.uint32)
    ahead = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at, lanes = checkpoints.astype(np.int64), len(checkpoints)
    out = np.empty((STRIDE, lanes), np.uint32)
    tail = n - STRIDE * (lanes - 1)
    for step in range(min(STRIDE, n)):
        if step == tail:
            at, lanes = at[:-1], lanes - 1
        if not lanes:
            break
        peek = ahead[at >> 3] >> (32 - LIMIT - (at & 7)).astype(np.uint32) & ((1 << LIMIT) - 1)
        out[step, :lanes] = table[peek]
        at = at + sizes[peek]
    return out.T.reshape(-1)[:n]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids): ids of the whole text and end_id, little-endian, of as many bytes as the vocabulary needs (2 or 4)."""

    def encode(batches):
        coder = word_coder(tokenizer)
        for b in small_batches(batches, 2048):
            ids, counts = coder.encode(b.column("text"), end_id)
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts), pa.array([ids[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def _stored(ids: list[bytes], counts: list[int]) -> np.ndarray:
    joined = b"".join(ids)
    return np.frombuffer(joined, f"<u{len(joined) // sum(counts)}")


def _count(batches):
    counts = np.zeros(0, np.int64)
    for b in small_batches(batches):
        got = np.bincount(_stored(b.column("ids").to_pylist(), b.column("n_tokens").to_pylist()))
        if len(got) > len(counts):
            counts, got = got, counts
        counts[: len(got)] += got
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["id", "n"])


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write the ids of docs(doc_id, text) as a dataset at path.

    Null text is empty and gives the end id alone. Rows that repeat a doc_id follow one another; a null doc_id comes first. An
    empty table gives a dataset without blocks. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    tokens = materialize(tokenize(docs, tokenizer, end_id), "token-ids")
    counts = tokens.select("ids", "n_tokens").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")  # a row for each id of the vocabulary
    lengths = code_lengths(counts["n"].to_numpy(np.int64))
    order = np.argsort(lengths, kind="stable")
    symbols, lengths = counts["id"].to_numpy(np.int64)[order], lengths[order]
    spark.createDataFrame([(symbols.tolist(), lengths.tolist())], "symbols array<long>, lengths array<long>").coalesce(1).write.parquet(f"{path}/codes")
    code, size = np.zeros(int(symbols.max(initial=0)) + 1, np.int64), np.zeros(int(symbols.max(initial=0)) + 1, np.int64)
    code[symbols], size[symbols] = canonical(lengths), lengths

    def blocks(batches):
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        doc_ids, sizes, parts, held = [], [], [], 0

        def close():
            ids = _stored(parts, sizes)
            bits, starts = pack(code[ids], size[ids])
            row = {"shard": shard, "block": block, "start": start, "doc_ids": list(doc_ids), "doc_tokens": list(sizes), "bits": bits, "checkpoints": starts[::STRIDE].astype(np.uint32).tobytes()}
            return pa.RecordBatch.from_pylist([row], BLOCK_ARROW)

        for b in small_batches(batches):
            for i, n, ids in zip(b.column("doc_id").to_pylist(), b.column("n_tokens").to_pylist(), b.column("ids").to_pylist(), strict=True):
                doc_ids.append(i), sizes.append(n), parts.append(ids)
                held += n
                if held >= BLOCK:
                    yield close()
                    block, start, held = block + 1, start + held, 0
                    doc_ids, sizes, parts = [], [], []
        if parts:
            yield close()

    ordered = tokens.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/blocks")
    discard(tokens)


BLOCK_SCHEMA = "shard int, block int, start long, doc_ids array<long>, doc_tokens array<long>, bits binary, checkpoints binary"
BLOCK_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("bits", pa.binary()), ("checkpoints", pa.binary())])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a dataset; start: ids of all documents before."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    symbols, lengths = (np.array(x, np.int64) for x in spark.read.parquet(f"{path}/codes").first())
    repeat = np.left_shift(np.int64(1), LIMIT - lengths)
    table, sizes = np.zeros(1 << LIMIT, np.uint32), np.zeros(1 << LIMIT, np.int64)
    table[: repeat.sum()], sizes[: repeat.sum()] = np.repeat(symbols, repeat), np.repeat(lengths, repeat)
    shared = spark.sparkContext.broadcast((table, sizes))

    def decode(batches: Iterable[pa.RecordBatch]):
        table, sizes = shared.value
        for b in small_batches(batches, 1):
            row = b.to_pylist()[0]
            counts = np.array(row["doc_tokens"], np.int64)
            ends = np.cumsum(counts)
            ids = unpack(row["bits"], np.frombuffer(row["checkpoints"], np.uint32), int(ends[-1]), table, sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(counts), row["shard"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - counts), pa.array(counts), pa.array([ids[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)], pa.binary())],
                ["shard", "doc_id", "start", "n_tokens", "ids"],
            )

    decoded = blocks.mapInArrow(decode, "shard int, doc_id long, start long, n_tokens long, ids binary")
    # One row for each shard, of which there are at most as many as the writer had shuffle partitions.
    ends = blocks.groupBy("shard").agg(F.sum(F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = ends.selectExpr("shard", "coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    return decoded.join(F.broadcast(before), "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def op4_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return encoded(documents(spark, sf_dir), tokenizer, end_id)


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of docs, read back from a dataset written to the shared folder.

    Null and empty texts are the end id alone; long texts are encoded whole. Rows that repeat a doc_id stand next to each other, those
    without one come first. An empty table gives no rows; other columns are ignored.
    """
    path = new_path(docs.sparkSession, "token-dataset")
    write_ids(docs, path, tokenizer, end_id)
    return read_ids(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
