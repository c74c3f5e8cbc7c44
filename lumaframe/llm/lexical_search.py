"""Ranked lexical search as a blocked sparse matrix product.

The item-term matrix holds how often an item asks for a term, the term-document matrix int64 impacts of a term in a document. Documents
are multiplied in blocks: the rows of the term-document block that an item's terms name are merged into the item's row of scores
(Gustavson), and each block leaves the best k documents of each item. Those meet in two windows, the first one salted by task.
Items come in blocks too, so that what is sent to tasks stays bounded; documents are read twice for each block of items.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lumaframe.llm.common import LOWER, UPPER, documents, integer_ids, partitions, small_batches, text_bytes

#: Characters of items in a block: their terms and counts are broadcast, some 100 bytes a different term.
BLOCK_CHARS = 8_000_000
#: Bytes of a text that are split into terms at a time, products that are expanded at a time, and cells of a dense block of scores.
PIECE, PRODUCTS, CELLS = 1 << 20, 1 << 21, 1 << 21
NO_ID = np.iinfo(np.int64).max

#: A term is a run of digits, A-Z, a-z and all beyond ASCII; the rest becomes a space, A-Z become a-z.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces."""
    data, at = text.translate(TERM_BYTES), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Items:
    """The item-term matrix of a block of items as compressed rows, and the vocabulary of its columns."""

    def __init__(self, rows: list[tuple[object, str | None]], multiplicity: bool):
        counted = [Counter(t for piece in terms((text or "").encode()) for t in piece) for _, text in rows]
        self.ids = [i for i, _ in rows]
        self.vocabulary = {t: k for k, t in enumerate(dict.fromkeys(t for c in counted for t in c))}
        self.start = np.concatenate(([0], np.cumsum([len(c) for c in counted]))).astype(np.int64)
        self.term = np.array([self.vocabulary[t] for c in counted for t in c], np.int64)
        self.count = np.array([n if multiplicity else 1 for c in counted for n in c.values()], np.int64)

    def occurrences(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms of each text with repeats), and term, text and count of each cell of the term-document block, by term."""
        get, sizes, found, owners = self.vocabulary.get, np.zeros(len(texts), np.int64), [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            before = len(found)
            for words in terms(text):
                sizes[k] += len(words)
                found += [t for t in map(get, words) if t is not None]
            owners[k] = len(found) - before
        cells, counts = np.unique(np.array(found, np.int64) * len(texts) + np.repeat(np.arange(len(texts)), owners), return_counts=True)
        return sizes, *np.divmod(cells, max(1, len(texts))), counts

    def scores(self, term: np.ndarray, text: np.ndarray, impact: np.ndarray, n_texts: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first item, dense rows of scores of it and the next ones) of a term-document block sorted by term."""
        first, length = (np.searchsorted(term, self.term, side) for side in ("left", "right"))
        length = length - first
        work = np.concatenate(([0], np.cumsum(length)))[self.start]
        most, at = max(1, CELLS // max(1, n_texts)), 0
        while at < len(self.ids):
            end = min(at + most, max(at + 1, int(np.searchsorted(work, work[at] + PRODUCTS, "right")) - 1))
            entries = slice(self.start[at], self.start[end])
            size, owner = length[entries], np.repeat(np.arange(end - at), np.diff(self.start[at : end + 1]))
            cells = np.repeat(first[entries] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            rows = np.zeros((end - at) * n_texts, np.int64)
            np.add.at(rows, np.repeat(owner * n_texts, size) + text[cells], impact[cells] * np.repeat(self.count[entries], size))
            yield at, rows.reshape(end - at, n_texts)
            at = end


class Best:
    """The k best (score, doc_id) of each item so far; equal scores by ascending doc_id."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, at: int, rows: np.ndarray, ids: np.ndarray) -> None:
        least = self.least[at : at + len(rows)]
        if rows.shape[1] > self.k:
            least = np.maximum(least, np.partition(rows, -self.k, axis=1)[:, -self.k])
        item, place = np.nonzero(rows >= least[:, None])
        if not len(item):
            return
        item, score, doc = (np.concatenate(x) for x in ((self.item, item + at), (self.score, rows[item, place]), (self.doc, ids[place])))
        order = np.lexsort((doc, -score, item))
        item = item[order]
        kept = np.arange(len(item)) - np.searchsorted(item, item) < self.k
        self.item, self.score, self.doc = item[kept], score[order][kept], doc[order][kept]
        full = np.flatnonzero(np.bincount(self.item, minlength=len(self.least)) == self.k)
        self.least[full] = self.score[np.searchsorted(self.item, full, "right") - 1]


def _statistics(docs: DataFrame, items: Items) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms with repeats, and for each term of the items the documents that hold it."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches):
        items, total = shared.value, np.zeros(2, np.int64)
        held = np.zeros(len(items.vocabulary), np.int64)
        for b in small_batches(batches):
            sizes, term, _, _ = items.occurrences(text_bytes(b.column("text")))
            total += (sizes > 0).sum(), sizes.sum()
            held += np.bincount(term, minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], some))), pa.array(np.concatenate((total, held[some])))], ["term", "n"])

    counted = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # a row for each term of the block
    n = dict(zip(counted["term"].tolist(), counted["n"].tolist(), strict=True))
    return n.get(-2, 0), n.get(-1, 0), np.array([n.get(t, 0) for t in range(len(items.vocabulary))], np.int64)


def _block_search(docs: DataFrame, items: Items, item_type: T.DataType, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): the k best of each item and task."""
    n_docs, n_terms, held = _statistics(docs, items)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((items, weights))
    schema = T.StructType().add("item", "long").add("item_id", item_type).add("doc_id", "long").add("score", "long")
    kind = to_arrow_type(item_type)

    def multiply(batches):
        items, weights = shared.value
        best = Best(len(items.ids), k)
        for b in small_batches(batches):
            sizes, term, text, count = items.occurrences(text_bytes(b.column("text")))
            spread = 10 + 90 * sizes * n_docs // max(1, n_terms)
            impact = weights[term] * (1_000_000_000 * count // (1000 * count + 8 * spread[text]))
            ids = b.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()
            for at, rows in items.scores(term, text, impact, b.num_rows):
                best.add(at, rows, ids)
        names = pa.array([items.ids[i] for i in best.item.tolist()], kind)
        yield pa.RecordBatch.from_arrays([pa.array(best.item), names, pa.array(best.doc, mask=best.doc == NO_ID), pa.array(best.score)], schema.names)

    return docs.select("doc_id", "text").mapInArrow(multiply, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 10, multiplicity: bool = False) -> DataFrame:
    """(item_id, rank, doc_id, score): the k rows of docs(doc_id, text) of highest score above 0 for each row of items(item_id, text).

    The score sums, over the item's terms, a term's weight times its saturated frequency in the document, all in 64-bit integers; with
    multiplicity a term counts as often as the item has it, else once. Equal scores rank by ascending doc_id, null last. Null and
    empty texts have no terms: such documents are never found, and such items have no rows. Rows that repeat a doc_id or an item_id are
    documents and items of their own. item_id may have any type, doc_id must be an integer. Empty tables give no rows; texts of any
    length count whole; other columns are ignored.
    """
    docs = integer_ids(docs).select("doc_id", "text")
    blocks = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS) or 1
    item_type = items.schema["item_id"].dataType
    out, salts = None, partitions(docs.sparkSession)
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(blocks)) == block).select("item_id", "text")
        part = _block_search(docs, Items([tuple(r) for r in rows.collect()], multiplicity), item_type, k)
        part = part.select(F.lit(block).alias("block"), "*", (F.spark_partition_id() % salts).alias("salt"))
        out = part if out is None else out.unionByName(part)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    few = out.withColumn("rank", F.row_number().over(Window.partitionBy("block", "item", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("block", "item").orderBy(*order))).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
total AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
i AS (SELECT row_number() OVER () AS item, item_id, list_distinct({_TERMS}) AS terms FROM benchmark),
it AS (SELECT item, unnest(terms) AS term FROM i),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) SEMI JOIN it USING (term) GROUP BY row, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
m AS (SELECT row, doc_id, 100 - 90 + (90 * len(terms)::BIGINT * n_docs) // n_terms AS m FROM d, total WHERE len(terms) > 0),
s AS (SELECT item, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM it JOIN tf USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY item, row),
r AS (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN m USING (row) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r JOIN i USING (item) WHERE rank <= 10
"""
