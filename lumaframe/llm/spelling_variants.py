"""Groups of spelling variants: words within one edit of each other, found by a rare-first prefix filter on positional bigrams.

One edit touches two bigrams of a word at most, so of its three rarest in one global order (rarest first, equal bigrams by place) one stays
whole, and near words share one that is among the three rarest of both, at places that differ by one at most. The edit then lies wholly
to the right of it, and all up to the bigram is equal, or wholly to the left, and all from the bigram on is equal. So words meet on a bigram with that
equal side as an equi-join. Where the equal side is short, half of the other side is equal too and joins the key.
Candidates are verified by their edit distance.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.llm.common import LOWER, UPPER, discard, documents, materialize, small_batches

#: Fewest code points of a word (it needs three bigrams and more than two edits' worth of text), and fewest occurrences.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form has so many times the occurrences of its variant.
RATIO = 10
#: One in so many spellings of a document is varied.
VARIED = 31
#: Different words of a task before their counts are sent (some 150 bytes each).
TABLE = 300_000
#: Bigrams of a word that are joined, and code points of an equal side from which it is the whole key.
RAREST, LONG_SIDE = 3, 6

#: Letters in Latin-1, A-Z become a-z; all else is a space. Code points beyond Latin-1 come as "?".
LETTER_BYTES = bytes(b if b >= 0xC0 or chr(b).isalpha() and b < 0x80 else 0x20 for b in range(256)).lower()


def varied_words(doc_id: int | None, text: str | None) -> Counter[bytes]:
    """The words of a text in Latin-1 with their occurrences, after the deletions that crc32 of doc_id and word asks for."""
    found = Counter(w for w in (text or "").encode("latin-1", "replace").translate(LETTER_BYTES).split() if len(w) >= LEAST_LENGTH)
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter[bytes] = Counter()
    for word, n in found.items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), head)
        if h % VARIED == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < LEAST_LENGTH:
                continue
        out[word] += n
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of docs(doc_id, text) that are long and frequent enough."""

    def count(batches):
        table: Counter[bytes] = Counter()

        def flush():
            words = pa.array([w.decode("latin-1") for w in table], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(table.values()), pa.int64())], ["word", "n"])

        for b in small_batches(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                table.update(varied_words(doc_id, text))
            if len(table) > TABLE:
                yield flush()
                table.clear()
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _bigram_order(words: DataFrame) -> dict[str, int]:
    """The place of each bigram, rarest first. Letters are 90 different code points, so there are 8,100 bigrams at most."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select(F.explode(F.transform(places, lambda p: F.substring(F.col("word"), p, F.lit(2)))).alias("gram"))
    return {r["gram"]: k for k, r in enumerate(sorted(grams.groupBy("gram").count().collect(), key=lambda r: (r["count"], r["gram"])))}


def join_keys(word: str, order: dict[str, int]) -> Iterator[str]:
    """The keys on which a word meets all words within one edit of it.

    A key names the side that is equal with its bigram at the end of it. A short side also names the shorter length of the two words and
    one of the halves of what remains of that word; a word stands once for the shorter or equal one and once for the longer one.
    """
    size = len(word)
    for at in sorted(range(size - 1), key=lambda p: (order[word[p : p + 2]], word[p : p + 2], p))[:RAREST]:
        for side, same, rest in (("<", word[: at + 2], word[at + 2 :]), (">", word[at:], word[:at])):
            if len(same) >= LONG_SIDE:
                yield f"{side}{at + 2 if side == '<' else size - at} {word[: at + 2] if side == '<' else word[at:]}"
                continue
            for shorter in {len(rest), len(rest) - 1}:
                half = shorter // 2
                yield f"{side}{shorter} {same} {rest[:half]}-"
                yield f"{side}{shorter} {same} -{rest[len(rest) - (shorter - half) :]}"


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n), both ways round, for the pairs of words(word, n) that are one edit apart.

    Words have LEAST_LENGTH code points or more and stand once; their letters are those of varied_words().
    """
    shared = words.sparkSession.sparkContext.broadcast(_bigram_order(words))

    def keyed(batches):
        order = shared.value
        for b in small_batches(batches, 4096):
            keys = [list(dict.fromkeys(join_keys(w, order))) for w in b.column("word").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays([pa.array([k for some in keys for k in some], pa.string()), b.column("word").take(at), b.column("n").take(at)], ["key", "word", "n"])

    # Keys are compared by their hashes; what meets by chance fails the verification.
    keys = materialize(words.mapInArrow(keyed, "key string, word string, n long").select(F.xxhash64("key").alias("key"), "word", "n"), "spelling-keys")
    other = keys.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = keys.join(other, "key").filter((F.col("word") < F.col("other")) & (F.abs(F.length("word") - F.length("other")) <= 1))
    pairs = materialize(met.filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").dropDuplicates(["word", "other"]), "spelling-pairs")
    discard(keys)
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): the last form that a chain of them reaches, by doubling. n grows tenfold at each step, so chains end."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        new = materialize(onward.select("word", F.coalesce("next", "root").alias("root"), F.isnotnull("next").alias("moved")), "spelling-roots")
        discard(now)
        if not new.filter("moved").limit(1).count():
            return new.select("word", "root")
        now = new


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row for each word of docs(doc_id, text): word, form, root, n, n_near, form_n.

    Words are runs of Latin letters, varied as varied_words() says, of LEAST_LENGTH code points and LEAST_COUNT occurrences or more. form is
    the near word (one insertion, deletion or replacement away) of most occurrences, the smallest of equals, if it has RATIO times those of
    the word; form_n its occurrences; root the end of the chain of forms. Null and empty texts have no words, a null doc_id counts as an
    empty one. Rows that repeat each count; doc_id may have any type that prints. An empty table gives no rows; texts of any length
    count whole; other columns are ignored.
    """
    words = materialize(count_words(docs), "spelling-words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("best")
    near = materialize(near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"), best), "spelling-near")
    form = F.when(-F.col("best.n") >= RATIO * F.col("n"), F.struct("best.form", (-F.col("best.n")).alias("form_n"))).alias("found")
    near = near.select("word", "n_near", form).select("word", "n_near", "found.form", "found.form_n")
    roots = _roots(near.filter("form IS NOT NULL"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


OP13_SQL = rf"""
WITH RECURSIVE steps AS (SELECT i, list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i) AS v FROM range(256) r(i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM steps),
runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY doc_id, w),
hashed AS (SELECT w, n, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295)) AS h FROM runs, crc),
varied AS (SELECT CASE WHEN h % 31 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM varied WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM words, unnest(range(1, length(word) + 1)) r(i)),
near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM words a JOIN gaps b ON a.word = b.rest
  UNION SELECT a.word, a.n, b.word, b.n FROM gaps a JOIN words b ON b.word = a.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n, any_value(n) AS n FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT word, form, form_n FROM best WHERE form_n >= 10 * n),
chain AS (SELECT word, form AS node, 1 AS k FROM forms UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.node),
roots AS (SELECT word, arg_max(node, k) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, words.n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN (SELECT word, n_near FROM best) USING (word) LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)
"""
