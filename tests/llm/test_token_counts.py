import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumaframe.llm import token_counts

from .conftest import prose

BYTES = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(BYTES)
COUNTER = token_counts.TokenCounter(BYTES)


def expected(texts, library=LIBRARY):
    return [len(x) for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def plain(docs, library=LIBRARY):
    return sorted(((i, len((t or "").encode()), n) for (i, t, *_), n in zip(docs, expected([r[1] for r in docs], library), strict=True)), key=str)


HOSTILE = st.text(st.sampled_from(list(" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 ᠎ ​ 　﻿abz'sdTll!?.,-09é́あ٣²\U0001f600힣<|>")), max_size=40)


@settings(max_examples=1500, deadline=None)
@given(st.lists(HOSTILE, min_size=1, max_size=4))
def test_pieces_give_the_counts_of_whole_texts(texts):
    assert COUNTER.counts(texts) == expected(texts)


def test_special_strings_and_long_texts():
    texts = ["a <|endoftext|> b", "<|endoftext|>" * 3, "x<|endoftext|", prose(3, 60_000), " " * 5000, "=" * 5000, "don't  we'll\n\n  they've"]
    assert COUNTER.counts(texts) == expected(texts)


def test_small_tables_and_stretches(monkeypatch):
    for name, small in (("PIECES", 20), ("PIECE_CHARS", 90), ("STRETCH", 7)):
        monkeypatch.setattr(token_counts, name, small)
    texts = [prose(k, 30) + "  \n two  spaces" for k in range(20)]
    assert token_counts.TokenCounter(BYTES).counts(texts) == expected(texts)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = token_counts.op12_token_counts(spark, sf)
    assert rows(got.drop("over_limit")) == plain([tuple(r) for r in docs])
    assert got.filter("over_limit <> (n_tokens > 512)").count() == 0


def test_edges(edge_docs, edge_rows):
    assert rows(token_counts.token_counts(edge_docs, BYTES)) == plain(edge_rows)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(edge_docs, edge_rows, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        want = plain(edge_rows, Tokenizer.from_file(path))
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        want = sorted(((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t, *_ in edge_rows), key=str)
    assert rows(token_counts.token_counts(edge_docs, path)) == want


def test_equal_content_has_equal_counts():
    path = public_tokenizers.path("word_bpe_49k.json")
    counter, library = token_counts.TokenCounter(path), Tokenizer.from_file(path)
    assert counter.content("Big  WORDS\n") == counter.content("big words ")
    mixed = ["<|ENDOFTEXT|>", "<|endoftext|>", "a <|EndOfText|>"]
    assert len({counter.content(t) for t in mixed}) == 3 and counter.counts(mixed) == expected(mixed, library)


def cached(spark, folder):
    return {bytes(r["digest"]): r["n_tokens"] for r in spark.read.schema(token_counts.CACHE_SCHEMA).parquet(folder).collect()}


def test_cache_is_read_and_appended_to(spark, tmp_path):
    cache = str(tmp_path / "cache")
    first = [(k, prose(k % 40, 30)) for k in range(100)]
    frame = spark.createDataFrame(first, "doc_id long, text string").repartition(3)
    assert rows(token_counts.token_counts(frame, BYTES, cache)) == plain(first)
    assert spark.read.parquet(cache).count() == 40
    # Stored counts are trusted: a changed one comes back, so known texts aren't encoded again.
    changed = spark.read.parquet(cache).withColumn("n_tokens", F.col("n_tokens") + 1000)
    other = str(tmp_path / "other")
    changed.write.parquet(other)
    more = [(k, prose(k % 55, 30)) for k in range(200)]
    frame = spark.createDataFrame(more, "doc_id long, text string").repartition(5)
    want = sorted(((i, b, n + 1000 * (i % 55 < 40)) for i, b, n in plain(more)), key=str)
    assert rows(token_counts.token_counts(frame, BYTES, other)) == want
    assert spark.read.parquet(other).count() == 55 and len(cached(spark, other)) == 55
    # All known: nothing is appended.
    assert rows(token_counts.token_counts(frame, BYTES, other)) == want and spark.read.parquet(other).count() == 55


def test_another_tokenizer_misses(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = [(k, prose(k, 20)) for k in range(10)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    token_counts.token_counts(frame, BYTES, cache)
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = token_counts.token_counts(frame, path, cache)
    assert spark.read.parquet(cache).count() == 20 and got.count() == 10
    assert token_counts.tokenizer_version(path) != token_counts.tokenizer_version(BYTES)


def test_filters_that_hold_everything(spark, monkeypatch, tmp_path):
    """Filters so full that all digests pass: texts travel, each distinct miss is still encoded once and counts are right."""
    import numpy as np

    monkeypatch.setattr(token_counts, "digest_filter", lambda digests: (np.full(1 << 13, 255, np.uint8), 16))
    cache = str(tmp_path / "cache")
    docs = [(k, prose(k % 30, 30)) for k in range(90)]
    token_counts.token_counts(spark.createDataFrame(docs[:20], "doc_id long, text string"), BYTES, cache)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert rows(token_counts.token_counts(frame, BYTES, cache)) == plain(docs)
    assert spark.read.parquet(cache).count() == 30


def test_two_writers_of_one_digest(spark, tmp_path):
    cache = str(tmp_path / "cache")
    docs = [(1, "one two"), (2, "three")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    token_counts.token_counts(frame, BYTES, cache)
    twice = [tuple(r) for r in spark.read.parquet(cache).collect()]
    spark.createDataFrame(twice, token_counts.CACHE_SCHEMA).write.mode("append").parquet(cache)
    assert rows(token_counts.token_counts(frame, BYTES, cache)) == plain(docs)


def test_string_ids_and_empty(spark, no_docs):
    frame = spark.createDataFrame([("a", "x y"), ("b", None)], "doc_id string, text string")
    assert rows(token_counts.token_counts(frame, BYTES)) == [("a", 3, 2), ("b", 0, 0)]
    assert token_counts.token_counts(no_docs, BYTES).count() == 0


def test_whitespace_rule_covers_what_engines_disagree_on():
    for c in map(chr, [*range(0x250), *range(0x1680, 0x1690), *range(0x180B, 0x180F), *range(0x2000, 0x2070), 0x3000, 0xFEFF]):
        for text in (f"a{c} b", f"!{c}b", f"a {c} {c}b", f"{c}{c} !"):
            assert COUNTER.counts([text]) == expected([text]), hex(ord(c))


def test_pieces_end_where_the_library_cuts():
    """Words share a piece whatever sign follows; a random mix of letters, signs, marks and contractions counts as the library counts it."""
    rng = random.Random(1)
    parts = ["a", "Z", "é", "ß", "中", "\u0301", "1", "٣", "²", "'", "'s", "'ll", "'LL", "!", "._", "-", "\x01", "\x7f", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u3000", "“", "…", "😀", "ſ", "don't", "12", "\u00ad"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(20_000)]
    counter = token_counts.TokenCounter(BYTES)
    assert counter.by_piece and counter.counts(texts) == expected(texts)
    counter = token_counts.TokenCounter(BYTES)
    counter.counts(["of word, word. word; word) word12 word!"])
    assert set(counter.pieces) == {"of", " word", ",", ".", ";", ")", "12", "!"}
