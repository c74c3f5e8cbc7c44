import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lumaframe.llm import token_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(got, rows, library):
    at, want = 0, []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    key = lambda r: (r[1], r[2])
    assert sorted((r[0], r[2], r[3]) for r in got if r[0] is not None) == sorted((r[0], r[2], r[3]) for r in want if r[0] is not None)
    ends = sorted((r[1], r[1] + r[2]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False)) and ends[-1][1] == at
    assert [r[0] for r in sorted(got, key=key)] == [r[0] for r in sorted(want, key=key)]


def test_edges(edge_docs, edge_rows, library):
    check([tuple(r) for r in token_ids.encoded(edge_docs, PATH).collect()], edge_rows, library)


def test_table(spark, sf, library):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in token_ids.op4_token_ids(spark, sf).collect()]
    check(got, rows, library)


def test_empty(no_docs):
    assert token_ids.encoded(no_docs, PATH).count() == 0


def test_word_coder_is_the_library(library):
    texts = ["a  b<|endoftext|>c  x y éz É\x1cq I'M it's", "the. THE, 's. a.. .a ,", "\x01 q\x01", "", " \t\n\v\f\r ", "<|STARTOFTEXT|> <|startoftext|>", "ﬁ Å ÅÅ ẞ İ 10,000.5 ａ", "a̸ ≮ .́ a.́", "é, ß. ÿ"]
    ids, counts = token_ids.WordCoder(PATH).encode(pa.array([*texts, None]), 2)
    want = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in [*texts, ""]]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_cache_starts_anew(monkeypatch, library):
    monkeypatch.setattr(token_ids, "CACHE", 5)
    coder = token_ids.WordCoder(PATH)
    for text in ("one two three four five six", "seven one eight", "one nine"):
        assert coder.encode(pa.array([text]), 2)[0].tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("n", [1, 2, 3, 255, 256, 257, 5000])
def test_pack_and_unpack(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 3000).astype(np.int64)
    found, counts = np.unique(ids, return_counts=True)
    lengths = token_ids.code_lengths(counts)
    order = np.argsort(lengths, kind="stable")
    found, lengths = found[order], lengths[order]
    code, size = np.zeros(3000, np.int64), np.zeros(3000, np.int64)
    code[found], size[found] = token_ids.canonical(lengths), lengths
    bits, starts = token_ids.pack(code[ids], size[ids])
    repeat = 1 << (token_ids.LIMIT - lengths)
    table, sizes = np.zeros(1 << token_ids.LIMIT, np.uint32), np.zeros(1 << token_ids.LIMIT, np.int64)
    table[: repeat.sum()], sizes[: repeat.sum()] = np.repeat(found, repeat), np.repeat(lengths, repeat)
    assert token_ids.unpack(bits, starts[:: token_ids.STRIDE], n, table, sizes).tolist() == ids.tolist()


def test_code_lengths_are_limited_and_best():
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    for limit in (6, 10, 18):
        lengths = token_ids.code_lengths(np.array(fib), limit)
        assert lengths.max() <= limit and sum(2.0**-lengths) == 1
    assert token_ids.code_lengths(np.array([1, 1, 2, 4])).tolist() == [3, 3, 2, 1]
    with pytest.raises(ValueError):
        token_ids.code_lengths(np.ones(9), 3)


def test_byte_level_alphabet():
    assert len(set(token_ids.BYTE_LEVEL.values())) == 256 and token_ids.BYTE_LEVEL[0x20] == "Ġ" and token_ids.BYTE_LEVEL[0x41] == "A"
