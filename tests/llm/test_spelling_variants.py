import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumaframe.llm import spelling_variants as sv

from ..oracle import same

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counted(docs):
    n = Counter()
    for i, t, *_ in docs:
        for w in RUN.findall(t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute(docs):
    n = counted(docs)
    cut = defaultdict(set)
    for w in n:
        for part in {w[:3], w[-3:]}:  # one of the two is untouched, whichever letter differs
            cut[part].add(w)
    near = {w: [x for x in cut[w[:3]] | cut[w[-3:]] if x != w and distance_one(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out)


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_query_equals_its_sql(spark, sf):
    same(spark, sf, sv.op13_spelling_variants, sv.OP13_SQL)


def test_edges(edge_docs, edge_rows):
    assert rows(sv.spelling_variants(edge_docs)) == brute(edge_rows)


@settings(max_examples=400, deadline=None)
@given(st.text("abé", min_size=7, max_size=12), st.data())
def test_near_words_share_a_key(word, data):
    """Words of few letters, so that bigrams repeat; any order of bigrams."""
    at = data.draw(st.integers(0, len(word) - 1))
    kind = data.draw(st.sampled_from("idr"))
    letter = data.draw(st.sampled_from("abcé"))
    other = word[:at] + (letter if kind != "d" else "") + word[at + (kind != "i") :]
    grams = sorted({w[k : k + 2] for w in (word, other) for k in range(len(w) - 1)})
    order = {g: k for k, g in enumerate(data.draw(st.permutations(grams)))}
    if len(other) >= 7 and distance_one(word, other):
        assert {*sv.join_keys(word, order)} & {*sv.join_keys(other, order)}


def test_pairs_of_random_words(spark):
    import random

    rng = random.Random(4)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randint(7, 9))) for _ in range(400)}
    words |= {w[:k] + rng.choice("abcdef") + w[k + rng.randint(0, 1) :] for w in list(words) for k in (0, 3, len(w) - 1)}
    words = sorted(w for w in words if len(w) >= 7)
    got = {(r["word"], r["other"]) for r in sv.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and distance_one(a, b)}


def test_chains_of_forms_end_at_the_last(spark):
    counts = {"anderlecht": 40_000, "anderlech": 4_000, "anderleck": 400, "anderlec": 4, "enderleck": 40, "unrelated": 9}
    docs = [(k, f"{w} " * n) for k, (w, n) in enumerate(counts.items())]
    assert all(zlib.crc32(f"{k}:{w}".encode()) % 31 for k, w in enumerate(counts))
    got = {r["word"]: (r["form"], r["root"], r["form_n"]) for r in sv.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows(sv.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    assert got["enderleck"] == ("anderleck", "anderlecht", 400) and got["unrelated"] == (None, "unrelated", None)


def test_counts_leave_tasks_in_parts(spark, monkeypatch, edge_docs, edge_rows):
    monkeypatch.setattr(sv, "TABLE", 5)
    assert {r["word"]: r["n"] for r in sv.count_words(edge_docs).collect()} == counted(edge_rows)


def test_a_word_in_a_third_of_all_rows(spark):
    docs = [(k, "everywhere hereabouts" if k % 3 == 0 else f"nothing{'abcdefgh'[k % 8]} {k}") for k in range(600)]
    assert rows(sv.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))) == brute(docs)


def test_letters_beyond_latin_1_part_words(spark):
    docs = [(k, "straßenbahn ÉCOLIERS×écoliers Łukaszewicz naïveté́ STRASSENBAHN") for k in range(3)]
    assert rows(sv.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_empty(no_docs):
    assert sv.spelling_variants(no_docs).count() == 0


@pytest.mark.parametrize("text", [None, "", "short words are not one"])
def test_texts_without_words(spark, text):
    assert sv.spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 0
