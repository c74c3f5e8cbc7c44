import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumaframe.llm import suffix_dedup as sd

from .conftest import prose


def n_runs(text, texts):
    """Maximal runs of bytes that repeated strings cover."""
    starts = Counter(t[p : p + sd.SPAN] for t in texts for p in range(len(t) - sd.SPAN + 1))
    covered = set()
    for p in range(len(text) - sd.SPAN + 1):
        if starts[text[p : p + sd.SPAN]] > 1:
            covered.update(range(p, p + sd.SPAN))
    return sum(k - 1 not in covered for k in covered)


def check(docs, rows, **options):
    left = sd.brute_force([(t or "").encode() for _, t, *_ in rows])
    runs = [n_runs((t or "").encode(), [(u or "").encode() for _, u, *_ in rows]) for _, t, *_ in rows] if len(rows) < 20 else None
    if runs:
        assert sorted(((r["doc_id"], r["n_spans"]) for r in sd.deduplicated(docs, **options).collect()), key=str) == sorted(((r[0], n) for r, n in zip(rows, runs, strict=True)), key=str)
    want = sorted(((i, len((t or "").encode()), len((t or "").encode()) - len(x), hashlib.sha256(x).hexdigest()) for (i, t, *_), x in zip(rows, left, strict=True)), key=str)
    got = sd.deduplicated(docs, **options)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", F.sha2("text", 256)).collect()), key=str) == want


@pytest.mark.parametrize("hot", [20_000, 0])
def test_edges(edge_docs, edge_rows, hot):
    short = [r for r in edge_rows if len(r[1] or "") < 50_000]
    check(edge_docs.filter("text IS NULL OR length(text) < 50000"), short, hot=hot)


def test_empty(no_docs):
    assert sd.deduplicated(no_docs).count() == 0


def spliced():
    """Texts that share passages just under, at and over the span, overlapping and nested, in one text and across."""
    rng, base = random.Random(3), prose(100, 400)
    out = []
    for k in range(60):
        parts = [prose(200 + k, rng.randint(5, 60))]
        for _ in range(rng.randint(0, 3)):
            at, n = rng.randint(0, len(base) - 900), rng.choice([300, 399, 400, 401, 450, 600, 900])
            parts += [base[at : at + n], prose(300 + rng.randint(0, 40), rng.randint(1, 40))]
        out.append((k, "".join(parts)))
    out += [(60, out[3][1]), (61, out[3][1][:-1] + "~"), (62, "ab" * 900), (63, "é" * 500), (64, base[:400]), (65, None)]
    return out


@pytest.mark.parametrize(("hot", "run", "span"), [(20_000, 20_000, 40_000), (20_000, 7, 10), (3, 50, 40)])
def test_spliced_passages(spark, monkeypatch, hot, run, span):
    monkeypatch.setattr(sd, "RUN", run)
    monkeypatch.setattr(sd, "RANGE", span)
    rows = spliced()
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, hot=hot)


def test_items_hold_every_window_once():
    text = prose(1, 800).encode()
    starts = [a - e for a, low, high in zip(*(x.tolist() for x in sd.items_of(text)), strict=True) for e in range(low, high + 1)]
    assert sorted(starts) == list(range(len(text) - sd.SPAN + 1))


texts = st.lists(st.binary(max_size=12).map(lambda b: bytes(c % 3 + 97 for c in b)), max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(texts, max_size=9))
def test_loser_tree_merges(runs):
    coded = [sd.front_code(sorted(r)) for r in runs]
    got = list(sd.merge_runs(coded)) if runs else []
    flat = sorted(x for r in runs for x in r)
    assert [g[2] for g in got] == flat
    assert [g[3] for g in got][1:] == [sd.common_prefix(a, b) for a, b in zip(flat, flat[1:], strict=False)]
    assert sorted((g[0], g[1]) for g in got) == sorted((k, j) for k, r in enumerate(runs) for j in range(len(r)))


def test_known_prefixes_are_never_compared_again(monkeypatch):
    seen = []
    real = sd.common_prefix
    runs = [sd.front_code(sorted((b"p" * 300 + bytes([97 + (k * 7 + j) % 26]) for j in range(9)))) for k in range(8)]
    monkeypatch.setattr(sd, "common_prefix", lambda a, b, known=0: seen.append((known, real(a, b, known))) or real(a, b, known))
    assert len(list(sd.merge_runs(runs))) == 72
    assert sum(1 for known, _ in seen if known < 300) < 8  # the first tournament alone


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=10), st.randoms())
def test_shared_windows_against_pairs(shape, rng):
    """Suffixes that differ late and bytes before that differ early."""
    items = sorted((bytes([97]) * (sd.SPAN - 10 + 3 * a) + bytes([98 + rng.randint(0, 2)]) * 20, bytes([97]) * (4 + 3 * b) + bytes([98 + rng.randint(0, 2)]) * 20) for a, b in shape)
    prefixes = [0] + [sd.common_prefix(x[0], y[0]) for x, y in zip(items, items[1:], strict=False)]
    got = sd.shared_windows(prefixes, [b for _, b in items])
    for k, (s, b) in enumerate(items):
        want = {e for j, (t, c) in enumerate(items) if j != k for e in range(sd.HALF) if sd.common_prefix(s, t) >= sd.SPAN - e and sd.common_prefix(b, c) >= e}
        assert {e for low, high in got[k] for e in range(max(low, 0), high + 1) if e < sd.HALF} == want


def test_query_on_the_table(spark, sf):
    rows = sorted((r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    left = sd.brute_force([t for _, t in rows])
    got = sorted(tuple(r) for r in sd.op3_suffix_dedup(spark, sf).drop("n_spans").collect())
    assert got == [(i, len(t), len(t) - len(k), hashlib.sha256(k).hexdigest()) for (i, t), k in zip(rows, left, strict=True)] and any(r[2] for r in got)


def test_anchors_of_long_texts_in_pieces(monkeypatch):
    text = np.random.default_rng(0).integers(97, 101, 20_000).astype(np.uint8).tobytes()
    whole = sd._window_anchors(text)
    for chunk in (1, 401, 5000, 20_000 - sd.SPAN + 1):
        monkeypatch.setattr(sd, "CHUNK", chunk)
        assert chunk == 1 or np.array_equal(sd._window_anchors(text), whole)
    monkeypatch.setattr(sd, "CHUNK", 1)
    assert np.array_equal(sd._window_anchors(text[:900]), whole[: 900 - sd.SPAN + 1])


def test_hot_items_give_runs_of_windows(spark, monkeypatch):
    """A passage among different words, counted by hash: an item has one row for its windows side by side, not one for each window."""
    passage, met = prose(77, 150)[:600], []
    rows = [(k, f"{prose(8000 + k, 30)} {passage} {prose(8100 + k, 30)}") for k in range(12)]
    monkeypatch.setattr(sd, "covered_windows", lambda *a, f=sd.covered_windows: met.append(f(*a)) or met[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, rows, hot=0)
    per_item = Counter(bytes(r["item"]) for r in met[-1].collect())
    assert per_item and max(per_item.values()) == 1
