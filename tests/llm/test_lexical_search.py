import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumaframe.llm import lexical_search

from ..oracle import same

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def brute(docs, items, k=10, multiplicity=False):
    tf = [(i, Counter(TERM.findall(lower(t)))) for i, t, *_ in docs]
    n_docs = sum(bool(c) for _, c in tf)
    n_terms = sum(c.total() for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in tf:
            m = 10 + 90 * c.total() * n_docs // n_terms if n_terms else 0
            s = sum((n if multiplicity else 1) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in Counter(TERM.findall(lower(text))).items() if c[t])
            if s:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def found(docs, items, **options):
    return sorted((tuple(r) for r in lexical_search.search(docs, items, **options).collect()), key=str)


def test_query_equals_its_sql(spark, sf):
    same(spark, sf, lexical_search.op11_lexical_search, lexical_search.OP11_SQL)


@pytest.mark.parametrize("multiplicity", [False, True])
def test_edges(edge_docs, edge_rows, benchmark, multiplicity):
    items = [tuple(r) for r in benchmark.collect()]
    assert found(edge_docs, benchmark, multiplicity=multiplicity) == brute(edge_rows, items, multiplicity=multiplicity)


def test_blocks_of_items_pieces_and_small_products(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    docs = [(int(rng.integers(0, 400)), " ".join(rng.choice(words, rng.integers(0, 40)))) for _ in range(500)]
    items = [(f"i{k}", " ".join(rng.choice(words, 12)) + " Élan") for k in range(30)]
    for name, small in (("PIECE", 16), ("PRODUCTS", 50), ("CELLS", 200), ("BLOCK_CHARS", 300)):
        monkeypatch.setattr(lexical_search, name, small)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert found(frame, spark.createDataFrame(items, "item_id string, text string"), k=3, multiplicity=True) == brute(docs, items, 3, True)


def test_ties_go_to_small_ids_and_repeated_rows_rank_alone(spark):
    docs = spark.createDataFrame([(k, "same words here") for k in (9, 4, 4, 7, None, 1)] + [(100, "other"), (101, None)], "doc_id long, text string").repartition(4)
    got = lexical_search.search(docs, spark.createDataFrame([(1, "Words")], "item_id int, text string"), k=6).orderBy("rank").collect()
    assert [(r["rank"], r["doc_id"]) for r in got] == [(1, 1), (2, 4), (3, 4), (4, 7), (5, 9), (6, None)]
    assert len({r["score"] for r in got}) == 1


def test_a_common_term_in_a_third_of_all_rows(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, concat('the hot ', CAST(id AS string)), concat('cold ', CAST(id AS string))) AS text").repartition(7)
    got = lexical_search.search(docs, spark.createDataFrame([(1, "hot 2997"), (2, "cold")], "item_id int, text string"))
    per = defaultdict(list)
    for r in got.orderBy("item_id", "rank").collect():
        per[r["item_id"]].append(r["doc_id"])
    assert per[1] == [2997, 0, 3, 6, 9, 12, 15, 18, 21, 24] and per[2] == [1, 2, 4, 5, 7, 8, 10, 11, 13, 14]


def test_empty(no_docs, edge_docs, benchmark):
    assert lexical_search.search(no_docs, benchmark).count() == 0
    assert lexical_search.search(edge_docs, benchmark.limit(0)).count() == 0


def test_ids_must_be_integers(spark, benchmark):
    with pytest.raises(ValueError, match="doc_id must be an integer"):
        lexical_search.search(spark.createDataFrame([("a", "x")], "doc_id string, text string"), benchmark)
