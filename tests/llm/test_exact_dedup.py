import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumaframe.llm import exact_dedup

from ..oracle import same


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t, *_ in rows:
        own = groups[lower(t)]
        best = max((x for x in own if x is not None), default=None)
        out.append((i, best, len(own), i == best, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_equals_its_sql(spark, sf):
    same(spark, sf, exact_dedup.op10_exact_dedup, exact_dedup.OP10_SQL)


@pytest.mark.parametrize("width", [32, 1])
def test_edges_and_digest_collisions(edge_docs, edge_rows, width):
    got = [tuple(r) for r in exact_dedup.exact_groups(edge_docs, "largest", width).collect()]
    assert sorted(got, key=str) == brute(edge_rows)


def test_collisions_in_a_larger_table(spark):
    rows = [(k, f"text {k % 700}") for k in range(2000)]
    got = [tuple(r) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "largest", 1).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_memtable_flushes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MEMTABLE", 10)
    rows = [(k, f"text {k % 90}") for k in range(600)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "smallest")
    assert got.filter("kept").count() == 90 and got.agg(F.max("keep_id")).first()[0] == 89


def test_empty(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert exact_dedup.drop_copies(no_docs).columns == no_docs.columns


def test_drop_copies(edge_docs):
    out = exact_dedup.drop_copies(edge_docs)
    assert out.columns == edge_docs.columns
    assert sorted(r[0] for r in out.select("doc_id").collect() if r[0] is not None) == [1, 1, 2, 4, 5, 6, 8, 9, 10, 11, 12]


def test_filter_grows_with_what_repeats(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "CAST(id div 2 AS string) AS text")
    words, width = exact_dedup.repeat_filter(exact_dedup.build_index(docs))
    assert width == 19 and len(words) == 1 << 16
    assert exact_dedup.repeat_filter(exact_dedup.build_index(docs.limit(0)))[1] == exact_dedup.LEAST_BITS
    single = [hashlib.sha256(f"x{k}".encode()).digest() for k in range(2000)]
    assert sum(all(words[x >> 3] >> (x & 7) & 1 for x in exact_dedup._filter_bits(d, width)) for d in single) < 40
