import hashlib
import pickle
import re

import numpy as np
import pytest

from lumaframe.llm import decontaminate

from ..oracle import same


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(rows, items, window=10):
    out = []
    for i, t, *_ in rows:
        w, hit, found, best = words(t), set(), set(), (0, -1)
        for item, u in items:
            v = words(u)
            n = min(window, len(v))
            for g in {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else ():
                for p in range(len(w) - n + 1):
                    if tuple(w[p : p + n]) == g:
                        hit.update(range(p, p + n))
                        if item is not None:
                            found.add(item)
            for p in range(len(w)) if n else ():
                for j in range(len(v)) if p in hit else ():
                    k = 0
                    while p + k < len(w) and j + k < len(v) and w[p + k] == v[j + k]:
                        k += 1
                    best = (k, p) if k >= n and k > best[0] or k == best[0] > 0 and p < best[1] else best
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit), *best))
    return sorted(out, key=str)


def test_query_equals_its_sql(spark, sf):
    same(spark, sf, decontaminate.op1_decontaminate, decontaminate.OP1_SQL)


def test_edges(edge_docs, edge_rows, benchmark, no_docs):
    items = [tuple(r) for r in benchmark.collect()]
    got = [tuple(r) for r in decontaminate.contamination(edge_docs, benchmark).collect()]
    assert sorted(got, key=str) == brute(edge_rows, items)
    assert decontaminate.contamination(no_docs, benchmark).count() == 0
    assert decontaminate.contamination(edge_docs, benchmark.limit(0)).filter("contaminated").count() == 0


def test_benchmark_in_blocks(edge_docs, edge_rows, benchmark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 250)
    items = [tuple(r) for r in benchmark.collect()]
    assert decontaminate.n_blocks(benchmark) > 5
    got = [tuple(r) for r in decontaminate.contamination(edge_docs, benchmark).collect()]
    assert sorted(got, key=str) == brute(edge_rows, items)


@pytest.mark.parametrize("chars", [8_000_000, 250])
def test_removal_keeps_clean_rows(edge_docs, edge_rows, benchmark, monkeypatch, chars):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
    out = decontaminate.remove_contaminated(edge_docs, benchmark)
    bad = {r[0] for r in brute(edge_rows, [tuple(r) for r in benchmark.collect()]) if r[5]}
    assert out.columns == edge_docs.columns and {(r["__words"], r["__items"], r["size"]) for r in out.collect()} == {(7, 8, "s")}
    assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == sorted(str(r[0]) for r in edge_rows if r[0] not in bad)


def test_longest_matches(spark):
    text = " ".join(f"w{k}" for k in range(100))
    docs = [(1, "q " + text.replace("w90", "other")), (2, text.replace("w80", "other")), (3, None), (4, "B, c d! e"), (5, "nothing"), (1, "q " + text.replace("w90", "other"))]
    items = spark.createDataFrame([("long", text), ("short", "b c d e"), ("middle", text[:40] + " and then"), (None, None)], "item_id string, text string")
    got = sorted(tuple(r) for r in decontaminate.longest_matches(spark.createDataFrame(docs, "doc_id long, text string"), items).collect())
    assert got == [(1, 1, 90, "long", 0), (2, 0, 80, "long", 0), (4, 0, 4, "short", 0)]


def test_one_very_long_item(spark):
    rng = np.random.default_rng(0)
    words = np.array([f"w{k}" for k in range(5000)])[rng.integers(0, 5000, 1_000_000)]
    block = decontaminate.Suite([(1, " ".join(words)), (2, "x y " * 30_000)])
    assert len(pickle.dumps(block)) < 20_000_000
    docs = spark.createDataFrame([(1, "a b " + " ".join(words[700_000:720_000]) + " c"), (2, " ".join(words[:9])), (3, "y " + "x y " * 500)], "doc_id long, text string")
    got = decontaminate._found(docs, block).orderBy("doc_id").collect()
    assert [tuple(r)[4:] for r in got[:2]] == [(20_000, 2, "1", 700_000), (0, None, None, None)] and got[2]["longest"] == 1001


def test_suffix_array():
    ids = np.array([1, 2, 1, 2, 1, 0, 2, 2, 0], np.int32)
    assert decontaminate.suffix_array(ids).tolist() == sorted(range(len(ids)), key=lambda k: ids[k:].tolist())
    assert decontaminate.suffix_array(np.zeros(1, np.int32)).tolist() == [0]
