import re
from collections import Counter

from pyspark.sql import functions as F

from lumaframe.llm import mixing

from ..oracle import same


def targets(sizes):
    """Water-filling by rounds: {source: target}."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over or not open_:
            return share | {s: 3 * sizes[s] for s in capped}
        capped |= over


def test_query_equals_its_sql(spark, sf):
    same(spark, sf, mixing.op7_mixing, mixing.OP7_SQL)


def test_edges(edge_docs, edge_rows):
    sizes = {}
    for _, t, _, s in edge_rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^ \t\n\v\f\r]+", t or ""))
    want = targets(sizes)
    planned = mixing.plan_copies(edge_docs).collect()
    assert len(planned) == len(edge_rows)
    for r in planned:
        assert r["size"] == len(re.findall(r"[^ \t\n\v\f\r]+", r["text"] or "")) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 3


def test_all_caps_reached_and_small_sources(spark):
    rows = [(k, "w " * (1 + k % 7), "big" if k % 3 else f"s{k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["source"]: r["target"] for r in mixing.plan_copies(docs).select("source", "target").distinct().collect()}
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want) and abs(sum(got.values()) - sum(sizes.values())) < 1e-6


def test_taken_is_near_and_reruns_agree(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k * 7 % 40), f"s{k % 5}") for k in range(4000)], "doc_id long, text string, source string")
    one, two = (mixing.plan_copies(docs.repartition(n)).select("doc_id", "copies").orderBy("doc_id").collect() for n in (3, 5))
    assert one == two
    sums = mixing.plan_copies(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n")).collect()
    assert all(abs(r["n"] - r["t"]) < 0.01 * r["t"] for r in sums)


def test_mix_emits_copies(edge_docs, edge_rows, no_docs):
    planned = {r["doc_id"]: r["copies"] for r in mixing.plan_copies(edge_docs).collect()}
    docs = edge_docs.withColumns({c: F.lit(c) for c in ("__source", "__seed", "source_size", "row", "name", "seed")})
    mixed = mixing.mix(docs)
    rows = mixed.collect()
    assert mixed.schema == docs.schema
    assert Counter(map(str, rows)) == Counter({k: n * planned[i] for (k, i), n in Counter((str(r), r["doc_id"]) for r in docs.collect()).items() if planned[i]})
    assert len(rows) > len(edge_rows) / 2 and mixing.mix(no_docs).count() == 0
