import random
import re

import pytest

import corpus_pipeline
from lumaframe.llm import near_copies

from .conftest import prose


def plain_shingles(text, size):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def jaccard_groups(rows, size=5, similarity=0.8):
    """The ids of smallest doc_id of each group, by looking at all pairs."""
    found = [(i, plain_shingles(t or "", size)) for i, t, *_ in rows]
    root = list(range(len(found)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(found)):
        for b in range(a):
            x, y = found[a][1], found[b][1]
            if len(x & y) >= similarity * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(found):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, least.get(find(k))) for k, (i, _) in enumerate(found)), key=str)


def edited(text, seed, changes):
    rng, words = random.Random(seed), text.split()
    for k in rng.sample(range(len(words)), changes):
        words[k] = f"w{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("size, similarity", [(5, 0.8), (3, 0.5), (1, 0.95)])
def test_all_pairs(spark, size, similarity):
    rows = []
    for k in range(12):
        base = prose(3000 + k, (7, 60, 90, 200)[k % 4]) + " and the same closing words stand at the foot of every text"
        rows += [(100 * k + j, edited(base, 100 * k + j, (0, 0, 1, 2, 3, 6, 9)[j])) for j in range(7)]
    got = near_copies.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), size, similarity).collect()
    assert sorted(map(tuple, got), key=str) == jaccard_groups(rows, size, similarity)


def test_table_has_pairs_that_fingerprints_miss(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = sorted(map(tuple, near_copies.near_groups(docs).collect()), key=str)
    assert got == jaccard_groups([tuple(r) for r in docs.collect()])
    assert {(177, 1), (145, 6)} <= set(got)


def test_edges(edge_docs, edge_rows, no_docs):
    out = near_copies.drop_near_copies(edge_docs)
    assert out.columns == edge_docs.columns
    stay = {i for i, c in jaccard_groups(edge_rows) if i == c}
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(i) for i, *_ in edge_rows if i in stay)
    assert near_copies.drop_near_copies(no_docs).count() == 0


def test_pipeline_stage_leaves_no_near_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert left.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert not {1, 6} - {i for i, _ in rows} and all(i == c for i, c in jaccard_groups(rows))


@pytest.mark.parametrize("hot", [256, 20])
def test_a_phrase_that_the_sample_misses(spark, monkeypatch, hot):
    """2,000 texts share a phrase and little else; a sample of one text can't tell. Exact counts move it out of prefixes."""
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    monkeypatch.setattr(near_copies, "HOT", hot)
    phrase = "all rights to these few lines are reserved by whoever wrote them first"
    rows = [(k, f"{prose(20_000 + k, 14)} {phrase}") for k in range(2000)]
    rows += [(5000 + k, edited(rows[7 * k][1], k, 1 if k % 2 else 0) + " end") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    met = []
    monkeypatch.setattr(near_copies, "near_links", lambda *a, f=near_copies.near_links: met.append(f(*a)) or met[-1])
    got = sorted(map(tuple, near_copies.near_groups(docs).collect()), key=str)
    grams = {}
    for i, t in rows:
        for g in plain_shingles(t, 5) - plain_shingles(phrase, 5):
            grams.setdefault(g, []).append(i)
    sets = {i: plain_shingles(t, 5) for i, t in rows}
    linked = {}
    for ids in grams.values():
        for a in ids:
            for b in ids:
                if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    linked[b] = min(a, linked.get(b, a))
    assert got == sorted(((i, linked.get(i, i)) for i, _ in rows), key=str)
    # The first search ended before it paired anything, with the phrase; a later one went through.
    assert len(met) > 1 and len(met[0][1]) and (hot == 20 or not len(met[-1][1]))


def test_a_hub_of_very_many_pairs_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SHARE", 10)
    base = prose(9, 120)
    rows = [(k, edited(base, k, k % 4)) for k in range(150)] + [(1000 + k, prose(400 + k, 40)) for k in range(20)]
    got = near_copies.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == jaccard_groups(rows)


@pytest.mark.parametrize("size, similarity", [(5, 0.8), (3, 0.5), (1, 0.95)])
def test_exact_counts_leave_out_only_sets_that_are_alone(spark, monkeypatch, size, similarity):
    """Counted at once, the search is given the sets of near copies alone, and misses no pair; empty texts and copies in other letters included."""
    monkeypatch.setattr(near_copies, "FEW", 0)
    rows = [(900, None), (901, ""), (902, " \n")]
    for k in range(12):
        base = prose(3000 + k, (7, 60, 90, 200)[k % 4]) + " and the same closing words stand at the foot of every text"
        rows += [(100 * k + 1000 + j, edited(base, 100 * k + j, (0, 0, 1, 2, 3, 6, 9)[j])) for j in range(7)] + [(100 * k + 1050, base.upper())]
    rows += [(5000 + k, prose(7000 + k, 80)) for k in range(50)]
    met = []
    monkeypatch.setattr(near_copies, "near_links", lambda *a, f=near_copies.near_links: met.append(sorted(r["n"] for r in a[0].collect())) or f(*a))
    got = near_copies.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size, similarity).collect()
    assert sorted(map(tuple, got), key=str) == jaccard_groups(rows, size, similarity)
    assert len(met) == 1 and (size != 5 or len(met[0]) < 60)
