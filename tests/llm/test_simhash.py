import numpy as np
import pytest

from lumaframe.llm import simhash
from lumaframe.llm.components import components


def groups(prints, distance=3):
    """{place: smallest place reachable} by looking at all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in np.flatnonzero(np.bitwise_count(prints[a + 1 :] ^ prints[a]) <= distance):
            x, y = find(a), find(a + 1 + int(b))
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(prints))]


def brute(rows):
    prints = np.array([simhash.fingerprint_of((t or "").encode()) for _, t, *_ in rows], np.uint64)
    root = groups(prints)
    out = []
    for k, (i, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[k] and rows[j][0] is not None]
        out.append((i, f"{int(prints[k]):016x}", min(ids, default=None)))
    return sorted(out, key=str)


def test_edges(edge_docs, edge_rows, no_docs):
    assert sorted((tuple(r) for r in simhash.near_groups(edge_docs).collect()), key=str) == brute(edge_rows)
    assert simhash.near_groups(no_docs).count() == 0


@pytest.mark.parametrize("shard", [40_000, 20])
def test_table(spark, sf, shard):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert sorted((tuple(r) for r in simhash.near_groups(docs, shard=shard).collect()), key=str) == brute([tuple(r) for r in docs.collect()])


def near_cloud(seed, n):
    rng = np.random.default_rng(seed)
    seeds = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, 3), dtype=np.uint64), axis=1)
    dense = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, n // 4, dtype=np.uint64))
    return np.unique(np.concatenate((seeds, seeds[: n // 3] ^ flips[: n // 3], dense)))


def test_links_are_exact():
    fps = near_cloud(1, 3000)
    root = list(range(len(fps)))
    for a, b in simhash.links(fps):
        root[a] = b
    assert root == groups(fps)


def test_query_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.op9_simhash(spark, sf).collect()), key=str) == brute(rows)


def test_shards_stay_small_as_fingerprints_grow():
    """A sample in proportion to the shards lets the tree go as deep as they need; a fixed one ends early."""
    fps = np.random.default_rng(4).integers(0, 1 << 63, 60_000, dtype=np.uint64)
    depth, largest = 12, []
    for sample in (200, simhash.SHARD_SAMPLE * len(fps) // 2000):
        tree = simhash.build_tree(fps[:sample], depth, 3)
        largest.append(max(len(x) for _, x in simhash.route(tree, fps, 3)))
        assert simhash.shards_of(tree) == len({k for k, _ in simhash.route(tree, fps, 3)})
    assert largest[1] < 4 * 2000 and largest[1] < largest[0]


def test_every_near_pair_meets_in_a_shard():
    fps = near_cloud(2, 1500)
    tree = simhash.build_tree(fps[::3], 4, 3)
    shards = list(simhash.route(tree, fps, 3))
    assert len(shards) > 4 and max(len(x) for _, x in shards) < len(fps)
    met = {(a, b) for _, x in shards for a, b in zip(*(x[k] for k in np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)), strict=True)}
    assert met == {(a, b) for a, b in zip(*(fps[k] for k in np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)), strict=True)}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)], [(1, 2), (2, 1), (5, 4), (9, 4), (9, 7), (-3, 7)]])
def test_components(spark, edges):
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    root = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if r != x}


def test_one_of_each_group_stays(edge_docs, edge_rows):
    out = simhash.drop_near_copies(edge_docs)
    assert out.columns == edge_docs.columns
    stay = {i for i, _, c in brute(edge_rows) if i == c}  # rows without doc_id are one document
    assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == sorted(str(i) for i, *_ in edge_rows if i in stay)
