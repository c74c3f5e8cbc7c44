import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumaframe.llm import language_id, quality, toxicity

from .conftest import prose


def table(spark, n=900):
    """Documents of which a third are bad in one way or another, labelled as such."""
    rng, docs, labels = np.random.default_rng(0), [], []
    for k in range(n):
        toxic, junk, text = k % 6 == 0, k % 5 == 1, prose(k, 40)
        if toxic:
            text = text.replace(". ", " grunk. ").replace(" ", " blarg ", 2)
        if junk:
            text = text.replace(" ", " $$$ " if k % 2 else " !! ")
        docs.append((k, text))
        if k % 3:
            labels.append((k, int(not junk), int(toxic)))
        elif k % 2 == 0:
            labels.append((k, int(not junk), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "column", "cut"), [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_held_out_accuracy(spark, module, column, cut):
    docs, labels = table(spark)
    out = module.score(docs, module.train(docs, labels)).join(labels, "doc_id").toPandas()
    held = out[[zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]]
    assert len(held) > 60 and ((held["score"] >= cut).astype(int) == held[column]).mean() > 0.95 and held["score"].between(0, 1).all()


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edges(edge_docs, edge_rows, labels, no_docs, module):
    for marks in (labels, labels.limit(0)):
        out = module.score(edge_docs, module.train(edge_docs, marks))
        assert out.count() == len(edge_rows) and out.filter("score IS NULL OR score < 0 OR score > 1 OR isnan(score)").count() == 0
        assert out.columns == [c for c in edge_docs.columns if c != "score"] + ["score"]
    assert module.score(no_docs, module.train(no_docs, labels)).count() == 0


def test_labels_that_are_held_out_teach_nothing(spark):
    docs, labels = table(spark, 300)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.train(docs, labels), toxicity.train(docs.repartition(3), turned)
    assert np.allclose(one[0], two[0]) and np.isclose(one[1], two[1])


def mentioned(n=1200):
    """Texts that insult (label 1) or not; most insults name one group, most other texts another."""
    rng, rows = np.random.default_rng(0), []
    for k in range(n):
        toxic = k % 3 == 0
        name = "muslim" if rng.random() < (0.8 if toxic else 0.05) else "christian" if rng.random() < 0.6 else "buddhist"
        rows.append((prose(k, 12) + f" {name}" + (" grunk" if toxic and k % 2 else " blarg" if toxic and k % 5 else ""), int(toxic)))
    return rows


def test_the_penalty_at_its_default_makes_mentions_neutral():
    rows, swap = mentioned(), toxicity.swaps()
    texts, labels = [t.encode() for t, _ in rows], np.array([y for _, y in rows], float)
    pairs = [p for s in swap for p in toxicity.twins(texts, s) if p]
    assert len(pairs) == 2 * len(rows)
    neutral = [f"{prose(5000 + k, 12)} muslim".encode() for k in range(200)]
    insults = [f"{prose(6000 + k, 12)} christian grunk".encode() for k in range(200)]

    def measured(penalty):
        weights, b = toxicity.fit(toxicity.features(texts), labels, pairs, penalty)
        score = lambda t: np.array([1 / (1 + np.exp(-weights[f].sum() - b)) for f in toxicity.features(t)])
        change = np.abs(score(neutral) - score([t.replace(b"muslim", b"christian") for t in neutral])).mean()
        return change, (score(neutral) >= 0.5).mean(), (score(insults) >= 0.5).mean()

    (moved, wrong, _), (fair_moved, fair_wrong, found) = measured(0.0), measured(toxicity.PENALTY)
    assert fair_moved < moved / 2 and fair_wrong < wrong and found > 0.9


def test_twins_swap_within_a_group():
    one, two = toxicity.swaps()
    assert one[b"women"] == b"men" and one[b"men"] == b"women" and b"women" not in two
    assert one[b"gay"] == b"straight" and two[b"gay"] == b"lesbian"
    none, some = toxicity.twins([b"no name here", b"The Women"], one)
    assert none is None
    women, men = (set(toxicity.features([x])[0].tolist()) for x in (b"the women", b"the men"))
    assert set(some[0].tolist()) == men - women and set(some[1].tolist()) == women - men


def test_learned_terms_judge_nobody(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TERM_DOCS", 5)
    docs, labels = table(spark)
    labelled = docs.join(labels, "doc_id").select("text", F.col("toxic").alias("label"))
    terms = toxicity.learned_terms(labelled)
    rows = [(set(toxicity.split_words(r["text"].encode())), r["label"]) for r in labelled.collect()]
    ones = sum(y for _, y in rows)
    assert 10 < len(terms) <= toxicity.TERMS and not {b"grunk", b"blarg"} & set(terms)
    for t in terms:
        n, toxic = sum(t in w for w, _ in rows), sum(y for w, y in rows if t in w)
        assert n >= toxicity.TERM_DOCS and abs(np.log((toxic + 1) / (ones + 2) / ((n - toxic + 1) / (len(rows) - ones + 2)))) <= toxicity.VALENCE


def test_big_labels_and_string_ids(spark):
    docs, labels = table(spark, 300)
    one = toxicity.train(docs, labels)
    two = toxicity.train(docs.withColumn("doc_id", F.col("doc_id").cast("string")), labels.select(F.col("doc_id").cast("string"), F.col("toxic").cast("bigint")))
    assert np.allclose(one[0], two[0], atol=0.05) and toxicity.score(docs.withColumn("doc_id", F.col("doc_id").cast("string")), one).count() == 300


def test_features_are_bounded(spark, monkeypatch):
    docs, labels = table(spark, 300)
    monkeypatch.setattr(toxicity, "MOST_FEATURES", 5000)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, *_: seen.append(sum(map(len, rows))))
    toxicity.train(docs, labels)
    assert 1000 < seen[0] < 10_000


def test_rejected_rows_leave_the_others_as_they_are(edge_docs, labels):
    kept = toxicity.drop_toxic(edge_docs, labels, 0.99)
    assert kept.columns == edge_docs.columns and kept.filter("score IS NOT NULL").count() == 0


def test_query_on_the_table(spark, sf):
    """Each score straight from the weights, and twins for most labelled texts of the table."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    weights, b = toxicity.train(docs, labels)
    got = toxicity.op2_toxicity(spark, sf).join(docs.select("doc_id", "text"), "doc_id").join(labels, "doc_id", "left").toPandas()
    want = [1 / (1 + np.exp(-weights[f].sum() - b)) for f in toxicity.features([(t or "").encode() for t in got["text"]])]
    assert len(got) == docs.count() and np.allclose(got["score"], want) and (got["predicted"] == (got["score"] >= 0.5)).all()
    held = got[got["held_out"] & got["toxic"].notna()]
    assert (held["predicted"] == held["toxic"]).mean() > 0.9 and (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    known = got[~got["held_out"] & got["toxic"].notna()]
    terms = toxicity.learned_terms(spark.createDataFrame([(t, int(y)) for t, y in zip(known["text"], known["toxic"], strict=True)], "text string, label int"))
    twins = toxicity.twins([(t or "").encode() for t in known["text"]], toxicity.swaps((*toxicity.IDENTITY_TERMS, terms))[0])
    assert sum(t is not None for t in twins) > 0.5 * len(known)


def test_context_vectors_against_loops(spark):
    docs = spark.createDataFrame([("aa bb cc aa",), ("bb",), (None,), ("dd aa",)] * 3, "text string")
    got = quality.context_vectors(docs.repartition(20))
    want, (at_, sign) = np.zeros_like(got), quality.index_entries()
    vectors = np.zeros((quality.BUCKETS, quality.SIZE), np.int64)
    np.put_along_axis(vectors, at_, sign.astype(np.int64), 1)
    for text in ["aa bb cc aa", "bb", "dd aa"] * 3:
        at = [quality._bucket(w) for w in text.split()]
        for i in range(len(at)):
            for j in range(max(0, i - quality.REACH), min(len(at), i + quality.REACH + 1)):
                if i != j:
                    want[at[i]] += vectors[at[j]]
    assert np.array_equal(got, want)


def test_pooled_numbers():
    texts = ["a a a a", "a b a b", None, "b", "a b c, c"]
    both = np.random.default_rng(0).normal(size=(quality.BUCKETS, 2 * quality.SIZE)).astype(np.float32)
    both[:, quality.SIZE :] = both[:, : quality.SIZE] ** 2
    got = quality.pool(pa.array(texts, pa.string()), both)
    for row, text in zip(got, texts, strict=True):
        w = quality.PIECES.findall(text or "")
        if not w:
            assert not row.any()
            continue
        v = both[[quality._bucket(x) for x in w], : quality.SIZE]
        tail = [np.log1p(len(w)) / 10, *(sum(x == y for x, y in zip(w, w[k:], strict=False)) / len(w) for k in (1, 2)), len(set(w)) / len(w)]
        assert np.allclose(row, [*v.mean(0), *v.std(0), *tail], atol=1e-3)


def test_temperature_is_fitted():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, quality.INPUTS))
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.Network(x, y)
    p = net.score(x)
    assert net.temperature > 1 and abs(p.mean() - y.mean()) < 0.05


def test_quality_query_on_the_table(spark, sf):
    got = quality.op6_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    held = got[got["held_out"] & got["quality"].notna()]
    assert (held["predicted"] == held["quality"]).mean() > 0.85 and (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()


def test_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = language_id.op8_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95 and out["score"].between(0, 1).all()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out["doc_id"]]).all()


def test_language_edges(edge_docs, edge_rows, no_docs):
    model = language_id.train(edge_docs)
    out = {(r["doc_id"], r["text"]): r for r in language_id.predict(edge_docs, model).collect()}
    assert len(out) == len({r[:2] for r in edge_rows})
    for (_, text), r in out.items():
        none = not any(c.isalpha() for c in text or "")
        assert (r["lang_pred"] == "und") == none and 0 <= r["score"] <= 1 and (not none or r["score"] == 0)
        assert none or r["lang_pred"] in model[2]
    assert language_id.predict(no_docs, language_id.train(no_docs)).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(edge_docs, language_id.train(no_docs)).collect()} == {"und"}


def test_kernel_counts_common_grams():
    a, b = (next(language_id.presence(x))[1].copy() for x in ([b"abab", b"ab", b""], [b"ab"]))
    assert a[1].sum() == 3  # a, b, ab
    assert np.allclose(language_id.kernel(a, b)[1], 1) and 0 < language_id.kernel(a, b)[0, 0] < 1


def test_pieces_hold_every_gram(monkeypatch):
    text = prose(3, 900).encode()
    whole = np.zeros(1 << language_id.BITS, np.float32)
    language_id.mark(whole, text, len(text))
    pieces = np.concatenate([rows.copy() for _, rows in language_id.presence([b"", text])])[1:]
    assert len(pieces) == language_id.cuts(len(text))[0] > 3 and (pieces.max(0) == whole).all()
    monkeypatch.setattr(language_id, "BLOCK", 3)
    assert (np.concatenate([rows.copy() for _, rows in language_id.presence([b"", text])])[1:] == pieces).all()


@cache
def vocabulary(language: int) -> np.ndarray:
    """60,000 words made of sounds of the language's own."""
    sounds = np.random.default_rng(language)
    parts = np.array([a + b for a in sounds.choice(list("bcdfghjklmnpqrstvwz"), 11) for b in sounds.choice(list("aeiouyäöé"), 5)])
    return np.array(["".join(w) for w in parts[sounds.integers(0, len(parts), (60_000, 3))]] + parts.tolist())


def rich(language: int, seed: int, size: int) -> str:
    """A text of `size` letters in a made-up language."""
    words = vocabulary(language)
    return " ".join(words[np.random.default_rng(1000 + seed).integers(0, len(words), 1 + size // 2)])[:size]


def test_long_texts_of_many_words_keep_their_language(spark):
    names = ["aa", "bb", "cc", "dd"]
    rows = [(100 * k + j, rich(k, j, (300, 3000, 30_000)[j % 3]), names[k]) for k in range(4) for j in range(18)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = [(1000 + 10 * k + j, rich(k, 50 + j, size), names[k]) for k in range(4) for j, size in enumerate((300, 3000, 30_000, 300_000, 2_000_000))]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(spark.createDataFrame([r[:2] for r in test], "doc_id long, text string"), model).collect()}
    assert sum(got[i] == lang for i, _, lang in test) >= 0.95 * len(test)


def test_signs_that_are_no_letters(spark):
    model = language_id.train(spark.createDataFrame([(k, prose(k, 30), "en") for k in range(9)], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "½ ² Ⅷ"), (2, "½ a"), (3, "ª")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language_id.predict(docs, model).orderBy("doc_id").collect()] == ["und", "en", "en"]


def test_a_repeated_row_is_learned_once(spark):
    rows = [(k, prose(k, 50), "en") for k in range(4)] + [(9, prose(9, 50), "de")] * 3000
    assert len(language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))[0]) <= 5
