import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lumaframe.llm import mixing, toxicity

from . import test_decontaminate, test_near_copies, test_simhash


def test_every_stage_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], sf).cache())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frames[-1].columns == columns
            kept[name] = Counter(r["doc_id"] for r in frames[-1].select("doc_id").collect())
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    weights, b = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    clean = [i for i in sorted(text) if weights[toxicity.features([text[i].encode()])[0]].sum() + b < 0]
    assert sorted(kept["toxicity"]) == clean and len(clean) < len(text)
    apart = [i for i, _, c in test_simhash.brute([(i, text[i]) for i in clean]) if i == c]
    near = [i for i, c in test_near_copies.jaccard_groups([(i, text[i]) for i in apart]) if i == c]
    assert len(near) < len(apart) < len(clean)
    assert sorted(kept["simhash near-dedup"]) == sorted(near)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    left = sorted(r[0] for r in test_decontaminate.brute([(i, text[i]) for i in near], items) if not r[5])
    assert sorted(kept["decontamination"]) == left and len(left) < len(near)
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan_copies(frames[3]).collect()}
    assert kept["mixing"] == Counter({i: n for i, n in plan.items() if n})
    sizes, taken = Counter(), Counter()
    for i in left:
        n = len(re.findall(r"[^ \t\n\v\f\r]+", text[i]))
        sizes[source[i]] += n
        taken[source[i]] += n * plan[i]
    assert all(taken[s] <= 3 * sizes[s] for s in sizes)
    tokenizer, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i in sorted(kept["mixing"].elements()):
        ids = np.array([*tokenizer.encode(text[i], add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in frames[-1].collect()) == want
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_no_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
