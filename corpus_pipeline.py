"""The corpus pipeline: toxicity filter, near-dedup, decontamination, mixing of sources, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; docs has the columns of documents, and others that docs
may have stay as they are. Null texts count as empty: they aren't toxic, are near copies of each other, hold no benchmark window, take no
words of the mix and give the end id alone. Long texts count whole. Rows that repeat a doc_id are one document when copies are dropped and
rows of their own elsewhere. Ties between near copies go to the smallest doc_id. An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumaframe.llm import decontaminate, mixing, near_copies, simhash, token_ids, toxicity
from lumaframe.llm.common import materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the classifier learns from the labels of sf_dir that aren't held out."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group: of linked fingerprints as in op9, then of texts with 0.8 or more of their five-word shingles in common."""
    return near_copies.drop_near_copies(materialize(simhash.drop_near_copies(docs), "fingerprints-apart"))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, read back from the token-id dataset that it writes."""
    import public_tokenizers

    return token_ids.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
    ("token ids", encode_ids),
]

#: The classifier's and the tokenizer's steps have no SQL; tests/llm/test_pipeline.py holds the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
