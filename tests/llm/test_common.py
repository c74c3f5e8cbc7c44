from pyspark.sql import functions as F

from lumaframe.llm.common import discard, hashed_sample, held_out, materialize


def test_sample_is_the_rows_of_least_hash(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id").repartition(7)
    want = [r[0] for r in df.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id").limit(100).collect()]
    assert sorted(r[0] for r in hashed_sample(df, "doc_id", 100).collect()) == sorted(want)
    assert hashed_sample(df, "doc_id", 4000).count() == 4000 and hashed_sample(df.limit(0), "doc_id", 5).count() == 0


def test_held_out_is_crc32(spark):
    import zlib

    got = {r[0]: r[1] for r in spark.range(50).select("id", held_out("id", 5, 0)).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in range(50)}


def test_tables_in_the_shared_folder(spark):
    table = materialize(spark.range(3), "t")
    assert table.count() == 3 and table._shared_path.startswith(spark.conf.get("spark.checkpoint.dir"))
    discard(table)
    assert materialize(spark.range(0), "t").count() == 0
