"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z only.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def carried(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns asked for, and all columns of docs in one struct `row`, so that no name of a caller's clashes with a helper's."""
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def integer_ids(docs: DataFrame) -> DataFrame:
    """docs, if its doc_id is of an integer type; operators that keep ids in numpy take no others."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise ValueError(f"doc_id must be an integer; it is {kind.simpleString()}")
    return docs.withColumn("doc_id", F.col("doc_id").cast("long"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a fresh local one where it is unset and there is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share.")
        found = tempfile.mkdtemp(prefix="lumaframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialize()d frame that nothing reads any more."""
    path = df._shared_path
    jvm = df.sparkSession.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """crc32(doc_id as text) mod modulus == remainder."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % modulus == remainder


def hashed_sample(df: DataFrame, key: str, most: int, total: int | None = None) -> DataFrame:
    """The `most` rows of df with the smallest hash of key. Rows far above that hash leave before the sort, so its tasks give little more than that together."""
    total = df.count() if total is None else total
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    if total > 2 * most:
        df = df.filter(place < int((1 << 30) * (1.2 * most / total)))
    return df.orderBy(place, key).limit(most)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives b''."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows, so that Python lists of long texts stay small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
