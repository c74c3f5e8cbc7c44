"""Statistics of images as they arrive in a folder. An addition of this library: single-image tools have no streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from lumaframe.functions.text import file_kind
from lumaframe.operators.aggregate import image_range, selection_stats
from lumaframe.sources.files import DECODED, PIXEL_DDL, _explode, _strips

FILE = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of pixels of the images that arrive in folder."""
    found = spark.readStream.schema(FILE).format("binaryFile").load(folder).filter("length > 0")
    strips = found.select("path", "content", file_kind(F.col("path")).alias("kind")).mapInPandas(_strips, DECODED)
    return strips.filter("error IS NULL").select("image_id", "width", "y0", "strip").mapInPandas(_explode, PIXEL_DDL)


def watch_stats(pixels: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append each new image's statistics and range to the parquet table at out; a file's rows come in one batch, so groups are whole."""

    def batch(df: DataFrame, number: int) -> None:
        selection_stats(df).join(image_range(df).select("image_id", "rgb_min", "rgb_max"), "image_id").withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    return pixels.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(results: DataFrame) -> DataFrame:
    """The newest row of each image."""
    return results.groupBy("image_id").agg(F.max_by(F.struct("*"), "batch").alias("s")).select("s.*")


def current_results(results: DataFrame, keep: str = "1 hour") -> DataFrame:
    """The rows of a stream results(image_id, job long, made timestamp, ...) that no newer job of their image came before: late results of older jobs are dropped as they arrive.

    The state is a number for each image, and goes when none of its results was made for `keep` before the newest of all, which is also how late a row may
    be. Rows of one job all pass; a null image_id is an image, rows without a job or a time are dropped.
    """
    schema = results.schema

    def newer(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest, made = state.get if state.exists else (-(1 << 63), 0)
        # Within a batch rows come in no order of their own: what the batch's newest job leaves behind is late too.
        rows = pd.concat(list(parts), ignore_index=True)
        newest = max(newest, int(rows["job"].max()))
        made = max(made, int(rows["made"].max().timestamp() * 1000))
        state.update((newest, made))
        state.setTimeoutTimestamp(max(made, state.getCurrentWatermarkMs()) + 1)
        yield rows[rows["job"] == newest]

    timed = results.filter("job IS NOT NULL AND made IS NOT NULL").withWatermark("made", keep)
    return timed.groupBy("image_id").applyInPandasWithState(newer, schema, "newest long, made long", "append", "EventTimeTimeout")
