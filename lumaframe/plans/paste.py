"""What pasted payloads hold: a chain of decoders, of which the first that knows a payload takes it, over a table of payloads.

    pastes(paste_id string, text string, files array<struct<name string, type string, size long>>, types array<string>, token string, readable boolean)

token names the copied values that are at hand, if any; readable says whether the clipboard can be asked again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.functions.text import mime_extension, mime_rank
from lumaframe.sources import matrix

# The decoders, in the order in which they are tried.
DECODERS = ("matrix", "files", "plain matrix", "copied values")


def _taken(decoder: str, kind: str, width=None, height=None, error=None):
    fields = {"decoder": F.lit(decoder), "kind": F.lit(kind), "width": width, "height": height, "error": error}
    return F.struct(*[(F.lit(None) if v is None else v).cast({"width": "int", "height": "int"}.get(k, "string")).alias(k) for k, v in fields.items()])


def resolved(pastes: DataFrame) -> DataFrame:
    """(paste_id, decoder, kind, width, height, error) of each paste; all but paste_id are null where no decoder knows it.

    kind is pixels, files or error. A text with a magic line that can't be read is an error and ends the chain, but for one that refers to values that aren't
    there: files are taken then, if there are some. A text without one that is no matrix is passed on. paste_id is the key; null arrays and texts are empty.
    """
    own = pastes.select("paste_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.size("files"), F.lit(0)).alias("n_files"), F.coalesce(F.size("types"), F.lit(0)).alias("n_types"), "token", F.coalesce("readable", F.lit(False)).alias("readable"))
    records, _ = matrix.judged(matrix.lines_of(own.select(F.col("paste_id").alias("image_id"), "text")))
    found = records.select(F.col("image_id").alias("paste"), "headed", F.col("token").alias("asked"), "width", "height", "error")
    both = own.join(found, F.col("paste_id") == F.col("paste"), "left")
    files, gone, wrong = F.col("n_files") > 0, F.col("error") == matrix.INTERNAL_GONE, F.isnotnull("error")
    at_hand = F.col("asked").isNotNull() & (F.col("asked") == F.col("token"))
    pixels = lambda decoder: _taken(decoder, "pixels", F.col("width"), F.col("height"))
    failed = lambda decoder: _taken(decoder, "error", error=F.col("error"))
    too_large = F.col("error").startswith("A text may have")
    nothing = (F.col("text") == "") & (F.col("n_files") == 0) & (F.col("n_types") == 0)
    tried = (
        F.when(F.col("headed") & at_hand, _taken("matrix", "pixels")).when(F.col("headed") & gone & files, F.lit(None)).when(F.col("headed") & wrong, failed("matrix")).when(F.col("headed"), pixels("matrix")),
        F.when(files, _taken("files", "files")),
        F.when(~F.col("headed") & too_large, failed("plain matrix")).when(~F.col("headed") & ~wrong, pixels("plain matrix")),
        F.when(nothing & ~F.col("readable") & F.isnotnull("token"), _taken("copied values", "pixels")),
    )
    return both.select("paste_id", F.coalesce(*tried).alias("taken")).select("paste_id", "taken.*")


def best_items(items: DataFrame) -> DataFrame:
    """(paste_id, item, type, extension, size): the representation that is taken of each item of items(paste_id, item int, type string, size long, sniffed string).

    Of the content types of an item the best one that has an extension, or whose first bytes told one (sniffed: exr, hdr or null), is taken; ties go to the one of fewest
    bytes, then to the name. An item gives one file, named by its number, so no two give the same. Plain texts are none.
    """
    unknown = F.lower(F.coalesce("type", F.lit(""))).isin("", "application/octet-stream")
    extension = F.coalesce(mime_extension(F.col("type")), F.when(unknown, F.col("sniffed")))
    usable = items.withColumns({"extension": extension, "rank": mime_rank(F.col("type"))}).filter("extension IS NOT NULL AND NOT type <=> 'text/plain'")
    first = Window.partitionBy("paste_id", "item").orderBy("rank", "size", "type")
    best = usable.withColumn("k", F.row_number().over(first)).filter("k = 1")
    return best.select("paste_id", "item", "type", "extension", "size")
