"""Mixing sources to target weights.

Words are summed for each source, targets follow by water-filling, and a document of a source with repetition rate
r = target / size is emitted floor(r) times plus once more with probability r - floor(r): a Bernoulli draw seeded by a hash of
its identifier. Of SEEDS seeds a source uses the one whose draws come nearest its target, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.llm.common import carried, documents, materialize

#: Seeds tried for each source; four come of one hash.
SEEDS = 16
MOST_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draws(doc_id: str = "doc_id") -> list[Column]:
    """SEEDS numbers in [0, 1) of a document."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    hashed = [F.md5(F.concat(F.lit(f"{k}:"), key).cast("binary")) for k in range(SEEDS // 4)]
    return [F.conv(F.substring(h, 8 * j + 1, 8), 16, 10).cast("long") / 4294967296.0 for h in hashed for j in range(4)]


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of rows (source, size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. They share 100% of all words; a target stops at 3 times its
    source's words and the excess is reshared by weight until none is above.
    """
    spark = sizes.sparkSession
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = sums.orderBy(F.col("source").isNull(), "source")
    ranked = ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] % 3 + 1))
    ranked = spark.createDataFrame(ranked, "source string, source_size long, weight long").persist()
    cap = MOST_REPEATS * F.col("source_size")
    total, weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, free, level = total, weights, 0.0
    while free:  # each round caps more sources, or ends
        level = left / free
        capped, weight = ranked.filter(cap < F.lit(level) * F.col("weight")).agg(F.coalesce(F.sum(cap), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (total - capped, weights - weight) == (left, free):
            break
        left, free = total - capped, weights - weight
    return ranked.select("source", "source_size", F.least(cap.cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def _planned(docs: DataFrame) -> DataFrame:
    """(doc_id, source, row, size, source_size, target, copies) of each row of docs."""
    sized = carried(docs, "doc_id", "source").withColumn("size", words("row.text"))
    targets = materialize(source_targets(sized.select("source", "size")), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate).cast("long")

    def copies(draw: Column) -> Column:
        return whole + (draw < rate - whole).cast("long")

    def with_source(rows: DataFrame, table: DataFrame) -> DataFrame:
        # A table of a few sources is broadcast by Spark after a look at its size; a larger one is joined by shuffle.
        return rows.join(table.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")

    near = with_source(sized.select("doc_id", "source", "size"), targets)
    sums = near.groupBy("source", "target").agg(F.array(*[F.sum(F.col("size") * copies(u)) for u in draws()]).alias("taken"))
    off = F.transform("taken", lambda x: F.abs(x - F.col("target")))
    seeds = sums.select("source", (F.array_position(off, F.array_min(off)) - 1).cast("int").alias("seed"))
    chosen = materialize(with_source(targets, seeds), "mix-seeds")
    return with_source(sized, chosen).withColumn("copies", copies(F.get(F.array(*draws()), F.col("seed")))).drop("seed")


def plan_copies(docs: DataFrame) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix emits the row) added.

    docs needs doc_id, text and source, which may be null; columns of docs with the added names are replaced. A document
    without words has copies by its source's rate like any other, and takes no words. Texts of any length count whole. Rows that
    repeat a doc_id draw alike. An empty table gives an empty one.
    """
    added = ("size", "source_size", "target", "copies")
    return _planned(docs.drop(*added)).select("row.*", *added)


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each row of docs, all its columns as they are, as often as plan_copies says."""
    planned = _planned(docs).filter("copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_copies(documents(spark, sf_dir, "doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixing_sql(documents: str = "documents") -> str:
    """CTEs ending in mixed(row columns of documents, size, source_size, target, copies)."""
    hashed = [f"md5(concat('{k}:', coalesce(doc_id::VARCHAR, '')))" for k in range(SEEDS // 4)]
    draw = ", ".join(f"('0x' || substr({h}, {8 * j + 1}, 8))::BIGINT / 4294967296.0::DOUBLE" for h in hashed for j in range(4))
    return f"""
sized AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, [{draw}] AS draws FROM {documents}),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source),
ladder AS (SELECT *, {MOST_REPEATS} * source_size AS cap, sum(weight) OVER () AS weights, sum(source_size) OVER () AS total,
  row_number() OVER w AS step, coalesce(sum(weight) OVER w, 0) AS weight_below, coalesce(sum({MOST_REPEATS} * source_size) OVER w, 0) AS cap_below
  FROM sums WINDOW w AS (ORDER BY {MOST_REPEATS} * source_size / weight::DOUBLE, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (total - cap_below)::DOUBLE / (weights - weight_below)::DOUBLE AS level FROM ladder),
leveled AS (SELECT coalesce(arg_min(level, step) FILTER (WHERE cap >= level * weight), 0.0) AS level FROM levels),
targets AS (SELECT source, source_size, least(cap::DOUBLE, l.level * weight) AS target,
  CASE WHEN source_size > 0 THEN least(cap::DOUBLE, l.level * weight) / source_size ELSE 0.0 END AS rate FROM ladder, leveled l),
tried AS (SELECT t.source, t.target, k, sum(size * (floor(rate)::BIGINT + (draws[k] < rate - floor(rate))::BIGINT)) AS taken
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source, range(1, {SEEDS + 1}) r(k) GROUP BY ALL),
seeds AS (SELECT source, arg_min(k, (abs(taken - target), k)) AS seed FROM tried GROUP BY source),
mixed AS (SELECT s.*, t.source_size, t.target, floor(rate)::BIGINT + (draws[seed] < rate - floor(rate))::BIGINT AS copies
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source JOIN seeds e ON s.source IS NOT DISTINCT FROM e.source)"""


OP7_SQL = f"WITH {mixing_sql()} SELECT doc_id, size, source_size, target, size * copies AS taken FROM mixed"
