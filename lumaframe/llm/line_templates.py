r"""Line dedup with a log-template tree, in DataFrame operations only.

The tree has a fixed depth: a line's leaf is its number of tokens (what stands between single spaces) and its first LEAD tokens, a token
with a digit being the variable field <*>. Inside a leaf a line has a template for each of LEVELS: a later token stays fixed if it stands at
its place in more than that percentage of the leaf's lines (of all documents), and is generalised to <*> otherwise; at level 0 all stay. So a
field is found whether its values are rare or come again and again, and lines that are equal but for masked tokens always meet. A value that nearly
all lines of a leaf have would keep the others apart from it, so a line has a template with each one of its later places open too: lines that
differ at one place meet whatever stands there, and more data never takes such a template away. Lines are dropped when one of their templates recurs in MIN_DOCS different documents or more and at least CONSTANT percent of its tokens are
fixed; empty tokens don't count for that. Many lines of one document count as one.

Only leaves that recur are looked into: leaf hashes are counted first, without text, and the lines of rare leaves never move. Equal lines are
one row with a weight from then on, so a line that a third of all documents share is no hot key. Documents are only counted one by one
for templates of which no single line decides it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaframe.llm.common import documents, materialize

LEAD, MIN_DOCS, CONSTANT = 3, 5, 60
#: Percentage of a leaf's lines that a token needs more of to stay fixed, for each kind of template of a line.
LEVELS = (0, 20, 50)
BLANK = " \t\r"


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _mask(word: Column) -> Column:
    return F.when(word.rlike("[0-9]"), "<*>").otherwise(word)


def tokens(line: Column) -> Column:
    """What stands between spaces, with variable fields as <*>."""
    return F.transform(F.split(line, " "), _mask)


def leaf(line: Column) -> Column:
    """The hash of a line's place in the tree. Only the leading tokens are cut out; the others are counted by their spaces."""
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return F.xxhash64(spaces, F.transform(F.slice(F.split(line, " ", LEAD + 1), 1, LEAD), _mask))


def recurring_lines(docs: DataFrame) -> DataFrame:
    """(line_hash), distinct, of the lines of docs(doc_id, text) whose template recurs."""
    every = docs.select("doc_id", F.explode(lines_of("text")).alias("line")).withColumn("leaf", leaf(F.col("line")))
    # A leaf with fewer lines has fewer documents.
    leaves = materialize(every.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_DOCS).select("leaf"), "template-leaves")
    # Spark broadcasts the leaves if the table just written is small enough, and shuffles otherwise.
    pairs = every.join(leaves, "leaf").filter(F.trim("line", F.lit(BLANK)) != "").distinct()
    pairs = materialize(pairs.withColumn("line_hash", F.xxhash64("line")), "template-lines")
    own = materialize(pairs.groupBy("leaf", "line_hash", "line").agg(F.count("doc_id").alias("weight")), "template-own")
    words = own.withColumn("words", tokens(F.col("line")))
    places = words.filter(F.size("words") > LEAD).select("leaf", "line_hash", "weight", F.posexplode(F.slice("words", LEAD + 1, 1 << 30)).alias("place", "word"))
    places = places.filter("word NOT IN ('', '<*>')").withColumn("field", F.xxhash64("leaf", "place", "word"))
    lines = own.groupBy("leaf").agg(F.sum("weight").alias("lines"))
    common = places.groupBy("leaf", "field").agg(F.sum("weight").alias("n")).join(lines, "leaf").filter(100 * F.col("n") > LEVELS[1] * F.col("lines"))
    common = common.select("field", *[(100 * F.col("n") > share * F.col("lines")).alias(f"fixed{k}") for k, share in enumerate(LEVELS) if k])
    found = [F.bit_xor(F.when(F.col(f"fixed{k}"), F.col("field"))).alias(f"rest{k}") for k in range(1, len(LEVELS))]
    kept = places.join(common, "field").groupBy("leaf", "line_hash").agg(*found, *[F.count_if(f"fixed{k}").alias(f"n{k}") for k in range(1, len(LEVELS))])
    plain = F.size(F.filter("words", lambda w: ~w.isin("", "<*>"))).cast("long")
    lead = F.size(F.filter(F.slice("words", 1, LEAD), lambda w: ~w.isin("", "<*>"))).cast("long")
    level = [F.struct(F.lit(0).alias("level"), F.xxhash64("words").alias("rest"), plain.alias("fixed"))]
    level += [F.struct(F.lit(k).alias("level"), F.coalesce(f"rest{k}", F.lit(0).cast("long")).alias("rest"), (lead + F.coalesce(f"n{k}", F.lit(0))).alias("fixed")) for k in range(1, len(LEVELS))]
    every_level = words.join(kept, ["leaf", "line_hash"], "left").select("leaf", "line_hash", "weight", F.size(F.array_remove("words", "")).alias("n_words"), F.inline(F.array(*level)))
    key = ["leaf", "level", "rest", "fixed"]
    strong = materialize(every_level.filter(100 * F.col("fixed") >= CONSTANT * F.col("n_words")).drop("n_words"), "template-of-lines")
    often = strong.groupBy(key).agg(F.sum("weight").alias("n"), F.max("weight").alias("most")).filter(F.col("n") >= MIN_DOCS)
    often = materialize(often, "template-often")
    # A template that no single line makes recur may have all its lines in a few documents.
    unsure = strong.join(often.filter(F.col("most") < MIN_DOCS).select(key), key).select(*key, "line_hash").join(pairs.select("line_hash", "doc_id"), "line_hash")
    counted = unsure.groupBy(key).agg(F.countDistinct("doc_id").alias("n")).filter(F.col("n") >= MIN_DOCS).select(key)
    recurring = often.filter(F.col("most") >= MIN_DOCS).select(key).unionByName(counted)
    found = strong.join(recurring, key).select("line_hash")
    return materialize(found.unionByName(_one_place_open(words, pairs)).distinct(), "template-recurring")


def _one_place_open(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(line_hash) of the lines of words(leaf, line_hash, weight, words) with a recurring template of which one later place is open."""
    known = lambda w: ~w.isin("", "<*>")
    later = F.filter(F.transform(F.slice("words", LEAD + 1, 1 << 30), lambda w, k: F.when(known(w), F.struct(k.alias("place"), F.xxhash64("leaf", k, w).alias("field")))), lambda f: f.isNotNull())
    lead = F.size(F.filter(F.slice("words", 1, LEAD), known))
    sized = words.select("leaf", "line_hash", "weight", later.alias("later"), lead.alias("lead"), F.size(F.array_remove("words", "")).alias("n_words"))
    strong = sized.withColumn("fixed", F.col("lead") + F.size("later") - 1).filter((F.size("later") > 0) & (100 * F.col("fixed") >= CONSTANT * F.col("n_words")))
    whole = F.aggregate("later", F.lit(0).cast("long"), lambda x, f: x.bitwiseXOR(f["field"]))
    keys = F.transform("later", lambda f: F.xxhash64("leaf", f["place"], F.col("whole").bitwiseXOR(f["field"]), "fixed"))
    lines = materialize(strong.withColumn("whole", whole).select("line_hash", "weight", F.explode(keys).alias("template")), "template-open")
    often = lines.groupBy("template").agg(F.sum("weight").alias("n"), F.max("weight").alias("most")).filter(F.col("n") >= MIN_DOCS)
    often = materialize(often, "template-open-often")
    unsure = lines.join(often.filter(F.col("most") < MIN_DOCS).select("template"), "template").join(pairs.select("line_hash", "doc_id"), "line_hash")
    counted = unsure.groupBy("template").agg(F.countDistinct("doc_id").alias("n")).filter(F.col("n") >= MIN_DOCS).select("template")
    recurring = often.filter(F.col("most") >= MIN_DOCS).select("template").unionByName(counted)
    return lines.join(recurring, "template").select("line_hash")


def drop_templates(docs: DataFrame) -> DataFrame:
    """docs, all columns, with text without the lines of recurring templates, and n_lines and n_dropped added.

    Columns of docs with the added names are replaced. Null text is one empty line and becomes empty; a document may lose all its lines.
    Blank lines always stay. Rows that repeat a doc_id are one document when templates are counted, rows without one are none, but lose
    the lines of templates that recur elsewhere. Long texts count whole. An empty table stays empty.
    """
    docs = docs.drop("n_lines", "n_dropped")
    found = recurring_lines(docs.select("doc_id", "text"))
    # The text travels once.
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    lines = keyed.select("doc_id", "text_hash", F.posexplode(lines_of("text")).alias("place", "line")).select("doc_id", "text_hash", "place", F.xxhash64("line").alias("line_hash"))
    gone = lines.join(found, "line_hash").groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.collect_set("place").alias("gone"))
    joined = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left").withColumn("lines", lines_of("text"))
    stays = F.array_join(F.filter("lines", lambda x, k: ~F.array_contains("gone", k)), "\n")
    left = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(stays).alias("text")
    kept = [left if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return joined.select(*kept, F.size("lines").cast("long").alias("n_lines"), F.greatest(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_templates(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
distinct_lines AS (SELECT line, count(DISTINCT doc_id) AS weight FROM lines GROUP BY line),
words AS (SELECT *, list_transform(string_split(line, ' '), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS w FROM distinct_lines),
leaved AS (SELECT line, weight, w, len(w) AS n, len(list_filter(w, lambda x: x <> '')) AS full_words, w[1:{LEAD}] AS lead FROM words WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
leaves AS (SELECT n, lead, sum(weight) AS n_lines FROM leaved GROUP BY ALL),
places AS (SELECT line, weight, n, lead, unnest(w[{LEAD + 1}:]) AS word, generate_subscripts(w[{LEAD + 1}:], 1) AS place FROM leaved),
levels(level, share) AS (VALUES {", ".join(f"({k}, {share})" for k, share in enumerate(LEVELS))}),
common AS (SELECT n, lead, level, place, word FROM (SELECT n, lead, place, word, sum(weight) AS found FROM places WHERE word NOT IN ('', '<*>') GROUP BY ALL) JOIN leaves USING (n, lead) JOIN levels ON level > 0 AND 100 * found > share * n_lines),
kept AS (SELECT p.line, level, string_agg(p.place || ':' || p.word, ' ' ORDER BY p.place) AS rest, count(*) AS n_rest FROM places p JOIN common c ON p.n = c.n AND p.lead = c.lead AND p.place = c.place AND p.word = c.word GROUP BY p.line, level),
template AS (SELECT l.line, n, lead, v.level, CASE v.level WHEN 0 THEN array_to_string(w, ' ') ELSE coalesce(rest, '') END AS rest,
    CASE v.level WHEN 0 THEN len(list_filter(w, lambda x: x NOT IN ('', '<*>'))) ELSE len(list_filter(lead, lambda x: x NOT IN ('', '<*>'))) + coalesce(n_rest, 0) END AS fixed, full_words
  FROM leaved l CROSS JOIN levels v LEFT JOIN kept k ON k.line = l.line AND k.level = v.level),
items AS (SELECT line, list(place || ':' || word ORDER BY place) AS items FROM places WHERE word NOT IN ('', '<*>') GROUP BY line),
open AS (SELECT l.line, l.n, l.lead, 100 + place AS level, array_to_string(list_filter(items, lambda x: x <> place || ':' || word), ' ') AS rest, len(list_filter(l.lead, lambda x: x NOT IN ('', '<*>'))) + len(items) - 1 AS fixed, full_words
  FROM leaved l JOIN items USING (line) JOIN places p ON p.line = l.line WHERE word NOT IN ('', '<*>')),
strong AS (SELECT * FROM (SELECT * FROM template UNION ALL SELECT * FROM open) WHERE 100 * fixed >= {CONSTANT} * full_words),
often AS (SELECT n, lead, level, rest FROM strong JOIN lines USING (line) GROUP BY ALL HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
recurring AS (SELECT DISTINCT line FROM strong JOIN often USING (n, lead, level, rest))
SELECT doc_id, count(*) AS n_lines, count(r.line) AS n_dropped, sha256(coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE r.line IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN recurring r ON l.line = r.line GROUP BY doc_id
"""
