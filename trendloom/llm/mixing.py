"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source expects target / source size copies. Documents are put in an order within
their source, expected copies are prefix-summed in it, one random offset per source is added, and a
document is emitted once for each integer that the sum crosses at it. The order goes through every other size class
upwards and through the rest downwards, so that documents of all sizes are taken alike and a source's words come
near its target whatever the offset.

No source is ever one group: documents fall into buckets (source, size class, salt), a salt being the doc_id's
hash modulo a number that grows with the table; positions are counted inside buckets, and the buckets' counts, not the
documents, are prefix-summed per source. Words are counted once, into a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import materialize

#: Salts at least, and the rows of the table to a salt beyond that.
SALTS = 32
SALT_ROWS = 1 << 18
#: Every other size class comes on the way back, so that what the offset errs upwards it errs back downwards.
TURN = 4000
#: No source's target exceeds so many times its size.
MOST = 3
WEIGHTS = 3
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """Adds `target` to `sources(key, missing, source_size)`, a row per source.

    Weights 1, 2, 3, repeating, go to the sources by code point, the null source last. A target is
    the weight's share of all sizes; where that exceeds MOST times the source's size it stops there
    and the excess is shared again. The result is least(cap, level * weight) at the level that
    spends all: sorted by cap / weight, the capped sources come first, so prefix sums give it.
    The windows hold one row per source, never documents.
    """
    total = Window.partitionBy()
    ranked = sources.withColumn("weight", ((F.row_number().over(Window.orderBy("missing", "key")) - 1) % WEIGHTS + 1).cast("double"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * MOST).cast("double"))
    before = Window.orderBy((F.col("cap") / F.col("weight")), "missing", "key").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = ranked.withColumn("level", level)
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    # the level only rises while sources are capped, so the first that fits is the least one after them
    at = F.min(F.when(free.isNotNull(), F.struct(F.col("cap") / F.col("weight"), "missing", "key", "level"))).over(total)["level"]
    spread = levels.withColumn("target", F.least(F.col("cap"), at * F.col("weight")))
    return spread.select("key", "missing", "source_size", "target")


def _sized(docs: DataFrame, carry: list[str]) -> DataFrame:
    """`row` (the columns `carry`), `doc_id`, `mark` (the text's hash), `key`, `missing`, `size`, `class`, `salt`, written down."""
    size = size_of(F.col("text"))
    # leading four bits of the size and how many follow
    kind = (F.length(F.bin("size")) * 16 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))")).cast("int")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"),
        F.coalesce("source", F.lit("")).alias("key"), F.col("source").isNull().alias("missing"), size.alias("size"),
        F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), "text", F.lit(""))), 1, 8), 16, 10).cast("long").alias("hash"))
    rows = materialize(rows.withColumn("class", F.when(kind % 2 == 0, kind).otherwise(TURN - kind)), "sized")
    salts = max(SALTS, -(-rows.count() // SALT_ROWS))
    return rows.withColumn("salt", (F.col("hash") % salts).cast("int")).drop("hash")


def with_copies(docs: DataFrame, carry: list[str]) -> DataFrame:
    """`row` (the columns `carry` of `docs`), `doc_id`, `size`, `source_size`, `target`, `copies` of every row.

    `docs` needs doc_id, text and source; null text has size 0, null source is a source of its own,
    a null doc_id sorts first. Rows that repeat are documents of their own. Nothing in, nothing out.
    """
    rows = _sized(docs, carry)
    bucket = ["key", "missing", "class", "salt"]
    counts = rows.groupBy(*bucket).agg(F.count("*").alias("n"), F.sum("size").alias("bucket_size"))
    goals = targets(counts.groupBy("key", "missing").agg(F.sum("bucket_size").alias("source_size")))
    ahead = Window.partitionBy("key", "missing").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n", "bucket_size")
    starts = starts.join(goals, ["key", "missing"])
    inside = Window.partitionBy(*bucket).orderBy("size", "doc_id", "mark")
    placed = rows.withColumn("place", F.row_number().over(inside)).join(starts, bucket)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    name = F.concat(F.lit(f"{SEED}:"), F.when(F.col("missing"), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("key"))))
    offset = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / float(1 << 32)
    position = F.col("ahead") + F.col("place")
    placed = placed.withColumns({"expected": expected, "offset": offset, "position": position})
    copies = F.floor(F.expr("position * expected + offset")) - F.floor(F.expr("(position - 1) * expected + offset"))
    return placed.select("row", "doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    """`doc_id, size, source_size, target, taken` of every row of `docs`: the words that the mix takes of it, repeats counted."""
    placed = with_copies(docs, ["doc_id"])
    return placed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken, with its own columns."""
    return with_copies(docs, docs.columns).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


#: DuckDB's statement of `mix_report`.
MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS key, source IS NULL AS missing, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 8)) AS BIGINT) AS hash,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
c AS (
  SELECT *, length(CASE WHEN size = 0 THEN '0' ELSE ltrim(bin(size), '0') END) AS bits FROM d),
b AS (
  SELECT *, CASE WHEN kind % 2 = 0 THEN kind ELSE {TURN} - kind END AS class,
         hash % greatest({SALTS}, (SELECT CAST(ceil(count(*) / {SALT_ROWS}) AS BIGINT) FROM documents)) AS salt
  FROM (SELECT *, bits * 16 + (size >> greatest(bits - 4, 0)) AS kind FROM c)),
s AS (
  SELECT key, missing, CAST(sum(size) AS BIGINT) AS source_size FROM b GROUP BY key, missing),
w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY missing, encode(key)) - 1) % {WEIGHTS} + 1 AS DOUBLE) AS weight,
         CAST(source_size * {MOST} AS DOUBLE) AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / weight, missing, encode(key) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (
  SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, missing, encode(key) LIMIT 1),
t AS (
  SELECT key, missing, source_size, least(cap, (SELECT level FROM a) * weight) AS target,
         CAST(('0x' || substr(md5('{SEED}:' || CASE WHEN missing THEN 'null' ELSE '=' || key END), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS shift
  FROM l),
p AS (
  SELECT doc_id, size, source_size, target, shift,
         row_number() OVER (PARTITION BY b.key, b.missing ORDER BY class, salt, size, doc_id) AS position,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS expected
  FROM b JOIN t ON b.key = t.key AND b.missing = t.missing)
SELECT doc_id, size, source_size, target,
       CAST(floor(position * expected + shift) - floor((position - 1) * expected + shift) AS BIGINT) * size AS taken
FROM p
"""
