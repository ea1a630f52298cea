"""Mixing sources to target weights, in DataFrame functions only.

Targets come from capped water-filling: every source gets words in proportion to its weight, a source stops at its
cap of epochs, and what it can't take is shared again by weight. The closed form needs one sorted pass over sources:
they fill up in the order of cap to weight, and the first that doesn't fill sets the level of all that follow.

A source's documents are then taken in a seeded order: whole repetitions of all of them, and one more of the documents
at the front of the order, the last of these in part, so that the words taken meet the target. No source is sorted as a
whole: documents fall into 4096 buckets by the seeded digest, a bucket's sum decides whether all or nothing of it is
taken, and only the one bucket per source where the target falls is put in order. A source may hold any share of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, count_words, words

#: Weights of sources in code point order, repeating; words to take as a share of all; most epochs of a source; seed.
WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2, 42
#: Hexadecimal digits of the digest that name a bucket.
DIGITS = 3


def seeded(seed: int) -> Column:
    """The place of a document in its source's order. Depends on doc_id alone, or the text where there is none, so that reruns agree."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))).cast("binary"))


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """docs as column row, with its source, size and order."""
    row = docs.select(F.struct("*").alias("row"), "source", count_words(F.col("text")).alias("size"), seeded(seed).alias("place"))
    return row.withColumn("bucket", F.substring("place", 1, DIGITS))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size and target for rows of source and source_size: one row a source, never one a document."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("at", F.row_number().over(order) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")))
    capped = weighed.withColumn("cap", F.col("source_size") * epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    fill = Window.orderBy("ratio", "at").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", "at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("ratio", "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(fill), F.lit(0))) / F.sum("weight").over(rest)
    levelled = capped.withColumn("level", level).withColumn("open", F.when(F.col("level") <= F.col("ratio"), F.col("level")))
    first = levelled.withColumn("level", F.first("open", ignorenulls=True).over(everything))
    full = F.col("cap").cast("double")
    target = F.least(full, F.coalesce(F.col("level") * F.col("weight"), full))
    return first.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...], share: float, epochs: int, seed: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """For each source: source_size, target, whole repetitions, extra words and, where these end, a bucket and what is
    still wanted in it. For each row of docs: row, source, size, place, bucket."""
    rows = sized(docs, seed)
    by_bucket = scratch.keep(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    goal = targets(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("whole", whole).withColumn("extra", F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = by_bucket.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    ends = ends.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    last = ends.where("before < extra AND extra <= before + words").select(F.col("source").alias("b"), F.col("bucket").alias("end"), (F.col("extra") - F.col("before")).alias("wanted"))
    both = goal.join(last, F.col("source").eqNullSafe(F.col("b")), "left").select(F.col("source").alias("s"), "source_size", "target", "whole", "extra", "end", "wanted")
    return scratch.keep(both), rows


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Each row of docs as struct row, with size, source_size, target and taken, the words that the mix takes of it.

    A null text has no words; a null source is a source, the last; empty texts take nothing; rows that share a doc_id
    follow each other by size, and rows alike in both are alike in the result but for which of them the extra words end in;
    no rows give no rows. Other columns, whatever their names, ride along in row.
    """
    goal, rows = plan(docs, weights, share, epochs, seed, scratch := Scratch(docs.sparkSession, "mixing"))
    del scratch
    # one row a source: Spark broadcasts it while its measured size is below the session's threshold and splits hot sources beyond
    met = rows.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    at_end = F.col("bucket").eqNullSafe(F.col("end")) & F.col("end").isNotNull()
    extra = F.when(F.col("end").isNotNull() & (F.col("bucket") < F.col("end")), F.col("size")).otherwise(F.lit(0).cast("long"))
    far = met.where(~at_end).withColumn("more", extra)
    before = Window.partitionBy("source").orderBy("place", "row.doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("wanted") - F.coalesce(F.sum("size").over(before), F.lit(0))
    near = met.where(at_end).withColumn("more", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left)))
    out = far.unionByName(near)
    return out.select("row", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: docs' columns, a row for each repetition and its number (from 1); the last of a document may be a
    part, its first words. Documents of which nothing is taken go, and so do null and empty texts; n_chars, if there, follows a
    cut text. The number's column is repetition, with as many underscores after it as docs' own columns make necessary.
    Nulls, ties, repeated rows and tables without rows are as in taken()."""
    number = "repetition"
    while number.lower() in map(str.lower, docs.columns):
        number += "_"
    t = taken(docs, **how).where("taken > 0")
    text, size = F.col("row.text"), F.col("size")
    each = t.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / size).cast("int"))))
    part = F.col("taken") - (F.col("repetition") - 1) * size
    cut = F.when(part >= size, text).otherwise(F.array_join(F.slice(words(text), F.lit(1), F.greatest(F.lit(1), F.least(part, size)).cast("int")), " "))
    kept = [
        cut.alias(c) if c == "text" else F.when(part >= size, F.col("row.n_chars")).otherwise(F.length(cut)).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ]
    return each.select(*kept, F.col("repetition").alias(number))


def query(docs: DataFrame) -> DataFrame:
    return taken(docs).select("row.doc_id", "size", "source_size", "target", "taken")


def oracle() -> str:
    """The same for DuckDB, which sorts each source as a whole."""
    w = ", ".join(map(str, WEIGHTS))
    return rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS place
  FROM documents
), weighed AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT AS pos,
         ([{w}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::BIGINT] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)
), levelled AS (
  SELECT *, source_size * {EPOCHS} AS cap, source_size * {EPOCHS} / weight AS ratio,
         ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(source_size * {EPOCHS}) OVER before, 0)) / sum(weight) OVER rest AS level
  FROM weighed
  WINDOW before AS (ORDER BY source_size * {EPOCHS} / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY source_size * {EPOCHS} / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), goal AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT arg_min(level, (ratio, pos)) FROM levelled WHERE level <= ratio) * weight, cap::DOUBLE)) AS target
  FROM levelled
), shared AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM goal
), ordered AS (
  SELECT doc_id, size, source_size, target, whole, floor(target + 0.5)::BIGINT - whole * source_size AS extra,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN shared g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, extra - before)))::BIGINT AS taken FROM ordered"""
