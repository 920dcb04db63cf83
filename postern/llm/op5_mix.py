"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

A document's size is its number of words.  Sources, ordered by code point with null last, weigh 5, 2, 1, repeating;
the targets share the sum of all sizes by weight, none above 3 times its source's size (the excess goes to the others
by weight).  A target of e whole source sizes and a rest takes every document e times; the rest goes to a prefix of
the documents in the order of their keys -ln(u) / w, u from a hash of doc_id and w the document's quality weight.
The prefix is the one whose sum comes nearest to the rest, so a source misses its target by half a document at most.

The prefix sum is never taken over a whole source: sizes are summed over 512 ranges of the key, then over 512 ranges
of the one range that holds the boundary, and rows are ordered in the last one alone.  Rows meet the targets by
(source, range), so a source with a third of all rows is 512 keys.  One row per source (not per document) is ranked
in one task.

Defined results: null or wordless texts have size 0 and are taken 0 times; null source is a source, the last; a row without
doc_id has its key from its text; equal rows are taken in any order, which does not show; a source of
size 0 has target 0; an empty table gives an empty one; other columns are not looked at.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common as C

RANGES = 512
#: The least quality weight.
LEAST = 1.0 / 21.0
GAP = r"[\x20\x09-\x0D]+"
JUNK = "#$%&*|!"


def quality_weight(text: Column) -> Column:
    """1 for clean text, towards 1/21 as the share of the characters #$%&*|! grows."""
    n = F.length(text)
    junk = n - F.length(F.translate(text, JUNK, ""))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * F.when(n > 0, junk / n).otherwise(F.lit(0.0)))


def uniform(name: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(per_source: DataFrame, cycle: tuple[int, ...], cap: int) -> DataFrame:
    """source_key, source, source_size -> and target; one row for each source."""
    rank = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(cycle))) + 1).cast("int"))
    w = per_source.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), "source_key")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("total", F.sum("source_size").over(every).cast("double"))
    w = w.withColumn("most_before", F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("weight_from", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("total") - F.col("most_before")) / F.col("weight_from")
    w = w.withColumn("level", level).withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    w = w.withColumn("water", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
    return w.select("source_key", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * F.col("water")).alias("target"))


def mix(docs: DataFrame, cycle: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix", weight: Column | None = None, row: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, and row (the whole number that the column ``row`` holds, else null): one
    row for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id", "source",
        (F.col(f"`{row}`") if row else F.lit(None)).cast("long").alias("row"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("source_key"),
        C.n_words(text, GAP).alias("size"),
        (-F.log(uniform(F.coalesce(F.col("doc_id").cast("string"), F.md5(text)), seed)) / (quality_weight(text) if weight is None else weight)).alias("key"))
    # keys of weights from LEAST to 1 spread over all ranges: none holds more than 1 / LEAST times its even share
    fine = F.least(F.lit(RANGES * RANGES - 1), F.floor((F.lit(1.0) - F.exp(-F.col("key") * F.lit(LEAST))) * F.lit(RANGES * RANGES))).cast("int")
    rows = C.cut(sized.withColumn("fine", fine).withColumn("coarse", F.floor(F.col("fine") / RANGES).cast("int")), "sized")
    cells = rows.groupBy("source_key", "coarse").agg(F.min("source").alias("source"), F.sum("size").alias("cell"))
    cells = C.cut(cells, "cells")
    goal = targets(cells.groupBy("source_key").agg(F.min("source").alias("source"), F.sum("cell").alias("source_size")), cycle, cap)
    size = F.col("source_size").cast("double")
    epochs = F.when(size > 0, F.least(F.lit(cap), F.floor(F.col("target") / size + F.lit(1e-12)))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * size))
    before = F.coalesce(F.sum("cell").over(Window.partitionBy("source_key").orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grid = cells.withColumn("before", before).join(goal, "source_key").select(
        "source_key", "coarse", "source_size", "target", "epochs",
        (F.col("rest") - F.col("before")).alias("left"),
        ((F.col("before") < F.col("rest")) & (F.col("before") + F.col("cell") > F.col("rest"))).alias("edge"))
    rows = rows.join(C.cut(grid, "grid"), ["source_key", "coarse"])
    edge = C.cut(rows.filter("edge"), "edge")
    cells = edge.groupBy("source_key", "fine").agg(F.sum("size").alias("cell"))
    before = F.coalesce(F.sum("cell").over(Window.partitionBy("source_key").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = edge.join(cells.withColumn("before2", before), ["source_key", "fine"])
    order = Window.partitionBy("source_key", "fine").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("left") - F.col("before2")
    middle = F.col("size") / 2 + F.when((left > 0) & (F.col("cell") > left), F.coalesce(F.sum("size").over(order), F.lit(0))).otherwise(F.lit(0))
    chosen = F.when(F.col("cell") <= left, F.lit(1)).when(left <= 0, F.lit(0)).otherwise((middle <= left).cast("int"))
    columns = ["doc_id", "size", "source_size", "target", "row"]
    plain = rows.filter("not edge").select(*columns, (F.col("size") * (F.col("epochs") + (F.col("left") > 0).cast("int"))).alias("taken"))
    return plain.union(within.select(*columns, (F.col("size") * (F.col("epochs") + chosen)).alias("taken")))


def take(docs: DataFrame, **options) -> DataFrame:
    """Every row of docs as often as the mix takes it; options are those of ``mix``."""
    row, times = "_row", "_times"
    while {row, times} & set(docs.columns):
        row, times = row + "_", times + "_"
    numbered = C.cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    taken = mix(numbered, row=row, **options).filter("taken > 0").select(F.col("row").alias(row), (F.col("taken") / F.col("size")).cast("int").alias(times))
    often = numbered.join(taken, row)
    return often.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(row)).drop(row)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(C.table(spark, sf_dir, "documents")).drop("row")


QUERIES = {"op5_mix_sources": op5_mix_sources}
ORACLE = {"op5_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         -ln((CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
           / (1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * CASE WHEN length(text) > 0
              THEN (length(text) - length(translate(text, '#$%&*|!', '')))::DOUBLE / length(text)::DOUBLE ELSE 0.0::DOUBLE END)) AS key
  FROM documents),
per AS (SELECT source, sum(size)::DOUBLE AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM per),
levels AS (
  SELECT *, 3 * source_size AS most,
         ((SELECT sum(source_size) FROM per) - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goal AS (
  SELECT source, source_size, CASE WHEN most <= level * weight THEN most
         ELSE weight * (SELECT max(level) FROM levels WHERE most > level * weight) END AS target FROM levels),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size + 1e-12)) ELSE 0 END AS epochs FROM goal),
ordered AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.epochs, greatest(0, g.target - g.epochs * g.source_size) AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN parts g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (epochs + CASE WHEN before + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered"""}
