"""Aggregations: noisy-or, modes with a tie rule, capped scores, histograms, agreement of two partitions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def noisy_or(rows: DataFrame, by: list[str], family: str, strength: str) -> DataFrame:
    """1 - prod(1 - s) over the largest strength of each family."""
    most = rows.groupBy(*by, family).agg(F.max(strength).alias("_s"))
    return most.groupBy(*by).agg((F.lit(1.0) - F.product(F.lit(1.0) - F.col("_s"))).alias("score"), F.count("*").alias("families"))


def mode_first_seen(rows: DataFrame, by: str, value: str, seen: str) -> DataFrame:
    """The most frequent value of each group; of equals, the one seen first."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"), F.min(seen).alias("_first"))
    best = counts.groupBy(by).agg(F.max_by(F.struct(value, "_n"), F.struct("_n", -F.col("_first"))).alias("_b"))
    return best.select(by, F.col(f"_b.{value}").alias("mode"), F.col("_b._n").alias("n"))


def capped_score(rows: DataFrame, id_: str, category: str, weight: str, caps: dict[str, float], bias: float = -2.6, default: float = 2.0) -> DataFrame:
    """Logistic score of the sums by category, each no more than its cap."""
    cap = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col(category)), F.lit(default))
    sums = rows.groupBy(id_, category).agg(F.sum(weight).alias("_s")).withColumn("_s", F.least("_s", cap))
    x = F.sum("_s") + F.lit(bias)
    return sums.groupBy(id_).agg(F.round(F.lit(100.0) / (F.lit(1.0) + F.exp(-x))).cast("int").alias("score"), F.round(x, 6).alias("logit"))


#: Widths of a timeline's buckets in milliseconds: 1 h, 6 h, 1, 7, 30 and 365 days.
WIDTHS = [3_600_000, 21_600_000, 86_400_000, 604_800_000, 2_592_000_000, 31_536_000_000]


def timeline(rows: DataFrame, at: str, most: int = 60) -> DataFrame:
    """Counts by bucket of the least width that needs ``most`` buckets at most; empty buckets are there, too."""
    span = rows.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    need = lambda w: F.floor(F.col("hi") / w) - F.floor(F.col("lo") / w) + 1
    width = F.coalesce(*[F.when(need(w) <= most, F.lit(w)) for w in WIDTHS], F.lit(WIDTHS[-1])).cast("long")
    span = span.filter("lo is not null").withColumn("width", width)
    grid = span.select("width", F.explode(F.sequence(F.floor(F.col("lo") / F.col("width")), F.floor(F.col("hi") / F.col("width")))).alias("slot"))
    widths = F.broadcast(span.select("width"))  # one row
    counts = rows.join(widths).groupBy(F.floor(F.col(at) / F.col("width")).alias("slot")).agg(F.count("*").alias("n"))
    return grid.join(counts, "slot", "left").select((F.col("slot") * F.col("width")).alias("start"), "width", F.coalesce("n", F.lit(0)).alias("n"))


def pairs_of(n: Column) -> Column:
    return n * (n - 1) / 2


def agreement(rows: DataFrame, found: str, truth: str) -> DataFrame:
    """Pairwise precision, recall, F1 and the adjusted Rand index of two partitions, from their contingency counts."""
    cells = rows.groupBy(found, truth).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(pairs_of(F.col("n"))).alias("both"), F.sum("n").alias("rows"))
    ours = cells.groupBy(found).agg(F.sum("n").alias("n")).agg(F.sum(pairs_of(F.col("n"))).alias("ours"))
    real = cells.groupBy(truth).agg(F.sum("n").alias("n")).agg(F.sum(pairs_of(F.col("n"))).alias("real"))
    one = both.crossJoin(ours).crossJoin(real)  # three single rows
    expected = F.col("ours") * F.col("real") / pairs_of(F.col("rows"))
    precision, recall = F.col("both") / F.col("ours"), F.col("both") / F.col("real")
    return one.select(F.round(precision, 9).alias("precision"), F.round(recall, 9).alias("recall"), F.round(2 * precision * recall / (precision + recall), 9).alias("f1"),
                      F.round((F.col("both") - expected) / ((F.col("ours") + F.col("real")) / 2 - expected), 9).alias("ari"))


def quantiles(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """The value at index floor(n * share) of the sorted values, without interpolation: found by counts of distinct values."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    block = F.floor(F.col(value) / 10)
    per = counts.groupBy(block.alias("_b")).agg(F.sum("_n").alias("_m"))
    per = per.withColumn("_before", F.sum("_m").over(Window.orderBy("_b")) - F.col("_m")).withColumn("_all", F.sum("_m").over(Window.partitionBy()))
    inner = counts.withColumn("_b", block).join(per, "_b").withColumn("_to", F.col("_before") + F.sum("_n").over(Window.partitionBy("_b").orderBy(value)))
    return inner.select(F.explode(F.array(*[F.lit(s) for s in shares])).alias("share"), value, "_to", "_all").filter(F.col("_to") > F.floor(F.col("_all") * F.col("share"))).groupBy("share").agg(F.min(value).alias("value"))
