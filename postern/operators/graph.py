"""Graph operators on edge tables (a, b[, weight]): components, neighbourhoods, degrees, modularity, communities."""
from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's folder, or (where none is set, as in tests) in one of its own."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="postern-"))
    return df.checkpoint()


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """id, component (the smallest id reachable), by alternating large and small stars."""
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    for _ in range(most):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select("m", F.col("b").alias("u")).filter("m <> u").distinct()
        least = large.groupBy("u").agg(F.min("m").alias("n"))
        small = large.join(least, "u").select(F.col("n").alias("a"), F.col("m").alias("b")).union(least.select(F.col("n").alias("a"), F.col("u").alias("b"))).filter("a <> b").distinct()
        now = cut(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")).union(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
        before = state
    raise RuntimeError("components did not settle")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """id, hops: what lies within depth steps (1 to 3) of the seeds."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = seeds.select("id").distinct().withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        reach = seen.filter(F.col("hops") == hop - 1).join(both, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        seen = seen.union(reach.join(seen, "id", "left_anti").withColumn("hops", F.lit(hop)))
    return seen


def min_degree(edges: DataFrame, least: int) -> DataFrame:
    """Edges whose ends both have the degree."""
    fine = degrees(edges).filter(F.col("degree") >= least).select("id")
    return edges.join(fine.withColumnRenamed("id", "a"), "a", "left_semi").join(fine.withColumnRenamed("id", "b"), "b", "left_semi")


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Q of the partition (id, part) of a weighted graph (a, b, weight)."""
    side = lambda c, name: parts.select(F.col("id").alias(c), F.col("part").alias(name))
    e = edges.join(side("a", "pa"), "a").join(side("b", "pb"), "b")
    ends = e.select(F.col("pa").alias("part"), "weight").union(e.select(F.col("pb").alias("part"), "weight")).groupBy("part").agg(F.sum("weight").alias("d"))
    inside = e.filter("pa = pb").groupBy(F.col("pa").alias("part")).agg(F.sum("weight").alias("w"))
    total = edges.agg(F.sum("weight").alias("m"))  # one row
    return ends.join(inside, "part", "left").crossJoin(total).agg(F.round(F.sum(F.coalesce("w", F.lit(0.0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), F.lit(2.0))), 9).alias("modularity"))


def louvain_part(a: np.ndarray, b: np.ndarray, w: np.ndarray, m: float, resolution: float = 1.0) -> dict:
    """Communities of one component: nodes move in sorted order while modularity grows, then communities become nodes."""
    names = sorted(set(a) | set(b))
    at = {x: i for i, x in enumerate(names)}
    links: list[dict[int, float]] = [{} for _ in names]
    loops = [0.0] * len(names)
    for x, y, v in zip(a, b, w):
        i, j = at[x], at[y]
        if i == j:
            loops[i] += v
        else:
            links[i][j] = links[i].get(j, 0.0) + v
            links[j][i] = links[j].get(i, 0.0) + v
    member = list(range(len(names)))
    for _ in range(32):
        n = len(links)
        degree = [sum(links[i].values()) + 2 * loops[i] for i in range(n)]
        part, total = list(range(n)), degree[:]
        moved = False
        for _ in range(100):
            changed = False
            for i in range(n):
                near: dict[int, float] = {}
                for j, v in links[i].items():
                    near[part[j]] = near.get(part[j], 0.0) + v
                total[part[i]] -= degree[i]
                gain = lambda c: near.get(c, 0.0) - resolution * total[c] * degree[i] / (2 * m)  # noqa: B023, E731
                best, most = part[i], gain(part[i])
                for c in sorted(near):
                    if gain(c) > most + 1e-12:
                        best, most = c, gain(c)
                total[best] += degree[i]
                if best != part[i]:
                    part[i], changed, moved = best, True, True
            if not changed:
                break
        if not moved:
            break
        order = {c: k for k, c in enumerate(sorted(set(part)))}
        part = [order[c] for c in part]
        grown: list[dict[int, float]] = [{} for _ in order]
        inner = [0.0] * len(order)
        for i in range(n):
            inner[part[i]] += loops[i]
            for j, v in links[i].items():
                if part[i] == part[j]:
                    inner[part[i]] += v / 2
                else:
                    grown[part[i]][part[j]] = grown[part[i]].get(part[j], 0.0) + v
        links, loops = grown, inner
        member = [part[c] for c in member]
    first: dict[int, object] = {}
    for x, c in zip(names, member):
        first.setdefault(c, x)
    return {x: first[c] for x, c in zip(names, member)}


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """id, community (its smallest id) of a weighted graph: components run apart, with the whole graph's weight."""
    total = float(edges.agg(F.sum("weight")).first()[0] or 1.0)
    label = components(edges)
    kind = dict(edges.dtypes)["a"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = louvain_part(group["a"].to_numpy(), group["b"].to_numpy(), group["weight"].to_numpy(), total, resolution)
        return pd.DataFrame({"id": list(found), "community": list(found.values())})

    return edges.join(label.withColumnRenamed("id", "a"), "a").groupBy("component").applyInPandas(run, f"id {kind}, community {kind}")
