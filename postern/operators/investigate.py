"""The investigation graph and the catalogue's case queries, over analysed messages, observations and clusters."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from postern.operators import graph

#: A message's rank by class in the order in which a cut graph keeps nodes.
CLASS_RANK = {"malicious": 800, "suspicious": 700, "inconclusive": 450, "failed": 400, "benign": 300}


def nodes_and_edges(rows: DataFrame, obs: DataFrame, clusters: DataFrame | None = None, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (id, kind, label, priority) and edges (a, b, kind, weight) of messages, what they show, and their clusters."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in CLASS_RANK.items() for x in kv]), F.col("class"))
    messages = rows.select(F.concat(F.lit("message:"), "message_id").alias("id"), F.lit("message").alias("kind"), F.col("subject").alias("label"), (F.coalesce(rank, F.lit(300)) * 1000 + F.col("score")).cast("double").alias("priority"))
    key = F.concat(F.col("type"), F.lit(":"), F.col("value"))
    links = obs.select(F.concat(F.lit("message:"), "message_id").alias("a"), key.alias("b"), F.col("role").alias("kind"), F.lit(1.0).alias("weight")).groupBy("a", "b", "kind").agg(F.max("weight").alias("weight"))
    degree = links.groupBy("b").agg(F.countDistinct("a").alias("degree"))
    shown = obs.select(key.alias("id"), F.col("type").alias("kind"), F.col("value").alias("label")).distinct().join(degree.withColumnRenamed("b", "id"), "id").select("id", "kind", "label", (100 + 50 * F.col("degree")).cast("double").alias("priority"))
    nodes, edges = messages.union(shown), links
    if clusters is not None and members is not None:
        named = clusters.select("community", "cluster_id", "size")
        nodes = nodes.union(named.select(F.concat(F.lit("cluster:"), "cluster_id"), F.lit("cluster"), F.col("cluster_id"), (F.lit(1_000_000.0) + F.col("size"))))
        edges = edges.union(members.join(named, "community").select(F.concat(F.lit("message:"), "id"), F.concat(F.lit("cluster:"), "cluster_id"), F.lit("member"), F.lit(1.0)))
    return nodes, edges


def view(nodes: DataFrame, edges: DataFrame, limit: int = 500, least_degree: int = 1, focus: str | None = None, depth: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The part of the graph that is shown: by degree, around a focus, the ``limit`` nodes of highest priority; with the
    number of hidden nodes of each kind."""
    kept = edges if least_degree <= 1 else graph.min_degree(edges, least_degree)
    if focus is not None:
        near = graph.neighbourhood(kept, nodes.filter(F.col("id") == focus).select("id"), depth).select("id")
        nodes = nodes.join(near, "id", "left_semi")
    best = nodes.orderBy(F.desc("priority"), "id").limit(limit)
    hidden = nodes.groupBy("kind").agg(F.count("*").alias("n")).join(best.groupBy("kind").agg(F.count("*").alias("shown")), "kind", "left").select("kind", (F.col("n") - F.coalesce("shown", F.lit(0))).alias("hidden"))
    ids = best.select("id")
    kept = kept.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    return best, kept, hidden


def pivot(obs: DataFrame, kind: str, value: str, rows: DataFrame) -> DataFrame:
    """Messages that show one value, newest first."""
    hit = obs.filter((F.col("type") == kind) & (F.col("value") == value)).select("message_id", "role").distinct()
    return rows.join(hit, "message_id").select("message_id", "role", "subject", "score", "class", "sent_ms").orderBy(F.desc_nulls_last("sent_ms"), "message_id")


def elsewhere(obs: DataFrame, cases: DataFrame, members: DataFrame, user: str, case: str) -> DataFrame:
    """Values of a case that other cases of the user show, too, with the number of those cases."""
    mine = cases.join(members.filter(F.col("user_id") == user).select("case_id").distinct(), "case_id", "left_semi")
    seen = obs.join(mine, "message_id").select("case_id", "type", "value").distinct()
    here = seen.filter(F.col("case_id") == case).select("type", "value")
    return seen.filter(F.col("case_id") != case).join(here, ["type", "value"], "left_semi").groupBy("type", "value").agg(F.countDistinct("case_id").alias("cases"))


def message_list(rows: DataFrame, obs: DataFrame | None = None, classes: list[str] | None = None, text: str | None = None, finding: str | None = None, indicator: tuple[str, str] | None = None, sort: str = "score", page: int = 0, size: int = 50) -> DataFrame:
    """A page of messages under any of the filters, sorted, with a total order."""
    if classes:
        rows = rows.filter(F.col("class").isin(classes))
    if text:
        rows = rows.filter(F.lower(F.concat_ws("\n", "subject", "from_addr", "from_name")).contains(text.lower()))
    if finding:
        rows = rows.filter(F.exists("findings", lambda f: f["id"].startswith(finding)))
    if indicator and obs is not None:
        rows = rows.join(obs.filter((F.col("type") == indicator[0]) & (F.col("value") == indicator[1])).select("message_id").distinct(), "message_id", "left_semi")
    return rows.orderBy(F.desc_nulls_last(sort), F.desc("score"), "message_id").offset(page * size).limit(min(size, 500)).select("message_id", "subject", "from_addr", "score", "class", "severity", "confidence")


def audit_breaks(log: DataFrame) -> DataFrame:
    """Entries (seq, payload, previous, hash) of a hash chain that do not fit what stands before them."""
    before = F.lag("hash").over(Window.orderBy("seq"))
    own = F.sha2(F.concat(F.coalesce("previous", F.lit("")), "payload"), 256)
    return log.withColumn("_before", before).filter((F.col("hash") != own) | ~F.col("previous").eqNullSafe(F.col("_before"))).drop("_before")
