"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, as flat neighbour arrays.

Distinct vectors are dealt to shards of about ``shard_rows`` by a hash; each shard's graph is a row of a table: ids, unit
vectors, and for every layer its nodes and a fixed-width neighbour array.  A node's links are chosen by the diversity
rule from its nearest earlier nodes on the layer, and pruned by the same rule; in a shard of this size a product over
blocks finds these nearest ones faster than a search of the growing graph would, and exactly.  Queries descend greedily
to the bottom layer and search it with a beam of ``ef``; what the shards find is scored again in double precision on the
original vectors, and merged.  Graphs are read where their shard is searched, once for ``PART_ROWS`` queries, and the
query blocks come to them.

Equal vectors are one node; of each the k + 1 smallest ids travel, enough for any query, itself left out.  So copies,
however many, neither crowd a graph nor meet in one task, and ties go to the smaller id.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids;
vectors of different lengths do not meet; rows with the same id and vector count once; rows with the query's id under
another vector are its own, too, and more are looked for in their place; with fewer candidates than k all are returned;
vectors have any length and any finite size; an empty table gives an empty one; columns other than vec_id and embedding are not looked at.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common as C

K, WIDTH, EF, SHARD_ROWS, BLOCK_ROWS, PART_ROWS = 5, 16, 128, 8_192, 256, 16_384
INDEX = "shard long, dim int, ids binary, firsts binary, raw binary, sizes array<int>, nodes binary, links binary"


def _choose(near: np.ndarray, unit: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
    """Of near (most similar first) those closer to the node than to any chosen before; filled up with the rest."""
    if len(near) <= width:
        return near
    among = unit[near] @ unit[near].T
    kept: list[int] = []
    best = np.full(len(near), -2.0, np.float32)  # similarity to what is kept
    for i in range(len(near)):
        if best[i] < sims[i]:
            kept.append(i)
            if len(kept) == width:
                break
            np.maximum(best, among[i], out=best)
    if len(kept) < width:
        mine = set(kept)
        kept += [i for i in range(len(near)) if i not in mine][: width - len(kept)]
    return near[kept]


def build(unit: np.ndarray, seed: int, width: int = WIDTH, candidates: int = 48) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the bottom: nodes, and their neighbour array (rows by node, -1 for none)."""
    n = len(unit)
    rng = np.random.default_rng(seed & ((1 << 63) - 1))
    level = np.floor(-np.log(1 - rng.random(n)) / math.log(width)).astype(int)
    layers = []
    for depth in range(int(level.max(initial=0)) + 1):
        nodes = np.flatnonzero(level >= depth)
        x = unit[nodes]
        cap = 2 * width if not depth else width
        links: list[list[int]] = [[] for _ in nodes]

        def prune(j: int) -> None:
            near = np.array(sorted(set(links[j])))
            sims = x[near] @ x[j]
            order = np.argsort(-sims, kind="stable")
            links[j] = _choose(near[order], x, sims[order], cap).tolist()

        for a in range(0, len(nodes), 256):
            block = x[a: a + 256] @ x[: a + 256].T
            for i in range(max(a, 1), min(a + 256, len(nodes))):
                sims = block[i - a, :i]
                near = np.argpartition(-sims, candidates)[:candidates] if i > candidates else np.arange(i)
                near = near[np.argsort(-sims[near], kind="stable")]
                for j in _choose(near, x, sims[near], width).tolist():
                    links[i].append(j)
                    links[j].append(i)
                    if len(links[j]) > 2 * cap:
                        prune(j)
        flat = np.full((len(nodes), cap), -1, np.int32)
        for i in range(len(nodes)):
            if len(links[i]) > cap:
                prune(i)
            flat[i, : len(links[i])] = links[i]
        layers.append((nodes.astype(np.int32), flat))
    return layers


def search(unit: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], lists: list[list[list[int]]], q: np.ndarray, ef: int) -> list[int]:
    """The up to ef nodes that the beam ends with, nearest first."""
    at = 0  # row of the entry in the layer above
    for depth in range(len(layers) - 1, 0, -1):
        nodes, _ = layers[depth]
        if depth < len(layers) - 1:
            at = int(np.searchsorted(nodes, entry))
        here = float(unit[nodes[at]] @ q)
        while True:
            near = lists[depth][at]
            if not near:
                break
            sims = unit[nodes[near]] @ q
            k = int(sims.argmax())
            if sims[k] <= here:
                break
            at, here = near[k], float(sims[k])
        entry = int(nodes[at])
    if len(layers) == 1:
        entry = 0
    bottom = lists[0]
    seen = bytearray(len(unit))
    seen[entry] = 1
    s = float(unit[entry] @ q)
    todo, found = [(-s, entry)], [(s, -entry)]
    while todo:
        s, node = heapq.heappop(todo)
        if -s < found[0][0] and len(found) >= ef:
            break
        near = [j for j in bottom[node] if not seen[j]]
        if not near:
            continue
        for j, s in zip(near, (unit[near] @ q).tolist()):
            seen[j] = 1
            if len(found) < ef or s > found[0][0]:
                heapq.heappush(todo, (-s, j))
                heapq.heappush(found, (s, -j))
                if len(found) > ef:
                    heapq.heappop(found)
    return [-j for _, j in sorted(found, reverse=True)]


def _unit(raw: np.ndarray) -> np.ndarray:
    x = _scaled(raw.astype(np.float64))
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def _graph(shard: pa.RecordBatch) -> pa.RecordBatch:
    ids = shard.column("rep").to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    raw = shard.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)[order]
    layers = build(_unit(raw), int(shard.column("shard")[0].as_py()))
    sizes = [v for nodes, links in layers for v in links.shape]
    return pa.record_batch({
        "shard": shard.column("shard").slice(0, 1), "dim": pa.array([raw.shape[1]], pa.int32()), "ids": pa.array([ids[order].astype("<i8").tobytes()]),
        "firsts": pa.array([shard.column("first").to_numpy(zero_copy_only=False)[order].astype("<i8").tobytes()]),
        "raw": pa.array([raw.astype("<f8").tobytes()]), "sizes": pa.array([sizes], pa.list_(pa.int32())),
        "nodes": pa.array([b"".join(a.tobytes() for a, _ in layers)]), "links": pa.array([b"".join(b.tobytes() for _, b in layers)])})


def valid(vectors: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists("embedding", lambda x: x != 0))


def _shards(nodes: DataFrame, shard_rows: int) -> DataFrame:
    """dim and its number of shards; one row for each length of vectors."""
    return nodes.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("long").alias("shards"))


def index(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A graph row for each shard of nodes (rep, embedding, dim)."""
    dealt = C.hot_join(nodes, _shards(nodes, shard_rows), "dim", "rep")
    return C.by_group(dealt.withColumn("shard", _shard("dim", F.pmod(F.xxhash64("rep"), F.col("shards")))).drop("shards"), "shard", _graph, INDEX)


def _shard(dim: str, number: Column) -> Column:
    return F.xxhash64(dim, number)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that their squares neither overflow nor vanish; their cosines are the same."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


class _Loaded:
    """A shard's graph, ready to be searched."""

    def __init__(self, row: dict) -> None:
        self.raw = _scaled(np.frombuffer(row["raw"], "<f8").reshape(-1, row["dim"]))
        self.ids, self.firsts, self.unit = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["firsts"], "<i8"), _unit(self.raw)
        self.norms = np.sqrt((self.raw * self.raw).sum(1))
        self.layers, a, b = [], 0, 0
        for n, wide in zip(row["sizes"][::2], row["sizes"][1::2]):
            self.layers.append((np.frombuffer(row["nodes"], np.int32, n, a), np.frombuffer(row["links"], np.int32, n * wide, b).reshape(n, wide)))
            a, b = a + 4 * n, b + 4 * n * wide
        self.lists = [[[j for j in r if j >= 0] for r in links.tolist()] for _, links in self.layers]

    def nearest(self, embedding: list[float], need: int, ef: int) -> list[tuple[int, int, float]]:
        """Node, its smallest id and cosine of the ``need`` nearest that a search finds."""
        q = _scaled(np.array(embedding, np.float64)[None])
        near = np.array(search(self.unit, self.layers, self.lists, _unit(q)[0], max(ef, 2 * need)))
        exact = (self.raw[near] @ q[0]) / (self.norms[near] * math.sqrt(float(q[0] @ q[0])))
        return [(int(self.ids[near[i]]), int(self.firsts[near[i]]), float(exact[i])) for i in np.lexsort((self.firsts[near], -exact))[:need]]


def _search_blocks(ef: int):
    """Rows sorted by (shard, part): a graph comes first, and the query blocks that search it follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, at = None, None
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if row["queries"] is None:
                    graph, at = _Loaded(row), (row["shard"], row["part"])
                    continue
                if at != (row["shard"], row["part"]):
                    continue  # queries of a length that no vector has
                out = [(query["qkey"], *found) for query in row["queries"] for found in graph.nearest(query["embedding"], query["need"], ef)]
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["qkey", "rep", "first", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, ef: int = EF, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row of queries (vec_id, embedding), itself left out."""
    rows = C.cut(valid(vectors).withColumn("dim", F.size("embedding")).distinct(), "vectors")
    order = Window.partitionBy("embedding").orderBy("vec_id")
    copies = C.cut(rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1), "copies")  # limited before the shuffle, too
    nodes = copies.filter("r = 1").select(F.col("vec_id").alias("rep"), "embedding", "dim")
    # an id may stand under several vectors and may be a copy's representative: nodes are named by a number of their own
    nodes = C.cut(nodes.select(F.monotonically_increasing_id().alias("rep"), F.col("rep").alias("first"), "embedding", "dim"), "nodes")
    graphs = C.cut(index(nodes, shard_rows), "graphs")
    asked = C.cut(valid(queries).distinct().withColumn("dim", F.size("embedding")), "asked")
    own = rows.join(asked.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").agg(F.count("*").alias("own"))
    mine = asked.join(own, "vec_id", "left").withColumn("need", (F.lit(k) + F.coalesce("own", F.lit(1))).cast("int"))
    distinct = C.cut(mine.groupBy("embedding").agg(F.max("need").alias("need"), F.min("dim").alias("dim")).withColumn("qkey", F.monotonically_increasing_id()), "distinct")
    number = distinct.count()
    blocks, parts = max(1, -(-number // BLOCK_ROWS)), max(1, -(-number // PART_ROWS))
    packed = distinct.groupBy("dim", F.pmod(F.xxhash64("qkey"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("qkey", "need", "embedding")).alias("queries"))
    # the query set against every shard, block by block: a graph goes out once for PART_ROWS queries, and the queries,
    # which are far smaller, to every graph
    carried = [*graphs.columns[2:]]
    sent = C.hot_join(packed, _shards(nodes, shard_rows), "dim", "block").withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    sent = sent.select(_shard("dim", F.col("number")).alias("shard"), "dim", *[F.lit(None).cast(graphs.schema[c].dataType).alias(c) for c in carried], (F.col("block") % F.lit(parts)).cast("int").alias("part"), "queries")
    kept = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("queries", F.lit(None).cast(packed.schema["queries"].dataType))
    work = kept.unionByName(sent).repartition(F.col("shard"), F.col("part")).sortWithinPartitions("shard", "part", F.col("queries").isNotNull())
    found = work.mapInArrow(_search_blocks(ef), "qkey long, rep long, first long, score double")
    needs = distinct.select("qkey", "need")
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "first", "rep")
    most = F.lit(int(distinct.agg(F.max("need")).first()[0] or k + 1))
    top = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= most).drop("r", "first")
    mates = nodes.select("rep", F.col("embedding").alias("e")).join(copies.select(F.col("embedding").alias("e"), "vec_id"), "e").select("rep", "vec_id")
    top = top.join(mates, "rep")
    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    top = top.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= most).join(needs, "qkey").filter("r <= need")
    lists = top.groupBy("qkey").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    lists = distinct.select("embedding", "qkey").join(lists, "qkey").select("embedding", "near")
    out = C.hot_join(asked, lists, "embedding", "vec_id")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    return out.select(F.col("vec_id").alias("query_id"), F.posexplode(others)).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = C.table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


QUERIES = {"op10_ann": op10_ann}
ORACLE: dict[str, str] = {}
