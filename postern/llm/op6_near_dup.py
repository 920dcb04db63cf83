"""MinHash near-dedup by a chosen-path set similarity join.

A document's set holds the 64-bit hashes of its distinct 4-word shingles (with fewer words: the whole sequence as
one; without words: empty, linked with nothing).  Documents with equal sets form a class, which goes on as one.  Each
of ``TREES`` trees deals the classes by one minwise token.  A node with up to ``leaf`` of them is compared as a whole:
minhash estimates find the clusters of classes that could be linked, each cluster is compared on full sets, and
components come from the verified links alone.

Larger nodes.  First leaders: in blocks of a node, the class that agrees most with the commonest tokens of its cluster
is a centre; up to LEADERS centres of a node that are not near each other lead, and every class of the node is verified
against the MATES of them that it agrees with most.  These links are kept, and give most classes of a group of near copies one label.  Then the classes of
such nodes are dealt once more, by BANDS bands of ROWS tokens; that deal does not look at the node, so it costs a class
the same in however many large nodes it stands.  A band whose classes have one label already has nothing to find and
goes.  Others are compared as a whole or, beyond ``most``, block by block: every class that lacks the band's commonest
label against all of the band.  So nothing is dropped, no task holds more than a block, and a group of n near copies
costs n rows for each leader step, not n * n.

Recall.  Two documents at similarity 0.8 are missed if no tree has them in one node (0.2^8 = 2.6e-6), if that node is
large and no band has them together ((1 - 0.8^3)^20 = 5.9e-7), or if fewer than 77 of their 128 tokens are equal
(7.6e-8): 3.3e-6 in all, whatever the size of a node.

Defined results: a null or empty text, or one of separators only, has n_shingles 0 and is its own component; equal
rows share a component, and so do rows with one doc_id and linked texts, while rows with one doc_id and different texts
are told apart; component_id is the smallest doc_id that is not null in the component, null if there is none; a null
doc_id is kept only where there is none; texts are read whole, and long ones count as several where blocks are dealt;
an empty table gives an empty table; columns other than doc_id and text are not looked at.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as C

#: 16-bit tokens for estimates and bands; 63-bit tokens of the first level, one for each tree.
TOKENS, TREES = 128, 8
#: Bands of the second deal, and the tokens of each.
BANDS, ROWS = 20, 3
#: Leaders of a large node, those that a row is verified against, the trees whose large nodes get them, and the shingles
#: that count as one more row of a block.
LEADERS, MATES, LED_TREES, LONG = 16, 2, 2, 2000
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done: done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


class _Words:
    """Hashes words of a byte buffer by prefix sums of a polynomial modulo 2^64."""

    def __init__(self) -> None:
        self.size = 0
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(data) + 1 > self.size:
            self.size = max(2 * self.size, len(data) + 1, 1 << 16)
            self.up, self.down = _powers(self.size, BASE), _powers(self.size, pow(BASE, -1, 1 << 64))
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=total[1:])
            return _mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))


def shingle_sets(data: np.ndarray, at: np.ndarray, words: _Words, k: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and the n + 1 offsets of the rows."""
    rows = len(at) - 1
    data = _LOWER[data]
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _GAP[data]
    gap_at = gap[1:-1]
    starts_mask = ~gap_at & gap[:-2]
    ends_mask = ~gap_at & gap[2:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    starts_mask[inner] = ~gap_at[inner]  # a new row begins a new word
    ends_mask[inner - 1] = ~gap_at[inner - 1]
    start, end = np.flatnonzero(starts_mask), np.flatnonzero(ends_mask) + 1
    row = np.searchsorted(at, start, side="right") - 1
    n_words = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(n_words)))
    with np.errstate(over="ignore"):
        h = words(data, start, end)
        total = len(h)
        full = np.zeros(total, np.uint64)
        for j in range(k):
            full[: max(0, total - j)] = full[: max(0, total - j)] * np.uint64(0xD6E8FEB86659FD93) + h[j:]
        full = _mix(full)
        in_row = np.arange(total) - first[row] if total else np.zeros(0, np.int64)
        keep = in_row + k <= n_words[row] if total else np.zeros(0, bool)
        value, owner = full[keep], row[keep]
        few = np.flatnonzero((n_words > 0) & (n_words < k))
        if len(few):
            own = np.zeros(len(few), np.uint64)
            for i, r in enumerate(few.tolist()):
                v = np.uint64(n_words[r])
                for x in h[first[r]: first[r + 1]]:
                    v = v * np.uint64(0xA0761D6478BD642F) + x
                own[i] = v
            value, owner = np.concatenate((value, _mix(own))), np.concatenate((owner, few))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[new], owner[new]
    return value, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows)))).astype(np.int64)


def _seeds(tokens: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    return rng.integers(0, 1 << 63, tokens, dtype=np.uint64) << np.uint64(1), rng.integers(0, 1 << 63, tokens, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(value: np.ndarray, at: np.ndarray, tokens: int) -> np.ndarray:
    """A row of 64-bit minwise tokens for each set; empty sets get zeros."""
    xor, mul = _seeds(tokens)
    rows = len(at) - 1
    out = np.zeros((rows, tokens), np.uint64)
    some = np.flatnonzero(np.diff(at))
    if not len(some):
        return out
    at_some = at[some]
    with np.errstate(over="ignore"):
        scratch = np.empty(len(value), np.uint64)
        for j in range(tokens):
            np.bitwise_xor(value, xor[j], out=scratch)
            np.multiply(scratch, mul[j], out=scratch)
            out[some, j] = np.minimum.reduceat(scratch, at_some)
    return out


def sketches(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, class_a and class_b (a 128-bit hash of the set, null for empty sets), roots, tokens, row (the
    whole number that the column ``row`` holds, else null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in C.slices(batches, "text"):
            value, at = shingle_sets(*C.text_buffer(batch.column("text")), words)
            n = np.diff(at)
            a, b = _class(value, at)
            none = n == 0
            drawn = minwise(value, at, TREES + TOKENS)
            roots, tokens = drawn[:, :TREES].astype(np.int64), _mix(drawn[:, TREES:]).astype(np.uint16).view(np.int16)
            ends = np.arange(len(n) + 1, dtype=np.int32)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                "n_shingles": pa.array(n, pa.int64()),
                "class_a": pa.array(a.view(np.int64), pa.int64(), mask=none),
                "class_b": pa.array(b.view(np.int64), pa.int64(), mask=none),
                "roots": pa.ListArray.from_arrays(pa.array(ends * TREES), pa.array(roots.ravel())),
                "tokens": pa.ListArray.from_arrays(pa.array(ends * TOKENS), pa.array(tokens.ravel())),
                "row": batch.column("row"),
            })

    number = F.col(f"`{row}`") if row else F.lit(None)
    schema = "doc_id long, n_shingles long, class_a long, class_b long, roots array<long>, tokens array<smallint>, row long"
    return docs.select("doc_id", "text", number.cast("long").alias("row")).mapInArrow(lambda batches: C.alone(run(batches)), schema)


def _class(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    with np.errstate(over="ignore"):
        return _total(value, at), _total(_mix(value ^ np.uint64(0x5851F42D4C957F2D)), at)


def _total(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    return _mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64))


def full_sets(docs: DataFrame) -> DataFrame:
    """class_a, class_b and the sorted full set as little-endian 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in C.slices(batches, "text"):
            value, at = shingle_sets(*C.text_buffer(batch.column("text")), words)
            a, b = _class(value, at)
            raw = value.astype("<u8").tobytes()
            full = pa.array([raw[8 * x: 8 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
            yield pa.record_batch({"class_a": pa.array(a.view(np.int64)), "class_b": pa.array(b.view(np.int64)), "full": full})

    return docs.select("text").mapInArrow(lambda batches: C.alone(run(batches)), "class_a long, class_b long, full binary")


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _estimated(tokens: np.ndarray, least: float) -> np.ndarray:
    """Labels of the connected clusters of rows whose tokens agree in a share of ``least`` or more."""
    n = len(tokens)
    need = math.ceil(least * tokens.shape[1])
    label = np.arange(n)
    for i in range(n - 1):
        if (label[i:] == label[i]).all():
            continue
        hit = np.flatnonzero(np.count_nonzero(tokens[i + 1:] == tokens[i], axis=1) >= need)
        if len(hit):
            old = np.unique(np.append(label[hit + i + 1], label[i]))
            if len(old) > 1:
                label[np.isin(label, old)] = old[0]
    return label


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The distinct reps of a group, sorted, and their tokens."""
    ids, first = np.unique(batch.column("rep").to_numpy(zero_copy_only=False), return_index=True)
    return ids, batch.column("tokens").flatten().to_numpy().reshape(batch.num_rows, -1)[first]


def _clusters(least: float):
    """In a group: connected clusters of the estimate graph, as (cluster, rep) rows; classes without a partner go."""

    def run(leaf: pa.RecordBatch) -> pa.RecordBatch | None:
        if leaf.num_rows < 2:
            return None
        ids, tokens = _rows(leaf)
        if len(ids) < 2:
            return None
        _, at, size = np.unique(_estimated(tokens, least), return_inverse=True, return_counts=True)
        with np.errstate(over="ignore"):
            name = np.zeros(len(size), np.uint64)
            np.add.at(name, at, _mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
        keep = size[at] > 1
        if not keep.any():
            return None
        return pa.record_batch({"cluster": pa.array(name.view(np.int64)[at][keep]), "rep": pa.array(ids[keep], pa.int64())})

    return run


def _centres(least: float, most: int = 4):
    """In a block of a large node: of each of its ``most`` largest clusters, the row that agrees most with the cluster's
    commonest tokens, weighed by the cluster's size times the agreement."""

    def run(block: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, tokens = _rows(block)
        names, at, size = np.unique(_estimated(tokens, least), return_inverse=True, return_counts=True)
        found = []
        for c in np.argsort(-size, kind="stable")[:most].tolist():
            if size[c] < 2:
                break
            mine = np.flatnonzero(at == c)
            column = np.sort(tokens[mine], axis=0)
            usual = np.empty(tokens.shape[1], tokens.dtype)
            for j in range(tokens.shape[1]):
                value, count = np.unique(column[:, j], return_counts=True)
                usual[j] = value[count.argmax()]
            agree = np.count_nonzero(tokens[mine] == usual, axis=1)
            best = int(agree.argmax())
            found.append((int(ids[mine[best]]), float(size[c]) * float(agree[best])))
        if not found:
            return None
        node = block.column("node")[0].as_py()
        return pa.record_batch({"node": pa.array([node] * len(found), pa.int64()), "rep": pa.array([r for r, _ in found], pa.int64()), "weight": pa.array([w for _, w in found])})

    return run


def _leading(most: int, near: float = 0.8):
    """Of the centres of a node, heaviest first, up to ``most`` that are not near one taken before."""

    def run(centres: pa.RecordBatch) -> pa.RecordBatch:
        reps = centres.column("rep").to_numpy(zero_copy_only=False)
        tokens = centres.column("tokens").flatten().to_numpy().reshape(centres.num_rows, -1)
        taken: list[int] = []
        for i in np.lexsort((reps, -centres.column("weight").to_numpy())).tolist():
            if len(taken) < most and not any(np.count_nonzero(tokens[i] == tokens[j]) >= near * tokens.shape[1] for j in taken):
                taken.append(i)
        return pa.record_batch({"node": centres.column("node").slice(0, len(taken)), "leader": pa.array(reps[taken], pa.int64())})

    return run


def _followers(least: float):
    """In a block of a large node with its leaders: (cluster, rep) rows of each leader and the rows that could be linked to it."""

    def run(block: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, tokens = _rows(block)
        led = np.unique(block.column("rep").to_numpy(zero_copy_only=False)[block.column("leads").to_numpy(zero_copy_only=False)])
        same = np.array([np.count_nonzero(tokens == tokens[at], axis=1) for at in np.searchsorted(ids, led).tolist()])
        if not len(led):
            return None
        # each row goes with the MATES leaders that it agrees with most
        least_same = np.maximum(-np.partition(-same, min(MATES, len(led)) - 1, axis=0)[min(MATES, len(led)) - 1], math.ceil(least * tokens.shape[1]))
        clusters, reps = [], []
        key = np.uint64(block.column("block")[0].as_py() & MASK)
        for leader, row in zip(led.tolist(), same):
            hit = ids[(row >= least_same) | (ids == leader)]
            if len(hit) > 1:
                with np.errstate(over="ignore"):
                    name = _mix(np.array([key], np.uint64) ^ _mix(np.array([leader], np.int64).view(np.uint64)))
                clusters.append(np.repeat(name.view(np.int64), len(hit)))
                reps.append(hit)
        return pa.record_batch({"cluster": pa.array(np.concatenate(clusters)), "rep": pa.array(np.concatenate(reps), pa.int64())}) if reps else None

    return run


def links_of(sets: list[np.ndarray], percent: int = 80) -> list[int]:
    """Smallest index reachable by links with 100 * intersection >= percent * union, for each set; exhaustive, but for
    pairs that are connected already."""
    n = len(sets)
    parent = list(range(n))
    sizes = np.array([len(x) for x in sets])
    at = np.concatenate(([0], np.cumsum(sizes)))
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, np.int32)
    root = np.arange(n)
    for i in range(n - 1):
        # a link needs sizes within the ratio; what is connected already needs no link
        other = np.flatnonzero((root[i + 1:] != root[i]) & (100 * np.minimum(sizes[i], sizes[i + 1:]) >= percent * np.maximum(sizes[i], sizes[i + 1:]))) + i + 1
        if not len(other):
            continue
        mine = codes[at[i]: at[i + 1]]
        mark[mine] = 1
        if 2 * len(other) > n - i:
            both = np.add.reduceat(mark[codes[at[i + 1]:]], at[i + 1: -1] - at[i + 1])[other - i - 1]
        else:
            ends = np.cumsum(sizes[other])
            inside = np.arange(ends[-1]) + np.repeat(at[other] - (ends - sizes[other]), sizes[other])
            both = np.add.reduceat(mark[codes[inside]], ends - sizes[other])
        mark[mine] = 0
        union = sizes[i] + sizes[other] - both
        for j in other[100 * both >= percent * union].tolist():
            a, b = _find(parent, i), _find(parent, j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                root[root == max(a, b)] = min(a, b)
    return [_find(parent, i) for i in range(n)]


def _verify(percent: int):
    def run(cluster: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = cluster.column("rep").to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        full = cluster.column("full")
        ids = ids[order]
        roots = links_of([np.frombuffer(full[i].as_buffer(), "<u8") for i in order.tolist()], percent)
        keep = [i for i, r in enumerate(roots) if r != i]
        return pa.record_batch({"a": pa.array(ids[[roots[i] for i in keep]], pa.int64()), "b": pa.array(ids[keep], pa.int64())}) if keep else None

    return run


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """id and component (the smallest id reachable) of every id in the edges (a < b): alternating large and small stars.

    Each round keeps about as many rows as there are edges, is written to the shared folder, and no key gathers more
    rows than its current degree; the rows of a key are only aggregated, never collected.
    """
    spark = edges.sparkSession
    path = None
    now = edges
    before = None
    for step in range(most):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = C.hot_join(both.filter("v > u"), least, "u", "v").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))  # v < u: each u points at smaller ids
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = C.hot_join(down, least, "u", "v").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a <> b").distinct()
        fresh = C.new_path(spark, f"cc{step}")
        after = C.cut(small, "cc", fresh)
        state = tuple(after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())
        if path:
            C.remove(spark, path)
        path, now = fresh, after
        if state == before or state[0] == 0:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))


def _bands() -> Column:
    """One key for each band of ROWS tokens."""
    return F.array(*[F.xxhash64(F.lit(j), *[F.get("tokens", F.lit(ROWS * j + i)) for i in range(ROWS)]) for j in range(BANDS)])


def _sizes(rows: DataFrame, group: str) -> DataFrame:
    """group, n (its rows) and size (long rows count as several), of groups with two rows or more."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.lit(1) + F.floor(F.col("n_shingles") / LONG)).alias("size")).filter("n > 1")


def _blocks(rows: DataFrame, group: str, most: int) -> DataFrame:
    """rows (group, rep, label, n_shingles) -> (group, rep): groups whose rows have one label go; groups of a size over
    ``most`` are cut into blocks, and every block meets every block of the rows that lack the group's commonest label."""
    labels = rows.groupBy(group, "label").agg(F.count("*").alias("n"), F.sum(F.lit(1) + F.floor(F.col("n_shingles") / LONG)).alias("size"))
    sizes = labels.groupBy(group).agg(F.sum("size").alias("size"), F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("usual"), (F.sum("size") - F.max_by("size", F.struct("n", "label"))).alias("rest")).filter("labels > 1")
    sized = C.cut(C.hot_join(rows, sizes, group, "rep"), f"sized-{group}")
    large = sized.filter(f"size > {most}")
    count = lambda c: F.greatest(F.ceil(F.col(c) / F.lit(most // 2)), F.lit(1)).cast("long")
    own = F.pmod(F.xxhash64(F.lit(99), group, "rep"), count("size"))
    odd = F.pmod(F.xxhash64(F.lit(98), group, "rep"), count("rest"))
    every = large.select(group, "rep", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), count("rest") - 1)).alias("odd"))
    rest = large.filter("label <> usual").select(group, "rep", F.explode(F.sequence(F.lit(0).cast("long"), count("size") - 1)).alias("own"), odd.alias("odd"))
    pairs = every.unionByName(rest).distinct().select(F.xxhash64(group, "own", "odd").alias(group), "rep")
    return sized.filter(f"size <= {most}").select(group, "rep").union(pairs)


def _verified(docs: DataFrame, reps: DataFrame, clusters: DataFrame, percent: int, name: str) -> DataFrame:
    """a < b: links of (cluster, rep) rows, confirmed on the full sets of the reps."""
    wanted = C.cut(reps.join(clusters.select("rep").distinct(), "rep", "left_semi").select("rep", "least_id", "class_a", "class_b"), f"wanted-{name}")
    source = docs.select("doc_id", "text")
    ids = C.cut(wanted.filter("least_id is not null").select(F.col("least_id").alias("doc_id")).distinct(), f"ids-{name}")
    texts = C.semi(source.filter("doc_id is not null"), ids, "doc_id").select("text")
    if wanted.filter("least_id is null").limit(1).count():
        texts = texts.union(source.filter("doc_id is null").select("text"))
    full = full_sets(texts).join(wanted.select("class_a", "class_b", "rep"), ["class_a", "class_b"]).select("rep", "full").dropDuplicates(["rep"])
    return C.cut(C.by_group(clusters.join(full, "rep"), "cluster", _verify(percent), "a long, b long").distinct(), f"edges-{name}")


def linked(docs: DataFrame, percent: int = 80, leaf: int = 1024, least: float = 0.6, most: int = 2048, row: str | None = None) -> DataFrame:
    """doc_id, row, n_shingles, component (a number; null for empty sets) and component_id (its smallest doc_id): one row
    for each row of docs.  See the module's text for the method."""
    rows = C.cut(sketches(docs, row), "sketches")
    sets = rows.filter("n_shingles > 0").groupBy("class_a", "class_b").agg(F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("roots").alias("roots"), F.first("tokens").alias("tokens"))
    reps = C.cut(sets.withColumn("rep", F.monotonically_increasing_id()), "reps")
    known = reps.select("rep", "tokens")
    nodes = reps.select("rep", "n_shingles", F.posexplode("roots")).select(F.xxhash64("pos", "col").alias("node"), "rep", "n_shingles", F.col("pos").alias("tree"))
    sized = C.cut(C.hot_join(nodes, _sizes(nodes, "node"), "node", "rep"), "nodes")
    groups, crowded = sized.filter(f"size <= {leaf}").select("node", "rep"), sized.filter(f"size > {leaf}")
    edges = None
    if crowded.limit(1).count():
        few = C.cut(C.semi(reps, C.cut(crowded.select("rep").distinct(), "crowded"), "rep", most=1_000_000), "few")
        own_tokens = few.select("rep", "tokens")
        blocks = F.ceil(F.col("size") / F.lit(leaf)).cast("long")
        dealt = crowded.filter(f"tree < {LED_TREES}").withColumn("at", F.pmod(F.xxhash64(F.lit(97), "node", "rep"), blocks))
        dealt = C.cut(dealt.select("node", "at", "rep", F.xxhash64("node", "at").alias("block")).join(own_tokens, "rep"), "dealt")
        centres = C.cut(C.by_group(dealt, "block", _centres(least), "node long, rep long, weight double"), "centres")
        leaders = C.cut(C.by_group(centres.join(own_tokens, "rep"), "node", _leading(LEADERS), "node long, leader long"), "leaders")
        led = dealt.select("node", "block").distinct().join(leaders, "node").select("block", F.col("leader").alias("rep")).join(own_tokens, "rep").withColumn("leads", F.lit(True))
        own = dealt.select("block", "rep", "tokens").withColumn("leads", F.lit(False))
        followers = C.by_group(own.unionByName(led), "block", _followers(least), "cluster long, rep long")
        edges = _verified(docs, reps, C.cut(followers, "followers"), percent, "leaders")
        label = components(edges).withColumnRenamed("id", "rep")
        again = few.join(label, "rep", "left")
        again = again.select("rep", "n_shingles", F.coalesce("component", "rep").alias("label"), F.explode(_bands()).alias("node"))
        groups = groups.union(_blocks(again, "node", most))
    clusters = C.cut(C.by_group(groups.join(known, "rep"), "node", _clusters(least), "cluster long, rep long").distinct(), "clusters")
    weighed = clusters.join(reps.select("rep", "n_shingles"), "rep").withColumn("label", F.col("rep"))
    if edges is not None:
        weighed = clusters.join(reps.select("rep", "n_shingles"), "rep").join(label, "rep", "left").select("cluster", "rep", "n_shingles", F.coalesce("component", "rep").alias("label"))
    clusters = C.cut(_blocks(weighed, "cluster", most), "blocks")
    found = _verified(docs, reps, clusters, percent, "clusters")
    joined = components(found if edges is None else C.cut(found.union(edges).distinct(), "edges"))
    named = C.cut(reps.select("class_a", "class_b", "least_id", "rep").join(joined.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "named")
    least_of = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = C.hot_join(named, least_of, "component", "rep").select(F.struct("class_a", "class_b").alias("class"), "component", "component_id")
    out = rows.select("doc_id", "row", "n_shingles", F.when(F.col("n_shingles") > 0, F.struct("class_a", "class_b")).alias("class"))
    out = C.hot_join(out.withColumn("spread", F.xxhash64(F.coalesce("doc_id", F.lit(0)))), of_class, "class", "spread", "left")
    return out.select("doc_id", "row", "n_shingles", "component", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs; options are those of ``linked``."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return linked(docs, **options).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (null last); rows without words all stay."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = C.cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = linked(numbered, row=row, **options)
    first = found.filter("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    stay = first.select(F.col("first.row").alias(row)).union(found.filter("component is null").select(F.col("row").alias(row)))
    return C.semi(numbered, C.cut(stay, "stay"), row, most=1_000_000).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))


QUERIES = {"op6_near_duplicates": op6_near_duplicates}
ORACLE = {"op6_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(0, len(w) - 3), lambda i: array_to_string(w[i + 1:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS c FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id AND r.c < l.b),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept FROM w JOIN m ON m.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""}
