"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays.

Statistics of the whole text (shares of character classes, word lengths, repetition of words, pairs and lines) are
computed for a batch of documents at once.  Trees are grown by depth on 64 quantile bins with the logistic loss, from
at most ``most_rows`` labelled rows (taken in the order of a hash of doc_id; the bound is the size of what the driver
holds), of which none has crc32(doc_id as text) mod 5 = 0.  The ensemble is flat: feature, threshold, left and right
child and value of every node, leaves pointing at themselves; a batch walks all trees by numpy indexing.

Defined results: null and empty texts have statistics of zeros and a score; a null doc_id is not held out; rows of
labels with null doc_id or quality are not learned from, of repeated labels the least counts; without any labelled row
every score is 0.5; equal texts have equal scores; an empty table gives an empty one; columns other than doc_id and
text are not looked at.
"""
from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as C
from .op6_near_dup import _GAP, _Words

MOST_ROWS = 20_000
THRESHOLD = 0.3
FEATURES = 20

_CLASS = np.zeros(256, np.uint8)
for _n, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*@^~", b"|", b"!", b".,;:?", b"\"'()[]{}<>=+/\\_-", b"\n\r", b" \t"), 1):
    _CLASS[list(_chars)] = _n
_CLASS[128:] = 11


def _sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1), np.cumsum(values, dtype=np.float64)))
    return total[at[1:]] - total[at[:-1]]


def _repeats(hashes: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the most frequent one, by row."""
    if not len(hashes):
        return np.zeros(rows), np.zeros(rows)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    starts = np.flatnonzero(new)
    most = np.zeros(rows)
    np.maximum.at(most, o[starts], np.diff(np.append(starts, len(h))))
    return np.bincount(o[starts], minlength=rows).astype(float), most


def statistics(data: np.ndarray, at: np.ndarray, words: _Words) -> np.ndarray:
    """A row of FEATURES numbers for each text."""
    rows = len(at) - 1
    n = np.diff(at).astype(float)
    out = np.zeros((rows, FEATURES))
    kind = _CLASS[data]
    for c in range(1, 12):
        out[:, c] = _sum(kind == c, at)
    letters = out[:, 1] + out[:, 2] + out[:, 11]
    out[:, 1] = out[:, 1] / np.maximum(1, letters)
    out[:, 2:12] /= np.maximum(1, n)[:, None]
    out[:, 0] = np.log1p(n)
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _GAP[data]
    first, last = ~gap[1:-1] & gap[:-2], ~gap[1:-1] & gap[2:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner], last[inner - 1] = ~gap[1:-1][inner], ~gap[1:-1][inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.searchsorted(at, start, side="right") - 1
    count = np.bincount(owner, minlength=rows).astype(float)
    some = np.maximum(1, count)
    size = (end - start).astype(float)
    mean = np.bincount(owner, size, minlength=rows) / some
    out[:, 12] = mean
    out[:, 13] = np.sqrt(np.maximum(0, np.bincount(owner, size * size, minlength=rows) / some - mean * mean))
    out[:, 14] = np.bincount(owner, size <= 3, minlength=rows) / some
    h = words(data, start, end)
    distinct, most = _repeats(h, owner, rows)
    out[:, 15], out[:, 16] = distinct / some, most / some
    if len(h) > 1:
        same = owner[1:] == owner[:-1]
        with np.errstate(over="ignore"):
            pair = (h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1])[same]
        distinct, _ = _repeats(pair, owner[1:][same], rows)
        out[:, 17] = distinct / np.maximum(1, count - 1)
        out[:, 18] = np.bincount(owner[1:][same], (h[1:] == h[:-1])[same], minlength=rows) / some
    ends = np.flatnonzero(data == 10)
    owner = np.searchsorted(at, ends, side="right") - 1
    begin = np.maximum(at[owner], np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends)
    distinct, _ = _repeats(words(data, begin, ends), owner, rows)
    out[:, 19] = distinct / np.maximum(1, np.bincount(owner, minlength=rows))
    return out


@dataclasses.dataclass
class Model:
    """Flat trees; roots are the first nodes of the trees."""

    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Model:
    if not len(y) or y.min() == y.max():
        base = 0.0 if not len(y) else 4.0 * (2 * float(y[0]) - 1)
        return Model(base, 0, np.zeros(0, int), *[np.zeros(0)] * 5)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    p = y.mean()
    base = float(np.log(p / (1 - p)))
    margin = np.full(len(y), base)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        level = [(roots[-1], np.arange(len(y)))]
        for d in range(depth + 1):
            below = []
            for node, rows in level:
                g, h = grad[rows].sum(), hess[rows].sum()
                best = (1e-6, None, None)
                for f in range(x.shape[1]) if d < depth and len(rows) >= 2 * least else ():
                    b = binned[rows, f]
                    size = len(cuts[f]) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (grad[rows], hess[rows], None))
                    gain = gl ** 2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g ** 2 / (h + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), f, int(gain.argmax()))
                if best[1] is None:
                    nodes[node][4] = -rate * g / (h + ridge)
                    margin[rows] += nodes[node][4]
                    continue
                _, f, cut = best
                goes = binned[rows, f] <= cut
                for side, mine in ((2, rows[goes]), (3, rows[~goes])):
                    nodes[node][side] = len(nodes)
                    below.append((len(nodes), mine))
                    nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
                nodes[node][:2] = f, float(cuts[f][cut])
            level = below
    feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes))
    return Model(base, depth, np.array(roots), feature.astype(int), threshold.astype(float), left.astype(int), right.astype(int), value.astype(float))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """Learn from the labelled rows of docs outside the held-out fold; the driver gets most_rows small rows at most."""
    known = labels.select(F.col("doc_id").alias("l_id"), "quality").filter("l_id is not null and quality is not null").filter(~held_out(F.col("l_id")))
    known = known.groupBy("l_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("l_id"), "l_id").limit(most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("l_id"))  # most_rows rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in C.slices(batches, "text"):
            x = statistics(*C.text_buffer(batch.column("text")), words)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    x = rows.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(lambda batches: C.alone(run(batches)), "doc_id long, quality int, x binary")
    got = x.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).orderBy("doc_id").collect()
    return train(np.array([np.frombuffer(r.x) for r in got]).reshape(len(got), FEATURES), np.array([r.quality > 0 for r in got], float))


def scores(batch: pa.RecordBatch, model: Model, words: _Words) -> np.ndarray:
    return model.score(statistics(*C.text_buffer(batch.column("text")), words))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in C.slices(batches, "text"):
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(scores(batch, model, words))})

    return docs.select("doc_id", "text").mapInArrow(lambda batches: C.alone(run(batches)), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores threshold or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in C.slices(batches, "text"):
            yield batch.filter(pa.array(scores(batch, model, words) >= threshold))

    return docs.mapInArrow(lambda batches: C.alone(run(batches)), docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = fit(docs, C.table(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op7_quality": op7_quality}
ORACLE: dict[str, str] = {}
