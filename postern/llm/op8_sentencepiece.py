"""SentencePiece encoding and decoding with N-best segmentation.

See unigram.py for the lattice: forward Viterbi scores are the exact heuristic of a backward A* search over a chunk's
lattice.  The n best segmentations of a text are the n best choices of one segmentation for each chunk; they differ
from the best in the n - 1 chunks with the smallest losses at most.  The forward pass, in step over all new chunks of
a batch, gives a chunk's best segmentation and the least loss of another one, which is the least loss of an edge into
the best path; the search runs in those n - 1 chunks alone, and a queue merges what it finds.  The ids of all n are
returned; those of the best are decoded again and held against the text.

Defined results: null and empty texts have no pieces, score 0 and the one segmentation of nothing; of equal scores the
order is that of the search within a chunk, and the earlier chunk changes first; texts are encoded whole, and a long
run without spaces costs in proportion to its length; equal rows give equal rows; null ids
pass through; an empty table gives an empty one; columns other than doc_id and text are not looked at.
"""
from __future__ import annotations

import hashlib
import heapq
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C, unigram

N_BEST = 4
#: Bytes of ids after which a batch goes out.
MOST_OUT = 2 << 20
SCHEMA = "doc_id long, n_tokens long, score double, ids_sha256 string, n_best array<double>, round_trip boolean, ids array<array<int>>"


Entry = tuple[float, bytes, float]  # best score, best ids, the least loss of another segmentation (infinite if none)


def learn(lattice: unigram.Lattice, chunks: set[str]) -> None:
    """Entries of chunks that the worker has not met; a long chunk's is made of those of its parts.

    Entries live in two generations of bounded size, so that frequent chunks stay when rare ones go.
    """
    if len(lattice.best) + len(chunks) > unigram.MOST_KEPT // 2:
        lattice.before, lattice.best = lattice.best, {}
    best = lattice.best
    new = []
    for c in chunks - best.keys():
        if (got := lattice.before.get(c)) is not None:
            best[c] = got
        else:
            new.append(c)
    if not new:
        return
    if lattice.forward is None:
        lattice.forward = unigram.Forward(lattice)
    short = [c for c in new if len(c) <= unigram.LONG]
    for c, entry in zip(short, lattice.forward(short)):
        best[c] = entry
    for c in new:
        if len(c) > unigram.LONG:
            each = entries_of(lattice, c)
            best[c] = sum([e[0] for e in each], 0.0), b"".join([e[1] for e in each]), min([e[2] for e in each])


def entries_of(lattice: unigram.Lattice, chunk: str) -> list[Entry]:
    """The entries of a long chunk's parts."""
    units = lattice.units(chunk)
    kept = {p: lattice.best[p] for p in units if p in lattice.best}
    short = [p for p in dict.fromkeys(units) if len(p) <= unigram.LONG and p not in kept]
    kept.update(zip(short, lattice.forward(short)))
    for p in units:
        if p not in kept:
            two = lattice.n_best(p, 2)
            kept[p] = two[0][0], array("i", two[0][1]).tobytes(), two[0][0] - two[1][0] if len(two) > 1 else math.inf
    return [kept[p] for p in units]


def least(losses: list[float], most: int) -> list[int]:
    """Where the ``most`` smallest finite losses stand, the first of equals first."""
    if len(losses) > 40:
        every = np.array(losses)
        bound = np.partition(every, most - 1)[most - 1]
        few = [(losses[i], i) for i in np.flatnonzero(every <= bound).tolist()]
    else:
        few = [(x, i) for i, x in enumerate(losses)]
    few.sort()
    return [i for x, i in few[:most] if x < math.inf]


def merge(losses: list[tuple[float, ...]], n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The n least sums of one loss (or none) from each chunk, each with its (chunk, choice) pairs, least first."""
    first = heapq.nsmallest(n - 1, [(x[0], at) for at, x in enumerate(losses) if x]) if len(losses) > n else sorted([(x[0], at) for at, x in enumerate(losses) if x])[: n - 1]
    order = [at for _, at in first]
    out: list[tuple[float, tuple[tuple[int, int], ...]]] = []
    queue: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
    while queue and len(out) < n:
        total, picks = heapq.heappop(queue)
        out.append((total, tuple((order[a], b) for a, b in picks)))
        # each set of picks is reached once: deepen the last pick, or add a later chunk's first loss
        if picks and picks[-1][1] < len(losses[order[picks[-1][0]]]):
            a, b = picks[-1]
            more = losses[order[a]]
            heapq.heappush(queue, (total - more[b - 1] + more[b], (*picks[:-1], (a, b + 1))))
        for a in range(picks[-1][0] + 1 if picks else 0, len(order)):
            heapq.heappush(queue, (total + losses[order[a]][0], (*picks, (a, 1))))
    return out


def others(lattice: unigram.Lattice, chunk: str, n: int) -> list[tuple[float, bytes]]:
    """Losses and ids of a chunk's second best to n-th best segmentation; kept in a bounded table."""
    got = lattice.paths.get(chunk)
    if got is None:
        units = lattice.units(chunk)
        if len(units) == 1:
            found = lattice.n_best(chunk, n)
            got = [(found[0][0] - s, array("i", ids).tobytes()) for s, ids in found[1:]]
        else:
            each = entries_of(lattice, chunk)
            got = [(loss, ids) for loss, ids in combine(lattice, units, each, n)[1:]]
        if len(lattice.paths) >= unigram.MOST_PATHS:
            lattice.paths.clear()
        if len(chunk) < 1000:
            lattice.paths[chunk] = got
    return got


def combine(lattice: unigram.Lattice, chunks: list[str], entries: list[Entry], n: int) -> list[tuple[float, bytes]]:
    """Losses and ids of the n best segmentations of chunks in a row, best first.  Only the n - 1 chunks whose second
    best segmentations lose least are searched: no other one changes in any of the n best."""
    ids = [e[1] for e in entries]
    out = [(0.0, b"".join(ids))]
    at = least([e[2] for e in entries], n - 1) if n > 1 else []
    if at:
        ways = [others(lattice, chunks[i], n) for i in at]
        for loss, picks in merge([tuple([w[0] for w in way]) for way in ways], n)[1:]:
            for a, choice in picks:
                ids[at[a]] = ways[a][choice - 1][1]
            out.append((loss, b"".join(ids)))
            for a, _ in picks:
                ids[at[a]] = entries[at[a]][1]
    return out


def encode_text(lattice: unigram.Lattice, text: str, n: int = N_BEST) -> list[tuple[float, list[int]]]:
    """Scores and ids of the n best segmentations of a text, best first."""
    chunks = lattice.chunk.findall(lattice.normal(text))
    learn(lattice, set(chunks))
    entries = [lattice.best[c] for c in chunks]
    score = sum([e[0] for e in entries], 0.0)
    return [(score - loss, array("i", ids).tolist()) for loss, ids in combine(lattice, chunks, entries, n)]


def _nested(rows: list[list[bytes]]) -> pa.Array:
    """Lists of lists of 32-bit ids."""
    outer = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    inner = np.concatenate(([0], np.cumsum([len(x) // 4 for r in rows for x in r]))).astype(np.int32)
    flat = pa.array(np.frombuffer(b"".join([x for r in rows for x in r]), np.int32))
    return pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), flat))


def encode(docs: DataFrame, n: int = N_BEST, model: str = unigram.MODEL) -> DataFrame:
    """One row for each row of docs: the best segmentation's size, score and digest of its ids (little-endian 32-bit),
    the scores of the n best, whether decoding the ids gives the text, and the ids of the n best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = unigram.lattice(model)
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64()), ("ids_sha256", pa.string()), ("n_best", pa.list_(pa.float64())), ("round_trip", pa.bool_()), ("ids", pa.list_(pa.list_(pa.int32())))])
        for batch in C.slices(batches, "text", 1 << 20):
            data, at = C.text_buffer(batch.column("text"))
            chunks = [lattice.chunk.findall(lattice.normal(text or "")) for text in batch.column("text").to_pylist()]
            learn(lattice, set().union(*chunks))
            known = lattice.best.__getitem__
            rows, every, held = [], [], 0
            for doc, a, b, own in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), chunks):
                entries = list(map(known, own))
                score = sum([e[0] for e in entries], 0.0)
                best = combine(lattice, own, entries, n)
                ids = best[0][1]
                every.append([x for _, x in best])
                held += len(ids) * len(best)
                back = lattice.decode_bytes(np.frombuffer(ids, np.int32))[0]
                rows.append((doc, len(ids) // 4, score, hashlib.sha256(ids).hexdigest(), [score - loss for loss, _ in best], bool(np.array_equal(back[1:] if len(back) else back, data[a:b]))))
                if held > MOST_OUT:
                    yield pa.record_batch([*[pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], _nested(every)], schema=schema)
                    rows, every, held = [], [], 0
            if rows:
                yield pa.record_batch([*[pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], _nested(every)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(lambda batches: C.tidy(run(batches)), SCHEMA)


def decode(rows: DataFrame, model: str = unigram.MODEL) -> DataFrame:
    """doc_id, text of rows with doc_id and ids (one segmentation each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = unigram.lattice(model)
        for batch in batches:
            texts = [lattice.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, scores and digests of what encode returns."""
    return encode(C.table(spark, sf_dir, "documents")).drop("ids")


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
ORACLE: dict[str, str] = {}
