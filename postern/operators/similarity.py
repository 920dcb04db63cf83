"""Similarity of two fingerprints, layer by layer, with absent layers left out of the weights; all pairs of similar sets."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postern.operators import graph

#: Weights of the layers.
LAYERS = {"content": 0.22, "urls": 0.18, "attachments": 0.15, "infra": 0.17, "sender": 0.10, "semantic": 0.10, "delivery": 0.08}


def jaccard(a: Column, b: Column) -> Column:
    """Null if both sets are empty or null."""
    a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in (a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def equal(a: Column, b: Column) -> Column:
    """1 or 0; null if a side is null or empty."""
    return F.when((a != "") & (b != ""), (a == b).cast("double"))


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """Mean by weight of the parts that are there; null if none is."""
    top = sum((F.coalesce(c * F.lit(w), F.lit(0.0)) for c, w in parts), F.lit(0.0))
    below = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return F.when(below > 0, top / below)


def delivery(a: Column, b: Column) -> Column:
    """exp(-days / 3) of two times in milliseconds."""
    return F.exp(-F.abs(a - b) / F.lit(86_400_000.0 * 3))


def layers(a: str, b: str, minhash_share: Column) -> dict[str, Column]:
    """The seven layers of fingerprint structs a and b (columns of a pair)."""
    x, y = (lambda f, s=s: F.col(f"{s}.{f}") for s in (a, b))
    eq = lambda f: equal(x(f), y(f))
    jac = lambda f: jaccard(x(f), y(f))
    subject = F.coalesce(F.when(eq("subject_template") == 1, F.lit(1.0)), jac("subject_tokens"))
    urls = F.greatest(jac("url_templates"), F.lit(0.85) * jac("url_domains"), F.lit(0.8) * jac("url_paths"))
    files = F.when(F.size(F.array_intersect(x("att_sha"), y("att_sha"))) > 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.85) * jac("att_structs"), F.lit(0.5) * jac("att_names")))
    return {
        "content": weighted([(minhash_share, 0.5), (subject, 0.25), (eq("skeleton"), 0.2), (eq("class_hash"), 0.05)]),
        "urls": urls,
        "attachments": files,
        "infra": weighted([(eq("origin_net"), 0.2), (eq("origin_org"), 0.1), (eq("mailer"), 0.15), (jac("dkim_domains"), 0.15), (jac("dkim_selectors"), 0.05), (eq("header_order"), 0.2), (eq("message_id_template"), 0.1), (eq("dkim_header_set"), 0.05)]),
        "sender": weighted([(eq("from_org"), 0.35), (eq("local_template"), 0.15), (eq("display_name"), 0.3), (eq("reply_to_org"), 0.2)]),
        "semantic": weighted([(eq("intent"), 0.5), (eq("brand"), 0.35), (jac("actions"), 0.15)]),
        "delivery": delivery(x("time"), y("time")),
    }


def combined(parts: dict[str, Column]) -> Column:
    return F.round(weighted([(parts[k], w) for k, w in LAYERS.items()]), 3)


def evidence(indicators: Column, similarity: Column) -> Column:
    """Two independent strengths together."""
    return F.round(F.lit(1.0) - (F.lit(1.0) - F.coalesce(indicators, F.lit(0.0))) * (F.lit(1.0) - F.coalesce(similarity, F.lit(0.0))), 3)


#: Cells that words are counted in, and the words (about) of the sets that are compared as a whole.
CELLS, TILE_WORDS = 1 << 22, 500_000


def word_sets(docs: DataFrame, part: str, words: Column) -> DataFrame:
    """doc_id, src, w (sorted 64-bit hashes of the distinct words), n of them, set_id (one for each part and set)."""
    s = docs.select("doc_id", F.xxhash64(part).alias("src"), F.sort_array(F.array_distinct(F.transform(words, lambda x: F.xxhash64(x)))).alias("w"))
    return s.select("*", F.size("w").alias("n"), F.xxhash64("src", "w").alias("set_id"))


def _levels(sets: DataFrame) -> np.ndarray:
    """For each cell of words about 4 * log2 of the sets that hold one, from 1; just 1 if a single set does."""
    counted = sets.select(F.explode("w").alias("h")).groupBy(F.pmod("h", F.lit(CELLS)).cast("int").alias("cell")).agg(F.count("*").alias("n"))
    got = counted.select("cell", F.least(F.lit(127), F.ceil(F.log2("n") * 4 + 1)).cast("byte").alias("level")).toArrow()
    out = np.zeros(CELLS, np.int8)
    out[got["cell"].to_numpy()] = got["level"].to_numpy()
    return out


def _prefixes(levels, percent: int):
    """Keys of a set: its rarest words, of which it shares one with any set that is similar enough, in the common order
    by level and hash.  A word that no other set holds is no key.  parity: 1 to 2 bits for each word of the set, at
    the places that its hashes name, each as often turned as it is named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("n").to_numpy().astype(np.int64)
            step = np.cumsum(size) // 1_000_000
            for some in np.split(np.arange(len(size)), np.flatnonzero(np.diff(step)) + 1):
                if not len(some):
                    continue
                part, n = batch.slice(int(some[0]), len(some)), size[some]
                h = part.column("w").flatten().to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                level = levels.value[h & (CELLS - 1)]
                order = np.argsort(row * 128 + level, kind="stable")
                at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                keep = (at < (n + (-percent * n // 100) + 1)[row]) & (level[order] > 1)
                key = (h[order] ^ part.column("src").to_numpy()[row])[keep]
                ends = np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=len(n))))).astype(np.int32)
                held = np.maximum(1 << np.ceil(np.log2(n)).astype(np.int64), 64)
                cells = np.concatenate(([0], np.cumsum(held // 64)))
                bit = (h >> 23) & (held[row] - 1)
                parity = np.zeros(int(cells[-1]), np.int64)
                np.bitwise_xor.at(parity, cells[row] + (bit >> 6), np.int64(1) << (bit & 63))
                parity = pa.ListArray.from_arrays(pa.array(cells.astype(np.int32)), pa.array(parity))
                keys, places = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (key, at[keep].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("set_id"), part.column("n"), keys, places, parity], ["doc_id", "set_id", "n", "key", "at", "parity"])

    return run


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _candidates(percent: int):
    """Pairs of sets with a common key (rows sorted by key, n, set_id) whose sizes and places of it allow the similarity."""

    def meet(key, n, sid, at):
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])  # copies
        key, n, sid, at = key[new], n[new].astype(np.int64), sid[new], at[new].astype(np.int64)
        last = np.searchsorted(key, key, side="right")
        i, d = np.arange(len(key)), 0
        a, b, rows = [], [], 0
        while len(i):
            d += 1
            i = i[i + d < last[i]]
            i = i[100 * n[i] >= percent * n[i + d]]
            j = i + d
            fits = (100 + percent) * np.minimum(n[i] - at[i], n[j] - at[j]) >= percent * (n[i] + n[j])
            x, y = sid[i[fits]], sid[j[fits]]
            a.append(np.minimum(x, y))
            b.append(np.maximum(x, y))
            rows += len(x)
            if rows > 1_000_000 or not len(i):
                yield _distinct(np.concatenate(a), np.concatenate(b))
                a, b, rows = [], [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, a, b, rows = ("key", "n", "set_id", "at"), None, [], [], 0

        def out():
            x, y = _distinct(np.concatenate(a), np.concatenate(b))
            for k in range(0, len(x), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k: k + 100_000]), pa.array(y[k: k + 100_000])], ["a", "b"])

        def ready():
            nonlocal held
            for batch in batches:
                if batch.num_rows:
                    cols = [batch.column(c).to_numpy() for c in names]
                    cols = cols if held is None else [np.concatenate(p) for p in zip(held, cols)]
                    whole = int(np.searchsorted(cols[0], cols[0][-1]))
                    held = [c[whole:] for c in cols]
                    if whole:
                        yield [c[:whole] for c in cols]
            if held is not None:
                yield held

        for cols in ready():
            for x, y in meet(*cols):
                a.append(x)
                b.append(y)
                rows += len(x)
                if rows > 1_000_000:
                    yield from out()
                    a, b, rows = [], [], 0
        if rows:
            yield from out()

    return run


def _verified(percent: int):
    """Similar pairs of each tile (rows sorted by tile), counted on the whole sets; of a tile of two sides only those across."""

    def tile(side, across, sid, w):
        sid, first = np.unique(sid, return_index=True)
        n = w.value_lengths().to_numpy()[first].astype(np.int64)
        order = np.argsort(n, kind="stable")
        first, sid, n, side = first[order], sid[order], n[order], side[first[order]]
        value, word = np.unique(w.take(pa.array(first)).flatten().to_numpy(), return_inverse=True)
        at = np.concatenate(([0], np.cumsum(n)))
        high = np.searchsorted(n, 100 * n // percent, side="right")
        flag = np.zeros(len(value), np.int64)
        for i in range(len(n) - 1):
            j = int(high[i])
            if j > i + 1:
                mine = word[at[i]: at[i + 1]]
                flag[mine] = 1
                both = np.add.reduceat(flag[word[at[i + 1]: at[j]]], at[i + 1: j] - at[i + 1])
                flag[mine] = 0
                union = n[i] + n[i + 1: j] - both
                good = np.flatnonzero((100 * both >= percent * union) & ((side[i + 1: j] != side[i]) | (not across)))
                if len(good):
                    yield np.full(len(good), sid[i]), sid[i + 1 + good], both[good], union[good]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, rows = [], [], 0

        def tiles():
            table = pa.Table.from_batches(held).combine_chunks()
            w = table.column("w").combine_chunks()
            w = w.chunk(0) if isinstance(w, pa.ChunkedArray) else w
            yield from tile(table.column("side").to_numpy(), bool(table.column("across")[0].as_py()), table.column("set_id").to_numpy(), w)

        def found():
            nonlocal held
            last = None
            for batch in batches:
                key = batch.column("tile").to_numpy()
                starts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else []
                for s, e in zip(starts[:-1], starts[1:]):
                    if held and key[s] != last:
                        yield from tiles()
                        held = []
                    last = key[s]
                    held.append(batch.slice(s, e - s))
            if held:
                yield from tiles()

        def send():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], ["a", "b", "both", "together"])

        for got in found():
            out.append(got)
            rows += len(got[0])
            if rows > 100_000:
                yield send()
                out, rows = [], 0
        if out:
            yield send()

    return run


def _turned(a: Column, b: Column) -> Column:
    """Bits in which two parities differ (the longer one folded), at most the words that only one of the sets has."""
    half = lambda s: F.zip_with(F.slice(s, F.lit(1), (F.size(s) / 2).cast("int")), F.slice(s, (F.size(s) / 2 + 1).cast("int"), (F.size(s) / 2).cast("int")), lambda x, y: x.bitwiseXOR(y))
    a, b = F.when(F.size(a) > F.size(b), half(a)).otherwise(a), F.when(F.size(b) > F.size(a), half(b)).otherwise(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def similar_pairs(docs: DataFrame, part: str, words: Column, percent: int = 80) -> DataFrame:
    """a < b, j: every two rows of a part (not null) whose sets of words have a Jaccard of percent / 100 or more.

    Rows with equal sets go on as one.  Sets that are similar enough share one of their rarest words; only the hashes of
    these are dealt, with the size of the set and the word's place, which rule out most other pairs; parities of the
    sets, which differ in no more bits than the sets do in words, rule out most of the rest.  The pairs left are labelled
    by their smallest neighbour and dealt in tiles of two labels, so that a group of near copies meets once and not pair
    by pair; a large label is split, and a tile holds about 2 * TILE_WORDS words, or two sets.  A task that finds pairs
    holds the rows of one key, 24 bytes each.  Counts of words only order them: nothing is left out.  Words are told
    apart by 64-bit hashes.  The rows that come out are all pairs, so they grow with the square of a group of copies.
    """
    docs = docs.filter(F.col("doc_id").isNotNull() & F.col(part).isNotNull() & words.isNotNull())
    spark = docs.sparkSession
    sets = word_sets(docs, part, words)
    levels = spark.sparkContext.broadcast(_levels(sets))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = graph.cut(sets.mapInArrow(_prefixes(levels, percent), f"doc_id {kind}, set_id long, n int, key array<long>, at array<int>, parity array<long>"))
    keys = rows.select("set_id", "n", F.inline(F.arrays_zip("key", "at")))
    one = graph.cut(rows.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies"), F.first("parity").alias("parity")))
    found = keys.repartition("key").sortWithinPartitions("key", "n", "set_id").mapInArrow(_candidates(percent), "a long, b long").repartition("a").dropDuplicates(["a", "b"])
    x, y = (one.select(F.col("set_id").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}")) for c in "ab")
    edges = graph.cut(found.join(x, "a").join(y, "b").filter(_turned(F.col("pa"), F.col("pb")) * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("set_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("set_id"), F.col("a").alias("other"))))).select("col.*")
    label = ends.groupBy("set_id").agg(F.min("other").alias("other")).select("set_id", F.least("set_id", "other").alias("label")).join(one.select("set_id", "doc_id", "n"), "set_id")
    split = label.groupBy("label").agg(F.ceil(F.sum("n") / TILE_WORDS).alias("k"))
    node = graph.cut(label.join(split, "label").select("set_id", "doc_id", F.xxhash64("label", F.pmod("set_id", F.col("k"))).alias("tag")))
    x, y = (node.select(F.col("set_id").alias(c), F.struct("set_id", "doc_id", "tag").alias(f"n{c}")) for c in "ab")
    low, high = F.least("na.tag", "nb.tag"), F.greatest("na.tag", "nb.tag")
    met = edges.join(x, "a").join(y, "b").select(F.xxhash64(low, high).alias("tile"), low.alias("low"), (low != high).alias("across"), F.explode(F.array("na", "nb")).alias("x"))
    need = graph.cut(met.select("tile", "across", (F.col("x.tag") != F.col("low")).cast("int").alias("side"), "x.set_id", "x.doc_id").distinct())
    few = need.count() <= 500_000
    small = lambda df: F.broadcast(df) if few else df
    whole = word_sets(docs.join(small(need.select("doc_id").distinct()), "doc_id", "left_semi"), part, words)
    tiles = whole.select("doc_id", "set_id", "w").join(small(need), ["doc_id", "set_id"]).select("tile", "across", "side", "set_id", "w")
    pairs = tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_verified(percent), "a long, b long, both long, together long")
    copies = one.filter("copies > 1").select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.lit(1).cast("long").alias("both"), F.lit(1).cast("long").alias("together"))
    ids = rows.select("set_id", "doc_id").join(one.select("set_id", F.ceil(F.col("copies") / 1000).alias("k")), "set_id")
    ids = ids.groupBy("set_id", F.pmod(F.xxhash64("doc_id"), F.col("k")).alias("chunk")).agg(F.collect_list("doc_id").alias("ids"))
    side = lambda c: ids.select(F.col("set_id").alias(c), F.col("ids").alias(f"i{c}"))
    every = pairs.union(copies).join(side("a"), "a").join(side("b"), "b").select((F.col("a") == F.col("b")).alias("same"), (F.col("both") / F.col("together")).alias("j"), F.explode("ia").alias("x"), "ib").select("same", "j", "x", F.explode("ib").alias("y"))
    return every.filter(F.when(F.col("same"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "j")
