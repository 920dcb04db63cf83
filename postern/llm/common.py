"""Helpers that several operators share: shared-folder tables, joins that survive hot keys, Arrow text buffers."""
from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SALTS = 256
#: Tables that an operator keeps in a Python worker from task to task; they load again where they are needed.
KEPT: list[dict] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (where that is unset, as in tests) a temporary one."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("postern.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="postern-")
        spark.conf.set("postern.shared.dir", base)
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that this module wrote, by Spark's own file system."""
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/postern-{uuid.uuid4().hex[:12]}-{name}"

    def forget() -> None:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            pass

    atexit.register(forget)
    return path


def cut(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    path = path or new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salt(*cols: Column | str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def n_words(text: Column, gap: str) -> Column:
    """The number of words of a text (not null) between runs of ``gap`` (a pattern that ends in +)."""
    parts = F.split(text, gap, -1)
    ends = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) + F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.greatest(F.size(parts) - ends, F.lit(0)).cast("long")


def hot_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """Join rows to a table with at most one row for each key, where single keys may hold a large share of left.

    left is dealt by (key, salt of the column ``spread``); right is first carried to the (key, salt) pairs that
    occur, at most SALTS of them for a key.  No task gets a whole hot key, and nothing is broadcast by force.
    """
    left = left.withColumn("_salt", salt(F.lit(7), spread))
    pairs = left.filter(F.col(key).isNotNull()).select(key, "_salt").distinct().join(right, key)
    return left.join(pairs, [key, "_salt"], how).drop("_salt")


def semi(rows: DataFrame, ids: DataFrame, key: str, most: int = 2_000_000) -> DataFrame:
    """Rows whose key is in ids (a written table of distinct keys); ids go by broadcast if there are ``most`` at most."""
    few = ids.limit(most + 1).count() <= most
    return rows.join(F.broadcast(ids) if few else ids, key, "left_semi")


def small_batches(spark: SparkSession, most: str = "2m") -> None:
    """From now on Spark sends rows to Python in batches of about ``most`` bytes, not of 10,000 rows of any size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; then freed memory goes back to the system, as Python workers live on between tasks."""
    try:
        yield from batches
    finally:
        give_back()


def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, tidied; first the tables go that other operators left in this worker."""
    if any(KEPT):
        for kept in KEPT:
            kept.clear()
        gc.collect()  # a table may hold itself
        give_back()
    yield from tidy(batches)


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0]: at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches again, each with about most_bytes of text at most (a longer text comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(text_buffer(batch.column(column))[1])
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """One batch for each run of equal keys; the rows must come sorted by key.  Runs may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if held and keys[a] != last:
                yield _one(held)
                held = []
            last = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def by_group(df: DataFrame, key: str, run: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Bring the rows of each key together, sorted, and apply run to each group; groups must be bounded."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.RecordBatch] = []
        rows = 0
        for group in groups(batches, key):
            got = run(group)
            if got is not None and got.num_rows:
                out.append(got)
                rows += got.num_rows
            if rows >= 20_000:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out, rows = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(lambda batches: alone(apply(batches)), schema)
