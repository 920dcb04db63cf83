"""Structured Streaming: intake without duplicates, sender history, scored mail, windowed counts."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postern.sources import mail


def intake(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Files as they land, with format and digest; each content once in a day of arrival."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(path)
    rows = files.withColumn("sha256", F.sha2("content", 256)).withColumn("format", mail.detect_format(F.col("content")))
    return rows.withWatermark("modificationTime", "1 day").dropDuplicatesWithinWatermark(["sha256"])


def sender_history(messages: DataFrame) -> DataFrame:
    """For each message of a stream (message_id, from_addr, sent_ms): how many others from the address came before.

    A message that comes again is not counted again: the state keeps the ids of the last 1,000 messages of an address.
    """
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, ids = state.get if state.exists else (0, [])
        ids = list(ids)
        out = []
        for frame in frames:
            for r in frame.sort_values(["sent_ms", "message_id"]).itertuples():
                if r.message_id in ids:
                    continue
                out.append((r.message_id, key[0], seen))
                seen += 1
                ids = [*ids, r.message_id][-1000:]
        state.update((seen, ids))
        yield pd.DataFrame(out, columns=["message_id", "from_addr", "seen"])

    return messages.groupBy("from_addr").applyInPandasWithState(run, "message_id string, from_addr string, seen long", "seen long, ids array<string>", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, at: str, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def upsert(stream: DataFrame, path: str, checkpoint: str, apply: Callable[[DataFrame], DataFrame] = lambda x: x) -> StreamingQuery:
    """Each micro-batch becomes its own partition of a table, written again if the batch is: exactly once."""
    def write(batch: DataFrame, number: int) -> None:
        apply(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
