"""Streams: keyed state by merge in batches, windows over event time, duplicates dropped in flight."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.state import bucket_of, last_batch, merge_by_key, read_state, write_state


def payload_stream(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """Payloads as they arrive in a folder, so many files a batch: the pull of a run, without its network."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def upsert_stream(
    stream: DataFrame, state_path: str, key: list[str], checkpoint: str, merged: Callable[[], dict], keep: Callable[[], Column] | None = None
) -> StreamingQuery:
    """Runs a keyed merge of each batch into a state, available data only. merged() gives the columns over aliases s and i.

    The state is kept in buckets of keys: a batch reads and writes the buckets of its own keys only. keep() tells which
    rows are still to be held (a time to live); others are dropped when their bucket is written. A batch that comes again
    after a failure is told by its number, kept in the state's pointer, and not merged twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        done = last_batch(spark, state_path)
        if done is not None and done >= number:
            return
        # at most BUCKETS numbers
        buckets = {r[0] for r in df.select(bucket_of(key)).distinct().collect()}
        state = read_state(spark, state_path, buckets)
        if state is None:
            state = df.limit(0)
        out = merge_by_key(state, df, key, merged())
        write_state(out.where(keep()) if keep else out, state_path, key, buckets, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, at: str, size: str, slide: str | None, by: list[str], late: str = "1 hour") -> DataFrame:
    """Counts and sums of value per window and keys; a stream closes a window once the watermark has passed."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, at: str, gap: str, by: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))


def drop_repeats(stream: DataFrame, keys: list[str], at: str, within: str) -> DataFrame:
    """Each key once within a time; state older than that is forgotten."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)
