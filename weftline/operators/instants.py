"""Times in many notations and zones as UTC instants, through a dictionary of distinct notations.

The distinct (text, zone, date order) triples are parsed once each, however many rows hold them; the
dictionary is a table to which later runs append only what it lacks. Rows join it back. Relative
notations keep their distance there and are counted back from the row's own fetch time in the join.

Null, blank and unreadable texts have no instant; repeated rows each get theirs; an unknown source
counts as UTC with the day first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.timeparse import read_time, resolve_posted
from weftline.plans.stages import kept_path, path_exists

EARLIEST = 946_684_800  # 2000-01-01


@F.pandas_udf(T.StructType().add("at_us", T.LongType()).add("back_s", T.LongType()))
def _read(text: pd.Series, zone: pd.Series, order: pd.Series) -> pd.DataFrame:
    found = [read_time(*x) for x in zip(text, zone, order)]
    return pd.DataFrame({"at_us": pd.array([a for a, _ in found], dtype="Int64"), "back_s": pd.array([b for _, b in found], dtype="Int64")})


_KEYS = ["text", "zone", "date_order"]
_DICTIONARY = "text string, zone string, date_order string, at_us bigint, back_s bigint"


def extend_dictionary(notations: DataFrame, store: str | None = None) -> DataFrame:
    """Dictionary text, zone, date_order -> at_us, back_s: only notations that the store lacks are parsed, and appended to it.

    store: path of the dictionary, kept for later runs; without one it lies in the application's scratch folder, so that
    later calls of the same application find it. Two runs that append the same notation at once do no harm.
    """
    spark = notations.sparkSession
    store = store or kept_path(spark, "time-dictionary")
    seen = notations.select(*_KEYS).where(F.trim("text") != "").distinct()
    if path_exists(spark, store):
        known = spark.read.schema(_DICTIONARY).parquet(store)
        seen = seen.join(known, [F.equal_null(seen[k], known[k]) for k in _KEYS], "left_anti")
    seen.withColumn("t", _read(*_KEYS)).select(*_KEYS, "t.at_us", "t.back_s").write.mode("append").parquet(store)
    return spark.read.schema(_DICTIONARY).parquet(store).dropDuplicates(_KEYS)


def utc_micros(iso: Column) -> Column:
    """Microseconds of an ISO time with zone; null where it isn't one."""
    return F.unix_micros(F.try_to_timestamp(iso))


def resolve(values: DataFrame, keys: list[str], store: str | None = None) -> DataFrame:
    """keys, epoch_s of each value that names an instant from 2000 up to its row's fetch.

    values: keys, text, zone, date_order, fetched_us. Zone and order may be null.
    """
    lookup = extend_dictionary(values, store)
    v, d = values.where(F.trim("text") != "").alias("v"), lookup.alias("d")
    same = (F.col("v.text") == F.col("d.text")) & F.equal_null("v.zone", "d.zone") & F.equal_null("v.date_order", "d.date_order")
    at = F.coalesce(F.col("d.at_us"), F.col("v.fetched_us") - F.col("d.back_s") * 1_000_000)
    return (
        v.join(d.where(F.col("d.at_us").isNotNull() | F.col("d.back_s").isNotNull()), same)
        .select(*[F.col(f"v.{k}") for k in keys], at.alias("at"), F.col("v.fetched_us").alias("__f"))
        .where((F.col("at") >= EARLIEST * 1_000_000) & (F.col("at") <= F.col("__f")))
        .select(*keys, F.floor(F.col("at") / 1_000_000).cast("bigint").alias("epoch_s"))
    )


@F.pandas_udf(T.StructType().add("at_us", T.LongType()).add("confidence", T.StringType()))
def _posted(value: pd.Series, text: pd.Series, fetched: pd.Series) -> pd.DataFrame:
    found = [resolve_posted(a, b, None if pd.isna(f) else int(f)) for a, b, f in zip(value, text, fetched)]
    return pd.DataFrame({"at_us": pd.array([a for a, _ in found], dtype="Int64"), "confidence": [b for _, b in found]})


def posted_at(value: Column, text: Column, fetched: Column) -> Column:
    """struct<at_us, confidence> of a listing: its time or its relative text, whichever is surer."""
    return _posted(value, text, utc_micros(fetched))


def listing_times(raw_jobs: DataFrame, items: DataFrame, feeds: DataFrame, item_source: str = "jobright", store: str | None = None) -> DataFrame:
    """tab, rec_id, field_name, epoch_s of postedAt, postedText and publishTime."""
    zones = feeds.groupBy("source").agg(F.first("zone_name", True).alias("zone"), F.first("date_order", True).alias("date_order"))
    fields = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in ("postedAt", "postedText")])
    rows = raw_jobs.select(
        F.lit("raw_jobs").alias("tab"), F.col("raw_id").alias("rec_id"), "source", utc_micros(F.col("fetchedAt")).alias("fetched_us"), F.inline(fields)
    ).unionByName(
        items.select(
            F.lit("jobright_items").alias("tab"),
            F.col("item_id").alias("rec_id"),
            F.lit(item_source).alias("source"),
            utc_micros(F.col("fetchedAt")).alias("fetched_us"),
            F.lit("publishTime").alias("field_name"),
            F.col("publishTime").alias("text"),
        )
    )
    values = rows.where(F.trim("text") != "").join(zones, "source", "left")
    return resolve(values, ["tab", "rec_id", "field_name"], store)
