"""Bitemporal history of entity attributes from periodic, late and corrected captures.

Each ledger row tells that an entity held a value from valid_from up to valid_to (null: open), and
that the ledger said so from recorded_from up to recorded_to (null: it still does). A capture that
arrives late splits the interval that covered its time: the covering row gets a recorded_to, and two
rows take its place; nothing is overwritten. The current state is the rows with no recorded_to.

What an entity's valid times said, one after the other, is told by windows over (entity, valid time). How late times
split the intervals of earlier ones depends on the times alone: the sweep sees, for each entity, its distinct valid times
and when each was first recorded, in recorded order, and keeps the times that are open; states never reach it. Both
are joined where their recorded intervals overlap.

Of captures of one entity at one valid time the latest recorded counts (ties: the greatest state).
Captures with a null entity or valid time are left out. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.stages import materialize

BLANK_RUN = r"[\s  -  　]+"


def tidy(c: Column) -> Column:
    """A text trimmed, runs of blanks as one; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(c, BLANK_RUN, " ")), F.lit(""))


def instant(c: Column) -> Column:
    """An ISO time as microseconds, so that one instant in several notations is one value; other texts stay apart."""
    at = F.unix_micros(F.try_to_timestamp(F.trim(c)))
    return F.coalesce(at.cast("string"), tidy(c))


def state_of(texts: list[str], instants: list[str]) -> Column:
    """One comparable value of all watched attributes; null and empty are told apart from any text."""
    return F.to_json(F.struct(*[tidy(F.col(c)).alias(c) for c in texts], *[instant(F.col(c)).alias(c) for c in instants]), {"ignoreNullFields": "false"})


def versions(current: DataFrame, entity: str, valid: str, state: str) -> DataFrame:
    """Longest series of equal states: entity, valid_from, valid_to, state. One row a valid time reaches the window."""
    w = Window.partitionBy(entity).orderBy(valid)
    starts = current.withColumn("__p", F.lag(F.struct(state)).over(w)).where(F.col("__p").isNull() | ~F.equal_null(F.col("__p")[state], F.col(state)))
    return starts.select(entity, F.col(valid).alias("valid_from"), F.lead(valid).over(w).alias("valid_to"), state)


class Sweep:
    """Intervals of one entity's valid times as they are split, in recorded order."""

    def __init__(self):
        self.starts: list = []
        self.since: dict = {}

    def add(self, valid, recorded) -> tuple | None:
        """A valid time that wasn't known; gives the row (valid_from, valid_to, recorded_from, recorded_to) that it ends."""
        i = bisect_right(self.starts, valid)
        ended = None
        if i:
            before = self.starts[i - 1]
            ended = (before, self.starts[i] if i < len(self.starts) else None, self.since[before], recorded)
            self.since[before] = recorded
        self.starts.insert(i, valid)
        self.since[valid] = recorded
        return ended

    def open_rows(self) -> list[tuple]:
        return [(a, b, self.since[a], None) for a, b in zip(self.starts, [*self.starts[1:], None])]


def _intervals(firsts: DataFrame, entity: str, valid: str) -> DataFrame:
    """entity, valid_from, valid_to, since, until (recorded, microseconds) of each valid time. firsts: entity, valid, at."""
    kinds = {f.name: f.dataType for f in firsts.schema}
    out = T.StructType([T.StructField(entity, kinds[entity]), T.StructField("valid_from", kinds[valid]), T.StructField("valid_to", kinds[valid]), T.StructField("since", T.LongType()), T.StructField("until", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sweep = None, Sweep()
        for batch in batches:
            ready: list[tuple] = []
            for e, v, at in batch.itertuples(index=False, name=None):
                if e != key:
                    ready += [(key, *r) for r in sweep.open_rows()]
                    key, sweep = e, Sweep()
                if (ended := sweep.add(v, at)) and ended[2] < ended[3]:
                    ready.append((key, *ended))
            if ready:
                yield pd.DataFrame(ready, columns=out.names, dtype=object)
        if sweep.starts:
            yield pd.DataFrame([(key, *r) for r in sweep.open_rows()], columns=out.names, dtype=object)

    return firsts.select(entity, valid, "at").repartition(entity).sortWithinPartitions(entity, "at", valid).mapInPandas(run, out)


def ledger(captures: DataFrame, entity: str, valid: str, recorded: str, state: str) -> DataFrame:
    """The whole bitemporal ledger: entity, valid_from, valid_to, recorded_from, recorded_to, state. recorded is a timestamp."""
    order = Window.partitionBy(entity, valid).orderBy("__at")
    said = (
        captures.where(F.col(entity).isNotNull() & F.col(valid).isNotNull() & F.col(recorded).isNotNull())
        .groupBy(entity, valid, F.unix_micros(recorded).alias("__at"))
        .agg(F.max(F.struct(F.col(state).alias("s"))).alias("m"))
        .select(entity, valid, "__at", F.col("m.s").alias(state))
        .withColumn("__p", F.lag(F.struct(state)).over(order))
        .where(F.col("__p").isNull() | ~F.equal_null(F.col("__p")[state], F.col(state)))
        .withColumn("__next", F.lead("__at").over(order))
        .select(entity, F.col(valid).alias("valid_from"), "__at", "__next", state)
    )
    said = materialize(said, "ledger-said")
    firsts = said.groupBy(entity, F.col("valid_from").alias(valid)).agg(F.min("__at").alias("at"))
    began, ended = F.greatest("__at", "since"), F.least("__next", "until")
    return (
        said.join(_intervals(firsts, entity, valid), [entity, "valid_from"])
        .where(began < F.coalesce(ended, F.lit(2**63 - 1)))
        .select(entity, "valid_from", "valid_to", F.timestamp_micros(began).alias("recorded_from"), F.timestamp_micros(ended).alias("recorded_to"), state)
    )


WATCHED = ["title", "location", "remote_type", "salary_raw", "apply_url"]


#: Between a run's start and its id: runs are ordered by their start, then by their id.
_SIGN = "\u0001"


def _run_of(place: Column) -> Column:
    return F.split_part(place, F.lit(_SIGN), F.lit(2))


def job_captures(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """job_id, run (its start and id, in order), loaded_at, state."""
    place = runs.select("id", F.concat_ws(_SIGN, F.coalesce("started_at", F.lit("")), "id").alias("run"))
    loaded = F.to_timestamp(F.col("loaded_at"))
    return snapshots.select("job_id", "run_id", loaded.alias("loaded_at"), state_of(WATCHED, ["reposted_at"]).alias("state")).join(place, F.col("run_id") == F.col("id"))


def _ledger_of_runs(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    return ledger(job_captures(snapshots, runs), "job_id", "run", "loaded_at", "state")


def job_ledger(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """The ledger of all jobs, valid times as run ids: job_id, valid_from, valid_to, recorded_from, recorded_to, state."""
    return _ledger_of_runs(snapshots, runs).withColumns({c: _run_of(F.col(c)) for c in ("valid_from", "valid_to")})


def job_versions(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """job_id, from_run, to_run of the versions that hold now, off the ledger's open rows: to_run '' for the last."""
    now = _ledger_of_runs(snapshots, runs).where(F.col("recorded_to").isNull()).select("job_id", F.col("valid_from").alias("run"), "state")
    found = versions(now, "job_id", "run", "state")
    return found.select("job_id", _run_of(F.col("valid_from")).alias("from_run"), F.coalesce(_run_of(F.col("valid_to")), F.lit("")).alias("to_run"))
