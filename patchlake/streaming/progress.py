"""Progress of jobs from their events: the same reducer for a batch and for a stream with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlake.runtime import ship_package

#: Events of a job that are kept.
RING = 200
#: States of a job.
STATES = ("queued", "running", "completed", "failed", "cancelled")


def accepted(value: Column) -> Column:
    """A metric value that counts: a whole number from 0."""
    return F.when((value >= 0) & (value == F.floor(value)), value.cast("long"))


def reduced(events: DataFrame) -> DataFrame:
    """(job, events, progress, state, last): each job after all its events.

    Progress never falls and is held between 0 and 100, below 100 while the job isn't completed; a job leaves a final state
    no more; a cancellation counts only while it is queued.
    """
    w = Window.partitionBy("job").orderBy("ts", "seq")
    final = F.col("kind").isin("completed", "failed")
    done = F.max(final.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    started = F.max((F.col("kind") == "running").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    counts = (F.coalesce(done, F.lit(0)) == 0) & ((F.col("kind") != "cancelled") | (F.coalesce(started, F.lit(0)) == 0))
    rows = events.withColumn("counts", counts).where("counts")
    state = F.max_by(F.when(F.col("kind").isin(*STATES), F.col("kind")), F.when(F.col("kind").isin(*STATES), F.struct("ts", "seq")))
    top = F.max(F.least(F.greatest(F.col("progress"), F.lit(0)), F.lit(100)))
    out = rows.groupBy("job").agg(F.count("*").alias("events"), top.alias("top"), F.coalesce(state, F.lit("queued")).alias("state"), F.max("ts").alias("last"))
    return out.select("job", "events", F.when(F.col("state") == "completed", 100).otherwise(F.least(F.coalesce("top", F.lit(0)), F.lit(99))).cast("int").alias("progress"), "state", "last")


def ring(events: DataFrame, n: int = RING) -> DataFrame:
    """The last n events of each job: an event told again keeps its first time and takes its last content."""
    own = events.groupBy("job", "event_id").agg(F.min("ts").alias("ts"), F.max_by("kind", F.struct("ts", "seq")).alias("kind"), F.max_by("progress", F.struct("ts", "seq")).alias("progress"))
    w = Window.partitionBy("job").orderBy(F.desc("ts"), F.desc("event_id"))
    return own.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).drop("place")


OUTPUT = "job long, events long, progress int, state string, last timestamp"
STATE = "events long, progress int, state string, last timestamp"


def streamed(events: DataFrame) -> DataFrame:
    """As reduced, kept up as events arrive: one row a job and batch, with what stands then. Events come in order of a job."""
    ship_package(events.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, top, now, last = state.get if state.exists else (0, 0, "queued", None)
        for pdf in batches:
            for x in pdf.sort_values(["ts", "seq"]).itertuples():
                if now in ("completed", "failed") or x.kind == "cancelled" and now == "running":
                    continue
                n, last = n + 1, x.ts
                if x.progress == x.progress and x.progress is not None:
                    top = max(top, min(100, max(0, int(x.progress))))
                if x.kind in STATES:
                    now = x.kind
        if last is not None:
            state.update((n, top, now, last))
            yield pd.DataFrame({"job": [key[0]], "events": [n], "progress": [100 if now == "completed" else min(top, 99)], "state": [now], "last": [last]})

    return events.groupBy("job").applyInPandasWithState(run, OUTPUT, STATE, "update", "NoTimeout")
