"""File-change events: debouncing and coalescing, as batch and as stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a pending change and a further one make; "" is none.
AFTER = {
    ("Create", "Create"): "Create",
    ("Create", "Modify"): "Create",
    ("Create", "Remove"): "",
    ("Modify", "Create"): "Modify",
    ("Modify", "Modify"): "Modify",
    ("Modify", "Remove"): "Remove",
    ("Remove", "Create"): "Modify",
    ("Remove", "Modify"): "Modify",
    ("Remove", "Remove"): "Remove",
}
QUIET_SECONDS = 0.5


def folded(kinds: Column) -> Column:
    """What is left of an array of changes in order; "" if nothing is."""
    step = lambda a, k: F.coalesce(F.when(a == "", k), *(F.when((a == x) & (k == y), F.lit(z)) for (x, y), z in AFTER.items()), k)
    return F.aggregate(kinds, F.lit(""), step)


def fold(kinds: list[str]) -> str:
    state = ""
    for k in kinds:
        state = AFTER[state, k] if state else k
    return state


def bursts(events: DataFrame, quiet: float = QUIET_SECONDS) -> DataFrame:
    """path, first, last, n, kind ("" if dropped): a path's events with no pause
    longer than `quiet` seconds between them, coalesced in order of time, then id."""
    order = Window.partitionBy("path").orderBy("ts", "event_id")
    pause = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order)) > int(quiet * 1e6)
    rows = events.withColumn("burst", F.sum(F.coalesce(pause, F.lit(False)).cast("int")).over(order))
    listed = F.sort_array(F.collect_list(F.struct("ts", "event_id", "kind")))
    met = rows.groupBy("path", "burst").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), folded(F.transform(listed, lambda e: e["kind"])).alias("kind"))
    return met.drop("burst")


def coalesced_stream(events: DataFrame, quiet_ms: int = 500) -> DataFrame:
    """path, kind: a stream's changes after a path has been quiet in processing time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (kind,) = state.get
            state.remove()
            if kind:
                yield pd.DataFrame({"path": [key[0]], "kind": [kind]})
            return
        kind = state.get[0] if state.exists else ""
        for batch in batches:
            for k in batch.sort_values(["ts"], kind="stable")["kind"]:
                kind = AFTER[kind, k] if kind else k
        state.update((kind,))
        state.setTimeoutDuration(quiet_ms)

    return events.groupBy("path").applyInPandasWithState(run, "path string, kind string", "kind string", "append", "ProcessingTimeTimeout")


def session_stream(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """path, first, last, n of sessions in event time, with a watermark for late
    events, which the processing-time rule does not have."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("path", w).agg(F.count("*").alias("n")).select("path", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last"), "n")


def windowed_counts(events: DataFrame, length: str = "10 seconds", slide: str = "1 second", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", length, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def rates(samples: DataFrame, window: int, by: tuple[str, ...] = ()) -> DataFrame:
    """samples (t seconds, n) with rate: the number in the last `window` seconds,
    both ends inclusive, over the time since the oldest; 0 with fewer than two."""
    w = Window.partitionBy(*by).orderBy("t").rangeBetween(-window, 0)
    span = F.greatest((F.col("t") - F.min("t").over(w)).cast("double"), F.lit(1e-3))
    return samples.withColumn("rate", F.when(F.count("*").over(w) >= 2, F.sum("n").over(w) / span).otherwise(F.lit(0.0)))


def idle_segments(samples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """samples (t, n, pending) with segment: idle ticks (pending 0) start a new one."""
    order = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("segment", F.sum((F.col("pending") == 0).cast("int")).over(order))


def done_deltas(samples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """samples (t, done) with n: what was done since the sample before, never negative."""
    order = Window.partitionBy(*by).orderBy("t")
    return samples.withColumn("n", F.greatest(F.col("done") - F.coalesce(F.lag("done").over(order), F.col("done")), F.lit(0)))


def throttled(events: DataFrame, seconds: int) -> DataFrame:
    """One event a path and window that begins with the path's first event in it (tumbling from the first of all)."""
    order = Window.partitionBy("path").orderBy("ts", "event_id")
    at = F.floor((F.unix_seconds("ts") - F.unix_seconds(F.first("ts").over(order))) / seconds)
    rows = events.withColumn("slot", at)
    return rows.groupBy("path", "slot").agg(F.max(F.struct("ts", "event_id", "kind")).alias("e")).select("path", "slot", "e.event_id", "e.kind")


def run_batches(stream: DataFrame, apply, checkpoint: str, batches_wait: bool = True):
    """Hands each micro-batch to apply(df, id) and, with batches_wait, returns
    when all that is there has been handled."""
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    if batches_wait:
        done = query.trigger(availableNow=True).start()
        done.awaitTermination()
        return done
    return query.start()


def event_stream(spark: SparkSession, path: str, schema, per_batch: int = 1) -> DataFrame:
    """Change events from a folder of Parquet files; fewer files a batch hold the rest back."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
