"""Jobs: steps over the catalog put together, tables in and tables out.

A job returns the tables that it changes; Snapshots.commit publishes them as one.
What it has to say while it runs or at its end are rows (event, payload).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import graph as G
from . import mutations as M
from .listing import live, pending_hash
from .relations import deepest_folder

#: Files between two progress events of a rescan and of one folder's scan.
RESCAN_STEP, FOLDER_STEP = 100, 10
#: Fixed value: images that wait for analysis from which hashing pauses.
MOST_PENDING = 48
#: Settings whose change makes derived data stale.
IMAGE_MODEL, FACE_MODEL = "embedding_model", "subject_model"


def events(name: str, payload: DataFrame | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Rows (event, payload as JSON): one a row of payload, or one without any."""
    if payload is None:
        return spark.range(1).select(F.lit(name).alias("event"), F.lit("{}").alias("payload"))
    return payload.select(F.lit(name).alias("event"), F.to_json(F.struct("*")).alias("payload"))


def progress(total: int, step: int, spark: SparkSession) -> DataFrame:
    """sync_progress after each `step` files and after the last, then sync_complete."""
    rows = spark.range(step, total + step, step).select(F.least("id", F.lit(total)).alias("done"), F.lit(total).cast("long").alias("total"))
    return events("sync_progress", rows).unionByName(events("sync_complete", spark=spark))


def hash_batch(images: DataFrame, hasher: Callable[[list[str]], list[str | None]], n: int | None = None) -> DataFrame:
    """images after all that wait for a hash (or the first n) have one: hasher
    gets paths and gives hashes, None for a file that cannot be read. A hash for
    an image that changed meanwhile is dropped by its mtime."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "mtime": batch["mtime"], "hash": hasher(batch["path"].tolist())})

    waiting = live(images).where("hash_status = 'PENDING'") if n is None else pending_hash(images, n).select("id").join(images, "id")
    return M.apply_hashes(images, waiting.select("id", "path", "mtime").mapInPandas(run, "id long, mtime long, hash string"))


def may_hash(queue: DataFrame, most: int = MOST_PENDING) -> bool:
    """Whether few enough images wait for analysis that hashing goes on."""
    return queue.select("image_id").distinct().limit(most + 1).count() <= most


def scanned(images: DataFrame, folders: DataFrame, queue: DataFrame, listing: DataFrame, now: int, folder_id: int | None = None) -> dict[str, DataFrame]:
    """images, queue and found after a directory listing (path, size, mtime,
    hash) was held against the catalog. New and modified images are queued; new
    ones belong to the deepest folder that holds them, those outside all folders
    are passed over. The scan of one folder takes its files only and marks none
    as deleted."""
    homes = deepest_folder(listing.select("path"), folders).select("path", F.col("folder_id").alias("home"))
    files = listing.join(homes.where("home is not null"), "path")
    if folder_id is not None:
        files = files.where(F.col("home") == folder_id)
    found = M.changes(files, images)
    if folder_id is not None:
        found = found.where("action not in ('delete', 'gone')")
    known = M.apply_changes(images, found, now)
    new = found.where("action = 'new'").join(files.select("path", "home"), "path")
    made = new.select(
        "path",
        F.col("home").alias("folder_id"),
        F.col("disk_size").alias("file_size"),
        F.col("disk_mtime").alias("mtime"),
        F.lit("").alias("file_hash"),
        F.lit("PENDING").alias("hash_status"),
        F.lit(False).alias("semantic_analysis_done"),
        F.lit(False).alias("subject_analysis_done"),
        F.lit(now).cast("long").alias("added_at"),
        F.lit(now).cast("long").alias("updated_at"),
    )
    after = M.insert(known, made, F.col("path"))
    again = found.where("action = 'modified'").select(F.col("id").alias("image_id")).unionByName(after.join(new.select("path"), "path", "left_semi").select(F.col("id").alias("image_id")))
    return {"images": after, "queue": M.enqueued(queue, again, now), "found": found}


def analysed(images: DataFrame, queue: DataFrame, answers: DataFrame, pipeline: str, now: int) -> dict[str, DataFrame]:
    """images, queue and results after a model's answers (id, result, error, as
    inferred() gives them): images with a result are done, the others are tried
    again later, or given up after the last attempt."""
    good = answers.where("error is null").select(F.col("id").alias("image_id"), "result")
    bad = answers.where("error is not null").select(F.col("id").alias("image_id"), F.lit(pipeline).alias("pipeline"))
    images, queue = M.done(images, queue, good, pipeline)
    return {"images": images, "queue": M.failed(queue, bad, now), "results": good}


def relabelled(faces: DataFrame, subjects: DataFrame, edges: DataFrame, constraints: DataFrame, dismissed: DataFrame, now: int) -> dict[str, DataFrame]:
    """faces, subjects, suggestions and counts after the kept edges were
    clustered anew under the constraints: actions applied, subjects without faces
    dropped, missing thumbnails filled, merges proposed."""
    clusters = G.constrained_components(faces.select("id"), edges, constraints).select("id", "cluster")
    actions = G.label_actions(clusters, faces, subjects)
    after, grown = M.apply_labels(clusters, actions, faces, subjects, now)
    kept = grown.join(after.where("subject_id is not null").select(F.col("subject_id").alias("id")), "id", "left_semi").select(*subjects.columns)
    kept = M.with_thumbnails(kept, after)
    counts = actions.agg(F.count(F.when(F.col("action") == "new_subject", 1)).alias("clusters"), F.coalesce(F.sum(F.when(F.col("action") == "noise", F.col("size"))), F.lit(0)).alias("noise"))
    return {"faces": after, "subjects": kept, "suggestions": G.merge_suggestions(edges, after, kept, constraints, dismissed), "counts": counts}


def updated_setting(settings: DataFrame, images: DataFrame, queue: DataFrame, edges: DataFrame, suggestions: DataFrame, key: str, value: str, now: int, embedder_of: Callable[[str | None], str] = lambda preset: preset or "") -> dict[str, DataFrame]:
    """The tables that a setting's new value changes. Another image model queues
    every live image in both pipelines; a face preset with another embedder
    queues them for faces and clears edges and suggestions. The value that is
    there already changes nothing else. embedder_of: of a preset, or of none."""
    row = settings.where(F.col("key") == key).select("value").first()
    was = row["value"] if row else None
    new = settings.sparkSession.createDataFrame([(key, value)], "key string, value string")
    out = {"settings": M.upsert(settings, new, "key")}
    if key == IMAGE_MODEL and was != value:
        out["images"], out["queue"] = M.reset_embeddings(images, queue, now)
    if key == FACE_MODEL and was != value and embedder_of(was) != embedder_of(value):
        out |= M.stale_subjects(images, queue, now) | {"edges": M.cleared(edges), "suggestions": M.cleared(suggestions)}
    return out


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[Callable[[], None]]:
    """Jobs started inside carry a tag; the function given cancels them all, from
    any thread, and the action that waits for them then raises."""
    context = spark.sparkContext
    context.addJobTag(tag)
    try:
        yield lambda: context.cancelJobsWithTag(tag)
    finally:
        context.removeJobTag(tag)


def pixels(rows: DataFrame, column: str = "pixels") -> DataFrame:
    """id, planes: an image's bytes (height * width * 3, row by row, colours
    together) as (p / 255 - 0.5) / 0.5, one plane a colour after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            planes = [None if x is None else ((np.frombuffer(x, np.uint8).reshape(-1, 3).T / np.float32(255) - np.float32(0.5)) / np.float32(0.5)).ravel() for x in batch["pixels"]]
            yield pd.DataFrame({"id": batch["id"], "planes": planes})

    return rows.select("id", F.col(column).alias("pixels")).mapInPandas(run, "id long, planes array<float>")


def sampled(samples: DataFrame, active: int = 1, idle: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """The ticks (t, done, pending) that a sampler takes: every `active` seconds
    while work is pending, every `idle` seconds otherwise, with the done count's
    growth since the tick before; the first is the baseline and has none."""
    tick = F.when(F.col("pending") > 0, F.lit(active)).otherwise(F.lit(idle))
    taken = samples.where(F.pmod(F.col("t"), tick) == 0)
    order = Window.partitionBy(*by).orderBy("t")
    return taken.withColumn("delta", F.greatest(F.col("done") - F.lag("done").over(order), F.lit(0)))
