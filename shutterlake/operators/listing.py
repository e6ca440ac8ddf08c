"""Scans, lookups, filters and orders over the catalog's tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric, text

CACHE_SECONDS = 1800


def live(images: DataFrame) -> DataFrame:
    return images.where(F.col("deleted_at").isNull())


def taken() -> Column:
    return numeric.taken(F.col("date_taken"), F.col("mtime"))


def ranked(df: DataFrame, *order: Column, name: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """df with its place in an order: within `by`, or over all rows, which then
    go through one task. Meant for results of a bounded size."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def list_folders(folders: DataFrame) -> DataFrame:
    return folders.select("id", "path", "added_at").orderBy("added_at", "id")


def lookup(df: DataFrame, *columns: str, **key) -> DataFrame:
    """At most one row, by a unique key."""
    for c, v in key.items():
        df = df.where(F.col(c) == F.lit(v))
    return df.select(*columns).limit(1)


def scan_metadata(images: DataFrame) -> DataFrame:
    """What a rescan compares, deleted rows included."""
    return images.select("id", "path", "file_hash", "file_size", "mtime", "hash_status", "deleted_at")


def list_images(images: DataFrame, folder_id: int | None = None) -> DataFrame:
    rows = live(images)
    rows = rows if folder_id is None else rows.where(F.col("folder_id") == folder_id)
    return rows.orderBy(taken().desc(), F.col("id").desc())


def needs_preview(images: DataFrame) -> DataFrame:
    return live(images).where(F.col("thumbnail_path").isNull()).orderBy(taken().desc(), F.col("id").desc())


def pending_hash(images: DataFrame, n: int = 32) -> DataFrame:
    return live(images).where(F.col("hash_status") == "PENDING").orderBy("id").limit(n)


def due(queue: DataFrame, pipeline: str, now: int, n: int = 12) -> DataFrame:
    return queue.where((F.col("pipeline") == pipeline) & (F.col("scheduled_at") <= now)).orderBy("scheduled_at", "id").limit(n)


def embedding_ready(images: DataFrame) -> DataFrame:
    return live(images).where(F.col("semantic_analysis_done") & F.col("embedding").isNotNull())


def cache_hits(cache: DataFrame, now: int, key: str | None = None) -> DataFrame:
    """Entries younger than CACHE_SECONDS; one exactly as old is neither served nor evicted."""
    rows = cache.where(F.col("created_at") > now - CACHE_SECONDS)
    return rows if key is None else rows.where(F.col("cache_key") == key)


def cache_evicted(cache: DataFrame, now: int) -> DataFrame:
    return cache.where(~(F.col("created_at") < now - CACHE_SECONDS))


def duplicate_name(subjects: DataFrame, name: str, not_id: int) -> DataFrame:
    same = text.ascii_lower(F.col("name")) == text.ascii_lower(F.lit(name.strip()))
    return subjects.where(same & (F.col("id") != not_id)).orderBy("id").limit(1)


def taken_between(images: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Both ends inclusive. Undated images are hidden while a range is set."""
    if start is None and end is None:
        return images
    d = F.col("date_taken")
    within = d.isNotNull()
    if start is not None:
        within &= d >= start
    if end is not None:
        within &= d <= end
    return images.where(within)


def merge_candidates(subjects: DataFrame, query: str, source: int, target: int) -> DataFrame:
    rows = subjects.where(F.col("name").isNotNull() & ~F.col("id").isin(source, target))
    return rows.where(text.contains_ignoring_case(F.col("name"), query))


def with_ids(df: DataFrame, column: str, ids: Iterable[int]) -> DataFrame:
    """Rows of given ids; none for an empty list."""
    ids = list(ids)
    return df.where(F.col(column).isin(*ids)) if ids else df.where(F.lit(False))


def subjects_by_name(subjects: DataFrame) -> DataFrame:
    """Named first, then newest."""
    return subjects.orderBy(F.col("name").isNull(), F.col("added_at").desc(), "id")


def newest(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("added_at").desc(), F.col("id").desc())


def sort_key(wanted: str | None, default: str | None, available: list[str]) -> str | None:
    """The wanted order if it is available, else the default, else the first."""
    return next((k for k in (wanted, default) if k in available), available[0] if available else None)


def available_orders(df: DataFrame) -> list[str]:
    """Relevance is available if there are rows and all have a score."""
    if "score" not in df.columns:
        return ["dateTaken"]
    r = df.agg(F.count("*").alias("n"), F.count("score").alias("scored")).first()
    return ["dateTaken", "relevance"] if r["n"] and r["n"] == r["scored"] else ["dateTaken"]


def in_order(df: DataFrame, key: str, ascending: bool = False) -> DataFrame:
    """By date or score, ids breaking ties; ascending is the exact reverse."""
    by = [taken() if key == "dateTaken" else F.col("score"), F.col("id")]
    return df.orderBy(*(c.asc() if ascending else c.desc() for c in by))
