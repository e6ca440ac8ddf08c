"""Queries over whole jobs, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..fixtures import Catalog, sql
from ..operators import jobs as J
from ..sources.files import inferred
from .relational import ACTIONS, NOW, _listing


def _roots(c: Catalog):
    """Folders whose deepest one holds the listing's files."""
    return c.spark.createDataFrame([(90, "/"), (91, "/img"), (92, "/elsewhere")], "id long, path string")


def _digest(paths: list[str]) -> list[str | None]:
    return [None if p.endswith("9.jpg") else hashlib.sha256(p.encode()).hexdigest() for p in paths]


def _hashed(c: Catalog):
    return J.hash_batch(c.images, _digest).select("id", "file_hash", "hash_status")


def _rescan(c: Catalog, folder_id: int | None = None):
    return J.scanned(c.images, _roots(c), c.queue, _listing(c), NOW, folder_id)


def _answers(c: Catalog):
    """A model that fails for some images."""

    def model(items: list) -> list:
        if any(i % 3 == 0 for i in items):
            raise ValueError("cannot tell")
        return [[float(i % 7)] for i in items]

    rows = c.queue.where("pipeline = 'semantic'").select(F.col("image_id").alias("id"), F.col("image_id").alias("item"))
    return inferred(rows, "item", model)


def _after_analysis(c: Catalog):
    return J.analysed(c.images, c.queue, _answers(c), "semantic", NOW)


def _settings(c: Catalog):
    return c.spark.createDataFrame([(J.IMAGE_MODEL, "base"), (J.FACE_MODEL, "fast"), ("theme", "dark")], "key string, value string")


def _switched(c: Catalog, key: str, value: str):
    empty = c.spark.createDataFrame([], "face_a long, face_b long, weight double")
    return J.updated_setting(_settings(c), c.images, c.queue, empty, empty, key, value, NOW, lambda p: {"fast": "s", "large": "l"}.get(p or "", "s"))


def _pixels(c: Catalog):
    """Images of 2 by 1 pixels from parts."""
    p = c.raw("part").select(F.col("p_partkey").alias("id"), F.unhex(F.lpad(F.hex(F.col("p_partkey") * 7919), 12, "0")).alias("pixels"))
    return J.pixels(p)


STATE = "SELECT i.path, CASE WHEN action IN ('touched', 'modified', 'failed') THEN disk_size ELSE i.file_size END AS file_size, CASE action WHEN 'modified' THEN 'DONE' WHEN 'failed' THEN 'FAILED' ELSE hash_status END AS hash_status, {deleted} AS deleted_at, i.folder_id FROM images i JOIN found f ON f.id = i.id UNION ALL SELECT path, disk_size, 'PENDING', NULL, 91 FROM found WHERE action = 'new'"
BACK = "WHEN action IN ('undelete', 'touched', 'modified') THEN NULL ELSE deleted_at END"
SAMPLED = "ticks AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT // 60 AS t, count(*) AS n FROM events GROUP BY 1, 2), states AS (SELECT user_id, t, sum(n) OVER (PARTITION BY user_id ORDER BY t) AS done, t % 3 AS pending FROM ticks), taken AS (SELECT * FROM states WHERE t % CASE WHEN pending > 0 THEN 1 ELSE 2 END = 0)"


def _ticks(c: Catalog):
    from pyspark.sql import Window

    t = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).cast("long")
    rows = c.raw("events").groupBy("user_id", t.alias("t")).agg(F.count("*").alias("n"))
    rows = rows.withColumn("done", F.sum("n").over(Window.partitionBy("user_id").orderBy("t"))).withColumn("pending", F.pmod(F.col("t"), F.lit(3)))
    return J.sampled(rows, by=("user_id",)).select("user_id", "t", "delta")


def queries() -> dict:
    return {
        "t13_hash_batch": (_hashed, sql("SELECT id, CASE WHEN hash_status = 'PENDING' AND deleted_at IS NULL AND path NOT LIKE '%9.jpg' THEN sha256(path) ELSE file_hash END AS file_hash, CASE WHEN hash_status = 'PENDING' AND deleted_at IS NULL THEN CASE WHEN path LIKE '%9.jpg' THEN 'FAILED' ELSE 'DONE' END ELSE hash_status END AS hash_status FROM images", "images")),
        "t14_rescan": (lambda c: _rescan(c)["images"].select("path", "file_size", "hash_status", "deleted_at", "folder_id"), sql(ACTIONS + ">> " + STATE.format(deleted=f"CASE WHEN action = 'delete' THEN {NOW} {BACK}"), "folders", "images")),
        "t14_folder_scan": (lambda c: _rescan(c, 91)["images"].select("path", "file_size", "hash_status", "deleted_at", "folder_id"), sql(ACTIONS + ">> " + STATE.format(deleted=f"CASE {BACK}"), "folders", "images")),
        "t14_rescan_queue": (lambda c: _rescan(c)["queue"].select("image_id", "pipeline", "attempts", "scheduled_at"), sql(ACTIONS + f", again AS (SELECT id FROM found WHERE action = 'modified' UNION ALL SELECT (SELECT max(id) FROM images) + row_number() OVER (ORDER BY path) FROM found WHERE action = 'new') >> SELECT image_id, pipeline, attempts, scheduled_at FROM queue WHERE image_id NOT IN (SELECT id FROM again) UNION ALL SELECT id, p, 0, {NOW} FROM again, (VALUES ('semantic'), ('subject')) x(p)", "folders", "images", "queue")),
        "t15_done": (lambda c: _after_analysis(c)["images"].select("id", "semantic_analysis_done"), sql("asked AS (SELECT image_id FROM queue WHERE pipeline = 'semantic' AND image_id % 3 <> 0) >> SELECT id, semantic_analysis_done OR id IN (SELECT image_id FROM asked) AS semantic_analysis_done FROM images", "images", "queue")),
        "t15_queue": (lambda c: _after_analysis(c)["queue"].select("image_id", "pipeline", "attempts", "scheduled_at"), sql(f"asked AS (SELECT *, pipeline = 'semantic' AND image_id % 3 = 0 AS bad FROM queue WHERE pipeline <> 'semantic' OR image_id % 3 = 0) >> SELECT image_id, pipeline, attempts + bad::INT AS attempts, CASE WHEN bad THEN {NOW} + least(5 * pow(2, attempts), 120)::BIGINT ELSE scheduled_at END AS scheduled_at FROM asked WHERE NOT bad OR attempts + 1 < 7", "queue")),
        "t16_sampler": (_ticks, f"WITH {SAMPLED} SELECT user_id, t, greatest(done - lag(done) OVER (PARTITION BY user_id ORDER BY t), 0)::BIGINT AS delta FROM taken"),
        "d13_switched": (lambda c: _switched(c, J.IMAGE_MODEL, "new")["queue"].groupBy("pipeline").agg(F.count("*").alias("n")), sql("SELECT pipeline, count(*) AS n FROM images, (VALUES ('semantic'), ('subject')) p(pipeline) WHERE deleted_at IS NULL GROUP BY 1", "images")),
        "d13_stored": (lambda c: _switched(c, J.FACE_MODEL, "large")["settings"], "SELECT * FROM (VALUES ('embedding_model', 'base'), ('subject_model', 'large'), ('theme', 'dark')) x(key, value)"),
        "s10_progress": (lambda c: J.progress(c.images.count(), J.RESCAN_STEP, c.spark), sql("n AS (SELECT count(*) AS n FROM images), steps AS (SELECT least(s * 100, n) AS done, n FROM n, range(1, (SELECT (n + 99) // 100 FROM n) + 1) r(s)) >> SELECT 'sync_progress' AS event, '{\"done\":' || done || ',\"total\":' || n || '}' AS payload FROM steps UNION ALL SELECT 'sync_complete', '{}'", "images")),
        "f20_planes": (lambda c: _pixels(c).select("id", F.transform("planes", lambda x: F.round(x.cast("double"), 4)).alias("planes")), "WITH b AS (SELECT p_partkey AS id, lpad(hex(p_partkey * 7919), 12, '0') AS h FROM part) SELECT id, list_transform([1, 4, 2, 5, 3, 6], lambda k: round((('0x' || substr(h, k * 2 - 1, 2))::INTEGER / 255.0 - 0.5) / 0.5, 4)) AS planes FROM b"),
    }
