"""Queries that run streams, hooks and stored forms to their end."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixtures import Catalog, sql
from ..functions import numeric as N
from ..functions import vectors
from ..operators import graph as G
from ..operators import mutations as M
from ..operators import vector as V
from ..operators.store import Snapshots, shared_folder
from ..sources import files
from ..streaming import events as T
from .advanced import MUTUAL, SAMPLES, TAU, _index, _knn, _r, _samples, _vec
from .relational import CACHE, _cache


def _events(c: Catalog) -> DataFrame:
    raw = c.spark.readStream.schema(c.raw("events").schema).parquet(f"{c.dir}/events*.parquet")
    return raw.select("event_id", F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("ts"))


def _drained(stream: DataFrame) -> DataFrame:
    """What a stream appends until its input is used up."""
    at = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def _batches(c: Catalog) -> DataFrame:
    at = f"{shared_folder(c.spark)}/batches-{uuid.uuid4().hex}"

    def handle(batch: DataFrame, k: int) -> None:
        batch.groupBy("path").agg(F.count("*").alias("n")).withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{at}/out/batch={k}/part")

    T.run_batches(_events(c), handle, f"{at}/state")
    rows = c.spark.read.option("recursiveFileLookup", "true").parquet(f"{at}/out")
    return rows.groupBy("path").agg(F.sum("n").alias("n"))


def _stored(c: Catalog) -> DataFrame:
    store = Snapshots(c.spark, f"{shared_folder(c.spark)}/store-{uuid.uuid4().hex}")
    store.commit({"tags": c.tags, "folders": c.folders})
    store.commit({"tags": M.rename_tag(store.read("tags"), 3, "Renamed")})
    return store.read("tags").select("id", "name")


def _index_file(c: Catalog) -> DataFrame:
    at = f"{shared_folder(c.spark)}/index-{uuid.uuid4().hex}"
    _index(c).select("id", vectors.half_precision(F.col("unit").cast("array<float>")).alias("unit")).write.parquet(at)
    held = files.read_index(c.spark, at, lambda: _index(c))
    return held.select("id", F.round(F.get("unit", F.lit(0)).cast("double"), 2).alias("x0"))


def laplacian_variance(pixels: Column, width: int) -> Column:
    """Population variance of a grey image's four-neighbour Laplacian, rows of `width` in one array."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        import numpy as np

        def one(x):
            a = np.asarray(x, float).reshape(-1, width)
            if min(a.shape) < 3:
                return 0.0
            lap = a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:] - 4 * a[1:-1, 1:-1]
            return float(lap.var())

        return s.map(one)

    return run(pixels)


def queries() -> dict:
    return {
        "t1_stream_sessions": (lambda c: _drained(T.session_stream(_events(c), "6 hours", "1 hour")), None),
        "t12_stream_windows": (lambda c: _drained(T.windowed_counts(_events(c), "1 day", "12 hours", "1 hour")), None),
        "t7_stream_batches": (_batches, sql("SELECT path, count(*) AS n FROM fs_events GROUP BY 1", "fs_events")),
        "s7_snapshots": (_stored, sql("SELECT id, CASE WHEN id = 3 THEN 'Renamed' ELSE name END AS name FROM tags", "tags")),
        "s8_index_file": (_index_file, None),
        "s11_blobs": (lambda c: c.face_vectors.select("id", vectors.from_blob(vectors.to_blob(F.col("embedding"))).alias("v")).select("id", F.round(F.get("v", F.lit(1)).cast("double"), 6).alias("x1"), F.size("v").cast("long").alias("dim")), sql("SELECT id, round(embedding[2]::DOUBLE, 6) AS x1, len(embedding) AS dim FROM face_vectors", "face_vectors")),
        "v12_vector_delete": (lambda c: V.removed(c.face_vectors, c.face_vectors.where("id % 3 = 1")).select("id"), sql("SELECT id FROM face_vectors WHERE id % 3 <> 1", "face_vectors")),
        "v8_search_by_bytes": (lambda c: V.hydrated(V.elbow(V.top_k(_index(c), _vec(c, 11))), c.images).select("id", "rank"), None),
        "v13_embedded": (lambda c: files.inferred(c.raw("documents").select(F.col("doc_id").alias("id"), "text"), "text", files.hashing_embedder(16)).select("id", F.size("result").alias("dim"), "error"), "SELECT doc_id AS id, 16 AS dim, NULL::VARCHAR AS error FROM documents"),
        "v15_cache_upsert": (lambda c: M.upsert(_cache(c).dropDuplicates(["cache_key"]).withColumn("query_type", F.lit("text")).select("cache_key", "query_type"), c.spark.createDataFrame([("q1", "image"), ("new", "image")], "cache_key string, query_type string"), "cache_key"), sql(CACHE + "SELECT DISTINCT cache_key, CASE cache_key WHEN 'q1' THEN 'image' ELSE 'text' END AS query_type FROM cache UNION ALL SELECT 'new', 'image'")),
        "g9_full_sweep": (lambda c: G.mutual_edges(_knn(c), TAU).select("face_a", "face_b", _r(F.col("weight")).alias("weight")), sql(MUTUAL + ">> SELECT face_a, face_b, round(weight, 6) AS weight FROM mutual", "face_vectors")),
        "f12_done_delta": (lambda c: T.done_deltas(_samples(c).withColumnRenamed("n", "done"), ("user_id",)).select("user_id", "t", F.col("n").cast("long").alias("n")), sql(SAMPLES + ">> SELECT user_id, t, greatest(n - coalesce(lag(n) OVER (PARTITION BY user_id ORDER BY t), n), 0) AS n FROM samples")),
        "f20_pixels": (lambda c: c.raw("part").select("p_partkey", _r(N.pixel(F.col("p_size"))).alias("x")), "SELECT p_partkey, round((p_size / 255.0::DOUBLE - 0.5) / 0.5, 6) AS x FROM part"),
        "a13_laplacian": (lambda c: c.raw("part").select("p_partkey", _r(laplacian_variance(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: (i * F.col("p_size") % 7) * 10), 5)).alias("variance")), None),
        "o2_newest": (lambda c: c.images.select("id", N.taken(F.col("date_taken"), F.col("mtime")).alias("taken")).orderBy(F.col("taken").desc(), F.col("id").desc()).limit(25), sql("SELECT id, coalesce(date_taken, mtime) AS taken FROM images ORDER BY taken DESC, id DESC LIMIT 25", "images")),
        "o4_top_n": (lambda c: c.raw("part").select("p_partkey", "p_retailprice").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(10), "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10"),
    }
