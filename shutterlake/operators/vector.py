"""Exact vector search: an index as a table, top-k, the elbow cut, hydration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from .listing import live

TOP, LEAST_GAP = 50, 0.05
#: Queries to a block of an all-pairs search, vectors to a shard.
QUERY_ROWS, SHARD_ROWS = 2048, 16384


def indexed(rows: DataFrame, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """id, unit: what the index holds; vectors without a direction are left out."""
    return rows.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), vectors.unit(F.col(vector)).alias("unit")).where("unit is not null")


def upserted(index: DataFrame, rows: DataFrame) -> DataFrame:
    """index with rows (id, unit) in place of those of the same id."""
    return index.join(rows.select("id"), "id", "left_anti").unionByName(rows)


def removed(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id"), "id", "left_anti")


def wants_compaction(total: int, tombstones: int) -> bool:
    return tombstones * 10 > total


def rebuilt(images: DataFrame, dim: int) -> DataFrame:
    """The index of the live, analysed images; vectors of another length are skipped."""
    return indexed(live(images).where(F.col("semantic_analysis_done") & (F.size("embedding") == dim)))


def unit_literal(query: list[float]) -> Column | None:
    q = np.asarray(query, float)
    n = np.sqrt((q * q).sum())
    return None if n < vectors.LEAST_NORM else F.array(*(F.lit(float(x)) for x in q / n))


def top_k(index: DataFrame, query: list[float], k: int = TOP) -> DataFrame:
    """id, score: the k best by cosine; none for a query without a direction."""
    q = unit_literal(query)
    if q is None:
        return index.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    return index.select("id", vectors.dot(F.col("unit"), q).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def elbow(hits: DataFrame, by: tuple[str, ...] = (), least: float = LEAST_GAP) -> DataFrame:
    """Hits (id, score) up to the first of the largest drops of at least `least`
    between neighbours; all without one. With rank, for each `by`."""
    place = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    rows = hits.withColumn("rank", F.row_number().over(place)).withColumn("gap", F.col("score") - F.lead("score").over(place))
    whole = Window.partitionBy(*by)
    steep = F.struct(F.col("gap").alias("gap"), (-F.col("rank")).alias("first"))
    rows = rows.withColumn("cut", F.max(F.when(F.col("gap") >= least, steep)).over(whole))
    return rows.where(F.col("cut").isNull() | (F.col("rank") <= -F.col("cut.first"))).drop("gap", "cut")


def hydrated(hits: DataFrame, images: DataFrame) -> DataFrame:
    """Hits with their live image, in order; the others are dropped."""
    return hits.join(live(images).select("id", "path", "folder_id"), "id").select("id", "path", "folder_id", "score", "rank")


def similar_to(index: DataFrame, images: DataFrame, image_id: int, query: list[float], exclude_self_first: bool = False) -> DataFrame:
    """Search by a stored image. The image is taken out after the cut, as a
    result of it, unless asked otherwise."""
    if exclude_self_first:
        return hydrated(elbow(top_k(index.where(F.col("id") != image_id), query)), images)
    return hydrated(elbow(top_k(index, query)).where(F.col("id") != image_id), images)


def knn_of(rows: DataFrame, face_id: int, vector: list[float] | None, k: int) -> DataFrame:
    """id, distance: the k nearest by L2, the face itself left out; none for an unknown one."""
    if vector is None:
        return rows.select("id", F.lit(0.0).alias("distance")).where(F.lit(False))
    q = F.array(*(F.lit(float(x)) for x in vector))
    near = rows.select("id", vectors.l2(F.col("embedding"), q).alias("distance")).orderBy("distance", "id").limit(k + 1)
    return near.where(F.col("id") != face_id).orderBy("distance", "id").limit(k)


#: Stands for no group; ids of groups are not that low.
_NO_GROUP = -(2**63)


def all_pairs_top(queries: DataFrame, rows: DataFrame, extra: str = "k", group: str | None = None) -> DataFrame:
    """id, other, score: for each query (id, embedding, k) its k nearest others
    by 1 - d*d/2, ties to the smaller id. With a group column those of the
    query's own group, if it has one, do not count.

    Rows are dealt to shards and queries to blocks, both of bounded size; every
    block meets every shard in one task by matrix product, keeps its k best
    there, and the shards' lists are merged.
    """
    count = lambda df: max(1, df.count())
    shards, blocks = -(-count(rows) // SHARD_ROWS), -(-count(queries) // QUERY_ROWS)
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = F.lit(_NO_GROUP) if group is None else F.coalesce(F.col(group).cast("long"), F.lit(_NO_GROUP))
    left = queries.select("id", "embedding", F.col(extra).cast("int").alias("k"), own.alias("own")).withColumn("block", deal(blocks)).withColumn("shard", each(shards))
    right = rows.select("id", "embedding", own.alias("group")).withColumn("other_shard", deal(shards)).withColumn("other_block", each(blocks))
    right = right.select(F.col("id").alias("other"), F.col("embedding").alias("vector"), "group", "other_shard", "other_block")  # names of their own: the sides may be one table

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            x = x.sort_values("other")
            a, b = np.stack(q["embedding"]).astype(float), np.stack(x["vector"]).astype(float)
            ids, groups = x["other"].to_numpy(), x["group"].to_numpy()
            sq = (b * b).sum(axis=1)
            for at in range(0, len(q), 256):
                part = a[at : at + 256]
                score = 1 - ((part * part).sum(axis=1)[:, None] + sq[None] - 2 * part @ b.T) / 2
                for row, me, k, mine in zip(score, *(q[c].to_numpy()[at : at + 256] for c in ("id", "k", "own")), strict=True):
                    row = np.where((ids == me) | ((groups == mine) & (mine != _NO_GROUP)), -np.inf, row)
                    k = min(int(k), len(ids) - 1) if me in ids else min(int(k), len(ids))
                    if k <= 0:
                        continue
                    bar = np.partition(row, -k)[-k] if k < len(row) else -np.inf
                    may = np.flatnonzero((row >= bar) & np.isfinite(row))
                    best = may[np.lexsort((ids[may], -row[may]))][:k]
                    out += zip([int(me)] * len(best), ids[best].tolist(), row[best].tolist(), strict=True)
        return pd.DataFrame(out, columns=["id", "other", "score"]).astype({"id": "int64", "other": "int64", "score": "float64"})

    hits = left.groupBy("shard", "block").cogroup(right.groupBy("other_shard", "other_block")).applyInPandas(search, "id long, other long, score double")
    if shards == 1:
        return hits
    best = Window.partitionBy("id").orderBy(F.col("score").desc(), "other")
    ks = queries.select("id", F.col(extra).alias("k"))
    return hits.withColumn("place", F.row_number().over(best)).join(ks, "id").where("place <= k").select("id", "other", "score")
