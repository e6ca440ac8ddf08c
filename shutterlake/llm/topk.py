"""Exact top-k search by inner product with MaxScore.

A query's terms are the dimensions of its vector. In a shard of candidates,
term d contributes q_d * x_d, between its least and its greatest value there.
Terms are ordered by the width of that interval. While a shard is traversed in
order of id, the k-th best score so far splits them: the non-essential terms are
those which, all at their greatest, cannot lift a candidate over it. Essential
columns ("postings") are read for each block of candidates; the other terms are
probed, widest first, only for candidates still able to enter. The shards'
lists are then merged.

Candidates are dealt to shards of about `shard_rows`, queries to blocks of
`query_rows`; a task holds one shard and one block of queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HITS = "query_id long, vec_id long, score long"


def quantized(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(256) * x.cast("double")))


def maxscore(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int, block: int = 256) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the k best (ids, scores) of candidates in ascending id;
    own[i] is the id that query i leaves out; ties go to smaller ids. Entries
    are numbers whose sums of products are exact in their type. Blocks of
    candidates grow fourfold, since the bar is nearly final after the first."""
    cols, out = np.ascontiguousarray(vectors.T), []
    high, low = vectors.max(axis=0), vectors.min(axis=0)
    for q, me in zip(queries, own, strict=True):
        most, least = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
        order = np.argsort(least - most, kind="stable")  # widest interval first
        whole, q, most, least = q, q[order], most[order], least[order]
        reach = np.append(np.cumsum(most[::-1])[::-1], 0)  # greatest sum of terms i and later
        lift = reach - np.append(np.cumsum(least[::-1])[::-1], 0)  # over their least sum
        best_id, best = np.empty(0, ids.dtype), np.empty(0, vectors.dtype)
        end, size = 0, block
        while end < len(ids):
            here = slice(end, end + size)
            at, end, size = end, end + size, size * 4
            bar, terms = (best[-1], int((lift > best[-1] - least.sum()).sum())) if len(best) == k else (None, len(q))
            if not terms:
                break  # no candidate of this shard can enter any more
            essential = whole
            if terms < len(q):
                essential = whole.copy()
                essential[order[terms:]] = 0
            score = essential @ cols[:, here]  # a view: columns are not copied for each query
            live = np.flatnonzero(ids[here] != me)
            score = score[live]
            for i in range(terms, len(q)):  # non-essential terms, while competitive
                keep = score + reach[i] > bar
                live, score = live[keep], score[keep]
                if not len(live):
                    break
                score = score + q[i] * cols[order[i], at + live]
            if bar is not None:
                live, score = live[score > bar], score[score > bar]
            if len(live):
                best_id, best = np.concatenate([best_id, ids[at + live]]), np.concatenate([best, score])
                first = np.lexsort((best_id, -best))[:k]
                best_id, best = best_id[first], best[first]
        out.append((best_id, best))
    return out


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows padded with zeros to width."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int, shard_rows: int = 4096, query_rows: int = 4096) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score of each query's k best
    candidates by inner product, all if fewer; ties to smaller vec_id.

    Both tables: vec_id long, vec array<long>. A candidate with the query's id
    is left out. Rows with a null id or vector take no part; of rows equal in
    both one does. Shorter vectors count as padded with zeros. Empty tables give
    an empty result, queries without candidates no rows. Scores must fit a long.
    """
    # A row is numbered by a hash of its id, so shards are even whatever the ids.
    held = {name: df.select("vec_id", "vec").where("vec_id is not null and vec is not null").distinct() for name, df in (("q", queries), ("x", candidates))}
    count = {name: max(1, df.count()) for name, df in held.items()}
    shards, blocks = -(-count["x"] // shard_rows), -(-count["q"] // query_rows)
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = held["q"].withColumn("block", deal(blocks)).withColumn("shard", each(shards))
    right = held["x"].withColumn("shard", deal(shards)).withColumn("block", each(blocks))

    def search(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(q) and len(x):
            x = x.sort_values("vec_id", kind="stable")
            width = max(max(map(len, q["vec"])), max(map(len, x["vec"])), 1)
            a, b = _matrix(q["vec"], width), _matrix(x["vec"], width)
            exact = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * width < 2**52
            a, b = (a.astype(float), b.astype(float)) if exact else (a.astype(object), b.astype(object))
            for me, (ids, scores) in zip(q["vec_id"], maxscore(a, x["vec_id"].to_numpy(), b, q["vec_id"].to_numpy(), k), strict=True):
                rows += [(int(me), int(i), int(s)) for i, s in zip(ids, scores, strict=True)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    hits = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select("vec_id", "embedding").where(F.col("embedding").isNotNull()).where(finite).select("vec_id", quantized(F.col("embedding")).alias("vec"))
    return exact_top_k(rows.where(F.col("vec_id") % every == 0), rows, k)
