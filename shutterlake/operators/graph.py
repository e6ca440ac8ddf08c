"""Face clustering: mutual neighbours, constrained components, label actions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relations import dismissed_subjects, without_pairs
from .store import settled
from .vector import all_pairs_top

#: Fixed values.
K, TAU = 5, 0.45
#: Up to so many edges (counted) one task finds the components by itself.
SMALL_EDGES = 50_000


def subject_knn(vectors: DataFrame, k: int = K, only: DataFrame | None = None) -> DataFrame:
    """id, other, score of faces (id, embedding, subject_id): k neighbours of
    other subjects, or of none. Faces of the own subject are left out inside the
    search, so a large subject costs no more than others."""
    asked = vectors.select("id", "embedding", "subject_id", F.lit(k).alias("k"))
    if only is not None:
        asked = asked.join(only.select("id"), "id", "left_semi")
    return all_pairs_top(asked, vectors, group="subject_id")


def mutual_edges(knn: DataFrame, tau: float = TAU) -> DataFrame:
    """face_a < face_b, weight of the pairs that are each other's neighbours with at least tau."""
    ahead = knn.where((F.col("id") < F.col("other")) & (F.col("score") >= tau)).select(F.col("id").alias("face_a"), F.col("other").alias("face_b"), F.col("score").alias("weight"))
    back = knn.where(F.col("id") > F.col("other")).select(F.col("other").alias("face_a"), F.col("id").alias("face_b"))
    return ahead.join(back, ["face_a", "face_b"], "left_semi")


def _union(rows: pd.DataFrame) -> pd.DataFrame:
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in rows[["a", "b"]].itertuples(index=False):
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return pd.DataFrame({"id": list(parent), "component": [root(x) for x in list(parent)]})


def components(nodes: DataFrame, edges: DataFrame, ends: bool = False) -> DataFrame:
    """id, component (its least id) of nodes under edges (a, b), by randomized
    contraction: each round every node goes over to the node of least random
    priority around it, so the rounds are logarithmic in the longest path.

    Ends of edges that are no nodes join what they link, and with `ends` they
    have rows too. A null id is no node."""
    nodes = nodes.select("id").where("id is not null").distinct()
    links = settled(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    if links.count() <= SMALL_EDGES:
        found = links.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_union, "id long, component long")
        return nodes.join(found, "id", "full" if ends else "left").select("id", F.coalesce("component", "id").alias("component"))
    at = nodes.union(links.select("a")).union(links.select("b")).distinct().withColumn("at", F.col("id"))
    turn = 0
    while not links.isEmpty():
        key = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("r"), c.alias("id"))  # noqa: B023, E731
        both = links.union(links.select("b", "a"))
        move = both.groupBy("a").agg(F.min(key(F.col("b"))).alias("best")).select(F.col("a").alias("old"), F.least(key(F.col("a")), F.col("best"))["id"].alias("new"))
        move = settled(move)
        at = at.join(move, at["at"] == move["old"], "left").select("id", F.coalesce("new", "at").alias("at"))
        links = links.join(move, links["a"] == move["old"]).select(F.col("new").alias("a"), "b")
        links = links.join(move, links["b"] == move["old"]).select(F.least("a", "new").alias("a"), F.greatest("a", "new").alias("b"))
        links, turn = settled(links.where("a <> b").distinct()), turn + 1
    at = settled(at)
    least = at.groupBy("at").agg(F.min("id").alias("component"))
    found = at.join(least, "at").select("id", "component")
    return found if ends else found.join(nodes, "id", "left_semi")


def _kruskal(rows: pd.DataFrame) -> pd.DataFrame:
    """Clusters of one component: edges from the strongest, skipping those that
    would join faces that may not be; must-links last, whatever forbids them."""
    parent: dict[int, int] = {}
    members: dict[int, set] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    apart: dict[int, set] = {}
    for a, b in rows.loc[rows["kind"] == "cannot_link", ["a", "b"]].itertuples(index=False):
        apart.setdefault(a, set()).add(b)
        apart.setdefault(b, set()).add(a)
    edges = rows[rows["kind"] == "edge"].sort_values(["weight", "a", "b"], ascending=[False, True, True])
    must = rows[rows["kind"] == "must_link"].sort_values(["a", "b"])
    contradicted = 0
    for table, forced in ((edges, False), (must, True)):
        for a, b in table[["a", "b"]].itertuples(index=False):
            x, y = root(a), root(b)
            if x == y:
                continue
            left, right = members.get(x, {x}), members.get(y, {y})
            small, large = sorted((left, right), key=len)
            barred = any(n in large for m in small for n in apart.get(m, ()))
            if barred and not forced:
                continue
            contradicted += barred
            parent[max(x, y)] = min(x, y)
            large |= small
            members[min(x, y)] = large
    ids = sorted(set(rows["a"]) | set(rows.loc[rows["kind"] != "node", "b"]))
    low: dict[int, int] = {}
    for i in ids:
        low.setdefault(root(i), i)
    return pd.DataFrame({"id": ids, "cluster": [low[root(i)] for i in ids], "contradicted": contradicted > 0})


def constrained_components(nodes: DataFrame, edges: DataFrame, constraints: DataFrame) -> DataFrame:
    """id, cluster, contradicted. Decisions in one component of edges and
    must-links depend on no other, so components are found first, and only those
    with a cannot-link inside are worked through edge by edge, one a task. Ends
    of edges that are no nodes have no rows."""
    e = edges.select(F.lit("edge").alias("kind"), F.col("face_a").alias("a"), F.col("face_b").alias("b"), F.col("weight").cast("double"))
    c = constraints.select("kind", F.col("face_a").alias("a"), F.col("face_b").alias("b"), F.lit(0.0).alias("weight"))
    whole = components(nodes, e.unionByName(c.where("kind = 'must_link'")).select("a", "b"), ends=True)
    inside = c.where("kind = 'cannot_link'").join(whole.select(F.col("id").alias("a"), "component"), "a").join(whole.select(F.col("id").alias("b"), F.col("component").alias("other")), "b").where(F.col("component") == F.col("other"))
    hard = inside.select("component").distinct()
    easy = whole.join(hard, "component", "left_anti").select("id", F.col("component").alias("cluster"), F.lit(False).alias("contradicted"))
    work = e.unionByName(c).join(whole.select(F.col("id").alias("a"), "component"), "a").join(hard, "component", "left_semi")
    work = work.join(whole.select(F.col("id").alias("b"), F.col("component").alias("other")), "b").where(F.col("component") == F.col("other")).select("component", "kind", "a", "b", "weight")
    alone = whole.join(hard, "component", "left_semi").select("component", F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("weight"))
    solved = work.unionByName(alone).groupBy("component").applyInPandas(lambda rows: _kruskal(rows), "id long, cluster long, contradicted boolean")
    return easy.unionByName(solved).join(nodes.select("id"), "id", "left_semi")


def label_actions(clusters: DataFrame, faces: DataFrame, subjects: DataFrame) -> DataFrame:
    """cluster, size, unlabeled, subjects, subject_id, action: what a cluster asks for."""
    rows = clusters.join(faces.select("id", "subject_id"), "id", "left").join(subjects.select(F.col("id").alias("subject_id"), F.col("name").isNotNull().alias("named")), "subject_id", "left")
    met = rows.groupBy("cluster").agg(
        F.count("*").alias("size"),
        F.count(F.when(F.col("subject_id").isNull(), 1)).alias("unlabeled"),
        F.countDistinct("subject_id").alias("subjects"),
        F.min("subject_id").alias("subject_id"),
        F.coalesce(F.max("named"), F.lit(False)).alias("named"),
    )
    action = (
        F.when((F.col("subjects") == 0) & (F.col("size") >= 2), F.lit("new_subject"))
        .when(F.col("subjects") == 0, F.lit("noise"))
        .when(F.col("subjects") == 1, F.when(F.col("unlabeled") > 0, F.lit("assign_all")).otherwise(F.lit("none")))
        .otherwise(F.when(F.col("named"), F.lit("suggest_merge")).otherwise(F.lit("none")))
    )
    return met.select("cluster", "size", "unlabeled", "subjects", F.when(F.col("subjects") == 1, F.col("subject_id")).alias("subject_id"), action.alias("action"))


def merge_suggestions(edges: DataFrame, faces: DataFrame, subjects: DataFrame, constraints: DataFrame, dismissed: DataFrame) -> DataFrame:
    """subject_id_a < subject_id_b, score: pairs of subjects, one of them named,
    with an edge that nothing forbids, and their strongest edge."""
    allowed = without_pairs(edges, constraints.where("kind = 'cannot_link'"), "face_a", "face_b", "face_a", "face_b")
    own = lambda side: faces.where("subject_id is not null").select(F.col("id").alias(f"face_{side}"), F.col("subject_id").alias(f"subject_{side}"))
    rows = allowed.join(own("a"), "face_a").join(own("b"), "face_b").where("subject_a <> subject_b")
    pairs = rows.groupBy(F.least("subject_a", "subject_b").alias("subject_id_a"), F.greatest("subject_a", "subject_b").alias("subject_id_b")).agg(F.max("weight").alias("score"))
    named = lambda side: subjects.select(F.col("id").alias(f"subject_id_{side}"), F.col("name").isNotNull().alias(f"named_{side}"))
    pairs = pairs.join(named("a"), "subject_id_a").join(named("b"), "subject_id_b").where("named_a or named_b").drop("named_a", "named_b")
    pairs = without_pairs(pairs, dismissed_subjects(constraints, faces), "subject_id_a", "subject_id_b", "lo", "hi")
    return without_pairs(pairs, dismissed, "subject_id_a", "subject_id_b", "subject_id_a", "subject_id_b")


def upserted_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges in order of their faces, new weights in place of old ones; of several
    new weights of a pair the largest."""
    lo, hi = F.least("face_a", "face_b"), F.greatest("face_a", "face_b")
    fresh = new.select(lo.alias("face_a"), hi.alias("face_b"), F.col("weight").cast("double")).where("face_a <> face_b").groupBy("face_a", "face_b").agg(F.max("weight").alias("weight"))
    return edges.select("face_a", "face_b", F.col("weight").cast("double")).join(fresh, ["face_a", "face_b"], "left_anti").unionByName(fresh)


def incremental_edges(edges: DataFrame, vectors: DataFrame, new_ids: DataFrame, k: int = K, tau: float = TAU) -> DataFrame:
    """edges with those of new faces and of their k + 1 nearest; none is deleted."""
    new = vectors.join(new_ids.select("id"), "id", "left_semi")
    near = all_pairs_top(new.withColumn("k", F.lit(k + 1)), vectors)
    affected = settled(new.select("id").union(near.select("other")).distinct())
    # Both ends' lists are needed to tell a mutual pair.
    around = subject_knn(vectors, k, affected)
    return upserted_edges(edges, mutual_edges(around, tau))


def reconciled(detections: DataFrame, faces: DataFrame, least: float = 0.5) -> DataFrame:
    """image_id, det_idx, face_id, action: detections take the face of the
    largest overlap of at least `least`, largest first, ties by detection, then
    face; the rest are inserted, faces without a detection deleted.

    Best matches that are mutual are taken in rounds, all images at once; that
    is the greedy order's result, since ties are broken in a total order."""
    from ..functions.numeric import iou

    pair = detections.select("image_id", "det_idx", *(F.col(f"bbox_{c}").alias(f"d{c}") for c in "xywh")).join(faces.select("image_id", F.col("id").alias("face_id"), *(F.col(f"bbox_{c}").alias(f"f{c}") for c in "xywh")), "image_id")
    overlap = iou(tuple(F.col(f"d{c}") for c in "xywh"), tuple(F.col(f"f{c}") for c in "xywh"))
    open_ = settled(pair.select("image_id", "det_idx", "face_id", overlap.alias("iou")).where(F.col("iou") >= least))
    done = None
    while not open_.isEmpty():
        order = [F.col("iou").desc(), F.col("det_idx"), F.col("face_id")]
        d, f = Window.partitionBy("image_id", "det_idx").orderBy(*order), Window.partitionBy("image_id", "face_id").orderBy(*order)
        best = settled(open_.withColumn("d", F.row_number().over(d)).withColumn("f", F.row_number().over(f)).where("d = 1 and f = 1").select("image_id", "det_idx", "face_id"))
        done = best if done is None else done.unionByName(best)
        open_ = settled(open_.join(best.select("image_id", "det_idx"), ["image_id", "det_idx"], "left_anti").join(best.select("image_id", "face_id"), ["image_id", "face_id"], "left_anti").select("image_id", "det_idx", "face_id", "iou"))
    if done is None:
        done = open_.select("image_id", "det_idx", "face_id")
    fresh = detections.join(done, ["image_id", "det_idx"], "left_anti").select("image_id", "det_idx", F.lit(None).cast("long").alias("face_id"), F.lit("insert").alias("action"))
    touched = faces.join(detections.select("image_id").distinct(), "image_id", "left_semi")
    gone = touched.join(done.select(F.col("face_id").alias("id")), "id", "left_anti").select("image_id", F.lit(None).cast("int").alias("det_idx"), F.col("id").alias("face_id"), F.lit("delete").alias("action"))
    return done.withColumn("action", F.lit("update")).unionByName(fresh).unionByName(gone)
