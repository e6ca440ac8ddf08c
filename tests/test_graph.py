"""The face graph: components, constraints, labels, reconciliation."""

import random

import pytest
from pyspark.sql import functions as F

from shutterlake.operators import graph as G

EDGE = "face_a long, face_b long, weight double"
CON = "face_a long, face_b long, kind string, source string"


def clusters(spark, ids, edges, constraints):
    got = G.constrained_components(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, EDGE), spark.createDataFrame(constraints, CON))
    out = {}
    for r in got.collect():
        out.setdefault(r["cluster"], set()).add(r["id"])
    return sorted(map(sorted, out.values()))


def greedy(ids, edges, constraints):
    """Sets joined from the strongest edge on unless a barred pair would meet; must-links come last and always hold."""
    barred = {frozenset(c[:2]) for c in constraints if c[2] == "cannot_link"}
    held = [{i} for i in ids]
    steps = [(a, b, False) for a, b, w in sorted(edges, key=lambda e: (-e[2], e[:2]))] + [(*c[:2], True) for c in constraints if c[2] == "must_link"]
    for a, b, forced in steps:
        x, y = (next(s for s in held if i in s) for i in (a, b))
        if x is not y and (forced or not any(frozenset((i, j)) in barred for i in x for j in y)):
            held.remove(y)
            x |= y
    return sorted(map(sorted, held))


@pytest.mark.parametrize("seed", range(4))
def test_constraints(spark, seed):
    random.seed(seed)
    ids = list(range(10, 34))
    pairs = random.sample([(a, b) for a in ids for b in ids if a < b], 40)
    edges = [(a, b, k / 64) for k, (a, b) in enumerate(pairs[:28], 20)]
    constraints = [(a, b, "cannot_link", "removal") for a, b in pairs[28:36]] + [(a, b, "must_link", "merge") for a, b in pairs[36:38]]
    assert clusters(spark, ids, edges, constraints) == greedy(ids, edges, constraints)


def test_a_must_link_joins_a_barred_pair(spark):
    assert clusters(spark, [70, 71, 72], [], [(70, 72, "cannot_link", "removal"), (70, 72, "must_link", "merge")]) == [[70, 72], [71]]


def test_mutual(spark):
    random.seed(11)
    knn = {a: random.sample([(b, random.randrange(30, 90) / 100) for b in range(20) if b != a], 6) for a in range(20)}
    weight = {(a, b): s for a, x in knn.items() for b, s in x}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in weight.items()], "id long, other long, score double")
    got = {(r["face_a"], r["face_b"]): r["weight"] for r in G.mutual_edges(df, 0.6).collect()}
    assert got and got == {(a, b): s for (a, b), s in weight.items() if a < b and s >= 0.6 and (b, a) in weight}


@pytest.mark.parametrize("small", [0, 10**6])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(G, "SMALL_EDGES", small)
    random.seed(3)
    edges = [(k, k + 1) for k in range(0, 30)] + [(random.randrange(40, 80), random.randrange(40, 80)) for _ in range(25)]
    parent = {i: i for i in range(90)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = G.components(spark.range(90), spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["component"] for r in got.collect()} == {i: root(i) for i in range(90)}


@pytest.mark.parametrize("small", [0, 10**6])
def test_components_of_nodes_alone(spark, monkeypatch, small):
    """An end of an edge that is no node links others and has no row; nor has a null id."""
    monkeypatch.setattr(G, "SMALL_EDGES", small)
    nodes = spark.createDataFrame([(1,), (2,), (5,), (8,), (8,), (None,)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 3), (8, 9)], "a long, b long")
    assert sorted(map(tuple, G.components(nodes, edges).collect())) == [(1, 1), (2, 1), (5, 1), (8, 8)]


def test_clusters_of_nodes_alone(spark):
    assert clusters(spark, [1, 2], [(1, 2, 0.9), (2, 3, 0.8)], []) == [[1, 2]]
    assert clusters(spark, [1, 2], [(1, 2, 0.9), (2, 3, 0.8)], [(1, 3, "cannot_link", "removal")]) == [[1, 2]]


def test_label_actions(spark):
    c = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (7, 7), (8, 7), (9, 7)], "id long, cluster long")
    faces = spark.createDataFrame([(1, 10), (2, None), (3, None), (4, None), (5, None), (6, None), (7, 10), (8, 20), (9, None)], "id long, subject_id long")
    subjects = spark.createDataFrame([(10, "A"), (20, "B")], "id long, name string")
    got = {r["cluster"]: (r["action"], r["subject_id"]) for r in G.label_actions(c, faces, subjects).collect()}
    assert got == {1: ("assign_all", 10), 4: ("noise", None), 5: ("new_subject", None), 7: ("suggest_merge", None)}
    unnamed = subjects.withColumn("name", F.lit(None).cast("string"))
    assert G.label_actions(c, faces, unnamed).where("cluster = 7").first()["action"] == "none"


def _suggest(spark, constraints):
    faces = spark.createDataFrame([(1, 10), (2, 20)], "id long, subject_id long")
    subjects = spark.createDataFrame([(10, "Alice"), (20, "Bob")], "id long, name string")
    none = spark.createDataFrame([], "subject_id_a long, subject_id_b long")
    return G.merge_suggestions(spark.createDataFrame([(1, 2, 0.99)], EDGE), faces, subjects, spark.createDataFrame(constraints, CON), none).count()


def test_suggestions(spark):
    assert _suggest(spark, []) == 1
    assert _suggest(spark, [(2, 1, "cannot_link", "removal")]) == 0


def test_crowded_neighbours(spark):
    """Six alike faces of one subject do not hide the one of another."""
    v = [(k, [1.0, 0.01 * k, 0.0], 1) for k in range(6)] + [(9, [0.99, 0.14, 0.0], 2), (10, [0.0, 0.0, 1.0], None)]
    df = spark.createDataFrame(v, "id long, embedding array<float>, subject_id long")
    assert {r["other"] for r in G.subject_knn(df).where("id = 0").collect()} == {9, 10}


def test_incremental_meets_sweep(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0], None), (2, [0.99, 0.14, 0.0], None), (3, [0.0, 1.0, 0.0], None), (4, [0.14, 0.99, 0.0], None)], "id long, embedding array<float>, subject_id long")
    edges = spark.createDataFrame([], EDGE)
    for batch in ([1, 3], [2, 4]):
        seen = v.where(F.col("id").isin([1, 3] + ([2, 4] if batch == [2, 4] else [])))
        edges = G.incremental_edges(edges, seen, spark.createDataFrame([(i,) for i in batch], "id long"))
    whole = G.mutual_edges(G.subject_knn(v))
    parts = [sorted({(r["id"], r["component"]) for r in G.components(v.select("id"), e.select(F.col("face_a").alias("a"), F.col("face_b").alias("b"))).collect()}) for e in (edges, whole)]
    assert parts[0] == parts[1] and len({c for _, c in parts[0]}) == 2


BOX = "image_id long, {} , bbox_x double, bbox_y double, bbox_w double, bbox_h double"


def test_reconcile(spark):
    d = spark.createDataFrame([(1, 0, 0.11, 0.11, 0.2, 0.2), (2, 0, 0.0, 0.0, 0.2, 0.2)], BOX.format("det_idx int"))
    f = spark.createDataFrame([(1, 7, 0.10, 0.10, 0.2, 0.2), (2, 8, 0.9, 0.9, 0.05, 0.05)], BOX.format("id long"))
    got = {(r["image_id"], r["det_idx"], r["face_id"], r["action"]) for r in G.reconciled(d, f).collect()}
    assert got == {(1, 0, 7, "update"), (2, 0, None, "insert"), (2, None, 8, "delete")}


def test_reconcile_is_greedy(spark):
    random.seed(5)
    det = [(i, k, *(round(random.choice([0.0, 0.05, 0.1]), 2) for _ in range(2)), 0.3, 0.3) for i in range(12) for k in range(4)]
    old = [(i, i * 10 + k, *(round(random.choice([0.0, 0.05, 0.1]), 2) for _ in range(2)), 0.3, 0.3) for i in range(12) for k in range(4)]

    def iou(a, b):
        w = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
        h = min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
        return w * h / (a[4] * a[5] + b[4] * b[5] - w * h) if w > 0 and h > 0 else 0.0

    want = set()
    pairs = sorted(((-iou(a, b), a[1], b[1], a[0]) for a in det for b in old if a[0] == b[0] and iou(a, b) >= 0.5))
    used: set = set()
    for _, d, f, i in pairs:
        if (i, "d", d) not in used and (i, "f", f) not in used:
            used |= {(i, "d", d), (i, "f", f)}
            want.add((i, d, f))
    got = G.reconciled(spark.createDataFrame(det, BOX.format("det_idx int")), spark.createDataFrame(old, BOX.format("id long")))
    assert {(r["image_id"], r["det_idx"], r["face_id"]) for r in got.where("action = 'update'").collect()} == want
