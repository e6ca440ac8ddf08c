"""Queries take in all rows of their tables, checked on more rows than sf0.01 has."""

import pytest

from shutterlake.fixtures import Catalog
from shutterlake.plans import registry


@pytest.fixture(scope="module")
def many_vectors(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("vectors"))
    rows = [(k, [1.0, float(k)], k // 4 % 10) for k in range(700)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


def chains(n):
    """The least id that edges k to k + 1, without k % 4 = 3, reach from each of n ids."""
    return {k: k - k % 4 for k in range(n)}


def test_components_over_all_ids(spark, many_vectors):
    found = registry.queries()
    got = {r["id"]: r["component"] for r in found["g4_components"](spark, many_vectors).collect()}
    assert got == chains(700)
    assert {r["component"]: r["size"] for r in found["a11_component_sizes"](spark, many_vectors).collect()} == {k: 4 for k in range(0, 700, 4)}
    assert {r["cluster"]: r["size"] for r in found["g5_label_actions"](spark, many_vectors).collect()} == {k: 4 for k in range(0, 700, 4)}


def test_relabelled_over_all_ids(spark, many_vectors):
    """Unlabelled faces take the one subject of their cluster, high ids like low ones."""
    got = {r["id"]: r["subject_id"] for r in registry.queries()["g6_relabel"](spark, many_vectors).collect()}
    assert got == {k: k // 4 % 10 for k in range(700)}


def test_reconciled_over_all_images(spark):
    """Each image that has detections is in the result, whatever its id."""
    at = "/root/testdata/sf0.001"
    faces = [(r["image_id"], r["id"]) for r in Catalog(spark, at).faces.select("image_id", "id").collect()]
    got = registry.queries()["g7_reconcile"](spark, at).collect()
    assert {r["image_id"] for r in got} == {image for image, k in faces if k % 4 != 1}
    touched = {r["face_id"] for r in got if r["face_id"] is not None}
    assert touched == {k for image, k in faces if image in {r["image_id"] for r in got}}


def test_labels_without_a_last_neighbour(spark, tmp_path):
    """The edge from the last id to one that is not there adds no face to a cluster."""
    rows = [(k, [1.0, float(k)], 7) for k in range(6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["cluster"]: (r["size"], r["unlabeled"]) for r in registry.queries()["g5_label_actions"](spark, str(tmp_path)).collect()}
    assert got == {0: (4, 2), 4: (2, 0)}
