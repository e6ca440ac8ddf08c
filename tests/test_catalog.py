"""Cases of the data model: text, joins, aggregates, search, changes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake import schemas
from shutterlake.fixtures import Catalog
from shutterlake.functions import numeric as N
from shutterlake.functions import text, vectors
from shutterlake.operators import layout
from shutterlake.operators import listing as L
from shutterlake.operators import mutations as M
from shutterlake.operators import relations as R
from shutterlake.operators import vector as V
from shutterlake.plans import registry


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_folding_and_patterns(spark):
    cases = {"Peñón_7": "penon_7", "ZOË": "zoe", "\t Ärger ": "arger", "same": "same", "": ""}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "s string, want string")
    assert df.where(text.folded(F.col("s")) != F.col("want")).count() == 0
    assert all(text.fold(k) == v for k, v in cases.items())
    assert text.like_pattern("red door") == "%red%door%"
    assert text.like_pattern("a_b%") == r"%a\_b\%%"
    assert text.like_pattern("   ") is None
    assert one(spark, text.like_pattern_column(F.lit("a_b%"))) == r"%a\_b\%%"


TAGS = "id long, name string, name_normalized string"


def _people(spark):
    subjects = spark.createDataFrame([(11, "Zoë"), (12, "Piet"), (13, None), (14, "Ilse"), (15, "Piet")], "id long, name string")
    tags = spark.createDataFrame([(5, "Peñón_7", "penon_7"), (6, "Red-Door", "red-door")], TAGS)
    links = spark.createDataFrame([(12, 5), (14, 6), (13, 6)], "subject_id long, tag_id long")
    return subjects, links, tags


@pytest.mark.parametrize(("query", "ids"), [("zoe", [11]), ("penon", [12]), ("piet", [12, 15]), ("nobody", []), ("red door", [13, 14]), ("r%d", [])])
def test_subject_search(spark, query, ids):
    found = R.search_subjects(*_people(spark), query)
    assert [r["id"] for r in found.orderBy("source", "id").collect()] == ids


def _images(spark, data):
    return spark.createDataFrame(data, "id long, folder_id long, path string, date_taken long, mtime long, deleted_at long")


def test_images_by_tag(spark):
    images = _images(spark, [(k, 1, f"/{k}", None, 10 * k, 5 if k == 4 else None) for k in (1, 2, 3, 4)])
    faces = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 4, 1), (4, 1, 2), (5, 4, 2)], "id long, image_id long, subject_id long")
    tags = spark.createDataFrame([(1, "red-door", "red-door")], TAGS)
    links = spark.createDataFrame([(1, 1), (2, 1)], "subject_id long, tag_id long")
    got = R.images_by_tag(images, faces, links, tags, "red door").orderBy(F.desc("subjects"))
    assert [r["image_id"] for r in got.collect()] == [1, 2]


def test_coverage(spark):
    subjects = spark.createDataFrame([(1, "Piet"), (2, "Ilse"), (3, "Noor"), (4, "Wim")], "id long, name string")
    links = spark.createDataFrame([(1, 1), (2, 1)], "subject_id long, tag_id long")
    images = _images(spark, [(1, 1, "/1", None, 1, None), (2, 1, "/2", None, 1, None)])
    faces = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 4), (5, 2, 4)], "id long, image_id long, subject_id long")
    got = R.coverage(1, [1], images, faces, subjects, links)
    assert rows(got, "bucket", "name", "frequency") == [("missing", "Ilse", 0), ("others", "Noor", 1), ("others", "Wim", 2), ("present", "Piet", 1)]
    assert tuple(R.coverage_summary(got).first()) == (2, 1, 1, 2)
    assert R.coverage(1, [], images, faces, subjects, links).where("bucket <> 'others'").count() == 0


def test_photos_with_faces(spark):
    images = _images(spark, [(1, 1, "a", 300, 100, None), (2, 1, "b", None, 200, None), (3, 1, "c", None, 999, 9)])
    faces = spark.createDataFrame([(1, 1, 7, 0.1), (2, 1, 7, 0.5), (3, 2, 7, 0.0), (4, 3, 7, 0.0)], "id long, image_id long, subject_id long, bbox_x double").withColumns({f"bbox_{c}": F.lit(0.1) for c in "ywh"})
    assert rows(R.subject_photos_with_faces(images, faces, 7), "path", "face_bbox.x") == [("a", 0.1), ("a", 0.5), ("b", 0.0)]


def test_vector_cases(spark):
    schema = "id long, embedding array<float>"
    two = V.indexed(spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], schema))
    got = V.top_k(two, [1.0, 0.0, 0.0], 2).collect()
    assert [r["id"] for r in got] == [1, 2] and got[0]["score"] > 0.99 and abs(got[1]["score"]) < 0.01
    assert V.top_k(two, [0.0, 0.0, 0.0], 2).count() == 0
    assert V.indexed(spark.createDataFrame([(1, [0.0, 0.0, 0.0])], schema)).count() == 0
    five = V.indexed(spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0]), (3, [0.8, 0.2, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [0.0, 0.0, 1.0])], schema))
    assert {r["id"] for r in V.top_k(five, [1.0, 0.0, 0.0], 3).collect()} == {1, 2, 3}
    assert rows(V.removed(two, spark.createDataFrame([(1,)], "id long")), "id") == [(2,)]
    assert V.upserted(two, two.where("id = 1")).count() == 2


@pytest.mark.parametrize(("scores", "kept"), [([0.90, 0.88, 0.70, 0.69], 2), ([0.90, 0.87, 0.84], 3), ([1.0, 0.60, 0.58], 1), ([0.9, 0.8, 0.7], 1)])
def test_elbow(spark, scores, kept):
    hits = spark.createDataFrame(list(enumerate(scores)), "id long, score double")
    if scores == [0.9, 0.8, 0.7]:  # equal drops up to rounding: exact ones
        hits = spark.createDataFrame([(0, 0.75), (1, 0.5), (2, 0.25)], "id long, score double")
    assert V.elbow(hits).count() == kept


def test_knn(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0]), (3, [0.0, 0.0, 1.0])], "id long, embedding array<float>")
    assert [r["id"] for r in V.knn_of(v, 1, [1.0, 0.0, 0.0], 2).collect()] == [2, 3]
    assert V.knn_of(v, 9, None, 2).count() == 0
    for d, want in ((0.0, 1.0), (2**0.5, 0.0), (2.0, -1.0)):
        assert abs(one(spark, N.l2_to_cosine(F.lit(d))) - want) < 1e-9


def test_boxes(spark):
    def value(a, b):
        return one(spark, N.iou(tuple(map(F.lit, a)), tuple(map(F.lit, b))))

    assert value((0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 1.0, 1.0)) == 1
    assert value((0.0, 0.0, 0.1, 0.1), (0.5, 0.5, 0.1, 0.1)) == 0
    assert abs(value((0.0, 0.0, 1.0, 1.0), (0.5, 0.0, 1.0, 1.0)) - 1 / 3) < 1e-9
    assert value((0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 1.0)) == 0
    assert value((0.0, 0.0, 0.5, 1.0), (0.5, 0.0, 0.5, 1.0)) == 0


def test_frontality(spark):
    marks = lambda *p: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p))
    level = one(spark, N.frontality(marks((0.3, 0.4), (0.7, 0.4), (0.5, 0.5), (0.4, 0.7), (0.6, 0.7))))
    turned = one(spark, N.frontality(marks((0.3, 0.4), (0.7, 0.4), (0.68, 0.5), (0.4, 0.7), (0.6, 0.7))))
    assert level > 0.95 > turned
    assert one(spark, N.frontality(marks((0.3, 0.4)))) == 0.5


def test_retries(spark):
    q = spark.createDataFrame([(1, a, "semantic", a, 0) for a in range(8)], "id long, image_id long, pipeline string, attempts int, scheduled_at long")
    got = {r["image_id"]: (r["attempts"], r["scheduled_at"]) for r in M.failed(q, q, 100).collect()}
    assert got[0] == (1, 105) and 6 not in got and 7 not in got
    assert sum(at - 100 for _, at in got.values()) == 275


def test_eta_labels(spark):
    for s, want in ((30, "~30s left"), (720, "~12 min left"), (0, ""), (3600, "~1h left"), (3780, "~1h 3m left")):
        assert one(spark, N.eta_label(F.lit(s))) == want


def test_hashing(spark):
    i = spark.createDataFrame([(1, "a", "", "PENDING", 1, None), (2, "b", "", "PENDING", 1, None), (3, "c", "", "PENDING", 1, 9)], "id long, path string, file_hash string, hash_status string, mtime long, deleted_at long")
    assert rows(L.pending_hash(i), "id") == [(1,), (2,)]
    done = M.apply_hashes(i, spark.createDataFrame([(1, 1, "deadbeef"), (2, 1, None)], "id long, mtime long, hash string"))
    assert rows(done, "id", "hash_status") == [(1, "DONE"), (2, "FAILED"), (3, "PENDING")]
    late = M.apply_hashes(i, spark.createDataFrame([(1, 7, "deadbeef")], "id long, mtime long, hash string"))
    assert rows(late, "id", "hash_status")[0] == (1, "PENDING")


def _tables(spark, a, b):
    e = lambda n: schemas.empty(spark, n)
    faces = spark.createDataFrame([(1, 1), (2, 2)], "id long, subject_id long").withColumns({"image_id": F.col("id"), "quality_score": F.lit(0.5), "bbox_w": F.lit(0.1), "bbox_h": F.lit(0.1)})
    subjects = schemas.validate(spark.createDataFrame([(1, a, None, "person", 0), (2, b, None, "person", 0)], "id long, name string, thumbnail_face_id long, type string, added_at long"), "subjects")
    pairs = spark.createDataFrame([(1, 1, 2, 0.9)], "id long, subject_id_a long, subject_id_b long, score double")
    return {"subjects": subjects, "faces": faces, "subject_tags": spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3)], "subject_id long, tag_id long"), "constraints": e("constraints"), "merge_suggestions": pairs, "dismissed_pairs": e("dismissed_pairs").drop("id")}


@pytest.mark.parametrize(("target", "source", "name"), [("Noor", None, "Noor"), (None, "Wim", "Wim"), ("Piet", "Ilse", "Piet"), (None, None, None)])
def test_merge(spark, target, source, name):
    t = M.merge_subjects(_tables(spark, target, source), 1, 2, 5)
    assert rows(t["subjects"], "id", "name", "thumbnail_face_id") == [(1, name, 1)]
    assert rows(t["constraints"], "face_a", "face_b", "kind", "source") == [(1, 2, "must_link", "merge")]
    assert rows(t["subject_tags"]) == [(1, 1), (1, 2), (1, 3)]
    assert t["merge_suggestions"].count() == 0


def test_a_folder_takes_every_subject_without_a_face(spark):
    images = _images(spark, [(1, 3, "/1", None, 1, None), (2, 4, "/2", None, 1, None)])
    faces = spark.createDataFrame([(1, 1, 21), (2, 2, 22)], "id long, image_id long, subject_id long")
    subjects = spark.createDataFrame([(21, 1), (22, 1), (23, None)], "id long, thumbnail_face_id long")
    folders = spark.createDataFrame([(3,), (4,)], "id long")
    left = M.delete_folder(3, {"folders": folders, "images": images, "faces": faces, "subjects": subjects})
    assert rows(left["subjects"], "id", "thumbnail_face_id") == [(22, None)]


def test_dismiss(spark):
    t = _tables(spark, "A", "B")
    t["faces"] = spark.createDataFrame([(k, 1) for k in (1, 2, 3, 4)] + [(5, 2), (6, 2)], "id long, subject_id long")
    t["subjects"] = M.set_where(t["subjects"], F.col("id") == 1, thumbnail_face_id=4)
    t = M.dismiss(t, 2, 1, 5)
    assert rows(t["dismissed_pairs"], "subject_id_a", "subject_id_b") == [(1, 2)]
    assert {r["face_a"] for r in t["constraints"].collect()} == {1, 2, 4}
    assert t["constraints"].count() == 6 and t["merge_suggestions"].count() == 0


def test_links(spark):
    pairs = spark.createDataFrame([(5, 3), (3, 5), (4, 4)], "x long, y long")
    c = M.linked(schemas.empty(spark, "constraints"), pairs, "cannot_link", "removal", 1)
    c = M.linked(c, pairs, "must_link", "merge", 1)
    assert rows(c, "face_a", "face_b", "kind") == [(3, 5, "cannot_link"), (3, 5, "must_link")]


def test_ranges_and_order(spark):
    i = _images(spark, [(1, 1, "a", None, 5, None), (2, 1, "b", 10, 1, None), (3, 1, "c", 20, 1, None)])
    assert rows(L.taken_between(i, 10, 20), "id") == [(2,), (3,)]
    assert L.taken_between(i, None, None).count() == 3
    down = [r["id"] for r in L.in_order(i, "dateTaken").collect()]
    assert down == [3, 2, 1] and [r["id"] for r in L.in_order(i, "dateTaken", True).collect()] == down[::-1]
    assert L.available_orders(i) == ["dateTaken"] and L.sort_key("relevance", "dateTaken", ["dateTaken"]) == "dateTaken"


def test_rows_fill_the_width():
    got = layout.rows_of(list(range(50)), 1000, 200)
    assert [i for r, _ in got for i in r] == list(range(50))
    for r, h in got[:-1]:
        assert abs(sum(h * layout.aspect(i) for i in r) + 4 * (len(r) - 1) - 1000) < 1e-6
    assert got[-1][1] == 200


def test_cache_gap(spark):
    c = spark.createDataFrame([("a", 100), ("b", 99), ("c", 101)], "cache_key string, created_at long")
    now = 100 + L.CACHE_SECONDS
    assert rows(L.cache_hits(c, now), "cache_key") == [("c",)]
    assert rows(L.cache_evicted(c, now), "cache_key") == [("a",), ("c",)]


def test_blobs(spark):
    df = spark.createDataFrame([([1.0, -2.5],)], "v array<float>").select(vectors.to_blob(F.col("v")).alias("b"))
    assert df.select(vectors.from_blob(F.col("b"))).first()[0] == [1.0, -2.5]
    assert spark.createDataFrame([(bytearray(b"123"),)], "b binary").select(vectors.from_blob(F.col("b"))).first()[0] is None


@pytest.mark.parametrize("a, b", [(3, 5), (5, 3), (3, 3), (3, 9)])
def test_merge_links(spark, a, b):
    """Each pair once, whatever is held already; pairs held in reverse or of another kind do not count as held."""
    faces = spark.createDataFrame([(1, 3), (4, 3), (6, 3), (2, 5), (7, 5), (8, None), (9, 4)], "id long, subject_id long")
    held = [(1, 2, "must_link"), (7, 4, "must_link"), (6, 7, "cannot_link"), (1, 4, "must_link")]
    held = spark.createDataFrame([(*h, "manual_assign", 1) for h in held], "face_a long, face_b long, kind string, source string, created_at long")
    left, right = (faces.where(F.col("subject_id") == s).select(F.col("id").alias(n)) for s, n in ((a, "x"), (b, "y")))
    want = M.linked(held, left.crossJoin(right), "must_link", "merge", 5)
    assert rows(M.merge_linked(held, faces, a, b, 5)) == rows(want)


def test_face_pairs_over_many_tasks(spark):
    """The pairs of two subjects are made in more tasks than there are shuffle partitions, and stay there."""
    pairs = registry.queries()["j20_face_pairs"](spark, "/root/testdata/sf0.001")
    faces = Catalog(spark, "/root/testdata/sf0.001").faces
    ids = [[r["id"] for r in faces.where(f"subject_id = {s}").select("id").collect()] for s in (3, 5)]
    assert rows(pairs) == sorted((min(x, y), max(x, y)) for x in ids[0] for y in ids[1])
    assert pairs.select(F.spark_partition_id()).distinct().count() > 32


def test_half_precision(spark):
    values = [0.0, -0.0, 1.0, -1.0, 0.1, -0.3333, 2.0**-14, 2.0**-24, 2.0**-25, 3 * 2.0**-25, 1e-9, 65504.0, 65519.0, 65520.0, -1e30, float("inf"), float("nan"), 2049.0, 2051.0]
    values = np.array(values + list(np.random.default_rng(5).normal(0, 0.2, 2000)), np.float32)
    df = spark.createDataFrame([(values.tolist(),)], "v array<float>")
    got = np.array(df.select(vectors.half_precision(F.col("v"))).first()[0], np.float32)
    with np.errstate(over="ignore"):
        np.testing.assert_array_equal(got, values.astype(np.float16).astype(np.float32))


def test_index_file_again(spark):
    """The index is stored each time, not only the first time in a session."""
    for _ in range(3):
        got = {r["id"]: r["x0"] for r in registry.queries()["s8_index_file"](spark, "/root/testdata/sf0.001").collect()}
        held = {r["id"]: r["embedding"] for r in Catalog(spark, "/root/testdata/sf0.001").face_vectors.select("id", "embedding").collect()}
        assert got.keys() == held.keys()
        assert all(abs(got[k] - v[0] / np.linalg.norm(v)) < 0.006 for k, v in held.items())


def test_schemas(spark):
    df, version = schemas.migrate(spark.range(1).toDF("id"), 1, [(2, schemas.add_column("kind", "x")), (1, schemas.add_column("old", 1))])
    assert df.columns == ["id", "kind"] and version == 2
    with pytest.raises(ValueError, match="no column"):
        schemas.validate(df, "folders")
