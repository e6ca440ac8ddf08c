"""Jobs that SQL does not tell all of: cancelling, the hashing gate, relabelling."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from shutterlake.operators import jobs as J


def test_a_tagged_job_can_be_cancelled(spark):
    slow = F.udf(lambda x: time.sleep(0.2) or x, "long")
    with J.cancellable(spark, "sweep") as cancel:
        threading.Timer(3.0, cancel).start()
        with pytest.raises(Exception, match="(?i)cancel"):
            spark.range(0, 4000, 1, 4).select(slow("id")).collect()
    assert spark.range(3).count() == 3


def test_hashing_pauses_while_many_images_wait(spark):
    queue = spark.range(60).select(F.shiftright("id", 1).alias("image_id"))
    assert J.may_hash(queue, 30) and not J.may_hash(queue, 29)


def test_relabelling(spark):
    faces = spark.createDataFrame([(k, s, k, 0.1 * k, 0.2, 0.2) for k, s in ((1, 50), (2, None), (3, None), (4, None), (5, 51), (6, None))], "id long, subject_id long, image_id long, quality_score double, bbox_w double, bbox_h double")
    subjects = spark.createDataFrame([(50, "Wim", None, "person", 0), (51, None, None, "person", 0), (52, "Noor", None, "person", 0)], "id long, name string, thumbnail_face_id long, type string, added_at long")
    edges = spark.createDataFrame([(1, 2, 0.9), (3, 4, 0.8), (1, 5, 0.7), (4, 6, 0.6)], "face_a long, face_b long, weight double")
    barred = spark.createDataFrame([(1, 5, "cannot_link", "removal", 0), (4, 6, "cannot_link", "removal", 0)], "face_a long, face_b long, kind string, source string, created_at long")
    none = spark.createDataFrame([], "subject_id_a long, subject_id_b long")
    t = J.relabelled(faces, subjects, edges, barred, none, 9)
    assert {r["id"]: r["subject_id"] for r in t["faces"].collect()} == {1: 50, 2: 50, 3: 53, 4: 53, 5: 51, 6: None}
    assert {r["id"]: r["thumbnail_face_id"] for r in t["subjects"].collect()} == {50: 2, 51: 5, 53: 4}
    assert t["suggestions"].count() == 0 and tuple(t["counts"].first()) == (1, 1)


def test_progress_ends_with_the_last_file(spark):
    got = [tuple(r) for r in J.progress(205, J.RESCAN_STEP, spark).collect()]
    assert got == [("sync_progress", '{"done":100,"total":205}'), ("sync_progress", '{"done":200,"total":205}'), ("sync_progress", '{"done":205,"total":205}'), ("sync_complete", "{}")]
    assert J.progress(0, 10, spark).count() == 1
