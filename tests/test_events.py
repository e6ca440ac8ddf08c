"""Events, rates, snapshots, files."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.operators.store import Snapshots
from shutterlake.sources import files
from shutterlake.streaming import events as T


def test_folding_matches_a_walk(spark):
    runs = [list(k) for n in range(1, 5) for k in itertools.product(("Create", "Modify", "Remove"), repeat=n)]
    df = spark.createDataFrame([(k,) for k in runs], "kinds array<string>").select("kinds", T.folded(F.col("kinds")).alias("left"))
    assert all(r["left"] == T.fold(r["kinds"]) for r in df.collect())


def test_bursts(spark):
    data = [("a", "Create", 0), ("a", "Remove", 1), ("a", "Modify", 9), ("b", "Remove", 0), ("b", "Create", 2)]
    df = spark.createDataFrame([(i, p, k, t) for i, (p, k, t) in enumerate(data)], "event_id long, path string, kind string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = sorted((r["path"], r["n"], r["kind"]) for r in T.bursts(df, 5).collect())
    assert got == [("a", 1, "Modify"), ("a", 2, ""), ("b", 2, "Modify")]


def test_stream_coalesces(spark, tmp_path):
    data = [("a", "Create", 0), ("a", "Modify", 1), ("b", "Create", 0), ("b", "Remove", 1), ("c", "Modify", 3)]
    df = spark.createDataFrame(data, "path string, kind string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = T.coalesced_stream(T.event_stream(spark, str(tmp_path / "in"), df.schema), quiet_ms=100)
    q = stream.writeStream.format("memory").queryName("coalesced").outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            if spark.sql("select * from coalesced").count() >= 2:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert sorted(tuple(r) for r in spark.sql("select path, kind from coalesced").collect()) == [("a", "Create"), ("c", "Modify")]


def test_stream_sessions_and_batches(spark, tmp_path):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 60), ("z", 10_000)], "path string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = T.session_stream(T.event_stream(spark, str(tmp_path / "in"), df.schema), "10 seconds")
    T.run_batches(stream, lambda batch, _: seen.extend((r["path"], r["n"]) for r in batch.collect()), str(tmp_path / "ck"))
    assert sorted(seen) == [("a", 1), ("a", 2)]


def test_rates(spark):
    df = spark.createDataFrame([(t, 12) for t in range(4, 10)], "t long, n long")
    assert abs(T.rates(df, 15).orderBy(F.desc("t")).first()["rate"] - 72 / 5) < 1e-9
    df = spark.createDataFrame([(0, 1000), (10, 12), (11, 12)], "t long, n long")
    assert T.rates(df, 5).orderBy(F.desc("t")).first()["rate"] == 24
    assert T.rates(df, 5).orderBy("t").first()["rate"] == 0
    d = spark.createDataFrame([(1, 100), (2, 95), (3, 99)], "t long, done long")
    assert [r["n"] for r in T.done_deltas(d).orderBy("t").collect()] == [0, 0, 4]


def test_snapshots(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/store")
    store.commit({"a": spark.range(3), "b": spark.range(2)})
    before = store.read("a")
    store.commit({"a": store.read("a").where("id > 0")})
    assert store.read("a").count() == 2 and store.read("b").count() == 2 and before.count() == 3


def test_vector_file(tmp_path):
    path = str(tmp_path / "v")
    files.write_vector_file(path, np.array([1, -1, 3]), np.array([[1, 0], [0, 0], [0.5, 0.25]], np.float32))
    ids, v = files.read_vector_file(path)
    assert ids.tolist() == [1, 3] and v.tolist() == [[1, 0], [0.5, 0.25]]
    (tmp_path / "bad").write_bytes(b"x" * 40)
    with pytest.raises(ValueError, match="not a vector file"):
        files.read_vector_file(str(tmp_path / "bad"))


def test_scan_and_decode(spark, tmp_path):
    (tmp_path / "r/s").mkdir(parents=True)
    for n in ("a.jpg", "s/b.PNG", "c.txt", "d.jpeg"):
        (tmp_path / "r" / n).write_bytes(b"bad" if n == "d.jpeg" else b"x" * 4)
    assert files.scan_images(spark, [str(tmp_path / "r")]).count() == 3

    def decode(content):
        if content == b"bad":
            raise ValueError("broken")
        return np.zeros((4096, 2048, 3))

    got = {r["path"].rsplit("/", 1)[1]: (r["width"], r["height"], r["error"]) for r in files.decoded(spark, [str(tmp_path / "r")], decode).collect()}
    assert got == {"a.jpg": (1024, 2048, None), "b.PNG": (1024, 2048, None), "d.jpeg": (None, None, "broken")}


def test_inference_hook(spark):
    df = spark.createDataFrame([(1, "red barn"), (2, "red barn"), (3, "")], "id long, text string")
    got = {r["id"]: r["result"] for r in files.inferred(df, "text", files.hashing_embedder(8)).collect()}
    assert got[1] == got[2] and sum(x * x for x in got[1]) > 0.99 and sum(got[3]) == 0
