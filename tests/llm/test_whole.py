"""Corpus operators do the whole job where texts are unusual."""

import pytest
from pyspark.sql import functions as F

from shutterlake.llm import ngram_join, warc
from shutterlake.llm.common import fresh_path

from . import reference as plain
from .test_near import corpus


def test_pages_with_very_long_urls(spark):
    urls = {1: "http://x/" + "a" * 300_000, 2: "http://x/" + " %" * 40_000, 3: "http://x/3"}
    df = spark.createDataFrame([(i, u, f"page {i}") for i, u in urls.items()], "page_id long, url string, html string")
    assert {r["page_id"] for r in warc.op6(spark, df).collect()} == {1, 2, 3}
    assert {r["page_id"]: (r["url"], r["payload"]) for r in warc.round_trip(spark, df).collect()} == {i: (u, f"page {i}".encode()) for i, u in urls.items()}


def test_records_that_are_not_read_are_noticed(spark):
    df = spark.createDataFrame([(i, f"http://x/{i}", f"page {i}") for i in range(4)], "page_id long, url string, html string")
    manifest = warc.write_archives(warc.decided(df), fresh_path(spark, "warc"))
    assert warc.checked(warc.read_archives(manifest), manifest).count() == 4
    with pytest.raises(ValueError, match="4 records read of"):
        warc.checked(warc.read_archives(manifest), manifest.withColumn("records", F.col("records") + 1))


@pytest.mark.parametrize("cell", [256, 3])
def test_every_link_is_counted(make_docs, monkeypatch, cell):
    monkeypatch.setattr(ngram_join, "COUNT_ROWS", cell)
    rows = corpus(3)
    sets = {i: plain.shingles(t) for i, t in rows}
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.op4(make_docs(rows)).collect()}
    assert got == {i: sum(j != i and plain.linked(s, sets[j]) for j in sets) for i, s in sets.items()}


def test_read_tasks_grow_with_the_ranges(spark):
    df = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 50) for i in range(300)], "page_id long, url string, html string")
    manifest = warc.write_archives(warc.decided(df), fresh_path(spark, "warc"))
    size = manifest.agg(F.sum("bytes")).first()[0]
    for ranges in (4, 12):
        read = warc.read_archives(manifest, split_bytes=size // ranges)
        read.write.format("noop").mode("overwrite").save()
        assert read.rdd.getNumPartitions() >= ranges and read.count() == 300


def test_workers_give_free_memory_back(monkeypatch):
    """After each batch, and at the end of a task, also of one that is cut short."""
    import pyarrow as pa

    from shutterlake.llm.common import lean

    class Pool:
        released = 0

        def release_unused(self):
            Pool.released += 1

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    run = lean(lambda batches: (b + 1 for b in batches))
    assert list(run(iter([1, 2]))) == [2, 3] and Pool.released == 3
    cut = run(iter([1, 2]))
    assert next(cut) == 2
    cut.close()
    assert Pool.released == 4


def test_kept_words_are_bounded():
    from shutterlake.llm import packing

    held = packing.WordIds(packing.tokenizer_path())
    for k in range(0, 600_000, 20_000):
        held.learn({f"{i:x}" for i in range(k, k + 20_000)})
    assert len(held) + len(held.older) < 300_000
