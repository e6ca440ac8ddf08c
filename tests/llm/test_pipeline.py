"""The corpus pipeline as a whole, and its stages on odd rows."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from shutterlake.llm import langid, packing  # noqa: E402
from shutterlake.llm.common import table  # noqa: E402

from . import reference as plain  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_run_is_its_stages_by_plain_code(spark):
    docs = table(spark, SMALL, "documents")
    told = {r["doc_id"]: r["text"] for r in langid.keep_identified(docs).collect()}
    assert 0.8 * docs.count() <= len(told)
    kept = {i: t for i, t in plain.without_repeated_lines(told).items() if t == told[i] or plain.words(t)}
    first = {i for i, c in plain.components(kept).items() if i == c}
    want = sorted((i, len(packing.text_ids(kept[i], packing.tokenizer_path())) // 4 + 1) for i in first)
    rows = corpus_pipeline.run(spark, SMALL).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sorted((r["doc_id"], r["n"]) for r in rows) == want


def test_stages_take_odd_rows(spark, make_docs):
    prose = [r["text"] for r in table(spark, SMALL, "documents").where("lang = 'en' and length(text) > 300").orderBy("doc_id").limit(3).collect()]
    rows = [(1, prose[0]), (1, prose[1]), (2, prose[0]), (2, prose[0]), (None, prose[2]), (None, None), (3, None), (4, ""), (5, " \n\n "), (6, "\n".join([prose[1]] * 3))]
    docs = make_docs(rows).withColumns({c: F.lit(c) for c in ("row", "doc", "nos", "n", "found")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns[-5:] == ["row", "doc", "nos", "n", "found"]
    texts = [r["text"] for r in docs.collect()]
    assert len(texts) == len(set(texts)) and 1 <= len(texts) <= 3
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).select("doc_id").distinct().count() >= 1


def test_stages_of_nothing(spark, make_docs):
    docs = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
