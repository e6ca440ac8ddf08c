"""What the corpus operators share: tables, the shared folder, native word splitting."""

from __future__ import annotations

import functools
import gc
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import shared_folder

#: The ASCII white space that separates words, U+0020 and U+0009 to U+000D.
WORD_SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/shutterlake-{uuid.uuid4().hex}/{name}"


def settled(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage is
    cut, it is computed once, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a settled table that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows and bytes of a batch that a Python worker gets at once, at most.
BATCH_ROWS, BATCH_BYTES = 500, "16m"


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session that hands rows to Python in small batches: texts may be
    long, and a worker holds a batch several times over. What the session sets
    itself to less stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key, "10000")) > BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of batches for Python workers, that gives free memory of
    Arrow's pool back to the system after each batch: workers wait for other
    tasks with what their pools have kept."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            for batch in run(batches):
                yield batch
                del batch
                pa.default_memory_pool().release_unused()
        finally:
            pa.default_memory_pool().release_unused()

    return wrapped


def released(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of queries that are over now, rather
    than when the driver next collects its garbage."""
    gc.collect()
    for _ in range(2):  # the first frees what Python let go, the second what that held
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case: runs of anything but WORD_SPACE.
    A null text has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), UPPER + WORD_SPACE[1:], UPPER.lower() + " " * 5)
    return F.filter(F.split(flat, " "), lambda w: w != "")


def shingle_hashes(tokens: Column, width: int = 5) -> Column:
    """64-bit hashes of every run of `width` tokens in order, repeats kept; of
    the whole sequence if it is shorter; none without tokens."""
    each = F.transform(tokens, lambda w: F.xxhash64(w))

    def run(h: Column) -> Column:
        last = F.size(h) - width
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(last < 0, F.array(F.aggregate(h, F.lit(42).cast("bigint"), lambda a, x: F.xxhash64(a, x)))).otherwise(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width))))
        )

    # One lambda binds the word hashes, so that they are not computed for each shingle.
    return F.element_at(F.transform(F.array(each), run), 1)
