"""Snapshots: tables as versioned Parquet directories with a pointer."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's
    spark.checkpoint.dir. Only in local mode, where it is unset (as in tests), a
    folder of this machine is chosen and recorded in the session; on a cluster
    executors would each write to a disk of their own, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='shutterlake-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Snapshots:
    """Named tables under a root. A commit writes new directories and then moves
    the pointer file over the old one; readers see all of a commit or nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    @property
    def _pointer(self) -> str:
        return f"{self.root}/CURRENT"

    def current(self) -> dict[str, str]:
        """Directory of each table."""
        if not self._fs.exists(self._path(self._pointer)):
            return {}
        rows = self.spark.read.text(self._pointer).collect()  # a line a table
        return dict(r["value"].split("\t") for r in rows if r["value"])

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.current()[name])

    def commit(self, tables: dict[str, DataFrame]) -> None:
        held = self.current()
        for name, df in tables.items():
            path = f"{self.root}/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            held[name] = path
        draft = self._path(f"{self._pointer}.{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write("".join(f"{n}\t{p}\n" for n, p in sorted(held.items())).encode())
        out.close()
        target = self._path(self._pointer)
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(draft, target, options)
