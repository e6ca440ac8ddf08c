"""File scans, and the vector file format."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_image

#: Fixed values of the vector file: magic bytes, version, greatest dimension.
MAGIC, VERSION, MOST_DIM, DELETED = b"SHTRVEC1", 1, 4096, -1


def scan_images(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, mtime (seconds), size of all image files below the roots. Listing
    is spread over the cluster; contents are not read. Files that cannot be read are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(roots)
    return rows.select("path", F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size")).where(is_image(F.col("path")))


def decoded(spark: SparkSession, roots: list[str], decode: Callable[[bytes], np.ndarray], edge: int = 2048) -> DataFrame:
    """path, width, height, error by a decoder that the caller provides, which
    gets a file's bytes and returns an array of (height, width, ...)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    h, w = decode(bytes(content)).shape[:2]
                    scale = min(1.0, edge / max(h, w))
                    out.append((path, max(1, int(w * scale + 0.5)), max(1, int(h * scale + 0.5)), None))
                except Exception as e:  # noqa: BLE001  a bad file must not end the job
                    out.append((path, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "width", "height", "error"]).astype({"width": "Int64", "height": "Int64"})

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots).where(is_image(F.col("path"))).select("path", "content")
    return rows.mapInPandas(run, "path string, width long, height long, error string")


def inferred(rows: DataFrame, column: str, model: Callable[[list], list], schema: str = "result array<float>") -> DataFrame:
    """id, result, error: a model's answers by batch; a batch that fails is
    tried row by row, so one bad row fails alone."""
    name, kind = schema.split(" ", 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            items = batch[column].tolist()
            try:
                out = [(x, None) for x in model(items)]
            except Exception:  # noqa: BLE001
                out = []
                for item in items:
                    try:
                        out.append((model([item])[0], None))
                    except Exception as e:  # noqa: BLE001
                        out.append((None, str(e)))
            yield pd.DataFrame({"id": batch["id"], name: [x for x, _ in out], "error": [e for _, e in out]})

    return rows.select("id", column).mapInPandas(run, f"id long, {name} {kind}, error string")


def hashing_embedder(dim: int = 64) -> Callable[[list], list]:
    """A stand-in for a text model: words hashed into dim signed counts, unit length."""

    def run(texts: list) -> list:
        import zlib

        out = []
        for t in texts:
            v = np.zeros(dim, np.float32)
            for w in (t or "").lower().split()[:64]:
                h = zlib.crc32(w.encode())
                v[h % dim] += 1 if h & 0x10000 else -1
            n = np.sqrt((v * v).sum())
            out.append(v / n if n else v)
        return out

    return run


def write_vector_file(path: str, ids: np.ndarray, vectors: np.ndarray) -> None:
    """One file of 16-bit vectors, written aside and then moved into place."""
    import os
    import uuid

    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "wb") as f:
        f.write(MAGIC + struct.pack("<BIQ", VERSION, vectors.shape[1], len(ids)))
        body = np.empty(len(ids), np.dtype([("id", "<i8"), ("v", "<f2", (vectors.shape[1],))]))
        body["id"], body["v"] = ids, vectors
        f.write(body.tobytes())
    os.replace(draft, path)


def read_vector_file(path: str) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors; deleted entries are skipped; ValueError for a file that is not one."""
    with open(path, "rb") as f:
        content = f.read()
    head = struct.calcsize("<BIQ")
    if content[: len(MAGIC)] != MAGIC or len(content) < len(MAGIC) + head:
        raise ValueError("not a vector file")
    version, dim, count = struct.unpack_from("<BIQ", content, len(MAGIC))
    kind = np.dtype([("id", "<i8"), ("v", "<f2", (dim,))])
    if version != VERSION or not 0 < dim <= MOST_DIM or len(content) < len(MAGIC) + head + count * kind.itemsize:
        raise ValueError("not a vector file of this version")
    body = np.frombuffer(content, kind, count, len(MAGIC) + head)
    body = body[body["id"] != DELETED]
    return body["id"].astype(np.int64), body["v"].astype(np.float32)


def read_index(spark: SparkSession, path: str, rebuild: Callable[[], DataFrame]) -> DataFrame:
    """id, unit from an index stored as Parquet; rebuilt if it is missing or of another schema."""
    try:
        rows = spark.read.parquet(path)
        if rows.columns != ["id", "unit"]:
            raise ValueError("another schema")
        return rows
    except Exception:  # noqa: BLE001
        return rebuild()
