"""The catalog's logical schema: one StructType a table, and versioned migrations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "vector": T.ArrayType(T.FloatType())}


def _schema(spec: str) -> T.StructType:
    """Fields as "name kind", nullable if the name ends in "?"."""
    fields = [f.split() for f in spec.split(",")]
    return T.StructType([T.StructField(n.rstrip("?"), _KINDS[k], n.endswith("?")) for n, k in fields])


#: The tables and columns of the data model.
TABLES: dict[str, T.StructType] = {
    name: _schema(spec)
    for name, spec in {
        "schema_version": "version long",
        "settings": "key string, value string",
        "folders": "id long, path string, added_at long",
        "images": "id long, folder_id long, path string, file_hash string, hash_status string, file_size long, date_taken? long, mtime long, thumbnail_path? string, preview_path? string, semantic_analysis_done boolean, subject_analysis_done boolean, embedding? vector, added_at long, updated_at long, deleted_at? long",
        "embedding_queue": "id long, image_id long, pipeline string, attempts int, last_error? string, scheduled_at long",
        "subjects": "id long, name? string, thumbnail_face_id? long, type string, added_at long",
        "faces": "id long, image_id long, subject_id? long, bbox_x double, bbox_y double, bbox_w double, bbox_h double, added_at long, det_score? double, quality_score? double, embedder_id string",
        "face_vectors": "face_id long, embedding vector",
        "tags": "id long, name string, name_normalized string, added_at long",
        "subject_tags": "subject_id long, tag_id long, added_at long",
        "embedding_cache": "id long, cache_key string, query_type string, embedding vector, created_at long",
        "merge_suggestions": "id long, subject_id_a long, subject_id_b long, score double, created_at long",
        "dismissed_pairs": "id long, subject_id_a long, subject_id_b long, dismissed_at long",
        "constraints": "face_a long, face_b long, kind string, source string, created_at long",
        "face_edges": "face_a long, face_b long, weight float",
        "saved_reports": "id long, name string, folder_id long, added_at long",
        "saved_report_tags": "report_id long, tag_id long",
    }.items()
}

#: Columns that name a row.
KEYS: dict[str, tuple[str, ...]] = {
    "settings": ("key",),
    "subject_tags": ("subject_id", "tag_id"),
    "constraints": ("face_a", "face_b", "kind"),
    "face_edges": ("face_a", "face_b"),
    "face_vectors": ("face_id",),
    "saved_report_tags": ("report_id", "tag_id"),
}


def key_of(table: str) -> tuple[str, ...]:
    return KEYS.get(table, ("id",))


def validate(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the table's columns in order, cast; raises if one is missing."""
    missing = [f.name for f in TABLES[table].fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{table}: no column {', '.join(missing)}")
    return df.select(*(F.col(f.name).cast(f.dataType) for f in TABLES[table].fields))


def empty(spark, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def add_column(name: str, default) -> Callable[[DataFrame], DataFrame]:
    """A migration that adds a column, and leaves one that is there as it is."""
    return lambda df: df if name in df.columns else df.withColumn(name, F.lit(default))


def migrate(df: DataFrame, version: int, steps: list[tuple[int, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, int]:
    """Applies the steps after a version in order; the result and its version."""
    for number, step in sorted(steps, key=lambda s: s[0]):
        if number > version:
            df, version = step(df), number
    return df, version
