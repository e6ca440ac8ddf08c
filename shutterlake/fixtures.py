"""Catalog tables derived from the driver's tables, in Spark and as DuckDB SQL.

Nulls, deletions and unused rows, which the driver's tables lack, come from
arithmetic on keys. FIXTURES[name] is the SQL of a table over the driver's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.store import settled

EMBEDDER = "buffalo_s_recognition"
#: Image ids (of 8 bytes) that are broadcast at most.
BROADCAST_IMAGES = 1_000_000


class Catalog:
    """Lazy tables of one directory: `catalog.images` and so on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def folders(self) -> DataFrame:
        n = self.raw("nation")
        return n.select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("/r"), F.col("n_regionkey").cast("string"), F.lit("/"), F.col("n_name")).alias("path"), F.col("n_nationkey").cast("long").alias("added_at"))

    @property
    def images(self) -> DataFrame:
        o = self.raw("orders").join(self.raw("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        k, mtime, status = F.col("o_orderkey"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")), F.col("o_orderstatus")
        return o.select(
            k.alias("id"),
            F.col("c_nationkey").cast("long").alias("folder_id"),
            F.concat(F.lit("/img/"), k.cast("string"), F.lit(".jpg")).alias("path"),
            F.when(status == "O", F.lit("")).otherwise(F.concat(F.lit("h"), k.cast("string"))).alias("file_hash"),
            F.when(status == "O", F.lit("PENDING")).when(status == "F", F.lit("DONE")).otherwise(F.lit("FAILED")).alias("hash_status"),
            F.floor(F.col("o_totalprice")).cast("long").alias("file_size"),
            F.when(k % 3 != 0, mtime - 86400 * (k % 5)).alias("date_taken"),
            mtime.alias("mtime"),
            F.when(k % 4 != 0, F.concat(F.lit("/t/"), k.cast("string"))).alias("thumbnail_path"),
            F.when(k % 4 != 0, F.concat(F.lit("/p/"), k.cast("string"))).alias("preview_path"),
            (status != "O").alias("semantic_analysis_done"),
            (status == "F").alias("subject_analysis_done"),
            mtime.alias("added_at"),
            mtime.alias("updated_at"),
            F.when(k % 17 == 0, mtime).alias("deleted_at"),
        )

    @property
    def faces(self) -> DataFrame:
        return self._faces(self.raw("lineitem"))

    def faces_beside(self, *subjects: int) -> DataFrame:
        """All faces of the images that show one of the subjects. Faces are numbered
        within their image, so these have the ids that they have in faces."""
        li = self.raw("lineitem")
        shown = settled(li.where(F.col("l_suppkey").isin(*subjects)).select("l_orderkey").distinct())
        return self._faces(li.join(F.broadcast(shown) if shown.count() <= BROADCAST_IMAGES else shown, "l_orderkey", "left_semi"))

    def _faces(self, li: DataFrame) -> DataFrame:
        order = ["l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
        n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
        q = F.col("l_quantity")
        return li.select(
            (F.col("l_orderkey") * 1000 + n).alias("id"),
            F.col("l_orderkey").alias("image_id"),
            F.when(F.col("l_linenumber") != 7, F.col("l_suppkey")).alias("subject_id"),
            (F.col("l_discount") * 5).alias("bbox_x"),
            (F.col("l_tax") * 5).alias("bbox_y"),
            (q / 200).alias("bbox_w"),
            (q / 100).alias("bbox_h"),
            F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("added_at"),
            (F.lit(0.5) + F.col("l_discount") * 5).alias("det_score"),
            F.when(q >= 5, F.round(F.col("l_tax") + F.col("l_discount"), 2)).alias("quality_score"),
            F.when(F.col("l_linenumber") == 6, F.lit("old")).otherwise(F.lit(EMBEDDER)).alias("embedder_id"),
        )

    @property
    def subjects(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.raw("supplier").select(k.alias("id"), F.when(k % 4 != 0, F.col("s_name")).alias("name"), F.lit(None).cast("long").alias("thumbnail_face_id"), F.lit("person").alias("type"), (k % 7).alias("added_at"))

    @property
    def tags(self) -> DataFrame:
        b = self.raw("part").select("p_brand").distinct()
        n = F.row_number().over(Window.orderBy("p_brand")) - 1
        return b.select(n.cast("long").alias("id"), F.col("p_brand").alias("name"), F.lower("p_brand").alias("name_normalized"), n.cast("long").alias("added_at"))

    @property
    def subject_tags(self) -> DataFrame:
        pairs = self.subjects.select(F.col("id").alias("subject_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("tag_id"))
        pairs = pairs.where((F.col("subject_id") * 7 + F.col("tag_id") * 3) % 11 == 0)
        return pairs.join(F.broadcast(self.tags.select(F.col("id").alias("tag_id"))), "tag_id", "left_semi").select("subject_id", "tag_id", F.lit(0).cast("long").alias("added_at"))

    @property
    def queue(self) -> DataFrame:
        i = self.images
        both = i.select("id", "mtime", "semantic_analysis_done", "subject_analysis_done", F.explode(F.array(F.lit("semantic"), F.lit("subject"))).alias("pipeline"))
        open_ = F.when(F.col("pipeline") == "semantic", ~F.col("semantic_analysis_done")).otherwise(~F.col("subject_analysis_done"))
        at = F.when(F.col("pipeline") == "semantic", F.lit(0)).otherwise(F.lit(1))
        return both.where(open_).select((F.col("id") * 2 + at).alias("id"), F.col("id").alias("image_id"), "pipeline", (F.col("id") % 8).cast("int").alias("attempts"), F.col("mtime").alias("scheduled_at"))

    @property
    def face_vectors(self) -> DataFrame:
        """id, embedding, subject_id: null for ids divisible by 3."""
        v = F.col("vec_id")
        return self.raw("embeddings").select(v.alias("id"), "embedding", F.when(v % 3 != 0, F.col("label").cast("long")).alias("subject_id"))

    @property
    def fs_events(self) -> DataFrame:
        kind = F.when(F.col("event_type") == "signup", F.lit("Create")).when(F.col("event_type").isin("purchase", "error"), F.lit("Remove")).otherwise(F.lit("Modify"))
        return self.raw("events").select("event_id", F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"))


FIXTURES = {
    "folders": "SELECT n_nationkey::BIGINT AS id, '/r' || n_regionkey || '/' || n_name AS path, n_nationkey::BIGINT AS added_at FROM nation",
    "images": """SELECT o_orderkey AS id, c_nationkey::BIGINT AS folder_id, '/img/' || o_orderkey || '.jpg' AS path,
  CASE WHEN o_orderstatus = 'O' THEN '' ELSE 'h' || o_orderkey END AS file_hash,
  CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'DONE' ELSE 'FAILED' END AS hash_status,
  floor(o_totalprice)::BIGINT AS file_size,
  CASE WHEN o_orderkey % 3 <> 0 THEN epoch(o_orderdate)::BIGINT - 86400 * (o_orderkey % 5) END AS date_taken,
  epoch(o_orderdate)::BIGINT AS mtime,
  CASE WHEN o_orderkey % 4 <> 0 THEN '/t/' || o_orderkey END AS thumbnail_path,
  CASE WHEN o_orderkey % 4 <> 0 THEN '/p/' || o_orderkey END AS preview_path,
  o_orderstatus <> 'O' AS semantic_analysis_done, o_orderstatus = 'F' AS subject_analysis_done,
  epoch(o_orderdate)::BIGINT AS added_at, epoch(o_orderdate)::BIGINT AS updated_at,
  CASE WHEN o_orderkey % 17 = 0 THEN epoch(o_orderdate)::BIGINT END AS deleted_at
  FROM orders JOIN customer ON o_custkey = c_custkey""",
    "faces": f"""SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS id,
  l_orderkey AS image_id, CASE WHEN l_linenumber <> 7 THEN l_suppkey END AS subject_id,
  l_discount * 5 AS bbox_x, l_tax * 5 AS bbox_y, l_quantity / 200 AS bbox_w, l_quantity / 100 AS bbox_h,
  epoch(l_shipdate)::BIGINT AS added_at, 0.5 + l_discount * 5 AS det_score,
  CASE WHEN l_quantity >= 5 THEN round(l_tax + l_discount, 2) END AS quality_score,
  CASE WHEN l_linenumber = 6 THEN 'old' ELSE '{EMBEDDER}' END AS embedder_id FROM lineitem""",
    "subjects": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS name, NULL::BIGINT AS thumbnail_face_id, 'person' AS type, s_suppkey % 7 AS added_at FROM supplier",
    "tags": "SELECT row_number() OVER (ORDER BY p_brand) - 1 AS id, p_brand AS name, lower(p_brand) AS name_normalized, row_number() OVER (ORDER BY p_brand) - 1 AS added_at FROM (SELECT DISTINCT p_brand FROM part)",
    "subject_tags": "SELECT s.id AS subject_id, t.id AS tag_id, 0::BIGINT AS added_at FROM subjects s, tags t WHERE (s.id * 7 + t.id * 3) % 11 = 0",
    "queue": """SELECT id * 2 + (pipeline = 'subject')::INT AS id, id AS image_id, pipeline, (id % 8)::INT AS attempts, mtime AS scheduled_at
  FROM images, (VALUES ('semantic'), ('subject')) p(pipeline)
  WHERE CASE pipeline WHEN 'semantic' THEN NOT semantic_analysis_done ELSE NOT subject_analysis_done END""",
    "face_vectors": "SELECT vec_id AS id, embedding, CASE WHEN vec_id % 3 <> 0 THEN label::BIGINT END AS subject_id FROM embeddings",
    "fs_events": "SELECT event_id, '/u/' || user_id AS path, CASE event_type WHEN 'signup' THEN 'Create' WHEN 'purchase' THEN 'Remove' WHEN 'error' THEN 'Remove' ELSE 'Modify' END AS kind, ts FROM events",
}
_NEEDS = {"subject_tags": ("subjects", "tags"), "queue": ("images",)}


def sql(body: str, *tables: str) -> str:
    """body over the named fixtures, as DuckDB SQL; a body may begin with further WITH entries before '>>'."""
    names: list[str] = []
    for t in tables:
        names += [x for x in (*_NEEDS.get(t, ()), t) if x not in names]
    extra, _, query = body.rpartition(">>")
    parts = [f"{n} AS ({FIXTURES[n]})" for n in names] + ([extra.strip()] if extra.strip() else [])
    return f"WITH {', '.join(parts)} {query}" if parts else query
