"""Queries over the relational catalog, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import EMBEDDER, Catalog, sql
from ..functions import numeric, text
from ..operators import listing as L
from ..operators import relations as R

NOW = 996_710_400  # 2001-08-02, the day on which all queries are asked
TAKEN = "coalesce(date_taken, mtime)"
IMG = ["id", "folder_id", "path", "mtime"]
#: ASCII-only lower case in DuckDB.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
FOLD = f"translate(lower(trim({{}})), '{text.ACCENTED}', '{text.PLAIN}')"
PHOTOS = "fi.id % 1000 <> 999"


def _folders(c: Catalog):
    """The folders, and some without images."""
    r = c.raw("region")
    return c.folders.unionByName(r.select((F.col("r_regionkey") + 100).cast("long").alias("id"), F.concat(F.lit("/empty/"), F.col("r_name")).alias("path"), F.col("r_regionkey").cast("long").alias("added_at")))


def _faces(c: Catalog):
    """The faces of all images; some subjects have none."""
    return c.faces.where(F.coalesce(F.col("subject_id"), F.lit(0)) % 10 != 2)


def _cache(c: Catalog):
    """Cache entries around the age limit, from part."""
    p = c.raw("part")
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("q"), (F.col("p_partkey") % 50).cast("string")).alias("cache_key"), F.when(F.col("p_partkey") % 2 == 0, F.lit("text")).otherwise(F.lit("image")).alias("query_type"), (F.lit(NOW) - F.col("p_partkey") * 30).cast("long").alias("created_at"))


CACHE = f"cache AS (SELECT p_partkey AS id, 'q' || (p_partkey % 50) AS cache_key, CASE WHEN p_partkey % 2 = 0 THEN 'text' ELSE 'image' END AS query_type, {NOW} - p_partkey * 30 AS created_at FROM part) >> "


def _suggested(c: Catalog):
    s = c.subjects
    return s.where(F.col("id") >= 3).select(F.col("id"), (F.col("id") - 3).alias("subject_id_a"), F.col("id").alias("subject_id_b"), (((F.col("id") * 37) % 100) / 100.0).alias("score"))


SUGGESTED = "pairs AS (SELECT id, id - 3 AS subject_id_a, id AS subject_id_b, ((id * 37) % 100) / 100.0 AS score FROM subjects WHERE id >= 3) >> "


def _edges(c: Catalog):
    """Edges between neighbouring vectors, some in reverse."""
    v = c.face_vectors.select(F.col("id").alias("face_a"))
    return v.where("face_a % 4 <> 3").select("face_a", (F.col("face_a") + 1).alias("face_b"), ((F.col("face_a") * 13 % 50) / 100.0 + 0.4).alias("weight"))


EDGES = "edges AS (SELECT id AS face_a, id + 1 AS face_b, (id * 13 % 50) / 100.0 + 0.4 AS weight FROM face_vectors WHERE id % 4 <> 3)"


def _constraints(c: Catalog):
    v = c.face_vectors.where("id % 10 = 0").select("id")
    kind = F.when(F.col("id") % 20 == 0, F.lit("cannot_link")).otherwise(F.lit("must_link"))
    source = F.when(F.col("id") % 40 == 0, F.lit("dismiss")).otherwise(F.lit("removal"))
    return v.select((F.col("id") + 1).alias("face_a"), F.col("id").alias("face_b"), kind.alias("kind"), source.alias("source"), F.lit(0).cast("long").alias("created_at"))


CONSTRAINTS = "constraints AS (SELECT id + 1 AS face_a, id AS face_b, CASE WHEN id % 20 = 0 THEN 'cannot_link' ELSE 'must_link' END AS kind, CASE WHEN id % 40 = 0 THEN 'dismiss' ELSE 'removal' END AS source, 0::BIGINT AS created_at FROM face_vectors WHERE id % 10 = 0)"


def _listing(c: Catalog):
    """A directory listing: most images, some changed, some new, some missing."""
    i = c.images.where("id % 13 <> 0")
    size = F.when(F.col("id") % 7 == 0, F.col("file_size") + 1).otherwise(F.col("file_size"))
    digest = F.when(F.col("id") % 21 == 0, F.col("file_hash")).when(F.col("id") % 35 != 0, F.concat(F.lit("n"), F.col("id").cast("string")))
    known = i.select("path", size.alias("size"), "mtime", digest.alias("hash"))
    fresh = c.folders.select(F.concat(F.lit("/img/new"), F.col("id").cast("string"), F.lit(".jpg")).alias("path"), F.lit(1).cast("long").alias("size"), F.lit(NOW).cast("long").alias("mtime"), F.lit("x").alias("hash"))
    return known.unionByName(fresh)


LISTING = f"""listing AS (SELECT path, CASE WHEN id % 7 = 0 THEN file_size + 1 ELSE file_size END AS size, mtime, CASE WHEN id % 21 = 0 THEN file_hash WHEN id % 35 <> 0 THEN 'n' || id END AS hash FROM images WHERE id % 13 <> 0
  UNION ALL SELECT '/img/new' || id || '.jpg', 1, {NOW}, 'x' FROM folders)"""
ACTIONS = f"""{LISTING}, found AS (SELECT coalesce(i.path, l.path) AS path, i.id, l.size AS disk_size, l.mtime AS disk_mtime, l.hash AS disk_hash,
  CASE WHEN i.id IS NULL THEN 'new' WHEN l.path IS NULL THEN CASE WHEN i.deleted_at IS NULL THEN 'delete' ELSE 'gone' END
  WHEN i.file_size = l.size AND i.mtime = l.mtime THEN CASE WHEN i.deleted_at IS NULL THEN 'unchanged' ELSE 'undelete' END
  WHEN l.hash IS NULL THEN 'failed' WHEN l.hash = i.file_hash THEN 'touched' ELSE 'modified' END AS action
  FROM images i FULL JOIN listing l ON i.path = l.path)"""


def _reports(c: Catalog):
    n = c.folders
    reports = n.where("id < 5").select("id", F.concat(F.lit("Report "), F.col("id").cast("string")).alias("name"), F.col("id").alias("folder_id"), (F.col("id") % 3).alias("added_at"))
    tags = reports.select(F.col("id").alias("report_id"), F.posexplode(F.array(*(((F.col("id") * 5 + k) % 27) for k in (7, 2, 9)))).alias("pos", "tag_id"))
    return reports, tags


REPORTS = """reports AS (SELECT id, 'Report ' || id AS name, id AS folder_id, id % 3 AS added_at FROM folders WHERE id < 5),
  report_tags AS (SELECT id AS report_id, pos, (id * 5 + list_extract([7, 2, 9], pos + 1)) % 27 AS tag_id FROM reports, (VALUES (0), (1), (2)) p(pos))"""


def _p(df, *cols):
    return df.select(*cols)


_TAGGED = """tagged AS (SELECT DISTINCT st.subject_id FROM subject_tags st JOIN tags t ON st.tag_id = t.id WHERE t.name_normalized LIKE '%brand%1%' ESCAPE '\\')"""
_A5 = f"""{_TAGGED}, hits AS (SELECT f.image_id, count(DISTINCT f.subject_id) AS subjects FROM faces f JOIN tagged USING (subject_id) GROUP BY 1),
  ranked AS (SELECT image_id, subjects, date_taken AS newest, row_number() OVER (ORDER BY subjects DESC, date_taken DESC NULLS LAST, image_id) AS rank FROM hits JOIN images i ON i.id = image_id WHERE deleted_at IS NULL)"""
_COVER = """counts AS (SELECT f.subject_id, count(DISTINCT f.image_id) AS frequency FROM faces f JOIN images i ON f.image_id = i.id WHERE f.subject_id % 10 <> 2 AND i.folder_id = 3 AND f.subject_id IS NOT NULL GROUP BY 1),
  targets AS (SELECT DISTINCT subject_id FROM subject_tags WHERE tag_id IN (0, 1)),
  cover AS (SELECT s.id AS subject_id, coalesce(s.name, 'Unknown') AS name, coalesce(c.frequency, 0) AS frequency,
    CASE WHEN t.subject_id IS NULL THEN 'others' WHEN coalesce(c.frequency, 0) > 0 THEN 'present' ELSE 'missing' END AS bucket
    FROM counts c FULL JOIN targets t USING (subject_id) JOIN subjects s ON s.id = subject_id)"""
_BEST = "best AS (SELECT subject_id, id AS face_id, row_number() OVER (PARTITION BY subject_id ORDER BY quality_score DESC NULLS LAST, bbox_w * bbox_h DESC, id) AS rank FROM faces WHERE subject_id IS NOT NULL)"


def _thumbed(c: Catalog):
    """Subjects of whom some have a thumbnail, not always the best or their own."""
    first = c.faces.where("subject_id is not null").groupBy("subject_id").agg(F.min("id").alias("low"))
    return c.subjects.join(first, F.col("id") == F.col("subject_id"), "left").select("id", "name", F.when(F.col("id") % 3 == 0, F.col("low")).when(F.col("id") % 3 == 1, F.lit(-1).cast("long")).alias("thumbnail_face_id"), "type", "added_at")


THUMBED = "thumbed AS (SELECT s.id, s.name, CASE WHEN s.id % 3 = 0 THEN low WHEN s.id % 3 = 1 THEN -1 END AS thumbnail_face_id, s.type, s.added_at FROM subjects s LEFT JOIN (SELECT subject_id, min(id) AS low FROM faces WHERE subject_id IS NOT NULL GROUP BY 1) ON s.id = subject_id)"
_TAGLIST = "string_agg(t.name, ',' ORDER BY " + LOWER.format("t.name") + ", t.name)"


def _names(c):
    return F.array_join(F.transform(c, lambda t: t["name"]), ",")


def queries() -> dict:
    return {
        "s1_list_folders": (lambda c: L.ranked(c.folders, F.col("added_at"), F.col("id")), sql("SELECT *, row_number() OVER (ORDER BY added_at, id)::INT AS rank FROM folders", "folders")),
        "s5_image_by_id": (lambda c: L.lookup(c.images, *IMG, id=5), sql("SELECT id, folder_id, path, mtime FROM images WHERE id = 5", "images")),
        "s5_image_by_path": (lambda c: L.lookup(c.images, *IMG, path="/img/7.jpg"), sql("SELECT id, folder_id, path, mtime FROM images WHERE path = '/img/7.jpg'", "images")),
        "s5_face_with_path": (lambda c: L.lookup(c.faces, "id", "image_id", id=5001).join(c.images.select(F.col("id").alias("image_id"), "path"), "image_id"), sql("SELECT f.id, image_id, path FROM faces f JOIN images i ON f.image_id = i.id WHERE f.id = 5001", "faces", "images")),
        "s12_query_key": (lambda c: c.raw("part").select("p_partkey", text.cache_key(F.unbase64(F.base64(F.col("p_name").cast("binary")))).alias("key")), "SELECT p_partkey, sha256(p_name) AS key FROM part"),
        "s15_scan_metadata": (lambda c: L.scan_metadata(c.images), sql("SELECT id, path, file_hash, file_size, mtime, hash_status, deleted_at FROM images", "images")),
        "p1_list_images": (lambda c: L.ranked(L.live(c.images).where("folder_id = 3").select(*IMG, L.taken().alias("taken")), F.col("taken").desc(), F.col("id").desc()), sql(f"SELECT id, folder_id, path, mtime, {TAKEN} AS taken, row_number() OVER (ORDER BY {TAKEN} DESC, id DESC)::INT AS rank FROM images WHERE deleted_at IS NULL AND folder_id = 3", "images")),
        "p2_needs_preview": (lambda c: L.needs_preview(c.images).select(*IMG), sql("SELECT id, folder_id, path, mtime FROM images WHERE deleted_at IS NULL AND thumbnail_path IS NULL", "images")),
        "p3_pending_hash": (lambda c: L.pending_hash(c.images).select("id", "path"), sql("SELECT id, path FROM images WHERE deleted_at IS NULL AND hash_status = 'PENDING' ORDER BY id LIMIT 32", "images")),
        "p4_due_queue": (lambda c: L.due(c.queue, "semantic", NOW).select("id", "image_id", "attempts"), sql(f"SELECT id, image_id, attempts FROM queue WHERE pipeline = 'semantic' AND scheduled_at <= {NOW} ORDER BY scheduled_at, id LIMIT 12", "queue")),
        "p5_embedding_ready": (lambda c: L.embedding_ready(c.images.join(c.face_vectors.select("id", "embedding"), "id", "left")).select("id"), sql("SELECT i.id FROM images i JOIN face_vectors v ON i.id = v.id WHERE semantic_analysis_done AND deleted_at IS NULL AND embedding IS NOT NULL", "images", "face_vectors")),
        "p6_cache_hits": (lambda c: L.cache_hits(_cache(c), NOW), sql(CACHE + f"SELECT * FROM cache WHERE created_at > {NOW} - 1800")),
        "p6_cache_evicted": (lambda c: L.cache_evicted(_cache(c), NOW), sql(CACHE + f"SELECT * FROM cache WHERE NOT created_at < {NOW} - 1800")),
        "p7_like": (lambda c: c.raw("part").where(text.like(text.folded(F.col("p_name")), text.like_pattern("all gi"))).select("p_partkey", "p_name"), f"SELECT p_partkey, p_name FROM part WHERE {FOLD.format('p_name')} LIKE '%all%gi%' ESCAPE '\\'"),
        "p8_ordered_tokens": (lambda c: c.raw("documents").where(text.has_tokens(F.col("text"), "étion par")).select("doc_id"), f"SELECT doc_id FROM documents WHERE regexp_matches({FOLD.format('text')}, '(?s)etion.*par')"),
        "p9_duplicate_name": (lambda c: L.duplicate_name(c.subjects, " SUPPLIER#000000001 ", 99).select("id", "name"), sql(f"SELECT id, name FROM subjects WHERE {LOWER.format('name')} = 'supplier#000000001' AND id <> 99 ORDER BY id LIMIT 1", "subjects")),
        "p10_date_range": (lambda c: L.taken_between(c.images, 700_000_000, 800_000_000).select("id", "date_taken"), sql("SELECT id, date_taken FROM images WHERE date_taken BETWEEN 700000000 AND 800000000", "images")),
        "p11_merge_candidates": (lambda c: L.merge_candidates(c.subjects, "00000 ".strip(), 1, 2).select("id", "name"), sql("SELECT id, name FROM subjects WHERE name IS NOT NULL AND id NOT IN (1, 2) AND contains(lower(name), '00000')", "subjects")),
        "p11_tag_filter": (lambda c: c.tags.where(text.contains_ignoring_case(F.col("name"), "BRAND#1")).select("id", "name"), sql("SELECT id, name FROM tags WHERE contains(lower(name), 'brand#1')", "tags")),
        "p12_ids": (lambda c: L.with_ids(c.faces, "subject_id", [1, 3, 5]).select("image_id").distinct(), sql("SELECT DISTINCT image_id FROM faces WHERE subject_id IN (1, 3, 5)", "faces")),
        "p12_no_ids": (lambda c: L.with_ids(c.faces, "subject_id", []).select("image_id"), sql("SELECT image_id FROM faces WHERE false", "faces")),
        "p13_stage": (lambda c: c.images.select("id", numeric.stage(F.col("semantic_analysis_done"), F.col("subject_analysis_done")).alias("stage")), sql("SELECT id, CASE WHEN semantic_analysis_done AND subject_analysis_done THEN 'ready' ELSE 'pending' END AS stage FROM images", "images")),
        "p14_suggestions_of": (lambda c: _suggested(c).where("subject_id_a = 4 or subject_id_b = 4"), sql(SUGGESTED + "SELECT * FROM pairs WHERE subject_id_a = 4 OR subject_id_b = 4", "subjects")),
        "p15_shaped": (lambda c: L.live(c.images).select(F.struct("id", "path").alias("image"), F.lit(1.0).alias("score")).select("image.id", "image.path", "score"), sql("SELECT id, path, 1.0::DOUBLE AS score FROM images WHERE deleted_at IS NULL", "images")),
        "j1_folder_counts": (lambda c: R.folder_counts(_folders(c), c.images), sql("more AS (SELECT * FROM folders UNION ALL SELECT r_regionkey + 100, '/empty/' || r_name, r_regionkey FROM region) >> SELECT f.id, f.path, f.added_at, count(i.id) AS photo_count FROM more f LEFT JOIN images i ON i.folder_id = f.id AND i.deleted_at IS NULL GROUP BY ALL", "folders", "images")),
        "j2_tag_counts": (lambda c: L.ranked(R.tag_counts(c.tags, c.subject_tags), text.ascii_lower(F.col("name")), F.col("id")), sql(f"SELECT t.id, t.name, count(st.subject_id) AS usage_count, row_number() OVER (ORDER BY {LOWER.format('t.name')}, t.id)::INT AS rank FROM tags t LEFT JOIN subject_tags st ON st.tag_id = t.id GROUP BY t.id, t.name", "subject_tags")),
        "j3_subject_photos": (lambda c: R.subject_photos(c.images, c.faces, 3).select("id", "path"), sql("SELECT id, path FROM images WHERE deleted_at IS NULL AND id IN (SELECT image_id FROM faces WHERE subject_id = 3)", "images", "faces")),
        "j4_photos_with_faces": (lambda c: R.subject_photos_with_faces(c.images, c.faces, 3).select("id", "taken", "face_id", F.round("face_bbox.x", 6).alias("x"), F.round("face_bbox.w", 6).alias("w")), sql(f"SELECT i.id, {TAKEN} AS taken, f.id AS face_id, round(bbox_x, 6) AS x, round(bbox_w, 6) AS w FROM images i JOIN faces f ON f.image_id = i.id WHERE deleted_at IS NULL AND subject_id = 3", "images", "faces")),
        "j5_suggestions": (lambda c: R.suggestions(_suggested(c), c.subjects, 5).select("id", "score", F.col("subject_a.id").alias("a"), F.col("subject_a.name").alias("name_a"), F.col("subject_b.id").alias("b"), F.col("subject_b.name").alias("name_b")), sql(SUGGESTED + "SELECT p.id, p.score, a.id AS a, a.name AS name_a, b.id AS b, b.name AS name_b FROM pairs p JOIN subjects a ON a.id = subject_id_a JOIN subjects b ON b.id = subject_id_b ORDER BY score DESC, p.id LIMIT 5", "subjects")),
        "j7_search_subjects": (lambda c: L.ranked(R.search_subjects(c.subjects, c.subject_tags, c.tags, "brand 1"), F.col("source"), F.col("id")).select("id", "name", "source", _names(F.col("tags")).alias("tags"), "rank"), sql(_TAGGED + f", found AS (SELECT subject_id AS id, 1 AS source FROM tagged ORDER BY id LIMIT 20) >> SELECT f.id, s.name, f.source, {_TAGLIST} AS tags, row_number() OVER (ORDER BY f.source, f.id)::INT AS rank FROM found f JOIN subjects s ON s.id = f.id LEFT JOIN subject_tags st ON st.subject_id = f.id LEFT JOIN tags t ON t.id = st.tag_id GROUP BY f.id, s.name, f.source", "subject_tags")),
        "j8_tag_subjects": (lambda c: R.subjects_with_tag(c.subjects, c.subject_tags, c.tags, 4).select("id", "name", _names(F.col("tags")).alias("tags")), sql(f"SELECT s.id, s.name, {_TAGLIST} AS tags FROM subjects s JOIN subject_tags st ON st.subject_id = s.id JOIN tags t ON t.id = st.tag_id WHERE s.id IN (SELECT subject_id FROM subject_tags WHERE tag_id = 4) GROUP BY s.id, s.name", "subject_tags")),
        "j9_without_faces": (lambda c: R.without_faces(c.subjects, c.faces.where("subject_id % 5 <> 0")).select("id", "name"), sql("SELECT id, name FROM subjects WHERE id NOT IN (SELECT subject_id FROM faces WHERE subject_id % 5 <> 0)", "subjects", "faces")),
        "j10_not_queued": (lambda c: R.not_queued(c.images, c.queue, "subject"), sql("SELECT id FROM images WHERE deleted_at IS NULL AND id NOT IN (SELECT image_id FROM queue WHERE pipeline = 'subject')", "queue")),
        "j11_not_barred": (lambda c: R.without_pairs(_edges(c), _constraints(c).where("kind = 'cannot_link'"), "face_a", "face_b", "face_a", "face_b"), sql(EDGES + ", " + CONSTRAINTS + ">> SELECT face_a, face_b, weight FROM edges e WHERE NOT EXISTS (SELECT 1 FROM constraints c WHERE kind = 'cannot_link' AND least(c.face_a, c.face_b) = least(e.face_a, e.face_b) AND greatest(c.face_a, c.face_b) = greatest(e.face_a, e.face_b))", "face_vectors")),
        "j12_dismissed_subjects": (lambda c: R.dismissed_subjects(_constraints(c), c.face_vectors), sql(CONSTRAINTS + ">> SELECT DISTINCT least(a.subject_id, b.subject_id) AS lo, greatest(a.subject_id, b.subject_id) AS hi FROM constraints c JOIN face_vectors a ON a.id = face_a JOIN face_vectors b ON b.id = face_b WHERE kind = 'cannot_link' AND source = 'dismiss' AND a.subject_id <> b.subject_id", "face_vectors")),
        "j13_in_folder": (lambda c: R.in_folder(3, c.images, c.faces, c.face_vectors.select((F.col("id") * 1000 + 1).alias("id")))["face_vectors"], sql("SELECT id * 1000 + 1 AS id FROM face_vectors WHERE id * 1000 + 1 IN (SELECT f.id FROM faces f JOIN images i ON f.image_id = i.id WHERE folder_id = 3)", "images", "faces", "face_vectors")),
        "j14_current_vectors": (lambda c: R.current_vectors(c.face_vectors.select((F.col("id") * 1000 + 1).alias("id")), c.faces, EMBEDDER), sql(f"SELECT f.id, f.subject_id FROM face_vectors v JOIN faces f ON f.id = v.id * 1000 + 1 WHERE embedder_id = '{EMBEDDER}'", "faces", "face_vectors")),
        "j15_merged_batches": (lambda c: R.merged_batches(c.queue.where("pipeline = 'semantic'"), c.queue.where("pipeline = 'subject'")), sql("SELECT coalesce(a.image_id, b.image_id) AS image_id, a.id AS semantic_slot, b.id AS subject_slot FROM (SELECT * FROM queue WHERE pipeline = 'semantic') a FULL JOIN (SELECT * FROM queue WHERE pipeline = 'subject') b ON a.image_id = b.image_id", "queue")),
        "j16_changes": (lambda c: _changes(c).select("path", "id", "action"), sql(ACTIONS + ">> SELECT path, id, action FROM found", "folders", "images")),
        "j17_deepest_folder": (lambda c: R.deepest_folder(_files(c), _nested(c)), sql("nested AS (SELECT id, path FROM folders UNION ALL SELECT id + 100, path || '/sub' FROM folders WHERE id % 2 = 0), files AS (SELECT path || '/sub/x' || id || '.jpg' AS path FROM folders UNION ALL SELECT path || 'y.jpg' FROM folders) >> SELECT f.path, arg_max(n.id, length(n.path)) AS folder_id FROM files f JOIN nested n ON starts_with(f.path, n.path || '/') GROUP BY 1", "folders")),
        "j19_mutual": (lambda c: _swapped(c), sql(EDGES + ", both_ AS (SELECT face_a AS a, face_b AS b FROM edges UNION ALL SELECT face_b, face_a FROM edges WHERE face_a % 3 = 0) >> SELECT x.a, x.b FROM both_ x JOIN both_ y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b", "face_vectors")),
        "j21_report_subjects": (lambda c: c.faces.select(F.col("subject_id").alias("k")).distinct().join(c.subjects, F.col("k") == F.col("id"), "left").select("k", F.coalesce("name", F.lit("Unknown")).alias("name")), sql("SELECT k, coalesce(s.name, 'Unknown') AS name FROM (SELECT DISTINCT subject_id AS k FROM faces) LEFT JOIN subjects s ON k = s.id", "faces", "subjects")),
        "j22_subject_tags": (lambda c: L.ranked(c.subject_tags.where("subject_id = 3").join(c.tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").select("tag_id", "name"), text.ascii_lower(F.col("name")), F.col("tag_id")), sql(f"SELECT t.id AS tag_id, t.name, row_number() OVER (ORDER BY {LOWER.format('t.name')}, t.id)::INT AS rank FROM subject_tags st JOIN tags t ON t.id = st.tag_id WHERE subject_id = 3", "subject_tags")),
        "a1_counts": (lambda c: R.folder_counts(c.folders, c.images).select("id", "photo_count"), sql("SELECT f.id, count(i.id) AS photo_count FROM folders f LEFT JOIN images i ON i.folder_id = f.id AND i.deleted_at IS NULL GROUP BY 1", "folders", "images")),
        "a3_subject_detail": (lambda c: R.subject_detail(c.subjects, c.faces), sql("SELECT s.id, s.name, count(DISTINCT f.image_id) AS photo_count, count(f.id) AS face_count FROM subjects s LEFT JOIN faces f ON f.subject_id = s.id GROUP BY 1, 2", "subjects", "faces")),
        "a4_coverage": (lambda c: _cover(c), sql(_COVER + ">> SELECT * FROM cover", "images", "faces", "subject_tags")),
        "a4_summary": (lambda c: R.coverage_summary(_cover(c)), sql(_COVER + ">> SELECT count(*) FILTER (bucket <> 'others') AS targets, count(*) FILTER (bucket = 'present') AS present, count(*) FILTER (bucket = 'missing') AS missing, count(*) FILTER (bucket = 'others') AS others FROM cover", "images", "faces", "subject_tags")),
        "a5_images_by_tag": (lambda c: R.images_by_tag(c.images, c.faces, c.subject_tags, c.tags, "brand 1"), sql(_A5 + ">> SELECT image_id, subjects, newest FROM ranked", "images", "faces", "subject_tags")),
        "j6_images_by_tag_top": (lambda c: L.ranked(R.images_by_tag(c.images, c.faces, c.subject_tags, c.tags, "brand 1").orderBy(F.col("subjects").desc(), F.col("newest").desc_nulls_last(), "image_id").limit(50), F.col("subjects").desc(), F.col("newest").desc_nulls_last(), F.col("image_id")), sql(_A5 + ">> SELECT image_id, subjects, newest, rank::INT AS rank FROM ranked WHERE rank <= 50", "images", "faces", "subject_tags")),
        "a7_queue_counts": (lambda c: R.queue_counts(c.queue, c.images, NOW), sql(f"SELECT (SELECT count(DISTINCT image_id) FROM queue) AS pending, (SELECT count(DISTINCT image_id) FROM queue WHERE scheduled_at <= {NOW}) AS due, (SELECT count(*) FROM images WHERE deleted_at IS NULL AND semantic_analysis_done AND subject_analysis_done) AS done", "queue")),
        "a8_total": (lambda c: R.folder_counts(c.folders, c.images).agg(F.sum("photo_count").alias("total")), sql("SELECT count(*) AS total FROM images WHERE deleted_at IS NULL AND folder_id IN (SELECT id FROM folders)", "folders", "images")),
        "a9_by_day": (lambda c: R.by_day(c.images).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.array_join("images", ",").alias("images")), sql(f"SELECT strftime(make_timestamp({TAKEN} * 1000000), '%Y-%m-%d') AS day, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY {TAKEN} DESC, id DESC) AS images FROM images GROUP BY 1", "images")),
        "a10_report_tags": (lambda c: R.report_tags(_reports(c)[1]).select("report_id", F.array_join("tag_ids", ",").alias("tag_ids")), sql(REPORTS + ">> SELECT report_id, string_agg(tag_id::VARCHAR, ',' ORDER BY pos) AS tag_ids FROM report_tags GROUP BY 1", "folders")),
        "a12_subject_sizes": (lambda c: c.face_vectors.where("subject_id is not null").groupBy("subject_id").agg(F.count("*").alias("n")), sql("SELECT subject_id, count(*) AS n FROM face_vectors WHERE subject_id IS NOT NULL GROUP BY 1", "face_vectors")),
        "w1_best_face": (lambda c: R.best_faces(c.faces).select("subject_id", "face_id"), sql(_BEST + ">> SELECT subject_id, face_id FROM best WHERE rank = 1", "faces")),
        "w2_thumbnail_upgrades": (lambda c: R.thumbnail_upgrades(_thumbed(c), c.faces), sql(_BEST + ", " + THUMBED + ">> SELECT t.id, face_id FROM thumbed t JOIN best ON subject_id = t.id AND rank = 1 WHERE thumbnail_face_id IS DISTINCT FROM face_id", "faces", "subjects")),
        "w3_thumbnail_fills": (lambda c: R.thumbnail_fills(_thumbed(c), c.faces), sql(_BEST + ", " + THUMBED + ">> SELECT t.id, face_id FROM thumbed t JOIN best ON subject_id = t.id AND rank = 1 WHERE thumbnail_face_id IS NULL", "faces", "subjects")),
        "w4_representatives": (lambda c: R.representatives(_thumbed(c), c.faces), sql(THUMBED + ">> SELECT subject_id, face_id, rank::INT AS rank FROM (SELECT f.subject_id, f.id AS face_id, row_number() OVER (PARTITION BY f.subject_id ORDER BY (f.id IS NOT DISTINCT FROM t.thumbnail_face_id) DESC, f.id) AS rank FROM faces f JOIN thumbed t ON t.id = f.subject_id) WHERE rank <= 3", "faces", "subjects")),
        "o1_subjects": (lambda c: L.ranked(c.subjects.select("id", "name", "added_at"), F.col("name").isNull(), F.col("added_at").desc(), F.col("id")), sql("SELECT id, name, added_at, row_number() OVER (ORDER BY name IS NULL, added_at DESC, id)::INT AS rank FROM subjects", "subjects")),
        "o5_by_date": (lambda c: L.ranked(c.images.select("id", L.taken().alias("taken")), F.col("taken"), F.col("id")), sql(f"SELECT id, {TAKEN} AS taken, row_number() OVER (ORDER BY {TAKEN}, id)::INT AS rank FROM images", "images")),
        "o5_by_relevance": (lambda c: L.in_order(c.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score")), "relevance").limit(20), "SELECT p_partkey AS id, p_retailprice AS score FROM part ORDER BY score DESC, id DESC LIMIT 20"),
        "o6_sort_fallback": (lambda c: c.spark.range(1).select(F.lit(L.sort_key("relevance", "dateTaken", L.available_orders(c.images))).alias("key")), "SELECT 'dateTaken' AS key"),
        "o7_faces_of": (lambda c: L.ranked(c.faces.where("subject_id = 3").select("id", "added_at"), F.col("added_at").desc(), F.col("id").desc()), sql("SELECT id, added_at, row_number() OVER (ORDER BY added_at DESC, id DESC)::INT AS rank FROM faces WHERE subject_id = 3", "faces")),
        "o8_reports": (lambda c: L.ranked(_reports(c)[0], F.col("added_at").desc(), F.col("id").desc()), sql(REPORTS + ">> SELECT *, row_number() OVER (ORDER BY added_at DESC, id DESC)::INT AS rank FROM reports", "folders")),
        "o9_coverage_order": (lambda c: L.ranked(_cover(c), F.col("name"), F.col("subject_id"), by=("bucket",)), sql(_COVER + ">> SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY name, subject_id)::INT AS rank FROM cover", "images", "faces", "subject_tags")),
        "u1_both_pipelines": (lambda c: L.live(c.images).select(F.col("id").alias("image_id"), F.explode(F.array(F.lit("semantic"), F.lit("subject"))).alias("pipeline")), sql("SELECT id AS image_id, 'semantic' AS pipeline FROM images WHERE deleted_at IS NULL UNION ALL SELECT id, 'subject' FROM images WHERE deleted_at IS NULL", "images")),
        "u3_first_occurrence": (lambda c: c.raw("part").groupBy("p_brand").agg(F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_size"))), lambda x: x["p_size"] % 5)), ",").alias("ids")), "SELECT p_brand, string_agg(v::VARCHAR, ',' ORDER BY first) AS ids FROM (SELECT p_brand, p_size % 5 AS v, min(p_partkey) AS first FROM part GROUP BY ALL) GROUP BY 1"),
        "u4_vanished": (lambda c: L.live(c.images).join(_listing(c).select("path"), "path", "left_anti").select("id", "path"), sql(LISTING + ">> SELECT id, path FROM images WHERE deleted_at IS NULL AND path NOT IN (SELECT path FROM listing)", "folders", "images")),
        "u5_distinct_images": (lambda c: c.faces.where("subject_id in (1, 2)").select("image_id").distinct(), sql("SELECT DISTINCT image_id FROM faces WHERE subject_id IN (1, 2)", "faces")),
    }


def _changes(c: Catalog):
    from ..operators.mutations import changes

    return changes(_listing(c), c.images)


def _files(c: Catalog):
    f = c.folders
    return f.select(F.concat("path", F.lit("/sub/x"), F.col("id").cast("string"), F.lit(".jpg")).alias("path")).union(f.select(F.concat("path", F.lit("y.jpg"))))


def _nested(c: Catalog):
    f = c.folders.select("id", "path")
    return f.union(f.where("id % 2 = 0").select(F.col("id") + 100, F.concat("path", F.lit("/sub"))))


def _swapped(c: Catalog):
    e = _edges(c).select(F.col("face_a").alias("a"), F.col("face_b").alias("b"))
    both = e.union(e.where("a % 3 = 0").select("b", "a"))
    back = both.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return both.join(back, ["a", "b"], "left_semi").where("a < b")


def _cover(c: Catalog):
    return R.coverage(3, [0, 1], c.images, _faces(c), c.subjects, c.subject_tags)
