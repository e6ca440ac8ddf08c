"""Joins and aggregations of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric, text
from .listing import live, taken, with_ids


def folder_counts(folders: DataFrame, images: DataFrame) -> DataFrame:
    """All folders with their number of live images. Images are counted before
    the join, so it moves one row a folder."""
    counts = live(images).groupBy("folder_id").agg(F.count("*").alias("photo_count"))
    return folders.join(counts, folders["id"] == counts["folder_id"], "left").select("id", "path", "added_at", F.coalesce("photo_count", F.lit(0)).alias("photo_count"))


def tag_counts(tags: DataFrame, subject_tags: DataFrame) -> DataFrame:
    counts = subject_tags.groupBy("tag_id").agg(F.count("*").alias("usage_count"))
    return tags.join(counts, tags["id"] == counts["tag_id"], "left").select("id", "name", F.coalesce("usage_count", F.lit(0)).alias("usage_count"))


def subject_photos(images: DataFrame, faces: DataFrame, subject_id: int) -> DataFrame:
    theirs = faces.where(F.col("subject_id") == subject_id).select("image_id")
    return live(images).join(theirs, images["id"] == theirs["image_id"], "left_semi").orderBy(taken().desc(), F.col("id").desc())


def subject_photos_with_faces(images: DataFrame, faces: DataFrame, subject_id: int) -> DataFrame:
    box = F.struct(*(F.col(f"bbox_{c}").alias(c) for c in "xywh")).alias("face_bbox")
    theirs = faces.where(F.col("subject_id") == subject_id).select("image_id", F.col("id").alias("face_id"), box)
    return live(images).join(theirs, images["id"] == theirs["image_id"]).select("id", "path", taken().alias("taken"), "face_id", "face_bbox")


def suggestions(pairs: DataFrame, subjects: DataFrame, n: int | None = None) -> DataFrame:
    """Suggested pairs with both subjects as structs, best first. None: all; 0 or less: none."""
    one = lambda side: subjects.select(F.col("id").alias(f"subject_id_{side}"), F.struct("id", "name", "thumbnail_face_id").alias(f"subject_{side}"))
    rows = pairs.join(one("a"), "subject_id_a").join(one("b"), "subject_id_b").select("id", "score", "subject_a", "subject_b")
    rows = rows.orderBy(F.col("score").desc(), "id")
    return rows if n is None else rows.limit(max(0, n))


def images_by_tag(images: DataFrame, faces: DataFrame, subject_tags: DataFrame, tags: DataFrame, query: str) -> DataFrame:
    """image_id, subjects, newest: live images of subjects with a matching tag,
    most subjects first. The matching subjects are few next to the faces, which
    are filtered by them before the join with images."""
    pattern = text.like_pattern(query)
    if pattern is None:
        return images.select(F.col("id").alias("image_id"), F.lit(0).cast("long").alias("subjects"), F.col("date_taken").alias("newest")).where(F.lit(False))
    matching = subject_tags.join(tags.where(text.like(F.col("name_normalized"), pattern)).select(F.col("id").alias("tag_id")), "tag_id", "left_semi").select("subject_id").distinct()
    counts = faces.join(matching, "subject_id").groupBy("image_id").agg(F.countDistinct("subject_id").alias("subjects"))
    rows = counts.join(live(images).select(F.col("id").alias("image_id"), F.col("date_taken").alias("newest")), "image_id")
    return rows.select("image_id", "subjects", "newest")


def tags_of(subject_ids: DataFrame, subject_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """subject_id, tags: names in an order that ignores ASCII case."""
    pairs = subject_tags.join(subject_ids, "subject_id", "left_semi").join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    listed = F.sort_array(F.collect_list(F.struct(text.ascii_lower(F.col("name")).alias("k"), F.col("name"), F.col("tag_id").alias("id"))))
    return pairs.groupBy("subject_id").agg(F.transform(listed, lambda t: F.struct(t["id"].alias("id"), t["name"].alias("name"))).alias("tags"))


def search_subjects(subjects: DataFrame, subject_tags: DataFrame, tags: DataFrame, query: str, n: int = 20) -> DataFrame:
    """id, name, source (0 name, 1 tag), tags: subjects found by name, then by
    tag, each once at its first place, at most n."""
    pattern = text.like_pattern(query)
    by_name = subjects.where(text.has_tokens(F.col("name"), query)).select("id", F.lit(0).alias("source"))
    if pattern is None:
        by_tag = by_name.where(F.lit(False))
    else:
        hit = tags.where(text.like(F.col("name_normalized"), pattern)).select(F.col("id").alias("tag_id"))
        by_tag = subject_tags.join(hit, "tag_id", "left_semi").select(F.col("subject_id").alias("id"), F.lit(1).alias("source"))
    found = by_name.unionByName(by_tag).groupBy("id").agg(F.min("source").alias("source")).orderBy("source", "id").limit(n)
    rows = found.join(subjects.select("id", "name"), "id")
    own = tags_of(found.select(F.col("id").alias("subject_id")), subject_tags, tags)
    return rows.join(own, rows["id"] == own["subject_id"], "left").select("id", "name", "source", "tags")


def subjects_with_tag(subjects: DataFrame, subject_tags: DataFrame, tags: DataFrame, tag_id: int) -> DataFrame:
    rows = subjects.join(subject_tags.where(F.col("tag_id") == tag_id).select(F.col("subject_id").alias("id")), "id", "left_semi")
    own = tags_of(rows.select(F.col("id").alias("subject_id")), subject_tags, tags)
    return rows.join(own, rows["id"] == own["subject_id"], "left").select("id", "name", "tags")


def without_faces(subjects: DataFrame, faces: DataFrame) -> DataFrame:
    held = faces.where(F.col("subject_id").isNotNull()).select(F.col("subject_id").alias("id"))
    return subjects.join(held, "id", "left_anti")


def not_queued(images: DataFrame, queue: DataFrame, pipeline: str) -> DataFrame:
    queued = queue.where(F.col("pipeline") == pipeline).select(F.col("image_id").alias("id"))
    return live(images).join(queued, "id", "left_anti").select("id")


def pair_key(a: str, b: str) -> tuple[Column, Column]:
    lo, hi = numeric.low_high(F.col(a), F.col(b))
    return lo.alias("lo"), hi.alias("hi")


def without_pairs(edges: DataFrame, pairs: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """Edges (a, b) whose unordered pair is not among pairs (c, d)."""
    keyed = edges.select("*", *pair_key(a, b))
    return keyed.join(pairs.select(*pair_key(c, d)).distinct(), ["lo", "hi"], "left_anti").drop("lo", "hi")


def dismissed_subjects(constraints: DataFrame, faces: DataFrame) -> DataFrame:
    """Unordered subject pairs with a dismissed pair of faces."""
    own = lambda side: faces.select(F.col("id").alias(f"face_{side}"), F.col("subject_id").alias(f"subject_{side}"))
    rows = constraints.where((F.col("kind") == "cannot_link") & (F.col("source") == "dismiss"))
    return rows.join(own("a"), "face_a").join(own("b"), "face_b").where("subject_a is not null and subject_b is not null and subject_a <> subject_b").select(*pair_key("subject_a", "subject_b")).distinct()


def in_folder(folder_id: int, images: DataFrame, faces: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    """What hangs on a folder: images, their faces, their vectors."""
    own = images.where(F.col("folder_id") == folder_id)
    theirs = faces.join(own.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    return {"images": own, "faces": theirs, "face_vectors": vectors.join(theirs.select("id"), "id", "left_semi")}


def current_vectors(vectors: DataFrame, faces: DataFrame, embedder: str) -> DataFrame:
    return vectors.join(faces.where(F.col("embedder_id") == embedder).select("id", "subject_id"), "id")


def merged_batches(semantic: DataFrame, subject: DataFrame) -> DataFrame:
    """image_id with its slots in both batches, null where it has none."""
    return semantic.select("image_id", F.col("id").alias("semantic_slot")).join(subject.select("image_id", F.col("id").alias("subject_slot")), "image_id", "full_outer")


def path_prefixes(path: Column) -> Column:
    """All leading whole components of a path, the path itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def deepest_folder(files: DataFrame, folders: DataFrame) -> DataFrame:
    """path, folder_id: the deepest folder that contains a file, by whole
    components. The paths' prefixes make it an equi-join."""
    spread = files.select("path", F.explode(path_prefixes(F.col("path"))).alias("prefix"))
    met = spread.join(folders.select(F.col("path").alias("prefix"), F.col("id").alias("folder_id")), "prefix")
    return met.groupBy("path").agg(F.max_by("folder_id", F.length("prefix")).alias("folder_id"))


def subject_detail(subjects: DataFrame, faces: DataFrame) -> DataFrame:
    counts = faces.where(F.col("subject_id").isNotNull()).groupBy("subject_id").agg(F.countDistinct("image_id").alias("photo_count"), F.count("*").alias("face_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return subjects.join(counts, subjects["id"] == counts["subject_id"], "left").select("id", "name", zero("photo_count"), zero("face_count"))


def coverage(folder_id: int, tag_ids: list[int], images: DataFrame, faces: DataFrame, subjects: DataFrame, subject_tags: DataFrame) -> DataFrame:
    """subject_id, name, frequency (distinct images of the folder, deleted ones
    too), bucket: present or missing for subjects with one of the tags, others
    for the rest that occur. Nameless ones are 'Unknown'."""
    here = faces.join(images.where(F.col("folder_id") == folder_id).select(F.col("id").alias("image_id")), "image_id", "left_semi")
    counts = here.where(F.col("subject_id").isNotNull()).groupBy("subject_id").agg(F.countDistinct("image_id").alias("frequency"))
    targets = with_ids(subject_tags, "tag_id", tag_ids).select("subject_id").distinct().withColumn("target", F.lit(True))
    rows = counts.join(targets, "subject_id", "full_outer").join(subjects.select(F.col("id").alias("subject_id"), "name"), "subject_id")
    n = F.coalesce("frequency", F.lit(0))
    bucket = F.when(F.col("target").isNull(), F.lit("others")).when(n > 0, F.lit("present")).otherwise(F.lit("missing"))
    return rows.select("subject_id", F.coalesce("name", F.lit("Unknown")).alias("name"), n.cast("long").alias("frequency"), bucket.alias("bucket"))


def coverage_summary(rows: DataFrame) -> DataFrame:
    count = lambda *b: F.count(F.when(F.col("bucket").isin(*b), 1))
    return rows.agg(count("present", "missing").alias("targets"), count("present").alias("present"), count("missing").alias("missing"), count("others").alias("others"))


def queue_counts(queue: DataFrame, images: DataFrame, now: int) -> DataFrame:
    waiting = queue.agg(F.countDistinct("image_id").alias("pending"), F.countDistinct(F.when(F.col("scheduled_at") <= now, F.col("image_id"))).alias("due"))
    done = live(images).where("semantic_analysis_done and subject_analysis_done").agg(F.count("*").alias("done"))
    return waiting.withColumn("one", F.lit(1)).join(done.withColumn("one", F.lit(1)), "one").drop("one")


def by_day(images: DataFrame) -> DataFrame:
    """day, n, images: newest first, one row a day (UTC)."""
    at = taken()
    rows = images.select(F.to_date(F.timestamp_seconds(at)).alias("day"), F.struct(at.alias("taken"), "id").alias("i"))
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list("i"), False), lambda i: i["id"]).alias("images"))


def report_tags(report_tags_: DataFrame) -> DataFrame:
    """report_id, tag_ids in order of insertion (column pos)."""
    listed = F.sort_array(F.collect_list(F.struct("pos", "tag_id")))
    return report_tags_.groupBy("report_id").agg(F.transform(listed, lambda t: t["tag_id"]).alias("tag_ids"))


def best_faces(faces: DataFrame, n: int = 1) -> DataFrame:
    """subject_id, face_id, rank: by quality, unknown last, then area, then id."""
    area = F.col("bbox_w") * F.col("bbox_h")
    order = Window.partitionBy("subject_id").orderBy(F.col("quality_score").desc_nulls_last(), area.desc(), "id")
    rows = faces.where(F.col("subject_id").isNotNull()).withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= n).select("subject_id", F.col("id").alias("face_id"), "rank")


def thumbnail_upgrades(subjects: DataFrame, faces: DataFrame) -> DataFrame:
    best = best_faces(faces).select(F.col("subject_id").alias("id"), "face_id")
    return subjects.join(best, "id").where(~F.col("thumbnail_face_id").eqNullSafe(F.col("face_id"))).select("id", "face_id")


def thumbnail_fills(subjects: DataFrame, faces: DataFrame) -> DataFrame:
    return thumbnail_upgrades(subjects.where(F.col("thumbnail_face_id").isNull()), faces)


def representatives(subjects: DataFrame, faces: DataFrame, n: int = 3) -> DataFrame:
    """subject_id, face_id, rank: the thumbnail first if it is still theirs, then the lowest ids."""
    own = faces.join(subjects.select(F.col("id").alias("subject_id"), "thumbnail_face_id"), "subject_id")
    order = Window.partitionBy("subject_id").orderBy(F.col("id").eqNullSafe(F.col("thumbnail_face_id")).desc(), "id")
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("subject_id", F.col("id").alias("face_id"), "rank")
