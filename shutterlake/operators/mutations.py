"""Changes to the catalog, each a function from tables to tables.

Plain Parquet has no row updates, so a change is a new snapshot of the tables it
touches; `Snapshots.commit` publishes several of them at once. New ids start
after a table's largest, in a stated order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric, text
from .listing import live
from .relations import not_queued, representatives, thumbnail_fills, thumbnail_upgrades, without_faces

PIPELINES = ("semantic", "subject")


def set_where(df: DataFrame, condition: Column, **values) -> DataFrame:
    """df with columns set in the rows of a condition."""
    return df.withColumns({c: F.when(condition, v if isinstance(v, Column) else F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def keyed_update(df: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with columns from the row of new with the same key, where there is one."""
    fresh = new.select(key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    rows = df.join(fresh, key, "left")
    return rows.select(*(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def upsert(df: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    return df.join(new.select(*key), list(key), "left_anti").select(*df.columns).unionByName(new.select(*df.columns))


def insert_ignore(df: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """df with the rows of new whose key it lacks; of equal new keys one."""
    fresh = new.join(df.select(*key), list(key), "left_anti").dropDuplicates(list(key))
    return df.unionByName(fresh.select(*df.columns))


def insert(df: DataFrame, new: DataFrame, *order: Column) -> DataFrame:
    """df with rows without ids, numbered in order after the largest id."""
    last = df.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    numbered = new.withColumn("n", F.row_number().over(Window.orderBy(*order))).withColumn("one", F.lit(1)).join(F.broadcast(last.withColumn("one", F.lit(1))), "one")
    rows = numbered.withColumn("id", F.col("last") + F.col("n"))
    return df.unionByName(rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns)))


def add_folder(folders: DataFrame, path: str, now: int) -> DataFrame:
    """A folder is added once for a path."""
    new = folders.sparkSession.createDataFrame([(path, now)], "path string, added_at long")
    return insert(folders, new.join(folders.select("path"), "path", "left_anti"), F.col("path"))


def create_tag(tags: DataFrame, name: str, now: int) -> DataFrame:
    name = name.strip()
    if not name:
        raise ValueError("a tag needs a name")
    new = tags.sparkSession.createDataFrame([(name, text.fold(name), now)], "name string, name_normalized string, added_at long")
    return insert(tags, new.join(tags.select("name_normalized"), "name_normalized", "left_anti"), F.col("name"))


def rename_tag(tags: DataFrame, tag_id: int, name: str) -> DataFrame:
    name = name.strip()
    if not name:
        raise ValueError("a tag needs a name")
    if not tags.where((F.col("name_normalized") == text.fold(name)) & (F.col("id") != tag_id)).isEmpty():
        raise ValueError(f"there is another tag named {name}")
    return set_where(tags, F.col("id") == tag_id, name=name, name_normalized=text.fold(name))


def delete_tag(tags: DataFrame, subject_tags: DataFrame, tag_id: int) -> tuple[DataFrame, DataFrame]:
    return tags.where(F.col("id") != tag_id), subject_tags.where(F.col("tag_id") != tag_id)


def unlink_tag(subject_tags: DataFrame, subject_id: int, tag_id: int) -> DataFrame:
    return subject_tags.where(~((F.col("subject_id") == subject_id) & (F.col("tag_id") == tag_id)))


def delete_folder(folder_id: int, t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left of folders, images, queue, faces, face_vectors, edges,
    constraints, subjects (thumbnails unlinked; then every subject without a face
    goes, whether or not it had one before)."""
    own = t["images"].where(F.col("folder_id") == folder_id).select(F.col("id").alias("image_id"))
    faces = t["faces"].join(own, "image_id", "left_anti").select(*t["faces"].columns)
    gone = t["faces"].join(own, "image_id", "left_semi").select("id")
    out = {"folders": t["folders"].where(F.col("id") != folder_id), "images": t["images"].where(F.col("folder_id") != folder_id), "faces": faces}
    for name in ("queue",):
        if name in t:
            out[name] = t[name].join(own, "image_id", "left_anti").select(*t[name].columns)
    if "face_vectors" in t:
        out["face_vectors"] = t["face_vectors"].join(gone, "id", "left_anti")
    for name in ("edges", "constraints"):
        if name in t:
            out[name] = t[name].join(gone.select(F.col("id").alias("face_a")), "face_a", "left_anti").join(gone.select(F.col("id").alias("face_b")), "face_b", "left_anti").select(*t[name].columns)
    linked = t["subjects"].join(gone.select(F.col("id").alias("thumbnail_face_id"), F.lit(True).alias("lost")), "thumbnail_face_id", "left")
    subjects = linked.withColumn("thumbnail_face_id", F.when(F.col("lost"), F.lit(None)).otherwise(F.col("thumbnail_face_id"))).select(*t["subjects"].columns)
    out["subjects"] = subjects.join(faces.where("subject_id is not null").select(F.col("subject_id").alias("id")), "id", "left_semi").select(*t["subjects"].columns)
    return out


def soft_delete(images: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Marks live images; the mark of deleted ones stays."""
    hit = images.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumn("deleted_at", F.when(F.col("_hit") & F.col("deleted_at").isNull(), F.lit(now)).otherwise(F.col("deleted_at"))).select(*images.columns)


def undelete(images: DataFrame, ids: DataFrame) -> DataFrame:
    hit = images.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumn("deleted_at", F.when(F.col("_hit"), F.lit(None)).otherwise(F.col("deleted_at"))).select(*images.columns)


def changes(listing: DataFrame, images: DataFrame) -> DataFrame:
    """path, id, action of a directory listing (path, size, mtime, content hash)
    against the catalog, deleted rows included: new, unchanged, undelete,
    touched (same content), failed (unreadable), modified, delete, gone.

    Size and time decide; the hash only tells touched from modified."""
    disk = listing.select("path", F.col("size").alias("disk_size"), F.col("mtime").alias("disk_mtime"), F.col("hash").alias("disk_hash"), F.lit(True).alias("on_disk"))
    known = images.select("path", "id", "file_size", "mtime", "file_hash", "deleted_at")
    rows = known.join(disk, "path", "full_outer")
    same = (F.col("file_size") == F.col("disk_size")) & (F.col("mtime") == F.col("disk_mtime"))
    action = (
        F.when(F.col("id").isNull(), F.lit("new"))
        .when(F.col("on_disk").isNull(), F.when(F.col("deleted_at").isNull(), F.lit("delete")).otherwise(F.lit("gone")))
        .when(same, F.when(F.col("deleted_at").isNull(), F.lit("unchanged")).otherwise(F.lit("undelete")))
        .when(F.col("disk_hash").isNull(), F.lit("failed"))
        .when(F.col("disk_hash") == F.col("file_hash"), F.lit("touched"))
        .otherwise(F.lit("modified"))
    )
    return rows.select("path", "id", action.alias("action"), "disk_size", "disk_mtime", "disk_hash")


def apply_changes(images: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """The catalog after changes(): times and sizes follow the disk, a modified
    image loses its analysis and previews, vanished ones are marked."""
    rows = images.join(found.where("id is not null").select("id", "action", "disk_size", "disk_mtime", "disk_hash"), "id", "left")
    act, moved = F.col("action"), F.col("action").isin("touched", "modified", "failed")
    new = {
        "file_size": F.when(moved, F.col("disk_size")),
        "mtime": F.when(moved, F.col("disk_mtime")),
        "file_hash": F.when(act == "modified", F.col("disk_hash")),
        "hash_status": F.when(act == "modified", F.lit("DONE")).when(act == "failed", F.lit("FAILED")),
        "semantic_analysis_done": F.when(act == "modified", F.lit(False)),
        "subject_analysis_done": F.when(act == "modified", F.lit(False)),
        "updated_at": F.when(moved, F.lit(now)),
    }
    rows = rows.withColumns({c: F.coalesce(v, F.col(c)) for c, v in new.items() if c in images.columns})
    cleared = [c for c in ("thumbnail_path", "preview_path", "embedding") if c in images.columns]
    rows = rows.withColumns({c: F.when(~F.coalesce(act == "modified", F.lit(False)), F.col(c)) for c in cleared})
    back = act.isin("undelete", "touched", "modified")
    rows = rows.withColumn("deleted_at", F.when(act == "delete", F.lit(now)).when(~F.coalesce(back, F.lit(False)), F.col("deleted_at")))
    return rows.select(*images.columns)


def apply_hashes(images: DataFrame, results: DataFrame) -> DataFrame:
    """Results (id, mtime, hash) of a batch: a hash is done, none is failed, and
    one for another mtime is dropped."""
    new = results.select("id", F.col("mtime").alias("_mtime"), F.col("hash").alias("_hash"), F.lit(True).alias("_hit"))
    rows = images.join(new, "id", "left")
    ok = F.coalesce(F.col("_hit") & (F.col("_mtime") == F.col("mtime")), F.lit(False))
    rows = rows.withColumn("hash_status", F.when(ok, F.when(F.col("_hash").isNotNull(), F.lit("DONE")).otherwise(F.lit("FAILED"))).otherwise(F.col("hash_status")))
    return rows.withColumn("file_hash", F.when(ok & F.col("_hash").isNotNull(), F.col("_hash")).otherwise(F.col("file_hash"))).select(*images.columns)


def enqueued(queue: DataFrame, ids: DataFrame, now: int, pipelines: tuple[str, ...] = PIPELINES) -> DataFrame:
    """image_id, pipeline, attempts, scheduled_at after images (image_id) are put
    in anew, their attempts forgotten."""
    ids = ids.select("image_id").distinct()
    rest = queue.join(ids, "image_id", "left_anti").select("image_id", "pipeline", "attempts", "scheduled_at")
    fresh = ids.select("image_id", F.explode(F.array(*(F.lit(p) for p in pipelines))).alias("pipeline"), F.lit(0).alias("attempts"), F.lit(now).cast("long").alias("scheduled_at"))
    return rest.unionByName(fresh)


def failed(queue: DataFrame, failures: DataFrame, now: int) -> DataFrame:
    """The queue after failures (image_id, pipeline): tried again later, or given
    up and taken out after the last attempt."""
    rows = queue.join(failures.select("image_id", "pipeline", F.lit(True).alias("_hit")), ["image_id", "pipeline"], "left")
    wait = numeric.retry_wait(F.col("attempts"))
    rows = rows.where(F.col("_hit").isNull() | wait.isNotNull())
    rows = rows.withColumn("scheduled_at", F.when(F.col("_hit"), F.lit(now) + wait).otherwise(F.col("scheduled_at")))
    return rows.withColumn("attempts", F.when(F.col("_hit"), F.col("attempts") + 1).otherwise(F.col("attempts"))).select(*queue.columns)


def done(images: DataFrame, queue: DataFrame, finished: DataFrame, pipeline: str) -> tuple[DataFrame, DataFrame]:
    """Flags finished images (image_id) and takes them out of the queue."""
    ids = finished.select("image_id").distinct()
    flag = f"{pipeline}_analysis_done"
    hit = images.join(ids.select(F.col("image_id").alias("id"), F.lit(True).alias("_hit")), "id", "left")
    images = hit.withColumn(flag, F.coalesce(F.col("_hit"), F.col(flag))).select(*images.columns)
    rest = queue.join(ids.withColumn("pipeline", F.lit(pipeline)), ["image_id", "pipeline"], "left_anti").select(*queue.columns)
    return images, rest


def reset_embeddings(images: DataFrame, queue: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """After a change of the image model: every live image is queued in both pipelines."""
    cleared = set_where(images, F.col("deleted_at").isNull(), semantic_analysis_done=False, subject_analysis_done=False)
    return cleared, enqueued(queue.where(F.lit(False)), live(images).select(F.col("id").alias("image_id")), now)


def stale_subjects(images: DataFrame, queue: DataFrame, now: int) -> dict[str, DataFrame]:
    """After a change of the face model: images are analysed again for faces;
    edges and suggestions are cleared, faces and constraints kept."""
    waiting = not_queued(images, queue, "subject").select(F.col("id").alias("image_id"), F.lit("subject").alias("pipeline"), F.lit(0).alias("attempts"), F.lit(now).cast("long").alias("scheduled_at"))
    flagged = set_where(images, F.col("deleted_at").isNull(), subject_analysis_done=False)
    return {"images": flagged, "queue": queue.select("image_id", "pipeline", "attempts", "scheduled_at").unionByName(waiting)}


def cleared(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def linked(constraints: DataFrame, pairs: DataFrame, kind: str, source: str, now: int) -> DataFrame:
    """constraints with pairs (x, y) in order, each once for a kind; no face with itself."""
    new = pairs.where("x <> y").select(F.least("x", "y").alias("face_a"), F.greatest("x", "y").alias("face_b"), F.lit(kind).alias("kind"), F.lit(source).alias("source"), F.lit(now).cast("long").alias("created_at"))
    return insert_ignore(constraints, new, "face_a", "face_b", "kind")


#: Pairs of faces are made in cells of SIDE by SIDE, dealt to CELL_TASKS tasks.
SIDE, CELL_TASKS = 32, 256


def merge_linked(constraints: DataFrame, faces: DataFrame, a: int, b: int, now: int) -> DataFrame:
    """constraints with a must-link of each face of one subject with each of
    another, as linked() gives it.

    Faces are told apart before they are paired, so the pairs, of which there may
    be very many, are neither sorted nor moved: only those of faces that have
    must-links already are held against these."""
    mine = lambda s: F.max(F.col("subject_id") == s)
    members = faces.where(F.col("subject_id").isin(a, b)).groupBy("id").agg(mine(a).alias("in_a"), mine(b).alias("in_b"))
    held = constraints.where("kind = 'must_link'")
    known = held.select(F.explode(F.array("face_a", "face_b")).alias("id")).distinct().withColumn("known", F.lit(True))
    row, column = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(SIDE)).cast("int") for seed in (1, 2))
    every = F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1)))
    cell = lambda df: df.withColumn("cell", F.col("row") * SIDE + F.col("column")).drop("row", "column").repartition(CELL_TASKS, "cell")
    x = members.where("in_a").join(known, "id", "left").select(F.col("id").alias("x"), F.col("in_b").alias("x_too"), F.coalesce("known", F.lit(False)).alias("known"), row.alias("row"), every.alias("column"))
    y = members.where("in_b").select(F.col("id").alias("y"), F.col("in_a").alias("y_too"), column.alias("column"), every.alias("row"))
    pairs = cell(x).join(cell(y), "cell").where("x <> y and not (x_too and y_too and x > y)")
    pairs = pairs.select(F.least("x", "y").alias("face_a"), F.greatest("x", "y").alias("face_b"), "known")
    fresh = pairs.where("not known").drop("known").unionByName(pairs.where("known").drop("known").join(held.select("face_a", "face_b"), ["face_a", "face_b"], "left_anti"))
    fresh = fresh.withColumns({"kind": F.lit("must_link"), "source": F.lit("merge"), "created_at": F.lit(now).cast("long")})
    return constraints.unionByName(fresh.select(*constraints.columns))


def merge_subjects(t: dict[str, DataFrame], target: int, source: int, now: int) -> dict[str, DataFrame]:
    """source goes into target: its name is taken if target has none, faces and
    tags move, all their faces must stay together, suggestions of either go."""
    out = dict(t)
    out["constraints"] = merge_linked(t["constraints"], t["faces"], target, source, now)
    names = t["subjects"].where(F.col("id") == source).select(F.lit(target).cast("long").alias("id"), F.col("name").alias("_name"))
    kept = t["subjects"].where(F.col("id") != source).join(names, "id", "left")
    subjects = kept.withColumn("name", F.coalesce("name", "_name")).select(*t["subjects"].columns)
    out["faces"] = set_where(t["faces"], F.col("subject_id") == source, subject_id=target)
    mine = t["subject_tags"].where(F.col("subject_id") != source)
    moved = t["subject_tags"].where(F.col("subject_id") == source).withColumn("subject_id", F.lit(target).cast("long"))
    out["subject_tags"] = insert_ignore(mine, moved, "subject_id", "tag_id")
    pair = [target, source]
    out["merge_suggestions"] = t["merge_suggestions"].where(~F.col("subject_id_a").isin(pair) & ~F.col("subject_id_b").isin(pair))
    out["subjects"] = with_thumbnails(subjects, out["faces"])
    return out


def with_thumbnails(subjects: DataFrame, faces: DataFrame, upgrade: bool = False) -> DataFrame:
    """Subjects with their best face where they have no thumbnail, or a worse one."""
    new = (thumbnail_upgrades if upgrade else thumbnail_fills)(subjects, faces).select("id", F.col("face_id").alias("thumbnail_face_id"))
    return keyed_update(subjects, new, "id", ["thumbnail_face_id"])


def dismiss(t: dict[str, DataFrame], a: int, b: int, now: int) -> dict[str, DataFrame]:
    """A dismissed suggestion: the pair is noted, up to three faces of each must
    not be joined, the suggestion goes."""
    out, (lo, hi) = dict(t), sorted((a, b))
    spark = t["subjects"].sparkSession
    pair = spark.createDataFrame([(lo, hi, now)], "subject_id_a long, subject_id_b long, dismissed_at long")
    out["dismissed_pairs"] = insert_ignore(t["dismissed_pairs"], pair, "subject_id_a", "subject_id_b")
    three = representatives(t["subjects"], t["faces"])
    x = three.where(F.col("subject_id") == lo).select(F.col("face_id").alias("x"), F.lit(1).alias("one"))
    y = three.where(F.col("subject_id") == hi).select(F.col("face_id").alias("y"), F.lit(1).alias("one"))
    out["constraints"] = linked(t["constraints"], x.join(y, "one").select("x", "y"), "cannot_link", "dismiss", now)
    same = (F.least("subject_id_a", "subject_id_b") == lo) & (F.greatest("subject_id_a", "subject_id_b") == hi)
    out["merge_suggestions"] = t["merge_suggestions"].where(~same)
    return out


def assign_face(faces: DataFrame, constraints: DataFrame, face_id: int, subject_id: int, now: int) -> tuple[DataFrame, DataFrame]:
    members = faces.where(F.col("subject_id") == subject_id).select(F.col("id").alias("x"), F.lit(face_id).cast("long").alias("y"))
    return set_where(faces, F.col("id") == face_id, subject_id=subject_id), linked(constraints, members, "must_link", "manual_assign", now)


def unassign_face(t: dict[str, DataFrame], face_id: int, now: int) -> dict[str, DataFrame]:
    """The face must not be joined with its siblings again; thumbnails are filled
    and subjects without faces go."""
    out = dict(t)
    own = t["faces"].where(F.col("id") == face_id).select("subject_id")
    siblings = t["faces"].join(own, "subject_id", "left_semi").where(F.col("id") != face_id)
    out["constraints"] = linked(t["constraints"], siblings.select(F.col("id").alias("x"), F.lit(face_id).cast("long").alias("y")), "cannot_link", "removal", now)
    out["faces"] = set_where(t["faces"], F.col("id") == face_id, subject_id=None)
    subjects = t["subjects"].join(without_faces(t["subjects"], out["faces"]).select("id"), "id", "left_anti")
    out["subjects"] = with_thumbnails(subjects, out["faces"])
    return out


def create_subject(subjects: DataFrame, faces: DataFrame, face_id: int, now: int) -> tuple[DataFrame, DataFrame]:
    new = faces.where(F.col("id") == face_id).select(F.col("id").alias("thumbnail_face_id"), F.lit("person").alias("type"), F.lit(now).cast("long").alias("added_at"))
    grown = insert(subjects, new, F.col("thumbnail_face_id"))
    made = grown.join(subjects.select("id"), "id", "left_anti").select("thumbnail_face_id", F.col("id").alias("subject_id"))
    return grown, keyed_update(faces, made.select(F.col("thumbnail_face_id").alias("id"), "subject_id"), "id", ["subject_id"])


def apply_labels(clusters: DataFrame, actions: DataFrame, faces: DataFrame, subjects: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """faces and subjects after label_actions(): unlabelled faces go to the one
    subject of their cluster, or to a new one, numbered by the clusters' ids."""
    last = subjects.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).withColumn("one", F.lit(1))
    new = actions.where("action = 'new_subject'").withColumn("n", F.row_number().over(Window.orderBy("cluster"))).withColumn("one", F.lit(1)).join(F.broadcast(last), "one")
    new = new.select("cluster", (F.col("last") + F.col("n")).alias("subject_id"))
    aim = actions.where("action = 'assign_all'").select("cluster", "subject_id").unionByName(new)
    given = clusters.select("id", "cluster").join(aim, "cluster").select("id", "subject_id")
    open_ = faces.where("subject_id is null").select("id").join(given, "id")
    made = new.select(F.col("subject_id").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("thumbnail_face_id"), F.lit("person").alias("type"), F.lit(now).cast("long").alias("added_at"))
    return keyed_update(faces, open_, "id", ["subject_id"]), subjects.unionByName(made.select(*subjects.columns))


def set_thumbnail(subjects: DataFrame, faces: DataFrame, subject_id: int, face_id: int) -> DataFrame:
    if faces.where((F.col("id") == face_id) & (F.col("subject_id") == subject_id)).isEmpty():
        raise ValueError(f"face {face_id} is not of subject {subject_id}")
    return set_where(subjects, F.col("id") == subject_id, thumbnail_face_id=face_id)


def save_report(reports: DataFrame, report_tags: DataFrame, name: str, folder_id: int, tag_ids: list[int], now: int) -> tuple[DataFrame, DataFrame]:
    """Tag ids are kept once, in order of first occurrence (pos)."""
    if not name.strip():
        raise ValueError("a report needs a name")
    spark = reports.sparkSession
    grown = insert(reports, spark.createDataFrame([(name.strip(), folder_id, now)], "name string, folder_id long, added_at long"), F.col("name"))
    own = grown.join(reports.select("id"), "id", "left_anti").select(F.col("id").alias("report_id"))
    ids = F.array_distinct(F.array(*(F.lit(t).cast("long") for t in tag_ids))) if tag_ids else F.array().cast("array<bigint>")
    return grown, report_tags.unionByName(own.select("report_id", F.posexplode(ids).alias("pos", "tag_id")))


def delete_report(reports: DataFrame, report_tags: DataFrame, report_id: int) -> tuple[DataFrame, DataFrame]:
    return reports.where(F.col("id") != report_id), report_tags.where(F.col("report_id") != report_id)


def rename_report(reports: DataFrame, report_id: int, name: str) -> DataFrame:
    if not name.strip():
        raise ValueError("a report needs a name")
    return set_where(reports, F.col("id") == report_id, name=name.strip())


def delete_faces(faces: DataFrame, vectors: DataFrame, edges: DataFrame, constraints: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    ids = ids.select("id")
    pairs = lambda df: df.join(ids.select(F.col("id").alias("face_a")), "face_a", "left_anti").join(ids.select(F.col("id").alias("face_b")), "face_b", "left_anti").select(*df.columns)
    return {"faces": faces.join(ids, "id", "left_anti"), "face_vectors": vectors.join(ids, "id", "left_anti"), "edges": pairs(edges), "constraints": pairs(constraints)}


def setting(settings: DataFrame, key: str, default: str) -> DataFrame:
    """One row: the value, or the default where there is none."""
    found = settings.where(F.col("key") == key).agg(F.max("value").alias("value"))
    return found.select(F.lit(key).alias("key"), F.coalesce("value", F.lit(default)).alias("value"))
