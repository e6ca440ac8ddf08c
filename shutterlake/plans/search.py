"""Search as one lazy plan: pinned hits by tag and name, then vector hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import relations as R
from ..operators import vector as V
from ..operators.listing import cache_hits, live


def first_places(*legs: DataFrame) -> DataFrame:
    """id, leg, pos of legs (id, pos): each id once, at its place in the first leg that has it."""
    all_ = None
    for k, leg in enumerate(legs):
        rows = leg.select("id", F.lit(k).alias("leg"), F.col("pos").cast("long").alias("pos"))
        all_ = rows if all_ is None else all_.unionByName(rows)
    return all_.groupBy("id").agg(F.min(F.struct("leg", "pos")).alias("at")).select("id", "at.leg", "at.pos")


def text_search(images: DataFrame, faces: DataFrame, subjects: DataFrame, subject_tags: DataFrame, tags: DataFrame, index: DataFrame, query: str, vector: list[float] | None) -> DataFrame:
    """id, leg (0 tag, 1 name, 2 vector), pos, score: pinned hits have score 1.
    The cut of the vector hits is found before pinned ones are taken out."""
    tagged = R.images_by_tag(images, faces, subject_tags, tags, query)
    order = Window.orderBy(F.col("subjects").desc(), F.col("newest").desc_nulls_last(), "image_id")
    tag_leg = tagged.select(F.col("image_id").alias("id"), F.row_number().over(order).alias("pos"))
    found = R.search_subjects(subjects, subject_tags, tags, query).select(F.col("id").alias("subject_id"))
    named = faces.join(F.broadcast(found), "subject_id", "left_semi").select(F.col("image_id").alias("id")).distinct()  # 20 subjects at most
    name_leg = named.join(live(images).select("id"), "id", "left_semi").select("id", F.col("id").alias("pos"))
    legs = [tag_leg, name_leg]
    if vector is not None:
        hits = V.hydrated(V.elbow(V.top_k(index, vector)), images)
        legs.append(hits.select("id", F.col("rank").alias("pos"), "score"))
    rows = first_places(*legs)
    if vector is None:
        return rows.withColumn("score", F.lit(1.0))
    scores = legs[2].select("id", F.col("score").alias("own"))
    return rows.join(scores, "id", "left").select("id", "leg", "pos", F.when(F.col("leg") == 2, F.col("own")).otherwise(F.lit(1.0)).alias("score"))


def cached_vector(cache: DataFrame, key: str, now: int) -> list[float] | None:
    """The vector of a query asked lately, or None."""
    row = cache_hits(cache, now, key).select("embedding").first()
    return None if row is None else list(row["embedding"])
