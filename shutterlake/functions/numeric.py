"""Scalar rules: geometry, quality, queues, time labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MAX_ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 7, 5, 120
SHARPNESS_KNEE = 500.0
QUALITY_WEIGHTS = (0.40, 0.35, 0.25)  # detection, frontality, sharpness
CROP_SCALE = 1.8


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Intersection over union of two (x, y, w, h) boxes; 0 for empty or touching ones."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    w = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    h = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    union = aw * ah + bw * bh - w * h
    return F.when((w <= 0) | (h <= 0) | (union <= 0), F.lit(0.0)).otherwise(w * h / union)


def box(prefix: str = "bbox_") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + c) for c in "xywh")


def l2_to_cosine(distance: Column) -> Column:
    """Of unit vectors."""
    return 1 - distance * distance / 2


def frontality(landmarks: Column) -> Column:
    """Of array<struct<x,y>>: left eye, right eye, nose, corners of the mouth.
    One half is how level the eyes are (the cosine of their line), the other how
    near the nose is to their middle. 0.5 unless there are five."""
    left, right, nose = (F.get(landmarks, F.lit(i)) for i in range(3))
    dx, dy = right["x"] - left["x"], right["y"] - left["y"]
    apart = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-6))
    level = clamp(F.abs(dx / apart))
    ahead = clamp(1 - F.abs(nose["x"] - (left["x"] + right["x"]) / 2) / (apart / 2))
    return F.when(landmarks.isNull() | (F.size(landmarks) != 5), F.lit(0.5)).otherwise(0.5 * level + 0.5 * ahead)


def sharpness(variance: Column) -> Column:
    return variance / (variance + SHARPNESS_KNEE)


def quality(detection: Column, front: Column, sharp: Column) -> Column:
    w = QUALITY_WEIGHTS
    return clamp(w[0] * clamp(detection) + w[1] * clamp(front) + w[2] * clamp(sharp))


def retry_wait(attempts: Column) -> Column:
    """Seconds to the next try after one more failure; null once it is given up."""
    a = attempts + 1
    return F.when(a < MAX_ATTEMPTS, F.least(F.lit(FIRST_WAIT) * F.pow(F.lit(2), F.least(a - 1, F.lit(10))), F.lit(LONGEST_WAIT)).cast("long"))


def low_high(a: Column, b: Column) -> tuple[Column, Column]:
    """An unordered pair in order; null if either is, unlike least and greatest."""
    ok = a.isNotNull() & b.isNotNull()
    return F.when(ok, F.least(a, b)), F.when(ok, F.greatest(a, b))


def eta_seconds(pending: Column, rate: Column) -> Column:
    return F.when(rate > 0, F.floor(pending / rate + 0.5)).otherwise(F.lit(0)).cast("long")


def eta_label(seconds: Column) -> Column:
    whole = F.floor(seconds + 0.5).cast("string")
    minutes = F.floor(seconds / 60 + 0.5).cast("long")
    hours, rest = F.floor(minutes / 60).cast("string"), (minutes % 60).cast("string")
    return (
        F.when(seconds.isNull() | (seconds <= 0), F.lit(""))
        .when(seconds < 60, F.concat(F.lit("~"), whole, F.lit("s left")))
        .when(minutes < 60, F.concat(F.lit("~"), minutes.cast("string"), F.lit(" min left")))
        .when(minutes % 60 == 0, F.concat(F.lit("~"), hours, F.lit("h left")))
        .otherwise(F.concat(F.lit("~"), hours, F.lit("h "), rest, F.lit("m left")))
    )


def day_label(day: Column, today: Column) -> Column:
    back = F.datediff(today, day)
    return (
        F.when(back == 0, F.lit("Today"))
        .when(back == 1, F.lit("Yesterday"))
        .when((back < 7) & (back > 1), F.lit("This Week"))
        .when((back < 14) & (back > 1), F.lit("Last Week"))
        .otherwise(F.date_format(day, "MMMM d, yyyy"))
    )


def crop_square(w: Column, h: Column, x: Column, y: Column, image_w: Column, image_h: Column) -> Column:
    """struct<left, top, side> in pixels of the square around a relative box."""
    side = F.greatest(F.least(F.greatest(w * image_w, h * image_h) * CROP_SCALE, image_w.cast("double"), image_h.cast("double")), F.lit(1.0))
    left = clampc((x + w / 2) * image_w - side / 2, image_w - side)
    top = clampc((y + h / 2) * image_h - side / 2, image_h - side)
    whole = lambda c: F.floor(c + 0.5).cast("long")
    return F.struct(whole(left).alias("left"), whole(top).alias("top"), whole(side).alias("side"))


def clampc(c: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(c, high))


def fit_within(w: Column, h: Column, edge: int) -> Column:
    """struct<width, height> scaled to a longest edge, never up."""
    scale = F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest(w, h))
    size = lambda c: F.greatest(F.lit(1), F.floor(c * scale + 0.5)).cast("long")
    return F.struct(size(w).alias("width"), size(h).alias("height"))


def taken(date_taken: Column, mtime: Column) -> Column:
    return F.coalesce(date_taken, mtime)


def preview_workers(pending: Column, idle_seconds: Column, burst: int) -> Column:
    """Burst while much is asked for or something was asked for lately, else a trickle of 2."""
    return F.when((pending > 0) | (idle_seconds < 5), F.lit(burst)).otherwise(F.lit(2))


def stage(semantic: Column, subject: Column) -> Column:
    return F.when(semantic & subject, F.lit("ready")).otherwise(F.lit("pending"))


def pixel(value: Column) -> Column:
    """A byte scaled to -1..1."""
    return (value / F.lit(255.0) - 0.5) / 0.5
