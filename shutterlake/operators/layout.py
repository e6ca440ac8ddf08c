"""Gallery views: day groups, timeline, neighbours, justified rows, work lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .listing import taken


def days(images: DataFrame) -> DataFrame:
    return images.select(F.to_date(F.timestamp_seconds(taken())).alias("day")).distinct()


def _placed(days_: DataFrame) -> DataFrame:
    """Days, newest first, numbered from 1; there are few, whatever the images."""
    return days_.select("day", F.row_number().over(Window.orderBy(F.col("day").desc())).alias("place"), F.count("*").over(Window.partitionBy()).alias("of"))


def markers(days_: DataFrame) -> DataFrame:
    """day, place of the first and last day and of first days of months."""
    return _placed(days_).where((F.col("place") == 1) | (F.col("place") == F.col("of")) | (F.dayofmonth("day") == 1)).select("day", "place")


def at_percent(days_: DataFrame, percent: float) -> DataFrame:
    aim = F.greatest(F.lit(0), F.least(F.floor(F.lit(percent) * F.col("of")), F.col("of") - 1))
    return _placed(days_).where(F.col("place") - 1 == aim).select("day")


def neighbours(rows: DataFrame, *order: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with previous and next id in an order that closes in a circle."""
    w = Window.partitionBy(*by).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("previous", F.coalesce(F.lag("id").over(w), F.last("id").over(whole))).withColumn("next", F.coalesce(F.lead("id").over(w), F.first("id").over(whole)))


#: Least aspect, multiplier and modulus of the stand-in for an image's shape.
ASPECT = (0.8, 54321, 1000)


def aspect(image_id: int) -> float:
    """A stable stand-in for an image's width over its height, 0.8 to 1.8."""
    least, times, of = ASPECT
    return least + (image_id * times % of) / of


def rows_of(ids: list[int], width: float, height: float, gap: float = 4) -> list[tuple[list[int], float]]:
    """ids in rows that fill a width, with the height of each. The last row keeps the wanted height."""
    out: list[tuple[list[int], float]] = []
    row: list[int] = []
    used = 0.0
    for i in ids:
        w = height * aspect(i)
        if row and used + w + gap * len(row) > width:
            out.append((row, (width - gap * (len(row) - 1)) / sum(map(aspect, row))))
            row, used = [], 0.0
        row.append(i)
        used += w
    return [*out, (row, float(height))] if row else out


def justified(images: DataFrame, group: str, width: float, height: float, gap: float = 4) -> DataFrame:
    """group, row, height, ids of images (group, id, taken), newest first in a group. A day's images are one fold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf.sort_values(["taken", "id"], ascending=False)["id"].tolist()
        rows = rows_of(ids, width, height, gap)
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(rows), "row": range(len(rows)), "height": [round(h, 6) for _, h in rows], "ids": [",".join(map(str, r)) for r, _ in rows]}).astype({"row": "int32"})

    return images.groupBy(group).applyInPandas(run, f"{group} string, row int, height double, ids string")


def flattened(images: DataFrame, group: str, collapsed: list[str], width: float, height: float) -> DataFrame:
    """group, row (-1 is the header), n, ids: headers with their number of
    images, and the rows of groups that are not collapsed."""
    headers = images.groupBy(group).agg(F.count("*").alias("n")).select(group, F.lit(-1).alias("row"), "n", F.lit("").alias("ids"))
    rows = justified(images.where(~F.col(group).isin(collapsed)), group, width, height)
    return headers.unionByName(rows.select(group, "row", F.size(F.split("ids", ",")).cast("long").alias("n"), "ids"))


def priorities(requests: DataFrame) -> DataFrame:
    """image_id, priority, place: each image once, with its highest priority, in order of its first request."""
    best = requests.groupBy("image_id").agg(F.max("priority").alias("priority"), F.min("id").alias("seq"))
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.col("priority").desc(), "seq"))).drop("seq")
