"""Where drawings lie: rows or columns by their lengths, and the nearest place that is shown.

All steps are as-of lookups by windows within a sheet, so points and places meet in one shuffle and no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def starts(sizes: DataFrame) -> DataFrame:
    """sheet_id, at, size, start: the lengths of all places before each. sizes: sheet_id, at, size."""
    before = Window.partitionBy("sheet_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))


def located(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """sheet_id, point, x, at, inside: the place that holds each x (the last one beyond the end) and how far x lies in it. points:
    sheet_id, point, x. Places of no length hold nothing."""
    edges = starts(sizes).where("size > 0").select("sheet_id", F.lit(None).cast("long").alias("point"), F.col("start").alias("x"), "at", "start")
    both = points.select("sheet_id", "point", "x", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("start")).unionByName(edges.select("sheet_id", "point", "x", F.col("at").cast("long").alias("at"), F.col("start").cast("long").alias("start")))
    upto = Window.partitionBy("sheet_id").orderBy(F.col("x"), F.col("at").isNull(), "point").rowsBetween(Window.unboundedPreceding, 0)
    found = both.select("sheet_id", "point", "x", F.last("at", True).over(upto).alias("at"), F.last("start", True).over(upto).alias("start"))
    return found.where("point is not null").select("sheet_id", "point", "x", "at", (F.col("x") - F.col("start")).alias("inside"))


def nearest_shown(points: DataFrame, shown: DataFrame) -> DataFrame:
    """sheet_id, x, near: the shown place next to each x, of two as near the lower one; null where a sheet shows none. points:
    sheet_id, x; shown: sheet_id, at."""
    both = points.select("sheet_id", "x", F.lit(None).cast("long").alias("at")).distinct().unionByName(shown.select("sheet_id", F.col("at").alias("x"), F.col("at").cast("long").alias("at")).distinct())
    order = Window.partitionBy("sheet_id").orderBy("x", F.col("at").isNull())
    below = F.last("at", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first("at", True).over(Window.partitionBy("sheet_id").orderBy("x", F.col("at").isNotNull()).rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumn("below", below).withColumn("above", above).where("at is null")
    near = F.when(F.col("below").isNull() | (F.col("above") - F.col("x") < F.col("x") - F.col("below")), F.col("above")).otherwise(F.col("below"))
    return found.select("sheet_id", "x", near.alias("near"))
