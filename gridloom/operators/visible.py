"""Hidden rows and columns: cells and regions in the coordinates of what a sheet shows.

A place loses the hidden ones before it; all windows are within a sheet. hidden: sheet_id, at, one row for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def places(used: DataFrame, hidden: DataFrame) -> DataFrame:
    """sheet_id, at, off (is hidden), before (hidden places before it) of used places (sheet_id, at)."""
    marks = used.select("sheet_id", "at", F.lit(0).alias("off"), F.lit(1).alias("used")).unionByName(hidden.select("sheet_id", "at", F.lit(1).alias("off"), F.lit(0).alias("used")))
    one = marks.groupBy("sheet_id", "at").agg(F.max("off").alias("off"), F.max("used").alias("used"))
    upto = F.sum("off").over(Window.partitionBy("sheet_id").orderBy("at"))
    return one.withColumn("before", upto - F.col("off")).where("used = 1").select("sheet_id", "at", "off", "before")


def visible_cells(cells: DataFrame, hidden_rows: DataFrame, hidden_columns: DataFrame) -> DataFrame:
    """sheet_id, r, c, v of the cells that are shown."""
    for axis, hidden in (("r", hidden_rows), ("c", hidden_columns)):
        at = places(cells.select("sheet_id", F.col(axis).alias("at")).distinct(), hidden).where("off = 0")
        cells = cells.join(at.select("sheet_id", F.col("at").alias(axis), "before"), ["sheet_id", axis]).withColumn(axis, F.col(axis) - F.col("before")).drop("before")
    return cells.select("sheet_id", "r", "c", "v")


def visible_merges(merges: DataFrame, hidden_rows: DataFrame, hidden_columns: DataFrame) -> DataFrame:
    """sheet_id, ord, r0, r1, c0, c1 of the regions' shown parts; those without any are left out."""
    for axis, hidden in (("r", hidden_rows), ("c", hidden_columns)):
        first, last = f"{axis}0", f"{axis}1"
        at = places(merges.select("sheet_id", F.explode(F.array(first, last)).alias("at")).distinct(), hidden)
        low = at.select("sheet_id", F.col("at").alias(first), F.col("before").alias("lost0"))
        high = at.select("sheet_id", F.col("at").alias(last), (F.col("before") + F.col("off")).alias("lost1"))
        merges = merges.join(low, ["sheet_id", first]).join(high, ["sheet_id", last])
        merges = merges.withColumn(first, F.col(first) - F.col("lost0")).withColumn(last, F.col(last) - F.col("lost1")).where(F.col(first) <= F.col(last)).drop("lost0", "lost1")
    return merges.select("sheet_id", "ord", "r0", "r1", "c0", "c1")
