"""Relations of cells from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _place(key: str) -> tuple[Column, Column]:
    """Sheet and row of an order: blank rows lie behind every third and every fifth order of a sheet, two behind each 15th."""
    i = F.col(key) % 100
    return F.expr(f"{key} div 100"), i + F.floor(i / 3) + F.floor(i / 5)


def whole_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells of sheets of 100 orders: every line item is a cell, a blank column lies behind every third one of an order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("i", F.row_number().over(order) - 1)
    sheet, r = _place("l_orderkey")
    c = F.col("i") + F.floor(F.col("i") / 3)
    return items.select(sheet.alias("sheet_id"), r.alias("r"), c.cast("long").alias("c"), F.col("l_quantity").cast("int").cast("string").alias("v"))


def all_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """merges of those sheets: every order is a region of up to five columns that takes in a single blank row behind it for
    odd customers. No two overlap."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    sheet, r = _place("o_orderkey")
    after, c0 = (F.col("o_orderkey") % 100 + 1), F.col("o_custkey") % 3
    blank = ((after % 3 == 0) | (after % 5 == 0)).cast("long")
    return orders.select(
        sheet.alias("sheet_id"), F.col("o_orderkey").alias("ord"), r.alias("r0"), (r + blank * (F.col("o_custkey") % 2)).alias("r1"),
        c0.alias("c0"), (c0 + F.col("o_custkey") % 5).alias("c1"),
    )
