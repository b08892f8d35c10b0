"""Segmentation of sheets by gaps: row bands, column stripes, segments, and their order.

cells: sheet_id, r, c, v with non-blank values only. All windows are within a sheet, which a spreadsheet's size bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _islands(rows: DataFrame, keys: list[str], at: str, least: int, name: str) -> DataFrame:
    """Numbers the runs of `at` (from 0) that `least` or more missing values separate."""
    w = Window.partitionBy(*keys).orderBy(at)
    starts = F.coalesce((F.col(at) - F.lag(at).over(w) - 1 >= least).cast("int"), F.lit(0))
    return rows.withColumn("__s", starts).withColumn(name, F.sum("__s").over(w)).drop("__s")


def row_bands(cells: DataFrame, blank_rows: int = 2) -> DataFrame:
    """sheet_id, r, band."""
    return _islands(cells.select("sheet_id", "r").distinct(), ["sheet_id"], "r", blank_rows, "band")


def column_stripes(banded: DataFrame) -> DataFrame:
    """sheet_id, band, c, stripe of cells that have a band."""
    return _islands(banded.select("sheet_id", "band", "c").distinct(), ["sheet_id", "band"], "c", 1, "stripe")


def three_level(cells: DataFrame, blank_rows: int = 2, stripe_rows: int = 2) -> DataFrame:
    """sheet_id, seg_ord, r0, r1, c0, c1, n_cells, gap of the segments, by band, stripe and rows of a stripe.

    r1 is the last non-blank row. gap: blank rows before it within the stripe (for a stripe's first segment, from the band's
    start); a band's first segment without any takes the blank rows since the previous band.
    """
    bands = row_bands(cells, blank_rows)
    with_band = cells.select("sheet_id", "r", "c").join(bands, ["sheet_id", "r"])
    placed = with_band.join(column_stripes(with_band), ["sheet_id", "band", "c"])
    keys = ["sheet_id", "band", "stripe"]
    parts = _islands(placed.groupBy(*keys, "r").agg(F.count("*").alias("n"), F.min("c").alias("a"), F.max("c").alias("b")), keys, "r", stripe_rows, "part")
    segs = parts.groupBy(*keys, "part").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n_cells"))
    stripe = Window.partitionBy(*keys)
    segs = segs.withColumn("c0", F.min("a").over(stripe)).withColumn("c1", F.max("b").over(stripe))
    band = Window.partitionBy("sheet_id", "band")
    segs = segs.withColumn("b0", F.min("r0").over(band)).withColumn("b1", F.max("r1").over(band))
    before = F.lag("r1").over(Window.partitionBy(*keys).orderBy("part"))
    own = F.col("r0") - F.coalesce(before + 1, F.col("b0"))
    ends = bands.groupBy("sheet_id", "band").agg(F.min("r").alias("first"), F.max("r").alias("last"))
    by_band = Window.partitionBy("sheet_id").orderBy("band")
    # a band keeps up to blank_rows - 1 of the blank rows behind it
    between = F.coalesce(F.col("first") - F.lag("last").over(by_band) - blank_rows, F.col("first"))
    segs = segs.join(ends.select("sheet_id", "band", between.alias("between")), ["sheet_id", "band"])
    order = Window.partitionBy("sheet_id").orderBy("band", "stripe", "part")
    lead = (F.row_number().over(Window.partitionBy("sheet_id", "band").orderBy("stripe", "part")) == 1) & (own == 0)
    gap = F.when(lead, F.col("between")).otherwise(own)
    return segs.select("sheet_id", (F.row_number().over(order) - 1).alias("seg_ord"), "r0", "r1", "c0", "c1", "n_cells", gap.alias("gap"))


def deferred_order(segments: DataFrame, least: int = 2) -> DataFrame:
    """segments with deferred and out_ord: blocks behind a large gap that no close block follows come last."""
    w = Window.partitionBy("sheet_id").orderBy("seg_ord")
    candidate = F.col("gap") >= least
    deferred = candidate & F.coalesce(F.lead(candidate).over(w), F.lit(True))
    out = segments.withColumn("deferred", deferred)
    return out.withColumn("out_ord", F.row_number().over(Window.partitionBy("sheet_id").orderBy("deferred", "seg_ord")) - 1)


def isolated_cells(cells: DataFrame) -> DataFrame:
    """Cells alone in their row whose neighbouring rows are blank or missing."""
    rows = cells.groupBy("sheet_id", "r").agg(F.count("*").alias("n"), F.min_by("c", "c").alias("c"), F.min_by("v", "c").alias("v"))
    w = Window.partitionBy("sheet_id").orderBy("r")
    alone = (F.col("n") == 1) & F.coalesce(F.lag("r").over(w) < F.col("r") - 1, F.lit(True)) & F.coalesce(F.lead("r").over(w) > F.col("r") + 1, F.lit(True))
    return rows.withColumn("alone", alone).where("alone").select("sheet_id", "r", "c", "v")


def header_row(cells: DataFrame) -> DataFrame:
    """sheet_id, header_row: the first row with a non-blank cell."""
    return cells.groupBy("sheet_id").agg(F.min("r").alias("header_row"))
