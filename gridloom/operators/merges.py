"""Merged regions: their cells, their part in a segment, and the header rows that they span.

cells: sheet_id, r, c, v with non-blank values only. merges: sheet_id, ord, r0, r1, c0, c1, inclusive and 0-based; where
regions overlap, the one with the larger ord counts. All joins are within a sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import cell_ref, meaningful, not_blank


def merged_grid(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """sheet_id, r, c, v: cells with every region's anchor text and markers of what it covers (^ above, < left)."""
    spans = merges.select("*", F.explode(F.sequence("r0", "r1")).alias("r")).select("*", F.explode(F.sequence("c0", "c1")).alias("c"))
    marker = F.concat(F.when(F.col("r") != F.col("r0"), "^").otherwise(""), F.when(F.col("c") != F.col("c0"), "<").otherwise(""))
    covered = spans.groupBy("sheet_id", "r", "c").agg(F.max_by(marker, "ord").alias("marker"))
    both = cells.join(covered, ["sheet_id", "r", "c"], "full")
    value = F.when(F.coalesce("marker", F.lit("")) != "", F.col("marker")).otherwise(F.col("v"))
    return both.select("sheet_id", "r", "c", value.alias("v")).where(not_blank(F.col("v")))


def clipped_merges(segments: DataFrame, merges: DataFrame) -> DataFrame:
    """sheet_id, seg_ord, ord, r0, r1, c0, c1 of each region's part in each segment, from the segment's corner."""
    s, m = segments.alias("s"), merges.alias("m")
    meet = (F.col("s.sheet_id") == F.col("m.sheet_id")) & (F.col("m.r0") <= F.col("s.r1")) & (F.col("m.r1") >= F.col("s.r0")) & (F.col("m.c0") <= F.col("s.c1")) & (F.col("m.c1") >= F.col("s.c0"))

    def part(low: str, high: str) -> list[Column]:
        return [(F.greatest(f"m.{low}", f"s.{low}") - F.col(f"s.{low}")).alias(low), (F.least(f"m.{high}", f"s.{high}") - F.col(f"s.{low}")).alias(high)]

    return s.join(m, meet).select("s.sheet_id", "s.seg_ord", "m.ord", *part("r0", "r1"), *part("c0", "c1"))


def header_rows(grid: DataFrame, merges: DataFrame) -> DataFrame:
    """sheet_id, header_start, header_rows of a merged grid that is one segment.

    The start is the first row with a meaningful value that is no banner before a richer row. A banner has one distinct
    value in a sheet of four columns or more, and is merged from the first column over half of them (four at least), or
    holds 40 characters or a line end. Regions of several rows that cross the start row add all their rows.
    """
    rows = grid.where(meaningful(F.col("v"))).groupBy("sheet_id", "r").agg(F.count("*").alias("n"), F.min("v").alias("v"), (F.min("v") == F.max("v")).alias("one"))
    size = grid.groupBy("sheet_id").agg((F.max("c") + 1).alias("cols"), F.max("r").alias("last"))
    wide = merges.where("r0 = r1 AND c0 = 0").groupBy("sheet_id", F.col("r0").alias("r")).agg((F.max("c1") + 1).alias("span"))
    rows = rows.join(size, "sheet_id").join(wide, ["sheet_id", "r"], "left")
    spans = F.coalesce(F.col("span") >= F.greatest(F.lit(4), F.floor(F.col("cols") / 2)), F.lit(False))
    banner = F.col("one") & (F.col("cols") >= 4) & (spans | (F.length("v") >= 40) | F.contains("v", F.lit("\n")))
    richer = F.coalesce(F.lead("n").over(Window.partitionBy("sheet_id").orderBy("r")) >= F.greatest(F.lit(3), F.col("n") + 2), F.lit(False))
    start = rows.withColumn("skip", banner & richer).where("NOT skip").groupBy("sheet_id").agg(F.min("r").alias("header_start"), F.min("last").alias("last"))
    tall = merges.where("r1 > r0").select("sheet_id", "r0", "r1")
    crossing = start.join(tall, "sheet_id").where("r0 <= header_start AND r1 >= header_start")
    added = crossing.select("sheet_id", F.explode(F.sequence("r0", F.least("r1", "last"))).alias("r"))
    own = start.select("sheet_id", F.col("header_start").alias("r"))
    counts = own.unionByName(added).groupBy("sheet_id").agg(F.count_distinct("r").alias("header_rows"))
    return start.select("sheet_id", "header_start").join(counts, "sheet_id")


def merge_summary(merges: DataFrame) -> DataFrame:
    """sheet_id, ord, cell, row_span, col_span of each region."""
    return merges.select("sheet_id", "ord", cell_ref(F.col("r0"), F.col("c0")).alias("cell"), (F.col("r1") - F.col("r0") + 1).alias("row_span"), (F.col("c1") - F.col("c0") + 1).alias("col_span"))
