"""Segmentation by connected cells: 4-neighbour components, their boxes, and the sweep that merges close boxes.

Rows are first cut to runs of neighbouring cells by windows; only runs go to the grouped map, one sheet a group, which a
spreadsheet's size bounds. There, runs of neighbouring rows that touch are joined by a disjoint-set forest.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.shipping import ship

Box = tuple[int, int, int, int]


def runs(cells: DataFrame) -> DataFrame:
    """sheet_id, r, a, b: maximal runs of cells of a row, from column a to b."""
    w = Window.partitionBy("sheet_id", "r").orderBy("c")
    return cells.withColumn("__k", F.col("c") - F.row_number().over(w)).groupBy("sheet_id", "r", "__k").agg(F.min("c").alias("a"), F.max("c").alias("b")).drop("__k")


def component_boxes(spans: list[tuple[int, int, int]]) -> list[Box]:
    """Boxes (r0, r1, c0, c1) of the components of runs (r, a, b) in row-major order, by each one's first run."""
    parent = list(range(len(spans)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above = 0  # first run that may touch run i from the row above
    for i, (r, a, b) in enumerate(spans):
        while spans[above][0] < r - 1 or (spans[above][0] == r - 1 and spans[above][2] < a):
            above += 1
        k = above
        while spans[k][0] == r - 1 and spans[k][1] <= b:
            x, y = sorted((root(i), root(k)))
            parent[y] = x
            k += 1
    boxes: dict[int, Box] = {}
    for i, (r, a, b) in enumerate(spans):
        r0, _, c0, c1 = boxes.get(k := root(i), (r, r, a, b))
        boxes[k] = (r0, r, min(c0, a), max(c1, b))
    return list(boxes.values())


def swept(boxes: list[Box], gap: int) -> list[Box]:
    """One sweep by first row: a box joins the present one if at most `gap` rows behind it and its columns touch."""
    out: list[Box] = []
    for r0, r1, c0, c1 in sorted(boxes, key=lambda x: x[0]):
        if out and r0 <= out[-1][1] + gap and c0 <= out[-1][3] + 1 and c1 >= out[-1][2] - 1:
            p = out[-1]
            out[-1] = (min(p[0], r0), max(p[1], r1), min(p[2], c0), max(p[3], c1))
        else:
            out.append((r0, r1, c0, c1))
    return out


def graph_segments(cells: DataFrame, merge_gap: int | None = 1) -> DataFrame:
    """sheet_id, seg_ord, r0, r1, c0, c1, gap of the components' boxes, swept unless merge_gap is None. gap: blank rows since
    the box before, 0 at least; the first one's is its first row. A sheet without cells has no segment."""
    ship(cells.sparkSession)

    def one_sheet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("r", "ascending"), ("a", "ascending")])
        boxes = component_boxes(list(zip(*(table.column(c).to_pylist() for c in ("r", "a", "b")), strict=True)))
        boxes = sorted(boxes if merge_gap is None else swept(boxes, merge_gap), key=lambda x: (x[0], x[2]))
        gaps = [x[0] if i == 0 else max(0, x[0] - boxes[i - 1][1] - 1) for i, x in enumerate(boxes)]
        columns = [[key[0].as_py()] * len(boxes), range(len(boxes)), *zip(*boxes, strict=True), gaps]
        return pa.table([pa.array(list(x), pa.int64()) for x in columns], names=["sheet_id", "seg_ord", "r0", "r1", "c0", "c1", "gap"])

    whole = runs(cells).select(F.col("sheet_id").cast("long"), F.col("r").cast("long"), F.col("a").cast("long"), F.col("b").cast("long"))
    return whole.groupBy("sheet_id").applyInArrow(one_sheet, "sheet_id long, seg_ord long, r0 long, r1 long, c0 long, c1 long, gap long")
