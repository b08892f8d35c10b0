"""Documents of files and of cell relations, as DataFrames: one row a file or a sheet, the document as JSON text.

A file is read and laid out by the task that has its bytes, so there is no shuffle. Cells that are relations already meet
by sheet in one shuffle. Rendering is a column function of the document.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.layout import PRESETS, Headers, Strategy, document_of, grid_of, sheet_document, table_element, with_images
from gridloom.plans.render import to_json, to_markdown
from gridloom.shipping import ship
from gridloom.sources.delimited import parse_rows, sniffed
from gridloom.sources.drawings import Images
from gridloom.sources.workbook import MOST_BYTES, WorkbookError, read_sheets

FILE_COLUMNS = "file_name string, sheets int, language string, document string, error_kind string, error string"


def strategy_of(strategy: str | Strategy) -> Strategy:
    """A strategy by its name, or as it is."""
    if isinstance(strategy, Strategy):
        return strategy
    if strategy not in PRESETS:
        raise ValueError(f"unknown strategy {strategy}; there are {', '.join(PRESETS)}")
    if strategy != "balanced":
        warnings.warn(f"the strategy {strategy} is experimental", stacklevel=3)
    return PRESETS[strategy]


def is_delimited(name: str | None) -> bool:
    return name is not None and name.rpartition(".")[2].lower() in ("csv", "tsv") and "." in name


def workbook_document(content: bytes, file_name: str | None = None, strategy: str | Strategy = "balanced", images: Images = Images(), most_bytes: int = MOST_BYTES) -> dict:
    """The document of a file's bytes: delimited text by its name, else a workbook."""
    if is_delimited(file_name):
        return delimited_document(content, file_name)
    chosen = strategy_of(strategy)
    sheets = read_sheets(content, images.output != "skip", most_bytes)
    return document_of(file_name, [sheet_document(i, s.name, with_images(s, images), chosen) for i, s in enumerate(sheets)])


def delimited_document(content: bytes, file_name: str | None = None, delimiter: str | None = None, encoding: str = "utf-8", has_header: bool = True) -> dict:
    """One sheet with one table of a delimited text; rows of different lengths stay as they are."""
    text = content.decode(encoding, "replace")
    rows = parse_rows(text, delimiter or sniffed(text))
    name = file_name.rpartition(".")[0] or file_name if file_name else "Sheet1"
    table = table_element(rows, Headers(count=int(has_header)), 0, 0)
    return document_of(file_name, [{"sheetIndex": 0, "sheetName": name, "elements": [table], "mergeRegions": []}])


def read_documents(spark: SparkSession, path: str, strategy: str | Strategy = "balanced", permissive: bool = True, images: Images = Images(), most_bytes: int = MOST_BYTES) -> DataFrame:
    """file_name, sheets, language, document of every file below path. permissive: a file that can't be read has an error_kind
    and an error instead; else it ends the query. images: what pictures become; its describe runs in the tasks."""
    chosen = strategy_of(strategy)
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row: dict = dict.fromkeys(("sheets", "language", "document", "error_kind", "error"))
                try:
                    found = workbook_document(content.as_py(), name, chosen, images, most_bytes)
                    row |= {"sheets": found["numberOfSheets"], "language": found["language"], "document": json.dumps(found, ensure_ascii=False)}
                except WorkbookError as e:
                    if not permissive:
                        raise
                    row |= {"error_kind": type(e).__name__, "error": str(e)}
                kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([row[k]], t) for k, t in zip(row, kinds, strict=True))], names=["file_name", *row])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")
    return files.mapInArrow(run, FILE_COLUMNS)


def sheet_documents(grid: DataFrame, merges: DataFrame, strategy: str | Strategy = "balanced") -> DataFrame:
    """sheet_id, document of cells that hold their markers (operators.merges.merged_grid) and their regions."""
    chosen = strategy_of(strategy)
    ship(grid.sparkSession)

    def one_sheet(key: tuple[pa.Scalar, ...], cells: pa.Table, regions: pa.Table) -> pa.Table:
        regions = regions.sort_by("ord")
        rows = list(zip(*(cells.column(c).to_pylist() for c in ("r", "c", "v")), strict=True))
        boxes = list(zip(*(regions.column(c).to_pylist() for c in ("r0", "r1", "c0", "c1")), strict=True))
        sheet = sheet_document(0, f"Sheet{key[0].as_py()}", grid_of(rows, boxes), chosen)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([json.dumps(document_of(None, [sheet]), ensure_ascii=False)])], names=["sheet_id", "document"])

    both = grid.select("sheet_id", "r", "c", "v").groupBy("sheet_id").cogroup(merges.select("sheet_id", "ord", "r0", "r1", "c0", "c1").groupBy("sheet_id"))
    return both.applyInArrow(one_sheet, "sheet_id long, document string")


def rendered(document: Column, form: str = "json", layout: str = "compact", assist: bool = False) -> Column:
    """The text of a document column; form: json or markdown. Null stays null."""
    write = {"json": to_json, "markdown": to_markdown}[form]
    if form == "markdown" and layout != "compact":
        raise ValueError(f"Markdown has no layout {layout}")

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else write(json.loads(x), layout, assist) for x in column.to_pylist()], pa.string())

    return text(document)


def raw_json(document: dict, pretty: bool = False) -> str:
    """A document as it is."""
    from gridloom.plans.render import pretty as over_lines

    return over_lines(document) if pretty else json.dumps(document, ensure_ascii=False, separators=(",", ":"))


def from_json(text: str) -> dict:
    """The document of its raw JSON, with whole numbers as the keys of paths."""
    out = json.loads(text)
    for e in (e for s in out["sheets"] for e in s["elements"] if e["type"] == "table"):
        for name in ("columnPaths", "rowPaths"):
            e[name] = {int(k): v for k, v in e[name].items()}
    return out
