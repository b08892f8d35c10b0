"""Documents as JSON and Markdown."""

from __future__ import annotations

import json
import re
from itertools import pairwise

from gridloom.plans.layout import blank, letters

# Markers that are not shown, values of a matrix in their order, and bounds of what is told.
PLACEHOLDERS = ("<", "^", "<^", "^<")
MATRIX = ("O", "X", "Y", "N", "YES", "NO", "TRUE", "FALSE", "○", "×", "✓")
SECTION_GAP, SECTION_COLUMNS, IDENTITY_ROWS, IDENTITY_COLUMNS, WIDE, MOST = 5, 80, 200, 4, 12, 80
# Sentences of the prompts.
LANGUAGES = {"KO": "Korean", "JA": "Japanese", "EN": "English"}
ROOT_JSON = "- `sheets` is an array of sheet objects; each has `sheetName`, `elements`, optional `mergeRegions`, and (when present) a `prompt` describing how to read that sheet."
ROOT_ROWS = '- Tables use the row-object layout — each row is `{"row": N, "cells": [...]}`.'
ROOT_MARKDOWN = """- The document is rendered as `## SheetName` sections.
- Each sheet starts with a `_Prompt_` block describing how to read it.
- Lines wrapped in single underscores (e.g. `_Prompt_`, `_Language: ..._`, `_Merged: ..._`, `_Table starts at ..._`) are metadata. Do NOT count them as data rows or sheets."""
SHEET_JSON = """- `startRow`/`startCol` are 1-based Excel row/column numbers.
- `cell` is the anchor cell of a heading/text block.
- Tables may include `range`, `endRow`/`endCol`, `headerRowCount`, `headerEndRow`, and `bodyStartRow` metadata.
- `leadingBlankColCount`/`sheetColCount` describe offset tables; leading blanks in `rows` preserve sheet alignment.
- `rowNumbers` gives absolute Excel row numbers when row identity matters; `rowAnchors` names representative body rows.
- `headerCells` maps each resolved header column to the header cell where that label is anchored."""
SHEET_PATHS = "- `columnPaths` and `resolvedHeaders` give fully qualified header names for multi-row headers."
SHEET_MERGES = """- Cell values "<"/"^" indicate left/up merge continuations.
- `mergeRegions` lists this sheet's merges (e.g. "A1:D1"); `mergedRanges` and `mergedRangeDetails` do the same per table."""
SHEET_ROWS = '- A merged cell becomes `{"v": "...", "mr": N, "md": N}` where `mr`/`md` are merged-right/down counts.'
SHEET_ROWS_MERGES = "- `mergeRegions` lists this sheet's merges (e.g. \"A1:D1\")."
SHEET_MARKDOWN = "- The first column of each table row is the 1-based Excel row number."
SHEET_MARKDOWN_MERGES = """- `[merged RxC]` after a cell value means the cell spans R rows × C columns.
- `_Merged: ..._` lists this sheet's merged ranges."""


def shown(value: str) -> str:
    return "" if value in PLACEHOLDERS else value


def cell_ref(row: int, column: int) -> str:
    return f"{letters(column)}{row + 1}"


def column_number(name: str) -> int:
    out = 0
    for ch in name:
        out = out * 26 + ord(ch) - 64
    return out - 1


def region_ref(region: dict) -> str:
    """A1:D1 of a region; one cell has no colon."""
    m = re.fullmatch(r"([A-Z]+)(\d+)", region["cell"])
    if not m or (region["rowSpan"] <= 1 and region["colSpan"] <= 1):
        return region["cell"]
    return f"{region['cell']}:{cell_ref(int(m[2]) + region['rowSpan'] - 2, column_number(m[1]) + region['colSpan'] - 1)}"


def language_sentence(*languages: str) -> str:
    """What one document, or several, is written in."""
    some = sorted(set(languages))
    if len(some) == 1:
        return f"This document is written in {LANGUAGES.get(some[0], 'English')}."
    return f"This data was extracted from {' and '.join(LANGUAGES[x] for x in some if x in LANGUAGES)} Excel documents."


def pretty(value: object, depth: int = 0) -> str:
    """Objects over lines of two more spaces, arrays on one line, a space on either side of the colon."""
    if isinstance(value, dict):
        pad = "  " * (depth + 1)
        lines = [f"{pad}{json.dumps(str(k), ensure_ascii=False)} : {pretty(v, depth + 1)}" for k, v in value.items()]
        return "{\n" + ",\n".join(lines) + "\n" + "  " * depth + "}" if lines else "{ }"
    if isinstance(value, list):
        return "[ " + ", ".join(pretty(v, depth) for v in value) + " ]" if value else "[ ]"
    return json.dumps(value, ensure_ascii=False)


class Table:
    """What is told of a table beside its rows."""

    def __init__(self, element: dict) -> None:
        self.e, self.rows, self.row, self.column = element, element["rows"], element["startRow"], element["startCol"]
        self.head = element["headerRowCount"]
        self.paths = {int(k): v for k, v in element["columnPaths"].items()}
        self.width = max((sum(1 + c["mergedRight"] for c in r["cells"]) for r in self.rows), default=0)
        self.headers, self.header_cells = self._headers()

    def _number(self, row: dict) -> int:
        return self.row + row["rowIndex"] + 1

    def bounds(self) -> dict:
        if not self.rows or not self.width:
            return {}
        last = (self.row + len(self.rows) - 1, self.column + self.width - 1)
        out = {"endRow": last[0] + 1, "endCol": last[1] + 1, "rowCount": len(self.rows), "colCount": self.width, "range": f"{cell_ref(self.row, self.column)}:{cell_ref(*last)}"}
        return out | ({"leadingBlankColCount": self.column, "sheetColCount": self.column + self.width} if self.column > 0 else {})

    def column_paths(self) -> dict:
        cleaned = {str(self.column + c + 1): self._clean(p) for c, p in self.paths.items()}
        return {k: p for k, p in cleaned.items() if p}

    @staticmethod
    def _clean(path: list[str]) -> list[str]:
        return list(dict.fromkeys(t for v in path if (t := shown(v).strip())))

    def _headers(self) -> tuple[dict, dict]:
        """Full header text, and the cell that names it, by column number: from header rows with two texts at least."""
        top = self.rows[: max(self.head, 0)]
        width = max((len(r["cells"]) for r in top), default=0)
        text = {(r, c): x["value"] for r, row in enumerate(top) for c, x in enumerate(row["cells"])}
        anchor: dict[tuple[int, int], tuple[int, int]] = {}
        for r, row in enumerate(top):
            for c, x in enumerate(row["cells"]):
                if not blank(v := shown(x["value"])):
                    for at in ((i, k) for i in range(r, min(self.head, r + x["mergedDown"] + 1)) for k in range(c, min(width, c + x["mergedRight"] + 1))):
                        text[at], anchor[at] = v, (r, c)
        telling = [r for r in range(self.head) if len({t for c in range(width) if (t := text.get((r, c), "").strip())}) > 1]
        names, cells = {}, {}
        for c in range(width) if telling else ():
            own = [r for r in telling if not blank(shown(text.get((r, c), "")))]
            path = self._clean(self.paths[c]) if c in self.paths else list(dict.fromkeys(shown(text[r, c]) for r in own))
            if path:
                key = str(self.column + c + 1)
                names[key] = " > ".join(path)
                if own and own[-1:] and (at := anchor.get((own[-1], c))):
                    cells[key] = cell_ref(self.row + at[0], self.column + at[1])
        return names, cells

    def columns(self) -> list[dict]:
        if not self.headers or not (self.column > 0 or self.head > 1 or self.width > WIDE):
            return []
        return [{"index": int(k), "letter": letters(int(k) - 1), "header": v} | ({"headerCell": self.header_cells[k]} if k in self.header_cells else {}) for k, v in self.headers.items()]

    def matrix_rows(self) -> list[dict]:
        """Rows of a table whose right columns hold marks alone: their key, marks by header, and headers by mark."""
        body = self.rows[self.head :] if self.head > 0 and self.headers else []
        if len(body) < 2:
            return []
        of = lambda row, c: shown(row["cells"][c]["value"]).strip() if c < len(row["cells"]) else ""
        marks = lambda c: [v for row in body if (v := of(row, c))]
        width = max(len(r["cells"]) for r in self.rows)
        columns = [c for c in range(width) if len(m := marks(c)) > 1 and all(v.upper() in MATRIX for v in m)]
        if len(columns) < 3:
            return []
        out = []
        for row in body:
            key = dict.fromkeys(v for c in range(columns[0]) if (v := of(row, c)))
            values = {self.headers[k]: v for c in columns if (v := of(row, c)).upper() in MATRIX and (k := str(self.column + c + 1)) in self.headers}
            if key and values:
                groups = {g: [h for h, v in values.items() if v == g] for g in sorted(set(values.values()))}
                out.append({"row": self._number(row), "key": " / ".join(key), "values": values, "groups": groups})
        return out[:MOST]

    @staticmethod
    def transitions(rows: list[dict]) -> list[dict]:
        """Which marks change between neighbouring rows."""
        out = []
        for a, b in pairwise(rows):
            moved: dict[tuple[int, int], list[str]] = {}
            for h in a["values"]:
                if h in b["values"] and (x := a["values"][h].upper()) != (y := b["values"][h].upper()):
                    moved.setdefault((MATRIX.index(x), MATRIX.index(y)), []).append(h)
            if moved:
                changes = {f"{MATRIX[x]}->{MATRIX[y]}": hs for (x, y), hs in sorted(moved.items())}
                out.append({"fromRow": a["row"], "fromKey": a["key"], "toRow": b["row"], "toKey": b["key"], "changes": changes})
        return out[:MOST]

    def identity(self) -> tuple[list[int], list[dict]]:
        """Numbers of all rows, and the first text of body rows, where rows are hard to tell apart."""
        tall = any(c["mergedDown"] > 0 for r in self.rows for c in r["cells"])
        if not 2 <= len(self.rows) <= IDENTITY_ROWS or not (self.width <= 1 or (self.width <= IDENTITY_COLUMNS and tall)):
            return [], []
        anchors = []
        for row in self.rows[max(self.head, 0) :]:
            first = next(((c, v) for c, x in enumerate(row["cells"]) if (v := shown(x["value"]).strip())), None)
            if first:
                anchors.append({"row": self._number(row), "cell": cell_ref(self.row + row["rowIndex"], self.column + first[0]), "label": first[1]})
        return [self._number(r) for r in self.rows], anchors[:MOST]

    def merges(self) -> tuple[list[dict], list[str], list[dict]]:
        """Merged cells, their ranges, and the ranges that have a text."""
        cells, ranges, details = [], [], []
        for row in self.rows:
            for c, x in enumerate(row["cells"]):
                right, down = x["mergedRight"], x["mergedDown"]
                if right > 0 or down > 0:
                    at, value = self.row + row["rowIndex"], shown(x["value"])
                    ref, column = cell_ref(at, self.column + c), self.column + c
                    text = {} if blank(value) else {"value": value}
                    cells.append({"cell": ref} | ({"rowSpan": down + 1} if down > 0 else {}) | ({"colSpan": right + 1} if right > 0 else {}) | text)
                    ranges.append(f"{ref}:{cell_ref(at + max(down, 0), column + max(right, 0))}")
                    if text:
                        details.append({"range": ranges[-1], "cell": ref} | text)
        return cells, ranges, details

    def told(self, row_object: bool) -> dict:
        out = {"type": "table"} | _start(self.e) | self.bounds()
        if self.head > 0:
            out |= {"headerRowCount": self.head, "headerEndRow": self.row + self.head, "bodyStartRow": self.row + self.head + 1}
        if not row_object:
            if self.paths:
                out["columnPaths"] = self.column_paths()
            if self.e["rowPaths"]:
                out["rowPaths"] = {str(k): v for k, v in self.e["rowPaths"].items()}
        matrix, (numbers, anchors), (cells, ranges, details) = self.matrix_rows(), self.identity(), self.merges()
        some = {"resolvedHeaders": self.headers, "headerCells": self.header_cells, "columns": self.columns(), "matrixRows": matrix, "matrixTransitions": self.transitions(matrix)}
        later = {"mergedRanges": ranges, "mergedRangeDetails": details}
        rows = [[""] * self.column + [self._shown(c, row_object) for c in r["cells"]] for r in self.rows]
        if row_object:
            some |= later
            rows = [{"row": self._number(r), "cells": x} for r, x in zip(self.rows, rows, strict=True)]
            later = {}
        else:
            some |= {"rowNumbers": numbers, "rowAnchors": anchors}
            later = {"merges": cells} | later
        return out | {k: v for k, v in some.items() if v} | {"rows": rows} | {k: v for k, v in later.items() if v}

    @staticmethod
    def _shown(cell: dict, row_object: bool) -> object:
        spans = {"mr": cell["mergedRight"], "md": cell["mergedDown"]}
        if not row_object or not any(spans.values()):
            return shown(cell["value"])
        return {"v": shown(cell["value"])} | {k: n for k, n in spans.items() if n > 0}


def _start(e: dict) -> dict:
    return {k: e[k] + 1 for k in ("startRow", "startCol") if e[k] != 0}


def _elements(elements: list[dict], row_object: bool) -> list[dict]:
    """All elements; a table that a heading stands shortly above has its section."""
    out, heading = [], None
    for e in elements:
        if e["type"] != "table":
            text = {"description": e.get("description") or ""} if e["type"] == "image" else {"text": e["text"]}
            level = {"level": e["level"]} if e["type"] == "heading" else {}
            out.append({"type": e["type"]} | text | level | _start(e) | {"cell": cell_ref(e["startRow"], e["startCol"])})
            heading = e if e["type"] == "heading" else heading
            continue
        told = Table(e).told(row_object)
        if heading and heading["startRow"] < e["startRow"] <= heading["startRow"] + SECTION_GAP:
            told["section"] = {"text": heading["text"], "cell": cell_ref(heading["startRow"], heading["startCol"])}
            columns = told.get("columns", [])
            cells = {f"{heading['text']} > {c['header']}": c["headerCell"] for c in columns if "headerCell" in c}
            if cells and len(columns) <= SECTION_COLUMNS:
                told["sectionHeaderCells"] = cells
        out.append(told)
    return out


def to_json(document: dict, layout: str = "compact", assist: bool = False) -> str:
    """JSON of a document; layout: compact (rows of texts) or row_object (rows of cells); assist: with prompts."""
    if layout not in ("compact", "row_object"):
        raise ValueError(f"unknown layout {layout}")
    row_object = layout == "row_object"
    root: dict = {"prompt": "\n".join([language_sentence(document["language"]), ROOT_JSON, *([ROOT_ROWS] if row_object else [])])} if assist else {}
    sheets = []
    for s in document["sheets"]:
        out = {"sheetName": s["sheetName"]}
        if assist:
            paths = not row_object and any(e["type"] == "table" and e["columnPaths"] for e in s["elements"])
            merged = [SHEET_ROWS_MERGES if row_object else SHEET_MERGES] if s["mergeRegions"] else []
            out["prompt"] = "\n".join([SHEET_JSON, *([SHEET_ROWS] if row_object else []), *([SHEET_PATHS] if paths else []), *merged])
        out["elements"] = _elements(s["elements"], row_object)
        if s["mergeRegions"]:
            out["mergeRegions"] = [region_ref(r) for r in s["mergeRegions"]]
        sheets.append(out)
    return pretty(root | {"language": document["language"], "sheets": sheets})


def markdown_cell(value: str) -> str:
    return re.sub("\r\n|\n|\r", "<br>", shown(value).replace("|", "\\|"))


def markdown_table(e: dict) -> str:
    width = max((len(r["cells"]) for r in e["rows"]), default=0)
    if not width:
        return "*Empty table*"
    notes = []
    if e["startRow"] or e["startCol"]:
        notes.append(f"_Table starts at row {e['startRow'] + 1}, col {e['startCol'] + 1}_")
    if e["headerRowCount"] > 1:
        notes.append(f"_Headers: {e['headerRowCount']} rows_")
    if e["columnPaths"]:
        notes += ["_Column hierarchy:_", *(f"- Col {c + 1}: {' > '.join(p)}" for c, p in sorted((int(k), v) for k, v in e["columnPaths"].items()))]
    paths = {int(k): v for k, v in e["rowPaths"].items()}
    head, lines = max(1, e["headerRowCount"]), []
    for i, row in enumerate(e["rows"]):
        texts = []
        for c in range(width):
            cell = row["cells"][c] if c < len(row["cells"]) else None
            spans = f" [merged {cell['mergedDown'] + 1}x{cell['mergedRight'] + 1}]" if cell and (cell["mergedRight"] > 0 or cell["mergedDown"] > 0) else ""
            texts.append((markdown_cell(cell["value"]) if cell else "") + spans)
        path = paths.get(i - head) if i >= head else None
        lead = "" if not paths else f"| _{' > '.join(path)}_ " if path else "| "  # with one pipe too many, as it always was
        lines.append(f"| {e['startRow'] + row['rowIndex'] + 1} | {lead}{' | '.join(texts)} |")
        if i == head - 1:
            lines.append("| " + " | ".join(["---"] * (width + 1 + bool(paths))) + " |")
    return "\n".join([*notes, *([""] if notes else []), *lines])


def markdown_element(e: dict) -> str:
    if e["type"] == "table":
        return markdown_table(e)
    if e["type"] == "heading":
        return f"{'#' * min(6, max(1, e['level']))} {e['text']}"
    if e["type"] == "image":
        return e["description"] if e.get("description") is not None else f"[Image: {e.get('mimeType') or 'unknown'}]" if e.get("base64") is not None else "[Image]"
    return f"> {e['text']}" if e["type"] == "note" else e["text"]


def to_markdown(document: dict, layout: str = "compact", assist: bool = False, with_name: bool = False) -> str:
    """Markdown of a document, a section for each sheet. There is no row-object layout of it."""
    if layout != "compact":
        raise ValueError(f"Markdown has no layout {layout}")
    parts = [f"# {document['fileName']}"] if with_name and document["fileName"] is not None else []
    if assist:
        parts.append("\n".join(["_Prompt_", language_sentence(document["language"]), ROOT_MARKDOWN]))
    if document["sheets"]:
        parts.append(f"_Language: {document['language']}_")
    for s in document["sheets"]:
        own = [f"## {s['sheetName']}"]
        if assist:
            own.append("\n".join(["_Prompt_", SHEET_MARKDOWN, *([SHEET_MARKDOWN_MERGES] if s["mergeRegions"] else [])]))
        if s["mergeRegions"]:
            own.append(f"_Merged: {', '.join(map(region_ref, s['mergeRegions']))}_")
        parts.append("\n\n".join([*own, *(map(markdown_element, s["elements"]) if s["elements"] else [""])]))  # an empty one still ends its head
    return "\n\n".join(parts).rstrip()
