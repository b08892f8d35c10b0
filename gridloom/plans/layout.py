"""The layout of one sheet: visible grid, segments, headers, elements and their order.

A grid is its dense rows of texts and its merged regions, both from 0. Stages are functions, so a strategy is a choice of
functions and anyone's own function fits: a segmenter takes a grid, a header detector a segment, an orderer blocks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from gridloom.functions import BULLETS, MARKERS
from gridloom.operators.graph import component_boxes, swept
from gridloom.sources.cell_text import cell_text
from gridloom.sources.drawings import Images, nearest, picture_file
from gridloom.sources.workbook import Evaluator, RawSheet

Rows = list[list[str]]
Region = tuple[int, int, int, int]  # first row, last row, first column, last column
#: Blank rows before a block that make it a candidate for the end.
DEFER = 2


@dataclass
class Grid:
    rows: Rows
    merges: list[Region] = field(default_factory=list)

    @property
    def columns(self) -> int:
        return max((len(r) for r in self.rows), default=0)

    def part(self, r0: int, r1: int, c0: int, c1: int) -> Grid:
        """A rectangle, and what of the regions lies in it."""
        inside = [(max(a, r0) - r0, min(b, r1) - r0, max(c, c0) - c0, min(d, c1) - c0) for a, b, c, d in self.merges if a <= r1 and b >= r0 and c <= c1 and d >= c0]
        return Grid([row[c0 : c1 + 1] for row in self.rows[r0 : r1 + 1]], inside)


@dataclass
class Segment:
    grid: Grid
    row: int = 0
    column: int = 0
    gap: int = 0


@dataclass
class Headers:
    start: int = 0
    count: int = 0
    column_paths: dict[int, list[str]] = field(default_factory=dict)
    row_paths: dict[int, list[str]] = field(default_factory=dict)


@dataclass
class Block:
    segment: Segment
    element: dict


def blank(text: str) -> bool:
    return not text.strip()


def empty(row: list[str]) -> bool:
    return all(map(blank, row))


def meaningful(text: str) -> bool:
    return not blank(text) and text not in MARKERS


# --- grid ---------------------------------------------------------------------------------------------------------------


def visible_grid(sheet: RawSheet) -> tuple[Grid, list[int], list[int]]:
    """The grid that a sheet shows, and the sheet's row and column behind each of its own.

    Hidden rows and columns are left out unless something is drawn over them. A region's first cell has its text, the
    others markers of what lies above and to the left, whatever they hold themselves. The grid ends at the last column
    with content; without content it is empty and the regions stay in the sheet's coordinates.
    """
    texts = Evaluator(sheet)
    shown = {at: t for at, c in sheet.cells.items() if not blank(t := cell_text(c, texts))}
    drawn_rows = {r for a, b, _, _ in sheet.drawn for r in range(a, b + 1)}
    drawn_columns = {c for _, _, a, b in sheet.drawn for c in range(a, b + 1)}
    last = max(sheet.rows | drawn_rows, default=-1)
    rows = [r for r in range(last + 1) if r not in sheet.hidden_rows or r in drawn_rows]
    width = max([c for (r, c) in shown if r not in sheet.hidden_rows or r in drawn_rows] + [r[3] for r in sheet.merges if (r[0], r[2]) in shown] + list(drawn_columns), default=-1)
    columns = [c for c in range(width + 1) if c not in sheet.hidden_columns or c in drawn_columns]
    if not rows or not columns:
        return Grid([], list(sheet.merges)), [], []
    covered = {}
    for r0, r1, c0, c1 in sheet.merges:
        for r in range(r0, r1 + 1):
            for c in range(c0, c1 + 1):
                covered[r, c] = "^" * (r > r0) + "<" * (c > c0) or shown.get((r0, c0), "")
    row_at, column_at = ({x: i for i, x in enumerate(xs)} for xs in (rows, columns))
    regions = []
    for r0, r1, c0, c1 in sheet.merges:
        rs, cs = [row_at[r] for r in range(r0, r1 + 1) if r in row_at], [column_at[c] for c in range(c0, c1 + 1) if c in column_at]
        if rs and cs:
            regions.append((rs[0], rs[-1], cs[0], cs[-1]))
    return Grid([[covered.get((r, c)) or shown.get((r, c), "") for c in columns] for r in rows], regions), rows, columns


def with_images(sheet: RawSheet, images: Images = Images()) -> Grid:
    """The grid that a sheet shows, with the texts of shapes and then of pictures below the texts of the cells in their middle.

    The first cell of a region stands for all of it, and the nearest shown row or column for a hidden one. What lies beyond
    the grid is left out, and so are pictures that are linked or that can't be told as such."""
    grid, rows, columns = visible_grid(sheet)
    if images.output == "skip":
        return grid
    last, shapes, pictures = max(sheet.rows, default=0), [], []
    for d in sheet.drawings:
        r, c = d.anchor.centre(sheet.heights, sheet.widths, last)
        r, c = next(((m[0], m[2]) for m in sheet.merges if m[0] <= r <= m[1] and m[2] <= c <= m[3]), (r, c))
        at = nearest(r, rows), nearest(c, columns)
        if None in at:
            continue
        if d.text is not None:
            shapes += [(at, d.text)] if images.shapes else []
        elif content := picture_file(d.mime, d.content):
            pictures.append((at, (d.mime or "image/png", content)))
    said = images.texts([p for _, p in pictures])
    for (r, c), text in shapes + list(zip((at for at, _ in pictures), said, strict=False)):
        grid.rows[r][c] = text if blank(grid.rows[r][c]) else f"{grid.rows[r][c]}\n{text}"
    return grid


# --- segmentation -------------------------------------------------------------------------------------------------------


def _runs(filled: list[bool], least: int) -> list[tuple[int, int]]:
    """First and last place of the runs of filled places that `least` or more others separate."""
    out: list[tuple[int, int]] = []
    for i in (i for i, x in enumerate(filled) if x):
        if out and i - out[-1][1] - 1 < least:
            out[-1] = (out[-1][0], i)
        else:
            out.append((i, i))
    return out


def _bands(grid: Grid, least: int) -> list[tuple[int, int]]:
    """First and last row of the bands that blank rows separate. A band keeps fewer than least of the blank rows behind it."""
    full = [not empty(r) for r in grid.rows]
    out = []
    for first, last in _runs(full, least):
        blanks = next((k for k, x in enumerate(full[last + 1 :]) if x), len(full) - last - 1)
        out.append((first, last + min(least - 1, blanks)))
    return out


def _stripes(band: Rows, columns: int) -> list[tuple[int, int]]:
    return _runs([any(c < len(r) and not blank(r[c]) for r in band) for c in range(columns)], 1)


def _parts(stripe: Rows, least: int) -> list[tuple[int, int, int]]:
    """First row, last row and blank rows before the segments of a stripe."""
    parts, done, out = _runs([not empty(r) for r in stripe], least), 0, []
    for k, (a, b) in enumerate(parts):
        rest = (parts[k + 1][0] if k + 1 < len(parts) else len(stripe)) - b - 1
        out.append((a, b + min(least - 1, rest), a - done))
        done = b + 1
    return out


def by_gaps(grid: Grid, band_rows: int = 2, stripe_rows: int = 2, offsets: bool = True) -> list[Segment]:
    """Bands of rows, stripes of columns in them, and segments of rows in these. Without offsets all start in column 0 and
    regions are cut by rows alone."""
    out, before = [], -1
    for first, end in _bands(grid, band_rows):
        band = grid.rows[first : end + 1]
        for c0, c1 in _stripes(band, grid.columns):
            for k, (a, stop, gap) in enumerate(_parts([r[c0 : c1 + 1] for r in band], stripe_rows)):
                part = grid.part(first + a, first + stop, c0, c1)
                if not offsets:
                    part.merges = [(max(x, first + a) - first - a, min(y, first + stop) - first - a, u, v) for x, y, u, v in grid.merges if x <= first + stop and y >= first + a]
                out.append(Segment(part, first + a, c0 if offsets else 0, gap or (0 if k else first - before - 1)))
        before = end
    return out or ([Segment(grid)] if grid.rows else [])


def by_gaps_alone(grid: Grid) -> list[Segment]:
    """As by_gaps, without offsets."""
    return by_gaps(grid, offsets=False)


def by_graph(grid: Grid, merge_gap: int | None = 1) -> list[Segment]:
    """The boxes of connected cells, close ones joined by one sweep; gap: blank rows since the box before."""
    spans = [(r, a, b) for r, row in enumerate(grid.rows) for a, b in _runs([not blank(v) for v in row], 1)]
    if not spans:
        return [Segment(grid)] if grid.rows else []
    boxes = component_boxes(spans)
    boxes = sorted(boxes if merge_gap is None else swept(boxes, merge_gap), key=lambda b: (b[0], b[2]))
    out, before = [], None
    for r0, r1, c0, c1 in boxes:
        out.append(Segment(grid.part(r0, r1, c0, c1), r0, c0, r0 if before is None else max(0, r0 - before - 1)))
        before = r1
    return out


def isolated(rows: Rows) -> tuple[list[str], Rows]:
    """Texts of cells alone in their row with blank rows or edges around, and the rows without them and those blank rows."""
    full = [not empty(r) for r in rows]
    alone = [i for i, r in enumerate(rows) if sum(not blank(v) for v in r) == 1 and not any(full[k] for k in (i - 1, i + 1) if 0 <= k < len(rows))]
    gone = {k for i in alone for k in (i - 1, i, i + 1)}
    return [next(v for v in rows[i] if not blank(v)) for i in alone], [r for i, r in enumerate(rows) if i not in gone]


# --- headers ------------------------------------------------------------------------------------------------------------


def single_row(segment: Segment) -> Headers:
    """The first row with a text."""
    first = next((i for i, r in enumerate(segment.grid.rows) if not empty(r)), None)
    return Headers(first or 0, 0 if first is None else 1)


def header_start(grid: Grid) -> int | None:
    """The first row with a meaningful text that is no banner before a richer row."""
    rows = [i for i, r in enumerate(grid.rows) if any(map(meaningful, r))]
    for i, following in zip(rows, [*rows[1:], None], strict=False):
        values, columns = {v for v in grid.rows[i] if meaningful(v)}, len(grid.rows[i])
        wide = any(a == b == i and c == 0 and d + 1 >= max(4, columns // 2) for a, b, c, d in grid.merges)
        one = next(iter(values))
        banner = len(values) == 1 and columns >= 4 and (wide or len(one) >= 40 or "\n" in one)
        filled = [sum(map(meaningful, grid.rows[k])) for k in (i, following) if k is not None]
        if not (banner and len(filled) == 2 and filled[1] >= max(3, filled[0] + 2)):
            return i
    return None


def _path(values: list[str]) -> list[str]:
    """Texts without blanks and repeats of the one before."""
    out: list[str] = []
    for v in values:
        if not blank(v) and (not out or out[-1] != v):
            out.append(v)
    return out


def column_paths(grid: Grid, start: int, count: int) -> dict[int, list[str]]:
    """Header texts above each column, outer ones first, of columns with two at least. A region's text stands for all of it."""
    if count < 2:
        return {}
    head = {(r, c): v for r in range(start, min(start + count, len(grid.rows))) for c, v in enumerate(grid.rows[r])}
    for r0, r1, c0, c1 in grid.merges:
        if r0 < len(grid.rows) and c0 < len(grid.rows[r0]) and not blank(text := grid.rows[r0][c0]):
            head |= {(r, c): text for r in range(r0, r1 + 1) for c in range(c0, c1 + 1) if (r, c) in head}
    found = {c: _path([head.get((r, c), "") for r in range(start, start + count)]) for c in range(grid.columns)}
    return {c: p for c, p in found.items() if len(p) > 1}


def merge_aware(segment: Segment) -> Headers:
    """The start row, and all rows of the regions of several rows that cross it."""
    grid, start = segment.grid, header_start(segment.grid)
    if start is None:
        return Headers()
    rows = {start} | {r for a, b, _, _ in grid.merges if a < b and a <= start <= b for r in range(a, min(b, len(grid.rows) - 1) + 1)}
    return Headers(start, len(rows), column_paths(grid, start, len(rows)))


def hierarchy_aware(segment: Segment) -> Headers:
    """As merge_aware, and the paths of rows: texts of the columns from the left that regions of several rows fill."""
    found, grid = merge_aware(segment), segment.grid
    body = found.start + found.count
    tall = [m for m in grid.merges if m[1] > m[0] and m[1] >= body and m[2] == m[3]]
    width = 0
    while any(m[2] == width for m in tall):
        width += 1
    paths = {}
    for r in range(body, len(grid.rows)):
        values = []
        for c in range(width):
            owner = next((m for m in tall if m[2] == c and m[0] <= r <= m[1]), None)
            values.append(grid.rows[owner[0]][c] if owner else grid.rows[r][c])
        if len(p := _path(values)) > 1:
            paths[r - body] = p
    return replace(found, row_paths=paths)


def with_placeholders(rows: Rows, name: str = "header_{}") -> Rows:
    """Header rows whose blank cells are named by a counter, row by row; a column that got a name keeps its later blanks."""
    named: set[int] = set()
    out = [list(r) for r in rows]
    for row in out:
        for c, v in enumerate(row):
            if blank(v) and c not in named:
                named.add(c)
                row[c] = name.format(len(named))
    return out


def with_names(rows: Rows, name: str = "header_{}") -> Rows:
    """As with_placeholders, for rows as wide as the widest; a column that has a text keeps its later blanks too."""
    width, done, named = max(map(len, rows), default=0), set(), 0
    out = [[*r, *[""] * (width - len(r))] for r in rows]
    for row in out:
        for c, v in enumerate(row):
            if blank(v) and c not in done:
                named += 1
                row[c] = name.format(named)
            done.add(c)
    return out


def plain_table(rows: Rows, merges: list[Region] = (), escape: bool = True) -> tuple[str, Rows, int]:
    """Lines of a table, its header rows and the first one's place. The header is the first row with a text and the later rows of
    regions that cross it; other blank rows are left out."""
    width = max(map(len, rows), default=0)
    if not width:
        return ("*Empty table*\n" if rows else "*Empty sheet*\n"), [], 0
    said = [[re.sub("\r\n|\n|\r", "<br>", v.replace("|", "\\|") if escape else v) for v in r] for r in rows]
    start = next((i for i, r in enumerate(said) if not empty(r)), None)
    if start is None:
        head, places = [[f"Column {c + 1}" for c in range(width)]], set()
    else:
        places = {start} | {r for a, b, _, _ in merges if a < b and a <= start <= b for r in range(start, min(b, len(said) - 1) + 1)}
        head = with_names([[*said[r], *[""] * (width - len(said[r]))] for r in sorted(places)], "empty header {}")
    body = [[*r, *[""] * (width - len(r))] for i, r in enumerate(said) if i not in places and not empty(r)]
    return "".join(f"| {' | '.join(r)} |\n" for r in head + body), head, start or 0


# --- elements -----------------------------------------------------------------------------------------------------------


def title_like(text: str) -> bool:
    t = text.strip()
    bare = re.sub(r"\s+", "", t)
    return bool(t) and (t[0] in BULLETS or re.match("(19|20)[0-9]{2}(년|$)", bare) is not None or t.startswith(("년", "~")) or ("패널" in t and len(t) <= 15))


def titled(text: str) -> str:
    """A title with a bullet."""
    t = text.strip()
    return t if t[:1] and t[0] in BULLETS else f"{BULLETS[1]} {t}"


def detect_title(rows: Rows) -> tuple[str, Rows] | None:
    """The first title-like text of the first two rows, and the rows without it and without blank ones."""
    found = next(((r, c) for r, row in enumerate(rows[:2]) for c, v in enumerate(row) if title_like(v)), None)
    if found is None:
        return None
    left = [["" if (r, c) == found else v for c, v in enumerate(row)] for r, row in enumerate(rows)]
    return rows[found[0]][found[1]].strip(), [r for r in left if not empty(r)]


def trimmed(rows: Rows) -> Rows:
    """Rows without blank ones at either end."""
    full = [i for i, r in enumerate(rows) if not empty(r)]
    return rows[full[0] : full[-1] + 1] if full else []


def one_column_text(rows: Rows) -> bool:
    """Whether all texts are in one column and one of them has white space in it."""
    texts = [(c, v) for r in rows for c, v in enumerate(r) if not blank(v)]
    return len({c for c, _ in texts}) == 1 and any(re.search(r"\s", v) for _, v in texts)


def text_element(kind: str, text: str, row: int, column: int) -> dict:
    return {"type": kind, "text": text, **({"level": 2} if kind == "heading" else {}), "startRow": row, "startCol": column}


def table_element(rows: Rows, headers: Headers, row: int, column: int) -> dict:
    cells = [{"rowIndex": i, "cells": [{"value": v, "mergedRight": 0, "mergedDown": 0} for v in r]} for i, r in enumerate(rows)]
    return {"type": "table", "rows": cells, "headerRowCount": headers.count, "startRow": row, "startCol": column, "columnPaths": headers.column_paths, "rowPaths": headers.row_paths}


def classify(segment: Segment, headers: Headers) -> dict:
    """A heading, a text or a table of a segment. Rows before the header's start are left out of a table."""
    rows, row, column = segment.grid.rows, segment.row, segment.column
    title = detect_title(rows)
    content = title[1] if title else rows
    body = trimmed(content)
    if not body:
        return text_element("heading", title[0], row, column) if title else text_element("text", "", row, column)
    shift = content.index(body[0])  # by equal values, as blank rows have gone
    shift += rows.index(content[0]) if title and content[0] in rows else 0
    texts = [v for r in body for v in r if not blank(v)]
    if len(texts) == 1 or one_column_text(body):
        whole = "\n".join(t for t in (title[0] if title else "", "\n".join(texts).strip()) if t)
        return text_element("text", whole, row if title else row + shift, column)
    drop = min(max(headers.start - shift, 0), len(body))
    return table_element(body[drop:], headers, row + shift + drop, column)


def in_sequence(blocks: list[Block]) -> list[Block]:
    return blocks


def deferred(blocks: list[Block]) -> list[Block]:
    """Blocks behind a large gap that no close block follows come last."""
    far = [b.segment.gap >= DEFER for b in blocks]
    late = [x and (i + 1 == len(far) or far[i + 1]) for i, x in enumerate(far)]
    return [b for b, x in zip(blocks, late, strict=True) if not x] + [b for b, x in zip(blocks, late, strict=True) if x]


# --- one pass -------------------------------------------------------------------------------------------------------------


def one_pass(grid: Grid) -> list[dict]:
    """Elements of a grid, band by band.

    A title waits for the next content of its stripe and comes before it as a heading, or at the stripe's end. Texts behind a
    large gap, and whatever a title behind one leads, come last in their band. Headings and texts have no place."""
    out = []
    for first, end in _bands(grid, 2):
        near, late = [], []
        band = grid.rows[first : end + 1]
        for c0, c1 in _stripes(band, grid.columns):
            stripe, waiting = [r[c0 : c1 + 1] for r in band], []
            for a, stop, gap in _parts(stripe, 2):
                rows = stripe[a : stop + 1]
                if title := detect_title(rows):
                    waiting, rows, gap = [(title[0], gap)], title[1], 0
                alone, rest = isolated(rows)
                rest = trimmed(rest)
                texts = [v for r in rest for v in r if not blank(v)]
                for group in (alone, texts if len(texts) == 1 else []):
                    to = late if max(gap, *(g for _, g in waiting), 0) >= DEFER else near
                    for text in group:
                        to += [text_element("heading", t, 0, 0) for t, _ in waiting] + [text_element("text", text.strip(), 0, 0)]
                        waiting = []
                if len(texts) > 1:
                    to = late if waiting and max(gap, waiting[0][1]) >= DEFER else near
                    count = len(plain_table(rest, grid.merges)[1])  # regions in the sheet's rows, the table's in its own
                    to += [text_element("heading", t, 0, 0) for t, _ in waiting] + [table_element(rest, Headers(count=count), first + a, c0)]
                    waiting = []
            for text, gap in waiting:
                (late if gap >= DEFER else near).append(text_element("heading", text, 0, 0))
        out += near + late
    return out


# --- strategies ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Strategy:
    segment: Callable[[Grid], list[Segment]] = by_graph
    headers: Callable[[Segment], Headers] = merge_aware
    element: Callable[[Segment, Headers], dict] = classify
    order: Callable[[list[Block]], list[Block]] = deferred


#: Strategies by name; the last three are experimental.
PRESETS = {
    "balanced": Strategy(),
    "structural": Strategy(segment=by_gaps, order=in_sequence),
    "scattered": Strategy(segment=lambda grid: by_graph(grid, None), headers=single_row, order=in_sequence),
    "complex": Strategy(headers=hierarchy_aware),
}


#: These four stages together are laid out in one pass.
ONE_PASS = Strategy(by_gaps_alone, single_row, classify, in_sequence)


def with_spans(table: dict, merges: list[Region]) -> dict:
    """A table whose cells say how far the regions that lie in it reach. A cell takes the first region only."""
    height, width = len(table["rows"]), len(table["rows"][0]["cells"]) if table["rows"] else 0
    for r0, r1, c0, c1 in merges:
        a, b, c, d = r0 - table["startRow"], r1 - table["startRow"], c0 - table["startCol"], c1 - table["startCol"]
        if (r1 > r0 or c1 > c0) and 0 <= a and b < height and 0 <= c and d < width and c < len(cells := table["rows"][a]["cells"]):
            if not cells[c]["mergedRight"] and not cells[c]["mergedDown"]:
                cells[c] |= {"mergedRight": d - c, "mergedDown": b - a}
    return table


def letters(column: int) -> str:
    out = ""
    while column >= 0:
        out, column = chr(65 + column % 26) + out, column // 26 - 1
    return out


def sheet_document(index: int, name: str, grid: Grid, strategy: Strategy) -> dict:
    """Elements and merged regions of a sheet. A sheet with cells but without elements is one table."""
    if strategy == ONE_PASS:
        elements = one_pass(grid)
    else:
        elements = [b.element for b in strategy.order([Block(s, strategy.element(s, strategy.headers(s))) for s in strategy.segment(grid)])]
    if not elements and grid.rows:
        elements = [table_element(grid.rows, Headers(count=1), 0, 0)]
    elements = [with_spans(e, grid.merges) if e["type"] == "table" else e for e in elements]
    regions = [{"cell": f"{letters(c0)}{r0 + 1}", "rowSpan": r1 - r0 + 1, "colSpan": c1 - c0 + 1} for r0, r1, c0, c1 in grid.merges]
    return {"sheetIndex": index, "sheetName": name, "elements": elements, "mergeRegions": regions}


def texts_of(document: dict) -> list[str]:
    out = []
    for e in (e for s in document["sheets"] for e in s["elements"]):
        out += [c["value"] for r in e["rows"] for c in r["cells"]] if e["type"] == "table" else [e.get("text") or e.get("description") or ""]
    return out


def language(texts: list[str]) -> str:
    """KO or JA if a hundredth of the texts that aren't blank have Hangul or kana, else EN; Hangul wins ties."""
    some = [t for t in texts if not blank(t)]
    hangul = sum(re.search("[ᄀ-ᇿ㄰-㆏ꥠ-꥿가-퟿]", t) is not None for t in some)
    kana = sum(re.search("[ぁ-ヿㇰ-ㇿｦ-ﾝ]", t) is not None for t in some)
    if not some:
        return "EN"
    return "KO" if hangul * 100 >= len(some) and hangul >= kana else "JA" if kana * 100 >= len(some) else "EN"


def document_of(file_name: str | None, sheets: list[dict]) -> dict:
    out = {"fileName": file_name, "numberOfSheets": len(sheets), "sheets": sheets}
    return out | {"language": language(texts_of(out))}


def grid_of(cells: list[tuple[int, int, str]], merges: list[Region]) -> Grid:
    """A grid of sparse cells that hold their markers already."""
    height, width = max((r for r, _, _ in cells), default=-1) + 1, max((c for _, c, _ in cells), default=-1) + 1
    rows: dict[int, dict[int, str]] = defaultdict(dict)
    for r, c, v in cells:
        rows[r][c] = v
    return Grid([[rows[r].get(c, "") for c in range(width)] for r in range(height)], merges)
