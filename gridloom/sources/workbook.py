"""Workbook files (zipped XML): sheets of cells, merged regions, hidden rows and columns, and what is drawn on them.

A file is read by one task from its bytes: the format is an archive whose shared parts every sheet needs, so it can't be cut.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from dataclasses import dataclass, field
from functools import partial
from xml.etree import ElementTree

from gridloom.sources import drawings as G
from gridloom.sources.cell_text import BUILT_IN, Cell

# Fixed value: first bytes of the older container, which also holds encrypted files.
CONTAINER = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
#: Bytes that one part of an archive may hold when unpacked, and number of parts.
MOST_BYTES, MOST_PARTS = 100_000_000, 100_000


class WorkbookError(ValueError):
    """A file that can't be read."""


class EncryptedFile(WorkbookError):
    """The file needs a password."""


class InvalidFormat(WorkbookError):
    """The file is no workbook that can be read here."""


class TooLarge(WorkbookError):
    """A part of the file is beyond its bound."""


@dataclass
class RawSheet:
    name: str
    cells: dict[tuple[int, int], Cell] = field(default_factory=dict)
    rows: set[int] = field(default_factory=set)
    merges: list[tuple[int, int, int, int]] = field(default_factory=list)  # first row, last row, first column, last column
    hidden_rows: set[int] = field(default_factory=set)
    hidden_columns: set[int] = field(default_factory=set)
    drawn: list[tuple[int, int, int, int]] = field(default_factory=list)
    drawings: list[G.Drawn] = field(default_factory=list)
    heights: G.Places = field(default_factory=lambda: G.Places({}, G.row_length(G.USUAL_HEIGHT), G.MOST_ROWS))
    widths: G.Places = field(default_factory=lambda: G.Places({}, G.column_length(G.USUAL_WIDTH), G.MOST_COLUMNS))


def place(ref: str) -> tuple[int, int]:
    """Row and column of a reference like B3, both from 0."""
    m = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", ref)
    if not m:
        raise InvalidFormat(f"no cell reference: {ref}")
    column = 0
    for ch in m[1].upper():
        column = column * 26 + ord(ch) - 64
    return int(m[2]) - 1, column - 1


class _Archive:
    def __init__(self, content: bytes, most_bytes: int = MOST_BYTES) -> None:
        self.most = most_bytes
        if content.startswith(CONTAINER):
            names = content.decode("utf-16-le", "ignore") + content[1:].decode("utf-16-le", "ignore")
            if "EncryptedPackage" in names:
                raise EncryptedFile("the workbook is encrypted")
            raise InvalidFormat("binary workbooks can't be read")
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as e:
            raise InvalidFormat(str(e)) from e
        self.names = set(self.zip.namelist())
        if len(self.names) > MOST_PARTS:
            raise TooLarge(f"more than {MOST_PARTS} parts")

    def part(self, name: str) -> bytes | None:
        """The bytes of a part, or None."""
        if name not in self.names:
            return None
        if self.zip.getinfo(name).file_size > self.most:
            raise TooLarge(f"{name} is beyond {self.most} bytes")
        try:
            return self.zip.read(name)
        except (zipfile.BadZipFile, zlib.error) as e:
            raise InvalidFormat(f"{name}: {e}") from e

    def type_of(self, name: str) -> str | None:
        """The type that the archive states for a part, else that of its name's end."""
        ending, said = name.rpartition(".")[2].lower(), None
        types = self.xml("[Content_Types].xml")
        for e in types if types is not None else ():
            if e.get("PartName", "").strip("/") == name:
                return e.get("ContentType")
            if e.tag == "Default" and e.get("Extension", "").lower() == ending:
                said = e.get("ContentType")
        return said or G.TYPES.get(ending)

    def xml(self, name: str) -> ElementTree.Element | None:
        """A part without its namespaces, or None."""
        content = self.part(name)
        if content is None:
            return None
        try:
            root = ElementTree.fromstring(content)
        except ElementTree.ParseError as e:
            raise InvalidFormat(f"{name}: {e}") from e
        for e in root.iter():
            e.tag = e.tag.rpartition("}")[2]
            e.attrib = {k.rpartition("}")[2]: v for k, v in e.attrib.items()}
        return root

    def links(self, name: str) -> dict[str, tuple[str, str]]:
        """Kind and target of a part's relations by id."""
        folder, _, file = name.rpartition("/")
        root = self.xml(f"{folder}/_rels/{file}.rels")
        out = {}
        for e in root if root is not None else ():
            target = e.get("Target", "")
            parts = [] if target.startswith("/") else folder.split("/")
            for p in target.strip("/").split("/"):
                parts = parts[:-1] if p == ".." else [*parts, p]
            out[e.get("Id", "")] = (e.get("Type", "").rpartition("/")[2], "/".join(parts))
        return out


def _formats(book: _Archive) -> list[str]:
    """The number format of each style."""
    root = book.xml("xl/styles.xml")
    if root is None:
        return []
    own = {int(e.get("numFmtId", 0)): e.get("formatCode", "") for e in root.iter("numFmt")}
    styles = root.find("cellXfs")
    return [own.get(k) or BUILT_IN.get(k, "General") for k in (int(e.get("numFmtId", 0)) for e in (styles if styles is not None else ()))]


def _text(e: ElementTree.Element) -> str:
    """Text of a string item, without readings."""
    return "".join(t.text or "" for c in e if c.tag in ("t", "r") for t in ([c] if c.tag == "t" else c.iter("t")))


def _cell(e: ElementTree.Element, strings: list[str], formats: list[str]) -> Cell:
    style, kind = int(e.get("s", 0)), e.get("t", "n")
    f, v, inline = e.find("f"), e.find("v"), e.find("is")
    out = Cell(format=formats[style] if style < len(formats) else "General", formula=(f.text or "") if f is not None else None)
    raw = v.text if v is not None else None
    if kind == "inlineStr" and inline is not None:
        out.kind, out.value = "s", _text(inline)
    elif raw is None:
        return out
    elif kind == "s":
        out.kind, out.value = "s", strings[int(raw)]
    elif kind == "b":
        out.kind, out.value = "b", raw.strip() in ("1", "true")
    elif kind == "n":
        out.kind, out.value = "n", float(raw)
    else:
        out.kind, out.value = "e" if kind == "e" else "s", raw
    return out


def _draw(book: _Archive, part: str, sheet: RawSheet, pictures: bool) -> None:
    """What is drawn on a sheet; pictures: with the bytes of pictures."""

    def picture(source: dict[str, tuple[str, str]], key: str) -> tuple[str | None, bytes | None]:
        target = source.get(key, ("", ""))[1]
        return (book.type_of(target), book.part(target)) if pictures and target in book.names else (None, None)

    for kind, target in book.links(part).values():
        if kind == "drawing" and (root := book.xml(target)) is not None:
            anchors, found = G.drawn_of(root, partial(picture, book.links(target)))
            sheet.drawn += [a.covered(sheet.heights, sheet.widths) for a in anchors]
            sheet.drawings += found


def read_sheets(content: bytes, pictures: bool = False, most_bytes: int = MOST_BYTES) -> list[RawSheet]:
    """The sheets of a workbook's bytes. pictures: with the bytes of pictures; most_bytes: what a part may hold when unpacked."""
    book = _Archive(content, most_bytes)
    root = book.xml("xl/workbook.xml")
    if root is None:
        raise InvalidFormat("the archive holds no workbook")
    links, formats = book.links("xl/workbook.xml"), _formats(book)
    shared = book.xml("xl/sharedStrings.xml")
    strings = [_text(e) for e in shared.iter("si")] if shared is not None else []
    out = []
    for entry in root.iter("sheet"):
        part = links.get(entry.get("id", ""), ("", ""))[1]
        sheet, body = RawSheet(entry.get("name", "")), book.xml(part)
        try:
            _fill(sheet, body, strings, formats)
            _draw(book, part, sheet, pictures)
        except (ValueError, IndexError) as e:
            raise e if isinstance(e, WorkbookError) else InvalidFormat(f"{part}: {e}") from e
        out.append(sheet)
    return out


def _fill(sheet: RawSheet, body: ElementTree.Element | None, strings: list[str], formats: list[str]) -> None:
    if body is None:
        return
    yes = ("1", "true")
    widths, heights = sheet.widths.own, {}
    if (usual := body.find("sheetFormatPr")) is not None:
        sheet.widths.usual = G.column_length(float(usual.get("baseColWidth", G.USUAL_WIDTH)))
        sheet.heights.usual = G.row_length(float(usual.get("defaultRowHeight", G.USUAL_HEIGHT)))
    for col in body.iter("col"):
        if col.get("width"):
            widths |= dict.fromkeys(range(int(col.get("min", 1)) - 1, int(col.get("max", 1))), G.column_length(float(col.get("width", 1))))
        if col.get("hidden") in yes or float(col.get("width", 1)) == 0:
            sheet.hidden_columns.update(range(int(col.get("min", 1)) - 1, int(col.get("max", 1))))
    row = -1
    for r in body.iter("row"):
        row = int(r.get("r", row + 2)) - 1
        sheet.rows.add(row)
        if r.get("ht"):
            heights[row] = G.row_length(float(r.get("ht", 1)))
        if r.get("hidden") in yes or float(r.get("ht", 1)) == 0:
            sheet.hidden_rows.add(row)
        column = -1
        for c in r.iter("c"):
            column = place(c.get("r"))[1] if c.get("r") else column + 1
            sheet.cells[row, column] = _cell(c, strings, formats)
    sheet.heights.own, sheet.widths.own = dict(sorted(heights.items())), dict(sorted(widths.items()))
    for m in body.iter("mergeCell"):
        first, _, last = m.get("ref", "").partition(":")
        (r0, c0), (r1, c1) = place(first), place(last or first)
        sheet.merges.append((min(r0, r1), max(r0, r1), min(c0, c1), max(c0, c1)))


class Evaluator:
    """Results of formulas without a kept one: references, numbers, texts, + - * / ^ &, SUM, CONCATENATE, AVERAGE, MIN, MAX."""

    TOKEN = re.compile(r'\s*("(?:[^"]|"")*"|\$?[A-Za-z]{1,3}\$?\d+(?::\$?[A-Za-z]{1,3}\$?\d+)?|[A-Za-z.]+(?=\()|\d+\.?\d*(?:[eE][+-]?\d+)?|[-+*/^&(),])')

    def __init__(self, sheet: RawSheet) -> None:
        self.sheet, self.open = sheet, set()

    def value(self, at: tuple[int, int]) -> object:
        cell = self.sheet.cells.get(at)
        if cell is None:
            return 0.0
        if cell.kind or cell.formula is None:
            return cell.value if cell.value is not None else 0.0
        if at in self.open:
            raise ValueError("a formula that needs itself")
        self.open.add(at)
        try:
            return self(cell.formula)
        finally:
            self.open.discard(at)

    def __call__(self, formula: str) -> object:
        tokens, at = [], 0
        while at < len(formula.rstrip()):
            m = self.TOKEN.match(formula, at)
            if not m:
                raise ValueError(f"unknown formula: {formula}")
            tokens.append(m[1])
            at = m.end()
        self_tokens = iter([*tokens, ""])
        return _Parse(self, self_tokens).whole()


class _Parse:
    LEVELS = (("&",), ("+", "-"), ("*", "/"), ("^",))

    def __init__(self, book: Evaluator, tokens) -> None:
        self.book, self.tokens, self.now = book, tokens, next(tokens)

    def take(self) -> str:
        out, self.now = self.now, next(self.tokens, "")
        return out

    def whole(self) -> object:
        out = self.level(0)
        if self.now:
            raise ValueError(f"unexpected {self.now}")
        return out[0] if isinstance(out, list) else out

    def level(self, k: int) -> object:
        if k == len(self.LEVELS):
            return self.atom()
        left = self.level(k + 1)
        while self.now in self.LEVELS[k]:
            sign, right = self.take(), self.level(k + 1)
            if sign == "&":
                left = _shown(left) + _shown(right)
            else:
                a, b = _number(left), _number(right)
                left = a + b if sign == "+" else a - b if sign == "-" else a * b if sign == "*" else a / b if sign == "/" else a**b
        return left

    def atom(self) -> object:
        token = self.take()
        if token in "+-" and token:
            return _number(self.level(2)) * (-1 if token == "-" else 1)
        if token == "(":
            out = self.level(0)
            if self.take() != ")":
                raise ValueError("an open bracket")
            return out
        if token.startswith('"'):
            return token[1:-1].replace('""', '"')
        if re.fullmatch(r"[A-Za-z.]+", token) and self.now == "(":
            return self.call(token.upper())
        if re.match(r"\$?[A-Za-z]", token):
            first, _, last = token.partition(":")
            (r0, c0), (r1, c1) = place(first), place(last or first)
            values = [self.book.value((r, c)) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)]
            return values if last else values[0]
        return float(token)

    def call(self, name: str) -> object:
        self.take()
        found: list[object] = []
        while self.now != ")":
            x = self.level(0)
            found += x if isinstance(x, list) else [x]
            if self.now == ",":
                self.take()
            elif not self.now:
                raise ValueError("an open bracket")
        self.take()
        if name in ("CONCATENATE", "CONCAT"):
            return "".join(map(_shown, found))
        numbers = [float(x) for x in found if isinstance(x, (int, float)) and not isinstance(x, bool)]
        if name not in ("SUM", "AVERAGE", "MIN", "MAX"):
            raise LookupError(name)
        return sum(numbers) if name == "SUM" else sum(numbers) / len(numbers) if name == "AVERAGE" else (min if name == "MIN" else max)(numbers)


def _number(x: object) -> float:
    return float(x)  # type: ignore[arg-type]


def _shown(x: object) -> str:
    from gridloom.sources.cell_text import number_text

    return number_text(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
