"""Pictures and shapes drawn on the sheets of a workbook: where they lie, and what they hold.

Lengths are in the files' own unit, 12,700 to a point and 9,525 to a pixel. A place is a row or a column, from 0. Pictures
are passed on as they are stored: nothing here redraws them, so vector pictures keep their own type.
"""

from __future__ import annotations

import base64
import math
from bisect import bisect_left
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from xml.etree import ElementTree

from gridloom.sources.cell_text import sanitised

POINT, PIXEL = 12_700, 9_525
# Pixels of a character, characters of a usual column, points of a usual row, and the places that a sheet may have.
CHARACTER, USUAL_WIDTH, USUAL_HEIGHT = 7.0017, 8, 15
MOST_ROWS, MOST_COLUMNS = 1_048_576, 16_384
# Types of pictures by the ends of their names.
TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "dib": "image/dib",
    "tif": "image/tiff", "tiff": "image/tiff", "emf": "image/x-emf", "wmf": "image/x-wmf",
}
# First bytes of pictures.
FIRST_BYTES = (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF8", b"BM", b"II*\0", b"MM\0*")


class Places:
    """The lengths of all rows, or of all columns: own ones of some, a usual one of the others."""

    def __init__(self, own: dict[int, int], usual: int, most: int) -> None:
        self.own, self.usual, self.most = dict(sorted(own.items())), usual, most

    def start(self, place: int) -> int:
        """The length of all places before one."""
        own = [x for k, x in self.own.items() if k < place]
        return sum(own) + (place - len(own)) * self.usual

    def at(self, x: int) -> int:
        """The place that holds x; the last one beyond the end."""
        done = place = 0
        for k, length in self.own.items():
            if x < done + (k - place) * self.usual:
                break
            done, place = done + (k - place) * self.usual + length, k + 1
            if x < done:
                return k
        return min(place + max(x - done, 0) // self.usual, self.most - 1) if self.usual else self.most - 1


def column_length(characters: float) -> int:
    return max(math.floor(round(characters * 256) / 256 * CHARACTER + 0.5), 1) * PIXEL


def row_length(points: float) -> int:
    return round(points * POINT)


@dataclass
class Anchor:
    """Where something is drawn: cells of two corners, a cell and a size, or a position and a size."""

    first: tuple[int, int] | None = None  # row, column
    last: tuple[int, int] | None = None
    y: int = 0  # from the top of the first cell, or of the sheet
    x: int = 0
    height: int = 0
    width: int = 0

    def _ends(self, rows: Places, columns: Places) -> tuple[tuple[int, int], tuple[int, int]]:
        """Top and bottom, left and right as lengths from the sheet's corner."""
        y, x = (self.y + rows.start(self.first[0]), self.x + columns.start(self.first[1])) if self.first else (self.y, self.x)
        return (y, y + self.height), (x, x + self.width)

    def covered(self, rows: Places, columns: Places) -> tuple[int, int, int, int]:
        """First row, last row, first column and last column under it; corners in the wrong order cover nothing."""
        if self.first and self.last:
            return self.first[0], self.last[0], self.first[1], self.last[1]
        (top, bottom), (left, right) = self._ends(rows, columns)
        return rows.at(top), rows.at(bottom), columns.at(left), columns.at(right)

    def centre(self, rows: Places, columns: Places, last_row: int) -> tuple[int, int]:
        """The row and column of its middle. If it ends below the last row that the file has: the middle one of two corner cells,
        else its first cell, else the place of its middle."""
        if self.first and self.last:
            tall, wide = (self.first[0], self.last[0]), (self.first[1], self.last[1])
        else:
            (top, bottom), (left, right) = self._ends(rows, columns)
            upto = lambda places, x: places.at(max(x - 1, 0))  # noqa: E731  an end on an edge is the end of the place before
            tall = (self.first[0] if self.first else upto(rows, top), upto(rows, bottom))
            wide = (self.first[1] if self.first else upto(columns, left), upto(columns, right))
        if tall[0] > last_row + 1 or tall[1] > last_row:
            if self.first:
                return (sum(tall) // 2, sum(wide) // 2) if self.last else self.first
            return rows.at(self.y + self.height // 2), columns.at(self.x + self.width // 2)
        return _middle(rows, *tall), _middle(columns, *wide)


def _middle(places: Places, a: int, b: int) -> int:
    found = places.at((places.start(a) + places.start(b + 1)) // 2)
    return found if min(a, b) <= found <= max(a, b) else (a + b) // 2


@dataclass
class Drawn:
    """A picture (content and type) or a shape (text)."""

    anchor: Anchor
    text: str | None = None
    mime: str | None = None
    content: bytes | None = field(default=None, repr=False)


def anchor_of(e: ElementTree.Element) -> Anchor | None:
    """The anchor of a drawing's part, or None if it says too little."""
    number = lambda at, name: int(at.findtext(name, "0"))
    first, last, pos, ext = (e.find(n) for n in ("from", "to", "pos", "ext"))
    if first is not None and last is not None:
        return Anchor((number(first, "row"), number(first, "col")), (number(last, "row"), number(last, "col")))
    if ext is None or (first is None and pos is None):
        return None
    size = {"height": int(ext.get("cy", 0)), "width": int(ext.get("cx", 0))}
    if first is not None:
        return Anchor((number(first, "row"), number(first, "col")), None, number(first, "rowOff"), number(first, "colOff"), **size)
    return Anchor(y=int(pos.get("y", 0)), x=int(pos.get("x", 0)), **size)


def shape_text(e: ElementTree.Element) -> str | None:
    """The text of a shape, paragraph by paragraph."""
    body = e.find("txBody")
    lines = ["".join("\n" if r.tag == "br" else r.findtext("t", "") for r in p if r.tag in ("r", "fld", "br")) for p in (body if body is not None else ()) if p.tag == "p"]
    return sanitised("\n".join(lines).strip()).strip() or None


def drawn_of(root: ElementTree.Element, picture: Callable[[str], tuple[str | None, bytes | None]]) -> tuple[list[Anchor], list[Drawn]]:
    """All anchors of a drawing, and the pictures and shapes with a text in them; those of a group lie where the group does.
    picture: type and bytes by the id of a relation."""
    anchors, out = [], []

    def inside(e: ElementTree.Element, anchor: Anchor) -> None:
        for part in e:
            if part.tag == "grpSp":
                inside(part, anchor)
            elif part.tag == "sp" and (text := shape_text(part)):
                out.append(Drawn(anchor, text))
            elif part.tag == "pic" and (blip := part.find("blipFill/blip")) is not None:
                mime, content = picture(blip.get("embed", ""))
                out.append(Drawn(anchor, None, mime, content))

    for e in root:
        if (anchor := anchor_of(e)) is not None:
            anchors.append(anchor)
            inside(e, anchor)
    return anchors, out


def bitmap_file(bitmap: bytes) -> bytes | None:
    """A bitmap that lacks the header of a file, with it; None if it is none."""
    head = int.from_bytes(bitmap[:4], "little", signed=True) if len(bitmap) >= 40 else 0
    if not 40 <= head <= len(bitmap):
        return None
    bits, used = int.from_bytes(bitmap[14:16], "little"), int.from_bytes(bitmap[32:36], "little")
    colours = (used or 1 << bits) if bits <= 8 else 0
    return b"BM" + (14 + len(bitmap)).to_bytes(4, "little") + bytes(4) + (14 + head + 4 * colours & 0xFFFFFFFF).to_bytes(4, "little") + bitmap


def picture_file(mime: str | None, content: bytes | None) -> bytes | None:
    """The bytes of a picture as a file; None if they are no picture."""
    if content is None or mime == "image/dib":
        return bitmap_file(content) if content else None
    return content if mime in ("image/x-emf", "image/x-wmf") or content.startswith(FIRST_BYTES) else None


@dataclass(frozen=True)
class Images:
    """What pictures become in the cells below them: nothing (skip), a note of their type (base64), or the text that
    describe(base64, type) gives (hybrid, at most at_once calls at a time in a task). shapes: also the texts of shapes."""

    output: str = "skip"
    describe: Callable[[str, str], str] | None = None
    at_once: int = 16
    shapes: bool = False

    def __post_init__(self) -> None:
        if self.output not in ("skip", "base64", "hybrid"):
            raise ValueError(f"unknown output of images {self.output}")

    def texts(self, pictures: list[tuple[str, bytes]]) -> list[str]:
        """The texts of pictures (type and bytes); none without a describe."""
        if self.output == "base64":
            return [f"[image:{mime}:base64]" for mime, _ in pictures]
        if self.output == "skip" or not self.describe or not pictures:
            return []
        with ThreadPoolExecutor(self.at_once) as pool:
            return list(pool.map(lambda p: self.describe(base64.b64encode(p[1]).decode("ascii"), p[0]), pictures))


def nearest(x: int, shown: list[int]) -> int | None:
    """The index of the shown place next to x, of two as near the lower one."""
    if not shown:
        return None
    i = bisect_left(shown, x)
    return i if i == 0 or (i < len(shown) and shown[i] - x < x - shown[i - 1]) else i - 1
