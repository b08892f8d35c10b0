"""Drawings and images of workbooks, and the layout in one pass, on small literal cases."""

import base64
import io
import struct
import zipfile

import pytest

from gridloom.plans import documents as D
from gridloom.plans import layout as L
from gridloom.sources import drawings as G
from gridloom.sources import workbook as W

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PNG = b"\x89PNG\r\n\x1a\n" + b"\0" * 20
DIB = struct.pack("<iiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0"


def book(rows, drawing, media=(), extra="", merges=(), hidden=()):
    """Bytes of a workbook of one sheet with a drawing; media: name, bytes; pictures have the ids p0, p1, ..."""
    out = io.BytesIO()
    cells = "".join(f'<row r="{r + 1}"{" hidden=\"1\"" if r in hidden else ""} ht="15">' + "".join(f'<c r="{L.letters(c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row) if v) + "</row>" for r, row in enumerate(rows))
    merged = "".join(f'<mergeCell ref="{m}"/>' for m in merges)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<Types><Default Extension="png" ContentType="image/png"/><Override PartName="/xl/media/odd.bin" ContentType="image/gif"/></Types>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="S" sheetId="1" r:id="s"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="s" Type="x/worksheet" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{MAIN}">{extra}<sheetData>{cells}</sheetData><mergeCells>{merged}</mergeCells></worksheet>')
        z.writestr("xl/worksheets/_rels/s.xml.rels", '<Relationships><Relationship Id="d" Type="x/drawing" Target="../drawings/d.xml"/></Relationships>')
        z.writestr("xl/drawings/d.xml", f'<d xmlns:r="{REL}">{drawing}</d>')
        z.writestr("xl/drawings/_rels/d.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="p{i}" Type="x/image" Target="../media/{n}"/>' for i, (n, _) in enumerate(media)) + "</Relationships>")
        for name, content in media:
            if content is not None:
                z.writestr(f"xl/media/{name}", content)
    return out.getvalue()


def two(r0, c0, r1, c1, inside):
    return f"<twoCellAnchor><from><col>{c0}</col><row>{r0}</row></from><to><col>{c1}</col><row>{r1}</row></to>{inside}</twoCellAnchor>"


def one(r, c, height, width, inside=""):
    return f'<oneCellAnchor><from><col>{c}</col><colOff>0</colOff><row>{r}</row><rowOff>0</rowOff></from><ext cx="{width}" cy="{height}"/>{inside}</oneCellAnchor>'


def pic(i):
    return f'<pic><blipFill><blip r:embed="p{i}"/></blipFill></pic>'


def shown(content, **options):
    return L.with_images(W.read_sheets(content, True)[0], G.Images(**options)).rows


def test_lengths_and_places():
    p = G.Places({2: 50, 1: 0}, 10, 100)
    assert [p.start(k) for k in range(5)] == [0, 10, 10, 60, 70] and [p.at(x) for x in (0, 9, 10, 59, 60, 75, 10**9, -5)] == [0, 0, 2, 2, 3, 4, 99, 0]
    assert G.column_length(8) == 56 * 9525 and G.row_length(15) == 190500 and G.Places({}, 0, 7).at(1) == 6
    assert [G.nearest(x, [2, 4, 8]) for x in (0, 2, 3, 6, 7, 9)] == [0, 0, 0, 1, 2, 2] and G.nearest(1, []) is None


def test_what_is_covered():
    column, row = G.column_length(8), G.row_length(15)
    covered = lambda d: W.read_sheets(book([["a"]], d))[0].drawn
    assert covered(two(1, 1, 3, 2, "")) == [(1, 3, 1, 2)]
    assert covered(one(1, 1, row, column)) == [(1, 2, 1, 2)]  # an end on an edge covers the next place
    assert covered(one(1, 1, row - 1, column - 1)) == [(1, 1, 1, 1)]
    assert covered(f'<absoluteAnchor><pos x="{column * 3}" y="5"/><ext cx="1" cy="{row * 2}"/></absoluteAnchor><absoluteAnchor><pos x="1" y="1"/></absoluteAnchor>') == [(0, 2, 3, 3)]
    wide = W.read_sheets(book([["a"]], one(0, 0, 1, column), extra='<sheetFormatPr baseColWidth="20" defaultRowHeight="30"/><cols><col min="1" max="1" width="16"/></cols>'))[0]
    assert wide.drawn == [(0, 0, 0, 0)] and wide.heights.usual == 2 * row and wide.widths.own == {0: 112 * 9525}


def test_middles():
    rows, columns = G.Places({}, 10, 100), G.Places({1: 100}, 10, 100)
    assert G.Anchor((0, 0), (4, 2)).centre(rows, columns, 9) == (2, 1)
    assert G.Anchor((0, 0), (4, 2)).centre(rows, columns, 3) == (2, 1)  # below the last row: the middle one
    assert G.Anchor((0, 0), (4, 5)).centre(rows, columns, 3) == (2, 2)
    assert G.Anchor((1, 1), height=30, width=100).centre(rows, columns, 9) == (2, 1)
    assert G.Anchor((1, 1), height=30, width=100).centre(rows, columns, 2) == (1, 1)
    assert G.Anchor(y=20, x=120, height=40, width=20).centre(rows, columns, 0) == (4, 4)
    assert G.Anchor((3, 3), (1, 1)).centre(rows, columns, 9)[0] in range(1, 4)


def test_images_in_cells():
    cells = [["a", "b", "c"], ["d", "", "f"], ["g", "h", "i"]]
    content = book(cells, two(1, 1, 1, 1, pic(0)) + two(0, 0, 0, 0, f"<grpSp><grpSp>{pic(1)}</grpSp></grpSp>") + two(2, 2, 2, 2, pic(2)) + two(2, 0, 2, 0, pic(3)), [("x.png", PNG), ("odd.bin", b"GIF89a"), ("no.png", b"text"), ("gone.png", None)])
    assert shown(content) == cells
    assert shown(content, output="base64") == [["a\n[image:image/gif:base64]", "b", "c"], ["d", "[image:image/png:base64]", "f"], cells[2]]
    told = shown(content, output="hybrid", describe=lambda data, mime: f"{mime} {len(base64.b64decode(data))}")
    assert told[1][1] == f"image/png {len(PNG)}" and told[0][0] == "a\nimage/gif 6"
    assert shown(content, output="hybrid") == cells
    with pytest.raises(ValueError):
        G.Images("other")


def test_images_in_regions_and_hidden_rows():
    cells = [["a", "b"], ["c", "d"], ["e", "f"], ["", "g"]]
    merged = book(cells, two(1, 1, 1, 1, pic(0)) + two(1, 1, 1, 1, pic(0)), [("x.png", PNG)], merges=["A1:B2"])
    assert shown(merged, output="base64")[0][0] == "a" + "\n[image:image/png:base64]" * 2
    far = f'<absoluteAnchor><pos x="0" y="{G.row_length(15)}"/><ext cx="2" cy="2"/>{pic(0)}</absoluteAnchor>'
    assert shown(book(cells, far, [("x.png", PNG)], hidden=[1, 2]), output="base64")[1][0] == "c\n[image:image/png:base64]"  # drawn over, so shown
    assert L.with_images(W.read_sheets(book([], far, [("x.png", PNG)]), True)[0], G.Images("base64")).columns in (0, 1)


def test_texts_of_shapes():
    shape = "<sp><txBody><p><r><t>one </t></r><r><t>line</t></r></p><p><fld><t>two</t></fld><br/><r><t>three</t></r></p></txBody></sp><sp><txBody><p/></txBody></sp><sp/>"
    content = book([["a", "b"]], two(0, 1, 0, 1, shape) + two(0, 1, 0, 1, pic(0)), [("x.png", PNG)])
    assert [d.text for d in W.read_sheets(content)[0].drawings] == ["one line\ntwo\nthree", None]
    assert shown(content, output="base64") == [["a", "b\n[image:image/png:base64]"]]
    assert shown(content, output="base64", shapes=True) == [["a", "b\none line\ntwo\nthree\n[image:image/png:base64]"]]


def test_picture_files():
    found = G.picture_file("image/dib", DIB)
    assert found[:2] == b"BM" and struct.unpack("<I", found[2:6])[0] == len(found) == 58 and struct.unpack("<I", found[10:14])[0] == 54 and found[14:] == DIB
    palette = struct.pack("<iiiHHIIiiII", 40, 1, 1, 1, 8, 0, 4, 0, 0, 2, 0)
    assert struct.unpack("<I", G.bitmap_file(palette)[10:14])[0] == 62 and G.bitmap_file(b"x" * 39) is None and G.bitmap_file(b"\1" * 50) is None
    assert G.picture_file("image/x-emf", b"any") == b"any" and G.picture_file(None, b"any") is None and G.picture_file("image/png", None) is None and G.picture_file("image/dib", b"") is None


def test_parts_beyond_their_bound():
    content = book([["a"]], two(0, 0, 0, 0, pic(0)), [("x.png", PNG + bytes(3000))])
    with pytest.raises(W.TooLarge):
        W.read_sheets(content, True, 2000)
    assert len(W.read_sheets(content, False, 2000)) == 1


def test_files_with_images(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(book([["a", "b"], ["c", "d"]], two(1, 0, 1, 0, pic(0)), [("x.png", PNG)]))
    (got,) = D.read_documents(spark, str(tmp_path), images=G.Images("hybrid", lambda data, mime: f"a picture of {len(data)}")).collect()
    assert "c\\na picture of 40" in got.document
    (got,) = D.read_documents(spark, str(tmp_path), most_bytes=50).collect()
    assert got.error_kind == "TooLarge"


def once(rows, merges=()):
    found = L.sheet_document(0, "S", L.Grid([list(r) for r in rows], list(merges)), L.ONE_PASS)["elements"]
    return [(e["type"], e.get("text") or [[c["value"] for c in r["cells"]] for r in e["rows"]], e["startRow"], e["startCol"]) for e in found]


def test_one_pass():
    assert once([["a", "b"], ["1", "2"]]) == [("table", [["a", "b"], ["1", "2"]], 0, 0)]
    assert once([["■ T", ""], ["a", "b"], ["1", "2"]]) == [("heading", "■ T", 0, 0), ("table", [["a", "b"], ["1", "2"]], 0, 0)]
    assert once([["■ T", ""], ["", ""], ["", ""], ["a", "b"], ["1", "2"]]) == [("heading", "■ T", 0, 0), ("table", [["a", "b"], ["1", "2"]], 3, 0)]
    assert once([["■ T"]]) == [("heading", "■ T", 0, 0)] and once([["x"]]) == [("text", "x", 0, 0)]
    assert once([["a", "", "x", "y"], ["b", "", "1", "2"]]) == [("table", [["a"], ["b"]], 0, 0), ("table", [["x", "y"], ["1", "2"]], 0, 2)]
    assert once([["", ""], ["", ""]]) == [("table", [["", ""], ["", ""]], 0, 0)] and once([]) == []


def test_one_pass_waits_and_defers():
    # in one band, so that a stripe has a title, a gap and texts
    left = ["■ T", "", "", "a", "b", "c", "d", "e", "f"]
    right = ["x", "y", "z", "x", "y", "z", "x", "y", "z"]
    got = once([[a, "", b] for a, b in zip(left, right, strict=True)])
    assert got == [("table", [[x] for x in right], 0, 2), ("heading", "■ T", 0, 0), ("table", [["a"], ["b"], ["c"], ["d"], ["e"], ["f"]], 3, 0)]
    left = ["a", "b", "", "", "note", "", "", "p", "q"]
    got = once([[a, "", b] for a, b in zip(left, right, strict=True)])
    assert [e[:2] for e in got] == [("table", [["a"], ["b"]]), ("table", [["p"], ["q"]]), ("table", [[x] for x in right]), ("text", "note")]
    left = ["a", "b", "", "", "■ U", "p", "q", "", ""]
    got = once([[a, "", b] for a, b in zip(left, right, strict=True)])
    assert [e[0] for e in got] == ["table", "table", "heading", "table"] and got[-1][1] == [["p"], ["q"]]
    got = once([["top", ""], ["", ""], ["a", "b"], ["c", "d"]])
    assert got == [("text", "top", 0, 0), ("table", [["a", "b"], ["c", "d"]], 0, 0)]


def test_one_pass_headers():
    found = L.sheet_document(0, "S", L.Grid([["a", "b"], ["^", "c"], ["1", "2"]], [(0, 1, 0, 0)]), L.ONE_PASS)["elements"]
    assert found[0]["headerRowCount"] == 2 and found[0]["rows"][0]["cells"][0]["mergedDown"] == 1


def test_plain_table():
    assert L.plain_table([["", ""], ["a|b", ""], ["1\r\n2", "x"]]) == ("| a\\|b | empty header 1 |\n| 1<br>2 | x |\n", [["a\\|b", "empty header 1"]], 1)
    assert L.plain_table([["a|"], ["", "y"]], [(0, 1, 0, 0)], False) == ("| a| | empty header 1 |\n|  | y |\n", [["a|", "empty header 1"], ["", "y"]], 0)
    assert L.plain_table([["", ""]])[1] == [["Column 1", "Column 2"]] and L.plain_table([])[0] == "*Empty sheet*\n" and L.plain_table([[]])[0] == "*Empty table*\n"
    assert L.with_names([["", "a", ""], ["x", "", ""], ["y"]]) == [["header_1", "a", "header_2"], ["x", "", ""], ["y", "", ""]]


def test_query_in_one_pass(spark):
    import json

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    got = entry.queries()["doc_one_pass"](spark, sf).collect()
    assert len(got) == entry.queries()["grid_merged"](spark, sf).select("sheet_id").distinct().count() and all(json.loads(r.json)["sheets"][0]["elements"] for r in got)
