"""Workbook files, cell texts, layout and rendering, on small literal cases."""

import io
import json
import zipfile

import pytest

from gridloom.plans import documents as D
from gridloom.plans import layout as L
from gridloom.plans import render as R
from gridloom.sources import cell_text as T
from gridloom.sources import workbook as W
from gridloom.sources.delimited import parse_rows, sniffed

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(sheets, formats=(), strings=()):
    """Bytes of a workbook; sheets: (name, body of the worksheet, drawing or None)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, (n, *_) in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Type="x/worksheet" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        own = "".join(f'<numFmt numFmtId="{164 + i}" formatCode="{f}"/>' for i, f in enumerate(formats))
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts>{own}</numFmts><cellXfs><xf numFmtId="0"/>{"".join(f"<xf numFmtId=\"{164 + i}\"/>" for i in range(len(formats)))}</cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si><t>{x}</t></si>" for x in strings) + "</sst>")
        for i, (_, body, *drawing) in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{MAIN}">{body}</worksheet>')
            if drawing:
                z.writestr(f"xl/worksheets/_rels/s{i}.xml.rels", '<Relationships><Relationship Id="d" Type="x/drawing" Target="../drawings/d.xml"/></Relationships>')
                z.writestr("xl/drawings/d.xml", drawing[0])
    return out.getvalue()


def rows_xml(rows, merges=(), attributes=None):
    def cell(r, c, v):
        ref = f"{L.letters(c)}{r + 1}"
        if v.startswith("<"):
            return v.replace("<c", f'<c r="{ref}"', 1)
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    body = "".join(f'<row r="{r + 1}" {(attributes or {}).get(r, "")}>{"".join(cell(r, c, v) for c, v in enumerate(row) if v)}</row>' for r, row in enumerate(rows))
    merged = "".join(f'<mergeCell ref="{m}"/>' for m in merges)
    return f"<sheetData>{body}</sheetData><mergeCells>{merged}</mergeCells>"


def grid(rows, merges=()):
    return L.Grid([list(r) for r in rows], list(merges))


def document(*elements, merges=(), language="EN"):
    return {"fileName": "a.xlsx", "numberOfSheets": 1, "language": language, "sheets": [{"sheetIndex": 0, "sheetName": "S", "elements": list(elements), "mergeRegions": list(merges)}]}


def table(rows, head=1, row=0, column=0, column_paths=None, row_paths=None, spans=None):
    out = L.table_element([list(r) for r in rows], L.Headers(count=head, column_paths=column_paths or {}, row_paths=row_paths or {}), row, column)
    for (r, c), (right, down) in (spans or {}).items():
        out["rows"][r]["cells"][c] |= {"mergedRight": right, "mergedDown": down}
    return out


def told(element, **options):
    return json.loads(R.to_json(document(element), **options))["sheets"][0]["elements"][0]


def test_simple_workbook():
    found = D.workbook_document(workbook([("TestSheet", rows_xml([["Name", "Age", "City"], ["Alice", "<c><v>30</v></c>", "Seoul"], ["Bob", "<c><v>25</v></c>", "Tokyo"]]))]))
    (e,) = found["sheets"][0]["elements"]
    assert e["type"] == "table" and [c["value"] for c in e["rows"][1]["cells"]] == ["Alice", "30", "Seoul"]
    text = R.to_markdown(found)
    assert "## TestSheet" in text and "| 2 | Alice | 30 | Seoul |" in text and "_Language: EN_" in text


def test_formulas_and_truth_values():
    cells = [["Value A", "Value B", "Sum"], ["<c><v>10</v></c>", "<c><v>20</v></c>", "<c><f>A2+B2</f></c>"], ["<c t='b'><v>1</v></c>", "<c t='b'><f>A3</f><v>0</v></c>", "<c><f>NOSUCH(1)</f></c>"], ["<c t='e'><v>#DIV/0!</v></c>", '<c><f>CONCATENATE("a",A2)</f></c>', "<c><f>SUM(A2:B2)*2</f><v>2.5</v></c>"], ["<c><f>B5</f></c>", "<c><f>A5</f></c>", "<c><f>1/0</f></c>"]]
    sheet = W.read_sheets(workbook([("S", rows_xml(cells))]))[0]
    texts = W.Evaluator(sheet)
    assert [[T.cell_text(sheet.cells[r, c], texts) for c in range(3)] for r in range(1, 5)] == [["10", "20", "30"], ["TRUE", "false", "Formula: NOSUCH(1)"], ["#DIV/0!", "a10", "2.5"], ["Formula: B5", "Formula: A5", "Formula: 1/0"]]


def test_formats():
    say = lambda x, f: T.cell_text(T.Cell("n", x, f))
    assert [say(x, f) for x, f in ((1234.5, "#,##0.00"), (0.256, "0.0%"), (-3.0, "0;(0)"), (1e6, "0.00E+00"), (3.0, '0" kg"'), (0.1, "General"), (5.0, "@"))] == ["1,234.50", "25.6%", "(3)", "1.00E+06", "3 kg", "0.1", "5"]
    assert [say(44927.0, f) for f in ("yyyy-mm-dd", "[$-409]dd/mm/yyyy", "m/d/yy", 'yyyy"년" m"월"')] == ["2023-01-01", "01/01/2023", "1/1/23", "2023년 1월"]
    assert say(44927.75, "hh:mm:ss") == "18:01:00"  # minutes become months
    assert say(5.0, "[Red]0") == "0" and say(2025.0, "[DBNum1]0") == "零二千二十五" and say(-1.5, "[DBNum1]0") == "負一点五"
    assert [T.number_text(x) for x in (3.0, 1.5, 123456789.5, 0.0001)] == ["3", "1.5", "1.234567895E8", "1.0E-4"]
    assert T.date_pattern("[Color1]mm/dd/yyyy hh:mm AM/PM") == "MM/dd/yyyy HH:MM a"
    assert [T.cjk_numeral(n) for n in (0, 10, 11, 20, 101, 110, 2025, 10**8)] == ["零", "十", "十一", "二十", "零一百一", "一百一十", "零二千二十五", "一億"]
    assert T.serial_date(1).strftime("%Y-%m-%d") == "1900-01-01" and T.serial_date(61).strftime("%Y-%m-%d") == "1900-03-01"
    assert T.sanitised("a​b\x07 reserved-12xAF\n") == "ab"


def test_hidden_rows_merges_and_drawings():
    rows = [["T", "x", "", ""], ["h", "", "", ""], ["a", "b", "", ""], ["", "", "", ""], ["e", "", "", ""]]
    body = '<cols><col min="2" max="2" hidden="1" width="9"/></cols>' + rows_xml(rows, ["A1:C1", "A2:A3"], {1: 'hidden="1"'})
    sheet = W.read_sheets(workbook([("S", body)]))[0]
    found, at, columns = L.visible_grid(sheet)
    assert (at, columns) == ([0, 2, 3, 4], [0, 2])
    assert found.rows == [["T", "<"], ["^", ""], ["", ""], ["e", ""]] and found.merges == [(0, 0, 0, 1), (1, 1, 0, 0)]
    drawing = "<d><twoCellAnchor><from><row>1</row><col>1</col></from><to><row>1</row><col>4</col></to></twoCellAnchor></d>"
    found, at, columns = L.visible_grid(W.read_sheets(workbook([("S", body, drawing)]))[0])
    assert (at, columns) == ([0, 1, 2, 3, 4], [0, 1, 2, 3, 4])
    assert L.visible_grid(W.read_sheets(workbook([("S", rows_xml([], ["B2:C3"]))]))[0])[0].merges == [(1, 2, 1, 2)]


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "bad.xlsx").write_bytes(b"no archive")
    (tmp_path / "locked.xlsx").write_bytes(W.CONTAINER + b"\0" * 8 + "EncryptedPackage".encode("utf-16-le"))
    (tmp_path / "good.xlsx").write_bytes(workbook([("A", rows_xml([["a", "b"], ["c", "d"]])), ("B", rows_xml([]))]))
    (tmp_path / "t.csv").write_text("n|m\n1|2\n")
    got = {r.file_name: r for r in D.read_documents(spark, str(tmp_path)).collect()}
    assert {k: (r.error_kind, r.sheets) for k, r in got.items()} == {"bad.xlsx": ("InvalidFormat", None), "locked.xlsx": ("EncryptedFile", None), "good.xlsx": (None, 2), "t.csv": (None, 1)}
    docs = D.read_documents(spark, str(tmp_path))
    text = {r.file_name: r.t for r in docs.select("file_name", D.rendered(docs.document, "markdown").alias("t")).collect()}
    assert text["bad.xlsx"] is None and "## t" in text["t.csv"] and "| 2 | 1 | 2 |" in text["t.csv"] and text["good.xlsx"].endswith("## B")
    with pytest.raises(Exception, match="InvalidFormat|EncryptedFile"):
        D.read_documents(spark, str(tmp_path), permissive=False).collect()


def test_delimited_texts():
    assert parse_rows('"a\r"\r\nb', ",") == [["a"], ["b"]] and parse_rows(" \n,\nx", ",") == [[" "], ["x"]]
    assert [sniffed(x) for x in ("Name\tAge\nAlice\t30", "a,b;c\n1,2", "a;b\n1;2", "", "a|b\n1")] == ["\t", ",", ";", ",", ","]
    found = D.delimited_document(b"a,b\n1,2")
    assert found["sheets"][0]["sheetName"] == "Sheet1" and found["language"] == "EN" and D.is_delimited("x.TSV") and not D.is_delimited("csv") and not D.is_delimited(None)


def test_segments_by_gaps():
    at = lambda g, **o: [(s.row, s.column, s.gap, s.grid.rows) for s in L.by_gaps(grid(g), **o)]
    assert at([["A", "B"], ["", ""], ["", ""], ["C", "D"]]) == [(0, 0, 0, [["A", "B"], ["", ""]]), (3, 0, 1, [["C", "D"]])]
    assert [(r, c) for r, c, *_ in at([["A", "B", "", "X", "Y"], ["C", "D", "", "Z", "W"]])] == [(0, 0), (0, 3)]
    assert len(at([["A"], ["B"], [""], [""], ["C"]])) == 2 and len(at([["", ""], ["", ""]])) == 1
    assert len(at([["A"], [""], ["B"]], band_rows=1, stripe_rows=1)) == 2
    first, last = L.by_gaps(grid([["H", "<", "V"], [""] * 3, [""] * 3, ["X", "Y", "Z"]], [(0, 0, 0, 1)]))
    assert first.grid.merges == [(0, 0, 0, 1)] and last.grid.merges == []
    assert [s.column for s in L.by_gaps(grid([["", "", "x"]]), offsets=False)] == [0]
    assert L.isolated([["", ""], ["", "x"], ["", ""]]) == (["x"], []) and L.isolated([["a", ""], ["b", "c"]])[0] == []


def test_segments_by_graph():
    g = grid([["a", "b", "", "x"], ["c", "", "", ""], [""] * 4, [""] * 4, ["", "q", "", ""]])
    assert [(s.row, s.column, s.gap) for s in L.by_graph(g)] == [(0, 0, 0), (0, 3, 0), (4, 1, 3)]
    assert len(L.by_graph(grid([["a"], [""], ["b"]]))) == 2 and len(L.by_graph(grid([["a", ""], ["", "b"]]))) == 1 and len(L.by_graph(grid([["a", ""], ["", "b"]]), None)) == 2


def test_headers():
    s = lambda rows, merges=(): L.Segment(grid(rows, merges))
    assert L.single_row(s([["", ""], ["a", ""]])) == L.Headers(1, 1) and L.single_row(s([[""]])).count == 0
    two = s([["Category", "Q1", "Q2"], ["^", "Jan-Mar", "Apr-Jun"], ["x", "1", "2"], ["y", "3", "4"]], [(0, 1, 0, 0)])
    assert (L.merge_aware(two).start, L.merge_aware(two).count) == (0, 2)
    banner = s([["Report", "<", "<", "<", "<"], ["^<"] * 5, ["Name", "H1", "<", "H2", "<"], ["^", "Q1", "Q2", "Q3", "Q4"], ["a", "1", "2", "3", "4"]], [(0, 0, 0, 4), (2, 3, 0, 0), (2, 2, 1, 2), (2, 2, 3, 4)])
    found = L.merge_aware(banner)
    assert (found.start, found.count) == (2, 2) and found.column_paths[1] == ["H1", "Q1"] and found.column_paths[4] == ["H2", "Q4"] and 0 not in found.column_paths
    nested = s([["Cat", "All", "<", "<", "<"], ["^", "H1", "<", "H2", "<"], ["^", "Q1", "Q2", "Q3", "Q4"], ["a", "1", "2", "3", "4"], ["b", "5", "6", "7", "8"]], [(0, 2, 0, 0), (0, 0, 1, 4), (1, 1, 1, 2), (1, 1, 3, 4)])
    assert L.hierarchy_aware(nested).column_paths == {1: ["All", "H1", "Q1"], 2: ["All", "H1", "Q2"], 3: ["All", "H2", "Q3"], 4: ["All", "H2", "Q4"]}
    sides = s([["R", "N", "v"], ["EU", "FR", "1"], ["^", "DE", "2"], ["AS", "JP", "3"]], [(1, 2, 0, 0), (1, 1, 1, 1), (2, 3, 1, 1)])
    assert L.hierarchy_aware(sides).row_paths == {0: ["EU", "FR"], 1: ["EU", "DE"], 2: ["AS", "DE"]}
    assert L.with_placeholders([["", "a", ""], ["x", "", ""]]) == [["header_1", "a", "header_2"], ["x", "header_3", ""]]


def test_titles():
    assert [L.title_like(t) for t in ("■ x", "- x", "2024", " 2024년 표", "~ a", "년도", "패널 A", "\t• x", "　■", "plain", "", "2024 x", "패널" + "x" * 20)] == [True] * 9 + [False] * 4
    assert L.detect_title([["■ T", ""], ["", ""], ["a", "b"]]) == ("■ T", [["a", "b"]]) and L.detect_title([["a"], ["b"], ["■"]]) is None
    assert L.titled(" x ") == "◾ x" and L.titled("■ x") == "■ x"


def test_elements():
    make = lambda rows, headers=None, row=0: L.classify(L.Segment(grid(rows), row, 1), headers or L.Headers(0, 1))
    assert make([["■ Title", ""]])["type"] == "heading" and make([["", ""]]) == L.text_element("text", "", 0, 1)
    assert make([["", "note"]], row=3) == L.text_element("text", "note", 3, 1)
    assert make([["■ T", ""], ["", "body"]])["text"] == "■ T\nbody"
    assert make([["see below"], ["more text"]])["text"] == "see below\nmore text"
    kept = make([["Report", "", "", ""], ["", "", "", ""], ["a", "b", "c", "d"], ["1", "2", "3", "4"]], L.Headers(2, 1), 10)
    assert kept["type"] == "table" and kept["startRow"] == 12 and len(kept["rows"]) == 2
    lost = make([["■ T", "", ""], ["a", "b", "c"], ["1", "2", "3"]], row=5)
    assert lost["startRow"] == 6 and lost["rows"][0]["cells"][0]["value"] == "a"


@pytest.mark.parametrize(("gaps", "order"), [([0, 0], [0, 1]), ([0, 3, 0], [0, 1, 2]), ([0, 2], [0, 1]), ([3, 3, 3], [0, 1, 2]), ([0, 3, 3, 0], [0, 2, 3, 1])])
def test_order(gaps, order):
    blocks = [L.Block(L.Segment(grid([["x"]]), i, 0, g), {"i": i}) for i, g in enumerate(gaps)]
    assert [b.element["i"] for b in L.deferred(blocks)] == order and L.in_sequence(blocks) == blocks


@pytest.mark.parametrize("name", sorted(L.PRESETS))
def test_second_table_has_its_place(name):
    g = grid([["A", "B"], ["1", "2"], ["", ""], ["", ""], ["X", "Y"], ["3", "4"]])
    found = L.sheet_document(0, "Data", g, L.PRESETS[name])
    assert [e["startRow"] for e in found["elements"]] == [0, 4]
    own = L.Strategy(segment=lambda g: [L.Segment(g)], headers=lambda s: L.Headers(0, 0))
    assert len(L.sheet_document(0, "Data", g, own)["elements"]) == 1 and L.sheet_document(0, "E", grid([]), L.PRESETS[name])["elements"] == []


def test_spans_and_regions():
    found = L.sheet_document(0, "S", grid([["H", "<", "V"], ["a", "b", "c"], ["^", "d", "e"]], [(0, 0, 0, 1), (1, 2, 0, 0)]), L.PRESETS["balanced"])
    (e,) = found["elements"]
    assert e["rows"][0]["cells"][0]["mergedRight"] == 1 and e["rows"][1]["cells"][0]["mergedDown"] == 1
    assert found["mergeRegions"] == [{"cell": "A1", "rowSpan": 1, "colSpan": 2}, {"cell": "A2", "rowSpan": 2, "colSpan": 1}]
    assert [R.region_ref(r) for r in found["mergeRegions"]] == ["A1:B1", "A2:A3"]


def test_language():
    assert [L.language(x) for x in (["가", "a"], ["あ"], ["가", "あ"], ["a"], [], ["", " "])] == ["KO", "JA", "KO", "EN", "EN", "EN"]
    assert R.language_sentence("KO") == "This document is written in Korean." and R.language_sentence("KO", "EN", "XX") == "This data was extracted from English and Korean Excel documents."
    assert R.language_sentence("XX") == "This document is written in English."


def test_json_of_sections_and_headers():
    e = R.Table(table([["a", "b"], ["1", "2"]], row=6, column=1)).told(False)
    assert (e["startRow"], e["startCol"], e["range"], e["leadingBlankColCount"], e["sheetColCount"], e["rows"][0]) == (7, 2, "B7:C8", 1, 3, ["", "a", "b"])
    both = json.loads(R.to_json(document(L.text_element("heading", "Sales", 4, 1), table([["a", "b"], ["1", "2"]], row=6, column=1))))["sheets"][0]["elements"][1]
    assert both["section"] == {"text": "Sales", "cell": "B5"} and both["sectionHeaderCells"] == {"Sales > a": "B7", "Sales > b": "C7"}
    wide = json.loads(R.to_json(document(L.text_element("heading", "W", 0, 0), table([[f"h{i}" for i in range(81)], ["1"] * 81], row=1))))["sheets"][0]["elements"][1]
    assert "section" in wide and "columns" in wide and "sectionHeaderCells" not in wide
    far = json.loads(R.to_json(document(L.text_element("heading", "F", 0, 0), table([["a"]], row=6))))["sheets"][0]["elements"][1]
    assert "section" not in far
    heads = told(table([["Cat", "Q1", "<", "Q2", "<"], ["^", "Jan", "Feb", "Apr", "May"], ["x", "1", "2", "3", "4"]], 2, spans={(0, 1): (1, 0), (0, 3): (1, 0)}))
    assert (heads["range"], heads["endCol"], heads["resolvedHeaders"]["2"], heads["headerCells"]["2"]) == ("A1:G3", 7, "Q1 > Jan", "B2")
    clean = told(table([["a", "b"], ["1", "2"], ["3", "4"]], 2, column_paths={0: ["<", "A", "^"], 1: ["^"]}))
    assert clean["columnPaths"] == {"1": ["A"]}


def test_json_of_matrices_and_rows():
    e = told(table([["Role", "R", "W", "X"], ["^", "r", "w", "x"], ["admin", "O", "O", "O"], ["user", "O", "X", "X"]], 2, column=1))
    assert [(m["row"], m["key"]) for m in e["matrixRows"]] == [(3, "admin"), (4, "user")] and list(e["matrixRows"][1]["groups"]) == ["O", "X"]
    assert e["matrixTransitions"] == [{"fromRow": 3, "fromKey": "admin", "toRow": 4, "toKey": "user", "changes": {"O->X": ["W > w", "X > x"]}}]
    assert "matrixRows" not in told(table([["R", "a"], ["x", "O"], ["y", "X"]]))
    column = table([["ID"], ["A-100"], ["A-101"]], row=9, column=1)
    for r, i in zip(column["rows"], (0, 3, 4), strict=True):
        r["rowIndex"] = i
    one = told(column)
    assert one["rowNumbers"] == [10, 13, 14] and one["rowAnchors"][0] == {"row": 13, "cell": "B13", "label": "A-100"}
    tall = told(table([["a", "b", "c"], ["x", "y", "z"], ["^", "u", "v"]], row=4, column=1, spans={(1, 0): (0, 1)}))
    assert tall["rowNumbers"] == [5, 6, 7] and [a["label"] for a in tall["rowAnchors"]] == ["x", "u"]
    assert tall["merges"] == [{"cell": "B6", "rowSpan": 2, "value": "x"}] and tall["mergedRanges"] == ["B6:B7"] and tall["mergedRangeDetails"] == [{"range": "B6:B7", "cell": "B6", "value": "x"}]
    rows = told(table([["a", "<"], ["1", "2"]], row=2, spans={(0, 0): (1, 0)}), layout="row_object")
    assert rows["rows"] == [{"row": 3, "cells": [{"v": "a", "mr": 1}, ""]}, {"row": 4, "cells": ["1", "2"]}] and "rowNumbers" not in rows
    with pytest.raises(ValueError):
        R.to_json(document(), layout="other")


def test_json_text():
    text = R.to_json(document(L.text_element("heading", "A", 0, 0), merges=[{"cell": "A1", "rowSpan": 1, "colSpan": 2}]))
    assert text == '{\n  "language" : "EN",\n  "sheets" : [ {\n    "sheetName" : "S",\n    "elements" : [ {\n      "type" : "heading",\n      "text" : "A",\n      "level" : 2,\n      "cell" : "A1"\n    } ],\n    "mergeRegions" : [ "A1:B1" ]\n  } ]\n}'
    assert R.pretty({"a": [], "b": {}}) == '{\n  "a" : [ ],\n  "b" : { }\n}'
    helped = json.loads(R.to_json(document(table([["a", "b"]] * 3, 2, column_paths={0: ["x", "y"]}), merges=[{"cell": "A1", "rowSpan": 1, "colSpan": 2}]), assist=True))
    assert helped["prompt"].startswith("This document is written in English.\n- `sheets`") and R.SHEET_PATHS in helped["sheets"][0]["prompt"] and helped["sheets"][0]["prompt"].endswith(R.SHEET_MERGES)
    assert R.SHEET_ROWS in json.loads(R.to_json(document(), "row_object", True))["sheets"][0]["prompt"]


def test_markdown():
    assert R.markdown_table(table([["Name", "Age"], ["Alice", "30"]])) == "| 1 | Name | Age |\n| --- | --- | --- |\n| 2 | Alice | 30 |"
    assert "H [merged 1x3]" in R.markdown_table(table([["H", "<", "<"]], spans={(0, 0): (2, 0)})) and "[merged 3x2]" in R.markdown_table(table([["H", "x"]], spans={(0, 0): (1, 2)}))
    deep = R.markdown_table(table([["a", "b"], ["c", "d"], ["1", "2"]], 2, 3, 1, {1: ["a", "c"]}, {0: ["p", "q"]}))
    assert deep.startswith("_Table starts at row 4, col 2_\n_Headers: 2 rows_\n_Column hierarchy:_\n- Col 2: a > c\n\n| 4 | | a | b |") and deep.endswith("| 6 | | _p > q_ 1 | 2 |")
    assert R.markdown_table(table([])) == "*Empty table*" and R.markdown_cell("a|b\r\nc") == "a\\|b<br>c" and R.markdown_cell("<^") == ""
    assert R.markdown_element({"type": "heading", "text": "x", "level": 9}) == "###### x" and R.markdown_element({"type": "note", "text": "n"}) == "> n"
    images = [{"type": "image"}, {"type": "image", "base64": "x", "mimeType": "image/png"}, {"type": "image", "base64": "x"}, {"type": "image", "description": "d"}]
    assert [R.markdown_element(x) for x in images] == ["[Image]", "[Image: image/png]", "[Image: unknown]", "d"]
    text = R.to_markdown(document(L.text_element("text", "t", 0, 0), merges=[{"cell": "A1", "rowSpan": 2, "colSpan": 1}]), assist=True, with_name=True)
    assert text.startswith("# a.xlsx\n\n_Prompt_\nThis document is written in English.\n") and "_Merged: A1:A2_\n\nt" in text and R.SHEET_MARKDOWN_MERGES in text
    with pytest.raises(ValueError):
        R.to_markdown(document(), layout="row_object")


def test_raw_json_comes_back():
    found = document(table([["a", "b"], ["1", "2"]], 1, column_paths={1: ["x", "y"]}, row_paths={0: ["p", "q"]}))
    assert D.from_json(D.raw_json(found)) == found and D.from_json(D.raw_json(found, pretty=True)) == found
    with pytest.raises(ValueError):
        D.strategy_of("none")
    with pytest.warns(UserWarning):
        D.strategy_of("complex")


def test_document_queries(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    sheets = entry.queries()["grid_merged"](spark, sf).select("sheet_id").distinct().count()
    for name, column in (("doc_json", "json"), ("doc_row_objects", "json"), ("doc_markdown", "markdown")):
        got = entry.queries()[name](spark, sf).collect()
        assert len(got) == len({r.sheet_id for r in got}) == sheets and all(r[column] for r in got)
        if column == "json":
            values = sorted(str(c["v"] if isinstance(c, dict) else c) for r in got for e in json.loads(r.json)["sheets"][0]["elements"] if e["type"] == "table" for row in e["rows"] for c in (row["cells"] if isinstance(row, dict) else row))
            assert sum(v.isdigit() for v in values) > 4000
