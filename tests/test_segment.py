import duckdb
import pytest

import __spark_entry__ as entry
from gridloom import catalogue, functions as C
from gridloom.operators import graph as G
from gridloom.operators import segment as S
from gridloom.sources.delimited import parse_rows, read_delimited

SF = "/root/testdata/sf0.001"


def cells(spark, rows):
    return spark.createDataFrame([(1, r, c, v) for r, c, v in rows], "sheet_id long, r long, c long, v string")


def test_bands_split_at_two_blank_rows(spark):
    got = S.row_bands(cells(spark, [(0, 0, "A"), (2, 0, "B"), (5, 0, "C")])).orderBy("r").collect()
    assert [r.band for r in got] == [0, 0, 1]


def test_side_by_side_tables(spark):
    rows = [(r, c, "x") for r in (0, 1) for c in (0, 1, 3, 4)]
    got = S.three_level(cells(spark, rows)).orderBy("seg_ord").collect()
    assert [(r.c0, r.c1, r.n_cells) for r in got] == [(0, 1, 4), (3, 4, 4)]


def test_deferred_blocks_come_last(spark):
    segs = spark.createDataFrame([(1, 0, 0), (1, 1, 3), (1, 2, 0), (1, 3, 2)], "sheet_id long, seg_ord int, gap long")
    got = {r.seg_ord: r.out_ord for r in S.deferred_order(segs).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}


def test_scalars(spark):
    df = spark.createDataFrame([(0,), (25,), (26,), (701,), (702,), (16383,)], "n int")
    assert [r[0] for r in df.select(C.column_letters(df.n)).collect()] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    df = spark.createDataFrame([("■ x",), ("2024년",), ("plain",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(C.title_like(df.v)).collect()] == [True, True, False, False, False]


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "documents", "part", "orders", "pages", "customer"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(catalogue.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    order = sorted(got.columns)
    assert sorted(map(str, want.project(",".join(f'"{c}"' for c in order)).fetchall())) == sorted(str(tuple(r)) for r in got.select(*order).collect())


def test_graph_boxes():
    spans = [(0, 0, 1), (0, 4, 4), (1, 1, 4), (3, 0, 0)]
    assert G.component_boxes(spans) == [(0, 1, 0, 4), (3, 3, 0, 0)]
    assert G.swept([(0, 1, 0, 4), (2, 3, 0, 0), (9, 9, 0, 0)], 1) == [(0, 3, 0, 4), (9, 9, 0, 0)]


def test_delimited_rows(tmp_path, spark):
    assert parse_rows('a;"b ""x""\n;c"\r\n;\n\nd"e;"";f', ";") == [["a", 'b "x"\n;c'], ['d"e', "", "f"]]
    assert parse_rows('"open', ",") == [["open"]] and parse_rows("", ",") == []
    (tmp_path / "a.b.csv").write_text("n|m\n1|2\n3|4\n")
    row = read_delimited(spark, str(tmp_path)).first()
    assert (row.sheet_name, row.header_row_count, row.rows) == ("a.b", 1, [["n", "m"], ["1", "2"], ["3", "4"]])


def test_numerals_and_markers(spark):
    df = spark.createDataFrame([(0,), (10,), (101,), (2025,), (-5,), (10_000,), (100_000_001,)], "n long")
    assert [r[0] for r in df.select(C.cjk_number(df.n)).collect()] == ["零", "十", "零一百一", "零二千二十五", "負五", "一万", "一億一"]
    df = spark.createDataFrame([("^<",), ("a|b\r\nc",), (None,)], "v string")
    assert [r[0] for r in df.select(C.markdown_escape(df.v)).collect()] == ["", "a\\|b<br>c", ""]


def test_places_of_drawings(spark):
    from gridloom.operators.geometry import located, nearest_shown

    points = spark.createDataFrame([(1, x) for x in (0, 3, 4, 9)] + [(2, 5)], "sheet_id long, x long")
    got = {(r.sheet_id, r.x): r.near for r in nearest_shown(points, spark.createDataFrame([(1, 2), (1, 6)], "sheet_id long, at long")).collect()}
    assert got == {(1, 0): 2, (1, 3): 2, (1, 4): 2, (1, 9): 6, (2, 5): None}
    sizes = spark.createDataFrame([(1, 0, 10), (1, 1, 0), (1, 2, 5)], "sheet_id long, at long, size long")
    points = spark.createDataFrame([(1, i, x) for i, x in enumerate((0, 9, 10, 99))], "sheet_id long, point long, x long")
    assert sorted((r.x, r["at"], r.inside) for r in located(points, sizes).collect()) == [(0, 0, 0), (9, 0, 9), (10, 2, 0), (99, 2, 89)]
