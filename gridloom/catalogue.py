"""Queries of the spreadsheet-structure operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import functions as C
from gridloom.operators import geometry as P
from gridloom.operators import graph as G
from gridloom.operators import language as L
from gridloom.operators import merges as M
from gridloom.operators import segment as S
from gridloom.operators import visible as V
from gridloom.plans import documents as D
from gridloom.plans.layout import ONE_PASS, Strategy
from gridloom.sources import all_regions, delimited, whole_grid


def seg_row_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = S.row_bands(whole_grid(spark, sf_dir))
    return bands.groupBy("sheet_id", "band").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.count("*").alias("n_rows"))


def seg_column_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = whole_grid(spark, sf_dir)
    stripes = S.column_stripes(cells.join(S.row_bands(cells), ["sheet_id", "r"]))
    return stripes.groupBy("sheet_id", "band", "stripe").agg(F.min("c").alias("c0"), F.max("c").alias("c1"))


def seg_three_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.three_level(whole_grid(spark, sf_dir))


def ord_deferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.deferred_order(S.three_level(whole_grid(spark, sf_dir))).select("sheet_id", "seg_ord", "deferred", "out_ord")


def seg_isolated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.isolated_cells(whole_grid(spark, sf_dir))


def hdr_single_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.header_row(whole_grid(spark, sf_dir))


def fn_column_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % 16384).cast("int").alias("n")).distinct()
    return ids.select("n", C.column_letters(F.col("n")).alias("letters"))


def fn_markdown_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", C.markdown_escape(F.col("text")).alias("cell"))


def cls_title_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "v"))
    return docs.groupBy("doc_id").agg(F.sum(C.title_like(F.col("v")).cast("long")).alias("titles"), F.count("*").alias("lines"))


def seg_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graph_segments(whole_grid(spark, sf_dir))


def seg_graph_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.graph_segments(whole_grid(spark, sf_dir), None)


def grid_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merged_grid(whole_grid(spark, sf_dir), all_regions(spark, sf_dir))


def seg_merge_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.clipped_merges(S.three_level(whole_grid(spark, sf_dir)), all_regions(spark, sf_dir))


def hdr_merge_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.header_rows(grid_merged(spark, sf_dir), all_regions(spark, sf_dir))


def fn_range_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = all_regions(spark, sf_dir)
    return m.select("sheet_id", "ord", C.range_ref(*[F.col(c) for c in ("r0", "c0", "r1", "c1")]).alias("region"))


def lang_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode_outer(F.split("text", "\n")).alias("v"))
    return L.languages(docs)


def fn_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", C.sanitize(F.col("html")).alias("v"))


def fn_cjk_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") * F.col("o_custkey") - 5000).alias("n")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(n).distinct().select("n", C.cjk_number(F.col("n")).alias("numeral"), C.cjk_digits(F.col("n").cast("string")).alias("digits"))


def fn_sniff_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", C.sniff_delimiter(F.col("text")).alias("delimiter"))


def src_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of line items written as delimited text, one text an order, and read back."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(";", F.col("l_linenumber").cast("string"), quote("l_linestatus"), F.col("l_returnflag"))
    texts = items.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\r\n").alias("text"))
    rows = delimited.delimited_rows(texts).select("l_orderkey", F.explode("rows").alias("f"))
    return rows.select("l_orderkey", *[F.col("f")[i].alias(n) for i, n in enumerate(("line", "status", "flag"))])


def _hidden(spark: SparkSession, sf_dir: str, places: str) -> DataFrame:
    """Hidden places of all sheets, by a rule on their numbers."""
    sheets = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr("o_orderkey div 100").alias("sheet_id")).distinct()
    return sheets.select("sheet_id", F.explode(F.expr(places)).alias("at"))


_HIDDEN_ROWS = "filter(sequence(0L, 199L), x -> x % 7 = 3 OR x % 50 BETWEEN 20 AND 22)"
_HIDDEN_COLUMNS = "filter(sequence(0L, 19L), x -> x % 5 = 2)"


def grid_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.visible_cells(whole_grid(spark, sf_dir), _hidden(spark, sf_dir, _HIDDEN_ROWS), _hidden(spark, sf_dir, _HIDDEN_COLUMNS))


def grid_visible_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.visible_merges(all_regions(spark, sf_dir), _hidden(spark, sf_dir, _HIDDEN_ROWS), _hidden(spark, sf_dir, _HIDDEN_COLUMNS))


def post_merge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_summary(all_regions(spark, sf_dir))


def fn_number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.when(F.col("c_custkey") % 3 == 0, F.floor("c_acctbal").cast("double")).otherwise(F.col("c_acctbal"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", C.number_text(balance).alias("v"))


def img_nearest_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shown row next to the row of each line item; rows with a line item of more than 30 pieces are hidden."""
    cells = whole_grid(spark, sf_dir)
    rows = cells.groupBy("sheet_id", "r").agg(F.max(F.col("v").cast("int")).alias("most"))
    return P.nearest_shown(rows.select("sheet_id", F.col("r").alias("x")), rows.where("most <= 30").select("sheet_id", F.col("r").alias("at")))


def img_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of a sheet that holds a point, rows being as high as their line items' pieces."""
    sizes = whole_grid(spark, sf_dir).groupBy("sheet_id", F.col("r").alias("at")).agg(F.sum(F.col("v").cast("long")).alias("size"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return P.located(orders.select(F.expr("o_orderkey div 100").alias("sheet_id"), F.col("o_orderkey").alias("point"), (F.col("o_custkey") * 3 % 9000).alias("x")), sizes)


_FORMATS = ("yyyy-mm-dd", "[Red]0.00", "[$-409]d mmm yy", "h:mm AM/PM", "General", '0" pcs"', "[DBNum1]yyyy", "#,##0")


def fn_date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    fmt = F.concat(F.element_at(F.array(*map(F.lit, _FORMATS)), (F.col("p_partkey") % len(_FORMATS) + 1).cast("int")), F.lit(" "), F.col("p_name"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", C.date_pattern(fmt).alias("pattern"), C.date_like_format(fmt).alias("date_like"), C.unprocessed_date(fmt).alias("unprocessed"))


def fn_csv_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("p_name"), F.element_at(F.array(*map(F.lit, (".csv", ".TSV", ".xlsx", "", ".csv.gz"))), (F.col("p_partkey") % 5 + 1).cast("int")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", C.is_csv_name(name).alias("delimited"))


def _documents(spark: SparkSession, sf_dir: str, strategy: str | Strategy = "balanced") -> DataFrame:
    merges = all_regions(spark, sf_dir)
    return D.sheet_documents(M.merged_grid(whole_grid(spark, sf_dir), merges), merges, strategy)


def doc_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("sheet_id", D.rendered(F.col("document"), assist=True).alias("json"))


def doc_row_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("sheet_id", D.rendered(F.col("document"), layout="row_object").alias("json"))


def doc_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("sheet_id", D.rendered(F.col("document"), "markdown").alias("markdown"))


def doc_one_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, ONE_PASS).select("sheet_id", D.rendered(F.col("document")).alias("json"))


def queries() -> dict:
    own = (
        seg_row_bands, seg_column_stripes, seg_three_level, seg_graph, seg_graph_apart, seg_merge_clip, ord_deferred, seg_isolated_cells, grid_merged,
        hdr_single_row, hdr_merge_aware, fn_column_letters, fn_range_ref, fn_markdown_escape, fn_sanitize, fn_cjk_number, fn_sniff_delimiter,
        cls_title_like, lang_documents, src_delimited, grid_visible, grid_visible_merges, post_merge_summary, fn_number_text, fn_date_formats, fn_csv_name,
        img_nearest_shown, img_located,
        doc_json, doc_row_objects, doc_markdown, doc_one_pass,
    )
    return {f.__name__: f for f in own}


_ROW = "({0} % 100 + {0} % 100 // 3 + {0} % 100 // 5)"
_CELLS = f"""
cells AS (SELECT l_orderkey // 100 AS sheet_id, {_ROW.format('l_orderkey')} AS r, i + i // 3 AS c, v FROM (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS v FROM lineitem))"""
_OFF = """
hr AS (SELECT x FROM range(0, 200) t(x) WHERE x % 7 = 3 OR x % 50 BETWEEN 20 AND 22), hc AS (SELECT x FROM range(0, 20) t(x) WHERE x % 5 = 2)"""
_BANDS = _CELLS + """,
rws AS (SELECT DISTINCT sheet_id, r FROM cells),
marked AS (SELECT *, r - coalesce(lag(r) OVER (PARTITION BY sheet_id ORDER BY r), r) > 2 AS cut FROM rws),
bands AS (SELECT sheet_id, r, count(*) FILTER (WHERE cut) OVER (PARTITION BY sheet_id ORDER BY r) AS band FROM marked)"""
_STRIPES = _BANDS + """,
cols AS (SELECT DISTINCT sheet_id, band, c FROM cells JOIN bands USING (sheet_id, r)),
isl AS (SELECT *, c - row_number() OVER (PARTITION BY sheet_id, band ORDER BY c) AS g FROM cols),
stripes AS (SELECT sheet_id, band, c, dense_rank() OVER (PARTITION BY sheet_id, band ORDER BY g) - 1 AS stripe FROM isl)"""
_SEGS = _STRIPES + """,
placed AS (SELECT DISTINCT sheet_id, band, stripe, r FROM cells JOIN bands USING (sheet_id, r) JOIN stripes USING (sheet_id, band, c)),
cuts AS (SELECT *, r - coalesce(lag(r) OVER (PARTITION BY sheet_id, band, stripe ORDER BY r), r) > 2 AS cut FROM placed),
parts AS (SELECT *, count(*) FILTER (WHERE cut) OVER (PARTITION BY sheet_id, band, stripe ORDER BY r) AS part FROM cuts),
boxes AS (SELECT sheet_id, band, stripe, part, min(r) AS r0, max(r) AS r1 FROM parts GROUP BY ALL),
wide AS (SELECT sheet_id, band, stripe, min(c) AS c0, max(c) AS c1 FROM stripes GROUP BY ALL),
edge AS (SELECT sheet_id, band, min(r) AS first, max(r) AS last FROM bands GROUP BY ALL),
counts AS (SELECT b.sheet_id, b.band, b.stripe, b.part, count(*) AS n_cells FROM boxes b JOIN wide w USING (sheet_id, band, stripe)
  JOIN cells x ON x.sheet_id = b.sheet_id AND x.r BETWEEN b.r0 AND b.r1 AND x.c BETWEEN w.c0 AND w.c1 GROUP BY ALL),
segs AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY band, stripe, part) - 1 AS seg_ord,
  row_number() OVER (PARTITION BY sheet_id, band ORDER BY stripe, part) = 1 AS lead,
  r0 - coalesce(lag(r1) OVER (PARTITION BY sheet_id, band, stripe ORDER BY part) + 1, first) AS own,
  coalesce(first - 2 - (SELECT e.last FROM edge e WHERE e.sheet_id = s.sheet_id AND e.band = s.band - 1), first) AS between_
  FROM boxes s JOIN wide USING (sheet_id, band, stripe) JOIN edge USING (sheet_id, band) JOIN counts USING (sheet_id, band, stripe, part)),
final AS (SELECT sheet_id, CAST(seg_ord AS INT) AS seg_ord, r0, r1, c0, c1, n_cells, CASE WHEN lead AND own = 0 THEN between_ ELSE own END AS gap FROM segs)"""

_MERGES = f"""
merges AS (SELECT sheet_id, ord, r0, CASE WHEN o_custkey % 2 = 1 AND ((ord % 100 + 1) % 3 = 0 OR (ord % 100 + 1) % 5 = 0) THEN r0 + 1 ELSE r0 END AS r1, o_custkey % 3 AS c0, o_custkey % 3 + o_custkey % 5 AS c1
  FROM (SELECT o_orderkey // 100 AS sheet_id, o_orderkey AS ord, {_ROW.format('o_orderkey')} AS r0, o_custkey FROM orders))"""
_GRID = f"""{_CELLS}, {_MERGES},
spans AS (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM merges), covered AS (SELECT *, unnest(range(c0, c1 + 1)) AS c FROM spans),
marks AS (SELECT sheet_id, r, c, CASE WHEN r <> r0 THEN '^' ELSE '' END || CASE WHEN c <> c0 THEN '<' ELSE '' END AS marker FROM covered),
grid AS (SELECT * FROM (SELECT sheet_id, r, c, coalesce(nullif(marker, ''), v) AS v FROM cells FULL JOIN marks USING (sheet_id, r, c)) WHERE v IS NOT NULL)"""
_BOXES = _CELLS + """,
reach AS (SELECT sheet_id, r AS r1, c AS c1, r, c FROM cells UNION
  SELECT x.sheet_id, x.r1, x.c1, y.r, y.c FROM reach x JOIN cells y ON x.sheet_id = y.sheet_id AND abs(x.r - y.r) + abs(x.c - y.c) = 1),
roots AS (SELECT sheet_id, r, c, min(r1 * 1000 + c1) AS root FROM reach GROUP BY ALL),
boxes AS (SELECT sheet_id, root, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM roots GROUP BY ALL)"""
_NUMBERED = """SELECT sheet_id, row_number() OVER w - 1 AS seg_ord, r0, r1, c0, c1,
  CAST(CASE WHEN lag(r1) OVER w IS NULL THEN r0 ELSE greatest(0, r0 - lag(r1) OVER w - 1) END AS BIGINT) AS gap FROM {} WINDOW w AS (PARTITION BY sheet_id ORDER BY r0, c0, {})"""


def _numeral() -> str:
    """SQL of a numeral by its digits, written apart from the column function: the zeros between two digits of a group of
    four put one zero before the upper digit."""
    def group(g: str, big: str) -> str:
        d = [f"({g} // {10**k} % 10)" for k in range(4)]
        digit = [
            f"CASE WHEN {d[k]} = 0 THEN '' ELSE " + (f"CASE WHEN {d[k - 1]} = 0 AND {g} % {10 ** k} > 0 THEN '零' ELSE '' END || " if k else "") + f"substr('零一二三四五六七八九', CAST({d[k]} + 1 AS BIGINT), 1) || '{u}' END"
            for k, u in enumerate(("", "十", "百", "千"))
        ]
        text = " || ".join(digit[::-1])
        return f"CASE WHEN {g} = 0 THEN '' WHEN {g} BETWEEN 10 AND 19 THEN substr({text}, 2) || '{big}' ELSE {text} || '{big}' END"

    parts = [group(f"(abs(n) // {10_000**k} % 10000)", big) for k, big in enumerate(("", "万", "億"))]
    return f"CASE WHEN n = 0 THEN '零' ELSE CASE WHEN n < 0 THEN '負' ELSE '' END || {' || '.join(f'({x})' for x in parts[::-1])} END"


def oracle_sql() -> dict[str, str]:
    return {
        "seg_row_bands": f"WITH {_BANDS} SELECT sheet_id, band, min(r) AS r0, max(r) AS r1, count(*) AS n_rows FROM bands GROUP BY sheet_id, band",
        "seg_column_stripes": f"WITH {_STRIPES} SELECT sheet_id, band, stripe, min(c) AS c0, max(c) AS c1 FROM stripes GROUP BY ALL",
        "seg_three_level": f"WITH {_SEGS} SELECT * FROM final",
        "ord_deferred": f"""WITH {_SEGS}, d AS (SELECT *, gap >= 2 AND NOT EXISTS (SELECT 1 FROM final n WHERE n.sheet_id = f.sheet_id AND n.seg_ord = f.seg_ord + 1 AND n.gap < 2) AS deferred FROM final f)
SELECT sheet_id, seg_ord, deferred, CAST(row_number() OVER (PARTITION BY sheet_id ORDER BY deferred, seg_ord) - 1 AS INT) AS out_ord FROM d""",
        "seg_isolated_cells": f"""WITH {_CELLS} SELECT sheet_id, r, c, v FROM cells x
WHERE NOT EXISTS (SELECT 1 FROM cells y WHERE y.sheet_id = x.sheet_id AND (y.r = x.r AND y.c <> x.c OR y.r = x.r - 1 OR y.r = x.r + 1))""",
        "hdr_single_row": f"WITH {_CELLS} SELECT sheet_id, min(r) AS header_row FROM cells GROUP BY sheet_id",
        "fn_column_letters": """SELECT DISTINCT n, CASE WHEN n < 26 THEN chr(65 + n) WHEN n < 702 THEN chr(64 + n // 26) || chr(65 + n % 26)
  ELSE chr(64 + (n - 26) // 676) || chr(65 + (n - 26) // 26 % 26) || chr(65 + n % 26) END AS letters FROM (SELECT CAST(p_partkey % 16384 AS INT) AS n FROM part)""",
        "seg_graph_apart": f"WITH RECURSIVE {_BOXES} {_NUMBERED.format('boxes', 'root')}",
        "seg_graph": f"""WITH RECURSIVE {_BOXES},
q AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY r0, root) AS i FROM boxes),
sweep AS (SELECT sheet_id, i, 1 AS g, r0, r1, c0, c1 FROM q WHERE i = 1 UNION ALL
  SELECT sheet_id, i, CASE WHEN j THEN g ELSE g + 1 END, CASE WHEN j THEN least(r0, a) ELSE a END, CASE WHEN j THEN greatest(r1, b) ELSE b END,
    CASE WHEN j THEN least(c0, d) ELSE d END, CASE WHEN j THEN greatest(c1, e) ELSE e END
  FROM (SELECT s.sheet_id, q.i, s.g, s.r0, s.r1, s.c0, s.c1, q.r0 AS a, q.r1 AS b, q.c0 AS d, q.c1 AS e,
      q.r0 <= s.r1 + 1 AND q.c0 <= s.c1 + 1 AND q.c1 >= s.c0 - 1 AS j FROM sweep s JOIN q ON q.sheet_id = s.sheet_id AND q.i = s.i + 1)),
swept AS (SELECT sheet_id, g, max_by(r0, i) AS r0, max_by(r1, i) AS r1, max_by(c0, i) AS c0, max_by(c1, i) AS c1 FROM sweep GROUP BY ALL)
{_NUMBERED.format('swept', 'g')}""",
        "grid_merged": f"WITH {_GRID} SELECT * FROM grid",
        "seg_merge_clip": f"""WITH {_SEGS}, {_MERGES} SELECT f.sheet_id, f.seg_ord, m.ord, greatest(m.r0, f.r0) - f.r0 AS r0, least(m.r1, f.r1) - f.r0 AS r1,
  greatest(m.c0, f.c0) - f.c0 AS c0, least(m.c1, f.c1) - f.c0 AS c1
FROM final f JOIN merges m ON f.sheet_id = m.sheet_id AND m.r0 <= f.r1 AND m.r1 >= f.r0 AND m.c0 <= f.c1 AND m.c1 >= f.c0""",
        "hdr_merge_aware": f"""WITH {_GRID}, plain AS (SELECT * FROM grid WHERE v NOT IN ('<', '^', '^<')),
wide AS (SELECT sheet_id, max(c) + 1 AS cols, max(r) AS last FROM grid GROUP BY ALL),
lines AS (SELECT sheet_id, r, count(*) AS n, count(DISTINCT v) AS kinds, min(v) AS v FROM plain GROUP BY ALL),
judged AS (SELECT *, lead(n) OVER (PARTITION BY sheet_id ORDER BY r) AS next, kinds = 1 AND cols >= 4 AND (length(v) >= 40 OR contains(v, chr(10)) OR EXISTS (SELECT 1 FROM merges m
  WHERE m.sheet_id = l.sheet_id AND m.r0 = l.r AND m.r1 = l.r AND m.c0 = 0 AND m.c1 + 1 >= greatest(4, cols // 2))) AS banner FROM lines l JOIN wide USING (sheet_id)),
start AS (SELECT sheet_id, min(r) AS header_start, any_value(last) AS last FROM judged WHERE NOT (banner AND coalesce(next >= greatest(3, n + 2), false)) GROUP BY ALL)
SELECT sheet_id, header_start, (SELECT count(DISTINCT x) FROM (SELECT s.header_start AS x UNION ALL
  SELECT unnest(range(m.r0, least(m.r1, s.last) + 1)) FROM merges m WHERE m.sheet_id = s.sheet_id AND m.r1 > m.r0 AND s.header_start BETWEEN m.r0 AND m.r1)) AS header_rows FROM start s""",
        "fn_range_ref": f"""WITH {_MERGES} SELECT sheet_id, ord, chr(CAST(65 + c0 AS INT)) || (r0 + 1) || CASE WHEN r0 = r1 AND c0 = c1 THEN '' ELSE ':' || chr(CAST(65 + c1 AS INT)) || (r1 + 1) END AS region FROM merges""",
        "lang_documents": """WITH l AS (SELECT doc_id, unnest(CASE WHEN text IS NULL THEN [''] ELSE string_split(text, chr(10)) END) AS v FROM documents),
s AS (SELECT doc_id, coalesce(avg(CAST(regexp_matches(v, '\\p{Hangul}') AS INT)) FILTER (WHERE regexp_matches(v, '[^\\s\\p{Z}]')), 0) AS h,
  coalesce(avg(CAST(regexp_matches(v, '[\\p{Hiragana}\\p{Katakana}]') AS INT)) FILTER (WHERE regexp_matches(v, '[^\\s\\p{Z}]')), 0) AS k FROM l GROUP BY doc_id)
SELECT doc_id, CASE WHEN h >= 0.01 AND h >= k THEN 'KO' WHEN k >= 0.01 THEN 'JA' ELSE 'EN' END AS language FROM s""",
        "fn_sanitize": r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{AD}]', '', 'g'),
  '(?i)reserved-[0-9]+x[0-9a-f]+', '', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS v FROM pages""",
        "fn_cjk_number": f"SELECT n, {_numeral()} AS numeral, translate(CAST(n AS VARCHAR), '0123456789', '零一二三四五六七八九') AS digits FROM (SELECT DISTINCT o_orderkey * o_custkey - 5000 AS n FROM orders)",
        "fn_sniff_delimiter": r"""WITH l AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r'), lambda x: regexp_matches(x, '[^\s\p{Z}]'))[1:10] AS ls FROM documents),
m AS (SELECT doc_id, d, p, list_transform(ls, lambda x: length(x) - length(replace(x, d, ''))) AS n FROM l, (VALUES (',', 1), (chr(9), 2), (';', 3), ('|', 4)) AS t(d, p))
SELECT doc_id, coalesce(min_by(d, p - 10 * n[1]) FILTER (WHERE n[1] > 0 AND list_min(n) = list_max(n)), ',') AS delimiter FROM m GROUP BY doc_id""",
        "grid_visible": f"""WITH {_CELLS}, {_OFF} SELECT sheet_id, r - (SELECT count(*) FROM hr WHERE x < r) AS r, c - (SELECT count(*) FROM hc WHERE x < c) AS c, v FROM cells
WHERE r NOT IN (SELECT x FROM hr) AND c NOT IN (SELECT x FROM hc)""",
        "grid_visible_merges": f"""WITH {_MERGES}, {_OFF}, p AS (SELECT sheet_id, ord, r0 - (SELECT count(*) FROM hr WHERE x < r0) AS r0, r1 - (SELECT count(*) FROM hr WHERE x <= r1) AS r1,
  c0 - (SELECT count(*) FROM hc WHERE x < c0) AS c0, c1 - (SELECT count(*) FROM hc WHERE x <= c1) AS c1 FROM merges) SELECT * FROM p WHERE r0 <= r1 AND c0 <= c1""",
        "post_merge_summary": f"WITH {_MERGES} SELECT sheet_id, ord, chr(CAST(65 + c0 AS INT)) || (r0 + 1) AS cell, r1 - r0 + 1 AS row_span, c1 - c0 + 1 AS col_span FROM merges",
        "fn_number_text": """SELECT c_custkey, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END AS v
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN floor(c_acctbal) ELSE c_acctbal END AS x FROM customer)""",
        "fn_date_formats": f"""WITH f AS (SELECT p_partkey, list_extract({list(_FORMATS)}, CAST(p_partkey % {len(_FORMATS)} + 1 AS INT)) || ' ' || p_name AS x FROM part),
b AS (SELECT *, trim(regexp_replace(x, '\\[(\\$[^\\]]*|color\\s*[0-9]+|black|blue|cyan|green|magenta|red|white|yellow|dbnum[0-9]*)\\]', '', 'gi')) AS y FROM f)
SELECT p_partkey, trim(replace(regexp_replace(replace(replace(y, 'm', 'M'), 'h', 'H'), 'am/pm', 'a', 'gi'), '"', '')) AS pattern,
  regexp_matches(lower(x), 'y{{2}}|[mdhs]') AS date_like, regexp_matches(lower(x), 'y{{2}}|m{{2}}|d{{2}}|h{{2}}|s{{2}}') AS unprocessed FROM b""",
        "img_nearest_shown": f"""WITH {_CELLS}, y AS (SELECT sheet_id, r, max(CAST(v AS INT)) AS most FROM cells GROUP BY ALL),
p AS (SELECT a.sheet_id, a.r AS x, b.r AS near, row_number() OVER (PARTITION BY a.sheet_id, a.r ORDER BY abs(a.r - b.r), b.r) AS n FROM y a LEFT JOIN y b ON a.sheet_id = b.sheet_id AND b.most <= 30)
SELECT sheet_id, x, near FROM p WHERE n = 1""",
        "img_located": f"""WITH {_CELLS}, z AS (SELECT sheet_id, r AS at_, CAST(sum(CAST(v AS BIGINT)) AS BIGINT) AS size FROM cells GROUP BY ALL),
e AS (SELECT *, CAST(sum(size) OVER (PARTITION BY sheet_id ORDER BY at_) - size AS BIGINT) AS start FROM z),
q AS (SELECT o_orderkey // 100 AS sheet_id, o_orderkey AS point, o_custkey * 3 % 9000 AS x FROM orders)
SELECT q.sheet_id, q.point, q.x, e.at_ AS at, q.x - e.start AS inside FROM q ASOF LEFT JOIN e ON q.sheet_id = e.sheet_id AND q.x >= e.start""",
        "fn_csv_name": "SELECT p_partkey, p_partkey % 5 IN (0, 1) AS delimited FROM part",
        "src_delimited": "SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS line, l_linestatus AS status, l_returnflag AS flag FROM lineitem",
        "fn_markdown_escape": """SELECT doc_id, CASE WHEN text IN ('<', '^', '<^', '^<') THEN ''
  ELSE regexp_replace(replace(coalesce(text, ''), '|', '\\|'), chr(13) || chr(10) || '|' || chr(10) || '|' || chr(13), '<br>', 'g') END AS cell FROM documents""",
        "cls_title_like": """WITH l AS (SELECT doc_id, regexp_replace(v, '^[\\p{Z}\\t-\\r\\x1C-\\x1F]+|[\\p{Z}\\t-\\r\\x1C-\\x1F]+$', '', 'g') AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS v FROM documents WHERE text IS NOT NULL))
SELECT doc_id, CAST(sum(CAST(regexp_matches(t, '^[■◾▪•·-]') OR regexp_matches(regexp_replace(t, '\\s+', '', 'g'), '^(19|20)[0-9]{2}(년|$)') OR starts_with(t, '년') OR starts_with(t, '~')
  OR (contains(t, '패널') AND length(t) <= 15) AS INT)) AS BIGINT) AS titles, count(*) AS lines FROM l GROUP BY doc_id""",
    }
