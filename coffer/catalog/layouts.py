"""Queries for printed layouts: pages and lines rendered from the tables."""

from pyspark.sql import functions as F

from ..functions import parse_money
from ..operators import words as C
from ..plans.testdata import table
from ..sources.readers import page_half
from .base import query
from .words import _ROWS, _rendered, _rows, _word, _words

FUNDS = [("GENERAL FUND", "A"), ("SPECIAL FUND", "B"), ("G.O. BONDS", "C")]
LABELS = [(180, 200, "APPRN"), (280, 300, "ADJUSTMENT"), (380, 400, "APPRN"),
          (480, 500, "APPRN"), (580, 600, "ADJUSTMENT"), (680, 700, "APPRN"),
          (780, 800, "BIENNIUM"), (880, 900, "BIENNIUM"), (980, 990, "CHANGE")]


def _text_line(top, text):
    """One word per line is enough where only its text matters."""
    return _word(10, 60, F.lit(top), F.lit(text))


def _number(x, top, value):
    return _word(x - 20, x + 17, top, value.cast("string"))


def _request_words(spark, d):
    top = F.lit(200) + F.col("n") * 12
    fund = F.when(F.col("n") > 3, "G.O. BONDS").when(F.col("n") == 1, "GENERAL FUND").otherwise(
        "SPECIAL FUND")
    return _rendered(_rows(spark, d), [
        _word(10, 60, top, fund), _number(200, top, F.col("q")), _number(300, top, -F.col("n")),
        F.when(F.col("flag") == "R", _number(400, top, F.col("v"))),
        _number(700, top, F.col("v"))],
        [*[_word(a, b, F.lit(100), F.lit(t)) for a, b, t in LABELS],
         _text_line(150, "OPERATING"), _text_line(240, "CAPITAL INVESTMENT"),
         _text_line(244, "TOTAL CAPITAL COST"), _text_line(400, "TOTAL PROGRAM COST"),
         _text_line(420, "GENERAL FUND"), _number(400, F.lit(420), F.lit(999))])


def _programs(spark, d):
    return _rows(spark, d).select("doc_id", "page").distinct().withColumn(
        "program_id", F.concat(F.lit("P"), (F.col("page") % 50).cast("string")))


@query("request_rows", _ROWS + """
SELECT doc_id, page, 'P' || (page % 50) AS program_id,
  CASE WHEN n > 3 THEN 'Capital Improvement' ELSE 'Operating' END AS section,
  CASE WHEN n > 3 THEN 'C' WHEN n = 1 THEN 'A' ELSE 'B' END AS fund_type,
  CAST(CASE WHEN flag = 'R' THEN v ELSE q - n END AS DOUBLE) AS amount1,
  CAST(v AS DOUBLE) AS amount2 FROM r""")
def request_rows(spark, d):
    return C.request_rows(_request_words(spark, d), _programs(spark, d), FUNDS).drop("line_no")


@query("request_projects", _ROWS + """
SELECT doc_id, page, 'P' || (page % 50) AS program_id, 'K' || n AS project_id,
  'OTHER WORKS ' || flag AS project_name, 'C' AS fund_type,
  CAST(CASE WHEN flag = 'R' THEN v ELSE q - n END * 1000 AS DOUBLE) AS amount1,
  CAST(v * 1000 AS DOUBLE) AS amount2 FROM r
WHERE v <> 0 OR q <> n""")
def request_projects(spark, d):
    top = F.lit(200) + F.col("n") * 24
    below = top + 10
    words = _rendered(_rows(spark, d), [
        _word(20, 40, top, F.concat(F.lit("K"), F.col("n").cast("string"))),
        _word(45, 50, top, F.lit("7")), _word(60, 90, top, F.lit("OTHER")),
        _word(95, 120, top, F.concat(F.lit("WORKS "), F.col("flag"))),
        _word(100, 140, below, F.lit("G.O. BONDS")), _number(200, below, F.col("q")),
        _number(300, below, -F.col("n")),
        F.when(F.col("flag") == "R", _number(400, below, F.col("v"))),
        _number(700, below, F.col("v"))],
        [*[_word(a, b, F.lit(100), F.lit(t)) for a, b, t in LABELS[:6]],
         _text_line(500, "PROGRAM TOTALS"), _word(100, 140, F.lit(520), F.lit("G.O. BONDS")),
         _number(400, F.lit(520), F.lit(5))])
    return C.request_projects(words, _programs(spark, d), FUNDS)


@query("position_totals", """
WITH p AS (SELECT o_custkey AS c, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS fk,
   max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS ok FROM orders GROUP BY 1)
SELECT 'C' || c AS program_id,
  CAST(CASE WHEN fk IS NOT NULL OR ok IS NOT NULL
    THEN coalesce(fk, 0) + coalesce(ok, 0) END AS DOUBLE) AS positions_fy1,
  CAST(CASE WHEN fk IS NOT NULL OR ok IS NOT NULL THEN coalesce(ok, 0) END AS DOUBLE)
    AS positions_temp_fy1 FROM p""")
def position_totals(spark, d):
    label = F.when(F.col("o_orderstatus") == "F", "Total perm positions").when(
        F.col("o_orderstatus") == "O", "Total temp positions").otherwise("Other")
    lines = table(spark, d, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("program_id"),
        F.col("o_orderkey").alias("line_no"), label.alias("line"),
        parse_money(F.concat(F.col("o_orderkey").cast("string"), F.lit(".00*")), "marked").alias(
            "fy1"))
    return C.position_totals(lines, ("fy1",))


@query("left_half", _ROWS + """
SELECT doc_id, page, count(*) * 2 - count(*) FILTER (v < 1000) + count(*) AS n
FROM r GROUP BY doc_id, page""")
def left_half(spark, d):
    words = _words(spark, d).where(F.col("top") > 150).withColumn("page_width", F.lit(500.0))
    return page_half(words, "left").groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))


_CUSTOMERS = """
WITH c AS (SELECT 'N' || c_nationkey AS doc_id, c_nationkey AS k, c_custkey AS i,
   c_mktsegment AS seg, CAST(floor(abs(c_acctbal)) AS BIGINT) AS v FROM customer)
"""


def _customers(spark, d):
    return table(spark, d, "customer").select(
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("doc_id"),
        F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("i"),
        F.col("c_mktsegment").alias("seg"), F.floor(F.abs("c_acctbal")).alias("v"))


def _framed(rows, line, opens, closes):
    """Body lines by customer number between an opening and a closing line.

    A line before the opening and one after the closing must not be read.
    """
    body = rows.select("doc_id", (F.col("i") + 10).cast("long").alias("line_no"),
                       line.alias("line"))
    last = 10**12
    outside = rows.groupBy("doc_id").agg(F.min("i").alias("i")).select(
        "doc_id", F.inline(F.array(*[
            F.struct(F.lit(n).cast("long").alias("line_no"), F.lit(t).alias("line"))
            for n, t in ((1, "Stray $1.0 $2.0"), (2, opens), (last, closes),
                         (last + 1, "Stray $1.0 $2.0"))])))
    return body.unionByName(outside)


@query("fund_sections", _CUSTOMERS + """
SELECT doc_id, CAST(i * 2 + 11 AS BIGINT) AS line_no,
  CASE k % 2 WHEN 0 THEN 'Highway Fund' ELSE 'Sewer Fund' END AS fund_name,
  CASE WHEN i % 2 = 0 THEN 'Works ' || seg ELSE 'TOTAL BEFORE ' || i END AS program_name,
  CAST(v AS DOUBLE) AS amount FROM c WHERE v <> 0""")
def fund_sections(spark, d):
    rows = _customers(spark, d)
    named = F.concat(F.lit("Works "), "seg")
    code = F.concat(F.lit("W"), F.lpad((F.col("i") % 1000).cast("string"), 3, "0"))
    amounts = F.concat(F.lit(" 1,000 (5) "), F.format_number("v", 0))
    body = rows.select("doc_id", F.inline(F.array(
        F.struct((F.col("i") * 2 + 10).cast("long").alias("line_no"),
                 F.concat(F.lit("TOTAL BEFORE "), F.col("i").cast("string")).alias("line")),
        F.struct((F.col("i") * 2 + 11).cast("long").alias("line_no"),
                 F.concat(F.when(F.col("i") % 2 == 0, F.concat(named, F.lit(" "))).otherwise(""),
                          code, amounts).alias("line")))))
    heads = rows.select("doc_id", "k").distinct().select("doc_id", F.inline(F.array(
        F.struct(F.lit(1).cast("long").alias("line_no"),
                 F.when(F.col("k") % 2 == 0, "OLD WORKS").otherwise("SEWER AND \u2018WATER\u2019,").alias("line")),
        F.struct(F.lit(2).cast("long").alias("line_no"),
                 F.when(F.col("k") % 2 == 0, "HIGHWAY FUND").otherwise("RESOURCES FUND").alias("line")))))
    return C.fund_section_rows(body.unionByName(heads), [("HIGHWAY", "Highway Fund"),
                                                         ("SEWER", "Sewer Fund")])


@query("dept_table", _CUSTOMERS + """
SELECT doc_id, CAST(i + 10 AS BIGINT) AS line_no, seg AS department_name,
  CAST(-v * 1000 AS DOUBLE) AS amount,
  CASE seg WHEN 'BUILDING' THEN 'Building Fund' ELSE 'General Fund' END AS fund_name
FROM c WHERE v <> 0""")
def dept_table(spark, d):
    line = F.concat("seg", F.lit(" 1 $10.5 ($"), F.format_number("v", 0), F.lit(".0)"))
    lines = _framed(_customers(spark, d), line, "DEPARTMENT WAGES", "Total Expenditures $1 $1")
    return C.department_table(lines, r"^DEPARTMENT WAGES", r"^Total Expenditures",
                              {"BUILDING": "Building Fund"}, "General Fund")


@query("project_sheet", _CUSTOMERS + """
SELECT doc_id, CAST(i * 3 + 12 AS BIGINT) AS line_no, 'Wrapped ' || i || ' tail' AS program_name,
  'GF' AS code, CAST(v * 1000 AS DOUBLE) AS amount, 'General' AS fund_name FROM c
WHERE v <> 0""")
def project_sheet(spark, d):
    rows = _customers(spark, d)
    at = F.col("i") * 3
    body = rows.select("doc_id", F.inline(F.array(
        F.struct((at + 10).cast("long").alias("line_no"), F.lit("  Wrapped").alias("line")),
        F.struct((at + 11).cast("long").alias("line_no"), F.col("i").cast("string").alias("line")),
        F.struct((at + 12).cast("long").alias("line_no"), F.concat(
            F.lit("Upper town CBS-12 tail GF "), F.format_number("v", 0)).alias("line")))))
    heads = rows.select("doc_id").distinct().select(
        "doc_id", F.lit(1).cast("long").alias("line_no"), F.lit("District Project").alias("line"))
    return C.project_sheet(
        body.unionByName(heads), r"^District Project", r"^Total:",
        r"^(.*?)\s([A-Z]{2})\s([\d,]+)$", {"GF": "General"})


@query("fund_summary", _CUSTOMERS + """
, m AS (SELECT doc_id, CASE seg WHEN 'BUILDING' THEN 'Building' WHEN 'MACHINERY' THEN 'Machines' END
    AS fund_name, i, v FROM c),
f AS (SELECT * FROM m WHERE fund_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id, fund_name ORDER BY i) = 1)
SELECT doc_id, fund_name, CAST(v * 1000 AS DOUBLE) AS amount FROM f WHERE v <> 0""")
def fund_summary(spark, d):
    line = F.concat(F.initcap("seg"), F.lit(" Fund 7 "), F.format_number("v", 0))
    lines = _framed(_customers(spark, d), line, "FUND Budget Proposed", "Total 5 5")
    return C.fund_summary(lines, [("building", "Building"), ("machinery", "Machines")], 1)


@query("stacked_lines", _ROWS + """
, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n) - 1 AS p FROM r)
SELECT doc_id, page, n, ['revenue', 'expenditure', 'net', 'other'][p // 2 + 1] AS block,
  CAST(2020 + p % 2 AS BIGINT) AS fiscal_year FROM o""")
def stacked_lines(spark, d):
    lines = _rows(spark, d).select(
        "doc_id", "page", "n", F.col("n").cast("double").alias("line_top"),
        F.concat(F.lit("FY 20 "), F.col("v").cast("string")).alias("line"))
    return C.stacked_blocks(lines, ["revenue", "expenditure", "net", "other"], [2020, 2021]).select(
        "doc_id", "page", "n", "block", "fiscal_year")


@query("band_values", _ROWS + """
SELECT doc_id, page, n, 'amount' AS band, CAST(CAST(v AS VARCHAR) || lpad(CAST(q % 100 AS VARCHAR), 2, '0')
  AS DOUBLE) AS value FROM r
UNION ALL SELECT doc_id, page, n, 'quantity', CAST(-q AS DOUBLE) FROM r WHERE q <> 0
UNION ALL SELECT doc_id, page, n, 'quantity', 0 FROM r WHERE q = 0""")
def band_values(spark, d):
    top = F.lit(10) * F.col("n")
    words = _rows(spark, d).select("doc_id", "page", F.inline(F.array(
        _word(100, 118, top, F.format_number("v", 0)),
        _word(119, 130, top, F.lpad((F.col("q") % 100).cast("string"), 2, "0")),
        _word(80, 99, top, F.lit("2027")),
        _word(300, 330, top, F.concat(F.lit("("), F.col("q").cast("string"), F.lit(")"))),
        _word(400, 430, top, F.lit("12")), _word(5, 9, top, F.lit("x")))))
    values = C.band_values(C.word_lines(words, "round"), [("amount", 110.0), ("quantity", 290.0)])
    return values.select("doc_id", "page", (F.col("line_top") / 10).cast("long").alias("n"), "band",
                         "value")


@query("revenue_cells", _ROWS + """
, x AS (SELECT doc_id, 'Tax ' || n AS source, page, n, v FROM r WHERE v >= 10)
SELECT doc_id, 2027 AS fiscal_year, source, CAST(arg_max(v, page * 100 + n) * 1000 AS DOUBLE)
  AS amount FROM x GROUP BY doc_id, source""")
def revenue_cells(spark, d):
    top = F.lit(10) * F.col("n")
    rows = _rows(spark, d)
    words = rows.select("doc_id", "page", F.inline(F.array(
        _word(5, 60, top, F.concat(F.lit("Tax "), F.col("n").cast("string"))),
        _word(295, 325, top, F.concat(F.lit("$"), F.format_number("v", 0))),
        _word(395, 425, top, F.lit("77")))))
    centre = rows.select("doc_id", "page").distinct().withColumns(
        {"fiscal_year": F.lit(2027), "centre": F.lit(310.0)})
    return C.revenue_rows(C.word_lines(words, "round"), centre)


@query("banded_projects", _ROWS + """
, t AS (SELECT * FROM r WHERE v <> 0)
SELECT doc_id, page, n, 'Public Safety' AS department_name, 'Hall ' || n AS program_name,
  'GL' AS code, CAST(v AS DOUBLE) AS amount FROM t""")
def banded_projects(spark, d):
    top = F.lit(200) + F.lit(30) * F.col("n")
    words = _rendered(_rows(spark, d), [
        _word(50, 80, top, F.concat(F.lit("2001234 Hall "), F.col("n").cast("string"))),
        _word(430, 450, top, F.format_number("v", 0)), _word(510, 550, top, F.format_number("v", 0)),
        _word(480, 490, top + 9, F.lit("GL"))], [_word(50, 99, F.lit(150), F.lit("PUBLIC SAFETY"))])
    found = C.banded_projects(C.word_lines(words, "round"), ["PUBLIC SAFETY"])
    return found.select(
        "doc_id", "page",
        F.floor((F.col("line_no") % C.LINE_SPAN / 10 - 200) / 30).cast("long").alias("n"),
        "department_name", "program_name", "code", "amount")
