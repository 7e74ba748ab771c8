"""Positional-word and page-text queries on pages rendered from the tables."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import notes as N
from ..operators import words as C
from ..operators.rollup import actuals_variance
from ..plans.bill import CODES, _pick
from ..plans.testdata import allocations, table
from .base import query, with_alloc

WORDS = "array<struct<x0:double,x1:double,top:double,text:string>>"

# One page per order: a line per line number with the summed values.
_ROWS = """
WITH r AS (SELECT l_orderkey AS page, 'D' || (l_orderkey // 100) AS doc_id, l_linenumber AS n,
   CAST(sum(l_quantity) AS BIGINT) AS q, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS v,
   min(l_returnflag) AS flag FROM lineitem GROUP BY ALL)
"""


def _rows(spark, d):
    """Summed lines of every page, dealt by page once; ``first`` marks one line a page.

    The number of parts is the session's: rows are short here and grow tenfold into words, so
    parts merged by their size in the shuffle would be too large for a task.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    page = F.col("l_orderkey")
    lines = table(spark, d, "lineitem").select(
        F.concat(F.lit("D"), F.floor(page / 100).cast("string")).alias("doc_id"), page.alias("page"),
        F.col("l_linenumber").alias("n"), "l_quantity", "l_extendedprice", "l_returnflag")
    return lines.repartition(parts, "doc_id", "page").groupBy("doc_id", "page", "n").agg(
        F.sum("l_quantity").cast("long").alias("q"),
        F.sum(F.floor("l_extendedprice")).alias("v"), F.min("l_returnflag").alias("flag")
    ).withColumn("first", F.row_number().over(W.partitionBy("doc_id", "page").orderBy("n")) == 1)


def _rendered(rows, words, once):
    """Words of every line, and those that stand once on a page (beside its first line)."""
    first = F.when(F.col("first"), F.array(*once)).otherwise(F.array().cast(WORDS))
    return rows.select("doc_id", "page", F.inline(F.concat(F.array_compact(F.array(*words)).cast(WORDS), first)))


def _word(x0, x1, top, text):
    return F.struct(F.lit(x0).cast("double").alias("x0"), F.lit(x1).cast("double").alias("x1"),
                    top.cast("double").alias("top"), text.alias("text"))


def _words(spark, d):
    """Label, split amount and quantity of every line, plus page headers."""
    top = F.lit(200) + F.col("n") * 12
    shown = F.format_number("v", 0)
    head = F.regexp_replace(shown, r"[^,]*$", "")
    tail = F.regexp_extract(shown, r"([^,]*)$", 1)
    labels = [(180, 200, "APPRN"), (270, 300, "ADJUSTMENT"), (370, 400, "APPRN")]
    return _rendered(_rows(spark, d), [
        _word(30, 60, top, F.concat(F.lit("LINE"), F.col("n").cast("string"))),
        _word(150, 200, top + 0.4, head), _word(201, 217, top + 0.8, tail),
        _word(280, 315, top - 0.3, F.col("q").cast("string"))],
        [_word(a, b, F.lit(100), F.lit(t)) for a, b, t in labels]).where(F.col("text") != "")


@query("word_lines", _ROWS + """
SELECT doc_id, page, 'LINE' || n || ' ' || regexp_replace(format('{:,}', v), ',([0-9]*)$', ', \\1')
   || ' ' || q AS line FROM r
UNION ALL SELECT DISTINCT doc_id, page, 'APPRN ADJUSTMENT APPRN' FROM r""")
def word_lines(spark, d):
    return C.word_lines(_words(spark, d)).select("doc_id", "page", "line")


@query("word_lines_thirds", _ROWS + """
SELECT doc_id, page, CAST(round_even((200 + n * 12) / 3.0, 0) * 3 AS DOUBLE) AS line_top,
  CASE WHEN v < 1000 THEN 3 ELSE 4 END AS n_words FROM r
UNION ALL SELECT DISTINCT doc_id, page, 99, 3 FROM r""")
def word_lines_thirds(spark, d):
    return C.word_lines(_words(spark, d), "thirds").select(
        "doc_id", "page", "line_top", F.size("words").alias("n_words"))


@query("header_columns", _ROWS + """
SELECT DISTINCT doc_id, page, i AS ordinal, CAST(200 + 100 * i AS DOUBLE) AS edge
FROM r, range(0, 3) t(i)""")
def header_columns(spark, d):
    return C.header_columns(_words(spark, d), ["APPRN", "ADJUSTMENT", "APPRN"], 150)


@query("nearest_col", _ROWS + """
SELECT doc_id, page, 200 + n * 12 AS line_top, 0 AS ordinal, CAST(v AS DOUBLE) AS value FROM r
UNION ALL SELECT doc_id, page, 200 + n * 12, 1, CAST(q AS DOUBLE) FROM r""")
def nearest_col(spark, d):
    words = _words(spark, d)
    columns = C.header_columns(words, ["APPRN", "ADJUSTMENT", "APPRN"], 150)
    lines = C.merge_fragments(C.word_lines(words))
    values = C.nearest_column(C.line_numbers(lines), columns)
    return values.select("doc_id", "page", F.bround("line_top").cast("long").alias("line_top"),
                         "ordinal", "value")


@query("frag_merge", _ROWS + """
SELECT doc_id, page, 'LINE' || n || ' ' || format('{:,}', v) || ' ' || q AS line FROM r
UNION ALL SELECT DISTINCT doc_id, page, 'APPRN ADJUSTMENT APPRN' FROM r""")
def frag_merge(spark, d):
    return C.merge_fragments(C.word_lines(_words(spark, d))).select("doc_id", "page", "line")


@query("request_rollup", with_alloc("""
, s AS (SELECT department_code, program_id, fund_type, section,
   CAST(coalesce(sum(CASE WHEN fiscal_year % 2 = 0 THEN amount END), 0) AS DOUBLE) AS amount1,
   CAST(coalesce(sum(CASE WHEN fiscal_year % 2 = 1 THEN amount END), 0) AS DOUBLE) AS amount2
  FROM alloc GROUP BY ALL),
p AS (SELECT program_id, CAST(max(positions) AS DOUBLE) AS positions FROM alloc GROUP BY 1)
SELECT s.*, positions FROM s LEFT JOIN p USING (program_id)"""))
def request_rollup(spark, d):
    rows = allocations(spark, d, "department_code", "program_id", "fund_type", "section",
                       "fiscal_year", "amount", "positions")
    even = F.col("fiscal_year") % 2 == 0
    shaped = rows.select(
        "department_code", "program_id", "fund_type", "section",
        F.when(even, F.col("amount")).otherwise(F.lit(0)).alias("amount1"),
        F.when(~even, F.col("amount")).otherwise(F.lit(0)).alias("amount2"))
    positions = rows.groupBy("program_id").agg(F.max("positions").alias("positions"))
    return C.request_rollup(shaped, positions)


# A worksheet per region: nations as departments, segments as their programs.
_STARS = """
WITH c AS (SELECT n_regionkey AS rk, n_nationkey AS nk, c_mktsegment AS seg,
   CAST(floor(sum(abs(c_acctbal))) AS BIGINT) AS v
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
d AS (SELECT rk, nk, sum(v) + 7 * (nk % 2) AS total FROM c GROUP BY rk, nk)
"""


@query("star_tree", _STARS + """
SELECT 'R' || rk AS doc_id, lpad(CAST(rk AS VARCHAR), 3, '0') AS fund, 'FUND ' || rk AS fund_name,
  'NATION ' || nk AS department_name, seg AS program_name, CAST(v AS DOUBLE) AS amount FROM c
  WHERE nk % 5 <> 3
UNION ALL SELECT 'R' || rk, lpad(CAST(rk AS VARCHAR), 3, '0'), 'FUND ' || rk, 'NATION ' || nk,
  'Other', 7 FROM d WHERE nk % 2 = 1 AND nk % 5 <> 3
UNION ALL SELECT 'R' || rk, lpad(CAST(rk AS VARCHAR), 3, '0'), 'FUND ' || rk, 'NATION ' || nk,
  NULL, CAST(total AS DOUBLE) FROM d WHERE nk % 5 = 3""")
def star_tree(spark, d):
    nations = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    sums = table(spark, d, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("n_regionkey").alias("rk"), F.col("n_nationkey").alias("nk"),
        F.col("c_mktsegment").alias("seg")).agg(
        F.floor(F.sum(F.abs(F.col("c_acctbal").cast("decimal(18,2)")))).alias("v"))
    doc = F.concat(F.lit("R"), F.col("rk").cast("string"))
    nothing = F.lit(None).cast("string")
    base = F.col("nk") * 100
    programs = sums.where(F.col("nk") % 5 != 3).select(
        doc.alias("doc_id"), (base + F.ascii("seg") % 50).cast("long").alias("line_no"),
        F.lit(1).alias("stars"), F.col("seg").alias("name"), F.col("v").alias("amount"),
        nothing.alias("fund"))
    departments = sums.groupBy("rk", "nk").agg(F.sum("v").alias("v")).select(
        doc.alias("doc_id"), (base + 90).cast("long").alias("line_no"), F.lit(2).alias("stars"),
        F.concat(F.lit("NATION "), F.col("nk").cast("string")).alias("name"),
        (F.col("v") + F.col("nk") % 2 * 7).alias("amount"), nothing.alias("fund"))
    regions = sums.select("rk").distinct()
    accounts = regions.select(
        doc.alias("doc_id"), F.lit(-1).cast("long").alias("line_no"),
        F.lit(None).cast("int").alias("stars"), nothing.alias("name"),
        F.lit(None).cast("long").alias("amount"),
        F.lpad(F.col("rk").cast("string"), 3, "0").alias("fund"))
    names = regions.select(
        doc.alias("doc_id"), F.lit(1_000_000).cast("long").alias("line_no"),
        F.lit(3).alias("stars"),
        F.concat(F.lit("FUND "), F.col("rk").cast("string")).alias("name"),
        F.lit(0).cast("long").alias("amount"), nothing.alias("fund"))
    lines = programs.unionByName(departments).unionByName(accounts).unionByName(names)
    return C.star_tree(lines).select(
        "doc_id", "fund", "fund_name", "department_name", "program_name",
        F.col("amount").cast("double").alias("amount"))


@query("schedule", with_alloc("""
, s AS (SELECT draft, department_code,
   CAST(floor(sum(amount) / 1000) AS BIGINT) AS o,
   CAST(floor(sum(CASE WHEN section <> 'One-Time' THEN amount END) / 1000) AS BIGINT) AS f,
   CAST(floor(sum(CASE WHEN section = 'Operating' THEN amount END) / 1000) AS BIGINT) AS a
  FROM alloc GROUP BY ALL),
t AS (SELECT department_code, CAST(sum(o) * 1000 AS DOUBLE) AS original,
   CAST(sum(f) * 1000 AS DOUBLE) AS final, CAST(sum(a) * 1000 AS DOUBLE) AS actual FROM s GROUP BY 1)
SELECT department_code AS department_name, original, final, actual, final - actual AS variance,
  round_even((final - actual) / nullif(final, 0) * 100, 2) AS pct_variance,
  round_even(actual / nullif(final, 0) * 100, 1) AS pct_spent FROM t"""))
def schedule(spark, d):
    rows = allocations(spark, d, "draft", "department_code", "section", "amount")
    sums = rows.groupBy("draft", "department_code").agg(
        F.floor(F.sum("amount") / 1000).alias("o"),
        F.floor(F.sum(F.when(F.col("section") != "One-Time", F.col("amount"))) / 1000).alias("f"),
        F.floor(F.sum(F.when(F.col("section") == "Operating", F.col("amount"))) / 1000).alias("a"))
    doc = F.concat(F.lit("S"), F.col("draft"))
    number = F.regexp_extract("department_code", r"(\d+)", 1).cast("long") + 10

    def money(c):
        return F.format_number(F.col(c), 0)

    body = sums.select(
        doc.alias("doc_id"), number.alias("line_no"),
        F.concat(F.col("department_code"), F.lit("  $ "), money("o"), F.lit("  "), money("f"),
                 F.lit("  "), money("a"), F.lit("  (1)")).alias("line"))
    frame = sums.select("draft").distinct().select(doc.alias("doc_id"), F.inline(F.array(
        F.struct(F.lit(5).cast("long").alias("line_no"), F.lit("Department").alias("line")),
        F.struct(F.lit(2).cast("long").alias("line_no"), F.lit("Not read 1 2 3 4").alias("line")),
        F.struct(F.lit(900).cast("long").alias("line_no"),
                 F.lit("Total expenditures 1 2 3 4").alias("line")),
        F.struct(F.lit(910).cast("long").alias("line_no"), F.lit("Department").alias("line")),
        F.struct(F.lit(911).cast("long").alias("line_no"), F.lit("Again 1 2 3 4").alias("line")))))
    read = C.schedule_rows(body.unionByName(frame))
    return actuals_variance(read, ["department_name"])


# --- page texts --------------------------------------------------------------

_PAGES = """
WITH p AS (SELECT o_orderkey AS page_no, {codes}[o_custkey % 25 + 1] ||
   lpad(CAST(o_custkey % 40 AS VARCHAR), 3, '0') AS program_id, o_orderpriority AS pr,
   o_orderstatus AS st, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders)
""".replace("{codes}", "[" + ", ".join(f"'{c}'" for c in CODES) + "]")


def _pages(spark, d):
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("page_no"),
        F.concat(_pick(CODES, F.col("o_custkey") % 25),
                 F.lpad((F.col("o_custkey") % 40).cast("string"), 3, "0")).alias("pid"),
        F.col("o_orderpriority").alias("pr"), F.col("o_orderstatus").alias("st"),
        F.floor("o_totalprice").alias("v"))
    shown = F.format_number("v", 0)
    message = F.concat(
        F.lit("GOVERNOR'S MESSAGE (01/02/26):\n ADD  "), F.col("pr"),
        F.lit("\n*******\nDETAIL OF GOVERNOR'S MESSAGE:\n ITEM "), F.col("st"), F.lit(" (FY27: "),
        shown, F.lit(") (FY2026: -"), shown, F.lit(")\n 1,000,000 A\n******"))
    reason = F.concat(
        F.lit("2060-001 SENATE ADJUSTMENT: (1) A\nREDUCE  FUNDS\n FOR "), F.col("pr"),
        F.lit(".\n*****\n2061-001 nothing\n2062-001 HOUSE ADJUSTMENT:\nADD "), F.col("st"),
        F.lit(".\n******\nDETAIL OF HOUSE ADJUSTMENT:\nno"))
    left = F.when(F.col("st") == "F", F.lit("Legislature does not concur")).otherwise(
        F.lit("LEGISLATURE CONCURS"))
    head = F.concat(F.lit("Program ID:  "), F.col("pid"), F.lit("\n"))
    return orders.select(
        "page_no", F.col("pid").alias("program_key"), left.alias("left_text"),
        message.alias("right_text"), F.concat(head, left, F.lit("\n"), message).alias("text"),
        F.concat(head, reason).alias("worksheet"))


@query("deltas", _PAGES + """
, s AS (SELECT program_id, CAST(sum(v) AS DOUBLE) AS v FROM p GROUP BY 1)
SELECT program_id AS program_key, 2027 AS fiscal_year, v AS delta FROM s WHERE v <> 0
UNION ALL SELECT program_id, 2026, -v FROM s WHERE v <> 0""")
def deltas(spark, d):
    return N.message_deltas(_pages(spark, d), ["program_key"])


@query("reason_texts", _PAGES + """
, x AS (SELECT program_id, 'SENATE' AS chamber, 'REDUCE FUNDS FOR ' || pr AS t,
    min(page_no) AS pos FROM p GROUP BY ALL
  UNION ALL SELECT program_id, 'HOUSE', 'ADD ' || st, min(page_no) FROM p GROUP BY ALL)
SELECT program_id, chamber, string_agg(t, '; ' ORDER BY pos) || '.' AS reason FROM x
GROUP BY program_id, chamber""")
def reason_texts(spark, d):
    return N.adjustment_reasons(_pages(spark, d), "worksheet")


@query("reason_items", _PAGES + """
, x AS (SELECT program_id, 'SENATE' AS chamber, 'REDUCE FUNDS FOR ' || pr AS title,
    min(page_no) AS pos FROM p GROUP BY ALL
  UNION ALL SELECT program_id, 'HOUSE', 'ADD ' || st, min(page_no) FROM p GROUP BY ALL)
SELECT program_id, chamber, title || '.' AS title, row_number() OVER (PARTITION BY program_id, chamber ORDER BY pos) AS position
FROM x""")
def reason_items(spark, d):
    return N.reason_items(_pages(spark, d), "worksheet")


@query("message_items", _PAGES + """
, t AS (SELECT program_id, 'title' AS kind, 'ADD ' || pr AS item, min(page_no) AS pos FROM p GROUP BY ALL
  UNION ALL SELECT program_id, 'detail', 'ITEM ' || st || ' (FY27: ' || format('{:,}', v) || ') (FY2026: -' ||
    format('{:,}', v) || ')', min(page_no) FROM p GROUP BY ALL)
SELECT program_id, kind, item, row_number() OVER (PARTITION BY program_id, kind ORDER BY pos) AS position
FROM t""")
def message_items(spark, d):
    return N.message_items(_pages(spark, d))


@query("message_details", _PAGES + """
, t AS (SELECT program_id, 'ADD ' || pr AS t, min(page_no) AS pos FROM p GROUP BY ALL),
i AS (SELECT program_id, 'ITEM ' || st || ' (FY27: ' || format('{:,}', v) || ') (FY2026: -' ||
    format('{:,}', v) || ')' AS t, min(page_no) AS pos FROM p GROUP BY ALL),
a AS (SELECT program_id, string_agg(t, '; ' ORDER BY pos) AS titles FROM t GROUP BY 1),
b AS (SELECT program_id, string_agg(t, '; ' ORDER BY pos) AS details FROM i GROUP BY 1),
f AS (SELECT program_id, bool_or(st = 'F') AS not_concur, bool_or(st <> 'F') AS concur FROM p
  GROUP BY 1)
SELECT * FROM f JOIN a USING (program_id) JOIN b USING (program_id)""")
def message_details(spark, d):
    out = N.message_details(_pages(spark, d))
    return out.select("program_id", "not_concur", "concur",
                      F.array_join("titles", "; ").alias("titles"),
                      F.array_join("details", "; ").alias("details"))


@query("objectives", r"""
WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS flat
  FROM documents),
g AS (SELECT doc_id, regexp_replace(flat, '^[-*•\s]+', '') AS flat FROM f)
SELECT doc_id, 'AGR' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') AS program_id,
  CASE WHEN doc_id % 2 = 0 THEN 'LAND USE' ELSE 'WATER 01' END AS title, flat AS objective
FROM g WHERE flat <> ''""")
def objectives(spark, d):
    number = F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0")
    end = F.lit("\n B. Description of Request and more")
    biennial = F.concat(F.lit("AGR "), number, F.lit(
        ": LAND USE 01 03 01\nA. Statement of Program Objectives\n"), "text", end)
    supplemental = F.concat(F.lit("Program ID: agr "), number, F.lit(
        "\nProgram Title: WATER 01\nA.Program Objective\n"), "text", end)
    pages = table(spark, d, "documents").select("doc_id", F.when(
        F.col("doc_id") % 2 == 0, biennial).otherwise(supplemental).alias("text"))
    return N.objective_text(pages).select("doc_id", "program_id", "title", "objective")


@query("source_counts", """
WITH u AS (SELECT doc_id, 1 AS source_rank FROM documents WHERE lang = 'en'
  UNION ALL SELECT doc_id, 2 FROM documents),
b AS (SELECT doc_id, min(source_rank) AS source_rank FROM u GROUP BY 1)
SELECT source_rank, count(*) AS new_keys FROM b GROUP BY 1""")
def source_counts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    first = docs.where(F.col("lang") == "en").select("doc_id", F.lit(1).alias("source_rank"))
    both = first.unionByName(docs.select("doc_id", F.lit(2).alias("source_rank")))
    return N.source_counts(both.groupBy("doc_id").agg(
        F.min("source_rank").alias("source_rank")))


@query("stutter", """
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN false ELSE true END AS repaired,
       p_type || p_size || ': x ' || CASE WHEN p_size % 4 = 0 THEN '2277 aa' ELSE '277 aa -' END AS text FROM part""")
def stutter(spark, d):
    plain = F.concat(F.col("p_type"), F.col("p_size").cast("string"), F.lit(":"))
    # every glyph 2, 3 or 5 times; tokens of one run and of odd runs stay as they are
    printed = F.lit(None).cast("string")
    for turn, times in ((0, 1), (1, 2), (2, 3), (3, 5)):
        printed = F.when(F.col("p_size") % 4 == turn, F.regexp_replace(plain, r"(.)", "$1" * times)).otherwise(printed)
    tail = F.when(F.col("p_size") % 4 == 0, F.lit(" x 2277 aa")).otherwise(F.lit(" x 222277777777 aa ---"))
    rows = table(spark, d, "part").select("p_partkey", F.concat(printed, tail).alias("text"))
    return N.collapse_stutter(rows)
