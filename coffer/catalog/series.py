"""Yearly series, source and registry queries."""

from pyspark.sql import functions as F

from ..operators import series as S
from ..operators.compare import deflate as deflate_rows
from ..plans.testdata import allocations, table
from ..sources import markup, readers, registry
from .base import query, with_alloc

# Monthly observations from orders: mean price per month as text, the last
# month blanked, plus annual rows that must be ignored.
_OBS = """
, m AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS v FROM orders
  GROUP BY ALL),
ob AS (SELECT year, CAST(floor(v) AS BIGINT) AS value FROM m WHERE month <> 12),
an AS (SELECT CAST(year AS BIGINT) AS year, CAST(sum(value) AS DOUBLE) / count(*) AS index_value
  FROM ob GROUP BY 1),
fi AS (SELECT a.year AS fiscal_year, (b.index_value + a.index_value) / 2 AS fy_index
  FROM an a JOIN an b ON a.year = b.year + 1),
df AS (SELECT fiscal_year, CAST(round_even((SELECT fy_index FROM fi WHERE fiscal_year = 1999)
   / fy_index, 4) AS DECIMAL(10, 4)) AS deflator FROM fi)
"""


def _observations(spark, d):
    monthly = table(spark, d, "orders").groupBy(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(
        (F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
         / F.count(F.lit(1))).alias("v"))
    months = monthly.select(
        "year", F.format_string("M%02d", "month").alias("period"),
        F.when(F.col("month") == 12, "-").otherwise(F.floor("v").cast("string")).alias("value"))
    annual = monthly.groupBy("year").agg(
        F.lit("M13").alias("period"), F.lit("999999").alias("value"))
    return months.unionByName(annual)


def _deflators(spark, d):
    return S.build_deflators(S.fiscal_index(S.calendar_average(_observations(spark, d))), 1999)


@query("cal_avg", with_alloc(_OBS + "SELECT * FROM an"))
def cal_avg(spark, d):
    return S.calendar_average(_observations(spark, d))


@query("fy_index", with_alloc(_OBS + "SELECT * FROM fi"))
def fy_index(spark, d):
    return S.fiscal_index(S.calendar_average(_observations(spark, d)))


@query("deflators", with_alloc(_OBS + "SELECT fiscal_year, CAST(deflator AS DOUBLE) AS deflator FROM df"))
def deflators(spark, d):
    return _deflators(spark, d)


_PROJECT = _OBS + """
, kept AS (SELECT * FROM df WHERE fiscal_year <= 1999),
rt AS (SELECT fiscal_year, CAST(lag(deflator) OVER (ORDER BY fiscal_year) AS DOUBLE)
   / CAST(deflator AS DOUBLE) AS r, row_number() OVER (ORDER BY fiscal_year DESC) AS back FROM kept),
gr AS (SELECT CASE WHEN count(*) >= 4 THEN avg(CASE WHEN back <= 3 THEN r END) ELSE 1.025 END AS g,
   max(fiscal_year) AS ly FROM rt),
pj AS (SELECT fiscal_year, deflator, false AS projected FROM kept UNION ALL
  SELECT f.fiscal_year, CAST(round_even((SELECT CAST(deflator AS DOUBLE) FROM kept
     WHERE fiscal_year = ly) / pow(g, f.fiscal_year - ly), 4) AS DECIMAL(10, 4)), true
  FROM (SELECT DISTINCT fiscal_year FROM alloc) f, gr WHERE f.fiscal_year > ly)
"""


def _projected(spark, d):
    kept = _deflators(spark, d).where(F.col("fiscal_year") <= 1999)
    return S.project_deflators(kept, allocations(spark, d, "fiscal_year"))


@query("project", with_alloc(_PROJECT + """
SELECT fiscal_year, CAST(deflator AS DOUBLE) AS deflator, projected FROM pj"""))
def project(spark, d):
    return _projected(spark, d)


@query("deflate", with_alloc(_PROJECT + """
SELECT line_number, part_key, supplier_key, fiscal_year, CAST(amount AS DOUBLE) AS amount,
  CAST(coalesce(deflator, 1) AS DOUBLE) AS deflator,
  CAST(amount * coalesce(deflator, CAST(1 AS DECIMAL(10, 4))) AS DOUBLE) AS amount_real
FROM alloc LEFT JOIN pj USING (fiscal_year)"""))
def deflate(spark, d):
    rows = allocations(spark, d, "line_number", "part_key", "supplier_key", "fiscal_year",
                       "amount")
    out = deflate_rows(rows, _projected(spark, d), ["amount"])
    return out.withColumn("amount_real", F.col("amount_real"))


def _pair(expr, name):
    return (f"CAST(round_even({expr}, 0) AS DOUBLE) AS {name}_nominal, "
            f"CAST(round_even({expr} * dl, 0) AS DOUBLE) AS {name}_real")


_YEARLY = _PROJECT + """
, s AS (SELECT {keys}, fiscal_year,
  coalesce(sum(CASE WHEN section = 'Operating' THEN amount END), 0) AS op,
  coalesce(sum(CASE WHEN section = 'Capital Improvement' THEN amount END), 0) AS cap
  FROM alloc GROUP BY ALL),
t AS (SELECT s.*, op + cap AS tot, coalesce(deflator, CAST(1 AS DECIMAL(10, 4))) AS dl
  FROM s LEFT JOIN pj USING (fiscal_year))
"""


@query("totals_fy", with_alloc(_YEARLY.replace("{keys}, ", "") + f"""
SELECT fiscal_year, {_pair('op', 'operating')}, {_pair('cap', 'capital')},
  {_pair('tot', 'total')}, CAST(dl AS DOUBLE) AS deflator FROM t"""))
def totals_fy(spark, d):
    return S.totals_by_year(allocations(spark, d, "fiscal_year", "section", "amount"),
                            _projected(spark, d))


@query("yoy", with_alloc(_YEARLY.replace("{keys}, ", "") + """
, y AS (SELECT fiscal_year, CAST(round_even(tot * dl, 0) AS DOUBLE) AS total_real FROM t)
SELECT fiscal_year, total_real, (total_real - lag(total_real) OVER (ORDER BY fiscal_year))
  / lag(total_real) OVER (ORDER BY fiscal_year) * 100 AS yoy_pct FROM y"""))
def yoy(spark, d):
    return S.real_growth(allocations(spark, d, "fiscal_year", "section", "amount"),
                         _projected(spark, d)).select("fiscal_year", "total_real", "yoy_pct")


@query("dept_series", with_alloc(_YEARLY.format(keys="department_code") + f"""
, r AS (SELECT department_code, fiscal_year, {_pair('op', 'operating')}, {_pair('cap', 'capital')},
  {_pair('tot', 'total')}, CAST(dl AS DOUBLE) AS deflator FROM t)
SELECT *, last_value(total_nominal) OVER (PARTITION BY department_code ORDER BY fiscal_year
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest_total FROM r"""))
def dept_series(spark, d):
    return S.department_series(
        allocations(spark, d, "department_code", "fiscal_year", "section", "amount"),
        _projected(spark, d))


@query("fund_series", with_alloc(_YEARLY.format(keys="fund_category") + f"""
SELECT fund_category, fiscal_year, {_pair('tot', 'total')}, CAST(dl AS DOUBLE) AS deflator
FROM t WHERE tot <> 0"""))
def fund_series(spark, d):
    return S.fund_series(
        allocations(spark, d, "fund_category", "fiscal_year", "section", "amount"),
        _projected(spark, d))


@query("cash", with_alloc("""
, n AS (SELECT fund_type, fiscal_year,
  coalesce(sum(CASE WHEN draft = 'F' THEN amount END), 0)
    - coalesce(sum(CASE WHEN draft = 'O' THEN amount END), 0) AS net FROM alloc GROUP BY ALL),
r AS (SELECT *, 1000000 + sum(net) OVER (PARTITION BY fund_type ORDER BY fiscal_year) AS cash_end
  FROM n)
SELECT fund_type, fiscal_year, CAST(net AS DOUBLE) AS net, CAST(cash_end AS DOUBLE) AS cash_end,
  CAST(last_value(cash_end) OVER (PARTITION BY fund_type ORDER BY fiscal_year
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - 250000 AS DOUBLE) AS available
FROM r"""))
def cash(spark, d):
    rows = allocations(spark, d, "fund_type", "fiscal_year", "draft", "amount")
    signed = F.when(F.col("draft") == "F", F.col("amount")).otherwise(-F.col("amount"))
    net = rows.groupBy("fund_type", "fiscal_year").agg(F.sum(signed).alias("net"))
    return S.cash_roll(net, ["fund_type"], F.lit(1_000_000), F.lit(-250_000))


@query("series_nested", with_alloc(_YEARLY.format(keys="department_code") + f"""
, r AS (SELECT department_code, fiscal_year, {_pair('tot', 'total')} FROM t)
SELECT department_code, row_number() OVER (PARTITION BY department_code ORDER BY fiscal_year) - 1 AS place,
  fiscal_year, total_nominal AS nominal, total_real AS real FROM r"""))
def series_nested(spark, d):
    series = S.department_series(
        allocations(spark, d, "department_code", "fiscal_year", "section", "amount"),
        _projected(spark, d))
    nested = S.nest_series(series.select(
        "department_code", "fiscal_year", F.col("total_nominal").cast("double").alias("nominal"),
        F.col("total_real").cast("double").alias("real")), "department_code", ["nominal", "real"])
    # the nested rows in their order, one row each so that they can be compared
    return nested.select("department_code", F.posexplode("series").alias("place", "year")).select(
        "department_code", F.col("place").cast("long").alias("place"), "year.*")


# --- registry ----------------------------------------------------------------


def _registry(spark, d):
    """Sessions from the orders: two fiscal years each, one bill per priority."""
    rows = allocations(spark, d, "fiscal_year", "fund_type")
    per = rows.groupBy(
        (F.col("fiscal_year") - F.col("fiscal_year") % 2).alias("session")).agg(
        F.array_sort(F.collect_set("fiscal_year")).alias("fy_covered"),
        F.array_sort(F.collect_set("fund_type")).alias("letters"))
    return per.select(
        "session", "fy_covered",
        F.transform("letters", lambda x: F.struct(
            F.concat(F.lit("HB-"), x).alias("number"), F.concat(F.lit("Act "), x).alias("act"),
            F.lit("combined").alias("scope"))).alias("bills"))


@query("bill_registry", with_alloc("""
, s AS (SELECT DISTINCT fiscal_year - fiscal_year % 2 AS session, fund_type FROM alloc),
l AS (SELECT session, 'HB-' || string_agg(fund_type, ' + HB-' ORDER BY fund_type) AS label
  FROM s GROUP BY 1),
y AS (SELECT fiscal_year - fiscal_year % 2 AS session,
  array_to_string(list_sort(list(DISTINCT fiscal_year)), ',') AS years FROM alloc GROUP BY 1)
SELECT session, 'HB-' || fund_type AS number, 'Act ' || fund_type AS act, 'combined' AS scope,
  label, years FROM s JOIN l USING (session) JOIN y USING (session)"""))
def bill_registry(spark, d):
    reg = _registry(spark, d)
    return registry.explode_bills(reg).join(registry.bill_labels(reg), "session").select(
        "session", "number", "act", "scope", "label",
        F.array_join(F.transform("fy_covered", lambda y: y.cast("string")), ",").alias("years"))


@query("bill_notes", with_alloc("""
, s AS (SELECT DISTINCT fiscal_year - fiscal_year % 2 AS session, fund_type FROM alloc)
SELECT session, 'The ' || session || ' biennial budget was enacted as two bills: HB-' ||
  string_agg(fund_type, ' and HB-' ORDER BY fund_type) || '. Totals here combine both.' AS note
FROM s GROUP BY 1 HAVING count(*) > 1"""))
def bill_notes(spark, d):
    return registry.coverage_notes(_registry(spark, d))


@query("years_covered", with_alloc("SELECT DISTINCT fiscal_year FROM alloc"))
def years_covered(spark, d):
    return registry.years_covered(_registry(spark, d))


# --- sources -----------------------------------------------------------------


@query("lines", r"""
WITH p AS (SELECT doc_id, string_split(replace(replace(replace(text, chr(13) || chr(10), chr(10)),
   chr(13), chr(10)), chr(160), ' '), chr(10)) AS parts FROM documents)
SELECT doc_id, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line FROM p""")
def lines(spark, d):
    return readers.text_lines(table(spark, d, "documents"))


@query("veto_unpivot", """
WITH w AS (SELECT p_partkey, upper(substr(p_type, 1, 3)) || p_size AS program_id,
   CASE WHEN p_partkey % 3 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) END AS a,
   CASE WHEN p_partkey % 4 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) * 1000 END AS b FROM part)
SELECT p_partkey AS place, program_id, 2026 AS fiscal_year, CAST(a AS DOUBLE) AS amount,
  'A' AS fund_type, 'Veto change for ' || program_id || ' FY2026' AS notes FROM w WHERE a IS NOT NULL
UNION ALL SELECT p_partkey, program_id, 2027, b, 'W', 'Veto change for ' || program_id || ' FY2027'
FROM w WHERE b IS NOT NULL""")
def veto_unpivot(spark, d):
    price = F.floor("p_retailprice")
    wide = table(spark, d, "part").select(
        F.col("p_partkey").alias("place"),
        F.concat(F.upper(F.substring("p_type", 1, 3)), F.col("p_size").cast("string")).alias(
            "Program"),
        F.when(F.col("p_partkey") % 3 != 0, F.format_number(price, 0)).alias("FY 2026 Amount"),
        F.when(F.col("p_partkey") % 4 != 0, F.concat(F.format_number(price * 1000, 0), F.lit("W"))
               ).otherwise(F.lit(" ")).alias("FY 2027 Amount"))
    return readers.read_vetoes(wide, {"FY 2026 Amount": 2026, "FY 2027 Amount": 2027})


@query("one_time", """
SELECT 'N' || s_nationkey || '999' AS program_id, 'One-Time Appropriation: ' || s_name AS program_name,
  'N' || s_nationkey AS department_code, s_name AS department_name, 'One-Time' AS section,
  'A' AS fund_type, 2026 AS fiscal_year, CAST(s_acctbal AS DOUBLE) AS amount,
  0.0::DOUBLE AS positions, 'One-time appropriation: ' || s_name AS notes FROM supplier""")
def one_time(spark, d):
    rows = table(spark, d, "supplier").select(
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("department_code"),
        F.col("s_name").alias("department_name"),
        F.col("s_acctbal").cast("decimal(18,2)").cast("string").alias("amount"),
        F.col("s_name").alias("description"), F.lit("A").alias("fund_type"))
    return readers.one_time_rows(rows, 2026)


@query("feed_rollup", """
WITH f AS (SELECT 'Police ' || n_name AS department_name, c_mktsegment AS division_name,
   CASE c_nationkey % 3 WHEN 0 THEN 'General Fund' WHEN 1 THEN 'Sewer Fund' ELSE '' END AS fund_name,
   CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_acctbal AS DECIMAL(18, 2)) END AS amount
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT replace(lower(replace(department_name, '_', '-')), ' ', '-') AS department_code,
  department_name, division_name AS program_name,
  coalesce(nullif(fund_name, ''), 'Unspecified') AS fund_name,
  CASE fund_name WHEN 'General Fund' THEN 'General Fund' WHEN 'Sewer Fund'
    THEN 'Special / Enterprise Funds' ELSE 'Trust & Other Funds' END AS fund_category,
  CAST(sum(amount) AS DOUBLE) AS amount
FROM f WHERE amount IS NOT NULL GROUP BY department_name, division_name, fund_name
HAVING sum(amount) <> 0""")
def feed_rollup(spark, d):
    bal = F.col("c_acctbal").cast("decimal(18,2)")
    text = F.when(bal < 0, F.concat(F.lit("$ ("), F.abs(bal).cast("string"), F.lit(")"))).otherwise(
        F.concat(F.lit("$   "), F.format_number(bal, 2)))
    feed = table(spark, d, "customer").join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit(" Police "), "n_name").alias("department_name"),
        F.col("c_mktsegment").alias("division_name"),
        F.element_at(F.array(F.lit("General Fund"), F.lit("Sewer Fund"), F.lit("")),
                     (F.col("c_nationkey") % 3 + 1)).alias("fund_name"),
        F.when(F.col("c_custkey") % 9 != 0, text).otherwise(F.lit(" - ")).alias("proposed"))
    return readers.feed_rollup(feed, "proposed")


@query("observations_json", """
SELECT CAST(year(o_orderdate) AS BIGINT) AS year, 'M' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0')
  AS period, o_totalprice AS value FROM orders WHERE o_orderstatus <> 'P'""")
def observations_json(spark, d):
    value = F.when(F.col("o_orderstatus") == "P", F.lit("-")).otherwise(
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    data = F.array(F.struct(
        F.year("o_orderdate").cast("string").alias("year"),
        F.format_string("M%02d", F.month("o_orderdate")).alias("period"), value.alias("value")))
    body = F.struct(F.struct(F.array(F.struct(data.alias("data"))).alias("series")).alias("Results"))
    return readers.flatten_observations(
        table(spark, d, "orders").select(F.to_json(body).alias("value")))


# The rules shared by both formats, as SQL steps over a column t.
_TIDY = r"""
u1 AS (SELECT id, regexp_replace(replace(t, chr(160), ' '), '\[([^\]]*)\]', ' \1', 'g') AS t
  FROM u0),
u2 AS (SELECT id, regexp_replace(t, '(\d+\.\s+[A-Z][A-Z0-9]+)\s*\n+\s*(-\s)', '\1 \2', 'g') AS t
  FROM u1),
u3 AS (SELECT id, {split} AS t FROM u2),
u4 AS (SELECT id, regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g') AS t FROM u3),
u5 AS (SELECT id, regexp_replace(t, '(?m)^.*[HS]\.B\. NO\.\s+\d+.*$', '', 'g') AS t FROM u4)
"""


@query("html_text", r"""
WITH h1 AS (SELECT page_id AS id, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<head\b[^>]*>.*?</(?:style|script|head)\s*>', '', 'g') AS t FROM pages),
h2 AS (SELECT id, regexp_replace(t, '(?i)<br\b[^>]*>|</?(p|div)\b[^>]*>', chr(10), 'g') AS t FROM h1),
h3 AS (SELECT id, regexp_replace(t, '(?s)<[!/a-zA-Z?][^>]*>', '', 'g') AS t FROM h2),
h4 AS (SELECT id, replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'),
  '&quot;', '"') AS t FROM h3),
u0 AS (SELECT id, replace(regexp_replace(replace(t, '&amp;', chr(1)), '&[A-Za-z][A-Za-z0-9]*;', '',
  'g'), chr(1), '&') AS t FROM h4),
""" + _TIDY.replace("{split}", r"""regexp_replace(regexp_replace(t,
  '\bINVESTMENT\s*\n(\s*CAPITAL\b)', 'INVESTMENT CAPITAL', 'g'),
  '\b([A-Z]{2,4}) *\n(\s*\d+(?:,\d+)+[A-Z])', '\1  \2', 'g')""") + r"""
SELECT id AS page_id, regexp_replace(t, '^\s+|\s+$', '', 'g') || chr(10) AS text FROM u5""")
def html_text(spark, d):
    return table(spark, d, "pages").select(
        "page_id", markup.html_to_text(F.col("html")).alias("text"))


@query("rtf_text", "WITH u0 AS (SELECT doc_id AS id, text AS t FROM documents),"
       + _TIDY.replace("{split}", "t") + r""",
u6 AS (SELECT id, regexp_replace(t, '(?im)^(\s*[A-Z]{2,4}\s.*[A-Za-z])"$', '\1', 'g') AS t FROM u5)
SELECT id AS doc_id, regexp_replace(t, '^\s+|\s+$', '', 'g') || chr(10) AS text FROM u6""")
def rtf_text(spark, d):
    wrapped = F.concat(
        F.lit("{\\rtf1{\\fonttbl\\f0 Arial;}{\\colortbl;}\\pard "),
        F.replace("text", F.lit("\n"), F.lit("\\\n")), F.lit("}"))
    return table(spark, d, "documents").select("doc_id", markup.rtf_to_text(wrapped).alias("text"))


@query("description_blocks", r"""
SELECT doc_id, 'ABC' AS department_code, 'The Department of ' || upper(substr(source, 1, 1)) ||
  lower(substr(source, 2)) AS name, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS description
FROM documents
UNION ALL SELECT doc_id, 'WRK', 'The Department of Works', 'builds roads.' FROM documents
UNION ALL SELECT doc_id, 'LAW', 'Department of Law Enforcement', 'Consolidates law enforcement.'
FROM documents""")
def description_blocks(spark, d):
    docs = table(spark, d, "documents").withColumn(
        "text", F.concat(
            F.lit("Preface\n The Department of "), F.initcap("source"), F.lit(" (ABC)  "),
            "text", F.lit("\nThe Department of Works (WRK)\n builds\n roads."),))
    return readers.extract_blocks(docs, defaults=[
        {"department_code": "LAW", "name": "Department of Law Enforcement",
         "description": "Consolidates law enforcement."}])


