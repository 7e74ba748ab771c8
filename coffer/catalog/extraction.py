"""Queries over bill lines rendered from the tables.

The SQL side never reads text: it computes the expected rows from the sums
that the lines were rendered from.
"""

from pyspark.sql import functions as F

from ..operators import grants as G
from ..operators import lines as L
from ..operators import projects as P
from ..plans import bill as B
from ..plans.testdata import allocations, first_lines, table
from ..session import cut_lineage
from .base import query, with_alloc

_CODES = "[" + ", ".join(f"'{c}'" for c in B.CODES) + "]"

_CELLS = f"""
WITH src AS (SELECT year(o_orderdate) + CASE WHEN month(o_orderdate) >= 7 THEN 1 ELSE 0 END AS fy,
   c_nationkey AS k, p_size AS s, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS f,
   l_returnflag AS r, CAST(l_quantity AS BIGINT) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey),
cell AS (SELECT 'B' || (fy - fy % 2) AS doc_id, fy - fy % 2 AS fy1, k, s, f,
   {_CODES}[k + 1] AS code, {_CODES}[k + 1] || lpad(CAST(s AS VARCHAR), 3, '0') AS pid,
   ['A', 'B', 'N', 'C', 'W'][f + 1] AS fund, (k * 50 + s) * 200 AS base,
   coalesce(sum(CASE WHEN r = 'N' AND fy % 2 = 0 THEN v END), 0) AS op1,
   coalesce(sum(CASE WHEN r = 'N' AND fy % 2 = 1 THEN v END), 0) AS op2,
   coalesce(sum(CASE WHEN r = 'A' AND fy % 2 = 0 THEN v END), 0) AS cap1,
   coalesce(sum(CASE WHEN r = 'A' AND fy % 2 = 1 THEN v END), 0) AS cap2,
   coalesce(sum(CASE WHEN r = 'R' AND fy % 2 = 0 THEN v END), 0) AS extra1,
   coalesce(sum(CASE WHEN r = 'R' AND fy % 2 = 1 THEN v END), 0) AS extra2,
   coalesce(sum(CASE WHEN fy % 2 = 0 THEN q END), 0) AS q1,
   coalesce(sum(CASE WHEN fy % 2 = 1 THEN q END), 0) AS q2
  FROM src GROUP BY ALL),
prog AS (SELECT doc_id, fy1, k, s, code, pid, base, sum(q1) AS q1, sum(q2) AS q2,
   sum(cap1 + cap2) AS cap, count(*) AS n FROM cell GROUP BY ALL)
"""

# Expected lines with a year pair or an amendment, with their kinds.
_LINES = _CELLS + """,
ln AS (
  SELECT *, base + f * 4 + 10 AS line_no, op1 AS a1, op2 AS a2, 'Operating' AS section,
    CASE WHEN op1 > 0 AND op2 > 0 THEN CASE WHEN s % 2 = 0 THEN 'operating_line' ELSE 'two_col' END
         WHEN op1 > 0 THEN 'operating_pdf' ELSE 'fy2_only' END AS kind
  FROM cell WHERE op1 > 0 OR op2 > 0
  UNION ALL
  SELECT *, base + f * 4 + 11, NULL, extra2, 'Operating', 'bare_amendment'
  FROM cell WHERE s % 5 = 0 AND extra2 > 0
  UNION ALL
  SELECT *, base + f * 4 + 51, cap1, cap2, 'Capital Improvement',
    CASE WHEN cap1 > 0 AND cap2 > 0 THEN 'capital_two_col' WHEN cap1 > 0 THEN 'capital_single'
         ELSE 'capital_fy2' END
  FROM cell WHERE cap1 > 0 OR cap2 > 0),
used AS (SELECT doc_id, pid, min(line_no) AS use_line FROM ln
  WHERE kind NOT IN ('operating_pdf', 'bare_amendment') GROUP BY ALL)
"""

_AMENDED = _LINES + """,
orig AS (SELECT doc_id, pid, code, s, f, fund, section, line_no, kind, fy1 AS fiscal_year,
    a1 AS amount, 1 AS slot FROM ln WHERE kind <> 'bare_amendment' AND a1 > 0
  UNION ALL SELECT doc_id, pid, code, s, f, fund, section, line_no, kind, fy1 + 1, a2, 2 FROM ln
    WHERE kind <> 'bare_amendment' AND a2 > 0),
am AS (SELECT doc_id, pid, code, s, f, fund, section, line_no, fy1 + 1 AS fiscal_year,
    a2 AS amount FROM ln WHERE kind = 'bare_amendment'),
fin AS (
  SELECT o.doc_id, o.pid, o.code, o.s, o.fund, o.section, o.line_no, o.fiscal_year, o.slot,
    coalesce(am.amount, o.amount) AS amount
  FROM orig o LEFT JOIN am ON o.doc_id = am.doc_id AND o.pid = am.pid AND o.fund = am.fund
    AND o.section = am.section AND o.fiscal_year = am.fiscal_year
  UNION ALL
  SELECT am.doc_id, am.pid, am.code, am.s, am.fund, am.section, am.line_no, am.fiscal_year, 2,
    am.amount
  FROM am ANTI JOIN orig o ON o.doc_id = am.doc_id AND o.pid = am.pid AND o.fund = am.fund
    AND o.section = am.section AND o.fiscal_year = am.fiscal_year)
"""


def _program_lines(spark, d):
    return cut_lineage(B.program_lines(cut_lineage(B.cells(spark, d))))


def _bill_lines(spark, d):
    return cut_lineage(B.bill_lines(spark, d))


def _years():
    return B.first_year(), B.first_year() + 1


@query("line_kinds", _LINES + """
, al AS (SELECT doc_id, kind FROM ln
  UNION ALL SELECT doc_id, unnest(['category', 'program', 'positions']) FROM prog
  UNION ALL SELECT doc_id, 'positions_temp' FROM prog WHERE s % 2 = 0
  UNION ALL SELECT doc_id, 'capital' FROM prog WHERE cap > 0)
SELECT doc_id, kind, count(*) AS n FROM al GROUP BY ALL""")
def line_kinds(spark, d):
    return L.classify_lines(_program_lines(spark, d)).groupBy("doc_id", "kind").agg(
        F.count(F.lit(1)).alias("n"))


@query("carry", _LINES + """
SELECT doc_id, line_no, pid AS program_id, code AS context_department,
  section = 'Capital Improvement' AS in_capital,
  CASE s % 11 WHEN 0 THEN 'Economic Development' WHEN 1 THEN 'Employment' WHEN 2 THEN
    'Transportation' WHEN 3 THEN 'Environment' WHEN 4 THEN 'Health' WHEN 5 THEN 'Human Services'
    WHEN 6 THEN 'Education' WHEN 7 THEN 'Culture and Recreation' WHEN 8 THEN 'Public Safety'
    WHEN 9 THEN 'Individual Rights' ELSE 'Government Operations' END AS category
FROM ln""")
def carry(spark, d):
    rows = L.classify_lines(_program_lines(spark, d))
    return rows.where(F.col("kind").isin(L.PAIR_KINDS + L.AMENDMENT_KINDS)).select(
        "doc_id", "line_no", "program_id", "context_department", "in_capital", "category")


@query("year_pair", _LINES + """
SELECT doc_id, line_no, pid AS program_id, fy1 AS fiscal_year, fund AS fund_type,
  CAST(a1 AS DOUBLE) AS amount FROM ln WHERE kind <> 'bare_amendment' AND a1 > 0
UNION ALL SELECT doc_id, line_no, pid, fy1 + 1, fund, CAST(a2 AS DOUBLE) FROM ln
WHERE kind <> 'bare_amendment' AND a2 > 0""")
def year_pair(spark, d):
    pairs = L.read_pairs(L.classify_lines(_program_lines(spark, d)))
    return L.explode_years(pairs, *_years()).select(
        "doc_id", "line_no", "program_id", "fiscal_year", "fund_type", "amount")


@query("positions", _LINES + """
SELECT l.doc_id, l.line_no,
  CASE WHEN l.line_no <= coalesce(use_line, 1e18) THEN CAST(p.q1 AS DOUBLE) END AS perm1,
  CASE WHEN l.line_no <= coalesce(use_line, 1e18) THEN CAST(p.q2 AS DOUBLE) END AS perm2,
  CASE WHEN l.line_no <= coalesce(use_line, 1e18) AND l.s % 2 = 0 THEN CAST(p.n AS DOUBLE) END
    AS temp1
FROM ln l JOIN prog p USING (doc_id, pid) LEFT JOIN used USING (doc_id, pid)""")
def positions(spark, d):
    rows = L.carry_positions(L.classify_lines(_program_lines(spark, d)))
    return rows.where(F.col("kind").isin(L.PAIR_KINDS + L.AMENDMENT_KINDS)).select(
        "doc_id", "line_no", "perm1", "perm2", "temp1")


@query("amend", _AMENDED + """
SELECT doc_id, pid AS program_id, fund AS fund_type, section, code AS department_code,
  fiscal_year, line_no, CAST(amount AS DOUBLE) AS amount FROM fin""")
def amend(spark, d):
    classified = cut_lineage(L.carry_positions(L.classify_lines(_program_lines(spark, d))))
    originals = cut_lineage(L.explode_years(L.read_pairs(classified), *_years()).drop("kind"))
    amendments = cut_lineage(L.read_amendments(classified, originals, *_years()))
    return L.apply_amendments(originals, amendments).select(*L.RUN_KEYS, "line_no", "amount")


@query("bill_allocations", _AMENDED + """
SELECT fin.doc_id, pid AS program_id, 'PROGRAM ' || pid AS program_name, code AS department_code,
  section, fund AS fund_type, fiscal_year, line_no AS line_number,
  CAST(amount AS DOUBLE) AS amount,
  CASE WHEN line_no <= coalesce(use_line, 1e18) THEN
    CAST(CASE WHEN slot = 1 THEN p.q1 + CASE WHEN fin.s % 2 = 0 THEN p.n ELSE 0 END
      ELSE p.q2 + CASE WHEN fin.s % 2 = 0 THEN 1.5 ELSE 0 END END AS DOUBLE) END AS positions,
  CASE WHEN line_no <= coalesce(use_line, 1e18) THEN
    CAST(CASE WHEN fin.s % 2 = 1 THEN 0 WHEN slot = 1 THEN p.n ELSE 1.5 END AS DOUBLE) END
    AS positions_temp
FROM fin JOIN prog p USING (doc_id, pid, code) LEFT JOIN used USING (doc_id, pid)""")
def bill_allocations(spark, d):
    rows = L.extract_allocations(_bill_lines(spark, d), *_years())
    return rows.select("doc_id", "program_id", "program_name", "department_code", "section",
                       "fund_type", "fiscal_year", "line_number", "amount", "positions",
                       "positions_temp")


@query("alloc_build", with_alloc("""
SELECT program_id, department_code, coalesce(category, 'Uncategorized') AS category,
  department_code AS department_name, fund_category, count(*) AS n
FROM alloc GROUP BY ALL"""))
def alloc_build(spark, d):
    rows = allocations(spark, d, "program_id", "program_name", "department_code", "category",
                       "fund_type")
    return L.build_allocations(rows).groupBy(
        "program_id", "department_code", "category", "department_name", "fund_category").agg(
        F.count(F.lit(1)).alias("n"))


@query("span", _CELLS + """
, dp AS (SELECT DISTINCT doc_id, k, s, f, cap1, cap2, extra2 FROM cell),
pr AS (SELECT doc_id, 4 + CASE WHEN s % 7 = 0 THEN 2 ELSE 0 END
   + CASE WHEN s % 5 = 0 AND extra2 >= 1000 THEN 1 ELSE 0 END AS n
  FROM cell WHERE cap1 >= 1000 OR cap2 >= 1000),
al AS (SELECT doc_id, n FROM pr UNION ALL SELECT doc_id, 1 FROM prog
  UNION ALL SELECT DISTINCT doc_id, 1 FROM prog)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS lines_in_list FROM al GROUP BY 1""")
def span(spark, d):
    rows = L.mark_project_span(L.prepare_lines(_bill_lines(spark, d)))
    return rows.where("in_list").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines_in_list"))


_PROJECTS = _CELLS + """
, pj AS (SELECT *, floor(cap1 / 1000) AS t1, floor(cap2 / 1000) AS t2,
   CASE WHEN s % 5 = 0 THEN floor(extra2 / 1000) ELSE 0 END AS x FROM cell
  WHERE cap1 >= 1000 OR cap2 >= 1000),
py AS (SELECT *, fy1 AS fiscal_year, t1 * 1000 AS amount, 6 AS spot FROM pj WHERE t1 > 0
  UNION ALL SELECT *, fy1 + 1, CASE WHEN x > 0 THEN x ELSE t2 END * 1000,
    CASE WHEN t2 > 0 THEN 6 ELSE 7 END FROM pj WHERE t2 > 0 OR x > 0)
"""


@query("projects", _PROJECTS + """
SELECT doc_id, CAST(f + 1 AS VARCHAR) AS project_id, 'WORKS ' || pid || ' ' || fund AS project_name,
  'PLANS AND DESIGN FOR ' || pid AS scope, pid AS program_id, code AS department_code, fiscal_year,
  fund AS fund_type, CAST(amount AS DOUBLE) AS amount,
  1000000 + base + f * 10 + spot AS line_number FROM py""")
def projects(spark, d):
    return P.extract_projects(_bill_lines(spark, d), *_years()).select(
        "doc_id", "project_id", "project_name", "scope", "program_id", "department_code",
        "fiscal_year", "fund_type", "amount", "line_number")


@query("reissue", _CELLS + """
SELECT doc_id, 1000000 + base + f * 10 + 1 AS block FROM cell
WHERE s % 7 = 0 AND (cap1 >= 1000 OR cap2 >= 1000)""")
def reissue(spark, d):
    context = cut_lineage(P.project_context(_bill_lines(spark, d)))
    return P.reissued_blocks(context)


# A title repeated right after itself replaces the first print, which happens where a program
# lists one project only; elsewhere a copy goes if the program's capital total doesn't hold it.
@query("reconcile", _PROJECTS + """
, alone AS (SELECT doc_id, pid FROM pj WHERE s % 3 = 0 GROUP BY ALL HAVING count(*) = 1),
first AS (SELECT * FROM py ANTI JOIN alone USING (doc_id, pid)),
cp AS (SELECT *, fy1 AS fiscal_year, t1 * 1000 AS amount FROM pj WHERE s % 3 = 0 AND t1 > 0
  UNION ALL SELECT *, fy1 + 1, t2 * 1000 FROM pj WHERE s % 3 = 0 AND t2 > 0),
ex AS (SELECT doc_id, pid, fund, fiscal_year, CAST(cp.amount AS DOUBLE) AS again,
   CAST(py.amount + cp.amount - CASE WHEN fiscal_year = py.fy1 THEN py.cap1 ELSE py.cap2 END AS DOUBLE) AS over
  FROM cp JOIN first AS py USING (doc_id, pid, fund, fiscal_year)),
kept AS (SELECT cp.* FROM cp LEFT JOIN ex USING (doc_id, pid, fund, fiscal_year)
  WHERE NOT coalesce(over > 0.5 AND again <= over + 0.5, false))
SELECT doc_id, pid AS program_id, fund AS fund_type, fiscal_year, CAST(f + 1 AS VARCHAR) AS project_id,
  1000000 + base + f * 10 + spot AS line_number, CAST(amount AS DOUBLE) AS amount FROM first
UNION ALL SELECT doc_id, pid, fund, fiscal_year, '9' || (f + 1) || '.1',
  1000000 + base + f * 10 + 101, CAST(amount AS DOUBLE) FROM kept""")
def reconcile(spark, d):
    cell = cut_lineage(B.cells(spark, d))
    lines = cut_lineage(
        B.program_lines(cell).unionByName(B.project_lines(cell, copies=True)))
    parsed = B.parse_bills(lines)
    return parsed["projects"].select("doc_id", "program_id", "fund_type", "fiscal_year",
                                     "project_id", "line_number", "amount")


@query("excess", _PROJECTS + """
, tg AS (SELECT doc_id, pid, fund, fy1 AS fiscal_year, cap1 AS target FROM cell
  UNION ALL SELECT doc_id, pid, fund, fy1 + 1, cap2 FROM cell)
SELECT py.doc_id, py.pid AS program_id, py.fund AS fund_type, py.fiscal_year,
  CAST(amount AS DOUBLE) AS listed, CAST(target AS DOUBLE) AS target,
  CAST(amount - target AS DOUBLE) AS excess
FROM py JOIN tg USING (doc_id, pid, fund, fiscal_year) WHERE amount - target > 0.5""")
def excess(spark, d):
    lines = _bill_lines(spark, d)
    found = cut_lineage(L.extract_allocations(lines, *_years()))
    listed = P.extract_projects(lines, *_years())
    return P.unresolved_excess(listed, found)


@query("large_dups", with_alloc("""
, a AS (SELECT program_id, fiscal_year, section, fund_type, line_number,
   CAST(floor(amount / 1000) AS DECIMAL(18, 2)) AS amount FROM alloc)
SELECT program_id, fiscal_year, section, CAST(amount AS DOUBLE) AS amount, count(*) AS n FROM (
  SELECT * FROM a WHERE amount <= 50
  UNION ALL SELECT * FROM a WHERE amount > 50 QUALIFY row_number() OVER (
    PARTITION BY program_id, fiscal_year, section, amount ORDER BY line_number, fund_type) = 1)
GROUP BY ALL"""))
def large_dups(spark, d):
    rows = allocations(spark, d, "program_id", "fiscal_year", "section", "fund_type",
                       "line_number", "amount")
    coarse = rows.withColumn("amount", F.floor(F.col("amount") / 1000).cast("decimal(18,2)"))
    return L.dedupe_large_repeats(coarse, scope=(), threshold=50).groupBy(
        "program_id", "fiscal_year", "section", "amount").agg(F.count(F.lit(1)).alias("n"))


@query("repeat_findings", with_alloc("""
SELECT program_id, fiscal_year, section, CAST(floor(amount / 1000) AS DOUBLE) AS amount,
  min(line_number) AS kept_line, count(*) - 1 AS removed
FROM alloc WHERE floor(amount / 1000) > 50 GROUP BY program_id, fiscal_year, section, floor(amount / 1000)
HAVING count(*) > 1"""))
def repeat_findings(spark, d):
    rows = allocations(spark, d, "program_id", "fiscal_year", "section", "fund_type",
                       "line_number", "amount")
    coarse = rows.withColumn("amount", F.floor(F.col("amount") / 1000).cast("decimal(18,2)"))
    return L.removed_repeats(coarse, scope=(), threshold=50)


@query("grants", _CELLS + """
, g AS (SELECT doc_id, fy1, k, s, code, pid, sum(extra1) AS v FROM cell GROUP BY ALL)
SELECT doc_id, 2000000 + k * 1000 AS block_line, 2000000 + k * 1000 + s * 10 AS line_number,
  CASE WHEN s % 3 = 0 THEN pid ELSE code || '900' END AS program_id, code AS department_code,
  fy1 + 1 AS fiscal_year, CAST(v AS DOUBLE) AS amount, 'Ch.42F grant: RECIPIENT ' || pid AS notes
FROM g WHERE v > 0""")
def grants(spark, d):
    return G.extract_grants(_bill_lines(spark, d)).select(
        "doc_id", "block_line", "line_number", "program_id", "department_code", "fiscal_year",
        "amount", "notes")


@query("grant_audit", _CELLS + """
, g AS (SELECT doc_id, fy1, k, s, sum(extra1) AS v FROM cell GROUP BY ALL)
SELECT doc_id, 2000000 + k * 1000 AS block_line, fy1 + 1 AS fiscal_year,
  CAST(sum(v) AS DOUBLE) AS declared_total, CAST(sum(v) AS DOUBLE) AS itemized_total,
  count(*) AS item_count, true AS reconciles
FROM g WHERE v > 0 GROUP BY doc_id, fy1, k""")
def grant_audit(spark, d):
    lines = _bill_lines(spark, d)
    return G.audit_grants(lines, G.extract_grants(lines))


@query("dims", with_alloc("""
SELECT department_code AS code, min(department_name) AS name, NULL AS category,
  NULL AS is_capital FROM alloc GROUP BY 1
UNION ALL
SELECT program_id, program_name, category, is_capital FROM (
  SELECT *, section = 'Capital Improvement' AS is_capital FROM alloc)
QUALIFY row_number() OVER (PARTITION BY program_id ORDER BY line_number, program_name,
  department_code, category, is_capital) = 1"""))
def dims(spark, d):
    departments = L.distinct_departments(allocations(
        spark, d, "department_code", "department_name", "line_number")).select(
        F.col("department_code").alias("code"), F.col("department_name").alias("name"))
    firsts = allocations(spark, d, "department_code", "program_id", "program_name", "category", "section",
                         "line_number", lines=first_lines(spark, d))
    programs = L.distinct_programs(firsts).select(
        F.col("program_id").alias("code"), F.col("program_name").alias("name"), "category",
        "is_capital")
    return departments.unionByName(programs, allowMissingColumns=True).select(
        "code", "name", "category", "is_capital")


_MONEY_TEXT = r"""
WITH p AS (SELECT doc_id, string_split(text || chr(10) || 'Sum $1,200 and 3,400B for lot 77'
   || chr(10) || '1. ABC123 - 500,000 UNITS', chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS line_no, trim(unnest(parts), ' ') AS text
  FROM p),
m AS (SELECT *, regexp_matches(text, '\b\d{1,3}(?:,\d{3})+[A-Z]\b|\b\d{6,}[A-Z]?\b|\$\s*\d{1,3}(?:,\d{3})*(?:\.\d{2})?[A-Z]?\b') AS money,
  regexp_matches(text, '^\s*(\d+)\.\s*([A-Z]{3}\d+)\s*-\s*(.+)$|^\s*OPERATING\s+([A-Z]+)\s+([\d,]+)([A-Z])\s+([A-Z])\s*$|^\s*([A-Z]+)\s+([\d,]+)([A-Z])\s+([\d,]+)([A-Z])\s*$|^\s*CAPITAL IMPROVEMENT\s+([A-Z]+)\s+([\d,]+)([A-Z])\s*$') AS ruled
  FROM l)
"""


def _money_lines(spark, d):
    from ..sources.readers import text_lines

    docs = table(spark, d, "documents").withColumn("text", F.concat(
        "text", F.lit("\nSum $1,200 and 3,400B for lot 77\n1. ABC123 - 500,000 UNITS")))
    return text_lines(docs)


@query("uncovered", _MONEY_TEXT + """
SELECT a.doc_id, a.line_no, a.text, b.text AS prev_text, c.text AS next_text FROM m a
LEFT JOIN l b ON a.doc_id = b.doc_id AND b.line_no = a.line_no - 1
LEFT JOIN l c ON a.doc_id = c.doc_id AND c.line_no = a.line_no + 1
WHERE a.money AND NOT a.ruled""")
def uncovered(spark, d):
    return L.uncovered_money_lines(_money_lines(spark, d))


@query("coverage", _MONEY_TEXT + """
SELECT doc_id, count(*) FILTER (money) AS money_lines,
  count(*) FILTER (money AND ruled) AS read_lines,
  round_even(count(*) FILTER (money AND ruled) * 1.0 / nullif(count(*) FILTER (money), 0) * 100, 1)
    AS coverage_pct FROM m GROUP BY 1""")
def coverage(spark, d):
    return L.coverage(_money_lines(spark, d))
