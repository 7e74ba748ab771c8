"""Aggregation queries."""

from pyspark.sql import functions as F

from ..operators import rollup as R
from ..operators.ordered import top_per_group
from ..operators.shares import add_metrics
from ..operators.views import previous_by_year, standard_view
from ..plans.testdata import allocations
from ..schema import FUND_GROUPS_CHART, FUND_GROUPS_REPORT
from ..sinks.writers import nest, refresh_field
from .base import query, with_alloc

NOT_GRANT = "section <> 'Grants in Aid'"


def _sum_section(section, alias):
    return (f"CAST(coalesce(sum(CASE WHEN section = '{section}' THEN amount END), 0) AS DOUBLE)"
            f" AS {alias}")


OP, CAP, ONE = (
    _sum_section("Operating", "operating_budget"),
    _sum_section("Capital Improvement", "capital_budget"),
    _sum_section("One-Time", "one_time_appropriations"),
)


@query("agg_by", with_alloc("""
SELECT section, fund_type, CAST(sum(amount) AS DOUBLE) AS amount,
       CAST(sum(amount) AS DOUBLE) / (SELECT CAST(sum(amount) AS DOUBLE) FROM alloc) * 100
         AS pct_of_total
FROM alloc GROUP BY ALL"""))
def agg_by(spark, d):
    return R.aggregate_by(allocations(spark, d, "section", "fund_type", "amount"),
                          ["section", "fund_type"])


@query("stats", with_alloc("""
SELECT CAST(sum(amount) AS DOUBLE) AS total, count(amount) AS count,
       CAST(sum(amount) AS DOUBLE) / count(amount) AS mean,
       round(median(CAST(amount AS DOUBLE)), 4) AS median,
       CAST(min(amount) AS DOUBLE) AS min, CAST(max(amount) AS DOUBLE) AS max,
       round(stddev_samp(CAST(amount AS DOUBLE)), 4) AS std,
       count(*) FILTER (amount <> 0) AS non_zero_count,
       count(*) FILTER (amount = 0) AS zero_count
FROM alloc"""))
def stats(spark, d):
    out = R.summary_stats(allocations(spark, d, "amount"))
    return out.withColumn("std", F.round("std", 4))


@query("stats_by", with_alloc("""
SELECT department_code, CAST(sum(amount) AS DOUBLE) AS total, count(amount) AS count,
       CAST(sum(amount) AS DOUBLE) / count(amount) AS mean,
       round(median(CAST(amount AS DOUBLE)), 4) AS median
FROM alloc GROUP BY ALL"""))
def stats_by(spark, d):
    return R.summary_stats(allocations(spark, d, "department_code", "amount"),
                           keys=["department_code"])


@query("dept_rollup", with_alloc(f"""
SELECT department_code, min(department_name) AS name, lower(department_code) AS id,
       {OP}, {CAP}, {ONE},
       CAST(coalesce(sum(positions), 0) AS DOUBLE) AS positions,
       CAST(sum(amount) AS DOUBLE) AS total_budget,
       CASE WHEN sum(amount) >= 1e9 THEN printf('$%.1fB', CAST(sum(amount) AS DOUBLE) / 1e9)
            ELSE printf('$%.0fM', CAST(sum(amount) AS DOUBLE) / 1e6) END AS budget
FROM alloc WHERE fiscal_year = 1998 AND {NOT_GRANT}
GROUP BY department_code"""))
def dept_rollup(spark, d):
    rows = allocations(spark, d, "department_code", "department_name", "section", "amount",
                       "positions", "fiscal_year", years=[1998])
    return R.department_rollup(standard_view(rows, 1998))


@query("fund_breakdown", with_alloc("""
SELECT department_code, fund_category, CAST(sum(amount) AS DOUBLE) AS amount
FROM alloc GROUP BY ALL HAVING sum(amount) <> 0"""))
def fund_breakdown(spark, d):
    return R.fund_breakdown(allocations(spark, d, "department_code", "fund_category", "amount"),
                            ["department_code"], drop_zero=True)


@query("program_rollup", with_alloc("""
SELECT department_code, program_id, program_name, section, fund_type, fund_category,
       CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(positions) AS DOUBLE) AS positions
FROM alloc GROUP BY ALL"""))
def program_rollup(spark, d):
    return R.program_rollup(allocations(spark, d, *R.PROGRAM_KEYS, "amount", "positions"))


@query("summary", with_alloc(f"""
SELECT fiscal_year, CAST(sum(amount) AS DOUBLE) AS total_budget, {OP}, {CAP}, {ONE},
       CAST(coalesce(sum(positions), 0) AS DOUBLE) AS total_positions,
       count(DISTINCT department_code) AS num_departments,
       count(DISTINCT program_id) AS num_programs, count(*) AS num_records
FROM alloc WHERE {NOT_GRANT} GROUP BY fiscal_year"""))
def summary(spark, d):
    rows = allocations(spark, d, "fiscal_year", "section", "amount", "positions",
                       "department_code", "program_id")
    return R.summary_row(standard_view(rows), ["fiscal_year"])


YEARS = list(range(1995, 2003))


@query("xtab", with_alloc(
    "SELECT section, " + ", ".join(
        f"CAST(coalesce(sum(CASE WHEN fiscal_year = {y} THEN amount END), 0) AS DOUBLE) AS \"{y}\""
        for y in YEARS)
    + ", CAST(sum(amount) AS DOUBLE) AS total FROM alloc GROUP BY section"))
def xtab(spark, d):
    return R.cross_tab(allocations(spark, d, "section", "fiscal_year", "amount"),
                       ["section"], "fiscal_year", YEARS)


@query("xtab_funds", with_alloc("""
SELECT fiscal_year, section,
       CAST(coalesce(sum(CASE WHEN fund_type = 'A' THEN amount END), 0) AS DOUBLE) AS "A",
       CAST(coalesce(sum(CASE WHEN fund_type = 'B' THEN amount END), 0) AS DOUBLE) AS "B",
       CAST(coalesce(sum(CASE WHEN fund_type = 'N' THEN amount END), 0) AS DOUBLE) AS "N",
       CAST(sum(amount) AS DOUBLE) AS total
FROM alloc GROUP BY fiscal_year, section"""))
def xtab_funds(spark, d):
    return R.cross_tab(allocations(spark, d, "section", "fiscal_year", "fund_type", "amount"),
                       ["fiscal_year", "section"], "fund_type", ["A", "B", "N"])


@query("year_totals", with_alloc("""
, y AS (SELECT fiscal_year, CAST(sum(amount) AS DOUBLE) AS total,
   CAST(coalesce(sum(CASE WHEN lower(section) LIKE '%operating%' THEN amount END), 0) AS DOUBLE)
     AS operating,
   CAST(coalesce(sum(CASE WHEN lower(section) LIKE '%capital%' THEN amount END), 0) AS DOUBLE)
     AS capital
  FROM alloc GROUP BY fiscal_year)
SELECT *, round_even(operating / nullif(total, 0) * 100, 2) AS operating_pct,
       round_even(capital / nullif(total, 0) * 100, 2) AS capital_pct FROM y"""))
def year_totals(spark, d):
    return R.year_totals(allocations(spark, d, "fiscal_year", "section", "amount"))


@query("top5", with_alloc("""
, s AS (SELECT fiscal_year, program_id, sum(amount) AS amount FROM alloc GROUP BY ALL)
SELECT fiscal_year, program_id, CAST(amount AS DOUBLE) AS amount FROM s
QUALIFY row_number() OVER (PARTITION BY fiscal_year ORDER BY amount DESC, program_id) <= 5"""))
def top5(spark, d):
    sums = allocations(spark, d, "fiscal_year", "program_id", "amount").groupBy(
        "fiscal_year", "program_id").agg(F.sum("amount").alias("amount"))
    return top_per_group(sums, ["fiscal_year"], [F.desc("amount"), "program_id"], 5)


@query("distribution", """
SELECT coalesce(nullif(lang, ''), CASE WHEN lang IS NULL THEN '(null)' ELSE '(empty)' END)
         AS value, count(*) AS n,
       round_even(count(*) * 1.0 / (SELECT count(*) FROM documents) * 100, 2) AS pct
FROM documents GROUP BY 1""")
def distribution(spark, d):
    return R.value_distribution(spark.read.parquet(f"{d}/documents.parquet").select("lang"),
                                "lang")


@query("fund_profile", with_alloc("""
SELECT fund_type, fund_category, count(amount) AS n, CAST(sum(amount) AS DOUBLE) AS total,
       CAST(sum(amount) AS DOUBLE) / count(amount) AS mean
FROM alloc WHERE section = 'Capital Improvement' GROUP BY ALL"""))
def fund_profile(spark, d):
    rows = allocations(spark, d, "section", "fund_type", "fund_category", "amount")
    return R.fund_profile(rows.where(F.col("section") == "Capital Improvement"))


@query("dept_profile", with_alloc("""
SELECT department_code, count(DISTINCT program_id) AS programs, count(amount) AS n,
       CAST(sum(amount) AS DOUBLE) AS total
FROM alloc WHERE section = 'Capital Improvement' GROUP BY ALL
ORDER BY total DESC, department_code"""))
def dept_profile(spark, d):
    rows = allocations(spark, d, "section", "department_code", "program_id", "amount")
    profile = R.department_profile(rows.where(F.col("section") == "Capital Improvement"))
    return profile.orderBy(F.desc("total"), "department_code")


def _county(spark, d):
    return allocations(spark, d, "department_code", "department_name", "program_name",
                       "fund_category", "section", "amount")


@query("county_op", with_alloc("""
SELECT department_code, program_name, fund_category, CAST(sum(amount) AS DOUBLE) AS amount,
       CASE grouping_id(department_code, program_name, fund_category)
         WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS level
FROM alloc WHERE section = 'Operating'
GROUP BY ROLLUP (department_code, program_name, fund_category)"""))
def county_op(spark, d):
    return R.county_operating(_county(spark, d))


@query("county_cip", with_alloc("""
, f AS (SELECT department_name, program_name, fund_category, sum(amount) AS amount
  FROM alloc WHERE section = 'Capital Improvement' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY department_name, program_name
        ORDER BY abs(amount) DESC, fund_category) AS rn FROM f)
SELECT department_name, program_name, CAST(sum(amount) AS DOUBLE) AS total_budget,
       max(CASE WHEN rn = 1 THEN fund_category END) AS primary_fund,
       count(*) FILTER (amount <> 0) AS num_funds
FROM r GROUP BY ALL"""))
def county_cip(spark, d):
    return R.county_capital(_county(spark, d))


@query("county_entry", with_alloc("""
, c AS (SELECT split_part(department_name, ' ', 2) AS county, fiscal_year, section, amount
  FROM alloc),
s AS (SELECT county, fiscal_year, sum(amount) AS total,
   coalesce(sum(CASE WHEN section = 'Operating' THEN amount END), 0) AS operating,
   coalesce(sum(CASE WHEN section = 'Capital Improvement' THEN amount END), 0) AS capital
  FROM c GROUP BY ALL),
g AS (SELECT r_name AS county, y AS fiscal_year FROM region,
      (SELECT unnest(range(1990, 2001)) AS y) v)
SELECT g.county, CAST(g.fiscal_year AS BIGINT) AS fiscal_year, total IS NOT NULL AS available,
       CAST(coalesce(total, 0) AS DOUBLE) AS total,
       CAST(coalesce(operating, 0) AS DOUBLE) AS operating,
       CAST(coalesce(capital, 0) AS DOUBLE) AS capital
FROM g LEFT JOIN s USING (county, fiscal_year)"""))
def county_entry(spark, d):
    rows = allocations(spark, d, "department_name", "fiscal_year", "section", "amount").withColumn(
        "county", F.element_at(F.split("department_name", " "), 2))
    grid = spark.read.parquet(f"{d}/region.parquet").select(
        F.col("r_name").alias("county"),
        F.explode(F.sequence(F.lit(1990), F.lit(2000))).alias("fiscal_year"))
    return R.county_entry(rows, grid)


@query("mof", with_alloc("""
SELECT CASE WHEN fund_type = 'A' THEN 'General Funds' WHEN fund_type = 'B' THEN 'Special Funds'
            WHEN fund_type IN ('N', 'P') THEN 'Federal Funds' ELSE 'Other Funds' END AS fund_group,
       CAST(sum(amount) AS DOUBLE) AS amount
FROM alloc WHERE section = 'Operating' GROUP BY 1"""))
def mof(spark, d):
    return R.means_of_finance(allocations(spark, d, "section", "fund_type", "amount"),
                              FUND_GROUPS_CHART)


MAIN = {"Brand#1": "Transportation", "Brand#2": "Formal Education",
        "Brand#3": "Economic Development", "Brand#4": "Health"}
_MAIN_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MAIN.items())


@query("cip_groups", with_alloc(f"""
SELECT CASE category {_MAIN_CASE} ELSE 'All Others' END AS category,
       CAST(sum(amount) AS DOUBLE) AS amount
FROM alloc WHERE section = 'Capital Improvement' GROUP BY 1 HAVING sum(amount) > 0"""))
def cip_groups(spark, d):
    return R.capital_groups(allocations(spark, d, "section", "category", "amount"), MAIN)


@query("dept_years", with_alloc("""
, s AS (SELECT department_code, department_name,
   CAST(coalesce(sum(CASE WHEN fiscal_year = 1997 THEN amount END), 0) AS DOUBLE) AS fy1,
   CAST(coalesce(sum(CASE WHEN fiscal_year = 1998 THEN amount END), 0) AS DOUBLE) AS fy2,
   CAST(coalesce(sum(CASE WHEN fiscal_year = 1998 THEN amount END), 0)
      - coalesce(sum(CASE WHEN fiscal_year = 1997 THEN amount END), 0) AS DOUBLE) AS delta
  FROM alloc GROUP BY ALL)
SELECT *, round_even(delta / nullif(fy1, 0) * 100, 1) AS pct_change FROM s"""))
def dept_years(spark, d):
    return R.department_years(
        allocations(spark, d, "department_code", "department_name", "fiscal_year", "amount"),
        1997, 1998)


@query("fund_matrix", with_alloc(
    "SELECT department_name, " + ", ".join(
        f"CAST(coalesce(sum(CASE WHEN fund_type = '{f}' THEN amount END), 0) AS DOUBLE) AS \"{f}\""
        for f in "ABCNW")
    + ", CAST(sum(amount) AS DOUBLE) AS total FROM alloc WHERE fiscal_year = 1998 GROUP BY 1"))
def fund_matrix(spark, d):
    rows = allocations(spark, d, "department_name", "fund_type", "fiscal_year", "amount",
                       years=[1998])
    return R.fund_matrix(rows.where(F.col("fiscal_year") == 1998), list("ABCNW"))


@query("fund_order", with_alloc("""
, s AS (SELECT fund_type, sum(amount) AS amount FROM alloc GROUP BY 1)
SELECT fund_type, CAST(amount AS DOUBLE) AS amount,
       row_number() OVER (ORDER BY amount DESC, fund_type) AS fund_rank FROM s"""))
def fund_order(spark, d):
    return R.fund_order(allocations(spark, d, "fund_type", "amount"))


SPECIAL = [("OHA", 0.006, 0.0, 0.0), ("Legislature", 0.05163, 0.0, 0.0),
           ("Judiciary", 0.21457, 0.0129, 0.0)]


@query("chart_depts", with_alloc("""
, s AS (SELECT department_code AS display_name,
   CAST(coalesce(sum(CASE WHEN section = 'Operating' THEN amount END), 0) AS DOUBLE) / 1e9 AS op_b,
   CAST(coalesce(sum(CASE WHEN section = 'Capital Improvement' THEN amount END), 0) AS DOUBLE)
     / 1e9 AS cap_b,
   CAST(coalesce(sum(CASE WHEN section = 'One-Time' THEN amount END), 0) AS DOUBLE) / 1e9 AS one_b,
   false AS is_special
  FROM alloc WHERE department_code NOT IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY 1),
u AS (SELECT * FROM s UNION ALL
  SELECT * FROM (VALUES ('OHA', 0.006, 0.0, 0.0, true), ('Legislature', 0.05163, 0.0, 0.0, true),
                 ('Judiciary', 0.21457, 0.0129, 0.0, true)))
SELECT display_name, CAST(op_b AS DOUBLE) AS op_b, CAST(cap_b AS DOUBLE) AS cap_b,
       CAST(one_b AS DOUBLE) AS one_b, is_special, CAST(op_b AS DOUBLE) + cap_b + one_b AS total_b
FROM u"""))
def chart_depts(spark, d):
    rows = allocations(spark, d, "department_code", "section", "amount")
    names = spark.read.parquet(f"{d}/nation.parquet").select(
        F.col("n_name").alias("department_code"), F.col("n_name").alias("display_name"))
    return R.chart_departments(rows, names, ["NATION_1", "NATION_2"], ["NATION_3"], SPECIAL)


@query("dept_summary", with_alloc("""
SELECT department_code,
  CAST(coalesce(sum(CASE WHEN section = 'Operating' AND fund_type = 'A' THEN amount END), 0)
    AS DOUBLE) AS general,
  CAST(coalesce(sum(CASE WHEN section = 'Operating' AND fund_type = 'B' THEN amount END), 0)
    AS DOUBLE) AS special,
  CAST(coalesce(sum(CASE WHEN section = 'Operating' AND fund_type IN ('N', 'P') THEN amount END),
    0) AS DOUBLE) AS federal,
  CAST(coalesce(sum(CASE WHEN section = 'Operating' AND fund_type NOT IN ('A', 'B', 'N', 'P')
    THEN amount END), 0) AS DOUBLE) AS other,
  CAST(coalesce(sum(CASE WHEN section = 'One-Time' THEN amount END), 0) AS DOUBLE) AS one_time,
  CAST(coalesce(sum(CASE WHEN section = 'Capital Improvement' THEN amount END), 0) AS DOUBLE)
    AS capital,
  CAST(coalesce(sum(CASE WHEN section = 'Operating' THEN amount END), 0) AS DOUBLE) AS operating,
  CAST(coalesce(sum(CASE WHEN section IN ('Operating', 'Capital Improvement', 'One-Time')
    THEN amount END), 0) AS DOUBLE) AS total
FROM alloc GROUP BY 1"""))
def dept_summary(spark, d):
    return R.department_summary(
        allocations(spark, d, "department_code", "section", "fund_type", "amount"),
        FUND_GROUPS_REPORT)


_MILLIONS = [
    ("sum(amount)", "total"),
    ("coalesce(sum(CASE WHEN section = 'Operating' THEN amount END), 0)", "operating"),
    ("coalesce(sum(CASE WHEN section = 'Capital Improvement' THEN amount END), 0)", "capital"),
    ("coalesce(sum(CASE WHEN section = 'One-Time' THEN amount END), 0)", "one_time"),
]


@query("index_table", with_alloc(
    "SELECT CASE WHEN grouping(department_code) = 1 THEN '(all)' ELSE department_code END"
    " AS department_code, "
    + ", ".join(f"CAST({e} AS DOUBLE) / 1e6 AS {a}" for e, a in _MILLIONS)
    + " FROM alloc GROUP BY ROLLUP (department_code)"))
def index_table(spark, d):
    return R.index_table(allocations(spark, d, "department_code", "section", "amount"))


COUNTIES = ["NATION_7", "NATION_8", "NATION_9"]


@query("figures", with_alloc(f"""
, a AS (SELECT *, department_code IN ('NATION_7', 'NATION_8', 'NATION_9') AS county FROM alloc),
u AS (
  SELECT 'departments' AS figure, CASE WHEN section = 'Operating' THEN 'operating:'
     ELSE 'capital:' END || department_code AS label, amount
  FROM a WHERE NOT county AND section IN ('Operating', 'Capital Improvement')
  UNION ALL
  SELECT 'means_of_finance', CASE WHEN fund_type = 'A' THEN 'General Funds'
     WHEN fund_type = 'B' THEN 'Special Funds' WHEN fund_type IN ('N', 'P') THEN 'Federal Funds'
     ELSE 'Other Funds' END, amount FROM a WHERE NOT county AND section = 'Operating'
  UNION ALL
  SELECT 'capital', CASE WHEN county THEN 'All Others' ELSE
     CASE category {_MAIN_CASE} ELSE 'All Others' END END, amount
  FROM a WHERE section = 'Capital Improvement')
SELECT figure, label, CAST(sum(amount) AS DOUBLE) AS amount FROM u GROUP BY ALL"""))
def figures(spark, d):
    return R.report_figures(
        allocations(spark, d, "department_code", "section", "category", "fund_type", "amount"),
        COUNTIES, MAIN, FUND_GROUPS_CHART)


@query("branch_table", with_alloc("""
SELECT CASE WHEN grouping(b) = 1 THEN '(all)' ELSE b END AS branch,
  CAST(coalesce(sum(CASE WHEN section = 'Operating' THEN amount END), 0) AS DOUBLE) AS operating,
  CAST(coalesce(sum(CASE WHEN section = 'Capital Improvement' THEN amount END), 0) AS DOUBLE)
    AS capital,
  CAST(coalesce(sum(CASE WHEN section = 'One-Time' THEN amount END), 0) AS DOUBLE) AS one_time,
  CAST(coalesce(sum(CASE WHEN section <> 'Grants in Aid' THEN amount END), 0) AS DOUBLE) AS total
FROM (SELECT split_part(department_name, ' ', 2) AS b, section, amount FROM alloc)
GROUP BY ROLLUP (b)"""))
def branch_table(spark, d):
    rows = allocations(spark, d, "department_name", "section", "amount")
    return R.branch_table(
        rows.withColumn("branch", F.element_at(F.split("department_name", " "), 2)))


@query("revenue", with_alloc("""
SELECT CASE WHEN category IN ('Brand#1', 'Brand#2', 'Brand#3') THEN category
            ELSE 'All Other Taxes' END AS source, CAST(sum(amount) AS DOUBLE) AS amount,
       round_even(CAST(sum(amount) AS DOUBLE) / (SELECT CAST(sum(amount) AS DOUBLE) FROM alloc)
         * 100, 1) AS pct
FROM alloc GROUP BY 1"""))
def revenue(spark, d):
    return R.revenue_shares(allocations(spark, d, "category", "amount"),
                            ["Brand#1", "Brand#2", "Brand#3"], source="category")


@query("positions_once", with_alloc("""
, m AS (SELECT department_code, program_id, max(positions) AS p FROM alloc GROUP BY ALL)
SELECT department_code, CAST(sum(p) AS DOUBLE) AS positions FROM m GROUP BY 1"""))
def positions_once(spark, d):
    return R.positions_once(allocations(spark, d, "department_code", "program_id", "positions"),
                            ["department_code"])


@query("cards", with_alloc("""
, c AS (SELECT department_code, program_id, sum(amount) AS total,
   coalesce(sum(CASE WHEN section = 'Operating' THEN amount END), 0) AS operating,
   coalesce(sum(CASE WHEN section = 'Capital Improvement' THEN amount END), 0) AS capital,
   sum(positions) AS positions,
   sum(CASE WHEN section <> 'Grants in Aid' THEN amount END) AS counted FROM alloc GROUP BY ALL)
SELECT department_code, program_id, CAST(total AS DOUBLE) AS total,
       CAST(operating AS DOUBLE) AS operating, CAST(capital AS DOUBLE) AS capital,
       CAST(positions AS DOUBLE) AS positions,
       round_even(CAST(total AS DOUBLE) / CAST(sum(counted) OVER (PARTITION BY department_code)
         AS DOUBLE) * 100, 2) AS share_pct
FROM c"""))
def cards(spark, d):
    return R.program_cards(allocations(spark, d, "department_code", "program_id", "section",
                                       "amount", "positions"))


@query("gf_tree", with_alloc("""
SELECT department_code, program_id, CAST(sum(amount) AS DOUBLE) AS amount,
       CASE grouping_id(department_code, program_id) WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END
         AS level
FROM alloc WHERE fund_category = 'General Funds' AND amount <> 0
GROUP BY ROLLUP (department_code, program_id)"""))
def gf_tree(spark, d):
    return R.general_fund_tree(
        allocations(spark, d, "department_code", "program_id", "fund_category", "amount"))


@query("tax_share", with_alloc("""
, s AS (SELECT department_code, sum(amount) AS total FROM alloc
  WHERE fund_category = 'General Funds' GROUP BY 1),
w AS (SELECT CAST(sum(total) AS DOUBLE) AS whole FROM s),
f AS (SELECT CASE WHEN CAST(total AS DOUBLE) / whole >= 0.04 THEN department_code ELSE 'more' END
       AS department, total, whole FROM s, w)
SELECT department, CAST(sum(total) AS DOUBLE) AS total, count(*) AS departments,
       round_even(5000.0::DOUBLE * CAST(sum(total) AS DOUBLE) / max(whole), 2) AS your_dollars
FROM f GROUP BY 1"""))
def tax_share(spark, d):
    rows = allocations(spark, d, "department_code", "fund_category", "amount")
    return R.tax_share(rows.where(F.col("fund_category") == "General Funds"), 5000, minimum=0.04)


@query("top_other", with_alloc("""
, s AS (SELECT department_code, program_id, sum(amount) AS amount FROM alloc GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY department_code ORDER BY amount DESC, program_id)
  AS rn FROM s)
SELECT department_code, CASE WHEN rn <= 6 THEN program_id ELSE 'Other' END AS item,
       CAST(sum(amount) AS DOUBLE) AS amount, count(*) AS n_items FROM r GROUP BY 1, 2"""))
def top_other(spark, d):
    return R.top_n_other(allocations(spark, d, "department_code", "program_id", "amount"),
                         ["department_code"], "program_id", "amount", 6)


BANDS = {"Brand#1": "Retirement", "Brand#2": "Health", "Brand#3": "Entitlements",
         "Brand#4": "Debt", "Brand#5": "Debt"}
_BAND_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BANDS.items())
BAND_ORDER = ["Retirement", "Health", "Entitlements", "Debt"]


def _bands(spark, d):
    rows = allocations(spark, d, "category", "fiscal_year", "amount")
    return R.bands(rows, BANDS)


_BAND_SQL = f""", b AS (SELECT fiscal_year, CASE category {_BAND_CASE}
   ELSE 'Unmapped' END AS band, sum(amount) AS amount FROM alloc GROUP BY ALL)"""


@query("bands", with_alloc(_BAND_SQL + """
SELECT fiscal_year, band, CAST(amount AS DOUBLE) AS amount FROM b"""))
def bands(spark, d):
    return _bands(spark, d)


@query("stack", with_alloc(_BAND_SQL + """
SELECT fiscal_year, band, CAST(amount AS DOUBLE) AS amount,
  CAST(sum(amount) OVER (PARTITION BY fiscal_year ORDER BY list_position(
    ['Retirement', 'Health', 'Entitlements', 'Debt', 'Unmapped'], band) ROWS UNBOUNDED PRECEDING)
    AS DOUBLE) AS top FROM b"""))
def stack(spark, d):
    return R.stacked(_bands(spark, d), BAND_ORDER)


@query("actuals", with_alloc("""
, s AS (SELECT department_code,
  CAST(coalesce(sum(CASE WHEN section = 'Operating' THEN amount END), 0) AS DOUBLE) AS original,
  CAST(coalesce(sum(CASE WHEN section <> 'Capital Improvement' THEN amount END), 0) AS DOUBLE)
    AS final,
  CAST(coalesce(sum(CASE WHEN draft = 'F' THEN amount END), 0) AS DOUBLE) AS actual,
  CAST(coalesce(sum(CASE WHEN section <> 'Capital Improvement' THEN amount END), 0)
    - coalesce(sum(CASE WHEN draft = 'F' THEN amount END), 0) AS DOUBLE) AS variance
  FROM alloc GROUP BY 1)
SELECT *, round_even(variance / nullif(final, 0) * 100, 2) AS pct_variance,
       round_even(actual / nullif(final, 0) * 100, 1) AS pct_spent FROM s"""))
def actuals(spark, d):
    rows = allocations(spark, d, "department_code", "section", "draft", "amount")
    section = F.col("section")
    return R.actuals_variance(rows.select(
        "department_code",
        F.when(section == "Operating", F.col("amount")).alias("original"),
        F.when(section != "Capital Improvement", F.col("amount")).alias("final"),
        F.when(F.col("draft") == "F", F.col("amount")).alias("actual")))


@query("bill_log", with_alloc("""
SELECT fiscal_year, draft AS bill, section, count(*) AS n_rows,
       CAST(sum(amount) AS DOUBLE) AS amount,
       CAST(grouping_id(fiscal_year, draft, section) AS BIGINT) AS level
FROM alloc GROUP BY ROLLUP (fiscal_year, draft, section)"""))
def bill_log(spark, d):
    rows = allocations(spark, d, "fiscal_year", "draft", "section", "amount")
    return R.bill_log(rows.withColumnRenamed("draft", "bill"))


@query("act_rollup", with_alloc(f"""
SELECT draft AS act, fiscal_year, department_code, min(department_name) AS name,
       lower(department_code) AS id, {OP}, {CAP}, {ONE},
       CAST(coalesce(sum(positions), 0) AS DOUBLE) AS positions,
       CAST(sum(amount) AS DOUBLE) AS total_budget
FROM alloc WHERE {NOT_GRANT} GROUP BY draft, fiscal_year, department_code"""))
def act_rollup(spark, d):
    rows = allocations(spark, d, "draft", "fiscal_year", "department_code", "department_name",
                       "section", "amount", "positions").withColumnRenamed("draft", "act")
    return R.department_rollup(standard_view(rows), ["act", "fiscal_year", "department_code"]
                               ).drop("budget")


@query("program_once", with_alloc("""
, t AS (SELECT program_id, department_code, sum(amount) OVER (PARTITION BY program_id)
  AS request_total FROM alloc),
o AS (SELECT program_id, min(department_code) AS department_code, max(request_total)
  AS request_total FROM t GROUP BY 1)
SELECT department_code, CAST(sum(request_total) AS DOUBLE) AS request_total FROM o GROUP BY 1"""))
def program_once(spark, d):
    rows = allocations(spark, d, "program_id", "department_code", "amount")
    totals = rows.groupBy("program_id").agg(F.sum("amount").alias("request_total"))
    pairs = rows.select("program_id", "department_code").distinct()
    return R.program_once(pairs.join(totals, "program_id"))


@query("food_long", with_alloc("""
, w AS (SELECT fiscal_year, fund_type,
  coalesce(sum(CASE WHEN section = 'Operating' THEN amount END), 0) AS revenue,
  coalesce(sum(CASE WHEN section <> 'Operating' THEN amount END), 0) AS expenditure
  FROM alloc GROUP BY ALL)
SELECT fiscal_year, fund_type, 'revenue' AS measure, CAST(revenue AS DOUBLE) AS amount FROM w
UNION ALL SELECT fiscal_year, fund_type, 'expenditure', CAST(expenditure AS DOUBLE) FROM w
UNION ALL SELECT fiscal_year, fund_type, 'net', CAST(revenue - expenditure AS DOUBLE) FROM w"""))
def food_long(spark, d):
    rows = allocations(spark, d, "fiscal_year", "fund_type", "section", "amount")
    kind = F.when(F.col("section") == "Operating", F.lit("revenue")).otherwise(
        F.lit("expenditure"))
    return R.net_long(rows.withColumn("kind", kind), ["fiscal_year", "fund_type"])


@query("metrics", with_alloc("""
SELECT line_number, part_key, supplier_key, department_code, CAST(amount AS DOUBLE) AS amount,
  CAST(positions AS DOUBLE) AS positions,
  round_even(CAST(amount AS DOUBLE) / (SELECT CAST(sum(amount) AS DOUBLE) FROM alloc) * 100, 2)
    AS pct_of_total,
  round_even(CAST(amount AS DOUBLE) / CAST(sum(amount) OVER (PARTITION BY department_code)
    AS DOUBLE) * 100, 2) AS pct_of_dept,
  dense_rank() OVER (PARTITION BY department_code ORDER BY amount DESC) AS rank_in_dept,
  dense_rank() OVER (ORDER BY amount DESC) AS rank_overall,
  round_even(CAST(amount AS DOUBLE) / CAST(nullif(positions, 0) AS DOUBLE), 0)
    AS cost_per_position
FROM alloc"""))
def metrics(spark, d):
    return add_metrics(allocations(spark, d, "line_number", "part_key", "supplier_key",
                                   "department_code", "amount", "positions"))


@query("year_before", with_alloc("""
, s AS (SELECT department_code, fiscal_year, sum(amount) AS amount FROM alloc GROUP BY ALL)
SELECT a.department_code, a.fiscal_year, CAST(a.amount AS DOUBLE) AS amount,
       CAST(b.amount AS DOUBLE) AS before
FROM s a LEFT JOIN s b ON a.department_code = b.department_code
  AND a.fiscal_year = b.fiscal_year + 1"""))
def year_before(spark, d):
    sums = allocations(spark, d, "department_code", "fiscal_year", "amount").groupBy(
        "department_code", "fiscal_year").agg(F.sum("amount").alias("amount"))
    return previous_by_year(sums, ["department_code"], "fiscal_year", "amount", "before")


@query("dept_tree", with_alloc("""
, c AS (SELECT department_code, program_id, sum(amount) AS amount FROM alloc GROUP BY ALL)
SELECT department_code, string_agg(program_id || '=' || CAST(amount AS VARCHAR), ','
  ORDER BY amount DESC, program_id) AS programs FROM c GROUP BY 1"""))
def dept_tree(spark, d):
    sums = allocations(spark, d, "department_code", "program_id", "amount").groupBy(
        "department_code", "program_id").agg(F.sum("amount").alias("amount"))
    ranked = sums.withColumn("down", -F.col("amount"))
    nested = nest(ranked, ["department_code"], ["program_id", "amount"], "rows",
                  ["down", "program_id"])
    return nested.select("department_code", F.array_join(F.transform(
        "rows", lambda r: F.concat(r["program_id"], F.lit("="), r["amount"].cast("string"))),
        ",").alias("programs"))


@query("refresh_field", with_alloc("""
, s AS (SELECT program_id, CAST(max(positions) AS DOUBLE) AS session_delta FROM alloc
  WHERE section = 'Grants in Aid' GROUP BY 1),
c AS (SELECT program_id, count(*) AS n FROM alloc GROUP BY 1)
SELECT program_id, n, session_delta FROM c LEFT JOIN s USING (program_id)"""))
def refresh_field_query(spark, d):
    rows = allocations(spark, d, "program_id", "section", "positions")
    base = rows.groupBy("program_id").agg(F.count(F.lit(1)).alias("n"),
                                          F.max("positions").alias("session_delta"))
    source = rows.where(F.col("section") == "Grants in Aid").withColumnRenamed(
        "positions", "session_delta")
    return refresh_field(base, source, ["program_id"], "session_delta")
