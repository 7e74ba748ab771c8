"""Comparison and join queries."""

from pyspark.sql import functions as F

from ..functions import normalize_name
from ..operators import compare as C
from ..operators import matching as M
from ..operators import quality as Q
from ..operators import rollup as R
from ..plans.testdata import allocations, table
from .base import query, with_alloc

KEYS = ["program_id", "department_code", "fund_type"]
CAST_KINDS = """CASE WHEN nb = 0 THEN 'added' WHEN na = 0 THEN 'removed' ELSE 'modified' END"""


def _sides(keys, first, second):
    """SQL of both sides summed on keys that may be NULL."""
    k = ", ".join(keys)
    on = " AND ".join(f"b.{c} IS NOT DISTINCT FROM a.{c}" for c in keys)
    both = ", ".join(f"CASE WHEN nb IS NULL THEN a.{c} ELSE b.{c} END AS {c}" for c in keys)
    return f"""
, b AS (SELECT {k}, sum(amount) AS vb, count(*) AS nb FROM alloc WHERE {first} GROUP BY ALL),
a AS (SELECT {k}, sum(amount) AS va, count(*) AS na FROM alloc WHERE {second} GROUP BY ALL),
j AS (SELECT {both}, vb, va, coalesce(nb, 0) AS nb, coalesce(na, 0) AS na
  FROM b FULL OUTER JOIN a ON {on}),
c AS (SELECT {k}, CAST(vb AS DOUBLE) AS before, CAST(va AS DOUBLE) AS after,
  CAST(coalesce(va, 0) - coalesce(vb, 0) AS DOUBLE) AS change,
  (CAST(va AS DOUBLE) - CAST(vb AS DOUBLE)) / nullif(CAST(vb AS DOUBLE), 0) * 100 AS pct_change,
  {CAST_KINDS} AS change_type FROM j)
"""


def _drafts(spark, d, *columns):
    rows = allocations(spark, d, "draft", "amount", *columns)
    return (rows.where(F.col("draft") == "F").drop("draft"),
            rows.where(F.col("draft") == "O").drop("draft"))


@query("compare", with_alloc(_sides(KEYS, "draft = 'F'", "draft = 'O'") + "SELECT * FROM c"))
def compare(spark, d):
    before, after = _drafts(spark, d, *KEYS)
    return C.compare(before, after, KEYS)


NULL_KEYS = ["department_code", "half"]


@query("compare_null_keys", with_alloc("""
, alloc2 AS (SELECT department_code, amount, draft,
   CASE WHEN positions IS NOT NULL THEN section END AS half FROM alloc)"""
    + _sides(NULL_KEYS, "draft = 'F'", "draft = 'O'").replace("FROM alloc WHERE",
                                                               "FROM alloc2 WHERE")
    + "SELECT * FROM c"))
def compare_null_keys(spark, d):
    half = F.when(F.col("positions").isNotNull(), F.col("section")).alias("half")
    before, after = _drafts(spark, d, "department_code", "positions", "section")
    return C.compare(before.select("department_code", half, "amount"),
                     after.select("department_code", half, "amount"), NULL_KEYS)


@query("compare_raw", with_alloc("""
, b AS (SELECT program_id, fiscal_year, supplier_key, part_key, amount FROM alloc WHERE draft = 'F'),
a AS (SELECT program_id, fiscal_year, supplier_key, part_key, amount FROM alloc WHERE draft = 'O')
SELECT coalesce(b.program_id, a.program_id) AS program_id,
  coalesce(b.fiscal_year, a.fiscal_year) AS fiscal_year,
  coalesce(b.supplier_key, a.supplier_key) AS supplier_key,
  coalesce(b.part_key, a.part_key) AS part_key,
  CAST(b.amount AS DOUBLE) AS before, CAST(a.amount AS DOUBLE) AS after,
  CAST(coalesce(a.amount, 0) - coalesce(b.amount, 0) AS DOUBLE) AS change,
  (CAST(a.amount AS DOUBLE) - CAST(b.amount AS DOUBLE)) / CAST(b.amount AS DOUBLE) * 100
    AS pct_change,
  CASE WHEN b.amount IS NULL THEN 'added' WHEN a.amount IS NULL THEN 'removed' ELSE 'modified' END
    AS change_type
FROM b FULL OUTER JOIN a ON b.program_id = a.program_id AND b.fiscal_year = a.fiscal_year
  AND b.supplier_key = a.supplier_key AND b.part_key = a.part_key"""))
def compare_raw(spark, d):
    keys = ["program_id", "fiscal_year", "supplier_key", "part_key"]
    before, after = _drafts(spark, d, *keys)
    return C.compare(before, after, keys, pre_aggregate=False)


@query("compare_years", with_alloc("""
, p AS (SELECT program_id, department_code, section, fund_type,
  CAST(coalesce(sum(CASE WHEN fiscal_year = 1997 THEN amount END), 0) AS DOUBLE) AS fy1,
  CAST(coalesce(sum(CASE WHEN fiscal_year = 1998 THEN amount END), 0) AS DOUBLE) AS fy2,
  CAST(coalesce(sum(CASE WHEN fiscal_year = 1998 THEN amount END), 0)
     - coalesce(sum(CASE WHEN fiscal_year = 1997 THEN amount END), 0) AS DOUBLE) AS delta
  FROM alloc WHERE fiscal_year IN (1997, 1998) GROUP BY ALL)
SELECT *, round_even(delta / nullif(fy1, 0) * 100, 2) AS pct_change FROM p"""))
def compare_years(spark, d):
    rows = allocations(spark, d, "program_id", "department_code", "section", "fund_type",
                       "fiscal_year", "amount", years=[1997, 1998])
    return C.compare_years(rows, 1997, 1998)


@query("veto_impact", with_alloc(_sides(KEYS, "draft = 'F'", "draft = 'O'")
                                 + "SELECT * FROM c WHERE change <> 0"))
def veto_impact(spark, d):
    before, after = _drafts(spark, d, *KEYS)
    return C.veto_impact(before, after, KEYS)


def _changes(spark, d):
    """Change list from the part table: several changes per key, in part order."""
    parts = table(spark, d, "part")
    return parts.select(
        F.concat(F.upper(F.substring("p_type", 1, 3)),
                 F.lpad(F.col("p_size").cast("string"), 3, "0")).alias("program_id"),
        (F.lit(1995) + F.col("p_partkey") % 8).cast("int").alias("fiscal_year"),
        F.when(F.col("p_partkey") % 3 != 0, F.element_at(
            F.array(*[F.lit(x) for x in "ABN"]), (F.col("p_partkey") % 3 + 1).cast("int"))
        ).alias("fund_type"),
        F.floor("p_retailprice").cast("decimal(18,2)").alias("amount"),
        F.concat(F.lit("change "), F.col("p_partkey").cast("string")).alias("notes"),
        "p_partkey")


_CHANGES = """
, ch AS (SELECT upper(substr(p_type, 1, 3)) || lpad(CAST(p_size AS VARCHAR), 3, '0') AS program_id,
   1995 + p_partkey % 8 AS fiscal_year,
   CASE p_partkey % 3 WHEN 1 THEN 'B' WHEN 2 THEN 'N' ELSE 'A' END AS fund_type,
   floor(p_retailprice) AS new_amount, 'change ' || p_partkey AS new_notes, p_partkey
  FROM part)
"""


@query("apply_changes", with_alloc(_CHANGES + """
, l AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY program_id, fiscal_year, fund_type
    ORDER BY p_partkey DESC) = 1)
SELECT line_number, part_key, supplier_key, program_id, fiscal_year, fund_type,
  coalesce(new_amount, CAST(amount AS DOUBLE)) AS amount, new_notes AS notes,
  new_notes IS NOT NULL AS changed
FROM alloc LEFT JOIN l USING (program_id, fiscal_year, fund_type)"""))
def apply_changes(spark, d):
    rows = allocations(spark, d, "line_number", "part_key", "supplier_key", "program_id",
                       "fiscal_year", "fund_type", "amount")
    return C.apply_changes(rows, _changes(spark, d), ["p_partkey"])


@query("unmatched_changes", with_alloc(_CHANGES + """
SELECT program_id, fiscal_year, fund_type, p_partkey FROM ch
WHERE (program_id, fiscal_year, fund_type) NOT IN
  (SELECT program_id, fiscal_year, fund_type FROM alloc WHERE section = 'Grants in Aid')"""))
def unmatched_changes(spark, d):
    rows = allocations(spark, d, "program_id", "fiscal_year", "fund_type", "section")
    changes = _changes(spark, d).withColumn("fund_type", F.coalesce("fund_type", F.lit("A")))
    grants = rows.where(F.col("section") == "Grants in Aid")
    return C.unmatched_changes(grants, changes).select(
        "program_id", "fiscal_year", "fund_type", "p_partkey")


DRAFT_COLUMNS = [*C.DRAFT_KEYS, "program_name", "department_name", "positions", "line_number"]


@query("draft_compare", with_alloc(_sides(C.DRAFT_KEYS, "draft = 'F'", "draft = 'O'") + f"""
, n AS (SELECT {", ".join(C.DRAFT_KEYS)}, program_name, department_name FROM alloc
  QUALIFY row_number() OVER (PARTITION BY {", ".join(C.DRAFT_KEYS)}
    ORDER BY draft DESC, line_number, program_name) = 1),
p AS (SELECT program_id, max(CASE WHEN draft = 'F' THEN positions END) AS pb,
   max(CASE WHEN draft = 'O' THEN positions END) AS pa FROM alloc GROUP BY 1)
SELECT c.*, n.program_name, n.department_name, CAST(pb AS DOUBLE) AS positions_before,
       CAST(pa AS DOUBLE) AS positions_after
FROM c JOIN n USING ({", ".join(C.DRAFT_KEYS)}) JOIN p USING (program_id)"""))
def draft_compare(spark, d):
    return C.compare_drafts(*_drafts(spark, d, *DRAFT_COLUMNS))


def _projects(spark, d):
    rows = allocations(spark, d, "draft", "program_id", "program_name", "fund_type", "category",
                       "amount", "line_number", "part_key", "supplier_key", "fiscal_year")
    rows = rows.withColumn("name_key", normalize_name(
        F.concat_ws(" ", "program_name", "fiscal_year"))).withColumn(
        "place", F.struct("line_number", "part_key", "supplier_key", "amount"))
    return rows.where(F.col("draft") == "F"), rows.where(F.col("draft") == "O")


@query("project_compare", with_alloc("""
, x AS (SELECT *, upper(program_name || ' ' || fiscal_year) AS name_key FROM alloc),
g AS (SELECT program_id, name_key, fund_type,
   sum(CASE WHEN draft = 'F' THEN amount END) AS b, sum(CASE WHEN draft = 'O' THEN amount END) AS a
  FROM x GROUP BY ALL),
r AS (SELECT program_id, name_key, fund_type, category, part_key FROM x
  QUALIFY row_number() OVER (PARTITION BY program_id, name_key, fund_type
    ORDER BY draft DESC, line_number, part_key, supplier_key, amount) = 1)
SELECT g.program_id, g.name_key, g.fund_type, category, part_key,
  CAST(coalesce(b, 0) AS DOUBLE) AS before, CAST(coalesce(a, 0) AS DOUBLE) AS after,
  CAST(coalesce(a, 0) - coalesce(b, 0) AS DOUBLE) AS change,
  CASE WHEN b IS NULL THEN 'added' WHEN a IS NULL THEN 'removed' WHEN a = b THEN 'unchanged'
       ELSE 'modified' END AS change_type
FROM g JOIN r USING (program_id, name_key, fund_type)"""))
def project_compare(spark, d):
    before, after = _projects(spark, d)
    return C.compare_projects(before, after, ["category", "part_key"], order="place")


@query("third_draft", with_alloc(
    _sides(KEYS, "draft = 'F' AND section = 'Operating'", "draft = 'O' AND section = 'Operating'")
    + """
, t AS (SELECT program_id, department_code, fund_type, CAST(sum(amount) AS DOUBLE) AS amount_third
  FROM alloc WHERE section = 'Capital Improvement' GROUP BY ALL)
SELECT c.*, amount_third FROM c LEFT JOIN t USING (program_id, department_code, fund_type)
UNION ALL
SELECT program_id, department_code, fund_type, NULL, NULL, 0, NULL, 'unchanged_in_cd1', amount_third
FROM t ANTI JOIN c USING (program_id, department_code, fund_type)"""))
def third_draft(spark, d):
    rows = allocations(spark, d, "draft", "section", "amount", *KEYS)
    op = rows.where(F.col("section") == "Operating")
    comparison = C.compare(op.where(F.col("draft") == "F"), op.where(F.col("draft") == "O"), KEYS)
    third = rows.where(F.col("section") == "Capital Improvement").groupBy(*KEYS).agg(
        F.sum("amount").alias("amount_third"))
    return C.merge_third_draft(comparison, third, KEYS)


BASE = ["department_code", "program_id", "fund_type", "section"]


@query("baseline", with_alloc(
    _sides(BASE, "draft = 'F' AND fiscal_year = 1997", "draft = 'O' AND fiscal_year = 1997") + """
, r AS (SELECT department_code, program_id, fund_type, section, fiscal_year,
    sum(amount) + coalesce(sum(positions), 0) AS base FROM alloc WHERE fiscal_year IN (1998, 1999)
    GROUP BY ALL),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY department_code, program_id,
    fund_type, section ORDER BY fiscal_year DESC) = 1)
SELECT c.*, CAST(coalesce(base, 0) AS DOUBLE) AS baseline
FROM c LEFT JOIN l USING (department_code, program_id, fund_type, section)
UNION ALL
SELECT department_code, program_id, fund_type, section, 0, 0, 0, NULL, 'removed',
  CAST(base AS DOUBLE)
FROM r ANTI JOIN c USING (department_code, program_id, fund_type, section) WHERE base <> 0"""))
def baseline(spark, d):
    rows = allocations(spark, d, "draft", "fiscal_year", "amount", "positions", *BASE,
                       years=[1997, 1999])
    now = rows.where(F.col("fiscal_year") == 1997)
    comparison = C.compare(now.where(F.col("draft") == "F"), now.where(F.col("draft") == "O"), BASE)
    request = rows.where(F.col("fiscal_year").isin(1998, 1999)).groupBy(*BASE, "fiscal_year").agg(
        F.sum("amount").alias("request"), F.sum("positions").alias("session_delta"))
    return C.attach_baseline(comparison, request, ["fiscal_year"])


# Project names built from the part table; the draft side is cut at varying
# lengths so that all three matching rules occur.
_REQUEST = """
, named AS (SELECT *, upper(program_name) || ' REHABILITATION AND UPGRADE ' || category || ' ' ||
    fiscal_year AS full_name FROM alloc),
rq AS (SELECT program_id, fund_category, full_name AS name_key, amount, line_number FROM named
  WHERE draft = 'F'),
dr AS (SELECT program_id, fund_category, CASE WHEN part_key % 3 = 0
     THEN substr(full_name, 1, 20 + CAST(line_number % 25 AS INTEGER)) ELSE full_name END
     AS name_key, amount FROM named WHERE draft = 'O'),
gm AS (SELECT program_id, fund_category, name_key, sum(amount) AS amt, min(line_number) AS seen
  FROM rq GROUP BY ALL),
dk AS (SELECT DISTINCT program_id, fund_category, name_key FROM dr),
ex AS (SELECT dk.*, amt FROM dk JOIN gm USING (program_id, fund_category, name_key)),
un AS (SELECT * FROM dk ANTI JOIN gm USING (program_id, fund_category, name_key)),
px AS (SELECT un.program_id, un.fund_category, un.name_key, gm.name_key AS gname, amt FROM un
  JOIN gm ON un.program_id = gm.program_id AND un.fund_category = gm.fund_category
   AND ((length(gm.name_key) >= 25 AND starts_with(un.name_key, gm.name_key))
     OR (length(un.name_key) >= 25 AND starts_with(gm.name_key, un.name_key)))
  QUALIFY row_number() OVER (PARTITION BY un.program_id, un.fund_category, un.name_key
    ORDER BY seen, gm.name_key) = 1),
nm AS (SELECT program_id, name_key, greatest(max(amt), 0) AS amt FROM gm GROUP BY ALL),
mt AS (SELECT dr.*, coalesce(ex.amt, px.amt, nm.amt) AS matched,
   CASE WHEN ex.amt IS NOT NULL THEN 'exact' WHEN px.amt IS NOT NULL THEN 'prefix'
        WHEN nm.amt IS NOT NULL THEN 'name' END AS rule
  FROM dr LEFT JOIN ex USING (program_id, fund_category, name_key)
  LEFT JOIN px USING (program_id, fund_category, name_key)
  LEFT JOIN nm USING (program_id, name_key))
"""


def _listings(spark, d):
    rows = allocations(spark, d, "draft", "program_id", "program_name", "category", "fiscal_year",
                       "fund_category", "amount", "line_number", "part_key")
    full = F.concat_ws(" ", F.upper("program_name"), F.lit("REHABILITATION AND UPGRADE"),
                       "category", F.col("fiscal_year").cast("string"))
    length = (F.lit(20) + F.col("line_number") % 25).cast("int")
    cut = F.when(F.col("part_key") % 3 == 0, F.substring(full, F.lit(1), length)).otherwise(full)
    keep = ["program_id", "fund_category", "name_key", "amount"]
    request = rows.where(F.col("draft") == "F").withColumn("name_key", full).select(
        *keep, "line_number")
    drafts = rows.where(F.col("draft") == "O").withColumn("name_key", cut).select(*keep)
    return drafts, request


@query("fuzzy_match", with_alloc(_REQUEST + """
SELECT program_id, fund_category, name_key, CAST(amount AS DOUBLE) AS amount,
       CAST(matched AS DOUBLE) AS matched_amount, rule FROM mt"""))
def fuzzy_match(spark, d):
    drafts, request = _listings(spark, d)
    return M.match_projects(drafts, request)


@query("prorate", with_alloc(_REQUEST + """
, pt AS (SELECT program_id, sum(amount) * 4 AS program_total FROM rq GROUP BY 1),
s AS (SELECT program_id, coalesce(sum(matched), 0) AS ms,
   coalesce(sum(CASE WHEN matched IS NULL THEN amount END), 0) AS ds,
   count(*) FILTER (matched IS NULL) AS n FROM mt GROUP BY 1),
f AS (SELECT mt.*, CASE WHEN program_total > 0 AND program_total - ms > 0
     THEN program_total - ms END AS left_over, ds, n
  FROM mt LEFT JOIN s USING (program_id) LEFT JOIN pt USING (program_id))
SELECT program_id, fund_category, name_key, CAST(amount AS DOUBLE) AS amount,
  CAST(matched AS DOUBLE) AS matched_amount,
  CASE WHEN matched IS NULL AND left_over IS NOT NULL THEN 'pro_rata' ELSE rule END AS rule,
  round(coalesce(CAST(matched AS DOUBLE), CAST(left_over AS DOUBLE) * CASE WHEN ds > 0
     THEN CAST(amount AS DOUBLE) / CAST(ds AS DOUBLE) ELSE 1.0 / n END), 4) AS resolved_amount
FROM f"""))
def prorate(spark, d):
    drafts, request = _listings(spark, d)
    totals = request.groupBy("program_id").agg(
        (F.sum("amount") * 4).alias("program_total"))
    out = M.prorate_unmatched(M.match_projects(drafts, request), totals)
    return out.withColumn("resolved_amount", F.round("resolved_amount", 4))


@query("project_orphans", with_alloc(_REQUEST + """
, used AS (SELECT program_id, fund_category, name_key FROM ex
  UNION SELECT program_id, fund_category, gname FROM px),
cov AS (SELECT DISTINCT gm.program_id, gm.fund_category, gm.name_key FROM gm JOIN used u
  ON gm.program_id = u.program_id AND gm.fund_category = u.fund_category
  AND (gm.name_key = u.name_key
    OR (length(u.name_key) >= 25 AND starts_with(gm.name_key, u.name_key))
    OR (length(gm.name_key) >= 25 AND starts_with(u.name_key, gm.name_key))))
SELECT program_id, fund_category, name_key, CAST(amount AS DOUBLE) AS amount, line_number,
       'removed' AS change_type
FROM rq ANTI JOIN cov USING (program_id, fund_category, name_key) WHERE amount > 0"""))
def project_orphans(spark, d):
    drafts, request = _listings(spark, d)
    return M.project_orphans(drafts, request)


@query("key_diff", with_alloc(_sides(["program_id", "department_code"], "draft = 'F'",
                                     "draft = 'O'") + """
SELECT program_id, department_code, before, after,
  CASE WHEN before IS NULL THEN 'only_b' WHEN after IS NULL THEN 'only_a'
       WHEN abs(before - after) <= 1e-8 + 1e-5 * abs(after) THEN 'equal' ELSE 'different' END
    AS status FROM c"""))
def key_diff(spark, d):
    before, after = _drafts(spark, d, "program_id", "department_code")
    return C.key_diff(before, after, ["program_id", "department_code"])


def _total(alias, where):
    return f"CAST(coalesce(sum(CASE WHEN {where} THEN amount END), 0) AS DOUBLE) AS {alias}"


@query("total_diff", with_alloc(", t AS (SELECT " + ", ".join(
    _total(f"{n}_{s}", f"draft = '{f}'" + c)
    for s, f in (("a", "F"), ("b", "O"))
    for n, c in (("operating", " AND section = 'Operating'"),
                 ("capital", " AND section = 'Capital Improvement'"), ("total", "")))
    + """ FROM alloc)
SELECT *, round(operating_a - operating_b, 2) AS operating_diff,
  round(capital_a - capital_b, 2) AS capital_diff, round(total_a - total_b, 2) AS total_diff
FROM t"""))
def total_diff(spark, d):
    return C.compare_totals(*_drafts(spark, d, "section"))


@query("golden", with_alloc("""
, e AS (SELECT fund_type, section, sum(amount) AS v FROM alloc WHERE draft = 'F' GROUP BY ALL),
a AS (SELECT fund_type, section, sum(amount) AS v FROM alloc
  WHERE draft = 'F' AND positions IS NOT NULL GROUP BY ALL)
SELECT fund_type, section, CAST(coalesce(e.v, 0) AS DOUBLE) AS expected,
  CAST(coalesce(a.v, 0) AS DOUBLE) AS actual,
  CAST(coalesce(a.v, 0) - coalesce(e.v, 0) AS DOUBLE) AS difference,
  abs(coalesce(a.v, 0) - coalesce(e.v, 0)) < 0.01 AS passed
FROM e FULL OUTER JOIN a USING (fund_type, section)"""))
def golden(spark, d):
    rows = allocations(spark, d, "draft", "fund_type", "section", "positions", "amount").where(
        F.col("draft") == "F")
    return C.expected_vs_actual(rows, rows.where(F.col("positions").isNotNull()),
                                ["fund_type", "section"])


@query("reasons", with_alloc(_sides(["program_id", "department_code"], "draft = 'F'",
                                    "draft = 'O'") + """
, r AS (SELECT program_id, min(program_name) AS reason_first, max(program_name) AS s
  FROM alloc GROUP BY 1)
SELECT c.*, reason_first, CASE WHEN abs(change) > 1 THEN s END AS reason_second
FROM c LEFT JOIN r USING (program_id)"""))
def reasons(spark, d):
    before, after = _drafts(spark, d, "program_id", "department_code", "program_name")
    texts = C.first_and_last(before.unionByName(after), ["program_id"], "program_name")
    comparison = C.compare(before, after, ["program_id", "department_code"])
    return C.attach_reasons(comparison, texts)


@query("authority", with_alloc("""
, s AS (SELECT *, CASE WHEN draft = 'O' AND fiscal_year IN (1996, 1997, 1999)
   THEN 'supplemental' ELSE 'main' END AS scope FROM alloc),
u AS (SELECT DISTINCT fiscal_year FROM s WHERE scope = 'supplemental' AND fiscal_year % 2 = 1)
SELECT fiscal_year, scope, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM s
WHERE (fiscal_year IN (FROM u)) = (scope = 'supplemental') GROUP BY ALL"""))
def authority(spark, d):
    rows = allocations(spark, d, "fiscal_year", "draft", "amount")
    supplemental = (F.col("draft") == "O") & F.col("fiscal_year").isin(1996, 1997, 1999)
    scoped = rows.withColumn("scope", F.when(supplemental, F.lit("supplemental")).otherwise(
        F.lit("main")))
    return C.resolve_authority(scoped).groupBy("fiscal_year", "scope").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query("program_category", with_alloc("""
, m AS (SELECT program_id, min(category) AS category FROM alloc
  WHERE section = 'Grants in Aid' GROUP BY 1)
SELECT coalesce(m.category, '') AS category, count(*) AS n FROM alloc a
LEFT JOIN m USING (program_id) GROUP BY 1"""))
def program_category(spark, d):
    rows = allocations(spark, d, "program_id", "category", "section")
    grants = rows.where(F.col("section") == "Grants in Aid")
    return C.program_category(rows.drop("category"), grants).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"))


# --- browser rollups of a comparison ----------------------------------------

_STAGE_KEYS = ["program_id", "department_code", "fund_type", "fund_category", "section"]
_STAGED = _sides(_STAGE_KEYS, "draft = 'F'", "draft = 'O'") + """
, st AS (SELECT program_id, department_code, fund_type, fund_category, section,
   coalesce(before, 0) AS d1, coalesce(after, 0) AS d2, change, change_type FROM c)
"""


def _staged(spark, d):
    before, after = _drafts(spark, d, *_STAGE_KEYS)
    return C.compare(before, after, _STAGE_KEYS).select(
        *_STAGE_KEYS, F.coalesce("before", F.lit(0)).alias("d1"),
        F.coalesce("after", F.lit(0)).alias("d2"), "change", "change_type")


@query("stage_totals", with_alloc(_STAGED + """
SELECT section, round(sum(d1), 2) AS d1, round(sum(d2), 2) AS d2,
       round(sum(d2) - sum(d1), 2) AS delta FROM st GROUP BY 1"""))
def stage_totals(spark, d):
    return R.stage_totals(_staged(spark, d), ["d1", "d2"], "d1", "d2")


@query("draft_programs", with_alloc(_STAGED + """
, p AS (SELECT program_id, max(positions) AS positions FROM alloc GROUP BY 1),
g AS (SELECT department_code, program_id, round(sum(d1), 2) AS d1, round(sum(d2), 2) AS d2,
  array_to_string(list_sort(list(DISTINCT fund_category)), ' | ') AS funds,
  CASE WHEN count(DISTINCT section) > 1 THEN 'Mixed' ELSE min(section) END AS section,
  bool_or(change_type = 'added') AS aa, bool_or(change_type = 'removed') AS rr
  FROM st GROUP BY ALL)
SELECT department_code, program_id, d1, d2, round(d2 - d1, 2) AS change,
  round(CASE WHEN d1 <> 0 THEN (d2 - d1) / abs(d1) * 100 WHEN d2 <> d1 THEN 100 ELSE 0 END, 6)
    AS pct_change, funds, section, CAST(positions AS DOUBLE) AS positions,
  CASE WHEN aa AND d1 = 0 THEN 'added' WHEN rr AND d2 = 0 THEN 'removed' ELSE 'modified' END
    AS change_type
FROM g JOIN p USING (program_id)"""))
def draft_programs(spark, d):
    positions = allocations(spark, d, "program_id", "positions").groupBy("program_id").agg(
        F.max("positions").alias("positions"))
    out = R.draft_programs(_staged(spark, d).join(positions, "program_id"))
    return out.withColumn("pct_change", F.round("pct_change", 6))


_SPLIT = _STAGED + """
, sp AS (SELECT program_id, department_code, round(sum(d1), 2) AS d1, round(sum(d2), 2) AS d2
  FROM st GROUP BY ALL),
sq AS (SELECT *, round(d2 - d1, 2) AS delta,
    count(*) OVER (PARTITION BY program_id) AS departments FROM sp),
sr AS (SELECT * FROM sq WHERE departments >= 2)
"""


@query("split", with_alloc(_SPLIT + "SELECT * FROM sr"))
def split(spark, d):
    return C.split_programs(_staged(spark, d))


@query("split_by_fund", with_alloc(_STAGED + """
, sp AS (SELECT program_id, section, fund_category, department_code, round(sum(d1), 2) AS d1,
   round(sum(d2), 2) AS d2 FROM st GROUP BY ALL)
SELECT *, round(d2 - d1, 2) AS delta,
  count(*) OVER (PARTITION BY program_id, section, fund_category) AS departments FROM sp
QUALIFY departments >= 2"""))
def split_by_fund(spark, d):
    return C.split_programs(_staged(spark, d), ["section", "fund_category"])


@query("transfers", with_alloc(_SPLIT + """
SELECT a.program_id, a.department_code, b.department_code AS counterpart, a.delta,
  b.delta AS other_delta,
  CASE WHEN abs(a.delta) > 100000 AND abs(b.delta) > 100000 AND (a.delta < 0) <> (b.delta < 0)
       THEN CASE WHEN a.delta < 0 THEN 'out' ELSE 'in' END ELSE 'neutral' END AS direction
FROM sr a JOIN sr b ON a.program_id = b.program_id AND a.department_code <> b.department_code"""))
def transfers(spark, d):
    return C.transfer_directions(C.split_programs(_staged(spark, d)))


@query("transfer_flows", with_alloc(_SPLIT + """
, m AS (SELECT program_id, department_code, delta < 0 AS gives, abs(delta) AS size,
  sum(abs(delta)) OVER (PARTITION BY program_id, delta < 0 ORDER BY department_code) AS upto
  FROM sr WHERE delta <> 0)
SELECT a.program_id, a.department_code AS giver, b.department_code AS taker,
  round(least(a.upto, b.upto) - greatest(a.upto - a.size, b.upto - b.size), 2) AS moved
FROM m a JOIN m b ON a.program_id = b.program_id AND a.gives AND NOT b.gives
  AND round(least(a.upto, b.upto) - greatest(a.upto - a.size, b.upto - b.size), 2) > 0"""))
def transfer_flows(spark, d):
    return C.transfer_flows(C.split_programs(_staged(spark, d)))


_AUGMENT = _STAGED + """
, ow AS (SELECT department_code, program_id, section, sum(d1) AS d1, sum(d2) AS d2
  FROM st GROUP BY ALL),
bs AS (SELECT program_id, section, sum(d1) AS a1, sum(d2) AS a2 FROM st GROUP BY ALL),
au AS (SELECT department_code, program_id, round(sum(d1), 2) AS d1, round(sum(d2), 2) AS d2,
  round(sum(a1), 2) AS all_d1, round(sum(a2), 2) AS all_d2
  FROM ow JOIN bs USING (program_id, section) GROUP BY ALL),
av AS (SELECT *, count(*) OVER (PARTITION BY program_id) > 1 AS is_split,
  round(d2 - d1, 2) AS change FROM au)
"""


@query("augment", with_alloc(_AUGMENT + """
SELECT *, round(CASE WHEN d1 <> 0 THEN change / abs(d1) * 100 WHEN change <> 0 THEN 100 ELSE 0 END,
  6) AS pct_change, is_split AND change <> 0 AS is_transfer FROM av"""))
def augment(spark, d):
    out = C.augment_split(_staged(spark, d))
    return out.withColumn("pct_change", F.round("pct_change", 6))


@query("buckets", with_alloc(_AUGMENT + """
, ow2 AS (SELECT program_id, list_sort(list(DISTINCT department_code)) AS owners
  FROM av GROUP BY 1),
bk AS (SELECT department_code, change,
  CASE WHEN is_split AND change < 0 THEN 'moved_out' WHEN is_split THEN 'moved_in'
       WHEN change > 0 THEN 'increase' ELSE 'reduction' END AS bucket,
  CASE WHEN is_split THEN array_to_string(list_filter(owners, lambda x: x <> department_code),
       ', ') ELSE '' END AS counterpart
  FROM av JOIN ow2 USING (program_id) WHERE change <> 0)
SELECT department_code, bucket, counterpart, count(*) AS n, round(sum(change), 2) AS net,
       round(sum(abs(change)), 2) AS gross FROM bk GROUP BY ALL"""))
def buckets(spark, d):
    return C.bucket_totals(C.change_buckets(C.augment_split(_staged(spark, d))))


@query("net_change", with_alloc(_AUGMENT + """
SELECT department_code, round(sum(change), 2) AS net,
  round(coalesce(sum(CASE WHEN NOT is_split THEN change END), 0), 2) AS net_without_transfers
FROM av WHERE change <> 0 GROUP BY 1"""))
def net_change(spark, d):
    return C.net_without_transfers(C.change_buckets(C.augment_split(_staged(spark, d))))


@query("fund_groups", with_alloc(_STAGED + """
SELECT CASE WHEN grouping(fund_type) = 1 THEN '(all)' ELSE fund_type END AS fund_type,
  round(sum(d1), 2) AS d1, round(sum(d2), 2) AS d2, round(sum(d2) - sum(d1), 2) AS delta,
  round(sum(abs(change)), 2) AS gross_change, count(*) AS n
FROM st GROUP BY ROLLUP (fund_type)"""))
def fund_groups(spark, d):
    return R.fund_stage_groups(_staged(spark, d))


@query("change_summary", with_alloc(_STAGED + """
SELECT count(*) FILTER (d2 > d1) AS increased, count(*) FILTER (d2 < d1) AS decreased,
  count(*) FILTER (change_type = 'added') AS added,
  count(*) FILTER (change_type = 'removed') AS removed,
  count(*) FILTER (change_type = 'modified') AS modified,
  round(sum(d1), 2) AS total_before, round(sum(d2), 2) AS total_after,
  round(sum(d2) - sum(d1), 2) AS net_change FROM st"""))
def change_summary(spark, d):
    return R.change_summary(_staged(spark, d), "d1", "d2")


# --- data quality ------------------------------------------------------------


@query("validate", """
WITH r AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS program_id, o_orderpriority AS
    program_name, CASE WHEN o_custkey % 10 = 0 THEN '' ELSE 'X' END AS department_code,
    CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE 2000 END AS fiscal_year,
    CASE WHEN o_orderkey % 7 = 0 THEN -o_totalprice WHEN o_orderkey % 11 = 0 THEN 0
         ELSE o_totalprice END AS amount, 'Operating' AS section,
    substr(o_orderstatus, 1, 1) AS fund_type FROM orders)
SELECT o_orderkey, 'missing program_id' AS error FROM r WHERE program_id IS NULL
UNION ALL SELECT o_orderkey, 'missing department_code' FROM r WHERE department_code = ''
UNION ALL SELECT o_orderkey, 'missing fiscal_year' FROM r WHERE fiscal_year = 0
UNION ALL SELECT o_orderkey, 'missing amount' FROM r WHERE amount = 0
UNION ALL SELECT o_orderkey, 'invalid fund_type' FROM r WHERE fund_type IN ('F', 'O')
UNION ALL SELECT o_orderkey, 'negative amount' FROM r WHERE amount < 0""")
def validate(spark, d):
    orders = table(spark, d, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    rows = orders.select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("program_id"),
        F.col("o_orderpriority").alias("program_name"),
        F.when(F.col("o_custkey") % 10 == 0, "").otherwise("X").alias("department_code"),
        F.when(key % 50 == 0, 0).otherwise(2000).alias("fiscal_year"),
        F.when(key % 7 == 0, -price).when(key % 11 == 0, 0).otherwise(price).alias("amount"),
        F.lit("Operating").alias("section"), F.substring("o_orderstatus", 1, 1).alias("fund_type"))
    return Q.validate_rows(rows, ["o_orderkey"])


@query("verdict", with_alloc("""
SELECT count(*) AS n_rows, count(*) FILTER (positions IS NULL) AS n_errors,
       count(*) FILTER (positions IS NULL) = 0 AS is_valid FROM alloc"""))
def verdict(spark, d):
    rows = allocations(spark, d, "line_number", "positions", "fund_type")
    return Q.validation_verdict(rows, Q.validate_rows(rows, ["line_number"], ["positions"]))


@query("control", with_alloc("""
, s AS (SELECT department_code, sum(amount) AS parsed FROM alloc
  WHERE section <> 'Grants in Aid' GROUP BY 1),
k AS (SELECT department_code, sum(amount) AS expected, CASE WHEN department_code LIKE '%1%'
   THEN 0.03 ELSE 0.0 END AS tolerance FROM alloc GROUP BY 1)
SELECT department_code, CAST(expected AS DOUBLE) AS expected, CAST(parsed AS DOUBLE) AS parsed,
  CAST(parsed - expected AS DOUBLE) AS difference,
  abs(parsed - expected) <= greatest(abs(CAST(expected AS DOUBLE)) * tolerance, 1000) AS passed
FROM k LEFT JOIN s USING (department_code)"""))
def control(spark, d):
    rows = allocations(spark, d, "department_code", "section", "amount")
    controls = rows.groupBy("department_code").agg(
        F.sum("amount").alias("expected")).withColumns({
            "tolerance": F.when(F.col("department_code").contains("1"), 0.03).otherwise(0.0),
            "floor": F.lit(1000)})
    return Q.control_totals(rows.where(F.col("section") != "Grants in Aid"), controls,
                            ["department_code"])


@query("checks", with_alloc("""
, g AS (SELECT section AS "check", CAST(sum(amount) AS DOUBLE) AS got FROM alloc GROUP BY 1),
w AS (SELECT CASE WHEN l_returnflag = 'N' THEN 'Operating' WHEN l_returnflag = 'A' THEN 'Capital Improvement'
     WHEN l_discount > 0.095 THEN 'Grants in Aid' ELSE 'One-Time' END AS "check",
   CAST(sum(CAST(l_quantity * 2000 AS DECIMAL(18, 2))) AS DOUBLE) AS want, 40000000.0::DOUBLE AS tolerance
   FROM lineitem GROUP BY 1)
SELECT "check", want, tolerance, got, abs(got - want) <= tolerance AS passed FROM w
JOIN g USING ("check")"""))
def checks(spark, d):
    sums = allocations(spark, d, "section", "amount").groupBy(
        F.col("section").alias("check")).agg(F.sum("amount").cast("double").alias("got"))
    # an estimate from quantities, which the sums can miss
    flag = F.col("l_returnflag")
    wanted = table(spark, d, "lineitem").groupBy(
        F.when(flag == "N", "Operating").when(flag == "A", "Capital Improvement")
        .when(F.col("l_discount") > 0.095, "Grants in Aid").otherwise("One-Time").alias("check")).agg(
        F.sum((F.col("l_quantity") * 2000).cast("decimal(18,2)")).cast("double").alias("want")).withColumn(
        "tolerance", F.lit(40000000.0))
    return Q.named_checks(sums, wanted)


@query("identity", with_alloc("""
, w AS (SELECT department_code, fiscal_year,
  coalesce(sum(CASE WHEN draft = 'F' THEN amount END), 0) AS revenue,
  coalesce(sum(CASE WHEN draft = 'O' THEN amount END), 0) AS expenditure,
  coalesce(sum(CASE WHEN draft = 'F' THEN amount END), 0)
    - coalesce(sum(CASE WHEN draft = 'O' AND section <> 'Grants in Aid' THEN amount END), 0) AS net,
  sum(amount) AS total, sum(CASE WHEN positions IS NOT NULL OR section <> 'One-Time' THEN amount END)
    AS parts FROM alloc GROUP BY ALL)
SELECT department_code, fiscal_year, 'net' AS violation FROM w
WHERE abs(net - (revenue - expenditure)) > 2
UNION ALL SELECT department_code, fiscal_year, 'parts' FROM w WHERE abs(total - parts) > 2"""))
def identity(spark, d):
    rows = allocations(spark, d, "department_code", "fiscal_year", "draft", "section", "positions",
                       "amount")
    f, o = F.col("draft") == "F", F.col("draft") == "O"
    grants = F.col("section") == "Grants in Aid"
    wide = rows.groupBy("department_code", "fiscal_year").agg(
        R.sum_if(f).alias("revenue"), R.sum_if(o).alias("expenditure"),
        (R.sum_if(f) - R.sum_if(o & ~grants)).alias("net"), F.sum("amount").alias("total"),
        R.sum_if(F.col("positions").isNotNull() | (F.col("section") != "One-Time")).alias("parts"))
    return Q.identity_violations(wide, ["department_code", "fiscal_year"])


@query("label_check", """
WITH l AS (SELECT o_orderkey, CASE o_orderkey % 4
  WHEN 0 THEN '$' || CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) || 'M'
  WHEN 1 THEN '$$1.5M' WHEN 2 THEN o_orderpriority ELSE '$1,200B' END AS label FROM orders)
SELECT o_orderkey, label, 'double dollar' AS finding FROM l WHERE contains(label, '$$')
UNION ALL SELECT o_orderkey, label, 'bad amount' FROM l
WHERE NOT regexp_matches(label, '^\\$[0-9][0-9,]*(\\.[0-9]+)?[MB]$')""")
def label_check(spark, d):
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    kind = F.col("o_orderkey") % 4
    label = F.when(kind == 0, F.concat(F.lit("$"), price, F.lit("M"))).when(
        kind == 1, F.lit("$$1.5M")).when(kind == 2, F.col("o_orderpriority")).otherwise("$1,200B")
    rows = table(spark, d, "orders").select("o_orderkey", label.alias("label"))
    return Q.label_findings(rows, ["o_orderkey"], "label")


@query("truncated", """
SELECT lang, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(*) >= 200""")
def truncated(spark, d):
    return Q.truncated_sources(table(spark, d, "documents"), "lang", 200)
