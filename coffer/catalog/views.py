"""Filter, projection, ordering and set queries."""

from pyspark.sql import functions as F

from ..operators import views as V
from ..operators.ordered import first_per_key, top_per_group, with_place
from ..plans.testdata import allocations, table
from .base import query, with_alloc

GRAIN = ["line_number", "part_key", "supplier_key"]
GRAIN_SQL = "line_number, part_key, supplier_key"


@query("std_view", with_alloc("""
SELECT line_number, part_key, supplier_key, section, fiscal_year, CAST(amount AS DOUBLE) AS amount,
       CAST(amount AS DOUBLE) / 1000000 AS amount_millions,
       section = 'Capital Improvement' AS is_capital
FROM alloc WHERE fiscal_year = 1998 AND section <> 'Grants in Aid'"""))
def std_view(spark, d):
    rows = allocations(spark, d, *GRAIN, "section", "fiscal_year", "amount", years=[1998])
    return V.standard_view(rows, 1998, "all")


@query("std_view_section", with_alloc("""
SELECT line_number, part_key, supplier_key, section, fiscal_year, CAST(amount AS DOUBLE) AS amount,
       CAST(amount AS DOUBLE) / 1000000 AS amount_millions, false AS is_capital
FROM alloc WHERE fiscal_year = 1998 AND section = 'Grants in Aid'"""))
def std_view_section(spark, d):
    rows = allocations(spark, d, *GRAIN, "section", "fiscal_year", "amount", years=[1998])
    return V.standard_view(rows, 1998, "grants in aid")


@query("clean_cols", """
SELECT doc_id, trim(replace(text, chr(10), ' '), ' ') AS program_name,
       trim(coalesce(nullif(source, 'web'), 'U')) AS fund_type,
       CAST(TRY_CAST(regexp_extract(text, '[0-9.]+') AS DECIMAL(18, 2)) AS DOUBLE) AS amount
FROM documents""")
def clean_cols(spark, d):
    docs = table(spark, d, "documents")
    return V.clean_columns(docs.select(
        "doc_id", F.col("text").alias("program_name"),
        F.nullif(F.col("source"), F.lit("web")).alias("fund_type"),
        F.regexp_extract("text", "[0-9.]+", 0).alias("amount")))


@query("year_from_name", """
SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(url, '(20[0-9]{2})', 1), '') AS BIGINT),
                         2026) AS fiscal_year FROM pages""")
def year_from_name(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return V.year_from_source(pages, F.col("url"), 2026).drop("url")


@query("large", with_alloc("""
SELECT line_number, part_key, supplier_key, CAST(amount AS DOUBLE) AS amount
FROM alloc WHERE amount > 100000"""))
def large(spark, d):
    return V.large_amounts(allocations(spark, d, *GRAIN, "amount"), 100_000, tiebreak=GRAIN)


@query("search", with_alloc("""
SELECT line_number, part_key, supplier_key, program_id, program_name, fund_type, section,
       CAST(amount AS DOUBLE) AS amount
FROM alloc
WHERE (contains(lower(program_name), 'ring') OR contains(lower(program_id), 'ring'))
  AND fund_type = 'A' AND section = 'Operating' AND starts_with(program_id, 'ECO')
ORDER BY amount DESC, line_number, part_key, supplier_key"""))
def search(spark, d):
    rows = allocations(spark, d, *GRAIN, "program_id", "program_name", "fund_type", "section",
                       "amount")
    hits = V.search_programs(rows, "Ring", "A", "Operating", "ECO")
    return V.top_rows(hits, [F.desc("amount"), *GRAIN])


@query("search_totals", with_alloc("""
SELECT count(*) AS n, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total FROM alloc
WHERE (contains(lower(program_name), 'ring') OR contains(lower(program_id), 'ring'))"""))
def search_totals(spark, d):
    hits = V.search_programs(allocations(spark, d, "program_id", "program_name", "amount"), "ring")
    return hits.agg(F.count(F.lit(1)).alias("n"),
                    F.coalesce(F.sum("amount"), F.lit(0)).alias("total"))


def _two_years(spark, d):
    rows = allocations(spark, d, "program_id", "department_code", "fund_type", "fiscal_year",
                       "amount")
    return rows.groupBy("program_id", "department_code", "fund_type").agg(
        F.sum(F.when(F.col("fiscal_year") == 1997, F.col("amount"))).alias("before"),
        F.sum(F.when(F.col("fiscal_year") == 1998, F.col("amount"))).alias("after"))


@query("change_filter", with_alloc("""
, p AS (SELECT program_id, department_code, fund_type,
  coalesce(sum(CASE WHEN fiscal_year = 1997 THEN amount END), 0) AS a,
  coalesce(sum(CASE WHEN fiscal_year = 1998 THEN amount END), 0) AS b FROM alloc GROUP BY ALL),
k AS (SELECT 'increases' AS kind, a, b FROM p WHERE b > a
  UNION ALL SELECT 'decreases', a, b FROM p WHERE b < a
  UNION ALL SELECT 'new', a, b FROM p WHERE a = 0 AND b > 0
  UNION ALL SELECT 'removed', a, b FROM p WHERE a > 0 AND b = 0)
SELECT kind, count(*) AS n, CAST(sum(b - a) AS DOUBLE) AS change FROM k GROUP BY 1"""))
def change_filter(spark, d):
    pairs = _two_years(spark, d).select(
        F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    kinds = [V.change_filter(pairs, k).withColumn("kind", F.lit(k))
             for k in ("increases", "decreases", "new", "removed")]
    return V.union_by_name(*kinds).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("after") - F.col("before")).alias("change"))


@query("draft_filter", with_alloc("""
SELECT line_number, part_key, supplier_key, program_id, section, fund_category FROM alloc
WHERE section IN ('Operating', 'One-Time')
  AND fund_category IN ('General Funds', 'Federal Funds')
  AND contains(lower(concat_ws(chr(10), program_id, program_name, department_code)), 'widget')"""))
def draft_filter(spark, d):
    rows = allocations(spark, d, *GRAIN, "program_id", "program_name", "department_code",
                       "section", "fund_category")
    return V.draft_filter(rows, ["Operating", "One-Time"], ["General Funds", "Federal Funds"],
                          text="Widget").drop("program_name", "department_code")


@query("dept_excl", with_alloc("""
SELECT department_code, CAST(sum(amount) AS DOUBLE) AS amount FROM alloc
WHERE department_code NOT IN ('NATION_1', 'NATION_2')
  AND NOT regexp_matches(lower(department_code), '_1[0-9]') GROUP BY 1"""))
def dept_excl(spark, d):
    rows = V.exclude_names(allocations(spark, d, "department_code", "amount"),
                           ["NATION_1", "NATION_2"], pattern=r"(?i)_1[0-9]")
    return rows.groupBy("department_code").agg(F.sum("amount").alias("amount"))


def _scopes(spark, d):
    years = allocations(spark, d, "fiscal_year").distinct()
    kind = F.when(F.col("fiscal_year") % 3 == 0, "operating").when(
        F.col("fiscal_year") % 3 == 1, "capital").otherwise("combined")
    return years.withColumn("scope", kind)


@query("scope", with_alloc("""
SELECT fiscal_year, section, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM alloc
WHERE section <> 'Grants in Aid' AND CASE fiscal_year % 3
  WHEN 0 THEN section = 'Operating' WHEN 1 THEN section = 'Capital Improvement' ELSE true END
GROUP BY ALL"""))
def scope(spark, d):
    rows = allocations(spark, d, "fiscal_year", "section", "amount")
    return V.scope_rows(rows, _scopes(spark, d), ["fiscal_year"]).groupBy(
        "fiscal_year", "section").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query("append_fixed", with_alloc("""
SELECT department_code, CAST(sum(amount) AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS note
FROM alloc GROUP BY 1
UNION ALL SELECT * FROM (VALUES ('OHA', 6000000.0::DOUBLE, 'fixed'), ('JUD', 214570000.0, 'fixed'))"""))
def append_fixed(spark, d):
    sums = allocations(spark, d, "department_code", "amount").groupBy("department_code").agg(
        F.sum("amount").cast("double").alias("amount"))
    return V.append_fixed_rows(
        sums, [("OHA", 6000000.0, "fixed"), ("JUD", 214570000.0, "fixed")],
        "department_code string, amount double, note string")


@query("display_name", with_alloc("""
SELECT department_code, CASE WHEN department_code LIKE 'NATION_1%' THEN department_code
         ELSE max(department_name) END AS display_name, CAST(sum(amount) AS DOUBLE) AS amount
FROM alloc GROUP BY department_code"""))
def display_name(spark, d):
    sums = allocations(spark, d, "department_code", "amount").groupBy("department_code").agg(
        F.sum("amount").alias("amount"))
    regions = table(spark, d, "region")
    names = table(spark, d, "nation").join(
        regions, F.col("n_regionkey") == F.col("r_regionkey")).where(
        ~F.col("n_name").like(r"NATION\_1%")).select(
        F.col("n_name").alias("department_code"),
        F.concat_ws(" ", "n_name", "r_name").alias("display_name"))
    return V.display_name(sums, names)


@query("fund_override", with_alloc("""
, m AS (SELECT DISTINCT program_id, 'X' AS fund FROM alloc WHERE program_id LIKE 'ECO%')
SELECT coalesce(fund, fund_type) AS fund_type, CAST(sum(amount) AS DOUBLE) AS amount
FROM alloc LEFT JOIN m USING (program_id) GROUP BY 1"""))
def fund_override(spark, d):
    fund_map = allocations(spark, d, "program_id").where(
        F.col("program_id").startswith("ECO")).distinct().withColumn("fund_type", F.lit("X"))
    rows = allocations(spark, d, "program_id", "fund_type", "amount")
    return V.override_fund(rows, fund_map).groupBy("fund_type").agg(
        F.sum("amount").alias("amount"))


@query("options", with_alloc("""
SELECT DISTINCT category FROM alloc WHERE category IS NOT NULL AND category <> ''"""))
def options(spark, d):
    return V.option_list(allocations(spark, d, "category"), "category")


@query("foreign", with_alloc("""
SELECT department_code, program_id, CAST(sum(amount) AS DOUBLE) AS amount FROM alloc
WHERE substr(program_id, 1, 3) <> substr(department_code, 1, 3) GROUP BY ALL"""))
def foreign(spark, d):
    rows = allocations(spark, d, "department_code", "program_id", "amount")
    return V.foreign_programs(rows).groupBy("department_code", "program_id").agg(
        F.sum("amount").alias("amount"))


@query("stage_choice", with_alloc("""
SELECT department_code, CAST(sum(CASE WHEN draft = 'F' THEN amount END) AS DOUBLE) AS first_stage,
       CAST(sum(CASE WHEN draft = 'O' THEN amount END) AS DOUBLE) AS last_stage
FROM alloc GROUP BY 1"""))
def stage_choice(spark, d):
    rows = allocations(spark, d, "department_code", "draft", "amount")
    wide = rows.groupBy("department_code").agg(
        F.sum(F.when(F.col("draft") == "F", F.col("amount"))).alias("amount_hd1"),
        F.sum(F.when(F.col("draft") == "O", F.col("amount"))).alias("amount_cd1"))
    first, last = V.stage_columns({"hd1", "enacted"})
    return wide.select("department_code", F.col(first).alias("first_stage"),
                       F.col(last).alias("last_stage"))


@query("provenance", with_alloc("""
SELECT line_number, part_key, supplier_key, 'act250' AS act, 'main' AS bill FROM alloc"""))
def provenance(spark, d):
    return V.with_provenance(allocations(spark, d, *GRAIN), act="act250", bill="main")


@query("topk", with_alloc("""
SELECT line_number, part_key, supplier_key, CAST(amount AS DOUBLE) AS amount FROM alloc
ORDER BY amount DESC, line_number, part_key, supplier_key LIMIT 15"""))
def topk(spark, d):
    return V.top_rows(allocations(spark, d, *GRAIN, "amount"), [F.desc("amount"), *GRAIN], 15)


@query("topk_group", with_alloc("""
SELECT department_code, line_number, part_key, supplier_key, CAST(amount AS DOUBLE) AS amount
FROM alloc QUALIFY row_number() OVER (PARTITION BY department_code
  ORDER BY amount DESC, line_number, part_key, supplier_key) <= 3"""))
def topk_group(spark, d):
    return top_per_group(allocations(spark, d, "department_code", *GRAIN, "amount"),
                         ["department_code"], [F.desc("amount"), *GRAIN], 3)


ORDER = ["Brand#9", "Brand#3", "Brand#21"]


@query("cat_order", with_alloc("""
, s AS (SELECT category, CAST(sum(amount) AS DOUBLE) AS amount FROM alloc GROUP BY 1)
SELECT *, coalesce(nullif(list_position(['Brand#9', 'Brand#3', 'Brand#21'], category), 0), 4)
  AS place FROM s"""))
def cat_order(spark, d):
    sums = allocations(spark, d, "category", "amount").groupBy("category").agg(
        F.sum("amount").alias("amount"))
    return V.by_category_order(
        sums.withColumn("place", V.category_rank(F.col("category"), ORDER)), ORDER,
        then=("category",))


@query("special_first", with_alloc("""
SELECT department_code, CAST(sum(amount) AS DOUBLE) AS total,
       department_code IN ('NATION_4', 'NATION_5') AS is_special FROM alloc GROUP BY 1"""))
def special_first(spark, d):
    sums = allocations(spark, d, "department_code", "amount").groupBy("department_code").agg(
        F.sum("amount").alias("total"))
    return V.special_first(sums, ["NATION_4", "NATION_5"])


@query("mixed_order", """
SELECT p_partkey, key, is_text FROM (
  SELECT p_partkey, key, TRY_CAST(key AS DOUBLE) IS NULL AS is_text,
         TRY_CAST(key AS DOUBLE) AS n FROM (
    SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_brand END AS key
    FROM part))
ORDER BY is_text, n, key, p_partkey""")
def mixed_order(spark, d):
    keyed = table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(
            F.col("p_brand")).alias("key"))
    ordered = keyed.orderBy(*V.mixed_order_key(F.col("key")), "p_partkey")
    return ordered.withColumn("is_text", F.col("key").try_cast("double").isNull())


@query("user_sort", with_alloc("""
, s AS (SELECT department_code, program_id, CAST(sum(amount) AS DOUBLE) AS amount
  FROM alloc GROUP BY ALL)
SELECT * FROM s ORDER BY lower(program_id) DESC, department_code"""))
def user_sort(spark, d):
    sums = allocations(spark, d, "department_code", "program_id", "amount").groupBy(
        "department_code", "program_id").agg(F.sum("amount").alias("amount"))
    return V.user_sort(sums, "program_id", True, True, ["department_code"])


def _year_sums(spark, d):
    return allocations(spark, d, "department_code", "program_id", "fiscal_year", "amount").groupBy(
        "department_code", "program_id", "fiscal_year").agg(F.sum("amount").alias("amount"))


def _placed_sql(order):
    return with_alloc(f"""
, s AS (SELECT department_code, program_id, fiscal_year, sum(amount) AS amount FROM alloc GROUP BY ALL)
SELECT * REPLACE (CAST(fiscal_year AS BIGINT) AS fiscal_year, CAST(amount AS DOUBLE) AS amount),
       row_number() OVER (ORDER BY {order}) AS place FROM s""")


@query("sort_by_id", _placed_sql("program_id NULLS LAST, department_code NULLS LAST, fiscal_year"))
def sort_by_id(spark, d):
    return with_place(_year_sums(spark, d), [
        F.asc_nulls_last("program_id"), F.asc_nulls_last("department_code"), "fiscal_year"])


@query("sort_by_value", _placed_sql(
    "amount DESC NULLS LAST, program_id NULLS LAST, department_code NULLS LAST, fiscal_year"))
def sort_by_value(spark, d):
    return with_place(_year_sums(spark, d), [
        F.desc_nulls_last("amount"), F.asc_nulls_last("program_id"),
        F.asc_nulls_last("department_code"), "fiscal_year"])


@query("sort_by_keys", _placed_sql(
    "department_code NULLS LAST, fiscal_year DESC, amount DESC NULLS LAST, program_id NULLS LAST"))
def sort_by_keys(spark, d):
    return with_place(_year_sums(spark, d), [
        F.asc_nulls_last("department_code"), F.desc("fiscal_year"), F.desc_nulls_last("amount"),
        F.asc_nulls_last("program_id")])


@query("sort_by_delta", with_alloc("""
, s AS (SELECT program_id, coalesce(sum(amount) FILTER (fiscal_year = 1998), 0)
    - coalesce(sum(amount) FILTER (fiscal_year = 1997), 0) AS delta FROM alloc GROUP BY 1)
SELECT program_id, CAST(delta AS DOUBLE) AS delta,
       row_number() OVER (ORDER BY abs(delta) DESC, program_id NULLS LAST) AS place FROM s"""))
def sort_by_delta(spark, d):
    year = lambda y: F.coalesce(
        F.sum(F.when(F.col("fiscal_year") == y, F.col("amount"))), F.lit(0))
    sums = allocations(spark, d, "program_id", "fiscal_year", "amount").groupBy("program_id").agg(
        (year(1998) - year(1997)).alias("delta"))
    return with_place(sums, [F.desc(F.abs("delta")), F.asc_nulls_last("program_id")])


@query("group_order", with_alloc("""
, s AS (SELECT department_code, program_id, sum(amount) AS amount FROM alloc GROUP BY ALL)
SELECT department_code, program_id, CAST(amount AS DOUBLE) AS amount,
       CAST(sum(amount) OVER (PARTITION BY department_code) AS DOUBLE) AS group_total FROM s"""))
def group_order(spark, d):
    sums = allocations(spark, d, "department_code", "program_id", "amount").groupBy(
        "department_code", "program_id").agg(F.sum("amount").alias("amount"))
    return V.group_then_row_order(sums, "department_code", "amount", ["program_id"])


@query("union", with_alloc("""
SELECT line_number, part_key, supplier_key, CAST(amount AS DOUBLE) AS amount,
  CASE WHEN fiscal_year = 1997 THEN fund_type END AS fund_type,
  CASE WHEN fiscal_year = 1998 THEN section END AS section
FROM alloc WHERE fiscal_year IN (1997, 1998)"""))
def union(spark, d):
    rows = allocations(spark, d, *GRAIN, "amount", "fiscal_year", "fund_type", "section",
                       years=[1997, 1998])
    a = rows.where(F.col("fiscal_year") == 1997).drop("fiscal_year", "section")
    b = rows.where(F.col("fiscal_year") == 1998).drop("fiscal_year", "fund_type")
    return V.union_by_name(a, b)


@query("keyset", with_alloc("""
, a AS (SELECT DISTINCT program_id, department_code FROM alloc WHERE draft = 'F'
        AND fiscal_year = 1997),
b AS (SELECT DISTINCT program_id, department_code FROM alloc WHERE draft = 'O'
        AND fiscal_year = 1998)
SELECT program_id, department_code, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT *, 'only_a' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT *, 'only_b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""))
def keyset(spark, d):
    rows = allocations(spark, d, "program_id", "department_code", "draft", "fiscal_year")
    a = rows.where((F.col("draft") == "F") & (F.col("fiscal_year") == 1997))
    b = rows.where((F.col("draft") == "O") & (F.col("fiscal_year") == 1998))
    return V.key_sets(a, b, ["program_id", "department_code"])


@query("missing_keys", with_alloc("""
SELECT y AS fiscal_year FROM range(1993, 2006) r(y)
WHERE y NOT IN (SELECT fiscal_year FROM alloc)"""))
def missing_keys(spark, d):
    have = allocations(spark, d, "fiscal_year")
    need = spark.range(1993, 2006).select(F.col("id").cast("int").alias("fiscal_year"))
    return V.missing_keys(need, have, ["fiscal_year"])


@query("splice", with_alloc("""
SELECT fiscal_year, draft, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM alloc
WHERE (draft = 'F' AND fiscal_year NOT IN (1997, 1998))
   OR (draft = 'O' AND fiscal_year IN (1997, 1998)) GROUP BY ALL"""))
def splice(spark, d):
    rows = allocations(spark, d, "fiscal_year", "draft", "amount")
    old = rows.where(F.col("draft") == "F")
    new = rows.where((F.col("draft") == "O") & F.col("fiscal_year").isin(1997, 1998))
    return V.replace_rows(old, new, ["fiscal_year"]).groupBy("fiscal_year", "draft").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query("dup_flag", with_alloc("""
SELECT line_number, part_key, supplier_key, program_id, fiscal_year, section, fund_type,
  count(*) OVER (PARTITION BY program_id, fiscal_year, section, fund_type) > 1 AS is_duplicate
FROM alloc"""))
def dup_flag(spark, d):
    rows = allocations(spark, d, *GRAIN, "program_id", "fiscal_year", "section", "fund_type")
    return V.mark_duplicates(rows, ["program_id", "fiscal_year", "section", "fund_type"])


@query("year_detail", with_alloc("""
, u AS (SELECT fiscal_year, department_code, sum(amount) AS amount, 1 AS source_rank FROM alloc
   WHERE draft = 'F' AND fiscal_year >= 1998 GROUP BY ALL
  UNION ALL SELECT fiscal_year, department_code, sum(amount), 2 FROM alloc GROUP BY ALL)
SELECT fiscal_year, department_code, CAST(amount AS DOUBLE) AS amount, source_rank FROM u
QUALIFY source_rank = min(source_rank) OVER (PARTITION BY fiscal_year)"""))
def year_detail(spark, d):
    rows = allocations(spark, d, "fiscal_year", "department_code", "draft", "amount")
    keys = ["fiscal_year", "department_code"]
    detail = rows.where((F.col("draft") == "F") & (F.col("fiscal_year") >= 1998)).groupBy(
        *keys).agg(F.sum("amount").alias("amount")).withColumn("source_rank", F.lit(1))
    history = rows.groupBy(*keys).agg(F.sum("amount").alias("amount")).withColumn(
        "source_rank", F.lit(2))
    return V.best_source(V.union_by_name(detail, history), ["fiscal_year"], "source_rank")


@query("first_source", """
WITH u AS (SELECT doc_id, lang AS label, 1 AS source_rank, n_chars AS page FROM documents
  WHERE lang = 'en'
  UNION ALL SELECT doc_id, source, 2, n_chars FROM documents)
SELECT doc_id, label, source_rank, page FROM u
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY source_rank, page) = 1""")
def first_source(spark, d):
    docs = table(spark, d, "documents")
    first = docs.where(F.col("lang") == "en").select(
        "doc_id", F.col("lang").alias("label"), F.lit(1).alias("source_rank"),
        F.col("n_chars").alias("page"))
    second = docs.select("doc_id", F.col("source").alias("label"), F.lit(2).alias("source_rank"),
                         F.col("n_chars").alias("page"))
    return first_per_key(first.unionByName(second), ["doc_id"], ["source_rank", "page"])
