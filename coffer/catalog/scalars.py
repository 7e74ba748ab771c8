"""Scalar function queries over whole columns of the given tables."""

from pyspark.sql import functions as F

from .. import functions as X
from ..functions.text import PROJECT_ABBREVIATIONS, SMALL_WORDS
from ..plans.testdata import allocations, table
from ..schema import FUND_NAMES
from .base import query, with_alloc

GRAIN = ["line_number", "part_key", "supplier_key"]
LETTERS = "".join(FUND_NAMES)


@query("fund_suffix", """
SELECT doc_id, coalesce(nullif(regexp_extract(trim(text), '([A-Z])$', 1), ''), 'Z') AS fund
FROM documents""")
def fund_suffix(spark, d):
    return table(spark, d, "documents").select("doc_id", X.fund_suffix(F.col("text")).alias("fund"))


_FUND_TEXT = """CASE o_orderkey % 6 WHEN 0 THEN substr(o_orderstatus, 1, 1)
  WHEN 1 THEN 'Revenue Bond' WHEN 2 THEN 'FEDERAL_AID' WHEN 3 THEN ''
  WHEN 4 THEN 'general' ELSE o_orderpriority END"""


@query("fund_parse", f"""
WITH t AS (SELECT o_orderkey, {_FUND_TEXT} AS txt FROM orders)
SELECT o_orderkey, CASE WHEN txt = '' THEN 'Z'
  WHEN length(txt) = 1 THEN CASE WHEN contains('{LETTERS}', upper(txt)) THEN upper(txt) ELSE 'Z' END
  WHEN txt = 'Revenue Bond' THEN 'E' WHEN txt = 'FEDERAL_AID' THEN 'J'
  WHEN txt = 'general' THEN 'A' ELSE 'Z' END AS fund,
  CASE WHEN length(txt) = 1 THEN CASE upper(txt) WHEN 'F' THEN 'J' WHEN 'O' THEN 'C'
    WHEN 'P' THEN 'P' END END AS legacy
FROM t""")
def fund_parse(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(_FUND_TEXT).alias("txt"))
    return rows.select(
        "o_orderkey", X.fund_from_text(F.col("txt")).alias("fund"),
        F.when(F.length("txt") == 1, X.fund_from_text(F.col("txt"), True)).alias("legacy"))


_FUND_NAME = """CASE doc_id % 7 WHEN 0 THEN 'Federal Trust Fund' WHEN 1 THEN 'Sewer Bond Fund'
  WHEN 2 THEN 'GENERAL FUND' WHEN 3 THEN 'Liquor Commission' WHEN 4 THEN '' ELSE text END"""


@query("county_fund", f"""
WITH t AS (SELECT doc_id, lower({_FUND_NAME}) AS n FROM documents)
SELECT doc_id, CASE WHEN n = '' THEN 'Trust & Other Funds'
  WHEN contains(n, 'trust') THEN 'Trust & Other Funds'
  WHEN regexp_matches(n, 'federal|grant|hud|fta|cdbg|community development|section 8|rental assistance')
    THEN 'Federal Funds'
  WHEN regexp_matches(n, 'bond|debt service|improvement district|capital projects')
    THEN 'Bond / Debt Funds'
  WHEN contains(n, 'general') THEN 'General Fund'
  WHEN regexp_matches(n, 'highway|sewer|wastewater|solid waste|bus|transit|transportation|water|liquor|golf|special|hanauma|zoo|housing|affordable|bikeway|parks|recreation|refuse')
    THEN 'Special / Enterprise Funds'
  ELSE 'Trust & Other Funds' END AS category FROM t""")
def county_fund(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.expr(_FUND_NAME).alias("n"))
    return rows.select("doc_id", X.county_fund_category(F.col("n")).alias("category"))


@query("slug", """
SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
       trim(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '-') AS source_slug
FROM documents""")
def slug(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.slug(F.col("text")).alias("slug"),
        X.department_slug(F.col("source")).alias("source_slug"))


@query("title", """
WITH t AS (SELECT p_partkey, upper(p_name) || ' OF THE ' || upper(p_type) AS n FROM part),
w AS (SELECT p_partkey, list_transform(string_split(lower(n), ' '),
        lambda x: upper(substr(x, 1, 1)) || substr(x, 2)) AS words FROM t)
SELECT p_partkey, replace(replace(array_to_string(words, ' '), ' Of ', ' of '), ' The ', ' the ')
  AS title FROM w""")
def title(spark, d):
    name = F.concat(F.upper("p_name"), F.lit(" OF THE "), F.upper("p_type"))
    return table(spark, d, "part").select("p_partkey", X.title_small_words(name).alias("title"))


_SMALL = "', '".join(SMALL_WORDS)


@query("pretty_names", rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0b\f\r\x{{2013}}\x{{2014}}-]+|[ \t\n\x0b\f\r\x{{2013}}\x{{2014}}-]') AS words,
  regexp_extract_all(lower(text), '[a-z]+|[^a-z]+') AS runs FROM documents),
u AS (SELECT doc_id, unnest(words) AS t, unnest(range(len(words))) AS i FROM w),
p AS (SELECT doc_id, string_agg(CASE WHEN regexp_full_match(t, '\([A-Z]+\)') THEN t
    WHEN regexp_full_match(t, '(?i)[IVX]{{1,4}}') THEN upper(t)
    WHEN i > 0 AND lower(t) IN ('{_SMALL}') THEN lower(t)
    ELSE CASE substr(t, 1, 1) WHEN 'ß' THEN 'SS' ELSE upper(substr(t, 1, 1)) END || lower(substr(t, 2)) END,
    '' ORDER BY i) AS pretty FROM u GROUP BY 1),
v AS (SELECT doc_id, unnest(runs) AS t, unnest(range(len(runs))) AS i FROM w),
q AS (SELECT doc_id, regexp_replace(string_agg(CASE substr(t, 1, 1) WHEN 'ß' THEN 'SS'
    ELSE upper(substr(t, 1, 1)) END || substr(t, 2), '' ORDER BY i), chr(39) || 'S\b', chr(39) || 's', 'g') AS possessive
  FROM v GROUP BY 1)
SELECT doc_id, pretty, possessive FROM p JOIN q USING (doc_id)""")
def pretty_names(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.pretty_name(F.col("text")).alias("pretty"),
        X.possessive_title(F.col("text")).alias("possessive"))


@query("norm_name", r"""
SELECT doc_id, upper(trim(regexp_replace(replace(text, 'ß', 'ss'), '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS name
FROM documents""")
def norm_name(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.normalize_name(F.col("text")).alias("name"))


def _expanded_sql(name):
    """The project-name normal form as nested SQL replacements."""
    steps = [("(?i)^LUMP\\s+SUM\\s+", ""), ("^\\d+\\s+", ""), ("^-\\s+", "")]
    out = f"replace({name}, 'ß', 'ss')"
    for pattern, by in steps:
        out = f"regexp_replace({out}, '{pattern}', '{by}')"
    out = f"regexp_replace(upper(trim({out}, ' ')), '\\s+', ' ', 'g')"
    out = (f"regexp_replace({out}, ',\\s*(OAHU|HAWAII|MAUI|KAUAI|MOLOKAI|LANAI|STATEWIDE|"
           "ALL ISLANDS)\\s*$', '')")
    for pattern, by in ((",\\s*AND\\b", " AND"), ("\\s*&\\s*", " AND "), (",", "")):
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    for short, full in PROJECT_ABBREVIATIONS.items():
        out = f"regexp_replace({out}, '\\b{short}\\b', '{full}', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'), ' ')"


@query("norm_full", f"""
WITH n AS (SELECT p_partkey, 'LUMP SUM 009 ' || p_name || ', CNTR & FAC, AND BLDG, OAHU' AS raw
  FROM part UNION ALL SELECT doc_id, text FROM documents)
SELECT p_partkey, {_expanded_sql('raw')} AS name FROM n""")
def norm_full(spark, d):
    name = F.concat(F.lit("LUMP SUM 009 "), "p_name", F.lit(", CNTR & FAC, AND BLDG, OAHU"))
    parts = table(spark, d, "part").select("p_partkey", X.expand_project_name(name).alias("name"))
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("p_partkey"), X.expand_project_name(F.col("text")).alias("name"))
    return parts.unionByName(docs)


_MONEY_TEXT = """CASE l_orderkey % 6
  WHEN 0 THEN concat('$ (', CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS {s}), ')')
  WHEN 1 THEN '$   - 0' WHEN 2 THEN '  ' WHEN 3 THEN '-'
  WHEN 4 THEN concat('$ ', substr(CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS {s}), 1, 2), ',',
                     substr(CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS {s}), 3))
  ELSE l_returnflag END"""


@query("money", f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_MONEY_TEXT.format(s='VARCHAR')} AS txt,
   CAST(l_extendedprice AS DECIMAL(18, 2)) AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE l_orderkey % 6 WHEN 0 THEN -a WHEN 1 THEN 0
   WHEN 4 THEN a END AS DOUBLE) AS amount FROM t""")
def money(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                       X.clean_money(F.expr(_MONEY_TEXT.format(s="STRING"))).alias("amount"))


@query("money_var", """
SELECT o_orderkey, CAST(-a * 1000 AS DOUBLE) AS thousands, CAST(-w AS DOUBLE) AS credit,
       CAST(-w AS DOUBLE) AS schedule, CAST(-w AS DOUBLE) AS band, CAST(w AS DOUBLE) AS ocr,
       CAST(a AS DOUBLE) AS decorated, CAST(a AS DOUBLE) AS marked
FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS a,
             CAST(floor(o_totalprice) AS BIGINT) AS w FROM orders)""")
def money_var(spark, d):
    a = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    w = F.floor("o_totalprice").cast("string")
    cut = F.length(w) - 3
    grouped = F.concat(F.substr(w, F.lit(1), cut), F.lit(","), F.substr(w, cut + 1))
    dotted = F.concat(F.substr(w, F.lit(1), cut), F.lit("."), F.substr(w, cut + 1))
    styles = {
        "thousands": F.concat(F.lit("($"), a, F.lit(")")),
        "credit": F.concat(grouped, F.lit("-")),
        "schedule": F.concat(F.lit("("), grouped, F.lit(")")),
        "band": F.concat(F.lit("( "), grouped, F.lit(" )")),
        "ocr": F.concat(F.lit("$"), dotted),
        "decorated": F.concat(a, F.lit(" -..")),
        "marked": F.concat(a, F.lit("**")),
    }
    return table(spark, d, "orders").select("o_orderkey", *[X.parse_money(c, k).alias(k) for k, c in styles.items()])


@query("ocr_code", """
WITH t AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'g.1' WHEN 1 THEN 'SVV' WHEN 2 THEN 'HLX'
   WHEN 3 THEN 'sw' WHEN 4 THEN '0I' ELSE substr(p_type, 1, 2) END AS token FROM part)
SELECT p_partkey, CASE token WHEN 'g.1' THEN 'GI' WHEN 'SVV' THEN 'SW' WHEN 'HLX' THEN 'HI'
   WHEN 'sw' THEN 'SW' WHEN '0I' THEN 'GI' END AS code FROM t""")
def ocr_code(spark, d):
    token = F.expr("""CASE p_size % 6 WHEN 0 THEN 'g.1' WHEN 1 THEN 'SVV' WHEN 2 THEN 'HLX'
        WHEN 3 THEN 'sw' WHEN 4 THEN '0I' ELSE substr(p_type, 1, 2) END""")
    return table(spark, d, "part").select("p_partkey", X.repair_fund_code(token).alias("code"))


@query("currency", with_alloc("""
, s AS (SELECT department_code, fiscal_year, sum(amount) AS a FROM alloc GROUP BY ALL)
SELECT department_code, fiscal_year,
  CASE WHEN a >= 1000000000 THEN printf('$%.2fB', CAST(a AS DOUBLE) / 1e9)
       WHEN a >= 1000000 THEN printf('$%.1fM', CAST(round_even(CAST(a AS DOUBLE) / 1e6, 1) AS DOUBLE))
       ELSE format('${:,}', CAST(round_even(CAST(a AS DOUBLE), 0) AS BIGINT)) END AS analysis,
  CASE WHEN a >= 1000000000 THEN printf('$%.1fB', CAST(a AS DOUBLE) / 1e9)
       WHEN a >= 100000000 THEN printf('$%.0fM', CAST(a AS DOUBLE) / 1e6)
       WHEN a >= 10000000 THEN printf('$%.1fM', CAST(a AS DOUBLE) / 1e6)
       ELSE printf('$%.2fM', CAST(a AS DOUBLE) / 1e6) END AS chart,
  CASE WHEN a >= 1000000000 THEN printf('$%.1fB', CAST(a AS DOUBLE) / 1e9)
       WHEN a >= 10000000 THEN printf('$%.0fM', CAST(a AS DOUBLE) / 1e6)
       WHEN a >= 1000000 THEN printf('$%.1fM', CAST(a AS DOUBLE) / 1e6)
       WHEN a >= 1000 THEN printf('$%.0fK', CAST(a AS DOUBLE) / 1e3)
       ELSE printf('$%.0f', CAST(a AS DOUBLE)) END AS brief,
  CASE WHEN a >= 1000000000 THEN '$' || rtrim(rtrim(printf('%.2f', CAST(a AS DOUBLE) / 1e9), '0'),
         '.') || ' billion'
       WHEN a >= 1000000 THEN '$' || rtrim(rtrim(printf('%.2f', CAST(a AS DOUBLE) / 1e6), '0'), '.')
         || ' million'
       ELSE format('${:,}', CAST(round_even(CAST(a AS DOUBLE), 0) AS BIGINT)) END AS words
FROM s"""))
def currency(spark, d):
    sums = allocations(spark, d, "department_code", "fiscal_year", "amount").groupBy(
        "department_code", "fiscal_year").agg(F.sum("amount").alias("a"))
    return sums.select(
        "department_code", "fiscal_year",
        *[X.currency_label(F.col("a"), s).alias(s) for s in ("analysis", "chart", "brief", "words")])


def _half_even(unit):
    """n / unit as a whole number, ties to the even one."""
    return (f"(n // {unit} + CASE WHEN n % {unit} * 2 > {unit} OR (n % {unit} * 2 = {unit} "
            f"AND n // {unit} % 2 = 1) THEN 1 ELSE 0 END)")


def _digits(count, digits):
    return (f"(CAST({count} // {10**digits} AS VARCHAR) || '.' || "
            f"lpad(CAST({count} % {10**digits} AS VARCHAR), {digits}, '0'))")


_HUNDREDTHS, _TENTHS, _MILLIONS = _half_even(10**4), _half_even(10**5), _half_even(10**6)


@query("currency_more", with_alloc(f"""
, k AS (SELECT line_number, part_key, supplier_key, CAST(amount * 1000 AS BIGINT) AS n FROM alloc)
SELECT line_number, part_key, supplier_key,
  '$' || CASE WHEN n % 1000000 = 0 THEN CAST(n // 1000000 AS VARCHAR)
    WHEN n % 100000 = 0 THEN {_digits(_TENTHS, 1)} ELSE {_digits(_HUNDREDTHS, 2)} END || 'M' AS report,
  '$' || CASE WHEN n >= 100000000 THEN CAST({_MILLIONS} AS VARCHAR)
    WHEN n >= 10000000 THEN rtrim(rtrim({_digits(_TENTHS, 1)}, '0'), '.')
    ELSE rtrim(rtrim({_digits(_HUNDREDTHS, 2)}, '0'), '.') END || 'M' AS short,
  '+$' || CASE WHEN n >= 1000000 THEN {_digits(_HUNDREDTHS, 2)} || 'M'
    ELSE CAST((n + 500) // 1000 AS VARCHAR) || 'K' END AS signed
FROM k"""))
def currency_more(spark, d):
    rows = allocations(spark, d, *GRAIN, "amount")
    big = F.col("amount") * 1000
    return rows.select(*GRAIN, *[X.currency_label(big, s).alias(s)
                                 for s in ("report", "short", "signed")])


@query("biennium", with_alloc("""
SELECT fiscal_year - fiscal_year % 2 AS biennium, count(*) AS n FROM alloc GROUP BY 1"""))
def biennium(spark, d):
    rows = allocations(spark, d, "fiscal_year")
    return rows.groupBy(X.biennium_start(F.col("fiscal_year")).alias("biennium")).agg(
        F.count(F.lit(1)).alias("n"))


@query("fy_of", """
SELECT event_id, CAST(year(ts + INTERVAL 6 MONTH) AS BIGINT) AS fiscal_year FROM events""")
def fy_of(spark, d):
    return table(spark, d, "events").select(
        "event_id", X.fiscal_year_of(F.col("ts")).alias("fiscal_year"))


@query("tax", """
WITH b(status, lo, hi, rate) AS (
  SELECT s, lo * m, hi * m, rate FROM (VALUES ('single', 1.0), ('mfj', 2.0), ('hoh', 1.5)) k(s, m),
  (VALUES (0, 2400, 0.014), (2400, 4800, 0.032), (4800, 9600, 0.055), (9600, 14400, 0.064),
    (14400, 19200, 0.068), (19200, 24000, 0.072), (24000, 36000, 0.076), (36000, 48000, 0.079),
    (48000, 150000, 0.0825), (150000, 175000, 0.09), (175000, 200000, 0.10),
    (200000, 1000000000000, 0.11)) r(lo, hi, rate)),
p AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'mfj' WHEN 'O' THEN 'hoh' ELSE 'single'
   END AS status, CAST(o_totalprice AS DECIMAL(18, 2)) AS o_totalprice FROM orders),
t AS (SELECT o_orderkey, p.status, greatest(o_totalprice - CASE p.status WHEN 'mfj' THEN 8800
   WHEN 'hoh' THEN 6424 ELSE 4400 END, 0) AS taxable FROM p)
SELECT o_orderkey, CAST(floor(sum(greatest(least(taxable, hi) - lo, 0) * rate) + 0.5) AS BIGINT) AS tax
FROM t JOIN b ON t.status = b.status GROUP BY 1""")
def tax(spark, d):
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN 'mfj' WHEN 'O' THEN 'hoh' ELSE 'x' END")
    return table(spark, d, "orders").select(
        "o_orderkey", X.income_tax(F.col("o_totalprice"), status).alias("tax"))


@query("sentence", """
WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
    lambda x: rtrim(trim(x, ' '), '.')), lambda x: x <> '') AS parts FROM documents)
SELECT doc_id, CASE WHEN len(parts) > 0 THEN array_to_string(parts, '; ') || '.' ELSE '' END
  AS sentence FROM t""")
def sentence(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.join_sentences(F.split("text", "\n")).alias("sentence"))


@query("label", with_alloc("""
, s AS (SELECT DISTINCT department_code, program_name FROM alloc)
SELECT department_code, program_name, department_code || ' - ' || CASE WHEN length(program_name) > 8
  THEN substr(program_name, 1, 8) || '...' ELSE program_name END AS label FROM s"""))
def label(spark, d):
    names = allocations(spark, d, "department_code", "program_name").distinct()
    return names.withColumn(
        "label", X.truncate_label(F.col("department_code"), F.col("program_name"), 8))


@query("md_norm", r"""
WITH a AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(160), ' ') AS t
  FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '\\([^\w\s]|_)', '\1', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?m)[ \t]+$', '', 'g'), '^[ \t]*\n*', '') AS t FROM b)
SELECT doc_id, regexp_replace(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN t ELSE
    '[[d' || doc_id || ']]' || chr(10) || t || chr(10) || chr(10) ||
    '[[note.1]]' || chr(10) || '  see https://e.org/' || doc_id || '! now' || chr(10) || chr(10) ||
    '[[sources]]' || chr(10) || '[a]: one, [b] two' || chr(10) || '[c-1]: three' || chr(10) || chr(10) ||
    '[[end]]' || chr(10) || 'x [a]: stays' END, '\n{3,}', chr(10) || chr(10), 'g'),
  '^\s+|\s+$', '', 'g') || chr(10) AS text FROM c""")
def md_norm(spark, d):
    number = F.col("doc_id").cast("string")
    link = F.concat(F.lit("https://e.org/"), number)
    keyed = F.concat(
        F.lit("dropped [[no]] text\r\n  [[d"), number, F.lit("]]  \t"), "text",
        F.lit("\n\n\n\\[\\[note.1\\]\\]\n\n\n  see ["), link, F.lit("]("), link,
        F.lit(")\\!\u00a0now \n \n[[sources]] [a]: one, [b] two  [c-1]: three\t\n\n[[end]]\nx [a]: stays"))
    return table(spark, d, "documents").select("doc_id", X.normalize_markdown(
        F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(keyed)).alias("text"))
