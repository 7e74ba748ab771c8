"""Round trips: rows written by a sink and read back, next to the rows themselves."""

import uuid

from pyspark.sql import functions as F

from ..operators.views import positive_amounts
from ..plans.testdata import allocations, table
from ..session import shared_folder
from ..sinks import (
    write_analysis,
    write_by_department,
    write_csv,
    write_hierarchy,
    write_json_records,
    write_yearly_csv,
)
from ..sources.readers import read_allocations, read_descriptions, read_lines
from .base import query, with_alloc

ROWS = ["department_code", "program_id", "section", "fiscal_year", "amount", "line_number"]
TYPES = "department_code string, program_id string, section string, fiscal_year long, " \
        "amount decimal(18,2), line_number long"


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _typed(df):
    return df.select(*[F.col(c.split()[0]).cast(c.strip().split(" ", 1)[1]) for c in TYPES.split(", ")])


_SUMS = """
SELECT {keys}, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount, sum(line_number) AS lines
FROM alloc {where} GROUP BY {keys}"""


def _sums(df, *keys):
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"),
                                 F.sum("line_number").cast("decimal(38,0)").alias("lines"))


@query("sink_yearly_csv", with_alloc(_SUMS.format(
    keys="fiscal_year, program_id", where="WHERE section = 'Operating'").replace(
    "sum(line_number)", "CAST(sum(line_number) AS DOUBLE)")))
def sink_yearly_csv(spark, d):
    path = _place(spark, "yearly")
    write_yearly_csv(allocations(spark, d, *ROWS), path, section="operating")
    return _sums(_typed(spark.read.option("header", True).csv(path)), "fiscal_year", "program_id")


@query("sink_json_records", with_alloc(_SUMS.format(
    keys="department_code, section, fiscal_year", where="").replace(
    "sum(line_number)", "CAST(sum(line_number) AS DOUBLE)")))
def sink_json_records(spark, d):
    path = _place(spark, "records")
    write_json_records(allocations(spark, d, *ROWS), path)
    return _sums(spark.read.schema(TYPES).json(path), "department_code", "section", "fiscal_year")


@query("sink_by_department", with_alloc(_SUMS.format(
    keys="department_code, program_id", where="").replace(
    "sum(line_number)", "CAST(sum(line_number) AS DOUBLE)")))
def sink_by_department(spark, d):
    path = _place(spark, "departments")
    write_by_department(allocations(spark, d, *ROWS), path)
    return _sums(_typed(spark.read.parquet(path)), "department_code", "program_id")


@query("sink_analysis", with_alloc("""
SELECT 'department' AS name, department_code AS key, CAST(sum(amount) AS DOUBLE) AS amount FROM alloc GROUP BY 2
UNION ALL
SELECT 'year', CAST(fiscal_year AS VARCHAR), CAST(sum(amount) AS DOUBLE) FROM alloc GROUP BY fiscal_year"""))
def sink_analysis(spark, d):
    path, rows = _place(spark, "analysis"), allocations(spark, d, "department_code", "fiscal_year", "amount")
    keys = {"department": "department_code", "year": "fiscal_year"}
    write_analysis({name: rows.groupBy(F.col(key).cast("string").alias("key")).agg(
        F.sum("amount").alias("amount")) for name, key in keys.items()}, path, "csv")
    back = [spark.read.option("header", True).csv(f"{path}/{name}").select(
        F.lit(name).alias("name"), "key", F.col("amount").cast("decimal(28,2)").alias("amount")) for name in keys]
    return back[0].unionByName(back[1])


@query("sink_filtered_csv", with_alloc("""
SELECT line_number, department_code, section, CAST(amount AS DOUBLE) AS amount FROM alloc
WHERE amount > 0 AND fiscal_year = 1996"""))
def sink_filtered_csv(spark, d):
    path = _place(spark, "filtered")
    write_csv(positive_amounts(allocations(spark, d, *ROWS, years=[1996])), path)
    return _typed(spark.read.option("header", True).csv(path)).select(
        "line_number", "department_code", "section", "amount")


@query("sink_hierarchy", with_alloc("""
, c AS (SELECT department_code, program_id, sum(amount) AS amount FROM alloc GROUP BY ALL)
SELECT department_code, CAST(sum(amount) OVER (PARTITION BY department_code) AS DOUBLE) AS total, program_id,
  CAST(amount AS DOUBLE) AS amount,
  row_number() OVER (PARTITION BY department_code ORDER BY amount DESC, program_id) - 1 AS place FROM c"""))
def sink_hierarchy(spark, d):
    path = _place(spark, "hierarchy")
    programs = allocations(spark, d, "department_code", "program_id", "amount").groupBy(
        "department_code", "program_id").agg(F.sum("amount").alias("amount"))
    parents = programs.groupBy("department_code").agg(F.sum("amount").alias("total"))
    write_hierarchy(parents, programs.withColumn("rank", -F.col("amount")), ["department_code"],
                    ["program_id", "amount"], path, order=("rank", "program_id"))
    back = spark.read.schema("department_code string, total decimal(38,2), "
                             "programs array<struct<program_id:string,amount:decimal(28,2)>>").json(path)
    return back.select("department_code", "total", F.posexplode("programs").alias("place", "p")).select(
        "department_code", "total", "p.program_id", "p.amount", "place")


@query("file_lines", """
SELECT line, count(*) AS n FROM (SELECT unnest(string_split(replace(replace(replace(coalesce(text, ''),
  chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), chr(10))) AS line FROM documents)
GROUP BY line""")
def file_lines(spark, d):
    path = _place(spark, "lines")
    table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("text")).write.text(path)
    return read_lines(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("allocation_csv", with_alloc("""
SELECT department_code, section, fiscal_year, count(*) AS n, count(TRY_CAST(fund_type AS INTEGER)) AS numbers,
  CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(positions) AS DOUBLE) AS positions FROM alloc
GROUP BY department_code, section, fiscal_year"""))
def allocation_csv(spark, d):
    path = _place(spark, "allocations")
    write_csv(allocations(spark, d, *ROWS, "fund_type", "positions"), path)
    return read_allocations(spark, path).groupBy("department_code", "section", "fiscal_year").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.col("fund_type").try_cast("int")).alias("numbers"),
        F.sum("amount").alias("amount"), F.sum("positions").alias("positions"))


@query("descriptions_json", """
SELECT n_name AS department_code, 'The "' || n_name || '"' AS name, 'Works in region ' || n_regionkey || '.' AS description
FROM nation UNION ALL SELECT r_name, 'Region ' || r_name, 'No. ' || r_regionkey FROM region""")
def descriptions_json(spark, d):
    path, nation, region = _place(spark, "texts"), table(spark, d, "nation"), table(spark, d, "region")
    # both dimensions are short fixed lists, as the files of descriptions are
    entry = F.struct(F.concat(F.lit('The "'), "n_name", F.lit('"')).alias("name"),
                     F.concat(F.lit("Works in region "), "n_regionkey", F.lit(".")).alias("description"))
    keyed = nation.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", entry)))).alias("t"))
    listed = region.agg(F.to_json(F.collect_list(F.struct(
        F.col("r_name").alias("code"), F.concat(F.lit("Region "), "r_name").alias("name"),
        F.concat(F.lit("No. "), "r_regionkey").alias("description")))).alias("t"))
    keyed.write.text(f"{path}/keyed")
    listed.write.text(f"{path}/listed")
    return read_descriptions(spark, f"{path}/keyed").unionByName(read_descriptions(spark, f"{path}/listed"))
