"""Grant blocks: declared sums, numbered items and their audit."""

from pyspark.sql import functions as F

from ..schema import DEPARTMENT_NAMES, FUND_NAMES, GRANTS, MONEY, lookup
from .ordered import carry_forward

# Header, item, program code and end of a grant block.
HEADER = (
    r"(?i)There is appropriated out of the general revenues of the State of Hawaii\s+"
    r"the sum of \$([\d,]+)\s+or so much there\s*-?\s*of as may be necessary\s+"
    r"for fiscal year (\d{4})-(\d{4})"
)
ITEM = r"^\s*(\d+)\.\s+\$([\d,]+)\.\d{2}\s+(\S.*?)\s*$"
PROGRAM_CODE = r"\(([A-Z]{3}\d{3})\)"
BLOCK_END = r'^\s*"?SECTION\s+\d+'


def _money(text):
    return F.nullif(F.replace(text, F.lit(","), F.lit("")), F.lit("")).try_cast(MONEY)


def _carried(lines):
    header = F.col("line").rlike(HEADER)
    item = ~header & F.col("line").rlike(ITEM)
    at = F.col("line_no").alias("at")
    code = F.nullif(F.regexp_extract("line", PROGRAM_CODE, 1), F.lit(""))
    marked = lines.withColumns({
        "is_header": header, "is_item": item, "code": code,
        "is_end": ~header & F.col("line").rlike(BLOCK_END)})
    return carry_forward(
        marked, ["doc_id"], "line_no",
        {
            "block": F.when(F.col("is_header"), F.struct(
                at, _money(F.regexp_extract("line", HEADER, 1)).alias("declared"),
                F.regexp_extract("line", HEADER, 3).try_cast("int").alias("fiscal_year"),
                F.col("code").alias("default_code"))),
            "item": F.when(F.col("is_item"), F.struct(at)),
            "closed": F.when(F.col("is_end"), F.struct(at)),
        })


def extract_grants(lines, allocations=None):
    """One row per grant item.

    The year is the second of the printed pair. A program code in the lines
    after an item is its program (the first one counts), else the code in the
    block header. Names and category come from the first allocation of the
    program where one is given.
    """
    rows = _carried(lines)
    never = F.lit(-1)
    opened = F.col("block.at") > F.coalesce(F.col("closed.at"), never)
    inside = opened & (F.col("item.at") > F.col("block.at"))
    items = rows.where(F.col("is_item") & opened).select(
        "doc_id", F.col("line_no").alias("line_number"), F.col("block.at").alias("block_line"),
        F.col("block.fiscal_year").alias("fiscal_year"),
        F.col("block.default_code").alias("default_code"),
        _money(F.regexp_extract("line", ITEM, 2)).alias("amount"),
        F.trim(F.regexp_extract("line", ITEM, 3)).alias("recipient"))
    codes = rows.where(
        inside & ~F.col("is_item") & ~F.col("is_header") & F.col("code").isNotNull()).groupBy(
        "doc_id", F.col("item.at").alias("line_number")).agg(
        F.min_by("code", "line_no").alias("own_code"))
    joined = items.join(codes, ["doc_id", "line_number"], "left").withColumn(
        "program_id", F.coalesce("own_code", "default_code", F.lit("UNKNOWN")))
    if allocations is None:
        known = joined.withColumn("k", F.lit(None).cast(
            "struct<program_name:string,department_code:string,department_name:string,"
            "category:string>"))
    else:
        first = allocations.groupBy("doc_id", "program_id").agg(F.min_by(
            F.struct("program_name", "department_code", "department_name", "category"),
            F.struct("line_number", "fiscal_year")).alias("k"))
        known = joined.join(first, ["doc_id", "program_id"], "left")
    prefix = F.upper(F.substring("program_id", 1, 3))
    listed = lookup(DEPARTMENT_NAMES, prefix)
    return known.select(
        "doc_id", "block_line", "line_number", "program_id",
        F.coalesce("k.program_name", "program_id").alias("program_name"),
        F.when(listed.isNotNull(), prefix).otherwise(
            F.coalesce(F.col("k.department_code"), prefix)).alias("department_code"),
        F.coalesce(listed, F.col("k.department_name"), prefix).alias("department_name"),
        F.lit(GRANTS).alias("section"), F.lit("A").alias("fund_type"),
        F.lit(FUND_NAMES["A"]).alias("fund_category"), "fiscal_year", "amount",
        F.col("k.category").alias("category"),
        F.concat(F.lit("Ch.42F grant: "), F.col("recipient")).alias("notes"))


def grant_blocks(lines):
    rows = lines.where(F.col("line").rlike(HEADER))
    return rows.select(
        "doc_id", F.col("line_no").alias("block_line"),
        F.regexp_extract("line", HEADER, 3).try_cast("int").alias("fiscal_year"),
        _money(F.regexp_extract("line", HEADER, 1)).alias("declared_total"))


def audit_grants(lines, grants):
    """Declared against itemised sum per block."""
    sums = grants.groupBy("doc_id", "block_line").agg(
        F.sum("amount").alias("itemized_total"), F.count(F.lit(1)).alias("item_count"))
    joined = grant_blocks(lines).join(sums, ["doc_id", "block_line"], "left").withColumns({
        "itemized_total": F.coalesce("itemized_total", F.lit(0)),
        "item_count": F.coalesce("item_count", F.lit(0))})
    return joined.withColumn(
        "reconciles", F.abs(F.col("itemized_total") - F.col("declared_total")) < 0.01)
