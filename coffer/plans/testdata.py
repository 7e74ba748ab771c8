"""The driver's star schema seen through the allocation model.

Each dimension is joined only when one of its columns is asked for. Joins are
left joins without hints: adaptive execution broadcasts a side only after it
has measured it, and splits skewed partitions otherwise.
"""

from pyspark.sql import functions as F

from ..functions import fiscal_year_of
from ..operators.views import section_of_flag
from ..schema import FUND_NAMES, MONEY, POSITIONS, lookup
from ..session import write_out

PRIORITY_FUND = {"1": "A", "2": "B", "3": "N", "4": "C", "5": "W"}

_ORDERS = {"fund_type", "fund_category", "fiscal_year", "department_code", "department_name",
           "order_date"}
_CUSTOMER = {"department_code", "department_name"}
_PART = {"program_id", "program_name", "category"}

_EXPRESSIONS = {
    "line_number": lambda: (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long"),
    "part_key": lambda: F.col("l_partkey"),
    "supplier_key": lambda: F.col("l_suppkey"),
    "order_date": lambda: F.col("o_orderdate"),
    "program_id": lambda: F.concat(
        F.upper(F.substring("p_type", 1, 3)), F.lpad(F.col("p_size").cast("string"), 3, "0")),
    "program_name": lambda: F.col("p_name"),
    "category": lambda: F.col("p_brand"),
    "department_code": lambda: F.col("n_name"),
    "department_name": lambda: F.concat_ws(" ", "n_name", "r_name"),
    "section": lambda: section_of_flag(F.col("l_returnflag"), F.col("l_discount")),
    "fund_type": lambda: lookup(PRIORITY_FUND, F.substring("o_orderpriority", 1, 1)),
    "fund_category": lambda: lookup(
        {p: FUND_NAMES[f] for p, f in PRIORITY_FUND.items()},
        F.substring("o_orderpriority", 1, 1)),
    "fiscal_year": lambda: fiscal_year_of(F.col("o_orderdate")),
    "amount": lambda: F.col("l_extendedprice").cast(MONEY),
    "positions": lambda: F.when(F.col("l_tax") != 0, F.col("l_quantity").cast(POSITIONS)),
    "draft": lambda: F.col("l_linestatus"),
}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_lines(spark, sf_dir):
    """Lowest line number of each program; lines become one per part before parts are joined.

    The result, one row a program, is written, so that a join knows its size.
    """
    lines = allocations(spark, sf_dir, "part_key", "line_number").groupBy("part_key").agg(
        F.min("line_number").alias("line_number"))
    parts = table(spark, sf_dir, "part").select("p_partkey", _EXPRESSIONS["program_id"]().alias("program_id"))
    return write_out(lines.join(parts, F.col("part_key") == F.col("p_partkey"), "left").groupBy("program_id").agg(
        F.min("line_number").alias("line_number")))


def allocations(spark, sf_dir, *columns, years=None, lines=None):
    """Allocation rows with just the requested columns (all when none given).

    ``years`` keeps the fiscal years from the first to the last given. It is
    stated as a date range on the orders, so that the scan can skip row groups
    and the join drops the other lines early.
    """
    wanted = list(columns) or [c for c in _EXPRESSIONS if c not in ("order_date",)]
    need = set(wanted)
    if years:
        need.add("order_date")
    rows = table(spark, sf_dir, "lineitem")
    if lines is not None:
        number = lines.select(F.col("line_number").alias("__line"))
        rows = rows.join(number, _EXPRESSIONS["line_number"]().eqNullSafe(F.col("__line")), "left_semi")
    if need & _ORDERS:
        orders = table(spark, sf_dir, "orders").select(
            "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        if years:
            first, last = min(years) - 1, max(years)
            date = F.col("o_orderdate")
            orders = orders.where(
                (date >= F.lit(f"{first}-07-01").cast("timestamp"))
                & (date < F.lit(f"{last}-07-01").cast("timestamp")))
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"),
                         "inner" if years else "left")
    if need & _CUSTOMER:
        customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        nations = table(spark, sf_dir, "nation")
        regions = table(spark, sf_dir, "region")
        rows = (
            rows.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
            .join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        )
    if need & _PART:
        parts = table(spark, sf_dir, "part").select(
            "p_partkey", "p_name", "p_brand", "p_type", "p_size")
        rows = rows.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.select(*[_EXPRESSIONS[c]().alias(c) for c in wanted])
