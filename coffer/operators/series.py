"""Price index, deflators and yearly series.

Yearly series are already aggregated: a handful of rows per key, so plain
windows over years are safe here.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import CAPITAL, OPERATING
from .compare import deflate
from .rollup import sum_section
from .views import year_over_year


def calendar_average(observations):
    """Mean index per calendar year; the annual row M13 and dashes are left out."""
    value = F.col("value").try_cast("decimal(18,4)")
    kept = observations.where(F.col("period") != "M13").withColumn("value", value).where(
        F.col("value").isNotNull())
    return kept.groupBy("year").agg(
        (F.sum("value").cast("double") / F.count("value")).alias("index_value"))


def fiscal_index(annual):
    """Mean of this and the previous calendar year, only where both exist."""
    before = annual.select((F.col("year") + 1).alias("year"),
                           F.col("index_value").alias("__before"))
    return annual.join(before, "year").select(
        F.col("year").alias("fiscal_year"),
        ((F.col("__before") + F.col("index_value")) / 2).alias("fy_index"))


def build_deflators(fy_index, base_year):
    """Base index over yearly index, four places. A missing base is an error."""
    base = fy_index.where(F.col("fiscal_year") == base_year).agg(F.max("fy_index").alias("b"))
    checked = base.select(
        F.when(F.col("b").isNull(), F.raise_error(
            F.lit(f"base fiscal year {base_year} is not in the index"))).otherwise(
            F.col("b")).cast("double").alias("b"))
    return fy_index.select(
        "fiscal_year",
        F.bround(checked.scalar() / F.col("fy_index"), 4).cast("decimal(10,4)").alias("deflator"))


def project_deflators(deflators, required_years):
    """Extend the series past its last year by the mean of the last three ratios.

    With fewer than four years the growth is 2.5 %. Earlier gaps stay open.
    """
    by_year = W.partitionBy(F.lit(0)).orderBy("fiscal_year")
    ratios = deflators.withColumn(
        "ratio", F.lag("deflator").over(by_year).cast("double") / F.col("deflator").cast("double")
    ).withColumn("back", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(
        F.desc("fiscal_year"))))
    growth = ratios.agg(
        F.when(F.count(F.lit(1)) >= 4, F.avg(F.when(F.col("back") <= 3, F.col("ratio")))).otherwise(
            F.lit(1.025)).alias("growth"))
    last = deflators.agg(F.max_by(F.struct("fiscal_year", "deflator"), "fiscal_year").alias("l"))
    latest_year = last.select("l.fiscal_year").scalar()
    latest = last.select(F.col("l.deflator").cast("double")).scalar()
    missing = required_years.select("fiscal_year").distinct().join(
        deflators.select("fiscal_year"), "fiscal_year", "left_anti").where(
        F.col("fiscal_year") > latest_year)
    projected = missing.select(
        "fiscal_year",
        F.bround(latest / F.pow(growth.scalar(), F.col("fiscal_year") - latest_year), 4).cast(
            "decimal(10,4)").alias("deflator"),
        F.lit(True).alias("projected"))
    return deflators.select("fiscal_year", "deflator", F.lit(False).alias("projected")).unionByName(
        projected)


def totals_by_year(df, deflators):
    """Operating, capital and total per year in nominal and real dollars."""
    sums = df.groupBy("fiscal_year").agg(
        sum_section(OPERATING).alias("operating"), sum_section(CAPITAL).alias("capital"))
    sums = sums.withColumn("total", F.col("operating") + F.col("capital"))
    return _nominal_and_real(sums, deflators, ["fiscal_year"], ["operating", "capital", "total"])


def department_series(df, deflators):
    """Department by year with the operating and capital split.

    ``latest_total`` is the department's amount in its last year, the display
    order.
    """
    sums = df.where(F.col("department_code").isNotNull()).groupBy(
        "department_code", "fiscal_year").agg(
        sum_section(OPERATING).alias("operating"), sum_section(CAPITAL).alias("capital"))
    sums = sums.withColumn("total", F.col("operating") + F.col("capital"))
    real = _nominal_and_real(sums, deflators, ["department_code", "fiscal_year"],
                             ["operating", "capital", "total"])
    latest = real.groupBy("department_code").agg(
        F.max_by("total_nominal", "fiscal_year").alias("latest_total"))
    return real.join(latest, "department_code")


def fund_series(df, deflators):
    sums = df.where(
        F.col("section").isin(OPERATING, CAPITAL) & F.col("fund_category").isNotNull()).groupBy(
        "fund_category", "fiscal_year").agg(F.sum("amount").alias("total"))
    return _nominal_and_real(sums, deflators, ["fund_category", "fiscal_year"], ["total"])


def _nominal_and_real(sums, deflators, keys, columns):
    real = deflate(sums, deflators, columns)
    out = []
    for c in columns:
        out += [F.bround(F.col(c), 0).alias(f"{c}_nominal"),
                F.bround(F.col(f"{c}_real"), 0).alias(f"{c}_real")]
    return real.select(*keys, *out, "deflator")


def real_growth(df, deflators):
    """Yearly real totals with their change from the year before."""
    return year_over_year(totals_by_year(df, deflators), [], "fiscal_year", "total_real")


def cash_roll(df, keys, start, encumbered, year="fiscal_year", net="net"):
    """Year-end balances from a start balance and yearly nets.

    ``start`` and ``encumbered`` are Columns; available cash is the last
    balance plus the (negative) encumbered amount.
    """
    w = W.partitionBy(*keys).orderBy(year).rowsBetween(W.unboundedPreceding, 0)
    rolled = df.withColumn("cash_end", start + F.sum(net).over(w))
    last = rolled.groupBy(*keys).agg(
        (F.max_by("cash_end", year) + encumbered).alias("available"))
    return rolled.join(last, list(keys))


def cash_check(rolled, reported, keys, tolerance=2):
    """Rows whose balance is not within tolerance of the reported one."""
    return rolled.join(reported, list(keys)).where(
        F.abs(F.col("cash_end") - F.col("reported")) > tolerance)


def nest_series(df, key, columns, year="fiscal_year"):
    """One row per key with its yearly rows as an array, for JSON sinks.

    A key has one entry per fiscal year, so the array stays short.
    """
    return df.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(year, *columns))).alias("series"))


def school_blocks(df, order, keys, years=5):
    """Stacked blocks of yearly lines: block number and year offset by position."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("block", F.floor(n / years)).withColumn("year_offset", n % years)
