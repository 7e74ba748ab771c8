"""Fiscal calendar, closeness and tax arithmetic."""

from decimal import Decimal

from pyspark.sql import functions as F

from ..schema import MONEY

# Income tax brackets (upper bound, marginal rate) of a single
# filer; the other statuses scale the bounds. The last bracket is open.
SINGLE_BRACKETS = [
    (2400, 0.014), (4800, 0.032), (9600, 0.055), (14400, 0.064),
    (19200, 0.068), (24000, 0.072), (36000, 0.076), (48000, 0.079),
    (150000, 0.0825), (175000, 0.09), (200000, 0.10), (None, 0.11),
]
BRACKET_SCALE = {"single": 1.0, "mfj": 2.0, "hoh": 1.5}
STANDARD_DEDUCTION = {"single": 4400, "mfj": 8800, "hoh": 6424}


def biennium_start(year):
    """Even year opens the two-year budget."""
    return year - F.pmod(year, F.lit(2))


def fiscal_year_of(date, first_month=7):
    """Fiscal year X runs from July X-1 to June X."""
    return F.year(date) + F.when(F.month(date) >= first_month, 1).otherwise(0)


def is_close(a, b, rel=1e-5, absolute=1e-8):
    return F.abs(a - b) <= F.lit(absolute) + F.lit(rel) * F.abs(b)


def income_tax(income, status):
    """Progressive tax after the standard deduction, rounded to whole dollars.

    An unknown status is taxed as single. Income counts in cents and the tax is
    summed exactly, so that half dollars always round up.
    """
    def exact(number):
        return F.lit(Decimal(str(number)))

    cents = F.coalesce(income.try_cast(MONEY), exact(0))

    def taxed_as(kind):
        scale = Decimal(str(BRACKET_SCALE[kind]))
        taxable = F.greatest(cents - exact(STANDARD_DEDUCTION[kind]), exact(0))
        total, lower = exact(0), Decimal(0)
        for upper, rate in SINGLE_BRACKETS:
            capped = taxable if upper is None else F.least(taxable, exact(upper * scale))
            total = total + F.greatest(capped - exact(lower), exact(0)) * exact(rate)
            lower = lower if upper is None else upper * scale
        return F.floor(total + exact("0.5"))

    return (
        F.when(status == "mfj", taxed_as("mfj"))
        .when(status == "hoh", taxed_as("hoh"))
        .otherwise(taxed_as("single"))
        .cast("long")
    )
