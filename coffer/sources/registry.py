"""Bill registry: sessions, their bills and the years they cover."""

from pyspark.sql import functions as F

SCHEMA = (
    "session int, fy_covered array<int>, "
    "bills array<struct<number:string,act:string,scope:string>>"
)

# Biennial budget acts by session.
BIENNIAL_BILLS = [
    (2015, [2016, 2017], [("HB500", "Act 119, SLH 2015", "combined")]),
    (2017, [2018, 2019], [("HB100", "Act 049, SLH 2017", "combined")]),
    (2019, [2020, 2021], [("HB2", "Act 005, SLH 2019", "operating"),
                          ("HB1259", "Act 042, SLH 2019", "capital")]),
    (2021, [2022, 2023], [("HB200", "Act 088, SLH 2021", "combined")]),
    (2023, [2024, 2025], [("HB300", "Act 164, SLH 2023", "combined")]),
    (2025, [2026, 2027], [("HB300", "Act 250, SLH 2025", "combined")]),
]
SUPPLEMENTAL_BILLS = [
    (2026, [2026, 2027], [("HB1800", "Act 175, SLH 2026", "supplemental")]),
]


def biennial_registry(spark):
    return spark.createDataFrame(BIENNIAL_BILLS, SCHEMA)


def explode_bills(registry):
    """One row per bill, in listed order."""
    return registry.select(
        "session", "fy_covered", F.posexplode("bills").alias("place", "bill")
    ).select("session", "fy_covered", "place", "bill.*")


def years_covered(registry):
    return registry.select(F.explode("fy_covered").alias("fiscal_year")).distinct()


def bill_labels(registry):
    """``HB2 + HB1259`` per session."""
    numbers = F.transform("bills", lambda b: b["number"])
    return registry.select("session", F.array_join(numbers, " + ").alias("label"))


def coverage_notes(registry):
    """A note for sessions enacted through more than one bill."""
    names = F.array_join(F.transform("bills", lambda b: b["number"]), " and ")
    return registry.where(F.size("bills") > 1).select(
        "session",
        F.concat(F.lit("The "), F.col("session").cast("string"),
                 F.lit(" biennial budget was enacted as two bills: "), names,
                 F.lit(". Totals here combine both.")).alias("note"))
