"""Column types and fixed lookups of the allocation model."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
POSITIONS = T.DecimalType(12, 2)

OPERATING = "Operating"
CAPITAL = "Capital Improvement"
ONE_TIME = "One-Time"
GRANTS = "Grants in Aid"
UNSPECIFIED = "Unspecified"
SECTIONS = [OPERATING, CAPITAL, ONE_TIME, GRANTS, UNSPECIFIED]

ALLOCATION = T.StructType(
    [
        T.StructField("program_id", T.StringType()),
        T.StructField("program_name", T.StringType()),
        T.StructField("department_code", T.StringType()),
        T.StructField("department_name", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("fund_type", T.StringType()),
        T.StructField("fund_category", T.StringType()),
        T.StructField("fiscal_year", T.IntegerType()),
        T.StructField("amount", MONEY),
        T.StructField("positions", POSITIONS),
        T.StructField("positions_temp", POSITIONS),
        T.StructField("ceiling", MONEY),
        T.StructField("allocation_type", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("subcategory", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

PROJECT = T.StructType(
    [
        T.StructField("project_id", T.StringType()),
        T.StructField("project_name", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("program_id", T.StringType()),
        T.StructField("program_name", T.StringType()),
        T.StructField("department_code", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("fiscal_year", T.IntegerType()),
        T.StructField("amount", MONEY),
        T.StructField("fund_type", T.StringType()),
        T.StructField("line_number", T.LongType()),
    ]
)

COUNTY_ALLOCATION = T.StructType(
    [
        T.StructField("county", T.StringType()),
        T.StructField("department_code", T.StringType()),
        T.StructField("department_name", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("fund_name", T.StringType()),
        T.StructField("fund_category", T.StringType()),
        T.StructField("fiscal_year", T.IntegerType()),
        T.StructField("amount", MONEY),
        T.StructField("program_name", T.StringType()),
        T.StructField("positions", POSITIONS),
        T.StructField("source", T.StringType()),
    ]
)

# Fund letters of the state budget, in enumeration order.
FUND_NAMES = {
    "A": "General Funds",
    "B": "Special Funds",
    "C": "General Obligation Bond Fund",
    "D": "General Obligation Bond Fund with Debt Service Cost to be Paid from Special Funds",
    "E": "Revenue Bond Funds",
    "J": "Federal Aid Interstate Funds",
    "K": "Federal Aid Primary Funds",
    "L": "Federal Aid Secondary Funds",
    "M": "Federal Aid Urban Funds",
    "N": "Federal Funds",
    "P": "Other Federal Funds",
    "R": "Private Contributions",
    "S": "County Funds",
    "T": "Trust Funds",
    "U": "Interdepartmental Transfers",
    "V": "American Rescue Plan Funds",
    "W": "Revolving Funds",
    "X": "Other Funds",
    "Z": "Uncategorized Funds",
}

# Enumeration names accepted when a fund is written out.
FUND_KEYS = {
    "GENERAL": "A",
    "SPECIAL": "B",
    "GENERAL_OBLIGATION_BOND": "C",
    "GENERAL_OBLIGATION_BOND_SPECIAL": "D",
    "REVENUE_BOND": "E",
    "FEDERAL_AID_INTERSTATE": "J",
    "FEDERAL_AID_PRIMARY": "K",
    "FEDERAL_AID_SECONDARY": "L",
    "FEDERAL_AID_URBAN": "M",
    "FEDERAL": "N",
    "OTHER_FEDERAL": "P",
    "PRIVATE_CONTRIBUTIONS": "R",
    "COUNTY": "S",
    "TRUST": "T",
    "INTERDEPARTMENTAL": "U",
    "ARP": "V",
    "REVOLVING": "W",
    "OTHER": "X",
    "UNKNOWN": "Z",
}

# Program category letters.
CATEGORY_NAMES = {
    "A": "Economic Development",
    "B": "Employment",
    "C": "Transportation",
    "D": "Environment",
    "E": "Health",
    "F": "Human Services",
    "G": "Education",
    "H": "Culture and Recreation",
    "I": "Public Safety",
    "J": "Individual Rights",
    "K": "Government Operations",
}

# Department codes.
DEPARTMENT_NAMES = {
    "AGR": "Department of Agriculture and Biosecurity",
    "AGS": "Department of Accounting and General Services",
    "ATG": "Department of the Attorney General",
    "BED": "Department of Business, Economic Development, and Tourism",
    "BUF": "Department of Budget and Finance",
    "CCA": "Department of Commerce and Consumer Affairs",
    "CCH": "City and County of Honolulu",
    "COH": "County of Hawaii",
    "COK": "County of Kauai",
    "COM": "County of Maui",
    "DEF": "Department of Defense",
    "EDN": "Department of Education",
    "GOV": "Office of the Governor",
    "HHL": "Department of Hawaiian Home Lands",
    "HMS": "Department of Human Services",
    "HRD": "Department of Human Resources Development",
    "HTH": "Department of Health",
    "JUD": "The Judiciary",
    "LAW": "Department of Law Enforcement",
    "LBR": "Department of Labor and Industrial Relations",
    "LEG": "Legislature",
    "LNR": "Department of Land and Natural Resources",
    "LTG": "Office of the Lieutenant Governor",
    "OHA": "Office of Hawaiian Affairs",
    "PSD": "Department of Corrections and Rehabilitation",
    "SUB": "Subsidies",
    "TAX": "Department of Taxation",
    "TRN": "Department of Transportation",
    "UOH": "University of Hawaii",
}

# The three fund groupings used by different reports.
FUND_GROUPS_CHART = {
    "A": "General Funds", "B": "Special Funds", "N": "Federal Funds", "P": "Federal Funds",
}
FUND_GROUPS_REPORT = {
    "A": "General Funds", "B": "Special Funds", "N": "Federal Funds", "P": "Federal Funds",
    "R": "Other Funds", "S": "Other Funds", "T": "Other Funds", "U": "Other Funds",
    "W": "Other Funds",
}


def lookup(mapping, key):
    """Value of a small fixed dictionary for a column, NULL when absent."""
    flat = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.try_element_at(F.create_map(*flat), key)


def ensure_columns(df, schema):
    """Select the declared columns with their types; absent ones become typed NULLs."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
