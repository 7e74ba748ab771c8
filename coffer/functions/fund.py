"""Fund letters, names and groupings."""

from pyspark.sql import functions as F

from ..schema import FUND_KEYS, FUND_NAMES, lookup

# Keywords per county fund category, checked in this order.
COUNTY_KEYWORDS = [
    ("Federal Funds", ["federal", "grant", "hud", "fta", "cdbg", "community development",
                       "section 8", "rental assistance"]),
    ("Bond / Debt Funds", ["bond", "debt service", "improvement district", "capital projects"]),
    ("General Fund", ["general fund", "general"]),
    ("Special / Enterprise Funds", ["highway", "sewer", "wastewater", "solid waste", "bus",
                                    "transit", "transportation", "water", "liquor", "golf",
                                    "special events", "hanauma", "zoo", "housing", "affordable",
                                    "bikeway", "parks", "recreation", "refuse", "special"]),
]
TRUST_OTHER = "Trust & Other Funds"

# Two-letter capital fund codes and their common misreadings.
CAPITAL_FUND_CODES = ["SR", "GI", "HI", "TB", "WB", "AF", "BK", "CF", "CP", "GN", "PP", "SW",
                      "CD", "FG"]
CODE_MISREADINGS = {
    "ILI": "HI", "CI": "GI", "GL": "GI", "GB": "GI", "01": "GI", "0I": "GI",
    "SVV": "SW", "SVI": "SW",
}


def fund_suffix(text, default="Z"):
    """Trailing capital letter of an amount such as ``1,000A``."""
    letter = F.regexp_extract(F.trim(text), r"([A-Z])$", 1)
    return F.when(letter == "", F.lit(default)).otherwise(letter)


def fund_from_text(value, legacy_partial=False):
    """Fund letter from a letter, an enumeration name, or part of one.

    A single letter that is no fund code is ``Z``; ``legacy_partial`` lets it
    fall through to the partial match instead.
    """
    key = F.upper(F.replace(value, F.lit(" "), F.lit("_")))
    single = F.length(value) == 1
    known = F.when(lookup(FUND_NAMES, F.upper(value)).isNotNull(), F.upper(value))
    partial = F.lit("Z")
    for name, letter in reversed(list(FUND_KEYS.items())):
        partial = F.when(F.lit(name).contains(key), F.lit(letter)).otherwise(partial)
    unmatched_letter = partial if legacy_partial else F.lit("Z")
    return (
        F.when(value.isNull() | (value == ""), F.lit("Z"))
        .when(single & known.isNotNull(), known)
        .when(single, unmatched_letter)
        .otherwise(F.coalesce(lookup(FUND_KEYS, key), partial))
    )


def fund_name(letter):
    return F.coalesce(lookup(FUND_NAMES, letter), F.lit(FUND_NAMES["Z"]))


def fund_group(letter, groups, default="Other Funds"):
    """Report-level grouping of fund letters; the mapping is a parameter."""
    return F.coalesce(lookup(groups, letter), F.lit(default))


def county_fund_category(name):
    """County fund category: trust first, then the keyword groups in order."""
    lowered = F.lower(name)
    result = F.when(name.isNull() | (name == ""), F.lit(TRUST_OTHER)).when(
        lowered.contains("trust"), F.lit(TRUST_OTHER)
    )
    for category, words in COUNTY_KEYWORDS:
        result = result.when(lowered.rlike("|".join(words)), F.lit(category))
    return result.otherwise(F.lit(TRUST_OTHER))


def repair_fund_code(token, codes=None, misreadings=None):
    """Known two-letter code from an optically read token, else NULL."""
    codes = CAPITAL_FUND_CODES if codes is None else codes
    misreadings = CODE_MISREADINGS if misreadings is None else misreadings
    clean = F.upper(F.regexp_replace(F.coalesce(token, F.lit("")), r"[^A-Za-z0-9]", ""))
    swapped = F.translate(clean, "L1B0", "IIIG")
    return (
        F.when(clean.isin(codes), clean)
        .when(lookup(misreadings, clean).isNotNull(), lookup(misreadings, clean))
        .when(swapped.isin(codes), swapped)
        .when(F.substring(swapped, 1, 2).isin(codes), F.substring(swapped, 1, 2))
    )
