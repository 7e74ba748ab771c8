"""Money text to decimals and back to labels."""

from pyspark.sql import functions as F

from ..schema import MONEY


def _number(text):
    return text.try_cast(MONEY)


def clean_money(text):
    """``$ (1,234)`` to -1234, ``$ - 0`` to 0, blank or unreadable to NULL."""
    bare = F.regexp_replace(text, r"[$,()\s]", "")
    value = F.when(~bare.isin("", "-"), _number(bare))
    in_brackets = text.contains("(") & text.contains(")")
    return F.when(in_brackets, -F.abs(value)).otherwise(value)


def parse_money(text, style):
    """Money token in one of the printed styles.

    ``thousands``   bracketed negatives, result times 1000
    ``credit``      trailing minus is negative; digits only, else NULL
    ``schedule``    dashes and blanks are 0, brackets negative
    ``band``        spaces dropped, either bracket negative, dashes 0
    ``ocr``         dots are misread commas; whole dollars
    ``decorated``   trailing dashes and dots are decoration
    ``marked``      as decorated, after dropping position marks
    """
    t = F.trim(text)
    if style == "thousands":
        value = _number(F.regexp_replace(t, r"[()$,]", "")) * 1000
        return F.when(t.startswith("("), -value).otherwise(value).cast(MONEY)
    if style == "credit":
        bare = F.regexp_replace(text, ",", "")
        digits = F.regexp_replace(bare, r"^-+|-+$", "")
        value = F.when(digits.rlike(r"^[0-9]+$"), _number(digits))
        return F.when(bare.endswith("-"), -value).otherwise(value)
    if style == "schedule":
        bare = F.regexp_replace(t, r"[()$,]", "")
        zero = t.isin("-", "\u2014", "\u2013", "") | bare.isin("", "-")
        negative = t.startswith("(") & t.endswith(")")
        value = _number(bare)
        return F.when(zero, F.lit(0).cast(MONEY)).when(negative, -value).otherwise(value)
    if style == "band":
        s = F.regexp_replace(text, r"\s", "")
        bare = F.regexp_replace(s, r"[(),]", "")
        zero = s.isin("", "-", "\u2014", "\u2013") | bare.isin("", "-")
        value = F.when(bare.rlike(r"^-?[0-9]+$"), _number(bare))
        return (
            F.when(zero, F.lit(0).cast(MONEY))
            .when(s.startswith("(") | s.endswith(")"), -value)
            .otherwise(value)
        )
    if style == "ocr":
        s = F.regexp_replace(text, r"[,.\s$]", "")
        return F.when(s.rlike(r"^-?[0-9]+$"), _number(s))
    if style in ("decorated", "marked"):
        drop = r"[,$]" if style == "decorated" else r"[*#,]"
        s = F.regexp_replace(F.regexp_replace(t, drop, ""), r"[-.\s]+$", "")
        # most words of a page have no digit: they are spared the replacements
        return F.when(t.rlike("[0-9]"), F.when(s.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), _number(s)))
    raise ValueError(f"unknown money style {style!r}")


def _fixed(value, digits):
    return F.format_number(F.bround(value, digits), digits)


def _plain(value, digits):
    return F.format_string(f"%.{digits}f", F.bround(value, digits).cast("double"))


def _trimmed(value, digits):
    text = _plain(value, digits)
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def currency_label(amount, style):
    """Printed amount; the rule sets differ per report.

    ``analysis``  $1.23B / $4.5M / $678
    ``chart``     $1.2B, else millions with 0, 1 or 2 decimals
    ``report``    billions or millions with up to two decimals
    ``brief``     $1.2B / $34M / $5.6M / $78K / $9
    ``words``     $19.88 billion / $450.67 million / $684,385 / $0
    ``short``     $4.8B / $659M / $80.7M / $2.56M
    ``signed``    +$1.23B / -$4.56M / +$7K
    """
    n = amount.cast("decimal(28,8)")
    size = F.abs(n)
    bn, mn, th = n / F.lit(10**9), n / F.lit(10**6), n / F.lit(1000)

    def mark(body, unit):
        return F.concat(F.lit("$"), body, F.lit(unit))

    if style == "analysis":
        return (
            F.when(size >= 10**9, mark(_fixed(bn, 2), "B"))
            .when(size >= 10**6, mark(_fixed(mn, 1), "M"))
            .otherwise(mark(_fixed(n, 0), ""))
        )
    if style == "chart":
        return (
            F.when(n >= 10**9, mark(_plain(bn, 1), "B"))
            .when(n >= 10**8, mark(_plain(mn, 0), "M"))
            .when(n >= 10**7, mark(_plain(mn, 1), "M"))
            .otherwise(mark(_plain(mn, 2), "M"))
        )
    if style == "report":
        def up_to_two(v, unit):
            return (
                F.when(v == F.floor(v), mark(_fixed(v, 0), unit))
                .when(v * 10 == F.floor(v * 10), mark(_fixed(v, 1), unit))
                .otherwise(mark(_fixed(v, 2), unit))
            )
        return F.when(n >= 10**9, up_to_two(bn, "B")).otherwise(up_to_two(mn, "M"))
    if style == "brief":
        return (
            F.when(n >= 10**9, mark(_plain(bn, 1), "B"))
            .when(n >= 10**7, mark(_plain(mn, 0), "M"))
            .when(n >= 10**6, mark(_plain(mn, 1), "M"))
            .when(n >= 1000, mark(_plain(th, 0), "K"))
            .otherwise(mark(_plain(n, 0), ""))
        )
    if style == "words":
        return (
            F.when(n == 0, F.lit("$0"))
            .when(n >= 10**9, mark(_trimmed(bn, 2), " billion"))
            .when(n >= 10**6, mark(_trimmed(mn, 2), " million"))
            .otherwise(mark(_fixed(n, 0), ""))
        )
    if style == "short":
        return (
            F.when(n >= 10**9, mark(_trimmed(bn, 1), "B"))
            .when(mn >= 100, mark(_plain(mn, 0), "M"))
            .when(mn >= 10, mark(_trimmed(mn, 1), "M"))
            .otherwise(mark(_trimmed(mn, 2), "M"))
        )
    if style == "signed":
        sign = F.when(n < 0, F.lit("\u2212")).when(n > 0, F.lit("+")).otherwise(F.lit(""))
        return F.concat(
            sign,
            F.when(size >= 10**9, mark(_plain(size / F.lit(10**9), 2), "B"))
            .when(size >= 10**6, mark(_plain(size / F.lit(10**6), 2), "M"))
            .when(size >= 1000, mark(_plain(F.round(size / F.lit(1000)), 0), "K"))
            .otherwise(mark(F.regexp_replace(F.format_number(size, 3), r"\.?0+$", ""), "")),
        )
    raise ValueError(f"unknown label style {style!r}")
