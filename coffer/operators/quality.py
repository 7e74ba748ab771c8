"""Data-quality findings as tables."""

from pyspark.sql import functions as F

from ..schema import FUND_NAMES

REQUIRED = ["program_id", "program_name", "department_code", "fiscal_year", "amount", "section"]


def validate_rows(df, identity, required=REQUIRED, require_fund=True):
    """One row per finding: missing field (0 counts as missing), fund, sign."""
    tests = []
    for name in required:
        c = F.col(name)
        text = c.cast("string")
        empty = c.isNull() | (text == "")
        if name in ("amount", "fiscal_year"):
            empty = c.isNull() | (c == 0)
        tests.append(F.when(empty, F.lit(f"missing {name}")))
    if require_fund:
        known = [letter for letter in FUND_NAMES if letter != "Z"]
        ok = F.coalesce(F.col("fund_type").isin(known), F.lit(False))
        tests.append(F.when(~ok, F.lit("invalid fund_type")))
    if "amount" in df.columns:
        tests.append(F.when(F.col("amount") < 0, F.lit("negative amount")))
    return df.select(*identity, F.explode(F.array_compact(F.array(*tests))).alias("error"))


def validation_verdict(df, errors):
    """Row and error counts; an empty input is invalid."""
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    n_errors = errors.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.withColumn("n_errors", n_errors).withColumn(
        "is_valid", (F.col("n_rows") > 0) & (F.col("n_errors") == 0))


def control_totals(df, controls, keys, value="amount"):
    """Parsed against published totals.

    A control row carries ``expected`` with a relative ``tolerance`` and an
    absolute ``floor``; the larger of both is allowed.
    """
    sums = df.groupBy(*keys).agg(F.sum(value).alias("parsed"))
    joined = controls.join(sums, list(keys), "left").withColumn(
        "parsed", F.coalesce("parsed", F.lit(0)))
    diff = F.col("parsed") - F.col("expected")
    allowed = F.greatest(
        F.abs("expected").cast("double") * F.col("tolerance"), F.col("floor").cast("double"))
    return joined.select(*keys, "expected", "parsed", diff.alias("difference"),
                         (F.abs(diff).cast("double") <= allowed).alias("passed"))


def named_checks(got, wanted, name="check"):
    """Got, want, tolerance and pass per named figure."""
    joined = wanted.join(got, name, "left")
    miss = F.abs(F.coalesce(F.col("got"), F.lit(0)) - F.col("want"))
    return joined.withColumn("passed", F.col("got").isNotNull() & (miss <= F.col("tolerance")))


def identity_violations(df, keys, tolerance=2):
    """Rows where net is not revenue minus expenditure, or parts miss the total."""
    net_gap = F.abs(F.col("net") - (F.col("revenue") - F.col("expenditure")))
    sum_gap = F.abs(F.col("total") - F.col("parts"))
    return df.select(
        *keys, F.explode(F.array_compact(F.array(
            F.when(net_gap > tolerance, F.lit("net")),
            F.when(sum_gap > tolerance, F.lit("parts"))))).alias("violation"))


def label_findings(df, identity, column):
    """Doubled dollar signs and amounts not shaped like ``$1.2M``."""
    doubled = F.col(column).contains("$$")
    bad = ~F.col(column).rlike(r"^\$[0-9][0-9,]*(\.[0-9]+)?[MB]$")
    return df.select(*identity, column, F.explode(F.array_compact(F.array(
        F.when(doubled, F.lit("double dollar")), F.when(bad, F.lit("bad amount"))))).alias(
        "finding"))


def truncated_sources(df, source, limit):
    """Sources that delivered as many rows as the feed allows."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n_rows")).where(
        F.col("n_rows") >= limit)
