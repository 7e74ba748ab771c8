"""Filters, projections, orderings and set operations on allocation rows."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import CAPITAL, GRANTS, MONEY, ONE_TIME, OPERATING, SECTIONS
from .ordered import null_safe_join


def section_of_flag(flag, discount):
    """Section of a stand-in row: N operating, A capital, R one-time or grant."""
    return (
        F.when(flag == "N", F.lit(OPERATING))
        .when(flag == "A", F.lit(CAPITAL))
        .when((flag == "R") & (discount > 0.095), F.lit(GRANTS))
        .when(flag == "R", F.lit(ONE_TIME))
    )


def _section_name(section):
    for name in SECTIONS:
        if section.lower() == name.lower():
            return name
    return section


def standard_view(df, fiscal_year=None, section=None, keep_grants=False):
    """Rows of one year and section, with millions and a capital flag.

    Without a section (or with ``all``) grants are left out; they are reached
    only by name. Section spelling is case-insensitive.
    """
    out = df
    if fiscal_year is not None:
        out = out.where(F.col("fiscal_year") == fiscal_year)
    if section is not None and section.lower() != "all":
        out = out.where(F.col("section") == _section_name(section))
    elif not keep_grants:
        out = out.where(~F.col("section").eqNullSafe(GRANTS))
    amount = F.col("amount").try_cast(MONEY)
    return out.withColumn("amount", amount).withColumn(
        "amount_millions", F.col("amount").cast("double") / 1_000_000
    ).withColumn("is_capital", F.coalesce(F.col("section") == CAPITAL, F.lit(False)))


def clean_columns(df, text=("program_name", "section"), fund="fund_type", amount="amount"):
    """Newlines to blanks, trimmed text, missing fund to ``U``, numeric amounts."""
    out = df
    for name in text:
        if name in df.columns:
            out = out.withColumn(
                name, F.trim(F.replace(F.col(name), F.lit("\n"), F.lit(" "))))
    if fund in df.columns:
        out = out.withColumn(fund, F.trim(F.coalesce(F.col(fund), F.lit("U"))))
    if amount in df.columns:
        out = out.withColumn(amount, F.col(amount).try_cast(MONEY))
    return out


def year_from_source(df, path, default, column="fiscal_year"):
    """Year from the column, else from the file name, else a default."""
    from_name = F.nullif(F.regexp_extract(path, r"(20\d{2})", 1), F.lit("")).cast("int")
    own = F.col(column).cast("int") if column in df.columns else F.lit(None).cast("int")
    return df.withColumn(column, F.coalesce(own, from_name, F.lit(default)))


def large_amounts(df, threshold=100_000_000, value="amount", tiebreak=()):
    return df.where(F.col(value) > threshold).orderBy(F.desc(value), *tiebreak)


def positive_amounts(df, value="amount"):
    return df.where(F.col(value) > 0)


def search_programs(df, text=None, fund=None, section=None, prefix=None):
    """Rows whose program name or id holds the text and that pass the filters."""
    out = df
    if text:
        needle = F.lit(text.lower())
        out = out.where(
            F.lower(F.col("program_name")).contains(needle)
            | F.lower(F.col("program_id")).contains(needle))
    if fund:
        out = out.where(F.col("fund_type") == fund)
    if section:
        out = out.where(F.col("section") == section)
    if prefix:
        out = out.where(F.col("program_id").startswith(prefix))
    return out


def top_rows(df, order, k=None):
    """Rows in report order; with ``k`` only the first (sorted per task, then merged)."""
    ordered = df.orderBy(*order)
    return ordered if k is None else ordered.limit(k)


def change_filter(df, kind, before="before", after="after"):
    """Increases, decreases, new (0 to positive) or removed (positive to 0)."""
    a, b = F.coalesce(F.col(before), F.lit(0)), F.coalesce(F.col(after), F.lit(0))
    rules = {
        "increases": b > a,
        "decreases": b < a,
        "new": (a == 0) & (b > 0),
        "removed": (a > 0) & (b == 0),
        "all": F.lit(True),
    }
    return df.where(rules[kind])


def draft_filter(df, sections=None, funds=None, change_types=None, text=None,
                 text_columns=("program_id", "program_name", "department_code")):
    out = df
    for values, column in ((sections, "section"), (funds, "fund_category"),
                           (change_types, "change_type")):
        if values:
            out = out.where(F.col(column).isin(list(values)))
    if text:
        joined = F.lower(F.concat_ws("\n", *text_columns))
        out = out.where(joined.contains(text.lower()))
    return out


def exclude_names(df, names, column="department_code", pattern=r"(?i)total"):
    """Drop listed names and any that look like totals or sub-accounts."""
    keep = ~F.coalesce(F.col(column).isin(list(names)), F.lit(False))
    if pattern:
        keep = keep & ~F.coalesce(F.col(column).rlike(pattern), F.lit(False))
    return df.where(keep)


def scope_rows(df, bills, keys, scope="scope"):
    """Keep the sections a bill is scoped to; grants never count.

    ``operating`` keeps operating rows, ``capital`` capital rows, ``combined``
    both.
    """
    joined = df.join(bills.select(*keys, scope), list(keys))
    section = F.col("section")
    allowed = (
        F.when(F.col(scope) == "operating", section == OPERATING)
        .when(F.col(scope) == "capital", section == CAPITAL)
        .otherwise(F.lit(True))
    )
    return joined.where(allowed & (section != GRANTS))


def append_fixed_rows(df, rows, schema):
    """Append a fixed list of rows (branches outside the main bill)."""
    extra = df.sparkSession.createDataFrame(rows, schema)
    return df.unionByName(extra, allowMissingColumns=True)


def display_name(df, names, code="department_code", name="display_name", out="display_name"):
    """Join a name table, falling back to the code."""
    side = names.select(F.col(code), F.col(name).alias("__name"))
    return df.join(side, code, "left").withColumn(
        out, F.coalesce(F.col("__name"), F.col(code))).drop("__name")


def override_fund(df, fund_map, key="program_id", fund="fund_type"):
    """Replace the fund of mapped programs; others keep theirs."""
    side = fund_map.select(F.col(key), F.col(fund).alias("__fund"))
    return df.join(side, key, "left").withColumn(
        fund, F.coalesce(F.col("__fund"), F.col(fund))).drop("__fund")


def with_provenance(df, **labels):
    return df.select("*", *[F.lit(v).alias(k) for k, v in labels.items()])


def option_list(df, column):
    """Distinct non-empty values, sorted."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != "")).select(
        column).distinct().orderBy(column)


def foreign_programs(df, owner="department_code", program="program_id"):
    """Programs whose id prefix is not the owning department."""
    return df.where(F.substring(program, 1, 3) != F.substring(owner, 1, 3))


STAGES = ["baseline", "hd1", "sd1", "cd1"]


def stage_columns(active, prefix="amount_"):
    """Leftmost and rightmost active stage; enacted equals the last draft."""
    order = [s for s in STAGES if s in active]
    first = order[0] if order else "cd1"
    last = "cd1" if "enacted" in active else (order[-1] if order else "baseline")
    return prefix + first, prefix + last


def category_rank(category, order):
    """Position in a custom order; unlisted values go last."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), category)
    return F.when(place == 0, F.lit(len(order) + 1)).otherwise(place)


def by_category_order(df, order, category="category", then=("program_id",)):
    return df.orderBy(category_rank(F.col(category), order), *then)


def special_first(df, special, total="total", column="department_code"):
    is_special = F.col(column).isin(list(special))
    return df.withColumn("is_special", is_special).orderBy(
        F.desc("is_special"), F.desc(total), column)


def mixed_order_key(identifier):
    """Numeric ids first by value, other ids after them by text."""
    number = identifier.try_cast("double")
    return [number.isNull(), number.asc_nulls_last(), identifier]


def user_sort(df, column, descending=False, text=False, tiebreak=()):
    key = F.lower(F.col(column)) if text else F.col(column)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), *tiebreak)


def group_then_row_order(df, group, value, tiebreak):
    """Groups by their total, then rows by value inside the group.

    The group total comes from an aggregate, so only the final sort moves rows.
    """
    totals = df.groupBy(group).agg(F.sum(value).alias("group_total"))
    return null_safe_join(df, totals, [group]).orderBy(
        F.desc("group_total"), group, F.desc(value), *tiebreak)


def union_by_name(*frames):
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def key_sets(a, b, keys):
    """Every key of either side with the side it comes from."""
    left = a.select(*keys).distinct().withColumn("__a", F.lit(1))
    right = b.select(*keys).distinct().withColumn("__b", F.lit(1))
    joined = left.join(right, list(keys), "full_outer")
    side = (
        F.when(F.col("__b").isNull(), F.lit("only_a"))
        .when(F.col("__a").isNull(), F.lit("only_b"))
        .otherwise(F.lit("both"))
    )
    return joined.select(*keys, side.alias("side"))


def missing_keys(required, available, keys):
    return required.select(*keys).distinct().join(
        available.select(*keys).distinct(), list(keys), "left_anti")


def replace_rows(df, replacement, keys):
    """Drop the rows of the keys present in the replacement, then append it."""
    dropped = replacement.select(*keys).distinct()
    return df.join(dropped, list(keys), "left_anti").unionByName(
        replacement, allowMissingColumns=True)


def mark_duplicates(df, columns=None, out="is_duplicate"):
    """Flag every copy of rows repeated on the columns (all when none given)."""
    columns = list(columns or df.columns)
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__copies"))
    return null_safe_join(df, counts, columns).withColumn(
        out, F.col("__copies") > 1).drop("__copies")


def best_source(df, keys, rank):
    """Rows of the best-ranked source per key (all of that source's rows)."""
    best = df.groupBy(*keys).agg(F.min(rank).alias("__best"))
    return df.join(best, list(keys)).where(F.col(rank) == F.col("__best")).drop("__best")


def previous_by_year(df, keys, year, value, out):
    """Value of the year before, by join, so that gaps stay gaps."""
    side = df.select(*keys, (F.col(year) + 1).alias(year), F.col(value).alias(out))
    return df.join(side, [*keys, year], "left")


def year_over_year(df, keys, year, value, out="yoy_pct"):
    """Percentage change from the preceding listed year; NULL first or from 0.

    Runs on a yearly series: one row per key and year.
    """
    w = W.partitionBy(*keys).orderBy(year)
    before = F.lag(value).over(w)
    return df.withColumn(
        out,
        (F.col(value).cast("double") - before.cast("double"))
        / F.nullif(before, F.lit(0)).cast("double") * 100,
    )
