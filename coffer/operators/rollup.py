"""Aggregations of allocation rows.

Each operator is one grouped aggregate (partial sums are built in the map
tasks), or a few over the already aggregated result.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import currency_label, fund_group
from ..schema import CAPITAL, ONE_TIME, OPERATING
from .ordered import exact_median, null_safe_join
from .shares import percent, total_of

def sum_if(condition, value="amount"):
    """Conditional sum, 0 when nothing matches."""
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0).cast("decimal(28,2)"))


def sum_section(section, value="amount"):
    return sum_if(F.col("section") == section, value)


def aggregate_by(df, columns, value="amount"):
    """Sum per group with its share of the grand total; NULL groups stay."""
    missing = [c for c in [*columns, value] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    sums = df.groupBy(*columns).agg(F.coalesce(F.sum(value), F.lit(0)).alias(value))
    whole = total_of(df, value)
    share = F.when(whole > 0, F.col(value).cast("double") / whole.cast("double") * 100)
    return sums.withColumn("pct_of_total", F.coalesce(share, F.lit(0.0)))


def summary_stats(df, value="amount", keys=()):
    """Sum, count, mean, exact median; ungrouped also spread and zero counts."""
    keys = list(keys)
    v = F.col(value)
    basic = [
        F.coalesce(F.sum(value), F.lit(0)).alias("total"),
        F.count(value).alias("count"),
        (F.sum(value).cast("double") / F.nullif(F.count(value), F.lit(0))).alias("mean"),
    ]
    if not keys:
        basic += [
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.stddev_samp(v.cast("double")).alias("std"),
            F.count_if(v != 0).alias("non_zero_count"),
            F.count_if(v == 0).alias("zero_count"),
        ]
    stats = df.groupBy(*keys).agg(*basic) if keys else df.agg(*basic)
    median = exact_median(df, keys, value)
    if keys:
        return null_safe_join(stats, median, keys)
    return stats.withColumn("median", median.scalar())


def department_rollup(df, keys=("department_code",), descriptions=None):
    """Operating, capital, one-time, positions and total per department."""
    # Numeric sums per name first: they hash-aggregate in the map tasks, while a
    # string minimum would sort every row there. The few names follow.
    sums = ["operating_budget", "capital_budget", "one_time_appropriations", "positions"]
    by_name = df.where(F.col("department_code").isNotNull()).groupBy(
        *keys, "department_name").agg(
        sum_section(OPERATING).alias("operating_budget"),
        sum_section(CAPITAL).alias("capital_budget"),
        sum_section(ONE_TIME).alias("one_time_appropriations"),
        F.coalesce(F.sum("positions"), F.lit(0)).alias("positions"),
    )
    out = by_name.groupBy(*keys).agg(
        F.min("department_name").alias("name"), *[F.sum(c).alias(c) for c in sums])
    total = (
        F.col("operating_budget") + F.col("capital_budget") + F.col("one_time_appropriations")
    )
    out = out.withColumn("total_budget", total)
    label = F.when(
        F.col("total_budget") >= 10**9, currency_label(F.col("total_budget"), "brief")
    ).otherwise(
        F.format_string("$%.0fM", F.bround(
            F.col("total_budget").cast("decimal(28,8)") / F.lit(10**6), 0).cast("double")))
    out = out.withColumn("budget", label).withColumn("id", F.lower("department_code"))
    if descriptions is not None:
        out = out.join(descriptions.select("department_code", "description"),
                       "department_code", "left")
        out = out.withColumn("description", F.coalesce("description", F.lit("")))
    return out


def fund_breakdown(df, keys, fund="fund_category", value="amount", drop_zero=False):
    out = df.groupBy(*keys, fund).agg(F.sum(value).alias(value))
    return out.where(F.col(value) != 0) if drop_zero else out


PROGRAM_KEYS = ["department_code", "program_id", "program_name", "section", "fund_type",
                "fund_category"]


def program_rollup(df, keys=PROGRAM_KEYS):
    """Amount and positions per program row; all-NULL positions stay NULL."""
    complete = df
    for k in keys:
        complete = complete.where(F.col(k).isNotNull())
    return complete.groupBy(*keys).agg(
        F.sum("amount").alias("amount"), F.sum("positions").alias("positions"))


def summary_row(df, keys=()):
    aggs = [
        F.coalesce(F.sum("amount"), F.lit(0)).alias("total_budget"),
        sum_section(OPERATING).alias("operating_budget"),
        sum_section(CAPITAL).alias("capital_budget"),
        sum_section(ONE_TIME).alias("one_time_appropriations"),
        F.coalesce(F.sum("positions"), F.lit(0)).alias("total_positions"),
        F.countDistinct("department_code").alias("num_departments"),
        F.countDistinct("program_id").alias("num_programs"),
        F.count(F.lit(1)).alias("num_records"),
    ]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def cross_tab(df, rows, column, values, value="amount"):
    """Sums of a fixed list of column values, one column each, plus a total."""
    return df.groupBy(*rows).agg(
        *[sum_if(F.col(column) == v, value).alias(str(v)) for v in values],
        F.coalesce(F.sum(value), F.lit(0)).alias("total"),
    )


def year_totals(df):
    """Total, operating and capital (by section text) with shares per year."""
    text = F.lower("section")
    out = df.groupBy("fiscal_year").agg(
        F.sum("amount").alias("total"),
        sum_if(text.contains("operating")).alias("operating"),
        sum_if(text.contains("capital")).alias("capital"),
    )
    return out.withColumn("operating_pct", percent(F.col("operating"), F.col("total"))).withColumn(
        "capital_pct", percent(F.col("capital"), F.col("total")))


def value_distribution(df, column):
    """Counts and shares of every value, with NULL and empty named."""
    shown = F.when(F.col(column).isNull(), F.lit("(null)")).when(
        F.col(column) == "", F.lit("(empty)")).otherwise(F.col(column))
    counts = df.groupBy(shown.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    whole = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumn("pct", percent(F.col("n"), whole))


def fund_profile(df):
    return df.groupBy("fund_type", "fund_category").agg(
        F.count("amount").alias("n"),
        F.sum("amount").alias("total"),
        (F.sum("amount").cast("double") / F.count("amount")).alias("mean"),
    )


def department_profile(df):
    return df.groupBy("department_code").agg(
        F.countDistinct("program_id").alias("programs"),
        F.count("amount").alias("n"),
        F.sum("amount").alias("total"),
    )


def county_operating(df):
    """Department, program and fund levels of operating rows in one pass.

    ``level`` 0 is the county total, 1 department, 2 program, 3 fund.
    """
    program = F.coalesce(F.col("program_name"), F.lit("(department-wide)"))
    op = df.where(F.col("section") == OPERATING).withColumn("program_name", program)
    levels = op.rollup("department_code", "program_name", "fund_category").agg(
        F.sum("amount").alias("amount"), F.grouping_id().alias("__gid"))
    level = F.when(F.col("__gid") == 7, 0).when(F.col("__gid") == 3, 1).when(
        F.col("__gid") == 1, 2).otherwise(3)
    return levels.select("department_code", "program_name", "fund_category", "amount",
                         level.alias("level"))


def county_capital(df):
    """Function, project and primary fund of capital rows.

    The primary fund is the largest by absolute amount, ties by name. Empty
    when the capital total is 0.
    """
    cap = df.where(F.col("section") == CAPITAL).withColumn(
        "program_name", F.coalesce(F.col("program_name"), F.lit("(unnamed project)")))
    funds = cap.groupBy("department_name", "program_name", "fund_category").agg(
        F.sum("amount").alias("amount"))
    projects = funds.groupBy("department_name", "program_name").agg(
        F.sum("amount").alias("total_budget"),
        F.min_by("fund_category", F.when(
            F.col("amount") != 0, F.struct(-F.abs("amount"), F.col("fund_category")))
        ).alias("primary_fund"),
        F.count_if(F.col("amount") != 0).alias("num_funds"),
    )
    return projects.where(total_of(cap, "amount") != 0)


def county_entry(df, grid, keys=("county", "fiscal_year")):
    """Totals for the full county and year grid, flagged when no rows exist."""
    keys = list(keys)
    sums = df.groupBy(*keys).agg(
        F.sum("amount").alias("total"), sum_section(OPERATING).alias("operating"),
        sum_section(CAPITAL).alias("capital"))
    return grid.join(sums, keys, "left").select(
        *keys,
        F.col("total").isNotNull().alias("available"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total", "operating", "capital")],
    )


def means_of_finance(df, groups, default="Other Funds"):
    """Operating amounts per group of fund letters."""
    op = df.where(F.col("section") == OPERATING)
    return op.groupBy(fund_group(F.col("fund_type"), groups, default).alias("fund_group")).agg(
        F.sum("amount").alias("amount"))


def capital_groups(df, main, other="All Others"):
    """Capital amounts of the named categories (renamed by the map), rest other."""
    cap = df.where(F.col("section") == CAPITAL)
    named = F.trim(F.coalesce(F.col("category"), F.lit("Uncategorized")))
    group = fund_group(named, main, other)
    return cap.groupBy(group.alias("category")).agg(F.sum("amount").alias("amount")).where(
        F.col("amount") > 0)


def department_years(df, first, second):
    out = df.groupBy("department_code", "department_name").agg(
        sum_if(F.col("fiscal_year") == first).alias("fy1"),
        sum_if(F.col("fiscal_year") == second).alias("fy2"),
    )
    return out.withColumn("delta", F.col("fy2") - F.col("fy1")).withColumn(
        "pct_change", percent(F.col("delta"), F.col("fy1"), 1))


def fund_matrix(df, letters):
    return cross_tab(df, ["department_name"], "fund_type", letters)


def fund_order(df):
    """Fund letters by descending total, as a rank column."""
    sums = df.groupBy("fund_type").agg(F.sum("amount").alias("amount"))
    return sums.withColumn(
        "fund_rank", F.row_number().over(
            W.partitionBy(F.lit(0)).orderBy(F.desc("amount"), "fund_type")))


def chart_departments(df, names, excluded, special_names, special_rows):
    """Department bars: section sums in billions, exclusions, fixed rows.

    ``names`` maps code to display name; codes without a name drop out.
    """
    sums = df.groupBy("department_code").agg(
        sum_section(OPERATING).alias("op"), sum_section(CAPITAL).alias("cap"),
        sum_section(ONE_TIME).alias("one"))
    named = sums.join(names.select("department_code", "display_name"), "department_code")
    kept = named.where(
        ~F.col("display_name").isin(list(excluded) + list(special_names))
        & ~F.col("display_name").rlike("(?i)total|subaccount"))
    billions = [(F.col(c).cast("double") / 1e9).alias(f"{c}_b") for c in ("op", "cap", "one")]
    regular = kept.select("display_name", *billions, F.lit(False).alias("is_special"))
    fixed = df.sparkSession.createDataFrame(
        special_rows, "display_name string, op_b double, cap_b double, one_b double"
    ).withColumn("is_special", F.lit(True))
    both = regular.unionByName(fixed)
    return both.withColumn("total_b", F.col("op_b") + F.col("cap_b") + F.col("one_b"))


def department_summary(df, groups):
    """Operating by four fund groups, one-time, capital and total.

    The total is operating + capital + one-time; letters outside the mapping
    count as other funds.
    """
    group = fund_group(F.col("fund_type"), groups)
    op = F.col("section") == OPERATING
    out = df.groupBy("department_code").agg(
        sum_if(op & (group == "General Funds")).alias("general"),
        sum_if(op & (group == "Special Funds")).alias("special"),
        sum_if(op & (group == "Federal Funds")).alias("federal"),
        sum_if(op & (group == "Other Funds")).alias("other"),
        sum_section(ONE_TIME).alias("one_time"),
        sum_section(CAPITAL).alias("capital"),
        sum_section(OPERATING).alias("operating"),
    )
    return out.withColumn("total", F.col("operating") + F.col("capital") + F.col("one_time"))


def index_table(df):
    """Department index in millions, plus a grand-total row."""
    def millions(c):
        return (F.col(c).cast("double") / 1e6).alias(c)

    cube = df.rollup("department_code").agg(
        F.sum("amount").alias("total"), sum_section(OPERATING).alias("operating"),
        sum_section(CAPITAL).alias("capital"), sum_section(ONE_TIME).alias("one_time"),
        F.grouping("department_code").alias("g"))
    return cube.select(
        F.when(F.col("g") == 1, F.lit("(all)")).otherwise(F.col("department_code")).alias(
            "department_code"),
        *[millions(c) for c in ("total", "operating", "capital", "one_time")])


def report_figures(df, county_codes, main, groups, fund="fund_type"):
    """The three figures of the yearly report as (figure, label, amount) rows.

    County rows leave the department figure; their capital joins the other
    capital group.
    """
    is_county = F.coalesce(F.col("department_code").isin(list(county_codes)), F.lit(False))
    slim = df.withColumn("is_county", is_county).groupBy(
        "is_county", "department_code", "section", "category", fund).agg(
        F.sum("amount").alias("amount"))
    own = slim.where(~F.col("is_county"))
    capital = F.col("section") == CAPITAL
    departments = own.where(F.col("section").isin(OPERATING, CAPITAL)).select(
        F.concat_ws(":", F.when(capital, F.lit("capital")).otherwise(F.lit("operating")),
                    F.col("department_code")).alias("label"),
        F.lit("departments").alias("figure"), "amount")
    finance = own.where(F.col("section") == OPERATING).select(
        fund_group(F.col(fund), groups).alias("label"),
        F.lit("means_of_finance").alias("figure"), "amount")
    group = F.when(F.col("is_county"), F.lit("All Others")).otherwise(
        fund_group(F.col("category"), main, "All Others"))
    cip = slim.where(capital).select(
        group.alias("label"), F.lit("capital").alias("figure"), "amount")
    return departments.unionByName(finance).unionByName(cip).groupBy("figure", "label").agg(
        F.sum("amount").alias("amount"))


def branch_table(df, branch="branch"):
    """Branches by kind of money, with a total per branch and overall."""
    out = df.rollup(branch).agg(
        sum_section(OPERATING).alias("operating"), sum_section(CAPITAL).alias("capital"),
        sum_section(ONE_TIME).alias("one_time"), F.grouping(branch).alias("g"))
    total = F.col("operating") + F.col("capital") + F.col("one_time")
    return out.select(
        F.when(F.col("g") == 1, F.lit("(all)")).otherwise(F.col(branch)).alias("branch"),
        "operating", "capital", "one_time", total.alias("total"))


def revenue_shares(df, named, source="source", value="amount", rest="All Other Taxes"):
    """Named sources, the remainder, and shares of the whole."""
    label = F.when(F.col(source).isin(list(named)), F.col(source)).otherwise(F.lit(rest))
    sums = df.groupBy(label.alias("source")).agg(F.sum(value).alias("amount"))
    return sums.withColumn("pct", percent(F.col("amount"), total_of(df, value), 1))


def positions_once(df, keys, program="program_id", positions="positions"):
    """Positions repeat on every fund row: max per program, then the sum."""
    per_program = df.groupBy(*keys, program).agg(F.max(positions).alias("positions"))
    return per_program.groupBy(*keys).agg(F.sum("positions").alias("positions"))


def stage_totals(df, stages, first, last):
    """Sums per section for every stage, and the change last minus first."""
    out = df.groupBy("section").agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in stages])
    return out.withColumn("delta", F.col(last) - F.col(first))


def draft_programs(df, d1="d1", d2="d2"):
    """Per department and program: stage sums, funds, sections, change type."""
    def zero(c):
        return F.coalesce(F.sum(c), F.lit(0))

    out = df.groupBy("department_code", "program_id").agg(
        zero(d1).alias("d1"), zero(d2).alias("d2"),
        F.array_sort(F.collect_set("fund_category")).alias("__funds"),
        F.array_sort(F.collect_set("section")).alias("__sections"),
        F.max("positions").alias("positions"),
        F.bool_or(F.col("change_type") == "added").alias("any_added"),
        F.bool_or(F.col("change_type") == "removed").alias("any_removed"),
    )
    change = F.col("d2") - F.col("d1")
    pct = F.when(
        F.col("d1") != 0, change.cast("double") / F.abs("d1").cast("double") * 100
    ).otherwise(F.when(change != 0, F.lit(100.0)).otherwise(F.lit(0.0)))
    return out.select(
        "department_code", "program_id", "d1", "d2", change.alias("change"),
        pct.alias("pct_change"),
        F.array_join("__funds", " | ").alias("funds"),
        F.when(F.size("__sections") > 1, F.lit("Mixed")).otherwise(
            F.coalesce(F.try_element_at("__sections", F.lit(1)), F.lit(""))).alias("section"),
        "positions",
        F.when(F.col("any_added") & (F.col("d1") == 0), F.lit("added"))
        .when(F.col("any_removed") & (F.col("d2") == 0), F.lit("removed"))
        .otherwise(F.lit("modified")).alias("change_type"),
    )


def fund_stage_groups(df, d1="d1", d2="d2"):
    """Stage sums per fund with the gross change, and a grand-total row."""
    out = df.rollup("fund_type").agg(
        F.coalesce(F.sum(d1), F.lit(0)).alias("d1"), F.coalesce(F.sum(d2), F.lit(0)).alias("d2"),
        F.coalesce(F.sum(F.abs("change")), F.lit(0)).alias("gross_change"),
        F.count(F.lit(1)).alias("n"), F.grouping("fund_type").alias("g"))
    return out.select(
        F.when(F.col("g") == 1, F.lit("(all)")).otherwise(
            F.coalesce("fund_type", F.lit("?"))).alias("fund_type"),
        "d1", "d2", (F.col("d2") - F.col("d1")).alias("delta"), "gross_change", "n")


def change_summary(df, before="before", after="after"):
    """Counts of change kinds with totals and the net change."""
    a, b = F.coalesce(F.col(before), F.lit(0)), F.coalesce(F.col(after), F.lit(0))
    return df.agg(
        F.count_if(b > a).alias("increased"),
        F.count_if(b < a).alias("decreased"),
        F.count_if(F.col("change_type") == "added").alias("added"),
        F.count_if(F.col("change_type") == "removed").alias("removed"),
        F.count_if(F.col("change_type") == "modified").alias("modified"),
        F.coalesce(F.sum(a), F.lit(0)).alias("total_before"),
        F.coalesce(F.sum(b), F.lit(0)).alias("total_after"),
        F.coalesce(F.sum(b - a), F.lit(0)).alias("net_change"),
    )


def program_cards(df):
    """Program totals with their share of the department."""
    cards = df.groupBy("department_code", "program_id").agg(
        F.coalesce(F.sum("amount"), F.lit(0)).alias("total"),
        sum_section(OPERATING).alias("operating"), sum_section(CAPITAL).alias("capital"),
        F.sum(F.when(F.col("positions") != 0, F.col("positions"))).alias("positions"),
        sum_if(F.col("section").isin(OPERATING, CAPITAL, ONE_TIME)).alias("__counted"))
    sums = cards.groupBy("department_code").agg(F.sum("__counted").alias("__dept"))
    return null_safe_join(cards.drop("__counted"), sums, ["department_code"]).withColumn(
        "share_pct", percent(F.col("total"), F.col("__dept"), 2, when_zero=0)).drop("__dept")


def general_fund_tree(df, value="amount"):
    """Non-zero general-fund rows: grand, department and program totals."""
    rows = df.where(
        (F.col("fund_category") == "General Funds") & (F.coalesce(F.col(value), F.lit(0)) != 0)
        & F.col("department_code").isNotNull())
    rows = rows.withColumn("program_id", F.coalesce("program_id", F.lit("UNKNOWN")))
    levels = rows.rollup("department_code", "program_id").agg(
        F.sum(value).alias("amount"), F.grouping_id().alias("gid"))
    return levels.select(
        "department_code", "program_id", "amount",
        F.when(F.col("gid") == 3, 0).when(F.col("gid") == 1, 1).otherwise(2).alias("level"))


def tax_share(df, tax, value="amount", minimum=0.01):
    """A taxpayer's dollars per department; those under 1 % fold into ``more``."""
    sums = df.groupBy("department_code").agg(F.sum(value).alias("total"))
    whole = total_of(df, value)
    share = F.col("total").cast("double") / F.nullif(whole, F.lit(0)).cast("double")
    folded = sums.withColumn("share", F.coalesce(share, F.lit(0.0))).withColumn(
        "department", F.when(F.col("share") >= minimum, F.col("department_code")).otherwise(
            F.lit("more")))
    return folded.groupBy("department").agg(
        F.sum("total").alias("total"), F.count(F.lit(1)).alias("departments")
    ).withColumn(
        "your_dollars",
        F.bround(F.coalesce(F.lit(float(tax)) * F.col("total").cast("double")
                            / F.nullif(whole, F.lit(0)).cast("double"), F.lit(0.0)), 2))


def top_n_other(df, keys, item, value, n, other="Other"):
    """The n largest items per group and one row for the rest with its count.

    The cut-off comes from a trimmed top list, so no group is ranked whole.
    """
    sums = df.groupBy(*keys, item).agg(F.sum(value).alias("amount"))
    w = W.partitionBy(*keys).orderBy(F.desc("amount"), item)
    top = sums.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    marks = top.select(*keys, F.col(item), F.lit(True).alias("__top"))
    label = F.when(F.col("__top"), F.col(item)).otherwise(F.lit(other))
    joined = null_safe_join(sums, marks, [*keys, item])
    return joined.groupBy(*keys, label.alias("item")).agg(
        F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n_items"))


def bands(df, mapping, year="fiscal_year", category="category", value="amount"):
    """Categories folded into display bands per year."""
    band = fund_group(F.col(category), mapping, "Unmapped")
    return df.groupBy(year, band.alias("band")).agg(F.sum(value).alias("amount"))


def stacked(df, order, year="fiscal_year", band="band", value="amount"):
    """Cumulative top of every band per year, in the given band order."""
    listed = F.array_position(F.array(*[F.lit(b) for b in order]), F.col(band))
    place = F.when(listed > 0, listed).otherwise(F.lit(len(order) + 1))  # bands not listed come last
    w = W.partitionBy(year).orderBy(place).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("top", F.sum(value).over(w))


def actuals_variance(df, keys=("department_code",)):
    """Original, final and actual sums with variance and share spent."""
    out = df.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("original", "final", "actual")])
    out = out.withColumn("variance", F.col("final") - F.col("actual"))
    return out.withColumn(
        "pct_variance", percent(F.col("variance"), F.col("final"))).withColumn(
        "pct_spent", percent(F.col("actual"), F.col("final"), 1))


def bill_log(df, keys=("fiscal_year", "bill", "section")):
    """Rows and totals per bill, year and section, with every subtotal."""
    keys = list(keys)
    return df.rollup(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("amount").alias("amount"),
        F.grouping_id().alias("level"))


def program_once(df, value="request_total", group="department_code"):
    """A program's repeated total counted once, then summed per department."""
    once = df.groupBy("program_id").agg(
        F.min(group).alias(group), F.max(value).alias(value))
    return once.groupBy(group).agg(F.sum(value).alias(value))


def net_long(df, keys, kind="kind", value="amount"):
    """Revenue, expenditure and net rows in long form."""
    wide = df.groupBy(*keys).agg(
        sum_if(F.col(kind) == "revenue", value).alias("revenue"),
        sum_if(F.col(kind) == "expenditure", value).alias("expenditure"))
    wide = wide.withColumn("net", F.col("revenue") - F.col("expenditure"))
    return wide.unpivot(
        list(keys), ["revenue", "expenditure", "net"], "measure", "amount")
