"""Comparisons of two versions, updates by key, and source resolution."""

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import is_close
from ..schema import CAPITAL, OPERATING
from .ordered import null_safe_join
from .rollup import sum_if

DRAFT_KEYS = ["program_id", "department_code", "fund_type", "fund_category", "section", "category"]


def _zero(name):
    return F.coalesce(F.col(name), F.lit(0))


def add_change(df, before="before", after="after", has_before=None, has_after=None):
    """Change (missing is 0), percentage (NULL unless both sides), change type."""
    has_before = F.col(before).isNotNull() if has_before is None else has_before
    has_after = F.col(after).isNotNull() if has_after is None else has_after
    a, b = F.col(before), F.col(after)
    pct = (b.cast("double") - a.cast("double")) / F.nullif(a, F.lit(0)).cast("double") * 100
    kind = F.when(~has_after, F.lit("removed")).when(~has_before, F.lit("added")).otherwise(
        F.lit("modified"))
    return df.withColumn("change", _zero(after) - _zero(before)).withColumn(
        "pct_change", pct).withColumn("change_type", kind)


def compare(before, after, keys, value="amount", pre_aggregate=True):
    """Two versions side by side per key; NULL keys match NULL keys.

    Aggregated form: both sides are stacked and summed in one grouping, so
    there is no join and partial sums are built before the shuffle. The raw
    form joins row by row and fans out on repeated keys.
    """
    missing = [c for c in [*keys, value] if c not in before.columns or c not in after.columns]
    if missing:
        raise ValueError(f"columns must exist on both sides: {missing}")
    if pre_aggregate:
        stacked = before.select(*keys, F.col(value).alias("__v"), F.lit(0).alias("__s")).unionByName(
            after.select(*keys, F.col(value).alias("__v"), F.lit(1).alias("__s")))
        sums = stacked.groupBy(*keys).agg(
            F.count_if(F.col("__s") == 0).alias("__n0"),
            F.count_if(F.col("__s") == 1).alias("__n1"),
            F.sum(F.when(F.col("__s") == 0, F.col("__v"))).alias("__b"),
            F.sum(F.when(F.col("__s") == 1, F.col("__v"))).alias("__a"),
        )
        has_before, has_after = F.col("__n0") > 0, F.col("__n1") > 0
        sides = sums.withColumn("before", F.when(has_before, _zero("__b"))).withColumn(
            "after", F.when(has_after, _zero("__a")))
    else:
        left = before.select(*keys, F.col(value).alias("before"), F.lit(1).alias("__n0"))
        right = after.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                             F.col(value).alias("after"), F.lit(1).alias("__n1"))
        on = reduce(lambda x, y: x & y,
                    [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
        has_before, has_after = F.col("__n0").isNotNull(), F.col("__n1").isNotNull()
        sides = left.join(right, on, "full_outer").withColumns(
            {k: F.when(has_before, F.col(k)).otherwise(F.col(f"__r_{k}")) for k in keys})
    out = add_change(sides, has_before=has_before, has_after=has_after)
    return out.select(*keys, "before", "after", "change", "pct_change", "change_type")


YEAR_KEYS = ["program_id", "program_name", "department_code", "department_name", "section",
             "fund_type", "fund_category", "category"]


def compare_years(df, first, second, keys=YEAR_KEYS, value="amount", year="fiscal_year",
                  pre_aggregate=True):
    """One year against another; missing is 0, rounded percentage."""
    keys = [k for k in keys if k in df.columns]
    if pre_aggregate:
        both = df.where(F.col(year).isin(first, second)).groupBy(*keys).agg(
            sum_if(F.col(year) == first, value).alias("fy1"),
            sum_if(F.col(year) == second, value).alias("fy2"))
    else:
        raw = compare(df.where(F.col(year) == first), df.where(F.col(year) == second), keys, value,
                      pre_aggregate=False)
        both = raw.select(*keys, _zero("before").alias("fy1"), _zero("after").alias("fy2"))
    delta = F.col("fy2") - F.col("fy1")
    pct = F.bround(
        delta.cast("double") / F.nullif(F.col("fy1"), F.lit(0)).cast("double") * 100, 2)
    return both.withColumn("delta", delta).withColumn("pct_change", pct)


def veto_impact(before, after, keys, value="amount"):
    """Keys whose amount an amendment changed."""
    return compare(before, after, keys, value).where(F.col("change") != 0)


def _last_change(changes, keys, order):
    return changes.groupBy(*keys).agg(
        F.max_by(F.struct("new_amount", "new_notes"), F.struct(*order)).alias("__c"))


def apply_changes(df, changes, order, match_section=False):
    """Set the amount (and notes) of rows matching program, year and fund.

    Every matching row takes the full new amount; of several changes to one
    key the last wins. ``changes`` has program_id, fiscal_year, fund_type,
    amount, notes and the ``order`` columns.
    """
    keys = ["program_id", "fiscal_year", "fund_type"] + (["section"] if match_section else [])
    renamed = changes.withColumnRenamed("amount", "new_amount").withColumnRenamed(
        "notes", "new_notes").withColumn(
        "fund_type", F.coalesce("fund_type", F.lit("A")))
    last = _last_change(renamed, keys, order)
    joined = df.join(last, keys, "left")
    hit = F.col("__c").isNotNull()
    out = joined.withColumn("amount", F.when(hit, F.col("__c.new_amount")).otherwise(
        F.col("amount")).cast("decimal(18,2)"))
    old_notes = F.col("notes") if "notes" in df.columns else F.lit(None).cast("string")
    return out.withColumn(
        "notes", F.when(hit, F.col("__c.new_notes")).otherwise(old_notes)
    ).withColumn("changed", hit).drop("__c")


def unmatched_changes(df, changes):
    keys = ["program_id", "fiscal_year", "fund_type"]
    return changes.join(df.select(*keys).distinct(), keys, "left_anti")


def compare_drafts(before, after, keys=DRAFT_KEYS, order="line_number"):
    """Two drafts on the identity keys with names and once-counted positions.

    Names come from the newer draft where present, first by document order
    (a number; ties by name). Positions repeat on fund rows: the maximum per
    program is attached. Sums and first places per name are numeric and
    hash-aggregate; only the distinct names go on to the second grouping.
    """
    stacked = before.withColumn("__s", F.lit(0)).unionByName(after.withColumn("__s", F.lit(1)))
    named = stacked.groupBy(*keys, "__s", "program_name", "department_name").agg(
        F.sum("amount").alias("__v"), F.min(order).alias("__o"))
    first, second = F.col("__s") == 0, F.col("__s") == 1

    def name(side, column):
        return F.min_by(column, F.when(
            (F.col("__s") == side) & F.col(column).isNotNull(), F.struct("__o", column)))

    sums = named.groupBy(*keys).agg(
        F.count_if(first).alias("__n0"), F.count_if(second).alias("__n1"),
        F.sum(F.when(first, F.col("__v"))).alias("__b"),
        F.sum(F.when(second, F.col("__v"))).alias("__a"),
        F.coalesce(name(1, "program_name"), name(0, "program_name")).alias("program_name"),
        F.coalesce(name(1, "department_name"), name(0, "department_name")).alias(
            "department_name"))
    has_before, has_after = F.col("__n0") > 0, F.col("__n1") > 0
    sides = sums.withColumn("before", F.when(has_before, _zero("__b"))).withColumn(
        "after", F.when(has_after, _zero("__a")))
    out = add_change(sides, has_before=has_before, has_after=has_after)
    positions = stacked.groupBy("program_id").agg(
        F.max(F.when(first, F.col("positions"))).alias("positions_before"),
        F.max(F.when(second, F.col("positions"))).alias("positions_after"))
    return null_safe_join(out, positions, ["program_id"]).select(
        *keys, "program_name", "department_name", "before", "after", "change", "pct_change",
        "change_type", "positions_before", "positions_after")


def compare_projects(before, after, attributes, order="line_number"):
    """Projects by program, name and fund; attributes from the newer side.

    Adds ``unchanged`` to the change types. ``name_key`` is the normal form.
    """
    keys = ["program_id", "name_key", "fund_type"]
    stacked = before.withColumn("__s", F.lit(0)).unionByName(after.withColumn("__s", F.lit(1)))
    first, second = F.col("__s") == 0, F.col("__s") == 1
    sums = stacked.groupBy(*keys).agg(
        F.count_if(first).alias("__n0"), F.count_if(second).alias("__n1"),
        F.coalesce(F.sum(F.when(first, F.col("amount"))), F.lit(0)).alias("before"),
        F.coalesce(F.sum(F.when(second, F.col("amount"))), F.lit(0)).alias("after"),
        F.min_by(F.struct(*attributes), F.struct(-F.col("__s"), F.col(order))).alias("__ref"))
    change = F.col("after") - F.col("before")
    kind = (
        F.when(F.col("__n0") == 0, F.lit("added")).when(F.col("__n1") == 0, F.lit("removed"))
        .when(change == 0, F.lit("unchanged")).otherwise(F.lit("modified")))
    return sums.select(*keys, *[F.col("__ref")[a].alias(a) for a in attributes], "before", "after",
                       change.alias("change"), kind.alias("change_type"))


def merge_third_draft(comparison, third, keys, value="amount_third"):
    """Bring a third amount onto a comparison, then its own extra rows.

    ``third`` has one row per key. Extra rows carry change 0 and the type
    ``unchanged_in_cd1``.
    """
    one = third.groupBy(*keys).agg(F.max(value).alias(value))
    merged = null_safe_join(comparison, one, list(keys))
    marked = null_safe_join(
        one, comparison.select(*keys).distinct().withColumn("__seen", F.lit(True)), list(keys))
    extra = marked.where(F.col("__seen").isNull()).drop("__seen").withColumn(
        "change", F.lit(0)).withColumn("change_type", F.lit("unchanged_in_cd1"))
    return merged.unionByName(extra, allowMissingColumns=True)


BASELINE_KEYS = ["department_code", "program_id", "fund_type", "section"]


def attach_baseline(comparison, request, order, keys=BASELINE_KEYS):
    """Request plus mid-session delta as baseline; absent requests as removed.

    Of several request rows with one key the last in ``order`` counts for the
    lookup. Requests with a non-zero sum and no comparison row are appended
    with zero drafts.
    """
    total = _zero("request") + _zero("session_delta")
    valued = request.withColumn("baseline", total)
    last = valued.groupBy(*keys).agg(F.max_by("baseline", F.struct(*order)).alias("baseline"))
    merged = null_safe_join(comparison, last, list(keys)).withColumn(
        "baseline", _zero("baseline"))
    present = comparison.select(*keys).distinct().withColumn("__seen", F.lit(True))
    absent = null_safe_join(valued, present, list(keys)).where(
        F.col("__seen").isNull() & (F.col("baseline") != 0))
    orphans = absent.select(
        *keys, "baseline", F.lit(0).alias("before"), F.lit(0).alias("after"),
        F.lit(0).alias("change"), F.lit("removed").alias("change_type"))
    return merged.unionByName(orphans, allowMissingColumns=True)


def key_diff(a, b, keys, value="amount"):
    """Keys only in a, only in b, or common with a relative tolerance."""
    both = compare(a, b, keys, value)
    close = is_close(F.col("before").cast("double"), F.col("after").cast("double"))
    status = (
        F.when(F.col("change_type") == "removed", F.lit("only_a"))
        .when(F.col("change_type") == "added", F.lit("only_b"))
        .when(close, F.lit("equal")).otherwise(F.lit("different")))
    return both.select(*keys, "before", "after", status.alias("status"))


def compare_totals(a, b):
    """Operating, capital and total of two sources with their differences."""
    stacked = a.select("section", "amount", F.lit("a").alias("__s")).unionByName(
        b.select("section", "amount", F.lit("b").alias("__s")))

    def side(s, section=None):
        match = F.col("__s") == s
        return sum_if(match if section is None else match & (F.col("section") == section))

    out = stacked.agg(
        *[side(s, sec).alias(f"{n}_{s}") for s in "ab"
          for n, sec in (("operating", OPERATING), ("capital", CAPITAL), ("total", None))])
    return out.withColumns(
        {f"{n}_diff": F.col(f"{n}_a") - F.col(f"{n}_b") for n in ("operating", "capital", "total")})


def expected_vs_actual(expected, actual, keys, value="amount", tolerance=0.01):
    """Expected and parsed sums per key, missing as 0, with a pass flag."""
    both = compare(expected, actual, keys, value)
    diff = _zero("after") - _zero("before")
    return both.select(
        *keys, _zero("before").alias("expected"), _zero("after").alias("actual"),
        diff.alias("difference"), (F.abs(diff) < tolerance).alias("passed"))


def pass_counts(checks):
    return checks.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias(
        "failed"), F.count(F.lit(1)).alias("total"))


def first_and_last(df, keys, text, first="reason_first", last="reason_second"):
    """Smallest and largest text per key.

    Spark sorts rows to find the least of texts, so distinct texts are hashed first and a task sorts
    no more rows than there are texts. Their count keeps that step: without it Spark drops it.
    """
    texts = df.groupBy(*keys, text).agg(F.count(F.lit(1)).alias("__n"))
    return texts.groupBy(*keys).agg(
        F.min(text).alias(first), F.max(text).alias(last), F.sum("__n").alias("__n")).where(
        "__n > 0").drop("__n")


def attach_reasons(comparison, reasons, key="program_id", first="before", second="after"):
    """Reasons per program; the later one only if the drafts differ by over 1."""
    joined = comparison.join(
        reasons.select(key, F.col("reason_first").alias("reason_first"),
                       F.col("reason_second").alias("__second")), key, "left")
    differs = F.abs(_zero(second) - _zero(first)) > 1
    return joined.withColumn(
        "reason_second", F.when(differs, F.col("__second"))).drop("__second")


def deflate(df, deflators, columns, year="fiscal_year"):
    """Real amounts; a year without a factor keeps its nominal value."""
    joined = df.join(deflators.select(year, "deflator"), year, "left").withColumn(
        "deflator", F.coalesce(F.col("deflator"), F.lit(1)).cast("decimal(10,4)"))
    return joined.withColumns(
        {f"{c}_real": (F.col(c) * F.col("deflator")).cast("decimal(38,6)") for c in columns})


def resolve_authority(df, scope="scope", year="fiscal_year"):
    """Odd years with a supplemental use it alone; all other years the main bill."""
    supplemental = F.col(scope) == "supplemental"
    covered = df.where(supplemental & (F.col(year) % 2 == 1)).select(year).distinct().withColumn(
        "__covered", F.lit(True))
    joined = df.join(covered, year, "left")
    use = F.coalesce(F.col("__covered"), F.lit(False))
    return joined.where((use & supplemental) | (~use & ~supplemental)).drop("__covered")


def program_category(df, categories, key="program_id", default=""):
    """Category per program with a fallback bucket."""
    one = categories.groupBy(key).agg(F.min("category").alias("__category"))
    return df.join(one, key, "left").withColumn(
        "category", F.coalesce(F.col("__category"), F.lit(default))).drop("__category")


# --- programs shared by several departments ---------------------------------


def split_programs(df, levels=(), d1="d1", d2="d2"):
    """Stage sums per department of programs booked under two or more.

    ``levels`` adds section or fund to the key.
    """
    keys = ["program_id", *levels]
    known = df.where(F.col("program_id").isNotNull() & F.col("department_code").isNotNull())
    sums = known.groupBy(*keys, "department_code").agg(
        F.coalesce(F.sum(d1), F.lit(0)).alias("d1"), F.coalesce(F.sum(d2), F.lit(0)).alias("d2"))
    wide = sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("departments")).where(
        F.col("departments") >= 2)
    return null_safe_join(sums, wide, keys, "inner").withColumn(
        "delta", F.col("d2") - F.col("d1"))


def transfer_directions(split, levels=(), threshold=100_000):
    """Direction of money between the departments of a shared program.

    One row per department and counterpart. The input holds one row per
    program and department, and departments are a fixed short list, so the
    counterparts of a row are few however many allocations there are.
    """
    keys = ["program_id", *levels]
    other = split.select(*keys, F.col("department_code").alias("counterpart"),
                         F.col("delta").alias("other_delta"))
    pairs = null_safe_join(split, other, keys, "inner").where(
        F.col("department_code") != F.col("counterpart"))
    moved = (
        (F.abs("delta") > threshold) & (F.abs("other_delta") > threshold)
        & ((F.col("delta") < 0) != (F.col("other_delta") < 0)))
    direction = F.when(moved & (F.col("delta") < 0), F.lit("out")).when(
        moved, F.lit("in")).otherwise(F.lit("neutral"))
    return pairs.select(*keys, "department_code", "counterpart", "delta", "other_delta",
                        direction.alias("direction"))


def transfer_flows(split, levels=()):
    """What moved between the departments of a shared program, as amounts that add up.

    The reductions of a program fill one axis, its increases another, both by department;
    each stretch where a reduction and an increase overlap is a flow. A program has fewer
    flows than departments, every reduction is used up as far as there are increases to
    take it, and departments that stay as they are have none.
    """
    keys = ["program_id", *levels]
    moved = split.where(F.col("delta") != 0).withColumn("gives", F.col("delta") < 0)
    along = W.partitionBy(*keys, "gives").orderBy("department_code").rowsBetween(W.unboundedPreceding, 0)
    ends = moved.withColumn("end", F.sum(F.abs("delta")).over(along)).groupBy(*keys, "end").agg(
        F.max(F.when(F.col("gives"), F.col("department_code"))).alias("giver"),
        F.max(F.when(~F.col("gives"), F.col("department_code"))).alias("taker"))
    by_end = W.partitionBy(*keys).orderBy("end")
    ahead = by_end.rowsBetween(0, W.unboundedFollowing)
    return ends.select(
        *keys, F.first("giver", ignorenulls=True).over(ahead).alias("giver"),
        F.first("taker", ignorenulls=True).over(ahead).alias("taker"),
        (F.col("end") - F.coalesce(F.lag("end").over(by_end), F.lit(0))).alias("moved"),
    ).where(F.col("giver").isNotNull() & F.col("taker").isNotNull())


def augment_split(df, d1="d1", d2="d2"):
    """Program rows per department with the full program total beside them.

    The full total covers all departments, but only sections this department
    has. Change and percentage stay with the department's own part; any change
    of a shared program is a transfer.
    """
    own = df.groupBy("department_code", "program_id", "section").agg(
        F.coalesce(F.sum(d1), F.lit(0)).alias("d1"), F.coalesce(F.sum(d2), F.lit(0)).alias("d2"))
    by_section = own.groupBy("program_id", "section").agg(
        F.sum("d1").alias("all_d1"), F.sum("d2").alias("all_d2"))
    rows = null_safe_join(own, by_section, ["program_id", "section"])
    programs = rows.groupBy("department_code", "program_id").agg(
        *[F.sum(c).alias(c) for c in ("d1", "d2", "all_d1", "all_d2")])
    shared = programs.groupBy("program_id").agg(
        (F.count(F.lit(1)) > 1).alias("is_split"))
    out = null_safe_join(programs, shared, ["program_id"])
    change = F.col("d2") - F.col("d1")
    pct = F.when(
        F.col("d1") != 0, change.cast("double") / F.abs("d1").cast("double") * 100
    ).otherwise(F.when(change != 0, F.lit(100.0)).otherwise(F.lit(0.0)))
    return out.withColumn("change", change).withColumn("pct_change", pct).withColumn(
        "is_transfer", F.col("is_split") & (change != 0))


def change_buckets(programs):
    """Label program changes and name the counterpart departments of transfers.

    Takes the output of :func:`augment_split`.
    """
    change = F.col("change")
    bucket = (
        F.when(F.col("is_transfer") & (change < 0), F.lit("moved_out"))
        .when(F.col("is_transfer"), F.lit("moved_in"))
        .when(change > 0, F.lit("increase")).otherwise(F.lit("reduction")))
    owners = programs.groupBy("program_id").agg(
        F.array_sort(F.collect_set("department_code")).alias("__owners"))
    joined = null_safe_join(programs.where(change != 0), owners, ["program_id"])
    others = F.array_join(
        F.array_except("__owners", F.array("department_code")), ", ")
    return joined.withColumn("bucket", bucket).withColumn(
        "counterpart", F.when(F.col("is_transfer"), others).otherwise(F.lit(""))).drop("__owners")


def bucket_totals(buckets):
    """Count, net and gross per department, bucket and counterpart group."""
    return buckets.groupBy("department_code", "bucket", "counterpart").agg(
        F.count(F.lit(1)).alias("n"), F.sum("change").alias("net"),
        F.sum(F.abs("change")).alias("gross"))


def net_without_transfers(buckets):
    return buckets.groupBy("department_code").agg(
        F.sum("change").alias("net"),
        sum_if(~F.col("is_transfer"), "change").alias("net_without_transfers"))
