"""Capital project list: blocks of lines to project rows, and reconciliation.

A block is named by the number of its header line, so no block counter is
needed. All context is carried in chunks; blocks themselves are grouped with
partial aggregation.
"""

from pyspark.sql import functions as F

from ..functions import fund_from_text
from ..schema import CAPITAL, CATEGORY_NAMES, DEPARTMENT_NAMES, MONEY, lookup
from ..session import cut_lineage
from .lines import mark_project_span, prepare_lines
from .ordered import carry_forward, nested_running_total, running_total, settle

# Line patterns inside the project list.
PROJECT_PATTERNS = {
    "category": r"(?i)^\s*([A-Z])\.\s+(.+?)(?=\s*\([A-Z]+\)|$)",
    "program": r"^\s*([A-Z]{2,4}\d{2,4})\s*[-–]\s*(.+?)\s*$",
    "funding": (r"(?i)^\s*TOTAL\s+FUNDING\s+([A-Z]{2,4})\s+(?:([\d,]+)\s+)?([A-Z])\s+"
                r"(?:([\d,]+)\s+)?([A-Z])\s*$"),
    "second": r"(?i)^([A-Z]{2,4})\s+(?:([\d,]+)\s+)?([A-Z])\s+(?:([\d,]+)\s+)?([A-Z])\s*$",
    "continuation": r"^([\d,]+)\s+([A-Z])$",
    "header": r"^\s*(\d+(?:\.\d+)?)\.?\s{2,}([A-Z0-9].+?)\s*$",
}
# Lines the main rules take before the list is looked at.
TAKEN_FIRST = r"^\s+[\d,.]+[*#]\s+[\d,.]+[*#]\s*$|^\s{4,}[\d,]+[A-Z]\s*$"
ROUNDING = 0.5


def _group(name, index):
    return F.regexp_extract("text", PROJECT_PATTERNS[name], index)


def _thousands(text):
    """Amount in thousands: 0 without digits, NULL if wider than an amount can be."""
    digits = F.regexp_replace(text, r"[^\d]", "")
    return F.when(digits == "", F.lit(0).cast(MONEY)).otherwise(
        (digits.try_cast(f"decimal({MONEY.precision - MONEY.scale - 3},0)") * 1000).cast(MONEY))


def unreadable_project_amounts(lines):
    """Amounts of the project list that are too wide to be read, as findings."""
    rows = list_lines(lines).where(F.col("shape").isin("funding", "second", "continuation"))
    numbers = F.regexp_extract_all("text", F.lit(r"(\d[\d,]*)"), F.lit(1))
    return rows.select("doc_id", "line_no", F.explode(numbers).alias("number")).where(
        _thousands(F.col("number")).isNull())


def _event(flag, *fields):
    return F.when(flag, F.struct(F.col("line_no").alias("line"), *fields))


def _line(name):
    return F.coalesce(F.col(name)["line"], F.lit(-1))


def _funds(name):
    """Department, amounts and fund letters of a funding line."""
    return [F.upper(_group(name, 1)).alias("department"),
            _thousands(_group(name, 2)).alias("amount1"), F.upper(_group(name, 3)).alias("fund1"),
            _thousands(_group(name, 4)).alias("amount2"), F.upper(_group(name, 5)).alias("fund2")]


def list_lines(lines):
    """Lines of the project list with their shape, in document order."""
    rows = mark_project_span(prepare_lines(lines))
    marker = F.col("text").contains("CAPITAL IMPROVEMENT PROJECTS AUTHORIZED")
    inside = F.col("in_list") & ~marker & ~F.col("raw").rlike(TAKEN_FIRST)
    prefix = F.upper(F.substring(_group("program", 1), 1, 3))
    shape = (
        F.when(~inside, F.lit("outside"))
        .when(F.col("text").rlike(PROJECT_PATTERNS["category"]), F.lit("category"))
        .when(lookup(DEPARTMENT_NAMES, prefix).isNotNull(), F.lit("program"))
        .when(F.col("text").rlike(PROJECT_PATTERNS["funding"]), F.lit("funding"))
        .when(F.col("text").rlike(PROJECT_PATTERNS["second"]), F.lit("second"))
        .when(F.col("text").rlike(PROJECT_PATTERNS["continuation"]), F.lit("continuation"))
        .when(F.col("text").rlike(PROJECT_PATTERNS["header"]), F.lit("header"))
        .otherwise(F.lit("text")))
    kept = settle(rows, {"shape": shape})
    # The line after the list closes it: keep the first outside lines as events.
    return kept.where((F.col("shape") != "outside") | F.col("text").rlike(r"^SECTION\s+\d+\.\s"))


def project_context(lines):
    """List lines with program, category, open block and last funding line."""
    rows = list_lines(lines)
    shape = F.col("shape")
    first = carry_forward(
        rows, ["doc_id"], "line_no",
        {
            "p_event": _event(shape == "program", F.upper(_group("program", 1)).alias("id"),
                              _group("program", 2).alias("name")),
            "c_event": _event(shape == "category", F.coalesce(
                lookup(CATEGORY_NAMES, F.upper(_group("category", 1))), F.lit("Other")).alias(
                "category")),
            "h_event": _event(shape == "header", _group("header", 1).alias("id"),
                              _group("header", 2).alias("name")),
            "x_event": _event(shape == "outside"),
            "f_event": _event(shape == "funding"),
        },
        inclusive=False)
    cut = F.greatest(_line("p_event"), _line("x_event"))
    in_block = _line("h_event") > F.greatest(cut, _line("f_event"))
    opened = first.withColumn("cut", cut).withColumn("in_block", in_block).withColumn(
        "valid", (F.col("shape") == "funding") & in_block & F.col("p_event").isNotNull())
    second = carry_forward(
        opened, ["doc_id"], "line_no",
        {"e_event": _event(F.col("valid"), F.col("h_event.line").alias("block"),
                           F.col("h_event.id").alias("id"),
                           F.upper(F.trim(F.col("h_event.name"))).alias("name_key"),
                           *_funds("funding"))},
        inclusive=False)
    fresh = _line("e_event") > F.greatest(F.col("cut"), _line("h_event"))
    same_program = _line("e_event") > F.col("cut")
    department = F.col("e_event.department")
    extra = (F.col("shape") == "second") & fresh & (F.upper(_group("second", 1)) == department)
    return second.withColumns({
        "after_funding": fresh, "has_previous": same_program, "is_extra": extra})


def block_lines(context):
    """The lines and columns that the steps after the context read: headers, amounts and
    the text of open blocks. Other lines have done their part once the context is carried."""
    amounts = F.col("shape").isin("header", "funding", "second", "continuation")
    return context.where(amounts | ((F.col("shape") == "text") & F.col("in_block"))).drop(
        "raw", "in_list", "x_event", "f_event", "cut")


def fund_rows(context):
    """One row per funding line of a block: the primary and further funds."""
    primary = context.where("valid").select(
        "doc_id", F.col("h_event.line").alias("block"), F.col("line_no").alias("row_line"),
        F.col("p_event.id").alias("program_id"), F.col("p_event.name").alias("program_name"),
        F.col("c_event.category").alias("category"), F.col("h_event.id").alias("project_id"),
        F.col("h_event.name").alias("project_name"), *_funds("funding"),
        F.lit(True).alias("is_primary"))
    extra = context.where("is_extra").select(
        "doc_id", F.col("e_event.block").alias("block"), F.col("line_no").alias("row_line"),
        F.col("p_event.id").alias("program_id"), F.col("p_event.name").alias("program_name"),
        F.col("c_event.category").alias("category"), F.col("e_event.id").alias("project_id"),
        F.lit(None).cast("string").alias("project_name"), *_funds("second"),
        F.lit(False).alias("is_primary"))
    return primary.unionByName(extra)


def continuation_amounts(context):
    """Second-year amount per funding line after its continuation lines.

    A continuation with the second-year fund replaces the amount; when that
    year was blank, it opens it if positive and both funds are equal.
    """
    carried = carry_forward(
        context, ["doc_id"], "line_no",
        {"r_event": _event(F.col("valid") | F.col("is_extra"))}, inclusive=False)
    return carried.where((F.col("shape") == "continuation") & F.col("after_funding")).select(
        "doc_id", F.col("r_event.line").alias("row_line"), F.col("line_no").alias("at_line"),
        _thousands(_group("continuation", 1)).alias("amount"),
        _group("continuation", 2).alias("letter"))


def scopes(context):
    """Scope text of every block: its plain lines joined in order."""
    text = context.where((F.col("shape").isin("text", "second", "continuation"))
                         & F.col("in_block"))
    return text.groupBy("doc_id", F.col("h_event.line").alias("block")).agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]),
            " ").alias("scope"))


def reissued_blocks(context):
    """Blocks replaced by a later block of the same program.

    The next headers after a funding line are compared with its block: the
    same id replaces it at once; the same title under another id only if the
    next funding line has the same funds and first-year amount.
    """
    after = context.where(F.col("has_previous") & F.col("shape").isin("header", "funding"))
    same_id = (F.col("shape") == "header") & (_group("header", 1) == F.col("e_event.id"))
    same_title = ((F.col("shape") == "header") & ~same_id
                  & (F.upper(F.trim(_group("header", 2))) == F.col("e_event.name_key")))
    same_funding = F.col("valid") & (
        (F.upper(_group("funding", 3)) == F.col("e_event.fund1"))
        & (F.upper(_group("funding", 5)) == F.col("e_event.fund2"))
        & (_thousands(_group("funding", 2)) == F.col("e_event.amount1")))
    marks = after.groupBy("doc_id", F.col("e_event.block").alias("block")).agg(
        F.bool_or(same_id).alias("same_id"), F.bool_or(same_title).alias("same_title"),
        F.bool_or(same_funding).alias("same_funding"))
    return marks.where(
        F.col("same_id") | (F.col("same_title") & F.col("same_funding"))).select("doc_id", "block")


def extract_projects(lines, fy1, fy2):
    """Project rows per fund and year, reissued blocks removed."""
    context = cut_lineage(block_lines(project_context(lines)))
    rows = fund_rows(context)
    amended = continuation_amounts(context).join(
        rows.select("doc_id", "row_line", "fund1", "fund2", "amount2"), ["doc_id", "row_line"])
    fund2 = fund_from_text(F.col("fund2"))
    replaces = (F.col("amount2") > 0) & (F.col("letter") == fund2)
    fills = ((F.col("amount2") == 0) & (F.col("letter") == F.col("fund1"))
             & (F.col("letter") == F.col("fund2")))
    opens = fills & (F.col("amount") > 0)
    changes = amended.groupBy("doc_id", "row_line").agg(
        F.max_by("amount", F.when(replaces, F.col("at_line"))).alias("new_amount"),
        F.max_by("amount", F.when(fills, F.col("at_line"))).alias("filled"),
        F.min(F.when(opens, F.col("at_line"))).alias("filled_line"))
    names = rows.where("is_primary").select(
        "doc_id", "block", F.col("project_name").alias("block_name"))
    kept = rows.join(reissued_blocks(context), ["doc_id", "block"], "left_anti")
    full = kept.join(changes, ["doc_id", "row_line"], "left").join(
        names, ["doc_id", "block"], "left").join(scopes(context), ["doc_id", "block"], "left")
    opened = F.col("filled_line").isNotNull()
    second = (
        F.when(F.col("amount2") > 0, F.coalesce("new_amount", "amount2"))
        .when(opened, F.col("filled")))
    years = F.array(
        F.struct(F.lit(fy1).cast("int").alias("fiscal_year"),
                 F.when(F.col("amount1") > 0, F.col("amount1")).alias("amount"),
                 F.col("fund1").alias("letter"), F.col("row_line").alias("line_number")),
        F.struct(F.lit(fy2).cast("int").alias("fiscal_year"), second.alias("amount"),
                 F.col("fund2").alias("letter"),
                 F.coalesce("filled_line", "row_line").alias("line_number")))
    return full.select(
        "doc_id", "block", "project_id", F.col("block_name").alias("project_name"),
        F.coalesce("scope", F.lit("")).alias("scope"), "program_id", "program_name",
        F.col("department").alias("department_code"),
        F.coalesce("category", F.lit("Uncategorized")).alias("category"), F.inline(years),
    ).where(F.col("amount").isNotNull()).transform(
        lambda df: settle(df, {"fund_type": fund_from_text(F.col("letter"))})).drop("letter")


# --- reconciliation with program totals --------------------------------------

BUCKET = ["doc_id", "program_id", "fund_type", "fiscal_year"]


def excess_buckets(projects, allocations):
    """Buckets whose project sum exceeds the capital total by over a half."""
    targets = allocations.where(F.col("section") == CAPITAL).groupBy(*BUCKET).agg(
        F.sum("amount").alias("target"))
    sums = projects.groupBy(*BUCKET).agg(F.sum("amount").alias("listed"))
    excess = F.col("listed") - F.coalesce(F.col("target"), F.lit(0))
    return sums.join(targets, BUCKET, "left").select(
        *BUCKET, "listed", F.coalesce("target", F.lit(0)).alias("target"),
        excess.alias("excess")).where(F.col("excess") > ROUNDING)


def _later_copies(projects, buckets):
    """Copies after the first of a title, ordered by title, then line."""
    keyed = projects.withColumn("name_key", F.upper(F.trim("project_name"))).join(
        buckets.select(*BUCKET, "excess"), BUCKET)
    first = keyed.groupBy(*BUCKET, "name_key").agg(
        F.min("line_number").alias("first_line"), F.count(F.lit(1)).alias("copies")).where(
        F.col("copies") > 1)
    later = keyed.join(first, [*BUCKET, "name_key"]).where(
        F.col("line_number") > F.col("first_line"))
    return later.select(*BUCKET, "excess", F.col("line_number").cast("long"), "amount",
                        F.col("first_line").cast("long"))


def _round_of_choices(copies, state):
    """What one round of the greedy choice drops, and where each bucket goes on.

    Copies under half the excess that is left ("small") fit as long as the excess
    has not halved; so a running total of the small ones tells every decision up
    to the first copy that brings the excess under its half: a small one by the
    total, or a large one that fits. That copy ends the round.
    """
    half = F.greatest(F.col("left") / 2, F.lit(ROUNDING + 0.01).cast("decimal(3,2)"))
    live = copies.join(state, BUCKET).where(
        (F.col("pos") > F.col("at")) & (F.col("amount") <= F.col("left") + ROUNDING)
    ).withColumn("half", half).withColumn("small", F.col("amount") < F.col("half"))
    totals = running_total(
        live, BUCKET, "pos", {"run": F.when(F.col("small"), F.col("amount")).otherwise(0)})
    rest = F.col("left") - F.col("run")
    ends = F.when(F.col("small"), rest < F.col("half")).otherwise(F.col("amount") <= rest + ROUNDING)
    totals = totals.withColumn("ends", ends)
    stop = totals.groupBy(*BUCKET).agg(F.min(F.when(F.col("ends"), F.col("pos"))).alias("stop"))
    return totals.join(stop, BUCKET).where(
        F.when(F.col("small"), F.col("stop").isNull() | (F.col("pos") <= F.col("stop")))
        .otherwise(F.col("pos") == F.col("stop"))).select(
        *BUCKET, "line_number", "amount", "left", "stop")


def copies_to_drop(projects, allocations):
    """Later copies of a title that were not counted in the program total.

    Titles are visited in first-seen order and their later copies by line; a
    copy is dropped while it fits the excess that remains. All buckets take
    their rounds together; a round at least halves the excess, so their number
    is the logarithm of the largest excess, whatever the number of copies. The
    copies of a bucket are numbered once, over nested ranges of lines.
    """
    found = _later_copies(projects, excess_buckets(projects, allocations))
    copies = cut_lineage(nested_running_total(
        found, BUCKET,
        {"__far": F.col("first_line").bitwiseAND(~0xFFFF), "__title": F.col("first_line"),
         "__near": F.col("line_number").bitwiseAND(~0xFFFF)},
        "line_number", {"pos": F.lit(1)}).drop("first_line"))
    state = copies.groupBy(*BUCKET).agg(
        F.max("excess").cast("decimal(28,2)").alias("left"), F.lit(0).cast("long").alias("at"))
    copies, dropped = copies.drop("excess"), None
    while True:
        taken = cut_lineage(_round_of_choices(copies, state))
        part = taken.select(*BUCKET, "line_number")
        dropped = part if dropped is None else dropped.unionByName(part)
        state = taken.groupBy(*BUCKET).agg(
            (F.max("left") - F.sum("amount")).cast("decimal(28,2)").alias("left"),
            F.max("stop").alias("at")).where(F.col("at").isNotNull() & (F.col("left") > ROUNDING))
        if state.isEmpty():
            return dropped


def reconcile_projects(projects, allocations):
    """Projects without the copies the program totals do not hold."""
    drop = copies_to_drop(projects, allocations)
    return projects.join(drop, [*BUCKET, "line_number"], "left_anti")


def unresolved_excess(projects, allocations):
    """What still exceeds the program totals after reconciliation."""
    return excess_buckets(projects, allocations)
