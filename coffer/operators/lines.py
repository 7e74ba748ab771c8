"""Bill text lines to allocation rows.

Input is one row per line: ``doc_id``, ``line_no``, ``line``. What a line means
depends on the lines before it (program, section, pending position counts).
That context is carried with :func:`~coffer.operators.ordered.carry_forward`,
so documents of any length are cut into chunks and run in parallel.
"""

from pyspark.sql import functions as F

from ..functions import fund_from_text, fund_name
from ..schema import CAPITAL, CATEGORY_NAMES, DEPARTMENT_NAMES, MONEY, OPERATING, POSITIONS, lookup
from ..session import cut_lineage
from .ordered import carry_forward, first_per_key, running_total, settle, with_neighbours

# Line patterns of the bill format. (?i) marks case-insensitive.
PATTERNS = {
    "positions": r"^\s+([\d,.]+)\*\s+([\d,.]+)\*\s*$",
    "positions_temp": r"^\s+([\d,.]+)#\s+([\d,.]+)#\s*$",
    "positions_amend": r"^\s+([\d,.]+)\*\s*$",
    "positions_temp_amend": r"^\s+([\d,.]+)#\s*$",
    "bare_amendment_two_col": r"^\s{4,}([\d,]+)([A-Z])\s+([\d,]+)([A-Z])\s*$",
    "bare_amendment": r"^\s{4,}([\d,]+)([A-Z])\s*$",
    "category": r"(?i)^\s*([A-Z])\.\s+(.+?)(?=\s*\([A-Z]+\)|$)",
    "program": r"(?i)^\s*\d+[A-Z]?\.\s+([A-Z]{2,4}\d{2,4})\s*[-–]\s*(.+)",
    "total_funding":
        r"(?i)^\s*TOTAL\s+FUNDING\s+([A-Z]{2,4})\s+([\d,]+)\s*([A-Z])\s+(?:([\d,]+)\s*)?([A-Z])\s*$",
    "investment_capital_fy2_only":
        r"(?i)^\s*INVESTMENT\s+CAPITAL\s+([A-Z]{2,4})\s+([A-Z])\s+([\d,]+)([A-Z])\s*$",
    "investment_capital":
        r"(?i)^\s*INVESTMENT\s+CAPITAL(?:\s+([A-Z0-9]+)\s+([\d,]+)([A-Z]?)(?:\s+([\d,]+)([A-Z]?))?)?",
    "amount_two_col": r"(?i)^\s*([A-Z]+)\s+([\d,]+)([A-Z])\s+([\d,]+)([A-Z]?)\s*$",
    "indented_amount": r"(?i)^\s*([A-Z]+)\s+([\d,]+)([A-Z]?)(?:\s+([\d,]+)([A-Z]?))?\s*$",
    "amount_single_fund": r"(?i)^\s*([A-Z]+)\s+([\d,]+)([A-Z])(?:\s+([A-Z]))?\s*$",
    "fy2_only_amount": r"(?i)^\s*([A-Z]+)\s+([A-Z])\s+([\d,]+)([A-Z])\s*$",
    "operating_pdf": r"(?i)^\s*OPERATING\s+([A-Z]+)\s+([\d,]+)([A-Z])\s+([A-Z])\s*$",
    "operating_line": r"(?i)^OPERATING\s+([A-Z]+)\s+([\d,]+)([A-Z])(?:\s+([\d,]+)([A-Z]?))?\s*$",
    "section_with_amounts":
        r"(?i)^\s*([A-Z]+)\s+([A-Z]+)\s+([\d,]+)([A-Z]?)(?:\s+([\d,]+)([A-Z]?))?\s*$",
    "section": r"(?i)^\s*OPERATING",
    "section_fy2": r"([A-Z]{2,4})\s+([A-Z])\s+([\d,]+)([A-Z])\s*$",
    "section_pair": r"([A-Z]+)\s+([\d,]+)([A-Z]?)(?:\s+([\d,]+)([A-Z]?))?\s*$",
    "loose_amount": r"([A-Z]+)?\s*([\d,]+)([A-Z])(?:\s+[A-Z])?\s*$",
    "loose_spaced": r"([A-Z]+)?\s*([\d,]+)(?:\s+)([A-Z])\s*$",
    "list_opens": r"CAPITAL IMPROVEMENT PROJECTS AUTHORIZED",
    "list_closes": r"^\s*SECTION\s+\d+\.\s",
}
MIN_INDENT = 20
LARGE_REPEAT = 50_000_000

# Kinds that read a year pair; all but the last use up pending positions.
PAIR_KINDS = [
    "total_funding", "capital_fy2_only", "capital_inline", "capital_two_col", "capital_indented",
    "capital_single", "capital_fy2", "two_col", "fy2_only", "operating_line",
    "section_with_amounts", "section_fy2", "section_pair", "fallback_single", "fallback_loose",
    "fallback_spaced", "operating_pdf",
]
AMENDMENT_KINDS = ["bare_amendment_two_col", "bare_amendment"]

# What counts as money when looking for unread lines.
MONEY_LINE = (
    r"\b\d{1,3}(?:,\d{3})+[A-Z]\b|\b\d{6,}[A-Z]?\b|\$\s*\d{1,3}(?:,\d{3})*(?:\.\d{2})?[A-Z]?\b"
)
RULE_LINE = (
    r"^\s*(\d+)\.\s*([A-Z]{3}\d+)\s*-\s*(.+)$"
    r"|^\s*OPERATING\s+([A-Z]+)\s+([\d,]+)([A-Z])\s+([A-Z])\s*$"
    r"|^\s*([A-Z]+)\s+([\d,]+)([A-Z])\s+([\d,]+)([A-Z])\s*$"
    r"|^\s*CAPITAL IMPROVEMENT\s+([A-Z]+)\s+([\d,]+)([A-Z])\s*$"
)


def _is(name, column="text"):
    return F.col(column).rlike(PATTERNS[name])


def _group(name, index, column="text"):
    return F.regexp_extract(column, PATTERNS[name], index)


def _trimmed(column):
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def strip_closing_quote(raw):
    """Drop a final quote, but only on appropriation-shaped lines."""
    shaped = _trimmed(raw).rlike(r"(?i)^[A-Z]{2,4}\s|^TOTAL FUNDING")
    return F.when(
        raw.rlike(r'\p{L}"$') & shaped, F.regexp_replace(raw, r'"$', "")).otherwise(raw)


def _at(flag, *fields):
    """Event struct where the flag holds, NULL elsewhere; the line comes first."""
    return F.when(flag, F.struct(F.col("line_no").alias("line"), *fields))


def _line_of(event):
    return F.coalesce(F.col(event)["line"], F.lit(-1))


def mark_project_span(lines):
    """``in_list`` between the project-list marker and the next section."""
    opens, closes = _is("list_opens"), _is("list_closes")
    event = F.when(opens, F.struct(F.lit(True).alias("open"))).when(
        closes, F.struct(F.lit(False).alias("open")))
    marked = carry_forward(lines, ["doc_id"], "line_no", {"__span": event})
    return marked.withColumn(
        "in_list", F.coalesce(F.col("__span.open"), F.lit(False))).drop("__span")


def prepare_lines(lines):
    """Non-blank lines with the raw and the trimmed text."""
    return lines.select(
        "doc_id", "line_no", strip_closing_quote(F.col("line")).alias("raw")
    ).withColumn("text", _trimmed(F.col("raw"))).where(F.col("text") != "")


def classify_lines(lines):
    """Kind of every line and the context in force before it.

    Patterns are tried in a fixed order and the first match counts. Two facts
    come from earlier lines: whether a known program was seen, and whether the
    line stands in the capital section of its program.
    """
    rows = mark_project_span(prepare_lines(lines))
    early = (
        F.when(_is("positions", "raw"), F.lit("positions"))
        .when(_is("positions_temp", "raw"), F.lit("positions_temp"))
        .when(_is("positions_amend", "raw"), F.lit("positions_amend"))
        .when(_is("positions_temp_amend", "raw"), F.lit("positions_temp_amend"))
        .when(_is("bare_amendment_two_col", "raw")
              & (_group("bare_amendment_two_col", 2, "raw")
                 == _group("bare_amendment_two_col", 4, "raw")), F.lit("bare_amendment_two_col"))
        .when(_is("bare_amendment", "raw"), F.lit("bare_amendment"))
        .when(_is("list_opens"), F.lit("list_opens"))
        .when(F.col("in_list"), F.lit("project_list"))
        .when(_is("category"), F.lit("category"))
        .when(_is("program"), F.lit("program"))
        .when(_is("total_funding"), F.lit("total_funding"))
        .when(_is("investment_capital_fy2_only"), F.lit("capital_fy2_only"))
        .when(_is("investment_capital") & (_group("investment_capital", 1) != ""),
              F.lit("capital_inline"))
        .when(_is("investment_capital"), F.lit("capital"))
        .when(_is("amount_two_col"), F.lit("two_col"))
        .when(_is("fy2_only_amount"), F.lit("fy2_only"))
        .when(F.col("raw").contains("OPERATING") | _is("section_with_amounts") | _is("section"),
              F.lit("operating"))
        .otherwise(F.lit("other"))
    )
    rows = rows.withColumn("base", early)
    base = F.col("base")
    is_program = base == "program"
    prefix = F.upper(F.substring(_group("program", 1), 1, 3))
    known = lookup(DEPARTMENT_NAMES, prefix).isNotNull()
    weak = F.col("raw").rlike(r"^\s|\d")
    context = carry_forward(
        rows, ["doc_id"], "line_no",
        {
            "p_event": _at(is_program, _trimmed(_group("program", 1)).alias("id"),
                           _trimmed(_group("program", 2)).alias("name")),
            "k_event": _at(is_program & known, prefix.alias("department")),
            "t_event": _at(base == "total_funding",
                           F.upper(_group("total_funding", 1)).alias("department")),
            "c_event": _at(base == "category", F.coalesce(
                lookup(CATEGORY_NAMES, F.upper(_group("category", 1))), F.lit("Other")).alias(
                "category")),
            "i_event": _at(base.isin("capital", "capital_inline", "capital_fy2_only")),
            "b_event": _at((base == "operating") & ~weak),
            "w_event": _at((base == "operating") & weak),
        },
        inclusive=False,
    )
    has_context = F.col("k_event").isNotNull()
    reset = F.greatest(_line_of("p_event"), _line_of("b_event"))
    in_capital = F.when(has_context, _line_of("i_event") > reset).otherwise(
        _line_of("i_event") > F.greatest(reset, _line_of("w_event")))
    opened = F.greatest(_line_of("b_event"), _line_of("w_event")) > _line_of("p_event")
    from_funding = _line_of("t_event") > _line_of("k_event")
    department = F.when(has_context, F.when(from_funding, F.col("t_event.department")).otherwise(
        F.col("k_event.department")))
    rows = context.select(
        "doc_id", "line_no", "raw", "text", "base", "in_list",
        F.col("p_event.id").alias("program_id"), F.col("p_event.name").alias("program_name"),
        F.col("c_event.category").alias("category"), department.alias("context_department"),
        has_context.alias("has_context"), in_capital.alias("in_capital"),
        (in_capital | opened).alias("has_section"))
    return rows.withColumn("kind", _final_kind()).drop("base")


def _final_kind():
    base, ctx = F.col("base"), F.col("has_context")
    capital_line = F.col("in_capital") & ctx & F.col("raw").rlike(r"^\s|\d")
    later = base.isin("two_col", "fy2_only", "operating", "other")
    indent = F.length("raw") - F.length(F.regexp_replace("raw", r"^\s+", ""))
    fallback = ctx & F.col("has_section") & ~F.col("text").startswith("OPERATING") & (
        indent < MIN_INDENT)
    operating = F.col("raw").contains("OPERATING")
    return (
        F.when(base.isin(*AMENDMENT_KINDS) & ctx, base)
        .when(base == "bare_amendment_two_col", F.lit("other"))
        .when(base == "bare_amendment", F.lit("other"))
        .when((base == "total_funding") & ~ctx, F.lit("other"))
        .when(~later, base)
        .when(capital_line & (base == "two_col"), F.lit("capital_two_col"))
        .when(capital_line & _is("indented_amount"), F.lit("capital_indented"))
        .when(capital_line & _is("amount_single_fund"), F.lit("capital_single"))
        .when(capital_line & _is("fy2_only_amount"), F.lit("capital_fy2"))
        .when(capital_line, F.lit("capital_other"))
        .when(base == "two_col", F.lit("two_col"))
        .when((base == "fy2_only") & ctx, F.lit("fy2_only"))
        .when(operating & _is("operating_pdf", "raw"), F.lit("operating_pdf"))
        .when(operating & _is("operating_line"), F.lit("operating_line"))
        .when(_is("section_with_amounts"), F.lit("section_with_amounts"))
        .when(_is("section") & _is("section_fy2"), F.lit("section_fy2"))
        .when(_is("section") & _is("section_pair"), F.lit("section_pair"))
        .when(_is("section"), F.lit("section"))
        .when(fallback & _is("amount_single_fund"), F.lit("fallback_single"))
        .when(fallback & _is("loose_amount"), F.lit("fallback_loose"))
        .when(fallback & _is("loose_spaced"), F.lit("fallback_spaced"))
        .otherwise(F.lit("other"))
    )


# Groups per kind: pattern, department, first amount, first fund, second
# amount, second fund (0 = not printed), capital section forced, note.
_READ = {
    "total_funding": ("total_funding", 1, 2, 3, 4, 5, CAPITAL, "Total Funding (grant/subsidy)"),
    "capital_fy2_only": ("investment_capital_fy2_only", 1, 0, 4, 3, 4, CAPITAL,
                         "Investment Capital - blank FY1 header"),
    "capital_inline": ("investment_capital", 1, 2, 3, 4, 5, CAPITAL, ""),
    "capital_two_col": ("amount_two_col", 1, 2, 3, 4, 5, CAPITAL, "Investment Capital"),
    "capital_indented": ("indented_amount", 1, 2, 3, 4, 5, CAPITAL, "Investment Capital"),
    "capital_single": ("amount_single_fund", 1, 2, 3, 0, 4, CAPITAL,
                       "Investment Capital - single amount"),
    "capital_fy2": ("fy2_only_amount", 1, 0, 4, 3, 4, CAPITAL,
                    "Investment Capital - blank FY1 column"),
    "two_col": ("amount_two_col", 1, 2, 3, 4, 5, None, ""),
    "fy2_only": ("fy2_only_amount", 1, 0, 4, 3, 4, None, ""),
    "operating_pdf": ("operating_pdf", 1, 2, 3, 0, 0, OPERATING, ""),
    "operating_line": ("operating_line", 1, 2, 3, 4, 5, OPERATING, ""),
    "section_with_amounts": ("section_with_amounts", 2, 3, 4, 5, 6, None, ""),
    "section_fy2": ("section_fy2", 1, 0, 4, 3, 4, OPERATING, ""),
    "section_pair": ("section_pair", 1, 2, 3, 4, 5, OPERATING, ""),
    "fallback_single": ("amount_single_fund", 1, 2, 3, 2, 4, None, "second year copied from first"),
    "fallback_loose": ("loose_amount", 1, 2, 3, 2, 0, None, "second year copied from first"),
    "fallback_spaced": ("loose_spaced", 1, 2, 3, 2, 0, None, "second year copied from first"),
}


def _digits(text):
    """Amount of a matched group: 0 without digits, NULL if wider than an amount can be."""
    digits = F.regexp_replace(text, r"[^\d]", "")
    return F.when(digits == "", F.lit(0).cast(MONEY)).otherwise(digits.try_cast(MONEY))


def unreadable_amounts(classified):
    """Amount lines with a number too wide to be read, as findings; no amount is made of it."""
    widest = MONEY.precision - MONEY.scale
    numbers = F.regexp_extract_all("raw", F.lit(r"(\d[\d,]*)"), F.lit(1))
    wide = F.filter(numbers, lambda n: F.length(F.replace(n, F.lit(","), F.lit(""))) > widest)
    return classified.where(F.col("kind").isin([*PAIR_KINDS, *AMENDMENT_KINDS])).select(
        "doc_id", "line_no", "kind", F.explode(wide).alias("number"))


def read_pairs(classified):
    """Department, amounts, funds and section of every line with a year pair."""
    pair = None
    for kind, (pattern, dept, a1, f1, a2, f2, section, note) in _READ.items():
        def group(index, pattern=pattern):
            return _group(pattern, index) if index else F.lit("")

        value = F.struct(
            group(dept).alias("department"), group(a1).alias("amount1"), group(f1).alias("fund1"),
            group(a2).alias("amount2"), group(f2).alias("fund2"),
            F.lit(section).cast("string").alias("section"), F.lit(note).alias("note"))
        test = F.col("kind") == kind
        pair = F.when(test, value) if pair is None else pair.when(test, value)
    rows = settle(classified.where(F.col("kind").isin(PAIR_KINDS)), {"pair": pair})
    section = F.coalesce(
        F.col("pair.section"),
        F.when(F.col("in_capital"), F.lit(CAPITAL)).otherwise(F.lit(OPERATING)))
    default = F.when(section == CAPITAL, F.lit("C")).otherwise(F.lit("A"))
    fund1 = F.upper(F.coalesce(F.nullif(F.col("pair.fund1"), F.lit("")), default))
    fund2 = F.upper(F.coalesce(F.nullif(F.col("pair.fund2"), F.lit("")), fund1))
    printed = F.col("pair.department")
    short = (printed == "") | printed.rlike(r"^[A-Za-z]{1,2}$")
    keep = F.col("kind") == "operating_pdf"
    code = F.when(short & ~keep, F.coalesce("context_department", printed)).otherwise(printed)
    code = F.when(F.col("kind") == "total_funding", F.upper(code)).otherwise(code)
    values = settle(rows.withColumn("program_id", F.coalesce("program_id", F.lit("Unknown"))), {
        "department_code": code, "section": section,
        "amount1": _digits(F.col("pair.amount1")), "fund1": fund1,
        "amount2": _digits(F.col("pair.amount2")), "fund2": fund2, "notes": F.col("pair.note")})
    return values.select(
        "doc_id", "line_no", "kind", "program_id", "program_name", "category", "department_code",
        "section", "amount1", "fund1", "amount2", "fund2", "notes",
        *[c for c in ("perm1", "perm2", "temp1", "temp2") if c in classified.columns])


def carry_positions(classified):
    """Position counts pending at every line.

    A ceiling pair belongs to the next amount line: any pair line but the
    first-year-only form, or a new program, uses it up.
    """
    kind = F.col("kind")

    def number(pattern, index):
        return F.replace(_group(pattern, index, "raw"), F.lit(","), F.lit("")).try_cast(POSITIONS)

    def pair(name):
        return _at(kind == name, number(name, 1).alias("fy1"), number(name, 2).alias("fy2"))

    def amended(name):
        return _at(kind == name, number(name, 1).alias("fy2"))

    used = kind.isin([k for k in PAIR_KINDS if k != "operating_pdf"] + ["program"])
    rows = carry_forward(
        classified, ["doc_id"], "line_no",
        {"q_event": pair("positions"), "qt_event": pair("positions_temp"),
         "qa_event": amended("positions_amend"), "qta_event": amended("positions_temp_amend"),
         "u_event": _at(used)},
        inclusive=False)

    def pending(event, amendment):
        live = _line_of(event) > _line_of("u_event")
        second = F.when(_line_of(amendment) > _line_of(event), F.col(f"{amendment}.fy2")).otherwise(
            F.col(f"{event}.fy2"))
        return F.when(live, F.col(f"{event}.fy1")), F.when(live, second)

    p1, p2 = pending("q_event", "qa_event")
    t1, t2 = pending("qt_event", "qta_event")
    out = rows.withColumns({"perm1": p1, "perm2": p2, "temp1": t1, "temp2": t2})
    return out.drop("q_event", "qt_event", "qa_event", "qta_event", "u_event")


def _positions(perm, temp):
    zero = F.lit(0).cast(POSITIONS)
    some = perm.isNotNull() | temp.isNotNull()
    return (F.when(some, F.coalesce(perm, zero) + F.coalesce(temp, zero)).cast(POSITIONS),
            F.when(some, F.coalesce(temp, zero)).cast(POSITIONS))


def explode_years(pairs, fy1, fy2):
    """Up to two rows per pair line; amounts of 0 are dropped.

    Position columns, if present, are attached by year.
    """
    def year(n, fy):
        perm, temp = (
            (F.col(f"perm{n}"), F.col(f"temp{n}")) if f"perm{n}" in pairs.columns
            else (F.lit(None).cast(POSITIONS), F.lit(None).cast(POSITIONS)))
        total, temporary = _positions(perm, temp)
        return F.struct(
            F.lit(fy).cast("int").alias("fiscal_year"), F.col(f"amount{n}").alias("amount"),
            F.col(f"fund{n}").alias("letter"), total.alias("positions"),
            temporary.alias("positions_temp"))

    drop = {"amount1", "amount2", "fund1", "fund2", "perm1", "perm2", "temp1", "temp2"}
    kept = [c for c in pairs.columns if c not in drop]
    rows = pairs.select(*kept, F.inline(F.array(year(1, fy1), year(2, fy2))))
    return settle(rows.where(F.col("amount") > 0), {
        "fund_type": fund_from_text(F.col("letter"))}).drop("letter")


def build_allocations(rows):
    """Names, categories and ``Unknown`` defaults of finished rows."""
    return rows.withColumns({
        "program_id": F.coalesce("program_id", F.lit("Unknown")),
        "program_name": F.coalesce("program_name", F.lit("Unknown Program")),
        "category": F.coalesce("category", F.lit("Uncategorized")),
        "department_name": F.coalesce(
            lookup(DEPARTMENT_NAMES, F.col("department_code")), F.col("department_code")),
        "fund_category": fund_name(F.col("fund_type")),
    })


RUN_KEYS = ["doc_id", "program_id", "fund_type", "section", "department_code", "fiscal_year"]


def apply_amendments(originals, amendments):
    """Amended values replace the latest earlier row with the same key.

    Both sides carry RUN_KEYS, ``line_no`` and ``amount``; ``amendments`` also
    has ``creates``: whether it may open a row when none precedes. A created
    row needs a positive amount; later amendments then apply to it, and a row
    amended to 0 stays. Each original opens a run, counted with a chunked
    running total; each run is one group with partial aggregation.
    """
    payload = [c for c in originals.columns if c not in RUN_KEYS and c not in ("line_no", "amount")]
    events = originals.withColumns({"is_original": F.lit(1), "creates": F.lit(False)}).unionByName(
        amendments.withColumn("is_original", F.lit(0)), allowMissingColumns=True)
    runs = running_total(events, RUN_KEYS, "line_no", {"run": F.col("is_original")})
    original = F.col("is_original") == 1
    opens = (F.col("is_original") == 0) & F.col("creates") & (F.col("amount") > 0)
    rest = F.struct(F.col("line_no"), *payload)
    merged = runs.groupBy(*RUN_KEYS, "run").agg(
        F.max_by("amount", F.when(~original, F.col("line_no"))).alias("amended"),
        F.max_by("amount", F.when(original, F.col("line_no"))).alias("printed"),
        F.max_by(rest, F.when(original, F.col("line_no"))).alias("own"),
        F.min_by(rest, F.when(opens, F.col("line_no"))).alias("created"),
    )
    first = F.coalesce("own", "created")
    return merged.where(F.col("own").isNotNull() | F.col("created").isNotNull()).select(
        *RUN_KEYS, first["line_no"].alias("line_no"),
        F.coalesce("amended", "printed").alias("amount"),
        *[first[c].alias(c) for c in payload])


def read_amendments(classified, originals, fy1, fy2):
    """Bare amount lines as amendments with the department they refer to.

    That is the department of the last row of the program before the line, or
    the one in context when the program has no row yet.
    """
    emitted = originals.groupBy("doc_id", "program_id", "line_no").agg(
        F.max("department_code").alias("emitted"))
    bare = classified.where(F.col("kind").isin(AMENDMENT_KINDS))
    both = bare.select(
        "doc_id", "program_id", "line_no", "raw", "kind", "in_capital", "program_name", "category",
        "context_department", "perm1", "perm2", "temp1", "temp2").unionByName(
        emitted, allowMissingColumns=True)
    placed = carry_forward(
        both, ["doc_id", "program_id"], "line_no",
        {"preceding": F.when(F.col("kind").isNull(), F.col("emitted"))}, inclusive=False,
    ).where(F.col("kind").isNotNull())
    two = F.col("kind") == "bare_amendment_two_col"
    section = F.when(F.col("in_capital"), F.lit(CAPITAL)).otherwise(F.lit(OPERATING))
    single, double = "bare_amendment", "bare_amendment_two_col"
    letter = F.when(two, _group(double, 2, "raw")).otherwise(_group(single, 2, "raw"))
    rows = settle(placed, {
        "section": section,
        "department_code": F.coalesce("preceding", "context_department", F.lit("")),
        "amount1": F.when(two, _digits(_group(double, 1, "raw"))),
        "amount2": F.when(two, _digits(_group(double, 3, "raw"))).otherwise(
            _digits(_group(single, 1, "raw"))),
        "fund_type": fund_from_text(letter),
        "creates": ~two | F.col("in_capital")})
    out = []
    for n, fy in ((1, fy1), (2, fy2)):
        total, temporary = _positions(F.col(f"perm{n}"), F.col(f"temp{n}"))
        out.append(rows.where(F.col(f"amount{n}").isNotNull()).select(
            "doc_id", "program_id", "line_no", "program_name", "category", "section",
            "department_code", F.lit(fy).cast("int").alias("fiscal_year"),
            F.col(f"amount{n}").alias("amount"), "fund_type",
            total.alias("positions"), temporary.alias("positions_temp"), "creates",
            F.concat(F.when(F.col("section") == CAPITAL, F.lit("Investment Capital")).otherwise(
                F.lit("Operating")), F.lit(" - amendment from zero")).alias("notes")))
    return out[0].unionByName(out[1])


def amount_lines(lines):
    """Bill lines with amounts, with all they need from other lines, written once."""
    placed = carry_positions(classify_lines(lines))
    return cut_lineage(placed.where(F.col("kind").isin([*PAIR_KINDS, *AMENDMENT_KINDS])))


def extract_allocations(lines, fy1, fy2):
    """Allocation rows of bill lines: classify, pair, position, amend, name."""
    return allocations_of(amount_lines(lines), fy1, fy2)


def allocations_of(classified, fy1, fy2):
    """Allocation rows of the lines of :func:`amount_lines`."""
    pairs = read_pairs(classified)
    originals = cut_lineage(explode_years(pairs, fy1, fy2).drop("kind"))
    amendments = cut_lineage(read_amendments(classified, originals, fy1, fy2))
    amended = apply_amendments(originals, amendments)
    return build_allocations(amended).withColumnRenamed("line_no", "line_number")


def dedupe_large_repeats(df, scope=("doc_id",), order="line_number", threshold=LARGE_REPEAT):
    """Of equal amounts over the threshold in one program, year and section the
    first stays, whatever its fund."""
    keys = [*scope, "program_id", "fiscal_year", "section", "amount"]
    large = F.coalesce(F.col("amount") > threshold, F.lit(False))
    first = first_per_key(df.where(large), keys, [order, "fund_type"])
    return df.where(~large).unionByName(first.select(*df.columns))


def removed_repeats(df, scope=("doc_id",), order="line_number", threshold=LARGE_REPEAT):
    """What :func:`dedupe_large_repeats` takes away: per repeated amount the line that
    stays and how many rows go. Rows kept and rows removed add up to the rows given."""
    keys = [*scope, "program_id", "fiscal_year", "section", "amount"]
    return df.where(F.col("amount") > threshold).groupBy(*keys).agg(
        F.min(order).alias("kept_line"), (F.count(F.lit(1)) - 1).alias("removed")).where(F.col("removed") > 0)


def distinct_departments(df, order="line_number"):
    """First row's name per department code (ties by name).

    The first place of every distinct name is a numeric minimum, taken before
    the names themselves are compared.
    """
    places = df.groupBy("department_code", "department_name").agg(F.min(order).alias("__o"))
    return places.groupBy("department_code").agg(
        F.min_by("department_name", F.struct("__o", "department_name")).alias("department_name"))


def distinct_programs(df, order="line_number"):
    """First row's attributes per program; capital if its first row is capital."""
    facts = ["program_name", "department_code", "category", "is_capital"]
    places = df.withColumn("is_capital", F.col("section") == CAPITAL).groupBy(
        "program_id", *facts).agg(F.min(order).alias("__o"))
    return places.groupBy("program_id").agg(
        F.min_by(F.struct(*facts), F.struct("__o", *facts)).alias("r")
    ).select("program_id", "r.*")


def uncovered_money_lines(lines):
    """Lines with money that no reading rule takes, with their neighbours."""
    shown = lines.withColumn("text", _trimmed(F.col("line")))
    framed = with_neighbours(shown.select("doc_id", "line_no", "text"), ["doc_id"], "line_no",
                             ["text"])
    return framed.where(F.col("text").rlike(MONEY_LINE) & ~F.col("text").rlike(RULE_LINE))


def coverage(lines):
    """Money lines, lines read, and the share read, per document."""
    text = _trimmed(F.col("line"))
    money, ruled = text.rlike(MONEY_LINE), text.rlike(RULE_LINE)
    return lines.groupBy("doc_id").agg(
        F.count_if(money).alias("money_lines"), F.count_if(money & ruled).alias("read_lines")
    ).withColumn("coverage_pct", F.bround(
        F.col("read_lines") / F.nullif(F.col("money_lines"), F.lit(0)) * 100, 1))
