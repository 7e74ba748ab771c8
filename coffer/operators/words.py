"""Positional words to rows: ``doc_id``, ``page``, ``x0``, ``x1``, ``top``, ``text``.

Words are grouped by document, page and line. A page holds what fits on a
sheet of paper, so page-sized groups are the unit of work and stay small
however large a document is; context that runs across pages is carried in
chunks.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parse_money
from ..schema import CAPITAL, MONEY, OPERATING
from ..session import cut_lineage
from .lines import _positions
from .ordered import carry_forward, settle

PAGE = ["doc_id", "page"]
LINE_SPAN = 1_000_000_000


def line_tops(words, mode="tolerance", tolerance=2.0):
    """Add ``line_top``, the line a word belongs to.

    ``thirds`` rounds the top to multiples of 3, ``round`` to 1, ``tolerance``
    opens a new line when a word lies further than the tolerance below the
    first word of the current one.
    """
    if mode == "thirds":
        return words.withColumn("line_top", (F.bround(F.col("top") / 3) * 3).cast("double"))
    if mode == "round":
        return words.withColumn("line_top", F.bround("top").cast("double"))
    rest = [c for c in words.columns if c not in (*PAGE, "top")]
    return _page_lines(words, rest, tolerance).select(*PAGE, "line_top", F.inline("words")).select(
        *words.columns, "line_top")


def _page_lines(words, columns, tolerance):
    """Lines of every page: ``line_top`` and ``words`` (``top`` and the columns) from the top down.

    The words of a page come together once, in order of their tops; one pass over the different
    tops finds where lines begin, and nothing is joined back. A page without a place or a word
    without a top is left out.
    """
    placed = words.where(F.col("top").isNotNull() & F.col("doc_id").isNotNull() & F.col("page").isNotNull())
    pages = placed.groupBy(*PAGE).agg(F.sort_array(F.collect_list(
        F.struct(F.col("top").cast("double").alias("top"), *columns))).alias("__words"))
    tops = F.transform("__words", lambda w: w["top"])

    def step(anchors, top):
        anchor = F.try_element_at(anchors, F.lit(-1))
        same = (top == anchor) | (F.abs(top - anchor) <= tolerance)
        return F.when(same, anchors).otherwise(F.concat(anchors, F.array(top)))

    begins = F.aggregate(F.array_distinct("__tops"), F.array().cast("array<double>"), step)
    cut = settle(settle(pages, {"__tops": tops}), {"__begins": begins})

    def line(begin, i):
        at = F.array_position("__tops", begin).cast("int")
        end = F.coalesce(F.array_position("__tops", F.get("__begins", i + 1)).cast("int"), F.size("__words") + 1)
        return F.struct(begin.alias("line_top"), F.slice("__words", at, end - at).alias("words"))

    return cut.select(*PAGE, F.inline(F.transform("__begins", line)))


def word_lines(words, mode="tolerance", tolerance=2.0):
    """One row per line with its words in x order and the joined text.

    ``line_no`` grows through the pages of a document.
    """
    if mode == "tolerance":
        lines = _page_lines(words, ["x0", "x1", "text"], tolerance).withColumn(
            "words", F.sort_array(F.transform(
                "words", lambda w: F.struct(w["x0"].alias("x0"), w["x1"].alias("x1"), w["text"].alias("text")))))
    else:
        lines = line_tops(words, mode).groupBy(*PAGE, "line_top").agg(
            F.sort_array(F.collect_list(F.struct("x0", "x1", "text"))).alias("words"))
    number = (F.col("page") * LINE_SPAN + F.floor(F.col("line_top") * 10)).cast("long")
    return lines.select(
        *PAGE, "line_top", number.alias("line_no"), "words",
        F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("line"))


def header_edges(words, expected, band):
    """Right edges of the header labels of every page, one array a page.

    ``expected`` lists the labels in order. Words of the band are taken in x
    order and matched greedily, one by one only where they are not just the labels expected;
    pages without the full sequence are left out.
    """
    header = words.where(F.col("text").isin(list(set(expected))) & (F.col("top") < band))
    listed = header.groupBy(*PAGE).agg(
        F.sort_array(F.collect_list(F.struct("x0", "x1", "text"))).alias("labels"))
    wanted = F.array(*[F.lit(e) for e in expected])
    start = F.array().cast("array<double>")

    def step(acc, label):
        due = F.try_element_at(wanted, F.size(acc) + 1)
        return F.when(due == label["text"], F.concat(acc, F.array(label["x1"]))).otherwise(acc)

    edges = F.when(F.col("labels")["text"] == wanted, F.col("labels")["x1"].cast("array<double>")).otherwise(
        F.aggregate("labels", start, step))
    return settle(listed.where(F.size("labels") >= len(expected)), {"edges": edges}).where(
        F.size("edges") == len(expected)).select(*PAGE, "edges")


def header_columns(words, expected, band):
    """Column edges from header labels (see :func:`header_edges`), a row each."""
    return header_edges(words, expected, band).select(*PAGE, F.posexplode("edges").alias("ordinal", "edge"))


def nearest_column(numbers, columns, x="x1", edge="edge", offset=17.0, tolerance=25.0):
    """Nearest column of every number on its page, within the tolerance.

    ``columns`` has a few rows per page (``ordinal``, ``edge``). They are kept
    as one short array per page, so a number meets the list, not a row each.
    Ties go to the left column; the first number of a column on a line wins.
    """
    lists = columns.groupBy(*PAGE).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", edge))).alias("cols"))
    paired = numbers.join(lists, PAGE)
    best = F.array_min(F.transform("cols", lambda c: F.struct(
        F.abs(c[edge] + offset - F.col(x)).alias("gap"), c["ordinal"].alias("ordinal"))))
    assigned = paired.withColumn("best", best).where(F.col("best.gap") <= tolerance)
    keys = [*PAGE, "line_top"]
    return assigned.groupBy(*keys, F.col("best.ordinal").alias("ordinal")).agg(
        F.min_by("value", F.struct("x0")).alias("value"))


def merge_fragments(lines, gap=3.0):
    """Join ``2,291,`` and ``122`` on a line: a trailing comma, then digits.

    A joined word ends in a digit, so no join depends on another one: each word looks at
    its two neighbours in the line's array, which takes time in proportion to its length.
    """
    source = F.transform("words", lambda w: F.struct(
        w["x0"].cast("double").alias("x0"), w["x1"].cast("double").alias("x1"),
        w["text"].alias("text")))

    def joins(left, right):
        return F.coalesce(
            left["text"].endswith(",") & right["text"].rlike(r"^\d+$") & (right["x0"] - left["x1"] < gap),
            F.lit(False))

    def joined(word, i):
        before, after = F.get("__words", i - 1), F.get("__words", i + 1)
        whole = F.struct(word["x0"].alias("x0"), after["x1"].alias("x1"),
                         F.concat(word["text"], after["text"]).alias("text"))
        return F.when(joins(before, word), None).when(joins(word, after), whole).otherwise(word)

    rows = settle(lines, {"__words": source})
    merged = F.filter(F.transform("__words", joined), lambda w: w.isNotNull())
    broken = F.exists("__words", lambda w: w["text"].endswith(","))
    out = settle(rows, {"__merged": F.when(broken, merged).otherwise(F.col("__words"))})
    out = out.withColumn("words", F.col("__merged")).drop("__merged", "__words")
    return out.withColumn("line", F.array_join(F.transform("words", lambda w: w["text"]), " "))


def line_numbers(lines, style="decorated"):
    """Numbers of each line with their position."""
    words = lines.select(*PAGE, "line_top", "line_no", F.inline("words"))
    return words.withColumn("value", parse_money(F.col("text"), style)).where(
        F.col("value").isNotNull())


def column_values(lines, edges, names, style="decorated", offset=17.0, tolerance=25.0):
    """Lines with one value column per named table column.

    Works inside each line: its words, fragments joined, meet the short list of the page's
    ``edges``, so rows are neither multiplied nor joined back.
    """
    with_edges = lines.join(edges, PAGE, "left")

    read = F.transform("words", lambda w: F.struct(parse_money(w["text"], style).alias("v"), w["x1"].alias("x1")))
    far = F.transform(F.filter(read, lambda n: n["v"].isNotNull()), lambda n: F.struct(
        n["v"].alias("v"), F.transform("edges", lambda e: F.abs(e + offset - n["x1"])).alias("gaps")))
    nearest = F.transform(far, lambda n: F.struct(
        n["v"].alias("v"), F.array_min(n["gaps"]).alias("gap"),
        F.array_position(n["gaps"], F.array_min(n["gaps"])).alias("column")))
    with_numbers = settle(with_edges, {"numbers": F.filter(nearest, lambda n: n["gap"] <= tolerance)})

    def first_in(ordinal):
        at = F.array_position(F.col("numbers")["column"], F.lit(ordinal + 1).cast("long"))
        return F.try_element_at(F.col("numbers")["v"], F.nullif(at, F.lit(0)).cast("int"))

    return with_numbers.withColumns(
        {n: first_in(i) for i, n in enumerate(names)}).drop("edges", "numbers")


def recommended(prefix):
    """Recommended amount, else current plus adjustment, else current, else 0."""
    curr = F.coalesce(F.col(f"{prefix}_curr"), F.lit(0))
    return F.coalesce(
        F.col(f"{prefix}_rec"), curr + F.col(f"{prefix}_adj"), curr).cast(MONEY)


REQUEST_LABELS = ["APPRN", "ADJUSTMENT", "APPRN", "APPRN", "ADJUSTMENT", "APPRN"]
REQUEST_COLUMNS = ["fy1_curr", "fy1_adj", "fy1_rec", "fy2_curr", "fy2_adj", "fy2_rec"]


def _fund_of(line, funds):
    """First listed fund whose label occurs in the line (longest first)."""
    out = F.lit(None).cast("string")
    for label, letter in reversed(funds):
        out = F.when(line.contains(label), F.lit(letter)).otherwise(out)
    return out


def request_rows(words, programs, funds, labels=None, band=150):
    """Fund rows of request tables per program, section and page.

    ``programs`` names the program of each page. The section is carried from
    page to page within a program; capital fund rows count only after the
    capital total line, and nothing after the program total.
    """
    labels = labels or REQUEST_LABELS + ["BIENNIUM", "BIENNIUM", "CHANGE"]
    upper = F.upper("line")
    event = (
        F.when(upper.contains("CAPITAL INVESTMENT"), F.lit("capital"))
        .when(upper.contains("TOTAL CAPITAL COST"), F.lit("capital_funds"))
        .when(upper.contains("TOTAL PROGRAM COST"), F.lit("end"))
        .when(upper.rlike(r"\bOPERATING\b") & ~upper.contains("TOTAL"), F.lit("operating")))
    marked = settle(merge_fragments(word_lines(words)), {"event": event, "letter": _fund_of(upper, funds)})
    # only lines that open a section or name a fund have their numbers read, and are written without their words
    placed = column_values(marked.where("event IS NOT NULL OR letter IS NOT NULL"),
                           header_edges(words, labels, band), REQUEST_COLUMNS)
    lines = cut_lineage(placed.join(programs, PAGE).select(
        "doc_id", "page", "program_id", "line_no", "event", "letter", *REQUEST_COLUMNS))
    state = carry_forward(
        lines, ["doc_id", "program_id"], "line_no",
        {"state": F.when(F.col("event").isNotNull(), F.struct(F.col("event").alias("s"), "page"))})
    section = F.when(F.col("state.s").isin("capital", "capital_funds"), F.lit(CAPITAL)).otherwise(
        F.lit(OPERATING))
    inside = F.coalesce(
        ~F.col("state.s").isin("capital", "end")
        | ((F.col("state.s") == "end") & (F.col("state.page") < F.col("page"))), F.lit(True))
    rows = state.where(inside & F.col("letter").isNotNull()).select(
        "doc_id", "page", "program_id", "line_no", section.alias("section"),
        F.col("letter").alias("fund_type"), recommended("fy1").alias("amount1"),
        recommended("fy2").alias("amount2"))
    return rows.where((F.col("amount1") != 0) | (F.col("amount2") != 0))


PROJECT_CODE = r"^[A-Z0-9.]{1,8}$"
COST_WORDS = ["PLANS", "LAND", "DESIGN", "CONSTRUCTION", "EQUIPMENT", "LUMP", "TOTAL", "COST",
              "PROGRAM", "PROJECT"]


def request_projects(words, programs, funds, band=170):
    """Fund rows of project request pages, thousands to dollars.

    A header starts flush left with a short code and has a title; its fund
    rows follow until the next header or the program totals.
    """
    first = F.element_at("words", 1)
    titled = F.exists(F.slice("words", F.lit(2), F.size("words")), lambda w: ~w["text"].rlike(r"^-?[\d,]+$"))
    header = (first["text"].rlike(PROJECT_CODE) & ~first["text"].isin(COST_WORDS) & titled
              & (first["x0"] <= 90))
    totals = F.upper("line").contains("PROGRAM TOTALS")
    title = F.regexp_replace("line", r"^\S+\s+(?:\d{1,2}\s+)?", "")
    marked = settle(merge_fragments(word_lines(words)), {
        "header": header, "totals": totals, "code": first["text"], "title": title,
        "letter": _fund_of(F.upper("line"), funds)})
    # only headers, totals and lines that name a fund have their numbers read
    placed = column_values(marked.where("header OR totals OR letter IS NOT NULL"),
                           header_edges(words, REQUEST_LABELS, band), REQUEST_COLUMNS)
    event = F.when(F.col("totals"), F.struct(F.lit(None).cast("string").alias("id"),
                                             F.lit(None).cast("string").alias("name"))).when(
        F.col("header"), F.struct(F.col("code").alias("id"), F.col("title").alias("name")))
    # a page is small and already in one place: its lines need no chunks
    above = W.partitionBy(*PAGE, "program_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    carried = placed.drop("words").join(programs, PAGE).withColumn("project", F.last(event, ignorenulls=True).over(above))
    rows = carried.where(
        ~F.col("header") & F.col("project.id").isNotNull() & F.col("letter").isNotNull()).select(
        "doc_id", "page", "program_id", F.col("project.id").alias("project_id"),
        F.col("project.name").alias("project_name"), F.col("letter").alias("fund_type"),
        (recommended("fy1") * 1000).cast(MONEY).alias("amount1"),
        (recommended("fy2") * 1000).cast(MONEY).alias("amount2"))
    return rows.where((F.col("amount1") != 0) | (F.col("amount2") != 0))


def position_totals(lines, names=("fy1", "fy2")):
    """Permanent and temporary totals per program with the NULL rule.

    ``lines`` carries ``program_id``, the line text and the named value columns.
    """
    upper = F.upper("line")
    perm, temp = upper.contains("TOTAL PERM POSITIONS"), upper.contains("TOTAL TEMP POSITIONS")
    sums = lines.groupBy("program_id").agg(*[
        F.max_by(n, F.when(flag, F.col("line_no"))).alias(f"{kind}_{n}")
        for n in names for kind, flag in (("perm", perm), ("temp", temp))])
    out = []
    for n in names:
        total, temporary = _positions(F.col(f"perm_{n}"), F.col(f"temp_{n}"))
        out += [total.alias(f"positions_{n}"), temporary.alias(f"positions_temp_{n}")]
    return sums.select("program_id", *out)


def request_rollup(rows, positions=None):
    """Request sums per program, fund and section, with positions attached."""
    sums = rows.groupBy("department_code", "program_id", "fund_type", "section").agg(
        F.sum("amount1").alias("amount1"), F.sum("amount2").alias("amount2"))
    return sums if positions is None else sums.join(positions, "program_id", "left")


def star_tree(lines, order="line_no", keys=("doc_id",)):
    """Subtotal lines marked by stars to department and program rows.

    ``*`` lines are programs of the next ``**`` department; what the
    department has beyond them, if over 1, becomes ``Other``. A department
    without programs is one row. ``***`` lines name the fund of the account
    lines before them. Needs ``stars``, ``name``, ``amount`` and ``fund`` (set
    on account lines). The next department is found by carrying backwards.
    """
    keys = list(keys)
    event = F.when(F.col("stars") == 2, F.struct(
        F.col(order).alias("at"), F.col("name").alias("name"), F.col("amount").alias("amount")))
    fund = F.when(F.col("fund").isNotNull(), F.struct("fund"))
    flipped = lines.withColumn("__back", -F.col(order))
    ahead = carry_forward(flipped, keys, "__back", {"dept": event})
    both = carry_forward(ahead, keys, order, {"in_fund": fund})
    names = both.where(F.col("stars") == 3).groupBy(*keys, F.col("in_fund.fund").alias("fund")).agg(
        F.max_by("name", order).alias("fund_name"))
    own_fund = both.where(F.col("stars") == 2).select(
        *keys, F.col(order).alias("at"), F.col("in_fund.fund").alias("fund"), "name", "amount")
    programs = both.where((F.col("stars") == 1) & F.col("dept").isNotNull()).select(
        *keys, F.col("dept.at").alias("at"), F.col("name").alias("program_name"),
        F.col("amount").alias("part"))
    sums = programs.groupBy(*keys, "at").agg(F.sum("part").alias("parts"))
    depts = own_fund.join(sums, [*keys, "at"], "left")
    rest = F.col("amount") - F.col("parts")
    whole = depts.where(F.col("parts").isNull()).select(
        *keys, "fund", F.col("name").alias("department_name"),
        F.lit(None).cast("string").alias("program_name"), "amount")
    other = depts.where(F.abs(rest) > 1).select(
        *keys, "fund", F.col("name").alias("department_name"), F.lit("Other").alias("program_name"),
        rest.alias("amount"))
    listed = programs.join(own_fund.drop("amount"), [*keys, "at"]).select(
        *keys, "fund", F.col("name").alias("department_name"), "program_name",
        F.col("part").alias("amount"))
    rows = whole.unionByName(other).unionByName(listed)
    return rows.join(names, [*keys, "fund"], "left").withColumn(
        "fund_name", F.coalesce("fund_name", F.concat(F.lit("Fund "), "fund")))


_LAST_AMOUNT = r"(\(?[\d,]*\d[\d,]*\)?)"


def fund_section_rows(lines, funds, code=r"\b([A-Z]{1,3}-?\d{2,4}[A-Z0-9-]*|NEW)\b"):
    """Project rows under capital fund headers; the last amount is the value.

    ``funds`` lists (keyword, name) pairs. A fund header may be wrapped, its second
    line being the one that says FUND, and may be repeated as continued. A name
    missing before the project code is the previous line.
    """
    text = F.trim("line")
    shown = lines.where(text != "").withColumn("text", text)
    header = F.col("text").rlike(r"^[A-Z][A-Z .,&'\u2018\u2019()/-]*$")
    total = F.col("text").rlike(r"^(SUB)?TOTAL|Appropriation|Ordinance")

    def named(column):
        name = F.lit(None).cast("string")
        for keyword, label in reversed(funds):
            name = F.when(F.upper(column).contains(keyword), F.lit(label)).otherwise(name)
        return name

    # Only header and total lines can lend their text to a wrapped header or a nameless row.
    placed = carry_forward(shown, ["doc_id"], "line_no",
                           {"prev": F.when(header | total, F.struct("text"))}, inclusive=False)
    above = F.coalesce("prev.text", F.lit(""))
    says = F.col("text").contains("FUND")
    wrapped = F.when(says & ~above.contains("FUND"), F.concat_ws(" ", above, "text"))
    fund = F.when(header & (says | F.lower("text").contains("(cont")),
                  F.coalesce(named(F.col("text")), named(wrapped)))
    carried = carry_forward(
        placed.withColumn("own_fund", fund), ["doc_id"], "line_no",
        {"fund": F.when(F.col("own_fund").isNotNull(), F.struct("own_fund"))}, inclusive=False)
    amounts = F.regexp_extract_all("text", F.lit(_LAST_AMOUNT), F.lit(1))
    last = F.regexp_replace(F.regexp_replace(
        F.try_element_at(amounts, F.lit(-1)), r"\(", "-"), r"[,)]", "").try_cast(MONEY)
    before = F.trim(F.regexp_extract("text", r"^(.*?)" + code, 1))
    rows = carried.where(~header & ~total & F.col("text").rlike(code)).select(
        "doc_id", "line_no", F.col("fund.own_fund").alias("fund_name"),
        F.coalesce(F.nullif(before, F.lit("")), F.col("prev.text")).alias("program_name"),
        last.alias("amount"))
    return rows.where(F.col("fund_name").isNotNull() & (F.col("amount") != 0)
                      & (F.coalesce("program_name", F.lit("")) != ""))


def banded_projects(lines, functions, name_edge=345, code_band=(470, 506),
                    amount_band=(426, 468), total_edge=505, least_amount=0, least_total=0):
    """Capital source lines by x band: name, fund code, amount, carried section.

    The amount may stand on the line before; a line with an all-funds total
    and a name opens a project. Numbers below the least values are no amounts.
    """
    def amount(w):
        return parse_money(w["text"], "ocr")

    def in_band(w, band):
        return (w["x0"] >= band[0]) & (w["x0"] <= band[1])

    name = F.trim(F.array_join(F.transform(
        F.filter("words", lambda w: (w["x0"] < name_edge) & amount(w).isNull()),
        lambda w: w["text"]), " "))
    codes = F.filter("words", lambda w: in_band(w, code_band) & (F.length(w["text"]) <= 4)
                     & ~w["text"].contains(",") & ~w["text"].rlike(r"^\d{3,}$"))
    amounts = F.filter("words", lambda w: in_band(w, amount_band) & (F.abs(amount(w)) >= least_amount))
    totals = F.filter("words", lambda w: (w["x0"] >= total_edge) & (F.abs(amount(w)) >= least_total))
    shaped = lines.withColumns({
        "name": name, "code": F.try_element_at(codes, F.lit(-1))["text"],
        "amount": parse_money(F.try_element_at(amounts, F.lit(-1))["text"], "ocr"),
        "total": parse_money(F.try_element_at(totals, F.lit(-1))["text"], "ocr")})
    squeezed = F.replace(F.upper("name"), F.lit(" "), F.lit(""))
    section = F.lit(None).cast("string")
    for f in reversed(functions):
        section = F.when(squeezed.contains(f.replace(" ", "")), F.initcap(F.lit(f))).otherwise(
            section)
    opens = section.isNotNull() & F.col("amount").isNull() & F.col("total").isNull()
    label = squeezed.startswith("TOTAL") | squeezed.contains("SOURCEOFFUNDS") | squeezed.contains(
        "WORKPHASE")
    project = F.nullif(F.trim(F.regexp_replace("name", r"^\d{7}\s*", "")), F.lit(""))
    named = ~opens & ~label & F.col("total").isNotNull() & project.isNotNull()
    carried = carry_forward(
        shaped, ["doc_id"], "line_no",
        {"function": F.when(opens, F.struct(section.alias("f"))),
         "project": F.when(named, F.struct(project.alias("p")))})
    with_previous = carry_forward(
        carried, PAGE, "line_no", {"before": F.struct(F.col("amount").alias("a"))},
        inclusive=False)
    value = F.coalesce("amount", F.col("before.a"))
    rows = with_previous.where(
        ~opens & ~label & F.col("code").isNotNull() & (value != 0)).select(
        "doc_id", "page", "line_no",
        F.coalesce(F.col("function.f"), F.lit("General Government")).alias("department_name"),
        F.coalesce(F.col("project.p"), F.lit("Capital Projects")).alias("program_name"),
        "code", value.alias("amount"))
    return rows


def span_between(lines, opens, closes, keys=("doc_id",)):
    """Lines strictly between an opening and the next closing line."""
    text = F.trim("line")
    event = F.when(text.rlike(opens), F.struct(F.lit(True).alias("o"))).when(
        text.rlike(closes), F.struct(F.lit(False).alias("o")))
    carried = carry_forward(lines, list(keys), "line_no", {"__span": event})
    return carried.where(F.coalesce(F.col("__span.o"), F.lit(False)) & ~text.rlike(opens)).drop(
        "__span")


def department_table(lines, opens, closes, primary_fund, default_fund, money=r"(\(?\$[\d,.]+\)?)"):
    """Department lines of a table; the last money value in thousands counts."""
    rows = span_between(lines, opens, closes).withColumn(
        "values", F.regexp_extract_all("line", F.lit(money), F.lit(1)))
    name = F.trim(F.regexp_replace(
        F.trim(F.substring_index("line", "$", 1)), r"[123 ]+$", ""))
    value = parse_money(F.try_element_at("values", F.lit(-1)), "thousands")
    fund = F.lit(default_fund)
    for department, label in primary_fund.items():
        fund = F.when(F.col("department_name") == department, F.lit(label)).otherwise(fund)
    return rows.where(F.size("values") >= 2).select(
        "doc_id", "line_no", name.alias("department_name"), value.alias("amount")).where(
        (F.col("department_name") != "") & (F.col("amount") != 0)).withColumn("fund_name", fund)


def project_sheet(lines, opens, closes, row, funds, name_mark=r"CBS-\d+", footer="MAYOR"):
    """Project sheet rows: wrapped name fragments joined to the next code row.

    ``row`` captures prefix, fund code and amount. A row whose prefix holds
    the mark starts a project; its name is the fragments since the previous
    row plus what follows the mark.
    """
    inside = span_between(lines, opens, closes)
    text = F.trim("line")
    is_row = text.rlike(row)
    fragment = ~is_row & (text != "") & ~text.contains(footer) & ~text.startswith("FISCAL YEAR")
    flipped = inside.withColumn("__back", -F.col("line_no"))
    ahead = carry_forward(
        flipped, ["doc_id"], "__back", {"next_row": F.when(is_row, F.struct("line_no"))}).drop(
        "__back")
    # fragments after the last row belong to none
    pieces = ahead.where(fragment & F.col("next_row.line_no").isNotNull()).groupBy(
        "doc_id", F.col("next_row.line_no").alias("line_no")).agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("n"),
                                                 text.alias("t")))), lambda s: s["t"]),
            " ").alias("wrapped"))
    prefix, code = F.regexp_extract(text, row, 1), F.regexp_extract(text, row, 2)
    amount = F.replace(F.regexp_extract(text, row, 3), F.lit(","), F.lit("")).try_cast(MONEY)
    rows = inside.where(is_row).join(pieces, ["doc_id", "line_no"], "left")
    starts = prefix.rlike(name_mark)
    tail = F.trim(F.regexp_extract(prefix, name_mark + r"(.*)$", 1))
    name = F.trim(F.regexp_replace(F.concat_ws(" ", "wrapped", tail), r"\s+", " "))
    carried = carry_forward(
        rows, ["doc_id"], "line_no",
        {"project": F.when(starts, F.struct(
            F.coalesce(F.nullif(name, F.lit("")), F.lit("(unnamed project)")).alias("name")))})
    known = F.lit(None).cast("string")
    for letter, label in funds.items():
        known = F.when(F.col("code") == letter, F.lit(label)).otherwise(known)
    return carried.select(
        "doc_id", "line_no", F.col("project.name").alias("program_name"), code.alias("code"),
        (amount * 1000).cast(MONEY).alias("amount")).withColumn("fund_name", known).where(
        F.col("fund_name").isNotNull() & (F.col("amount") != 0))


def fund_summary(lines, keywords, column, opens=r"(?i)^fund.*proposed",
                 closes=r"(?i)^(total|section|part )"):
    """Fund lines by ordered keywords; the first line of a fund counts."""
    squeezed = F.replace(F.lower("line"), F.lit(" "), F.lit(""))
    name = F.lit(None).cast("string")
    for keyword, label in reversed(keywords):
        name = F.when(squeezed.contains(keyword), F.lit(label)).otherwise(name)
    numbers = F.regexp_extract_all("line", F.lit(r"(\d{1,3}(?:,\d{3})+|\d+)"), F.lit(1))
    value = F.replace(F.try_element_at("numbers", F.lit(column + 1)), F.lit(","),
                      F.lit("")).try_cast(MONEY) * 1000
    rows = span_between(lines, opens, closes).withColumns({"fund_name": name, "numbers": numbers})
    return rows.where(F.col("fund_name").isNotNull() & (F.size("numbers") >= 2)).groupBy(
        "doc_id", "fund_name").agg(F.min_by(value.cast(MONEY), "line_no").alias("amount")).where(
        F.col("amount") != 0)


_SCHEDULE_VALUE = r"^\(?-?[\d,]+\)?$|^[-–—]$"


def schedule_rows(lines, opens=r"^Department$", closes=r"^Total expenditures",
                  keys=("doc_id",)):
    """Department lines of a schedule: a name and the last four values.

    A document's schedule ends for good at its first closing line.
    """
    keys, text = list(keys), F.trim("line")
    begins = lines.where(text.rlike(opens)).groupBy(*keys).agg(F.min("line_no").alias("__begin"))
    ends = lines.where(text.rlike(closes)).select(*keys, F.col("line_no").alias("__end"))
    last = ends.join(begins, keys).where("__end > __begin").groupBy(*keys).agg(
        F.min("__end").alias("__end"))
    inside = span_between(lines, opens, closes, keys).join(last, keys, "left").where(
        "__end IS NULL OR line_no < __end")
    tokens = F.filter(F.split(F.trim("line"), r"\s+"), lambda t: t != "$")
    shaped = inside.withColumn("tokens", tokens).where(F.size("tokens") >= 5)
    values = F.slice("tokens", -4, 4)
    shaped = shaped.withColumn("values", values).where(
        F.forall("values", lambda v: v.rlike(_SCHEDULE_VALUE)))
    name = F.array_join(F.slice("tokens", F.lit(1), F.greatest(F.size("tokens") - 4, F.lit(0))), " ")
    columns = ["original", "final", "actual", "printed_variance"]
    return shaped.select(
        *keys, "line_no", name.alias("department_name"),
        *[(parse_money(F.element_at("values", i + 1), "schedule") * 1000).cast(MONEY).alias(c)
          for i, c in enumerate(columns)]).where(
        (F.col("department_name") != "") & ~F.lower("department_name").startswith("total"))


def band_values(lines, bands, tolerance=45.0, skip=r"^20\d{2}$"):
    """Numbers of a line by nearest named band (name, centre x).

    All fragments with a digit in one band are one number, read from left to right;
    texts that match ``skip`` (the year) are none.
    """
    pieces = lines.select(*PAGE, "line_top", F.inline("words")).withColumn("text", F.trim("text"))
    pieces = pieces.where(F.col("text").rlike(r"\d") & ~F.col("text").rlike(skip))
    gaps = F.array(*[F.struct(F.abs(F.col("x0") - x).alias("gap"), F.lit(n).alias("band"))
                     for n, x in bands])
    best = F.array_min(gaps)
    # Ties go to the first listed band through its position in the list.
    parts = pieces.withColumn("best", best).where(F.col("best.gap") <= tolerance).groupBy(
        *PAGE, "line_top", F.col("best.band").alias("band")).agg(
        F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return parts.select(*PAGE, "line_top", "band", parse_money(text, "band").alias("value")).where(
        F.col("value").isNotNull())


def stacked_blocks(lines, blocks, years, starts="FY 20", band=340):
    """Block and year of the yearly lines by their order down the page."""
    yearly = lines.where((F.col("line_top") < band) & F.col("line").startswith(starts))
    n = F.row_number().over(W.partitionBy(*PAGE).orderBy("line_top")) - 1
    block = F.element_at(F.array(*[F.lit(b) for b in blocks]),
                         (F.floor(n / len(years)) + 1).cast("int"))
    year = F.element_at(F.array(*[F.lit(y) for y in years]), (n % len(years) + 1).cast("int"))
    return yearly.withColumns({"block": block, "fiscal_year": year})


def revenue_rows(lines, year_columns, label_edge=270.0, tolerance=26.0):
    """Label left of the edge and the number nearest the year's column.

    ``year_columns`` has ``fiscal_year`` and ``centre`` per page.
    """
    label = F.trim(F.regexp_replace(F.trim(F.array_join(F.transform(
        F.filter("words", lambda w: (w["x1"] < label_edge) & w["text"].rlike("[A-Za-z]")),
        lambda w: w["text"]), " ")), r"\*+$", ""))
    rows = lines.withColumn("source", label).where(
        (F.col("source") != "") & ~F.col("source").contains("FY"))
    cells = rows.select(*PAGE, "line_no", "source", F.inline("words")).withColumn(
        "digits", F.regexp_replace("text", r"[,$]", "")).where(F.col("digits").rlike(r"^\d{2,}$"))
    near = cells.join(year_columns, PAGE).where(
        F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("centre")) < tolerance)
    return near.groupBy("doc_id", "fiscal_year", "source").agg(
        F.max_by((F.col("digits").try_cast(MONEY) * 1000).cast(MONEY),
                 F.struct("line_no", "x0")).alias("amount"))


def account_lines(lines, account=r"^(\d{3})-", left=60):
    """Star lines and account lines of a worksheet, ready for the star tree."""
    first = F.element_at("words", 1)
    starred = first["text"].rlike(r"^\*{1,3}$") & (first["x0"] <= left)
    values = F.filter(F.transform(F.slice("words", F.lit(2), F.size("words")), lambda w: F.struct(
        w["x1"].alias("x1"), parse_money(w["text"], "credit").alias("v"))),
        lambda s: s["v"].isNotNull())
    plain = F.filter(F.slice("words", F.lit(2), F.size("words")),
                     lambda w: parse_money(w["text"], "credit").isNull())
    fund = F.nullif(F.regexp_extract("line", account, 1), F.lit(""))
    out = lines.select(
        "doc_id", "line_no",
        F.when(starred & (F.size(values) > 0), F.length(first["text"])).alias("stars"),
        F.array_join(F.transform(plain, lambda w: w["text"]), " ").alias("name"),
        F.array_max(values)["v"].alias("amount"), fund.alias("fund"))
    return out.where(F.col("stars").isNotNull() | F.col("fund").isNotNull())
