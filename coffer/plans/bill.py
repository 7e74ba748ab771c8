"""Bill documents rendered from the star schema, and the job that reads them.

The given tables hold no bill text. Rendering their sums as bill lines gives
the extraction job whole documents that grow with the tables, and an exact
expected result: the sums themselves.
"""

from pyspark.sql import functions as F

from ..operators.grants import audit_grants, extract_grants
from ..operators.lines import (
    allocations_of,
    amount_lines,
    dedupe_large_repeats,
    removed_repeats,
    unreadable_amounts,
)
from ..operators.projects import extract_projects, reconcile_projects, unreadable_project_amounts
from ..session import cut_lineage
from .testdata import table

CODES = ["AGR", "AGS", "ATG", "BED", "BUF", "CCA", "CCH", "COH", "COK", "COM", "DEF", "EDN", "GOV",
         "HHL", "HMS", "HRD", "HTH", "JUD", "LAW", "LBR", "LEG", "LNR", "LTG", "OHA", "PSD"]
FUNDS = ["A", "B", "N", "C", "W"]
BLOCK = 200
LIST_START = 1_000_000
GRANT_START = 2_000_000


def first_year(doc="doc_id"):
    """Bills are named by their first fiscal year, ``B1996``."""
    return F.substring(F.col(doc), 2, 4).cast("int")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def cells(spark, sf_dir):
    """Whole-dollar sums per bill, department, program number and fund.

    Year slots: even fiscal years are the first, odd the second. ``op`` and
    ``cap`` come from return flags N and A, ``extra`` from R.
    """
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    rows = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey")))
    year = F.year("o_orderdate") + F.when(F.month("o_orderdate") >= 7, 1).otherwise(0)
    dollars = F.floor("l_extendedprice")
    keyed = rows.select(
        F.concat(F.lit("B"), (year - year % 2).cast("string")).alias("doc_id"),
        F.col("c_nationkey").alias("k"), F.col("p_size").alias("s"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("f"),
        (year % 2).alias("slot"), "l_returnflag", "l_quantity", dollars.alias("v"))

    def total(flag, slot):
        hit = (F.col("l_returnflag") == flag) & (F.col("slot") == slot)
        return F.coalesce(F.sum(F.when(hit, F.col("v"))), F.lit(0))

    def quantity(slot):
        return F.coalesce(
            F.sum(F.when(F.col("slot") == slot, F.col("l_quantity").cast("long"))), F.lit(0))

    return keyed.groupBy("doc_id", "k", "s", "f").agg(
        total("N", 0).alias("op1"), total("N", 1).alias("op2"),
        total("A", 0).alias("cap1"), total("A", 1).alias("cap2"),
        total("R", 0).alias("extra1"), total("R", 1).alias("extra2"),
        quantity(0).alias("q1"), quantity(1).alias("q2"))


def _row(offset, text, when=None):
    line = F.struct((F.col("base") + offset).cast("long").alias("line_no"), text.alias("line"))
    return line if when is None else F.when(when, line)


def _emit(df, rows):
    return df.select("doc_id", F.inline(F.array_compact(F.array(*rows))))


def _money(value):
    return F.format_number(value, 0)


def _columns(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _named(df):
    code = _pick(CODES, F.col("k"))
    return df.withColumns({
        "code": code,
        "pid": F.concat(code, F.lpad(F.col("s").cast("string"), 3, "0")),
        "base": (F.col("k") * 50 + F.col("s")) * BLOCK})


def program_lines(cell):
    """Part II lines: headers, positions, operating, amendments, capital."""
    fund = _pick(FUNDS, F.col("f"))
    c = _named(cell).withColumn("fund", fund)
    op1, op2, cap1, cap2 = (F.col(x) for x in ("op1", "op2", "cap1", "cap2"))
    gap = "            "
    word = F.when(F.col("s") % 2 == 0, F.lit("OPERATING")).otherwise(F.lit("         "))
    both = _columns(word, gap, F.col("code"), gap, _money(op1), fund, gap, _money(op2), fund)
    first = _columns("OPERATING", gap, F.col("code"), gap, _money(op1), fund, gap, fund)
    second = _columns(gap, F.col("code"), gap, fund, gap, _money(op2), fund)
    cap_both = _columns(gap, gap, F.col("code"), gap, _money(cap1), fund, gap, _money(cap2), fund)
    cap_first = _columns(gap, gap, F.col("code"), gap, _money(cap1), fund, gap, fund)
    cap_second = _columns(gap, gap, F.col("code"), gap, fund, gap, _money(cap2), fund)
    amended = (F.col("s") % 5 == 0) & (F.col("extra2") > 0)
    op_line = F.when((op1 > 0) & (op2 > 0), both).when(op1 > 0, first).otherwise(second)
    cap_line = F.when((cap1 > 0) & (cap2 > 0), cap_both).when(cap1 > 0, cap_first).otherwise(
        cap_second)
    spot = F.col("f") * 4
    detail = _emit(c, [
        _row(spot + 10, op_line, (op1 > 0) | (op2 > 0)),
        _row(spot + 11, _columns(gap, gap, _money(F.col("extra2")), fund), amended),
        _row(spot + 51, cap_line, (cap1 > 0) | (cap2 > 0))])
    programs = _named(cell.groupBy("doc_id", "k", "s").agg(
        F.sum("q1").alias("q1"), F.sum("q2").alias("q2"),
        F.sum(F.col("cap1") + F.col("cap2")).alias("cap"),
        F.count(F.lit(1)).alias("n")))
    letter = F.char(F.lit(65) + F.col("s") % 11)
    heads = _emit(programs, [
        _row(0, _columns(letter, ". CATEGORY OF THE BILL")),
        _row(1, _columns(F.col("s").cast("string"), ". ", F.col("pid"), " - PROGRAM ",
                         F.col("pid"))),
        _row(3, _columns(gap, _money(F.col("q1")), ".00*", gap, _money(F.col("q2")), ".00*")),
        _row(4, _columns(gap, F.col("n").cast("string"), ".00#", gap, "1.50#"),
             F.col("s") % 2 == 0),
        _row(50, F.lit("INVESTMENT CAPITAL"), F.col("cap") > 0)])
    return heads.unionByName(detail)


def project_lines(cell, copies=False):
    """Project list lines from the capital sums in thousands.

    Every seventh program prints its blocks twice, the first time with other
    amounts; every fifth adds a continuation line. ``copies`` repeats titles
    later in the list under other ids.
    """
    fund = _pick(FUNDS, F.col("f"))
    c = _named(cell).withColumns({
        "fund": fund, "t1": F.floor(F.col("cap1") / 1000), "t2": F.floor(F.col("cap2") / 1000),
        "x": F.floor(F.col("extra2") / 1000)})
    c = c.withColumn("base", F.col("base") + LIST_START)
    gap = "            "

    def amount(value):
        return F.when(value > 0, F.concat(_money(value), F.lit(" "))).otherwise(F.lit(""))

    def funding(t1, t2):
        return _columns("TOTAL FUNDING", gap, F.col("code"), gap, amount(t1), fund, gap,
                        amount(t2), fund)

    number = (F.col("f") + 1).cast("string")
    header = _columns(number, ".", gap, "WORKS ", F.col("pid"), " ", fund)
    printed = (F.col("t1") > 0) | (F.col("t2") > 0)
    twice = printed & (F.col("s") % 7 == 0)
    continued = printed & (F.col("s") % 5 == 0) & (F.col("x") > 0)
    spot = F.col("f") * 10
    rows = [
        _row(spot + 1, header, twice), _row(spot + 2, funding(F.col("t1") + 1, F.col("t2")), twice),
        _row(spot + 3, header, printed), _row(spot + 4, F.lit("   PLANS AND DESIGN"), printed),
        _row(spot + 5, _columns("   FOR ", F.col("pid")), printed),
        _row(spot + 6, funding(F.col("t1"), F.col("t2")), printed),
        _row(spot + 7, _columns(gap, gap, _money(F.col("x")), " ", fund), continued)]
    if copies:
        again = printed & (F.col("s") % 3 == 0)
        title = _columns(F.lit("9"), number, ".1", gap, "WORKS ", F.col("pid"), " ", fund)
        rows += [_row(spot + 100, title, again),
                 _row(spot + 101, funding(F.col("t1"), F.col("t2")), again)]
    heads = _named(cell.select("doc_id", "k", "s").distinct()).withColumn(
        "base", F.col("base") + LIST_START)
    titles = _emit(heads, [_row(0, _columns(F.col("pid"), " - PROGRAM ", F.col("pid")))])
    marker = cell.select("doc_id").distinct().select(
        "doc_id", F.lit(LIST_START).cast("long").alias("line_no"),
        F.lit('"SECTION 14. CAPITAL IMPROVEMENT PROJECTS AUTHORIZED.').alias("line"))
    return _emit(c, rows).unionByName(titles).unionByName(marker)


def grant_lines(cell):
    """One grant block per department: declared sum, items, program codes."""
    sums = _named(cell.groupBy("doc_id", "k", "s").agg(F.sum("extra1").alias("v"))).where(
        F.col("v") > 0).withColumn(
        "base", F.lit(GRANT_START) + F.col("k") * 1000 + F.col("s") * 10)
    items = _emit(sums, [
        _row(0, _columns(F.col("s").cast("string"), ".  $", _money(F.col("v")),
                         ".00      RECIPIENT ", F.col("pid"))),
        _row(1, _columns("ADD FUNDS AS A GRANT FOR THE OFFICE (", F.col("pid"), ")"),
             F.col("s") % 3 == 0)])
    blocks = sums.groupBy("doc_id", "k", "code").agg(F.sum("v").alias("v")).withColumn(
        "base", F.lit(GRANT_START) + F.col("k") * 1000)
    year = first_year()
    heads = _emit(blocks, [_row(0, _columns(
        "SECTION ", F.col("k").cast("string"),
        ". There is appropriated out of the general revenues of the State of Hawaii the sum of $",
        _money(F.col("v")), " or so much there-of as may be necessary for fiscal year ",
        year.cast("string"), "-", (year + 1).cast("string"), " to the office (", F.col("code"),
        "900)"))])
    return heads.unionByName(items)


def bill_lines(spark, sf_dir):
    """All lines of all bills."""
    cell = cut_lineage(cells(spark, sf_dir))
    return program_lines(cell).unionByName(project_lines(cell)).unionByName(grant_lines(cell))


def bill_findings(amounts, allocations, lines):
    """What the reading job could not read or took away, one row each: ``doc_id``,
    ``line_no``, ``finding``, ``detail`` and the number of ``rows`` it stands for."""
    wide = unreadable_amounts(amounts).select("doc_id", "line_no", "number").unionByName(
        unreadable_project_amounts(lines))
    repeats = removed_repeats(allocations)
    return wide.select(
        "doc_id", "line_no", F.lit("unreadable amount").alias("finding"), F.col("number").alias("detail"),
        F.lit(1).cast("long").alias("rows")).unionByName(repeats.select(
            "doc_id", F.col("kept_line").alias("line_no"), F.lit("repeated large amount").alias("finding"),
            F.concat_ws(" ", "program_id", "section", F.col("fiscal_year").cast("string"),
                        F.col("amount").cast("string")).alias("detail"),
            F.col("removed").alias("rows")))


def parse_bills(lines, fy1=None, fy2=None):
    """The whole reading job: allocations, reconciled projects, grants, audit, findings.

    Results that later steps read more than once are written to the shared checkpoint
    folder. ``findings`` holds what could not be read and the repeats taken out: allocation
    rows read are those kept and those that ``findings`` counts.
    """
    fy1 = first_year() if fy1 is None else fy1
    fy2 = first_year() + 1 if fy2 is None else fy2
    amounts = amount_lines(lines)
    read = cut_lineage(allocations_of(amounts, fy1, fy2))
    allocations = dedupe_large_repeats(read)
    projects = cut_lineage(extract_projects(lines, fy1, fy2))
    grants = extract_grants(lines, allocations)
    return {
        "allocations": allocations,
        "projects": reconcile_projects(projects, allocations),
        "grants": grants,
        "grant_audit": audit_grants(lines, grants),
        "findings": bill_findings(amounts, read, lines),
    }
