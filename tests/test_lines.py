"""Bill lines: single shapes, carried context and amendments."""

import pytest
from pyspark.sql import functions as F

from coffer.operators import lines as L


def document(spark, text, doc="d"):
    return spark.createDataFrame(
        [(doc, i + 1, line) for i, line in enumerate(text.split("\n"))],
        "doc_id string, line_no long, line string")


def read(spark, text, fy1=2026, fy2=2027):
    rows = L.extract_allocations(document(spark, text), fy1, fy2).collect()
    return {(r.program_id, r.department_code, r.section, r.fund_type, r.fiscal_year):
            float(r.amount) for r in rows}, rows


OP, CAP = "Operating", "Capital Improvement"


def test_two_programs_with_context(spark):
    got, rows = read(spark, """B. EMPLOYMENT
1. LBR111 - WORKFORCE DEVELOPMENT
OPERATING LBR 4,500,000A 4,600,000A
LBR 2,200,000N 2,300,000N
C. TRANSPORTATION
2. TRN195 - AIRPORTS
LBR 10B 20B
INVESTMENT CAPITAL TRN 200,000,000C 150,000,000C""", 2028, 2029)
    assert got == {
        ("LBR111", "LBR", OP, "A", 2028): 4500000, ("LBR111", "LBR", OP, "A", 2029): 4600000,
        ("LBR111", "LBR", OP, "N", 2028): 2200000, ("LBR111", "LBR", OP, "N", 2029): 2300000,
        ("TRN195", "LBR", OP, "B", 2028): 10, ("TRN195", "LBR", OP, "B", 2029): 20,
        ("TRN195", "TRN", CAP, "C", 2028): 200000000,
        ("TRN195", "TRN", CAP, "C", 2029): 150000000}
    assert {(r.program_id, r.category) for r in rows} == {
        ("LBR111", "Employment"), ("TRN195", "Transportation")}


@pytest.mark.parametrize("line, want", [
    ("                                  AGR                 P       164,450P",
     {("AGR192", "AGR", OP, "P", 2027): 164450}),
    ("OPERATING   AGR   1,000A    A", {("AGR192", "AGR", OP, "A", 2026): 1000}),
    ("OPERATING", {}),
    ("AGR 7,000B", {}),
    ("TOTAL FUNDING  LBR  350 C    C", {("AGR192", "LBR", CAP, "C", 2026): 350}),
    ("INVESTMENT CAPITAL  LNR  C  2,000,000C", {("AGR192", "LNR", CAP, "C", 2027): 2000000}),
    ("COK 13,000,000S  14,000,000S\"", {("AGR192", "COK", OP, "S", 2026): 13000000,
                                       ("AGR192", "COK", OP, "S", 2027): 14000000}),
])
def test_single_shapes(spark, line, want):
    got, _ = read(spark, "1. AGR192 - GENERAL ADMINISTRATION\n" + line)
    assert got == want


@pytest.mark.parametrize("line, want", [
    ("                                  TRN                 N    19,200,000N",
     {("N", 2027): 19200000}),
    ("                                  TRN       10,000,000N              N",
     {("N", 2026): 10000000}),
    ("   TRN  5,000E  6,000E", {("E", 2026): 5000, ("E", 2027): 6000}),
    ("   TRN  5,000", {("C", 2026): 5000}),
])
def test_capital_shapes(spark, line, want):
    got, _ = read(spark, "1. TRN511 - MAUI HIGHWAYS\nINVESTMENT CAPITAL\n" + line)
    assert got == {("TRN511", "TRN", CAP, f, y): v for (f, y), v in want.items()}


def test_lone_amount_is_copied(spark):
    got, rows = read(spark, "1. AGR192 - X\nOPERATING\nAGR 7,000B")
    assert got == {("AGR192", "AGR", OP, "B", 2026): 7000, ("AGR192", "AGR", OP, "B", 2027): 7000}
    assert {r.notes for r in rows} == {"second year copied from first"}


def test_hyphenated_grant_name_is_no_program(spark):
    got, _ = read(spark, """1. LBR903 - COMMUNITY SERVICES
OPERATING LBR 1A 2A
32. KALIHI-PALAMA HEALTH CENTER
LBR 5B 6B""")
    assert {k[0] for k in got} == {"LBR903"}


def test_positions_belong_to_next_line(spark):
    _, rows = read(spark, """1. EDN100 - SCHOOLS
            12.00*      14.00*
                        15.00*
             1.00#       2.00#
OPERATING EDN 10A 20A
EDN 5B 6B
            3.00*      4.00*
2. EDN200 - OTHER
OPERATING EDN 7A 8A""")
    got = {(r.program_id, r.fund_type, r.fiscal_year):
           (r.positions and float(r.positions), r.positions_temp and float(r.positions_temp))
           for r in rows}
    assert got[("EDN100", "A", 2026)] == (13.0, 1.0)
    assert got[("EDN100", "A", 2027)] == (17.0, 2.0)
    assert got[("EDN100", "B", 2026)] == (None, None)
    assert got[("EDN200", "A", 2026)] == (None, None)


def test_amendments(spark):
    got, rows = read(spark, """1. LBR902 - ADMINISTRATION
OPERATING   LBR   5,580,886A   5,556,126A
                               2,748,713A
            LBR   1,000,000B   1,000,000B
                                       0B
                                 500,000W
INVESTMENT CAPITAL   LNR   4,500,000C   0C
                                5,000,000C
                     AGS           N   19,200,000N
                         17,650,000N   1,186,819N
2. LBR111 - NEXT
OPERATING   LBR   1A   2A""")
    assert got == {
        ("LBR902", "LBR", OP, "A", 2026): 5580886, ("LBR902", "LBR", OP, "A", 2027): 2748713,
        ("LBR902", "LBR", OP, "B", 2026): 1000000, ("LBR902", "LBR", OP, "B", 2027): 0,
        ("LBR902", "LBR", OP, "W", 2027): 500000,
        ("LBR902", "LNR", CAP, "C", 2026): 4500000, ("LBR902", "LNR", CAP, "C", 2027): 5000000,
        ("LBR902", "AGS", CAP, "N", 2027): 1186819, ("LBR902", "AGS", CAP, "N", 2026): 17650000,
        ("LBR111", "LBR", OP, "A", 2026): 1, ("LBR111", "LBR", OP, "A", 2027): 2}
    assert len(rows) == len(got)


def test_created_row_then_amended_to_zero(spark):
    got, _ = read(spark, """1. LBR902 - ADMINISTRATION
OPERATING   LBR   1,000A   0A
                        500A
                          0A""")
    assert got[("LBR902", "LBR", OP, "A", 2027)] == 0


def test_project_list_is_not_allocated(spark):
    got, _ = read(spark, """1. SUB501 - COUNTY
INVESTMENT CAPITAL COK 5,000C 6,000C
"SECTION 14. CAPITAL IMPROVEMENT PROJECTS AUTHORIZED.
SUB501 - COUNTY
1.          WORKS
            TOTAL FUNDING       COK      3,500 C       1,000 C
SECTION 15. More.
OPERATING COK 1A 2A""")
    # The operating line still stands in the capital section of its program.
    assert got == {("SUB501", "COK", CAP, "C", 2026): 5000, ("SUB501", "COK", CAP, "C", 2027): 6000}


def test_large_repeats(spark):
    df = spark.createDataFrame(
        [("d", "T", 2026, OP, "A", 60_000_000, 1), ("d", "T", 2026, OP, "B", 60_000_000, 2),
         ("d", "T", 2026, OP, "A", 10, 3), ("d", "T", 2026, OP, "A", 10, 4)],
        "doc_id string, program_id string, fiscal_year int, section string, fund_type string, "
        "amount long, line_number long")
    got = sorted(r.line_number for r in L.dedupe_large_repeats(df).collect())
    assert got == [1, 3, 4]


def test_long_document_in_many_chunks(spark):
    """Context survives chunk borders when one document holds all lines."""
    n = 300
    lines = spark.range(n).select(F.explode(F.array(
        F.struct((F.col("id") * 500_000).alias("line_no"), F.concat(
            F.lit("1. AGR"), F.lpad(F.col("id").cast("string"), 3, "0"),
            F.lit(" - P")).alias("line")),
        F.struct((F.col("id") * 500_000 + 200_000).alias("line_no"),
                 F.lit("OPERATING AGR 10A 20A").alias("line")),
        F.struct((F.col("id") * 500_000 + 400_000).alias("line_no"),
                 F.lit("                30A").alias("line")))).alias("s")).select(
        F.lit("d").alias("doc_id"), "s.line_no", "s.line")
    rows = L.extract_allocations(lines, 2026, 2027).groupBy("fiscal_year").agg(
        F.count("*").alias("n"), F.sum("amount").cast("long").alias("v")).collect()
    assert {(r.fiscal_year, r.n, r.v) for r in rows} == {(2026, n, 10 * n), (2027, n, 30 * n)}


def test_wide_amounts_are_findings(spark):
    df = spark.createDataFrame(
        [("d", 1, "bare_amendment", "[12,345,678,901,234,567A]"), ("d", 2, "bare_amendment", "[1,200A]"),
         ("d", 3, "other", "99999999999999999999")], "doc_id string, line_no long, kind string, raw string")
    found = L.unreadable_amounts(df).collect()
    assert [(r.line_no, r.number) for r in found] == [(1, "12,345,678,901,234,567")]
    amounts = [r[0] for r in df.orderBy("line_no").select(L._digits(F.col("raw"))).collect()]
    assert amounts[0] is None and float(amounts[1]) == 1200.0 and amounts[2] is None


def test_kept_and_removed_repeats_add_up(spark):
    rows = [("d", "P1", 2026, "Operating", f, 60_000_000, n) for n, f in enumerate("ABAB")]
    rows += [("d", "P1", 2026, "Operating", "A", 5, 9), ("d", "P1", 2026, "Operating", "A", 5, 10),
             ("e", "P1", 2026, None, "A", 70_000_000, 1), ("e", "P1", 2026, None, "A", 70_000_000, 1)]
    df = spark.createDataFrame(rows, "doc_id string, program_id string, fiscal_year int, section string, "
                                     "fund_type string, amount long, line_number long").withColumn(
        "amount", F.col("amount").cast("decimal(18,2)"))
    removed = L.removed_repeats(df).collect()
    assert {(r.doc_id, r.kept_line, r.removed) for r in removed} == {("d", 0, 3), ("e", 1, 1)}
    assert L.dedupe_large_repeats(df).count() + sum(r.removed for r in removed) == len(rows)
