"""Project list, reconciliation and grants."""

import random

from pyspark.sql import functions as F

from coffer.operators import grants as G
from coffer.operators import lines as L
from coffer.operators import projects as P
from tests.test_lines import document

LIST = """1. SUB501 - COUNTY OF KAUAI
INVESTMENT CAPITAL COK 13,000,000C 5,000,000C
"SECTION 14. CAPITAL IMPROVEMENT PROJECTS AUTHORIZED.  The sums
A. ECONOMIC DEVELOPMENT
SUB501 - COUNTY OF KAUAI
1.          EAST-WEST CENTER, OAHU
            PLANS AND DESIGN
            FOR WORK.
            TOTAL FUNDING       COK      3,500 C       1,000 C
                                             2,000 C
            COK   26 E   10 E
                          12 E
20.         KAUAI WATER
            CONSTRUCTION
            TOTAL FUNDING       COK      1,500 C    C
                                         67 C
                                         68 C
21.         VIDINHA STADIUM
            TOTAL FUNDING       COK      8,000 C    C
21.1        KAUAI WATER
            TOTAL FUNDING       COK      1,500 C    C
40.         SAME TITLE
            TOTAL FUNDING       COK      40 C   9 C
41.         SAME TITLE
            TOTAL FUNDING       COK      40 C   8 C
42.         SAME TITLE
            TOTAL FUNDING       COK      41 C   7 C
50.         OLD
            TOTAL FUNDING       COK      1 C   1 C
50.         NEW
            TOTAL FUNDING       COK     C   7 C
LNR100 - LAND
50.         NEW
            TOTAL FUNDING       LNR     C   7 C
SECTION 7. Other.
9.          NOT A PROJECT"""


def test_projects(spark):
    rows = P.extract_projects(document(spark, LIST), 2026, 2027).collect()
    got = {(r.program_id, r.project_id, r.fund_type, r.fiscal_year): float(r.amount) / 1000
           for r in rows}
    assert got == {
        ("SUB501", "1", "C", 2026): 3500, ("SUB501", "1", "C", 2027): 2000,
        ("SUB501", "1", "E", 2026): 26, ("SUB501", "1", "E", 2027): 12,
        ("SUB501", "20", "C", 2026): 1500, ("SUB501", "20", "C", 2027): 68,
        ("SUB501", "21", "C", 2026): 8000, ("SUB501", "21.1", "C", 2026): 1500,
        ("SUB501", "41", "C", 2026): 40, ("SUB501", "41", "C", 2027): 8,
        ("SUB501", "42", "C", 2026): 41, ("SUB501", "42", "C", 2027): 7,
        ("SUB501", "50", "C", 2027): 7, ("LNR100", "50", "C", 2027): 7}
    first = next(r for r in rows if r.project_id == "1")
    assert first.scope == "PLANS AND DESIGN FOR WORK."
    assert first.category == "Economic Development"


def _greedy(copies, excess):
    """Reference fold over copies sorted by (first line, line)."""
    dropped = []
    for _, line, amount in sorted(copies):
        if excess <= 0.5:
            break
        if amount <= excess + 0.5:
            dropped.append(line)
            excess -= amount
    return set(dropped)


def test_reconcile_equals_the_greedy_choice(spark):
    rng = random.Random(11)
    rows, want = [], set()
    for b in range(6):
        line, titles, copies = 0, {}, []
        for _ in range(40):
            line += 1
            t = rng.choice("ABCDE")
            amount = rng.choice([1000, 2000, 5000, 9000])
            if t in titles:
                copies.append((titles[t], line, amount))
            else:
                titles[t] = line
            rows.append(("d", f"AGR{b:03d}", "C", 2026, t, line, amount))
        total = sum(r[6] for r in rows if r[1] == f"AGR{b:03d}")
        excess = rng.randint(3, 60) * 1000
        rows.append(("d", f"AGR{b:03d}", "C", 2026, None, -1, total - excess))
        want |= {(f"AGR{b:03d}", n) for n in _greedy(copies, excess)}
    df = spark.createDataFrame(
        rows, "doc_id string, program_id string, fund_type string, fiscal_year int, "
              "project_name string, line_number long, amount long").withColumn(
        "amount", F.col("amount").cast("decimal(18,2)"))
    projects = df.where("line_number > 0")
    targets = df.where("line_number < 0").withColumn("section", F.lit("Capital Improvement"))
    got = P.copies_to_drop(projects, targets).collect()
    assert {(r.program_id, r.line_number) for r in got} == want
    kept = P.reconcile_projects(projects, targets)
    assert kept.count() == projects.count() - len(want)


def test_reconcile_hundreds_of_thousands_of_copies(spark):
    n = 200_000
    amount = (F.col("id") * 7919 % 1000 + 1000).cast("long")
    listed = spark.range(n).select(
        F.lit("d").alias("doc_id"), F.lit("AGR001").alias("program_id"), F.lit("C").alias("fund_type"),
        F.lit(2026).alias("fiscal_year"), F.lit("SAME TITLE").alias("project_name"),
        (F.col("id") + 1).alias("line_number"), amount.cast("decimal(18,2)").alias("amount"))
    amounts = [i * 7919 % 1000 + 1000 for i in range(n)]
    excess = 1_234_567
    target = listed.limit(1).withColumn("amount", F.lit(sum(amounts) - excess).cast("decimal(18,2)")).withColumn(
        "section", F.lit("Capital Improvement"))
    want = _greedy([(1, i + 1, a) for i, a in enumerate(amounts) if i], excess)
    got = {r.line_number for r in P.copies_to_drop(listed, target).collect()}
    assert got == want


GRANTS = """SECTION 13. There is appropriated out of the general revenues of the State of Hawaii the \
sum of $300,000 or so much there-of as may be necessary for fiscal year 2026-2027 to (LBR903)
1. $200,000.00      808 CLEANUPS
ADD FUNDS AS A GRANT
FOR OFFICE (LNR100) (SUB501)
2.  $100,001.00   FOO BAR
nothing here
SECTION 15.
3.  $5.00   OUTSIDE"""


def test_grants(spark):
    lines = document(spark, GRANTS)
    known = spark.createDataFrame(
        [("d", "LNR100", "LAND", "LNR", "Land", "Environment", 1, 2026)],
        "doc_id string, program_id string, program_name string, department_code string, "
        "department_name string, category string, line_number long, fiscal_year int")
    rows = G.extract_grants(lines, known)
    got = {(r.program_id, r.program_name, r.category, float(r.amount), r.fiscal_year, r.fund_type,
            r.notes) for r in rows.collect()}
    assert got == {
        ("LNR100", "LAND", "Environment", 200000.0, 2027, "A", "Ch.42F grant: 808 CLEANUPS"),
        ("LBR903", "LBR903", None, 100001.0, 2027, "A", "Ch.42F grant: FOO BAR")}
    audit = G.audit_grants(lines, rows).first()
    assert (float(audit.declared_total), float(audit.itemized_total), audit.item_count,
            audit.reconciles) == (300000.0, 300001.0, 2, False)


def test_departments_and_programs(spark):
    rows = L.extract_allocations(document(spark, LIST), 2026, 2027)
    assert [(r.department_code, r.department_name) for r in
            L.distinct_departments(rows).collect()] == [("COK", "County of Kauai")]
    assert L.distinct_programs(rows).first().is_capital
