"""Layouts of positional words and text tables."""

from pyspark.sql import functions as F

from coffer.operators import notes as N
from coffer.operators import words as C
from tests.test_lines import document


def words(spark, rows):
    """rows: (page, top, [(x0, x1, text)])."""
    data = [("d", p, float(a), float(b), float(t), s) for p, t, ws in rows for a, b, s in ws]
    return spark.createDataFrame(
        data, "doc_id string, page int, x0 double, x1 double, top double, text string")


HEADER = [(180, 200, "APPRN"), (280, 300, "ADJUSTMENT"), (380, 400, "APPRN"),
          (480, 500, "APPRN"), (580, 600, "ADJUSTMENT"), (680, 700, "APPRN")]
TAIL = [(780, 800, "BIENNIUM"), (880, 900, "BIENNIUM"), (980, 990, "CHANGE")]
FUNDS = [("GENERAL FUND", "A"), ("SPECIAL FUND", "B"), ("G.O. BONDS", "C")]


def test_lines_by_tolerance(spark):
    df = words(spark, [(1, 10, [(5, 9, "b")]), (1, 11.5, [(1, 4, "a")]), (1, 12.5, [(1, 2, "c")]),
                       (2, 10, [(1, 2, "d")])])
    assert sorted(r.line for r in C.word_lines(df).collect()) == ["a b", "c", "d"]


def test_fragments(spark):
    df = words(spark, [(1, 10, [(1, 20, "2,291,"), (21, 30, "497,"), (31, 40, "122"),
                                (90, 99, "1,"), (105, 110, "5")])])
    out = C.merge_fragments(C.word_lines(df)).first().line
    # The comma of the second fragment is not digits only, so it starts anew.
    assert out == "2,291, 497,122 1, 5"


def test_request_table(spark):
    page = [
        (1, 100, HEADER + TAIL),
        (1, 150, [(10, 40, "OPERATING")]),
        (1, 170, [(10, 40, "GENERAL"), (41, 60, "FUND"), (190, 217, "100"), (290, 317, "-40"),
                  (690, 717, "75")]),
        (1, 190, [(10, 40, "SPECIAL"), (41, 60, "FUND"), (190, 217, "9"), (390, 417, "11"),
                  (490, 517, "3")]),
        (1, 210, [(10, 40, "CAPITAL"), (41, 90, "INVESTMENT")]),
        (1, 220, [(10, 40, "GENERAL"), (41, 60, "FUND"), (390, 417, "999")]),
        (1, 230, [(10, 40, "TOTAL"), (41, 90, "CAPITAL"), (91, 99, "COST"), (390, 417, "5")]),
        (2, 100, HEADER + TAIL),
        (2, 170, [(10, 40, "G.O."), (41, 60, "BONDS"), (390, 417, "5"), (690, 717, "6")]),
        (2, 180, [(10, 40, "TOTAL"), (41, 60, "PROGRAM"), (61, 70, "COST"), (390, 417, "5")]),
        (2, 190, [(10, 40, "GENERAL"), (41, 60, "FUND"), (390, 417, "123")]),
    ]
    programs = spark.createDataFrame([("d", 1, "AGR101"), ("d", 2, "AGR101")],
                                     "doc_id string, page int, program_id string")
    got = {(r.page, r.section, r.fund_type): (float(r.amount1), float(r.amount2))
           for r in C.request_rows(words(spark, page), programs, FUNDS).collect()}
    assert got == {(1, "Operating", "A"): (60.0, 75.0), (1, "Operating", "B"): (11.0, 3.0),
                   (2, "Capital Improvement", "C"): (5.0, 6.0)}


def test_request_projects(spark):
    page = [
        (1, 100, HEADER),
        (1, 150, [(20, 40, "A38A"), (41, 45, "6"), (50, 90, "RENOVATION"), (95, 120, "HALL")]),
        (1, 160, [(95, 120, "PLANS"), (390, 417, "7")]),
        (1, 170, [(95, 120, "G.O."), (121, 140, "BONDS"), (390, 417, "1,500"), (690, 717, "20")]),
        (1, 180, [(20, 60, "PROGRAM"), (61, 90, "TOTALS"), (390, 417, "5")]),
        (1, 190, [(95, 120, "G.O."), (121, 140, "BONDS"), (390, 417, "77")]),
    ]
    programs = spark.createDataFrame([("d", 1, "AGS881")],
                                     "doc_id string, page int, program_id string")
    rows = C.request_projects(words(spark, page), programs, FUNDS).collect()
    assert [(r.project_id, r.project_name, r.fund_type, float(r.amount1), float(r.amount2))
            for r in rows] == [("A38A", "RENOVATION HALL", "C", 1500000.0, 20000.0)]


def test_position_totals(spark):
    df = spark.createDataFrame(
        [("P", 1, "Total perm positions", 10.0, None), ("P", 2, "TOTAL TEMP POSITIONS", 1.0, None),
         ("Q", 1, "TOTAL TEMP POSITIONS", 3.0, 4.0)],
        "program_id string, line_no long, line string, fy1 double, fy2 double")
    got = {r.program_id: tuple(None if v is None else float(v) for v in r[1:])
           for r in C.position_totals(df).collect()}
    assert got == {"P": (11.0, 1.0, None, None), "Q": (3.0, 3.0, 4.0, 4.0)}


def test_star_worksheet(spark):
    page = [
        (1, 10, [(10, 60, "001-0101-512"), (70, 99, "x")]),
        (1, 20, [(20, 25, "*"), (30, 50, "PATROL"), (200, 210, "5"), (300, 310, "100")]),
        (1, 30, [(20, 25, "*"), (30, 50, "RECORDS"), (300, 310, "20-")]),
        (1, 40, [(20, 30, "**"), (31, 50, "POLICE"), (300, 310, "95")]),
        (1, 50, [(20, 30, "**"), (31, 50, "FIRE"), (300, 310, "7")]),
        (1, 60, [(20, 35, "***"), (36, 60, "GENERAL"), (61, 80, "FUND"), (300, 310, "102")]),
    ]
    lines = C.account_lines(C.word_lines(words(spark, page), "round"))
    got = {(r.department_name, r.program_name, float(r.amount), r.fund, r.fund_name)
           for r in C.star_tree(lines).collect()}
    assert got == {("POLICE", "PATROL", 100.0, "001", "GENERAL FUND"),
                   ("POLICE", "RECORDS", -20.0, "001", "GENERAL FUND"),
                   ("POLICE", "Other", 15.0, "001", "GENERAL FUND"),
                   ("FIRE", None, 7.0, "001", "GENERAL FUND")}


def test_fund_sections(spark):
    text = """HIGHWAY FUND
Bridge repair W12345 1,000 2,000 3,000
LONG PROJECT TITLE
R24005 10 (20)
TOTAL 3,000
Nothing NEW 0"""
    rows = C.fund_section_rows(document(spark, text), [("HIGHWAY", "Highway Fund")]).collect()
    assert {(r.program_name, float(r.amount), r.fund_name) for r in rows} == {
        ("Bridge repair", 3000.0, "Highway Fund"), ("LONG PROJECT TITLE", -20.0, "Highway Fund")}


def test_banded_projects(spark):
    page = [
        (1, 210, [(50, 99, "PUBLIC"), (100, 140, "SAFETY")]),
        (1, 220, [(50, 80, "2001234"), (85, 99, "Fire"), (100, 120, "Station"), (430, 450, "1,000"),
                  (480, 490, "GL"), (510, 550, "1,500")]),
        (1, 230, [(430, 450, "500")]),
        (1, 240, [(480, 490, "SW")]),
        (1, 250, [(50, 80, "TOTAL"), (430, 450, "9,000"), (480, 490, "SW")]),
    ]
    rows = C.banded_projects(C.word_lines(words(spark, page), "thirds"), ["PUBLIC SAFETY"])
    got = {(r.department_name, r.program_name, r.code, float(r.amount)) for r in rows.collect()}
    assert got == {("Public Safety", "Fire Station", "GL", 1000.0),
                   ("Public Safety", "Fire Station", "SW", 500.0)}


def test_department_table(spark):
    text = """Police $1 $2
DEPARTMENT WAGES TOTAL
Police 1 $10.0 $12,708.1
Water $5.0 ($17.5)
Total Expenditures $9 $9
Fire $1 $1"""
    rows = C.department_table(document(spark, text), r"^DEPARTMENT WAGES", r"^Total Expenditures",
                              {"Water": "Water Fund"}, "General Fund").collect()
    assert {(r.department_name, float(r.amount), r.fund_name) for r in rows} == {
        ("Police", 12708100.0, "General Fund"), ("Water", -17500.0, "Water Fund")}


def test_project_sheet(spark):
    text = """District Project Fund
Upper valley
road widening
Wailuku Drainage CBS-1017 phase two GF 1,500
Wailuku Drainage FD 20
FISCAL YEAR 2026 MAYOR'S BUDGET
Kula Parks CBS-2 XX 5
Kula Parks CBS-3 GF 7
Total: 9"""
    rows = C.project_sheet(
        document(spark, text), r"^District Project", r"^Total:",
        r"^(.*?)\s([A-Z]{2})\s([\d,]+)$", {"GF": "General", "FD": "Federal"}).collect()
    assert {(r.program_name, r.code, float(r.amount)) for r in rows} == {
        ("Upper valley road widening phase two", "GF", 1500000.0),
        ("Upper valley road widening phase two", "FD", 20000.0),
        ("(unnamed project)", "GF", 7000.0)}


def test_fund_summary(spark):
    text = """General 1 2
FUND Budget Proposed
General Fund 1,000 2,000
Solid Waste Fund 30 40
General Fund 9 9
Total 5 5
Highway 7 8"""
    rows = C.fund_summary(document(spark, text),
                          [("solidwaste", "Solid Waste"), ("general", "General")], 1).collect()
    assert {(r.fund_name, float(r.amount)) for r in rows} == {
        ("General", 2000000.0), ("Solid Waste", 40000.0)}


def test_schedule(spark):
    text = """Education 1 2 3 4
Department
Public Safety $ 1,000 $ 1,200 (38) -
Too short 1 2
Total other 1 2 3 4
Total expenditures 1 2 3 4
Health 1 2 3 4"""
    rows = C.schedule_rows(document(spark, text)).collect()
    assert [(r.department_name, float(r.original), float(r.final), float(r.actual),
             float(r.printed_variance)) for r in rows] == [
        ("Public Safety", 1000000.0, 1200000.0, -38000.0, 0.0)]


def test_bands_blocks_and_revenue(spark):
    page = [(1, 10 * i, [(5, 8, "FY"), (9, 20, "2020"), (100, 110, f"1,{i}00"), (200, 210, "(5)")])
            for i in range(1, 5)]
    lines = C.word_lines(words(spark, page), "round")
    blocks = C.stacked_blocks(lines, ["revenue", "net"], [2020, 2021]).orderBy("line_top").collect()
    assert [(r.block, r.fiscal_year) for r in blocks] == [
        ("revenue", 2020), ("revenue", 2021), ("net", 2020), ("net", 2021)]
    values = C.band_values(lines, [("a", 90.0), ("b", 190.0)]).where("line_top = 10").collect()
    assert {(r.band, float(r.value)) for r in values} == {("a", 1100.0), ("b", -5.0)}
    tax = [(1, 10, [(5, 60, "Income"), (61, 90, "Tax*"), (295, 305, "$1,234"), (395, 405, "99")])]
    centre = spark.createDataFrame([("d", 1, 2027, 310.0)],
                                   "doc_id string, page int, fiscal_year int, centre double")
    row = C.revenue_rows(C.word_lines(words(spark, tax), "round"), centre).first()
    assert (row.source, float(row.amount), row.fiscal_year) == ("Income Tax", 1234000.0, 2027)


def test_stutter(spark):
    df = spark.createDataFrame(
        [("EEEDDDNNN444000000:::",), ("LLNNRR101 bookkeeper aaa",), ("committee of MAUI",),
         ("-----",)], "text string")
    got = {r.text: r.repaired for r in N.collapse_stutter(df).collect()}
    assert got == {"EDN400:": True, "LLNNRR101 bookkeeper aaa": True, "committee of MAUI": False,
                   "-": True}


def test_objective_cap(spark):
    df = spark.createDataFrame([("• First point. Second one is long",), ("no end at all here",)],
                               "t string")
    got = [r[0] for r in df.select(N.normalize_objective(F.col("t"), 15)).collect()]
    assert got == ["First point.", "no end at all h…"]


def test_long_texts_and_lines_are_whole(spark):
    long = "First. " + "word " * 1200 + "end"
    df = spark.createDataFrame([(long,)], "t string")
    assert df.select(N.normalize_objective(F.col("t"))).first()[0] == long
    tall = [(1, 12000, [(5, 9, "a")]), (2, 2000, [(5, 9, "b")])]
    numbers = [r.line_no for r in C.word_lines(words(spark, tall), "round").orderBy("page").collect()]
    assert numbers[0] < numbers[1]
    wide = [(1, 10, [(10, 20, "***")] + [(30 + i, 31 + i, f"w{i}") for i in range(1500)]
             + [(9000, 9010, "77")])]
    row = C.account_lines(C.word_lines(words(spark, wide), "round")).first()
    assert (row.stars, float(row.amount)) == (3, 77.0) and row.name.endswith("w1499")


def test_band_fragments_and_first_schedule_only(spark):
    split = [(1, 10, [(100, 110, "1,2"), (112, 120, "34"), (95, 99, "2027"), (300, 310, "(5)")])]
    values = C.band_values(C.word_lines(words(spark, split), "round"), [("a", 105.0), ("b", 300.0)])
    assert {(r.band, float(r.value)) for r in values.collect()} == {("a", 1234.0), ("b", -5.0)}
    text = ["Department", "Health 1 2 3 4", "Total expenditures 1 2 3 4", "Department", "Health 9 9 9 9",
            "Total expenditures"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "doc_id string, line_no long, line string")
    assert [float(r.original) for r in C.schedule_rows(lines).collect()] == [1000.0]


def test_line_tops_follow_the_anchor(spark):
    import random
    rng = random.Random(8)
    tops = [round(rng.choice([rng.uniform(0, 40), rng.uniform(100, 900)]), 1) for _ in range(200)]
    df = spark.createDataFrame([("d", 1, 0.0, 1.0, t, "w") for t in tops],
                               "doc_id string, page int, x0 double, x1 double, top double, text string")
    got = {r.top: r.line_top for r in C.line_tops(df).collect()}
    anchor, want = None, {}
    for t in sorted(set(tops)):
        if anchor is None or abs(t - anchor) > 2.0:
            anchor = t
        want[t] = anchor
    assert got == want


def test_a_very_long_line_is_merged_in_place(spark):
    words_ = [(float(i), i + 0.5, "1," if i % 3 == 0 else "23" if i % 3 == 1 else "x") for i in range(20_000)]
    df = spark.createDataFrame([(1, words_)], "k int, words array<struct<x0:double,x1:double,text:string>>")
    line = C.merge_fragments(df).first().line
    assert line == " ".join(("1,23" if i % 3 == 0 else "x") for i in range(20_000) if i % 3 != 1)


def test_words_of_a_page_are_shuffled_once(spark):
    """Lines by tolerance join nothing back and leave out words without a place."""
    rows = [(f"d{i % 3}", i % 5, 10.0 * w, 10.0 * w + 5, 100.0 + 1.5 * w + i, f"w{w}")
            for i in range(30) for w in range(8)]
    rows += [("d0", 1, 0.0, 1.0, None, "lost"), (None, 1, 0.0, 1.0, 5.0, "lost")]
    df = spark.createDataFrame(rows, "doc_id string, page long, x0 double, x1 double, top double, text string")
    out = C.word_lines(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    expected = {}
    for doc, page in {(r[0], r[1]) for r in rows if r[0]}:
        anchor = None
        for top, x0, x1, text in sorted((r[4], r[2], r[3], r[5]) for r in rows if r[:2] == (doc, page) and r[4]):
            anchor = top if anchor is None or top - anchor > 2.0 else anchor
            expected.setdefault((doc, page, anchor), []).append((x0, x1, text))
    got = {(r.doc_id, r.page, r.line_top): [tuple(w) for w in r.words] for r in out.collect()}
    assert got == {k: sorted(v) for k, v in expected.items()}
    placed = C.line_tops(df).select("doc_id", "page", "line_top", "text").collect()
    assert len(placed) == 240 and {(r.doc_id, r.page, r.line_top) for r in placed} == set(expected)


def test_request_lines_stay_where_their_page_is(spark):
    frame = words(spark, [(1, 100, HEADER), (1, 170, [(95, 140, "G.O. BONDS"), (390, 417, "1,500")])])
    programs = spark.createDataFrame([("d", 1, "AGS881")], "doc_id string, page int, program_id string")
    plan = C.request_projects(frame, programs, FUNDS)._jdf.queryExecution().optimizedPlan().toString()
    # words and labels are grouped by page; edges, programs and the carry find them there
    assert [plan.count(x) for x in ("Aggregate [", "Join ", "Window [")] == [2, 2, 1]


def test_numbers_go_to_the_nearest_edge_and_the_first_one_stays(spark):
    lines = C.merge_fragments(C.word_lines(words(spark, [
        (1, 100, [(0, 20, "5"), (30, 117, "x"), (118, 122, "7"), (125, 130, "8"), (200, 250, "9")]),
        (2, 100, [(0, 20, "5")])])))
    edges = spark.createDataFrame([("d", 1, [3.0, 103.0, 113.0])], "doc_id string, page int, edges array<double>")
    got = C.column_values(lines, edges, ["a", "b", "c"]).orderBy("page").select("a", "b", "c").collect()
    # edges stand at 20, 120 and 130; 250 is beyond the tolerance, page 2 has no edges
    assert [tuple(r) for r in got] == [(5, 7, 8), (None, None, None)]
