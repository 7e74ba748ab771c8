"""Readers, markup, registry, sinks and the streaming refresh."""

import json
import os

import pytest
from pyspark.sql import functions as F

from coffer.operators import series as S
from coffer.plans.testdata import allocations
from coffer.schema import ALLOCATION, ensure_columns
from coffer.sinks import write_analysis, write_by_department, write_csv, write_hierarchy
from coffer.sinks import write_json_records, write_yearly_csv
from coffer.sources import markup, readers, registry
from coffer.streaming import watch
from coffer.streaming.watch import partial_rollup, read_findings, read_rollup, watch_allocations


def test_lines_and_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\r\ntwo x\rthree".encode())
    (tmp_path / "b.txt").write_bytes("caf\xe9".encode("latin-1"))
    got = {(r.doc_id, r.line_no): r.line for r in readers.read_lines(spark, str(tmp_path)).collect()}
    assert got == {("a.txt", 1): "one", ("a.txt", 2): "two x", ("a.txt", 3): "three",
                   ("b.txt", 1): "café"}


def test_a_large_file_is_numbered_across_blocks(spark, tmp_path):
    texts = {"a b.txt": "".join(f"line {i}" + ("\r\n" if i % 3 else "\n") for i in range(60_000)),
             "c.txt": "x\ry\n\n z\u00a0w", "empty.txt": "",
             "latin.txt": "".join(f"caf\xe9 {i}\n" for i in range(9000))}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode("latin-1" if name == "latin.txt" else "utf-8"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        lines = readers.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 1
        got = {}
        for r in lines.collect():
            got.setdefault(r.doc_id.replace("%20", " "), {})[r.line_no] = r.line
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, text in texts.items():
        want = text.replace("\r\n", "\n").replace("\r", "\n").replace("\u00a0", " ").split("\n")
        want = want[:-1] if want[-1] == "" else want
        assert got.get(name, {}) == dict(enumerate(want, 1))


def test_allocation_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text(
        'program_id,amount,fiscal_year,program_name\nP1,"12.5",2026,"two\nlines"\nP2,abc,x,n\n')
    rows = {r.program_id: r for r in readers.read_allocations(spark, str(tmp_path), multi_line=True).collect()}
    assert float(rows["P1"].amount) == 12.5 and rows["P1"].program_name == "two\nlines"
    assert rows["P2"].amount is None and rows["P2"].fiscal_year is None
    assert rows["P1"].positions is None


def test_vetoes(spark):
    df = spark.createDataFrame([("BED143", None, "2,701,795A"), ("EDN400", "380W", "5"),
                                ("  ", "1A", "1A")], "Program string, y1 string, y2 string")
    got = {(r.program_id, r.fiscal_year, r.fund_type): float(r.amount)
           for r in readers.read_vetoes(df, {"y1": 2026, "y2": 2027}).collect()}
    assert got == {("BED143", 2027, "A"): 2701795.0, ("EDN400", 2026, "W"): 380.0,
                   ("EDN400", 2027, "A"): 5.0}


def test_unreadable_vetoes_are_findings(spark):
    df = spark.createDataFrame(
        [("P1", "99,999,999,999,999,999,999A", "5B"), ("P2", "n/a", "A")], "Program string, y1 string, y2 string")
    years = {"y1": 2026, "y2": 2027}
    got = {(r.program_id, r.fiscal_year): r.amount for r in readers.read_vetoes(df, years).collect()}
    assert got[("P1", 2026)] is None and got[("P2", 2026)] is None
    assert float(got[("P1", 2027)]) == 5 and float(got[("P2", 2027)]) == 0
    found = readers.unreadable_vetoes(df, years).collect()
    assert {(r.program_id, r.fiscal_year) for r in found} == {("P1", 2026), ("P2", 2026)}


def test_descriptions(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"AGR": {"name": "n", "description": "d"}}))
    (tmp_path / "b.json").write_text(json.dumps([{"code": "TAX", "name": "t", "description": "x"}]))
    got = {tuple(r) for r in readers.read_descriptions(spark, str(tmp_path)).collect()}
    assert got == {("AGR", "n", "d"), ("TAX", "t", "x")}


def test_a_description_block_without_text_leaves_the_next_block(spark):
    rows = [(i, f"The Department of Arts (ABC)  {t}\nThe Department of Works (WRK)\n builds\n roads.")
            for i, t in enumerate(["", " \n\t", "x"])]
    got = readers.extract_blocks(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["department_code"]): r["description"] for r in got} == {
        (0, "ABC"): "", (1, "ABC"): "", (2, "ABC"): "x",
        (0, "WRK"): "builds roads.", (1, "WRK"): "builds roads.", (2, "WRK"): "builds roads."}


def test_html(spark):
    html = ("<html><head><title>no</title></head><body><style>x</style>1.   BED100<br>\n- NAME"
            "<p>INVESTMENT<br>CAPITAL TRN [5A]&nbsp;&amp;lt;&#233;&#xA0;x &bogus;</p>"
            "H.B. NO. 300 page\n<div>OPERATING BED   \n3,802,604A</div><!-- c --></body></html>")
    df = spark.createDataFrame([(html,)], "h string")
    got = df.select(markup.html_to_text(F.col("h"))).first()[0]
    assert got == ("1.   BED100 - NAME\nINVESTMENT CAPITAL TRN  5A &lt;é x \n\n\n"
                   "OPERATING BED  3,802,604A\n")


def test_rtf(spark):
    rtf = ("{\\rtf1{\\fonttbl\\f0 Arial;}{\\*\\expandedcolortbl;;}\\pard A\\'97B\\'a0\\'41\\'e9\\\n"
           "1. BED100\\\n- X [9A]\\\nCOK  5S\"\\\n}")
    df = spark.createDataFrame([(rtf,)], "h string")
    got = df.select(markup.rtf_to_text(F.col("h"))).first()[0]
    assert got == "A-B A \n1. BED100 - X  9A\nCOK  5S\n"


def test_registry(spark):
    reg = registry.biennial_registry(spark)
    assert registry.explode_bills(reg).count() == 7
    labels = {r.session: r.label for r in registry.bill_labels(reg).collect()}
    assert labels[2019] == "HB2 + HB1259" and labels[2025] == "HB300"
    assert [r.session for r in registry.coverage_notes(reg).collect()] == [2019]
    assert sorted(r.fiscal_year for r in registry.years_covered(reg).collect()) == list(
        range(2016, 2028))


def test_deflators(spark):
    obs = spark.createDataFrame(
        [(2020, "S01", "90"), (2020, "S02", "110"), (2020, "M13", "1"), (2021, "M01", "-"),
         (2021, "M02", "110"), (2022, "M01", "121"), (2024, "M01", "140")],
        "year int, period string, value string")
    index = S.fiscal_index(S.calendar_average(obs))
    assert {(r.fiscal_year, r.fy_index) for r in index.collect()} == {(2021, 105.0), (2022, 115.5)}
    base = S.build_deflators(index, 2022)
    assert {(r.fiscal_year, float(r.deflator)) for r in base.collect()} == {
        (2021, 1.1), (2022, 1.0)}
    need = spark.createDataFrame([(2019,), (2022,), (2024,)], "fiscal_year int")
    got = {r.fiscal_year: (float(r.deflator), r.projected)
           for r in S.project_deflators(base, need).collect()}
    assert got == {2021: (1.1, False), 2022: (1.0, False), 2024: (0.9518, True)}
    with pytest.raises(Exception, match="not in the index"):
        S.build_deflators(index, 1990).collect()


def _files(path, end):
    return [os.path.join(r, f) for r, _, fs in os.walk(path) for f in fs if f.endswith(end)]


def test_sinks(spark, sf_dir, tmp_path):
    rows = allocations(spark, sf_dir, "department_code", "program_id", "section", "fiscal_year",
                       "amount", "line_number")
    write_yearly_csv(rows, str(tmp_path / "y"), section="operating")
    back = spark.read.option("header", True).csv(str(tmp_path / "y"))
    assert back.count() == rows.where("section = 'Operating'").count()
    write_by_department(rows, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == rows.count()
    write_analysis({"a": rows.limit(3), "b": rows.limit(4)}, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "b")).count() == 4
    write_csv(rows.limit(5), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 5
    odd = spark.sql("SELECT double('NaN') AS a, CAST(NULL AS STRING) AS b, 1 AS c")
    write_json_records(odd, str(tmp_path / "j"))
    text = open(_files(tmp_path / "j", ".json")[0]).read()
    assert json.loads(text) == {"a": None, "b": None, "c": 1}
    parents = spark.createDataFrame([("D", 3)], "department_code string, total int")
    children = spark.createDataFrame([("D", "P1", 1), ("D", "P2", 2)],
                                     "department_code string, program_id string, amount int")
    ranked = children.withColumn("rank", -F.col("amount"))
    write_hierarchy(parents, ranked, ["department_code"], ["program_id", "amount"],
                    str(tmp_path / "h"))
    text = open([f for f in _files(tmp_path / "h", ".json") if os.path.getsize(f)][0]).read()
    assert json.loads(text)["programs"] == [{"program_id": "P2", "amount": 2},
                                            {"program_id": "P1", "amount": 1}]


def test_hierarchy_of_many_children(spark, tmp_path):
    parents = spark.createDataFrame(
        [("hot", 1.5), ("none", float("nan")), (None, 2.0)], "code string, total double")
    children = spark.range(300_000).select(
        F.lit("hot").alias("code"), (-F.col("id")).alias("rank"), F.concat(F.lit('q"'), "id").alias("name")
    ).unionByName(spark.createDataFrame([(None, 1, "n"), ("orphan", 1, "o")], "code string, rank long, name string"))
    write_hierarchy(parents, children, ["code"], ["name"], str(tmp_path / "h"))
    got = {r.code: r for r in spark.read.json(str(tmp_path / "h")).collect()}
    assert set(got) == {"hot", "none", None}
    assert [p.name for p in got["hot"].programs] == [f'q"{i}' for i in reversed(range(300_000))]
    assert got["none"].programs is None and got["none"].total is None
    assert [p.name for p in got[None].programs] == ["n"]
    twice = parents.unionByName(parents)
    with pytest.raises(Exception, match="two parents share a key"):
        write_hierarchy(twice, children, ["code"], ["name"], str(tmp_path / "t"))


def test_many_small_batches_leave_few_files(spark, tmp_path):
    state, width = str(tmp_path / "state"), 3
    for b in range(10):
        rows = ensure_columns(spark.createDataFrame(
            [("D", "Dep", "P", "Operating", "A", 2026, 10, b)],
            "department_code string, department_name string, program_id string, section string, "
            "fund_type string, fiscal_year int, amount int, line_number long"), ALLOCATION)
        for _ in range(2 if b in (4, 8) else 1):  # a repeated batch changes nothing
            watch._refresh_rollup(rows, b, state)
            watch._refresh_findings(rows, b, state, width)
    got = read_rollup(spark, state)
    assert [float(r.operating_budget) for r in got.collect()] == [100.0]
    assert len(got.inputFiles()) <= 2
    found = read_findings(spark, state, width)
    assert found.where("error = 'missing program_name'").count() == 10
    assert len(found.inputFiles()) <= 3


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = ensure_columns(
        allocations(spark, sf_dir, "department_code", "department_name", "program_id", "section",
                    "fund_type", "fiscal_year", "amount", "positions", "line_number"), ALLOCATION)
    source, state, check = (str(tmp_path / n) for n in ("in", "state", "check"))
    for part in ("amount < 40000", "amount >= 40000"):
        rows.where(part).write.mode("append").parquet(source)
        watch_allocations(spark, source, state, check).awaitTermination()
    batch = {r.department_code: (r.operating_budget, r.capital_budget, r.positions)
             for r in partial_rollup(rows).collect()}
    stream = {r.department_code: (r.operating_budget, r.capital_budget, r.positions)
              for r in read_rollup(spark, state).collect()}
    assert stream == batch
    assert read_findings(spark, state).where(
        "error = 'missing program_name'").count() == rows.count()
