"""Comparisons with NULL keys, duplicates, updates and transfers."""

import pytest
from pyspark.sql import functions as F

from coffer.operators import compare as C
from coffer.operators import matching as M
from coffer.operators import quality as Q
from coffer.operators import rollup as R
from coffer.operators import views as V


def frame(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("amount", F.col("amount").cast("decimal(18,2)")) if (
        "amount" in df.columns) else df


def test_compare_null_keys_and_types(spark):
    before = frame(spark, [("A", None, 10), ("A", None, 5), ("B", "x", 0), ("C", "x", 1)],
                   "k string, s string, amount int")
    after = frame(spark, [("A", None, 30), ("B", "x", 7), ("D", "x", 2)],
                  "k string, s string, amount int")
    got = {(r.k, r.s): (r.before and float(r.before), r.after and float(r.after),
                        float(r.change), r.pct_change, r.change_type)
           for r in C.compare(before, after, ["k", "s"]).collect()}
    assert got == {
        ("A", None): (15.0, 30.0, 15.0, 100.0, "modified"),
        ("B", "x"): (0, 7.0, 7.0, None, "modified"),
        ("C", "x"): (1.0, None, -1.0, None, "removed"),
        ("D", "x"): (None, 2.0, 2.0, None, "added")}
    raw = C.compare(before, after, ["k", "s"], pre_aggregate=False)
    assert raw.where("k = 'A'").count() == 2
    with pytest.raises(ValueError):
        C.compare(before, after, ["missing"])


def test_apply_changes_last_wins(spark):
    rows = frame(spark, [("P1", 2026, "A", "Operating", 100), ("P1", 2026, "A", "One-Time", 7),
                         ("P1", 2026, "B", "Operating", 50)],
                 "program_id string, fiscal_year int, fund_type string, section string, amount int")
    changes = frame(spark, [("P1", 2026, None, 1, "first", 1), ("P1", 2026, "A", 2, "last", 2),
                            ("P9", 2026, "A", 3, "none", 3)],
                    "program_id string, fiscal_year int, fund_type string, amount int, "
                    "notes string, place int")
    got = {(r.fund_type, r.section): (float(r.amount), r.notes)
           for r in C.apply_changes(rows, changes, ["place"]).collect()}
    assert got == {("A", "Operating"): (2.0, "last"), ("A", "One-Time"): (2.0, "last"),
                   ("B", "Operating"): (50.0, None)}
    left = C.unmatched_changes(rows, changes.where("fund_type IS NOT NULL"))
    assert [r.program_id for r in left.collect()] == ["P9"]


def test_matching_rules(spark):
    long = "A VERY LONG PROJECT NAME INDEED PHASE 2"
    request = frame(spark, [
        ("P", "F1", "EXACT", 10, 1), ("P", "F1", long, 20, 2), ("P", "F2", "OTHER FUND", 30, 3),
        ("P", "F1", "SHORT NAME ONLY", 40, 4), ("P", "F1", "A VERY LONG PROJECT NAME INDEED", 50, 5)],
        "program_id string, fund_category string, name_key string, amount int, line_number int")
    drafts = frame(spark, [
        ("P", "F1", "EXACT", 1), ("P", "F1", long + " WITH MORE", 2), ("P", "F1", "OTHER FUND", 3),
        ("P", "F1", "SHORT NAME", 4), ("P", "F1", "NOTHING", 12)],
        "program_id string, fund_category string, name_key string, amount int")
    matched = M.match_projects(drafts, request)
    got = {r.name_key: (r.matched_amount and float(r.matched_amount), r.rule)
           for r in matched.collect()}
    assert got == {
        "EXACT": (10.0, "exact"), long + " WITH MORE": (20.0, "prefix"),
        "OTHER FUND": (30.0, "name"), "SHORT NAME": (None, None), "NOTHING": (None, None)}
    totals = frame(spark, [("P", 140)], "program_id string, program_total int")
    resolved = {r.name_key: (r.resolved_amount, r.rule)
                for r in M.prorate_unmatched(matched, totals).collect()}
    assert resolved["SHORT NAME"] == (20.0, "pro_rata")
    assert resolved["NOTHING"] == (60.0, "pro_rata")
    orphans = {r.name_key for r in M.project_orphans(drafts, request).collect()}
    assert orphans == {"OTHER FUND", "SHORT NAME ONLY"}


def test_transfers(spark):
    rows = spark.createDataFrame(
        [("P1", "AGS", "Operating", "F", 500_000, 100_000), ("P1", "BED", "Operating", "F", 0, 450_000),
         ("P1", "BED", "Capital Improvement", "F", 5, 9), ("P2", "AGS", "Operating", "F", 1, 2)],
        "program_id string, department_code string, section string, fund_category string, "
        "d1 long, d2 long")
    split = C.split_programs(rows)
    assert {r.program_id for r in split.collect()} == {"P1"}
    got = {(r.department_code, r.counterpart): r.direction
           for r in C.transfer_directions(split).collect()}
    assert got == {("AGS", "BED"): "out", ("BED", "AGS"): "in"}
    aug = {(r.department_code, r.program_id): (r.change, r.all_d1, r.all_d2, r.is_transfer)
           for r in C.augment_split(rows).collect()}
    assert aug[("AGS", "P1")] == (-400_000, 500_000, 550_000, True)
    assert aug[("BED", "P1")] == (450_004, 500_005, 550_009, True)
    assert aug[("AGS", "P2")] == (1, 1, 2, False)
    buckets = C.change_buckets(C.augment_split(rows))
    assert {(r.department_code, r.bucket, r.counterpart) for r in buckets.collect()} == {
        ("AGS", "moved_out", "BED"), ("BED", "moved_in", "AGS"), ("AGS", "increase", "")}


def test_positions_and_grants_view(spark):
    rows = frame(spark, [("D", "P1", "Operating", 1, 5.0), ("D", "P1", "Operating", 2, 5.0),
                         ("D", "P2", "Grants in Aid", 4, None)],
                 "department_code string, program_id string, section string, amount int, "
                 "positions double")
    once = R.positions_once(rows, ["department_code"]).first()
    assert once.positions == 5.0
    assert V.standard_view(rows).count() == 2
    assert V.standard_view(rows, section="all").count() == 2
    assert V.standard_view(rows, section="GRANTS IN AID").count() == 1
    assert V.standard_view(rows, keep_grants=True).count() == 3


def test_validation(spark):
    rows = frame(spark, [("P", "N", "D", 2026, 5, "Operating", "A"),
                         (None, "", "D", 2026, 0, "Operating", "Z"),
                         ("P", "N", "D", 2026, -5, "Operating", "A")],
                 "program_id string, program_name string, department_code string, "
                 "fiscal_year int, amount int, section string, fund_type string")
    errors = Q.validate_rows(rows, ["program_id"])
    assert sorted(r.error for r in errors.collect()) == [
        "invalid fund_type", "missing amount", "missing program_id", "missing program_name",
        "negative amount"]
    assert not Q.validation_verdict(rows.limit(0), errors.limit(0)).first().is_valid


def test_shares_sum_to_hundred(spark):
    rows = frame(spark, [("A", 33), ("B", 33), ("C", 34), (None, 7)], "g string, amount int")
    shares = R.aggregate_by(rows, ["g"]).agg(F.sum("pct_of_total")).first()[0]
    assert shares == pytest.approx(100)
    with pytest.raises(ValueError):
        R.aggregate_by(rows, ["missing"])


def test_first_and_last_texts_are_hashed_before_they_are_sorted(spark):
    rows = [("a", "x"), ("a", "x"), ("a", None), ("b", None), (None, "z"), (None, "y"), ("c", "")]
    out = C.first_and_last(spark.createDataFrame(rows * 3, "k string, t string"), ["k"], "t", "lo", "hi")
    assert {tuple(r) for r in out.collect()} == {
        ("a", "x", "x"), ("b", None, None), (None, "y", "z"), ("c", "", "")}
    # one grouping by key and text under the one that picks the least and the largest
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2
