"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_oracle import rows_of

QUERIES = contract.queries()
ORACLES = contract.oracle_sql()

# One query per family here; tools/check_oracle.py runs all of them.
SAMPLE = ["agg_by", "stats_by", "metrics", "county_op", "compare_null_keys", "apply_changes",
          "fuzzy_match", "augment", "dept_series", "money", "lines", "search", "amend",
          "projects", "grant_audit", "nearest_col", "deltas", "validate"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def test_entry(spark):
    df = contract.entry(spark)
    rows = df.collect()
    assert rows and abs(sum(r.pct_of_total for r in rows) - 100) < 0.2


def test_names_are_paired():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cur = duck.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(
        columns, cur.fetchall())


@pytest.mark.parametrize("name", ["agg_by", "compare", "dept_rollup", "draft_compare"])
def test_plans_have_no_pairwise_joins(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_first_lines_are_found_before_parts_are_joined(spark, sf_dir):
    from coffer.plans.testdata import allocations, first_lines

    lines, rows = {}, allocations(spark, sf_dir, "program_id", "line_number").collect()
    for r in rows:
        lines[r.program_id] = min(r.line_number, lines.get(r.program_id, r.line_number))
    firsts = first_lines(spark, sf_dir)
    assert {r.program_id: r.line_number for r in firsts.collect()} == lines
    # line numbers repeat: every row that has one of them stays
    kept = allocations(spark, sf_dir, "program_id", "line_number", lines=firsts)
    assert sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in rows if r.line_number in set(lines.values()))
