"""Registry of queries, plus the shared SQL view of the star schema."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FUND_NAMES

QUERIES = {}
ORACLES = {}

# Integer columns that SQL types more narrowly than the 64-bit output here.
LONG_COLUMNS = {
    "carry": ["line_no"], "year_pair": ["line_no"], "positions": ["line_no"], "amend": ["line_no"],
    "bill_allocations": ["line_number"], "projects": ["line_number"], "reissue": ["block"],
    "grants": ["block_line", "line_number"], "grant_audit": ["block_line"],
    "county_op": ["level"], "gf_tree": ["level"], "money": ["l_linenumber"],
    "veto_unpivot": ["fiscal_year"], "one_time": ["fiscal_year"], "cat_order": ["place"],
    "year_detail": ["source_rank"], "first_source": ["source_rank"],
    "word_lines_thirds": ["n_words"], "nearest_col": ["line_top", "ordinal"],
    "stacked_lines": ["n"], "band_values": ["n"], "revenue_cells": ["fiscal_year"],
    "banded_projects": ["n"], "deltas": ["fiscal_year"], "source_counts": ["source_rank"],
}


def query(name, sql=None):
    """Register a query; ``sql`` is its counterpart over the same tables."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
        if sql is not None:
            casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in LONG_COLUMNS.get(name, []))
            ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql
        return fn

    return add


def plain(df):
    """Exact decimals to doubles at the output only, integers to long."""
    columns = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            columns.append(F.col(f.name).cast("double").alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            columns.append(F.col(f.name).cast("long").alias(f.name))
        else:
            columns.append(F.col(f.name))
    return df.select(*columns)


_FUND_CASE = " ".join(
    f"WHEN '{p}' THEN '{FUND_NAMES[f]}'"
    for p, f in {"1": "A", "2": "B", "3": "N", "4": "C", "5": "W"}.items()
)

ALLOC = f"""alloc AS (
  SELECT l_orderkey * 10 + l_linenumber AS line_number,
         l_partkey AS part_key, l_suppkey AS supplier_key,
         upper(substr(p_type, 1, 3)) || lpad(CAST(p_size AS VARCHAR), 3, '0') AS program_id,
         p_name AS program_name, p_brand AS category,
         n_name AS department_code, n_name || ' ' || r_name AS department_name,
         CASE WHEN l_returnflag = 'N' THEN 'Operating'
              WHEN l_returnflag = 'A' THEN 'Capital Improvement'
              WHEN l_returnflag = 'R' AND l_discount > 0.095 THEN 'Grants in Aid'
              WHEN l_returnflag = 'R' THEN 'One-Time' END AS section,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'A' WHEN '2' THEN 'B'
              WHEN '3' THEN 'N' WHEN '4' THEN 'C' WHEN '5' THEN 'W' END AS fund_type,
         CASE substr(o_orderpriority, 1, 1) {_FUND_CASE} END AS fund_category,
         CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 7 THEN 1 ELSE 0 END AS BIGINT)
           AS fiscal_year,
         CAST(l_extendedprice AS DECIMAL(18, 2)) AS amount,
         CASE WHEN l_tax <> 0 THEN CAST(l_quantity AS DECIMAL(12, 2)) END AS positions,
         l_linestatus AS draft
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN part ON l_partkey = p_partkey
)"""


def with_alloc(*rest):
    """SQL text over the shared view; the last part is the final SELECT."""
    return "WITH " + ", ".join([ALLOC, *rest[:-1]]) + " " + rest[-1].lstrip()
