"""Chunked operators against brute force on small random data."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from coffer.operators import ordered as O
from coffer.operators.shares import add_metrics


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    # One key holds most rows.
    return [("hot" if rng.random() < 0.7 else rng.choice("abc"), i,
             rng.randint(1, 9) if rng.random() < 0.2 else None) for i in range(400)]


@pytest.mark.parametrize("inclusive", [True, False])
def test_carry_forward(spark, rows, inclusive):
    df = spark.createDataFrame(rows, "k string, o long, v int").repartition(5)
    got = {(r.k, r.o): r.c for r in O.carry_forward(
        df, ["k"], "o", {"c": F.col("v")}, inclusive, chunk_rows=16).collect()}
    last, want = {}, {}
    for k, o, v in rows:
        before = last.get(k)
        if v is not None:
            last[k] = v
        want[(k, o)] = last.get(k) if inclusive else before
    assert got == want


def test_reset_event(spark):
    df = spark.createDataFrame([("d", 1, "x"), ("d", 2, None), ("d", 3, "reset"), ("d", 4, None)],
                               "k string, o long, v string")
    event = F.when(F.col("v") == "reset", F.struct(F.lit(None).cast("string").alias("s"))).when(
        F.col("v").isNotNull(), F.struct(F.col("v").alias("s")))
    got = O.carry_forward(df, ["k"], "o", {"e": event}, chunk_rows=2).orderBy("o").select("e.s")
    assert [r.s for r in got.collect()] == ["x", "x", None, None]


def test_running_total(spark, rows):
    df = spark.createDataFrame(rows, "k string, o long, v int").repartition(5)
    got = {(r.k, r.o): r.t for r in O.running_total(
        df, ["k"], "o", {"t": F.col("v")}, chunk_rows=16).collect()}
    sums, want = {}, {}
    for k, o, v in rows:
        sums[k] = sums.get(k, 0) + (v or 0)
        want[(k, o)] = sums[k]
    assert got == want


def test_neighbours(spark):
    df = spark.createDataFrame([("d", i, chr(96 + i)) for i in (1, 2, 3)],
                               "k string, o long, t string")
    got = O.with_neighbours(df, ["k"], "o", ["t"]).orderBy("o").collect()
    assert [(r.prev_t, r.next_t) for r in got] == [(None, "b"), ("a", "c"), ("b", None)]


def test_rank_and_median(spark):
    rng = random.Random(3)
    data = [(rng.choice(["x", "x", "y", None]), round(rng.uniform(0, 90), 1)) for _ in range(301)]
    df = spark.createDataFrame(data, "k string, v double").withColumn(
        "v", F.col("v").cast("decimal(18,2)"))
    ranked = O.dense_rank_desc(df, ["k"], "v", "r", width=10).collect()
    for r in ranked:
        higher = {v for k, v in data if k == r.k and v > float(r.v)}
        assert r.r == len(higher) + 1
    for r in O.exact_median(df, ["k"], "v", width=10).collect():
        assert r["median"] == pytest.approx(median(v for k, v in data if k == r.k))


def test_rank_and_median_over_twelve_orders_of_magnitude(spark):
    rng = random.Random(4)
    data = [(rng.choice(["x", "y"]), rng.choice([-1, 1, 1]) * round(10 ** rng.uniform(-2, 12), 2))
            for _ in range(400)]
    for kind in ("decimal(18,2)", "decimal(38,2)"):
        df = spark.createDataFrame(data, "k string, v double").withColumn("v", F.col("v").cast(kind))
        for r in O.exact_median(df, ["k"], "v").collect():
            assert r["median"] == pytest.approx(median(v for k, v in data if k == r.k))
        whole = O.exact_median(df, [], "v").first()["median"]
        assert whole == pytest.approx(median(v for _, v in data))
        order = sorted({v for _, v in data}, reverse=True)
        for r in O.dense_rank_desc(df, [], "v", "r").collect():
            assert order[r.r - 1] == pytest.approx(float(r.v))


def test_nested_running_total(spark):
    rng = random.Random(5)
    data = [(rng.choice(["x", None]), i, rng.randint(0, 9)) for i in rng.sample(range(10**6), 300)]
    df = spark.createDataFrame(data, "k string, o long, v int").repartition(4)
    levels = {"a": F.floor(F.col("o") / 100_000), "b": F.floor(F.col("o") / 1000)}
    for r in O.nested_running_total(df, ["k"], levels, "o", {"t": F.col("v")}).collect():
        assert r.t == sum(v for k, o, v in data if k == r.k and o <= r.o)


def test_metrics_with_nulls_and_ties(spark):
    df = spark.createDataFrame(
        [("A", 60.0, 2.0), ("A", 40.0, None), ("B", 60.0, 0.0), ("B", None, 1.0)],
        "department_code string, a double, p double").select(
        "department_code", F.col("a").cast("decimal(18,2)").alias("amount"),
        F.col("p").cast("decimal(12,2)").alias("positions"))
    got = {(r.department_code, r.amount and float(r.amount)):
           (r.pct_of_total, r.pct_of_dept, r.rank_in_dept, r.rank_overall, r.cost_per_position)
           for r in add_metrics(df).collect()}
    assert got[("A", 60.0)] == (37.5, 60.0, 1, 1, 30.0)
    assert got[("A", 40.0)] == (25.0, 40.0, 2, 2, None)
    assert got[("B", 60.0)] == (37.5, 100.0, 1, 1, None)
    assert got[("B", None)][2:] == (None, None, None)


def test_metrics_join_the_rows_once(spark):
    df = spark.range(1000).select(
        (F.col("id") % 7).cast("string").alias("department_code"),
        F.when(F.col("id") % 10 != 0, F.col("id") % 90).cast("decimal(18,2)").alias("amount"))
    out = add_metrics(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 1000") == 1
    rows = [(r.department_code, r.amount, r.rank_in_dept, r.rank_overall) for r in out.collect()]
    assert len(rows) == 1000 and out.columns[2:] == ["pct_of_total", "pct_of_dept", "rank_in_dept", "rank_overall"]
    for d, a, inside, overall in rows:
        assert (overall, inside) == ((None, None) if a is None else (
            len({x for _, x, _, _ in rows if x is not None and x >= a}),
            len({x for e, x, _, _ in rows if e == d and x is not None and x >= a})))


def test_hot_key_stays_exact(spark):
    df = spark.range(20_000).select(
        F.lit("hot").alias("k"), F.col("id").alias("o"),
        F.when(F.col("id") % 997 == 0, F.col("id")).alias("v"))
    out = O.carry_forward(df, ["k"], "o", {"c": F.col("v")}, chunk_rows=500)
    assert out.where(F.col("c") != F.col("o") - F.col("o") % 997).count() == 0


def test_places_follow_the_order_over_many_partitions(spark):
    rows = [(i * 7919 % 5003, i) for i in range(5000)] + [(None, 5000)]
    frame = spark.createDataFrame(rows, "v int, i int").repartition(7)
    placed = O.with_place(frame, [F.desc_nulls_last("v"), "i"]).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r["v"], r["i"]) for r in sorted(placed, key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in placed) == list(range(1, 5002))
    assert O.with_place(frame.limit(0), ["v"]).count() == 0
