"""Order-dependent operators that never hold one whole group in a task.

A key may own a third of all rows, so nothing here opens a window over the
plain key. Rows are cut into chunks of their order column (or of the value
range), each chunk is handled in parallel, and only the per-chunk summaries,
smaller by the chunk size, meet in a window over the key.
"""

from decimal import Decimal
from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..session import cut_lineage

CHUNK_ROWS = 65536


def null_safe_join(left, right, keys, how="left"):
    """Join on equal keys where NULL equals NULL, keeping the left key columns."""
    if not keys:
        raise ValueError("null_safe_join needs keys")
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def settle(df, columns):
    """Add computed columns that later filters read instead of recomputing.

    The values pass through a one-row generator, which the optimizer does not
    push conditions through; a long CASE is then evaluated once per row.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def _chunked(df, order, chunk_rows):
    return df.withColumn("__chunk", F.floor(F.col(order) / F.lit(chunk_rows)).cast("long"))


def carry_forward(df, keys, order, events, inclusive=True, chunk_rows=CHUNK_ROWS):
    """Latest non-NULL value of each event at (or before) every row.

    ``events`` maps an output column to a Column that is NULL where nothing
    happens. A reset is an event too: a struct whose field is NULL. Keys must
    not be NULL; with plain equality the join, the window and any further
    carry over the same keys share one shuffle of the rows.
    """
    base = _chunked(df, order, chunk_rows)
    for name, event in events.items():
        base = base.withColumn(f"__ev_{name}", event)
    parts = list(keys) + ["__chunk"]
    tails = base.groupBy(*parts).agg(
        *[
            F.max_by(f"__ev_{n}", F.when(F.col(f"__ev_{n}").isNotNull(), F.col(order))).alias(
                f"__in_{n}")
            for n in events
        ]
    )
    before = (
        W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    )
    starts = tails.select(
        *parts,
        *[F.last(f"__in_{n}", ignorenulls=True).over(before).alias(f"__in_{n}") for n in events],
    )
    joined = base.join(starts, parts, "left")
    inside = W.partitionBy(*parts).orderBy(order).rowsBetween(
        W.unboundedPreceding, 0 if inclusive else -1
    )
    return joined.select(
        *df.columns,
        *[
            F.coalesce(F.last(f"__ev_{n}", ignorenulls=True).over(inside),
                       F.col(f"__in_{n}")).alias(n)
            for n in events
        ],
    )


def running_total(df, keys, order, values, chunk_rows=CHUNK_ROWS):
    """Inclusive running sums; ``values`` maps an output column to a Column.

    Keys must not be NULL (see :func:`carry_forward`).
    """
    base = _chunked(df, order, chunk_rows)
    for name, value in values.items():
        base = base.withColumn(f"__v_{name}", value)
    parts = list(keys) + ["__chunk"]
    sums = base.groupBy(*parts).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values])
    before = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(
        *parts, *[F.sum(f"__s_{n}").over(before).alias(f"__o_{n}") for n in values]
    )
    joined = base.join(starts, parts, "left")
    inside = W.partitionBy(*parts).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return joined.select(
        *df.columns,
        *[
            (F.coalesce(F.col(f"__o_{n}"), F.lit(0))
             + F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0))).alias(n)
            for n in values
        ],
    )


def with_neighbours(df, keys, order, columns, step=1):
    """Columns of the physically previous and next row of a dense order column.

    An equality join on the shifted order, so that no group is windowed.
    """
    side = df.select(*keys, F.col(order).alias("__o"), *columns)
    before = side.select(
        *keys, (F.col("__o") + step).alias(order), *[F.col(c).alias(f"prev_{c}") for c in columns])
    after = side.select(
        *keys, (F.col("__o") - step).alias(order), *[F.col(c).alias(f"next_{c}") for c in columns])
    return df.join(before, [*keys, order], "left").join(after, [*keys, order], "left")


def range_offsets(ranges, keys, levels, sums, descending=False):
    """What precedes each range of its key, by nested ranges.

    ``levels`` are columns from coarse to fine; ``sums`` the columns to add up.
    Each window sees the ranges of one coarser range only, so its size is the
    fan-out of the levels, whatever the number or the spread of the rows.
    """
    totals = [ranges]
    for depth in range(len(levels) - 1, 0, -1):
        totals.insert(0, totals[0].groupBy(*keys, *levels[:depth]).agg(
            *[F.sum(s).alias(s) for s in sums]))
    found = None
    for depth, rows in enumerate(totals, 1):
        outer, inner = list(levels[:depth - 1]), F.col(levels[depth - 1])
        before = W.partitionBy(*keys, *outer).orderBy(
            inner.desc() if descending else inner.asc()).rowsBetween(W.unboundedPreceding, -1)
        here = rows.withColumns({
            f"before_{s}": F.coalesce(F.sum(s).over(before), F.lit(0)) for s in sums})
        if found is not None:
            above = found.select(*keys, *outer, *[
                F.col(f"before_{s}").alias(f"__above_{s}") for s in sums])
            here = null_safe_join(here, above, [*keys, *outer], "inner").withColumns({
                f"before_{s}": F.col(f"before_{s}") + F.col(f"__above_{s}") for s in sums}).drop(
                *[f"__above_{s}" for s in sums])
        found = here
    return found


def nested_running_total(df, keys, levels, order, values):
    """Inclusive running sums over rows ordered by nested ranges, then ``order``.

    ``levels`` maps names to Columns from coarse to fine; a row's place is given
    by all of them and, inside the finest, by ``order``. NULL keys are equal.
    """
    names = list(levels)
    base = df.withColumns({**levels, **{f"__v_{n}": v for n, v in values.items()}})
    ranges = base.groupBy(*keys, *names).agg(*[F.sum(f"__v_{n}").alias(n) for n in values])
    before = range_offsets(ranges, keys, names, list(values)).drop(*values)
    inside = W.partitionBy(*keys, *names).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return null_safe_join(base, before, [*keys, *names], "inner").select(
        *df.columns,
        *[(F.col(f"before_{n}") + F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0))).alias(n)
          for n in values])


FAN_DIGITS = 6


def _value_levels(df, value, width):
    """Nested value ranges: ``width`` at the finest, a million times wider at each step out.

    A decimal type bounds how many steps there are, so every range has at most a
    million ranges inside it, and the finest ``width`` / 0.01 amounts.
    """
    kind = df.schema[value].dataType
    digits = kind.precision - kind.scale if isinstance(kind, DecimalType) else 3 * FAN_DIGITS
    steps = max(1, -(-(digits - (len(str(width)) - 1)) // FAN_DIGITS))
    return {f"__l{i}": F.floor(F.col(value) / F.lit(Decimal(width * 10 ** (FAN_DIGITS * (steps - 1 - i))))).cast(
        "decimal(38,0)" if i == 0 and steps > 3 else "long") for i in range(steps)}


def _value_counts(df, keys, value, width):
    """Distinct values with their counts and their nested ranges."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("__n")).withColumns(_value_levels(df, value, width))


def dense_rank_desc(df, keys, value, out, width=10_000):
    """Dense rank by descending value; rows with a NULL value get NULL.

    Distinct values are ranked inside nested value ranges, so no window holds
    more than a million of them, however large or spread out a group is.
    """
    keys = list(keys)
    levels = list(_value_levels(df, value, width))
    distinct = _value_counts(df, keys, value, width).drop("__n")
    sizes = distinct.groupBy(*keys, *levels).agg(F.count(F.lit(1)).alias("__size"))
    offsets = range_offsets(sizes, keys, levels, ["__size"], descending=True).drop("__size")
    inside = W.partitionBy(*keys, *levels).orderBy(F.desc(value))
    ranked = null_safe_join(distinct, offsets, keys + levels, "inner").select(
        *keys, value, (F.col("before___size") + F.dense_rank().over(inside)).cast("long").alias(out)
    )
    return null_safe_join(df, ranked, keys + [value])


def exact_median(df, keys, value, out="median", width=10_000):
    """Exact median per group from value counts, through nested value ranges.

    Only the values of the ranges that hold the middle ranks are put in order.
    """
    keys = list(keys)
    levels = list(_value_levels(df, value, width))
    counts = _value_counts(df, keys, value, width)
    ranges = counts.groupBy(*keys, *levels).agg(F.sum("__n").alias("__size"))
    offsets = range_offsets(ranges, keys, levels, ["__size"])
    totals = ranges.groupBy(*keys).agg(F.sum("__size").alias("__total"))
    joined = null_safe_join(offsets, totals, keys) if keys else offsets.withColumn(
        "__total", ranges.agg(F.sum("__size").alias("__total")).scalar())
    placed = (
        joined.withColumn("__start", F.col("before___size"))
        .withColumn("__low", F.floor((F.col("__total") + 1) / 2))
        .withColumn("__high", F.floor((F.col("__total") + 2) / 2))
        .where((F.col("__start") < F.col("__high"))
               & (F.col("__start") + F.col("__size") >= F.col("__low")))
        .select(*keys, *levels, "__start", "__low", "__high")
    )
    inside = (
        W.partitionBy(*keys, *levels).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    )
    ends = null_safe_join(counts, placed, keys + levels, "inner").withColumn(
        "__last", F.col("__start") + F.sum("__n").over(inside))
    first = F.col("__last") - F.col("__n")
    holds_low = (first < F.col("__low")) & (F.col("__last") >= F.col("__low"))
    holds_high = (first < F.col("__high")) & (F.col("__last") >= F.col("__high"))
    low = F.max(F.when(holds_low, F.col(value)))
    high = F.max(F.when(holds_high, F.col(value)))
    middle = (low + high).cast("double") / 2
    return ends.groupBy(*keys).agg(middle.alias(out))


def with_place(df, order, out="place"):
    """Number all rows from 1 in a total order, without a window over all rows.

    A range-partitioned sort is written once; rows are numbered inside each of its partitions
    and the partition counts, one row a partition, give each its first number. ``order`` must
    leave no ties for the numbers to be reproducible. Runs Spark jobs when called.
    """
    row_bits = 33  # of the generated id: the row inside its partition
    placed = cut_lineage(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.select(
        *df.columns, F.shiftright("__id", row_bits).alias("__part"),
        F.col("__id").bitwiseAND(F.lit((1 << row_bits) - 1)).alias("__row"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    first = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    return placed.join(first, "__part").select(
        *df.columns, (F.col("__first") + F.col("__row") + 1).alias(out))


def top_per_group(df, keys, order, k):
    """First ``k`` rows per group; Spark trims each group before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def first_per_key(df, keys, order):
    """One whole row per key, the smallest by ``order`` (partial per task)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)
