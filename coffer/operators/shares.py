"""Shares, ranks and per-position cost (the derived metrics)."""

from pyspark.sql import functions as F

from ..session import write_out
from .ordered import dense_rank_desc, null_safe_join


def total_of(df, value):
    """Grand total as a scalar, evaluated once and used as a literal."""
    return df.agg(F.coalesce(F.sum(value), F.lit(0)).alias("__total")).scalar()


def percent(part, whole, digits=2, when_zero=None):
    """Half-even rounded percentage as double; ``when_zero`` for an empty base."""
    ratio = F.bround(
        part.cast("double") / F.nullif(whole, F.lit(0)).cast("double") * 100, digits
    )
    return ratio if when_zero is None else F.coalesce(ratio, F.lit(float(when_zero)))


def add_share_of_total(df, value="amount", out="pct_of_total", digits=2):
    whole = total_of(df, value)
    return df.withColumn(
        out,
        F.when(F.col(value).isNotNull(), percent(F.col(value), whole, digits, when_zero=0)),
    )


def add_share_of_group(df, keys, value="amount", out="pct_of_group", digits=2):
    """Share of the group's sum, through an aggregate and a join."""
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__group_sum"))
    joined = null_safe_join(df, sums, list(keys))
    return joined.withColumn(out, percent(F.col(value), F.col("__group_sum"), digits)).drop(
        "__group_sum")


def add_metrics(df, value="amount", group="department_code", positions="positions"):
    """Share of total and of department, both ranks, cost per position.

    Sums and ranks are found on the distinct amounts of each group, which are written once;
    the rows are read twice and joined once, whatever figures they get.
    """
    amounts = write_out(df.groupBy(group, value).agg(F.sum(value).alias("__sum")))
    whole = total_of(amounts, "__sum")
    sums = amounts.groupBy(group).agg(F.sum("__sum").alias("__group_sum"))
    found = dense_rank_desc(amounts.select(group, value), [group], value, "rank_in_dept")
    overall = dense_rank_desc(amounts.select(value).distinct(), [], value, "rank_overall")
    found = null_safe_join(null_safe_join(found, sums, [group]), overall, [value])
    out = null_safe_join(df, found, [group, value]).select(
        *df.columns,
        F.when(F.col(value).isNotNull(), percent(F.col(value), whole, when_zero=0)).alias("pct_of_total"),
        percent(F.col(value), F.col("__group_sum")).alias("pct_of_dept"), "rank_in_dept", "rank_overall")
    if positions in df.columns:
        out = out.withColumn(
            "cost_per_position",
            F.bround(
                F.col(value).cast("double") / F.nullif(F.col(positions), F.lit(0)).cast("double"),
                0),
        )
    return out
