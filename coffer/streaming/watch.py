"""New allocation files to a refreshed rollup and validation findings.

Each micro-batch adds its partial sums to the rollup of the batch before and writes
the whole rollup, one row per department, into one of two places by turns. A place
holds one file that appears when its write is committed, so a reader always finds one
whole version, and a repeated batch starts from the version before it and writes the
same again. Findings are kept in levels: full sets of small batches are merged into one
file of the next level. However many batches have run, a read opens a bounded number of
files for the rollup, and one that grows with the logarithm of the batches for findings.
"""

from pyspark.sql import functions as F

from ..operators.quality import validate_rows
from ..operators.rollup import sum_section
from ..schema import ALLOCATION, CAPITAL, ONE_TIME, OPERATING

ROLLUP = {
    "department_code": "string", "name": "string", "operating_budget": "decimal(28,2)",
    "capital_budget": "decimal(28,2)", "one_time_appropriations": "decimal(28,2)",
    "positions": "decimal(22,2)", "batch": "long"}
PARTIAL = ["operating_budget", "capital_budget", "one_time_appropriations", "positions"]


def partial_rollup(rows):
    return rows.groupBy("department_code").agg(
        F.min("department_name").alias("name"),
        sum_section(OPERATING).alias("operating_budget"),
        sum_section(CAPITAL).alias("capital_budget"),
        sum_section(ONE_TIME).alias("one_time_appropriations"),
        F.coalesce(F.sum("positions"), F.lit(0)).alias("positions"))


def _merged(parts):
    return parts.groupBy("department_code").agg(
        F.min("name").alias("name"), *[F.sum(c).alias(c) for c in PARTIAL])


def _versions(spark, state_path):
    """Rollup rows of both places, with their batch; None before the first batch."""
    fs = _files(spark, state_path)
    places = [f"{state_path}/rollup/place={i}" for i in (0, 1)]
    there = [p for p in places if fs(p, "exists")]
    return spark.read.schema(", ".join(f"{n} {t}" for n, t in ROLLUP.items())).option("ignoreMissingFiles", True).parquet(*there) if there else None


def _files(spark, path):
    """Existence and deletion of paths in the file system of ``path``."""
    jvm = spark.sparkContext._jvm
    to_path = jvm.org.apache.hadoop.fs.Path
    system = to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def act(p, what):
        return system.exists(to_path(p)) if what == "exists" else system.delete(to_path(p), True)

    return act


def read_rollup(spark, state_path):
    """Current rollup: the rows of the newest whole version."""
    rows = _versions(spark, state_path)
    if rows is None:
        raise ValueError("no batch has been handled yet")
    newest = rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar())
    return newest.where(F.col("department_code").isNotNull()).drop("batch").withColumn(
        "total_budget", F.col("operating_budget") + F.col("capital_budget") + F.col("one_time_appropriations"))


def _refresh_rollup(batch, batch_id, state_path):
    new, old = partial_rollup(batch), _versions(batch.sparkSession, state_path)
    if old is not None:
        # a repeated batch sees its own version as well and goes by the one before
        last = old.where(F.col("batch") < batch_id).agg(F.max("batch")).first()[0]
        if last is not None:
            new = _merged(new.unionByName(old.where(F.col("batch") == last).drop("batch")))
    new.select(
        *[F.col(n).cast(t).alias(n) for n, t in ROLLUP.items() if n != "batch"],
        F.lit(batch_id).cast("long").alias("batch")).coalesce(1).write.mode("overwrite").parquet(
        f"{state_path}/rollup/place={batch_id % 2}")


def _refresh_findings(batch, batch_id, state_path, width):
    spark, fs = batch.sparkSession, _files(batch.sparkSession, state_path)

    def place(level, number):
        return f"{state_path}/findings/level={level}/part={number}"

    validate_rows(batch, ["program_id", "line_number"]).coalesce(1).write.mode("overwrite").parquet(
        place(0, batch_id))
    level, number = 0, batch_id
    while (number + 1) % width == 0:
        parts = [place(level, n) for n in range(number - width + 1, number + 1)]
        parts = [p for p in parts if fs(p, "exists")]  # all gone if this merge is repeated
        if len(parts) == width:
            spark.read.parquet(*parts).coalesce(1).write.mode("overwrite").parquet(place(level + 1, number // width))
        for p in parts:
            fs(p, "delete")
        level, number = level + 1, number // width


def read_findings(spark, state_path, width=32):
    """Findings of all batches; parts that a merge has replaced but not yet removed are left out."""
    rows = spark.read.option("ignoreMissingFiles", True).parquet(f"{state_path}/findings")
    parts = [(r["level"], r["part"]) for r in rows.select("level", "part").distinct().collect()]
    covered = {(low, n) for level, part in parts for low in range(level)
               for n in range(part * width ** (level - low), (part + 1) * width ** (level - low))
               if (low, n) in set(parts)}
    for level, part in covered:
        rows = rows.where((F.col("level") != level) | (F.col("part") != part))
    return rows.drop("level", "part")


def watch_allocations(spark, path, state_path, checkpoint, schema=ALLOCATION, once=True, width=32):
    """Start the refresh; with ``once`` it handles what is there and stops.

    ``checkpoint`` and ``state_path`` belong together: batch numbers go on from the
    checkpoint.
    """
    stream = spark.readStream.schema(schema).parquet(path)

    def refresh(batch, batch_id):
        _refresh_rollup(batch, batch_id, state_path)
        _refresh_findings(batch, batch_id, state_path, width)

    writer = stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(
        processingTime="1 second")
    return writer.start()
