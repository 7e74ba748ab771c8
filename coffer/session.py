"""Session settings the library is designed for."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app="coffer", master=None, shuffle_partitions=None, progress=True):
    """Create (or reuse) a session with adaptive execution and UTC times.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: adaptive
    execution coalesces or splits partitions from measured sizes.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if not progress:
        builder = builder.config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_OWN = {}


def shared_folder(spark):
    """The folder all executors see, by ``spark.checkpoint.dir``; a folder of our own only in a
    local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"file://{_OWN['dir']}"


def cut_lineage(df):
    """Write the rows to the session's shared checkpoint folder and read on from there.

    Used where one intermediate result feeds several branches, and between the
    rounds of an iteration. A folder of our own is set only where the session names none, which is the
    case in single-machine tests.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if spark.sparkContext.getCheckpointDir() is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return df.checkpoint(eager=True)


def write_out(df):
    """As :func:`cut_lineage`, in compressed columns: for tables of many rows that repeat long texts."""
    path = f"{shared_folder(df.sparkSession)}/rows-{os.getpid()}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def importable(spark):
    """Lets workers on this machine import the package when the driver found it by a path of its
    own; on a cluster it is shipped with the job."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
