"""Shared pieces: tables, intermediate results, words of a text, link components."""

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import functions as F

from ..session import importable  # noqa: F401

_FALLBACK = {}
#: whether Spark removes a query's shuffle files when it ends, or when the driver collects garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark):
    """The folder all executors see; a folder of our own only where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"file://{_FALLBACK['dir']}"


def materialize(df):
    """Write once to the shared folder and read on from there.

    Files survive the loss of an executor, and the next plan starts from a scan of known
    size with no inherited partitioning, so adaptive joins can split hot keys.  What the write
    shuffled is removed when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{os.getpid()}-{uuid.uuid4().hex}"
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df, column, buckets):
    """As :func:`materialize`, dealt into ``buckets`` by a column: later joins and groups on it
    read the rows in place and shuffle only the other side."""
    spark, name = df.sparkSession, f"llm_{os.getpid()}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.write.bucketBy(buckets, column).option("path", path).saveAsTable(name)
    return spark.table(name)


def small_batches(spark, rows=500):
    """Python tasks get batches of at most ``rows`` texts, whatever the texts' length.

    Also lets workers on this machine import the package when the driver found it by a path
    of its own; on a cluster it is shipped with the job.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


class Recent:
    """A memory of at most ``2 * limit`` results that keeps what is asked for again.

    When the young half is full it becomes the old one; an old entry that is used moves back.
    """

    def __init__(self, limit):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        """For keys that are not in ``young``."""
        found = self.old.get(key)
        if found is not None:
            self.put(key, found)
        return found

    def put(self, key, value):
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Words:
    """Words of many texts at once: byte buffer, bounds and owner of every word.

    ``table`` maps each byte to itself, to another byte (lower case) or to 0 for bytes that
    separate words.  Texts are joined by a separator, so words never span two texts.
    """

    def __init__(self, texts, table):
        raw = b"\0".join(texts) + b"\0"
        self.raw = table[np.frombuffer(raw, np.uint8)]
        inside = self.raw != 0
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.first_byte = np.concatenate(([0], np.cumsum(sizes)))
        # first word of each text, and one past the last
        self.first = np.searchsorted(self.start, self.first_byte)
        self.n_words = np.diff(self.first)

    def hashes(self):
        """A 64-bit hash of every word, the same for equal words anywhere."""
        n = len(self.raw)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        value = BYTE_VALUES[self.raw]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value * _powers(n, BASE), out=total[1:])
        h = (total[self.end] - total[self.start]) * _powers(n, INVERSE)[self.start]
        return mix(h)


BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS = {}


def _powers(n, base):
    """base ** (0 .. n-1) modulo 2**64, kept and grown by doubling."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            step = np.uint64(pow(int(base), len(have), 1 << 64))
            have = np.concatenate((have, have * step))
        _POWERS[int(base)] = have
    return have[:n]


def mix(x):
    """Spread a 64-bit value over all bits (finaliser of a multiply-xorshift hash)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def gram_hashes(h, k):
    """Hash of every run of ``k`` values of ``h`` (one per start; empty if there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(len(h), BASE))))
    return mix((total[k:] - total[:-k]) * _powers(n, INVERSE))


def sliding_min(x, w):
    """Minimum of every run of ``w`` values, by doubling."""
    return _sliding(x, w, np.minimum)


def sliding_max(x, w):
    return _sliding(x, w, np.maximum)


def _sliding(x, w, op):
    have, span = x, 1
    while span * 2 <= w:
        have = op(have[:-span], have[span:])
        span *= 2
    rest = w - span
    return op(have[:-rest], have[rest:]) if rest else have


def window_minima(h, w):
    """Positions that hold the minimum of some run of ``w`` values, ties included."""
    if len(h) < w or not len(h):
        return np.zeros(0, np.int64)
    low = sliding_min(h, w)
    if w > 1:
        pad = np.zeros(w - 1, low.dtype)
        low = sliding_max(np.concatenate((pad, low, pad)), w)
    return np.flatnonzero(low == h)


def union_pairs(n, a, b):
    """Smallest index reachable over the links (a, b) for each of n nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def components(edges):
    """Connected components of links ``(u, v)``: one row ``(node, component)`` per linked node.

    ``component`` is the smallest node reachable.  Each round every node is merged into the
    neighbour of lowest random priority and the links are carried over, so a chain of any
    length shrinks by a constant factor a round.  Only partial minima and joins on written
    tables are used: a node with very many links is split by adaptive execution.
    """
    spark = edges.sparkSession
    edges = materialize(edges.where("u <> v").select("u", "v").distinct())
    first = edges
    merged, rounds = [], 0
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(rounds)), F.col(c).alias("n"))  # noqa: E731,B023
        both = edges.union(edges.select("v", "u"))
        parent = materialize(
            both.groupBy("u").agg(F.min(rank("v")).alias("low"))
            .select(F.col("u").alias("node"), F.least("low", rank("u"))["n"].alias("parent")))
        merged.append(parent)
        left = parent.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        right = parent.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        half = materialize(edges.join(left, "u").select("pu", "v").distinct())
        edges = materialize(
            half.join(right, "v").where("pu <> pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        rounds += 1
    if not merged:
        return spark.createDataFrame([], f"node {first.schema['u'].dataType.simpleString()}, "
                                         f"component {first.schema['u'].dataType.simpleString()}")
    label = merged[0]
    for step in merged[1:]:
        up = step.select(F.col("node").alias("parent"), F.col("parent").alias("higher"))
        label = materialize(label.join(up, "parent", "left").select(
            "node", F.coalesce("higher", "parent").alias("parent")))
    lowest = materialize(label.groupBy("parent").agg(F.min("node").alias("component")))
    return label.join(lowest, "parent").select("node", "component")
