"""Near copies among embeddings by cross-polytope hashing."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .common import components, materialize, small_batches, union_pairs


def hadamard(x):
    """Fast Walsh-Hadamard transform of the rows of x (a power of two wide), orthonormal."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


class CrossPolytope:
    """Codes of unit vectors: nearest signed axis after random rotations.

    A rotation is three rounds of random signs and a fast Hadamard transform.  A table joins
    ``k`` rotations into one code.  Besides its own code a vector probes, per table, the
    codes in which one rotation takes its next best axis, best first.
    """

    def __init__(self, dim, tables, k, probes, seed=11):
        self.width = 1 << max(1, (dim - 1).bit_length())
        self.tables, self.k, self.probes = tables, k, probes
        rng = np.random.default_rng(seed)
        self.signs = rng.choice((-1.0, 1.0), (tables, k, 3, self.width))

    def codes(self, x):
        """(own codes, probe codes): arrays of shape (n, tables) and (n, tables, probes)."""
        n = len(x)
        x = np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
        own = np.zeros((n, self.tables), np.int64)
        probe = np.zeros((n, self.tables, self.probes), np.int64)
        base = 2 * self.width
        for t in range(self.tables):
            first, change, loss = np.zeros(n, np.int64), [], []
            for j in range(self.k):
                y = x
                for s in self.signs[t, j]:
                    y = hadamard(y * s)
                size = np.abs(y)
                top = np.argsort(-size, 1, kind="stable")[:, :1 + self.probes]
                axis = 2 * top + (np.take_along_axis(y, top, 1) < 0)
                big = np.take_along_axis(size, top, 1)
                scale = base ** j
                first += axis[:, 0] * scale
                change.append((axis[:, 1:] - axis[:, :1]) * scale)
                loss.append(big[:, :1] - big[:, 1:])
            change, loss = np.concatenate(change, 1), np.concatenate(loss, 1)
            best = np.argsort(loss, 1, kind="stable")[:, :self.probes]
            own[:, t] = first
            probe[:, t] = first[:, None] + np.take_along_axis(change, best, 1)
        return own, probe


def _unit(rows):
    x = np.array(rows.tolist(), np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _bucket_links(x, weight, own, probe, home, table, code, threshold, block=2048):
    """Verified pairs of one bucket that did not meet before: (i, j) with i a home row."""
    homes, every = np.flatnonzero(home), np.arange(len(x))
    found_i, found_j = [], []
    for a in range(0, len(homes), block):
        for b in range(0, len(every), block):
            i, j = np.nonzero(x[homes[a:a + block]] @ x[every[b:b + block]].T >= threshold)
            i, j = homes[a + i], every[b + j]
            keep = ~home[j] | (i < j)
            found_i.append(i[keep])
            found_j.append(j[keep])
    i = np.concatenate(found_i) if found_i else np.zeros(0, np.int64)
    j = np.concatenate(found_j) if found_j else np.zeros(0, np.int64)
    if not len(i):
        return i, j
    met = ((own[i] == own[j]) | (own[i][:, :, None] == probe[j]).any(2)
           | (own[j][:, :, None] == probe[i]).any(2))
    seen = met[:, :table].any(1)
    # within the table both may probe each other's bucket: the lower code counts
    both = ((own[i][:, table, None] == probe[j][:, table]).any(1)
            & (own[j][:, table, None] == probe[i][:, table]).any(1))
    later = both & (np.minimum(own[i][:, table], own[j][:, table]) != code)
    return i[~seen & ~later], j[~seen & ~later]


def embedding_links(vectors, threshold=0.95, tables=4, probes=2, bucket_rows=4096,
                    id_col="vec_id", vector_col="embedding"):
    """Links and classes of embeddings at a cosine of ``threshold`` or more.

    One row per input row: id, ``n_links`` (other rows linked directly, copies included),
    ``component_id`` (smallest id reachable), ``kept`` (the row is that id).  Every pair that
    shares a bucket is checked with the exact cosine in double precision.  Vectors that are
    null, empty, zero, or hold null or non-finite parts link with nothing; vectors of
    different length do not link; rows with equal ids stay separate rows; other columns are
    ignored; an empty table gives an empty result.

    Equal vectors are one node with a weight.  A bucket with more than ``bucket_rows`` own
    rows is split into parts that meet each other as guests, so no task holds a hot bucket.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    v = F.col("v")
    ok = (v.isNotNull() & (F.size(v) > 0)
          & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
          & F.exists(v, lambda e: e != 0))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    good = rows.where("ok")
    nodes = materialize(good.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("w")))
    sizes = [r["n"] for r in nodes.select(F.size("v").alias("n")).distinct().collect()]
    counts, edges = [], []
    for dim in sizes:
        part = nodes.where(F.size("v") == dim)
        n = part.count()
        k = max(1, math.ceil(math.log(max(n, 2) / 64) / math.log(2 * dim))) if n > 64 else 1
        found = materialize(_dim_links(part, dim, CrossPolytope(dim, tables, k, probes),
                                       threshold, bucket_rows))
        counts.append(found.where("v IS NULL").select("u", "n"))
        edges.append(found.where("v IS NOT NULL").select("u", "v"))
    if not sizes:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                           F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    all_counts, all_edges = counts[0], edges[0]
    for c, e in zip(counts[1:], edges[1:]):
        all_counts, all_edges = all_counts.union(c), all_edges.union(e)
    linked = components(all_edges)
    per_node = all_counts.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    known = materialize(
        nodes.join(per_node, "node", "left").join(linked, "node", "left")
        .select("v", "w", F.coalesce("n", F.lit(0)).alias("n"),
                F.coalesce("component", "node").alias("component")))
    marked = good.select("id", "v").join(known, "v").select(
        "id", (F.col("n") + F.col("w") - 1).alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("NOT ok").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return marked.union(alone).select(
        F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id",
        (F.col("id") == F.col("component_id")).alias("kept"))


def _dim_links(nodes, dim, lsh, threshold, bucket_rows):
    """Rows (u, v, n): links u - v that join the classes, and link counts n of u (v null)."""
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast(lsh)

    def hash_rows(batches):
        h = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            own, probe = h.codes(_unit(pdf["v"]))
            packed = [a.tobytes() + b.tobytes() for a, b in zip(own, probe)]
            for t in range(h.tables):
                for p in range(-1, h.probes):
                    code = own[:, t] if p < 0 else probe[:, t, p]
                    yield pd.DataFrame({"t": t, "code": code, "home": p < 0, "node": pdf["node"],
                                        "w": pdf["w"], "v": pdf["v"], "codes": packed})

    def check(batches):
        h, rest = shared.value, None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat((rest, pdf), ignore_index=True)
            key = rest[["t", "code", "part"]].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            if len(cut):
                yield _bucket_batch(rest.iloc[:cut[-1]], np.concatenate(([0], cut)), h, threshold)
                rest = rest.iloc[cut[-1]:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield _bucket_batch(rest, np.array([0, len(rest)]), h, threshold)

    dealt = materialize(nodes.select("node", "w", "v").mapInPandas(
        hash_rows, "t int, code long, home boolean, node long, w long, v array<double>, codes binary"))
    full = materialize(dealt.where("home").groupBy("t", "code").agg(F.count("*").alias("rows"))
                       .where(F.col("rows") > bucket_rows))
    parts = F.coalesce(F.ceil(F.col("rows") / bucket_rows), F.lit(1)).cast("int")
    dealt = (dealt.join(full, ["t", "code"], "left").withColumn("parts", parts)
             .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
             .withColumn("part", F.explode(F.when(F.col("home"), F.sequence("mine", F.col("parts") - 1))
                                           .otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
             .withColumn("home", F.col("home") & (F.col("part") == F.col("mine")))
             .select("t", "code", "part", "home", "node", "w", "v", "codes"))
    return (dealt.repartition("t", "code", "part").sortWithinPartitions("t", "code", "part")
            .mapInPandas(check, "u long, v long, n long"))


def _bucket_batch(pdf, bounds, h, threshold):
    x = _unit(pdf["v"])
    size = 8 * h.tables
    own = np.array([np.frombuffer(c, np.int64, h.tables) for c in pdf["codes"]])
    probe = np.array([np.frombuffer(c, np.int64, offset=size) for c in pdf["codes"]])
    probe = probe.reshape(len(pdf), h.tables, h.probes)
    home, w, node = pdf["home"].to_numpy(), pdf["w"].to_numpy(), pdf["node"].to_numpy()
    t, code = pdf["t"].to_numpy(), pdf["code"].to_numpy()
    count = np.zeros(len(pdf), np.int64)
    label = np.arange(len(pdf))
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a < 2 or not home[a:b].any():
            continue
        s = slice(a, b)
        i, j = _bucket_links(x[s], w[s], own[s], probe[s], home[s], t[a], code[a], threshold)
        np.add.at(count, a + i, w[a + j])
        np.add.at(count, a + j, w[a + i])
        label[s] = a + union_pairs(b - a, i, j)
    some, moved = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(pdf)))
    return pd.DataFrame({
        "u": np.concatenate((node[some], node[label[moved]])),
        "v": pd.array(np.concatenate((np.zeros(len(some), np.int64), node[moved])), "Int64")
        if not len(some) else pd.array([None] * len(some) + node[moved].tolist(), "Int64"),
        "n": np.concatenate((count[some], np.zeros(len(moved), np.int64)))})
