"""Near copies by SimHash: fingerprints in shards of vantage-point trees."""

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import components, materialize, small_batches, union_pairs

SAMPLE_PER_SHARD = 16
#: fingerprints that are dealt to shards together
ROUTED = 20_000


def fingerprint(raw, words=4):
    """64-bit SimHash of a text given as bytes; no words: 0.

    Shingles of ``words`` words (split at ASCII white space, A-Z in lower case), repeats
    counted, are hashed by XXH64 with seed 42; a bit is set if over half the hashes set it.
    """
    parts = raw.lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(line, 42)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[:len(parts) - words + 1].tolist()
    h = np.array([digest(line[a:b], 42) for a, b in zip(begin, end[words - 1:].tolist())],
                 np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at:at + (1 << 16)].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(words):
    @F.pandas_udf(LongType())
    def of(text: pd.Series) -> pd.Series:
        values = [fingerprint((t or "").encode("utf-8", "surrogatepass"), words) for t in text]
        return pd.Series(np.array(values, np.uint64).view(np.int64))
    return of


ALL_BITS = (1 << 64) - 1


def bands(bits):
    """(mask, radius) pairs of which one holds for any two values at ``bits`` or fewer
    differing bits: the first band allows one differing bit, the others none."""
    n = max(1, bits)
    edge = [64 * i // n for i in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    return [(m, (1 if bits else 0) if i == 0 else 0) for i, m in enumerate(masks)]


class VantageTree:
    """Vantage-point tree over 64-bit values and the Hamming distance on a band of bits.

    A node keeps a vantage value and a radius: values within the radius lie inside, the
    others outside.  ``d(q, x) >= |d(q, v) - d(x, v)|`` lets a search leave out a side.
    Values that agree on the band are told apart by all bits, with the full search radius.
    """

    def __init__(self, values, leaf, mask=ALL_BITS, reach=4, full_reach=4, depth=48, seed=7):
        self.leaves, self.full_reach = 0, full_reach
        self.rng = np.random.default_rng(seed)
        self.root = self._grow(np.asarray(values, np.uint64), leaf, depth, np.uint64(mask), reach)

    def _grow(self, values, leaf, depth, mask, reach):
        if depth and len(values) > leaf:
            # of a few candidates, the vantage value whose distances spread most
            picks = values[self.rng.choice(len(values), min(8, len(values)), replace=False)]
            some = values[self.rng.choice(len(values), min(256, len(values)), replace=False)]
            spread = np.bitwise_count((picks[:, None] ^ some[None, :]) & mask).std(1)
            v = picks[spread.argmax()]
            d = np.bitwise_count((values ^ v) & mask)
            radius = int(np.median(d))
            if (d <= radius).all():
                radius = int(d.max()) - 1
            near = d <= radius
            if near.any():
                return (mask, v, radius, reach, self._grow(values[near], leaf, depth - 1, mask, reach),
                        self._grow(values[~near], leaf, depth - 1, mask, reach))
            if mask != np.uint64(ALL_BITS):
                return self._grow(values, leaf, depth, np.uint64(ALL_BITS), self.full_reach)
        self.leaves += 1
        return self.leaves - 1, values

    def reach(self, q, own):
        """(leaf number, leaf values, positions in q, own) for every leaf a value meets.

        A value has one leaf of its own.  From there it visits, as a guest, the leaves beyond
        a boundary within reach; of two values apart only the inner one crosses, and values
        that are guests from the start (``own`` false) look at both sides.
        """
        stack = [(self.root, np.arange(len(q)), own)]
        while stack:
            node, at, own = stack.pop()
            if not len(at):
                continue
            if len(node) == 2:
                yield node[0], node[1], at, own
                continue
            mask, v, radius, r, near, far = node
            d = np.bitwise_count((q[at] ^ v) & mask).astype(np.int64)
            inside = d <= radius
            go = inside | ~own & (d <= radius + r)
            stack.append((near, at[go], (own & inside)[go]))
            go = ~inside | (d > radius - r)
            stack.append((far, at[go], (own & ~inside)[go]))


def _links(values, guests, r):
    """Index pairs (i of values, j of values and guests together) within distance r."""
    every = np.concatenate((values, guests))
    order = np.argsort(values, kind="stable")
    tree = VantageTree(values, leaf=256, reach=r)
    left, right = [], []
    for _, held, at, _ in tree.reach(every, np.arange(len(every)) < len(values)):
        idx = order[np.searchsorted(values[order], held)]
        for block in range(0, len(at), 4096):
            part = at[block:block + 4096]
            i, j = np.nonzero(np.bitwise_count(every[part][:, None] ^ held[None, :]) <= r)
            left.append(idx[j])
            right.append(part[i])
    a = np.concatenate(left) if left else np.zeros(0, np.int64)
    b = np.concatenate(right) if right else np.zeros(0, np.int64)
    keep = a != b
    return a[keep], b[keep]


def _routed(pdf, trees):
    """Fingerprints of a batch beside every shard they meet: one frame a tree, however many its shards."""
    q, node = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["node"].to_numpy()
    for t, tree in enumerate(trees):
        numbers, _, places, own = zip(*tree.reach(q, np.ones(len(q), bool)))
        at = np.concatenate(places)
        yield pd.DataFrame({"tree": t, "shard": np.repeat(numbers, [len(p) for p in places]),
                            "fp": q[at].view(np.int64), "node": node[at], "home": np.concatenate(own)})


def near_fingerprints(fps, bits=4, per_shard=4096, max_shards=16384):
    """Links between distinct fingerprints ``(fp, node)`` at ``bits`` or fewer differing bits.

    Two such fingerprints agree on one of a few bands of bits, but for one bit in the first
    band.  Each band has a vantage-point tree that deals fingerprints to shards; it is grown
    on a sample of at most ``16 * max_shards`` values.  Every fingerprint goes to its own
    shard and, as a guest, to each shard within reach of its boundary.  Shards are searched
    exactly, by trees of their own.  Returns links ``(u, v)`` between nodes that join the
    same classes as all the links do.
    """
    spark = fps.sparkSession
    n = fps.count()
    shards = 1
    while shards * per_shard < n and shards < max_shards:
        shards *= 2
    picked = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE_PER_SHARD * shards)
    sample = picked.toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    leaf = max(2, len(sample) // shards)
    shared = spark.sparkContext.broadcast(
        [VantageTree(sample, leaf, m, r, bits) for m, r in bands(bits)])

    def route(batches):
        for pdf in batches:
            if len(pdf):
                yield from _routed(pdf, shared.value)

    def search(pdf):
        pdf = pdf.sort_values("home", ascending=False, kind="stable")
        homes = int(pdf["home"].sum())
        q = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        a, b = _links(q[:homes], q[homes:], bits)
        low = union_pairs(len(q), a, b)
        node = pdf["node"].to_numpy()
        moved = low != np.arange(len(q))
        return pd.DataFrame({"u": node[low[moved]], "v": node[moved]})

    # a walk through the trees costs the same for few and many values: a partition is one batch
    small_batches(spark, ROUTED)
    parts = max(spark.sparkContext.defaultParallelism, n // ROUTED)
    routed = fps.select("fp", "node").repartition(parts).mapInPandas(
        route, "tree int, shard int, fp long, node long, home boolean")
    return routed.groupBy("tree", "shard").applyInPandas(search, "u long, v long")


def simhash_classes(docs, bits=4, words=4, id_col="doc_id", text_col="text"):
    """Fingerprint and class of near copies of every document.

    One row per input row: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id
    reachable over links of at most ``bits`` differing bits; its own id if none).  A null text
    counts as empty, empty texts share fingerprint zero; repeated rows and ids stay as they
    are; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    marked = materialize(docs.select(F.col(id_col).alias("id"),
                                     _fingerprints(words)(F.col(text_col)).alias("fp")))
    fps = materialize(marked.groupBy("fp").agg(F.min("id").alias("node")))
    linked = components(near_fingerprints(fps, bits))
    classes = materialize(fps.join(linked, "node", "left").select(
        "fp", F.coalesce("component", "node").alias("component_id")))
    # the lowest node of a class is its lowest document, as nodes are lowest documents
    return marked.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id")
