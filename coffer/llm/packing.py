"""Packing token pieces into sequences: exact complements of gaps first, best fit for the rest.

A packing depends on the lengths alone, and there are at most ``capacity`` of them.  Spark
counts the pieces of each length; the plan is made from those counts (one number per length,
whatever the corpus) as *patterns*, each a multiset of lengths with a number of copies.  Every
piece gets a running number among the pieces of its length, from per-task counters and a prefix
sum over tasks, and the number says which copy of which pattern takes it.
"""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import importable, materialize
from .ranked import in_groups, word_coder

CAPACITY = 2048
_RANK_BITS = 44


class _Complements:
    """One, two or three available lengths that make up a gap.

    The index of sums is filled as it is asked for: a known pair of a sum is checked against
    what is left, a sum found to have none is never asked again, since counts only fall.
    """

    def __init__(self, left):
        self.left = left
        self.pairs = {}
        self.may = np.ones(len(left), bool)  # sums that a pair may still make
        self.may[:2] = False

    def _fits(self, lengths):
        return all(self.left[x] >= lengths.count(x) for x in lengths)

    def single(self, gap):
        return (gap,) if self.left[gap] > 0 else None

    def pair(self, gap):
        known = self.pairs.get(gap)
        if known and self._fits(known):
            return known
        if not self.may[gap]:
            return None
        high = np.arange(gap - 1, (gap - 1) // 2, -1)
        both = np.minimum(self.left[high], self.left[gap - high])
        if gap % 2 == 0:
            both[-1] = self.left[gap // 2] // 2
        at = int(np.argmax(both > 0))
        if both[at] <= 0:
            return None
        self.pairs[gap] = found = (int(high[at]), int(gap - high[at]))
        return found

    def triple(self, gap):
        first = np.arange(gap - 2, 0, -1)
        for a in first[(self.left[first] > 0) & self.may[gap - first]]:
            self.left[a] -= 1
            rest = self.pair(gap - int(a))
            self.left[a] += 1
            if rest:
                return (int(a), *rest)
        return None

    def forget(self, gap):
        """Note sums up to a gap that no pair makes any more."""
        have = np.flatnonzero(self.left[:gap + 1] > 0)
        made = np.zeros(len(self.left) * 2, bool)
        for x in have:
            made[have + x] = True
        self.may &= made[:len(self.may)]

    def exact(self, gap):
        return self.single(gap) or self.pair(gap) or self.triple(gap)


def _pattern(longest, capacity, index):
    """Lengths that fill a sequence exactly, begun with ``longest``; None if none are found.

    While no complement of up to three lengths fits the gap, the longest length that fits goes
    in, and the smaller gap is asked for.
    """
    left, used, gap = index.left, [longest], capacity - longest
    left[longest] -= 1
    try:
        while gap:
            found = index.exact(gap)
            if not found:
                below = np.flatnonzero(left[1:gap + 1] > 0)
                if not len(below):
                    return None
                found = (int(below[-1]) + 1,)
            for x in found:
                left[x] -= 1
            used += found
            gap -= sum(found)
        return used
    finally:
        np.add.at(left, used, 1)


def plan_packing(counts, capacity=CAPACITY):
    """Patterns ``(copies, ((length, times), ...))`` that take every piece of a histogram.

    ``counts`` maps a length (1 to ``capacity``) to its number of pieces.  From the longest
    length down, patterns that fill a sequence exactly are used as often as the counts allow;
    lengths without one are packed by best fit, longest first.  Each use exhausts a length or
    takes it below its number of times, which bounds the patterns by the capacity, not by the
    pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"no piece of length {length} fits in {capacity}")
        left[length] += n
    rest, plan, index = np.zeros_like(left), [], _Complements(left)
    for longest in range(capacity, 0, -1):
        if longest % 64 == 0:
            index.forget(capacity - 1)
        while left[longest] > 0:
            used = _pattern(longest, capacity, index)
            if used is None:
                rest[longest], left[longest] = left[longest], 0
                break
            lengths, times = np.unique(used, return_counts=True)
            copies = int((left[lengths] // times).min())
            left[lengths] -= copies * times
            plan.append((copies, tuple(zip(lengths.tolist()[::-1], times.tolist()[::-1]))))
    return plan + _best_fit(rest, capacity)


def _best_fit(counts, capacity):
    """Best fit by decreasing length over a histogram; equal sequences move together."""
    open_, has = {}, np.zeros(capacity + 1, bool)  # gap -> [[copies, pattern], ...]

    def put(gap, copies, pattern):
        if copies:
            open_.setdefault(gap, []).append((copies, pattern))
            has[gap] = True

    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            at = int(np.argmax(has[length:]))
            gap = length + at if has[length + at] else None
            times = (capacity if gap is None else gap) // length
            if gap is None:
                group, pattern = max(1, n // times), ()
                gap = capacity
            else:
                group, pattern = open_[gap].pop()
                has[gap] = bool(open_[gap])
            full = min(group, n // times)
            put(gap - times * length, full, (*pattern, (length, times)))
            n -= full * times
            if full < group:
                some = min(n, times - 1)
                if some:
                    put(gap - some * length, 1, (*pattern, (length, some)))
                    n -= some
                if pattern:
                    put(gap, group - full - bool(some), pattern)
    return [group for groups in open_.values() for group in groups]


class Places:
    """The plan as a lookup from (length, number among its length) to sequence and offset."""

    def __init__(self, plan):
        taken, rows, sequence = {}, [], 0
        for copies, pattern in plan:
            offset = 0
            for length, times in pattern:
                first = taken.get(length, 0)
                rows.append((length, first, sequence, times, offset))
                taken[length] = first + copies * times
                offset += length * times
            sequence += copies
        rows.sort()
        self.sequences = sequence
        self.length, self.first, self.sequence, self.times, self.offset = (
            np.array(rows, np.int64).reshape(-1, 5).T.copy())
        self.key = (self.length << _RANK_BITS) + self.first

    def find(self, length, number):
        at = np.searchsorted(self.key, (length << _RANK_BITS) + number, "right") - 1
        copy, place = np.divmod(number - self.first[at], self.times[at])
        return self.sequence[at] + copy, self.offset[at] + place * length


def token_pieces(docs, path, capacity=CAPACITY, end_id=0, id_col="doc_id", text_col="text"):
    """Whole texts as token ids with ``end_id``, cut only where longer than ``capacity``.

    One written row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``token_ids`` (little-endian 32-bit), and ``part`` and ``nth``: the task that made it and
    the pieces of its length made there before.  Null and empty texts are the end id alone;
    repeated rows and rows without an id stay; an empty table gives no piece.
    """
    importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def cut(batches):
        known, part = word_coder(path), TaskContext.get().partitionId()
        end, seen, width = np.array([end_id], "<u4").tobytes(), [0] * (capacity + 1), 4 * capacity
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, last in in_groups(texts):
                source, piece, start, length, crc, nth, ids = [], [], [], [], [], [], []
                for i, coded in enumerate(known.encode(texts[first:last]), first):
                    whole = coded + end
                    for number, at in enumerate(range(0, len(whole), width)):
                        own = whole[at:at + width]
                        n = len(own) >> 2
                        source.append(i)
                        piece.append(number)
                        start.append(at >> 2)
                        length.append(n)
                        crc.append(zlib.crc32(own))
                        nth.append(seen[n])
                        ids.append(own)
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()),
                     *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array(ids, pa.binary()),
                     pa.array([part] * len(source), pa.int32()), pa.array(nth, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32", "token_ids", "part", "nth"])

    pieces = materialize(rows.mapInArrow(
        cut, f"id {id_type}, piece int, start long, length long, ids_crc32 long, token_ids binary, "
             "part int, nth long"))
    return pieces.withColumnRenamed("id", id_col)


def place_pieces(pieces, capacity=CAPACITY):
    """``sequence_id`` and ``offset`` for written pieces with ``length``, ``part`` and ``nth``.

    Only the counts per length come to the driver, at most ``capacity`` numbers, and only the
    plan goes out, which the capacity bounds as well.
    """
    runs = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in runs.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(plan_packing(counts, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = places.find(length.to_numpy(np.int64), number.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    before = runs.select("part", "length", (
        F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    found = pieces.join(before, ["part", "length"]).withColumn(
        "place", find("length", F.col("before") + F.col("nth")))
    return found.select("*", "place.sequence_id", "place.offset").drop("place", "before", "part", "nth")


def pack_documents(docs, path, capacity=CAPACITY, end_id=0, id_col="doc_id", text_col="text"):
    """Pieces of all documents with their place: id, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``token_ids``, ``sequence_id``, ``offset``."""
    return place_pieces(token_pieces(docs, path, capacity, end_id, id_col, text_col), capacity)


def packed_sequences(placed):
    """Whole sequences ``(sequence_id, n_tokens, token_ids)``; a row gathers what fits in one."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "token_ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "sequence_id", "n_tokens",
        F.aggregate("parts", F.lit(b""), lambda whole, x: F.concat(whole, x["token_ids"])).alias("token_ids"))
