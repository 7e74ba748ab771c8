"""Repeated byte strings across documents, by suffix arrays over Lyndon groups.

Texts are cut into chunks.  Every 50-byte window of a text is filed under its minimizer (the
lowest hash among its 26-byte grams), so equal windows meet under one key and neighbouring
windows travel as one short string.  Only minimizers that occur in two documents matter.
Strings under one key are suffix-sorted, and windows that stand next to each other with 50
equal bytes form a class; its lowest document is the first to hold the window.
"""

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F

from .common import BASE, BYTE_VALUES, INVERSE, _powers, gram_hashes, materialize_bucketed, mix, sliding_min, small_batches

CHUNK_BYTES = 2 << 20
GRAM = 26


def suffix_classes(strings, length, group):
    """Classes of equal windows of ``length`` bytes among strings of one group each.

    ``strings`` is a list of bytes (no byte 255), ``group`` their group numbers.  Returns
    (string number, offset, class number) of every window; equal windows of equal groups,
    and only those, share a class number.

    Suffixes are first put into the groups of their Lyndon prefixes.  Previous-smaller
    pointers, followed in all strings side by side, give for each suffix the next smaller
    one, where its Lyndon prefix ends.  Groups are ranked by their words; then one ascending
    pass emits every group in order: a suffix is placed when the suffix after its Lyndon
    prefix is, so no part is renamed or sorted again.
    """
    n, width = len(strings), max(map(len, strings)) + 1
    sizes = np.fromiter(map(len, strings), np.int64, n)
    grid = np.zeros((n, width + 16), np.uint8)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    grid[np.repeat(np.arange(n), sizes), _within(sizes)] = flat + 1
    # eight bytes from every place on, as one number
    key = np.zeros((n, width + 8), np.uint64)
    for b in range(8):
        key |= grid[:, b:b + width + 8].astype(np.uint64) << np.uint64(56 - 8 * b)
    after = _next_smaller(key, sizes, width)
    word = _word_ranks(key, after, sizes, width, group)
    order = _emit(word, after, sizes, width, n)
    row, col = order // width, order % width
    fits = col + length <= sizes[row]
    row, col = row[fits], col[fits]
    new = np.ones(len(row), bool)
    if len(row):
        same = group[row[1:]] == group[row[:-1]]
        for at in range(0, length, 8):
            step = key[row, col + at] if at + 8 <= length else key[row, col + length - 8]
            same &= step[1:] == step[:-1]
        new[1:] = ~same
    return row, col, np.cumsum(new) - 1


def _within(sizes):
    """0, 1, .. for each size in turn."""
    total = int(sizes.sum())
    return np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _next_smaller(key, sizes, width):
    """Place of the next smaller suffix of every place (its own end at the latest)."""
    n = len(key)
    before = np.full((n, width), -1, np.int16)
    after = np.zeros((n, width), np.int16)
    for i in range(1, width):
        at = np.flatnonzero(i <= sizes)
        p = np.full(len(at), i - 1)
        while len(at):
            less = _suffix_less(key, at, i, p)
            held = at[~less]
            before[held, i] = p[~less]
            at, p = at[less], p[less]
            after[at, p] = i
            p = before[at, p].astype(np.int64)
            at, p = at[p >= 0], p[p >= 0]
    return after


def _suffix_less(key, row, i, p):
    """Whether the suffix at i is smaller than the one at p (p before i), row by row."""
    left, right = key[row, i], key[row, p]
    less = left < right
    tie = np.flatnonzero((left == right) & (left & np.uint64(255) != 0))
    step = 8
    last = key.shape[1] - 1
    while len(tie):
        left, right = key[row[tie], np.minimum(i + step, last)], key[row[tie], np.minimum(p[tie] + step, last)]
        less[tie] = left < right
        tie = tie[(left == right) & (left & np.uint64(255) != 0)]
        step += 8
    return less


def _word_ranks(key, after, sizes, width, group):
    """Rank of each place's Lyndon prefix, grouped by the strings' group first."""
    n = len(key)
    place = np.arange(width)
    row, col = np.nonzero(place[None, :] < sizes[:, None])
    size = after[row, col].astype(np.int64) - col
    rank = group[row].astype(np.int64)
    todo, at = np.arange(len(row)), 0
    while len(todo):
        left = np.clip(size[todo] - at, 0, 8).astype(np.uint64)
        part = key[row[todo], np.minimum(col[todo] + at, key.shape[1] - 1)]
        shift = np.minimum(np.uint64(64) - np.uint64(8) * left, np.uint64(63))
        part = np.where(left == 0, np.uint64(0), (part >> shift) << shift)
        order = np.lexsort((part, rank[todo]))
        r, q = rank[todo][order], part[order]
        older = np.concatenate(([True], r[1:] != r[:-1]))
        new = older | np.concatenate(([True], q[1:] != q[:-1]))
        # a rank is the first place a class takes, so finer ranks fit inside it
        starts = np.flatnonzero(new)
        base = np.flatnonzero(older)
        offset = starts - (base[np.searchsorted(base, starts, "right") - 1] if at else 0)
        cls = np.cumsum(new) - 1
        rank[todo[order]] = (r if at else 0) + offset[cls]
        at += 8
        # go on in classes that hold a longer word; words that ended come first there
        open_ = np.zeros(len(row) + 1, bool)
        open_[rank[size > at]] = True
        todo = np.flatnonzero(open_[rank])
    out = np.full((n, width), -1, np.int64)
    out[row, col] = rank
    return out


def _emit(word, after, sizes, width, n):
    """All places in suffix order (string ends, the smallest, left out).

    Each place waits for the place where its Lyndon prefix ends; ends of strings come first.
    """
    row, col = np.nonzero(word >= 0)
    place = row * width + col
    follows = row * width + after[row, col]
    rank = word[row, col]
    by_rank = np.sort(rank)
    first = np.concatenate(([True], by_rank[1:] != by_rank[:-1]))
    group_of = np.searchsorted(by_rank[first], rank)
    free = np.flatnonzero(first).tolist()
    waiting = np.argsort(follows, kind="stable")
    sorted_follows = follows[waiting]
    ends = np.arange(n) * width + sizes
    # slices of ``waiting`` for each place: those it releases
    count = np.zeros(n * width + 1, np.int64)
    np.add.at(count, sorted_follows + 1, 1)
    begin = np.cumsum(count)
    starts = begin.tolist()
    mine, where = group_of[waiting].tolist(), place[waiting].tolist()
    order = [0] * len(place)
    for e in ends.tolist():
        for k in range(starts[e], starts[e + 1] if e + 1 < len(starts) else len(where)):
            g = mine[k]
            order[free[g]] = where[k]
            free[g] += 1
    for i in range(len(order)):
        s = order[i]
        for k in range(starts[s], starts[s + 1]):
            g = mine[k]
            order[free[g]] = where[k]
            free[g] += 1
    return np.array(order, np.int64)


class _Chunk:
    """Windows of the documents of one chunk, in runs that share a minimizer."""

    def __init__(self, ids, sizes, raw, length):
        self.ids, self.sizes, self.length = ids, sizes, length
        # one byte that no text holds parts the documents
        gaps = np.cumsum(sizes + 1) - 1
        self.raw = np.full(int((sizes + 1).sum()), 255, np.uint8)
        inside = np.ones(len(self.raw), bool)
        inside[gaps] = False
        self.raw[inside] = np.frombuffer(raw, np.uint8)
        self.begin = gaps - sizes
        w = length - GRAM + 1
        h = gram_hashes(BYTE_VALUES[self.raw], GRAM)
        if len(h) < w:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        low = sliding_min(h, w)
        place = np.arange(len(low))
        doc = np.searchsorted(self.begin, place, "right") - 1
        ok = place + length <= self.begin[doc] + sizes[doc]
        new = np.concatenate(([True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])))
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(low))
        # the windows of a document are its first ones: cut each run at the last
        end = np.minimum(end, self.begin[doc[start]] + sizes[doc[start]] - length + 1)
        keep = ok[start] & (end > start)
        start, end = start[keep], end[keep]
        # long runs (repeats inside a text) go in pieces
        pieces = -(-(end - start) // w)
        index = np.repeat(np.arange(len(start)), pieces)
        s = start[index] + w * _within(pieces)
        self.start, self.end = s, np.minimum(s + w, end[index])
        self.doc, self.key = doc[s], low[s]

    def contents(self, which):
        """64-bit hash of the bytes that the windows of each run cover."""
        if not hasattr(self, "_sums"):
            self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(
                BYTE_VALUES[self.raw] * _powers(len(self.raw), BASE))))
        a, b = self.start[which], self.end[which] + self.length - 1
        h = (self._sums[b] - self._sums[a]) * _powers(len(self.raw), INVERSE)[a]
        return mix(h + (b - a).astype(np.uint64) * BASE)


def pack_chunks(base, chunk_bytes=CHUNK_BYTES):
    """Documents ``(id, text)`` as rows of about ``chunk_bytes`` of compressed text each.

    To be written before use: a chunk's number and content come from the task that packs it.
    """
    def pack(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0

        def row():
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            return pd.DataFrame({"chunk": [(part << 32) | number], "ids": [np.array(ids, "<i8").tobytes()],
                                 "sizes": [sizes.astype("<i8").tobytes()], "bytes": [int(sizes.sum())],
                                 "texts": [zstandard.compress(b"".join(texts), 3)]})

        for pdf in batches:
            for i, t in zip(pdf["id"], pdf["text"]):
                ids.append(i)
                texts.append((t or "").encode("utf-8", "replace"))
                held += len(texts[-1])
                if held >= chunk_bytes:
                    yield row()
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield row()

    return base.select("id", "text").mapInPandas(
        pack, "chunk long, ids binary, sizes binary, bytes long, texts binary")


def _unpack(row, length):
    ids = np.frombuffer(row.ids, "<i8")
    sizes = np.frombuffer(row.sizes, "<i8")
    return _Chunk(ids, sizes, zstandard.decompress(row.texts), length)


def _split(key, buckets):
    """(bucket, 32-bit rest) of a 64-bit hash."""
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), key.astype(np.uint32)


def _pack_rows(bucket, order, *columns):
    """Slices of the columns per bucket as (bucket, [bytes])."""
    b = bucket[order]
    cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else []
    for a, z in zip(cut, [*cut[1:], len(b)]):
        yield int(b[a]), [c[order[a:z]] for c in columns]


def repeated_bytes(docs, length=50, chunk_bytes=CHUNK_BYTES, hot_chunks=4096, id_col="doc_id",
                   text_col="text"):
    """Bytes of every document inside a ``length``-byte string of an earlier document.

    One row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``kept_sha256`` and ``kept`` (the other bytes joined).  Texts are UTF-8 bytes; a null text
    is empty; matches never cross documents; "earlier" is a smaller id, so rows that repeat an
    id keep what they share, and rows without an id keep everything and take nothing from
    others.  Other columns are ignored; an empty table gives an empty result.

    Scale: a chunk files one entry per minimizer and one per distinct string, whatever number
    of its documents hold it.  Keys in more than ``hot_chunks`` chunks are split by window.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    known = base.where("id IS NOT NULL")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(max(16, total >> 23), 16384))
    # a few chunks a bucket, and no fewer buckets than other shuffles have, so that the texts
    # stay where they are in both joins
    dealt = max(total // (4 * chunk_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = materialize_bucketed(pack_chunks(known, chunk_bytes), "chunk", int(min(dealt, 65536)))
    small_batches(spark, 1)

    def keys(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                c = _unpack(row, length)
                order = np.lexsort((c.doc, c.key))
                k, d = c.key[order], c.doc[order]
                first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
                many = np.maximum.reduceat(d, first) != d[first] if len(k) else np.zeros(0, bool)
                bucket, rest = _split(k[first], buckets)
                rows = [(b, r.astype("<u4").tobytes(), m.tobytes())
                        for b, (r, m) in _pack_rows(bucket, np.argsort(bucket, kind="stable"), rest, many)]
                yield pd.DataFrame({"bucket": [r[0] for r in rows], "chunk": row.chunk,
                                    "rest": [r[1] for r in rows], "many": [r[2] for r in rows]})

    def shared_keys(pdf):
        parts = [np.frombuffer(r, "<u4") for r in pdf["rest"]]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        rest, many = np.concatenate(parts), np.concatenate([np.frombuffer(m, bool) for m in pdf["many"]])
        order = np.argsort(rest, kind="stable")
        r = rest[order]
        first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        n = np.diff(np.append(first, len(r)))
        good = (n > 1) | np.logical_or.reduceat(many[order], first)
        good_row = np.zeros(len(rest), bool)
        good_row[order] = np.repeat(good, n)
        hot_row = np.zeros(len(rest), bool)
        hot_row[order] = np.repeat(n > hot_chunks, n)
        out = []
        for i, a in enumerate(np.cumsum(sizes) - sizes):
            own = slice(a, a + sizes[i])
            take = good_row[own]
            if take.any():
                out.append((pdf["chunk"].iloc[i], pdf["bucket"].iloc[0], rest[own][take].tobytes(),
                            hot_row[own][take].tobytes()))
        return pd.DataFrame(out, columns=["chunk", "bucket", "rest", "hot"])

    shared = (chunks.select("chunk", "ids", "sizes", "texts").mapInPandas(
        keys, "bucket int, chunk long, rest binary, many binary").groupBy("bucket").applyInPandas(
        shared_keys, "chunk long, bucket int, rest binary, hot binary"))
    per_chunk = shared.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "rest", "hot")).alias("shared"))

    def strings(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                yield _chunk_strings(row.chunk, _unpack(row, length), row.shared, buckets, length)

    def classes(pdf):
        return _bucket_classes(pdf, length)

    texts = chunks.select("chunk", "ids", "sizes", "texts")
    found = (texts.join(per_chunk, "chunk").mapInPandas(
        strings, "bucket int, chunk long, n int, packed binary").groupBy("bucket").applyInPandas(
        classes, "chunk long, content binary, at binary, n binary, low binary, single binary"))
    hits = found.groupBy("chunk").agg(F.collect_list(F.struct("content", "at", "n", "low", "single")).alias("hits"))

    def cut(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                yield from _cut_chunk(_unpack(row, length), row.hits, length)

    out = texts.join(hits, "chunk", "left").mapInPandas(
        cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    whole = base.where("id IS NULL").select(
        "id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), text.alias("kept"))
    return out.union(whole).withColumnRenamed("id", id_col)


#: what a packed string has, one array after the other, and then its bytes
_FIELDS = [("key", "<u4"), ("content", "<u8"), ("first", "<i8"), ("last", "<i8"), ("sizes", "<u2"),
           ("single", "?")]


def _chunk_strings(chunk, c, shared, buckets, length):
    """Distinct strings of a chunk under shared keys, packed per bucket."""
    bucket, rest = _split(c.key, buckets)
    take = np.zeros(len(c.key), bool)
    hot = np.zeros(len(c.key), bool)
    code = bucket.astype(np.uint64) << np.uint64(32) | rest.astype(np.uint64)
    for entry in shared:
        known = np.frombuffer(entry["rest"], "<u4").astype(np.uint64) | (
            np.uint64(entry["bucket"]) << np.uint64(32))
        take |= np.isin(code, known)
        warm = known[np.frombuffer(entry["hot"], bool)]
        if len(warm):
            hot |= np.isin(code, warm)
    which = np.flatnonzero(take & ~hot)
    start, end, doc, key = c.start[which], c.end[which], c.doc[which], c.key[which]
    spread = np.flatnonzero(take & hot)
    if len(spread):
        # windows of a hot key go one by one, each filed under its own bytes
        n = c.end[spread] - c.start[spread]
        s = np.repeat(c.start[spread], n) + _within(n)
        start, end = np.concatenate((start, s)), np.concatenate((end, s + 1))
        doc = np.concatenate((doc, np.repeat(c.doc[spread], n)))
        key = np.concatenate((key, np.zeros(len(s), np.uint64)))
    c.start, c.end = start, end
    content = c.contents(slice(None))
    key[len(which):] = content[len(which):]
    single = np.arange(len(key)) >= len(which)
    bucket, _ = _split(key, buckets)
    order = np.lexsort((doc, content))
    x = content[order]
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    ids = c.ids[doc[order]]
    low = np.minimum.reduceat(ids, first) if len(x) else ids
    high = np.maximum.reduceat(ids, first) if len(x) else ids
    at = order[first]
    raw = c.raw.tobytes()
    rows = []
    # within a bucket half of a key tells keys apart; a clash only puts two keys side by side
    columns = (key[at], content[at], low, high, end[at] + length - 1 - start[at], single[at], start[at])
    for b, (*fields, s) in _pack_rows(bucket[at], np.argsort(bucket[at], kind="stable"), *columns):
        arrays = [x.astype(kind).tobytes() for x, (_, kind) in zip(fields, _FIELDS)]
        texts = [raw[p:p + q] for p, q in zip(s.tolist(), fields[4].tolist())]
        rows.append((b, chunk, len(s), zstandard.compress(b"".join(arrays + texts), 3)))
    return pd.DataFrame(rows, columns=["bucket", "chunk", "n", "packed"])


def _bucket_classes(pdf, length):
    """For every string of a bucket, the lowest document of each of its windows, in runs."""
    found, texts = {name: [] for name, _ in _FIELDS}, []
    for n, packed in zip(pdf["n"], pdf["packed"]):
        data, at = zstandard.decompress(packed), 0
        for name, kind in _FIELDS:
            found[name].append(np.frombuffer(data, kind, n, at))
            at += found[name][-1].nbytes
        texts.append(data[at:])
    key, content, first, last, sizes, single = (np.concatenate(found[name]) for name, _ in _FIELDS)
    key, sizes = key.astype(np.uint64), sizes.astype(np.int64)
    chunk = np.repeat(pdf["chunk"].to_numpy(), pdf["n"].to_numpy())
    raw = b"".join(texts)
    ends = np.cumsum(sizes)
    # equal strings of several chunks once, with their lowest document
    order = np.lexsort((first, content, key))
    k, x = key[order], content[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (x[1:] != x[:-1])))
    lead = order[new]
    one = np.empty(len(key), np.int64)
    one[order] = np.cumsum(new) - 1
    windows = sizes[lead] - length + 1
    place = np.cumsum(windows) - windows
    low = np.repeat(first[lead], windows)
    same_key = np.unique(key[lead], return_inverse=True)[1]
    crowd = np.bincount(same_key)[same_key] > 1
    for part in _rounds(np.flatnonzero(crowd), same_key, raw, ends - sizes, sizes, lead, length):
        texts = [raw[ends[i] - sizes[i]:ends[i]] for i in lead[part]]
        row, col, cls = suffix_classes(texts, length, same_key[part])
        begin = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
        lowest = np.minimum.reduceat(first[lead[part]][row], begin)[cls]
        low[place[part[row]] + col] = lowest
    # runs of windows with one lowest document, where that is before the string's last
    begin = np.ones(len(low), bool)
    begin[1:] = low[1:] != low[:-1]
    begin[place] = True
    run = np.flatnonzero(begin)
    run_size = np.diff(np.append(run, len(low)))
    run_string = np.searchsorted(place, run, "right") - 1
    runs_of = np.bincount(run_string, minlength=len(lead))
    first_run = np.cumsum(runs_of) - runs_of
    mine = np.repeat(np.arange(len(key)), runs_of[one])
    which = first_run[one[mine]] + _within(runs_of[one])
    keep = low[run[which]] < last[mine]
    mine, which = mine[keep], which[keep]
    out = []
    for c, (i, w) in _pack_rows(chunk[mine], np.argsort(chunk[mine], kind="stable"), mine, which):
        out.append((c, content[i].tobytes(), (run[w] - place[run_string[w]]).astype("<u2").tobytes(),
                    run_size[w].astype("<u2").tobytes(), low[run[w]].astype("<i8").tobytes(),
                    single[i].tobytes()))
    return pd.DataFrame(out, columns=["chunk", "content", "at", "n", "low", "single"])


def _rounds(which, same_key, raw, begins, sizes, lead, length, batch=6000):
    """Strings that can share a window with another of their key, whole keys together.

    A string none of whose windows has an equal hash elsewhere under the key needs no sorting.
    """
    if not len(which):
        return
    which = which[np.argsort(same_key[which], kind="stable")]
    keep = np.zeros(len(which), bool)
    for a in range(0, len(which), 4 * batch):
        # whole keys: move the border to the next key
        lo = a if a == 0 else int(np.searchsorted(same_key[which], same_key[which[a]], "left"))
        hi = min(a + 4 * batch, len(which))
        hi = len(which) if hi == len(which) else int(np.searchsorted(same_key[which], same_key[which[hi]], "right"))
        part = which[lo:hi]
        z = sizes[lead[part]]
        flat = np.frombuffer(b"".join([raw[begins[i]:begins[i] + sizes[i]] for i in lead[part]]), np.uint8)
        h = gram_hashes(BYTE_VALUES[flat], length)
        start = np.cumsum(z) - z
        n = z - length + 1
        at = np.repeat(start, n) + _within(n)
        owner = np.repeat(np.arange(len(part)), n)
        g = mix(h[at] ^ (same_key[part][owner].astype(np.uint64) * BASE))
        order = np.lexsort((owner, g))
        gs, os = g[order], owner[order]
        tie = (gs[1:] == gs[:-1]) & (os[1:] != os[:-1])
        keep[lo + os[1:][tie]] = True
        keep[lo + os[:-1][tie]] = True
    which = which[keep]
    key = same_key[which]
    a = 0
    while a < len(which):
        b = min(a + batch, len(which))
        b = len(which) if b == len(which) else int(np.searchsorted(key, key[b], "right"))
        yield which[a:b]
        a = b


def _cut_chunk(c, hits, length):
    """Rows of the documents of a chunk."""
    cover = np.zeros(len(c.raw) + 1, np.int64)
    if hits is not None and len(hits):
        take = lambda name, kind: np.concatenate([np.frombuffer(h[name], kind) for h in hits])
        single = take("single", bool)
        for windows in (False, True):  # runs as filed; windows one by one under hot keys
            part = np.flatnonzero(single == windows)
            if not len(part):
                continue
            content, at, n, low = (take(c_, k)[part] for c_, k in (
                ("content", "<u8"), ("at", "<u2"), ("n", "<u2"), ("low", "<i8")))
            if windows:
                z = c.end - c.start
                c.doc = np.repeat(c.doc, z)
                c.start = np.repeat(c.start, z) + _within(z)
                c.end = c.start + 1
            own = c.contents(slice(None))
            order = np.argsort(own, kind="stable")
            lo, hi = np.searchsorted(own[order], content, "left"), np.searchsorted(own[order], content, "right")
            hit = np.repeat(np.arange(len(content)), hi - lo)
            run = order[np.repeat(lo, hi - lo) + _within(hi - lo)]
            ok = low[hit] < c.ids[c.doc[run]]
            hit, run = hit[ok], run[ok]
            a = c.start[run] + at[hit]
            np.add.at(cover, a, 1)
            np.add.at(cover, a + n[hit] + length - 1, -1)
    gone = np.cumsum(cover)[:-1] > 0
    rows = []
    for i, (b, z) in enumerate(zip(c.begin, c.sizes)):
        mark = gone[b:b + z]
        own = c.raw[b:b + z]
        kept = own[~mark].tobytes() if mark.any() else own.tobytes()
        spans = int(mark[:1].sum() + (mark[1:] & ~mark[:-1]).sum())
        rows.append((c.ids[i], int(z), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        if len(rows) == 1000:
            yield pd.DataFrame(rows, columns=_OUT)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=_OUT)


_OUT = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
