"""Near-duplicate passages by compact windows.

For a hash function over word shingles, every subsequence of a text whose minimum is a given
shingle lies in one compact window, a node of the Cartesian tree over the hashes.  Only nodes
at least as wide as the shortest passage count.  Two texts that share a passage meet in a
window with the same minimum under most hash functions; where windows of enough functions
agree, the runs of equal shingles of both texts are chained.  Under a minimum that many texts
have, the windows of the first function are told apart by all their runs of the least length,
so that a text meets the first one with the same run, whoever else has the minimum.
"""

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import functions as F

from .common import Words, gram_hashes, materialize, mix, sliding_min, small_batches, window_minima
from .suffixes import _split, _within, pack_chunks

SHINGLE = 5
MIN_WORDS = 50
HASHES = 6
CONTEXT = 20
AGREE = 2
#: number of links by an equal run, which need no second function to agree
SURE = 127


def _plain_bytes():
    """Words are what stands between ASCII white space, A-Z in lower case."""
    t = np.arange(256)
    t[65:91] += 32
    t[[0, 9, 10, 11, 12, 13, 32]] = 0
    return t.astype(np.uint8)


PLAIN_BYTES = _plain_bytes()


def shingle_values(texts, words=SHINGLE):
    """(word bounds, shingle hash at each word); 0 where a text has no further shingle."""
    w = Words(texts, PLAIN_BYTES)
    h = w.hashes()
    s = np.zeros(len(h), np.uint64)
    g = gram_hashes(h, words)
    s[:len(g)] = g | np.uint64(1)
    for back in range(1, words):
        at = w.first[1:] - back
        s[at[at >= w.first[:-1]]] = 0
    return w, s


def compact_windows(values, width):
    """Cartesian-tree nodes at least ``width`` wide: arrays (left, place of minimum, right).

    ``values`` are hashes; 0 is a wall.  A node's ancestors are as wide as itself, so only
    minima of some run of ``width`` values can be nodes, and the tree is built over these.
    Equal minima of one range are one node, at the first of them.
    """
    if len(values) < width:
        return (np.zeros(0, np.int64),) * 3
    v = np.concatenate((np.zeros(1, np.uint64), values, np.zeros(1, np.uint64)))
    place = np.union1d(window_minima(v, width), [0, len(v) - 1])
    walls = v[place] == 0
    # of neighbouring walls only the outer ones bound anything
    inner = walls[1:-1] & walls[:-2] & walls[2:]
    place = place[np.concatenate(([True], ~inner, [True]))]
    out, stack = [], []
    for at, value in zip(place.tolist(), v[place].tolist()):
        while stack and stack[-1][0] > value:
            _, low, left, _ = stack.pop()
            if at - left >= width:
                out.append((left, low, at - 1))
        if stack and stack[-1][0] == value:
            stack[-1][3] = at
        else:
            stack.append([value, at, stack[-1][3] + 1 if stack else 0, at])
    if not out:
        return (np.zeros(0, np.int64),) * 3
    left, low, right = np.array(out, np.int64).T
    return left - 1, low - 1, right - 1


def _links(value, number, doc, place, context):
    """Each window beside the one of the lowest document with the same minimum, and beside the
    lowest that also agrees with it before, or after, the minimum.

    ``place`` has the columns low, left, right (words of the text); ``context`` the shingles
    ``CONTEXT`` words before and after the minimum, one of which lies in any passage around it.
    Returns (rows, leaders, lead): windows of other documents, the window each goes with, and
    the windows that stand for their equals elsewhere.
    """
    none = np.zeros(0, np.int64)
    if not len(value):
        return none, none, none
    pairs, leads = [], []
    for side in ((), (context[:, 0],), (context[:, 1],)):
        order = np.lexsort((place[:, 0], doc, *side, number, value))
        new = np.zeros(len(order), bool)
        new[0] = True
        for c in (value, number, *side):
            new[1:] |= c[order][1:] != c[order][:-1]
        lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        other = doc[order] != doc[lead]
        pairs.append(order[other] * len(value) + lead[other])
        leads.append(order[new])
    pairs = np.unique(np.concatenate(pairs))
    return pairs // len(value), pairs % len(value), np.unique(np.concatenate(leads))


_LINK = np.dtype([("doc", "<i8"), ("other", "<i8"), ("j", "<i4"), ("low", "<i4"), ("left", "<i4"),
                  ("right", "<i4"), ("olow", "<i4"), ("oleft", "<i4"), ("oright", "<i4")])


_WINDOW = np.dtype([("doc", "<i8"), ("number", "<i1"), ("low", "<i4"), ("left", "<i4"), ("right", "<i4")])

_SEGMENT = np.dtype([("doc", "<i8"), ("at", "<i4"), ("n", "<i4")])


def _thin(*tables):
    """Records as one compressed string: steps between their documents, like bytes side by side."""
    out = []
    for rows in tables:
        rows = rows.copy()
        rows["doc"][1:] = np.diff(rows["doc"])
        out.append(rows.view(np.uint8).reshape(len(rows), rows.dtype.itemsize).T.tobytes())
    return zstandard.compress(b"".join(out), 3)


def _thick(packed, *counts):
    """The tables of :func:`_thin`, by their kinds and lengths; the last one, of links, takes the rest."""
    raw, at, out = np.frombuffer(zstandard.decompress(packed), np.uint8), 0, []
    for kind, n in (*counts, (_LINK, None)):
        n = (len(raw) - at) // kind.itemsize if n is None else n
        rows = raw[at:at + n * kind.itemsize].reshape(kind.itemsize, n).T.copy().view(kind).ravel()
        rows["doc"] = np.cumsum(rows["doc"])
        out.append(rows)
        at += n * kind.itemsize
    return out


def _runs_of_windows(values, shingles, width):
    """(start, minimum, hash) of every run of ``width`` shingles; ``values`` are 0 at walls."""
    if len(values) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    low = sliding_min(values, width)
    at = np.flatnonzero(low)
    return at, low[at], gram_hashes(shingles, width)[at]


def _equal_runs(key, doc, at):
    """Each run beside the first one of the lowest document that has it.

    Returns (rows, leaders, lead): runs of other documents, the run each goes with, and a mask
    of the runs that stand for their equals elsewhere: all in that document.
    """
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    part = np.union1d(order[1:][same], order[:-1][same])
    part = part[np.lexsort((at[part], doc[part], key[part]))]
    lead = np.ones(len(key), bool)
    if not len(part):
        return part, part, lead
    new = np.concatenate(([True], key[part][1:] != key[part][:-1]))
    leaders = part[new][np.cumsum(new) - 1]
    other = doc[part] != doc[leaders]
    lead[part[other]] = False
    return part[other], leaders[other], lead


def _pack_runs(doc, at, rows, leaders, width):
    """Links of equal runs; runs that follow each other on both sides are one link."""
    a, b = at[rows], at[leaders]
    order = np.lexsort((a, b - a, doc[leaders], doc[rows]))
    d, o, a, b = doc[rows][order], doc[leaders][order], a[order], b[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (o[1:] != o[:-1]) | (np.diff(b - a) != 0)
                          | (np.diff(a) > 1)))[:len(a)]
    cut = np.flatnonzero(new)
    last = np.concatenate((cut[1:], [len(a)]))[:len(cut)] - 1
    out = np.zeros(len(cut), _LINK)
    out["doc"], out["other"], out["j"] = d[cut], o[cut], SURE
    out["low"], out["left"], out["right"] = a[cut], a[cut], a[last] + width - 1
    out["olow"], out["oleft"], out["oright"] = b[cut], b[cut], b[last] + width - 1
    return out


def _dealt(bucket, *columns):
    """A function from a bucket to its slices of the columns, in their order."""
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]

    def part(b):
        i, j = np.searchsorted(bucket, (b, b + 1))
        return [c[i:j] for c in columns]

    return part


def _pack_links(number, doc, place, rows, leaders):
    out = np.zeros(len(rows), _LINK)
    out["doc"], out["other"], out["j"] = doc[rows], doc[leaders], number[rows]
    for i, c in enumerate(("low", "left", "right")):
        out[c], out["o" + c] = place[rows, i], place[leaders, i]
    return out


def near_passages(docs, similarity=0.8, min_words=MIN_WORDS, hashes=HASHES, id_col="doc_id", text_col="text"):
    """Passages that a document shares, exactly or nearly, with an earlier one.

    One row per passage: id, ``other_id`` (a document of smaller id that has it),
    ``first_word``, ``n_words``, ``other_first_word``, ``similarity``.  A passage has at least
    ``min_words`` words and a similarity (shared among all shingles of five words, in the
    same order on both sides, whatever words were put in or left out between) of
    ``similarity`` or more.  Documents with nothing in common with an earlier one have no row.  A passage in many documents gives links
    towards the lowest ones with its windows, never all pairs; but every word of each run of ``min_words`` words
    that an earlier document has, word for word, lies in a passage shared with such a document.
    Null and empty texts
    and rows without an id have no passage; rows that repeat an id do not match each other;
    other columns are ignored; an empty table gives an empty result.

    A chunk passes on one window per minimum, and each run of words from one document,
    whatever number of its documents share them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    chunks = materialize(pack_chunks(base))
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    buckets = int(min(max(16, total >> 24), 16384))
    small_batches(spark, 1)
    width = min_words - SHINGLE + 1
    seeds = mix(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def windows(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                ids, sizes = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.sizes, "<i8")
                raw = zstandard.decompress(row.texts)
                ends = np.cumsum(sizes)
                w, s = shingle_values([raw[e - z:e] for e, z in zip(ends.tolist(), sizes.tolist())])
                values, places, numbers = [], [], []
                for j, seed in enumerate(seeds):
                    v = np.where(s == 0, np.uint64(0), mix(s ^ seed) | np.uint64(1))
                    left, low, right = compact_windows(v, width)
                    if j == 0:
                        start, least, run = _runs_of_windows(v, s, width)
                    values.append(v[low])
                    places.append(np.stack((low, left, right), 1))
                    numbers.append(np.full(len(low), j))
                value, place, number = np.concatenate(values), np.concatenate(places), np.concatenate(numbers)
                wide = np.concatenate((np.zeros(CONTEXT, np.uint64), s, np.zeros(CONTEXT, np.uint64)))
                context = np.stack((wide[place[:, 0]], wide[place[:, 0] + 2 * CONTEXT]), 1).astype("<u4")
                at = np.searchsorted(w.first, place[:, 0], "right") - 1
                place = place - w.first[at][:, None]
                doc = ids[at]
                rows, leaders, lead = _links(value, number, doc, place, context)
                links = _pack_links(number, doc, place, rows, leaders)
                at = np.searchsorted(w.first, start, "right") - 1
                owner, inside = ids[at], start - w.first[at]
                same, first, stays = _equal_runs(run, owner, inside)
                links = np.concatenate((links, _pack_runs(owner, inside, same, first, width)))
                value, number, doc = value[lead], number[lead], doc[lead]
                place, context = place[lead], context[lead]
                # neighbouring runs with one minimum are one segment
                start, least, run, owner, inside = (c[stays] for c in (start, least, run, owner, inside))
                new = np.concatenate(([True], (np.diff(start) != 1) | (least[1:] != least[:-1])))[:len(start)]
                cut = np.flatnonzero(new)
                segments = np.zeros(len(cut), _SEGMENT)
                segments["doc"], segments["at"], segments["n"] = owner[cut], inside[cut], np.diff([*cut, len(start)])
                nodes = np.zeros(len(value), _WINDOW)
                # widths on both sides of a minimum take fewer bytes than places
                nodes["doc"], nodes["number"], nodes["low"] = doc, number, place[:, 0]
                nodes["left"], nodes["right"] = place[:, 0] - place[:, 1], place[:, 2] - place[:, 0]
                bucket, near, home = (_split(value, buckets)[0], (links["doc"] % buckets).astype(np.int64),
                                      _split(least[cut], buckets)[0])
                dealt = _dealt(bucket, nodes, value, context)
                dealt_links, dealt_segments = _dealt(near, links), _dealt(home, segments, least[cut])
                dealt_runs = _dealt(np.repeat(home, segments["n"]), run.astype("<u4"))
                rows = []
                for b in np.unique(np.concatenate((bucket, near, home))).tolist():
                    (node, *hashed), (segment, low) = dealt(b), dealt_segments(b)
                    rows.append((b, _thin(node, segment, *dealt_links(b)),
                                 *(c.tobytes() for c in (*hashed, low, *dealt_runs(b)))))
                yield pd.DataFrame(rows, columns=["bucket", "packed", "value", "context", "least", "runs"])

    def meet(pdf):
        take = lambda name, kind: np.concatenate([np.frombuffer(v, kind) for v in pdf[name]])
        value, least, run = take("value", "<u8"), take("least", "<u8"), take("runs", "<u4")
        context = take("context", "<u4").reshape(-1, 2)
        nodes, segments, links = (np.concatenate(tables) for tables in zip(*(
            _thick(p, (_WINDOW, len(v) // 8), (_SEGMENT, len(s) // 8))
            for p, v, s in zip(pdf["packed"], pdf["value"], pdf["least"]))))
        low = nodes["low"]
        place, number, doc = np.stack((low, low - nodes["left"], low + nodes["right"]), 1), nodes["number"], nodes["doc"]
        rows, leaders, _ = _links(value, number, doc, place, context)
        n = segments["n"].astype(np.int64)
        owner = np.repeat(segments["doc"], n)
        at = np.arange(len(run)) + np.repeat(segments["at"] - (np.cumsum(n) - n), n)
        run = np.repeat(least, n) ^ (run * np.uint64(0xD1B54A32D192ED03))
        same, first, _ = _equal_runs(run, owner, at)
        links = np.concatenate((links, _pack_links(number, doc, place, rows, leaders),
                                _pack_runs(owner, at, same, first, width)))
        # a row per pair of documents, its windows packed
        order = np.lexsort((links["other"], links["doc"]))
        links = links[order]
        new = np.concatenate(([True], (links["doc"][1:] != links["doc"][:-1])
                              | (links["other"][1:] != links["other"][:-1]))) if len(links) else []
        cut = np.flatnonzero(new)
        return pd.DataFrame({"doc": links["doc"][cut], "other": links["other"][cut],
                             "links": [links[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(links)])]})

    pairs = (chunks.select("ids", "sizes", "texts").mapInPandas(
        windows, "bucket int, packed binary, value binary, context binary, least binary, runs binary")
        .groupBy("bucket").applyInPandas(meet, "doc long, other long, links binary")
        .groupBy("doc", "other").agg(F.collect_list("links").alias("links")))

    def agree(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            packed = [b"".join(p) for p in pdf["links"]]
            links = np.frombuffer(b"".join(packed), _LINK)
            ends = np.cumsum([len(p) // _LINK.itemsize for p in packed])
            starts = np.concatenate(([0], ends[:-1]))
            # most pairs have links of one function only
            most = np.maximum.reduceat(links["j"], starts)
            some = np.flatnonzero((most == SURE) | (most != np.minimum.reduceat(links["j"], starts)))
            out = []
            for doc, other, p, q in zip(pdf["doc"].to_numpy()[some].tolist(), pdf["other"].to_numpy()[some].tolist(),
                                        starts[some].tolist(), ends[some].tolist()):
                out += [(doc, other, *c) for c in _join_intervals(links[p:q])]
            yield pd.DataFrame(out, columns=["doc", "other", "a", "b", "oa", "ob", "shifts", "runs"])

    small_batches(spark, 2000)
    spans = materialize(pairs.mapInPandas(
        agree, "doc long, other long, a int, b int, oa int, ob int, shifts binary, runs binary"))
    texts = base.select("id", F.col("text").alias("text"))

    def slices(batches):
        for pdf in batches:
            if len(pdf):
                which, own = pd.factorize(pdf["text"].fillna(""))
                w = Words([t.encode("utf-8", "replace") for t in own], PLAIN_BYTES)
                raw = w.raw.tobytes()
                part = []
                for i, a, b in zip(which.tolist(), pdf["oa"], pdf["ob"]):
                    f, n = w.first[i], w.n_words[i]
                    b = min(b + SHINGLE - 1, n - 1)
                    part.append(raw[w.start[f + a]:w.end[f + b]])
                yield pd.DataFrame({"doc": pdf["doc"], "other": pdf["other"], "a": pdf["a"], "b": pdf["b"],
                                    "oa": pdf["oa"], "shifts": pdf["shifts"], "runs": pdf["runs"], "passage": part})

    def verify(batches):
        for pdf in batches:
            if len(pdf):
                which, own = pd.factorize(pdf["text"].fillna(""))
                w, s = shingle_values([t.encode("utf-8", "replace") for t in own])
                _, o = (x := shingle_values(pdf["passage"].tolist()))
                out = []
                for i, row in enumerate(pdf.itertuples()):
                    mine = s[w.first[which[i]]:w.first[which[i] + 1]]
                    theirs = o[x[0].first[i]:x[0].first[i + 1]]
                    out += [(row.doc, row.other, *p) for p in _verified(
                        mine, row.a, row.b, theirs, row.oa, np.frombuffer(row.shifts, "<i8"), width, similarity,
                        np.frombuffer(row.runs, "<i8").reshape(-1, 3))]
                yield pd.DataFrame(out, columns=["doc", "other", "first_word", "n_words",
                                                 "other_first_word", "similarity"])

    small_batches(spark, 200)
    # rows of a pair leave the text of one side behind before the other is joined
    first = spans.join(texts.withColumnRenamed("id", "other"), "other").mapInPandas(
        slices, "doc long, other long, a int, b int, oa int, shifts binary, runs binary, passage binary")
    found = materialize(first.join(texts.withColumnRenamed("id", "doc"), "doc").mapInPandas(
        verify, "doc long, other long, first_word long, n_words long, other_first_word long, similarity double"))
    best = found.groupBy("doc", "other", "first_word", "n_words").agg(
        F.max(F.struct("similarity", "other_first_word")).alias("best"))
    return best.select(F.col("doc").alias(id_col), F.col("other").alias("other_id"), "first_word", "n_words",
                       "best.other_first_word", "best.similarity")


def _join_intervals(links):
    """Stretches of a pair where windows of enough hash functions, or a run, overlap in the text.

    Words put in or left out move the places in the other text, so links of any alignment
    are one stretch: (first, last, other's first, other's last, packed shifts of its windows,
    packed equal runs).
    """
    links = links[np.argsort(links["left"], kind="stable")]
    gap = np.flatnonzero(links["left"][1:] > np.maximum.accumulate(links["right"])[:-1]) + 1
    out = []
    for p, q in zip([0, *gap], [*gap, len(links)]):
        part = links[p:q]
        if len(np.unique(part["j"])) >= AGREE or (part["j"] == SURE).any():
            sure, shifts = part["j"] == SURE, part["olow"].astype(np.int64) - part["low"]
            out.append((int(part["left"].min()), int(part["right"].max()),
                        int(part["oleft"].min()), int(part["oright"].max()),
                        np.unique(shifts[~sure]).tobytes(), _join_runs(part[sure], shifts[sure]).tobytes()))
    return out


def _join_runs(links, shifts):
    """Equal runs (first, other's first, length), those that overlap on one diagonal as one."""
    order = np.lexsort((links["left"], shifts))
    first, last, shifts = (c[order].astype(np.int64) for c in (links["left"], links["right"], shifts))
    cut = np.flatnonzero(np.concatenate(
        ([True], (shifts[1:] != shifts[:-1]) | (first[1:] > last[:-1] + 1)))[:len(first)])
    last = last[np.concatenate((cut[1:], [len(first)]))[:len(cut)] - 1]
    return np.stack((first[cut], first[cut] + shifts[cut], last - first[cut] + 1), 1)


def _runs(left, right, shifts):
    """Runs of equal shingles (first in left, first in right, length): all on the given
    diagonals, and those through shingles that meet at the same occurrence on both sides."""
    def ranked(v):
        at = np.argsort(v, kind="stable")
        s = v[at]
        new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        rank = np.arange(len(s)) - np.repeat(new, np.diff(np.append(new, len(s))))
        key = mix(s + rank.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        return key[s != 0], at[s != 0]

    (ka, ia), (kb, ib) = ranked(left), ranked(right)
    _, x, y = np.intersect1d(ka, kb, return_indices=True)
    i, d = [ia[x]], [ib[y] - ia[x]]
    for s in shifts.tolist():
        lo, hi = max(0, -s), min(len(left), len(right) - s)
        if lo < hi:
            at = lo + np.flatnonzero((left[lo:hi] == right[lo + s:hi + s]) & (left[lo:hi] != 0))
            i.append(at)
            d.append(np.full(len(at), s))
    # diagonals may be negative, places are not
    both = np.unique((np.concatenate(d) << 32) + np.concatenate(i))
    if not len(both):
        return np.zeros((0, 3), np.int64)
    d, i = both >> 32, both & 0xFFFFFFFF
    cut = np.flatnonzero((np.diff(d) != 0) | (np.diff(i) != 1)) + 1
    first, last = i[np.concatenate(([0], cut))], i[np.concatenate((cut - 1, [len(i) - 1]))]
    d = d[np.concatenate(([0], cut))]
    out = np.stack((first, first + d, last - first + 1), 1)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def _chain(runs):
    """The chain of runs, ascending on both sides, with most equal shingles for its gaps:
    (first in left, first in right, length) of its pieces, and the numbers of its runs."""
    a, b, n = runs.T
    total = n.sum()
    best, back = n.astype(float), np.full(len(n), -1)
    for k in range(1, len(n)):
        over = np.maximum(np.maximum(a[:k] + n[:k] - a[k], b[:k] + n[:k] - b[k]), 0)
        gap = np.maximum(a[k] + b[k] + 2 * over - a[:k] - b[:k] - 2 * n[:k], 0)
        score = best[:k] + n[k] - over - 0.05 * gap
        # a gap that four times its equal shingles can't carry joins nothing
        score[(over >= n[k]) | (4 * gap > total) | (a[:k] >= a[k]) | (b[:k] >= b[k])] = -1
        p = int(score.argmax())
        if score[p] > best[k]:
            best[k], back[k] = score[p], p
    k, at = int(best.argmax()), []
    while k >= 0:
        at.append(k)
        k = int(back[k])
    pieces = []
    for k in at[::-1]:
        x, y, m = (int(c) for c in runs[k])
        if pieces:
            over = max(0, pieces[-1][0] + pieces[-1][2] - x, pieces[-1][1] + pieces[-1][2] - y)
            x, y, m = x + over, y + over, m - over
        pieces.append((x, y, m))
    return np.array(pieces, np.int64), at


def _stretches(pieces, lengths, width, similarity):
    """Longest parts of a chain that are similar enough and wide enough, apart from each other:
    (first in left, length, first in right, length, equal)."""
    a, b, n = pieces.T
    known = np.concatenate(([0], np.cumsum(n)))
    found = []
    todo = [(0, len(n), 0, 0, *lengths)]
    while todo:
        p, q, a0, b0, a1, b1 = todo.pop()
        take = None
        for s in range(p, q):
            if known[q] - known[s] < similarity * width - 1e-9 or take and known[q] - known[s] <= take[0]:
                break
            e = np.arange(s, q)
            la, lb = a[s:q] + n[s:q] - a[s], b[s:q] + n[s:q] - b[s]
            same = known[e + 1] - known[s]
            # parts short of the least length take in unequal shingles around them
            pad = np.maximum(width - np.minimum(la, lb), 0)
            room = min(a[s] - a0, b[s] - b0) + np.minimum(a1 - a[s:q] - n[s:q], b1 - b[s:q] - n[s:q])
            good = np.flatnonzero((same >= similarity * (la + lb + 2 * pad - same) - 1e-9) & (pad <= room))
            if len(good):
                g = good[-1]
                if take is None or same[g] > take[0]:
                    take = (same[g], s, s + int(g) + 1, int(pad[g]))
        if take is None:
            continue
        same, s, e, pad = take
        x, y, xe, ye = a[s], b[s], a[e - 1] + n[e - 1], b[e - 1] + n[e - 1]
        after = min(pad, a1 - xe, b1 - ye)
        x, y, xe, ye = x - pad + after, y - pad + after, xe + after, ye + after
        found.append((int(x), int(xe - x), int(y), int(ye - y), int(same)))
        todo += [(p, s, a0, b0, x, y), (e, q, xe, ye, a1, b1)]
    return found


def _verified(mine, a, b, theirs, oa, shifts, width, similarity, equal=()):
    """Passages of shingles a..b of one text and their partners: (first word, words, other's, similarity).

    Equal shingles are chained over inserted and deleted words; the similarity is what the
    chain has in common among all shingles of both stretches.  Runs ``equal`` to the other's
    that lie in no passage so found are passages themselves.
    """
    left, right = mine[a:b + 1], theirs
    while len(left) and left[-1] == 0:
        left = left[:-1]
    while len(right) and right[-1] == 0:
        right = right[:-1]
    # equal stretches without a repeated shingle have one run, which is the passage
    if len(left) >= width and np.array_equal(left, right) and left.all() and len(np.unique(left)) == len(left):
        out = [(int(a), len(left) + SHINGLE - 1, int(oa), 1.0)]
        return out + _uncovered(mine, a, b, theirs, oa, equal, out) if len(equal) else out
    runs, out = _runs(left, right, shifts + (a - oa)), []
    while len(runs) and runs[:, 2].sum() >= similarity * width - 1e-9:
        pieces, at = _chain(runs)
        if pieces[:, 2].sum() < similarity * width - 1e-9:
            break
        for x, n, y, m, same in _stretches(pieces, (len(left), len(right)), width, similarity):
            out.append((int(a + x), int(n + SHINGLE - 1), int(oa + y), same / (n + m - same)))
        runs = np.delete(runs, at, axis=0)
    return out + _uncovered(mine, a, b, theirs, oa, equal, out) if len(equal) else out


def _uncovered(mine, a, b, theirs, oa, equal, found):
    """As few of the equal runs as cover what words of them lie in no passage found."""
    first, last = equal[:, 0] - a, equal[:, 0] - a + equal[:, 2] + SHINGLE - 1
    left, live, out = np.zeros(b + SHINGLE + 1 - a, bool), np.ones(len(equal), bool), []
    for x, y in zip(first.tolist(), last.tolist()):
        left[x:y] = True
    for x, n, _, _ in found:
        left[x - a:x - a + n] = False
    while left.any():
        at = int(left.argmax())
        k = int(np.where(live & (first <= at), last, 0).argmax())
        x, y, n = equal[k].tolist()
        if not live[k] or last[k] <= at:
            left[at] = False
        elif np.array_equal(mine[x:x + n], theirs[y - oa:y - oa + n]):
            out.append((x, n + SHINGLE - 1, y, 1.0))
            left[first[k]:last[k]] = False
        else:
            live[k] = False
    return out
