"""Ranked lexical search over impact lists with the best position algorithm.

Each task keeps the postings of the items' terms for blocks of documents.  In a block every term
has a list of its documents by falling impact.  An item reads its lists in step; a document met
for the first time is completed by direct access to all lists, which also marks its positions
there as seen.  A list's *best position* is the end of its unbroken run of seen positions, and
no unseen document can score more than the impacts at the best positions together.  Reading
stops once that sum is strictly below the lowest score kept, so equal scores are never missed.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import Words, importable, materialize

TOP = 10
BLOCK_BYTES = 1 << 24
ITEMS, ITEM_BYTES = 1000, 1 << 23
FIRST_STEP = 32
DIRECT = 1 << 23

TABLE = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    TABLE[_b] = _b
TABLE[0x41:0x5B] = np.arange(0x61, 0x7B)


class Queries:
    """A bounded block of items: their terms, and how often each item holds each."""

    def __init__(self, items):
        self.ids = [i for i, _ in items]
        words = Words([t for _, t in items], TABLE)
        self.terms, term = np.unique(words.hashes(), return_inverse=True)
        item = np.repeat(np.arange(len(items)), words.n_words)
        each, self.times = np.unique(item * max(1, len(self.terms)) + term, return_counts=True)
        item, self.term = np.divmod(each, max(1, len(self.terms)))
        self.first = np.searchsorted(item, np.arange(len(items) + 1))


def _item_blocks(items, id_col, text_col):
    """Items in id order, in blocks of at most ``ITEMS`` rows and ``ITEM_BYTES`` bytes (a longer
    item is a block of its own); one block is held at a time."""
    held, size = [], 0
    rows = items.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    for r in rows.orderBy("i").toLocalIterator():
        if held and (len(held) >= ITEMS or size + len(r["t"]) > ITEM_BYTES):
            yield held
            held, size = [], 0
        held.append((r["i"], bytes(r["t"])))
        size += len(r["t"])
    if held:
        yield held


def postings(docs, terms, id_col="doc_id", text_col="text", block_bytes=BLOCK_BYTES):
    """Written blocks of documents with the postings of some terms (64-bit hashes, in order).

    A row has the documents' ids and numbers of terms, the postings ``(term, doc, tf)`` in
    order of term and document, and how many documents hold each term.
    """
    importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def index(batches):
        ids, sizes, found, docs_held, held = [], [], [], 0, 0

        def row():
            term, doc, tf = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found))
            order = np.argsort(term, kind="stable")
            holds, documents = np.unique(term, return_counts=True)
            values = [pa.concat_arrays(ids), np.concatenate(sizes), term[order].astype(np.int32),
                      doc[order].astype(np.int32), tf[order].astype(np.int32), holds.astype(np.int32),
                      documents]
            names = ["ids", "n", "term", "doc", "tf", "holds", "documents"]
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in values],
                names)

        for batch in batches:
            texts, first, size = batch.column(1).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size < block_bytes // 4 and i + 1 < len(texts):
                    continue
                words = Words(texts[first:i + 1], TABLE)
                h = words.hashes()
                at = np.searchsorted(terms, h)
                at[at == len(terms)] = 0
                match = terms[at] == h if len(terms) else np.zeros(len(h), bool)
                doc = np.repeat(np.arange(i + 1 - first), words.n_words)[match]
                each, tf = np.unique(doc * max(1, len(terms)) + at[match], return_counts=True)
                doc, term = np.divmod(each, max(1, len(terms)))
                found.append((term, doc + docs_held, tf))
                ids.append(batch.column(0).slice(first, i + 1 - first))
                sizes.append(words.n_words.astype(np.int64))
                docs_held += i + 1 - first
                held, first, size = held + size, i + 1, 0
                if held >= block_bytes:
                    yield row()
                    ids, sizes, found, docs_held, held = [], [], [], 0, 0
        if ids:
            yield row()

    return materialize(rows.mapInArrow(
        index, f"ids array<{id_type}>, n array<long>, term array<int>, doc array<int>, tf array<int>, "
               "holds array<int>, documents array<long>"))


class Lists:
    """Impact lists of one block: by term, falling impact, then document."""

    def __init__(self, term, doc, impact, n_docs, n_terms):
        self.n_docs = n_docs
        self.key = term * n_docs + doc  # rising: the order in which postings were written
        order = np.lexsort((doc, -impact, term))
        self.first = np.searchsorted(term, np.arange(n_terms + 1))
        self.doc, self.impact = doc[order], impact[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.place = place - self.first[term]  # position in its list, for direct access

    def _direct(self, term, first, size):
        """Documents to their positions in each of the item's lists, -1 where they are in none.

        A table of lists by documents while that is small, else a search in the postings.
        """
        if len(term) * self.n_docs <= DIRECT:
            table = np.full((len(term), self.n_docs), -1, np.int32)
            for k, (a, n) in enumerate(zip(first, size)):
                table[k, self.doc[a:a + n]] = np.arange(n)
            return lambda met: table[:, met]

        def find(met):
            asked = term[:, None] * self.n_docs + met[None, :]
            at = np.searchsorted(self.key, asked)
            at[at == len(self.key)] = 0
            return np.where(self.key[at] == asked, self.place[at], -1)

        return find

    def search(self, term, times, floor, top):
        """(documents, scores) that may be among the ``top`` ones: all with a score of at least
        the ``top``-th highest, and none below ``floor`` need be given."""
        first, size = self.first[term], self.first[term + 1] - self.first[term]
        term, times, first, size = (x[size > 0] for x in (term, times, first, size))
        own = np.concatenate(([0], np.cumsum(size)))  # the item's lists end to end
        seen = np.zeros(own[-1], bool)
        at = self._direct(term, first, size)
        best = np.zeros(len(term), np.int64)
        known = np.zeros(self.n_docs, bool)
        docs, scores, depth, step = [], [], 0, FIRST_STEP
        kept = np.zeros(0, np.int64)
        while len(term) and depth < size.max():
            met = np.concatenate([self.doc[a + depth:a + min(depth + step, n)]
                                  for a, n in zip(first, size) if depth < n])
            depth, step = depth + step, 2 * step
            met = np.unique(met[~known[met]])
            known[met] = True
            if len(met):
                place = at(met)
                there = place >= 0
                impact = np.where(there, self.impact[first[:, None] + np.maximum(place, 0)], 0)
                score = times @ impact
                seen[(own[:-1, None] + place)[there]] = True
                docs.append(met)
                scores.append(score)
                kept = np.concatenate((kept, score))
                if len(kept) > top:
                    kept = np.partition(kept, len(kept) - top)[-top:]
            limit = 0
            for k in range(len(term)):
                run = seen[own[k] + best[k]:own[k + 1]]
                best[k] += len(run) if run.all() else int(np.argmin(run))
                if best[k] < size[k]:
                    # at the best position; before anything is seen, the list's highest impact
                    limit += times[k] * self.impact[first[k] + max(best[k] - 1, 0)]
            if limit < floor or (len(kept) == top and limit < kept.min()):
                break
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(docs), np.concatenate(scores)


def _search_block(docs, queries, top, id_col, text_col):
    """The ``top`` documents of each item of one block of items."""
    blocks = postings(docs, queries.terms, id_col, text_col)
    total = blocks.select(
        F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + F.when(x > 0, 1).otherwise(0)).alias("docs"),
        F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x).alias("words"),
    ).agg(F.sum("docs"), F.sum("words")).first()
    n_docs, n_words = (int(x or 0) for x in total)
    held = blocks.select(F.explode(F.arrays_zip("holds", "documents")).alias("x")).groupBy("x.holds").agg(
        F.sum("x.documents").alias("df"))
    weight = np.zeros(len(queries.terms), np.int64)
    for r in held.toLocalIterator():  # one number per term of the items at hand
        weight[r["holds"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    id_type = docs.schema[id_col].dataType

    def rank(batches):
        kept = [[] for _ in queries.ids]  # per item: (-score, no id, id)
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column(0)[row].values
                n, term, doc, tf = (np.asarray(batch.column(c)[row].values).astype(np.int64) for c in range(1, 5))
                m = 25 + 75 * n * n_docs // max(1, n_words)
                impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                lists = Lists(term, doc, impact, len(n), len(queries.terms))
                for i in range(len(queries.ids)):
                    own = slice(queries.first[i], queries.first[i + 1])
                    floor = -kept[i][-1][0] if len(kept[i]) == top else 1
                    found, score = lists.search(queries.term[own], queries.times[own], floor, top)
                    good = score >= floor
                    if not good.any():
                        continue
                    found, score = found[good], score[good]
                    if len(score) > top:
                        low = np.partition(score, len(score) - top)[-top]
                        found, score = found[score >= low], score[score >= low]
                    kept[i] += [(-s, d is None, d) for s, d in
                                zip(score.tolist(), ids.take(pa.array(found)).to_pylist())]
                    kept[i] = sorted(kept[i], key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))[:top]
        rows = [(i, -s, d) for i, best in enumerate(kept) for s, _, d in best]
        if rows:
            item, score, doc = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), pa.array(doc, batch.schema.field(0).type.value_type),
                 pa.array(score, pa.int64())], ["item", "doc", "score"])

    found = blocks.select("ids", "n", "term", "doc", "tf").mapInArrow(
        rank, f"item long, doc {id_type.simpleString()}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs, items, top=TOP, id_col="doc_id", text_col="text", item_id_col="item_id", item_text_col="text"):
    """The ``top`` highest-scoring documents of every item: item id, ``rank``, document id, ``score``.

    Items are taken in blocks of bounded size, each against all documents.  Null and empty texts
    have no terms; an item without terms, or whose terms no document holds, has no row; equal
    scores go by document id (none last); repeated documents rank one by one and repeated items
    are answered one by one; empty tables give no row; other columns are left out.
    """
    spark, out = docs.sparkSession, []
    item_type, doc_type = (d.schema[c].dataType.simpleString() for d, c in ((items, item_id_col), (docs, id_col)))
    for held in _item_blocks(items, item_id_col, item_text_col):
        found = _search_block(docs, Queries(held), top, id_col, text_col)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(held)],
                                      f"item long, item_id {item_type}")
        out.append(found.join(names, "item").select(
            F.col("item_id").alias(item_id_col), "rank", F.col("doc").alias(id_col), "score"))
    if not out:
        return spark.createDataFrame([], f"{item_id_col} {item_type}, rank int, {id_col} {doc_type}, score long")
    while len(out) > 1:
        out = [a.unionAll(b) for a, b in zip(out[::2], out[1::2])] + out[len(out) // 2 * 2:]
    return out[0]
