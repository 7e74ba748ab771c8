"""Benchmark passages in documents, found by winnowed fingerprints and exact windows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .common import Words, gram_hashes, materialize, mix, small_batches, window_minima

WINDOW = 10
GRAM = 5


def _word_bytes():
    """Word bytes: digits, letters (lower case) and everything beyond ASCII."""
    t = np.arange(256)
    t[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[65:91] = word[97:123] = word[128:] = True
    return np.where(word, t, 0).astype(np.uint8)


WORD_BYTES = _word_bytes()


def _words(texts):
    return Words([(t or "").encode("utf-8", "surrogatepass") for t in texts], WORD_BYTES)


def scheme(length):
    """(gram, window) for spans of ``length`` words: ``gram + window - 1 == length``."""
    k = min(GRAM, length)
    return k, length - k + 1


def fingerprints(h, length):
    """Winnowed fingerprints of a word-hash sequence: every span of ``length`` words has one.

    Of each run of grams the lowest hash is kept, ties included, so equal spans keep equal
    fingerprints wherever they stand.
    """
    k, w = scheme(length)
    g = gram_hashes(h, k)
    return np.unique(mix(g[window_minima(g, w)] + np.uint64(length)))


def _item_length(n, window):
    return np.minimum(n, window)


def contamination(docs, benchmark, window=WINDOW, id_col="doc_id", text_col="text",
                  item_col="item_id", item_text_col="text"):
    """Benchmark passages of every document.

    A span is ``window`` consecutive words of an item, or a whole shorter item.  One row per
    input row: id, ``n_words``, ``n_hit`` (words inside a span), ``items`` (sorted texts of the
    ids of items that occur), ``spans`` (first word and length of each run of hit words).
    Null and empty texts have no words; items without words or id match nothing; repeated
    rows stay; other columns are ignored; an empty table on either side gives no hit.

    Fingerprints of the benchmark are written first, so their size is known when Spark picks
    the join.  Documents meet an item only if they share a fingerprint, then exactly.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("item_text"))

    def item_prints(batches):
        for pdf in batches:
            words = _words(pdf["item_text"])
            h = words.hashes()
            for i, item in enumerate(pdf["item"]):
                own = h[words.first[i]:words.first[i + 1]]
                if len(own):
                    size = int(_item_length(len(own), window))
                    for f in fingerprints(own, size):
                        yield pd.DataFrame({"print": [f.astype(np.int64)], "size": [size], "item": [item]})

    test = materialize(items.mapInPandas(item_prints, "print long, size int, item string").distinct())
    sizes = sorted(r["size"] for r in test.select("size").distinct().collect())

    def doc_prints(batches):
        for pdf in batches:
            words = _words(pdf["text"])
            h = words.hashes()
            found = []
            for i in range(len(pdf)):
                own = h[words.first[i]:words.first[i + 1]]
                part = [fingerprints(own, s) for s in sizes if len(own) >= s]
                found.append((np.concatenate(part) if part else np.zeros(0, np.uint64)).view(np.int64))
            yield pd.DataFrame({"id": pdf["id"], "prints": found})

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = base.schema["id"].dataType.simpleString()
    prints = base.mapInPandas(doc_prints, f"id {id_type}, prints array<long>").select(
        "id", F.explode("prints").alias("print"))
    met = prints.join(test.select("print", "item"), "print").select("id", "item").distinct()
    # an item's text per document that may hold it: bounded by the benchmark
    texts = items.groupBy("item").agg(F.collect_set("item_text").alias("item_texts"))
    candidates = materialize(
        met.join(texts, "item").groupBy("id")
        .agg(F.collect_list(F.struct("item", "item_texts")).alias("held")))

    def extend(batches):
        for pdf in batches:
            words = _words(pdf["text"])
            h = words.hashes()
            rows = []
            for i, held in enumerate(pdf["held"]):
                a, b = words.first[i], words.first[i + 1]
                rows.append(_extend(words, h, a, b, held, window) if held is not None and len(held)
                            else (int(b - a), 0, [], []))
            yield pd.DataFrame({"id": pdf["id"], "n_words": [r[0] for r in rows],
                                "n_hit": [r[1] for r in rows], "items": [r[2] for r in rows],
                                "spans": [r[3] for r in rows]})

    held = candidates.withColumnRenamed("id", "held_id")
    out = base.join(held, base["id"].eqNullSafe(held["held_id"]), "left").drop("held_id").mapInPandas(
        extend, f"id {id_type}, n_words long, n_hit long, items array<string>, "
                "spans array<struct<first:long,length:long>>")
    return out.withColumnRenamed("id", id_col)


def _extend(words, h, a, b, held, window):
    """Exact hits of the candidate items in words a..b."""
    cover = np.zeros(b - a + 1, np.int64)
    at_size, items = {}, []
    for entry in held:
        occurs = False
        other = _words(entry["item_texts"])
        g = other.hashes()
        for i in range(len(entry["item_texts"])):
            lo, hi = other.first[i], other.first[i + 1]
            size = int(_item_length(hi - lo, window))
            if not size or size > b - a:
                continue
            if size not in at_size:
                at_size[size] = gram_hashes(h[a:b], size)
            spans = gram_hashes(g[lo:hi], size)
            for p in np.flatnonzero(np.isin(at_size[size], spans)):
                mine = [words.raw[s:e].tobytes() for s, e in zip(
                    words.start[a + p:a + p + size], words.end[a + p:a + p + size])]
                for q in np.flatnonzero(spans == at_size[size][p]):
                    if mine == [other.raw[s:e].tobytes() for s, e in zip(
                            other.start[lo + q:lo + q + size], other.end[lo + q:lo + q + size])]:
                        cover[p] += 1
                        cover[p + size] -= 1
                        occurs = True
                        break
        if occurs:
            items.append(entry["item"])
    hit = np.cumsum(cover)[:-1] > 0
    edge = np.flatnonzero(np.diff(hit, prepend=False, append=False))
    spans = [{"first": int(s), "length": int(e - s)} for s, e in zip(edge[0::2], edge[1::2])]
    return int(b - a), int(hit.sum()), sorted(items), spans


def drop_contaminated(docs, benchmark, id_col="doc_id", text_col="text"):
    """Documents without any benchmark span; all columns stay."""
    bad = contamination(docs, benchmark, id_col=id_col, text_col=text_col).where("n_hit > 0")
    bad = materialize(bad.select(F.col(id_col).alias("bad_id")).distinct())
    return docs.join(bad, docs[id_col].eqNullSafe(bad["bad_id"]), "left_anti")

