"""Ranked search against its SQL and against a plain version on awkward rows."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from coffer.llm import lexical
from coffer.llm.queries import ORACLES, QUERIES

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, top=10):
    terms = [(i, TERM.findall(bytes((t or "").encode()).lower())) for i, t in docs]
    held = [t for _, t in terms if t]
    n_docs, n_words = len(held), sum(map(len, held))
    df = Counter(w for t in held for w in set(t))
    out = []
    for item, text in items:
        asked, scored = Counter(TERM.findall((text or "").encode().lower())), []
        for i, t in terms:
            tf, m, score = Counter(t), 0, 0
            if t:
                m = 100 - 75 + (75 * len(t) * n_docs) // n_words
            for w, times in asked.items():
                if tf[w]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    score += times * weight * ((1000000000 * tf[w]) // (1000 * tf[w] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[:top])]
    return sorted(map(str, out))


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = QUERIES["op13_search"](spark, sf_dir)
    want = con.execute(ORACLES["op13_search"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("items_a_block,block_bytes,direct", [(1000, 1 << 24, 1 << 23), (2, 600, 0)])
def test_awkward_rows(spark, monkeypatch, items_a_block, block_bytes, direct):
    monkeypatch.setattr(lexical, "ITEMS", items_a_block)
    monkeypatch.setattr(lexical.search, "__defaults__", (10, "doc_id", "text", "item_id", "text"))
    monkeypatch.setattr(lexical.postings, "__defaults__", ("doc_id", "text", block_bytes))
    monkeypatch.setattr(lexical, "DIRECT", direct)
    rng = random.Random(5)
    words = ["the", "of", "Ärger", "zwölf", "x1", "rare", "ZEBRA", "日本", *[f"w{i}" for i in range(30)]]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(200)]
    docs += [(500 + i, "the of the same words here") for i in range(40)]  # ties
    docs += [(900, None), (901, ""), (902, " .,-"), (903, "THE the The " * 5000), (None, "zebra rare"),
             (None, "zebra rare"), (1, docs[1][1])]
    items = [("a", "the of same"), ("b", "rare zebra zebra"), ("c", None), ("d", ""), ("e", "missing words"),
             ("f", "日本 ärger Ärger"), ("a", "x1"), (None, "w1 w2"), ("g", docs[7][1])]
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, score string").repartition(4)
    q = spark.createDataFrame(items, "item_id string, text string")
    got = sorted(str(tuple(r)) for r in lexical.search(d, q).collect())
    assert got == plain(docs, items)


def test_stops_before_the_end_of_the_lists():
    rng = np.random.default_rng(2)
    n_docs, term, doc, impact = 5000, [], [], []
    for t in range(3):
        docs = np.sort(rng.choice(n_docs, 3000, replace=False))
        term.append(np.full(3000, t))
        doc.append(docs)
        impact.append((rng.pareto(1, 3000) * 1000).astype(np.int64) + 1)
    term, doc, impact = map(np.concatenate, (term, doc, impact))
    lists = lexical.Lists(term, doc, impact, n_docs, 3)
    times = np.array([1, 2, 1])
    found, score = lists.search(np.arange(3), times, 1, 10)
    whole = np.zeros(n_docs, np.int64)
    np.add.at(whole, doc, impact * times[term])
    assert (whole[found] == score).all() and len(found) < 2000
    assert sorted(score.tolist())[-10:] == sorted(whole.tolist())[-10:]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    item = spark.createDataFrame([("a", "the")], "item_id string, text string")
    assert lexical.search(none, item).count() == 0
    assert lexical.search(none, item.limit(0)).count() == 0
