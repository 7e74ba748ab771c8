"""Passages with inserted and deleted words."""

import random

import pytest

from coffer.llm import passages


def words(name, n):
    return [f"{name}{i}" for i in range(n)]


@pytest.mark.parametrize("n,edits", [(60, [30]), (88, [44]), (300, [70, 150, 230]), (60, [-30]), (300, [60, -150, 220])])
def test_edited_passage(n, edits):
    here = words("p", n)
    there = list(here)
    for e in sorted(edits, key=abs, reverse=True):
        there[abs(e):abs(e) + (e < 0)] = [] if e < 0 else ["new"]
    texts = [" ".join(words("a", 40) + here + words("b", 30)), " ".join(words("c", 25) + there + words("d", 50))]
    w, s = passages.shingle_values([t.encode() for t in texts])
    other, mine = s[:w.first[1]], s[w.first[1]:]
    out = passages._verified(mine, 0, len(mine) - 1, other, 0, passages.np.array([15]), 46, 0.8)
    assert len(out) == 1
    first, size, start, similarity = out[0]
    assert (first, size, start) == (25, len(there), 40) and 0.8 <= similarity < 1


def test_edited_passages_are_found(spark):
    rows = []
    for k in range(20):
        here = words(f"p{k}x", 60)
        rows += [(2 * k, " ".join(words(f"a{k}x", 40) + here)),
                 (2 * k + 1, " ".join(words(f"b{k}x", 30) + here[:30] + ["new"] * (k % 2) + here[30 + (k % 2 == 0):]))]
    out = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in out if r["other_id"] == r["doc_id"] - 1 and r["n_words"] >= 59
            and r["first_word"] == 30 and r["other_first_word"] == 40} == set(range(1, 40, 2))


def covered(out):
    by = {}
    for r in out:
        assert r["other_id"] < r["doc_id"]
        by.setdefault(r["doc_id"], set()).update(range(r["first_word"], r["first_word"] + r["n_words"]))
    return by


@pytest.mark.parametrize("parts", [1, 7])
def test_passages_around_a_stock_phrase_are_found(spark, parts):
    """Pairs that share a phrase of all documents and, they alone, some words more."""
    stock, rows, n = words("stock", 44), [], 0
    for size in (50, 52, 56):
        for k in range(100):
            before = (size - 44) * (k % 3) // 2
            here = words(f"p{size}x{k}y", before) + stock + words(f"q{size}x{k}y", size - 44 - before)
            for _ in range(2):
                rows.append((n, " ".join(words(f"a{n}y", 60) + here + words(f"b{n}y", 60)), size))
                n += 1
    random.Random(4).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int").repartition(parts)
    out = passages.near_passages(docs).collect()
    by = covered(out)
    for i, _, size in rows:
        assert set(range(60, 60 + size)) <= by.get(i, set()) if i % 2 else i not in by


def test_every_run_of_an_earlier_document_is_found(spark):
    """Texts put together from few parts, next to a comparison of all runs of 50 words."""
    r = random.Random(8)
    pool = [[f"w{r.randrange(40)}" for _ in range(r.randrange(10, 90))] for _ in range(25)]
    pool.append(["same"] * 70)
    rows = []
    for i in range(80):
        text = []
        for _ in range(r.randrange(1, 7)):
            part = r.choice(pool)
            a = r.randrange(len(part) // 2)
            text += part[a:a + r.randrange(5, 90)] + words(f"x{i}y", r.randrange(3))
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, text string").repartition(5)
    by = covered(passages.near_passages(docs).collect())
    seen, runs = {}, 0
    for i, text in rows:
        w = text.split()
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k:k + 50]), i) < i:
                runs += 1
                assert set(range(k, k + 50)) <= by.get(i, set())
    assert runs > 100


def test_few_runs_cover_a_repeated_word(spark):
    rows = [(1, " ".join(words("a", 20) + ["same"] * 67)), (2, " ".join(["same"] * 400 + words("b", 9)))]
    out = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert covered(out)[2] == set(range(400)) and len(out) <= 12


def test_links_travel_in_few_bytes():
    """Windows, segments and links come back whole, in a quarter of their records' bytes."""
    r = passages.np.random.default_rng(3)
    tables = []
    for kind in (passages._WINDOW, passages._SEGMENT, passages._LINK):
        rows = passages.np.zeros(2000, kind)
        for name in kind.names:
            rows[name] = r.integers(0, 100, 2000)
        rows["doc"] = passages.np.sort(r.integers(-2000, 1 << 40, 40)).repeat(50)
        tables.append(rows)
    packed = passages._thin(*tables)
    back = passages._thick(packed, (passages._WINDOW, 2000), (passages._SEGMENT, 2000))
    assert [b.tolist() for b in back] == [t.tolist() for t in tables]
    assert 4 * len(packed) < sum(t.nbytes for t in tables)
    none = [t[:0] for t in tables]
    assert [len(b) for b in passages._thick(passages._thin(*none), (passages._WINDOW, 0), (passages._SEGMENT, 0))] == [0, 0, 0]


def test_written_tables_leave_no_shuffle_behind(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = disk.getAllFiles().size()
    docs = passages.materialize(spark.range(1000).repartition(5, "id"))
    assert disk.getAllFiles().size() <= before
    assert docs.count() == 1000
