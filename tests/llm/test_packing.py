"""Packing: the plan on histograms, and whole documents against the tokenizers library."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from coffer.llm.packing import Places, pack_documents, packed_sequences, plan_packing
from coffer.llm.ranked import word_coder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "\x00a b", "İstanbul ΣΑΣ ς", "á ́", "x" * 30000, "<|endoftext|> it's I'LL 123abc¼ ²",
       "日本語 テスト", "a\x1cb \x85 c", "'S 's", "ǅ ß ẞ ŉ", "a" * 700 + "</w>", "word " * 9000]


def taken(plan):
    got = {}
    for copies, pattern in plan:
        for length, times in pattern:
            got[length] = got.get(length, 0) + copies * times
    return got


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(
    st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 1000), max_size=12))))
def test_plan_takes_every_piece_within_the_capacity(case):
    capacity, counts = case
    plan = plan_packing(counts, capacity)
    assert taken(plan) == counts
    assert all(copies > 0 and sum(a * n for a, n in p) <= capacity for copies, p in plan)


def test_plan_is_close_to_the_least_number_and_small():
    rng = np.random.default_rng(3)
    lengths = np.clip(rng.lognormal(6, 1, 100_000).astype(int), 1, 2048)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    plan = plan_packing(counts)
    least = math.ceil(lengths.sum() / 2048)
    assert sum(c for c, _ in plan) <= least * 1.001 + 1
    many = plan_packing({k: 10**7 * v for k, v in counts.items()})
    assert len(many) < 8000 and taken(many) == {k: 10**7 * v for k, v in counts.items()}


def test_exact_complements_by_one_two_and_three():
    assert plan_packing({1500: 7, 548: 7}) == [(7, ((1500, 1), (548, 1)))]
    assert plan_packing({1500: 5, 300: 5, 248: 5}) == [(5, ((1500, 1), (300, 1), (248, 1)))]
    assert sum(c for c, _ in plan_packing({1500: 5, 300: 5, 200: 5, 48: 5})) == 5
    assert plan_packing({2048: 3}) == [(3, ((2048, 1),))]
    assert plan_packing({}) == []
    with pytest.raises(ValueError):
        plan_packing({9: 1}, 8)


def test_places_are_gapless():
    counts = {5: 7, 3: 11, 2: 4, 1: 9}
    places = Places(plan_packing(counts, 8))
    length = np.repeat(list(counts), list(counts.values()))
    number = np.concatenate([np.arange(n) for n in counts.values()])
    sequence, offset = places.find(length, number)
    for s in range(places.sequences):
        ends = 0
        for o, n in sorted(zip(offset[sequence == s].tolist(), length[sequence == s].tolist())):
            assert o == ends
            ends += n
        assert 0 < ends <= 8


def test_words_equal_the_library():
    coder, library = word_coder(PATH), Tokenizer.from_file(PATH)
    texts = [t or "" for t in ODD]
    for text, raw in zip(texts, coder.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_documents_are_packed_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = [(10**6 + i, t) for i, t in enumerate(ODD)] + [(None, "same"), (None, "same"), (10**6, "")]
    rows = [tuple(r) for r in docs.collect()] + odd
    data = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, part int, length string")
    placed = pack_documents(data.repartition(5), PATH)
    got = [r.asDict() for r in placed.collect()]
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, a in enumerate(range(0, len(ids), 2048)):
            own = ids[a:a + 2048]
            want.append((i, piece, a, len(own), zlib.crc32(own.tobytes())))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in columns)) for r in got)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["token_ids"])))
    for parts in held.values():
        ends = 0
        for offset, length, _ in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 2048
    total = sum(r["length"] for r in got)
    assert len(held) == math.ceil(total / 2048)
    whole = {r["sequence_id"]: bytes(r["token_ids"]) for r in packed_sequences(placed).collect()}
    assert whole == {s: b"".join(x[2] for x in sorted(p)) for s, p in held.items()}


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
