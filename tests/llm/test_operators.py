"""Each operator next to a brute-force version, on rows that are awkward on purpose."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coffer.llm import bpe, decontaminate, markup, passages, pii, quality, simhash, suffixes, token_files, vectors
from coffer.llm.common import components

SCHEMA = "doc_id long, text string, lang string, id long, fp string, node string, chunk int, stats string, items int"
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ta", "ne", "ro", "Ki", "lu", "so"]) for _ in range(r.randint(1, 4)))
                    + r.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    shared = prose(2, 70)
    texts = [base, near, base, None, "", "one two three", " \t\n ", prose(3, 9000), "x" * 40000,
             prose(4, 30) + " " + shared + " " + prose(5, 40), prose(6, 20) + "\n" + shared, "Same. " * 400,
             "Same. " * 300, "héllo wörld ÅΣ 漢字 " * 30, base, prose(7, 200), shared + prose(8, 12), "a\x00b\x1cc\x85d"]
    return [(i * 7 % 31 if i < 17 else 1, t) for i, t in enumerate(texts)] + [(None, base), (3, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "f", "n", 2, "s", 3) for i, t in rows], SCHEMA).repartition(3)


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def plain_fingerprint(text):
    import xxhash
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_fingerprints_are_dealt_a_frame_a_tree(spark):
    values = np.random.default_rng(3).integers(0, 1 << 63, 400, dtype=np.uint64)
    trees = [simhash.VantageTree(values, 20, m, r) for m, r in simhash.bands(4)]
    pdf = pd.DataFrame({"fp": values.view(np.int64), "node": np.arange(400)})
    frames = list(simhash._routed(pdf, trees))
    assert [set(f["tree"]) for f in frames] == [{0}, {1}, {2}, {3}]
    for f, tree in zip(frames, trees):
        assert sorted(f["node"][f["home"]]) == list(range(400)) and (f["fp"] == values.view(np.int64)[f["node"]]).all()
        assert f.groupby("shard").size().to_dict() == {
            n: len(at) for n, _, at, _ in tree.reach(values, np.ones(400, bool)) if len(at)}


def test_simhash(docs, rows):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fingerprint"], r["component_id"])
                 for r in simhash.simhash_classes(docs).collect())
    fps = [plain_fingerprint(t) for _, t in rows]
    reach = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(len(rows)):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                low, high = sorted((reach[a], reach[b]))
                reach = [low if r == high else r for r in reach]
    want = sorted((i if i is not None else -1, f"{fps[k]:016x}",
                   min(j for m, (j, _) in enumerate(rows) if reach[m] == reach[k] and j is not None))
                  for k, (i, _) in enumerate(rows))
    assert got == want


def test_vantage_trees_lose_no_pair(spark):
    r = random.Random(5)
    values = {r.getrandbits(64) for _ in range(300)}
    for v in list(values)[:150]:
        for _ in range(3):
            values.add(v ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))))
    values = sorted(values)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)],
                                  "fp long, node long")
    got = {x["node"]: x["component"] for x in
           components(simhash.near_fingerprints(frame, per_shard=40)).collect()}
    reach = list(range(len(values)))
    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= 4 and reach[a] != reach[b]:
                low, high = sorted((reach[a], reach[b]))
                reach = [low if x == high else x for x in reach]
    assert [got.get(i, i) for i in range(len(values))] == reach


def plain_repeats(rows, length=50):
    seen, out = {}, {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for a in range(len(b) - length + 1):
            w = b[a:a + length]
            if i is not None and i < seen.get(w, 1 << 60):
                seen[w] = i
    for i, b in texts:
        gone = np.zeros(len(b) + 1, int)
        for a in range(len(b) - length + 1):
            if i is not None and seen[b[a:a + length]] < i:
                gone[a:a + length] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.setdefault(i, []).append((len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()),
                                      hashlib.sha256(kept).hexdigest(), kept))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeated_bytes(docs, rows, hot):
    got = {}
    for r in suffixes.repeated_bytes(docs, chunk_bytes=9000, hot_chunks=hot).collect():
        got.setdefault(r["doc_id"], []).append(
            (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])))
    assert {i: sorted(v) for i, v in got.items()} == plain_repeats(rows)


def test_suffix_classes_against_slices():
    r = random.Random(3)
    for _ in range(60):
        length = r.choice([8, 10, 17])
        strings = [bytes(r.choice(b"ab\x00c") for _ in range(r.randint(length, 40))) for _ in range(r.randint(1, 30))]
        strings = [s if r.random() < .5 else r.choice(strings)[:30] + b"ab" * length for s in strings]
        group = np.array([r.randint(0, 2) for _ in strings])
        got, want = {}, {}
        for i, o, k in zip(*suffixes.suffix_classes(strings, length, group)):
            got.setdefault(k, set()).add((i, o))
        for i, s in enumerate(strings):
            for o in range(len(s) - length + 1):
                want.setdefault((group[i], s[o:o + length]), set()).add((i, o))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_embedding_links(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 24))
    x[100:160] = x[7] + rng.standard_normal((60, 24)) * 0.12
    x[160:200] = x[7]
    x[200] = 3 * x[9]
    data = [(i, [float(v) for v in r], 1) for i, r in enumerate(x.astype(np.float32).astype(float))]
    bad = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [float("inf")] * 24]
    data += [(1000 + i, v, 2) for i, v in enumerate(bad)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, w int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in
           vectors.embedding_links(frame, bucket_rows=16).collect()}
    v = x.astype(np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = v @ v.T >= 0.95
    np.fill_diagonal(near, False)
    found = sum(got[i][0] for i in range(500))
    assert 0.97 * near.sum() <= found <= near.sum()
    assert all(got[i][0] <= near[i].sum() for i in range(500))
    assert all(got[1000 + i] == (0, 1000 + i, True) for i in range(len(bad)))
    assert all(got[i][1] == 7 for i in range(160, 200)) and got[200][1] == 9
    assert sum(k for *_, k in got.values()) == len({c for _, c, _ in got.values()})


def test_quality(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        t = prose(i, r.randint(30, 200))
        rows.append((i, t if good else " | ".join(t.split()) + "###"))
        labels.append((i, int(good), i % 2))
    rows += [(None, "lost"), (400, None), (401, ""), (5, rows[5][1])]
    labels += [(2, None, 0), (None, 1, 0), (1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("stats", F.lit(1))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.score_quality(docs, marks).collect()
    assert len(out) == len(rows)
    for x in out:
        assert 0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3)
        if x["doc_id"] is not None:
            assert x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0)
    held = [x for x in out if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 400]
    assert sum(x["predicted"] == int(x["doc_id"] % 3 != 0) for x in held) >= 0.95 * len(held)
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns
    blank = quality.score_quality(docs, marks.limit(0)).collect()
    assert {x["score"] for x in blank} == {0.5}


def test_contamination(spark, docs, rows):
    base = rows[0][1].split()
    items = [("10", " ".join(base[20:45])), ("9", "ONE, two"), ("8", None), ("7", ""), (None, rows[0][1]),
             ("6", "héllo wörld"), ("5", prose(50, 40)), ("5", "Same same"), ("4", rows[7][1])]
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("item", F.lit(1))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    want = []
    for i, t in rows:
        w, hit, found = word.findall(low(t)), set(), set()
        for item, x in items:
            iw = word.findall(low(x))
            n = min(10, len(iw))
            spans = {tuple(iw[a:a + n]) for a in range(len(iw) - n + 1)} if n and item else set()
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in spans:
                    hit |= set(range(a, a + n))
                    found.add(item)
        want.append((str(i), len(w), len(hit), sorted(found)))
    out = decontaminate.contamination(docs, bench).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in out) == sorted(want)
    assert all(sum(s["length"] for s in r["spans"]) == r["n_hit"] for r in out)
    clean = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert all(r["n_hit"] == 0 for r in clean) and len(clean) == len(rows)


@pytest.mark.parametrize("text", [
    "Hello's WORLD's café ÅΣΑΣ İstanbul \x1c a\x1fb \x85 y 1234 ½ ٣ 漢字かな!!! <|endoftext|>a", "a" * 3000,
    "ab" * 2500 + "!" * 700, "aaab" * 999, "", "\t\n\r", "the " * 500, "nono" * 800 + "ing " + "th" * 900])
def test_bpe_like_the_library(text):
    library = Tokenizer.from_file(WORD_FILE)
    library.no_truncation()
    library.no_padding()
    v = bpe.vocabulary(WORD_FILE)
    ids = library.encode(text, add_special_tokens=False).ids
    mine = np.frombuffer(v.encode(text), "<u4").tolist()
    assert mine == ids
    reader = bpe.TokenReader(v)
    pieces = [reader.feed(mine[a:a + 3]) for a in range(0, len(mine), 3)]
    assert "".join(pieces) == library.decode(ids, skip_special_tokens=False)
    words = bpe.TokenReader(v, joined=False)
    if text == "the " * 500:
        assert words.feed(mine) + words.finish() == text


def test_streaming_encoder_keeps_a_bounded_buffer():
    v = bpe.vocabulary(WORD_FILE)
    symbols = [v.symbol[b] for b in random.Random(1).choices(b"inge", k=9000)]
    encoder, out = bpe.WordEncoder(v.merges, v.lengths), []
    for s in symbols:
        out += encoder.push(s)
        assert len(encoder.wait) <= encoder.block + v.merges.lookahead
    assert out + encoder.finish() == v.merges.settle(symbols)


def test_encode_decode_columns(docs, rows):
    out = bpe.encode_decode(docs, WORD_FILE).collect()
    assert len(out) == len(rows)
    library = Tokenizer.from_file(WORD_FILE)
    for r in out:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == ids
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


PRIVATE = [
    (1, "Mail anna.b@mail4.example.com or ANNA.B@MAIL4.EXAMPLE.COM, call +1 (017) 555-7713 or +1 017 555 7713."),
    (2, "Card 4111 1111 1111 1111, 4111111111111111; ip 97.51.17.173! ssn 123-45-6789 a@b.example.org"),
    (3, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" Frau Clara Berg met Mr. Paul Stone and Mr. Paul Stone"),
    (4, None), (5, ""), (6, "nothing here, version 2.0, 12 apples"), (6, "nothing here, version 2.0, 12 apples"),
    (7, "Господин Иван Петров, DE44 5001 0517 5407 3249 31"), (None, "x" * 30000 + " 10.2.3.4")]


def test_personal_data(spark):
    docs = spark.createDataFrame(PRIVATE, "doc_id long, text string").withColumn("late", F.lit(1)).withColumn(
        "n_entities", F.lit("old"))
    out = {r["doc_id"]: r for r in pii.replace_personal_data(docs, key="k").collect()}
    assert len(out) == 8 and out[4]["text"] is None and out[4]["n_entities"] == 0 and out[5]["text"] == ""
    assert out[6]["text"] == PRIVATE[5][1] and out[6]["late"] == 1
    one = out[1]["text"]
    mails = re.findall(r"\S+@[^\s,]+", one)
    assert mails[0].upper() == mails[1] and "anna" not in one.lower() and mails[0].endswith(".com")
    assert len(mails[0]) == len("anna.b@mail4.example.com")
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\+1 \d{3} \d{3} \d{4}", one)
    assert len(phones) == 2 and len({re.sub(r"\D", "", p) for p in phones}) == 1 and "7713" not in one
    two = out[2]["text"]
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", two)
    assert cards[0].replace(" ", "") == cards[1] and pii._luhn(cards[1]) == 0 and cards[1] != "4" + "1" * 15
    assert not any(x in two for x in ("97.51.17.173", "123-45-6789", "a@b."))
    three = out[3]["text"]
    assert re.search(r"Frau [A-Z]\w+ [A-Z]\w+", three)[0].split()[1] in pii.GIVEN["f", "latin"]
    men = re.findall(r"Mr\. (\w+ \w+)", three)
    assert men[0] == men[1] and men[0].split()[0] in pii.GIVEN["m", "latin"] and "Stone" not in three
    assert re.search(r'token = "[0-9a-f]{40}"', three) and "24be6443" not in three
    assert re.match("Господин [А-Яа-яё]+ [А-Яа-яё]+, DE", out[7]["text"]) and "Иван Петров" not in out[7]["text"]
    again = {r["doc_id"]: r["text"] for r in pii.replace_personal_data(docs, key="k").collect()}
    other = {r["doc_id"]: r["text"] for r in pii.replace_personal_data(docs, key="z").collect()}
    assert again[1] == one and other[1] != one
    assert pii.replace_personal_data(docs.limit(0)).count() == 0


def test_surrogates_stay_distinct(spark):
    names = spark.createDataFrame([("ip", f"10.0.0.{i}") for i in range(40)], "kind string, canon string")
    out = pii.assign_surrogates(names, "k").collect()
    assert len({r["made"] for r in out}) == 40 and not {r["made"] for r in out} & {r["canon"] for r in out}
    # a format so narrow that surrogates clash and have to grow
    few = spark.createDataFrame([("secret", c) for c in "0123456789"], "kind string, canon string")
    out = pii.assign_surrogates(few, "k2").collect()
    assert len({r["made"] for r in out}) == 10 and not {r["made"] for r in out} & set("0123456789")


def test_compact_windows_against_definition():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, width = int(rng.integers(1, 60)), int(rng.integers(1, 9))
        v = rng.integers(0, 12, n).astype(np.uint64)
        got = set(zip(*(x.tolist() for x in passages.compact_windows(v, width))))
        want = set()
        for i in range(n):
            a = b = i
            while v[i] and a > 0 and v[a - 1] >= v[i]:
                a -= 1
            while v[i] and b < n - 1 and v[b + 1] >= v[i]:
                b += 1
            if v[i] and b - a + 1 >= width:
                want.add((a, a + int(np.flatnonzero(v[a:b + 1] == v[i])[0]), b))
        assert got == want


def test_passages(docs, rows):
    out = passages.near_passages(docs).collect()
    by = {}
    for r in out:
        assert r["other_id"] < r["doc_id"] and r["n_words"] >= 50 and r["similarity"] >= 0.8
        by.setdefault(r["doc_id"], set()).update(range(r["first_word"], r["first_word"] + r["n_words"]))
    ids = {t: [i for i, x in rows if x == t and i is not None] for _, t in rows if t}
    base = rows[0][1]
    copies = sorted(ids[base])
    assert all(len(by[i]) == 120 for i in copies[1:])
    near = [i for i, t in rows if t and "changed" in t][0]
    assert near == min([near, *copies]) or len(by[near]) >= 100
    a, b, c = (rows[k][0] for k in (9, 10, 16))
    assert [i in by for i in sorted((a, b, c))] == [False, True, True]
    clean = rows[15][0]
    assert clean not in by


HTML = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no</p>";</script><style>p{}</style></head>
<body><header>Site</header><nav><ul><li>Menu one</li></ul></nav><div class="ad">Buy now, it is cheap.</div>
<div class="cookie notice">We use cookies.</div><main><article><header><h1>Head&nbsp;line</h1></header>
<p>First  <b>bo</b>ld &amp; more text,\n with several words in it.<p>Second paragraph, unclosed.<br>After break
<ul><li>Item</li></ul><div class="comments">Nice!</div></article><aside>Side</aside></main>
<form>Mail<button>Go</button></form><footer>&copy; Foot.</footer></body></html>"""


def test_main_text(spark):
    text = "Head line First bold & more text, with several words in it. Second paragraph, unclosed. After break Item"
    rows = [(1, "u", HTML), (2, "u", None), (3, "u", ""), (4, "u", "<nav>only menu</nav>"), (4, "u", HTML),
            (None, None, "<p>plain &amp words"), (6, "v", "<article><p>" + "word, " * 40000 + "</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    out = [(r["page_id"], r["text"], r["n_chars"]) for r in markup.extract_main_text(pages).collect()]
    assert out[0] == (1, text, len(text)) and out[4] == (4, text, len(text))
    assert [o[1:] for o in out[1:4]] == [("", 0)] * 3
    assert out[5] == (None, "plain & words", 13)
    assert out[6][1] == ("word, " * 40000).strip()


LEAD = "A short lead."
BODY = " ".join(f"Sentence {i} of the body has words, commas and a full stop." for i in range(30))
MENU = "<div><a href=x>One</a> <a href=y>Two</a> <a href=z>Three</a></div>"


@pytest.mark.parametrize("html, text", [
    (f"<article><h1>Title</h1><p>{LEAD}</p><div class=body><p>{BODY}</p></div><p>The end.</p></article>",
     f"Title {LEAD} {BODY} The end."),
    (f"<main><section><p>{BODY}</p></section><section><p>Two lines, no more.</p></section></main>",
     f"{BODY} Two lines, no more."),
    (f"<article><p class=related-work>{BODY}</p><div class='side-by-side'><p>{BODY}</p></div>"
     f"<section id=notice><h2>Notice</h2><p>{BODY}</p></section></article>", f"{BODY} {BODY} Notice {BODY}"),
    (f"<article><p>{BODY}</p><div class='share-row-x'>Tell all</div><div class=comment-body><p>{BODY}</p></div>"
     f"<div class=ad>Buy now, it is cheap.</div></article>", BODY),
    (f"<body class='has-sidebar'>{MENU}<div><h1>Head</h1><div><p>{BODY}</p></div><div><p>{BODY}</p></div></div>"
     f"{MENU}</body>", f"Head {BODY} {BODY}"),
    (f"<div>{MENU}<p>{LEAD}</p><p>{BODY}</p>{MENU}</div>", f"{LEAD} {BODY}"),
    (f"<article><p>{BODY}</p></article><article><p>{BODY}</p></article><article><p>{BODY}</p></article>",
     f"{BODY} {BODY} {BODY}"),
    (f"<article><p>{BODY}</p><article class=comment><p>{BODY}</p></article></article>", BODY),
    ("<div class=ad-x>few</div>", "few")])
def test_articles_are_kept_whole(html, text):
    assert markup.main_text(html) == text


def test_main_text_of_no_pages(spark):
    out = markup.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string"))
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == 0


def test_coder_round_trip():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 255, 256, 5000, 40000):
        for ids in (rng.integers(0, 50257, n), np.minimum(rng.zipf(1.3, n), 50000), np.full(n, 7)):
            lanes = token_files._lanes_of(n)
            data = token_files.encode_ids(ids.astype("<u4"), 50257)
            assert (token_files.decode_ids(data, n, lanes, 50257) == ids).all()
    block = token_files.write_block([3, 9], [np.array([1, 2], "<u4"), np.array([0], "<u4")], 5, 50257)
    assert read_parts(block) == ([3, 9], [2, 1], [1, 2, 0], 5)
    with pytest.raises(ValueError):
        token_files.read_block(block[:20] + bytes([block[20] ^ 1]) + block[21:])


def read_parts(block):
    ids, sizes, tokens, before = token_files.read_block(block)
    return ids.tolist(), sizes.tolist(), tokens.tolist(), before


def test_token_files(docs, rows):
    blocks = token_files.write_token_files(docs, BYTE_FILE, block_ids=5000)
    out = token_files.read_token_files(blocks).collect()
    library = Tokenizer.from_file(BYTE_FILE)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    at, want = 0, []
    for i, t in order:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, (r[:4] for r in out)), key=lambda r: r[1]) == want


@pytest.mark.parametrize("apply", [
    simhash.simhash_classes, suffixes.repeated_bytes, passages.near_passages,
    lambda d: decontaminate.contamination(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    lambda d: bpe.encode_decode(d, WORD_FILE), pii.replace_personal_data,
    lambda d: quality.score_quality(d, d.select("doc_id", F.lit(1).alias("quality"))),
    lambda d: token_files.read_token_files(token_files.write_token_files(d, BYTE_FILE)),
    lambda d: vectors.embedding_links(d.select(F.col("doc_id").alias("vec_id"),
                                               F.array(F.lit(1.0)).alias("embedding")))])
def test_empty_tables(docs, apply):
    assert apply(docs.limit(0)).count() == 0
