"""Token ids in a compact block format: context mixing and range coding in many lanes.

A block holds whole documents.  Its ids are cut into lanes of equal length that are coded
side by side, each with a range coder of its own, all with one adaptive model.  The model
starts anew in every block, so a block is read without any other; a checksum guards it.

Layout of a block, little endian: magic ``CMX1``; counts of documents, ids, lanes and symbols
(four uint32); CRC-32 of the ids (uint32); ids in the file before it (uint64); document ids
(int64 each) and lengths (uint32 each); words per lane (uint32 each); the lanes' words
(uint32).  Blocks are rows of Parquet files, one file series per range of document ids, so
Spark's committer deals with lost and repeated tasks.
"""

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import packed
from .common import Recent, materialize, small_batches

MAGIC = b"CMX1"
HEAD = struct.Struct("<4s5IQ")
LANES = 4096
BLOCK_IDS = 1 << 22
STATES = 16
U = np.uint64
_M32 = U((1 << 32) - 1)
_FLOOR = U(1 << 32)
_SLOTS = 1 << 20
NO_ID = -(1 << 63)

# Probabilities have 12 bits.  ``SQUASH`` maps a mixed score to one by x / (K + |x|), and
# ``STRETCH`` is its inverse; integers only, so every machine computes the same.
_K = 1024
_SPAN = 65536
_scores = np.arange(-_SPAN, _SPAN + 1, dtype=np.int64)
SQUASH = np.clip(2048 + 2048 * _scores // (_K + np.abs(_scores)), 16, 4080)
_p = np.clip(np.arange(4097, dtype=np.int64) - 2048, -2032, 2032)
STRETCH = _p * _K // (2048 - np.abs(_p))


class _Model:
    """Predictions of the next id in each lane from the last two, the last one, and none."""

    def __init__(self, lanes, symbols):
        self.next2 = np.zeros(_SLOTS, np.int32)
        self.sure2 = np.zeros(_SLOTS, np.int8)
        self.next1 = np.zeros(symbols, np.int32)
        self.sure1 = np.zeros(symbols, np.int8)
        self.first = np.full(STATES, 2048, np.int64)
        self.second = np.full(2 * STATES, 2048, np.int64)
        self.other = np.full(STATES, 1024, np.int64)
        self.weights = [32768, 32768]
        self.count = np.ones(symbols, np.int64)
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)
        self.steps = 0
        self._sum()

    def _sum(self):
        if int(self.count.sum()) > 1 << 24:
            self.count = (self.count + 1) >> 1
        self.below = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.count)))

    def predict(self):
        self.slot = ((self.before * 0x9E3779B1 + self.last * 0x85EBCA6B) >> 7) & (_SLOTS - 1)
        self.v2, self.k2 = self.next2[self.slot], self.sure2[self.slot]
        self.v1, self.k1 = self.next1[self.last], self.sure1[self.last]
        self.guess = np.where(self.k2 > 0, self.v2, self.v1)
        self.state1 = self.k1 * np.int8(2) + (self.v1 == self.guess)
        self.s2, self.s1 = STRETCH[self.first[self.k2]], STRETCH[self.second[self.state1]]
        score = (self.weights[0] * self.s2 + self.weights[1] * self.s1) >> 15
        self.p = SQUASH[np.clip(score, -_SPAN, _SPAN) + _SPAN]
        return self.p

    @staticmethod
    def _learn(table, state, hit):
        n = np.bincount(state, minlength=len(table))
        hits = np.bincount(state[hit], minlength=len(table))
        table += ((hits * 4096 // np.maximum(n, 1)) - table) * np.minimum(n, 16) >> 5
        np.clip(table, 16, 4080, out=table)

    def update(self, symbol, hit, tried, matched, literal):
        self._learn(self.first, self.k2, hit)
        self._learn(self.second, self.state1, hit)
        if len(tried):
            self._learn(self.other, self.k1[tried], matched)
        error = (hit.astype(np.int64) << 12) - self.p
        for i, s in enumerate((self.s2, self.s1)):
            step = int((error * s).sum()) // len(symbol) >> 8
            self.weights[i] = min(max(self.weights[i] + step, 0), 1 << 18)
        for table, sure, at, value, k in ((self.next2, self.sure2, self.slot, self.v2, self.k2),
                                          (self.next1, self.sure1, self.last, self.v1, self.k1)):
            right = value == symbol
            keep = right | (k >= 4)
            table[at] = np.where(keep, value, symbol)
            sure[at] = np.where(right, np.minimum(k + 1, STATES - 1), np.where(keep, k >> 1, 1))
        np.add.at(self.count, literal, 24)
        self.before, self.last = self.last, symbol
        self.steps += 1
        if self.steps % 32 == 0 or self.steps in (1, 2, 4, 8, 16):
            self._sum()


class _Writer:
    def __init__(self, lanes, steps):
        self.low, self.range = np.zeros(lanes, U), np.full(lanes, U(0xFFFFFFFFFFFFFFFF))
        self.words = np.zeros((lanes, 64), np.uint32)
        self.used = np.zeros(lanes, np.int64)

    def put(self, lanes, low, size, total_bits=None, total=None):
        """Narrow the lanes to [low, low + size) of a total."""
        r = self.range[lanes]
        unit = r >> total_bits if total is None else r // total
        self.low[lanes] += unit * low
        self.range[lanes] = unit * size
        self._shift(lanes)

    def _shift(self, lanes):
        go = self.range[lanes] < _FLOOR
        if go.any():
            at = lanes[go] if isinstance(lanes, np.ndarray) else np.flatnonzero(go)
            low = self.low[at]
            self._emit(at, low >> U(32))
            rest = low & _M32
            # an interval that spans two words is cut at the border
            self.range[at] = np.minimum(self.range[at], _FLOOR - rest) << U(32)
            self.low[at] = rest << U(32)

    def _emit(self, at, word):
        used = self.used[at]
        if used.max() >= self.words.shape[1]:
            self.words = np.concatenate((self.words, np.zeros_like(self.words)), 1)
        self.words[at, used] = word
        self.used[at] = used + 1

    def finish(self):
        every = np.arange(len(self.low))
        self._emit(every, self.low >> U(32))
        self._emit(every, self.low & _M32)
        inside = np.arange(self.words.shape[1])[None, :] < self.used[:, None]
        return self.used.astype("<u4").tobytes() + self.words[inside].astype("<u4").tobytes()


class _Reader:
    def __init__(self, data, lanes):
        used = np.frombuffer(data, "<u4", lanes).astype(np.int64)
        self.words = np.concatenate((np.frombuffer(data, "<u4", offset=4 * lanes), [0, 0])).astype(U)
        self.at = np.concatenate(([0], np.cumsum(used)[:-1]))
        self.low, self.range = np.zeros(lanes, U), np.full(lanes, U(0xFFFFFFFFFFFFFFFF))
        self.code = (self.words[self.at] << U(32)) | self.words[self.at + 1]
        self.at += 2

    def target(self, lanes, total_bits=None, total=None):
        r = self.range[lanes]
        self.unit = r >> total_bits if total is None else r // total
        return (self.code[lanes] - self.low[lanes]) // self.unit

    def take(self, lanes, low, size):
        self.low[lanes] += self.unit * low
        self.range[lanes] = self.unit * size
        go = self.range[lanes] < _FLOOR
        if go.any():
            at = lanes[go] if isinstance(lanes, np.ndarray) else np.flatnonzero(go)
            rest = self.low[at] & _M32
            self.range[at] = np.minimum(self.range[at], _FLOOR - rest) << U(32)
            self.low[at] = rest << U(32)
            self.code[at] = (self.code[at] << U(32)) | self.words[self.at[at]]
            self.at[at] += 1


_BITS = U(12)
_EVERY = slice(None)


def _lanes_of(n):
    return max(1, min(LANES, n // 256))


def encode_ids(ids, symbols):
    """Coded lanes of an id array."""
    lanes = _lanes_of(len(ids))
    steps = -(-len(ids) // lanes)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model, out = _Model(lanes, symbols), _Writer(lanes, steps)
    for symbol in grid:
        p = model.predict().astype(U)
        hit = model.guess == symbol
        out.put(_EVERY, np.where(hit, U(0), p), np.where(hit, p, U(4096) - p), _BITS)
        rest = np.flatnonzero(~hit)
        open_ = model.v1[rest] != model.guess[rest]
        tried = rest[open_]
        matched = model.v1[tried] == symbol[tried]
        if len(tried):
            q = model.other[model.k1[tried]].astype(U)
            out.put(tried, np.where(matched, U(0), q), np.where(matched, q, U(4096) - q), _BITS)
        plain = np.sort(np.concatenate((rest[~open_], tried[~matched])))
        literal = symbol[plain]
        if len(plain):
            low = model.below[literal]
            out.put(plain, low.astype(U), (model.below[literal + 1] - low).astype(U),
                    total=U(model.below[-1]))
        model.update(symbol, hit, tried, matched, literal)
    return out.finish()


def decode_ids(data, n, lanes, symbols):
    """Ids of coded lanes."""
    steps = -(-n // lanes) if n else 0
    grid = np.zeros((steps, lanes), np.int64)
    model, source = _Model(lanes, symbols), _Reader(data, lanes)
    for step in range(steps):
        p = model.predict().astype(U)
        hit = source.target(_EVERY, _BITS) < p
        source.take(_EVERY, np.where(hit, U(0), p), np.where(hit, p, U(4096) - p))
        symbol = model.guess.astype(np.int64)
        rest = np.flatnonzero(~hit)
        open_ = model.v1[rest] != model.guess[rest]
        tried = rest[open_]
        matched = np.zeros(0, bool)
        if len(tried):
            q = model.other[model.k1[tried]].astype(U)
            matched = source.target(tried, _BITS) < q
            source.take(tried, np.where(matched, U(0), q), np.where(matched, q, U(4096) - q))
            symbol[tried[matched]] = model.v1[tried[matched]]
        plain = np.sort(np.concatenate((rest[~open_], tried[~matched])))
        literal = np.zeros(0, np.int64)
        if len(plain):
            value = source.target(plain, total=U(model.below[-1])).astype(np.int64)
            literal = np.searchsorted(model.below, value, "right") - 1
            low = model.below[literal]
            source.take(plain, low.astype(U), (model.below[literal + 1] - low).astype(U))
            symbol[plain] = literal
        grid[step] = symbol
        model.update(symbol, hit, tried, matched, literal)
    return grid.T.ravel()[:n].astype("<u4")


def write_block(doc_ids, id_arrays, before, symbols):
    """One block of whole documents."""
    ids = np.concatenate([np.zeros(0, "<u4"), *id_arrays])
    lanes = _lanes_of(len(ids))
    head = HEAD.pack(MAGIC, len(doc_ids), len(ids), lanes, symbols, zlib.crc32(ids.tobytes()), before)
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(),
                     np.array([len(a) for a in id_arrays], "<u4").tobytes(), encode_ids(ids, symbols)])


def read_block(data):
    """(document ids, lengths, ids, ids in the file before it); checks the checksum."""
    magic, docs, n, lanes, symbols, crc, before = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = HEAD.size
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    lengths = np.frombuffer(data, "<u4", docs, at + 8 * docs).astype(np.int64)
    ids = decode_ids(data[at + 12 * docs:], n, lanes, symbols)
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a block of token ids is damaged")
    return doc_ids, lengths, ids, before


class _ByteEncoder:
    """Ids of whole texts by the library, one lookup per chunk between single spaces.

    A piece never runs from a letter over a space, so text may be cut before a space that
    has no white space on either side.
    """

    def __init__(self, path, limit=1 << 18):
        self.library, self.known = Tokenizer.from_file(path), Recent(limit)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.symbols = self.library.get_vocab_size()

    def _whole(self, text):
        return packed(self.library.encode(text, add_special_tokens=False).ids)

    def encode(self, text):
        if any(s in text for s in self.special):
            return self._whole(text)
        parts = text.split(" ")
        chunks = [parts[0]]
        for part in parts[1:]:
            if part and chunks[-1] and not part[0].isspace() and not chunks[-1][-1].isspace():
                chunks.append(" " + part)
            else:
                chunks[-1] += " " + part
        known, out = self.known, []
        for c in chunks:
            ids = known.young.get(c)
            if ids is None:
                ids = known.get(c)
            if ids is None:
                ids = self._whole(c)
                if len(c) <= 48:
                    known.put(c, ids)
            out.append(ids)
        return b"".join(out)


_ENCODERS = {}


def _encoder(path):
    if path not in _ENCODERS:
        _ENCODERS[path] = _ByteEncoder(path)
    return _ENCODERS[path]


def write_token_files(docs, path, end_id=0, id_col="doc_id", text_col="text", block_ids=BLOCK_IDS):
    """Encode whole texts, add ``end_id`` to each, write blocks in ascending id order.

    Returns the written blocks ``(part, block, first_id, block_bytes)``.  Null and empty texts
    give the end id alone; rows of equal id stay apart, in order of their text; rows without
    an id come first; an empty table gives no block.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def code(batches):
        encoder, part = _encoder(path), TaskContext.get().partitionId()
        ids, arrays, held, before, number = [], [], 0, 0, 0
        end = np.array([end_id], "<u4").tobytes()

        def block():
            return pd.DataFrame({"part": [part], "block": [number], "first_id": [ids[0]],
                                 "n_ids": [held], "block_bytes": [
                                     write_block(ids, arrays, before, encoder.symbols)]})

        for pdf in batches:
            for i, t in zip(pdf["id"], pdf["text"]):
                a = np.frombuffer(encoder.encode(t) + end, "<u4")
                ids.append(i)
                arrays.append(a)
                held += len(a)
                if held >= block_ids:
                    yield block()
                    before, number = before + held, number + 1
                    ids, arrays, held = [], [], 0
        if ids:
            yield block()

    dealt = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return materialize(dealt.mapInPandas(
        code, "part int, block int, first_id long, n_ids long, block_bytes binary"))


def read_token_files(blocks, id_col="doc_id"):
    """Documents of written blocks: id, ``start``, ``n_tokens``, ``ids_crc32``, ``token_ids``.

    ``start`` counts the ids of all documents before.  Parts follow each other in id order;
    one number per part, as many as the range partitions of the writer, gives their places.
    """
    spark = blocks.sparkSession
    totals = {r["part"]: r["n"] for r in
              blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    place, at = {}, 0
    for part in sorted(totals):
        place[part], at = at, at + totals[part]
    small_batches(spark, 1)

    def decode(batches):
        for pdf in batches:
            for part, data in zip(pdf["part"], pdf["block_bytes"]):
                doc_ids, lengths, ids, before = read_block(data)
                ends = np.cumsum(lengths)
                raw = ids.tobytes()
                for a in range(0, len(doc_ids), 1000):
                    some = range(a, min(a + 1000, len(doc_ids)))
                    own = [raw[4 * (ends[i] - lengths[i]):4 * ends[i]] for i in some]
                    yield pd.DataFrame({
                        "id": doc_ids[some], "n_tokens": lengths[some],
                        "start": place[part] + before + ends[some] - lengths[some],
                        "ids_crc32": [zlib.crc32(o) for o in own], "token_ids": own})

    return blocks.select("part", "block_bytes").mapInPandas(
        decode, "id long, n_tokens long, start long, ids_crc32 long, token_ids binary").select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "start", "n_tokens", "ids_crc32",
        "token_ids")
