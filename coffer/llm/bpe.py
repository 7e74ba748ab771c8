"""BPE by a streaming transducer with bounded lookahead, and decoding by a state machine."""

import codecs
import heapq
import json
import sys
import unicodedata
from array import array
from itertools import repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType
from tokenizers import Regex as TokenizerRegex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import Split

from .common import Recent, small_batches

CACHE = 1 << 17
CACHED_LENGTH = 48
NEVER = 1 << 60


def byte_letters():
    """The letter that stands for each byte: itself if printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return letters


def packed(ids):
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Merges:
    """A merge list over symbol ids, and how far a decision can depend on what follows.

    ``lookahead`` bounds, in letters, how much of a text's end can still change when more
    text follows.  Where two continuations differ, the difference moves left only when a
    merge takes the token before it: rule r moves it by the length of r's left side, and the
    next rule that moves it has a higher rank and a right side that begins with that left
    side.  The longest such chain is the bound, found in one pass over the list.
    """

    def __init__(self, vocab, merges):
        self.rank, self.made, reach = {}, [], {}
        bound = longest = 0
        for rank, (a, b) in enumerate(merges):
            self.rank.setdefault((vocab[a], vocab[b]), rank)
            self.made.append(vocab[a + b])
            here = max((reach.get(b[:i], 0) for i in range(1, len(b) + 1)), default=0) + len(a)
            if here > reach.get(a, 0):
                reach[a] = here
            bound = max(bound, here)
            longest = max(longest, len(a) + len(b))
        self.lookahead = bound + longest

    def settle(self, ids):
        """Apply the merges to a list of symbols, lowest rank first, then leftmost."""
        if len(ids) > 64:
            return self._settle_long(ids)
        get, made, ids = self.rank.get, self.made, list(ids)
        waiting = list(map(get, zip(ids, ids[1:]), repeat(NEVER)))
        while waiting and (low := min(waiting)) != NEVER:
            i = waiting.index(low)
            del waiting[i], ids[i]
            ids[i] = new = made[low]
            if i < len(waiting):
                waiting[i] = get((new, ids[i + 1]), NEVER)
            if i:
                waiting[i - 1] = get((ids[i - 1], new), NEVER)
        return ids

    def _settle_long(self, ids):
        rank, n = self.rank, len(ids)
        ids = list(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            low, i, p = heapq.heappop(heap)
            j = right[i]
            if ids[i] is None or j < 0 or (ids[i], ids[j]) != p:
                continue
            ids[i], ids[j] = self.made[low], None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (q := (ids[a], ids[b])) in rank:
                    heapq.heappush(heap, (rank[q], a, q))
        return [x for x in ids if x is not None]


class WordEncoder:
    """Streaming encoder of one piece: symbols go in, tokens come out once they are stable.

    It keeps at most a block and the lookahead.  A token that ends more than the lookahead
    before the last symbol seen can't change; what follows a stable token is encoded as if
    it stood alone, because no merge crosses a token's edge.
    """

    def __init__(self, merges, lengths, block=256):
        self.merges, self.lengths, self.block, self.wait = merges, lengths, block, []

    def push(self, symbol):
        self.wait.append(symbol)
        if len(self.wait) < self.block + self.merges.lookahead:
            return []
        tokens, end, take = self.merges.settle(self.wait), 0, 0
        for t in tokens:
            if end + self.lengths[t] > len(self.wait) - self.merges.lookahead:
                break
            end += self.lengths[t]
            take += 1
        self.wait = self.wait[end:]
        return tokens[:take]

    def finish(self):
        out, self.wait = self.merges.settle(self.wait), []
        return out


class Vocabulary:
    """A vocabulary file with word-end marks: text to ids and back."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = dict(model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        self.merges = Merges(vocab, [m if isinstance(m, list) else m.split(" ") for m in model["merges"]])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile(
            "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        letters = byte_letters()
        self.symbol = [vocab.get(letters[b]) for b in range(256)]
        self.last = [vocab.get(letters[b] + self.end) for b in range(256)]
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.lengths = {i: len(t) - len(self.end) * t.endswith(self.end) if self.end else len(t)
                        for i, t in self.tokens.items()}
        self.bytes_of = {c: b for b, c in letters.items()}
        self.library = Tokenizer.from_file(path)
        self.splitter = Split(TokenizerRegex(split["pattern"]["Regex"]), "removed", invert=True)
        self.cache, self.words = Recent(CACHE), Recent(CACHE)
        self.spaced = {i: " " + t for i, t in self.tokens.items()}

    def word(self, piece):
        """Ids of one piece as bytes, through the streaming encoder."""
        known = self.words.young.get(piece)
        if known is None:
            known = self.words.get(piece)
        if known is not None:
            return known
        raw = piece.encode("utf-8")
        symbols = [self.symbol[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        symbols = [s for s in symbols if s is not None]
        if len(symbols) <= CACHED_LENGTH:  # the encoder would hold them all until the end
            out = self.merges.settle(symbols)
        else:
            encoder, out = WordEncoder(self.merges, self.lengths), []
            for s in symbols:
                out += encoder.push(s)
            out += encoder.finish()
        out = packed(out)
        if len(piece) <= CACHED_LENGTH:
            self.words.put(piece, out)
        return out

    def split(self, text):
        """Normalised pieces; beyond Latin letters by the library's own character tables."""
        if max(text) < "\u02b0":
            normal = unicodedata.normalize("NFC", text).lower()
            if normal.isalpha():
                return [normal]
            if normal[-1] in ",." and normal[:-1].isalpha():
                return [normal[:-1], normal[-1]]
            return self.pieces.findall(normal)
        normal = self.library.normalizer.normalize_str(text)
        return [s for s, _ in self.splitter.pre_tokenize_str(normal)]

    def chunk(self, text):
        """Ids (as little-endian 32-bit bytes) of a chunk that spaces bound on both sides."""
        out = self.cache.get(text)
        if out is None:
            out = b"".join([self.word(p) for p in self.split(text)])
            if len(text) <= CACHED_LENGTH:
                self.cache.put(text, out)
        return out

    def plain(self, text):
        cache, chunk = self.cache, self.chunk
        # a line break parts pieces just as a space does
        return b"".join([c if (c := cache.young.get(w)) is not None else chunk(w)
                         for w in text.replace("\n", " ").split(" ") if w])

    def encode(self, text):
        """Ids of a whole text as bytes; special tokens in the text count as such."""
        if not any(s in text for s in self.special):
            return self.plain(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [self.plain(text[at:m.start()]), packed([self.special[m[0]]])]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


class TokenReader:
    """State machine from ids to text, a run of ids at a time.

    ``joined``: tokens with a space between, as the library decodes without a decoder.
    Otherwise the words themselves: token bytes run through an incremental UTF-8 decoder that
    holds back an unfinished character, word ends become spaces.
    """

    def __init__(self, vocabulary, joined=True):
        self.v, self.joined, self.begun = vocabulary, joined, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids):
        """Text that the next ids make certain."""
        if self.joined:
            known = self.v.spaced
            text = "".join([known[i] for i in ids if i in known])
            if text and not self.begun:
                self.begun, text = True, text[1:]
            return text
        return "".join(map(self._word, ids))

    def _word(self, token_id):
        token = self.v.tokens.get(token_id)
        if token is None:
            return ""
        if token in self.v.special:
            return self.utf8.decode(b"", True) + token
        ended = bool(self.v.end) and token.endswith(self.v.end)
        body = token[:len(token) - len(self.v.end)] if ended else token
        text = self.utf8.decode(bytes(self.v.bytes_of[c] for c in body))
        return text + self.utf8.decode(b"", True) + " " if ended else text

    def finish(self):
        return "" if self.joined else self.utf8.decode(b"", True)


_LOADED = {}


def vocabulary(path):
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode_column(text, path):
    """Token ids of a text column as little-endian 32-bit binary; null counts as empty."""

    @F.pandas_udf(BinaryType())
    def encode(texts: pd.Series) -> pd.Series:
        v = vocabulary(path)
        return pd.Series([v.encode(t or "") for t in texts], dtype=object)

    return encode(text)


def decode_column(ids, path, joined=True):
    """Text of token ids, by the incremental reader."""

    @F.pandas_udf(StringType())
    def decode(rows: pd.Series) -> pd.Series:
        v, out = vocabulary(path), []
        for row in rows:
            reader = TokenReader(v, joined)
            ids = np.frombuffer(row, "<u4")
            out.append("".join([reader.feed(ids[a:a + 65536].tolist())
                                for a in range(0, len(ids), 65536)]) + reader.finish())
        return pd.Series(out, dtype=object)

    return decode(ids)


def encode_decode(docs, path, text_col="text"):
    """All columns, with ``token_ids`` (binary) and ``decoded`` in place of older ones of that name.

    Map-only; null and empty texts have no ids and an empty decoded text; texts of any length
    go through whole.  Repeated rows stay, an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    coded = docs.withColumn("token_ids", encode_column(F.col(text_col), path))
    return coded.withColumn("decoded", decode_column(F.col("token_ids"), path))
