"""Merge lists run by rank of the merged bytes, equal to the tokenizers library's ids.

``tiktoken`` merges any two neighbours whose bytes together have a rank; a merge list names
the two sides as well.  Both give the same ids when every token, spelt out alone, is put
together by its own rule: neighbours that make up a token's bytes have been merged exactly as
in that token alone, since nothing crossed its ends.  :func:`Ranked` checks this for every
rule and leaves out tokens that can never come about.
"""

import json
import re
import unicodedata
from functools import cache

import numpy as np
import regex
import tiktoken
from tokenizers import Regex as TokenizerRegex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import Split

from .bpe import Merges, byte_letters

END = "\0"  # closes a word in vocabularies with word-end marks
LONG = 20_000  # longer runs without a break go to the library


@cache
def unsettled():
    """Matches a character whose class may depend on the version of the character tables.

    Letters, digits and spaces that Unicode 3.2 knew have kept their classes.
    """
    old, ranges = unicodedata.ucd_3_2_0, []
    for c in map(chr, range(0x110000)):
        was, now = old.category(c), unicodedata.category(c)
        if was != "Cn" and (was[0] == now[0] or not {was[0], now[0]} & set("LNZ")):
            if ranges and ord(ranges[-1][1]) + 1 == ord(c):
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return re.compile("[^" + "".join(f"{re.escape(a)}-{re.escape(b)}" for a, b in ranges) + "]")


class Ranked:
    """Ids of whole texts for a vocabulary file of the tokenizers library.

    ``plain_special``: strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path, plain_special=False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        bytes_of = {c: b for b, c in letters.items()}
        rules = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]

        def spelt(token):
            ended = bool(end) and token.endswith(end)
            body = token[:len(token) - len(end)] if ended else token
            return bytes([bytes_of[c] for c in body]) + END.encode() * ended

        def symbols(raw):
            if raw[-1:] == END.encode() and end:
                return [vocab[letters[b]] for b in raw[:-2]] + [vocab[letters[raw[-2]] + end]]
            return [vocab[letters[b]] for b in raw]

        merges, ranks, ids = Merges(vocab, rules), {}, []

        def rank(raw, token):
            if raw not in ranks:
                ranks[raw] = len(ids)
                ids.append(vocab.get(token, -1))

        for b in range(256):
            rank(bytes([b]), letters[b])
        if end:
            for b in range(256):
                rank(bytes([b]) + END.encode(), letters[b] + end)
        for a, b in rules:
            raw = spelt(a + b)
            if merges.settle(symbols(raw)) == [vocab[a + b]]:
                rank(raw, a + b)
        self.ids = np.array(ids, np.int64)
        self.sizes = np.array([len(raw) for raw in ranks], np.int64)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = plain_special
        self.special = [] if plain_special else [t["content"] for t in spec["added_tokens"]]
        self.words = bool(end)
        if self.words:
            split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
            self.pieces = regex.compile(split["pattern"]["Regex"])
            self.splitter = Split(TokenizerRegex(split["pattern"]["Regex"]), "removed", invert=True)
            pattern = f"[^{END}]+{END}"
        else:  # the usual byte-level split
            pattern = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.coder = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.long = re.compile(rf"\S{{{LONG}}}|\s{{{LONG}}}")

    def _whole(self, text):
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)

    def regular(self, text):
        """Whether the ranks give the library's ids; other texts go to the library."""
        return not (any(s in text for s in self.special) or len(text) > LONG and self.long.search(text)
                    or self.words and END in text or not text.isascii() and unsettled().search(text))

    def runs(self, strings):
        """Ids of strings that may stand next to each other, and where each string's ids end."""
        joined = "".join(strings)
        coded = np.array(self.coder._core_bpe.encode_ordinary(joined), np.int64)
        sizes = np.fromiter(map(len, strings) if joined.isascii() else
                            (len(s.encode()) for s in strings), np.int64, len(strings))
        ends = np.searchsorted(np.cumsum(self.sizes[coded]), np.cumsum(sizes), "right")
        return self.ids[coded], ends

    def closed(self, text):
        """Lower-case pieces of a text, each closed by the end mark.

        Characters above U+02AF are lower-cased and composed by the library's own tables.
        """
        if text.isascii() or max(text) < "\u02b0":
            low = text.lower()
            if low.isascii() and low.isalpha():
                return low + END
            pieces = self.pieces.findall(low)
        else:
            normal = self.library.normalizer.normalize_str(text)
            pieces = [s for s, _ in self.splitter.pre_tokenize_str(normal)]
        return END.join(pieces) + END if pieces else ""


class Chunks:
    """A bounded memory of what became of chunks of text, filled for many chunks at a time."""

    def __init__(self, make, limit=1 << 18, longest=48):
        self.make, self.limit, self.longest = make, limit, longest
        self.young, self.old = {}, {}

    def fill(self, chunks):
        """Have every chunk of a set in ``young``."""
        missing = chunks.difference(self.young)
        if len(self.young) + len(missing) > self.limit:
            self.old, self.young = self.young, {}
            missing = chunks
        fresh = []
        for c in missing:
            known = self.old.get(c)
            if known is None:
                fresh.append(c)
            else:
                self.young[c] = known
        if fresh:
            self.young.update(zip(fresh, self.make(fresh)))
        return [c for c in fresh if len(c) > self.longest]

    def drop(self, chunks):
        for c in chunks:
            self.young.pop(c, None)


class WordCoder:
    """Ids of whole texts, as bytes, for a vocabulary that closes words and drops white space."""

    def __init__(self, path):
        self.ranked = ranked(path)
        self.memory = Chunks(self._make)

    def _make(self, chunks):
        closed = [self.ranked.closed(c) for c in chunks]
        ids, ends = self.ranked.runs(closed)
        raw, out, at = packed(ids), [], 0
        for end in (4 * ends).tolist():
            out.append(raw[at:end])
            at = end
        return out

    def encode(self, texts):
        """Ids of each text as little-endian 32-bit bytes; memory is bounded by the texts."""
        split = [t.replace("\n", " ").split(" ") if self.ranked.regular(t) else None for t in texts]
        once = self.memory.fill(set().union(*filter(None, split)))
        known = self.memory.young.__getitem__
        out = [packed(self.ranked._whole(t)) if parts is None else b"".join(map(known, parts))
               for t, parts in zip(texts, split)]
        self.memory.drop(once)
        return out


def in_groups(texts, size=1 << 22):
    """Runs ``(first, last)`` of texts with about ``size`` characters each."""
    first = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def packed(ids):
    """Ids as little-endian unsigned 32-bit integers."""
    return ids.astype("<u4").tobytes()


@cache
def ranked(path, plain_special=False):
    return Ranked(path, plain_special)


@cache
def word_coder(path):
    return WordCoder(path)
