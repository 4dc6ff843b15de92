"""Token ids by the tokenizers library, with the ids of each word kept between texts.

A tokenizer that splits a text into words first and then encodes each word by itself gives a
text's ids as the concatenation of its words' ids. For the two splitting rules below (that of
byte-level BPE, and that of lower-cased BPE with word ends) the words of texts over a plain Latin
alphabet are found here by byte classes, in numpy, many texts at once. Each new word is encoded once
by the library (by its model alone, where the steps before it leave a word as it is), and ids are gathered from a table. A hash only says where in the table a word may
be: a word is taken for a known one if its length and all its bytes are equal. Words of more than
LONGEST bytes, and those whose place another word of equal hash has, are encoded anew in each slice.
Any other text, and any other tokenizer file, goes to the library whole. Both ways give the same
ids; the tests compare them.
"""

from __future__ import annotations

import json
import os
import re

#: Letters of the plain alphabet (Latin-1 and Latin Extended A and B, all of category L,
#: without the one whose lower case has two characters). In UTF-8 all their bytes are 0x80 or more, or ASCII letters.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
PLAIN = re.compile(f"[^\t\n\r\x20-\x7e{LETTERS}]")
LETTER, DIGIT, OTHER, SPACE = range(4)
#: The character that stands for each byte in byte-level vocabularies: itself where it is visible, else one from 256 on.
SEEN = {*range(33, 127), *range(161, 173), *range(174, 256)}
CHARACTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in SEEN)}
#: Bytes of a word that the table may keep.
LONGEST = 256

_encoders: dict[str, "Encoder"] = {}


def _masks():
    import numpy as np

    return np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _classes():
    import numpy as np

    out = np.full(256, OTHER, dtype=np.uint8)
    for lo, hi, kind in ((65, 91, LETTER), (97, 123, LETTER), (128, 256, LETTER), (48, 58, DIGIT)):
        out[lo:hi] = kind
    out[[9, 10, 13, 32]] = SPACE
    return out


class Words:
    """Words as stretches of bytes in one buffer: their first 16 bytes as numbers, and a hash of all of them."""

    def __init__(self, data, starts, sizes):
        import numpy as np

        self.masks = _masks()
        padded = np.zeros(len(data) + 16, np.uint8)
        padded[: len(data)] = data
        #: eight bytes from each place on
        self.eights = np.ndarray(len(data) + 9, "<u8", padded, 0, (1,))
        self.starts, self.sizes, self.last = starts, sizes, len(data) + 8
        self.low, self.high = self.block(np.arange(len(starts)), 0), self.block(np.arange(len(starts)), 1)
        h = _mixed(_mixed(self.low + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ self.high)
        k, rest = 2, np.flatnonzero(sizes > 16)
        while len(rest):
            h[rest] = _mixed(h[rest] ^ self.block(rest, k))
            k += 1
            rest = rest[sizes[rest] > 8 * k]
        self.hashes = h | np.uint64(1)

    def block(self, which, k: int):
        """The k-th eight bytes of some words, zero beyond their ends."""
        import numpy as np

        left = np.clip(self.sizes[which] - 8 * k, 0, 8)
        return self.eights[np.minimum(self.starts[which] + 8 * k, self.last)] & self.masks[left]

    def only(self, which) -> "Words":
        """Some of the words, over the same buffer."""
        some = Words.__new__(Words)
        some.masks, some.eights, some.last = self.masks, self.eights, self.last
        some.starts, some.sizes, some.low, some.high, some.hashes = (x[which] for x in (self.starts, self.sizes, self.low, self.high, self.hashes))
        return some


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class WordTable:
    """Words -> ids, in flat arrays with open addressing; emptied when two thirds full."""

    def __init__(self, bits: int = 21):
        import numpy as np

        self.bits = bits
        self.keys, self.low, self.high = (np.zeros(1 << bits, dtype=np.uint64) for _ in range(3))
        self.start, self.length, self.at, self.size = (np.zeros(1 << bits, dtype=np.int32) for _ in range(4))
        self.ids = np.zeros(1 << 16, dtype="<u4")
        self.text = np.zeros(1 << 16, np.uint8)
        self.used = self.words = self.written = 0

    def find(self, words: Words):
        """Slot of each word, or -1: of equal hash, length and bytes."""
        import numpy as np

        keys, mask = words.hashes, np.uint64((1 << self.bits) - 1)
        at = keys >> np.uint64(64 - self.bits)
        held = self.keys[at]
        out = np.where(held == keys, at.view(np.int64), -1)
        open_ = np.flatnonzero((held != keys) & (held != 0))
        while len(open_):
            at[open_] = (at[open_] + np.uint64(1)) & mask
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = at[open_[hit]].view(np.int64)
            open_ = open_[~hit & (held != 0)]
        same = (out >= 0) & (self.size[out] == words.sizes) & (self.low[out] == words.low) & (self.high[out] == words.high)
        k, rest = 2, np.flatnonzero(same & (words.sizes > 16))
        if len(rest):
            known = Words.__new__(Words)
            known.eights, known.last = np.ndarray(len(self.text) - 7, "<u8", self.text, 0, (1,)), len(self.text) - 8
            known.masks, known.starts, known.sizes = words.masks, self.at[out].astype(np.int64), words.sizes
        while len(rest):
            equal = known.block(rest, k) == words.block(rest, k)
            same[rest[~equal]] = False
            k += 1
            rest = rest[equal]
            rest = rest[words.sizes[rest] > 8 * k]
        return np.where(same, out, -1)

    def has(self, keys):
        """Whether some word of the table has the hash."""
        import numpy as np

        mask, at = np.uint64((1 << self.bits) - 1), keys >> np.uint64(64 - self.bits)
        out = self.keys[at] == keys
        open_ = np.flatnonzero(~out & (self.keys[at] != 0))
        while len(open_):
            at[open_] = (at[open_] + np.uint64(1)) & mask
            held = self.keys[at[open_]]
            out[open_] = held == keys[open_]
            open_ = open_[(held != keys[open_]) & (held != 0)]
        return out

    def room_for(self, n: int) -> bool:
        return 3 * (self.words + n) <= 2 << self.bits

    def clear(self) -> None:
        self.keys[:] = 0
        self.used = self.words = self.written = 0

    def add(self, words: Words, which, data, ids: list) -> None:
        """Some of the words, of distinct hashes that the table has not, with their ids."""
        import numpy as np

        keys, sizes = words.hashes[which], words.sizes[which]
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(lengths.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), "<u4", total)
        starts = (self.used + np.cumsum(lengths) - lengths).astype(np.int32)
        self.used += total
        self.words += len(ids)
        places, long = np.zeros(len(ids), np.int32), np.flatnonzero(sizes > 16)
        for i in long.tolist():  # the bytes of long words are kept; short ones are their two numbers
            first, n = int(words.starts[which[i]]), int(sizes[i])
            while self.written + n + 16 > len(self.text):
                self.text = np.concatenate((self.text, np.zeros_like(self.text)))
            self.text[self.written : self.written + n] = data[first : first + n]
            places[i] = self.written
            self.written += n
        mask = np.uint64((1 << self.bits) - 1)
        at, left = keys >> np.uint64(64 - self.bits), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == 0
            self.keys[at[left[free]]] = keys[left[free]]
            placed = self.keys[at[left]] == keys[left]
            done = left[placed]
            self.start[at[done]], self.length[at[done]] = starts[done], lengths[done]
            self.low[at[done]], self.high[at[done]] = words.low[which[done]], words.high[which[done]]
            self.size[at[done]], self.at[at[done]] = sizes[done], places[done]
            left = left[~placed]
            at[left] = (at[left] + np.uint64(1)) & mask


class Encoder:
    """encode(texts) -> each text's ids as little-endian unsigned 32-bit integers."""

    #: Bytes of text handled at once.
    SLICE = 1 << 18

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.splits, self.lower = self._splitting(spec)
        self.model = self._word_model(spec)
        if self.splits:
            import numpy as np

            self.table, self.kinds = WordTable(), _classes()
            self.tails = [(t, np.frombuffer(t.encode(), np.uint8)) for t in ("s", "t", "m", "d", "re", "ve", "ll")]

    @staticmethod
    def _splitting(spec: dict) -> tuple[bool, bool]:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True):
            return True, False
        steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        first = (pre.get("pretokenizers") or [{}])[0]
        if steps == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert"):
            return True, True
        return False, False

    def _word_model(self, spec: dict):
        """The library's model, where a word's bytes as characters are all that it gets from the steps before it."""
        pre = spec.get("pre_tokenizer") or {}
        last = (pre.get("pretokenizers") or [pre])[-1]
        plain = len(pre.get("pretokenizers") or [pre]) == 1 + self.lower and last.get("type") == "ByteLevel" and not last.get("add_prefix_space", True)
        return self.tokenizer.model if self.splits and plain and not spec["model"].get("dropout") else None

    def whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_starts(self, data, kind, first):
        """Flags of word starts; `first` flags texts' first bytes.

        Byte-level words take one space before them with them, and of white space before a word the last
        character stands apart; lower-cased ones are letters, one digit, or other marks, and white space is none.
        """
        import numpy as np

        before = np.empty_like(kind)
        before[0], before[1:] = SPACE, kind[:-1]
        start = (kind != before) | first
        word = start & (kind != SPACE) & ~first
        if self.lower:
            start |= kind == DIGIT
        else:
            after_space = np.flatnonzero(word & (before == SPACE))
            start[after_space - 1] = True
            start[after_space[data[after_space - 1] == 32]] = False
        # a lone apostrophe before one of the tails is a word with it
        n = len(data)
        marks = np.flatnonzero(data == 39)
        if len(marks):
            alone = start[marks] & (marks + 1 < n)
            marks = marks[alone]
            marks = marks[(kind[marks + 1] == LETTER) & ~first[marks + 1]]
            taken = np.zeros(len(marks), dtype=bool)
            for text, tail in self.tails:
                end = marks + 1 + len(tail)
                fits = ~taken & (end <= n)
                for j, byte in enumerate(tail):
                    at = np.minimum(marks + 1 + j, n - 1)
                    fits &= (data[at] == byte) & ~first[at]
                taken |= fits
                start[marks[fits] + 1] = False
                inside = end[fits][end[fits] < n]
                inside = inside[kind[inside] == LETTER]
                start[inside] = True
        return start

    def _library(self, words: list[bytes]) -> list[list[int]]:
        if self.model:
            of = self.model.tokenize
            return [[t.id for t in of(w.decode() if w.isalnum() else w.decode("latin-1").translate(CHARACTERS))] for w in words]
        return [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def _slice(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        parts = [t.encode() for t in texts]
        sizes = np.array([len(p) for p in parts])
        data = np.frombuffer(b"".join(parts), np.uint8)
        if not len(data):
            return [b""] * len(texts)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        first = np.zeros(len(data), dtype=bool)
        first[begins[sizes > 0]] = True
        kind = self.kinds[data]
        start = np.flatnonzero(self._word_starts(data, kind, first))
        stop = np.append(start[1:], len(data))
        if self.lower:
            words = kind[start] != SPACE
            start, stop = start[words], stop[words]
        if not len(start):
            return [b""] * len(texts)
        words = Words(data, start, np.minimum(stop - start, LONGEST + 1))
        short = words.sizes <= LONGEST
        slots = np.where(short, self.table.find(words), -1)
        raw = data.tobytes()
        lost = np.flatnonzero((slots < 0) & short)
        if len(lost):
            # at a hash that the table or an earlier word has with other bytes nothing is added
            _, one = np.unique(words.hashes[lost], return_index=True)
            new = lost[one]
            if not self.table.room_for(len(new)):
                self.table.clear()
                lost = np.flatnonzero(short)
                _, one = np.unique(words.hashes[lost], return_index=True)
                new = lost[one]
            new = new[~self.table.has(words.hashes[new])]
            self.table.add(words, new, data, self._library([raw[a:b] for a, b in zip(start[new].tolist(), stop[new].tolist())]))
            slots[lost] = self.table.find(words.only(lost))
        lengths, offsets, ids = self.table.length[slots].astype(np.int64), self.table.start[slots].astype(np.int64), self.table.ids
        odd = np.flatnonzero(slots < 0).tolist()
        if odd:
            own = list(dict.fromkeys(raw[start[i] : stop[i]] for i in odd))
            found = dict(zip(own, self._library(own)))
            place, extra = {}, []
            for word, x in found.items():
                place[word] = self.table.used + len(extra)
                extra += x
            for i in odd:
                word = raw[start[i] : stop[i]]
                offsets[i], lengths[i] = place[word], len(found[word])
            ids = np.concatenate((ids[: self.table.used], np.array(extra, "<u4")))
        until = np.cumsum(lengths)
        ids = ids[np.repeat(offsets - (until - lengths), lengths) + np.arange(int(until[-1]))]
        at = np.append(0, until)[np.searchsorted(start, np.append(begins, len(data)))].tolist()
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(at, at[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.splits:
            return self.whole(texts)
        out: list[bytes] = [b""] * len(texts)
        rest, some, size = [], [], 0
        for i, text in enumerate(texts):
            if PLAIN.search(text):
                rest.append(i)
                continue
            some.append(i)
            size += len(text)
            if size > self.SLICE:
                self._put(out, some, texts)
                some, size = [], 0
        self._put(out, some, texts)
        for i, ids in zip(rest, self.whole([texts[i] for i in rest])):
            out[i] = ids
        return out

    def _put(self, out: list[bytes], some: list[int], texts: list[str]) -> None:
        for i, ids in zip(some, self._slice([texts[i].lower() if self.lower else texts[i] for i in some])):
            out[i] = ids


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker; workers outlive tasks, and so do the words they know."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
