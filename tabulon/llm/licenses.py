"""License notices, exact and with errors.

A text becomes its words (ASCII lower-cased, split at anything that is no letter, digit or
non-ASCII character) joined by single spaces. Base phrases are counted wherever their words
stand in a row. For notices with errors a phrase with at most e edits is split into e + 1
pieces, one of which must stand unchanged (the pigeonhole principle): one automaton finds all
pieces of all phrases, and each hit opens a window of the phrase's length and e characters on both
sides. An edit takes away two of a phrase's pairs of letters at most, so a window that lacks more than
2e of them holds no match; in the others the regex library's bounded-error matching looks for the
best match, with its edits and its span. Of overlapping matches of a notice the one with fewest
edits stays, then the first. Windows of equal letters are matched once, so that a text takes time in
proportion to its length however often it repeats a notice or what comes near one.

Defined cases: a null text is empty; no words give counts 0, null first and last word, empty
labels and score 0; repeated rows stay; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate, groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and labels that count exactly
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str

    @property
    def errors(self) -> int:
        return max(1, len(self.phrase) // 10)


NOTICES = (
    Notice("apache", "licensed under the apache license version"),
    Notice("gpl", "gnu general public license version"),
    Notice("lgpl", "gnu lesser general public license"),
    Notice("mpl", "subject to the terms of the mozilla public license"),
    Notice("mit", "permission is hereby granted free of charge to any person"),
    Notice("bsd", "redistribution and use in source and binary forms"),
    Notice("cc", "licensed under a creative commons"),
    Notice("cc-by", "licensed under cc by"),
    Notice("reserved", "all rights reserved"),
    Notice("public-domain", "released into the public domain"),
)

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: int, end: int, edits: int>>"
#: Windows whose best match a worker remembers.
KNOWN_WINDOWS = 20_000
#: keeps digits, small letters and all bytes of non-ASCII characters
_WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, notices: tuple[Notice, ...] = NOTICES):
        import ahocorasick
        import regex

        self.base = [(f" {phrase} ".encode(), label) for phrase, label in base.items()]
        self.notices = notices
        self.known: dict[tuple[int, str], tuple[int, int, int] | None] = {}
        self.pairs = [[n.phrase[i : i + 2] for i in range(len(n.phrase) - 1)] for n in notices]
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={n.errors}}}") for n in notices]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(notices):
            parts = n.errors + 1
            edges = [len(n.phrase) * i // parts for i in range(parts + 1)]
            for a, b in zip(edges, edges[1:]):
                pieces.setdefault(n.phrase[a:b], []).append((k, a))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def windows(self, text: str) -> list[tuple[int, int]]:
        """(notice, first letter of a window); every match with at most the notice's errors lies in a window."""
        return sorted({(k, max(0, end + 1 - size - offset - self.notices[k].errors)) for end, (size, uses) in self.seeds.iter(text) for k, offset in uses})

    def best(self, k: int, window: str) -> tuple[int, int, int] | None:
        """(start, end, edits) of a notice's best match in a window."""
        found = self.known.get((k, window), self)
        if found is self:
            n = self.notices[k]
            held = {window[i : i + 2] for i in range(len(window) - 1)}
            m = self.patterns[k].search(window) if sum(g in held for g in self.pairs[k]) >= len(n.phrase) - 1 - 2 * n.errors else None
            found = m and (m.start(), m.end(), sum(m.fuzzy_counts))
            if len(self.known) >= KNOWN_WINDOWS:
                self.known.clear()
            self.known[k, window] = found
        return found

    def matches(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, edits, score) in the joined words."""
        by_notice: dict[int, set[tuple[int, int, int]]] = {}
        for k, lo in self.windows(text):
            n = self.notices[k]
            m = self.best(k, text[lo : lo + len(n.phrase) + 2 * n.errors])
            if m:
                by_notice.setdefault(k, set()).add((m[2], lo + m[0], lo + m[1]))
        out = []
        for k, found in by_notice.items():
            n = self.notices[k]
            for edits, s, e in _apart(sorted(found)):
                out.append((n.label, s, e, edits, 1 - edits / len(n.phrase)))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))

    def scan(self, text: str | None) -> tuple:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.lower().translate(_WORD_BYTES).split()
        joined = b" " + b" ".join(words) + b" "
        places, labels, starts = [], set(), None
        for needle, label in self.base:
            at = joined.find(needle)
            while at >= 0:
                starts = starts or list(accumulate((len(w) + 1 for w in words), initial=1))
                places.append(bisect_left(starts, at + 1))
                labels.add(label)
                at = joined.find(needle, at + 1)
        near = self.matches(joined.decode("utf-8", "surrogatepass"))
        spans = []
        if near:
            at = _word_spans(text or "")
            starts = list(accumulate((e - s + 1 for s, e in at), initial=1))
            ends = [x - 1 for x in starts[1:]]
            for label, s, e, edits, _ in near:
                # the words that the match has letters of
                first = min(bisect_right(ends, s), len(at) - 1)
                last = max(bisect_left(starts, e) - 1, first)
                spans.append({"label": label, "start": at[first][0], "end": at[last][1], "edits": edits})
        score = max([float(bool(places)), *(x[4] for x in near)])
        every = labels | {x[0] for x in near}
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score, spans


def _apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (edits, start, end) in this order, each that overlaps none taken before it."""
    taken: list[tuple[int, int, int]] = []
    for _, some in groupby(found, key=lambda x: x[0]):
        older, i, last, new = taken, 0, 0, []
        for x in some:
            while i < len(older) and older[i][2] <= x[1]:
                i += 1
            if x[1] >= last and (i == len(older) or x[2] <= older[i][1]):
                new.append(x)
                last = x[2]
        taken = sorted(older + new, key=lambda x: x[1])
    return taken


def _word_spans(text: str) -> list[tuple[int, int]]:
    import re

    return [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, labels, score and the spans (code points of the text) of each document's notices."""

    def run(batches):
        import pyarrow as pa

        scanner = Scanner()
        span = pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span)]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            rows = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op9(spark, sf_dir: str) -> DataFrame:
    from tabulon.llm.common import table

    return scan(table(spark, sf_dir, "documents")).withColumn("n_spans", F.size("spans").cast("long")).drop("spans")
