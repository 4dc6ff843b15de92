"""Benchmark decontamination: word n-grams as seeds, Smith-Waterman alignment as the judge.

Every n-gram of an item is a seed, however many documents hold it, so an item whose edited copies stand
in very many documents is found in all of them. Around the places where an item's seeds stand in a
document, its words are aligned locally (match 1, mismatch and gap -1), and the score is the alignment's
divided by the item's number of words. 1 is a verbatim copy; one edit in five leaves 0.6. From THRESHOLD
on, and with LEAST_WORDS or the whole item, it counts as a match. Stock phrases are seeds too, so before
an alignment its score is bounded: a word that the other side lacks costs 1 wherever it is passed. Only
places whose bound reaches the threshold are aligned; the bound never hides a match.

The benchmark's n-grams are sent out only up to MOST_WORDS benchmark words; a larger benchmark is taken
in slices of that size, each with its own pass. No pass shuffles documents. Alignments in which no N words
of the item stand in a row unchanged have no seed. With N = 3 such an alignment has an edit for every two
words, so it scores half the item's words and one at most: from there on every match is found, and below
it all but those.

Defined cases: null texts are empty; items or documents without words never match; an item of fewer
words than an n-gram is one seed; items with equal texts are all reported; repeated documents are
each reported; of several matches of an item in one document the best, then first, is reported; null
ids are carried; further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N = 3
THRESHOLD = 0.4
#: Alignments of fewer words than this count only where they hold the whole item.
LEAST_WORDS = 6
MOST_WORDS = 2_000_000
WORD = re.compile(r"\w+")
MATCHES = "doc_id long, item_id long, score double, n_seeds long, start_word long, end_word long"


class Benchmark:
    """Items as word numbers, and the table of their n-grams."""

    def __init__(self, items: list[tuple[int | None, str | None]], n: int = N):
        import numpy as np

        self.n, self.vocabulary, self.items = n, {}, []
        for item_id, text in items:
            words = WORD.findall((text or "").lower())
            if words:
                numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
                self.items.append((item_id, numbers))
        self.grams: dict[tuple, int] = {}
        self.places: list[list[tuple[int, int]]] = []
        for k, (_, numbers) in enumerate(self.items):
            for offset, gram in self._grams(numbers.tolist(), len(numbers)):
                g = self.grams.setdefault(gram, len(self.grams))
                if g == len(self.places):
                    self.places.append([])
                self.places[g].append((k, offset))
        self.short = sorted({len(g) for g in self.grams if len(g) < n})
        self.mark = None

    def _grams(self, numbers: list[int], whole: int):
        n = min(self.n, whole)
        return [(i, tuple(numbers[i : i + n])) for i in range(len(numbers) - n + 1)]

    def numbers(self, text: str | None):
        import numpy as np

        get = self.vocabulary.get
        words = WORD.findall((text or "").lower())
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def found(self, numbers) -> list[tuple[int, int]]:
        """(place, n-gram) of every benchmark n-gram in a document."""
        import numpy as np

        out = []
        for n in [*self.short, self.n]:
            if len(numbers) < n:
                continue
            on = numbers > 0
            all_on = np.ones(len(numbers) - n + 1, dtype=bool)
            for i in range(n):
                all_on &= on[i : i + len(all_on)]
            for place in np.flatnonzero(all_on).tolist():
                g = self.grams.get(tuple(numbers[place : place + n].tolist()))
                if g is not None:
                    out.append((place, g))
        return out

    def _reaches(self, item, words, least: float) -> bool:
        """Whether an alignment could score `least`: words that the other side lacks cost 1 each, all others give 1."""
        import numpy as np

        if self.mark is None:
            self.mark = np.zeros(len(self.vocabulary) + 1, dtype=bool)
        for held, passed in ((item, words), (words, item)):
            self.mark[held] = True
            self.mark[0] = False
            gain = np.cumsum(np.where(self.mark[passed], 1, -1))
            self.mark[held] = False
            before = np.minimum(np.minimum.accumulate(gain), 0)
            if max(int(gain[0]), int((gain[1:] - before[:-1]).max(initial=0))) < least:
                return False
        return True

    def matches(self, text: str | None, threshold: float) -> list[tuple]:
        """(item_id, score, n_seeds, first word, last word + 1) of the items found in a document."""
        numbers = self.numbers(text)
        seeds: dict[int, list[int]] = {}
        for place, g in self.found(numbers):
            for k, offset in self.places[g]:
                seeds.setdefault(k, []).append(place - offset)
        out = []
        for k, starts in seeds.items():
            item_id, item = self.items[k]
            m, best = len(item), None
            least = max(threshold * m, min(m, LEAST_WORDS))
            starts.sort()
            groups = [[starts[0], starts[0]]]
            for s in starts[1:]:
                if s - groups[-1][1] <= m:
                    groups[-1][1] = s
                else:
                    groups.append([s, s])
            for lo, hi in groups:
                a, b = max(0, lo - m), min(len(numbers), hi + 2 * m)
                if not self._reaches(item, numbers[a:b], least):
                    continue
                score, s, e = local_alignment(item, numbers[a:b])
                if best is None or score > best[0]:
                    best = (score, a + s, a + e)
            if best and best[0] >= least:
                out.append((item_id, best[0] / m, len(starts), best[1], best[2]))
        return out


def _ends(item, words):
    """Best local score, and where it ends in both (the first such place)."""
    import numpy as np

    step = np.arange(len(words) + 1)
    row, best = np.zeros(len(words) + 1, dtype=np.int64), (0, 0, 0)
    for i, w in enumerate(item):
        through = np.maximum(row - 1, 0)
        through[1:] = np.maximum(through[1:], row[:-1] + np.where(words == w, 1, -1))
        row = np.maximum.accumulate(through + step) - step
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
    return best


def local_alignment(item, words) -> tuple[int, int, int]:
    """Smith-Waterman: (score, start, end) in `words`; match 1, mismatch -1, gap -1."""
    score, i, j = _ends(item, words)
    if not score:
        return 0, 0, 0
    _, _, back = _ends(item[:i][::-1], words[:j][::-1])
    return score, j - back, j


def _slices(bench: DataFrame, id_col: str, text_col: str) -> list[Benchmark]:
    """The benchmark in parts of at most MOST_WORDS words; a part is what the driver and each worker hold at once."""
    sized = bench.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = total // (4 * MOST_WORDS) + 1
    for p in range(parts):
        rows = sized.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == p).collect()
        yield Benchmark(sorted(((r.id, r.text) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1])))


def matches(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score, n_seeds, and the words [start_word, end_word) of each document that holds an item."""
    out = None
    for part in _slices(bench, item_id_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches, sent=sent):
            import pyarrow as pa

            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            for batch in batches:
                rows = [(doc_id, *m) for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)) for m in sent.value.matches(text, threshold)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "item_id", "score", "n_seeds", "start_word", "end_word"])

        found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, MATCHES)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    from tabulon.llm.common import stored

    held = None
    for part in _slices(bench, item_id_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches, sent=sent):
            import pyarrow as pa

            for batch in batches:
                clean = [not sent.value.matches(t, threshold) for t in batch.column(text_col).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        # written between slices, so that none runs the alignments of those before it again
        docs = docs.mapInArrow(run, docs.schema) if held is None else stored(held, "clean").mapInArrow(run, docs.schema)
        held = docs
    return docs


def op6(spark, sf_dir: str) -> DataFrame:
    from tabulon.llm.common import table

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
