"""Toxicity by character n-grams: a linear classifier over features scaled by naive Bayes log-count ratios.

A text's features are the n-grams (3 to 6 characters, lower-cased, with the word's borders, and the
word itself) of its distinct words, present or not, and whether they stand in two or in three of
them. Each is scaled by the log of the ratio of its smoothed frequencies
in toxic and other texts, and a logistic regression is fitted on the scaled features by AdaGrad.

Defined cases: a null or empty text has the intercept alone; repeated rows and long texts are
scored whole like any other; no usable labels give 0.5 for every text; a null id is never held
out and never learned from; further columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most about so many labelled rows are learned from.
MOST_ROWS = 8000
BITS = 20
LENGTHS = (3, 4, 5, 6)
#: An n-gram of fewer learned texts than this has ratio 0.
LEAST_TEXTS = 3
#: An n-gram whose ratio is nearer to 0 says too little; it has ratio 0.
LEAST_RATIO = 1.5
#: The length of a text's scaled vector.
SCALE = 8.0
WORDS = re.compile(r"\w+")
MOST_WORDS = 300_000


def _marked(word: str) -> bytes:
    try:  # one byte a character where that is possible
        return f"<{word}>".encode("latin-1")
    except UnicodeEncodeError:
        return f"<{word}>".encode("utf-8", "surrogatepass")


@cache
def _crc_table():
    """What a byte does to a CRC-32."""
    import numpy as np

    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (t & np.uint32(1)))
    return t


def _grams(words: list[str], used=None) -> list:
    """Each word's n-gram numbers, each once; the checksums of all words' n-grams are made together, a byte at a time."""
    import zlib

    import numpy as np

    marked = [_marked(w) for w in words]
    sizes = np.array([len(m) for m in marked])
    data = np.frombuffer(b"".join(marked), np.uint8)
    owner = np.repeat(np.arange(len(marked)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
    number = lambda h: (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    found, of = [number(np.array([zlib.crc32(m) for m in marked], dtype=np.uint32))], [np.arange(len(marked))]
    table, crc = _crc_table(), np.full(len(data), 0xFFFFFFFF, dtype=np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        end = len(data) - n + 1
        if end <= 0:
            break
        crc = table[(crc[:end] ^ data[n - 1 :]) & np.uint32(255)] ^ (crc[:end] >> np.uint32(8))
        if n in LENGTHS:
            inside = left[:end] >= n
            found.append(number(~crc[inside]))
            of.append(owner[:end][inside])
    number_, word = np.concatenate(found), np.concatenate(of)
    if used is not None:
        on = used[number_]
        number_, word = number_[on], word[on]
    key = np.unique(word.astype(np.int64) << np.int64(32) | number_)
    cuts = np.searchsorted(key, np.arange(1, len(marked), dtype=np.int64) << np.int64(32))
    return np.split((key & np.int64(0xFFFFFFFF)).astype(np.uint32), cuts)


#: Odd factors that name the features of n-grams in two and in three words.
_STEP = {2: 0x9E3779B1, 3: 0x85EBCA77}


class Grams:
    """A text's features; `used` (a mask) leaves out n-grams that have no say. Words' n-grams are kept between texts."""

    def __init__(self, used=None):
        self.used, self.exact, self.known = used, used, {}
        if used is not None:
            import numpy as np

            at = np.arange(1 << BITS, dtype=np.uint32)
            mask = np.uint32((1 << BITS) - 1)
            self.used = used | used[(at * np.uint32(_STEP[2])) & mask] | used[(at * np.uint32(_STEP[3])) & mask]

    def words(self, text: str) -> set[str]:
        return set(WORDS.findall(text.lower()))

    def learn(self, words: set[str]) -> None:
        """Makes the n-grams of all new words at once; a word without any that counts is known as None."""
        if len(self.known) + len(words) > MOST_WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for lo in range(0, len(new), 20_000):
            some = new[lo : lo + 20_000]
            self.known.update((w, g if len(g) else None) for w, g in zip(some, _grams(some, self.used)))

    def many(self, texts: list[str]) -> list:
        """Each text's features; words that are new in any of them are learned together."""
        of = [self.words(t) for t in texts]
        self.learn(set().union(*of))
        return [self.numbers(words) for words in of]

    def __call__(self, text: str):
        return self.many([text])[0]

    def numbers(self, words: set[str]):
        import numpy as np

        parts = [g for g in map(self.known.get, words) if g is not None]
        if not parts:
            return np.zeros(0, np.uint32)
        seen = np.concatenate(parts)
        seen.sort()
        first = np.ones(len(seen), bool)
        np.not_equal(seen[1:], seen[:-1], out=first[1:])
        places = np.flatnonzero(first)
        at, words = seen[places], np.diff(np.append(places, len(seen)))
        # an n-gram of several distinct words is also a feature of its own for two, and for three or more
        out = np.concatenate([at, *((at[words >= k] * np.uint32(_STEP[k])) & np.uint32((1 << BITS) - 1) for k in (2, 3))])
        return out if self.exact is None else out[self.exact[out]]


_all = Grams()


def features(text: str):
    import numpy as np

    at = _all(text)
    return at, np.ones(len(at), np.float32)


def fit_scaled(data, y, smoothing: float = 1.0, rate: float = 0.1, l2: float = 1e-4, updates: int = 24_000) -> dict:
    """r: log-count ratio of each n-gram, w: its weight, b: the intercept; 3 to 60 passes of about `updates` rows in all."""
    import numpy as np

    size = 1 << BITS
    zero = np.zeros(size, np.float32)
    if not len(y) or y.min() == y.max():
        return {"w": zero, "r": zero, "b": np.zeros(1) if not len(y) else np.full(1, 6.0 * (2 * y[0] - 1))}
    counts = np.zeros((2, size))
    for (i, _), target in zip(data, y):
        counts[int(target > 0.5), i] += 1
    n = np.array([(y <= 0.5).sum(), (y > 0.5).sum()]) + 2 * smoothing
    ratio = np.log((counts[1] + smoothing) / n[1]) - np.log((counts[0] + smoothing) / n[0])
    ratio[(counts.sum(axis=0) < LEAST_TEXTS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    used = np.flatnonzero(ratio)
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    rows = []
    for i, _ in data:
        at = place[i]
        at = at[at >= 0]
        r = ratio[used[at]]
        rows.append((at, r * (SCALE / np.sqrt(r @ r + 1e-9))))
    w, b = np.zeros(len(used)), np.log(n[1] / n[0])
    seen, seen_b = np.full(len(used), 1e-6), 1e-6
    for _ in range(min(60, max(3, updates // len(data)))):
        for (at, x), target in zip(rows, y):
            wi = w[at]
            d = 1 / (1 + np.exp(-np.clip(wi @ x + b, -35, 35))) - target
            g = d * x + l2 * wi
            total = seen[at] + g * g
            seen[at] = total
            w[at] = wi - rate * g / np.sqrt(total)
            seen_b += d * d
            b -= rate * d / np.sqrt(seen_b)
    weight = np.zeros(size, np.float32)
    weight[used] = w
    return {"w": weight, "r": ratio.astype(np.float32), "b": np.array([b])}


def probability(at, model) -> float:
    import math

    r = model["r"][at]
    z = float(model["w"][at] @ r) * SCALE / math.sqrt(float(r @ r) + 1e-9) + float(model["b"][0])
    return 1 / (1 + math.exp(-min(35.0, max(-35.0, z))))


def fit(docs: DataFrame, labels: DataFrame, label: str, train, most_rows: int = MOST_ROWS) -> dict:
    from tabulon.llm.fitting import fitted, labelled_sample

    return fitted(labelled_sample(docs, labels, label, train, most_rows), features, fit_scaled)


def score(docs: DataFrame, model: dict, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        model = sent.value
        grams = Grams(model["r"] != 0)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                p = [probability(at, model) for at in grams.many([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def op5(spark, sf_dir: str) -> DataFrame:
    from tabulon.llm.common import crc_bucket, table

    docs, held = table(spark, sf_dir, "documents"), F.col("doc_id").isNotNull() & (crc_bucket("doc_id", 3) == 1)
    model = fit(docs, table(spark, sf_dir, "labels"), "toxic", ~held)
    return score(docs, model, threshold=0.7).select("doc_id", held.alias("held_out"), "score", "predicted")
