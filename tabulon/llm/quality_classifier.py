"""Quality by hashed word n-grams: logistic regression fitted by follow-the-regularised-leader.

Words are runs of letters and digits or of other marks. Features are the n-grams of one and two
words, and of two and three word shapes (case, digits, the marks themselves, and whether a word
repeats the one before), all hashed to one table; a feature counts 1 + log(times), and a text's
vector has length one. FTRL-proximal with L1 leaves most weights at zero; a score is the sparse
dot product through the logistic function.

Defined cases: a null or empty text has the intercept alone; repeated rows and long texts are
scored whole like any other; no usable labels give 0.5 for every text; a null id is never held
out and never learned from; further columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most about so many labelled rows are learned from.
MOST_ROWS = 8000
BITS = 18
WORDS = re.compile(r"\w+|[^\w\s]+")
MOST_WORDS = 400_000


def _hashes(word: str) -> tuple[int, int]:
    import xxhash

    if word[0].isalnum() or word[0] == "_":
        shape = "9" if word.isdigit() else "A" if word.isupper() and len(word) > 1 else "a" if word.islower() else "Aa" if word.istitle() else "aA"
    else:
        shape = word
    return xxhash.xxh64_intdigest(word.lower(), 1), xxhash.xxh64_intdigest(shape, 2)


class _Words:
    """The hashes of words met so far, numbered, so that a text's are looked up as one array."""

    def __init__(self):
        self.numbers, self.hashes = {}, None

    def __call__(self, words: list[str]):
        import numpy as np

        try:
            at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = [w for w in set(words) if w not in self.numbers]
            if len(self.numbers) + len(new) > MOST_WORDS:
                self.numbers, new = {}, list(set(words))
            n = len(self.numbers)
            if self.hashes is None or n + len(new) > self.hashes.shape[1]:
                larger = np.zeros((2, 2 * (n + len(new))), dtype=np.uint64)
                if n:
                    larger[:, :n] = self.hashes[:, :n]
                self.hashes = larger
            self.hashes[:, n : n + len(new)] = np.array([_hashes(w) for w in new], dtype=np.uint64).T
            self.numbers.update(zip(new, range(n, n + len(new))))
            at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        return self.hashes[0, at], self.hashes[1, at]


_words = _Words()


def features(text: str):
    """(indices, values) of a text: ascending indices below 2^BITS; index 0 is the intercept."""
    import numpy as np

    words = WORDS.findall(text)
    at, times = np.zeros(1, np.int64), np.ones(1)
    if words:
        h, s = _words(words)
        s[1:][h[1:] == h[:-1]] = np.uint64(0xABCDEF)
        a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        two = s[:-1] * a + s[1:] * b
        grams = np.concatenate((h, h[:-1] * a + h[1:], two, two[:-1] * b + s[2:] * a))
        index = ((grams * b) >> np.uint64(64 - BITS)).astype(np.int64)
        found, n = np.unique(index[index > 0], return_counts=True)
        value = 1 + np.log(n)
        at, times = np.concatenate((at, found)), np.concatenate((times, value / np.sqrt((value * value).sum())))
    return at, times


def ftrl(data, y, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1, updates: int = 32_000) -> dict:
    """Weights of FTRL-proximal over the rows in order, again and again up to about `updates` rows, 4 to 60 times."""
    import numpy as np

    epochs = min(60, max(4, updates // max(1, len(data))))

    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(i):
        zi = z[i]
        free = np.where(i == 0, 0.0, l1)
        w = -(zi - np.sign(zi) * free) / ((beta + np.sqrt(n[i])) / alpha + np.where(i == 0, 0.0, l2))
        return np.where(np.abs(zi) <= free, 0.0, w)

    for _ in range(epochs):
        for (i, x), target in zip(data, y):
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - target) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return {"w": weights(np.arange(1 << BITS)).astype(np.float32)}


def fit(docs: DataFrame, labels: DataFrame, label: str, train, most_rows: int = MOST_ROWS):
    """The weights (2^BITS float32)."""
    from tabulon.llm.fitting import fitted, labelled_sample

    return fitted(labelled_sample(docs, labels, label, train, most_rows), features, ftrl)["w"]


def score(docs: DataFrame, w, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every whole text."""
    weights = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = weights.value
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for r, text in enumerate(batch.column(1).to_pylist()):
                i, x = features(text or "")
                z[r] = held[i] @ x
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def op1(spark, sf_dir: str) -> DataFrame:
    from tabulon.llm.common import crc_bucket, table

    docs, held = table(spark, sf_dir, "documents"), F.col("doc_id").isNotNull() & (crc_bucket("doc_id", 5) == 0)
    w = fit(docs, table(spark, sf_dir, "labels"), "quality", ~held)
    return score(docs, w, threshold=0.3).select("doc_id", held.alias("held_out"), "score", "predicted")
