"""Repeated byte strings across documents, by a stored logarithmic family of suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Suffixes are taken
at anchors: of the k-byte strings in a window of `length` bytes, the one with the smallest hash, the
first of equals. Equal windows have their anchor at the same offset, so equal windows are found among
the suffixes that start with the same anchor string.

1. `Family.add` takes a batch of documents. Its suffix array has a row for each distinct suffix: (h,
   context), how many places have it, and one of them. h orders suffixes by their first four bytes and
   then by a hash of the anchor string; context is the hash of all bytes of the windows that the anchor
   serves. The array is written sorted to the family's folder, as a level. Levels of like size merge
   before the next batch goes in, so n batches make about log2(n) levels and a row is rewritten about
   log2(n) times. A family can be opened again later, by its folder alone.
2. `Family.met` merge-scans all levels by h: suffixes that meet, in one level or across levels. Of a
   suffix in two places or more, all windows repeat.
3. What is left are the edges of long matches, where anchors agree and contexts don't. The bytes of one
   of each distinct context go to the task of their h, windows there are sorted by a 128-bit fingerprint
   of their `length` bytes, and neighbours are compared; how many places a context has goes along, so
   no copy of it is moved. A task takes as many h at once as make `MOST_WINDOWS` windows.
4. Runs of windows found for (h, context) are joined back to all places that have it.
An h with more contexts than `hot_contexts` is dealt out further: its windows go in groups of `BUCKET`
offsets, each to the task of the hash of the bytes that all windows of the group share; groups with
equal bytes are counted before they are moved. Where a group still has more than `crowd` distinct
bodies, its windows are counted by fingerprint as rows. No step holds more than these bounds in a task.

Defined cases: a null text is empty; texts shorter than `length` are kept whole; repeated rows
repeat each other, and of any number of rows with one id and text one speaks for all; a text of one short
period has one row of anchors for each stretch; overlapping matches count as one run; null ids are carried; further columns are
ignored; an empty table gives no rows. Texts of any length are read in pieces of PIECE windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH, ANCHOR = 400, 100
#: Shorter repeated strings that the query tells of (some 40 words), and their anchors.
SHORTER, SHORTER_ANCHOR = 250, 60
HOT_CONTEXTS, CROWD = 500, 20_000
BUCKET = 25
PIECE = 1 << 22
MOST_WINDOWS = 1 << 19
#: Batches that a table is taken in; equal texts are in one batch.
BATCHES = 4
NO_ID = -(1 << 63)
PLACES = "doc0 long, th long, h long, context long, a int, s1 int, s2 int, times int, step int"
#: Rows of places that a task passes on at once.
PLACES_AT_ONCE = 20_000
ROUTED = "route long, h long, context long, s1 int, n long, body binary, hot boolean"
RUNS = "h long, context long, lo int, hi int"
WINDOWS = "f1 long, f2 long, n long, h long, context long, at int"
LEVEL = "h long, context long, n long, one struct<doc0: long, th: long, a: int, s1: int, s2: int>"


class Rolling:
    """Sums of random byte values times powers of an odd number, modulo 2^64: a hash of any stretch from two running sums."""

    def __init__(self, seed: int):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base = int(rng.integers(1 << 62, 1 << 63)) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int):
        import numpy as np

        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            out = []
            for base in (self.base, self.inverse):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            self.up, self.down = out
        return self.up[:n], self.down[:n]

    def all(self, data, width: int, at=None):
        """Hashes of the strings of `width` bytes starting at each place, or at the places `at`."""
        import numpy as np

        up, down = self._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * up[:-1], out=sums[1:])
        if at is None:
            return (sums[width:] - sums[:-width]) * down[: len(data) - width + 1]
        return (sums[at + width] - sums[at]) * down[at]


class Modular:
    """The same over sums modulo a prime, which shares no structure with sums modulo 2^64: texts that one takes for equal the other tells apart."""

    PRIME = (1 << 31) - 1

    def __init__(self, seed: int):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, self.PRIME, 256, dtype=np.uint64)
        self.base = int(rng.integers(1 << 20, self.PRIME))
        self.inverse = pow(self.base, -1, self.PRIME)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int):
        import numpy as np

        while n > len(self.up):  # the next as many powers are those so far times the first beyond them
            size, p = len(self.up), np.uint64(self.PRIME)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(self.base, size, self.PRIME)) % p))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(self.inverse, size, self.PRIME)) % p))
        return self.up[:n], self.down[:n]

    def all(self, data, width: int, at):
        """Hashes of the strings of `width` bytes at the places `at`."""
        import numpy as np

        up, down = self._powers(len(data) + 1)
        sums, p = np.zeros(len(data) + 1, dtype=np.uint64), np.uint64(self.PRIME)
        np.cumsum(self.values[data] * up[:-1] % p, out=sums[1:])
        return (sums[at + width] - sums[at]) % p * down[at] % p


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _window_minima(x, width: int):
    """Minimum of each `width` neighbours, in two running minima over blocks."""
    import numpy as np

    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _heads(data, at):
    """The four bytes at each place as a number, so that numbers stand in the order of the bytes."""
    import numpy as np

    out = np.zeros(len(at), dtype=np.uint64)
    for i in range(4):
        out = (out << np.uint64(8)) | data[at + i].astype(np.uint64)
    return out


def anchors_of(data: bytes, rolling: Rolling, length: int = LENGTH, anchor: int = ANCHOR) -> Iterator[tuple[int, int, int, int]]:
    """(h, place, first window, last window) of each anchor; windows are counted by their first byte, h is a signed 64-bit number."""
    import numpy as np

    low = np.uint64((1 << 24) - 1)
    for lo in range(0, len(data) - length + 1, PIECE):
        part = np.frombuffer(data, np.uint8)[lo : lo + PIECE + length - 1]
        h = _mixed(rolling.all(part, anchor))
        least = _window_minima((h & ~low) | np.arange(len(h), dtype=np.uint64), length - anchor + 1)
        place = (least & low).astype(np.int64)
        cuts = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate(([0], cuts))
        last = np.concatenate((cuts, [len(place)])) - 1
        places = place[first]
        order = (_heads(part, places) << np.uint64(32)) | (h[places] >> np.uint64(32))
        columns = ((order ^ np.uint64(1 << 63)).view(np.int64), places + lo, first + lo, last + lo)
        for at in range(0, len(places), PLACES_AT_ONCE):
            yield from zip(*(c[at : at + PLACES_AT_ONCE].tolist() for c in columns))


def _short(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def merged_anchors(text: bytes, found: list, length: int):
    """(h, context, place, first window, last window, times, step): anchors one after another with equal bytes around them are one.

    A text of period p has an anchor every p bytes; those come as one row with their number and p.
    """
    held = None  # [h, context bytes' end points, times, step]
    for h, a, s1, s2 in found:
        if held and h == held[0] and s1 - a == held[2] - held[1] and s2 - a == held[3] - held[1]:
            step = a - held[6]
            if held[5] in (0, step) and text[s1 : s2 + length] == text[held[2] : held[3] + length]:
                held[4] += 1
                held[5], held[6] = step, a
                continue
        if held:
            yield held[0], _short(text[held[2] : held[3] + length]), *held[1:6]
        held = [h, a, s1, s2, 1, 0, a]
    if held:
        yield held[0], _short(text[held[2] : held[3] + length]), *held[1:6]


def anchors(keyed: DataFrame, length: int, anchor: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        rolling = Rolling(1)
        names = ["doc0", "th", "h", "context", "a", "s1", "s2", "times", "step"]
        kinds = [pa.int64()] * 4 + [pa.int32()] * 5
        cols: list[list] = [[] for _ in names]

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
            cols[:] = [[] for _ in names]
            return out

        for batch in batches:
            for doc, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                text = text.as_py()
                for row in merged_anchors(text, anchors_of(text, rolling, length, anchor), length) if len(text) >= length else ():
                    for col, v in zip(cols, (doc, th, *row)):
                        col.append(v)
                    if len(cols[0]) >= PLACES_AT_ONCE:
                        yield rows()
        if cols[0]:
            yield rows()

    return keyed.mapInArrow(run, PLACES)


class Family:
    """Suffix arrays of batches, as levels `level-<first batch>-<last batch>` in a folder that all executors see.

    Beside them lie `places-<first batch>`: every anchor of one call's batches with its document, its (h, context) and its
    windows. A level that a wider one covers is a leftover of a stopped merge and counts no more.
    """

    def __init__(self, spark: SparkSession, path: str, length: int = LENGTH, anchor: int = ANCHOR):
        from tabulon.llm.common import folder_names

        self.spark, self.path, self.length, self.anchor = spark, path, length, anchor
        found = sorted((int(a), -int(b)) for a, b in (x.split("-")[1:] for x in folder_names(spark, path) if x.startswith("level-")))
        self.spans: list[tuple[int, int]] = []
        for first, last in ((a, -b) for a, b in found):
            if not self.spans or first > self.spans[-1][1]:
                self.spans.append((first, last))

    @property
    def batches(self) -> int:
        return self.spans[-1][1] + 1 if self.spans else 0

    def _at(self, span: tuple[int, int]) -> str:
        return f"{self.path}/level-{span[0]}-{span[1]}"

    def _read(self, span: tuple[int, int]) -> DataFrame:
        return self.spark.read.schema(LEVEL).parquet(self._at(span))

    def _write(self, suffixes: DataFrame, span: tuple[int, int]) -> None:
        """A suffix array: each distinct (h, context) once, in order."""
        from tabulon.llm.common import stored

        array = suffixes.groupBy("h", "context").agg(F.sum("n").alias("n"), F.min("one").alias("one"))
        stored(array.sortWithinPartitions("h", "context"), "level", self._at(span))

    def merge(self) -> None:
        """Merges levels of like size: the last two as long as the older has no more batches than the younger."""
        from tabulon.llm.common import drop_path

        while len(self.spans) > 1 and self.spans[-2][1] - self.spans[-2][0] <= self.spans[-1][1] - self.spans[-1][0]:
            b, a = self.spans.pop(), self.spans.pop()
            self._write(self._read(a).unionByName(self._read(b)), (a[0], b[1]))
            self.spans.append((a[0], b[1]))
            for old in (a, b):
                drop_path(self.spark, self._at(old))

    def add(self, keyed: DataFrame, batches: int = 1) -> None:
        """Documents (doc0, th, text), read once, as so many batches, each a new level; equal texts are in one batch."""
        first = self.batches
        found = anchors(keyed.select("doc0", "th", "text"), self.length, self.anchor).withColumn("batch", F.pmod("th", F.lit(batches)).cast("int"))
        path = f"{self.path}/places-{first}"
        found.write.mode("overwrite").option("compression", "zstd").partitionBy("batch").parquet(path)
        one = F.struct("doc0", "th", "a", "s1", "s2").alias("one")
        for k in range(batches):
            self.merge()
            places = self.spark.read.schema(f"{PLACES}, batch int").parquet(path).filter(F.col("batch") == k)
            self._write(places.select("h", "context", F.col("times").cast("long").alias("n"), one), (first + k, first + k))
            self.spans.append((first + k, first + k))

    def suffixes(self) -> DataFrame:
        """The rows of all levels; an (h, context) stands once in each level that has it."""
        out = self.spark.createDataFrame([], LEVEL)
        for span in self.spans:
            out = out.unionByName(self._read(span))
        return out

    def places(self) -> DataFrame:
        from tabulon.llm.common import folder_names

        out = self.spark.createDataFrame([], PLACES)
        for name in folder_names(self.spark, self.path):
            if name.startswith("places-") and int(name.split("-")[1]) < self.batches:
                out = out.unionByName(self.spark.read.schema(f"{PLACES}, batch int").parquet(f"{self.path}/{name}").drop("batch"))
        return out

    def met(self) -> DataFrame:
        """h, k (contexts, once for each level) of the suffixes that meet others, found in a merge-scan of the levels."""
        scanned = self.suffixes().groupBy("h").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
        return scanned.filter("n > 1").select("h", "k")


def _runs(rows, length: int, hashes):
    """(h, context, first and last window by its distance to the anchor) of windows met twice among the bodies in hand."""
    import numpy as np

    h, context, s1, n, bodies = zip(*rows)
    sizes = np.array([len(b) for b in bodies])
    data = np.frombuffer(b"".join(bodies), np.uint8)
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(sizes)), windows)
    inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    high, low = (x.all(data, length, inner + np.repeat(np.cumsum(sizes) - sizes, windows)) for x in hashes)
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    first = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))))
    weight = np.add.reduceat(np.array(n)[owner[order]], first)
    again = np.zeros(len(order), dtype=bool)
    again[order] = np.repeat(weight > 1, np.diff(np.append(first, len(order))))
    owner, inner = owner[again], inner[again]
    if not len(owner):
        return None
    cut = np.flatnonzero((np.diff(owner) != 0) | (np.diff(inner) > 1)) + 1
    lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [len(owner)])) - 1
    of, start = owner[lo], np.array(s1, dtype=np.int64)[owner[lo]]
    return np.array(h)[of], np.array(context)[of], start + inner[lo], start + inner[hi]


def _resolve(routed: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows among routed bodies; a task sorts the windows of some routes at a time."""

    def run(batches):
        import pyarrow as pa

        hashes = Rolling(2), Modular(3)
        held, windows, last = [], 0, None

        def done():
            found = _runs(held, length, hashes)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["h", "context", "lo", "hi"])

        for batch in batches:
            for route, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if windows >= MOST_WINDOWS and route != last:
                    yield from done()
                    held, windows = [], 0
                last = route
                held.append(row)
                windows += len(row[-1]) - length + 1
        if held:
            yield from done()

    return routed.select("route", "h", "context", "s1", "n", "body").repartition("route").sortWithinPartitions("route").mapInArrow(run, RUNS)


def _counted(crowded: DataFrame, length: int, kept) -> DataFrame:
    """Runs of one repeated window each, from windows as rows counted by fingerprint."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes = Rolling(2), Modular(3)
        names, kinds = ["f1", "f2", "n", "h", "context", "at"], [pa.int64()] * 5 + [pa.int32()]
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                h, context, s1, n, bodies = (c.to_pylist() for c in whole.slice(lo, 2000).columns)
                sizes = np.array([len(b) for b in bodies])
                windows = sizes - length + 1
                inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                data = np.frombuffer(b"".join(bodies), np.uint8)
                prints = [x.all(data, length, inner + np.repeat(np.cumsum(sizes) - sizes, windows)).view(np.int64) for x in hashes]
                cols = [*prints, *(np.repeat(np.array(x, dtype=np.int64), windows) for x in (n, h, context)), np.repeat(np.array(s1, dtype=np.int64), windows) + inner]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    windows = kept(crowded.select("h", "context", "s1", "n", "body").mapInArrow(run, WINDOWS), "windows")
    again = kept(windows.groupBy("f1", "f2").agg(F.sum("n").alias("n")).filter("n > 1").select("f1", "f2"), "again")
    return windows.join(again, ["f1", "f2"], "left_semi").select("h", "context", F.col("at").alias("lo"), F.col("at").alias("hi"))


def _bodies(keyed: DataFrame, needed: DataFrame, length: int, hot_contexts: int) -> DataFrame:
    """The bytes of each needed context, with the number of the task that resolves it; s1 is the first window's distance to the anchor."""

    def run(batches):
        import pyarrow as pa

        names, kinds = ["route", "h", "context", "s1", "n", "body", "hot"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
        met = set()  # equal rows lie in one task, and one of them speaks for all
        for batch in batches:
            cols: list[list] = [[] for _ in names]

            def put(*row):
                for col, v in zip(cols, row):
                    col.append(v)

            for text, wanted, *key in zip(batch.column(0).cast(pa.binary()), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if tuple(key) in met:
                    continue
                met.add(tuple(key))
                text = text.as_py()
                for x in wanted.as_py():
                    h, context, n, a, s1, s2 = x["h"], x["context"], x["n"], x["a"], x["s1"], x["s2"]
                    if x["k"] <= hot_contexts:
                        put(h, h, context, s1 - a, n, text[s1 : s2 + length], False)
                        continue
                    for q in range((a - s2) // BUCKET, (a - s1) // BUCKET + 1):
                        shared = text[a - BUCKET * q : max(a - BUCKET * (q + 1) + 1 + length, 0)]
                        first, last = max(s1, a - BUCKET * (q + 1) + 1), min(s2, a - BUCKET * q)
                        put(_short(q.to_bytes(4, "little") + shared), h, context, first - a, n, text[first : last + length], True)
                if len(cols[0]) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
                    cols[:] = [[] for _ in names]
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    by_doc = needed.groupBy("doc0", "th").agg(F.collect_list(F.struct("h", "context", "n", "k", "a", "s1", "s2")).alias("wanted"))
    one = keyed.select("doc0", "th", "text").join(by_doc.hint("shuffle_hash"), ["doc0", "th"])
    return one.select("text", "wanted", "doc0", "th").mapInArrow(run, ROUTED)


def repeated_runs(family: Family, keyed: DataFrame, hot_contexts: int = HOT_CONTEXTS, crowd: int = CROWD) -> DataFrame:
    """Runs (doc0, th, lo, hi) of repeated windows among all documents of the family; `keyed` has their texts."""
    from tabulon.llm.common import drop_path, new_path, stored

    spark, length = family.spark, family.length
    made: dict[str, str] = {}

    def kept(df, name):
        # written, so that the joins below deal both sides anew and Spark can split a hot key's rows
        made[name] = new_path(spark, name)
        return stored(df, name, made[name])

    met = kept(family.met(), "met")
    meeting = family.suffixes().join(met, "h").groupBy("h", "context").agg(F.sum("n").alias("n"), F.min("one").alias("one"), F.first("k").alias("k"))
    meeting = kept(meeting, "meeting")
    whole = meeting.filter("n > 1").select("h", "context", (F.col("one.s1") - F.col("one.a")).alias("lo"), (F.col("one.s2") - F.col("one.a")).alias("hi"))
    routed = kept(_bodies(keyed, meeting.filter("k > 1").select("h", "context", "n", "k", "one.*"), length, hot_contexts), "routed")
    hot = routed.filter("hot")
    own = F.struct("h", "context", "s1")
    alike = kept(hot.groupBy("route", "body").agg(F.sum("n").alias("n"), F.min(own).alias("one")), "alike")
    told = hot.join(alike.filter("n > 1").select("route", "body"), ["route", "body"], "left_semi")
    told = told.select("h", "context", F.col("s1").alias("lo"), (F.col("s1") + F.octet_length("body") - length).cast("int").alias("hi"))
    crowds = kept(alike.groupBy("route").agg(F.count(F.lit(1)).alias("bodies")).filter(F.col("bodies") > crowd), "crowds")
    bodies = alike.join(crowds, "route", "left").select("route", "one.h", "one.context", "one.s1", "n", "body", F.col("bodies").isNotNull().alias("crowded"))
    rest = routed.filter("NOT hot").select("route", "h", "context", "s1", "n", "body").unionByName(bodies.filter("NOT crowded").drop("crowded"))
    edges = kept(_resolve(rest, length), "edges")
    single = kept(_counted(bodies.filter("crowded"), length, kept), "single")
    runs = stored(whole.unionByName(told).unionByName(edges).unionByName(single), "runs", f"{family.path}/runs")
    # a row of several anchors stands for runs that overlap: a step is no longer than the strings
    until = F.col("a") + (F.col("times") - 1) * F.col("step") + F.col("hi")
    found = family.places().join(runs, ["h", "context"]).select("doc0", "th", (F.col("a") + F.col("lo")).alias("lo"), until.cast("int").alias("hi"))
    for path in made.values():
        drop_path(spark, path)
    return found


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, doc0 (the id; NO_ID for none), th (the text's hash) and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc0"), F.xxhash64("text").alias("th"), "text")


def _listed(found: DataFrame, name: str) -> DataFrame:
    """doc0, th and the runs of each distinct text, once each however many rows have it."""
    return found.groupBy("doc0", "th").agg(F.collect_set(F.struct("lo", "hi")).alias(name))


def _stretches(keyed: DataFrame, by_doc: DataFrame, inner: int, length: int) -> DataFrame:
    """doc0, th, text, of, own, start: stretches of at least `length` bytes covered by repeated strings of `inner` bytes, as documents of their own."""

    def run(batches):
        import pyarrow as pa

        kinds = pa.schema([("doc0", pa.int64()), ("th", pa.int64()), ("text", pa.binary()), ("of", pa.int64()), ("own", pa.int64()), ("start", pa.int32())])
        for batch in batches:
            rows = []
            for doc0, th, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3)):
                text = text.as_py()
                for a, b in zip(*_spans(found.as_py(), inner)):
                    if b - a >= length:
                        name = doc0.to_bytes(8, "little", signed=True) + th.to_bytes(8, "little", signed=True) + a.to_bytes(8, "little")
                        rows.append((_short(name), _short(name[::-1]), text[a:b], doc0, th, a))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    joined = keyed.join(by_doc.hint("shuffle_hash"), ["doc0", "th"]).select("doc0", "th", "text", "found")
    return joined.mapInArrow(run, "doc0 long, th long, text binary, of long, own long, start int")


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot_contexts: int = HOT_CONTEXTS, crowd: int = CROWD, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text",
    shorter: int | None = None, shorter_anchor: int = SHORTER_ANCHOR,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes that stay (`kept`).

    With `shorter`, n_shorter and n_shorter_spans tell what repeated strings of so many bytes cover besides; they stay. One family
    of that length then has all documents, and strings of `length` are looked for only where it found stretches as long.
    """
    from tabulon.llm.common import drop_path, new_path, stored

    spark = docs.sparkSession
    keyed = keyed_texts(docs, id_col, text_col)

    def runs_of(texts: DataFrame, n: int, k: int, name: str) -> DataFrame:
        family = Family(spark, new_path(spark, "family"), n, k)
        family.add(texts, batches)
        out = stored(_listed(repeated_runs(family, texts, hot_contexts, crowd), "found"), name)
        drop_path(spark, family.path)
        return out

    if shorter is None or shorter >= length:
        return _cut(keyed, runs_of(keyed, length, anchor, "found"), length)
    around = runs_of(keyed, shorter, shorter_anchor, "around")
    parts = stored(_stretches(keyed, around, shorter, length), "stretches")
    inside = runs_of(parts, length, anchor, "inside").select("doc0", "th", F.explode("found").alias("r"))
    starts = parts.select("doc0", "th", "of", "own", "start").distinct()
    found = inside.join(starts, ["doc0", "th"]).select(F.col("of").alias("doc0"), F.col("own").alias("th"), (F.col("start") + F.col("r.lo")).alias("lo"), (F.col("start") + F.col("r.hi")).alias("hi"))
    both = around.select("doc0", "th", F.col("found").alias("around")).join(_listed(found, "found"), ["doc0", "th"], "left")
    return _cut(keyed, both, length, shorter)


def _spans(found: list, length: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the maximal stretches that the windows of some runs cover."""
    import numpy as np

    if not found:
        return [], []
    lo, hi = np.array([(x["lo"], x["hi"] + length) for x in found], dtype=np.int64).T
    by = np.argsort(lo, kind="stable")
    lo, hi = lo[by], np.maximum.accumulate(hi[by])
    first = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
    return lo[first].tolist(), hi[np.concatenate((first[1:] - 1, [len(hi) - 1]))].tolist()


def _cut(keyed: DataFrame, by_doc: DataFrame, length: int, shorter: int | None = None) -> DataFrame:
    """The documents without the bytes of their runs."""

    def cut(batches):
        import pyarrow as pa

        kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]
        schema = pa.schema(kinds + [("n_shorter", pa.int64()), ("n_shorter_spans", pa.int64())] * (shorter is not None))
        for batch in batches:
            rows, size = [], 0
            for doc_id, text, *found in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), *batch.columns[2:]):
                text = text.as_py()
                starts, ends = _spans(found[0].as_py(), length)
                kept = b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)])) if starts else text
                row = (doc_id, len(text), len(text) - len(kept), len(starts), kept)
                if shorter is not None:
                    around = _spans(found[1].as_py(), shorter)
                    row += (sum(around[1]) - sum(around[0]), len(around[0]))
                rows.append(row)
                size += len(kept)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    more = ["around"] if shorter is not None else []
    joined = keyed.join(by_doc.hint("shuffle_hash"), ["doc0", "th"], "left").select("doc_id", "text", "found", *more)
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary" + (", n_shorter long, n_shorter_spans long" if more else ""))


def op4(spark, sf_dir: str) -> DataFrame:
    from tabulon.llm.common import settled, table

    def digests():
        found = remove_repeats(table(spark, sf_dir, "documents"), shorter=SHORTER)
        return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shorter", "n_shorter_spans")

    return settled(spark, "op4", digests)
