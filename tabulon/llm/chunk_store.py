"""Content-addressed store of token ids.

Layout of a store at `path`:
  chunks/    hash, n, payload   each distinct chunk once; payload holds the ids little-endian, 2 or 4 bytes each
             (and, with no hash, the recipes in the order they were made)
  recipes/   part, place, doc_id, start, n_tokens, hashes, ends      documents in ascending doc_id order
  manifest/  part, n_docs, n_tokens, root   a Merkle root over the recipes of each part
A rolling hash over the last 16 ids cuts each document's ids where its low bits are zero, so equal
passages give equal chunks wherever they stand. Writing: one pass encodes and cuts, a task sends
each of its distinct chunks once, and one shuffle by hash leaves each chunk in one place; only the
short recipes are sorted. Reading checks every chunk against its hash and every part against its
root. Then either documents are put together again (`documents`), or their checksums are joined
from the chunks' (`digests`): the crc32 of a concatenation is the exclusive-or of the parts'
checksums, each shifted by the bytes that follow, so no payload is moved to a document.

Defined cases: a null text is empty; a document of no ids and no end id has an empty recipe and
checksum 0; repeated rows and repeated ids are stored as often as they occur, in any order among
themselves; null ids come first; further columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WINDOW, MEAN_BITS, LEAST, MOST = 16, 9, 64, 8192
#: Ids that the rolling hash runs over at once.
BLOCK = 1 << 15
#: Chunks that an encoding task remembers, so as not to send them twice; what it forgets goes again and is dropped later.
MOST_MET = 200_000
#: Documents, and bytes of text, that an encoding task has in hand at once; a longer text comes alone.
SLICE_DOCS, SLICE_BYTES = 500, 1 << 22
DIGEST = 16
STAGED = "doc_id long, hashes array<binary>, ends array<long>, hash binary, n int, payload binary"


def _mixed(x):
    """splitmix64, vectorised."""
    import numpy as np

    x = (x + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def marks_of(ids):
    """Places after which the rolling hash lets a chunk end, in blocks that fit the processor's cache."""
    import numpy as np

    found = [np.zeros(0, np.int64)]
    for lo in range(0, len(ids), BLOCK):
        first = max(lo - WINDOW + 1, 0)
        h = _mixed(ids[first : lo + BLOCK].astype(np.uint64))
        width = 1
        while width < WINDOW:  # doubles the window: the sum over 2w ids from two sums over w
            h[width:] = h[width:] + (h[:-width] << np.uint64(width))
            width *= 2
        found.append(np.flatnonzero((h >> np.uint64(64 - MEAN_BITS))[lo - first :] == 0) + lo + 1)
    return np.concatenate(found)


def cut_points(ids, sizes) -> list[list[int]]:
    """Ends of the chunks of each document (the last is its length), of the ids of documents one after another.

    At a document's first ids the window reaches back into the one before, but no chunk ends before LEAST of its own.
    """
    import numpy as np

    marks = marks_of(ids)
    until = np.cumsum(sizes)
    begins = until - sizes
    lows, highs = np.searchsorted(marks, begins, "right").tolist(), np.searchsorted(marks, until, "right").tolist()
    marks, out = marks.tolist(), []
    for begin, n, low, high in zip(begins.tolist(), sizes.tolist(), lows, highs):
        ends, last = [], 0
        for mark in [*(m - begin for m in marks[low:high]), n]:
            while mark - last > MOST:
                last += MOST
                ends.append(last)
            if mark - last >= LEAST or mark == n and mark > last:
                ends.append(mark)
                last = mark
        out.append(ends)
    return out


def slices_of(batch):
    """Slices of a batch of documents (texts in column 1), in order, bounded in number and bytes."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    until, lo = np.cumsum(sizes), 0
    while lo < batch.num_rows:
        room = until[lo] - sizes[lo] + SLICE_BYTES
        hi = min(max(int(np.searchsorted(until, room, "right")), lo + 1), lo + SLICE_DOCS)
        yield batch.slice(lo, hi - lo)
        lo = hi


def stage(docs: DataFrame, tokenizer_path: str, end_id: int | None, width: int, id_col: str, text_col: str) -> DataFrame:
    """Two kinds of rows: a document's recipe (hash null), and a chunk that this task met first here."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from tabulon.llm.encoding import encoder

        enc = encoder(tokenizer_path)
        end = b"" if end_id is None else end_id.to_bytes(4, "little")
        types = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary()]
        names = ["doc_id", "hashes", "ends", "hash", "n", "payload"]
        met: set[bytes] = set()
        for batch in batches:
            for part in slices_of(batch):
                cols: list[list] = [[] for _ in names]

                def put(*row):
                    for col, value in zip(cols, row):
                        col.append(value)

                texts = part.column(1).to_pylist()
                packed = [ids + end for ids in enc.encode(["" if t is None else t for t in texts])]
                sizes = np.array([len(ids) // 4 for ids in packed])
                ids = np.frombuffer(b"".join(packed), dtype="<u4")
                raw, first = ids.astype(f"<u{width}").tobytes(), 0
                for doc_id, n, ends in zip(part.column(0).to_pylist(), sizes.tolist(), cut_points(ids, sizes)):
                    hashes, start = [], 0
                    for stop in ends:
                        payload = raw[(first + start) * width : (first + stop) * width]
                        digest = hashlib.blake2b(payload, digest_size=DIGEST).digest()
                        hashes.append(digest)
                        if digest not in met:
                            if len(met) >= MOST_MET:
                                met.clear()
                            met.add(digest)
                            put(None, None, None, digest, stop - start, payload)
                        start = stop
                    first += n
                    put(doc_id, hashes, ends, None, None, None)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, STAGED)


def _first_of_each(staged: DataFrame) -> DataFrame:
    """Chunks dealt and sorted by hash, recipes by document; of equal chunks the first stays."""
    key = F.when(F.col("hash").isNull(), F.xxhash64("doc_id", "hashes")).otherwise(F.xxhash64("hash"))
    before = F.lag("hash").over(Window.partitionBy("key").orderBy("hash"))
    dealt = staged.withColumn("key", key).repartition("key").withColumn("before", before)
    return dealt.filter("hash IS NULL OR before IS NULL OR hash != before").drop("key", "before")


def leaf(doc_id, hashes) -> bytes:
    return hashlib.blake2b(repr(doc_id).encode() + b"".join(hashes), digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    while len(leaves) > 1:
        leaves = [hashlib.blake2b(b"".join(leaves[i : i + 2]), digest_size=DIGEST).digest() for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else bytes(DIGEST)


def roots(recipes: DataFrame) -> DataFrame:
    """part, n_docs, n_tokens, root; a part's recipes come by place, in slices of `SLICE` that make the lower level of its tree."""

    def leaves(batches):
        import pyarrow as pa

        for batch in batches:
            ids, hashes = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(4), pa.array([leaf(d, h) for d, h in zip(ids, hashes)], pa.binary())],
                ["part", "place", "n_tokens", "leaf"],
            )

    def root(batches):
        import pyarrow as pa

        for batch in batches:
            trees = [merkle_root([x["leaf"] for x in rows]) for rows in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(trees, pa.binary())], ["part", "n_docs", "n_tokens", "root"])

    hashed = recipes.select("part", "place", "doc_id", "hashes", "n_tokens").mapInArrow(leaves, "part long, place long, n_tokens long, leaf binary")
    total = [F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")]
    nodes = F.sort_array(F.collect_list(F.struct("slice", "leaf"))).alias("nodes")
    lower = (
        hashed.groupBy("part", F.floor(F.col("place") / SLICE).alias("slice"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("place", "leaf"))).alias("nodes"))
        .select(F.struct("part", "slice").alias("at"), "n_docs", "n_tokens", "nodes")
    )
    of = "at struct<part: long, slice: long>, n_docs long, n_tokens long, root binary"

    def slices(batches):
        import pyarrow as pa

        for batch in root(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, ["at", "n_docs", "n_tokens", "root"])

    upper = lower.mapInArrow(slices, of).select("at.part", "at.slice", "n_docs", "n_tokens", F.col("root").alias("leaf"))
    return upper.groupBy("part").agg(*total, nodes).select("part", "n_docs", "n_tokens", "nodes").mapInArrow(root, "part long, n_docs long, n_tokens long, root binary")


SLICE = 4096


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the store. `width`: bytes of an id in the chunk files, 2 where the vocabulary allows."""
    from tabulon.llm.common import drop_path

    spark = docs.sparkSession
    first = _first_of_each(stage(docs, tokenizer_path, end_id, width, id_col, text_col))
    first.write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/chunks")
    del first
    raw = spark.read.schema(STAGED).parquet(f"{path}/chunks")
    ordered = (
        raw.filter("hash IS NULL")
        .select("doc_id", "hashes", "ends", F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0).cast("long")).alias("n_tokens"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("hashes"), F.monotonically_increasing_id())
        .withColumn("part", F.spark_partition_id().cast("long"))
    )
    ordered.write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/sorting")
    ranged = spark.read.schema(ordered.schema).parquet(f"{path}/sorting")
    # one row for each part, so its size is that of the number of parts
    before, starts = 0, []
    for part, n in sorted(tuple(r) for r in ranged.groupBy("part").agg(F.sum("n_tokens")).collect()):
        starts.append((part, before))
        before += n
    by = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("hashes"))
    offsets = spark.createDataFrame(starts, "part long, first long")
    recipes = ranged.join(F.broadcast(offsets), "part").select(
        "part",
        (F.row_number().over(by) - 1).cast("long").alias("place"),
        "doc_id",
        (F.col("first") + F.sum("n_tokens").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")).alias("start"),
        "n_tokens", "hashes", "ends",
    )
    recipes.sortWithinPartitions("part", "place").write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/recipes")
    roots(read_recipes(spark, path)).write.mode("overwrite").parquet(f"{path}/manifest")
    drop_path(spark, f"{path}/sorting")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part long, place long, doc_id long, start long, n_tokens long, hashes array<binary>, ends array<long>").parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STAGED).parquet(f"{path}/chunks").filter("hash IS NOT NULL").select("hash", "n", "payload")


def verify(spark: SparkSession, path: str) -> None:
    """Raises if a part's recipes don't give its root, or a part is missing."""
    told = spark.read.parquet(f"{path}/manifest")
    names = ["n_docs", "n_tokens", "root"]
    found = roots(read_recipes(spark, path)).select("part", *(F.col(n).alias(f"own_{n}") for n in names))
    same = F.lit(True)
    for n in names:
        same &= F.col(n).eqNullSafe(F.col(f"own_{n}"))
    bad = told.join(found, "part", "full").filter(~same).select("part").limit(5).collect()
    if bad:
        raise ValueError(f"recipes of parts {[r[0] for r in bad]} do not match the manifest")


def chunk_sums(spark: SparkSession, path: str) -> DataFrame:
    """hash, n and crc32 of each chunk's ids as 32-bit integers; raises where a payload doesn't match its hash."""

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sums = []
            for digest, n, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if hashlib.blake2b(payload, digest_size=DIGEST).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                sums.append(zlib.crc32(np.frombuffer(payload, f"<u{len(payload) // n}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], ["hash", "n", "crc"])

    return read_chunks(spark, path).mapInArrow(run, "hash binary, n int, crc long")


def _times(table, crc):
    """The linear map given by its images of the 32 unit vectors, applied to each crc."""
    import numpy as np

    out = np.zeros_like(crc)
    for bit in range(32):
        out ^= np.where(crc >> np.uint32(bit) & np.uint32(1), table[bit], np.uint32(0))
    return out


def shifted(crc, n_bytes):
    """crc32 of each text's bytes as they count before n_bytes further ones."""
    import numpy as np

    unit = np.array([1 << i for i in range(32)], dtype=np.uint32)
    step = np.where(unit & np.uint32(1), unit >> np.uint32(1) ^ np.uint32(0xEDB88320), unit >> np.uint32(1))
    for _ in range(3):  # one bit, then a byte
        step = _times(step, step)
    crc, left = crc.astype(np.uint32), n_bytes.astype(np.int64)
    while (left > 0).any():
        crc = np.where(left & 1, _times(step, crc), crc)
        step = _times(step, step)
        left >>= 1
    return crc


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files; raises on a missing or damaged chunk."""
    verify(spark, path)

    def shift(series: "pd.Series", more: "pd.Series") -> "pd.Series":
        import pandas as pd

        return pd.Series(shifted(series.to_numpy(), more.to_numpy()).astype("int64"))

    import pandas as pd  # noqa: F401  for the annotations

    shift.__annotations__ = {"series": pd.Series, "more": pd.Series, "return": pd.Series}
    move = F.pandas_udf(shift, "long")
    recipes = read_recipes(spark, path)
    after = F.transform("ends", lambda end: F.col("n_tokens") - end)
    uses = recipes.filter(F.size("hashes") > 0).select("part", "place", F.explode(F.arrays_zip(F.col("hashes").alias("hash"), after.alias("after"))).alias("use")).select("part", "place", F.col("use.hash").alias("hash"), F.col("use.after").alias("after"))
    sums = uses.join(chunk_sums(spark, path), "hash", "left").select("part", "place", move(F.coalesce("crc", F.raise_error(F.lit("a chunk is missing")).cast("long")), F.col("after") * 4).alias("crc"))
    whole = sums.groupBy("part", "place").agg(F.bit_xor("crc").alias("ids_crc32"))
    return recipes.select("part", "place", "doc_id", "start", "n_tokens").join(whole, ["part", "place"], "left").select("doc_id", "start", "n_tokens", F.coalesce("ids_crc32", F.lit(0).cast("long")).alias("ids_crc32"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids (little-endian unsigned 32-bit) of each document, put together from its chunks."""
    verify(spark, path)

    def widen(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids = [b"".join(np.frombuffer(p["payload"], f"<u{len(p['payload']) // p['n']}").astype("<u4").tobytes() for p in row or []) for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    recipes = read_recipes(spark, path)
    uses = recipes.select("part", "place", F.posexplode("hashes").alias("i", "hash"))
    held = uses.join(read_chunks(spark, path), "hash").groupBy("part", "place").agg(F.sort_array(F.collect_list(F.struct("i", "n", "payload"))).alias("parts"))
    return recipes.select("part", "place", "doc_id", "start").join(held, ["part", "place"], "left").select("doc_id", "start", "parts").mapInArrow(widen, "doc_id long, start long, ids binary")


def op10(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tabulon.llm.common import new_path, settled, table

    def read_back():
        path = new_path(spark, "ids")
        write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
        return digests(spark, path)

    return settled(spark, "op10", read_back)
