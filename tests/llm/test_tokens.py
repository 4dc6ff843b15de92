import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

from tabulon.llm import chunk_store, packing
from tabulon.llm.common import new_path
from tabulon.llm.encoding import PLAIN, Encoder, WordTable

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def texts(n=1500, seed=1):
    rng = random.Random(seed)
    fixed = ["don't I'll  we've\n\n x's 12345 a1b2\t\tç  ", "", "   ", "\n", "é", "é", "中文", "<|endoftext|> a", "''s 's'S 'LL x'rex", "İ ß ÀÉ", "a b", "\x0b \x0c"]
    return fixed + ["".join(rng.choice(" \n\tabzAZ''steévlmdr09!.,|<>ÀßŸ") for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_same_ids_as_the_library(path):
    e = Encoder(path)
    assert e.splits
    e.SLICE = 700
    assert e.encode(texts()) == e.whole(texts())


def test_word_table_when_full():
    e = Encoder(BYTES)
    e.table, e.SLICE = WordTable(bits=10), 300
    assert e.encode(texts(seed=2)) == e.whole(texts(seed=2))


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_words_of_equal_sums(path):
    """Thue-Morse words over two letters, and with the letters swapped: one polynomial hash modulo 2^64 from 1024 letters on."""
    swap, some = str.maketrans("ab", "ba"), ["a"]
    for _ in range(13):
        some.append(some[-1] + some[-1].translate(swap))
    some = [t for s in some[3:] for t in (s, s.translate(swap))]
    some += ["q" * n + end for n in (7, 8, 15, 16, 17, 31, 32, 33, 255, 256, 257, 300) for end in ("", "z", " z")]
    e = Encoder(path)
    assert e.encode(some) == e.whole(some) and e.encode(some[::-1]) == e.whole(some[::-1])


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_words_of_equal_hashes(path, monkeypatch):
    """With four hashes in all, words are still told apart."""
    from tabulon.llm import encoding

    monkeypatch.setattr(encoding, "_mixed", lambda x: (x & np.uint64(6)) << np.uint64(60))
    e = Encoder(path)
    assert e.encode(texts(300, 5)) == e.whole(texts(300, 5)) and e.encode(texts(300, 6)) == e.whole(texts(300, 6))


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_new_words_meet_the_model_alone(path):
    e, some = Encoder(path), [t for t in texts(600, 8) + ["ÀÉß ıɏ don't 'll 's 12 <|endoftext|> </w> Ġ!", "\x20" * 9 + "ÿ~\t"] if not PLAIN.search(t)]
    want = e.whole(some)

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.seen = tokenizer, 0

        def encode_batch_fast(self, words, **more):
            self.seen += len(words)
            return self.tokenizer.encode_batch_fast(words, **more)

    e.tokenizer = Counted(e.tokenizer)
    assert len(some) > 500 and e.encode(some) == want and e.tokenizer.seen == 0


def test_only_lost_words_are_looked_up_again(monkeypatch):
    looked, find = [], WordTable.find
    monkeypatch.setattr(WordTable, "find", lambda self, words: looked.append(len(words.sizes)) or find(self, words))
    e = Encoder(WORDS)
    some = ["known " * 1000, "known " * 1000 + "unknown"]
    assert [e.encode([t]) for t in some] == [e.whole([t]) for t in some]
    assert looked == [1000, 1000, 1001, 1]


def test_cuts_of_many_documents_at_once(monkeypatch):
    """Against a plain rolling sum over each document alone."""
    rng = np.random.default_rng(4)
    sizes = np.array([0, 1, 15, 16, 17, 63, 64, 65, 0, 9000, 20_000, *rng.integers(0, 2500, 60), 0])
    ids = rng.integers(0, 49_000, int(sizes.sum())).astype("<u4")
    ids[300:9500] = 7
    want, at = [], 0
    for n in sizes.tolist():
        mixed = [int(x) for x in chunk_store._mixed(ids[at : at + n].astype(np.uint64))]
        ends, last = [], 0
        for i in range(1, n + 1):
            h = sum(x << j for j, x in enumerate(mixed[max(i - 16, 0) : i][::-1])) % (1 << 64)
            if i - last >= 64 and h >> 55 == 0 or i == n or i - last == 8192:
                ends.append(i)
                last = i
        want.append(ends)
        at += n
    for block in (chunk_store.BLOCK, 50):
        monkeypatch.setattr(chunk_store, "BLOCK", block)
        assert chunk_store.cut_points(ids, sizes) == want
    assert max(map(len, want)) > 10


def test_equal_chunks_stay_in_the_engine(spark):
    rows = [(None, None, None, h, 1, h) for h in (b"a", b"b", b"a", b"c", b"b", b"a")] + [(d, [b"a"], [1], None, None, None) for d in (1, 1, 2, None, None)]
    first = chunk_store._first_of_each(spark.createDataFrame(rows, chunk_store.STAGED))
    assert "ArrowInMap" not in first._jdf.queryExecution().toString() and "MapInArrow" not in first._jdf.queryExecution().toString()
    got = first.collect()
    assert sorted(bytes(r.hash) for r in got if r.hash is not None) == [b"a", b"b", b"c"]
    assert sorted(str(r.doc_id) for r in got if r.hash is None) == ["1", "1", "2", "None", "None"]


@pytest.mark.parametrize("capacity", [16, 64, 1024])
def test_packing(capacity):
    rng = random.Random(capacity)
    docs = [(i, np.arange(rng.choice([0, 1, 2, rng.randint(1, 3 * capacity)]), dtype="<u4").tobytes()) for i in range(300)]
    seen, padding, total = {}, 0, 0
    for sequence in packing.fill(iter(docs), capacity):
        length = sum(len(ids) // 4 for _, _, ids, _ in sequence)
        assert 0 < length <= capacity
        padding += 0 if length & (length - 1) == 0 else capacity - length
        total += length
        for doc, start, ids, n in sequence:
            seen.setdefault(doc, []).append((start, ids))
            assert n == len(docs[doc][1]) // 4
    for doc, ids in docs:
        pieces = sorted(seen.get(doc, []))
        assert b"".join(x for _, x in pieces) == ids
        assert [s for s, _ in pieces] == list(np.cumsum([0, *(len(x) // 4 for _, x in pieces[:-1])]))[: len(pieces)]
    assert padding <= 2 / capacity * total


def test_classes_hold_whole_documents():
    rng = random.Random(7)
    lengths = [min(20_000, int(rng.lognormvariate(6, 1.1)) + 1) for _ in range(4000)]
    assert all(1024 // (k + 1) < n <= 1024 // k for n in range(1, 1025) for k in [packing.length_class(n, 1024)])
    pieces, sequences, full = {}, 0, 0
    for sequence in packing.fill(((i, bytes(4 * n)) for i, n in enumerate(lengths)), 1024):
        sequences += 1
        full += sum(len(x[2]) // 4 for x in sequence) == 1024
        for doc, *_ in sequence:
            pieces[doc] = pieces.get(doc, 0) + 1
    fit = [i for i, n in enumerate(lengths) if n <= 1024]
    assert sum(pieces[i] > 1 for i in fit) < 0.2 * len(fit)
    assert sequences - full <= 10 and full >= 0.99 * sum(lengths) / 1024


def test_packed_table(spark, odd, odd_rows):
    rows = packing.digests(packing.pack(odd, BYTES, 0)).collect()
    whole = dict(zip(range(len(odd_rows)), Encoder(BYTES).whole([r[1] or "" for r in odd_rows])))
    assert sum(r.length for r in rows) == sum(len(x) // 4 + 1 for x in whole.values())
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
    ids = whole[5] + bytes(4)
    for r in (r for r in rows if r.doc_id == 5):
        assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) and r.doc_tokens == len(ids) // 4


def test_store_round_trip(spark, odd, odd_rows):
    path = new_path(spark, "t")
    chunk_store.write(odd, path, WORDS, 1)
    want, at = [], 0
    order = sorted(range(len(odd_rows)), key=lambda i: (odd_rows[i][0] is not None, odd_rows[i][0] or 0))
    encoded = [x + np.uint32(1).tobytes() for x in Encoder(WORDS).whole([r[1] or "" for r in odd_rows])]
    held = sorted(((r.start, r.doc_id, bytes(r.ids)) for r in chunk_store.documents(spark, path).collect()), key=lambda x: x[0])
    assert [d for _, d, _ in held] == [odd_rows[i][0] for i in order]
    assert sorted(x for *_, x in held) == sorted(encoded)
    for start, _, ids in held:
        assert start == at
        want.append((start, zlib.crc32(ids), len(ids) // 4))
        at += len(ids) // 4
    assert sorted((r.start, r.ids_crc32, r.n_tokens) for r in chunk_store.digests(spark, path).collect()) == want
    hashes = [bytes(r.hash) for r in chunk_store.read_chunks(spark, path).select("hash").collect()]
    assert len(hashes) == len(set(hashes))


def test_long_documents_are_encoded_few_at_once():
    import pyarrow as pa

    rng = random.Random(3)
    sizes = [rng.choice([0, 9, 3_000, 900_000, 5_000_000]) for _ in range(60)] + [7] * 1200
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([None if n == 9 else "x" * n for n in sizes], pa.string())], ["doc_id", "text"])
    parts = list(chunk_store.slices_of(batch))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(sizes)))
    for part in parts:
        held = sum(len(t or "") for t in part.column(1).to_pylist())
        assert 0 < part.num_rows <= 500 and (held <= 1 << 22 or part.num_rows == 1)
    assert len(parts) < 60 and list(chunk_store.slices_of(batch.slice(0, 0))) == []


def test_documents_of_very_many_chunks(spark):
    ids = np.arange(300_000, dtype="<u4") % 60_000
    path = new_path(spark, "t")
    ends = list(range(10, len(ids) + 1, 10))
    payloads = [ids[e - 10 : e].astype("<u2").tobytes() for e in ends]
    hashes = [chunk_store.hashlib.blake2b(p, digest_size=chunk_store.DIGEST).digest() for p in payloads]
    spark.createDataFrame([(None, None, None, h, 10, p) for h, p in dict(zip(hashes, payloads)).items()], chunk_store.STAGED).write.parquet(f"{path}/chunks")
    spark.createDataFrame([(0, 0, 7, 0, len(ids), hashes, ends)], "part long, place long, doc_id long, start long, n_tokens long, hashes array<binary>, ends array<long>").write.parquet(f"{path}/recipes")
    chunk_store.roots(chunk_store.read_recipes(spark, path)).write.parquet(f"{path}/manifest")
    began = time.time()
    assert [r.ids_crc32 for r in chunk_store.digests(spark, path).collect()] == [zlib.crc32(ids.tobytes())]
    assert time.time() - began < 30


def test_damage_is_found(spark, odd):
    from pyspark.sql import functions as F

    path, other = new_path(spark, "t"), new_path(spark, "t")
    chunk_store.write(odd, path, WORDS, 1)
    recipes = chunk_store.read_recipes(spark, path)
    recipes.withColumn("n_tokens", F.col("n_tokens") + F.when(F.col("doc_id") == 3, 1).otherwise(0)).write.parquet(f"{other}/recipes")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{other}/manifest")
    with pytest.raises(ValueError, match="manifest"):
        chunk_store.verify(spark, other)
    chunk_store.verify(spark, path)
    bad = F.concat(F.lit(b"\x07\x00"), F.expr("substring(payload, 3)"))
    spark.read.parquet(f"{path}/chunks").withColumn("payload", bad).write.parquet(f"{other}/chunks")
    with pytest.raises(Exception, match="damaged"):
        chunk_store.chunk_sums(spark, other).collect()


def test_shifted_checksums():
    a, b = b"some bytes", b"and a longer tail of them" * 9
    joined = chunk_store.shifted(np.array([zlib.crc32(a)], dtype=np.uint32), np.array([len(b)])) ^ np.uint32(zlib.crc32(b))
    assert int(joined[0]) == zlib.crc32(a + b)
