import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import repeats


def plain(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - length + 1):
            if n[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, anchor, hot, crowd", [(40, 10, 20_000, 20_000), (40, 10, 2, 20_000), (60, 33, 1, 2), (31, 31, 1, 1)])
def test_against_all_windows(spark, length, anchor, hot, crowd):
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 5)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(10)]
    rows = []
    for i in range(160):
        t = " ".join(rng.choice(passages) if rng.random() < 0.3 else word() for _ in range(rng.randint(0, 40)))
        t = {1: "Heat " * rng.randint(1, 60), 2: "a" * rng.randint(1, 200), 3: rows[-1][1] if rows else t, 4: None}.get(i % 31, t)
        rows.append((None if i % 97 == 0 else i - i % 2 if i % 30 == 0 else i, t))
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length, anchor, hot, crowd)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found.collect()), key=str)
    assert got == plain(rows, length)
    # the same from a family of shorter strings, with what those cover
    short = length // 2
    both = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length, anchor, hot, crowd, shorter=short, shorter_anchor=min(10, short)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in both), key=str) == got
    assert sorted(((r.doc_id, r.n_bytes, r.n_shorter, r.n_shorter_spans) for r in both), key=str) == [x[:4] for x in sorted(plain(rows, short), key=lambda x: str(x[:4]))]


def test_pieces_of_long_texts(monkeypatch):
    data = bytes(random.Random(4).choice(b"abcd ") for _ in range(3000))
    whole = list(repeats.anchors_of(data, repeats.Rolling(1), 60, 20))
    monkeypatch.setattr(repeats, "PIECE", 500)
    cut = list(repeats.anchors_of(data, repeats.Rolling(1), 60, 20))
    at = lambda xs: {w: (h, a) for h, a, s, e in xs for w in range(s, e + 1)}
    assert at(whole) == at(cut)


def test_batches_meet_the_levels_of_earlier_ones(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(20)) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(passages) if rng.random() < 0.2 else word() for _ in range(25))) for i in range(120)]
    docs = repeats.keyed_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    path, levels = f"file://{tmp_path}/family", []
    for k in range(6):
        family = repeats.Family(spark, path, 40, 10)  # opened anew, as another session would
        assert family.batches == k
        family.add(docs.filter(f"doc_id % 6 = {k}"))
        levels.append([b - a + 1 for a, b in family.spans])
        if k not in (1, 5):
            continue
        some = docs.filter(f"doc_id % 6 <= {k}")
        by_doc = repeats.repeated_runs(family, some).groupBy("doc0", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
        got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in repeats._cut(some, by_doc, 40).collect()), key=str)
        assert got == plain([r for r in rows if r[0] % 6 <= k], 40)
    assert levels == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1], [4, 1, 1]]
    array = [(r.h, r.context) for r in family._read((0, 3)).coalesce(1).collect()]
    assert len(set(array)) == len(array)
    os.remove(next(iter((tmp_path / "family" / "level-5-5").glob("_SUCCESS"))))  # a level that was never finished
    assert repeats.Family(spark, path, 40, 10).spans == [(0, 3), (4, 4)]


def test_suffixes_stand_in_the_order_of_their_bytes():
    data = bytes(random.Random(4).choice(b"abcd ") for _ in range(3000))
    found = sorted(repeats.anchors_of(data, repeats.Rolling(1), 60, 20))
    assert [data[a : a + 4] for _, a, _, _ in found] == sorted(data[a : a + 4] for _, a, _, _ in found)


def test_bounded_tasks(spark, monkeypatch):
    """One row of text after another: windows are taken a few routes at a time."""
    monkeypatch.setattr(repeats, "MOST_WINDOWS", 50)
    rng, hashes = random.Random(3), (repeats.Rolling(2), repeats.Rolling(3))
    rows = [(h, c, 0, 1 + (c % 7 == 0), bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 30)))) for h in range(30) for c in range(10)]
    df = spark.createDataFrame([(r[0], *r, False) for r in rows], repeats.ROUTED)
    got = {(r.h, r.context, w) for r in repeats._resolve(df, 8).collect() for w in range(r.lo, r.hi + 1)}
    want = set()
    for h in range(30):
        n = Counter()
        for r in rows:
            if r[0] == h:
                n.update({r[4][k : k + 8]: 0 for k in range(len(r[4]) - 7)})
                for k in range(len(r[4]) - 7):
                    n[r[4][k : k + 8]] += r[3]
        want |= {(h, r[1], k) for r in rows if r[0] == h for k in range(len(r[4]) - 7) if n[r[4][k : k + 8]] > 1}
    assert got == want


def test_periods_and_equal_rows(spark):
    """Runs of one character and of short periods take few rows of anchors; many rows under one id are one text."""
    texts = ["a" * 700, "ab" * 150 + "c" * 90, "x" * 55 + "yz", "abc" * 40 + "d" + "abc" * 30, "q" * 39, ("w" * 13 + "v") * 20]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[3] + "tail")] * 50 + [(None, "lone " * 30)] * 40
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 40, 10, shorter=25, shorter_anchor=8).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found), key=str) == plain(rows, 40)
    long = b" " * 2_000_000
    made = list(repeats.merged_anchors(long, repeats.anchors_of(long, repeats.Rolling(1)), repeats.LENGTH))
    assert len(made) < 10 and sum(r[5] for r in made) >= len(long) - repeats.LENGTH


def test_fingerprints_differ_in_kind():
    """Thue-Morse strings and their complements have one sum modulo 2^64 from 1024 bytes on, but not modulo a prime."""
    s = b"a"
    while len(s) < 4096:
        s += s.translate(bytes.maketrans(b"ab", b"ba"))
    data = np.frombuffer(s + s.translate(bytes.maketrans(b"ab", b"ba")), np.uint8)
    at = np.array([0, 4096])
    a, b = repeats.Rolling(2).all(data, 4096, at)
    c, d = repeats.Modular(3).all(data, 4096, at)
    assert a == b and c != d
    text = np.frombuffer(b"some text, and some text", np.uint8)
    hashes = repeats.Modular(3).all(text, 9, np.array([0, 15, 4]))
    assert hashes[0] == hashes[1] != hashes[2]
