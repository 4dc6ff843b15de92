"""Words, near words, forms and roots against deletion neighbourhoods in plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabulon.llm import spelling
from tabulon.llm.spelling import Automaton, near_words, one_error


def plain_near(words):
    by, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by[w[:i], w[i + 1 :]].add(w)
            less = w[:i] + w[i + 1 :]
            if less in words:
                near[w].add(less)
                near[less].add(w)
    for group in by.values():
        for a in group:
            near[a] |= group - {a}
    return near


def plain(rows):
    total = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            total[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in total.items() if len(w) >= 7 and k >= 2}
    near, form, out = plain_near(n), {}, set()
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= 10 * n[w]:
                form[w] = best
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def invented(n, seed, letters="aabé", lengths=(7, 12)):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))) for _ in range(n)})


def test_automaton():
    words = [w.encode("latin-1") for w in invented(3000, 1, "abc", (1, 9))]
    made = Automaton(words)
    for rank, word in enumerate(words):
        state, total = made.start, 0
        for byte in word:
            ok, edge = made.step(np.array([state]), np.array([byte]))
            assert ok[0]
            state, total = made.targets[edge[0]], total + made.before[edge[0]]
        assert made.final[state] and total == rank
    # minimal: no two states with the same future
    futures = [(bool(made.final[s]), *zip(made.labels[a:b].tolist(), made.targets[a:b].tolist())) for s, (a, b) in enumerate(zip(made.first, made.first[1:]))]
    assert len(set(futures)) == len(futures)


@pytest.mark.parametrize("seed", range(4))
def test_one_error(seed):
    words = [w.encode("latin-1") for w in invented(400, seed, "ab", (4, 7))]
    made = Automaton(words)
    for length in (4, 5, 6, 7):
        some = [w for w in words if len(w) == length]
        for exact in (0, 2):
            near = plain_near(set(words))
            for longer in (False, True):
                who, rank = one_error(made, np.frombuffer(b"".join(some), np.uint8).reshape(-1, length), exact, longer)
                got = sorted(zip(who.tolist(), rank.tolist()))
                fits = lambda w, v: len(v) == length - 1 if longer else len(v) >= length
                possible = lambda w, v: v[:exact] == w[:exact] and (len(v) >= length or any(w[:i] + w[i + 1 :] == v for i in range(exact, length)))
                assert got == sorted((i, words.index(v)) for i, w in enumerate(some) for v in near[w] if fits(w, v) and possible(w, v))


@pytest.mark.parametrize("most_words", [100_000, 30])
def test_near_words(spark, most_words):
    """Crowded halves are cut into many automata without a change of the result."""
    n = {w: 1 + zlib.crc32(w.encode()) % 1000 for w in invented(1500, 5)}
    near = plain_near(n)
    got = {r.word: (r.n_near, r.best.n, r.best.word) for r in near_words(spark.createDataFrame(list(n.items()), "word string, n long"), most_words).collect()}
    want = {}
    for w, vs in near.items():
        if vs:
            best = min(vs, key=lambda v: (-n[v], v))
            want[w] = (len(vs), n[best], best)
    assert got == want and len(want) > 500


def test_forms_lead_to_the_root(spark):
    """A chain of forms, each ten times as frequent: the root is its end."""
    chain = ["abcdefg" + "h" * i for i in range(7)]
    rows = [(w, 2 * 10**i) for i, w in enumerate(chain)] + [("otheràÿs", 5)]
    got = {r.word: (r.form, r.form_n, r.root, r.n_near) for r in spelling.grouped(spark.createDataFrame(rows, "word string, n long")).collect()}
    for i, w in enumerate(chain[:-1]):
        assert got[w] == (chain[i + 1], 2 * 10 ** (i + 1), chain[-1], 1 + (i > 0))
    assert got[chain[-1]] == (None, None, chain[-1], 1)
    assert got["otheràÿs"] == (None, None, "otheràÿs", 0)


def test_query(spark, tmp_path):
    rng = random.Random(9)
    words = invented(120, 7, "abCÉé", (6, 11))
    rows = [(rng.randint(0, 50), " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 400))) + ", x1yĀ ×÷") for _ in range(250)]
    rows += [(None, None), (None, " ".join(words)), (3, ""), (4, "z" * 2000), (4, "z" * 2000)] + rows[:20]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.op12(spark, str(tmp_path)).collect()}
    assert got == plain(rows) and any(r[1] for r in got)


def test_words_as_they_are(spark):
    rows = spark.createDataFrame([(1, "one ONE two"), (2, "oneÉ")], "doc_id long, text string")
    assert {tuple(r) for r in spelling.counted(rows, 1, None).collect()} == {("one", 2), ("two", 1), ("oneÉ", 1)}
