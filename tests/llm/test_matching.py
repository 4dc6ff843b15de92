import random
import re
import time

import numpy as np
import pytest
import regex

from tabulon.llm import decontamination as d
from tabulon.llm import licenses


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        score, s, e = d.local_alignment(a, b)
        assert score == plain_alignment(a, b)
        if score:
            assert plain_alignment(a, b[s:e]) == score


def test_copies_edits_and_clean_texts(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(["of the and"] + [word() for _ in range(30)])) for i in range(20)] + [(90, None), (91, ""), (92, "of the and"), (93, "two words")]
    rows, want = [], set()
    for i, text in items[:20]:
        words = text.split()
        for at in range(4, 33, 6):
            words[at] = "changed"
        filler = lambda: [word() for _ in range(50)] + ["of", "the", "and"]
        rows += [(10 * i, " ".join(filler() + text.upper().split() + filler())), (10 * i + 1, " ".join(filler() + words + filler())), (10 * i + 2, " ".join(filler() + text.split()[:9] + filler()))]
        want |= {(10 * i, i), (10 * i + 1, i)}
    rows += [(900, None), (901, "")] + [(1000 + k, items[0][1]) for k in range(300)]
    want |= {(1000 + k, 0) for k in range(300)}
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in d.matches(docs, bench).collect() if r.item_id < 90}
    assert set(got) == want
    assert got[10, 1].score == 1 and (got[10, 1].start_word, got[10, 1].end_word) == (53, 86) and 0.5 <= got[11, 1].score < 1
    left = {r.doc_id for r in d.without_leaks(docs, bench.filter("item_id < 90")).collect()}
    assert left == {r[0] for r in rows} - {x for x, _ in want}


def test_slices_of_a_large_benchmark(spark, monkeypatch):
    items = [(i, f"item number{i} has words{i} of its{i} own{i}") for i in range(40)]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in items], "doc_id long, text string")
    monkeypatch.setattr(d, "MOST_WORDS", 30)
    got = d.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(i, i) for i in range(40)} <= {(r.doc_id, r.item_id) for r in got if r.score == 1}
    more = docs.unionByName(spark.createDataFrame([(99, "nothing of the kind stands here")], "doc_id long, text string"))
    assert [r.doc_id for r in d.without_leaks(more, spark.createDataFrame(items, "item_id long, text string")).collect()] == [99]


def test_edited_and_partial_copies_in_many_documents(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(38))) for i in range(2)]
    edited = items[0][1].split()
    edited[2:35:5] = ["changed"] * 7
    filler = lambda: [word() for _ in range(40)]
    kinds = [edited, items[1][1].split()[:19], items[1][1].split()[:5] + ["and"] + items[0][1].split()[-5:]]
    rows = [(3 * i + k, " ".join(filler() + words + filler())) for i in range(300) for k, words in enumerate(kinds)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    got = d.matches(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(3 * i + k, k) for i in range(300) for k in range(2)}
    assert all(r.score >= (24 / 38 if r.item_id == 0 else 0.5) for r in got)
    assert {r.doc_id for r in d.without_leaks(docs, bench).collect()} == {3 * i + 2 for i in range(300)}


def test_matches_as_by_all_alignments(spark):
    """Every item against every document by plain alignment: edits of all kinds, from verbatim to unrelated."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    items = [[rng.choice(words) for _ in range(rng.randint(8, 30))] for _ in range(12)]
    rows = []
    for i in range(120):
        copy = list(rng.choice(items))
        for _ in range(rng.randint(0, len(copy))):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randint(0, 1)] = rng.choice([[], [rng.choice(words)], ["extra", "words"]])
            copy = copy or ["one"]
        rows.append((i, " ".join([rng.choice(words) for _ in range(rng.randint(0, 15))] + copy + [rng.choice(words) for _ in range(rng.randint(0, 15))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in d.matches(docs, bench).collect()}
    seen = {w: n for n, w in enumerate(sorted({w for _, t in rows for w in t.split()} | set(words)))}
    want, without_seed = {}, 0
    for i, t in rows:
        numbers = np.array([seen[w] for w in t.split()])
        for k, item in enumerate(items):
            score, m = plain_alignment(np.array([seen[w] for w in item]), numbers), len(item)
            if score >= max(d.THRESHOLD * m, min(m, d.LEAST_WORDS)):
                want[i, k] = score / m
                if score <= m / 2 + 1 and (i, k) not in got:
                    without_seed += 1
    assert got.items() <= want.items() and len(want) > 40
    assert len(want) - len(got) == without_seed <= 0.05 * len(want)


def test_bound_hides_no_match():
    rng = np.random.default_rng(4)
    held = d.Benchmark([(0, " ".join(f"w{i}" for i in range(6)))])
    for _ in range(2000):
        a, b = rng.integers(1, 7, rng.integers(1, 12)), rng.integers(0, 7, rng.integers(1, 20))
        score = d.local_alignment(a, b)[0]
        assert held._reaches(a, b, score) and not held._reaches(a, b, min(len(a), len(b)) + 1)


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_phrases():
    rng, s = random.Random(2), licenses.Scanner()
    bits = ["cc", "by", "CC BY", "general", "Public", "license", "all rights", "reserved", "x", "É", "-", "\n", "all rights reserved", "Cc-By", None]
    for _ in range(3000):
        text = "".join((rng.choice(bits[:-1]) + rng.choice([" ", "-", "  ", ""])) for _ in range(rng.randint(0, 14)))
        assert s.scan(text)[:5] == plain_base(text)
    assert s.scan(None)[:5] == plain_base(None)


def test_errors_are_found_as_by_the_library_alone():
    rng, s = random.Random(3), licenses.Scanner()
    for k, n in enumerate(licenses.NOTICES):
        direct = regex.compile(f"(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={n.errors}}}")
        for _ in range(60):
            letters = list(n.phrase)
            for _ in range(rng.randint(0, n.errors + 3)):
                at = rng.randrange(len(letters))
                letters[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
            text = f" some words {''.join(letters)} and more "
            m = direct.search(text)
            assert bool(m) == any(x[0] == n.label for x in s.matches(text)), text
            if m:
                size = len(n.phrase) + 2 * n.errors
                assert any(i == k and lo <= m.start() and m.end() <= lo + size for i, lo in s.windows(text))


@pytest.mark.parametrize("text, least", [("permission is hereby granteed free of charg to any person ", 17_000), ("all rights reserved ", 50_000), ("licensed ", 0), ("all rights reservd ", 50_000), ("licensed under the apach ", 0)])
def test_long_texts_that_repeat_themselves(text, least):
    """A megabyte each; joined windows or rescans from the start would take hours."""
    began = time.process_time()
    found = licenses.Scanner().scan(text * (1_000_000 // len(text)))
    assert len(found[7]) >= least and time.process_time() - began < 6


def test_matches_of_a_notice_do_not_overlap():
    rng = random.Random(8)
    for _ in range(300):
        found = sorted({(rng.randint(0, 3), s, s + rng.randint(5, 9)) for s in (rng.randint(0, 80) for _ in range(30))})
        taken = []
        for x in found:
            if all(x[2] <= y[1] or y[2] <= x[1] for y in taken):
                taken.append(x)
        assert licenses._apart(found) == sorted(taken, key=lambda x: x[1])


def test_edited_notice_before_an_exact_one():
    s = licenses.Scanner()
    for text, want in [(" all rights reservd all rights reserved ", [1, 0]), (" all rights reserved all rights reservd ", [0, 1]), (" all rihts reserved all rights reservd all rights reserved all rights reservd ", [1, 1, 0, 1])]:
        assert [x[3] for x in s.matches(text) if x[0] == "reserved"] == want
    spans = s.scan("All rights reservd. All rights reserved.")[7]
    assert [(x["start"], x["end"]) for x in spans] == [(0, 18), (20, 39)]


def test_spans_point_into_the_text():
    text = "Ünder. This work is Licensd -- under the  Apache License, Version 2.0. Fin"
    n_words, n_base, *_, labels, score, spans = licenses.Scanner().scan(text)
    assert labels == "apache" and 0.9 < score < 1 and n_base == 0
    assert text[spans[0]["start"] : spans[0]["end"]] == "Licensd -- under the  Apache License, Version" and spans[0]["edits"] == 1


@pytest.mark.parametrize("text, score", [("", 0.0), ("all rights reserved", 1.0), ("nothing here", 0.0)])
def test_score(text, score):
    assert licenses.Scanner().scan(text)[6] == score
