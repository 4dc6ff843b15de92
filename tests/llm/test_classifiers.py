import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import quality_classifier as quality
from tabulon.llm import toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randint(20, 120))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["grobzik", "grobzak", "vexq"]) + rng.choice(["", "en", "a"])
        text = rng.choice([" ".join(w.upper() + "!!" for w in words), " | ".join(words)]) if bad else " ".join(words).capitalize() + "."
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out(spark, docs, labels, label, scored):
    met = scored.join(labels, "doc_id").filter("doc_id % 4 = 0")
    return met.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]


def test_quality_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    w = quality.fit(docs, labels, "quality", F.col("doc_id") % 4 != 0)
    assert held_out(spark, docs, labels, "quality", quality.score(docs, w, 0.5)) > 0.97


def test_toxicity_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels, "toxic", F.col("doc_id") % 4 != 0)
    assert held_out(spark, docs, labels, "toxic", toxicity.score(docs, model, 0.5)) > 0.95


def test_bounded_sample(spark, labelled):
    from tabulon.llm.fitting import labelled_sample

    docs, labels = labelled
    n = labelled_sample(docs, labels, "quality", F.lit(True), 100).count()
    assert 50 < n < 160
    assert labelled_sample(docs, labels, "quality", F.lit(True), 100).count() == n


def test_no_labels(spark, labelled):
    docs, labels = labelled
    none = labels.filter("false")
    assert {r.score for r in quality.score(docs, quality.fit(docs, none, "quality", F.lit(True)), 0.3).collect()} == {0.5}
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none, "toxic", F.lit(True)), 0.7).collect()} == {0.5}
    one = toxicity.fit(docs, labels.filter("toxic = 0"), "toxic", F.lit(True))
    assert max(r.score for r in toxicity.score(docs, one, 0.7).collect()) < 0.5


def test_scores_see_only_the_text(spark, labelled):
    docs, labels = labelled
    w = quality.fit(docs, labels, "quality", F.lit(True))
    renamed = docs.select((F.col("doc_id") + 5000).alias("doc_id"), "text", F.lit(1).alias("quality"))
    a = {r.doc_id: r.score for r in quality.score(docs, w, 0.3).collect()}
    assert all(a[r.doc_id - 5000] == r.score for r in quality.score(renamed, w, 0.3).collect())


def test_features():
    i, x = quality.features("a b a b !! B9 9")
    assert i[0] == 0 and (np.diff(i) > 0).all() and abs((x[1:] ** 2).sum() - 1) < 1e-9
    assert quality.features("")[0].tolist() == [0] and len(toxicity.features("")[0]) == 0


def test_several_words_of_one_stem_count():
    rng = random.Random(4)
    ends = ["ab", "en", "or", "ul", "is", "am", "et", "yx"]
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7)))
    texts, y = [], []
    for i in range(400):
        words = [word() for _ in range(60)]
        toxic = i % 4 == 0
        if toxic or i % 4 == 1:  # others hold one word of the stem
            for end in rng.sample(ends, 3 if toxic else 1):
                words[rng.randrange(60)] = "grobz" + end
        texts.append(" ".join(words))
        y.append(float(toxic))
    rows = [toxicity.features(t) for t in texts]
    model = toxicity.fit_scaled(rows[:300], np.array(y[:300]))
    p = np.array([toxicity.probability(toxicity.Grams(model["r"] != 0)(t), model) for t in texts[300:]])
    assert ((p > 0.5) == (np.array(y[300:]) > 0.5)).mean() > 0.95


def plain_ftrl(data, y, alpha=0.5, beta=1.0, l1=0.05, l2=0.1, epochs=4):
    """The published update, one coordinate at a time, in dictionaries."""
    z, n = {}, {}

    def weight(i):
        free = 0.0 if i == 0 else l1
        zi = z.get(i, 0.0)
        if abs(zi) <= free:
            return 0.0
        return -(zi - math.copysign(free, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + (0.0 if i == 0 else l2))

    for _ in range(epochs):
        for (at, x), target in zip(data, y):
            w = {i: weight(i) for i in at}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at, x))))
            for i, v in zip(at, x):
                g = (p - target) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return weight


def test_ftrl_as_by_coordinates():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("alpha beta gamma delta !! 12 Up".split()) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    y = np.array([float("!!" in t) for t in texts])
    data = [quality.features(t) for t in texts]
    w = quality.ftrl(data, y, updates=4 * len(texts))["w"]
    plain = plain_ftrl([(i.tolist(), x.tolist()) for i, x in data], y.tolist())
    for i in {j for at, _ in data for j in at.tolist()}:
        assert w[i] == pytest.approx(plain(i), abs=1e-5)
    assert np.count_nonzero(w) == sum(plain(i) != 0 for i in {j for at, _ in data for j in at.tolist()})


def test_quality_query_scores_are_the_plain_dot_products(spark):
    """The whole query on the smallest tables, against dictionaries and one text at a time."""
    from tabulon.llm.common import table

    at = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in table(spark, at, "documents").collect()}
    known = [(r.doc_id, float(r.quality)) for r in table(spark, at, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    known.sort(key=lambda r: (r[0] * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    data = [quality.features(docs[i] or "") for i, _ in known if i in docs]
    y = [v for i, v in known if i in docs]
    weight = plain_ftrl([(i.tolist(), x.tolist()) for i, x in data], y, epochs=min(60, max(4, 32_000 // len(data))))
    for r in quality.op1(spark, at).collect():
        i, x = quality.features(docs[r.doc_id] or "")
        p = 1 / (1 + math.exp(-sum(weight(j) * v for j, v in zip(i.tolist(), x.tolist()))))
        assert r.score == pytest.approx(p, abs=1e-4) and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def plain_grams(text):
    """Names of a text's features: n-grams of its distinct words, and those of two and of three words."""
    times = {}
    for word in set(toxicity.WORDS.findall(text.lower())):
        marked = f"<{word}>"
        for g in {marked, *(marked[i : i + n] for n in toxicity.LENGTHS for i in range(len(marked) - n + 1))}:
            times[g] = times.get(g, 0) + 1
    return {(k, g) for g, n in times.items() for k in (1, 2, 3) if n >= k}


def plain_number(feature):
    k, g = feature
    low = (zlib.crc32(g.encode("latin-1")) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - toxicity.BITS)
    return low if k == 1 else low * toxicity._STEP[k] & ((1 << toxicity.BITS) - 1)


def test_scaled_features_as_by_dictionaries():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(12)) + (" grobzik grobzak" if i % 3 == 0 else "") for i in range(90)]
    y = np.array([float(i % 3 == 0) for i in range(90)])
    for t in texts[:20]:
        assert sorted(set(toxicity.features(t)[0].tolist())) == sorted({plain_number(f) for f in plain_grams(t)})
    model = toxicity.fit_scaled([toxicity.features(t) for t in texts], y)
    n = {0: int((y == 0).sum()) + 2, 1: int((y == 1).sum()) + 2}
    wrong = 0
    for f in {f for t in texts for f in plain_grams(t)}:
        with_f = [v for t, v in zip(texts, y) if f in plain_grams(t)]
        a, b = sum(with_f), len(with_f) - sum(with_f)
        ratio = math.log((a + 1) / n[1]) - math.log((b + 1) / n[0])
        want = 0.0 if len(with_f) < toxicity.LEAST_TEXTS or abs(ratio) < toxicity.LEAST_RATIO else ratio
        wrong += abs(model["r"][plain_number(f)] - want) > 1e-4
    assert wrong <= 2  # two names may share a number
    grams = toxicity.Grams(model["r"] != 0)
    for t in texts[:10]:
        at = sorted({plain_number(f) for f in plain_grams(t)})
        x = [model["r"][i] for i in at]
        size = math.sqrt(sum(float(v) ** 2 for v in x) + 1e-9)
        z = sum(float(model["w"][i]) * float(v) for i, v in zip(at, x)) * toxicity.SCALE / size + float(model["b"][0])
        assert toxicity.probability(grams(t), model) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_repeated_ids_do_not_grow_the_sample(spark):
    from tabulon.llm.fitting import labelled_sample

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    assert sorted(map(tuple, labelled_sample(docs, labels, "quality", F.lit(True), 100).collect())) == [(1, "text 0", 1.0), (2, "", 0.0)]
