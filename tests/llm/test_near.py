import numpy as np
import pandas as pd
import pytest
import xxhash

from tabulon.llm import simhash
from tabulon.llm.components import components


def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_components(fp, ids, radius):
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
    label = np.array(ids)
    while True:
        new = np.where(near, label[None, :], 1 << 60).min(axis=1)
        if (new == label).all():
            return label.tolist()
        label = new


def test_fingerprints_and_components(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    base = [[words[j] for j in rng.integers(0, 300, n)] for n in rng.integers(0, 400, 60)]
    texts = [" ".join(b) for b in base]
    for b in base * 2:
        if len(b) > 5:
            e = list(b)
            e[rng.integers(0, len(e))] = "Edit"
            texts.append("  ".join(e))
    ids = rng.permutation(len(texts)).tolist()
    got = simhash.near_duplicates(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).toPandas().set_index("doc_id")
    fp = np.array([plain_fingerprint(t) for t in texts], dtype=np.uint64)
    assert got.loc[ids].fp.to_numpy().view(np.uint64).tolist() == fp.tolist()
    assert got.loc[ids].component_id.tolist() == plain_components(fp, ids, 2)


def sketched(spark, monkeypatch, rows):
    """Components of rows (id, fingerprint)."""
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: spark.createDataFrame(rows, "doc_id long, fp long"))
    return sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(None).collect()), key=repr)


def test_rows_without_ids(spark, monkeypatch):
    """Fingerprints that only rows without ids have, and an id over unlinked texts, join nothing."""
    b, c, near_c = 0x7FFF0000FFFF0000, 0b111, 0b100
    assert sketched(spark, monkeypatch, [(None, b), (None, near_c), (3, c)]) == sorted([(None, b, None), (None, near_c, 3), (3, c, 3)], key=repr)
    assert sketched(spark, monkeypatch, [(7, b), (7, near_c), (3, c)]) == sorted([(7, b, 7), (7, near_c, 3), (3, c, 3)], key=repr)


def test_null_and_repeated_ids_as_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    fp = rng.integers(0, 2**63, 30, dtype=np.uint64)[rng.integers(0, 30, 400)] ^ (np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64))
    ids = [None if x < 40 else int(x) for x in rng.integers(0, 90, 400)]
    of = plain_components(fp, range(400), 2)
    least = {}
    for i, root in zip(ids, of):
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    rows = list(zip(ids, fp.view(np.int64).tolist()))
    assert sketched(spark, monkeypatch, rows) == sorted([(i, f, least[root]) for (i, f), root in zip(rows, of)], key=repr)


@pytest.mark.parametrize("radius, tile_rows", [(2, 8), (2, 4096), (5, 40)])
def test_tiles(spark, radius, tile_rows):
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, 25, dtype=np.uint64)[rng.integers(0, 25, 800)]
    for _ in range(4):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, 800).astype(np.uint64))
    fp = np.unique(fp)
    df = spark.createDataFrame(pd.DataFrame({"fp": fp.view(np.int64), "node": np.arange(len(fp))}))
    got = {r.node: r.root for r in components(simhash.links(df, radius, tile_rows), "t").collect()}
    assert [got.get(i, i) for i in range(len(fp))] == plain_components(fp, range(len(fp)), radius)


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links, "t").collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == got[500] == 500 and len(got) == 203


@pytest.mark.parametrize("tile_rows", [7, 16_384])
def test_deduplicated(spark, tile_rows):
    rng = np.random.default_rng(3)
    base = [[f"v{j}" for j in rng.integers(0, 5000, 200)] for _ in range(20)]
    rows, copies = [], {}
    for i, b in enumerate(base):
        for k in range(4):
            e = list(b)
            for at in rng.integers(0, 200, k):
                e[at] = f"edit{i}{k}{at}"
            rows.append((4 * i + k, " ".join(e), "x"))
            copies[4 * i + k] = i
    rows.append((100, None, "x"))
    left = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, row string"), tile_rows=tile_rows)
    assert left.columns == ["doc_id", "text", "row"]
    assert sorted(r.doc_id for r in left.collect()) == [4 * i for i in range(20)] + [100]


def exact_survivors(texts, similarity=0.8, size=5):
    """Indices of the first text of each group that links of shingle sets make."""
    sets = []
    for t in texts:
        w = t.split()
        sets.append({" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} or {t})
    names = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(names)), dtype=np.float32)
    for i, s in enumerate(sets):
        held[i, [names[x] for x in s]] = 1
    both, n = held @ held.T, held.sum(axis=1)
    near = both >= similarity * (n[:, None] + n[None, :] - both)
    label = np.arange(len(sets))
    while (new := np.where(near, label[None, :], len(sets)).min(axis=1)).tolist() != label.tolist():
        label = new
    return np.flatnonzero(label == np.arange(len(sets))).tolist()


def variants(rng, copies, words, changed):
    """Copies of one text with some words changed, so that their similarities lie about 0.8."""
    base, out = [f"v{j}" for j in rng.integers(0, 5000, words)], []
    for k in range(copies):
        e = list(base)
        for at in rng.choice(words, rng.choice(changed), replace=False):
            e[at] = f"edit{k}x{at}"
        out.append(" ".join(e))
    return out


@pytest.mark.parametrize("part_sets", [60, 512])
def test_large_groups_about_the_similarity_are_as_by_exact_sets(spark, monkeypatch, part_sets):
    monkeypatch.setattr(simhash, "PART_SETS", part_sets)
    rng = np.random.default_rng(8)
    texts = variants(rng, 400, 300, [4, 5]) + variants(rng, 300, 200, [3, 4]) + variants(rng, 60, 100, [1, 2])
    core = [f"core{j}" for j in range(270)]
    texts += [" ".join(core + [f"own{k}x{j}" for j in range(35)]) for k in range(200)]  # every two share 266 of 336
    left = simhash.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    want = exact_survivors(texts)
    assert 200 < len(want) < len(texts) - 200 and set(range(760, 960)) <= set(want)
    assert sorted(r.doc_id for r in left.collect()) == want


def test_few_shingles_and_chance_bits_lose_no_pair(spark):
    rng = np.random.default_rng(9)
    word = lambda: f"v{rng.integers(0, 10**9)}"
    texts = []
    for k in range(300):
        base = [word() for _ in range(8 + k % 3 + 4 * (k % 2) * (k % 7))]
        shared = len(base) - 4
        longer = base + [word() for _ in range(shared // 4)]  # shared of shared * 5 / 4: 0.8 or just more
        texts += [" ".join(base), " ".join(longer)]
    left = simhash.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    assert exact_survivors(texts) == list(range(0, 600, 2)) == sorted(r.doc_id for r in left.collect())


def test_radii_hold_pairs_just_as_similar():
    rng = np.random.default_rng(10)
    first, wide = simhash._radii(0.8, 128), simhash._radii(0.8, 1024)
    for small, large, shared in [(4, 5, 4), (5, 6, 5), (12, 15, 12), (20, 25, 20), (36, 45, 36), (180, 180, 160)]:
        for _ in range(50):
            h = rng.integers(0, 2**63, small + large - shared, dtype=np.uint64)
            masks = rng.integers(0, 2**63, (16, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            bits = [simhash.majority_bits((((x := h * m) ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93))[part], np.array([len(h[part])])) for m in masks for part in (slice(0, small), slice(small - shared, None))]
            d = [int(np.bitwise_count(a ^ b)[0]) for a, b in zip(bits[::2], bits[1::2])]
            at = min(small, 40)
            assert sum(d[:2]) <= first[at] and sum(d) <= wide[at]


def test_texts_under_one_id_are_told_apart(spark):
    rng = np.random.default_rng(11)
    text = lambda: " ".join(f"v{j}" for j in rng.integers(0, 10**6, 100))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (1, b), (2, b + " end"), (2, c), (3, c), (None, c), (None, text())]
    left = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = [tuple(r) for r in left.collect()]
    assert len(got) == 4 and set(got) == {(1, a), (1, b), (None, c), rows[7]}


def test_bands_hold_pairs_of_that_similarity():
    rng = np.random.default_rng(12)
    missed = 0
    for small, large, both in [(4, 5, 4), (20, 25, 20), (90, 90, 80), (180, 180, 160), (1000, 1250, 1000)]:
        for _ in range(60):
            h = rng.integers(0, 2**63, small + large - both, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            keys = simhash.band_keys(np.concatenate([h[:small], h[small - both :]]), np.array([small, large]))
            missed += not (keys[0] == keys[1]).any()
    assert missed == 0
    apart = simhash.band_keys(rng.integers(0, 2**63, 2000, dtype=np.uint64), np.full(20, 100))
    assert len(np.unique(apart)) == apart.size
    empty = simhash.band_keys(np.zeros(0, dtype=np.uint64), np.zeros(3, dtype=np.int64))
    assert (empty == empty[0]).all() and len(np.unique(empty[0])) == simhash.BANDS


def test_survivors_of_real_documents_as_by_exact_sets(spark):
    """Recall and precision over the whole table, against all pairs of sets."""
    rows = sorted((r.doc_id, (r.text or "").encode().lower().decode()) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    left = simhash.deduplicated(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert sorted(r.doc_id for r in left.collect()) == [rows[i][0] for i in exact_survivors([t for _, t in rows])]
