"""Lloyd's rounds against plain Python in whole numbers; the query against its SQL is in test_every_query."""

import hashlib
import math
import random

from tabulon.llm import centroids


def plain(rows, k, rounds, scale=64, seed=1):
    held = [(i, [max(-(1 << 27), min(1 << 27, math.floor(scale * x))) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: "~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    middles = [v for _, v in sorted(held, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(middles))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in held]
        for c in range(len(middles)):
            mine = [v for (_, v), o in zip(held, of) if o == c]
            if mine:
                middles[c] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, *near(v)[::-1]) for i, v in held]
    total = sum(r[2] for r in out)
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middles]
    return [(i, c, d, sum(r[2] for r in out if r[1] == c), total if total < 2**63 else None, digest[c]) for i, c, d in out]


def compared(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.op13(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows, 16, 3), key=repr)
    return got


def test_query(spark, tmp_path):
    """Negative components, ties, equal vectors, null and repeated ids, vectors that do not count."""
    rng = random.Random(4)
    grid = [(i if i % 31 else None, [rng.choice([-1.0, -0.51, 0.0, 0.3, 1.0]) for _ in range(64)]) for i in range(300)]
    grid += grid[:40] + [(7, [0.25] * 64), (8, [0.25] * 64), (500, None), (501, [1.0] * 63), (502, [None] * 64), (503, [float("nan")] * 64), (504, [float("-inf")] * 64), (505, [])]
    assert len(compared(spark, tmp_path, grid)) == 342


def test_fewer_vectors_than_centroids(spark, tmp_path):
    assert len(compared(spark, tmp_path, [(i, [float(i)] * 64) for i in range(5)])) == 5


def test_widest_components(spark, tmp_path):
    got = compared(spark, tmp_path, [(i, [(-1) ** (i + j) * 3e38 for j in range(64)]) for i in range(2)] + [(9, [0.5] * 64)])
    assert {r[2] for r in got} == {0}


def test_an_empty_cluster_stays(spark):
    points = centroids.whole_numbers(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.5])], "vec_id long, embedding array<double>"), 2, 64)
    assert centroids.moved(points, [[0, 0], [900, 900], [0, 0]]) == [[32, 16], [900, 900], [0, 0]]
