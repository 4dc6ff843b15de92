"""Lloyd's clustering of vectors in whole numbers.

A component x becomes floor(scale * x), so sums, means and distances are exact and no order of addition
matters. Centroids go out as a broadcast of k x width numbers, whatever the number of vectors. A task takes
squared differences from one centroid after another in numpy and gives one row of sums for each cluster it
met; only those, at most k a batch, are shuffled. One large cluster is so many partial sums like any other.

Defined cases: a vector that is null, of another width, or with a component that is null or not finite is
left out. A component counts as within +-2^27 / scale, so that every squared distance fits 64 bits. A null
id is a row like any other; rows that repeat an id or a vector are as many rows. First centroids are the k
vectors with the smallest seeded SHA-256 of their ids (null ids last), equal ones by their components; with
fewer vectors there are fewer centroids, and without any no rows. Of centroids at one distance the first
wins; a centroid without vectors stays. A total beyond 64 bits is null. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Whole components lie within this; squared distances of up to 128 of them fit a signed 64-bit number.
WIDEST = 1 << 27


def whole_numbers(vectors: DataFrame, width: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id: long, v: array<int>, of the vectors that count."""
    x = F.col(vector_col).cast("array<double>")
    fits = (F.size(x) == width) & F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf"))))
    held = lambda a: F.greatest(F.least(F.floor(F.greatest(F.least(a * F.lit(float(scale)), F.lit(float(WIDEST))), F.lit(-float(WIDEST)))), F.lit(WIDEST)), F.lit(-WIDEST))
    return vectors.filter(F.coalesce(fits, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda a: held(a).cast("int")).alias("v"))


def first_centroids(points: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k points with the smallest SHA-256 of "seed:id", in that order."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    return [list(r.v) for r in points.orderBy(named.asc_nulls_last(), "v").limit(k).collect()]


def nearest(batch, centroids):
    """Cluster and squared distance of each row of a matrix of whole numbers; of equals the lowest cluster."""
    import numpy as np

    distances = np.empty((len(centroids), len(batch)), np.int64)
    for c, centroid in enumerate(centroids):
        difference = batch - centroid
        distances[c] = np.einsum("ij,ij->i", difference, difference)
    cluster = distances.argmin(axis=0)
    return cluster, distances[cluster, np.arange(len(batch))]


def _matrix(column, width: int):
    import numpy as np

    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.empty((0, width), np.int64)


def assigned(points: DataFrame, centroids: Sequence[Sequence[int]]) -> DataFrame:
    """id, cluster, distance of each point."""
    import numpy as np

    sent = points.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))

    def run(batches):
        import pandas as pd

        for batch in batches:
            cluster, distance = nearest(_matrix(batch["v"], sent.value.shape[1]), sent.value)
            yield pd.DataFrame({"id": batch["id"].astype("Int64"), "cluster": cluster.astype("int32"), "distance": distance})

    return points.mapInPandas(run, "id long, cluster int, distance long")


def moved(points: DataFrame, centroids: Sequence[Sequence[int]]) -> list[list[int]]:
    """Centroids after one round: floor of the mean of a cluster's points by component."""
    import numpy as np

    sent = points.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))

    def sums(batches):
        import pandas as pd

        total, count = np.zeros_like(sent.value), np.zeros(len(sent.value), np.int64)
        for batch in batches:
            rows = _matrix(batch["v"], total.shape[1])
            cluster, _ = nearest(rows, sent.value)
            for c in np.unique(cluster):
                mine = rows[cluster == c]
                total[c] += mine.sum(axis=0)
                count[c] += len(mine)
        met = np.flatnonzero(count)
        if len(met):
            yield pd.DataFrame({"cluster": met.astype("int32"), "n": count[met], "total": [total[c].tolist() for c in met]})

    parts = points.mapInPandas(sums, "cluster int, n long, total array<long>")
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(len(centroids[0]))))
    out = [list(c) for c in centroids]
    for r in merged.collect():  # at most one row for each centroid
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(len(out[0]))]
    return out


@dataclass(frozen=True)
class Clustering:
    """Fitted centroids, and the points they were fitted to with their clusters."""

    centroids: list[list[int]]
    assignments: DataFrame

    def digest(self, cluster: Column) -> Column:
        """SHA-256 of a centroid's components in decimal, joined by commas."""
        names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]
        return F.get(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"), cluster)

    def inertia(self) -> DataFrame:
        """cluster, cluster_inertia, inertia: distances summed over each cluster and over all."""
        by = self.assignments.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
        return by.withColumn("inertia", F.try_sum("cluster_inertia").over(Window.partitionBy()))  # one row a cluster


def lloyd(vectors: DataFrame, k: int, rounds: int, width: int, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> Clustering:
    """k-means with a fixed number of rounds. The whole numbers and the assignments are tables in the shared folder."""
    from tabulon.llm.common import stored

    points = stored(whole_numbers(vectors, width, scale, id_col, vector_col), "whole-numbers")
    centroids = first_centroids(points, k, seed)
    if not centroids:
        return Clustering([], points.sparkSession.createDataFrame([], "id long, cluster int, distance long"))
    for _ in range(rounds):
        centroids = moved(points, centroids)
    return Clustering(centroids, stored(assigned(points, centroids), "assigned"))


def op13(spark, sf_dir: str) -> DataFrame:
    from tabulon.llm.common import settled, table

    def rows() -> DataFrame:
        found = lloyd(table(spark, sf_dir, "embeddings"), k=16, rounds=3, width=64)
        joined = found.assignments.join(F.broadcast(found.inertia()), "cluster")  # sixteen rows at most
        return joined.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", found.digest(F.col("cluster")).alias("centroid_sha256"))

    return settled(spark, "clusters", rows)


def _round_sql(i: int) -> str:
    return f"""
a{i} AS MATERIALIZED (
  SELECT n, any_value(id) AS id, any_value(v) AS v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT p.n, p.id, p.v, c.cluster, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.v, c.v)])::BIGINT AS d FROM points p, c{i} c) GROUP BY n)"""


def _means_sql(i: int) -> str:
    return f"""
m{i} AS (SELECT cluster, list(m ORDER BY j) AS v FROM (
  SELECT cluster, j, (sum(v[j]) - ((sum(v[j]) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM a{i}, range(1, 65) r(j) GROUP BY cluster, j) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.v::BIGINT[], c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (cluster))"""


OP13_SQL = f"""
WITH points AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id AS id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY s, v) - 1)::INTEGER AS cluster, v FROM (SELECT sha256('1:' || id) AS s, v FROM points ORDER BY s, v LIMIT 16)),
{_round_sql(0)}, {_means_sql(0)}, {_round_sql(1)}, {_means_sql(1)}, {_round_sql(2)}, {_means_sql(2)}, {_round_sql(3)}
SELECT id AS vec_id, a3.cluster, distance, (sum(distance) OVER (PARTITION BY a3.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c3.v, ',')) AS centroid_sha256 FROM a3 JOIN c3 USING (cluster)
"""
