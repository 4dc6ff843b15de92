"""Connected components over a table of links, smallest member as the name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def local_roots(n: int, left, right):
    """Smallest index reachable from each of n nodes over the links left[i]-right[i] (numpy)."""
    import numpy as np

    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of `links` (a, b: long), root the smallest node reachable.

    Alternates a large star and a small star step until the links no longer change; both only
    attach nodes to a smaller neighbour, so the number of links never grows. Each round is
    written to the shared folder; a star's centre may have any number of links, as the smallest
    neighbour comes from a pre-aggregated minimum and is joined back. Links that name one node
    twice are ignored; an empty table gives no rows.
    """
    from tabulon.llm.common import drop_path, new_path, stored

    spark = links.sparkSession
    path = new_path(spark, f"{name}-links")
    pairs = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), name, path)
    rounds = 0
    while True:
        both = pairs.select("v", "u").union(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        smaller = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(smaller, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("v <> u").union(smaller.select("v", F.col("m").alias("u"))).distinct()
        after = new_path(spark, f"{name}-links")
        new = stored(small, name, after)
        same = _sum(new) == _sum(pairs)
        drop_path(spark, path)
        pairs, path, rounds = new, after, rounds + 1
        if same:
            break
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("root")).union(pairs.select(F.col("u"), F.col("u")).distinct())


def _sum(pairs: DataFrame):
    row = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first()
    return row[0], row[1]
