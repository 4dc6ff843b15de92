"""Exact best splits of ordered features, for the open nodes of many trees at a time, from histograms.

Features are cut once into bins by quantiles, from mergeable sketches. A first pass adds rows up by (node,
feature, bin) inside its tasks; merged, those cells give every split between two bins exactly, and for the
splits inside a bin a bound that none of them passes: impurity only falls as rows are taken away, so a split
is no better than the rows before its bin and those behind it alone. A second pass reads only the bins whose
bound reaches the best split found so far, adds up by value, and scans each bin in the order of its values
from what lies before it. What a job holds is bounded by its cells, and a level with more nodes takes several
jobs; a scan holds one batch. The driver gets one row for each node and feature, and the open bins of each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a feature, and numbers that a job's cells may come to.
BINS, MOST_NUMBERS = 256, 1 << 21
#: Digits to which qualities count as equal.
DIGITS = 10


# Sums of rows: of classes ("gini"), or number, outputs and squares of outputs ("sse"); the last axis of an array.


def number(kind: str, s):
    return s[..., 0] if kind == "sse" else s.sum(-1)


def impurity(kind: str, s):
    """Times the number of rows: Gini impurity, or the sum of squares around the means of all outputs."""
    import numpy as np

    n = number(kind, s)
    safe = np.where(n > 0, n, 1)
    if kind == "sse":
        return np.where(n > 0, np.maximum(s[..., -1] - (s[..., 1:-1] ** 2).sum(-1) / safe, 0), 0)
    return n - (s**2).sum(-1) / safe


def quality(kind: str, left, right, whole=None):
    """Weighted impurity of two sides (for squares: each side's share times its sum of squares), by the rows of both or `whole`."""
    n, m = number(kind, left), number(kind, right)
    a, b = impurity(kind, left), impurity(kind, right)
    total = n + m if whole is None else whole
    return (n * a + m * b) / total if kind == "sse" else (a + b) / total


def unsplit(kind: str, s):
    return impurity(kind, s) if kind == "sse" else impurity(kind, s) / number(kind, s)


@dataclass(frozen=True)
class Rules:
    kind: str
    min_samples_split: float = 2
    min_samples_leaf: float = 1
    min_impurity_decrease: float = 0.0

    def allowed(self, left, right, q, top):
        n, m = number(self.kind, left), number(self.kind, right)
        return (n >= self.min_samples_leaf) & (m >= self.min_samples_leaf) & (n + m >= self.min_samples_split) & (top - q > self.min_impurity_decrease + 1e-12)


@dataclass
class Grown:
    """A tree in the making: for each node its feature (-1: a leaf), threshold, first child and sums."""

    feature: list
    threshold: list
    child: list
    sums: list

    @staticmethod
    def root(sums) -> "Grown":
        return Grown([-1], [0.0], [-1], [sums])

    def split(self, node: int, f: int, value: float, left) -> None:
        self.feature[node], self.threshold[node], self.child[node] = f, value, len(self.feature)
        for s in (left, self.sums[node] - left):
            self.feature.append(-1)
            self.threshold.append(0.0)
            self.child.append(-1)
            self.sums.append(s)

    def arrays(self):
        import numpy as np

        return np.array(self.feature, np.int32), np.array(self.threshold), np.array(self.child, np.int32)


def walk(arrays, x):
    """The leaf of each row of a matrix; a missing number goes to the second child."""
    import numpy as np

    feature, threshold, child = arrays
    at, rows = np.zeros(len(x), np.int32), np.arange(len(x))
    while True:
        rows = rows[feature[at[rows]] >= 0]
        if not len(rows):
            return at
        here = at[rows]
        at[rows] = child[here] + ~(x[rows, feature[here]] <= threshold[here])


def matrix(column, width: int):
    """Rows of a list column of numbers."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=float).reshape(-1, width) if len(column) else np.empty((0, width))


def contributions(kind: str, y, dims: int):
    """What each row adds for a weight of 1: y has class numbers, or outputs."""
    import numpy as np

    out = np.zeros((len(y), dims))
    if kind == "sse":
        out[:, 0], out[:, 1:-1], out[:, -1] = 1, y, (y**2).sum(1)
    else:
        out[np.arange(len(y)), y[:, 0].astype(int)] = 1
    return out


def cuts_of(held: DataFrame, width: int, bins: int = BINS) -> list:
    """Upper edges of each feature's bins but the last, at quantiles of all rows."""
    import numpy as np

    shares = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    row = held.agg(*(F.percentile_approx(F.get("x", F.lit(i)), shares, F.lit(4 * bins)).alias(f"c{i}") for i in range(width))).first()
    return [np.unique(np.array(row[i] or [], float)) for i in range(width)]


class _Search:
    """One job's nodes: where they are in which trees, and how rows are added up for them."""

    def __init__(self, rules: Rules, width: int, outputs: int, dims: int, cuts: list, weighted: bool, trees: dict, nodes: list):
        import numpy as np

        self.rules, self.width, self.outputs, self.dims, self.cuts, self.weighted = rules, width, outputs, dims, cuts, weighted
        self.bins = max((len(c) for c in cuts), default=0) + 1
        self.nodes = nodes  # (tree, node) in order
        self.trees = {t: trees[t].arrays() for t, _ in nodes}
        self.places = {}
        for i, (t, node) in enumerate(nodes):
            self.places.setdefault(t, np.full(len(self.trees[t][0]), -1, np.int64))[node] = i

    def rows(self, batch):
        """For each tree: rows that lie in open nodes, the node's place, weights; before them the batch's features and outputs."""
        import numpy as np

        x, y = matrix(batch.column(0), self.width), matrix(batch.column(1), self.outputs)
        w = batch.column(2)
        w = matrix(w, len(w[0])) if len(w) and self.weighted else None
        for t, arrays in self.trees.items():
            place = self.places[t][walk(arrays, x)]
            weight = w[:, t] if w is not None else np.ones(len(x))
            met = np.flatnonzero((place >= 0) & (weight > 0))
            yield x[met], place[met], contributions(self.rules.kind, y[met], self.dims) * weight[met, None]

    # first pass: cells

    def cells(self, batches):
        import numpy as np
        import pyarrow as pa

        n = len(self.nodes) * self.width * self.bins
        sums, least, most = np.zeros((self.dims, n)), np.full(n, np.inf), np.full(n, -np.inf)
        for batch in batches:
            for x, place, added in self.rows(batch):
                for f in range(self.width):
                    cell = (place * self.width + f) * self.bins + np.searchsorted(self.cuts[f], x[:, f])
                    for d in range(self.dims):
                        np.add.at(sums[d], cell, added[:, d])
                    np.minimum.at(least, cell, x[:, f])
                    np.maximum.at(most, cell, x[:, f])
        for part in np.array_split(np.flatnonzero(least <= most), max(1, n // 20_000)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part // self.bins), pa.array((part % self.bins).astype(np.int32)), pa.array(least[part]), pa.array(most[part]), pa.array([s.tobytes() for s in np.ascontiguousarray(sums[:, part].T)], pa.binary())],
                ["key", "bin", "least", "most", "sums"],
            )

    def best_of(self, key: int, bins, least, most, sums):
        """(key, quality, value, left, open bins, their bounds, what lies before each) of one node and feature."""
        import numpy as np

        kind = self.rules.kind
        until = np.cumsum(sums, axis=0)
        whole, total = until[-1], number(kind, until[-1])
        top = unsplit(kind, whole)
        left = until[:-1]
        q = quality(kind, left, whole - left)
        ok = np.flatnonzero(self.rules.allowed(left, whole - left, q, top))
        best, value, kept = None, None, None
        if len(ok):
            values = (most[:-1] + least[1:]) / 2
            i = ok[np.lexsort((values[ok], np.round(q[ok], DIGITS)))[0]]
            best, value, kept = float(q[i]), float(values[i]), left[i].tobytes()
        before = until - sums
        bound = quality(kind, before, whole - until, total)
        reach = np.inf if best is None else best + 2 * 10.0**-DIGITS + 1e-9 * abs(best)
        open_ = np.flatnonzero((least < most) & (bound <= reach) & (top - bound > self.rules.min_impurity_decrease))
        return key, best, value, kept, bins[open_].tolist(), bound[open_].tolist(), [b.tobytes() for b in before[open_]]

    def merged(self, batches):
        import numpy as np
        import pyarrow as pa

        kinds = pa.schema([("key", pa.int64()), ("q", pa.float64()), ("value", pa.float64()), ("left", pa.binary()), ("bins", pa.list_(pa.int32())), ("bounds", pa.list_(pa.float64())), ("before", pa.list_(pa.binary()))])

        def done():
            met = np.flatnonzero(most >= least)
            return pa.RecordBatch.from_arrays([pa.array([v], k.type) for v, k in zip(self.best_of(key, met, least[met], most[met], sums[met]), kinds)], schema=kinds)

        key, sums, least, most = None, None, None, None
        for batch in batches:
            keys, bins, lows, highs = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:4])
            added = np.frombuffer(b"".join(batch.column(4).to_pylist())).reshape(-1, self.dims)
            for rows in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1):
                if not len(rows):
                    continue
                if keys[rows[0]] != key:
                    if key is not None:
                        yield done()
                    key = int(keys[rows[0]])
                    sums, least, most = np.zeros((self.bins, self.dims)), np.full(self.bins, np.inf), np.full(self.bins, -np.inf)
                np.add.at(sums, bins[rows], added[rows])
                np.minimum.at(least, bins[rows], lows[rows])
                np.maximum.at(most, bins[rows], highs[rows])
        if key is not None:
            yield done()

    # second pass: values inside open bins

    def inside(self, slots):
        """Rows of open bins as (slot, value, sums), one for each value of a batch; `slots` has a number or -1 for each cell."""

        def run(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                for x, place, added in self.rows(batch):
                    for f in range(self.width):
                        slot = slots[(place * self.width + f) * self.bins + np.searchsorted(self.cuts[f], x[:, f])]
                        met = np.flatnonzero(slot >= 0)
                        met = met[np.lexsort((x[met, f], slot[met]))]
                        if not len(met):
                            continue
                        s, v = slot[met], x[met, f]
                        first = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (v[1:] != v[:-1])))
                        sums = np.add.reduceat(added[met], first, axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(s[first]), pa.array(v[first]), pa.array([r.tobytes() for r in sums], pa.binary())], ["slot", "value", "sums"])

        return run

    def scanned(self, before, totals):
        """Best split inside each slot; rows come sorted by slot and value, and only what goes from batch to batch is held."""

        def run(batches):
            import numpy as np
            import pyarrow as pa

            kinds = pa.schema([("slot", pa.int64()), ("q", pa.float64()), ("value", pa.float64()), ("left", pa.binary())])
            kind, slot, last, left, best = self.rules.kind, None, None, None, None

            def done():
                return pa.RecordBatch.from_arrays([pa.array([v], k.type) for v, k in zip((slot, *best[1]), kinds)], schema=kinds)

            for batch in batches:
                slots, values = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
                added = np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(-1, self.dims)
                for rows in np.split(np.arange(len(slots)), np.flatnonzero(np.diff(slots)) + 1):
                    if not len(rows):
                        continue
                    if slots[rows[0]] != slot:
                        if best:
                            yield done()
                        slot, last, best = int(slots[rows[0]]), None, None
                        left = before[slot]
                    v = values[rows]
                    first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
                    v, s = v[first], np.add.reduceat(added[rows], first, axis=0)
                    until = left + np.cumsum(s, axis=0)
                    # a split lies after each value, once a larger one has come
                    at = np.concatenate(([v[0] if last is None else last], v))
                    sides = np.concatenate(([left], until))
                    new = np.flatnonzero(at[:-1] < at[1:])
                    if last is None:
                        new = new[new > 0]
                    a, b = sides[new], totals[slot] - sides[new]
                    q = quality(kind, a, b)
                    ok = np.flatnonzero(self.rules.allowed(a, b, q, unsplit(kind, totals[slot])))
                    if len(ok):
                        middles = (at[new] + at[new + 1]) / 2
                        i = ok[np.lexsort((middles[ok], np.round(q[ok], DIGITS)))[0]]
                        found = ((round(float(q[i]), DIGITS), float(middles[i])), (float(q[i]), float(middles[i]), a[i].tobytes()))
                        best = found if best is None else min(best, found)
                    left, last = until[-1], v[-1]
            if best:
                yield done()

        return run


def best_splits(held: DataFrame, rules: Rules, width: int, outputs: int, dims: int, cuts: list, weighted: bool, trees: dict[int, Grown], nodes: list[tuple[int, int]]) -> dict:
    """(tree, node) -> (feature, value, left sums) of the best split, for the nodes that have one."""
    import numpy as np

    search = _Search(rules, width, outputs, dims, cuts, weighted, trees, nodes)
    cells = held.select("x", "y", "w").mapInArrow(search.cells, "key long, bin int, least double, most double, sums binary")
    merged = cells.repartition("key").sortWithinPartitions("key").mapInArrow(search.merged, "key long, q double, value double, left binary, bins array<int>, bounds array<double>, before array<binary>")
    best: dict[int, tuple] = {}
    rows = merged.collect()  # one for each node and feature
    for r in rows:
        if r.q is not None:
            i, f = divmod(r.key, width)
            best[i] = min(best.get(i, ((np.inf,),)), ((round(r.q, DIGITS), f, r.value), bytes(r.left)))
    before, totals, of = [], [], []
    slots = np.full(len(nodes) * width * search.bins, -1, np.int64)
    for r in rows:
        i, f = divmod(r.key, width)
        reach = best[i][0][0] + 2 * 10.0**-DIGITS + 1e-9 * abs(best[i][0][0]) if i in best else np.inf
        for b, bound, s in zip(r.bins, r.bounds, r.before):
            if bound <= reach:
                slots[r.key * search.bins + b] = len(of)
                of.append((i, f))
                before.append(np.frombuffer(bytes(s)))
                tree, node = nodes[i]
                totals.append(trees[tree].sums[node])
    if of:
        values = held.select("x", "y", "w").mapInArrow(search.inside(slots), "slot long, value double, sums binary")
        scanned = values.repartition("slot").sortWithinPartitions("slot", "value").mapInArrow(search.scanned(before, totals), "slot long, q double, value double, left binary")
        for r in scanned.collect():  # at most one for each open bin
            i, f = of[r.slot]
            best[i] = min(best.get(i, ((np.inf,),)), ((round(r.q, DIGITS), f, r.value), bytes(r.left)))
    return {nodes[i]: (f, value, np.frombuffer(left)) for i, ((_, f, value), left) in best.items()}


def totals_of(held: DataFrame, kind: str, outputs: int, dims: int, trees: int, weighted: bool) -> list:
    """Sums over all rows, for each tree."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        sums = np.zeros((trees, dims))
        for batch in batches:
            added = contributions(kind, matrix(batch.column(0), outputs), dims)
            sums += matrix(batch.column(1), trees).T @ added if weighted else added.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(trees), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.float64()))], ["tree", "sums"])

    parts = held.select("y", "w").mapInArrow(run, "tree int, sums array<double>").select("tree", F.posexplode("sums").alias("d", "s"))
    out = np.zeros((trees, dims))
    for r in parts.groupBy("tree", "d").agg(F.sum("s").alias("s")).collect():  # trees times sums
        out[r.tree, r.d] = r.s
    return list(out)


def grow_all(held: DataFrame, kind: str, width: int, outputs: int, dims: int, n_trees: int = 1, weighted: bool = False, max_depth: int = 10, bins: int = BINS, **rules) -> list[Grown]:
    """Trees over `held` (x: features, y: outputs or class number, w: a weight for each tree), level by level, all side by side."""
    trees = {t: Grown.root(s) for t, s in enumerate(totals_of(held, kind, outputs, dims, n_trees, weighted))}
    cuts = cuts_of(held, width, bins)
    open_nodes = [(t, 0) for t in trees]
    at_once = max(1, MOST_NUMBERS // ((dims + 2) * width * (max((len(c) for c in cuts), default=0) + 1)))
    for _ in range(max_depth):
        new = []
        for lo in range(0, len(open_nodes), at_once):
            found = best_splits(held, Rules(kind, **rules), width, outputs, dims, cuts, weighted, trees, open_nodes[lo : lo + at_once])
            for t, node in sorted(found):
                f, value, left = found[t, node]
                trees[t].split(node, f, value, left)
                new += [(t, trees[t].child[node]), (t, trees[t].child[node] + 1)]
        open_nodes = new
        if not open_nodes:
            break
    return list(trees.values())

