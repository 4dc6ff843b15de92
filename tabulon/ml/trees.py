"""Decision trees grown level by level, and forests of them.

Trees over ordered features grow from histograms (tabulon.ml.histograms), all trees of a forest side by side. Trees that
split by equality count rows by (node, feature, value), and one aggregate takes the best split of each node. One row for
each open node reaches the driver. A small tree predicts by one CASE expression; larger ones, and forests, are arrays that
rows walk in Arrow batches, so no plan grows with trees or depth.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.scalars import seeded_hash
from tabulon.ml import histograms
from tabulon.ml.preprocess import Fitted

MOST_CLASSES = 1000
#: Nodes up to which a tree predicts by an expression.
SMALL = 63


@dataclass(frozen=True)
class Tree(Fitted):
    """nodes: id -> {feature, op ("eq", "le" or "multi"), value, children (value -> id, or [left, right]), out}; `out` is a list where there are more outputs."""

    features: list[str]
    classes: list
    nodes: dict = field(default_factory=dict)
    outputs: int = 1

    def _test(self, node: dict, value) -> Column:
        c = F.col(node["feature"])
        return c <= F.lit(value) if node["op"] == "le" else c.eqNullSafe(F.lit(value))

    def expression(self, leaf) -> Column:
        """leaf(node) at the end of each path."""

        def walk(i) -> Column:
            node = self.nodes[str(i)]
            if not node.get("children"):
                return leaf(node)
            if node["op"] == "multi":
                out = None
                for value, child in node["children"]:
                    test = self._test(node, value)
                    out = F.when(test, walk(child)) if out is None else out.when(test, walk(child))
                return out.otherwise(leaf({"out": None}))
            left, right = node["children"]
            return F.when(self._test(node, node["value"]), walk(left)).otherwise(walk(right))

        return walk(0)

    def leaf(self, among: Sequence[int] | None = None) -> Column:
        """The leaf that a row ends in; -1 where there is none, or none of those `among`."""
        walker = Walker([self])
        kept = None if among is None else set(among)

        def run(columns):
            import numpy as np

            at = walker.leaves(columns)[0]
            if kept is None:
                return at
            wanted = np.zeros(len(self.nodes) + 1, bool)
            wanted[list(kept)] = True
            return np.where(wanted[at], at, -1)

        return batched(run, "int", self.features)

    def transform(self, df: DataFrame, name: str = "prediction", unseen=None, legacy_int: bool = False) -> DataFrame:
        """Classes: the likeliest, of equals the smallest; regression: the mean, cut to an integer if `legacy_int`, or all outputs' means.

        A value that learning never met gives `unseen`: unless told, -1 for numeric classes and NULL for others.
        """
        if not self.classes:
            if self.outputs > 1 or len(self.nodes) > SMALL:
                out = mean_of([self], [1.0], 0.0, self.outputs)
            else:
                out = self.expression(lambda n: F.lit(n["out"]).cast("double"))
            return df.withColumn(name, F.floor(out) if legacy_int else out)
        if unseen is None and isinstance(self.classes[0], (int, float)):
            unseen = -1
        best = lambda p: unseen if p is None else self.classes[p.index(max(p))]
        if len(self.nodes) <= SMALL:
            return df.withColumn(name, self.expression(lambda n: F.lit(best(n["out"]))))
        of_leaf = [n["out"].index(max(n["out"])) if "out" in n else -1 for n in self._in_order()]
        code = batched(lambda columns, walker=Walker([self]): _lookup(of_leaf, walker.leaves(columns)[0]), "int", self.features)
        return df.withColumn(name, F.coalesce(F.get(F.array(*map(F.lit, self.classes)), code), F.lit(unseen)))

    def probabilities(self, df: DataFrame, name: str = "probabilities") -> DataFrame:
        none = [0.0] * len(self.classes)
        if len(self.nodes) <= SMALL:
            return df.withColumn(name, self.expression(lambda n: F.array(*(F.lit(float(x)) for x in (n["out"] or none)))))
        of_leaf = [n.get("out") or none for n in self._in_order()] + [none]
        return df.withColumn(name, batched(lambda columns, walker=Walker([self]): [of_leaf[i] for i in walker.leaves(columns)[0].tolist()], "array<double>", self.features))

    def _in_order(self) -> list[dict]:
        return [self.nodes[str(i)] for i in range(len(self.nodes))]


def _lookup(values: list, at):
    """values[at]; -1 stays."""
    import numpy as np

    return np.append(np.array(values, np.int64), -1)[at]


def batched(run, kind: str, features: Sequence[str]) -> Column:
    """A column of run(Arrow arrays of the features), over batches."""
    import pyarrow as pa

    @F.arrow_udf(kind)
    def walked(rows):
        out = run(rows.flatten())
        return pa.array(out, {"int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}[kind])

    return walked(F.struct(*features))


class Walker:
    """Trees over the same features as arrays: leaves(columns) gives each tree's leaf of every row, -1 for none."""

    def __init__(self, trees: Sequence[Tree]):
        import numpy as np

        self.trees, features = [], trees[0].features
        of = {f: i for i, f in enumerate(features)}
        ops = {n["op"] for t in trees for n in t.nodes.values() if n.get("children")}
        self.ordered = ops <= {"le"}
        self.values: list[dict] = [{} for _ in features]  # value -> code, where splits are by equality
        for tree in trees:
            nodes = tree._in_order()
            feature, threshold, child = np.full(len(nodes), -1, np.int32), np.zeros(len(nodes)), np.full(len(nodes), -1, np.int32)
            multi: dict[int, dict[int, int]] = {}
            for i, node in enumerate(nodes):
                if not node.get("children"):
                    continue
                f = feature[i] = of[node["feature"]]
                code = lambda v, f=f: self.values[f].setdefault(v, len(self.values[f]))
                if node["op"] == "multi":
                    multi[i] = {code(v): j for v, j in node["children"]}
                else:
                    child[i], threshold[i] = node["children"][0], node["value"] if node["op"] == "le" else code(node["value"])
            self.trees.append((feature, threshold, child, multi))

    def leaves(self, columns) -> list:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.ordered:
            x = np.stack([c.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) for c in columns], axis=1) if columns else None
            return [histograms.walk(t[:3], x) for t in self.trees]
        codes = np.stack([pc.fill_null(pc.index_in(c, pa.array(list(v), c.type)), -1).to_numpy(zero_copy_only=False) for c, v in zip(columns, self.values)], axis=1)
        out = []
        for feature, threshold, child, multi in self.trees:
            tables = {}
            for node, children in multi.items():
                tables[node] = np.full(len(self.values[feature[node]]) + 1, -1, np.int32)
                tables[node][list(children)] = list(children.values())
            at, rows = np.zeros(len(codes), np.int32), np.arange(len(codes))
            while True:
                rows = rows[(at[rows] >= 0) & (feature[at[rows]] >= 0)]
                if not len(rows):
                    break
                here = at[rows]
                code = codes[rows, feature[here]]
                if multi:
                    for node in np.unique(here).tolist():
                        mine = rows[here == node]
                        at[mine] = tables[node][codes[mine, feature[node]]]
                else:
                    at[rows] = child[here] + (code != threshold[here])
            out.append(at)
        return out


def mean_of(trees: Sequence[Tree], weights: Sequence[float], start: float, outputs: int = 1) -> Column:
    """start and the weighted sum of the trees' values."""
    walker = Walker(trees)

    def run(columns):
        import numpy as np

        leaves = walker.leaves(columns)
        total = np.full((len(columns[0]), outputs), start)
        for tree, weight, at in zip(trees, weights, leaves):
            total += weight * np.array([n["out"] if outputs > 1 else [n["out"]] for n in tree._in_order()], float)[at]
        return total[:, 0] if outputs == 1 else total.tolist()

    return batched(run, "double" if outputs == 1 else "array<double>", trees[0].features)


def _impurity(kind: str, sums: list[Column], n: Column) -> Column:
    """Times n: n x Gini, n x entropy, or the sum of squares around the mean (sums: count, sum, sum of squares)."""
    if kind == "sse":
        return F.greatest(sums[1] - F.try_divide(sums[0] * sums[0], n), F.lit(0.0))
    if kind == "entropy":
        return sum((F.when(s > 0, -s * F.log(s / n)).otherwise(0.0) for s in sums), F.lit(0.0))
    return n - sum((F.try_divide(s * s, n) for s in sums), F.lit(0.0))


def _cells(df: DataFrame, features: Sequence[str], sums: list[str], kind_of: str, node: str) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(i).alias("f"), F.col(f).cast(kind_of).alias("value")) for i, f in enumerate(features)))
    return df.select(node, "n", *sums, F.explode(rows).alias("r")).select(node, "n", *sums, "r.*").groupBy(node, "f", "value").agg(*(F.sum(c).alias(c) for c in ("n", *sums)))


def _judged(made: DataFrame, sums: list[str], kind: str, node: str) -> DataFrame:
    """Quality of each row's split from the sums left of it (l_) and of all (t_)."""
    n, m, t = F.col("l_n"), F.col("t_n") - F.col("l_n"), F.col("t_n")
    a, b = [F.col(f"l_{c}") for c in sums], [F.col(f"t_{c}") - F.col(f"l_{c}") for c in sums]
    la, lb = _impurity(kind, a, n), _impurity(kind, b, m)
    quality = (n * la + m * lb) / t if kind == "sse" else (la + lb) / t
    top = _impurity(kind, [F.col(f"t_{c}") for c in sums], t) / (F.lit(1.0) if kind == "sse" else t)
    return made.filter(F.col("value").isNotNull()).select(node, "f", "value", n.alias("n_left"), m.alias("n_right"), quality.alias("quality"), top.alias("impurity"), *(F.col(f"l_{c}") for c in sums))


def split_table(df: DataFrame, features: Sequence[str], sums: list[str], kind: str, continuous: bool, node: str = "node", bins: int = 64) -> DataFrame:
    """node, feature, value, n and quality of every split; `n` and the columns `sums` of df are what a row counts for.

    Quality is the weighted impurity of the two sides (for squares: each side's share times its sum of squares), lower is better.
    Ordered values are scanned bin by bin (at most `bins` by quantiles), each from what lies in the bins before it.
    """
    cols = ("n", *sums)
    cells = _cells(df, features, sums, "double" if continuous else "string", node)
    whole = cells.groupBy(node, "f").agg(*(F.sum(c).alias(f"t_{c}") for c in cols))
    if continuous:
        shares = F.array(*(F.lit(i / bins) for i in range(1, bins)))
        cuts = cells.groupBy("f").agg(F.array_distinct(F.percentile_approx("value", shares, F.lit(4 * bins))).alias("cuts"))
        placed = cells.join(F.broadcast(cuts), "f").withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")  # one row a feature
        by_bin = placed.groupBy(node, "f", "bin").agg(F.min("value").alias("least"), *(F.sum(c).alias(f"b_{c}") for c in cols))
        of_bins = Window.partitionBy(node, "f").orderBy("bin")  # at most `bins` rows
        before = {c: F.coalesce(F.sum(f"b_{c}").over(of_bins.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) for c in cols}
        by_bin = by_bin.select(node, "f", "bin", F.lead("least").over(of_bins).alias("after"), *(v.alias(f"b_{c}") for c, v in before.items()))
        order = Window.partitionBy(node, "f", "bin").orderBy("value")
        left = {c: F.col(f"b_{c}") + F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)) for c in cols}
        value = (F.col("value") + F.coalesce(F.lead("value").over(order), F.col("after"))) / 2
        cells = placed.join(by_bin, [node, "f", "bin"])
    else:
        left, value = {c: F.col(c) for c in cols}, F.col("value")
    made = cells.select(node, "f", value.alias("value"), *(v.alias(f"l_{c}") for c, v in left.items())).join(whole, [node, "f"])
    return _judged(made, sums, kind, node).drop(*(f"l_{c}" for c in sums))


def _classes(held: DataFrame, label: str) -> list:
    classes = [r[0] for r in held.select(label).distinct().orderBy(label).limit(MOST_CLASSES + 1).collect()]
    if not classes or len(classes) > MOST_CLASSES:
        raise ValueError(f"there are no classes, or over {MOST_CLASSES}")
    return classes


def _code(label: str, classes: list) -> Column:
    return (F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1).cast("double")


def _one_hot(df: DataFrame, features, label: str, weight: str | None):
    """Rows with their weight n and a column of weights for each class."""
    held = df.dropna(subset=[*features, label])
    classes = _classes(held, label)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    sums = [f"s{i}" for i in range(len(classes))]
    return held.withColumns({"n": w} | {s: F.when(F.col(label) == c, w).otherwise(0.0) for s, c in zip(sums, classes)}), sums, classes


def _ordered(df: DataFrame, features: Sequence[str], label: str | Sequence[str], task: str, weights: Column | None):
    """x, y, w for histograms, the classes, and the outputs' means: they are taken off, so that sums of squares don't cancel."""
    labels = [label] if isinstance(label, str) else list(label)
    held = df.dropna(subset=[*features, *labels])
    classes, means = [], [0.0] * len(labels)
    if task == "regress":
        means = list(held.agg(*(F.avg(F.col(c).cast("double")) for c in labels)).first())
        if means[0] is None:
            raise ValueError("nothing to fit")
        y = [F.col(c).cast("double") - F.lit(m) for c, m in zip(labels, means)]
    else:
        classes = _classes(held, label)
        y = [_code(label, classes)]
    w = F.lit(None).cast("array<double>") if weights is None else weights
    return held.select(F.array(*(F.col(f).cast("double") for f in features)).alias("x"), F.array(*y).alias("y"), w.alias("w")), classes, means


def _named(grown: histograms.Grown, features: Sequence[str], classes: list, means: list[float], leaf: str) -> Tree:
    tree = Tree(list(features), classes, {}, len(means))
    for i, s in enumerate(grown.sums):
        n = float(s.sum() if classes else s[0]) or 1.0  # a tree may have drawn no row
        out = (s / n).tolist() if classes else [float(a / n + m) for a, m in zip(s[1:-1], means)]
        if classes and leaf == "majority":
            out = [float(j == out.index(max(out))) for j in range(len(classes))]
        node = {"n": n, "out": out if classes or len(means) > 1 else out[0]}
        if grown.feature[i] >= 0:
            node |= {"feature": features[grown.feature[i]], "op": "le", "value": grown.threshold[i], "children": [grown.child[i], grown.child[i] + 1]}
        tree.nodes[str(i)] = node
    return tree


def grow_ordered(df: DataFrame, features: Sequence[str], label: str | Sequence[str], task: str, weights: Column | None = None, n_trees: int = 1, leaf: str = "probabilities", **options) -> list[Tree]:
    """Trees by midpoints of distinct values, `weights` an array with a weight for each; several labels make vector leaves."""
    rows, classes, means = _ordered(df, features, label, task, weights)
    held = rows.persist()
    try:
        kind = "sse" if task == "regress" else "gini"
        dims = len(means) + 2 if kind == "sse" else len(classes)
        made = histograms.grow_all(held, kind, len(features), len(means), dims, n_trees, weights is not None, **options)
    finally:
        held.unpersist()
    return [_named(g, features, classes, means, leaf) for g in made]


def grow(df: DataFrame, features: Sequence[str], label: str | Sequence[str], task: str = "classify", continuous: bool | None = None, max_depth: int = 10, min_samples_split: int = 2, min_samples_leaf: int = 1, min_impurity_decrease: float = 0.0, leaf: str = "probabilities", weight: str | None = None) -> Tree:
    """task classify (Gini) or regress (squares). Splits by equality, or by midpoints of distinct values if continuous.

    leaf="majority" keeps only the likeliest class of a leaf. Of equal splits the first feature's smallest value wins.
    Regression takes ordered features; several labels are learned together, and a leaf has a value for each.
    """
    rules = {"min_samples_split": min_samples_split, "min_samples_leaf": min_samples_leaf, "min_impurity_decrease": min_impurity_decrease}
    if task == "regress" or continuous:
        if continuous is False:
            raise ValueError("regression splits ordered features")
        return grow_ordered(df, features, label, task, F.array(F.col(weight).cast("double")) if weight else None, leaf=leaf, max_depth=max_depth, **rules)[0]
    held, sums, classes = _one_hot(df, features, label, weight)
    held = held.select(*features, "n", *sums).persist()
    kinds, cols = dict(df.dtypes), ("n", *sums)
    tree = Tree(list(features), classes, {"0": {}})
    spark = df.sparkSession
    try:
        first = held.agg(*(F.sum(c) for c in cols)).first()
        totals = {0: list(first)}
        for depth in range(max_depth + 1):
            for i, t in totals.items():
                out = [x / t[0] for x in t[1:]]
                tree.nodes[str(i)] |= {"n": t[0], "out": [float(j == out.index(max(out))) for j in range(len(classes))] if leaf == "majority" else out}
            if depth == max_depth or not totals:
                break
            placed = held.withColumn("node", F.lit(0)) if depth == 0 else held.withColumn("node", tree.leaf(list(totals))).filter("node >= 0")
            whole = spark.createDataFrame([(i, *map(float, t)) for i, t in totals.items()], "node int, " + ", ".join(f"t_{c} double" for c in cols))
            cells = _cells(placed, features, sums, "string", "node").select("node", "f", "value", *(F.col(c).alias(f"l_{c}") for c in cols))
            table = _judged(cells.join(F.broadcast(whole), "node"), sums, "gini", "node")  # one row for each open node
            ok = table.filter((F.col("n_left") >= min_samples_leaf) & (F.col("n_right") >= min_samples_leaf) & (F.col("n_left") + F.col("n_right") >= min_samples_split) & (F.col("impurity") - F.col("quality") > F.lit(min_impurity_decrease) + 1e-12))
            best = ok.groupBy("node").agg(F.min(F.struct(F.round("quality", 10).alias("q"), "f", "value", F.array("n_left", *(f"l_{c}" for c in sums)).alias("left"))).alias("b")).select("node", "b.*").collect()
            new = {}
            for r in sorted(best, key=lambda r: r.node):
                name = features[r.f]
                first = len(tree.nodes)
                tree.nodes[str(r.node)] |= {"feature": name, "op": "eq", "value": r.value if kinds[name] == "string" else type_of(kinds[name])(r.value), "children": [first, first + 1]}
                for j, t in ((first, r.left), (first + 1, [a - b for a, b in zip(totals[r.node], r.left)])):
                    tree.nodes[str(j)], new[j] = {}, t
            totals = new
    finally:
        held.unpersist()
    return tree


def type_of(kind: str):
    if kind in ("int", "bigint", "smallint", "tinyint"):
        return int
    if kind == "boolean":
        return lambda text: text == "true"
    return float


def gain_table(df: DataFrame, features: Sequence[str], sums: list[str], node: str = "node") -> DataFrame:
    """node, f, gain: information gain (natural log) of splitting by all values of a feature."""
    rows = F.array(*(F.struct(F.lit(i).alias("f"), F.col(f).cast("string").alias("value")) for i, f in enumerate(features)))
    cells = df.select(node, "n", *sums, F.explode(rows).alias("r")).select(node, "n", *sums, "r.*").groupBy(node, "f", "value").agg(*(F.sum(c).alias(c) for c in ("n", *sums)))
    inner = cells.withColumn("e", _impurity("entropy", [F.col(s) for s in sums], F.col("n")))
    by = inner.groupBy(node, "f").agg(F.sum("e").alias("inner"), F.count(F.lit(1)).alias("k"), *(F.sum(c).alias(c) for c in ("n", *sums)))
    return by.select(node, "f", "k", (F.try_divide(_impurity("entropy", [F.col(s) for s in sums], F.col("n")) - F.col("inner"), F.col("n"))).alias("gain"))


def grow_id3(df: DataFrame, features: Sequence[str], label: str, max_depth: int | None = None, min_samples_split: int = 2) -> Tree:
    """A branch for each value of the feature with most information gain; a feature is used once on a path; an unseen value gives no class."""
    held, sums, classes = _one_hot(df, features, label, None)
    held = held.select(*features, "n", *sums).persist()
    tree, used = Tree(list(features), classes, {"0": {}}), {0: frozenset()}
    kinds = dict(df.dtypes)
    try:
        open_nodes = [0]
        for depth in range((len(features) if max_depth is None else min(max_depth, len(features))) + 1):
            placed = held.withColumn("node", tree.leaf(open_nodes)).filter("node >= 0") if depth else held.withColumn("node", F.lit(0))
            for r in placed.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("n", *sums))).collect():
                tree.nodes[str(r.node)] |= {"n": r.n, "out": [r[s] / r.n for s in sums]}
            splittable = [i for i in open_nodes if max(tree.nodes[str(i)]["out"]) < 1 and tree.nodes[str(i)]["n"] >= min_samples_split and len(used[i]) < len(features)]
            if not splittable or depth == (len(features) if max_depth is None else min(max_depth, len(features))):
                break
            gains: dict[int, tuple] = {}
            for r in gain_table(placed, features, sums).collect():  # open nodes times features
                if r.node in splittable and r.f not in used[r.node] and r.k > 1:
                    gains[r.node] = max(gains.get(r.node, (0.0, 1)), (round(r.gain, 12), -r.f))
            chosen = {i: -f for i, (g, f) in gains.items() if g > 0}
            pick = None
            for i, f in chosen.items():
                v = F.col(features[f]).cast("string")
                pick = F.when(F.col("node") == i, v) if pick is None else pick.when(F.col("node") == i, v)
            if pick is None:
                break
            values: dict[int, list] = {}
            for r in placed.select("node", pick.alias("v")).dropna().distinct().orderBy("node", "v").collect():
                values.setdefault(r.node, []).append(r.v)
            open_nodes = []
            for i, vs in values.items():
                name = features[chosen[i]]
                cast = str if kinds[name] == "string" else type_of(kinds[name])
                children = []
                for v in vs:
                    j = len(tree.nodes)
                    tree.nodes[str(j)], used[j] = {}, used[i] | {chosen[i]}
                    children.append([cast(v), j])
                    open_nodes.append(j)
                tree.nodes[str(i)] |= {"feature": name, "op": "multi", "children": children}
    finally:
        held.unpersist()
    return tree


def bootstrap_weight(key: Column, seed: int | Column) -> Column:
    """How often a row is drawn: Poisson(1) from a hash of its key, so the same in every run."""
    u = F.conv(F.substring(seeded_hash(key, seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    total, p, out = 0.0, 0.36787944117144233, None
    for k in range(8):
        total += p
        out = F.when(u < total, k) if out is None else out.when(u < total, k)
        p /= k + 1
    return out.otherwise(8)


@dataclass(frozen=True)
class Forest(Fitted):
    trees: list[Tree]

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Majority of the trees' classes, of equals the smallest; or the mean of their values (of each output)."""
        trees, classes = self.trees, self.trees[0].classes
        if not classes:
            return df.withColumn(name, mean_of(trees, [1 / len(trees)] * len(trees), 0.0, trees[0].outputs))
        walker = Walker(trees)
        votes = [[n["out"].index(max(n["out"])) for n in t._in_order()] for t in trees]

        def run(columns):
            import numpy as np

            counts = np.zeros((len(columns[0]), len(classes)), np.int32)
            rows = np.arange(len(counts))
            for vote, at in zip(votes, walker.leaves(columns)):
                counts[rows, np.array(vote)[at]] += 1
            return counts.argmax(axis=1)

        return df.withColumn(name, F.get(F.array(*map(F.lit, classes)), batched(run, "int", trees[0].features)))


def grow_forest(df: DataFrame, features: Sequence[str], label: str | Sequence[str], key: str, n_estimators: int = 100, task: str = "classify", seed: int = 0, threads: int = 4, continuous: bool | None = None, **options) -> Forest:
    """Trees over bootstrap samples, all features each. Over ordered features all grow in the same passes; by equality, some side by side."""
    if task == "regress" or continuous:
        draws = F.transform(F.sequence(F.lit(seed), F.lit(seed + n_estimators - 1)), lambda i: bootstrap_weight(F.col(key), i).cast("double"))
        return Forest(grow_ordered(df, features, label, task, draws, n_estimators, **options))

    from concurrent.futures import ThreadPoolExecutor
    from contextvars import copy_context

    held = df.select(key, *features, label).persist()

    def one(i: int) -> Tree:
        drawn = held.withColumn("_w", bootstrap_weight(F.col(key), seed + i)).filter("_w > 0")
        return grow(drawn, features, label, task, weight="_w", **options)

    try:
        with ThreadPoolExecutor(threads) as pool:
            return Forest([f.result() for f in [pool.submit(copy_context().run, one, i) for i in range(n_estimators)]])
    finally:
        held.unpersist()
