"""SQL of models that learn in rounds: each round is a table of its own, so any engine can check them."""

from __future__ import annotations

from collections.abc import Sequence


def _split(level: int, features: Sequence[str], sums: Sequence[str], kind: str, continuous: bool) -> list[str]:
    """Tables best{level} (the chosen split of each node) from the rows n{level}; nodes 2 i and 2 i + 1 are the children of i."""
    value = "{}" if continuous else "CAST({} AS VARCHAR)"
    long = " UNION ALL ".join(f"SELECT node, {i} AS f, {value.format(f)} AS value, w, {', '.join(sums)} FROM n{level} WHERE w > 0 AND node >= {2**level}" for i, f in enumerate(features))
    cols = ["w", *sums]
    made = [f"c{level} AS (SELECT node, f, value, {', '.join(f'sum({x}) AS {x}' for x in cols)} FROM ({long}) GROUP BY ALL)"]
    if continuous:
        left = ", ".join(f"sum({x}) OVER (PARTITION BY node, f ORDER BY value) AS l_{x}" for x in cols)
        at = "(value + lead(value) OVER (PARTITION BY node, f ORDER BY value)) / 2 AS value"
    else:
        left, at = ", ".join(f"{x} AS l_{x}" for x in cols), "value"
    whole = ", ".join(f"sum({x}) OVER (PARTITION BY node, f) AS t_{x}" for x in cols)
    made.append(f"k{level} AS (SELECT node, f, {at}, {left}, {whole} FROM c{level})")

    def impurity(s: Sequence[str], n: str) -> str:
        if kind == "sse":
            squares = " + ".join(f"{x} * {x}" for x in s[:-1])
            return f"greatest({s[-1]} - ({squares}) / {n}, 0)"
        return f"({n} - " + " - ".join(f"{x} * {x} / {n}" for x in s) + ")"

    a, b, t = [f"l_{x}" for x in sums], [f"(t_{x} - l_{x})" for x in sums], [f"t_{x}" for x in sums]
    left, right = impurity(a, "l_w"), impurity(b, "(t_w - l_w)")
    quality = f"(l_w * {left} + (t_w - l_w) * {right}) / t_w" if kind == "sse" else f"({left} + {right}) / t_w"
    top = impurity(t, "t_w") if kind == "sse" else f"{impurity(t, 't_w')} / t_w"
    made.append(f"q{level} AS (SELECT node, f, value, {quality} AS quality, {top} AS impurity FROM k{level} WHERE value IS NOT NULL AND l_w >= 1 AND t_w - l_w >= 1)")
    made.append(f"best{level} AS (SELECT * FROM q{level} WHERE impurity - quality > 1e-12 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(quality, 10), f, value) = 1)")
    return made


def tree(rows: str, key: str, features: Sequence[str], depth: int, kind: str, continuous: bool, outputs: Sequence[str] = ()) -> str:
    """Tables that end in `p` (key, prediction): a tree over `rows` (key, y, w, features), a row weighing w.

    kind "gini": y is 0 or 1, the likelier class, of equals 0; "sse": the mean of y, or of each of the `outputs` as a list.
    """
    sums = ["s0", "s1"]
    if outputs:
        sums = [f"s{i}" for i in range(len(outputs) + 1)]
        means = [f"(SELECT sum(w * {y}) / sum(w) FROM {rows})" for y in outputs]
        off = [f"({y} - {m})" for y, m in zip(outputs, means)]
        start = ", ".join(f"w * {o} AS s{i}" for i, o in enumerate(off)) + ", w * (" + " + ".join(f"{o} * {o}" for o in off) + f") AS s{len(off)}"
        out = "[" + ", ".join(f"sum(s{i}) / sum(w) + {m}" for i, m in enumerate(means)) + "]"
    elif kind == "sse":
        mean = f"(SELECT sum(w * y) / sum(w) FROM {rows})"
        start = f"w * (y - {mean}) AS s0, w * (y - {mean}) * (y - {mean}) AS s1"
        out = f"sum(s0) / sum(w) + {mean}"
    else:
        start = "CASE WHEN y = 0 THEN w ELSE 0 END AS s0, CASE WHEN y = 1 THEN w ELSE 0 END AS s1"
        out = "CASE WHEN sum(s1) > sum(s0) THEN 1 ELSE 0 END"
    made = [f"n0 AS MATERIALIZED (SELECT {key}, w, {', '.join(features)}, {start}, 1 AS node FROM {rows})"]
    for level in range(depth):
        made += _split(level, features, sums, kind, continuous)
        chosen = "CASE b.f " + " ".join(f"WHEN {i} THEN {f'r.{f}' if continuous else f'CAST(r.{f} AS VARCHAR)'}" for i, f in enumerate(features)) + " END"
        test = f"{chosen} {'<=' if continuous else '='} b.value"
        made.append(f"n{level + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN r.node WHEN {test} THEN 2 * r.node ELSE 2 * r.node + 1 END AS node FROM n{level} r LEFT JOIN best{level} b ON b.node = r.node)")
    made.append(f"leaf AS (SELECT node, {out} AS prediction FROM n{depth} WHERE w > 0 GROUP BY 1)")
    made.append(f"p AS (SELECT {key}, prediction FROM n{depth} JOIN leaf USING (node))")
    return ", ".join(made)


def id3(rows: str, key: str, features: Sequence[str], depth: int) -> str:
    """Tables that end in `p` (key, prediction): a branch for each value of the most telling feature; y is 0 or 1."""
    made = [f"n0 AS MATERIALIZED (SELECT {key}, y, {', '.join(features)}, '' AS node, '' AS used FROM {rows})"]
    entropy = lambda a, n: f"(CASE WHEN {a} > 0 THEN -{a} * ln({a} / {n}) ELSE 0 END + CASE WHEN {n} - {a} > 0 THEN -({n} - {a}) * ln(({n} - {a}) / {n}) ELSE 0 END)"
    for d in range(depth):
        long = " UNION ALL ".join(f"SELECT node, {i} AS f, CAST({f} AS VARCHAR) AS value, y FROM n{d} WHERE length(used) = {d} AND position('{i}' IN used) = 0" for i, f in enumerate(features))
        made.append(f"c{d} AS (SELECT node, f, value, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS a FROM ({long}) GROUP BY ALL)")
        made.append(f"g{d} AS (SELECT node, f, count(*) AS k, sum(n) AS n, sum(a) AS a, ({entropy('sum(a)', 'sum(n)')} - sum({entropy('a', 'n')})) / sum(n) AS gain FROM c{d} GROUP BY ALL)")
        made.append(f"best{d} AS (SELECT * FROM g{d} WHERE k > 1 AND gain > 1e-12 AND a > 0 AND a < n QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 12) DESC, f) = 1)")
        value = "CASE b.f " + " ".join(f"WHEN {i} THEN CAST(r.{f} AS VARCHAR)" for i, f in enumerate(features)) + " END"
        made.append(f"n{d + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (node, used), CASE WHEN b.node IS NULL THEN r.node ELSE r.node || '|' || {value} END AS node, CASE WHEN b.node IS NULL THEN r.used ELSE r.used || b.f END AS used FROM n{d} r LEFT JOIN best{d} b ON b.node = r.node)")
    made.append(f"leaf AS (SELECT node, CASE WHEN 2 * sum(y) > count(*) THEN 1 ELSE 0 END AS prediction FROM n{depth} GROUP BY 1)")
    made.append(f"p AS (SELECT {key}, prediction FROM n{depth} JOIN leaf USING (node))")
    return ", ".join(made)


def drawn(key: str, seed: int) -> str:
    """How often a row is drawn: Poisson(1) from the seeded hash of its key."""
    u = f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"
    total, p, out = 0.0, 0.36787944117144233, "CASE"
    for k in range(8):
        total += p
        out += f" WHEN {u} < {total!r}::DOUBLE THEN {k}"
        p /= k + 1
    return out + " ELSE 8 END::DOUBLE"


def kmeans(rows: str, key: str, starts: Sequence[Sequence[float]], rounds: int, name: str = "m") -> str:
    """Tables that end in {name}c (key, a, b, j): clusters of points (a, b) after some rounds; starts are places in the bounding box."""
    at = lambda c, u: f"(SELECT min({c}) + (max({c}) - min({c})) * {u!r}::DOUBLE FROM {rows})"
    made = [f"{name}0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {j} AS j, {at('a', u)} AS a, {at('b', v)} AS b" for j, (u, v) in enumerate(starts)) + ")"]
    place = lambda i: f"SELECT p.{key}, p.a, p.b, m.j FROM {rows} p, {name}{i} m QUALIFY row_number() OVER (PARTITION BY p.{key} ORDER BY (p.a - m.a) * (p.a - m.a) + (p.b - m.b) * (p.b - m.b), m.j) = 1"
    for i in range(rounds):
        made.append(f"{name}{i + 1} AS MATERIALIZED (SELECT m.j, coalesce(avg(x.a), any_value(m.a)) AS a, coalesce(avg(x.b), any_value(m.b)) AS b FROM {name}{i} m LEFT JOIN ({place(i)}) x ON x.j = m.j GROUP BY m.j)")
    made.append(f"{name}c AS MATERIALIZED ({place(rounds)})")
    return ", ".join(made)


def descent(moments: str, n_features: int, gradient: str, alpha: float = 0.0, rate: float = 0.1, rounds: int = 1000, tol: float = 1e-3) -> str:
    """Recursive table `d` (i, t0, t1, ..., moving) from `moments` (n, yy, zyI, zzIJ): descent from all ones.

    gradient "lasso": forward differences of the mean squared error + alpha |weights|; "plain": the mean squared error's half gradient.
    """
    p = n_features + 1
    t = [f"t{i}" for i in range(p)]
    zz = lambda i, j: f"zz{min(i, j)}{max(i, j)}"

    def cost(x: Sequence[str]) -> str:
        square = " + ".join(f"{x[i]} * {x[j]} * {zz(i, j)}" for i in range(p) for j in range(p))
        cross = " + ".join(f"{x[i]} * zy{i}" for i in range(p))
        return f"(({square} - 2 * ({cross}) + yy) / n + {alpha}::DOUBLE * (" + " + ".join(f"abs({v})" for v in x[1:]) + "))"

    if gradient == "lasso":
        slopes = [f"({cost([f'({v} + 0.0001)' if i == k else v for i, v in enumerate(t)])} - {cost(t)}) / 0.0001" for k in range(p)]
    else:
        slopes = ["((" + " + ".join(f"{zz(k, j)} * {t[j]}" for j in range(p)) + f" - zy{k}) / n)" for k in range(p)]
    g = ", ".join(f"{s} AS g{k}" for k, s in enumerate(slopes))
    moving = f"sqrt({' + '.join(f'g{k} * g{k}' for k in range(p))}) > {tol}"
    step = ", ".join(f"CASE WHEN {moving} THEN t{k} - {rate}::DOUBLE * g{k} ELSE t{k} END" for k in range(p))
    return f"d AS (SELECT 0 AS i, {', '.join(f'1.0::DOUBLE AS {v}' for v in t)}, true AS moving UNION ALL SELECT i + 1, {step}, {moving} FROM (SELECT d.*, {g} FROM d, {moments}) WHERE moving AND i < {rounds})"
