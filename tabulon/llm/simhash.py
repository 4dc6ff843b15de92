"""SimHash near-duplicates: fingerprints, exact links in tiles, components.

Equal fingerprints are one row. Each goes to as many blocks as
the radius plus one: cut into that many bit ranges, two fingerprints within the radius agree in
at least one. A block is a tile: its fingerprints, sorted by population count, are compared by
exclusive-or and bit count; pairs of runs whose counts differ beyond the radius are skipped. A
block with more rows than `tile_rows` is dealt to several tasks as pairs of smaller tiles, one for
every two population counts within the radius, split further where one count alone is too large.
A tile gives no pairs but each row's smallest linked member there; components join those.

Defined cases: a null text is empty; no words give fingerprint 0, which links like any other;
fewer words than a shingle give the whole sequence; repeated rows and repeated ids share a
fingerprint, and an id that stands over unlinked texts joins none of them; a row without an id gets the
component of its fingerprint, which is null where no row of the component has an id; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import stored
from tabulon.llm.components import components, local_roots

TILE_ROWS = 4096


def shingle_hashes(texts: list, size: int):
    """XXH64 (seed 42) of every text's word shingles, end to end, and how many each text has."""
    from itertools import accumulate

    import numpy as np
    import xxhash

    digest, parts, counts = xxhash.xxh64_digest, [], []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(words) <= size:
            if words:
                parts.append(digest(b" ".join(words), 42))
            counts.append(min(len(words), 1))
            continue
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        parts.append(b"".join([digest(joined[s : e - 1], 42) for s, e in zip(starts, ends[size - 1 :])]))
        counts.append(len(words) - size + 1)
    return np.frombuffer(b"".join(parts), dtype=">u8").astype(np.uint64), np.array(counts, dtype=np.int64)


def majority_bits(hashes, counts):
    """For each text the 64 bits that are set in over half its hashes; 0 for none.

    Eight counters lie in one 64-bit lane, so at most 255 hashes are added before they are widened.
    """
    import numpy as np

    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    pieces = -(-n // 255)
    inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = np.repeat(first, pieces) + inner * 255
    groups = np.cumsum(pieces) - pieces
    lane = np.uint64(0x0101010101010101)
    for j in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(j)) & lane, cuts)
        bytes_ = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), groups, axis=0)
        over = bytes_ * 2 > n[:, None]
        for k in range(8):
            out[full] |= over[:, k].astype(np.uint64) << np.uint64(8 * k + j)
    return out


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                fp = majority_bits(*shingle_hashes(part.column(1).to_pylist(), shingle_words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 bit ranges over 64 bits."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    return list(zip(edges, (b - a for a, b in zip(edges, edges[1:]))))


def tiles(distinct: DataFrame, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(key, fp, node): every two fingerprints within the radius share a key, and no key has many times tile_rows rows."""
    blocks = [F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)) for shift, width in _blocks(radius)]
    rows = distinct.select("fp", "node", F.bit_count("fp").alias("pop"), F.posexplode(F.array(*blocks)).alias("block", "value"))
    counts = rows.groupBy("block", "value", "pop").agg(F.count(F.lit(1)).alias("n"))
    large = (
        counts.groupBy("block", "value")
        .agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("n") / tile_rows).cast("int")))).alias("subs"))
        .filter(F.col("total") > tile_rows)
        .select("block", "value", "subs")
    )
    joined = rows.join(large, ["block", "value"], "left")
    own = F.pmod(F.xxhash64("fp", "node"), F.try_element_at("subs", F.col("pop"))).cast("int")
    # partner tiles (population count, part) of a row whose block is large; the pair's key has the smaller one first
    partners = F.expr(
        f"flatten(transform(filter(sequence(pop - {radius}, pop + {radius}), q -> map_contains_key(subs, q)),"
        " q -> transform(sequence(0, try_element_at(subs, q) - 1), s -> struct(q AS q, s AS s))))"
    )
    keyed = joined.withColumn("own", F.struct(F.col("pop").alias("q"), own.alias("s")))
    keys = F.when(F.col("subs").isNull(), F.array(F.xxhash64("block", "value"))).otherwise(
        F.transform(partners, lambda p: F.xxhash64("block", "value", F.least(p, F.col("own")), F.greatest(p, F.col("own"))))
    )
    return keyed.select(F.explode(keys).alias("key"), "fp", "node", "pop")


def _near(fp, pop, radius: int, side: int = 1024):
    """Index pairs within the radius among rows sorted by population count."""
    import numpy as np

    left, right = [], []
    n = len(fp)
    for lo in range(0, n, side):
        a = fp[lo : lo + side]
        reach = pop[min(lo + side, n) - 1] + radius
        for at in range(lo, n, side):
            if pop[at] > reach:
                break
            near = np.bitwise_count(a[:, None] ^ fp[None, at : at + side]) <= radius
            i, j = np.nonzero(near)
            i, j = i + lo, j + at
            keep = i < j
            left.append(i[keep])
            right.append(j[keep])
            if len(left) > 64:  # what is linked already is kept as a forest, not as pairs
                root = local_roots(n, np.concatenate(left), np.concatenate(right))
                below = np.flatnonzero(root != np.arange(n))
                left, right = [below], [root[below]]
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): node a belongs to the component of node b; enough links for all components."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def compared(key, fp, pop, node):
            """Links inside each key; rows are sorted by key, then population count."""
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
            size = ends - starts
            left, right = [], []
            longest = int(size[size <= 48].max(initial=1))
            for d in range(1, longest):  # small tiles: all at once, each row with the d-th after it
                i = np.flatnonzero((key[d:] == key[:-d]) & (pop[d:] - pop[:-d] <= radius))
                i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
                left.append(i)
                right.append(i + d)
            for s, e in zip(starts[size > 48], ends[size > 48]):
                i, j = _near(fp[s:e], pop[s:e], radius)
                left.append(i + s)
                right.append(j + s)
            order = np.argsort(node, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            if not left:
                return None
            i, j = np.concatenate(left), np.concatenate(right)
            root = order[local_roots(len(node), rank[i], rank[j])[rank]]
            below = np.flatnonzero(node[root] != node)
            return pa.RecordBatch.from_arrays([pa.array(node[below]), pa.array(node[root[below]])], ["a", "b"])

        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = [cols[0], cols[1].view(np.uint64), cols[2].astype(np.int64), cols[3]]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            last = np.searchsorted(-(cols[0] == cols[0][-1]).astype(np.int8)[::-1], 0) if len(cols[0]) else 0
            whole = len(cols[0]) - int(last)
            if whole:
                found = compared(*(c[:whole] for c in cols))
                if found is not None:
                    yield found
            held = [c[whole:] for c in cols]
        if held is not None and len(held[0]):
            found = compared(*held)
            if found is not None:
                yield found

    dealt = tiles(distinct, radius, tile_rows).select("key", "fp", F.col("pop").cast("int").alias("pop"), "node")
    return dealt.repartition("key").sortWithinPartitions("key", "pop").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle_words: int = 3, tile_rows: int = TILE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: documents whose fingerprints are joined by steps of at most `radius` bits."""
    prints = stored(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    names = components(links(distinct.select("fp", F.col("fp").alias("node")), radius, tile_rows), "simhash")
    rooted = distinct.join(names, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# Near-duplicates by similarity of shingle sets.

#: 64-bit words of the wide sketch and the rows of a tile; the first two words decide which pairs are compared by all.
WIDE_WORDS, WIDE_TILE = 16, 16_384
#: Two sets share a band if all its least hashes agree: of pairs of 0.8, three in a million share none.
BANDS, BAND_ROWS = 24, 4


def band_keys(hashes, counts):
    """For each set of shingle hashes, BANDS keys of BAND_ROWS least hashes; sets without shingles share theirs."""
    import numpy as np

    rng = np.random.default_rng(7)
    full = np.flatnonzero(counts)
    keys = np.zeros((len(counts), BANDS), dtype=np.uint64)
    if len(full):
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        first = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
        for band in range(BANDS):
            for _ in range(BAND_ROWS):
                xor, times = rng.integers(0, 1 << 32, 2, dtype=np.uint32)
                least = np.minimum.reduceat((low ^ xor) * (times | np.uint32(1)), first)
                keys[full, band] = (keys[full, band] ^ least) * np.uint64(0x9E3779B97F4A7C15)
                keys[full, band] ^= keys[full, band] >> np.uint64(29)
    return keys * np.uint64(0xBF58476D1CE4E5B9) + np.arange(BANDS, dtype=np.uint64)


def sketches(docs: DataFrame, shingle_words: int) -> DataFrame:
    """id0, h, n (distinct shingles), 16 SimHash words over the set of a text's shingles (the first is the fingerprint), and its band keys."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                hashes, counts = shingle_hashes(part.column(2).to_pylist(), shingle_words)
                order = np.lexsort((hashes, np.repeat(np.arange(len(counts)), counts)))
                owner, hashes = np.repeat(np.arange(len(counts)), counts)[order], hashes[order]
                first = np.ones(len(hashes), dtype=bool)
                first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                hashes, counts = hashes[first], np.bincount(owner[first], minlength=len(counts))
                words = [majority_bits(hashes, counts)]
                for k in range(1, WIDE_WORDS):
                    x = hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
                    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                    words.append(majority_bits(x ^ (x >> np.uint64(32)), counts))
                wide = np.stack(words, axis=1).astype("<u8")
                keys = pa.ListArray.from_arrays(np.arange(0, BANDS * len(counts) + 1, BANDS, dtype=np.int32), pa.array(band_keys(hashes, counts).view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array([row.tobytes() for row in wide], pa.binary()), keys], ["id0", "h", "n", "wide", "keys"])

    return docs.mapInArrow(run, "id0 long, h long, n long, wide binary, keys array<long>")


def _radii(similarity: float, bits: int, deviations: float = 6.0):
    """Differing bits of two sketches beyond which sets are not as similar, by the smaller set's size (the last: all larger).

    A bit differs where the majorities of two sets do, at the worst split into shared and own shingles; small sets are no
    normal case. Beyond six deviations lies fewer than one pair in a million of those just as similar.
    """
    from math import ceil, comb

    import numpy as np

    def reached(n):
        """Chance of at least 0, 1, ..., n + 1 bits among n."""
        return np.cumsum(np.array([0.0, *(comb(n, k) / 2**n for k in range(n, -1, -1))]))[::-1]

    def differ(shared, *own):
        bits = np.arange(shared + 1)
        over = [reached(n)[np.clip((shared + n) // 2 + 1 - bits, 0, n + 1)] for n in own]
        return float((np.diff(-reached(shared)) * (over[0] * (1 - over[1]) + over[1] * (1 - over[0]))).sum())

    worst = [0.0]
    for n in range(1, 41):
        splits = [(s, n - s, m - s) for m in range(n, int(n / similarity) + 1) for s in range(max(0, ceil(similarity * (n + m) / (1 + similarity) - 1e-9)), n + 1)]
        worst.append(max(differ(*x) for x in splits))
    worst[-1] = max(worst[-8:])
    p = np.array(worst)
    return (bits * p + deviations * np.sqrt(bits * p * (1 - p))).astype(np.int64) + 1


def _forest(n: int, left, right, distance):
    """Indices of the links of a shortest spanning forest over n nodes."""
    import numpy as np

    order = np.argsort(distance, kind="stable")
    root, kept = np.arange(n), []
    a, b = left[order], right[order]
    while len(order):
        apart = a != b
        order, a, b = order[apart], a[apart], b[apart]
        first = np.full(n, len(order))
        np.minimum.at(first, a, np.arange(len(order)))
        np.minimum.at(first, b, np.arange(len(order)))
        chosen = np.unique(first[first < len(order)])
        if not len(chosen):
            break
        kept.append(order[chosen])
        root = local_roots(n, np.concatenate([left[k] for k in kept]), np.concatenate([right[k] for k in kept]))
        a, b = root[left[order]], root[right[order]]
    return np.concatenate(kept) if kept else np.zeros(0, dtype=np.int64)


def _band_links(distinct: DataFrame, similarity: float, tile_rows: int) -> DataFrame:
    """(a, b) candidates whose sketches are near, among sets that share a band.

    A band's sets are a tile; those of a larger one are dealt in parts, and every two parts are a tile. A tile gives a
    shortest spanning forest of its candidates, which is never more than its rows: what candidates join, these join too.
    """
    every = distinct.select(F.explode("keys").alias("key"), "node")
    shared = stored(every.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("parts"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("key", "parts"), "shared")
    members = stored(every.join(shared, "key").groupBy("node").agg(F.collect_list(F.struct("key", "parts")).alias("bands")), "members")
    rows = distinct.join(members, "node").select(F.explode("bands").alias("band"), "node", "n", "wide").select("band.key", "band.parts", "node", "n", "wide")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda s: s != F.col("own"))
    keys = F.when(F.col("parts") == 1, F.array("key")).otherwise(F.transform(others, lambda s: F.xxhash64("key", F.least(s, F.col("own")), F.greatest(s, F.col("own")))))
    dealt = rows.withColumn("own", own).select(F.explode(keys).alias("key"), "node", "n", "wide")
    first_radius, too_far = _radii(similarity, 128), _radii(similarity, 64 * WIDE_WORDS)

    def compare(node, n, wide):
        import numpy as np

        by = np.argsort(n, kind="stable")
        node, n, wide = node[by], n[by], wide[by]
        first, second = wide[:, 0].copy(), wide[:, 1].copy()
        small = np.minimum(n, len(too_far) - 1)
        none = np.zeros(0, dtype=np.int64)
        found = [(none, none, none)]
        side, across, held = 512, 4096, 0

        def settled():
            """A forest of the candidates so far."""
            i, j, d = (np.concatenate(x) for x in zip(*found))
            k = _forest(len(node), i, j, d)
            return i[k], j[k], d[k]

        for lo in range(0, len(node), side):
            for at in range(lo, len(node), across):
                if similarity * n[at] > n[min(lo + side, len(node)) - 1]:
                    break
                near = np.bitwise_count(first[lo : lo + side, None] ^ first[None, at : at + across])
                near += np.bitwise_count(second[lo : lo + side, None] ^ second[None, at : at + across])
                near = near <= first_radius[small[lo : lo + side], None]
                i, j = np.nonzero(near)
                i, j = i + lo, j + at
                keep = (i < j) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
                i, j = i[keep], j[keep]
                for q in range(0, len(i), 100_000):
                    a, b = i[q : q + 100_000], j[q : q + 100_000]
                    d = np.bitwise_count(wide[a] ^ wide[b]).sum(axis=1, dtype=np.int64)
                    near = d <= too_far[small[a]]
                    found.append((a[near], b[near], d[near]))
                    held += int(near.sum())
                if held > 1_000_000:
                    found, held = [settled()], 0
        i, j, _ = settled()
        return node[i], node[j]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, key = [], None

        def done():
            node, n, wide = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in compare(node, n, wide)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, node, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            wide = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u8").reshape(-1, WIDE_WORDS)
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if keys[s] != key and held:
                    yield done()
                    held = []
                key = keys[s]
                held.append((node[s:e], n[s:e], wide[s:e]))
        if held:
            yield done()

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _similar(links: DataFrame, texts: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    """(a, b, similar): whether the texts (id0, text) of a link have shingle sets of at least that Jaccard similarity."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sets = []
            for column in (2, 3):
                hashes, counts = shingle_hashes(batch.column(column).to_pylist(), shingle_words)
                sets.append(np.split(hashes, np.cumsum(counts)[:-1]) if len(counts) else [])
            keep = []
            for x, y in zip(*sets):
                x, y = np.unique(x), np.unique(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keep, pa.bool_())], ["a", "b", "similar"])

    pairs = links.select("a", "b").distinct()
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id0")).distinct()
    held = stored(texts.join(asked, "id0", "left_semi").dropDuplicates(["id0"]), "asked")
    of = lambda name: held.select(F.col("id0").alias(name), F.col("text").alias(f"text_{name}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b")
    return met.mapInArrow(run, "a long, b long, similar boolean")


def _set_links(n, hashes, similarity: float):
    """Index pairs that join all of several shingle sets with that Jaccard similarity; every two are compared.

    The hashes of the sets stand end to end, n[i] distinct ones of set i. A hash of few sets is counted pair by pair, one of
    many by a matrix product.
    """
    import numpy as np

    m = len(n)
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    both = np.zeros((m, m), dtype=np.float32)
    edge = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1], [True]))) if len(hashes) else np.zeros(1, dtype=np.int64)
    runs = np.diff(edge)
    many = np.flatnonzero(runs >= 16)
    for q in range(0, len(many), 2048):
        part = many[q : q + 2048]
        columns = np.zeros((m, len(part)), dtype=np.float32)
        columns[owner[np.concatenate([np.arange(edge[k], edge[k + 1]) for k in part])], np.repeat(np.arange(len(part)), runs[part])] = 1
        both += columns @ columns.T
    few = np.repeat(runs < 16, runs)
    hashes, owner = hashes[few], owner[few]
    for d in range(1, 16):
        i = np.flatnonzero(hashes[d:] == hashes[:-d])
        if not len(i):
            break
        np.add.at(both, (owner[i], owner[i + d]), 1)  # owners rise within a hash, as the sort is stable
    return np.nonzero(np.triu(both >= similarity * (n[:, None] + n[None, :] - both), 1))


#: Sets, and shingles of them, in a part of a group whose sets are all compared.
PART_SETS, PART_SHINGLES = 1024, 1_000_000


def _settled(groups: DataFrame, texts: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    """(a, b): links that join all similar sets within each group (root, id0, n); all pairs of a group are compared.

    A group is one task; a large one is dealt in parts, and every two of them are a task.
    """

    def hashed(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            hashes, counts = shingle_hashes(batch.column(2).to_pylist(), shingle_words)
            sets = [np.unique(x).tobytes() for x in np.split(hashes, np.cumsum(counts)[:-1])] if len(counts) else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sets, pa.binary())], ["root", "node", "hashes"])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, key = [], None

        def done():
            nodes, sets = zip(*held)
            node, n = np.array(nodes), np.array([len(x) // 8 for x in sets])
            i, j = _set_links(n, np.frombuffer(b"".join(sets), dtype=np.uint64), similarity)
            root = local_roots(len(node), i, j)
            below = np.flatnonzero(root != np.arange(len(node)))
            return pa.RecordBatch.from_arrays([pa.array(node[below]), pa.array(node[root[below]])], ["a", "b"])

        for batch in batches:
            for k, node, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key and held:
                    yield done()
                    held = []
                key = k
                held.append((node, shingles))
        if held:
            yield done()

    sized = groups.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / PART_SETS), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int").alias("parts"))
    sets = groups.select("root", "id0").join(texts.join(groups, "id0", "left_semi").dropDuplicates(["id0"]), "id0").select("root", "id0", "text").mapInArrow(hashed, "root long, node long, hashes binary").join(sized, "root")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda s: s != F.col("own"))
    keys = F.when(F.col("parts") == 1, F.array(F.xxhash64("root"))).otherwise(F.transform(others, lambda s: F.xxhash64("root", F.least(s, F.col("own")), F.greatest(s, F.col("own")))))
    dealt = sets.withColumn("own", own).select(F.explode(keys).alias("key"), "node", "hashes")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def deduplicated(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, tile_rows: int = WIDE_TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns: of each group of near-duplicates the one with the smallest id.

    Only sets that share a band of least hashes are compared, so the work grows with the documents and not with their square.
    A radius of 128 SimHash bits that finds 0.8-similar sets takes in unrelated ones too, so pairs within it are compared again
    by 1024 bits of the same kind. Those near there are candidates only: no row goes without a link whose texts' sets were
    compared. A spanning forest of the candidates is compared first; where one of its links fails and leaves a group of
    candidates apart, all sets of that group are compared with each other. Links chain. The comparisons grow with the square
    of the distinct texts of one band, and of a group, in tiles of independent tasks. A row without an id takes
    one from its text; rows of one id are told apart by the hash of their text, and of equal ones one stays.
    """
    own = docs.columns
    text = F.col(text_col).cast("string")
    h = F.xxhash64(F.coalesce(text, F.lit("")))
    id0 = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)) + F.shiftrightunsigned(h, 1))
    rows = docs.select(id0.alias("id0"), h.alias("h"), text.alias("text"))
    prints = stored(sketches(rows, shingle_words), "sketches")
    # a text's hash is its name; of equal sketches the row of the smallest id speaks for all
    distinct = stored(prints.groupBy("wide", "n", "keys").agg(F.min(F.struct("id0", "h")).alias("first")).select("wide", "n", "keys", F.col("first.h").alias("node"), F.col("first.id0").alias("least")), "distinct")
    texts = rows.join(distinct.select(F.col("least").alias("id0"), F.col("node").alias("h")), ["id0", "h"], "left_semi").select(F.col("h").alias("id0"), "text")
    links = stored(_band_links(distinct, similarity, tile_rows), "links")
    tried = stored(_similar(links, texts, similarity, shingle_words), "tried")
    sound = tried.filter("similar").select("a", "b")
    names = components(sound, "near")
    at = lambda name: names.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    apart = tried.filter("NOT similar").join(at("a"), "a", "left").join(at("b"), "b", "left").filter("coalesce(root_a, a) <> coalesce(root_b, b)").select(F.col("a").alias("node"))
    apart = stored(apart, "apart")
    if not apart.isEmpty():
        loose = components(links, "candidates")
        roots = loose.join(apart.distinct(), "node", "left_semi").select("root").distinct()
        groups = stored(loose.join(roots, "root", "left_semi").join(distinct, "node").select("root", F.col("node").alias("id0"), "n"), "groups")
        names = components(sound.unionByName(_settled(groups, texts, similarity, shingle_words)), "near")
    named = distinct.join(names, "node", "left").select(F.coalesce("root", "node").alias("root"), F.struct(F.col("least").alias("id0"), F.col("node").alias("h")).alias("first"))
    stay = named.groupBy("root").agg(F.min("first").alias("first")).select("first.id0", "first.h")
    packed = docs.select(id0.alias("id0"), h.alias("h"), F.struct(*own).alias("row"))
    left = packed.join(stay, ["id0", "h"], "left_semi")
    if prints.count() > prints.select("id0", "h").distinct().count():  # equal rows
        left = left.dropDuplicates(["id0", "h"])
    return left.select("row.*")


def op8(spark, sf_dir: str) -> DataFrame:
    from tabulon.llm.common import settled, table

    found = settled(spark, "op8", lambda: near_duplicates(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
