"""Spelling variants of a corpus: words one error apart, each led to the form that is far more frequent.

Two words are near if one inserted, deleted or replaced character turns one into the other. The shorter's
length c (or both words') halves it: either the first c // 2 characters of both are equal and the error
lies behind them, or the last c - c // 2 are equal and it lies before. So the words of c and of c + 1
characters are dealt by (c, first half) for the forward direction and by (c, last half) for the backward
one, and near words always meet. A task builds the minimal acyclic automaton of its words of one c, of the
reversed words for the backward direction, with the number of words behind every edge: a path's sum is the
word's rank, its perfect hash, by which counts are found. All words walk the exact half and complete the
rest with one error, in numpy, many at once. Paths to one word are taken once, and a word that both
directions reach counts in the forward one only. A task gives one row for each word (how many near ones, and
the best), never pairs; those rows are added up by word.

Words go twice in either direction, whatever their neighbours; a half that more than MOST_WORDS words share
is cut into automata of about that size, and its words walk every one of them, so no half is one task.

Defined cases: null and empty texts have no words; a null id is an empty text in the hash; repeated rows
count as often as they occur; ties go to the smallest word in code-point order; an empty table gives no
rows; further columns are ignored. Texts are whole, words of any length count.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of words (fixed values); only A-Z are lower-cased. All lie below U+0100.
LETTERS = "A-Za-zÀ-ÿ"
LOWER = {i: i + 32 for i in range(65, 91)}
#: Words of one automaton, distinct words that a task counts before it passes them on, and words that walk at once.
MOST_WORDS, MOST_COUNTED, AT_ONCE = 100_000, 300_000, 4096


# Words and how often they occur


def variant(seed: int, word: str, every: int) -> str:
    """A document's word, one character less if `every` divides the CRC-32 of "id:word"; `seed` is that of "id:"."""
    h = zlib.crc32(word.encode(), seed)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def counted(docs: DataFrame, least_length: int = 7, every: int | None = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of at least so many characters and how often they occur; every=None takes words as they are."""

    def run(batches):
        import pyarrow as pa

        find = re.compile(f"[{LETTERS}]{{{least_length},}}").findall
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        total: dict[str, int] = defaultdict(int)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(find(text.lower() if text.isascii() else text)).items():
                    if not word.islower():
                        word = word.lower() if word.isascii() else word.translate(LOWER)
                    if every:
                        word = variant(seed, word, every)
                        if len(word) < least_length:
                            continue
                    total[word] += n
                if len(total) > MOST_COUNTED:
                    yield rows()
                    total.clear()
        if total:
            yield rows()

    parts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


# A minimal acyclic automaton in flat arrays


class Automaton:
    """Of sorted distinct byte strings, none of them empty: edges by (state, byte), and for each how many words sort before it in its state.

    Equal right languages share a state (states are kept in a register as the words come in order). `rank` of
    a path, the sum of its edges' numbers and of final states passed, is the word's place in the sorted list.
    """

    def __init__(self, words: list[bytes]):
        import numpy as np

        register: dict[tuple, int] = {}
        targets: list[int] = []  # of all edges, state by state
        labels: list[int] = []
        before: list[int] = []
        first, final, size = [], [], []  # by state

        def settle(node: list) -> int:
            """A node ([edges], final) whose words are all in; its state's number."""
            key = (node[1], *node[0])
            state = register.get(key)
            if state is None:
                state = register[key] = len(first)
                first.append(len(targets))
                final.append(node[1])
                count = int(node[1])
                for label, target in node[0]:
                    labels.append(label)
                    targets.append(target)
                    before.append(count)
                    count += size[target]
                size.append(count)
            return state

        path: list[list] = [[[], False]]  # open nodes along the last word
        last = b""
        for word in words:
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            for depth in range(len(last), same, -1):
                path[depth - 1][0].append((last[depth - 1], settle(path.pop())))
            path.extend([[], False] for _ in range(len(word) - same))
            path[-1][1] = True
            last = word
        for depth in range(len(last), 0, -1):
            path[depth - 1][0].append((last[depth - 1], settle(path.pop())))
        self.start, self.words = settle(path[0]), len(words)
        self.first = np.array([*first, len(targets)], np.int64)
        self.final = np.array(final, bool)
        self.labels, self.targets, self.before = np.array(labels, np.int64), np.array(targets, np.int64), np.array(before, np.int64)
        states = np.repeat(np.arange(len(first)), np.diff(self.first))
        self.keys = states * 256 + self.labels  # ascending: states in order, the labels of each too

    def step(self, states, labels):
        """Whether there is an edge, and its place."""
        import numpy as np

        wanted = states * 256 + labels
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.keys[at] == wanted, at

    def fan(self, states):
        """All edges of each state: index of the state in the argument, place of the edge."""
        import numpy as np

        n = self.first[states + 1] - self.first[states]
        owner = np.repeat(np.arange(len(states)), n)
        return owner, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[states], n)


def one_error(automaton: Automaton, words, exact: int, longer: bool):
    """(index, rank) of the automaton's words near each of equally long words (a matrix of bytes), first `exact` bytes equal.

    `longer`: of one byte less; else of as many, or of one more. Each is given once.
    """
    import numpy as np

    length = words.shape[1]
    who = np.arange(len(words))
    state, rank = np.full(len(words), automaton.start), np.zeros(len(words), np.int64)

    def walk(who, state, rank, at):
        """One step by each word's own byte; those without an edge end here."""
        ok, edge = automaton.step(state, words[who, at].astype(np.int64))
        edge = edge[ok]
        return who[ok], automaton.targets[edge], rank[ok] + automaton.before[edge]

    for at in range(exact):
        who, state, rank = walk(who, state, rank, at)
    late = tuple(np.empty(0, np.int64) for _ in range(3))  # one error made
    for at in range(exact, length + 1):
        if longer:
            if at < length:  # this byte is too much: the next is read from the same state
                late = tuple(map(np.concatenate, zip(walk(*late, at), (who, state, rank))))
                who, state, rank = walk(who, state, rank, at)
            continue
        owner, edge = automaton.fan(state)
        added = who[owner], automaton.targets[edge], rank[owner] + automaton.before[edge]
        late = tuple(map(np.concatenate, zip(late, added)))  # an added byte: this one is still to be read
        if at < length:
            other = automaton.labels[edge] != words[added[0], at]  # a replaced byte: the next is to be read
            late = tuple(map(np.concatenate, zip(walk(*late, at), (x[other] for x in added))))
            who, state, rank = walk(who, state, rank, at)
    met = automaton.final[late[1]]
    both = np.unique(late[0][met] * automaton.words + late[2][met])
    return both // automaton.words, both % automaton.words


# Near words of all words


def _dealt(words: DataFrame, most_words: int) -> DataFrame:
    """word, n, c, back, half, part, own: each word in both of its length classes and both directions, by what must be equal.

    Of crowded halves there is at most one for each `most_words` rows, so their table is small enough to be sent out.
    """
    size = F.length("word")
    classes = words.filter(size > 1).select("word", "n", F.explode(F.array(size, size - 1)).alias("c"))
    h = (F.col("c") / 2).cast("int")
    rows = classes.select("word", "n", "c", F.explode(F.array(F.struct(F.lit(False).alias("back"), F.substring("word", F.lit(1), h).alias("half")), F.struct(F.lit(True).alias("back"), F.expr("right(word, c - cast(c / 2 as int))").alias("half")))).alias("r")).select("word", "n", "c", "r.*")
    crowded = rows.groupBy("c", "back", "half").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > most_words).withColumn("parts", F.ceil(F.col("size") / most_words).cast("int"))
    rows = rows.join(F.broadcast(crowded.select("c", "back", "half", "parts")), ["c", "back", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    return rows.select("word", "n", "c", "back", "half", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def _near_of(c: int, back: bool, words: list[bytes], n, own) -> Iterator[tuple]:
    """Rows (word, n_near, best_n, best) of distinct words; the automaton has those that are its `own`."""
    import numpy as np

    exact = c - c // 2 if back else c // 2
    turned = [w[::-1] for w in words] if back else words
    mine = sorted((turned[i], i) for i in np.flatnonzero(own).tolist())
    if not mine:
        return
    automaton = Automaton([w for w, _ in mine])
    index = np.array([i for _, i in mine])  # rank -> place in words
    heads = np.frombuffer(b"".join(w[: c // 2] for w in words), np.uint8).reshape(len(words), c // 2)
    order = np.empty(len(words), np.int64)  # of equal counts the smallest word is best
    order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    for length in (c, c + 1):
        those = np.array([i for i, w in enumerate(words) if len(w) == length], np.int64)
        for lo in range(0, len(those), AT_ONCE):
            some = those[lo : lo + AT_ONCE]
            matrix = np.frombuffer(b"".join(turned[i] for i in some.tolist()), np.uint8).reshape(len(some), length)
            who, rank = one_error(automaton, matrix, exact, longer=length > c)
            who, which = some[who], index[rank]
            if back:  # what the forward direction finds too counts there
                apart = (heads[who] != heads[which]).any(axis=1)
                who, which = who[apart], which[apart]
            best = np.lexsort((order[which], -n[which], who))
            who, which = who[best], which[best]
            first = np.flatnonzero(np.append(True, who[1:] != who[:-1])[: len(who)])
            counts = np.diff(np.append(first, len(who)))
            for i, k, j in zip(who[first].tolist(), counts.tolist(), which[first].tolist()):
                yield words[i], k, int(n[j]), words[j]


def near_words(words: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """word, n_near, best (n, word): for each word with near ones, how many, and the most frequent, of equals the smallest."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

        def groups():
            """Words of one (c, direction, part), at a change of the half cut into those of one automaton."""
            key, last, rows = None, None, []
            for batch in batches:
                for c, back, part, half, word, n, own in zip(*(x.to_pylist() for x in batch.columns)):
                    if (c, back, part) != key or half != last and len(rows) >= most_words:
                        if rows:
                            yield key, rows
                        key, rows = (c, back, part), []
                    last = half
                    rows.append((word, n, own == part))
            if rows:
                yield key, rows

        def found():
            for (c, back, _), rows in groups():
                words = [w.encode("latin-1") for w, _, _ in rows]
                n, own = np.array([n for _, n, _ in rows], np.int64), np.array([o for _, _, o in rows], bool)
                for word, k, best_n, best in _near_of(c, back, words, n, own):
                    yield word.decode("latin-1"), k, best_n, best.decode("latin-1")

        out: list[tuple] = []
        for row in found():
            out.append(row)
            if len(out) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    dealt = _dealt(words, most_words).repartition("c", "back", "half", "part").sortWithinPartitions("c", "back", "part", "half", "word")
    parts = dealt.select("c", "back", "part", "half", "word", "n", "own").mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    by = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return by.select("word", "n_near", F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def grouped(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, n, form, form_n, n_near, root of distinct words with their counts.

    A form is at least `ratio` times as frequent, so a chain of forms is short: its length is bounded by the
    logarithm of the largest count, and following it takes the logarithm of that in joins, each of the words with a form.
    """
    import math

    from tabulon.llm.common import stored

    at = words.join(near_words(words), "word", "left")
    form = F.when(F.col("best.n") >= ratio * F.col("n"), F.col("best.word"))
    held = stored(at.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best.n")).alias("form_n")), "spelling-forms")
    up = held.filter("form is not null").select("word", F.col("form").alias("root"))
    least, most = held.agg(F.min("n"), F.max("n")).first()
    steps = int(math.log(most / least, ratio)) + 1 if most else 0
    for _ in range(max(steps - 1, 0).bit_length()):
        above = up.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        up = stored(up.join(above, "root", "left").select("word", F.coalesce("higher", "root").alias("root")), "spelling-roots")
    return held.join(up, "word", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))


def op12(spark, sf_dir: str) -> DataFrame:
    from tabulon.llm.common import settled, stored, table

    def rows() -> DataFrame:
        words = stored(counted(table(spark, sf_dir, "documents")).filter("n >= 2"), "spelling-words")
        return grouped(words).select("word", "form", "root", "n", "n_near", "form_n")

    return settled(spark, "spelling", rows)
