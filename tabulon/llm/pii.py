"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

Base spans are the leftmost matches of four patterns. The field labels words (runs without white
space) from their shapes and their neighbours' shapes, with a first and an inner label for each
kind; it is fitted by its exact likelihood on a small labelled table and decoded by Viterbi in
numpy batches. Words without a digit, @, + or bracket, farther than `REACH` words from one that has,
have only the shapes of plain words around them and are never labelled (fitting checks that), so
only the stretches around such marked words are decoded. A labelled stretch becomes a span if it
passes its kind's check and overlaps no base span: phones without a plus sign or right before another
number, addresses with the at sign or dots spelled in brackets, numbers of cards and hosts with other
separators, and secrets (kind `secret`, after the four), which no base pattern looks for: long runs of
letters and digits that the words before them call a token, key, password or secret.

Defined cases: a null text is empty and has no spans; ties between kinds at one start come in the
order email, ip, card, phone; repeated rows stay; further columns are ignored; an empty table gives
no rows. All patterns take time in proportion to the text, whatever it holds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in their order, and the base patterns (guards against starts inside a run added where they change no match)
KINDS = ("email", "ip", "card", "phone")
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Kinds that the field knows, in the order of their spans.
FIELD_KINDS = (*KINDS, "secret")
#: Words that keep their letters in a shape.
CUES = ("token", "secret", "password", "passwd", "key", "apikey", "api", "bearer", "auth", "credential")
SECRET = re.compile(r"[A-Za-z0-9_+/-]{12,}")

MARK = re.compile(r"[0-9@+\[(]")
WORD = re.compile(r"\S+")
REACH = 3
TAGS = ("O", *(f"{p}-{k}" for k in FIELD_KINDS for p in "BI"))
SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of KINDS."""
    out: list[tuple[int, int, int]] = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        m = EMAIL_DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if any(d in text for d in "0123456789"):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            if m.end() - m.start() <= 37 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


@lru_cache(maxsize=50_000)
def shape(word: str) -> str:
    """Digits as 9 (their number up to 4, then a class), letters as a, other marks as they are; the kind of a long mixed word."""
    if word.lower() in CUES:
        return word.lower()
    out = []
    for run in re.findall(r"[0-9]+|[^\W\d_]+|[\W_]", word):
        if run[0] in "0123456789":
            n = len(run)
            out.append("9" * n if n <= 4 else "5-8" if n <= 8 else "9-11" if n <= 11 else "12-19" if n <= 19 else "20+")
        else:
            out.append(run if run.lower() in ("at", "dot") and run != word else "a" if run[0].isalpha() else run)
    if len(out) <= 8:
        return "".join(out)
    held = set(out)
    mixed = "a" in held and any(x[0].isdigit() for x in held) and held <= {"a", "_", "-", "+", "/"} | {x for x in held if x[0].isdigit()}
    return f"{'mixed' if mixed else 'long'}{min(len(word) // 8, 4)}" if mixed or len(out) > 24 else "".join(out)


@lru_cache(maxsize=50_000)
def _shapes(word: str) -> tuple[str, str]:
    fine = shape(word.strip(".,;:!?\"'#$%&*") or word)
    return fine, re.sub(r"9+|5-8|9-11|12-19|20\+", "9", fine)


def _features(words: list[str]) -> list[list[str]]:
    """Names of each word's features."""
    plain, coarse = zip(*map(_shapes, words))
    at = lambda xs, i: xs[i] if 0 <= i < len(xs) else ""
    return [
        ["bias", f"0:{plain[i]}", f"0~{coarse[i]}", f"-1:{at(plain, i - 1)}", f"-2:{at(coarse, i - 2)}", f"+1:{at(plain, i + 1)}", f"-1,0:{at(coarse, i - 1)},{coarse[i]}", f"-2,0:{at(coarse, i - 2)},{coarse[i]}", f"0,+1:{coarse[i]},{at(coarse, i + 1)}"]
        for i in range(len(words))
    ]


class Field:
    """weights: feature -> one number for each tag; moves[a, b]: from tag a to tag b."""

    def __init__(self, names: list[str], weights, moves):
        import numpy as np

        self.index = {n: i for i, n in enumerate(names)}
        self.names, self.weights, self.moves = names, np.asarray(weights, dtype=float), np.asarray(moves, dtype=float)

    def emissions(self, words: list[str]):
        import numpy as np

        rows = [[self.index[f] for f in fs if f in self.index] for fs in _features(words)]
        return np.array([self.weights[r].sum(axis=0) for r in rows])

    def decode(self, sentences: list[list[str]]) -> list[list[int]]:
        """Best tags of each sentence; sentences of like length are decoded together, longer ones by themselves."""
        import numpy as np

        out: list[list[int]] = [[] for _ in sentences]
        groups: dict[int, list[int]] = {}
        for i, words in enumerate(sentences):
            groups.setdefault((len(words) - 1).bit_length(), []).append(i)
        for members in groups.values():
            for lo in range(0, len(members), 256):
                some = members[lo : lo + 256]
                lengths = np.array([len(sentences[i]) for i in some])
                top, k = int(lengths.max()), len(TAGS)
                e = np.zeros((len(some), top, k))
                for r, i in enumerate(some):
                    e[r, : lengths[r]] = self.emissions(sentences[i])
                best, back = e[:, 0], np.zeros((len(some), top, k), dtype=np.int8)
                for t in range(1, top):
                    through = best[:, :, None] + self.moves
                    back[:, t] = through.argmax(axis=1)
                    on = (t < lengths)[:, None]
                    best = np.where(on, through.max(axis=1) + e[:, t], best)
                tag = best.argmax(axis=1)
                path = np.zeros((len(some), top), dtype=np.int64)
                for t in range(top - 1, -1, -1):
                    inside = t < lengths
                    path[inside, t] = tag[inside]
                    if t:
                        tag = np.where(inside, back[np.arange(len(some)), t, tag], tag)
                for r, i in enumerate(some):
                    out[i] = path[r, : lengths[r]].tolist()
        return out


def fit_field(sentences: list[tuple[list[str], list[str]]], steps: int = 150, rate: float = 0.3, l2: float = 0.02) -> Field:
    """Maximum of the penalised likelihood by full-batch AdaGrad; the gradient is exact (forward and backward sums)."""
    import numpy as np

    made = [_features(words) for words, _ in sentences]
    names = sorted({f for fs in made for f in sum(fs, [])})
    index = {n: i for i, n in enumerate(names)}
    n, top, k, width = len(made), max(map(len, made)), len(TAGS), len(made[0][0])
    at = np.zeros((n, top, width), dtype=int)
    on, gold = np.zeros((n, top), dtype=bool), np.zeros((n, top), dtype=int)
    for r, (fs, (_, tags)) in enumerate(zip(made, sentences)):
        on[r, : len(fs)] = True
        at[r, : len(fs)] = [[index[f] for f in row] for row in fs]
        gold[r, : len(fs)] = [TAGS.index(t) for t in tags]
    w, moves = np.zeros((len(names), k)), np.zeros((k, k))
    seen_w, seen_m = np.full_like(w, 1e-8), np.full_like(moves, 1e-8)
    one = np.eye(k)[gold] * on[:, :, None]
    pairs = np.einsum("nta,ntb->ab", one[:, :-1], one[:, 1:])

    places = at.reshape(-1)  # padding stands at feature 0, where its share is 0
    order = np.argsort(places, kind="stable")
    firsts = np.flatnonzero(np.concatenate(([True], np.diff(places[order]) > 0)))
    named, rows = places[order][firsts], order // width
    for _ in range(steps):
        e = w[at].sum(axis=2)
        eb, m = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(moves - moves.max())
        fwd, bwd, scale = np.zeros((n, top, k)), np.ones((n, top, k)), np.ones((n, top, 1))
        for t in range(top):
            a = (fwd[:, t - 1] @ m if t else 1.0) * eb[:, t]
            scale[:, t] = a.sum(axis=1, keepdims=True)
            fwd[:, t] = np.where(on[:, t, None], a / scale[:, t], fwd[:, t - 1])
        for t in range(top - 2, -1, -1):
            bwd[:, t] = np.where(on[:, t + 1, None], (eb[:, t + 1] * bwd[:, t + 1] / scale[:, t + 1]) @ m.T, 1.0)
        p = fwd * bwd * on[:, :, None]
        after = eb[:, 1:] * bwd[:, 1:] / scale[:, 1:] * on[:, 1:, None]
        through = m * (fwd[:, :-1].reshape(-1, k).T @ after.reshape(-1, k))
        gw, gm = l2 * w, l2 * moves + through - pairs
        gw[named] += np.add.reduceat((p - one).reshape(-1, k)[rows], firsts, axis=0)
        seen_w += gw * gw
        seen_m += gm * gm
        w -= rate * gw / np.sqrt(seen_w)
        moves -= rate * gm / np.sqrt(seen_m)
    field = Field(names, w, moves)
    plain = ["word"] * (4 * REACH)
    if any(field.decode([plain, ["Word,"], ["word", "word."]])[i] != [0] * m for i, m in enumerate((len(plain), 1, 2))):
        raise ValueError("the field labels plain words; the labelled table has too few of them")
    return field


def labelled_rows(copies: int = 6, seed: int = 11) -> list[tuple[int, int, str, str]]:
    """(sentence, place, word, tag): the small labelled table, made by rule from the layouts below."""
    import random

    rng = random.Random(seed)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9)))
    part = lambda: str(rng.randint(1, 255))
    key = lambda: "".join(rng.choice(("0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyzABCDEF_")[n % 3]) for _ in range(n)) if (n := rng.randint(20, 64)) else ""
    cue = lambda: rng.choice((str.lower, str.title, str.upper))(rng.choice(CUES[:7]))
    layouts = [
        ("email", lambda: f"{name()}.{num(2)}@{name()}.{name()}.com"), ("email", lambda: f"{name()}@{name()}.org"),
        ("email", lambda: f"{name()} [at] {name()} [dot] com"), ("email", lambda: f"{name()} (at) {name()} (dot) org"),
        ("email", lambda: f"{name()}[at]{name()}[dot]com"), ("email", lambda: f"{name()}(at){name()}.com"), ("email", lambda: f"{name()} @ {name()}.com"),
        ("ip", lambda: f"{part()}.{part()}.{part()}.{part()}"), ("ip", lambda: f"{part()}[.]{part()}[.]{part()}[.]{part()}"), ("ip", lambda: f"{part()}(.){part()}(.){part()}(.){part()}"),
        ("card", lambda: num(16)), ("card", lambda: f"{num(4)} {num(4)} {num(4)} {num(4)}"), ("card", lambda: f"{num(4)}-{num(4)}-{num(4)}-{num(4)}"),
        ("card", lambda: f"{num(4)}.{num(4)}.{num(4)}.{num(4)}"), ("card", lambda: f"{num(4)}/{num(4)}/{num(4)}/{num(4)}"),
        ("phone", lambda: f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}"), ("phone", lambda: f"+{num(2)} {num(3)} {num(3)} {num(4)}"),
        ("phone", lambda: f"({num(3)}) {num(3)}-{num(4)}"), ("phone", lambda: f"{num(3)}-{num(3)}-{num(4)}"), ("phone", lambda: f"{num(3)}.{num(3)}.{num(4)}"),
        ("phone", lambda: f"({num(3)}){num(3)}-{num(4)}"),
        ("secret", lambda: f'{cue()} = "{key()}"'), ("secret", lambda: f'{cue()} = "{key()}"'), ("secret", lambda: f"{cue()} = {key()}"), ("secret", lambda: f'{cue()}: "{key()}"'), ("secret", lambda: f"{cue()}: {key()}"), ("secret", lambda: f"bearer {key()}"),
    ]
    others = [
        lambda: num(rng.randint(1, 11)), lambda: f"{num(1)}.{num(1)}", lambda: f"{num(1)}.{num(2)}.{num(1)}", lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(2)}:{num(2)}",
        lambda: f"({name()})", lambda: f"[{num(1)}]", lambda: f"({num(4)})", lambda: f"{num(2)}%", lambda: f"${num(3)}.{num(2)}", lambda: f"{name()}+{name()}",
        lambda: f"{name()}={num(5)}{name()}{num(9)}", lambda: f'"{num(7)}{name()}{num(2)}"', lambda: f"{num(3)}-{num(4)}", lambda: f"{num(3)} {num(4)}", lambda: f"@{name()}", lambda: "@", lambda: "+",
        lambda: f"{num(3)} {num(3)} {num(4)}", lambda: f"({num(1)})", lambda: f"{num(1)}[.]{num(1)}", lambda: f"{num(20)}", lambda: f"[at] {name()}", lambda: f"({name()}) {num(3)}-{num(4)}",
        lambda: f"{name()} {key()}", lambda: f'{name()} "{key()}"', lambda: f'"{key()}"', lambda: key(), lambda: cue(), lambda: f"{cue()} {name()} {num(3)}", lambda: f"{cue()} = {num(2)}", lambda: f"{cue()}: {num(4)}", lambda: f"= {num(4)}", lambda: f"{name()} = {num(6)}",
    ]
    rows, sentence = [], 0
    for _ in range(copies):
        for kind, make in [*layouts, *((None, o) for o in others), *((None, name) for _ in range(12))]:
            words = [(rng.choice((name(), name().title(), name() + ",", name() + ".")), "O") for _ in range(rng.randint(0, 5))]
            pieces = make().split(" ")
            for i, piece in enumerate(pieces):
                first = len(pieces) - 1 if kind == "secret" else 0  # the words that name a secret are no part of it
                words.append((piece, "O" if kind is None or i < first else f"{'BI'[i > first]}-{kind}"))
            if kind == "phone" and rng.random() < 0.3:  # another number right behind
                words += rng.choice(([(f"{part()}.{part()}.{part()}.{part()}", "B-ip")], [(num(16), "B-card")], [(num(rng.randint(1, 5)), "O")]))
            if rng.random() < 0.25:
                words[-1] = (words[-1][0] + rng.choice(".,"), words[-1][1])
            words += [(rng.choice((name(), name().title(), name() + ",")), "O") for _ in range(rng.randint(0, 5))]
            rows += [(sentence, i, w, t) for i, (w, t) in enumerate(words)]
            sentence += 1
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "sentence int, place int, word string, tag string")


def fit(labelled: DataFrame, most_rows: int = 50_000) -> Field:
    """The field of a labelled table (sentence, place, word, tag) of at most `most_rows` rows; more are an error."""
    rows = labelled.select("sentence", "place", "word", "tag").dropna().orderBy("sentence", "place").limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"the labelled table has over {most_rows} rows")
    sentences: dict = {}
    for r in rows:
        words, tags = sentences.setdefault(r.sentence, ([], []))
        words.append(r.word)
        tags.append(r.tag)
    return fit_field(list(sentences.values()))


def _passes(kind: str, text: str) -> bool:
    digits = _digits(text)
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+\s*(?:@|\[at\]|\(at\))\s*[\w-]+(?:\s*(?:\.|\[dot\]|\(dot\))\s*[\w-]+)+", text, re.IGNORECASE))
    if kind == "ip":
        parts = re.split(r"\[\.\]|\(\.\)|\.", text)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "secret":
        return len(text) >= 12 and bool(digits) and any(c.isalpha() for c in text)
    if kind == "card":
        return bool(re.fullmatch(r"[0-9]+(?:[ ./-][0-9]+)*", text)) and 12 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"\+?[0-9 ().-]+", text)) and 9 <= len(digits) <= 15


def find(texts: Iterable[str], field: Field) -> list[list[tuple[int, int, str, bool]]]:
    """Each text's spans (start, end, kind, base) by start, then kind."""
    texts = list(texts)
    out = [[(s, e, k, True) for s, e, k in base_spans(t)] for t in texts]
    where, sentences = [], []
    for r, text in enumerate(texts):
        if not MARK.search(text):
            continue
        words = [m.span() for m in WORD.finditer(text)]
        marked = [i for i, (s, e) in enumerate(words) if MARK.search(text, s, e)]
        lo = hi = 0
        for i in [*marked, None]:
            if i is not None and hi and i - REACH <= hi:
                hi = min(i + REACH + 1, len(words))
                continue
            if hi:
                where.append((r, words[lo:hi]))
                sentences.append([text[s:e] for s, e in words[lo:hi]])
            if i is not None:
                lo, hi = max(0, i - REACH), min(i + REACH + 1, len(words))
    at, starts, reach = -1, [], [-1]
    for (r, words), tags in zip(where, field.decode(sentences)):
        text, taken = texts[r], out[r]
        if r != at:  # base spans by start, and how far those before each one reach
            at, base = r, [x for x in taken if x[3]]
            starts, reach = [x[0] for x in base], list(accumulate((x[1] for x in base), max, initial=-1))
        i = 0
        while i < len(tags):
            tag = TAGS[tags[i]]
            j = i + 1
            if tag != "O":
                while j < len(tags) and TAGS[tags[j]] == f"I-{tag[2:]}":
                    j += 1
                s, e = words[i][0], words[j - 1][1]
                while e > s and text[e - 1] in ".,;:!?\"'":
                    e -= 1
                while s < e and text[s] in "\"'":
                    s += 1
                if tag == "B-secret" or tag == "I-secret":
                    s, e = max((m.span() for m in SECRET.finditer(text, s, e)), key=lambda x: (x[1] - x[0], -x[0]), default=(s, s))
                if _passes(tag[2:], text[s:e]) and reach[bisect_left(starts, e)] <= s:
                    taken.append((s, e, tag[2:], False))
            i = j
    return [sorted(x, key=lambda y: (y[0], FIELD_KINDS.index(y[2]))) for x in out]


def spans(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans in code points, base ones and the field's."""
    sent = docs.sparkSession.sparkContext.broadcast((field.names, field.weights, field.moves))

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        held = Field(*sent.value)
        for batch in batches:
            found = find((t or "" for t in batch.column(1).to_pylist()), held)
            rows = [[{"kind": k, "start": s, "end": e, "base": b} for s, e, k, b in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact(text: str, found: list[tuple[int, int, str, bool]]) -> str:
    """The text with each span (joined where they overlap, named by the first) as <KIND>."""
    out, at, end = [], 0, -1
    for s, e, kind, _ in found:
        if s >= end:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = end = max(e, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, field: Field, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents with their spans replaced and, where the column exists, their lengths counted anew."""
    sent = docs.sparkSession.sparkContext.broadcast((field.names, field.weights, field.moves))

    def run(batches):
        import pyarrow as pa

        held = Field(*sent.value)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            new = [t if not x else redact(t, x) for t, x in zip(texts, find((t or "" for t in texts), held))]
            at = batch.schema.get_field_index(text_col)
            columns = batch.columns
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if length_col in batch.schema.names:
                at = batch.schema.get_field_index(length_col)
                columns[at] = pa.array([None if t is None else len(t) for t in new], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts of base spans, the digest of their list, and the list of all spans."""
    listed = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["base"])
    of = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    counts = [of(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op3(spark, sf_dir: str) -> DataFrame:
    from tabulon.llm.common import table

    return digests(spans(table(spark, sf_dir, "documents"), fit(labelled_table(spark))))
