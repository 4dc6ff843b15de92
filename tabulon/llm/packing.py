"""Harmonic packing of token documents into sequences of a fixed capacity.

A length class is a reciprocal of the capacity: class k has the documents of more than capacity // (k + 1)
and at most capacity // k tokens, and k of them, uncut, fill one sequence, up to what they leave of it.
Every class fills its own bins, in every partition by itself; there is no shuffle. A document of more
than the capacity is cut into whole sequences and a rest. Rests, and documents below the last class
(less than capacity / MOST_CLASSES tokens), are spare: cut as needed, they fill what the bins leave. Only
where bins wait for more than that, a document of another class becomes spare too, so few documents are
cut that fit a sequence. What a partition has left at its end is laid end to end, cut at the capacity,
and the last part is cut into powers of two, which need no padding.

Defined cases: a null text is empty and has only the end id; repeated rows are packed as often as
they occur; an empty table gives no rows; further columns are ignored. A sequence number is the
partition's number and a count, so a task that runs again gives the same numbers.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, padded_to long"


MOST_CLASSES = 16
#: Bins that wait for spare tokens, and sequences that their room or the spare tokens may come to, before either is used up.
MOST_WAITING, MOST_HELD = 64, 4
Piece = tuple[int, int, bytes, int]


def length_class(n: int, capacity: int) -> int:
    """How many documents of this length fill one sequence."""
    return capacity // n


class _Spare:
    """Pieces that may be cut, first in, first out."""

    def __init__(self):
        self.pieces: deque[Piece] = deque()
        self.tokens = 0

    def put(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.tokens += len(piece[2]) // 4

    def take(self, n: int) -> list[Piece]:
        out = []
        self.tokens -= n
        while n:
            doc_id, at, ids, whole = self.pieces.popleft()
            size = min(n, len(ids) // 4)
            out.append((doc_id, at, ids[: 4 * size], whole))
            if 4 * size < len(ids):
                self.pieces.appendleft((doc_id, at + size, ids[4 * size :], whole))
            n -= size
        return out


def fill(docs: Iterator[tuple[int, bytes]], capacity: int) -> Iterator[list[Piece]]:
    """Sequences, each a list of (doc_id, start, ids, doc_tokens)."""
    bins: dict[int, list[Piece]] = {k: [] for k in range(1, MOST_CLASSES + 1)}
    waiting: deque[tuple[list[Piece], int]] = deque()
    room, spare = 0, _Spare()
    for doc_id, ids in docs:
        n = len(ids) // 4
        rest = n % capacity
        for at in range(0, n - rest, capacity):
            yield [(doc_id, at, ids[4 * at : 4 * (at + capacity)], n)]
        if not rest:
            continue
        piece, k = (doc_id, n - rest, ids[4 * (n - rest) :], n), length_class(rest, capacity)
        if rest < n or k > MOST_CLASSES or room - spare.tokens > MOST_HELD * capacity or len(waiting) > MOST_WAITING:
            spare.put(piece)
        else:
            held = bins[k]
            held.append(piece)
            if len(held) == k:
                bins[k], left = [], capacity - sum(len(x[2]) // 4 for x in held)
                waiting.append((held, left))
                room += left
        while waiting and waiting[0][1] <= spare.tokens:
            held, left = waiting.popleft()
            room -= left
            yield held + spare.take(left)
        while spare.tokens > MOST_HELD * capacity:
            yield spare.take(capacity)
    for piece in [x for held, _ in waiting for x in held] + [x for held in bins.values() for x in held]:
        spare.put(piece)
    while spare.tokens >= capacity:
        yield spare.take(capacity)
    for bit in reversed(range(spare.tokens.bit_length())):
        if spare.tokens >> bit & 1:
            yield spare.take(1 << bit)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece, with its ids (little-endian unsigned 32-bit)."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from tabulon.llm.encoding import encoder

        enc, end = encoder(tokenizer_path), end_id.to_bytes(4, "little")
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padded_to", pa.int64())])

        def documents():
            for batch in batches:
                for lo in range(0, batch.num_rows, 500):
                    part = batch.slice(lo, 500)
                    texts = part.column(1).to_pylist()
                    for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(["" if t is None else t for t in texts])):
                        yield doc_id, ids + end

        number = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        size = 0
        for sequence in fill(documents(), capacity):
            at = 0
            length = sum(len(ids) for _, _, ids, _ in sequence) // 4
            padded = length if length & (length - 1) == 0 else capacity
            for doc_id, start, ids, n in sequence:
                rows.append((doc_id, start, ids, n, number, at, padded))
                at += len(ids) // 4
            number += 1
            size += 4 * at
            if size > 4_000_000 or len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def digests(pieces: DataFrame, with_ids: bool = False) -> DataFrame:
    return pieces.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset", "padded_to", *(["ids"] if with_ids else []),
    )


def op2(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tabulon.llm.common import table

    return digests(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0))
