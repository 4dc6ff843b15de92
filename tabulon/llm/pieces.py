"""SentencePiece ids by a table of distinct marked words, and texts back from ids.

A text's white space becomes markers, and a word is a run of markers with what follows up to the next one
or to a line end. In a model whose pieces hold markers only at their start, and no line end, merges never
cross from one word into the next, so a text's ids are its words' ids one after another. A task keeps a
table of the distinct words it has met: each is segmented by the library once, and a text's ids are joined
from the table in the order of its words. The table is keyed by the words themselves; it has a bound in
bytes, is emptied when full, and words longer than LONG are not kept beyond their slice, which changes no
id. There is no shuffle, and a lost task only fills its table anew. A model of another kind (not BPE,
pieces that cross markers or hold line ends, a normaliser that alters texts) gets every text whole.

Defined cases: a null text is empty and has the begin and end ids alone; texts of any length are whole;
null ids, repeated ids and repeated rows are rows like any other; an empty table gives no rows; further
columns are ignored. Decoding skips a null list of ids (null text); an id outside the model is an error.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKER = "▁"
#: Words of a text whose markers are spaces: a line end with what follows, or spaces with what follows.
WORD = re.compile(r"\n[^ \n]*| +[^ \n]*")
#: Bytes of a worker's table, and characters of a word that is kept in it.
TABLE_BYTES, LONG = 160 << 20, 100
#: A dictionary entry besides its key and value.
ENTRY = 200

_codecs: dict[str, "Codec"] = {}


class Codec:
    """encode(texts) -> ids as little-endian unsigned 32-bit integers; decode(lists of ids) -> texts."""

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.splits = self._splits()
        self.begin, self.end = ([i] if i >= 0 else [] for i in (self.model.bos_id(), self.model.eos_id()))
        self.bound, self.used, self.segmented = table_bytes, 0, 0
        self.table: dict[str, bytes] = {}

    def _splits(self) -> bool:
        from sentencepiece import sentencepiece_model_pb2 as described

        spec = described.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        how, piece = spec.normalizer_spec, described.ModelProto.SentencePiece
        plain = not how.precompiled_charsmap and not spec.denormalizer_spec.precompiled_charsmap and how.add_dummy_prefix and how.escape_whitespaces and not how.remove_extra_whitespaces
        bpe = spec.trainer_spec.model_type == described.TrainerSpec.BPE and not spec.trainer_spec.treat_whitespace_as_suffix
        kinds = {piece.NORMAL, piece.UNKNOWN, piece.CONTROL, piece.BYTE}
        return plain and bpe and all(p.type in kinds and MARKER not in p.piece.lstrip(MARKER) and "\n" not in p.piece for p in spec.pieces)

    def _packed(self, ids: list[list[int]]) -> list[bytes]:
        import numpy as np

        sizes = list(map(len, ids))
        raw, until, out = np.fromiter(chain.from_iterable(ids), "<u4", sum(sizes)).tobytes(), 0, []
        for n in sizes:
            out.append(raw[until : until + 4 * n])
            until += 4 * n
        return out

    def words(self, text: str) -> list[str]:
        """Keys of a text's words: the word after its first marker, or a line end with what follows."""
        if not text:
            return []
        text = text.replace(MARKER, " ").replace("\n", " \n")
        if text[0] != "\n" and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        text = " " + text.replace(" \n", "\n")
        return [w[1:] if w[0] == " " else w for w in WORD.findall(text)]

    def _segmented(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words: after a line end, which no piece shares, a word has the ids that it has in a text."""
        lead = len(self.model.encode("\n"))
        ids = self.model.encode([w if w[:1] == "\n" else "\n " + w for w in words], num_threads=1)
        self.segmented += len(words)
        return dict(zip(words, self._packed([x[lead - 1 :] if w[:1] == "\n" else x[lead:] for w, x in zip(words, ids)])))

    def _table(self, words: list[list[str]]) -> dict[str, bytes]:
        """A table with all words of a slice; what stays for the next slice is within the bound."""
        new = list(set(chain.from_iterable(words)).difference(self.table))
        if not new:
            return self.table
        found = self._segmented(new)
        kept = found if max(map(len, new)) <= LONG else {w: ids for w, ids in found.items() if len(w) <= LONG}
        self.used += sum(map(len, kept)) + sum(map(len, kept.values())) + ENTRY * len(kept)
        if self.used > self.bound:
            # full: the words at hand stay, as frequent ones are among them; if they alone are too many, none
            whole = self.table | found
            self.table = {w: whole[w] for w in set(chain.from_iterable(words)) if len(w) <= LONG}
            self.used = sum(len(w) + len(ids) + ENTRY for w, ids in self.table.items())
            if self.used > self.bound:
                self.table, self.used = {}, 0
            return whole
        self.table |= kept
        return self.table if len(kept) == len(found) else self.table | found

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.splits:
            words = [self.words(t) for t in texts]
            table = self._table(words)
            bodies = [b"".join(map(table.__getitem__, w)) for w in words]
        else:
            bodies = self._packed(self.model.encode(texts, num_threads=1)) if texts else []
        begin, end = self._packed([self.begin, self.end])
        return [begin + body + end for body in bodies]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.model.decode(ids, num_threads=1) if ids else []


def codec(path: str) -> Codec:
    """One for each file and Python worker; workers outlive tasks, and so do the words they know."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) of each text, with the begin and end ids."""

    def run(batches):
        import pyarrow as pa

        from tabulon.llm.chunk_store import slices_of

        known = codec(model_path)
        for batch in batches:
            for part in slices_of(batch):
                ids = known.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decoded(encoded_docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, text: what the library makes of each list of ids."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from tabulon.llm.chunk_store import slices_of

        known = codec(model_path)
        for batch in batches:
            for part in slices_of(batch):
                ids = part.column(1).to_pylist()
                held = [i for i, x in enumerate(ids) if x is not None]
                texts: list[str | None] = [None] * len(ids)
                for i, text in zip(held, known.decode([np.frombuffer(ids[i], "<u4").tolist() for i in held])):
                    texts[i] = text
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded_docs.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def op11(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tabulon.llm.common import table

    path = public_tokenizers.path("piece_bpe_32k.model")
    back = decoded(encoded(table(spark, sf_dir, "documents"), path), path)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
