"""Ids and texts must be the sentencepiece library's own, whatever the table holds."""

import array
import hashlib
import random

import public_tokenizers
import pytest

from tabulon.llm import pieces
from tabulon.llm.pieces import Codec

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def texts(n, seed):
    rng = random.Random(seed)
    fixed = ["", " ", "\n", "▁", "\n\n", " \n ", "a ", " a", "a\n", "a  b", "a▁b", "\x00", "a\x00b", "<s> </s> <unk> <0x0A>", "\t tab\tand\r\n", "中文 ﻿ \U0001f600", "x" * 3000, "é", "▁\n▁"]
    return fixed + ["".join(rng.choice(" \n  ▁\tab<0x41>zÀé中\U0001f600'1\x00,the") for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("table_bytes", [1 << 30, 20_000, 0])
def test_same_ids_as_the_library(table_bytes):
    codec, given = Codec(MODEL, table_bytes), texts(4000, 1)
    assert codec.splits
    want = codec.model.encode(given, add_bos=True, add_eos=True)
    got = [ids for i in range(0, len(given), 300) for ids in codec.encode(given[i : i + 300])]
    assert got == [array.array("I", x).tobytes() for x in want]
    assert codec.used <= table_bytes
    assert codec.decode(want) == [codec.model.decode(x) for x in want]


def test_a_word_is_segmented_once():
    codec = Codec(MODEL)
    codec.encode(["one two three two", "two one"])
    codec.encode(["three one", "two\ntwo"])
    assert codec.segmented == 4  # one, two, three, and two after a line end


def test_other_models_get_whole_texts():
    codec, given = Codec(MODEL), texts(200, 2)
    want = codec.encode(given)
    codec.splits = False
    assert codec.encode(given) == want and codec.encode([]) == []


def test_query(spark, tmp_path):
    """All columns against the library, null text and id and repeated rows included."""
    rows = [(i, t) for i, t in enumerate(texts(300, 3))] + [(None, None), (None, "a b"), (5, "again"), (5, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    model = Codec(MODEL).model
    want = []
    for i, t in rows:
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, pieces.op11(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_decoding_null_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, bytearray(array.array("I", [1, 2]).tobytes()))], "doc_id long, ids binary")
    assert {r.doc_id: r.text for r in pieces.decoded(rows, MODEL).collect()} == {1: None, 2: ""}
