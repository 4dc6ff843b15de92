import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, spans string, id0 long, row string, kept_columns int, score double"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeats, repeated ids, and columns whose names operators use."""
    long = " ".join(f"w{i % 97}x{i}" for i in range(20_000))
    texts = [None, "", " \n\t ", "one", "One two", "a b c", "Über ñandú çà", "x" * 5000, long, "same text here " * 40, "same text here " * 40, "mail a.b@c.de 10.0.0.1 now", "中文 ﻿ \U0001f600", "\x00\x0b\x0c"]
    rows = [(i if i != 4 else None, t, None if i == 1 else "en", "s", None if t is None else len(t), i, "z", 5, "r", 1, 0.5) for i, t in enumerate(texts)]
    return rows + [(9, "another text under a taken id", None, None, 5, 1, None, None, None, None, None), rows[9]]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def folder(spark, odd, tmp_path_factory):
    """The odd documents with labels and a benchmark, as tables."""
    at = str(tmp_path_factory.mktemp("tables"))
    odd.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (3, 0, 1), (5, 1, 0), (6, None, None), (None, 1, 1), (8, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    width = 64
    vectors = [(i if i % 7 else None, [float((i * j) % 11 - 5) / 3 for j in range(width)], i) for i in range(40)]
    vectors += [vectors[3], (3, [1e30] * width, 0), (90, None, 0), (91, [1.0] * 63, 0), (92, [1.0] * 63 + [float("nan")], 0), (93, [1.0] * 63 + [None], 0), (94, [1.0] * 63 + [float("inf")], 0), (95, [], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, cluster int").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(1, "same text here same text"), (2, None), (3, ""), (None, "one")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at
