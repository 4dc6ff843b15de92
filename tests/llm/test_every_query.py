"""Each query over odd rows and over no rows: no crash, a row where one is due."""

import pytest

from tabulon.llm import catalog

PER_DOCUMENT = ["op1_quality_classifier", "op3_personal_data", "op4_repeated_strings", "op5_toxicity", "op7_quality_rules", "op8_simhash", "op9_license_notices", "op10_chunk_store", "op11_sentence_pieces"]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_odd_rows(spark, folder, odd_rows, name):
    rows = catalog.QUERIES[name](spark, folder).collect()
    if name in PER_DOCUMENT:
        assert len(rows) == len(odd_rows)
        assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(r[0] for r in odd_rows if r[0] is not None)
    if name == "op2_harmonic_packing":
        # every id of every row lies in one piece, and offsets have no gaps
        texts: dict = {}
        for doc_id, text, *_ in odd_rows:
            texts.setdefault(doc_id, []).append(text)
        for doc_id in texts:
            mine = [r for r in rows if r.doc_id == doc_id]
            wholes = sum(r.doc_tokens for r in mine if r.start == 0)
            assert sum(r.start == 0 for r in mine) == len(texts[doc_id]) and sum(r.length for r in mine) == wholes
        places: dict = {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == places.get(r.sequence_id, 0)
            places[r.sequence_id] = r.offset + r.length
        assert max(places.values()) <= 1024
    if name == "op6_decontamination":
        # only the two rows with the repeated phrase (one id is repeated, with its row) hold an item of more than a word
        assert {r.doc_id for r in rows if r.item_id == 1} == {9, 10}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_rows(spark, tmp_path, none, name):
    none.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql(spark, name):
    from oracle import connection, difference

    at = "/root/testdata/sf0.01"
    assert not difference(spark, connection(at), at, catalog.QUERIES[name], catalog.ORACLE_SQL[name])
