"""A corpus pipeline: quality rules, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents; the last returns the packed pieces with their token ids.

Defined cases, for all stages: further columns are kept as they are, whatever their names; a null id is a
row like any other; rows with equal id and text are one from the near-duplicate stage on; an empty table
gives an empty one; ties go to the smallest id, then to the smallest hash of the text. Texts are whole at
every stage. Each function's own words say what becomes of null and empty texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import decontamination, packing, pii, quality_rules, simhash
from tabulon.llm.common import drop_path, new_path, settled, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; those without words, so null and empty texts too, are among them."""
    return quality_rules.accepted(docs, "clean", 1)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the smallest id: five-word shingles, similarity 0.8 or more.

    Null and empty texts are equal to each other: one of them stays. Very long texts are sets of shingles like any other.
    """
    return simhash.deduplicated(docs, similarity=0.8, shingle_words=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, and null or empty items are in no document."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by the name of their kind; n_chars is counted anew. A null text stays null."""
    return pii.redacted(docs, pii.fit(pii.labelled_table(spark)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row for each piece of a document. A null or empty text is one piece, its end id."""
    import public_tokenizers

    return packing.digests(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0), with_ids=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: Sketches, alignments, the random field and tokenizers are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        docs = settled(spark, name, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
