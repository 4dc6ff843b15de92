"""Reading tables, and the split of labelled rows; intermediate tables are those of tabulon.storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.storage import drop_path, folder_names, new_path, settled, shared_dir, stored

__all__ = ["crc_bucket", "drop_path", "folder_names", "new_path", "settled", "shared_dir", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(doc_id: str, modulus: int):
    """crc32 of the id's decimal text, modulo; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(0))
