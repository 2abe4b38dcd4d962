"""Session helpers that every operator of this subpackage shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import checkpoint_dir, cut

__all__ = ["checkpoint_dir", "cut", "parts_for", "text_bytes", "texts_of"]


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    row = docs.agg(F.sum(F.octet_length(text).cast("long")).alias("b")).first()
    return int(row["b"] or 0)


def parts_for(spark: SparkSession, size: int, each: int) -> int:
    """Partitions of about ``each`` bytes, and at least as many as the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def texts_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id long, text) of docs; all other columns, whatever their names, are left behind."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

