"""Rows of document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row_per_id(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """`columns` of `docs` (doc_id and text among them) with one row per id: rows with a null id
    are left out, a null text is empty, and of rows with the same id the smallest by (text, other
    columns) counts. Rows are only shuffled if some id is repeated."""
    rest = [c for c in columns if c not in ("doc_id", "text")]
    rows = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"), *rest)
    repeated = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return rows.select(*columns)
    single = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min(F.struct("text", *rest)).alias("row")).select("doc_id", "row.*")
    return rows.join(repeated, "doc_id", "left_anti").unionByName(single).select(*columns)


def one_per_id(docs: DataFrame) -> DataFrame:
    """doc_id and text of `one_row_per_id`."""
    return one_row_per_id(docs, ("doc_id", "text"))
