"""Conversation records, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens import schemas


def _conversations(rows: DataFrame) -> DataFrame:
    stamps = F.col("timestamps")
    rest = F.slice(stamps, 2, F.greatest(F.size(stamps) - 1, F.lit(0)))
    # A name of its own: inside a lambda, an output alias would win over the input column.
    return rows.withColumn("_first", F.get(stamps, F.lit(0))).select(
        F.col("ts").cast("long").alias("ts"), "src", "sport", "dst", "dport", "end_state",
        F.transform(stamps, lambda t: t.cast("long")).alias("timestamps"),
        F.transform(rest, lambda t: t - F.col("_first")).alias("intervals"),
    )


def parse_conversations(lines: DataFrame) -> DataFrame:
    """JSON lines (column `value`) as conversations.

    `timestamps` are truncated to seconds; `intervals` are offsets from the first packet.
    """
    record = F.from_json("value", schemas.CONVERSATION_JSON)
    return _conversations(lines.select(record.alias("r")).select("r.*"))


def conversation_scan(spark: SparkSession, path: str) -> DataFrame:
    """Conversation JSON files as conversations."""
    return _conversations(spark.read.schema(schemas.CONVERSATION_JSON).json(path))
