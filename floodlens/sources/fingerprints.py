"""Operating-system fingerprint logs: one block of lines per observation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.schemas import FINGERPRINT_ATTRIBUTES

BLOCK_END = "`----"
# The marks of a block. Its title reads `.-[ address/port -> address/port (kind) ]-`,
# and each attribute `| name = value` on a line of its own.
_TITLE, _ARROW, _ATTRIBUTE, _IS = ".-[ ", " -> ", "| ", " = "


def _entry(line: Column) -> Column:
    """Name and value of an attribute line, around its first ` = `."""
    at = F.locate(_IS, line)
    return F.struct(
        F.trim(F.substring(line, F.lit(len(_ATTRIBUTE) + 1), at - len(_ATTRIBUTE) - 1)).alias("k"),
        F.trim(F.substring(line, at + len(_IS), F.length(line))).alias("v"))


def parse_fingerprints(blocks: DataFrame, position: Column, source: Column | None = None
                       ) -> DataFrame:
    """Log blocks (column `value`) as up to two rows per connection: client, server.

    All blocks of a connection are merged; where an attribute occurs more than once, the block
    with the highest `position` wins. `source` separates logs of different captures. The server
    row has the endpoints swapped; a side without any attribute gives no row. The log carries no
    time, so `ts` is 0.
    """
    lines = F.split("value", "\n")
    title = F.get(F.filter(lines, lambda x: F.startswith(x, F.lit(_TITLE))
                           & F.contains(x, F.lit(_ARROW))), F.lit(0))
    ends = F.split(F.substring_index(F.substring(
        title, F.lit(len(_TITLE) + 1), F.length(title)), " (", 1), _ARROW, 2)
    one, two = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
    entries = F.transform(
        F.filter(lines, lambda x: F.startswith(x, F.lit(_ATTRIBUTE)) & F.contains(x, F.lit(_IS))),
        _entry)
    read = blocks.select(
        (source if source is not None else F.lit("")).alias("source"),
        position.alias("position"),
        F.substring_index(one, "/", 1).alias("a"), F.substring_index(one, "/", -1).alias("a_port"),
        F.substring_index(two, "/", 1).alias("b"), F.substring_index(two, "/", -1).alias("b_port"),
        entries.alias("entries"),
    ).filter(F.col("a").isNotNull())

    def last_value(attribute: str) -> Column:
        matches = F.filter("entries", lambda e: e["k"] == attribute)
        return F.try_element_at(matches, F.lit(-1))["v"]

    per_block = read.select(
        "source", "position", "a", "a_port", "b", "b_port",
        F.exists("entries", lambda e: e["k"] == "server").alias("server"),
        *[last_value(name).alias(name) for name in FINGERPRINT_ATTRIBUTES],
    )
    merged = per_block.groupBy("source", "a", "a_port", "b", "b_port", "server").agg(*[
        F.max(F.when(F.col(name).isNotNull(), F.struct("position", name)))[name].alias(name)
        for name in FINGERPRINT_ATTRIBUTES
    ])
    side = {
        "src": F.when(F.col("server"), F.col("b")).otherwise(F.col("a")),
        "sport": F.when(F.col("server"), F.col("b_port")).otherwise(F.col("a_port")),
        "dst": F.when(F.col("server"), F.col("a")).otherwise(F.col("b")),
        "dport": F.when(F.col("server"), F.col("a_port")).otherwise(F.col("b_port")),
    }
    return (
        merged.filter(F.coalesce(*FINGERPRINT_ATTRIBUTES).isNotNull())
        .select(F.lit(0).cast("long").alias("ts"),
                side["src"].alias("src"), side["sport"].try_cast("int").alias("sport"),
                side["dst"].alias("dst"), side["dport"].try_cast("int").alias("dport"),
                *FINGERPRINT_ATTRIBUTES)
    )


def fingerprint_scan(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprint log files as fingerprints; blocks are ordered by their place in the file."""
    blocks = spark.read.text(path, lineSep=BLOCK_END).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.monotonically_increasing_id().alias("row"),
    )
    return parse_fingerprints(blocks, F.struct("offset", "row"), F.col("file"))
