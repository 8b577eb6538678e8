"""Aggregations that stay bounded per group, however hot one key is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_first(count: str, *keys: str) -> list[Column]:
    """Ordering for a top-1 / report: largest count, then smallest key."""
    return [F.col(count).desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in keys]]


def value_counts(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """How often each value occurs per key, for several columns in one pass.

    Result: keys, `kind` (name in `values`), `value`, `n`. Nulls are left out. The counts are
    combined before the shuffle and spread over (key, kind, value), so that the rows of one hot
    key end up in many partitions.
    """
    entries = F.array(*[
        F.struct(F.lit(kind).alias("kind"), column.alias("value"))
        for kind, column in values.items()
    ])
    return (
        df.select(*keys, F.inline(entries))
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "kind", "value")
        .agg(F.count("*").alias("n"))
    )


def exact_median(df: DataFrame, key: str, value: str, name: str,
                 block_bits: int = 16) -> DataFrame:
    """Exact median of an integer column per key, with no key's values held by one task.

    Values are counted, the counts are summed per block of 2^block_bits values, the one or two
    blocks holding the middle ranks are found on those sums, and only their values are ranked.
    For 32-bit values no window sees more than 65,536 rows of a key.
    """
    # Both uses of the counts below carry the same conditions, so that they share one exchange.
    number = F.col(value).cast("long")
    counts = (
        df.filter(F.col(value).isNotNull() & F.shiftright(number, block_bits).isNotNull())
        .groupBy(key, number.alias("_value"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_block", F.shiftright("_value", block_bits))
    )
    by_block = Window.partitionBy(key).orderBy("_block")
    whole_key = Window.partitionBy(key)
    blocks = (
        counts.groupBy(key, "_block").agg(F.sum("_n").alias("_size"))
        .withColumn("_before", F.sum("_size").over(
            by_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size"))
        .withColumn("_total", F.sum("_size").over(whole_key))
    )
    low = F.floor((F.col("_total") - 1) / 2)
    high = F.floor(F.col("_total") / 2)

    def covers(rank: Column, start: str, size: str) -> Column:
        return (F.col(start) <= rank) & (rank < F.col(start) + F.col(size))

    middle = (
        blocks.filter(covers(low, "_before", "_size") | covers(high, "_before", "_size"))
        .select(F.col(key).alias("_key"), F.col("_block").alias("_middle"), "_before", "_total")
    )
    in_block = Window.partitionBy(key, "_block").orderBy("_value")
    ranked = (
        counts.join(middle, F.col(key).eqNullSafe(F.col("_key"))
                    & (F.col("_block") == F.col("_middle")))
        .withColumn("_start", F.col("_before") - F.col("_n") + F.sum("_n").over(
            in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    hit = F.when(covers(low, "_start", "_n"), F.col("_value"))
    hit_high = F.when(covers(high, "_start", "_n"), F.col("_value"))
    return ranked.groupBy(key).agg(((F.max(hit) + F.max(hit_high)) / 2.0).alias(name))
