"""A filter of bounded size ahead of a join: rows of the large side that cannot match stay where they
are instead of being shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one row of `bitmap_construct_agg` (a fixed value of Spark).
_ROW_BITS = 32_768
BITS_PER_KEY = 16
MOST_BITS = 1 << 24     # 2 MB of filter, for about a million keys
_PROBES = 2


def _places(keys: Sequence[str], bits: int) -> list[Column]:
    """Bits that a key sets, from 0."""
    return [F.pmod(F.xxhash64(*keys, F.lit(probe)), F.lit(bits)) for probe in range(_PROBES)]


def filter_bits(keys: int) -> int:
    """Bits of the filter for so many keys, a whole number of rows; 0 if it would exceed the bound."""
    rows = -(-max(keys, 1) * BITS_PER_KEY // _ROW_BITS)
    return rows * _ROW_BITS if rows * _ROW_BITS <= MOST_BITS else 0


def key_filter(small: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """One row with the filter of all keys of `small`, as `bits` / 8 bytes.

    Tasks set the bits of their own keys; what is shuffled is at most one row of 4 KB for each 32,768
    bits and task, whatever the number of rows.
    """
    places = small.select(F.explode(F.array(*_places(keys, bits))).alias("place"))
    # Numbers from 1 on: the functions take the bits of a bucket as 1 to 32,768.
    parts = places.groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("part"))
    empty = small.sparkSession.range(1, bits // _ROW_BITS + 1).select(
        F.col("id").alias("bucket"), F.lit(bytes(_ROW_BITS // 8)).alias("part"))
    whole = parts.unionByName(empty).groupBy("bucket").agg(F.bitmap_or_agg("part").alias("part"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("bucket", "part"))),
                          lambda row: row["part"])
    return whole.agg(F.aggregate(ordered, F.lit(b""), lambda held, part: F.concat(
        held, part)).alias("bits"))


def may_match(bits: Column, keys: Sequence[str], size: int) -> Column:
    """Whether the filter has all bits of a row's key; false only for keys that it was not given."""
    found = F.lit(True)
    for place in _places(keys, size):
        byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10)
        found = found & (byte.cast("int").bitwiseAND(
            F.pow(F.lit(2.0), place % 8).cast("int")) > 0)
    return found


def only_possible(large: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of `large` whose key may occur in `small`: all that match, and few others.

    For inner and semi joins on `keys`. The filter is sized by the number of rows of `small`; above
    a million it is left out, and `large` comes back as it is.
    """
    bits = filter_bits(small.count())
    if not bits:
        return large
    held = key_filter(small, keys, bits).select("bits").scalar()
    return large.where(may_match(held, keys, bits))
