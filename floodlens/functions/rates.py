"""Time bins and data rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_bin(ts: Column | str, size: int) -> Column:
    """Start of the fixed-size bin; the quotient truncates, like an integer division."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts - ts % F.lit(size).cast("long")


def megabits(total_bytes: Column, single_precision: bool = False) -> Column:
    """Megabits of a byte total; `single_precision` rounds as 32-bit floats do."""
    if single_precision:
        return (total_bytes.cast("float") * F.lit(8.0).cast("float")
                / F.lit(1000000.0).cast("float")).cast("float")
    return total_bytes * 8 / F.lit(1000000.0)


def epoch_seconds(text: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss[.fff]` text as seconds since 1970, whatever the session time zone."""
    day = F.unix_date(F.substring(text, 1, 10).try_cast("date"))
    clock = F.split(F.substring(text, 12, 8), ":")
    return (day * F.lit(86400).cast("long")
            + F.get(clock, F.lit(0)).try_cast("int") * 3600
            + F.get(clock, F.lit(1)).try_cast("int") * 60
            + F.get(clock, F.lit(2)).try_cast("int"))
