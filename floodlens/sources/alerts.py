"""Intrusion-alert log lines ("fast" format)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The marks of an alert line, which reads
#   time  [**] [generator:rule:revision] message [**] ... [Priority: n] {protocol} end -> end
_PRIORITY = "[Priority: "
_ARROW = " -> "


def _before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def _behind(text: Column, mark: str) -> Column:
    """What follows the first `mark`; null without it."""
    at = F.locate(mark, text)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def _end(text: Column, protocol: Column) -> tuple[Column, Column]:
    """Address and port of one end. A dotted address has its port behind a colon; one of colons
    has it behind the last colon, if the protocol knows ports."""
    text = F.trim(text)
    last = F.substring_index(text, ":", -1)
    colons = F.contains(text, F.lit(":"))
    has_port = colons & (F.contains(text, F.lit(".")) | F.upper(protocol).isin("TCP", "UDP"))
    address = F.when(has_port, F.substring(
        text, F.lit(1), F.length(text) - F.length(last) - 1)).otherwise(text)
    return address, F.coalesce(F.when(has_port, last).try_cast("int"), F.lit(0))


def parse_alerts(lines: DataFrame, compat: bool = False) -> DataFrame:
    """Alert lines (column `value`) as alerts; lines of another shape are skipped.

    A line is cut at its marks: the time and the rule before the message, the priority, the
    protocol and the two ends behind it. `compat=True` adds the fraction of the time as
    milliseconds, whatever its number of digits.
    """
    three = lines.select(F.split("value", r" +\[\*\*\] +", 3).alias("p")).where(F.size("p") == 3)
    head, rule, tail = (F.trim(F.get("p", F.lit(i))) for i in range(3))
    braces = F.substring_index(tail, "{", -1)
    protocol, ends = _before(braces, "}"), _behind(braces, "}")
    ids = F.split(_before(F.substring(rule, F.lit(2), F.length(rule)), "]"), ":")
    src, sport = _end(_before(ends, _ARROW), protocol)
    dst, dport = _end(_before(F.trim(_behind(ends, _ARROW)), " "), protocol)
    rows = three.where(
        rule.startswith("[") & (F.size(ids) == 3) & F.contains(tail, F.lit("{"))
        & F.contains(ends, F.lit(_ARROW))
    ).select(
        F.substring_index(head, " ", -1).alias("time"),
        F.concat_ws("_", F.get(ids, F.lit(0)), F.get(ids, F.lit(1))).alias("sig"),
        _before(_behind(tail, _PRIORITY), "]").try_cast("int").alias("priority"),
        F.trim(_behind(rule, "]")).alias("message"), protocol.alias("proto"),
        src.alias("src"), sport.alias("sport"), dst.alias("dst"), dport.alias("dport"))

    # MM/dd/yy-HH:mm:ss.ffffff, read without a session time zone.
    stamp = F.split("time", r"[/:.\-]", -1)
    number = [F.get(stamp, F.lit(i)).try_cast("int") for i in range(6)]
    day = F.unix_date(F.concat_ws(
        "-", (number[2] + 2000).cast("string"), F.get(stamp, F.lit(0)), F.get(stamp, F.lit(1))
    ).try_cast("date"))
    seconds = (day * F.lit(86400).cast("long") + number[3] * 3600 + number[4] * 60 + number[5])
    if compat:
        fraction = F.coalesce(F.get(stamp, F.lit(6)).try_cast("long"), F.lit(0))
        seconds = seconds + F.floor(fraction / 1000)
    return rows.select(
        seconds.alias("ts"), "sig", "priority", "message", "proto", "src", "sport", "dst", "dport",
    ).filter(F.col("ts").isNotNull() & F.col("priority").isNotNull())


def alert_scan(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """Alert log files as alerts."""
    return parse_alerts(spark.read.text(path), compat)
