"""Delimited packet and flow records, the raw flow export, and the lookup dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodlens import schemas
from floodlens.functions.addresses import in_network
from floodlens.functions.rates import epoch_seconds

_NO_QUOTES = {"quote": "", "escape": "", "mode": "PERMISSIVE"}


def _as_strings(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def _typed(schema: T.StructType, root: str = "") -> list[Column]:
    """Cast text columns to the schema; empty, `NONE` and malformed values become null."""
    columns = []
    for field in schema.fields:
        text = F.col(f"{root}{field.name}")
        present = F.when(~text.isin("", "NONE"), text)
        if isinstance(field.dataType, T.StringType):
            value = present
        elif field.name == "ts":
            value = present.try_cast("double").try_cast("long")
        else:
            value = present.try_cast(field.dataType)
        columns.append(value.alias(field.name))
    return columns


def _scan(spark: SparkSession, path: str, schema: T.StructType, sep: str) -> DataFrame:
    raw = spark.read.schema(_as_strings(schema)).options(sep=sep, **_NO_QUOTES).csv(path)
    return raw.select(*_typed(schema))


def _parse(lines: DataFrame, schema: T.StructType, sep: str) -> DataFrame:
    options = {"sep": sep, **_NO_QUOTES}
    record = F.from_csv(F.col("value"), _as_strings(schema).simpleString()[7:-1]
                        .replace(":", " "), options)
    return lines.select(record.alias("r")).select(*_typed(schema, "r."))


def packet_scan(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """Packet text files as typed packets; a fractional `ts` is truncated."""
    return _scan(spark, path, schemas.PACKETS, sep)


def parse_packets(lines: DataFrame, sep: str = " ") -> DataFrame:
    """The same over a DataFrame of lines (column `value`)."""
    return _parse(lines, schemas.PACKETS, sep)


def flow_scan(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """Flow text files as typed flows."""
    return _scan(spark, path, schemas.FLOWS, sep)


def parse_flows(lines: DataFrame, sep: str = " ") -> DataFrame:
    """The same over a DataFrame of lines."""
    return _parse(lines, schemas.FLOWS, sep)


def flow_export_scan(spark: SparkSession, path: str) -> DataFrame:
    """Raw comma-separated flow export, all columns as text."""
    return spark.read.schema(schemas.FLOW_EXPORT).options(sep=",", **_NO_QUOTES).csv(path)


def flow_prepare(raw: DataFrame, cidr: str) -> DataFrame:
    """Flow export rows into `cidr` from outside of it, as typed flows."""
    wanted = in_network("dst_addr", cidr) & ~in_network("src_addr", cidr)
    return raw.filter(wanted).select(
        epoch_seconds(F.col("first_seen")).alias("ts"),
        F.trim("protocol").alias("ip_proto"),
        F.col("src_addr").alias("ip_src"),
        F.col("dst_addr").alias("ip_dst"),
        F.trim("src_port").try_cast("int").alias("sport"),
        F.trim("dst_port").try_cast("int").alias("dport"),
        F.trim("in_packets").try_cast("long").alias("pkts"),
        F.trim("in_bytes").try_cast("long").alias("byts"),
        F.trim("flags").alias("tcp_flg"),
        F.trim("tos").try_cast("int").alias("stos"),
    )


def protocol_dim_scan(spark: SparkSession, path: str) -> DataFrame:
    """`number,description` lines of IP protocols."""
    return _scan(spark, path, schemas.PROTOCOL_DIM, ",")


def port_dim_scan(spark: SparkSession, path: str) -> DataFrame:
    """`number,description` lines of ports."""
    return _scan(spark, path, schemas.PORT_DIM, ",")


def asn_dim_scan(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon-separated network lookup table; empty fields are null."""
    return _scan(spark, path, schemas.ASN_DIM, ";")


def whois_clean(lines: DataFrame) -> DataFrame:
    """Pipe-separated registry response lines as the network lookup table.

    Blanks are dropped everywhere, commas of the description become dashes, empty fields are
    null. Response banners and other lines without five fields are left out.
    """
    parts = F.split(F.regexp_replace("value", " ", ""), r"\|", -1)
    fields = [F.get("p", F.lit(i)) for i in range(5)]
    fields[4] = F.translate(fields[4], ",", "-")
    return (
        lines.select(parts.alias("p")).filter(F.size("p") >= 5)
        .select(*[F.nullif(field, F.lit("")).alias(name)
                  for field, name in zip(fields, schemas.ASN_DIM.names)])
    )


def whois_scan(spark: SparkSession, path: str) -> DataFrame:
    """Registry response files as the network lookup table."""
    return whois_clean(spark.read.text(path))
