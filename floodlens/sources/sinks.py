"""Result sinks: report CSV, JSON objects, external stores, one folder per connection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_report_sink(df: DataFrame, folder: str, single_file: bool = False) -> None:
    """A result as CSV with header, in as many files as tasks. `single_file` is for report-sized
    results; the rows are shuffled, so that the work before them stays spread."""
    out = df.repartition(1) if single_file else df
    out.write.option("header", True).csv(folder)


def delimited_sink(df: DataFrame, folder: str, sep: str = "\t") -> None:
    """A result as delimited text without header."""
    df.write.option("sep", sep).csv(folder)


def json_sink(df: DataFrame, folder: str) -> None:
    """Rows as JSON objects, one per line, with nulls written out."""
    df.write.option("ignoreNullFields", "false").json(folder)


def external_store_sink(df: DataFrame, uri: str, format: str = "parquet",
                        **options: str) -> None:
    """A result to any store Spark has a writer for."""
    df.write.format(format).options(**options).save(uri)


def connection_name(src: str = "ip_src", sport: str = "tcp_sport", dst: str = "ip_dst",
                    dport: str = "tcp_dport") -> Column:
    """`a.port-b.port`, the same for both directions of a connection."""
    one = F.struct(F.col(src).alias("ip"), F.col(sport).alias("port"))
    two = F.struct(F.col(dst).alias("ip"), F.col(dport).alias("port"))
    first, second = F.least(one, two), F.greatest(one, two)
    return F.concat(first["ip"], F.lit("."), first["port"].cast("string"), F.lit("-"),
                    second["ip"], F.lit("."), second["port"].cast("string"))


def with_connection(packets: DataFrame) -> DataFrame:
    """TCP packets with ports, and the name of their connection."""
    held = ((F.col("ip_proto") == 6) & F.col("tcp_sport").isNotNull()
            & F.col("tcp_dport").isNotNull())
    return packets.filter(held).withColumn("connection", connection_name())


def connection_split(packets: DataFrame, folder: str, groups: int = 4096) -> None:
    """TCP packets as Parquet, apart by connection.

    Connections are hashed into `groups` folders, and within a folder the files are sorted by
    connection, so the number of folders does not grow with the number of connections and a read
    of one connection still touches one folder and few row groups. The rebalance hint splits a
    hot group over several files and joins small ones. `connection_packets` reads one connection.
    """
    (
        with_connection(packets)
        .withColumn("connection_group", _group(F.col("connection"), groups))
        .hint("rebalance", "connection_group")
        .sortWithinPartitions("connection_group", "connection", "ts")
        .write.partitionBy("connection_group").parquet(folder)
    )


def _group(connection: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(connection), F.lit(groups)).cast("int")


def connection_packets(split: DataFrame, connection: str, groups: int = 4096) -> DataFrame:
    """The packets of one connection from a split read back as `split`."""
    return split.filter(
        (F.col("connection_group") == _group(F.lit(connection), groups))
        & (F.col("connection") == connection))
