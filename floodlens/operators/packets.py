"""General packet queries: volumes, ports, sizes, fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens import schemas
from floodlens.functions.rates import time_bin
from floodlens.functions.summaries import rank_first

TCP, UDP = 6, 17


def _tcp(packets: DataFrame) -> DataFrame:
    return packets.filter(F.col("ip_proto") == TCP)


def packet_total(packets: DataFrame) -> DataFrame:
    """Number of packets."""
    return packets.agg(F.count("ts").alias("packets"))


def packet_volume(packets: DataFrame) -> DataFrame:
    """Number of packets and bytes."""
    return packets.agg(F.count("ts").alias("packets"), F.sum("ip_total_length").alias("bytes"))


def packets_all(packets: DataFrame) -> DataFrame:
    """All packets, in the columns of the record layout."""
    return packets.select(*schemas.PACKETS.names)


def packets_with_data(packets: DataFrame) -> DataFrame:
    """Packets that carry TCP payload."""
    return packets.filter(F.col("tcp_len") > 0)


def bandwidth(packets: DataFrame, time: int = 60) -> DataFrame:
    """Bytes per time bin."""
    return packets.groupBy(time_bin("ts", time).alias("bin")).agg(
        F.sum("ip_total_length").alias("bytes"))


def bandwidth_by_protocol(packets: DataFrame, time: int = 60) -> DataFrame:
    """TCP payload, UDP and total bytes of the bins that saw both TCP and UDP."""
    def part(protocol: int, column: str):
        return F.when(F.col("ip_proto") == protocol, F.col(column))

    return (
        packets.filter(F.col("ts").isNotNull())
        .groupBy(time_bin("ts", time).alias("bin"))
        .agg(
            F.sum(part(TCP, "tcp_len")).alias("tcp_bytes"),
            F.sum(part(UDP, "udp_len")).alias("udp_bytes"),
            F.sum("ip_total_length").alias("total_bytes"),
            F.count_if(F.col("ip_proto") == TCP).alias("tcp_seen"),
            F.count_if(F.col("ip_proto") == UDP).alias("udp_seen"),
        )
        .filter((F.col("tcp_seen") > 0) & (F.col("udp_seen") > 0))
        .drop("tcp_seen", "udp_seen")
    )


def top_dst_ports(packets: DataFrame, n: int = 10) -> DataFrame:
    """The n TCP destination ports with most packets (packets without one form a group)."""
    return (
        packets.groupBy(F.col("tcp_dport").alias("port"))
        .agg(F.count("ts").alias("count_packets"))
        .orderBy(*rank_first("count_packets", "port"))
        .limit(n)
    )


def common_sources(packets_a: DataFrame, packets_b: DataFrame) -> DataFrame:
    """Sources present in both captures."""
    first = packets_a.select("ip_src").distinct()
    second = packets_b.select("ip_src").distinct()
    return second.join(first, "ip_src")


def packet_size_histogram(packets: DataFrame) -> DataFrame:
    """Packets per IP length, rarest first."""
    return (
        packets.groupBy("ip_total_length").agg(F.count("ts").alias("packets"))
        .orderBy("packets", "ip_total_length")
    )


def port_volume(packets: DataFrame) -> DataFrame:
    """TCP packets and payload per destination port, most payload first."""
    return (
        _tcp(packets).groupBy(F.col("tcp_dport").alias("port"))
        .agg(F.count("ts").alias("packets"), F.sum("tcp_len").alias("payload"))
        .orderBy(*rank_first("payload", "port"))
    )


def source_volume(packets: DataFrame) -> DataFrame:
    """Packets and TCP payload per source, most payload first."""
    return (
        packets.groupBy("ip_src")
        .agg(F.count("ts").alias("packets"), F.sum("tcp_len").alias("payload"))
        .orderBy(*rank_first("payload", "ip_src"))
    )


def port_inout_volume(packets: DataFrame) -> DataFrame:
    """Bytes to and from each TCP port, for the ports seen on both sides."""
    directions = F.array(
        F.struct(F.col("tcp_dport").alias("port"), F.lit(True).alias("to_port")),
        F.struct(F.col("tcp_sport").alias("port"), F.lit(False).alias("to_port")),
    )
    return (
        packets.filter(F.col("tcp_sport") > 0)
        .select("ip_total_length", F.inline(directions))
        .filter(F.col("port").isNotNull())
        .groupBy("port")
        .agg(F.sum(F.when(F.col("to_port"), F.col("ip_total_length"))).alias("bytes_in"),
             F.sum(F.when(~F.col("to_port"), F.col("ip_total_length"))).alias("bytes_out"),
             F.count_if("to_port").alias("n_in"), F.count_if(~F.col("to_port")).alias("n_out"))
        .filter((F.col("n_in") > 0) & (F.col("n_out") > 0))
        .select("port", (F.col("bytes_in") + F.col("bytes_out")).alias("bytes"))
    )


def source_fanout(packets: DataFrame) -> DataFrame:
    """Distinct destinations of each TCP source."""
    return _tcp(packets).groupBy("ip_src").agg(F.count_distinct("ip_dst").alias("destinations"))


def source_ports(packets: DataFrame) -> DataFrame:
    """Destination ports of each TCP source, as a sorted set and a count.

    Ports are made distinct before they are gathered, so a set has at most 65,536 entries.
    """
    return (
        _tcp(packets).select("ip_src", "tcp_dport").distinct()
        .groupBy("ip_src")
        .agg(F.sort_array(F.collect_list("tcp_dport")).alias("dst_ports"),
             F.count("tcp_dport").alias("num_dst_ports"))
    )


def src_dst_volume(packets: DataFrame) -> DataFrame:
    """TCP packets and payload per (source, destination)."""
    return _tcp(packets).groupBy("ip_src", "ip_dst").agg(
        F.count("ts").alias("packets"), F.sum("tcp_len").alias("payload"))
