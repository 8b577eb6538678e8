"""Earlier variants of the packet drill-down, with their own output columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.functions.summaries import rank_first, value_counts
from floodlens.operators import attack


def legacy_proto_stats(packets: DataFrame, ip_proto_dim: DataFrame) -> DataFrame:
    """Packets to the victim per protocol, labelled by the description alone."""
    counts = attack.proto_counts(packets)
    return (
        counts.join(ip_proto_dim, F.col("ip_proto") == F.col("ip_proto_number"), "left")
        .select(F.col("ip_proto_desc").alias("ip_proto"), "occurrences")
        .orderBy(*rank_first("occurrences", "ip_proto"))
    )


def legacy_port_stats(packets: DataFrame, port_dim: DataFrame, side: str = "sport",
                      filtered: bool = False) -> DataFrame:
    """Packets per port with port and description apart.

    The port is taken from the UDP side only: ports seen over TCP alone stay null, one row each.
    """
    traffic = packets if filtered else attack.filter_top_proto(packets)
    name = "src_port" if side == "sport" else "dst_port"
    counts = attack.port_counts(traffic, side).withColumn(
        name, F.when(F.col("udp_packets") > 0, F.col("port")))
    return (
        counts.join(port_dim, F.col(name) == F.col("port_number"), "left")
        .select(name, F.coalesce("port_desc", F.lit("unknown")).alias("port_desc"),
                "udp_packets", "tcp_packets", "packets")
        .orderBy(*rank_first("packets", name))
    )


def unique_sources(packets: DataFrame, filtered: bool = False) -> DataFrame:
    """Number of distinct attacking sources."""
    return attack.attack_sources(packets, filtered).agg(F.count("ip_src").alias("sources"))


def legacy_source_stats(packets: DataFrame, filtered: bool = False) -> DataFrame:
    """15 columns per source; fragments are packets with `ip_frag_offset` above 0."""
    traffic = packets if filtered else attack.filter_top_proto(packets)
    fragment = (F.col("ip_frag_offset") > 0) & F.col("ts").isNotNull()
    totals = traffic.groupBy(F.col("ip_src").alias("src_ip")).agg(
        F.count("ts").alias("total_packets"),
        F.count_if(fragment).alias("packets_fragment_marked"),
        F.avg("ip_total_length").alias("pkt_length_avg"),
        F.min("ip_total_length").alias("pkt_length_min"),
        F.max("ip_total_length").alias("pkt_length_max"),
        F.stddev_pop("ip_total_length").alias("pkt_length_std_dev"),
        F.avg("ip_ttl").alias("ttl_avg"),
        F.min("ip_ttl").alias("ttl_min"),
        F.max("ip_ttl").alias("ttl_max"),
        F.stddev_pop("ip_ttl").alias("ttl_std_dev"),
    )
    values = value_counts(traffic, ["ip_src"], {
        "udp_sport": F.col("udp_sport"), "length": F.col("ip_total_length"),
    }).groupBy(F.col("ip_src").alias("_src")).agg(
        F.count_if(F.col("kind") == "udp_sport").alias("ports"),
        F.percentile(F.when(F.col("kind") == "length", F.col("value")), F.lit(0.5), F.col("n"))
        .alias("pkt_length_median"),
    )
    return (
        totals.join(values, F.col("src_ip").eqNullSafe(F.col("_src")), "left")
        .select(
            "src_ip", "total_packets", "packets_fragment_marked",
            (F.col("total_packets") - F.col("packets_fragment_marked"))
            .alias("packets_non_fragment_marked"),
            F.coalesce("ports", F.lit(0).cast("long")).alias("num_distinct_udp_sport"),
            "pkt_length_avg", "pkt_length_median", "pkt_length_min", "pkt_length_max",
            "pkt_length_std_dev", "ttl_avg", "ttl_min", "ttl_max", "ttl_std_dev",
        )
        .orderBy(*rank_first("total_packets", "src_ip"))
    )


def legacy_source_rates(packets: DataFrame, binsize: int = 1,
                        filtered: bool = False) -> DataFrame:
    """Mean rates per source, highest packet rate first."""
    return (
        attack.source_rate_stats(packets, binsize, filtered=filtered)
        .orderBy(*rank_first("pkts_per_bin_avg", "src_ip"))
    )
