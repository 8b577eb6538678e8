"""Attack drill-down over flow records.

The victim received most packets; its top protocol is the one with most *flows*. As in the packet
drill-down, pass `filtered=True` for flows that are attack traffic already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.functions.rates import megabits, time_bin
from floodlens.functions.summaries import exact_median, rank_first, value_counts
from floodlens.operators import attack
from floodlens.session import staged


def _total_packets() -> Column:
    return F.sum("pkts").cast("double")


def _series(flows: DataFrame, keys: list[Column]) -> DataFrame:
    return flows.groupBy(*keys).agg(
        megabits(F.sum("byts")).alias("mbits_per_second"),
        _total_packets().alias("pkts_per_second"),
    )


def flow_timeseries(flows: DataFrame, binsize: int = 1) -> DataFrame:
    """Megabits and packets per time bin, from the flows' byte and packet counts."""
    return _series(flows, [time_bin("ts", binsize).alias("timestamp")])


def flow_packets_per_dst(flows: DataFrame) -> DataFrame:
    """Packets per destination, most first."""
    return (
        flows.groupBy("ip_dst").agg(_total_packets().alias("packets"))
        .orderBy(*rank_first("packets", "ip_dst"))
    )


def flow_filter_top_dst(flows: DataFrame) -> DataFrame:
    """Flows of the destination that received most packets."""
    top = flow_packets_per_dst(flows).limit(1)
    return flows.filter(F.col("ip_dst") == top.select("ip_dst").scalar())


def flow_proto_stats(flows: DataFrame) -> DataFrame:
    """Flows (not packets) to the victim per protocol name, most first."""
    return (
        flow_filter_top_dst(flows).groupBy("ip_proto").agg(F.count("ts").alias("occurrences"))
        .orderBy(*rank_first("occurrences", "ip_proto"))
    )


def _target(flows: DataFrame) -> DataFrame:
    per_pair = flows.groupBy("ip_dst", "ip_proto").agg(
        F.sum("pkts").alias("pkts"), F.count("ts").alias("flows"))
    best_first = F.struct(-F.col("flows"), F.col("ip_proto").isNull(), "ip_proto")
    return (
        per_pair.groupBy("ip_dst")
        .agg(F.sum("pkts").alias("packets"), F.min_by("ip_proto", best_first).alias("ip_proto"))
        .orderBy(*rank_first("packets", "ip_dst"))
        .limit(1)
    )


def flow_filter_top_proto(flows: DataFrame) -> DataFrame:
    """The attack traffic: flows to the victim over the victim's top protocol."""
    target = _target(flows)
    return flows.filter(
        (F.col("ip_dst") == target.select("ip_dst").scalar())
        & (F.col("ip_proto") == target.select("ip_proto").scalar())
    )


def _attack(flows: DataFrame, filtered: bool) -> DataFrame:
    return flows if filtered else flow_filter_top_proto(flows)


def flow_sources(flows: DataFrame, filtered: bool = False) -> DataFrame:
    """Distinct sources of the attack traffic."""
    return _attack(flows, filtered).select("ip_src").distinct()


def _port_stats(flows: DataFrame, port_dim: DataFrame, side: str, name: str) -> DataFrame:
    label = F.concat(F.col(side).cast("string"), F.lit(":"),
                     F.coalesce(F.col("port_desc"), F.lit("unknown")))
    return (
        flows.groupBy(side).agg(_total_packets().alias("packets"))
        .join(port_dim, F.col(side) == F.col("port_number"), "left")
        .select(label.alias(name), "packets")
        .orderBy(*rank_first("packets", name))
    )


def flow_src_port_stats(flows: DataFrame, port_dim: DataFrame,
                        filtered: bool = False) -> DataFrame:
    """Attack packets per source port, labelled `port:description`."""
    return _port_stats(_attack(flows, filtered), port_dim, "sport", "src_port")


def flow_dst_port_stats(flows: DataFrame, port_dim: DataFrame,
                        filtered: bool = False) -> DataFrame:
    """Attack packets per destination port, labelled `port:description`."""
    return _port_stats(_attack(flows, filtered), port_dim, "dport", "dst_port")


def _value_lists(flows: DataFrame) -> DataFrame:
    """Port and flag sets per source.

    Values are made distinct before they are gathered; a set has at most 65,536 ports or the few
    combinations of TCP flags.
    """
    counts = value_counts(flows, ["ip_src"], {
        "sport": F.col("sport").cast("string"),
        "dport": F.col("dport").cast("string"),
        "flags": F.col("tcp_flg"),
    })

    def ports(kind: str) -> Column:
        return F.sort_array(F.collect_list(
            F.when(F.col("kind") == kind, F.col("value").cast("int"))))

    return counts.groupBy(F.col("ip_src").alias("_src")).agg(
        ports("sport").alias("sports"),
        ports("dport").alias("dports"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "flags", F.col("value"))))
        .alias("distinct_flags"),
    )


def flow_source_stats(flows: DataFrame, filtered: bool = False) -> DataFrame:
    """12 columns per source: packets, port lists, bytes per flow (`pkt_length_*`), flag set."""
    traffic = _attack(flows, filtered)
    totals = traffic.groupBy(F.col("ip_src").alias("src_ip")).agg(
        _total_packets().alias("total_packets"),
        F.avg("byts").alias("pkt_length_avg"),
        F.min("byts").alias("pkt_length_min"),
        F.max("byts").alias("pkt_length_max"),
        F.stddev_pop("byts").alias("pkt_length_std_dev"),
    )
    values = _value_lists(traffic)
    medians = (
        exact_median(traffic, "ip_src", "byts", "pkt_length_median")
        .withColumnRenamed("ip_src", "_median_src")
    )
    return (
        totals
        .join(values, F.col("src_ip").eqNullSafe(F.col("_src")), "left")
        .join(medians, F.col("src_ip").eqNullSafe(F.col("_median_src")), "left")
        .select(
            "src_ip", "total_packets",
            F.array_join("sports", ",").alias("distinct_sport"),
            F.array_join("dports", ",").alias("distinct_dport"),
            F.size("sports").cast("long").alias("tot_distinct_sport"),
            F.size("dports").cast("long").alias("tot_distinct_dport"),
            "pkt_length_avg", "pkt_length_min", "pkt_length_max", "pkt_length_median",
            "pkt_length_std_dev", "distinct_flags",
        )
    )


def _source_bins(flows: DataFrame, binsize: int, filtered: bool) -> DataFrame:
    return _series(_attack(flows, filtered),
                   [F.col("ip_src").alias("src_ip"), time_bin("ts", binsize).alias("bin")])


def flow_source_timeseries(flows: DataFrame, binsize: int = 1,
                           filtered: bool = False) -> DataFrame:
    """Megabits and packets per (source, bin), in the order of the bins."""
    return _source_bins(flows, binsize, filtered).orderBy("bin", "src_ip")


def flow_source_rates(flows: DataFrame, binsize: int = 1, filtered: bool = False) -> DataFrame:
    """Mean rates per source over the bins with traffic."""
    return _source_bins(flows, binsize, filtered).groupBy("src_ip").agg(
        F.avg("mbits_per_second").alias("mbits_per_second_avg"),
        F.avg("pkts_per_second").alias("pkts_per_second_avg"))


def flow_source_stats_asn(flows: DataFrame, asn_dim: DataFrame, binsize: int = 1,
                          filtered: bool = False) -> DataFrame:
    """Statistics, rates and network of each source, 18 columns, most packets first.

    The attack traffic is taken out of the flows once and staged.
    """
    traffic = flows if filtered else staged(flow_filter_top_proto(flows), "attack-flows")
    joined = flow_source_stats(traffic, filtered=True).join(
        flow_source_rates(traffic, binsize, filtered=True), "src_ip", "left")
    return (
        attack.join_asn(joined, asn_dim)
        .orderBy(*rank_first("total_packets", "src_ip"))
    )


def _flow_source_counts(flows: DataFrame, asn_dim: DataFrame, column: str,
                        filtered: bool) -> DataFrame:
    sources = flow_sources(flows, filtered).withColumnRenamed("ip_src", "src_ip")
    return attack.count_sources(sources, asn_dim, column)


def flow_country_stats(flows: DataFrame, asn_dim: DataFrame, filtered: bool = False) -> DataFrame:
    """Attacking sources per country."""
    return _flow_source_counts(flows, asn_dim, "country", filtered)


def flow_bgp_stats(flows: DataFrame, asn_dim: DataFrame, filtered: bool = False) -> DataFrame:
    """Attacking sources per routed prefix."""
    return _flow_source_counts(flows, asn_dim, "bgp_prefix", filtered)


def flow_asn_stats(flows: DataFrame, asn_dim: DataFrame, filtered: bool = False) -> DataFrame:
    """Attacking sources per autonomous system."""
    return _flow_source_counts(flows, asn_dim, "asn", filtered)
