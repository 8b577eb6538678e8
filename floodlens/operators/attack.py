"""Attack drill-down over packets.

The victim is the destination that received most packets, the attack traffic is what reached it
over the victim's top IP protocol. Every function takes raw packets; pass `filtered=True` when
they are attack traffic already (for instance a staged copy shared by several results).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.functions.rates import megabits, time_bin
from floodlens.functions.summaries import exact_median, rank_first, value_counts
from floodlens.session import staged

# Output name of each summed TCP flag.
FLAG_COLUMNS = {
    "CWR": "tcp_cwr", "ECE": "tcp_ece", "URG": "tcp_urg", "ACK": "tcp_ack",
    "PSH": "tcp_psh", "RST": "tcp_rst", "SYN": "tcp_syn", "FIN": "tcp_fin",
}


#: Columns of the attack traffic that statistics of its sources are made of.
_SOURCE_COLUMNS = ["ts", "ip_src", "ip_total_length", "ip_ttl", "ip_more_fragments", "udp_sport",
                   "udp_dport", "tcp_sport", "tcp_dport", *FLAG_COLUMNS.values()]


def _series(packets: DataFrame, keys: list[Column], single_precision: bool) -> DataFrame:
    return packets.groupBy(*keys).agg(
        megabits(F.sum("ip_total_length"), single_precision).alias("mbits_per_bin"),
        F.count("ts").alias("pkts_per_bin"),
    )


def traffic_timeseries(packets: DataFrame, binsize: int = 1,
                       single_precision: bool = False) -> DataFrame:
    """Megabits and packets per time bin."""
    return _series(packets, [time_bin("ts", binsize).alias("timestamp")], single_precision)


def packets_per_dst(packets: DataFrame) -> DataFrame:
    """Packets per destination, most first."""
    return (
        packets.groupBy("ip_dst").agg(F.count("ts").alias("packets"))
        .orderBy(*rank_first("packets", "ip_dst"))
    )


def filter_top_dst(packets: DataFrame) -> DataFrame:
    """Packets of the destination that received most; ties go to the smaller address."""
    top = packets_per_dst(packets).limit(1)
    return packets.filter(F.col("ip_dst") == top.select("ip_dst").scalar())


def _target(packets: DataFrame) -> DataFrame:
    """One row: the victim and its top protocol, from a single pass over the packets."""
    per_pair = packets.groupBy("ip_dst", "ip_proto").agg(F.count("ts").alias("n"))
    best_first = F.struct(-F.col("n"), F.col("ip_proto").isNull(), "ip_proto")
    return (
        per_pair.groupBy("ip_dst")
        .agg(F.sum("n").alias("packets"), F.min_by("ip_proto", best_first).alias("ip_proto"))
        .orderBy(*rank_first("packets", "ip_dst"))
        .limit(1)
    )


def filter_top_proto(packets: DataFrame) -> DataFrame:
    """The attack traffic: packets to the victim over the victim's top protocol.

    Both values are scalar subqueries over the same (destination, protocol) counts, so that the
    counting shuffle runs once and the two equalities reach the Parquet scan as filters.
    """
    target = _target(packets)
    return packets.filter(
        (F.col("ip_dst") == target.select("ip_dst").scalar())
        & (F.col("ip_proto") == target.select("ip_proto").scalar())
    )


def _attack(packets: DataFrame, filtered: bool) -> DataFrame:
    return packets if filtered else filter_top_proto(packets)


def proto_counts(packets: DataFrame) -> DataFrame:
    """Packets to the victim per IP protocol number."""
    return filter_top_dst(packets).groupBy("ip_proto").agg(F.count("ts").alias("occurrences"))


def ip_proto_stats(packets: DataFrame, ip_proto_dim: DataFrame) -> DataFrame:
    """Packets to the victim per protocol, labelled `number:description`.

    A protocol without description has a null label; one described twice gives two rows.
    """
    counts = proto_counts(packets)
    return (
        counts.join(ip_proto_dim, F.col("ip_proto") == F.col("ip_proto_number"), "left")
        .select(
            F.concat(F.col("ip_proto").cast("string"), F.lit(":"), F.col("ip_proto_desc"))
            .alias("ip_proto"),
            "occurrences",
        )
        .orderBy(*rank_first("occurrences", "ip_proto"))
    )


def attack_sources(packets: DataFrame, filtered: bool = False) -> DataFrame:
    """Distinct sources of the attack traffic."""
    return _attack(packets, filtered).select("ip_src").distinct()


def port_counts(packets: DataFrame, side: str, tcp_gate: str | None = None) -> DataFrame:
    """UDP and TCP packets per port (> 0), both protocols in one pass.

    `side` is `sport` or `dport`. `tcp_gate` names another TCP column that must be positive for
    a TCP packet to count, whatever its own port is.
    """
    gate = F.col(tcp_gate or f"tcp_{side}") > 0
    entries = F.array(
        F.struct(F.lit("udp").alias("kind"), F.col(f"udp_{side}").alias("port"),
                 (F.col(f"udp_{side}") > 0).alias("keep")),
        F.struct(F.lit("tcp").alias("kind"), F.col(f"tcp_{side}").alias("port"),
                 gate.alias("keep")),
    )
    counted = F.col("ts").isNotNull()
    return (
        packets.select("ts", F.inline(entries))
        .filter("keep")
        .groupBy("port")
        .agg(F.count_if((F.col("kind") == "udp") & counted).alias("udp_packets"),
             F.count_if((F.col("kind") == "tcp") & counted).alias("tcp_packets"))
        .withColumn("packets", F.col("udp_packets") + F.col("tcp_packets"))
    )


def _port_stats(packets: DataFrame, port_dim: DataFrame, side: str, name: str,
                tcp_gate: str | None = None) -> DataFrame:
    label = F.concat(F.col("port").cast("string"), F.lit(":"),
                     F.coalesce(F.col("port_desc"), F.lit("unknown")))
    return (
        port_counts(packets, side, tcp_gate)
        .join(port_dim, F.col("port") == F.col("port_number"), "left")
        .select(label.alias(name), "udp_packets", "tcp_packets", "packets")
        .orderBy(*rank_first("packets", name))
    )


def src_port_stats(packets: DataFrame, port_dim: DataFrame, filtered: bool = False) -> DataFrame:
    """UDP, TCP and all attack packets per source port, labelled `port:description`."""
    return _port_stats(_attack(packets, filtered), port_dim, "sport", "src_port")


def dst_port_stats(packets: DataFrame, port_dim: DataFrame, compat: bool = False,
                   filtered: bool = False) -> DataFrame:
    """The same per destination port.

    `compat=True` counts the TCP packets whose *source* port is positive, as the original
    analysis did.
    """
    return _port_stats(_attack(packets, filtered), port_dim, "dport", "dst_port",
                       "tcp_sport" if compat else None)


def attack_timeseries(packets: DataFrame, binsize: int = 1, single_precision: bool = False,
                      filtered: bool = False) -> DataFrame:
    """Megabits and packets of the attack traffic per time bin."""
    return traffic_timeseries(_attack(packets, filtered), binsize, single_precision)


def series_stats(series: DataFrame, medians: dict[str, Column] | None = None) -> DataFrame:
    """One row of overall statistics of a time series (timestamp, mbits_per_bin, pkts_per_bin).

    `medians` gives the two medians where they are known already; else they are taken of all bins
    at once, which suits a series that fits one task.
    """
    columns = ["mbits_per_bin", "pkts_per_bin"]
    medians = medians or {c: F.median(c) for c in columns}
    return series.agg(
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        (F.max("timestamp") - F.min("timestamp")).alias("duration"),
        F.avg("mbits_per_bin").alias("avg_mbits"),
        medians["mbits_per_bin"].alias("median_mbits"),
        F.stddev_pop("mbits_per_bin").alias("std_dev_mbits"),
        F.avg("pkts_per_bin").alias("avg_pkts"),
        medians["pkts_per_bin"].alias("median_pkts"),
        F.stddev_pop("pkts_per_bin").alias("std_dev_pkts"),
    )


def attack_overall_stats(packets: DataFrame, binsize: int = 1,
                         filtered: bool = False) -> DataFrame:
    """Begin, end, duration and rate statistics of the attack traffic.

    The bins are staged once. Their medians come from the bytes and packets per bin, which are
    whole numbers, so that no task holds the values of all bins.
    """
    bins = staged(
        _attack(packets, filtered).groupBy(time_bin("ts", binsize).alias("timestamp")).agg(
            F.sum("ip_total_length").alias("bytes"), F.count("ts").alias("pkts_per_bin")),
        "attack-bins")

    # Both in one pass: bytes and packets are two kinds of values.
    values = bins.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in (
            "bytes", "pkts_per_bin")])))
    medians = exact_median(values, "kind", "value", "median").groupBy().agg(*[
        F.max(F.when(F.col("kind") == c, F.col("median"))).alias(c) for c in (
            "bytes", "pkts_per_bin")])
    found = medians.select(F.struct("bytes", "pkts_per_bin")).scalar()

    series = bins.select("timestamp", megabits(F.col("bytes")).alias("mbits_per_bin"),
                         "pkts_per_bin")
    return series_stats(series, {"mbits_per_bin": megabits(found["bytes"]),
                                 "pkts_per_bin": found["pkts_per_bin"]})


def _ports_and_median(attack: DataFrame, compat: bool) -> DataFrame:
    """Distinct ports and the median length per source.

    Values are counted per (source, kind, value) first, so a hot source is spread; what is left
    per source is bound by the 16-bit range of ports and lengths.
    """
    def port(column: str) -> Column:
        return F.col(column) if compat else F.when(F.col(column) > 0, F.col(column))

    counts = value_counts(attack, ["ip_src"], {
        "udp_sport": port("udp_sport"),
        "tcp_sport": port("tcp_sport"),
        "udp_dport": port("udp_dport"),
        "tcp_dport": port("tcp_dport"),
        "length": F.col("ip_total_length"),
    })
    surplus = 1 if compat else 0
    length = F.when(F.col("kind") == "length", F.col("value"))
    return counts.groupBy(F.col("ip_src").alias("_src")).agg(
        (F.count_if(F.col("kind").isin("udp_sport", "tcp_sport")) - surplus)
        .alias("num_distinct_sport"),
        (F.count_if(F.col("kind").isin("udp_dport", "tcp_dport")) - surplus)
        .alias("num_distinct_dport"),
        F.percentile(length, F.lit(0.5), F.col("n")).alias("pkt_length_median"),
    )


def source_stats(packets: DataFrame, compat: bool = False, filtered: bool = False) -> DataFrame:
    """23 columns per attacking source: packets, fragments, ports, lengths, TTLs, TCP flags.

    Distinct ports are the ports above 0. `compat=True` counts every non-null port and subtracts
    one, as the original analysis did.
    """
    attack = _attack(packets, filtered)
    fragment = (F.col("ip_more_fragments") > 0) & F.col("ts").isNotNull()
    totals = attack.groupBy(F.col("ip_src").alias("src_ip")).agg(
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
        *[F.sum(column).alias(flag) for flag, column in FLAG_COLUMNS.items()],
    )
    values = _ports_and_median(attack, compat)
    none = F.lit(-1 if compat else 0).cast("long")
    return (
        totals.join(values, F.col("src_ip").eqNullSafe(F.col("_src")), "left")
        .select(
            "src_ip",
            "total_packets",
            "packets_fragment_marked",
            (F.col("total_packets") - F.col("packets_fragment_marked"))
            .alias("packets_frag_non_marked"),
            F.coalesce("num_distinct_sport", none).alias("num_distinct_sport"),
            F.coalesce("num_distinct_dport", none).alias("num_distinct_dport"),
            "pkt_length_avg", "pkt_length_min", "pkt_length_max", "pkt_length_median",
            "pkt_length_std_dev",
            "ttl_avg", "ttl_min", "ttl_max", "ttl_std_dev",
            *FLAG_COLUMNS,
        )
    )


def source_timeseries(packets: DataFrame, binsize: int = 1, single_precision: bool = False,
                      filtered: bool = False) -> DataFrame:
    """Megabits and packets per (source, bin), in the order of the bins."""
    return _source_bins(packets, binsize, single_precision, filtered).orderBy("bin", "src_ip")


def _source_bins(packets: DataFrame, binsize: int, single_precision: bool,
                 filtered: bool) -> DataFrame:
    keys = [F.col("ip_src").alias("src_ip"), time_bin("ts", binsize).alias("bin")]
    return _series(_attack(packets, filtered), keys, single_precision)


def source_rate_stats(packets: DataFrame, binsize: int = 1, single_precision: bool = False,
                      filtered: bool = False) -> DataFrame:
    """Mean megabits and packets per bin and source, over the bins with traffic."""
    return (
        _source_bins(packets, binsize, single_precision, filtered).groupBy("src_ip")
        .agg(F.avg("mbits_per_bin").alias("mbits_per_bin_avg"),
             F.avg("pkts_per_bin").alias("pkts_per_bin_avg"))
    )


def source_stats_joined(packets: DataFrame, binsize: int = 1, compat: bool = False,
                        filtered: bool = False) -> DataFrame:
    """`source_stats` with the mean rates of each source, 25 columns.

    The attack traffic is taken out of the packets once and staged, with the columns it needs.
    """
    attack = packets if filtered else staged(
        filter_top_proto(packets).select(*_SOURCE_COLUMNS), "attack-packets")
    return source_stats(attack, compat, filtered=True).join(
        source_rate_stats(attack, binsize, filtered=True), "src_ip", "left")


def join_asn(stats: DataFrame, asn_dim: DataFrame) -> DataFrame:
    """Per-source statistics with the network of each source."""
    return stats.join(
        asn_dim.select(F.col("ip").alias("src_ip"), "asn", "bgp_prefix", "country", "as_info"),
        "src_ip", "left")


def source_stats_asn(packets: DataFrame, asn_dim: DataFrame, binsize: int = 1,
                     compat: bool = False, filtered: bool = False) -> DataFrame:
    """`source_stats_joined` with the network of each source, 29 columns, most packets first."""
    return (
        join_asn(source_stats_joined(packets, binsize, compat, filtered), asn_dim)
        .orderBy(*rank_first("total_packets", "src_ip"))
    )


def count_sources(sources: DataFrame, asn_dim: DataFrame, column: str) -> DataFrame:
    """Sources (column `src_ip`) per value of one network column; no network counts as `NONE`."""
    return (
        join_asn(sources, asn_dim).groupBy(column).agg(F.count("src_ip").alias("sips"))
        .select(F.coalesce(F.col(column), F.lit("NONE")).alias(column), "sips")
        .orderBy(*rank_first("sips", column))
    )


def _attack_source_counts(packets: DataFrame, asn_dim: DataFrame, column: str,
                          filtered: bool) -> DataFrame:
    sources = attack_sources(packets, filtered).withColumnRenamed("ip_src", "src_ip")
    return count_sources(sources, asn_dim, column)


def country_stats(packets: DataFrame, asn_dim: DataFrame, filtered: bool = False) -> DataFrame:
    """Attacking sources per country."""
    return _attack_source_counts(packets, asn_dim, "country", filtered)


def bgp_stats(packets: DataFrame, asn_dim: DataFrame, filtered: bool = False) -> DataFrame:
    """Attacking sources per routed prefix."""
    return _attack_source_counts(packets, asn_dim, "bgp_prefix", filtered)


def asn_stats(packets: DataFrame, asn_dim: DataFrame, filtered: bool = False) -> DataFrame:
    """Attacking sources per autonomous system."""
    return _attack_source_counts(packets, asn_dim, "asn", filtered)


def length_sketches(packets: DataFrame, binsize: int = 1, k: int = 200, filtered: bool = False,
                    keys: tuple[str, ...] = ()) -> DataFrame:
    """A mergeable sketch of the packet lengths of each source and time bin: src_ip, bin, n, sketch,
    and `keys` (such as the capture) if given.

    Sketches are binary KLL sketches of bounded size (a few KB at k = 200). They are built from what
    each task has before the shuffle, can be stored, and add up over bins and captures with
    `sketched_medians`. `source_stats` keeps the exact median.
    """
    return _attack(packets, filtered).groupBy(
        *keys, F.col("ip_src").alias("src_ip"), time_bin("ts", binsize).alias("bin")).agg(
        F.count("ip_total_length").alias("n"),
        F.kll_sketch_agg_bigint(F.col("ip_total_length").cast("long"), k).alias("sketch"))


def sketched_medians(sketches: DataFrame, keys: tuple[str, ...] = ("src_ip",)) -> DataFrame:
    """Packets and approximate median length per `keys`, of sketches from any bins and captures.

    At k = 200 the rank of the result is within 1.7 percent of the middle in 99 of 100 cases.
    """
    merged = sketches.where("n > 0").groupBy(*keys).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return merged.select(*keys, "n", F.kll_sketch_get_quantile_bigint(
        "sketch", F.lit(0.5)).alias("pkt_length_median"))
