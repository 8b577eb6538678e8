"""One-row summaries per capture and the column subsets behind the report pages."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodlens.functions.rates import megabits, time_bin
from floodlens.operators import attack
from floodlens.session import staged

# Columns of each view on the per-source statistics.
VIEWS = {
    "overall": ["src_ip", "total_packets"],
    "fragments": ["src_ip", "packets_frag_non_marked", "packets_fragment_marked"],
    "packet_length": ["src_ip", "pkt_length_avg", "pkt_length_min", "pkt_length_max"],
    "ttl": ["src_ip", "ttl_avg", "ttl_min", "ttl_max"],
    "flags": ["src_ip", *attack.FLAG_COLUMNS],
}
# A port is named above this share; more unnamed ports than this are `MANY`.
NAMED_SHARE = 0.25
FEW_PORTS = 3


#: Columns of the attack traffic that a summary is made of.
_NEEDED = ["ts", "ip_src", "ip_total_length", "ip_more_fragments", "udp_sport", "udp_dport",
           "tcp_sport", "tcp_dport", *attack.FLAG_COLUMNS.values()]


def attack_targets(packets: DataFrame, capture: str = "capture") -> DataFrame:
    """Per capture: the victim (`ip_dst`) and its top protocol (`ip_proto`).

    Most packets first, ties to the smaller address and protocol. The packets are counted once per
    (capture, destination, protocol); both choices are minima over these counts, so no task sees
    the destinations of a whole capture.
    """
    pairs = packets.where(F.col(capture).isNotNull()).groupBy(
        capture, "ip_dst", "ip_proto").agg(F.count("ts").alias("n"))
    best_proto = F.struct(-F.col("n"), F.col("ip_proto").isNull(), "ip_proto")
    best_dst = F.struct(-F.col("packets"), F.col("ip_dst").isNull(), "ip_dst")
    per_dst = pairs.groupBy(capture, "ip_dst").agg(
        F.sum("n").alias("packets"), F.min_by("ip_proto", best_proto).alias("ip_proto"))
    return per_dst.groupBy(capture).agg(
        F.min_by(F.struct("ip_dst", "ip_proto"), best_dst).alias("target")).select(
        capture, "target.ip_dst", "target.ip_proto")


def captures_attack(packets: DataFrame, targets: DataFrame, capture: str = "capture"
                    ) -> DataFrame:
    """The attack traffic of every capture: packets to its victim over the victim's top protocol.

    `targets` has one row per capture. Read back from a table its size is known, and Spark sends it
    to the tasks that read the packets as long as it is small.
    """
    wanted = targets.where("ip_dst is not null and ip_proto is not null")
    return packets.join(wanted, [capture, "ip_dst", "ip_proto"])


def _port_texts(traffic: DataFrame, port_dim: DataFrame, capture: str, compat: bool) -> DataFrame:
    """Per capture: src_ports and dst_ports as `a+b+MANY`: the ports above the share, most packets
    first, then the amount of others.

    Both sides are counted in one pass. At most three ports can exceed a quarter of the packets, so
    the lists are bounded; windows see the ports of one capture, at most 65,536 a side.
    """
    gate = "tcp_sport" if compat else "tcp_dport"
    entries = F.array(*[
        F.struct(F.lit(side).alias("side"), F.lit(kind).alias("kind"),
                 F.col(f"{kind}_{side}").alias("port"), (F.col(condition) > 0).alias("keep"))
        for side, kind, condition in (
            ("sport", "udp", "udp_sport"), ("sport", "tcp", "tcp_sport"),
            ("dport", "udp", "udp_dport"), ("dport", "tcp", gate))])
    counted = F.col("ts").isNotNull()
    ports = (
        traffic.select(capture, "ts", F.inline(entries)).where("keep")
        .groupBy(capture, "side", "port")
        .agg(F.count_if((F.col("kind") == "udp") & counted).alias("udp_packets"),
             F.count_if(counted).alias("packets"))
        .join(port_dim, F.col("port") == F.col("port_number"), "left")
        .withColumn("label", F.concat(F.col("port").cast("string"), F.lit(":"),
                                      F.coalesce(F.col("port_desc"), F.lit("unknown"))))
    )
    if compat:
        whole = Window.partitionBy(capture)
        total = F.sum(F.when(F.col("side") == "sport", F.col("packets"))).over(whole)
    else:
        total = F.sum("packets").over(Window.partitionBy(capture, "side"))
    measure = "udp_packets" if compat else "packets"
    ports = ports.withColumn("named", F.coalesce(
        F.col(measure) / F.nullif(total, F.lit(0)) > NAMED_SHARE, F.lit(False)))

    def text(side: str) -> Column:
        here = F.col("side") == side
        names = F.sort_array(F.collect_list(F.when(here & F.col("named"), F.struct(
            (-F.col("packets")).alias("rank"), "label"))))
        others = F.count_if(here & ~F.col("named"))
        return F.concat(
            F.array_join(F.transform(names, lambda p: F.concat(p["label"], F.lit("+"))), ""),
            F.when(others > FEW_PORTS, "MANY").when(others > 0, "SOME").otherwise(""))

    return ports.groupBy(capture).agg(text("sport").alias("src_ports"),
                                      text("dport").alias("dst_ports"))


def _parts(packets: DataFrame, targets: DataFrame, traffic: DataFrame, ip_proto_dim: DataFrame,
           port_dim: DataFrame, binsize: int, compat: bool, capture: str) -> list[DataFrame]:
    """Statistics by capture: times, sources and flags; peaks; protocols; ports."""
    peak = packets.groupBy(capture, time_bin("ts", binsize).alias("bin")).agg(
        megabits(F.sum("ip_total_length")).alias("mbits")).groupBy(capture).agg(
        F.max("mbits").alias("peak_mbps"))
    described = targets.join(
        ip_proto_dim, F.col("ip_proto") == F.col("ip_proto_number"), "left").groupBy(capture).agg(
        F.min("ip_proto_desc").alias("protocol"))
    ports = _port_texts(traffic, port_dim, capture, compat)

    fragment = (F.col("ip_more_fragments") > 0) & F.col("ts").isNotNull()
    bins = time_bin("ts", binsize)
    per_source = traffic.groupBy(capture, "ip_src").agg(
        F.count_if(fragment).alias("fragments"), F.min(bins).alias("first"),
        F.max(bins).alias("last"),
        *[F.sum(c).alias(f"sum_{flag}") for flag, c in attack.FLAG_COLUMNS.items()])
    flags = [
        F.when(F.count_if(F.col(f"sum_{flag}") > 0) > 0, F.concat(
            F.lit(f"{flag}("), F.count_if(F.col(f"sum_{flag}") > 0).cast("string"), F.lit(")")))
        for flag in attack.FLAG_COLUMNS
    ]
    sources = per_source.groupBy(capture).agg(
        F.min("first").alias("start"), (F.max("last") - F.min("first")).alias("duration_s"),
        F.count("*").alias("src_ips"), F.count_if(F.col("fragments") > 0).alias("_fragmented"),
        F.concat_ws("", *flags).alias("flags"))
    return [sources, peak, described, ports]


def _summaries(joined: DataFrame, compat: bool, capture: str) -> DataFrame:
    """The columns of a summary from captures with all their parts, null where there are none."""

    def text(name: str) -> Column:
        return F.coalesce(name, F.lit("")).alias(name)

    none = F.lit(0).cast("long")
    return joined.select(
        "start",
        F.concat(F.lit("TrafficAnalysis_"), capture, F.lit("/")).alias("folder"),
        F.split_part(F.col(capture), F.lit("."), F.lit(1)).alias("file_name"),
        "duration_s", "peak_mbps", text("protocol"), text("src_ports"), text("dst_ports"),
        F.coalesce("src_ips", none).alias("src_ips"),
        (F.coalesce("_fragmented", none) + (1 if compat else 0)).alias("ips_fragmented"),
        text("flags"))


def captures_summary(packets: DataFrame, ip_proto_dim: DataFrame, port_dim: DataFrame,
                     binsize: int = 1, compat: bool = False,
                     capture: str = "capture") -> DataFrame:
    """`attack_summary` of all captures of `packets` (one more column, `capture`) at once.

    One plan whatever the number of captures: the packets are read to find the targets, to take the
    attack traffic out (staged once, with the columns a summary needs) and for the peaks. Packets
    without a capture take no part; a capture without attack traffic has a row with empty texts.
    Earliest attack first.
    """
    targets = staged(attack_targets(packets, capture), "capture-targets")
    traffic = staged(captures_attack(packets, targets, capture).select(capture, *_NEEDED),
                     "captures-attack")
    joined = targets.select(capture)
    for part in _parts(packets, targets, traffic, ip_proto_dim, port_dim, binsize, compat, capture):
        joined = joined.join(part, capture, "left")
    return _summaries(joined, compat, capture).orderBy("start", "folder")


def attack_summary(packets: DataFrame, ip_proto_dim: DataFrame, port_dim: DataFrame,
                   capture_name: str, binsize: int = 1, compat: bool = False,
                   attack_packets: DataFrame | None = None) -> DataFrame:
    """One row per capture: when, how long, peak, protocol, ports, sources, fragments, flags.

    Port shares are packets over the side's own total. `compat=True` reproduces the original
    summary: UDP packets over the source-side total for both sides, and one fragmenting source
    too many. `attack_packets` is a staged copy of the attack traffic, if there is one.
    """
    name = F.lit(capture_name).alias("_capture")
    named = packets.select("*", name)
    targets = staged(attack_targets(named, "_capture"), "capture-target")
    if attack_packets is None:  # two equalities with one value each, which the scan can use
        attack_packets = staged(packets.where(
            (F.col("ip_dst") == targets.select("ip_dst").scalar())
            & (F.col("ip_proto") == targets.select("ip_proto").scalar())).select(*_NEEDED),
            "capture-attack")
    traffic = attack_packets.select(*_NEEDED, name)
    # Every part is one row or none: scalar subqueries instead of joins.
    parts = [part.select(F.struct(*[c for c in part.columns if c != "_capture"])).scalar().alias(
        f"_part_{i}") for i, part in enumerate(_parts(
            named, targets, traffic, ip_proto_dim, port_dim, binsize, compat, "_capture"))]
    row = packets.sparkSession.range(1).select(name, *parts).select(
        "_capture", *[f"_part_{i}.*" for i in range(len(parts))])
    return _summaries(row, compat, "_capture")


def attack_summaries(summaries: Iterable[DataFrame]) -> DataFrame:
    """Summary rows of several captures, earliest attack first."""
    return reduce(DataFrame.unionByName, summaries).orderBy("start", "folder")


def report_views(stats: DataFrame, view: str) -> DataFrame:
    """One view on the per-source statistics: a key of `VIEWS`."""
    return stats.select(*VIEWS[view])


def with_datetime(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """`df` with an epoch-seconds column as a timestamp, for plotting."""
    return df.withColumn(column, F.timestamp_seconds(column))
