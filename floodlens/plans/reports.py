"""The full reports: every result of a drill-down over one capture, written as CSV folders."""

from __future__ import annotations

from pyspark.sql import DataFrame

from floodlens.operators import attack, flows, geo, report
from floodlens.session import staged
from floodlens.sources.sinks import csv_report_sink


def _write(folder: str, bounded: dict[str, DataFrame], others: dict[str, DataFrame]) -> None:
    """Results of bounded size as one file each, the others as Spark partitions them."""
    for name, result in bounded.items():
        csv_report_sink(result, f"{folder}/{name}", single_file=True)
    for name, result in others.items():
        csv_report_sink(result, f"{folder}/{name}")


def packet_report(packets: DataFrame, ip_proto_dim: DataFrame, port_dim: DataFrame,
                  prefix_dim: DataFrame, folder: str, capture_name: str,
                  binsize: int = 1) -> list[str]:
    """All results of the packet drill-down; returns the names of the written folders.

    The attack traffic and the network of its sources feed most results and are staged once as
    Parquet in the shared folder.
    """
    traffic = staged(attack.filter_top_proto(packets), "attack-packets")
    asn_dim = staged(geo.asn_enrich(attack.attack_sources(traffic, filtered=True), prefix_dim),
                     "attack-networks")
    stats = staged(attack.source_stats_asn(traffic, asn_dim, binsize, filtered=True),
                   "attack-source-stats")
    bounded = {
        "ip_proto": attack.ip_proto_stats(packets, ip_proto_dim),
        "src_ports": attack.src_port_stats(traffic, port_dim, filtered=True),
        "dst_ports": attack.dst_port_stats(traffic, port_dim, filtered=True),
        "attack_stats": attack.attack_overall_stats(traffic, binsize, filtered=True),
        "country_stats": attack.country_stats(traffic, asn_dim, filtered=True),
        "summary": report.attack_summary(packets, ip_proto_dim, port_dim, capture_name, binsize,
                                         attack_packets=traffic),
    }
    others = {
        "series": attack.traffic_timeseries(packets, binsize).orderBy("timestamp"),
        "packets_per_dst": attack.packets_per_dst(packets),
        "sources": attack.attack_sources(traffic, filtered=True),
        "attack_series": attack.attack_timeseries(traffic, binsize, filtered=True)
        .orderBy("timestamp"),
        "source_series": attack.source_timeseries(traffic, binsize, filtered=True),
        "source_stats": stats,
        "bgp_stats": attack.bgp_stats(traffic, asn_dim, filtered=True),
        "asn_stats": attack.asn_stats(traffic, asn_dim, filtered=True),
        **{f"view_{view}": report.report_views(stats, view) for view in report.VIEWS},
    }
    _write(folder, bounded, others)
    return [*bounded, *others]


def flow_report(flow_records: DataFrame, port_dim: DataFrame, prefix_dim: DataFrame, folder: str,
                binsize: int = 1) -> list[str]:
    """All results of the flow drill-down; returns the names of the written folders."""
    traffic = staged(flows.flow_filter_top_proto(flow_records), "attack-flows")
    asn_dim = staged(geo.asn_enrich(flows.flow_sources(traffic, filtered=True), prefix_dim),
                     "attack-networks")
    stats = flows.flow_source_stats_asn(traffic, asn_dim, binsize, filtered=True)
    # CSV has no arrays: the flag set becomes one text.
    stats = stats.selectExpr(
        *[f"array_join({c}, ' ') as {c}" if c == "distinct_flags" else c for c in stats.columns])
    bounded = {
        "ip_proto": flows.flow_proto_stats(flow_records),
        "src_ports": flows.flow_src_port_stats(traffic, port_dim, filtered=True),
        "dst_ports": flows.flow_dst_port_stats(traffic, port_dim, filtered=True),
        "country_stats": flows.flow_country_stats(traffic, asn_dim, filtered=True),
    }
    others = {
        "series": flows.flow_timeseries(flow_records, binsize).orderBy("timestamp"),
        "packets_per_dst": flows.flow_packets_per_dst(flow_records),
        "sources": flows.flow_sources(traffic, filtered=True),
        "source_series": flows.flow_source_timeseries(traffic, binsize, filtered=True),
        "source_stats": stats,
        "bgp_stats": flows.flow_bgp_stats(traffic, asn_dim, filtered=True),
        "asn_stats": flows.flow_asn_stats(traffic, asn_dim, filtered=True),
    }
    _write(folder, bounded, others)
    return [*bounded, *others]
