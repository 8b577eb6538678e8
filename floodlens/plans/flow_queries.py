"""Queries over flow records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.operators import flows
from floodlens.plans.registry import Query
from floodlens.plans.tables import Tables, sql_bin, with_views

DAY = 86400


def _flags_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("distinct_flags", F.array_join("distinct_flags", ","))


_LIST = "array_to_string(list_sort(list(DISTINCT {c})), ',')"

STATS = f"""
    SELECT ip_src AS src_ip, CAST(sum(pkts) AS DOUBLE) AS total_packets,
           {_LIST.format(c='sport')} AS distinct_sport,
           {_LIST.format(c='dport')} AS distinct_dport,
           count(DISTINCT sport) AS tot_distinct_sport,
           count(DISTINCT dport) AS tot_distinct_dport,
           round(avg(byts), 9) AS pkt_length_avg, min(byts) AS pkt_length_min,
           max(byts) AS pkt_length_max, round(median(byts), 9) AS pkt_length_median,
           round(stddev_pop(byts), 6) AS pkt_length_std_dev,
           {_LIST.format(c='tcp_flg')} AS distinct_flags
    FROM w2 GROUP BY 1"""

SERIES = f"""
    SELECT ip_src AS src_ip, {sql_bin('ts', DAY)} AS bin,
           sum(byts) * 8 / 1000000.0 AS mbits_per_second,
           CAST(sum(pkts) AS DOUBLE) AS pkts_per_second
    FROM w2 GROUP BY 1, 2"""

RATES = f"""
    SELECT src_ip, round(avg(mbits_per_second), 9) AS mbits_per_second_avg,
           round(avg(pkts_per_second), 9) AS pkts_per_second_avg
    FROM ({SERIES}) GROUP BY 1"""

# The prefixes looked up for the flow sources.
_ASN = """(SELECT CASE WHEN bgp_prefix IS NULL THEN 'NA' ELSE asn END AS asn, ip,
        coalesce(bgp_prefix, 'NA') AS bgp_prefix,
        country,
        CASE WHEN bgp_prefix IS NULL THEN 'NA' ELSE as_info END AS as_info
    FROM (SELECT DISTINCT ip_src AS ip FROM flows) LEFT JOIN prefix_dim
        ON split_part(bgp_prefix, '.', 2) = split_part(ip, '.', 2)
        AND split_part(bgp_prefix, '.', 3) = split_part(ip, '.', 3))"""


def _ports(side: str, name: str) -> str:
    return with_views(f"""
        SELECT concat(CAST(port AS VARCHAR), ':', coalesce(port_desc, 'unknown')) AS {name},
               packets
        FROM (SELECT {side} AS port, CAST(sum(pkts) AS DOUBLE) AS packets FROM w2 GROUP BY 1)
        LEFT JOIN port_dim ON port = port_number""", "w2", "port_dim")


def _sources_per(column: str) -> str:
    return with_views(f"""
        SELECT coalesce({column}, 'NONE') AS {column}, count(*) AS sips
        FROM (SELECT DISTINCT ip_src FROM w2) LEFT JOIN {_ASN} ON ip_src = ip
        GROUP BY {column}""", "w2", "prefix_dim")


def _stats(t: Tables) -> DataFrame:
    return _flags_as_text(flows.flow_source_stats(t.flows))


QUERIES = [
    Query("flow_timeseries", lambda t: flows.flow_timeseries(t.flows, DAY),
          with_views(f"""SELECT {sql_bin('ts', DAY)} AS timestamp,
                                round(sum(byts) * 8 / 1000000.0, 9) AS mbits_per_second,
                                CAST(sum(pkts) AS DOUBLE) AS pkts_per_second
                         FROM flows GROUP BY 1""", "flows")),
    Query("flow_packets_per_dst", lambda t: flows.flow_packets_per_dst(t.flows),
          with_views("""SELECT ip_dst, CAST(sum(pkts) AS DOUBLE) AS packets
                        FROM flows GROUP BY 1""", "flows")),
    Query("flow_filter_top_dst", lambda t: flows.flow_filter_top_dst(t.flows),
          with_views("SELECT * FROM w1", "w1")),
    Query("flow_proto_stats", lambda t: flows.flow_proto_stats(t.flows),
          with_views("SELECT ip_proto, count(ts) AS occurrences FROM w1 GROUP BY 1", "w1")),
    Query("flow_filter_top_proto", lambda t: flows.flow_filter_top_proto(t.flows),
          with_views("SELECT * FROM w2", "w2")),
    Query("flow_sources", lambda t: flows.flow_sources(t.flows),
          with_views("SELECT DISTINCT ip_src FROM w2", "w2")),
    Query("flow_src_port_stats", lambda t: flows.flow_src_port_stats(t.flows, t.port_dim),
          _ports("sport", "src_port")),
    Query("flow_dst_port_stats", lambda t: flows.flow_dst_port_stats(t.flows, t.port_dim),
          _ports("dport", "dst_port")),
    Query("flow_source_stats", _stats, with_views(STATS, "w2")),
    Query("flow_source_timeseries", lambda t: flows.flow_source_timeseries(t.flows, DAY),
          with_views(f"""SELECT src_ip, bin, round(mbits_per_second, 9) AS mbits_per_second,
                                pkts_per_second FROM ({SERIES})""", "w2")),
    Query("flow_source_rates", lambda t: flows.flow_source_rates(t.flows, DAY),
          with_views(RATES, "w2")),
    Query("flow_source_stats_asn", lambda t: _flags_as_text(
        flows.flow_source_stats_asn(t.flows, t.flow_asn_dim, DAY)),
          with_views(f"""
              SELECT s.*, mbits_per_second_avg, pkts_per_second_avg,
                     asn, bgp_prefix, country, as_info
              FROM ({STATS}) s LEFT JOIN ({RATES}) r ON s.src_ip = r.src_ip
              LEFT JOIN {_ASN} a ON s.src_ip = a.ip""", "w2", "prefix_dim")),
    Query("flow_country_stats", lambda t: flows.flow_country_stats(t.flows, t.flow_asn_dim),
          _sources_per("country")),
    Query("flow_bgp_stats", lambda t: flows.flow_bgp_stats(t.flows, t.flow_asn_dim),
          _sources_per("bgp_prefix")),
    Query("flow_asn_stats", lambda t: flows.flow_asn_stats(t.flows, t.flow_asn_dim),
          _sources_per("asn")),
]
