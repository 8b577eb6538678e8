"""Queries over packets: drill-down, legacy variants, general queries, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.operators import attack, legacy, ngrams, packets, report
from floodlens.plans.registry import Query
from floodlens.plans.tables import Tables, sql_bin, with_views
from floodlens.session import shared_folder
from floodlens.sources import capture

HOUR = 3600
FLAG_SUMS = ", ".join(f"sum({c}) AS {f}" for f, c in attack.FLAG_COLUMNS.items())


def _series(view: str) -> str:
    return with_views(f"""
        SELECT {sql_bin('ts', HOUR)} AS timestamp,
               round(sum(ip_total_length) * 8 / 1000000.0, 9) AS mbits_per_bin,
               count(ts) AS pkts_per_bin
        FROM {view} GROUP BY 1""", view)


def _ports(side: str, name: str) -> str:
    return with_views(f"""
        SELECT concat(CAST(port AS VARCHAR), ':', coalesce(port_desc, 'unknown')) AS {name},
               udp_packets, tcp_packets, udp_packets + tcp_packets AS packets
        FROM (SELECT coalesce(u.port, t.port) AS port, coalesce(udp_packets, 0) AS udp_packets,
                     coalesce(tcp_packets, 0) AS tcp_packets
              FROM (SELECT udp_{side} AS port, count(ts) AS udp_packets FROM f2
                    WHERE udp_{side} > 0 GROUP BY 1) u
              FULL JOIN (SELECT tcp_{side} AS port, count(ts) AS tcp_packets FROM f2
                         WHERE tcp_{side} > 0 GROUP BY 1) t ON u.port = t.port)
        LEFT JOIN port_dim ON port = port_number""", "f2", "port_dim")


SOURCE_STATS = f"""
    SELECT ip_src AS src_ip, count(ts) AS total_packets,
           count(ts) FILTER (ip_more_fragments > 0) AS packets_fragment_marked,
           count(ts) - count(ts) FILTER (ip_more_fragments > 0) AS packets_frag_non_marked,
           count(DISTINCT udp_sport) FILTER (udp_sport > 0)
             + count(DISTINCT tcp_sport) FILTER (tcp_sport > 0) AS num_distinct_sport,
           count(DISTINCT udp_dport) FILTER (udp_dport > 0)
             + count(DISTINCT tcp_dport) FILTER (tcp_dport > 0) AS num_distinct_dport,
           round(avg(ip_total_length), 9) AS pkt_length_avg,
           min(ip_total_length) AS pkt_length_min, max(ip_total_length) AS pkt_length_max,
           round(median(ip_total_length), 9) AS pkt_length_median,
           round(stddev_pop(ip_total_length), 6) AS pkt_length_std_dev,
           round(avg(ip_ttl), 9) AS ttl_avg, min(ip_ttl) AS ttl_min, max(ip_ttl) AS ttl_max,
           round(stddev_pop(ip_ttl), 6) AS ttl_std_dev,
           {FLAG_SUMS.replace('sum(', 'CAST(sum(').replace(') AS', ') AS BIGINT) AS')}
    FROM f2 GROUP BY ip_src"""

SOURCE_SERIES = f"""
    SELECT ip_src AS src_ip, {sql_bin('ts', HOUR)} AS bin,
           sum(ip_total_length) * 8 / 1000000.0 AS mbits_per_bin, count(ts) AS pkts_per_bin
    FROM f2 GROUP BY 1, 2"""

SOURCE_RATES = f"""
    SELECT src_ip, round(avg(mbits_per_bin), 9) AS mbits_per_bin_avg,
           round(avg(pkts_per_bin), 9) AS pkts_per_bin_avg
    FROM ({SOURCE_SERIES}) GROUP BY src_ip"""

SOURCE_JOINED = f"""
    SELECT s.*, mbits_per_bin_avg, pkts_per_bin_avg
    FROM ({SOURCE_STATS}) s LEFT JOIN ({SOURCE_RATES}) r ON s.src_ip = r.src_ip"""

SOURCE_ASN = f"""
    SELECT j.*, asn, bgp_prefix, country, as_info
    FROM ({SOURCE_JOINED}) j LEFT JOIN asn_dim ON src_ip = ip"""


def _sources_per(column: str) -> str:
    return with_views(f"""
        SELECT coalesce({column}, 'NONE') AS {column}, count(*) AS sips
        FROM (SELECT DISTINCT ip_src FROM f2) LEFT JOIN asn_dim ON ip_src = ip
        GROUP BY {column}""", "f2", "asn_dim")


def _port_text(side: str) -> str:
    """Named ports and the amount of others, as one text."""
    return f"""(SELECT concat(
            coalesce(string_agg(concat(label, '+'), '' ORDER BY n DESC, label)
                     FILTER (n > 0.25 * total), ''),
            CASE WHEN count(*) FILTER (n <= 0.25 * total) > 3 THEN 'MANY'
                 WHEN count(*) FILTER (n <= 0.25 * total) > 0 THEN 'SOME' ELSE '' END)
        FROM (SELECT concat(CAST(port AS VARCHAR), ':', coalesce(port_desc, 'unknown')) AS label,
                     n, sum(n) OVER () AS total
              FROM (SELECT coalesce(nullif(udp_{side}, 0), tcp_{side}) AS port, count(ts) AS n
                    FROM f2 WHERE udp_{side} > 0 OR tcp_{side} > 0 GROUP BY 1)
              LEFT JOIN port_dim ON port = port_number))"""


_FLAGS = "concat(" + ", ".join(
    f"CASE WHEN count(*) FILTER (coalesce({f}, 0) > 0) > 0 THEN concat('{f}(', "
    f"CAST(count(*) FILTER (coalesce({f}, 0) > 0) AS VARCHAR), ')') ELSE '' END"
    for f in attack.FLAG_COLUMNS) + ")"

def _capture_ports(side: str, compat: bool) -> str:
    """Named ports and the amount of others of each capture, as one text."""
    gate = "tcp_sport" if compat else f"tcp_{side}"
    measure, base = ("udp_n", "sport") if compat else ("n", side)
    return f"""
        SELECT capture, concat(
            coalesce(string_agg(concat(label, '+'), '' ORDER BY n DESC, label)
                     FILTER (named), ''),
            CASE WHEN count(*) FILTER (NOT named) > 3 THEN 'MANY'
                 WHEN count(*) FILTER (NOT named) > 0 THEN 'SOME' ELSE '' END) AS {side}_text
        FROM (
            SELECT capture, concat(CAST(port AS VARCHAR), ':', coalesce(port_desc, 'unknown'))
                    AS label, n, coalesce({measure} > 0.25 * total, false) AS named
            FROM (SELECT capture, port, sum(udp) AS udp_n, count(*) AS n
                  FROM (SELECT capture, udp_{side} AS port, 1 AS udp FROM capture_attack
                        WHERE udp_{side} > 0
                        UNION ALL SELECT capture, tcp_{side}, 0 FROM capture_attack
                        WHERE {gate} > 0)
                  GROUP BY ALL)
            LEFT JOIN port_dim ON port = port_number
            LEFT JOIN (SELECT capture, sum(k) AS total
                  FROM (SELECT capture, udp_{base} AS port, 1 AS k FROM capture_attack
                        WHERE udp_{base} > 0
                        UNION ALL SELECT capture, tcp_{base}, 1 FROM capture_attack
                        WHERE tcp_{base} > 0)
                  LEFT JOIN port_dim ON port = port_number GROUP BY capture) USING (capture))
        GROUP BY capture"""


def _captures(compat: bool) -> str:
    """The summary of every capture."""
    views = with_views("", "capture_packets", "port_dim", "ip_proto_dim").strip()
    return f"""{views},
    pairs AS (SELECT capture, ip_dst, ip_proto, count(ts) AS n FROM capture_packets GROUP BY ALL),
    victims AS (
        SELECT capture, ip_dst
        FROM (SELECT capture, ip_dst, sum(n) AS n FROM pairs GROUP BY capture, ip_dst)
        QUALIFY row_number() OVER (
            PARTITION BY capture ORDER BY n DESC, ip_dst NULLS LAST) = 1),
    targets AS (
        SELECT capture, ip_dst, ip_proto FROM pairs JOIN victims USING (capture, ip_dst)
        QUALIFY row_number() OVER (
            PARTITION BY capture ORDER BY n DESC, ip_proto NULLS LAST) = 1),
    capture_attack AS (SELECT p.* FROM capture_packets p JOIN targets
        USING (capture, ip_dst, ip_proto)),
    peaks AS (
        SELECT capture, round(max(m), 9) AS peak_mbps
        FROM (SELECT capture, sum(ip_total_length) * 8 / 1000000.0 AS m
              FROM capture_packets GROUP BY capture, {sql_bin('ts', HOUR)}) GROUP BY capture),
    described AS (
        SELECT capture, min(ip_proto_desc) AS protocol
        FROM targets LEFT JOIN ip_proto_dim ON ip_proto = ip_proto_number GROUP BY capture),
    times AS (
        SELECT capture, min({sql_bin('ts', HOUR)}) AS start,
            max({sql_bin('ts', HOUR)}) - min({sql_bin('ts', HOUR)}) AS duration_s
        FROM capture_attack GROUP BY capture),
    sources AS (
        SELECT capture, count(*) AS src_ips, count(*) FILTER (fragments > 0) AS fragmented,
            {_FLAGS} AS flags
        FROM (SELECT capture, ip_src, count(ts) FILTER (ip_more_fragments > 0) AS fragments,
                  {FLAG_SUMS} FROM capture_attack GROUP BY capture, ip_src) GROUP BY capture),
    sports AS ({_capture_ports('sport', compat)}),
    dports AS ({_capture_ports('dport', compat)})
    SELECT start, concat('TrafficAnalysis_', capture, '/') AS folder,
        split_part(capture, '.', 1) AS file_name, duration_s, peak_mbps,
        coalesce(protocol, '') AS protocol, coalesce(sport_text, '') AS src_ports,
        coalesce(dport_text, '') AS dst_ports, coalesce(src_ips, 0) AS src_ips,
        coalesce(fragmented, 0) + {int(compat)} AS ips_fragmented, coalesce(flags, '') AS flags
    FROM victims LEFT JOIN times USING (capture) LEFT JOIN peaks USING (capture)
    LEFT JOIN described USING (capture) LEFT JOIN sources USING (capture)
    LEFT JOIN sports USING (capture) LEFT JOIN dports USING (capture)"""


SUMMARY = with_views(f"""
    SELECT start, 'TrafficAnalysis_capture-1.txt/' AS folder, 'capture-1' AS file_name,
           duration_s,
           (SELECT round(max(m), 9) FROM (SELECT sum(ip_total_length) * 8 / 1000000.0 AS m
                FROM packets GROUP BY {sql_bin('ts', HOUR)})) AS peak_mbps,
           (SELECT min(ip_proto_desc) FROM ip_proto_dim
            WHERE ip_proto_number = (SELECT min(ip_proto) FROM f2)) AS protocol,
           {_port_text('sport')} AS src_ports, {_port_text('dport')} AS dst_ports,
           src_ips, ips_fragmented, flags
    FROM (SELECT min({sql_bin('ts', HOUR)}) AS start,
                 max({sql_bin('ts', HOUR)}) - min({sql_bin('ts', HOUR)}) AS duration_s FROM f2),
         (SELECT count(*) AS src_ips,
                 count(*) FILTER (packets_fragment_marked > 0) AS ips_fragmented,
                 {_FLAGS} AS flags FROM ({SOURCE_STATS}))
    """, "packets", "f2", "port_dim", "ip_proto_dim")


def _view(name: str) -> Query:
    suffix = "" if name == "packet_length" else f"_{name}"
    columns = ", ".join(report.VIEWS[name])
    return Query(
        f"report_views{suffix}",
        lambda t: report.report_views(
            attack.source_stats_asn(t.packets, t.asn_dim, HOUR), name),
        with_views(f"SELECT {columns} FROM ({SOURCE_ASN})", "f2", "asn_dim"))


DRILL_DOWN = [
    Query("traffic_timeseries", lambda t: attack.traffic_timeseries(t.packets, HOUR),
          _series("packets")),
    Query("packets_per_dst", lambda t: attack.packets_per_dst(t.packets),
          with_views("SELECT ip_dst, count(ts) AS packets FROM packets GROUP BY 1", "packets")),
    Query("filter_top_dst", lambda t: attack.filter_top_dst(t.packets),
          with_views("SELECT * FROM f1", "f1")),
    Query("ip_proto_stats", lambda t: attack.ip_proto_stats(t.packets, t.ip_proto_dim),
          with_views("""
              SELECT CAST(ip_proto AS VARCHAR) || ':' || ip_proto_desc AS ip_proto, occurrences
              FROM (SELECT ip_proto, count(ts) AS occurrences FROM f1 GROUP BY 1)
              LEFT JOIN ip_proto_dim ON ip_proto = ip_proto_number""", "f1", "ip_proto_dim")),
    Query("filter_top_proto", lambda t: attack.filter_top_proto(t.packets),
          with_views("SELECT * FROM f2", "f2")),
    Query("attack_sources", lambda t: attack.attack_sources(t.packets),
          with_views("SELECT DISTINCT ip_src FROM f2", "f2")),
    Query("src_port_stats", lambda t: attack.src_port_stats(t.packets, t.port_dim),
          _ports("sport", "src_port")),
    Query("dst_port_stats", lambda t: attack.dst_port_stats(t.packets, t.port_dim),
          _ports("dport", "dst_port")),
    Query("attack_timeseries", lambda t: attack.attack_timeseries(t.packets, HOUR),
          _series("f2")),
    Query("attack_overall_stats", lambda t: attack.attack_overall_stats(t.packets, HOUR),
          with_views(f"""
              SELECT min(b) AS first_ts, max(b) AS last_ts, max(b) - min(b) AS duration,
                     round(avg(m), 9) AS avg_mbits, round(median(m), 9) AS median_mbits,
                     round(stddev_pop(m), 6) AS std_dev_mbits, round(avg(n), 9) AS avg_pkts,
                     round(median(n), 9) AS median_pkts, round(stddev_pop(n), 6) AS std_dev_pkts
              FROM (SELECT {sql_bin('ts', HOUR)} AS b, sum(ip_total_length) * 8 / 1000000.0 AS m,
                           count(ts) AS n FROM f2 GROUP BY 1)""", "f2")),
    Query("source_stats", lambda t: attack.source_stats(t.packets),
          with_views(SOURCE_STATS, "f2")),
    Query("source_timeseries", lambda t: attack.source_timeseries(t.packets, HOUR),
          with_views(f"""SELECT src_ip, bin, round(mbits_per_bin, 9) AS mbits_per_bin,
                                pkts_per_bin FROM ({SOURCE_SERIES})""", "f2")),
    Query("source_rate_stats", lambda t: attack.source_rate_stats(t.packets, HOUR),
          with_views(SOURCE_RATES, "f2")),
    Query("source_stats_joined", lambda t: attack.source_stats_joined(t.packets, HOUR),
          with_views(SOURCE_JOINED, "f2")),
    Query("source_stats_asn", lambda t: attack.source_stats_asn(t.packets, t.asn_dim, HOUR),
          with_views(SOURCE_ASN, "f2", "asn_dim")),
    Query("country_stats", lambda t: attack.country_stats(t.packets, t.asn_dim),
          _sources_per("country")),
    Query("bgp_stats", lambda t: attack.bgp_stats(t.packets, t.asn_dim),
          _sources_per("bgp_prefix")),
    Query("asn_stats", lambda t: attack.asn_stats(t.packets, t.asn_dim), _sources_per("asn")),
    Query("attack_summary", lambda t: report.attack_summary(
        t.packets, t.ip_proto_dim, t.port_dim, "capture-1.txt", HOUR), SUMMARY),
    *[Query(f"captures_summary{suffix}", lambda t, compat=compat: report.captures_summary(
        t.capture_packets, t.ip_proto_dim, t.port_dim, HOUR, compat), _captures(compat))
      for suffix, compat in (("", False), ("_compat", True))],
    *[_view(name) for name in report.VIEWS],
]


def _legacy_ports(side: str, name: str) -> str:
    return with_views(f"""
        SELECT port AS {name}, coalesce(port_desc, 'unknown') AS port_desc,
               udp_packets, tcp_packets, udp_packets + tcp_packets AS packets
        FROM (SELECT u.port, coalesce(udp_packets, 0) AS udp_packets,
                     coalesce(tcp_packets, 0) AS tcp_packets
              FROM (SELECT udp_{side} AS port, count(ts) AS udp_packets FROM f2
                    WHERE udp_{side} > 0 GROUP BY 1) u
              FULL JOIN (SELECT tcp_{side} AS port, count(ts) AS tcp_packets FROM f2
                         WHERE tcp_{side} > 0 GROUP BY 1) t ON u.port = t.port)
        LEFT JOIN port_dim ON port = port_number""", "f2", "port_dim")


LEGACY = [
    Query("legacy_proto_stats", lambda t: legacy.legacy_proto_stats(t.packets, t.ip_proto_dim),
          with_views("""
              SELECT ip_proto_desc AS ip_proto, occurrences
              FROM (SELECT ip_proto, count(ts) AS occurrences FROM f1 GROUP BY 1)
              LEFT JOIN ip_proto_dim ON ip_proto = ip_proto_number""", "f1", "ip_proto_dim")),
    Query("legacy_port_stats", lambda t: legacy.legacy_port_stats(t.packets, t.port_dim),
          _legacy_ports("sport", "src_port")),
    Query("legacy_port_stats_dst",
          lambda t: legacy.legacy_port_stats(t.packets, t.port_dim, "dport"),
          _legacy_ports("dport", "dst_port")),
    Query("unique_sources", lambda t: legacy.unique_sources(t.packets),
          with_views("SELECT count(DISTINCT ip_src) AS sources FROM f2", "f2")),
    Query("legacy_source_stats", lambda t: legacy.legacy_source_stats(t.legacy_packets),
          with_views("""
              SELECT ip_src AS src_ip, count(ts) AS total_packets,
                     count(ts) FILTER (ip_id % 9 = 0) AS packets_fragment_marked,
                     count(ts) FILTER (ip_id % 9 <> 0) AS packets_non_fragment_marked,
                     count(DISTINCT udp_sport) AS num_distinct_udp_sport,
                     round(avg(ip_total_length), 9) AS pkt_length_avg,
                     round(median(ip_total_length), 9) AS pkt_length_median,
                     min(ip_total_length) AS pkt_length_min,
                     max(ip_total_length) AS pkt_length_max,
                     round(stddev_pop(ip_total_length), 6) AS pkt_length_std_dev,
                     round(avg(ip_ttl), 9) AS ttl_avg, min(ip_ttl) AS ttl_min,
                     max(ip_ttl) AS ttl_max, round(stddev_pop(ip_ttl), 6) AS ttl_std_dev
              FROM f2 GROUP BY 1""", "f2")),
    Query("legacy_source_rates", lambda t: legacy.legacy_source_rates(t.packets, HOUR),
          with_views(SOURCE_RATES, "f2")),
]

GENERAL = [
    Query("packet_total", lambda t: packets.packet_total(t.packets),
          with_views("SELECT count(ts) AS packets FROM packets", "packets")),
    Query("packet_volume", lambda t: packets.packet_volume(t.packets),
          with_views("""SELECT count(ts) AS packets, CAST(sum(ip_total_length) AS BIGINT) AS bytes
                        FROM packets""", "packets")),
    Query("packets_all", lambda t: packets.packets_all(t.packets),
          with_views("SELECT * FROM packets", "packets")),
    Query("packets_with_data", lambda t: packets.packets_with_data(t.packets),
          with_views("SELECT * FROM packets WHERE tcp_len > 0", "packets")),
    Query("bandwidth", lambda t: packets.bandwidth(t.packets),
          with_views(f"""SELECT {sql_bin('ts', 60)} AS bin,
                                CAST(sum(ip_total_length) AS BIGINT) AS bytes
                         FROM packets GROUP BY 1""", "packets")),
    Query("bandwidth_by_protocol", lambda t: packets.bandwidth_by_protocol(t.packets, HOUR),
          with_views(f"""
              SELECT t.bin, tcp_bytes, udp_bytes, total_bytes
              FROM (SELECT {sql_bin('ts', HOUR)} AS bin, CAST(sum(tcp_len) AS BIGINT) AS tcp_bytes
                    FROM packets WHERE ip_proto = 6 GROUP BY 1) t
              JOIN (SELECT {sql_bin('ts', HOUR)} AS bin, CAST(sum(udp_len) AS BIGINT) AS udp_bytes
                    FROM packets WHERE ip_proto = 17 GROUP BY 1) u ON t.bin = u.bin
              JOIN (SELECT {sql_bin('ts', HOUR)} AS bin,
                           CAST(sum(ip_total_length) AS BIGINT) AS total_bytes
                    FROM packets GROUP BY 1) p ON t.bin = p.bin""", "packets")),
    Query("top_dst_ports", lambda t: packets.top_dst_ports(t.packets),
          with_views("""SELECT tcp_dport AS port, count(ts) AS count_packets FROM packets
                        GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 10""", "packets")),
    Query("common_sources", lambda t: packets.common_sources(
        t.packets.filter(F.col("ip_proto") == 6), t.packets.filter(F.col("ip_proto") == 17)),
          with_views("""SELECT DISTINCT ip_src FROM packets WHERE ip_proto = 17 AND ip_src IN
                        (SELECT ip_src FROM packets WHERE ip_proto = 6)""", "packets")),
    Query("packet_size_histogram", lambda t: packets.packet_size_histogram(t.packets),
          with_views("SELECT ip_total_length, count(ts) AS packets FROM packets GROUP BY 1",
                     "packets")),
    Query("port_volume", lambda t: packets.port_volume(t.packets),
          with_views("""SELECT tcp_dport AS port, count(ts) AS packets,
                               CAST(sum(tcp_len) AS BIGINT) AS payload
                        FROM packets WHERE ip_proto = 6 GROUP BY 1""", "packets")),
    Query("source_volume", lambda t: packets.source_volume(t.packets),
          with_views("""SELECT ip_src, count(ts) AS packets,
                               CAST(sum(tcp_len) AS BIGINT) AS payload
                        FROM packets GROUP BY 1""", "packets")),
    Query("port_inout_volume", lambda t: packets.port_inout_volume(t.packets),
          with_views("""
              SELECT i.port, CAST(i.b + o.b AS BIGINT) AS bytes
              FROM (SELECT tcp_dport AS port, sum(ip_total_length) AS b FROM packets
                    WHERE tcp_sport > 0 GROUP BY 1) i
              JOIN (SELECT tcp_sport AS port, sum(ip_total_length) AS b FROM packets
                    WHERE tcp_sport > 0 GROUP BY 1) o ON i.port = o.port""", "packets")),
    Query("port_inout_volume_sessions", lambda t: packets.port_inout_volume(t.sessions),
          with_views("""
              SELECT i.port, CAST(i.b + o.b AS BIGINT) AS bytes
              FROM (SELECT tcp_dport AS port, sum(ip_total_length) AS b FROM sessions GROUP BY 1) i
              JOIN (SELECT tcp_sport AS port, sum(ip_total_length) AS b FROM sessions GROUP BY 1) o
              ON i.port = o.port""", "sessions")),
    Query("source_fanout", lambda t: packets.source_fanout(t.packets),
          with_views("""SELECT ip_src, count(DISTINCT ip_dst) AS destinations FROM packets
                        WHERE ip_proto = 6 GROUP BY 1""", "packets")),
    Query("source_ports", lambda t: packets.source_ports(t.packets).withColumn(
        "dst_ports", F.array_join("dst_ports", ",")),
          with_views("""
              SELECT ip_src, string_agg(CAST(tcp_dport AS VARCHAR), ',' ORDER BY tcp_dport)
                         AS dst_ports, count(*) AS num_dst_ports
              FROM (SELECT DISTINCT ip_src, tcp_dport FROM packets WHERE ip_proto = 6)
              GROUP BY 1""", "packets")),
    Query("src_dst_volume", lambda t: packets.src_dst_volume(t.packets),
          with_views("""SELECT ip_src, ip_dst, count(ts) AS packets,
                               CAST(sum(tcp_len) AS BIGINT) AS payload
                        FROM packets WHERE ip_proto = 6 GROUP BY 1, 2""", "packets")),
]

_DNS_FILTER = "(udp_sport = 53 OR udp_dport = 53)"
_SERVICE_ROWS = " UNION ALL ".join(
    f"SELECT '{name}' AS service, byte FROM payload_bytes WHERE pos < size"
    + (f" AND (coalesce({p}_sport, 0) = {port} OR coalesce({p}_dport, 0) = {port})" if p else "")
    for name, (p, _, port) in ((n, f.partition(":")) for n, f in ngrams.SERVICES.items()))

_TWO_BYTES = f"""
    SELECT a * 256 + b AS g, count(*) AS c
    FROM (SELECT byte AS a, lead(byte) OVER (PARTITION BY doc_id ORDER BY pos) AS b, pos, size
          FROM payload_bytes WHERE {_DNS_FILTER})
    WHERE pos + 1 < size GROUP BY 1"""
_THREE_BYTES = """
    SELECT a, b, c
    FROM (SELECT byte AS a, lead(byte, 1) OVER w AS b, lead(byte, 2) OVER w AS c, pos, size
          FROM payload_bytes WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    WHERE pos + 2 < size"""

_TWO_BYTES_OF_PACKETS = (_TWO_BYTES.replace("payload_bytes", "piece_bytes")
                         .replace("PARTITION BY doc_id", "PARTITION BY doc_id, piece"))


def _service_sql(rows: str) -> str:
    return f"""
        SELECT service, ngram, coalesce(c, 0) AS count
        FROM (SELECT unnest({list(ngrams.SERVICES)}) AS service),
             (SELECT unnest(range(256)) AS ngram)
        LEFT JOIN (SELECT service AS s, byte AS g, count(*) AS c FROM ({rows})
                   GROUP BY 1, 2) ON service = s AND ngram = g"""


def _captured_payloads(t: Tables) -> DataFrame:
    """The payloads, written as capture files by the executors and read back from them."""
    capture.register_capture(t.spark)
    folder = shared_folder(t.spark, "payload-captures")
    t.payload_packets.write.format("capture").mode("append").save(folder)
    return capture.packet_scan_pcap(t.spark, folder, columns=[
        "tcp_sport", "tcp_dport", "udp_sport", "udp_dport", "payload"])


PAYLOADS = [
    Query("payload_ngrams_capture",
          lambda t: ngrams.payload_ngrams(_captured_payloads(t), "payload", "udp:53", 2),
          with_views(f"""SELECT 'udp:53' AS filter, g AS ngram, c AS count
                         FROM ({_TWO_BYTES_OF_PACKETS})""", "piece_bytes")),
    Query("ngrams_by_service_capture",
          lambda t: ngrams.ngrams_by_service(_captured_payloads(t), "payload"),
          with_views(_service_sql(_SERVICE_ROWS.replace("payload_bytes", "piece_bytes")),
                     "piece_bytes")),
    Query("payload_ngrams",
          lambda t: ngrams.payload_ngrams(t.payloads, "text", "udp:53", 2, zeros=True),
          with_views(f"""
              SELECT 'udp:53' AS filter, ngram, coalesce(c, 0) AS count
              FROM (SELECT unnest(range(65536)) AS ngram) LEFT JOIN ({_TWO_BYTES}) ON ngram = g""",
                     "payload_bytes")),
    Query("payload_ngrams_found",
          lambda t: ngrams.payload_ngrams(t.payloads, "text", "udp:53", 2),
          with_views(f"SELECT 'udp:53' AS filter, g AS ngram, c AS count FROM ({_TWO_BYTES})",
                     "payload_bytes")),
    Query("payload_trigrams", lambda t: ngrams.payload_ngrams(t.payloads, "text", "", 3),
          with_views(f"""
              SELECT '' AS filter, a * 65536 + b * 256 + c AS ngram, count(*) AS count
              FROM ({_THREE_BYTES}) GROUP BY 2""", "payload_bytes")),
    Query("top_trigrams", lambda t: ngrams.top_ngrams(t.payloads, "text", 50, n=3),
          with_views(f"""
              SELECT a * 65536 + b * 256 + c AS ngram, count(*) AS count
              FROM ({_THREE_BYTES}) GROUP BY 1 ORDER BY count DESC, ngram LIMIT 50""",
                     "payload_bytes")),
    Query("ngrams_by_service", lambda t: ngrams.ngrams_by_service(t.payloads, "text"),
          with_views(_service_sql(_SERVICE_ROWS), "payload_bytes")),
    Query("ngram_cube",
          lambda t: ngrams.ngram_cube(ngrams.payload_ngrams(t.payloads, "text", "", 3)),
          with_views(f"""
              SELECT x, y, z, coalesce(n, 0) AS count
              FROM (SELECT CAST(i % 32 AS INTEGER) AS x, CAST(i // 32 % 32 AS INTEGER) AS y,
                           CAST(i // 1024 AS INTEGER) AS z
                    FROM (SELECT unnest(range(32768)) AS i))
              LEFT JOIN (SELECT c // 8 AS x, b // 8 AS y, a // 8 AS z, count(*) AS n
                         FROM ({_THREE_BYTES}) GROUP BY 1, 2, 3) USING (x, y, z)""",
                     "payload_bytes")),
    Query("word_count", lambda t: ngrams.word_count(t.table("documents"), "text"),
          """SELECT word, count(*) AS n
             FROM (SELECT lower(unnest(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9]*'))) AS word
                   FROM documents) GROUP BY 1"""),
]

QUERIES = [*DRILL_DOWN, *LEGACY, *GENERAL, *PAYLOADS]


def flagship(tables: Tables):
    """Which sources attacked the top victim, and how."""
    return attack.source_stats(tables.packets)
