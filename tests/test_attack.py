"""Null, tie and quirk rules of the packet and flow drill-downs, and the golden roll-ups."""

import math
from functools import reduce

import pytest
from pyspark.sql import functions as F
from support import packets, rows, tcp, udp

from floodlens import schemas
from floodlens.operators import attack, flows, legacy, report
from floodlens.operators import packets as general
from floodlens.session import staged

# Attack series of the golden capture: (second, megabits, packets).
GOLDEN_SERIES = [
    (1428745323, 4.251552, 371), (1428745324, 3.44032, 308), (1428745325, 1.860512, 167),
    (1428745326, 10.105504, 899), (1428745327, 4.425568, 393), (1428745328, 5.839808, 518),
    (1428745329, 5.4296, 485), (1428745330, 3.8072, 343), (1428745331, 6.310048, 559),
    (1428745332, 6.159776, 547), (1428745333, 2.32832, 204), (1428745334, 9.033792, 806),
    (1428745335, 5.977632, 529), (1428745336, 2.18, 193), (1428745337, 3.416896, 308),
    (1428745338, 10.933728, 969), (1428745339, 6.400352, 569), (1428745340, 5.898816, 524),
    (1428745341, 5.821696, 522), (1428745342, 5.655808, 508), (1428745343, 3.054592, 270),
]


def test_golden_overall_stats(spark):
    series = spark.createDataFrame(
        GOLDEN_SERIES, "timestamp long, mbits_per_bin double, pkts_per_bin long")
    (got,) = attack.series_stats(series).collect()
    assert (got.first_ts, got.last_ts, got.duration) == (1428745323, 1428745343, 20)
    assert math.isclose(got.avg_mbits, 5.349120003836496, rel_tol=1e-7)
    assert math.isclose(got.median_mbits, 5.655807971954346, rel_tol=1e-7)
    assert math.isclose(got.std_dev_mbits, 2.3879781413792323, rel_tol=1e-7)
    assert math.isclose(got.avg_pkts, 475.8095238095238, rel_tol=1e-12)
    assert got.median_pkts == 508.0
    assert math.isclose(got.std_dev_pkts, 212.19883286955618, rel_tol=1e-12)


def test_golden_series_packets_are_the_attack_packets():
    assert sum(n for _, _, n in GOLDEN_SERIES) == 9992


def test_golden_rate_in_single_precision(spark):
    frame = packets(spark, [udp(5, "a", length=531444)])
    (got,) = attack.traffic_timeseries(frame, 1, single_precision=True).collect()
    assert dict(attack.traffic_timeseries(frame, 1, True).dtypes)["mbits_per_bin"] == "float"
    assert math.isclose(got.mbits_per_bin, 4.251552, rel_tol=1e-7)


def test_golden_network_counts(spark):
    """An unrouted, unallocated source is `NA` with no country; a missing one is `NONE`."""
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "src_ip string")
    asn = spark.createDataFrame(
        [("NA", "a", "NA", None, "NA"), ("7482", "b", "218.184.192.0/18", "TW", "X")],
        schemas.ASN_DIM)
    assert rows(attack.count_sources(sources, asn, "country")) == [("NONE", 2), ("TW", 1)]
    assert rows(attack.count_sources(sources, asn, "asn")) == [
        ("7482", 1), ("NA", 1), ("NONE", 1)]


def test_ties_go_to_the_smaller_key(spark):
    frame = packets(spark, [udp(1, "a", dst="y"), udp(2, "b", dst="x"), tcp(3, "c", dst="x"),
                            tcp(4, "c", dst="y")])
    assert rows(attack.filter_top_dst(frame), "ip_dst") == [("x",), ("x",)]
    assert rows(attack.filter_top_proto(frame), "ip_src") == [("c",)]


def test_empty_input(spark):
    empty = packets(spark, [])
    assert attack.filter_top_proto(empty).count() == 0
    assert attack.source_stats(empty).count() == 0
    (stats,) = attack.attack_overall_stats(empty).collect()
    assert stats.first_ts is None


def test_packets_without_time_do_not_count(spark):
    frame = packets(spark, [udp(1, "a", dst="x"), udp(None, "a", dst="y"),
                            udp(None, "b", dst="y")])
    assert rows(attack.packets_per_dst(frame)) == [("x", 1), ("y", 0)]


def test_bins_truncate(spark):
    frame = packets(spark, [udp(59, "a"), udp(60, "a"), udp(119, "a")])
    assert rows(general.bandwidth(frame, 60)) == [(0, 100), (60, 200)]


def test_source_stats_with_filler_zeros_and_nulls(spark):
    """Port 0 is a filler; compat keeps it and takes one off."""
    filler = {"tcp_sport": 0, "tcp_dport": 0}
    frame = packets(spark, [
        udp(1, "a", sport=10, dport=53, length=100, **filler),
        udp(2, "a", sport=11, dport=53, length=300, ip_more_fragments=1, **filler),
        udp(3, "a", sport=11, dport=53, length=200, **filler),
        udp(4, "b", sport=7, dport=9, length=50, ip_ttl=64),
    ])
    columns = ["src_ip", "total_packets", "packets_fragment_marked", "num_distinct_sport",
               "num_distinct_dport", "pkt_length_median"]
    assert rows(attack.source_stats(frame), *columns) == [
        ("a", 3, 1, 2, 1, 200.0), ("b", 1, 0, 1, 1, 50.0)]
    # With nulls for the absent protocol the original count is one too low.
    assert rows(attack.source_stats(frame, compat=True), *columns) == [
        ("a", 3, 1, 2, 1, 200.0), ("b", 1, 0, 0, 0, 50.0)]


def test_source_without_address_is_one_group(spark):
    frame = packets(spark, [udp(1, None), udp(2, None), udp(3, "a")])
    got = rows(attack.source_stats(frame), "src_ip", "total_packets", "num_distinct_sport")
    assert got == [("a", 1, 1), (None, 2, 1)]
    # Nulls never match in the join with the rates.
    joined = rows(attack.source_stats_joined(frame), "src_ip", "pkts_per_bin_avg")
    assert joined == [("a", 1.0), (None, None)]


PORTS = [(53, "DNS"), (80, "HTTP")]


def test_port_stats_join_udp_and_tcp(spark):
    dim = spark.createDataFrame(PORTS, schemas.PORT_DIM)
    frame = packets(spark, [udp(1, "a", sport=53), tcp(2, "a", sport=53), tcp(3, "a", sport=99),
                            tcp(4, "a", sport=0), udp(5, "a", sport=0)])
    assert rows(attack.src_port_stats(frame, dim, filtered=True)) == [
        ("53:DNS", 1, 1, 2), ("99:unknown", 0, 1, 1)]
    assert rows(legacy.legacy_port_stats(frame, dim, filtered=True)) == [
        (53, "DNS", 1, 1, 2), (None, "unknown", 0, 1, 1)]


def test_compat_destination_ports_follow_the_source_port(spark):
    dim = spark.createDataFrame(PORTS, schemas.PORT_DIM)
    frame = packets(spark, [tcp(1, "a", sport=5, dport=80), tcp(2, "a", sport=0, dport=80),
                            tcp(3, "a", sport=5, dport=0), tcp(4, "a", sport=5, dport=None)])
    assert rows(attack.dst_port_stats(frame, dim, filtered=True)) == [("80:HTTP", 0, 2, 2)]
    assert rows(attack.dst_port_stats(frame, dim, compat=True, filtered=True)) == [
        ("0:unknown", 0, 1, 1), ("80:HTTP", 0, 1, 1), (None, 0, 1, 1)]


def test_protocol_labels(spark):
    dim = spark.createDataFrame([(6, "TCP"), (6, "TCP2")], schemas.PROTOCOL_DIM)
    frame = packets(spark, [udp(1, "a"), udp(2, "a"), tcp(3, "a")])
    assert rows(attack.ip_proto_stats(frame, dim)) == [
        ("6:TCP", 1), ("6:TCP2", 1), (None, 2)]


def test_series_and_source_series_sum_to_the_attack(spark):
    frame = packets(spark, [udp(i, f"s{i % 7}", length=i) for i in range(1, 200)])
    total = attack.filter_top_proto(frame).count()
    for series in (attack.attack_timeseries(frame, 10), attack.source_timeseries(frame, 10)):
        assert series.agg(F.sum("pkts_per_bin")).first()[0] == total


def _summary(spark, frame, **more):
    return report.attack_summary(
        frame, spark.createDataFrame([(17, "UDP"), (6, "TCP")], schemas.PROTOCOL_DIM),
        spark.createDataFrame(PORTS, schemas.PORT_DIM), "cap-1.txt", **more).collect()[0]


def test_summary_row(spark):
    frame = packets(spark, [
        *[udp(100 + i, f"s{i % 4}", length=1000, sport=53, dport=i + 1,
              ip_more_fragments=int(i == 0)) for i in range(8)],
        tcp(90, "x", length=2000), tcp(90, "x", length=2000)])
    got = _summary(spark, frame)
    assert got.asDict() == {
        "start": 100, "folder": "TrafficAnalysis_cap-1.txt/", "file_name": "cap-1",
        "duration_s": 7, "peak_mbps": 0.032, "protocol": "UDP", "src_ports": "53:DNS+",
        "dst_ports": "MANY", "src_ips": 4, "ips_fragmented": 1, "flags": ""}
    assert _summary(spark, frame, compat=True).ips_fragmented == 2


def test_summary_flags_and_few_ports(spark):
    frame = packets(spark, [
        tcp(1, "a", sport=1, dport=80, tcp_syn=1, tcp_ack=0),
        tcp(2, "b", sport=1, dport=80, tcp_syn=1, tcp_ack=1),
        tcp(3, "c", sport=1, dport=80, tcp_syn=0, tcp_ack=0),
        tcp(4, "c", sport=2, dport=80), tcp(5, "c", sport=1, dport=80)])
    got = _summary(spark, frame)
    assert (got.src_ports, got.dst_ports, got.flags) == (
        "1:unknown+SOME", "80:HTTP+", "ACK(1)SYN(2)")
    # No UDP: the original shares are all zero.
    assert _summary(spark, frame, compat=True).dst_ports == "SOME"


def test_summaries_are_ordered_by_start(spark):
    dims = (spark.createDataFrame([], schemas.PROTOCOL_DIM),
            spark.createDataFrame([], schemas.PORT_DIM))
    late = report.attack_summary(packets(spark, [udp(50, "a")]), *dims, "late.txt")
    early = report.attack_summary(packets(spark, [udp(5, "a")]), *dims, "early.txt")
    got = report.attack_summaries([late, early]).collect()
    assert [r.file_name for r in got] == ["early", "late"]
    assert got[0].protocol == ""


def _captures(spark):
    """Five captures: two alike, one of UDP alone, one whose victims and protocols tie, one without
    a protocol, and packets of none."""
    many = [udp(10 + i, f"s{i % 3}", length=500, dport=i + 1, ip_more_fragments=i % 2)
            for i in range(9)]
    rows = {
        "b.first.pcap": [*many, tcp(5, "x", "w", length=900), tcp(300, "s1", sport=1)],
        "a.pcap": many,
        "tie.pcap": [tcp(7, "a", "v2"), udp(7, "a", "v2"), udp(8, "b", "v1"), tcp(9, "b", "v1")],
        "none.pcap": [{"ts": 1, "ip_src": "q", "ip_dst": "z", "ip_total_length": 10}],
        "syn.pcap": [tcp(1000 + i, f"c{i}", sport=i + 1, tcp_syn=1) for i in range(6)],
        None: [udp(1, "n")],
    }
    frames = [packets(spark, held).withColumn("capture", F.lit(name).cast("string"))
              for name, held in rows.items()]
    return reduce(type(frames[0]).unionByName, frames), [n for n in rows if n]


@pytest.mark.parametrize("compat", [False, True])
def test_summary_of_many_captures_equals_one_by_one(spark, compat):
    frame, names = _captures(spark)
    dims = (spark.createDataFrame([(17, "UDP"), (6, "TCP"), (6, "TCP2")], schemas.PROTOCOL_DIM),
            spark.createDataFrame([*PORTS, (1, "one"), (1, "uno")], schemas.PORT_DIM))
    got = report.captures_summary(frame, *dims, 2, compat).collect()
    want = report.attack_summaries([
        report.attack_summary(frame.where(F.col("capture") == n), *dims, n, 2, compat)
        for n in names]).collect()
    assert got == want and len(got) == 5
    by_name = {r.file_name: r for r in got}
    assert by_name["tie"].protocol == "TCP" and by_name["tie"].start == 8
    assert by_name["none"].start is None and by_name["none"].src_ips == 0
    assert by_name["syn"].flags == "SYN(6)"


def _reads(spark, frame, use):
    """How often every row of `frame` is read while `use(frame)` runs."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = frame.count()
    use(frame.mapInArrow(count, frame.schema)).collect()
    return seen.value / rows


def test_summaries_and_source_statistics_read_the_packets_three_times_at_most(spark):
    frame, _ = _captures(spark)
    frame = staged(frame.where("capture is not null"), "test-captures")
    dims = (spark.createDataFrame([(17, "UDP")], schemas.PROTOCOL_DIM),
            spark.createDataFrame(PORTS, schemas.PORT_DIM))
    networks = spark.createDataFrame([], "ip string, asn string, bgp_prefix string, "
                                         "country string, as_info string")
    assert _reads(spark, frame, lambda p: report.captures_summary(p, *dims)) <= 3
    assert _reads(spark, frame, lambda p: report.attack_summary(p, *dims, "x")) <= 3
    assert _reads(spark, frame, lambda p: attack.source_stats_asn(p, networks)) <= 3
    flow = staged(spark.createDataFrame([
        _flow(i, f"s{i % 3}", i, sport=i) for i in range(40)], schemas.FLOWS), "test-flows")
    assert _reads(spark, flow, lambda f: flows.flow_source_stats_asn(f, networks)) <= 3


def test_report_time_column(spark):
    frame = spark.createDataFrame([(0, 1)], "timestamp long, n int")
    assert dict(report.with_datetime(frame).dtypes)["timestamp"] == "timestamp"


def _flow(ts, src, byts, dst="v", proto="UDP", sport=1, dport=2, pkts=1, flags="."):
    return (ts, proto, src, dst, sport, dport, pkts, byts, flags, 0)


def test_flow_top_protocol_counts_flows_not_packets(spark):
    frame = spark.createDataFrame([
        _flow(1, "a", 10, proto="TCP", pkts=100), _flow(2, "a", 10), _flow(3, "b", 10),
        _flow(4, "b", 10, dst="w", pkts=50)], schemas.FLOWS)
    assert rows(flows.flow_filter_top_proto(frame), "ip_proto", "ip_src") == [
        ("UDP", "a"), ("UDP", "b")]
    assert rows(flows.flow_proto_stats(frame)) == [("TCP", 1), ("UDP", 2)]


def test_flow_source_stats(spark):
    frame = spark.createDataFrame([
        _flow(1, "a", 10, sport=9, flags="S"), _flow(1, "a", 30, sport=10, flags="A"),
        _flow(2, "a", 1 << 20, sport=9, flags="A"), _flow(3, "a", 1 << 30, sport=100)],
        schemas.FLOWS)
    (got,) = flows.flow_source_stats(frame).collect()
    assert got.distinct_sport == "9,10,100" and got.tot_distinct_sport == 3
    assert got.distinct_dport == "2" and list(got.distinct_flags) == [".", "A", "S"]
    assert got.pkt_length_median == (30 + (1 << 20)) / 2 and got.total_packets == 4.0


@pytest.mark.parametrize("view", report.VIEWS)
def test_views_are_column_subsets(view, spark):
    stats = attack.source_stats(packets(spark, [udp(1, "a")]))
    assert report.report_views(stats, view).columns == report.VIEWS[view]
