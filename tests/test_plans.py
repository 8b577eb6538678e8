"""Physical plans and whole reports."""

import re

import pytest
from pyspark.sql import functions as F
from support import plan

from floodlens.operators import alerts, attack, flows, geo, report
from floodlens.operators import packets as general
from floodlens.plans import reports
from floodlens.plans.registry import all_queries
from floodlens.plans.tables import Tables
from floodlens.session import shared_folder, staged

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF_DIR)


@pytest.fixture(scope="module")
def stored(tables):
    return staged(tables.packets, "test-packets")


def test_target_is_counted_once_and_reaches_the_scan(stored):
    traffic = attack.filter_top_proto(stored).select("ip_src")
    traffic.collect()
    assert "ReusedExchange" in plan(traffic)
    scans = re.findall(r"FileScan parquet \[([^]]*)\][^\n]*DataFilters: \[([^\n]*)", plan(traffic))
    columns, filters = next(scan for scan in scans if "ip_src" in scan[0])
    assert set(re.sub(r"#\d+L?", "", columns).split(",")) == {"ip_proto", "ip_src", "ip_dst"}
    assert filters.count("Subquery") >= 2


def test_source_stats_read_their_columns_only(stored):
    stats = attack.source_stats(stored, filtered=True).select("src_ip", "num_distinct_sport")
    names = set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<([^>]*)>",
                                                          plan(stats)))))
    assert names <= {"ip_src", "udp_sport", "tcp_sport", "udp_dport", "tcp_dport",
                     "ip_total_length"}


def test_top_ports_do_not_sort_everything(stored):
    text = plan(general.top_dst_ports(stored))
    assert "TakeOrderedAndProject" in text and "partial_count" in text


# The queries whose result is one row from one-row parts use no join at all; every other join is
# an equality.
@pytest.mark.parametrize("name", [n for n in all_queries() if not n.startswith("stream_conversations")
                                  and "sink" not in n and n not in ("connection_split",)])
def test_no_product_joins(name, tables):
    text = plan(all_queries()[name].run(tables))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_no_row_by_row_python(tables):
    for name in all_queries():
        if "sink" in name or name in ("stream_conversations", "connection_split"):
            continue
        assert "BatchEvalPython" not in plan(all_queries()[name].run(tables)), name


def test_location_lookup_sees_each_source_once(tables):
    text = plan(alerts.alert_countries(tables.alerts, tables.geo_dim))
    assert "partial_sum(priority" in text


def test_staged_copy_reads_columns(stored):
    assert "ReadSchema: struct<ts:bigint>" in plan(stored.select("ts"))


def test_shared_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    one, two = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert one != two and (root is None or one.startswith(root))


def test_shared_folder_is_asked_for_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Cluster, "x")
    Cluster.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        shared_folder(Cluster, "x")


def _read(spark, folder, name):
    return spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/{name}")


def test_packet_report(spark, tables, tmp_path):
    folder = str(tmp_path / "report")
    names = reports.packet_report(tables.packets, tables.ip_proto_dim, tables.port_dim,
                                  tables.prefix_dim, folder, "capture-1.txt", 3600)
    assert set(names) == {p.name for p in (tmp_path / "report").iterdir()}
    total = attack.filter_top_proto(tables.packets).count()
    sources = _read(spark, folder, "sources").count()

    def total_of(name, column):
        return _read(spark, folder, name).agg(F.sum(column)).first()[0]

    assert total_of("attack_series", "pkts_per_bin") == total
    assert total_of("source_series", "pkts_per_bin") == total
    assert total_of("source_stats", "total_packets") == total
    assert total_of("series", "pkts_per_bin") == tables.packets.count()
    for name in ("country_stats", "bgp_stats", "asn_stats"):
        assert total_of(name, "sips") == sources
    summary = _read(spark, folder, "summary").first()
    assert (summary.src_ips, summary.file_name) == (sources, "capture-1")
    assert len(list((tmp_path / "report" / "summary").glob("part-*"))) == 1
    view = _read(spark, folder, "view_ttl")
    assert view.columns == report.VIEWS["ttl"] and view.count() == sources


def test_flow_report(spark, tables, tmp_path):
    folder = str(tmp_path / "report")
    names = reports.flow_report(tables.flows, tables.port_dim, tables.prefix_dim, folder, 86400)
    assert set(names) == {p.name for p in (tmp_path / "report").iterdir()}
    traffic = flows.flow_filter_top_proto(tables.flows)
    packets = float(traffic.agg(F.sum("pkts")).first()[0])
    for name, column in (("source_series", "pkts_per_second"), ("source_stats", "total_packets"),
                         ("src_ports", "packets"), ("dst_ports", "packets")):
        assert _read(spark, folder, name).agg(F.sum(column)).first()[0] == packets


def test_hot_source_gives_the_same_statistics(spark, tables):
    """One source with a third of all packets, and salts of its rows in every partition."""
    hot = tables.packets.withColumn("ip_src", F.when(F.col("ip_id") % 3 == 0, "10.0.0.1")
                                    .otherwise(F.col("ip_src")))
    spread = hot.repartition(13, "ip_id")
    one = attack.source_stats(hot).orderBy("src_ip").select("src_ip", "num_distinct_sport",
                                                            "pkt_length_median").collect()
    two = attack.source_stats(spread).orderBy("src_ip").select(
        "src_ip", "num_distinct_sport", "pkt_length_median").collect()
    assert one == two


def test_range_lookup_joins_on_networks(tables):
    text = plan(geo.geo_country(tables.alerts, "src", tables.geo_dim))
    joins = [line for line in text.splitlines() if "_network" in line and "Join" in line]
    assert joins and all("_length" in line and "range_start" not in line for line in joins)
