"""Alert rules that the test tables do not reach."""

from support import packets, rows, tcp, udp

from floodlens import schemas
from floodlens.operators import alerts, web
from floodlens.operators import packets as general

FINGERPRINTS = "ts long, src string, sport int, dst string, dport int, os string"
HTTP = "ts long, src string, sport int, dst string, dport int, field string"


def _alerts(spark, *entries):
    return spark.createDataFrame(
        [(ts, sig, priority, message, "TCP", src, sport, "v", 80)
         for ts, sig, priority, message, src, sport in entries], schemas.ALERTS)


def test_bin_label_belongs_to_priority_one(spark):
    frame = _alerts(spark, (5, "s", 1, "m", "a", 1), (65, "s", 3, "m", "a", 1),
                    (66, "s", 3, "m", "a", 1), (125, "s", 1, "m", "a", 1),
                    (126, "s", 3, "m", "a", 1), (200, "s", 2, "m", "a", 1))
    assert rows(alerts.alerts_by_priority_bin(frame)) == sorted(
        [(0, 1, None), (120, 1, 1), (None, None, 2)], key=str)


def test_new_rules_keep_unsigned_alerts(spark):
    old = _alerts(spark, (1, "a", 1, "m", "x", 1), (1, None, 1, "m", "x", 1))
    new = _alerts(spark, (1, "a", 1, "m", "x", 1), (2, "b", 1, "m", "x", 1),
                  (3, None, 1, "m", "x", 1))
    assert rows(alerts.new_alerts(old, new), "ts") == [(2,), (3,)]
    assert rows(alerts.new_alert_summary(old, new)) == [("b", 1), (None, 1)]


def test_messages_of_a_signature_are_kept_whole(spark):
    frame = _alerts(spark, *[(i, "s", 1, "m" if i % 3 else "n", "a", 1) for i in range(30)])
    (got,) = alerts.alert_bin_signature(frame).collect()
    assert [tuple(m) for m in got.messages] == [("m", 20), ("n", 10)] and got.total == 30


def test_bags_per_source(spark):
    prints = spark.createDataFrame(
        [(1, "a", 1, "v", 2, "L"), (1, "a", 2, "v", 2, "L"), (1, "b", 1, "v", 2, "L")],
        FINGERPRINTS)
    http = spark.createDataFrame(
        [(1, "a", 1, "v", 2, "curl"), (1, "c", 1, "v", 2, "wget")], HTTP)
    bags = alerts.os_and_http_by_source(prints, http)
    assert rows(bags) == [("a", "field", "curl", 1), ("a", "os", "L", 2)]
    (got,) = alerts.os_and_http_lists(bags).collect()
    assert [tuple(v) for v in got.os] == [("L", 2)]
    assert [tuple(v) for v in got.fields] == [("curl", 1)]


def test_profile_keeps_alerts_together_unless_asked(spark):
    frame = _alerts(spark, (1, "s1", 1, "m1", "10.0.0.1", 7), (2, "s2", 1, "m2", "10.0.0.1", 7),
                    (3, "s3", 2, "m3", "10.0.0.1", 7))
    prints = spark.createDataFrame([(1, "10.0.0.1", 7, "v", 80, "L")] * 2, FINGERPRINTS)
    http = spark.createDataFrame([(1, "10.0.0.1", 7, "v", 80, "ua")] * 2, HTTP)
    geo_dim = spark.createDataFrame(
        [], "range_start long, range_end long, country string, city string, lat double, "
            "lon double, asnum string")
    got = alerts.attacker_profile(frame, prints, http, geo_dim)
    assert rows(got, "sig", "message", "ts", "country") == [
        ("s1", "m1", 1, "--"), ("s2", "m2", 2, "--")]
    assert alerts.attacker_profile(frame, prints, http, geo_dim, compat=True).count() == 8


def test_useragent_pairs(spark):
    frame = _alerts(spark, *[(i, "s", 1, "m", "a", 7) for i in range(3)])
    http = spark.createDataFrame([(1, "a", 7, "v", 80, "x")] * 2 + [(1, "a", 7, "v", 80, "y"),
                                                                    (1, "b", 7, "v", 80, "y")],
                                 HTTP)
    assert alerts.attacker_useragents(frame, http).collect() == [("x", 6), ("y", 3)]


def test_dns_ttl_needs_a_positive_response(spark):
    frame = spark.createDataFrame(
        [(1, "response", "a", 60), (1, "response", "a", 0), (1, "query", "a", 60)],
        "ts long, mode string, name string, ttl long")
    assert rows(web.dns_response_ttl(frame)) == [("a", 60, 1)]


def test_bandwidth_needs_all_three(spark):
    frame = packets(spark, [udp(1, "a", udp_len=8), tcp(2, "a", tcp_len=5), udp(70, "a")])
    assert rows(general.bandwidth_by_protocol(frame)) == [(0, 5, 8, 200)]


def test_ports_on_both_sides(spark):
    frame = packets(spark, [tcp(1, "a", length=10, sport=5, dport=80),
                            tcp(1, "b", length=7, sport=80, dport=5),
                            tcp(1, "b", length=9, sport=0, dport=80),
                            tcp(1, "b", length=3, sport=80, dport=None)])
    assert rows(general.port_inout_volume(frame)) == [(5, 17), (80, 20)]
