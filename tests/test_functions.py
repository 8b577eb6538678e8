"""Shared expressions and aggregations against plain Python."""

import math
import random
import statistics

from pyspark.sql import functions as F
from support import plan, rows

from floodlens import schemas
from floodlens.functions.addresses import (
    in_network,
    ipv4_to_long,
    long_to_ipv4,
    tcp_flag_columns,
)
from floodlens.functions.geodesy import great_circle_km
from floodlens.functions.summaries import exact_median, value_counts
from floodlens.operators import geo


def test_addresses_round_trip(spark):
    frame = spark.createDataFrame(
        [("0.0.0.0",), ("255.255.255.255",), ("10.1.2.3",), ("256.1.1.1",), ("1.2.3",),
         ("1.2.3.4.5",), ("",), ("a.b.c.d",), (None,)], "ip string")
    got = frame.select("ip", ipv4_to_long("ip").alias("n")).withColumn("back", long_to_ipv4("n"))
    for ip, n, back in (tuple(r) for r in got.collect()):
        if ip in ("0.0.0.0", "255.255.255.255", "10.1.2.3"):
            assert back == ip
        else:
            assert n is None


def test_networks(spark):
    frame = spark.createDataFrame(
        [("145.58.0.0",), ("145.58.255.255",), ("145.59.0.0",), ("x",)], "ip string")
    got = [r[0] for r in frame.select(in_network("ip", "145.58.0.0/16")).collect()]
    assert got == [True, True, False, None]


def test_an_address_is_taken_apart_once(spark):
    """Also where it is an expression that a filter holds."""
    frame = spark.range(3).select(F.concat(F.lit("145.58.0."), "id").alias("ip"))
    found = frame.filter(in_network("ip", "145.58.0.0/16"))
    filters = [line for line in plan(found).splitlines() if "Filter" in line]
    assert found.count() == 3 and sum(line.count("split(") for line in filters) == 1


def test_odd_parts_of_addresses(spark):
    texts = [" 1.2.3.4", "1.2.3.4 ", "01.2.3.4", "+1.2.3.4", "-1.2.3.4", "1.2.3.", ".1.2.3", "1..2.3",
             "1.2.3.4.", "1.2.3.4.5.6.7.8.9.10", "1.2.3.1e1", "1.2.3.99999999999999999999", "1.0.0.0.0"]
    frame = spark.createDataFrame([(t,) for t in texts], "ip string")
    first = (1 << 24) + (2 << 16) + (3 << 8) + 4
    assert [r[0] for r in frame.select(ipv4_to_long("ip")).collect()] == [first] * 4 + [None] * 9


def test_flag_bits(spark):
    frame = spark.createDataFrame([(0b100010010,)], "f int")
    got = frame.select(*[c.alias(n) for n, c in tcp_flag_columns("f").items()]).first().asDict()
    assert {n for n, v in got.items() if v} == {"ns", "ack", "syn"}


def test_exact_median_per_key(spark):
    random.seed(3)
    data = [(f"k{i % 5}" if i % 3 else "hot", random.choice(
        [random.randint(-5, 5), random.randint(0, 1 << 31), random.randint(0, 100000)]))
        for i in range(3000)] + [("one", 7), (None, 5), (None, 8), ("k0", None)]
    frame = spark.createDataFrame(data, "k string, v long").repartition(7)
    want = {}
    for k, v in data:
        if v is not None:
            want.setdefault(k, []).append(v)
    got = {r.k: r.m for r in exact_median(frame, "k", "v", "m").collect()}
    assert got == {k: float(statistics.median(v)) for k, v in want.items()}
    # Small blocks, so that the middle ranks fall into different ones.
    small = {r.k: r.m for r in exact_median(frame, "k", "v", "m", block_bits=2).collect()}
    assert small == got


def test_value_counts_leave_nulls_out(spark):
    frame = spark.createDataFrame([("a", 1, None), ("a", 1, 2), ("b", None, None)],
                                  "k string, x int, y int")
    got = value_counts(frame, ["k"], {"x": F.col("x"), "y": F.col("y")})
    assert rows(got) == [("a", "x", 1, 2), ("a", "y", 2, 1)]


def test_distance(spark):
    frame = spark.createDataFrame([(52.0, 5.0, 40.7, -74.0), (1.0, 1.0, 1.0, 1.0)],
                                  "a double, b double, c double, d double")
    far, same = (r[0] for r in frame.select(great_circle_km("a", "b", "c", "d")).collect())
    lat1, lon1, lat2, lon2 = map(math.radians, (52.0, 5.0, 40.7, -74.0))
    h = (math.sin((lat2 - lat1) / 2) ** 2
         + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2)
    assert math.isclose(far, 12756.4 * math.atan2(math.sqrt(h), math.sqrt(1 - h)), rel_tol=1e-7)
    assert same == 0.0


def test_longest_prefix_wins(spark):
    prefixes = spark.createDataFrame([
        ("1", "10.0.0.0/8", "A", "eight"), ("2", "10.1.0.0/16", "B", "sixteen"),
        ("3", "10.1.2.0/24", None, "twentyfour"), ("4", "10.1.2.3/32", "D", "host"),
        ("5", "junk", "E", "bad")], "asn string, bgp_prefix string, country string, as_info string")
    ips = spark.createDataFrame(
        [("10.9.9.9",), ("10.1.9.9",), ("10.1.2.9",), ("10.1.2.3",), ("11.0.0.1",), ("10.1.2.9",),
         ("no address",)], "ip_src string")
    got = {r.ip: (r.asn, r.country) for r in geo.asn_enrich(ips, prefixes).collect()}
    assert got == {
        "10.9.9.9": ("1", "A"), "10.1.9.9": ("2", "B"), "10.1.2.9": ("3", None),
        "10.1.2.3": ("4", "D"), "11.0.0.1": ("NA", None), "no address": ("NA", None)}
    assert geo.asn_enrich(ips, prefixes).columns == schemas.ASN_DIM.names


def test_default_route(spark):
    prefixes = spark.createDataFrame([("0", "0.0.0.0/0", "Z", "all")],
                                     "asn string, bgp_prefix string, country string, as_info string")
    ips = spark.createDataFrame([("255.0.0.1",), ("1.2.3.4",)], "ip_src string")
    assert rows(geo.asn_enrich(ips, prefixes), "asn", "country") == [("0", "Z"), ("0", "Z")]


GEO = "range_start long, range_end long, country string, city string, lat double, lon double, " \
      "asnum string"


def test_ranges(spark):
    base = 10 << 24
    dim = spark.createDataFrame([
        (base, base + (1 << 24) - 1, "AA", "wide", 1.5, -2.25, "AS1"),
        (base + 70000, base + 70010, "BB", None, 0.5, 3.0, None)], GEO)
    ips = spark.createDataFrame(
        [("10.0.0.0", 1), ("10.255.255.255", 2), ("10.1.17.112", 3), ("10.1.17.122", 4),
         ("10.1.17.123", 5), ("11.0.0.0", 6), (None, 7), ("x", 8)], "ip string, id int")
    country = {r.id: r.country for r in geo.geo_country(ips, "ip", dim).collect()}
    assert country == {1: "AA", 2: "AA", 3: "BB", 4: "BB", 5: "AA", 6: "--", 7: "--", 8: "--"}
    city = {r.id: r.city for r in geo.geo_city(ips, "ip", dim).collect()}
    assert city == {1: "wide", 2: "wide", 3: None, 4: None, 5: "wide", 6: None, 7: None, 8: None}
    assert geo.geo_latlon(ips, "ip", dim).filter("id = 1").first().latlon == "1.5 -2.25"
    assert geo.geo_asnum(ips, "ip", dim).filter("id = 6").first().asnum is None


def test_region_and_zone(spark):
    regions = spark.createDataFrame([("US", "CA", "California")],
                                    "country string, region string, region_name string")
    zones = spark.createDataFrame(
        [("US", "CA", "America/Los_Angeles"), ("NL", None, "Europe/Amsterdam")],
        "country string, region string, timezone string")
    frame = spark.createDataFrame(
        [("US", "CA"), ("US", "XX"), ("NL", None), ("NL", ""), ("NL", "07"), (None, "CA")],
        "country string, region string")
    assert rows(geo.geo_region_timezone(frame, regions, zones)) == sorted([
        ("US", "CA", "California", "America/Los_Angeles"), ("US", "XX", None, None),
        ("NL", None, None, "Europe/Amsterdam"), ("NL", "", None, "Europe/Amsterdam"),
        ("NL", "07", None, "Europe/Amsterdam"), (None, "CA", None, None)], key=str)
