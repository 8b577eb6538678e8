"""Address lookups against plain search, on overlapping ranges and prefixes of all lengths."""

import ipaddress
import random

from floodlens.operators import geo


def _text(number):
    return str(ipaddress.ip_address(number))


def test_ranges(spark):
    rng = random.Random(8)
    ranges = []
    for i in range(60):
        start = rng.randrange(2 ** 24, 2 ** 24 + 2 ** 20)
        ranges.append((start, start + int(2 ** rng.uniform(0, 21)), f"r{i}"))
    ranges += [(0, 2 ** 32 - 1, "all"), (2 ** 32 - 1, 2 ** 32 - 1, "last"), (0, 0, "first"),
               (9, 5, "none"), (ranges[0][0], ranges[0][1], "r00")]
    numbers = [0, 2 ** 32 - 1, *[rng.randrange(2 ** 24 - 5, 2 ** 24 + 2 ** 21) for _ in range(300)],
               *[x + d for a, b, _ in ranges[:60] for x in (a, b) for d in (-1, 0, 1)]]
    addresses = spark.createDataFrame([(_text(n),) for n in numbers] + [("junk",), (None,)],
                                      "ip string")
    dim = spark.createDataFrame(ranges, "range_start long, range_end long, name string")
    for some in (dim, dim.where("name <> 'all'")):
        held = [tuple(r) for r in some.collect()]
        want = {}
        for n in numbers:
            fitting = [(b - a, name) for a, b, name in held if a <= n <= b]
            if fitting:
                want[_text(n)] = min(fitting)[1]
        found = geo.range_lookup(addresses, "ip", some, ["name"])
        assert {r["ip"]: r["name"] for r in found.collect()} == want


def test_prefixes(spark):
    rng = random.Random(9)
    base = int(ipaddress.ip_address("10.0.0.0"))
    prefixes = []
    for length in [*range(6, 33), *range(20, 33)]:
        network = (base + rng.randrange(2 ** 16)) >> (32 - length) << (32 - length)
        prefixes.append((f"{len(prefixes)}", f"{_text(network)}/{length}", "C", "info"))
    ips = [_text(base + rng.randrange(2 ** 16)) for _ in range(300)] + ["192.0.2.1"]
    ips += [p[1].split("/")[0] for p in prefixes]
    frame = spark.createDataFrame([(ip,) for ip in ips], "ip_src string")
    schema = "asn string, bgp_prefix string, country string, as_info string"
    for table in (prefixes, [*prefixes, ("d", "0.0.0.0/0", None, "default")]):
        want = {}
        for ip in ips:
            fitting = [(ipaddress.ip_network(p).prefixlen, asn, p) for asn, p, *_ in table
                       if ipaddress.ip_address(ip) in ipaddress.ip_network(p)]
            want[ip] = max(fitting)[1:] if fitting else ("NA", "NA")
        found = geo.asn_enrich(frame, spark.createDataFrame(table, schema))
        assert {r["ip"]: (r["asn"], r["bgp_prefix"]) for r in found.collect()} == want


def test_lookups_in_empty_tables(spark):
    frame = spark.createDataFrame([("10.0.0.1",)], "ip_src string")
    prefixes = spark.createDataFrame(
        [], "asn string, bgp_prefix string, country string, as_info string")
    assert [tuple(r) for r in geo.asn_enrich(frame, prefixes).collect()] == [
        ("NA", "10.0.0.1", "NA", None, "NA")]
    ranges = spark.createDataFrame([], "range_start long, range_end long, name string")
    assert geo.range_lookup(frame, "ip_src", ranges, ["name"]).collect() == []
