"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the table folder, BENCH_CPUS (default 8) the
local cores. Each query runs once to warm up and then BENCH_RUNS times (default 1); the fastest
counts. Results go to a sink that reads every row and keeps none.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from floodlens.plans.registry import all_queries  # noqa: E402
from floodlens.plans.tables import Tables  # noqa: E402
from floodlens.session import build_session, ship_package  # noqa: E402

HEADLINE = [
    # packet drill-down
    "traffic_timeseries", "packets_per_dst", "filter_top_proto", "ip_proto_stats",
    "src_port_stats", "attack_overall_stats", "source_stats", "source_timeseries",
    "source_stats_asn", "country_stats", "attack_summary",
    # flow drill-down
    "flow_timeseries", "flow_proto_stats", "flow_src_port_stats", "flow_source_stats",
    "flow_source_stats_asn",
    # general packet queries, payloads
    "packet_total", "bandwidth_by_protocol", "top_dst_ports", "packet_size_histogram",
    "source_fanout", "port_inout_volume", "payload_ngrams", "ngrams_by_service", "word_count",
    # conversations, alerts, lookups
    "conversation_build", "conversation_volume", "alert_bin_distincts", "alert_countries",
    "attacker_useragents", "attacker_profile", "asn_enrich", "geo_country",
    # scans
    "packet_scan", "flow_scan", "packet_scan_pcap", "alert_scan", "fingerprint_scan",
    "dns_rows", "http_message_split",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", int(cpus),
        **{"spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    queries = all_queries()
    seconds = {}
    for name in only:
        best = None
        for run in range(runs + 1):
            start = time.perf_counter()
            queries[name].run(Tables(spark, sf_dir)).write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - start
            if run and (best is None or taken < best):
                best = taken
        seconds[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds,
        "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
