"""Intrusion alerts: counts per bin, rule-set comparison, locations, attackers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodlens.functions.rates import time_bin
from floodlens.functions.semijoin import only_possible
from floodlens.functions.summaries import rank_first
from floodlens.operators import geo
from floodlens.session import staged

ENDPOINTS = ["src", "sport", "dst", "dport"]
# The countries of the country series.
CHART_COUNTRIES = ("AU", "CN", "DE", "JP", "NL", "KR", "NZ", "US")


def alerts_by_priority_bin(alerts: DataFrame, time: int = 60) -> DataFrame:
    """Priority-1 and priority-3 alerts per bin.

    The bin label belongs to the priority-1 side: a bin with priority 3 alone has none. A missing
    side has a null count.
    """
    return (
        alerts.filter(F.col("priority").isin(1, 3))
        .groupBy(time_bin("ts", time).alias("_bin"))
        .agg(F.count_if(F.col("priority") == 1).alias("n1"),
             F.count_if(F.col("priority") == 3).alias("n3"))
        .select(F.when(F.col("n1") > 0, F.col("_bin")).alias("bin"),
                F.when(F.col("n1") > 0, F.col("n1")).alias("prio1_count"),
                F.when(F.col("n3") > 0, F.col("n3")).alias("prio3_count"))
    )


def alert_totals(alerts: DataFrame) -> DataFrame:
    """Alerts and distinct sources, destinations and signatures overall."""
    return alerts.agg(
        F.count("ts").alias("total_attacks"),
        F.count_distinct("src").alias("total_sources"),
        F.count_distinct("dst").alias("total_destinations"),
        F.count_distinct("sig").alias("distinct_attacks"),
    )


def alert_bin_distincts(alerts: DataFrame, time: int = 60) -> DataFrame:
    """Distinct sources, signatures, destinations and destination ports, and alerts, per bin."""
    return alerts.groupBy(time_bin("ts", time).alias("bin")).agg(
        F.count_distinct("src").alias("sources"),
        F.count_distinct("sig").alias("signatures"),
        F.count_distinct("dst").alias("destinations"),
        F.count_distinct("dport").alias("dst_ports"),
        F.count("ts").alias("total"),
    )


def alert_bin_priority(alerts: DataFrame, time: int = 60) -> DataFrame:
    """Alerts per (bin, priority)."""
    return alerts.groupBy(time_bin("ts", time).alias("bin"), "priority").agg(
        F.count("ts").alias("total"))


def alert_bin_signature(alerts: DataFrame, time: int = 60) -> DataFrame:
    """Alerts and their messages per (bin, priority, signature).

    The bag of messages is kept whole as (message, occurrences) entries: counted before it is
    gathered, its size is the number of different texts of a rule, not the number of alerts.
    """
    keys = ["bin", "priority", "sig"]
    return (
        alerts.groupBy(time_bin("ts", time).alias("bin"), "priority", "sig", "message")
        .agg(F.count("ts").alias("n"), F.count("*").alias("occurrences"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("message", "occurrences"))).alias("messages"),
             F.sum("n").alias("total"))
    )


def new_alerts(old_alerts: DataFrame, new: DataFrame) -> DataFrame:
    """Alerts whose signature only the new rule set raises."""
    return new.join(old_alerts.select("sig").distinct(), "sig", "left_anti").select(*new.columns)


def new_alert_summary(old_alerts: DataFrame, new: DataFrame) -> DataFrame:
    """Alerts per signature that only the new rule set raises."""
    counts = new.groupBy("sig").agg(F.count("ts").alias("alerts"))
    return counts.join(old_alerts.select("sig").distinct(), "sig", "left_anti")


def _per_source(alerts: DataFrame) -> DataFrame:
    """Alert count and priority sum per source: what the location results are rolled up from."""
    return alerts.groupBy("src").agg(
        F.sum("priority").alias("_priorities"), F.count("priority").alias("_n"))


def _severity(grouped) -> DataFrame:
    return grouped.agg(
        (F.sum("_priorities") / F.sum("_n")).alias("average_severity"),
        F.sum("_n").alias("attacks"),
    )


def alert_countries(alerts: DataFrame, geo_dim: DataFrame, by: str = "attacks") -> DataFrame:
    """Mean priority and alerts per source country, ascending by `attacks` or `average_severity`.

    Alerts are summed per source before the lookup, so the join sees each source once.
    """
    located = geo.geo_country(_per_source(alerts), "src", geo_dim)
    return _severity(located.groupBy("country")).orderBy(by, "country")


def alert_country_timeseries(alerts: DataFrame, geo_dim: DataFrame, time: int = 86400,
                             countries: tuple[str, ...] = CHART_COUNTRIES) -> DataFrame:
    """Alerts per (country, bin) for the listed countries, with a constant label."""
    per_source = alerts.groupBy("src", time_bin("ts", time).alias("bin")).agg(
        F.count("ts").alias("n"))
    return (
        geo.geo_country(per_source, "src", geo_dim)
        .filter(F.col("country").isin(*countries))
        .groupBy("country", "bin").agg(F.sum("n").alias("attacks"))
        .select(F.lit("All Severities").alias("label"), "country", "bin", "attacks")
    )


def alert_locations(alerts: DataFrame, geo_dim: DataFrame) -> DataFrame:
    """Time, country, organisation, location and priority of every alert."""
    located = geo.with_location(alerts, "src", geo_dim, {
        "country": F.col("country"), "asnum": F.col("asnum"), "latlon": geo.lat_lon()})
    return located.select(
        "ts", F.coalesce("country", F.lit(geo.UNKNOWN_COUNTRY)).alias("country"),
        "asnum", "latlon", "priority")


def alert_globe(alerts: DataFrame, geo_dim: DataFrame) -> DataFrame:
    """Mean priority and alerts per location, ascending by alerts."""
    located = geo.geo_latlon(_per_source(alerts), "src", geo_dim)
    return _severity(located.groupBy("latlon")).orderBy("attacks", "latlon")


def attacker_fingerprints(alerts: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Alerts with the fingerprints of the same connection."""
    extra = only_possible(fingerprints, alerts, ENDPOINTS).select(
        *ENDPOINTS, *[F.col(c).alias(f"fp_{c}" if c in alerts.columns else c)
                      for c in fingerprints.columns if c not in ENDPOINTS])
    return alerts.join(extra, ENDPOINTS).select(
        *alerts.columns, *[c for c in extra.columns if c not in ENDPOINTS])


def os_frequency(fingerprints: DataFrame) -> DataFrame:
    """Fingerprints per operating system."""
    return fingerprints.groupBy("os").agg(F.count("ts").alias("fingerprints"))


def os_and_http_by_source(fingerprints: DataFrame, http: DataFrame) -> DataFrame:
    """For each source with both: its operating systems and its header values, as bags in rows.

    One row per (source, kind, value) with its occurrences; kind is `os` or `field`. A busy
    source thus has many rows instead of one unbounded list; `os_and_http_lists` gathers them.
    """
    os = fingerprints.groupBy("src", F.col("os").alias("value")).agg(
        F.count("*").alias("occurrences")).withColumn("kind", F.lit("os"))
    fields = http.groupBy("src", F.col("field").alias("value")).agg(
        F.count("*").alias("occurrences")).withColumn("kind", F.lit("field"))
    both = (
        fingerprints.select("src").distinct().join(http.select("src").distinct(), "src")
    )
    return (
        os.unionByName(fields).join(both, "src", "left_semi")
        .select("src", "kind", "value", "occurrences")
    )


def os_and_http_lists(bags: DataFrame) -> DataFrame:
    """The bags of `os_and_http_by_source` as two sorted lists of (value, occurrences) per source.

    For sources whose number of different header values fits a row.
    """
    def entries(kind: str):
        return F.sort_array(F.collect_list(
            F.when(F.col("kind") == kind, F.struct("value", "occurrences"))))

    return bags.groupBy("src").agg(entries("os").alias("os"), entries("field").alias("fields"))


def attacker_useragents(alerts: DataFrame, http: DataFrame) -> DataFrame:
    """(alert, header) pairs of the same connection per header value, most first.

    Both sides are counted per connection before they meet, so no pair is ever written out.
    Headers of connections without alerts are left out before they are shuffled.
    """
    raised = staged(alerts.groupBy(*ENDPOINTS).agg(F.count("*").alias("_alerts")),
                    "alerted-connections")
    sent = only_possible(http, raised, ENDPOINTS).groupBy(*ENDPOINTS, "field").agg(
        F.count("*").alias("_headers"))
    return (
        sent.join(raised, ENDPOINTS)
        .groupBy("field").agg(F.sum(F.col("_alerts") * F.col("_headers")).alias("count"))
        .orderBy(*rank_first("count", "field"))
    )


def attacker_profile(alerts: DataFrame, fingerprints: DataFrame, http: DataFrame,
                     geo_dim: DataFrame, compat: bool = False) -> DataFrame:
    """Priority-1 alerts with the fingerprints, headers and location of the same connection.

    Every side is made distinct before the joins, and rows of connections without such alerts are
    left out before that. `compat=True` combines signatures, messages and times of a connection
    freely, as the original flattening did, instead of keeping those of one alert together; its
    size is the product of the three numbers for every connection.
    """
    high = alerts.filter(F.col("priority") == 1)
    if compat:
        raised = high.select(*ENDPOINTS, "sig").distinct()
        for column in ("message", "ts"):
            raised = raised.join(high.select(*ENDPOINTS, column).distinct(), ENDPOINTS)
    else:
        raised = high.select(*ENDPOINTS, "sig", "message", "ts").distinct()
    connections = staged(high.select(*ENDPOINTS).distinct(), "alerted-connections")
    fields, systems = (only_possible(side, connections, ENDPOINTS).select(
        *ENDPOINTS, column).distinct() for side, column in ((http, "field"), (fingerprints, "os")))
    joined = raised.join(fields, ENDPOINTS).join(systems, ENDPOINTS)
    located = geo.with_location(joined, "src", geo_dim, {
        "country": F.col("country"), "city": F.col("city"), "latlon": geo.lat_lon()})
    return located.select(
        "sig", "message", "field", "os", *ENDPOINTS, "ts",
        F.coalesce("country", F.lit(geo.UNKNOWN_COUNTRY)).alias("country"), "city", "latlon")
