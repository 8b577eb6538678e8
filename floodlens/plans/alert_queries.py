"""Queries over alerts, fingerprints, HTTP, DNS and the network lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from floodlens.operators import alerts, geo, web
from floodlens.plans.registry import Query
from floodlens.plans.tables import Tables, sql_bin, sql_long, with_views

HOUR, DAY = 3600, 86400


def _located(view: str, columns: str, ip: str = "src") -> str:
    return (f"SELECT {columns} FROM {view} LEFT JOIN geo_dim "
            f"ON {sql_long(ip)} BETWEEN range_start AND range_end")


_COUNTRY = "coalesce(country, '--')"
_LATLON = "CAST(lat AS VARCHAR) || ' ' || CAST(lon AS VARCHAR)"
_JOIN4 = "USING (src, sport, dst, dport)"


def _messages_as_text(df):
    text = F.transform("messages", lambda m: F.concat(
        m["message"], F.lit("*"), m["occurrences"].cast("string")))
    return df.withColumn("messages", F.array_join(text, ","))


def _old_new(t: Tables):
    """Two rule sets over the same capture: the old one lacks some of the rules."""
    old = t.alerts.filter(~F.col("sig").isin("1_3", "1_7", "1_11"))
    return old, t.alerts


_NEW = "sig NOT IN (SELECT sig FROM alerts WHERE sig NOT IN ('1_3', '1_7', '1_11'))"


def _regions(t: Tables):
    """Customers with a country and region code, and the lookup tables."""
    nation = t.table("nation")
    region = F.concat(F.lit("R"), (F.col("n_nationkey") % 5).cast("string"))
    country = F.concat(F.lit("N"), F.col("n_regionkey").cast("string"))
    names = nation.select(country.alias("country"), region.alias("region"),
                          F.col("n_name").alias("region_name")).groupBy(
        "country", "region").agg(F.min("region_name").alias("region_name"))
    zones = names.select("country", "region", F.concat(
        F.lit("Zone/"), "country", F.lit("-"), "region").alias("timezone")).filter(
        F.col("region") != "R4")
    default = nation.select(country.alias("country")).distinct().select(
        "country", F.lit(None).cast("string").alias("region"),
        F.concat(F.lit("Zone/"), "country").alias("timezone"))
    key = F.col("c_custkey")
    rows = t.table("customer").select(
        "c_custkey",
        F.when(key % 11 != 0, F.concat(F.lit("N"), (key % 6).cast("string"))).alias("country"),
        F.when(key % 13 == 0, "").when(key % 7 != 0,
                                       F.concat(F.lit("R"), (key % 5).cast("string")))
        .alias("region"))
    return rows, names, zones.unionByName(default)


_REGION_SQL = """
    WITH names AS (
        SELECT concat('N', CAST(n_regionkey AS VARCHAR)) AS country,
               concat('R', CAST(n_nationkey % 5 AS VARCHAR)) AS region,
               min(n_name) AS region_name FROM nation GROUP BY 1, 2),
    rows AS (
        SELECT c_custkey,
               CASE WHEN c_custkey % 11 <> 0 THEN concat('N', CAST(c_custkey % 6 AS VARCHAR)) END
                   AS country,
               CASE WHEN c_custkey % 13 = 0 THEN ''
                    WHEN c_custkey % 7 <> 0 THEN concat('R', CAST(c_custkey % 5 AS VARCHAR)) END
                   AS region FROM customer)
    SELECT c_custkey, r.country, r.region, n.region_name,
           CASE WHEN n.country IS NOT NULL AND r.region <> 'R4'
                THEN concat('Zone/', r.country, '-', r.region)
                WHEN r.country IN (SELECT country FROM names) THEN concat('Zone/', r.country)
           END AS timezone
    FROM rows r LEFT JOIN names n ON r.country = n.country AND r.region = n.region"""


def _distances(t: Tables):
    key = F.col("s_suppkey").cast("double")
    points = t.table("supplier").select(
        "s_suppkey",
        ((key * 7) % 180 - 90).alias("lat1"), ((key * 13) % 360 - 180).alias("lon1"),
        ((key * 11) % 180 - 90).alias("lat2"), ((key * 17) % 360 - 180).alias("lon2"))
    far = geo.geo_distance(points, "lat1", "lon1", "lat2", "lon2")
    return far.select("s_suppkey", F.round("distance_km", 6).alias("distance_km"))


_RAD = "(3.14159265::DOUBLE / 180)"
_H = (f"pow(sin((lat2 * {_RAD} - lat1 * {_RAD}) / 2), 2) + cos(lat1 * {_RAD}) * "
      f"cos(lat2 * {_RAD}) * pow(sin((lon2 * {_RAD} - lon1 * {_RAD}) / 2), 2)")
_DISTANCE_SQL = f"""
    SELECT s_suppkey, round(12756.4::DOUBLE * atan2(sqrt(h), sqrt(1 - h)), 6) AS distance_km
    FROM (SELECT s_suppkey, {_H} AS h FROM (
        SELECT s_suppkey, (s_suppkey * 7) % 180 - 90.0::DOUBLE AS lat1,
               (s_suppkey * 13) % 360 - 180.0::DOUBLE AS lon1,
               (s_suppkey * 11) % 180 - 90.0::DOUBLE AS lat2,
               (s_suppkey * 17) % 360 - 180.0::DOUBLE AS lon2 FROM supplier))"""

ALERTS = [
    Query("alerts_by_priority_bin", lambda t: alerts.alerts_by_priority_bin(t.alerts, HOUR),
          with_views(f"""
              SELECT a.bin, prio1_count, prio3_count
              FROM (SELECT {sql_bin('ts', HOUR)} AS bin, count(ts) AS prio1_count FROM alerts
                    WHERE priority = 1 GROUP BY 1) a
              FULL JOIN (SELECT {sql_bin('ts', HOUR)} AS bin, count(ts) AS prio3_count FROM alerts
                         WHERE priority = 3 GROUP BY 1) c ON a.bin = c.bin""", "alerts")),
    Query("alert_totals", lambda t: alerts.alert_totals(t.alerts),
          with_views("""SELECT count(ts) AS total_attacks, count(DISTINCT src) AS total_sources,
                               count(DISTINCT dst) AS total_destinations,
                               count(DISTINCT sig) AS distinct_attacks FROM alerts""", "alerts")),
    Query("alert_bin_distincts", lambda t: alerts.alert_bin_distincts(t.alerts, DAY),
          with_views(f"""SELECT {sql_bin('ts', DAY)} AS bin, count(DISTINCT src) AS sources,
                                count(DISTINCT sig) AS signatures,
                                count(DISTINCT dst) AS destinations,
                                count(DISTINCT dport) AS dst_ports, count(ts) AS total
                         FROM alerts GROUP BY 1""", "alerts")),
    Query("alert_bin_priority", lambda t: alerts.alert_bin_priority(t.alerts, HOUR),
          with_views(f"""SELECT {sql_bin('ts', HOUR)} AS bin, priority, count(ts) AS total
                         FROM alerts GROUP BY 1, 2""", "alerts")),
    Query("alert_bin_signature",
          lambda t: _messages_as_text(alerts.alert_bin_signature(t.alerts, DAY)),
          with_views(f"""
              SELECT bin, priority, sig,
                     string_agg(concat(message, '*', CAST(n AS VARCHAR)), ',' ORDER BY message)
                         AS messages, CAST(sum(n) AS BIGINT) AS total
              FROM (SELECT {sql_bin('ts', DAY)} AS bin, priority, sig, message, count(ts) AS n
                    FROM alerts GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""", "alerts")),
    Query("new_alerts", lambda t: alerts.new_alerts(*_old_new(t)),
          with_views(f"SELECT * FROM alerts WHERE {_NEW}", "alerts")),
    Query("new_alert_summary", lambda t: alerts.new_alert_summary(*_old_new(t)),
          with_views(f"""SELECT sig, count(ts) AS alerts FROM alerts WHERE {_NEW}
                         GROUP BY 1""", "alerts")),
    Query("alert_countries", lambda t: alerts.alert_countries(t.alerts, t.geo_dim),
          with_views(f"""SELECT country, round(avg(priority), 9) AS average_severity,
                                count(priority) AS attacks
                         FROM ({_located('alerts', f'{_COUNTRY} AS country, priority')})
                         GROUP BY 1""", "alerts", "geo_dim")),
    Query("alert_countries_by_severity",
          lambda t: alerts.alert_countries(t.alerts, t.geo_dim, "average_severity"),
          with_views(f"""SELECT country, round(avg(priority), 9) AS average_severity,
                                count(priority) AS attacks
                         FROM ({_located('alerts', f'{_COUNTRY} AS country, priority')})
                         GROUP BY 1""", "alerts", "geo_dim")),
    Query("alert_country_timeseries",
          lambda t: alerts.alert_country_timeseries(t.alerts, t.geo_dim),
          with_views(f"""
              SELECT 'All Severities' AS label, country, {sql_bin('ts', DAY)} AS bin,
                     count(ts) AS attacks FROM ({_located('alerts', 'ts, country')})
              WHERE country IN {alerts.CHART_COUNTRIES} GROUP BY country, bin""",
                     "alerts", "geo_dim")),
    Query("alert_locations", lambda t: alerts.alert_locations(t.alerts, t.geo_dim),
          with_views(_located("alerts", f"ts, {_COUNTRY} AS country, asnum, "
                              f"{_LATLON} AS latlon, priority"), "alerts", "geo_dim")),
    Query("alert_globe", lambda t: alerts.alert_globe(t.alerts, t.geo_dim),
          with_views(f"""SELECT latlon, round(avg(priority), 9) AS average_severity,
                                count(priority) AS attacks
                         FROM ({_located('alerts', f'{_LATLON} AS latlon, priority')})
                         GROUP BY 1""", "alerts", "geo_dim")),
    Query("attacker_fingerprints",
          lambda t: alerts.attacker_fingerprints(t.alerts, t.fingerprints),
          with_views(f"""SELECT a.*, f.ts AS fp_ts, f.os
                         FROM alerts a JOIN fingerprints f {_JOIN4}""",
                     "alerts", "fingerprints")),
    Query("os_frequency", lambda t: alerts.os_frequency(t.fingerprints),
          with_views("SELECT os, count(ts) AS fingerprints FROM fingerprints GROUP BY 1",
                     "fingerprints")),
    Query("os_and_http_by_source",
          lambda t: alerts.os_and_http_by_source(t.fingerprints, t.http),
          with_views("""
              SELECT src, 'os' AS kind, os AS value, count(*) AS occurrences FROM fingerprints
              WHERE src IN (SELECT src FROM http) GROUP BY 1, 2, 3
              UNION ALL
              SELECT src, 'field' AS kind, field AS value, count(*) AS occurrences FROM http
              WHERE src IN (SELECT src FROM fingerprints) GROUP BY 1, 2, 3""",
                     "fingerprints", "http")),
    Query("attacker_useragents", lambda t: alerts.attacker_useragents(t.alerts, t.http),
          with_views(f"""SELECT field, count(*) AS count FROM alerts a JOIN http h {_JOIN4}
                         GROUP BY 1""", "alerts", "http")),
    Query("attacker_profile", lambda t: alerts.attacker_profile(
        t.alerts, t.fingerprints, t.http, t.geo_dim),
          with_views(f"""
              SELECT DISTINCT sig, message, field, os, src, sport, dst, dport, ts,
                     {_COUNTRY} AS country, city, {_LATLON} AS latlon
              FROM (SELECT a.sig, a.message, h.field, f.os, src, sport, dst, dport, a.ts
                    FROM alerts a JOIN http h {_JOIN4} JOIN fingerprints f {_JOIN4}
                    WHERE a.priority = 1)
              LEFT JOIN geo_dim ON {sql_long('src')} BETWEEN range_start AND range_end""",
                     "alerts", "http", "fingerprints", "geo_dim")),
    Query("attacker_profile_compat", lambda t: alerts.attacker_profile(
        t.alerts, t.fingerprints, t.http, t.geo_dim, compat=True),
          with_views(f"""
              SELECT DISTINCT sig, message, field, os, src, sport, dst, dport, ts,
                     {_COUNTRY} AS country, city, {_LATLON} AS latlon
              FROM (SELECT a.sig, b.message, h.field, f.os, src, sport, dst, dport, c.ts
                    FROM alerts a JOIN alerts b {_JOIN4} JOIN alerts c {_JOIN4}
                    JOIN http h {_JOIN4} JOIN fingerprints f {_JOIN4}
                    WHERE a.priority = 1 AND b.priority = 1 AND c.priority = 1)
              LEFT JOIN geo_dim ON {sql_long('src')} BETWEEN range_start AND range_end""",
                     "alerts", "http", "fingerprints", "geo_dim")),
]

LOOKUPS = [
    Query("asn_enrich", lambda t: geo.asn_enrich(t.packets, t.prefix_dim),
          with_views("""
              SELECT CASE WHEN bgp_prefix IS NULL THEN 'NA' ELSE asn END AS asn, ip,
                     coalesce(bgp_prefix, 'NA') AS bgp_prefix,
                     country,
                     CASE WHEN bgp_prefix IS NULL THEN 'NA' ELSE as_info END AS as_info
              FROM (SELECT DISTINCT ip_src AS ip FROM packets) LEFT JOIN prefix_dim
                  ON starts_with(ip, regexp_replace(bgp_prefix, '0/24$', ''))""",
                     "packets", "prefix_dim")),
    Query("geo_country", lambda t: geo.geo_country(t.alerts, "src", t.geo_dim),
          with_views(_located("alerts", f"alerts.*, {_COUNTRY} AS country"),
                     "alerts", "geo_dim")),
    Query("geo_city", lambda t: geo.geo_city(t.alerts, "src", t.geo_dim),
          with_views(_located("alerts", "alerts.*, city"), "alerts", "geo_dim")),
    Query("geo_latlon", lambda t: geo.geo_latlon(t.alerts, "src", t.geo_dim),
          with_views(_located("alerts", f"alerts.*, {_LATLON} AS latlon"),
                     "alerts", "geo_dim")),
    Query("geo_asnum", lambda t: geo.geo_asnum(t.alerts, "src", t.geo_dim),
          with_views(_located("alerts", "alerts.*, asnum"), "alerts", "geo_dim")),
    Query("geo_region_timezone", lambda t: geo.geo_region_timezone(*_regions(t)),
          _REGION_SQL.strip()),
    Query("geo_distance", _distances, _DISTANCE_SQL.strip()),
]

WEB = [
    Query("http_field_frequency", lambda t: web.http_field_frequency(t.http),
          with_views("SELECT field, count(field) AS count FROM http GROUP BY 1", "http")),
    Query("http_fields_per_source", lambda t: web.http_fields_per_source(t.http),
          with_views("""SELECT src, field, count(DISTINCT field) AS count FROM http
                        GROUP BY 1, 2""", "http")),
    Query("http_countries", lambda t: web.http_countries(t.http, t.geo_dim),
          with_views(f"""SELECT country, count(*) AS count
                         FROM ({_located('http', f'{_COUNTRY} AS country')}) GROUP BY 1""",
                     "http", "geo_dim")),
    Query("dns_response_ttl", lambda t: web.dns_response_ttl(t.dns),
          with_views("""SELECT name, ttl, count(ts) AS count FROM dns
                        WHERE mode = 'response' AND ttl > 0 GROUP BY 1, 2""", "dns")),
]

QUERIES = [*ALERTS, *LOOKUPS, *WEB]
