"""Queries that read text, JSON or capture inputs, and the sinks.

The driver tables hold no such inputs, so each query first lets Spark write files of such lines,
derived from the relations, to the shared folder, and then scans that folder; the check compares
with the relations themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens import schemas
from floodlens.functions.rates import time_bin
from floodlens.operators import alerts, attack, packets
from floodlens.plans.registry import Query
from floodlens.plans.tables import Tables, sql_bin, sql_epoch, with_views
from floodlens.session import shared_folder
from floodlens.sources import (
    alerts as alert_source,
)
from floodlens.sources import (
    capture,
    capture_splits,
    conversations,
    dns,
    fingerprints,
    http,
    ledger,
    records,
    sinks,
)

HOUR, DAY = 3600, 86400


def _line(*columns: Column, sep: str) -> Column:
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("NONE")) for c in columns])


def _files(df: DataFrame, value: Column, name: str) -> str:
    """A folder of text files with `value` of each row, one for every task that has some."""
    folder = shared_folder(df.sparkSession, name)
    df.select(value.alias("value")).write.text(folder)
    return folder


def _packet_scan(t: Tables) -> DataFrame:
    columns = [F.concat(F.col("ts").cast("string"), F.lit(".25")),
               *[F.col(c) for c in schemas.PACKETS.names[1:]]]
    return records.packet_scan(t.spark, _files(t.packets, _line(*columns, sep=" "), "packets"))


def _flow_scan(t: Tables) -> DataFrame:
    columns = [F.col(c) for c in schemas.FLOWS.names]
    return records.flow_scan(t.spark, _files(t.flows, _line(*columns, sep=" "), "flows"))


_OUTSIDE = "l_linenumber % 4 <> 0"


def _flow_prepare(t: Tables) -> DataFrame:
    """Exporter rows; every fourth line item flows out of the network instead of into it."""
    inward = F.expr(_OUTSIDE)
    rows = t.table("lineitem").selectExpr(
        "*", "concat('10.', cast(l_suppkey % 4 as string), '.', cast(l_suppkey % 7 as string), "
        "'.', cast(l_suppkey % 250 as string)) as outer_ip",
        "concat('192.0.', cast(l_linenumber % 3 + 1 as string), '.7') as inner_ip")
    export = rows.select(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("last_seen"),
        F.lit("0.250").alias("duration"),
        F.when(inward, F.col("outer_ip")).otherwise(F.col("inner_ip")).alias("src_addr"),
        F.when(inward, F.col("inner_ip")).otherwise(F.col("outer_ip")).alias("dst_addr"),
        (1024 + F.col("l_partkey") % 2000).cast("string").alias("src_port"),
        F.lit("53").alias("dst_port"), F.lit("UDP").alias("protocol"),
        F.concat(F.lit(".A..S"), "l_linestatus").alias("flags"), F.lit("0").alias("forwarding"),
        F.lit("0").alias("tos"),
        F.col("l_quantity").cast("bigint").cast("string").alias("in_packets"),
        F.floor("l_extendedprice").cast("string").alias("in_bytes"))
    return records.flow_prepare(export, "192.0.2.0/23")


def _alert_scan(t: Tables, compat: bool = False) -> DataFrame:
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ts") / DAY).cast("int"))
    second = F.col("ts") % DAY
    clock = F.format_string("%02d:%02d:%02d", F.floor(second / 3600),
                            F.floor(second % 3600 / 60), second % 60)
    value = F.concat(
        F.date_format(day, "MM/dd/yy"), F.lit("-"), clock, F.lit(".674725  [**] ["),
        F.translate("sig", "_", ":"), F.lit(":1] "), F.col("message"),
        F.lit(" [**] [Classification: Attempted] [Priority: "), F.col("priority").cast("string"),
        F.lit("] {"), F.col("proto"), F.lit("} "), F.col("src"), F.lit(":"),
        F.col("sport").cast("string"), F.lit(" -> "), F.col("dst"), F.lit(":"),
        F.col("dport").cast("string"))
    # A line of another shape after every alert.
    both = t.alerts.select(F.explode(F.array(value, F.lit("--- snipped ---"))).alias("line"))
    return alert_source.alert_scan(t.spark, _files(both, F.col("line"), "alerts"), compat)


def _fingerprint_scan(t: Tables) -> DataFrame:
    """A client and a server block per fingerprint."""
    title = F.concat(F.lit(".-[ "), F.col("src"), F.lit("/"), F.col("sport").cast("string"),
                     F.lit(" -> "), F.col("dst"), F.lit("/"), F.col("dport").cast("string"))

    def block(side: str, system: Column) -> Column:
        return F.concat(title, F.lit(f" (syn) ]-\n|\n| {side}   = "), F.col("src"),
                        F.lit("\n| os       = "), system, F.lit("\n| dist     = 12\n|\n"))

    blocks = t.fingerprint_events.select("*", F.explode(F.array(
        block("client", F.col("os")), block("server", F.lit("srv")))).alias("value"))
    # The observations of a connection are in one log, in order.
    folder = shared_folder(t.spark, "fingerprints")
    (blocks.repartition("src", "sport", "dst", "dport").sortWithinPartitions("event_id")
     .select(F.concat("value", F.lit(fingerprints.BLOCK_END + "\n"))).write.text(folder))
    return fingerprints.fingerprint_scan(t.spark, folder).select(
        "ts", "src", "sport", "dst", "dport", "os", "app", "dist")


_FINGERPRINT_SQL = with_views("""
    SELECT 0::BIGINT AS ts, src, sport, dst, dport, arg_max(os, event_id) AS os,
           CAST(NULL AS VARCHAR) AS app, '12' AS dist FROM fingerprints GROUP BY 2, 3, 4, 5
    UNION ALL
    SELECT DISTINCT 0::BIGINT AS ts, dst AS src, dport AS sport, src AS dst, sport AS dport,
           'srv' AS os, CAST(NULL AS VARCHAR) AS app, '12' AS dist FROM fingerprints""",
                              "fingerprints")


def _conversation_scan(t: Tables) -> DataFrame:
    value = F.to_json(F.struct(
        (F.col("ts") + 0.5).alias("ts"), "src", "sport", "dst", "dport",
        F.lit("close").alias("end_state"),
        F.array(*[F.col("ts") + x for x in (0.5, 1.75, 4.0)]).alias("timestamps")))
    rows = conversations.conversation_scan(t.spark, _files(t.http, value, "conversations"))

    def text(column: str) -> Column:
        return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")

    return rows.withColumn("timestamps", text("timestamps")).withColumn(
        "intervals", text("intervals"))


def _header_files(t: Tables) -> str:
    """Two header lines per HTTP row, in files."""
    key = [F.concat(F.col("ts").cast("string"), F.lit(".75")), F.col("src"), F.col("sport"),
           F.col("dst"), F.col("dport"), F.lit("GET /index HTTP/1.1"), F.lit("s")]
    return _files(t.http.select(F.explode(F.array(
        F.concat_ws("\t", *key, F.lit("host"), F.lit("example.org")),
        F.concat_ws("\t", *key, F.lit("user-agent"), F.col("field")))).alias("line")),
        F.col("line"), "headers")


def _all_fields(t: Tables) -> DataFrame:
    rows = http.http_all_fields_scan(t.spark, _header_files(t))
    return rows.withColumn("fields", F.array_join("fields", "|"))


def _messages(t: Tables) -> DataFrame:
    """Pages as HTTP messages; every third declares only half of its body, every fifth none."""
    page = F.col("page_id")
    shown = F.when(page % 3 == 0, F.substring("html", F.lit(1), F.floor(F.length("html") / 2)
                                              .cast("int"))).otherwise(F.col("html"))
    length = F.when(page % 5 != 0, F.concat(F.lit("Content-Length: "),
                                            F.octet_length(shown).cast("string"),
                                            F.lit("\r\n"))).otherwise("")
    message = F.concat(
        F.lit("POST "), F.col("url"), F.lit(" HTTP/1.1\r\n"), length,
        F.lit("X-Page: old\r\nX-PAGE: "), page.cast("string"),
        F.lit("\r\nConnection: close\r\n\r\n"), F.col("html"))
    return t.table("pages").select("page_id", message.alias("message"))


def _message_split(t: Tables) -> DataFrame:
    rows = http.http_message_split(_messages(t))
    return rows.select("page_id", "status", F.size("headers").alias("num_headers"),
                       F.col("headers")["x-page"].alias("page_header"), "payload")


_SPLIT_SQL = """
    SELECT page_id, concat('POST ', url, ' HTTP/1.1') AS status,
           CASE WHEN page_id % 5 <> 0 THEN 3 ELSE 2 END AS num_headers,
           CAST(page_id AS VARCHAR) AS page_header,
           CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 3 = 0
                THEN left(html, CAST(length(html) // 2 AS BIGINT)) ELSE html END AS payload
    FROM pages"""


def _dns_messages(t: Tables) -> DataFrame:
    response = F.col("mode") == "response"
    question = F.array(F.struct(F.col("name").alias("qname"), F.lit(1).alias("qtype"),
                                F.lit(1).alias("qclass")))
    answer = F.array(F.struct(
        F.col("name").alias("qname"), F.lit(1).alias("qtype"), F.lit(1).alias("qclass"),
        F.col("ttl").alias("qttl"), F.struct(F.col("addr").alias("IPAddress")).alias("qrdata")))
    value = F.to_json(F.struct(
        (F.col("ts") + 0.25).alias("ts"), "id", "mode",
        F.lit("192.0.2.53").alias("srcIP"), F.lit("192.0.2.1").alias("dstIP"),
        question.alias("questions"), F.when(response, answer).otherwise(F.slice(answer, 1, 0))
        .alias("answers")))
    return dns.read_messages(t.spark, _files(t.dns, value, "dns"))


def _file_hashes(t: Tables) -> DataFrame:
    page = F.col("page_id")
    files = t.table("pages").select(
        "page_id", F.col("html").alias("payload"),
        F.when(page % 4 == 0, "text/plain").otherwise("text/html").alias("mimetype"),
        F.when(page % 4 == 0, ".txt").otherwise(".html").alias("ext"),
        F.when(page % 6 == 0, "s").otherwise("c").alias("direction"),
        F.concat(F.lit("GET "), "url", F.lit(" HTTP/1.1")).alias("request"))
    return http.http_file_hashes(files, "text/html")


_HASH_SQL = """
    SELECT page_id, 'text/html' AS mimetype, '.html' AS ext, md5(html) AS md5, sha1(html) AS sha1,
           sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS size,
           CASE WHEN page_id % 6 = 0 OR url = '' THEN '-'
                ELSE right(regexp_replace(url, '[^-_.() a-zA-Z0-9]', '_', 'g'), 50) END AS name
    FROM pages WHERE page_id % 4 <> 0"""


def _whois_clean(t: Tables) -> DataFrame:
    value = F.concat_ws(" | ", F.rpad("asn", 7, " "), F.lit("192.0.2.1 "),
                        F.col("bgp_prefix"), F.coalesce("country", F.lit("")),
                        F.concat("as_info", F.lit(", Inc. - X")))
    lines = t.prefix_dim.select(F.explode(F.array(
        value, F.lit("Bulk mode; one record per line"))).alias("line"))
    return records.whois_scan(t.spark, _files(lines, F.col("line"), "whois"))


_WHOIS_SQL = with_views("""
    SELECT asn, '192.0.2.1' AS ip, bgp_prefix, country,
           concat(replace(as_info, ' ', ''), '-Inc.-X') AS as_info FROM prefix_dim""",
                        "prefix_dim")


def _csv_report(t: Tables) -> DataFrame:
    result = attack.country_stats(t.packets, t.asn_dim)
    folder = shared_folder(t.spark, "report-csv")
    sinks.csv_report_sink(result, folder)
    return t.spark.read.schema(result.schema).option("header", True).csv(folder)


def _tab_report(t: Tables) -> DataFrame:
    result = attack.country_stats(t.packets, t.asn_dim)
    folder = shared_folder(t.spark, "report-tab")
    sinks.delimited_sink(result, folder)
    return t.spark.read.schema(result.schema).option("sep", "\t").csv(folder)


def _json_objects(t: Tables) -> DataFrame:
    rows = alerts.alert_bin_signature(t.alerts, DAY).withColumn("note", F.when(
        F.col("priority") == 1, "high"))
    folder = shared_folder(t.spark, "report-json")
    sinks.json_sink(rows, folder)
    back = t.spark.read.text(folder)
    # The written text itself shows whether nulls are there.
    record = F.from_json("value", rows.schema)
    parsed = back.select(record.alias("r"), F.col("value").contains('"note"').alias("has_note"))
    return parsed.select("r.bin", "r.priority", "r.sig", "r.note", "r.total", "has_note",
                         F.col("r.messages")[0]["message"].alias("message"))


_JSON_SQL = with_views(f"""
    SELECT {sql_bin('ts', DAY)} AS bin, priority, sig,
           CASE WHEN priority = 1 THEN 'high' END AS note, count(ts) AS total,
           true AS has_note, min(message) AS message
    FROM alerts GROUP BY 1, 2, 3""", "alerts")


def _external_store(t: Tables) -> DataFrame:
    rows = packets.bandwidth(t.packets, HOUR)
    folder = shared_folder(t.spark, "store")
    sinks.external_store_sink(rows, folder, "parquet")
    return t.spark.read.schema(rows.schema).parquet(folder)


def _connection_split(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "connections")
    sinks.connection_split(t.sessions, folder, 64)
    back = t.spark.read.parquet(folder)
    return back.select("connection", "ts", "ip_src", "ip_dst", "ip_total_length")


_SPLIT_CONNECTION_SQL = with_views("""
    SELECT CASE WHEN (ip_src, tcp_sport) <= (ip_dst, tcp_dport)
        THEN concat(ip_src, '.', CAST(tcp_sport AS VARCHAR), '-', ip_dst, '.',
                    CAST(tcp_dport AS VARCHAR))
        ELSE concat(ip_dst, '.', CAST(tcp_dport AS VARCHAR), '-', ip_src, '.',
                    CAST(tcp_sport AS VARCHAR)) END AS connection,
        ts, ip_src, ip_dst, ip_total_length FROM sessions
        WHERE tcp_sport IS NOT NULL AND tcp_dport IS NOT NULL""", "sessions")


def _ledger(t: Tables) -> DataFrame:
    """Bytes per bin, committed by three jobs: wrong ones first, the UDP half twice, then all."""
    folder = shared_folder(t.spark, "ledger")
    bytes_of = t.packets.groupBy(time_bin("ts", HOUR).alias("bin")).agg(
        F.sum("ip_total_length").alias("bytes"))
    ledger.ledger_write(bytes_of.withColumn("bytes", F.lit(0).cast("long")), folder, "first")
    for _ in range(2):
        ledger.ledger_write(bytes_of.where("bin % 2 = 0"), folder, "even")
    ledger.ledger_write(bytes_of.where("bin % 2 <> 0 or bin is null or bytes > 0"), folder, "all")
    return ledger.ledger_read(t.spark, folder, bytes_of.schema, ["bin"])


def _captures(t: Tables) -> str:
    """Packets written as capture files by the executors."""
    capture.register_capture(t.spark)
    folder = shared_folder(t.spark, "captures")
    t.packets.write.format("capture").mode("append").save(folder)
    return folder


def _capture_split_scan(t: Tables) -> DataFrame:
    """The files read in ranges of 64 KB."""
    files = ",".join(capture.list_files(_captures(t)))
    return capture_splits.packet_scan_large(t.spark, files, 64 * 1024)


_CAPTURE_SQL = with_views("""
    SELECT * REPLACE (ip_more_fragments AS ip_flags,
                      CASE WHEN ip_proto = 17 THEN '0' END AS udp_checksum)
    FROM packets""", "packets")

QUERIES = [
    Query("packet_scan", _packet_scan, with_views("SELECT * FROM packets", "packets")),
    Query("flow_scan", _flow_scan, with_views("SELECT * FROM flows", "flows")),
    Query("flow_prepare", _flow_prepare, f"""
        SELECT {sql_epoch('l_shipdate')} AS ts, 'UDP' AS ip_proto,
               concat('10.', CAST(l_suppkey % 4 AS VARCHAR), '.', CAST(l_suppkey % 7 AS VARCHAR),
                      '.', CAST(l_suppkey % 250 AS VARCHAR)) AS ip_src,
               concat('192.0.', CAST(l_linenumber % 3 + 1 AS VARCHAR), '.7') AS ip_dst,
               CAST(1024 + l_partkey % 2000 AS INTEGER) AS sport, 53 AS dport,
               CAST(l_quantity AS BIGINT) AS pkts, CAST(floor(l_extendedprice) AS BIGINT) AS byts,
               concat('.A..S', l_linestatus) AS tcp_flg, 0 AS stos
        FROM lineitem WHERE {_OUTSIDE} AND l_linenumber % 3 > 0""".strip()),
    Query("packet_scan_pcap", lambda t: capture.packet_scan_pcap(t.spark, _captures(t)),
          _CAPTURE_SQL),
    Query("packet_scan_pcap_split", _capture_split_scan, _CAPTURE_SQL),
    Query("alert_scan", _alert_scan, with_views("SELECT * FROM alerts", "alerts")),
    Query("alert_scan_compat", lambda t: _alert_scan(t, compat=True), with_views(
        "SELECT * REPLACE (ts + 674 AS ts) FROM alerts", "alerts")),
    Query("fingerprint_scan", _fingerprint_scan, _FINGERPRINT_SQL),
    Query("conversation_scan", _conversation_scan, with_views("""
        SELECT ts, src, sport, dst, dport, 'close' AS end_state,
               concat(CAST(ts AS VARCHAR), ',', CAST(ts + 1 AS VARCHAR), ',',
                      CAST(ts + 4 AS VARCHAR)) AS timestamps, '1.25,3.5' AS intervals
        FROM http""", "http")),
    Query("http_field_scan", lambda t: http.http_field_scan(t.spark, _header_files(t), "user-agent"),
          with_views("SELECT * FROM http", "http")),
    Query("http_all_fields_scan", _all_fields, with_views("""
        SELECT ts, src, sport, dst, dport, 'GET /index HTTP/1.1' AS request,
               unnest(['host|example.org', concat('user-agent|', field)]) AS fields
        FROM http""", "http")),
    Query("http_message_split", _message_split, _SPLIT_SQL.strip()),
    Query("dns_rows", lambda t: dns.dns_rows(_dns_messages(t)),
          with_views("SELECT * FROM dns", "dns")),
    Query("dns_all_rows", lambda t: dns.dns_all_rows(_dns_messages(t)),
          with_views("""
              SELECT ts, id, CASE mode WHEN 'query' THEN 'question' ELSE mode END AS mode, name,
                     CAST(NULL AS VARCHAR) AS addr, 0::BIGINT AS ttl, '192.0.2.53' AS src_ip,
                     '192.0.2.1' AS dst_ip, 1 AS class, 1 AS type FROM dns
              UNION ALL
              SELECT ts, id, mode, name, addr, ttl, '192.0.2.53' AS src_ip, '192.0.2.1' AS dst_ip,
                     1 AS class, 1 AS type FROM dns WHERE mode = 'response'""", "dns")),
    Query("dns_packet_rows", lambda t: dns.dns_packet_rows(_dns_messages(t)), with_views("""
        SELECT ts, id, CASE mode WHEN 'query' THEN 'question' ELSE mode END AS mode, name,
               CAST(NULL AS VARCHAR) AS addr, 0::BIGINT AS ttl FROM dns
        UNION ALL
        SELECT ts, id, mode, name, addr, ttl FROM dns WHERE mode = 'response'""", "dns")),
    Query("http_file_hashes", _file_hashes, _HASH_SQL.strip()),
    Query("whois_clean", _whois_clean, _WHOIS_SQL),
    Query("csv_report_sink", _csv_report, with_views("""
        SELECT coalesce(country, 'NONE') AS country, count(*) AS sips
        FROM (SELECT DISTINCT ip_src FROM f2) LEFT JOIN asn_dim ON ip_src = ip
        GROUP BY country""", "f2", "asn_dim")),
    Query("delimited_sink", _tab_report, with_views("""
        SELECT coalesce(country, 'NONE') AS country, count(*) AS sips
        FROM (SELECT DISTINCT ip_src FROM f2) LEFT JOIN asn_dim ON ip_src = ip
        GROUP BY country""", "f2", "asn_dim")),
    Query("json_sink", _json_objects, _JSON_SQL),
    Query("external_store_sink", _external_store, with_views(f"""
        SELECT {sql_bin('ts', HOUR)} AS bin, CAST(sum(ip_total_length) AS BIGINT) AS bytes
        FROM packets GROUP BY 1""", "packets")),
    Query("ledger_sink", _ledger, with_views(f"""
        SELECT {sql_bin('ts', HOUR)} AS bin, CAST(sum(ip_total_length) AS BIGINT) AS bytes
        FROM packets GROUP BY 1""", "packets")),
    Query("connection_split", _connection_split, _SPLIT_CONNECTION_SQL),
]
