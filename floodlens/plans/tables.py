"""Traffic relations as views over the driver tables, in Spark and as SQL for the check.

The driver tables hold no traffic, so packets, flows and the other relations are derived from
them by fixed expressions; both engines give the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens import schemas
from floodlens.operators import attack, geo

CHART = ["AU", "CN", "DE", "JP", "NL", "KR", "NZ", "US", "FR", "BR"]
PAYLOAD_PORTS = [22, 25, 80, 443]
PIECE_BYTES = 1400  # of a payload in a packet
PROTOCOLS = [(6, "TCP"), (6, "TCP-ALT"), (17, "UDP")]
PORTS = [(22, "SSH"), (53, "DNS"), (80, "HTTP"), (443, "HTTPS"), (1024, "Reserved"),
         (1055, "ANSYS-LM"), (2048, "DLS-Monitor"), (3128, "Proxy")]


def epoch(c: str) -> str:
    return (f"cast(datediff({c}, DATE'1970-01-01') as bigint) * 86400 + hour({c}) * 3600 "
            f"+ minute({c}) * 60 + second({c})")


def ip(k: str) -> str:
    return (f"concat('10.', cast({k} % 4 as string), '.', cast({k} % 7 as string), '.', "
            f"cast({k} % 250 as string))")


_SPORT = "cast(1024 + (event_id * 31) % 4000 as int)"
_DPORT = ("cast(case when event_id % 4 = 0 then 80 when event_id % 4 = 1 then 53 "
          "else 1 + event_id % 443 end as int)")
_DST = ("concat('192.0.2.', cast(case when event_id % 3 = 0 then event_id % 5 else 1 end "
        "as string))")
_PROTO = ("case when event_type = 'error' then 1 when event_type in ('click', 'view') then 17 "
          "when event_type in ('purchase', 'signup') then 6 end")


class Tables:
    """The relations, read lazily from one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @staticmethod
    def packets_of(events: DataFrame) -> DataFrame:
        base = events.selectExpr(
            "*", f"{epoch('ts')} as t", f"{_PROTO} as proto",
            "20 + cast(floor(value * 10) as bigint) % 1480 as size")
        tcp_zero = "cast(case when proto = 6 then 0 end as {})"
        columns = {
            "ts": "t", "ip_version": "4", "ip_header_length": "5", "ip_tos": "0",
            "ip_total_length": "cast(size as int)",
            "ip_id": "cast(event_id % 65536 as int)", "ip_flags": "cast(null as int)",
            "ip_more_fragments": "case when event_id % 7 = 0 then 1 else 0 end",
            "ip_ttl": "cast(40 + user_id % 25 as int)", "ip_proto": "proto",
            "ip_checksum": "0", "ip_src": ip("user_id"), "ip_dst": _DST,
            "tcp_sport": f"case when proto = 6 then {_SPORT} end",
            "tcp_dport": f"case when proto = 6 then {_DPORT} end",
            "tcp_syn": "case when proto = 6 then if(event_id % 2 = 0, 1, 0) end",
            "tcp_ack": "case when proto = 6 then if(event_id % 5 = 0, 1, 0) end",
            "tcp_len": "case when proto = 6 then cast(greatest(size - 40, 0) as int) end",
            "udp_sport": f"case when proto = 17 then {_SPORT} end",
            "udp_dport": f"case when proto = 17 then {_DPORT} end",
            "udp_len": "case when proto = 17 then cast(greatest(size - 20, 8) as int) end",
            "udp_checksum": "cast(null as string)",
        }
        return base.selectExpr(*[
            f"{columns.get(f.name, tcp_zero.format(f.dataType.simpleString()))} as {f.name}"
            for f in schemas.PACKETS.fields
        ])

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def packets(self) -> DataFrame:
        return self.packets_of(self.events)

    @cached_property
    def capture_packets(self) -> DataFrame:
        """The packets dealt to five captures, one of them without TCP."""
        return self.packets.withColumn("capture", F.concat(
            F.lit("capture-"), (F.col("ip_id") % 5).cast("string"), F.lit(".pcap"))).where(
            "not (ip_id % 5 = 4 and ip_proto <=> 6)")

    @cached_property
    def legacy_packets(self) -> DataFrame:
        """Packets of the earlier layout, with the fragment offset."""
        return self.packets.withColumn(
            "ip_frag_offset", F.when(F.col("ip_id") % 9 == 0, 185).otherwise(0))

    @staticmethod
    def sessions_of(events: DataFrame, *more: str) -> DataFrame:
        """TCP packets of few connections, both directions, with opening and ending flags; some
        are later fragments without ports."""
        one = "concat('10.9.', cast(user_id % 5 as string), '.', cast(user_id % 20 as string))"
        port = "cast(1024 + user_id % 3 as int)"
        back = "event_id % 3 = 1"
        whole = "event_id % 97 <> 5"
        return events.selectExpr(
            f"{epoch('ts')} as ts", "6 as ip_proto",
            f"case when {back} then '192.0.2.9' else {one} end as ip_src",
            f"case when {back} then {one} else '192.0.2.9' end as ip_dst",
            f"case when {whole} then case when {back} then 80 else {port} end end as tcp_sport",
            f"case when {whole} then case when {back} then {port} else 80 end end as tcp_dport",
            "if(event_id % 6 = 0, 1, 0) as tcp_syn", "if(event_id % 4 = 3, 1, 0) as tcp_ack",
            "if(event_id % 10 = 5, 1, 0) as tcp_fin", "if(event_id % 50 = 7, 1, 0) as tcp_rst",
            "cast(20 + event_id % 1000 as int) as ip_total_length", *more,
        )

    @cached_property
    def sessions(self) -> DataFrame:
        return self.sessions_of(self.events)

    @cached_property
    def micro_sessions(self) -> DataFrame:
        """The session packets with fractions of seconds; some have none."""
        held = self.sessions_of(self.events, "event_id")
        return held.withColumn("ts_micros", F.expr(
            "case when event_id % 13 <> 4 then ts * 1000000 + event_id * 7919 % 1000000 end"
        )).drop("event_id")

    @cached_property
    def flows(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            f"{epoch('l_shipdate')} as ts",
            "case l_returnflag when 'A' then 'TCP' when 'R' then 'UDP' else 'ICMP' end "
            "as ip_proto",
            f"{ip('l_suppkey')} as ip_src",
            "concat('192.0.2.', cast(case when l_orderkey % 3 = 0 then l_linenumber else 1 end "
            "as string)) as ip_dst",
            "cast(1024 + l_partkey % 2000 as int) as sport",
            "case when l_linenumber % 2 = 0 then 80 else 53 end as dport",
            "cast(l_quantity as bigint) as pkts",
            "cast(floor(l_extendedprice) as bigint) as byts",
            "concat('.A..', l_linestatus, 'F') as tcp_flg",
            "0 as stos",
        )

    def _endpoint_rows(self, where: str, *columns: str) -> DataFrame:
        return self.events.filter(where).selectExpr(
            f"{epoch('ts')} as ts", f"{ip('user_id')} as src", f"{_SPORT} as sport",
            f"{_DST} as dst", f"{_DPORT} as dport", *columns)

    @cached_property
    def alerts(self) -> DataFrame:
        return self._endpoint_rows(
            "event_type = 'error'",
            "concat('1_', cast(event_id % 20 as string)) as sig",
            "cast(1 + event_id % 3 as int) as priority",
            "concat('rule ', cast(event_id % 20 as string)) as message",
            "case when event_id % 2 = 0 then 'TCP' else 'UDP' end as proto",
        ).select(*schemas.ALERTS.names)

    @cached_property
    def fingerprint_events(self) -> DataFrame:
        return self._endpoint_rows(
            "true", "concat('os-', cast(user_id % 5 as string)) as os", "event_id")

    @cached_property
    def fingerprints(self) -> DataFrame:
        return self.fingerprint_events.drop("event_id")

    @cached_property
    def http(self) -> DataFrame:
        return self._endpoint_rows(
            "event_type in ('error', 'view')",
            "concat('agent-', cast(user_id % 8 as string)) as field")

    @cached_property
    def dns(self) -> DataFrame:
        return self.events.selectExpr(
            f"{epoch('ts')} as ts", "event_id % 65536 as id",
            "case when event_id % 2 = 0 then 'query' else 'response' end as mode",
            "concat('host', cast(user_id % 40 as string), '.example') as name",
            f"case when event_id % 2 = 1 then {ip('user_id')} end as addr",
            "case when event_id % 2 = 1 then 60 * (event_id % 5) else 0 end as ttl")

    @cached_property
    def prefix_dim(self) -> DataFrame:
        k = "n_nationkey"
        return self.table("nation").selectExpr(
            f"cast(64500 + {k} % 9 as string) as asn",
            f"concat('10.', cast({k} % 4 as string), '.', cast({k} % 7 as string), '.0/24') "
            "as bgp_prefix",
            f"case when {k} % 6 <> 5 then concat('C', cast({k} % 6 as string)) end as country",
            "n_name as as_info")

    @cached_property
    def asn_dim(self) -> DataFrame:
        """The prefixes looked up for every packet source."""
        return geo.asn_enrich(attack.attack_sources(self.packets), self.prefix_dim)

    @cached_property
    def flow_asn_dim(self) -> DataFrame:
        sources = self.flows.select("ip_src").distinct()
        return geo.asn_enrich(sources, self.prefix_dim)

    @cached_property
    def geo_dim(self) -> DataFrame:
        k = "n_nationkey"
        start = f"cast(10 as bigint) * 16777216 + ({k} % 4) * 65536 + ({k} % 7) * 256"
        countries = ", ".join(f"'{c}'" for c in CHART)
        return self.table("nation").selectExpr(
            f"{start} as range_start", f"{start} + 255 as range_end",
            f"element_at(array({countries}), {k} % 10 + 1) as country",
            f"case when {k} % 7 <> 3 then concat(n_name, ' City') end as city",
            f"cast({k} as double) * 1.5 - 20.25 as lat",
            f"100.25D - cast({k} as double) * 2.5 as lon",
            f"concat('AS', cast(64500 + {k} % 9 as string), ' ', n_name) as asnum")

    @cached_property
    def ip_proto_dim(self) -> DataFrame:
        return self.spark.createDataFrame(PROTOCOLS, schemas.PROTOCOL_DIM)

    @cached_property
    def port_dim(self) -> DataFrame:
        return self.spark.createDataFrame(PORTS, schemas.PORT_DIM)

    @cached_property
    def payloads(self) -> DataFrame:
        """Document texts as payloads of TCP and UDP packets."""
        ports = ", ".join(map(str, PAYLOAD_PORTS))
        return self.table("documents").selectExpr(
            "doc_id", "text",
            "case when doc_id % 2 = 0 then cast(1024 + doc_id % 1000 as int) end as tcp_sport",
            f"case when doc_id % 2 = 0 then element_at(array({ports}), "
            "cast(doc_id % 8 div 2 as int) + 1) end as tcp_dport",
            "case when doc_id % 2 = 1 then if(doc_id % 4 = 1, 53, 5353) end as udp_sport",
            "case when doc_id % 2 = 1 then cast(2000 + doc_id % 1000 as int) end as udp_dport")

    @cached_property
    def payload_packets(self) -> DataFrame:
        """The payloads in pieces that fit a packet, as TCP and UDP packets with all columns of a
        capture that the pieces decide on."""
        size = PIECE_BYTES
        pieces = self.payloads.withColumn("body", F.col("text").cast("binary")).withColumn(
            "piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(
                (F.octet_length("body") - 1) / size).cast("int")))))
        held = pieces.withColumn("payload", F.substring(
            "body", F.col("piece") * size + 1, F.lit(size)))
        known = {
            "ts": "doc_id", "ip_proto": "if(tcp_sport is null, 17, 6)", "ip_version": "4",
            "ip_header_length": "5", "ip_src": ip("doc_id"), "ip_dst": "'192.0.2.1'",
            "ip_total_length": "cast(octet_length(payload) as int) + if(tcp_sport is null, 28, 40)",
            "tcp_sport": "tcp_sport", "tcp_dport": "tcp_dport", "tcp_offset": "5",
            "udp_sport": "udp_sport", "udp_dport": "udp_dport",
        }
        return held.selectExpr(*[
            f"cast({known.get(f.name, 'null')} as {f.dataType.simpleString()}) as {f.name}"
            for f in schemas.PACKETS.fields], "payload")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 9 digits, standard deviations to 6, so that both engines agree."""
    def column(name: str, kind: str) -> Column:
        if kind == "double":
            return F.round(name, 6 if "std" in name else 9).alias(name)
        return F.col(name)

    return df.select(*[column(n, k) for n, k in df.dtypes])


# The same relations for DuckDB. ---------------------------------------------------------------

def sql_epoch(c: str) -> str:
    return (f"CAST(date_diff('day', DATE '1970-01-01', CAST({c} AS DATE)) * 86400 "
            f"+ hour({c}) * 3600 + minute({c}) * 60 + second({c}) AS BIGINT)")


def sql_ip(k: str) -> str:
    return (f"concat('10.', CAST({k} % 4 AS VARCHAR), '.', CAST({k} % 7 AS VARCHAR), '.', "
            f"CAST({k} % 250 AS VARCHAR))")


def sql_bin(c: str, size: int) -> str:
    return f"({c} - {c} % {size})"


_SQL_SPORT = "CAST(1024 + (event_id * 31) % 4000 AS INTEGER)"
_SQL_DPORT = ("CAST(CASE WHEN event_id % 4 = 0 THEN 80 WHEN event_id % 4 = 1 THEN 53 "
              "ELSE 1 + event_id % 443 END AS INTEGER)")
_SQL_DST = ("concat('192.0.2.', CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 5 ELSE 1 END "
            "AS VARCHAR))")
_ENDPOINTS = (f"{sql_epoch('ts')} AS ts, {sql_ip('user_id')} AS src, {_SQL_SPORT} AS sport, "
              f"{_SQL_DST} AS dst, {_SQL_DPORT} AS dport")


def _sql_packets() -> str:
    columns = {
        "ts": "t", "ip_version": "4", "ip_header_length": "5", "ip_tos": "0",
        "ip_total_length": "CAST(size AS INTEGER)",
        "ip_id": "CAST(event_id % 65536 AS INTEGER)", "ip_flags": "CAST(NULL AS INTEGER)",
        "ip_more_fragments": "CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END",
        "ip_ttl": "CAST(40 + user_id % 25 AS INTEGER)", "ip_proto": "proto",
        "ip_checksum": "0", "ip_src": sql_ip("user_id"), "ip_dst": _SQL_DST,
        "tcp_sport": f"CASE WHEN proto = 6 THEN {_SQL_SPORT} END",
        "tcp_dport": f"CASE WHEN proto = 6 THEN {_SQL_DPORT} END",
        "tcp_syn": "CASE WHEN proto = 6 THEN CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END END",
        "tcp_ack": "CASE WHEN proto = 6 THEN CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END END",
        "tcp_len": "CASE WHEN proto = 6 THEN CAST(greatest(size - 40, 0) AS INTEGER) END",
        "udp_sport": f"CASE WHEN proto = 17 THEN {_SQL_SPORT} END",
        "udp_dport": f"CASE WHEN proto = 17 THEN {_SQL_DPORT} END",
        "udp_len": "CASE WHEN proto = 17 THEN CAST(greatest(size - 20, 8) AS INTEGER) END",
        "udp_checksum": "CAST(NULL AS VARCHAR)",
    }
    kinds = {"int": "INTEGER", "bigint": "BIGINT"}
    selected = ", ".join(
        columns.get(f.name, "CAST(CASE WHEN proto = 6 THEN 0 END AS "
                    f"{kinds.get(f.dataType.simpleString(), 'VARCHAR')})") + f" AS {f.name}"
        for f in schemas.PACKETS.fields)
    return f"""SELECT {selected} FROM (
        SELECT *, {sql_epoch('ts')} AS t,
            CASE WHEN event_type = 'error' THEN 1 WHEN event_type IN ('click', 'view') THEN 17
                 WHEN event_type IN ('purchase', 'signup') THEN 6 END AS proto,
            20 + CAST(floor(value * 10) AS BIGINT) % 1480 AS size
        FROM events)"""


def _values(rows: list[tuple], number: str, text: str) -> str:
    listed = ", ".join(f"({n}, '{d}')" for n, d in rows)
    return f"SELECT * FROM (VALUES {listed}) AS d({number}, {text})"


_K = "n_nationkey"
_START = f"(10::BIGINT * 16777216 + ({_K} % 4) * 65536 + ({_K} % 7) * 256)"
_SESSION_IP = "concat('10.9.', CAST(user_id % 5 AS VARCHAR), '.', CAST(user_id % 20 AS VARCHAR))"
_SESSION_PORT = "CAST(1024 + user_id % 3 AS INTEGER)"

VIEWS = {
    "packets": _sql_packets(),
    "f1": """SELECT * FROM packets WHERE ip_dst = (
        SELECT ip_dst FROM packets GROUP BY ip_dst ORDER BY count(ts) DESC, ip_dst LIMIT 1)""",
    "f2": """SELECT * FROM f1 WHERE ip_proto = (
        SELECT ip_proto FROM f1 GROUP BY ip_proto ORDER BY count(ts) DESC, ip_proto LIMIT 1)""",
    "capture_packets": """SELECT *, concat('capture-', CAST(ip_id % 5 AS VARCHAR), '.pcap') AS capture
        FROM packets WHERE NOT (ip_id % 5 = 4 AND ip_proto IS NOT DISTINCT FROM 6)""",
    "sessions": f"""SELECT {sql_epoch('ts')} AS ts,
        CASE WHEN event_id % 3 = 1 THEN '192.0.2.9' ELSE {_SESSION_IP} END AS ip_src,
        CASE WHEN event_id % 3 = 1 THEN {_SESSION_IP} ELSE '192.0.2.9' END AS ip_dst,
        CASE WHEN event_id % 97 <> 5 THEN
            CASE WHEN event_id % 3 = 1 THEN 80 ELSE {_SESSION_PORT} END END AS tcp_sport,
        CASE WHEN event_id % 97 <> 5 THEN
            CASE WHEN event_id % 3 = 1 THEN {_SESSION_PORT} ELSE 80 END END AS tcp_dport,
        event_id % 6 = 0 AND event_id % 4 <> 3 AS syn, event_id % 10 = 5 AS fin,
        event_id % 50 = 7 AS rst, CAST(20 + event_id % 1000 AS INTEGER) AS ip_total_length,
        {sql_epoch('ts')} * 1000000 + CASE WHEN event_id % 13 <> 4
            THEN event_id * 7919 % 1000000 ELSE 0 END AS ts_micros
        FROM events""",
    "flows": f"""SELECT {sql_epoch('l_shipdate')} AS ts,
        CASE l_returnflag WHEN 'A' THEN 'TCP' WHEN 'R' THEN 'UDP' ELSE 'ICMP' END AS ip_proto,
        {sql_ip('l_suppkey')} AS ip_src,
        concat('192.0.2.', CAST(CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber ELSE 1 END
            AS VARCHAR)) AS ip_dst,
        CAST(1024 + l_partkey % 2000 AS INTEGER) AS sport,
        CASE WHEN l_linenumber % 2 = 0 THEN 80 ELSE 53 END AS dport,
        CAST(l_quantity AS BIGINT) AS pkts, CAST(floor(l_extendedprice) AS BIGINT) AS byts,
        concat('.A..', l_linestatus, 'F') AS tcp_flg, 0 AS stos FROM lineitem""",
    "w1": """SELECT * FROM flows WHERE ip_dst = (
        SELECT ip_dst FROM flows GROUP BY ip_dst ORDER BY sum(pkts) DESC, ip_dst LIMIT 1)""",
    "w2": """SELECT * FROM w1 WHERE ip_proto = (
        SELECT ip_proto FROM w1 GROUP BY ip_proto ORDER BY count(ts) DESC, ip_proto LIMIT 1)""",
    "alerts": f"""SELECT {_ENDPOINTS}, concat('1_', CAST(event_id % 20 AS VARCHAR)) AS sig,
        CAST(1 + event_id % 3 AS INTEGER) AS priority,
        concat('rule ', CAST(event_id % 20 AS VARCHAR)) AS message,
        CASE WHEN event_id % 2 = 0 THEN 'TCP' ELSE 'UDP' END AS proto
        FROM events WHERE event_type = 'error'""",
    "fingerprints": f"""SELECT {_ENDPOINTS}, event_id,
        concat('os-', CAST(user_id % 5 AS VARCHAR)) AS os FROM events""",
    "http": f"""SELECT {_ENDPOINTS}, concat('agent-', CAST(user_id % 8 AS VARCHAR)) AS field
        FROM events WHERE event_type IN ('error', 'view')""",
    "dns": f"""SELECT {sql_epoch('ts')} AS ts, event_id % 65536 AS id,
        CASE WHEN event_id % 2 = 0 THEN 'query' ELSE 'response' END AS mode,
        concat('host', CAST(user_id % 40 AS VARCHAR), '.example') AS name,
        CASE WHEN event_id % 2 = 1 THEN {sql_ip('user_id')} END AS addr,
        CASE WHEN event_id % 2 = 1 THEN 60 * (event_id % 5) ELSE 0 END AS ttl FROM events""",
    "prefix_dim": f"""SELECT CAST(64500 + {_K} % 9 AS VARCHAR) AS asn,
        concat('10.', CAST({_K} % 4 AS VARCHAR), '.', CAST({_K} % 7 AS VARCHAR), '.0/24')
            AS bgp_prefix,
        CASE WHEN {_K} % 6 <> 5 THEN concat('C', CAST({_K} % 6 AS VARCHAR)) END AS country,
        n_name AS as_info FROM nation""",
    "asn_dim": """SELECT CASE WHEN bgp_prefix IS NULL THEN 'NA' ELSE asn END AS asn, ip,
        coalesce(bgp_prefix, 'NA') AS bgp_prefix,
        country,
        CASE WHEN bgp_prefix IS NULL THEN 'NA' ELSE as_info END AS as_info
        FROM (SELECT DISTINCT ip_src AS ip FROM f2) LEFT JOIN prefix_dim
            ON split_part(bgp_prefix, '.', 2) = split_part(ip, '.', 2)
            AND split_part(bgp_prefix, '.', 3) = split_part(ip, '.', 3)""",
    "geo_dim": f"""SELECT {_START} AS range_start, {_START} + 255 AS range_end,
        [{", ".join(f"'{c}'" for c in CHART)}][{_K} % 10 + 1] AS country,
        CASE WHEN {_K} % 7 <> 3 THEN concat(n_name, ' City') END AS city,
        {_K}::DOUBLE * 1.5::DOUBLE - 20.25::DOUBLE AS lat,
        100.25::DOUBLE - {_K}::DOUBLE * 2.5::DOUBLE AS lon,
        concat('AS', CAST(64500 + {_K} % 9 AS VARCHAR), ' ', n_name) AS asnum FROM nation""",
    "ip_proto_dim": _values(PROTOCOLS, "ip_proto_number", "ip_proto_desc"),
    "port_dim": _values(PORTS, "port_number", "port_desc"),
    "payloads": f"""SELECT doc_id, text,
        CASE WHEN doc_id % 2 = 0 THEN CAST(1024 + doc_id % 1000 AS INTEGER) END AS tcp_sport,
        CASE WHEN doc_id % 2 = 0 THEN {PAYLOAD_PORTS}[(doc_id % 8) // 2 + 1] END AS tcp_dport,
        CASE WHEN doc_id % 2 = 1 THEN CASE WHEN doc_id % 4 = 1 THEN 53 ELSE 5353 END END
            AS udp_sport,
        CASE WHEN doc_id % 2 = 1 THEN CAST(2000 + doc_id % 1000 AS INTEGER) END AS udp_dport
        FROM documents""",
    # Every byte of every payload with its position from 1.
    "payload_bytes": """SELECT doc_id, tcp_sport, tcp_dport, udp_sport, udp_dport, pos, size,
        CAST((strpos('0123456789ABCDEF', substr(pair, 1, 1)) - 1) * 16
            + strpos('0123456789ABCDEF', substr(pair, 2, 1)) - 1 AS BIGINT) AS byte
        FROM (SELECT * EXCLUDE (text, pairs), unnest(pairs) AS pair,
                generate_subscripts(pairs, 1) AS pos, len(pairs) AS size
              FROM (SELECT *, regexp_extract_all(hex(encode(text)), '..') AS pairs
                    FROM payloads))""",
}
VIEWS["piece_bytes"] = f"""SELECT * EXCLUDE (pos, size), (pos - 1) // {PIECE_BYTES} AS piece,
    (pos - 1) % {PIECE_BYTES} + 1 AS pos,
    least({PIECE_BYTES}, size - (pos - 1) // {PIECE_BYTES} * {PIECE_BYTES}) AS size
    FROM payload_bytes"""
_NEEDS = {
    "piece_bytes": ["payload_bytes"],
    "capture_packets": ["packets"],
    "f1": ["packets"], "f2": ["f1"], "w1": ["flows"], "w2": ["w1"],
    "asn_dim": ["f2", "prefix_dim"], "payload_bytes": ["payloads"],
}


def with_views(body: str, *names: str) -> str:
    """A statement with the named views, and the ones they need, in front."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    return f"WITH {views}\n{body.strip()}" if views else body.strip()


def sql_long(ip_column: str) -> str:
    """Number of a dotted address."""
    parts = [f"CAST(split_part({ip_column}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}"
             for i in range(4)]
    return "(" + " + ".join(parts) + ")"
