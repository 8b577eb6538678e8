"""Queries over TCP conversations, batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens import schemas
from floodlens.operators import conversations, latency
from floodlens.plans.registry import Query
from floodlens.plans.tables import Tables, sql_bin, with_views
from floodlens.session import STATE_STORE, shared_folder
from floodlens.sources import capture
from floodlens.sources.capture_stream import packet_stream_pcap
from floodlens.streaming.conversations import stream_conversations

GAP = 6 * 3600
DELAY_HOURS = 24
DAY = 86400

_CONNECTION = "a_ip, a_port, b_ip, b_port"
_NUMBERED = f"""
    numbered AS (
        SELECT *, min(ts) OVER whole AS start, arg_min(starter, ts) OVER whole AS first_starter
        FROM (
            SELECT *, sum(CASE WHEN silent > 0 OR (syn > 0 AND last_mark = 'end')
                    THEN 1 ELSE 0 END) OVER (PARTITION BY {_CONNECTION} ORDER BY ts) AS number
            FROM (
                SELECT *, last_value(mark IGNORE NULLS) OVER (
                        PARTITION BY {_CONNECTION}, stretch ORDER BY ts
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_mark
                FROM (
                    SELECT *, sum(silent) OVER (PARTITION BY {_CONNECTION} ORDER BY ts)
                            AS stretch,
                        CASE WHEN fin + rst > 0 THEN 'end' WHEN syn > 0 THEN 'open' END AS mark
                    FROM (
                        SELECT *, CASE WHEN coalesce(ts - lag(ts) OVER (
                                PARTITION BY {_CONNECTION} ORDER BY ts) > {GAP}, true)
                                THEN 1 ELSE 0 END AS silent
                        FROM per_second))))
        WINDOW whole AS (PARTITION BY {_CONNECTION}, number)),
    times AS (
        SELECT start AS ts,
            CASE WHEN first_starter % 2 = 0 THEN a_ip ELSE b_ip END AS src,
            CASE WHEN first_starter % 2 = 0 THEN a_port ELSE b_port END AS sport,
            CASE WHEN first_starter % 2 = 0 THEN b_ip ELSE a_ip END AS dst,
            CASE WHEN first_starter % 2 = 0 THEN b_port ELSE a_port END AS dport,
            ts AS second, n AS packets, fin, rst
        FROM numbered),
    built AS (
        SELECT ts, src, sport, dst, dport,
            CASE WHEN max(rst) > 0 THEN 'reset' WHEN max(fin) > 0 THEN 'close'
                 ELSE 'timeout' END AS end_state,
            max(second) AS last_ts, CAST(sum(packets) AS BIGINT) AS packets
        FROM times GROUP BY ts, src, sport, dst, dport)"""
_PER_SECOND = f"""
    per_second AS (
        SELECT {_CONNECTION}, ts, count(*) AS n, min(starter) AS starter,
            max(syn) AS syn, max(fin) AS fin, max(rst) AS rst
        FROM (
            SELECT ts, CAST(fin AS INTEGER) AS fin, CAST(rst AS INTEGER) AS rst,
                CAST(syn AS INTEGER) AS syn,
                CASE WHEN syn THEN 0 ELSE 2 END + CASE WHEN onward THEN 0 ELSE 1 END AS starter,
                CASE WHEN onward THEN ip_src ELSE ip_dst END AS a_ip,
                CASE WHEN onward THEN tcp_sport ELSE tcp_dport END AS a_port,
                CASE WHEN onward THEN ip_dst ELSE ip_src END AS b_ip,
                CASE WHEN onward THEN tcp_dport ELSE tcp_sport END AS b_port
            FROM (SELECT *, (ip_src, tcp_sport) <= (ip_dst, tcp_dport) AS onward FROM sessions
                  WHERE tcp_sport IS NOT NULL AND tcp_dport IS NOT NULL))
        GROUP BY {_CONNECTION}, ts)"""


#: Conversations with the start of the next one of the same connection.
_FOLLOWED = """
    followed AS (
        SELECT *, lead(ts) OVER (PARTITION BY
            least(struct_pack(ip := src, port := sport), struct_pack(ip := dst, port := dport)),
            greatest(struct_pack(ip := src, port := sport), struct_pack(ip := dst, port := dport))
            ORDER BY ts) AS next_ts
        FROM built)"""


def _sql(body: str, *more: str) -> str:
    """A statement over the conversations of the session packets (`built`) and `more` views."""
    views = with_views("", "sessions").strip()
    return ",".join([views, _PER_SECOND, _NUMBERED, *more]) + f"\n{body.strip()}"


def _as_text(df: DataFrame) -> DataFrame:
    def joined(column: str):
        return F.array_join(F.transform(column, lambda t: t.cast("bigint").cast("string")), ",")

    return df.withColumn("timestamps", joined("timestamps")).withColumn(
        "intervals", joined("intervals"))


def _built(t: Tables) -> DataFrame:
    return conversations.conversation_build(t.sessions, GAP)


def _times(t: Tables) -> DataFrame:
    return conversations.conversation_times(t.sessions, GAP)


def _streamed(t: Tables, delay_hours: int = DELAY_HOURS) -> DataFrame:
    """Run the stream over the event files until all are read, and read its output back."""
    spark = _stream_session(t)
    events = spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events*.parquet")
    return _run(t, t.sessions_of(events), delay_hours)


def _stream_session(t: Tables) -> SparkSession:
    spark = t.spark.newSession()  # settings of the stream stay with it
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # The state keeps the number of partitions it is started with: one per core.
    spark.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    return spark


def _streamed_captures(t: Tables) -> DataFrame:
    """The same from a folder of capture files that the executors have written."""
    capture.register_capture(t.spark)
    folder = shared_folder(t.spark, "session-captures")
    held = {f.name: f for f in t.sessions.schema.fields}
    t.sessions.where("tcp_sport is not null and tcp_dport is not null").selectExpr(*[
        f"cast({f.name if f.name in held else 'null'} as {f.dataType.simpleString()}) as {f.name}"
        for f in schemas.PACKETS.fields]).write.format("capture").mode("append").save(folder)
    packets = packet_stream_pcap(
        _stream_session(t), folder, shared_folder(t.spark, "session-capture-log"), columns=[
            "ts", "ip_proto", "ip_src", "ip_dst", "tcp_sport", "tcp_dport",
            *[f"tcp_{flag}" for flag in ("syn", "ack", "fin", "rst")]])
    return _run(t, packets, DELAY_HOURS)


def _run(t: Tables, packets: DataFrame, delay_hours: int) -> DataFrame:
    out = shared_folder(t.spark, "stream-conversations")
    stream = stream_conversations(packets, f"{delay_hours} hours", GAP)
    query = (
        stream.writeStream.format("parquet").option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint").start()
    )
    try:
        query.processAllAvailable()  # up to the batch without data that the last watermark opens
    finally:
        query.stop()
    return t.spark.read.schema(stream.schema).parquet(f"{out}/rows")


_HEADER = "ts, src, sport, dst, dport"
_WATERMARK = f"(SELECT max(ts) - {DELAY_HOURS * 3600} FROM sessions)"
_LISTS = f"""
    SELECT {_HEADER},
        string_agg(rtrim(repeat(CAST(second AS VARCHAR) || ',', CAST(packets AS INTEGER)), ','),
            ',' ORDER BY second) AS timestamps,
        regexp_replace(string_agg(rtrim(repeat(CAST(second - ts AS VARCHAR) || ',',
            CAST(packets AS INTEGER)), ','), ',' ORDER BY second), '^0,?', '') AS intervals
    FROM times GROUP BY {_HEADER}"""
_LATENCY = f"""
    SELECT CAST(i AS BIGINT) * 1000 AS interval_ms, count(*) AS count
    FROM (SELECT unnest(string_split(intervals, ',')) AS i FROM ({_LISTS}))
    WHERE i <> '' GROUP BY 1"""

_STREAM_SQL = _sql(f"""
    SELECT {_HEADER}, second, packets, NULL::VARCHAR AS end_state, NULL::BIGINT AS last_ts
    FROM times WHERE second < {_WATERMARK}
    UNION ALL
    SELECT {_HEADER}, NULL, packets, end_state, last_ts FROM followed
    WHERE last_ts + {GAP} < {_WATERMARK} OR next_ts < {_WATERMARK}""", _FOLLOWED)

#: Every packet with its time and the first one of its conversation, in microseconds.
_MICROS = f"""
    packet_micros AS (
        SELECT n.*, ts_micros, min(ts_micros) OVER (PARTITION BY {_CONNECTION}, number) AS begun
        FROM (SELECT {_CONNECTION}, number, first_starter, start, ts, fin, rst FROM numbered) n
        JOIN (SELECT *, CASE WHEN onward THEN ip_src ELSE ip_dst END AS a_ip,
                  CASE WHEN onward THEN tcp_sport ELSE tcp_dport END AS a_port,
                  CASE WHEN onward THEN ip_dst ELSE ip_src END AS b_ip,
                  CASE WHEN onward THEN tcp_dport ELSE tcp_sport END AS b_port
              FROM (SELECT ip_src, ip_dst, tcp_sport, tcp_dport, ts, ts_micros,
                        (ip_src, tcp_sport) <= (ip_dst, tcp_dport) AS onward FROM sessions
                    WHERE tcp_sport IS NOT NULL AND tcp_dport IS NOT NULL)) p
        USING ({_CONNECTION}, ts)),
    offsets AS (
        SELECT ts_micros - begun AS micros FROM packet_micros
        QUALIFY row_number() OVER (PARTITION BY {_CONNECTION}, number ORDER BY ts_micros) > 1)"""
_BUCKET = f"""CASE WHEN micros < {1 << latency.SUB_BITS} THEN micros ELSE
    (floor(log2(micros)) - {latency.SUB_BITS} << {latency.SUB_BITS})
    + (micros >> (floor(log2(micros)) - {latency.SUB_BITS})) END"""
_BUCKET = _BUCKET.replace("floor(log2(micros))", "CAST(length(ltrim(bin(micros), '0')) - 1 AS BIGINT)")

QUERIES = [
    Query("conversation_build_micros",
          lambda t: latency.conversation_build_micros(t.micro_sessions, GAP),
          _sql("""
              SELECT min(ts_micros) AS ts_micros,
                  CASE WHEN any_value(first_starter) % 2 = 0 THEN a_ip ELSE b_ip END AS src,
                  CASE WHEN any_value(first_starter) % 2 = 0 THEN a_port ELSE b_port END AS sport,
                  CASE WHEN any_value(first_starter) % 2 = 0 THEN b_ip ELSE a_ip END AS dst,
                  CASE WHEN any_value(first_starter) % 2 = 0 THEN b_port ELSE a_port END AS dport,
                  CASE WHEN max(rst) > 0 THEN 'reset' WHEN max(fin) > 0 THEN 'close'
                      ELSE 'timeout' END AS end_state,
                  max(ts_micros) AS last_micros, count(*) AS packets
              FROM packet_micros GROUP BY a_ip, a_port, b_ip, b_port, number""", _MICROS)),
    Query("latency_histogram_micros",
          lambda t: latency.latency_histogram_micros(t.micro_sessions, GAP),
          _sql("""SELECT CAST(micros // 1000 AS BIGINT) AS interval_ms, count(*) AS count
                  FROM offsets GROUP BY 1""", _MICROS)),
    Query("latency_buckets",
          lambda t: latency.latency_buckets(t.micro_sessions, GAP).drop("from_micros"),
          _sql(f"""SELECT CAST({_BUCKET} AS BIGINT) AS bucket, count(*) AS count
                   FROM offsets GROUP BY 1""", _MICROS)),
    Query("conversation_build", _built,
          _sql(f"SELECT {_HEADER}, end_state, last_ts, packets FROM built")),
    Query("conversation_times", _times, _sql(f"SELECT {_HEADER}, second, packets FROM times")),
    Query("conversation_lists",
          lambda t: _as_text(conversations.conversation_lists(_times(t))), _sql(_LISTS)),
    Query("stream_conversations", _streamed, _STREAM_SQL),
    Query("stream_conversations_captures", _streamed_captures, _STREAM_SQL),
    Query("conversation_volume",
          lambda t: conversations.conversation_volume(_built(t), t.sessions, DAY),
          _sql(f"""
              SELECT CAST(sum(ip_total_length) AS BIGINT) AS bytes
              FROM built b JOIN sessions p ON {sql_bin('b.ts', DAY)} = {sql_bin('p.ts', DAY)}
                  AND src = ip_src AND sport = tcp_sport AND dst = ip_dst AND dport = tcp_dport
              GROUP BY src, sport, dst, dport""")),
    Query("latency_histogram",
          lambda t: conversations.latency_histogram_of_times(_times(t)), _sql(_LATENCY)),
    Query("latency_histogram_lists", lambda t: conversations.latency_histogram(
        conversations.conversation_lists(_times(t))), _sql(_LATENCY)),
]
