"""TCP conversations: built from packets, and queries over them.

A conversation holds the packets of one connection, in both directions. It ends when the
connection is silent for longer than the gap, or when a connection that was closed or reset is
opened anew. Its endpoints are named from the side that opened it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodlens.functions.rates import time_bin

CONNECTION = ["a_ip", "a_port", "b_ip", "b_port"]
ENDPOINTS = ["src", "sport", "dst", "dport"]
HEADER = ["ts", *ENDPOINTS]


def connection_packets(packets: DataFrame, *more: Column) -> DataFrame:
    """TCP packets by direction-independent connection, with what decides conversations, and
    `more` columns.

    Packets without ports (later fragments, short captures) belong to no connection.
    `starter` is smallest for the packet that names the endpoints: an opening packet before
    others, then the direction from the smaller endpoint before the other.
    """
    one = F.struct(F.col("ip_src").alias("ip"), F.col("tcp_sport").alias("port"))
    two = F.struct(F.col("ip_dst").alias("ip"), F.col("tcp_dport").alias("port"))
    a, b = F.least(one, two), F.greatest(one, two)

    def flag(name: str) -> Column:
        return F.coalesce(F.col(f"tcp_{name}"), F.lit(0)) > 0

    syn = flag("syn") & ~flag("ack")
    starter = F.when(syn, 0).otherwise(2) + F.when(one <= two, 0).otherwise(1)
    held = ((F.col("ip_proto") == 6) & F.col("ts").isNotNull()
            & F.col("tcp_sport").isNotNull() & F.col("tcp_dport").isNotNull())
    return packets.filter(held).select(
        a["ip"].alias("a_ip"), a["port"].alias("a_port"),
        b["ip"].alias("b_ip"), b["port"].alias("b_port"),
        "ts", starter.alias("starter"), syn.cast("int").alias("syn"),
        flag("fin").cast("int").alias("fin"), flag("rst").cast("int").alias("rst"), *more)


def per_second(rows: DataFrame) -> DataFrame:
    """Packets per (connection, second): combined before the shuffle, so that a connection is
    never more rows than seconds, however many packets it has."""
    return rows.groupBy(*CONNECTION, "ts").agg(
        F.count("*").alias("n"),
        F.min("starter").alias("starter"),
        F.max("syn").alias("syn"), F.max("fin").alias("fin"), F.max("rst").alias("rst"))


def _numbered(packets: DataFrame, gap_s: int) -> DataFrame:
    """Packets per (connection, second) with the `number` of their conversation."""
    return number_conversations(per_second(connection_packets(packets)), gap_s)


def number_conversations(seconds: DataFrame, gap_s: int) -> DataFrame:
    """Rows of connections and seconds with the `number` of their conversation."""
    connection = Window.partitionBy(*CONNECTION).orderBy("ts")
    silent = F.coalesce(F.col("ts") - F.lag("ts").over(connection) > gap_s, F.lit(True))
    seconds = seconds.withColumn("silent", silent.cast("int"))
    seconds = seconds.withColumn("stretch", F.sum("silent").over(connection))

    before_in_stretch = (
        Window.partitionBy(*CONNECTION, "stretch").orderBy("ts")
        .rowsBetween(Window.unboundedPreceding, -1))
    ended = (F.col("fin") + F.col("rst")) > 0
    mark = F.when(ended, "end").when(F.col("syn") > 0, "open")
    reopened = (F.col("syn") > 0) & (
        F.last(mark, ignorenulls=True).over(before_in_stretch) == "end")
    seconds = seconds.withColumn(
        "begins", ((F.col("silent") > 0) | F.coalesce(reopened, F.lit(False))).cast("int"))
    return seconds.withColumn("number", F.sum("begins").over(connection))


def named_endpoints(starter: str) -> list[Column]:
    """Endpoints, from the side that sent the packet `starter` tells of."""
    from_a = F.col(starter) % 2 == 0
    pairs = {"src": ("a_ip", "b_ip"), "sport": ("a_port", "b_port"),
             "dst": ("b_ip", "a_ip"), "dport": ("b_port", "a_port")}
    return [F.when(from_a, F.col(one)).otherwise(F.col(two)).alias(name)
            for name, (one, two) in pairs.items()]


def conversation_build(packets: DataFrame, gap_s: int = 60) -> DataFrame:
    """One row per conversation: start (`ts`), endpoints, end state (close, reset or timeout),
    last second and number of packets."""
    held = _numbered(packets, gap_s).groupBy(*CONNECTION, "number").agg(
        F.min("ts").alias("ts"), F.max("ts").alias("last_ts"), F.sum("n").alias("packets"),
        F.min_by("starter", "ts").alias("starter"),
        F.max("rst").alias("rst"), F.max("fin").alias("fin"))
    state = F.when(F.col("rst") > 0, "reset").when(F.col("fin") > 0, "close").otherwise("timeout")
    return held.select("ts", *named_endpoints("starter"), state.alias("end_state"), "last_ts", "packets")


def conversation_times(packets: DataFrame, gap_s: int = 60) -> DataFrame:
    """Packet times of the conversations: their start and endpoints, each second with packets, and
    how many it has."""
    ordered = Window.partitionBy(*CONNECTION, "number").orderBy("ts")
    return (
        _numbered(packets, gap_s)
        .withColumn("start", F.first("ts").over(ordered))
        .withColumn("first_starter", F.first("starter").over(ordered))
        .select(F.col("start").alias("ts"), *named_endpoints("first_starter"),
                F.col("ts").alias("second"), F.col("n").alias("packets"))
    )


def conversation_lists(times: DataFrame) -> DataFrame:
    """`conversation_times` as one row per conversation: its packet times, and their offsets from
    the first packet. Only for conversations whose packet times fit a row."""
    held = times.groupBy(*HEADER).agg(F.sort_array(F.collect_list(
        F.struct("second", F.col("packets").cast("int").alias("packets")))).alias("seconds"))
    stamps = F.flatten(F.transform(
        "seconds", lambda s: F.array_repeat(s["second"], s["packets"])))
    offsets = F.transform("timestamps", lambda t: (t - F.col("ts")).cast("double"))
    return held.withColumn("timestamps", stamps).select(
        *HEADER, "timestamps", F.slice(offsets, 2, F.size("timestamps")).alias("intervals"))


def conversation_volume(conversations: DataFrame, packets: DataFrame,
                        time: int = 60) -> DataFrame:
    """Bytes per conversation endpoints, over the packets of the conversation's time bin.

    Several conversations of the same endpoints in a bin count its packets several times. Both
    sides are summed per (bin, endpoints) before they meet.
    """
    keys = ["bin", *ENDPOINTS]
    held = conversations.groupBy(time_bin("ts", time).alias("bin"), *ENDPOINTS).agg(
        F.count("*").alias("_conversations"))
    sent = packets.groupBy(
        time_bin("ts", time).alias("bin"), F.col("ip_src").alias("src"),
        F.col("tcp_sport").alias("sport"), F.col("ip_dst").alias("dst"),
        F.col("tcp_dport").alias("dport")).agg(F.sum("ip_total_length").alias("_bytes"))
    return (
        held.join(sent, keys).groupBy(*ENDPOINTS)
        .agg(F.sum(F.col("_conversations") * F.col("_bytes")).alias("bytes"))
        .select("bytes")
    )


def latency_histogram(conversations: DataFrame) -> DataFrame:
    """Packets per offset (`intervals`) from the first packet of their conversation, in whole ms."""
    offset = F.explode("intervals").alias("interval")
    return (
        conversations.select(offset)
        .groupBy(F.floor(F.col("interval") * 1000).cast("long").alias("interval_ms"))
        .agg(F.count("*").alias("count"))
    )


def latency_histogram_of_times(times: DataFrame) -> DataFrame:
    """The same from `conversation_times`, without a list per conversation."""
    offset = F.col("second") - F.col("ts")
    later = F.col("packets") - F.when(offset == 0, 1).otherwise(0)  # without the first packet
    return (
        times.groupBy((offset * 1000).alias("interval_ms")).agg(F.sum(later).alias("count"))
        .where(F.col("count") > 0)
    )
