"""Conversations and latencies in microseconds.

Packets carry `ts_micros` (microseconds since 1970) besides the seconds. Within a task the packets of
a connection and second become one row with their times as a binary column: sorted, as differences,
in base 128. Conversations are numbered on the seconds, as in `conversations`; the times are only
unpacked where they are counted. A row holds at most `ROW_TIMES` times, so a connection with any
number of packets in a second is several rows, and no list of a whole conversation exists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodlens.operators.conversations import (
    CONNECTION,
    connection_packets,
    named_endpoints,
    number_conversations,
)
from floodlens.session import ship_package, staged

ROW_TIMES = 65_536
SECOND = 1_000_000
#: Buckets of the log-linear histogram: exact below 2 ** SUB_BITS, then 2 ** SUB_BITS to a doubling.
SUB_BITS = 4
_PACKED = ("a_ip string, a_port int, b_ip string, b_port int, ts long, n long, starter int, "
           "syn int, fin int, rst int, first_micro int, last_micro int, times binary")
_FIELDS = pa.schema([
    ("a_ip", pa.string()), ("a_port", pa.int32()), ("b_ip", pa.string()), ("b_port", pa.int32()),
    ("ts", pa.int64()), ("n", pa.int64()), ("starter", pa.int32()), ("syn", pa.int32()),
    ("fin", pa.int32()), ("rst", pa.int32()), ("first_micro", pa.int32()),
    ("last_micro", pa.int32()), ("times", pa.binary())])


# Times as bytes --------------------------------------------------------------------------------

def pack(times: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ascending times, times[first[i]:first[i + 1]], as bytes, and where each row's begin
    (one more). A time is its difference from the one before it, seven bits a byte, low ones first;
    the top bit says that more follow."""
    deltas = np.diff(times, prepend=0)
    begins = first[:-1][np.diff(first) > 0]
    deltas[begins] = times[begins]
    sizes = np.ones(len(times), np.int64)
    for bits in (7, 14, 21, 28):
        sizes += deltas >= 1 << bits
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(at[-1]), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        here = np.flatnonzero(sizes > k)
        more = (sizes[here] > k + 1).astype(np.int64) << 7
        out[at[here] + k] = deltas[here] >> 7 * k & 127 | more
    return out, at[first]


def unpack(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The times of rows of bytes, and where each row's begin (one more)."""
    if not len(data):
        return np.empty(0, np.int64), np.zeros(len(first), np.int64)
    last = data < 128
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], ends[:-1]])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts)
    deltas = np.add.reduceat((data & 127).astype(np.int64) << 7 * place, starts)
    rows = np.searchsorted(starts, first)
    total = np.cumsum(deltas)
    before = np.concatenate([[0], total])[rows[:-1]]
    return total - np.repeat(before, np.diff(rows)), rows


def _code(column: pa.Array) -> np.ndarray:
    coded = column.dictionary_encode()
    order = np.argsort(np.array(coded.dictionary.to_pylist(), object), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[coded.indices.to_numpy()]


def _packed(batches: Iterator[pa.RecordBatch], row_times: int) -> Iterator[pa.RecordBatch]:
    """Rows of packets per (connection, second) of each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        micros = batch.column("ts_micros").to_numpy() % SECOND
        keys = [_code(batch.column(c)) if "ip" in c else batch.column(c).to_numpy()
                for c in (*CONNECTION, "ts")]
        order = np.lexsort([micros, *reversed(keys)])
        micros, keys = micros[order], [k[order] for k in keys]
        new = np.zeros(len(order), bool)
        new[0] = True
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        at = np.flatnonzero(new)
        inside = np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order))))
        new |= inside % row_times == 0
        at = np.flatnonzero(new)
        data, offsets = pack(micros, np.append(at, len(order)))
        row = pa.array(order[at])
        flags = {c: batch.column(c).to_numpy()[order] for c in ("starter", "syn", "fin", "rst")}
        counts = np.diff(np.append(at, len(order)))
        times = pa.Array.from_buffers(pa.binary(), len(at), [
            None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        columns = {
            **{c: batch.column(c).take(row) for c in (*CONNECTION, "ts")}, "n": pa.array(counts),
            "starter": pa.array(np.minimum.reduceat(flags["starter"], at)),
            **{c: pa.array(np.maximum.reduceat(flags[c], at)) for c in ("syn", "fin", "rst")},
            "first_micro": pa.array(micros[at]), "last_micro": pa.array(micros[at + counts - 1]),
            "times": times}
        yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in _FIELDS],
                                         schema=_FIELDS)


def packed_times(packets: DataFrame, row_times: int = ROW_TIMES) -> DataFrame:
    """Rows of packets per (connection, second), with their times packed. A second may have several
    rows. Packets without `ts_micros` count at the beginning of their second."""
    ship_package(packets.sparkSession)
    return connection_packets(packets, F.coalesce(
        "ts_micros", F.col("ts") * SECOND).alias("ts_micros")).mapInArrow(
        lambda batches: _packed(batches, row_times), _PACKED)


# Conversations -----------------------------------------------------------------------------------

def _numbered(packed: DataFrame, gap_s: int) -> DataFrame:
    """Seconds of every connection with the number of their conversation and its first time."""
    seconds = packed.groupBy(*CONNECTION, "ts").agg(
        F.sum("n").alias("n"), F.min("starter").alias("starter"), F.max("syn").alias("syn"),
        F.max("fin").alias("fin"), F.max("rst").alias("rst"),
        F.min("first_micro").alias("first_micro"), F.max("last_micro").alias("last_micro"))
    whole = Window.partitionBy(*CONNECTION, "number")
    return number_conversations(seconds, gap_s).withColumn(
        "start_micros", F.min(F.col("ts") * SECOND + F.col("first_micro")).over(whole))


def conversation_build_micros(packets: DataFrame, gap_s: int = 60) -> DataFrame:
    """`conversation_build` with the first and last packet time in microseconds.

    Conversations are those of `conversation_build`: silence is measured in whole seconds.
    """
    held = _numbered(packed_times(packets), gap_s).groupBy(*CONNECTION, "number").agg(
        F.min("ts").alias("ts"), F.min("start_micros").alias("ts_micros"),
        F.max(F.col("ts") * SECOND + F.col("last_micro")).alias("last_micros"),
        F.sum("n").alias("packets"), F.min_by("starter", "ts").alias("starter"),
        F.max("rst").alias("rst"), F.max("fin").alias("fin"))
    state = F.when(F.col("rst") > 0, "reset").when(F.col("fin") > 0, "close").otherwise("timeout")
    return held.select("ts_micros", *named_endpoints("starter"), state.alias("end_state"),
                       "last_micros", "packets")


def _offset_counts(packets: DataFrame, gap_s: int, unit: int, sub_bits: int | None,
                   row_times: int = ROW_TIMES) -> DataFrame:
    """(value, count): packets per offset from the first packet of their conversation, without that
    packet, in whole units of so many microseconds, or in log-linear buckets of them."""
    packed = staged(packed_times(packets, row_times), "packed-times")
    numbered = staged(_numbered(packed, gap_s).select(
        *CONNECTION, "ts", "number", "start_micros", "first_micro"), "numbered-seconds")
    held = packed.select(*CONNECTION, "ts", "times").join(
        numbered.select(*CONNECTION, "ts", "start_micros"), [*CONNECTION, "ts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = batch.column("times")
            offsets = np.frombuffer(times.buffers()[1], np.int32)[
                times.offset:times.offset + len(times) + 1].astype(np.int64)
            body = times.buffers()[2]
            data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
            micros, rows = unpack(data[offsets[0]:offsets[-1]], offsets - offsets[0])
            base = batch.column("ts").to_numpy() * SECOND - batch.column("start_micros").to_numpy()
            values = (micros + np.repeat(base, np.diff(rows))) // unit
            if sub_bits is not None:
                values = bucket_of(values, sub_bits)
            found, counts = np.unique(values, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)],
                                             names=["value", "count"])

    counted = held.select("times", "ts", "start_micros").mapInArrow(
        count, "value long, count long")
    first = numbered.where(F.col("ts") * SECOND + F.col("first_micro") == F.col("start_micros")
                           ).select(F.lit(0).cast("long").alias("value"),
                                    F.lit(-1).cast("long").alias("count"))
    return counted.unionByName(first).groupBy("value").agg(
        F.sum("count").alias("count")).where("count > 0")


def latency_histogram_micros(packets: DataFrame, gap_s: int = 60,
                             row_times: int = ROW_TIMES) -> DataFrame:
    """Packets per offset from the first packet of their conversation, in whole milliseconds."""
    return _offset_counts(packets, gap_s, 1000, None, row_times).withColumnRenamed("value", "interval_ms")


def bucket_of(values: np.ndarray, sub_bits: int = SUB_BITS) -> np.ndarray:
    """Number of the log-linear bucket of whole numbers from 0 on: exact below 2 ** sub_bits, then
    2 ** sub_bits buckets to every doubling, so a bucket is no wider than its start over that."""
    values = np.asarray(values, np.int64)
    shift = np.maximum(np.frexp(np.maximum(values, 1).astype(np.float64))[1] - 1 - sub_bits, 0)
    shift += (values >> shift) >= 2 << sub_bits   # a float may round up to the next power of two
    shift -= (shift > 0) & ((values >> shift) < 1 << sub_bits)
    return (shift << sub_bits) + (values >> shift)


def bucket_start(bucket: Column, sub_bits: int = SUB_BITS) -> Column:
    """Smallest number in a bucket."""
    size = 1 << sub_bits
    shift = F.greatest(F.floor(bucket / size) - 1, F.lit(0)).cast("int")
    return F.when(bucket < size, bucket).otherwise(
        ((bucket % size + size).cast("double") * F.pow(F.lit(2.0), shift)).cast("long"))


def latency_buckets(packets: DataFrame, gap_s: int = 60, sub_bits: int = SUB_BITS) -> DataFrame:
    """Packets per log-linear bucket of their offset in microseconds: bucket, from_micros, count.

    The number of buckets is bounded (some 16 to a doubling), so histograms of any captures can be
    added up bucket by bucket.
    """
    return _offset_counts(packets, gap_s, 1, sub_bits).select(
        F.col("value").alias("bucket"), bucket_start(F.col("value"), sub_bits).alias(
            "from_micros"), "count")


def latency_quantiles(buckets: DataFrame, probabilities: list[float]) -> DataFrame:
    """Per probability: the start of the bucket in which that share of the packets is reached, of
    histograms of `latency_buckets` (one, or a union of several)."""
    total = buckets.groupBy("from_micros").agg(F.sum("count").alias("count"))
    # Bounded: at most some thousand buckets.
    upto = Window.orderBy("from_micros").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = total.select("from_micros", F.sum("count").over(upto).alias("upto"),
                          F.sum("count").over(Window.partitionBy(F.lit(0))).alias("whole"))
    return ranked.select("*", F.explode(F.array(*map(F.lit, probabilities))).alias(
        "probability")).where(F.col("upto") >= F.col("probability") * F.col("whole")).groupBy(
        "probability").agg(F.min("from_micros").alias("from_micros"))
