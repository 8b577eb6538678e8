"""Packet times in microseconds: packing, conversations, histograms."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import rows
from test_conversations import GAP, _frame, _track, _traffic

from floodlens.operators import conversations, latency


def test_packed_times_come_back():
    rng = np.random.default_rng(1)
    parts = [np.sort(rng.integers(0, top, n)) for top, n in (
        (10, 50), (1_000_000, 300), (2, 1), (1_000_000, 1), (200, 5), (1 << 31, 40))]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    data, at = latency.pack(np.concatenate(parts), first)
    times, rows = latency.unpack(data, at)
    assert rows.tolist() == first.tolist() and times.tolist() == np.concatenate(parts).tolist()
    empty = latency.unpack(np.empty(0, np.uint8), np.zeros(3, np.int64))
    assert empty[0].tolist() == [] and empty[1].tolist() == [0, 0, 0]


def test_buckets_are_narrow_and_ordered(spark):
    values = np.unique(np.concatenate([
        np.arange(5000), 2 ** np.arange(62), 2 ** np.arange(2, 62) - 1,
        np.random.default_rng(2).integers(0, 1 << 62, 3000)]))
    buckets = latency.bucket_of(values)
    assert (np.diff(buckets) >= 0).all() and buckets[:32].tolist() == list(range(32))
    frame = spark.createDataFrame([(int(v), int(b)) for v, b in zip(values, buckets)],
                                  "value long, bucket long")
    held = frame.select("value", latency.bucket_start(F.col("bucket")).alias("start")).toPandas()
    assert (held.start <= held.value).all()
    assert (held.value - held.start <= held.start / 16).all()


def _micros(traffic, seed):
    """The traffic with fractions of seconds, in any order; some packets have none."""
    rng = random.Random(seed)
    fraction = [rng.choice([None, 0, 7, 999_999, rng.randrange(10 ** 6)]) for _ in traffic]
    return traffic, fraction


def _frame_of(spark, traffic, fraction):
    plain = _frame(spark, traffic)
    held = [(*tuple(row), None if f is None else row.ts * 10 ** 6 + f)
            for row, f in zip(plain.collect(), fraction)]
    random.Random(3).shuffle(held)
    schema = plain.withColumn("ts_micros", F.lit(None).cast("long")).schema
    return spark.createDataFrame(held, schema).repartition(3)


def _offsets(traffic, fraction, gap):
    """Per conversation: the sorted packet times, in microseconds."""
    times = {}
    for packet, f in zip(traffic, fraction):
        key = (tuple(sorted(packet[1:3])), packet[0])
        times.setdefault(key, []).append(packet[0] * 10 ** 6 + (f or 0))
    found = []
    for header, _, stamps in _track(traffic, gap):
        key = tuple(sorted([(header[1], header[2]), (header[3], header[4])]))
        found.append(sorted(t for ts in set(stamps) for t in times[key, ts]))
    return found


@pytest.mark.parametrize("row_times", [65_536, 3])
def test_histograms_equal_the_tracker(spark, row_times):
    traffic, fraction = _micros(_traffic(5), 5)
    frame = _frame_of(spark, traffic, fraction)
    held = _offsets(traffic, fraction, GAP)
    offsets = [t - times[0] for times in held for t in times[1:]]
    assert rows(latency.latency_histogram_micros(frame, GAP, row_times)) == sorted(
        Counter(o // 1000 for o in offsets).items(), key=str)
    buckets = latency.latency_buckets(frame, GAP)
    assert rows(buckets, "bucket", "count") == sorted(
        Counter(latency.bucket_of(np.array(offsets)).tolist()).items(), key=str)
    built = latency.conversation_build_micros(frame, GAP)
    assert rows(built, "ts_micros", "last_micros", "packets") == sorted(
        ((t[0], t[-1], len(t)) for t in held), key=str)
    assert rows(built, *conversations.ENDPOINTS, "end_state") == rows(
        conversations.conversation_build(frame, GAP), *conversations.ENDPOINTS, "end_state")
    exact = np.sort(offsets)
    for r in latency.latency_quantiles(buckets.unionByName(buckets), [0.5, 0.99]).collect():
        want = exact[int(np.ceil(r.probability * len(exact))) - 1]
        assert r.from_micros <= want <= r.from_micros * (1 + 1 / 16) + 1


def test_a_second_with_very_many_packets_is_many_rows(spark):
    traffic = [(100, ("a", 1), ("b", 2), "")] * 2000
    frame = _frame(spark, traffic).coalesce(1).withColumn(
        "ts_micros", F.lit(100 * 10 ** 6).cast("long") + F.monotonically_increasing_id())
    packed = latency.packed_times(frame, 100).collect()
    assert len(packed) >= 20 and max(r.n for r in packed) == 100
    assert rows(latency.latency_histogram_micros(frame, GAP, 100)) == [(0, 999), (1, 1000)]


def test_no_packets(spark):
    frame = _frame(spark, [(1, ("a", 1), ("b", 2), "")]).withColumn(
        "ts_micros", F.lit(1).cast("long")).where("false")
    assert latency.latency_histogram_micros(frame).count() == 0
    assert latency.conversation_build_micros(frame).count() == 0
