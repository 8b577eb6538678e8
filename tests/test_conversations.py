"""Conversations against a packet-by-packet tracker, in batch and as a stream."""

import random
from collections import Counter
from types import SimpleNamespace

import oracle
import pandas as pd
import pytest
from support import packets, rows, tcp

import __spark_entry__ as contract
from floodlens.operators import conversations
from floodlens.plans import conversation_queries
from floodlens.plans.tables import Tables
from floodlens.streaming import conversations as tracking
from floodlens.streaming.conversations import stream_conversations

GAP = 20


def _traffic(seed, count=400):
    random.seed(seed)
    found, ts = [], 1000
    for _ in range(count):
        ts += random.choice([0, 0, 1, 3, 8, 15])
        client = ("10.0.0.1", random.choice([1, 2, 3]))
        server = ("10.0.0.2", 80)
        one, two = (client, server) if random.random() < 0.6 else (server, client)
        flags = random.choices(["", "S", "SA", "F", "R"], [6, 2, 1, 1, 1])[0]
        found.append((ts, one, two, flags))
    return found


def _frame(spark, traffic):
    return packets(spark, [
        tcp(ts, one[0], two[0], sport=one[1], dport=two[1], tcp_syn=int("S" in f),
            tcp_ack=int("A" in f), tcp_fin=int("F" in f), tcp_rst=int("R" in f))
        for ts, one, two, f in traffic])


def _track(traffic, gap):
    """One conversation after the other, second by second."""
    by_connection = {}
    for packet in traffic:
        by_connection.setdefault(tuple(sorted(packet[1:3])), {}).setdefault(
            packet[0], []).append(packet)
    found = []
    for seconds in by_connection.values():
        current, ended = [], False
        for ts in sorted(seconds):
            flags = [p[3] for p in seconds[ts]]
            opens = "S" in flags
            silent = current and ts - current[-1][0] > gap
            if silent or (opens and ended):
                found.append(current)
                current = []
            if any(f in ("F", "R") for f in flags):
                ended = True
            elif opens or silent or not current:
                ended = False
            current.extend(seconds[ts])
        found.append(current)
    out = []
    for held in found:
        first = [p for p in held if p[0] == held[0][0]]
        named = min(first, key=lambda p: (p[3] != "S", p[1] > p[2]))
        flags = {p[3] for p in held}
        stamps = [p[0] for p in held]
        header = (held[0][0], *named[1], *named[2])
        out.append((header, "reset" if "R" in flags else "close" if "F" in flags else "timeout",
                    stamps))
    return out


def _headers(tracked):
    return sorted(((*h, state, stamps[-1], len(stamps)) for h, state, stamps in tracked), key=str)


def _seconds(tracked):
    return sorted(((*h, ts, n) for h, _, stamps in tracked for ts, n in Counter(stamps).items()),
                  key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_batch_equals_tracker(spark):
    for seed in (1, 2, 3):
        traffic = _traffic(seed)
        want = _track(traffic, GAP)
        frame = _frame(spark, traffic)
        assert _rows(conversations.conversation_build(frame, GAP)) == _headers(want)
        times = conversations.conversation_times(frame, GAP)
        assert _rows(times) == _seconds(want)
        assert _rows(conversations.conversation_lists(times)) == sorted(
            ((*h, stamps, [float(t - stamps[0]) for t in stamps[1:]]) for h, _, stamps in want),
            key=str)


def test_many_packets_in_a_second_stay_one_conversation(spark):
    traffic = [(100, ("a", 1), ("b", 2), "")] * 500 + [(101, ("a", 1), ("b", 2), "")]
    frame = _frame(spark, traffic)
    built = conversations.conversation_build(frame, GAP)
    assert _rows(built) == [(100, "a", 1, "b", 2, "timeout", 101, 501)]
    assert rows(conversations.conversation_volume(built, frame)) == [(50100,)]


def test_other_packets_are_left_out(spark):
    frame = packets(spark, [{"ts": 1, "ip_proto": 17}, {"ts": None, "ip_proto": 6},
                            {"ts": 1, "ip_proto": 6, "ip_src": "a", "ip_dst": "b"}])
    assert conversations.conversation_build(frame).count() == 0
    assert conversations.conversation_times(frame).count() == 0


def _stream(spark, tmp_path, frames, watermark, gap):
    source = str(tmp_path / "in")
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frames[0].schema).option(
        "maxFilesPerTrigger", 1).parquet(source)
    tracked = stream_conversations(stream, watermark, gap)
    query = (
        tracked.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(tracked.schema).parquet(str(tmp_path / "out"))


def test_stream_equals_batch(spark, tmp_path):
    """Several files, packets out of order within the watermark, and a last packet to close all."""
    traffic = _traffic(4)
    last = max(p[0] for p in traffic)
    shuffled = sorted(traffic, key=lambda p: p[0] + random.uniform(0, 40))
    third = len(shuffled) // 3
    closing = [(last + 1000, ("c", 1), ("d", 2), "")]
    frames = [_frame(spark, part) for part in (
        shuffled[:third], shuffled[third:2 * third], shuffled[2 * third:], closing)]
    got = _stream(spark, tmp_path, frames, "60 seconds", GAP)
    want = _track(traffic, GAP)
    over = got.where("second is null").select(*conversations.HEADER, "end_state", "last_ts",
                                              "packets")
    assert _rows(over) == _headers(want)
    times = got.where("second is not null").select(*conversations.HEADER, "second", "packets")
    assert _rows(times) == _seconds(want)


@pytest.mark.parametrize("hours", [3, 24, 96])
def test_registered_stream_equals_tracker(spark, hours):
    """At a size where conversations are ended by their successors and not by the gap alone."""
    tables = Tables(spark, "/root/testdata/sf0.01")
    traffic = [
        (r.ts, (r.ip_src, r.tcp_sport), (r.ip_dst, r.tcp_dport),
         "R" if r.tcp_rst else "F" if r.tcp_fin else "", r.tcp_syn)
        for r in tables.sessions.where("tcp_sport is not null and tcp_dport is not null").collect()]
    watermark = max(p[0] for p in traffic) - hours * 3600
    gap = conversation_queries.GAP
    seconds, headers, by_connection = [], [], {}
    for ts, one, two, flag, syn in sorted(traffic, key=lambda p: p[0]):
        by_connection.setdefault(tuple(sorted([one, two])), {}).setdefault(ts, []).append(
            (one, two, flag, syn))
    for held in by_connection.values():
        current = None
        for ts in sorted(s for s in held if s < watermark):
            silent = current is None or ts - current["last"] > gap
            opens = any(p[3] for p in held[ts])
            if current and (silent or (opens and current["ended"])):
                headers.append(current)
                current = None
            if current is None:
                one, two, *_ = min(held[ts], key=lambda p: (not p[3], p[0] > p[1]))
                current = {"name": (ts, *one, *two), "n": 0, "flags": set(), "ended": False}
            flags = {p[2] for p in held[ts]} - {""}
            current["ended"] = bool(flags) or (current["ended"] and not opens and not silent)
            current["flags"] |= flags
            current["last"] = ts
            current["n"] += len(held[ts])
            seconds.append((*current["name"], ts, len(held[ts])))
        if current and current["last"] + gap < watermark:
            headers.append(current)
    got = conversation_queries._streamed(tables, hours)
    assert _rows(got.where("second is not null").select(
        *conversations.HEADER, "second", "packets")) == sorted(seconds, key=str)
    assert _rows(got.where("second is null").select(
        *conversations.HEADER, "end_state", "last_ts", "packets")) == sorted(
        ((*c["name"], "reset" if "R" in c["flags"] else "close" if "F" in c["flags"]
          else "timeout", c["last"], c["n"]) for c in headers), key=str)
    assert any(c["last"] + gap >= watermark for c in headers) or hours != 24


def test_registered_stream_equals_sql_at_the_larger_size(spark):
    sf = "/root/testdata/sf0.01"
    name = "stream_conversations"
    assert oracle.differences(contract.queries()[name](spark, sf), oracle.connect(sf),
                              contract.oracle_sql()[name]) == []


def test_open_conversation_gives_its_passed_seconds(spark, tmp_path):
    traffic = [(100 + 10 * i, ("a", 1), ("b", 2), "") for i in range(30)]
    frames = [_frame(spark, traffic[:10]), _frame(spark, traffic[10:20]),
              _frame(spark, traffic[20:])]
    got = _stream(spark, tmp_path, frames, "50 seconds", GAP)
    assert got.where("second is null").count() == 0
    passed = [t for t, *_ in traffic if t < traffic[-1][0] - 50]
    assert sorted(r["second"] for r in got.collect()) == passed


class _State:
    """Map and value state of one key in plain Python, with the number of writes."""

    def __init__(self):
        self.held, self.value, self.writes, self.timers = {}, None, 0, []

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value,
                               update=lambda v: setattr(self, "value", v),
                               clear=lambda: setattr(self, "value", None))

    def registerTimer(self, at):
        self.timers.append(at)

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.writes += 1
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]

    def keys(self):
        return iter(list(self.held))

    def iterator(self):
        return iter(list(self.held.items()))


@pytest.mark.parametrize("held_rows", [200_000, 700])
def test_seconds_are_kept_and_given_out_in_blocks(monkeypatch, held_rows):
    """Many seconds of one connection, in batches that overlap; watermarks within blocks."""
    if hasattr(tracking, "HELD_ROWS"):
        monkeypatch.setattr(tracking, "HELD_ROWS", held_rows)
    random.seed(8)
    one, two = ("10.0.0.1", 1), ("10.0.0.2", 80)
    traffic, ts = [], 5000
    for _ in range(9000):
        ts += random.choice([0, 1, 1, 2, 2, GAP + 1 if random.random() < 0.1 else 1])
        traffic.append((ts, *random.sample([one, two], 2),
                        random.choices(["", "S", "SA", "F", "R"], [40, 4, 1, 2, 2])[0]))
    traffic.append((ts + 10 ** 6, one, two, ""))
    state, tracker = _State(), tracking.ConversationTracker(GAP)
    tracker.init(state)
    key, got = (*one, *two), []

    def batches(part):
        for low in range(0, len(part), 500):
            yield pd.DataFrame([{
                "ts": p[0], "n": 1, "starter": 2 * (p[3] != "S") + (p[1] > p[2]),
                "syn": int(p[3] == "S"), "fin": int(p[3] == "F"), "rst": int(p[3] == "R")}
                for p in part[low:low + 500]])

    def run(watermark):
        clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark * 1000)
        got.extend(f for f in tracker.handleExpiredTimer(key, clock, None) if len(f))

    part = list(traffic[:-1])
    random.shuffle(part)
    list(tracker.handleInputRows(key, batches(part[:6000]), None))
    list(tracker.handleInputRows(key, batches(part[6000:] + traffic[-1:]), None))
    assert min(state.timers) <= min(p[0] for p in traffic) * 1000 + 1
    blocks = (ts - 5000) // 3600 + 3
    assert len(state.held) <= blocks
    assert state.writes <= 2 * blocks if held_rows > 9000 else state.writes <= 20 * blocks
    for watermark in (5001, 7000, 7000, 7001, 11000, ts + 10, ts + GAP + 1):
        run(watermark)
        if state.held:
            assert state.timers[-1] >= watermark * 1000
    want = _track(traffic[:-1], GAP)
    found = pd.concat(got, ignore_index=True).astype(object)
    found = found.where(found.notna(), None)
    over = found[found["second"].isna()]
    assert sorted(over[[*conversations.HEADER, "end_state", "last_ts", "packets"]].itertuples(
        index=False, name=None), key=str) == _headers(want)
    times = found[found["second"].notna()]
    assert sorted(times[[*conversations.HEADER, "second", "packets"]].itertuples(
        index=False, name=None), key=str) == _seconds(want)
    assert len(state.held) == 1 and state.value is None


def test_volume_counts_shared_bins_twice(spark):
    held = spark.createDataFrame(
        [(10, "a", 1, "b", 2), (50, "a", 1, "b", 2), (70, "a", 1, "b", 2), (10, "x", 1, "b", 2)],
        "ts long, src string, sport int, dst string, dport int")
    frame = packets(spark, [tcp(5, "a", "b", 100, 1, 2), tcp(20, "a", "b", 50, 1, 2),
                            tcp(65, "a", "b", 7, 1, 2), tcp(20, "b", "a", 999, 2, 1)])
    assert rows(conversations.conversation_volume(held, frame)) == [(307,)]


def test_latency(spark):
    days = 40 * 86400.0
    frame = spark.createDataFrame([([0.0015, 2.0],), ([0.0019, days],), ([],)],
                                  "intervals array<double>")
    assert rows(conversations.latency_histogram(frame)) == [
        (1, 2), (2000, 1), (40 * 86400 * 1000, 1)]
    traffic = [(100 + 10 ** 6 * i, ("a", 1), ("b", 2), "") for i in (0, 0, 1, 5)]
    times = conversations.conversation_times(_frame(spark, traffic), 10 ** 7)
    assert rows(conversations.latency_histogram_of_times(times)) == [
        (0, 1), (10 ** 9, 1), (5 * 10 ** 9, 1)]
