"""Capture files: payloads, chosen columns, pushed filters, and the stream of a growing folder."""

import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from support import packets, plan, rows, tcp
from test_conversations import GAP, _headers, _rows, _seconds, _track, _traffic
from test_sources import FRAMES, TCP_HEADER, UDP_HEADER, _capture, _frame

from floodlens import schemas
from floodlens.operators import conversations, ngrams
from floodlens.sources import capture, capture_splits
from floodlens.sources.capture_stream import FileLog, packet_stream_pcap
from floodlens.streaming.conversations import stream_conversations

ALL = schemas.CAPTURED.names
PAYLOADS = [b"hello", b"abcde", None, None, None]


def _write(tmp_path, frames, **more):
    path = tmp_path / "a.pcap"
    path.write_bytes(_capture(frames, **more))
    return str(path)


@pytest.mark.parametrize("magic,micros", [(0xA1B2C3D4, 5), (0xA1B23C4D, 0)])
def test_payload_times_and_offsets(spark, tmp_path, magic, micros):
    padded = [f + b"\0" * 9 if i == 0 else f for i, f in enumerate(FRAMES)]  # Ethernet padding
    got = capture.packet_scan_pcap(spark, _write(tmp_path, padded, magic=magic), columns=ALL)
    assert got.schema == schemas.CAPTURED
    found = got.orderBy("ts").collect()
    assert [None if r.payload is None else bytes(r.payload) for r in found] == PAYLOADS
    assert [r.ts_micros - r.ts * 1_000_000 for r in found] == [micros] * 5
    assert [r.ip_frag_offset for r in found] == [0, 0, 16, 0, 0]
    headers = capture.packet_scan_pcap(spark, _write(tmp_path, padded, magic=magic))
    assert headers.orderBy("ts").collect() == [tuple(r)[:-3] for r in found]


def test_empty_payload_offload_and_short_capture(spark, tmp_path):
    whole = _frame(6, TCP_HEADER, payload=b"x" * 40)
    offloaded = whole[:16] + b"\0\0" + whole[18:]       # total length zero
    frames = [_frame(17, UDP_HEADER), whole[:-30], offloaded]
    found = capture.packet_scan_pcap(spark, _write(tmp_path, frames),
                                     columns=["ts", "payload"]).orderBy("ts").collect()
    assert [bytes(r.payload) for r in found] == [b"", b"x" * 10, b"x" * 40]


def test_payloads_across_blocks(monkeypatch, tmp_path):
    rng = np.random.default_rng(4)
    frames = [_frame(17, UDP_HEADER, payload=rng.bytes(int(n)))
              for n in rng.integers(0, 90, 300)]
    path = _write(tmp_path, frames)
    wanted = capture.Wanted(("ts", "payload"))
    whole = pa.Table.from_batches(capture.read_capture(path, wanted=wanted)).to_pydict()
    assert whole["payload"] == [f[42:] for f in frames]
    monkeypatch.setattr(capture, "BLOCK", 151)
    parts = pa.Table.from_batches(capture.read_capture(path, wanted=wanted))
    assert parts.num_rows == 300 and parts.to_pydict() == whole


def test_split_reader_gives_payloads_too(spark, tmp_path):
    frames = [_frame(17, UDP_HEADER, payload=bytes([i % 251]) * (i % 60)) for i in range(2000)]
    path = _write(tmp_path, frames)
    got = capture_splits.packet_scan_large(spark, path, 8192, columns=["ts", "payload"])
    assert [bytes(r.payload) for r in got.orderBy("ts").collect()] == [f[42:] for f in frames]


def test_payload_is_not_built_when_it_is_not_selected(monkeypatch, tmp_path):
    def never(self):
        raise AssertionError("payload built")

    monkeypatch.setattr(capture.Frames, "payload", never)
    path = _write(tmp_path, FRAMES)
    (batch,) = capture.read_capture(path, wanted=capture.Wanted(("ip_dst", "tcp_len")))
    assert batch.schema.names == ["ip_dst", "tcp_len"] and batch.num_rows == 5
    with pytest.raises(AssertionError):
        list(capture.read_capture(path, wanted=capture.Wanted(("payload",))))


def _many(tmp_path):
    frames = []
    for i in range(400):
        transport = (struct.pack(">HHIIHHHH", i % 50, 80, i, 5, 5 << 12 | 2, 4096, 0, 0)
                     if i % 3 else struct.pack(">HHHH", 53, i, 13, 999))
        frame = bytearray(_frame(6 if i % 3 else 17, transport, payload=b"p" * (i % 7)))
        frame[29] = i % 4                                # last byte of the source address
        frames.append(bytes(frame))
    return _write(tmp_path, frames)


CONDITIONS = ["ip_proto = 17", "ip_src = '1.2.3.2'", "ip_src in ('1.2.3.1', '1.2.3.3', 'x', '01.2.3.2')",
              "tcp_sport >= 40 and tcp_sport < 45", "udp_dport in (3, 9, 10, null)", "tcp_dport is not null",
              "udp_sport <=> 53", "ip_proto = 6 and tcp_len > 3 and ip_dst = '5.6.7.8'",
              "ip_proto = 6 or udp_dport = 9", "not ip_proto = 6", "ip_src > '1.2.3.1'",
              "payload = X'7070'", "ts_micros <= 3000000007000005", "tcp_sport <=> null", "ip_src = 'no'",
              "udp_checksum = '999'", "tcp_seq_id is null"]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_filters_give_the_same_rows_pushed_or_not(spark, tmp_path, condition):
    scan = capture.packet_scan_pcap(spark, _many(tmp_path), columns=ALL)
    whole = spark.createDataFrame(scan.collect(), schemas.CAPTURED)
    assert rows(scan.where(condition)) == rows(whole.where(condition))


def test_filters_reach_the_reader(spark, tmp_path):
    scan = capture.packet_scan_pcap(spark, _many(tmp_path), columns=["ip_proto", "ip_src", "ts"])
    handled = scan.where("ip_proto = 17 and ip_src = '1.2.3.2' and ts > 5")
    assert "Filter" not in plan(handled).replace("RuntimeFilters", "")  # nothing left for Spark
    assert "Filter" in plan(scan.where("ip_src > '1.2.3.1'")).replace("RuntimeFilters", "")


def test_ngrams_of_a_capture_equal_those_of_the_table(spark, tmp_path):
    capture.register_capture(spark)
    rng = np.random.default_rng(8)
    table = packets(spark, [
        {"ts": i, "ip_src": "1.1.1.1", "ip_dst": "2.2.2.2", "ip_proto": 6 if i % 2 else 17,
         "tcp_offset": 5, "tcp_sport": 25 if i % 2 else None, "tcp_dport": 1000 if i % 2 else None,
         "udp_sport": None if i % 2 else 53, "udp_dport": None if i % 2 else 9} for i in range(60)])
    texts = spark.createDataFrame([(i, rng.bytes(int(rng.integers(0, 200)))) for i in range(60)],
                                  "ts long, payload binary")
    table = table.join(texts, "ts").withColumn("ip_total_length", (
        F.octet_length("payload") + F.when(F.col("ip_proto") == 6, 40).otherwise(28)).cast("int"))
    folder = str(tmp_path / "captures")
    table.select(*schemas.PACKETS.names, "payload").write.format("capture").mode(
        "append").save(folder)
    read = capture.packet_scan_pcap(spark, folder, columns=[
        "tcp_sport", "tcp_dport", "udp_sport", "udp_dport", "payload"])
    for service in ("", "udp:53", "tcp:25"):
        for n in (1, 3):
            assert rows(ngrams.payload_ngrams(read, "payload", service, n)) == rows(
                ngrams.payload_ngrams(table, "payload", service, n))
    assert rows(ngrams.ngrams_by_service(read, "payload")) == rows(
        ngrams.ngrams_by_service(table, "payload"))


def test_written_fractions_of_seconds_come_back(spark, tmp_path):
    capture.register_capture(spark)
    frame = packets(spark, [tcp(7, "1.1.1.1", "2.2.2.2")]).withColumn(
        "ts_micros", F.lit(7_123_456).cast("long"))
    frame.write.format("capture").mode("append").save(str(tmp_path / "c"))
    (got,) = capture.packet_scan_pcap(spark, str(tmp_path / "c"),
                                      columns=["ts", "ts_micros"]).collect()
    assert tuple(got) == (7, 7_123_456)


# Streams ---------------------------------------------------------------------------------------

def _addressed(traffic):
    """The traffic of the tracker between addresses, as captures hold them."""
    place = {"10.0.0.1": "10.0.0.1", "10.0.0.2": "10.0.0.2", "c": "10.0.0.3", "d": "10.0.0.4"}
    return [(ts, (place[a], p), (place[b], q), f) for ts, (a, p), (b, q), f in traffic]


def _add(folder, name, traffic):
    """A capture file of TCP packets, moved into place."""
    frames = out = b""
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for ts, one, two, flags in traffic:
        bits = 2 * ("S" in flags) + 16 * ("A" in flags) + ("F" in flags) + 4 * ("R" in flags)
        header = struct.pack(">HHIIHHHH", one[1], two[1], 1, 1, 5 << 12 | bits, 1, 0, 0)
        frame = bytearray(_frame(6, header))
        frame[26:30] = bytes(map(int, one[0].split(".")))
        frame[30:34] = bytes(map(int, two[0].split(".")))
        out += struct.pack("<IIII", ts, 0, len(frame), len(frame)) + bytes(frame)
    pending = folder / f"_{name}"
    pending.write_bytes(out + frames)
    pending.rename(folder / name)


def _advance(spark, tmp_path, fail=False):
    """Run the stream over what is there, from its checkpoint; the sink may fail once."""
    stream = stream_conversations(
        packet_stream_pcap(spark, str(tmp_path / "in"), str(tmp_path / "log")), "60 seconds", GAP)

    def write(batch, number):
        if fail:
            raise RuntimeError("lost")
        batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={number}"))

    query = (stream.writeStream.foreachBatch(write)
             .option("checkpointLocation", str(tmp_path / "check")).start())
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_stream_of_a_growing_folder_survives_a_failure(spark, tmp_path):
    """Files added between runs; a run that dies in its sink after more files came is repeated with
    the same files, and in the end all rows are those of the tracker."""
    (tmp_path / "in").mkdir()
    traffic = _addressed(_traffic(6, 200))
    third = len(traffic) // 3
    last = traffic[-1][0]
    _add(tmp_path / "in", "z-first.pcap", traffic[:third])
    _advance(spark, tmp_path)
    _add(tmp_path / "in", "b.pcap", traffic[third:2 * third])
    with pytest.raises(Exception, match="lost"):
        _advance(spark, tmp_path, fail=True)
    _add(tmp_path / "in", "a-later.pcap", traffic[2 * third:])  # sorts before what was taken
    _advance(spark, tmp_path)
    _advance(spark, tmp_path)                                   # nothing new
    _add(tmp_path / "in", "c.pcap", [(last + 1000, ("10.0.0.3", 1), ("10.0.0.4", 2), "")])
    _advance(spark, tmp_path)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = _track(traffic, GAP)
    assert _rows(got.where("second is null").select(
        *conversations.HEADER, "end_state", "last_ts", "packets")) == _headers(want)
    assert _rows(got.where("second is not null").select(
        *conversations.HEADER, "second", "packets")) == _seconds(want)


def test_memory_of_payloads_does_not_grow_with_a_batch(tmp_path):
    """Written and read again, of all sizes, some larger than what is written at once."""
    rng = np.random.default_rng(4)
    sizes = [0, 1, 5, 65000, *rng.integers(0, 3000, 20_000).tolist()]
    payloads = [rng.bytes(n) for n in sizes]
    wanted = capture.Wanted((*schemas.PACKETS.names, "payload"))
    known = {"payload": payloads, "ts": list(range(len(sizes))), "ip_proto": [17] * len(sizes),
             "ip_total_length": [0] * len(sizes)}
    batch = pa.RecordBatch.from_arrays(
        [pa.array(known.get(f.name, [None] * len(sizes)), f.type) for f in wanted.schema()],
        schema=wanted.schema())
    writer = capture.CaptureWriter(str(tmp_path), False)
    tracemalloc.start()
    file = writer.write(iter([batch, batch.slice(0, 0), batch.slice(3, 2)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    found, stamps = [], []
    for part in capture.read_capture(str(tmp_path / "_temporary" / file.file),
                                     wanted=capture.Wanted(("ts", "payload"))):
        found.extend(map(hash, part["payload"].to_pylist()))
        stamps.extend(part["ts"].to_pylist())
    read_peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert stamps == [*range(len(sizes)), 3, 4]
    assert found == [hash(p) for p in [*payloads, *payloads[3:5]]]
    assert peak < 48_000_000 and read_peak < 64_000_000


def test_other_sessions_read_streams_too(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for session in (spark, spark.newSession(), spark.newSession()):
        assert packet_stream_pcap(
            session, str(tmp_path / "in"), str(tmp_path / "log"), columns=["ts"]).isStreaming


def test_log_keeps_its_entries(tmp_path):
    log = FileLog(str(tmp_path / "log"))
    assert log.last() == 0 and log.files(0, 0) == []
    log.add(["a", "b"])
    log.add(["c"])
    assert log.last() == 2 and log.files(0, 2) == ["a", "b", "c"] and log.files(1, 2) == ["c"]
    with pytest.raises(ValueError, match="lost"):
        log.files(1, 3)
