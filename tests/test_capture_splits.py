"""Large captures read in ranges give the packets of a sequential read."""

import random
import struct

import pytest
from support import rows
from test_sources import FRAMES, UDP_HEADER, _capture, _frame

from floodlens import schemas
from floodlens.sources import capture, capture_splits


def _nested(order):
    """A packet that carries a capture, with records that look perfectly real."""
    inner = _capture([_frame(17, UDP_HEADER)] * 40, order)
    return _frame(17, UDP_HEADER, payload=inner)


def _decoy(order):
    """A packet full of empty record headers."""
    return _frame(17, UDP_HEADER, payload=struct.pack(order + "IIII", 1, 1, 0, 0) * 200)


@pytest.mark.parametrize("order", "<>")
def test_ranges_equal_one_read(spark, tmp_path, order):
    random.seed(1)
    frames = [f for _ in range(150) for f in (random.choice(FRAMES), _nested(order),
                                              _decoy(order))]
    path = tmp_path / "big.pcap"
    path.write_bytes(_capture(frames, order, tail=struct.pack(order + "IIII", 1, 1, 500, 500)))
    whole = capture.packet_scan_pcap(spark, str(path))
    got = capture_splits.packet_scan_large(spark, str(path), 9000)
    assert got.schema == schemas.PACKETS
    assert rows(got) == rows(whole)


def test_broken_record_in_the_middle_raises_or_ends_the_file(spark, tmp_path):
    path = tmp_path / "torn.pcap"
    one = _capture(FRAMES * 20)
    path.write_bytes(one + struct.pack("<IIII", 1, 1, 2_000_000_000, 5) + one[24:])
    got = capture_splits.packet_scan_large(spark, str(path), 600, bad_records="stop")
    whole = capture.packet_scan_pcap(spark, str(path), bad_records="stop")
    assert rows(got) == rows(whole) and whole.count() == 20 * 5
    with pytest.raises(Exception, match="more bytes than a frame"):
        capture_splits.packet_scan_large(spark, str(path), 600).collect()


def test_several_files_and_an_empty_one(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(_capture(FRAMES * 9))
    (tmp_path / "b.pcap").write_bytes(_capture([]))
    (tmp_path / "c.pcap").write_bytes(_capture(FRAMES * 5, ">"))
    paths = ",".join(str(tmp_path / f"{n}.pcap") for n in "abc")
    got = capture_splits.packet_scan_large(spark, paths, 300)
    assert rows(got) == rows(capture.packet_scan_pcap(spark, str(tmp_path)))


def _records(count, second=lambda i: 1, length=500):
    """Records of 60 bytes that claim `length` bytes on the wire."""
    frame = (_frame(17, UDP_HEADER) + bytes(60))[:60]
    return _capture([]) + b"".join(
        struct.pack("<IIII", second(i), 1, len(frame), length) + frame for i in range(count))


def test_wrong_guesses_of_a_file_are_corrected_in_one_pass(spark, tmp_path, monkeypatch):
    """Times far from the first one: no guess holds, in any of the ranges."""
    path = tmp_path / "old.pcap"
    path.write_bytes(_records(600, lambda i: 2_000_000_000 if i else 1))
    rounds = []
    real = capture_splits.staged
    monkeypatch.setattr(capture_splits, "staged",
                        lambda df, name: rounds.append(name) or real(df, name))
    got = capture_splits.packet_scan_large(spark, str(path), 3000)
    assert rows(got) == rows(capture.packet_scan_pcap(spark, str(path))) and got.count() == 600
    assert len(rounds) <= 3


def test_records_longer_than_their_frames_are_found(tmp_path):
    """Some writers note fewer bytes on the wire than they have captured."""
    path = tmp_path / "short.pcap"
    path.write_bytes(_records(200, length=20))
    with open(path, "rb") as file:
        assert capture_splits._find(file, "<", 24 + 76 * 10 - 7, 24 + 76 * 50, 24 + 76 * 200) == (
            24 + 76 * 10, 24 + 76 * 50)


def test_a_walk_reads_its_range_only(tmp_path):
    path = tmp_path / "long.pcap"
    path.write_bytes(_records(20000))
    size = path.stat().st_size
    with open(path, "rb") as file:
        class Counted:
            taken = 0
            seek = file.seek

            def read(self, count):
                self.taken += count
                return file.read(count)

        counted = Counted()
        assert capture_splits._walk(counted, "<", 24, 24 + 7600, size) == 24 + 7600
        assert counted.taken < 8000
