"""Readers and sinks on real files and on awkward lines."""

import bz2
import gzip
import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F
from support import lines, packets, rows, tcp, udp

from floodlens import schemas
from floodlens.sources import (
    alerts,
    capture,
    conversations,
    dns,
    fingerprints,
    http,
    records,
    sinks,
)


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_packet_lines(spark, tmp_path):
    full = ["1428745323.9"] + ["NONE"] * 32
    full[4], full[9], full[11], full[12], full[29] = "1500", "17", "1.2.3.4", "5.6.7.8", "53"
    bad = ["x", "junk", "", "3.5"] + [""] * 29
    path = _write(tmp_path / "p.txt", " ".join(full) + "\n" + " ".join(bad) + "\n1 4\n")
    got = records.packet_scan(spark, path)
    assert got.schema == schemas.PACKETS
    first, second, third = sorted(got.collect(), key=lambda r: -(r.ts or 0))[:1] + [
        r for r in got.collect() if r.ts is None] + [r for r in got.collect() if r.ts == 1]
    assert (first.ts, first.ip_total_length, first.ip_src, first.udp_sport) == (
        1428745323, 1500, "1.2.3.4", 53)
    assert first.udp_checksum is None and first.tcp_sport is None
    assert all(v is None for v in second)
    assert third.ip_version == 4 and third.ip_src is None
    assert rows(records.parse_packets(spark.read.text(path))) == rows(got)


def test_flow_lines_with_any_separator(spark, tmp_path):
    path = _write(tmp_path / "f.txt", '1,TCP,1.1.1.1,2.2.2.2,80,99,3,400,".A.,0\n')
    (got,) = records.flow_scan(spark, path, ",").collect()
    assert tuple(got) == (1, "TCP", "1.1.1.1", "2.2.2.2", 80, 99, 3, 400, '".A.', 0)


def test_flow_export(spark, tmp_path):
    row = "2015-04-11 09:42:03,2015-04-11 09:42:04,1.0,{},{},53,80,UDP,......,0,2,7,900,0,0\n"
    path = _write(tmp_path / "x.csv", row.format("9.9.9.9", "145.58.1.1")
                  + row.format("145.58.2.2", "145.58.1.1") + row.format("145.58.1.1", "9.9.9.9"))
    got = records.flow_prepare(records.flow_export_scan(spark, path), "145.58.0.0/16")
    assert got.schema.names == schemas.FLOWS.names
    assert rows(got) == [
        (1428745323, "UDP", "9.9.9.9", "145.58.1.1", 53, 80, 7, 900, "......", 2)]


def test_dimensions(spark, tmp_path):
    path = _write(tmp_path / "d.txt", "6,TCP\n84,TTP\n84,IPTM\n")
    assert rows(records.protocol_dim_scan(spark, path)) == [
        (6, "TCP"), (84, "IPTM"), (84, "TTP")]
    assert records.port_dim_scan(spark, path).count() == 3
    path = _write(tmp_path / "a.txt", "NA;203.0.113.1;NA;;NA\n64502;192.0.2.8;192.0.2.0/24;NZ;U-NZ\n")
    assert rows(records.asn_dim_scan(spark, path)) == [
        ("64502", "192.0.2.8", "192.0.2.0/24", "NZ", "U-NZ"),
        ("NA", "203.0.113.1", "NA", None, "NA")]


def test_registry_response(spark, tmp_path):
    path = _write(tmp_path / "w.txt", "Bulk mode; registry [now]\n"
                  "64501   | 198.51.100.44    | 198.51.100.0/24 | NZ | PINEHILL Pinehill Carrier, NZ\n"
                  "NA      | 203.0.113.71     | NA              |    | NA\n")
    assert rows(records.whois_scan(spark, path)) == [
        ("64501", "198.51.100.44", "198.51.100.0/24", "NZ", "PINEHILLPinehillCarrier-NZ"),
        ("NA", "203.0.113.71", "NA", None, "NA")]


ALERT = ("03/07/19-06:05:04.000250  [**] [3:9001:2] made-up rule, long body [**] [Priority: 3] "
         "{UDP} 198.51.100.7:5353 -> 203.0.113.9:137")
ICMP = ("03/07/19-06:05:05.300000  [**] [1:42:7] odd echo [**] [Classification: Just a test] "
        "[Priority: 12] {IPV6-ICMP} 2001:db8::7 -> 2001:db8::9")
SIX = ("03/07/19-06:05:06.000000 [**] [1:43:1] v6 web [**] [Priority: 1] {TCP} "
       "2001:db8:0:0:0:0:0:7:40000 -> 2001:db8:0:0:0:0:0:9:443")
BARE = ("03/07/19-06:05:07.000000  [**] [1:44:1] [x] {y} [**] [Priority: 2] {PROTO-089} "
        "198.51.100.7 -> 203.0.113.9")


def test_alert_lines(spark, tmp_path):
    torn = ["torn line [**] [1:2", "", "03/07/19-06:05:04.0  [**] [1:2:3] no end [**] [Priority: 1]",
            "[**] no time [**] [Priority: 1] {TCP} a -> b"]
    path = _write(tmp_path / "alert", "\n".join([ALERT, *torn, ICMP, SIX, BARE]) + "\n")
    assert rows(alerts.alert_scan(spark, path)) == [
        (1551938704, "3_9001", 3, "made-up rule, long body", "UDP", "198.51.100.7", 5353,
         "203.0.113.9", 137),
        (1551938705, "1_42", 12, "odd echo", "IPV6-ICMP", "2001:db8::7", 0, "2001:db8::9", 0),
        (1551938706, "1_43", 1, "v6 web", "TCP", "2001:db8:0:0:0:0:0:7", 40000,
         "2001:db8:0:0:0:0:0:9", 443),
        (1551938707, "1_44", 2, "[x] {y}", "PROTO-089", "198.51.100.7", 0, "203.0.113.9", 0)]
    # The fraction read as milliseconds shifts the time.
    assert [r[0] for r in rows(alerts.alert_scan(spark, path, compat=True))] == [
        1551938704, 1551938706, 1551938707, 1551938705 + 300]


BLOCK = """.-[ {} (syn) ]-
|
| {}   = x
{}|
`----

"""


def test_fingerprint_blocks(spark, tmp_path):
    one, two = "1.1.1.1/10 -> 2.2.2.2/80", "3.3.3.3/11 -> 2.2.2.2/80"
    path = _write(tmp_path / "fp.log", "".join([
        BLOCK.format(one, "client", "| os       = Linux\n| dist     = 3\n"),
        BLOCK.format(one, "client", "| os       = Linux 3\n| uptime   = 4 days\n"),
        BLOCK.format(one, "server", "| os       = ???\n"),
        BLOCK.format(two, "client", "| note     = nothing known\n"),
        BLOCK.format(two, "server", "| raw_sig  = 4:52:0\n"),
    ]))
    got = fingerprints.fingerprint_scan(spark, path)
    assert rows(got, "src", "sport", "dst", "dport", "os", "dist", "uptime", "raw_sig") == [
        ("1.1.1.1", 10, "2.2.2.2", 80, "Linux 3", "3", "4 days", None),
        ("2.2.2.2", 80, "1.1.1.1", 10, "???", None, None, None),
        ("2.2.2.2", 80, "3.3.3.3", 11, None, None, None, "4:52:0")]


def test_conversation_json(spark, tmp_path):
    base = {"src": "a", "sport": 1, "dst": "b", "dport": 2, "end_state": "close"}
    path = _write(tmp_path / "c.json", "\n".join(json.dumps({**base, "ts": s[0], "timestamps": s})
                                                 for s in ([10.5], [20.5, 20.75, 21.0, 25.5])))
    got = sorted(tuple(r) for r in conversations.conversation_scan(spark, path).collect())
    assert got == [
        (10, "a", 1, "b", 2, "close", [10], []),
        (20, "a", 1, "b", 2, "close", [20, 20, 21, 25], [0.25, 0.5, 5.0])]


HEADERS = ("5.9\t1.1.1.1\t10\t2.2.2.2\t80\tGET / HTTP/1.1\ts\t{}\t{}")


def test_http_header_lines(spark, tmp_path):
    path = _write(tmp_path / "h.tsv", "\n".join([
        HEADERS.format("user-agent", "curl/7"), HEADERS.format("host", "user-agent"),
        HEADERS.format("user-agent", ""), "too\tshort"]))
    key = (5, "1.1.1.1", 10, "2.2.2.2", 80)
    assert rows(http.http_field_scan(spark, path)) == [(*key, "curl/7")]
    assert rows(http.http_field_scan(spark, path, "host")) == [(*key, "user-agent")]
    got = [tuple(r) for r in http.http_all_fields_scan(spark, path).collect()]
    assert sorted(got, key=str) == sorted([
        (*key, "GET / HTTP/1.1", ["user-agent", "curl/7"]),
        (*key, "GET / HTTP/1.1", ["host", "user-agent"]),
        (*key, "GET / HTTP/1.1", ["user-agent"])], key=str)


def test_http_messages(spark):
    def message(*head, body=""):
        return "\r\n".join(head) + "\r\n\r\n" + body

    frame = spark.createDataFrame([
        (1, message("GET / HTTP/1.1", "A: 1", "a: 2", "Content-Length: 3", body="abcdef")),
        (2, message("GET / HTTP/1.1", "Host: x: y", "no header here", body="abc\r\n\r\nd")),
        (3, message("GET / HTTP/1.1", body="x")), (4, "no head"),
        (5, message("POST /", "Content-Length: 4", body="äöü")),
        (6, message("POST /", "Content-Length: many", body="abc")), (7, None),
    ], "id int, message string")
    got = {r.id: (r.status, r.headers, r.payload)
           for r in http.http_message_split(frame).collect()}
    assert got == {
        1: ("GET / HTTP/1.1", {"a": "2", "content-length": "3"}, "abc"),
        2: ("GET / HTTP/1.1", {"host": "x: y"}, ""),
        5: ("POST /", {"content-length": "4"}, "äö"),
        6: ("POST /", {"content-length": "many"}, "")}
    # The original splitter loses the last header.
    got = {r.id: (r.headers, r.payload)
           for r in http.http_message_split(frame, compat=True).collect()}
    assert got[1] == ({"a": "2"}, "")


def test_message_bodies_are_cut_by_bytes(spark):
    """A cut through a character, a body that is no text, and line ends at odd places of it."""
    head = b"POST / HTTP/1.1\r\nContent-Length: %d\r\nX: \xc3\xa9\r\n\r\n"
    bodies = [("é日本".encode(), 4), (bytes(range(256)) * 2, 512), (b"\x00\r\n\r\n\xff", 6)]
    frame = spark.createDataFrame([(i, head % n + body) for i, (body, n) in enumerate(bodies)],
                                  "id int, message binary")
    found = {r.id: r for r in http.http_message_split(frame).collect()}
    for i, (body, n) in enumerate(bodies):
        assert bytes(found[i].payload_bytes) == body[:n] and found[i].headers["x"] == "é"
        assert found[i].payload == body[:n].decode(errors="replace")
    assert found[0].payload == "é\ufffd"


def test_http_files(spark):
    frame = spark.createDataFrame([
        (1, "abc", "text/html", ".html", "c", "GET /a/b?c=1 HTTP/1.1"),
        (2, "", "image/png", ".png", "s", "GET /x HTTP/1.1"),
        (3, "d", "image/png", ".png", "c", "GET"),
        (4, "d", "image/png", ".png", "c", "GET /" + "y" * 80 + " HTTP/1.1"),
    ], "id int, payload string, mimetype string, ext string, direction string, request string")
    got = {r.id: r for r in http.http_file_hashes(frame).collect()}
    assert [got[i].name for i in (1, 2, 3, 4)] == ["_a_b_c_1", "-", "-", "y" * 50]
    assert got[1].md5 == hashlib.md5(b"abc").hexdigest() and got[2].size == 0
    assert got[1].sha256 == hashlib.sha256(b"abc").hexdigest()
    for mime in ("image/png", ".png", "png"):
        assert {r.id for r in http.http_file_hashes(frame, mime).collect()} == {2, 3, 4}


def test_dns_messages(spark, tmp_path):
    question = {"qname": "q.", "qtype": 1, "qclass": 1}

    def answer(kind, **data):
        return {"qname": "q.", "qtype": kind, "qclass": 1, "qttl": 60, "qrdata": data}

    messages = [
        {"ts": 1.5, "id": 7, "mode": "query", "srcIP": "a", "dstIP": "b",
         "questions": [question, question], "answers": []},
        {"ts": 2.5, "id": 7, "mode": "response", "srcIP": "b", "dstIP": "a",
         "questions": [question], "answers": [
             answer(1, IPAddress="1.2.3.4"), answer(28, IPAddress="::1"),
             answer(15, Target="mail."), answer(16, Strings=["x", "y"]), answer(5)]},
        {"ts": 3.5, "id": 8, "mode": "response", "questions": [], "answers": []},
    ]
    path = _write(tmp_path / "d.json", "\n".join(map(json.dumps, messages)))
    read = dns.read_messages(spark, path)
    assert rows(dns.dns_rows(read)) == sorted([
        (1, 7, "query", "q.", None, 0), (1, 7, "query", "q.", None, 0),
        (2, 7, "response", "q.", "1.2.3.4", 60), (2, 7, "response", "q.", "::1", 60),
        *[(2, 7, "response", "q.", None, 60)] * 3], key=str)
    everything = dns.dns_all_rows(read)
    assert rows(everything, "mode", "addr", "ttl", "type", "src_ip") == sorted([
        ("question", None, 0, 1, "a"), ("question", None, 0, 1, "a"),
        ("response", None, 0, 1, "b"), ("response", "1.2.3.4", 60, 1, "b"),
        ("response", "::1", 60, 28, "b"), ("response", "mail.", 60, 15, "b"),
        ("response", "[x, y]", 60, 16, "b"), ("response", None, 60, 5, "b")], key=str)
    assert rows(dns.dns_packet_rows(read).filter("addr is not null"), "addr") == [("1.2.3.4",)]


# Capture files --------------------------------------------------------------------------------

def _frame(proto, transport, src=b"\x01\x02\x03\x04", dst=b"\x05\x06\x07\x08", fragment=0,
           options=b"", kind=0x0800, payload=b""):
    length = 20 + len(options) + len(transport) + len(payload)
    ip = struct.pack(">BBHHHBBH", 0x40 | (20 + len(options)) // 4, 1, length, 77, fragment, 64,
                     proto, 0xBEEF) + src + dst + options
    return b"\0" * 12 + struct.pack(">H", kind) + ip + transport + payload


TCP_HEADER = struct.pack(">HHIIHHHH", 1000, 80, 0xFFFFFFFF, 5, 5 << 12 | 0x112, 4096, 0, 0)
UDP_HEADER = struct.pack(">HHHH", 53, 4000, 13, 999)


def _capture(frames, order="<", magic=0xA1B2C3D4, link=1, tail=b""):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for i, frame in enumerate(frames):
        out += struct.pack(order + "IIII", 3_000_000_000 + i, 5, len(frame), len(frame)) + frame
    return out + tail


FRAMES = [
    _frame(6, TCP_HEADER, payload=b"hello", options=b"\x01" * 4),
    _frame(17, UDP_HEADER, payload=b"abcde", fragment=0x2000),
    b"\xff" * 60,
    _frame(17, UDP_HEADER, fragment=0x0010),
    _frame(1, b"\x08\0\0\0"),
    _frame(6, TCP_HEADER[:12]),
    b"short",
]


def _summary(df):
    return rows(df, "ts", "ip_proto", "ip_total_length", "ip_more_fragments", "tcp_sport",
                "tcp_seq_id", "tcp_ns", "tcp_ack", "tcp_syn", "tcp_len", "udp_sport", "udp_len",
                "udp_checksum")


EXPECTED = sorted([
    (3000000000, 6, 49, 0, 1000, 4294967295, 1, 1, 1, 5, None, None, None),
    (3000000001, 17, 33, 1, None, None, None, None, None, None, 53, 13, "999"),
    (3000000003, 17, 28, 0, None, None, None, None, None, None, None, None, None),
    (3000000004, 1, 24, 0, None, None, None, None, None, None, None, None, None),
    (3000000005, 6, 32, 0, None, None, None, None, None, None, None, None, None),
], key=str)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("magic", [0xA1B2C3D4, 0xA1B23C4D])
def test_capture_orders(spark, tmp_path, order, magic):
    (tmp_path / "a.pcap").write_bytes(_capture(FRAMES, order, magic))
    got = capture.packet_scan_pcap(spark, str(tmp_path / "a.pcap"))
    assert got.schema == schemas.PACKETS
    assert _summary(got) == EXPECTED
    assert got.first().ip_src == "1.2.3.4" and got.first().ip_dst == "5.6.7.8"


def test_capture_folder_compression_and_tail(spark, tmp_path):
    torn = _capture(FRAMES, tail=struct.pack("<IIII", 1, 1, 500, 500) + b"only a bit")
    (tmp_path / "a.pcap").write_bytes(torn)
    (tmp_path / "b.pcap.gz").write_bytes(gzip.compress(torn))
    (tmp_path / "c.pcap.bz2").write_bytes(bz2.compress(torn))
    (tmp_path / "d.pcap.gz").write_bytes(gzip.compress(torn)[:-12])
    (tmp_path / "e.pcap").write_bytes(_capture([]))
    got = capture.packet_scan_pcap(spark, str(tmp_path))
    assert _summary(got) == sorted(EXPECTED * 4, key=str)
    assert got.rdd.getNumPartitions() == 5


def test_capture_blocks_join_records(monkeypatch, tmp_path):
    (tmp_path / "a.pcap").write_bytes(_capture(FRAMES * 50))
    whole = [b.to_pydict() for b in capture.read_capture(str(tmp_path / "a.pcap"))]
    monkeypatch.setattr(capture, "BLOCK", 97)
    parts = [b.to_pydict() for b in capture.read_capture(str(tmp_path / "a.pcap"))]
    assert len(parts) > 10
    assert whole[0] == {k: [v for p in parts for v in p[k]] for k in whole[0]}


def _relinked(link):
    """FRAMES under another link type; the two frames without a network header are left out."""
    head = {1: lambda f: f[:12] + b"\x81\0\0\x05" + f[12:],
            2: lambda f: f[:12] + b"\x88\xa8\0\x07\x81\0\0\x05" + f[12:],
            101: lambda f: f[14:], 113: lambda f: b"\0" * 14 + f[12:],
            276: lambda f: f[12:14] + b"\0" * 18 + f[14:]}[link]
    return [head(f) if len(f) > 14 else f for f in FRAMES]


@pytest.mark.parametrize("link", [1, 2, 101, 113, 276])
def test_tagged_frames_and_other_links(spark, tmp_path, link):
    (tmp_path / "a.pcap").write_bytes(_capture(_relinked(link), link=1 if link == 2 else link))
    assert _summary(capture.packet_scan_pcap(spark, str(tmp_path / "a.pcap"))) == EXPECTED


def test_unknown_link_type(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(_capture(FRAMES, link=105))
    with pytest.raises(Exception, match="link type 105"):
        capture.packet_scan_pcap(spark, str(tmp_path / "a.pcap")).collect()


def test_broken_record(spark, tmp_path):
    bad = struct.pack("<IIII", 1, 1, 0x7FFFFFF0, 60) + b"\0" * 10_000
    (tmp_path / "a.pcap").write_bytes(_capture(FRAMES, tail=bad))
    with pytest.raises(Exception, match="more bytes than a frame"):
        capture.packet_scan_pcap(spark, str(tmp_path / "a.pcap")).collect()
    kept = capture.packet_scan_pcap(spark, str(tmp_path / "a.pcap"), bad_records="stop")
    assert _summary(kept) == EXPECTED


def test_no_capture(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(b"not a capture file at all")
    with pytest.raises(Exception, match="is not a capture file"):
        capture.packet_scan_pcap(spark, str(tmp_path / "a.pcap")).collect()


def test_capture_overwrite(spark, tmp_path):
    capture.register_capture(spark)
    folder = str(tmp_path / "out")
    frame = packets(spark, [udp(1, "1.1.1.1", dst="2.2.2.2", ip_tos=3)]).coalesce(1)
    for _ in range(2):
        frame.write.format("capture").mode("overwrite").save(folder)
    (got,) = capture.packet_scan_pcap(spark, folder).collect()
    assert (got.ts, got.ip_src, got.ip_tos, got.udp_dport) == (1, "1.1.1.1", 3, 53)


# Sinks ----------------------------------------------------------------------------------------

def test_csv_and_tab_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("US", 21), ("NONE", 7)], "country string, sips long")
    sinks.csv_report_sink(frame.repartition(2), str(tmp_path / "many"))
    assert len(list((tmp_path / "many").glob("part-*"))) == 2
    sinks.csv_report_sink(frame, str(tmp_path / "csv"), single_file=True)
    (part,) = (tmp_path / "csv").glob("part-*")
    assert part.read_text().splitlines()[0] == "country,sips"
    sinks.delimited_sink(frame, str(tmp_path / "tab"))
    text = "".join(p.read_text() for p in (tmp_path / "tab").glob("part-*"))
    assert sorted(text.splitlines()) == ["NONE\t7", "US\t21"]


def test_json_sink_writes_nulls(spark, tmp_path):
    frame = spark.createDataFrame(
        [(1, None, ("x", 2), [1, 2], {"k": "v"})],
        "a int, b string, t struct<p:string,q:int>, bag array<int>, m map<string,string>")
    sinks.json_sink(frame, str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    assert json.loads(text) == {"a": 1, "b": None, "t": {"p": "x", "q": 2}, "bag": [1, 2],
                                "m": {"k": "v"}}


def test_connection_split(spark, tmp_path):
    frame = packets(spark, [
        tcp(1, "1.1.1.1", "2.2.2.2", sport=10, dport=80),
        tcp(2, "2.2.2.2", "1.1.1.1", sport=80, dport=10),
        tcp(3, "1.1.1.1", "2.2.2.2", sport=11, dport=80), udp(4, "1.1.1.1", "2.2.2.2")])
    sinks.connection_split(frame, str(tmp_path / "s"), groups=8)
    split = spark.read.parquet(str(tmp_path / "s"))
    assert split.count() == 3
    one = sinks.connection_packets(split, "1.1.1.1.10-2.2.2.2.80", groups=8)
    assert rows(one.select(F.col("ts"))) == [(1,), (2,)]
