"""Record schemas of every relation the library reads or produces."""

from __future__ import annotations

from pyspark.sql import types as T

_INT, _LONG, _DOUBLE, _STR = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()


def _struct(columns: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


# The record layouts of the input formats.
PACKETS = _struct([
    ("ts", _LONG),
    ("ip_version", _INT),
    ("ip_header_length", _INT),
    ("ip_tos", _INT),
    ("ip_total_length", _INT),
    ("ip_id", _INT),
    ("ip_flags", _INT),
    ("ip_more_fragments", _INT),
    ("ip_ttl", _INT),
    ("ip_proto", _INT),
    ("ip_checksum", _INT),
    ("ip_src", _STR),
    ("ip_dst", _STR),
    ("tcp_sport", _INT),
    ("tcp_dport", _INT),
    ("tcp_seq_id", _LONG),
    ("tcp_ack_id", _LONG),
    ("tcp_offset", _INT),
    ("tcp_ns", _INT),
    ("tcp_cwr", _INT),
    ("tcp_ece", _INT),
    ("tcp_urg", _INT),
    ("tcp_ack", _INT),
    ("tcp_psh", _INT),
    ("tcp_rst", _INT),
    ("tcp_syn", _INT),
    ("tcp_fin", _INT),
    ("tcp_window", _INT),
    ("tcp_len", _INT),
    ("udp_sport", _INT),
    ("udp_dport", _INT),
    ("udp_len", _INT),
    ("udp_checksum", _STR),
])

#: What a capture file holds beyond the packet layout: microseconds since 1970, the fragment offset
#: (in units of 8 bytes) and the payload behind a TCP or UDP header.
CAPTURED = T.StructType([
    *PACKETS.fields,
    T.StructField("ts_micros", _LONG),
    T.StructField("ip_frag_offset", _INT),
    T.StructField("payload", T.BinaryType()),
])

FLOWS = _struct([
    ("ts", _LONG),
    ("ip_proto", _STR),
    ("ip_src", _STR),
    ("ip_dst", _STR),
    ("sport", _INT),
    ("dport", _INT),
    ("pkts", _LONG),
    ("byts", _LONG),
    ("tcp_flg", _STR),
    ("stos", _INT),
])

# Comma-separated flow export, in the exporter's column order.
FLOW_EXPORT = _struct([
    ("first_seen", _STR),
    ("last_seen", _STR),
    ("duration", _STR),
    ("src_addr", _STR),
    ("dst_addr", _STR),
    ("src_port", _STR),
    ("dst_port", _STR),
    ("protocol", _STR),
    ("flags", _STR),
    ("forwarding", _STR),
    ("tos", _STR),
    ("in_packets", _STR),
    ("in_bytes", _STR),
])

PROTOCOL_DIM = _struct([("ip_proto_number", _INT), ("ip_proto_desc", _STR)])
PORT_DIM = _struct([("port_number", _INT), ("port_desc", _STR)])
ASN_DIM = _struct([
    ("asn", _STR),
    ("ip", _STR),
    ("bgp_prefix", _STR),
    ("country", _STR),
    ("as_info", _STR),
])

ALERTS = _struct([
    ("ts", _LONG),
    ("sig", _STR),
    ("priority", _INT),
    ("message", _STR),
    ("proto", _STR),
    ("src", _STR),
    ("sport", _INT),
    ("dst", _STR),
    ("dport", _INT),
])

CONVERSATIONS = _struct([
    ("ts", _LONG),
    ("src", _STR),
    ("sport", _INT),
    ("dst", _STR),
    ("dport", _INT),
    ("end_state", _STR),
    ("timestamps", T.ArrayType(_LONG)),
    ("intervals", T.ArrayType(_DOUBLE)),
])

# One JSON object per line, as written by the conversation and DNS exporters.
CONVERSATION_JSON = _struct([
    ("ts", _DOUBLE),
    ("src", _STR),
    ("sport", _INT),
    ("dst", _STR),
    ("dport", _INT),
    ("end_state", _STR),
    ("timestamps", T.ArrayType(_DOUBLE)),
])

_DNS_QUESTION = _struct([("qname", _STR), ("qtype", _INT), ("qclass", _INT)])
_DNS_DATA = _struct([
    ("IPAddress", _STR),
    ("Target", _STR),
    ("Strings", T.ArrayType(_STR)),
])
_DNS_ANSWER = _struct([
    ("qname", _STR),
    ("qtype", _INT),
    ("qclass", _INT),
    ("qttl", _LONG),
    ("qrdata", _DNS_DATA),
])
DNS_JSON = _struct([
    ("ts", _DOUBLE),
    ("id", _LONG),
    ("mode", _STR),
    ("srcIP", _STR),
    ("dstIP", _STR),
    ("questions", T.ArrayType(_DNS_QUESTION)),
    ("answers", T.ArrayType(_DNS_ANSWER)),
])

FINGERPRINT_ATTRIBUTES = [
    "os", "app", "dist", "lang", "link", "params", "raw_freq", "raw_mtu", "raw_sig", "uptime",
]
