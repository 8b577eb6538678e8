"""IPv4 addresses as numbers, prefixes and label strings."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ipv4_to_long(address: Column | str) -> Column:
    """Dotted IPv4 text as a number; anything else gives null."""
    # The address is named once: where it is an expression, each mention would compute it anew. A
    # fifth part, or a part too few, gives a number that does not begin with the 1.
    octets = F.transform(F.split(_column(address), r"\.", 5), lambda part: part.try_cast("long"))
    return F.aggregate(
        octets, F.lit(1).cast("long"),
        lambda number, octet: F.when(octet.between(0, 255), number * 256 + octet),
        lambda number: F.when(F.shiftright(number, 32) == 1, number - (1 << 32)))


def long_to_ipv4(number: Column | str) -> Column:
    number = _column(number)
    return F.concat_ws(".", *[
        F.shiftright(number, shift).bitwiseAND(F.lit(255)).cast("string")
        for shift in (24, 16, 8, 0)
    ])


def in_network(address: Column | str, cidr: str) -> Column:
    """Whether the address lies in `cidr`; null for text that is no IPv4 address."""
    network = ipaddress.ip_network(cidr, strict=False)
    shift = 32 - network.prefixlen
    return (F.shiftright(ipv4_to_long(address), shift)
            == F.lit(int(network.network_address) >> shift).cast("long"))


def prefix_bounds(prefix: Column | str) -> tuple[Column, Column]:
    """Network number and prefix length of `a.b.c.d/len` text; nulls if malformed."""
    prefix = _column(prefix)
    length = F.get(F.split(prefix, "/"), F.lit(1)).try_cast("int")
    base = ipv4_to_long(F.get(F.split(prefix, "/"), F.lit(0)))
    valid = length.between(0, 32)
    return F.when(valid, base), F.when(valid, length)


def tcp_flag_columns(flags: Column | str) -> dict[str, Column]:
    """The nine TCP flag bits of a flags number as 0/1 columns."""
    flags = _column(flags)
    # Bit of each flag in the TCP header.
    bits = {"ns": 256, "cwr": 128, "ece": 64, "urg": 32, "ack": 16,
            "psh": 8, "rst": 4, "syn": 2, "fin": 1}
    return {
        name: (flags.bitwiseAND(F.lit(bit)) != 0).cast("int")
        for name, bit in bits.items()
    }
