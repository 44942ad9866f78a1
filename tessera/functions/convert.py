"""Texts of logs and exports as typed columns. What can't be converted is NULL, never zero."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

YES, NO = ("true", "yes", "y", "t", "1", "on"), ("false", "no", "n", "f", "0", "off")
QUAD = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def stripped(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")


def trimmed(x: Column) -> Column:
    """Without white space at both ends; NULL if nothing is left."""
    return F.nullif(stripped(x), F.lit(""))


def whole(x: Column) -> Column:
    """A whole number in decimal digits, as a long."""
    return F.when(stripped(x).rlike(r"^[+-]?\d+$"), stripped(x).try_cast("bigint"))


def port(x: Column) -> Column:
    """0 to 65535."""
    return F.when(whole(x).between(0, 65535), whole(x)).cast("int")


def hexadecimal(x: Column) -> Column:
    """Up to 15 digits of base 16, with or without 0x."""
    digits = F.regexp_extract(stripped(x), r"^(?:0[xX])?([0-9A-Fa-f]{1,15})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("bigint"))


def truth(x: Column) -> Column:
    """The usual words of yes and no, in any case."""
    word = F.lower(stripped(x))
    return F.when(word.isin(*YES), True).when(word.isin(*NO), False)


def seconds(x: Column, unit: float = 1.0) -> Column:
    """A duration of zero or more, in units of so many seconds."""
    n = F.when(stripped(x).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), stripped(x).try_cast("double"))
    return F.when(n >= 0, n * unit)


def mac(x: Column) -> Column:
    """Six bytes in lower-case hexadecimal with colons."""
    text = F.lower(F.regexp_replace(stripped(x), "[-.]", ":"))
    return F.when(text.rlike("^([0-9a-f]{2}:){5}[0-9a-f]{2}$"), text)


def ipv4(x: Column) -> Column:
    """An address of four numbers up to 255, as a long."""
    parts = [F.regexp_extract(stripped(x), QUAD, i).cast("string").try_cast("bigint") for i in range(1, 5)]
    fine = stripped(x).rlike(QUAD) & (F.greatest(*parts) <= 255)
    return F.when(fine, parts[0] * (1 << 24) + parts[1] * (1 << 16) + parts[2] * 256 + parts[3])


def ipv6(x: Column) -> Column:
    """An address of eight groups, one run of zeros left out or not and the last two as an IPv4 address or not, as 32
    hexadecimal digits, so that texts sort as addresses do."""
    text = F.lower(stripped(x))
    tail = ipv4(F.regexp_extract(text, r"([0-9.]+)$", 1))
    ends = F.concat(F.regexp_replace(text, r"[0-9]+(\.[0-9]+){3}$", ""), F.hex(F.shiftright(tail, 16)), F.lit(":"), F.hex(tail.bitwiseAND(F.lit(65535))))
    text = F.lower(F.when(text.contains("."), ends).otherwise(text))
    sides = F.split(text, "::")
    left, right = F.split(F.get(sides, F.lit(0)), ":"), F.split(F.coalesce(F.get(sides, F.lit(1)), F.lit("")), ":")
    left, right = F.filter(left, lambda g: g != ""), F.filter(right, lambda g: g != "")
    short, n = F.size(sides) == 2, F.size(left) + F.size(right)
    groups = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), right)
    form = text.rlike("^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?(::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?)?$") & F.when(short, n <= 7).otherwise(n == 8)
    return F.when(x.contains(":"), F.when(form, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")))


def is_address(x: Column) -> Column:
    return ipv4(x).isNotNull() | ipv6(x).isNotNull()


def group_address(x: Column) -> Column:
    """Whether a text is an address of many: IPv4 from 224 to 239 and all ones, IPv6 that begins with ff."""
    n = ipv4(x)
    return F.coalesce(n.between(224 << 24, (240 << 24) - 1) | (n == (1 << 32) - 1), ipv6(x).startswith("ff"), F.lit(False))


def in_networks(x: Column, networks: list[str]) -> Column:
    """Whether a text lies in one of the networks (IPv4 or IPv6 address/bits); NULL if it is no address."""
    n, long, hits, six = ipv4(x), ipv6(x), F.lit(False), F.lit(False)
    for network in map(ipaddress.ip_network, networks):
        low, high = int(network.network_address), int(network.broadcast_address)
        if network.version == 4:
            hits = hits | n.between(low, high)
        else:
            six = six | long.between(f"{low:032x}", f"{high:032x}")
    return F.when(n.isNotNull(), hits).when(long.isNotNull(), six)


def nonzero(x: Column) -> Column:
    return F.when(x != 0, x)


def syn_count(flags: Column, n: Column) -> Column:
    """n where the flags of a TCP segment hold SYN."""
    return F.when(flags.bitwiseAND(F.lit(2)) != 0, n)


def first_whole(parts: Column) -> Column:
    """The first of an array of texts, as a whole number."""
    return whole(F.get(parts, F.lit(0)))


def joined(parts: Column) -> Column:
    return F.array_join(parts, "/")
