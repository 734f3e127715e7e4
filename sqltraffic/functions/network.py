"""Addresses and networks as column expressions."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_IPV4 = r"\A(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\z"


def host(source: Column) -> Column:
    """The address without its port: a.b.c.d:p and [v6]:p."""
    return F.regexp_replace(F.regexp_replace(source, r"\A\[([^\]]*)\](?::[0-9]+)?\z", "$1"), r"\A([0-9.]+):[0-9]+\z", "$1")


def ipv4_number(address: Column) -> Column:
    """The address as a number; null if it is no IPv4 address."""
    parts = F.split(address, r"\.")
    return F.when(address.rlike(_IPV4), F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p.cast("long")))


def networks(cidrs: list[str]) -> list[tuple[int, int, int]]:
    """(version, first, last) of each; a bad one is a ValueError."""
    found = [ipaddress.ip_network(c, strict=False) for c in cidrs]
    low_high = [(n.version, int(n.network_address), int(n.broadcast_address)) for n in found]
    # A network of mapped addresses is one of IPv4 addresses.
    return [(4, low & 0xFFFFFFFF, high & 0xFFFFFFFF) if v == 6 and low >> 32 == high >> 32 == 0xFFFF else (v, low, high) for v, low, high in low_high]


def ipv6_hex(address: Column) -> Column:
    """An IPv6 address as 32 hex digits, null if it is none; `::` stands for the groups that are missing.

    Hex texts of one length order as the numbers do, so containment is BETWEEN.
    """
    halves = F.split(F.lower(address), "::", 2)
    groups = lambda half: F.filter(F.split(half, ":"), lambda g: g != "")
    left, right = groups(halves[0]), F.when(F.size(halves) > 1, groups(F.get(halves, 1))).otherwise(F.array().cast("array<string>"))
    missing = 8 - F.size(left) - F.size(right)
    every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    fine = address.rlike(r"(?i)\A[0-9a-f:]+\z") & address.contains(":") & F.forall(every, lambda g: g.rlike(r"\A[0-9a-f]{1,4}\z"))
    fine &= ~address.rlike("::.*::|:::")
    fine &= F.when(address.contains("::"), missing >= 1).otherwise(missing == 0)
    return F.when(fine, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))


def _dotted_as_hex(address: Column) -> Column:
    """An IPv6 address whose end is written as IPv4, with two groups of hex digits there."""
    tail = F.regexp_extract(address, r"(?s)\A.*:([0-9.]+)\z", 1)
    n = ipv4_number(tail)
    groups = F.concat_ws(":", F.lower(F.hex(F.shiftright(n, 16))), F.lower(F.hex(n.bitwiseAND(F.lit(0xFFFF)))))
    return F.when(n.isNotNull(), F.concat(F.regexp_replace(address, r"[0-9.]+\z", ""), groups)).otherwise(address)


_MAPPED = "0" * 20 + "ffff"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def number(address: Column) -> Column:
    """(v4, v6): the address as an IPv4 number or as 32 hex digits; the other, or both, null. An IPv4-mapped IPv6 address is its IPv4 one."""
    six = F.when(address.contains(":"), _let(_dotted_as_hex(address), ipv6_hex))
    mapped = lambda x: F.when(x.startswith(_MAPPED), F.conv(F.substring(x, 25, 8), 16, 10).cast("long"))
    return _let(six, lambda x: F.struct(F.coalesce(ipv4_number(address), mapped(x)).alias("v4"), F.when(~x.startswith(_MAPPED), x).alias("v6")))


def bits(address: Column) -> Column:
    """The address as a text: its version and its bits, so that a network is a prefix of those in it; null if it cannot be read."""
    four = lambda n: F.concat(F.lit("4"), F.lpad(F.bin(n["v4"]), 32, "0"))
    six = lambda n: F.concat(F.lit("6"), *[F.lpad(F.bin(F.conv(F.substring(n["v6"], 8 * i + 1, 8), 16, 10).cast("long")), 32, "0") for i in range(4)])
    return _let(number(address), lambda n: F.coalesce(four(n), six(n)))


def prefix(cidr: Column) -> Column:
    """The version and leading bits that the addresses of a network (address/length) have; null if it is none."""
    parts = F.split(cidr, "/")
    address, length = F.get(parts, F.lit(0)), F.try_element_at(parts, F.lit(2)).cast("int")

    def cut(every: Column) -> Column:
        own = length - F.when(address.contains(":") & every.startswith("4"), 96).otherwise(0)  # 96 of a mapped network's are fixed
        return F.when((own >= 0) & (own < F.length(every)), F.substring(every, F.lit(1), 1 + own))

    return _let(bits(address), cut)


def inside_each(address: Column, cidrs: Column) -> Column:
    """Whether the address is in one of the row's own networks (an array); null if it cannot be read. No or a null list has none."""
    nets = F.transform(F.coalesce(cidrs, F.array().cast("array<string>")), prefix)
    return _let(bits(address), lambda own: F.when(own.isNotNull(), F.exists(nets, lambda p: F.coalesce(own.startswith(p), F.lit(False)))))


def inside_any(address: Column, cidrs: list[str]) -> Column:
    """Whether the address is in one of a short list of networks; null if it cannot be read."""

    def test(n: Column) -> Column:
        found = F.lit(False)
        for version, low, high in networks(cidrs):
            found = found | F.coalesce(n["v4"].between(low, high) if version == 4 else n["v6"].between(f"{low:032x}", f"{high:032x}"), F.lit(False))
        return F.when(n["v4"].isNotNull() | n["v6"].isNotNull(), found)

    return _let(number(address), test)
