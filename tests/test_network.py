"""Addresses and networks of both versions, against Python's own reading of them."""

import ipaddress

from pyspark.sql import functions as F

from sqltraffic.functions import network
from sqltraffic.operators import gates

ADDRESSES = ["10.0.5.1:3306", "10.0.6.1", "::ffff:10.0.5.1", "[::ffff:10.0.5.7]:99", "::ffff:a00:501", "2001:db8::1", "[2001:db8:1::5]:80", "fe80::1", "", "nonsense", "1.2.3", "2001:db8:::1", None]
NETWORKS = ["10.0.5.0/24", "10.0.0.0/8", "2001:db8::/48", "::ffff:10.0.5.0/120", "::/0", "0.0.0.0/0", "2001:db8::1/128"]


def _inside(address, cidr):
    host = address.strip("[]").split("]")[0] if address.count(":") > 1 else address.split(":")[0]
    a, net = ipaddress.ip_address(host), ipaddress.ip_network(cidr)
    mapped = getattr(a, "ipv4_mapped", None)
    a = mapped or a
    if net.version == 6 and net.network_address.ipv4_mapped and net.prefixlen >= 96:
        net = ipaddress.ip_network(f"{net.network_address.ipv4_mapped}/{net.prefixlen - 96}")
    return a.version == net.version and a in net


def _expected(cidr):
    out = []
    for a in ADDRESSES:
        try:
            out.append(_inside(a, cidr))
        except (ValueError, AttributeError):
            out.append(None)
    return out


def test_inside(spark):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ADDRESSES)], "i int, a string").orderBy("i")
    host = network.host(F.col("a"))
    for cidr in NETWORKS:
        rows = df.select(network.inside_any(host, [cidr]), network.inside_each(host, F.array(F.lit(cidr)))).collect()
        assert [r[0] for r in rows] == [r[1] for r in rows] == _expected(cidr), cidr


def test_mapped_addresses_are_excluded(spark):
    log = spark.createDataFrame([(a,) for a in ADDRESSES], "source_ip string")
    kept = {r[0] for r in gates.gate_by_cidr(log, ["10.0.0.0/8"], ["10.0.5.0/24"]).collect()}
    assert kept == {"10.0.6.1", "", "nonsense", "1.2.3", "2001:db8:::1", None}


def test_join_keeps_columns_and_takes_both_versions(spark):
    log = spark.createDataFrame([(a, i, "p") for i, a in enumerate(ADDRESSES)], "source_ip string, length int, prefix string")
    nets = spark.createDataFrame([(c, c) for c in [*NETWORKS, "bad", "10.0.0.0/99"]], "name string, cidr string")
    found = gates.cidr_join(log, nets)
    assert found.columns == ["source_ip", "length", "prefix", "name"]
    got = {(r["length"], r["name"]) for r in found.collect()}
    assert got == {(i, c) for c in NETWORKS for i, x in enumerate(_expected(c)) if x}


def test_policy_lists(spark):
    log = spark.createDataFrame([(a,) for a in ADDRESSES], "source_ip string")
    row = lambda allow, exclude: {r[0] for r in log.where(gates.policy_cidr_passes(F.col("source_ip"), allow, exclude)).collect()}
    none = F.lit(None).cast("array<string>")
    assert row(none, none) == set(ADDRESSES)
    assert row(F.array(F.lit("10.0.0.0/8")), F.array(F.lit("10.0.5.0/24"))) == {"10.0.6.1", "", "nonsense", "1.2.3", "2001:db8:::1", None}
