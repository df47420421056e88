"""Allow-listed sources, whose alerts are suppressed."""

from __future__ import annotations

from functools import reduce
from ipaddress import IPv4Network

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_allowed(ip: Column, entries: list[str], mode: str = "cidr") -> Column:
    """True for addresses on a configured list of addresses and networks.

    ``prefix`` compares the text before the network's last dot and so ignores the
    mask length; ``cidr`` tests the network's address range.
    """
    tests = [ip.isin(list(entries))] if entries else [F.lit(False)]
    for entry in (e for e in entries if "/" in e):
        if mode == "cidr":
            tests.append(_in_network(ip, entry))
        else:
            tests.append(ip.startswith(entry.split("/")[0].rsplit(".", 1)[0]))
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def ip_number(ip: Column) -> Column:
    """Dotted IPv4 address as a number; null for other text."""
    parts = F.split(ip, r"\.")
    values = [F.try_element_at(parts, F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    number = reduce(lambda total, v: total * 256 + v, values)
    return F.when(F.size(parts) == 4, number)


def _in_network(ip: Column, entry: str) -> Column:
    network = IPv4Network(entry, strict=False)
    low, high = int(network.network_address), int(network.broadcast_address)
    return F.coalesce(ip_number(ip).between(low, high), F.lit(False))


def drop_listed(df: DataFrame, listed: DataFrame, ip: str = "source_ip") -> DataFrame:
    """Rows whose address is not in a table of addresses.

    The join is left to Spark, which broadcasts the table only when its size allows.
    """
    return df.join(listed.select(F.col(ip)), ip, "left_anti")


def drop_networks(df: DataFrame, networks: DataFrame, ip: str = "source_ip") -> DataFrame:
    """Rows whose address lies in none of a table's networks (column ``cidr``).

    Networks become (mask length, network number) pairs, so that every mask
    length in use is one equality join however many networks there are. An
    address without mask is a network of one; entries that are no network are
    skipped, see ``bad_networks``.
    """
    parts = _networks(networks).where(_valid())
    nets = parts.select("bits", _network_number(F.col("_base"), F.col("bits")).alias("_net")).distinct()
    lengths = [r.bits for r in nets.select("bits").distinct().collect()]  # lengths from 0 to 32
    kept = df.withColumn("_number", ip_number(F.col(ip)))
    for bits in lengths:
        side = nets.where(F.col("bits") == bits).select(F.col("_net").alias(f"_net{bits}"))
        here = _network_number(F.col("_number"), F.lit(bits))
        kept = kept.join(side, here == F.col(f"_net{bits}"), "left_anti")
    return kept.drop("_number")


def _networks(networks: DataFrame) -> DataFrame:
    bits = F.when(F.contains("cidr", F.lit("/")), F.substring_index("cidr", "/", -1).try_cast("int")).otherwise(F.lit(32))
    return networks.select("cidr", bits.alias("bits"), ip_number(F.substring_index("cidr", "/", 1)).alias("_base"))


def _valid() -> Column:
    return F.coalesce(F.col("bits").between(0, 32) & F.col("_base").isNotNull(), F.lit(False))


def bad_networks(networks: DataFrame) -> DataFrame:
    """Entries of a table of networks that are none."""
    return _networks(networks).where(~_valid()).select("cidr")


def _network_number(number: Column, bits: Column) -> Column:
    return F.call_function("shiftright", number, F.lit(32) - bits)
